import datetime as dt

import pytest

from gridloom.functions.numfmt import Formatted, format_value
from gridloom.functions.typed import parse_input, parse_tsv, to_tsv

FORMATS = [
    (0, "General", "en", "0"), (-12.5, "General", "en", "-12.5"), (12.5, "General", "es", "12,5"), (1 / 3, "General", "en", "0.333333333"), (123456789012, "General", "en", "1.23457E+11"), (0.0000000001234, "General", "en", "1.234E-10"),
    (1234.5, "0.00", "en", "1234.50"), (2.675, "0.00", "en", "2.68"), (1234567.891, "#,##0.00", "es", "1.234.567,89"), (0, "#,##0", "en", "0"), (0.5, "#.##", "en", ".5"), (0.256, "0%", "en", "26%"), (-5, "0.0", "en", "-5.0"),
    (1234567, "#,##0,", "en", "1,235"), (1234567, '0.0,," M"', "en", "1.2 M"), (5551234567, "(###) ###-####", "en", "(555) 123-4567"), (7, "000", "en", "007"), (1.5, "0.0??", "en", "1.5  "),
    (60, '#,##0.00 "€"', "es", "60,00 €"), (1234.5, "[$€-C0A] #,##0.00", "es", "€ 1.234,50"), (-1234, "$#,##0_);($#,##0)", "en", "($1,234)"), (1234, "$#,##0_);($#,##0)", "en", "$1,234 "), (0, '0;-0;"cero"', "en", "cero"), (0, "0;-0;;@", "en", ""),
    (150, '[>100]"alto";[<=100]"bajo"', "en", "alto"), (50, '[>100]"alto";[<=100]"bajo"', "en", "bajo"), (12345, "0.00E+00", "en", "1.23E+04"), (0.00012, "0.00E+00", "en", "1.20E-04"), (12345, "##0.0E+0", "en", "12.3E+3"),
    (1.5, "# ?/?", "en", "1 1/2"), (0.75, "# ?/?", "en", "3/4"), (3, "# ?/?", "en", "3"), (0.333, "# ??/??", "en", "1/3"), (0.3, "# ?/8", "en", "2/8"),
    (45000.75, "yyyy-mm-dd hh:mm", "en", "2023-03-15 18:00"), (45000.75, "d mmmm yyyy", "es", "15 marzo 2023"), (1.5, "[h]:mm:ss", "en", "36:00:00"), (0.5, "h:mm AM/PM", "en", "12:00 PM"), (-1, "yyyy", "en", "########"), ("ab", '"<"@">"', "en", "<ab>"),
]


@pytest.mark.parametrize("value,code,tag,want", FORMATS)
def test_formats(value, code, tag, want):
    assert format_value(value if isinstance(value, str) else float(value), code, tag).text == want


@pytest.mark.parametrize("value,code,cell,exact", [(198500, "0.00E+00", "1.99E+05", "1.98E+05"), (-9725, "0.00E+00", "-9.73E+03", "-9.72E+03"), (10.35, "0.0E+0", "1.0E+1", "1.0E+1"), (10.35, "0.00E+00", "1.04E+01", "1.03E+01"), (999500, "0.00E+00", "1.00E+06", "1.00E+06"), (12.25, "##0.0E+0", "12.3E+0", "12.2E+0"), (0.125, "0.00", "0.13", "0.12"), (2.675, "0.00", "2.68", "2.67"), (5e-324, "0.00E+00", None, "4.94E-324")])
def test_ties_of_cells_and_of_printf(value, code, cell, exact):
    assert cell is None or format_value(float(value), code).text == cell
    assert format_value(float(value), code, exact=True).text == exact


def test_colour():
    assert format_value(-3.0, "0.0;[Red]-0.0") == Formatted("-3.0", "#FF0000")


def _ms(*a):
    return int(dt.datetime(*a, tzinfo=dt.timezone.utc).timestamp() * 1000)


INPUTS = [
    ("1234,5", "es", "number", 1234.5), ("1.234.567,25", "es", "number", 1234567.25), (",5", "es", "number", 0.5), ("(300)", "en", "number", -300), ("-$5", "en", "number", -5), ("1.234,50 €", "es", "number", 1234.5), ("1,5E+3", "es", "number", 1500),
    ("1,5", "en", "string", "1,5"), ("1.23", "es", "string", "1.23"), ("12,34,5", "en", "string", "12,34,5"), ("$", "en", "string", "$"), ("15%", "es", "percent", 0.15), ("-7.1%", "en", "percent", -0.071), ("%", "en", "string", "%"),
    ("15/03/2024", "es", "date", _ms(2024, 3, 15)), ("3/15/2024 2:30 PM", "en", "date", _ms(2024, 3, 15, 14, 30)), ("1/2/95", "en", "date", _ms(1995, 1, 2)), ("15.3.2024", "es", "date", _ms(2024, 3, 15)), ("15/3", "es", "date", _ms(2026, 3, 15)),
    ("31/02/2024", "es", "string", "31/02/2024"), ("1/1/1850", "es", "string", "1/1/1850"), ("6:00 pm", "en", "time", 0.75), ("24:00", "es", "string", "24:00"), ("verdadero", "es", "boolean", True), ("TRUE", "es", "string", "TRUE"), ("=A1", "en", "formula", "A1"), (" ", "en", "empty", None),
]


@pytest.mark.parametrize("text,tag,kind,value", INPUTS)
def test_inputs(text, tag, kind, value):
    assert parse_input(text, tag, 2026) == (kind, value)


def test_tsv():
    rows = [["a", 'b"c', ""], ["x\ty", "new\nline", "z"]]
    assert parse_tsv(to_tsv(rows)) == rows and parse_tsv("a\tb\r\nc\td\r\n") == [["a", "b"], ["c", "d"]]
