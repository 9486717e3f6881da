"""Typed text to values, as a cell takes what a user types, and tab-separated text."""

from __future__ import annotations

import datetime as dt
import re

import pandas as pd
from pyspark.sql import functions as F

_TIME = re.compile(r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\s*([aApP])\.?[mM]\.?)?")


def _number(text: str, es: bool) -> float | None:
    point, group = (",", ".") if es else (".", ",")
    t = text.strip()
    negative = t.startswith("(") and t.endswith(")") and len(t) > 2
    if negative:
        t = t[1:-1].strip()
    m = re.fullmatch(r"([+-]?)\s*(?:[$€£¥]\s*)?([+-]?)(.+?)(?:\s*[$€£¥])?", t)
    if not m or m[1] and m[2] or negative and (m[1] or m[2]):
        return None
    p, g = re.escape(point), re.escape(group)
    if not re.fullmatch(rf"(?:\d{{1,3}}(?:{g}\d{{3}})+|\d+)?(?:{p}\d*)?(?:[eE][+-]?\d+)?", m[3]) or not re.match(rf"{p}?\d", m[3]):
        return None
    x = float(m[3].replace(group, "").replace(point, "."))
    return -x if negative or "-" in (m[1], m[2]) else x


def _seconds(text: str) -> int | None:
    m = _TIME.fullmatch(text.strip())
    if not m:
        return None
    h, mi, s = int(m[1]), int(m[2]), int(m[3] or 0)
    if m[4]:
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if m[4] in "pP" else 0)
    return h * 3600 + mi * 60 + s if h < 24 and mi < 60 and s < 60 else None


def _date_ms(text: str, es: bool, year: int) -> int | None:
    m = re.fullmatch(r"(\S+?)(?:[T\s]+(\d.*))?", text.strip())
    if not m:
        return None
    seconds = _seconds(m[2]) if m[2] else 0
    iso = re.fullmatch(r"(\d{4})-(\d{1,2})-(\d{1,2})", m[1])
    own = re.fullmatch(r"(\d{1,2})([/.-])(\d{1,2})(?:\2(\d{4}|\d{2}))?", m[1])
    if seconds is None or not (iso or own):
        return None
    if iso:
        y, mo, d = map(int, iso.groups())
    else:
        if own[4] is None and own[2] != "/":
            return None
        a, b = int(own[1]), int(own[3])
        d, mo = (a, b) if es else (b, a)
        y = year if own[4] is None else int(own[4])
        if own[4] and len(own[4]) == 2:
            y += 2000 if y < 30 else 1900
    try:
        day = dt.date(y, mo, d)
    except ValueError:
        return None
    return ((day - dt.date(1970, 1, 1)).days * 86_400 + seconds) * 1000 if y >= 1900 else None


def parse_input(text: str, tag: str = "en", year: int | None = None) -> tuple[str, object]:
    """(type, value): empty, formula, boolean, number, percent, time (a fraction of a day), date (epoch
    milliseconds) or string. year is that of dates typed without one."""
    es, t = tag.lower().startswith("es"), text.strip()
    if not t:
        return "empty", None
    if t.startswith("=") and len(t) > 1:
        return "formula", t[1:]
    if t.upper() in (("VERDADERO", "FALSO") if es else ("TRUE", "FALSE")):
        return "boolean", t.upper() in ("VERDADERO", "TRUE")
    if (x := _number(t, es)) is not None:
        return "number", x
    if t.endswith("%") and (x := _number(t[:-1], es)) is not None:
        return "percent", round(x / 100, 15)
    if (s := _seconds(t)) is not None:
        return "time", s / 86_400
    if (ms := _date_ms(t, es, year or dt.date.today().year)) is not None:
        return "date", ms
    return "string", text


def to_tsv(rows: list[list[str]]) -> str:
    quote = lambda x: '"' + x.replace('"', '""') + '"' if re.search(r'[\t\n\r"]', x) else x
    return "\n".join("\t".join(map(quote, r)) for r in rows)


def parse_tsv(text: str) -> list[list[str]]:
    """Rows of cells; a cell that starts with a quote runs to its closing one."""
    text = text.replace("\r\n", "\n").replace("\r", "\n").removesuffix("\n")
    rows, at = [[]], 0
    if not text:
        return []
    while True:
        m = re.compile(r'"((?:[^"]|"")*)"(?=[\t\n]|$(?!\n))|([^\t\n]*)').match(text, at)
        rows[-1].append(m[1].replace('""', '"') if m[1] is not None else m[2])
        at = m.end()
        if at >= len(text):
            return rows
        if text[at] == "\n":
            rows.append([])
        at += 1


def infer_column(value, tag: str = "en", year: int | None = None):
    """A string column as struct<type, number, text>: numbers, fractions and epoch milliseconds as number."""

    @F.pandas_udf("type string, number double, text string")
    def typed(v: pd.Series) -> pd.DataFrame:
        found = [parse_input("" if x is None else x, tag, year) for x in v]
        return pd.DataFrame({"type": [k for k, _ in found], "number": [float(x) if isinstance(x, int | float) else None for _, x in found], "text": [x if isinstance(x, str) else None for _, x in found]})

    return typed(value)
