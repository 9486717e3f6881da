import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from gridloom.formula.compiler import aggregated, with_formulas
from gridloom.formula.interpreter import Book, evaluate
from gridloom.formula.values import Err
from gridloom.plans.lookups import Table, with_lookups

ROWS = [(0, 1.5, -2.0, "norte", True), (1, 0.0, 3.0, "Sur 12", False), (2, None, 0.0, None, None), (3, 2.675, 1e9, " x  Y ", True), (4, -7.25, 100.0, "12.5", False), (5, 45000.75, 45100.0, "a-b-a-b", True), (6, 60.0, 61.0, "ñandú €", None), (7, 1e-12, 2.0, "50%", True), (8, 0.30000000000000004, -1.0, "TRUE", False)]
NAMES = ["id", "x", "y", "s", "b"]

ROW_FORMULAS = [
    "x+y", "x-y*2", "x/y", "x^2", "x&s", "x&y", "s&b", "-x%", "x=y", "x<>y", "x<s", 's="NORTE"', "b>x", "b=b", 's>="m"', "s+1", "s*1", "b+1", "x=\"\"", "ROUND(x,2)", "ROUND(x,-1)", "ROUNDUP(x,1)", "ROUNDDOWN(x,1)", "INT(x)", "TRUNC(x,1)", "ABS(x)", "SIGN(x)", "SQRT(x)", "POWER(x,y)", "MOD(x,y)", "CEILING(x,0.5)", "FLOOR(x,2)", "CEILING.MATH(x,2,1)",
    "FLOOR.MATH(x,2,1)", "LN(x)", "LOG(x)", "LOG(x,2)", "LOG10(x)", "EXP(x)", "EVEN(x)", "ODD(x)", "MROUND(x,0.5)", "QUOTIENT(x,y)", "ISEVEN(x)", "ISODD(y)", 'IF(x>1,"a","b")', "IF(x>1,x)*1", "IF(b,x,y)", "IFS(x>100,1,x>1,2)", 'SWITCH(x,0,"zero",1.5,"more","other")', "CHOOSE(x,1,2,3)", "IFERROR(x/y,-1)", "IFNA(x/y,-1)", "NOT(b)", "ISBLANK(x)",
    "ISNUMBER(x)", "ISTEXT(s)", "ISERROR(1/x)", "ISERR(x/y)", "ISNA(x)", "AND(x>0,y>0)", "OR(x>0,y>0)", "XOR(x>0,y>0)", 'CONCATENATE(s,"-",x)', "LEFT(s,2)", "LEFT(s)", "RIGHT(s,3)", "MID(s,2,2)", "MID(s,0,2)", "LEN(s)", "UPPER(s)", "LOWER(s)", "TRIM(s)", "PROPER(s)", 'SUBSTITUTE(s,"a","Z")', 'SUBSTITUTE(s,"a","Z",2)', "REPT(s,2)", "EXACT(s,s)", 'FIND("a",s)', 'SEARCH("?b",s)', "CHAR(y)",
    "CODE(s)", 'SEARCH("",s)', 'SEARCH("A",s,2)', 'SEARCH("~*",s)', 'SEARCH("1*5",s)', "SEARCH(s,s)", 'SEARCH("x",s,99)', 'CODE(RIGHT(s))', "CLEAN(s)", "VALUE(s)", 'TEXT(x,"0.00")', "YEAR(x)", "MONTH(x)", "DAY(x)", "WEEKDAY(x)", "WEEKDAY(x,2)", "EDATE(x,1)", "EOMONTH(y,-1)", "DAYS(y,x)", "TIME(x,y,0)", "HOUR(x)", "MINUTE(x)", "SECOND(x)", 'DATEDIF(x,y,"M")', "NETWORKDAYS(x,y)", "WORKDAY(x,3)", "WEEKNUM(x)", "WEEKNUM(y,2)", "WEEKNUM(x,15)", "WEEKNUM(y,21)", "WEEKNUM(x,9)", "WORKDAY(y,-3)", "WORKDAY(x,y)", "WORKDAY(45003,x)", 'DATEDIF(x,y,"D")', 'DATEDIF(x,45100,"Y")', 'DATEDIF(y,46000,"YM")', 'DATEDIF(x,46000,"MD")', "NETWORKDAYS(x,45200,{45001,45003,45050})", "DATE(2024,y,31)", "PMT(x,12,1000)", "FV(0.01,y,-5)", "PV(0.01,y,-5)", "NPER(0.01,y,-500)", "SUM(x,y)", "MAX(x,y,1)", "PI()*x", "NA()", "nope+1", "TRUE()",
]


def _interpreted(formula, row):
    """The same formula, with names for the cells of its row."""
    cells = {(1, i + 1): float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for i, v in enumerate(row)}
    names = {(None, n.upper()): f"${'ABCDE'[i]}$1" for i, n in enumerate(NAMES)}
    return evaluate(Book({"s": cells}, names), "s", 1, 9, formula)


def _same(got, error, want):
    if isinstance(want, Err):
        return error == want.code and got is None
    if error is not None:
        return False
    if isinstance(want, float):
        return isinstance(got, float) and math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)
    return got == want


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "id int, x double, y double, s string, b boolean")


def test_row_formulas_are_what_the_interpreter_makes(table):
    lots = [ROW_FORMULAS[i : i + 40] for i in range(0, len(ROW_FORMULAS), 40)]
    wrong = []
    for lot in lots:
        got = with_formulas(table, {f"f{i}": f for i, f in enumerate(lot)}).orderBy("id").collect()
        for row, out in zip(ROWS, got, strict=True):
            for i, f in enumerate(lot):
                want = _interpreted(f, row)
                value = out[f"f{i}"]
                value = value[{"number": "n", "text": "s", "bool": "b"}[value.k]] if isinstance(value, Row) else value
                if not _same(value, out[f"f{i}__err"], want):
                    wrong.append((f, row, out[f"f{i}"], out[f"f{i}__err"], want))
    assert not wrong, wrong[:20]


EXTREMES = [0.0, 0.5, -0.5, 1.5, 2.5, 1e25, -1e25, 1.5e-17, -2.5e-17, 9007199254740993.0, 123456789012345.6, 0.1 + 0.2, 1.005, 2.675, 1e15 - 0.5, 4.35, 1e-300, 1e300, 0.285, -1.15, 33.333333333333336, 1e22]
EXTREME_FORMULAS = [f"{f}(x,{d})" for f in ("ROUND", "ROUNDUP", "ROUNDDOWN") for d in (0, 1, 2, -1, 3, 17, -20, "y")] + ["INT(x)", "TRUNC(x)", "EVEN(x)", "ODD(x)", "CEILING(x,0.1)", "FLOOR(x,0.1)", "CEILING.MATH(x,0.3)", "FLOOR.MATH(x,3)", "MROUND(x,0.05)", "s+1", "IF(s,1,2)", "s&1"]
TEXTS = ["\t12", "12\n", "\u00a012\u00a0", "1 2", " TRUE", "TRUE", "false", " 5 % ", "%", "1e3", ".5", "5.", "+3", "inf", "NaN", "0x10", "1e400", "", "\u30003"]


def test_extremes_are_what_the_interpreter_makes(spark):
    rng = random.Random(11)
    numbers = EXTREMES + [rng.choice([-1, 1]) * round(rng.uniform(0, 10 ** rng.randint(-3, 12)), rng.randint(0, 4)) + 0.0 for _ in range(300)]
    rows = [(i, x, float(rng.randint(-3, 6)), TEXTS[i % len(TEXTS)], None) for i, x in enumerate(numbers)]
    got = with_formulas(spark.createDataFrame(rows, "id int, x double, y double, s string, b boolean"), {f"f{i}": f for i, f in enumerate(EXTREME_FORMULAS)}).orderBy("id").collect()
    wrong = []
    for row, out in zip(rows, got, strict=True):
        for i, f in enumerate(EXTREME_FORMULAS):
            if not _same(out[f"f{i}"], out[f"f{i}__err"], want := _interpreted(f, row)):
                wrong.append((f, row, out[f"f{i}"], out[f"f{i}__err"], want))
    assert not wrong, (len(wrong), wrong[:20])


def test_working_days_from_every_day_of_a_week(spark):
    rows = [(i, float(d), float(n)) for i, (d, n) in enumerate((d, n) for d in range(45000, 45009) for n in (*range(-12, 13), 0.9, -1.5, 40))]
    got = with_formulas(spark.createDataFrame(rows, "id int, x double, y double"), {"w": "WORKDAY(x,y)", "n": "NETWORKDAYS(x,x+y)", "k": "WEEKNUM(x+y*9,13)"}).collect()
    for r in got:
        for name, f in (("w", "WORKDAY(x,y)"), ("n", "NETWORKDAYS(x,x+y)"), ("k", "WEEKNUM(x+y*9,13)")):
            assert _same(r[name], r[f"{name}__err"], _interpreted(f, (r.id, r.x, r.y))), (f, r)


AGG_FORMULAS = [
    "SUM(x)", "SUM(x,1)", "PRODUCT(y)", "AVERAGE(x)", "MIN(x)", "MAX(x,y)", "MEDIAN(x)", "COUNT(x)", "COUNT(s)", "COUNTA(s)", "COUNTBLANK(x)", "SUMSQ(y)", "SUMPRODUCT(x,y)", "STDEV(x)", "VAR.P(y)", "LARGE(x,2)", "SMALL(x,3)", "LARGE(x,99)", "AND(b)", "OR(b)", "XOR(b)", "AND(s)",
    'SUMIF(x,">1")', 'SUMIF(s,"norte",x)', 'SUMIF(s,"*a*",y)', 'COUNTIF(s,"")', 'COUNTIF(s,"<>")', 'COUNTIF(s,"<>norte")', 'COUNTIF(x,"<=1.5")', "COUNTIF(x,1.5)", 'COUNTIF(s,12.5)', "COUNTIF(b,TRUE)", 'AVERAGEIF(s,"zzz",x)', 'SUMIFS(x,y,">0",s,"?*")', 'MAXIFS(x,b,TRUE)', 'MINIFS(y,x,">100000")', 'COUNTIFS(x,">0",y,">0")', "SUM(x)/COUNT(x)-AVERAGE(x)", 'IF(SUM(x)>10,"big","small")', "CONCAT(s)", 'TEXTJOIN("|",TRUE,s)', 'TEXTJOIN("|",FALSE,s)', "SUM(1/x)",
]


def test_aggregates_are_what_the_interpreter_makes(table):
    cells = {(i + 1, c + 1): float(v) if isinstance(v, int | float) and not isinstance(v, bool) else v for i, row in enumerate(ROWS) for c, v in enumerate(row)}
    names = {(None, n.upper()): f"${'ABCDE'[i]}$1:${'ABCDE'[i]}${len(ROWS)}" for i, n in enumerate(NAMES)}
    book, wrong = Book({"s": cells}, names), []
    out = aggregated(table.repartition(3), {f"f{i}": f for i, f in enumerate(AGG_FORMULAS)}, order=F.col("id")).collect()[0]
    for i, f in enumerate(AGG_FORMULAS):
        want = evaluate(book, "s", 20, 9, f)
        if not _same(out[f"f{i}"], out[f"f{i}__err"], want):
            wrong.append((f, out[f"f{i}"], out[f"f{i}__err"], want))
    assert not wrong, wrong


def test_order_statistics_by_ranges_are_those_of_one_task(spark, table):
    names = {"m": "MEDIAN(x)", "e": "MEDIAN(y)+1", "l": "LARGE(x,2)", "s": "SMALL(y,1.5)", "far": "LARGE(x,99)", "err": "SMALL(1/x,1)", "txt": "MEDIAN(s)"}
    one, many = (aggregated(table, names, order=F.col("id"), in_task=n).first().asDict() for n in (10**6, -1))
    assert one == many and one["far__err"] == "#NUM!" and one["err__err"] == "#DIV/0!"


LOOKUPS = {
    "VLOOKUP(x,t,2,FALSE)": "VLOOKUP({x},{t},2,FALSE)", "VLOOKUP(x,t,3)": "VLOOKUP({x},{t},3)", "VLOOKUP(s,u,2,FALSE)": "VLOOKUP({s},{u},2,FALSE)", "MATCH(x,t.k,0)": "MATCH({x},{tk},0)", "MATCH(x,t.k)": "MATCH({x},{tk})", "MATCH(x,f.k,-1)": "MATCH({x},{fk},-1)", "MATCH(s,u.k,0)": "MATCH({s},{uk},0)",
    "XLOOKUP(x,t.k,t.n)": "XLOOKUP({x},{tk},{tn})", 'XLOOKUP(x,t.k,t.v,"no")': 'XLOOKUP({x},{tk},{tv},"no")', "XLOOKUP(x,t.k,t.n,,1)": "XLOOKUP({x},{tk},{tn},,1)", "XLOOKUP(x,t.k,t.n,0,-1)": "XLOOKUP({x},{tk},{tn},0,-1)", "XLOOKUP(x,t.k,t.n,,0,-1)": "XLOOKUP({x},{tk},{tn},,0,-1)", 'XLOOKUP(s,u.k,u.n,"-",2)': 'XLOOKUP({s},{uk},{un},"-",2)', "XLOOKUP(s,u.k,u.n,,2,-1)": "XLOOKUP({s},{uk},{un},,2,-1)", "XLOOKUP(s,u.k,u.n)": "XLOOKUP({s},{uk},{un})",
    "INDEX(t.v,x)": "INDEX({tv},{x})", "VLOOKUP(VLOOKUP(x,t,2,FALSE),t,3)&s": "VLOOKUP(VLOOKUP({x},{t},2,FALSE),{t},3)&{s}", "IFERROR(VLOOKUP(1/x,t,2,FALSE),-1)": "IFERROR(VLOOKUP(1/{x},{t},2,FALSE),-1)", "VLOOKUP(x,t,4,FALSE)": "VLOOKUP({x},{t},4,FALSE)",
}


@pytest.mark.parametrize("seed", [1, 2])
def test_lookups_are_what_the_interpreter_makes(spark, seed):
    rng = random.Random(seed)
    keys = [float(rng.randrange(8)) for _ in range(9)]
    t = [(i, k, float(rng.randrange(8)), f"v{i}") for i, k in enumerate(sorted(keys) if seed == 1 else keys)]
    f = [(i, k) for i, k in enumerate(sorted(keys, reverse=True) if seed == 1 else keys)]
    u = [(i, k, float(i)) for i, k in enumerate(["plum", "Pear", "fig", "pear", "f*g", "date"])]
    tables = {"t": Table(spark.createDataFrame(t, "o int, k double, n double, v string"), ("k", "n", "v"), "o"), "f": Table(spark.createDataFrame(f, "o int, k double"), ("k",), "o"), "u": Table(spark.createDataFrame(u, "o int, k string, n double"), ("k", "n"), "o")}
    rows = [(i, x / 2, s) for i, (x, s) in enumerate(zip(range(2, 20), ["pear", "PEAR", "p*", "?ig", "f~*g", "kiwi", "*", "dat?", "d", "fig"] * 2, strict=False))]
    out = with_lookups(spark.createDataFrame(rows, "id int, x double, s string"), {f"f{i}": x for i, x in enumerate(LOOKUPS)}, tables).orderBy("id").collect()
    cells = {(r + 1, c): v for r, row in enumerate(t) for c, v in enumerate(row[1:], 2)} | {(r + 1, 6): row[1] for r, row in enumerate(f)} | {(r + 1, c): v for r, row in enumerate(u) for c, v in enumerate(row[1:], 8)}
    at = {"t": "$B$1:$D$9", "tk": "$B$1:$B$9", "tn": "$C$1:$C$9", "tv": "$D$1:$D$9", "fk": "$F$1:$F$9", "u": "$H$1:$I$6", "uk": "$H$1:$H$6", "un": "$I$1:$I$6"}
    wrong = []
    for (i, x, s), got in zip(rows, out, strict=True):
        for k, (formula, plain) in enumerate(LOOKUPS.items()):
            book = Book({"s": cells | {(30, 1): x, (30, 2): s}}, {})
            want = evaluate(book, "s", 30, 20, plain.format(x="$A$30", s="$B$30", **at))
            value = got[f"f{k}"]
            value = value[{"number": "n", "text": "s", "bool": "b"}[value.k]] if isinstance(value, Row) else value
            if not _same(value, got[f"f{k}__err"], want):
                wrong.append((formula, x, s, value, got[f"f{k}__err"], want))
    assert not wrong, (len(wrong), wrong[:12], keys)
