"""Formulas as Spark columns.

A name stands for a column of the table: its value in the same row, or the whole column where a function
reads a range. Every node becomes a value and an error column, so nothing is ever raised on executors:
a null value without an error is an empty cell. Kinds (number, text, bool) are known from the schema, so
coercions are chosen here and the plan stays in generated code. Functions without such a form are
evaluated by the interpreter in an Arrow function, on the compiled values of their arguments.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.formula import parser as p
from gridloom.formula.interpreter import CP1252, FUNCTIONS, Book, Criterion, evaluate
from gridloom.formula.parser import Unsupported
from gridloom.formula.values import CellError, Err, to_text

N, S, B, EMPTY = "number", "text", "bool", "empty"
_TYPE = {N: "double", S: "string", B: "boolean", EMPTY: "double"}


@dataclass
class V:
    """A compiled expression. ranged: from a range, of which functions read only some kinds."""

    kind: str
    value: Column
    error: Column | None = None
    ranged: bool = False


def no_value(kind: str) -> Column:
    return F.lit(None).cast(_TYPE[kind])


def first_error(*vs: V | Column | None) -> Column | None:
    found = [e for v in vs if (e := v.error if isinstance(v, V) else v) is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def failing(code: str) -> V:
    return V(EMPTY, no_value(EMPTY), F.lit(code))


def guarded(kind: str, value: Column, *errors) -> V:
    """value unless an error: (condition, code) pairs and error columns, the first that holds."""
    found = [F.when(e[0], F.lit(e[1])) if isinstance(e, tuple) else e for e in errors if e is not None]
    error = first_error(*found)
    return V(kind, value if error is None else F.when(error.isNull(), value), error)


class Bindings:
    """Expressions that a formula uses several times, as columns of projections beneath it. A formula's first one
    goes into the first projection, the next one, which may use it, into the second, and so on."""

    def __init__(self) -> None:
        self.layers: list[list[Column]] = []
        self.own: list[Column] = []
        self.count = 0

    def add(self, value: Column) -> Column:
        name = f"__bound{self.count}"
        self.count += 1
        self.own.append(value.alias(name))
        return F.col(name)

    def keep(self) -> None:
        """Ends a formula."""
        self.layers += [[] for _ in range(len(self.own) - len(self.layers))]
        for layer, value in zip(self.layers, self.own, strict=False):
            layer.append(value)
        self.own = []

    def over(self, df: DataFrame) -> DataFrame:
        return reduce(lambda d, layer: d.select("*", *layer), self.layers, df)


_bindings: Bindings | None = None


def once(value: Column) -> Column:
    """value, to be used several times; where a projection's formulas are compiled it is evaluated once a row."""
    return value if _bindings is None else _bindings.add(value)


def finite(value: Column, *errors) -> V:
    """A number, or #NUM! where it is infinite or none."""
    value = once(value)
    return guarded(N, value, *errors, (~(value * 0.0).eqNullSafe(F.lit(0.0)), "#NUM!"))


def number(v: V) -> V:
    if v.kind == N:
        return V(N, F.coalesce(v.value, F.lit(0.0)), v.error)
    if v.kind == B:
        return V(N, F.coalesce(v.value.cast("double"), F.lit(0.0)), v.error)
    if v.kind == EMPTY:
        return V(N, F.lit(0.0), v.error)
    parsed = text_number(v.value)
    return guarded(N, F.when(v.value.isNull(), F.lit(0.0)).otherwise(parsed), v.error, (v.value.isNotNull() & parsed.isNull(), "#VALUE!"))


#: White space around numbers in texts.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def text_number(text: Column) -> Column:
    t = F.btrim(text, F.lit(WHITE))
    percent = t.endswith("%")
    t = F.btrim(F.regexp_replace(t, "%$", ""), F.lit(WHITE))
    x = F.when(t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), t.try_cast("double"))
    x = F.when(F.abs(x) < float("inf"), x)
    return F.when(percent, x / 100).otherwise(x)


def round_sig(x: Column) -> Column:
    return F.format_string("%.14e", x).try_cast("double")


def number_text(x: Column) -> Column:
    """What a cell shows of a number: 15 digits, scientific only far from 1."""
    s = round_sig(x)
    plain = F.regexp_replace(F.regexp_replace(s.try_cast("decimal(38,22)").cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    far = F.regexp_replace(F.format_string("%.14E", x), r"\.?0+E", "E")
    return F.when(s == 0, F.lit("0")).when((F.abs(s) >= 1e-9) & (F.abs(s) < 1e15), plain).otherwise(far)


def text(v: V) -> V:
    if v.kind == S:
        return V(S, F.coalesce(v.value, F.lit("")), v.error)
    if v.kind == EMPTY:
        return V(S, F.lit(""), v.error)
    shown = number_text(v.value) if v.kind == N else F.upper(v.value.cast("string"))
    return V(S, F.when(v.value.isNull(), F.lit("")).otherwise(shown), v.error)


def boolean(v: V) -> V:
    if v.kind == B:
        return V(B, F.coalesce(v.value, F.lit(False)), v.error)
    if v.kind == EMPTY:
        return V(B, F.lit(False), v.error)
    if v.kind == N:
        return V(B, F.coalesce(v.value != 0, F.lit(False)), v.error)
    low = F.lower(v.value)
    return guarded(B, F.coalesce(low == "true", F.lit(False)), v.error, (v.value.isNotNull() & ~low.isin("true", "false"), "#VALUE!"))


_RANK = {N: 0, S: 1, B: 2}


def compared(op: str, a: V, b: V) -> V:
    """Numbers before texts before booleans; an empty side is 0, "" or FALSE as the other asks."""
    kind = b.kind if a.kind == EMPTY else a.kind
    other = kind if b.kind == EMPTY else b.kind
    error = first_error(a, b)
    if kind == EMPTY:
        return guarded(B, F.lit(op in ("=", "<=", ">=")), error)
    if kind != other:
        # a null of either kind takes the other's side
        base = {"=": False, "<>": True, "<": _RANK[kind] < _RANK[other], "<=": _RANK[kind] < _RANK[other], ">": _RANK[kind] > _RANK[other], ">=": _RANK[kind] > _RANK[other]}[op]
        left, right = _as(a, other), _as(b, kind)
        whole = F.when(a.value.isNull(), _test(op, left, _filled(b, other))).when(b.value.isNull(), _test(op, _filled(a, kind), right)).otherwise(F.lit(base))
        return guarded(B, whole, error)
    return guarded(B, _test(op, _filled(a, kind), _filled(b, kind)), error)


_ZERO = {N: 0.0, S: "", B: False}


def _filled(v: V, kind: str) -> Column:
    x = F.lit(_ZERO[kind]) if v.kind == EMPTY else F.coalesce(v.value, F.lit(_ZERO[kind]))
    return F.lower(x) if kind == S else x


def _as(v: V, kind: str) -> Column:
    return F.lit(_ZERO[kind])


def _test(op: str, x: Column, y: Column) -> Column:
    return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


def same_kind(vs: Iterable[V]) -> str:
    kinds = {v.kind for v in vs if v.kind != EMPTY}
    if len(kinds) > 1:
        raise Unsupported("a result of several kinds")
    return kinds.pop() if kinds else EMPTY


def chosen(cases: list[tuple[Column, V]], default: V, error: Column | None = None) -> V:
    """The first case that holds; conditions must not be null."""
    kind = same_kind([v for _, v in cases] + [default])
    pick = lambda get: reduce(lambda rest, c: F.when(c[0], get(c[1])).otherwise(rest), reversed(cases), get(default))
    value = pick(lambda v: v.value.cast(_TYPE[kind]) if v.kind != EMPTY else no_value(kind))
    errors = [v.error for _, v in cases] + [default.error]
    inner = None if all(e is None for e in errors) else pick(lambda v: F.lit(None).cast("string") if v.error is None else v.error)
    return guarded(kind, value, error, inner)


class Compiler:
    """Compiles formulas over the columns of one table. order: a column that gives rows their order."""

    def __init__(self, df: DataFrame, order: Column | None = None, names: dict[str, V] | None = None):
        self.names = dict(names or {})
        for f in df.schema.fields:
            if (v := bound(f, F.col(f"`{f.name}`"))) is not None:
                self.names.setdefault(f.name.upper(), v)
        self.order = order

    def compile(self, formula: str | p.Expr) -> V:
        return self.node(p.parse(formula) if isinstance(formula, str) else formula)

    def node(self, e: p.Expr) -> V:
        if isinstance(e, p.Number):
            return V(N, F.lit(e.value))
        if isinstance(e, p.Text):
            return V(S, F.lit(e.value))
        if isinstance(e, p.Bool):
            return V(B, F.lit(e.value))
        if isinstance(e, p.Error):
            return failing(e.code)
        if isinstance(e, p.Missing):
            return V(EMPTY, no_value(EMPTY))
        if isinstance(e, p.Paren):
            return self.node(e.of)
        if isinstance(e, p.Name):
            return self.names.get(e.name.upper()) or failing("#NAME?")
        if isinstance(e, p.Unary):
            v = self.node(e.of)
            if e.op == "+":
                return v
            v = number(v)
            return V(N, -v.value if e.op == "-" else v.value / 100, v.error)
        if isinstance(e, p.Binary):
            return self.binary(e.op, self.node(e.left), self.node(e.right))
        if isinstance(e, p.Call):
            return self.call(e)
        raise Unsupported(f"{type(e).__name__} in a column formula")

    def binary(self, op: str, a: V, b: V) -> V:
        if op == "&":
            a, b = text(a), text(b)
            return guarded(S, F.concat(a.value, b.value), first_error(a, b))
        if op not in "+-*/^":
            return compared(op, a, b)
        a, b = number(a), number(b)
        error, x, y = first_error(a, b), a.value, b.value
        if op == "/":
            return finite(F.try_divide(x, y), error, (y == 0, "#DIV/0!"))
        if op == "^":
            return finite(F.pow(x, y), error, ((x == 0) & (y < 0), "#DIV/0!"))
        return finite({"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y}[op](), error)

    def call(self, e: p.Call) -> V:
        least, most, _ = FUNCTIONS.get(e.name, (0, -1, None))
        if not least <= len(e.args) <= most:
            raise Unsupported(f"{e.name} with {len(e.args)} arguments")
        if e.name in AGGREGATES:
            return AGGREGATES[e.name](self, e.name, e.args)
        if e.name in SCALARS:
            return SCALARS[e.name](self, e.name, e.args)
        return self.interpreted(e)

    def interpreted(self, e: p.Call) -> V:
        """A function evaluated in Python, in Arrow batches, from its arguments' columns."""
        if e.name not in RESULT:
            raise Unsupported(f"{e.name} in a column formula")
        args, kind = [self.node(a) for a in e.args], RESULT[e.name]
        name, kinds = e.name, [v.kind for v in args]

        @F.pandas_udf(f"v {_TYPE[kind]}, e string")
        def run(*columns: pd.Series) -> pd.DataFrame:
            out, book = [], Book({"s": {}})
            for row in zip(*columns, strict=True):
                parts = tuple(_constant(k, None if x is None or x != x else x) for k, x in zip(kinds, row, strict=True))
                out.append(evaluate(book, "s", 1, 1, p.Call(name, parts)))
            return pd.DataFrame({"v": [None if isinstance(v, Err) else v for v in out], "e": [v.code if isinstance(v, Err) else None for v in out]})

        got = run(*[v.value for v in args])
        return guarded(kind, got["v"], first_error(*args), got["e"])

    def tagged(self, e: p.Expr) -> Column:
        """A whole formula evaluated in Python for each row, as struct<v: struct<k, n, s, b>, e>."""
        used = sorted({n for n in _names(e) if n in self.names})
        kinds = [self.names[n].kind for n in used]
        failed = [i for i, n in enumerate(used) if self.names[n].error is not None]
        evaluate(Book({"s": {}}, {(None, n): "0" for n in used}), "s", 1, 1, e)  # Unsupported shows here

        @F.pandas_udf("v struct<k: string, n: double, s: string, b: boolean>, e string")
        def run(*columns: pd.Series) -> pd.DataFrame:
            out, names = [], {(None, n): f"$A${i + 1}" for i, n in enumerate(used)}
            for row in zip(*columns, strict=True):  # the names' values, then the errors of some
                cells = {(i + 1, 1): _cell(k, x) for i, (k, x) in enumerate(zip(kinds, row[: len(kinds)], strict=True))}
                cells |= {(i + 1, 1): Err(code) for i, code in zip(failed, row[len(kinds) :], strict=True) if isinstance(code, str)}
                out.append(evaluate(Book({"s": cells}, names), "s", 1, 2, e))
            tags = [None if isinstance(v, Err) else {"k": B if isinstance(v, bool) else N if isinstance(v, float) else S, "n": v if isinstance(v, float) else None, "s": v if isinstance(v, str) else None, "b": v if isinstance(v, bool) else None} for v in out]
            return pd.DataFrame({"v": tags, "e": [v.code if isinstance(v, Err) else None for v in out]})

        return run(*[self.names[n].value for n in used], *[self.names[used[i]].error for i in failed]) if used else run(F.lit(0.0))

    def numbers(self, e: p.Expr) -> V:
        """An argument as SUM reads it, null where it does not count."""
        v = self.node(e)
        if v.ranged or not isinstance(e, p.Number | p.Text | p.Bool):
            return V(N, v.value if v.kind == N else no_value(N), v.error)
        return number(v)


def _constant(kind: str, x) -> p.Expr:
    if x is None:
        return p.Missing()
    return p.Number(float(x)) if kind in (N, EMPTY) else p.Text(x) if kind == S else p.Bool(bool(x))


def _cell(kind: str, x):
    return None if x is None or x != x else bool(x) if kind == B else x if kind == S else float(x)


def _names(e: p.Expr) -> set[str]:
    return ({e.name.upper()} if isinstance(e, p.Name) else set()).union(*map(_names, p.children(e)))


def bound(field: T.StructField, column: Column) -> V | None:
    """A table's column: dates become serials, other kinds than these have no meaning in a formula."""
    t = field.dataType
    if isinstance(t, T.NumericType):
        return V(N, column.cast("double"), ranged=True)
    if isinstance(t, T.StringType):
        return V(S, column, ranged=True)
    if isinstance(t, T.BooleanType):
        return V(B, column, ranged=True)
    if isinstance(t, T.DateType | T.TimestampNTZType | T.TimestampType):
        return V(N, to_serial(column), ranged=True)
    return None


def to_serial(column: Column) -> Column:
    ts = column.cast("timestamp_ntz")
    days = F.datediff(ts.cast("date"), F.lit("1899-12-30").cast("date"))
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    return F.when(days >= 61, days).otherwise(days - 1).cast("double") + seconds / 86_400


def from_serial(x: Column) -> Column:
    """The date of a serial; serial 60 never was, and is one short here."""
    n = _int(F.floor(x), 4e6)
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(n >= 60, n).otherwise(n + 1))


#: Kinds of the functions that only the interpreter has.
RESULT = {"PROPER": S, "TEXT": S, "WORKDAY": N, "CODE": N, "DATEDIF": N, "WEEKNUM": N, "SEARCH": N, "GCD": N, "LCM": N}
SCALARS: dict[str, Callable] = {}
AGGREGATES: dict[str, Callable] = {}


def scalar(names: str):
    def add(f):
        for n in names.split():
            SCALARS[n] = f
        return f

    return add


def _numbers(c: Compiler, args, *defaults: float) -> tuple[list[Column], Column | None]:
    vs = [c.node(a) for a in args]
    vs = [V(N, F.lit(defaults[i]), v.error) if v.kind == EMPTY and i < len(defaults) and v.error is None else number(v) for i, v in enumerate(vs)]
    vs += [V(N, F.lit(d)) for d in defaults[len(vs) :]]
    return [v.value for v in vs], first_error(*vs)


def _whole(x: Column, how) -> Column:
    """floor or ceil of a double as a double: beyond 2^53 all are whole, and a long could not hold them."""
    return F.when(F.abs(x) < 2.0**53, how(x).cast("double")).otherwise(x)


def _trunc(x: Column) -> Column:
    return F.signum(x) * _whole(F.abs(x), F.floor)


#: Twice the most by which rounding to 15 digits, and that of a product once more, can change a number.
NEAR = 2.5e-14


def _steady(x: Column, halves: bool = False) -> Column:
    """x as 15 digits show it wherever that could change its whole part (halves: what it rounds to). Only
    numbers next to a whole one (a half) take the slow way through digits."""
    x = once(x)
    u = x * 2 if halves else x
    r = once(F.rint(u))
    return F.when((u == r) & (F.abs(u) < 1e15), x).when(F.abs(u - r) <= F.abs(u) * NEAR, round_sig(x)).otherwise(x)


def _int(x: Column, most: float = 1e8) -> Column:
    """A whole number that cannot overflow; nothing here tells apart what lies beyond."""
    return F.greatest(F.least(x, F.lit(most)), F.lit(-most)).cast("int")


@scalar("ROUND ROUNDUP ROUNDDOWN")
def _(c, name, args):
    (x, d), error = _numbers(c, args)
    literal = args[1]
    sign = isinstance(literal, p.Unary) and literal.op == "-"
    literal = literal.of if sign else literal
    if isinstance(literal, p.Number):
        k = max(-400, min(400, int(literal.value) * (-1 if sign else 1)))
        scale, back = F.lit(float(f"1e{k}")), F.lit(float(f"1e{-k}"))
    else:
        k, scale, back = None, F.pow(F.lit(10.0), _trunc(d)), None
    y = _steady(F.abs(x) * scale, halves=name == "ROUND")
    y = once(y + 0.5 if name == "ROUND" else y)
    y = once(_whole(y, F.ceil if name == "ROUNDUP" else F.floor))
    if k is None or abs(k) > 15:
        return finite(F.signum(x) * round_sig(F.try_divide(y, scale)), error, (scale == 0, "#NUM!"))
    # a whole number of up to 15 digits by an exact power of ten is the nearest double there is
    moved = y * back if k < 0 else y / scale
    return finite(F.signum(x) * F.when(y < 1e15, moved).otherwise(round_sig(moved)), error)


def _one(name: str, f, *bad):
    @scalar(name)
    def _(c, _n, args):
        (x,), error = _numbers(c, args)
        return finite(f(x), error, *[(test(x), code) for test, code in bad])


_one("INT", lambda x: _whole(x, F.floor))
_one("ABS", F.abs)
_one("SIGN", F.signum)
_one("SQRT", F.sqrt, (lambda x: x < 0, "#NUM!"))
_one("LN", F.ln, (lambda x: x <= 0, "#NUM!"))
_one("LOG10", F.log10, (lambda x: x <= 0, "#NUM!"))
_one("EXP", F.exp)
_one("EVEN", lambda x: F.signum(x) * _whole(F.abs(x) / 2, F.ceil) * 2.0)
_one("ODD", lambda x: F.when(F.abs(x) <= 1, F.when(x < 0, F.lit(-1.0)).otherwise(F.lit(1.0))).otherwise(F.signum(x) * (_whole((F.abs(x) - 1) / 2, F.ceil) * 2.0 + 1)))


@scalar("ISEVEN ISODD")
def _(c, name, args):
    (x,), error = _numbers(c, args)
    return guarded(B, F.pmod(_trunc(x), F.lit(2.0)) == (0.0 if name == "ISEVEN" else 1.0), error)


@scalar("TRUNC")
def _(c, _n, args):
    (x, d), error = _numbers(c, args, 0.0, 0.0)
    scale = F.pow(F.lit(10.0), _trunc(d))
    return finite(_trunc(x * scale) / scale, error)


@scalar("POWER")
def _(c, _n, args):
    return c.binary("^", *[c.node(a) for a in args])


@scalar("MOD")
def _(c, _n, args):
    (x, d), error = _numbers(c, args)
    return finite(x - d * F.floor(F.try_divide(x, d)), error, (d == 0, "#DIV/0!"))


@scalar("PI")
def _(c, _n, args):
    return V(N, F.pi())


@scalar("CEILING FLOOR")
def _(c, name, args):
    (x, s), error = _numbers(c, args)
    q = _whole(once(_steady(F.try_divide(x, s))), F.ceil if name == "CEILING" else F.floor)
    return finite(F.when((s == 0) | (x == 0), F.lit(0.0)).otherwise(q * s), error, ((x > 0) & (s < 0), "#NUM!"))


@scalar("CEILING.MATH FLOOR.MATH")
def _(c, name, args):
    (x, s, mode), error = _numbers(c, args, 0.0, 1.0, 0.0)
    s = F.abs(s)
    q = once(_steady(F.try_divide(x, s)))
    turned = (x < 0) & (mode != 0)
    up, down = _whole(q, F.ceil) * s, _whole(q, F.floor) * s
    return finite(F.when(s == 0, F.lit(0.0)).when(turned, down if name == "CEILING.MATH" else up).otherwise(up if name == "CEILING.MATH" else down), error)


@scalar("LOG")
def _(c, _n, args):
    (x, b), error = _numbers(c, args, 0.0, 10.0)
    return finite(round_sig(F.try_divide(F.ln(x), F.ln(b))), error, ((x <= 0) | (b <= 0), "#NUM!"), (b == 1, "#DIV/0!"))


@scalar("MROUND")
def _(c, _n, args):
    (x, m), error = _numbers(c, args)
    q = F.try_divide(x, m)
    return finite(F.when((x == 0) | (m == 0), F.lit(0.0)).otherwise(round_sig(F.signum(q) * _whole(once(_steady(F.abs(q), halves=True) + 0.5), F.floor) * m)), error, (x * m < 0, "#NUM!"))


@scalar("QUOTIENT")
def _(c, _n, args):
    (a, b), error = _numbers(c, args)
    return finite(_trunc(once(F.try_divide(a, b))), error, (b == 0, "#DIV/0!"))


@scalar("TRUE FALSE")
def _(c, name, args):
    return V(B, F.lit(name == "TRUE"))


@scalar("NA")
def _(c, name, args):
    return failing("#N/A")


@scalar("IF")
def _(c, _n, args):
    test = boolean(c.node(args[0]))
    zero = lambda v: V(N, F.lit(0.0)) if v.kind == EMPTY and v.error is None else v
    then = zero(c.node(args[1]))
    other = V(B, F.lit(False)) if len(args) < 3 else zero(c.node(args[2]))
    return chosen([(F.coalesce(test.value, F.lit(False)), then)], other, test.error)


@scalar("IFS")
def _(c, _n, args):
    if len(args) % 2:
        raise Unsupported("IFS without a value")
    tests = [boolean(c.node(a)) for a in args[::2]]
    # an error in a test counts if no test before it holds
    cases = [(F.coalesce(t.value, F.lit(False)) if t.error is None else F.coalesce(t.value, F.lit(False)) | t.error.isNotNull(), V(v.kind, v.value, first_error(t, v))) for t, v in zip(tests, [c.node(a) for a in args[1::2]], strict=True)]
    return chosen(cases, failing("#N/A"))


@scalar("SWITCH")
def _(c, _n, args):
    x = c.node(args[0])
    pairs = [(c.node(args[i]), c.node(args[i + 1])) for i in range(1, len(args) - 1, 2)]
    default = c.node(args[-1]) if len(args) % 2 == 0 else failing("#N/A")
    cases = [(F.coalesce(compared("=", x, k).value, F.lit(False)) & x.value.isNotNull() & k.value.isNotNull() if k.kind == x.kind else F.lit(False), v) for k, v in pairs]
    return chosen(cases, default, x.error)


@scalar("CHOOSE")
def _(c, _n, args):
    (k,), error = _numbers(c, args[:1])
    return chosen([(F.floor(k) == i, v) for i, v in enumerate(map(c.node, args[1:]), 1)], failing("#VALUE!"), error)


@scalar("IFERROR IFNA")
def _(c, name, args):
    v, alt = c.node(args[0]), c.node(args[1])
    if v.error is None:
        return v
    bad = v.error.isNotNull() if name == "IFERROR" else F.coalesce(v.error == "#N/A", F.lit(False))
    return chosen([(bad, alt)], v)


@scalar("NOT")
def _(c, _n, args):
    v = boolean(c.node(args[0]))
    return V(B, ~v.value, v.error)


@scalar("ISBLANK ISNUMBER ISTEXT ISLOGICAL ISNONTEXT ISERROR ISERR ISNA")
def _(c, name, args):
    v = c.node(args[0])
    error = F.lit(None).cast("string") if v.error is None else v.error
    there = error.isNull() & v.value.isNotNull()
    of = lambda kind: there if v.kind == kind else F.lit(False)
    return V(B, {"ISBLANK": error.isNull() & v.value.isNull(), "ISNUMBER": of(N), "ISTEXT": of(S), "ISLOGICAL": of(B), "ISNONTEXT": ~of(S), "ISERROR": error.isNotNull(), "ISERR": F.coalesce(error != "#N/A", F.lit(False)), "ISNA": F.coalesce(error == "#N/A", F.lit(False))}[name])


@scalar("CONCATENATE")
def _(c, _n, args):
    vs = [text(c.node(a)) for a in args]
    out = F.concat(*[v.value for v in vs])
    return guarded(S, out, first_error(*vs), (F.length(out) > 32_767, "#VALUE!"))


def _text(name: str, f, kind: str = S):
    @scalar(name)
    def _(c, _n, args):
        v = text(c.node(args[0]))
        return guarded(kind, f(v.value), v.error)


_text("LEN", lambda t: F.length(t).cast("double"), N)
_text("UPPER", F.upper)
_text("LOWER", F.lower)
_text("TRIM", lambda t: F.regexp_replace(F.trim(t), " +", " "))
_text("CLEAN", lambda t: F.regexp_replace(t, r"[\x00-\x1F]", ""))


@scalar("LEFT RIGHT")
def _(c, name, args):
    t, ((n,), e) = text(c.node(args[0])), _numbers(c, args[1:], 1.0)
    n = _int(_trunc(n))
    size = F.length(t.value)
    out = F.substring(t.value, F.lit(1), n) if name == "LEFT" else F.substring(t.value, size - F.least(n, size) + 1, n)
    return guarded(S, F.when(n == 0, F.lit("")).otherwise(out), first_error(t, e), (n < 0, "#VALUE!"))


@scalar("MID")
def _(c, _n, args):
    t, ((s, n), e) = text(c.node(args[0])), _numbers(c, args[1:])
    s, n = _int(_trunc(s)), _int(_trunc(n))
    return guarded(S, F.substring(t.value, s, n), first_error(t, e), ((s < 1) | (n < 0), "#VALUE!"))


@scalar("SUBSTITUTE")
def _(c, _n, args):
    t, old, new = (text(c.node(a)) for a in args[:3])
    if len(args) == 3:
        out = F.when(old.value == "", t.value).otherwise(F.replace(t.value, old.value, new.value))
        return guarded(S, out, first_error(t, old, new))
    (k,), e = _numbers(c, args[3:])
    k = _int(_trunc(k))
    before = F.call_function("substring_index", t.value, old.value, k)
    whole = (old.value == "") | (before == t.value)
    out = F.when(whole, t.value).otherwise(F.concat(before, new.value, F.substring(t.value, F.length(before) + F.length(old.value) + 1, F.length(t.value))))
    return guarded(S, out, first_error(t, old, new, e), (k < 1, "#VALUE!"))


@scalar("REPT")
def _(c, _n, args):
    t, ((n,), e) = text(c.node(args[0])), _numbers(c, args[1:])
    n = _int(_trunc(n))
    bad = (n < 0) | (F.octet_length(t.value).cast("long") * n > 32_767)
    return guarded(S, F.when(~bad, F.repeat(t.value, n)), first_error(t, e), (bad, "#VALUE!"))


@scalar("EXACT")
def _(c, _n, args):
    a, b = (text(c.node(x)) for x in args)
    return guarded(B, a.value == b.value, first_error(a, b))


@scalar("FIND")
def _(c, _n, args):
    a, b, ((s,), e) = text(c.node(args[0])), text(c.node(args[1])), _numbers(c, args[2:], 1.0)
    s = _int(_trunc(s))
    at = F.position(a.value, b.value, s)
    return guarded(N, at.cast("double"), first_error(a, b, e), ((s < 1) | (s > F.length(b.value) + 1) | (at == 0), "#VALUE!"))


@scalar("SEARCH")
def _(c, name, args):
    if not isinstance(args[0], p.Text):
        return c.interpreted(p.Call(name, tuple(args)))  # a pattern for each row
    b, ((s,), e) = text(c.node(args[1])), _numbers(c, args[2:], 1.0)
    s, pattern = once(_int(_trunc(s))), java_wildcard(args[0].value, whole=False)
    rest = once(F.substring(b.value, F.greatest(s, F.lit(1)), F.length(b.value)))
    at = F.when(rest.rlike(pattern), F.length(F.regexp_extract(rest, pattern.replace("(?isu)", "(?isu)^(.*?)", 1), 1)) + s)
    return guarded(N, at.cast("double"), first_error(b, e), ((s < 1) | (s > F.length(b.value) + 1) | at.isNull(), "#VALUE!"))


@scalar("CODE")
def _(c, _n, args):
    a = text(c.node(args[0]))
    first = once(F.substring(a.value, 1, 1))
    k, place = F.ascii(first), F.instr(F.lit(CP1252), first)
    out = F.when((k < 128) | k.between(160, 255), k).when(place > 0, place + 127).otherwise(F.lit(63))
    return guarded(N, out.cast("double"), a.error, (first == "", "#VALUE!"))


@scalar("CHAR")
def _(c, _n, args):
    (x,), e = _numbers(c, args)
    k = _int(_trunc(x))
    high = F.substring(F.lit(CP1252), k - 127, F.lit(1))
    return guarded(S, F.when((k >= 128) & (k < 160), high).otherwise(F.chr(k)), e, ((k < 1) | (k > 255), "#VALUE!"))


@scalar("VALUE")
def _(c, _n, args):
    v = c.node(args[0])
    return V(N, no_value(N), first_error(v, F.lit("#VALUE!"))) if v.kind == B else number(v)


@scalar("TODAY NOW")
def _(c, name, args):
    return V(N, to_serial(F.current_date() if name == "TODAY" else F.current_timestamp()))


def _ymd(x: Column) -> tuple[Column, Column, Column]:
    """Year, month and day of a serial, with the day that never was."""
    day, n = once(from_serial(x)), once(F.floor(x))
    return tuple(F.when(n == 60, F.lit(odd)).when(n == 0, F.lit(zero)).otherwise(f(day)) for f, odd, zero in ((F.year, 1900, 1900), (F.month, 2, 1), (F.dayofmonth, 29, 0)))


def _month_start(months: Column) -> tuple[Column, Column]:
    """The serial of the first day of a month counted from year 0, and the month's days."""
    first = once(F.add_months(F.lit("1900-01-01").cast("date"), months - 22_800))
    n = once(F.datediff(first, F.lit("1899-12-30").cast("date")))
    return F.when(n > 60, n).otherwise(n - 1), F.when(months == 22_801, F.lit(29)).otherwise(F.dayofmonth(F.last_day(first)))


@scalar("DATE")
def _(c, _n, args):
    (y, m, d), e = _numbers(c, args)
    y, m, d = (_int(_trunc(x), 1e6) for x in (y, m, d))
    y = F.when((y >= 0) & (y < 1900), y + 1900).otherwise(y)
    months = y * 12 + m - 1
    out = _month_start(months)[0] + d - 1
    return guarded(N, out.cast("double"), e, ((months < 22_800) | (months >= 120_000) | (out < 0), "#NUM!"))


@scalar("YEAR MONTH DAY")
def _(c, name, args):
    (x,), e = _numbers(c, args)
    out = dict(zip(("YEAR", "MONTH", "DAY"), _ymd(x), strict=True))[name]
    return guarded(N, out.cast("double"), e, ((x < 0) | (x > 2_958_466), "#NUM!"))


@scalar("WEEKDAY")
def _(c, _n, args):
    (x, k), e = _numbers(c, args, 0.0, 1.0)
    day = F.pmod(_int(F.floor(x)) - 1, F.lit(7))
    out = F.when(k.isin(1.0, 17.0), day + 1).when(k == 3, F.pmod(day - 1, F.lit(7))).otherwise(F.pmod(day - 1, F.lit(7)) + 1)
    return guarded(N, out.cast("double"), e, ((x < 0) | ~k.isin(1.0, 2.0, 3.0, 11.0, 17.0), "#NUM!"))


@scalar("EDATE EOMONTH")
def _(c, name, args):
    (x, m), e = _numbers(c, args)
    # from March 1900 on serials are days on end, so dates serve; the rest goes by years and months
    x, m = once(x), once(_int(_trunc(m), 1e5))
    moved = once(F.add_months(from_serial(x), m))
    plain = once((x >= 61) & (x <= 2_958_466) & (F.abs(m) < 24_000) & moved.between(F.lit("1900-03-01").cast("date"), F.lit("9999-12-31").cast("date")))
    quick = F.datediff(F.last_day(moved) if name == "EOMONTH" else moved, F.lit("1899-12-30").cast("date"))
    year, month, day = _ymd(x)
    months = year * 12 + month - 1 + m
    months = once(F.when(plain, F.lit(None)).otherwise(F.when((months >= 0) & (months < 22_800), months + 22_800).otherwise(months)))
    first, days = _month_start(months)
    out = first + (days if name == "EOMONTH" else F.least(day, days)) - 1
    bad = (x < 0) | (x > 2_958_466) | (months < 22_800) | (months >= 120_000) | (out < 0)
    return guarded(N, F.when(plain, quick).otherwise(out).cast("double"), e, (F.when(plain, F.lit(False)).otherwise(bad), "#NUM!"))


@scalar("DAYS")
def _(c, _n, args):
    (a, b), e = _numbers(c, args)
    return guarded(N, (F.floor(a) - F.floor(b)).cast("double"), e)


@scalar("TIME")
def _(c, _n, args):
    (h, m, s), e = _numbers(c, args)
    x = _trunc(h) * 3600 + _trunc(m) * 60 + _trunc(s)
    return guarded(N, F.pmod(x, F.lit(86_400.0)) / 86_400, e, (x < 0, "#NUM!"))


@scalar("HOUR MINUTE SECOND")
def _(c, name, args):
    (x,), e = _numbers(c, args)
    s = F.pmod(F.round((x - F.floor(x)) * 86_400).cast("int"), F.lit(86_400))
    out = {"HOUR": F.floor(s / 3600), "MINUTE": F.pmod(F.floor(s / 60), F.lit(60)), "SECOND": F.pmod(s, F.lit(60))}[name]
    return guarded(N, out.cast("double"), e, (x < 0, "#NUM!"))


@scalar("ISOWEEKNUM")
def _(c, _n, args):
    (x,), e = _numbers(c, args)
    return guarded(N, F.weekofyear(from_serial(x)).cast("double"), e, ((x < 1) | (x > 2_958_466), "#NUM!"))


def _constants(e: p.Expr) -> list[float] | None:
    """The numbers of a constant or a constant array."""
    cells = [x for row in e.rows for x in row] if isinstance(e, p.Array) else [e]
    return [x.value for x in cells] if all(isinstance(x, p.Number) for x in cells) else None


_DATES_END = 2_958_466


@scalar("NETWORKDAYS")
def _(c, _n, args):
    holidays = _constants(args[2]) if len(args) > 2 else []
    if holidays is None:
        raise Unsupported("holidays that are not constants in a column formula")
    (a, b), e = _numbers(c, args[:2])
    lo, hi = once(_int(F.floor(F.least(a, b)), 2e9)), once(_int(F.floor(F.greatest(a, b)), 2e9))
    # whole weeks have five working days; those before serial n, counted from a Monday
    before = lambda n: F.floor((n - 2) / 7) * 5 + F.least(F.pmod(n - 2, F.lit(7)), F.lit(5))
    free = sorted({int(x // 1) for x in holidays if (int(x // 1) - 2) % 7 < 5})
    off = F.size(F.filter(F.array(*map(F.lit, free)), lambda x: x.between(lo, hi))) if free else F.lit(0)
    days = once(before(hi + 1) - before(lo) - off)
    return guarded(N, F.when(a > b, -days).otherwise(days).cast("double"), e, ((a < 0) | (b < 0), "#NUM!"))


@scalar("WORKDAY")
def _(c, name, args):
    if len(args) > 2:
        return c.interpreted(p.Call(name, tuple(args)))
    (x, n), e = _numbers(c, args)
    x, n = once(_int(F.floor(x), 2e9)), once(_trunc(n))
    day = once(F.pmod(x - 2, F.lit(7)))  # from Monday on
    # from a weekend steps begin as if from the working day on its other side
    forth = once(F.least(day, F.lit(4)) + n)
    back = once(F.when(day > 4, 0).otherwise(day) + n)
    ahead = x - day + F.floor(forth / 5) * 7 + F.pmod(forth, F.lit(5.0))
    behind = x - day + F.when(day > 4, 7).otherwise(0) + F.floor(back / 5) * 7 + F.pmod(back, F.lit(5.0))
    out = once(F.when(n > 0, ahead).when(n < 0, behind).otherwise(x.cast("double")))
    return guarded(N, out, e, ((x < 0) | (F.abs(n) > 1_000_000) | (out < 0), "#NUM!"))


#: By a kind of week, the day from Sunday on that it begins with.
_WEEK_STARTS = {1: 0, 2: 1, 11: 1, 12: 2, 13: 3, 14: 4, 15: 5, 16: 6, 17: 0}


@scalar("WEEKNUM")
def _(c, name, args):
    kind = _constants(args[1]) if len(args) > 1 else [1.0]
    if kind == [21.0]:
        return SCALARS["ISOWEEKNUM"](c, "ISOWEEKNUM", args[:1])
    if not kind or len(kind) != 1 or int(kind[0]) not in _WEEK_STARTS:
        return c.interpreted(p.Call(name, tuple(args)))
    (x,), e = _numbers(c, args[:1])
    x = once(x)
    first = once(_month_start(_ymd(x)[0] * 12)[0])
    out = F.floor((_int(F.floor(x)) - first + F.pmod(first - 1 - _WEEK_STARTS[int(kind[0])], F.lit(7))) / 7) + 1
    return guarded(N, out.cast("double"), e, ((x < 0) | (x > _DATES_END), "#NUM!"))


@scalar("DATEDIF")
def _(c, name, args):
    unit = args[2].value.upper() if isinstance(args[2], p.Text) else None
    if unit not in ("D", "M", "Y", "YM"):
        return c.interpreted(p.Call(name, tuple(args)))
    (a, b), e = _numbers(c, args[:2])
    a, b = once(F.floor(a)), once(F.floor(b))
    bad = (a < 0) | (b < 0) | (a > _DATES_END) | (b > _DATES_END) | (a > b)
    if unit == "D":
        return guarded(N, (b - a).cast("double"), e, (bad, "#NUM!"))
    (y1, m1, d1), (y2, m2, d2) = _ymd(a.cast("double")), _ymd(b.cast("double"))
    months = once((y2 - y1) * 12 + m2 - m1 - (d2 < d1).cast("int"))
    out = {"M": months, "Y": F.floor(months / 12), "YM": F.pmod(months, F.lit(12))}[unit]
    return guarded(N, out.cast("double"), e, (bad, "#NUM!"))


@scalar("PMT PV FV NPER")
def _(c, name, args):
    (r, x, y, z, t), e = _numbers(c, args, 0.0, 0.0, 0.0, 0.0, 0.0)
    due = F.when(t != 0, r + 1).otherwise(F.lit(1.0))
    if name == "NPER":
        q = F.try_divide(x * due - z * r, x * due + y * r)
        return finite(F.when(r == 0, F.try_divide(-(y + z), x)).otherwise(F.try_divide(F.ln(q), F.ln(r + 1))), e, ((r != 0) & ((q <= 0) | (r <= -1)), "#NUM!"))
    g = F.pow(r + 1, x)
    flat, grown = {
        "PMT": (F.try_divide(-(y + z), x), F.try_divide(-(y * g + z) * r, due * (g - 1))),
        "PV": (-(y * x + z), F.try_divide(-(z + F.try_divide(y * due * (g - 1), r)), g)),
        "FV": (-(z + y * x), -(z * g + F.try_divide(y * due * (g - 1), r))),
    }[name]
    return finite(F.when(r == 0, flat).otherwise(grown), e)


# ranges


def aggregate(names: str):
    def add(f):
        for n in names.split():
            AGGREGATES[n] = f
        return f

    return add


def _error_of(c: Compiler, *vs: V) -> Column | None:
    """The first error among all rows, in the order of the table if it has one."""
    errors = [v.error for v in vs if v.error is not None]
    if not errors:
        return None
    e = F.coalesce(*errors)
    return F.max(e) if c.order is None else F.min_by(e, F.when(e.isNotNull(), c.order))


def _typed(e: p.Expr) -> bool:
    """Whether an argument is a value of its own, not one of each row."""
    return not isinstance(e, p.Name | p.Ref) and all(map(_typed, p.children(e)))


def _folded(c, args, fold, join, empty, one=lambda x: x):
    """An aggregate of each range, joined with each other and with typed values."""
    vs = [c.numbers(a) for a in args]
    parts = [one(v.value) if _typed(a) else fold(v.value) for a, v in zip(args, vs, strict=True)]
    return vs, join([F.coalesce(x, empty) if empty is not None else x for x in parts]), _error_of(c, *vs)


@aggregate("SUM SUMSQ")
def _(c, name, args):
    _, out, error = _folded(c, args, (lambda x: F.sum(x)) if name == "SUM" else (lambda x: F.sum(x * x)), lambda xs: reduce(lambda a, b: a + b, xs), F.lit(0.0), (lambda x: x) if name == "SUM" else (lambda x: x * x))
    return finite(out, error)


@aggregate("PRODUCT")
def _(c, _n, args):
    _, out, error = _folded(c, args, F.product, lambda xs: reduce(lambda a, b: a * b, xs), F.lit(1.0))
    return finite(out, error)


@aggregate("MIN MAX")
def _(c, name, args):
    pick = F.least if name == "MIN" else F.greatest
    _, out, error = _folded(c, args, F.min if name == "MIN" else F.max, lambda xs: xs[0] if len(xs) == 1 else pick(*xs), None)
    return guarded(N, F.coalesce(out, F.lit(0.0)), error)


@aggregate("AVERAGE")
def _(c, _n, args):
    vs = [c.numbers(a) for a in args]
    n = reduce(lambda a, b: a + b, [F.lit(1) if _typed(a) else F.count(v.value) for a, v in zip(args, vs, strict=True)])
    total = reduce(lambda a, b: a + b, [v.value if _typed(a) else F.coalesce(F.sum(v.value), F.lit(0.0)) for a, v in zip(args, vs, strict=True)])
    return finite(F.try_divide(total, n.cast("double")), _error_of(c, *vs), (n == 0, "#DIV/0!"))


def _single(c, args) -> V:
    if len(args) > 1:
        raise Unsupported("several ranges")
    return c.numbers(args[0])


@aggregate("MEDIAN")
def _(c, _n, args):
    v = _single(c, args)
    return guarded(N, F.median(v.value), _error_of(c, v), (F.count(v.value) == 0, "#NUM!"))


@aggregate("STDEV STDEV.S STDEV.P VAR VAR.S VAR.P")
def _(c, name, args):
    v = _single(c, args)
    f = {"STDEV": F.stddev_samp, "VAR": F.var_samp, "STDEV.P": F.stddev_pop, "VAR.P": F.var_pop}[name.removesuffix(".S")]
    return guarded(N, f(v.value), _error_of(c, v), (F.count(v.value) < (1 if name.endswith(".P") else 2), "#DIV/0!"))


@aggregate("COUNT")
def _(c, _n, args):
    return V(N, reduce(lambda a, b: a + b, [F.count(F.when(F.lit(True) if v.error is None else v.error.isNull(), v.value)) for v in [c.numbers(a) for a in args]]).cast("double"))


@aggregate("COUNTA")
def _(c, _n, args):
    vs = [c.node(a) for a in args]
    return V(N, reduce(lambda a, b: a + b, [F.count_if(v.value.isNotNull() if v.error is None else v.value.isNotNull() | v.error.isNotNull()) for v in vs]).cast("double"))


@aggregate("COUNTBLANK")
def _(c, _n, args):
    v = c.node(args[0])
    blank = v.value.isNull() | (v.value == "") if v.kind == S else v.value.isNull()
    return V(N, F.count_if(blank if v.error is None else blank & v.error.isNull()).cast("double"))


@aggregate("SUMPRODUCT")
def _(c, _n, args):
    vs = [c.node(a) for a in args]
    factors = [F.coalesce(v.value, F.lit(0.0)) if v.kind == N else F.lit(0.0) for v in vs]
    return finite(F.coalesce(F.sum(reduce(lambda a, b: a * b, factors)), F.lit(0.0)), _error_of(c, *vs))


@aggregate("AND OR XOR")
def _(c, name, args):
    vs = [c.node(a) for a in args]
    vs = [V(B, no_value(B), v.error) if v.kind == S and v.ranged or v.kind == EMPTY else V(B, F.when(v.value.isNotNull(), boolean(v).value), first_error(boolean(v))) for v in vs]
    n = reduce(lambda a, b: a + b, [F.count(v.value) for v in vs])
    true = reduce(lambda a, b: a + b, [F.count_if(F.coalesce(v.value, F.lit(False))) for v in vs])
    out = {"AND": true == n, "OR": true > 0, "XOR": true % 2 == 1}[name]
    return guarded(B, out, _error_of(c, *vs), (n == 0, "#VALUE!"))


def _row_logic(c, name, args):
    vs = [boolean(c.node(a)) for a in args]
    xs = [v.value for v in vs]
    if name == "XOR":
        return guarded(B, reduce(lambda a, b: a + b, [x.cast("int") for x in xs]) % 2 == 1, first_error(*vs))
    return guarded(B, reduce((lambda a, b: a & b) if name == "AND" else (lambda a, b: a | b), xs), first_error(*vs))


@aggregate("LARGE SMALL")
def _(c, name, args):
    if not isinstance(args[1], p.Number):
        raise Unsupported("a computed place")
    import math

    k, v = math.ceil(args[1].value), c.numbers(args[0])
    # over a whole table long columns do not come this far, see _by_ranges
    n = F.count(v.value)
    values = F.sort_array(F.collect_list(v.value), asc=name == "SMALL")
    return guarded(N, F.try_element_at(values, F.lit(k)) if k > 0 else no_value(N), _error_of(c, v), ((n < k) | F.lit(k < 1), "#NUM!"))


@aggregate("MODE MODE.SNGL")
def _(c, _n, args):
    raise Unsupported("MODE needs a pass of its own: see operators.ranking.mode")


@aggregate("CONCAT TEXTJOIN")
def _(c, name, args):
    if c.order is None:
        raise Unsupported("rows without an order")
    delimiter, skip, parts = "", False, args
    if name == "TEXTJOIN":
        if not isinstance(args[0], p.Text) or not isinstance(args[1], p.Bool) or len(args) > 3:
            raise Unsupported("TEXTJOIN of several ranges")
        delimiter, skip, parts = args[0].value, args[1].value, args[2:]
    vs = [text(c.node(a)) for a in parts]
    row = F.concat(*[v.value for v in vs])
    kept = F.when(row != "", row) if skip else row
    ordered = F.transform(F.sort_array(F.collect_list(F.when(kept.isNotNull(), F.struct(c.order.alias("o"), kept.alias("t"))))), lambda x: x["t"])
    out = F.array_join(ordered, delimiter)
    return guarded(S, out, _error_of(c, *vs), (F.length(out) > 32_767, "#VALUE!"))


# conditions


def criterion(v: V, test: Criterion) -> Column:
    """A criterion on a column whose kind is known; never null."""
    want, op = test.want, test.op
    if test.blank and op in ("=", "<>"):
        empty = v.value.isNull() if v.kind != S or test.exact_blank else v.value.isNull() | (v.value == "")
        return empty if op == "=" else ~empty
    if op in ("=", "<>"):
        if isinstance(want, Err):
            hit = F.lit(False) if v.error is None else F.coalesce(v.error == want.code, F.lit(False))
        elif isinstance(want, str):
            hit = F.lit(False) if v.kind != S else F.coalesce(F.lower(v.value) == want.lower(), F.lit(False)) if not any(x in want for x in "*?~") else F.coalesce(v.value.rlike(java_wildcard(want)), F.lit(False))
        elif isinstance(want, bool):
            hit = F.coalesce(v.value == want, F.lit(False)) if v.kind == B else F.lit(False)
        else:
            x = v.value if v.kind == N else text_number(v.value) if v.kind == S else None
            hit = F.lit(False) if x is None else F.coalesce(x == want, F.lit(False))
        return hit if op == "=" else ~hit
    kind = B if isinstance(want, bool) else S if isinstance(want, str) else N
    if isinstance(want, Err) or v.kind != kind:
        return F.lit(False)
    x, y = (F.lower(v.value), want.lower()) if kind == S else (v.value, want)
    return F.coalesce(_test(op, x, F.lit(y)), F.lit(False))


def java_wildcard(pattern: str, whole: bool = True) -> str:
    out, i = "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "~" and i + 1 < len(pattern) and pattern[i + 1] in "*?~":
            i += 1
            ch = pattern[i]
        elif ch in "*?":
            out += ".*" if ch == "*" else "."
            i += 1
            continue
        out += ch if ch.isalnum() or ch == " " else f"\\x{{{ord(ch):x}}}"
        i += 1
    return f"(?isu)^{out}$" if whole else f"(?isu){out}"


def _literal_criterion(e: p.Expr) -> Criterion:
    if isinstance(e, p.Unary) and e.op == "-" and isinstance(e.of, p.Number):
        return Criterion(-e.of.value)
    if isinstance(e, p.Number | p.Text | p.Bool):
        return Criterion(e.value)
    if isinstance(e, p.Binary) and e.op == "&":
        sides = [x.value if isinstance(x, p.Number | p.Text) else None for x in (e.left, e.right)]
        if None not in sides:
            return Criterion("".join(map(to_text, sides)))
    raise Unsupported("a computed criterion")


@aggregate("SUMIF AVERAGEIF COUNTIF SUMIFS AVERAGEIFS MAXIFS MINIFS COUNTIFS")
def _(c, name, args):
    """One aggregate with a condition: several of them over a table share one pass."""
    if name in ("SUMIF", "AVERAGEIF", "COUNTIF"):
        target, pairs = (args[2] if len(args) > 2 and not isinstance(args[2], p.Missing) else args[0]), args[:2]
    elif name == "COUNTIFS":
        target, pairs = None, args
    else:
        target, pairs = args[0], args[1:]
    if len(pairs) % 2:
        raise Unsupported("a criterion is missing")
    hit = reduce(lambda a, b: a & b, [criterion(c.node(r), _literal_criterion(k)) for r, k in zip(pairs[::2], pairs[1::2], strict=True)])
    if name.startswith("COUNT"):
        return V(N, F.count_if(hit).cast("double"))
    v = c.numbers(target)
    x = F.when(hit, v.value)
    error = _error_of(c, V(N, x, None if v.error is None else F.when(hit, v.error)))
    if name.startswith("AVERAGE"):
        return finite(F.avg(x), error, (F.count(x) == 0, "#DIV/0!"))
    f = {"SUM": F.sum, "MAX": F.max, "MIN": F.min}[name[:3]]
    return finite(F.coalesce(f(x), F.lit(0.0)), error)


# tables


def _shown(v: V, alias: str, with_error: bool = True) -> list[Column]:
    value = F.coalesce(v.value, F.when(F.lit(True) if v.error is None else v.error.isNull(), F.lit(0.0))) if v.kind == EMPTY else v.value
    error = F.lit(None).cast("string") if v.error is None else v.error
    return [value.alias(alias), *[error.alias(f"{alias}__err")] * with_error]


def with_formulas(df: DataFrame, formulas: dict[str, str | p.Expr], errors: bool = True, order: Column | None = None, names: dict[str, V] | None = None) -> DataFrame:
    """df with a column for each formula, one projection for all, and a column __err for its errors. names: what
    else formulas may call by name.

    A formula whose value is of no one kind becomes struct<k, n, s, b> with the kind of each row."""
    global _bindings
    c, out, bound = RowCompiler(df, order, names), [], Bindings()
    _bindings = bound
    try:
        for alias, f in formulas.items():
            try:
                out += _shown(c.compile(f), alias, errors)
            except Unsupported:
                bound.own = []
                value = c.tagged(p.parse(f) if isinstance(f, str) else f)
                out += [value["v"].alias(alias), *[value["e"].alias(f"{alias}__err")] * errors]
            bound.keep()
    finally:
        _bindings = None
    return bound.over(df).select(*[F.col(f"`{x}`") for x in df.columns], *out)


#: Numbers that an order statistic over a whole table may hold in one task; more are counted by ranges.
IN_TASK = 1_000_000


def _by_ranges(df: DataFrame, c: Compiler, e: p.Expr, in_task: int) -> p.Expr:
    """e with each MEDIAN, LARGE and SMALL of more numbers than one task may hold as the constant it comes to."""
    e = p.rebuilt(e, lambda x: _by_ranges(df, c, x, in_task))
    median = isinstance(e, p.Call) and e.name == "MEDIAN" and len(e.args) == 1
    if not median and not (isinstance(e, p.Call) and e.name in ("LARGE", "SMALL") and len(e.args) == 2 and isinstance(e.args[1], p.Number)):
        return e
    v = c.numbers(e.args[0])
    failed = F.lit(None).cast("string") if v.error is None else v.error
    n, errors = df.agg(F.count(v.value), F.count(failed)).first()
    if n <= max(in_task, 0):
        return e
    if errors:
        return p.Call("SUM", e.args[:1])  # which fails alike
    from gridloom.operators.ranking import at_places

    k = -(-e.args[1].value // 1) if not median else 0
    places = [(n + 1) // 2, n // 2 + 1] if median else [int(k if e.name == "SMALL" else n - k + 1)]
    if not median and not 1 <= k <= n:
        return p.Error("#NUM!")
    found = at_places(df.select(v.value.alias("v")), "v", places)
    x = sum(found) / len(found)
    return p.Number(x) if x >= 0 else p.Unary("-", p.Number(-x))


def aggregated(df: DataFrame, formulas: dict[str, str], by: Iterable[str] = (), errors: bool = True, order: Column | None = None, in_task: int = IN_TASK) -> DataFrame:
    """One row (one for each value of by) with the value of each formula over whole columns, in one pass; order
    statistics over more than in_task numbers of the whole table take a pass of their own."""
    c, keys = Compiler(df, order), list(by)
    parsed = {alias: p.parse(f) for alias, f in formulas.items()}
    if not keys:
        parsed = {alias: _by_ranges(df, c, e, in_task) for alias, e in parsed.items()}
    out = [x for alias, e in parsed.items() for x in _shown(c.compile(e), alias, errors)]
    return df.groupBy(*keys).agg(*out) if keys else df.agg(*out)


class RowCompiler(Compiler):
    """Of functions that read ranges, only those make sense in a row that read several values of it."""

    def call(self, e: p.Call) -> V:
        if e.name in ("AND", "OR", "XOR"):
            return _row_logic(self, e.name, e.args)
        if e.name in ("SUM", "MIN", "MAX", "AVERAGE", "PRODUCT") and len(e.args) > 1:
            xs, error = _numbers(self, e.args)
            joined = {"SUM": lambda: reduce(lambda a, b: a + b, xs), "PRODUCT": lambda: reduce(lambda a, b: a * b, xs), "MIN": lambda: F.least(*xs), "MAX": lambda: F.greatest(*xs), "AVERAGE": lambda: reduce(lambda a, b: a + b, xs) / len(xs)}[e.name]()
            return finite(joined, error)
        if e.name in AGGREGATES:
            raise Unsupported(f"{e.name} over a column in a row: aggregate it first")
        return super().call(e)


__all__ = ["Compiler", "RowCompiler", "V", "aggregated", "criterion", "with_formulas", "CellError"]
