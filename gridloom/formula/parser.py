"""Formula text to syntax tree and back.

Loosest to tightest: comparison, &, + -, * /, ^ (from the left), %, sign. So -2^2 is 4 and 2^3^2 is 64.
Syntax that is known but not evaluated raises Unsupported; text that is no formula raises Invalid.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

MAX_ROW, MAX_COL = 1_048_576, 16_384
#: Error literals.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA")
#: Functions that files store with the prefix _xlfn.
PREFIXED = frozenset("CONCAT IFNA IFS ISOWEEKNUM MAXIFS MINIFS TEXTJOIN SWITCH XLOOKUP XMATCH XOR FILTER SORT UNIQUE SEQUENCE LET DAYS CEILING.MATH FLOOR.MATH RANK.EQ MODE.SNGL STDEV.S STDEV.P VAR.S VAR.P".split())


class Unsupported(Exception):
    """The formula is well-formed but not evaluated here; a cell keeps its stored value."""


class Invalid(Exception):
    """The text is no formula."""


class Expr:
    pass


@dataclass(frozen=True)
class Number(Expr):
    value: float


@dataclass(frozen=True)
class Text(Expr):
    value: str


@dataclass(frozen=True)
class Bool(Expr):
    value: bool


@dataclass(frozen=True)
class Error(Expr):
    code: str


@dataclass(frozen=True)
class Missing(Expr):
    pass


@dataclass(frozen=True)
class Pos:
    """One end of a reference; a row of None stands for the whole column."""

    row: int | None
    col: int
    fixed_row: bool = False
    fixed_col: bool = False

    def shifted(self, rows: int, cols: int) -> Pos | None:
        row = self.row if self.row is None or self.fixed_row else self.row + rows
        col = self.col if self.fixed_col else self.col + cols
        return replace(self, row=row, col=col) if (row is None or 1 <= row <= MAX_ROW) and 1 <= col <= MAX_COL else None

    def __str__(self) -> str:
        return ("$" if self.fixed_col else "") + column_name(self.col) + ("" if self.row is None else ("$" if self.fixed_row else "") + str(self.row))


@dataclass(frozen=True)
class Ref(Expr):
    first: Pos
    last: Pos | None = None
    sheet: str | None = None

    def box(self) -> tuple[int, int, int, int]:
        """First row, first column, last row, last column."""
        last = self.last or self.first
        rows = (1, MAX_ROW) if self.first.row is None else (min(self.first.row, last.row), max(self.first.row, last.row))
        return rows[0], min(self.first.col, last.col), rows[1], max(self.first.col, last.col)


@dataclass(frozen=True)
class Name(Expr):
    name: str


@dataclass(frozen=True)
class Unary(Expr):
    op: str  # - or + before, % after
    of: Expr


@dataclass(frozen=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr


@dataclass(frozen=True)
class Call(Expr):
    name: str
    args: tuple[Expr, ...]


@dataclass(frozen=True)
class Array(Expr):
    rows: tuple[tuple[Expr, ...], ...]


@dataclass(frozen=True)
class Paren(Expr):
    of: Expr


def column_name(n: int) -> str:
    out = ""
    while n:
        n, r = divmod(n - 1, 26)
        out = chr(65 + r) + out
    return out


def column_number(name: str) -> int:
    n = 0
    for c in name.upper():
        n = n * 26 + ord(c) - 64
    return n


_TOKENS = re.compile(
    r"""(?P<space>\s+)
    |(?P<text>"(?:[^"]|"")*")
    |(?P<error>\#(?:NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|GETTING_DATA))
    |(?P<sheet>(?:'(?:[^']|'')+'|[^\W\d][\w.]*)(?::(?:'(?:[^']|'')+'|[^\W\d][\w.]*))?!)
    |(?P<ref>\$?[A-Za-z]{1,3}\$?[1-9]\d*(?![\w.(]))
    |(?P<column>\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}(?![\w.(]))
    |(?P<row>\$?\d+:\$?\d+)
    |(?P<number>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[^\W\d][\w.]*|\\[\w.]*)
    |(?P<op><=|>=|<>|[-+*/^&=<>%(){},;:\[\]@!])""",
    re.VERBOSE,
)


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKENS.match(text, at)
        if not m:
            raise Invalid(f"unexpected {text[at]!r} at {at}")
        if m.lastgroup != "space":
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


_LEVELS = (("=", "<>", "<", "<=", ">", ">="), ("&",), ("+", "-"), ("*", "/"), ("^",))


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = tokenize(text.strip().removeprefix("=")), 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self) -> tuple[str, str]:
        found = self.peek()
        self.at += 1
        return found

    def taken(self, op: str) -> bool:
        if self.peek() == ("op", op):
            self.at += 1
            return True
        return False

    def binary(self, level: int = 0) -> Expr:
        if level == len(_LEVELS):
            return self.percent()
        left = self.binary(level + 1)
        while self.peek()[0] == "op" and self.peek()[1] in _LEVELS[level]:
            op = self.take()[1]
            left = Binary(op, left, self.binary(level + 1))
        return left

    def percent(self) -> Expr:
        out = self.sign()
        while self.taken("%"):
            out = Unary("%", out)
        return out

    def sign(self) -> Expr:
        for op in "-+":
            if self.taken(op):
                return Unary(op, self.sign())
        return self.atom()

    def atom(self) -> Expr:
        kind, text = self.take()
        if kind == "number":
            return Number(float(text))
        if kind == "text":
            return Text(text[1:-1].replace('""', '"'))
        if kind == "error":
            return Error(text)
        if kind == "sheet":
            if ":" in text.replace("''", ""):
                raise Unsupported("reference over several sheets")
            sheet = text[1:-2].replace("''", "'") if text[0] == "'" else text[:-1]
            if self.peek()[0] == "error":
                return Error(self.take()[1])
            if self.peek()[0] not in ("ref", "column", "row"):
                raise Unsupported("name of another sheet")
            return replace(self.reference(*self.take()), sheet=sheet)
        if kind in ("ref", "column", "row"):
            return self.reference(kind, text)
        if kind == "name":
            if self.taken("("):
                return Call(text.upper().removeprefix("_XLFN.").removeprefix("_XLWS."), self.arguments())
            if text.upper() in ("TRUE", "FALSE"):
                return Bool(text.upper() == "TRUE")
            if self.peek() == ("op", ":"):
                raise Unsupported("name as the end of a range")
            return Name(text)
        if (kind, text) == ("op", "("):
            out = self.binary()
            if self.peek() in (("op", ","), ("op", ";")):
                raise Unsupported("union of references")
            self.need(")")
            return Paren(out)
        if (kind, text) == ("op", "{"):
            return self.array()
        if text in ("[", "@"):
            raise Unsupported("reference to another workbook or a table")
        raise Invalid(f"unexpected {text!r}" if text else "formula ends early")

    def need(self, op: str) -> None:
        if not self.taken(op):
            raise Invalid(f"{op} expected")

    def reference(self, kind: str, text: str) -> Ref:
        if kind == "row":
            raise Unsupported("whole rows")
        if kind == "column":
            a, b = text.split(":")
            return Ref(_column(a), _column(b))
        first = _cell(text)
        if self.taken(":"):
            kind, text = self.take()
            if kind != "ref":
                raise Unsupported("range with a computed end")
            return Ref(first, _cell(text))
        return Ref(first)

    def arguments(self) -> tuple[Expr, ...]:
        if self.taken(")"):
            return ()
        out: list[Expr] = []
        while True:
            if self.peek() in (("op", ","), ("op", ";"), ("op", ")")):
                out.append(Missing())
            else:
                out.append(self.binary())
            if self.taken(")"):
                return tuple(out)
            if not (self.taken(",") or self.taken(";")):
                raise Invalid(") expected")

    def array(self) -> Array:
        rows: list[list[Expr]] = [[]]
        while True:
            minus = self.taken("-")
            kind, text = self.take()
            if kind == "number":
                rows[-1].append(Number(-float(text) if minus else float(text)))
            elif kind == "text" and not minus:
                rows[-1].append(Text(text[1:-1].replace('""', '"')))
            elif kind == "error" and not minus:
                rows[-1].append(Error(text))
            elif kind == "name" and text.upper() in ("TRUE", "FALSE") and not minus:
                rows[-1].append(Bool(text.upper() == "TRUE"))
            else:
                raise Invalid("only constants in an array")
            if self.taken("}"):
                break
            if self.taken(";"):
                rows.append([])
            elif not self.taken(","):
                raise Invalid("} expected")
        if len({len(r) for r in rows}) > 1:
            raise Invalid("rows of an array differ in length")
        return Array(tuple(map(tuple, rows)))


def _column(text: str) -> Pos:
    col = column_number(text.replace("$", ""))
    if col > MAX_COL:
        raise Invalid(f"no column {text}")
    return Pos(None, col, False, text[0] == "$")


def _cell(text: str) -> Pos:
    m = re.fullmatch(r"(\$?)([A-Za-z]+)(\$?)(\d+)", text)
    row, col = int(m[4]), column_number(m[2])
    if row > MAX_ROW or col > MAX_COL:
        raise Unsupported(f"{text} is beyond the sheet")
    return Pos(row, col, bool(m[3]), bool(m[1]))


def parse(text: str) -> Expr:
    p = _Parser(text)
    out = p.binary()
    if p.peek()[0] != "end":
        raise Unsupported("union of references") if p.peek()[1] in (",", ";") else Invalid(f"unexpected {p.peek()[1]!r}")
    return out


def children(e: Expr) -> tuple[Expr, ...]:
    if isinstance(e, Binary):
        return e.left, e.right
    if isinstance(e, Unary | Paren):
        return (e.of,)
    return e.args if isinstance(e, Call) else ()


def rebuilt(e: Expr, f) -> Expr:
    """e with f applied to its parts."""
    if isinstance(e, Binary):
        return Binary(e.op, f(e.left), f(e.right))
    if isinstance(e, Unary):
        return Unary(e.op, f(e.of))
    if isinstance(e, Paren):
        return Paren(f(e.of))
    return Call(e.name, tuple(map(f, e.args))) if isinstance(e, Call) else e


def refs(e: Expr) -> Iterator[Ref]:
    """Every reference of a formula, from left to right."""
    if isinstance(e, Ref):
        yield e
    for c in children(e):
        yield from refs(c)


def shifted(e: Expr, rows: int, cols: int) -> Expr:
    """The formula as if copied so many rows and columns on; what leaves the sheet becomes #REF!."""
    if isinstance(e, Ref):
        first, last = e.first.shifted(rows, cols), e.last and e.last.shifted(rows, cols)
        return Error("#REF!") if first is None or (e.last and last is None) else replace(e, first=first, last=last)
    return rebuilt(e, lambda x: shifted(x, rows, cols))


def relative(e: Expr, row: int, col: int) -> str:
    """The formula with references as offsets from its cell: equal for all cells of a filled column."""

    def pos(p: Pos) -> str:
        r = "" if p.row is None else f"R{p.row}" if p.fixed_row else f"R[{p.row - row}]"
        return r + (f"C{p.col}" if p.fixed_col else f"C[{p.col - col}]")

    def walk(x: Expr) -> str:
        if isinstance(x, Ref):
            return (f"{quoted(x.sheet)}!" if x.sheet else "") + pos(x.first) + (":" + pos(x.last) if x.last else "")
        parts = ",".join(map(walk, children(x)))
        return f"{type(x).__name__}({x.name if isinstance(x, Call) else getattr(x, 'op', '')};{parts})" if parts or isinstance(x, Call) else repr(x)

    return walk(e)


def quoted(sheet: str) -> str:
    plain = re.fullmatch(r"[^\W\d][\w.]*", sheet) and not re.fullmatch(r"[A-Za-z]{1,3}\d+", sheet)
    return sheet if plain else "'" + sheet.replace("'", "''") + "'"


def show(e: Expr, stored: bool = False) -> str:
    """The formula's text, without =; stored: as files have it, with prefixes of later functions."""
    if isinstance(e, Number):
        return repr(int(e.value)) if e.value == int(e.value) and abs(e.value) < 1e15 else repr(e.value).upper()
    if isinstance(e, Text):
        return '"' + e.value.replace('"', '""') + '"'
    if isinstance(e, Bool):
        return "TRUE" if e.value else "FALSE"
    if isinstance(e, Error):
        return e.code
    if isinstance(e, Missing):
        return ""
    if isinstance(e, Ref):
        return (f"{quoted(e.sheet)}!" if e.sheet else "") + str(e.first) + (f":{e.last}" if e.last else "")
    if isinstance(e, Name):
        return e.name
    if isinstance(e, Unary):
        return show(e.of, stored) + "%" if e.op == "%" else e.op + show(e.of, stored)
    if isinstance(e, Binary):
        return show(e.left, stored) + e.op + show(e.right, stored)
    if isinstance(e, Paren):
        return f"({show(e.of, stored)})"
    if isinstance(e, Array):
        return "{" + ";".join(",".join(show(x) for x in r) for r in e.rows) + "}"
    return ("_xlfn." if stored and e.name in PREFIXED else "") + e.name + "(" + ",".join(show(a, stored) for a in e.args) + ")"
