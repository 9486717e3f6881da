"""Structural edits: where rows or columns go, and the references in formulas that follow them."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.formula import parser as p


@dataclass(frozen=True)
class LineMove:
    """count lines from first on go before another line, are inserted, or are deleted."""

    kind: str  # move, insert, delete
    first: int
    count: int
    before: int = 0

    @staticmethod
    def move(first: int, count: int, before: int) -> LineMove:
        if count < 1 or first < 1 or before < 1 or first < before < first + count:
            raise ValueError("lines cannot move into themselves")
        return LineMove("move", first, count, before)

    @staticmethod
    def insert(before: int, count: int) -> LineMove:
        if count < 1 or before < 1:
            raise ValueError("nothing to insert")
        return LineMove("insert", before, count)

    @staticmethod
    def delete(first: int, count: int) -> LineMove:
        if count < 1 or first < 1:
            raise ValueError("nothing to delete")
        return LineMove("delete", first, count)

    def _steps(self) -> list[tuple[int, int, int | None]]:
        """(from, to, shift) of the lines that change place; None: they go."""
        a, n, b = self.first, self.count, self.before
        far = 1 << 30
        if self.kind == "insert":
            return [(a, far, n)]
        if self.kind == "delete":
            return [(a, a + n - 1, None), (a + n, far, -n)]
        if b > a:
            return [(a, a + n - 1, b - a - n), (a + n, b - 1, -n)]
        return [(a, a + n - 1, b - a), (b, a - 1, n)]

    def line(self, i: int) -> int | None:
        for lo, hi, by in self._steps():
            if lo <= i <= hi:
                return None if by is None else i + by
        return i

    def column(self, c: Column) -> Column:
        """line() as an expression; null where the line is deleted."""
        out = c
        for lo, hi, by in reversed(self._steps()):
            out = F.when(c.between(lo, hi), F.lit(None).cast("int") if by is None else c + by).otherwise(out)
        return out

    def span(self, a: int, b: int) -> tuple[int, int] | None:
        """Where a range of lines goes. A range around both the block and its destination stays as it is; one
        inside the block goes with it. Any other has its ends where the outermost of its own lines go that
        stay in place: lines that leave make it shrink, lines that come in between make it grow."""
        if self.kind == "insert":
            return self.line(a), self.line(b)
        if self.kind == "delete":
            kept = [self.line(i) for i in (a, b)]
            lo = self.first if kept[0] is None else kept[0]
            hi = self.first - 1 if kept[1] is None else kept[1]
            return (lo, hi) if lo <= hi else None
        first, last = self.first, self.first + self.count - 1
        if a <= first and last <= b and a <= self.before <= b + 1:
            return a, b
        if not (first <= a and b <= last):
            a = last + 1 if first <= a <= last else a
            b = first - 1 if first <= b <= last else b
        return self.line(a), self.line(b)

    def pieces(self, a: int, b: int) -> list[tuple[int, int]]:
        """A range of lines where they end up, as runs of adjacent lines in order; for what may fall apart,
        such as the area of a rule."""
        runs: list[tuple[int, int]] = []
        steps = sorted({a, b + 1, *(x for lo, hi, _ in self._steps() for x in (lo, hi + 1) if a < x <= b)})
        for lo, end in zip(steps, steps[1:], strict=False):
            if (at := self.line(lo)) is not None:
                runs.append((at, at + end - lo - 1))
        out: list[tuple[int, int]] = []
        for lo, hi in sorted(runs):
            if out and lo == out[-1][1] + 1:
                out[-1] = (out[-1][0], hi)
            else:
                out.append((lo, hi))
        return out

    def torn(self, a: int, b: int) -> bool:
        """Whether the lines a to b, of a merge or a table, would not stay together."""
        edges = {"move": (self.first, self.first + self.count, self.before), "insert": (self.first,), "delete": ()}[self.kind]
        return any(a < x <= b for x in edges)

    def pushed_off(self, used: int, limit: int) -> bool:
        """Whether lines in use would go beyond the sheet's last one."""
        return self.kind == "insert" and used >= self.first and used + self.count > limit


_REFERENCE = re.compile(
    r"""("(?:[^"]|"")*")                                   # text
    |((?:'(?:[^']|'')+'|[^\W\d][\w.]*)!)?                  # sheet
     (\$?[A-Za-z]{1,3}\$?[1-9]\d*(?::\$?[A-Za-z]{1,3}\$?[1-9]\d*)?|\$?[A-Za-z]{1,3}:\$?[A-Za-z]{1,3}|\$?\d+:\$?\d+)(?![\w.(!])""",
    re.VERBOSE,
)


def moved_formula(formula: str, own_sheet: str, sheet: str, move: LineMove, rows: bool = True) -> str:
    """A formula of own_sheet after lines of sheet have moved. Only references change, so that formulas
    whose other syntax is not evaluated survive."""

    def one(m: re.Match) -> str:
        before = formula[m.start() - 1] if m.start() else ""
        if m[1] or before and (before.isalnum() or before in "_.]$"):
            return m[0]
        of = own_sheet if not m[2] else (m[2][1:-2].replace("''", "'") if m[2][0] == "'" else m[2][:-1])
        if of.lower() != sheet.lower():
            return m[0]
        ends = m[3].split(":")
        parts = [re.fullmatch(r"(\$?)([A-Za-z]*)(\$?)(\d*)", e) for e in ends]
        take = (lambda x: int(x[4]) if x[4] else None) if rows else (lambda x: p.column_number(x[2]) if x[2] else None)
        lines = [take(x) for x in parts]
        if None in lines:
            return m[0]
        if len(lines) == 1:
            new = move.line(lines[0])
            new = None if new is None else (new,)
        else:
            new = move.span(min(lines), max(lines))
        if new is None:
            return (m[2] or "") + "#REF!"
        shown = [x[1] + x[2] + x[3] + str(n) if rows else x[1] + p.column_name(n) + x[3] + x[4] for x, n in zip(parts, new, strict=True)]
        return (m[2] or "") + ":".join(shown)

    return _REFERENCE.sub(one, formula)


def renamed_formula(formula: str, old: str, new: str) -> str:
    """A formula after a sheet's new name; texts and other workbooks' sheets stay."""
    pattern = re.compile(r"""("(?:[^"]|"")*")|(?<![\w.\]])('(?:[^']|'')+'|[^\W\d][\w.]*)!""")

    def one(m: re.Match) -> str:
        if m[1]:
            return m[0]
        name = m[2][1:-1].replace("''", "'") if m[2][0] == "'" else m[2]
        return (p.quoted(new) if name.lower() == old.lower() else m[2]) + "!"

    return pattern.sub(one, formula)


#: Lines of a sheet; what sheet names may not hold, and their length.
ROWS, COLUMNS = 1_048_576, 16_384
BAD_IN_NAMES, NAME_LENGTH = "[]:*?/\\", 31


def check_sheet_name(name: str, others: list[str]) -> None:
    if not name or len(name) > NAME_LENGTH or any(c in BAD_IN_NAMES for c in name) or name[0] == "'" or name[-1] == "'":
        raise ValueError(f"no name for a sheet: {name!r}")
    if name.lower() in (o.lower() for o in others):
        raise ValueError(f"there is a sheet {name!r}")


def moved_cells(cells: DataFrame, sheet: int, name: str, move: LineMove, rows: bool = True, names: dict[int, str] | None = None) -> DataFrame:
    """All cells after lines of one sheet have moved: places on that sheet, references everywhere."""
    names = {sheet: name, **(names or {})}
    axis = "row" if rows else "col"
    placed = cells.withColumn(axis, F.when(F.col("sheet") == sheet, move.column(F.col(axis))).otherwise(F.col(axis))).filter(F.col(axis).isNotNull())

    @F.pandas_udf("string")
    def follow(formula: pd.Series, of: pd.Series) -> pd.Series:
        return pd.Series([None if f is None else moved_formula(f, names.get(s, ""), name, move, rows) for f, s in zip(formula, of, strict=True)])

    plain = placed.filter("formula is null")
    return plain.unionByName(placed.filter("formula is not null").withColumn("formula", follow("formula", "sheet")))


def checked(move: LineMove, sheet: int, merges: list[dict], used: int = 0, rows: bool = True) -> None:
    """Refuses a move that would tear a merged area (sheet, r1, c1, r2, c2) or push lines in use off the sheet."""
    limit = ROWS if rows else COLUMNS
    if move.pushed_off(used, limit):
        raise ValueError("lines in use would go beyond the end of the sheet")
    lo, hi = ("r1", "r2") if rows else ("c1", "c2")
    if any(m["sheet"] == sheet and move.torn(m[lo], m[hi]) for m in merges):
        raise ValueError("a merged area would be torn")


def moved_areas(areas: DataFrame, sheet: int, move: LineMove, rows: bool = True) -> DataFrame:
    """Areas (sheet, r1, c1, r2, c2, ...), such as merges, tables or targets of names, after lines of a sheet have
    moved; those whose lines are all deleted go. Plain expressions: an area's ends follow the rule of span()."""
    lo, hi = ("r1", "r2") if rows else ("c1", "c2")
    a, b, own = F.col(lo), F.col(hi), F.col("sheet") == sheet
    if move.kind == "delete":
        first, last = move.first, move.first + move.count - 1
        ends = F.when(a.between(first, last), first).otherwise(move.column(a)), F.when(b.between(first, last), first - 1).otherwise(move.column(b))
    elif move.kind == "insert":
        ends = move.column(a), move.column(b)
    else:
        first, last = move.first, move.first + move.count - 1
        around = (a <= first) & (b >= last) & (a <= move.before) & (b + 1 >= move.before)
        within = (a >= first) & (b <= last)
        start = F.when(a.between(first, last) & ~within, last + 1).otherwise(a)
        end = F.when(b.between(first, last) & ~within, first - 1).otherwise(b)
        ends = F.when(around, a).otherwise(move.column(start)), F.when(around, b).otherwise(move.column(end))
    moved = areas.withColumns({lo: F.when(own, ends[0]).otherwise(a).cast("int"), hi: F.when(own, ends[1]).otherwise(b).cast("int")})
    return moved.filter(F.col(lo) <= F.col(hi))


def moved_sizes(sizes: DataFrame, sheet: int, move: LineMove) -> DataFrame:
    """Sizes of lines (sheet, line, ...) after lines of a sheet have moved; those of deleted lines go."""
    return sizes.withColumn("line", F.when(F.col("sheet") == sheet, move.column(F.col("line"))).otherwise(F.col("line")).cast("int")).filter("line is not null")


def moved_names(names: dict[str, str], sheet: str, move: LineMove, rows: bool = True) -> dict[str, str]:
    """Defined names' formulas after lines of a sheet have moved."""
    return {k: moved_formula(v, "", sheet, move, rows) for k, v in names.items()}


def renamed_cells(cells: DataFrame, old: str, new: str) -> DataFrame:
    """All cells after a sheet's new name: formulas that refer to it follow."""

    @F.pandas_udf("string")
    def follow(formula: pd.Series) -> pd.Series:
        return formula.map(lambda f: renamed_formula(f, old, new), na_action="ignore")

    # only formulas that name a sheet are looked at in Python
    names = F.coalesce(F.contains(F.col("formula"), F.lit("!")), F.lit(False))
    return cells.filter(~names).unionByName(cells.filter(names).withColumn("formula", follow("formula")))
