"""Lookups inside column formulas, as joins with other tables.

A formula's VLOOKUP, XLOOKUP, MATCH or INDEX over a named table becomes a join ahead of the formula's own
projection, innermost first, and the formula then reads the joined column. A table is a DataFrame with an
order; its name stands for all its columns, name.column for one of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.formula import parser as p
from gridloom.formula.compiler import V, bound, with_formulas
from gridloom.formula.parser import Unsupported
from gridloom.operators import lookup


@dataclass(frozen=True)
class Table:
    """columns in the order that column numbers count them; order: the column that gives rows theirs."""

    rows: DataFrame
    columns: tuple[str, ...]
    order: str


def _constant(e: p.Expr, default: float | None = None) -> float:
    if isinstance(e, p.Missing) and default is not None:
        return default
    if isinstance(e, p.Unary) and e.op == "-":
        return -_constant(e.of)
    if isinstance(e, p.Number | p.Bool):
        return float(e.value)
    raise Unsupported("a lookup's column or mode that is no constant")


class _Joins:
    """The table as joined so far, and the names that formulas know the joined columns by."""

    def __init__(self, df: DataFrame, tables: dict[str, Table]):
        self.df, self.names, self.count = df, {}, 0
        self.tables = {k.upper(): v for k, v in tables.items()}

    def table(self, e: p.Expr) -> Table | None:
        return self.tables.get(e.name.upper()) if isinstance(e, p.Name) else None

    def column(self, e: p.Expr) -> tuple[Table, str] | None:
        """A table's column by its name."""
        if not isinstance(e, p.Name) or "." not in e.name:
            return None
        name, _, column = e.name.upper().partition(".")
        found = self.tables.get(name)
        own = [c for c in found.columns if c.upper() == column] if found else []
        return (found, own[0]) if own else None

    def replaced(self, e: p.Expr) -> p.Expr:
        e = p.rebuilt(e, self.replaced)
        if not isinstance(e, p.Call):
            return e
        args = [*e.args, *[p.Missing()] * (6 - len(e.args))]
        if e.name == "VLOOKUP" and 3 <= len(e.args) <= 4 and (t := self.table(args[1])):
            at = int(_constant(args[2]))
            if not 1 <= at <= len(t.columns):
                return p.Error("#REF!" if at > 0 else "#VALUE!")
            near = _constant(args[3], 0.0 if len(e.args) == 4 else 1.0) != 0
            return self.joined(args[0], t, t.columns[0], t.columns[at - 1], 1 if near else 2)
        if e.name == "MATCH" and 2 <= len(e.args) <= 3 and (own := self.column(args[1])):
            mode = _constant(args[2], 0.0 if len(e.args) == 3 else 1.0)
            return self.joined(args[0], *own, None, 1 if mode > 0 else 2 if mode == 0 else -1)
        if e.name == "INDEX" and len(e.args) == 2 and (own := self.column(args[0])):
            return self.joined(args[1], own[0], None, own[1], 0)
        if e.name == "XLOOKUP" and 3 <= len(e.args) <= 6 and (keys := self.column(args[1])) and (values := self.column(args[2])):
            if keys[0] is not values[0]:
                raise Unsupported("keys and results of different tables")
            mode, search = int(_constant(args[4], 0.0)), _constant(args[5], 1.0)
            found = self.joined(args[0], *keys, values[1], {0: 3, 2: 2, 1: 4, -1: 5}[mode], last=search < 0)
            return found if isinstance(args[3], p.Missing) else p.Call("IFNA", (found, args[3]))
        return e

    def joined(self, key: p.Expr, t: Table, key_column: str | None, value: str | None, mode: int, last: bool = False) -> p.Name:
        """mode 0: the row of a number; 1, -1: as a scan of rising or falling keys stops; 2: equal, or a text that fits
        wildcards; 3: equal; 4, 5: equal or next larger, next smaller. Without value: the row's number."""
        n, self.count = self.count, self.count + 1
        have = self.df.columns
        at, out = f"__key{n}", f"__look{n}"
        df = with_formulas(self.df, {at: key}, names=self.names)
        rows = t.rows.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*t.columns, t.order])])
        if value is None or mode in (0, 1, -1):
            rows = lookup.numbered(rows, t.order, "__place")
        order = "__place" if "__place" in rows.columns else t.order
        wanted = value or "__place"
        if mode in (2, 3):
            df = lookup.exact(df, at, rows, key_column, wanted, order, out, last=last, wild=mode == 2)
        elif mode in (4, 5):
            # of equal keys the first row, or the last
            one = rows.groupBy(F.col(key_column).alias("__k")).agg((F.max_by if last else F.min_by)(F.struct(F.col(wanted).alias("v")), F.col(order)).alias("__hit"))
            df = lookup.as_of(df, at, one, "__k", ["__hit"], "__near", upward=mode == 4)
            df = df.withColumns({out: F.col("__near__hit.v"), f"{out}__err": F.when(F.col("__near__hit").isNull(), F.lit("#N/A"))})
        else:
            place = F.floor(F.col(at)).cast("long") if mode == 0 else F.col("__at").cast("long")
            if mode:
                sign = -1 if mode < 0 else 1
                scanned = rows.select((F.col(key_column) * sign).alias("__k"), "__place")
                df = lookup.approximate_match(df.withColumn("__x", F.col(at) * sign), "__x", scanned, "__k", "__place", "__at")
            side = rows.select(F.col("__place").alias("__p"), F.struct(F.col(wanted).alias("v")).alias("__hit"))
            df = df.withColumn("__to", place).join(side, F.col("__to") == F.col("__p"), "left")
            missing = F.when(F.col("__hit").isNull(), F.lit("#N/A" if mode else "#REF!"))
            df = df.withColumns({out: F.col("__hit.v"), f"{out}__err": missing})
        # a key's own error comes first
        df = df.withColumn(f"{out}__err", F.coalesce(F.col(f"{at}__err"), F.col(f"{out}__err")))
        self.df = df.select(*[F.col(f"`{c}`") for c in have], out, f"{out}__err")
        v = bound(self.df.schema[out], F.col(out))
        if v is None:
            raise Unsupported(f"values of {wanted}")
        error = F.col(f"{out}__err")
        self.names[out.upper()] = V(v.kind, F.when(error.isNull(), v.value), error)
        return p.Name(out)


def with_lookups(df: DataFrame, formulas: dict[str, str], tables: dict[str, Table], errors: bool = True) -> DataFrame:
    """df with a column for each formula, as with_formulas(), where formulas may look up other tables."""
    joins = _Joins(df, tables)
    parsed = {alias: joins.replaced(p.parse(f)) for alias, f in formulas.items()}
    out = with_formulas(joins.df, parsed, errors, names=joins.names)
    return out.drop(*[c for c in joins.df.columns if c not in df.columns])
