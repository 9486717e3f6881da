"""Recalculation: cells of formulas in dependency order, as lanes of one projection or cell by cell.

A lane is a column whose formulas are all the same in relative form. Where a sheet's formulas are lanes
over the row's own values and over whole columns, recalculating is a plan of projections and single-row
aggregates. Anything else goes to the interpreter, one workbook for each group.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.formula import parser as p
from gridloom.formula.compiler import _TYPE, AGGREGATES, Compiler, RowCompiler, V, _shown
from gridloom.formula.interpreter import Book, evaluate
from gridloom.formula.parser import Invalid, Unsupported
from gridloom.formula.values import Err, number_text
from gridloom.operators.areas import CELLS

MOST_EDGES = 5_000_000


def ordered(needs: dict) -> tuple[list, set]:
    """Nodes after what they need, and those that take part in a cycle: whole strongly connected
    components, found without recursion."""
    index: dict = {}
    low: dict = {}
    stack, on, out, cyclic = [], set(), [], set()
    for root in needs:
        if root in index:
            continue
        work = [(root, iter(needs[root]))]
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        while work:
            node, rest = work[-1]
            for n in rest:
                if n not in needs:
                    continue
                if n not in index:
                    index[n] = low[n] = len(index)
                    stack.append(n)
                    on.add(n)
                    work.append((n, iter(needs[n])))
                    break
                if n in on:
                    low[node] = min(low[node], index[n])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    part = []
                    while True:
                        x = stack.pop()
                        on.discard(x)
                        part.append(x)
                        if x == node:
                            break
                    if len(part) > 1 or node in needs[node]:
                        cyclic.update(part)
                    out += part
    return out, cyclic


def _used(e: p.Expr) -> set[str]:
    return ({e.name.upper()} if isinstance(e, p.Name) else set()).union(*map(_used, p.children(e)))


def _split(e: p.Expr, found: dict[str, p.Expr]) -> p.Expr:
    """A lane's formula with each function over whole columns replaced by a name of its own."""
    if isinstance(e, p.Call) and e.name in AGGREGATES and not (e.name in ("AND", "OR", "XOR") or e.name in ("SUM", "MIN", "MAX", "AVERAGE", "PRODUCT") and len(e.args) > 1):
        name = next((k for k, v in found.items() if v == e), f"__AGG{len(found)}")
        found[name] = e
        return p.Name(name)
    return p.rebuilt(e, lambda x: _split(x, found))


def recalculated(df: DataFrame, lanes: dict[str, str], order: Column | None = None) -> DataFrame:
    """df with a column for each lane and its errors in <lane>__err. Lanes may use each other in any order;
    those in a cycle stay null with the error #CYCLE!.

    Lanes go by levels: all whose needs are there. What a level's lanes aggregate over whole columns is made in
    one pass over the table and comes back as one row of values, which the lanes then hold as constants. So
    the plan grows by a projection a level and never holds an aggregate of its own past."""
    parsed = {k.upper(): p.parse(v) for k, v in lanes.items()}
    named = {k.upper(): k for k in lanes}
    needs = {k: _used(e) & set(parsed) for k, e in parsed.items()}
    order_of, cyclic = ordered(needs)
    out, kinds, left = df, {}, [k for k in order_of if k not in cyclic]
    for k in order_of:
        if k in cyclic:
            alias = named[k]
            out = out.withColumns({alias: F.lit(None).cast("double"), f"{alias}__err": F.lit("#CYCLE!")})
            kinds[k] = V("number", F.col(f"`{alias}`"), F.col(f"`{alias}__err`"), True)
    while left:
        level = [k for k in left if needs[k] <= set(kinds)]
        left = [k for k in left if k not in level]
        found: dict[str, p.Expr] = {}
        rest = {k: _split(parsed[k], found) for k in level}
        names = dict(kinds)
        if found:
            c = Compiler(out, order, names)
            made = {name: c.compile(e) for name, e in found.items()}
            row = out.agg(*[x for name, v in made.items() for x in _shown(v, name)]).first()  # one row
            names |= {name: V(v.kind, F.lit(row[name]).cast(_TYPE[v.kind]), F.lit(row[f"{name}__err"]).cast("string")) for name, v in made.items()}
        compiled = {k: RowCompiler(out, order, names).compile(rest[k]) for k in level}
        out = out.select("*", *[x for k, v in compiled.items() for x in _shown(v, named[k])])
        kinds |= {k: V(v.kind, F.col(f"`{named[k]}`"), F.col(f"`{named[k]}__err`"), True) for k, v in compiled.items()}
    return out


def running_total(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """The lane B2 = B1 + A2, which needs itself one row above: a window over each group."""
    from pyspark.sql import Window

    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.sum(F.coalesce(F.col(value), F.lit(0.0))).over(w))


def _value(k, n, s, b, e):
    return float(n) if k == "n" else s if k == "s" else bool(b) if k == "b" else Err(e) if k == "e" else None


def book_of(pdf: pd.DataFrame, sheet_names: dict[int, str], names: dict, now: float) -> Book:
    sheets: dict[str, dict] = {v: {} for v in sheet_names.values()}
    for r in pdf.itertuples():
        v = _value(r.k, r.n, r.s, r.b, r.e)
        if v is not None:
            sheets.setdefault(sheet_names.get(int(r.sheet), f"Sheet{int(r.sheet)}"), {})[int(r.row), int(r.col)] = v
    return Book(sheets, names, now=now)


def recalculated_book(pdf: pd.DataFrame, sheet_names: dict[int, str], names: dict | None = None, now: float = 0.0) -> pd.DataFrame:
    """Cells of one workbook with changed: formulas evaluated in order. Unsupported formulas and whole
    cycles keep their values; a value equal to 15 digits counts as unchanged."""
    title = lambda i: sheet_names.get(int(i), f"Sheet{int(i)}")
    book = book_of(pdf, sheet_names, names or {}, now)
    formulas: dict[tuple, p.Expr] = {}
    for r in pdf[pdf.formula.notna()].itertuples():
        try:
            formulas[title(r.sheet), int(r.row), int(r.col)] = p.parse(r.formula)
        except (Unsupported, Invalid):
            continue
    by_column: dict[tuple, list] = {}
    for s, r, c in formulas:
        by_column.setdefault((s, c), []).append(r)
    for rows in by_column.values():
        rows.sort()

    def targets(e: p.Expr, sheet: str, depth: int = 0):
        for ref in p.refs(e):
            s = sheet if ref.sheet is None else book.find(ref.sheet)
            r1, c1, r2, c2 = ref.box()
            for (of, c), rows in by_column.items():
                if of == s and c1 <= c <= c2:
                    yield from ((of, r, c) for r in rows if r1 <= r <= r2)
        for n in _used(e):
            text = book.name(sheet, n)
            if text is not None and depth < 16:
                yield from targets(p.parse(text), sheet, depth + 1)

    needs, edges = {}, 0
    for at, e in formulas.items():
        needs[at] = set(targets(e, at[0]))
        edges += len(needs[at])
        if edges > MOST_EDGES:
            return pdf.assign(changed=False)
    order, cyclic = ordered(needs)
    changed = set()
    for at in order:
        if at in cyclic:
            continue
        try:
            v = evaluate(book, *at, formulas[at])
        except Unsupported:
            continue
        old = book.sheets[at[0]].get(at[1:])
        same = type(old) is type(v) and (number_text(old) == number_text(v) if isinstance(v, float) else old == v)
        if not same:
            changed.add(at)
            book.sheets[at[0]][at[1:]] = v
    out = pdf.copy()
    out["changed"] = [(title(s), int(r), int(c)) in changed for s, r, c in zip(pdf.sheet, pdf.row, pdf.col, strict=True)]
    for i in out.index[out["changed"]]:
        v = book.sheets[title(out.at[i, "sheet"])][int(out.at[i, "row"]), int(out.at[i, "col"])]
        out.loc[i, ["k", "n", "s", "b", "e"]] = ["b" if isinstance(v, bool) else "n" if isinstance(v, float) else "e" if isinstance(v, Err) else "s", v if isinstance(v, float) else None, v if isinstance(v, str) else None, v if isinstance(v, bool) else None, v.code if isinstance(v, Err) else None]
    return out


def recalculated_cells(cells: DataFrame, sheet_names: dict[int, str], names: dict | None = None, now: float = 0.0) -> DataFrame:
    """recalculated_book for every workbook of a cells table."""
    run: Callable = lambda pdf: recalculated_book(pdf, sheet_names, names, now)[[*[x.split()[0] for x in CELLS.split(", ")], "changed"]]
    return cells.groupBy("workbook_id").applyInPandas(run, f"{CELLS}, changed boolean")
