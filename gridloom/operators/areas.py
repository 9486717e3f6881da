"""Areas of cells: regions, titles and headers, profiles, statistics of a selection.

cells: (workbook_id, sheet, row, col, k, n, s, b, e, formula) with k one of n s b e, or null for empty.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CELLS = "workbook_id string, sheet int, row int, col int, k string, n double, s string, b boolean, e string, formula string"


def boxes(filled: set[tuple[int, int]]) -> list[tuple[int, int, int, int]]:
    """Bounding boxes (first row, first column, last row, last column) of cells that touch, corners
    included; boxes that touch or overlap unite until none do."""
    left, out = set(filled), []
    while left:
        stack = [left.pop()]
        box = [*stack[0], *stack[0]]
        while stack:
            r, c = stack.pop()
            box = [min(box[0], r), min(box[1], c), max(box[2], r), max(box[3], c)]
            near = {(r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            stack += near
        out.append(tuple(box))
    out.sort()
    merged = True
    while merged:
        merged, rest = False, []
        for b in out:
            for i, a in enumerate(rest):
                if a[0] <= b[2] + 1 and b[0] <= a[2] + 1 and a[1] <= b[3] + 1 and b[1] <= a[3] + 1:
                    rest[i], merged = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])), True
                    break
            else:
                rest.append(b)
        out = rest
    return sorted(out)


def structure(cells: dict[tuple[int, int], str], box: tuple[int, int, int, int]) -> tuple[int, int | None]:
    """How many title rows a box starts with, and its header row: two texts or more (fewer only if the box
    is narrower) and nothing else, with something other than text in the row below."""
    r1, c1, r2, c2 = box
    kinds = lambda r: [cells[r, c] for c in range(c1, c2 + 1) if (r, c) in cells]
    titles = 0
    while r1 + titles < r2 and c2 > c1 and kinds(r1 + titles) == ["s"]:
        titles += 1
    row = r1 + titles
    own, below = kinds(row), kinds(row + 1) if row < r2 else []
    header = len(own) >= min(2, c2 - c1 + 1) and set(own) == {"s"} and bool(set(below) - {"s"})
    return titles, row if header else None


def regions(cells: DataFrame) -> DataFrame:
    """(workbook_id, sheet, r1, c1, r2, c2, titles, header_row) for each region: one sheet at a time."""

    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds = {(int(r), int(c)): k for r, c, k in zip(pdf.row, pdf.col, pdf.k, strict=True) if k}
        out = [(pdf.workbook_id.iloc[0], int(pdf.sheet.iloc[0]), *box, *structure(kinds, box)) for box in boxes(set(kinds))]
        return pd.DataFrame(out, columns=["workbook_id", "sheet", "r1", "c1", "r2", "c2", "titles", "header_row"])

    used = cells.filter(F.col("k").isNotNull()).select("workbook_id", "sheet", "row", "col", "k")
    return used.groupBy("workbook_id", "sheet").applyInPandas(find, "workbook_id string, sheet int, r1 int, c1 int, r2 int, c2 int, titles int, header_row int")


def region_at(areas: DataFrame, points: DataFrame) -> DataFrame:
    """points (workbook_id, sheet, row, col) with the area around each: a table if there is one, the smallest."""
    table = (F.col("kind") != "table") if "kind" in areas.columns else F.lit(True)
    size = F.struct(table, (F.col("r2") - F.col("r1") + 1) * (F.col("c2") - F.col("c1") + 1))
    inside = F.col("row").between(F.col("r1"), F.col("r2")) & F.col("col").between(F.col("c1"), F.col("c2"))
    found = points.join(areas, ["workbook_id", "sheet"], "left").withColumn("__box", F.when(inside, F.struct("r1", "c1", "r2", "c2")))
    return found.groupBy("workbook_id", "sheet", "row", "col").agg(F.min_by("__box", F.when(inside, size)).alias("area"))


def to_cells(df: DataFrame, columns: list[str], row: str, workbook: str = "w", sheet: int = 1) -> DataFrame:
    """A table in long form, a cell for each value."""
    kinds = dict(df.dtypes)
    each = []
    for i, c in enumerate(columns, 1):
        x = F.col(f"`{c}`")
        text, flag = kinds[c] == "string", kinds[c] == "boolean"
        each.append(F.struct(F.lit(i).alias("col"), F.when(x.isNotNull(), F.lit("s" if text else "b" if flag else "n")).alias("k"), (F.lit(None) if text or flag else x).cast("double").alias("n"), (x if text else F.lit(None)).cast("string").alias("s"), (x if flag else F.lit(None)).cast("boolean").alias("b")))
    out = df.select(F.col(row).cast("int").alias("row"), F.explode(F.array(*each)).alias("x"))
    return out.select(F.lit(workbook).alias("workbook_id"), F.lit(sheet).alias("sheet"), "row", "x.col", "x.k", "x.n", "x.s", "x.b", F.lit(None).cast("string").alias("e"), F.lit(None).cast("string").alias("formula"))


def profile(cells: DataFrame) -> DataFrame:
    """Of each column of cells: its type, filled cells, count, sum, min, max and average of its numbers,
    formulas. A total row without a table's metadata counts as data."""
    kinds = F.sort_array(F.collect_set("k"))
    kind = F.when(F.size(kinds) == 0, F.lit("empty")).when(F.size(kinds) == 1, F.element_at(F.create_map(*[F.lit(x) for x in ("n", "number", "s", "string", "b", "boolean", "e", "error")]), F.try_element_at(kinds, F.lit(1))))
    kind = kind.when((F.size(kinds) == 2) & F.array_contains(kinds, "n") & F.array_contains(kinds, "e"), F.lit("number")).otherwise(F.lit("mixed"))
    x = F.when(F.col("k") == "n", F.col("n"))
    return cells.groupBy("workbook_id", "sheet", "col").agg(kind.alias("type"), F.count("k").alias("filled"), F.count(x).alias("numbers"), F.sum(x).alias("sum"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("avg"), F.count("formula").alias("formulas"))


def selection_stats(cells: DataFrame, hidden_rows: DataFrame | None = None, hidden_cols: DataFrame | None = None) -> DataFrame:
    """What a status bar shows: filled cells; sum, average, min and max of numbers unless there is an error.
    Hidden lines (row or col) do not count."""
    seen = cells.filter(F.col("k").isNotNull())
    if hidden_rows is not None:
        seen = seen.join(hidden_rows, "row", "left_anti")
    if hidden_cols is not None:
        seen = seen.join(hidden_cols, "col", "left_anti")
    x = F.when(F.col("k") == "n", F.col("n"))
    fine = F.count_if(F.col("k") == "e") == 0
    return seen.agg(F.count("*").alias("count"), *[F.when(fine, f(x)).alias(name) for name, f in (("numbers", F.count), ("sum", F.sum), ("average", F.avg), ("min", F.min), ("max", F.max))])


def runs(cells: DataFrame) -> DataFrame:
    """Runs of numbers down each column (autosum ranges, block edges): first and last row, by gaps and islands."""
    w = Window.partitionBy("workbook_id", "sheet", "col").orderBy("row")
    own = cells.filter("k = 'n'").withColumn("__g", F.col("row") - F.row_number().over(w))
    return own.groupBy("workbook_id", "sheet", "col", "__g").agg(F.min("row").alias("first"), F.max("row").alias("last"), F.sum("n").alias("sum")).drop("__g")


def find_cells(cells: DataFrame, pattern: str, whole: bool = False, hidden: DataFrame | None = None) -> DataFrame:
    """Cells whose value, as a cell in General format shows it, or whose formula a search with * ? ~ hits, in order
    of sheet, row and column. Sheets of hidden (workbook_id, sheet) are passed over."""
    from gridloom.formula.compiler import java_wildcard, number_text

    regex = java_wildcard(pattern, whole)
    shown = F.when(F.col("k") == "n", number_text(F.col("n"))).when(F.col("k") == "b", F.upper(F.col("b").cast("string"))).when(F.col("k") == "e", F.col("e")).otherwise(F.col("s"))
    seen = cells if hidden is None else cells.join(hidden.select("workbook_id", "sheet"), ["workbook_id", "sheet"], "left_anti").select(*cells.columns)
    return seen.filter(F.coalesce(shown.rlike(regex), F.lit(False)) | F.coalesce(F.col("formula").rlike(regex), F.lit(False))).orderBy("sheet", "row", "col")


def replace_cells(cells: DataFrame, pattern: str, replacement: str, tag: str = "en") -> DataFrame:
    """cells with every hit in texts and formulas replaced, the replacement taken as it is, and n_replaced. A text
    that has changed is typed again: what reads as a number, a share or a truth value becomes one."""
    from gridloom.formula.compiler import java_wildcard
    from gridloom.functions.typed import infer_column

    regex = java_wildcard(pattern, whole=False)
    literal = replacement.replace("\\", "\\\\").replace("$", "\\$")
    count = lambda c: F.coalesce(F.regexp_count(c, F.lit(regex)), F.lit(0))
    out = cells.withColumns({"n_replaced": count(F.col("s")) + count(F.col("formula")), "__changed": count(F.col("s")) > 0})
    out = out.withColumns({"s": F.regexp_replace("s", regex, literal), "formula": F.regexp_replace("formula", regex, literal)})
    own = F.col("__changed") & (F.col("k") == "s") & F.col("formula").isNull()
    # only texts that begin as a number or a truth value can turn into one; few enough to look at in Python
    out = out.withColumn("__t", F.when(own & F.col("s").rlike(r"(?iu)^\s*([-+($€£.,]?\s*[$€£]?\s*[0-9.,]|true\s*$|false\s*$|verdadero\s*$|falso\s*$)"), F.col("s")))
    out = out.withColumn("__v", infer_column(F.col("__t"), tag))
    kind = F.when(F.col("__t").isNull(), None).when(F.col("__v.type").isin("number", "percent"), F.lit("n")).when(F.col("__v.type") == "boolean", F.lit("b"))
    out = out.withColumn("__k", kind)
    typed = F.col("__k").isNotNull()
    new = {"k": F.coalesce("__k", "k"), "n": F.when(F.col("__k") == "n", F.col("__v.number")).otherwise(F.col("n")), "b": F.when(F.col("__k") == "b", F.col("__v.number") != 0).otherwise(F.col("b")), "s": F.when(~typed, F.col("s"))}
    return out.withColumns(new).select(*cells.columns, "n_replaced")


def offsets(lines: DataFrame, axis: str = "row", size: str = "size") -> DataFrame:
    """lines (sheet, axis, size, hidden) with the offset of each line on its sheet; hidden ones take no room."""
    room = F.when(F.col("hidden"), F.lit(0.0)).otherwise(F.col(size))
    w = Window.partitionBy("sheet").orderBy(axis).rowsBetween(Window.unboundedPreceding, 0)
    return lines.withColumn("offset", F.sum(room).over(w) - room)


def hide(lines: DataFrame, first: int, last: int, axis: str = "row", hidden: bool = True) -> DataFrame:
    return lines.withColumn("hidden", F.when(F.col(axis).between(first, last), F.lit(hidden)).otherwise(F.col("hidden")))


def merge(merges: DataFrame, cells: DataFrame, workbook: str, sheet: int, r1: int, c1: int, r2: int, c2: int) -> DataFrame:
    """merges (workbook_id, sheet, r1, c1, r2, c2) and one more; refused where it would hide a value or
    meet another merge."""
    own = (F.col("workbook_id") == workbook) & (F.col("sheet") == sheet)
    inside = F.col("row").between(r1, r2) & F.col("col").between(c1, c2) & ~((F.col("row") == r1) & (F.col("col") == c1))
    meets = (F.col("r1") <= r2) & (F.col("r2") >= r1) & (F.col("c1") <= c2) & (F.col("c2") >= c1)
    if not cells.filter(own & inside & F.col("k").isNotNull()).isEmpty() or not merges.filter(own & meets).isEmpty():
        raise ValueError("the merge is refused")
    return merges.unionByName(merges.sparkSession.createDataFrame([(workbook, sheet, r1, c1, r2, c2)], merges.schema))


def unmerge(merges: DataFrame, workbook: str, sheet: int, row: int, col: int) -> DataFrame:
    hit = (F.col("workbook_id") == workbook) & (F.col("sheet") == sheet) & F.lit(row).between(F.col("r1"), F.col("r2")) & F.lit(col).between(F.col("c1"), F.col("c2"))
    return merges.filter(~hit)


def all_areas(cells: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared areas (workbook_id, sheet, kind, name, r1, c1, r2, c2: tables, names, filters) and the regions
    that none of them overlaps, each with kind and name."""
    found = regions(cells).withColumns({"kind": F.lit("region"), "name": F.lit(None).cast("string")})
    box = ["r1", "c1", "r2", "c2"]
    other = declared.select("workbook_id", "sheet", *[F.col(c).alias(f"__{c}") for c in box])
    meets = (F.col("r1") <= F.col("__r2")) & (F.col("r2") >= F.col("__r1")) & (F.col("c1") <= F.col("__c2")) & (F.col("c2") >= F.col("__c1"))
    same = (found["workbook_id"] == other["workbook_id"]) & (found["sheet"] == other["sheet"])
    free = found.join(other, same & meets, "left_anti")
    columns = ["workbook_id", "sheet", "kind", "name", *box]
    return declared.select(*columns).unionByName(free.select(*columns))


def resolved(areas_: DataFrame, target: str) -> DataFrame:
    """The area of a name, in any case, or of an address such as B2:D9."""
    from gridloom.formula import parser as p

    try:
        e = p.parse(target)
    except (p.Invalid, p.Unsupported):
        e = None
    named = areas_.filter(F.lower("name") == target.lower())
    if isinstance(e, p.Ref) and e.first.row is not None:
        r1, c1, r2, c2 = e.box()
        return named.unionByName(areas_.filter((F.col("r1") == r1) & (F.col("c1") == c1) & (F.col("r2") == r2) & (F.col("c2") == c2)))
    return named


def context(cells: DataFrame, sheet: int, r1: int, c1: int, r2: int, c2: int, most_rows: int = 20) -> dict:
    """What describes an area in short: its profile by column, its first rows, and both as Markdown. Only
    the profile (a row for each column) and most_rows rows come to the driver."""
    own = cells.filter((F.col("sheet") == sheet) & F.col("row").between(r1, r2) & F.col("col").between(c1, c2))
    kinds = {(r.row, r.col): r.k for r in own.filter((F.col("row") <= r1 + 20) & F.col("k").isNotNull()).select("row", "col", "k").collect()}
    titles, header = structure(kinds, (r1, c1, r2, c2))
    first = (header + 1) if header else r1 + titles
    shown = own.filter(F.col("row") < first + most_rows).select("row", "col", F.coalesce("s", F.col("n").cast("string"), F.upper(F.col("b").cast("string")), "e").alias("t")).collect()
    at = {(r.row, r.col): r.t or "" for r in shown}
    names = [at.get((header, c), "") if header else f"Column {c}" for c in range(c1, c2 + 1)]
    rows = [[at.get((r, c), "") for c in range(c1, c2 + 1)] for r in range(first, min(r2, first + most_rows - 1) + 1)]
    line = lambda xs: "| " + " | ".join(x.replace("|", "\\|") for x in xs) + " |"
    profile_ = [r.asDict() for r in profile(own.filter(F.col("row") >= first)).orderBy("col").collect()]
    title = next((at[k] for k in sorted(at) if k[0] < first and k[0] != header), None)
    return {"title": title, "columns": names, "profile": profile_, "rows": rows, "markdown": "\n".join([line(names), line(["---"] * len(names)), *map(line, rows)])}
