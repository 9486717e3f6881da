"""Filling series: what a source of cells goes on to."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.formula import parser as p

#: Lists that fill on, in both languages; short names too.
LISTS = [
    "enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre".split(),
    "ene feb mar abr may jun jul ago sep oct nov dic".split(),
    "january february march april may june july august september october november december".split(),
    "jan feb mar apr may jun jul aug sep oct nov dec".split(),
    "lunes martes miércoles jueves viernes sábado domingo".split(),
    "lun mar mié jue vie sáb dom".split(),
    "monday tuesday wednesday thursday friday saturday sunday".split(),
    "mon tue wed thu fri sat sun".split(),
]


def trend(values: list[float]) -> tuple[float, float]:
    """Intercept and slope of the least squares line over places 0, 1, ..."""
    n, mean = len(values), sum(values) / len(values)
    centre = (n - 1) / 2
    below = sum((i - centre) ** 2 for i in range(n))
    slope = sum((i - centre) * (v - mean) for i, v in enumerate(values)) / below if below else 0.0
    return mean - slope * centre, slope


def _cased(like: str, word: str) -> str:
    return word.upper() if like.isupper() and len(like) > 1 else word.capitalize() if like[:1].isupper() else word


def _step(numbers: list[int]) -> int | None:
    steps = {b - a for a, b in zip(numbers, numbers[1:], strict=False)}
    return 1 if not steps else steps.pop() if len(steps) == 1 else None


def series(source: list, count: int, dates: bool = False) -> list:
    """The next count values after source: formulas (texts that start with =) are copied with their
    references moved on, two numbers or more follow their trend, a date goes on by days, texts of a known
    list or with a counter at their end count on, and anything else repeats."""
    n = len(source)
    if all(isinstance(v, str) and v.startswith("=") for v in source):
        return ["=" + p.show(p.shifted(p.parse(source[i % n]), (i // n + 1) * n, 0)) for i in range(count)]
    if all(isinstance(v, int | float) and not isinstance(v, bool) for v in source) and (n > 1 or dates):
        a, b = trend(list(map(float, source))) if n > 1 else (float(source[0]), 1.0)
        return [round((a + b * (n + i)) * 1e10) / 1e10 for i in range(count)]
    if all(isinstance(v, str) for v in source):
        for names in LISTS:
            at = [names.index(v.lower()) if v.lower() in names else None for v in source]
            if None not in at and (by := _step([a + len(names) * sum(at[j] < at[j - 1] for j in range(1, i + 1)) for i, a in enumerate(at)])) is not None:
                return [_cased(source[0], names[(at[-1] + by * (i + 1)) % len(names)]) for i in range(count)]
        parts = [re.fullmatch(r"(.*?)(\d{1,15})", v, re.DOTALL) for v in source]
        if all(parts) and len({m[1] for m in parts}) == 1 and (by := _step([int(m[2]) for m in parts])) is not None:
            width = len(parts[-1][2]) if parts[-1][2].startswith("0") or parts[0][2].startswith("0") else 0
            return [parts[0][1] + str(max(0, int(parts[-1][2]) + by * (i + 1))).zfill(width) for i in range(count)]
    return [source[i % n] for i in range(count)]


#: Cells that one fill makes at most.
MOST_CELLS = 200_000


def _lane(source: list[dict], steps: list[int], down: bool, dates: bool) -> list[dict]:
    """What a lane of cells goes on to, that many steps away from its first cell (negative: ahead of it)."""
    n, out = len(source), []
    values = [c["n"] if c["k"] == "n" else c["s"] if c["k"] == "s" else None for c in source]
    back = steps and steps[0] < 0
    plain = all(c["formula"] is None for c in source) and None not in values
    grown = series([v if not isinstance(v, str) or not v.startswith("=") else " " + v for v in (values[::-1] if back else values)], len(steps), dates) if plain and n else None
    for i, step in enumerate(sorted(steps, key=abs)):
        like = source[step % n]
        made = dict(like)
        if like["formula"] is not None:
            by = step - step % n
            made["formula"] = p.show(p.shifted(p.parse(like["formula"]), by if down else 0, 0 if down else by))
        elif grown is not None and like["k"] in ("n", "s"):
            v = grown[i]
            v = v[1:] if isinstance(v, str) and v.startswith(" =") else v
            if isinstance(v, str) == (like["k"] == "s"):
                made["s" if like["k"] == "s" else "n"] = v
        out.append(made | {"step": step})
    return out


def filled_cells(cells: DataFrame, workbook: str, sheet: int, source: tuple[int, int, int, int], target: tuple[int, int, int, int], merges: DataFrame | None = None, dates: bool = False) -> DataFrame:
    """cells after an area (r1, c1, r2, c2) was filled on into a target that holds it: each column (or row) goes on by
    its own series, up or left as well. Refused: a target that holds not all of it, or grows along both axes; merged
    areas in the new part; more than MOST_CELLS new cells."""
    (r1, c1, r2, c2), (a1, b1, a2, b2) = source, target
    down = (b1, b2) == (c1, c2)
    if not (a1 <= r1 <= r2 <= a2 and b1 <= c1 <= c2 <= b2) or not (down or (a1, a2) == (r1, r2)):
        raise ValueError("the target must hold the source and grow along one axis")
    if (a2 - a1 + 1) * (b2 - b1 + 1) - (r2 - r1 + 1) * (c2 - c1 + 1) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells to fill")
    own = (F.col("workbook_id") == workbook) & (F.col("sheet") == sheet)
    if merges is not None:
        meets = (F.col("r1") <= a2) & (F.col("r2") >= a1) & (F.col("c1") <= b2) & (F.col("c2") >= b1)
        if not merges.filter(own & meets).isEmpty():
            raise ValueError("a merged area is in the way")
    inside = lambda box: F.col("row").between(box[0], box[2]) & F.col("col").between(box[1], box[3])
    empty = dict.fromkeys(cells.columns) | {"workbook_id": workbook, "sheet": sheet}
    have = {(r["row"], r["col"]): r.asDict() for r in cells.filter(own & inside(source)).collect()}
    first, last, lo, hi = (r1, r2, a1, a2) if down else (c1, c2, b1, b2)
    new = []
    for line in range(c1, c2 + 1) if down else range(r1, r2 + 1):
        place = lambda i, line=line: (i, line) if down else (line, i)
        lane = [have.get(place(i), empty) for i in range(first, last + 1)]
        for steps in ([i - first for i in range(last + 1, hi + 1)], [i - first for i in range(first - 1, lo - 1, -1)]):
            for made in _lane(lane, steps, down, dates) if steps else ():
                at = place(first + made.pop("step"))
                if made["k"] is not None or made["formula"] is not None:
                    new.append(made | {"row": at[0], "col": at[1]})
    kept = cells.filter(~(own & inside(target) & ~inside(source)))
    rows = cells.sparkSession.createDataFrame([[r[c] for c in cells.columns] for r in new], cells.schema)
    return kept.unionByName(rows)


def filled_trend(df: DataFrame, by: list[str], place: str, value: str, count: int) -> DataFrame:
    """For each group of rows: count values on along the least squares line over place, as rows
    (by, place, value). The line is an aggregate; the new places are generated."""
    line = df.groupBy(*by).agg(F.regr_slope(value, place).alias("__b"), F.regr_intercept(value, place).alias("__a"), F.max(place).alias("__last"))
    out = line.withColumn(place, F.explode(F.sequence(F.col("__last") + 1, F.col("__last") + count)))
    return out.select(*by, place, (F.round((F.col("__a") + F.col("__b") * F.col(place)) * 1e10) / 1e10).alias(value))


def filled_counter(df: DataFrame, text: str, count: int) -> DataFrame:
    """df with a row for each of the next count texts of a column that ends in a counter."""
    prefix, digits = F.regexp_extract(text, r"^(.*?)(\d{1,15})$", 1), F.regexp_extract(text, r"^(.*?)(\d{1,15})$", 2)
    width = F.when(digits.startswith("0"), F.length(digits)).otherwise(F.lit(0))
    out = df.filter(F.col(text).rlike(r"\d$")).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(count))))
    n = (digits.cast("long") + F.col("step")).cast("string")
    return out.withColumn("filled", F.concat(prefix, F.lpad(n, F.greatest(width, F.length(n)), F.lit("0"))))
