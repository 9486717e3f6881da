"""Lookups as joins: first exact match, nearest below or above, membership in intervals."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.formula.values import wildcard

#: Rows of one range that rows are dealt out to by a key, about, and the most ranges there are.
RANGE_ROWS, RANGES = 500_000, 1000
#: Rows of a table that a lookup searches in memory, at most.
SMALL = 20_000


def dealt(df: DataFrame, key: str, rows: int = RANGE_ROWS) -> tuple[DataFrame, int]:
    """df with __range, which rises with a key, and the number of ranges; as many as its rows ask for, with
    bounds from a quantile sketch."""
    ranges = max(1, min(RANGES, -(-df.select(F.count(key)).first()[0] // rows)))
    found = df.agg(F.percentile_approx(key, [i / ranges for i in range(1, ranges)], 10 * RANGES)).first()[0] if ranges > 1 else []
    cuts = sorted(set(found))
    if not cuts:
        return df.withColumn("__range", F.lit(0)), 1
    kind = df.schema[key].dataType
    at = F.transform(F.array(F.array(*[F.lit(x).cast(kind) for x in cuts])), lambda c: F.size(F.filter(c, lambda x: x <= F.col(key))))[0]
    return df.withColumn("__range", F.when(F.col(key).isNull(), 0).otherwise(at)), len(cuts) + 1


def carried(ranges: DataFrame, n: int, value: str, how) -> DataFrame:
    """(__at, carried): for each of n ranges how(value) over all the ranges before it. A row for each range."""
    every = ranges.sparkSession.range(n).select(F.col("id").cast("int").alias("__at"))
    before = Window.partitionBy(F.lit(0)).orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    return every.join(ranges, F.col("__at") == F.col("__range"), "left").select("__at", how(value).over(before).alias("carried"))


def _fold(c: Column, text: bool) -> Column:
    return F.lower(c) if text else c


def _is_text(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def exact(left: DataFrame, key: str, right: DataFrame, right_key: str, value: str, order: str, out: str, last: bool = False, default=None, wild: bool = False) -> DataFrame:
    """left with out, the value of the first row of right (last: the last one) whose key is equal, texts
    without regard to case; out__err is #N/A where there is none, unless a default is given.

    right is reduced to a row for each key before the join, so its copies of a key never multiply rows. wild:
    texts with * ? or ~ fit keys as patterns do; there may be PATTERNS different ones."""
    if _is_text(left, key) != _is_text(right, right_key):
        found = right.limit(0)  # values of different kinds are never equal
    else:
        found = right
    pick = F.max_by if last else F.min_by
    folded = _fold(F.col(right_key), _is_text(right, right_key))
    firsts = found.filter(F.col(right_key).isNotNull()).groupBy(folded.alias("__key")).agg(pick(F.struct(F.col(value).alias("v")), F.col(order)).alias("__hit"))
    folded_key = _fold(F.col(key), _is_text(left, key))
    if wild and _is_text(left, key) and _is_text(right, right_key):
        firsts = firsts.filter(~F.col("__key").rlike(WILD)).unionByName(_fitting(left.select(folded_key.alias("__key")), found, right_key, value, order, pick))
    joined = left.join(firsts, folded_key == F.col("__key"), "left")
    hit = F.col("__hit").isNotNull()
    got = F.col("__hit")["v"] if default is None else F.when(hit, F.col("__hit")["v"]).otherwise(F.lit(default))
    error = F.lit(None).cast("string") if default is not None else F.when(~hit, F.lit("#N/A"))
    return joined.select(*[left[c] for c in left.columns], got.alias(out), error.alias(f"{out}__err"))


def as_of(left: DataFrame, key: str, right: DataFrame, right_key: str, values: list[str], out_prefix: str = "", upward: bool = False, range_rows: int = RANGE_ROWS, small: int = SMALL) -> DataFrame:
    """left with the values of the row of right that has the largest right_key up to key (upward: the
    smallest from key on), null where there is none. Of equal right keys one row must remain: the first.

    Up to SMALL rows of right are searched by halves in Arrow batches, and left is not shuffled. Beyond: the
    answer depends on the key alone, so left's keys are made distinct, dealt out by ranges together with
    right's, and sorted once: a key's answer is the last right row before it, in its range or carried on from
    the ranges before. Then left meets the answers by its key, where a frequent key can be split."""
    sign = -1 if upward else 1
    bands = right.select((F.col(right_key) * sign).cast("double").alias("__x"), F.struct(*[F.col(v).alias(f"v{i}") for i, v in enumerate(values)]).alias("__band")).filter("__x is not null").dropDuplicates(["__x"])
    # one more than may be: so many values of one column at most come to the driver
    lows = sorted(r[0] for r in bands.select("__x").limit(small + 1).collect())
    if len(lows) <= small:
        return _searched(left, (F.col(key) * sign).cast("double"), bands, np.array(lows, float), values, out_prefix)
    keys = left.select((F.col(key) * sign).cast("double").alias("__x")).filter("__x is not null").distinct()
    rows, n = dealt(keys.withColumn("__band", F.lit(None)).withColumn("__own", F.lit(1)).unionByName(bands.withColumn("__own", F.lit(0))), "__x", range_rows)
    inside = Window.partitionBy("__range").orderBy("__x", "__own").rowsBetween(Window.unboundedPreceding, 0)
    tops = rows.filter("__own = 0").groupBy("__range").agg(F.max_by("__band", "__x").alias("__top"))
    before = carried(tops, n, "__top", lambda v: F.last(v, ignorenulls=True))
    found = rows.withColumn("__hit", F.last("__band", ignorenulls=True).over(inside)).filter("__own = 1")
    found = found.join(before, F.col("__range") == F.col("__at")).select("__x", F.coalesce("__hit", "carried").alias("__hit"))
    joined = left.withColumn("__key", (F.col(key) * sign).cast("double")).join(found, F.col("__key") == F.col("__x"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("__hit")[f"v{i}"].alias(f"{out_prefix}{v}") for i, v in enumerate(values)])


#: Characters that make a text a pattern, and the number of different patterns that one lookup may have.
WILD, PATTERNS = r"[*?~]", 1000


def _fitting(keys: DataFrame, right: DataFrame, right_key: str, value: str, order: str, pick) -> DataFrame:
    """(__key, __hit) for each pattern among keys that some row of right fits. Every pattern is tried on every row,
    so their number is checked."""
    asked = [r[0] for r in keys.filter(F.col("__key").rlike(WILD)).distinct().limit(PATTERNS + 1).collect()]
    if len(asked) > PATTERNS:
        raise ValueError(f"a lookup by more than {PATTERNS} patterns")
    patterns = keys.sparkSession.createDataFrame([(k, "(?is)" + wildcard(k).pattern) for k in asked], "__key string, __pattern string")
    met = right.filter(F.col(right_key).isNotNull()).join(F.broadcast(patterns), F.rlike(F.col(right_key), F.col("__pattern")))
    return met.groupBy("__key").agg(pick(F.struct(F.col(value).alias("v")), F.col(order)).alias("__hit"))


def numbered(df: DataFrame, order: str, out: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """df with out, the number of each row from 1 on in an order, counted by ranges of it."""
    rows, n = dealt(df, order, range_rows)
    counts = carried(rows.groupBy("__range").agg(F.count("*").alias("rows")), n, "rows", F.sum)
    nth = F.row_number().over(Window.partitionBy("__range").orderBy(order))
    return rows.withColumn("__nth", nth).join(counts, F.col("__range") == F.col("__at")).select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__nth") + F.coalesce("carried", F.lit(0))).cast("long").alias(out))


def _searched(left: DataFrame, x: Column, bands: DataFrame, lows: np.ndarray, values: list[str], out_prefix: str) -> DataFrame:
    """as_of() with the keys of few bands, which are also broadcast: their number has been checked."""

    @F.pandas_udf("int")
    def place(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(lows, v.to_numpy(float), side="right"))

    numbered = bands.select(F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__x")).alias("__nth"), "__band")
    joined = left.withColumn("__place", F.when(x.isNotNull(), place(x))).join(F.broadcast(numbered), F.col("__place") == F.col("__nth"), "left")
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], *[F.col("__band")[f"v{i}"].alias(f"{out_prefix}{v}") for i, v in enumerate(values)])


def approximate_match(left: DataFrame, key: str, right: DataFrame, right_key: str, order: str, out: str, range_rows: int = RANGE_ROWS, small: int = SMALL) -> DataFrame:
    """left with out: the 1-based place in right, in its order, that an approximate MATCH finds; null for
    #N/A. It holds for unsorted tables too: the scan's stop for x is the first key above x, so the rows
    that matter are the running maxima, and the place is the last row before the stop, or the first equal.
    Places and maxima run over ranges of the order, and go on from one range to the next."""
    rows, n = dealt(right.filter(F.col(right_key).isNotNull()).select(F.col(right_key).cast("double").alias("k"), F.col(order).alias("__order")), "__order", range_rows)
    whole = rows.groupBy("__range").agg(F.count("*").alias("rows"), F.max("k").alias("top"))
    inside = Window.partitionBy("__range").orderBy("__order")
    own = rows.withColumns({"nth": F.row_number().over(inside), "peak": F.max("k").over(inside.rowsBetween(Window.unboundedPreceding, -1))})
    counts, tops = carried(whole, n, "rows", F.sum), carried(whole, n, "top", F.max)
    own = own.join(counts, F.col("__range") == F.col("__at")).withColumn("place", F.col("nth") + F.coalesce("carried", F.lit(0))).drop("__at", "carried")
    own = own.join(tops, F.col("__range") == F.col("__at")).withColumn("before", F.greatest("peak", "carried")).select("k", "place", "before")
    total = whole.agg(F.sum("rows")).first()[0] or 0
    # key x stops at the first peak above it; between two peaks the place is the one before the later peak
    peaks, m = dealt(own.filter("before is null or k > before").select("k", "place"), "place", range_rows)
    firsts = peaks.groupBy("__range").agg((-F.min("place")).alias("first"))
    after = carried(firsts.withColumn("__range", F.lit(m - 1) - F.col("__range")), m, "first", lambda v: F.last(v, ignorenulls=True)).withColumn("__at", F.lit(m - 1) - F.col("__at"))
    stops = peaks.withColumn("stop", F.lead("place").over(Window.partitionBy("__range").orderBy("place"))).join(after, F.col("__range") == F.col("__at"))
    stops = stops.withColumn("end", F.coalesce(F.col("stop") - 1, -F.col("carried") - 1, F.lit(total)))
    near = as_of(left, key, stops.select("k", "end"), "k", ["end"], "__", range_rows=range_rows, small=small)
    same = own.groupBy("k").agg(F.min("place").alias("__same"))
    joined = near.join(same, F.col(key).cast("double") == F.col("k"), "left")
    place = F.when((F.col("__same").isNotNull()) & (F.col("__same") <= F.col("__end")), F.col("__same")).otherwise(F.col("__end"))
    return joined.select(*[F.col(f"`{c}`") for c in left.columns], place.cast("double").alias(out))


def innermost(points: DataFrame, at: str, intervals: DataFrame, by: list[str], first: str = "first", last: str = "last", depth: str = "depth", key: str = "key") -> DataFrame:
    """points with key, that of the deepest interval around each, by document: an equi-join on the document
    and a range condition, reduced by an aggregate of one row for each point."""
    rows = points.withColumn("__id", F.monotonically_increasing_id())
    inner = intervals.select(*[F.col(b).alias(f"__{b}") for b in by], F.col(first).alias("__first"), F.col(last).alias("__last"), F.col(depth).alias("__depth"), F.col(key).alias("__key"))
    hit = F.col(at).between(F.col("__first"), F.col("__last"))
    for b in by:
        hit = hit & (F.col(b) == F.col(f"__{b}"))
    found = rows.join(inner, hit, "left")
    columns = [F.col(f"`{c}`") for c in points.columns]
    return found.groupBy("__id", *columns).agg(F.max_by("__key", F.struct("__depth", "__first")).alias(key)).drop("__id")
