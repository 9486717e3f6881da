"""Order statistics that hold at any size: ranks, k-th values, modes, running totals."""

from __future__ import annotations

import functools
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.lookup import RANGE_ROWS, carried, dealt


def running_counts(df: DataFrame, value: str, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(value, n, before): of each distinct value its rows and the rows of smaller ones, dealt out by ranges."""
    counts, ranges = dealt(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n")), value, range_rows)
    sums = carried(counts.groupBy("__range").agg(F.sum("n").alias("rows")), ranges, "rows", F.sum)
    inner = F.sum("n").over(Window.partitionBy("__range").orderBy(value)) - F.col("n")
    return counts.withColumn("__own", inner).join(sums, F.col("__range") == F.col("__at")).select(value, "n", (F.col("__own") + F.coalesce("carried", F.lit(0))).alias("before"))


def ranked(df: DataFrame, value: str, out: str, ascending: bool = False) -> DataFrame:
    """df with RANK of each value among all; ties share. Null values have none."""
    counts = running_counts(df, value)
    total = F.lit(0) if ascending else F.lit(df.select(F.count(value)).first()[0])
    rank = F.col("before") + 1 if ascending else total - F.col("before") - F.col("n") + 1
    ranks = counts.select(F.col(value).alias("__v"), rank.cast("double").alias(out))
    return df.join(ranks, F.col(value) == F.col("__v"), "left").drop("__v")


def at_places(df: DataFrame, value: str, places: list[int]) -> list:
    """The values at places from 1 on of a column in rising order; each place must be there."""
    counts = running_counts(df, value)
    hits = functools.reduce(lambda a, b: a | b, [(F.col("before") < k) & (F.col("before") + F.col("n") >= k) for k in places])
    rows = counts.filter(hits).select(value, "n", "before").collect()  # a row for each place at most
    return [next(r[0] for r in rows if r["before"] < k <= r["before"] + r["n"]) for k in places]


def kth(df: DataFrame, value: str, k: int, largest: bool = True, out: str = "kth") -> DataFrame:
    """LARGE or SMALL of a column by its distinct values' counts; #NUM! beyond its ends."""
    counts = running_counts(df, value)
    total = df.select(F.count(value)).first()[0]
    place = total - k + 1 if largest else k
    hit = counts.filter((F.col("before") < place) & (F.col("before") + F.col("n") >= place))
    got = hit.agg(F.max(value).cast("double").alias(out))
    return got.withColumn(f"{out}__err", F.when(F.col(out).isNull() | F.lit(k < 1), F.lit("#NUM!")))


def mode(df: DataFrame, value: str, order: str, out: str = "mode") -> DataFrame:
    """The most frequent number, of several the one seen first; #N/A if none recurs."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = counts.filter("n > 1").agg(F.max_by(value, F.struct("n", F.struct((-F.col("first")).alias("f")))).cast("double").alias(out))
    return best.withColumn(f"{out}__err", F.when(F.col(out).isNull(), F.lit("#N/A")))


def divisors(df: DataFrame, value: str, least: bool = False, out: str = "gcd") -> DataFrame:
    """GCD (least: LCM) of a column: each partition folds its own rows, one task the partitions' results.
    Negative numbers and results from 2^53 on are #NUM!."""
    fold, none = (math.lcm, 1) if least else (math.gcd, 0)

    def part(batches):
        acc, bad, n = none, False, 0
        for batch in batches:
            for x in batch.column(0).to_pylist():
                if x is not None and not bad:
                    n += 1
                    bad = x < 0 or x >= 2**53
                    acc = acc if bad else fold(acc, math.floor(x))
                    bad = bad or acc >= 2**53
        yield pa.RecordBatch.from_arrays([pa.array([None if bad else float(acc)], pa.float64()), pa.array([bad])], names=["v", "bad"])

    own = df.select(F.col(value).cast("double").alias("v")).mapInArrow(part, "v double, bad boolean")

    def whole(batches):
        rows = [(v, b) for batch in batches for v, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        acc = None if any(b for _, b in rows) else fold(*[int(v) for v, _ in rows], none)
        acc = None if acc is None or acc >= 2**53 else float(acc)
        yield pa.RecordBatch.from_arrays([pa.array([acc], pa.float64()), pa.array([None if acc is not None else "#NUM!"], pa.string())], names=[out, f"{out}__err"])

    return own.coalesce(1).mapInArrow(whole, f"{out} double, {out}__err string")
