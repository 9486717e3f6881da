r"""Mixing sources to target weights by a time-varying curriculum. DataFrame functions only.

A document's size is its number of words. Sources, in order of code points with null last, weigh 5, 2,
1, 5, 2, 1, ... and share one and a half times all words by weight; no source gets more than twice its
own words, and what is over is shared again by weight (the water level at which none is above).

Each source has an endless stream: its documents in a fixed pseudo-random order, over and over. The mix
takes the words of the stream up to the target, so a source meets its target to the word, no document
comes more than twice, and one document of a source may be due in part. Where documents are put out,
they stay whole: that one comes once more if at least half of it is due. Weights change over training:
source s is demanded at the rate 1 + a(2t - 1) at time t of [0, 1], with a from SLANT, so heavy sources
come rather early and light ones late. The cumulative demand t + a(t^2 - t) is inverted in closed form
at each copy's place in its source's stream; that gives the copy's position in training, by which the
result is range-sorted.

Running sums over a source go by buckets of the order, so a hot source is dealt to many tasks.
Null, empty and word-less texts have size 0 and are never taken; very long ones count whole, and one may
be due in part. Repeated rows are taken each by itself: they tie in the order, any of them comes first.
An empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import shielded, table, written

WEIGHTS = (5, 2, 1)
#: How the demand of a source leans over time, by the place of its weight.
SLANT = (-0.5, 0.0, 0.5)
SHARE, MOST = 1.5, 2
#: Documents of a source in one bucket of its order, about.
BUCKET_ROWS = 2000


def _key():
    """Orders a source's documents; differs where ids or texts do."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, key) of each row."""
    words = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return docs.select("doc_id", "source", words.cast("long").alias("size"), _key().alias("key"))


def _nth(values: tuple, place) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.pmod(place - 1, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, target, slant) for each source."""
    every = Window.partitionBy(F.lit(0))  # a row for each source
    out = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    out = out.withColumn("place", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())))
    out = out.withColumn("w", _nth(WEIGHTS, F.col("place"))).withColumn("slant", _nth(SLANT, F.col("place")))
    out = out.withColumn("bound", F.col("source_size") * MOST / F.col("w"))
    by_bound = every.orderBy("bound", "place")
    below = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_bound.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("level", (F.sum("source_size").over(every) * SHARE - F.coalesce(F.sum("source_size").over(below), F.lit(0)) * MOST) / F.sum("w").over(onward))
    # in order of bounds, the first source that the level leaves below its bound fixes the level
    out = out.withColumn("at", F.min(F.when(F.col("level") <= F.col("bound"), F.struct("bound", "place", "level"))).over(every)["level"])
    target = F.least(F.col("source_size") * F.lit(float(MOST)), F.col("at") * F.col("w"))
    return out.select("source", "source_size", "n", target.alias("target"), "slant")


def mixed(sizes: DataFrame) -> DataFrame:
    """sizes with source_size, target, taken, position (of its first word in training) and positions (of
    each whole copy)."""
    goals = written(targets(sizes), "targets")
    total = goals.agg(F.sum("target")).first()[0] or 0.0
    rows = sizes.join(goals, sizes["source"].eqNullSafe(goals["source"]), "left").drop(goals["source"])
    part = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32 * F.ceil(F.col("n") / BUCKET_ROWS)).cast("int")
    rows = rows.withColumn("part", part)
    parts = rows.groupBy("source", "part").agg(F.sum("size").alias("words"))
    parts = parts.withColumn("before", F.sum("words").over(Window.partitionBy("source").orderBy("part")) - F.col("words")).select(F.col("source").alias("of"), F.col("part").alias("in"), "before")
    inner = Window.partitionBy("source", "part").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("own", F.sum("size").over(inner) - F.col("size"))
    rows = rows.join(parts, F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("in"))).withColumn("c", F.col("own") + F.col("before"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("passes", passes.cast("long"))
    due = F.floor(F.col("target") - F.col("passes") * F.col("source_size")) - F.col("c")
    rows = rows.withColumn("due", F.greatest(F.lit(0), F.least(due, F.col("size"))).cast("long"))
    copies = F.when(F.col("size") > 0, F.col("passes") + ((F.col("due") > 0) & (F.col("due") * 2 >= F.col("size"))).cast("long")).otherwise(0)
    at = F.filter(F.array(*[F.lit(k) for k in range(MOST)]), lambda k: k < F.col("copies"))
    rows = rows.withColumn("copies", copies).withColumn("taken", F.col("passes") * F.col("size") + F.col("due"))
    rows = rows.withColumn("position", F.when(F.col("taken") > 0, _time(F.col("c") / F.col("target"), F.col("slant")) * F.lit(total)))
    rows = rows.withColumn("positions", F.transform(at, lambda k: _time((F.col("c") + k * F.col("source_size")) / F.col("target"), F.col("slant")) * F.lit(total)))
    return rows.select("doc_id", "source", "size", "key", "source_size", "target", "taken", "position", "positions")


def _time(f, a):
    """Where t + a(t^2 - t) is f."""
    return F.when(a == 0, f).otherwise((F.sqrt((F.lit(1.0) - a) * (F.lit(1.0) - a) + a * F.lit(4.0) * f) - (F.lit(1.0) - a)) / (a * F.lit(2.0)))


@shielded
def mixture(docs: DataFrame) -> DataFrame:
    """The documents as training meets them: each as often as the mix takes it, sorted by position."""
    plan = mixed(written(sized(docs), "sizes"))
    nth = F.row_number().over(Window.partitionBy("__key", "__source").orderBy("__key"))  # tells repeated rows apart
    source = F.coalesce(F.concat(F.lit("s"), "source"), F.lit(""))
    plan = plan.select(F.col("key").alias("__key"), source.alias("__source"), F.col("positions").alias("__at")).withColumn("__nth", nth)
    marked = docs.withColumn("__key", _key()).withColumn("__source", source).withColumn("__nth", nth)
    out = marked.join(plan, ["__key", "__source", "__nth"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.explode("__at").alias("__at")).orderBy("__at").drop("__at")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(written(sized(table(spark, sf_dir, "documents")), "sizes"))
    return out.select("doc_id", "size", "source_size", "target", "taken", "position").orderBy("position", F.xxhash64("doc_id"))  # the hash deals out those never taken


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(concat(doc_id, ':', coalesce(text, ''))) AS key FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS w, [-0.5, 0.0, 0.5][(place - 1) % 3 + 1]::DOUBLE AS slant, source_size * 2 / [5, 2, 1][(place - 1) % 3 + 1] AS bound FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(source_size) OVER (ORDER BY bound, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2)
    / sum(w) OVER (ORDER BY bound, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, slant, least(source_size * 2.0::DOUBLE, (SELECT level FROM l WHERE level <= bound ORDER BY bound, place LIMIT 1) * w) AS target FROM l
), c AS (
  SELECT d.*, source_size, slant, target, sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS c,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), f AS (SELECT *, CAST(greatest(0, least(floor(target - passes * source_size) - c, size)) AS BIGINT) AS due, c / target AS f FROM c)
SELECT doc_id, size, source_size, target, CAST(passes * size + due AS BIGINT) AS taken,
  CASE WHEN passes * size + due > 0 THEN (CASE WHEN slant = 0 THEN f ELSE (sqrt((1.0::DOUBLE - slant) * (1.0::DOUBLE - slant) + slant * 4.0::DOUBLE * f) - (1.0::DOUBLE - slant)) / (slant * 2.0::DOUBLE) END) * (SELECT sum(target) FROM t) END AS position
FROM f
"""
