"""SimHash near-duplicates: tiled exact comparison of fingerprints.

Fingerprints are made in Arrow batches, then only distinct ones go on. Of B blocks of their bits, two
fingerprints at most three bits apart agree on B - 3 at least, so the distinct fingerprints are dealt
out by every choice of B - 3 blocks and those blocks' value; within each group numpy compares tiles by
exclusive-or and bit counts, and skips pairs of tiles whose population counts differ by more than the
radius. Any B finds every link; the more fingerprints there are, the more blocks it takes for groups
to stay small: 4 choices of 16 bits, 10 of some 25 or 20 of some 32, whichever costs least for their
number. A group too large for one task is split by salt and its parts meet pairwise. Each task returns
a spanning forest of its links, never all pairs; the forests' components are then found by min-label
rounds over tables.

Null and empty texts have fingerprint zero, linked like any other; long texts are hashed whole. Texts of
one or two words are one shingle. Repeated rows share a fingerprint, so ties need no rule. Rows whose
doc_id is null form part of their group, whose id is the smallest doc_id that is not null (null if there
is none). An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import chunked, shielded, small_batches, table, written

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Numbers of blocks to choose from, and comparisons that cost as much as a row that is shuffled.
BLOCKS, COMPARED = (4, 5, 6), 200
TILE = 1024
#: Fingerprints of one group that a single task compares; larger groups are split.
GROUP_ROWS = 20_000
#: Rows of one call, about, that compares many small groups.
LOT_ROWS = 4000
_UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes | None) -> list[int]:
    words = (text or b"").translate(_UPPER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: len(words) - SHINGLE].tolist()]
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]


def fingerprints(texts: list[bytes | None]) -> np.ndarray:
    """One 64-bit fingerprint for each text."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in chunked(texts, 1 << 20):
        parts = [np.array(shingle_hashes(t), np.uint64) for t in texts[a:b]]
        counts = np.array([len(p) for p in parts])
        sums = np.zeros((b - a, 64), np.int64)
        for at in range(b - a):  # big-endian, so that column 0 is the highest bit
            for lo in range(0, counts[at], 1 << 17):
                own = parts[at][lo : lo + (1 << 17)]
                sums[at] += np.unpackbits(own.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        bits = sums * 2 > counts[:, None]
        out[a:b] = np.packbits(bits, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def _fingerprint_batches(text_at: int):
    def run(batches):
        for batch in batches:
            prints = fingerprints(batch.column(text_at).cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(prints.view(np.int64))],
                schema=pa.schema([*[batch.schema.field(i) for i in range(batch.num_columns - 1)], ("__fp", pa.int64())]),
            )

    return run


def fingerprinted(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with __fp, the fingerprint as a signed long."""
    small_batches(spark)
    out = docs.withColumn("__fp", F.lit(0).cast("long"))
    return out.mapInArrow(_fingerprint_batches(docs.columns.index("text")), out.schema)


def forest(prints: np.ndarray, side: np.ndarray | None = None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: (fingerprint, its root) where they
    differ. side: 0 or 1 for each; only links between sides are looked for."""
    weight = np.bitwise_count(prints)
    order = np.argsort(weight, kind="stable")
    prints, weight = prints[order], weight[order].astype(np.int64)
    side = None if side is None else side[order]
    parent = np.arange(len(prints))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for a in range(0, len(prints), tile):
        own, last = prints[a : a + tile], weight[min(a + tile, len(prints)) - 1]
        for b in range(a, len(prints), tile):
            if weight[b] - last > radius:
                break  # later tiles have more bits still
            near = np.bitwise_count(own[:, None] ^ prints[None, b : b + tile]) <= radius
            if side is not None:
                near &= side[a : a + tile, None] != side[None, b : b + tile]
            if a == b:
                near = np.triu(near, 1)
            for i, j in zip(*map(np.ndarray.tolist, np.nonzero(near)), strict=True):
                i, j = root(a + i), root(b + j)
                if i != j:
                    parent[max(i, j)] = min(i, j)
    roots = np.array([root(i) for i in range(len(parent))], np.int64)
    at = np.flatnonzero(roots != np.arange(len(parent)))
    return prints[at], prints[roots[at]]


def _links(table_: pa.Table) -> pa.Table:
    """The forests of all groups of one lot; a group's rows share value."""
    value, side, prints = (np.array(table_.column(c).to_numpy()) for c in ("value", "side", "fp"))
    order = np.argsort(value, kind="stable")
    value, side, prints = value[order], side[order], prints[order].view(np.uint64)
    edges = np.concatenate([[0], np.flatnonzero(value[1:] != value[:-1]) + 1, [len(value)]])
    xs, ys = [], []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = side[a:b]
        x, y = forest(prints[a:b], own if own.any() and not own.all() else None)
        if len(x):
            xs.append(x)
            ys.append(y)
    both = [np.concatenate(v).view(np.int64) if v else np.empty(0, np.int64) for v in (xs, ys)]
    return pa.table({"x": pa.array(both[0]), "y": pa.array(both[1])})


def choices(blocks: int) -> list[int]:
    """Masks of the bits of every choice of all but RADIUS blocks."""
    edges = [64 * k // blocks for k in range(blocks + 1)]
    own = [(1 << b) - (1 << a) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(c) for c in itertools.combinations(own, blocks - RADIUS)]


def blocks_for(n: int) -> int:
    """The number of blocks that costs least for n fingerprints: rows shuffled and comparisons."""
    cost = lambda b: sum(n + n * n / 2 / COMPARED / 2.0 ** m.bit_count() for m in choices(b))
    return min(BLOCKS, key=cost)


def links(prints: DataFrame, n: int, group_rows: int = GROUP_ROWS, blocks: int | None = None) -> DataFrame:
    """Links (x, y) between n distinct fingerprints (fp) that join all that are within the radius."""
    masks = [m - (1 << 64) if m >> 63 else m for m in choices(blocks or blocks_for(n))]
    keys = F.array(*[F.struct(F.lit(k).alias("band"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("value")) for k, m in enumerate(masks)])
    dealt = prints.select("fp", F.explode(keys).alias("b")).select("fp", "b.band", "b.value")
    sizes = dealt.groupBy("band", "value").agg(F.count("*").alias("n")).filter("n > 1").select("band", "value", F.ceil(F.col("n") / group_rows).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = dealt.join(sizes, ["band", "value"]).withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("fp", "band", "value", F.least("own", "with").alias("a"), F.greatest("own", "with").alias("b"), (F.col("own") > F.col("with")).cast("int").alias("side"))
    # many values share a task's call: most groups are of a few rows
    lot = F.pmod(F.xxhash64("value"), F.lit(math.ceil((n + 1) / LOT_ROWS)))
    return met.withColumn("lot", lot).groupBy("band", "lot", "a", "b").applyInArrow(_links, "x long, y long")


def components(pairs: DataFrame) -> DataFrame:
    """(fp, root) for each fingerprint in pairs (x, y); root is the smallest of its component.

    Large and small stars in turn: every round links each node to the least of its neighbours, which
    halves paths. A hub has one row for each neighbour; the least of them is pre-aggregated before the
    shuffle and written, so that the adaptive planner can split the hub's rows where they meet it."""
    edges = written(pairs.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).filter("x <> y").distinct(), "links")
    state = _state(edges)
    while True:
        both = edges.union(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = both.join(least, "x").filter("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).filter("x <> y").distinct()
        large = written(large, "large-star")
        low = written(large.groupBy("x").agg(F.min("y").alias("m")), "least")
        small = large.join(low, "x")
        small = small.select(F.col("y").alias("x"), F.col("m").alias("y")).union(small.select("x", F.col("m").alias("y"))).filter("x <> y").distinct()
        edges = written(small, "small-star")
        before, state = state, _state(edges)
        if before == state:
            break
    roots = edges.select(F.col("y").alias("fp"), F.col("y").alias("root")).distinct()
    return edges.select(F.col("x").alias("fp"), F.col("y").alias("root")).union(roots)


def _state(edges: DataFrame) -> tuple:
    """Rows and a checksum of a table of links; equal when nothing has changed."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("x", "y").cast("decimal(38,0)"))).first())


def grouped(spark: SparkSession, rows: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """For rows (doc_id, __fp): each distinct __fp with __group, the smallest doc_id reachable."""
    prints = written(rows.groupBy(F.col("__fp").alias("fp")).agg(F.min("doc_id").alias("least")), "prints")
    root_of = components(links(prints, prints.count(), group_rows))
    labelled = prints.join(root_of, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = labelled.groupBy("root").agg(F.min("least").alias("__group"))
    return labelled.join(least, "root").select(F.col("fp").alias("__fp"), "__group")


def with_groups(spark: SparkSession, docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, __fp, __group) for each row of docs."""
    slim = written(fingerprinted(spark, docs.select("doc_id", "text")).select("doc_id", "__fp"), "fingerprints")
    return slim.join(grouped(spark, slim, group_rows), "__fp", "left").select("doc_id", "__fp", "__group")


@shielded
def deduplicated(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One document of each group: that with the smallest doc_id, or of rows that repeat it the first by
    text. Where a group has no doc_id at all, the first of each text."""
    same = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("__same")  # stands in for a missing id
    slim = written(fingerprinted(spark, docs.select("doc_id", "text")).select("doc_id", "__fp", same), "fingerprints")
    groups = grouped(spark, slim)
    keep = slim.join(groups, "__fp").filter(F.col("doc_id").eqNullSafe(F.col("__group"))).select(F.col("doc_id").alias("__keep"), F.col("__same").alias("__keep_same")).distinct()
    marked = docs.withColumn("__same", same)
    kept = marked.join(keep, F.col("doc_id").eqNullSafe(F.col("__keep")) & F.col("__same").eqNullSafe(F.col("__keep_same")), "left_semi")
    first = Window.partitionBy("doc_id", "__same").orderBy(F.col("text").asc_nulls_first())
    return kept.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1").drop("__nth", "__same")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_groups(spark, table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__group").alias("component_id"))
