"""Benchmark decontamination by suffix arrays of the training texts.

Each chunk of training words becomes a shard with a suffix array over the words that can take part
in a match. Every benchmark suffix that holds a whole window is binary-searched in every shard, word by
word up to the window length, which yields all the places of every window. Matches are then extended to
their longest: from the first of each run of places, and from all of a run's where that match ends before
the run does, the longest verbatim match with any benchmark text is found in the block's own suffix array.

The benchmark is the query set, read in blocks of bounded size. A benchmark of one block is broadcast, and
documents are judged in a single pass without a shuffle. Of a larger one, a block at a time is broadcast,
searched, its hits written by document, and the block dropped before the next one is made; the blocks'
hits are united at the end. At no time does an executor hold more than one block. Contaminated documents
are those with a hit on at least a twentieth of their words.

Null, empty or word-less texts have no words and are clean; very long texts are a shard of their own.
Repeated rows are judged alike, each by itself. Items whose text has no words never occur. Items that
share an id count once; an item without an id makes words hit, but there is no id to count or list. Of
several longest matches the first in the document is reported. Empty tables give empty or clean results.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.llm.common import chunked, shielded, small_batches, table, written

WINDOW = 13
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 4 << 20

_KEEP = b"0123456789abcdefghijklmnopqrstuvwxyz"
_TABLE = bytes(c if c in _KEEP or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of digits, letters and whatever is not ASCII."""
    return (text or b"").translate(_TABLE).split()


def suffix_order(values: np.ndarray) -> np.ndarray:
    """The suffix array of a sequence, by doubling the length that ranks go by."""
    n, k = len(values), 1
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while n and rank[order[-1]] < n - 1:
        key = rank * (n + 1) + np.append(rank[k:] + 1, np.zeros(min(k, n), np.int64))
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.diff(key[order], prepend=key[order[0]]) != 0)
        k *= 2
    return order


class Sums:
    """Hashes of all stretches of a sequence: sums of its scattered values times powers of an odd base."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, values: np.ndarray):
        x = values.astype(np.int64).view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(len(x), self.BASE)), dtype=np.uint64)
        self.sums = np.append(np.uint64(0), np.cumsum((x ^ (x >> np.uint64(29))) * self.powers[:-1], dtype=np.uint64))

    def common(self, at: np.ndarray, other: Sums, there: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many values are the same from the places at on, and there in the other, at most most."""
        lo, hi = np.zeros(len(at), np.int64), most.astype(np.int64)
        while np.any(lo < hi):
            mid = (lo + hi + 1) >> 1
            same = (self.sums[at + mid] - self.sums[at]) * other.powers[there] == (other.sums[there + mid] - other.sums[there]) * self.powers[at]
            lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        return lo


class Block:
    """Benchmark suffixes of one block, distinct and in fixed width, with the items behind each; and the
    block's texts in a row with their suffix array."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        rows: dict[tuple[int, ...], set[str]] = {}
        pairs = set()
        stream: list[np.ndarray] = []
        self.names, self.first, at = [], [], 0
        for item, text in items:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            if ids:
                self.names.append(item)
                self.first.append(at)
                at += len(ids) + 1
                stream.append(np.array([*ids, -len(self.names)], np.int64))  # no two texts end alike
            pairs.update(zip(ids, ids[1:], strict=False))
            for k in range(max(1, len(ids) - window + 1) if ids else 0):
                rows.setdefault(tuple(ids[k : k + window]), set()).update([] if item is None else [item])
        self.stream = np.concatenate(stream) if stream else np.empty(0, np.int64)
        self.order = suffix_order(self.stream)
        self.items = [sorted(x) for x in rows.values()]
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.words = np.zeros((len(rows), window), np.int32)
        for i, r in enumerate(rows):
            self.words[i, : len(r)] = r
        self.pairs = np.array(sorted(a * (len(self.vocab) + 1) + b for a, b in pairs), np.int64)

    def suffix_array(self, ids: np.ndarray) -> np.ndarray:
        """Suffixes of a shard, sorted by their first words. Those that cannot hold the shortest
        window, as some pair of adjacent words is in no benchmark text, are left out."""
        least, n = int(self.lengths.min()), len(ids)
        known = ids > 0
        if least > 1 and len(self.pairs):
            code = ids[:-1].astype(np.int64) * (len(self.vocab) + 1) + ids[1:]
            at = np.searchsorted(self.pairs, code)
            at[at == len(self.pairs)] = 0
            good = (self.pairs[at] == code) & known[:-1] & known[1:]
            ends = np.where(good, n, np.arange(n - 1))
            ends = np.minimum.accumulate(ends[::-1])[::-1]  # where the run of good pairs stops
            ends[ends == n] = n - 1
            at = np.flatnonzero(ends - np.arange(n - 1) + 1 >= least)
        else:
            at = np.flatnonzero(known)
        if not len(at):
            return at
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        return at[np.lexsort([padded[at + d] for d in reversed(range(self.window))])]

    def search(self, ids: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each benchmark suffix: the range of the suffix array that starts with its whole window
        (empty if none), and the number of words of its longest match."""
        m = len(self.words)
        lo, hi, longest = np.zeros(m, np.int64), np.full(m, len(suffixes), np.int64), np.zeros(m, np.int64)
        padded = np.concatenate([ids, np.zeros(self.window, ids.dtype)])
        for d in range(self.window):
            on = np.flatnonzero((self.lengths > d) & (hi > lo))
            if not len(on):
                break
            column, want = padded[suffixes + d], self.words[on, d]
            left = _bisect(column, lo[on], hi[on], want, False)
            right = _bisect(column, left, hi[on], want, True)
            lo[on], hi[on] = left, right
            longest[on] += right > left
        return lo, hi, longest

    def hits(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, set[str]]]:
        """Which words of a shard lie in an occurrence, which begin one; by document of the shard, the items
        found (none of them if they have no id)."""
        found: dict[int, set[str]] = {}
        hit, begins = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
        if not len(self.words) or not len(ids):
            return hit, begins, found
        suffixes = self.suffix_array(ids)
        if not len(suffixes):
            return hit, begins, found
        lo, hi, longest = self.search(ids, suffixes)
        whole = np.flatnonzero((hi > lo) & (longest == self.lengths))
        edge = np.zeros(len(ids) + 1, np.int64)
        for w in whole:
            at = suffixes[lo[w] : hi[w]]
            begins[at] = True
            np.add.at(edge, at, 1)
            np.add.at(edge, at + self.lengths[w], -1)
            for doc in np.unique(np.searchsorted(starts, at, side="right") - 1):
                found.setdefault(int(doc), set()).update(self.items[w])
        return np.cumsum(edge)[:-1] > 0, begins, found

    def longest(self, ids: np.ndarray, at: np.ndarray, own: Sums) -> tuple[np.ndarray, np.ndarray]:
        """For the places at of a shard the length of the longest verbatim match that begins there, and its
        place in the block: the suffixes next to the place's own one, were it in the block's order."""
        if not hasattr(self, "sums"):
            self.sums = Sums(self.stream)
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.order), np.int64)
        size, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        while len(on := np.flatnonzero(lo < hi)):
            mid = (lo[on] + hi[on]) >> 1
            here, there = at[on], self.order[mid]
            same = own.common(here, self.sums, there, np.minimum(len(ids) - here, len(self.stream) - there) - 1)
            better = same > size[on]
            size[on] = np.where(better, same, size[on])
            place[on] = np.where(better, there, place[on])
            before = self.stream[there + same] < ids[here + same]
            lo[on] = np.where(before, mid + 1, lo[on])
            hi[on] = np.where(before, hi[on], mid)
        return size, place

    def extended(self, ids: np.ndarray, starts: np.ndarray, begins: np.ndarray) -> dict[int, tuple[int, int, str | None, int]]:
        """By document of a shard with hits: the words of its longest match, the first one's number in the
        document, the item and the first one's number in it."""
        at = np.flatnonzero(begins)
        if not len(at):
            return {}
        own = Sums(ids)
        new = np.diff(at, prepend=-2) != 1
        run = np.cumsum(new) - 1
        last = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)]
        size, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        size[new], place[new] = self.longest(ids, at[new], own)
        # a match that begins later in a run is longer only if the first one ends before the run does
        more = ~new & ((at[new] + size[new] < last + self.window)[run])
        size[more], place[more] = self.longest(ids, at[more], own)
        doc = np.searchsorted(starts, at, side="right") - 1
        order = np.lexsort([at, -size, doc])
        out = {}
        for k in order[np.diff(doc[order], prepend=-1) != 0].tolist():
            item = int(np.searchsorted(self.first, place[k], side="right")) - 1
            out[int(doc[k])] = int(size[k]), int(at[k] - starts[doc[k]]), self.names[item], int(place[k]) - self.first[item]
        return out


def _bisect(column: np.ndarray, lo: np.ndarray, hi: np.ndarray, want: np.ndarray, after: bool) -> np.ndarray:
    lo, hi = lo.copy(), hi.copy()
    while len(on := np.flatnonzero(lo < hi)):
        mid = (lo[on] + hi[on]) >> 1
        go = column[mid] <= want[on] if after else column[mid] < want[on]
        lo[on] = np.where(go, mid + 1, lo[on])
        hi[on] = np.where(go, hi[on], mid)
    return lo


def blocks_of(benchmark: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[list[tuple[str | None, bytes | None]]]:
    """The benchmark, a bounded block at a time, by way of the driver."""
    block, size = [], 0
    for row in benchmark.select(F.col("item_id").cast("string"), "text").toLocalIterator():
        text = None if row[1] is None else row[1].encode()
        block.append((row[0], text))
        size += len(text or b"") + 64
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


_MATCH = T.StructType([T.StructField("words", T.LongType()), T.StructField("at", T.LongType()), T.StructField("item", T.StringType()), T.StructField("item_at", T.LongType())])
_FOUND = [T.StructField("__n", T.LongType()), T.StructField("__spans", T.ArrayType(T.LongType())), T.StructField("__items", T.ArrayType(T.StringType())), T.StructField("__match", _MATCH)]
_ARROW = [("__n", pa.int64()), ("__spans", pa.list_(pa.int64())), ("__items", pa.list_(pa.string())), ("__match", pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())]))]


def _pass(docs: DataFrame, handle, only_hits: bool = False) -> DataFrame:
    """One block against all documents: their columns with what was found (only_hits: of those with hits)."""
    text_at = docs.columns.index("text")

    def run(batches):
        block: Block = handle.value
        for batch in batches:
            texts = batch.column(text_at).cast(pa.binary()).to_pylist()
            counts, spans, items, matches = [], [], [], []
            for a, b in chunked(texts):
                parts, starts, at = [], [], 0
                for t in texts[a:b]:
                    words = words_of(t)
                    starts.append(at)
                    counts.append(len(words))
                    parts.append(np.fromiter(map(block.vocab.get, words, [0] * len(words)), np.int32, len(words)))
                    parts.append(np.zeros(1, np.int32))  # ends each document
                    at += len(words) + 1
                ids, first = np.concatenate(parts), np.array(starts)
                hit, begins, found = block.hits(ids, first)
                longest = block.extended(ids, first, begins)
                edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
                of = np.searchsorted(first, edges[::2], side="right") - 1
                for i in range(b - a):
                    mine = edges.reshape(-1, 2)[of == i] - first[i] if i in found else np.empty((0, 2), np.int64)
                    spans.append(mine.ravel().tolist())
                    items.append(sorted(found.get(i, ())))
                    matches.append(dict(zip(("words", "at", "item", "item_at"), longest[i], strict=True)) if i in longest else None)
            made = [pa.array(v, t) for v, (_, t) in zip((counts, spans, items, matches), _ARROW, strict=True)]
            out = pa.RecordBatch.from_arrays([*batch.columns, *made], schema=pa.schema([*batch.schema, *_ARROW]))
            yield out.filter(pa.array([bool(x) for x in spans], pa.bool_())) if only_hits else out

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *_FOUND]))


def _united(batches):
    """Of each document the hits in all blocks as one."""
    for batch in batches:
        rows = []
        for found in batch.column(1).to_pylist():
            best = max((f["__match"] for f in found if f["__match"]), key=lambda m: (m["words"], -m["at"], m["item"] or "", -m["item_at"]), default=None)
            rows.append((merged([x for f in found for x in f["__spans"]]), sorted({x for f in found for x in f["__items"]}), best))
        columns = zip(*rows, strict=True) if rows else [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, (_, t) in zip(columns, _ARROW[1:], strict=True)]], names=["__key", "__spans", "__items", "__match"])


def matched(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with __n (words), __spans (flat start and end words of verbatim benchmark passages, disjoint
    and in order), __items (ids of the items found) and __match (the longest match and where it lies)."""
    small_batches(spark)
    blocks = blocks_of(benchmark, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return _pass(docs, spark.sparkContext.broadcast(Block(first)))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit(""))).cast("binary"))
    keyed, tables = docs.select(key.alias("__key"), "text"), []
    for items in itertools.chain([first, second], blocks):
        handle = spark.sparkContext.broadcast(Block(items))
        tables.append(written(_pass(keyed, handle, True).drop("text", "__n").dropDuplicates(["__key"]), "hits"))
        handle.destroy()
    every = functools.reduce(DataFrame.union, tables)
    found = every.groupBy("__key").agg(F.collect_list(F.struct("__spans", "__items", "__match")).alias("found"))  # a row for each block
    hits = written(found.mapInArrow(_united, T.StructType([T.StructField("__key", T.StringType()), *_FOUND[1:]])), "hits")
    counted = _pass(docs, spark.sparkContext.broadcast(Block([]))).drop("__spans", "__items", "__match").withColumn("__key", key)
    none = [F.coalesce("__spans", F.array().cast("array<bigint>")).alias("__spans"), F.coalesce("__items", F.array().cast("array<string>")).alias("__items")]
    return counted.join(hits, "__key", "left").select(*[F.col(f"`{c}`") for c in docs.columns], "__n", *none, "__match")


def merged(spans: list[int]) -> list[int]:
    """Flat (start, end, ...) spans, united where they overlap or touch, in order."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2], strict=True)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def judged(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """matched() with __hit (words hit) and __bad (contaminated)."""
    # x - s for each start and then end adds up end - start
    out = matched(spark, docs, benchmark, block_bytes).withColumn("__hit", F.aggregate("__spans", F.lit(0).cast("long"), lambda s, x: x - s))
    return out.withColumn("__bad", (F.col("__hit") > 0) & (F.col("__hit") * 20 >= F.col("__n")))


@shielded
def decontaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with their columns as they were."""
    return judged(spark, docs, benchmark).filter(~F.col("__bad")).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judged(spark, table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id",
        F.col("__n").alias("n_words"),
        F.col("__hit").alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ",").cast("binary"), 256).alias("items_sha256"),
        F.col("__bad").alias("contaminated"),
    )


SQL = r"""
WITH w AS (
  SELECT doc_id AS id, 'd' AS kind, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents
  UNION ALL
  SELECT item_id, 'b', list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark
), items AS (
  SELECT id AS item_id, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS g, least(13, len(ws)) AS k
  FROM (SELECT id, ws, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS i FROM w WHERE kind = 'b' AND len(ws) > 0)
), ks AS (SELECT DISTINCT k FROM items),
grams AS (
  SELECT id AS doc_id, i, k, array_to_string(ws[i:i + k - 1], ' ') AS g
  FROM (SELECT id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, ks WHERE kind = 'd' AND len(ws) >= k)
), found AS (SELECT grams.doc_id, grams.i, grams.k, items.item_id FROM grams JOIN items USING (g, k)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM found)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s FROM found GROUP BY doc_id)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hit ON hit.doc_id = w.id LEFT JOIN its ON its.doc_id = w.id WHERE kind = 'd'
"""
