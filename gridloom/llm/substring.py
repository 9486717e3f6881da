"""Substring dedup by fixed-block anchors: every word covered by a window that repeats is removed.

Any 35 consecutive words of a document hold exactly one whole block of 18 words that starts at a
multiple of 18 (the blocks do not overlap). Those blocks are the index; it is probed with every
rolling 18-word window of every document. A block that no other window repeats rules out the 18
windows around it. The rest, the hits, are extended: all windows around a repeated block are compared
exactly (96 bits of hash) and adjoining repeated windows unite to maximal exact repeats.

Documents are dealt once into shards of bounded size, stored bucketed by shard, so that the three
passes over the text read it in place. Passes exchange packed hashes: each shard sends each bucket of
the hash range its distinct hashes, sorted and delta-coded, with a bit for those it has itself more
than once; the bucket answers with bits in the same order. A window that thousands of documents share
is one entry for each shard, so no key makes a large task, and no pairs are ever made.

Null and empty texts have no words; texts of fewer than 35 words lose none; very long texts are a shard of
their own at most. Repeated rows repeat each other. Windows are equal if 96 bits of their words' hashes
are. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import CHUNK_BYTES, WordHashes, chunked, gram_hashes, table, text_bytes, written

WINDOW, BLOCK = 35, 18
#: Bytes of text in a shard, about; memory of a Python worker is some multiple of it.
SHARD_BYTES = 12 << 20
#: Bytes of text for each bucket of the hash range.
BUCKET_BYTES = 16 << 20


def packed(values: np.ndarray) -> bytes:
    """Sorted unsigned 64-bit values: the gaps, a byte plane at a time, so that small gaps compress."""
    gaps = np.diff(values, prepend=np.uint64(0))
    width = 4 if not len(gaps) or (len(gaps) == 1 or int(gaps[1:].max()) < 1 << 32) else 8
    first = gaps[:1].astype("<u8").tobytes()
    return bytes([width]) + first + np.ascontiguousarray(gaps[1:].astype(f"<u{width}").view(np.uint8).reshape(-1, width).T).tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    width, first = blob[0], np.frombuffer(blob, "<u8", 1, 1) if len(blob) > 1 else np.empty(0, "<u8")
    planes = np.frombuffer(blob, np.uint8, offset=1 + 8 * len(first))
    rest = np.ascontiguousarray(planes.reshape(width, -1).T).view(f"<u{width}").ravel().astype(np.uint64)
    return np.cumsum(np.concatenate([first.astype(np.uint64), rest]), dtype=np.uint64)


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


class Shard:
    """The documents of one shard in a fixed order, with their words' hashes."""

    def __init__(self, rows: pa.Table):
        ids, texts = rows.column("doc_id").to_pylist(), rows.column("text").cast(pa.binary()).to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i] is not None, texts[i] or b""))
        self.ids, self.texts = [ids[i] for i in order], [texts[i] for i in order]
        known, parts = WordHashes(), []
        for a, b in chunked(self.texts, CHUNK_BYTES // 3):
            parts += [known.of((t or b"").split()) for t in self.texts[a:b]]
        self.counts = np.array([len(p) for p in parts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.counts)[:-1]]).astype(np.int64) if len(parts) else np.empty(0, np.int64)
        self.words = np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def within(self, size: int, least: int = WINDOW) -> np.ndarray:
        """Positions from which size words lie within one document of at least so many words."""
        last = np.where(self.counts >= least, self.counts - size + 1, 0)
        return np.repeat(self.starts - np.concatenate([[0], np.cumsum(last)[:-1]]), last) + np.arange(last.sum()) if len(last) else np.empty(0, np.int64)

    def offset(self, at: np.ndarray) -> np.ndarray:
        """Of positions, the word number within their document."""
        return at - self.starts[np.searchsorted(self.starts, at, side="right") - 1] if len(at) else at

    def block_keys(self, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rolling windows' distinct hashes cut to the upper keep bits, which recur here, and at the
        blocks' positions their places in that list."""
        at = self.within(BLOCK)
        hashes = gram_hashes(self.words, BLOCK)[at] >> np.uint64(64 - keep) if len(at) else np.empty(0, np.uint64)
        distinct, counts = np.unique(hashes, return_counts=True)
        anchors = at[self.offset(at) % BLOCK == 0]
        places = np.searchsorted(distinct, gram_hashes(self.words, BLOCK)[anchors] >> np.uint64(64 - keep)) if len(anchors) else anchors
        return distinct, counts > 1, np.stack([anchors, places]) if len(anchors) else np.empty((2, 0), np.int64)

    def candidates(self, repeated: np.ndarray) -> np.ndarray:
        """Start positions of the windows whose block is at one of the positions repeated."""
        flag = np.zeros(len(self.words) + BLOCK, bool)
        flag[repeated] = True
        at = self.within(WINDOW)
        return at[flag[at + (-self.offset(at)) % BLOCK]] if len(at) else at

    def window_keys(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct hashes of the windows at, a second hash of each, which recur here, and by window its place."""
        if not len(at):
            return np.empty(0, np.uint64), np.empty(0, np.uint32), np.empty(0, bool), np.empty(0, np.int64)
        first = gram_hashes(self.words, WINDOW)[at]
        second = (gram_hashes(self.words ^ np.uint64(0x5851F42D4C957F2D), WINDOW)[at] >> np.uint64(32)).astype(np.uint32)
        order = np.lexsort([second, first])
        a, b = first[order], second[order]
        new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
        heads = np.flatnonzero(new)
        place = np.empty(len(at), np.int64)
        place[order] = np.cumsum(new) - 1
        return a[heads], b[heads], np.diff(np.append(heads, len(at))) > 1, place


def _cut(values: np.ndarray, keep: int, buckets: int) -> np.ndarray:
    """Where each bucket of the range starts in sorted values of keep bits."""
    edges = np.arange(buckets, dtype=np.uint64) << np.uint64(keep - int(math.log2(buckets)))
    return np.append(np.searchsorted(values, edges), len(values))


def _sent(shard: int, values: np.ndarray, keep: int, buckets: int, more: dict[str, np.ndarray]) -> pa.Table:
    cut, out = _cut(values, keep, buckets), {"bucket": [], "shard": [], "hashes": []} | {k: [] for k in more}
    for k in np.flatnonzero(np.diff(cut)).tolist():
        a, b = cut[k], cut[k + 1]
        out["bucket"].append(k)
        out["shard"].append(shard)
        out["hashes"].append(packed(values[a:b]))
        for name, x in more.items():
            out[name].append(bits(x[a:b]) if x.dtype == bool else x[a:b].tobytes())
    kinds = {"bucket": pa.int32(), "shard": pa.int32()}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in out.items()})


def _answers(rows: pa.Table, lists: list[tuple[np.ndarray, ...]], asked: list[np.ndarray], level: int) -> pa.Table:
    return pa.table({
        "shard": rows.column("shard").cast(pa.int32()),
        "level": pa.array([level] * len(lists), pa.int32()),
        "bucket": rows.column("bucket").cast(pa.int32()),
        "n": pa.array([len(x) for x in asked], pa.int32()),
        "flags": pa.array([bits(x) for x in asked], pa.binary()),
    })


_ANSWER = "shard int, level int, bucket int, n int, flags binary"


def _blocks_repeated(rows: pa.Table) -> pa.Table:
    """One bucket: which blocks some other rolling window repeats."""
    lists = [unpacked(x) for x in rows.column("hashes").to_pylist()]
    own = [unbits(x, len(v)) for x, v in zip(rows.column("recurs").to_pylist(), lists, strict=True)]
    block = [unbits(x, len(v)) for x, v in zip(rows.column("block").to_pylist(), lists, strict=True)]
    every = np.sort(np.concatenate(lists))
    again = np.unique(every[1:][every[1:] == every[:-1]])
    asked = []
    for v, o, b in zip(lists, own, block, strict=True):
        at = np.minimum(np.searchsorted(again, v[b]), max(0, len(again) - 1))
        asked.append(o[b] | (again[at] == v[b]) if len(again) else o[b])
    return _answers(rows, lists, asked, 1)


def _windows_repeated(rows: pa.Table) -> pa.Table:
    """One bucket: which windows occur elsewhere too."""
    first = [unpacked(x) for x in rows.column("hashes").to_pylist()]
    second = [np.frombuffer(x, np.uint32) for x in rows.column("second").to_pylist()]
    own = [unbits(x, len(v)) for x, v in zip(rows.column("recurs").to_pylist(), first, strict=True)]
    a, b = np.concatenate(first), np.concatenate(second)
    order = np.lexsort([b, a])
    same = (a[order][1:] == a[order][:-1]) & (b[order][1:] == b[order][:-1])
    flag = np.zeros(len(a), bool)
    flag[order[1:]] |= same
    flag[order[:-1]] |= same
    edges = np.cumsum([0, *map(len, first)])
    return _answers(rows, first, [flag[x:y] | o for x, y, o in zip(edges[:-1], edges[1:], own, strict=True)], 2)


def _flags(rows: pa.Table, level: int) -> np.ndarray:
    """A shard's answers of one level, in the order of its sorted hashes."""
    got = sorted((b, n, f) for b, n, f, x in zip(*(rows.column(c).to_pylist() for c in ("bucket", "n", "flags", "level")), strict=True) if x == level)
    return np.concatenate([unbits(f, n) for _, n, f in got]) if got else np.empty(0, bool)


class Plan:
    """The sizes that follow from the bytes of text: shards, buckets, bits of a block's hash."""

    def __init__(self, size: int):
        self.shards = max(1, math.ceil(size / SHARD_BYTES))
        self.buckets = 1 << max(3, math.ceil(math.log2(max(1, size / BUCKET_BYTES))))
        # eight more bits than words: few chance hits, and those fall at the exact comparison
        self.keep = min(64, math.ceil(math.log2(size + 2)) + 6)

    def _blocks(self, shard: Shard) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        distinct, recurs, (at, places) = shard.block_keys(self.keep)
        block = np.zeros(len(distinct), bool)
        block[places] = True
        return distinct, recurs, block, np.stack([at, (np.cumsum(block) - 1)[places]]) if len(at) else np.empty((2, 0), np.int64)

    def send_blocks(self, key: tuple, rows: pa.Table) -> pa.Table:
        distinct, recurs, block, _ = self._blocks(Shard(rows))
        return _sent(key[0].as_py(), distinct, self.keep, self.buckets, {"recurs": recurs, "block": block})

    def _candidates(self, shard: Shard, answers: pa.Table) -> np.ndarray:
        at, places = self._blocks(shard)[3]
        flags = _flags(answers, 1)
        return shard.candidates(at[flags[places]] if len(at) else at)

    def send_windows(self, key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        shard = Shard(rows)
        first, second, recurs, _ = shard.window_keys(self._candidates(shard, answers))
        return _sent(key[0].as_py(), first, 64, self.buckets, {"recurs": recurs, "second": second})

    def finish(self, key: tuple, rows: pa.Table, answers: pa.Table) -> pa.Table:
        shard = Shard(rows)
        at = self._candidates(shard, answers)
        place = shard.window_keys(at)[3]
        at = at[_flags(answers, 2)[place]] if len(at) else at
        edge = np.zeros(len(shard.words) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + WINDOW, -1)
        gone = np.cumsum(edge)[:-1] > 0
        spans, kept = [], []
        for n, start, text in zip(shard.counts.tolist(), shard.starts.tolist(), shard.texts, strict=True):
            own = gone[start : start + n]
            spans.append(np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8))).tolist())
            words = (text or b"").split()
            kept.append(hashlib.sha256(b" ".join(words if not own.any() else [words[i] for i in np.flatnonzero(~own).tolist()])).hexdigest())
        removed = np.add.reduceat(np.append(gone, False).astype(np.int64), shard.starts) * (shard.counts > 0) if len(spans) else []
        return pa.table({"doc_id": pa.array(shard.ids, pa.int64()), "n_words": pa.array(shard.counts), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept_sha256": pa.array(kept, pa.string())})


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_removed, spans (flat start and end words of its maximal
    exact repeats, united where they overlap) and kept_sha256 of the words left."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))
    plan = Plan(text_bytes(docs))
    # the text helps to deal rows out that share an id or have none
    shard = F.pmod(F.xxhash64("doc_id", "text"), F.lit(plan.shards)).cast("int")
    name = f"gridloom_shards_{uuid.uuid4().hex}"
    buckets = min(plan.shards, 20_000)
    try:
        docs.withColumn("shard", shard).repartition(buckets, "shard").write.option("compression", "zstd").bucketBy(buckets, "shard").saveAsTable(name)
        return _repeats(spark.table(name), plan)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # the texts' copy is large


def _repeats(stored: DataFrame, plan: Plan) -> DataFrame:
    """repeats() of documents stored by shard."""
    groups = stored.groupBy("shard")
    sent = groups.applyInArrow(lambda k, r: plan.send_blocks(k, r), "bucket int, shard int, hashes binary, recurs binary, block binary")
    first = written(sent.groupBy("bucket").applyInArrow(_blocks_repeated, _ANSWER), "blocks")
    again = groups.cogroup(first.groupBy("shard")).applyInArrow(lambda k, r, a: plan.send_windows(k, r, a), "bucket int, shard int, hashes binary, recurs binary, second binary")
    both = first.union(written(again.groupBy("bucket").applyInArrow(_windows_repeated, _ANSWER), "windows"))
    out = groups.cogroup(both.groupBy("shard")).applyInArrow(lambda k, r, a: plan.finish(k, r, a), "doc_id long, n_words long, n_removed long, spans array<long>, kept_sha256 string")
    return written(out, "repeats")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark, table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), g AS (
  SELECT doc_id, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w WHERE len(ws) >= 35)
), r AS (SELECT doc_id, i FROM g WHERE h IN (SELECT h FROM g GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM r) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(CASE WHEN ps IS NULL THEN array_to_string(ws, ' ') ELSE coalesce((SELECT string_agg(ws[q], ' ' ORDER BY q) FROM (SELECT unnest(range(1, len(ws) + 1)) AS q) WHERE NOT list_contains(ps, q)), '') END) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
