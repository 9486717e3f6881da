"""Token ids in binary files: frequency-ranked, byte-aligned, with control bytes apart from the data.

Documents are dealt out by ranges of doc_id, sorted, tokenised once and written in blocks. A block
ranks its ids by frequency and stores ranks: two bits for each in the control bytes give its length in
the data bytes, 1 to 4. So frequent ids take one byte, and a block is decoded by table lookups and
gathers in numpy, without a loop. Blocks are rows of a Parquet table in the shared folder (executors
reach no other store), each complete in itself: its table of ids, its documents and a checksum.

A tokenizer that drops white space and parts letters from marks (cuttable) gets each distinct
white-space-separated chunk of text once in a task, and its ids are looked up from then on; others get
whole texts. The ids of a text depend on nothing but the text.

A null text is an empty one: its only id is the end id. Very long texts are encoded whole. Rows that
repeat a doc_id, and rows without one, which come first, lie in order of a hash of their text; rows that
are the same lie next to each other. No documents: an empty result.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import chunked, fresh_path, small_batches, table, text_bytes

END_ID = 2
#: Ids of one block, about, and bytes of text in one of the files' ranges.
BLOCK_IDS = 1 << 21
RANGE_BYTES = 24 << 20
MAGIC = b"GLT1"
_HEAD = struct.Struct("<4sIIIII")  # magic, distinct ids, documents, ids, data bytes, crc32 of what follows
#: By control byte, the lengths of its four values.
LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)


#: How the tokenizers that texts may be cut up for prepare a text, as their files say it.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END, SPECIAL = "</w>", "<|"


def cuttable(spec: dict) -> bool:
    """Whether a tokenizer drops white space, ignores case but for special tokens that begin with <|, and parts
    letters from marks, so that texts may be encoded by chunks. Any other tokenizer gets whole texts."""
    parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
    level = all(p.get("type") == "ByteLevel" and not p.get("add_prefix_space") and not p.get("use_regex") for p in parts[1:])
    plain = all(t["content"].startswith(SPECIAL) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] and not t["normalized"] for t in spec.get("added_tokens", []))
    return spec.get("normalizer") == NORMALIZER and parts[0] == split and level and plain and spec["model"].get("end_of_word_suffix") == WORD_END and spec.get("truncation") is None


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts by way of a table of the chunks seen; the table is emptied when it has grown large.

    A chunk of letters with a tail of punctuation falls into just these two parts, whatever the case of
    its ASCII letters. So texts are put in lower case (unless they might hold a special token, whose case
    counts), tails are parted off, and most chunks are letters only: those are encoded many to a text,
    where the tokens that end words show where each one ends. All other chunks are encoded alone."""

    BOUND = 900_000
    TAIL = b".,!?;:#*$%&|"
    TOGETHER = 100
    _TAILED = re.compile(rb"(?<=[a-z])([.,!?;:#*$%&|]+)(?![^\x20\x09-\x0d])")

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cut = cuttable(json.loads(self.tokenizer.to_str()))
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.ends = np.zeros(self.size, bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if token.endswith(WORD_END)]] = True
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {b"": 0}
        self.pool, self.starts, self.lengths = np.empty(0, np.uint32), np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _add(self, chunks: list[bytes], counts: list[np.ndarray], ids: list[np.ndarray]) -> None:
        lengths = np.concatenate([np.empty(0, np.int64), *counts])
        self.known.update(zip(chunks, range(len(self.starts), len(self.starts) + len(chunks)), strict=True))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.pool = np.concatenate([self.pool, *ids])

    def _alone(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each chunk, and all their ids."""
        found = [e.ids for e in self.tokenizer.encode_batch_fast([c.decode() for c in chunks], add_special_tokens=False)] if chunks else []
        return np.fromiter(map(len, found), np.int64, len(found)), np.array(list(itertools.chain.from_iterable(found)), np.uint32)

    @staticmethod
    def _lettered(core: bytes) -> bool:
        """Whether it is still letters throughout once the tokenizer has normalised it."""
        return core.isalpha() or (word := core.decode()).isalpha() and unicodedata.normalize("NFC", word).lower().isalpha()

    def _letters(self, words: list[bytes]) -> None:
        lots = [words[lo : lo + self.TOGETHER] for lo in range(0, len(words), self.TOGETHER)]
        counts, ids = [], []
        for lot, found in zip(lots, self.tokenizer.encode_batch_fast([b" ".join(x).decode() for x in lots], add_special_tokens=False), strict=True):
            own = np.array(found.ids, np.uint32)
            cut = np.flatnonzero(self.ends[own]) + 1
            if len(cut) == len(lot) and cut[-1] == len(own):
                counts.append(np.diff(cut, prepend=0))
            else:
                n, own = self._alone(lot)
                counts.append(n)
            ids.append(own)
        self._add(words, counts, ids)

    def _learn(self, chunks: list[bytes]) -> None:
        letters, alone, tailed = set(), [], []
        for chunk in chunks:
            low = chunk.lower()
            core = low.rstrip(self.TAIL)
            if not self._lettered(core):  # tested for known ones too: chunks of all kinds are known
                alone.append(chunk)
                continue
            if core not in self.known:
                letters.add(core)
            if core != chunk:
                tailed.append((chunk, core, low[len(core) :]))
        self._letters(sorted(letters))
        alone += sorted({t for _, _, t in tailed}.difference(self.known, alone))
        counts, ids = self._alone(alone)
        self._add(alone, [counts], [ids])
        tailed = [x for x in tailed if x[0] not in self.known]  # a tail may be a chunk too
        segment = lambda c: self.pool[self.starts[k := self.known[c]] : self.starts[k] + self.lengths[k]]
        both = [np.concatenate([segment(a), segment(b)]) for _, a, b in tailed]
        self._add([c for c, _, _ in tailed], [np.fromiter(map(len, both), np.int64, len(both))], both)

    def _chunks(self, text: bytes | None) -> list[bytes]:
        text = text or b""
        return text.split() if SPECIAL.encode() in text else self._TAILED.sub(rb" \1", text.lower()).split()

    def places(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > self.BOUND:
            self._clear()
        found = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        if len(new := np.flatnonzero(found < 0)):
            new_words = [words[i] for i in new.tolist()]
            self._learn(sorted(set(new_words)))
            found[new] = np.fromiter(map(self.known.__getitem__, new_words), np.int64, len(new))
        return found

    def encode(self, texts: list[bytes | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts: their ids, the end id after each text, and the number of each text's ids."""
        for a, b in chunked(texts, 1 << 20):
            if not self.cut:
                counts, ids = self._alone([t or b"" for t in texts[a:b]])
                yield np.insert(ids, np.cumsum(counts), np.uint32(END_ID)), counts + 1
                continue
            words = list(map(self._chunks, texts[a:b]))
            counts = np.fromiter(map(len, words), np.int64, len(words))
            places = self.places(list(itertools.chain.from_iterable(words)))
            lengths = self.lengths[places]
            edges = np.concatenate([[0], np.cumsum(lengths)])
            at = np.repeat(self.starts[places] - edges[:-1], lengths) + np.arange(edges[-1])
            ends = edges[np.cumsum(counts)]
            ids = np.insert(self.pool[at], ends, np.uint32(END_ID))
            yield ids, np.diff(ends, prepend=0) + 1


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, which serves many tasks: what it has seen need not be encoded again."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write_block(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """A block of the file format: header, the block's ids by frequency, documents (id, whether it has
    one, ids), control, data."""
    times = np.bincount(ids)
    table_ = np.flatnonzero(times)
    table_ = table_[np.argsort(-times[table_], kind="stable")]
    rank_of = np.zeros(len(times), "<u4")
    rank_of[table_] = np.arange(len(table_))
    ranks = rank_of[ids]
    lengths = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = codes.reshape(-1, 4) @ np.array([1, 4, 16, 64], np.uint8)
    data = ranks.view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    body = table_.astype("<u4").tobytes() + np.array([d or 0 for d in doc_ids], "<i8").tobytes() + bytes(d is not None for d in doc_ids) + counts.astype("<u4").tobytes() + control.tobytes() + data.tobytes()
    return _HEAD.pack(MAGIC, len(table_), len(doc_ids), len(ranks), len(data), zlib.crc32(body)) + body


def read_block(blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Documents, the number of ids of each, and all ids."""
    magic, kinds, docs, n, size, crc = _HEAD.unpack_from(blob)
    if magic != MAGIC or zlib.crc32(memoryview(blob)[_HEAD.size :]) != crc:
        raise ValueError("damaged block of token ids")
    table_ = np.frombuffer(blob, "<u4", kinds, at := _HEAD.size)
    doc_ids = np.frombuffer(blob, "<i8", docs, at := at + 4 * kinds)
    there = np.frombuffer(blob, np.uint8, docs, at := at + 8 * docs)
    counts = np.frombuffer(blob, "<u4", docs, at := at + docs).astype(np.int64)
    control = np.frombuffer(blob, np.uint8, -(-n // 4), at := at + 4 * docs)
    data = np.frombuffer(blob, np.uint8, size, at + len(control))
    lengths = LENGTHS[control].ravel()[:n]
    starts = np.cumsum(lengths, dtype=np.int64) - lengths
    ranks = data[starts].astype(np.uint32)
    for k in range(1, int(lengths.max(initial=1))):
        on = np.flatnonzero(lengths > k)
        ranks[on] |= data[starts[on] + k].astype(np.uint32) << np.uint32(8 * k)
    return [i if t else None for i, t in zip(doc_ids.tolist(), there.tolist(), strict=True)], counts, table_[ranks]


def write(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str | None = None) -> None:
    """Writes the blocks of docs to path."""
    small_batches(spark)
    tokenizer = tokenizer or default_tokenizer()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text"))

    def blocks(batches: Iterable[pa.RecordBatch]):
        from pyspark import TaskContext

        coder, part, before, seq, size = encoder(tokenizer), TaskContext.get().partitionId(), 0, 0, 0
        held: tuple[list, list, list] = ([], [], [])

        def out():
            nonlocal before, seq, size
            ids, counts = np.concatenate(held[2]), np.concatenate(held[1])
            row = [pa.array([v], t) for v, t in ((part, pa.int32()), (seq, pa.int32()), (before, pa.int64()), (len(ids), pa.int64()), (write_block(held[0], counts, ids), pa.binary()))]
            before, seq, size = before + len(ids), seq + 1, 0
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays(row, names=["part", "seq", "before", "n_ids", "block"])

        for batch in batches:
            doc_ids, at = batch.column(0).to_pylist(), 0
            for ids, counts in coder.encode(batch.column(1).cast(pa.binary()).to_pylist()):
                held[0].extend(doc_ids[at : at + len(counts)])
                held[1].append(counts)
                held[2].append(ids)
                at, size = at + len(counts), size + len(ids)
                if size >= BLOCK_IDS:
                    yield out()
        if held[0]:
            yield out()

    parts = 1 + text_bytes(docs) // RANGE_BYTES
    # the text's hash lets rows that share an id, or have none, lie in several ranges
    keys = F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()
    ordered = docs.repartitionByRange(int(parts), *keys).sortWithinPartitions(*keys, F.col("text").asc_nulls_first())
    ordered.mapInArrow(blocks, "part int, seq int, before long, n_ids long, block binary").write.option("compression", "zstd").parquet(path)


def _decoded(batches: Iterable[pa.RecordBatch]):
    for batch in batches:
        for part, before, blob in zip(*(batch.column(c) for c in (0, 1, 2)), strict=True):
            doc_ids, counts, ids = read_block(blob.as_py())
            edges = np.concatenate([[0], np.cumsum(counts)])
            ids = ids.astype("<u4")
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([part.as_py()] * len(counts), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(before.as_py() + edges[:-1]), pa.array(counts), pa.array(crcs, pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids.astype(np.int32)))],
                names=["part", "doc_id", "at", "n_tokens", "ids_crc32", "ids"],
            )


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """One row for each document written: doc_id, start, n_tokens, ids_crc32 and the ids."""
    stored = spark.read.schema("part int, seq int, before long, n_ids long, block binary").parquet(path)
    totals = stored.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each range
    offsets = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    schema = "part int, doc_id long, at long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    decode = _decoded if with_ids else lambda batches: (b.select(b.schema.names[:-1]) for b in _decoded(batches))
    found = stored.select("part", "before", "block").mapInArrow(decode, schema)
    return found.join(offsets, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def encoded(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs to files in the shared folder and reads them back, without the ids themselves."""
    path = fresh_path(spark, "tokens")
    write(spark, docs, path, tokenizer)
    return read(spark, path, with_ids=False)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, table(spark, sf_dir, "documents"))
