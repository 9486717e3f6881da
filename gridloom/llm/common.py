"""Helpers that the corpus operators share: tables in the shared folder, chunking, word hashes.

Conventions of every operator here: input columns are selected by name, so extra columns never
clash; names that begin with two underscores are the operators' own, and where an operator hands
documents on, extra columns of such names come through it unharmed (shielded); a null text has no
words; one output row comes back per input row.
"""

from __future__ import annotations

import atexit
import contextlib
import functools
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of one Arrow batch; with long texts a larger batch would not fit a small executor.
BATCH_ROWS, BATCH_BYTES = 1000, 32 << 20
#: Bytes of text that a Python worker splits into words at once.
CHUNK_BYTES = 3 << 20

_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (found or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A place in the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/gridloom-{label}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    return path


def release() -> None:
    """Removes all tables written so far; results that still read them must have been used."""
    while _written:
        spark, path = _written.pop()
        with contextlib.suppress(Exception):  # the session may be gone
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: df as a Parquet table in the shared folder, read again."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shielded(step: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For a step that hands documents on: columns named as if they were the step's own go by other names."""

    @functools.wraps(step)
    def run(*args: object) -> DataFrame:
        at, docs = next((i, x) for i, x in enumerate(args) if isinstance(x, DataFrame))
        other = {c: f"extra {i} of the caller" for i, c in enumerate(docs.columns) if c.startswith("__")}
        out = step(*args[:at], docs.withColumnsRenamed(other), *args[at + 1 :])
        return out.withColumnsRenamed({new: c for c, new in other.items()})

    return run


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a column, one number on the driver; sizes shards and buckets."""
    return int(df.agg(F.sum(F.octet_length(F.col(column).cast("string")).cast("long"))).first()[0] or 0)


def chunked(texts: Sequence[bytes | None], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes each; a longer text is a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if size and size + n > limit:
            yield lo, i
            lo, size = i, 0
        size += n
    if len(texts) > lo:
        yield lo, len(texts)


class WordHashes(dict):
    """XXH64 of each word seen; forgets all when it has grown past a bound."""

    BOUND = 400_000

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh64_intdigest(word, 7)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.BOUND:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One well-spread 64-bit value for each ordered pair."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """A hash of the k words from each position on; as many as there are whole grams."""
    if len(words) < k:
        return np.empty(0, np.uint64)
    level, width = words, 1
    while 2 * width <= k:
        level, width = mixed(level[:-width], level[width:]), 2 * width
    if width < k:  # two overlapping grams of a power of two fix a gram of any length between
        level = mixed(level[: len(words) - k + 1], level[k - width : k - width + len(words) - k + 1])
    return level
