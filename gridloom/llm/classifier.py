"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each text gives a vector of shares and ratios (FEATURES), on square-root and log scales so that classes
are nearer to normal. Each class has its mean and a covariance shrunk towards the diagonal of the pooled
one; a floor keeps it regular. The score is the logistic of the difference of the classes' log
densities (half the Mahalanobis distances and the log determinants, by Cholesky factors made once and
sent to the tasks) plus the log odds of the labels.

Only labelled rows outside the held-out fifth (crc32 of the id as text, modulo 5) are learnt from, all
of them. Null texts are empty; an empty text has a score like any other. Without labels of both classes
every score is the smoothed share of label 1. Repeated labels count each, null ones not at all; rows that
tie have equal scores. Very long texts are measured whole. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import chunked, small_batches, table, written

FEATURES = ("symbols", "bars", "marks", "upper", "variety", "echo", "length", "points", "digits", "lines", "same_lines", "ascii")
SHRINK, FLOOR = 0.1, 0.03
THRESHOLD = 0.3
_CLASSES = {"symbols": b"#$%&*<>", "bars": b"|", "marks": b"!?:;=@~^_\\/{}[]()+", "points": b".,", "digits": b"0123456789"}
_DROP = {k: bytes(c for c in range(256) if c not in v) for k, v in _CLASSES.items()}
_NOT_UPPER = bytes(c for c in range(256) if not 65 <= c <= 90)
_NOT_ASCII_LETTER = bytes(c for c in range(256) if not (65 <= c <= 90 or 97 <= c <= 122))


def features(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n, size = len(words) + 1.0, len(text) + 1.0
    count = {k: len(text.translate(None, drop)) for k, drop in _DROP.items()}
    lines = [x for x in text.split(b"\n") if x.strip()]
    echo = sum(a == b for a, b in zip(words, words[1:], strict=False))
    return [
        math.sqrt(count["symbols"] / n),
        math.sqrt(count["bars"] / n),
        math.sqrt(count["marks"] / n),
        math.sqrt(len(text.translate(None, _NOT_UPPER)) / size),
        math.log(len(set(words)) + 1.0) / math.log(n + 1),
        math.sqrt(echo / n),
        math.log(size / n),
        math.sqrt(count["points"] / n),
        math.sqrt(count["digits"] / size),
        math.sqrt(len(lines) / n),
        math.sqrt((len(lines) - len(set(lines))) / (len(lines) + 1.0)),
        math.sqrt(len(text.translate(None, _NOT_ASCII_LETTER)) / size),
    ]


def _vectors(batches):
    for batch in batches:
        texts, rows = batch.column(1).cast(pa.binary()).to_pylist(), []
        for a, b in chunked(texts):
            rows += map(features, texts[a:b])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["doc_id", "x"])


def vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, x) for each row."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_vectors, "doc_id long, x array<double>")


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _sums(batches):
    """Of each class: the number of rows, the sums and the sums of products, as (class, place, value)."""
    d = len(FEATURES)
    total = {k: np.zeros(1 + d + d * d) for k in (0, 1)}
    for batch in batches:
        y = np.array(batch.column(0).to_pylist(), np.int64)
        x = np.array(batch.column(1).to_pylist(), float).reshape(-1, d)
        for k, t in total.items():
            own = x[y == k]
            t += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
    y = np.repeat(list(total), 1 + d + d * d)
    yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array(np.tile(np.arange(1 + d + d * d), 2), pa.int32()), pa.array(np.concatenate(list(total.values())))], names=["y", "place", "v"])


class Discriminant:
    """The fitted model: of each class the mean, the Cholesky factor of its covariance, its log
    determinant; and the labels' log odds."""

    def __init__(self, sums: dict[int, np.ndarray]):
        d = len(FEATURES)
        n = {k: v[0] for k, v in sums.items()}
        self.odds = math.log((n[1] + 1) / (n[0] + 1))
        self.classes = []
        if min(n.values()) < 2:
            return
        means = {k: v[1 : 1 + d] / v[0] for k, v in sums.items()}
        scatter = {k: v[1 + d :].reshape(d, d) - v[0] * np.outer(means[k], means[k]) for k, v in sums.items()}
        pooled = np.diag((scatter[0] + scatter[1]).diagonal() / (n[0] + n[1]))
        for k in (0, 1):
            shrunk = (1 - SHRINK) * scatter[k] / n[k] + SHRINK * pooled + FLOOR**2 * np.eye(d)
            factor = np.linalg.cholesky(shrunk)
            self.classes.append((means[k], np.linalg.inv(factor), 2 * np.log(factor.diagonal()).sum()))

    def score(self, x: np.ndarray) -> np.ndarray:
        log_odds = np.full(len(x), self.odds)
        if self.classes:
            density = [-0.5 * ((((x - m) @ inverse.T) ** 2).sum(1) + det) for m, inverse, det in self.classes]
            log_odds = log_odds + density[1] - density[0]
        return 1 / (1 + np.exp(-np.clip(log_odds, -60, 60)))


def fit(rows: DataFrame, labels: DataFrame) -> Discriminant:
    """From vectors and labels (doc_id, quality), but for the held-out rows."""
    learnt = labels.filter(~held_out() & F.col("quality").isin(0, 1)).select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("y"))
    pairs = learnt.join(rows, F.col("__id") == F.col("doc_id")).select("y", "x")
    sums = {k: np.zeros(1 + len(FEATURES) + len(FEATURES) ** 2) for k in (0, 1)}
    for y, place, v in pairs.mapInArrow(_sums, "y int, place int, v double").groupBy("y", "place").agg(F.sum("v")).collect():
        sums[y][place] = v
    return Discriminant(sums)


def scored(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for each row of docs."""
    small_batches(spark)
    rows = written(vectors(docs), "vectors")
    shared = spark.sparkContext.broadcast(fit(rows, labels))

    def score(batches):
        for batch in batches:
            x = np.array(batch.column(1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(x))], names=["doc_id", "score"])

    return rows.mapInArrow(score, "doc_id long, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
