import math
import re
import zlib

import numpy as np

from gridloom.llm import classifier
from tests.llm.data import frame, rows

HERE = "/root/testdata/sf0.01"


def test_held_out_labels_are_predicted(spark):
    got = {r.doc_id: r for r in classifier.query(spark, HERE).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(r.quality, got[r.doc_id]) for r in spark.read.parquet(f"{HERE}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert len(held) > 50 and np.mean([q == r.predicted for q, r in held]) > 0.95


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = (spark.read.parquet(f"{HERE}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.select("doc_id", (labels.quality != classifier.held_out().cast("int")).cast("int").alias("quality"))
    assert sorted(classifier.scored(spark, docs, labels).collect()) == sorted(classifier.scored(spark, docs, turned).collect())


def test_hard_rows_and_missing_labels(spark):
    docs = frame(spark)
    none = spark.createDataFrame([(1, None), (None, 1), (2, 1)], "doc_id long, quality int")
    assert classifier.scored(spark, docs, none).count() == len(rows())
    assert {r.score for r in classifier.scored(spark, docs, none.limit(0)).collect()} == {0.5}
    assert classifier.scored(spark, frame(spark, []), none).count() == 0


def test_density_is_that_of_the_normal():
    rng = np.random.default_rng(0)
    d = len(classifier.FEATURES)
    x = {k: rng.normal(k, 1 + k, (500, d)) for k in (0, 1)}
    model = classifier.Discriminant({k: np.concatenate([[500], v.sum(0), (v.T @ v).ravel()]) for k, v in x.items()})
    pooled = np.diag(sum(np.cov(v.T, bias=True) * 500 for v in x.values()).diagonal() / 1000)
    logs = []
    for v in x.values():
        c = 0.9 * np.cov(v.T, bias=True) + 0.1 * pooled + classifier.FLOOR**2 * np.eye(d)
        y = x[0] - v.mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", y, np.linalg.inv(c), y) + np.linalg.slogdet(c)[1]))
    assert np.allclose(model.score(x[0]), 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60))))


def plain_vector(text):
    text = text or ""
    raw = text.encode()
    words, n, size = re.findall(r"[^\x20\x09-\x0d]+", text), 0, len(raw) + 1
    n = len(words) + 1
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    of = lambda chars: sum(text.count(c) for c in chars)
    upper = sum("A" <= c <= "Z" for c in text)
    letters = sum(c.isascii() and c.isalpha() for c in text)
    echo = sum(words[i] == words[i - 1] for i in range(1, len(words)))
    roots = [of("#$%&*<>") / n, of("|") / n, of("!?:;=@~^_\\/{}[]()+") / n, upper / size]
    more = [of(".,") / n, of("0123456789") / size, len(lines) / n, (len(lines) - len(set(lines))) / (len(lines) + 1), letters / size]
    return [*map(math.sqrt, roots), math.log(len(set(words)) + 1) / math.log(n + 1), math.sqrt(echo / n), math.log(size / n), *map(math.sqrt, more)]


def test_the_query_is_what_plain_code_makes_of_it(spark):
    here = "/root/testdata/sf0.01"
    docs = {r.doc_id: plain_vector(r.text) for r in spark.read.parquet(f"{here}/documents.parquet").collect()}
    learnt = [(r.quality, docs[r.doc_id]) for r in spark.read.parquet(f"{here}/labels.parquet").collect() if r.quality in (0, 1) and zlib.crc32(str(r.doc_id).encode()) % 5]
    own = {k: np.array([x for y, x in learnt if y == k]) for k in (0, 1)}
    spread = {k: np.cov(x.T, bias=True) for k, x in own.items()}
    pooled = sum(len(own[k]) * spread[k].diagonal() for k in (0, 1)) / len(learnt)
    odds = math.log((len(own[1]) + 1) / (len(own[0]) + 1))
    x, density = np.array(list(docs.values())), []
    for k in (0, 1):
        cov = (1 - classifier.SHRINK) * spread[k] + np.diag(classifier.SHRINK * pooled + classifier.FLOOR**2)
        z = x - own[k].mean(0)
        density.append(-0.5 * (np.einsum("ij,jk,ik->i", z, np.linalg.inv(cov), z) + np.linalg.slogdet(cov)[1]))
    want = 1 / (1 + np.exp(-np.clip(odds + density[1] - density[0], -60, 60)))
    got = {r.doc_id: r for r in classifier.query(spark, here).collect()}
    assert list(map(len, (got, want))) == [len(docs)] * 2
    assert np.allclose([got[d].score for d in docs], want, rtol=1e-6, atol=1e-9)
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and got[d].predicted == (got[d].score >= 0.3) for d in docs)
