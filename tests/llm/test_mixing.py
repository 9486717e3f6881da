import re

from pyspark.sql import functions as F

from gridloom.llm import mixing
from tests.llm.data import frame, rows


def water(sizes):
    """Targets by sharing again and again, as the rule reads."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    got, left = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values())
    while left > 1e-9:
        free = [s for s in order if got[s] < 2 * sizes[s] - 1e-9]
        if not free:
            break
        share = left / sum(weight[s] for s in free)
        left = 0.0
        for s in free:
            more = share * weight[s]
            room = 2 * sizes[s] - got[s]
            got[s] += min(more, room)
            left += max(0.0, more - room)
    return got


def _words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_targets_and_takes(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 7)
    data = rows(150) + [(400 + i, "w " * n, None, s, None) for i, (s, n) in enumerate([("s3", 5), ("é", 70), ("s4", 0), ("s4", 0)])]
    got = mixing.mixed(mixing.sized(frame(spark, data))).collect()
    assert sorted((r.doc_id, r.size) for r in got) == sorted((r[0], _words(r[1])) for r in data)
    sizes = {}
    for r in data:
        sizes[r[3]] = sizes.get(r[3], 0) + _words(r[1])
    want = water(sizes)
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and abs(len(r.positions) * r.size - r.taken) <= r.size / 2
        taken[r.source] += r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) < 1 + 1e-6, (s, t, want[s])
    again = mixing.mixed(mixing.sized(frame(spark, data).repartition(3))).collect()
    assert sorted((r.doc_id, r.key, r.taken, r.positions) for r in got) == sorted((r.doc_id, r.key, r.taken, r.positions) for r in again)


def test_mixture_repeats_documents_in_order_of_position(spark):
    docs = frame(spark)
    out = mixing.mixture(docs)
    assert out.columns == docs.columns
    takes = mixing.mixed(mixing.sized(docs)).withColumn("n", F.size("positions")).filter("n > 0")
    assert sorted(r.doc_id for r in out.collect()) == sorted(r.doc_id for r in takes.collect() for _ in range(r.n))


def test_no_documents_and_no_words(spark):
    assert mixing.mixed(mixing.sized(frame(spark, []))).count() == 0
    got = mixing.mixed(mixing.sized(frame(spark, [(1, None, None, None, None), (2, "", None, "a", 0)]))).collect()
    assert [(r.taken, r.target) for r in got] == [(0, 0.0)] * 2


def test_no_python_on_executors(spark):
    plan = mixing.query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
