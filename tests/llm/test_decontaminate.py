import hashlib
import random
import re

import numpy as np
import pytest

from gridloom.llm import decontaminate
from gridloom.llm.decontaminate import words_of
from tests.llm.data import SCHEMA, frame, rows


def words(text):
    return [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]


def brute(data, items):
    out = []
    for r in data:
        w, hit, found = words(r[1]), set(), set()
        for item, text in items:
            v = words(text)
            k = min(13, len(v))
            grams = {tuple(v[i : i + k]) for i in range(len(v) - k + 1)} if v else set()
            for i in range(len(w) - k + 1 if k else 0):
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    found.update([] if item is None else [str(item)])
        out.append((r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 100])
def test_as_brute_force(spark, block):
    data = rows()
    texts = [(data[3][1] or "x").split(), data[10][1].split()]
    items = [(1, " ".join(texts[1][:40])), (2, " ".join(texts[1][5:60])), (2, "a b"), (10, "A, B"), (3, None), (4, ""), (5, " ".join(texts[0])), (None, "w1 w2"), (6, "go GO go")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judged(spark, frame(spark), bench, block).collect()
    found = sorted((r.doc_id, r["__n"], r["__hit"], len(r["__items"]), hashlib.sha256(",".join(r["__items"]).encode()).hexdigest(), r["__bad"]) for r in got)
    assert found == brute(data, items)
    texts = {str(k) if k is not None else None: [] for k, _ in items}
    for k, t in items:
        texts[str(k) if k is not None else None].append(words(t))
    for r in got:
        w, best = words(r.text), 0
        for v in (v for vs in texts.values() for v in vs):
            k = min(13, len(v))
            if k and any(w[i : i + k] == v[j : j + k] for i in range(len(w) - k + 1) for j in range(len(v) - k + 1)):
                best = max(best, longest_common(w, v))
        m = r["__match"]
        assert (m.words if m else 0) == best
        if m:
            assert any(v[m.item_at : m.item_at + m.words] == w[m.at : m.at + m.words] for v in texts[m.item])


def longest_common(w, v):
    best, row = 0, [0] * (len(v) + 1)
    for x in w:
        row = [0, *[row[j] + 1 if x == y else 0 for j, y in enumerate(v)]]
        best = max(best, *row)
    return best


def longest_prefix(w, v):
    return max(next((k for k, (x, y) in enumerate(zip(w, v[j:], strict=False)) if x != y), min(len(w), len(v) - j)) for j in range(len(v)))


def test_longest_matches_of_repetitive_texts():
    rng = random.Random(7)
    for _ in range(150):
        items = [(str(i), " ".join(rng.choice("ab") for _ in range(rng.randint(1, 60))).encode()) for i in range(4)]
        texts = [" ".join(rng.choice(["a", "b", "b", "c"][: rng.randint(2, 4)]) for _ in range(rng.randint(1, 80))) for _ in range(3)]
        block = decontaminate.Block(items)
        ids, starts = [], []
        for t in texts:
            starts.append(len(ids))
            ids += [block.vocab.get(w, 0) for w in words_of(t.encode())] + [0]
        ids, starts = np.array(ids, np.int32), np.array(starts)
        _, begins, found = block.hits(ids, starts)
        got = block.extended(ids, starts, begins)
        assert set(got) == set(found)
        for d, (n, at, item, there) in got.items():
            w, v = texts[d].split(), dict(items)[item].decode().split()
            assert w[at : at + n] == v[there : there + n]
            begin = [k for k in range(len(w)) if begins[starts[d] + k]]
            assert n == max(longest_prefix(w[k:], t.decode().split()) for _, t in items for k in begin)


def test_one_block_at_a_time_and_no_nested_python(spark):
    bench = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i + 2}") for i in range(40)], "item_id long, text string")
    plan = decontaminate.judged(spark, frame(spark), bench, 100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_no_benchmark_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminated(spark, frame(spark), none).count() == len(rows())
    empty = decontaminate.decontaminated(spark, spark.createDataFrame([], SCHEMA), none)
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "lang", "source", "n_chars"]
