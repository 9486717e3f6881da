import hashlib
import re

import numpy as np
import pytest

from gridloom.llm import substring
from tests.llm.data import frame, rows


def brute(data):
    words = [[w for w in re.split("[\x20\x09-\x0d]+", r[1] or "") if w] for r in data]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - 34):
            seen.setdefault(tuple(w[i : i + 35]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + 35))
    return sorted((r[0], len(w), len(g), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in g).encode()).hexdigest()) for r, w, g in zip(data, words, gone, strict=True))


def _got(spark, data):
    return sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.repeats(spark, frame(spark, data)).collect())


@pytest.mark.parametrize("shard", [substring.SHARD_BYTES, 4000])
def test_repeats_as_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(substring, "SHARD_BYTES", shard)
    monkeypatch.setattr(substring, "BUCKET_BYTES", shard)
    data = rows()
    assert _got(spark, data) == brute(data)


def test_empty_table(spark):
    assert _got(spark, []) == []


def test_packed_lists_come_back():
    rng = np.random.default_rng(1)
    for top in (1 << 20, 1 << 40, 1 << 63):
        for n in (0, 1, 2, 500):
            v = np.sort(rng.integers(0, top, n, dtype=np.uint64))
            assert (substring.unpacked(substring.packed(v)) == v).all()
