import itertools
import random

import numpy as np
import pytest
import xxhash

from gridloom.llm import simhash
from tests.llm.data import SCHEMA, frame, rows


def brute(data):
    prints = []
    for r in data:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1] or "").replace("\n", " ").replace("\t", " ").split(" ")
        words = [w for w in words if w]
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    return prints, groups(prints, [r[0] for r in data])


def groups(prints, ids):
    least = list(ids)
    while True:
        before = list(least)
        for i in range(len(ids)):
            least[i] = min(least[j] for j in range(len(ids)) if (prints[i] ^ prints[j]).bit_count() <= 3)
        if before == least:
            return least


def test_fingerprints_and_components(spark):
    data = rows()
    prints, least = brute(data)
    got = simhash.with_groups(spark, frame(spark)).collect()
    assert sorted((r.doc_id, r["__fp"] % 2**64, r["__group"]) for r in got) == sorted(zip([r[0] for r in data], prints, least, strict=True))


def test_forest_joins_what_is_near_even_when_split():
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(40)]
    prints = np.unique(np.array([c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(9)] + centres, np.uint64))
    want = groups([int(x) for x in prints], list(range(len(prints))))
    x, y = simhash.forest(prints, tile=16)
    parent = dict(zip(x.tolist(), y.tolist(), strict=True))
    got = {}
    for i, p in enumerate(prints.tolist()):
        while p in parent:
            p = parent[p]
        got.setdefault(p, []).append(i)
    assert sorted(got.values()) == sorted([i for i in range(len(want)) if want[i] == g] for g in set(want))


def test_large_groups_are_split_and_lose_no_link(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)})
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    slim = spark.createDataFrame(list(enumerate(signed)), "doc_id long, __fp long")
    got = {r["__fp"]: r["__group"] for r in simhash.grouped(spark, slim, group_rows=10).collect()}
    assert [got[s] for s in signed] == groups(prints, list(range(len(prints))))


def test_one_of_each_group_stays(spark):
    data = rows()
    got = simhash.deduplicated(spark, frame(spark)).collect()
    assert sorted(r.doc_id for r in got) == sorted(set(brute(data)[1]))
    assert simhash.deduplicated(spark, frame(spark, [])).count() == 0
    missing = [(None, "a b c", None, None, 1), (None, "a b c", None, None, 1), (None, None, None, None, None), (4, "a b c", None, None, 1)]
    kept = simhash.deduplicated(spark, spark.createDataFrame(missing, SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, ""), (4, "a b c")]


@pytest.mark.parametrize("blocks", simhash.BLOCKS)
def test_any_number_of_blocks_loses_no_link(spark, blocks):
    rng = random.Random(blocks)
    centres = [rng.getrandbits(64) for _ in range(60)] + [0, 2**64 - 1]
    prints = sorted({c ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for c in centres for _ in range(4)} | set(centres))
    signed = [p - 2**64 if p >= 2**63 else p for p in prints]
    pairs = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), len(prints), blocks=blocks)
    root = {r.fp: r.root for r in simhash.components(pairs).collect()}
    found, want = {}, {}
    for p, s, g in zip(prints, signed, groups(prints, list(range(len(prints)))), strict=True):
        found.setdefault(root.get(s, s), set()).add(p)
        want.setdefault(g, set()).add(p)
    assert sorted(map(sorted, found.values())) == sorted(map(sorted, want.values()))


def test_blocks_grow_with_the_corpus():
    assert [simhash.blocks_for(n) for n in (0, 10**6, 10**9, 10**11)] == [4, 4, 5, 6]
    for b in simhash.BLOCKS:  # whichever three blocks differ, some choice holds only others
        edges = [64 * k // b for k in range(b + 1)]
        for hit in itertools.combinations(range(b), 3):
            differ = sum(1 << edges[k] for k in hit)
            assert any(not m & differ for m in simhash.choices(b))
