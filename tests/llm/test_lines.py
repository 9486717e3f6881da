from collections import defaultdict

from gridloom.llm import lines
from tests.llm.data import SCHEMA, frame, rows


def brute(data):
    docs = {(r[0], r[1]): (r[1] or "").split("\n") for r in data}
    masked = {(d, i): ["<*>" if any(c in "0123456789" for c in t) else t for t in x.split()] for d, xs in docs.items() for i, x in enumerate(xs) if x.split()}
    reach, kinds = defaultdict(set), defaultdict(set)
    leaf = lambda ts: (len(ts), tuple(ts[:3]))
    for (d, _), ts in masked.items():
        reach[leaf(ts)].add(d)
        kinds[tuple(ts)].add(d)
    support = defaultdict(int)
    for ts, ds in kinds.items():
        for j, t in enumerate(ts):
            support[leaf(ts), j, t] += len(ds)
    of = {}
    for ts in kinds:
        if len(reach[leaf(ts)]) >= lines.MIN_DOCS:
            general = tuple(t if t != "<*>" and (j < 3 or support[leaf(ts), j, t] >= lines.MIN_DOCS) else None for j, t in enumerate(ts))
            of[ts] = general if sum(t is not None for t in general) >= lines.SIMILAR * len(ts) else ("exact", ts)
    recur = defaultdict(set)
    for (d, _), ts in masked.items():
        if tuple(ts) in of:
            recur[of[tuple(ts)]].add(d)
    gone = {k for k, ts in masked.items() if tuple(ts) in of and len(recur[of[tuple(ts)]]) >= lines.MIN_DOCS}
    return sorted((r[0], sum(bool(x.split()) for x in docs[r[0], r[1]]), sum(((r[0], r[1]), i) in gone for i in range(len(docs[r[0], r[1]]))), "\n".join(x for i, x in enumerate(docs[r[0], r[1]]) if ((r[0], r[1]), i) not in gone)) for r in data)


def test_as_brute_force(spark):
    data = rows()
    for i in range(12):
        text = f"own line number {'abcdefghijkl'[i]} of this\n\nOrder no {i} was sent to you today\nvisit the shop of {'xyz'[i % 3]}{'uvw'[i // 4]} now and again soon\n{'abcdefghijkl'[i] * 3} stays\nlast {i}"
        data.append((700 + i, text, "en", "s", len(text)))
    got = sorted((r.doc_id, r["__lines"], r["__dropped"], r["__text"] or "") for r in lines.cleaned(frame(spark, data)).collect())
    want = brute(data)
    assert got == want and any(0 < w[2] < w[1] for w in want)


def test_no_documents(spark):
    assert lines.cleaned(spark.createDataFrame([], SCHEMA)).count() == 0
