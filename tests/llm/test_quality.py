import re
import unicodedata
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import quality
from tests.llm.data import SCHEMA, frame, rows

HERE = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    grams = Counter(zip(words, words[1:], words[2:], strict=False))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_counts_as_brute_force(spark):
    data = rows() + [(800, "a b c\na b c\n\na b c d a b c |", None, None, 1), (801, "x y x y x y " * 40, "en", "s1", 1)]
    got = quality.judged(frame(spark, data)).collect()
    want = []
    for r in data:
        n = counts(r[1])
        want.append((r[0], *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == sorted(want)
    assert all(not (r.kept and r.base_failed) for r in got)


def test_estimates_are_those_of_numpy(spark):
    """The same steps over arrays: robust start, core by distance, shrinkage; with exact quantiles."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(0, 1, (300, quality.D)), rng.normal(8, 1, (60, quality.D))])
    df = spark.createDataFrame([("en", "s", *map(float, r)) for r in x], ["lang", "source", *quality.FEATURES])
    got = quality.estimates(quality.grouped(df)).first()
    n, floor = len(x), np.diag(np.array(quality.FLOOR) ** 2)
    low = lambda v, q: np.sort(v, axis=0)[int(np.ceil(q * len(v))) - 1]
    mean = low(x, 0.5)
    cov = np.diag((1.4826 * low(np.abs(x - mean), 0.5)) ** 2)
    for step in range(quality.STEPS + 1):
        inverse = np.linalg.inv(cov + floor)
        if step == quality.STEPS:
            break
        d2 = np.einsum("ij,jk,ik->i", x - mean, inverse, x - mean)
        core = x[d2 <= low(d2, quality.CORE)]
        mean, cov = core.mean(0), np.cov(core.T, bias=True) * quality.SCALE
    assert np.allclose([got[f"m{i}"] for i in range(quality.D)], mean, atol=1e-6) and n == 360
    assert np.allclose([got[f"p{i}{j}"] for i, j in quality.PAIRS], [inverse[i, j] for i, j in quality.PAIRS], rtol=1e-6)


def test_junk_goes_and_clean_documents_stay(spark):
    got = {r.doc_id: r for r in quality.judged(spark.read.parquet(f"{HERE}/documents.parquet")).collect()}
    labels = spark.read.parquet(f"{HERE}/labels.parquet").collect()
    clean = [got[r.doc_id].kept for r in labels if r.quality == 1 and not got[r.doc_id].base_failed]
    junk = [got[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean(clean) > 0.99 and np.mean(junk) < 0.1


def test_kept_documents_keep_their_columns(spark):
    docs = frame(spark)
    kept = {r.doc_id for r in quality.judged(docs).filter("kept").collect()}
    out = quality.cleaned(docs)
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    assert quality.cleaned(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chi_squared():
    assert quality.chi2_cdf(9.236, 5) == pytest.approx(0.9, abs=1e-4) and quality.chi2_cdf(2.0, 2) == pytest.approx(1 - np.exp(-1))


def test_no_python_on_executors(spark):
    plan = quality.query(spark, HERE)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and F is not None


@pytest.mark.parametrize("width", [1, 61])
def test_counts_are_exact_where_hashes_clash(spark, monkeypatch, width):
    monkeypatch.setattr(quality, "LEAST_WIDTH", width)  # 61: three bits are left for the hash
    data = rows(25) + [(800, "a b c\na b c\n\na b c d a b c |", None, None, 1), (801, "x y x y x y " * 40, "en", "s1", 1), (802, "a a a", "en", "s1", 1)]
    got = quality.counted(frame(spark, data), [F.col("doc_id")]).collect()
    assert sorted((r.doc_id, r.n_repeat_words) for r in got) == sorted((r[0], counts(r[1])[-1]) for r in data)


def test_counts_of_a_text_of_a_million_words(spark):
    words = [f"w{i}" for i in range(1_000_000)]
    words[700_000:700_003] = words[5:8]
    words[900_000:900_004] = words[6:10]
    got = quality.counted(spark.createDataFrame([(1, " ".join(words))], "doc_id long, text string"), [F.col("doc_id")]).first()
    assert (got.n_words, got.n_repeat_words) == (1_000_000, 3 + 4 + 5)  # words 5 to 9 and their two copies


def plain_features(text):
    text = text or ""
    n, chars, symbols, _, _ = counts(text)
    upper = sum(unicodedata.category(c) == "Lu" for c in text)
    marks = len(re.findall(r"[!?:;=@~^_\\/{}\[\]()+]", text))
    distinct = len({w for w in re.split("[\x20\x09-\x0d]+", text) if w})
    return [2 * np.log((chars + 1) / (n + 1)), np.sqrt(symbols / (n + 1)), np.sqrt(upper / (chars + 1)), np.sqrt(marks / (n + 1)), np.log(distinct + 1) / np.log(n + 2)]


def test_kept_is_what_plain_code_keeps(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{HERE}/documents.parquet").select("doc_id", "text", "lang", "source").collect()]
    docs += [(9001, None, None, None), (9002, "", "en", None)]
    x, lang, group, base, size = [], [], [], [], []
    for _, text, la, source in docs:
        n = counts(text)
        x.append(plain_features(text))
        lang.append(la)
        group.append((la, source))
        base.append(n[0] < 50 or 100 * n[4] > 50 * n[0])
        size.append(n[0])
    x, base = np.array(x), np.array(base)
    low = lambda v, q: np.sort(v, axis=0)[int(np.ceil(q * len(v))) - 1]
    of = {g: np.array([i for i, h in enumerate(group) if h == g and not base[i]]) for g in set(group)}
    of = {g: at for g, at in of.items() if len(at)}

    def leant(est):
        def mean(gs):
            total = sum(est[g][0] for g in gs)
            return total, [sum(est[g][k] * est[g][0] for g in gs) for k in (1, 2)]

        n, sums = mean(est)
        wide, out = [s / n for s in sums], {}
        for g, (own, m, c) in est.items():
            k, sums = mean([h for h in est if h[0] == g[0]])
            mid = [(s + quality.PRIOR * w) / (k + quality.PRIOR) for s, w in zip(sums, wide, strict=True)]
            m, c = ((v * own + quality.PRIOR * w) / (own + quality.PRIOR) for v, w in zip((m, c), mid, strict=True))
            out[g] = m, np.linalg.inv(c + np.diag(np.array(quality.FLOOR) ** 2))
        return out

    d2 = lambda at, m, inverse: np.einsum("ij,jk,ik->i", x[at] - m, inverse, x[at] - m)
    est = {g: (len(at), m := low(x[at], 0.5), np.diag((1.4826 * low(np.abs(x[at] - m), 0.5)) ** 2)) for g, at in of.items()}
    for _ in range(quality.STEPS):
        fitted, core = leant(est), {}
        for g, at in of.items():
            far = d2(at, *fitted[g])
            core[g] = x[at[far <= low(far, quality.CORE)]]
        est = {g: (len(c), c.mean(0), np.cov(c.T, bias=True).reshape(quality.D, quality.D) * quality.SCALE) for g, c in core.items()}
    fitted, want = leant(est), {}
    for i, (doc, *_) in enumerate(docs):
        far = d2(np.array([i]), *fitted[group[i]])[0] if group[i] in fitted else 0.0
        want[doc] = not base[i] and bool(far <= quality.CUT * (1 + quality.SHORT / (size[i] + 1)))
    got = quality.judged(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")).collect()
    assert {r.doc_id: r.kept for r in got} == want and 0 < sum(want.values()) < len(docs)
