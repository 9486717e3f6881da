r"""Quality rules with robust multivariate outliers. DataFrame functions only.

Base rules count symbols, repeated lines and repeated 3-word windows of each whole text. Documents that
pass them are judged by language and source: transformed statistics (FEATURES) form a vector, and the
minimum covariance determinant gives each group's centre and scatter. The estimate starts from medians
and median absolute deviations; every concentration step then keeps the CORE share of the group with
the smallest Mahalanobis distances and takes mean and covariance of those, which lowers the determinant
but for the sketches' error. Small groups lean on their language's pooled estimate, and that on the one of all, by
PRIOR rows; a floor keeps scatters regular where a statistic is constant. Vectors beyond CUT, a
chi-squared quantile, are rejected; the cut is wider for short texts, whose shares vary more.

Groups are only ever aggregates: quantile sketches and moments, so hot groups need no task of their own.
Estimates are written before they are joined: their size is known then, and Spark broadcasts them if small.
Null and empty texts have no words, so fail; null languages and sources are groups of their own. Repeated
rows count and are judged each; vectors at equal distances are all in the core, or none. Counts of very
long texts are exact. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import shielded, table, written

LEAST_WORDS, MOST_REPEATED = 50, 50
FEATURES = ("word_length", "symbols", "upper", "marks", "variety")
#: Added to the variances, in the features' own units.
FLOOR = (0.05, 0.05, 0.05, 0.05, 0.08)
CORE, STEPS, PRIOR = 0.75, 3, 60
#: Share of normal vectors that may be rejected; the cut is the chi-squared quantile there, times 1 + SHORT / words.
REJECTED, SHORT = 1e-4, 100
D = len(FEATURES)
PAIRS = [(i, j) for i in range(D) for j in range(i, D)]


def chi2_cdf(x: float, k: int) -> float:
    """The chi-squared distribution with k degrees of freedom, by the series of the incomplete gamma."""
    term = total = 1 / (k / 2)
    n = 1
    while term > total * 1e-15:
        term *= (x / 2) / (k / 2 + n)
        total, n = total + term, n + 1
    return total * math.exp(-x / 2 + k / 2 * math.log(x / 2) - math.lgamma(k / 2))


def chi2_quantile(share: float, k: int) -> float:
    lo, hi = 1e-6, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < share else (lo, mid)
    return lo


#: What makes the covariance of a normal's core as large as that of the whole.
SCALE = CORE / chi2_cdf(chi2_quantile(CORE, D), D + 2)
CUT = chi2_quantile(1 - REJECTED, D)

#: Bits of a window's code that hold its position, at least; the others are of its hash.
LEAST_WIDTH = 1

_CODES = """
case when size(ws) < 3 then cast(array() as array<bigint>)
else sort_array(transform(sequence(0, size(ws) - 3), i -> shiftleft(xxhash64(ws[i], ws[i + 1], ws[i + 2]), width) | cast(i as bigint))) end
"""
_AT = "cast({} & (shiftleft(1L, width) - 1L) as int)"
#: Of each code: 0 if the hash before it is another, 1 if the words are the same too, 2 if only the hash is.
_SAME = f"""
transform(codes, (x, k) -> case
  when k = 0 or shiftrightunsigned(x, width) <> shiftrightunsigned(codes[k - 1], width) then 0
  when ws[{_AT.format("x")}] = ws[{_AT.format("codes[k - 1]")}] and ws[{_AT.format("x")} + 1] = ws[{_AT.format("codes[k - 1]")} + 1] and ws[{_AT.format("x")} + 2] = ws[{_AT.format("codes[k - 1]")} + 2] then 1
  else 2 end)
"""
#: Positions of repeated windows: from the codes, or from the sorted words themselves where hashes clash.
_FOUND = f"""
if(array_contains(same, 2),
  transform(
    array(sort_array(transform(sequence(0, size(ws) - 3), i -> struct(ws[i] as a, ws[i + 1] as b, ws[i + 2] as c, i as at)))),
    s -> filter(transform(s, (x, k) -> if(
      (k > 0 and struct(x.a, x.b, x.c) = struct(s[k - 1].a, s[k - 1].b, s[k - 1].c)) or (k < size(s) - 1 and struct(x.a, x.b, x.c) = struct(s[k + 1].a, s[k + 1].b, s[k + 1].c)),
      x.at, -1)), p -> p >= 0))[0],
  filter(transform(codes, (x, k) -> if(same[k] = 1 or (k < size(codes) - 1 and same[k + 1] = 1), {_AT.format("x")}, -1)), p -> p >= 0))
"""
_REPEATS = "aggregate(sort_array(found), struct(0L as n, -9 as last), (s, p) -> struct(s.n + least(3, p - s.last) as n, p as last), s -> s.n)"


def _count(pattern: str):
    """Characters of a class; what is left when all others go."""
    return F.length(F.regexp_replace("t", pattern, "")).cast("long")


def counted(docs: DataFrame, keep: list) -> DataFrame:
    """The columns keep of docs, the base counts, base_failed and the features.

    A window's code is its hash with its position in the lowest bits, so sorting brings equal windows
    together. The words of neighbours with equal hashes are compared; where any differ, as in texts so
    long that few bits are left for the hash, the text's windows are sorted by their words instead."""
    out = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("t"))
    out = out.withColumn("ws", F.array_remove(F.split("t", r"[\x20\x09-\x0D]+", -1), ""))
    out = out.withColumn("width", F.greatest(F.length(F.bin(F.size("ws"))), F.lit(LEAST_WIDTH))).withColumn("codes", F.expr(_CODES)).withColumn("same", F.expr(_SAME)).withColumn("found", F.expr(_FOUND))
    lines = F.filter(F.split("t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumns({
        "n_words": F.size("ws").cast("long"),
        "word_chars": _count(r"[\x20\x09-\x0D]+"),
        "n_symbols": _count(r"[^#*$%&|<>]+"),
        "n_dup_lines": F.transform(F.array(lines), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))[0],
        "n_repeat_words": F.expr(_REPEATS),
        "n_upper": F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", "")),
        "n_marks": _count(r"[^!?:;=@~^_\\/{}\[\]()+]+"),
        "n_distinct": F.size(F.array_distinct("ws")),
    })
    out = out.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED))
    n = F.col("n_words") + 1.0
    values = {
        "word_length": F.ln((F.col("word_chars") + 1) / n) * 2,
        "symbols": F.sqrt(F.col("n_symbols") / n),
        "upper": F.sqrt(F.col("n_upper") / (F.col("word_chars") + 1)),
        "marks": F.sqrt(F.col("n_marks") / n),
        "variety": F.ln(F.col("n_distinct") + 1.0) / F.ln(n + 1),
    }
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    return out.select(*[c for c in out.columns[: len(keep)]], *names, *[values[f].alias(f) for f in FEATURES])


def _moments(rows: DataFrame) -> DataFrame:
    """Mean m{i} and covariance c{i}{j} of the features, and n, for each group."""
    means = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
    covariances = [(F.covar_pop(FEATURES[i], FEATURES[j]) * SCALE).alias(f"c{i}{j}") for i, j in PAIRS]
    return rows.groupBy("__lang", "__group").agg(F.count("*").alias("n"), *means, *covariances)


def _first(rows: DataFrame) -> DataFrame:
    """The same from medians and median absolute deviations, without covariances."""
    middle = written(rows.groupBy("__lang", "__group").agg(F.count("*").alias("n"), *[F.percentile_approx(f, F.lit(0.5), F.lit(1000)).alias(f"m{i}") for i, f in enumerate(FEATURES)]), "middle")
    away = rows.join(middle, ["__lang", "__group"]).groupBy("__lang", "__group").agg(*[F.percentile_approx(F.abs(F.col(f) - F.col(f"m{i}")), F.lit(0.5), F.lit(1000)).alias(f"a{i}") for i, f in enumerate(FEATURES)])
    out = middle.join(away, ["__lang", "__group"])
    return out.select("__lang", "__group", "n", *[f"m{i}" for i in range(D)], *[(F.pow(F.col(f"a{i}") * 1.4826, 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in PAIRS])


def _leaning(groups: DataFrame) -> DataFrame:
    """Each group's estimate drawn towards its language's, and that towards the one of all, which is one
    row on the driver."""
    values = [f"m{i}" for i in range(D)] + [f"c{i}{j}" for i, j in PAIRS]
    sums = [F.sum("n").alias("__n"), *[F.sum(F.col(v) * F.col("n")).alias(f"__{v}") for v in values]]
    wide = groups.agg(*sums).first()
    langs = groups.groupBy("__lang").agg(*sums)
    mid = {v: (F.col(f"__{v}") + F.lit(PRIOR * (wide[f"__{v}"] or 0.0) / (wide["__n"] or 1))) / (F.col("__n") + PRIOR) for v in values}
    leant = {v: (F.col(v) * F.col("n") + mid[v] * PRIOR) / (F.col("n") + PRIOR) for v in values}
    floors = {f"c{i}{j}": FLOOR[i] ** 2 if i == j else 0.0 for i, j in PAIRS}
    return groups.join(langs, "__lang").select("__group", *[(leant[v] + F.lit(floors.get(v, 0.0))).alias(v) for v in values])


def _inverse(groups: DataFrame) -> DataFrame:
    """The precision matrix p{i}{j} of each group by Gauss-Jordan elimination, column expressions only."""
    at = lambda a, i, j: F.col(f"{a}{min(i, j)}{max(i, j)}")
    rows = F.array(*[F.array(*[at("c", i, j) for j in range(D)], *[F.lit(float(i == j)) for j in range(D)]) for i in range(D)])
    groups = groups.withColumn("a", rows)
    for k in range(D):
        pivot = groups["a"][k][k]
        groups = groups.withColumn("r", F.transform(groups["a"][k], _over(pivot)))
        groups = groups.withColumn("a", F.array(*[F.col("r") if i == k else F.zip_with(F.col("a")[i], F.transform("r", _times(F.col("a")[i][k])), lambda x, y: x - y) for i in range(D)]))
    return groups.select("__group", *[f"m{i}" for i in range(D)], *[F.col("a")[i][D + j].alias(f"p{i}{j}") for i, j in PAIRS])


def _over(pivot):
    return lambda x: x / pivot


def _times(factor):
    return lambda x: x * factor


def _distances(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows with d2, the squared Mahalanobis distance to their group."""
    z = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(FEATURES)]
    d2 = sum((z[i] * z[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0) for i, j in PAIRS), F.lit(0.0))
    return rows.join(groups, "__group", "left").withColumn("d2", d2).select(*[rows[c] for c in rows.columns], "d2")


def grouped(rows: DataFrame) -> DataFrame:
    """rows (with lang and source) and names for their groups, null told from every text."""
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in ("lang", "source"))
    return rows.withColumn("__lang", lang).withColumn("__group", F.concat_ws("\n", lang, source))


def estimates(rows: DataFrame) -> DataFrame:
    """Centre and precision of each group of rows, by concentration steps from a robust start."""
    groups = written(_inverse(_leaning(written(_first(rows), "moments"))), "groups")
    for _ in range(STEPS):
        near = _distances(rows, groups)
        core = written(near.groupBy("__group").agg(F.percentile_approx("d2", F.lit(CORE), F.lit(2000)).alias("most")), "core")
        moments = written(_moments(near.join(core, "__group").filter("d2 <= most")), "moments")
        groups = written(_inverse(_leaning(moments)), "groups")
    return groups


def judged(docs: DataFrame) -> DataFrame:
    """For each row of docs: doc_id, text_key, lang, source, the base counts, base_failed, d2 and kept."""
    keep = [F.col("doc_id"), F.xxhash64("text").alias("text_key"), F.col("lang"), F.col("source")]
    rows = written(grouped(counted(docs.select("doc_id", "text", "lang", "source"), keep)), "features")
    groups = estimates(rows.filter("not base_failed"))
    near = _distances(rows, groups)
    fine = F.coalesce(F.col("d2") <= CUT * (1 + SHORT / (F.col("n_words") + 1)), F.lit(True))
    return near.withColumn("kept", ~F.col("base_failed") & fine)


@shielded
def cleaned(docs: DataFrame) -> DataFrame:
    """The documents kept, with their columns as they were."""
    good = judged(docs).filter("kept").select(*[F.col(c).alias(f"__{c}") for c in ("doc_id", "text_key", "lang", "source")])
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in ("doc_id", "lang", "source")]
    return docs.join(good, (F.xxhash64(docs["text"]) == F.col("__text_key")) & same[0] & same[1] & same[2], "left_semi")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
