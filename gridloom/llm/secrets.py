r"""Secret scans by a trigram inverted index. DataFrame functions only.

Each rule's regular expression is turned into a Boolean query: an OR over its ways to match of the AND
of the trigrams that way must contain, in lower case. The index holds postings (trigram, document) for
the trigrams that any query asks for; a query's postings are intersected by document, and only the
candidates are verified with the regular expression. Rules with a way to match that has no mandatory
trigram scan every text. Offsets count code points, ends are exclusive.

Base rules are assign, access and hex, leftmost and without overlap within a kind; the others add
spans of their own kinds. Null texts are empty, and so are the spans of an empty text; very long texts are
scanned whole. Repeated rows share postings and are reported each; rows of one doc_id with different texts
are told apart by the text. Matches of several kinds at one place all count. An empty table gives an
empty result.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table

ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, expression (leftmost matches), and the least length of a group of it, if one is asked for. A run
#: of a class at least so long is the same as the whole run of it, kept if it is that long.
RULES = [
    ("assign", ASSIGN, (2, 6)),
    ("access", r"AKIA[A-Z0-9]{16,}", None),
    ("hex", r"[0-9a-f]{24,}", None),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", None),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", None),
    ("google", r"AIza[A-Za-z0-9_-]{35}", None),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", None),
    ("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", None),
]
BASE = ("assign", "access", "hex")
#: Ways to match that a query tells apart, at most; beyond, the part of the expression counts as unknown.
WAYS = 64
#: Put around matches; in texts it becomes its neighbour, which no rule tells from it.
MARK, PLAIN = "\ue000", "\ue001"

#: Parts of a marked text that are added up at once; even, so that every block begins outside a match.
BLOCK = 512

_GAP = None


def _ways(parsed) -> list[tuple]:
    """The ways to match as sequences of literal strings and gaps of unknown text."""
    ways: list[tuple] = [()]
    for op, arg in parsed:
        if op is sre.LITERAL:
            own = [(chr(arg),)]
        elif op is sre.IN:
            own = _class(arg)
        elif op is sre.SUBPATTERN:
            own = _ways(arg[-1])
        elif op is sre.BRANCH:
            own = [w for branch in arg[1] for w in _ways(branch)]
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, inner = arg
            once = _ways(inner)
            if least == 0 and most == 1:
                own = [(), *once]
            else:
                own = [once[0] * min(least, 3) + (_GAP,)] if len(once) == 1 and least else [(_GAP,)]
        else:
            own = [(_GAP,)]
        if len(ways) * len(own) > WAYS:
            own = [(_GAP,)]
        ways = [a + b for a in ways for b in own]
    return ways


def _class(items) -> list[tuple]:
    chars: set[str] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(chr(arg))
        elif op is sre.RANGE and arg[1] - arg[0] < 8:
            chars.update(map(chr, range(arg[0], arg[1] + 1)))
        else:
            return [(_GAP,)]
    return [(c,) for c in sorted(chars)] if len(chars) <= 8 else [(_GAP,)]


def trigram_query(expression: str) -> list[frozenset[str]]:
    """An OR of ANDs of trigrams in lower case; empty if some way to match has none."""
    clauses = set()
    for way in _ways(sre_parser.parse(expression)):
        runs = "".join("\0" if part is _GAP else part for part in way).lower().split("\0")
        clauses.add(frozenset(run[i : i + 3] for run in runs for i in range(len(run) - 2)))
    if frozenset() in clauses:
        return []
    return sorted((c for c in clauses if not any(o < c for o in clauses)), key=sorted)


QUERIES = {kind: trigram_query(expression) for kind, expression, _ in RULES}
TRIGRAMS = sorted({t for clauses in QUERIES.values() for c in clauses for t in c})


def postings(docs: DataFrame) -> DataFrame:
    """(trigram, doc_id, text_key) for each trigram of the queries that a text contains."""
    lowered = F.array(F.lower(F.coalesce(F.col("text"), F.lit(""))))  # bound by the lambda, so made once
    held = F.transform(lowered, lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), F.lit(t)) for t in TRIGRAMS])))[0]
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), held.alias("held")).select(F.explode("held").alias("trigram"), "doc_id", "text_key")


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, kinds): documents whose postings meet some rule's query, with those rules."""
    spark = docs.sparkSession
    wanted = [(kind, n, t, k, len(c)) for kind, clauses in QUERIES.items() for n, c in enumerate(clauses) for k, t in enumerate(sorted(c))]
    asked = spark.createDataFrame(wanted, "kind string, clause int, trigram string, k int, need int")
    # the queries are as large as the rules, whatever the corpus: safe to broadcast
    met = postings(docs).join(F.broadcast(asked), "trigram").groupBy("doc_id", "text_key", "kind", "clause", "need")
    met = met.agg(F.bit_or(F.expr("shiftleft(1L, k)")).alias("found")).filter(F.bit_count("found") == F.col("need"))
    return met.groupBy("doc_id", "text_key").agg(F.collect_set("kind").alias("kinds"))  # a name for each rule at most


def _spans(text, number: int, expression: str, least):
    """The matches of one rule as (start, kind, end), by marking them and adding up the parts' lengths.

    Every second part is a match. Parts are taken BLOCK at a time, as each step copies what a block has
    found so far: a text of n matches costs n times BLOCK, not n times n."""
    parts = F.split(F.regexp_replace(text, expression, MARK + "$0" + MARK), MARK, -1)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")

    def step(s, part):
        end = s["at"] + F.length(part)
        good = s["on"] if least is None else s["on"] & (F.length(F.regexp_extract(part, expression, least[0])) >= least[1])
        found = F.array(F.struct(s["at"].alias("start"), F.lit(number).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), (~s["on"]).alias("on"), F.when(good, F.concat(s["found"], found)).otherwise(s["found"]).alias("found"))

    def block(own, start):
        return F.aggregate(own, F.struct(start.alias("at"), F.lit(False).alias("on"), none.alias("found")), step, lambda s: s["found"])

    def all_of(own):
        cut = F.transform(F.sequence(F.lit(0), F.size(own) - 1, F.lit(BLOCK)), lambda a: F.slice(own, a + 1, F.lit(BLOCK)))
        sizes = F.transform(cut, lambda b: F.aggregate(b, F.lit(0), lambda n, part: n + F.length(part)))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(sizes, zero, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["starts"], F.array(s["at"])).alias("starts")), lambda s: s["starts"])
        return F.flatten(F.zip_with(cut, starts, block))

    # bound by the lambda, so that texts are marked and split once
    return F.transform(F.array(parts), lambda own: F.when(F.size(own) <= BLOCK, block(own, F.lit(0))).otherwise(all_of(own)))[0]


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, found): the spans (start, kind number, end) of every row of docs, in order."""
    docs = docs.select("doc_id", "text")
    near = candidates(docs).select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "kinds")
    rows = docs.withColumn("text_key", F.xxhash64("text"))
    rows = rows.join(near, F.col("doc_id").eqNullSafe(F.col("__doc")) & (F.col("text_key") == F.col("__key")), "left")
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), MARK, PLAIN)
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    found = []
    for number, (kind, expression, least) in enumerate(RULES):
        # most texts have no match, which a plain search finds out fastest
        likely = F.array_contains("kinds", kind) if QUERIES[kind] else F.col("text").rlike(expression)
        found.append(F.when(likely, _spans(text, number, expression, least)).otherwise(none))
    return rows.select("doc_id", F.array_sort(F.concat(*found)).alias("found"))


def _shown(spans):
    names = F.array(*[F.lit(kind) for kind, _, _ in RULES])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _of_kind(number: int):
    return lambda span: span["kind"] == number


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scanned(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("found", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(BASE)]
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    return out.select("doc_id", *counts, F.sha2(_shown(base).cast("binary"), 256).alias("base_sha256"), _shown(F.col("found")).alias("spans"))


def _sql() -> str:
    quoted = [(k, e.replace("'", "''"), least) for k, e, least in RULES]
    each = " UNION ALL ".join(
        f"SELECT doc_id, id, {n} AS kind, '{k}' AS name, string_split(regexp_replace(t, '{e}', chr(57344) || '\\0' || chr(57344), 'g'), chr(57344)) AS parts FROM d" for n, (k, e, _) in enumerate(quoted)
    )
    return rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS id, translate(coalesce(text, ''), chr(57344), chr(57345)) AS t FROM documents),
m AS ({each}),
p AS (SELECT id, kind, name, generate_subscripts(parts, 1) AS i, unnest(parts) AS part FROM m WHERE len(parts) > 1),
q AS (SELECT *, sum(length(part)) OVER (PARTITION BY id, kind ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS e FROM p),
s AS (
  SELECT id, kind, name || ':' || CAST(e - length(part) AS BIGINT) || ':' || CAST(e AS BIGINT) AS s, e - length(part) AS a FROM q
  WHERE i % 2 = 0 AND (kind <> 0 OR length(regexp_extract(part, '{quoted[0][1]}', 2)) >= 6)
)
SELECT doc_id, count(s) FILTER (WHERE kind = 0) AS n_assign, count(s) FILTER (WHERE kind = 1) AS n_access, count(s) FILTER (WHERE kind = 2) AS n_hex,
  sha256(coalesce(string_agg(s, ',' ORDER BY a, kind) FILTER (WHERE kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY a, kind), '') AS spans
FROM d LEFT JOIN s USING (id) GROUP BY id, doc_id
"""


SQL = _sql()
