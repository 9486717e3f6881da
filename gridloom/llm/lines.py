r"""Line dedup by a log-template tree: lines of templates that recur across documents are dropped.

A line's tokens are its white-space-separated parts, those with a digit taken as variable (<*>). The
tree has fixed depth: a leaf is the number of tokens and the first DEPTH of them. In a leaf that enough
documents reach, a token further on is constant if at its place at least MIN_DOCS different documents
have it (as counted by different lines of the leaf, each with its documents), and generalises to <*>
otherwise. If at least SIMILAR of a line's tokens are constant, the generalised line is its template;
otherwise the line as masked at first is. Templates of at least MIN_DOCS documents recur, and all their
lines go. Unlike a parser that reads one line after the other, this depends on no order.

Only hashes of lines are shuffled, but for the lines of leaves that recur, whose tokens are counted once
for each different line. Documents, lines and leaves are known by 64-bit hashes: a clash would treat two
as one. Blank lines stay. Null and empty texts have no lines; very long texts are split whole. Rows that
repeat a document count as one document and are treated alike, so ties need no rule. An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import table, written

DEPTH, MIN_DOCS, SIMILAR = 3, 4, 0.7
VARIABLE = "<*>"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, line, masked, leaf, exact) for each line that is not blank; masked has its tokens parted by
    single spaces. Regular expressions run only over lines that need them."""
    doc = F.xxhash64("doc_id", "text").alias("doc")
    split = docs.select(doc, F.posexplode(F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)).alias("line", "own"))
    plain = F.when(F.col("own").rlike(r"[\x09-\x0D]|  |^ | $"), F.trim(F.regexp_replace("own", r"[\x20\x09-\x0D]+", " "))).otherwise(F.col("own"))
    masked = F.when(F.col("plain").rlike("[0-9]"), F.regexp_replace("plain", r"(?<![^ ])[^ 0-9]*+[0-9][^ ]*+", VARIABLE)).otherwise(F.col("plain"))
    out = split.select("doc", "line", plain.alias("plain")).filter("plain <> ''").select("doc", "line", masked.alias("masked"))
    size = F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit("")))
    return out.select("doc", "line", "masked", F.xxhash64(size, F.substring_index("masked", " ", DEPTH)).alias("leaf"), F.xxhash64("masked").alias("exact"))


def _recurring(pairs: DataFrame, key: str) -> DataFrame:
    """Values of key that at least MIN_DOCS documents have."""
    return pairs.select(key, "doc").distinct().groupBy(key).agg(F.count("*").alias("docs")).filter(F.col("docs") >= MIN_DOCS)


def dropped(docs: DataFrame) -> DataFrame:
    """(doc, lines): of each document that loses lines, their numbers from 0 on."""
    slim = written(_lines(docs), "lines")
    # written, so that their size is known: few leaves are broadcast and filter lines before these are
    # shuffled; many meet lines that are distinct by then, so that a hot leaf can be split
    leaves = written(_recurring(slim, "leaf").select("leaf"), "leaves")
    counts = slim.select("exact", "doc").distinct().groupBy("exact").agg(F.count("*").alias("docs"))
    kinds = slim.select("leaf", "exact", "masked").distinct().join(leaves, "leaf", "left_semi")
    kinds = written(kinds.join(counts, "exact").select("leaf", "exact", "docs", F.split("masked", " ").alias("tokens")), "line-kinds")
    # all lines of a leaf have its leading tokens: these are not counted, and meet nothing
    later = F.slice("tokens", DEPTH + 1, F.greatest(F.size("tokens") - DEPTH, F.lit(0)))
    placed = kinds.select("leaf", "exact", "docs", F.posexplode(later).alias("place", "token"))
    support = placed.groupBy("leaf", "place", "token").agg(F.sum("docs").alias("support")).filter((F.col("support") >= MIN_DOCS) & (F.col("token") != VARIABLE))
    # aggregates are written before rows meet them: so the adaptive planner can split a hot key of the rows
    judged = placed.join(written(support, "support"), ["leaf", "place", "token"], "left").withColumn("place", F.col("place") + DEPTH)
    leading = kinds.select("leaf", "exact", F.posexplode(F.slice("tokens", 1, DEPTH)).alias("place", "token"))
    judged = judged.select("leaf", "exact", "place", "token", F.col("support").isNotNull().alias("constant")).unionByName(leading.withColumn("constant", F.col("token") != VARIABLE))
    constant = F.col("constant")
    shapes = judged.groupBy("leaf", "exact").agg(F.sort_array(F.collect_list(F.struct("place", F.when(constant, F.col("token")).alias("token")))).alias("ts"))  # one line's tokens
    fixed = F.size(F.filter("ts", lambda t: t["token"].isNotNull()))
    general = F.transform("ts", lambda t: F.coalesce(t["token"], F.lit(VARIABLE)))
    template = F.when(fixed >= F.size("ts") * SIMILAR, F.xxhash64("leaf", general)).otherwise(F.xxhash64(F.lit("exact"), "exact"))
    shapes = written(shapes.select("exact", template.alias("template")), "shapes")
    found = written(slim.join(shapes, "exact").select("doc", "line", "template"), "templates")
    gone = found.join(written(_recurring(found, "template").select("template"), "recurring"), "template", "left_semi")
    return gone.groupBy("doc").agg(F.sort_array(F.collect_set("line")).alias("lines"))  # one document's lines


def cleaned(docs: DataFrame) -> DataFrame:
    """docs with __lines (lines not blank), __dropped and __text, the text without the dropped lines."""
    gone = dropped(docs.select("doc_id", "text"))
    out = docs.join(gone.select(F.col("doc").alias("__doc"), F.col("lines").alias("__gone")), F.xxhash64(docs["doc_id"], docs["text"]) == F.col("__doc"), "left")
    parts = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    left = F.filter(parts, lambda x, i: ~F.array_contains("__gone", i))
    out = out.withColumn("__text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    out = out.withColumn("__lines", F.size(F.filter(parts, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long"))
    return out.withColumn("__dropped", F.coalesce(F.size("__gone"), F.lit(0)).cast("long")).drop("__doc", "__gone")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = cleaned(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), F.sha2(F.coalesce("__text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


SQL = rf"""
WITH l AS (
  SELECT doc_id, generate_subscripts(parts, 1) - 1 AS line, unnest(parts) AS own FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), t AS (
  SELECT doc_id, line, own, list_filter(regexp_split_to_array(regexp_replace(own, '[^\x20\x09-\x0D]*[0-9][^\x20\x09-\x0D]*', '<*>', 'g'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ts FROM l
), e AS (SELECT *, len(ts) || ' ' || array_to_string(ts[1:{DEPTH}], ' ') AS leaf, array_to_string(ts, ' ') AS exact FROM t WHERE len(ts) > 0),
k AS (
  SELECT leaf, exact, any_value(ts) AS ts, count(DISTINCT doc_id) AS docs FROM e
  WHERE leaf IN (SELECT leaf FROM e GROUP BY leaf HAVING count(DISTINCT doc_id) >= {MIN_DOCS}) GROUP BY leaf, exact
), p AS (SELECT leaf, exact, docs, generate_subscripts(ts, 1) - 1 AS place, unnest(ts) AS token FROM k),
s AS (SELECT *, (place < {DEPTH} OR sum(docs) OVER (PARTITION BY leaf, place, token) >= {MIN_DOCS}) AND token <> '{VARIABLE}' AS fixed FROM p),
g AS (
  SELECT exact, CASE WHEN count(*) FILTER (WHERE fixed) >= count(*) * {SIMILAR}::DOUBLE THEN 'g ' || string_agg(CASE WHEN fixed THEN token ELSE '{VARIABLE}' END, ' ' ORDER BY place) ELSE 'e ' || exact END AS template
  FROM s GROUP BY leaf, exact
), f AS (SELECT e.doc_id, e.line, g.template FROM e JOIN g USING (exact)),
gone AS (SELECT DISTINCT doc_id, line FROM f WHERE template IN (SELECT template FROM f GROUP BY template HAVING count(DISTINCT doc_id) >= {MIN_DOCS}))
SELECT d.doc_id, (SELECT count(*) FROM e WHERE e.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM gone WHERE gone.doc_id = d.doc_id) AS n_dropped,
  sha256(coalesce((SELECT string_agg(l.own, chr(10) ORDER BY l.line) FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line = l.line WHERE l.doc_id = d.doc_id AND gone.line IS NULL), '')) AS kept_sha256
FROM documents d
"""
