"""Documents as ordered blocks: sections, their schema, validation and planning, list labels.

blocks: (doc_id, ord, level, text), level 0 for text and 1 on for headings.
"""

from __future__ import annotations

import functools
from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.text import title_key


def from_headings(blocks: DataFrame) -> DataFrame:
    """(doc_id, key, title, first, last, depth, parent) for each heading: it lasts until the next heading
    of its level or a higher one. Keys that a document repeats get -2, -3, ... Of each document the last
    heading of every level is carried along in an array, so nothing but a heading's levels is held for it."""
    heads = blocks.filter("level > 0")
    ends = blocks.groupBy("doc_id").agg(F.max("ord").alias("__end"))
    top = heads.agg(F.max("level")).first()[0] or 0  # levels are few
    by_doc = Window.partitionBy("doc_id").orderBy("ord")
    ahead = by_doc.rowsBetween(1, Window.unboundedFollowing)
    behind = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    base = title_key(F.col("text"))
    nth = F.row_number().over(Window.partitionBy("doc_id", base).orderBy("ord"))
    out = heads.withColumn("key", F.when(nth == 1, base).otherwise(F.concat(base, F.lit("-"), nth.cast("string"))))
    # the next heading that ends one of a level is the next of that level or a higher one
    stop = functools.reduce(lambda rest, k: F.when(F.col("level") == k, F.min(F.when(F.col("level") <= k, F.col("ord"))).over(ahead)).otherwise(rest), range(1, top + 1), F.lit(None).cast("int"))
    out = out.withColumn("__stop", stop)
    # a level's last heading is an ancestor if none of a higher level, and none of it, has ended it since
    lasts = [F.max_by(F.when(F.col("level") == k, F.struct("ord", "key")), F.when(F.col("level") == k, F.col("ord"))).over(behind) for k in range(1, top)]
    out = out.withColumns({f"__l{k}": x for k, x in enumerate(lasts, 1)})
    none = F.lit(None).cast(out.schema["__l1"].dataType) if lasts else F.lit(None)
    ups: list = []
    for k in range(1, top):
        higher = [F.coalesce(F.col(f"__l{j}.ord"), F.lit(-1)) for j in range(1, k)]
        open_ = F.col(f"__l{k}").isNotNull() & (F.col("level") > k)
        if higher:
            open_ = open_ & (F.col(f"__l{k}.ord") > (F.greatest(*higher) if len(higher) > 1 else higher[0]))
        ups.append(F.when(open_, F.col(f"__l{k}")).otherwise(none))
    chain = F.array_compact(F.array(*ups)) if ups else None
    depth = F.size(chain) if ups else F.lit(0)
    parent = F.try_element_at(chain, F.lit(-1))["key"] if ups else F.lit(None).cast("string")
    joined = out.withColumns({"__depth": depth, "__parent": parent}).join(ends, "doc_id")
    return joined.select("doc_id", "key", F.col("text").alias("title"), F.col("ord").alias("first"), F.coalesce(F.col("__stop") - 1, F.col("__end")).alias("last"), F.col("__depth").alias("depth"), F.col("__parent").alias("parent"))


def contents(blocks: DataFrame, sections: DataFrame) -> DataFrame:
    """(doc_id, key, content): the texts inside each section in order, joined by line breaks."""
    own = sections.select(F.col("doc_id").alias("__doc"), "key", F.col("first").alias("__first"), F.col("last").alias("__last"))
    rows = blocks.join(own, (F.col("doc_id") == F.col("__doc")) & F.col("ord").between(F.col("__first") + 1, F.col("__last"))).select("doc_id", "key", "ord", "text")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"])
    return rows.groupBy("doc_id", "key").agg(F.array_join(ordered, "\n").alias("content"))


def longest_rising(xs: list[int]) -> set[int]:
    """Places of the longest strictly rising run within xs that ends first, and of those the one whose places
    before come first. Runs of one length end in falling values, so each pile is searched by halves."""
    piles: list[tuple[list[int], list[int]]] = []  # of each length: the ends' values, negated, and places
    before: list[int | None] = []
    for i, x in enumerate(xs):
        lo, hi = 0, len(piles)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if -piles[mid][0][-1] < x else (lo, mid)
        if lo == len(piles):
            piles.append(([], []))
        before.append(piles[lo - 1][1][bisect_right(piles[lo - 1][0], -x)] if lo else None)
        piles[lo][0].append(-x)
        piles[lo][1].append(i)
    out, i = set(), piles[-1][1][0] if piles else None
    while i is not None:
        out.add(i)
        i = before[i]
    return out


#: Sections of a schema at most: it is a table of a document type, held whole.
MOST_SECTIONS = 10_000


def schema_rows(schema: DataFrame) -> list[dict]:
    """The sections of a schema (pos, key, parent, optional) in order. Keys are unique, parents come first."""
    rows = [r.asDict() for r in schema.limit(MOST_SECTIONS + 1).collect()]
    if len(rows) > MOST_SECTIONS:
        raise ValueError(f"a schema of more than {MOST_SECTIONS} sections")
    rows = sorted(({"parent": None} | r for r in rows), key=lambda r: r["pos"])
    seen: set[str] = set()
    for r in rows:
        if r["key"] in seen or r["parent"] is not None and r["parent"] not in seen:
            raise ValueError(f"a section twice, or before its parent: {r['key']}")
        seen.add(r["key"])
    return rows


def validated(sections: DataFrame, schema: DataFrame, empty: DataFrame | None = None) -> DataFrame:
    """(doc_id, key, issue) against a schema: missing, duplicated, unexpected; parent, order and (of required
    ones) empty as the first section of a key in the document has it. empty: (doc_id, key) of empty sections."""
    rows = schema_rows(schema)
    known = sections.sparkSession.createDataFrame([(r["pos"], r["key"], r["parent"], r["optional"]) for r in rows], "pos int, __want string, __parent string, __optional boolean")
    listed, required = (F.array(*[F.lit(r["key"]) for r in rows if not r["optional"] or every]).cast("array<string>") for every in (True, False))
    # a schema is bounded, see above: a document's listed keys fit one array, and the schema may be broadcast
    have = sections.groupBy("doc_id").agg(F.collect_set(F.when(F.array_contains(listed, F.col("key")), F.col("key"))).alias("__have"))
    missing = have.select("doc_id", F.explode(F.array_except(required, "__have")).alias("key"))
    counts = sections.groupBy("doc_id", "key").agg(F.count("*").alias("n"), F.min_by(F.struct("first", "parent"), "first").alias("__first"))
    placed = counts.join(F.broadcast(known), F.col("key") == F.col("__want"), "left")
    own = placed.filter("__want is not null")
    issue = lambda df, name: df.select("doc_id", "key", F.lit(name).alias("issue"))
    parts = [
        issue(missing, "missing"),
        issue(own.filter("n > 1"), "duplicated"),
        issue(placed.filter("__want is null"), "unexpected"),
        issue(own.filter(~F.col("__first.parent").eqNullSafe(F.col("__parent"))), "parent"),
    ]

    @F.pandas_udf("array<string>")
    def disorder(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            fine = longest_rising([x["pos"] for x in group])
            out.append([x["key"] for i, x in enumerate(group) if i not in fine])
        return pd.Series(out)

    # siblings of a schema in the document's order: as many as the schema has at most
    siblings = own.groupBy("doc_id", "__parent").agg(F.sort_array(F.collect_list(F.struct(F.col("__first.first").alias("first"), "pos", "key"))).alias("__group"))
    several = siblings.filter(F.size("__group") > 1)
    parts.append(issue(several.select("doc_id", F.explode(disorder("__group")).alias("key")), "order"))
    if empty is not None:
        wanted = own.filter("not __optional").select("doc_id", "key")
        parts.append(issue(wanted.join(empty.select("doc_id", "key").distinct(), ["doc_id", "key"], "left_semi"), "empty"))
    return functools.reduce(DataFrame.unionByName, parts)


def plan_of(rows: list[dict], present: frozenset[str], optional: bool = False) -> list[tuple[str, str, str | None, int]]:
    """(key, place, relative_to, depth) of each section that is missing beside those present, in the order of the
    schema: after the nearest sibling ahead of it that is there or planned, else before the next one that is there,
    else inside its parent, else at the end. Sections of a parent that will not be there are left out."""
    there, depth, out = set(present), {}, []
    for at, r in enumerate(rows):
        depth[r["key"]] = 0 if r["parent"] is None else depth[r["parent"]] + 1
        if r["key"] in there or (r["optional"] and not optional) or (r["parent"] is not None and r["parent"] not in there):
            continue
        ahead = [x["key"] for x in rows[:at] if x["parent"] == r["parent"] and x["key"] in there]
        behind = [x["key"] for x in rows[at + 1 :] if x["parent"] == r["parent"] and x["key"] in present]
        place = ("after", ahead[-1]) if ahead else ("before", behind[0]) if behind else ("inside", r["parent"]) if r["parent"] is not None else ("end", None)
        out.append((r["key"], *place, depth[r["key"]]))
        there.add(r["key"])
    return out


def planned(sections: DataFrame, schema: DataFrame, optional: bool = False) -> DataFrame:
    """(doc_id, nth, key, place, relative_to, depth): where missing sections go, see plan_of(). Documents that hold the
    same sections share a plan, which each task makes once."""
    rows = schema_rows(schema)
    listed = F.array(*[F.lit(r["key"]) for r in rows]).cast("array<string>")
    have = sections.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.when(F.array_contains(listed, F.col("key")), F.col("key")))).alias("__have"))

    @F.pandas_udf("array<struct<key: string, place: string, relative_to: string, depth: int>>")
    def plans(present: pd.Series) -> pd.Series:
        made: dict = {}
        names = ("key", "place", "relative_to", "depth")
        return present.map(lambda x: made[k] if (k := frozenset(x)) in made else made.setdefault(k, [dict(zip(names, p, strict=True)) for p in plan_of(rows, k, optional)]))

    return have.select("doc_id", F.posexplode(plans("__have")).alias("nth", "p")).select("doc_id", "nth", "p.*")


def labels(items: DataFrame) -> DataFrame:
    """items (doc_id, ord, list_id, level) with number, its place in its list and level; deeper levels start
    again where a shallower one goes on."""
    w = Window.partitionBy("doc_id", "list_id").orderBy("ord")
    top = items.agg(F.max("level")).first()[0] or 0
    out = items
    for k in range(top):  # how often a shallower level has come by so far
        out = out.withColumn(f"__r{k}", F.sum((F.col("level") <= k).cast("int")).over(w))
    shallower = F.when(F.col("level") == 0, F.lit(0))
    for k in range(1, top + 1):
        shallower = shallower.when(F.col("level") == k, F.col(f"__r{k - 1}"))
    out = out.withColumn("__run", shallower)
    return out.withColumn("number", F.row_number().over(Window.partitionBy("doc_id", "list_id", "level", "__run").orderBy("ord"))).drop("__run", *[f"__r{k}" for k in range(top)])


def label(n: int, style: str) -> str:
    """A list number as text; letters double after z: aa, bb."""
    if style in ("upperLetter", "lowerLetter"):
        c = chr(65 + (n - 1) % 26) * ((n - 1) // 26 + 1) if n > 0 else ""
        return c if style == "upperLetter" else c.lower()
    if style in ("upperRoman", "lowerRoman"):
        out, left = "", n
        for v, s in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "M CM D CD C XC L XL X IX V IV I".split(), strict=True):
            out += s * (left // v)
            left %= v
        return out if style == "upperRoman" else out.lower()
    if style == "decimalZero":
        return f"{n:02d}"
    if style == "ordinal":
        return f"{n}º"
    return str(n)


def _digit(n, ones: str, five: str, ten: str):
    """A digit of a Roman number."""
    marks = ["", ones, ones * 2, ones * 3, ones + five, five, five + ones, five + ones * 2, five + ones * 3, ones + ten]
    return F.get(F.array(*map(F.lit, marks)), F.pmod(n, F.lit(10)).cast("int"))


def label_column(n, style):
    """label() of columns: a number and the name of a style."""
    letter = F.char((65 + F.pmod(n - 1, F.lit(26))).cast("long"))
    letters = F.when(n > 0, F.repeat(letter, F.floor((n - 1) / 26).cast("int") + 1)).otherwise(F.lit(""))
    roman = F.when(n > 0, F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), _digit(F.floor(n / 100), "C", "D", "M"), _digit(F.floor(n / 10), "X", "L", "C"), _digit(n, "I", "V", "X"))).otherwise(F.lit(""))
    plain = n.cast("string")
    out = F.when(style == "upperLetter", letters).when(style == "lowerLetter", F.lower(letters)).when(style == "upperRoman", roman).when(style == "lowerRoman", F.lower(roman))
    return out.when((style == "decimalZero") & n.between(0, 9), F.concat(F.lit("0"), plain)).when(style == "ordinal", F.concat(plain, F.lit("º"))).otherwise(plain)


#: Levels of a list.
LEVELS = 9


def list_labels(items: DataFrame, levels: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """items (doc_id, ord, list_id, level; num_id if starts are given) with label, each list's own way. levels:
    (list_id, level, start, style, pattern), where %1 to %9 in a pattern stand for the levels' numbers; styles none
    and bullet show no number. starts: (num_id, level, start) begin a level anew at the first item of a num_id;
    lists that several num_ids share go on counting otherwise.

    An item ends the counts of deeper levels, and so does a new start, of its own level too. A level's number is
    its start and the items since its count was last ended: running sums over a document's list."""
    at = Window.partitionBy("doc_id", "list_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    struct = F.struct("start", "style", "pattern")
    lists = levels.groupBy("list_id").agg(F.map_from_entries(F.collect_list(F.struct("level", struct))).alias("__levels"))  # a list's few levels
    top = min(LEVELS, (levels.agg(F.max("level")).first()[0] or 0) + 1)
    rows = items.withColumn("level", F.least(F.col("level"), F.lit(LEVELS - 1)).cast("int")).join(lists, "list_id")
    rows = rows.filter(F.map_contains_key("__levels", F.col("level")))  # items of other levels have no label and count nowhere
    if starts is not None:
        anew = starts.groupBy("num_id").agg(F.map_from_entries(F.collect_list(F.struct("level", "start"))).alias("__anew"))
        first = F.row_number().over(Window.partitionBy("doc_id", "num_id").orderBy("ord")) == 1
        rows = rows.withColumn("__first", first).join(anew, "num_id", "left").withColumn("__anew", F.when(F.col("__first"), F.col("__anew")))
    else:
        rows = rows.withColumn("__anew", F.lit(None).cast("map<int,int>"))
    numbers = []
    for k in range(top):
        # what ends level k's count ahead of an item: an item above it, or a new start at k or above
        own = F.try_element_at("__anew", F.lit(k))
        above = functools.reduce(lambda a, b: a | b, [F.try_element_at(F.col("__anew"), F.lit(j)).isNotNull() for j in range(k)], F.lit(False))
        ended = (F.col("level") < k) | above | own.isNotNull()
        rows = rows.withColumns({f"__end{k}": F.sum(ended.cast("int")).over(at), f"__own{k}": own})
        run = Window.partitionBy("doc_id", "list_id", f"__end{k}").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        seen = F.sum((F.col("level") == k).cast("int")).over(run)
        # a count that a new start opened goes on from it, even before its first item
        opened = F.first(F.when(F.col("level") >= k, F.col(f"__own{k}"))).over(run)
        start = F.coalesce(F.try_element_at("__levels", F.lit(k))["start"], F.lit(1))
        rows = rows.withColumn(f"__n{k}", F.when(opened.isNotNull(), opened - 1 + seen).when(seen > 0, start + seen - 1).otherwise(start))
        numbers.append(F.when(F.col("level") < k, start).otherwise(F.col(f"__n{k}")))
    own = F.element_at("__levels", F.col("level"))
    label = own["pattern"]
    for k in reversed(range(LEVELS)):
        if k >= top:
            label = F.replace(label, F.lit(f"%{k + 1}"), F.lit("1"))
            continue
        style = F.coalesce(F.try_element_at("__levels", F.lit(k))["style"], F.lit("decimal"))
        label = F.replace(label, F.lit(f"%{k + 1}"), label_column(numbers[k], style))
    label = F.when(own["style"] == "none", F.lit("")).when(own["style"] == "bullet", own["pattern"]).otherwise(label)
    return rows.withColumn("label", label).select(*[F.col(f"`{c}`") for c in items.columns], "label")
