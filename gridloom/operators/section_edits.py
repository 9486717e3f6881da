"""Edits of one document's sections: define, unwrap, lock, replace and insert.

blocks: (doc_id, ord, level, text); sections: (doc_id, key, title, first, last, depth, parent, locked,
content_locked), of which an edit looks at one document's. Each edit returns what it changes as new
DataFrames and leaves other documents alone.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.sections import MOST_SECTIONS

SECTIONS = "key string, title string, first int, last int, depth int, parent string, locked boolean, content_locked boolean"
#: What keys may hold.
KEY = re.compile(r"[\w.-]+")


def _own(sections: DataFrame, doc_id) -> list[dict]:
    rows = sections.filter(F.col("doc_id") == doc_id).drop("doc_id").limit(MOST_SECTIONS + 1).collect()
    if len(rows) > MOST_SECTIONS:
        raise ValueError(f"a document of more than {MOST_SECTIONS} sections")
    return sorted((r.asDict() for r in rows), key=lambda r: (r["first"], -r["last"], r["depth"]))


def _with(sections: DataFrame, doc_id, own: list[dict]) -> DataFrame:
    names = [x.split()[0] for x in SECTIONS.split(", ")]
    new = sections.sparkSession.createDataFrame([[r[n] for n in names] for r in _nested(own)], SECTIONS)
    new = new.withColumn("doc_id", F.lit(doc_id).cast(sections.schema["doc_id"].dataType))
    return sections.filter(F.col("doc_id") != doc_id).unionByName(new.select(*sections.columns))


def _nested(own: list[dict]) -> list[dict]:
    """Sections in order with parents and depths as their ranges nest; of equal ranges the one given first is outside."""
    out, open_ = [], []
    for r in sorted(own, key=lambda r: (r["first"], -r["last"])):
        while open_ and open_[-1]["last"] < r["first"]:
            open_.pop()
        out.append(r | {"parent": open_[-1]["key"] if open_ else None, "depth": len(open_)})
        open_.append(out[-1])
    return out


def _only(own: list[dict], key: str) -> dict:
    found = [r for r in own if r["key"] == key]
    if len(found) != 1:
        raise ValueError(f"{len(found)} sections with the key {key!r}")
    return found[0]


def _free(own: list[dict], key: str) -> None:
    if not KEY.fullmatch(key) or any(r["key"] == key for r in own):
        raise ValueError(f"no key for a new section: {key!r}")


def defined(sections: DataFrame, doc_id, key: str, title: str, first: int, last: int, locked: bool = False, content_locked: bool = False, tables: DataFrame | None = None) -> DataFrame:
    """sections with one more around the blocks first to last. Sections that lie in the range come to lie in it.
    Refused: keys in use, ranges that cut a section or a table (doc_id, first, last)."""
    own = _own(sections, doc_id)
    _free(own, key)
    if first > last or any((r["first"] < first <= r["last"] < last) or (first < r["first"] <= last < r["last"]) for r in own):
        raise ValueError("the range cuts a section")
    if tables is not None:
        a, b = F.col("first"), F.col("last")
        whole = (a >= first) & (b <= last)
        meets = (F.col("doc_id") == doc_id) & (a <= last) & (b >= first)
        if not tables.filter(meets & ~whole).isEmpty():
            raise ValueError("the range cuts a table")
    new = {"key": key, "title": title, "first": first, "last": last, "depth": 0, "parent": None, "locked": locked, "content_locked": content_locked}
    return _with(sections, doc_id, [new, *own])


def unwrapped(sections: DataFrame, doc_id, key: str) -> DataFrame:
    """sections without one; its blocks, and the sections nested in it, stay."""
    own = _own(sections, doc_id)
    gone = _only(own, key)
    return _with(sections, doc_id, [r for r in own if r is not gone])


def with_locks(sections: DataFrame, doc_id, key: str, locked: bool, content_locked: bool) -> DataFrame:
    """sections with one's locks set: against deletion, and against edits of its content by hand."""
    own = _own(sections, doc_id)
    _only(own, key).update(locked=locked, content_locked=content_locked)
    return _with(sections, doc_id, own)


def _spliced(blocks: DataFrame, doc_id, first: int, count: int, items: list[tuple[int, str]]) -> DataFrame:
    """blocks with count of them from first on replaced by items (level, text)."""
    own = F.col("doc_id") == doc_id
    kept = blocks.filter(~(own & F.col("ord").between(first, first + count - 1)))
    kept = kept.withColumn("ord", F.when(own & (F.col("ord") >= first + count), F.col("ord") + len(items) - count).otherwise(F.col("ord")))
    new = blocks.sparkSession.createDataFrame([(first + i, level, text) for i, (level, text) in enumerate(items)], "ord int, level int, text string")
    return kept.unionByName(new.withColumn("doc_id", F.lit(doc_id).cast(blocks.schema["doc_id"].dataType)), allowMissingColumns=True)


def _shifted(own: list[dict], first: int, count: int, by: int) -> list[dict]:
    """Sections after count blocks from first on became count + by: those around them grow, those behind move."""
    end = first + count
    return [r | {"first": r["first"] + by * (r["first"] >= end), "last": r["last"] + by * (r["last"] >= end - 1)} for r in own]


def replaced(blocks: DataFrame, sections: DataFrame, doc_id, key: str, items: list[tuple[int, str]], keep_heading: bool = False) -> tuple[DataFrame, DataFrame]:
    """blocks and sections after the content of one was replaced by items (level, text), of which there is one at
    least. A heading that opens it may stay. Sections nested in it go."""
    if not items:
        raise ValueError("nothing to put in place of the content")
    own = _own(sections, doc_id)
    at = _only(own, key)
    first, last = at["first"], at["last"]
    if keep_heading and not blocks.filter((F.col("doc_id") == doc_id) & (F.col("ord") == first) & (F.col("level") > 0)).isEmpty():
        first += 1
    count = last - first + 1
    left = [r for r in own if r is at or not (r["depth"] > at["depth"] and at["first"] <= r["first"] and r["last"] <= at["last"])]
    moved = [r | {"last": r["last"] + len(items) - count} if r["key"] == key else r for r in left]
    others = _shifted([r for r in moved if r["key"] != key], first, count, len(items) - count)
    return _spliced(blocks, doc_id, first, count, items), _with(sections, doc_id, sorted([*others, *[r for r in moved if r["key"] == key]], key=lambda r: r["depth"]))


def inserted(blocks: DataFrame, sections: DataFrame, doc_id, place: str, relative_to: str | None, key: str, title: str, items: list[tuple[int, str]]) -> tuple[DataFrame, DataFrame]:
    """blocks and sections after a new section of items (level, text) was put after or before another, inside it at
    its end, or at the end of the document. Next to a section it lies in the same parent."""
    if not items:
        raise ValueError("a section without content")
    own = _own(sections, doc_id)
    _free(own, key)
    if place == "end":
        end = blocks.filter(F.col("doc_id") == doc_id).agg(F.max("ord")).first()[0]
        at = 0 if end is None else end + 1
        around: list[str] = []
    else:
        other = _only(own, relative_to)
        at = other["first"] if place == "before" else other["last"] + 1
        # the sections that take the new one in: all around the other, and itself if it goes inside
        around = [r["key"] for r in own if r["first"] <= other["first"] and r["last"] >= other["last"] and (r["depth"] < other["depth"] or (r is other and place == "inside"))]
    n = len(items)
    grown = [r | {"first": r["first"] + n * (r["first"] >= at and r["key"] not in around), "last": r["last"] + n * (r["last"] >= at or r["key"] in around)} for r in own]
    new = {"key": key, "title": title, "first": at, "last": at + n - 1, "depth": 0, "parent": None, "locked": False, "content_locked": False}
    return _spliced(blocks, doc_id, at, 0, items), _with(sections, doc_id, sorted([*grown, new], key=lambda r: r["depth"]) if not around else [*sorted(grown, key=lambda r: r["depth"]), new])
