import pytest

from gridloom.operators import section_edits as edits

SECTIONS = "doc_id string, " + edits.SECTIONS


@pytest.fixture(scope="module")
def document(spark):
    blocks = spark.createDataFrame([("d", i, 1 if t.isupper() else 0, t) for i, t in enumerate("A b C d e F g".split())] + [("other", 0, 0, "x")], "doc_id string, ord int, level int, text string")
    # top: A to e, with inner around C to e; tail: F to g
    rows = [("d", "top", "Top", 0, 4, 0, None, False, False), ("d", "inner", "Inner", 2, 4, 1, "top", False, False), ("d", "tail", "Tail", 5, 6, 0, None, True, False), ("other", "top", "Top", 0, 0, 0, None, False, False)]
    return blocks, spark.createDataFrame(rows, SECTIONS)


def shown(sections):
    return sorted((r.key, r["first"], r["last"], r.depth, r.parent) for r in sections.filter("doc_id = 'd'").collect())


def texts(blocks):
    rows = blocks.filter("doc_id = 'd'").orderBy("ord").collect()
    assert [r.ord for r in rows] == list(range(len(rows)))
    return " ".join(r.text for r in rows)


def test_sections_are_defined_and_unwrapped(spark, document):
    _, sections = document
    more = edits.defined(sections, "d", "mid", "Mid", 1, 4)
    assert shown(more) == [("inner", 2, 4, 2, "mid"), ("mid", 1, 4, 1, "top"), ("tail", 5, 6, 0, None), ("top", 0, 4, 0, None)]
    assert shown(edits.unwrapped(more, "d", "mid")) == shown(sections)
    assert shown(edits.unwrapped(sections, "d", "top")) == [("inner", 2, 4, 0, None), ("tail", 5, 6, 0, None)]
    assert shown(edits.defined(sections, "d", "all", "All", 0, 6))[0] == ("all", 0, 6, 0, None)
    assert ("same", 2, 4, 1, "top") in shown(edits.defined(sections, "d", "same", "Same", 2, 4)) and ("inner", 2, 4, 2, "same") in shown(edits.defined(sections, "d", "same", "Same", 2, 4))
    assert more.filter("doc_id = 'other'").count() == 1
    tables = spark.createDataFrame([("d", 2, 3)], "doc_id string, first int, last int")
    edits.defined(sections, "d", "t", "T", 2, 3, tables=tables)
    for key, a, b in (("top", 1, 1), ("a b", 1, 1), ("x", 1, 3), ("x", 4, 5), ("x", 3, 2), ("x", 3, 4)):
        with pytest.raises(ValueError):
            edits.defined(sections, "d", key, "X", a, b, tables=tables)
    with pytest.raises(ValueError):
        edits.unwrapped(sections, "d", "none")


def test_locks(document):
    _, sections = document
    got = edits.with_locks(sections, "d", "top", False, True).filter("doc_id = 'd' and key = 'top'").first()
    assert (got.locked, got.content_locked) == (False, True)


def test_content_is_replaced(document):
    blocks, sections = document
    text, now = edits.replaced(blocks, sections, "d", "inner", [(0, "n")])
    assert texts(text) == "A b n F g" and shown(now) == [("inner", 2, 2, 1, "top"), ("tail", 3, 4, 0, None), ("top", 0, 2, 0, None)]
    text, now = edits.replaced(blocks, sections, "d", "top", [(0, "n"), (0, "m")], keep_heading=True)
    assert texts(text) == "A n m F g" and shown(now) == [("tail", 3, 4, 0, None), ("top", 0, 2, 0, None)]
    text, now = edits.replaced(blocks, sections, "d", "tail", [(0, "1"), (0, "2"), (0, "3")])
    assert texts(text) == "A b C d e 1 2 3" and shown(now)[1] == ("tail", 5, 7, 0, None)


@pytest.mark.parametrize("place,other,want,at", [
    ("after", "inner", "A b C d e N m F g", [("inner", 2, 4, 1, "top"), ("new", 5, 6, 1, "top"), ("tail", 7, 8, 0, None), ("top", 0, 6, 0, None)]),
    ("before", "inner", "A b N m C d e F g", [("inner", 4, 6, 1, "top"), ("new", 2, 3, 1, "top"), ("tail", 7, 8, 0, None), ("top", 0, 6, 0, None)]),
    ("inside", "inner", "A b C d e N m F g", [("inner", 2, 6, 1, "top"), ("new", 5, 6, 2, "inner"), ("tail", 7, 8, 0, None), ("top", 0, 6, 0, None)]),
    ("after", "top", "A b C d e N m F g", [("inner", 2, 4, 1, "top"), ("new", 5, 6, 0, None), ("tail", 7, 8, 0, None), ("top", 0, 4, 0, None)]),
    ("before", "top", "N m A b C d e F g", [("inner", 4, 6, 1, "top"), ("new", 0, 1, 0, None), ("tail", 7, 8, 0, None), ("top", 2, 6, 0, None)]),
    ("end", None, "A b C d e F g N m", [("inner", 2, 4, 1, "top"), ("new", 7, 8, 0, None), ("tail", 5, 6, 0, None), ("top", 0, 4, 0, None)]),
])
def test_sections_are_inserted(document, place, other, want, at):
    blocks, sections = document
    text, now = edits.inserted(blocks, sections, "d", place, other, "new", "New", [(1, "N"), (0, "m")])
    assert texts(text) == want and shown(now) == at
