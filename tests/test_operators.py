import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom.formula import parser as p
from gridloom.formula.interpreter import approximate
from gridloom.operators import areas, blocks, fill, lookup, moves, ranking, sections, text
from gridloom.plans import history, recalc
from gridloom.sources import docx, package, xlsx


def at(cells):
    out = set()
    for c in cells.split():
        ref = p.parse(c).first
        out.add((ref.row, ref.col))
    return out


def test_regions_unite():
    assert areas.boxes(at("B2 B3 C4 H2 G3 B9 D9")) == [(2, 2, 4, 3), (2, 7, 3, 8), (9, 2, 9, 2), (9, 4, 9, 4)]
    # a box that grows takes in what it then touches
    assert areas.boxes(at("A1 B2 C3 E2 D1")) == [(1, 1, 3, 5)]


def test_titles_and_headers():
    kinds = {(1, 1): "s", (2, 1): "s", (2, 2): "s", (2, 3): "s", (3, 1): "s", (3, 2): "n", (3, 3): "n"}
    assert areas.structure(kinds, (1, 1, 3, 3)) == (1, 2)
    assert areas.structure({(1, 1): "s", (1, 2): "s", (2, 1): "s", (2, 2): "s"}, (1, 1, 2, 2)) == (0, None)


LINES = 9


def _small_moves():
    for first in range(1, LINES + 1):
        for count in range(1, LINES + 2 - first):
            yield from (moves.LineMove.move(first, count, before) for before in range(1, LINES + 2) if not first < before < first + count)
            yield moves.LineMove.delete(first, count)
            yield moves.LineMove.insert(first, count)


def _shuffled(m):
    """The lines from 1 on as a list, after a move; 0 for new ones."""
    lines = list(range(1, LINES + 1))
    own = lines[m.first - 1 : m.first + m.count - 1]
    if m.kind == "insert":
        return lines[: m.first - 1] + [0] * m.count + lines[m.first - 1 :]
    rest = [x for x in lines if x not in own]
    if m.kind == "delete":
        return rest
    gap = len([x for x in rest if x < m.before])
    return rest[:gap] + own + rest[gap:]


def test_spans_follow_every_small_move():
    for m in _small_moves():
        new, block = _shuffled(m), set(range(m.first, m.first + m.count)) if m.kind != "insert" else set()
        place = {x: i for i, x in enumerate(new, 1) if x}
        assert all(m.line(x) == place.get(x) for x in range(1, LINES + 1))
        for a in range(1, LINES + 1):
            for b in range(a, LINES + 1):
                own = set(range(a, b + 1))
                stay = sorted(own - block)
                if m.kind == "move" and block <= own and a <= m.before <= b + 1:
                    want = (a, b)
                elif not stay:
                    want = None if m.kind == "delete" else (place[a], place[b])
                else:
                    want = (place[stay[0]], place[stay[-1]])
                assert m.span(a, b) == want, (m, a, b)
                runs = m.pieces(a, b)
                assert sorted(place[x] for x in own if x in place) == [i for lo, hi in runs for i in range(lo, hi + 1)]
                assert all(x[1] + 1 < y[0] for x, y in zip(runs, runs[1:], strict=False))
                if m.kind != "delete":
                    assert m.torn(a, b) == ([place[x] - place[a] for x in sorted(own)] != list(range(b - a + 1)) or any(0 < e - a <= b - a for e in ((m.first, m.first + m.count, m.before) if m.kind == "move" else (m.first,))))


def test_areas_follow_moves(spark):
    boxes = [(a, b) for a in range(1, LINES + 1) for b in range(a, LINES + 1)]
    df = spark.createDataFrame([(1, a, 1, b, 1) for a, b in boxes] + [(2, 4, 1, 5, 1)], "sheet int, r1 int, c1 int, r2 int, c2 int").cache()
    for m in (moves.LineMove.move(3, 2, 8), moves.LineMove.move(5, 3, 2), moves.LineMove.delete(3, 3), moves.LineMove.insert(4, 2)):
        got = sorted((r.r1, r.r2) for r in moves.moved_areas(df, 1, m).filter("sheet = 1").collect())
        assert got == sorted(x for a, b in boxes if (x := m.span(a, b)))
    assert moves.moved_areas(df, 1, moves.LineMove.delete(1, 9)).collect()[0].asDict() == {"sheet": 2, "r1": 4, "c1": 1, "r2": 5, "c2": 1}
    sizes = spark.createDataFrame([(1, 2, 9.0), (1, 6, 7.0)], "sheet int, line int, size double")
    assert [(r.line, r.size) for r in moves.moved_sizes(sizes, 1, moves.LineMove.delete(2, 1)).collect()] == [(5, 7.0)]


def test_moves_that_are_refused():
    merge = [{"sheet": 1, "r1": 4, "c1": 1, "r2": 6, "c2": 2}]
    moves.checked(moves.LineMove.move(4, 3, 1), 1, merge)
    moves.checked(moves.LineMove.move(5, 1, 9), 2, merge)
    for m, used in ((moves.LineMove.move(5, 1, 9), 0), (moves.LineMove.insert(5, 1), 0), (moves.LineMove.insert(2, 5), moves.ROWS - 3)):
        with pytest.raises(ValueError):
            moves.checked(m, 1, merge, used)
    assert moves.moved_names({"RATE": "Stock!$B$7", "OTHER": "Sum!$B$7"}, "Stock", moves.LineMove.delete(2, 2)) == {"RATE": "Stock!$B$5", "OTHER": "Sum!$B$7"}


def test_lines_follow_moves(spark):
    for m in (moves.LineMove.move(2, 1, 5), moves.LineMove.move(4, 2, 2), moves.LineMove.insert(3, 2), moves.LineMove.delete(2, 3)):
        got = spark.range(1, 9).select(F.col("id").cast("int").alias("i")).select("i", m.column(F.col("i")).alias("to")).collect()
        assert all(m.line(r.i) == r.to for r in got)
    assert [moves.LineMove.move(2, 1, 5).line(i) for i in range(1, 6)] == [1, 4, 2, 3, 5]
    with pytest.raises(ValueError):
        moves.LineMove.move(2, 3, 4)


def test_formulas_follow_moves_and_names(spark):
    m = moves.LineMove.delete(6, 3)
    assert moves.moved_formula('MAX(D5:D12)-D9&"D9"&Plan!D9+D$6+T!$D10', "T", "T", m) == 'MAX(D5:D9)-D6&"D9"&Plan!D9+#REF!+T!$D7'
    assert moves.moved_formula("EXP1(A2)+B7+LOG10(D4)+F:H", "T", "T", moves.LineMove.insert(3, 2), rows=False) == "EXP1(A2)+B7+LOG10(F4)+H:J"
    assert moves.renamed_formula("Q1!C3-'Q1'!C4&\"Q1!\"&[7]Q1!C3", "Q1", "First quarter") == "'First quarter'!C3-'First quarter'!C4&\"Q1!\"&[7]Q1!C3"
    cells = spark.createDataFrame([(1, "Q1!A1*2"), (2, "B1"), (3, None)], "row int, formula string")
    assert {r.row: r.formula for r in moves.renamed_cells(cells, "Q1", "Late").collect()} == {1: "Late!A1*2", 2: "B1", 3: None}
    for bad in ("", "in?out", "n" * 32, "end'", "PLAN"):
        with pytest.raises(ValueError):
            moves.check_sheet_name(bad, ["Plan"])


@pytest.mark.parametrize("source,count,want", [([4.0, 1.0], 2, [-2, -5]), ([2.0, 2.5, 3.0], 2, [3.5, 4]), (["Box 99"], 2, ["Box 100", "Box 101"]), (["v007"], 1, ["v008"]), (["TUESDAY"], 2, ["WEDNESDAY", "THURSDAY"]), (["W2", "W6"], 2, ["W10", "W14"]), (["Apr"], 3, ["May", "Jun", "Jul"]), ([8.0], 2, [8, 8]), (["=C3-C$1"], 2, ["=C4-C$1", "=C5-C$1"]), (["on", "off"], 3, ["on", "off", "on"])])
def test_fills(source, count, want):
    assert fill.series(source, count) == want


MARKED = [
    ("Dear {{FULL NAME}}, on {{ DAY : any day }} at {place:town}", [("FULL NAME", None, 5), ("DAY", "any day", 23), ("place", "town", 46)]),
    ("{{7}} {{a/b}} {{ : x}} {{}} {x y} {} {:h}", [("7", None, 0), ("a/b", None, 6)]),
    ("{{a\rb}} {{a\x0bb}} {{a\u2028b}} {{a\u2029b}} {a\nb}", []),
    ("{so [check this] on} [see {{KEY}}] [{{K2}", [(None, "check this", 4), (None, "see {{KEY}}", 21), ("K2", None, 37)]),
    ("[12; 14] [3 - 5] [7] [X] [ SIC ] [\t] [1a] [;]", [(None, "1a", 37), (None, ";", 42)]),
    ("[____] [. . .] [-…-] [\u00a0_]", [(None, None, 0), (None, None, 7), (None, None, 15), (None, None, 21)]),
    ("🍊ž {{K}}{ {{L:}} }", [("K", None, 3), ("L", None, 10)]),
]


@pytest.mark.parametrize("line,want", MARKED)
def test_markers(spark, line, want):
    assert [(m[3], m[4], m[5]) for m in text.scan(line)] == want
    assert all(line[m[5] : m[5] + m[6]] == m[2] for m in text.scan(line))
    df = spark.createDataFrame([(line * 2,)], "t string")
    assert df.select(text.field_keys(F.col("t")).alias("k")).first().k == list(dict.fromkeys(k for k, _, _ in want if k))


def test_replacements_across_runs():
    assert text.across_runs(["to <<", "WH", "O>> and <<WHO>>"], "<<WHO>>", "Bo") == (["to Bo", "", " and Bo"], 2)
    assert text.longest_first({"K": "1", "KEY": "2", "KE": "3"}) == [("KEY", "2"), ("KE", "3"), ("K", "1")]


def test_texts_on_columns(spark):
    df = spark.createDataFrame([("3.1) Año  Über-Ålesund", "{{A}} {{ B : x}} {{C}} {d}"), ("12.", "")], "t string, m string")
    values = F.create_map(F.lit("A"), F.lit("1"), F.lit("B"), F.lit("$2"))
    r = df.select(text.title_key(F.col("t")).alias("key"), text.field_keys(F.col("m")).alias("keys"), text.filled_from(F.col("m"), values).alias("filled"), text.replaced(F.col("m"), [(r"\{\{(\w)\}\}", "<$1>")], regex=True).alias("re")).first()
    assert df.select(text.title_key(F.col("t")).alias("key")).collect()[1].key == text.NO_KEY
    assert (r.key, r["keys"], r.filled, r.re) == ("ano-uber-alesund", ["A", "B", "C", "d"], "1 $2 {{C}} {d}", "<A> {{ B : x}} <C> {d}")
    with pytest.raises(ValueError):
        text.replaced(F.col("m"), [("(?=x)", "")], regex=True)


def test_placeholders_and_runs_of_columns(spark):
    df = spark.createDataFrame([("{{A}}{{ B :x\ny}}{{C}} {{A", ["ab{{", "X", None, "}} c{{X}}"]), (None, None), ("", ["x"])], "t string, r array<string>")
    got = df.select(text.filled(F.col("t"), {"A": "{{B}}", "B": "$2"}).alias("t"), text.count_filled(F.col("t"), ["A", "B"]).alias("n"), text.runs_replaced(F.col("r"), "{{X}}", "1").alias("r")).collect()
    assert (got[0].t, got[0].n, got[0].r.runs, got[0].r.n) == ("{{B}}$2{{C}} {{A", 2, ["ab1", "", "", " c1"], 2)
    assert got[1].t is None and got[1].r.runs is None and (got[2].t, got[2].r.runs, got[2].r.n) == ("", ["x"], 0)


def test_approximate_match_is_the_scan(spark):
    rng = random.Random(1)
    for _ in range(3):
        keys = [float(rng.randrange(12)) for _ in range(rng.randrange(1, 15))]
        table = spark.createDataFrame(list(enumerate(keys)), "ord int, k double")
        left = spark.createDataFrame([(x / 2,) for x in range(-2, 28)], "x double")
        for r in [*lookup.approximate_match(left, "x", table, "k", "ord", "place", range_rows=4, small=0).collect(), *lookup.approximate_match(left, "x", table, "k", "ord", "place").collect()]:
            want = approximate(keys, r.x)
            assert (r.place is None) == (want is None) and (want is None or r.place == want + 1), (keys, r)


def test_as_of_both_ways(spark):
    rng = random.Random(2)
    keys = sorted({rng.randrange(500) for _ in range(60)})
    right = spark.createDataFrame([(float(k), f"v{k}") for k in keys], "k double, v string")
    left = spark.createDataFrame([(float(x),) for x in range(-5, 510, 3)] + [(None,)], "x double")
    for up, small in ((False, 0), (True, 0), (False, 99), (True, 99)):
        got = lookup.as_of(left, "x", right, "k", ["v"], upward=up, range_rows=9, small=small).collect()
        assert len(got) == left.count()
        for r in got:
            fit = [k for k in keys if r.x is not None and (k >= r.x if up else k <= r.x)]
            assert r.v == (f"v{min(fit) if up else max(fit)}" if fit else None)


def test_order_statistics(spark):
    rng = random.Random(3)
    xs = [float(rng.randrange(20)) for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(xs)), "i int, x double")
    for k in (1, 17, 200):
        assert ranking.kth(df, "x", k).first().kth == sorted(xs, reverse=True)[k - 1]
        assert ranking.kth(df, "x", k, largest=False).first().kth == sorted(xs)[k - 1]
    assert ranking.kth(df, "x", 201).first()["kth__err"] == "#NUM!"
    assert all(r.rank == 1 + sum(y > r.x for y in xs) for r in ranking.ranked(df, "x", "rank").collect())
    best = max(xs.count(x) for x in xs)
    assert ranking.mode(df, "x", "i").first().mode == next(x for x in xs if xs.count(x) == best)


def _cells(rows):
    names = "workbook_id sheet row col k n s b e formula".split()
    return pd.DataFrame([dict(dict.fromkeys(names), workbook_id="w.xlsx", sheet=s, **{"row": r, "col": c}, **{"k": "n" if isinstance(v, float) else "s" if isinstance(v, str) else None, "n": v if isinstance(v, float) else None, "s": v if isinstance(v, str) else None, "formula": f}) for s, r, c, v, f in rows], columns=names)


def test_recalculation_of_cells():
    pdf = _cells([(1, 1, 1, 5.0, None), (1, 1, 2, 0.0, "A1+1"), (1, 1, 3, 0.0, "B1*2"), (1, 2, 1, 3.0, "A3"), (1, 3, 1, 4.0, "A4"), (1, 4, 1, 9.0, "A2"), (1, 5, 1, 7.0, "OFFSET(A1,1,1)"), (2, 1, 1, 0.0, "S1!C1*RATE"), (1, 6, 1, 0.0, "1/0")])
    out = recalc.recalculated_book(pdf, {1: "S1", 2: "S2"}, {(None, "RATE"): "10"})
    assert out.n.tolist()[:8] == [5, 6, 12, 3, 4, 9, 7, 120] and out.e.tolist()[8] == "#DIV/0!"
    assert out.changed.tolist() == [False, True, True, False, False, False, False, True, True]


def test_lanes_and_cycles(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 3.0)], "id int, q double")
    out = recalc.recalculated(df, {"c": "b/SUM(b)", "b": "q*2", "x": "y+1", "y": "x+1", "z": "c>AVERAGE(c)"}).orderBy("id").collect()
    assert [(r.b, r.c, r.z, r.x, r["x__err"]) for r in out] == [(4, 0.4, False, None, "#CYCLE!"), (6, 0.6, True, None, "#CYCLE!")]
    order, cyclic = recalc.ordered({"a": {"b"}, "b": {"c"}, "c": {"a"}, "d": {"a"}, "e": set()})
    assert cyclic == {"a", "b", "c"} and order.index("d") > order.index("a")


def test_sections(spark):
    blocks = spark.createDataFrame([("d", 0, 1, "1. Uno"), ("d", 1, 0, "x"), ("d", 2, 2, "1.1 Dos"), ("d", 3, 0, "y"), ("d", 4, 1, "Anexo"), ("d", 5, 1, "Anexo")], "doc_id string, ord int, level int, text string")
    got = sections.from_headings(blocks).orderBy("first").collect()
    assert [(r.key, r["first"], r["last"], r.depth, r.parent) for r in got] == [("uno", 0, 3, 0, None), ("dos", 2, 3, 1, "uno"), ("anexo", 4, 4, 0, None), ("anexo-2", 5, 5, 0, None)]
    inside = sections.contents(blocks, sections.from_headings(blocks)).collect()
    assert {r.key: r.content for r in inside} == {"uno": "x\n1.1 Dos\ny", "dos": "y"}
    assert [sections.label(n, s) for n, s in ((27, "upperLetter"), (28, "lowerLetter"), (14, "upperRoman"), (7, "decimalZero"))] == ["AA", "bb", "XIV", "07"]


def test_longest_rising_run_is_the_first_found():
    """By the definition: of each place the longest run that ends there, by way of the first place that gives it."""
    rng = random.Random(9)
    for _ in range(400):
        xs = [rng.randrange(8) for _ in range(rng.randrange(12))]
        size, before = [1] * len(xs), [None] * len(xs)
        for i, x in enumerate(xs):
            for j in range(i):
                if xs[j] < x and size[j] + 1 > size[i]:
                    size[i], before[i] = size[j] + 1, j
        want, i = set(), size.index(max(size)) if xs else None
        while i is not None:
            want.add(i)
            i = before[i]
        assert sections.longest_rising(xs) == want, xs
    assert sections.longest_rising([2, 1]) == {0}


def test_validation_and_plan(spark):
    names = [("totals", None), ("methods", None), ("sources", "totals"), ("methods", "totals"), ("methods-2", None), ("notes", None), ("scope", None)]
    found = spark.createDataFrame([("d", k, i * 10, up) for i, (k, up) in enumerate(names)], "doc_id string, key string, first int, parent string")
    rows = [(1, "scope", None, False), (2, "sources", "methods", False), (3, "methods", None, False), (4, "notes", None, True), (5, "results", None, False), (6, "tables", "results", False), (7, "totals", None, False), (8, "extra", None, True)]
    schema = spark.createDataFrame(sorted(rows, key=lambda r: (r[1] == "sources", r[0])), "pos int, key string, parent string, optional boolean")
    with pytest.raises(ValueError):
        sections.schema_rows(schema)  # sources before its parent
    schema = schema.withColumn("pos", F.when(F.col("key") == "sources", 4).when(F.col("key") == "notes", 5).when(F.col("pos") > 4, F.col("pos") + 1).otherwise(F.col("pos")))
    empty = spark.createDataFrame([("d", "notes"), ("d", "scope"), ("d", "methods-2")], "doc_id string, key string")
    got = sorted((r.key, r.issue) for r in sections.validated(found, schema, empty).collect())
    # in the document: totals, methods, notes, scope; methods and notes rise
    want = [("results", "missing"), ("tables", "missing"), ("methods", "duplicated"), ("methods-2", "unexpected"), ("sources", "parent"), ("scope", "empty"), ("totals", "order"), ("scope", "order")]
    assert got == sorted(want)
    plan = lambda keys, optional=False: [(r.key, r.place, r.relative_to, r.depth) for r in sections.planned(spark.createDataFrame([("d", k) for k in keys], "doc_id string, key string"), schema, optional).orderBy("nth").collect()]
    assert plan(["notes", "other"]) == [("scope", "before", "notes", 0), ("methods", "after", "scope", 0), ("sources", "inside", "methods", 1), ("results", "after", "notes", 0), ("tables", "inside", "results", 1), ("totals", "after", "results", 0)]
    assert plan(["scope", "methods", "sources", "results", "tables", "totals"], True) == [("notes", "after", "methods", 0), ("extra", "after", "totals", 0)]
    assert plan(["other"])[0] == ("scope", "end", None, 0)


def test_many_levels_plan_in_linear_size(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(1, 9)], "id int, lane0 double")
    sizes = []
    for n in (5, 10, 20):
        out = recalc.recalculated(df, {f"lane{k}": f"lane{k - 1}+MAX(lane{k - 1})" for k in range(n, 0, -1)})
        sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        assert {r.id: r[f"lane{n}"] for r in out.collect()} == {i: i + 8 * (2**n - 1) for i in range(1, 9)}
    assert sizes[2] < 5 * sizes[0]


def test_workbooks_round_trip(spark, tmp_path):
    rows = [(1, 1, 1, "Región & <x>", None), (1, 2, 1, 120.5, None), (1, 3, 2, 241.0, "A2*2"), (2, 1, 3, " text ", None)]
    cells = spark.createDataFrame(_cells(rows).astype(object).where(lambda d: d.notna(), None), areas.CELLS)
    xlsx.save(xlsx.files(cells, {1: "Uno", 2: "Dos hojas"}), f"file://{tmp_path}")
    back = xlsx.read(spark, f"file://{tmp_path}").orderBy("sheet", "row", "col").collect()
    assert [(r.sheet, r.row, r.col, r.s if r.k == "s" else r.n, r.formula) for r in back] == [(s, r, c, v, f) for s, r, c, v, f in rows]
    (tmp_path / "bad.xlsx").write_bytes(b"PK no zip")
    names = {(r.workbook_id, r.name, r.error is None) for r in xlsx.sheets(spark, f"file://{tmp_path}").collect()}
    assert names == {("w.xlsx", "Uno", True), ("w.xlsx", "Dos hojas", True), ("bad.xlsx", None, False)}


def test_shared_formulas_and_kinds():
    sheet = '<worksheet><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="b"><v>1</v></c><c r="C1" t="e"><v>#N/A</v></c><c r="D1" t="d"><v>2020-01-13T12:00:00Z</v></c></row><row r="3"><c r="C3"><f t="shared" ref="C3:C4" si="0">A3*$B$1</f><v>1</v></c></row><row r="4"><c r="C4"><f t="shared" si="0"/><v>2</v></c></row></sheetData></worksheet>'
    made = package.parts(xlsx.file(_cells([(1, 1, 1, "x", None)])))
    made["xl/worksheets/sheet1.xml"] = sheet.encode()
    made["xl/_rels/workbook.xml.rels"] = made["xl/_rels/workbook.xml.rels"].replace(b"</Relationships>", b'<Relationship Id="s" Type="x/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
    made["xl/sharedStrings.xml"] = b"<sst><si><r><t>a</t></r><r><t>b</t></r><rPh><t>no</t></rPh></si></sst>"
    got = list(xlsx.cells("w", package.packed(made)))
    assert [g[4:] for g in got] == [("s", None, "ab", None, None, None), ("b", None, None, True, None, None), ("e", None, None, None, "#N/A", None), ("n", 43843.5, None, None, None, None), ("n", 1.0, None, None, None, "A3*$B$1"), ("n", 2.0, None, None, None, "A4*$B$1")]


def test_limits_of_packages():
    data = package.packed({"a": b"x" * 1000, "b": b"y" * 1000})
    assert list(package.parts(data)) == ["a", "b"]
    for limits in ({"most_parts": 1}, {"most_part": 999}, {"most": 1500}):
        with pytest.raises(package.Refused):
            package.parts(data, **limits)
    with pytest.raises(package.Refused):
        package.xml(b'<!DOCTYPE x [<!ENTITY a "b">]><x>&a;</x>')


def test_documents(spark, tmp_path):
    (tmp_path / "d.docx").write_bytes(docx.file([("Uno & dos", 1), ("  texto", 0)]))
    got = docx.read(spark, f"file://{tmp_path}").orderBy("ord").collect()
    assert [(r.kind, r.level, r.text) for r in got] == [("paragraph", 1, "Uno & dos"), ("paragraph", 0, "  texto")]
    assert docx.raw_text(docx.read(spark, f"file://{tmp_path}")).first().text == "Uno & dos\n\n  texto"


def test_delta_is_all_or_nothing(spark):
    cells = spark.createDataFrame(_cells([(1, 1, 1, 1.0, None), (1, 2, 1, 2.0, None)]).astype(object).where(lambda d: d.notna(), None), areas.CELLS)
    delta = lambda rows: spark.createDataFrame([("w.xlsx", 1, r, 1, "n", float(v), None, None, None, None, op) for r, v, op in rows], areas.CELLS + ", op string")
    out = xlsx.write_cells(cells, delta([(1, 9, "set"), (2, 0, "clear"), (3, 4, "set"), (4, 4, "skip")])).collect()
    assert sorted((r.row, r.n) for r in out) == [(1, 9.0), (3, 4.0)]
    with pytest.raises(ValueError):
        xlsx.write_cells(cells, delta([(1, 9, "set"), (0, 1, "set")]))
    assert xlsx.dense(cells, 1, 1, 1, 3, 2).count() == 6


def test_history(spark):
    log = spark.createDataFrame([("w", 1, 1, 1, 1.0, 1, "set"), ("w", 1, 1, 1, 2.0, 2, "set"), ("w", 1, 2, 1, 5.0, 2, "set"), ("w", 1, 1, 1, 0.0, 3, "clear")], "workbook_id string, sheet int, row int, col int, n double, version int, op string")
    assert [sorted((r.row, r.n) for r in history.as_of(log, v).collect()) for v in (1, 2, 3)] == [[(1, 1.0)], [(1, 2.0), (2, 5.0)], [(2, 5.0)]]
    assert history.can_undo(10, 10) and not history.can_undo(10, 210)
    assert history.can_redo(1, 3) and not history.can_redo(3, 3)
    new = history.edited(log, 1, log.limit(0).drop("version").unionByName(spark.createDataFrame([("w", 1, 9, 1, 7.0, "set")], "workbook_id string, sheet int, row int, col int, n double, op string")))
    assert sorted((r.row, r.n) for r in history.as_of(new, 9).collect()) == [(1, 1.0), (9, 7.0)] and new.agg(F.max("version")).first()[0] == 2
    short = history.trimmed(log, 202)
    assert short.filter("version <= 2").count() == 2 and sorted((r.row, r.n) for r in history.as_of(short, 3).collect()) == [(2, 5.0)]


def test_streams(spark, tmp_path):
    from gridloom.streaming import formulas

    spark.range(20).selectExpr("timestamp_seconds(id * 60) as ts", "double(id) as x").write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, x double").parquet(f"file://{tmp_path}/in")
    q = formulas.windowed(stream, "ts", "10 minutes", {"big": 'SUMIF(x,">=5")'}).writeStream.format("memory").queryName("windowed").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.big for r in spark.sql("select big from windowed").collect()) == [sum(range(5, 10)), sum(range(10, 20))]


def test_divisors(spark):
    df = spark.createDataFrame([(12.0,), (18.9,), (None,), (30.0,)], "x double").repartition(3)
    assert ranking.divisors(df, "x").first().gcd == 6 and ranking.divisors(df, "x", least=True).first().gcd == 180
    assert ranking.divisors(spark.createDataFrame([(-1.0,)], "x double"), "x").first()["gcd__err"] == "#NUM!"


def test_edits_of_blocks(spark):
    df = spark.createDataFrame([("d", i, c) for i, c in enumerate("abcd")] + [("e", 0, "z")], "doc_id string, ord int, text string")
    show = lambda x: "|".join(r.text for r in x.filter("doc_id = 'd'").orderBy("ord").collect())
    assert show(blocks.inserted(df, "d", 1, ["x", "y"])) == "a|x|y|b|c|d"
    assert show(blocks.deleted(df, "d", 1, 2)) == "a|d" and show(blocks.moved(df, "d", 0, 2, 3)) == "c|a|b|d" and show(blocks.moved(df, "d", 2, 1, 0)) == "c|a|b|d"
    assert show(blocks.replaced(df, "d", 1, "B")) == "a|B|c|d" and show(blocks.merged(df, "d", 1)) == "a|bc|d" and show(blocks.split(blocks.merged(df, "d", 1), "d", 1, 1)) == "a|b|c|d"
    cells = spark.createDataFrame([("d", 0, r, c, f"{r}{c}") for r in range(3) for c in range(2)], "doc_id string, table int, row int, col int, text string")
    assert blocks.with_rows(cells, "d", 0, moves.LineMove("delete", 1, 1)).filter("row = 1").select("text").first().text == "20"
    assert blocks.duplicated_table(cells, "d", 0).filter("table = 1").count() == 6 and blocks.with_cell(cells, "d", 0, 1, 1, "!").filter("text = '!'").count() == 1


def test_areas_declared_and_found(spark):
    long = [(1, 1, 1, "Fruit picked", None), (1, 2, 1, "Grower", None), (1, 2, 2, "Crates", None), (1, 3, 1, "Ana", None), (1, 3, 2, 41.5, None), (1, 4, 1, "Bo", None), (1, 4, 2, 18.0, None), (1, 8, 5, "alone", None)]
    cells = spark.createDataFrame(_cells(long).astype(object).where(lambda d: d.notna(), None), areas.CELLS)
    declared = spark.createDataFrame([("w.xlsx", 1, "table", "Fruit", 8, 5, 9, 6)], "workbook_id string, sheet int, kind string, name string, r1 int, c1 int, r2 int, c2 int")
    every = areas.all_areas(cells, declared)
    assert sorted((r.kind, r.r1, r.c1, r.r2, r.c2) for r in every.collect()) == [("region", 1, 1, 4, 2), ("table", 8, 5, 9, 6)]
    assert areas.resolved(every, "FRUIT").count() == 1 and areas.resolved(every, "A1:B4").count() == 1
    points = spark.createDataFrame([("w.xlsx", 1, 3, 2), ("w.xlsx", 1, 20, 2)], "workbook_id string, sheet int, row int, col int")
    assert [None if r.area is None else tuple(r.area) for r in areas.region_at(every, points).orderBy("row").collect()] == [(1, 1, 4, 2), None]
    seen = areas.context(cells, 1, 1, 1, 4, 2)
    assert seen["title"] == "Fruit picked" and seen["columns"] == ["Grower", "Crates"] and seen["profile"][1]["sum"] == 59.5 and seen["markdown"].split("\n")[2] == "| Ana | 41.5 |"


def test_side_tables(spark):
    lines = spark.createDataFrame([(1, i, 10.0, False) for i in range(1, 5)], "sheet int, row int, size double, hidden boolean")
    assert [r.offset for r in areas.offsets(areas.hide(lines, 2, 2)).orderBy("row").collect()] == [0, 10, 10, 20]
    cells = spark.createDataFrame(_cells([(1, 1, 1, "a", None), (1, 3, 1, "b", None)]).astype(object).where(lambda d: d.notna(), None), areas.CELLS)
    none = spark.createDataFrame([], "workbook_id string, sheet int, r1 int, c1 int, r2 int, c2 int")
    one = areas.merge(none, cells, "w.xlsx", 1, 1, 1, 2, 2)
    assert one.count() == 1 and areas.unmerge(one, "w.xlsx", 1, 2, 2).count() == 0
    for box in ((1, 1, 3, 1), (2, 2, 4, 4)):
        with pytest.raises(ValueError):
            areas.merge(one, cells, "w.xlsx", 1, *box)


def test_list_labels_as_counters_that_run_along(spark):
    """The same by counters over a document's items in order."""
    rng = random.Random(8)
    styles = [("decimal", "%1."), ("upperRoman", "%1-%2)"), ("lowerLetter", "%3"), ("ordinal", "%2/%4"), ("bullet", "•"), ("none", "x")]
    levels = [(a, k, rng.randrange(1, 4), *styles[k]) for a in ("p", "q") for k in range(6) if (a, k) != ("q", 2)]
    starts = [("n2", 0, 7), ("n3", 1, 4), ("n3", 2, 9)]
    lists = {"n1": "p", "n2": "p", "n3": "p", "n4": "q"}
    items = [(d, i, lists[n], n, rng.randrange(6)) for d in "ab" for i in range(80) for n in [rng.choice(list(lists))]]
    spec, anew = {(a, k): x for a, k, *x in levels}, {}
    for n, k, start in starts:
        anew.setdefault(n, {})[k] = start
    want, counts, seen = [], {}, set()
    for d, i, a, n, level in items:
        if (a, level) not in spec:
            continue
        own = counts.setdefault((d, a), {})
        if (d, n) not in seen:
            seen.add((d, n))
            for k, start in sorted(anew.get(n, {}).items()):
                own[k] = start - 1
                for deeper in [x for x in own if x > k]:
                    del own[deeper]
        own[level] = own[level] + 1 if level in own else spec[a, level][0]
        for deeper in [x for x in own if x > level]:
            del own[deeper]
        start, style, label = spec[a, level]
        if style not in ("none", "bullet"):
            for k in range(8, -1, -1):
                first, form = spec[a, k][:2] if (a, k) in spec else (1, "decimal")
                label = label.replace(f"%{k + 1}", sections.label(own.get(k, first), form))
        want.append((d, i, "" if style == "none" else label))
    df = spark.createDataFrame(items, "doc_id string, ord int, list_id string, num_id string, level int")
    got = sections.list_labels(df, spark.createDataFrame(levels, "list_id string, level int, start int, style string, pattern string"), spark.createDataFrame(starts, "num_id string, level int, start int")).collect()
    assert sorted((r.doc_id, r.ord, r.label) for r in got) == sorted(want)


def test_labels_of_columns(spark):
    styles = ["upperLetter", "lowerLetter", "upperRoman", "lowerRoman", "decimalZero", "ordinal", "decimal"]
    rows = [(n, s) for n in (0, 1, 4, 9, 10, 26, 27, 53, 444, 1994, 3999) for s in styles]
    got = spark.createDataFrame(rows, "n int, style string").select("n", "style", sections.label_column(F.col("n"), F.col("style")).alias("t")).collect()
    assert all(r.t == sections.label(r.n, r.style) for r in got)


def test_tables_filters_and_names_of_workbooks(spark, tmp_path):
    made = package.parts(xlsx.file(_cells([(1, 1, 1, "x", None), (2, 1, 1, "y", None)]), {1: "Stock", 2: "Q 2"}))
    sheet = "xl/worksheets/sheet1.xml"
    made[sheet] = made[sheet].replace(b"</worksheet>", b'<autoFilter ref="B2:C9"/></worksheet>')
    made["xl/worksheets/_rels/sheet1.xml.rels"] = b'<Relationships><Relationship Id="t" Type="x/table" Target="../tables/table1.xml"/></Relationships>'
    made["xl/tables/table1.xml"] = b'<table name="T1" displayName="Fruit" ref="E3:F8" totalsRowCount="1"><tableColumns><tableColumn name="Kind"/><tableColumn name="Crates"/></tableColumns></table>'
    names = b"<definedNames><definedName name=\"AREA\">'Q 2'!$A$1:$B$4</definedName><definedName name=\"RATE\">0.2</definedName><definedName name=\"COLS\">Stock!$A:$B</definedName></definedNames></workbook>"
    made["xl/workbook.xml"] = made["xl/workbook.xml"].replace(b"</workbook>", names)
    (tmp_path / "w.xlsx").write_bytes(package.packed(made))
    got = sorted((tuple(r)[1:] for r in xlsx.areas(spark, f"file://{tmp_path}").collect()), key=str)
    assert got == sorted([(1, "table", "Fruit", 3, 5, 8, 6, 1, 1, ["Kind", "Crates"]), (1, "filter", None, 2, 2, 9, 3, 1, 0, None), (2, "name", "AREA", 1, 1, 4, 2, None, None, None)], key=str)


def test_a_table_comes_before_smaller_areas(spark):
    found = spark.createDataFrame([("w", 1, "table", 1, 1, 9, 9), ("w", 1, "region", 2, 2, 3, 3)], "workbook_id string, sheet int, kind string, r1 int, c1 int, r2 int, c2 int")
    points = spark.createDataFrame([("w", 1, 2, 2)], "workbook_id string, sheet int, row int, col int")
    assert tuple(areas.region_at(found, points).first().area) == (1, 1, 9, 9)


def test_rows_under_spanning_cells_are_refused(spark):
    cells = spark.createDataFrame([("d", 0, r, 0, 2 if r == 1 else 1) for r in range(4)], "doc_id string, table int, row int, col int, row_span int")
    assert blocks.with_rows(cells, "d", 0, moves.LineMove("delete", 3, 1)).count() == 3
    for m in (moves.LineMove("delete", 2, 1), moves.LineMove("insert", 2, 1), moves.LineMove("move", 0, 1, 2)):
        with pytest.raises(ValueError):
            blocks.with_rows(cells, "d", 0, m)


def test_cells_are_found_as_shown_and_typed_again(spark):
    rows = [(1, 1, 1, "12 kg", None), (1, 2, 1, 0.1 + 0.2, None), (1, 3, 1, "kg", None), (1, 4, 1, 5.0, "A1*12"), (2, 1, 1, "12 kg", None), (1, 5, 1, "true kg", None), (1, 6, 1, "$3kg", None)]
    cells = spark.createDataFrame(_cells(rows).astype(object).where(lambda d: d.notna(), None), areas.CELLS)
    hidden = spark.createDataFrame([("w.xlsx", 2)], "workbook_id string, sheet int")
    assert [r.row for r in areas.find_cells(cells, "12", hidden=hidden).collect()] == [1, 4]
    assert [r.row for r in areas.find_cells(cells, "0.3", whole=True).collect()] == [2]
    got = {(r.sheet, r.row): (r.k, r.n, r.s, r.b, r.n_replaced) for r in areas.replace_cells(cells, "kg", "").collect()}
    assert got[1, 1] == ("n", 12.0, None, None, 1) and got[1, 3] == ("s", None, "", None, 1) and got[1, 5] == ("b", None, None, True, 1) and got[1, 6] == ("n", 3.0, None, None, 1)
    assert got[1, 2] == ("n", 0.1 + 0.2, None, None, 0) and got[2, 1][0] == "n"


def test_areas_are_filled(spark):
    rows = [(1, 3, 1, 10.0, None), (1, 4, 1, 14.0, None), (1, 3, 2, "Lot 8", None), (1, 4, 2, "Lot 9", None), (1, 3, 3, 20.0, "A3*2+$A$3"), (1, 4, 3, 38.0, "A4*2+$A$3"), (1, 3, 4, "x", None), (1, 4, 4, 3.0, None), (1, 6, 1, "old", None), (2, 5, 1, "other", None)]
    cells = spark.createDataFrame(_cells(rows).astype(object).where(lambda d: d.notna(), None), areas.CELLS)
    got = {(r.sheet, r.row, r.col): r.formula or (r.n if r.k == "n" else r.s) for r in fill.filled_cells(cells, "w.xlsx", 1, (3, 1, 4, 4), (3, 1, 6, 4)).collect()}
    assert [got[1, r, 1] for r in (5, 6)] == [18, 22] and [got[1, r, 2] for r in (5, 6)] == ["Lot 10", "Lot 11"]
    assert [got[1, r, 3] for r in (5, 6)] == ["A5*2+$A$3", "A6*2+$A$3"] and [got[1, r, 4] for r in (5, 6)] == ["x", 3] and got[2, 5, 1] == "other"
    up = {(r.row, r.col): r.formula or (r.n if r.k == "n" else r.s) for r in fill.filled_cells(cells, "w.xlsx", 1, (3, 1, 4, 3), (1, 1, 4, 3)).filter("sheet = 1").collect()}
    assert [up[r, 1] for r in (1, 2)] == [2, 6] and [up[r, 2] for r in (1, 2)] == ["Lot 6", "Lot 7"] and [up[r, 3] for r in (1, 2)] == ["A1*2+$A$3", "A2*2+$A$3"]
    merges = spark.createDataFrame([("w.xlsx", 1, 6, 1, 6, 2)], "workbook_id string, sheet int, r1 int, c1 int, r2 int, c2 int")
    for target in ((3, 1, 6, 5), (4, 1, 9, 4), (3, 1, 9, 4)):
        with pytest.raises(ValueError):
            fill.filled_cells(cells, "w.xlsx", 1, (3, 1, 4, 4), target, merges)
