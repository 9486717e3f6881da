"""Templates and replacements in texts: markers, placeholders, ordered rules, statistics, keys."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The characters that end a line, which no marker crosses, and the rest of white space.
_BREAK, _BLANK = "\\n\\r\\x0B\\u2028\\u2029", "\\t\\x0C \\x85\\xA0\\u1680\\u2000-\\u200A\\u202F\\u205F\\u3000"
_INNER = rf"[^{{}}{_BREAK}]"
#: {{KEY: hint}}, any key that is not blank; {key:hint} without white space.
_DOUBLE = rf"\{{\{{[{_BLANK}]*(?![{_BLANK}:}}])((?:(?!:){_INNER})+)(?::({_INNER}*))?\}}\}}"
_SINGLE = rf"\{{([^{{}}:{_BLANK}{_BREAK}]+)(?::([^{{}}{_BLANK}{_BREAK}]*))?\}}"
#: [text], but for citations (numbers and lists of them), a cross or nothing in a box, and sic.
_NOTE = rf"\[(?![{_BLANK}]*(?:[xX]|[sS][iI][cC])?[{_BLANK}]*\])(?![{_BLANK}]*[0-9,;\u2013 -]*[0-9][0-9,;\u2013 -]*[{_BLANK}]*\])([^\[\]{_BREAK}]*)\]"
_MARKER = f"{_DOUBLE}|{_SINGLE}|{_NOTE}"
#: Characters that fill a blank to be written on, so say nothing about it.
_FILLER = "._-\u2026 \u00a0"

SPAN = "kind string, syntax string, raw string, key string, hint string, start int, len int"


def scan(text: str) -> list[tuple]:
    """(kind, syntax, raw, key, hint, start, len) of each marker, offsets in code points. What is no marker
    hides none that begins inside it."""
    import regex

    out = []
    for m in regex.finditer(_MARKER, text):
        if (note := m[5]) is not None:
            out.append(("pending", "bracket", m[0], None, note.strip() if note.strip().strip(_FILLER) else None, m.start(), len(m[0])))
            continue
        syntax, key, hint = ("double", m[1], m[2]) if m[1] is not None else ("single", m[3], m[4])
        out.append(("field", syntax, m[0], key.strip(), (hint or "").strip() or None, m.start(), len(m[0])))
    return out


def markers(df: DataFrame, text: str) -> DataFrame:
    """df with a row for each marker of a text column, in Arrow batches."""

    @F.pandas_udf(f"array<struct<{', '.join(x.replace(' ', ': ', 1) for x in SPAN.split(', '))}>>")
    def found(v: pd.Series) -> pd.Series:
        names = [x.split()[0] for x in SPAN.split(", ")]
        return v.map(lambda t: [dict(zip(names, s, strict=True)) for s in scan(t or "")])

    return df.select("*", F.explode(found(F.col(text))).alias("__m")).select(*df.columns, "__m.*")


def field_keys(text: Column) -> Column:
    """The keys of a text's fields, each once, in order; generated code only."""
    whole = F.filter(F.regexp_extract_all(text, F.lit(_MARKER), F.lit(0)), lambda m: m.startswith("{"))
    return F.array_distinct(F.transform(whole, lambda m: F.regexp_extract(m, rf"^\{{+[{_BLANK}]*([^:}}]*[^:}}{_BLANK}])", 1)))


#: {{KEY}} or {{KEY: hint}} at the start of a piece; hints of templates may run over several lines.
_PLACEHOLDER = r"^\{\{([\s\S]*?)\}\}"


def _pieces(text: Column) -> Column:
    """A text cut ahead of every {{, so that each piece has one placeholder at most, at its start."""
    return F.split(text, r"(?=\{\{)", -1)


def _key_of(piece: Column) -> Column:
    return F.regexp_replace(F.split(F.regexp_extract(piece, _PLACEHOLDER, 1), ":", 2)[0], r"^\s+|\s+$", "")


def filled(text: Column, values: dict[str, str]) -> Column:
    """text with {{KEY}} or {{KEY: hint}} replaced where values has the key; other markers stay as they are."""
    if not values:
        return text
    return filled_from(text, F.create_map(*[F.lit(x) for kv in values.items() for x in kv]))


def filled_from(text: Column, values: Column) -> Column:
    """The same with a map column of values, which may differ by row. One pass over the text, whatever the number
    of keys; what is put in is not looked at again."""
    fill = lambda x: F.when(x.rlike(_PLACEHOLDER) & F.map_contains_key(values, _key_of(x)), F.concat(F.element_at(values, _key_of(x)), F.regexp_replace(x, _PLACEHOLDER, ""))).otherwise(x)
    return F.array_join(F.transform(_pieces(text), fill), "")


def count_filled(text: Column, keys: list[str]) -> Column:
    """How many placeholders of a text have one of the keys."""
    return F.size(F.filter(_pieces(text), lambda x: x.rlike(_PLACEHOLDER) & F.array_contains(F.array(*map(F.lit, keys)).cast("array<string>"), _key_of(x))))


def replaced(text: Column, rules: list[tuple[str, str]], regex: bool = False) -> Column:
    """Rules one after the other, each on what the ones before it left. Patterns use the common part of
    regular expression dialects: no look-around and no back-references. $1 counts in patterns only."""
    for find, to in rules:
        if regex:
            if re.search(r"\(\?[=!<]|\\[1-9]", find):
                raise ValueError(f"look-around or back-reference: {find}")
            text = F.regexp_replace(text, find, to)
        else:
            text = F.replace(text, F.lit(find), F.lit(to)) if find else text
    return text


def longest_first(values: dict[str, str]) -> list[tuple[str, str]]:
    """Literal rules in an order in which no key spoils a longer one."""
    return sorted(values.items(), key=lambda kv: (-len(kv[0]), kv[0]))


def across_runs(runs: list[str], find: str, to: str) -> tuple[list[str], int]:
    """Replaces in texts joined from runs: what replaces a match goes to the run it starts in."""
    joined, out, count, at = "".join(runs), list(runs), 0, 0
    edges = [0]
    for r in runs:
        edges.append(edges[-1] + len(r))
    new = [""] * len(runs)
    while True:
        hit = joined.find(find, at) if find else -1
        end = len(joined) if hit < 0 else hit
        for i in range(len(runs)):
            new[i] += joined[max(at, edges[i]) : min(end, edges[i + 1])] if max(at, edges[i]) < min(end, edges[i + 1]) else ""
        if hit < 0:
            return (new if count else out), count
        new[next(i for i in range(len(runs)) if edges[i] <= hit < edges[i + 1])] += to
        at, count = hit + len(find), count + 1


def runs_replaced(runs: Column, find: str, to: str) -> Column:
    """across_runs() of a column of arrays, in Arrow batches, as struct<runs, n>; rows without a hit are not looked at."""

    @F.pandas_udf("runs array<string>, n int")
    def replaced_in(v: pd.Series) -> pd.DataFrame:
        found = [(None, 0) if x is None else across_runs([r or "" for r in x], find, to) for x in v]
        return pd.DataFrame({"runs": [r for r, _ in found], "n": [n for _, n in found]})

    hit = F.contains(F.array_join(runs, "", ""), F.lit(find))
    got = replaced_in(F.when(hit, runs))
    return F.struct(F.when(hit, got["runs"]).otherwise(runs).alias("runs"), F.when(hit, got["n"]).otherwise(0).alias("n"))


def statistics(df: DataFrame, text: str) -> DataFrame:
    """Paragraphs that hold text, words and characters (code points) of all rows, in one pass."""
    t = F.coalesce(F.col(text), F.lit(""))
    words = F.size(F.array_remove(F.split(t, r"\s+"), ""))
    return df.agg(F.count_if(words > 0).alias("paragraphs"), F.coalesce(F.sum(words), F.lit(0)).cast("long").alias("words"), F.coalesce(F.sum(F.length(t)), F.lit(0)).cast("long").alias("chars"))


#: Letters with marks and what keys have for them; the longest key, and that of a title without any.
_MARKED, _BARE = "áàäâãåéèëêíìïîóòöôõúùüûñç", "aaaaaaeeeeiiiiooooouuuunc"
KEY_LENGTH, NO_KEY = 64, "seccion"


def title_key(title: Column) -> Column:
    """A key from a title: without numbering and marks, in lower case, joined by -; NO_KEY if nothing is left."""
    low = F.translate(F.lower(F.regexp_replace(title, r"^\s*[0-9.)]*", "")), _MARKED, _BARE)
    joined = F.regexp_replace(F.regexp_replace(low, r"[^\p{IsAlphabetic}\p{N}]+", "-"), "^-+|-+$", "")
    key = F.regexp_replace(F.substring(joined, 1, KEY_LENGTH), "-+$", "")
    return F.when(key == "", F.lit(NO_KEY)).otherwise(key)


def next_markers(found: DataFrame, doc: str, order: str) -> DataFrame:
    """markers() of ordered texts with the marker that comes next in each document."""
    w = Window.partitionBy(doc).orderBy(order, "start")
    return found.withColumn("next_raw", F.lead("raw").over(w)).withColumn("next_order", F.lead(order).over(w))


def relocated(before: DataFrame, after: DataFrame, doc: str, order: str) -> DataFrame:
    """For each marker of before the place in after of the nearest marker with the same text."""
    new = after.select(F.col(doc).alias("__doc"), F.col("raw").alias("__raw"), F.col(order).alias("__order"), F.col("start").alias("__start"))
    rows = before.select(doc, "raw", order, "start").distinct().join(new, (F.col(doc) == F.col("__doc")) & (F.col("raw") == F.col("__raw")), "left")
    near = F.struct(F.abs(F.col("__order") - F.col(order)), F.abs(F.col("__start") - F.col("start")), "__order", "__start")
    return rows.groupBy(doc, "raw", order, "start").agg(F.min_by(F.struct(F.col("__order").alias("order"), F.col("__start").alias("start")), near).alias("at"))
