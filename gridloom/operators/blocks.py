"""Edits of documents as ordered blocks (doc_id, ord, ...): paragraphs and rows of tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.moves import LineMove


def _at(doc_id) -> F.Column:
    return F.col("doc_id") == doc_id


def inserted(blocks: DataFrame, doc_id, at: int, texts: list[str]) -> DataFrame:
    """New paragraphs before place at."""
    moved = blocks.withColumn("ord", F.when(_at(doc_id) & (F.col("ord") >= at), F.col("ord") + len(texts)).otherwise(F.col("ord")))
    new = blocks.sparkSession.createDataFrame([(at + i, t) for i, t in enumerate(texts)], "ord int, text string")
    new = new.withColumn("doc_id", F.lit(doc_id).cast(dict(blocks.dtypes)["doc_id"]))
    return moved.unionByName(new, allowMissingColumns=True)


def deleted(blocks: DataFrame, doc_id, first: int, count: int) -> DataFrame:
    return _moved(blocks, doc_id, LineMove("delete", first, count))


def moved(blocks: DataFrame, doc_id, first: int, count: int, before: int) -> DataFrame:
    """Paragraphs first on go before another; places count from 0."""
    if first < before < first + count or count < 1:
        raise ValueError("paragraphs cannot move into themselves")
    return _moved(blocks, doc_id, LineMove("move", first, count, before))


def _moved(blocks: DataFrame, doc_id, move: LineMove) -> DataFrame:
    return blocks.withColumn("ord", F.when(_at(doc_id), move.column(F.col("ord"))).otherwise(F.col("ord"))).filter("ord is not null")


def replaced(blocks: DataFrame, doc_id, at: int, text: str) -> DataFrame:
    return blocks.withColumn("text", F.when(_at(doc_id) & (F.col("ord") == at), F.lit(text)).otherwise(F.col("text")))


def split(blocks: DataFrame, doc_id, at: int, offset: int) -> DataFrame:
    """One paragraph becomes two at a code point."""
    hit = _at(doc_id) & (F.col("ord") == at)
    parts = F.when(hit, F.array(F.substring("text", 1, offset), F.substring(F.col("text"), F.lit(offset + 1), F.length("text")))).otherwise(F.array("text"))
    out = blocks.withColumn("ord", F.when(_at(doc_id) & (F.col("ord") > at), F.col("ord") + 1).otherwise(F.col("ord")))
    return out.select(*[c for c in out.columns if c not in ("ord", "text")], "ord", F.posexplode(parts).alias("__i", "text")).withColumn("ord", F.col("ord") + F.col("__i")).drop("__i").select(*blocks.columns)


def merged(blocks: DataFrame, doc_id, at: int) -> DataFrame:
    """A paragraph takes in the one after it."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    joined = F.when(_at(doc_id) & (F.col("ord") == at), F.concat("text", F.coalesce(F.lead("text").over(w), F.lit("")))).otherwise(F.col("text"))
    return deleted(blocks.withColumn("text", joined), doc_id, at + 1, 1)


def with_rows(cells: DataFrame, doc_id, table: int, move: LineMove) -> DataFrame:
    """Cells of tables (doc_id, table, row, col, ...) after rows of one were inserted, deleted or moved;
    refused where a cell spans rows (row_span) that would not stay together, or that are deleted in part."""
    own = _at(doc_id) & (F.col("table") == table)
    if "row_span" in cells.columns:
        spans = cells.filter(own & (F.col("row_span") > 1)).select("row", (F.col("row") + F.col("row_span") - 1).alias("end"))
        edges = {"move": (move.first, move.first + move.count, move.before), "insert": (move.first,), "delete": (move.first, move.first + move.count)}[move.kind]
        torn = [(F.col("row") < x) & (F.col("end") >= x) for x in edges]
        if not spans.filter(functools.reduce(lambda a, b: a | b, torn)).isEmpty():
            raise ValueError("a cell spans the rows")
    return cells.withColumn("row", F.when(own, move.column(F.col("row"))).otherwise(F.col("row"))).filter("row is not null")


def with_cell(cells: DataFrame, doc_id, table: int, row: int, col: int, text: str) -> DataFrame:
    own = _at(doc_id) & (F.col("table") == table) & (F.col("row") == row) & (F.col("col") == col)
    return cells.withColumn("text", F.when(own, F.lit(text)).otherwise(F.col("text")))


def duplicated_table(cells: DataFrame, doc_id, table: int) -> DataFrame:
    """A table once more, behind the last one of its document."""
    last = cells.filter(_at(doc_id)).agg(F.max("table")).first()[0] or 0
    return cells.unionByName(cells.filter(_at(doc_id) & (F.col("table") == table)).withColumn("table", F.lit(last + 1)))
