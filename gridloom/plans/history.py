"""Undo and redo over an append-only log of cell changes, instead of before-images of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: versions that can be undone.
STEPS = 200
AT = ["workbook_id", "sheet", "row", "col"]


def as_of(log: DataFrame, version: int) -> DataFrame:
    """Cells at a version of a log (cells, version, op): of each cell the last entry up to it, unless cleared."""
    values = [c for c in log.columns if c not in AT]
    last = log.filter(F.col("version") <= version).groupBy(*AT).agg(F.max_by(F.struct(*values), "version").alias("x"))
    return last.filter("x.op = 'set'").select(*AT, *[F.col(f"x.{c}").alias(c) for c in values if c not in ("version", "op")])


def can_undo(current: int, newest: int) -> bool:
    return current > max(0, newest - STEPS)


def can_redo(current: int, newest: int) -> bool:
    return current < newest


def edited(log: DataFrame, current: int, changes: DataFrame) -> DataFrame:
    """log after an edit at a version: changes (cells, op) become the next one, and what could be redone goes."""
    return log.filter(F.col("version") <= current).unionByName(changes.withColumn("version", F.lit(current + 1).cast(log.schema["version"].dataType)))


def trimmed(log: DataFrame, newest: int) -> DataFrame:
    """log without versions that can no longer be undone: the last state before them becomes one version."""
    oldest = max(0, newest - STEPS)
    base = as_of(log, oldest).withColumns({"version": F.lit(oldest).cast(log.schema["version"].dataType), "op": F.lit("set")})
    return base.unionByName(log.filter(F.col("version") > oldest))
