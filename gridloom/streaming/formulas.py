"""Formulas over streams: row formulas as they come, conditional aggregates by event-time windows.

An extension: the projection and the aggregates are the ones of batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.formula.compiler import Compiler, _shown, with_formulas


def rows(stream: DataFrame, formulas: dict[str, str]) -> DataFrame:
    return with_formulas(stream, formulas)


def windowed(stream: DataFrame, time: str, width: str, formulas: dict[str, str], late: str = "10 minutes") -> DataFrame:
    """Each formula over each window of event time; rows later than late are dropped by the watermark."""
    c = Compiler(stream)
    out = [x for alias, f in formulas.items() for x in _shown(c.compile(f), alias)]
    return stream.withWatermark(time, late).groupBy(F.window(time, width)).agg(*out)
