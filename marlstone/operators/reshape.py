"""Alignment to a calendar, wide to long, and rows without gaps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reindex(rows: DataFrame, key: str, at: str, step: int) -> DataFrame:
    """rows at every `step` between the table's first and last `at`, for each key; columns of missing ones are null. Keys that are null play no
    part. The grid is spread by key and step, and rows are joined to it by both."""
    ends = rows.agg(F.min(at).alias("_a"), F.max(at).alias("_z")).withColumn("_one", F.lit(1))
    keys = rows.select(key).where(F.col(key).isNotNull()).distinct().withColumn("_one", F.lit(1))
    grid = keys.join(F.broadcast(ends), "_one").select(key, F.explode(F.sequence("_a", "_z", F.lit(step))).alias(at))  # one row of ends
    return grid.join(rows, [key, at], "left")


def stack(rows: DataFrame, keep: Sequence[str], columns: Sequence[str], name: str, value: str) -> DataFrame:
    """A row per row and column."""
    return rows.unpivot(list(keep), list(columns), name, value)


def bounded(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Infinite and undefined numbers as null."""
    return rows.withColumns({c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c)) for c in columns})


def complete(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows that have all of the columns."""
    return rows.dropna("any", subset=list(columns))
