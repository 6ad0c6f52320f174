"""Join cardinality and key multiplicity without joining the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _products(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    a = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("left_multiplicity"))
    b = right.groupBy(*keys).agg(F.count(F.lit(1)).alias("right_multiplicity"))
    return a.join(b, list(keys)).withColumn("rows", F.col("left_multiplicity") * F.col("right_multiplicity"))


def inner_cardinality(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: common keys and the exact number of rows an inner join would have."""
    return _products(left, right, keys).agg(F.count(F.lit(1)).alias("common_keys"), F.coalesce(F.sum("rows"), F.lit(0)).alias("expected_inner_rows"))


def top_products(left: DataFrame, right: DataFrame, keys: Sequence[str], k: int = 10) -> DataFrame:
    """The k keys that make the most rows; ties go to the smaller key."""
    return _products(left, right, keys).orderBy(F.desc("rows"), *keys).limit(k)


def key_multiplicity(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: rows, unique keys, rows beyond the first of their key, the largest multiplicity, and whether keys are unique."""
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("unique_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"), F.coalesce(F.max("n"), F.lit(0)).alias("max_multiplicity"))
    return out.withColumn("is_unique", F.col("duplicate_rows") == 0)
