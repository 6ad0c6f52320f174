"""Connected components by alternating stars; every step is a pair of aggregations and joins over the links that are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import free, materialize


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, component) for every node of the links (u, v); the component is its smallest node. Links of a node with itself play no part."""
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = materialize(e, "links")
    before = None
    for _ in range(most):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("a"), "m").where("a <> m").select(F.col("a").alias("u"), F.col("m").alias("v"))
        last, e = e, materialize(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "links")
        free(last)
        if (now := _state(e)) == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
    raise RuntimeError(f"components did not settle in {most} rounds")
