"""Windows and running values over long series: no task takes a whole series.

`placed` gives each row its position in its series: rows are dealt by range, which Spark balances by sampling, whatever the keys; a part's rows are numbered
as they lie, and parts' counts, a row per part and key, give each part its offset.

`in_blocks` cuts series into blocks of consecutive positions and copies the rows that other blocks' frames reach into (the halo) to those blocks. A window by
key and block then has for the block's own rows what a window by key has.

Running values without a bounded frame are segmented scans (`carried`, `running_equity`): each block is summed up in a few values that compose, a window
over the blocks' summaries, which are few, gives each block what comes before it, and its own rows are put right with that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators.tables import materialize

#: Rows of a block.
BLOCK = 1 << 18


def placed(rows: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "pos") -> DataFrame:
    """rows with their position from 0 in order within their key, as a table. Without keys: over all rows; the driver then gets a count per part.
    Rows that tie in the order are numbered in any order."""
    ranged = rows.repartitionByRange(*by, *order).sortWithinPartitions(*by, *order)
    ranged = materialize(ranged.withColumn("_n", F.monotonically_increasing_id()), "ranged-rows")  # parts must not change between their two readings
    parts = ranged.groupBy(*by, F.shiftright("_n", 33).alias("_part")).agg(F.min("_n").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    if by:
        before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        parts = parts.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0)))
    else:
        total, counted = 0, []
        for r in sorted(parts.collect()):
            counted.append((r._part, r._first, total))
            total += r._rows
        parts = F.broadcast(rows.sparkSession.createDataFrame(counted, "_part long, _first long, _before long"))
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"p.{k}")) for k in by]
    joined = ranged.withColumn("_part", F.shiftright("_n", 33)).alias("r").join(parts.alias("p"), [*same, F.col("r._part") == F.col("p._part")])
    return joined.select(*(F.col(f"r.`{c}`") for c in rows.columns), (F.col("r._n") - F.col("p._first") + F.col("p._before")).alias(name))


def in_blocks(rows: DataFrame, before: int, after: int, block: int = BLOCK, pos: str = "pos") -> DataFrame:
    """rows, each once with `own` and again, without it, in every block with a row at most `before` positions behind or `after` before it."""
    at = F.col(pos)
    to = F.sequence(F.greatest(F.lit(0), F.floor((at - after) / block)), F.floor((at + before) / block))
    return rows.withColumn("block", F.explode(to)).withColumn("own", F.col("block") == F.floor(at / block))


def carried(rows: DataFrame, value: Column, by: Sequence[str], order: Sequence[str], name: str, block: int = BLOCK) -> DataFrame:
    """rows (with `pos`, from `placed`) and the last value before each in its series that isn't null."""
    rows = rows.withColumns({"_v": value, "block": F.floor(F.col("pos") / block)})
    inside = Window.partitionBy(*by, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy(*by, "block").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("pos"))).alias("_end"))
    before = ends.withColumn("_before", F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)))
    out = rows.withColumn("_inside", F.last("_v", ignorenulls=True).over(inside)).join(before.drop("_end"), [*by, "block"])
    return out.withColumn(name, F.coalesce("_inside", "_before")).drop("_v", "_inside", "_before", "block")


def running_equity(rows: DataFrame, value: str, by: Sequence[str], block: int = BLOCK) -> DataFrame:
    """rows (with `pos`) and their equity, the product of 1 + value so far, its peak from 1 on, and the drawdown from that.

    A block's summary is its product and the largest and smallest of its running products: with a product of p before it, its largest equity is p times
    the one or, if p is negative, the other."""
    rows = rows.withColumn("block", F.floor(F.col("pos") / block))
    inside = Window.partitionBy(*by, "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_p", F.product(1 + F.col(value)).over(inside)).withColumns({"_hi": F.max("_p").over(inside), "_lo": F.min("_p").over(inside)})
    blocks = local.groupBy(*by, "block").agg(F.max_by("_p", "pos").alias("_whole"), F.max("_p").alias("_most"), F.min("_p").alias("_least"))
    earlier = Window.partitionBy(*by).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_start", F.coalesce(F.product("_whole").over(earlier), F.lit(1.0)))
    scaled = lambda most, least: F.when(F.col("_start") >= 0, F.col("_start") * F.col(most)).otherwise(F.col("_start") * F.col(least))
    blocks = blocks.withColumn("_peak", F.greatest(F.lit(1.0), F.coalesce(F.max(scaled("_most", "_least")).over(earlier), F.lit(1.0))))
    out = local.join(blocks.select(*by, "block", "_start", "_peak"), [*by, "block"])
    out = out.withColumns({"equity": F.col("_start") * F.col("_p"), "peak": F.greatest("_peak", scaled("_hi", "_lo"))})
    return out.withColumn("drawdown", F.col("equity") / F.col("peak") - 1).drop("_p", "_hi", "_lo", "_start", "_peak", "block")
