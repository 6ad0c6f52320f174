"""Writes bars, metrics and observations as files of the vendors' layouts, one per symbol and day, for archives and tests.

Spark writes a folder per symbol and day; the files in it are then given their names, which moves no data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.sources.files import METRIC_COLUMNS


def _day(ms: Column) -> Column:
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd")


def _named(rows: DataFrame, root: str, pattern: str) -> str:
    """rows: (symbol, day, at, line). A file of lines in order of `at` for each symbol and day."""
    spark = rows.sparkSession
    dealt = rows.repartition("symbol", "day").sortWithinPartitions("symbol", "day", "at")
    dealt.select(F.col("symbol").alias("s"), F.col("day").alias("d"), "line").write.partitionBy("s", "d").option("lineSep", "\n").text(root)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    store = path(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in store.globStatus(path(f"{root}/s=*/d=*/part-*")):
        folder = status.getPath().getParent()
        name = pattern.format(symbol=folder.getParent().getName()[2:], day=folder.getName()[2:])
        if not store.rename(status.getPath(), path(folder, name)):
            raise OSError(f"{status.getPath()} couldn't be named {name}")
    return root


def write_klines(bars: DataFrame, root: str, pattern: str) -> str:
    """Bars as eleven columns without a header; a null is an empty cell, which loading bars refuses as no number."""
    zero = F.lit(0.0)
    cells = [F.col(c) for c in ("open_time_ms", "open", "high", "low", "close", "volume", "close_time_ms")] + [zero, F.col("count"), F.col("taker_buy_volume"), zero]
    line = F.concat_ws(",", *(F.coalesce(c.cast("string"), F.lit("")) for c in cells))
    return _named(bars.select("symbol", _day(F.col("open_time_ms")).alias("day"), F.col("open_time_ms").alias("at"), line.alias("line")), root, pattern)


def write_metrics(metrics: DataFrame, root: str, tie: Sequence[str] = ()) -> str:
    """Metric rows under a header; a time has whole seconds, and of a second's rows the last counts when they are loaded. tie: columns that order the
    rows of one timestamp_ms; without them any may come last."""
    have = {v: F.coalesce(F.col(v).cast("string"), F.lit("")) if v in metrics.columns else F.lit("") for v in METRIC_COLUMNS.values()}
    stamp = F.date_format(F.timestamp_millis(F.col("timestamp_ms")), "yyyy-MM-dd HH:mm:ss")
    at = F.struct("timestamp_ms", *tie)
    rows = metrics.select("symbol", _day(F.col("timestamp_ms")).alias("day"), at.alias("at"), F.concat_ws(",", stamp, *have.values()).alias("line"))
    first = F.struct(F.lit(-1).cast("long").alias("timestamp_ms"), *(F.lit(None).cast(metrics.schema[c].dataType).alias(c) for c in tie))
    heads = rows.select("symbol", "day").distinct().select("symbol", "day", first.alias("at"), F.lit(",".join(["create_time", *METRIC_COLUMNS])).alias("line"))
    return _named(rows.unionByName(heads), root, "coinm-metrics-{symbol}-{day}.csv")


def write_onchain(onchain: DataFrame, root: str) -> str:
    """Observations as a JSON document per asset and day."""
    text = lambda c: F.col(c).cast("string").alias(c)
    stamp = F.date_format(F.timestamp_millis(F.col("metric_time_ms")), "yyyy-MM-dd'T'HH:mm:ss'.000000000Z'")
    item = F.struct(stamp.alias("time"), *(text(c) for c in ("AdrActCnt", "TxCnt", "FeeTotNtv")))
    days = onchain.groupBy(F.col("asset").alias("symbol"), _day(F.col("metric_time_ms")).alias("day")).agg(F.to_json(F.struct(F.sort_array(F.collect_list(item)).alias("data"))).alias("line"))
    return _named(days.withColumn("at", F.lit(0).cast("long")), root, "coinmetrics-{symbol}-onchain-{day}.json")
