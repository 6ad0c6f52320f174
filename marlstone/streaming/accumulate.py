"""Incremental accumulation: new bar files join a table of bars, and only the touched days are written again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from marlstone.operators.joins import keep_last

DAY_MS = 86_400_000


def merge_bars(spark: SparkSession, batch: DataFrame, table: str, batch_id: int, order: Sequence[str] = ()) -> None:
    """Upserts a batch by (symbol, close_time_ms); the later batch wins, and within a batch the last row by `order` (its columns, such as the
    source's path and position), or where they tie by the row's content, so that tasks' timing decides nothing. Touched days are replaced as a
    whole, so a repeated batch changes nothing."""
    key = ["symbol", "close_time_ms"]
    content = F.xxhash64(F.to_json(F.struct(*(F.col(f"`{c}`") for c in batch.columns))))
    new = keep_last(batch.withColumn("_content", content), key, [*(F.col(c) for c in order), F.col("_content")]).drop("_content")
    new = new.withColumns({"day": F.floor(F.col("close_time_ms") / DAY_MS), "batch": F.lit(batch_id).cast("long")})
    try:
        old = spark.read.parquet(table)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        new.write.partitionBy("day").parquet(table)
        return
    if spark.sparkContext.getCheckpointDir() is None and spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.sparkContext.setCheckpointDir(f"{table}_checkpoint")  # beside the table: a folder that all machines see
    new = new.checkpoint()
    touched = old.join(new.select("day").distinct(), "day", "left_semi").unionByName(new)
    merged = keep_last(touched, key, [F.col("batch")]).checkpoint()
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(table)


def accumulate(stream: DataFrame, table: str, checkpoint: str, order: Sequence[str] = ()) -> StreamingQuery:
    """Reads what is there, merges it batch by batch and stops."""
    spark = stream.sparkSession
    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: merge_bars(spark, df, table, n, order)).start()


def windowed_bars(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Bars of a stream of (ts, symbol, value), complete once the watermark has passed their end."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "symbol").agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"), F.sum("value").alias("volume"), F.count(F.lit(1)).alias("count")
    )
