import bars as B

from marlstone.streaming.accumulate import accumulate, merge_bars, windowed_bars


def test_accumulation_replaces_touched_days_only_and_repeats_change_nothing(spark, tmp_path):
    src, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    one = B.frame(spark, B.make("BTCUSDT", 30))
    one.coalesce(1).write.mode("append").parquet(src)
    stream = lambda: spark.readStream.schema(one.schema).parquet(src)
    accumulate(stream(), table, check).awaitTermination()
    assert spark.read.parquet(table).count() == 30
    late = [[*r[:6], 999.0, *r[7:]] for r in B.make("BTCUSDT", 34)[28:]]
    B.frame(spark, late).coalesce(1).write.mode("append").parquet(src)
    accumulate(stream(), table, check).awaitTermination()
    got = {r.close_time_ms: r.close for r in spark.read.parquet(table).collect()}
    assert len(got) == 34 and sum(v == 999.0 for v in got.values()) == 6
    accumulate(stream(), table, check).awaitTermination()
    assert spark.read.parquet(table).count() == 34


def test_rows_with_one_key_in_a_batch(spark, tmp_path):
    """The first batch and later ones keep the last by the order given, whatever their rows' order."""
    table = str(tmp_path / "table")
    rows = [[*r[:6], 100.0 + k, *r[7:-1], f"f{k}"] for k in (2, 0, 1) for r in B.make("BTCUSDT", 3)]
    merge_bars(spark, B.frame(spark, rows), table, 0, ["source_path"])
    assert [r.close for r in spark.read.parquet(table).collect()] == [102.0] * 3
    merge_bars(spark, B.frame(spark, [[*r[:6], r[6] + 10, *r[7:]] for r in rows]), table, 1, ["source_path"])
    assert [r.close for r in spark.read.parquet(table).collect()] == [112.0] * 3


def test_windowed_bars(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([("2024-01-01 00:05:00", "a", 1.0), ("2024-01-01 00:55:00", "a", 3.0), ("2024-01-01 01:10:00", "a", 2.0), ("2024-01-01 05:00:00", "b", 2.0)], "ts string, symbol string, value double").selectExpr("cast(ts as timestamp) ts", "symbol", "value").coalesce(1).write.parquet(src)
    q = windowed_bars(spark.readStream.schema("ts timestamp, symbol string, value double").parquet(src)).writeStream.format("memory").queryName("wb").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {(r.symbol, r.window.start.hour): (r.open, r.high, r.low, r.close, r["count"]) for r in spark.table("wb").collect()}
    assert got["a", 0] == (1.0, 3.0, 1.0, 3.0, 2) and got["a", 1] == (2.0, 2.0, 2.0, 2.0, 1)
