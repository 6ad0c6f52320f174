import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions.values import growth
from marlstone.operators.windows import bar_features, last_before
from marlstone.streaming.features import CONTEXT, latest, stream_features

SCHEMA = "symbol string, close_time_ms long, close double, volume double, taker_buy_volume double, oi double, n long"
NAMES = ("ret1", "ret4", "ret24", "order_imb", "rv24", "z_ret1", "z_ret4", "z_ret24", "z_order_imb", "z_rv24", "oi_change")
HOUR = 3_600_000


def series(symbol, n, seed):
    rng = random.Random(seed)
    price, out = 100.0, []
    for k in range(n):
        price = price * math.exp(rng.gauss(0, 0.02)) if rng.random() > 0.05 else price
        close = rng.choice([None, 0.0]) if rng.random() < 0.01 else price
        out.append((symbol, k * HOUR, close, rng.choice([0.0, 5.0, 9.0, None]), rng.uniform(0, 5), None if rng.random() < 0.2 else rng.choice([0.0, 3.0, price])))
    return out


def batch(spark, rows):
    d = bar_features(spark.createDataFrame([(*r, 0) for r in rows], SCHEMA))
    over = Window.partitionBy("symbol").orderBy("close_time_ms")
    d = d.withColumn("oi_change", growth(F.col("oi"), last_before(F.col("oi"), over)))
    return {(r.symbol, r.close_time_ms): [r[n] for n in NAMES] for r in d.collect()}


class Run:
    """A stream over a folder of files, each call of `feed` one of them and so a batch."""

    def __init__(self, spark, path, revisable=168):
        self.spark, self.src, self.out, self.check, self.revisable, self.n = spark, f"{path}/in", f"{path}/out", f"{path}/check", revisable, 0

    def feed(self, rows):
        self.n += 1
        self.spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], SCHEMA).coalesce(1).write.mode("append").parquet(self.src)

    def go(self):
        """Reads what is there, a file a batch, and stops; the next call goes on from the checkpoint."""
        stream = self.spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(self.src)
        q = stream_features(stream, self.revisable, "n").writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.check).trigger(availableNow=True).start()
        q.awaitTermination()
        return self.spark.read.parquet(self.out)

    def rows(self):
        return {(r.symbol, r.close_time_ms): [r[n] for n in NAMES] for r in latest(self.spark.read.parquet(self.out)).collect()}


def same(got, want):
    assert set(got) == set(want)
    for k, w in want.items():
        for name, a, b in zip(NAMES, got[k], w, strict=True):
            assert (a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)), (k, name, a, b)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_of_the_input(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = series("A", 460, seed) + series("B", 60, seed + 10) + series("C", 1, 5)
    cuts = sorted(rng.sample(range(1, 460), 4))
    run = Run(spark, tmp_path, revisable=20)
    for a, z in zip([0, *cuts], [*cuts, 10**9], strict=True):
        part = [r for r in rows if a <= r[1] // HOUR < z]
        rng.shuffle(part)
        run.feed(part)
    run.go()
    same(run.rows(), batch(spark, rows))


def test_late_and_corrected_bars_and_a_restart(spark, tmp_path):
    """Bars that come late, in other batches, after a restart, or again with other values revise what they bear upon; of one batch's rows of a time the last counts."""
    rows = series("A", 420, 3)
    late, corrected = [rows[k] for k in (330, 331, 400)], [("A", rows[k][1], 50.0 + k, 7.0, 1.0, 2.0) for k in (340, 410)]
    run = Run(spark, tmp_path)
    run.feed([r for r in rows[:402] if r not in late])
    run.go()
    run.feed([late[2], *rows[402:], late[0]])
    run.feed([late[1], ("A", corrected[0][1], 1.0, 1.0, 1.0, 1.0), corrected[0]])
    run.feed([corrected[1]])
    out = run.go()
    final = {r[1]: r for r in rows} | {r[1]: r for r in corrected}
    same(run.rows(), batch(spark, list(final.values())))
    assert out.where("too_late").count() == 0
    before = out.count()
    run.go()  # nothing new
    assert spark.read.parquet(run.out).count() == before
    assert out.groupBy("close_time_ms").count().where("count > 1").count() > 80  # revisions


def test_a_bar_without_its_context_is_told_apart(spark, tmp_path):
    rows = series("A", 400, 4)
    run = Run(spark, tmp_path, revisable=10)
    missing = rows[150]
    run.feed([r for r in rows if r is not missing])
    run.go()
    run.feed([missing, ("A", 400 * HOUR, 90.0, 1.0, 1.0, 1.0)])
    out = run.go()
    assert [(r.close_time_ms, r.z_ret1) for r in out.where("too_late").collect()] == [(missing[1], None)]
    same(run.rows(), batch(spark, [r for r in rows if r is not missing] + [("A", 400 * HOUR, 90.0, 1.0, 1.0, 1.0)]))


def test_state_is_bounded(spark, tmp_path):
    run = Run(spark, tmp_path, revisable=5)
    rows = series("A", 600, 6)
    for a in range(0, 600, 200):
        run.feed(rows[a : a + 200])
        run.go()
    kept = spark.read.format("statestore").option("stateVarName", "bars").load(run.check).selectExpr("size(value.times) n", "value.before b").collect()
    assert [(r.n, r.b) for r in kept] == [(CONTEXT + 5, 600 - CONTEXT - 5)]
