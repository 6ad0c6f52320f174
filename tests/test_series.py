import math
import random
import re

import bars as B
import pytest
from compare import connect, same
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import evaluation as E
from marlstone.operators import windows as W
from marlstone.operators.series import carried, in_blocks, placed, running_equity
from marlstone.plans import queries as Q
from marlstone.plans.oracles import ORACLES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def near(a, b):
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or (isinstance(p, float) and isinstance(q, float) and math.isclose(p, q, rel_tol=1e-9, abs_tol=1e-9)) for p, q in zip(x, y, strict=True)), (x, y)


@pytest.mark.parametrize("name", ["rolling_zscore", "realized_vol", "forward_return"])
@pytest.mark.parametrize("block", [50, 1000])
def test_features_in_blocks_equal_their_sql(spark, con, monkeypatch, name, block):
    whole = W.bar_features
    monkeypatch.setattr(Q.W, "bar_features", lambda b: whole(b, block))
    same(Q.QUERIES[name](spark, SF), con, ORACLES[name])


def test_no_task_takes_more_than_a_block_and_its_halo(spark):
    d = B.frame(spark, B.make("A", 700), B.make("B", 30))
    blocks = in_blocks(placed(d, ["symbol"], ["close_time_ms"]), 191, 1, 50)
    most = blocks.groupBy("symbol", "block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("own").cast("int")).alias("own"))
    assert {r.own for r in most.collect()} <= {50, 30, 0} and max(r.n for r in most.collect()) <= 50 + 191 + 1
    assert blocks.where("own").count() == 730
    assert windows(W.bar_features(d, 50)) and all("block#" in x or "_part#" in x for x in windows(W.bar_features(d, 50)))


def windows(df):
    """What each window of the plan is partitioned and ordered by."""
    return re.findall(r"windowspecdefinition\((.*?), specifiedwindowframe", df._jdf.queryExecution().optimizedPlan().toString())


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_positions(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice("ab") if rng.random() < 0.9 else None, k, rng.random()) for k in range(400)]
    rng.shuffle(rows)
    d = spark.createDataFrame(rows, "s string, t long, x double").repartition(parts)
    with_conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {(r.s, r.t): r.pos for r in placed(d, ["s"], ["t"]).collect()}
        alone = {r.t: r.idx for r in placed(d.select("t"), [], ["t"], "idx").collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_conf)
    for s in ("a", "b", None):
        assert [got[s, t] for t in sorted(t for x, t, _ in rows if x == s)] == list(range(sum(x == s for x, _, _ in rows)))
    assert alone == {t: t for t in range(400)}


def test_positions_of_nothing(spark):
    none = spark.createDataFrame([], "s string, t long")
    assert placed(none, ["s"], ["t"]).collect() == [] == placed(none, [], ["t"]).collect()


def test_dense_index_has_no_single_partition(spark):
    d = spark.range(500).selectExpr("id % 97 AS timestamp")
    out = W.dense_index(d, "timestamp")
    assert {r.timestamp: r.idx for r in out.collect()} == {k: k for k in range(97)}
    assert "SinglePartition" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_segmented_scans(spark, block):
    rng = random.Random(block)
    rows = [(s, t, None if rng.random() < 0.4 else float(rng.randint(0, 9)), rng.choice([rng.gauss(0, 0.2), -1.5, -1.0 if rng.random() < 0.02 else 0.1])) for s in ("a", "b") for t in range(150)]
    rows += [("c", 0, None, 0.5), ("d", 0, 1.0, -0.5), ("d", 1, None, -0.25)]
    d = spark.createDataFrame(rows, "s string, t long, v double, r double")
    p = placed(d, ["s"], ["t"])
    over = Window.partitionBy("s").orderBy("t")
    near(rows_of(carried(p, F.col("v"), ["s"], ["t"], "last", block).select("s", "t", "last")), rows_of(d.select("s", "t", W.last_before(F.col("v"), over).alias("last"))))
    names = ("s", "t", "equity", "peak", "drawdown")
    near(rows_of(running_equity(p, "r", ["s"], block).select(*names)), rows_of(E.drawdowns(d, ["s"], ["t"], "r").select(*names)))
    near(rows_of(E.drawdowns(d, ["s"], ["t"], "r", block).select(*names)), rows_of(E.drawdowns(d, ["s"], ["t"], "r").select(*names)))


def test_scans_have_no_window_over_a_series(spark):
    d = spark.createDataFrame([("a", k, 0.1) for k in range(20)], "s string, t long, r double")
    assert windows(E.drawdowns(d, ["s"], ["t"], "r")) and not any("block#" in x for x in windows(E.drawdowns(d, ["s"], ["t"], "r")))
    p = placed(d, ["s"], ["t"])
    for scan in (running_equity(p, "r", ["s"], 5), carried(p, F.col("r"), ["s"], ["t"], "x", 5)):
        assert windows(scan) and all("block#" in x or "_part#" in x for x in windows(scan))


def test_stage_two_in_blocks(spark):
    rows = [(s, t, math.sin(t * k) if t % 9 else None) for s, k in (("a", 1.0), ("b", 0.37)) for t in range(400)]
    d = spark.createDataFrame(rows, "asset string, t long, x double")
    near(rows_of(W.rolling_zscores(d, ["x"], "asset", "t", 60)), rows_of(W.rolling_zscores(d, ["x"], "asset", "t")))


def test_only_long_series_are_cut(spark):
    d = B.frame(spark, B.make("A", 50))
    assert W.long_series(d, "symbol") is None and W.long_series(d, "symbol", 10) == 10 and W.long_series(d.where("false"), "symbol") is None
