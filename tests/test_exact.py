import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions.values import fixed_sum
from marlstone.operators import evaluation as E
from marlstone.operators import joins as J

TRADES = "model string, fold long, idx long, timestamp string, asset string, gross double, cost double, funding double, turnover double, benchmark_return double"


@pytest.fixture(scope="module")
def trades(spark):
    rng = random.Random(3)
    rows = [(m, f, i, f"t{i:03d}", f"a{k:02d}", rng.gauss(0, 0.01) * 10 ** rng.randint(-6, 0), rng.random() / 3000, rng.gauss(0, 1e-5), float(rng.randint(0, 2)), 0.001 * i / 7) for m in ("M0", "M1") for f in (0, 1) for i in range(40) for k in range(23)]
    rng.shuffle(rows)
    return spark.createDataFrame(rows, TRADES)


def bits(df):
    return sorted((tuple(x.hex() if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [None, 16])
def test_bits_do_not_depend_on_partitions(spark, trades, block):
    """Portfolio returns, fold and overall summaries over 1, 4 and 200 partitions."""
    found, had = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", str(min(parts, 16)))
            returns = E.portfolio(trades.repartition(parts, F.rand(parts)))
            found.append((bits(returns), bits(E.summarize(returns, ["model", "fold"], ["idx"], 8760, block)), bits(E.overall_summary(returns, 8760)), bits(trades.repartition(parts, F.rand(parts)).select("model", "fold", "idx", "asset", J.leave_one_out("gross", "idx").alias("x")))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", had)
    assert found[0] == found[1] == found[2]


def test_summaries_are_those_of_plain_arithmetic(spark, trades):
    import math
    import statistics

    returns = E.portfolio(trades)
    rows = sorted(returns.collect(), key=lambda r: (r.model, r.fold, r.idx))
    for s in E.summarize(returns, ["model", "fold"], ["idx"], 8760).collect():
        own = [r for r in rows if (r.model, r.fold) == (s.model, s.fold)]
        net = [r.net for r in own]
        assert math.isclose(s.net_return, math.prod(1 + x for x in net) - 1, rel_tol=1e-12) and math.isclose(s.gross_return, math.prod(1 + r.gross for r in own) - 1, rel_tol=1e-12)
        assert math.isclose(s.sharpe, statistics.fmean(net) / statistics.stdev(net) * math.sqrt(8760), rel_tol=1e-9) and math.isclose(s.turnover, math.fsum(r.turnover for r in own), rel_tol=1e-12)


def test_equal_returns_have_no_sharpe(spark):
    """A deviation of 0 is seen from the values, not from a sum that rounding may leave above 0."""
    d = spark.createDataFrame([("M", 0, i, 0.1, 0.1, 0.1, 0.0, 0, 0.0, 0.0) for i in range(30)], "model string, fold long, idx long, gross double, net double, benchmark double, turnover double, transitions int, cost double, funding double")
    assert E.summarize(d, ["model", "fold"], ["idx"], 8760).first().sharpe is None
    assert E.summarize(d.where("idx = 0"), ["model", "fold"], ["idx"], 8760).first().sharpe is None


def test_fixed_sum(spark):
    d = spark.createDataFrame([(1e10,), (1e-9,), (-1e10,), (None,), (float("nan"),), (float("inf"),)], "x double")
    assert d.agg(fixed_sum(F.col("x")).alias("s")).first().s == 1e-9
    assert d.where("x is null").agg(fixed_sum(F.col("x")).alias("s")).first().s is None
