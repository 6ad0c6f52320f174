import math
import re
import statistics

import bars as B
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.operators import joins, windows
from marlstone.plans import panel as P
from marlstone.protocol import Protocol, default_protocol

LABELS = {"forward_return", "benchmark_return"}
METRICS = "symbol string, timestamp_ms long, taker_long_short_ratio double, sum_open_interest_value double"
CHAIN = "asset string, metric_time_ms long, available_time_ms long, AdrActCnt double, TxCnt double, FeeTotNtv double"


def full_panel(spark, spot, n=50, deriv=None, metrics=None, chain=None):
    deriv = B.make("BTCUSD_PERP", n, 0.9) if deriv is None else deriv
    metrics = [("BTCUSD_PERP", B.START + i * 2 * B.HOUR + 7, 1.0 + i / 50, None if i % 4 == 0 else 100.0 + i) for i in range(n // 2)] if metrics is None else metrics
    chain = [("btc", B.START + d * 24 * B.HOUR, B.START + (d + 1) * 24 * B.HOUR, 100.0 + d, 200.0, 2.0) for d in range(-14, 2)] if chain is None else chain
    return P.point_in_time_panel(B.frame(spark, *spot), derivative_bars=B.frame(spark, deriv), derivative_metrics=spark.createDataFrame(metrics, METRICS), onchain=spark.createDataFrame(chain, CHAIN))


def rows_by_key(p):
    return {(r.decision_time_ms, r.asset): r.asDict() for r in p.collect()}


def test_panel_has_both_assets_and_cross_feature(spark):
    got = rows_by_key(P.point_in_time_panel(B.frame(spark, B.make("BTCUSDT"), B.make("ETHUSDT", slope=0.5))))
    assert {a for _, a in got} == {"BTCUSDT", "ETHUSDT"} and len(got) == 2 * 39
    assert any(r["cross_crypto_leadlag"] is not None for r in got.values())


def test_no_feature_looks_ahead(spark):
    """Everything after a time is changed; features at that time and before stay."""
    cut, n = 36, 50
    at = B.START + (cut + 1) * B.HOUR - 1

    def after(rows, key, cols):
        return [[v * 1.5 if k in cols and r[key] > at and v is not None else v for k, v in enumerate(r)] for r in rows]

    spot = [B.make("BTCUSDT", n), B.make("ETHUSDT", n, 0.5)]
    deriv = B.make("BTCUSD_PERP", n, 0.9)
    metrics = [["BTCUSD_PERP", B.START + i * 2 * B.HOUR + 7, 1.0 + i / 50, None if i % 4 == 0 else 100.0 + i] for i in range(n // 2)]
    chain = [["btc", B.START + d * 24 * B.HOUR, B.START + (d + 1) * 24 * B.HOUR, 100.0 + d, 200.0, 2.0] for d in range(-14, 2)]
    one = rows_by_key(full_panel(spark, spot, n, deriv, [tuple(m) for m in metrics], [tuple(c) for c in chain]))
    two = rows_by_key(full_panel(spark, [after(s, 2, (6, 7, 10)) for s in spot], n, after(deriv, 2, (6,)), [tuple(m) for m in after(metrics, 1, (2, 3))], [tuple(c) for c in after(chain, 2, (3, 4, 5))]))
    early = [k for k in one if k[0] <= at]
    assert len(early) > 60
    for k in early:
        a, b = one[k], two[k]
        assert {n_: v for n_, v in a.items() if n_ not in LABELS} == {n_: v for n_, v in b.items() if n_ not in LABELS}
    assert any(one[k]["forward_return"] != two[k]["forward_return"] for k in early)
    for name in ("basis_z", "taker_imbalance", "oi_change_z", "onchain_activity_z", "network_growth_z", "cross_crypto_leadlag"):
        assert any(one[k][name] is not None for k in early), name


def test_lags_are_positional_over_a_missing_hour(spark):
    b = B.make("BTCUSDT", 30, skip=(10,))
    got = {r.close_time_ms: r.ret1 for r in windows.lagged_returns(B.frame(spark, b), {"ret1": 1}).collect()}
    assert got[b[10][2]] == pytest.approx(b[10][6] / b[9][6] - 1)


def test_forward_return_is_the_symbols_own_next_bar(spark):
    """BTC lacks an hour that ETH has: ETH's own next bar counts, not the next time that both have."""
    eth = B.make("ETHUSDT", 40, 0.5)
    got = rows_by_key(P.point_in_time_panel(B.frame(spark, B.make("BTCUSDT", 40, skip=(20,)), eth)))
    assert (eth[20][2], "ETHUSDT") not in got
    assert got[eth[19][2], "ETHUSDT"]["forward_return"] == pytest.approx(eth[20][6] / eth[19][6] - 1)


def test_rolling_zscore_equals_statistics(spark):
    b = B.make("BTCUSDT", 200)
    f = windows.bar_features(B.frame(spark, b)).orderBy("close_time_ms").collect()
    ret = [r.ret1 for r in f]
    for i, r in enumerate(f):
        seen = [x for x in ret[max(0, i - 167) : i + 1] if x is not None]
        want = None if ret[i] is None or len(seen) < 12 else (ret[i] - statistics.fmean(seen)) / statistics.stdev(seen)
        assert (r.z_ret1 is None) == (want is None) and (want is None or math.isclose(r.z_ret1, want, abs_tol=1e-9))


def test_constant_series_has_zero_z(spark):
    b = [[*r[:6], 5.0, *r[7:]] for r in B.make("BTCUSDT", 30)]
    got = windows.bar_features(B.frame(spark, b)).where("z_ret1 is not null").collect()
    assert got and all(r.z_ret1 == 0.0 for r in got)


@pytest.mark.parametrize("split", [None, 1, 2, 100])
def test_asof_takes_the_last_row_at_or_before_however_old(spark, split):
    left = spark.createDataFrame([("a", t) for t in (0, 3, 7, 1000)] + [("b", 5), ("c", 1)], "k string, t long")
    right = spark.createDataFrame([("a", 1, 1.0), ("a", 3, None), ("a", 3, 3.5), ("a", 9, 9.0), ("b", 6, 6.0), ("c", None, 1.0)], "k string, s long, v double")
    got = {(r.k, r.t): r.matched for r in joins.asof_backward(left, right, ["k"], "t", "s", tie=["v"], split=split).collect()}
    assert got["a", 0] is None and got["b", 5] is None and got["c", 1] is None
    assert got["a", 3].v == 3.5 and got["a", 7].s == 3 and got["a", 1000].v == 9.0 and len(got) == 6


def test_asof_spreads_a_key_whose_rows_lie_in_one_day(spark):
    """A key with all its rows within seconds is cut at its own quantiles; ties stay together and results are those of one sort."""
    import random

    rng = random.Random(2)
    left = [("a", rng.randint(0, 5000), k) for k in range(600)] + [("b", 7, -1), (None, 3, -2)]
    right = [("a", rng.randint(0, 5000), float(k)) for k in range(900)] + [("a", 2500, -1.0)] * 50 + [(None, 1, 5.0)]
    l, r = spark.createDataFrame(left, "k string, t long, n long"), spark.createDataFrame(right, "k string, s long, v double")
    rows = lambda split: sorted((x.n, x.matched) for x in joins.asof_backward(l, r, ["k"], "t", "s", tie=["v"], split=split).collect())
    assert rows(100) == rows(None) and len(rows(100)) == 602
    edges = {x.k: x["_edges"] for x in joins._spread(l, r, ["k"], "t", "s", 100).collect()}
    assert edges["b"] == [] == edges[None] and 10 <= len(edges["a"]) <= 20
    parts = [sum(sum(e <= t for e in edges["a"]) == k for key, t, _ in left + right if key == "a") for k in range(len(edges["a"]) + 1)]
    assert max(parts) <= 200 and min(parts) > 20


def test_the_panel_in_blocks_is_the_panel(spark):
    chain = [("btc", B.START + d * 24 * B.HOUR, B.START + (d + 1) * 24 * B.HOUR, 100.0 + d, 200.0, 2.0) for d in range(12)]
    spot, coin = B.frame(spark, B.make("BTCUSDT", 260), B.make("ETHUSDT", 260, slope=0.5, skip={40})), B.frame(spark, B.make("BTCUSD_PERP", 255, slope=1.01))
    metrics = spark.createDataFrame([("BTCUSD_PERP", B.START + k * B.HOUR // 2, 1.0 + k % 7, None if k % 5 == 0 else 10.0 + k % 11) for k in range(500)], "symbol string, timestamp_ms long, taker_long_short_ratio double, sum_open_interest_value double")
    build = lambda block: P.point_in_time_panel(spot, "BTCUSDT", coin, metrics, None, spark.createDataFrame(chain, CHAIN), block=block).orderBy("timestamp", "asset").collect()
    whole, cut = build(None), build(50)
    assert len(whole) == len(cut) > 400
    for a, b in zip(whole, cut, strict=True):
        assert all(x == y or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9) for x, y in zip(a, b, strict=True))


def test_the_panel_takes_few_exchanges(spark):
    """Over tables, so that the sources' own aggregates don't count."""
    from marlstone.plans import queries as Q

    sf = "/root/testdata/sf0.001"
    parts = [Q.materialize(f(spark, sf, Q.DAY) if f in (Q.bars, Q.derivative_bars) else f(spark, sf), "t") for f in (Q.bars, Q.derivative_bars, Q.metrics, Q.onchain)]
    plan = P.point_in_time_panel(parts[0], Q.BENCHMARK, parts[1], parts[2], {Q.BENCHMARK: Q.DERIVATIVE}, parts[3])._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange ", plan)) <= 8  # and two for the features and for the rows of common times, which are tables


def test_oi_change_divides_by_the_last_that_is_not_null(spark):
    df = spark.createDataFrame([(1, 10.0), (2, None), (3, 12.0), (4, 0.0), (5, 6.0)], "t long, v double")
    got = [r.p for r in df.withColumn("p", windows.last_before(F.col("v"), Window.orderBy("t"))).orderBy("t").collect()]
    assert got == [None, 10.0, 10.0, 12.0, 0.0]


def test_symbol_with_empty_files_empties_the_panel(spark):
    spot = B.frame(spark, B.make("BTCUSDT"))
    assert P.point_in_time_panel(spot, symbols=1).count() == 39
    assert P.point_in_time_panel(spot, symbols=2).count() == 0


def test_onchain_is_used_only_once_available(spark):
    chain = [("btc", B.START, B.START + 24 * B.HOUR, 100.0, 200.0, 2.0)]
    spot = B.frame(spark, B.make("BTCUSDT", 50))
    got = P.asof_backward(spot.withColumn("asset", F.lit("btc")), P.onchain_state(spark.createDataFrame(chain, CHAIN)), ["asset"], "close_time_ms", "available_time_ms").collect()
    assert all((r.matched is not None) == (r.close_time_ms >= B.START + 24 * B.HOUR) for r in got)


def test_readiness_counts_timestamps_and_sees_gaps(spark):
    ts = lambda h: f"2026-01-0{1 + h // 24}T{h % 24:02d}:59:59.999000Z"
    rows = [(ts(h), a, ts(h + 1), 1.0) for h in range(100) for a in ("A", "B", "C")]
    p = spark.createDataFrame(rows, "timestamp string, asset string, target_close_time string, momentum_1h double")
    r = P.readiness(p, Protocol.of(default_protocol())).first()
    assert (r.decision_timestamps, r.minimum_timestamps_for_first_fold, r.history_ready_for_first_fold, r.hourly_continuity_ok) == (100, 313, False, True)
    gap = P.panel_quality(p.where("timestamp not like '%T02:%'")).first()
    assert gap.max_gap_hours == pytest.approx(2.0) and not gap.hourly_continuity_ok
    with pytest.raises(ValueError, match="duplicate"):
        P.readiness_report(p.unionByName(p), Protocol.of(default_protocol(feature_sets={"M0": ["momentum_1h"]})))
