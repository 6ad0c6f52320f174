"""The catalogue of queries over the driver's tables, each a thin use of the library."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import values as V
from marlstone.operators import cardinality, evaluation as E
from marlstone.operators import joins as J
from marlstone.operators import reshape as R
from marlstone.operators import windows as W
from marlstone.operators.tables import materialize, new_path
from marlstone.plans import evaluate as G
from marlstone.plans import panel as P
from marlstone.shipping import ship_package
from marlstone.sources import committed, files, http, vendor
from marlstone.streaming.features import latest, stream_features
from marlstone.protocol import FEATURE_SETS, Costs, Protocol, default_protocol

HOUR, DAY = 3_600_000, 86_400_000
#: Rows of a key that an as-of join leaves to one task.
ASOF_ROWS = 1 << 18
BENCHMARK, DERIVATIVE = "click", "click_future"
PROTOCOL = Protocol.of(default_protocol(feature_sets=FEATURE_SETS | {"X1": ["momentum_1h", "order_flow_imbalance", "regime_trend"]}))
EVALUATED = tuple(PROTOCOL.feature_sets)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with their time in milliseconds; timestamp_ntz is cast first, as unix_millis takes no other."""
    return table(spark, sf, "events").withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))


def bars_from(events: DataFrame, step: int) -> DataFrame:
    taker = F.coalesce(F.sum(F.when(F.col("event_id") % 2 == 0, F.col("value"))), F.lit(0.0))
    out = events.groupBy(F.col("event_type").alias("symbol"), (F.floor(F.col("ms") / step) * step).cast("long").alias("open_time_ms")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.sum("value").alias("volume"), F.count(F.lit(1)).alias("count"), taker.alias("taker_buy_volume"),
    )
    return out.withColumn("close_time_ms", F.col("open_time_ms") + step - 1)


def bars(spark: SparkSession, sf: str, step: int = HOUR) -> DataFrame:
    return bars_from(_events(spark, sf), step)


def derivative_bars(spark: SparkSession, sf: str, step: int = HOUR) -> DataFrame:
    e = _events(spark, sf).where("event_type = 'purchase'").withColumn("event_type", F.lit(DERIVATIVE))
    return bars_from(e, step)


def metrics(spark: SparkSession, sf: str, *more: Column) -> DataFrame:
    e = _events(spark, sf).where("event_type = 'view'")
    return e.select(F.lit(DERIVATIVE).alias("symbol"), F.col("ms").alias("timestamp_ms"), (F.col("value") / 100).alias("taker_long_short_ratio"), F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("sum_open_interest_value"), *more)


def onchain(spark: SparkSession, sf: str) -> DataFrame:
    day = (F.floor(F.col("ms") / DAY) * DAY).cast("long")
    out = _events(spark, sf).groupBy(day.alias("metric_time_ms")).agg(F.countDistinct("user_id").cast("double").alias("AdrActCnt"), F.count(F.lit(1)).cast("double").alias("TxCnt"), F.sum("value").alias("FeeTotNtv"))
    return out.withColumns({"asset": F.lit(BENCHMARK), "available_time_ms": F.col("metric_time_ms") + DAY})


def _mapping(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame([(BENCHMARK, DERIVATIVE)], "symbol string, derivative string"))


def panel(spark: SparkSession, sf: str, step: int = HOUR) -> DataFrame:
    return P.point_in_time_panel(bars(spark, sf, step), BENCHMARK, derivative_bars(spark, sf, step), metrics(spark, sf), {BENCHMARK: DERIVATIVE}, onchain(spark, sf))


def written_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The panel as a table, for plans that read it more than once."""
    return materialize(panel(spark, sf), "panel")


def rounded(df: DataFrame, digits: int = 8) -> DataFrame:
    """Doubles rounded, with no negative zero."""
    return df.select(*((F.round(F.col(f"`{n}`"), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


def summed_up(df: DataFrame) -> DataFrame:
    """Doubles to 6 places, those of 10,000 or more to 2: engines multiply long series in different orders, which shows in the last bits."""
    places = lambda c: F.when(F.abs(c) < 10_000, F.round(c, 6)).otherwise(F.round(c, 2)) + F.lit(0.0)
    return df.select(*(places(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return W.bar_features(bars(spark, sf))


def _members(spark: SparkSession, sf: str) -> DataFrame:
    return E.fold_members(written_panel(spark, sf), PROTOCOL.walk_forward)


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    return E.scored(_members(spark, sf), {m: PROTOCOL.feature_sets[m] for m in EVALUATED}, PROTOCOL.clip, PROTOCOL.entry_threshold, digits=10)


def _returns(spark: SparkSession, sf: str) -> DataFrame:
    """A row per model, fold and timestamp, as a table: summaries read it several times."""
    return materialize(E.portfolio(E.traded(_scored(spark, sf), PROTOCOL.costs)), "returns")


def dedup_keep_last(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).withColumn("day", F.floor(F.col("ms") / DAY).cast("long"))
    return J.keep_last(e, ["user_id", "day"], [F.col("event_id")]).select("user_id", "day", "event_id", "event_type", "value")


def bars_hourly(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bars(spark, sf).select("symbol", "open_time_ms", "close_time_ms", "open", "high", "low", "close", "volume", "count", "taker_buy_volume"))


def returns_lagged(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(W.lagged_returns(bars(spark, sf), {"ret1": 1, "ret4": 4, "ret24": 24}).select("symbol", "close_time_ms", "ret1", "ret4", "ret24"))


def rolling_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_features(spark, sf).select("symbol", "close_time_ms", "z_ret1", "z_ret4", "z_ret24", "z_order_imb", "z_rv24"))


def realized_vol(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_features(spark, sf).select("symbol", "close_time_ms", "rv24"))


def order_imbalance(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(bars(spark, sf).select("symbol", "close_time_ms", V.order_imbalance(F.col("taker_buy_volume"), F.col("volume")).alias("order_imb")))


def forward_return(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    return rounded(f.select("symbol", "close_time_ms", F.coalesce("next_close_time_ms", F.lit(-1).cast("long")).alias("next_close_time_ms"), V.simple_return(F.col("next_close"), F.col("close")).alias("forward_return")))


def benchmark_attach(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    return rounded(f.select("symbol", "close_time_ms").join(J.benchmark(f, BENCHMARK), "close_time_ms"))


def decision_times(spark: SparkSession, sf: str) -> DataFrame:
    return J.decision_times(bars(spark, sf))


def basis_equi_join(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(J.basis(bars(spark, sf), derivative_bars(spark, sf), _mapping(spark)))


def asof_metrics(spark: SparkSession, sf: str) -> DataFrame:
    left = bars(spark, sf).where(F.col("symbol") == BENCHMARK).select(F.lit(DERIVATIVE).alias("symbol"), "close_time_ms")
    out = J.asof_backward(left, metrics(spark, sf), ["symbol"], "close_time_ms", "timestamp_ms", split=ASOF_ROWS)
    return rounded(out.select("symbol", "close_time_ms", "matched.timestamp_ms", "matched.taker_long_short_ratio", "matched.sum_open_interest_value"))


def asof_onchain(spark: SparkSession, sf: str) -> DataFrame:
    left = bars(spark, sf).select("symbol", "close_time_ms", V.asset_from_symbol(F.col("symbol")).alias("asset"))
    out = J.asof_backward(left, onchain(spark, sf), ["asset"], "close_time_ms", "available_time_ms", split=ASOF_ROWS)
    return rounded(out.select("symbol", "close_time_ms", F.coalesce("matched.available_time_ms", F.lit(-1).cast("long")).alias("available_time_ms"), "matched.AdrActCnt", "matched.TxCnt"))


def oi_change(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf)
    d = P.derivative_state(b.join(J.decision_times(b), "close_time_ms", "left_semi"), metrics(spark, sf), _mapping(spark))
    return rounded(d.select("symbol", "close_time_ms", "oi", "oi_change"))


def taker_transform(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(metrics(spark, sf).select("timestamp_ms", V.taker_transform(F.col("taker_long_short_ratio")).alias("taker")))


def onchain_activity(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.onchain_state(onchain(spark, sf)).select("available_time_ms", "activity"))


def network_growth(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.onchain_state(onchain(spark, sf)).select("available_time_ms", "network_growth"))


def cross_leadlag(spark: SparkSession, sf: str) -> DataFrame:
    f = _features(spark, sf)
    at = f.join(J.decision_times(f), "close_time_ms", "left_semi")
    return rounded(at.select("symbol", "close_time_ms", J.leave_one_out("ret1", "close_time_ms").alias("leadlag")))


def panel_build(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(panel(spark, sf), 7)


def panel_daily(spark: SparkSession, sf: str) -> DataFrame:
    """The panel over daily bars, which every scale has at all symbols."""
    p = panel(spark, sf, DAY)
    return rounded(p.select("decision_time_ms", "asset", "forward_return", "benchmark_return", "momentum_1h", "momentum_4h", "basis_z"), 7)


def panel_quality(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(P.panel_quality(written_panel(spark, sf)))


def readiness(spark: SparkSession, sf: str) -> DataFrame:
    return P.readiness(written_panel(spark, sf), PROTOCOL).select("decision_timestamps", "minimum_timestamps_for_first_fold", "history_ready_for_first_fold")


def feature_availability(spark: SparkSession, sf: str) -> DataFrame:
    a = P.feature_availability(panel(spark, sf), PROTOCOL.feature_sets)
    return rounded(a.withColumn("missing_features", F.concat_ws(",", "missing_features")))


def universe_check(spark: SparkSession, sf: str) -> DataFrame:
    b = bars(spark, sf).select(V.iso_from_ms(F.col("close_time_ms")).alias("timestamp"), F.col("symbol").alias("asset"))
    out = G.universe_changes(b)
    return out.select("timestamp", F.concat_ws(",", F.array_sort("missing")).alias("missing"), F.concat_ws(",", F.array_sort("extra")).alias("extra"))


def timestamp_index(spark: SparkSession, sf: str) -> DataFrame:
    return W.dense_index(panel(spark, sf), "timestamp").withColumn("idx", F.col("idx").cast("long"))


def fold_generator(spark: SparkSession, sf: str) -> DataFrame:
    return E.folds(spark, max(1, J.decision_times(bars(spark, sf)).count()), PROTOCOL.walk_forward)


def fold_membership(spark: SparkSession, sf: str) -> DataFrame:
    return _members(spark, sf).select("timestamp", "asset", "fold", F.col("idx").cast("long").alias("idx"))


def missing_features(spark: SparkSession, sf: str) -> DataFrame:
    return E.missing_features(_members(spark, sf), PROTOCOL.feature_sets)


def score_position(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_scored(spark, sf).select("model", "fold", "timestamp", "asset", "score", F.col("position").cast("long").alias("position")), 10)


def turnover_cost(spark: SparkSession, sf: str) -> DataFrame:
    t = E.traded(_scored(spark, sf), PROTOCOL.costs)
    return rounded(t.select("model", "fold", "timestamp", "asset", F.col("turnover").cast("long").alias("turnover"), "gross", "cost", "funding"))


def portfolio_returns(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(_returns(spark, sf).select("model", "fold", "timestamp", "gross", "cost", "turnover", "transitions", "net"))


def drawdown(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(E.drawdowns(_returns(spark, sf), ["model", "fold"], ["idx"]).select("model", "fold", "timestamp", "equity", "peak", "drawdown"), 7)


_SUMMARY = ("observations", "gross_return", "net_return", "benchmark_return", "simple_alpha", "sharpe", "max_drawdown", "turnover", "position_transitions", "execution_cost_fraction_sum")


def fold_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summed_up(E.summarize(_returns(spark, sf), ["model", "fold"], ["idx"], PROTOCOL.annualization).select("model", "fold", *_SUMMARY))


def overall_summary(spark: SparkSession, sf: str) -> DataFrame:
    return summed_up(E.overall_summary(_returns(spark, sf), PROTOCOL.annualization).select("model", *_SUMMARY, "positive_folds", "fold_count", "positive_fold_fraction"))


def candidate_screen(spark: SparkSession, sf: str) -> DataFrame:
    return E.screen(E.overall_summary(_returns(spark, sf), PROTOCOL.annualization), PROTOCOL.screen).select("model", "candidate_screen_pass")


def cost_styles(spark: SparkSession, sf: str) -> DataFrame:
    """Cost per event under both execution styles, with spread and slippage from the event and defaults where they're null."""
    e = _events(spark, sf).select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value") / 100 - 1).alias("spread_bps"), F.when(F.col("event_id") % 5 != 0, F.col("value") / 200 - 1).alias("slippage_bps"), (F.col("event_id") % 3).alias("turnover"))
    return rounded(e.select("event_id", *(E.cost_fraction(F.col("turnover"), Costs(execution_style=s)).alias(s) for s in ("taker", "maker"))), 12)


def event_score(spark: SparkSession, sf: str) -> DataFrame:
    """Event scores scaled by confidence clamped to [0, 1], unscaled where it's missing."""
    e = _events(spark, sf).select("event_id", (F.col("value") / 100 - 2).alias("llm_event_score"), F.when(F.col("event_id") % 4 != 0, F.col("value") / 150 - 0.5).alias("llm_event_confidence"))
    return rounded(e.select("event_id", E.score(["llm_event_score", "llm_event_confidence"], 3.0).alias("score")))


def join_cardinality(spark: SparkSession, sf: str) -> DataFrame:
    o, l = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return cardinality.inner_cardinality(o, l, ["k"])


def key_multiplicity(spark: SparkSession, sf: str) -> DataFrame:
    return cardinality.key_multiplicity(table(spark, sf, "lineitem"), ["l_orderkey"])


def top_key_products(spark: SparkSession, sf: str) -> DataFrame:
    o, l = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k")), table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"))
    return cardinality.top_products(o, l, ["k"])


def key_intersection(spark: SparkSession, sf: str) -> DataFrame:
    o, c = table(spark, sf, "orders"), table(spark, sf, "customer")
    return c.select(F.col("c_custkey").alias("k")).join(o.select(F.col("o_custkey").alias("k")), "k", "left_semi")


def asset_from_symbol(spark: SparkSession, sf: str) -> DataFrame:
    quotes = F.array(*(F.lit(q) for q in (*V.QUOTES, "EUR")))
    s = table(spark, sf, "part").select("p_partkey", F.concat(F.upper(F.substring("p_brand", 1, 5)), F.element_at(quotes, (F.col("p_partkey") % 5 + 1).cast("int"))).alias("symbol"))
    return s.select("p_partkey", "symbol", V.asset_from_symbol(F.col("symbol")).alias("asset"))


def epoch_normalize(spark: SparkSession, sf: str) -> DataFrame:
    e = _events(spark, sf).select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("ms") * 1000 + 7).otherwise(F.col("ms")).alias("raw"))
    return e.select("event_id", V.epoch_ms(F.col("raw")).alias("ms"), V.iso_from_ms(V.epoch_ms(F.col("raw"))).alias("iso"))


def lenient_cast(spark: SparkSession, sf: str) -> DataFrame:
    words = F.array(*(F.lit(x) for x in ("", "abc", "NaN", "inf", "-inf", "1e3", " 2.5 ")))
    e = _events(spark, sf).select("event_id", F.when(F.col("event_id") % 3 == 0, F.element_at(words, (F.col("event_id") % 7 + 1).cast("int"))).otherwise(F.col("event_id").cast("string")).alias("text"))
    return e.select("event_id", V.lenient_double(F.col("text")).alias("number"))


def sha256_rows(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(F.col("text"), 256).alias("sha256"))


def calendar_reindex(spark: SparkSession, sf: str) -> DataFrame:
    """Bars aligned to every hour between the first and the last, missing ones null."""
    return rounded(R.reindex(bars(spark, sf).select("symbol", "close_time_ms", "close"), "symbol", "close_time_ms", HOUR))


def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(R.stack(bars(spark, sf), ["symbol", "close_time_ms"], ["open", "high", "low", "close"], "field", "price"))


def complete_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Logarithms of values over a threshold, infinite and undefined ones as null, and rows that lack one left out."""
    e = _events(spark, sf).select("event_id", F.when(F.col("event_id") % 5 == 0, float("inf")).when(F.col("event_id") % 7 == 0, float("nan")).otherwise(F.col("value")).alias("a"), F.when(F.col("event_id") % 3 != 0, F.col("value") / 2).alias("b"))
    return rounded(R.complete(R.bounded(e, ["a", "b"]), ["a", "b"]))


def model_status(spark: SparkSession, sf: str) -> DataFrame:
    """Each feature set with its status: evaluated, or blocked by the features that test rows lack."""
    return G.model_status(_members(spark, sf), PROTOCOL.feature_sets)


def evaluation_overall(spark: SparkSession, sf: str) -> DataFrame:
    """The evaluation from end to end: validation, eligibility, folds, costs and the screen, a row per feature set."""
    p = written_panel(spark, sf).withColumn("forward_return", F.col("forward_return") / 100_000)  # the events' values jump: a position would lose everything
    report = G.evaluate(p, default_protocol(feature_sets=PROTOCOL.feature_sets))
    names = ("observations", "net_return", "max_drawdown", "turnover", "positive_folds")
    rows = [(m, v["status"], len(v["folds"]), v["candidate_screen_pass"], *(v["overall"][k] if v["overall"] else None for k in names)) for m, v in report["models"].items()]
    kinds = "model string, status string, folds long, candidate_screen_pass boolean, observations long, net_return double, max_drawdown double, turnover double, positive_folds long"
    return rounded(spark.createDataFrame(rows, kinds), 6)


def source_spot_bars(spark: SparkSession, sf: str) -> DataFrame:
    """Bars written as a vendor's daily files and loaded again."""
    root = vendor.write_klines(bars(spark, sf).withColumn("symbol", F.upper("symbol")), new_path(spark, "spot"), "spot-klines-{symbol}-1h-{day}.csv")
    return rounded(files.load_spot_bars(spark, root).select(*_LOADED))


def source_pruned_bars(spark: SparkSession, sf: str) -> DataFrame:
    """The bars of one symbol and week out of an archive of vendor files, the others of which are never opened."""
    root = vendor.write_klines(bars(spark, sf).withColumn("symbol", F.upper("symbol")), new_path(spark, "spot"), "spot-klines-{symbol}-1h-{day}.csv")
    found = files.load_spot_bars(spark, root, (F.col("symbol") == BENCHMARK.upper()) & F.col("day").between(F.lit("2024-01-08").cast("date"), F.lit("2024-01-14").cast("date")))
    return rounded(found.select(*_LOADED))


def _metrics_archive(spark: SparkSession, sf: str) -> str:
    """Metrics as a vendor's daily files. Of events in one millisecond that of the smallest id counts, as for SQL that reads the table in order; so it is written last."""
    rows = metrics(spark, sf, F.bitwise_not(F.col("event_id").cast("long")).alias("falling_id"))
    return vendor.write_metrics(rows.withColumn("symbol", F.upper("symbol")), new_path(spark, "metrics"), ["falling_id"])


def source_pruned_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics from a day on."""
    root = _metrics_archive(spark, sf)
    found = files.load_derivative_metrics(spark, root, F.col("day") >= F.lit("2024-01-15").cast("date"))
    return rounded(found.select("symbol", "timestamp_ms", "taker_long_short_ratio", "sum_open_interest_value"))


def source_derivative_bars(spark: SparkSession, sf: str) -> DataFrame:
    root = vendor.write_klines(derivative_bars(spark, sf).withColumn("symbol", F.upper("symbol")), new_path(spark, "derivative"), "coinm-klines-{symbol}-1h-{day}.csv")
    return rounded(files.load_derivative_bars(spark, root).select(*_LOADED))


def source_metrics(spark: SparkSession, sf: str) -> DataFrame:
    root = _metrics_archive(spark, sf)
    return rounded(files.load_derivative_metrics(spark, root).select("symbol", "timestamp_ms", "taker_long_short_ratio", "sum_open_interest_value"))


def source_onchain(spark: SparkSession, sf: str) -> DataFrame:
    root = vendor.write_onchain(onchain(spark, sf), new_path(spark, "onchain"))
    return rounded(files.load_onchain(spark, root).select("asset", "metric_time_ms", "available_time_ms", "AdrActCnt", "TxCnt", "FeeTotNtv"))


def source_committed_panel(spark: SparkSession, sf: str) -> DataFrame:
    """The daily panel as parts under a manifest, every digest checked before they are read again."""
    path = new_path(spark, "committed-panel")
    committed.write_committed(panel(spark, sf, DAY), path)
    p = committed.verified(spark, path)
    return rounded(p.select("timestamp", "decision_time_ms", "asset", "forward_return", "benchmark_return", "momentum_1h", "target_close_time"), 7)


def _canned(spark: SparkSession, sf: str, per_page: int = 4) -> tuple[dict[str, bytes], dict[str, str]]:
    """(address: answer, request) of a provider that has the days' observations, a few to a page. The driver holds a row per day."""
    text = lambda c: F.col(c).cast("string").alias(c)
    at = F.date_format(F.timestamp_millis("metric_time_ms"), "yyyy-MM-dd'T'HH:mm:ss'.000000000Z'")
    days = onchain(spark, sf).select(at.alias("time"), F.lit(BENCHMARK).alias("asset"), text("AdrActCnt"), text("TxCnt"), text("FeeTotNtv")).orderBy("time")
    items = [json.loads(r[0]) for r in days.select(F.to_json(F.struct("*"))).collect()]
    request = {"assets": BENCHMARK, "metrics": "AdrActCnt,TxCnt,FeeTotNtv"}
    pages = [items[k : k + per_page] for k in range(0, len(items), per_page)] or [[]]
    address = [http.request_url("asset_metrics", request)] + [f"{http.CHAIN_BASE}/timeseries/asset-metrics?next_page_token={k}" for k in range(1, len(pages))]
    return {a: json.dumps({"data": p, **({"next_page_url": address[k + 1]} if k + 1 < len(pages) else {})}).encode() for k, (a, p) in enumerate(zip(address, pages, strict=True))}, request


def _observations(items: DataFrame) -> DataFrame:
    d = F.from_json("item", "time string, asset string, AdrActCnt string, TxCnt string, FeeTotNtv string")
    at = F.unix_millis(F.to_timestamp(F.regexp_replace(d["time"], r"(\.\d{6})\d+", "$1")))
    return rounded(items.select(d["asset"].alias("asset"), at.alias("metric_time_ms"), *(V.lenient_double(d[c]).alias(c) for c in ("AdrActCnt", "TxCnt", "FeeTotNtv"))))


def http_asset_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The days' observations from a provider's pages."""
    answers, request = _canned(spark, sf)
    ship_package(spark)
    spark.dataSource.register(http.provider(lambda url: (200, answers[url])))
    return _observations(spark.read.format("market_http").option("endpoint", "asset_metrics").option("requests", json.dumps([request])).load())


def http_metrics_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The same as a stream of three pages a batch, which stops after each and goes on from its checkpoint."""
    answers, request = _canned(spark, sf)
    ship_package(spark)
    spark.dataSource.register(http.provider(lambda url: (200, answers[url])))
    out, state = new_path(spark, "http-items"), new_path(spark, "http-state")
    for _ in range(-(-len(answers) // 3) + 1):
        stream = spark.readStream.format("market_http").option("request", json.dumps(request)).option("pagesPerBatch", "3").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
    return _observations(spark.read.schema("request string, item string").parquet(out))


def stream_bar_features(spark: SparkSession, sf: str) -> DataFrame:
    """Features of the bars as a stream of seven batches, each of which has bars of all times, so that later ones revise earlier ones."""
    b = bars(spark, sf).select("symbol", "close_time_ms", "close", "volume", "taker_buy_volume", F.when(F.col("count") % 7 != 0, F.col("volume")).alias("oi"))
    src, out = new_path(spark, "stream-bars"), new_path(spark, "stream-features")
    b.repartition(7, "symbol", "close_time_ms").write.parquet(src)
    stream = spark.readStream.schema(b.schema).option("maxFilesPerTrigger", 1).parquet(src)
    found = stream_features(stream, revisable=1 << 20).writeStream.format("parquet").option("path", out).option("checkpointLocation", new_path(spark, "stream-state")).trigger(availableNow=True).start()
    found.awaitTermination()
    return rounded(latest(spark.read.parquet(out)).select("symbol", "close_time_ms", "ret1", "ret24", "z_ret1", "z_ret4", "z_ret24", "z_order_imb", "rv24", "z_rv24", "oi_change"), 7)


def source_panel_csv(spark: SparkSession, sf: str) -> DataFrame:
    """The daily panel written as CSV, validated in file order and read again."""
    path = new_path(spark, "panel-csv")
    files.write_panel_csv(panel(spark, sf, DAY), path)
    p = files.read_panel_csv(spark, path, validate=True)
    return rounded(p.select("timestamp", "decision_time_ms", "asset", "forward_return", "benchmark_return", "momentum_1h", "target_close_time"), 7)


_LOADED = ("symbol", "open_time_ms", "close_time_ms", "open", "high", "low", "close", "volume", "count", "taker_buy_volume")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        dedup_keep_last, bars_hourly, returns_lagged, rolling_zscore, realized_vol, order_imbalance, forward_return, benchmark_attach, decision_times, basis_equi_join,
        asof_metrics, asof_onchain, oi_change, taker_transform, onchain_activity, network_growth, cross_leadlag, panel_build, panel_daily, panel_quality, readiness,
        feature_availability, universe_check, timestamp_index, fold_generator, fold_membership, missing_features, score_position, turnover_cost, portfolio_returns,
        drawdown, fold_summary, overall_summary, candidate_screen, cost_styles, event_score, join_cardinality, key_multiplicity, top_key_products, key_intersection,
        asset_from_symbol, epoch_normalize, lenient_cast, sha256_rows, calendar_reindex, wide_to_long,
        complete_rows, model_status, evaluation_overall, source_spot_bars, source_pruned_bars, source_pruned_metrics, source_derivative_bars, source_metrics, source_onchain, source_panel_csv, source_committed_panel, stream_bar_features, http_asset_metrics, http_metrics_stream,
    )
}
