"""The point-in-time panel, its quality and readiness."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.values import asset_from_symbol, growth, iso_from_ms, ms_from_iso, onchain_activity, simple_return, taker_transform
from marlstone.operators.joins import BROADCAST_ROWS, asof_backward, basis_value, derivative_close, leave_one_out
from marlstone.operators.series import BLOCK
from marlstone.operators.tables import materialize
from marlstone.operators.universe import numbered, size, universes
from marlstone.operators.windows import bar_features, last_before, long_series, rolling_zscores
from marlstone.protocol import Protocol
from marlstone.schema import PANEL, RESERVED

#: Features whose raw values are standardised per asset over the emitted rows.
STAGE_TWO = ("cross_crypto_leadlag", "oi_change_z", "basis_z", "taker_imbalance", "onchain_activity_z", "network_growth_z")
#: Fixed value: the default map of spot to derivative symbols.
DEFAULT_MAP = {"BTCUSDT": "BTCUSD_PERP"}
GAP_LIMIT_HOURS = 1.000001


def with_metrics(rows: DataFrame, metrics: DataFrame, mapping: DataFrame, split: int | None = None) -> DataFrame:
    """rows (symbol, close_time_ms, ...) with the metrics of their derivative at or before their time as `dm`, its taker and oi, and the change of oi against
    the last that isn't null in a row before. Metrics are handed to their spot symbols first, so one exchange by symbol serves both."""
    right = metrics.withColumnRenamed("symbol", "derivative").join(mapping, "derivative").drop("derivative")
    over = Window.partitionBy("symbol").orderBy("close_time_ms")
    found = asof_backward(rows, right, ["symbol"], "close_time_ms", "timestamp_ms", name="dm", split=split)
    found = found.withColumns({"taker": taker_transform(F.col("dm.taker_long_short_ratio")), "oi": F.col("dm.sum_open_interest_value")})
    return found.withColumn("oi_change", growth(F.col("oi"), last_before(F.col("oi"), over)))


def derivative_state(at: DataFrame, metrics: DataFrame, mapping: DataFrame, split: int | None = None) -> DataFrame:
    """(symbol, close_time_ms, taker, oi, oi_change) at those of `at` (symbol, close_time_ms) that have a derivative with metrics at or before them."""
    at = at.select("symbol", "close_time_ms").join(mapping.select("symbol"), "symbol", "left_semi")
    return with_metrics(at, metrics, mapping, split).where("dm is not null").drop("dm")


def onchain_state(onchain: DataFrame) -> DataFrame:
    """Daily rows with activity and growth against the row before in order of availability."""
    over = Window.partitionBy("asset").orderBy("available_time_ms")
    return onchain.select("asset", "available_time_ms", onchain_activity(F.col("AdrActCnt"), F.col("TxCnt"), F.col("FeeTotNtv")).alias("activity"), growth(F.col("AdrActCnt"), F.lag("AdrActCnt").over(over)).alias("network_growth"))


#: What the panel takes from bars' features.
_FEATURES = ("symbol", "close_time_ms", "close", "next_close", "next_close_time_ms", "ret1", "z_ret1", "z_ret4", "z_ret24", "z_order_imb", "z_rv24")


def point_in_time_panel(spot: DataFrame, benchmark_symbol: str = "BTCUSDT", derivative_bars: DataFrame | None = None, derivative_metrics: DataFrame | None = None, derivative_map: dict[str, str] | None = None, onchain: DataFrame | None = None, symbols: int | None = None, block: int | None = None) -> DataFrame:
    """The panel of PANEL's columns; features at t use rows up to t only. Bars are unique by (symbol, close_time_ms); derivative_metrics needs `symbol`, onchain
    `asset`. symbols: how many there are, if some have files but no rows.

    Bars' features are computed once. One exchange by time then tells the times that all symbols have, and attaches the benchmark and the others' mean return;
    derivatives and observations are looked up at those times alone. Series of over four blocks (by default BLOCK) are cut into blocks, the others are one task each."""
    spark = spot.sparkSession
    spot = materialize(spot, "bars")  # their count decides how they are windowed
    counts = spot.groupBy("symbol").count()
    known = counts.agg(F.max("count").alias("longest"), F.count(F.lit(1)).alias("symbols"), F.max(F.col("symbol") == benchmark_symbol).alias("benchmark")).first()
    if symbols is None and not known.benchmark:
        raise ValueError(f"no bars of the benchmark symbol {benchmark_symbol}")
    cut = block or (BLOCK if (known.longest or 0) > 4 * BLOCK else None)
    features = bar_features(spot, cut).select(*_FEATURES)
    at = Window.partitionBy("close_time_ms")
    regime = F.when(F.col("symbol") == benchmark_symbol, F.struct(simple_return(F.col("next_close"), F.col("close")).alias("r"), "z_ret24", "z_rv24"))
    times = features.withColumns({"_n": F.count(F.lit(1)).over(at), "_b": F.max(regime).over(at), "cross_crypto_leadlag": leave_one_out("ret1", "close_time_ms")})
    times = times.where(F.col("_n") == (known.symbols if symbols is None else symbols))
    rows = materialize(times.select(*_FEATURES, "cross_crypto_leadlag", F.col("_b.r").alias("benchmark_return"), F.col("_b.z_ret24").alias("regime_trend"), F.col("_b.z_rv24").alias("regime_volatility")), "decision-rows")

    none = F.lit(None).cast("double")
    pairs = list((derivative_map or DEFAULT_MAP).items())
    mapping = spark.createDataFrame(pairs, "symbol string, derivative string")
    mapping = F.broadcast(mapping) if len(pairs) <= BROADCAST_ROWS else mapping
    if derivative_metrics is not None:  # at all common times, also those without a next bar
        rows = with_metrics(rows, derivative_metrics, mapping, block or long_series(derivative_metrics, "symbol"))
    rows = rows.where("next_close_time_ms is not null and benchmark_return is not null")
    if derivative_bars is not None:
        rows = rows.join(derivative_close(derivative_bars, mapping), ["symbol", "close_time_ms"], "left").withColumn("basis", basis_value())
    if onchain is not None:
        assets = counts.select("symbol", asset_from_symbol(F.col("symbol")).alias("asset"))
        rows = asof_backward(rows, onchain_state(onchain).join(assets, "asset").drop("asset"), ["symbol"], "close_time_ms", "available_time_ms", name="oc", split=cut)
    have = set(rows.columns)
    raw = {
        "timestamp": iso_from_ms(F.col("close_time_ms")), "decision_time_ms": F.col("close_time_ms"), "asset": F.col("symbol"),
        "forward_return": simple_return(F.col("next_close"), F.col("close")),
        "momentum_1h": F.col("z_ret1"), "momentum_4h": F.col("z_ret4"), "momentum_1d": F.col("z_ret24"), "order_flow_imbalance": F.col("z_order_imb"),
        "oi_change_z": F.col("oi_change") if "oi_change" in have else none, "basis_z": F.col("basis") if "basis" in have else none, "taker_imbalance": F.col("taker") if "taker" in have else none,
        "onchain_activity_z": F.col("oc.activity") if "oc" in have else none, "network_growth_z": F.col("oc.network_growth") if "oc" in have else none,
        "source_close_time": iso_from_ms(F.col("close_time_ms")), "target_close_time": iso_from_ms(F.col("next_close_time_ms")),
        **dict.fromkeys(RESERVED, none),
    }
    panel = rows.select(*(raw.get(f.name, F.col(f.name)).alias(f.name) for f in PANEL.fields))
    return rolling_zscores(panel, STAGE_TWO, "asset", "decision_time_ms", cut)


def feature_availability(panel: DataFrame, feature_sets: dict[str, list[str]]) -> DataFrame:
    """(model, rows, complete_rows, complete_fraction, missing_features) from one pass."""
    names = sorted({f for fs in feature_sets.values() for f in fs})
    present = {f: F.col(f).isNotNull() & ~F.isnan(F.col(f)) for f in names}
    aggs = [F.count(F.lit(1)).alias("n"), *(F.coalesce(F.max(p), F.lit(False)).alias(f"has_{f}") for f, p in present.items())]
    for model, fs in feature_sets.items():
        ok = F.lit(True)
        for f in fs:
            ok = ok & present[f]
        aggs.append(F.coalesce(F.sum(ok.cast("long")), F.lit(0)).alias(f"ok_{model}"))
    one = panel.agg(*aggs)
    rows = [
        F.struct(
            F.lit(model).alias("model"), F.col("n").alias("rows"), F.col(f"ok_{model}").alias("complete_rows"),
            F.when(F.col("n") > 0, F.col(f"ok_{model}") / F.nullif(F.col("n"), F.lit(0))).otherwise(0.0).alias("complete_fraction"),
            F.filter(F.array(*(F.when(~F.col(f"has_{f}"), F.lit(f)) for f in fs)), lambda x: x.isNotNull()).alias("missing_features"),
        )
        for model, fs in feature_sets.items()
    ]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicate_keys(panel: DataFrame) -> DataFrame:
    return panel.groupBy("timestamp", "asset").count().where("count > 1")


def panel_quality(panel: DataFrame) -> DataFrame:
    """One row of quality flags. Only one row per timestamp meets in the ordering window; universes are bits, told apart by the least and the greatest, so
    no names are gathered."""
    late = ms_from_iso(F.col("target_close_time")) <= ms_from_iso(F.col("timestamp"))
    ids = numbered(panel)
    per_ts = universes(panel, ids, most={"late": late})
    w = Window.orderBy("timestamp")
    gaps = per_ts.withColumn("gap", (ms_from_iso(F.col("timestamp")) - F.lag(ms_from_iso(F.col("timestamp"))).over(w)) / F.lit(3_600_000.0))
    out = gaps.agg(
        F.count(F.lit(1)).alias("decision_timestamps"), F.coalesce(F.min("bits") == F.max("bits"), F.lit(True)).alias("stable_asset_universe"), F.max("late").alias("_late"),
        F.greatest(F.coalesce(F.max("gap"), F.lit(0.0)), F.lit(0.0)).alias("max_gap_hours"), F.max(F.col("n") > size("bits")).alias("_dup"),
    ).withColumn("asset_count", F.lit(ids.where("asset is not null").count()).cast("long"))
    return out.select(
        "decision_timestamps", "asset_count", "stable_asset_universe", (~F.coalesce(F.col("_late"), F.lit(False))).alias("target_strictly_after_decision"),
        "max_gap_hours", ((F.col("decision_timestamps") <= 1) | (F.col("max_gap_hours") <= GAP_LIMIT_HOURS)).alias("hourly_continuity_ok"), F.coalesce(F.col("_dup"), F.lit(False)).alias("duplicate_keys"),
    )


def readiness(panel: DataFrame, protocol: Protocol) -> DataFrame:
    minimum = protocol.walk_forward.minimum
    ready = (F.col("decision_timestamps") >= minimum) & F.col("stable_asset_universe") & F.col("target_strictly_after_decision") & F.col("hourly_continuity_ok") & ~F.col("duplicate_keys")
    return panel_quality(panel).withColumns({"minimum_timestamps_for_first_fold": F.lit(minimum).cast("long"), "history_ready_for_first_fold": ready})


def readiness_report(panel: DataFrame, protocol: Protocol) -> dict[str, Any]:
    """The readiness document; raises on duplicate keys. The driver gets one row, one row per model and the asset names."""
    r = readiness(panel, protocol).first().asDict()
    if r["duplicate_keys"]:
        raise ValueError(f"the panel has a duplicate key, more than one row at {tuple(duplicate_keys(panel).first())[:2]}")
    assets = sorted(x[0] for x in panel.select("asset").distinct().collect())
    models = feature_availability(panel, protocol.feature_sets).collect()
    ready = bool(r["history_ready_for_first_fold"])
    # fixed values: the document's keys, mode and decisions
    return {
        "schema_version": "1.1.0", "mode": "RESEARCH_ONLY", "decision_timestamps": r["decision_timestamps"], "assets": assets, "asset_count": len(assets),
        "minimum_timestamps_for_first_fold": r["minimum_timestamps_for_first_fold"], "history_ready_for_first_fold": ready,
        "data_quality": {k: r[k] for k in ("stable_asset_universe", "target_strictly_after_decision", "max_gap_hours", "hourly_continuity_ok", "duplicate_keys")},
        "feature_availability": {m["model"]: {k: m[k] for k in ("rows", "complete_rows", "complete_fraction", "missing_features")} for m in models},
        "holdout_accessed": False, "EDGE_VERIFIED": False, "paper_authorized": False, "testnet_authorized": False, "live_authorized": False,
        "decision": "DATASET_READY_FOR_ABLATION" if ready else "ACCUMULATE_MORE_PROSPECTIVE_DATA",
    }
