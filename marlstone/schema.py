"""Explicit schemas. Nothing in the library infers a schema."""

from __future__ import annotations

from pyspark.sql import types as T

_D, _L, _S = T.DoubleType(), T.LongType(), T.StringType()


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields])


#: Names and order of the columns of bars, metrics, observations and the panel.
BARS = _struct(
    ("symbol", _S), ("open_time_ms", _L), ("close_time_ms", _L), ("open", _D), ("high", _D), ("low", _D), ("close", _D),
    ("volume", _D), ("quote_volume", _D), ("count", _L), ("taker_buy_volume", _D), ("taker_buy_quote_volume", _D), ("source_path", _S),
)
METRICS = _struct(
    ("timestamp_ms", _L), ("sum_open_interest", _D), ("sum_open_interest_value", _D), ("toptrader_count_ratio", _D),
    ("toptrader_sum_ratio", _D), ("global_long_short_ratio", _D), ("taker_long_short_ratio", _D), ("source_path", _S),
)
ONCHAIN = _struct(
    ("metric_time_ms", _L), ("available_time_ms", _L), ("AdrActCnt", _D), ("TxCnt", _D), ("FeeTotNtv", _D), ("source_path", _S),
)

#: Feature columns of the panel that no source fills yet; they are part of the format and stay null.
RESERVED = (
    "funding_z", "book_imbalance", "microprice_edge", "exchange_netflow_z", "sentiment_z", "news_novelty",
    "llm_event_score", "llm_event_confidence", "spread_bps", "slippage_bps", "funding_bps",
)
PANEL = _struct(
    ("timestamp", _S), ("decision_time_ms", _L), ("asset", _S),
    *((name, _D) for name in (
        "forward_return", "benchmark_return", "momentum_1h", "momentum_4h", "momentum_1d", "cross_crypto_leadlag", "funding_z",
        "oi_change_z", "basis_z", "taker_imbalance", "order_flow_imbalance", "book_imbalance", "microprice_edge",
        "onchain_activity_z", "exchange_netflow_z", "network_growth_z", "sentiment_z", "news_novelty", "llm_event_score",
        "llm_event_confidence", "regime_trend", "regime_volatility", "spread_bps", "slippage_bps", "funding_bps",
    )),
    ("source_close_time", _S), ("target_close_time", _S),
)
