"""DuckDB SQL for the catalogue: written from the definitions, with other forms (ASOF JOIN, self-joins) than the Spark plans."""

from __future__ import annotations

from marlstone.plans.queries import BENCHMARK, DAY, DERIVATIVE, EVALUATED, HOUR, PROTOCOL


def _bars(step: int, name: str = "bars", where: str = "true", symbol: str = "event_type") -> str:
    return f"""{name} AS (
  SELECT {symbol} AS symbol, ((epoch_us(ts) // 1000) // {step}) * {step} AS open_time_ms, ((epoch_us(ts) // 1000) // {step}) * {step} + {step} - 1 AS close_time_ms,
         arg_min(value, ts) AS "open", max(value) AS high, min(value) AS low, arg_max(value, ts) AS "close", sum(value) AS volume, count(*) AS "count",
         coalesce(sum(CASE WHEN event_id % 2 = 0 THEN value END), 0.0) AS taker_buy_volume
  FROM events WHERE {where} GROUP BY 1, 2, 3)"""


def _z(c: str, part: str, order: str) -> str:
    w = f"(PARTITION BY {part} ORDER BY {order} ROWS BETWEEN 167 PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN {c} IS NOT NULL AND count({c}) OVER {w} >= 12 THEN CASE WHEN coalesce(stddev_samp({c}) OVER {w}, 0) = 0 THEN 0.0 ELSE ({c} - avg({c}) OVER {w}) / stddev_samp({c}) OVER {w} END END"


def _ret(now: str, then: str) -> str:
    return f"CASE WHEN {then} > 0 THEN {now} / {then} - 1 END"


_W = "(PARTITION BY symbol ORDER BY close_time_ms)"
_FEATURES = f"""r AS (
  SELECT *, {_ret('"close"', f'lag("close", 1) OVER {_W}')} AS ret1, {_ret('"close"', f'lag("close", 4) OVER {_W}')} AS ret4, {_ret('"close"', f'lag("close", 24) OVER {_W}')} AS ret24,
         CASE WHEN volume > 0 THEN 2.0 * taker_buy_volume / volume - 1 END AS order_imb, lead("close") OVER {_W} AS next_close, lead(close_time_ms) OVER {_W} AS next_close_time_ms,
         row_number() OVER {_W} AS n FROM bars),
v AS (
  SELECT *, CASE WHEN n > 24 AND count(ret1) OVER w >= 12 THEN stddev_pop(ret1) OVER w * sqrt(24.0) END AS rv24 FROM r
  WINDOW w AS (PARTITION BY symbol ORDER BY close_time_ms ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
feat AS (SELECT *, {', '.join(f"{_z(c, 'symbol', 'close_time_ms')} AS z_{c}" for c in ('ret1', 'ret4', 'ret24', 'order_imb', 'rv24'))} FROM v)"""
_BENCH = f"""bench AS (
  SELECT close_time_ms, next_close / "close" - 1 AS benchmark_return, z_ret24 AS regime_trend, z_rv24 AS regime_volatility
  FROM feat WHERE symbol = '{BENCHMARK}' AND "close" > 0 AND next_close IS NOT NULL)"""
_TIMES = "times AS (SELECT close_time_ms FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) = (SELECT count(DISTINCT symbol) FROM bars))"
_METRICS = f"""metrics AS (
  SELECT '{DERIVATIVE}' AS symbol, (epoch_us(ts) // 1000) AS timestamp_ms, value / 100 AS taker_long_short_ratio, CASE WHEN event_id % 7 <> 0 THEN value END AS sum_open_interest_value
  FROM events WHERE event_type = 'view')"""
_ONCHAIN = f"""onchain AS (
  SELECT '{BENCHMARK}' AS asset, ((epoch_us(ts) // 1000) // {DAY}) * {DAY} + {DAY} AS available_time_ms, count(DISTINCT user_id)::DOUBLE AS "AdrActCnt", count(*)::DOUBLE AS "TxCnt", sum(value) AS "FeeTotNtv"
  FROM events GROUP BY 1, 2),
oc AS (
  SELECT asset, available_time_ms, "AdrActCnt", "TxCnt", (ln(1 + "AdrActCnt") + ln(1 + "TxCnt") + ln(1 + "FeeTotNtv")) / 3 AS activity,
         CASE WHEN lag("AdrActCnt") OVER o <> 0 THEN "AdrActCnt" / lag("AdrActCnt") OVER o - 1 END AS network_growth
  FROM onchain WINDOW o AS (PARTITION BY asset ORDER BY available_time_ms))"""
_TAKER = "CASE WHEN taker_long_short_ratio > 0 THEN tanh(ln(taker_long_short_ratio)) END"
_OI = f"""dm AS (
  SELECT t.close_time_ms, {_TAKER.replace('taker_long', 'm.taker_long')} AS taker, m.sum_open_interest_value AS oi FROM times t ASOF JOIN metrics m ON t.close_time_ms >= m.timestamp_ms),
dp AS (
  SELECT *, last_value(oi IGNORE NULLS) OVER (ORDER BY close_time_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM dm),
doi AS (SELECT close_time_ms, taker, oi, CASE WHEN prev <> 0 THEN oi / prev - 1 END AS oi_change FROM dp)"""


def _deriv(step: int) -> str:
    return _bars(step, "deriv", "event_type = 'purchase'", f"'{DERIVATIVE}'")


_BASIS = f"""basis AS (
  SELECT s.symbol, s.close_time_ms, d."close" / s."close" - 1 AS basis FROM bars s JOIN deriv d ON s.close_time_ms = d.close_time_ms WHERE s.symbol = '{BENCHMARK}' AND s."close" > 0)"""
_CROSS = """cross_ AS (
  SELECT a.symbol, a.close_time_ms, avg(b.ret1) - any_value(a.ret1) AS leadlag FROM feat a JOIN times USING (close_time_ms)
  LEFT JOIN feat b ON b.close_time_ms = a.close_time_ms AND b.symbol <> a.symbol GROUP BY 1, 2)"""


def _iso(ms: str) -> str:
    return f"CASE WHEN {ms} % 1000 = 0 THEN strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%SZ') ELSE strftime(make_timestamp({ms} * 1000), '%Y-%m-%dT%H:%M:%S.%fZ') END"


_STAGE2 = ("cross_crypto_leadlag", "oi_change_z", "basis_z", "taker_imbalance", "onchain_activity_z", "network_growth_z")
_NULLS = ("funding_z", "book_imbalance", "microprice_edge", "exchange_netflow_z", "sentiment_z", "news_novelty", "llm_event_score", "llm_event_confidence", "spread_bps", "slippage_bps", "funding_bps")


def _panel(step: int) -> str:
    return f"""{_bars(step)}, {_deriv(step)}, {_FEATURES}, {_BENCH}, {_TIMES}, {_METRICS}, {_ONCHAIN}, {_OI}, {_BASIS}, {_CROSS},
rawp AS (
  SELECT {_iso('f.close_time_ms')} AS "timestamp", f.close_time_ms AS decision_time_ms, f.symbol AS asset, {_ret('f.next_close', 'f."close"')} AS forward_return, b.benchmark_return,
         f.z_ret1 AS momentum_1h, f.z_ret4 AS momentum_4h, f.z_ret24 AS momentum_1d, c.leadlag AS cross_crypto_leadlag, d.oi_change AS oi_change_z, s.basis AS basis_z, d.taker AS taker_imbalance,
         f.z_order_imb AS order_flow_imbalance, o.activity AS onchain_activity_z, o.network_growth AS network_growth_z, b.regime_trend, b.regime_volatility,
         {', '.join(f'NULL::DOUBLE AS {c}' for c in _NULLS)},
         {_iso('f.close_time_ms')} AS source_close_time, {_iso('f.next_close_time_ms')} AS target_close_time
  FROM feat f JOIN times USING (close_time_ms) JOIN bench b USING (close_time_ms) JOIN cross_ c ON c.symbol = f.symbol AND c.close_time_ms = f.close_time_ms
  LEFT JOIN doi d ON d.close_time_ms = f.close_time_ms AND f.symbol = '{BENCHMARK}' LEFT JOIN basis s ON s.symbol = f.symbol AND s.close_time_ms = f.close_time_ms
  ASOF LEFT JOIN oc o ON o.asset = f.symbol AND f.close_time_ms >= o.available_time_ms
  WHERE f.next_close_time_ms IS NOT NULL),
panel AS (SELECT * REPLACE ({', '.join(f"{_z(c, 'asset', 'decision_time_ms')} AS {c}" for c in _STAGE2)}) FROM rawp)"""


_wf = PROTOCOL.walk_forward
_FOLDS = f"""gen AS (SELECT k AS fold, {_wf.min_train_rows} + k * {_wf.step_rows} AS train_end FROM generate_series(0, 100000) g(k)),
folds AS (
  SELECT fold, 0::BIGINT AS train_start, train_end AS train_end_exclusive, train_end AS purge_start, train_end + {_wf.purge_rows} AS test_start,
         least(train_end + {_wf.purge_rows + _wf.test_rows}, n) AS test_end_exclusive, least(n, least(train_end + {_wf.purge_rows + _wf.test_rows}, n) + {_wf.embargo_rows}) AS embargo_end_exclusive
  FROM gen, cnt WHERE train_end + {_wf.purge_rows} < n)"""
_MEMBERS = f"""{_panel(HOUR)}, ix AS (SELECT "timestamp", row_number() OVER (ORDER BY "timestamp") - 1 AS idx FROM (SELECT DISTINCT "timestamp" FROM panel)),
cnt AS (SELECT count(*) AS n FROM ix), {_FOLDS},
members AS (SELECT p.*, ix.idx, f.fold FROM panel p JOIN ix USING ("timestamp") JOIN folds f ON ix.idx >= f.test_start AND ix.idx < f.test_end_exclusive)"""


def _score(features: list[str]) -> str:
    c = PROTOCOL.clip
    total = " + ".join(f"coalesce(CASE WHEN {f} > {c} THEN {c} WHEN {f} < -{c} THEN -{c} ELSE {f} END / {c}, 0)" for f in features)
    n = " + ".join(f"({f} IS NOT NULL)::INT" for f in features)
    return f"CASE WHEN {n} = 0 THEN 0.0 ELSE ({total}) / ({n}) END"


_SCORED = f"""{_MEMBERS}, scored0 AS ({' UNION ALL '.join(f"SELECT '{m}' AS model, *, round({_score(PROTOCOL.feature_sets[m])}, 10) AS score FROM members" for m in EVALUATED)}),
scored AS (SELECT *, CASE WHEN score >= {PROTOCOL.entry_threshold} THEN 1 WHEN score <= -{PROTOCOL.entry_threshold} THEN -1 ELSE 0 END::BIGINT AS position FROM scored0)"""
_TRADED = f"""{_SCORED}, tt AS (SELECT *, abs(position - lag(position, 1, 0) OVER (PARTITION BY model, fold, asset ORDER BY idx)) AS turnover FROM scored),
traded AS (SELECT *, position * forward_return AS gross, turnover * 7.0 / 10000 AS cost, 0.0 AS funding FROM tt)"""
_RETURNS = f"""{_TRADED}, pr0 AS (
  SELECT model, fold, idx, "timestamp", sum(gross) / count(*) AS gross, sum(cost) / count(*) AS cost, sum(turnover) / count(*) AS turnover,
         count(*) FILTER (turnover > 0) AS transitions, min(benchmark_return) AS benchmark FROM traded GROUP BY 1, 2, 3, 4),
pr AS (SELECT *, gross - cost AS net FROM pr0)"""


def _summary(by: str, order: str) -> str:
    w = f"(PARTITION BY {by} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"""{_RETURNS}, eq AS (SELECT *, product(1 + net) OVER {w} AS equity FROM pr),
dd AS (SELECT *, equity / greatest(1.0, max(equity) OVER {w}) - 1 AS drawdown FROM eq),
summ AS (
  SELECT {by}, count(*) AS observations, product(1 + gross) - 1 AS gross_return, product(1 + net) - 1 AS net_return, product(1 + benchmark) - 1 AS benchmark_return,
         product(1 + net) - product(1 + benchmark) AS simple_alpha, CASE WHEN count(*) >= 2 AND stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) * sqrt({PROTOCOL.annualization}) END AS sharpe,
         least(0.0, min(drawdown)) AS max_drawdown, sum(turnover) AS turnover, sum(transitions)::BIGINT AS position_transitions, sum(cost) AS execution_cost_fraction_sum
  FROM dd GROUP BY {by})"""


_SHARE = """pf AS (SELECT model, fold, product(1 + net) - 1 AS r FROM pr GROUP BY 1, 2),
share AS (SELECT model, count(*) FILTER (r > 0) AS positive_folds, count(*) AS fold_count FROM pf GROUP BY 1)"""
_SUMS = ("gross_return", "net_return", "benchmark_return", "simple_alpha", "sharpe", "max_drawdown", "turnover", "execution_cost_fraction_sum")


def _round(names: tuple[str, ...] | list[str], digits: int = 8) -> str:
    return ", ".join(f"round({n}, {digits}) + 0.0 AS {n}" for n in names)


def _places(names: tuple[str, ...]) -> str:
    return ", ".join(f"CASE WHEN abs({n}) < 10000 THEN round({n}, 6) ELSE round({n}, 2) END + 0.0 AS {n}" for n in names)


_PANEL_DOUBLES = ["forward_return", "benchmark_return", "momentum_1h", "momentum_4h", "momentum_1d", *_STAGE2, "order_flow_imbalance", "regime_trend", "regime_volatility"]
_QUALITY = f"""{_panel(HOUR)}, ts AS (SELECT decision_time_ms AS t, list_sort(list(DISTINCT asset)) AS assets, count(*) AS n FROM panel GROUP BY 1),
gaps AS (SELECT *, (t - lag(t) OVER (ORDER BY t)) / 3600000.0 AS gap FROM ts),
quality AS (
  SELECT count(*) AS decision_timestamps, (SELECT count(DISTINCT asset) FROM panel) AS asset_count, count(DISTINCT assets) <= 1 AS stable_asset_universe, true AS target_strictly_after_decision,
         coalesce(max(gap), 0.0) AS max_gap_hours, count(*) <= 1 OR coalesce(max(gap), 0.0) <= 1.000001 AS hourly_continuity_ok, coalesce(max(n > len(assets)), false) AS duplicate_keys FROM gaps)"""
_availability = " UNION ALL ".join(
    f"SELECT '{m}' AS model, count(*) AS \"rows\", count(*) FILTER ({' AND '.join(f'{f} IS NOT NULL' for f in fs)}) AS complete_rows, "
    f"round(CASE WHEN count(*) > 0 THEN count(*) FILTER ({' AND '.join(f'{f} IS NOT NULL' for f in fs)}) / count(*) ELSE 0.0 END, 8) AS complete_fraction, "
    f"concat_ws(',', {', '.join(f'''CASE WHEN count({f}) = 0 THEN '{f}' END''' for f in fs)}) AS missing_features FROM panel"
    for m, fs in PROTOCOL.feature_sets.items()
)
_missing = " UNION ALL ".join(f"SELECT '{m}' AS model, '{f}' AS feature, count(*) - count({f}) AS missing FROM members" for m, fs in PROTOCOL.feature_sets.items() for f in fs)
_B = f"WITH {_bars(HOUR)}"
_STATUS = f"""{_MEMBERS}, lacking AS (SELECT model, string_agg(feature, ',' ORDER BY feature) AS missing_features FROM ({_missing}) WHERE missing > 0 GROUP BY 1),
sets(model) AS (VALUES {', '.join(f"('{m}')" for m in PROTOCOL.feature_sets)}),
status AS (SELECT s.model, CASE WHEN missing_features IS NULL THEN 'EVALUATED_OOS' ELSE 'BLOCKED_MISSING_FEATURES' END AS status, coalesce(missing_features, '') AS missing_features FROM sets s LEFT JOIN lacking USING (model))"""
_LOADED = 'open_time_ms, close_time_ms, "open", high, low, "close", round(volume, 8) AS volume, "count", round(taker_buy_volume, 8) AS taker_buy_volume'


def _overall() -> str:
    summary = _summary("model", "fold, idx").replace("position * forward_return", "position * (forward_return / 100000)")
    return f"""WITH {summary}, {_SHARE}, {_STATUS.removeprefix(_MEMBERS + ', ')},
o AS (SELECT s.*, positive_folds, fold_count, positive_folds / fold_count >= 0.6 AND net_return > 0 AND simple_alpha > 0 AND coalesce(sharpe > 0, false) AS ok FROM summ s JOIN share USING (model))
SELECT t.model, t.status, CASE WHEN t.missing_features = '' THEN fold_count ELSE 0 END AS folds, CASE WHEN t.missing_features = '' THEN ok ELSE false END AS candidate_screen_pass,
       {', '.join(f"CASE WHEN t.missing_features = '' THEN {v} END AS {n}" for n, v in (("observations", "observations"), ("net_return", "round(net_return, 6) + 0.0"), ("max_drawdown", "round(max_drawdown, 6) + 0.0"), ("turnover", "round(turnover, 6) + 0.0"), ("positive_folds", "positive_folds")))}
FROM status t JOIN o USING (model)"""


_OBSERVED = f'WITH {_ONCHAIN} SELECT asset, available_time_ms - {DAY} AS metric_time_ms, "AdrActCnt", "TxCnt", round("FeeTotNtv", 8) AS "FeeTotNtv" FROM onchain'

ORACLES: dict[str, str] = {
    "dedup_keep_last": f"SELECT user_id, day, event_id, event_type, value FROM (SELECT *, (epoch_us(ts) // 1000) // {DAY} AS day, row_number() OVER (PARTITION BY user_id, (epoch_us(ts) // 1000) // {DAY} ORDER BY event_id DESC) AS k FROM events) WHERE k = 1",
    "bars_hourly": f'{_B} SELECT symbol, open_time_ms, close_time_ms, "open", high, low, "close", round(volume, 8) AS volume, "count", round(taker_buy_volume, 8) AS taker_buy_volume FROM bars',
    "returns_lagged": f"{_B}, {_FEATURES} SELECT symbol, close_time_ms, {_round(['ret1', 'ret4', 'ret24'])} FROM feat",
    "rolling_zscore": f"{_B}, {_FEATURES} SELECT symbol, close_time_ms, {_round(['z_ret1', 'z_ret4', 'z_ret24', 'z_order_imb', 'z_rv24'])} FROM feat",
    "realized_vol": f"{_B}, {_FEATURES} SELECT symbol, close_time_ms, {_round(['rv24'])} FROM feat",
    "order_imbalance": f"{_B}, {_FEATURES} SELECT symbol, close_time_ms, {_round(['order_imb'])} FROM feat",
    "forward_return": f"{_B}, {_FEATURES} SELECT symbol, close_time_ms, coalesce(next_close_time_ms, -1) AS next_close_time_ms, round({_ret('next_close', chr(34) + 'close' + chr(34))}, 8) + 0.0 AS forward_return FROM feat",
    "benchmark_attach": f"{_B}, {_FEATURES}, {_BENCH} SELECT f.symbol, close_time_ms, {_round(['benchmark_return', 'regime_trend', 'regime_volatility'])} FROM feat f JOIN bench b USING (close_time_ms)",
    "decision_times": f"{_B}, {_TIMES} SELECT close_time_ms FROM times",
    "basis_equi_join": f"{_B}, {_deriv(HOUR)}, {_BASIS} SELECT symbol, close_time_ms, {_round(['basis'])} FROM basis",
    "asof_metrics": f"{_B}, {_METRICS} SELECT '{DERIVATIVE}' AS symbol, b.close_time_ms, m.timestamp_ms, {_round(['taker_long_short_ratio', 'sum_open_interest_value'])} FROM (SELECT * FROM bars WHERE symbol = '{BENCHMARK}') b ASOF LEFT JOIN metrics m ON b.close_time_ms >= m.timestamp_ms",
    "asof_onchain": f'{_B}, {_ONCHAIN} SELECT b.symbol, b.close_time_ms, coalesce(o.available_time_ms, -1) AS available_time_ms, o."AdrActCnt", o."TxCnt" FROM bars b ASOF LEFT JOIN oc o ON o.asset = b.symbol AND b.close_time_ms >= o.available_time_ms',
    "oi_change": f"{_B}, {_TIMES}, {_METRICS}, {_OI} SELECT '{BENCHMARK}' AS symbol, close_time_ms, {_round(['oi', 'oi_change'])} FROM doi",
    "taker_transform": f"WITH {_METRICS} SELECT timestamp_ms, round({_TAKER}, 8) + 0.0 AS taker FROM metrics",
    "onchain_activity": f"WITH {_ONCHAIN} SELECT available_time_ms, {_round(['activity'])} FROM oc",
    "network_growth": f"WITH {_ONCHAIN} SELECT available_time_ms, {_round(['network_growth'])} FROM oc",
    "cross_leadlag": f"{_B}, {_FEATURES}, {_TIMES}, {_CROSS} SELECT symbol, close_time_ms, {_round(['leadlag'])} FROM cross_",
    "panel_build": f'WITH {_panel(HOUR)} SELECT "timestamp", decision_time_ms, asset, {_round(_PANEL_DOUBLES, 7)}, {", ".join(_NULLS)}, source_close_time, target_close_time FROM panel',
    "panel_daily": f"WITH {_panel(DAY)} SELECT decision_time_ms, asset, {_round(['forward_return', 'benchmark_return', 'momentum_1h', 'momentum_4h', 'basis_z'], 7)} FROM panel",
    "panel_quality": f"WITH {_QUALITY} SELECT * REPLACE (round(max_gap_hours, 8) AS max_gap_hours) FROM quality",
    "readiness": f"WITH {_QUALITY} SELECT decision_timestamps, {_wf.minimum}::BIGINT AS minimum_timestamps_for_first_fold, decision_timestamps >= {_wf.minimum} AND stable_asset_universe AND hourly_continuity_ok AND NOT duplicate_keys AS history_ready_for_first_fold FROM quality",
    "feature_availability": f"WITH {_panel(HOUR)} {_availability}",
    "universe_check": f"""{_B}, s AS (SELECT close_time_ms, list_sort(list(symbol)) AS a FROM bars GROUP BY 1), f AS (SELECT arg_min(a, close_time_ms) AS a0 FROM s)
SELECT {_iso('close_time_ms')} AS "timestamp", array_to_string(list_filter(a0, lambda x: NOT list_contains(a, x)), ',') AS missing, array_to_string(list_filter(a, lambda x: NOT list_contains(a0, x)), ',') AS extra FROM s, f WHERE a <> a0""",
    "timestamp_index": f'WITH {_MEMBERS} SELECT "timestamp", idx FROM ix',
    "fold_generator": f"{_B}, {_TIMES}, cnt AS (SELECT count(*) AS n FROM times), {_FOLDS} SELECT * FROM folds",
    "fold_membership": f'WITH {_MEMBERS} SELECT "timestamp", asset, fold, idx FROM members',
    "missing_features": f"WITH {_MEMBERS} SELECT * FROM ({_missing}) WHERE missing > 0",
    "score_position": f'WITH {_SCORED} SELECT model, fold, "timestamp", asset, score + 0.0 AS score, position FROM scored',
    "turnover_cost": f'WITH {_TRADED} SELECT model, fold, "timestamp", asset, turnover, {_round(["gross", "cost", "funding"])} FROM traded',
    "portfolio_returns": f'WITH {_RETURNS} SELECT model, fold, "timestamp", {_round(["gross", "cost", "turnover", "net"])}, transitions FROM pr',
    "drawdown": f'WITH {_summary("model, fold", "idx")} SELECT model, fold, "timestamp", round(equity, 7) AS equity, round(equity / (1 + drawdown), 7) AS peak, round(drawdown, 7) + 0.0 AS drawdown FROM dd',
    "fold_summary": f"WITH {_summary('model, fold', 'idx')} SELECT model, fold, observations, position_transitions, {_places(_SUMS)} FROM summ",
    "overall_summary": f"WITH {_summary('model', 'fold, idx')}, {_SHARE} SELECT s.model, observations, position_transitions, {_places(_SUMS)}, positive_folds, fold_count, round(positive_folds / fold_count, 6) AS positive_fold_fraction FROM summ s JOIN share USING (model)",
    "candidate_screen": f"WITH {_summary('model', 'fold, idx')}, {_SHARE} SELECT s.model, positive_folds / fold_count >= 0.6 AND net_return > 0 AND simple_alpha > 0 AND coalesce(sharpe > 0, false) AS candidate_screen_pass FROM summ s JOIN share USING (model)",
    "cost_styles": """SELECT event_id, round(t * (4 + h + s) / 10000, 12) AS taker, round(t * (2 + h + s) / 10000, 12) AS maker FROM (SELECT event_id, event_id % 3 AS t,
CASE WHEN event_id % 3 <> 0 THEN greatest(0.0, value / 100 - 1) / 2 ELSE 1.0 END AS h, CASE WHEN event_id % 5 <> 0 THEN greatest(0.0, value / 200 - 1) ELSE 2.0 END AS s FROM events)""",
    "event_score": """SELECT event_id, round(CASE WHEN v > 3 THEN 3.0 WHEN v < -3 THEN -3.0 ELSE v END / 3.0, 8) + 0.0 AS score FROM (
SELECT event_id, (value / 100 - 2) * CASE WHEN event_id % 4 <> 0 THEN least(1.0, greatest(0.0, value / 150 - 0.5)) ELSE 1.0 END AS v FROM events)""",
    "join_cardinality": "SELECT count(DISTINCT o_orderkey) AS common_keys, count(*) AS expected_inner_rows FROM orders JOIN lineitem ON o_orderkey = l_orderkey",
    "key_multiplicity": "SELECT sum(n)::BIGINT AS \"rows\", count(*) AS unique_keys, sum(n - 1)::BIGINT AS duplicate_rows, max(n) AS max_multiplicity, sum(n - 1) = 0 AS is_unique FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey)",
    "top_key_products": """SELECT k, a.n AS left_multiplicity, b.n AS right_multiplicity, a.n * b.n AS "rows" FROM (SELECT o_orderkey AS k, count(*) AS n FROM orders GROUP BY 1) a
JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) b USING (k) ORDER BY "rows" DESC, k LIMIT 10""",
    "key_intersection": "SELECT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
    "asset_from_symbol": """SELECT p_partkey, symbol, lower(CASE WHEN symbol LIKE '%USDT' OR symbol LIKE '%USDC' OR symbol LIKE '%BUSD' THEN left(symbol, length(symbol) - 4) WHEN symbol LIKE '%USD' THEN left(symbol, length(symbol) - 3) ELSE symbol END) AS asset
FROM (SELECT p_partkey, upper(left(p_brand, 5)) || (['USDT', 'USDC', 'BUSD', 'USD', 'EUR'])[p_partkey % 5 + 1] AS symbol FROM part)""",
    "epoch_normalize": f"""SELECT event_id, ms, {_iso('ms')} AS iso FROM (SELECT event_id, CASE WHEN raw > 100000000000000 THEN raw // 1000 ELSE raw END AS ms FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (epoch_us(ts) // 1000) * 1000 + 7 ELSE (epoch_us(ts) // 1000) END AS raw FROM events))""",
    "lenient_cast": """SELECT event_id, CASE WHEN isfinite(n) THEN n END AS number FROM (SELECT event_id, try_cast(t AS DOUBLE) AS n FROM (
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN (['', 'abc', 'NaN', 'inf', '-inf', '1e3', ' 2.5 '])[event_id % 7 + 1] ELSE event_id::VARCHAR END AS t FROM events))""",
    "sha256_rows": "SELECT doc_id, sha256(text) AS sha256 FROM documents",
    "calendar_reindex": f"""{_B}, g AS (SELECT unnest(generate_series(min(close_time_ms), max(close_time_ms), {HOUR})) AS close_time_ms FROM bars)
SELECT s.symbol, g.close_time_ms, b."close" FROM g CROSS JOIN (SELECT DISTINCT symbol FROM bars) s LEFT JOIN bars b ON b.symbol = s.symbol AND b.close_time_ms = g.close_time_ms""",
    "wide_to_long": f"{_B} " + " UNION ALL ".join(f"SELECT symbol, close_time_ms, '{c}' AS field, \"{c}\" AS price FROM bars" for c in ("open", "high", "low", "close")),
    "complete_rows": """SELECT event_id, round(value, 8) AS a, round(value / 2, 8) AS b FROM events WHERE event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 3 <> 0""",
    "model_status": f"WITH {_STATUS} SELECT model, status, missing_features FROM status",
    "evaluation_overall": _overall(),
    "source_spot_bars": f"{_B} SELECT upper(symbol) AS symbol, {_LOADED} FROM bars",
    "source_pruned_bars": f"{_B} SELECT upper(symbol) AS symbol, {_LOADED} FROM bars WHERE symbol = '{BENCHMARK}' AND make_timestamp(open_time_ms * 1000) >= TIMESTAMP '2024-01-08' AND make_timestamp(open_time_ms * 1000) < TIMESTAMP '2024-01-15'",
    "source_pruned_metrics": f"""WITH {_METRICS} SELECT upper(symbol) AS symbol, timestamp_ms // 1000 * 1000 AS timestamp_ms, round(arg_max(taker_long_short_ratio, timestamp_ms), 8) AS taker_long_short_ratio,
round(arg_max_null(sum_open_interest_value, timestamp_ms), 8) AS sum_open_interest_value FROM metrics WHERE make_timestamp(timestamp_ms * 1000) >= TIMESTAMP '2024-01-15' GROUP BY 1, 2""",
    "source_derivative_bars": f"WITH {_deriv(HOUR)} SELECT upper(symbol) AS symbol, {_LOADED} FROM deriv",
    "source_metrics": f"""WITH {_METRICS} SELECT upper(symbol) AS symbol, timestamp_ms // 1000 * 1000 AS timestamp_ms, round(arg_max(taker_long_short_ratio, timestamp_ms), 8) AS taker_long_short_ratio,
round(arg_max_null(sum_open_interest_value, timestamp_ms), 8) AS sum_open_interest_value FROM metrics GROUP BY 1, 2""",
    "source_onchain": f'WITH {_ONCHAIN} SELECT asset, available_time_ms - {DAY} AS metric_time_ms, available_time_ms, "AdrActCnt", "TxCnt", round("FeeTotNtv", 8) AS "FeeTotNtv" FROM onchain',
    "http_asset_metrics": _OBSERVED,
    "http_metrics_stream": _OBSERVED,
    "stream_bar_features": f"""{_B}, {_FEATURES}, q AS (SELECT *, CASE WHEN "count" % 7 <> 0 THEN volume END AS oi FROM feat),
p AS (SELECT *, last_value(oi IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY close_time_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM q)
SELECT symbol, close_time_ms, {_round(['ret1', 'ret24', 'z_ret1', 'z_ret4', 'z_ret24', 'z_order_imb', 'rv24', 'z_rv24'], 7)}, round(CASE WHEN prev <> 0 THEN oi / prev - 1 END, 7) + 0.0 AS oi_change FROM p""",
    "source_panel_csv": f'WITH {_panel(DAY)} SELECT "timestamp", decision_time_ms, asset, {_round(["forward_return", "benchmark_return", "momentum_1h"], 7)}, target_close_time FROM panel',
    "source_committed_panel": f'WITH {_panel(DAY)} SELECT "timestamp", decision_time_ms, asset, {_round(["forward_return", "benchmark_return", "momentum_1h"], 7)}, target_close_time FROM panel',
}
