"""Features of bars as they arrive, from state of bounded size.

Per symbol the state holds the last CONTEXT + `revisable` bars, how many came before those, and the last open interest before them. A batch's bars are put in
their places (a bar of a known time replaces it), and the features of the first place that changed and of all after it come out: new bars add rows, a late or corrected bar
revises the rows behind it too. The features of a bar need the CONTEXT bars before it and no more: a z-score looks at 168 values, each of a return over 24
bars. So rows are those of the batch plan over the whole series, for any split of the input and any order of arrival, as long as a late bar has its
context in the state. One that hasn't comes out alone with `too_late` set and changes nothing; `merge_bars` of streaming.accumulate takes those. Null and NaN
are alike: no value.

Rows are revisions: the last one of a (symbol, close_time_ms) by `revision`, the count of the symbol's batches, counts (`latest`).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marlstone.operators.joins import keep_last
from marlstone.shipping import ship_by_value, ship_package

#: Bars before one that its features depend on: 167 of the z-score and 24 of the longest return.
CONTEXT = 191
LAGS = {"ret1": 1, "ret4": 4, "ret24": 24}
STANDARDISED = (*LAGS, "order_imb", "rv24")
INPUT = ("close_time_ms", "close", "volume", "taker_buy_volume", "oi")
STATE = "before long, oi double, revision long, times array<long>, bars array<array<double>>"
OUTPUT = "symbol string, close_time_ms long, " + ", ".join(f"{n} double" for n in (*LAGS, "order_imb", "rv24", *(f"z_{n}" for n in STANDARDISED), "oi_change")) + ", too_late boolean, revision long"


def _rolled(x: np.ndarray, window: int) -> np.ndarray:
    """A row of the last `window` values for each value, those before the first missing."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(window - 1, np.nan), x]), window)


def _ratio(now: np.ndarray, then: np.ndarray) -> np.ndarray:
    with np.errstate(all="ignore"):
        return np.where(then > 0, now / then - 1, np.nan)


def rolling_zscores(x: np.ndarray, window: int = 168, least: int = 12) -> np.ndarray:
    w = _rolled(x, window)
    n = (~np.isnan(w)).sum(axis=1)
    with np.errstate(all="ignore"):
        mean = np.nansum(w, axis=1) / n
        sd = np.sqrt(np.nansum((w - mean[:, None]) ** 2, axis=1) / (n - 1))
        same = np.fmax.reduce(w, axis=1) == np.fmin.reduce(w, axis=1)
        z = np.where(same | (sd == 0), 0.0, (x - mean) / sd)
    return np.where(~np.isnan(x) & (n >= least), z, np.nan)


def realized_vols(ret: np.ndarray, place: np.ndarray, window: int = 24, least: int = 12) -> np.ndarray:
    w = _rolled(ret, window)
    n = (~np.isnan(w)).sum(axis=1)
    with np.errstate(all="ignore"):
        mean = np.nansum(w, axis=1) / n
        sd = np.sqrt(np.nansum((w - mean[:, None]) ** 2, axis=1) / n)
    return np.where((place >= window) & (n >= least), sd * np.sqrt(window), np.nan)


def features(bars: np.ndarray, before: int, oi_before: float) -> dict[str, np.ndarray]:
    """Features of the rows (close, volume, taker buy volume, open interest) of one series that has `before` bars before them."""
    close, volume, taker, oi = bars.T
    out = {}
    for name, k in LAGS.items():
        out[name] = _ratio(close, np.concatenate([np.full(k, np.nan), close])[: len(close)])
    with np.errstate(all="ignore"):
        out["order_imb"] = np.where(volume > 0, 2 * taker / volume - 1, np.nan)
        out["rv24"] = realized_vols(out["ret1"], before + np.arange(len(close)))
        for name in STANDARDISED:
            out[f"z_{name}"] = rolling_zscores(out[name])
        last = pd.Series(np.concatenate([[oi_before], oi])).ffill().to_numpy()[:-1]
        out["oi_change"] = np.where((last != 0) & ~np.isnan(last), oi / last - 1, np.nan)
    return out


class BarFeatures(StatefulProcessor):
    def __init__(self, revisable: int) -> None:
        self.revisable = revisable

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("bars", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows), ignore_index=True)
        new = new.sort_values("order", kind="stable").drop_duplicates("close_time_ms", keep="last").sort_values("close_time_ms")
        if self.state.exists():
            before, oi, revision, times, bars = self.state.get()
            times, bars = np.array(times, np.int64), np.array(bars, np.float64).reshape(len(times), 4)
        else:
            before, oi, revision, times, bars = 0, np.nan, -1, np.empty(0, np.int64), np.empty((0, 4))
        oi = np.nan if oi is None else oi
        revision += 1
        t = new["close_time_ms"].to_numpy(np.int64)
        v = new[["close", "volume", "taker_buy_volume", "oi"]].to_numpy(np.float64)

        # a bar among those whose context is no longer whole can't be put right any more
        late = t <= times[CONTEXT - 1] if before and len(times) >= CONTEXT else np.zeros(len(t), bool)
        if late.any():
            yield self._rows(key, t[late], {}, True, revision)
            t, v = t[~late], v[~late]
        if len(t):
            at = np.searchsorted(times, t)
            known = np.array([a < len(times) and times[a] == x for a, x in zip(at, t, strict=True)], bool)
            bars = bars.copy()
            bars[at[known]] = v[known]
            all_times, all_bars = np.concatenate([times, t[~known]]), np.concatenate([bars, v[~known]])
            order = np.argsort(all_times, kind="stable")
            times, bars = all_times[order], all_bars[order]
            first = int(np.searchsorted(times, t[0]))
            start = max(0, first - CONTEXT)
            known_oi = bars[:start, 3][~np.isnan(bars[:start, 3])]
            found = features(bars[start:], before + start, known_oi[-1] if len(known_oi) else oi)
            yield self._rows(key, times[first:], {k: x[first - start :] for k, x in found.items()}, False, revision)
            gone = max(0, len(times) - CONTEXT - self.revisable)
            dropped = bars[:gone, 3][~np.isnan(bars[:gone, 3])]
            before, oi = before + gone, float(dropped[-1]) if len(dropped) else oi
            times, bars = times[gone:], bars[gone:]
        self.state.update((int(before), None if np.isnan(oi) else float(oi), int(revision), times.tolist(), [[None if np.isnan(x) else x for x in r] for r in bars.tolist()]))

    def _rows(self, key: Any, times: np.ndarray, found: dict[str, np.ndarray], late: bool, revision: int) -> pd.DataFrame:
        names = (*LAGS, "order_imb", "rv24", *(f"z_{n}" for n in STANDARDISED), "oi_change")
        values = {n: pd.Series(found[n]).astype("Float64") if n in found else pd.Series([None] * len(times), dtype="Float64") for n in names}
        return pd.DataFrame({"symbol": key[0], "close_time_ms": times, **values, "too_late": late, "revision": revision})

    def close(self) -> None:
        pass


def stream_features(bars: DataFrame, revisable: int = 168, order: str | None = None) -> DataFrame:
    """Rows of OUTPUT for a stream of bars (symbol, close_time_ms, close, volume, taker_buy_volume and, if there, oi). order: a column by which of a batch's rows of one
    time the last counts, by default a hash of their content, so that tasks' timing decides nothing. revisable: how many of a symbol's last bars may still be revised with certainty. Needs the RocksDB state
    store, which this sets for the session."""
    spark = bars.sparkSession
    ship_package(spark)
    ship_by_value(__name__)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    oi = F.col("oi").cast("double") if "oi" in bars.columns else F.lit(None).cast("double")
    place = F.col(order) if order else F.xxhash64(*INPUT[1:4], oi)
    rows = bars.select("symbol", "close_time_ms", *(F.col(c).cast("double").alias(c) for c in INPUT[1:4]), oi.alias("oi"), place.alias("order"))
    return rows.groupBy("symbol").transformWithStateInPandas(BarFeatures(revisable), outputStructType=OUTPUT, outputMode="Append", timeMode="None")


def latest(revisions: DataFrame) -> DataFrame:
    """The rows that count of a table of revisions."""
    return keep_last(revisions.where("not too_late"), ["symbol", "close_time_ms"], [F.col("revision")]).drop("too_late", "revision")
