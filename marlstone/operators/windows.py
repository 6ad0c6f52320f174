"""Positional windows: lags and rolling statistics count rows, never time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from marlstone.functions.values import order_imbalance, simple_return
from marlstone.operators.series import BLOCK, in_blocks, placed

#: Rows before a bar that its features depend on: 167 of a z-score, each of a return over 24 bars.
CONTEXT = 191


def by_symbol() -> WindowSpec:
    """Each symbol's rows in order of time. A function, as windows need a running session."""
    return Window.partitionBy("symbol").orderBy("close_time_ms")


def rolling_zscore(value: Column, over: WindowSpec, window: int = 168, min_periods: int = 12) -> Column:
    """z of the current row against the last `window` rows, itself included; nulls don't count. A constant window gives 0."""
    frame = over.rowsBetween(1 - window, 0)
    n, mean, sd = F.count(value).over(frame), F.avg(value).over(frame), F.stddev_samp(value).over(frame)
    return F.when(value.isNotNull() & (n >= min_periods), F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((value - mean) / sd))


def realized_vol(ret: Column, over: WindowSpec, window: int = 24, min_periods: int = 12, place: Column | None = None) -> Column:
    """Population deviation of the last `window` returns times sqrt(window), from row `window` + 1 on. place: rows before the current one in its series,
    where the window holds but a part of it."""
    frame = over.rowsBetween(1 - window, 0)
    place = F.row_number().over(over) - 1 if place is None else place
    return F.when((place >= window) & (F.count(ret).over(frame) >= min_periods), F.stddev_pop(ret).over(frame) * F.sqrt(F.lit(float(window))))


def lagged_returns(bars: DataFrame, lags: dict[str, int], over: WindowSpec | None = None) -> DataFrame:
    over = over or by_symbol()
    return bars.withColumns({name: simple_return(F.col("close"), F.lag("close", k).over(over)) for name, k in lags.items()})


def long_series(rows: DataFrame, by: str, block: int = BLOCK) -> int | None:
    """The size of blocks for windows over rows, if a series is so long that one task had better not take it, or else None. One aggregate; the driver gets
    a number."""
    longest = rows.groupBy(by).count().agg(F.max("count")).first()[0]
    return block if (longest or 0) > 4 * block else None


def bar_features(bars: DataFrame, block: int | None = None) -> DataFrame:
    """Features of each symbol's full series; one exchange and one sort by (symbol, close_time_ms) carry all of them. block: series are cut into blocks of so many
    rows, each with the rows before and after it that its features look at, so that no task takes a whole one."""
    rows, over, place = bars, by_symbol(), None
    if block:
        rows = in_blocks(placed(bars, ["symbol"], ["close_time_ms"]), CONTEXT, 1, block)
        over, place = Window.partitionBy("symbol", "block").orderBy("pos"), F.col("pos")
    out = lagged_returns(rows, {"ret1": 1, "ret4": 4, "ret24": 24}, over)
    out = out.withColumns({
        "order_imb": order_imbalance(F.col("taker_buy_volume"), F.col("volume")),
        "rv24": realized_vol(F.col("ret1"), over, place=place),
        "next_close": F.lead("close").over(over),
        "next_close_time_ms": F.lead("close_time_ms").over(over),
    })
    out = out.withColumns({f"z_{name}": rolling_zscore(F.col(name), over) for name in ("ret1", "ret4", "ret24", "order_imb", "rv24")})
    return out.where("own").drop("pos", "block", "own") if block else out


def rolling_zscores(rows: DataFrame, names: Sequence[str], by: str, order: str, block: int | None = None, window: int = 168) -> DataFrame:
    """rows with the z of each named column in its place, over the series of `by`; block: as for bar_features."""
    if not block:
        over = Window.partitionBy(by).orderBy(order)
        return rows.withColumns({c: rolling_zscore(F.col(c), over, window) for c in names})
    over = Window.partitionBy(by, "block").orderBy("pos")
    out = in_blocks(placed(rows, [by], [order]), window - 1, 0, block)
    return out.withColumns({c: rolling_zscore(F.col(c), over, window) for c in names}).where("own").drop("pos", "block", "own")


def last_before(value: Column, over: WindowSpec) -> Column:
    """The last value that isn't null before the current row."""
    return F.last(value, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, -1))


def dense_index(rows: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Distinct keys with their position in order. Keys are dealt by range and parts' counts added up: no task orders them all."""
    return placed(rows.select(key).distinct(), [], [key], name)
