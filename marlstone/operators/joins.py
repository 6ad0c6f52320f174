"""As-of, benchmark, basis and cross-sectional joins, keep-last deduplication and timestamp intersection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.values import fixed_sum, simple_return

#: A dimension of at most so many rows is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 100_000


def checked_broadcast(small: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """`small` with a broadcast hint if it has at most `rows` rows. Looks at no more than that many and one."""
    return F.broadcast(small) if small.limit(rows + 1).count() <= rows else small


def keep_last(rows: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The last row of each key in the given order (ascending columns)."""
    last = Window.partitionBy(*keys).orderBy(*(c.desc() for c in order))
    return rows.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


def _spread(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, most: int) -> DataFrame:
    """(by, _edges): where each key's times are cut so that its rows of both sides, however they lie in time, fall in parts of about `most`: quantiles
    of its own times, none for a key of fewer rows."""
    steps = [k / _STEPS for k in range(1, _STEPS)]
    times = right.select(*by, F.col(right_ts).alias("_ts")).unionByName(left.select(*by, F.col(left_ts).alias("_ts"))).where("_ts is not null")
    found = times.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"), F.approx_percentile("_ts", F.array(*(F.lit(s) for s in steps)), F.lit(20_000)).alias("_all"))
    each = F.greatest(F.lit(1), F.floor(F.lit(_STEPS) / F.ceil(F.col("_rows") / most))).cast("int")
    return found.select(*by, F.when(F.col("_rows") > most, F.array_distinct(F.filter("_all", lambda _, i: (i + 1) % each == 0))).otherwise(F.array().cast("array<long>")).alias("_edges"))


#: Quantiles that a key's times can be cut at.
_STEPS = 256


def asof_backward(left: DataFrame, right: DataFrame, by: Sequence[str], left_ts: str, right_ts: str, name: str = "matched", tie: Sequence[str] = (), split: int | None = None) -> DataFrame:
    """Each left row with a struct `name` of the last right row at or before it, however old; null if there is none.

    Both sides are united and sorted once per key, right rows first on equal times; ties on the right go to the last by `tie`.
    With `split`, the times of a key of more rows are cut at their quantiles into parts of about that many, and each part starts from the last right row before it;
    so a key with very many rows is no single task, even if they all lie in one day. Only one row per key and part is sorted by key alone.
    """
    value = F.struct(*(F.col(c) for c in right.columns))
    kind = right.select(value.alias("r")).schema["r"].dataType
    keys = [F.col(k) for k in by]
    after = F.struct(*(F.col(c) for c in ("_ts", *(f"_r.{c}" for c in tie))))
    r = right.where(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("_ts"), F.lit(0).alias("_side"), F.struct(*(F.col(c) for c in tie)).alias("_tie") if tie else F.lit(None).alias("_tie"), value.alias("_r"), F.lit(None).alias("_l"))
    row = left.select(F.struct(*(F.col(c) for c in left.columns)).alias("l")).schema["l"].dataType
    tie_kind = r.schema["_tie"].dataType
    lone = left.select(*keys, F.col(left_ts).alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(tie_kind).alias("_tie"), F.lit(None).cast(kind).alias("_r"), F.struct(*(F.col(c) for c in left.columns)).alias("_l"))
    both = r.withColumn("_l", F.col("_l").cast(row)).unionByName(lone)
    part = list(by)
    if split:
        edges = _spread(left, right, by, left_ts, right_ts, split).alias("e")
        same = [F.col(f"b.{k}").eqNullSafe(F.col(f"e.{k}")) for k in by]
        at = F.size(F.filter(F.coalesce("e._edges", F.array().cast("array<long>")), lambda e: e <= F.col("b._ts")))
        both, part = both.alias("b").join(edges, same, "left").select("b.*", at.alias("_bucket")), [*by, "_bucket"]
        marks = both.groupBy(*by, "_bucket").agg(F.max_by("_r", F.when(F.col("_side") == 0, after)).alias("_end"))
        carried = marks.withColumn("_r", F.last("_end", ignorenulls=True).over(Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1))).where("_r is not null")
        both = both.unionByName(carried.select(*by, F.lit(None).cast("long").alias("_ts"), F.lit(0).alias("_side"), F.lit(None).cast(tie_kind).alias("_tie"), "_r", F.lit(None).cast(row).alias("_l"), "_bucket"))
    so_far = Window.partitionBy(*part).orderBy("_ts", "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.last("_r", ignorenulls=True).over(so_far)).where("_side = 1").select(*(F.col(c) if c in by else F.col(f"_l.{c}") for c in left.columns), name)  # keys as they were dealt by


def decision_times(bars: DataFrame, symbols: int | None = None) -> DataFrame:
    """Timestamps that every symbol has. `symbols`: how many there are, if some have files but no rows."""
    counted = bars.groupBy("close_time_ms").agg(F.countDistinct("symbol").alias("n"))
    if symbols is not None:
        return counted.where(F.col("n") == symbols).select("close_time_ms")
    total = bars.agg(F.countDistinct("symbol").alias("total"))
    return counted.join(F.broadcast(total), F.col("n") == F.col("total")).select("close_time_ms")


def derivative_close(derivative: DataFrame, mapping: DataFrame) -> DataFrame:
    """(symbol, close_time_ms, d_close): closes of derivative bars under their spot symbols."""
    return derivative.select(F.col("symbol").alias("derivative"), "close_time_ms", F.col("close").alias("d_close")).join(mapping, "derivative").drop("derivative")


def basis_value() -> Column:
    return F.when(F.col("close") > 0, F.col("d_close") / F.col("close") - 1)


def basis(spot: DataFrame, derivative: DataFrame, mapping: DataFrame) -> DataFrame:
    """(symbol, close_time_ms, basis) at each time that a spot symbol and its derivative (mapping: symbol, derivative; with a broadcast hint if it's small)
    share."""
    found = spot.select("symbol", "close_time_ms", "close").join(derivative_close(derivative, mapping), ["symbol", "close_time_ms"]).where("close > 0")
    return found.select("symbol", "close_time_ms", basis_value().alias("basis"))


def benchmark(features: DataFrame, symbol: str) -> DataFrame:
    """One row per timestamp of the benchmark's series that has a next bar and a valid return."""
    b = features.where(F.col("symbol") == symbol)
    return b.select("close_time_ms", simple_return(F.col("next_close"), F.col("close")).alias("benchmark_return"), F.col("z_ret24").alias("regime_trend"), F.col("z_rv24").alias("regime_volatility")).where("benchmark_return is not null")


def leave_one_out(value: str, at: str) -> Column:
    """Mean of the others' values at the same time, less the own; null if there are no others or the own is null. The order of rows decides no bit."""
    w = Window.partitionBy(at)
    n, total, own = F.count(value).over(w), fixed_sum(F.col(value), w), F.col(value)
    return F.when(own.isNotNull() & (n > 1), (total - own) / F.nullif(n - 1, F.lit(0)) - own)
