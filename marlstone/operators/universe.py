"""Which assets there are at each time, as bits.

Assets are numbered once; the universe of a time is an array of words of 63 bits, one bit for each number. So universes are compared, counted and subtracted
as numbers, and no names are gathered for any time but those whose universe is reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.operators.joins import checked_broadcast
from marlstone.operators.windows import dense_index

BITS = 63


def numbered(rows: DataFrame, asset: str = "asset") -> DataFrame:
    """(asset, id): the distinct assets, numbered from 0 in their order, as a table; a null one counts as an asset."""
    return dense_index(rows, asset, "id")


def universes(rows: DataFrame, ids: DataFrame, at: str = "timestamp", asset: str = "asset", sums: dict[str, Column] | None = None, most: dict[str, Column] | None = None, least: dict[str, Column] | None = None) -> DataFrame:
    """(at, n, bits, ...): a row per time with its number of rows, its universe, and sums, maxima and minima of the given columns."""
    sums, most, least = sums or {}, most or {}, least or {}
    words = -(-ids.count() // BITS)
    small = checked_broadcast(ids.select(F.col(asset).alias("_asset"), "id"))
    placed = rows.join(small, F.col(asset).eqNullSafe(F.col("_asset")))
    bits = F.bit_or(F.expr(f"shiftleft(1L, cast(id % {BITS} as int))"))
    first = [F.count(F.lit(1)).alias("n"), bits.alias("bits"), *(F.sum(c).alias(k) for k, c in sums.items()), *(F.max(c).alias(k) for k, c in most.items()), *(F.min(c).alias(k) for k, c in least.items())]
    names = [*sums, *most, *least]
    if words <= 1:
        return placed.groupBy(at).agg(*first).select(at, "n", F.array("bits").alias("bits"), *names)
    parts = placed.groupBy(at, F.floor(F.col("id") / BITS).alias("word")).agg(*first)
    found = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(words - 1).cast("long")), lambda w: F.coalesce(F.try_element_at("_w", w), F.lit(0).cast("long")))
    both = [F.sum("n").alias("n"), found.alias("_w"), *(F.sum(k).alias(k) for k in sums), *(F.max(k).alias(k) for k in most), *(F.min(k).alias(k) for k in least)]
    return parts.groupBy(at).agg(*both).select(at, "n", whole.alias("bits"), *names)


def size(bits: str = "bits") -> Column:
    """How many assets a universe has."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w))


def changes(found: DataFrame, ids: DataFrame, at: str = "timestamp", asset: str = "asset") -> DataFrame:
    """(at, missing, extra): the times whose universe isn't the first one's, with the names that it lacks and has besides, in order. found: from `universes`."""
    first = found.agg(F.min_by("bits", at).alias("first"))
    other = found.join(F.broadcast(first), F.col("bits") != F.col("first"))  # a row
    words = other.select(at, F.posexplode(F.arrays_zip("bits", "first")).alias("word", "w")).select(at, "word", F.col("w.first").bitwiseAND(F.bitwise_not("w.bits")).alias("missing"), F.col("w.bits").bitwiseAND(F.bitwise_not("w.first")).alias("extra"))
    bit = F.explode(F.sequence(F.lit(0), F.lit(BITS - 1))).alias("bit")
    has = lambda c: F.expr(f"shiftright({c}, bit) & 1") == 1
    each = words.where("missing <> 0 or extra <> 0").select(at, "word", "missing", "extra", bit).where(has("missing") | has("extra"))
    each = each.select(at, (F.col("word") * BITS + F.col("bit")).alias("id"), has("missing").alias("gone")).join(checked_broadcast(ids), "id")
    names = lambda which: F.array_sort(F.collect_list(F.when(which, F.col(asset))))
    return each.groupBy(at).agg(names(F.col("gone")).alias("missing"), names(~F.col("gone")).alias("extra"))
