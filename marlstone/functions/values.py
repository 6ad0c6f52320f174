"""Casts, time and scalar functions whose edge cases differ from Spark's defaults."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

#: Epoch values strictly above this are microseconds.
MICROSECOND_FLOOR = 100_000_000_000_000
#: Quote currencies, first match wins.
QUOTES = ("USDT", "USDC", "BUSD", "USD")


def finite(value: Column) -> Column:
    """Null for NaN and the infinities."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def lenient_double(text: Column) -> Column:
    """Null for null, empty, unparsable, NaN and infinite text. A trailing type letter (``1.0d``) is not a number; ``1_000`` isn't either."""
    return finite(F.when(~text.rlike(r"[dDfF_]\s*$"), text).try_cast("double"))


def epoch_ms(value: Column) -> Column:
    """Milliseconds from milliseconds or microseconds."""
    number = value.cast("double").cast("long")
    return F.when(number > MICROSECOND_FLOOR, F.floor(number / F.lit(1000))).otherwise(number).cast("long")


def iso_from_ms(ms: Column) -> Column:
    """UTC text with Z; six fraction digits only where the fraction isn't zero. Needs the session time zone UTC."""
    at = F.timestamp_millis(ms)
    return F.when(ms % 1000 == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))


def ms_from_iso(text: Column) -> Column:
    """Milliseconds of ISO text; text without a zone counts as UTC. More than six fraction digits are cut."""
    return F.unix_millis(F.to_timestamp(F.regexp_replace(text, r"(\.\d{6})\d+", "$1")))


def simple_return(now: Column, then: Column) -> Column:
    """now / then - 1; null where the base is null or not positive."""
    return F.when(then > 0, now / then - 1)


def order_imbalance(taker_buy: Column, volume: Column) -> Column:
    return F.when(volume > 0, 2 * taker_buy / volume - 1)


def taker_transform(ratio: Column) -> Column:
    """tanh(ln(ratio)); null unless the ratio is positive."""
    return F.when(ratio > 0, F.tanh(F.log(F.when(ratio > 0, ratio))))


def asset_from_symbol(symbol: Column) -> Column:
    return F.lower(F.regexp_replace(symbol, rf"^(.*?)({'|'.join(QUOTES)})$", "$1"))


def onchain_activity(*counts: Column) -> Column:
    """Mean of log1p over those that are present and not negative; null if there are none."""
    logs = [F.when(c >= 0, F.log1p(F.when(c >= 0, c))) for c in counts]
    n = sum((F.when(x.isNotNull(), 1).otherwise(0) for x in logs), F.lit(0))
    return F.when(n > 0, sum((F.coalesce(x, F.lit(0.0)) for x in logs), F.lit(0.0)) / n)


def growth(now: Column, before: Column) -> Column:
    """now / before - 1; null if either is null or the base is 0."""
    return F.when(before != 0, now / before - 1)


def default_asset(asset: Column) -> Column:
    return F.coalesce(F.nullif(asset, F.lit("")), F.lit("__portfolio__"))


def fixed_sum(value: Column, over: WindowSpec | None = None) -> Column:
    """The sum of the finite values as a double, the same bits in whatever order they come: values are added as decimals of 20 places, which is exact. Sums
    of 10 ** 18 or more raise."""
    total = F.sum(finite(value.cast("double")).cast("decimal(38,20)"))
    return (total.over(over) if over is not None else total).cast("double")
