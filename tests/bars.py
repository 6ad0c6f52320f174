"""Hourly bars as lists of rows."""

START = 1_767_225_600_000  # 2026-01-01T00:00Z
HOUR = 3_600_000
SCHEMA = "symbol string, open_time_ms long, close_time_ms long, open double, high double, low double, close double, volume double, quote_volume double, count long, taker_buy_volume double, taker_buy_quote_volume double, source_path string"


def make(symbol, n=40, slope=1.0, skip=()):
    out = []
    for i in range(n):
        if i in skip:
            continue
        c = 100 + slope * i + (i % 5) * 0.3
        out.append([symbol, START + i * HOUR, START + (i + 1) * HOUR - 1, c - 0.2, c + 0.5, c - 0.3, c, 1000.0 + i, c * (1000 + i), 100, 520 + i / 10 + i % 3, 0.0, "synthetic"])
    return out


def frame(spark, *series):
    return spark.createDataFrame([tuple(r) for s in series for r in s], SCHEMA)
