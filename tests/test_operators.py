from collections import Counter

from pyspark.sql import functions as F

from marlstone.functions import values as V
from marlstone.operators import cardinality as C
from marlstone.operators import joins as J


def col(spark, kind, values, f):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").orderBy("i").select(f(F.col("v"))).collect()]


def test_numbers_and_times(spark):
    assert col(spark, "string", [None, "", "x", "nan", "inf", "-Infinity", "1e3", "1.0d", " 2.5 "], V.lenient_double) == [None] * 6 + [1000.0, None, 2.5]
    assert col(spark, "long", [100_000_000_000_000, 100_000_000_000_001, 1_767_225_600_000_999], V.epoch_ms) == [100_000_000_000_000, 100_000_000_000, 1_767_225_600_000]
    assert col(spark, "long", [1_767_225_600_000, 1_767_225_600_999], V.iso_from_ms) == ["2026-01-01T00:00:00Z", "2026-01-01T00:00:00.999000Z"]
    assert col(spark, "string", ["2026-01-01T00:00:00Z", "2026-01-01T00:00:00.999000Z", "2026-01-01T02:00:00+02:00"], V.ms_from_iso) == [1_767_225_600_000, 1_767_225_600_999, 1_767_225_600_000]


def test_guards(spark):
    assert col(spark, "double", [0.0, -1.0, None], lambda c: V.simple_return(F.lit(2.0), c)) == [None] * 3
    assert col(spark, "double", [0.0, None], lambda c: V.growth(F.lit(2.0), c)) == [None] * 2
    assert col(spark, "double", [0.0, -2.0, None, 1.0], V.taker_transform) == [None, None, None, 0.0]
    assert col(spark, "string", ["BTCUSDT", "ETHBUSD", "XUSDC", "BTCUSD", "USD", "btc"], V.asset_from_symbol)[:4] == ["btc", "eth", "x", "btc"]


def test_cardinality(spark):
    a, b = [1, 1, 2, 3, 3, 3], [1, 3, 3, 4]
    ca, cb = Counter(a), Counter(b)
    fa, fb = (spark.createDataFrame([(x,) for x in v], "k long") for v in (a, b))
    r = C.inner_cardinality(fa, fb, ["k"]).first().asDict()
    assert sum(ca[k] * cb[k] for k in ca) in r.values() and fa.join(fb, "k").count() in r.values()
    m = C.key_multiplicity(fa, ["k"]).first().asDict()
    assert {6, 3} <= set(m.values())
    top = C.top_products(fa, fb, ["k"]).first().asDict()
    assert top["k"] == 3 and 6 in top.values()


def test_keep_last_and_leave_one_out(spark):
    d = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, None)], "k string, o int, v double")
    assert {(r.k, r.v) for r in J.keep_last(d, ["k"], [F.col("o")]).collect()} == {("a", 2.0), ("b", None)}
    x = spark.createDataFrame([(1, 1.0), (1, 4.0), (1, None), (2, 5.0)], "t int, v double")
    got = sorted((r.t, r.v is None, r.v or 0, r.l) for r in x.withColumn("l", J.leave_one_out("v", "t")).collect())
    assert got == [(1, False, 1.0, 3.0), (1, False, 4.0, -3.0), (1, True, 0, None), (2, False, 5.0, None)]


def test_small_sides_only_are_broadcast(spark):
    small = spark.range(10)
    assert "broadcast" in J.checked_broadcast(small)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in J.checked_broadcast(small, 5)._jdf.queryExecution().logical().toString().lower()
