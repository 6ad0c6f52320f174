import datetime

import bars as B
import pytest
from pyspark.sql import functions as F

from marlstone.sources import archive, files, vendor

DAY = 86_400_000


@pytest.fixture
def root(spark, tmp_path):
    """Ten days of two symbols, a file each; all but three days of BTCUSDT are unreadable as bars."""
    rows = [r for s in ("BTCUSDT", "ETHUSDT") for r in B.make(s, 240)]
    out = vendor.write_klines(B.frame(spark, rows), str(tmp_path / "spot"), "spot-klines-{symbol}-1h-{day}.csv")
    for f in (tmp_path / "spot").rglob("*.csv"):
        if "BTCUSDT" not in f.name or f.name[-14:-4] not in ("2026-01-03", "2026-01-04", "2026-01-05"):
            f.write_text("not,a,bar")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    (tmp_path / "spot" / "spot-klines-BTCUSDT-1h-2026-13-40.csv").write_text("no such day")
    return out


def days(a, z):
    return F.col("day").between(F.lit(a).cast("date"), F.lit(z).cast("date"))


def test_only_matching_files_are_opened(spark, root):
    with pytest.raises(Exception, match="a bar has 11 at least"):
        files.load_spot_bars(spark, root).collect()
    got = files.load_spot_bars(spark, root, (F.col("symbol") == "BTCUSDT") & days("2026-01-03", "2026-01-05")).collect()
    assert len(got) == 72 and {r.symbol for r in got} == {"BTCUSDT"} and {r.open_time_ms // DAY for r in got} == {B.START // DAY + k for k in (2, 3, 4)}


@pytest.mark.parametrize(
    "where, n",
    [
        (None, 20), ("true", 20), ("symbol = 'BTCUSDT'", 10), ("symbol in ('BTCUSDT', 'X')", 10), ("symbol = 'BTCUSDT' and day > date'2026-01-08'", 2),
        ("day >= date'2026-01-09'", 4), ("day < date'2026-01-02'", 2), ("day <= date'2026-01-02' and symbol in ('ETHUSDT')", 2), ("symbol = 'X'", 0), ("symbol = 'BTCUSDT' and symbol = 'ETHUSDT'", 0),
        ("day = date'2026-01-05'", 2), ("day in (date'2026-01-05', date'2026-01-06')", 4), ("symbol like 'BTC%'", 20), ("pos = 0", 20), ("symbol is not null", 20),
    ],
)
def test_number_of_files_read(spark, root, where, n):
    """A partition a file: as many are planned as names match the conditions that the source takes."""
    d = archive.archive_lines(spark, root, "spot", filesPerPartition=1)
    d = d if where is None else d.where(where)
    assert d.rdd.getNumPartitions() in (n, max(n, 1))  # a reader without files is one empty partition, unless Spark sees itself that no row is left
    if isinstance(where, str):
        whole = archive.archive_lines(spark, root, "spot").collect()
        want = spark.createDataFrame(whole, archive.SCHEMA).where(where).count()
        assert d.count() == want


def test_conditions_that_the_source_leaves_to_spark(spark, root):
    reader = archive.ArchiveReader({"path": root, "kind": "spot"})
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, IsNull, StringStartsWith

    left = [EqualTo(("pos",), 0), StringStartsWith(("symbol",), "B"), IsNull(("symbol",))]
    taken = [EqualTo(("symbol",), "BTCUSDT"), In(("day",), (datetime.date(2026, 1, 3), None)), GreaterThan(("day",), datetime.date(2026, 1, 1)), IsNotNull(("day",))]
    assert list(reader.pushFilters(left + taken)) == left
    assert [x[:2] for x in reader.matching()] == [("BTCUSDT", datetime.date(2026, 1, 3))]


def test_both_readers_agree(spark, tmp_path):
    """Blank files, headers, blank ends, ties over folders: as Spark's own reader has them."""
    head = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume"
    line = lambda i, c: f"{B.START + i * B.HOUR},1,2,0.5,{c},10,{B.START + (i + 1) * B.HOUR - 1},20,5,6,7"
    for name, text in {
        "a/spot-klines-BTCUSDT-1h-2026-01-01.csv": f"\n {head}\r\n{line(0, 1)}\r\n{line(1, 2)}\n\n", "a-b/spot-klines-BTCUSDT-1h-2026-01-01.csv": f"{line(1, 3)}\n{line(1, 4)}",
        "a/spot-klines-ETHUSDT-1h-2026-01-01.csv": " \n", "a/spot-klines-SOLUSDT-1h-2026-01-02.csv": head, "b/x-spot-klines-ADAUSDT-1h-2026-01-02.csv": line(5, 9),
    }.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(text.encode())
    own, pruned = files.load_spot_bars(spark, str(tmp_path)), files.load_spot_bars(spark, str(tmp_path), F.lit(True))
    assert sorted(own.drop("source_path").collect()) == sorted(pruned.drop("source_path").collect()) and own.count() == 2
    for root in (f"file://{tmp_path}", f"file:{tmp_path}"):
        assert {r.source_path for r in files.load_spot_bars(spark, root, F.lit(True)).collect()} == {r.source_path for r in own.collect()}


def test_a_null_cell_is_an_empty_one(spark, tmp_path):
    rows = B.make("BTCUSDT", 1)
    names = B.frame(spark, rows).columns
    for k, c in enumerate(names):
        if c in ("symbol", "open_time_ms", "source_path"):
            continue
        d = B.frame(spark, [[*rows[0][:k], None, *rows[0][k + 1 :]]])
        root = vendor.write_klines(d, str(tmp_path / c), "spot-klines-{symbol}-1h-{day}.csv")
        assert spark.read.text(root).first()[0].count(",") == 10


def test_an_archive_without_files(spark, tmp_path):
    assert files.load_spot_bars(spark, str(tmp_path), F.col("symbol") == "X").collect() == []
