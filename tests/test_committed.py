import hashlib
import json

import bars as B
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from marlstone.plans.panel import point_in_time_panel
from marlstone.sources import committed as C


@pytest.fixture(scope="module")
def panel(spark):
    return spark.createDataFrame(point_in_time_panel(B.frame(spark, B.make("BTCUSDT", 60), B.make("ETHUSDT", 60, slope=0.5))).collect(), C.PANEL).repartition(5)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[1], r[2]))


def test_parts_follow_each_other_and_the_root_is_reproducible(spark, tmp_path, panel):
    one, two = (C.write_committed(panel, str(tmp_path / n), 4) for n in ("one", "two"))
    assert one["root"] == two["root"] and one["rows"] == 118 == sum(p["rows"] for p in one["parts"]) and len(one["parts"]) > 1
    assert rows_of(C.verified(spark, str(tmp_path / "one"))) == rows_of(panel)
    assert rows_of(C.verified(spark, f"file://{tmp_path}/two")) == rows_of(panel)
    text = [(tmp_path / "one" / p["name"]).read_text().splitlines() for p in one["parts"]]
    keys = [tuple(x.split(",")[1:3]) for t in text for x in t[1:]]
    assert keys == sorted(keys, key=lambda k: (int(k[0]), k[1])) and all(t[0].startswith("timestamp,decision_time_ms,asset,") for t in text)
    assert {p["sha256"] for p in one["parts"]} == {hashlib.sha256((tmp_path / "one" / p["name"]).read_bytes()).hexdigest() for p in one["parts"]}
    assert sorted(x.name for x in (tmp_path / "one").iterdir() if not x.name.startswith(".")) == ["manifest.json", *(p["name"] for p in one["parts"])]


def test_a_failed_task_leaves_no_manifest(spark, tmp_path, panel):
    bad = panel.withColumn("asset", F.when(F.col("decision_time_ms") > B.START + 40 * B.HOUR, F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("asset")))
    spark.dataSource.register(C.CommittedPanel)
    with pytest.raises(Exception, match="lost"):
        bad.write.format("committed_panel").mode("append").option("path", str(tmp_path / "x")).save()
    assert not (tmp_path / "x" / "manifest.json").exists() and not list((tmp_path / "x").glob("*")) if (tmp_path / "x").exists() else True


def test_changed_parts_are_refused(spark, tmp_path, panel):
    root = tmp_path / "p"
    m = C.write_committed(panel, str(root))
    with pytest.raises(FileExistsError):
        C.write_committed(panel, str(root))
    part = root / m["parts"][0]["name"]
    whole = part.read_text()
    part.write_text(whole.replace("BTCUSDT", "XTCUSDT", 1))
    with pytest.raises(ValueError, match="isn't what"):
        C.verified(spark, str(root))
    part.write_text(whole)
    (root / "manifest.json").write_text(json.dumps(m | {"root": "0" * 64}))
    with pytest.raises(ValueError, match="root"):
        C.verified(spark, str(root))


def test_an_empty_panel(spark, tmp_path, panel):
    m = C.write_committed(panel.where("false"), str(tmp_path / "none"))
    assert m["rows"] == 0 and C.verified(spark, str(tmp_path / "none")).count() == 0


def test_merkle_root():
    h = lambda *x: hashlib.sha256(b"".join(x)).digest()
    a, b, c = h(b"a"), h(b"b"), h(b"c")
    assert C.merkle_root([a.hex()]) == a.hex() and C.merkle_root([x.hex() for x in (a, b, c)]) == h(h(a, b), c).hex()
    assert C.merkle_root([b.hex(), a.hex()]) != C.merkle_root([a.hex(), b.hex()]) and C.merkle_root([]) == h(b"").hex()


def test_digests_of_files_in_chunks(spark, tmp_path, monkeypatch):
    (tmp_path / "a").write_bytes(b"x" * 100_000)
    (tmp_path / "b").write_bytes(b"")
    monkeypatch.setattr(C, "CHUNK", 7)
    assert C.file_digest(fs.LocalFileSystem(), str(tmp_path / "a")) == (hashlib.sha256(b"x" * 100_000).hexdigest(), 100_000)
    got = {r.name: (r.sha256, r.bytes) for r in C.digests(spark, str(tmp_path), ["a", "b"]).collect()}
    assert got == {"a": (hashlib.sha256(b"x" * 100_000).hexdigest(), 100_000), "b": (hashlib.sha256(b"").hexdigest(), 0)}
