import json

import bars as B
import pytest

from marlstone.sources import files, http


def line(i, close=None, unit=1):
    t = (B.START + i * B.HOUR) * unit
    return f"{t},1,2,0.5,{close or 100 + i},10,{t + (B.HOUR - 1) * unit},20,5,6,7,0"


HEAD = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore"


@pytest.fixture
def root(tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)

    put("a/spot-klines-BTCUSDT-1h-2026-01-01.csv", "\n".join([HEAD, line(0), line(1)]) + "\n")
    put("a-b/spot-klines-BTCUSDT-1h-2026-01-01.csv", "\n".join([line(1, 777), line(1, 778), line(2, unit=1000)]))
    put("a/spot-klines-ETHUSDT-1h-2026-01-01.csv", "")
    put("a/spot-klines-SOLUSDT-1h-2026-01-01.csv", HEAD)
    put("a/spot-klines-bad-1h-x.csv", "1,2")
    put("c/coinm-klines-BTCUSD_PERP-1h-2026-01-01.csv", line(0))
    put("c/coinm-metrics-BTCUSD_PERP-2026-01-01.csv", "create_time,sum_open_interest,sum_open_interest_value,count_toptrader_long_short_ratio,sum_toptrader_long_short_ratio,count_long_short_ratio,sum_taker_long_short_vol_ratio\n2026-01-01 00:05:00,1,,NaN,inf,x,2.5\n2026-01-01 00:05:00,2,3,1,1,1,1\n")
    put("c/coinmetrics-btc-onchain-2026.json", json.dumps({"data": [{"time": "2026-01-01T00:00:00.000000000Z", "AdrActCnt": "5", "TxCnt": None, "FeeTotNtv": "x", "asset": "eth"}]}))
    return tmp_path


def test_bars_keep_the_last_by_path_parts_and_row(spark, root):
    got = {r.close_time_ms: r for r in files.load_spot_bars(spark, str(root)).collect()}
    at = lambda i: B.START + (i + 1) * B.HOUR - 1
    assert sorted(got) == [at(0), at(1), at(2)] and got[at(1)].close == 778 and got[at(0)].taker_buy_volume == 6.0 and got[at(2)].open_time_ms == B.START + 2 * B.HOUR
    assert {r.symbol for r in files.symbols_of(spark, str(root), "spot-klines-*-1h-*.csv", files.SPOT_NAME).collect()} == {"BTCUSDT", "ETHUSDT", "SOLUSDT"}
    assert files.load_derivative_bars(spark, str(root)).first().symbol == "BTCUSD_PERP"


def test_short_rows_and_bad_numbers_raise(spark, tmp_path):
    p = tmp_path / "spot-klines-BTCUSDT-1h-2026-01-01.csv"
    for bad in ("1,2,3", line(0) + "\n\n" + line(1), line(0).replace(",2,0.5", ",two,0.5")):
        p.write_text(bad)
        with pytest.raises(Exception, match="a bar has 11 at least|CAST_INVALID_INPUT"):
            files.load_spot_bars(spark, str(tmp_path)).collect()


def test_metrics_and_observations(spark, root):
    m = files.load_derivative_metrics(spark, str(root)).collect()
    assert len(m) == 1 and m[0].timestamp_ms == B.START + 300_000 and m[0].sum_open_interest == 2.0 and m[0].taker_long_short_ratio == 1.0
    c = files.load_onchain(spark, str(root)).collect()
    assert len(c) == 1 and (c[0].asset, c[0].metric_time_ms, c[0].available_time_ms, c[0].AdrActCnt, c[0].TxCnt, c[0].FeeTotNtv) == ("btc", B.START, B.START + 86_400_000, 5.0, None, None)


def test_panel_round_trip(spark, tmp_path):
    from marlstone.plans.panel import point_in_time_panel

    p = point_in_time_panel(B.frame(spark, B.make("BTCUSDT"), B.make("ETHUSDT", slope=0.5)))
    files.write_panel_csv(p, str(tmp_path / "panel.csv"))
    back = files.read_panel_csv(spark, str(tmp_path / "panel.csv"), validate=True)
    key = lambda r: (r.decision_time_ms, r.asset)
    for a, b in zip(sorted(p.collect(), key=key), sorted(back.collect(), key=key), strict=True):
        assert a == b
    files.write_panel_csv(p.where("false"), str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="empty"):
        files.read_panel_csv(spark, str(tmp_path / "none.csv"))
    with pytest.raises(ValueError, match="duplicate"):
        files.validate_rows(p.unionByName(p).orderBy("timestamp"))


def test_an_empty_panel_is_an_empty_file_and_a_single_one_a_part(spark, tmp_path):
    from marlstone.plans.panel import point_in_time_panel

    p = point_in_time_panel(B.frame(spark, B.make("BTCUSDT"), B.make("ETHUSDT", slope=0.5)))
    files.write_panel_csv(p.where("false"), str(tmp_path / "none.csv"))
    parts = list((tmp_path / "none.csv").glob("part-*"))
    assert sum(x.stat().st_size for x in parts) == 0
    files.write_panel_csv(p, str(tmp_path / "one.csv"), single=True)
    assert len(list((tmp_path / "one.csv").glob("part-*"))) == 1
    assert files.read_panel_csv(spark, str(tmp_path / "one.csv"), validate=True).count() == p.count()


def test_order_is_that_of_files_whatever_their_sizes(spark, tmp_path):
    """Spark reads the largest piece first."""
    from marlstone.schema import PANEL

    head = ",".join(PANEL.names)
    row = lambda i: ",".join([f"2026-01-01T{i // 60:02d}:{i % 60:02d}:00Z", str(i), "A", *[""] * (len(PANEL.names) - 3)])
    for name, spans in (("good", ((0, 3), (3, 40), (40, 900))), ("bad", ((0, 3), (40, 900), (3, 40)))):
        (tmp_path / name).mkdir()
        for k, (a, z) in enumerate(spans):
            (tmp_path / name / f"part-{k}.csv").write_text("\n".join([head, *(row(i) for i in range(a, z))]) + "\n")
    assert files.read_panel_csv(spark, str(tmp_path / "good"), validate=True).count() == 900
    with pytest.raises(ValueError, match="ascend"):
        files.read_panel_csv(spark, str(tmp_path / "bad"), validate=True)


def test_digests(spark, tmp_path):
    import hashlib

    (tmp_path / "x.bin").write_bytes(b"abc")
    assert files.sha256_files(spark, str(tmp_path)).first().sha256 == hashlib.sha256(b"abc").hexdigest()


def test_http_requests_and_hosts():
    assert http.request_url("spot_klines", {"symbol": "BTCUSDT", "interval": "1h", "startTime": None}).endswith("/api/v3/klines?limit=1000&symbol=BTCUSDT&interval=1h")
    with pytest.raises(ValueError):
        http.request_url("book_ticker", {"pair": "a", "symbol": "b"})
    ok = lambda url: (200, b"[1]")
    assert http.get_json("https://api.binance.com/x", ok) == [1]
    for url, fetch in (("http://api.binance.com/x", ok), ("https://example.com/x", ok), ("https://api.binance.com/x", lambda u: (500, b"")), ("https://api.binance.com/x", lambda u: (200, b"{")), ("https://api.binance.com/x", lambda u: 1 / 0)):
        with pytest.raises(http.ProviderError):
            http.get_json(url, fetch)


def test_pages_are_followed_on_the_same_host():
    urls = []

    def fetch(url):
        urls.append(url)
        n = len(urls)
        return 200, json.dumps({"data": [n], "next_page_url": f"{http.CHAIN_BASE}/p{n}" if n < 3 else None}).encode()

    assert list(http.pages("asset_metrics", {"assets": "btc"}, fetch)) == [1, 2, 3]
    endless = lambda url: (200, json.dumps({"data": [0], "next_page_url": f"{http.CHAIN_BASE}/p"}).encode())
    with pytest.raises(http.ProviderError, match="pages"):
        list(http.pages("asset_metrics", {}, endless))
    away = lambda url: (200, json.dumps({"data": [], "next_page_url": "https://api.binance.com/p"}).encode())
    with pytest.raises(http.AddressRefused):
        list(http.pages("asset_metrics", {}, away))
    with pytest.raises(http.BadPayload):
        list(http.pages("asset_metrics", {}, lambda url: (200, b"[1]")))


def test_public_snapshot():
    urls = []

    def fetch(url):
        urls.append(url)
        return 200, json.dumps({"data": [{"t": 1}]} if "asset-metrics" in url else [1, 2]).encode()

    request = {"spot_symbol": "BTCUSDT", "coinm_symbol": "BTCUSD_PERP", "coinm_pair": "BTCUSD", "interval": "1h", "start_ms": 5, "end_ms": None, "onchain_asset": "btc", "onchain_start": None, "onchain_end": None, "onchain_metrics": ["AdrActCnt", "TxCnt"]}
    s = http.public_snapshot(request, fetch)
    assert s["request"] == request and list(s["data"]) == list(http.PUBLIC_CALLS) and len(urls) == 6 and s["data"]["onchain_asset_metrics"] == [{"t": 1}]
    assert not any(s["safety"].values()) and s["fetched_at"] and "startTime=5" in urls[0] and "endTime" not in urls[0] and "metrics=AdrActCnt%2CTxCnt" in urls[5]
    assert s["data_sha256"] == http._digest(s["data"])


def test_data_source(spark):
    def fetch(url):
        return 200, json.dumps([{"u": url.split("symbol=")[1]}]).encode()

    spark.dataSource.register(http.provider(fetch))
    rows = spark.read.format("market_http").option("endpoint", "spot_klines").option("requests", json.dumps([{"symbol": "A"}, {"symbol": "B"}])).load().collect()
    assert sorted(json.loads(r.item)["u"] for r in rows) == ["A", "B"]
    snap = http.snapshot({"one": ("spot_klines", {"symbol": "A"})}, fetch)
    assert len(snap["data_sha256"]) == 64 and snap["data"]["one"]["items"] == [{"u": "A"}]
