import json

import pytest

from marlstone.sources import http

FIRST = http.request_url("asset_metrics", {"assets": "btc"})
PAGE = f"{http.CHAIN_BASE}/timeseries/asset-metrics?next_page_token="


def put(path, pages):
    path.write_text(json.dumps(pages))


def provider_of(path):
    """A fetcher of the pages in a file, which may grow while a stream reads them. A closure, so that it goes to workers by value."""
    path, first, page = str(path), FIRST, PAGE

    def fetch(url):
        with open(path) as f:
            pages = json.load(f)
        k = 0 if url == first else int(url.removeprefix(page))
        return 200, json.dumps({"data": pages[k], **({"next_page_url": f"{page}{k + 1}"} if k + 1 < len(pages) else {})}).encode()

    return fetch


def reader(fetch, most=2):
    return http.PagedItems({"request": json.dumps({"assets": "btc"}), "pagesPerBatch": str(most)}, fetch)


def items(rows):
    return [json.loads(x) for _, x in rows]


def test_offsets_can_be_replayed(tmp_path):
    pages = tmp_path / "p.json"
    put(pages, [[1, 2], [3], [], [4, 5, 6]])
    p = provider_of(pages)
    r = reader(p)
    at, seen, steps = r.initialOffset(), [], []
    for _ in range(4):
        rows, end = r.read(at)
        got = items(rows)
        assert items(reader(p).readBetweenOffsets(json.loads(json.dumps(at)), end)) == got
        steps.append(got)
        seen += got
        at = end
    assert seen == [1, 2, 3, 4, 5, 6] and steps == [[1, 2, 3], [4, 5, 6], [], []]
    put(pages, [[1, 2], [3], [], [4, 5, 6, 7], [8]])  # the last page has grown, and another follows
    rows, end = r.read(at)
    assert items(rows) == [7, 8] == items(r.readBetweenOffsets(at, end))
    put(pages, [[1, 2]])
    with pytest.raises(http.BadPayload):
        items(r.readBetweenOffsets(r.initialOffset(), end))


def test_restart_in_the_middle_of_the_paging(spark, tmp_path):
    pages = tmp_path / "p.json"
    put(pages, [[10 * k + j for j in range(3)] for k in range(7)])
    p = provider_of(pages)
    spark.dataSource.register(http.provider(p))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def go():
        stream = spark.readStream.format("market_http").option("request", json.dumps({"assets": "btc"})).option("pagesPerBatch", "2").load()
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()
        return sorted(int(r.item) for r in spark.read.schema("request string, item string").parquet(out).collect())

    first = go()
    assert 0 < len(first) < 21
    for _ in range(6):
        got = go()
    assert got == [10 * k + j for k in range(7) for j in range(3)]
    put(pages, [[10 * k + j for j in range(3)] for k in range(8)])
    for _ in range(2):
        got = go()
    assert got == [10 * k + j for k in range(8) for j in range(3)]
