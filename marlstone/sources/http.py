"""Market and chain data over HTTPS as a Python data source. The fetcher is injected; tests never touch a network."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from datetime import UTC, datetime
from typing import Any
from urllib.parse import urlencode, urlsplit, urlunsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

from marlstone.shipping import ship_by_value

#: Hosts that may be read, base addresses and endpoint paths.
SPOT_BASE = "https://api.binance.com"
COINM_BASE = "https://dapi.binance.com"
CHAIN_BASE = "https://community-api.coinmetrics.io/v4"
ALLOWED_HOSTS = {"api.binance.com", "dapi.binance.com", "community-api.coinmetrics.io"}
ENDPOINTS = {
    "spot_klines": (SPOT_BASE, "/api/v3/klines", {"limit": 1000}),
    "funding_rate": (COINM_BASE, "/dapi/v1/fundingRate", {"limit": 1000}),
    "open_interest": (COINM_BASE, "/futures/data/openInterestHist", {"contractType": "PERPETUAL", "limit": 500}),
    "taker_volume": (COINM_BASE, "/futures/data/takerBuySellVol", {"contractType": "PERPETUAL", "limit": 500}),
    "basis": (COINM_BASE, "/futures/data/basis", {"contractType": "PERPETUAL", "limit": 500}),
    "book_ticker": (COINM_BASE, "/dapi/v1/ticker/bookTicker", {}),
    "asset_metrics": (CHAIN_BASE, "/timeseries/asset-metrics", {"frequency": "1d", "page_size": 10000, "paging_from": "start"}),
}
MAX_PAGES = 50
TIMEOUT_S = 15.0

Fetcher = Callable[[str], tuple[int, bytes]]


class ProviderError(RuntimeError):
    """A request that can't be made or that brings nothing usable."""


class AddressRefused(ProviderError):
    """Not HTTPS, or a host that isn't in the list."""


class NoAnswer(ProviderError):
    """The fetcher failed, or answered with another status than 200."""


class BadPayload(ProviderError):
    """The answer isn't JSON, or not of the endpoint's form."""


def urlopen_fetcher(url: str) -> tuple[int, bytes]:
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers={"Accept": "application/json"}), timeout=TIMEOUT_S) as r:
        return r.status, r.read()


def permitted(url: str, hosts: set[str] = ALLOWED_HOSTS) -> str:
    """The address, if it may be read."""
    parts = urlsplit(url)
    if (parts.scheme, parts.hostname in hosts) != ("https", True):
        raise AddressRefused(f"{parts.scheme}://{parts.hostname} may not be read; permitted: https to {', '.join(sorted(hosts))}")
    return url


def fetched(url: str, fetch: Fetcher) -> bytes:
    try:
        status, body = fetch(url)
    except Exception as e:
        raise NoAnswer(f"no answer from {url}") from e
    if status != 200:
        raise NoAnswer(f"{url} answered with status {status}")
    return body


def get_json(url: str, fetch: Fetcher, hosts: set[str] = ALLOWED_HOSTS) -> Any:
    """The JSON at an https address of a permitted host."""
    body = fetched(permitted(url, hosts), fetch)
    try:
        return json.loads(body)
    except ValueError as e:
        raise BadPayload(f"{url} didn't answer with JSON") from e


def request_url(endpoint: str, params: dict[str, Any]) -> str:
    """The address of a request: the endpoint's own parameters, then those given; null ones are left out."""
    base, path, defaults = ENDPOINTS[endpoint]
    if endpoint == "book_ticker" and {"pair", "symbol"} <= {k for k, v in params.items() if v is not None}:
        raise ValueError("book_ticker takes one of pair and symbol")
    host = urlsplit(base)
    given = [(k, v) for k, v in {**defaults, **params}.items() if v is not None]
    return urlunsplit((host.scheme, host.netloc, host.path + path, urlencode(given), ""))


def pages(endpoint: str, params: dict[str, Any], fetch: Fetcher) -> Iterator[Any]:
    """Items of a response. asset_metrics is followed from page to page, each on the same host, up to MAX_PAGES."""
    url: str | None = request_url(endpoint, params)
    if endpoint != "asset_metrics":
        answer = get_json(url, fetch)
        yield from answer if isinstance(answer, list) else [answer]
        return
    for _ in range(MAX_PAGES):
        items, url = page_of(url, fetch)
        yield from items
        if not url:
            return
    raise BadPayload(f"more than {MAX_PAGES} pages")


def page_of(url: str, fetch: Fetcher) -> tuple[list[Any], str | None]:
    """(items, address of the next page or None) of a page of asset_metrics."""
    page = get_json(url, fetch, {urlsplit(CHAIN_BASE).hostname})
    if not isinstance(page, dict):
        raise BadPayload(f"{url} didn't answer with a page of items")
    return page.get("data", []), page.get("next_page_url")


class _Request(InputPartition):
    def __init__(self, params: dict[str, Any]) -> None:
        super().__init__(params)
        self.params = params


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], fetch: Fetcher) -> None:
        self.endpoint, self.requests, self.fetch = options["endpoint"], json.loads(options.get("requests", "[{}]")), fetch

    def partitions(self) -> list[InputPartition]:
        return [_Request(p) for p in self.requests]

    def read(self, partition: _Request) -> Iterator[tuple[str, str]]:
        echo = json.dumps(partition.params, sort_keys=True)
        for item in pages(self.endpoint, partition.params, self.fetch):
            yield echo, json.dumps(item, sort_keys=True)


class PagedItems(SimpleDataSourceStreamReader):
    """asset_metrics as a stream. The offset is the page to go on from and how many of its items are taken, so a query that starts again goes on in the middle of
    the paging, and a batch that is repeated has the same items. A batch reads at most `pagesPerBatch` pages; at the last page it waits for more items or a next one."""

    def __init__(self, options: dict[str, str], fetch: Fetcher) -> None:
        self.params, self.most, self.fetch = json.loads(options.get("request", "{}")), int(options.get("pagesPerBatch", "10")), fetch
        self.echo = json.dumps(self.params, sort_keys=True)

    def initialOffset(self) -> dict[str, Any]:
        return {"url": request_url("asset_metrics", self.params), "taken": 0}

    def _rows(self, items: list[Any]) -> list[tuple[str, str]]:
        return [(self.echo, json.dumps(x, sort_keys=True)) for x in items]

    def read(self, start: dict[str, Any]) -> tuple[Iterator[tuple[str, str]], dict[str, Any]]:
        rows: list[tuple[str, str]] = []
        at = dict(start)
        for _ in range(self.most):
            items, following = page_of(at["url"], self.fetch)
            rows += self._rows(items[at["taken"] :])
            if not following:
                at = {"url": at["url"], "taken": max(at["taken"], len(items))}
                break
            at = {"url": following, "taken": 0}
        return iter(rows), at

    def readBetweenOffsets(self, start: dict[str, Any], end: dict[str, Any]) -> Iterator[tuple[str, str]]:
        at = dict(start)
        while True:
            last = at["url"] == end["url"]
            if last and end["taken"] <= at["taken"]:
                return
            items, following = page_of(at["url"], self.fetch)
            yield from self._rows(items[at["taken"] : end["taken"] if last else None])
            if last:
                return
            if not following:
                raise BadPayload(f"{at['url']} led to {end['url']} before and is now the last page")
            at = {"url": following, "taken": 0}


def provider(fetch: Fetcher = urlopen_fetcher) -> type[DataSource]:
    """A data source class to register: ``spark.dataSource.register(provider(fetch))``, then
    ``spark.read.format("market_http").option("endpoint", name).option("requests", json_list).load()``: one partition per request. As a stream,
    ``spark.readStream.format("market_http").option("request", json).option("pagesPerBatch", n).load()``: asset_metrics page by page."""

    ship_by_value(__name__)

    class MarketHttp(DataSource):
        @classmethod
        def name(cls) -> str:
            return "market_http"

        def schema(self) -> str:
            return "request string, item string"

        def reader(self, schema: Any) -> DataSourceReader:
            return _Reader(dict(self.options), fetch)

        def simpleStreamReader(self, schema: Any) -> PagedItems:
            return PagedItems(self.options, fetch)

    return MarketHttp


def snapshot(calls: dict[str, tuple[str, dict[str, Any]]], fetch: Fetcher = urlopen_fetcher) -> dict[str, Any]:
    """A bounded collection of named calls, each with its request and the SHA-256 of all data in canonical form."""
    data = {name: {"endpoint": e, "request": p, "items": list(pages(e, p, fetch))} for name, (e, p) in calls.items()}
    return {"data": data, "data_sha256": _digest(data)}


def _digest(data: Any) -> str:
    return hashlib.sha256((json.dumps(data, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n").encode()).hexdigest()


#: Names of the public snapshot's calls, each with its endpoint and which field of the request gives which parameter; and what a
#: snapshot says of its safety.
_SPAN = {"startTime": "start_ms", "endTime": "end_ms"}
PUBLIC_CALLS = {
    "spot_klines": ("spot_klines", {"symbol": "spot_symbol", "interval": "interval", **_SPAN}),
    "coinm_funding": ("funding_rate", {"symbol": "coinm_symbol", **_SPAN}),
    "coinm_open_interest": ("open_interest", {"pair": "coinm_pair", "period": "interval", **_SPAN}),
    "coinm_taker_buy_sell": ("taker_volume", {"pair": "coinm_pair", "period": "interval", **_SPAN}),
    "coinm_basis": ("basis", {"pair": "coinm_pair", "period": "interval", **_SPAN}),
    "onchain_asset_metrics": ("asset_metrics", {"assets": "onchain_asset", "metrics": "onchain_metrics", "start_time": "onchain_start", "end_time": "onchain_end"}),
}
SAFETY = {"credentials_used": False, "account_accessed": False, "orders_placed": False, "holdout_accessed": False, "live_authorized": False}


def public_snapshot(request: dict[str, Any], fetch: Fetcher = urlopen_fetcher, now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> dict[str, Any]:
    """The six calls of one market: a page of each, of observations MAX_PAGES at most, so what the driver holds is bounded. The document echoes the
    whole request and tells when it was fetched. onchain_metrics is a list."""
    flat = request | {"onchain_metrics": ",".join(request["onchain_metrics"])}
    data = {name: list(pages(e, {p: flat.get(f) for p, f in own.items()}, fetch)) for name, (e, own) in PUBLIC_CALLS.items()}
    return {"schema_version": "1.0.0", "mode": "RESEARCH_ONLY", "fetched_at": now().isoformat(), "request": request, "data": data, "safety": SAFETY, "data_sha256": _digest(data)}
