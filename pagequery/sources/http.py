"""HTTP fetch of a frontier, in as many partitions as requests may run at once.

A page whose request fails has a null html and an error; any HTTP status that arrives with a body is a success. Responses of
429 and 5xx, and network failures, are tried again after a fixed delay. Each partition keeps its share of
the request rate.
"""

from __future__ import annotations

import gzip
import time
import urllib.error
import urllib.parse
import urllib.request
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from ..config import Config, Limits

SCHEMA = "pos bigint, url string, html string, status int, final_url string, content_type string, latency_ms bigint, bytes bigint, error string"


@dataclass
class Response:
    body: str | None = None
    status: int = 0
    final_url: str = ""
    content_type: str = ""
    size: int = 0
    latency_ms: int = 0
    error: str | None = None


class _Redirects(urllib.request.HTTPRedirectHandler):
    def __init__(self, limits: Limits):
        self.follow = limits.follow_redirects is not False
        self.max_redirections = 10 if limits.max_redirects is None else limits.max_redirects

    def redirect_request(self, *args):
        return super().redirect_request(*args) if self.follow else None


def opener(limits: Limits) -> urllib.request.OpenerDirector:
    proxies = urllib.request.ProxyHandler({"http": limits.proxy, "https": limits.proxy} if limits.proxy else {})
    return urllib.request.build_opener(proxies, _Redirects(limits))


def _decoded(raw: bytes, charset: str | None) -> str:
    """An unknown charset's name fails no page."""
    try:
        return raw.decode(charset or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


def _once(open_url, url: str, config: Config) -> Response:
    began = time.perf_counter()
    out = Response(final_url=url)
    headers = {"User-Agent": config.user_agent, "Accept-Encoding": "gzip, deflate", **config.headers}
    try:
        request = urllib.request.Request(url, config.body.encode() if config.body else None, headers, method=config.method)
        try:
            reply = open_url.open(request, timeout=config.limits.timeout_ms / 1000)
        except urllib.error.HTTPError as e:
            reply = e
        with reply:
            raw = reply.read()
            kind = reply.headers.get("Content-Encoding", "")
            raw = gzip.decompress(raw) if kind == "gzip" else zlib.decompress(raw) if kind == "deflate" else raw
            out.status, out.final_url, out.content_type = reply.status, reply.geturl() or url, reply.headers.get("Content-Type", "")
            out.body, out.size = _decoded(raw, reply.headers.get_content_charset()), len(raw)
    except Exception as e:  # whatever goes wrong with one page is that page's error
        out.error = f"[HTTP] url={url} {type(e).__name__}: {e}"
    out.latency_ms = round((time.perf_counter() - began) * 1000)
    return out


def fetch(url: str, config: Config, open_url=None) -> Response:
    open_url = open_url or opener(config.limits)
    for attempt in range(config.limits.max_retries + 1):
        out = _once(open_url, url, config)
        if attempt == config.limits.max_retries or not (out.error or out.status == 429 or out.status >= 500):
            return out
        time.sleep(config.limits.retry_delay_ms / 1000)
    return out


def fetch_pages(urls: DataFrame, config: Config) -> DataFrame:
    """urls (pos, url) -> SCHEMA. Deal out by an explicit number of partitions, so nothing merges them again."""
    width = min(256, max(1, config.limits.max_concurrent))
    rate = config.limits.requests_per_second
    pause = width / rate if rate and rate > 0 else 0.0

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_url, due = opener(config.limits), 0.0
        for b in batches:
            for pos, url in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                time.sleep(max(0.0, due - time.monotonic()))
                due = time.monotonic() + pause
                r = fetch(url, config, open_url)
                row = {"pos": pos, "url": url, "html": r.body, "status": r.status, "final_url": r.final_url, "content_type": r.content_type, "latency_ms": r.latency_ms, "bytes": r.size, "error": r.error}
                kinds = {"pos": pa.int64(), "status": pa.int32(), "latency_ms": pa.int64(), "bytes": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array([v], kinds.get(k, pa.string())) for k, v in row.items()], names=list(row))

    return urls.select("pos", "url").repartition(width, "url").mapInArrow(run, SCHEMA)


def http_get(url: str, config: Config | None = None) -> Response:
    """One request without extraction."""
    return fetch(url, config or Config())
