"""HTTP scans as a Spark data source: one partition per request, failures as rows.

spark.dataSource.register(HttpSource); spark.read.format("quillstream_http").option("requests", json.dumps([...])).load()
A request is {"id", "url", "hosts"} and, for a POST, "headers" and "data" (redirects are not followed then); each of at most three redirects is held against hosts again. What follows (parsing,
extraction) works on the payload table alone, so it needs no network.
"""

from __future__ import annotations

import json
import time
from urllib.error import HTTPError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MOST_REDIRECTS = 3
SCHEMA = "id string, url string, status int, content_type string, body string, error string, duration_ms int"


def url_error(url: str, hosts: list[str] | None) -> str | None:
    parts = urlsplit(url)
    if not parts.scheme or not parts.hostname:
        return f"Invalid URL: {url}"
    if parts.scheme != "https":
        return "URL must use HTTPS"
    if hosts is not None and parts.hostname.lower() not in hosts:
        return f"Host {parts.hostname} is not allowed"
    return None


class _Still(HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def required_secret(value: str | None, name: str) -> str:
    """The trimmed secret; an empty one is an error that names it and shows nothing of it."""
    if not (value or "").strip():
        raise ValueError(f"{name} is required")
    return value.strip()


def browser_request(target: str, url: str, hosts: list[str], endpoint: str, token: str) -> dict:
    """The POST that asks a browser service for a page; raises if the page may not be fetched or the token is empty."""
    if error := url_error(url, hosts):
        raise ValueError(error)
    headers = {"Authorization": f"Bearer {required_secret(token, 'token')}", "Content-Type": "application/json"}
    return {"id": target, "url": endpoint, "hosts": [urlsplit(endpoint).hostname], "headers": headers, "data": json.dumps({"url": url})}


def open_url(url: str, timeout: float, headers: dict[str, str] | None = None, data: str | None = None) -> tuple[int, dict[str, str], bytes]:
    request = Request(url, headers={"User-Agent": "quillstream", **(headers or {})}, data=data.encode("utf-8") if data is not None else None)
    try:
        with build_opener(_Still).open(request, timeout=timeout) as r:
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read()
    except HTTPError as e:
        return e.code, {k.lower(): v for k, v in e.headers.items()}, e.read()


def fetch(request: dict, timeout: float = 15.0, opener=open_url) -> tuple:
    """One row of SCHEMA without its time; never raises."""
    url, hosts = request["url"], request.get("hosts")
    more = {k: request[k] for k in ("headers", "data") if k in request}
    try:
        for _ in range(MOST_REDIRECTS + 1):
            if error := url_error(url, hosts):
                return request["id"], url, None, None, None, error
            status, headers, body = opener(url, timeout, **more)
            if status in (301, 302, 303, 307, 308) and headers.get("location") and "data" not in more:
                url = urljoin(url, headers["location"])
                continue
            kind = headers.get("content-type")
            error = None if 200 <= status < 300 else f"HTTP {status}"
            return request["id"], url, status, kind, body.decode("utf-8", "replace") if error is None else None, error
        return request["id"], url, None, None, None, "Too many redirects"
    except TimeoutError:
        return request["id"], url, None, None, None, f"Timed out after {int(timeout * 1000)}ms"
    except Exception as e:
        return request["id"], url, None, None, None, f"{type(e).__name__}: {e}"


def timed_fetch(request: dict, timeout: float = 15.0, opener=open_url) -> tuple:
    """One row of SCHEMA; never raises."""
    began = time.monotonic()
    return (*fetch(request, timeout, opener), round(1000 * (time.monotonic() - began)))


class _Reader(DataSourceReader):
    def __init__(self, requests: list[dict], timeout: float):
        self.requests, self.timeout = requests, timeout

    def partitions(self):
        return [InputPartition(i) for i in range(len(self.requests))]

    def read(self, partition):
        yield timed_fetch(self.requests[partition.value], self.timeout)


class HttpSource(DataSource):
    @classmethod
    def name(cls):
        return "quillstream_http"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(json.loads(self.options.get("requests", "[]")), float(self.options.get("timeout", "15")))
