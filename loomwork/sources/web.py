"""Pages over HTTP as a data source: URLs are split over partitions, each fetched with retries, errors
kept as rows. The fetcher is pluggable, for rendered pages or for tests."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from http.client import HTTPException

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "ordinal long, url string, success boolean, status int, content string, error string, attempts int, fetched_at timestamp"
Fetch = Callable[[str, float], tuple[int, str, float | None]]


def fetch_http(url: str, timeout: float) -> tuple[int, str, float | None]:
    """Status, text and the seconds that a Retry-After header asks for."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "loomwork"}), timeout=timeout) as response:
            return response.status, response.read().decode(response.headers.get_content_charset() or "utf-8", "replace"), None
    except urllib.error.HTTPError as error:
        wait = error.headers.get("Retry-After", "") if error.headers else ""
        return error.code, "", float(wait) if wait.replace(".", "", 1).isdigit() else None


def fetch_one(ordinal: int, url: str, fetch: Fetch, tries: int, timeout: float, pause: float, delay: float) -> tuple:
    """A row of SCHEMA. Failures of the connection and statuses 429 and 503 are tried again, after
    ``delay * 2**k`` seconds or as long as the server asks."""
    from datetime import datetime, timezone

    status, content, error, k = None, None, None, 0
    for k in range(1, tries + 1):
        time.sleep(pause)
        try:
            status, content, wait = fetch(url, timeout)
            error = None if status < 400 else f"HTTP {status}"
            if status not in (429, 503):
                break
        except (OSError, ValueError, HTTPException) as problem:  # no connection, no URL, a cut body
            status, content, error, wait = None, None, f"{type(problem).__name__}: {problem}", None
        if k < tries:
            time.sleep(delay * 2 ** (k - 1) if wait is None else wait)
    return ordinal, url, error is None, status, content if error is None else None, error, k, datetime.now(timezone.utc)


@dataclass
class Urls(InputPartition):
    rows: list[tuple[int, str]]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.urls = options["urls"].split("\n")
        self.parts = int(options.get("partitions", 8))
        self.settings = int(options.get("tries", 3)), float(options.get("timeout", 30)), float(options.get("pause", 0)), float(options.get("delay", 1))

    def partitions(self) -> list[Urls]:
        rows = [(k, u.strip()) for k, u in enumerate(self.urls) if u.strip()]
        return [Urls(rows[k :: self.parts]) for k in range(min(self.parts, len(rows)))] or [Urls([])]

    def read(self, part: Urls) -> Iterator[tuple]:
        for ordinal, url in part.rows:
            yield fetch_one(ordinal, url, fetch_http, *self.settings)


class WebPages(DataSource):
    """``format("web_pages")``: option ``urls``, one a line, and ``partitions``, ``tries``,
    ``timeout``, ``pause``, ``delay``."""

    @classmethod
    def name(cls) -> str:
        return "web_pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def pages(spark: SparkSession, urls: list[str], **options) -> DataFrame:
    """Pages of a list of URLs."""
    spark.dataSource.register(WebPages)
    return spark.read.format("web_pages").options(urls="\n".join(urls), **options).load()


def fetch_table(urls: DataFrame, fetch: Fetch = fetch_http, partitions: int | None = None, tries: int = 3, timeout: float = 30, pause: float = 0, delay: float = 1) -> DataFrame:
    """Pages of a table ``ordinal, url``. A host's URLs go to one task, which paces them."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.string(), pa.bool_(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.timestamp("us", "UTC")]
    target = pa.schema(list(zip([f.split()[0] for f in SCHEMA.split(", ")], kinds)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for o, u in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.append(fetch_one(o, u, fetch, tries, timeout, pause, delay))
                held += len(rows[-1][4] or "")
                if held > 4 << 20 or len(rows) == 100:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), target)], schema=target)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), target)], schema=target)

    rows = urls.select(F.col("ordinal").cast("long"), "url").repartition(partitions or int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.regexp_extract("url", r"^[^:/?#]+://([^/?#]*)", 1))
    return rows.mapInArrow(work, SCHEMA)
