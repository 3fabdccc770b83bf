"""A Spark data source over paged, rate-limited services, one partition for each service.

What fetches a page is a function of the caller: over a network, or, as in the tests, from files."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

from ..operators.compose import by_source
from .registry import SOURCES, SourceSpec, source

SCHEMA = "api string, id_collect int, endpoint string, page int, total long, n int, results string"


class RateLimit:
    """So many calls in any second."""

    def __init__(self, calls_per_second: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.gap, self.clock, self.sleep, self.free = 1 / calls_per_second, clock, sleep, 0.0

    def wait(self) -> None:
        now = self.clock()
        if now < self.free:
            self.sleep(self.free - now)
        self.free = max(now, self.free) + self.gap


def pages(spec: SourceSpec, query: str, fetch: Callable[[str, int], dict], last_page: int = 0, limit: RateLimit | None = None) -> Iterator[dict]:
    """Pages behind `last_page`, the last complete one, until a short or failed page, the cap, or the only page."""
    limit = limit or RateLimit(spec.calls_per_second)
    page = last_page + 1
    while spec.most_rows is None or (page - 1) * spec.page_size < spec.most_rows:
        limit.wait()
        try:
            got = fetch(query.format(spec.offset(page)), page)
        except OSError:
            return
        results = got.get("results", [])
        yield {"page": page, "total": got.get("total_nb") or got.get("total") or 0, "n": len(results), "results": results}
        if spec.single_page or len(results) != spec.page_size:
            return
        page += 1


def until_empty(fetch: Callable[[int], list], size: int = 100) -> Iterator[list]:
    """Pages of a library until one is empty; the last, shorter page counts, too."""
    start = 0
    while got := fetch(start):
        yield got
        start += size


def collect(queries: DataFrame, fetch: Callable[[str, str, int], dict]) -> DataFrame:
    """One row a page of the pending queries (api, id_collect, keyword, year, last_page). All queries of a service are in one
    partition, so its rate limit holds, and one service's pages go out as they come (C6). A service with several endpoints is asked at each, from its
    first page or behind last_page, the query text having the endpoint's name and a question mark in front."""

    def run(batches):
        import pandas as pd

        limits: dict[str, RateLimit] = {}
        for frame in batches:
            for q in frame.itertuples():
                spec = source(q.api)
                limit = limits.setdefault(spec.name, RateLimit(spec.calls_per_second))
                text = spec.compile(list(q.keyword), int(q.year))
                for end in spec.endpoints:
                    for p in pages(spec, f"{end}?{text}" if end else text, lambda u, n, a=q.api: fetch(a, u, n), int(q.last_page), limit):
                        yield pd.DataFrame([[q.api, q.id_collect, end, p["page"], p["total"], p["n"], json.dumps(p["results"])]], columns=["api", "id_collect", "endpoint", "page", "total", "n", "results"])

    return by_source(queries, len(SOURCES)).mapInPandas(run, SCHEMA)


def register(spark: SparkSession, name: str, schema: str, specs: list[dict], reader: Callable[[dict], Iterator[tuple]]) -> None:
    """A data source `spark.read.format(name)` whose partitions are `specs` and whose rows `reader(spec)` gives."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(s) for s in specs]

        def read(self, partition):
            yield from reader(partition.value)

    class Source(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Source)
