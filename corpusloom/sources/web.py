"""Web APIs as a Spark data source, batch and stream: pages are read by the tasks, failures are rows.

``spark.read.format("web_api")`` gives a row for every item (JSON text) of every page of every query. With offset paging a
partition is a span of pages of one query; with cursor paging it is a query, whose pages follow one another; a later read goes on from the cursors of this one. As a stream the
offset is the number of items an endpoint has: a batch reads what came since, and a restart goes on where
the checkpoint ends. Every request has a time-out, is repeated with growing pauses where that can help, and keeps to
a rate; a page that stays unread is one row with ``error``, and the pages behind it are read all the same (a cursor chain ends there).

Defined results: an empty page ends a query; an item that is no JSON object is kept as its JSON text; no query, no rows.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "query string, page long, place int, item string, cursor string, attempts int, error string"
#: Answers that another attempt may change.
PASSING = {408, 425, 429, 500, 502, 503, 504}


@dataclass(frozen=True)
class Api:
    """Where an API has its items, its next cursor and its total, and what it calls its parameters."""

    items: str
    count: str
    cursor: str | None = None  # path of the next cursor in a page; without it pages are numbered by offset
    query_param: str = "query"
    size_param: str = "per_page"
    offset_param: str = "offset"
    cursor_param: str = "cursor"
    key_param: str | None = None
    key_header: str | None = None


# Fixed values of public APIs.
APIS = {
    "openalex": Api("results", "meta.count", "meta.next_cursor", "search", "per_page", key_param="api_key"),
    "crossref": Api("message.items", "message.total-results", "message.next-cursor", "query", "rows"),
    "semantic_scholar": Api("data", "total", None, "query", "limit", key_header="x-api-key"),
}


def at_path(page: dict, path: str):
    for name in path.split("."):
        page = page.get(name) if isinstance(page, dict) else None
    return page


@dataclass
class Client:
    """One task's connection: a rate that slows down after failures and recovers, time-outs, repeats, a budget of requests."""

    rate: float = 10.0
    timeout: float = 30.0
    attempts: int = 4
    pause: float = 0.5
    longest_pause: float = 60.0
    budget: int | None = None
    headers: dict[str, str] = field(default_factory=dict)
    slow: float = 1.0
    spent: int = 0
    last: float = 0.0
    open: Callable = urllib.request.urlopen
    sleep: Callable[[float], None] = time.sleep

    def get(self, url: str, *, without_key: str | None = None) -> tuple[dict | None, int, str | None]:
        """(page, attempts, error). ``without_key`` is tried once where the key is refused."""
        error, pause = "no attempt", self.pause
        for n in range(1, self.attempts + 1):
            if self.budget is not None and self.spent >= self.budget:
                return None, n - 1, "the budget of requests is spent"
            self.sleep(max(0.0, self.slow / self.rate - (time.monotonic() - self.last)))
            self.last, self.spent = time.monotonic(), self.spent + 1
            try:
                with self.open(urllib.request.Request(url, headers=self.headers), timeout=self.timeout) as answer:
                    page = json.loads(answer.read())
                self.slow = max(1.0, self.slow * 0.9)
                return page, n, None
            except urllib.error.HTTPError as e:
                error = f"HTTP {e.code}"
                if e.code in (401, 403) and (without_key or self.headers.pop("x-api-key", None)):
                    url, without_key = without_key or url, None
                    continue
                if e.code not in PASSING:
                    return None, n, error
            except (OSError, ValueError) as e:  # connection, time-out, a body that is no JSON
                error = f"{type(e).__name__}: {e}"[:200]
            self.slow = min(self.longest_pause, self.slow * 2)
            if n < self.attempts:
                self.sleep(min(pause, self.longest_pause))
                pause *= 2
        return None, self.attempts, error


class Span(InputPartition):
    """Items from ``first`` to before ``last`` (None: to the end) of a query; with a cursor, the chain from there."""

    def __init__(self, query: str, first: int, last: int | None, cursor: str | None = None):
        self.query, self.first, self.last, self.cursor, self.tasks, self.at_once = query, first, last, cursor, 1, 1


def _together(spans: list[Span], at_once: int | None) -> list[Span]:
    for span in spans:
        span.tasks, span.at_once = len(spans), min(len(spans), at_once or len(spans))
    return spans


class _Pages:
    """What batch and stream readers share: the options and the reading of a span."""

    def __init__(self, options: dict[str, str]):
        o = {k.lower(): v for k, v in options.items()}
        self.endpoint, self.api = o["endpoint"], APIS[o.get("api", "openalex")]
        self.queries: list[str] = json.loads(o.get("queries", '[""]'))
        self.size, self.span = int(o.get("pagesize", 50)), int(o.get("pagesperpartition", 20))
        self.most = int(o["maxpages"]) if "maxpages" in o else None
        self.extra, self.key = json.loads(o.get("params", "{}")), o.get("apikey")
        self.cursors = json.loads(o.get("cursors", "{}"))
        self.paging = o.get("paging", "cursor" if self.api.cursor else "offset")
        self.at_once = int(o["tasksatonce"]) if "tasksatonce" in o else None
        self.client_options = {"rate": float(o.get("rate", 10)), "timeout": float(o.get("timeout", 30)), "attempts": int(o.get("attempts", 4)), "pause": float(o.get("pause", 0.5)), "budget": int(o["budget"]) if "budget" in o else None}

    def client(self, tasks: int = 1, at_once: int | None = None) -> Client:
        """Rate and budget are those of the whole read: the budget is shared out among its tasks, the rate among those that can run at once."""
        o = dict(self.client_options)
        o["rate"] /= max(at_once or tasks, 1)
        o["budget"] = None if o["budget"] is None else max(1, o["budget"] // max(tasks, 1))
        return Client(**o, headers={"x-api-key": self.key} if self.key and self.api.key_header else {})

    def page(self, client: Client, query: str, size: int, offset: int, cursor: str | None) -> tuple[dict | None, int, str | None]:
        where = {self.api.cursor_param: cursor or "*"} if self.paging == "cursor" else {self.api.offset_param: offset}
        params = {self.api.query_param: query, self.api.size_param: size} | where | self.extra
        url = lambda p: f"{self.endpoint}?{urllib.parse.urlencode(p)}"
        if self.key and self.api.key_param:
            return client.get(url(params | {self.api.key_param: self.key}), without_key=url(params))
        return client.get(url(params))

    def read_span(self, part: Span) -> Iterator[tuple]:
        client, at, cursor, chained = self.client(part.tasks, part.at_once), part.first, part.cursor, self.paging == "cursor"
        while part.last is None or at < part.last:
            size = self.size if chained or part.last is None else min(self.size, part.last - at)
            page, attempts, error = self.page(client, part.query, size, at, cursor)
            number = at // self.size
            if page is None:
                yield (part.query, number, None, None, cursor, attempts, error)
                if chained or part.last is None:
                    return  # what follows is not known
                at += size
                continue
            items = at_path(page, self.api.items) or []
            cursor = at_path(page, self.api.cursor) if chained else None
            for k, item in enumerate(items):
                yield (part.query, number, k, json.dumps(item, ensure_ascii=False, sort_keys=True), cursor, attempts, None)
            at += size
            if not items or chained and not cursor:
                return


class _Reader(DataSourceReader, _Pages):
    def partitions(self) -> list[Span]:
        most = None if self.most is None else self.most * self.size
        if self.paging == "cursor":
            return _together([Span(q, 0, most, self.cursors.get(q)) for q in self.queries], self.at_once)
        spans, client = [], self.client()
        for q in self.queries:
            page, _, _ = self.page(client, q, 1, 0, None)  # only the total is of interest
            total = at_path(page, self.api.count) if page else None
            end = min(x for x in (total, most) if x is not None) if (total, most) != (None, None) else None
            step = self.size * self.span
            spans += [Span(q, lo, min(lo + step, end)) for lo in range(0, end, step)] if end is not None else [Span(q, 0, None)]
        return _together(spans, self.at_once)

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.read_span(partition) if partition else iter(())  # Spark reads None where there are no partitions


class _Stream(DataSourceStreamReader, _Pages):
    """Offsets are totals by query, as the endpoint states them: {"0": 120, "1": 7}, by the query's place."""

    def __init__(self, options: dict[str, str]):
        _Pages.__init__(self, options)
        self.paging = "offset"
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {str(k): 0 for k in range(len(self.queries))}

    def latestOffset(self) -> dict:  # noqa: N802
        client = self.client()
        for k, q in enumerate(self.queries):
            page, _, _ = self.page(client, q, 1, 0, None)
            total = at_path(page, self.api.count) if page else None
            self.known[str(k)] = max(self.known.get(str(k), 0), int(total or 0))  # an endpoint that does not answer has nothing new
        return dict(self.known)

    def partitions(self, start: dict, end: dict) -> list[Span]:
        step = self.size * self.span
        return _together([Span(q, lo, min(lo + step, end[str(k)])) for k, q in enumerate(self.queries) for lo in range(start.get(str(k), 0), end[str(k)], step)], self.at_once)

    def read(self, partition: Span) -> Iterator[tuple]:
        return self.read_span(partition)

    def commit(self, end: dict) -> None:
        pass

    def stop(self) -> None:
        pass


class WebApi(DataSource):
    """Options: endpoint, api (openalex, crossref, semantic_scholar), queries (JSON list), paging (offset, cursor), pageSize,
    pagesPerPartition, maxPages, params (JSON), apiKey, cursors (JSON: query -> where to go on), rate (requests a second, all tasks),
    timeout, attempts, pause (seconds, doubled each time), budget (requests, all tasks), tasksAtOnce (tasks that can run at once, among which the rate is shared out; all of them where it is not given)."""

    @classmethod
    def name(cls) -> str:
        return "web_api"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def tasks_at_once(spark: SparkSession) -> int | None:
    """How many tasks can run at once; None where more executors may come or the default parallelism says something else."""
    given = spark.sparkContext.getConf()
    if given.get("spark.dynamicAllocation.enabled", "false") == "true":
        return None
    instances, cores = given.get("spark.executor.instances"), given.get("spark.executor.cores")
    if instances and cores and not spark.sparkContext.master.startswith("local"):
        return int(instances) * int(cores)
    return None if given.contains("spark.default.parallelism") else spark.sparkContext.defaultParallelism


def _options(spark: SparkSession, endpoint: str, queries: list[str], options: dict) -> dict[str, str]:
    at_once = tasks_at_once(spark)
    options = ({"tasksAtOnce": at_once} if at_once else {}) | options
    plain = {k: json.dumps(v) if isinstance(v, (dict, list)) else str(v) for k, v in options.items()}
    return plain | {"endpoint": endpoint, "queries": json.dumps(queries)}


def read_api(spark: SparkSession, endpoint: str, queries: list[str], **options) -> DataFrame:
    """Rows of SCHEMA for all pages of ``queries``; options as in ``WebApi``."""
    spark.dataSource.register(WebApi)
    return spark.read.format("web_api").options(**_options(spark, endpoint, queries, options)).load()


def stream_api(spark: SparkSession, endpoint: str, queries: list[str], **options) -> DataFrame:
    """The same as a stream: each batch has the items that came since the last one."""
    spark.dataSource.register(WebApi)
    return spark.readStream.format("web_api").options(**_options(spark, endpoint, queries, options)).load()


def next_cursors(rows: DataFrame) -> dict[str, str]:
    """By query the cursor behind the last page that was read, for the option ``cursors`` of a later read. One row a query reaches the driver."""
    from pyspark.sql import functions as F

    last = rows.groupBy("query").agg(F.max_by("cursor", F.struct("page", F.col("error").isNotNull())).alias("cursor"))
    return {r["query"]: r["cursor"] for r in last.collect() if r["cursor"]}
