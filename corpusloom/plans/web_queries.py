"""Queries that read web APIs: a local endpoint serves pages that Spark wrote from the driver's tables, with failures put in."""

from __future__ import annotations

import json
import threading
import urllib.parse
from collections import Counter, OrderedDict
from collections.abc import Iterator
from contextlib import contextmanager
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.session import load
from corpusloom.sources import web
from corpusloom.workspace import drop, materialise, scratch

PAGE = 50
#: Pages of a file, and files that the endpoint keeps at a time.
SHELF, KEPT = 128, 48


def write_pages(items: DataFrame, key: str, path: str) -> None:
    """A line for every page of ``PAGE`` keys (key div PAGE): its number, a tab, the page's items as a JSON list. A file for every ``SHELF`` pages. A page bounds its group."""
    record = F.struct(*items.columns)
    pages = items.groupBy(F.floor(F.col(key) / PAGE).cast("long").alias("page")).agg(F.to_json(F.sort_array(F.collect_list(record))).alias("items"))
    lines = pages.select(F.concat(F.col("page").cast("string"), F.lit("\t"), "items").alias("value"), F.floor(F.col("page") / SHELF).cast("long").alias("shelf"))
    lines.repartition("shelf").write.partitionBy("shelf").text(path)


@contextmanager
def endpoint(spark: SparkSession, path: str, pages: int, *, refuse=lambda page, n: None) -> Iterator[tuple[str, Counter]]:
    """A local server of the pages below ``path`` while the block runs: its address and the requests by page. ``refuse`` may give a status."""
    seen: Counter = Counter()
    lock = threading.Lock()
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())

    shelves: OrderedDict[int, dict[int, bytes]] = OrderedDict()
    reading = threading.Lock()

    def shelf(number: int) -> dict[int, bytes]:
        with reading:
            if number not in shelves:
                lines = []
                for file in fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/shelf={number}/part-*")) or []:
                    stream = fs.open(file.getPath())
                    try:
                        lines += bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).split(b"\n")
                    finally:
                        stream.close()
                shelves[number] = {int(page): items for page, _, items in (line.partition(b"\t") for line in lines if line)}
                while len(shelves) > KEPT:
                    shelves.popitem(last=False)
            shelves.move_to_end(number)
            return shelves[number]

    def body(page: int) -> bytes:
        return shelf(page // SHELF).get(page, b"[]")

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            asked = dict(urllib.parse.parse_qsl(urllib.parse.urlsplit(self.path).query))
            size = int(asked.get("per_page") or asked.get("limit"))
            at = int(asked["offset"]) if "offset" in asked else 0 if asked["cursor"] == "*" else int(asked["cursor"])
            page = at // PAGE
            if size == 1:  # only the total is asked for
                status, data = None, json.dumps({"meta": {"count": pages * PAGE}, "total": pages * PAGE, "results": []}).encode()
            else:
                with lock:
                    seen[page] += 1
                    status = refuse(page, seen[page])
                if not status:
                    items = body(page)
                    rest = json.dumps({"meta": {"count": pages * PAGE, "next_cursor": str(at + PAGE) if page + 1 < pages else None}, "total": pages * PAGE}).encode()
                    data = b'{"results": ' + items + b', "data": ' + items + b", " + rest[1:]
            data = b"" if status else data
            self.send_response(status or 200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = ThreadingHTTPServer((spark.conf.get("spark.driver.host", "127.0.0.1"), 0), Handler)
    thread = threading.Thread(target=server.serve_forever, daemon=True)
    thread.start()
    try:
        yield f"http://{server.server_address[0]}:{server.server_address[1]}/works", seen
    finally:
        server.shutdown()
        server.server_close()
        thread.join()


def _served(spark: SparkSession, sf: str) -> tuple[str, int]:
    path = scratch(spark, "pages")
    docs = load(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    write_pages(docs, "doc_id", path)
    return path, int(docs.agg(F.max("doc_id")).first()[0]) // PAGE + 1


def passing_and_lasting(page: int, n: int) -> int | None:
    """Every seventh page is refused once, the pages 5, 16, 27, .. always."""
    return 404 if page % 11 == 5 else 503 if page % 7 == 3 and n == 1 else None


_FIELDS = "doc_id long, lang string, source string, n_chars long"


@query("""SELECT doc_id // 50 AS page, doc_id, source, n_chars, CAST(NULL AS VARCHAR) AS error, CASE WHEN (doc_id // 50) % 7 = 3 THEN 2 ELSE 1 END AS attempts FROM documents WHERE (doc_id // 50) % 11 <> 5
    UNION ALL SELECT DISTINCT doc_id // 50, NULL, NULL, NULL, 'HTTP 404', 1 FROM documents WHERE (doc_id // 50) % 11 = 5""")
def web_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All pages of an endpoint by offset, spans of pages side by side; a page that is refused for a while is read later, one that stays refused is a row."""
    path, pages = _served(spark, sf)
    with endpoint(spark, path, pages, refuse=passing_and_lasting) as (url, _):
        rows = materialise(web.read_api(spark, url, ["all"], api="semantic_scholar", pageSize=PAGE, pagesPerPartition=8, rate=10_000, pause=0.01), "read")
    drop(spark, path)
    item = F.from_json("item", _FIELDS)
    return rows.select("page", item["doc_id"].alias("doc_id"), item["source"].alias("source"), item["n_chars"].alias("n_chars"), "error", "attempts")


@query("SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS n_chars, count(DISTINCT CASE WHEN doc_id // 50 < 3 THEN 'first' ELSE 'second' END) AS runs FROM documents GROUP BY source")
def web_cursors(spark: SparkSession, sf: str) -> DataFrame:
    """A cursor chain read in two runs: the second starts at the cursor that the first one left."""
    path, pages = _served(spark, sf)
    with endpoint(spark, path, pages) as (url, seen):
        first = materialise(web.read_api(spark, url, ["all"], pageSize=PAGE, maxPages=3, rate=10_000), "first")
        second = materialise(web.read_api(spark, url, ["all"], pageSize=PAGE, cursors=web.next_cursors(first), rate=10_000), "second")
    if max(seen.values()) > 1:
        raise ValueError("a page was asked for twice")
    drop(spark, path)
    rows = first.withColumn("run", F.lit("first")).unionAll(second.withColumn("run", F.lit("second")))
    item = F.from_json("item", _FIELDS)
    return rows.select(item["source"].alias("source"), item["n_chars"].alias("n_chars"), "run").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("n_chars"), F.countDistinct("run").alias("runs"))
