"""The web API source against a local endpoint: paging, repeats, refusals, keys, budgets, cursors, a stream with a restart."""

import io
import json
import urllib.error

from pyspark.sql import functions as F

from corpusloom.plans import web_queries as W
from corpusloom.sources import web


class _Answers:
    """Stands for urlopen: gives what it is told to, one answer a call."""

    def __init__(self, *answers):
        self.answers, self.urls, self.keys = list(answers), [], []

    def __call__(self, request, timeout):
        self.urls.append(request.full_url)
        self.keys.append(request.get_header("X-api-key"))
        answer = self.answers.pop(0)
        if isinstance(answer, int):
            raise urllib.error.HTTPError(request.full_url, answer, "", {}, None)
        if isinstance(answer, Exception):
            raise answer
        return io.BytesIO(answer if isinstance(answer, bytes) else json.dumps(answer).encode())


def _client(*answers, **kw):
    naps = []
    return web.Client(open=_Answers(*answers), sleep=naps.append, rate=1e9, **kw), naps


def test_client_repeats_what_may_pass():
    client, naps = _client(503, TimeoutError("slow"), b"no json", {"a": 1}, pause=1.0)
    assert client.get("http://x") == ({"a": 1}, 4, None)
    assert [n for n in naps if n > 0.5] == [1.0, 2.0, 4.0]
    client, _ = _client(404)
    assert client.get("http://x") == (None, 1, "HTTP 404")
    client, _ = _client(500, 500, attempts=2)
    assert client.get("http://x") == (None, 2, "HTTP 500")


def test_client_slows_down_and_keeps_to_its_budget():
    client, _ = _client(500, 500, {"a": 1}, {"a": 2}, attempts=4, budget=4)
    client.get("http://x")
    assert client.slow == 4 * 0.9
    assert client.get("http://x")[0] == {"a": 2}
    assert client.get("http://x") == (None, 0, "the budget of requests is spent")


def test_client_tries_a_refused_key_once_without():
    client, _ = _client(403, {"a": 1})
    assert client.get("http://x?k=1", without_key="http://x")[0] == {"a": 1} and client.open.urls == ["http://x?k=1", "http://x"]
    client, _ = _client(401, {"a": 1}, headers={"x-api-key": "k"})
    assert client.get("http://x")[0] == {"a": 1} and client.open.keys == ["k", None]
    client, _ = _client(403)
    assert client.get("http://x") == (None, 1, "HTTP 403")


def _serve(spark, tmp_path, rows):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(rows)], "doc_id long, title string")
    W.write_pages(df, "doc_id", f"file://{tmp_path}/{rows}")
    return f"file://{tmp_path}/{rows}", -(-rows // W.PAGE)


def test_offset_and_cursor_pages(spark, tmp_path):
    path, pages = _serve(spark, tmp_path, 520)
    with W.endpoint(spark, path, pages, refuse=lambda p, n: 500 if p == 4 else None) as (url, seen):
        got = web.read_api(spark, url, ["a", "b"], api="semantic_scholar", pageSize=W.PAGE, pagesPerPartition=3, rate=1e6, attempts=2, pause=0.01).cache()
        assert got.count() == 2 * (520 - 50 + 1)
        assert [tuple(r) for r in got.where("error is not null").select("query", "page", "attempts").orderBy("query").collect()] == [("a", 4, 2), ("b", 4, 2)]
        # a chain ends at the page that cannot be read, and goes on from there once it can
        first = web.read_api(spark, url, ["a"], pageSize=W.PAGE, rate=1e6, attempts=1).cache()
        assert first.where("error is null").count() == 200 and first.where("error is not null").count() == 1
        cursors = web.next_cursors(first)
    with W.endpoint(spark, path, pages) as (url, seen):
        rest = web.read_api(spark, url, ["a"], pageSize=W.PAGE, rate=1e6, cursors=cursors).cache()
        assert rest.count() == 320 and min(seen) == 4
        assert web.read_api(spark, url, ["a"], pageSize=W.PAGE, maxPages=2, rate=1e6).count() == 100
    assert web.read_api(spark, "http://127.0.0.1:9", ["a"], attempts=1, timeout=2).where("error is not null").count() == 1
    assert web.read_api(spark, "http://127.0.0.1:9", []).count() == 0


def test_stream_goes_on_where_it_stopped(spark, tmp_path):
    numbers = []

    def sink(batch, number):
        numbers.append(number)
        batch.select(F.from_json("item", "doc_id long")["doc_id"].alias("doc_id")).write.mode("overwrite").parquet(f"{tmp_path}/out/batch={number}")

    path, pages = _serve(spark, tmp_path, 300)
    for known in (2, 2, pages):  # the endpoint grows before the third run
        with W.endpoint(spark, path, known) as (url, seen):
            q = web.stream_api(spark, url, ["a"], api="semantic_scholar", pageSize=W.PAGE, rate=1e6).writeStream.foreachBatch(sink).option("checkpointLocation", f"file://{tmp_path}/ck").start()
            q.processAllAvailable()
            q.stop()
    assert sorted(seen) == list(range(2, pages)) and len(numbers) == 2
    ids = [r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("doc_id").collect()]
    assert sorted(ids) == list(range(300))



def test_rate_is_shared_among_the_tasks_that_run_at_once(spark):
    from corpusloom.sources import web

    options = {"endpoint": "http://none", "api": "semantic_scholar", "rate": "80", "budget": "4000"}
    spans = lambda o: web._Stream(o).partitions({}, {"0": 50 * 20 * 400})
    few, all_ = spans(options | {"tasksAtOnce": "8"}), spans(options)
    pages = web._Pages(options)
    client = lambda part: pages.client(part.tasks, part.at_once)
    assert len(few) == len(all_) == 400 and (client(few[0]).rate, client(few[0]).budget) == (10, 10) and (client(all_[0]).rate, client(all_[0]).budget) == (0.2, 10)
    assert web.tasks_at_once(spark) == spark.sparkContext.defaultParallelism


def test_many_pages_lie_in_few_files(spark, tmp_path, monkeypatch):
    from corpusloom.plans import web_queries

    monkeypatch.setattr(web_queries, "KEPT", 1)
    path, n = f"file://{tmp_path}/p", 50 * 300
    web_queries.write_pages(spark.range(n).selectExpr("id AS doc_id", "'\t\n' AS s"), "doc_id", path)
    assert len(list(tmp_path.glob("p/shelf=*/part-*"))) == 3
    with web_queries.endpoint(spark, path, 300) as (url, seen):
        import json
        import urllib.request

        for page in (0, 299, 127, 128, 5):
            got = json.loads(urllib.request.urlopen(f"{url}?limit=50&offset={page * 50}").read())
            assert [x["doc_id"] for x in got["data"]] == list(range(page * 50, page * 50 + 50)) and got["results"] == got["data"] and got["data"][0]["s"] == "\t\n"
