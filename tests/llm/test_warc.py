import gzip
import io
import json
from pathlib import Path

import pytest

from corpusloom.llm import warc
from tests import oracle

ROWS = [(1, "http://a/1", "x"), (2, "http://a/2", "x"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5\r\nX: y", "WARC/1.1\r\n\r\nnested"), (6, "http://a/6", "é" * 100000), (2, "http://a/2", "x"), (None, "http://n", "z")]


def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumnRenamed("extra", "payload")


def test_splitting_whatever_the_chunks():
    records = [warc._record(str(i), "u", b"\r\n\r\n" * i, None) for i in range(20)] + [warc._record("r", "u", b"abc", "7")]
    blob = gzip.compress(b"".join(records))
    for chunk in (1, 7, 1 << 20):
        got = list(warc.split_records(warc._inflate(io.BytesIO(blob), chunk=chunk)))
        assert [r for _, r in got] == records
    assert got[-1][0]["warc-type"] == "revisit" and got[-1][0]["content-length"] == "0"


def test_archives_members_and_index(spark, tmp_path):
    made = warc.write_archives(warc.with_targets(pages(spark), "page_id", "html"), f"file://{tmp_path}/plain", roll_bytes=2000).collect()
    assert sum(r["records"] for r in made) == len(ROWS)
    for r in made:  # a single member: one gzip stream over the whole file
        raw = Path(r["archive"].removeprefix("file://")).read_bytes()
        d = __import__("zlib").decompressobj(31)
        d.decompress(raw)
        assert d.eof and not d.unused_data
    done = warc.normalise(spark.createDataFrame(made), f"file://{tmp_path}/records").collect()
    total = 0
    for r in done:
        raw = Path(r["archive"].removeprefix("file://")).read_bytes()
        at = 0
        for line in Path(r["index"].removeprefix("file://")).read_text().splitlines():
            e = json.loads(line)
            assert e["offset"] == at
            record = gzip.decompress(raw[at : at + e["length"]])
            assert record.startswith(b"WARC/1.1\r\nWARC-Type: " + e["type"].encode())
            at += e["length"]
            total += 1
        assert at == len(raw) == r["bytes"]
    assert total == len(ROWS)
    payloads = {bytes(x["payload"]) for x in warc.read_archives(spark.createDataFrame(done)).collect() if x["payload"] is not None}
    assert ("é" * 100000).encode() in payloads and b"WARC/1.1\r\n\r\nnested" in payloads


def test_page_records(spark):
    got = {(r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.page_records(pages(spark)).collect()}
    assert got == {(1, "revisit", 2, 1), (2, "response", None, 1), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 18), (6, "response", None, 200000), (None, "response", None, 1)}
    assert warc.page_records(pages(spark).limit(0)).count() == 0


def test_a_revisit_needs_its_response(spark):
    rows = warc.archive_roundtrip(pages(spark))
    assert warc.resolve_revisits(rows).count() == len(ROWS)
    with pytest.raises(Exception, match="no response for the revisit"):
        warc.resolve_revisits(rows.where("record_type = 'revisit'")).collect()


def test_inflating_is_bounded():
    blob = gzip.compress(b"\0" * 50_000_000)
    parts = list(warc._inflate(io.BytesIO(blob), chunk=1 << 16))
    assert sum(map(len, parts)) == 50_000_000 and max(map(len, parts)) <= 1 << 16


def test_equals_sql(spark, sf):
    got = warc.page_records(spark.read.parquet(f"{sf}/pages.parquet")).toPandas()
    assert oracle.rows(got) == oracle.rows(oracle.connect(sf).sql(warc.oracle_sql()).df())


def test_small_payloads_are_all_responses(spark):
    df = warc.archive_roundtrip(pages(spark), min_bytes=1)
    assert {r["rid"] for r in df.collect() if r["record_type"] == "revisit"} == {"1"}
