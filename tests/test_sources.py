import json

from pyspark.sql import functions as F

from corpusloom.functions import parse as P
from corpusloom.sources import readers, sinks
from corpusloom.streaming import incremental


def test_csv_to_papers(spark, tmp_path):
    (tmp_path / "t.csv").write_text("DOI;Title;Year;\n10.1234/test;Test Paper;2020;x\n10.5678/test2;Another Paper;2021;y\n;;;z\n")
    df = readers.read_table(spark, str(tmp_path / "t.csv"))
    assert len(df.columns) == 4 and df.count() == 3
    papers = readers.rows_to_papers(df, P.detect_columns(df))
    assert {(r["paper_id"], r["year"]) for r in papers.collect()} == {("doi:10.1234/test", 2020), ("doi:10.5678/test2", 2021)}


def test_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"rule_id": "r1", "polarity": "positive"}\n\n{bad\n')
    df = readers.read_jsonl(spark, str(tmp_path), P.RULE_RECORD).cache()
    assert sorted((r["rule_id"] or "", r["bad_line"] or "") for r in df.collect()) == [("", "{bad"), ("r1", "")]


def test_bundles_and_claims(spark, tmp_path):
    for run in ("output_a", "output_b"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "result.json").write_text(json.dumps({"run_id": run, "status": "SUCCESS", "summary": {"n_claims": 1, "n_rules": 0}}))
    got = readers.read_bundles(spark, f"{tmp_path}/output_*/result.json", P.RESULT_RECORD).select("bundle", "run_id", P.finder_status(F.col("status")).alias("s")).collect()
    assert sorted(tuple(r) for r in got) == [("output_a", "output_a", "processed_success"), ("output_b", "output_b", "processed_success")]
    claim = json.dumps({"claim_id": "c", "constructs": {"outcomes": [{"id": "o"}]}, "statistics": {"effect_size": {"value": 0.5}, "ci95": [0.1, 0.9]}, "study": {"setting": [{"value": "office"}]}})
    c = P.flat_claims(spark.createDataFrame([(claim,)], "j string").select(F.from_json("j", P.CLAIM_RECORD).alias("c")).select("c.*"), F.lit("run")).first()
    assert (c["ci95_low"], c["ci95_high"], c["setting"], c["effect_size_value"]) == (0.1, 0.9, "office", 0.5)


def test_library(spark):
    items = spark.createDataFrame([(1, "K1"), (2, "K2")], "itemID int, key string")
    data = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 1, 1)], "itemID int, fieldID int, valueID int")
    values, fields = spark.createDataFrame([(1, "Title"), (2, "10.1/x")], "valueID int, value string"), spark.createDataFrame([(1, "title"), (2, "DOI")], "fieldID int, fieldName string")
    names = ["title", "DOI", "date", "publicationTitle", "conferenceName", "abstractNote"]
    wide = readers.library_items(items, data, values, fields, spark.createDataFrame([(2,)], "itemID int"), names)
    who = readers.library_authors(spark.createDataFrame([(1, 10, 1, 1), (1, 11, 1, 0)], "itemID int, creatorID int, creatorTypeID int, orderIndex int"), spark.createDataFrame([(10, "Jones", "B"), (11, "Smith", "A")], "creatorID int, lastName string, firstName string"), spark.createDataFrame([(1, "author")], "creatorTypeID int, creatorType string"))
    files = readers.library_attachments(spark.createDataFrame([(1, "AK", "application/pdf", "storage:a.pdf")], "parentItemID int, key string, contentType string, path string"), "/z/storage")
    r = readers.library_papers(wide, who, files).collect()
    assert len(r) == 1 and r[0]["authors"] == ["Smith, A", "Jones, B"] and r[0]["pdf_path"] == "/z/storage/AK/a.pdf" and r[0]["doi"] == "10.1/x"


def test_exports(spark, tmp_path):
    p = spark.createDataFrame([("doi:10.1/x", "10.1/x", "T", ["A", "B"], 2020, "J", None, "review", 0.5, "f.pdf", None)], "paper_id string, doi string, title string, authors array<string>, year int, venue string, abstract string, triage_decision string, triage_score double, pdf_path string, pdf_sha256 string")
    assert p.select(sinks.ris_text()).first()[0] == "TY  - JOUR\nTI  - T\nAU  - A\nAU  - B\nPY  - 2020\nJO  - J\nDO  - 10.1/x\nER  - \n"
    sinks.export_csv(p, str(tmp_path / "csv"), ["doi", "authors"])
    assert spark.read.csv(str(tmp_path / "csv"), header=True).first()["authors"] == "A; B"
    b = sinks.bundle_records(p).first()
    assert b["bundle"] == "job_doi_10_1_x" and json.loads(b["payload"])["title"] == "T" and b["problems"] == []
    assert spark.read.parquet(sinks.write_snapshot(p, str(tmp_path / "snap"))).count() == 1


def test_bundles_are_packed_and_found_by_name(spark, tmp_path):
    path, odd = str(tmp_path / "bundles"), ["doi:10.1/ä", 'doi:"q"\n', "doi:10.1/Ä ", "x" * 120]
    ids = spark.createDataFrame([(i,) for i in [*odd, *(f"p{k}" for k in range(2 * sinks.SHARDS))]], "paper_id string")
    p = ids.select("paper_id", F.lit(None).cast("string").alias("doi"), F.concat(F.lit("T\n"), "paper_id").alias("title"), F.array(F.lit("A")).alias("authors"), F.lit(2000).alias("year"), F.lit("V").alias("venue"), F.lit("a").alias("abstract"), F.lit("review").alias("triage_decision"), F.lit(0.5).alias("triage_score"), F.when(F.col("paper_id") != "p7", "/x.pdf").alias("pdf_path"), F.lit("s").alias("pdf_sha256"))
    sinks.write_bundles(p, path)
    want = {r["bundle"]: r["payload"] for r in sinks.bundle_records(p).where("paper_id <> 'p7'").collect()}
    assert len(list((tmp_path / "bundles").glob("**/*.json"))) <= sinks.SHARDS < len(want) == ids.count() - 1
    assert sorted(map(tuple, readers.read_job_bundles(spark, path).collect())) == sorted(want.items())
    asked = ["job_p3", "job_p7", *(n for n in want if not n.startswith("job_p"))]
    some = readers.read_job_bundles(spark, path, asked)
    assert {r["bundle"]: r["payload"] for r in some.collect()} == {n: want[n] for n in asked if n in want} and len(want) > some.count() == len(asked) - 1
    assert "PartitionFilters: [shard" in some._jdf.queryExecution().executedPlan().toString()
    sinks.write_bundles(p.where("paper_id = 'p3'"), path)
    assert readers.read_job_bundles(spark, path, ["job_p3"]).count() == 2
    sinks.write_bundles(p.limit(0), str(tmp_path / "none"))
    assert readers.read_job_bundles(spark, str(tmp_path / "none")).count() == 0 == readers.read_job_bundles(spark, str(tmp_path / "none"), ["job_p3"]).count()


def test_embedding_cache(spark, tmp_path):
    import pandas as pd

    def provider(parts):
        for pdf in parts:
            yield pd.DataFrame({"key": pdf["key"], "embedding": [[float(len(t))] for t in pdf["text"]]})

    texts = spark.createDataFrame([("a",), ("bb",)], "text string")
    for _ in range(2):
        got = sinks.with_embeddings(texts, str(tmp_path / "cache"), "m", provider, spark)
        assert sorted(r["embedding"][0] for r in got.collect()) == [1.0, 2.0]
    assert spark.read.parquet(str(tmp_path / "cache")).count() == 2


def test_streams(spark, sf, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.pdf").write_bytes(b"x")
    sink = incremental.write_batches(str(tmp_path / "out"))
    for _ in range(2):  # the second run finds nothing new
        incremental.available_now(incremental.inbox(spark, str(inbox)), sink, str(tmp_path / "cp"))
    (inbox / "b.pdf").write_bytes(b"y")
    incremental.available_now(incremental.inbox(spark, str(inbox)), sink, str(tmp_path / "cp"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    events = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    for k, counted in enumerate((incremental.windowed(stream, "ts", size="1 day", late="1 hour", keys=["event_type"]), incremental.sessions(stream, "ts", "user_id", gap="6 hours", late="1 hour"))):
        got = incremental.to_the_end(counted, str(tmp_path / f"state{k}"), str(tmp_path / f"progress{k}"))
        assert got.agg(F.sum("n")).first()[0] == events.count()
