from pyspark.sql import functions as F

from corpusloom import config
from corpusloom import schemas as V
from corpusloom.operators import ingest, taxonomy
from corpusloom.plans import discovery


def rows(df, key):
    return {r[key]: r.asDict() for r in df.collect()}


def test_config():
    base = {"triage": {"send": 0.7, "on": True}, "name": "x"}
    out = config.with_environment(config.merged(base, {"triage": {"review": 0.4}}), environ={"CORPUSLOOM_TRIAGE__SEND": "0.8", "CORPUSLOOM_TRIAGE__ON": "false", "OTHER": "1", "CORPUSLOOM_MAX_ROWS": "5"})
    assert out == {"triage": {"send": 0.8, "on": False, "review": 0.4}, "name": "x", "max_rows": "5"} and base["triage"]["send"] == 0.7
    assert config.get(out, "triage.review") == 0.4 and config.get(out, "triage.none", 1) == 1


def test_best_candidates(spark):
    r = spark.createDataFrame([("a", "Built environment and stress", "Smith", 2021), ("b", "Environmental stress and cognition", None, 2020)], "id string, title string, author string, year int")
    c = spark.createDataFrame([("a", "Built environment and stress", ["J. Smith"], 2021, "10.1000/good", "<p>x</p>"), ("a", "Unrelated", [], 2015, None, None), ("b", "Marine ecosystems and coral bleaching", [], 2020, None, None)], "id string, title string, authors array<string>, year int, doi string, abstract string")
    got = rows(ingest.best_candidates(r, c), "id")
    assert set(got) == {"a"} and got["a"]["doi"] == "10.1000/good" and got["a"]["match_score"] >= 0.8 and got["a"]["abstract"] == "x"


def test_resolve_and_drain(spark):
    k = "doi string, title string, year int"
    got = rows(ingest.resolved(spark.createDataFrame([("1", " ", 2000), ("2", "T", None)], k), spark.createDataFrame([("1", "U", 1999), ("3", "V", 1)], k), "doi", ["title", "year"]), "doi")
    assert (got["1"]["title"], got["1"]["year"], got["2"]["title"], got["3"]["title"]) == ("U", 2000, "T", "V")
    q = spark.createDataFrame([(x,) for x in "abcde"], "paper_id string")
    p = spark.createDataFrame([("a", "t", None, None), ("b", "", None, None), ("c", "t", None, None), ("d", "t", "have", "10.1/x")], "paper_id string, title string, abstract string, doi string")
    f = spark.createDataFrame([("a", "new", None), ("d", "new", "10.1/x")], "paper_id string, abstract string, doi string")
    got = {k: (v["status"], v["reason"]) for k, v in rows(ingest.drained(q, p, f), "paper_id").items()}
    assert got == {"a": ("fetched", None), "b": ("rejected", "missing_title"), "c": ("not_found", "no_match"), "d": ("not_found", "no_new_data"), "e": ("rejected", "paper_missing")}


def test_library_and_files(spark):
    papers = spark.createDataFrame([("p1", "10.1/x", "Daylight effects", ["Smith, J."], 1), ("p2", None, "Noise at work", [], 2)], "paper_id string, doi string, title string, authors array<string>, seq int")
    items = spark.createDataFrame([(1, "https://doi.org/10.1/X", "?"), (2, None, "Noise, at work!"), (3, None, "New")], "item_id int, doi string, title string")
    assert {k: (v["paper_id"], v["basis"]) for k, v in rows(ingest.match_library(items, papers), "item_id").items()} == {1: ("p1", "doi"), 2: ("p2", "title"), 3: (None, "none")}
    known = papers.withColumnRenamed("paper_id", "known_id")
    got = rows(ingest.match_files(spark.createDataFrame([("in/Smith_2020_Daylight_Effects.pdf",), ("in/zzz.pdf",)], "path string"), known), "path")
    assert got["in/Smith_2020_Daylight_Effects.pdf"]["known_id"] == "p1" and got["in/zzz.pdf"]["known_id"] is None
    new = ingest.imported(spark.createDataFrame([("p1",), ("n1",), ("n2",), ("n3",)], "paper_id string"), papers, spark.createDataFrame([("n1", 0.9, "send_to_eater"), ("n2", 0.1, "reject")], "paper_id string, triage_score double, decision string"))
    assert {k: v["status"] for k, v in rows(new, "paper_id").items()} == {"n1": "candidate", "n2": "rejected", "n3": "pending_scorer"}


def test_queues_and_passes(spark):
    q = spark.createDataFrame([("doi:10.1/x", 2), ("doi:10.1/y", 1)], "paper_id string, priority int")
    b = spark.createDataFrame([("job_doi_10_1_x",)], "bundle string")
    assert [r["paper_id"] for r in ingest.due_jobs(q, b).collect()] == ["doi:10.1/x"]
    t = spark.createDataFrame([("Light at work",), ("coral reef light",), ("",)], "t string")
    got = ingest.keyword_passes(t, F.col("t"), [("off_topic", ["coral"]), ("on_topic", ["light"])], default="needs_abstract")
    assert [r["topic_decision"] for r in got.collect()] == ["on_topic", "off_topic", "needs_abstract"]
    assert ingest.outcome_counts(spark.createDataFrame([("a",), ("a",), ("b",)], "outcome string"), ["a", "b", "c"]).first().asDict() == {"total": 3, "a": 2, "b": 1, "c": 0}
    assert set(r["batch"] for r in ingest.in_batches(spark.range(100), "id", 25).collect()) <= set(range(4))


def test_discovery(spark):
    nodes = spark.createDataFrame(taxonomy.flatten_tree({"environmental_factors": [{"id": "env.air"}], "outcomes": [{"id": "out.mood"}]}), V.FACET_NODES)
    cent = spark.createDataFrame([("env.air", "environmental_factors", 1, [1.0, 0.0]), ("out.mood", "outcomes", 1, [0.0, 1.0])], "node_id string, facet_id string, level int, centroid array<double>")
    k = "array<struct<id:string,role:string,direction:string>>"
    tables = {
        "taxonomy": nodes, "nodes": cent, "vectors": spark.createDataFrame([("p1", [1.0, 1.0]), ("p2", [1.0, 0.0])], "paper_id string, embedding array<float>"),
        "papers": spark.createDataFrame([("p1", "10.1/a", "One")], "paper_id string, doi string, title string"), "rows": spark.createDataFrame([("p2", None, "Two"), ("p1", "10.1/x", "Again")], "paper_id string, doi string, title string"),
        "citations": spark.createDataFrame([("p1", "10.1/A", "t", 1), ("p1", "10.1/b", "u", 2)], "source_paper_id string, cited_doi string, cited_title string, seq int"), "files": spark.createDataFrame([], "path string"),
        "queue": spark.createDataFrame([], "doi string, discovery_count int, priority_score double, title string, discovered_from string"),
        "claims": spark.createDataFrame([], f"claim_id string, paper_id string, claim_type string, statement string, environment_factors {k}, outcomes {k}, moderators {k}"),
    }
    tables["papers"] = tables["papers"].withColumn("pdf_path", F.lit(None).cast("string"))
    tables["rows"] = tables["rows"].withColumn("pdf_path", F.lit(None).cast("string"))
    run = discovery.discover(tables, extra=[discovery.Phase("broken", lambda t: {"x": t["missing"]}, ("papers",), ("x",))])
    got = rows(run.report(spark), "phase")
    assert got["broken"]["state"] == "failed" and got["broken"]["error"].startswith("KeyError")
    assert {p.name: got[p.name]["state"] for p in discovery.PHASES} == {p.name: "done" for p in discovery.PHASES}, got
    assert {n: got[n]["rows"] for n in ("import", "classify", "expand", "acquire", "gaps")} == {"import": 2, "classify": 2, "expand": 1, "acquire": 1, "gaps": 1}
    assert rows(run.tables["coverage"], "factor_id")["env.air"]["paper_count"] == 1 and run.tables["targets"].count() == 1

    del tables["vectors"]
    again = discovery.discover(tables | {"triaged": run.tables["triaged"], "scores": run.tables["scores"]})  # stale tables of an earlier run
    got = rows(again.report(spark), "phase")
    assert got["classify"]["state"] == "skipped" and got["bundle"]["state"] == "skipped" and got["gaps"]["state"] == "skipped" and got["expand"]["state"] == "done" and "scores" not in again.tables
