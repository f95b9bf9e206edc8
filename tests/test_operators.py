import math

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas as V
from corpusloom.functions import normalize as N
from corpusloom.operators import audit, dedup, expansion, gaps, graph, merge, nlquery, synthesis, taxonomy, vector


def rows(df, *keys):
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[k]) for k in keys)) if keys else out


def test_inventory_match(spark):
    papers = spark.createDataFrame([("af-1", "10.1234/abc", "Thermal comfort and stress", 2019), ("af-2", "", "Daylight and alertness", 2020), ("af-3", "10.9999/miss", "Unmatched paper", 2022)], "paper_id string, doi string, title string, year int")
    reg = [("PDF-0001", "Daylight and alertness", 2020, ""), ("PDF-0002", "Thermal comfort and stress", 2019, "10.1234/abc")]
    kind = "paper_id string, title string, year int, doi string"
    a, b, c = rows(dedup.match_inventory(papers, spark.createDataFrame(reg, kind)), "paper_id")
    assert (a["match_status"], a["match_basis"], a["match_paper_id"], a["match_confidence"]) == ("matched", "exact_doi", "PDF-0002", 1.0)
    assert (b["match_status"], b["match_basis"], b["match_paper_id"], b["match_confidence"]) == ("matched", "exact_title_year", "PDF-0001", 0.98)
    assert (c["match_status"], c["match_basis"], c["match_paper_id"], c["n_candidates"]) == ("unmatched", "none", None, 0)
    more = dedup.match_inventory(papers, spark.createDataFrame([*reg, ("PDF-0003", "Daylight and alertness", 2020, "")], kind))
    b = rows(more, "paper_id")[1]
    assert (b["match_status"], b["match_confidence"], b["n_candidates"]) == ("ambiguous", None, 2)
    n = rows(dedup.match_counters(more))[0]
    assert (n["matched"], n["ambiguous"], n["unmatched"], n["matched_exact_doi"]) == (1, 1, 1, 1)


def test_inventory(spark):
    reg = spark.createDataFrame([("a", "T a", 2000, ""), ("b", "T b", 2001, "10.1/b")], "paper_id string, title string, year int, doi string")
    sup = spark.createDataFrame([("b",)], "superseded_paper_id string")
    titles = spark.createDataFrame([("a", "10.1/a", "Title A", 2000)], "paper_id string, doi string, title_authoritative string, publication_year int")
    assert rows(dedup.inventory(reg, sup, spark.createDataFrame([("a", True)], "paper_id string, is_canonical boolean"), titles)) == [{"paper_id": "a", "title": "Title A", "year": 2000, "doi": "10.1/a"}]


def test_duplicate_cascade(spark):
    known = spark.createDataFrame([("k1", "10.1/a", "Daylight and cognitive performance in open offices", ["Smith, J."], 1), ("k2", None, "Noise annoyance", ["Jones, B."], 2)], "known_id string, doi string, title string, authors array<string>, seq int")
    new = spark.createDataFrame([("n1", "10.1/A", "x", []), ("n2", None, "Cognitive performance and daylight, in open offices", []), ("n3", None, "Daylight and cognitive performances in open office", ["Smith, A."]), ("n4", None, "Annoyance of workers by loud noise", ["Jones, C."]), ("n5", None, "Nothing alike", [])], "new_id string, doi string, title string, authors array<string>")
    got = {r["new_id"]: (r["known_id"], r["match_type"]) for r in rows(dedup.check_duplicates(new, known))}
    assert got["n1"] == ("k1", "doi") and got["n2"] == ("k1", "title_exact") and got["n3"] == ("k1", "title_fuzzy") and got["n4"] == ("k2", "author_title") and got["n5"] == (None, None)


def test_merge(spark):
    paper = "struct<doi:string,title:string,authors:array<string>,abstract:string,year:int,venue:string,url:string,publisher:string,sources:array<string>,pdf_path:string>"
    old = ("10.1234/test", "Short Title", ["Smith"], None, None, None, None, None, None, None)
    new = ("10.1234/test", "Much Longer and More Descriptive Title", ["Smith", "Jones"], "This is the abstract.", 2020, None, None, None, None, None)
    m = rows(spark.createDataFrame([(old, new)], f"o {paper}, n {paper}").select(*[c.alias(k) for k, c in merge.merged_paper("o", "n").items()]))[0]
    assert m["title"].startswith("Much") and m["authors"] == ["Smith", "Jones"] and m["abstract"] and m["year"] == 2020


def test_counting_upsert(spark):
    queue = spark.createDataFrame([], "doi string, discovery_count int, priority_score double, title string, discovered_from string")
    seen = spark.createDataFrame([("d1", 0.5, 1, "t1", "a"), ("d1", 0.9, 2, "t2", "b"), ("d1", 0.3, 3, "t3", "c"), ("d2", 0.4, 4, "t4", "d")], "doi string, priority_score double, seq int, title string, discovered_from string")
    got = merge.counting_upsert(queue, seen, "doi", count="discovery_count", priority="priority_score", order="seq", first=["title", "discovered_from"])
    assert [tuple(r.values()) for r in rows(got, "doi")] == [("d1", 3, 0.9, "t1", "a"), ("d2", 1, 0.4, "t4", "d")]
    again = merge.counting_upsert(got, seen.limit(0).unionByName(seen.where("seq = 2")), "doi", count="discovery_count", priority="priority_score", order="seq", first=["title", "discovered_from"])
    assert rows(again, "doi")[0]["discovery_count"] == 4 and rows(again, "doi")[0]["title"] == "t1"


def test_upsert_keeps_columns(spark):
    cur = spark.createDataFrame([("p", "t", 1.0)], "id string, title string, score double")
    new = spark.createDataFrame([("p", None, 2.0, 1), ("q", "u", None, 2)], "id string, title string, score double, seq int")
    assert [tuple(r.values()) for r in rows(merge.upsert(cur, new, "id", "seq"), "id")] == [("p", "t", 2.0), ("q", "u", None)]


def test_insert_ignore_and_fill(spark):
    cur, new = spark.createDataFrame([("a", 1)], "k string, v int"), spark.createDataFrame([("a", 2), ("b", 4), ("b", 3), (None, 5), (None, 6)], "k string, v int")
    assert [r["v"] for r in rows(merge.insert_ignore(cur, new, ["k"], ["v"]), "v")] == [3, 5, 6]
    df = spark.createDataFrame([("a", " ", None)], "k string, abstract string, year int")
    got = rows(merge.fill_missing(df, spark.createDataFrame([("a", "text", 2000)], "k string, abstract string, year int"), "k", ["abstract", "year"]))[0]
    assert got["abstract"] == "text" and got["year"] == 2000 and got["fields_added"] == ["abstract", "year"]


def test_triage(spark):
    f = spark.createDataFrame([("a", "environmental_factors", 0.8), ("a", "outcomes", 0.6), ("a", "settings", 0.5), ("a", "theory", 0.3), ("b", "environmental_factors", 0.9)], "id string, facet_id string, score double")
    a, b = rows(taxonomy.triage(f, "id"), "id")
    assert math.isclose(a["triage_score"], 0.61) and a["decision"] == "review" and math.isclose(b["triage_score"], 0.315) and b["decision"] == "reject"


def test_domain_and_promotion(spark):
    s = spark.createDataFrame([("a", "n", "f", 3, 0.66), ("b", "n", "f", 2, 0.69), ("c", "n", "f", 2, 0.99)], "id string, node_id string, facet_id string, level int, score double")
    d = spark.createDataFrame([("a", 0.5), ("b", 0.5), ("c", 0.2)], "id string, domain_score double")
    assert [r["decision"] for r in rows(taxonomy.domain_decision(s, d, "id"), "id")] == ["send_to_eater", "review", "reject"]
    m = spark.createDataFrame([("review", "send_to_eater"), ("send_to_eater", "reject"), ("pending", "reject")], "a string, b string").select(taxonomy.merge_decision(F.col("a"), F.col("b")).alias("m"))
    assert [r["m"] for r in m.collect()] == ["send_to_eater", "send_to_eater", "reject"]


def test_question_gate(spark):
    df = spark.createDataFrame([("natural environments improve directed attention; participants did an attention task",), ("forest bathing reduces stress",), ("coral reefs",)], "t string")
    arr = lambda *x: F.array(*map(F.lit, x))
    v = taxonomy.question_verdict(*[taxonomy.question_hits(F.col("t"), arr(*ts)) for ts in (["natural environment", "forest"], ["attention", "stress"], ["attention task"], ["coral"])])
    assert [r[0] for r in df.select(taxonomy.verdict_decision(v)).collect()] == ["send_to_eater", "review", "reject"]


def test_tree(spark):
    nodes = spark.createDataFrame(taxonomy.flatten_tree({"env": [{"id": "env.air", "name": "Air", "seeds": ["air"], "children": [{"id": "env.air.co2", "name": "CO2"}]}, {"id": "env.airflow", "name": "Flow"}]}), V.FACET_NODES)
    assert {r["node_id"] for r in rows(taxonomy.subtree(nodes, "env.air"))} == {"env.air", "env.air.co2"}
    own = spark.createDataFrame([("env.air", [1.0, 0.0])], "node_id string, centroid array<double>")
    got = {r["node_id"]: r["centroid"] for r in rows(taxonomy.hierarchical_centroids(nodes, own))}
    assert got["env.air.co2"] == [1.0, 0.0] and "env.airflow" not in got


def test_relevance_gate(spark):
    df = spark.createDataFrame([(0.6, 1), (0.2, 1), (0.5, 2), (0.8, 3)], "s double, d int")
    g = lambda t: df.select(expansion.gate(F.col("s"), F.col("d"), F.lit("x"), F.lit(None).cast("array<struct<facet:string,score:double>>"), threshold=t).alias("g")).select("g.*").collect()
    high, low, shallow, deep = g(0.4)
    assert high["ok"] and not low["ok"] and "threshold" in low["reason"] and shallow["ok"] and not deep["ok"] and "depth" in deep["reason"]


def _claims(spark):
    c = lambda *ids: [(i, i.split(".")[-1], None) for i in ids]
    base = [("c1", "p1", "causal", "daylight improves mood", c("env.day"), c("out.mood"), 0.5), ("c2", "p1", "causal", "daylight reduces mood", c("env.day", "env.noise"), c("out.mood"), -0.3), ("c3", "p2", "null", "no effect", c("env.day"), c("out.mood", "out.sleep"), None)]
    k = "array<struct<id:string,role:string,direction:string>>"
    df = spark.createDataFrame(base, f"claim_id string, paper_id string, claim_type string, statement string, environment_factors {k}, outcomes {k}, effect double")
    none = F.array().cast(k)
    return df.withColumn("mediators", none).withColumn("moderators", none)


def test_graph_and_synthesis(spark):
    claims, papers = _claims(spark), spark.createDataFrame([("p1", "One"), ("p2", "Two")], "paper_id string, title string")
    edges, nodes = graph.edges(papers, claims), graph.nodes(papers, claims)
    n = {r["type"]: r["n"] for r in rows(graph.graph_stats(nodes, edges)) if r["kind"] == "edge"}
    assert (n["about_iv"], n["about_dv"], n["affects"], n["has_claim"]) == (4, 4, 5, 3)
    got = {r["src"]: r for r in rows(graph.what_affects(edges.where("type = 'affects'"), claims.select("claim_id", "effect"), F.col("dst") == "out.mood"))}
    assert got["env.day"]["claim_count"] == 3 and math.isclose(got["env.day"]["avg_effect"], 0.1) and math.isclose(got["env.noise"]["avg_effect"], -0.3)
    s = rows(synthesis.synthesise(claims.withColumn("key", F.lit("env.day")), "key"))[0]
    assert (s["n_claims"], s["n_with_effect"], s["n_positive"], s["n_negative"], s["n_null"], s["overall"], s["heterogeneity"]) == (3, 2, 1, 1, 1, "mixed", "low")
    assert math.isclose(s["pooled_effect"], 0.1) and math.isclose(s["pooled_se"], math.sqrt(0.5)) and math.isclose(s["q_statistic"], 0.32) and s["i_squared"] == 0 and round(s["ci_lower"], 4) == -1.2859
    way = claims.withColumn("key", F.lit("k")).withColumn("way", synthesis.direction(F.col("claim_type"), F.col("statement")))
    kinds = [r["type"] for r in rows(synthesis.contradictions(way, "key", "claim_id", "way"))]
    assert sorted(kinds) == ["direction_conflict", "effect_vs_null", "effect_vs_null"]
    corpus = nlquery.Corpus(nodes, edges, claims.select("claim_id", "claim_type", "statement", "effect"))
    kind, construct, df = nlquery.answer(corpus, "What affects mood?")
    assert (kind, construct) == ("what_affects", "mood") and {r["src"] for r in rows(df)} == {"env.day", "env.noise"}
    assert sum(r["n"] for r in rows(nlquery.answer(corpus, "how many claims about day")[2])) == 3
    assert len(rows(nlquery.answer(corpus, "contradictory claims about day")[2])) == 3


def test_coverage(spark):
    one = spark.range(1)
    score = lambda p, c, m, n: one.select(gaps.coverage_score(F.lit(p), F.lit(c), F.lit(m), F.lit(n))).first()[0]
    assert math.isclose(score(4, 2, True, False), 0.43) and score(0, 0, False, False) == 0.0 and math.isclose(score(20, 9, True, True), 1.0)
    q = one.select(gaps.coverage_queries(F.array(*map(F.lit, "abcd")), F.array(F.lit("x"), F.lit("y"), F.lit("z")))).first()[0]
    assert len(q) == 8 and q[0] == '"a" AND "x"' and q[-1] == '"a" indoor environment effect'
    assert one.select(gaps.priority(F.lit("env.air.co2"), F.lit("out.cognitive.memory"))).first()[0] == "HIGH"
    up = {r["query"]: r["gap_type"] for r in rows(gaps.follow_up_queries(_claims(spark)))}
    assert up['"day" mechanism "mood" pathway'] == "mechanism" and '"biophilia" empirical test evidence' in up


def test_expand(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (2, 1)], "src int, dst int")
    got = {r["node"]: r["depth"] for r in rows(expansion.expand(e, spark.createDataFrame([(1,)], "node int"), max_depth=2))}
    assert got == {1: 0, 2: 1, 3: 2}


def test_near_pairs_equal_brute_force(spark, sf):
    import numpy as np

    e = spark.read.parquet(f"{sf}/embeddings.parquet").limit(200)
    pdf = e.toPandas()
    v = np.array(pdf.embedding.tolist(), np.float64)
    v /= np.linalg.norm(v, axis=1)[:, None]
    sim, ids, lab = v @ v.T, pdf.vec_id.to_numpy(), pdf.label.to_numpy()
    want = {tuple(sorted((ids[i], ids[j]))) for i in range(len(v)) for j in range(i) if sim[i, j] >= 0.35 and lab[i] != lab[j]}
    for tile in (30, 4096):
        got = rows(vector.near_pairs(e, id_col="vec_id", least=0.35, differ="label", tile_rows=tile))
        assert len(got) == len(want) and {(r["id_a"], r["id_b"]) for r in got} == want


def test_file_integrity(spark):
    papers = spark.createDataFrame([("p1", "data/good.pdf", "x"), ("p2", "data/missing.pdf", "1"), ("p3", "data/bad.pdf", "x")], "paper_id string, pdf_path string, pdf_sha256 string")
    files = spark.createDataFrame([("data/good.pdf", "x"), ("data/bad.pdf", "y"), ("data/pdfs/orphan.pdf", "z")], "path string, sha256 string")
    assert rows(audit.file_integrity(papers, files)) == [{"missing_pdf_path_files": 1, "pdf_sha256_mismatch_rows": 1, "duplicate_pdf_sha_rows": 1, "orphan_pdf_files": 1}]


STATE = "paper_id string, status string, triage_decision string, ae_job_path string, ae_output_path string, ae_status string, ae_n_claims int, ae_n_rules int, ae_confidence double, human_notes string"


def test_semantic_state_and_repair(spark):
    papers = spark.createDataFrame([("p_valid", "candidate", "pending", None, None, None, None, None, None, None), ("p_deprecated", "candidate", "needs_review", None, None, None, None, None, None, None), ("p_stale_pending", "candidate", "review", "job1", "out1", "pending", None, None, None, None), ("p_stale_success", "candidate", "send_to_eater", "job2", None, "SUCCESS", 4, 1, 0.5, None)], STATE)
    results = spark.createDataFrame([("out1", "PARTIAL_SUCCESS", 1, 2, 0.25)], "ae_output_path string, status string, n_claims int, n_rules int, confidence double")
    m = rows(audit.semantic_integrity(papers, results))[0]
    assert (m["deprecated_triage_rows"], m["ae_pending_with_output_rows"], m["ae_result_status_mismatch_rows"], m["ae_terminal_without_output_rows"]) == (1, 1, 1, 1)
    fixed = audit.repaired_state(papers, results)
    got = {r["paper_id"]: r for r in rows(fixed)}
    assert got["p_deprecated"]["triage_decision"] == "review" and got["p_stale_pending"]["ae_status"] == "PARTIAL_SUCCESS" and got["p_stale_pending"]["ae_n_rules"] == 2
    assert got["p_stale_success"]["ae_status"] == "pending" and got["p_stale_success"]["ae_n_claims"] is None and got["p_stale_success"]["human_notes"]
    assert rows(audit.repaired_state(fixed, results), "paper_id") == rows(fixed, "paper_id")
    assert rows(audit.changed_rows(papers, fixed, "paper_id"))[0]["triage_decision"] == 1


def test_json_and_schema_audits(spark):
    p = spark.createDataFrame([("t", "[1]", "{}", 1, 0.5), ("", "x", "[]", 2, 1.5)], "core string, l string, p string, b int, u double")
    assert rows(audit.classification_integrity(p, core=["core"], lists=["l"], payload="p", booleans=["b"], units=["u"])) == [{"classified_rows": 2, "missing_core_rows": 1, "bad_l_rows": 1, "bad_payload_rows": 1, "bad_boolean_rows": 1, "bad_confidence_rows": 1}]
    assert [r["ok"] for r in rows(audit.schema_drift(p, {"core": "string", "b": "bigint"}), "column")] == [False, True, False, False, False]
    assert rows(audit.invalid_transitions(spark.createDataFrame([("a", 1, "candidate"), ("a", 2, "rejected"), ("a", 3, "candidate")], "k string, o int, s string"), "k", "o", "s", V.STATUS_TRANSITIONS))[0]["o"] == 3


@pytest.mark.parametrize("empty", [True, False])
def test_conflicts(spark, empty):
    df = spark.createDataFrame([] if empty else [("s", 0.9, "a"), ("s", 0.5, "b"), ("u", 0.1, "c"), ("u", 0.1, "d"), ("w", 0.5, "e"), ("w", 0.49, "f"), ("w", 0.1, "g")], "sha string, score double, id string")
    got = {r["sha"]: r["keep_id"] for r in rows(dedup.conflict_winner(df, "sha", "score", "id"))}
    assert got == ({} if empty else {"s": "a", "u": None, "w": None})


def test_title_lookup_equals_brute_force(spark):
    import difflib
    import random

    r = random.Random(5)
    vocabulary = [f"{a}{b}" for a in ("light", "sound", "space", "focus", "stress") for b in ("", "ing", "wards", "fulness", "ometry", "scape")]
    titles = [" ".join(r.choice(vocabulary[:8] if r.random() < 0.5 else vocabulary) for _ in range(r.randrange(0, 7))) for _ in range(120)] + ["light", "", "of the"]
    names = ["Smith, A.", "Jones, B.", "Miller, C."]
    data = [(i, t, r.sample(names, r.randrange(0, 3))) for i, t in enumerate(titles)]
    df = spark.createDataFrame(data, "new_id long, title string, authors array<string>").cache()
    known = df.withColumnRenamed("new_id", "known_id")
    terms = {x["new_id"]: (x["t"], x["k"].split(" "), x["k"], x["a"]) for x in df.select("new_id", N.key_terms(F.col("title")).alias("t"), N.title_key(F.col("title")).alias("k"), N.surnames(F.col("authors")).alias("a")).collect()}
    want = {(i, j): len(set(t) & set(terms[j][1])) for i, (t, *_) in terms.items() for j in terms if i != j and t and len(set(t) & set(terms[j][1])) >= min(2, len(t))}
    assert {(x["new_id"], x["known_id"]): x["shared"] for x in dedup.fuzzy_title_pairs(df, known, others_only=True).collect()} == want

    best = {}
    for (i, j), shared in want.items():
        score = difflib.SequenceMatcher(None, terms[i][2], terms[j][2]).ratio() + 0.1 * min(3, len(set(terms[i][3]) & set(terms[j][3])))
        if score >= 0.85:
            best[i] = min(best.get(i, (0, 0, 10**9)), (-score, -shared, j))
    got = {x["new_id"]: (x["known_id"], x["confidence"]) for x in dedup.fuzzy_title_matches(df, known, others_only=True).collect()}
    assert got.keys() == best.keys() and len(got) > 10
    assert all(got[i][0] == j and abs(got[i][1] - (-s if -s >= 0.95 else -s * 0.9)) < 1e-9 for i, (s, _, j) in best.items())

    close = {}
    for i, t, a in data:
        for j in terms:
            mine, theirs = terms[i], terms[j]
            by_author, by_term = (len(set(mine[k]) & set(theirs[k])) / len(mine[k]) if mine[k] else 0.0 for k in (3, 0))
            if len(t) < 50 and by_author >= 0.5 and by_term >= 0.4:
                close[i] = min(close.get(i, (0, 10**9)), (-0.7 * (by_author + by_term) / 2, j))
    got = {x["new_id"]: (x["confidence"], x["known_id"]) for x in dedup.author_title_matches(df, known).collect()}
    assert got.keys() == close.keys() and all(abs(got[i][0] + s) < 1e-9 and got[i][1] == j for i, (s, j) in close.items())


def test_narrow_rows_of_one_task_are_dealt_out(spark):
    from corpusloom.operators.sized import TASK_ROWS, spread

    one = spark.range(0, 3 * TASK_ROWS + 1, 1, 1)
    assert one.rdd.getNumPartitions() == 1 and spread(one).rdd.getNumPartitions() == 4
    assert spread(one).distinct().count() == one.count() and spread(one.limit(0)).count() == 0


def test_constructs_and_edges_without_meeting_papers(spark):
    kind = "array<struct<id:string,role:string,direction:string>>"
    one = lambda *c: [(i, r, None) for i, r in c]
    claims = spark.createDataFrame([("c2", "p1", one(("x", "late"), (None, "own")), one(("y", "mood")), "causal", "it will increase", 0.5), ("c1", "p9", one(("x", "early")), one(("y", "mood")), "null", "s1", None), ("c3", "p1", one(("", None)), None, "causal", "s3", 1.0)], f"claim_id string, paper_id string, environment_factors {kind}, outcomes {kind}, claim_type string, statement string, effect double").withColumns({c: F.array().cast(kind) for c in ("mediators", "moderators")})
    papers = spark.createDataFrame([("p1", "t")], "paper_id string, title string")
    assert {(r["node_id"], r["label"]) for r in rows(graph.nodes(papers, claims)) if r["type"] == "construct"} == {("x", "early"), ("y", "mood"), ("construct:own", "own")}
    whole, some = graph.edges(papers, claims), graph.edges(papers, claims, kinds=("about_iv", "affects"), carry=nlquery.CARRIED)
    assert "Join" not in some._jdf.queryExecution().optimizedPlan().toString()
    key = lambda r: (r["src"], r["dst"], r["type"], r["claim_id"])
    assert sorted(map(key, rows(some))) == sorted(key(r) for r in rows(whole) if r["type"] in ("about_iv", "affects"))
    narrow = claims.select("claim_id", *nlquery.CARRIED)
    for question in ("What affects y?", "What does x affect?", "How many claims about x?", "Show all claims about x", "Are there contradictions about y?"):
        corpora = [nlquery.Corpus(graph.nodes(papers, claims), graph.edges(papers, claims, carry=carry), narrow) for carry in ((), nlquery.CARRIED)]
        plain, carried = (rows(nlquery.answer(c, question)[2]) for c in corpora)
        assert sorted(map(str, plain)) == sorted(map(str, carried)) and plain, question


def test_all_contradictions_beyond_the_page(spark):
    way = ["positive"] * 70 + ["negative"] * 60 + ["null"] * 9 + ["unknown"] * 5
    told = [(f"c{i:03}", "p", "null" if w == "null" else "causal", {"positive": "will increase", "negative": "may reduce"}.get(w, "meets"), 0.1) for i, w in enumerate(way)]
    k = "array<struct<id:string,role:string,direction:string>>"
    claims = spark.createDataFrame(told, "claim_id string, paper_id string, claim_type string, statement string, effect double").withColumns({c: F.array().cast(k) for c in ("outcomes", "mediators", "moderators")})
    claims = claims.withColumn("environment_factors", F.array(F.struct(F.lit("day").alias("id"), F.lit("r").alias("role"), F.lit("d").alias("direction"))).cast(k))
    papers = spark.createDataFrame([("p", "t")], "paper_id string, title string")
    corpus = nlquery.Corpus(graph.nodes(papers, claims), graph.edges(papers, claims), claims.select("claim_id", *nlquery.CARRIED))
    question = "Are there contradictions about day?"
    got = rows(nlquery.answer(corpus, question, whole=True)[2])
    n = {"positive": (60, 9), "negative": (70, 9), "null": (0, 130)}
    assert sorted((r["claim_id"], r["way"], r["n_conflicts"], r["n_against_null"]) for r in got) == [(f"c{i:03}", w, *n[w]) for i, w in enumerate(way) if w in n]
    assert len(rows(nlquery.answer(corpus, "Show all claims about day", whole=True)[2])) == len(way) > len(rows(nlquery.answer(corpus, "Show all claims about day")[2])) == 50
    d = spark.createDataFrame([(1, 1, "positive"), (1, 2, "null"), (2, 3, "positive"), (2, 4, "positive"), (None, 5, "negative"), (None, 6, "positive")], "k int, id int, w string")
    assert sorted((r["id"], r["n_conflicts"], r["n_against_null"]) for r in rows(synthesis.opposed(d, "k", "id", "w"))) == [(1, 0, 1), (2, 0, 1), (5, 1, 0), (6, 1, 0)]
