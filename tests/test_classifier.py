"""Scores of vectors with nodes, the second classifier, measured broadcasts: against plain reckonings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import classifier, scoring, sized, taxonomy

NAN = float("nan")


def _vectors(spark, n=60, dim=6):
    x = np.random.default_rng(5).normal(size=(n, dim))
    odd = [(n, None), (n + 1, [0.0] * dim), (n + 2, [1.0]), (n + 3, [NAN] + [1.0] * (dim - 1)), (n + 4, [None] + [1.0] * (dim - 1)), (n + 5, []), (0, x[1].tolist())]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + odd
    return data, spark.createDataFrame(data, "id long, embedding array<double>").repartition(3)


def _nodes(spark, n=30, dim=6):
    x = np.random.default_rng(6).normal(size=(n, dim))
    data = [(f"n{i:02d}", f"f{i % 3}", i % 3 + 1, x[i - i % 5 // 4].tolist()) for i in range(n)]  # every fifth equals the one before it
    return data, spark.createDataFrame(data + [("none", "f0", 1, None)], "node_id string, facet_id string, level int, centroid array<double>").repartition(2)


def _cosine(a, b):
    a, b = ([float("nan") if v is None else v for v in c or []] for c in (a, b))
    if len(a) != len(b) or not all(map(math.isfinite, a + b)) or not any(a) or not any(b):
        return 0.0
    return round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 12)


@pytest.mark.parametrize("node_bytes", [scoring.NODE_BYTES, 1200])
@pytest.mark.parametrize("least, clip", [(-1.0, False), (0.25, False), (0.0, True)])
def test_scores_equal_brute_force(spark, node_bytes, least, clip):
    vectors, v = _vectors(spark)
    nodes, n = _nodes(spark)
    got = sorted((r["id"], r["node_id"], r["facet_id"], r["level"], round(r["score"], 9)) for r in scoring.pairs(v, n, id_col="id", least=least, clip=clip, node_bytes=node_bytes).collect())
    want = [(i, m, f, lv, max(_cosine(x, c), 0.0) if clip else _cosine(x, c)) for i, x in vectors for m, f, lv, c in [*nodes, ("none", "f0", 1, None)]]
    assert got == sorted((*k, round(s, 9)) for *k, s in want if s >= least)


def test_scores_of_empty_tables(spark):
    v, n = _vectors(spark)[1], _nodes(spark)[1]
    assert not scoring.pairs(v.where("false"), n, id_col="id", least=-1.0).collect()
    assert not scoring.pairs(v, n.where("false"), id_col="id", least=-1.0).collect()
    assert not classifier.classify(v, n.where("false"), [1.0] * 6, id_col="id").collect()


def _plain(x, nodes, domain):
    scores = sorted(((round(max(_cosine(x, c), 0.0), 9), m, f, lv) for m, f, lv, c in nodes), key=lambda s: (-s[0], s[1]))
    near = _cosine(x, domain)
    strong = {lv: [s for s in scores if s[3] == lv and s[0] >= least][:3] for lv, least in ((3, 0.65), (2, 0.7))}
    listed = {lv: f"Strong L{lv} matches: {[f'{m}:{s:.2f}' for s, m, *_ in found]}" for lv, found in strong.items()}
    if near < 0.3:
        decision, reasons = "reject", [f"Low domain relevance: {near:.2f}"]
    else:
        why = listed[3] if strong[3] else listed[2] if strong[2] else "In domain but no strong facet matches" if near >= 0.5 else f"Marginal domain score: {near:.2f}"
        decision, reasons = "send_to_eater" if strong[3] or strong[2] else "review", [f"Domain score: {near:.2f}", why]
    facets = [(f, m) for f in sorted({n[1] for n in nodes}) for s, m, g, _ in [s for s in scores if s[2] == f][:3]]
    return round(near, 9), decision, reasons, [(m, s) for s, m, *_ in scores[:10]], facets


@pytest.mark.parametrize("node_bytes", [scoring.NODE_BYTES, 1200])
def test_classifier_equals_a_plain_reckoning(spark, node_bytes):
    vectors, v = _vectors(spark, 200)
    nodes, n = _nodes(spark)
    domain = [1.0, 0.5, 0.0, 0.0, 0.0, 0.2]
    out = classifier.classify(v, n, domain, id_col="id", node_bytes=node_bytes)
    got = [(r["id"], round(r["domain_score"], 9), r["decision"], r["reasons"], [(b["node_id"], round(b["score"], 9)) for b in r["top_nodes"]], [(b["facet_id"], b["node_id"]) for b in r["facets"]]) for r in out.collect()]
    want = [(i, *_plain(x, [*nodes, ("none", "f0", 1, None)], domain)) for i, x in vectors]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {w[2] for w in want} == {"reject", "review", "send_to_eater"} and {w[3][-1][:9] for w in want} >= {"Strong L2", "Strong L3", "In domain", "Marginal "}
    kept = {(r["id"], r["node_id"]) for r in classifier.stored(out, "id").collect()}
    assert kept == {(i, m) for i, *_, top, _ in want for m, s in top if s >= 0.3}


def test_bounded_nodes_are_scored_without_a_shuffle(spark):
    plan = classifier.classify(_vectors(spark)[1].coalesce(1), _nodes(spark)[1], [1.0] * 6, id_col="id")._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_node_model_blends_raw_means(spark):
    nodes = spark.createDataFrame([("a", None, 1, "f"), ("a.b", "a", 2, "f"), ("a.c", "a", 2, "f"), ("z", None, 1, "f")], "node_id string, parent_id string, level int, facet_id string")
    seeds = spark.createDataFrame([("a", [2.0, 0.0]), ("a.b", [1.0, 0.0]), ("a.b", [0.0, 1.0])], "node_id string, embedding array<double>")
    got = {r["node_id"]: r["centroid"] for r in classifier.node_model(nodes, seeds, levels=2).collect()}
    blend = np.array([0.7 * 0.5 + 0.3, 0.7 * 0.5])
    assert got.keys() == {"a", "a.b", "a.c"} and np.allclose(got["a"], [1, 0]) and np.allclose(got["a.b"], blend / np.linalg.norm(blend)) and np.allclose(got["a.c"], [1, 0])


def test_hints_stand_behind_rows_and_bytes(spark):
    df = spark.createDataFrame([(1, "x" * 1000, ["y" * 1000], [1.0] * 100, ("z" * 1000, {"k": "v" * 1000}))], "a long, s string, l array<string>, v array<double>, t struct<p:string,m:map<string,string>>")
    n = df.select(sized.row_bytes(df)).first()[0]
    assert 4800 <= n <= 5100
    hinted = lambda d: "ResolvedHint" in d._jdf.queryExecution().analyzed().toString()
    assert hinted(sized.small(df)) and not hinted(sized.small(df, size=n - 1)) and not hinted(sized.small(df.unionAll(df), rows=1)) and hinted(sized.small(df.where("false")))
    nulls = spark.createDataFrame([(None,) * 3], "s string, l array<string>, v array<double>")
    assert nulls.select(sized.row_bytes(nulls)).first()[0] > 0


def test_weights_of_slots(spark):
    df = spark.createDataFrame([("one two two",), ("one",), (None,)], "t string")
    held = df.select(F.explode(F.array_distinct(taxonomy.word_slots(F.col("t"), 8)))).groupBy("col").count().collect()
    weights = taxonomy.slot_weights(df, F.col("t"), dim=8)
    assert weights == [math.log(4 / (dict(held).get(i, 0) + 1)) for i in range(8)]
    plain, weighted = (taxonomy.embed(df, F.col("t"), dim=8, weights=w).collect()[0]["embedding"] for w in (None, weights))
    raw = np.array(plain) * weights
    assert np.allclose(weighted, raw / (np.linalg.norm(raw) + 1e-10), atol=1e-6)
