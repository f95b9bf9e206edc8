"""The exact vector index against a full reckoning, on clustered and on evenly spread vectors."""

import numpy as np
import pytest

from corpusloom.operators import vector_index as V


def _table(spark, x, marks=None):
    return spark.createDataFrame([(i, [float(a) for a in r], marks[i] if marks is not None else "m") for i, r in enumerate(x)], "vec_id long, embedding array<double>, label string")


def _unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.fixture(scope="module", params=["clustered", "spread"])
def data(request):
    r = np.random.default_rng(3)
    x = r.normal(size=(600, 16))
    if request.param == "clustered":
        x = x * 0.25 + r.normal(size=(12, 16))[r.integers(0, 12, 600)]
    x[10] = x[20] = x[30]  # ties
    return request.param, x


def test_search_equals_a_full_scan(spark, data, monkeypatch):
    monkeypatch.setattr(V, "TILE", 32)
    monkeypatch.setattr(V, "BLOCK", 16)
    kind, x = data
    df = _table(spark, x)
    index = V.build(df, id_col="vec_id", cells=24)
    s = np.round(_unit(x) @ _unit(x).T, 12)
    for own in (False, True):
        got = V.search(index, df.where("vec_id % 20 = 0"), k=7, id_col="vec_id", exclude_self=own).collect()
        want = {q: [j for j in np.lexsort((np.arange(600), -s[q])) if not (own and j == q)][:7] for q in range(0, 600, 20)}
        for q in want:
            assert [r["id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want[q]
    read = {r["query_id"]: r["cells_read"] for r in got}
    assert max(read.values()) <= 24 and (kind == "spread" or np.mean(list(read.values())) < 12)


def test_pairs_equal_all_pairs(spark, data):
    kind, x = data
    marks = [f"m{i % 3}" for i in range(600)]
    df = _table(spark, x, marks)
    index = V.build(df, id_col="vec_id", differ="label", cells=24)
    s = _unit(x) @ _unit(x).T
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if s[i, j] >= 0.92 and marks[i] != marks[j]}
    got = {(r["id_a"], r["id_b"]) for r in V.range_pairs(index, df, least=0.92, id_col="vec_id", differ="label").collect()}
    assert got == want and (kind == "spread" or len(want) > 50)
    p = V.products(index, df, least=0.92, id_col="vec_id").first()
    assert p["products"] < (0.35 if kind == "clustered" else 1.001) * 600 * 600


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0], "a"), (2, [0.0, 0.0], "a"), (3, None, "a"), (4, [2.0, 0.1], "b"), (4, [2.0, 0.1], "b"), (None, [1.0, 0.2], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    index = V.build(df, id_col="vec_id")
    got = sorted((r["query_id"], r["rank"], r["id"]) for r in V.search(index, df.where("vec_id in (1, 2, 3)"), k=2, id_col="vec_id").collect())
    assert got == [(1, 1, 1), (1, 2, 4)]
    assert {(r["id_a"], r["id_b"]) for r in V.range_pairs(index, df, least=0.9, id_col="vec_id").collect()} == {(1, 4)}
    none = df.where("vec_id = 3")
    empty = V.build(none, id_col="vec_id")
    assert V.search(empty, df, k=2, id_col="vec_id").count() == 0 and V.range_pairs(empty, none, least=0.9, id_col="vec_id").count() == 0


def test_pairs_are_not_shuffled_once_they_are_found(spark):
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 5))
    rows = [(f"k{i}", v.tolist(), i % 3) for i, v in enumerate(x)] + [(None, x[0].tolist(), 1), ("é", x[1].tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>, part int")
    index = V.build(df, id_col="vec_id", differ="part", cells=4)
    pairs = V.range_pairs(index, df, least=0.5, id_col="vec_id", differ="part")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # visits meet tiles; what comes of it meets nothing
    y = {i: np.array(v) / np.linalg.norm(v) for i, v, _ in rows if i}
    part = {i: p for i, _, p in rows}
    got = {(row["id_a"], row["id_b"]) for row in pairs.collect()}
    assert got == {(a, b) for a in y for b in y if a < b and part[a] != part[b] and y[a] @ y[b] >= 0.5} and len(got) > 20


def test_products_get_few_blocks_at_once(spark, monkeypatch):
    rows, plain = {}, V.materialise
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(V, "materialise", lambda df, tag: rows.setdefault(tag, spark.conf.get(key)) and plain(df, tag))
    x = np.random.default_rng(9).normal(size=(200, 4))
    df = _table(spark, x)
    got = V.search(V.build(df, id_col="vec_id", cells=6), df.where("vec_id % 20 = 0"), k=3, id_col="vec_id").collect()
    assert len(got) == 30 and spark.conf.get(key) == before
    assert int(rows["home"]) <= 8 and int(rows["far"]) <= 8 and rows["queries"] == rows["visits"] == before
