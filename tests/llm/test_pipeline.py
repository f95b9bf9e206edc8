import hashlib
import inspect

from pyspark.sql import functions as F

from corpusloom.llm import queries


def test_pipeline_stages(spark, docs, sf):
    import corpus_pipeline as C

    assert [n for n, _ in C.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "bpe"] and C.ORACLE_SQL is None
    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    df = docs
    for name, stage in C.STAGES:
        out = stage(spark, df, sf).cache()
        got = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name != "bpe":
            assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes)
        if name in ("quality", "near_duplicates"):
            assert 0 < len(got) < len(ids) and len(got) == len(set(got))
        else:
            assert set(got) == ids  # no document is lost here
        if name == "secrets":
            assert out.where(F.col("text").rlike("AKIA[A-Z0-9]{12}|[0-9a-f]{32}")).count() == 0
        ids, before, df = set(got), df, out
    assert df.count() == before.count()
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    assert all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in df.collect())


def test_results_of_a_stage_stand_side_by_side(spark, docs, sf):
    import corpus_pipeline as C

    parts = [docs.where(F.col("doc_id") % 2 == k) for k in range(2)]
    for name, stage in C.STAGES:
        results = [stage(spark, p, sf) for p in parts]
        counts = [r.count() for r in reversed(results)][::-1]
        assert counts == [stage(spark, p, sf).count() for p in parts], name
    runs = [C.run(spark, sf) for _ in range(2)]
    assert runs[0].count() == runs[1].count() == runs[0].count()


def test_run_on_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline as C

    for k, df in enumerate((odd, empty)):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        assert C.run(spark, f"{tmp_path}/{k}").count() == (1 if k == 0 else 0)  # only the plain sentence passes the rules, once


def test_native_operators_have_no_python(spark, docs):
    from corpusloom.llm import mixing, pii, quality

    for module in (mixing, pii, quality):
        source = inspect.getsource(module)
        assert not any(w in source for w in ("mapInArrow", "mapInPandas", "pandas_udf", "applyIn", ".rdd", "F.udf"))


def test_registered():
    assert {int(n[2:].split("_")[0]) for n in queries.queries() if n.startswith("op")} == set(range(1, 14)) and "pipeline" in queries.queries()
    assert queries.oracle_sql().keys() <= queries.queries().keys()
