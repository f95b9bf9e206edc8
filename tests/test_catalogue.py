import pytest

from corpusloom.plans import catalogue
from tests import oracle


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE))
def test_matches_duckdb(spark, sf, con, name):
    got, want = catalogue.QUERIES[name](spark, sf).toPandas(), con.sql(catalogue.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert oracle.rows(got) == oracle.rows(want)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES.keys() - catalogue.ORACLE.keys()))
def test_runs(spark, sf, name):
    df = catalogue.QUERIES[name](spark, sf)
    assert len(df.columns) == len(set(df.columns))
    df.collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert __spark_entry__.oracle_sql().keys() <= __spark_entry__.queries().keys()


@pytest.mark.parametrize("name", ["near_dup_pairs", "jaccard_best_match", "bidirectional_overlap", "cooccurrence_distinct", "coverage_grid", "insert_ignore"])
def test_plan_has_no_nested_loop_over_facts(spark, sf, name):
    plan = catalogue.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_filters_and_columns_reach_the_scan(spark, sf):
    plan = catalogue.scan_filter_topn(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(p_size)" in plan and "p_retailprice" not in plan.split("ReadSchema")[1]
