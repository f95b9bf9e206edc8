"""Trees by parent ids against a walk: unbalanced depth, opaque ids, orphans, cycles, repeated and null ids."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import tree as T


def _walk(parents):
    up = {}
    for k in parents:
        path, at = [k], parents[k]
        while at in parents and at not in path and len(path) <= len(parents):
            path.append(at)
            at = parents[at]
        up[k] = None if at in path else path
    return up


def test_forest_equals_a_walk(spark):
    r = random.Random(9)
    parents = {f"n{k}": f"n{k - 1}" for k in range(1, 40)} | {"n0": None}
    parents |= {f"b{k}": r.choice(["n3", "n17", *(f"b{j}" for j in range(k))]) for k in range(1, 60)} | {"b0": "gone"}
    parents |= {"c1": "c2", "c2": "c3", "c3": "c1", "c4": "c1", "c5": "c4", "s": "s"}
    rows = [*parents.items(), (None, "n1"), ("n5", "n4")]
    tree = T.build(spark.createDataFrame(rows, "id string, parent string"), id_col="id", parent_col="parent")
    up = _walk(parents)
    assert {x["node"] for x in tree.cyclic.collect()} == {k for k, p in up.items() if p is None} == {"c1", "c2", "c3", "c4", "c5", "s"}
    assert sorted(map(tuple, tree.closure.collect())) == sorted((k, a, d) for k, p in up.items() if p for d, a in enumerate(p))
    assert {(x["node"], x["level"], x["root"]) for x in T.levels(tree).collect()} == {(k, len(p), p[-1]) for k, p in up.items() if p}
    below = T.subtree(tree, spark.createDataFrame([("n17",), ("b0",), ("zz",)], "id string")).collect()
    assert {(x["root"], x["node"]) for x in below} == {(a, k) for k, p in up.items() if p for a in p if a in ("n17", "b0")}
    values = spark.createDataFrame([("n39", 5), ("n39", 1), ("b0", 2), ("c1", 9)], "id string, v long")
    assert dict(map(tuple, T.rolled_up(tree, values, "id", "v").collect())) == {f"n{k}": 6 for k in range(40)} | {"b0": 2}


def test_empty_tree(spark):
    tree = T.build(spark.createDataFrame([], "id long, parent long"), id_col="id", parent_col="parent")
    assert tree.closure.count() == tree.cyclic.count() == 0


def test_sums_and_cycles_in_rows_of_the_order_of_the_nodes(spark):
    n = 500
    rows = [(k, k - 1 if k else None, k % 7) for k in range(n)] + [(n + k, n + (k + 1) % 3, 1) for k in range(3)] + [(n + 3, n, 1), (n + 4, n + 3, 1)]
    values = spark.createDataFrame(rows, "id long, parent long, v int").withColumns({"one": F.lit(1), "d": F.col("v").cast("decimal(12,2)")})
    tree = T.build(values, id_col="id", parent_col="parent")
    assert {x["node"] for x in tree.cyclic.collect()} == {n, n + 1, n + 2, n + 3, n + 4}
    assert [s.count() for s in tree.steps] == [n - (1 << k) + 5 for k in range(9)]
    assert sorted(map(tuple, T.levels(tree).collect())) == [(k, k + 1, 0) for k in range(n)]
    got = T.rolled_up(tree, values, "id", "v", "one", "d").collect()
    assert sorted((x["node"], x["total"], x["one"], int(x["d"])) for x in got) == [(k, t := sum(j % 7 for j in range(k, n)), n - k, t) for k in range(n)]
    only = spark.createDataFrame([("c1", "c2"), ("c2", "c1")], "id string, parent string")
    alone = T.build(only, id_col="id", parent_col="parent")
    assert alone.cyclic.count() == 2 and T.levels(alone).count() == T.rolled_up(alone, only.withColumn("one", F.lit(1)), "id", "one").count() == alone.closure.count() == 0
