"""Bucketed tables: merges touch their buckets, failures change nothing, readers keep their version; the cache; running state."""

import datetime

import pytest
from pyspark.sql import functions as F

from corpusloom.sources.bucketed import BucketedTable, Conflict, ExpiringCache
from corpusloom.streaming.state import running_state


def _rows(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_merge_rewrites_touched_buckets_only(spark, tmp_path):
    base = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("old").alias("w"))
    first = BucketedTable.create(base, f"file://{tmp_path}/t", "k", buckets=32)
    change = spark.createDataFrame([(5, None, "new", 1), (5, 70, None, 2), (2000, 1, "in", 1)], "k long, v long, w string, at int")
    second = first.upsert(change, "at")
    assert len(second.touched) <= 2 and {b: p for b, p in second.where.items() if b not in second.touched} == {b: p for b, p in first.where.items() if b not in second.touched}
    want = {k: (k, 2 * k, "old") for k in range(1000)} | {5: (5, 70, None), 2000: (2000, 1, "in")}
    got = {r[0]: r for r in _rows(second)}
    assert got[5][1] == 70 and {k: v for k, v in got.items() if k != 5} == {k: v for k, v in want.items() if k != 5}
    assert len(_rows(first)) == 1000  # the version that was opened stays as it was
    third = second.delete(spark.createDataFrame([(2000,), (7,)], "k long"))
    assert {r[0] for r in _rows(third)} == set(range(1000)) - {7}
    assert third.merge(change.limit(0), lambda a, b: a) is third
    assert [tuple(r) for r in third.lookup(spark.createDataFrame([(3,), (7,), (None,)], "k long")).collect()] == [(3, 6, "old")]
    assert third.vacuum(keep=1) > 0 and _rows(BucketedTable(spark, f"file://{tmp_path}/t")) == _rows(third)


def test_failed_and_competing_merges_change_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = BucketedTable.create(spark.range(50).select(F.col("id").alias("k"), F.lit(1).alias("v")), path, "k", buckets=8)
    before = _rows(table)
    change = spark.createDataFrame([(1, 9)], "k long, v int")
    with pytest.raises(Exception, match="broken"):
        table.merge(change, lambda a, b: a.unionByName(b).withColumn("v", F.raise_error(F.lit("broken")).cast("int")))
    assert _rows(BucketedTable(spark, path)) == before and BucketedTable(spark, path).version == 1
    other = BucketedTable(spark, path)
    table.replace(change)
    with pytest.raises(Conflict):
        other.replace(spark.createDataFrame([(2, 5)], "k long, v int"))
    assert dict(_rows(BucketedTable(spark, path))) == {k: 9 if k == 1 else 1 for k in range(50)}


def test_cache_expires_and_compacts(spark, tmp_path):
    at = lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)
    frame = lambda rows: spark.createDataFrame(rows, ExpiringCache.SCHEMA)
    cache = ExpiringCache.create(spark, f"file://{tmp_path}/c", ttl_seconds=100, buckets=4)
    cache = cache.put(frame([("a", "1", at(0)), ("b", "1", at(50)), ("b", "2", at(60)), ("b", "0", at(10))]))
    cache = cache.put(frame([("a", "old", at(-5)), ("c", "3", at(90))]))
    ask = spark.createDataFrame([("a",), ("b",), ("b",), ("z",)], "key string")
    assert sorted(tuple(r) for r in cache.get(ask, F.lit(at(120))).collect()) == [("a", None, "expired"), ("b", "2", "hit"), ("z", None, "miss")]
    assert sorted(tuple(r) for r in cache.get(ask, F.lit(at(100))).collect())[0] == ("a", "1", "hit")  # to the last second
    asked = []

    def fetch(missing):
        asked.append(sorted(r["key"] for r in missing.collect()))
        return missing.select("key", F.lit("new").alias("value"), F.lit(at(120)).alias("cached_at"))

    answers, cache = cache.through(ask, F.lit(at(120)), fetch)
    assert sorted(map(tuple, answers.collect())) == [("a", "new"), ("b", "2"), ("z", "new")] and asked == [["a", "z"]]
    compacted = cache.compact(F.lit(at(170)))
    assert sorted(r["key"] for r in compacted.table.read().collect()) == ["a", "c", "z"]


def test_running_state_writes_changed_keys_and_survives_a_restart(spark, tmp_path):
    path, counts = f"file://{tmp_path}/state", {}
    schema = "k string, v double"
    batches = [[("a", 1.0), ("b", 2.0), ("a", 5.0)], [("b", 7.0)], [("c", 1.0), ("a", -3.0)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"), F.avg("v").alias("mean"))
        running_state(stream, path, "k", f"file://{tmp_path}/ck", buckets=16)
        for k, v in rows:
            counts.setdefault(k, []).append(v)
        table = BucketedTable(spark, path)
        assert table.version == n + 1 and len(table.touched) == len({k for k, _ in rows})
        got = {r["k"]: (r["n"], r["most"], r["mean"]) for r in table.read().collect()}
        assert got == {k: (len(v), max(v), sum(v) / len(v)) for k, v in counts.items()}
