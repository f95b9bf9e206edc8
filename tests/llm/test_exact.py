"""Exact dedup by the cuckoo index: brute force over tables and over a history of insertions and deletions."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import cuckoo


def _bare(text):
    return (text or "").translate({c: None for c in (0x20, *range(0x09, 0x0E))})


def _groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[_bare(t)].append((i, len(t or "")))
    out = []
    for bare, members in by.items():
        keep = min(members, key=lambda m: (-m[1], m[0] is None, m[0] or 0))
        out += [(i, keep[0], len(members), (i, n) == keep, hashlib.sha256(bare.encode()).hexdigest()) for i, n in members]
    return sorted(out, key=str)


def _got(index):
    return sorted((tuple(r) for r in cuckoo.groups(index).withColumn("key", F.lower(F.hex("key"))).collect()), key=str)


def test_filter_holds_what_was_inserted_and_not_deleted():
    r = random.Random(3)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(5000)]
    bucket, live = cuckoo.Bucket(), set()
    for _ in range(20000):
        key = r.choice(keys)
        if key in live and r.random() < 0.4:
            bucket.remove(key)
            live.discard(key)
        elif key not in live:
            bucket.add(key)
            live.add(key)
        assert bucket.keys == live if r.random() < 0.01 else True
    assert all(k in bucket.filter for k in live)
    assert sum(k in bucket.filter for k in keys if k not in live) < 20
    again = cuckoo.Bucket(bucket.filter.to_bytes(), b"".join(bucket.keys))
    assert all(k in again.filter for k in live)
    for k in list(live):
        again.remove(k)
    assert not any(again.filter.table)


def test_overflow_resizes_from_the_stored_keys():
    bucket = cuckoo.Bucket()
    before = bucket.filter.mask
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k in keys:
        bucket.add(k)
    assert bucket.filter.mask > before and all(k in bucket.filter for k in keys)


def test_document_groups(docs, odd, empty):
    for df in (docs, odd):
        rows = [tuple(r) for r in df.select("doc_id", "text").collect()]
        assert sorted((tuple(r) for r in cuckoo.document_groups(df).collect()), key=str) == _groups(rows)
    assert cuckoo.document_groups(empty).count() == 0


def test_history_of_the_index(spark, monkeypatch):
    monkeypatch.setattr(cuckoo, "BUCKET_KEYS", 8)
    r = random.Random(7)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(0, 5))) for _ in range(120)] + [None, "", " \t"]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    index, live, number = cuckoo.create(spark, 100), {}, 0
    assert _got(index) == [] and cuckoo.delete(index, frame([(1, "")])) is index
    for step in range(4):
        rows = [(number + k, r.choice(texts)) for k in range(40)]
        number += 40
        index = cuckoo.insert(index, frame(rows))
        live |= dict(rows)
        gone = [*r.sample(sorted(live), 25), 10**6]
        before, index = index, cuckoo.delete(index, frame([(g, None) for g in gone]))
        for g in gone[:-1]:
            del live[g]
        assert _got(index) == _groups(live.items())
        keys = {hashlib.sha256(_bare(t).encode()).digest() for t in live.values()}
        held = index.filters.collect()
        assert {bytes(f["keys"][k : k + 32]) for f in held for k in range(0, len(f["keys"]), 32)} == keys
        assert sum(c.count() for c in index.content) == len(keys)
        asked = [(k, t) for k, t in enumerate(texts)]
        found = {x["doc_id"]: x["found"] for x in cuckoo.lookup(index, frame(asked)).collect()}
        assert found == {k: hashlib.sha256(_bare(t).encode()).digest() in keys for k, t in asked}
    assert len(_got(before)) == len(live) + 25


def test_different_texts_under_one_digest_raise(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").coalesce(1)
    index = cuckoo.create(spark, 2)
    events = docs.select(F.lit(0).alias("bucket"), F.unhex(F.lit("01" * 32)).alias("key"), F.encode("text", "utf-8").alias("content"))
    with pytest.raises(Exception, match="different texts have the digest"):
        cuckoo._changed(index, cuckoo._event(events, 2)).collect()
