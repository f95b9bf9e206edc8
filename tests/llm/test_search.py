"""Ranked search against brute force: whole tables, odd rows, ties, small shards and blocks."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import wavelet


def _terms(text):
    return re.findall(wavelet.TERM, re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _brute(docs, items, k=10):
    held = [(i, Counter(_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        wanted, found = set(_terms(text)), []
        for i, c in held:
            m = 10 + (90 * sum(c.values()) * n) // total
            if (score := sum(w[t] * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in wanted if t in c)) > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def _got(docs, items, **kw):
    return sorted((tuple(r) for r in wavelet.search(wavelet.build(docs), items, **kw).collect()), key=str)


@pytest.fixture(scope="module")
def items(spark, sf):
    return spark.read.parquet(f"{sf}/benchmark.parquet")


def test_whole_tables(docs, items):
    assert _got(docs, items) == _brute(_rows(docs, "doc_id", "text"), _rows(items, "item_id", "text"))


def test_terms():
    for text in ("Été’s 12x_Y\x00z ÀB\x85c　d", "", None, "  -- ", "\x7fa\x80b", "İI"):
        assert [t.decode() for t in wavelet.terms(text)] == _terms(text)


@pytest.mark.parametrize("size", [(3, 1 << 20), (4096, 5), (1, 1)])
def test_small_shards_blocks_and_ties(spark, monkeypatch, size):
    monkeypatch.setattr(wavelet, "SHARD_DOCS", size[0])
    monkeypatch.setattr(wavelet, "SHARD_POSTINGS", size[1])
    monkeypatch.setattr(wavelet, "BLOCK_QUERIES", 2)
    monkeypatch.setattr(wavelet, "BATCH", 2)
    r = random.Random(size[0])
    docs = [(k, " ".join(r.choice("abcdefgh") for _ in range(r.choice([0, 1, 3, 3, 9])))) for k in r.sample(range(100), 60)]
    docs += [(7, "a b"), (7, "a b"), (None, "a b c"), (101, "x a"), (102, "x a"), (103, None)]
    items = [(1, "a b c"), (2, "x"), (3, "zzz"), (4, None), (5, "h G f e d c b a"), (5, "h"), (None, "b")]
    frames = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert _got(*frames, k=3) == _brute(docs, items, 3)


def test_odd_rows_and_empty_tables(spark, odd, empty, items):
    rows = _rows(odd, "doc_id", "text")
    asked = [(1, "fox word3 code here"), (2, "word1 word2 word3"), (3, "é🙂 12345")]
    assert _got(odd, spark.createDataFrame(asked, "item_id long, text string")) == _brute(rows, asked)
    assert _got(empty, items) == [] and _got(odd, items.limit(0)) == []


def test_tree_reads_by_impact_and_by_document():
    r = random.Random(5)
    builder = wavelet._Builder(50, 500)
    texts = [[b"%d" % r.randrange(12) for _ in range(r.randrange(1, 20))] for _ in range(50)]
    for k, words in enumerate(texts):
        builder.add(k, words)
    import pyarrow as pa

    row = builder.row(0, pa.int64())
    shard = wavelet.Shard(*(row.column(c)[0].as_py() for c in ("vocab", "starts", "impacts", "bits")), 50)
    for t, name in enumerate(shard.vocab):
        s, e = int(shard.starts[t]), int(shard.starts[t + 1])
        want = sorted((-wavelet.impact(w.count(name), len(w), 50, 500), d) for d, w in enumerate(texts) if name in w)
        assert list(zip(-shard.impacts[0][s:e], shard.documents(np.arange(s, e)))) == want
    query = shard.lists([(n, 3) for n in shard.vocab])
    exact = [sum(3 * wavelet.impact(w.count(n), len(w), 50, 500) for n in set(w)) for w in texts]
    assert shard.scores(np.arange(50), query).tolist() == exact
    docs, scores = shard.search(query, 5, 1)
    assert list(zip((-scores).tolist(), docs.tolist())) == sorted((-s, d) for d, s in enumerate(exact))[:5]
