import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F

from corpusloom.llm import bpe, langid

PATH = P.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def tokens():
    return bpe.load_ranks(PATH)


@pytest.fixture(scope="module")
def reference(tokens):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


TEXTS = ["", " ", "\n\n  a", "🙂é\u0000x", "'s don't it'll " + "a" * 5000, "  " * 3000, "the" * 3000, "▁ ▁▁x", "<unk> <s> <|endoftext|>", "\x85\xa0 x 　 y", "½ ²x ª 123abc", "日本語 の テスト", "a\tb\r\nc"]


def test_codec_equals_reference(tokens, reference, docs):
    codec = bpe.Codec(bpe.serialise(tokens), tokens, P.PATTERN)
    for text in TEXTS + [r["text"] for r in docs.select("text").collect()]:
        ids = codec.encode(text)
        assert ids == " ".join(map(str, reference.encode_ordinary(text)))
        assert codec.decode(ids) == text.encode()


def test_other_vocabulary(docs):
    path = P.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.load_ranks(path)
    enc = tiktoken.Encoding("m", pat_str=P.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    codec = bpe.Codec(bpe.serialise(tokens), tokens, P.PATTERN)
    assert all(codec.encode(t) == " ".join(map(str, enc.encode_ordinary(t))) for t in TEXTS)


def test_cache_turns_over(tokens, reference, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 3)
    codec = bpe.Codec(bpe.serialise(tokens), tokens, P.PATTERN)
    text = " ".join(f"w{i % 7}" for i in range(100))
    assert codec.encode(text) == " ".join(map(str, reference.encode_ordinary(text))) and len(codec.words) <= 3


def test_round_trip_rows(odd, empty, reference):
    got = bpe.roundtrip(odd, ["doc_id"], path=PATH, pattern=P.PATTERN).collect()
    want = [(r["doc_id"], reference.encode_ordinary(r["text"] or ""), (r["text"] or "").encode()) for r in odd.collect()]
    key = lambda x: tuple(map(str, x))
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got), key=key) == sorted(((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest()) for i, ids, raw in want), key=key)
    assert bpe.roundtrip(empty, ["doc_id"], path=PATH, pattern=P.PATTERN).count() == 0


def test_encode_and_decode_operators(docs):
    coded = bpe.encode(docs.limit(20), ["doc_id"], path=PATH, pattern=P.PATTERN)
    plain = {r["doc_id"]: bytes(r["decoded"]).decode() for r in bpe.decode(coded, ["doc_id"], path=PATH, pattern=P.PATTERN).collect()}
    assert plain == {r["doc_id"]: r["text"] for r in docs.limit(20).collect()}


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(sf.replace("sf0.001", "sf0.01") + "/documents.parquet")
    got = langid.documents_language(docs).join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars > 40").collect()
    right = sum(r["lang_pred"] == r["lang"] for r in got) / len(got)
    assert len(got) > 200 and right > 0.95, right
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(odd, empty):
    got = langid.documents_language(odd).collect()
    assert len(got) == odd.count()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], set()).add((r["held_out"], r["lang_pred"], r["score"]))
    assert all(len(v) == 1 for v in by.values())
    assert all(next(iter(by[i]))[1:] == ("und", 0.0) for i in (1, 2, 3, 9))
    import zlib

    assert all(next(iter(v))[0] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, v in by.items() if i is not None)
    assert langid.documents_language(empty).count() == 0
    no_label = langid.documents_language(odd.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in no_label} == {"und"}


def _grams(text):
    t = f" {text.lower()} "
    return {t[i : i + n] for n in langid.ORDERS for i in range(len(t) - n + 1)}


def test_kernel_and_ridge_equal_a_dense_solution(docs):
    rows = [(r["lang"], r["text"][:400]) for r in docs.where("lang is not null and length(text) between 100 and 3000").orderBy("doc_id").limit(60).collect()]
    bits = langid.presence([t for _, t in rows])
    grams = [_grams(t) for _, t in rows]
    plain = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in grams] for a in grams])
    # Hashing to DIM bits joins n-grams by chance: of a and b bits a Poisson number of mean a * b / DIM meet that differ.
    sizes = np.sqrt([[len(a) * len(b) for b in grams] for a in grams])
    chance = sizes**2 / langid.DIM
    assert (np.abs(langid._kernel(bits, bits) - plain) < (chance + 4 * np.sqrt(chance) + 2) / sizes).all()

    model = langid.fit_rows(bits, [x for x, _ in rows], landmarks=len(rows) * 10, ridge=0.05)
    k = langid._kernel(bits, bits).astype(float)
    y = np.array([[float(x == n) for n in model.langs] for x, _ in rows])
    weight = (y / y.sum(0)).sum(1)
    dense = k @ np.linalg.solve(k + 0.05 * len(model.langs) * np.diag(1 / weight), y)
    assert np.abs(model.scores(bits) - dense).max() < 1e-2
    assert (model.scores(bits).argmax(1) == dense.argmax(1)).all()


def test_the_draw_is_the_same_in_any_order(spark):
    rows = [(1, "the same words again and again", "en")] * 300 + [(i, f"palabra numero {i} de la lista", "es") for i in range(300)] + [(i, f"another english text number {i}", "en") for i in range(300, 500)]
    models = []
    for seed in (1, 2):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3 + seed)
        models.append(langid.fit(df, F.col("doc_id"), max_rows=60, landmarks=16))
    assert models[0].langs == models[1].langs == ["en", "es"] and (models[0].landmarks == models[1].landmarks).all() and (models[0].weights == models[1].weights).all()


def test_presence_is_of_the_whole_text():
    a, b = langid.presence(["x" * 50000 + " zebra", "x" * 50000])
    assert a.sum() > b.sum() and langid.presence([None, ""]).sum() == 0
