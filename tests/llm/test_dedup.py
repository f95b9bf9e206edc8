import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from corpusloom.llm import simhash, spans
from corpusloom.llm.components import connected_components


def _fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def _classes(fps):
    """id -> smallest id reachable over links of 3 bits; fps: (id, fp)."""
    ids, out = sorted({i for i, _ in fps if i is not None}), {}
    by = dict(fps)
    rest = set(ids)
    while rest:
        seed = min(rest)
        group, todo = {seed}, [seed]
        while todo:
            x = todo.pop()
            new = {y for y in rest - group if (by[x] ^ by[y]).bit_count() <= 3}
            group |= new
            todo += new
        out |= {y: seed for y in group}
        rest -= group
    return out


def test_fingerprint():
    for text in (None, "", "  \n", "One", "one TWO", "a b c d a b c d", "É é É", "x " * 40000):
        assert simhash.fingerprint(text) == _fingerprint(text)


def test_document_classes(docs, odd, empty):
    for df in (docs, odd):
        texts = [(r["doc_id"], _fingerprint(r["text"])) for r in df.select("doc_id", "text").collect()]
        got = simhash.document_classes(df).collect()
        assert sorted((str(r["doc_id"]), r["fingerprint"]) for r in got) == sorted((str(i), f"{f:016x}") for i, f in texts)
        want = _classes(texts)
        assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == want
    assert simhash.document_classes(empty).count() == 0


def test_links_lose_no_pair(spark):
    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(40)]
    fps = set(base)
    for b in base:
        for _ in range(8):
            x = b
            for _ in range(r.randrange(1, 6)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {0, 1, 3, 7, (1 << 64) - 1, 1 << 63, (1 << 63) | 5, 0xFFFFFFFF}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    got = {tuple(sorted((x["a"], x["b"]))) for x in simhash.links(spark.createDataFrame([(signed(f),) for f in fps], "fp long")).collect()}
    fs = sorted(fps)
    want = {tuple(sorted((signed(a), signed(b)))) for i, a in enumerate(fs) for b in fs[:i] if (a ^ b).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none", "loops"])
def test_components(spark, shape):
    r = random.Random(5)
    n = 60
    edges = {"chain": [(i, i + 1) for i in range(n)], "star": [(0, i) for i in range(1, n)], "random": [(r.randrange(n), r.randrange(n)) for _ in range(40)], "none": [], "loops": [(1, 1), (2, 3), (3, 2), (2, None)]}[shape]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}


def test_similar_classes_equal_brute_force(docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    sets = {i: set(simhash.shingle_hashes(t, 5).tolist()) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and both >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = {r["doc_id"]: r["component_id"] for r in simhash.similar_classes(docs).collect()}
    assert got == {i: find(i) for i in ids}


def test_variants_of_one_original_are_one_class(spark):
    r = random.Random(11)
    original = [f"w{r.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(original)]
    for _ in range(300):
        words = list(original)
        for at in r.sample(range(8, 292), 6):
            words[at] = f"v{r.randrange(10**9)}"
        texts.append(" ".join(words))
    assert all(simhash.shared_part(texts[0], t, 5) >= 0.8 for t in texts)
    assert sum(simhash.shared_part(a, b, 5) < 0.8 for a, b in zip(texts[1:], texts[2:])) > 250
    r.shuffle(texts)
    got = simhash.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(got) == 301 and {x["component_id"] for x in got} == {0}


def test_similar_classes_link_fingerprints_first(docs, monkeypatch):
    texts = {r["node"]: r["fp"] for r in simhash.prefixes(docs, ["doc_id"]).select("node", "fp").distinct().collect()}
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    nodes = docs.sparkSession.createDataFrame(list(texts.items()), "node long, fp long")
    got = {(x["a"], x["b"]) for x in simhash.fingerprint_pairs(nodes).collect()}
    assert all(a < b and apart(texts[a], texts[b]) <= simhash.DISTANCE for a, b in got)
    fps = sorted(set(texts.values()))
    linked = {(texts[a], texts[b]) for a, b in got} | {(texts[b], texts[a]) for a, b in got}
    assert all((a, b) in linked for k, b in enumerate(fps) for a in fps[:k] if apart(a, b) <= simhash.DISTANCE)
    seen = []
    monkeypatch.setattr(simhash, "links", lambda distinct, of=simhash.links: seen.append(distinct.count()) or of(distinct))
    simhash.similar_classes(docs)
    assert seen == [len(fps)]


def test_prefixes_meet_in_any_order():
    import numpy as np

    r = np.random.default_rng(4)
    for _ in range(300):
        n = int(r.integers(1, 60))
        pool = r.integers(0, 2**63, n + 20).astype(np.uint64)
        x, y = np.unique(pool[: int(r.integers(1, n + 1))]), np.unique(pool[int(r.integers(0, 8)) : n])
        both = len(np.intersect1d(x, y))
        common = np.unique(r.choice(pool, 10, replace=False))
        at = r.permutation(len(common))
        if len(x) and len(y) and both / (len(x) + len(y) - both) >= 0.8:
            assert set(simhash.prefix(x, 0.8, common, at).tolist()) & set(simhash.prefix(y, 0.8, common, at).tolist())


def test_keep_one(odd, spark, empty):
    kept = simhash.keep_one(odd).collect()
    ids = [r["doc_id"] for r in kept]
    assert ids.count(4) == 1 and 5 not in ids and len(ids) == len(set(ids)) and set(odd.columns) == set(kept[0].asDict())
    assert sorted(map(str, ids)) == sorted(map(str, [1, 4, 6, 7, 8, 9, None]))  # null, empty and blank texts are one class
    twice = spark.createDataFrame([(1, "a b c d e f g"), (1, "a b c d e f g"), (2, "q")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(twice).collect()) == [1, 2]
    assert simhash.keep_one(empty).count() == 0


# ---------------------------------------------------------------- sentence spans
def _sentences(text):
    """(start, end, words) of each sentence, by the definition."""
    found = [(m.group(), m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    over = [k == len(found) - 1 or w[-1] in ".!?;:" or "\n" in text[e : found[k + 1][1]] for k, (w, _, e) in enumerate(found)]
    rank = [0 if o else (xxhash.xxh64_intdigest(w) & 0x3FFFFFFF) + 1 for (w, _, _), o in zip(found, over)]
    for lo in range(len(found) - spans.WINDOW + 1):
        window = rank[lo : lo + spans.WINDOW]
        over[max(k for k in range(lo, lo + spans.WINDOW) if rank[k] == min(window))] = True
    out, first = [], 0
    for k, o in enumerate(over):
        if o:
            out.append((found[first][1], found[k][2], [w for w, _, _ in found[first : k + 1]]))
            first = k + 1
    return out


def _removed(rows):
    """doc_id -> set of removed (start, end) by the definition, spans unmerged."""
    seen, occ = {}, []
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        found = _sentences(t) if t else []
        for first in range(len(found)):
            for past in range(first + 1, len(found) + 1):
                words = [w for s in found[first:past] for w in s[2]]
                if past - first >= spans.MIN_SENTENCES and len(words) >= spans.MIN_WORDS:
                    occ.append((" ".join(words), i, first, found[first][0], found[past - 1][1]))
                    break
    for key, i, first, *_ in occ:
        seen[key] = min(seen.get(key, (i, first)), (i, first))
    out = {}
    for key, i, first, start, end in occ:
        if seen[key] != (i, first):
            out.setdefault(i, set()).update(range(start, end))
    return out


def test_spans_equal_brute_force(docs, odd, empty):
    for df in (docs, odd.dropDuplicates(["doc_id"])):
        rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
        want = _removed(rows)
        texts = {i: t for i, t in rows}
        got = spans.document_spans(df).collect()
        assert len(got) == len(rows)
        for r in got:
            cut = {p for s in r["removed"].split(",") if s for p in range(*map(int, s.split(":")))}
            full = texts[r["doc_id"]]
            blank = lambda p: full[p].isspace()
            w = want.get(r["doc_id"], set())
            assert {p for p in cut if not blank(p)} == {p for p in w if not blank(p)}
            if full is not None:
                assert r["text"] == "".join(c for p, c in enumerate(full) if p not in cut) and r["chars_removed"] == len(cut)
            else:
                assert r["text"] is None
    assert spans.document_spans(empty).count() == 0


def test_passage_is_found_wherever_it_stands(spark):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9)))
    passage = " ".join(word() + ("." if k % 11 == 10 else "," if k % 7 == 6 else "") for k in range(70))
    texts = [" ".join(word() for _ in range(r.randrange(5, 40))) + " " + passage + " " + " ".join(word() for _ in range(r.randrange(5, 40))) for _ in range(6)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in spans.document_spans(df).collect()}
    assert got[0]["removed"] == "" and got[0]["text"] == texts[0]
    assert all(got[i]["chars_removed"] > 0.6 * len(passage) for i in range(1, 6))
    clean = spark.createDataFrame([(i, " ".join(word() for _ in range(200))) for i in range(5)], "doc_id long, text string")
    assert spans.document_spans(clean).agg(F.sum("n_removed")).first()[0] == 0


def test_any_fifty_words_hold_a_whole_span():
    r = random.Random(21)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9)))

    def found(text):
        words, _, _, stops = spans.cut(text.encode())
        return {b" ".join(words[a:b]) for a, b in zip(*spans.runs(stops, spans.MIN_SENTENCES, spans.MIN_WORDS))}

    for k in range(2000):
        passage = " ".join(word() + ("." if k % 2 and r.random() < 0.1 else "") for _ in range(50))
        one, two = (" ".join([*(word() for _ in range(r.randrange(30))), passage, *(word() for _ in range(r.randrange(30)))]) for _ in range(2))
        assert found(one) & found(two)
