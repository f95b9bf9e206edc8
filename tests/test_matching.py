"""Clusters of ten starts, set matching, bounds of alignments, hashed embeddings, graph edges: against plain reckonings."""

import random
from difflib import SequenceMatcher

import numpy as np
import xxhash
from pyspark.sql import functions as F

from corpusloom.functions import normalize as N
from corpusloom.functions import similarity as SIM
from corpusloom.operators import dedup, graph, ingest, setmatch, sized, taxonomy, vector


def test_clusters_equal_a_plain_reckoning(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 6)) * 0.4 + r.normal(size=(7, 6))[r.integers(0, 7, 300)] * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "vec_id long, embedding array<double>").repartition(3)
    first = vector.first_centres(df, id_col="vec_id", k=5, starts=4)
    assert first.shape == (4, 5, 6) and len({tuple(c.ravel()) for c in first}) == 4
    got, inertia = vector.lloyd(df, first)
    want = []
    for c in first:
        for _ in range(50):
            d = ((x[:, None] - c) ** 2).sum(2)
            own, cost = d.argmin(1), d.min(1).sum()
            moved = np.array([x[own == i].mean(0) if (own == i).any() else c[i] for i in range(5)])
            shift, c = np.abs(moved - c).max(), moved
            if shift <= 1e-4:
                break
        want.append((c, cost))
    assert np.allclose(got, [c for c, _ in want], atol=1e-3) and np.allclose(inertia, [i for _, i in want], rtol=1e-3)
    best = want[int(np.argmin([i for _, i in want]))][0]
    rows = vector.clusters(df, id_col="vec_id", k=5, starts=4).collect()
    own = ((x[:, None] - best) ** 2).sum(2).argmin(1)
    assert sum(row["cluster"] == own[row["vec_id"]] for row in rows) >= 298
    for cluster in {row["cluster"] for row in rows}:
        members = [row for row in rows if row["cluster"] == cluster]
        cos = lambda i: x[i] @ best[cluster] / np.linalg.norm(x[i]) / np.linalg.norm(best[cluster])  # noqa: B023, E731
        assert members[0]["members"] == len(members) and members[0]["representative"] == max((m["vec_id"] for m in members), key=cos)
    assert vector.clusters(df.limit(3), id_col="vec_id", k=5).count() == 0


def test_set_matching_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(setmatch, "BLOCK_QUERIES", 3)
    r = random.Random(6)
    words = ["ab", "abc", "b", "cd", "x", "yy"]
    some = lambda n: r.sample(words, r.randrange(0, n))
    queries, docs = [(k, some(6)) for k in range(10)] + [(10, None)], [(k, some(7)) for k in range(40)] + [(40, None), (41, [])]
    q, d = spark.createDataFrame(queries, "q long, tokens array<string>"), spark.createDataFrame(docs, "id long, tokens array<string>").repartition(3)
    j = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    best = {k: min(((-j(a, b), i) for i, b in docs if b and set(a) & set(b)), default=None) for k, a in queries if a}
    assert {x["q"]: x["id"] for x in setmatch.best_jaccard(q, d).collect()} == {k: b[1] for k, b in best.items() if b}
    pairs = {(x["q"], x["id"], x["n"]) for x in setmatch.pairs_above(q, d, of_query=0.5, of_doc=0.4, least_tokens=2).collect()}
    assert pairs == {(k, i, n) for k, a in queries if a and len(a) >= 2 for i, b in docs if b and len(b) >= 2 and (n := len(set(a) & set(b))) and n / len(a) >= 0.5 and n / len(b) >= 0.4}
    texts = [(i, " ".join(b).upper() if b is not None else None) for i, b in docs]
    got = {(x["q"], x["id"]): x["share"] for x in setmatch.contained_above(q, spark.createDataFrame(texts, "id long, text string"), least=0.5).collect()}
    share = {(k, i): sum(w in t.lower() for w in a) / len(a) for k, a in queries if a for i, t in texts if t}
    assert got == {p: s for p, s in share.items() if s >= 0.5}


def test_clusters_of_a_table_with_tasks_without_rows(spark):
    rows = [(i, [float(i % 3), float(i)]) for i in range(6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(12)
    assert vector.clusters(df, id_col="vec_id", k=2, starts=2, least_size=1).count() == 6


def test_cascade_reaches_its_tiers_at_long_numbers(spark, tmp_path):
    from corpusloom.plans import corpus_queries

    keys = [2, 10_002, 1_000_002, 123_456_786, 9_999_999_998]
    spark.createDataFrame([(k, f"part {k}", "STEEL", "Brand#1", 3) for k in keys], "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    got = corpus_queries.duplicate_check(spark, str(tmp_path)).collect()
    assert {(r["new_id"], r["known_id"], r["match_type"], r["confidence"]) for r in got} == {(f"n{k}", f"p{k}", "author_title", 0.49) for k in keys}


def test_scores_are_written_as_printf_writes_them(spark):
    values = [k / 1000 for k in range(-1005, 1006, 5)] + [0.125, 0.375, 0.1549999, 0.0, 1.005, 17.345, None]
    got = spark.createDataFrame([(v,) for v in values], "x double").select("x", N.fixed(F.col("x")).alias("s"), N.fixed(F.col("x"), 3).alias("t")).collect()
    for row in got:
        assert (row["s"], row["t"]) == (None if row["x"] is None else f"{row['x']:.2f}", None if row["x"] is None else f"{row['x']:.3f}")


def test_reasons_are_ranked_by_unrounded_scores(spark):
    scores = spark.createDataFrame([(1, "a", 0.1560001), (1, "b", 0.1560004), (1, "c", 0.1550001)], "id long, node_id string, score double")
    names = spark.createDataFrame([(x, f"n{x}") for x in "abc"], "node_id string, name string")
    assert taxonomy.reasons(scores, names, "id", 3, shown=F.round("score", 6)).first()["reasons"] == ["nb (0.16)", "na (0.16)", "nc (0.15)"]


def test_no_alignment_beats_its_bound(spark):
    r = random.Random(8)
    pairs = [("".join(r.choice("abc é1") for _ in range(r.randrange(0, 15))), "".join(r.choice("abc é1") for _ in range(r.randrange(0, 15)))) for _ in range(400)]
    df = spark.createDataFrame([*pairs, ("", "")], "a string, b string")
    n = lambda c: SIM.letter_counts(F.col(c))
    for row in df.select("a", "b", SIM.ratio_bound(n("a"), n("b"), F.length("a"), F.length("b")).alias("bound")).collect():
        assert row["bound"] >= SequenceMatcher(None, row["a"], row["b"]).ratio() - 1e-12


def test_bounds_leave_few_titles_to_align_and_lose_no_match(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice(r.choice(["aeiou", "qxzw", "lmnrst", "bcdfg"])) for _ in range(r.randrange(3, 9)))
    titles = [f"effects light {' '.join(word() for _ in range(r.randrange(1, 7)))}" for _ in range(60)]
    titles += [t[:-1] + r.choice("ab") for t in titles[:15]]
    docs = spark.createDataFrame([(k, t, ["Ann Smith"] if k % 2 else []) for k, t in enumerate(titles)], "doc_id long, title string, authors array<string>")
    new, known = docs.withColumnRenamed("doc_id", "new_id"), docs.withColumnRenamed("doc_id", "known_id")
    pairs = dedup.fuzzy_title_pairs(new, known, others_only=True).cache()
    left = {(x["new_id"], x["known_id"]): x for x in dedup.open_pairs(pairs, new, known).collect()}
    keys = [x["k"] for x in docs.orderBy("doc_id").select(N.title_key(F.col("title")).alias("k")).collect()]
    assert pairs.count() > 3000 and len(left) < 0.5 * pairs.count()
    for x in pairs.collect():
        bonus = 0.1 if x["new_id"] % 2 and x["known_id"] % 2 else 0.0
        if SequenceMatcher(None, keys[x["new_id"]], keys[x["known_id"]]).ratio() + bonus >= 0.85:
            assert (x["new_id"], x["known_id"]) in left
    scored = {(x["new_id"], x["known_id"]): x["score"] for x in dedup.aligned_pairs(spark.createDataFrame(list(left.values()), "new_id long, known_id long, shared int, a string, b string, bonus double")).collect()}
    assert all(abs(s - SequenceMatcher(None, keys[i], keys[j]).ratio() - left[i, j]["bonus"]) < 1e-9 for (i, j), s in scored.items())


def test_copies_of_a_title_are_compared_once(spark, monkeypatch):
    rows = [(k, "daylight exposure improves classroom attention", ["Ann Smith"] if k % 2 else []) for k in range(80)] + [(k, "daylight exposure improves classroom attentions", ["Ann Smith"]) for k in range(80, 120)]
    rows += [(200, "daylight exposure improves bedroom attention", None), (201, "nothing like it anywhere", ["B. C"]), (202, None, [])]
    docs = spark.createDataFrame(rows, "doc_id long, title string, authors array<string>").repartition(3)
    new, known, seen, plain = docs.withColumnRenamed("doc_id", "new_id"), docs.withColumnRenamed("doc_id", "known_id"), [], dedup.aligned_pairs
    monkeypatch.setattr(dedup, "aligned_pairs", lambda pairs: seen.append(pairs.count()) or plain(pairs))
    got = {x["new_id"]: (x["known_id"], x["confidence"]) for x in dedup.fuzzy_title_matches(new, known, others_only=True).collect()}
    keys = {x["doc_id"]: (x["k"], set(x["t"])) for x in docs.select("doc_id", N.title_key(F.col("title")).alias("k"), N.key_terms(F.col("title")).alias("t")).collect()}
    smith = {k for k, _, names in rows if names == ["Ann Smith"]}
    want = {}
    for i, (a, t) in keys.items():
        for j, (b, _) in keys.items():
            shared = len(t & set(b.split(" ")))
            if i != j and t and shared >= min(2, len(t)):
                score = SequenceMatcher(None, a, b).ratio() + (0.1 if i in smith and j in smith else 0.0)
                if score >= 0.85:
                    want[i] = min(want.get(i, (0, 0, 0)), (-score, -shared, j))
    assert {i: (j, round(c, 9)) for i, (j, c) in got.items()} == {i: (j, round(-s if -s >= 0.95 else -s * 0.9, 9)) for i, (s, _, j) in want.items()} and len(got) == 121
    assert seen[0] < 30


def test_widespread_terms_are_no_key_of_a_shuffle_and_lose_no_pair(spark, monkeypatch):
    monkeypatch.setattr(dedup, "WIDESPREAD", 5)
    r = random.Random(3)
    titles = ["candlelight " + " ".join(r.choice(["dorm", "even", "word", "noise", "thermal", f"own{k}x"]) for _ in range(r.randrange(0, 4))) for k in range(60)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(titles)] + [(77, "candlelight")], "doc_id long, title string")
    new, known = docs.withColumnRenamed("doc_id", "new_id"), docs.where("title <> 'candlelight'").withColumnRenamed("doc_id", "known_id")
    got = {(x["new_id"], x["known_id"]): x["shared"] for x in dedup.fuzzy_title_pairs(new, known, others_only=True).collect()}
    keys = {x["doc_id"]: (set(x["k"].split(" ")), set(x["t"])) for x in docs.select("doc_id", N.title_key(F.col("title")).alias("k"), N.key_terms(F.col("title")).alias("t")).collect()}
    held = {x["known_id"] for x in known.collect()}
    assert got == {(i, j): len(t & keys[j][0]) for i, (_, t) in keys.items() for j in held if i != j and len(t & keys[j][0]) >= min(2, len(t))} and len(got) > 100
    sent, plain = [], dedup.small
    monkeypatch.setattr(dedup, "small", lambda df: sent.append([x["term"] for x in df.select("term").collect()]) or plain(df))
    dedup.fuzzy_title_pairs(new.where("new_id < 40 and size(split(title, ' ')) > 2"), known).collect()
    assert "candlelight" in sent[0] and len(sent) == 3


def test_hashed_embedding(spark):
    texts = ["one two two", "", None, "Three, three. THREE"]
    rows = taxonomy.embed(spark.createDataFrame([(t,) for t in texts], "t string"), F.col("t"), dim=8).collect()
    for t, row in zip(texts, rows):
        count = np.zeros(8)
        for w in "".join(c if c.isalnum() else " " for c in (t or "").lower()).split():
            h = xxhash.xxh64_intdigest(w, 42)
            count[(h - (1 << 64) if h >> 63 else h) % 8] += 1
        assert np.allclose(row["embedding"], count / (np.linalg.norm(count) + 1e-10))


def test_graph_edges_come_from_one_scan(spark, sf):
    from corpusloom.plans.corpus_queries import _claims, _papers

    plan = graph.edges(_papers(spark, sf), _claims(spark, sf))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey#") and plan.count("Relation [l_orderkey") == 1


def test_claim_keys_and_citations_are_dealt_out(spark, sf):
    from corpusloom.operators.sized import FEW_ROWS, HELD_ROWS, dealt
    from corpusloom.plans.catalogue import citation_parse

    df = spark.range(3 * FEW_ROWS + 1)
    assert dealt(df, "id").rdd.getNumPartitions() == 4 and HELD_ROWS <= 1_000_000 and dealt(df.limit(0), "id").rdd.getNumPartitions() == 1
    assert "Repartition" in citation_parse(spark, sf)._jdf.queryExecution().optimizedPlan().toString()


def test_titles_of_one_file_are_dealt_out_before_their_keys_are_made(spark, monkeypatch):
    monkeypatch.setattr(sized.spread, "__kwdefaults__", {"each": 50})
    docs = spark.range(200).coalesce(1).select(F.col("id").alias("known_id"), F.concat(F.lit("candlelight own"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij"), F.lit(" evening")).alias("title"), F.array().cast("array<string>").alias("authors"))
    tasks, plain = {}, dedup.materialise
    monkeypatch.setattr(dedup, "materialise", lambda df, tag: tasks.setdefault(tag, []).append(df.rdd.getNumPartitions()) or plain(df, tag))
    got = dedup.fuzzy_title_matches(docs.withColumnRenamed("known_id", "new_id"), docs).collect()
    assert len(got) == 200 and all(x["known_id"] == x["new_id"] and x["confidence"] == 1.0 for x in got)
    assert tasks["titles"] == [4, 4]


def test_names_of_files_are_parsed_once_and_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(sized.spread, "__kwdefaults__", {"each": 50})
    word = F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")
    rows = spark.range(200).coalesce(1).select("id", F.concat(F.lit("Candlelight own"), word, F.lit(" Evening")).alias("title"))
    files = rows.select(F.concat(F.lit("/in/Smith_2001_"), F.replace("title", F.lit(" "), F.lit("_")), F.lit(".pdf")).alias("path"))
    known = rows.select(F.col("id").alias("known_id"), F.lit(None).cast("string").alias("doi"), "title", F.array().cast("array<string>").alias("authors"), F.col("id").alias("seq"))
    tasks, plans, plain = {}, {}, dedup.materialise

    def seen(df, tag):
        tasks[tag], plans[tag] = df.rdd.getNumPartitions(), df._jdf.queryExecution().optimizedPlan().toString()
        return plain(df, tag)

    monkeypatch.setattr(dedup, "materialise", seen)
    monkeypatch.setattr(ingest, "materialise", seen, raising=False)
    got = {x["path"]: (x["known_id"], x["match_type"]) for x in ingest.match_files(files, known).collect()}
    assert got == {f"/in/Smith_2001_{x['title'].replace(' ', '_')}.pdf": (x["id"], "title_exact") for x in rows.collect()}
    assert [tasks[t] for t in ("names", "new", "known")] == [4, 4, 4] and "Smith" in plans["names"] and "regexp_extract" not in plans["exact"]


def test_rows_without_a_key_are_not_one_tasks(spark, monkeypatch):
    rows = [(f"n{k}", None if k % 3 else "", None if k % 2 else "The of", None) for k in range(60)] + [("x", "10.1/A", None, None), ("y", None, "daylight indoors", None)]
    new = spark.createDataFrame(rows, "new_id string, doi string, title string, authors array<string>")
    known = spark.createDataFrame([("a", "10.1/a", "the of", None, 1), ("b", "", "Indoors: daylight", None, 2), ("n1", None, None, None, 3)], "known_id string, doi string, title string, authors array<string>, seq int")
    plans, plain = {}, dedup.materialise
    monkeypatch.setattr(dedup, "materialise", lambda df, tag: plans.setdefault(tag, df) is None or plain(df, tag))
    got = {x["new_id"]: (x["known_id"], x["match_type"]) for x in dedup.check_duplicates(new, known).collect()}
    assert got == {r[0]: (None, None) for r in rows[:60]} | {"x": ("a", "doi"), "y": ("b", "title_exact")}
    assert "title_key" not in plans["exact"].columns and "regexp_replace" not in plans["exact"]._jdf.queryExecution().optimizedPlan().toString()
    everything = dedup.check_duplicates(new.where("new_id in ('x', 'y')"), known)
    assert {x["new_id"]: x["confidence"] for x in everything.collect()} == {"x": 1.0, "y": 0.95}
