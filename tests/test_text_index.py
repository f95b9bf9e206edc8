"""The text index against substring search, on texts of odd spaces, punctuation and repeats."""

import random

from pyspark.sql import functions as F

from corpusloom.operators import text_index as X


def test_find_equals_substring_search(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("abé.,\n") for _ in range(r.randrange(0, 4)))
    text = lambda n: " ".join(word() for _ in range(n))
    rows = [(k % 90, r.choice([text(r.randrange(1, 12)), None, "", " "]), r.choice([text(3).upper(), None])) for k in range(120)]
    phrases = [(k, text(r.choice([1, 1, 2, 3]))) for k in range(150)] + [(200, None), (201, ""), (202, "  "), (203, " a"), (204, "a "), (205, "a  b"), (206, " a b "), (207, "A B")]
    df = spark.createDataFrame(rows, "id long, title string, body string")
    index = X.build(df, id_col="id", fields=["title", "body"])
    got = {(x["q"], x["id"]) for x in X.find(index, spark.createDataFrame(phrases, "q long, phrase string")).collect()}
    want = {(q, i) for q, p in phrases if p and p.strip(" ") for i, *fields in rows if any(f is not None and p.lower() in f.lower() for f in fields)}
    assert got == want and len(want) > 300


def test_fallback_counts_only_where_nothing_is_scored(spark):
    papers = spark.createDataFrame([(1, "Light level and stress"), (2, "low light levels"), (3, "noise"), (4, None), (4, "light level, stress")], "id long, title string")
    index = X.build(papers, id_col="id", fields=["title"])
    scored = spark.createDataFrame([("env.light_level", 0), ("env.noise", 7), ("env.none", 0), ("outcome.stress", 0)], "node_id string, paper_count long")
    assert {tuple(r) for r in X.theory_counts(scored, index).collect()} == {("env.light_level", 3), ("env.noise", 7), ("env.none", 0), ("outcome.stress", 2)}
    cells = spark.createDataFrame([("env.light_level", "outcome.stress", 0), ("env.noise", "outcome.stress", 0), ("env.light_level", "env.noise", 5)], "factor_id string, outcome_id string, paper_count long")
    assert {tuple(r) for r in X.cell_counts(cells, index).collect()} == {("env.light_level", "outcome.stress", 2), ("env.noise", "outcome.stress", 0), ("env.light_level", "env.noise", 5)}


def test_empty_and_keyword_search(spark):
    df = spark.createDataFrame([], "id long, title string, year int")
    index = X.build(df, id_col="id", fields=["title"])
    assert X.find(index, spark.createDataFrame([(1, "a")], "q long, phrase string")).count() == 0
    df = spark.createDataFrame([(1, "Alpha beta", 1), (2, "alphabet", 2), (3, "gamma", 3)], "id long, title string, year int")
    index = X.build(df, id_col="id", fields=["title"])
    ask = lambda text, where=None, n=9: [r["id"] for r in X.keyword_search(df, index, text, id_col="id", where=where, order=[F.desc("year")], limit=n).collect()]
    assert ask("ALPHA") == [2, 1] and ask("a b") == [1] and ask(None) == [3, 2, 1] and ask("alpha", F.col("year") > 1) == [2] and ask("alpha", None, 1) == [2]


def test_tokens_are_pushed_into_the_scan(spark):
    df = spark.createDataFrame([(1, "one two"), (2, "two three")], "id long, title string")
    index = X.build(df, id_col="id", fields=["title"])
    plan = X.find(index, spark.createDataFrame([(1, "two")], "q long, phrase string"))._jdf.queryExecution().executedPlan().toString()
    assert "In(token" in plan or "EqualTo(token,two)" in plan


def test_index_is_written_without_a_shuffle_and_widespread_pieces_are_not_looked_up(spark):
    rows = [(k, f"the cat of word{k % 40} the end of it the {k}") for k in range(400)]
    df = spark.createDataFrame(rows, "id long, body string")
    index = X.build(df, id_col="id", fields=["body"])
    assert index.postings.count() == 400 * 8  # the distinct words of a text, and none twice but a first one that comes again
    held = []
    seen, X._holding = X._holding, lambda i, c, *a: held.append(c.count()) or seen(i, c, *a)
    try:
        got = X.find(index, spark.createDataFrame([(1, "e end of it the 7"), (2, "of word3 t")], "q long, phrase string")).groupBy("q").count().collect()
    finally:
        X._holding = seen
    want = {q: sum(p in t for _, t in rows) for q, p in ((1, "e end of it the 7"), (2, "of word3 t"))}
    assert {r["q"]: r["count"] for r in got} == want and held[0] <= 11 + 10


def test_cells_are_one_query_of_two_phrases(spark, monkeypatch):
    texts = [(0, "Visual cortex and soft fascination"), (1, "soft fascinations; no cortical term"), (2, "SOFT FASCINATION cortex"), (3, None), (4, "cortex alone"), (5, "unsoft fascination, cortex")]
    index = X.build(spark.createDataFrame(texts, "id long, text string"), id_col="id", fields=["text"])
    cells = [("theory.soft_fascination", "out.cortex", 0), ("theory.soft_fascination", "out.cort", 0), ("theory.cortex", "out.soft", 0), ("theory.cortex", "out.soft", 0), ("theory.none_such", "out.cortex", 0), ("a.cortex", "a.", 0), ("a.b", "a.c", 7)]
    asked, plain = [], X.matching_tokens
    monkeypatch.setattr(X, "matching_tokens", lambda i, pieces: asked.extend(r["kind"] for r in pieces.where("q like '%soft_fascination%'").collect()) or plain(i, pieces))
    got = {(r["factor_id"], r["outcome_id"]): r["paper_count"] for r in X.cell_counts(spark.createDataFrame(cells, "factor_id string, outcome_id string, paper_count long"), index).collect()}
    has = lambda *terms: sum(t is not None and all(x in t.lower() for x in terms) for _, t in texts)
    assert got == {cells[0][:2]: has("soft fascination", "cortex"), cells[1][:2]: has("soft fascination", "cort"), cells[2][:2]: has("cortex", "soft"), cells[4][:2]: 0, ("a.cortex", "a."): 0, ("a.b", "a.c"): 7}
    assert set(asked) == {"end", "start"}  # a widespread term of the other side is not looked up
