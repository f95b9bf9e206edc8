"""Meta-analysis over claims, contradictions, claim verification and value of information."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.normalize import fixed
from corpusloom.operators.sized import small

# Words that tell the direction of a statement, tested in this order.
POSITIVE_WORDS = ["increase", "improve", "enhance", "positive", "higher", "better", "more"]
NEGATIVE_WORDS = ["decrease", "reduce", "impair", "negative", "lower", "worse", "less"]


def mentions(text: Column, terms: list[str]) -> Column:
    plain = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda a, b: a | b, (F.contains(plain, F.lit(t)) for t in terms))


def direction(claim_type: Column, statement: Column, *, positive: list[str] = POSITIVE_WORDS, negative: list[str] = NEGATIVE_WORDS) -> Column:
    return F.when(claim_type == "null", "null").when(mentions(statement, positive), "positive").when(mentions(statement, negative), "negative").otherwise("unknown")


def weight(variance: Column, n: Column) -> Column:
    """1 / variance, else the sample size, else 1."""
    return F.coalesce(F.when(variance > 0, 1 / variance), F.when(n > 0, n.cast("double")), F.lit(1.0))


def pooled(effects: DataFrame, key: str, effect: str, w: Column) -> DataFrame:
    """Fixed-effect pool of every key: n, pooled, se, confidence interval, Q, I squared and its band.

    Two passes of partial aggregates: the mean first, then squares around it, which keeps Q exact where
    the one-pass formula cancels.
    """
    rows = effects.where(F.col(effect).isNotNull()).select(key, F.col(effect).alias("x__"), w.alias("w__"))
    mean = rows.groupBy(key).agg(F.count("*").alias("n_with_effect"), (F.sum(F.col("w__") * F.col("x__")) / F.sum("w__")).alias("pooled_effect"), F.sqrt(1 / F.sum("w__")).alias("pooled_se"))
    q = rows.join(mean.select(key, "pooled_effect"), key).groupBy(key).agg(F.sum(F.col("w__") * F.pow(F.col("x__") - F.col("pooled_effect"), 2)).alias("q"))
    df = F.col("n_with_effect") - 1
    i2 = F.when(df < 1, None).when(F.col("q") > 0, F.greatest(F.lit(0.0), (F.col("q") - df) / F.col("q") * 100)).otherwise(0.0)
    out = mean.join(q, key).withColumn("i_squared", i2)
    return out.select(key, "n_with_effect", "pooled_effect", "pooled_se", (F.col("pooled_effect") - 1.96 * F.col("pooled_se")).alias("ci_lower"), (F.col("pooled_effect") + 1.96 * F.col("pooled_se")).alias("ci_upper"), F.when(df >= 1, F.col("q")).alias("q_statistic"), "i_squared", F.when(F.col("i_squared") < 25, "low").when(F.col("i_squared") < 75, "moderate").when(F.col("i_squared").isNotNull(), "high").alias("heterogeneity"))


def vote(rows: DataFrame, key: str, way: Column) -> DataFrame:
    """Counts of the directions of every key and the one that leads; positive and negative without a leader is mixed."""
    n = rows.withColumn("d__", way).groupBy(key).agg(F.count("*").alias("n_claims"), *[F.count_if(F.col("d__") == d).alias(f"n_{d}") for d in ("positive", "negative", "null")])
    p, m, z = F.col("n_positive"), F.col("n_negative"), F.col("n_null")
    return n.withColumn("overall", F.when((p > m) & (p > z), "positive").when((m > p) & (m > z), "negative").when((z > p) & (z > m), "null").when((p > 0) & (m > 0), "mixed").otherwise("unknown"))


def contradictions(rows: DataFrame, key: str, id_col: str, way: str, *, effects: int = 5, nulls: int = 3, cap: int = 20) -> DataFrame:
    """Per key the first five positive claims with the first five negative ones, and the first five effects with the
    first three null ones, up to ``cap``: a report of examples, ordered by id. ``opposed`` has all of them."""
    w = Window.partitionBy(key, way).orderBy(id_col)
    first = rows.where(F.col(way).isin("positive", "negative", "null")).withColumn("r__", F.row_number().over(w)).where(F.col("r__") <= effects)
    side = lambda d, a, r: first.where(F.col(way) == d).select(key, F.col(id_col).alias(a), F.col("r__").alias(r))
    pairs = side("positive", "claim_1", "r1").join(side("negative", "claim_2", "r2"), key).select(key, F.lit("direction_conflict").alias("type"), "claim_1", "claim_2", F.lit(0).alias("o__"), "r1", "r2")
    ranked = first.where(F.col(way) != "null").withColumn("e__", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(way), "r__"))).where(F.col("e__") <= effects).select(key, F.col(id_col).alias("claim_1"), F.col("e__").alias("r1"))
    against = ranked.join(side("null", "claim_2", "r2").where(F.col("r2") <= nulls), key).select(key, F.lit("effect_vs_null").alias("type"), "claim_1", "claim_2", F.lit(1).alias("o__"), "r1", "r2")
    order = Window.partitionBy(key).orderBy("o__", "r1", "r2")
    return pairs.unionByName(against).withColumn("n__", F.row_number().over(order)).where(F.col("n__") <= cap).select(key, "type", "claim_1", "claim_2")


def opposed(rows: DataFrame, key: str, id_col: str, way: str) -> DataFrame:
    """(key, id, way, n_conflicts, n_against_null): every claim that contradicts another of its key, with the number of its pairs.

    All contradictions without a row for each: a pair is every positive claim of a key with every negative one, and every
    positive or negative one with every null one.
    """
    told = rows.where(F.col(way).isin("positive", "negative", "null")).select(key, id_col, F.col(way).alias("way"))
    n = told.groupBy(F.col(key).alias("key__")).agg(*[F.count_if(F.col("way") == d).alias(f"{d}__") for d in ("positive", "negative", "null")])
    is_ = lambda d: F.col("way") == d
    conflicts = F.when(is_("positive"), F.col("negative__")).when(is_("negative"), F.col("positive__")).otherwise(0)
    against = F.when(is_("null"), F.col("positive__") + F.col("negative__")).otherwise(F.col("null__"))
    met = told.join(small(n), F.col(key).eqNullSafe(F.col("key__")))
    return met.select(key, id_col, "way", conflicts.alias("n_conflicts"), against.alias("n_against_null")).where("n_conflicts + n_against_null > 0")


def moderated(claims: DataFrame, key: str) -> DataFrame:
    """Keys with two moderated claims or more."""
    return claims.where("claim_type = 'moderated'").groupBy(key).agg(F.count("*").alias("n")).where("n >= 2")


def forest_rows(effects: DataFrame, key: str, order: str, effect: str, low: str, high: str) -> DataFrame:
    """A row a study, numbered within its ``key``; a missing bound is 0.2 away."""
    w = Window.partitionBy(key).orderBy(order)
    e = F.col(effect)
    return effects.where(e.isNotNull()).withColumn("label", F.concat(F.lit("Study "), F.row_number().over(w).cast("string"))).select(key, "label", order, e.alias("effect"), F.coalesce(low, e - 0.2).alias("ci_lower"), F.coalesce(high, e + 0.2).alias("ci_upper"))


def synthesise(claims: DataFrame, key: str) -> DataFrame:
    """Votes and pool of every key. ``claims``: key, claim_id, claim_type, statement, effect; one row a claim and key."""
    votes = vote(claims, key, direction(F.col("claim_type"), F.col("statement")))
    return votes.join(pooled(claims, key, "effect", F.lit(1.0)), key, "left")


def summary_text(n: Column, overall: Column, effect: Column) -> Column:
    return F.concat(F.format_string("%d claims, overall direction %s", n, overall), F.coalesce(F.concat(F.lit(", pooled effect "), fixed(effect, 3)), F.lit("")))


def claim_relevance(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """(paper_id, n_claims, mean overlap, status) of claim words with title and abstract words; under 0.1 warns."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z]{5,})"), 1))
    p = papers.select("paper_id", words(F.concat_ws(" ", "title", "abstract")).alias("pw"))
    met = claims.join(p, "paper_id").withColumn("cw", words(F.col("statement"))).where(F.size("cw") > 0)
    score = met.groupBy("paper_id").agg(F.count("*").alias("n_claims"), F.avg(F.size(F.array_intersect("cw", "pw")) / F.size("cw")).alias("relevance"))
    return score.withColumn("status", F.when(F.col("relevance") < 0.1, "warning").otherwise("pass"))


def missing_fields(df: DataFrame, required: list[str]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required]), lambda x: x.isNotNull())


def rule_problems(polarities: tuple[str, ...]) -> Column:
    """Names of what is wrong with a rule row: sides missing, polarity outside the vocabulary."""
    checks = [(F.coalesce(F.size("lhs"), F.lit(0)) <= 0, "missing_lhs"), (F.coalesce(F.size("rhs"), F.lit(0)) <= 0, "missing_rhs"), (F.col("polarity").isNotNull() & ~F.col("polarity").isin(*polarities), "bad_polarity")]
    return F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in checks]), lambda x: x.isNotNull())


def value_of_information(prior: Column, untested: Column, confidence: Column, quantitative: Column, chain: Column, narrow: Column) -> Column:
    """0.3 prior + 0.2 untested + 0.2 confidence + 0.1 quantitative + 0.1 for a chain of 2 - 0.1 narrow, in 0 to 1, two digits."""
    one = lambda c, w: F.when(c, w).otherwise(0.0)
    raw = 0.3 * prior + one(untested, 0.2) + 0.2 * confidence + one(quantitative, 0.1) + one(chain >= 2, 0.1) - one(narrow, 0.1)
    return F.bround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 2)


def theory_relevance(text: Column, outcome: Column, theory_names: Column, statement: Column, env_types: Column) -> Column:
    """Relevance of a text to a prediction: 0.3 outcome words, 0.3 a name of its theory, 0.2 statement words, 0.2 an environment."""
    plain = F.lower(text)
    ow = F.split(F.translate(F.lower(outcome), "_", " "), " ")
    o = 0.3 * F.size(F.filter(ow, lambda t: (F.length(t) > 3) & F.contains(plain, t))) / F.greatest(F.size(ow), F.lit(1))
    sw = F.slice(F.filter(F.split(F.lower(statement), " "), lambda t: F.length(t) > 4), 1, 10)
    hits = F.size(F.filter(sw, lambda t: F.contains(plain, t)))
    s = F.when(hits >= 2, 0.2 * F.least(F.lit(1.0), hits / 5)).otherwise(0.0)
    any_of = lambda c: F.exists(c, lambda t: (t != "") & F.contains(plain, F.translate(F.lower(t), "_", " ")))
    return o + F.when(any_of(theory_names), 0.3).otherwise(0.0) + s + F.when(any_of(env_types), 0.2).otherwise(0.0)
