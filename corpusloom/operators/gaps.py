"""Coverage of the factor x outcome grid, gaps, and the queries that are to fill them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.sized import small
from corpusloom.operators.taxonomy import ancestors

# First matching rule (factor prefix, outcome prefix) gives a cell's priority.
PRIORITY_RULES = [
    ("env.luminous", "out.cognitive", "HIGH"),
    ("env.luminous", "out.circadian", "HIGH"),
    ("env.luminous", "out.affective", "HIGH"),
    ("env.spatial", "out.cognitive", "HIGH"),
    ("env.spatial", "out.social", "HIGH"),
    ("env.biophilic", "out.affective", "HIGH"),
    ("env.biophilic", "out.physiological", "HIGH"),
    ("env.acoustic", "out.cognitive", "HIGH"),
    ("env.acoustic", "out.affective", "HIGH"),
    ("env.thermal", "out.cognitive", "HIGH"),
    ("env.air", "out.cognitive", "HIGH"),
    ("env.air", "out.physiological", "HIGH"),
    ("env.visual", "out.circadian", "LOW"),
    ("env.materials", "out.circadian", "LOW"),
]
# Theories (term, other term) whose testing is followed up.
THEORIES = [("attention restoration", "ART"), ("stress recovery", "SRT"), ("biophilia", "biophilia hypothesis"), ("prospect refuge", "prospect-refuge"), ("affordance", "Gibson affordances")]


def grid(factors: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Every factor with every outcome. Both come from the taxonomy, whose size is checked before the broadcast."""
    return factors.select(F.col("node_id").alias("factor_id")).join(small(outcomes.select(F.col("node_id").alias("outcome_id"))), how="cross")


def rolled_up(scores: DataFrame, entity: str, *, least: float = 0.4) -> DataFrame:
    """(entity, node): every node at or above one the entity scores on, once. Subtree counts are then equi-joins."""
    return scores.where(F.col("score") >= least).select(entity, F.explode(ancestors(F.col("node_id"))).alias("node")).distinct()


def pair_evidence(rolled: DataFrame, factors: DataFrame, outcomes: DataFrame, entity: str, name: str) -> DataFrame:
    """(factor_id, outcome_id, name): entities under both, for all cells at once."""
    f = rolled.join(small(factors.select(F.col("node_id").alias("node"))), "node", "left_semi").select(entity, F.col("node").alias("factor_id"))
    o = rolled.join(small(outcomes.select(F.col("node_id").alias("node"))), "node", "left_semi").select(entity, F.col("node").alias("outcome_id"))
    return f.join(o, entity).groupBy("factor_id", "outcome_id").agg(F.count("*").alias(name))


def claim_evidence(claims: DataFrame) -> DataFrame:
    """(factor_id, outcome_id, claim_count, has_mechanism, has_neural), constructs rolled up to their ancestors."""
    up = lambda c: F.explode(F.array_distinct(F.flatten(F.transform(F.filter(c, lambda x: x["id"].isNotNull()), lambda x: ancestors(x["id"])))))
    f = claims.select("claim_id", "claim_type", F.exists(F.coalesce(F.col("outcomes"), F.array().cast("array<struct<id:string,role:string,direction:string>>")), lambda x: F.contains(F.coalesce(x["id"], F.lit("")), F.lit("neural"))).alias("neural"), up(F.col("environment_factors")).alias("factor_id"))
    o = claims.select("claim_id", up(F.col("outcomes")).alias("outcome_id"))
    return f.join(o, "claim_id").groupBy("factor_id", "outcome_id").agg(F.count("*").alias("claim_count"), F.bool_or(F.col("claim_type") == "mechanistic").alias("has_mechanism"), F.bool_or("neural").alias("has_neural"))


def coverage_score(papers: Column, claims: Column, mechanism: Column, neural: Column) -> Column:
    """0.4 papers (10 are full) + 0.3 claims (5 are full) + 0.15 mechanism + 0.15 neural, two digits, half to even."""
    raw = 0.4 * F.least(F.lit(1.0), papers / 10) + 0.3 * F.least(F.lit(1.0), claims / 5) + F.when(mechanism, 0.15).otherwise(0.0) + F.when(neural, 0.15).otherwise(0.0)
    return F.bround(raw, 2)


def coverage(cells: DataFrame, papers: DataFrame, claims: DataFrame) -> DataFrame:
    keys = ["factor_id", "outcome_id"]
    joined = cells.join(papers, keys, "left").join(claims, keys, "left").fillna({"paper_count": 0, "claim_count": 0, "has_mechanism": False, "has_neural": False})
    return joined.withColumn("coverage_score", coverage_score(F.col("paper_count"), F.col("claim_count"), F.col("has_mechanism"), F.col("has_neural")))


def _gap(df: DataFrame, kind: str, ident: Column, priority: Column, evidence: Column) -> DataFrame:
    order = {"coverage": 0, "theory": 1, "mechanism": 2, "neural": 3}[kind]
    return df.select(F.concat(F.lit(f"{kind}:"), ident).alias("gap_id"), F.lit(kind).alias("gap_type"), priority.cast("double").alias("priority"), evidence.cast("long").alias("existing_evidence"), F.lit(order).alias("kind_order"))


def coverage_gaps(cov: DataFrame, *, least: float = 0.3) -> DataFrame:
    return _gap(cov.where(F.col("coverage_score") < least), "coverage", F.concat_ws("_", "factor_id", "outcome_id"), 1.0 - F.col("coverage_score"), F.col("paper_count"))


def theory_gaps(theories: DataFrame) -> DataFrame:
    """``theories``: node_id, paper_count. Under 5 papers is a gap, none at all an urgent one."""
    return _gap(theories.where("paper_count < 5"), "theory", F.col("node_id"), F.when(F.col("paper_count") == 0, 0.8).otherwise(0.6), F.col("paper_count"))


def mechanism_gaps(cov: DataFrame) -> DataFrame:
    return _gap(cov.where("paper_count >= 3 and not has_mechanism"), "mechanism", F.concat_ws("_", "factor_id", "outcome_id"), F.lit(0.7), F.col("paper_count"))


def neural_gaps(cells: DataFrame, *, top: int = 50) -> DataFrame:
    """``cells``: factor_id, outcome_id, paper_count of neural outcomes. Under 2 papers; the first ``top`` by id."""
    return _gap(cells.where("paper_count < 2"), "neural", F.concat_ws("_", "factor_id", "outcome_id"), F.lit(0.75), F.col("paper_count")).orderBy("gap_id").limit(top)


def ranked_gaps(*kinds: DataFrame, limit: int | None = None) -> DataFrame:
    """All gaps once, by priority, kind, id."""
    out = reduce(lambda a, b: a.unionByName(b), kinds)
    out = out.groupBy("gap_id").agg(F.max_by(F.struct("gap_type", "priority", "existing_evidence", "kind_order"), "priority").alias("g")).select("gap_id", "g.*").orderBy(F.desc("priority"), "kind_order", "gap_id")
    return out.limit(limit) if limit else out


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def coverage_queries(f_seeds: Column, o_seeds: Column) -> Column:
    """3 x 2 seeds crossed, two context queries behind them, 8 at most."""
    crossed = F.flatten(F.transform(F.slice(f_seeds, 1, 3), lambda f: F.transform(F.slice(o_seeds, 1, 2), lambda o: F.concat(_quoted(f), F.lit(" AND "), _quoted(o)))))
    first = F.get(f_seeds, F.lit(0))
    context = F.filter(F.array(F.concat(_quoted(first), F.lit(" building occupants")), F.concat(_quoted(first), F.lit(" indoor environment effect"))), lambda x: x.isNotNull())
    return F.slice(F.concat(crossed, context), 1, 8)


def theory_queries(seeds: Column, name: Column) -> Column:
    by_seed = F.flatten(F.transform(F.slice(seeds, 1, 3), lambda s: F.array(F.concat(_quoted(s), F.lit(" empirical study")), F.concat(_quoted(s), F.lit(" experiment")))))
    by_name = F.filter(F.array(F.concat(_quoted(name), F.lit(" test evidence")), F.concat(_quoted(name), F.lit(" architecture environment"))), lambda x: x.isNotNull())
    return F.slice(F.concat(by_seed, by_name), 1, 6)


def mechanism_queries(f_seeds: Column, o_seeds: Column) -> Column:
    f, o = F.get(f_seeds, F.lit(0)), F.get(o_seeds, F.lit(0))
    each = [F.concat(_quoted(f), F.lit(f" {w} "), _quoted(o)) for w in ("mechanism", "mediates", "pathway")] + [F.concat(F.lit("how "), f, F.lit(" affects "), o)]
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def neural_queries(f_seeds: Column, n_seeds: Column, n_id: Column, n_name: Column, f_name: Column) -> Column:
    f = F.get(f_seeds, F.lit(0))
    each = [F.concat(_quoted(f), F.lit(" "), _quoted(F.get(n_seeds, F.lit(0)))), F.concat(_quoted(f), F.lit(" "), n_name, F.lit(" brain")), F.when(n_name.isNotNull(), F.concat(f, F.lit(" neural correlates"))), F.when(F.contains(n_id, F.lit("eeg")), F.concat(f_name, F.lit(" EEG study"))), F.when(F.contains(n_id, F.lit("fmri")), F.concat(f_name, F.lit(" fMRI neuroimaging")))]
    return F.slice(F.filter(F.array(*each), lambda x: x.isNotNull()), 1, 5)


def priority_queries(gaps: DataFrame, queries: str, *, limit: int | None = None) -> DataFrame:
    """(query, gap_id, priority): every distinct query with the most urgent gap it serves."""
    each = gaps.select("gap_id", "priority", F.posexplode(queries).alias("pos", "query"))
    best = each.groupBy("query").agg(F.min(F.struct((-F.col("priority")).alias("p"), "gap_id", "pos")).alias("b")).select("query", F.col("b.gap_id").alias("gap_id"), (-F.col("b.p")).alias("priority"), F.col("b.pos").alias("pos"))
    out = best.orderBy(F.desc("priority"), "gap_id", "pos").drop("pos")
    return out.limit(limit) if limit else out


def coverage_summary(cov: DataFrame) -> DataFrame:
    return cov.agg(F.count("*").alias("cells"), F.count_if(F.col("paper_count") > 0).alias("covered"), F.count_if(F.col("coverage_score") < 0.3).alias("gaps"), F.count_if("has_mechanism").alias("with_mechanism"), F.count_if("has_neural").alias("with_neural"), F.avg("coverage_score").alias("mean_coverage"))


def priority(factor: Column, outcome: Column, rules: list[tuple[str, str, str]] = PRIORITY_RULES, default: str = "MEDIUM") -> Column:
    """The priority of the first rule whose prefixes both match."""
    return F.coalesce(*[F.when(F.startswith(factor, F.lit(f)) & F.startswith(outcome, F.lit(o)), p) for f, o, p in rules], F.lit(default))


def search_cells(factors: DataFrame, outcomes: DataFrame, theories: DataFrame) -> DataFrame:
    """Cells of the four families: cell_id, cell_type, factor_id, outcome_id, priority."""
    g = grid(factors, outcomes).withColumn("priority", priority(F.col("factor_id"), F.col("outcome_id")))
    cell = lambda df, kind, prefix, prio: df.select(F.concat(F.lit(prefix), F.concat_ws("_", "factor_id", "outcome_id")).alias("cell_id"), F.lit(kind).alias("cell_type"), "factor_id", "outcome_id", prio.alias("priority"))
    t = theories.select(F.concat(F.lit("theory:"), "node_id").alias("cell_id"), F.lit("theory").alias("cell_type"), F.col("node_id").alias("factor_id"), F.lit("").alias("outcome_id"), F.lit("HIGH").alias("priority"))
    return cell(g, "factor_outcome", "", F.col("priority")).unionByName(t).unionByName(cell(g.where(F.contains("outcome_id", F.lit("neural"))), "neural", "neural:", F.lit("HIGH"))).unionByName(cell(g.where("priority = 'HIGH'"), "mechanism", "mechanism:", F.lit("MEDIUM")))


def cells_from_gaps(gaps: DataFrame, known: DataFrame) -> DataFrame:
    new = gaps.select(F.concat(F.lit("gap:"), "gap_id").alias("cell_id"), F.col("gap_type").alias("cell_type"), F.when(F.col("priority") > 0.7, "HIGH").otherwise("MEDIUM").alias("priority"))
    return new.join(known.select("cell_id"), "cell_id", "left_anti")


def select_cells(cells: DataFrame, *, prio: str | None = None, kind: str | None = None) -> DataFrame:
    """Cells to work on: by priority, theory and neural ones first, then by id; ``order`` is their place."""
    out = cells.where(F.col("priority") == prio) if prio else cells
    out = out.where(F.col("cell_type") == kind) if kind else out
    rank = lambda c, names: F.coalesce(F.array_position(F.array(*map(F.lit, names)), c), F.lit(9))
    return out.orderBy(rank(F.col("priority"), ["HIGH", "MEDIUM", "LOW"]), rank(F.col("cell_type"), ["theory", "neural", "mechanism", "factor_outcome"]), "cell_id")


def cell_status(cells: DataFrame, *, min_papers: int = 3) -> DataFrame:
    return cells.groupBy("priority").agg(F.count("*").alias("cells"), F.count_if(F.col("status") == "complete").alias("complete"), F.sum("papers_found").alias("papers"), F.count_if(F.coalesce("papers_found", F.lit(0)) < min_papers).alias("under_filled"))


def follow_up_queries(claims: DataFrame) -> DataFrame:
    """Queries that claims call for: a causal claim without a mechanism for its first factor, theories under 3 mentions, moderators."""
    causal = claims.where("claim_type = 'causal'").select("paper_id", "claim_id", F.get("environment_factors", F.lit(0)).alias("iv"), F.get("outcomes", F.lit(0)).alias("dv"))
    mech = claims.where("claim_type = 'mechanistic'").select(F.explode("environment_factors.id").alias("m__")).distinct()
    words = lambda c: F.translate(c, "_", " ")
    mechanism = causal.join(mech, F.col("iv.id") == F.col("m__"), "left_anti").where("iv.role <> '' and dv.role <> ''").select(F.concat(_quoted(words(F.col("iv.role"))), F.lit(" mechanism "), _quoted(words(F.col("dv.role"))), F.lit(" pathway")).alias("query"), F.lit("mechanism").alias("gap_type"), F.lit(0.75).alias("priority"), "paper_id", "claim_id")
    boundary = claims.where("claim_type = 'moderated' or size(moderators) > 0").select("paper_id", "claim_id", F.explode(F.slice("moderators", 1, 2)).alias("m")).where("m.id <> ''").select(F.concat(_quoted(words(F.col("m.id"))), F.lit(" moderator effect boundary")).alias("query"), F.lit("boundary").alias("gap_type"), F.lit(0.6).alias("priority"), "paper_id", "claim_id")
    hit = lambda t, alt: F.contains(F.lower("statement"), F.lit(t)) | F.col("statement").rlike(rf"\b{alt}\b")
    n = claims.agg(*[F.count_if(hit(t, a)).alias(f"n{i}") for i, (t, a) in enumerate(THEORIES)])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col(f"n{i}").alias("n")) for i, (t, _) in enumerate(THEORIES)]))
    theory = n.select(each.alias("x")).where("x.n < 3").select(F.explode(F.array(F.struct(F.concat(_quoted(F.col("x.t")), F.lit(" empirical test evidence")).alias("query"), F.lit(0.8).alias("priority")), F.struct(F.concat(_quoted(F.col("x.t")), F.lit(" experiment built environment")).alias("query"), F.lit(0.75).alias("priority")))).alias("q")).select("q.query", F.lit("theory").alias("gap_type"), "q.priority", F.lit(None).cast("string").alias("paper_id"), F.lit(None).cast("string").alias("claim_id"))
    out = mechanism.unionByName(boundary).unionByName(theory)
    return out.groupBy("query").agg(F.max_by(F.struct("gap_type", "priority", "paper_id", "claim_id"), F.struct("priority", "claim_id")).alias("f")).select("query", "f.*")


def feedback_summary(follow_up: DataFrame) -> DataFrame:
    """Follow-up queries by the kind of gap: how many, from how many papers, how urgent."""
    return follow_up.groupBy("gap_type").agg(F.count("*").alias("queries"), F.countDistinct("paper_id").alias("papers"), F.avg("priority").alias("mean_priority"), F.max("priority").alias("highest"))


def reset_cells(cells: DataFrame, chosen: DataFrame, counters: list[str]) -> DataFrame:
    """``cells`` with the ``chosen`` (cell_id) pending again, their counters at 0 and without an error."""
    hit = cells.join(chosen.select(F.col("cell_id").alias("c__")).distinct(), F.col("cell_id") == F.col("c__"), "left")
    again = F.col("c__").isNotNull()
    changes = {"status": F.when(again, "pending").otherwise(F.col("status")), "error": F.when(~again, F.col("error"))} | {c: F.when(again, 0).otherwise(F.col(c)) for c in counters}
    return hit.withColumns(changes).select(*cells.columns)
