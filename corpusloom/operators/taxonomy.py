"""Taxonomy, centroids, scoring and triage."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.normalize import blank_to_null, fixed
from corpusloom.functions.similarity import unit
from corpusloom.operators import scoring
from corpusloom.operators.sized import small

def flatten_tree(trees: dict[str, list[dict]]) -> list[tuple]:
    """facet -> nested nodes (id, name, description, seeds, children) as rows of FACET_NODES."""
    rows: list[tuple] = []

    def walk(nodes: list[dict], facet: str, parent: str | None, level: int) -> None:
        for n in nodes or []:
            rows.append((n["id"], facet, parent, level, n.get("name"), n.get("description"), list(n.get("seeds") or [])))
            walk(n.get("children"), facet, n["id"], level + 1)

    for facet, nodes in trees.items():
        walk(nodes, facet, None, 1)
    return rows


def subtree(nodes: DataFrame, root: str, *, max_level: int | None = None) -> DataFrame:
    """A node and all below it by dotted path, so that ``env.air`` does not take ``env.airflow`` along."""
    out = nodes.where((F.col("node_id") == root) | F.startswith("node_id", F.lit(root + ".")))
    return out.where(F.col("level") <= max_level) if max_level else out


def seeds_of(nodes: DataFrame, root: str) -> DataFrame:
    """(node_id, seed): the seeds of a node and of all below it."""
    return subtree(nodes, root).select("node_id", F.explode("seeds").alias("seed"))


def ancestors(path: Column) -> Column:
    """The path and every prefix of it at a dot."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def tree_summary(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("facet_id", "level").agg(F.count("*").alias("nodes"), F.count_if(F.size("seeds") > 0).alias("with_seeds"))


def centroids(vectors: DataFrame, key: str, embedding: str = "embedding", *, normalise: bool = True) -> DataFrame:
    """(key, centroid): the mean vector of every key, of unit length.

    Positions are exploded and averaged by a partial aggregate, so a hot key costs each task one row a position.
    """
    means = vectors.select(key, F.posexplode(F.transform(embedding, lambda x: x.cast("double")))).groupBy(key, "pos").agg(F.avg("col").alias("m"))
    out = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda x: x["m"]).alias("centroid"))
    return out.withColumn("centroid", unit(F.col("centroid"))) if normalise else out


def blend(own: Column, parent: Column, weight: float = 0.7) -> Column:
    """``weight`` of the own vector and the rest of the parent's, of unit length; whichever exists if one is null."""
    return F.when(own.isNull(), parent).when(parent.isNull(), own).otherwise(unit(F.zip_with(own, parent, lambda a, b: a * weight + b * (1 - weight))))


def hierarchical_centroids(nodes: DataFrame, own: DataFrame, *, levels: int = 3) -> DataFrame:
    """(node_id, centroid), level by level: 0.7 own + 0.3 parent; a node without seeds takes its parent's."""
    base = nodes.select("node_id", "parent_id", "level").join(own, "node_id", "left")
    done = base.where("level = 1").select("node_id", "centroid")
    out = done
    for level in range(2, levels + 1):
        parents = done.select(F.col("node_id").alias("p__"), F.col("centroid").alias("c__"))
        done = base.where(F.col("level") == level).join(parents, F.col("parent_id") == F.col("p__"), "left").select("node_id", blend(F.col("centroid"), F.col("c__")).alias("centroid"))
        out = out.unionByName(done)
    return out.where("centroid is not null")


def node_scores(vectors: DataFrame, nodes: DataFrame, *, id_col: str, embedding: str = "embedding", least: float = 0.25, clip: bool = False) -> DataFrame:
    """Cosine of every vector to every node, ``least`` or more, as matrix products (see ``scoring``). ``nodes``: node_id, facet_id, level, centroid."""
    return scoring.pairs(vectors, nodes, id_col=id_col, embedding=embedding, least=least, clip=clip)


def top_nodes(scores: DataFrame, id_col: str, k: int = 20, *, by: list[str] = ()) -> DataFrame:
    """The ``k`` best nodes of every document (and of every further key in ``by``)."""
    w = Window.partitionBy(id_col, *by).orderBy(F.col("score").desc(), "node_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def facet_max(scores: DataFrame, id_col: str) -> DataFrame:
    return scores.groupBy(id_col, "facet_id").agg(F.max("score").alias("score"))


def triage(facets: DataFrame, id_col: str, *, core: tuple[str, str] = ("environmental_factors", "outcomes"), send: float = 0.70, review: float = 0.40) -> DataFrame:
    """0.7 of the mean over the two core facets (a missing one is 0) + 0.3 of the mean over the others present; then three ways."""
    is_core = F.col("facet_id").isin(list(core))
    agg = facets.groupBy(id_col).agg((F.coalesce(F.sum(F.when(is_core, F.col("score"))), F.lit(0.0)) / len(core)).alias("c__"), F.coalesce(F.avg(F.when(~is_core, F.col("score"))), F.lit(0.0)).alias("o__"))
    return agg.select(id_col, (0.7 * F.col("c__") + 0.3 * F.col("o__")).alias("triage_score")).withColumn("decision", decide(F.col("triage_score"), send, review))


def decide(score: Column, send: float = 0.70, review: float = 0.40) -> Column:
    return F.when(score >= send, "send_to_eater").when(score >= review, "review").otherwise("reject")


def reasons(scores: DataFrame, names: DataFrame, id_col: str, k: int = 5, *, shown: Column | None = None) -> DataFrame:
    """The ``k`` best nodes as ``name (0.00)``, best first by the unrounded score; ``shown`` is written in its place."""
    top = top_nodes(scores, id_col, k).withColumn("s", fixed(shown if shown is not None else F.col("score"))).join(small(names.select("node_id", "name")), "node_id")
    return top.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.format_string("%s (%s)", "name", "s").alias("s")))), lambda x: x["s"]).alias("reasons"))


def domain_decision(scores: DataFrame, domain: DataFrame, id_col: str, *, reject: float = 0.3, strong_l2: float = 0.7, strong_l3: float = 0.65) -> DataFrame:
    """Below the domain limit: reject; a strong level 3 or level 2 node: send; else review. ``domain``: id, domain_score."""
    best = scores.groupBy(id_col).agg(F.max(F.when(F.col("level") == 3, F.col("score"))).alias("l3"), F.max(F.when(F.col("level") == 2, F.col("score"))).alias("l2"))
    d = F.when(F.col("domain_score") < reject, "reject").when((F.col("l3") >= strong_l3) | (F.col("l2") >= strong_l2), "send_to_eater").otherwise("review")
    return domain.join(best, id_col, "left").select(id_col, "domain_score", d.alias("decision"))


def decisions(triaged: DataFrame, id_col: str) -> DataFrame:
    """Number of documents by decision (the ids stay where they are: they are not gathered into lists)."""
    return triaged.groupBy("decision").agg(F.count("*").alias("n"), F.min(id_col).alias("first_id"), F.avg("triage_score").alias("mean_score"))


def score_buckets(scores: DataFrame, score: str, *, edges: tuple = (0.2, 0.4, 0.6, 0.8)) -> DataFrame:
    """Counts of five score ranges, the last one closed, and of rows without a score."""
    c = F.col(score)
    label = F.when(c.isNull(), "unscored")
    low = 0.0
    for e in edges:
        label = label.when(c < e, f"{low:.1f}-{e:.1f}")
        low = e
    return scores.groupBy(label.otherwise(f"{low:.1f}-1.0").alias("bucket")).agg(F.count("*").alias("n"))


def needs_scoring(papers: DataFrame, *, version: str | None = None) -> DataFrame:
    """Rows without a score (null or 0), or scored by another version of the taxonomy."""
    missing = F.coalesce("triage_score", F.lit(0.0)) == 0
    return papers.where(missing | ~F.col("taxonomy_version").eqNullSafe(F.lit(version)) if version else missing)


def expansion_score(facets: DataFrame, id_col: str, *, priority: tuple = ("environmental_factors", "outcomes"), core: tuple = ("settings", "methodology")) -> DataFrame:
    """Weighted mean of the facet maxima: priority facets 2, core facets 1.5, others 1; and the five best facets."""
    w = F.when(F.col("facet_id").isin(list(priority)), 2.0).when(F.col("facet_id").isin(list(core)), 1.5).otherwise(1.0)
    top = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), F.col("facet_id").alias("facet")))), 1, 5)
    return facets.groupBy(id_col).agg((F.sum(w * F.col("score")) / F.sum(w)).alias("relevance_score"), F.transform(top, lambda x: F.struct(x["facet"].alias("facet"), (-x["s"]).alias("score"))).alias("top_facets"))


def merge_decision(current: Column, gate: Column) -> Column:
    """The gate only ever promotes: a better decision than the current one replaces it."""
    rank = lambda c: F.when(c == "send_to_eater", 3).when(c == "review", 2).when(c == "reject", 1).otherwise(0)
    return F.when(rank(gate) > rank(current), gate).otherwise(current)


def question_hits(text: Column, terms: Column) -> Column:
    """The terms that occur in the text, lower-cased."""
    return F.filter(terms, lambda t: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(t)))


def question_verdict(env: Column, outcome: Column, evidence: Column, exclusion: Column) -> Column:
    """accept needs environment, outcome and evidence terms; environment and outcome alone are an edge case; an exclusion term rejects."""
    n = lambda c: F.size(c) > 0
    return F.when(n(exclusion), "reject").when(n(env) & n(outcome) & n(evidence), "accept").when(n(env) & n(outcome), "edge_case").otherwise("reject")


def verdict_decision(verdict: Column) -> Column:
    return F.when(verdict == "accept", "send_to_eater").when(verdict == "edge_case", "review").otherwise("reject")


def topic_decision(relevance: Column, has_abstract: Column, *, off_topic: float = 0.06) -> Column:
    return F.when(relevance >= off_topic, "on_topic").when(~has_abstract, "needs_abstract").otherwise("possibly_off_topic")


def backlog_fields(papers: DataFrame, payload: str) -> DataFrame:
    """Classification payload (a JSON struct column) as columns: decisions, topic, confidence, status."""
    p = lambda path: F.col(f"{payload}.{path}")
    intake = p("intake_result.intake_decision")
    decision = F.when(intake == "accept_candidate", "send_to_eater").when(intake.isin("edge_case", "manual_review"), "review").when(intake == "reject_clear_false_positive", "reject").otherwise("pending")
    domain = p("intake_result.domain_relevance")
    topic = F.when(domain == "on_domain", "on_topic").when(domain == "clear_false_positive", "off_topic").when(domain == "insufficient_metadata", "needs_abstract").otherwise("possibly_off_topic")
    status = F.coalesce("status", F.lit("candidate"))
    filled = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    return papers.select(
        "paper_id", F.when(decision == "reject", "rejected").when((status == "pending_scorer") & decision.isin("send_to_eater", "review"), "candidate").otherwise(status).alias("status"),
        p("overall_confidence").alias("triage_score"), decision.alias("triage_decision"), topic.alias("topic_decision"), F.lit("shared_pre_extraction").alias("topic_stage"),
        F.coalesce(p("intake_result.primary_topic"), p("stable_topic_routing.primary_topic")).alias("topic_category"), p("article_type.value").alias("article_type"), p("article_type.confidence").alias("article_type_confidence"),
        F.coalesce(filled(p("intake_result.topic_candidates")), F.array().cast("array<string>")).alias("topic_candidates"),
        F.coalesce(F.when(p("intake_result.matched_question_ids").isNotNull(), filled(p("intake_result.matched_question_ids"))), F.concat(filled(p("question_summary.accepted_question_ids")), filled(p("question_summary.edge_case_question_ids")))).alias("matched_question_ids"),
        filled(p("intake_result.adjacent_topics")).alias("adjacent_topics"), F.coalesce(p("needs_more_evidence"), F.lit(False)).alias("needs_more_evidence"),
    )


def registry_facts(assessments: DataFrame, dimension: str, label: str, confidence: str, source: str) -> DataFrame:
    """Append-only facts: paper, dimension, label, confidence (0 to 1), source."""
    return assessments.where(blank_to_null(F.col(label)).isNotNull()).select("paper_id", F.lit(dimension).alias("dimension"), F.col(label).alias("label"), F.least(F.greatest(F.col(confidence), F.lit(0.0)), F.lit(1.0)).alias("confidence"), F.lit(source).alias("source"))


def word_slots(text: Column, dim: int, hashed: Callable[[Column], Column] = F.xxhash64) -> Column:
    """The slot (0 to dim - 1) of every word of a text, by a hash of the word."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.pmod(hashed(w), F.lit(dim)).cast("int"))


def slot_weights(df: DataFrame, text: Column, *, dim: int = 64, hashed: Callable[[Column], Column] = F.xxhash64) -> list[float]:
    """Inverse document frequency of every slot, ln((n + 1) / (df + 1)): one partial aggregate, ``dim`` numbers."""
    held = dict(df.select(F.explode(F.array_distinct(word_slots(text, dim, hashed))).alias("slot")).groupBy("slot").count().collect())
    n = df.count()
    return [math.log((n + 1) / (held.get(i, 0) + 1)) for i in range(dim)]


def embed(df: DataFrame, text: Column, provider: Callable | None = None, *, dim: int = 64, hashed: Callable[[Column], Column] = F.xxhash64, weights: list[float] | None = None) -> DataFrame:
    """``df`` with ``embedding``: by ``provider`` (a mapInPandas function), or hashed word counts, ``weights`` laid over the slots, of unit length (plus 1e-10) as the offline default.

    Words are hashed by built-in functions; their slots are counted in Arrow batches. A text that is null or has no word has zeros.
    """
    if provider is not None:
        from pyspark.sql import types as T

        return df.withColumn("text", text).mapInPandas(provider, T.StructType([*df.schema.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))]))
    factor = np.ones(dim) if weights is None else np.array(weights, np.float64)

    @F.arrow_udf("array<double>")
    def counted(slots: pa.Array) -> pa.Array:
        row = np.repeat(np.arange(len(slots)), pc.list_value_length(slots).to_numpy(zero_copy_only=False))
        count = np.bincount(row * dim + slots.flatten().to_numpy(zero_copy_only=False), minlength=len(slots) * dim).reshape(-1, dim) * factor
        count = count / (np.linalg.norm(count, axis=1, keepdims=True) + 1e-10)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(slots) + 1) * dim, pa.int32()), pa.array(count.ravel()))

    return df.withColumn("embedding", counted(word_slots(text, dim, hashed)))


def profile_similarity(profiles: DataFrame, entity: str, feature: str, weight: str, one: DataFrame) -> DataFrame:
    """Sum of the lesser weights over shared features / greater of the totals, of every entity to that of ``one`` (one row: entity)."""
    it = one.select(F.col(entity).alias("it__")).limit(1)
    mine = profiles.join(F.broadcast(it), F.col(entity) == F.col("it__")).select(feature, F.col(weight).alias("w__"))
    totals = profiles.groupBy(entity).agg(F.sum(weight).alias("t__"))
    shared = profiles.join(mine, feature).groupBy(entity).agg(F.sum(F.least(weight, "w__")).alias("s__"))
    own = mine.agg(F.sum("w__").alias("o__"))
    out = shared.join(totals, entity).join(F.broadcast(own), how="cross").join(F.broadcast(it), F.col(entity) == F.col("it__"), "left_anti")
    return out.select(entity, (F.col("s__") / F.greatest("t__", "o__")).alias("similarity"))
