"""Questions in plain language, answered over the claim graph and the vector indexes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.parse import parse_question
from corpusloom.operators import graph as G
from corpusloom.operators import synthesis as S
from corpusloom.operators.sized import small
from corpusloom.workspace import materialise

#: Columns of a claim that its edges may carry, so that a question does not have to meet all claims again.
CARRIED = ("claim_type", "statement", "effect")


@dataclass
class Corpus:
    """What questions are asked of: nodes and edges of the graph, claims (claim_id, claim_type, statement, effect; claim_id is
    their key), and two searches, text -> rows with a score. Edges may have the columns ``CARRIED`` of their claim."""

    nodes: DataFrame
    edges: DataFrame
    claims: DataFrame
    claim_search: Callable[[str], DataFrame] | None = None
    paper_search: Callable[[str], DataFrame] | None = None


def _first(df: DataFrame, n: int | None, *order) -> DataFrame:
    return df if n is None else df.orderBy(*order).limit(n)


def claims_about(c: Corpus, construct: str, *, cap: int | None = 50, enough: int = 10, extra: int | None = 20) -> DataFrame:
    """Claims whose constructs match; with fewer than ``enough`` also the nearest by meaning. ``total`` counts before the cap; None: no cap."""
    found = G.find_construct(c.nodes, construct).select(F.col("node_id").alias("dst"))
    about = c.edges.where(F.col("type").isin("about_iv", "about_dv", "mediates", "moderates")).join(small(found), "dst", "left_semi")
    if set(CARRIED) <= set(c.edges.columns) and set(c.claims.columns) == {"claim_id", *CARRIED}:
        rows = about.select(*c.claims.columns).distinct()
    else:
        rows = c.claims.join(about.select("claim_id").distinct(), "claim_id", "left_semi")
    rows = materialise(rows.withColumn("found_by", F.lit("graph")), "about")  # asked three times
    direct = rows.select("claim_id")
    if c.claim_search and rows.limit(enough).count() < enough:
        near = _first(c.claim_search(construct), extra, F.desc("score"), "claim_id").select("claim_id")
        rows = rows.unionByName(c.claims.join(near, "claim_id", "left_semi").join(direct, "claim_id", "left_anti").withColumn("found_by", F.lit("search")))
    total = rows.agg(F.count("*").alias("total"))
    return _first(rows, cap, "found_by", "claim_id").join(F.broadcast(total), how="cross")


def answer(c: Corpus, question: str, *, compat: bool = False, whole: bool = False) -> tuple[str, str, DataFrame]:
    """(type, construct, rows) of a question: a page of the first rows, or with ``whole`` all of them, contradictions as
    ``synthesis.opposed`` has them."""
    about = lambda: claims_about(c, construct, cap=None, extra=None) if whole else claims_about(c, construct)
    page = lambda df, n, key: _first(df, None if whole else n, F.desc("score"), key)
    spark = c.nodes.sparkSession
    parsed = spark.range(1).select(parse_question(F.lit(question), compat=compat).alias("q")).select("q.*").first()
    kind, construct = parsed["type"], parsed["construct"]
    effects = None if "effect" in c.edges.columns else c.claims.select("claim_id", "effect")
    affect = c.edges.where("type = 'affects'")
    matches = G.find_construct(c.nodes, construct).select("node_id")
    if kind == "what_affects":
        rows = G.what_affects(affect.join(matches.withColumnRenamed("node_id", "dst"), "dst", "left_semi"), effects, F.lit(True), by="src").orderBy(F.desc("claim_count"), "src")
    elif kind == "affects_what":
        rows = G.what_affects(affect.join(matches.withColumnRenamed("node_id", "src"), "src", "left_semi"), effects, F.lit(True), by="dst").orderBy(F.desc("claim_count"), "dst")
    elif kind == "count_claims":
        rows = about().groupBy("claim_type").agg(F.count("*").alias("n"), F.max("total").alias("total"))
    elif kind == "contradictions":
        way = about().withColumn("key", F.lit(construct)).withColumn("way", S.direction(F.col("claim_type"), F.col("statement"), positive=S.POSITIVE_WORDS[:5], negative=S.NEGATIVE_WORDS[:5]))
        rows = (S.opposed if whole else S.contradictions)(way, "key", "claim_id", "way").drop("key")
    elif kind == "papers_about" and c.paper_search:
        rows = page(c.paper_search(construct), 30, "paper_id")
    elif kind == "general_search" and c.paper_search and c.claim_search:
        papers = page(c.paper_search(construct), 15, "paper_id").select(F.lit("paper").alias("kind"), F.col("paper_id").alias("id"), "score")
        rows = papers.unionByName(page(c.claim_search(construct), 15, "claim_id").select(F.lit("claim").alias("kind"), F.col("claim_id").alias("id"), "score"))
    else:
        rows = about()
    return kind, construct, rows
