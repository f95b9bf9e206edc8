"""The claim graph as node and edge tables, and traversals over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators.sized import small
from corpusloom.workspace import materialise

CONSTRUCT_COLUMNS = {"about_iv": "environment_factors", "about_dv": "outcomes", "mediates": "mediators", "moderates": "moderators"}


def _named(column: str) -> Column:
    """A claim's constructs of one kind as (construct, role): one without an id is named by its role, one without either is left out."""
    named = F.transform(column, lambda c: F.struct(F.coalesce(F.nullif(c["id"], F.lit("")), F.concat(F.lit("construct:"), c["role"])).alias("construct"), c["role"].alias("role")))
    return F.coalesce(F.filter(named, lambda c: c["construct"].isNotNull()), F.array().cast("array<struct<construct:string,role:string>>"))


def edges(papers: DataFrame, claims: DataFrame, citations: DataFrame | None = None, *, kinds: tuple[str, ...] | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(src, dst, type, claim_id): has_claim, about_iv, about_dv, mediates, moderates, affects and cites.

    All edges of a claim come from its row, in one scan: it affects every dependent construct by every independent one, repeats kept.
    ``kinds``: only these edges; without has_claim the claims do not meet the papers and are not shuffled. ``carry``: columns of the claim
    that its edges have as well (null for cites).
    """
    asked = lambda kind: kinds is None or kind in kinds
    known = papers.select("paper_id").distinct()
    edge = lambda src, dst, kind: F.struct(src.alias("src"), dst.alias("dst"), F.lit(kind).alias("type"))
    claim, none = F.col("claim_id"), F.array().cast("array<struct<src:string,dst:string,type:string>>")
    own = [none]
    if asked("has_claim"):
        own.append(F.when(F.col("known__").isNotNull(), F.array(edge(F.col("paper_id"), claim, "has_claim"))).otherwise(none))
    about = lambda kind: lambda c: edge(claim, c["construct"], kind)
    own += [F.transform(_named(column), about(kind)) for kind, column in CONSTRUCT_COLUMNS.items() if asked(kind)]
    iv, dv = _named(CONSTRUCT_COLUMNS["about_iv"]), _named(CONSTRUCT_COLUMNS["about_dv"])
    if asked("affects"):
        own.append(F.flatten(F.transform(iv, lambda i: F.transform(dv, lambda d: edge(i["construct"], d["construct"], "affects")))))
    rows = claims.join(known.select("paper_id", F.lit(1).alias("known__")), "paper_id", "left") if asked("has_claim") else claims
    out = rows.select("claim_id", *carry, F.explode(F.concat(*own)).alias("e")).select("e.src", "e.dst", "e.type", "claim_id", *carry)
    if citations is not None and asked("cites"):
        c = citations.where("cited_paper_id is not null").join(known.withColumnRenamed("paper_id", "source_paper_id"), "source_paper_id", "left_semi").join(known.withColumnRenamed("paper_id", "cited_paper_id"), "cited_paper_id", "left_semi")
        out = out.unionByName(c.select(F.col("source_paper_id").alias("src"), F.col("cited_paper_id").alias("dst"), F.lit("cites").alias("type"), F.lit(None).cast("string").alias("claim_id"), *[F.lit(None).cast(claims.schema[x].dataType).alias(x) for x in carry]))
    return out


def affects(iv: DataFrame, dv: DataFrame) -> DataFrame:
    """The same where constructs stand in tables (claim_id, construct): per claim every independent with every dependent one."""
    return iv.select("claim_id", F.col("construct").alias("src")).join(dv.select("claim_id", F.col("construct").alias("dst")), "claim_id").select("src", "dst", F.lit("affects").alias("type"), "claim_id")


def nodes(papers: DataFrame, claims: DataFrame) -> DataFrame:
    """(node_id, type, label); a construct is labelled by its first mention.

    The constructs with their roles, each once, are found by hashing and written; only of those with more than one role the
    first mention is looked for, so that not every mention is sorted.
    """
    p = papers.select(F.col("paper_id").alias("node_id"), F.lit("paper").alias("type"), F.substring(F.coalesce("title", F.lit("")), 1, 100).alias("label"))
    c = claims.select(F.col("claim_id").alias("node_id"), F.lit("claim").alias("type"), F.substring(F.coalesce("statement", F.lit("")), 1, 100).alias("label"))
    mentions = claims.select("claim_id", F.explode(F.concat(*map(_named, CONSTRUCT_COLUMNS.values()))).alias("c")).select("claim_id", "c.construct", F.coalesce("c.role", "c.construct").alias("label"))
    labels = materialise(mentions.select("construct", "label").distinct(), "labels")
    named = labels.groupBy("construct").agg(F.min("label").alias("label"), F.count("*").alias("n"))
    k = named.where("n = 1").select(F.col("construct").alias("node_id"), F.lit("construct").alias("type"), "label")
    several = named.where("n > 1").select("construct")
    if not several.isEmpty():
        first = mentions.join(small(several), "construct", "left_semi").groupBy("construct").agg(F.min_by("label", "claim_id").alias("label"))
        k = k.unionAll(first.select("construct", F.lit("construct"), "label"))
    return p.unionByName(c).unionByName(k)


def find_construct(node_table: DataFrame, query: str) -> DataFrame:
    q = F.lit(query.lower())
    return node_table.where((F.col("type") == "construct") & (F.contains(F.lower("label"), q) | F.contains(F.lower("node_id"), q)))


def neighbours(edge_table: DataFrame, node, *, outgoing: bool = True, kind: str | None = None) -> DataFrame:
    out = edge_table.where(F.col("src" if outgoing else "dst") == F.lit(node))
    return out.where(F.col("type") == kind) if kind else out


def what_affects(affect_edges: DataFrame, effects: DataFrame | None, target: Column, *, by: str = "src", first: int = 5) -> DataFrame:
    """(by, claim_count, avg_effect ignoring nulls, the first claims). ``effects``: claim_id, effect; None where the edges carry the effect.

    One aggregate over (by, claim) carries all three: a claim's effect weighs as often as its edges repeat, claims count once.
    """
    met = affect_edges.where(target)
    met = met if effects is None else met.join(effects, "claim_id", "left")
    claims = met.groupBy(by, "claim_id").agg(F.sum("effect").alias("total"), F.count("effect").alias("n"))
    rank = F.row_number().over(Window.partitionBy(by).orderBy("claim_id"))  # Spark limits groups before the shuffle
    firsts = claims.select(by, "claim_id").withColumn("rank", rank).where(F.col("rank") <= first).groupBy(by).agg(F.array_sort(F.collect_list("claim_id")).alias("claims"))
    totals = claims.groupBy(by).agg(F.count("claim_id").alias("claim_count"), (F.sum("total") / F.nullif(F.sum("n"), F.lit(0))).alias("avg_effect"))
    return totals.join(firsts, by).select(by, "claim_count", "avg_effect", "claims")


def graph_stats(node_table: DataFrame, edge_table: DataFrame) -> DataFrame:
    n = node_table.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("node").alias("kind"), "type", "n")
    return n.unionByName(edge_table.groupBy("type").agg(F.count("*").alias("n")).select(F.lit("edge").alias("kind"), "type", "n"))


def in_degree(edge_table: DataFrame, kind: str = "cites") -> DataFrame:
    """(node, in_degree, size): drawn size 5 + twice the degree, 30 more at most."""
    d = edge_table.where(F.col("type") == kind).groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("in_degree"))
    return d.withColumn("size", 5 + F.least(2 * F.col("in_degree"), F.lit(30)))


def export(node_table: DataFrame, edge_table: DataFrame) -> tuple[DataFrame, DataFrame]:
    return node_table.select(F.col("node_id").alias("id"), "type", "label"), edge_table.select(F.col("src").alias("source"), F.col("dst").alias("target"), "type")
