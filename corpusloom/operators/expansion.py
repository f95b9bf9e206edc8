"""Citation network, the expansion queue, and bounded expansion of a frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.normalize import fixed, seen_key
from corpusloom.operators.merge import counting_upsert
from corpusloom.operators.relational import frequent
from corpusloom.workspace import materialise


def external_citations(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """Citations whose DOI is not in the corpus."""
    known = papers.where("doi is not null").select(F.lower("doi").alias("d__")).distinct()
    return citations.where("cited_doi is not null").join(known, F.lower("cited_doi") == F.col("d__"), "left_anti")


def highly_cited(citations: DataFrame, papers: DataFrame, *, least: int = 2, k: int | None = None) -> DataFrame:
    """External DOIs cited ``least`` times or more, with priority min(1, n / 10)."""
    out = frequent(external_citations(citations, papers), "cited_doi", least=least, k=k, carry="cited_title", count="n")
    return out.withColumn("priority_score", F.least(F.lit(1.0), F.col("n") / 10))


def enqueue(queue: DataFrame, citations: DataFrame, papers: DataFrame, *, per_source: int | None = None) -> DataFrame:
    """The queue with every external citation counted in; ``per_source`` can set a crawler's budget for one paper (the first by ``seq``)."""
    new = external_citations(citations, papers)
    if per_source:
        w = Window.partitionBy("source_paper_id").orderBy("seq")
        new = new.withColumn("r__", F.row_number().over(w)).where(F.col("r__") <= per_source)
    seen = new.select(F.lower("cited_doi").alias("doi"), F.col("cited_title").alias("title"), F.col("source_paper_id").alias("discovered_from"), F.lit(0.5).alias("priority_score"), "seq")
    return counting_upsert(queue, seen, "doi", count="discovery_count", priority="priority_score", order="seq", first=["title", "discovered_from"])


def reprioritised(queue: DataFrame) -> DataFrame:
    return queue.withColumn("priority_score", F.when(F.col("status") == "pending", F.least(F.lit(1.0), F.col("discovery_count") / 10)).otherwise(F.col("priority_score")))


def queue_head(queue: DataFrame, n: int) -> DataFrame:
    return queue.where("status = 'pending'").orderBy(F.desc("priority_score"), F.desc("discovery_count"), "doi").limit(n)


def queue_import(queue: DataFrame, n: int, *, least: float = 0.3) -> DataFrame:
    """The first ``n`` of the 2n most urgent entries that score ``least``: the filter stands between the limits."""
    return queue_head(queue, 2 * n).where(F.col("priority_score") >= least).orderBy(F.desc("priority_score"), F.desc("discovery_count"), "doi").limit(n)


def network_stats(citations: DataFrame) -> DataFrame:
    return citations.agg(F.count("*").alias("citations"), F.countDistinct("source_paper_id").alias("citing"), F.countDistinct("cited_doi").alias("cited_dois"), F.count("cited_paper_id").alias("internal"))


def gate(score: Column, depth: Column, abstract: Column, top_facets: Column, *, threshold: float = 0.4, max_depth: int = 2, boost: float = 0.1, need_abstract: bool = False, priority: tuple = ("environmental_factors", "outcomes")) -> Column:
    """(ok, reason): depth, abstract, then the threshold, lower by ``boost`` where a priority facet scores over 0.4."""
    strong = F.exists(F.coalesce(top_facets, F.array().cast("array<struct<facet:string,score:double>>")), lambda f: f["facet"].isin(list(priority)) & (f["score"] > 0.4))
    limit = F.lit(threshold) - F.when(strong, boost).otherwise(0.0)
    no = lambda text: F.struct(F.lit(False).alias("ok"), text.alias("reason"))
    out = F.when(depth > max_depth, no(F.format_string("Exceeds max depth (%d > %d)", depth, F.lit(max_depth))))
    if need_abstract:
        out = out.when(F.coalesce(abstract, F.lit("")) == "", no(F.lit("No abstract available")))
    return out.when(score < limit, no(F.format_string("Below threshold (%s < %s)", fixed(score), fixed(limit)))).otherwise(F.struct(F.lit(True).alias("ok"), F.format_string("Relevant (%s)", fixed(score)).alias("reason")))


def routed(candidates: DataFrame, *, threshold: float = 0.4) -> DataFrame:
    """duplicate, deferred (no score yet), rejected or imported. ``candidates``: known (boolean), score, decision."""
    route = F.when(F.col("known"), "duplicate").when(F.col("score").isNull(), "deferred").when((F.col("decision") == "reject") | (F.col("score") < threshold), "rejected").otherwise("imported")
    return candidates.withColumn("route", route)


def expansion_stats(gated: DataFrame) -> DataFrame:
    """Counters and acceptance rate of gated candidates (ok, reason)."""
    return gated.agg(F.count("*").alias("candidates"), F.count_if("ok").alias("queued"), F.count_if(~F.col("ok")).alias("rejected"), F.count_if(F.startswith("reason", F.lit("Below"))).alias("below_threshold"), F.count_if(F.startswith("reason", F.lit("Exceeds"))).alias("too_deep"), F.coalesce(F.try_divide(F.count_if("ok"), F.count("*")), F.lit(0.0)).alias("acceptance_rate"))


def bounded(candidates: DataFrame, known_dois: DataFrame, known_titles: DataFrame, **limits) -> DataFrame:
    """Outcome (duplicate, queued or rejected) and reason of every candidate of a corpus-wide expansion.

    ``candidates``: seq (arrival), doi, title, score, depth, abstract, top_facets; ``limits`` go to ``gate``. A candidate is a
    duplicate if the corpus, or an earlier candidate, has its DOI or its title.
    """
    c = candidates.withColumns({"d__": F.nullif(F.lower("doi"), F.lit("")), "t__": F.nullif(seen_key(F.col("title")), F.lit(""))})
    for key, known in (("d__", known_dois.select(F.lower("doi").alias("d__"))), ("t__", known_titles.select(seen_key(F.col("title")).alias("t__")))):
        own = c.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("seq").alias("first"))
        seen = known.where(F.coalesce(key, F.lit("")) != "").distinct().withColumn("known", F.lit(True))
        marks = own.join(seen, key, "left").select(F.col(key).alias("k__"), F.when(F.col("known"), F.lit(-1)).otherwise(F.col("first")).alias(f"{key}first"))
        c = c.join(marks, F.col(key) == F.col("k__"), "left").drop("k__")
    dup = (F.coalesce(F.col("d__first") < F.col("seq"), F.lit(False))) | (F.coalesce(F.col("t__first") < F.col("seq"), F.lit(False)))
    g = gate(F.col("score"), F.col("depth"), F.col("abstract"), F.col("top_facets"), **limits)
    out = c.withColumn("g__", g)
    outcome = F.when(dup, "duplicate").when(F.col("g__.ok"), "queued").otherwise("rejected")
    return out.select(*candidates.columns, outcome.alias("outcome"), F.when(dup, "Already seen").otherwise(F.col("g__.reason")).alias("reason"))


def bounded_report(outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one row of counters, counts by the first word of the reason)."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    scored = F.count_if(F.col("outcome") != "duplicate")
    row = outcomes.agg(F.count("*").alias("candidates"), n("duplicate").alias("duplicates_skipped"), scored.alias("scored"), n("queued").alias("queued"), n("rejected").alias("rejected"), F.coalesce(F.try_divide(n("queued"), scored), F.lit(0.0)).alias("acceptance_rate"))
    return row, outcomes.groupBy(F.split("reason", " ")[0].alias("reason")).agg(F.count("*").alias("n"))


def one_hop(edges: DataFrame, frontier: DataFrame, seen: DataFrame) -> DataFrame:
    """Nodes next to the frontier that were not seen. ``edges``: src, dst; the others: node."""
    return edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti")


def expand(edges: DataFrame, seeds: DataFrame, *, max_depth: int = 2, least_new: int = 1, keep: Column | None = None) -> DataFrame:
    """(node, depth) reached from the seeds, hop by hop, until a hop adds fewer than ``least_new`` nodes.

    The edges and every hop are written in the shared folder, which keeps the plan short and survives
    lost executors; the driver sees one count a hop.
    """
    edges = materialise(edges.select("src", "dst"), "edges")
    seen = seeds.select("node").distinct().withColumn("depth", F.lit(0))
    frontier = seen
    for depth in range(1, max_depth + 1):
        new = one_hop(edges, frontier, seen.select("node"))
        new = materialise((new.where(keep) if keep is not None else new).withColumn("depth", F.lit(depth)), "hop")
        seen = seen.unionByName(new)
        if depth < max_depth and new.limit(least_new).count() < least_new:
            break
        frontier = new
    return seen
