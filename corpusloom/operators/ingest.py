"""Bringing records in: previews, candidate choice, queue drains, library import, job queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import normalize as N
from corpusloom.functions import parse as P
from corpusloom.functions import similarity as SIM
from corpusloom.operators import dedup
from corpusloom.operators.audit import filled
from corpusloom.operators.sized import spread
from corpusloom.workspace import materialise


def preview(df: DataFrame, n: int = 5) -> tuple[dict[str, str], DataFrame]:
    """(detected columns, the first rows) of a text table."""
    return P.detect_columns(df), df.limit(n)


def keyword_passes(df: DataFrame, text: Column, passes: list[tuple[str, list[str]]], *, default: str) -> DataFrame:
    """Topic decisions by keyword passes in order: the first pass of which any word occurs decides."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    hits = [F.when(reduce(lambda a, b: a | b, (F.contains(plain, F.lit(w.lower())) for w in words)), F.lit(decision)) for decision, words in passes]
    return df.withColumn("topic_decision", F.coalesce(*hits, F.lit(default)))


def resolved(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Two sources of metadata as one: a field of ``left`` unless it is blank there."""
    l, r = left.select(key, *[F.col(c).alias(f"{c}__l") for c in columns]), right.select(key, *[F.col(c).alias(f"{c}__r") for c in columns])  # noqa: E741
    kinds = dict(left.dtypes)
    mine = lambda c: N.blank_to_null(F.col(f"{c}__l")) if kinds[c] == "string" else F.col(f"{c}__l")
    return l.join(r, key, "full_outer").select(key, *[F.coalesce(mine(c), F.col(f"{c}__r")).alias(c) for c in columns])


def best_candidates(records: DataFrame, candidates: DataFrame, *, least: float = 0.35) -> DataFrame:
    """The best candidate of every record, if it scores ``least``. ``records``: id, title, author, year; ``candidates``: id (of the record looked up), title, authors, year, doi, abstract."""
    c = candidates.select("id", F.col("title").alias("c_title"), F.col("authors").alias("c_authors"), F.col("year").alias("c_year"), F.col("doi").alias("c_doi"), F.col("abstract").alias("c_abstract"))
    score = SIM.repair_score(N.tokens(F.col("title")), N.tokens(F.col("c_title")), F.col("year"), F.col("c_year"), F.col("author"), F.col("c_authors"), F.col("c_abstract"), F.col("c_doi"))
    met = records.join(c, "id").where((F.size(N.tokens(F.col("title"))) > 0) & (F.size(N.tokens(F.col("c_title"))) > 0)).withColumn("match_score", score).where(F.col("match_score") >= least)
    best = met.groupBy("id").agg(F.max(F.struct("match_score", "c_doi", "c_title", "c_year", "c_authors", "c_abstract")).alias("b"))
    return best.select("id", F.round("b.match_score", 3).alias("match_score"), F.col("b.c_doi").alias("doi"), F.col("b.c_title").alias("title"), F.col("b.c_year").alias("year"), F.col("b.c_authors").alias("authors"), N.strip_tags(F.col("b.c_abstract")).alias("abstract"))


def drained(queue: DataFrame, papers: DataFrame, found: DataFrame) -> DataFrame:
    """Status and reason of every queue entry after a drain. ``queue``: paper_id; ``found``: paper_id, abstract, doi of matches."""
    p = papers.select("paper_id", F.col("title").alias("t__"), F.col("abstract").alias("a__"), F.col("doi").alias("d__"), F.lit(True).alias("p__"))
    f = found.select("paper_id", F.col("abstract").alias("fa__"), F.col("doi").alias("fd__"), F.lit(True).alias("f__"))
    j = queue.join(p, "paper_id", "left").join(f, "paper_id", "left")
    new = (~filled("a__") & filled("fa__")) | (~filled("d__") & filled("fd__"))
    reason = F.when(F.col("p__").isNull(), "paper_missing").when(~filled("t__"), "missing_title").when(F.col("f__").isNull(), "no_match").when(~new, "no_new_data")
    return j.select("paper_id", F.when(reason.isNull(), "fetched").when(reason.isin("no_match", "no_new_data"), "not_found").otherwise("rejected").alias("status"), reason.alias("reason"))


def match_library(items: DataFrame, papers: DataFrame) -> DataFrame:
    """(item_id, paper_id, basis): by DOI, then by title. ``items``: item_id, doi, title; ``papers``: paper_id, doi, title."""
    d = papers.where(filled("doi")).groupBy(N.doi_library(F.col("doi")).alias("d__")).agg(F.min("paper_id").alias("by_doi"))
    t = papers.groupBy(N.seen_key(F.col("title")).alias("t__")).agg(F.min("paper_id").alias("by_title")).where("t__ <> ''")
    j = items.join(d, N.doi_library(F.col("doi")) == F.col("d__"), "left").join(t, N.seen_key(F.col("title")) == F.col("t__"), "left")
    return j.select("item_id", F.coalesce("by_doi", "by_title").alias("paper_id"), F.when(F.col("by_doi").isNotNull(), "doi").when(F.col("by_title").isNotNull(), "title").otherwise("none").alias("basis"))


def match_files(files: DataFrame, papers: DataFrame) -> DataFrame:
    """Files matched to papers by what their names say. ``files``: path; ``papers`` as ``known`` of check_duplicates. Names are parsed once, dealt out."""
    n = spread(files.select("path"), "path").select("path", P.parse_filename(F.element_at(F.split("path", "/"), -1)).alias("m"))
    n = materialise(n, "names")
    return dedup.check_duplicates(n.select(F.col("path").alias("new_id"), "m.doi", "m.title", "m.authors"), papers).withColumnRenamed("new_id", "path")


def imported(items: DataFrame, papers: DataFrame, scores: DataFrame, *, reject: str = "reject") -> DataFrame:
    """New library items as papers: existing ids skipped; rejected by score, or left waiting for a scorer."""
    new = items.join(papers.select("paper_id"), "paper_id", "left_anti").join(scores.select("paper_id", "triage_score", "decision"), "paper_id", "left")
    return new.withColumn("status", F.when(F.col("decision").isNull(), "pending_scorer").when(F.col("decision") == reject, "rejected").otherwise("candidate"))


def outcome_counts(outcomes: DataFrame, names: list[str], column: str = "outcome") -> DataFrame:
    return outcomes.agg(F.count("*").alias("total"), *[F.count_if(F.col(column) == n).alias(n) for n in names])


def recent(df: DataFrame, ts: str, days: int, now: Column) -> DataFrame:
    return df.where(F.col(ts) >= now - F.make_dt_interval(F.lit(days)))


def enqueued(papers: DataFrame, chosen: DataFrame, transitions: dict[str, list[str]], *, to: str = "queued_for_eater") -> DataFrame:
    """``papers`` with the ``chosen`` (paper_id) moved on to ``to`` where the state machine allows it, and ``moved`` (null: not asked for)."""
    allowed = [state for state, after in transitions.items() if to in after]
    hit = papers.join(chosen.select(F.col("paper_id").alias("p__")).distinct(), F.col("paper_id") == F.col("p__"), "left")
    moved = F.when(F.col("p__").isNotNull(), F.col("status").isin(allowed))
    return hit.withColumn("moved", moved).withColumn("status", F.when(F.col("moved"), to).otherwise(F.col("status"))).drop("p__")


def due_jobs(queue: DataFrame, bundles: DataFrame, n: int | None = None) -> DataFrame:
    """Queued papers whose bundle exists, by priority. ``bundles``: bundle (a safe id after ``job_``)."""
    j = queue.withColumn("bundle", F.concat(F.lit("job_"), N.safe_filename(F.col("paper_id")))).join(bundles.select("bundle"), "bundle", "left_semi")
    out = j.orderBy("priority", "paper_id")
    return out.limit(n) if n else out


def in_batches(df: DataFrame, order: str, size: int) -> DataFrame:
    """``df`` with a batch number, by hash of ``order``, so that batches are made without a global sort; of about ``size`` rows."""
    n = df.count()
    return df.withColumn("batch", F.pmod(F.xxhash64(order), F.lit(max(1, -(-n // size)))))


def first_seen(df: DataFrame, key: Column, order: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return df.withColumn("r__", F.row_number().over(w)).where("r__ = 1").drop("r__")
