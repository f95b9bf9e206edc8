"""Sinks that merge: they return the new state, to be written as a new snapshot beside the old one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.normalize import blank_to_null


def upsert(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Latest change of a key wins, column by column: a null in a change keeps the value that was there.

    Nothing else is touched and no dependent row is deleted.
    """
    cols = [c for c in current.columns if c != key]
    newest = changes.groupBy(key).agg(F.max_by(F.struct(*[F.col(c) if c in changes.columns else F.lit(None).alias(c) for c in cols]), order).alias("new__"))
    joined = current.join(newest, key, "full_outer")
    return joined.select(key, *[F.coalesce(F.col(f"new__.{c}"), F.col(c)).alias(c) for c in cols])


def latest_wins(changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last change of every key, whole; a partial aggregate, no window."""
    rest = [c for c in changes.columns if c not in keys]
    return changes.groupBy(*keys).agg(F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("l__")).select(*keys, *[F.col(f"l__.{c}").alias(c) for c in rest])


def insert_ignore(current: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``new`` rows whose key is neither in ``current`` nor earlier in ``new``. Rows with a null key all count as new."""
    null = F.greatest(*[F.col(k).isNull().cast("int") for k in keys]) == 1 if len(keys) > 1 else F.col(keys[0]).isNull()
    keyed = new.where(~null)
    rest = [c for c in new.columns if c not in keys]
    firsts = keyed.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("f__")).select(*keys, *[F.col(f"f__.{c}").alias(c) for c in rest])
    return firsts.join(current.select(*keys), keys, "left_anti").select(*new.columns).unionByName(new.where(null))


def with_internal_ids(citations: DataFrame, papers: DataFrame) -> DataFrame:
    """Citations with ``cited_paper_id`` filled in by DOI where it is missing."""
    known = papers.where(F.col("doi").isNotNull()).groupBy(F.lower("doi").alias("d__")).agg(F.min("paper_id").alias("p__"))
    return citations.join(known, F.lower("cited_doi") == F.col("d__"), "left").withColumn("cited_paper_id", F.coalesce("cited_paper_id", "p__")).drop("d__", "p__")


def counting_upsert(current: DataFrame, seen: DataFrame, key: str, *, count: str, priority: str, order: str, first: list[str]) -> DataFrame:
    """A queue row a key: occurrences added up, highest priority, the other columns as first seen.

    ``current`` has ``count`` already; every row of ``seen`` counts 1; ``order`` is the arrival (null in ``current``).
    """
    old = current.select(key, F.col(count).cast("long").alias(count), priority, F.lit(None).cast(seen.schema[order].dataType).alias(order), *first)
    new = seen.select(key, F.lit(1).cast("long").alias(count), priority, order, *first)
    return old.unionByName(new).groupBy(key).agg(F.sum(count).alias(count), F.max(priority).alias(priority), F.min(F.struct(F.col(order).isNotNull().alias("n"), F.col(order).alias("o"), *first)).alias("f__")).select(key, count, priority, *[F.col(f"f__.{c}").alias(c) for c in first])


def merged_paper(old: str, new: str) -> dict[str, Column]:
    """Columns of two joined paper structs merged: gaps filled, the longer title and abstract, authors united, a new file wins."""
    o, n = (lambda c: F.col(f"{old}.{c}")), (lambda c: F.col(f"{new}.{c}"))
    fill = {c: F.coalesce(blank_to_null(o(c)), n(c)) for c in ("doi", "venue", "url", "publisher")}
    longer = {c: F.when(F.coalesce(F.length(n(c)), F.lit(0)) > F.coalesce(F.length(o(c)), F.lit(0)), n(c)).otherwise(o(c)) for c in ("title", "abstract")}
    empty = F.array().cast("array<string>")
    return fill | longer | {
        "year": F.coalesce(o("year"), n("year")), "authors": F.array_union(F.coalesce(o("authors"), empty), F.coalesce(n("authors"), empty)),
        "sources": F.array_union(F.coalesce(o("sources"), empty), F.coalesce(n("sources"), empty)), "pdf_path": F.coalesce(blank_to_null(n("pdf_path")), o("pdf_path")),
    }


def fill_missing(df: DataFrame, metadata: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``df`` with missing values of ``columns`` (null, blank, empty array) taken from ``metadata``, and ``fields_added``."""
    extra = metadata.select(F.col(key).alias("k__"), *[F.col(c).alias(f"{c}__m") for c in columns])
    kinds = dict(df.dtypes)

    def missing(c: str) -> Column:
        return F.coalesce(F.size(c), F.lit(0)) <= 0 if kinds[c].startswith("array") else F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""

    joined = df.join(extra, F.col(key) == F.col("k__"), "left")
    gained = F.filter(F.array(*[F.when(missing(c) & F.col(f"{c}__m").isNotNull(), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return joined.withColumns({"fields_added": gained} | {c: F.when(missing(c), F.coalesce(F.col(f"{c}__m"), F.col(c))).otherwise(F.col(c)) for c in columns}).drop("k__", *[f"{c}__m" for c in columns])


def backfilled(df: DataFrame, sig: Column, order: list[str], fill: list[str]) -> DataFrame:
    """One row a signature: the first by ``order``, its ``fill`` columns completed from the later ones. Partial aggregates only."""
    rest = [c for c in df.columns if c not in fill]
    return (
        df.withColumn("sig__", sig).groupBy("sig__")
        .agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("f__"), *[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.struct(*order))).alias(c) for c in fill], F.count("*").alias("members"))
        .select(*[F.col(f"f__.{c}").alias(c) for c in rest], *fill, "members")
    )


def keep_longest(df: DataFrame, keys: list[Column], length: Column, tie: str) -> DataFrame:
    """The row with the greatest ``length`` of every key, ties by the smallest ``tie``; one partial aggregate, no window over a hot key."""
    named = [k.alias(f"k{i}__") for i, k in enumerate(keys)]
    first = F.min(F.struct((-length).alias("l__"), F.col(tie).alias("t__"), F.struct(*df.columns).alias("row__"))).alias("f__")
    return df.groupBy(*named).agg(first).select("f__.row__.*")
