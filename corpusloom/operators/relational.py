"""Scans and relational building blocks. Every order has a unique tie-breaker."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row with this key. For many keys join instead."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def all_of(conditions: list[Column]) -> Column:
    """The conjunction of a list of predicates that is put together at run time; true for none."""
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def holds_text(c: Column, needle: str) -> Column:
    """Case-insensitive containment; the needle is taken literally."""
    return F.contains(F.lower(F.coalesce(c, F.lit(""))), F.lit(needle.lower()))


def search(df: DataFrame, *, text_cols: list[str] = (), query: str | None = None, equals: dict | None = None, ranges: dict | None = None, order: list[Column] = (), limit: int | None = None) -> DataFrame:
    """Conjunctive search: ``query`` in any text column, column = value, column in (low, high); then order and limit."""
    conditions = [F.col(k) == v for k, v in (equals or {}).items()]
    for k, (low, high) in (ranges or {}).items():
        conditions += [F.col(k) >= low] if low is not None else []
        conditions += [F.col(k) <= high] if high is not None else []
    if query:
        conditions.append(reduce(lambda a, b: a | b, (holds_text(F.col(c), query) for c in text_cols)))
    out = df.where(all_of(conditions))
    out = out.orderBy(*order) if order else out
    return out.limit(limit) if limit is not None else out


def by_status(df: DataFrame, status: str, *, status_col: str = "status", decision_col: str = "triage_decision") -> DataFrame:
    return df.where((F.col(status_col) == status) | (F.col(decision_col) == status))


def children(df: DataFrame, fk: str, parent) -> DataFrame:
    return df.where(F.col(fk) == F.lit(parent))


def latest(df: DataFrame, order_col: str, n: int) -> DataFrame:
    return df.orderBy(F.col(order_col).desc_nulls_last()).limit(n)


def flagged(df: DataFrame, flag: str, *, unless_set: str | None = None) -> DataFrame:
    out = df.where(F.col(flag))
    return out.where(F.col(unless_set).isNull()) if unless_set else out


def top_scored(entities: DataFrame, scores: DataFrame, key: str, score: str, least: float, k: int) -> DataFrame:
    """Entities with a score of at least ``least``, best first, ties by key."""
    return entities.join(scores.where(F.col(score) >= least), key).orderBy(F.col(score).desc(), key).limit(k)


def cooccurring(facts: DataFrame, group: str, left: Column, right: Column, what: str) -> DataFrame:
    """Distinct ``what`` (the group) in which a ``left`` and a ``right`` fact meet; each side is reduced to its groups first."""
    a = facts.where(left).select(group).distinct()
    b = facts.where(right).select(group).distinct()
    return a.join(b, group, "left_semi").agg(F.count("*").alias(what))


def without_match(left: DataFrame, right: DataFrame, on: Column) -> DataFrame:
    """NOT EXISTS with any condition; rows whose condition is null stay."""
    return left.join(right, on, "left_anti")


def frequent(df: DataFrame, key: str, *, least: int, k: int | None = None, carry: str | None = None, count: str = "n") -> DataFrame:
    """Keys that occur ``least`` times or more, most frequent first, with the smallest value of ``carry``."""
    aggs = [F.count("*").alias(count)] + ([F.min(carry).alias(carry)] if carry else [])
    out = df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs).where(F.col(count) >= least).orderBy(F.desc(count), key)
    return out.limit(k) if k is not None else out


def counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias(name))


def excess(df: DataFrame, key: Column, name: str = "excess") -> DataFrame:
    """How many rows repeat a key: sum of (count - 1), 0 for none."""
    return df.groupBy(key.alias("k__")).agg((F.count("*") - 1).alias("c__")).where("c__ > 0").agg(F.coalesce(F.sum("c__"), F.lit(0)).alias(name))


def union_distinct(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames).distinct()


def pivot_attributes(facts: DataFrame, entity: str, attribute: str, value: Column, names: list[str]) -> DataFrame:
    """Entity-attribute-value rows as one row an entity, a column for each of ``names``."""
    return facts.where(F.col(attribute).isin(names)).groupBy(entity).agg(*[F.min(F.when(F.col(attribute) == n, value)).alias(n) for n in names])


def conditional_update(df: DataFrame, changes: dict[str, tuple[Column, Column]]) -> DataFrame:
    """UPDATE ... SET column = value WHERE condition, for several columns at once, on the old values."""
    return df.withColumns({c: F.when(condition, value).otherwise(F.col(c)) for c, (condition, value) in changes.items()})


def ranked(df: DataFrame, partition: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
