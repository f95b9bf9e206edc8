"""Similarity of titles, token sets, profiles and vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 M / T of the longest-matching-block alignment (not symmetric); for pairs that were blocked before."""
    from difflib import SequenceMatcher

    return pd.Series([0.0 if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)])


#: Characters that are counted one by one; all others of a text are counted together.
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def letter_counts(text: Column) -> Column:
    """How often each of a-z, 0-9, the space and all other characters together occur in a text."""
    each = F.transform(F.array(*map(F.lit, _LETTERS)), lambda c: F.length(text) - F.length(F.replace(text, c, F.lit(""))))
    return F.transform(F.array(each), lambda n: F.concat(n, F.array(F.length(text) - F.aggregate(n, F.lit(0), lambda a, x: a + x))))[0]


def ratio_bound(counts: Column, other_counts: Column, length: Column, other_length: Column) -> Column:
    """No alignment of two texts has a higher ``sequence_ratio``: the characters that they share, wherever they stand."""
    shared = F.aggregate(F.zip_with(counts, other_counts, lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)
    return F.coalesce(F.try_divide(2.0 * shared, (length + other_length).cast("double")), F.lit(1.0))


def overlap_size(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(overlap_size(a, b), F.size(F.array_union(a, b))), F.lit(0.0))


def share_of(a: Column, b: Column) -> Column:
    """|a and b| / |a|, 0 without a."""
    return F.coalesce(F.try_divide(overlap_size(a, b), F.size(F.array_distinct(a))), F.lit(0.0))


def repair_score(title: Column, other_title: Column, year: Column, other_year: Column, author: Column, other_authors: Column, other_abstract: Column, other_doi: Column) -> Column:
    """Jaccard of title tokens, moved by year, author, abstract and DOI; 0.35 accepts."""
    apart = F.abs(year - other_year)
    by_year = F.when(apart.isNull() | (year == 0) | (other_year == 0), 0.0).when(apart == 0, 0.2).when(apart <= 1, 0.05).otherwise(-0.15)
    has = lambda c: F.coalesce(F.trim(c), F.lit("")) != ""
    by_author = F.when(has(author) & F.contains(F.lower(F.array_join(other_authors, " ")), F.lower(author)), 0.1).otherwise(0.0)
    return jaccard(title, other_title) + by_year + by_author + F.when(has(other_abstract), 0.08).otherwise(0.0) + F.when(has(other_doi), 0.05).otherwise(0.0)


def enrich_score(title: Column, other_title: Column, year: Column, other_year: Column, other_doi: Column) -> Column:
    """0.6 of the title's share found, 0.3 for the year (0.15 if one off), 0.1 for a DOI; 0.5 accepts."""
    apart = F.abs(year - other_year)
    return 0.6 * share_of(title, other_title) + F.when(apart == 0, 0.3).when(apart == 1, 0.15).otherwise(0.0) + F.when(F.coalesce(other_doi, F.lit("")) != "", 0.1).otherwise(0.0)


def titles_similar(a: Column, b: Column, *, least: float = 0.85, words: int = 5) -> Column:
    """Both shares at least ``least``, both titles of ``words`` words or more."""
    return (F.size(a) >= words) & (F.size(b) >= words) & (share_of(a, b) >= least) & (share_of(b, a) >= least)


def catalogue_score(first_surname: Column, other_first_author: Column, year: Column, other_year: Column, title: Column, other_title: Column) -> Column:
    """0.35 author + 0.2 year + 0.45 of the lesser share; at most 0.5 on little overlap, 0.6 without the author; 0.7 accepts."""
    author = F.coalesce((first_surname != "") & F.contains(F.lower(other_first_author), F.lower(first_surname)), F.lit(False))
    overlap = F.least(share_of(title, other_title), share_of(other_title, title))
    raw = F.when(author, 0.35).otherwise(0.0) + F.when(year == other_year, 0.2).otherwise(0.0) + 0.45 * overlap
    capped = F.when(overlap < 0.4, F.least(raw, F.lit(0.5))).otherwise(raw)
    return F.when(~author & (capped > 0.5), F.least(capped, F.lit(0.6))).otherwise(capped)


def contained_share(words: Column, text: Column) -> Column:
    """Share of ``words`` that occur in ``text`` as substrings; 1 without words (nothing to check), 0 without text."""
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).when(F.size(words) == 0, 1.0).otherwise(F.size(F.filter(words, lambda w: F.contains(F.lower(text), w))) / F.size(words))


def keyword_relevance(text: Column, keywords: list[str]) -> Column:
    """Share of ``keywords`` that occur in ``text`` as substrings."""
    plain = F.lower(F.coalesce(text, F.lit("")))
    return sum((F.contains(plain, F.lit(k)).cast("int") for k in keywords), F.lit(0)) / F.lit(float(len(keywords)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is null or zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector by its length (plus 1e-10), as doubles."""
    return F.transform(F.array(norm(a) + 1e-10), lambda n: F.transform(a, lambda x: x.cast("double") / n))[0]
