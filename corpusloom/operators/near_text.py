"""Short texts alike by the ratio of their alignment (``sequence_ratio``), found without comparing all with all. Exact.

An alignment of M of the T characters of two texts leaves T - 2 M unmatched, and two of its blocks have an unmatched one between
them, so it has T - 2 M + 1 blocks at most and keeps 3 M - T - 1 pairs of neighbouring characters or more. A ratio of ``least`` means
M >= least T / 2, and T is at least the own length times 2 / (2 - least). So two texts share that many of their
grams, counted with repeats: pairs of characters from 0.85 on, single characters below, where pairs promise nothing for short texts.
Texts that share c of n grams share one of the n - c + 1 that come first in one order, here the rarest first; only these are join keys.
Equal texts meet by equality (one of one character has no pair). Pairs whose lengths or letters rule the ratio out are dropped before any alignment.

Defined results: null and empty texts are like nothing, not even each other.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.similarity import letter_counts, ratio_bound, sequence_ratio
from corpusloom.workspace import materialise


def grams(text: Column, q: int) -> Column:
    """The runs of ``q`` characters of a text, sorted and numbered among equal ones."""
    runs = F.when(F.length(text) >= q, F.transform(F.sequence(F.lit(1), F.length(text) - (q - 1)), lambda i: F.substring(text, i, F.lit(q)))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(F.array_sort(runs)), lambda s: F.transform(s, lambda g, i: F.concat(g, (i + 1 - F.array_position(s, g)).cast("string"))))[0]


def shared_at_least(length: Column, q: int, least: float) -> Column:
    """How many grams a text of this length shares with any other at ``least``; 1 or more."""
    total = length * (2 / (2 - least))
    need = total * (1.5 * least - 1) - 1 if q == 2 else total * least / 2
    return F.greatest(F.ceil(need - 1e-9), F.lit(1).cast("long"))


def alike(left: DataFrame, right: DataFrame, *, least: float = 0.85) -> DataFrame:
    """(a, b, ratio): every different text ``a`` of ``left`` with every ``b`` of ``right`` at ``least`` or more. Both are one column of text."""
    if not 0 < least <= 1:
        raise ValueError("least lies above 0 and at 1 at most")
    q = 2 if least >= 0.85 else 1
    texts = [materialise(d.select(F.col(d.columns[0]).alias("t")).where("t <> ''").distinct(), "texts") for d in (left, right)]
    cut = [d.select("t", F.length("t").alias("n"), F.explode(grams(F.col("t"), q)).alias("g")) for d in texts]
    spread = cut[0].select("g").unionAll(cut[1].select("g")).groupBy("g").agg(F.count("*").alias("held"))

    def first(d: DataFrame, name: str) -> DataFrame:
        ordered = d.join(spread, "g").groupBy("t", "n").agg(F.array_sort(F.collect_list(F.struct("held", "g"))).alias("o"))  # the grams of one text
        return ordered.select(F.col("t").alias(name), F.explode(F.slice("o", F.lit(1), F.greatest(F.size("o") - shared_at_least(F.col("n"), q, least) + 1, F.lit(0)).cast("int"))).alias("x")).select(name, F.col("x.g").alias("g"))

    met = first(cut[0], "a").join(first(cut[1], "b"), "g").where("a <> b").select("a", "b").distinct()
    met = met.where(2.0 * F.least(F.length("a"), F.length("b")) >= (least - 1e-9) * (F.length("a") + F.length("b")))
    met = met.where(ratio_bound(letter_counts(F.col("a")), letter_counts(F.col("b")), F.length("a"), F.length("b")) >= least - 1e-9)
    equal = texts[0].join(texts[1], "t").select(F.col("t").alias("a"), F.col("t").alias("b"), F.lit(1.0).alias("ratio"))
    return met.withColumn("ratio", sequence_ratio(F.col("a"), F.col("b"))).where(F.col("ratio") >= least).unionAll(equal)
