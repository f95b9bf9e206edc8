"""Mixing sources to target weights by temperature, all in built-in expressions.

The token shares p of the sources are exponentiated, w ~ p ** t, and t in [0, 1] is bisected to the
most even mix that meets the target: an entropy of the weights at least ``entropy`` (as a part of the
entropy of the even mix), or no source repeated more than ``max_repeats`` times. 15 inner points at a time halve the
interval four times a pass; a pass is one partial aggregate over the source table, of which only the
sums reach the driver.

The weights are realised as budgeted block permutations. An epoch of a source is a block, a
permutation of its documents by hash; whole blocks are emitted while the source's token budget lasts
and the last block stops before the document that would exceed it. ``budget`` is the tokens to emit;
without one it is the least that keeps every document at least once, so nothing is dropped. Every emitted copy
has its block and its position in it; the mix is read block after block, by position.

A running token sum decides where the last block stops. It is taken by levels of the permutation
hash (two digits of 10 bits, then documents), so that no window holds a source: a hot source is cut
into 2**20 bins of a permutation, and windows run over bins of sums first. What a source emits of the last block is
a beginning of the permutation, so one row a source (its blocks, and where the last one stops) tells the copies of every
document; texts never meet a table of documents.

Defined results: null and empty texts hold no token and go with whole blocks; a null source is a
source of its own; sources without a token have weight 0 and are kept once; ties of the permutation
are broken by doc_id, rows that repeat an id go together; an empty table gives an empty mix.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.shared import clear_of, materialise
from corpusloom.llm.text import words

MAX_REPEATS = 2.0
_POINTS, _PASSES = 15, 8
_SEED = "mix-1"


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def _position(doc_id: Column, block: Column | str) -> Column:
    """The place of a document in a block's permutation: 15 hex digits, the same in any engine with MD5."""
    return F.substring(F.md5(F.concat_ws(":", F.lit(_SEED), (F.col(block) if isinstance(block, str) else block).cast("string"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 15)


def bisect_exponent(shares: DataFrame, meets: Callable[[dict], bool]) -> float:
    """The least exponent t in [0, 1] of which ``meets`` is true; ``meets`` must turn true once as t grows to 1.

    ``shares`` has the column p > 0 of every source. ``meets`` gets sum (of p ** t), entropy (of the
    weights), p_max, p_min and t.
    """
    lo, hi = 0.0, 1.0
    for k in range(_PASSES):
        points = [lo + (hi - lo) * i / (_POINTS + 1) for i in range(0 if k == 0 else 1, _POINTS + 1)]
        power = lambda t: F.pow(F.col("p"), F.lit(t))
        row = shares.agg(F.max("p").alias("p_max"), F.min("p").alias("p_min"), *[f for i, t in enumerate(points) for f in (F.sum(power(t)).alias(f"z{i}"), F.sum(power(t) * F.log("p")).alias(f"l{i}"))]).first()
        for i, t in enumerate(points):
            z = row[f"z{i}"]
            if meets({"t": t, "sum": z, "entropy": math.log(z) - t * row[f"l{i}"] / z, "p_max": row["p_max"], "p_min": row["p_min"]}):
                hi = t
                break
            lo = t
        if hi == lo:
            break
    return hi


def source_weights(rows: DataFrame, *, max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """``rows`` (source__, tokens__) -> source__, n_docs, source_tokens, weight, target_tokens, blocks, last_tokens.

    With ``entropy`` the largest exponent that keeps that entropy is taken, with ``max_repeats`` the
    least that keeps the repetition; exactly one of them is set.
    """
    if (max_repeats is None) == (entropy is None):
        raise ValueError("set max_repeats or entropy")
    sources = materialise(rows.groupBy("source__").agg(F.count("*").alias("n_docs"), F.sum("tokens__").alias("source_tokens")), "sources")
    total = sources.agg(F.sum("source_tokens").alias("t"), F.count(F.when(F.col("source_tokens") > 0, 1)).alias("s")).first()
    tokens, n = total["t"] or 0, total["s"] or 0
    t = 1.0
    if tokens and n > 1:
        shares = sources.where("source_tokens > 0").select((F.col("source_tokens") / F.lit(tokens)).alias("p"))
        if entropy is not None:
            # Entropy falls as t grows: the bound is where it first falls below the target.
            t = bisect_exponent(shares, lambda x: x["entropy"] < entropy * math.log(n))
        elif budget is None:
            t = bisect_exponent(shares, lambda x: (x["p_max"] / x["p_min"]) ** (1 - x["t"]) <= max_repeats)
        else:
            t = bisect_exponent(shares, lambda x: budget / tokens * x["p_min"] ** (x["t"] - 1) / x["sum"] <= max_repeats)
    weigh = F.when(F.col("source_tokens") > 0, F.pow(F.col("source_tokens") / F.lit(float(max(tokens, 1))), F.lit(t))).otherwise(0.0)
    sums = sources.agg(F.sum(weigh).alias("z"), F.max(F.when(F.col("source_tokens") > 0, F.col("source_tokens") / weigh)).alias("most")).first()
    z = sums["z"] or 1.0
    spent = float(budget) if budget is not None else z * (sums["most"] or 0.0)
    # Rounding keeps a source that is to be emitted exactly once from falling a hair short of it.
    ratio = F.when(F.col("source_tokens") > 0, F.round(F.lit(spent / z) * weigh / F.col("source_tokens"), 9)).otherwise(1.0)
    return sources.select("source__", "n_docs", "source_tokens", (weigh / F.lit(z)).alias("weight"), F.floor(ratio).alias("blocks"), F.round((ratio - F.floor(ratio)) * F.col("source_tokens")).cast("long").alias("last_tokens"))


def _last_taken(rows: DataFrame, weights: DataFrame) -> DataFrame:
    """(s__, stop__): the last document (position and id) that each source emits of its last, partial block."""
    placed = rows.join(weights.select(F.col("source__").alias("w__"), "blocks", "last_tokens"), F.col("source__").eqNullSafe(F.col("w__"))).where("last_tokens > 0")
    placed = placed.withColumn("p__", _position(F.col("id__"), "blocks")).withColumn("h__", F.conv("p__", 16, 10).cast("long"))
    keyed = placed.select("row__", F.coalesce(F.concat(F.lit("="), "source__"), F.lit("null")).alias("s__"), F.shiftright("h__", 50).alias("a__"), F.shiftright("h__", 40).alias("b__"), "p__", "id__", "tokens__", "last_tokens")
    fine = keyed.groupBy("s__", "a__", "b__").agg(F.sum("tokens__").alias("f__"))
    coarse = fine.groupBy("s__", "a__").agg(F.sum("f__").alias("c__"))
    before = lambda v, *by: F.coalesce(F.sum(v).over(Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    coarse = coarse.select("s__", "a__", before("c__", "s__", "a__").alias("c0__"))
    fine = fine.select("s__", "a__", "b__", before("f__", "s__", "a__", "b__").alias("f0__")).join(coarse, ["s__", "a__"]).select("s__", "b__", (F.col("c0__") + F.col("f0__")).alias("o__"))
    upto = F.sum("tokens__").over(Window.partitionBy("s__", "b__").orderBy("p__", "id__", "row__").rowsBetween(Window.unboundedPreceding, 0))
    summed = keyed.withColumn("u__", upto).join(fine, ["s__", "b__"]).where(F.col("o__") + F.col("u__") <= F.col("last_tokens"))
    return summed.groupBy("s__").agg(F.max(F.struct(F.col("p__").alias("p"), F.col("id__").alias("i"))).alias("stop__"))


def source_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """One row a source (null included): source__, n_docs, source_tokens, weight, blocks, last_tokens, stop__ (the last document of the partial block; null: none)."""
    base = docs.select(F.col(id_col).alias("id__"), F.col(source_col).cast("string").alias("source__"), token_count(F.col(text_col)).alias("tokens__"))
    rows = materialise(base.withColumn("row__", F.monotonically_increasing_id()), "tokens")
    weights = materialise(source_weights(rows, max_repeats=max_repeats, entropy=entropy, budget=budget), "weights")
    last = _last_taken(rows, weights)
    return materialise(weights.withColumn("s__", F.coalesce(F.concat(F.lit("="), "source__"), F.lit("null"))).join(last, "s__", "left").drop("s__"), "sources")


def _copies(docs: DataFrame, sources: DataFrame, id_col: str, source_col: str) -> DataFrame:
    """``docs`` with weight__, blocks__ and copies__."""
    clear_of(docs.columns, "s__", "stop__", "weight__", "blocks__", "copies__", "block__", "position__")
    own = sources.select(F.col("source__").alias("s__"), F.col("weight").alias("weight__"), F.col("blocks").alias("blocks__"), "stop__")
    joined = docs.join(own, F.col(source_col).cast("string").eqNullSafe(F.col("s__")))
    taken = F.struct(_position(F.col(id_col), "blocks__").alias("p"), F.col(id_col).alias("i")) <= F.col("stop__")
    return joined.withColumn("copies__", F.col("blocks__") + F.coalesce(taken, F.lit(False)).cast("int")).drop("s__", "stop__")


def plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_repeats: float | None = MAX_REPEATS, entropy: float | None = None, budget: int | None = None) -> DataFrame:
    """One row a document: id, source, n_tokens, weight (of the source), blocks, copies (times it is emitted)."""
    sources = source_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, max_repeats=max_repeats, entropy=entropy, budget=budget)
    narrow = docs.select(id_col, F.col(source_col).cast("string").alias(source_col), token_count(F.col(text_col)).alias("n_tokens"))
    return _copies(narrow, sources, id_col, source_col).select(id_col, source_col, "n_tokens", F.col("weight__").alias("weight"), F.col("blocks__").alias("blocks"), F.col("copies__").alias("copies"))


def realise(docs: DataFrame, sources: DataFrame, *, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """The columns of ``docs``, each row once for every copy, with ``block__`` (from 0) and ``position__`` (in the block's permutation).

    Columns with these names, or s__, stop__, weight__, blocks__ and copies__, have to be renamed first.
    """
    emitted = _copies(docs, sources, id_col, source_col).where("copies__ > 0").withColumn("block__", F.explode(F.sequence(F.lit(0), F.col("copies__").cast("int") - 1)))
    return emitted.withColumn("position__", _position(F.col(id_col), "block__")).select(*docs.columns, "block__", "position__")


def in_order(emitted: DataFrame, sources: DataFrame) -> DataFrame:
    """Realised rows in the order of the mix, by block and position, over all partitions from the first to the last.

    Positions are hashes, so the range of a partition is known without looking at the rows.
    """
    partitions = int(emitted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = sources.agg(F.max(F.col("blocks") + F.col("stop__").isNotNull().cast("int")).alias("n")).first()["n"] or 1
    place = F.conv(F.substring("position__", 1, 8), 16, 10).cast("double") / float(1 << 32)
    part = F.least(F.lit(partitions - 1), F.floor((F.col("block__") + place) * (partitions / blocks)).cast("int"))
    return emitted.repartitionById(partitions, part).sortWithinPartitions("block__", "position__")


def document_mix(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, weight (8 digits), block and position of every copy of every document."""
    copies = plan(docs).withColumn("block", F.explode(F.expr("sequence(0L, copies - 1)")))
    return copies.select("doc_id", "source", "n_tokens", F.round("weight", 8).alias("weight"), "block", _position(F.col("doc_id"), "block").alias("position"))


def oracle_sql() -> str:
    """DuckDB SQL for ``document_mix``: the exponent in closed form, since the repetition bound has one."""
    return rf"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS n FROM documents),
s AS (SELECT source, sum(n)::BIGINT AS tok FROM d GROUP BY source),
a AS (SELECT sum(tok) AS total, max(tok) / min(tok) AS span FROM s WHERE tok > 0),
e AS (SELECT total, CASE WHEN span > {MAX_REPEATS} THEN 1 - ln({MAX_REPEATS}) / ln(span) ELSE 0 END AS t FROM a),
w AS (SELECT source, tok, CASE WHEN tok > 0 THEN pow(tok / total, t) ELSE 0 END AS w FROM s, e),
z AS (SELECT sum(w) AS z, max(CASE WHEN tok > 0 THEN tok / w END) AS most FROM w),
r AS (SELECT source, tok, w / z AS weight, CASE WHEN tok > 0 THEN round(most * w / tok, 9) ELSE 1 END AS r FROM w, z),
b AS (SELECT source, weight, floor(r)::BIGINT AS blocks, round((r - floor(r)) * tok)::BIGINT AS last FROM r),
q AS (SELECT d.*, b.weight, b.blocks, b.last, sum(n) OVER (PARTITION BY d.source ORDER BY left(md5('{_SEED}:' || b.blocks || ':' || coalesce(doc_id::VARCHAR, '')), 15), doc_id ROWS UNBOUNDED PRECEDING) AS upto
      FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
c AS (SELECT *, unnest(range(blocks + (last > 0 AND upto <= last)::INT::BIGINT)) AS block FROM q)
SELECT doc_id, source, n AS n_tokens, round(weight, 8) AS weight, block, left(md5('{_SEED}:' || block || ':' || coalesce(doc_id::VARCHAR, '')), 15) AS position FROM c"""
