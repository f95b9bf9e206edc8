"""Vector search, near-duplicate vectors, clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.similarity import cosine, unit
from corpusloom.workspace import materialise


def nearest(df: DataFrame, query: list[float], *, id_col: str, embedding: str = "embedding", k: int = 10, least: float = 0.0, where: Column | None = None) -> DataFrame:
    """Top k by cosine to a query vector: a scan and a bounded top-k in each task, no shuffle of vectors."""
    rows = df.where(where) if where is not None else df
    q = F.array(*[F.lit(float(x)) for x in query])
    return rows.withColumn("score", cosine(F.col(embedding), q)).where(F.col("score") >= least).orderBy(F.desc("score"), id_col).limit(k)


def similar_to(df: DataFrame, ident, *, id_col: str, embedding: str = "embedding", k: int = 10, least: float = 0.0, exclude_self: bool = True) -> DataFrame:
    """Top k by cosine to the vector of one row (a broadcast of that row)."""
    one = df.where(F.col(id_col) == F.lit(ident)).limit(1).select(F.col(embedding).alias("q__"))
    rows = df.where(F.col(id_col) != F.lit(ident)) if exclude_self else df
    return rows.join(F.broadcast(one), how="cross").withColumn("score", cosine(F.col(embedding), F.col("q__"))).drop("q__").where(F.col("score") >= least).orderBy(F.desc("score"), id_col).limit(k)


def near_pairs(df: DataFrame, *, id_col: str, embedding: str = "embedding", least: float = 0.92, block: Column | None = None, differ: str | None = None, tile_rows: int = 4096) -> DataFrame:
    """Pairs (id_a, id_b, score) at ``least`` or more whose ``differ`` columns differ. Exact.

    In many dimensions no grid or pivot prunes pairs without losing some, so rows are dealt into tiles of
    about ``tile_rows`` and every two tiles meet in one task as a matrix product: a task holds two tiles,
    however large the table, and only the pairs found leave it. The products grow with the square of the
    rows that share a ``block``; give one where the data has a key that near vectors share.
    """
    n = df.count()
    tiles = max(1, -(-n // tile_rows))
    rows = df.select(F.col(id_col).alias("id"), unit(F.col(embedding)).alias("v"), (F.col(differ).cast("string") if differ else F.lit(None).cast("string")).alias("d"), (block.cast("string") if block is not None else F.lit("")).alias("g"), F.pmod(F.xxhash64(id_col), F.lit(tiles)).alias("t"))
    met = rows.where("v is not null").withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1)))).withColumns({"p": F.least("t", "o"), "q": F.greatest("t", "o")})
    differs = differ is not None

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        one, two = pdf[pdf.t == pdf.p.iloc[0]], pdf[pdf.t == pdf.q.iloc[0]]
        if not len(one) or not len(two):
            return pd.DataFrame({"id_a": one.id[:0], "id_b": one.id[:0], "score": np.zeros(0)})
        scores = np.stack(one.v.to_numpy()) @ np.stack(two.v.to_numpy()).T
        i, j = np.nonzero(scores >= least)
        a, b = one.id.to_numpy()[i], two.id.to_numpy()[j]
        keep = a < b if pdf.p.iloc[0] == pdf.q.iloc[0] else a != b
        if differs:
            keep &= np.array([x != y for x, y in zip(one.d.to_numpy()[i], two.d.to_numpy()[j])], bool)
        a, b, s = a[keep], b[keep], scores[i, j][keep]
        return pd.DataFrame({"id_a": np.where(a < b, a, b), "id_b": np.where(a < b, b, a), "score": s})

    kind = df.schema[id_col].dataType.simpleString()
    return met.groupBy("g", "p", "q").applyInPandas(product, f"id_a {kind}, id_b {kind}, score double")


def label_pairs(pairs: DataFrame, *, duplicate: float = 0.95) -> DataFrame:
    return pairs.withColumn("kind", F.when(F.col("score") > duplicate, "duplicate").otherwise("similar"))


def first_centres(df: DataFrame, *, id_col: str, embedding: str = "embedding", k: int, starts: int, seed: int = 42) -> np.ndarray:
    """(starts, k, dimension): for every start the k rows that a hash of id, vector and start puts first. A bounded top-k for each."""
    out = []
    for s in range(starts):
        order = F.xxhash64(F.lit(seed), F.lit(s), F.col(id_col).cast("string"), F.col(embedding))
        out.append([[float(x) for x in r["v"]] for r in df.where(F.col(embedding).isNotNull()).orderBy(order, id_col).select(F.col(embedding).alias("v")).limit(k).collect()])
    return np.array(out)


def lloyd(df: DataFrame, centres: np.ndarray, *, embedding: str = "embedding", rounds: int = 50, tolerance: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Centres and inertia of every start. All starts share each pass: a task adds up its rows by start and centre, Spark adds up the tasks; a centre without rows stays.

    The driver sees starts x k rows a round.
    """
    spark, (starts, k, dim) = df.sparkSession, centres.shape
    rows = df.where(F.col(embedding).isNotNull()).select(F.transform(embedding, lambda x: x.cast("double")).alias("v"))
    inertia = np.zeros(starts)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(centres)

        def add_up(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            flat = shared.value.reshape(starts * k, dim)
            total, count, apart = np.zeros((starts * k, dim)), np.zeros(starts * k, np.int64), np.zeros(starts * k)
            for pdf in parts:
                if not len(pdf):
                    continue
                x = np.stack(pdf.v.to_numpy())
                d = ((x**2).sum(1)[:, None] + (flat**2).sum(1) - 2 * x @ flat.T).reshape(len(x), starts, k)
                own = d.argmin(2)
                at = (own + np.arange(starts) * k).ravel()
                np.add.at(total, at, np.repeat(x, starts, axis=0))
                np.add.at(apart, at, np.maximum(np.take_along_axis(d, own[:, :, None], 2).ravel(), 0))
                count += np.bincount(at, minlength=starts * k)
            hit = np.flatnonzero(count)
            if not len(hit):  # a task without rows: a frame without rows has no lists that Arrow could tell
                return
            yield pd.DataFrame({"at": hit, "n": count[hit], "apart": apart[hit], "total": list(total[hit])})

        each = rows.mapInPandas(add_up, "at long, n long, apart double, total array<double>")
        summed = each.groupBy("at").agg(F.sum("n").alias("n"), F.sum("apart").alias("apart"), F.array(*[F.sum(F.get("total", F.lit(i))) for i in range(dim)]).alias("total")).collect()
        moved, inertia = centres.reshape(starts * k, dim).copy(), np.zeros(starts)
        for r in summed:
            moved[r["at"]] = np.array(r["total"]) / r["n"]
            inertia[r["at"] // k] += r["apart"]
        shift = np.abs(moved - centres.reshape(starts * k, dim)).max(initial=0)
        centres = moved.reshape(starts, k, dim)
        if shift <= tolerance:
            break
    return centres, inertia


def clusters(df: DataFrame, *, id_col: str, embedding: str = "embedding", k: int = 10, starts: int = 10, seed: int = 42, least_size: int = 2) -> DataFrame:
    """K-means, the best of ``starts`` starts by inertia (the first of equal ones): id, cluster, members, representative (the member nearest its centre by cosine).

    Fewer than ``k`` rows give no cluster; clusters under ``least_size`` are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    first = first_centres(df, id_col=id_col, embedding=embedding, k=k, starts=starts, seed=seed)
    if first.ndim < 3 or first.shape[1] < k:
        return df.sparkSession.createDataFrame([], f"`{id_col}` {kind}, cluster int, members long, representative {kind}")
    centres, inertia = lloyd(df, first, embedding=embedding)
    best = centres[int(np.argmin(inertia))]
    table = F.array(*[F.struct(F.lit(i).alias("cluster"), F.array(*map(F.lit, c.tolist())).alias("centre")) for i, c in enumerate(best)])
    gap = lambda c: F.aggregate(F.zip_with(F.col(embedding), c["centre"], lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
    near = F.array_min(F.transform(table, lambda c: F.struct(gap(c).alias("d"), c["cluster"].alias("cluster"), c["centre"].alias("centre"))))
    scored = df.where(F.col(embedding).isNotNull()).select(id_col, embedding, near.alias("c")).select(id_col, "c.cluster", cosine(F.col(embedding), F.col("c.centre")).alias("score"))
    scored = materialise(scored, "clusters")
    named = scored.groupBy("cluster").agg(F.count("*").alias("members"), F.max_by(id_col, F.struct("score", id_col)).alias("representative")).where(F.col("members") >= least_size)
    return scored.join(F.broadcast(named), "cluster").select(id_col, "cluster", "members", "representative")  # k rows


def index_stats(df: DataFrame, embedding: str = "embedding") -> DataFrame:
    return df.agg(F.count("*").alias("rows_total"), F.count(embedding).alias("indexed"), F.max(F.size(embedding)).alias("dimension"))


def missing_embeddings(entities: DataFrame, index: DataFrame, key: str, model: str) -> DataFrame:
    return entities.join(index.where(F.col("model") == model).select(key), key, "left_anti")


def top_per_group(scored: DataFrame, group: str, id_col: str, k: int) -> DataFrame:
    w = Window.partitionBy(group).orderBy(F.desc("score"), id_col)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
