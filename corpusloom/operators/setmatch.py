"""A query set of token sets against all documents: shared tokens are counted document by document, never as joined rows.

The query set is taken in blocks (``BLOCK_QUERIES`` rows, ``BLOCK_BYTES`` of tokens), each a broadcast and a pass over the
documents. A task turns a document's tokens into counts for all queries of the block by adding up posting lists, and hands on
what is asked for only: each query's best document so far, or the pairs above a threshold. A word that stands everywhere costs an addition, no row.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.workspace import materialise

BLOCK_QUERIES, BLOCK_BYTES = 2048, 8 << 20


class _Postings:
    """Of a block of queries: which queries have a token, and how many tokens each has."""

    def __init__(self, rows: list[tuple[int, list[str]]]):
        self.keys, self.sizes = np.array([k for k, _ in rows], np.int64), np.array([len(t) for _, t in rows], np.int64)
        lists = defaultdict(list)
        for n, (_, tokens) in enumerate(rows):
            for t in tokens:
                lists[t].append(n)
        self.lists = {t: np.array(v, np.int64) for t, v in lists.items()}

    def counts(self, tokens: Iterator[str]) -> np.ndarray:
        held = [x for x in map(self.lists.get, tokens) if x is not None]
        return np.bincount(np.concatenate(held), minlength=len(self.keys)) if held else np.zeros(len(self.keys), np.int64)


def _in_blocks(queries: DataFrame, run: Callable[[list[tuple[int, list[str]]]], DataFrame]) -> DataFrame | None:
    """``run`` for every block of ``queries`` (q, tokens); the blocks' results together."""
    table = materialise(queries.where(F.size("tokens") > 0).select(F.col("q").cast("long").alias("q"), "tokens"), "query-set")
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.expr("aggregate(tokens, 0L, (a, t) -> a + octet_length(t) + 60)")), F.lit(0)).alias("bytes")).first()
    blocks = max(-(-size["n"] // BLOCK_QUERIES), -(-size["bytes"] // BLOCK_BYTES))
    found = []
    for k in range(blocks):
        rows = [(r["q"], r["tokens"]) for r in table.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == k).collect()]
        if rows:
            found.append(run(rows))
    return reduce(DataFrame.unionAll, found) if found else None


def best_jaccard(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(q, id): of every query (q long, tokens) the document (id long, tokens) of greatest Jaccard similarity, the smallest id of several; none where no token is shared."""
    spark = docs.sparkSession

    def block(rows: list[tuple[int, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = _Postings(shared.value)
            best, ids = np.zeros(len(of.keys)), np.full(len(of.keys), np.iinfo(np.int64).max)
            for batch in batches:
                for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if key is None or not tokens:
                        continue
                    n = of.counts(tokens)
                    j = n / (of.sizes + len(tokens) - n)
                    better = (j > best) | (j == best) & (n > 0) & (key < ids)
                    best[better], ids[better] = j[better], key
            hit = best > 0
            yield pa.RecordBatch.from_arrays([pa.array(of.keys[hit]), pa.array(ids[hit]), pa.array(best[hit])], names=["q", "id", "j"])

        return docs.select(F.col("id").cast("long").alias("id"), "tokens").mapInArrow(run, "q long, id long, j double")

    found = _in_blocks(queries, block)
    if found is None:
        return spark.createDataFrame([], "q long, id long")
    return found.groupBy("q").agg(F.min(F.struct((-F.col("j")).alias("j"), "id")).alias("m")).select("q", F.col("m.id").alias("id"))


def pairs_above(queries: DataFrame, docs: DataFrame, *, of_query: float, of_doc: float, least_tokens: int = 1) -> DataFrame:
    """(q, id, n): the pairs that share n tokens, at least the given shares of the query's and of the document's, both of ``least_tokens`` or more."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()

    def block(rows: list[tuple[int, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast([r for r in rows if len(r[1]) >= least_tokens])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of = _Postings(shared.value)
            for batch in batches:
                qs, at, ns = [], [], []
                for k, tokens in enumerate(batch.column(1).to_pylist()):
                    if tokens and len(tokens) >= least_tokens:
                        n = of.counts(tokens)
                        hit = np.flatnonzero((n / np.maximum(of.sizes, 1) >= of_query) & (n / len(tokens) >= of_doc) & (n > 0))
                        qs += of.keys[hit].tolist()
                        at += [k] * len(hit)
                        ns += n[hit].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(ns, pa.int64())], names=["q", "id", "n"])

        return docs.select("id", "tokens").mapInArrow(run, f"q long, id {kind}, n long")

    found = _in_blocks(queries, block)
    return spark.createDataFrame([], f"q long, id {kind}, n long") if found is None else found


def contained_above(queries: DataFrame, docs: DataFrame, *, least: float) -> DataFrame:
    """(q, id, share): where at least ``least`` of a query's tokens occur in the lower-cased text of a document (id, text) as substrings; one pass of all patterns over a text."""
    spark, kind = docs.sparkSession, docs.schema["id"].dataType.simpleString()

    def block(rows: list[tuple[int, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(rows)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            of, patterns = _Postings(shared.value), ahocorasick.Automaton()
            for t in of.lists:
                patterns.add_word(t, t)
            patterns.make_automaton()
            for batch in batches:
                qs, at, shares = [], [], []
                for k, text in enumerate(batch.column(1).to_pylist()):
                    share = of.counts({t for _, t in patterns.iter(text)}) / of.sizes if text else None
                    hit = np.flatnonzero(share >= least) if text else ()
                    qs += of.keys[hit].tolist() if text else []
                    at += [k] * len(hit)
                    shares += share[hit].tolist() if text else []
                yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), batch.column(0).take(pa.array(at, pa.int64())), pa.array(shares, pa.float64())], names=["q", "id", "share"])

        return docs.select("id", F.lower("text").alias("text")).mapInArrow(run, f"q long, id {kind}, share double")

    found = _in_blocks(queries, block)
    return spark.createDataFrame([], f"q long, id {kind}, share double") if found is None else found
