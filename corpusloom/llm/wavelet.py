"""Ranked lexical search in shards of dual-sorted wavelet trees.

A shard holds some thousand documents. The posting lists of its terms stand one behind the other, each by
falling impact, and the sequence of their documents is a wavelet tree: level by level, the next bit of
every document's number, and the sequence dealt stably to zeros and ones. So a node is a range of
documents, in which every list is a range again, still by falling impact: lists can be read by impact and by
document alike. The first posting of a range has the largest impact in it; weighted and summed over
a query's terms this bounds every score in the subtree, and at a leaf it is the score.

A query opens the nodes with the largest bounds first, a batch at a time, keeps those in which some of its terms
meet documents, and stops when no bound reaches its k-th best score. The k-th best of some documents at the heads
of its heaviest lists, over all shards, is where that score starts; a node is left out only below it, so results are exact.

The score of a term in a document is ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` with
``m = 10 + (90 * n * N) div L`` and ``w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))``; the second factor is the impact.

Shards are built where the rows are, without a shuffle. Queries come in blocks of a bounded size; a shard
answers a block from one load, with at most k rows a query that reach the block's floor.

Defined results: null texts and texts without a term are not counted and not found; a query without a term, or
with none that a document holds, gets no row. Equal scores rank by document, ids that are null last; repeated
rows are documents of their own; of rows with one item_id each is a query of its own. Empty tables give an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.shared import written

#: A shard ends with the document that reaches one of these: documents, postings.
SHARD_DOCS, SHARD_POSTINGS = 4096, 1 << 20
#: Queries, and bytes of their terms, that a task holds at once.
BLOCK_QUERIES, BLOCK_BYTES = 512, 4 << 20
#: Nodes that are opened together; lists and postings from the heads of which a query's first floor comes.
BATCH, SEED_LISTS, SEED_POSTINGS = 128, 8, 4
#: A term is a run of these characters: letters and digits of ASCII, and all others.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """The terms of a text in order, A-Z lower-cased, in UTF-8."""
    return (text or "").encode().translate(_FOLD).split()


def impact(tf, n, docs: int, total: int):
    """What a term brings a document before its weight; integers or arrays of 64 bits."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))


def weight(df: int, docs: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


class Shard:
    """A loaded shard: for every level how many ones stand before each place, and the impacts as that level orders them."""

    def __init__(self, vocab: bytes, starts: bytes, impacts: bytes, bits: bytes, n_docs: int):
        self.vocab, self.starts = vocab.split(b"\n"), np.frombuffer(starts, np.int32)
        root = np.frombuffer(impacts, np.int32)
        n = self.n = len(root)
        self.levels = levels_of(n_docs)
        packed = np.frombuffer(bits, np.uint8).reshape(self.levels, -1)
        self.ones = np.zeros((self.levels, n + 1), np.int32)
        self.impacts = np.empty((self.levels + 1, n), np.int32)
        self.impacts[0] = root
        for k in range(self.levels):
            bit = np.unpackbits(packed[k], count=n).view(bool)
            np.cumsum(bit, out=self.ones[k, 1:])
            zeros = n - int(self.ones[k, -1])
            self.impacts[k + 1, :zeros], self.impacts[k + 1, zeros:] = self.impacts[k][~bit], self.impacts[k][bit]
        self.zeros = n - self.ones[:, -1].astype(np.int64)
        self.flat_ones, self.flat_impacts = self.ones.ravel(), self.impacts.ravel()

    def lists(self, query: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and weight of the query's lists that stand in the shard, the heaviest first."""
        found = []
        for term, w in query:
            k = bisect_left(self.vocab, term)
            if k < len(self.vocab) and self.vocab[k] == term:
                found.append((w, self.starts[k], self.starts[k + 1]))
        found.sort(key=lambda x: -x[0])
        return tuple(np.array([x[i] for x in found], np.int64) for i in (1, 2, 0))

    def documents(self, places: np.ndarray) -> np.ndarray:
        """The documents of postings, by their places in the root."""
        docs = np.zeros(len(places), np.int64)
        for k in range(self.levels):
            before, after = self.ones[k, places].astype(np.int64), self.ones[k, places + 1]
            one = after > before
            docs = docs << 1 | one
            places = np.where(one, self.zeros[k] + before, places - before)
        return docs

    def scores(self, docs: np.ndarray, lists: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """The exact scores of documents: every list is narrowed to the document, level by level."""
        s, e = (np.broadcast_to(x, (len(docs), len(x))).copy() for x in lists[:2])
        for k in range(self.levels):
            one = (docs >> (self.levels - 1 - k) & 1)[:, None] == 1
            a, b = self.ones[k][s].astype(np.int64), self.ones[k][e].astype(np.int64)
            s, e = np.where(one, self.zeros[k] + a, s - a), np.where(one, self.zeros[k] + b, e - b)
        held = e > s
        return (self.impacts[self.levels][np.where(held, s, 0)].astype(np.int64) * held * lists[2]).sum(1)

    def seeds(self, lists: tuple[np.ndarray, np.ndarray, np.ndarray], k: int) -> np.ndarray:
        """The k best scores of the documents at the heads of the heaviest lists."""
        s, e = lists[0][:SEED_LISTS], lists[1][:SEED_LISTS]
        heads = s[:, None] + np.arange(SEED_POSTINGS)
        return -np.sort(-self.scores(np.unique(self.documents(heads[heads < e[:, None]])), lists))[:k]

    def search(self, lists: tuple[np.ndarray, np.ndarray, np.ndarray], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents and their scores, of those that reach ``floor`` (above 0), the best first."""
        s, e, w = lists
        best_docs = best = np.zeros(0, np.int64)
        level, key, size = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(s)])
        bound = np.array([(w * self.impacts[0][s]).sum()])
        while len(bound) and bound.max() >= floor:
            chosen = np.zeros(len(bound), bool)
            chosen[np.argpartition(-bound, BATCH)[:BATCH] if len(bound) > BATCH else slice(None)] = True
            chosen &= bound >= floor
            mine = np.repeat(chosen, size)
            at, owner = np.repeat(level[chosen], size[chosen]), np.repeat(np.arange(int(chosen.sum())), size[chosen])
            ps, pe, pw = s[mine], e[mine], w[mine]
            a, b = self.flat_ones[at * (self.n + 1) + ps].astype(np.int64), self.flat_ones[at * (self.n + 1) + pe].astype(np.int64)
            zeros = self.zeros[at]
            cs, ce = np.stack([ps - a, zeros + a], 1).ravel(), np.stack([pe - b, zeros + b], 1).ravel()
            child = np.stack([2 * owner, 2 * owner + 1], 1).ravel()
            live = ce > cs
            cs, ce, child, cw, below = cs[live], ce[live], child[live], np.repeat(pw, 2)[live], np.repeat(at, 2)[live] + 1
            order = np.argsort(child, kind="stable")
            cs, ce, child, cw, below = cs[order], ce[order], child[order], cw[order], below[order]
            total = np.zeros(2 * len(level[chosen]), np.int64)
            np.add.at(total, child, cw * self.flat_impacts[below * self.n + cs])
            c_level, c_key = np.repeat(level[chosen] + 1, 2), np.stack([2 * key[chosen], 2 * key[chosen] + 1], 1).ravel()
            leaf = (c_level == self.levels) & (total >= floor)
            if leaf.any():
                docs, scores = np.concatenate([best_docs, c_key[leaf]]), np.concatenate([best, total[leaf]])
                top = np.lexsort((docs, -scores))[:k]
                best_docs, best = docs[top], scores[top]
                floor = max(floor, int(best[-1])) if len(best) == k else floor
            grow = (c_level < self.levels) & (total >= floor)
            rest, kept, theirs = ~chosen, np.repeat(~chosen, size), grow[child]
            s, e, w = np.concatenate([s[kept], cs[theirs]]), np.concatenate([e[kept], ce[theirs]]), np.concatenate([w[kept], cw[theirs]])
            size = np.concatenate([size[rest], np.bincount(child, minlength=len(total))[grow]])
            level, key, bound = np.concatenate([level[rest], c_level[grow]]), np.concatenate([key[rest], c_key[grow]]), np.concatenate([bound[rest], total[grow]])
        return best_docs, best


def levels_of(n_docs: int) -> int:
    return max(1, (n_docs - 1).bit_length())


class _Builder:
    """Collects the documents of a shard and turns them into its row."""

    def __init__(self, docs: int, total: int):
        self.docs, self.total = docs, total
        self.clear()

    def clear(self) -> None:
        self.ids, self.sizes, self.held, self.times, self.postings = [], [], [], [], 0
        self.vocab = defaultdict(lambda: len(self.vocab))

    def add(self, key, words: list[bytes]) -> None:
        counts = Counter(words)
        self.ids.append(key)
        self.sizes.append(len(words))
        self.held.append(np.fromiter(map(self.vocab.__getitem__, counts), np.int64, len(counts)))
        self.times.append(np.fromiter(counts.values(), np.int64, len(counts)))
        self.postings += len(counts)

    def full(self) -> bool:
        return len(self.ids) >= SHARD_DOCS or self.postings >= SHARD_POSTINGS

    def row(self, number: int, kind: pa.DataType) -> pa.RecordBatch:
        order = sorted(range(len(self.ids)), key=lambda k: (self.ids[k] is None, self.ids[k] if self.ids[k] is not None else 0))
        vocab = list(self.vocab)
        by_name = sorted(range(len(vocab)), key=vocab.__getitem__)
        rank = np.empty(len(vocab), np.int64)
        rank[by_name] = np.arange(len(vocab))
        doc = np.repeat(np.arange(len(order)), [len(self.held[k]) for k in order])
        tf = np.concatenate([self.times[k] for k in order])
        value = impact(tf, np.array([self.sizes[k] for k in order], np.int64)[doc], self.docs, self.total)
        term = rank[np.concatenate([self.held[k] for k in order])]
        packed = np.sort(term << 33 | ((1 << 20) - value) << 13 | doc)  # an impact is below 2**20, a document below 2**13
        term, value, doc = packed >> 33, (1 << 20) - (packed >> 13 & (1 << 20) - 1), packed & (1 << 13) - 1
        starts = np.searchsorted(term, np.arange(len(vocab) + 1))
        bits, depth = [], levels_of(len(order))
        for k in range(depth):
            bit = (doc >> (depth - 1 - k) & 1).astype(bool)
            bits.append(np.packbits(bit).tobytes())
            doc = np.concatenate([doc[~bit], doc[bit]])
        row = [number, [self.ids[k] for k in order], b"\n".join(vocab[k] for k in by_name), starts.astype(np.int32).tobytes(), value.astype(np.int32).tobytes(), b"".join(bits)]
        self.clear()
        kinds = [pa.int64(), pa.list_(kind), *[pa.binary()] * 4]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds)], names=["shard", "ids", "vocab", "starts", "impacts", "bits"])


@dataclass
class Index:
    """The shards as a table, with N (documents that hold a term) and L (terms in all of them)."""

    shards: DataFrame
    docs: int
    total: int


def build(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """Two passes over the texts: one counts, one builds the shards, which are written to the shared folder."""
    n = F.regexp_count(F.coalesce(text_col, F.lit("")), F.lit(TERM)).cast("long")
    counts = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("total")).first()
    kind = docs.schema[id_col].dataType
    arrow_kind = to_arrow_type(kind)
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("ids", T.ArrayType(kind)), *(T.StructField(c, T.BinaryType()) for c in ("vocab", "starts", "impacts", "bits"))])
    n_docs, total = counts["docs"], counts["total"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        builder, number = _Builder(n_docs, total), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if words := terms(text):
                        builder.add(key, words)
                        if builder.full():
                            yield builder.row(number, arrow_kind)
                            number += 1
        if builder.ids:
            yield builder.row(number, arrow_kind)

    return Index(written(docs.select(id_col, text_col).mapInArrow(run, schema), "shards")[0], n_docs, total)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """One shard after the other, never a batch of them as objects."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield [c[k] for c in batch.columns]


def frequencies(index: Index, vocabulary: list[bytes]) -> DataFrame:
    """(term, df): in how many documents each term of ``vocabulary`` stands, a row for each shard that has it, summed."""
    wanted = index.shards.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for vocab, starts in _rows(batches):
            names, first, found = vocab.as_py().split(b"\n"), np.frombuffer(starts.as_py(), np.int32), []
            for term in wanted.value:
                k = bisect_left(names, term)
                if k < len(names) and names[k] == term:
                    found.append((term, int(first[k + 1] - first[k])))
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.binary()), pa.array([n for _, n in found], pa.int64())], names=["term", "df"])

    return index.shards.select("vocab", "starts").mapInArrow(run, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


def _query_table(queries: DataFrame, item_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(q, item, terms, block) for every row of ``queries`` that has a term, written; and the number of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms(t))) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["q", "item", "terms"])

    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("item", queries.schema[item_col].dataType), T.StructField("terms", T.ArrayType(T.BinaryType()))])
    named = queries.select(F.monotonically_increasing_id().alias("q"), F.col(item_col).alias("item"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    table, _ = written(named.where(F.size("terms") > 0), "queries")
    size = table.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.expr("aggregate(terms, 0L, (a, t) -> a + octet_length(t) + 40)")), F.lit(0)).alias("bytes")).first()
    return table, max(1, -(-size["n"] // BLOCK_QUERIES), -(-size["bytes"] // BLOCK_BYTES))


def search(index: Index, queries: DataFrame, *, k: int = 10, item_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(item, rank, id, score): the k best documents of the whole index for every row of ``queries``.

    A block of queries (512, 4 MB of terms) is a broadcast, a pass over the shards' heads and one over the shards.
    """
    spark = index.shards.sparkSession
    kind = index.shards.schema["ids"].dataType.elementType
    table, n_blocks = _query_table(queries, item_col, text_col)
    found = []
    for block in range(n_blocks):
        rows = table.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block).select("q", "terms").collect() if index.docs else []
        df = {bytes(r["term"]): r["df"] for r in frequencies(index, sorted({bytes(t) for r in rows for t in r["terms"]})).collect()} if rows else {}
        w = {t: weight(n, index.docs) for t, n in df.items()}
        asked = [(r["q"], [(bytes(t), w[bytes(t)]) for t in r["terms"] if w.get(bytes(t), 0) > 0]) for r in rows]
        if asked := [x for x in asked if x[1]]:
            found.append(written(_answers(index, asked, k, _floors(index, asked, k), kind), "answers")[0])
    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    answers = reduce(DataFrame.unionAll, found) if found else spark.createDataFrame([], schema)
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id")))).where(F.col("rank") <= k)
    items = table.select("q", "item")
    return ranked.join(items, "q").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _loaded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Scalar, Shard]]:
    for ids, vocab, starts, impacts, bits in _rows(batches):
        yield ids, Shard(vocab.as_py(), starts.as_py(), impacts.as_py(), bits.as_py(), len(ids))


def _shards(index: Index) -> DataFrame:
    return index.shards.select("ids", "vocab", "starts", "impacts", "bits")


def _floors(index: Index, asked: list[tuple[int, list]], k: int) -> dict[int, int]:
    """By query a score that k documents reach at least; queries for which fewer were seen are left out."""
    shared = index.shards.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, shard in _loaded(batches):
            qs, scores = [], []
            for q, query in shared.value:
                lists = shard.lists(query)
                if len(lists[0]):
                    best = shard.seeds(lists, k)
                    qs.append(np.full(len(best), q))
                    scores.append(best)
            if qs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(qs)), pa.array(np.concatenate(scores))], names=["q", "score"])

    heads = _shards(index).mapInArrow(run, "q long, score long")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    return {r["q"]: r["score"] for r in heads.withColumn("nth", nth).where(F.col("nth") == k).select("q", "score").collect()}


def _answers(index: Index, asked: list[tuple[int, list]], k: int, floors: dict[int, int], kind: T.DataType) -> DataFrame:
    shared = index.shards.sparkSession.sparkContext.broadcast([(q, query, max(1, floors.get(q, 1))) for q, query in asked])
    arrow_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, shard in _loaded(batches):
            qs, docs, scores = [], [], []
            for q, query, floor in shared.value:
                lists = shard.lists(query)
                if len(lists[0]):
                    best, score = shard.search(lists, k, floor)
                    qs += [q] * len(best)
                    docs += best.tolist()
                    scores += score.tolist()
            names = ids.values.take(pa.array(docs, pa.int64())).cast(arrow_kind)
            yield pa.RecordBatch.from_arrays([pa.array(qs, pa.int64()), names, pa.array(scores, pa.int64())], names=["q", "id", "score"])

    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    return _shards(index).mapInArrow(run, schema)


def oracle_sql(k: int = 10) -> str:
    words = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{TERM}')"
    return f"""
    WITH w AS (SELECT doc_id, unnest({words}) AS term FROM documents),
    p AS (SELECT doc_id, term, count(*) AS tf FROM w GROUP BY ALL),
    s AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM p GROUP BY ALL),
    c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS total FROM s),
    v AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, c GROUP BY ALL),
    q AS (SELECT DISTINCT item_id, unnest({words}) AS term FROM benchmark),
    r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // total))))::BIGINT AS score
          FROM q JOIN p USING (term) JOIN v USING (term) JOIN s USING (doc_id), c GROUP BY ALL HAVING score > 0)
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score FROM r
    QUALIFY rank <= {k}"""
