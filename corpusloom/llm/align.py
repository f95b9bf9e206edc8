"""Alignment of two tokenizers over a corpus, by a dictionary of groups.

A text is encoded twice: by a byte-level BPE (A, with a space put in front) and by a sentencepiece model
(B, which puts one there itself). Where tokens of both end at the same byte, both sequences are cut; what lies
between two cuts is a group, written ``a1,a2|b1``. All A-B pairs of a group are linked, and a pair's count is the
number of documents that hold it linked.

Groups repeat, so they are interned: the corpus is read in blocks of documents, each with its distinct groups
and, for every document, which of them it holds how often. Over all blocks a group's documents are
summed; its links are expanded once. A pair is counted from the groups that hold it, multiplied by
their documents, less what was counted twice where a document holds it in several groups (each block reports
that). The counts go back to a group once, and by the group's key to the blocks, which add up their documents.
Rows of (document, group) are never shuffled.

Cuts within a text: a space behind a character that is no white space starts a new pre-token of A and a
new piece of B, as none of B's pieces has a space behind another character (checked). So both
encode the segments between such places for themselves, and a bounded cache holds the segments.

Defined results: a text that is null or empty, or that either tokenizer does not give back byte by byte,
has no tokens: zeros and an empty digest. Repeated rows and rows with one id are documents of their own. A group
is bounded by its text; its links are made as rows, not held. An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corpusloom.llm.bpe import byte_characters
from corpusloom.llm.shared import drop, written

#: A block ends with the document that reaches one of these: documents, (document, group) entries.
BLOCK_DOCS, BLOCK_ENTRIES = 4096, 1 << 18
#: Segments, and characters in them, that a worker remembers.
CACHE, CACHE_CHARS = 1 << 18, 1 << 24
#: Distinct groups that a worker remembers, at least; beyond it they go with the end of a block.
GROUPS = 1 << 20
_RESULT = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def segments(text: str) -> list[str]:
    """`` text`` cut before every space that follows a character other than white space."""
    if re.search(r"\s ", text) or text[0] == " ":
        return re.split(r"(?<=\S)(?= )", " " + text)
    return [" " + w for w in text.split(" ")] if text[-1] != " " else re.split(r"(?<=\S)(?= )", " " + text)


class _Column:
    """A numpy array that grows at its end."""

    def __init__(self):
        self.data, self.size = np.zeros(1 << 12, np.int64), 0

    def extend(self, values) -> None:
        size = self.size + len(values)
        if size > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(size, np.int64)])
        self.data[self.size : size] = values
        self.size = size


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The places starts[k], starts[k] + 1, .. (counts[k] of them), one run after the other."""
    total = int(counts.sum())
    return np.repeat(starts - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(total) if total else np.zeros(0, np.int64)


class Pair:
    """Both tokenizers of one worker, with the segments and groups that they have met.

    A is run from its own vocabulary by rank, which gives the ids that its merges give, several times as fast.
    """

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tiktoken

        with open(a_path, encoding="utf-8") as f:
            model = json.load(f)
        octet = {c: b for b, c in enumerate(byte_characters())}
        self.a_bytes = {i: bytes(map(octet.__getitem__, p)) for p, i in model["model"]["vocab"].items() if all(c in octet for c in p)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks={p: i for i, p in self.a_bytes.items()}, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any(re.search("[^▁]▁", p) for p in pieces) or len(pieces) >= 1 << 15 or max(self.a_bytes) >= (1 << 16) - 1:
            raise ValueError("a piece with a space behind another character, or more ids than a key holds")
        self.a_len = np.array([len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], np.int64)
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)
        self.forget_segments()
        self.forget_groups()

    def forget_segments(self) -> None:
        self.segment: dict[str, int] = {}
        self.chars, self.line = 0, []
        #: By segment: tokens of A and B, groups, links, whether a tokenizer changes it, where its groups start in ``flat``.
        self.n_a, self.n_b, self.n_groups, self.n_links, self.bad, self.first, self.flat = (_Column() for _ in range(7))

    def forget_groups(self) -> None:
        self.group: dict[int, int] = {}
        self.large: dict[bytes, int] = {}
        self.names: list[str] = []
        #: By group: where its distinct pairs start in ``pairs`` (as a << 15 | b), and how many they are.
        self.at, self.count, self.pairs = (_Column() for _ in range(3))
        self.forget_segments()

    def learn(self, texts: list[list[str]]) -> None:
        """Encode the segments that are new: those that may stand together as one text, the others one by one."""
        new = list(set(chain.from_iterable(texts)).difference(self.segment))
        together = [s for s in new if not s[-1].isspace() and "▁" not in s]
        if together:
            line = "".join(together)
            a, b = np.array(self.a.encode_ordinary(line), np.int64), np.array(self.b.encode(line[1:]), np.int64)
            if self._joined(a, b, line.encode()):
                self._add(together, a, b)
            else:
                for s in together:
                    self._alone(s)
        for s in set(new).difference(together) if len(together) < len(new) else ():
            self._alone(s)

    def _joined(self, a: np.ndarray, b: np.ndarray, data: bytes) -> bool:
        return b"".join(map(self.a_bytes.__getitem__, a.tolist())) == data and b"".join(map(self.b_bytes.__getitem__, b.tolist())) == data

    def _alone(self, s: str) -> None:
        a = np.array(self.a.encode_ordinary(s), np.int64)
        b = np.array(self.b.encode(s[1:]) if s != " " else [self.b.piece_to_id("▁")], np.int64)  # the model sees no empty text
        if self._joined(a, b, s.encode()):
            self._add([s], a, b)
        else:
            self.segment[s] = len(self.line)
            self.line.append("")
            for column, value in ((self.n_a, 0), (self.n_b, 0), (self.n_groups, 0), (self.n_links, 0), (self.bad, 1), (self.first, self.flat.size)):
                column.extend([value])

    def _add(self, new: list[str], a: np.ndarray, b: np.ndarray) -> None:
        a_ends, b_ends = np.cumsum(self.a_len[a]), np.cumsum(self.b_len[b])
        common = np.intersect1d(a_ends, b_ends, assume_unique=True)
        a_cut, b_cut = (np.concatenate([[0], np.searchsorted(e, common, "right")]) for e in (a_ends, b_ends))
        groups = self._intern(a, b, a_cut, b_cut)
        ends = np.concatenate([[0], np.searchsorted(common, np.cumsum([len(s.encode()) for s in new]), "right")])  # groups up to each segment's end
        links = np.concatenate([[0], np.cumsum(np.diff(a_cut) * np.diff(b_cut))])
        names = list(map(self.names.__getitem__, groups.tolist()))
        for s, lo, hi in zip(new, ends[:-1].tolist(), ends[1:].tolist()):
            self.segment[s] = len(self.line)
            self.line.append(";".join(names[lo:hi]))
        self.chars += sum(map(len, new))
        self.first.extend(ends[:-1] + self.flat.size)
        self.flat.extend(groups)
        self.bad.extend(np.zeros(len(new), np.int64))
        for column, total in ((self.n_a, a_cut), (self.n_b, b_cut), (self.n_groups, np.arange(len(common) + 1)), (self.n_links, links)):
            column.extend(np.diff(total[ends]))

    def _intern(self, a: np.ndarray, b: np.ndarray, a_cut: np.ndarray, b_cut: np.ndarray) -> np.ndarray:
        """The number of each group. A group of up to two ids on either side is its own key of 62 bits; a larger one is looked up by its ids."""
        na, nb = np.diff(a_cut), np.diff(b_cut)
        up = lambda x: np.concatenate([x + 1, [0]])
        a1, b1 = up(a), up(b)
        key = a1[a_cut[:-1]] | np.where(na > 1, a1[np.minimum(a_cut[:-1] + 1, len(a))], 0) << 16 | b1[b_cut[:-1]] << 32 | np.where(nb > 1, b1[np.minimum(b_cut[:-1] + 1, len(b))], 0) << 47
        for k in np.flatnonzero((na > 2) | (nb > 2)).tolist():
            ids = a[a_cut[k] : a_cut[k + 1]].tobytes() + b"|" * 8 + b[b_cut[k] : b_cut[k + 1]].tobytes()
            key[k] = -1 - self.large.setdefault(ids, len(self.large))
        found, where, back = np.unique(key, return_index=True, return_inverse=True)
        number = np.zeros(len(found), np.int64)
        for i, (value, k) in enumerate(zip(found.tolist(), where.tolist())):
            g = self.group.get(value)
            if g is None:
                g = self.group[value] = len(self.names)
                left, right = a[a_cut[k] : a_cut[k + 1]], b[b_cut[k] : b_cut[k + 1]]
                self.names.append(f"{','.join(map(str, left.tolist()))}|{','.join(map(str, right.tolist()))}")
                pairs = ((np.unique(left) << 15)[:, None] | np.unique(right)).ravel()
                self.at.extend([self.pairs.size])
                self.count.extend([len(pairs)])
                self.pairs.extend(pairs)
            number[i] = g
        return number[back]


class _Block:
    """Documents with the groups they hold, numbered as the pair's tables number them."""

    def __init__(self):
        self.ids, self.digest = [], []
        self.sizes, self.held, self.groups, self.times, self.twice, self.extra = ([] for _ in range(6))
        self.entries = 0

    def add(self, keys: list, pair: Pair, texts: list[list[str]]) -> None:
        at = [list(map(pair.segment.__getitem__, t)) for t in texts]
        flat, ends = np.fromiter(chain.from_iterable(at), np.int64), np.cumsum([0, *map(len, at)])
        per_doc = lambda column: np.diff(np.concatenate([[0], np.cumsum(column.data[flat])])[ends])
        good = (per_doc(pair.bad) == 0) & (np.diff(ends) > 0)
        flat = flat[np.repeat(good, np.diff(ends))]
        ends = np.cumsum([0, *np.where(good, np.diff(ends), 0)])
        owner = np.repeat(np.arange(len(keys)), np.diff(ends))
        counts = pair.n_groups.data[flat]
        groups = pair.flat.data[_ragged(pair.first.data[flat], counts)]
        held, times = np.unique(np.repeat(owner, counts) << 40 | groups, return_counts=True)
        doc, group = held >> 40, held & ((1 << 40) - 1)
        pairs = pair.pairs.data[_ragged(pair.at.data[group], pair.count.data[group])]
        if len(pairs):
            # pairs of one document that several of its groups hold
            seen = np.sort(np.repeat(doc, pair.count.data[group]) << 32 | pairs)
            self.twice.append(seen[1:][seen[1:] == seen[:-1]] & 0xFFFFFFFF)
        self.ids += keys
        self.sizes.append(np.stack([per_doc(c) for c in (pair.n_a, pair.n_b, pair.n_groups, pair.n_links)]))
        self.digest += [hashlib.sha256(";".join(map(pair.line.__getitem__, t)).encode()).hexdigest() if ok else "" for t, ok in zip(at, good.tolist())]
        self.held.append(np.bincount(doc, minlength=len(keys)))
        self.groups.append(group)
        self.times.append(times)
        self.entries += len(group)

    def full(self) -> bool:
        return len(self.ids) >= BLOCK_DOCS or self.entries >= BLOCK_ENTRIES

    def batch(self, number: int, pair: Pair, kind: pa.DataType) -> pa.RecordBatch:
        held, place, docs = np.unique(np.concatenate(self.groups), return_inverse=True, return_counts=True)
        sizes, starts = np.concatenate(self.sizes, axis=1), np.cumsum([0, *np.concatenate(self.held)])
        links, often = np.unique(np.concatenate([np.zeros(0, np.int64), *self.twice]), return_counts=True)
        twice = pa.StructArray.from_arrays([pa.array((links >> 15).astype(np.int32)), pa.array((links & 0x7FFF).astype(np.int32)), pa.array(often)], names=["a", "b", "n"])
        names = pa.array([pair.names[g] for g in held.tolist()], pa.string())
        columns = [pa.array(self.ids, kind), *map(pa.array, sizes), pa.array(self.digest, pa.string()), pa.array(starts.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(np.concatenate(self.times).astype(np.int32)), names, pa.array(docs), twice]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *lists], names=["block", "ids", "n_a", "n_b", "n_groups", "n_links", "digest", "starts", "place", "times", "groups", "docs", "twice"])


def blocks(docs: DataFrame, *, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for every block: its documents (ids, sizes, digests), which of its distinct ``groups`` each holds how often, a group's ``docs`` in the block, and the pairs counted ``twice``."""
    kind = docs.schema[id_col].dataType
    longs, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    strings = T.ArrayType(T.StringType())
    twice = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([T.StructField(n, t) for n, t in [("block", T.LongType()), ("ids", T.ArrayType(kind)), *((n, longs) for n in ("n_a", "n_b", "n_groups", "n_links")), ("digest", strings), ("starts", ints), ("place", ints), ("times", ints), ("groups", strings), ("docs", longs), ("twice", twice)]])

    docs_kind = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, number = Pair(a_path, b_path), _Block(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                cut = [segments(t) if t else [] for t in part.column(1).to_pylist()]
                if len(pair.segment) > CACHE or pair.chars > CACHE_CHARS:
                    pair.forget_segments()
                pair.learn(cut)
                block.add(part.column(0).to_pylist(), pair, cut)
                if block.full():
                    yield block.batch(number, pair, docs_kind)
                    block, number = _Block(), number + 1
                    if len(pair.names) > GROUPS:
                        pair.forget_groups()
        if block.ids:
            yield block.batch(number, pair, docs_kind)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def group_table(table: DataFrame) -> DataFrame:
    """(g, docs): the distinct groups of all blocks and the documents that hold each."""
    return table.select(F.explode(F.arrays_zip("groups", "docs")).alias("x")).groupBy(F.col("x.groups").alias("g")).agg(F.sum("x.docs").alias("docs"))


def link_table(groups: DataFrame) -> DataFrame:
    """(g, a, b, times, docs): the links of a distinct group, expanded once, by its ids and how often they meet in it."""
    ids = lambda k: F.explode(F.split(F.element_at(F.split("g", r"\|"), k), ",").cast("array<int>"))
    return groups.withColumn("a", ids(1)).withColumn("b", ids(2)).groupBy("g", "a", "b").agg(F.count("*").alias("times"), F.first("docs").alias("docs"))


def pair_counts(links: DataFrame, table: DataFrame) -> DataFrame:
    """(a, b, n, best): in how many documents a pair is linked, and whether that is the most for its A id."""
    twice = table.select(F.explode("twice").alias("x")).select("x.a", "x.b", (-F.col("x.n")).alias("n"))
    counts = links.select("a", "b", F.col("docs").alias("n")).unionAll(twice).groupBy("a", "b").agg(F.sum("n").alias("n"))
    most = counts.groupBy(F.col("a").alias("of")).agg(F.max("n").alias("most"))
    return counts.join(most, F.col("a") == F.col("of")).select("a", "b", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, *, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For every document: n_a, n_b (tokens), n_groups, n_links, n_best (links whose count is the most of their A id), count_sum (over links) and groups_sha256."""
    spark, kind = docs.sparkSession, docs.schema[id_col].dataType
    table, _ = written(blocks(docs, a_path=a_path, b_path=b_path, id_col=id_col, text_col=text_col), "blocks")
    links, _ = written(link_table(group_table(table)), "links")
    counts, counts_path = written(pair_counts(links, table), "pairs")
    values = links.join(counts, ["a", "b"]).groupBy("g").agg(F.sum(F.col("times") * F.col("n")).alias("sum"), F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("best"))
    places = table.select("block", F.posexplode("groups").alias("at", "g"))
    back, _ = written(places.join(values, "g").groupBy("block").agg(F.collect_list(F.struct("at", "sum", "best")).alias("back")), "back")
    drop(spark, counts_path)
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(n, T.LongType()) for n in _RESULT), T.StructField("groups_sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1) for b in batches for k in range(b.num_rows)):
            of = {n: batch.column(n)[0].values for n in batch.schema.names if batch.column(n)[0].is_valid}
            starts, place, times = (of[n].to_numpy() for n in ("starts", "place", "times"))
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            totals = []
            for n in ("best", "sum"):
                value = np.zeros(len(of["groups"]), np.int64)
                if "back" in of:
                    value[of["back"].field("at").to_numpy()] = of["back"].field(n).to_numpy()
                total = np.zeros(len(starts) - 1, np.int64)
                np.add.at(total, owner, value[place] * times)
                totals.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([of["ids"], *(of[n] for n in _RESULT[:4]), *totals, of["digest"]], names=schema.names)

    return table.drop("docs", "twice").join(back, "block", "left").drop("block").mapInArrow(run, schema)

