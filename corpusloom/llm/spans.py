"""Substring dedup by sliding sentence spans.

A text is cut into sentences behind a word that ends in ``. ! ? ; :`` and at line ends, and further so
that of any ``WINDOW`` words one ends a sentence: the last that has the least rank, where ends of
sentences and lines rank below all hashes. A cut depends on the words of the windows around it alone, so a
passage is cut alike wherever it stands, but for its ends. A span is the shortest run of at least
``min_sentences`` consecutive sentences with at least ``min_words`` words. Within a passage of L words the
first whole window ends a sentence at word W or before, the last one at word L - W + 1 or behind; the L - 2W + 1
words between hold over 2 sentences of W words, so a whole span, if L >= 4W: with W = 12 any 50 whole words do.

All spans of the corpus are hashed (96 bits of the words joined by one space) and joined globally; of
every span that occurs again, the first occurrence (by doc_id, then place) stays and the sentences of all
others are removed.

Repeats inside a text are found in the text. Across texts two shuffles of rows of three longs do it: a
partial aggregate finds the hashes of several documents and the first of these, an equi-join carries
it back, where adaptive execution splits hot passages. Texts are shuffled once, by doc_id, to be cut. A
document's spans are gathered by its own id only, so a group is bounded by one text.

Defined results: null and empty texts come back as they are; rows with one doc_id count as one
document (they are not compared with each other, and lose the sentences of either); rows without a
doc_id only lose what repeats inside them, taken together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.shared import clear_of, materialise

MIN_SENTENCES, MIN_WORDS, WINDOW = 3, 20, 12
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?;:")] = True


def cut(data: bytes) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of a text in UTF-8: its words, where each starts and ends, and how many words stand up to each end of a sentence."""
    words = data.split()  # at \x20 and \x09 to \x0D
    if not words:
        none = np.zeros(0, np.int64)
        return words, none, none, none
    octets = np.frombuffer(data, np.uint8)
    inside = ~_SPACE[octets]
    edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    starts, ends = edges[0::2], edges[1::2]
    over = _STOP[octets[ends - 1]]
    lines = np.flatnonzero(octets == 10)
    if len(lines):
        over[:-1] |= np.searchsorted(lines, starts[1:]) > np.searchsorted(lines, ends[:-1])
    over[-1] = True
    return words, starts, ends, np.flatnonzero(over | _least(words, over)) + 1


def _least(words: list[bytes], over: np.ndarray) -> np.ndarray:
    """Whether a word is the last of least rank in one of the windows that hold it."""
    n, chosen = len(words), np.zeros(len(words), bool)
    if n >= WINDOW:
        rank = np.fromiter(map(_ranks.__getitem__, words), np.int64, n)
        rank[over] = 0
        least, width = (rank << 32) | (0xFFFFFFFF - np.arange(n)), 1
        while 2 * width <= WINDOW:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if rest := WINDOW - width:
            least = np.minimum(least[:-rest], least[rest:])
        chosen[0xFFFFFFFF - (least & 0xFFFFFFFF)] = True
    return chosen


class _Ranks(dict):
    """30 bits of a word's hash, above 0, the same on every machine; holds a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        value = self[word] = (xxhash.xxh64_intdigest(word) & 0x3FFFFFFF) + 1
        return value


_ranks = _Ranks()


def runs(stops: np.ndarray, min_sentences: int, min_words: int) -> tuple[np.ndarray, np.ndarray]:
    """First and past the last word of the shortest long-enough run from each sentence on that has one; ``stops``: words up to each end."""
    firsts = np.concatenate([[0], stops[:-1]]) if len(stops) else stops
    past = np.maximum(np.searchsorted(stops, firsts + min_words), np.arange(len(stops)) + min_sentences - 1)
    good = past < len(stops)
    return firsts[good], stops[past[good]]


def span_table(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """One row a span: id, h1 (64 bits of its hash), h2 (32 more bits above the number of its first sentence), again (it stood in the text before)."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, h1 long, h2 long, again boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_digest
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                sizes, places, hashes, again = [], [], [], []
                for text in part.column(1).to_pylist():
                    words, _, _, stops = cut(text.encode() if text else b"")
                    first, past = runs(stops, min_sentences, min_words)
                    line = b" ".join(words)
                    at = np.concatenate([[0], np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)])
                    found = [digest(line[a:b])[:12] for a, b in zip(at[first].tolist(), (at[past] - 1).tolist())]
                    sizes.append(len(found))
                    places.append(np.arange(len(found)))
                    hashes += found
                    seen = set(found)
                    if len(seen) == len(found):
                        again.append(np.zeros(len(found), bool))
                    else:
                        again.append(np.array([h not in seen or seen.discard(h) is not None for h in found]))
                raw = np.frombuffer(b"".join(hashes), "<i4").astype(np.int64).reshape(-1, 3)
                h1 = (raw[:, 0] & 0xFFFFFFFF) | (raw[:, 1] << 32)
                h2 = (raw[:, 2] << 32) | np.concatenate([np.zeros(0, np.int64), *places])
                ids = part.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int32()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(h1), pa.array(h2), pa.array(np.concatenate([np.zeros(0, bool), *again]))], names=[id_col, "h1", "h2", "again"])

    return docs.select(id_col, F.col(text_col).alias("text__")).mapInArrow(run, schema)


def repeated_spans(spans: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """(id, place) of the occurrences that are not the first of their hash."""
    place, upper = F.col("h2").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("place"), F.shiftright("h2", 32)
    ids = spans.where(F.col(id_col).isNotNull() & ~F.col("again")).drop("again")
    seen = ids.groupBy(F.col("h1").alias("k1"), upper.alias("k2")).agg(F.min(id_col).alias("lo"), F.max(id_col).alias("hi")).where("lo <> hi").drop("hi")
    across = ids.join(seen, (F.col("h1") == F.col("k1")) & (upper == F.col("k2"))).where(F.col(id_col) != F.col("lo")).select(id_col, place)
    return across.unionAll(spans.where("again").select(id_col, place))


def remove_repeated(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_sentences: int = MIN_SENTENCES, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs``, the text without repeated sentences, and ``removed``: what was cut, as (start, end) in code points (null: nothing)."""
    clear_of(docs.columns, "removed", "places__", "lost__")
    spans = materialise(span_table(docs, id_col=id_col, text_col=text_col, min_sentences=min_sentences, min_words=min_words), "spans")
    lost = materialise(repeated_spans(spans, id_col=id_col).groupBy(F.col(id_col).alias("lost__")).agg(F.collect_set("place").alias("places__")), "removals")
    joined = docs.join(lost, F.col(id_col).eqNullSafe(F.col("lost__")), "left").drop("lost__")
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts, cuts = part.column(at).to_pylist(), []
                for k, places in enumerate(part.column(len(names)).to_pylist()):
                    cuts.append(None)
                    if places and texts[k]:
                        texts[k], gone = without(texts[k], set(places), min_sentences, min_words)
                        cuts[k] = [{"start": a, "end": b} for a, b in gone] or None
                columns = [part.column(k) for k in range(len(names))]
                columns[at] = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([*columns, pa.array(cuts, kind)], names=[*names, "removed"])

    return joined.mapInArrow(run, schema)


def without(text: str, places: set[int], min_sentences: int, min_words: int) -> tuple[str, list[tuple[int, int]]]:
    """The text without the runs whose numbers are ``places``, and the merged pieces that went, in code points."""
    data = text.encode()
    _, starts, ends, stops = cut(data)
    first, past = runs(stops, min_sentences, min_words)
    merged: list[list[int]] = []
    for k in sorted(p for p in places if p < len(first)):  # rows that share an id lose the places of either
        if merged and first[k] <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], int(past[k]))
        else:
            merged.append([int(first[k]), int(past[k])])
    points = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)  # code points up to and with each byte
    kept, gone, last = [], [], 0
    for a, b in merged:
        start, end = int(starts[a]), int(ends[b - 1])
        kept.append(data[last:start])
        gone.append((int(points[start]) - 1, int(points[end - 1])))
        last = end
    return b"".join([*kept, data[last:]]).decode(), gone


def document_spans(docs: DataFrame) -> DataFrame:
    """doc_id, the text that stays, removed spans as start:end, their number and code points, for every document."""
    out = remove_repeated(docs.select("doc_id", "text"))
    return out.select(
        "doc_id", "text", F.coalesce(F.array_join(F.expr("transform(removed, r -> concat(r.start, ':', r.end))"), ","), F.lit("")).alias("removed"),
        F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"), F.coalesce(F.expr("aggregate(removed, 0, (a, r) -> a + r.end - r.start)"), F.lit(0)).cast("long").alias("chars_removed"),
    )
