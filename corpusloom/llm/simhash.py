"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint has 64 bits. Two within ``DISTANCE`` = 3 bits are cut into 2 segments of 32, one of
which differs in at most one bit. So an index entry is a segment with one bit as wildcard (32 a
segment), and a pair meets where the entry of the one that has the bit clear equals the entry of
the one that has it set; segments that do not differ meet in the segment itself and, as the other
then holds all 3 differing bits, in one of its 4 bytes as well. Equality joins, then a popcount
verifies. Every pair is met once in either segment, none within the distance is lost.

Only distinct fingerprints are indexed: copies cost one row each and are never paired.

Defined results: a null, empty or blank text has fingerprint 0 and is linked like any other; fewer
words than a shingle make one shingle; a null doc_id gets its class but never names one; repeated
rows come back repeated.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.components import connected_components
from corpusloom.llm.shared import clear_of, drop, made, materialise, written
from corpusloom.llm.text import sized

DISTANCE = 3
_BLOCK = 1 << 15


def shingle_hashes(text: str | None, shingle: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``shingle`` words (A-Z lower-cased, joined by a space), repeats included; fewer words make one run.

    Of a long text no more than a block of runs is held as Python objects.
    """
    line = b" ".join((text or "").encode().lower().split())  # splits at \x20 and \x09 to \x0D
    if not line:
        return np.zeros(0, np.uint64)
    gaps, digest = np.flatnonzero(np.frombuffer(line, np.uint8) == 32), xxhash.xxh64_intdigest
    starts, ends = np.append(0, gaps + 1), np.append(gaps, len(line))
    ends = ends[min(shingle, len(ends)) - 1 :]
    out = np.empty(len(ends), np.uint64)
    for lo in range(0, len(ends), _BLOCK):
        out[lo : lo + _BLOCK] = [digest(line[a:b], seed) for a, b in zip(starts[lo : lo + _BLOCK].tolist(), ends[lo : lo + _BLOCK].tolist())]
    return out


def majority(hashes: np.ndarray) -> int:
    """The fingerprint: a bit is 1 if it is set in over half of the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), _BLOCK):
        counts += np.unpackbits(hashes[lo : lo + _BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little") if len(hashes) else 0


def fingerprint(text: str | None, *, shingle: int = 3, seed: int = 42) -> int:
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, keep: list[str], *, text_col: str = "text", shingle: int = 3) -> DataFrame:
    """The columns ``keep`` with ``fp`` (the fingerprint as a signed long)."""
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), "fp long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                fps = np.array([fingerprint(t, shingle=shingle) for t in part.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [pa.array(fps, pa.int64())], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text_col).alias("text__")).mapInArrow(run, schema)


def _half(segment: int) -> Column:
    return F.shiftrightunsigned("fp", 32) if segment else F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))


_NEAR = f"bit_count(a ^ b) <= {DISTANCE}"


def _one_off(distinct: DataFrame, segment: int) -> DataFrame:
    """Pairs whose segment differs in exactly one bit: they meet where that bit is the wildcard."""
    wild = distinct.select("fp", _half(segment).alias("half"), F.explode(F.sequence(F.lit(0), F.lit(31))).alias("w"))
    wild = wild.select("fp", (F.expr("shiftleft(cast(w as bigint), 32)") + F.expr("half & ~shiftleft(1L, w)")).alias("key"), F.expr("(shiftrightunsigned(half, w) & 1) = 1").alias("set"))
    clear, marked = (wild.where(c).select("key", F.col("fp").alias(n)) for c, n in (("not set", "a"), ("set", "b")))
    return clear.join(marked, "key").where(_NEAR).select("a", "b")


def _equal(distinct: DataFrame, segment: int) -> DataFrame:
    """Pairs whose segment is equal: the other holds all differing bits, so one of its 4 bytes is equal too; the first such byte counts."""
    same = distinct.select("fp", _half(segment).alias("half"), _half(1 - segment).alias("other"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    same = same.select("fp", "k", "half", F.expr("shiftrightunsigned(other, 8 * k) & 255").alias("byte"))
    left, right = (same.select("k", "half", "byte", F.col("fp").alias(n)) for n in ("a", "b"))
    differs = lambda i: f"(shiftrightunsigned(a ^ b, {8 * i + 32 * (1 - segment)}) & 255) <> 0"
    first = " and ".join(f"(k <= {i} or {differs(i)})" for i in range(3))
    return left.join(right, ["k", "half", "byte"]).where(f"a < b and {_NEAR} and {first}").select("a", "b")


def links(distinct: DataFrame) -> DataFrame:
    """``distinct`` (fp: long, each once) -> (a, b): every pair of fingerprints that differ in 1 to 3 bits, once or twice.

    One segment is indexed at a time and its links are written, so that only one index is shuffled at once.
    """
    found = [materialise(_one_off(distinct, s).unionAll(_equal(distinct, s)), f"links-{s}") for s in (0, 1)]
    return found[0].unionAll(found[1])


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row a document: the id, ``fp``, ``root`` (a fingerprint naming the class) and ``component_id`` (the class's smallest id).

    The fingerprints are computed once and written; the class of a fingerprint is found on distinct
    fingerprints; one equi-join carries it back, whose hot fingerprints adaptive execution splits.
    """
    fps = materialise(fingerprints(docs, [id_col], text_col=text_col, shingle=shingle), "fingerprints")
    distinct = materialise(fps.groupBy("fp").agg(F.min(id_col).alias("first_id")), "distinct")
    classes = connected_components(links(distinct.select("fp")))
    rooted = distinct.join(classes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("fp", "root", "component_id")
    return fps.join(named, "fp").select(id_col, "fp", "root", "component_id")


def document_classes(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id of every document."""
    return near_duplicate_classes(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


SIMILARITY = 0.8
#: Shingles found in COMMON_LEAST texts of one sixteenth of the corpus, the COMMON_MOST most frequent at most, come last in the order of shingles.
COMMON_LEAST, COMMON_MOST = 8, 100_000
#: Texts of a shingle from which on they first meet hubs, and the rounds of that.
CROWD, HUB_ROUNDS = 16, 1
#: The shingles are brought together in this many slices, so that no more than one of them is shuffled at once.
SLICES = 2
#: Sizes are binned by this ratio, so that a long prefix meets only the sizes its place allows.
_BIN = math.log(1.03)


def _columns(docs: DataFrame, keep: list[str]) -> str:
    return ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)


def common_shingles(docs: DataFrame, *, text_col: str = "text", shingle: int = 5) -> np.ndarray:
    """Frequent shingle hashes, the most frequent last. They only order the shingles: any order loses no pair, this one meets fewer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(text, shingle)).view(np.int64))], names=["e"])

    part = docs.where(F.pmod(F.xxhash64(text_col), F.lit(16)) == 0).select(text_col).mapInArrow(run, "e long")
    found = part.groupBy("e").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON_LEAST).orderBy(F.desc("n"), "e").limit(COMMON_MOST).collect()
    return np.array([r["e"] for r in reversed(found)], np.int64).view(np.uint64)


def prefix(hashes: np.ndarray, similarity: float, common: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first shingles of a set (sorted hashes) in the common order, so many that two sets of at least ``similarity`` share one of them.

    ``common`` is sorted, ``at`` has its places in the order, behind all other hashes.
    """
    size = len(hashes)
    if not size:
        return hashes
    if len(common):
        k = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
        late = common[k] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late][np.argsort(at[k[late]])]])
    return hashes[: size - math.ceil(similarity * size - 1e-9) + 1]


def prefixes(docs: DataFrame, keep: list[str], *, text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY, common: np.ndarray | None = None) -> DataFrame:
    """The columns ``keep`` with ``node`` (a hash of the set of shingles), ``fp`` (the text's fingerprint), ``size`` (of that set) and ``prefix``, whose hashes are empty without ``common``."""
    at = np.argsort(common) if common is not None else np.zeros(0, np.int64)
    ranked = common[at] if common is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                node, fp, size, first = [], [], [], []
                for text in part.column(len(keep)).to_pylist():
                    runs = shingle_hashes(text, shingle)
                    h = np.unique(runs)
                    fp.append(majority(runs))
                    node.append(xxhash.xxh64_intdigest(h.tobytes(), 7))
                    size.append(len(h))
                    first.append((h[:0] if ranked is None else prefix(h, similarity, ranked, at)).view(np.int64))
                nodes, fps = (pa.array(np.array(x, np.uint64).view(np.int64), pa.int64()) for x in (node, fp))
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [nodes, fps, pa.array(size, pa.int32()), pa.array(first, pa.list_(pa.int64()))], names=[*keep, "node", "fp", "size", "prefix"])

    return docs.select(*keep, F.col(text_col).alias("text__")).mapInArrow(run, f"{_columns(docs, keep)}, node long, fp long, size int, prefix array<long>")


def shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, text__) -> node and ``set``, its distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                sets = [np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "set"])

    return texts.select("node", "text__").mapInArrow(run, "node long, set array<long>")


def shared_part(a: str | None, b: str | None, shingle: int) -> float:
    """Jaccard similarity of the shingle sets of two texts; 1 if neither has a word."""
    x, y = (np.unique(shingle_hashes(t, shingle)) for t in (a, b))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) or len(y) else 1.0


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets have the similarity."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("set").alias(f"s{c}"))
    both = F.size(F.array_intersect("sa", "sb"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("n"), both.alias("both"))
    return met.where(F.col("both") / (F.col("n") - F.col("both")) >= similarity).select("a", "b")


def _reaches(similarity: float) -> Column:
    """Whether texts of na and nb shingles, n of them in both prefixes, can have the similarity: at most what lies behind either prefix is shared as well."""
    behind = F.ceil(similarity * F.greatest("na", "nb") - 1e-9) - 1
    return (F.col("n") + behind >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-6) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-6)


def _rooted(held: DataFrame, classes: DataFrame | None) -> DataFrame:
    """``held`` with ``root``, without the shingles whose texts are all of one class already."""
    if classes is None:
        return held.withColumn("root", F.col("node"))
    rows = held.join(classes, "node", "left").withColumn("root", F.coalesce("component", "node")).drop("component")
    open_ones = materialise(rows.groupBy("e").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("e"), "open")
    return rows.join(sized(open_ones), "e", "left_semi")  # measured: where it is small, no crowd is shuffled into one task


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``nodes`` (node, fp) -> the pairs (a, b) whose fingerprints differ in 1 to 3 bits, one text standing for a fingerprint; texts of one fingerprint meet that one.

    The deletion-variant signatures of ``links`` find them on distinct fingerprints.
    """
    first = materialise(nodes.groupBy("fp").agg(F.min("node").alias("one")), "first")
    same = nodes.join(first, "fp").where("node <> one").select(F.col("node").alias("a"), F.col("one").alias("b"))
    side = lambda c: first.select(F.col("fp").alias(c), F.col("one").alias(f"n{c}"))
    met = links(first.select("fp")).join(side("a"), "a").join(side("b"), "b").select(F.col("na").alias("a"), F.col("nb").alias("b"))
    return _ordered(same.unionAll(met))


def _hubs(held: DataFrame, similarity: float, turn: int) -> DataFrame:
    """Pairs (a, b) that likely join large groups. ``held``: e, node, size, texts (that hold e), root.

    The hubs of a shingle are one text by the turn's hash and the one with the largest part of widespread
    shingles, as an original has among its variants; a text meets the two hubs it shares most with. The count
    of shared shingles is a lower one here: what the bound drops, the candidates bring back.
    """
    scored = held.join(held.groupBy("node").agg((F.sum("texts") / F.first("size")).alias("score")), "node")
    one = F.struct("node", "size", "root")
    ends = scored.groupBy("e").agg(F.min_by(one, F.struct(F.xxhash64("node", F.lit(turn)), "node")).alias("lo"), F.max_by(one, F.struct("score", "node")).alias("hi"))
    ends = sized(materialise(ends.select("e", *[F.col(f"{x}.{c}").alias(f"{x}_{c}") for x in ("lo", "hi") for c in ("node", "size", "root")]), "ends"))
    hub = lambda x: F.struct(*[F.col(f"{x}_{c}").alias(c) for c in ("node", "size", "root")])
    met = held.join(ends, "e").select(F.col("node").alias("a"), F.col("size").alias("na"), "root", F.explode(F.array(hub("lo"), hub("hi"))).alias("h")).where("root <> h.root")
    counted = met.select("a", "na", F.col("h.node").alias("b"), F.col("h.size").alias("nb")).groupBy("a", "b").agg(F.count("*").alias("n"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    most = counted.where(_reaches(similarity)).groupBy("a").agg(F.max(F.struct("n", "b")).alias("x"), F.max(F.struct("n", F.bitwise_not("b").alias("c"))).alias("y"))
    return _ordered(most.select("a", F.explode(F.array(F.col("x.b"), F.bitwise_not(F.col("y.c")))).alias("b")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _candidates(held: DataFrame, similarity: float) -> DataFrame:
    """Every pair (a, b) of nodes in different classes that may have the similarity. ``held``: e, node, size, pos (of e in the prefix), root.

    Of a pair, a is the smaller; e stands for the first shingle both share, so at most what follows it is
    shared too. That bounds the place of e in a, and by its place in b the sizes of a that b can still match:
    of a crowded shingle b meets those sizes only (binned), so dissimilar texts of a crowd do not even meet.
    """
    share = similarity / (1 + similarity)
    bin_of = lambda c: F.when(F.col("texts") >= CROWD, F.floor(F.log(c) / _BIN)).otherwise(-1)
    index = held.where(F.col("size") - F.col("pos") >= 2 * share * F.col("size") - 1e-6)
    index = index.select("e", bin_of(F.col("size")).alias("bin"), F.col("node").alias("a"), F.col("size").alias("na"), F.col("pos").alias("pa"), F.col("root").alias("ra"))
    most = F.least(F.col("size").cast("double"), (F.col("size") - F.col("pos")) / share - F.col("size") + 1e-6)
    probe = held.withColumn("least", F.ceil(similarity * F.col("size") - 1e-6)).withColumn("most", most).where("most >= least")
    probe = probe.select("e", F.explode(F.sequence(bin_of(F.col("least")), bin_of(F.col("most")))).alias("bin"), F.col("node").alias("b"), F.col("size").alias("nb"), F.col("pos").alias("pb"), F.col("root").alias("rb"))
    room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) >= share * (F.col("na") + F.col("nb")) - 1e-6
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    met = index.join(probe, ["e", "bin"]).where(smaller & (F.col("ra") != F.col("rb")) & (F.col("na") >= similarity * F.col("nb") - 1e-6) & room)
    return met.select("a", "b").distinct()


def _likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose whole prefixes share enough."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("size").alias(f"n{c}"), F.col("prefix").alias(f"p{c}"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("n"))
    return met.where(_reaches(similarity)).select("a", "b")


def similar_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """One row a document: the id, ``node``, ``root`` and ``component_id``, of classes linked by texts of at least ``similarity``.

    Texts whose fingerprints differ in at most ``DISTANCE`` bits are linked first, by deletion-variant signatures.
    What they miss an exact search finds: in one order of all shingles, frequent ones last, two texts of the similarity
    share one of the first (1 - similarity) of theirs. Texts of crowded shingles first meet a few hubs, which joins
    most of a large group by few pairs; then all texts that share a first shingle meet, unless they are in
    one class already or their sizes and the shingle's places rule the similarity out. Every pair is verified
    by exact Jaccard similarity of the whole texts, whose shingles are hashed once a node and not once a pair.
    Texts with equal sets of shingles are one node throughout.
    """
    spark = docs.sparkSession
    with made() as paths:
        found, kept = written(_similar(docs, id_col, text_col, shingle, similarity), "classes")
    drop(spark, *(p for p in paths if p != kept))
    return found


def _similar(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float) -> DataFrame:
    keyed = docs.select(id_col, text_col).withColumn("t__", F.xxhash64(text_col))  # tells rows with one id apart
    common = common_shingles(docs, text_col=text_col, shingle=shingle)
    full, full_at = written(prefixes(keyed, [id_col, "t__"], text_col=text_col, shingle=shingle, similarity=similarity, common=common), "prefixes")
    rows = materialise(full.select(id_col, "node"), "rows")
    least = F.min(F.struct(F.col(id_col).isNull().alias("n"), F.col(id_col).alias("i"), F.col("t__").alias("t")))
    nodes = full.groupBy("node").agg(least.alias("least"), F.min("fp").alias("fp"), F.first("size").alias("size"), F.first("prefix").alias("prefix"))
    nodes = materialise(nodes.select("node", F.col("least.i").alias("first_id"), F.col("least.t").alias("first_t"), "fp", "size", "prefix"), "nodes")
    drop(docs.sparkSession, full_at)
    reps = materialise(nodes.select("node", F.col("first_id").alias("i__"), F.col("first_t").alias("f__")), "reps")

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that have the similarity, written. Only texts that are in a pair are read, hashed and moved; what was written for that goes."""
        with made() as paths:
            wanted = materialise(pairs.select(F.col("a").alias("node")).unionAll(pairs.select("b")).distinct(), "wanted")
            own = materialise(reps.join(sized(wanted), "node", "left_semi"), "own")  # its true size decides whether the texts are shuffled to meet it
            texts = keyed.join(sized(own), F.col(id_col).eqNullSafe(F.col("i__")) & F.col("t__").eqNullSafe(F.col("f__"))).select("node", F.col(text_col).alias("text__"))
            found, kept = written(_verified(pairs, materialise(shingle_sets(texts.dropDuplicates(["node"]), shingle), "sets"), similarity), "links")
        drop(docs.sparkSession, *(p for p in paths if p != kept))
        return found

    near = linked(materialise(fingerprint_pairs(nodes.select("node", "fp")), "fingerprint-pairs"))
    classes = connected_components(near)
    of_shingle = nodes.select("node", "size", F.posexplode("prefix").alias("pos", "e"))
    held = None
    for k in range(SLICES):
        part = of_shingle.where(F.pmod("e", F.lit(SLICES)) == k)
        shared = part.groupBy("e").agg(F.count("*").alias("texts")).where("texts > 1")
        done = materialise(part.join(shared, "e").select("e", "node", "size", "pos", "texts"), "held")
        held = done if held is None else held.unionAll(done)
    for turn in range(HUB_ROUNDS):
        pairs = materialise(_hubs(_rooted(held.where(F.col("texts") >= CROWD), classes), similarity, turn), "hubs")
        near = near.unionAll(linked(pairs))
        classes = connected_components(near)
    pairs = materialise(_likely(_candidates(_rooted(held, classes), similarity), nodes, similarity), "candidates")
    classes = connected_components(near.unionAll(linked(pairs)))
    rooted = nodes.join(classes, "node", "left").select("node", "first_id", F.coalesce("component", "node").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first_id").alias("component_id")), "root").select("node", "root", "component_id")
    return rows.join(named, "node").select(id_col, "node", "root", "component_id")


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = SIMILARITY) -> DataFrame:
    """The columns of ``docs``, one row of each class: that with the smallest id (rows that repeat it are dropped as well).

    A class whose ids are all null keeps one row, whichever. Columns row__, i__, n__ and r__ have to be renamed first.
    """
    clear_of(docs.columns, "row__", "i__", "n__", "r__")
    classes = similar_classes(docs, id_col=id_col, text_col=text_col, shingle=shingle, similarity=similarity)
    kept = classes.where(F.col(id_col).eqNullSafe(F.col("component_id"))).select(F.col(id_col).alias("i__"), F.col("node").alias("n__"), F.col("root").alias("r__"))
    kept = materialise(kept, "kept")
    if classes.groupBy(id_col).count().where("count > 1").isEmpty():
        return docs.join(sized(kept.select("i__")), F.col(id_col).eqNullSafe(F.col("i__")), "left_semi")
    own = prefixes(docs.withColumn("row__", F.struct(*docs.columns)), ["row__"], text_col=text_col, shingle=shingle)
    named = own.join(kept.distinct(), F.col(f"row__.{id_col}").eqNullSafe(F.col("i__")) & (F.col("node") == F.col("n__")))
    return named.dropDuplicates(["i__", "r__"]).select("row__.*")
