"""Exact dedup by an index of cuckoo filters over the digests of live texts.

A text's key is the SHA-256 of its bytes without white space. Keys are dealt to buckets by their first bytes. A
bucket has a cuckoo filter of 16-bit fingerprints (four to a slot, two slots for each key), its stored
keys, and the content of every key. Inserting probes the filter: a key that it does not hold is new
and goes in; a hit is verified against the bucket, by key and then by content, byte for byte, and is a copy or a false
hit, which goes in as well. If fingerprints can be moved no further the filter is full and is rebuilt at twice the size
from the stored keys. Deleting takes members away; a key without members leaves filter, keys and content.

The index is three tables in the shared folder: ``filters`` (bucket, slots, keys), ``content`` (bucket, key,
content) and ``members`` (bucket, key, id, points: code points of the original text). Texts are shuffled by
bucket once, copies that a task has just seen left out, so a group of copies costs its bucket one
text a task. Members are narrow rows that are written where they arise; their groups are a partial aggregate.

Defined results: a null text is the empty text, and both equal texts of white space alone; the member with the most code
points stays, of these the smallest id (null ids last); repeated rows are members of their own. An empty
table gives an empty index. Different contents under one key, which SHA-256 rules out, raise an error.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.shared import materialise, written

SPACE = bytes([0x20, *range(0x09, 0x0E)])
#: Keys of a bucket, about; slots of a new filter; moves after which a filter is full.
BUCKET_KEYS, FIRST_SLOTS, MOVES = 4096, 256, 200
#: Keys whose content a task does not send again, the latest ones.
RECENT = 4096
_TAILS = bytes(range(0x80, 0xC0))


class CuckooFilter:
    """Fingerprints of keys: insert, delete, and a test that errs on the side of yes. The number of slots is a power of two."""

    def __init__(self, slots: int = FIRST_SLOTS, table: bytes | None = None):
        self.table = np.frombuffer(table, np.uint16).tolist() if table else [0] * (4 * slots)
        self.mask = len(self.table) // 4 - 1

    @staticmethod
    def _hash(key: bytes) -> tuple[int, int]:
        """The fingerprint (never 0) and the first slot's hash, from bytes of the key that its bucket does not use."""
        return int.from_bytes(key[8:10], "little") or 1, int.from_bytes(key[10:18], "little")

    def _other(self, slot: int, mark: int) -> int:
        return (slot ^ (mark * 0x5BD1E995)) & self.mask

    def _slots(self, key: bytes) -> tuple[int, int, int]:
        mark, where = self._hash(key)
        first = where & self.mask
        return mark, first, self._other(first, mark)

    def __contains__(self, key: bytes) -> bool:
        mark, a, b = self._slots(key)
        return mark in self.table[4 * a : 4 * a + 4] or mark in self.table[4 * b : 4 * b + 4]

    def _put(self, slot: int, mark: int) -> bool:
        for k in range(4 * slot, 4 * slot + 4):
            if not self.table[k]:
                self.table[k] = mark
                return True
        return False

    def insert(self, key: bytes) -> bool:
        """False if it is full; then a fingerprint has dropped out and the filter has to be built anew."""
        mark, a, b = self._slots(key)
        if self._put(a, mark) or self._put(b, mark):
            return True
        slot = a
        for move in range(MOVES):
            k = 4 * slot + (mark + move) % 4
            mark, self.table[k] = self.table[k], mark
            slot = self._other(slot, mark)
            if self._put(slot, mark):
                return True
        return False

    def delete(self, key: bytes) -> None:
        """Take a key out that was inserted."""
        mark, a, b = self._slots(key)
        for slot in (a, b):
            for k in range(4 * slot, 4 * slot + 4):
                if self.table[k] == mark:
                    self.table[k] = 0
                    return
        raise KeyError(key)

    def to_bytes(self) -> bytes:
        return np.array(self.table, np.uint16).tobytes()


class Bucket:
    """A filter with its stored keys, from which it is built anew at twice the size when it is full."""

    def __init__(self, slots: bytes | None = None, keys: bytes | None = None):
        self.filter = CuckooFilter(table=slots)
        self.keys = {keys[k : k + 32] for k in range(0, len(keys or b""), 32)}

    def add(self, key: bytes) -> None:
        self.keys.add(key)
        if not self.filter.insert(key):
            size = 2 * (self.filter.mask + 1)
            while True:
                self.filter = CuckooFilter(size)
                if all(map(self.filter.insert, self.keys)):
                    break
                size *= 2

    def remove(self, key: bytes) -> None:
        if key in self.keys:
            self.keys.remove(key)
            self.filter.delete(key)


@dataclass(frozen=True)
class Index:
    """Tables of the live texts; every change gives a new Index and leaves the old one as it was."""

    spark: SparkSession
    buckets: int
    id_type: T.DataType
    filters: DataFrame
    content: list[DataFrame]
    members: list[DataFrame]


def create(spark: SparkSession, expected_rows: int, id_type: T.DataType | None = None) -> Index:
    """An empty index with a bucket for every 4096 rows that are expected; more rows make larger buckets."""
    filters = spark.createDataFrame([], "bucket int, slots binary, keys binary")
    return Index(spark, max(1, -(-expected_rows // BUCKET_KEYS)), id_type or T.LongType(), filters, [], [])


def normalised(text: str | None) -> bytes:
    return (text or "").encode().translate(None, SPACE)


def _keyed(index: Index, docs: DataFrame, id_col: str, text_col: str, *, content: bool) -> DataFrame:
    """bucket, key, id and points of every row; or, with ``content``, bucket, key and content of texts that the task has not sent lately."""
    buckets, kind = index.buckets, docs.schema[id_col].dataType
    rest = [T.StructField("content", T.BinaryType())] if content else [T.StructField("id", kind), T.StructField("points", T.LongType())]
    schema = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("key", T.BinaryType()), *rest])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[bytes, int] = OrderedDict()
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
                bare = [t.translate(None, SPACE) for t in texts]
                keys = [hashlib.sha256(t).digest() for t in bare]
                if content:
                    fresh = []
                    for k, key in enumerate(keys):
                        if recent.get(key) != (check := hash(bare[k])):  # other content under the key is sent, and found
                            recent[key] = check
                            fresh.append(k)
                        recent.move_to_end(key)
                        if len(recent) > RECENT:
                            recent.popitem(last=False)
                    keys, last = [keys[k] for k in fresh], [pa.array([bare[k] for k in fresh], pa.binary())]
                else:
                    last = [part.column(0), pa.array([len(t.translate(None, _TAILS)) for t in texts], pa.int64())]
                at = [int.from_bytes(key[:8], "big") % buckets for key in keys]
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(keys, pa.binary()), *last], names=schema.names)

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def _hits(index: Index, keys: DataFrame) -> DataFrame:
    """Of (bucket, key) those that the filters hold, or seem to."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        held = CuckooFilter(table=right.column("slots")[0].as_py()) if right.num_rows else ()
        return left.filter(pa.array([k in held for k in left.column("key").to_pylist()], pa.bool_()))

    return keys.groupBy("bucket").cogroup(index.filters.select("bucket", "slots").groupBy("bucket")).applyInArrow(run, "bucket int, key binary")


_EVENTS = "bucket int, kind int, key binary, content binary, slots binary, keys binary"


def _changed(index: Index, events: DataFrame) -> DataFrame:
    """Play the events of each bucket: its filter (kind 0), stored contents (1), new contents (2), keys to take out (3).

    Rows are sorted by bucket and key outside Python, so a task holds one filter and one content. Comes back: a
    row (kind 0) for every bucket's filter, a row (2) for every content that is new.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bucket, stored = None, None, (None, None)
        for batch in batches:
            out = []
            for lo in range(0, batch.num_rows, 256):
                for row in batch.slice(lo, 256).to_pylist():
                    if row["bucket"] != number:
                        if bucket is not None:
                            out.append((number, 0, None, None, bucket.filter.to_bytes(), b"".join(sorted(bucket.keys))))
                        number, bucket, stored = row["bucket"], Bucket(row["slots"], row["keys"]), (None, None)
                    key, content = row["key"], row["content"]
                    if row["kind"] == 1:
                        stored = (key, content)
                    elif row["kind"] == 3:
                        bucket.remove(key)
                    elif row["kind"] == 2:
                        if key in bucket.filter and key == stored[0]:  # a hit: its content stands in the bucket
                            if content != stored[1]:
                                raise ValueError(f"different texts have the digest {key.hex()}")
                        else:  # not in the filter, or a false hit
                            bucket.add(key)
                            stored = (key, content)
                            out.append((number, 2, key, content, None, None))
                if out:
                    yield _batch(out)
                    out = []
        if bucket is not None:
            yield _batch([(number, 0, None, None, bucket.filter.to_bytes(), b"".join(sorted(bucket.keys)))])

    dealt = events.repartition("bucket").sortWithinPartitions("bucket", F.col("kind") != 0, "key", "kind")
    return dealt.mapInArrow(run, _EVENTS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["bucket", "kind", "key", "content", "slots", "keys"])


def _event(df: DataFrame, kind: int) -> DataFrame:
    have = set(df.columns)
    return df.select("bucket", F.lit(kind).alias("kind"), *((F.col(c) if c in have else F.lit(None).cast("binary")).alias(c) for c in ("key", "content", "slots", "keys")))


def _all(parts: list[DataFrame]) -> DataFrame | None:
    return reduce(DataFrame.unionAll, parts) if parts else None


def insert(index: Index, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Index:
    """The index with the rows of ``docs`` as members. Stored contents are read for keys that the filters hold only."""
    members = materialise(_keyed(index, docs, id_col, text_col, content=False), "members")
    fresh = _keyed(index, docs, id_col, text_col, content=True)
    events = _event(index.filters, 0).unionAll(_event(fresh, 2))
    if (content := _all(index.content)) is not None:
        hits = materialise(_hits(index, members.select("bucket", "key").distinct()), "hits")
        events = events.unionAll(_event(content.join(hits, ["bucket", "key"], "left_semi"), 1))
    changed = materialise(_changed(index, events), "index")
    return replace(index, filters=changed.where("kind = 0").select("bucket", "slots", "keys"), content=[*index.content, changed.where("kind = 2").select("bucket", "key", "content")], members=[*index.members, members])


def delete(index: Index, ids: DataFrame, *, id_col: str = "doc_id") -> Index:
    """The index without the members whose ids are in ``ids``; ids that it does not hold are ignored."""
    if not index.members:
        return index
    gone = ids.select(F.col(id_col).alias("gone")).distinct()
    members = _all(index.members)
    left = materialise(members.join(gone, F.col("id").eqNullSafe(F.col("gone")), "left_anti"), "members")
    dead = materialise(members.select("bucket", "key").distinct().join(left.select("bucket", "key").distinct(), ["bucket", "key"], "left_anti"), "dead")
    changed = materialise(_changed(index, _event(index.filters, 0).unionAll(_event(dead, 3))), "index")
    content = materialise(_all(index.content).join(dead, ["bucket", "key"], "left_anti"), "content")
    return replace(index, filters=changed.select("bucket", "slots", "keys"), content=[content], members=[left])


def lookup(index: Index, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): whether a row's text is live. The filters answer no; only their hits are looked for among the keys."""
    rows, _ = written(_keyed(index, docs, id_col, text_col, content=False), "asked")
    content = _all(index.content)
    if content is None:
        return rows.select(F.col("id").alias(id_col), F.lit(False).alias("found"))
    hits = content.join(_hits(index, rows.select("bucket", "key").distinct()), ["bucket", "key"], "left_semi").select(F.col("key").alias("live"))
    return rows.join(hits, F.col("key") == F.col("live"), "left").select(F.col("id").alias(id_col), F.col("live").isNotNull().alias("found"))


def groups(index: Index) -> DataFrame:
    """Every member with its group: id, keep_id, group_size, kept, key.

    The one that stays has the most points, then the smallest id; of repeated rows of that one, each counts as kept.
    """
    members = _all(index.members)
    if members is None:
        members = index.spark.createDataFrame([], T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("id", index.id_type), T.StructField("points", T.LongType())]))
    live = _all([c.select(F.col("key").alias("live")) for c in index.content])
    best = F.min(F.struct((-F.col("points")).alias("less"), F.col("id").isNull().alias("none"), F.col("id").alias("id"))).alias("best")
    whole = members.groupBy(F.col("key").alias("group")).agg(F.count("*").alias("group_size"), best)
    if live is not None:
        whole = whole.join(live, F.col("group") == F.col("live"), "left_semi")
    kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("points") == -F.col("best.less"))
    return members.join(whole, F.col("key") == F.col("group")).select("id", F.col("best.id").alias("keep_id"), "group_size", kept.alias("kept"), "key")


def document_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document, from an index that all are inserted into."""
    index = insert(create(docs.sparkSession, docs.count(), docs.schema["doc_id"].dataType), docs)
    return groups(index).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("key")).alias("text_sha256"))


def oracle_sql() -> str:
    return r"""
    WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, text_sha256
    FROM n WINDOW w AS (PARTITION BY text_sha256 ORDER BY points DESC, doc_id)"""
