"""Tables that are merged into: hashed into buckets, a manifest a version, one rename a commit.

A table is a folder with ``data`` (Parquet, a folder for every bucket of every write) and ``manifests``: each version's list of where its
buckets lie. A merge reads and rewrites the buckets that its changes touch, then commits by renaming one manifest; readers hold on to the
version they opened, and a merge that fails leaves none. A version is claimed before it is written, so of two merges from
one version one fails and changes nothing. The driver sees a line for each bucket.

Defined results: null keys lie in a bucket like any other; an empty change commits nothing; an empty table reads as
no rows with its columns.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.operators import merge as M

_BUCKET = "bucket__"


class Conflict(RuntimeError):
    """Another merge has taken the version that this one was to become."""


class BucketedTable:
    """The table at ``path``, keyed by ``key``. ``create`` starts one, the constructor opens the newest version (or ``version``)."""

    def __init__(self, spark: SparkSession, path: str, *, version: int | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())
        found = self.versions()
        if not found:
            raise FileNotFoundError(f"no table at {path}")
        self.version = found[-1] if version is None else version
        state = json.loads(self._read(f"manifests/{self.version:010d}.json"))
        self.key, self.n, self.where = state["key"], state["n"], {int(b): p for b, p in state["buckets"].items()}
        self.schema = StructType.fromJson(state["schema"])
        self.touched: list[int] = state["touched"]

    @classmethod
    def create(cls, rows: DataFrame, path: str, key: str, *, buckets: int = 64) -> BucketedTable:
        """A new table with ``rows``, which hold every key once. A bucket should hold some hundred MB: a merge rewrites whole ones."""
        table = cls.__new__(cls)
        table.spark, table.path, table.key, table.n, table.version = rows.sparkSession, path.rstrip("/"), key, buckets, 0
        table.where, table.schema, table.touched = {}, rows.schema, []
        table._fs = table._at("").getFileSystem(table.spark._jsc.hadoopConfiguration())
        table._fs.mkdirs(table._at("manifests"))
        table._replace(rows.withColumn(_BUCKET, table.bucket()), None)
        return cls(table.spark, path)

    def _at(self, inner: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{inner}" if inner else self.path)

    def _read(self, inner: str) -> str:
        stream = self._fs.open(self._at(inner))
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def versions(self) -> list[int]:
        return sorted(int(f.getPath().getName()[:-5]) for f in self._fs.globStatus(self._at("manifests/*.json")) or [])

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.n)).cast("int")

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """The rows of this version; of ``buckets`` alone, if they are named."""
        paths = [f"{self.path}/{p}" for b, p in self.where.items() if buckets is None or b in set(buckets)]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of the keys in the first column of ``keys``; only buckets that can hold one are read."""
        column = keys.columns[0]
        near = [r[0] for r in keys.select(self.bucket(F.col(column)).alias("b")).distinct().collect()]
        return self.read(near).join(keys.select(F.col(column).alias("wanted__")).distinct(), F.col(self.key) == F.col("wanted__"), "left_semi")

    def merge(self, changes: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> BucketedTable:
        """The next version: ``how(current, changes)`` over the buckets that ``changes`` touch (a row for each key)."""
        touched = sorted(r[0] for r in changes.select(self.bucket().alias("b")).distinct().collect())
        if not touched:
            return self
        merged = how(self.read(touched), changes).select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        self._replace(merged.withColumn(_BUCKET, self.bucket()), touched)
        return BucketedTable(self.spark, self.path, version=self.version + 1)

    def upsert(self, changes: DataFrame, order: str) -> BucketedTable:
        """Latest change of a key wins, column by column (``merge.upsert``)."""
        return self.merge(changes, lambda current, new: M.upsert(current, new, self.key, order))

    def replace(self, rows: DataFrame) -> BucketedTable:
        """Whole rows by key, one for each; a repeated call changes nothing."""
        return self.merge(rows, lambda current, new: current.join(new.select(self.key), self.key, "left_anti").unionByName(new))

    def delete(self, keys: DataFrame) -> BucketedTable:
        """Without the rows of ``keys`` (a column named as the key)."""
        return self.merge(keys.select(self.key), lambda current, gone: current.join(gone, self.key, "left_anti"))

    def _replace(self, rows: DataFrame, touched: list[int] | None) -> None:
        version, folder = self.version + 1, f"data/{uuid.uuid4().hex}"
        claim = self._at(f"manifests/{version:010d}.claim")
        if not self._fs.createNewFile(claim):
            raise Conflict(f"version {version} of {self.path} is being written or stands")
        try:
            rows.repartition(self.n, _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
            new = {}
            for f in self._fs.globStatus(self._at(f"{folder}/{_BUCKET}=*")) or []:
                name = f.getPath().getName()
                new[int(name.rpartition("=")[2])] = f"{folder}/{name}"
            kept = {b: p for b, p in self.where.items() if touched is not None and b not in set(touched)}
            state = {"key": self.key, "n": self.n, "schema": self.schema.jsonValue(), "touched": sorted(new) if touched is None else touched, "buckets": kept | new}
            self._commit(version, json.dumps(state))
        except BaseException:
            self._fs.delete(self._at(folder), True)
            self._fs.delete(claim, False)
            raise

    def _commit(self, version: int, state: str) -> None:
        draft, final = self._at(f"manifests/.{uuid.uuid4().hex}"), self._at(f"manifests/{version:010d}.json")
        out = self._fs.create(draft, False)
        out.write(bytearray(state.encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise Conflict(f"version {version} of {self.path} stands already")

    def vacuum(self, *, keep: int = 2) -> int:
        """Drop all but the newest ``keep`` versions and what only they point to, and the claims of merges that died; the number of folders that went.

        No merge may run meanwhile.
        """
        kept = self.versions()[-keep:]
        live = {p for v in kept for p in json.loads(self._read(f"manifests/{v:010d}.json"))["buckets"].values()}
        for f in self._fs.globStatus(self._at("manifests/*")) or []:
            if int(f.getPath().getName().partition(".")[0] or -1) not in kept:
                self._fs.delete(f.getPath(), False)
        gone = 0
        for f in self._fs.globStatus(self._at(f"data/*/{_BUCKET}=*")) or []:
            inner = "/".join(["data", *f.getPath().toString().rsplit("/", 2)[-2:]])
            if inner not in live:
                gone += bool(self._fs.delete(f.getPath(), True))
        return gone


class ExpiringCache:
    """Answers by key that hold for a time: the latest entry of a key counts, if it is not older than ``ttl_seconds`` when it is asked for.

    Entries are appended to a bucketed table by merging; ``compact`` drops the expired ones. Columns: key, value, cached_at.
    """

    SCHEMA = "key string, value string, cached_at timestamp"

    def __init__(self, table: BucketedTable, ttl_seconds: int):
        self.table, self.ttl = table, ttl_seconds

    @classmethod
    def create(cls, spark: SparkSession, path: str, *, ttl_seconds: int = 7 * 24 * 3600, buckets: int = 64) -> ExpiringCache:
        return cls(BucketedTable.create(spark.createDataFrame([], cls.SCHEMA), path, "key", buckets=buckets), ttl_seconds)

    def _fresh(self, now: Column) -> Column:
        return F.unix_micros(now) - F.unix_micros("cached_at") <= self.ttl * 1_000_000

    def get(self, keys: DataFrame, now: Column) -> DataFrame:
        """(key, value, state) for every distinct key: a hit, an expired entry (no value) or a miss."""
        asked = keys.select(F.col(keys.columns[0]).alias("asked__")).distinct()
        found = asked.join(self.table.lookup(asked), F.col("asked__") == F.col("key"), "left")
        state = F.when(F.col("key").isNull(), "miss").when(self._fresh(now), "hit").otherwise("expired")
        return found.select(F.col("asked__").alias("key"), F.when(self._fresh(now), F.col("value")).alias("value"), state.alias("state"))

    def put(self, entries: DataFrame) -> ExpiringCache:
        """With ``entries`` (key, value, cached_at); of several of a key, and against what stands, the latest counts."""

        def latest(current: DataFrame, new: DataFrame) -> DataFrame:
            return M.latest_wins(current.unionByName(new.select(*current.columns)), ["key"], ["cached_at", "value"]).select(*current.columns)

        return ExpiringCache(self.table.merge(entries, latest), self.ttl)

    def compact(self, now: Column) -> ExpiringCache:
        """Without expired entries; only buckets that hold one are rewritten."""
        return ExpiringCache(self.table.delete(self.table.read().where(~self._fresh(now)).select("key")), self.ttl)

    def through(self, keys: DataFrame, now: Column, fetch: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, ExpiringCache]:
        """Answers for ``keys``: hits from the cache, the others by ``fetch`` (key -> key, value, cached_at), which are put in."""
        from corpusloom.workspace import materialise

        state = materialise(self.get(keys, now), "cache")
        fetched = materialise(fetch(state.where("state <> 'hit'").select("key")), "fetched")
        return state.where("state = 'hit'").select("key", "value").unionAll(fetched.select("key", "value")), self.put(fetched)
