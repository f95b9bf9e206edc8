"""Incremental surfaces as Structured Streaming. Progress is in the checkpoint; every sink is idempotent by key or batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def inbox(spark: SparkSession, path: str, *, pattern: str = "*.pdf", archive: str | None = None) -> DataFrame:
    """A stream of files that arrive in a folder: path, length, sha256; read ones move to ``archive``."""
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern)
    if archive:
        r = r.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    return r.load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def available_now(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process what has arrived since the last run, in batches, then stop."""
    q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def unprocessed(arrived: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Resume by the set of processed keys, which holds in whatever order they finished."""
    return arrived.join(done.select(key), key, "left_anti")


def counted_stream(spark: SparkSession, path: str, schema: StructType, keys: list[str], value: str, *, pattern: str = "*.parquet") -> DataFrame:
    """Running count, sum and maximum of every key over files that arrive in a folder."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.max(value).alias("most"))


def to_the_end(stream: DataFrame, target: str, checkpoint: str) -> DataFrame:
    """The final state of an aggregated stream over all that has arrived (one row a key), as a table at ``target``: no state passes the driver."""

    def sink(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(target)

    q = stream.writeStream.outputMode("complete").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(target)


def write_batches(target: str) -> Callable[[DataFrame, int], None]:
    """A sink that writes each batch under its number: a repeated batch overwrites itself."""
    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return sink


# ---------------------------------------------------------------- extensions: event-time windows
def _timed(stream: DataFrame, ts: str, late: str | None) -> DataFrame:
    """Watermarks need an instant: a time without a zone is taken in the session's."""
    if stream.schema[ts].dataType.typeName() == "timestamp_ntz":
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, late) if late else stream


def windowed(stream: DataFrame, ts: str, *, size: str, late: str, keys: list[str] = (), slide: str | None = None, value: Column | None = None) -> DataFrame:
    """Tumbling or sliding windows with a watermark; rows later than ``late`` are dropped by definition of the watermark."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    aggs = [F.count("*").alias("n")] + ([F.sum(value).alias("total")] if value is not None else [])
    return _timed(stream, ts, late).groupBy(w.alias("window"), *keys).agg(*aggs)


def sessions(stream: DataFrame, ts: str, key: str, *, gap: str, late: str | None = None) -> DataFrame:
    return _timed(stream, ts, late).groupBy(F.session_window(ts, gap).alias("session"), key).agg(F.count("*").alias("n"))
