"""Keyed running state: a stream's aggregates, whose changed keys alone are written after each batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from corpusloom.sources.bucketed import BucketedTable


def running_state(totals: DataFrame, path: str, key: str, checkpoint: str, *, buckets: int = 64) -> StreamingQuery:
    """Run ``totals`` (a grouped stream, one row for each ``key``) over what has arrived; the keys that a batch changed replace their rows in the table at ``path``.

    Spark keeps the running counts, sums and maxima in its state store and hands out changed keys in update mode; the merge
    rewrites their buckets. A batch that is repeated after a failure replaces its rows by the same ones.
    """
    spark = totals.sparkSession

    def sink(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        try:
            try:
                BucketedTable(spark, path).replace(rows)
            except FileNotFoundError:
                BucketedTable.create(rows, path, key, buckets=buckets)
        finally:
            rows.unpersist()

    q = totals.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
