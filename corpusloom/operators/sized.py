"""Broadcast hints behind a measured number of rows and bytes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What may be sent to every task: rows and bytes, both at most.
BROADCAST_ROWS, BROADCAST_BYTES = 20_000, 64 << 20


def value_bytes(value: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory, 16 of them for itself."""
    zero, own = F.lit(0).cast("long"), F.lit(16).cast("long")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return own + F.coalesce(F.octet_length(value).cast("long"), zero)
    if isinstance(kind, T.ArrayType):
        if isinstance(kind.elementType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)):
            return own + F.coalesce(F.greatest(F.size(value), F.lit(0)).cast("long") * 8, zero)
        return own + F.coalesce(F.aggregate(value, zero, lambda total, x: total + value_bytes(x, kind.elementType)), zero)
    if isinstance(kind, T.MapType):
        return value_bytes(F.map_keys(value), T.ArrayType(kind.keyType)) + value_bytes(F.map_values(value), T.ArrayType(kind.valueType))
    if isinstance(kind, T.StructType):
        return sum((value_bytes(value[f.name], f.dataType) for f in kind.fields), own)
    return own


def row_bytes(df: DataFrame) -> Column:
    return sum((value_bytes(df[f"`{f.name}`"], f.dataType) for f in df.schema.fields), F.lit(0).cast("long"))


def small(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows of ``size`` bytes together, measured on a bounded prefix; else as it is, for a shuffled join."""
    m = df.select(row_bytes(df).alias("b")).limit(rows + 1).agg(F.count("*").alias("n"), F.sum("b").alias("b")).first()
    return F.broadcast(df) if m["n"] <= rows and (m["b"] or 0) <= size else df


#: Narrow rows that a task may hold at once, and those of a task while there are few.
HELD_ROWS, FEW_ROWS = 1_000_000, 50_000


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` by ``keys`` in as many partitions as its rows call for, so that a task holds no more of them when there are more."""
    rows = df.count()
    return df.repartition(max(1, min(-(-rows // FEW_ROWS), 2 * df.sparkSession.sparkContext.defaultParallelism), -(-rows // HELD_ROWS)), *keys)


#: Rows of a task where each costs much work, and the most that one task may get.
TASK_ROWS, MOST_ROWS = 2_000, 200_000


def spread(df: DataFrame, *keys: str, each: int = TASK_ROWS) -> DataFrame:
    """``df`` dealt out evenly where rows are narrow and cost much work: a small file is one task however many cores there are.

    Up to four tasks a core of ``each`` rows, more where they would hold more than ``MOST_ROWS``. Without ``keys`` (an id)
    a task sorts what it reads before it deals it out.
    """
    rows = df.count()
    return df.repartition(max(1, min(-(-rows // each), 4 * df.sparkSession.sparkContext.defaultParallelism), -(-rows // MOST_ROWS)), *keys)
