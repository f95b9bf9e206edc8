"""What the operators share with the rest of the library: tables in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusloom.workspace import drop, made, materialise, scratch, shared_dir, written

__all__ = ["clear_of", "drop", "lean", "made", "materialise", "scratch", "shared_dir", "table", "written"]

#: Rows of an Arrow batch, which hold whole texts; Spark's default of 10,000 takes tens of MB for each task on both sides.
ARROW_ROWS = 1000
_ROWS_KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


def clear_of(columns: list[str], *own: str) -> None:
    """Raise if a table that an operator carries along has a column with one of the operator's own names."""
    taken = {c.lower() for c in columns} & set(own)
    if taken:
        raise ValueError(f"rename these columns first: {sorted(taken)}")


def lean(spark: SparkSession) -> None:
    """Smaller Arrow batches, unless the session has its own setting."""
    if spark.conf.get(_ROWS_KEY) == "10000":
        spark.conf.set(_ROWS_KEY, str(ARROW_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    lean(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
