"""Tables that outlive a stage, in the folder all executors share.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``; a lost executor
then costs the re-read of a file, never the recomputation of a Python pass.
All of a session lies in one folder, named by the application, that goes when the session's file
system is closed; tables that a later one supersedes are dropped at once.
"""

from __future__ import annotations

import getpass
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FALLBACK = "file:///tmp/checkpoints/corpusloom-{user}"


def _qualified(spark: SparkSession, path: str):
    """The Hadoop path, qualified by the default file system if it names none, and its file system."""
    raw = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = raw.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, fs.makeQualified(raw)


def _configured(spark: SparkSession) -> str:
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local[") and master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = _LOCAL_FALLBACK.format(user=getpass.getuser())
    return named


def shared_dir(spark: SparkSession) -> str:
    """The shared folder as a URI: ``spark.checkpoint.dir`` if the session names one, on the default file system unless it has a scheme.

    Only a local master may fall back on a folder of this machine; on a cluster without
    the setting the call raises instead of writing where other executors cannot read.
    """
    uri = _qualified(spark, _configured(spark).rstrip("/"))[1].toString()
    return f"file:///{uri[5:].lstrip('/')}" if uri.startswith("file:") else uri


_homes: set[str] = set()


def _home(spark: SparkSession) -> str:
    home = f"{shared_dir(spark)}/corpusloom/{spark.sparkContext.applicationId}"
    if home not in _homes:
        fs, path = _qualified(spark, home)
        fs.mkdirs(path)
        fs.deleteOnExit(path)
        _homes.add(home)
    return home


_watched: list[list[str]] = []


@contextmanager
def made() -> Iterator[list[str]]:
    """The paths that are handed out inside the block, for a later ``drop``."""
    _watched.append([])
    try:
        yield _watched[-1]
    finally:
        _watched.pop()


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it goes with the session."""
    path = f"{_home(spark)}/{uuid.uuid4().hex}/{tag}"
    for each in _watched:
        each.append(path)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path for ``drop``. Shuffle files of the write go with its end."""
    spark, path = df.sparkSession, scratch(df.sparkSession, tag)
    before = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back."""
    return written(df, tag)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that nothing reads any more."""
    for each in paths:
        fs, path = _qualified(spark, each.rpartition("/")[0])
        fs.delete(path, True)
