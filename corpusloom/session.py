"""Session settings the engine expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


DEFAULTS = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"}


def session(app: str = "corpusloom", *, master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution, ANSI mode and UTC where neither ``conf`` nor the cluster's own settings say otherwise."""
    builder = SparkSession.builder.appName(app)
    for k, v in (conf or {}).items():
        builder = builder.config(k, v)
    spark = (builder.master(master) if master else builder).getOrCreate()
    given = spark.sparkContext.getConf()
    for k, v in DEFAULTS.items():
        if k not in (conf or {}) and not given.contains(k):
            spark.conf.set(k, v)
    return spark


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
