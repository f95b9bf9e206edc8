"""Sinks: snapshots, exports, bundles, partitioned logs, embedding caches."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_snapshot(df: DataFrame, base: str, *, partition_by: list[str] = ()) -> str:
    """``df`` as a new snapshot directory below ``base``; readers switch by path, the old one is never overwritten."""
    path = f"{base.rstrip('/')}/snapshot-{uuid.uuid4().hex}"
    (df.write.partitionBy(*partition_by) if partition_by else df.write).parquet(path)
    return path


def export_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    flat = [F.array_join(c, "; ").alias(c) if dict(df.dtypes)[c].startswith("array") else F.col(c) for c in columns]
    df.select(*flat).write.mode("overwrite").csv(path, header=True, escape='"')


def ris_text() -> Column:
    """A paper row (title, authors, year, venue, doi, abstract) as an RIS record; missing fields have no line."""
    line = lambda tag, c: F.when(F.coalesce(F.trim(c.cast("string")), F.lit("")) != "", F.concat(F.lit(f"{tag}  - "), c.cast("string")))
    authors = F.nullif(F.array_join(F.transform("authors", lambda a: F.concat(F.lit("AU  - "), a)), "\n"), F.lit(""))
    return F.concat_ws("\n", F.lit("TY  - JOUR"), line("TI", F.col("title")), authors, line("PY", F.col("year")), line("JO", F.col("venue")), line("DO", F.col("doi")), line("AB", F.col("abstract")), F.lit("ER  - "), F.lit(""))


def export_ris(df: DataFrame, path: str) -> None:
    df.select(ris_text().alias("value")).write.mode("overwrite").text(path)


def bundle_records(papers: DataFrame) -> DataFrame:
    """(paper_id, bundle, payload, payload_sha256, problems): a paper as its job bundle's JSON, validated."""
    from corpusloom.functions.normalize import safe_filename
    from corpusloom.operators.synthesis import missing_fields

    body = F.to_json(F.struct(F.lit("ae.paper.v1").alias("schema"), "paper_id", "doi", "title", "authors", "year", "venue", "abstract", F.struct("triage_decision", "triage_score").alias("triage"), F.struct("pdf_path", "pdf_sha256").alias("files")))
    return papers.select("paper_id", F.concat(F.lit("job_"), safe_filename(F.col("paper_id"))).alias("bundle"), body.alias("payload"), F.sha2(body, 256).alias("payload_sha256"), missing_fields(papers, ["paper_id", "title", "pdf_path"]).alias("problems"))


#: Directories that bundles are dealt over by the CRC of their name. A directory to a bundle costs the file system several calls a paper, and the driver one.
SHARDS = 64


def bundle_shard(name: str) -> int:
    return zlib.crc32(name.encode()) % SHARDS


def write_bundles(papers: DataFrame, path: str) -> None:
    """Bundles without problems as JSON lines (bundle, payload), payload as it is; a bundle's directory follows from its name (``readers.read_job_bundles``)."""
    kept = bundle_records(papers).where(F.size("problems") == 0).select("bundle", "payload", (F.crc32("bundle") % SHARDS).cast("int").alias("shard"))
    kept.repartition("shard").write.partitionBy("shard").mode("append").json(path)


def append_log(records: DataFrame, path: str, ts: str = "started_at") -> None:
    """JSON lines by date, so that a reader of a span of days lists only those."""
    records.withColumn("date", F.to_date(ts)).write.mode("append").partitionBy("date").json(path)


def with_embeddings(texts: DataFrame, cache_path: str, model: str, provider: Callable, spark: SparkSession) -> DataFrame:
    """(key, embedding) of texts by hash of text and model; only texts that the cache lacks reach the provider."""
    keyed = texts.withColumn("key", F.md5(F.concat_ws("|", F.lit(model), F.md5("text"))))
    try:
        cache = spark.read.parquet(cache_path)
    except Exception as e:  # the cache does not exist yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        cache = spark.createDataFrame([], "key string, embedding array<float>")
    missing = keyed.select("key", "text").dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")
    missing.mapInPandas(provider, "key string, embedding array<float>").write.mode("append").parquet(cache_path)
    return keyed.join(spark.read.parquet(cache_path).dropDuplicates(["key"]), "key")


def review_queue(resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(resolved, to review) of resolved terms."""
    return resolved.where("term_id is not null"), resolved.where("term_id is null").select("term").distinct()
