"""A training-data pipeline over ``documents``: five stages, each written as Parquet and read by the next.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns
of documents. Nulls, empty and very long texts, ties, repeated rows, empty tables and extra columns
are handled as the operators' docstrings say; columns other than those of documents are dropped at
the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import bpe, mixing, quality, secrets, simhash
from corpusloom.llm.shared import drop, lean, made, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: No source is emitted more often than this; see README on what that does to the size of the output.
MAX_REPEATS = 2.0


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules or the verdict of their source reject go. Texts are measured once and written."""
    return quality.with_verdicts(docs.select(*COLUMNS), COLUMNS).where("kept").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates (five-word shingles) the document with the smallest doc_id stays."""
    lean(spark)
    return simhash.keep_one(docs.select(*COLUMNS), shingle=5)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are redacted in the text, n_chars follows; no document is dropped."""
    lean(spark)
    done = secrets.redact(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document is emitted once or more, small sources more often, towards even weights; rows in the order of the blocks' permutations."""
    rows = docs.select(*COLUMNS)
    sources = mixing.source_plan(rows, max_repeats=MAX_REPEATS)
    return mixing.in_order(mixing.realise(rows, sources), sources).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the digests of the ids and of the decoded bytes, a row for every emitted document."""
    lean(spark)
    return bpe.roundtrip(docs.select("doc_id", "source", "text"), ["doc_id", "source"], path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [("quality", quality_rules), ("near_duplicates", near_duplicates), ("secrets", secret_scan), ("mixing", mix_sources), ("bpe", encode)]

#: Fingerprints, components and merges have no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote for its result goes when that result is written; a stage by itself leaves it to the session."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        with made() as left:
            rows = stage(spark, docs, sf_dir)
        docs, path = written(rows, f"stage-{name}")
        drop(spark, *before, *left)
        before = [path]
    return STAGES[-1][1](spark, docs, sf_dir)
