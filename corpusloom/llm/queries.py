"""The queries of this subpackage and their DuckDB SQL, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm import align, bpe, cuckoo, langid, mixing, pii, quality, secrets, simhash, spans, tiff, warc, wavelet
from corpusloom.llm.shared import table

#: Where the ranks and the pattern of the BPE vocabulary are; other vocabularies are passed to the operators.
RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
#: The two tokenizers that are aligned.
BYTE_LEVEL, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op1_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiff.media_digest(table(spark, sf_dir, "documents"))


def op2_warc_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.documents_language(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.roundtrip(table(spark, sf_dir, "documents"), ["doc_id"], path=RANKS, pattern=PATTERN)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.document_classes(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.document_findings(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.document_mix(table(spark, sf_dir, "documents"))


def op8_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spans.document_spans(table(spark, sf_dir, "documents"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.document_secrets(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.document_rules(table(spark, sf_dir, "documents"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.document_groups(table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.search(wavelet.build(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"), a_path=BYTE_LEVEL, b_path=PIECES)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_tiff_media, op2_warc_normalise, op3_language_id, op4_byte_bpe, op5_simhash, op6_pii, op7_mixing, op8_sentence_spans, op9_secrets, op10_quality, op11_exact_dedup, op12_ranked_search, op13_alignment, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc_normalise": warc.oracle_sql(), "op7_mixing": mixing.oracle_sql(), "op10_quality": quality.oracle_sql(), "op11_exact_dedup": cuckoo.oracle_sql(), "op12_ranked_search": wavelet.oracle_sql()}
