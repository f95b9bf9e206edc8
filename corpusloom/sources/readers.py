"""Sources: text tables, workbooks, trees, JSON and JSONL, directories of bundles, reference libraries, documents."""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.sized import small
from corpusloom.operators.taxonomy import flatten_tree
from corpusloom.schemas import FACET_NODES
from corpusloom.sources.sinks import bundle_shard


def sniff_separator(spark: SparkSession, path: str) -> str:
    """The separator of a text table, from its first line as Spark reads it."""
    head = spark.read.text(path).limit(1).collect()
    try:
        return csv.Sniffer().sniff(head[0][0][:4096], ",;\t|").delimiter if head else ","
    except csv.Error:
        return ","


def read_table(spark: SparkSession, path: str, *, sep: str | None = None, multi_line: bool = False) -> DataFrame:
    """CSV, TSV or TXT with a header; every column a string, an empty header becomes Column_i.

    ``multi_line`` lets quoted fields hold line ends, at the price that a file is then read by one task.
    """
    df = spark.read.csv(path, header=True, sep=sep or sniff_separator(spark, path), mode="PERMISSIVE", multiLine=multi_line, escape='"')
    return df.toDF(*[c if c and not c.startswith("_c") else f"Column_{i}" for i, c in enumerate(df.columns)])


def read_taxonomy(spark: SparkSession, tree: dict[str, list[dict]]) -> DataFrame:
    """A parsed taxonomy (facet -> nested nodes) as FACET_NODES."""
    return spark.createDataFrame(flatten_tree(tree), FACET_NODES)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def read_jsonl(spark: SparkSession, path: str, schema: str, *, strict: bool = False) -> DataFrame:
    """One object a line, blank lines skipped. Bad lines stay with ``bad_line`` set, or raise with ``strict``."""
    if strict:
        return spark.read.schema(schema).json(path, mode="FAILFAST")
    return spark.read.schema(f"{schema}, bad_line string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="bad_line")


def read_bundles(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """JSON files of a directory pattern, with the bundle (parent directory) and path they came from."""
    df = spark.read.schema(schema).option("multiLine", True).json(glob).withColumn("path", F.col("_metadata.file_path"))
    return df.withColumn("bundle", F.regexp_extract("path", "([^/]+)/[^/]+$", 1))


def read_job_bundles(spark: SparkSession, path: str, names: list[str] | None = None) -> DataFrame:
    """(bundle, payload) as ``sinks.write_bundles`` left them; with ``names`` only these, of which only their directories are read."""
    df = spark.read.schema("bundle string, payload string, shard int").json(path)
    if names is not None:
        df = df.where(F.col("shard").isin(sorted({bundle_shard(n) for n in names})) & F.col("bundle").isin(names))
    return df.select("bundle", "payload")


def read_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """path, length, modificationTime, sha256 of files; the bytes are hashed where they are read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return df.select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))


def library_items(items: DataFrame, data: DataFrame, values: DataFrame, fields: DataFrame, deleted: DataFrame, names: list[str]) -> DataFrame:
    """Entity-attribute-value tables of a reference library as one row an item, deleted items left out."""
    facts = data.join(values, "valueID").join(small(fields), "fieldID").where(F.col("fieldName").isin(names))
    wide = facts.groupBy("itemID").agg(*[F.min(F.when(F.col("fieldName") == n, F.col("value"))).alias(n) for n in names])
    return items.join(deleted.select("itemID"), "itemID", "left_anti").join(wide, "itemID", "left")


def library_authors(item_creators: DataFrame, creators: DataFrame, types: DataFrame) -> DataFrame:
    """(itemID, authors) in order; an item without authors takes all its creators."""
    c = item_creators.join(creators, "creatorID").join(small(types), "creatorTypeID")
    name = F.concat_ws(", ", F.nullif("lastName", F.lit("")), F.nullif("firstName", F.lit("")))
    listed = c.groupBy("itemID").agg(F.array_sort(F.collect_list(F.struct("orderIndex", (F.col("creatorType") == "author").alias("author"), name.alias("name")))).alias("all"))
    own = F.filter("all", lambda x: x["author"])
    return listed.select("itemID", F.transform(F.when(F.size(own) > 0, own).otherwise(F.col("all")), lambda x: x["name"]).alias("authors"))


def library_attachments(attachments: DataFrame, storage: str) -> DataFrame:
    """(itemID, pdf_path): ``storage:`` paths resolved below the item's key; the first file by path."""
    path = F.when(F.startswith("path", F.lit("storage:")), F.concat(F.lit(storage.rstrip("/") + "/"), "key", F.lit("/"), F.regexp_replace("path", "^storage:", ""))).otherwise(F.col("path"))
    return attachments.where("contentType = 'application/pdf'").groupBy(F.col("parentItemID").alias("itemID")).agg(F.min(path).alias("pdf_path"))


def library_papers(items: DataFrame, authors: DataFrame, attachments: DataFrame) -> DataFrame:
    """Paper rows of library items: venue from publication, else conference; year from the date."""
    from corpusloom.functions.normalize import blank_to_null, doi_library

    j = items.join(authors, "itemID", "left").join(attachments, "itemID", "left")
    return j.select(
        F.concat(F.lit("zotero:"), "key").alias("paper_id"), doi_library(F.col("DOI")).alias("doi"), "title", "authors",
        F.nullif(F.regexp_extract(F.coalesce("date", F.lit("")), r"\b(1[89][0-9]{2}|20[0-9]{2})\b", 1), F.lit("")).cast("int").alias("year"),
        F.coalesce(blank_to_null(F.col("publicationTitle")), blank_to_null(F.col("conferenceName"))).alias("venue"), F.col("abstractNote").alias("abstract"), "pdf_path",
    )


def added_since(df: DataFrame, ts: str, mark: Column) -> DataFrame:
    """Rows after a high-water mark; the next mark is the maximum of ``ts``."""
    return df.where(F.col(ts) > mark)


def document_text(files: DataFrame, extract, *, max_chars: int | None = None) -> DataFrame:
    """(path, text) of binary documents by ``extract`` (bytes -> text), a provider that runs on the executors; the whole text unless ``max_chars`` is given."""
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"path": pdf["path"], "text": [(extract(c) or "")[:max_chars] for c in pdf["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, text string")


def rows_to_papers(rows: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Spreadsheet rows as papers: mapped columns; the DOI from its column, else the first in any cell; no title and no DOI, no paper."""
    from corpusloom.functions import normalize as N

    col = lambda f: N.blank_to_null(F.col(mapping[f]).cast("string")) if f in mapping else F.lit(None).cast("string")
    cells = [N.doi_in_text(F.col(c).cast("string")) for c in rows.columns]
    doi = F.coalesce(N.doi_in_text(col("doi")), *cells)
    papers = rows.select(doi.alias("doi"), col("title").alias("title"), N.authors_from_field(col("authors")).alias("authors"), N.year_in_text(col("year")).alias("year"), col("venue").alias("venue"), col("abstract").alias("abstract"), col("url").alias("url"), col("citation").alias("citation"))
    return papers.where("doi is not null or title is not null or citation is not null").withColumn("paper_id", N.paper_id(F.col("doi"), F.coalesce("title", "citation")))
