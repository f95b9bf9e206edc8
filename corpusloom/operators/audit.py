"""Reports, integrity metrics and repairs. A metric table is one row, computed in one pass where one table suffices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom import schemas as V
from corpusloom.functions.normalize import append_note, venue


def filled(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != ""


def corpus_stats(df: DataFrame, *, by: str, present: list[str]) -> tuple[DataFrame, DataFrame]:
    """(one row of totals, counts by a column)."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(filled(c)).alias(f"with_{c}") for c in present]), df.groupBy(by).agg(F.count("*").alias("n"))


def coverage_row(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(F.count("*").alias("total"), *[F.coalesce(F.try_divide(F.count_if(filled(c)), F.count("*")), F.lit(0.0)).alias(f"{c}_coverage") for c in columns])


def by_year(df: DataFrame, year: Column, *, low: int = 1950, high: int = 2030) -> DataFrame:
    return df.select(year.alias("year")).where(F.col("year").between(low, high)).groupBy("year").agg(F.count("*").alias("n"))


def last_hours(df: DataFrame, ts: str, hours: int, by: str) -> DataFrame:
    """Counts by ``by`` over the ``hours`` before the newest row."""
    newest = df.agg(F.max(ts).alias("m__"))
    return df.join(F.broadcast(newest), how="cross").where(F.col(ts) >= F.col("m__") - F.expr(f"interval {hours} hours")).groupBy(by).agg(F.count("*").alias("n"))


def log_summary(log: DataFrame, key: str, status: str, duration: str, *, done: str = "completed") -> DataFrame:
    ok = F.col(status) == done
    return log.groupBy(key).agg(F.count("*").alias("queries"), F.count_if(ok).alias("completed"), F.avg(duration).alias("avg_duration"), F.coalesce(F.try_divide(F.count_if(ok), F.count("*")), F.lit(0.0)).alias("acceptance_rate"))


def query_records(events: DataFrame) -> DataFrame:
    """start and end events of a query id as one record."""
    start = events.where("event = 'start'").groupBy("query_id").agg(F.min_by(F.struct("ts", "api", "query_text"), "ts").alias("s"))
    end = events.where("event = 'end'").groupBy("query_id").agg(F.max_by(F.struct("ts", "status", "results"), "ts").alias("e"))
    return start.join(end, "query_id", "left").select("query_id", "s.api", "s.query_text", F.col("s.ts").alias("started_at"), F.col("e.ts").alias("ended_at"), F.coalesce("e.status", F.lit("started")).alias("status"), F.col("e.results").alias("results"))


def gates(df: DataFrame, limits: dict[str, float]) -> DataFrame:
    """One row a gate: column, coverage, limit, passed."""
    cov = coverage_row(df, list(limits))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("gate"), F.col(f"{c}_coverage").alias("coverage"), F.lit(v).alias("limit")) for c, v in limits.items()]))
    return cov.select(each.alias("g")).select("g.*").withColumn("passed", F.col("coverage") >= F.col("limit"))


def reject_candidates(papers: DataFrame, allow: DataFrame, neuro: DataFrame, *, high: int = 150) -> DataFrame:
    """Papers about to be rejected, with the reasons that protect them."""
    cand = papers.where((F.lower(F.coalesce("topic_decision", F.lit(""))) == "off_topic") | (F.lower(F.coalesce("triage_decision", F.lit(""))) == "reject")).withColumn("v__", venue(F.col("venue")))
    a, n = (x.select(F.col("venue").alias("v__")).distinct().withColumn(name, F.lit(True)) for x, name in ((allow, "a__"), (neuro, "n__")))
    j = cand.join(a, "v__", "left").join(n, "v__", "left")
    why = F.array(F.when(F.col("a__"), F.lit("allowlist")), F.when(F.coalesce("n__", F.lit(False)) | F.col("v__").rlike(r"\bneuro|\bbrain"), F.lit("neuroscience")), F.when(F.coalesce("citation_count", F.lit(0)) >= high, F.lit(f"high_citation>={high}")))
    return j.withColumn("protected_reasons", F.array_join(F.filter(why, lambda x: x.isNotNull()), ";")).drop("a__", "n__", "v__")


def file_integrity(papers: DataFrame, files: DataFrame) -> DataFrame:
    """Missing and differing files, shared hashes, orphans. ``files``: path, sha256."""
    have = papers.where(filled("pdf_path")).join(files.select(F.col("path").alias("p__"), F.col("sha256").alias("s__")), F.col("pdf_path") == F.col("p__"), "left")
    a = have.agg(F.count_if(F.col("p__").isNull()).alias("missing_pdf_path_files"), F.count_if((F.col("s__") != F.col("pdf_sha256")) & filled("pdf_sha256")).alias("pdf_sha256_mismatch_rows"))
    dup = papers.where(filled("pdf_sha256")).groupBy("pdf_sha256").agg((F.count("*") - 1).alias("c")).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("duplicate_pdf_sha_rows"))
    orphans = files.join(papers.select(F.col("pdf_path").alias("path")).where(filled("path")), "path", "left_anti").agg(F.count("*").alias("orphan_pdf_files"))
    return a.join(dup, how="cross").join(orphans, how="cross")


def semantic_integrity(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Vocabulary and state counters. ``results``: ae_output_path, status, n_claims, n_rules, confidence of the outputs that exist."""
    r = results.select(F.col("ae_output_path").alias("o__"), F.col("status").alias("r_status"), F.col("n_claims").alias("r_claims"), F.col("n_rules").alias("r_rules"), F.col("confidence").alias("r_conf"))
    j = papers.join(r, F.col("ae_output_path") == F.col("o__"), "left")
    out, n = F.col("o__").isNotNull(), F.count_if
    valid = F.col("ae_status").isin(*V.AE_STATUS)
    final = F.col("ae_status").isin("SUCCESS", "PARTIAL_SUCCESS", "FAIL")
    differs = lambda a, b: F.coalesce((F.col(a) != F.col(b)).cast("int"), F.lit(0))
    summary = differs("ae_n_claims", "r_claims") + differs("ae_n_rules", "r_rules") + F.coalesce((F.abs(F.col("ae_confidence") - F.col("r_conf")) > 1e-9).cast("int"), F.lit(0))
    return j.agg(
        F.count("*").alias("papers_total"), n(F.col("triage_decision") == "pending").alias("pending_triage_rows"),
        n(filled("status") & ~F.col("status").isin(*V.STATUSES)).alias("invalid_status_rows"),
        n(filled("triage_decision") & ~F.col("triage_decision").isin(*V.TRIAGE_DECISIONS, *V.DEPRECATED_DECISIONS)).alias("invalid_triage_rows"),
        n(F.col("triage_decision").isin(*V.DEPRECATED_DECISIONS)).alias("deprecated_triage_rows"),
        n((F.col("triage_decision") == "pending") & ~F.col("status").isin("candidate", "pending_scorer")).alias("pending_triage_invalid_status_rows"),
        n((F.col("ae_status") == "pending") & ~filled("ae_job_path")).alias("ae_pending_without_job_rows"),
        n(final & ~out).alias("ae_terminal_without_output_rows"), n((F.col("ae_status") == "pending") & out).alias("ae_pending_with_output_rows"),
        n(filled("ae_status") & (~valid | (out & F.col("r_status").isNotNull() & (F.col("r_status") != F.col("ae_status"))))).alias("ae_result_status_mismatch_rows"),
        F.coalesce(F.sum(F.when(final & out & F.col("r_status").isNotNull(), summary)), F.lit(0)).alias("ae_result_summary_mismatch_rows"),
    )


def match_integrity(papers: DataFrame) -> DataFrame:
    n, s = F.count_if, F.col("match_status")
    given = filled("match_status")
    ids = F.try_parse_json("candidates_json")
    is_list = F.coalesce(F.startswith(F.schema_of_variant(ids), F.lit("ARRAY")), F.lit(False))
    return papers.agg(
        F.count("*").alias("rows_total"), n(filled("classified_at") & (filled("doi") | filled("title")) & ~given).alias("missing_dedupe_rows"),
        n(given & ~s.isin(*V.MATCH_STATUS)).alias("bad_status_rows"), n(given & (~F.coalesce("match_basis", F.lit("")).isin(*V.MATCH_BASIS) | ((s == "unmatched") & (F.col("match_basis") != "none")))).alias("bad_basis_rows"),
        n((s == "matched") & ~filled("match_paper_id")).alias("matched_missing_paper_id_rows"), n((s == "matched") & ~F.coalesce((F.col("match_confidence") > 0) & (F.col("match_confidence") <= 1), F.lit(False))).alias("matched_bad_confidence_rows"),
        n((s == "unmatched") & filled("match_paper_id")).alias("unmatched_with_paper_id_rows"), n(given & filled("candidates_json") & ~is_list).alias("bad_candidates_json_rows"),
        n((s == "ambiguous") & (F.coalesce(F.trim("candidates_json"), F.lit("[]")) == "[]")).alias("ambiguous_missing_candidates_rows"), n(given & ~filled("deduped_at")).alias("missing_deduped_at_rows"),
    )


def classification_integrity(papers: DataFrame, *, core: list[str], lists: list[str], payload: str, booleans: list[str], units: list[str]) -> DataFrame:
    """Empty core fields, JSON columns that are no list or no object, booleans outside 0/1, confidences outside 0 to 1."""
    kind = lambda c, k: F.coalesce(F.startswith(F.schema_of_variant(F.try_parse_json(c)), F.lit(k)), F.lit(False))
    any_of = lambda cs: F.greatest(*[c.cast("int") for c in cs], F.lit(0)) == 1
    return papers.agg(
        F.count("*").alias("classified_rows"), F.count_if(any_of([~filled(c) for c in core])).alias("missing_core_rows"), *[F.count_if(~kind(c, "ARRAY")).alias(f"bad_{c}_rows") for c in lists],
        F.count_if(~kind(payload, "OBJECT")).alias("bad_payload_rows"), F.count_if(any_of([~F.coalesce(F.col(c).isin(0, 1), F.lit(False)) for c in booleans])).alias("bad_boolean_rows"),
        F.count_if(any_of([F.coalesce(~F.col(c).between(0, 1), F.lit(False)) for c in units])).alias("bad_confidence_rows"),
    )


def schema_drift(df: DataFrame, expected: dict[str, str]) -> DataFrame:
    """One row an expected or present column: column, expected, present, ok."""
    have = dict(df.dtypes)
    rows = [(c, expected.get(c), have.get(c), expected.get(c) == have.get(c)) for c in sorted(expected.keys() | have.keys())]
    return df.sparkSession.createDataFrame(rows, "column string, expected string, present string, ok boolean")


def manifest(files: DataFrame) -> DataFrame:
    """Batch, files, bytes and hash of a batch. ``files``: batch, path, length, content."""
    each = files.select("batch", "path", "length", F.sha2("content", 256).alias("sha256"))
    return each.groupBy("batch").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "sha256"))), lambda x: x["sha256"]), "\n"), 256).alias("digest"))


def repaired_state(papers: DataFrame, results: DataFrame) -> DataFrame:
    """Idempotent: deprecated decisions renamed, results taken over, terminal rows without an output set back with one note."""
    r = results.select(F.col("ae_output_path").alias("o__"), F.col("status").alias("r_status"), F.col("n_claims").alias("r_claims"), F.col("n_rules").alias("r_rules"), F.col("confidence").alias("r_conf"))
    j = papers.join(r, F.col("ae_output_path") == F.col("o__"), "left")
    take = F.col("o__").isNotNull() & F.col("r_status").isNotNull() & ~F.col("ae_status").eqNullSafe(F.col("r_status"))
    lost = F.col("ae_status").isin("SUCCESS", "PARTIAL_SUCCESS", "FAIL") & F.col("o__").isNull()
    pick = lambda mine, theirs: F.when(take, F.col(theirs)).when(lost, None).otherwise(F.col(mine))
    return j.withColumns({
        "triage_decision": F.coalesce(*[F.when(F.col("triage_decision") == k, v) for k, v in V.DEPRECATED_DECISIONS.items()], F.col("triage_decision")),
        "human_notes": F.when(lost, append_note(F.col("human_notes"), "Set back: its output is missing.")).otherwise(F.col("human_notes")),
        "ae_n_claims": pick("ae_n_claims", "r_claims"), "ae_n_rules": pick("ae_n_rules", "r_rules"), "ae_confidence": pick("ae_confidence", "r_conf"),
        "ae_status": F.when(take, F.col("r_status")).when(lost, "pending").otherwise(F.col("ae_status")),
    }).select(*papers.columns)


def changed_rows(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """How many rows differ, column by column."""
    cols = [c for c in before.columns if c != key]
    j = before.alias("b").join(after.alias("a"), key)
    return j.agg(*[F.count_if(~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))).alias(c) for c in cols])


def bundle_problems(bundles: DataFrame, claims: DataFrame, rules: DataFrame) -> DataFrame:
    """Bundles whose counts or hash differ from what they say: run_id, problems. ``bundles``: run_id, n_claims, n_rules, pdf_sha256, actual_sha256."""
    c, r = (d.groupBy("run_id").agg(F.count("*").alias(n)) for d, n in ((claims, "c__"), (rules, "r__")))
    j = bundles.join(c, "run_id", "left").join(r, "run_id", "left").fillna(0, ["c__", "r__"])
    checks = [(F.col("n_claims") != F.col("c__"), "claim_count"), (F.col("n_rules") != F.col("r__"), "rule_count"), (F.col("pdf_sha256") != F.col("actual_sha256"), "pdf_hash")]
    return j.select("run_id", F.filter(F.array(*[F.when(x, F.lit(n)) for x, n in checks]), lambda x: x.isNotNull()).alias("problems"))


def run_summary(runs: DataFrame) -> DataFrame:
    return runs.agg(F.count("*").alias("total"), F.count_if(F.col("status").isin("SUCCESS", "PARTIAL_SUCCESS")).alias("succeeded"), F.count_if(F.col("status") == "FAIL").alias("failed"), F.coalesce(F.sum("n_claims"), F.lit(0)).alias("claims"), F.coalesce(F.sum("n_rules"), F.lit(0)).alias("rules"), F.avg("seconds").alias("mean_seconds"))


def acquisition(papers: DataFrame) -> DataFrame:
    return papers.agg(F.count("*").alias("total"), F.count_if(filled("doi")).alias("with_doi"), F.count_if(filled("pdf_path")).alias("with_pdf"), F.count_if(filled("doi") & ~filled("pdf_path")).alias("to_download"))


def invalid_transitions(history: DataFrame, key: str, order: str, state: str, allowed: dict[str, list[str]]) -> DataFrame:
    """Steps between successive states that the machine does not allow."""
    step = history.withColumn("previous", F.lag(state).over(Window.partitionBy(key).orderBy(order)))
    legal = [F.lit(f"{a}>{b}") for a, bs in allowed.items() for b in bs]
    return step.where("previous is not null").where(~F.concat_ws(">", "previous", state).isin(*legal) if legal else F.lit(True))


def orphans(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    return child.where(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def download_candidates(papers: DataFrame, files: DataFrame) -> DataFrame:
    """Papers with a DOI and no file that exists."""
    return papers.where(filled("doi")).join(files.select(F.col("path").alias("pdf_path")), "pdf_path", "left_anti")


