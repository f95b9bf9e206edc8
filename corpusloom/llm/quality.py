"""Quality rules with host-level verdicts, all in built-in expressions.

Five rules fail a document; two of them (``BASE``) by themselves, the others (symbols, repeated lines, word
sizes) only with the host's verdict. Failures are counted by host and rule, and every rate is shrunk towards the
corpus by an empirical beta prior (method of moments over the hosts' rates), so that small hosts are not judged by a
handful of documents. Of a rule with prior mean m and deviation s, and a host whose shrunk rate r has the posterior
deviation d,

* the host is *suspect* if r - d > m: its documents that fail this rule are rejected;
* the host is *rejected* with all its documents if r - 3d > m + s, r > 2m and r >= ``HOST_LEAST``: far out among
  the hosts, and bad by itself, but not wholly bad.

Repeated windows are found inside a row: windows of 8 words are hashed (64 bits), and only where a
hash occurs twice the positions are sorted by hash and neighbours compared, so the work is n log n
in a text's words and never leaves its row. Host counts are partial aggregates; host verdicts come
back by an equi-join on the host, small enough to be broadcast by size in practice and otherwise
split by adaptive execution where one host holds many rows.

Defined results: a null text has no words and fails; a null host is a host of its own; repeated rows
count as documents; no documents, no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import clear_of, materialise
from corpusloom.llm.text import SPACE, words

MIN_WORDS, REPEAT_PERCENT, WINDOW = 20, 30, 8
#: A document fails a rule by its measures; the same text is SQL for Spark and DuckDB.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": f"100 * n_repeat_words > {REPEAT_PERCENT} * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "word_size": "(word_chars < 3 * n_words or word_chars > 10 * n_words)",
}
BASE = ("short", "repeats")
_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")
#: Least failure rate of a host that is rejected whole.
HOST_LEAST = 0.2
_SYMBOLS = "#*$%&|<>"


def n_repeat_words(word_array: Column, window: int = WINDOW) -> Column:
    """Words inside ``window``-word windows that occur twice or more in the text, the first occurrence included."""
    # transform over a one-element array binds a value once; inside the lambda it is a variable.
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)
    hashes = F.transform(word_array, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - window + 1), lambda i: F.xxhash64(F.slice(h, i, window)))

    def covered(win: Column) -> Column:
        placed = F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda a, j: F.coalesce(F.get(s, j)["h"] == a["h"], F.lit(False))
            marked = F.filter(s, lambda a, j: same(a, j - 1) | same(a, j + 1))
            return let(F.array_sort(F.transform(marked, lambda a: a["i"])), lambda p: F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(p, j + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x))

        return let(placed, twice)

    return F.when(F.size(word_array) <= window, F.lit(0)).otherwise(
        let(hashes, lambda h: let(windows(h), lambda win: F.when(F.size(F.array_distinct(win)) == F.size(win), F.lit(0)).otherwise(covered(win))))
    )


def measured(docs: DataFrame, keep: list[str], *, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with the measures n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines (long) and base_failed."""
    text = F.coalesce(F.col("text__"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    src = docs.select(*keep, F.col(text_col).alias("text__")).select(
        *keep, F.length(F.regexp_replace(text, SPACE + "+", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("d")))[0].alias("l__"),
        F.transform(F.array(words(text)), lambda w: F.struct(F.size(w).cast("long").alias("n"), n_repeat_words(w).cast("long").alias("r")))[0].alias("w__"),
    )
    n, r = F.col("w__.n"), F.col("w__.r")
    rows = src.select(*keep, n.alias("n_words"), "word_chars", "n_symbols", F.col("l__.d").alias("n_dup_lines"), r.alias("n_repeat_words"), F.col("l__.n").alias("n_lines"))
    return rows.withColumn("base_failed", F.expr(" or ".join(RULES[k] for k in BASE)))


def _prior(hosts: DataFrame) -> DataFrame:
    """One row: m_, v_ (mean and variance of the hosts' rates) and s_ (strength of the beta prior with these moments) of every rule."""
    moments = hosts.agg(*[f(F.col(f"x_{k}") / F.col("n_docs")).alias(f"{n}_{k}") for k in RULES for n, f in (("m", F.avg), ("v", F.var_pop))])
    # Strength = mean (1 - mean) / variance - 1, at least 1; without spread the prior rules.
    return moments.select("*", *[F.expr(f"case when v_{k} > 1e-12 then greatest(1.0D, m_{k} * (1 - m_{k}) / v_{k} - 1) else 1e6D end").alias(f"s_{k}") for k in RULES])


def _verdict(rate: str, n: str, k: str) -> tuple[str, str]:
    """SQL for suspect and rejected by rule ``k``."""
    deviation = f"sqrt({rate} * (1 - {rate}) / ({n} + s_{k} + 1))"
    far = f"{rate} - 3 * {deviation} > m_{k} + sqrt(v_{k}) + 1e-9 and {rate} > 2 * m_{k} and {rate} >= {HOST_LEAST}"
    return f"({rate} - {deviation} > m_{k} + 1e-9)", f"({far})"


def host_verdicts(rows: DataFrame, host: Column) -> DataFrame:
    """Measured rows -> host, n_docs, rejected, and of every rule rate_ (shrunk) and suspect_."""
    hosts = rows.groupBy(host.alias("host")).agg(F.count("*").alias("n_docs"), *[F.sum(F.expr(f"cast({rule} as int)")).alias(f"x_{k}") for k, rule in RULES.items()])
    rated = hosts.join(F.broadcast(_prior(hosts))).select("*", *[F.expr(f"(x_{k} + m_{k} * s_{k}) / (n_docs + s_{k})").alias(f"rate_{k}") for k in RULES])
    verdicts = {k: _verdict(f"rate_{k}", "n_docs", k) for k in RULES}
    return rated.select("host", "n_docs", F.expr(" or ".join(v[1] for v in verdicts.values())).alias("rejected"), *[f"rate_{k}" for k in RULES], *[F.expr(v[0]).alias(f"suspect_{k}") for k, v in verdicts.items()])


def with_verdicts(docs: DataFrame, keep: list[str], *, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Every document's measures and ``kept``: false if its own rules fail, else its host's verdict. The measures are written once, as two passes read them.

    Columns in ``keep`` with a name of the measures or the verdict have to be renamed first.
    """
    clear_of(keep, "host__", "h__", "l__", "w__", "rejected", "kept", "base_failed", "host", *_MEASURES, *[f"suspect_{k}" for k in RULES])
    rows = materialise(measured(docs.withColumn("host__", F.col(host_col).cast("string")), [*keep, "host__"], text_col=text_col), "measures")
    return judge(rows, keep)


def judge(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Measured rows (with host__) and their verdict. The hosts' verdicts are written first: their true size decides how they meet the rows."""
    hosts = materialise(host_verdicts(rows, F.col("host__")), "hosts").select(F.col("host").alias("h__"), "rejected", *[f"suspect_{k}" for k in RULES])
    joined = rows.join(hosts, F.col("host__").eqNullSafe(F.col("h__")), "left")
    doubted = " or ".join(f"(suspect_{k} and {rule})" for k, rule in RULES.items())
    return joined.select(*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "base_failed", F.expr(f"not (base_failed or rejected or {doubted})").alias("kept"))


def document_rules(docs: DataFrame) -> DataFrame:
    """The digest columns of every document."""
    return with_verdicts(docs, ["doc_id"])


def oracle_sql() -> str:
    """DuckDB SQL for ``document_rules``."""
    verdicts = {k: _verdict(f"rate_{k}", "n_docs", k) for k in RULES}
    return rf"""
WITH base AS (
  SELECT doc_id, source, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM base)),
dup AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
cov AS (SELECT doc_id, sum(least({WINDOW}, coalesce(nxt - i, {WINDOW}))) AS r FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM dup) GROUP BY doc_id),
f AS (
  SELECT b.doc_id, b.source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{_SYMBOLS}', '')))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(r, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines
  FROM base b LEFT JOIN cov USING (doc_id)),
g AS (SELECT *, ({" OR ".join(RULES[k] for k in BASE)}) AS base_failed FROM f),
h AS (SELECT source, count(*) AS n_docs, {", ".join(f"count(*) FILTER ({rule}) AS x_{k}" for k, rule in RULES.items())} FROM g GROUP BY source),
q AS (SELECT {", ".join(f"avg(x_{k} / n_docs) AS m_{k}, var_pop(x_{k} / n_docs) AS v_{k}" for k in RULES)} FROM h),
p AS (SELECT *, {", ".join(f"CASE WHEN v_{k} > 1e-12 THEN greatest(1.0::DOUBLE, m_{k} * (1 - m_{k}) / v_{k} - 1) ELSE 1e6::DOUBLE END AS s_{k}" for k in RULES)} FROM q),
r AS (SELECT *, {", ".join(f"(x_{k} + m_{k} * s_{k}) / (n_docs + s_{k}) AS rate_{k}" for k in RULES)} FROM h, p),
k AS (SELECT source, {" OR ".join(v[1] for v in verdicts.values())} AS rejected, {", ".join(f"{v[0]} AS suspect_{k}" for k, v in verdicts.items())} FROM r)
SELECT g.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed,
       NOT (base_failed OR rejected OR {" OR ".join(f"(suspect_{k} AND {rule})" for k, rule in RULES.items())}) AS kept
FROM g JOIN k ON g.source IS NOT DISTINCT FROM k.source"""
