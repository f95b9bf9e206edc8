"""A text index that answers substring queries exactly.

Texts are lower-cased and cut at every space, so a phrase stands in a text as a substring if and only if consecutive tokens
match its pieces: the first ends with its first piece, the last begins with its last, those between are equal (a phrase
of one piece: a token contains it). ``postings`` has a row for every distinct token of every field, with the sides on which the
token has neighbours; it is written where the texts are read, without a shuffle, each file sorted by token, so that a widespread
token lies in all files and row groups are skipped by token. ``vocabulary`` has each distinct token once.

A query meets the vocabulary by equality of substrings of the lengths it asks for, then the postings of its rarest piece alone: a
phrase of one piece is answered by them; of the others only the texts that have the rarest piece are read and compared, so no
widespread piece is ever looked up. Phrases that must all stand in a text are one query, so none of them is looked up by itself.

Defined results: null fields are not indexed; rows with one id count as one; a phrase that is null, empty or
of spaces alone finds nothing. An empty table gives an empty index.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.sized import small
from corpusloom.workspace import materialise

#: Tokens up to this number are pushed into the scan of the postings, so that row groups are skipped.
PUSHED = 512
#: Bits of ``sides``: the token stands in the field; behind another; before another; between two.
STANDS, BEHIND, BEFORE, BETWEEN = 1, 2, 4, 8


@dataclass
class TextIndex:
    postings: DataFrame  # token, id, sides; a token at a field's end may have a second row
    vocabulary: DataFrame  # token, rows (of postings)
    texts: DataFrame  # id, fields (lower-cased): what was indexed


def build(df: DataFrame, *, id_col: str, fields: list[str]) -> TextIndex:
    """Index ``fields`` of ``df``."""
    texts = df.select(F.col(id_col).alias("id"), F.array(*[F.lower(c) for c in fields]).alias("fields"))
    cut = texts.select("id", F.explode("fields").alias("text")).where(F.col("text").isNotNull()).select("id", F.split("text", " ", -1).alias("w"))
    at = lambda token, sides: F.struct(token.alias("token"), F.lit(sides).alias("sides"))
    n, first, last = F.size("w"), F.element_at("w", 1), F.element_at("w", -1)
    inner = F.transform(F.array_distinct(F.slice("w", F.lit(2), n - 2)), lambda t: at(t, STANDS | BEHIND | BEFORE | BETWEEN))
    held = F.when(n == 1, F.array(at(first, STANDS))).otherwise(F.concat(inner, F.array(at(first, STANDS | BEFORE), at(last, STANDS | BEHIND))))
    tokens = cut.select("id", F.explode(held).alias("t")).select("t.token", "id", "t.sides")
    postings = materialise(tokens.sortWithinPartitions("token", "id"), "postings")
    return TextIndex(postings, materialise(postings.groupBy("token").agg(F.count("*").alias("rows")), "vocabulary"), texts)


def _pieces(queries: DataFrame) -> DataFrame:
    """(q, last, n, i, kind, piece): the pieces of each query's phrases that are not empty, or stand between others; n counts them all.

    A query of a phrase that is null or blank has none. Pieces in the middle of a token are left out where a query has others.
    """
    asked = queries.where(F.forall("phrases", lambda p: F.coalesce(F.trim(p) != "", F.lit(False)))).select("q", F.posexplode("phrases").alias("of", "p"))
    cut = asked.select("q", "of", F.split(F.lower("p"), " ", -1).alias("w")).withColumn("last", F.size("w") - 1).select("q", "of", "last", F.posexplode("w").alias("i", "piece"))
    kind = F.when(F.col("last") == 0, "in").when(F.col("i") == 0, "end").when(F.col("i") == F.col("last"), "start").otherwise("whole")
    held = cut.withColumn("kind", kind).where((F.col("piece") != "") | (F.col("kind") == "whole"))
    sized = held.groupBy(F.col("q").alias("has")).agg(F.count("*").alias("n"), F.count_if(F.col("kind") != "in").alias("sided"))
    return held.join(sized, F.col("q") == F.col("has")).where("kind <> 'in' or sided = 0").drop("has", "of", "sided")


def _lengths(pieces: DataFrame, kind: str) -> list[int]:
    """The lengths of pieces of a kind: distinct numbers, as few as words have letters."""
    return sorted(r[0] for r in pieces.where(F.col("kind") == kind).select(F.length("piece")).distinct().collect())


def matching_tokens(index: TextIndex, pieces: DataFrame) -> DataFrame:
    """(kind, piece, token, rows): the tokens of the vocabulary that match a piece, by equality of the parts of a token that are as long. One pass for all ends, another for middles if any are asked for."""
    token = F.col("token")
    ends = [F.struct(F.lit(kind).alias("kind"), F.lit(n).alias("n")) for kind in ("end", "start") for n in _lengths(pieces, kind)]
    cut = index.vocabulary.select("token", "rows", F.explode(F.array(*ends, F.struct(F.lit("whole").alias("kind"), F.lit(0).alias("n")))).alias("x")).select("token", "rows", "x.kind", "x.n").where(F.length("token") >= F.col("n"))
    part = F.when(F.col("kind") == "end", F.right(token, F.col("n"))).when(F.col("kind") == "start", F.left(token, F.col("n"))).otherwise(token)
    all_parts = cut.select("kind", part.alias("piece"), "token", "rows")
    for n in _lengths(pieces, "in"):
        long = index.vocabulary.where(F.length("token") >= n)
        inner = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("token") - n + 1), lambda k: F.substr(token, k, F.lit(n)))))  # noqa: B023
        all_parts = all_parts.unionAll(long.select(F.lit("in").alias("kind"), inner.alias("piece"), "token", "rows"))
    return all_parts.join(small(pieces.select("kind", "piece").distinct()), ["kind", "piece"])


def find(index: TextIndex, queries: DataFrame, *, phrase: str = "phrase") -> DataFrame:
    """(q, id) for every id one of whose fields has the phrase of ``queries`` (q, phrase) as a substring, case ignored."""
    return find_all(index, queries.select("q", F.array(phrase).alias("phrases")))


def find_all(index: TextIndex, queries: DataFrame) -> DataFrame:
    """(q, id) for every id whose fields have all ``phrases`` of ``queries`` (q, phrases), each in one of them: one piece of them all is looked up."""
    pieces = materialise(_pieces(queries), "pieces")
    tokens = materialise(matching_tokens(index, pieces), "tokens")
    spread = tokens.groupBy("kind", "piece").agg(F.sum("rows").alias("rows"))
    behind, before = F.col("i") > 0, F.col("i") < F.col("last")
    sides = F.when(behind & before, BETWEEN).when(behind, BEHIND).when(before, BEFORE).otherwise(STANDS)
    ranked = pieces.join(spread, ["kind", "piece"], "left").select("q", F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), "i", "kind", "piece", sides.alias("need"), "n").alias("p"))
    anchors = materialise(ranked.groupBy("q").agg(F.min("p").alias("p")).select("q", "p.kind", "p.piece", "p.need", "p.n"), "anchors")
    wanted = materialise(tokens.join(anchors, ["kind", "piece"]).select("token", "q", "need", "n").distinct(), "wanted")
    few = [r[0] for r in wanted.select("token").distinct().limit(PUSHED + 1).collect()]
    postings = index.postings.where(F.col("token").isin(few)) if len(few) <= PUSHED else index.postings
    met = postings.join(small(wanted), "token").where(F.col("sides").bitwiseAND(F.col("need")) != 0)
    single = met.where("n = 1").select("q", "id").distinct()
    return single.unionAll(_holding(index, met.where("n > 1").select("q", "id").distinct(), queries))


def _holding(index: TextIndex, candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """The candidates (q, id) whose texts have all phrases of q. Texts meet their candidates by id, so each is moved once at most."""
    asked = queries.select(F.col("q").alias("of"), F.transform("phrases", F.lower).alias("ps"))
    near = small(materialise(candidates, "candidates")).withColumnRenamed("id", "c__")
    met = index.texts.join(near, F.col("id").eqNullSafe(F.col("c__"))).join(small(asked), F.col("q") == F.col("of"))
    return met.where(F.forall("ps", lambda p: F.exists("fields", lambda f: F.coalesce(F.contains(f, p), F.lit(False))))).select("q", "id").distinct()


def counts(found: DataFrame, queries: DataFrame) -> DataFrame:
    """(q, n): how many ids each query has found, 0 included."""
    n = found.groupBy("q").agg(F.count("*").alias("n"))
    return queries.select("q").join(n, "q", "left").select("q", F.coalesce("n", F.lit(0)).alias("n"))


def keyword_search(df: DataFrame, index: TextIndex, text: str | None, *, id_col: str, where: Column | None = None, order: list[Column], limit: int = 100) -> DataFrame:
    """Rows of ``df`` whose indexed fields have ``text`` as a substring (all rows without a text) and that pass ``where``; the first ``limit`` in ``order``."""
    rows = df.where(where) if where is not None else df
    if text:
        one = df.sparkSession.createDataFrame([(0, text)], "q long, phrase string")
        rows = rows.join(find(index, one).select(F.col("id").alias("found__")), F.col(id_col) == F.col("found__"), "left_semi")
    return rows.orderBy(*order).limit(limit)


def node_term(node_id: Column) -> Column:
    """What a node is looked for by: the last part of its id, with spaces for underlines."""
    return F.replace(F.element_at(F.split(node_id, r"\."), -1), F.lit("_"), F.lit(" "))


def theory_counts(scored: DataFrame, index: TextIndex) -> DataFrame:
    """``scored`` (node_id, paper_count) with the count by text where no paper is scored."""
    none = scored.where("paper_count = 0").select("node_id").distinct()
    terms = materialise(none.select(F.col("node_id").alias("q"), node_term(F.col("node_id")).alias("phrase")), "terms")
    by_text = counts(find(index, terms), terms).select(F.col("q").alias("node_id"), "n")
    return scored.join(by_text, "node_id", "left").withColumn("paper_count", F.coalesce("n", "paper_count")).drop("n")


def cell_counts(scored: DataFrame, index: TextIndex) -> DataFrame:
    """``scored`` (factor_id, outcome_id, paper_count) with the papers that have both terms where none is scored."""
    none = materialise(scored.where("paper_count = 0").select("factor_id", "outcome_id").distinct(), "cells")
    key = F.to_json(F.struct("factor_id", "outcome_id"))
    found = find_all(index, none.select(key.alias("q"), F.array(node_term(F.col("factor_id")), node_term(F.col("outcome_id"))).alias("phrases")))
    both = none.withColumn("q", key).join(found.groupBy("q").agg(F.count("*").alias("n")), "q").drop("q")
    return scored.join(both, ["factor_id", "outcome_id"], "left").withColumn("paper_count", F.coalesce("n", "paper_count")).drop("n")
