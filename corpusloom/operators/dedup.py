"""Duplicate detection and matching against an inventory, as joins instead of per-row look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import normalize as N
from corpusloom.functions.similarity import letter_counts, overlap_size, ratio_bound, sequence_ratio, share_of
from corpusloom.operators.sized import small, spread
from corpusloom.workspace import materialise


def keyed_index(df: DataFrame, key: Column, id_col: str, order: str) -> DataFrame:
    """(key, id): the last row of a key in ``order``."""
    return df.withColumn("k__", key).where(F.coalesce(F.col("k__"), F.lit("")) != "").groupBy(F.col("k__").alias("key")).agg(F.max_by(id_col, order).alias(id_col))


#: From so many titles on, a term is never a key of a shuffle unless a title is looked up by it.
WIDESPREAD = 10_000


def _bonus_of(n: Column, other: Column) -> Column:
    return 0.1 * F.least(n, other, F.lit(3))


def _lookup(a: DataFrame, b: DataFrame, *, least_shared: int, least: float | None = None) -> DataFrame:
    """(new_id, known_id) of ``a`` (new_id, t) and ``b`` (known_id, k) that share one of the rarest terms of t; k without repeats.

    With ``least``, both have the length of their key and the number of surnames (la, na; lb, nb), and pairs whose lengths rule the score out are left out.
    """
    ours, theirs = (("la", "na"), ("lb", "nb")) if least is not None else ((), ())
    asked, held = a.select("new_id", F.explode("t").alias("term"), *ours), b.select("known_id", F.explode("k").alias("term"), *theirs)
    count = asked.select("term", F.lit(0).alias("n"), F.lit(1).alias("m")).unionAll(held.select("term", F.lit(1), F.lit(0))).groupBy("term").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))
    count = materialise(count.where("m > 0"), "terms")
    wide = count.where(F.greatest("n", "m") > WIDESPREAD).select("term", F.col("n").alias("wide"))
    found = asked.join(small(wide), "term", "left")
    narrow = found.where("wide is null").drop("wide").join(count.where(F.greatest("n", "m") <= WIDESPREAD).select("term", "n"), "term")
    known = narrow.unionByName(found.where("wide is not null").withColumnRenamed("wide", "n"))
    order = F.array_sort(F.collect_list(F.struct("n", "term")))  # a title's own terms, five at most
    rare = known.groupBy("new_id", *ours).agg(order.alias("o"))
    rare = rare.select("new_id", *ours, F.explode(F.slice("o", F.lit(1), F.greatest(F.size("o") - (least_shared - 1), F.lit(1)))).alias("x")).select("new_id", *ours, F.col("x.term").alias("term"))
    rare = materialise(rare, "rare")
    unused = wide.select("term").join(rare.join(small(wide.select("term")), "term", "left_semi").select("term").distinct(), "term", "left_anti")
    met = rare.join(held.join(small(unused), "term", "left_anti"), "term")
    if least is not None:
        met = met.where(2.0 * F.least("la", "lb") / (F.col("la") + F.col("lb")) + _bonus_of(F.col("na"), F.col("nb")) >= least - 1e-9)
    return met.select("new_id", "known_id").distinct()


def _sharing(pairs: DataFrame, a: DataFrame, b: DataFrame, *, least_shared: int) -> DataFrame:
    """``pairs`` with ``shared``, how many terms of t stand in k, where that is enough."""
    met = pairs.join(a.select("new_id", "t"), "new_id").join(b.select("known_id", "k"), "known_id").withColumn("shared", F.size(F.array_intersect("t", "k")))
    return met.where(F.col("shared") >= F.least(F.lit(least_shared), F.size("t"))).drop("t", "k")


def _words(key: Column) -> Column:
    return F.array_distinct(F.split(key, " "))


def fuzzy_title_pairs(new: DataFrame, known: DataFrame, *, least_shared: int = 2, others_only: bool = False) -> DataFrame:
    """Pairs that share enough key terms: (new_id, known_id, shared). ``new``: new_id, title; ``known``: known_id, title.

    Two titles that share k of n terms share one of the n - k + 1 rarest, so a title is looked up by these
    alone: its most widespread terms, on which everything would meet, are never a join key. Nothing is capped.
    """
    a = new.select("new_id", N.key_terms(F.col("title")).alias("t")).where(F.size("t") > 0)
    b = known.select("known_id", _words(N.title_key(F.col("title"))).alias("k"))
    met = _lookup(a, b, least_shared=least_shared)
    met = met.where(F.col("new_id") != F.col("known_id")) if others_only else met
    return _sharing(met, a, b, least_shared=least_shared).select("new_id", "known_id", "shared")


def _classes(df: DataFrame, i: str, keep: str, *fields: str) -> tuple[DataFrame, DataFrame]:
    """(c, id) of the rows to ``keep``, and their classes (n, c, fields, first, second): rows with the same ``fields`` are one class, n numbers the classes.

    ``first`` and ``second`` are the two smallest ids of a class (no second: null). A hot class is two rows of a task.
    ``keep`` is asked of written rows: Spark would move it, and the making of the fields, in front of an exchange.
    """
    rows = materialise(df.withColumn("c", F.sha2(F.to_json(F.struct(*fields)), 256)), "titles").where(keep)
    nth = F.dense_rank().over(Window.partitionBy("c").orderBy("i"))
    ids = rows.select("c", F.col(i).alias("i")).withColumn("nth", nth).where("nth <= 2").groupBy("c").agg(F.min("i").alias("first"), F.max("i").alias("second"))
    each = rows.groupBy("c").agg(*[F.any_value(f).alias(f) for f in fields]).join(ids.withColumn("second", F.expr("nullif(second, first)")), "c")
    return rows.select("c", i), materialise(each.withColumn("n", F.monotonically_increasing_id()), "classes")


def fuzzy_title_matches(new: DataFrame, known: DataFrame, *, others_only: bool = False) -> DataFrame:
    """Best fuzzy match of each new title: 0.95 counts as is, 0.85 at 0.9 of its score; shared surnames add 0.1 each, up to 3.

    Both sides: id, title, authors. Ties: more shared terms, then the smaller id. ``others_only``: never the row with its own id.
    Titles of equal key, surnames and terms are compared once, however many rows have them; of known ones the two
    smallest ids can be an answer, the second where the first is the asking row itself. Titles are dealt out before
    their keys are made: a small file is one task, which would have to sort all of them.
    """
    new, known = spread(new.select("new_id", "title", "authors"), "new_id"), spread(known.select("known_id", "title", "authors"), "known_id")
    key, names, count = N.title_key(F.col("title")), N.surnames(F.col("authors")), lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0))
    asking, a = _classes(new.select("new_id", key.alias("a"), names.alias("aa"), N.key_terms(F.col("title")).alias("t")), "new_id", "size(t) > 0", "a", "aa", "t")
    _, b = _classes(known.select("known_id", key.alias("b"), names.alias("ba")), "known_id", "b <> ''", "b", "ba")
    ours = a.select(F.col("n").alias("new_id"), "a", "aa", "t", F.length("a").alias("la"), count("aa").alias("na"))
    theirs = b.select(F.col("n").alias("known_id"), "b", "ba", _words(F.col("b")).alias("k"), F.length("b").alias("lb"), count("ba").alias("nb"))
    met = materialise(_lookup(ours, theirs, least_shared=2, least=0.85), "met")
    scored = aligned_pairs(_sharing(_open(met, ours, theirs, least=0.85), ours, theirs, least_shared=2)).where("score >= 0.85")
    ids = F.array_compact(F.array("first", "second")) if others_only else F.array("first")
    found = scored.join(b.select(F.col("n").alias("known_id"), ids.alias("ids")), "known_id").select("new_id", "score", "shared", F.explode("ids").alias("id"))
    found = materialise(found.select(F.col("new_id").alias("n"), F.struct((-F.col("score")).alias("s"), (-F.col("shared")).alias("h"), F.col("id").alias("i")).alias("e")), "found")
    best = found.groupBy("n").agg(F.min("e").alias("m"))
    rows = asking.join(a.select("c", "n").join(best, "n"), "c")
    if others_only:
        other = found.join(best, "n").where("e.i <> m.i").groupBy("n").agg(F.min("e").alias("o"))
        rows = rows.join(other, "n", "left").withColumn("m", F.when(F.col("new_id") == F.col("m.i"), F.col("o")).otherwise(F.col("m"))).where("m is not null")
    rows = rows.groupBy("new_id").agg(F.min("m").alias("m"))
    score = -F.col("m.s")
    return rows.select("new_id", F.col("m.i").alias("known_id"), F.lit("title_fuzzy").alias("match_type"), F.when(score >= 0.95, score).otherwise(score * 0.9).alias("confidence"))


def open_pairs(pairs: DataFrame, new: DataFrame, known: DataFrame, *, least: float = 0.85) -> DataFrame:
    """(new_id, known_id, shared, a, b, bonus): the pairs whose title keys a and b can still score ``least``, by the characters they share."""
    side = lambda d, i, key, names: d.select(i, N.title_key(F.col("title")).alias(key), N.surnames(F.col("authors")).alias(names))
    return _open(pairs, side(new, "new_id", "a", "aa"), side(known, "known_id", "b", "ba"), least=least).select("new_id", "known_id", "shared", "a", "b", "bonus")


def _open(pairs: DataFrame, new: DataFrame, known: DataFrame, *, least: float) -> DataFrame:
    """``pairs`` with a, b and bonus, those that the letters of a and b leave open. Letters are counted once a title, of titles in ``pairs`` alone; texts come to pairs that are left."""
    side = lambda d, i, key, names: d.join(pairs.select(i).distinct(), i, "left_semi").select(i, F.length(key).alias(f"{key}_l"), letter_counts(F.col(key)).alias(f"{key}_n"), names)
    met = pairs.join(side(new, "new_id", "a", "aa"), "new_id").join(side(known, "known_id", "b", "ba"), "known_id")
    met = met.withColumn("bonus", 0.1 * F.least(F.coalesce(overlap_size(F.col("aa"), F.col("ba")), F.lit(0)), F.lit(3)))
    bound = ratio_bound(F.col("a_n"), F.col("b_n"), F.col("a_l"), F.col("b_l"))
    left = met.where(bound + F.col("bonus") >= least - 1e-9).select(*pairs.columns, "bonus")
    return left.join(new.select("new_id", "a"), "new_id").join(known.select("known_id", "b"), "known_id")


def aligned_pairs(pairs: DataFrame) -> DataFrame:
    """(new_id, known_id, shared, score): every two different keys are aligned once, however many titles have them; equal ones need no alignment."""
    pairs = materialise(pairs, "open-pairs")
    apart = pairs.where("a <> b")
    ratios = materialise(spread(apart.select("a", "b").distinct(), each=50).withColumn("ratio", sequence_ratio(F.col("a"), F.col("b"))), "ratios")
    scored = apart.join(ratios, ["a", "b"]).unionByName(pairs.where("a = b").withColumn("ratio", F.lit(1.0)))
    return scored.select("new_id", "known_id", "shared", (F.col("ratio") + F.col("bonus")).alias("score"))


def author_title_matches(new: DataFrame, known: DataFrame) -> DataFrame:
    """Short titles (under 50 characters) by authors (half of them shared) and key terms (0.4 shared).

    A match shares a surname and a term, so both together are the join key: neither a common name nor a common word meets everything.
    """
    a = new.where(F.length("title") < 50).select("new_id", N.surnames(F.col("authors")).alias("aa"), N.key_terms(F.col("title")).alias("at"))
    b = known.select("known_id", N.surnames(F.col("authors")).alias("ba"), N.key_terms(F.col("title")).alias("bt"))
    keys = lambda i, s, t: lambda d: d.select(i, F.explode(s).alias("s"), t).select(i, "s", F.explode(t).alias("t"))
    met = a.transform(keys("new_id", "aa", "at")).join(b.transform(keys("known_id", "ba", "bt")), ["s", "t"]).select("new_id", "known_id").distinct()
    by_author, by_term = share_of(F.col("aa"), F.col("ba")), share_of(F.col("at"), F.col("bt"))
    scored = met.join(a, "new_id").join(b, "known_id").where((by_author >= 0.5) & (by_term >= 0.4)).select("new_id", "known_id", (0.7 * (by_author + by_term) / 2).alias("confidence"))
    best = scored.groupBy("new_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("known_id").alias("i"))).alias("m"))
    return best.select("new_id", F.col("m.i").alias("known_id"), F.lit("author_title").alias("match_type"), (-F.col("m.c")).alias("confidence"))


def check_duplicates(new: DataFrame, known: DataFrame) -> DataFrame:
    """The cascade DOI, equal title key, fuzzy title, author and title; the first tier that matches decides.

    Both sides: id, doi, title, authors; ``known`` also ``seq``, its arrival. Returns new_id, known_id (null: new),
    match_type, confidence. Both are dealt out and written with their keys first, so that no sort works keys out again
    and what made the rows (a parsed file name) is done once. Rows without a key have one of their own, which nothing meets:
    nulls would all be one task's.
    """
    keyed = lambda d, i, *more: spread(d.select(i, "doi", "title", "authors", *more), i).select("*", F.lower("doi").alias("d"), N.title_key(F.col("title")).alias("t"))
    new, known = materialise(keyed(new, "new_id"), "new"), materialise(keyed(known, "known_id", "seq"), "known")
    held = lambda c: F.concat(F.lit("k"), c)
    asked = lambda c: F.when(F.coalesce(c, F.lit("")) != "", held(c)).otherwise(F.concat(F.lit("n"), F.coalesce(F.col("new_id").cast("string"), F.lit(""))))
    doi = keyed_index(known, F.col("d"), "known_id", "seq").select(held("key").alias("d__"), F.col("known_id").alias("by_doi"))
    title = keyed_index(known, F.col("t"), "known_id", "seq").select(held("key").alias("t__"), F.col("known_id").alias("by_title"))
    exact = new.select("new_id", "title", "authors", asked(F.col("d")).alias("d__"), asked(F.col("t")).alias("t__")).join(doi, "d__", "left").join(title, "t__", "left")
    tier = lambda i, kind, c: F.when(i.isNotNull(), F.struct(i.alias("known_id"), F.lit(kind).alias("match_type"), F.lit(c).alias("confidence")))
    exact = exact.select("new_id", "title", "authors", F.coalesce(tier(F.col("by_doi"), "doi", 1.0), tier(F.col("by_title"), "title_exact", 0.95)).alias("m"))
    exact = materialise(exact, "exact")
    open_ = exact.where("m is null").drop("m")
    if open_.isEmpty():
        return exact.select("new_id", "m.*")
    fuzzy = materialise(fuzzy_title_matches(open_, known), "fuzzy")
    author = author_title_matches(open_.join(fuzzy, "new_id", "left_anti"), known)
    rest = open_.select("new_id").join(fuzzy.unionByName(author), "new_id", "left")
    return exact.where("m is not null").select("new_id", "m.*").unionByName(rest)


def inventory(registry: DataFrame, superseded: DataFrame, canonical: DataFrame, titles: DataFrame) -> DataFrame:
    """Current inventory rows: canonical where flags exist, else the registry without superseded rows; authoritative titles first."""
    flagged = canonical.where("is_canonical").select("paper_id")
    current = registry.join(superseded.select(F.col("superseded_paper_id").alias("paper_id")), "paper_id", "left_anti")
    current = current.join(flagged, "paper_id", "left_semi") if not canonical.isEmpty() else current
    t = titles.select(F.col("paper_id").alias("p__"), "title_authoritative", F.col("publication_year").alias("y__"), F.col("doi").alias("d__"))
    return current.join(t, F.col("paper_id") == F.col("p__"), "left").select("paper_id", F.coalesce("title_authoritative", "title").alias("title"), F.coalesce("year", "y__").alias("year"), F.coalesce(N.blank_to_null(F.col("doi")), "d__").alias("doi"))


def _inventory_keys(inv: DataFrame) -> DataFrame:
    return inv.select("paper_id", N.doi_inventory(F.col("doi")).alias("d"), N.inventory_key(F.col("title")).alias("t"), "year")


def match_inventory(papers: DataFrame, inv: DataFrame) -> DataFrame:
    """matched, ambiguous or unmatched, on DOI (1.0), title and year (0.98) or title (0.95); more than one candidate is ambiguous.

    ``papers``: paper_id, doi, title, year. The first basis with a candidate decides. A key keeps the number and the
    first of its papers, so that a title thousands share is one row; ``candidate_pairs`` lists them all.
    """
    rows = _inventory_keys(inv).distinct()
    ids = [F.countDistinct("paper_id").alias("n"), F.min("paper_id").alias("first")]
    both = lambda *by: F.struct("n", "first").alias(by[-1])
    by_doi = rows.where("d <> ''").groupBy(F.col("d").alias("d__")).agg(*ids).select("d__", both("c1"))
    by_both = rows.where("t <> '' and year is not null").groupBy(F.col("t").alias("t__"), F.col("year").alias("y__")).agg(*ids).select("t__", "y__", both("c2"))
    by_title = rows.where("t <> ''").groupBy(F.col("t").alias("u__")).agg(*ids).select("u__", both("c3"))
    p = _inventory_keys(papers)
    joined = p.join(by_doi, F.col("d") == F.col("d__"), "left").join(by_both, (F.col("t") == F.col("t__")) & (F.col("year") == F.col("y__")), "left").join(by_title, F.col("t") == F.col("u__"), "left")
    found = F.coalesce("c1", "c2", "c3")
    basis = F.when(F.col("c1").isNotNull(), "exact_doi").when(F.col("c2").isNotNull(), "exact_title_year").when(F.col("c3").isNotNull(), "exact_title").otherwise("none")
    n = F.coalesce(found["n"], F.lit(0))
    sure = F.when(basis == "exact_doi", 1.0).when(basis == "exact_title_year", 0.98).otherwise(0.95)
    return joined.select("paper_id", F.when(n == 1, "matched").when(n > 1, "ambiguous").otherwise("unmatched").alias("match_status"), basis.alias("match_basis"), F.when(n == 1, found["first"]).alias("match_paper_id"), F.when(n == 1, sure).alias("match_confidence"), n.alias("n_candidates"))


def candidate_pairs(papers: DataFrame, inv: DataFrame, matches: DataFrame) -> DataFrame:
    """(paper_id, candidate): all candidates of every matched or ambiguous paper, a row each, by the basis that decided."""
    rows = _inventory_keys(inv).withColumnRenamed("paper_id", "candidate")
    p = _inventory_keys(papers).join(matches.select("paper_id", "match_basis"), "paper_id")
    parts = [p.where(F.col("match_basis") == basis).join(rows, keys).select("paper_id", "candidate") for basis, keys in (("exact_doi", ["d"]), ("exact_title_year", ["t", "year"]), ("exact_title", ["t"]))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).distinct()


def match_counters(matches: DataFrame) -> DataFrame:
    """One row of conditional counts over status and basis."""
    n = lambda c, name: F.count_if(c).alias(name)
    s, b = F.col("match_status"), F.col("match_basis")
    return matches.agg(F.count("*").alias("rows_total"), *[n(s == x, x) for x in ("matched", "unmatched", "ambiguous")], *[n((s == "matched") & (b == x), f"matched_{x}") for x in ("exact_doi", "exact_title_year", "exact_title")], n((s == "ambiguous") & (b == "exact_title"), "ambiguous_exact_title"))


def examples(matches: DataFrame, bucket: str, order: str, n: int = 10) -> DataFrame:
    """The first ``n`` rows of every bucket."""
    return matches.withColumn("r__", F.row_number().over(Window.partitionBy(bucket).orderBy(order))).where(F.col("r__") <= n).drop("r__")


def unseen(candidates: DataFrame, known_dois: DataFrame, known_titles: DataFrame) -> DataFrame:
    """Candidates whose DOI and title are both new. ``known_dois``: doi; ``known_titles``: title."""
    d = known_dois.select(F.lower("doi").alias("d__")).distinct()
    t = known_titles.select(N.seen_key(F.col("title")).alias("t__")).where("t__ <> ''").distinct()
    return candidates.join(d, F.lower("doi") == F.col("d__"), "left_anti").join(t, N.seen_key(F.col("title")) == F.col("t__"), "left_anti")


def first_by_doi(results: DataFrame, order: str) -> DataFrame:
    """The first result of every DOI; results without one all stay."""
    w = Window.partitionBy(F.coalesce(F.lower("doi"), F.concat(F.lit("row:"), F.col(order).cast("string")))).orderBy(order)
    return results.withColumn("r__", F.row_number().over(w)).where("r__ = 1").drop("r__")


def conflict_winner(df: DataFrame, group: str, score: str, id_col: str, *, least: float = 0.45, gap: float = 0.08) -> DataFrame:
    """Of rows that share ``group``: keep the best if it reaches ``least`` and leads by ``gap`` (or the group has two); else keep none."""
    shared = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("members"), F.max(F.struct(score, id_col)).alias("best")).where("members > 1")
    second = df.join(shared, group).where(F.col(id_col) != F.col(f"best.{id_col}")).groupBy(group).agg(F.max(score).alias("second"))
    lead = F.col(f"best.{score}") - F.coalesce("second", F.lit(0.0))
    return shared.join(second, group, "left").select(group, "members", F.when((F.col(f"best.{score}") >= least) & ((lead >= gap) | (F.col("members") == 2)), F.col(f"best.{id_col}")).alias("keep_id"))
