"""The query catalogue: every operator family applied to the driver's tables, with DuckDB SQL where SQL can say it.

Thresholds are those that these tables call for; the operators' own defaults are in their modules.
Sums of doubles are rounded on both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import normalize as N
from corpusloom.functions import parse as P
from corpusloom.functions import similarity as SIM
from corpusloom.operators import audit, dedup, expansion, gaps, graph, ingest, merge, synthesis, taxonomy, vector, setmatch
from corpusloom.operators import relational as R
from corpusloom.operators.sized import spread
from corpusloom.plans.registry import ORACLE, QUERIES, query
from corpusloom.session import load
from corpusloom.streaming import incremental
from corpusloom.workspace import materialise, scratch

__all__ = ["ORACLE", "QUERIES"]


# ================================================================ scans and the relational core
@query("SELECT p_partkey, p_name, p_size FROM part WHERE contains(lower(p_name), '1') AND p_size BETWEEN 5 AND 40 ORDER BY p_size DESC, p_partkey LIMIT 50")
def scan_filter_topn(spark: SparkSession, sf: str) -> DataFrame:
    return R.search(load(spark, sf, "part"), text_cols=["p_name"], query="1", ranges={"p_size": (5, 40)}, order=[F.desc("p_size"), F.col("p_partkey")], limit=50).select("p_partkey", "p_name", "p_size")


@query("SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' OR o_orderpriority = '1-URGENT'")
def status_or_decision(spark: SparkSession, sf: str) -> DataFrame:
    urgent = load(spark, sf, "orders").withColumn("decision", F.when(F.col("o_orderpriority") == "1-URGENT", "F"))
    return R.by_status(urgent, "F", status_col="o_orderstatus", decision_col="decision").select("o_orderkey", "o_orderstatus", "o_orderpriority")


@query("SELECT c_custkey, c_name, o_totalprice FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice >= 1000 ORDER BY o_totalprice DESC, c_custkey LIMIT 100")
def facet_topk_join(spark: SparkSession, sf: str) -> DataFrame:
    scores = load(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    return R.top_scored(load(spark, sf, "customer").select("c_custkey", "c_name"), scores, "c_custkey", "o_totalprice", 1000.0, 100)


@query("""WITH b AS (SELECT l_orderkey, p_brand FROM lineitem JOIN part ON p_partkey = l_partkey),
m AS (SELECT min(p_brand) AS lo, max(p_brand) AS hi FROM part)
SELECT count(DISTINCT x.l_orderkey) AS n_orders FROM b x JOIN b y USING (l_orderkey), m WHERE x.p_brand = lo AND y.p_brand = hi""")
def cooccurrence_distinct(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part")
    brands = part.agg(F.min("p_brand").alias("lo"), F.max("p_brand").alias("hi"))
    facts = load(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey")).join(part.select("p_partkey", "p_brand"), "p_partkey").join(F.broadcast(brands), how="cross")
    return R.cooccurring(facts, "l_orderkey", F.col("p_brand") == F.col("lo"), F.col("p_brand") == F.col("hi"), "n_orders")


@query("SELECT doc_id, lang, quality, toxic FROM documents LEFT JOIN labels USING (doc_id)")
def left_enrich(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "lang").join(load(spark, sf, "labels"), "doc_id", "left").select("doc_id", "lang", "quality", "toxic")


@query("SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 20 * c.c_acctbal)")
def not_exists_theta(spark: SparkSession, sf: str) -> DataFrame:
    c, o = load(spark, sf, "customer").select("c_custkey", "c_acctbal"), load(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("most"))
    return R.without_match(c, o, (F.col("o_custkey") == F.col("c_custkey")) & (F.col("most") > 20 * F.col("c_acctbal"))).select("c_custkey")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def deleted_anti(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", "source").join(load(spark, sf, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@query("SELECT l_partkey, count(*) AS n, min(l_shipdate) AS first_ship FROM lineitem GROUP BY l_partkey HAVING count(*) >= 20 ORDER BY n DESC, l_partkey LIMIT 100")
def highly_cited_external(spark: SparkSession, sf: str) -> DataFrame:
    return R.frequent(load(spark, sf, "lineitem").withColumnRenamed("l_shipdate", "first_ship"), "l_partkey", least=20, k=100, carry="first_ship")


@query("SELECT coalesce(sum(c), 0)::BIGINT AS excess FROM (SELECT count(*) - 1 AS c FROM documents GROUP BY md5(text) HAVING count(*) > 1)")
def dup_excess_sum(spark: SparkSession, sf: str) -> DataFrame:
    return R.excess(load(spark, sf, "documents"), F.md5("text"))


@query("SELECT count(*) AS n_lines, count(DISTINCT l_suppkey) AS n_suppliers, count(DISTINCT l_partkey) AS n_parts FROM lineitem")
def network_stats(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "lineitem").agg(F.count("*").alias("n_lines"), F.countDistinct("l_suppkey").alias("n_suppliers"), F.countDistinct("l_partkey").alias("n_parts"))


@query("SELECT doc_id FROM labels UNION SELECT doc_id FROM documents WHERE lang = 'en'")
def union_distinct_ids(spark: SparkSession, sf: str) -> DataFrame:
    return R.union_distinct(load(spark, sf, "labels").select("doc_id"), load(spark, sf, "documents").where("lang = 'en'").select("doc_id"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events WHERE (props->>'$.k')::BIGINT > 50")
def json_path_filter(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k")).where("k > 50")


_TYPES = ["click", "purchase", "error", "signup", "view"]


@query("SELECT user_id, " + ", ".join(f"min(value) FILTER (event_type = '{t}') AS {t}" for t in _TYPES) + " FROM events GROUP BY user_id")
def eav_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return R.pivot_attributes(load(spark, sf, "events"), "user_id", "event_type", F.col("value"), _TYPES)


@query("""SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def upsert_latest_wins(spark: SparkSession, sf: str) -> DataFrame:
    return merge.latest_wins(load(spark, sf, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "value", "event_id")


@query("SELECT user_id, count(*) AS n, max(value) AS priority, coalesce(arg_min(event_type, event_id) FILTER (event_id % 2 = 0), arg_min(event_type, event_id)) AS first_type FROM events GROUP BY user_id")
def counting_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select("user_id", F.col("value").alias("priority"), "event_id", F.col("event_type").alias("first_type"))
    half = F.col("event_id") % 2 == 0
    old = e.where(half).groupBy("user_id").agg(F.count("*").alias("n"), F.max("priority").alias("priority"), F.min_by("first_type", "event_id").alias("first_type"))
    return merge.counting_upsert(old, e.where(~half), "user_id", count="n", priority="priority", order="event_id", first=["first_type"])


@query("SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY l_orderkey, l_partkey")
def insert_ignore(spark: SparkSession, sf: str) -> DataFrame:
    new = load(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    had = load(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    current = new.join(had, "l_orderkey", "left_semi")
    return merge.insert_ignore(current, new, ["l_orderkey", "l_partkey"], ["l_linenumber"])


# ================================================================ scalar functions
_STOP = "['" + "','".join(N.TITLE_STOP_WORDS) + "']"
_ASCII_LINE = "regexp_replace(lower(string_split(text, chr(10))[1]), '[^a-z0-9]', ' ', 'g')"


def _first_line() -> Column:
    return F.regexp_replace(F.lower(F.get(F.split("text", "\n"), F.lit(0))), "[^a-z0-9]", " ")


@query(f"SELECT doc_id, array_to_string(list_sort(list_filter(string_split_regex({_ASCII_LINE}, '\\s+'), lambda w: length(w) > 2 AND NOT list_contains({_STOP}, w))), ' ') AS title_key FROM documents")
def title_key_sorted(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", N.title_key(_first_line()).alias("title_key"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(replace(lower(p_type || '_' || p_name), '_', ' '), '-', ' '), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g')) AS name_key FROM part")
def inventory_key(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", N.inventory_key(F.concat_ws("_", "p_type", "p_name")).alias("name_key"))


@query("""WITH b AS (SELECT page_id, rtrim(regexp_replace(regexp_replace(trim(url), '^[A-Za-z]+://', ''), '[?#].*$', ''), '/') AS u FROM pages)
SELECT page_id, regexp_replace(lower(regexp_extract(u, '^([^/]*)', 1)), '^www\\.', '') || regexp_extract(u, '^[^/]*(.*)$', 1) AS url_key FROM b""")
def url_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", N.url_key(F.col("url")).alias("url_key"))


@query(f"""WITH w AS (SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9]', ' ', 'g'), '\\s+'), lambda w: length(w) > 3 AND NOT list_contains({_STOP}, w)) AS ws FROM benchmark),
e AS (SELECT item_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
r AS (SELECT item_id, w, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, i) AS k FROM e)
SELECT item_id, array_to_string(list_sort(list(DISTINCT w)), ' ') AS terms FROM r WHERE k <= 5 GROUP BY item_id""")
def key_terms(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "benchmark").select("item_id", F.array_join(F.array_sort(N.key_terms(F.regexp_replace(F.lower("text"), "[^a-z0-9]", " "))), " ").alias("terms"))


@query("SELECT 'c' || c_custkey AS id, regexp_replace(lower(string_split(c_name, '#')[1]), '[^a-z0-9_-]', '', 'g') AS surname FROM customer UNION ALL SELECT 's' || s_suppkey, regexp_replace(lower(string_split(s_name, '#')[1]), '[^a-z0-9_-]', '', 'g') FROM supplier")
def surname(spark: SparkSession, sf: str) -> DataFrame:
    of = lambda t, k, n: load(spark, sf, t).select(F.concat(F.lit(t[0]), k).alias("id"), N.surname(F.concat(F.get(F.split(n, "#"), F.lit(0)), F.lit(", x"))).alias("surname"))
    return of("customer", "c_custkey", "c_name").unionByName(of("supplier", "s_suppkey", "s_name"))


@query("SELECT doc_id, 'sha256:' || left(sha256(text), 12) AS paper_id, left(md5(text), 12) AS row_hash, 'title:' || sha1(lower(trim(text, ' '))) AS queue_key FROM documents")
def id_hash(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", N.paper_id(F.lit(None).cast("string"), F.col("text")).alias("paper_id"), F.substring(F.md5("text"), 1, 12).alias("row_hash"), F.concat(F.lit("title:"), F.sha1(F.lower(F.trim("text")))).alias("queue_key"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t\\r\\n\\f\\v]+', ' ', 'g'), ' ') AS body FROM pages")
def strip_html(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "pages").select("page_id", N.strip_tags(F.col("html")).alias("body"))


@query("SELECT item_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' ') AS text, len(list_distinct(list_filter(string_split(text, ' '), lambda w: w <> '')))::INT AS n_words FROM benchmark")
def inverted_index_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    b = load(spark, sf, "benchmark").select("item_id", N.to_inverted_index(F.col("text")).alias("i"))
    return b.select("item_id", N.from_inverted_index(F.col("i")).alias("text"), F.size("i").alias("n_words"))


_YEAR_RULES = [r"\(([0-9]{4})\)", r",\s*([0-9]{4})[,.\s]", r"\b(19[0-9]{2}|20[0-2][0-9])\b"]


@query("WITH y AS (SELECT doc_id, " + ", ".join(f"try_cast(regexp_extract(text, '{p}', 1) AS INT) AS y{i}" for i, p in enumerate(_YEAR_RULES)) + " FROM documents) SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN y{i} BETWEEN 1800 AND 2030 THEN y{i} END" for i in range(3)) + ") AS year FROM y")
def year_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "documents").select("doc_id", N.year_in_text(F.col("text")).alias("year"))


@query("""WITH d AS (SELECT p_partkey AS id, CASE p_partkey % 5 WHEN 0 THEN ' https://doi.org/10.1234/P.' || p_partkey || '). ' WHEN 1 THEN 'DOI:10.1234/p.' || p_partkey WHEN 2 THEN 'http://doi.org/10.1234/p.' || p_partkey || ';' WHEN 3 THEN 'see 10.1234/p' || p_partkey || ', p. 3' ELSE 'none' END AS raw FROM part),
i AS (SELECT id, raw, lower(trim(raw)) AS x FROM d)
SELECT id, regexp_replace(trim(regexp_replace(trim(regexp_replace(x, '^https?://doi.org/', '')), '^doi:', '')), '[).,;\\]]+$', '') AS inventory,
CASE WHEN regexp_replace(x, '^(?:https?://(?:dx\\.)?doi\\.org/|doi:)\\s*', '') LIKE '10.%' THEN trim(regexp_replace(x, '^(?:https?://(?:dx\\.)?doi\\.org/|doi:)\\s*', '')) END AS resolver,
nullif(lower(regexp_replace(regexp_extract(raw, '(10\\.[0-9]{4,}/[^\\s\\]>"'']+)', 1), '[.,;:]+$', '')), '') AS in_text FROM i""")
def doi_variants(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    raw = F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit(" https://doi.org/10.1234/P."), k, F.lit("). "))).when(F.col("p_partkey") % 5 == 1, F.concat(F.lit("DOI:10.1234/p."), k)).when(F.col("p_partkey") % 5 == 2, F.concat(F.lit("http://doi.org/10.1234/p."), k, F.lit(";"))).when(F.col("p_partkey") % 5 == 3, F.concat(F.lit("see 10.1234/p"), k, F.lit(", p. 3"))).otherwise("none")
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw")).select("id", N.doi_inventory(F.col("raw")).alias("inventory"), N.doi_resolver(F.col("raw")).alias("resolver"), N.doi_in_text(F.col("raw")).alias("in_text"))


# ================================================================ similarity and matching
_TOK = "list_distinct(list_filter(regexp_extract_all(lower(text), '([a-z0-9]+)', 1), lambda t: length(t) > {least}))"


@query(f"""WITH b AS (SELECT item_id, {_TOK.format(least=2)} AS t FROM benchmark), d AS (SELECT doc_id, {_TOK.format(least=2)} AS t FROM documents),
s AS (SELECT item_id, doc_id, len(list_intersect(b.t, d.t)) / greatest(len(list_distinct(list_concat(b.t, d.t))), 1) AS j FROM b, d)
SELECT item_id, doc_id, round(j, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) AS r FROM s) WHERE r = 1""")
def jaccard_best_match(spark: SparkSession, sf: str) -> DataFrame:
    """The items are the query set, held against all documents, whole: shared tokens are counted, the best pair is scored."""
    b, d = _token_sets(spark, sf)
    best = setmatch.best_jaccard(b, d).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"))
    least = d.agg(F.min("id").alias("least"))  # what shares nothing is as good as the first document
    found = b.select(F.col("q").alias("item_id"), F.col("tokens").alias("bt")).join(best, "item_id", "left").join(F.broadcast(least), how="cross").withColumn("doc_id", F.coalesce("doc_id", "least")).where("doc_id is not null")
    return found.join(d.select(F.col("id").alias("doc_id"), F.col("tokens").alias("dt")), "doc_id").select("item_id", "doc_id", F.round(SIM.jaccard(F.col("bt"), F.col("dt")), 6).alias("score"))


def _token_sets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Items (q, tokens) and documents (id, tokens)."""
    return load(spark, sf, "benchmark").select(F.col("item_id").alias("q"), N.tokens(F.col("text")).alias("tokens")), load(spark, sf, "documents").select(F.col("doc_id").alias("id"), N.tokens(F.col("text")).alias("tokens"))


@query(f"""WITH b AS (SELECT item_id, {_TOK.format(least=2)} AS t FROM benchmark), d AS (SELECT doc_id, {_TOK.format(least=2)} AS t FROM documents),
p AS (SELECT item_id, doc_id, len(list_intersect(b.t, d.t)) AS n, len(b.t) AS nb, len(d.t) AS nd FROM b, d WHERE len(b.t) >= 5 AND len(d.t) >= 5)
SELECT item_id, doc_id, round(n / nb, 6) AS of_item, round(n / nd, 6) AS of_doc FROM p WHERE n / nb >= 0.3 AND n / nd >= 0.3""")
def bidirectional_overlap(spark: SparkSession, sf: str) -> DataFrame:
    b, d = _token_sets(spark, sf)
    near = setmatch.pairs_above(b, d, of_query=0.3 - 1e-6, of_doc=0.3 - 1e-6, least_tokens=5)
    bt, dt = F.col("bt"), F.col("dt")
    met = near.join(b.select("q", F.col("tokens").alias("bt")), "q").join(d.select("id", F.col("tokens").alias("dt")), "id").where(SIM.titles_similar(bt, dt, least=0.3))
    return met.select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), F.round(SIM.share_of(bt, dt), 6).alias("of_item"), F.round(SIM.share_of(dt, bt), 6).alias("of_doc"))


_KEYWORDS = ["tion", "ment", "heit", "ando", "ough", "that", "with", "from", "para", "pour", "nicht", "ering", "able", "ness", "ding", "http"]


@query("SELECT doc_id, round(r, 6) AS relevance, CASE WHEN r >= 0.2 THEN 'on_topic' WHEN n_chars = 0 THEN 'needs_abstract' ELSE 'possibly_off_topic' END AS topic FROM (SELECT doc_id, n_chars, (" + " + ".join(f"contains(lower(text), '{k}')::INT" for k in _KEYWORDS) + f") / {len(_KEYWORDS)} AS r FROM documents)")
def keyword_relevance(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", "n_chars", SIM.keyword_relevance(F.col("text"), _KEYWORDS).alias("r"))
    return d.select("doc_id", F.round("r", 6).alias("relevance"), taxonomy.topic_decision(F.col("r"), F.col("n_chars") > 0, off_topic=0.2).alias("topic"))


@query(f"""WITH b AS (SELECT item_id, {_TOK.format(least=3)} AS t FROM benchmark), d AS (SELECT doc_id, lower(text) AS x FROM documents)
SELECT item_id, doc_id, round(len(list_filter(t, lambda w: contains(x, w))) / len(t), 6) AS score FROM b, d WHERE len(t) > 0 AND len(list_filter(t, lambda w: contains(x, w))) / len(t) >= 0.5""")
def keyword_containment(spark: SparkSession, sf: str) -> DataFrame:
    b = load(spark, sf, "benchmark").select(F.col("item_id").alias("q"), N.tokens(F.col("text"), least=4).alias("tokens"))
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return setmatch.contained_above(b, d, least=0.5).select(F.col("q").alias("item_id"), F.col("id").alias("doc_id"), F.round("share", 6).alias("score"))


@query()
def seqmatch_fuzzy(spark: SparkSession, sf: str) -> DataFrame:
    """Query set: ids divisible by 20, against all other rows; a title is the whole first line."""
    docs = load(spark, sf, "documents").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("title"), F.array("source").alias("authors"))
    found = dedup.fuzzy_title_matches(docs.where("doc_id % 20 = 0").withColumnRenamed("doc_id", "new_id"), docs.withColumnRenamed("doc_id", "known_id"), others_only=True)
    return found.withColumn("confidence", F.round("confidence", 4))


@query("""WITH p AS (SELECT o_custkey AS c, p_brand AS b, sum(l_quantity) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
m AS (SELECT b, w FROM p WHERE c = (SELECT min(c) FROM p)), t AS (SELECT c, sum(w) AS t FROM p GROUP BY c), o AS (SELECT sum(w) AS o FROM m)
SELECT c AS custkey, round(sum(least(p.w, m.w)) / greatest(t, o), 6) AS similarity FROM p JOIN m USING (b) JOIN t USING (c), o WHERE c <> (SELECT min(c) FROM p) GROUP BY c, t, o""")
def profile_overlap(spark: SparkSession, sf: str) -> DataFrame:
    li, o, pt = load(spark, sf, "lineitem"), load(spark, sf, "orders"), load(spark, sf, "part")
    p = li.join(o.select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("custkey")), "l_orderkey").join(pt.select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey").groupBy("custkey", "p_brand").agg(F.sum("l_quantity").alias("w"))
    p = materialise(p, "profiles")
    return taxonomy.profile_similarity(p, "custkey", "p_brand", "w", p.agg(F.min("custkey").alias("custkey"))).withColumn("similarity", F.round("similarity", 6))


@query("""WITH b AS (SELECT item_id, text, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM benchmark),
d AS (SELECT doc_id, md5(text) AS h, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS k FROM documents),
e AS (SELECT md5(text) AS h, min(item_id) AS i FROM b GROUP BY 1), n AS (SELECT k, min(item_id) AS i, count(*) AS c FROM b GROUP BY k)
SELECT d.doc_id, coalesce(e.i, n.i) AS item_id, CASE WHEN e.i IS NOT NULL THEN 'exact' WHEN n.i IS NULL THEN 'none' WHEN n.c > 1 THEN 'ambiguous' ELSE 'normalised' END AS basis FROM d LEFT JOIN e USING (h) LEFT JOIN n USING (k)""")
def dedup_cascade(spark: SparkSession, sf: str) -> DataFrame:
    key = lambda: F.trim(F.regexp_replace(F.lower("text"), "[^a-z0-9]+", " "))
    b = load(spark, sf, "benchmark")
    e = b.groupBy(F.md5("text").alias("h")).agg(F.min("item_id").alias("e"))
    n = b.groupBy(key().alias("k")).agg(F.min("item_id").alias("n"), F.count("*").alias("c"))
    d = load(spark, sf, "documents").select("doc_id", F.md5("text").alias("h"), key().alias("k")).join(e, "h", "left").join(n, "k", "left")
    return d.select("doc_id", F.coalesce("e", "n").alias("item_id"), F.when(F.col("e").isNotNull(), "exact").when(F.col("n").isNull(), "none").when(F.col("c") > 1, "ambiguous").otherwise("normalised").alias("basis"))


@query("""WITH i AS (SELECT s_suppkey AS id, regexp_replace(lower(s_name), '[^a-z0-9]', '', 'g') AS t, s_nationkey AS y FROM supplier),
p AS (SELECT c_custkey AS id, 'supplier' || lpad(((c_custkey * 7) % 300 + 1)::VARCHAR, 9, '0') AS t, c_nationkey AS y FROM customer),
b AS (SELECT t, y, list(id ORDER BY id) AS c FROM i GROUP BY t, y), n AS (SELECT t, list(id ORDER BY id) AS c FROM i GROUP BY t),
m AS (SELECT p.id, coalesce(b.c, n.c, []) AS c, CASE WHEN b.c IS NOT NULL THEN 'exact_title_year' WHEN n.c IS NOT NULL THEN 'exact_title' ELSE 'none' END AS basis FROM p LEFT JOIN b ON b.t = p.t AND b.y = p.y LEFT JOIN n ON n.t = p.t)
SELECT basis AS match_basis, CASE len(c) WHEN 0 THEN 'unmatched' WHEN 1 THEN 'matched' ELSE 'ambiguous' END AS match_status, count(*) AS n FROM m GROUP BY ALL""")
def inventory_match_status(spark: SparkSession, sf: str) -> DataFrame:
    inv = load(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("paper_id"), F.lit("").alias("doi"), F.regexp_replace("s_name", "[^A-Za-z0-9]", "").alias("title"), F.col("s_nationkey").alias("year"))
    papers = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("paper_id"), F.lit("").alias("doi"), F.concat(F.lit("Supplier"), F.lpad(((F.col("c_custkey") * 7) % 300 + 1).cast("string"), 9, "0")).alias("title"), F.col("c_nationkey").alias("year"))
    return R.counts(dedup.match_inventory(papers, inv), "match_basis", "match_status")


@query("""WITH s AS (SELECT *, 'title:' || left(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 60) || ':unknown' AS sig FROM documents)
SELECT sig, min(doc_id) AS doc_id, count(*) AS members, arg_min(n_chars, doc_id) FILTER (n_chars > 500) AS n_chars FROM s GROUP BY sig""")
def session_dedupe_merge(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("doc_id", N.signature(F.lit(None).cast("string"), F.col("text"), F.lit(None).cast("int")).alias("sig"), F.when(F.col("n_chars") > 500, F.col("n_chars")).alias("n_chars"))
    return merge.backfilled(d, F.col("sig"), ["doc_id"], ["n_chars"]).select("sig", "doc_id", "members", "n_chars")


@query("SELECT source, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS r FROM documents) WHERE r = 1")
def merge_prefer_longer(spark: SparkSession, sf: str) -> DataFrame:
    return merge.keep_longest(load(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars"), [F.col("source"), F.col("lang")], F.col("n_chars"), "doc_id").select("source", "doc_id", "n_chars")


@query("""WITH g AS (SELECT user_id, count(*) AS members, max(value) AS best FROM events GROUP BY user_id HAVING count(*) > 1),
b AS (SELECT user_id, members, best, (SELECT max(event_id) FROM events e WHERE e.user_id = g.user_id AND e.value = best) AS id FROM g),
s AS (SELECT e.user_id, max(value) AS second FROM events e JOIN b ON b.user_id = e.user_id AND e.event_id <> b.id GROUP BY e.user_id)
SELECT user_id, members, CASE WHEN best >= 50 AND (best - coalesce(second, 0) >= 2 OR members = 2) THEN id END AS keep_id FROM b LEFT JOIN s USING (user_id)""")
def conflict_keep_best(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.conflict_winner(load(spark, sf, "events").select("user_id", "value", "event_id"), "user_id", "value", "event_id", least=50.0, gap=2.0)


# ================================================================ centroids, triage, vectors
_C = """WITH v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL), nn AS (SELECT label, sqrt(sum(m * m)) + 1e-10 AS n FROM m GROUP BY label), c AS (SELECT label, i, m / n AS m FROM m JOIN nn USING (label)),
cn AS (SELECT label, sqrt(sum(m * m)) AS n FROM c GROUP BY label), vn AS (SELECT vec_id, sqrt(sum(x * x)) AS n FROM v GROUP BY vec_id),
s AS (SELECT v.vec_id, c.label, sum(v.x * c.m) / (any_value(vn.n) * any_value(cn.n)) AS score FROM v JOIN c ON c.i = v.i JOIN vn ON vn.vec_id = v.vec_id JOIN cn ON cn.label = c.label GROUP BY v.vec_id, c.label)"""


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    nodes = taxonomy.centroids(e, "label").select(F.col("label").cast("string").alias("node_id"), F.concat(F.lit("f"), (F.col("label") % 2).cast("string")).alias("facet_id"), F.lit(1).alias("level"), "centroid")
    return taxonomy.node_scores(e, nodes, id_col="vec_id", least=-1.0)


@query(_C + " SELECT label, round(sqrt(sum(m * m)), 4) AS norm, round(sum(m), 4) AS total FROM c GROUP BY label")
def centroid_build(spark: SparkSession, sf: str) -> DataFrame:
    c = taxonomy.centroids(load(spark, sf, "embeddings"), "label")
    return c.select("label", F.round(SIM.norm(F.col("centroid")), 4).alias("norm"), F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query(_C + ", b AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label::VARCHAR) AS r FROM s) SELECT vec_id, label::VARCHAR AS top_label, round(score, 4) AS score, CASE WHEN score >= 0.3 THEN 'send_to_eater' WHEN score >= 0.2 THEN 'review' ELSE 'reject' END AS decision FROM b WHERE r = 1")
def centroid_triage(spark: SparkSession, sf: str) -> DataFrame:
    best = _scores(spark, sf).groupBy("vec_id").agg(F.min(F.struct((-F.col("score")).alias("n"), "node_id")).alias("m"))
    score = -F.col("m.n")
    return best.select("vec_id", F.col("m.node_id").alias("top_label"), F.round(score, 4).alias("score"), taxonomy.decide(score, 0.3, 0.2).alias("decision"))


@query(_C + " SELECT vec_id, 'f' || (label % 2) AS facet_id, round(max(score), 4) AS score FROM s GROUP BY ALL")
def facet_max_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.facet_max(_scores(spark, sf), "vec_id").withColumn("score", F.round("score", 4))


@query(_C + ", f AS (SELECT vec_id, 'f' || (label % 2) AS facet, max(score) AS score FROM s GROUP BY ALL) SELECT vec_id, round(0.7 * coalesce(sum(score) FILTER (facet = 'f0'), 0) / 2 + 0.3 * coalesce(avg(score) FILTER (facet <> 'f0'), 0), 4) AS triage_score FROM f GROUP BY vec_id")
def facet_triage(spark: SparkSession, sf: str) -> DataFrame:
    t = taxonomy.triage(taxonomy.facet_max(_scores(spark, sf), "vec_id"), "vec_id", core=("f0", "outcomes"))
    return t.select("vec_id", F.round("triage_score", 4).alias("triage_score"))


@query(_C + ", f AS (SELECT vec_id, 'f' || (label % 2) AS facet, max(score) AS score FROM s GROUP BY ALL) SELECT vec_id, round(sum(CASE facet WHEN 'f0' THEN 2 ELSE 1.5 END * score) / sum(CASE facet WHEN 'f0' THEN 2 ELSE 1.5 END), 4) AS relevance FROM f GROUP BY vec_id")
def expansion_relevance(spark: SparkSession, sf: str) -> DataFrame:
    e = taxonomy.expansion_score(taxonomy.facet_max(_scores(spark, sf), "vec_id"), "vec_id", priority=("f0",), core=("f1",))
    return e.select("vec_id", F.round("relevance_score", 4).alias("relevance"))


@query("""WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL), mn AS (SELECT label, sqrt(sum(m * m)) + 1e-10 AS n FROM m GROUP BY label),
g AS (SELECT i, avg(x) AS g FROM v GROUP BY i), gn AS (SELECT sqrt(sum(g * g)) + 1e-10 AS n FROM g),
b AS (SELECT label, i, 0.7 * m / mn.n + 0.3 * g / gn.n AS b FROM m JOIN mn USING (label) JOIN g USING (i), gn), bn AS (SELECT label, sqrt(sum(b * b)) + 1e-10 AS n FROM b GROUP BY label)
SELECT label, round(sum(b / n), 4) AS total, round(max(b / n), 4) AS most FROM b JOIN bn USING (label) GROUP BY label""")
def hier_blend(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    whole = taxonomy.centroids(e.withColumn("one", F.lit(1)), "one").select(F.col("centroid").alias("parent"))
    c = taxonomy.centroids(e, "label").join(F.broadcast(whole), how="cross").select("label", taxonomy.blend(F.col("centroid"), F.col("parent")).alias("b"))
    return c.select("label", F.round(F.aggregate("b", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("b"), 4).alias("most"))


@query(_C + ", b AS (SELECT vec_id, round(max(score), 6) AS score FROM s GROUP BY vec_id) SELECT CASE WHEN score < 0.2 THEN '0.0-0.2' WHEN score < 0.4 THEN '0.2-0.4' WHEN score < 0.6 THEN '0.4-0.6' WHEN score < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END AS bucket, count(*) AS n FROM b GROUP BY 1")
def triage_report(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.score_buckets(_scores(spark, sf).groupBy("vec_id").agg(F.round(F.max("score"), 6).alias("score")), "score")


@query(_C + ", r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label::VARCHAR) AS r FROM s) SELECT vec_id, string_agg(printf('n%s (%.2f)', label::VARCHAR, round(score, 6)), ', ' ORDER BY r) AS reasons FROM r WHERE r <= 3 AND score > 0 GROUP BY vec_id")
def triage_reasons(spark: SparkSession, sf: str) -> DataFrame:
    s = _scores(spark, sf).where("score > 0")
    names = s.select("node_id").distinct().withColumn("name", F.concat(F.lit("n"), "node_id"))
    return taxonomy.reasons(s, names, "vec_id", 3, shown=F.round("score", 6)).select("vec_id", F.array_join("reasons", ", ").alias("reasons"))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT b.vec_id, round({_COS}, 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 0 AND {_COS} >= 0.0 ORDER BY {_COS} DESC, b.vec_id LIMIT 20")
def semantic_topk(spark: SparkSession, sf: str) -> DataFrame:
    return vector.similar_to(load(spark, sf, "embeddings"), 0, id_col="vec_id", k=20, exclude_self=False).select("vec_id", F.round("score", 4).alias("score"))


@query(f"SELECT b.vec_id, round({_COS}, 4) AS score FROM embeddings a, embeddings b WHERE a.vec_id = 7 AND b.vec_id <> 7 AND {_COS} >= 0.1 ORDER BY {_COS} DESC, b.vec_id LIMIT 20")
def similar_excl_self(spark: SparkSession, sf: str) -> DataFrame:
    return vector.similar_to(load(spark, sf, "embeddings"), 7, id_col="vec_id", k=20, least=0.1).select("vec_id", F.round("score", 4).alias("score"))


@query(f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, round({_COS}, 4) AS score, CASE WHEN {_COS} > 0.45 THEN 'duplicate' ELSE 'similar' END AS kind FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label WHERE {_COS} >= 0.42")
def near_dup_pairs(spark: SparkSession, sf: str) -> DataFrame:
    pairs = vector.near_pairs(load(spark, sf, "embeddings"), id_col="vec_id", least=0.42, differ="label")
    return vector.label_pairs(pairs, duplicate=0.45).select("id_a", "id_b", F.round("score", 4).alias("score"), "kind")


@query()
def kmeans_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return vector.clusters(load(spark, sf, "embeddings"), id_col="vec_id", k=10)


# ================================================================ graph, synthesis
def _mentions(spark: SparkSession, sf: str, col: str, prefix: str) -> DataFrame:
    return load(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"), F.col("l_orderkey").alias("order"), F.concat(F.lit(prefix), F.col(col).cast("string")).alias("construct"))


@query("SELECT 'has_claim' AS type, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey UNION ALL SELECT 'about_iv', count(*) FROM lineitem UNION ALL SELECT 'about_dv', count(*) FROM lineitem UNION ALL SELECT 'construct', count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'paper', count(*) FROM orders")
def graph_nodes_edges(spark: SparkSession, sf: str) -> DataFrame:
    papers = load(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("paper_id"), F.col("o_orderstatus").alias("title"))
    item = lambda c, r: F.array(F.struct(F.concat(F.lit(r), F.col(c).cast("string")).alias("id"), F.lit(r).alias("role"), F.lit(None).cast("string").alias("direction")))
    none = F.array().cast("array<struct<id:string,role:string,direction:string>>")
    claims = load(spark, sf, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"), F.col("l_orderkey").cast("string").alias("paper_id"), F.lit("").alias("statement"), item("l_partkey", "part").alias("environment_factors"), item("l_suppkey", "supp").alias("outcomes"), none.alias("mediators"), none.alias("moderators"))
    stats = graph.graph_stats(graph.nodes(papers, claims), graph.edges(papers, claims))
    return stats.where("type in ('has_claim', 'about_iv', 'about_dv', 'construct', 'paper')").select("type", "n")


@query("SELECT a.l_orderkey AS orderkey, count(*) AS n_affects FROM lineitem a JOIN lineitem b USING (l_orderkey) GROUP BY a.l_orderkey")
def affects_edges(spark: SparkSession, sf: str) -> DataFrame:
    iv = _mentions(spark, sf, "l_partkey", "p").withColumn("claim_id", F.col("order"))
    dv = _mentions(spark, sf, "l_suppkey", "s").withColumn("claim_id", F.col("order"))
    return graph.affects(iv, dv).groupBy(F.col("claim_id").alias("orderkey")).agg(F.count("*").alias("n_affects"))


@query("""WITH c AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p, min(l_suppkey) AS s, min(l_discount) AS x FROM lineitem GROUP BY ALL)
SELECT 'p' || p AS src, count(*) AS claim_count, round(avg(x), 6) AS avg_effect FROM c WHERE s = 1 GROUP BY p ORDER BY claim_count DESC, src LIMIT 50""")
def what_affects(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"), F.min("l_discount").alias("effect"))
    c = c.select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("claim_id"), F.concat(F.lit("p"), F.col("p").cast("string")).alias("p"), F.concat(F.lit("s"), F.col("s").cast("string")).alias("s"), "effect")
    edges = graph.affects(c.select("claim_id", F.col("p").alias("construct")), c.where("s = 's1'").select("claim_id", F.col("s").alias("construct")))
    effects = c.select("claim_id", "effect")
    return graph.what_affects(edges, effects, F.col("dst") == "s1").orderBy(F.desc("claim_count"), "src").limit(50).select("src", "claim_count", F.round("avg_effect", 6).alias("avg_effect"))


@query("SELECT l_suppkey AS node, count(*) AS in_degree, 5 + least(2 * count(*), 30) AS size FROM lineitem GROUP BY l_suppkey")
def indegree_size(spark: SparkSession, sf: str) -> DataFrame:
    return graph.in_degree(load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("cites").alias("type")))


_ASK = ["What affects {}?", "what does {} affect?", "How many claims about {}", "contradictory claims about {}", "show claims about {}", "find papers on {}", "{}"]


@query("""WITH q AS (SELECT conv_id, turn, lower(CASE (conv_id + turn) % 7 WHEN 0 THEN 'What affects ' || r || '?' WHEN 1 THEN 'what does ' || r || ' affect?' WHEN 2 THEN 'How many claims about ' || r WHEN 3 THEN 'contradictory claims about ' || r WHEN 4 THEN 'show claims about ' || r WHEN 5 THEN 'find papers on ' || r ELSE r END) AS q, lower(r) AS r, (conv_id + turn) % 7 AS k FROM (SELECT conv_id, turn, 'topic' || (conv_id % 13) AS r FROM conversations))
SELECT conv_id, turn, CASE k WHEN 0 THEN 'what_affects' WHEN 1 THEN 'affects_what' WHEN 2 THEN 'count_claims' WHEN 3 THEN 'contradictions' WHEN 4 THEN 'claims_about' WHEN 5 THEN 'papers_about' ELSE 'general_search' END AS type, r AS construct FROM q""")
def nl_parse(spark: SparkSession, sf: str) -> DataFrame:
    r = F.concat(F.lit("topic"), (F.col("conv_id") % 13).cast("string"))
    k = (F.col("conv_id") + F.col("turn")) % 7
    text = F.coalesce(*[F.when(k == i, F.concat(F.lit(q.split("{}")[0]), r, F.lit(q.split("{}")[1]))) for i, q in enumerate(_ASK)])
    return load(spark, sf, "conversations").select("conv_id", "turn", P.parse_question(text).alias("p")).select("conv_id", "turn", "p.type", "p.construct")


_WAY = "CASE event_type WHEN 'purchase' THEN 'positive' WHEN 'signup' THEN 'positive' WHEN 'error' THEN 'negative' WHEN 'view' THEN 'null' ELSE 'unknown' END"


@query(f"""WITH d AS (SELECT user_id, event_id, {_WAY} AS way FROM events), f AS (SELECT *, row_number() OVER (PARTITION BY user_id, way ORDER BY event_id) AS r FROM d),
e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY way DESC, r) AS e FROM f WHERE r <= 5 AND way IN ('positive', 'negative')),
x AS (SELECT p.user_id, 'direction_conflict' AS type, p.event_id AS claim_1, n.event_id AS claim_2, 0 AS o, p.r AS r1, n.r AS r2 FROM f p JOIN f n USING (user_id) WHERE p.way = 'positive' AND n.way = 'negative' AND p.r <= 5 AND n.r <= 5
 UNION ALL SELECT e.user_id, 'effect_vs_null', e.event_id, z.event_id, 1, e.e, z.r FROM e JOIN f z USING (user_id) WHERE e.e <= 5 AND z.way = 'null' AND z.r <= 3)
SELECT user_id, type, claim_1, claim_2 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY o, r1, r2) AS n FROM x) WHERE n <= 20""")
def contradictions(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "events").select("user_id", "event_id", F.expr(_WAY).alias("way"))
    return synthesis.contradictions(d, "user_id", "event_id", "way")


_POOL = """WITH e AS (SELECT l_partkey AS partkey, l_discount AS x, l_quantity AS w FROM lineitem), m AS (SELECT partkey, count(*) AS n, sum(w * x) / sum(w) AS p, sqrt(1 / sum(w)) AS se FROM e GROUP BY partkey),
q AS (SELECT partkey, sum(w * (x - p) ** 2) AS q FROM e JOIN m USING (partkey) GROUP BY partkey)"""


def _pooled(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "lineitem").select(F.col("l_partkey").alias("partkey"), F.col("l_discount").alias("x"), "l_quantity")
    return synthesis.pooled(e, "partkey", "x", F.col("l_quantity"))


@query(_POOL + " SELECT partkey, n AS n_with_effect, round(p, 6) AS pooled_effect, round(se, 6) AS pooled_se, round(p - 1.96 * se, 6) AS ci_lower, round(p + 1.96 * se, 6) AS ci_upper FROM m")
def pooled_effect(spark: SparkSession, sf: str) -> DataFrame:
    return _pooled(spark, sf).select("partkey", "n_with_effect", *[F.round(c, 6).alias(c) for c in ("pooled_effect", "pooled_se", "ci_lower", "ci_upper")])


@query(_POOL + ", i AS (SELECT partkey, round(q + 1e-7, 3) AS q_statistic, CASE WHEN q > 0 THEN greatest(0, (q - n + 1) / q * 100) ELSE 0 END AS i FROM q JOIN m USING (partkey) WHERE n >= 2) SELECT partkey, q_statistic, round(i, 4) AS i_squared, CASE WHEN i < 25 THEN 'low' WHEN i < 75 THEN 'moderate' ELSE 'high' END AS heterogeneity FROM i")
def heterogeneity(spark: SparkSession, sf: str) -> DataFrame:
    return _pooled(spark, sf).where("n_with_effect >= 2").select("partkey", F.round(F.col("q_statistic") + 1e-7, 3).alias("q_statistic"), F.round("i_squared", 4).alias("i_squared"), "heterogeneity")


@query(f"""WITH d AS (SELECT user_id, {_WAY} AS w FROM events), n AS (SELECT user_id, count(*) AS n_claims, count(*) FILTER (w = 'positive') AS n_positive, count(*) FILTER (w = 'negative') AS n_negative, count(*) FILTER (w = 'null') AS n_null FROM d GROUP BY user_id)
SELECT *, CASE WHEN n_positive > n_negative AND n_positive > n_null THEN 'positive' WHEN n_negative > n_positive AND n_negative > n_null THEN 'negative' WHEN n_null > n_positive AND n_null > n_negative THEN 'null' WHEN n_positive > 0 AND n_negative > 0 THEN 'mixed' ELSE 'unknown' END AS overall FROM n""")
def direction_vote(spark: SparkSession, sf: str) -> DataFrame:
    return synthesis.vote(load(spark, sf, "events").select("user_id", "event_type"), "user_id", F.expr(_WAY))


@query("SELECT s_nationkey, 'Study ' || row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS label, s_suppkey, s_acctbal / 1000 AS effect, s_acctbal / 1000 - 0.2 AS ci_lower, CASE WHEN s_nationkey > 10 THEN s_acctbal / 1000 + 0.2 ELSE s_nationkey END AS ci_upper FROM supplier")
def forest_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") / 1000).alias("e"), F.lit(None).cast("double").alias("lo"), F.when(F.col("s_nationkey") <= 10, F.col("s_nationkey").cast("double")).alias("hi"))
    return synthesis.forest_rows(e, "s_nationkey", "s_suppkey", "e", "lo", "hi")


@query("""WITH w AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '([a-z]{5,})', 1)) AS w FROM conversations), f AS (SELECT conv_id, arg_min(w, turn) AS p FROM w GROUP BY conv_id),
m AS (SELECT conv_id, len(list_intersect(w, p)) / len(w) AS s FROM w JOIN f USING (conv_id) WHERE len(w) > 0)
SELECT conv_id::VARCHAR AS paper_id, count(*) AS n_claims, round(avg(s), 6) AS relevance, CASE WHEN avg(s) < 0.1 THEN 'warning' ELSE 'pass' END AS status FROM m GROUP BY conv_id""")
def claim_relevance(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "conversations")
    papers = c.groupBy(F.col("conv_id").cast("string").alias("paper_id")).agg(F.min_by("text", "turn").alias("title")).withColumn("abstract", F.lit(""))
    return synthesis.claim_relevance(c.select(F.col("conv_id").cast("string").alias("paper_id"), F.col("text").alias("statement")), papers).withColumn("relevance", F.round("relevance", 6))


@query("""SELECT p_partkey, round_even(least(greatest(0.3 * (p_size / 50) + CASE WHEN p_partkey % 2 = 0 THEN 0.2 ELSE 0 END + 0.2 * (p_retailprice / 3000) + CASE WHEN p_size > 25 THEN 0.1 ELSE 0 END
 + CASE WHEN length(p_brand) % 3 >= 2 THEN 0.1 ELSE 0 END - CASE WHEN p_size < 5 THEN 0.1 ELSE 0 END, 0), 1), 2) AS voi FROM part""")
def theory_voi(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    return p.select("p_partkey", synthesis.value_of_information(F.col("p_size") / 50, F.col("p_partkey") % 2 == 0, F.col("p_retailprice") / 3000, F.col("p_size") > 25, F.length("p_brand") % 3, F.col("p_size") < 5).alias("voi"))


# ================================================================ coverage, gaps, expansion
_COV = """WITH f AS (SELECT r_name FROM region), b AS (SELECT DISTINCT p_brand FROM part),
x AS (SELECT r_name, p_brand, l_orderkey, l_quantity FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
e AS (SELECT r_name, p_brand, count(DISTINCT l_orderkey) AS papers, count(*) FILTER (l_quantity > 48) AS claims, bool_or(l_quantity > 49) AS mech FROM x GROUP BY ALL),
c AS (SELECT r_name AS factor_id, p_brand AS outcome_id, coalesce(papers, 0) AS paper_count, coalesce(claims, 0) AS claim_count, coalesce(mech, FALSE) AS has_mechanism FROM f CROSS JOIN b LEFT JOIN e USING (r_name, p_brand)),
s AS (SELECT *, round_even(0.4 * least(1, paper_count / 10) + 0.3 * least(1, claim_count / 5) + CASE WHEN has_mechanism THEN 0.15 ELSE 0 END, 2) AS coverage_score FROM c)"""


def _coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("factor_id"))
    s = load(spark, sf, "supplier").join(n, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"), "factor_id")
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("outcome_id"))
    x = load(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_partkey", "l_suppkey").join(p, "l_partkey").join(s, "l_suppkey")
    seen = x.groupBy("factor_id", "outcome_id").agg(F.countDistinct("l_orderkey").alias("paper_count"), F.count_if(F.col("l_quantity") > 48).alias("claim_count"), F.bool_or(F.col("l_quantity") > 49).alias("has_mechanism"), F.lit(False).alias("has_neural"))
    seen = materialise(seen, "evidence")  # read twice below, and by every kind of gap
    cells = gaps.grid(load(spark, sf, "region").select(F.col("r_name").alias("node_id")), load(spark, sf, "part").select(F.col("p_brand").alias("node_id")).distinct())
    return gaps.coverage(cells, seen.select("factor_id", "outcome_id", "paper_count"), seen.drop("paper_count"))


@query(_COV + " SELECT factor_id, outcome_id, paper_count, claim_count, has_mechanism, coverage_score FROM s")
def coverage_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _coverage(spark, sf).select("factor_id", "outcome_id", "paper_count", "claim_count", "has_mechanism", "coverage_score")


@query(_COV + """, g AS (SELECT 'coverage:' || factor_id || '_' || outcome_id AS gap_id, 'coverage' AS gap_type, round(1 - coverage_score, 4) AS priority FROM s WHERE coverage_score < 0.86
 UNION ALL SELECT 'theory:' || outcome_id, 'theory', CASE WHEN sum(claim_count) = 0 THEN 0.8 ELSE 0.6 END FROM s GROUP BY outcome_id HAVING sum(claim_count) < 5
 UNION ALL SELECT 'mechanism:' || factor_id || '_' || outcome_id, 'mechanism', 0.7 FROM s WHERE paper_count >= 3 AND NOT has_mechanism) SELECT * FROM g""")
def gap_union_ranked(spark: SparkSession, sf: str) -> DataFrame:
    cov = _coverage(spark, sf)
    theories = cov.groupBy(F.col("outcome_id").alias("node_id")).agg(F.sum("claim_count").alias("paper_count"))
    return gaps.ranked_gaps(gaps.coverage_gaps(cov, least=0.86), gaps.theory_gaps(theories), gaps.mechanism_gaps(cov)).select("gap_id", "gap_type", F.round("priority", 4).alias("priority"))


@query("""WITH t AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda w: length(w) > 4) AS w FROM benchmark),
c AS (SELECT item_id, unnest(list_transform(range(0, 6), lambda k: '"' || w[1 + k // 2] || '" AND "' || w[4 + k % 2] || '"') || ['"' || w[1] || '" building occupants', '"' || w[1] || '" indoor environment effect']) AS query FROM t WHERE len(w) >= 5)
SELECT query, min(item_id) AS item_id FROM c GROUP BY query""")
def seed_cross_queries(spark: SparkSession, sf: str) -> DataFrame:
    w = F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 4)
    t = load(spark, sf, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 5)
    return t.select("item_id", F.explode(gaps.coverage_queries(F.slice("w", 1, 3), F.slice("w", 4, 2))).alias("query")).groupBy("query").agg(F.min("item_id").alias("item_id"))


_RULES = [("PROMO", "Brand#1", "HIGH"), ("STANDARD", "Brand#", "HIGH"), ("SMALL", "", "LOW"), ("ECONOMY", "Brand#3", "LOW"), ("", "Brand#2", "HIGH")]


@query("SELECT p_partkey, CASE " + " ".join(f"WHEN starts_with(p_type, '{f}') AND starts_with(p_brand, '{o}') THEN '{p}'" for f, o, p in _RULES) + " ELSE 'MEDIUM' END AS priority FROM part")
def priority_rules(spark: SparkSession, sf: str) -> DataFrame:
    return load(spark, sf, "part").select("p_partkey", gaps.priority(F.col("p_type"), F.col("p_brand"), _RULES).alias("priority"))


@query("""WITH e AS (SELECT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey), s AS (SELECT min(c) AS c FROM e),
h1 AS (SELECT DISTINCT p FROM e JOIN s USING (c)), h2 AS (SELECT DISTINCT c FROM e JOIN h1 USING (p) WHERE c NOT IN (SELECT c FROM s))
SELECT 'c' || c AS node, 0 AS depth FROM s UNION ALL SELECT 'p' || p, 1 FROM h1 UNION ALL SELECT 'c' || c, 2 FROM h2""")
def frontier_expand(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"), "o_custkey").join(load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst")), "k")
    seeds = e.agg(F.concat(F.lit("c"), F.min("o_custkey").cast("string")).alias("node"))
    both = e.select("src", "dst").unionAll(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return expansion.expand(both, seeds, max_depth=2)


@query("""WITH RECURSIVE n AS (SELECT 'w' AS id, NULL AS parent, 'w' AS path UNION ALL SELECT * FROM (SELECT 'r' || r_regionkey, 'w', 'w.r' || r_regionkey FROM region) UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'w.r' || n_regionkey || '.n' || n_nationkey FROM nation),
leaf AS (SELECT 'n' || c_nationkey AS id, count(*) AS c FROM customer GROUP BY 1), up AS (SELECT path, c FROM leaf JOIN n USING (id))
SELECT n.path AS node, coalesce(sum(c), 0)::BIGINT AS customers FROM n LEFT JOIN up ON up.path = n.path OR starts_with(up.path, n.path || '.') GROUP BY n.path""")
def subtree_rollup(spark: SparkSession, sf: str) -> DataFrame:
    nation = load(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("w.r"), F.col("n_regionkey").cast("string"), F.lit(".n"), F.col("n_nationkey").cast("string")).alias("path"))
    per = load(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("c"))
    return nation.join(per, "n_nationkey", "left").select(F.explode(taxonomy.ancestors(F.col("path"))).alias("node"), F.coalesce("c", F.lit(0)).alias("c")).groupBy("node").agg(F.sum("c").alias("customers"))


# ================================================================ audits and reports
_ALLOWED = {"user": ["assistant"], "assistant": ["user"], "system": ["user"]}


@query("""SELECT conv_id, turn, role, previous FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations) WHERE previous IS NOT NULL AND (previous || '>' || role) NOT IN ('user>assistant', 'assistant>user', 'system>user')""")
def state_machine_check(spark: SparkSession, sf: str) -> DataFrame:
    return audit.invalid_transitions(load(spark, sf, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role", _ALLOWED)


@query("SELECT concat_ws(':', 'lang', lang) AS metric, count(*) AS n FROM documents GROUP BY lang UNION ALL SELECT 'total', count(*) FROM documents UNION ALL SELECT 'with_source', count(*) FROM documents WHERE trim(source) <> '' UNION ALL SELECT 'with_long_docs', count(*) FROM documents WHERE n_chars > 1000")
def corpus_stats(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").select("lang", "source", F.when(F.col("n_chars") > 1000, "long").alias("long_docs"))
    row, by = audit.corpus_stats(d, by="lang", present=["source", "long_docs"])
    return by.select(F.concat_ws(":", F.lit("lang"), "lang").alias("metric"), "n").unionByName(row.select(F.explode(F.expr("map('total', total, 'with_source', with_source, 'with_long_docs', with_long_docs)")).alias("metric", "n")))


@query("SELECT year(o_orderdate)::INT AS year, count(*) AS n FROM orders WHERE year(o_orderdate) BETWEEN 1950 AND 2030 GROUP BY 1")
def dashboard_year_counts(spark: SparkSession, sf: str) -> DataFrame:
    return audit.by_year(load(spark, sf, "orders"), F.year("o_orderdate"))


@query("SELECT event_type, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS GROUP BY event_type")
def dashboard_last_day(spark: SparkSession, sf: str) -> DataFrame:
    return audit.last_hours(load(spark, sf, "events"), "ts", 24, "event_type")


@query("SELECT user_id, count(*) AS queries, count(*) FILTER (event_type = 'purchase') AS completed, round(avg(value), 6) AS avg_duration, round(count(*) FILTER (event_type = 'purchase') / count(*), 6) AS acceptance_rate FROM events GROUP BY user_id")
def log_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = audit.log_summary(load(spark, sf, "events"), "user_id", "event_type", "value", done="purchase")
    return s.withColumns({c: F.round(c, 6) for c in ("avg_duration", "acceptance_rate")})


@query("""WITH d AS (SELECT d.*, l.doc_id AS labelled FROM documents d LEFT JOIN labels l USING (doc_id)), c AS (SELECT 'lang' AS gate, count(*) FILTER (trim(lang) <> '') / count(*) AS coverage, 0.9 AS lim FROM d UNION ALL SELECT 'labelled', count(labelled) / count(*), 0.5 FROM d UNION ALL SELECT 'text', count(*) FILTER (trim(text) <> '') / count(*), 0.99 FROM d)
SELECT gate, round(coverage, 6) AS coverage, lim::DOUBLE AS "limit", coverage >= lim AS passed FROM c""")
def production_gates(spark: SparkSession, sf: str) -> DataFrame:
    d = load(spark, sf, "documents").join(load(spark, sf, "labels").select("doc_id", F.lit("y").alias("labelled")), "doc_id", "left")
    return audit.gates(d, {"lang": 0.9, "labelled": 0.5, "text": 0.99}).withColumn("coverage", F.round("coverage", 6))


@query("""SELECT 'orphan_lines' AS metric, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'orphan_orders', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'bad_status', count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F') UNION ALL SELECT 'bad_props', count(*) FROM events WHERE NOT json_valid(props) UNION ALL SELECT 'bad_discount', count(*) FROM lineitem WHERE l_discount NOT BETWEEN 0 AND 1""")
def integrity_counters(spark: SparkSession, sf: str) -> DataFrame:
    li, o, c, e = (load(spark, sf, t) for t in ("lineitem", "orders", "customer", "events"))
    n = lambda df, name: df.agg(F.lit(name).alias("metric"), F.count("*").alias("n"))
    parts = [
        n(audit.orphans(li.select("l_orderkey"), o, "l_orderkey", "o_orderkey"), "orphan_lines"), n(audit.orphans(o.select("o_custkey"), c, "o_custkey", "c_custkey"), "orphan_orders"),
        n(o.where("o_orderstatus not in ('O', 'F')"), "bad_status"), n(e.where(F.try_parse_json("props").isNull()), "bad_props"), n(li.where("l_discount not between 0 and 1"), "bad_discount"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'O' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_totalprice < 1000 THEN 'low' ELSE o_orderpriority END AS o_orderpriority FROM orders")
def conditional_update(spark: SparkSession, sf: str) -> DataFrame:
    o = load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    return R.conditional_update(o, {"o_orderstatus": (F.col("o_orderstatus") == "P", F.lit("O")), "o_orderpriority": (F.col("o_totalprice") < 1000, F.lit("low"))}).drop("o_totalprice")


@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus")
def grouped_totals(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("date"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.count("*").alias("n"))


@query("""SELECT c_custkey, 'Effects of daylight on ' || lower(c_mktsegment) AS title, (1980 + c_custkey % 40)::INT AS year, 'Journal of Tests' AS venue, (c_custkey % 90 + 10) || '-' || (c_custkey % 90 + 20) AS pages,
 'Smith, J. A.; Jones, B' AS authors, 1.0::DOUBLE AS confidence, 'apa' AS parse_method FROM customer""")
def citation_parse(spark: SparkSession, sf: str) -> DataFrame:
    c = spread(load(spark, sf, "customer").select("c_custkey", "c_mktsegment")).select("c_custkey", F.concat(F.lit("Smith, J. A., & Jones, B. ("), (1980 + F.col("c_custkey") % 40).cast("string"), F.lit("). Effects of daylight on "), F.lower("c_mktsegment"), F.lit(". Journal of Tests, 12, "), (F.col("c_custkey") % 90 + 10).cast("string"), F.lit("-"), (F.col("c_custkey") % 90 + 20).cast("string"), F.lit(".")).alias("t"))
    return c.select("c_custkey", P.parse_citations(F.col("t")).alias("p")).select("c_custkey", "p.title", "p.year", "p.venue", "p.pages", F.array_join("p.authors", "; ").alias("authors"), F.round("p.confidence", 4).alias("confidence"), "p.parse_method")


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, max(value) AS most FROM events GROUP BY event_type")
def stream_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts over the events file as a stream run to its end; equal to the batch counts."""
    path, schema, pattern = _events_folder(spark, sf)
    return _at_the_end(incremental.counted_stream(spark, path, schema, ["event_type"], "value", pattern=pattern)).select("event_type", "n", F.round("total", 4).alias("total"), "most")


def _events_folder(spark: SparkSession, sf: str) -> tuple:
    """Folder, schema and file pattern of the events as a stream: a stream reads a folder, that of the file or the table's own."""
    events = load(spark, sf, "events")
    single = events.inputFiles()[0].rsplit("/", 1)[-1] == "events.parquet"
    return (sf if single else f"{sf}/events.parquet"), events.schema, ("events.parquet" if single else "*.parquet")


def _events_stream(spark: SparkSession, sf: str) -> DataFrame:
    path, schema, pattern = _events_folder(spark, sf)
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(path)


def _at_the_end(stream: DataFrame) -> DataFrame:
    return incremental.to_the_end(stream, scratch(stream.sparkSession, "state"), scratch(stream.sparkSession, "progress"))


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = incremental.windowed(_events_stream(spark, sf), "ts", size="1 hour", late="1 hour", keys=["event_type"], value=F.col("value"))
    return _at_the_end(w).select(F.col("window.start").cast("timestamp_ntz").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


_SESSIONS = "SELECT user_id, count(*) AS n_sessions FROM (SELECT user_id, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 HOURS OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 END AS s FROM events) WHERE s = 1 GROUP BY user_id"


@query(_SESSIONS)
def stream_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return _at_the_end(incremental.sessions(_events_stream(spark, sf), "ts", "user_id", gap="6 hours", late="1 hour")).groupBy("user_id").agg(F.count("*").alias("n_sessions"))


@query(_SESSIONS)
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return incremental.sessions(load(spark, sf, "events"), "ts", "user_id", gap="6 hours").groupBy("user_id").agg(F.count("*").alias("n_sessions"))


# ================================================================ ingest, queues, windows
@query("SELECT doc_id, CASE WHEN contains(lower(text), 'nicht') THEN 'off_topic' WHEN contains(lower(text), 'that') OR contains(lower(text), 'pour') THEN 'on_topic' ELSE 'needs_abstract' END AS topic_decision FROM documents")
def keyword_passes(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.keyword_passes(load(spark, sf, "documents").select("doc_id", "text"), F.col("text"), [("off_topic", ["nicht"]), ("on_topic", ["that", "pour"])], default="needs_abstract").drop("text")


@query("""WITH l AS (SELECT n_nationkey AS key, CASE WHEN n_nationkey % 3 = 0 THEN ' ' ELSE n_name END AS name FROM nation), r AS (SELECT p_partkey AS key, p_brand AS name FROM part)
SELECT key, coalesce(nullif(CASE WHEN trim(l.name) = '' THEN '' ELSE l.name END, ''), r.name) AS name FROM l FULL JOIN r USING (key)""")
def two_source_resolve(spark: SparkSession, sf: str) -> DataFrame:
    left = load(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.when(F.col("n_nationkey") % 3 == 0, " ").otherwise(F.col("n_name")).alias("name"))
    return ingest.resolved(left, load(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_brand").alias("name")), "key", ["name"])


@query("""WITH q AS (SELECT user_id::VARCHAR AS doi, count(*) AS discovery_count, least(1, max(value) / 200) AS priority_score FROM events GROUP BY user_id),
h AS (SELECT * FROM q ORDER BY priority_score DESC, discovery_count DESC, doi LIMIT 100)
SELECT doi, discovery_count, round(priority_score, 6) AS priority_score FROM h WHERE priority_score >= 0.3 ORDER BY h.priority_score DESC, discovery_count DESC, doi LIMIT 50""")
def queue_import(spark: SparkSession, sf: str) -> DataFrame:
    q = load(spark, sf, "events").groupBy(F.col("user_id").cast("string").alias("doi")).agg(F.count("*").alias("discovery_count"), F.least(F.lit(1.0), F.max("value") / 200).alias("priority_score")).withColumn("status", F.lit("pending"))
    return expansion.queue_import(q, 50, least=0.3).select("doi", "discovery_count", F.round("priority_score", 6).alias("priority_score"))


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS day, event_type, count(*) AS n FROM events GROUP BY ALL")
def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    w = incremental.windowed(load(spark, sf, "events"), "ts", size="1 day", late="1 hour", keys=["event_type"])
    return w.select(F.col("window.start").alias("day"), "event_type", "n")


@query("SELECT c_custkey, c_mktsegment, rank FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 10")
def top_per_group(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "customer").select("c_custkey", "c_mktsegment", F.col("c_acctbal").alias("score"))
    return vector.top_per_group(c, "c_mktsegment", "c_custkey", 10).select("c_custkey", "c_mktsegment", "rank")


from corpusloom.plans import corpus_queries as _corpus_queries  # noqa: E402, F401  (registers its queries)
from corpusloom.plans import web_queries as _web_queries  # noqa: E402, F401
from corpusloom.plans import index_queries as _index_queries  # noqa: E402, F401
