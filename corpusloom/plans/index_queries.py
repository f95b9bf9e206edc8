"""Queries over stored structures: the vector index, the text index, bucketed tables, running state, trees by parent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import classifier, ingest, taxonomy, vector_index
from corpusloom.plans.registry import query
from corpusloom.session import load
from corpusloom.workspace import materialise

_COS = "list_cosine_similarity(a.v, b.v)"


@query(f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
    s AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score FROM e a JOIN e b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)
    SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vec_id)::INTEGER AS rank, vec_id AS found_id, round(score, 6) AS score FROM s QUALIFY rank <= 10""")
def vector_index_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten nearest of every twentieth vector, against all, through the exact index."""
    e = load(spark, sf, "embeddings")
    index = vector_index.build(e, id_col="vec_id")
    found = vector_index.search(index, e.where("vec_id % 20 = 0"), k=10, id_col="vec_id", exclude_self=True)
    return found.select("query_id", "rank", F.col("id").alias("found_id"), F.round("score", 6).alias("score"))


@query(f"""WITH e AS (SELECT vec_id, vec_id % 3 AS part, list_transform(embedding::DOUBLE[], lambda x, i: 0.35 * x + CASE WHEN i - 1 = label % 64 THEN 1.0 ELSE 0.0 END) AS v FROM embeddings)
    SELECT a.vec_id AS id_a, b.vec_id AS id_b, round({_COS}, 6) AS score, CASE WHEN {_COS} > 0.95 THEN 'duplicate' ELSE 'similar' END AS kind
    FROM e a JOIN e b ON a.vec_id < b.vec_id AND a.part <> b.part WHERE {_COS} >= 0.92""")
def vector_index_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate vectors at 0.92 of different parts, in vectors that stand around their labels; cells of other labels are never multiplied."""
    from corpusloom.operators.vector import label_pairs

    around = F.expr("transform(embedding, (x, i) -> 0.35D * x + CASE WHEN i = label % 64 THEN 1.0D ELSE 0.0D END)")
    e = load(spark, sf, "embeddings").select("vec_id", around.alias("embedding"), (F.col("vec_id") % 3).alias("part"))
    index = vector_index.build(e, id_col="vec_id", differ="part")
    pairs = vector_index.range_pairs(index, e, least=0.92, id_col="vec_id", differ="part")
    return label_pairs(pairs).select("id_a", "id_b", F.round("score", 6).alias("score"), "kind")


#: Two words of a benchmark item name a node; every other one has papers by score, the others are looked for in the texts.
_NODES = """t AS (SELECT item_id, string_split(replace(replace(lower(text), '.', ''), ',', ''), ' ') AS w FROM benchmark),
    n AS (SELECT item_id, 'theory.' || w[4] || '_' || w[5] AS node_id, 'outcome.neural.' || w[2] AS neural_id FROM t WHERE len(w) >= 6),
    s AS (SELECT n.*, CASE WHEN item_id % 2 = 0 THEN (SELECT count(*) FROM documents d WHERE d.doc_id % 97 = n.item_id) ELSE 0 END AS scored,
          replace(list_extract(string_split(node_id, '.'), -1), '_', ' ') AS term, replace(list_extract(string_split(neural_id, '.'), -1), '_', ' ') AS neural_term FROM n)"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    docs = load(spark, sf, "documents").groupBy((F.col("doc_id") % 97).alias("of")).agg(F.count("*").alias("scored"))
    w = F.split(F.regexp_replace(F.lower("text"), "[.,]", ""), " ", -1)
    n = load(spark, sf, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 6)
    n = n.select("item_id", F.concat(F.lit("theory."), F.get("w", 3), F.lit("_"), F.get("w", 4)).alias("node_id"), F.concat(F.lit("outcome.neural."), F.get("w", 1)).alias("neural_id"))
    return n.join(docs, F.col("item_id") == F.col("of"), "left").withColumn("scored", F.when(F.col("item_id") % 2 == 0, F.coalesce("scored", F.lit(0))).otherwise(0)).drop("of")


@query(f"""WITH {_NODES},
    c AS (SELECT s.*, (SELECT count(*) FROM documents d WHERE contains(lower(d.text), s.term)) AS found,
          (SELECT count(*) FROM documents d WHERE contains(lower(d.text), s.term) AND contains(lower(d.text), s.neural_term)) AS both_found FROM s),
    g AS (SELECT DISTINCT 'theory:' || node_id AS gap_id, 'theory' AS gap_type, CASE WHEN scored > 0 THEN scored ELSE found END AS n FROM c),
    h AS (SELECT DISTINCT 'neural:' || node_id || '_' || neural_id AS gap_id, 'neural' AS gap_type, CASE WHEN scored > 0 THEN scored ELSE both_found END AS n FROM c)
    SELECT gap_id, gap_type, CASE WHEN n = 0 THEN 0.8 ELSE 0.6 END::DOUBLE AS priority, n AS existing_evidence FROM g WHERE n < 5
    UNION ALL (SELECT gap_id, gap_type, 0.75::DOUBLE, n FROM h WHERE n < 2 ORDER BY gap_id LIMIT 50)""")
def gap_text_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Theory and neural gaps whose papers are counted by text where none is scored, through the text index."""
    from corpusloom.operators import gaps, text_index

    index = text_index.build(load(spark, sf, "documents"), id_col="doc_id", fields=["text"])
    n = _nodes(spark, sf)
    theories = text_index.theory_counts(n.select("node_id", F.col("scored").alias("paper_count")).distinct(), index)
    cells = text_index.cell_counts(n.select(F.col("node_id").alias("factor_id"), F.col("neural_id").alias("outcome_id"), F.col("scored").alias("paper_count")).distinct(), index)
    return gaps.ranked_gaps(gaps.theory_gaps(theories), gaps.neural_gaps(cells)).select("gap_id", "gap_type", "priority", "existing_evidence")


@query("""WITH q AS (SELECT item_id, lower(substr(text, 4, 9)) AS phrase FROM benchmark)
    SELECT item_id, count(doc_id) AS n, min(doc_id) AS first_doc FROM q LEFT JOIN documents ON contains(lower(text), phrase) GROUP BY item_id""")
def text_index_phrases(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents have nine characters out of the middle of an item's text as a substring, cut words and punctuation included."""
    from corpusloom.operators import text_index

    index = text_index.build(load(spark, sf, "documents"), id_col="doc_id", fields=["text"])
    asked = load(spark, sf, "benchmark").select(F.col("item_id").alias("q"), F.substring("text", 4, 9).alias("phrase"))
    found = text_index.find(index, asked).groupBy("q").agg(F.count("*").alias("n"), F.min("id").alias("first_doc"))
    return asked.join(found, "q", "left").select(F.col("q").alias("item_id"), F.coalesce("n", F.lit(0)).alias("n"), "first_doc")


@query("""SELECT doc_id, source, n_chars FROM documents WHERE (contains(lower(text), 'the ') OR contains(lower(source), 'the ')) AND n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 100""")
def keyword_search(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred longest documents that a keyword search finds in text or source."""
    from corpusloom.operators import text_index

    d = load(spark, sf, "documents")
    index = text_index.build(d, id_col="doc_id", fields=["text", "source"])
    return text_index.keyword_search(d, index, "the ", id_col="doc_id", where=F.col("n_chars") > 500, order=[F.desc("n_chars"), F.col("doc_id")]).select("doc_id", "source", "n_chars")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 100 = 7 THEN o_totalprice + 2 WHEN o_orderkey % 100 = 8 THEN -1.0 ELSE o_totalprice END AS o_totalprice,
    CASE WHEN o_orderkey % 100 = 7 THEN 'FIXED' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 100 <> 9
    UNION ALL SELECT -o_orderkey, o_totalprice, NULL FROM orders WHERE o_orderkey % 100 = 9""")
def bucketed_merges(spark: SparkSession, sf: str) -> DataFrame:
    """A table that is merged into three times: two changes of a key with nulls that keep what was there, inserts, deletes."""
    from corpusloom.sources.bucketed import BucketedTable
    from corpusloom.workspace import scratch

    orders = load(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority")
    seven, eight, nine = (orders.where(F.col("o_orderkey") % 100 == k) for k in (7, 8, 9))
    none = F.lit(None).cast("string")
    changes = seven.select("o_orderkey", (F.col("o_totalprice") + 1).alias("o_totalprice"), none.alias("o_orderpriority"), F.lit(1).alias("at"))
    changes = changes.unionAll(seven.select("o_orderkey", (F.col("o_totalprice") + 2).alias("o_totalprice"), F.lit("FIXED"), F.lit(2))).unionAll(eight.select("o_orderkey", F.lit(-1.0), none, F.lit(1)))
    table = BucketedTable.create(orders, scratch(spark, "orders"), "o_orderkey", buckets=32).upsert(changes, "at")
    table = table.replace(nine.select((-F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", none.alias("o_orderpriority")))
    return table.delete(nine).read()


@query("SELECT user_id, count(*) AS n, max(value) AS most, round(avg(value) + 1e-7, 5) AS mean, max(event_id) AS last_event FROM events GROUP BY user_id")
def running_user_state(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, maxima and means by user over events that arrive in three batches, the stream started anew for each; every batch writes the users it changed."""
    from corpusloom.sources.bucketed import BucketedTable
    from corpusloom.streaming.state import running_state
    from corpusloom.workspace import scratch

    events = load(spark, sf, "events").select("event_id", "user_id", "value")
    inbox, path, checkpoint = (scratch(spark, t) for t in ("inbox", "state", "checkpoint"))
    for part in range(3):
        events.where(F.col("event_id") % 3 == part).write.mode("append").parquet(inbox)
        totals = spark.readStream.schema(events.schema).parquet(inbox).groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.max("event_id").alias("last_event"))
        running_state(totals, path, "user_id", checkpoint, buckets=16)
    return BucketedTable(spark, path).read().withColumn("mean", F.round(F.col("mean") + 1e-7, 5))


@query("""WITH m AS (SELECT max(ts) AS now FROM events), e AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS value, max(ts) AS seen FROM events WHERE user_id % 5 <> 0 GROUP BY user_id),
    a AS (SELECT DISTINCT user_id FROM events)
    SELECT 'u' || a.user_id AS key, CASE WHEN seen IS NULL THEN 'miss' WHEN epoch_us(now) - epoch_us(seen) <= 86400 * 1000000::BIGINT THEN 'hit' ELSE 'expired' END AS state,
           CASE WHEN epoch_us(now) - epoch_us(seen) <= 86400 * 1000000::BIGINT THEN value END AS value FROM a LEFT JOIN e USING (user_id), m""")
def cached_answers(spark: SparkSession, sf: str) -> DataFrame:
    """A cache of the last event of each user, put in twice and asked at the last event's time with a day to live; compacted before it is asked again."""
    from corpusloom.sources.bucketed import ExpiringCache
    from corpusloom.workspace import materialise, scratch

    e = load(spark, sf, "events")
    now = F.lit(e.agg(F.max(F.col("ts").cast("timestamp"))).first()[0])
    latest = e.where("user_id % 5 <> 0").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("value"), F.max("ts").alias("ts"))
    entries = latest.select(F.concat(F.lit("u"), "user_id").alias("key"), "value", F.col("ts").cast("timestamp").alias("cached_at"))
    early = entries.select("key", F.lit("old").alias("value"), (F.col("cached_at") - F.expr("interval 1 second")).alias("cached_at"))
    cache = ExpiringCache.create(spark, scratch(spark, "cache"), ttl_seconds=86400, buckets=16).put(entries).put(early)
    asked = e.select(F.concat(F.lit("u"), "user_id").alias("key")).distinct()
    before = materialise(cache.get(asked, now), "answers")
    again = cache.compact(now).get(asked, now)
    same = before.join(again.select("key", F.col("value").alias("then"), F.col("state").alias("now_is")), "key")
    return same.where(F.col("value").eqNullSafe(F.col("then")) & (F.col("now_is") == F.when(F.col("state") == "hit", "hit").otherwise("miss"))).select("key", "state", "value")


#: A forest over the customers with ids that say nothing: long chains under every seventeenth, bushes elsewhere, cycles of three.
_PARENT = "CASE WHEN c_custkey % 97 = 0 THEN NULL WHEN c_custkey % 97 = 96 THEN c_custkey - 2 WHEN c_custkey % 97 = 94 THEN c_custkey + 1 WHEN c_custkey % 97 = 95 THEN c_custkey + 1 WHEN c_custkey % 97 < 30 THEN c_custkey - 1 ELSE c_custkey - c_custkey % 97 + (c_custkey % 97) // 3 END"


@query(f"""WITH RECURSIVE n AS (SELECT c_custkey AS k, {_PARENT} AS p, c_nationkey AS v FROM customer),
    r AS (SELECT k, k AS root, 1 AS level FROM n WHERE p IS NULL OR p NOT IN (SELECT k FROM n) UNION ALL SELECT n.k, root, level + 1 FROM n JOIN r ON n.p = r.k),
    d AS (SELECT k AS top, k FROM r UNION ALL SELECT d.top, n.k FROM n JOIN d ON n.p = d.k),
    t AS (SELECT top, sum(v)::BIGINT AS total, count(*) AS size FROM d JOIN n USING (k) GROUP BY top)
    SELECT md5(n.k::VARCHAR) AS node, level, md5(root::VARCHAR) AS root, total, size FROM n LEFT JOIN r USING (k) LEFT JOIN t ON t.top = n.k""")
def parent_trees(spark: SparkSession, sf: str) -> DataFrame:
    """Level, root, size and rolled-up value of every node of a forest by parent ids; nodes on a cycle have none."""
    from corpusloom.operators import tree

    parent = F.expr(_PARENT.replace("//", "div"))
    n = load(spark, sf, "customer").select(F.md5(F.col("c_custkey").cast("string")).alias("id"), F.md5(parent.cast("string")).alias("parent"), "c_nationkey")
    t = tree.build(n, id_col="id", parent_col="parent")
    known = tree.levels(t).join(tree.rolled_up(t, n.withColumn("size", F.lit(1)), "id", "c_nationkey", "size"), "node")
    return known.select("node", "level", "root", "total", "size").unionByName(t.cyclic, allowMissingColumns=True)


# ================================================================ files, calls, graph and coverage
@query("SELECT s_suppkey::VARCHAR AS s_suppkey, s_name, coalesce(s_nationkey::VARCHAR, '') AS s_nationkey FROM supplier")
def workbook_table(spark: SparkSession, sf: str) -> DataFrame:
    """The suppliers as workbooks, written by the tasks and read back by them."""
    from corpusloom.sources import workbooks
    from corpusloom.workspace import scratch

    path = scratch(spark, "workbooks")
    workbooks.write_workbooks(load(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path, most_rows=5000).collect()
    return workbooks.read_workbook(spark, path)


@query("""SELECT c_custkey::VARCHAR AS key, CASE WHEN c_custkey % 11 = 5 THEN 'failed' ELSE 'ok' END AS status, CASE WHEN c_custkey % 11 <> 5 THEN upper(c_mktsegment) END AS result,
    CASE WHEN c_custkey % 11 = 5 OR c_custkey % 7 = 3 THEN 2 ELSE 1 END AS run FROM customer""")
def external_calls(spark: SparkSession, sf: str) -> DataFrame:
    """Calls for every customer that fail for some in the first run and for a few always; the second run asks for the failed ones only."""
    from corpusloom.operators import calls
    from corpusloom.workspace import materialise

    def outside(first: bool):
        def call(key: str, payload: str) -> str:
            if int(key) % 11 == 5 or first and int(key) % 7 == 3:
                raise RuntimeError("refused")
            return payload.upper()

        return call

    requests = load(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_mktsegment").alias("payload"))
    first = materialise(calls.call_all(requests, outside(True), attempts=1).withColumn("run", F.lit(1)), "calls")
    second = materialise(calls.call_all(calls.resume(requests, first), outside(False), attempts=1).withColumn("run", F.lit(2)), "calls")
    return calls.latest(first.unionAll(second)).select("key", "status", "result", "run")


@query("SELECT item_id, text, length(text)::BIGINT AS size FROM benchmark")
def json_documents(spark: SparkSession, sf: str) -> DataFrame:
    """A JSON document of several lines for every item, written and read back."""
    from corpusloom.sources import readers
    from corpusloom.workspace import scratch

    path = scratch(spark, "documents")
    items = load(spark, sf, "benchmark").select(F.col("item_id").alias("of"), F.to_json(F.struct("item_id", "text", F.length("text").cast("long").alias("size")), {"pretty": "true"}).alias("value"))
    items.write.partitionBy("of").text(path)
    return readers.read_json(spark, path, "item_id long, text string, size long").select("item_id", "text", "size")


@query("""WITH p AS (SELECT p_partkey FROM part WHERE p_partkey % 10 < 7) SELECT concat('p', l_partkey) AS src, concat('p', l_suppkey) AS dst, count(*) AS n FROM lineitem
    WHERE l_linenumber = 1 AND l_partkey IN (SELECT p_partkey FROM p) AND l_suppkey IN (SELECT p_partkey FROM p) GROUP BY ALL""")
def citation_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Citations in the claim graph: edges between papers that both stand in the corpus."""
    from corpusloom.operators import graph
    from corpusloom.plans.corpus_queries import _claims, view

    papers = view(spark, sf, "papers").where("k % 10 < 7").select("paper_id", "title")
    edges = graph.edges(papers, _claims(spark, sf), view(spark, sf, "citations").select("source_paper_id", "cited_paper_id"))
    return edges.where("type = 'cites'").groupBy("src", "dst").agg(F.count("*").alias("n"))


def _coverage_sql() -> str:
    from corpusloom.plans.catalogue import _COV

    return _COV + " SELECT count(*) AS cells, count(*) FILTER (paper_count > 0) AS covered, count(*) FILTER (coverage_score < 0.3) AS gaps, count(*) FILTER (has_mechanism) AS with_mechanism, 0::BIGINT AS with_neural, round(avg(coverage_score), 6) AS mean_coverage FROM s"


@query(_coverage_sql())
def coverage_overview(spark: SparkSession, sf: str) -> DataFrame:
    """The coverage grid in one row."""
    from corpusloom.operators import gaps
    from corpusloom.plans.catalogue import _coverage

    return gaps.coverage_summary(_coverage(spark, sf)).withColumn("mean_coverage", F.round("mean_coverage", 6))


@query("""SELECT line, count(*) AS n FROM (SELECT unnest(['TY  - JOUR', 'TI  - ' || p_name, 'AU  - A. One', 'PY  - ' || p_size, 'ER  - ']) AS line FROM part) GROUP BY line""")
def ris_file(spark: SparkSession, sf: str) -> DataFrame:
    """An exported RIS file read back, its lines counted."""
    from corpusloom.sources import sinks
    from corpusloom.workspace import scratch

    path, none = scratch(spark, "ris"), F.lit(None).cast("string")
    p = load(spark, sf, "part").select(F.col("p_name").alias("title"), F.array(F.lit("A. One")).alias("authors"), F.col("p_size").alias("year"), none.alias("venue"), none.alias("doi"), none.alias("abstract"))
    sinks.export_ris(p, path)
    return spark.read.text(path).where("value <> ''").groupBy(F.col("value").alias("line")).agg(F.count("*").alias("n"))


def _md5_slot(word):
    """A hash that DuckDB has too: the first eight hex digits of the MD5."""
    return F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long")


@query("""WITH w AS (SELECT 'd' AS kind, doc_id AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS w FROM documents
    UNION ALL SELECT 'b', item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) FROM benchmark),
  h AS (SELECT kind, id, w, count(*)::DOUBLE AS c FROM w GROUP BY ALL),
  s AS (SELECT kind, id, ('0x' || substr(md5(w), 1, 8))::UBIGINT % 64 AS i, sum(c) AS c FROM h GROUP BY ALL),
  f AS (SELECT i, ln(((SELECT count(*) FROM documents) + 1) / (count(*) + 1)) AS idf FROM s WHERE kind = 'd' GROUP BY i),
  x AS (SELECT kind, id, i, c * coalesce(idf, ln((SELECT count(*) FROM documents) + 1)) AS x FROM s LEFT JOIN f USING (i)),
  n AS (SELECT kind, id, sqrt(sum(x * x)) + 1e-10 AS n FROM x GROUP BY ALL), e AS (SELECT kind, id, i, x / n AS x FROM x JOIN n USING (kind, id)),
  items AS (SELECT item_id AS id, 'f' || item_id % 3 AS n1, 'f' || item_id % 3 || '.' || item_id % 9 AS n2, 'f' || item_id % 3 || '.' || item_id % 9 || '.' || item_id AS n3 FROM benchmark),
  tree AS (SELECT n1 AS node, 1 AS level, NULL AS parent, id FROM items UNION ALL SELECT n2, 2, n1, id FROM items UNION ALL SELECT n3, 3, n2, id FROM items),
  size AS (SELECT node, level, parent, count(*) AS items FROM tree GROUP BY ALL),
  own AS (SELECT node, i, sum(x) / any_value(items) AS m FROM tree JOIN size USING (node) JOIN e ON e.kind = 'b' AND e.id = tree.id GROUP BY node, i),
  n1 AS (SELECT node, sqrt(sum(m * m)) + 1e-10 AS n FROM own JOIN size USING (node) WHERE level = 1 GROUP BY node),
  c1 AS (SELECT node, i, m / n AS m FROM own JOIN n1 USING (node)),
  b2 AS (SELECT size.node, p.i, 0.7 * coalesce(own.m, 0) + 0.3 * p.m AS m FROM size JOIN c1 p ON size.parent = p.node AND level = 2 LEFT JOIN own ON own.node = size.node AND own.i = p.i),
  c2 AS (SELECT node, i, m / (sqrt(sum(m * m) OVER (PARTITION BY node)) + 1e-10) AS m FROM b2),
  b3 AS (SELECT size.node, p.i, 0.7 * coalesce(own.m, 0) + 0.3 * p.m AS m FROM size JOIN c2 p ON size.parent = p.node AND level = 3 LEFT JOIN own ON own.node = size.node AND own.i = p.i),
  c3 AS (SELECT node, i, m / (sqrt(sum(m * m) OVER (PARTITION BY node)) + 1e-10) AS m FROM b3),
  c AS (SELECT * FROM c1 UNION ALL SELECT * FROM c2 UNION ALL SELECT * FROM c3),
  g AS (SELECT i, sum(x) AS g FROM e WHERE kind = 'b' AND id < 14 GROUP BY i), dom AS (SELECT i, g / (SELECT sqrt(sum(g * g)) FROM g) AS g FROM g),
  ds AS (SELECT id AS doc_id, round(sum(x * g), 12) AS domain FROM e JOIN dom USING (i) WHERE kind = 'd' GROUP BY id),
  hit AS (SELECT e.id AS doc_id, c.node, round(greatest(sum(e.x * c.m), 0), 12) AS score FROM e JOIN c USING (i) WHERE e.kind = 'd' GROUP BY ALL),
  sc AS (SELECT documents.doc_id, node, substr(node, 1, 2) AS facet, level, coalesce(score, 0) AS score FROM documents CROSS JOIN size LEFT JOIN hit USING (doc_id, node)),
  r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, node) AS r, row_number() OVER (PARTITION BY doc_id, facet ORDER BY score DESC, node) AS rf FROM sc),
  a AS (SELECT doc_id, string_agg(node, ',' ORDER BY r) FILTER (r <= 10) AS top, string_agg(node, ',' ORDER BY facet, rf) FILTER (rf <= 3) AS by_facet, count(*) FILTER (r <= 10 AND score >= 0.3) AS stored,
    max(score) FILTER (level = 2) AS l2, max(score) FILTER (level = 3) AS l3, max(score) AS best FROM r GROUP BY doc_id)
SELECT doc_id, round(coalesce(domain, 0), 4) AS domain_score, round(best, 4) AS best_score, top, by_facet, stored,
  CASE WHEN coalesce(domain, 0) < 0.3 THEN 'reject' WHEN l2 >= 0.7 OR l3 >= 0.65 THEN 'send_to_eater' ELSE 'review' END AS decision FROM a LEFT JOIN ds USING (doc_id)""")
def classified_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Whole texts embedded by hashed words, against a tree of three levels whose seeds are the benchmark's items, and a domain of its first 14."""
    d, b = load(spark, sf, "documents").select("doc_id", "text"), load(spark, sf, "benchmark")
    weights = taxonomy.slot_weights(d, F.col("text"), hashed=_md5_slot)
    vectors = taxonomy.embed(d, F.col("text"), hashed=_md5_slot, weights=weights).select("doc_id", "embedding")
    item = F.col("item_id")
    one = F.concat(F.lit("f"), (item % 3).cast("string"))
    two = F.concat(one, F.lit("."), (item % 9).cast("string"))
    three = F.concat(two, F.lit("."), item.cast("string"))
    none = F.lit(None).cast("string")
    place = lambda node, parent, level: F.struct(node.alias("node_id"), parent.alias("parent_id"), F.lit(level).alias("level"), one.alias("facet_id"))
    items = taxonomy.embed(b, F.col("text"), hashed=_md5_slot, weights=weights).withColumn("n", F.explode(F.array(place(one, none, 1), place(two, one, 2), place(three, two, 3))))
    items = materialise(items.select("item_id", "embedding", "n.*"), "items")
    nodes = items.select("node_id", "parent_id", "level", "facet_id").distinct()
    domain = taxonomy.centroids(items.where("item_id < 14 and level = 1").select(F.lit(1).alias("k"), "embedding"), "k").first()
    found = classifier.classify(vectors, classifier.node_model(nodes, items.select("node_id", "embedding")), domain["centroid"] if domain else [0.0] * 64, id_col="doc_id")
    names = lambda c: F.array_join(F.transform(c, lambda x: x["node_id"]), ",")
    kept = F.size(F.filter("top_nodes", lambda x: x["score"] >= 0.3)).cast("long")
    return found.select("doc_id", F.round("domain_score", 4).alias("domain_score"), F.round(F.get("top_nodes", F.lit(0))["score"], 4).alias("best_score"), names("top_nodes").alias("top"), names("facets").alias("by_facet"), kept.alias("stored"), "decision")


@query(r"""WITH k AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(coalesce(split_part(text, '.', 1), '')), '[^\p{L}\p{N}\p{M}_\s]', '', 'g'), '\s+', ' ', 'g')) AS key FROM documents),
  p AS (SELECT 'p' || doc_id AS paper_id, CASE WHEN doc_id % 10 = 0 THEN '10.5/x' || doc_id % 70 END AS doi, key FROM k WHERE doc_id % 2 = 0),
  d AS (SELECT doi, min(paper_id) AS by_doi FROM p WHERE doi IS NOT NULL GROUP BY doi), t AS (SELECT key, min(paper_id) AS by_title FROM p WHERE key <> '' GROUP BY key)
SELECT k.doc_id AS item_id, coalesce(by_doi, by_title) AS paper_id, CASE WHEN by_doi IS NOT NULL THEN 'doi' WHEN by_title IS NOT NULL THEN 'title' ELSE 'none' END AS basis
FROM k LEFT JOIN d ON k.doc_id % 7 = 0 AND d.doi = '10.5/x' || k.doc_id % 90 LEFT JOIN t ON t.key = k.key""")
def library_of_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as library items against the even ones as papers, by DOIs that several papers share and by first sentences, which copies share; the SQL reckons the match."""
    k = load(spark, sf, "documents").select("doc_id", F.split_part("text", F.lit("."), F.lit(1)).alias("title"))
    ident = F.col("doc_id")
    doi = lambda head, n: F.concat(F.lit(head), (ident % n).cast("string"))
    papers = k.where(ident % 2 == 0).select(F.concat(F.lit("p"), ident.cast("string")).alias("paper_id"), F.when(ident % 10 == 0, doi("HTTPS://DOI.ORG/10.5/X", 70)).alias("doi"), "title")
    items = k.select(ident.alias("item_id"), F.when(ident % 7 == 0, doi("doi: 10.5/x", 90)).alias("doi"), F.concat(F.lit(" \""), "title", F.lit("!\"")).alias("title"))
    return ingest.match_library(items, papers)


@query("""WITH p AS (SELECT p_partkey, string_split(p_name || ' ' || lower(p_type), ' ') AS w, 1980 + p_size % 4 AS y FROM part), r AS (SELECT * FROM p WHERE p_partkey % 5 = 0),
  m AS (SELECT r.p_partkey AS id, c.p_partkey AS cand, len(list_intersect(r.w, c.w)) / len(list_distinct(list_concat(r.w, c.w))) AS jac, abs(r.y - c.y) AS apart, c.p_partkey % 3 = 0 AS has_doi, c.p_partkey % 4 = 1 AS has_abstract
    FROM r JOIN p c ON c.p_partkey BETWEEN r.p_partkey - 10 AND r.p_partkey + 10 AND r.p_partkey <> c.p_partkey),
  s AS (SELECT id, cand, jac + CASE WHEN apart = 0 THEN 0.2 WHEN apart <= 1 THEN 0.05 ELSE -0.15 END::DOUBLE + CASE WHEN has_abstract THEN 0.08 ELSE 0 END::DOUBLE + CASE WHEN has_doi THEN 0.05 ELSE 0 END::DOUBLE AS score, has_doi FROM m)
SELECT id AS p_partkey, round(max(score), 3) AS match_score FROM s WHERE score >= 0.35 GROUP BY id""")
def best_part_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Every fifth part against the twenty around it: titles share words, years lie apart, some have a DOI or an abstract; the SQL reckons every score."""
    key = F.col("p_partkey")
    p = load(spark, sf, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.lower("p_type")).alias("title"), (1980 + F.col("p_size") % 4).alias("year"))
    records = p.where(key % 5 == 0).select(key.alias("id"), "title", F.lit("nobody").alias("author"), "year")
    near = records.select("id", F.explode(F.array_remove(F.sequence(F.col("id") - 10, F.col("id") + 10), F.col("id"))).alias("other"))
    other = p.select(key.alias("other"), "title", F.array(F.lit("J. Smith")).alias("authors"), "year", F.when(key % 3 == 0, "10.9/a").alias("doi"), F.when(key % 4 == 1, "text").otherwise(" ").alias("abstract"))
    return ingest.best_candidates(records, near.join(other, "other")).select(F.col("id").alias("p_partkey"), "match_score")
