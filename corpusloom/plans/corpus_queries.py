"""Queries over a research corpus laid over the driver's tables: parts are papers, line items claims, orders their sources.

A view is a table and a dict of SQL expressions that both engines read alike, so a query and its SQL start
from the same rows. ``CTE`` has the views as DuckDB common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import config
from corpusloom.functions import normalize as N
from corpusloom.functions import parse as P
from corpusloom.functions import similarity as SIM
from corpusloom.operators import audit, dedup, expansion, gaps, graph, ingest, merge, nlquery, synthesis, taxonomy, vector
from corpusloom.operators import relational as R
from corpusloom.operators.sized import dealt, spread
from corpusloom.plans import discovery
from corpusloom.plans.registry import query
from corpusloom.schemas import STATUS_TRANSITIONS
from corpusloom.session import load
from corpusloom.sources import readers, sinks
from corpusloom.streaming import incremental
from corpusloom.workspace import materialise, scratch

VIEWS: dict[str, tuple[str, dict[str, str]]] = {
    "papers": ("part", {
        "paper_id": "concat('p', p_partkey)", "k": "p_partkey", "doi": "CASE WHEN p_partkey % 3 <> 0 THEN concat('10.1234/p.', p_partkey) END",
        "title": "concat('Effects of ', p_name, ' on ', lower(p_type), ' study ', p_partkey)", "year": "1980 + p_size", "venue": "CASE WHEN p_partkey % 5 = 0 THEN concat('Brain & ', p_brand) ELSE p_brand END",
        "abstract": "CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 = 1 THEN NULL ELSE concat('an abstract on ', p_name) END", "url": "CASE WHEN p_partkey % 2 = 0 THEN concat('https://x.example/', p_partkey) END", "publisher": "CAST(NULL AS VARCHAR(10))",
        "status": "CASE p_partkey % 6 WHEN 0 THEN 'candidate' WHEN 1 THEN 'rejected' WHEN 2 THEN 'lost' WHEN 3 THEN 'pending_scorer' WHEN 4 THEN 'downloaded' ELSE 'candidate' END",
        "triage_decision": "CASE p_partkey % 7 WHEN 0 THEN 'pending' WHEN 1 THEN 'needs_review' WHEN 2 THEN 'reject' WHEN 3 THEN 'odd' ELSE 'review' END", "triage_score": "CASE WHEN p_partkey % 8 = 0 THEN NULL WHEN p_partkey % 8 = 1 THEN 0.0 ELSE p_size / 50.0 END",
        "topic_decision": "CASE WHEN p_partkey % 9 = 0 THEN 'off_topic' ELSE 'on_topic' END", "citation_count": "p_size * 5", "taxonomy_version": "CASE WHEN p_partkey % 10 < 7 THEN 'v2' ELSE 'v1' END",
        "pdf_path": "CASE WHEN p_partkey % 4 <> 3 THEN concat('/pdf/', p_partkey % 500, '.pdf') END", "pdf_sha256": "CASE WHEN p_partkey % 4 <> 3 THEN md5(concat(p_partkey % 300)) END",
        "ae_status": "CASE p_partkey % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'SUCCESS' WHEN 2 THEN 'PARTIAL_SUCCESS' WHEN 3 THEN 'strange' END", "ae_job_path": "CASE WHEN p_partkey % 10 <> 0 THEN concat('/job/', p_partkey) END",
        "ae_output_path": "CASE WHEN p_partkey % 5 < 3 THEN concat('/out/', p_partkey) END", "ae_n_claims": "p_size", "ae_n_rules": "p_size % 7", "ae_confidence": "p_size / 100.0", "human_notes": "CASE WHEN p_partkey % 2 = 0 THEN 'seen' END",
    }),
    "files": ("part", {"path": "concat('/pdf/', p_partkey, '.pdf')", "sha256": "md5(concat(p_partkey % 290))"}),
    "outputs": ("part", {"ae_output_path": "concat('/out/', p_partkey)", "status": "CASE WHEN p_partkey % 11 = 0 THEN 'FAIL' ELSE 'SUCCESS' END", "n_claims": "p_size + CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 0 END", "n_rules": "p_size % 7", "confidence": "p_size / 100.0 + CASE WHEN p_partkey % 17 = 0 THEN 0.01 ELSE 0 END"}),
    "claims": ("lineitem", {
        "claim_id": "concat(l_orderkey, '-', l_linenumber, '-', l_partkey)", "paper_id": "concat('p', l_partkey)", "construct": "concat('s', l_suppkey)", "effect": "CASE WHEN l_quantity > 10 THEN l_discount - 0.05 END",
        "claim_type": "CASE l_linenumber % 6 WHEN 0 THEN 'causal' WHEN 1 THEN 'null' WHEN 2 THEN 'moderated' WHEN 3 THEN 'mechanistic' ELSE 'associational' END",
        "statement": "concat('light of ', l_suppkey, CASE l_returnflag WHEN 'A' THEN ' will increase ' WHEN 'R' THEN ' will reduce ' ELSE ' meets ' END, 'focus ', l_partkey)",
    }),
    "citations": ("lineitem", {
        "source_paper_id": "concat('p', l_partkey)", "cited_doi": "CASE WHEN l_linenumber = 7 THEN NULL ELSE concat('10.1234/', CASE WHEN l_linenumber % 2 = 0 THEN 'P.' ELSE 'x.' END, l_suppkey) END", "cited_title": "concat('Title ', l_suppkey)",
        "seq": "l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 10", "cited_paper_id": "CASE WHEN l_linenumber = 1 THEN concat('p', l_suppkey) END",
    }),
}


def view(spark: SparkSession, sf: str, name: str) -> DataFrame:
    table, columns = VIEWS[name]
    return load(spark, sf, table).selectExpr(*[f"{expression.replace('VARCHAR(10)', 'STRING')} AS {c}" for c, expression in columns.items()])


def cte(*names: str) -> str:
    return "WITH " + ", ".join(f"{n} AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in VIEWS[n][1].items()) + f" FROM {VIEWS[n][0]})" for n in names)


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def unpivoted(row: DataFrame) -> DataFrame:
    """A one-row table of counters as (metric, n)."""
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("n")) for c in row.columns])).alias("x")).select("x.*")


def _union(*selects: str) -> str:
    return " UNION ALL ".join(selects)


_FILLED = "coalesce(trim(CAST({c} AS VARCHAR)), '') <> ''"


# ================================================================ scans, sinks that merge
@query(_union(
    "SELECT 'lookup' AS scan, p_partkey AS id FROM part WHERE p_partkey = 17", "SELECT 'children', l_linenumber FROM lineitem WHERE l_orderkey = 3", "SELECT * FROM (SELECT 'latest', o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 20)",
    "SELECT 'flagged', c_custkey FROM customer WHERE c_acctbal > 5000 AND (c_nationkey <> 3)"))
def small_scans(spark: SparkSession, sf: str) -> DataFrame:
    named = lambda df, n, c: df.select(F.lit(n).alias("scan"), F.col(c).cast("long").alias("id"))
    c = load(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") > 5000).alias("rich"), F.when(F.col("c_nationkey") == 3, "x").alias("closed"))
    return R.union_distinct(named(R.lookup(load(spark, sf, "part"), "p_partkey", 17), "lookup", "p_partkey"), named(R.latest(load(spark, sf, "orders"), "o_orderkey", 20), "latest", "o_orderkey"), named(R.flagged(c, "rich", unless_set="closed"), "flagged", "c_custkey")).unionAll(
        named(R.children(load(spark, sf, "lineitem"), "l_orderkey", 3), "children", "l_linenumber"))


@query(cte("papers") + """, m AS (SELECT paper_id, CASE WHEN k % 2 = 0 THEN 'filled' END AS abstract, CASE WHEN k % 3 = 0 THEN '10.9/x' END AS doi FROM papers)
SELECT paper_id, CASE WHEN coalesce(trim(p.abstract), '') = '' THEN coalesce(m.abstract, p.abstract) ELSE p.abstract END AS abstract, CASE WHEN coalesce(trim(p.doi), '') = '' THEN coalesce(m.doi, p.doi) ELSE p.doi END AS doi,
 concat_ws(',', CASE WHEN coalesce(trim(p.abstract), '') = '' AND m.abstract IS NOT NULL THEN 'abstract' END, CASE WHEN coalesce(trim(p.doi), '') = '' AND m.doi IS NOT NULL THEN 'doi' END) AS fields_added FROM papers p JOIN m USING (paper_id)""")
def fill_missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers").select("paper_id", "k", "abstract", "doi")
    m = p.select("paper_id", F.when(F.col("k") % 2 == 0, "filled").alias("abstract"), F.when(F.col("k") % 3 == 0, "10.9/x").alias("doi"))
    return merge.fill_missing(p.drop("k"), m, "paper_id", ["abstract", "doi"]).withColumn("fields_added", F.array_join("fields_added", ","))


@query(cte("papers") + """, n AS (SELECT paper_id, CASE WHEN k % 2 = 0 THEN title || ' revised' ELSE 'Short' END AS title, '10.5/n' AS doi, 'Venue N' AS venue, 'long new abstract text of the other source' AS abstract, CASE WHEN k % 4 = 0 THEN '/new.pdf' END AS pdf, year + 1 AS year FROM papers)
SELECT paper_id, coalesce(nullif(trim(p.doi), ''), n.doi) AS doi, coalesce(nullif(trim(p.venue), ''), n.venue) AS venue, CASE WHEN length(n.title) > length(p.title) THEN n.title ELSE p.title END AS title,
 CASE WHEN length(n.abstract) > coalesce(length(p.abstract), 0) THEN n.abstract ELSE p.abstract END AS abstract, p.year AS year, 'A. One;B. Two;C. Three' AS authors, coalesce(n.pdf, p.pdf_path) AS pdf_path FROM papers p JOIN n USING (paper_id)""")
def paper_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    sides = lambda *names: F.array(*map(F.lit, names))
    old = p.select("paper_id", F.struct("doi", "venue", "url", "publisher", "title", "abstract", "year", "pdf_path", sides("A. One", "B. Two").alias("authors"), sides("s1").alias("sources")).alias("o"))
    title = F.when(F.col("k") % 2 == 0, F.concat("title", F.lit(" revised"))).otherwise("Short")
    new = p.select("paper_id", F.struct(F.lit("10.5/n").alias("doi"), F.lit("Venue N").alias("venue"), "url", "publisher", title.alias("title"), F.lit("long new abstract text of the other source").alias("abstract"), (F.col("year") + 1).alias("year"), F.when(F.col("k") % 4 == 0, "/new.pdf").alias("pdf_path"), sides("B. Two", "C. Three").alias("authors"), sides("s2").alias("sources")).alias("n"))
    cols = merge.merged_paper("o", "n")
    return old.join(new, "paper_id").select("paper_id", *[(F.array_join(c, ";") if n == "authors" else c).alias(n) for n, c in cols.items() if n in ("doi", "venue", "title", "abstract", "year", "authors", "pdf_path")])


@query(cte("papers", "citations") + ", d AS (SELECT lower(doi) AS d, min(paper_id) AS p FROM papers WHERE doi IS NOT NULL GROUP BY 1) SELECT seq, source_paper_id, coalesce(cited_paper_id, d.p) AS cited_paper_id FROM citations LEFT JOIN d ON lower(cited_doi) = d.d")
def citation_targets(spark: SparkSession, sf: str) -> DataFrame:
    return merge.with_internal_ids(view(spark, sf, "citations"), view(spark, sf, "papers").select("paper_id", "doi")).select("seq", "source_paper_id", "cited_paper_id")


@query(cte("papers") + ", c AS (SELECT paper_id, k, status, 1 AS tt FROM papers WHERE k % 2 = 0 UNION ALL SELECT paper_id, k, CASE WHEN k % 4 = 0 THEN NULL ELSE 'changed' END, 2 FROM papers WHERE k % 3 = 0), l AS (SELECT paper_id, (arg_max(struct_pack(s := status), tt)).s AS s FROM c GROUP BY paper_id) SELECT paper_id, coalesce(l.s, p.status) AS status, p.venue AS venue FROM papers p LEFT JOIN l USING (paper_id)")
def column_upsert(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers").select("paper_id", "k", "status", "venue")
    first = p.where("k % 2 = 0").select("paper_id", "status", F.lit(1).alias("at"))
    second = p.where("k % 3 = 0").select("paper_id", F.when(F.col("k") % 4 == 0, None).otherwise("changed").alias("status"), F.lit(2).alias("at"))
    return merge.upsert(p.drop("k"), first.unionByName(second), "paper_id", "at").select("paper_id", "status", "venue")


# ================================================================ scalar rules
_NAME = "lower(regexp_replace(p_name, ' ', '_', 'g'))"


@query("""SELECT p_partkey AS id, '10.1234/a.' || p_partkey AS library, 'the ' || p_name || ' of it' AS seen, CASE WHEN p_partkey % 4 = 0 THEN left(md5('row ' || p_partkey), 12) ELSE left('thea' || p_partkey || 'z', 30) END AS slug, 'title:' || sha1(lower(trim(p_name))) AS queue,
 'Doe, J.|Roe, A.' AS authors, 'journal of ' || lower(p_brand) || ' and more' AS venue, p_size || '-' || (p_size + 9) AS pages, 'job_a_b_c_' || p_partkey || '_pdf' AS file, CASE WHEN p_partkey % 2 = 0 THEN 'old' || chr(10) || 'note' ELSE 'a note' END AS notes,
 '10.1016.j.x.' || p_partkey AS filename_doi, '10.5/q' || p_partkey AS citation_doi, '10.12345/d.' || p_partkey AS document_doi, 'smith;jones-lee' AS surnames FROM part""")
def paper_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The small normalising rules side by side, on texts built from parts."""
    k = F.col("p_partkey").cast("string")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("id"), N.doi_library(text("https://dx.doi.org/10.1234/A.", k)).alias("library"), N.seen_key(text("The: ", F.col("p_name"), "  of it!")).alias("seen"),
        N.slug_id(F.when(F.col("p_partkey") % 4 == 0, "").otherwise(text("The a-", k, " z")), text("row ", k)).alias("slug"), N.queue_key(text(" ", F.col("p_name"), " ")).alias("queue"),
        F.array_join(N.authors_from_field(F.lit("Doe, J.; Roe, A.")), "|").alias("authors"), N.venue(text("Journal of ", F.col("p_brand"), "  & More ")).alias("venue"),
        N.pages(text("x, ", F.col("p_size").cast("string"), " – ", (F.col("p_size") + 9).cast("string"), ".")).alias("pages"), N.safe_filename(text("job:a/b\\c ", k, ".pdf")).alias("file"),
        N.append_note(F.when(F.col("p_partkey") % 2 == 0, "old").otherwise("a note"), "note").alias("notes"), N.doi_in_filename(text("10_1016_j_x_", k)).alias("filename_doi"), N.doi_citation(text(" HTTPS://DOI.ORG/10.5/Q", k)).alias("citation_doi"),
        N.doi_in_document(text("see 10.12345/D.", k, ").")).alias("document_doi"), F.array_join(N.surnames(F.array(F.lit("Smith, J."), F.lit("Anne Jones-Lee"), F.lit("Smith, K."))), ";").alias("surnames"),
    )


_T = "list_distinct(list_filter(regexp_extract_all(lower({c}), '([a-z0-9]+)', 1), lambda t: length(t) >= 3))"


@query(cte("papers") + f""", b AS (SELECT paper_id, k, year, doi, abstract, {_T.format(c='title')} AS t, {_T.format(c="title || CASE WHEN k % 2 = 0 THEN ' again and more' ELSE '' END")} AS o FROM papers),
s AS (SELECT *, len(list_intersect(t, o)) / len(list_distinct(list_concat(t, o))) AS j, len(list_intersect(t, o)) / len(t) AS st, len(list_intersect(t, o)) / len(o) AS so, k % 3 AS apart FROM b),
r AS (SELECT paper_id, j + CASE apart WHEN 0 THEN 0.2 WHEN 1 THEN 0.05 ELSE -0.15 END + CASE WHEN k % 2 = 0 THEN 0.1 ELSE 0 END + CASE WHEN coalesce(trim(abstract), '') <> '' THEN 0.08 ELSE 0 END + CASE WHEN coalesce(trim(doi), '') <> '' THEN 0.05 ELSE 0 END AS repair,
 0.6 * st + CASE apart WHEN 0 THEN 0.3 WHEN 1 THEN 0.15 ELSE 0 END + CASE WHEN coalesce(doi, '') <> '' THEN 0.1 ELSE 0 END AS enrich, CASE WHEN k % 2 = 0 THEN 0.35 ELSE 0 END + CASE WHEN apart = 0 THEN 0.2 ELSE 0 END + 0.45 * least(st, so) AS raw, k, least(st, so) AS lo FROM s),
c AS (SELECT *, CASE WHEN lo < 0.4 THEN least(raw, 0.5) ELSE raw END AS capped FROM r)
SELECT paper_id, round(repair, 6) AS repair, round(enrich, 6) AS enrich, round(CASE WHEN k % 2 <> 0 AND capped > 0.5 THEN least(capped, 0.6) ELSE capped END, 6) AS catalogue FROM c""")
def match_scores(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers").select("paper_id", "k", "year", "doi", "abstract", N.tokens(F.col("title")).alias("t"), N.tokens(F.concat("title", F.when(F.col("k") % 2 == 0, " again and more").otherwise(""))).alias("o"), (F.col("year") + F.col("k") % 3).alias("y2"))
    author, other = F.lit("Smith"), F.when(F.col("k") % 2 == 0, "J. Smith").otherwise("A. Jones")
    return p.select(
        "paper_id", F.round(SIM.repair_score(F.col("t"), F.col("o"), F.col("year"), F.col("y2"), author, F.array(other), F.col("abstract"), F.col("doi")), 6).alias("repair"),
        F.round(SIM.enrich_score(F.col("t"), F.col("o"), F.col("year"), F.col("y2"), F.col("doi")), 6).alias("enrich"), F.round(SIM.catalogue_score(F.lit("smith"), other, F.col("year"), F.col("y2"), F.col("t"), F.col("o")), 6).alias("catalogue"),
    )


@query("""SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '10.1016.j.' || p_partkey END AS doi, CASE WHEN p_partkey % 3 <> 0 THEN (1980 + p_size % 40)::INT END AS year, CASE WHEN p_partkey % 3 <> 0 THEN 'Smith' ELSE '' END AS authors,
 CASE WHEN p_partkey % 3 <> 0 THEN 'Daylight And Focus X' || translate(CAST(p_partkey AS VARCHAR), '0123456789', 'abcdefghij') END AS title, CASE WHEN p_partkey % 3 = 0 THEN 0.9 ELSE 0.9 END::DOUBLE AS confidence FROM part""")
def filename_parse(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey").cast("string")
    name = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("10_1016_j_"), k, F.lit(".pdf"))).otherwise(F.concat(F.lit("Smith_"), (1980 + F.col("p_size") % 40).cast("string"), F.lit("_daylight_and_focus_x"), F.translate(k, "0123456789", "abcdefghij"), F.lit(".pdf")))
    return load(spark, sf, "part").select(F.col("p_partkey").alias("id"), P.parse_filename(name).alias("m")).select("id", "m.doi", "m.year", F.array_join("m.authors", ";").alias("authors"), "m.title", F.round("m.confidence", 4).alias("confidence"))


@query("SELECT * FROM (VALUES ('doi', 'Article Link', 0), ('url', 'Article Link', 0), ('title', 'Paper Title', 0), ('year', 'When', 0), ('authors', 'Author Names', 0), ('abstract', 'Abstrakt', 0)) AS v(field, header, n) UNION ALL SELECT 'rows', 'preview', 5")
def column_detection(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of a table by their headers and contents, and its preview."""
    t = view(spark, sf, "papers").where("doi is not null").select(F.col("doi").alias("Article Link"), F.col("title").alias("Paper Title"), F.col("year").cast("string").alias("When"), F.lit("A. Smith").alias("Author Names"), F.col("abstract").alias("Abstrakt"))
    found, rows = ingest.preview(t, 5)
    named = spark.createDataFrame([(f, h, 0) for f, h in found.items()], "field string, header string, n long")
    return named.unionAll(rows.agg(F.lit("rows"), F.lit("preview"), F.count("*")))


@query("""WITH k AS (SELECT unnest(['openalex', 'crossref', 'semantic_scholar', 'unpaywall', 'pubmed']) AS source)
SELECT source, p_partkey AS id, '10.1/x' || p_partkey AS doi, 'On ' || p_name AS title, CASE source WHEN 'pubmed' THEN 'Doe;Roe' ELSE 'J Doe;A Roe' END AS authors, (1980 + p_size)::INT AS year, 'Journal ' || p_brand AS venue,
 CASE source WHEN 'unpaywall' THEN NULL ELSE 'Words of ' || p_name END AS abstract FROM part, k""")
def api_records(spark: SparkSession, sf: str) -> DataFrame:
    p = spread(load(spark, sf, "part")).select(F.col("p_partkey").alias("id"), "p_name", "p_brand", (1980 + F.col("p_size")).alias("y"))
    doi, title, venue, words = F.concat(F.lit("10.1/X"), F.col("id").cast("string")), F.concat(F.lit("On "), "p_name"), F.concat(F.lit("Journal "), "p_brand"), F.concat(F.lit("Words of "), "p_name")
    name = lambda given, family: F.struct(F.lit(given).alias("given"), F.lit(family).alias("family"))
    both = F.array(name("J", "Doe"), name("A", "Roe"))
    full = F.array(F.lit("J Doe"), F.lit("A Roe"))
    raw = {
        "openalex": F.to_json(F.struct(F.concat(F.lit("https://doi.org/"), doi).alias("doi"), title.alias("title"), F.col("y").alias("publication_year"), N.to_inverted_index(words).alias("abstract_inverted_index"), F.transform(full, lambda n: F.struct(F.struct(n.alias("display_name")).alias("author"))).alias("authorships"), F.array(F.struct(F.struct(venue.alias("display_name")).alias("source"))).alias("locations"))),
        "crossref": F.to_json(F.struct(doi.alias("DOI"), F.array(title).alias("title"), both.alias("author"), F.struct(F.array(F.array("y")).alias("date-parts")).alias("published"), F.array(venue).alias("container-title"), F.concat(F.lit("<p>"), words, F.lit("</p>")).alias("abstract"))),
        "semantic_scholar": F.to_json(F.struct(title.alias("title"), F.col("y").alias("year"), words.alias("abstract"), venue.alias("venue"), F.transform(full, lambda n: F.struct(n.alias("name"))).alias("authors"), F.struct(doi.alias("DOI")).alias("externalIds"))),
        "unpaywall": F.to_json(F.struct(doi.alias("doi"), title.alias("title"), F.col("y").alias("year"), venue.alias("journal_name"), both.alias("z_authors"))),
    }
    xml = F.concat(F.lit('<A><ArticleId IdType="doi">'), doi, F.lit("</ArticleId><ArticleTitle>"), title, F.lit("</ArticleTitle><Author><LastName>Doe</LastName></Author><Author><LastName>Roe</LastName></Author><PubDate><Year>"), F.col("y").cast("string"), F.lit("</Year></PubDate><Journal><Title>"), venue, F.lit("</Title></Journal><AbstractText>"), words, F.lit("</AbstractText></A>"))
    each = F.explode(F.array(*[P.normalise_record(j, api) for api, j in raw.items()], P.normalise_pubmed(xml)))
    return p.select("id", each.alias("r")).select("r.source", "id", "r.doi", "r.title", F.array_join("r.authors", ";").alias("authors"), "r.year", "r.venue", "r.abstract")


@query("""WITH v AS (SELECT lower(n_name) AS n, n_nationkey AS id FROM nation), t AS (SELECT n_name || CASE WHEN n_nationkey % 3 = 1 THEN 's' WHEN n_nationkey % 3 = 2 THEN ' xyzabc' ELSE '' END AS term, n_nationkey AS id FROM nation)
SELECT term, CASE WHEN id % 3 < 2 THEN id END AS term_id, CASE id % 3 WHEN 0 THEN 1.0 WHEN 1 THEN round(2.0 * (length(term) - 1) / (2 * length(term) - 1), 6) END::DOUBLE AS score, (id % 3 = 2) AS to_review FROM t""")
def term_resolution(spark: SparkSession, sf: str) -> DataFrame:
    n = load(spark, sf, "nation")
    k = F.col("n_nationkey") % 3
    terms = n.select(F.concat("n_name", F.when(k == 1, "s").when(k == 2, " xyzabc").otherwise("")).alias("term"))
    done, review = sinks.review_queue(P.resolve_terms(terms, n.select(F.col("n_nationkey").alias("term_id"), F.col("n_name").alias("name"))))
    return done.select("term", "term_id", F.round("score", 6).alias("score"), F.lit(False).alias("to_review")).unionByName(review.select("term", F.lit(None).cast("int").alias("term_id"), F.lit(None).cast("double").alias("score"), F.lit(True).alias("to_review")))


_EFFECT = "array<struct<id:string,role:string,direction:string>>"


@query("""SELECT 'c' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS claim_id, 'p' || l_partkey AS paper_id, 'causal' AS claim_type, 'f' || l_partkey AS factor, 'o' || l_suppkey AS outcome, 'trial' AS design, l_quantity::INT AS sample_n, 'office' AS setting, 'd' AS effect_size_type, l_discount AS effect_size_value,
 l_tax AS p_value, l_discount - 1 AS ci95_low, CASE WHEN l_linenumber % 2 = 0 THEN l_discount + 1 END AS ci95_high, 'run-1' AS ae_run_id FROM lineitem""")
def claims_flat(spark: SparkSession, sf: str) -> DataFrame:
    """Claims as JSON records, read by their schema and flattened."""
    li = load(spark, sf, "lineitem")
    one = lambda prefix, c: F.array(F.struct(F.concat(F.lit(prefix), F.col(c).cast("string")).alias("id"), F.lit("r").alias("role")))
    ci = F.when(F.col("l_linenumber") % 2 == 0, F.array(F.col("l_discount") - 1, F.col("l_discount") + 1)).otherwise(F.array(F.col("l_discount") - 1))
    record = F.to_json(F.struct(
        F.concat(F.lit("c"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("claim_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("paper_id"), F.lit("causal").alias("claim_type"),
        F.struct(one("f", "l_partkey").alias("environment_factors"), one("o", "l_suppkey").alias("outcomes")).alias("constructs"),
        F.struct(F.lit("trial").alias("design"), F.struct(F.col("l_quantity").cast("int").alias("n")).alias("sample"), F.array(F.struct(F.lit("s1").alias("id"), F.lit("office").alias("value"))).alias("setting")).alias("study"),
        F.struct(F.struct(F.lit("d").alias("type"), F.col("l_discount").alias("value")).alias("effect_size"), F.col("l_tax").alias("p_value"), ci.alias("ci95")).alias("statistics"),
    ))
    flat = P.flat_claims(li.select(F.from_json(record, P.CLAIM_RECORD).alias("c")).select("c.*"), F.lit("run-1"))
    return flat.select("claim_id", "paper_id", "claim_type", F.col("environment_factors")[0]["id"].alias("factor"), F.col("outcomes")[0]["id"].alias("outcome"), "design", "sample_n", "setting", "effect_size_type", "effect_size_value", "p_value", "ci95_low", "ci95_high", "ae_run_id")


@query("""SELECT 'r' || p_partkey AS rule_id, 'p' || p_partkey AS paper_id, 'positive' AS polarity, 'adults' AS population, 'c' || p_partkey AS evidence, p_size / 50 AS strength_value, CASE WHEN p_partkey % 3 = 0 THEN 'missing_rhs' WHEN p_partkey % 3 = 1 THEN 'bad_polarity' ELSE '' END AS problems FROM part""")
def rules_flat(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    side = F.array(F.struct(F.lit("v").alias("var"), F.lit("up").alias("state")))
    record = F.to_json(F.struct(
        F.concat(F.lit("r"), k).alias("rule_id"), F.concat(F.lit("p"), k).alias("paper_id"), F.lit("edge").alias("rule_type"), side.alias("lhs"), F.when(F.col("p_partkey") % 3 != 0, side).alias("rhs"), F.lit("positive").alias("polarity"),
        F.struct((F.col("p_size") / 50).alias("value")).alias("strength"), F.struct(F.array(F.struct(F.lit("adults").alias("id"))).alias("population")).alias("applicability"), F.array(F.struct(F.concat(F.lit("c"), k).alias("claim_id"))).alias("evidence_links"),
    ))
    flat = P.flat_rules(p.select(F.from_json(record, P.RULE_RECORD).alias("r"), F.col("p_partkey")).select("r.*"))
    odd = flat.withColumn("polarity", F.when(F.expr("cast(substring(rule_id, 2) as bigint) % 3 = 1"), "sideways").otherwise(F.col("polarity")))
    return odd.select("rule_id", "paper_id", F.lit("positive").alias("polarity"), "population", F.array_join("evidence_links", ",").alias("evidence"), "strength_value", F.array_join(synthesis.rule_problems(("positive", "negative", "null")), ",").alias("problems"))


# ================================================================ predicates, gates, cells
@query(cte("papers") + ", s AS (SELECT paper_id, status FROM papers) SELECT paper_id, CASE WHEN status = 'candidate' THEN 'processed_fail' ELSE 'processed_fail' END AS finder FROM s WHERE status <> 'downloaded' UNION ALL SELECT paper_id, 'processed_success' FROM s WHERE status = 'downloaded' UNION ALL SELECT 'x' || paper_id, 'processed_partial' FROM s WHERE status = 'downloaded'")
def finder_states(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers").select("paper_id", F.when(F.col("status") == "downloaded", "SUCCESS").otherwise("FAIL").alias("s"))
    rows = p.unionByName(p.where("s = 'SUCCESS'").select(F.concat(F.lit("x"), "paper_id").alias("paper_id"), F.lit("PARTIAL_SUCCESS").alias("s")))
    return rows.select("paper_id", P.finder_status(F.col("s")).alias("finder"))


_GATE = cte("papers") + """, c AS (SELECT paper_id, year, abstract, year % 4 AS depth, (year % 50) / 50 AS score, year % 3 = 0 AS strong FROM papers),
l AS (SELECT *, 0.4 - CASE WHEN strong THEN 0.1 ELSE 0 END AS lim FROM c),
g AS (SELECT *, CASE WHEN depth > 2 THEN 'Exceeds' WHEN coalesce(abstract, '') = '' THEN 'No' WHEN score < lim THEN 'Below' ELSE 'Relevant' END AS why FROM l)"""


def _gated(spark: SparkSession, sf: str) -> DataFrame:
    c = view(spark, sf, "papers").select("paper_id", "year", "abstract", (F.col("year") % 4).alias("depth"), ((F.col("year") % 50) / 50).alias("score"))
    facets = F.array(F.struct(F.lit("outcomes").alias("facet"), F.when(F.col("year") % 3 == 0, 0.9).otherwise(0.1).alias("score")))
    return c.withColumn("g", expansion.gate(F.col("score"), F.col("depth"), F.col("abstract"), facets, need_abstract=True)).select("paper_id", "g.ok", "g.reason")


@query(_GATE + " SELECT paper_id, why = 'Relevant' AS ok, CASE why WHEN 'Exceeds' THEN 'Exceeds max depth (' || depth || ' > 2)' WHEN 'No' THEN 'No abstract available' WHEN 'Below' THEN printf('Below threshold (%.2f < %.2f)', score, lim) ELSE printf('Relevant (%.2f)', score) END AS reason FROM g")
def expansion_gate(spark: SparkSession, sf: str) -> DataFrame:
    return _gated(spark, sf)


@query(_GATE + ", n AS (SELECT count(*) AS a, count(*) FILTER (why = 'Relevant') AS b, count(*) FILTER (why = 'Below') AS c, count(*) FILTER (why = 'Exceeds') AS d FROM g) " + _union("SELECT 'candidates' AS metric, a::DOUBLE AS n FROM n", "SELECT 'queued', b FROM n", "SELECT 'rejected', a - b FROM n", "SELECT 'below_threshold', c FROM n", "SELECT 'too_deep', d FROM n", "SELECT 'acceptance_rate', round(b / a, 6) FROM n"))
def expansion_counters(spark: SparkSession, sf: str) -> DataFrame:
    return unpivoted(expansion.expansion_stats(_gated(spark, sf)).withColumn("acceptance_rate", F.round("acceptance_rate", 6)))


@query(cte("papers") + """, c AS (SELECT paper_id, citation_count, trim(regexp_replace(replace(lower(venue), '&', 'and'), '\\s+', ' ', 'g')) AS v FROM papers WHERE topic_decision = 'off_topic' OR triage_decision = 'reject')
SELECT paper_id, concat_ws(';', CASE WHEN v = 'brand#3' THEN 'allowlist' END, CASE WHEN v = 'brand#7' OR regexp_matches(v, '\\bneuro|\\bbrain') THEN 'neuroscience' END, CASE WHEN citation_count >= 150 THEN 'high_citation>=150' END) AS protected_reasons FROM c""")
def reject_protection(spark: SparkSession, sf: str) -> DataFrame:
    venue = lambda v: spark.range(1).select(F.lit(v).alias("venue"))
    lower = lambda d: d.select(N.venue(F.col("venue")).alias("venue"))
    return audit.reject_candidates(view(spark, sf, "papers"), lower(venue("Brand#3")), lower(venue("Brand#7"))).select("paper_id", "protected_reasons")


@query(cte("papers") + " SELECT paper_id FROM papers WHERE coalesce(triage_score, 0) = 0 OR taxonomy_version IS DISTINCT FROM 'v2'")
def rescore_needed(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.needs_scoring(view(spark, sf, "papers"), version="v2").select("paper_id")


@query(cte("papers", "files") + " SELECT paper_id FROM papers WHERE coalesce(trim(doi), '') <> '' AND (pdf_path IS NULL OR pdf_path NOT IN (SELECT path FROM files WHERE sha256 <> ''))")
def download_list(spark: SparkSession, sf: str) -> DataFrame:
    return audit.download_candidates(view(spark, sf, "papers"), view(spark, sf, "files").where("sha256 <> ''")).select("paper_id")


def _tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Factors (regions), outcomes (brands, every third one neural) and theories (nations) as taxonomy nodes."""
    factors = load(spark, sf, "region").select(F.concat(F.lit("env.luminous."), F.lower("r_name")).alias("node_id")).unionByName(load(spark, sf, "region").select(F.concat(F.lit("env.air."), F.lower("r_name")).alias("node_id")))
    outcomes = load(spark, sf, "part").select(F.concat(F.when(F.substring("p_brand", 7, 2).cast("int") % 3 == 0, "out.neural.").otherwise("out.cognitive."), F.lower("p_brand")).alias("node_id")).distinct()
    theories = load(spark, sf, "nation").select(F.concat(F.lit("theory."), F.lower("n_name")).alias("node_id"))
    return factors, outcomes, theories


_CELLS = """WITH f AS (SELECT 'env.luminous.' || lower(r_name) AS factor_id FROM region UNION ALL SELECT 'env.air.' || lower(r_name) FROM region),
o AS (SELECT DISTINCT CASE WHEN substr(p_brand, 7, 2)::INT % 3 = 0 THEN 'out.neural.' ELSE 'out.cognitive.' END || lower(p_brand) AS outcome_id FROM part),
g AS (SELECT *, CASE WHEN starts_with(outcome_id, 'out.cognitive') THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM f, o),
c AS (SELECT factor_id || '_' || outcome_id AS cell_id, 'factor_outcome' AS cell_type, factor_id, outcome_id, priority FROM g UNION ALL SELECT 'theory:theory.' || lower(n_name), 'theory', 'theory.' || lower(n_name), '', 'HIGH' FROM nation
 UNION ALL SELECT 'neural:' || factor_id || '_' || outcome_id, 'neural', factor_id, outcome_id, 'HIGH' FROM g WHERE contains(outcome_id, 'neural') UNION ALL SELECT 'mechanism:' || factor_id || '_' || outcome_id, 'mechanism', factor_id, outcome_id, 'MEDIUM' FROM g WHERE priority = 'HIGH')"""


@query(_CELLS + " SELECT * FROM c")
def search_cells(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.search_cells(*_tree(spark, sf))


@query(_CELLS + " SELECT cell_id, cell_type FROM c WHERE priority = 'HIGH' ORDER BY CASE cell_type WHEN 'theory' THEN 1 WHEN 'neural' THEN 2 WHEN 'mechanism' THEN 3 ELSE 4 END, cell_id")
def cell_selection(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.select_cells(gaps.search_cells(*_tree(spark, sf)), prio="HIGH").select("cell_id", "cell_type")


_PROGRESS = ", s AS (SELECT *, CASE WHEN length(cell_id) % 3 = 0 THEN 'complete' ELSE 'pending' END AS status, CASE WHEN length(cell_id) % 5 > 0 THEN length(cell_id) % 5 END AS papers_found FROM c)"


@query(_CELLS + _PROGRESS + " SELECT priority, count(*) AS cells, count(*) FILTER (status = 'complete') AS complete, sum(papers_found)::BIGINT AS papers, count(*) FILTER (coalesce(papers_found, 0) < 3) AS under_filled FROM s GROUP BY priority")
def cell_progress(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("cell_id")
    cells = gaps.search_cells(*_tree(spark, sf)).withColumn("status", F.when(n % 3 == 0, "complete").otherwise("pending")).withColumn("papers_found", F.when(n % 5 > 0, n % 5))
    return gaps.cell_status(cells)


# ================================================================ duplicates, inventory, library
_KNOWN = cte("papers") + ", kn AS (SELECT paper_id AS known_id, doi, title, k AS seq FROM papers)"


@query(cte("papers") + """, q AS (SELECT 'n' || k AS new_id, k, paper_id, doi, title FROM papers)
SELECT new_id, CASE k % 4 WHEN 0 THEN CASE WHEN doi IS NOT NULL THEN paper_id ELSE paper_id END WHEN 1 THEN paper_id WHEN 2 THEN paper_id END AS known_id,
 CASE k % 4 WHEN 0 THEN CASE WHEN doi IS NOT NULL THEN 'doi' ELSE 'title_exact' END WHEN 1 THEN 'title_exact' WHEN 2 THEN 'author_title' END AS match_type,
 CASE k % 4 WHEN 0 THEN CASE WHEN doi IS NOT NULL THEN 1.0 ELSE 0.95 END WHEN 1 THEN 0.95 WHEN 2 THEN 0.49 END::DOUBLE AS confidence FROM q""")
def duplicate_check(spark: SparkSession, sf: str) -> DataFrame:
    """The cascade DOI, title key, fuzzy title, author and title, on papers built so that the deciding tier is known."""
    letters = F.translate(F.col("k").cast("string"), "0123456789", "abcdefghij")
    p = view(spark, sf, "papers").select("paper_id", "k", "doi", F.concat("title", F.lit(" tag"), letters).alias("title"))
    own = F.array(F.concat(F.lit("Sur"), letters, F.lit(", A.")))
    # Five key terms of a known paper, words of its own; a new one shares two of them and the author. Its other three are no
    # paper's own: however long the number, the ratio stays below 4/7 and the title under 50 characters.
    words = lambda *names: F.concat_ws(" ", *[F.concat(F.lit(n), letters) for n in names])
    known_title = F.when(F.col("k") % 4 == 2, words("alph", "brav", "corr", "dayl", "entr")).otherwise(F.col("title"))
    known = p.select(F.col("paper_id").alias("known_id"), "doi", known_title.alias("title"), own.alias("authors"), F.col("k").alias("seq"))
    short = F.concat(words("alph", "brav"), F.lit(" qqqq wwww zzzz"))
    doi = F.when(F.col("k") % 4 == 0, F.upper("doi"))
    title = F.when(F.col("k") % 4 == 0, F.col("title")).when(F.col("k") % 4 == 1, F.concat(F.lit("THE "), F.upper("title"))).when(F.col("k") % 4 == 2, short).otherwise(words("unheard", "novelty"))
    new = p.select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("new_id"), doi.alias("doi"), title.alias("title"), F.when(F.col("k") % 4 == 2, own).otherwise(F.array(F.lit("Nobody, Z."))).alias("authors"))
    return dedup.check_duplicates(new, known).withColumn("confidence", F.round("confidence", 6))


@query(cte("papers") + """, q AS (SELECT k, translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghij') AS w FROM papers), t AS (SELECT k, 'candlelight dorm' || w || ' even' || w || ' word' || w AS known, 'candlelight dorm' || w || ' even' || w || ' word' || w || 's' AS new FROM q)
SELECT 'n' || k AS new_id, 'p' || k AS known_id, CASE WHEN 2.0 * length(known) / (length(known) + length(new)) >= 0.95 THEN round(2.0 * length(known) / (length(known) + length(new)), 6) ELSE round(1.8 * length(known) / (length(known) + length(new)), 6) END::DOUBLE AS confidence FROM t""")
def fuzzy_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Titles that differ by a closing letter, so the ratio of the alignment is known; all papers share the longest word."""
    own = F.translate(F.col("k").cast("string"), "0123456789", "abcdefghij")
    w = F.concat(F.lit("candlelight dorm"), own, F.lit(" even"), own, F.lit(" word"), own)
    p = view(spark, sf, "papers").select("paper_id", "k", w.alias("title"), F.array().cast("array<string>").alias("authors"))
    new = p.select(F.concat(F.lit("n"), F.col("k").cast("string")).alias("new_id"), F.concat("title", F.lit("s")).alias("title"), "authors")
    return dedup.fuzzy_title_matches(new, p.withColumnRenamed("paper_id", "known_id")).select("new_id", "known_id", F.round("confidence", 6).alias("confidence"))


@query(cte("papers") + """, r AS (SELECT * FROM papers WHERE k % 10 <> 3), c AS (SELECT paper_id FROM papers WHERE k % 4 <> 1)
SELECT paper_id, CASE WHEN k % 2 = 0 THEN 'Authoritative ' || k ELSE title END AS title, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 2 = 0 THEN 2001 END ELSE year END AS year, coalesce(doi, CASE WHEN k % 2 = 0 THEN '10.7/t' || k END) AS doi FROM r SEMI JOIN c USING (paper_id)""")
def inventory_current(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    registry = p.select("paper_id", "title", F.when(F.col("k") % 3 != 0, F.col("year")).alias("year"), "doi")
    titles = p.where("k % 2 = 0").select("paper_id", F.concat(F.lit("Authoritative "), F.col("k").cast("string")).alias("title_authoritative"), F.lit(2001).alias("publication_year"), F.concat(F.lit("10.7/t"), F.col("k").cast("string")).alias("doi"))
    return dedup.inventory(registry, p.where("k % 10 = 3").select(F.col("paper_id").alias("superseded_paper_id")), p.select("paper_id", (F.col("k") % 4 != 1).alias("is_canonical")), titles)


_MATCH = cte("papers") + """, i AS (SELECT 'i' || k AS id, doi AS d, trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g')) AS t, year AS y FROM papers UNION ALL SELECT 'j' || k, NULL, trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g')), year FROM papers WHERE k % 5 = 0),
q AS (SELECT paper_id, k, CASE WHEN k % 2 = 0 THEN doi END AS d, CASE WHEN k % 7 = 6 THEN 'unknown thing ' || k ELSE trim(regexp_replace(lower(title), '[^a-z0-9 ]', '', 'g')) END AS t, CASE WHEN k % 3 = 0 THEN year ELSE 1900 END AS y FROM papers),
a AS (SELECT d, count(DISTINCT id) AS n FROM i WHERE d IS NOT NULL GROUP BY d), b AS (SELECT t, y, count(DISTINCT id) AS n FROM i GROUP BY t, y), c AS (SELECT t, count(DISTINCT id) AS n FROM i GROUP BY t),
m AS (SELECT q.paper_id, coalesce(a.n, b.n, c.n, 0) AS n, CASE WHEN a.n IS NOT NULL THEN 'exact_doi' WHEN b.n IS NOT NULL THEN 'exact_title_year' WHEN c.n IS NOT NULL THEN 'exact_title' ELSE 'none' END AS basis FROM q LEFT JOIN a ON a.d = q.d LEFT JOIN b ON b.t = q.t AND b.y = q.y LEFT JOIN c ON c.t = q.t)"""


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    p = view(spark, sf, "papers")
    i = p.select(F.concat(F.lit("i"), F.col("k").cast("string")).alias("paper_id"), "doi", "title", "year").unionByName(p.where("k % 5 = 0").select(F.concat(F.lit("j"), F.col("k").cast("string")).alias("paper_id"), F.lit(None).cast("string").alias("doi"), "title", "year"))
    q = p.select("paper_id", F.when(F.col("k") % 2 == 0, F.col("doi")).alias("doi"), F.when(F.col("k") % 7 == 6, F.concat(F.lit("unknown thing "), F.col("k").cast("string"))).otherwise(F.col("title")).alias("title"), F.when(F.col("k") % 3 == 0, F.col("year")).otherwise(1900).alias("year"))
    return q, i, dedup.match_inventory(q, i)


@query(_MATCH + """, s AS (SELECT *, CASE WHEN n = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS st FROM m), x AS (SELECT count(*) AS rows_total, count(*) FILTER (st = 'matched') AS matched, count(*) FILTER (st = 'unmatched') AS unmatched, count(*) FILTER (st = 'ambiguous') AS ambiguous,
 count(*) FILTER (st = 'matched' AND basis = 'exact_doi') AS matched_exact_doi, count(*) FILTER (st = 'matched' AND basis = 'exact_title_year') AS matched_exact_title_year, count(*) FILTER (st = 'matched' AND basis = 'exact_title') AS matched_exact_title, count(*) FILTER (st = 'ambiguous' AND basis = 'exact_title') AS ambiguous_exact_title FROM s)
SELECT metric, n::DOUBLE AS n FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE n)""")
def match_counters(spark: SparkSession, sf: str) -> DataFrame:
    return unpivoted(dedup.match_counters(_matched(spark, sf)[2]))


@query(_MATCH + """, e AS (SELECT paper_id, basis, n, row_number() OVER (PARTITION BY basis ORDER BY paper_id) AS r FROM m) SELECT paper_id, basis AS match_basis, n AS n_candidates FROM e WHERE r <= 10""")
def match_examples(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.examples(_matched(spark, sf)[2], "match_basis", "paper_id").select("paper_id", "match_basis", "n_candidates")


@query(_MATCH + " SELECT m.paper_id, i.id AS candidate FROM m JOIN q USING (paper_id) JOIN i ON CASE basis WHEN 'exact_doi' THEN i.d = q.d WHEN 'exact_title_year' THEN i.t = q.t AND i.y = q.y WHEN 'exact_title' THEN i.t = q.t END")
def match_candidates(spark: SparkSession, sf: str) -> DataFrame:
    return dedup.candidate_pairs(*_matched(spark, sf))


@query(cte("papers") + ", c AS (SELECT k, CASE WHEN k % 2 = 0 THEN '10.1234/P.' || (k * 2) ELSE '10.88/z' || k END AS doi, CASE WHEN k % 3 = 0 THEN 'Effects-- of' || CHR(32) || 'unseen ' || k ELSE title END AS title FROM papers) SELECT k FROM c WHERE lower(doi) NOT IN (SELECT lower(doi) FROM papers WHERE doi IS NOT NULL) AND k % 3 = 0")
def unseen_candidates(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    k = F.col("k").cast("string")
    c = p.select("k", F.when(F.col("k") % 2 == 0, F.concat(F.lit("10.1234/P."), (F.col("k") * 2).cast("string"))).otherwise(F.concat(F.lit("10.88/z"), k)).alias("doi"), F.when(F.col("k") % 3 == 0, F.concat(F.lit("Effects-- of unseen "), k)).otherwise(F.col("title")).alias("title"))
    return dedup.unseen(c, p.where("doi is not null").select("doi"), p.select("title")).select("k")


@query(cte("citations") + ", r AS (SELECT *, row_number() OVER (PARTITION BY coalesce(lower(cited_doi), 'row:' || seq) ORDER BY seq, source_paper_id) AS r FROM citations) SELECT lower(cited_doi) AS doi, count(*) AS n, min(seq) AS seq FROM r WHERE r = 1 AND cited_doi IS NOT NULL GROUP BY 1")
def first_by_doi(spark: SparkSession, sf: str) -> DataFrame:
    rows = view(spark, sf, "citations").where("cited_doi is not null").select(F.lower("cited_doi").alias("doi"), "seq")
    return dedup.first_by_doi(rows, "seq").groupBy("doi").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))


@query(cte("papers") + ", i AS (SELECT 'z' || k AS item_id, k, paper_id FROM papers) SELECT item_id, CASE k % 3 WHEN 0 THEN paper_id WHEN 1 THEN paper_id END AS paper_id, CASE k % 3 WHEN 0 THEN 'title' WHEN 1 THEN 'doi' ELSE 'none' END AS basis FROM i")
def library_match(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    k = F.col("k").cast("string")
    items = p.select(F.concat(F.lit("z"), k).alias("item_id"), F.when(F.col("k") % 3 == 1, F.concat(F.lit("https://doi.org/10.1234/P."), k)).alias("doi"), F.when(F.col("k") % 3 == 0, F.concat(F.upper("title"), F.lit("!"))).otherwise(F.concat(F.lit("other "), k)).alias("title"))
    return ingest.match_library(items, p.select("paper_id", "doi", "title"))


@query(cte("papers") + " SELECT '/in/Smith_2001_' || replace(lower(title), ' ', '_') || '.pdf' AS path, paper_id AS known_id, 'title_exact' AS match_type FROM (SELECT paper_id, regexp_replace(title, '[0-9]+$', '') || 'no' || translate(CAST(k AS VARCHAR), '0123456789', 'abcdefghij') AS title FROM papers)")
def file_match(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers").withColumn("title", F.concat(F.regexp_replace("title", "[0-9]+$", ""), F.lit("no"), F.translate(F.col("k").cast("string"), "0123456789", "abcdefghij")))
    files = p.select(F.concat(F.lit("/in/Smith_2001_"), F.replace(F.lower("title"), F.lit(" "), F.lit("_")), F.lit(".pdf")).alias("path"))
    known = p.select(F.col("paper_id").alias("known_id"), "doi", "title", F.array().cast("array<string>").alias("authors"), F.col("k").alias("seq"))
    return ingest.match_files(files, known).select("path", "known_id", "match_type")


# ================================================================ taxonomy and triage
_NODES = """WITH n AS (SELECT 'w.' || lower(r_name) AS node_id, 'place' AS facet_id, NULL AS parent_id, 1 AS level, r_name AS name, 0 AS n_seeds FROM region
 UNION ALL SELECT 'w.' || lower(r_name) || '.' || lower(n_name), 'place', 'w.' || lower(r_name), 2, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 0 END FROM nation JOIN region ON r_regionkey = n_regionkey)"""


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    """Regions and nations as a parsed taxonomy, read as its table."""
    rows = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).orderBy("n_nationkey").collect()  # 25 rows, as a taxonomy file has them
    tree: dict[str, dict] = {r["r_name"]: {"id": f"w.{r['r_name'].lower()}", "name": r["r_name"], "children": []} for r in rows}
    for r in rows:
        tree[r["r_name"]]["children"].append({"id": f"w.{r['r_name'].lower()}.{r['n_name'].lower()}", "name": r["n_name"], "seeds": ["seed"] if r["n_nationkey"] % 2 == 0 else []})
    return readers.read_taxonomy(spark, {"place": list(tree.values())})


@query(_NODES + " SELECT node_id, facet_id, parent_id, level, name, n_seeds FROM n WHERE parent_id IS NOT NULL OR node_id IN (SELECT parent_id FROM n)")
def taxonomy_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _nodes(spark, sf).select("node_id", "facet_id", "parent_id", "level", "name", F.size("seeds").alias("n_seeds"))


@query(_NODES + " SELECT facet_id, level, count(*) AS nodes, count(*) FILTER (n_seeds > 0) AS with_seeds FROM n WHERE parent_id IS NOT NULL OR node_id IN (SELECT parent_id FROM n) GROUP BY facet_id, level")
def taxonomy_summary(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.tree_summary(_nodes(spark, sf))


@query(_NODES + " SELECT node_id FROM n WHERE node_id = 'w.asia' OR starts_with(node_id, 'w.asia.')")
def taxonomy_subtree(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.subtree(_nodes(spark, sf), "w.asia").select("node_id")


_HIER = """WITH v AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
m AS (SELECT label, i, avg(x) AS m FROM v GROUP BY ALL), mn AS (SELECT label, sqrt(sum(m * m)) + 1e-10 AS n FROM m GROUP BY label), g AS (SELECT i, avg(x) AS g FROM v GROUP BY i), gn AS (SELECT sqrt(sum(g * g)) + 1e-10 AS n FROM g),
b AS (SELECT label, i, 0.7 * m / mn.n + 0.3 * g / gn.n AS b FROM m JOIN mn USING (label) JOIN g USING (i), gn), bn AS (SELECT label, sqrt(sum(b * b)) + 1e-10 AS n FROM b GROUP BY label)"""


@query(_HIER + " SELECT 'all.l' || label AS node_id, round(sum(b / n), 4) AS total, round(max(b / n), 4) AS most FROM b JOIN bn USING (label) GROUP BY label UNION ALL SELECT 'all', round(sum(g / n), 4), round(max(g / n), 4) FROM g, gn UNION ALL SELECT 'all.seedless', round(sum(g / n), 4), round(max(g / n), 4) FROM g, gn")
def centroid_hierarchy(spark: SparkSession, sf: str) -> DataFrame:
    """Own centroids blended with the parent's, level by level; a node without seeds takes its parent's."""
    e = load(spark, sf, "embeddings")
    own = taxonomy.centroids(e.withColumn("node_id", F.lit("all")), "node_id").unionByName(taxonomy.centroids(e.withColumn("node_id", F.concat(F.lit("all.l"), F.col("label").cast("string"))), "node_id"))
    leaves = e.select(F.concat(F.lit("all.l"), F.col("label").cast("string")).alias("node_id")).distinct().unionAll(spark.range(1).select(F.lit("all.seedless")))
    nodes = leaves.select("node_id", F.lit("all").alias("parent_id"), F.lit(2).alias("level")).unionAll(spark.range(1).select(F.lit("all"), F.lit(None).cast("string"), F.lit(1)))
    c = taxonomy.hierarchical_centroids(nodes, own, levels=2)
    return c.select("node_id", F.round(F.aggregate("centroid", F.lit(0.0), lambda a, x: a + x), 4).alias("total"), F.round(F.array_max("centroid"), 4).alias("most"))


@query(cte("papers") + """, s AS (SELECT paper_id, CASE WHEN k % 3 > 0 THEN (k % 100) / 100 END AS l3, (k % 80) / 100 AS l2, (k % 10) / 10 AS domain_score FROM papers)
SELECT paper_id, domain_score, CASE WHEN domain_score < 0.3 THEN 'reject' WHEN coalesce(l3 >= 0.65, FALSE) OR l2 >= 0.7 THEN 'send_to_eater' ELSE 'review' END AS decision FROM s""")
def domain_decisions(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers").select("paper_id", "k")
    scores = p.where("k % 3 > 0").select("paper_id", F.lit(3).alias("level"), (F.col("k") % 100 / 100).alias("score")).unionByName(p.select("paper_id", F.lit(2).alias("level"), (F.col("k") % 80 / 100).alias("score")))
    return taxonomy.domain_decision(scores, p.select("paper_id", (F.col("k") % 10 / 10).alias("domain_score")), "paper_id")


_ENV, _OUT, _EVI, _EXC = ["that", "para"], ["mente", "tion"], ["ough", "ing", "que"], ["nicht"]


@query("WITH h AS (SELECT doc_id, " + ", ".join(f"({' + '.join(f'contains(lower(text), {chr(39)}{t}{chr(39)})::INT' for t in terms)}) AS {n}" for n, terms in (("e", _ENV), ("o", _OUT), ("v", _EVI), ("x", _EXC))) + """ FROM documents), d AS (SELECT doc_id, CASE WHEN x > 0 THEN 'reject' WHEN e > 0 AND o > 0 AND v > 0 THEN 'accept' WHEN e > 0 AND o > 0 THEN 'edge_case' ELSE 'reject' END AS verdict FROM h),
g AS (SELECT *, CASE verdict WHEN 'accept' THEN 'send_to_eater' WHEN 'edge_case' THEN 'review' ELSE 'reject' END AS gate FROM d) SELECT doc_id, verdict, CASE WHEN gate = 'send_to_eater' THEN gate ELSE 'review' END AS decision FROM g""")
def question_gate(spark: SparkSession, sf: str) -> DataFrame:
    """Terms of a research question found in whole texts, the verdict, and the gate that only promotes a decision."""
    hits = lambda terms: taxonomy.question_hits(F.col("text"), F.array(*map(F.lit, terms)))
    verdict = taxonomy.question_verdict(hits(_ENV), hits(_OUT), hits(_EVI), hits(_EXC))
    d = load(spark, sf, "documents").select("doc_id", verdict.alias("verdict"))
    return d.select("doc_id", "verdict", taxonomy.merge_decision(F.lit("review"), taxonomy.verdict_decision(F.col("verdict"))).alias("decision"))


@query(cte("papers") + """ SELECT paper_id, CASE k % 4 WHEN 2 THEN 'rejected' ELSE CASE WHEN status = 'pending_scorer' AND k % 4 < 2 THEN 'candidate' ELSE status END END AS status, CASE k % 4 WHEN 0 THEN 'send_to_eater' WHEN 1 THEN 'review' WHEN 2 THEN 'reject' ELSE 'pending' END AS triage_decision,
 CASE k % 4 WHEN 0 THEN 'on_topic' WHEN 1 THEN 'possibly_off_topic' WHEN 2 THEN 'off_topic' ELSE 'needs_abstract' END AS topic_decision, 't' || (k % 5) AS topic_category, 'review' AS article_type, CASE WHEN k % 2 = 0 THEN 'q1' ELSE 'a1,e1' END AS matched_question_ids FROM papers""")
def backlog_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    by = lambda *v: F.element_at(F.array(*map(F.lit, v)), (F.col("k") % 4 + 1).cast("int"))
    none = F.lit(None).cast("array<string>")
    topic = F.concat(F.lit("t"), (F.col("k") % 5).cast("string"))
    intake = F.struct(by("accept_candidate", "manual_review", "reject_clear_false_positive", "later").alias("intake_decision"), by("on_domain", "near_domain", "clear_false_positive", "insufficient_metadata").alias("domain_relevance"), F.when(F.col("k") % 2 == 0, topic).alias("primary_topic"),
                      F.array(F.lit("x"), F.lit(" ")).alias("topic_candidates"), F.when(F.col("k") % 2 == 0, F.array(F.lit("q1"), F.lit(" "))).otherwise(none).alias("matched_question_ids"), none.alias("adjacent_topics"))
    payload = F.struct(intake.alias("intake_result"), F.struct(topic.alias("primary_topic")).alias("stable_topic_routing"), F.lit(0.8).alias("overall_confidence"), F.struct(F.lit("review").alias("value"), F.lit(0.7).alias("confidence")).alias("article_type"),
                       F.struct(F.array(F.lit("a1")).alias("accepted_question_ids"), F.array(F.lit("e1")).alias("edge_case_question_ids")).alias("question_summary"), F.lit(False).alias("needs_more_evidence"))
    out = taxonomy.backlog_fields(p.withColumn("payload", payload), "payload")
    return out.select("paper_id", "status", "triage_decision", "topic_decision", "topic_category", "article_type", F.array_join("matched_question_ids", ",").alias("matched_question_ids"))


@query(cte("papers") + " SELECT paper_id, 'topic' AS dimension, venue AS label, least(greatest(triage_score * 1.5 - 0.1, 0), 1) AS confidence, 'scorer' AS source FROM papers WHERE k % 3 <> 0")
def registry_facts(spark: SparkSession, sf: str) -> DataFrame:
    a = view(spark, sf, "papers").select("paper_id", F.when(F.col("k") % 3 == 0, " ").otherwise(F.col("venue")).alias("label"), (F.col("triage_score") * 1.5 - 0.1).alias("c"))
    return taxonomy.registry_facts(a, "topic", "label", "c", "scorer")


@query(cte("papers") + ", d AS (SELECT *, CASE WHEN triage_score >= 0.7 THEN 'send_to_eater' WHEN triage_score >= 0.4 THEN 'review' ELSE 'reject' END AS decision FROM papers WHERE triage_score IS NOT NULL) SELECT decision, count(*) AS n, min(paper_id) AS first_id, round(avg(triage_score), 6) AS mean_score FROM d GROUP BY decision")
def decision_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = view(spark, sf, "papers").where("triage_score is not null").select("paper_id", F.col("triage_score").cast("double").alias("triage_score")).withColumn("decision", taxonomy.decide(F.col("triage_score")))
    return taxonomy.decisions(t, "paper_id").withColumn("mean_score", F.round("mean_score", 6))


# ================================================================ vectors
_NEAR = "list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3))"


@query(f"SELECT vec_id, round({_NEAR}, 4) AS score FROM embeddings WHERE label % 2 = 0 AND {_NEAR} >= 0 ORDER BY {_NEAR} DESC, vec_id LIMIT 15")
def vector_search(spark: SparkSession, sf: str) -> DataFrame:
    """Top k to a query vector among the rows of some labels."""
    e = load(spark, sf, "embeddings")
    q = e.where("vec_id = 3").select("embedding").first()["embedding"]  # the query: one vector
    return vector.nearest(e, q, id_col="vec_id", k=15, where=F.col("label") % 2 == 0).select("vec_id", F.round("score", 4).alias("score"))


@query("SELECT 'rows_total' AS metric, count(*)::DOUBLE AS n FROM embeddings UNION ALL SELECT 'indexed', count(embedding) FROM embeddings UNION ALL SELECT 'dimension', max(len(embedding)) FROM embeddings UNION ALL SELECT 'missing', count(*) FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def index_counts(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings")
    missing = vector.missing_embeddings(load(spark, sf, "documents").select("doc_id"), e.select(F.col("vec_id").alias("doc_id"), F.lit("m").alias("model")), "doc_id", "m")
    return unpivoted(vector.index_stats(e).join(F.broadcast(missing.agg(F.count("*").alias("missing"))), how="cross"))


# ================================================================ claim graph and questions
_GRAPH = """WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), cl AS (SELECT 'c' || l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS claim_id, 'p' || l_partkey AS paper_id, 'daylight' || (l_suppkey % 7) AS iv, 'focus' || (l_orderkey % 11) AS dv,
 CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'moderated' ELSE 'causal' END AS claim_type, CASE l_linenumber % 3 WHEN 0 THEN 'will increase it' WHEN 1 THEN 'may reduce it' ELSE 'meets it' END AS statement, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey / 100 END AS effect FROM li)"""


def _claim_keys(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return dealt(li, *li.columns).distinct()


def _claims(spark: SparkSession, sf: str, li: DataFrame | None = None) -> DataFrame:
    li = _claim_keys(spark, sf) if li is None else li
    one = lambda name, c: F.array(F.struct(F.concat(F.lit(name), c.cast("string")).alias("id"), F.lit(name).alias("role"), F.lit(None).cast("string").alias("direction")))
    none = F.array().cast(_EFFECT)
    n = F.col("l_linenumber")
    return li.select(
        F.concat(F.lit("c"), F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")).alias("claim_id"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("paper_id"), one("daylight", F.col("l_suppkey") % 7).alias("environment_factors"), one("focus", F.col("l_orderkey") % 11).alias("outcomes"),
        none.alias("mediators"), none.alias("moderators"), F.expr("CASE (l_orderkey + l_linenumber) % 4 WHEN 0 THEN 'null' WHEN 1 THEN 'moderated' ELSE 'causal' END").alias("claim_type"),
        F.when(n % 3 == 0, "will increase it").when(n % 3 == 1, "may reduce it").otherwise("meets it").alias("statement"), F.when(n % 2 == 0, F.col("l_suppkey") / 100).alias("effect"),
    )


def _papers(spark: SparkSession, sf: str) -> DataFrame:
    return view(spark, sf, "papers").select("paper_id", "title")


def _corpus(spark: SparkSession, sf: str) -> nlquery.Corpus:
    """The graph over the claims, of which only the keys are written, and two searches by the number of the topic. A question asks for one kind of node or edge, which is one scan of the claims; who asks often writes both tables (``graph_export``)."""
    claims, papers = _claims(spark, sf, materialise(_claim_keys(spark, sf), "claim-keys")), _papers(spark, sf)
    edges = graph.edges(papers, claims, kinds=(*graph.CONSTRUCT_COLUMNS, "affects"), carry=nlquery.CARRIED)
    score = lambda df, c: df.withColumn("score", F.length(c) / 100)
    search = lambda df, i, c: lambda text: score(df.where(F.contains(F.lower(c), F.lit(text.split()[0]))), c).select(i, "score")
    return nlquery.Corpus(graph.nodes(papers, claims), edges, claims.select("claim_id", "claim_type", "statement", "effect"), search(claims, "claim_id", "statement"), search(papers, "paper_id", "title"))


@query(_GRAPH + " SELECT node_id, type, label FROM (SELECT 'p' || p_partkey AS node_id, 'paper' AS type, left('Effects of ' || p_name || ' on ' || lower(p_type) || ' study ' || p_partkey, 100) AS label FROM part UNION ALL SELECT claim_id, 'claim', statement FROM cl UNION ALL SELECT DISTINCT iv, 'construct', 'daylight' FROM cl UNION ALL SELECT DISTINCT dv, 'construct', 'focus' FROM cl)")
def graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return graph.nodes(_papers(spark, sf), _claims(spark, sf))


@query(_GRAPH + " SELECT paper_id AS source, claim_id AS target, 'has_claim' AS type FROM cl WHERE paper_id IN (SELECT 'p' || p_partkey FROM part) UNION ALL SELECT claim_id, iv, 'about_iv' FROM cl UNION ALL SELECT claim_id, dv, 'about_dv' FROM cl UNION ALL SELECT iv, dv, 'affects' FROM cl")
def graph_export(spark: SparkSession, sf: str) -> DataFrame:
    papers, claims = _papers(spark, sf), _claims(spark, sf)
    return graph.export(graph.nodes(papers, claims), graph.edges(papers, claims))[1]


@query(_GRAPH + " SELECT 'in' AS way, claim_id AS node FROM cl WHERE iv = 'daylight3' UNION ALL SELECT 'out', dv FROM cl WHERE iv = 'daylight3' UNION ALL SELECT DISTINCT 'found', dv FROM cl WHERE contains(dv, 'focus1')")
def graph_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    papers, claims = _papers(spark, sf), _claims(spark, sf)
    e, n = graph.edges(papers, claims, kinds=("about_iv", "affects")), graph.nodes(papers, claims)
    into, out = graph.neighbours(e, "daylight3", outgoing=False, kind="about_iv"), graph.neighbours(e, "daylight3", kind="affects")
    return into.select(F.lit("in").alias("way"), F.col("src").alias("node")).unionAll(out.select(F.lit("out"), "dst")).unionAll(graph.find_construct(n, "Focus1").select(F.lit("found"), "node_id"))


def _ask(spark: SparkSession, sf: str, question: str) -> DataFrame:
    return nlquery.answer(_corpus(spark, sf), question)[2]


@query(_GRAPH + " SELECT iv AS src, count(*) AS claim_count, round(avg(effect), 6) AS avg_effect FROM cl WHERE dv = 'focus4' GROUP BY iv")
def ask_what_affects(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(spark, sf, "What affects focus4?").select("src", "claim_count", F.round("avg_effect", 6).alias("avg_effect"))


@query(_GRAPH + " SELECT dv AS dst, count(*) AS claim_count, round(avg(effect), 6) AS avg_effect FROM cl WHERE iv = 'daylight2' GROUP BY dv")
def ask_affects_what(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(spark, sf, "What does daylight2 affect?").select("dst", "claim_count", F.round("avg_effect", 6).alias("avg_effect"))


_FOUND = _GRAPH + ", m AS (SELECT * FROM cl WHERE iv = 'daylight5'), r AS (SELECT * FROM m ORDER BY claim_id LIMIT 50)"


@query(_FOUND + " SELECT claim_type, count(*) AS n, (SELECT count(*) FROM m) AS total FROM r GROUP BY claim_type")
def ask_count_claims(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(spark, sf, "How many claims about daylight5?")


@query(_FOUND + " SELECT claim_id, claim_type, 'graph' AS found_by, (SELECT count(*) FROM m) AS total FROM r")
def ask_claims_about(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(spark, sf, "Show all claims about daylight5").select("claim_id", "claim_type", "found_by", "total")


@query(_FOUND + """, w AS (SELECT claim_id, CASE WHEN claim_type = 'null' THEN 'null' WHEN contains(statement, 'increase') THEN 'positive' WHEN contains(statement, 'reduce') THEN 'negative' ELSE 'unknown' END AS way FROM r), f AS (SELECT *, row_number() OVER (PARTITION BY way ORDER BY claim_id) AS r FROM w WHERE way <> 'unknown' QUALIFY r <= 5),
e AS (SELECT *, row_number() OVER (ORDER BY way DESC, r) AS e FROM f WHERE way <> 'null'), x AS (SELECT 'direction_conflict' AS type, p.claim_id AS claim_1, n.claim_id AS claim_2, 0 AS o, p.r AS r1, n.r AS r2 FROM f p JOIN f n ON p.way = 'positive' AND n.way = 'negative' UNION ALL SELECT 'effect_vs_null', e.claim_id, z.claim_id, 1, e.e, z.r FROM e JOIN f z ON z.way = 'null' AND z.r <= 3 WHERE e.e <= 5)
SELECT type, claim_1, claim_2 FROM x ORDER BY o, r1, r2 LIMIT 20""")
def ask_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(spark, sf, "Are there contradictions about daylight5?")


@query(_FOUND + """, w AS (SELECT claim_id, CASE WHEN claim_type = 'null' THEN 'null' WHEN contains(statement, 'increase') THEN 'positive' WHEN contains(statement, 'reduce') THEN 'negative' ELSE 'unknown' END AS way FROM m),
n AS (SELECT count(*) FILTER (way = 'positive') AS p, count(*) FILTER (way = 'negative') AS g, count(*) FILTER (way = 'null') AS z FROM w), x AS (SELECT claim_id, way, CASE way WHEN 'positive' THEN g WHEN 'negative' THEN p ELSE 0 END AS n_conflicts, CASE way WHEN 'null' THEN p + g ELSE z END AS n_against_null FROM w, n WHERE way <> 'unknown')
SELECT claim_id, way, n_conflicts, n_against_null FROM x WHERE n_conflicts + n_against_null > 0""")
def ask_all_contradictions(spark: SparkSession, sf: str) -> DataFrame:
    """Of ``ask_contradictions``, which shows a page, the whole: every claim that contradicts another, with the number of its pairs."""
    return nlquery.answer(_corpus(spark, sf), "Are there contradictions about daylight5?", whole=True)[2]


@query(cte("papers") + " SELECT paper_id, round(length(title) / 100, 6) AS score FROM papers WHERE contains(lower(title), 'gizmo') ORDER BY length(title) DESC, paper_id LIMIT 30")
def ask_papers_about(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(spark, sf, "Find papers on gizmo").select("paper_id", F.round("score", 6).alias("score"))


@query(_GRAPH + " SELECT * FROM (SELECT 'paper' AS kind, 'p' || p_partkey AS id FROM part WHERE contains('effects of ' || p_name || ' on ' || lower(p_type) || ' study ' || p_partkey, 'increase') LIMIT 15) UNION ALL SELECT * FROM (SELECT 'claim', claim_id FROM cl WHERE contains(statement, 'increase') ORDER BY claim_id LIMIT 15)")
def ask_anything(spark: SparkSession, sf: str) -> DataFrame:
    return _ask(spark, sf, "increase of it").select("kind", "id")


# ================================================================ synthesis
@query(_GRAPH + """, d AS (SELECT iv AS key, effect, CASE WHEN claim_type = 'null' THEN 'null' WHEN contains(statement, 'increase') THEN 'positive' WHEN contains(statement, 'reduce') THEN 'negative' ELSE 'unknown' END AS way FROM cl),
n AS (SELECT key, count(*) AS n_claims, count(*) FILTER (way = 'positive') AS p, count(*) FILTER (way = 'negative') AS m, count(*) FILTER (way = 'null') AS z, avg(effect) AS e FROM d GROUP BY key),
o AS (SELECT *, CASE WHEN p > m AND p > z THEN 'positive' WHEN m > p AND m > z THEN 'negative' WHEN z > p AND z > m THEN 'null' WHEN p > 0 AND m > 0 THEN 'mixed' ELSE 'unknown' END AS overall FROM n)
SELECT key, n_claims, p AS n_positive, m AS n_negative, z AS n_null, overall, round(e, 6) AS pooled_effect, n_claims || ' claims, overall direction ' || overall || coalesce(printf(', pooled effect %.3f', round(e, 6)), '') AS summary FROM o""")
def construct_synthesis(spark: SparkSession, sf: str) -> DataFrame:
    rows = _claims(spark, sf).select(F.col("environment_factors")[0]["id"].alias("key"), "claim_id", "claim_type", "statement", "effect")
    s = synthesis.synthesise(rows, "key").withColumn("pooled_effect", F.round("pooled_effect", 6))
    return s.select("key", "n_claims", "n_positive", "n_negative", "n_null", "overall", "pooled_effect", synthesis.summary_text(F.col("n_claims"), F.col("overall"), F.col("pooled_effect")).alias("summary"))


@query("WITH e AS (SELECT l_suppkey AS k, l_discount AS x, coalesce(CASE WHEN l_tax > 0 THEN 1 / l_tax END, CASE WHEN l_quantity > 25 THEN l_quantity END, 1) AS w FROM lineitem) SELECT k, count(*) AS n_with_effect, round(sum(w * x) / sum(w), 6) AS pooled_effect FROM e GROUP BY k")
def weighted_pool(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_discount").alias("x"), "l_tax", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("n"))
    return synthesis.pooled(e, "k", "x", synthesis.weight(F.col("l_tax"), F.col("n"))).select("k", "n_with_effect", F.round("pooled_effect", 6).alias("pooled_effect"))


@query(_GRAPH + " SELECT iv AS key, count(*) AS n FROM cl WHERE claim_type = 'moderated' GROUP BY iv HAVING count(*) >= 2")
def moderated_constructs(spark: SparkSession, sf: str) -> DataFrame:
    return synthesis.moderated(_claims(spark, sf).select(F.col("environment_factors")[0]["id"].alias("key"), "claim_type"), "key")


@query(cte("papers") + " SELECT paper_id, concat_ws(',', CASE WHEN coalesce(trim(abstract), '') = '' THEN 'abstract' END, CASE WHEN doi IS NULL THEN 'doi' END) AS missing FROM papers")
def missing_fields(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    return p.select("paper_id", F.array_join(synthesis.missing_fields(p, ["abstract", "title", "doi"]), ",").alias("missing"))


@query("""WITH s AS (SELECT item_id, lower(text) AS t, list_filter(string_split(lower(text), ' '), lambda w: length(w) > 4)[1:10] AS w FROM benchmark),
d AS (SELECT item_id, t, w, len(list_filter(w, lambda x: contains(t, x))) AS hits FROM s) SELECT item_id, round(0.3 * (contains(t, 'tion')::INT + contains(t, 'mente')::INT) / 2 + CASE WHEN contains(t, 'heit') OR contains(t, 'ough') THEN 0.3 ELSE 0 END + CASE WHEN hits >= 2 THEN 0.2 * least(1, hits / 5) ELSE 0 END + CASE WHEN contains(t, 'que la') THEN 0.2 ELSE 0 END, 6) AS relevance FROM d""")
def theory_relevance(spark: SparkSession, sf: str) -> DataFrame:
    names = lambda *t: F.array(*map(F.lit, t))
    score = synthesis.theory_relevance(F.col("text"), F.lit("tion_mente"), names("Heit", "ough"), F.col("text"), names("que_la"))
    return load(spark, sf, "benchmark").select("item_id", F.round(score, 6).alias("relevance"))


# ================================================================ coverage evidence, follow-up, queue
_EVIDENCE = """WITH s AS (SELECT o_orderkey AS paper, 'env.r' || (c_nationkey % 3) || '.n' || c_nationkey AS node, (o_orderkey % 10) / 10 AS score FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT l_orderkey, 'out.b' || (l_suppkey % 4) || '.s' || l_suppkey, (l_linenumber % 10) / 10 FROM lineitem),
p AS (SELECT DISTINCT paper, unnest([split_part(node, '.', 1), split_part(node, '.', 1) || '.' || split_part(node, '.', 2), node]) AS node FROM s WHERE score >= 0.4)"""


def _rolled(spark: SparkSession, sf: str) -> DataFrame:
    n, o, li = F.col("c_nationkey"), load(spark, sf, "orders"), load(spark, sf, "lineitem")
    path = lambda a, b, c: F.concat(F.lit(a), b.cast("string"), F.lit(c))
    env = o.join(load(spark, sf, "customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("paper"), F.concat(path("env.r", n % 3, ".n"), n.cast("string")).alias("node_id"), (F.col("o_orderkey") % 10 / 10).alias("score"))
    out = li.select(F.col("l_orderkey").alias("paper"), F.concat(path("out.b", F.col("l_suppkey") % 4, ".s"), F.col("l_suppkey").cast("string")).alias("node_id"), (F.col("l_linenumber") % 10 / 10).alias("score"))
    return gaps.rolled_up(env.unionByName(out), "paper")


@query(_EVIDENCE + " SELECT node, count(*) AS papers FROM p GROUP BY node")
def subtree_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Papers under every node of the tree, each once however many of its leaves it scores on."""
    return _rolled(spark, sf).groupBy("node").agg(F.count("*").alias("papers"))


@query(_EVIDENCE + ", f AS (SELECT paper, node AS factor_id FROM p WHERE regexp_full_match(node, 'env\\.r[0-9]+')), o AS (SELECT paper, node AS outcome_id FROM p WHERE regexp_full_match(node, 'out\\.b[0-9]+')) SELECT factor_id, outcome_id, count(*) AS paper_count FROM f JOIN o USING (paper) GROUP BY ALL")
def pair_evidence(spark: SparkSession, sf: str) -> DataFrame:
    rolled = materialise(_rolled(spark, sf), "rolled")
    nodes = lambda p: rolled.where(F.col("node").rlike(p)).select(F.col("node").alias("node_id")).distinct()
    return gaps.pair_evidence(rolled, nodes(r"^env\.r[0-9]+$"), nodes(r"^out\.b[0-9]+$"), "paper", "paper_count")


@query("""WITH li AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem), u AS (SELECT *, unnest(['env', 'env.f' || (l_partkey % 5)]) AS factor_id FROM li), v AS (SELECT *, unnest(['out', 'out.neural', 'out.neural.s' || (l_suppkey % 6)][(CASE WHEN l_suppkey % 2 = 0 THEN 1 ELSE 1 END):]) AS outcome_id FROM u WHERE l_suppkey % 2 = 0 UNION ALL SELECT *, unnest(['out', 'out.s' || (l_suppkey % 6)]) FROM u WHERE l_suppkey % 2 <> 0)
SELECT factor_id, outcome_id, count(*) AS claim_count, bool_or(l_linenumber = 3) AS has_mechanism, bool_or(l_suppkey % 2 = 0) AS has_neural FROM v GROUP BY ALL""")
def claim_evidence(spark: SparkSession, sf: str) -> DataFrame:
    """Claims by factor and outcome, constructs rolled up to all their ancestors."""
    li = load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    one = lambda c: F.array(F.struct(c.alias("id"), F.lit("r").alias("role"), F.lit(None).cast("string").alias("direction")))
    s = (F.col("l_suppkey") % 6).cast("string")
    claims = li.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("claim_id"), F.when(F.col("l_linenumber") == 3, "mechanistic").otherwise("causal").alias("claim_type"), one(F.concat(F.lit("env.f"), (F.col("l_partkey") % 5).cast("string"))).alias("environment_factors"), one(F.concat(F.when(F.col("l_suppkey") % 2 == 0, "out.neural.s").otherwise("out.s"), s)).alias("outcomes"))
    return gaps.claim_evidence(claims)


_GAPQ = "WITH b AS (SELECT item_id, list_filter(string_split(lower(text), ' '), lambda w: length(w) > 4) AS w FROM benchmark), t AS (SELECT item_id, w[1] AS a, w[2] AS b, w[3] AS c, 0.5 + item_id % 5 / 10 AS p FROM b WHERE len(w) >= 3)"


@query(_GAPQ + """, q AS (SELECT 'g' || item_id AS gap_id, p, unnest(['"' || a || '" mechanism "' || b || '"', '"' || a || '" mediates "' || b || '"', '"' || a || '" pathway "' || b || '"', 'how ' || a || ' affects ' || b]) AS query FROM t
 UNION ALL SELECT 't' || item_id, p, unnest(['"' || a || '" empirical study', '"' || a || '" experiment', '"' || b || '" empirical study', '"' || b || '" experiment', '"' || c || '" test evidence', '"' || c || '" architecture environment']) FROM t
 UNION ALL SELECT 'n' || item_id, p, unnest(['"' || a || '" "' || b || '"', '"' || a || '" ' || c || ' brain', a || ' neural correlates', c || ' EEG study']) FROM t)
SELECT query, max(p) AS priority FROM q GROUP BY query""")
def gap_queries(spark: SparkSession, sf: str) -> DataFrame:
    """Mechanism, theory and neural queries of every gap, each once with the most urgent gap it serves."""
    w = F.filter(F.split(F.lower("text"), " "), lambda x: F.length(x) > 4)
    t = load(spark, sf, "benchmark").select("item_id", w.alias("w")).where(F.size("w") >= 3).select("item_id", (0.5 + F.col("item_id") % 5 / 10).alias("priority"), F.col("w")[0].alias("a"), F.col("w")[1].alias("b"), F.col("w")[2].alias("c"))
    made = lambda k, q: t.select(F.concat(F.lit(k), F.col("item_id").cast("string")).alias("gap_id"), "priority", q.alias("queries"))
    each = made("g", gaps.mechanism_queries(F.array("a"), F.array("b"))).unionByName(made("t", gaps.theory_queries(F.array("a", "b"), F.col("c")))).unionByName(made("n", gaps.neural_queries(F.array("a"), F.array("b"), F.lit("x.eeg"), F.col("c"), F.col("c"))))
    return gaps.priority_queries(each, "queries").select("query", "priority")


@query("""WITH g AS (SELECT 'x' || p_partkey AS gap_id, CASE WHEN p_partkey % 2 = 0 THEN 'theory' ELSE 'neural' END AS t, p_size / 50 AS p FROM part) SELECT 'gap:' || gap_id AS cell_id, t AS cell_type, CASE WHEN p > 0.7 THEN 'HIGH' ELSE 'MEDIUM' END AS priority FROM g WHERE gap_id <> 'x7'""")
def cells_from_gaps(spark: SparkSession, sf: str) -> DataFrame:
    g = load(spark, sf, "part").select(F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("gap_id"), F.when(F.col("p_partkey") % 2 == 0, "theory").otherwise("neural").alias("gap_type"), (F.col("p_size") / 50).alias("priority"))
    return gaps.cells_from_gaps(g, spark.range(1).select(F.lit("gap:x7").alias("cell_id")))


@query("""WITH c AS (SELECT DISTINCT l_orderkey AS o, l_linenumber AS n, l_partkey AS p, l_suppkey AS s FROM lineitem), k AS (SELECT 'c' || o || '-' || n || '-' || p || '-' || s AS claim_id, 'p' || p AS paper_id, CASE n % 3 WHEN 0 THEN 'causal' WHEN 1 THEN 'mechanistic' ELSE 'moderated' END AS t, 'f' || (CASE n % 3 WHEN 1 THEN s % 5 ELSE s % 10 END) AS f, 'bright light ' || (s % 10) AS fr, 'deep focus ' || (o % 4) AS fo, 'm' || (o % 6) AS m FROM c),
q AS (SELECT '"' || fr || '" mechanism "' || fo || '" pathway' AS query, 'mechanism' AS gap_type, 0.75 AS priority FROM k WHERE t = 'causal' AND f NOT IN (SELECT f FROM k WHERE t = 'mechanistic') UNION SELECT '"' || m || '" moderator effect boundary', 'boundary', 0.6 FROM k WHERE t = 'moderated')
SELECT query, gap_type, priority::DOUBLE AS priority FROM q UNION ALL SELECT unnest(['"' || x || '" empirical test evidence', '"' || x || '" experiment built environment']), 'theory', unnest([0.8, 0.75])::DOUBLE FROM (SELECT unnest(['stress recovery', 'biophilia', 'prospect refuge', 'affordance']) AS x)""")
def follow_up_queries(spark: SparkSession, sf: str) -> DataFrame:
    c = load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s")).distinct()
    kind = F.expr("CASE n % 3 WHEN 0 THEN 'causal' WHEN 1 THEN 'mechanistic' ELSE 'moderated' END")
    factor = F.concat(F.lit("f"), F.when(F.col("n") % 3 == 1, F.col("s") % 5).otherwise(F.col("s") % 10).cast("string"))
    one = lambda i, r: F.array(F.struct(i.alias("id"), r.alias("role"), F.lit(None).cast("string").alias("direction")))
    num = lambda t, v: F.concat(F.lit(t), v.cast("string"))
    moderators = F.when(kind == "moderated", one(num("m", F.col("o") % 6), F.lit("mod"))).otherwise(F.array().cast(_EFFECT))
    claims = c.select(F.concat(F.lit("c"), F.concat_ws("-", "o", "n", "p", "s")).alias("claim_id"), num("p", F.col("p")).alias("paper_id"), kind.alias("claim_type"), F.lit("on attention restoration").alias("statement"), one(factor, num("bright_light ", F.col("s") % 10)).alias("environment_factors"), one(F.lit("o"), num("deep_focus ", F.col("o") % 4)).alias("outcomes"), moderators.alias("moderators"))
    return gaps.follow_up_queries(claims).select("query", "gap_type", F.col("priority").cast("double").alias("priority"))


_EXTERNAL = cte("papers", "citations") + ", x AS (SELECT *, lower(cited_doi) AS d FROM citations WHERE cited_doi IS NOT NULL AND lower(cited_doi) NOT IN (SELECT lower(doi) FROM papers WHERE doi IS NOT NULL))"


@query(_EXTERNAL + ", b AS (SELECT *, row_number() OVER (PARTITION BY source_paper_id ORDER BY seq) AS r FROM x) SELECT d AS doi, count(*) + CASE WHEN d = '10.1234/x.3' THEN 5 ELSE 0 END AS discovery_count, CASE WHEN d = '10.1234/x.3' THEN 0.9 ELSE 0.5 END::DOUBLE AS priority_score FROM b GROUP BY d")
def expansion_queue(spark: SparkSession, sf: str) -> DataFrame:
    """A queue that had one entry, with all external citations counted in."""
    queue = spark.range(1).select(F.lit("10.1234/x.3").alias("doi"), F.lit("T").alias("title"), F.lit("p0").alias("discovered_from"), F.lit(5).alias("discovery_count"), F.lit(0.9).alias("priority_score"))
    q = expansion.enqueue(queue, view(spark, sf, "citations").where("cited_doi is not null"), view(spark, sf, "papers"))
    return q.select("doi", "discovery_count", "priority_score")


@query(_EXTERNAL + " SELECT cited_doi, count(*) AS n, min(cited_title) AS cited_title, least(1, count(*) / 10)::DOUBLE AS priority_score FROM x GROUP BY cited_doi HAVING count(*) >= 2")
def highly_cited(spark: SparkSession, sf: str) -> DataFrame:
    return expansion.highly_cited(view(spark, sf, "citations"), view(spark, sf, "papers"))


@query(_EXTERNAL + ", q AS (SELECT d AS doi, count(*) AS discovery_count, CASE WHEN length(d) % 2 = 0 THEN 'pending' ELSE 'fetched' END AS status FROM x GROUP BY d) SELECT doi, CASE WHEN status = 'pending' THEN least(1, discovery_count / 10) ELSE 0.5 END::DOUBLE AS priority_score FROM q")
def queue_priorities(spark: SparkSession, sf: str) -> DataFrame:
    x = expansion.external_citations(view(spark, sf, "citations"), view(spark, sf, "papers"))
    q = x.groupBy(F.lower("cited_doi").alias("doi")).agg(F.count("*").alias("discovery_count")).withColumn("status", F.when(F.length("doi") % 2 == 0, "pending").otherwise("fetched")).withColumn("priority_score", F.lit(0.5))
    return expansion.reprioritised(q).select("doi", "priority_score")


@query(cte("citations") + ", x AS (SELECT count(*) AS citations, count(DISTINCT source_paper_id) AS citing, count(DISTINCT cited_doi) AS cited_dois, count(cited_paper_id) AS internal FROM citations) SELECT metric, n::DOUBLE AS n FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE n)")
def citation_network(spark: SparkSession, sf: str) -> DataFrame:
    return unpivoted(expansion.network_stats(view(spark, sf, "citations")))


@query(cte("papers") + ", c AS (SELECT paper_id, k % 5 = 0 AS known, CASE WHEN k % 7 <> 0 THEN k % 10 / 10 END AS score, CASE WHEN k % 3 = 0 THEN 'reject' ELSE 'review' END AS decision FROM papers) SELECT paper_id, CASE WHEN known THEN 'duplicate' WHEN score IS NULL THEN 'deferred' WHEN decision = 'reject' OR score < 0.4 THEN 'rejected' ELSE 'imported' END AS route FROM c")
def import_routes(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    c = p.select("paper_id", (F.col("k") % 5 == 0).alias("known"), F.when(F.col("k") % 7 != 0, F.col("k") % 10 / 10).alias("score"), F.when(F.col("k") % 3 == 0, "reject").otherwise("review").alias("decision"))
    return expansion.routed(c).select("paper_id", "route")


# ================================================================ audits
@query(cte("papers", "files") + ", x AS (SELECT (SELECT count(*) FROM papers LEFT JOIN files ON pdf_path = path WHERE pdf_path IS NOT NULL AND path IS NULL) AS missing_pdf_path_files, (SELECT count(*) FROM papers JOIN files ON pdf_path = path WHERE sha256 <> pdf_sha256) AS pdf_sha256_mismatch_rows, (SELECT coalesce(sum(c), 0) FROM (SELECT count(*) - 1 AS c FROM papers WHERE pdf_sha256 IS NOT NULL GROUP BY pdf_sha256)) AS duplicate_pdf_sha_rows, (SELECT count(*) FROM files WHERE path NOT IN (SELECT pdf_path FROM papers WHERE pdf_path IS NOT NULL)) AS orphan_pdf_files) SELECT metric, n::DOUBLE AS n FROM (UNPIVOT (SELECT missing_pdf_path_files::BIGINT AS missing_pdf_path_files, pdf_sha256_mismatch_rows::BIGINT AS pdf_sha256_mismatch_rows, duplicate_pdf_sha_rows::BIGINT AS duplicate_pdf_sha_rows, orphan_pdf_files::BIGINT AS orphan_pdf_files FROM x) ON COLUMNS(*) INTO NAME metric VALUE n)")
def file_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return unpivoted(audit.file_integrity(view(spark, sf, "papers"), view(spark, sf, "files")))


_OK_STATUS = ("candidate", "pending_scorer", "rejected", "downloaded")
_STATE = cte("papers", "outputs") + f""", j AS (SELECT p.*, o.ae_output_path AS o, o.status AS rs, o.n_claims AS rc, o.n_rules AS rr, o.confidence AS rf FROM papers p LEFT JOIN outputs o ON p.ae_output_path = o.ae_output_path),
x AS (SELECT count(*) AS papers_total, count(*) FILTER (triage_decision = 'pending') AS pending_triage_rows, count(*) FILTER (status NOT IN {_OK_STATUS}) AS invalid_status_rows, count(*) FILTER (triage_decision NOT IN ('pending', 'send_to_eater', 'review', 'reject', 'needs_review')) AS invalid_triage_rows,
 count(*) FILTER (triage_decision = 'needs_review') AS deprecated_triage_rows, count(*) FILTER (triage_decision = 'pending' AND status NOT IN ('candidate', 'pending_scorer')) AS pending_triage_invalid_status_rows, count(*) FILTER (ae_status = 'pending' AND ae_job_path IS NULL) AS ae_pending_without_job_rows,
 count(*) FILTER (ae_status IN ('SUCCESS', 'PARTIAL_SUCCESS', 'FAIL') AND o IS NULL) AS ae_terminal_without_output_rows, count(*) FILTER (ae_status = 'pending' AND o IS NOT NULL) AS ae_pending_with_output_rows,
 count(*) FILTER (ae_status IS NOT NULL AND (ae_status NOT IN ('pending', 'SUCCESS', 'PARTIAL_SUCCESS', 'FAIL') OR (o IS NOT NULL AND rs <> ae_status))) AS ae_result_status_mismatch_rows,
 coalesce(sum((ae_n_claims <> rc)::INT + (ae_n_rules <> rr)::INT + (abs(ae_confidence - rf) > 1e-9)::INT) FILTER (ae_status IN ('SUCCESS', 'PARTIAL_SUCCESS', 'FAIL') AND o IS NOT NULL), 0)::BIGINT AS ae_result_summary_mismatch_rows FROM j)"""


@query(_STATE + " SELECT metric, n::DOUBLE AS n FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE n)")
def semantic_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return unpivoted(audit.semantic_integrity(view(spark, sf, "papers"), view(spark, sf, "outputs")))


@query(_STATE + """, t AS (SELECT *, o IS NOT NULL AND rs IS DISTINCT FROM ae_status AS take, ae_status IN ('SUCCESS', 'PARTIAL_SUCCESS', 'FAIL') AND o IS NULL AS lost FROM j)
SELECT paper_id, CASE WHEN triage_decision = 'needs_review' THEN 'review' ELSE triage_decision END AS triage_decision, CASE WHEN take THEN rs WHEN lost THEN 'pending' ELSE ae_status END AS ae_status, CASE WHEN take THEN rc WHEN lost THEN NULL ELSE ae_n_claims END AS ae_n_claims FROM t""")
def repaired_state(spark: SparkSession, sf: str) -> DataFrame:
    p, o = view(spark, sf, "papers"), view(spark, sf, "outputs")
    once = audit.repaired_state(p, o)
    return audit.repaired_state(once, o).select("paper_id", "triage_decision", "ae_status", "ae_n_claims")  # a second run changes nothing


@query(_STATE + ", t AS (SELECT *, o IS NOT NULL AND rs IS DISTINCT FROM ae_status AS take FROM j) SELECT 'triage_decision' AS metric, count(*) FILTER (triage_decision = 'needs_review')::DOUBLE AS n FROM t UNION ALL SELECT 'ae_status', count(*) FILTER (take) FROM t UNION ALL SELECT 'ae_n_claims', count(*) FILTER (take AND rc <> ae_n_claims) FROM t")
def repair_report(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    done = audit.repaired_state(p, view(spark, sf, "outputs"))
    keep = ["paper_id", "triage_decision", "ae_status", "ae_n_claims"]
    return unpivoted(audit.changed_rows(p.select(*keep), done.select(*keep), "paper_id"))


@query(cte("papers") + """, m AS (SELECT k, CASE k % 6 WHEN 0 THEN 'matched' WHEN 1 THEN 'unmatched' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'odd' WHEN 4 THEN NULL ELSE 'matched' END AS st, CASE WHEN k % 6 = 1 THEN CASE WHEN k % 4 = 1 THEN 'exact_doi' ELSE 'none' END WHEN k % 9 = 0 THEN 'strange' ELSE 'exact_title' END AS basis, CASE WHEN k % 5 > 0 THEN 'x' END AS pid, CASE WHEN k % 7 = 0 THEN 1.5 ELSE 0.9 END AS conf, CASE k % 3 WHEN 0 THEN '["a"]' WHEN 1 THEN '{{"a": 1}}' ELSE '[]' END AS cj, k % 8 > 0 AS dated FROM papers),
x AS (SELECT count(*) AS rows_total, count(*) FILTER (st IS NULL) AS missing_dedupe_rows, count(*) FILTER (st = 'odd') AS bad_status_rows, count(*) FILTER (st IS NOT NULL AND (basis = 'strange' OR (st = 'unmatched' AND basis <> 'none'))) AS bad_basis_rows, count(*) FILTER (st = 'matched' AND pid IS NULL) AS matched_missing_paper_id_rows,
 count(*) FILTER (st = 'matched' AND conf > 1) AS matched_bad_confidence_rows, count(*) FILTER (st = 'unmatched' AND pid IS NOT NULL) AS unmatched_with_paper_id_rows, count(*) FILTER (st IS NOT NULL AND k % 3 = 1) AS bad_candidates_json_rows, count(*) FILTER (st = 'ambiguous' AND cj = '[]') AS ambiguous_missing_candidates_rows, count(*) FILTER (st IS NOT NULL AND NOT dated) AS missing_deduped_at_rows FROM m)
SELECT metric, n::DOUBLE AS n FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE n)""".replace("{{", "{").replace("}}", "}"))
def match_integrity(spark: SparkSession, sf: str) -> DataFrame:
    m = view(spark, sf, "papers").selectExpr(
        "doi", "title", "'2024' AS classified_at", "CASE k % 6 WHEN 0 THEN 'matched' WHEN 1 THEN 'unmatched' WHEN 2 THEN 'ambiguous' WHEN 3 THEN 'odd' WHEN 4 THEN NULL ELSE 'matched' END AS match_status", "CASE WHEN k % 6 = 1 THEN CASE WHEN k % 4 = 1 THEN 'exact_doi' ELSE 'none' END WHEN k % 9 = 0 THEN 'strange' ELSE 'exact_title' END AS match_basis",
        "CASE WHEN k % 5 > 0 THEN 'x' END AS match_paper_id", "CASE WHEN k % 7 = 0 THEN 1.5 ELSE 0.9 END AS match_confidence", """CASE k % 3 WHEN 0 THEN '["a"]' WHEN 1 THEN '{"a": 1}' ELSE '[]' END AS candidates_json""", "CASE WHEN k % 8 > 0 THEN '2024' END AS deduped_at",
    )
    return unpivoted(audit.match_integrity(m))


@query(cte("papers") + ", x AS (SELECT count(*) AS classified_rows, count(*) FILTER (abstract IS NULL OR abstract = '') AS missing_core_rows, count(*) FILTER (k % 4 = 0) AS bad_topics_rows, count(*) FILTER (k % 5 = 0) AS bad_payload_rows, count(*) FILTER (k % 6 > 1) AS bad_boolean_rows, count(*) FILTER (k % 30 > 10) AS bad_confidence_rows FROM papers) SELECT metric, n::DOUBLE AS n FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE n)")
def classification_integrity(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers").selectExpr("title", "abstract", """CASE WHEN k % 4 = 0 THEN '{"a": 1}' ELSE '["t"]' END AS topics""", """CASE WHEN k % 5 = 0 THEN 'no json' ELSE '{"a": 1}' END AS payload""", "k % 6 AS flag", "k % 30 / 10.0 AS conf")
    return unpivoted(audit.classification_integrity(p, core=["title", "abstract"], lists=["topics"], payload="payload", booleans=["flag"], units=["conf"]))


@query("SELECT * FROM (VALUES ('r_regionkey', 'int', 'int', true), ('r_name', 'bigint', 'string', false), ('extra', 'string', NULL, false)) AS v(\"column\", expected, present, ok)")
def schema_drift(spark: SparkSession, sf: str) -> DataFrame:
    return audit.schema_drift(load(spark, sf, "region").select("r_regionkey", "r_name"), {"r_regionkey": "int", "r_name": "bigint", "extra": "string"})


@query("WITH b AS (SELECT o_orderkey AS id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT 'r' || id AS run_id, concat_ws(',', CASE WHEN id % 3 = 0 THEN 'claim_count' END, CASE WHEN id % 4 = 0 THEN 'rule_count' END, CASE WHEN id % 5 = 0 THEN 'pdf_hash' END) AS problems FROM b")
def bundle_problems(spark: SparkSession, sf: str) -> DataFrame:
    o, li = load(spark, sf, "orders").select(F.col("o_orderkey").alias("id")), load(spark, sf, "lineitem").select(F.col("l_orderkey").alias("id"))
    run = F.concat(F.lit("r"), F.col("id").cast("string"))
    claims, rules = li.select(run.alias("run_id")), li.where("id % 2 = 0").select(run.alias("run_id"))
    n, m = claims.groupBy("run_id").agg(F.count("*").alias("n")), rules.groupBy("run_id").agg(F.count("*").alias("m"))
    b = o.select("id", run.alias("run_id")).join(n, "run_id", "left").join(m, "run_id", "left").fillna(0)
    bundles = b.select("run_id", (F.col("n") + F.when(F.col("id") % 3 == 0, 1).otherwise(0)).alias("n_claims"), (F.col("m") + F.when(F.col("id") % 4 == 0, 2).otherwise(0)).alias("n_rules"), F.lit("a").alias("pdf_sha256"), F.when(F.col("id") % 5 == 0, "b").otherwise("a").alias("actual_sha256"))
    return audit.bundle_problems(bundles, claims, rules).withColumn("problems", F.array_join("problems", ","))


@query(cte("papers") + ", x AS (SELECT count(*)::DOUBLE AS total, count(*) FILTER (ae_status IN ('SUCCESS', 'PARTIAL_SUCCESS'))::DOUBLE AS succeeded, 0::DOUBLE AS failed, sum(ae_n_claims)::DOUBLE AS claims, sum(ae_n_rules)::DOUBLE AS rules, round(avg(ae_n_claims / 2), 6)::DOUBLE AS mean_seconds FROM papers) SELECT metric, n FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE n)")
def run_summary(spark: SparkSession, sf: str) -> DataFrame:
    runs = view(spark, sf, "papers").selectExpr("ae_status AS status", "ae_n_claims AS n_claims", "ae_n_rules AS n_rules", "ae_n_claims / 2 AS seconds")
    return unpivoted(audit.run_summary(runs).withColumn("mean_seconds", F.round("mean_seconds", 6)))


@query(cte("papers") + ", x AS (SELECT count(*) AS total, count(doi) AS with_doi, count(pdf_path) AS with_pdf, count(*) FILTER (doi IS NOT NULL AND pdf_path IS NULL) AS to_download FROM papers) SELECT metric, n::DOUBLE AS n FROM (UNPIVOT x ON COLUMNS(*) INTO NAME metric VALUE n)")
def acquisition(spark: SparkSession, sf: str) -> DataFrame:
    return unpivoted(audit.acquisition(view(spark, sf, "papers")))


@query("SELECT * FROM (SELECT 'source' AS facet, source AS name, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, name LIMIT 10) UNION ALL SELECT * FROM (SELECT 'venue', p_brand, count(*) AS n FROM part GROUP BY p_brand ORDER BY n DESC, p_brand LIMIT 15)")
def dashboard_top(spark: SparkSession, sf: str) -> DataFrame:
    """The ten largest sources and the fifteen most frequent venues."""
    top = lambda df, c, k, facet: R.frequent(df, c, least=1, k=k).select(F.lit(facet).alias("facet"), F.col(c).alias("name"), "n")
    return top(load(spark, sf, "documents").select("source"), "source", 10, "source").unionAll(top(load(spark, sf, "part").select("p_brand"), "p_brand", 15, "venue"))


@query("SELECT 'q' || event_id AS query_id, 'api' || (event_id % 3) AS api, CASE WHEN event_id % 4 = 0 THEN 'started' ELSE 'completed' END AS status, CASE WHEN event_id % 4 > 0 THEN user_id END AS results FROM events")
def query_records(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "events").select(F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"), "event_id", "ts", F.col("user_id").alias("results"), F.concat(F.lit("api"), (F.col("event_id") % 3).cast("string")).alias("api"), F.lit("text").alias("query_text"))
    start = e.select("query_id", F.lit("start").alias("event"), "ts", "api", "query_text", F.lit(None).cast("string").alias("status"), F.lit(None).cast("long").alias("results"))
    end = e.where("event_id % 4 > 0").select("query_id", F.lit("end").alias("event"), (F.col("ts") + F.expr("interval 1 second")).alias("ts"), "api", "query_text", F.lit("completed").alias("status"), "results")
    return audit.query_records(start.unionByName(end)).select("query_id", "api", "status", "results")


# ================================================================ ingest
@query("""SELECT CASE WHEN p_partkey % 3 = 0 THEN '10.1234/m.' || p_partkey WHEN p_partkey % 3 = 1 THEN '10.5678/c.' || p_partkey END AS doi, CASE WHEN p_partkey % 5 <> 0 THEN 'Title ' || p_name END AS title, (1980 + p_size % 40)::INT AS year, 'A. Smith|B. Jones' AS authors FROM part WHERE p_partkey % 3 < 2 OR p_partkey % 5 <> 0""")
def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Spreadsheet rows as papers: the DOI from its column, else from any cell."""
    k = F.col("p_partkey").cast("string")
    rows = load(spark, sf, "part").select(F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("doi:10.1234/M."), k)).alias("DOI"), F.when(F.col("p_partkey") % 5 != 0, F.concat(F.lit("Title "), "p_name")).alias("T"), F.concat(F.lit("in "), (1980 + F.col("p_size") % 40).cast("string")).alias("Y"), F.lit("A. Smith; B. Jones").alias("A"), F.when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("see 10.5678/C."), k)).alias("Note"))
    return readers.rows_to_papers(rows, {"doi": "DOI", "title": "T", "year": "Y", "authors": "A"}).select("doi", "title", "year", F.array_join("authors", "|").alias("authors"))


@query(cte("papers") + """, q AS (SELECT 'p' || k AS paper_id, k FROM papers UNION ALL SELECT 'gone' || k, k FROM papers WHERE k % 10 = 0)
SELECT paper_id, CASE WHEN starts_with(paper_id, 'gone') THEN 'rejected' WHEN k % 7 = 0 THEN 'rejected' WHEN k % 3 = 0 THEN 'not_found' WHEN k % 4 < 2 THEN 'fetched' ELSE 'not_found' END AS status, CASE WHEN starts_with(paper_id, 'gone') THEN 'paper_missing' WHEN k % 7 = 0 THEN 'missing_title' WHEN k % 3 = 0 THEN 'no_match' WHEN k % 4 >= 2 THEN 'no_new_data' END AS reason FROM q""")
def queue_drain(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    queue = p.select("paper_id").unionByName(p.where("k % 10 = 0").select(F.concat(F.lit("gone"), F.col("k").cast("string")).alias("paper_id")))
    papers = p.select("paper_id", F.when(F.col("k") % 7 != 0, F.col("title")).alias("title"), "abstract", F.lit("10.1/x").alias("doi"))
    found = p.where("k % 3 <> 0").select("paper_id", F.lit("found text").alias("abstract"), F.lit(None).cast("string").alias("doi"))
    return ingest.drained(queue, papers, found)


@query(cte("papers") + ", s AS (SELECT paper_id, k % 4 AS d FROM papers WHERE k % 4 > 0) SELECT 'p' || k AS paper_id, CASE d WHEN 1 THEN 'rejected' WHEN 2 THEN 'candidate' WHEN 3 THEN 'candidate' ELSE 'pending_scorer' END AS status FROM papers p LEFT JOIN s USING (paper_id) WHERE k % 5 <> 0")
def library_import(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    scores = p.where("k % 4 > 0").select("paper_id", F.lit(0.5).alias("triage_score"), F.when(F.col("k") % 4 == 1, "reject").otherwise("review").alias("decision"))
    return ingest.imported(p.select("paper_id", "title"), p.where("k % 5 = 0").select("paper_id"), scores).select("paper_id", "status")


@query("SELECT 'total' AS metric, count(*)::DOUBLE AS n FROM events UNION ALL SELECT unnest(['click', 'error', 'view']), unnest([count(*) FILTER (event_type = 'click'), count(*) FILTER (event_type = 'error'), count(*) FILTER (event_type = 'view')]) FROM events")
def run_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    return unpivoted(ingest.outcome_counts(load(spark, sf, "events"), ["click", "error", "view"], "event_type"))


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS AND ts > (SELECT min(ts) FROM events) + INTERVAL 1 DAY")
def recent_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the last seven days that lie after a high-water mark."""
    e = load(spark, sf, "events").select("event_id", "ts")
    ends = e.agg(F.max("ts").alias("hi"), F.min("ts").alias("lo"))
    j = e.join(F.broadcast(ends), how="cross")
    return readers.added_since(ingest.recent(j, "ts", 7, F.col("hi")), "ts", F.col("lo") + F.expr("interval 1 day")).select("event_id")


@query(cte("papers") + " SELECT paper_id, k AS priority FROM papers WHERE k % 3 = 0 ORDER BY k, paper_id LIMIT 25")
def due_jobs(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    bundles = p.where("k % 3 = 0").select(F.concat(F.lit("job_"), N.safe_filename(F.concat(F.lit("x:"), "paper_id"))).alias("bundle"))
    q = p.select(F.concat(F.lit("x:"), "paper_id").alias("paper_id"), F.col("k").alias("priority"))
    return ingest.due_jobs(q, bundles, 25).select(F.substring("paper_id", 3, 100).alias("paper_id"), "priority")


@query(cte("papers") + " SELECT paper_id, CASE WHEN k % 3 = 0 THEN 1.35 ELSE 1.3 END::DOUBLE AS match_score, CASE WHEN k % 3 = 0 THEN '10.9/a' END AS doi FROM papers")
def best_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Two candidates for a paper: the same title a year off, and the same title and year; the better one wins."""
    p = view(spark, sf, "papers")
    records = p.select(F.col("paper_id").alias("id"), "title", F.lit("smith").alias("author"), "year")
    same = p.select(F.col("paper_id").alias("id"), "title", F.array(F.lit("J. Smith")).alias("authors"), "year", F.when(F.col("k") % 3 == 0, "10.9/a").alias("doi"), F.lit(" ").alias("abstract"))
    off = p.select(F.col("paper_id").alias("id"), "title", F.array(F.lit("J. Smith")).alias("authors"), (F.col("year") + 1).alias("year"), F.lit("10.9/b").alias("doi"), F.lit("text").alias("abstract"))
    best = ingest.best_candidates(records, same.unionByName(off))
    return best.select(F.col("id").alias("paper_id"), "match_score", "doi")


# ================================================================ sources and sinks, over files the query writes
@query("SELECT s_suppkey::VARCHAR AS id, s_name AS name, s_name || ', \"of\" ' || s_nationkey AS note, 'a; b' AS tags, 'Column_4' AS unnamed FROM supplier")
def text_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table exported as CSV and read back: quotes, separators and an empty header survive."""
    path = scratch(spark, "table")
    s = load(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.concat("s_name", F.lit(', "of" '), F.col("s_nationkey").cast("string")).alias("note"), F.array(F.lit("a"), F.lit("b")).alias("tags"))
    sinks.export_csv(s.withColumn("_c4", F.lit("x")), path, ["id", "name", "note", "tags", "_c4"])
    t = readers.read_table(spark, path)
    return t.select("id", "name", "note", "tags", F.lit(t.columns[4]).alias("unnamed"))


@query("SELECT c_custkey::VARCHAR AS id, c_name AS name FROM customer")
def separated_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table with another separator, which is found from its first line."""
    path = scratch(spark, "separated")
    load(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey").toDF("id", "name", "nation").write.csv(path, header=True, sep=";")
    return readers.read_table(spark, path).select("id", "name")


@query("SELECT e.event_id AS id, e.event_type AS kind, FALSE AS bad FROM events e WHERE event_id % 10 <> 0 UNION ALL SELECT NULL, NULL, TRUE FROM events WHERE event_id % 10 = 0")
def json_lines(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines of which every tenth is broken: it stays, marked."""
    path = scratch(spark, "lines")
    line = F.when(F.col("event_id") % 10 == 0, F.lit('{"id": ')).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("kind"))))
    load(spark, sf, "events").select(line.alias("value")).write.text(path)
    return readers.read_jsonl(spark, path, "id long, kind string").select("id", "kind", F.col("bad_line").isNotNull().alias("bad"))


@query("SELECT 'job_p' || p_partkey AS bundle, 'p' || p_partkey AS paper_id, p_name AS title FROM part WHERE p_partkey % 2 = 0")
def job_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Job bundles written for the papers that have all they need, and read back by directory."""
    path = scratch(spark, "bundles")
    p = load(spark, sf, "part").select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("paper_id"), F.lit("10.1/x").alias("doi"), F.col("p_name").alias("title"), F.array(F.lit("A")).alias("authors"), F.lit(2000).alias("year"), F.lit("V").alias("venue"), F.lit("a").alias("abstract"),
        F.lit("review").alias("triage_decision"), F.lit(0.5).alias("triage_score"), F.when(F.col("p_partkey") % 2 == 0, "/x.pdf").alias("pdf_path"), F.lit("s").alias("pdf_sha256"),
    )
    sinks.write_bundles(p, path)
    b = readers.read_job_bundles(spark, path).select("bundle", F.from_json("payload", "paper_id string, title string").alias("r"))
    return b.select("bundle", "r.paper_id", "r.title")


@query("SELECT 'run' || n_nationkey AS bundle, 'p' || n_nationkey AS paper_id, n_regionkey AS n_claims FROM nation")
def result_bundles(spark: SparkSession, sf: str) -> DataFrame:
    """Results of runs, one JSON file in a folder each, read by a directory pattern."""
    path = scratch(spark, "results")
    record = F.to_json(F.struct(F.concat(F.lit("p"), F.col("n_nationkey").cast("string")).alias("paper_id"), F.struct(F.col("n_regionkey").alias("n_claims")).alias("summary")))
    load(spark, sf, "nation").select(F.concat(F.lit("run"), F.col("n_nationkey").cast("string")).alias("d"), record.alias("value")).repartition("d").write.partitionBy("d").text(path)
    return readers.read_bundles(spark, f"{path}/*", P.RESULT_RECORD).select(F.regexp_extract("path", "d=([^/]+)/", 1).alias("bundle"), "paper_id", F.col("summary.n_claims").alias("n_claims"))


@query("SELECT item_id, sha256(text) AS sha256, length(text)::BIGINT AS chars, TRUE AS same_text FROM benchmark")
def document_files(spark: SparkSession, sf: str) -> DataFrame:
    """Files hashed where they are read, and their text by a provider."""
    path = scratch(spark, "files")
    b = load(spark, sf, "benchmark")
    b.select(F.col("item_id").alias("d"), "text").repartition("d").write.option("lineSep", "\u0000").partitionBy("d").text(path)
    item = lambda c: F.regexp_extract(c, "d=([0-9]+)/", 1).cast("long")
    hashed = readers.read_files(spark, path, "*.txt").select(item("path").alias("item_id"), "sha256", "length")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").load(path)
    texts = readers.document_text(raw, lambda content: bytes(content).decode()).select(item("path").alias("item_id"), F.rtrim(F.col("text"), F.lit("\u0000")).alias("t"))
    own = hashed.join(texts, "item_id").join(b, "item_id")
    return own.select("item_id", F.sha2("t", 256).alias("sha256"), F.length("t").cast("long").alias("chars"), (F.sha2(F.concat("text", F.lit("\u0000")), 256) == F.col("sha256")).alias("same_text"))


@query("SELECT 'day' || (event_id % 97) AS batch, count(*) AS files FROM events GROUP BY 1")
def file_manifest(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "events").select(F.concat(F.lit("day"), (F.col("event_id") % 97).cast("string")).alias("batch"), F.concat(F.lit("/f"), F.col("event_id").cast("string")).alias("path"), F.length("props").cast("long").alias("length"), F.col("props").cast("binary").alias("content"))
    m = audit.manifest(f)
    same = audit.manifest(f.orderBy(F.desc("path"))).select("batch", F.col("digest").alias("d"))
    return m.join(same, "batch").where("digest = d and length(digest) = 64 and bytes > 0").select("batch", "files")


@query("SELECT user_id, count(*) AS n FROM events WHERE ts::DATE = (SELECT min(ts)::DATE FROM events) GROUP BY user_id")
def partitioned_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events appended to a log by date in two runs; one day is read, of which only its folder is listed."""
    path = scratch(spark, "log")
    e = load(spark, sf, "events").select("event_id", "user_id", F.col("ts").alias("started_at"))
    for half in (0, 1):
        sinks.append_log(e.where(F.col("event_id") % 2 == half), path)
    first = e.agg(F.min(F.to_date("started_at"))).first()[0]
    return spark.read.schema("event_id long, user_id long, date date").json(path).where(F.col("date") == F.lit(first)).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT p_partkey AS id, concat_ws(chr(10), 'TY  - JOUR', 'TI  - ' || p_name, 'AU  - A. One', 'AU  - B. Two', 'PY  - ' || p_size, CASE WHEN p_partkey % 2 = 0 THEN 'DO  - 10.1/' || p_partkey END, 'ER  - ', '') AS ris FROM part")
def ris_export(spark: SparkSession, sf: str) -> DataFrame:
    p = load(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array(F.lit("A. One"), F.lit("B. Two")).alias("authors"), F.col("p_size").alias("year"), F.lit(" ").alias("venue"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("10.1/"), F.col("p_partkey").cast("string"))).alias("doi"), F.lit(None).cast("string").alias("abstract"))
    return p.select("id", sinks.ris_text().alias("ris"))


@query("SELECT r_name AS name, count(*) AS n FROM nation JOIN region ON r_regionkey = n_regionkey GROUP BY r_name")
def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    """Two snapshots of a table below one folder; the reader switches to the later one by its path."""
    base = scratch(spark, "snapshots")
    n = load(spark, sf, "nation").join(load(spark, sf, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select("n_name", "r_name")
    sinks.write_snapshot(n.where("r_name = 'ASIA'"), base)
    return spark.read.parquet(sinks.write_snapshot(n, base, partition_by=["r_name"])).groupBy(F.col("r_name").alias("name")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, 3 AS dimension, length(text)::DOUBLE AS first FROM documents")
def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings by a provider, of texts that the cache lacks only: the second run asks for none."""
    path = scratch(spark, "embeddings")
    d = load(spark, sf, "documents").select("doc_id", "text")

    def lengths(parts):
        for pdf in parts:
            pdf["embedding"] = [[float(len(t)), 0.0, 1.0] for t in pdf["text"]]
            yield pdf[["key", "embedding"]]

    def none(parts):
        for pdf in parts:
            if len(pdf):
                raise ValueError("the cache has all texts")
            pdf["embedding"] = [[]] * 0
            yield pdf[["key", "embedding"]]

    sinks.with_embeddings(d.where("doc_id % 2 = 0"), path, "m", lengths, spark).count()
    sinks.with_embeddings(d, path, "m", lengths, spark).count()
    return sinks.with_embeddings(d, path, "m", none, spark).select("doc_id", F.size("embedding").alias("dimension"), F.col("embedding")[0].cast("double").alias("first"))


@query("""SELECT 'zotero:k' || p_partkey AS paper_id, CASE WHEN p_partkey % 2 = 0 THEN '10.1/z' || p_partkey END AS doi, p_name AS title, (1980 + p_size % 40)::INT AS year, CASE WHEN p_partkey % 4 < 2 THEN 'Journal' ELSE 'Conference' END AS venue, CASE WHEN p_partkey % 3 = 0 THEN 'Doe, J;Roe, A' ELSE 'Edit, E' END AS authors,
 CASE WHEN p_partkey % 5 = 0 THEN '/store/a' || p_partkey || '/x.pdf' END AS pdf_path FROM part WHERE p_partkey % 7 <> 0""")
def reference_library(spark: SparkSession, sf: str) -> DataFrame:
    """The entity-attribute-value tables of a reference library as papers."""
    p = load(spark, sf, "part")
    k = F.col("p_partkey").cast("string")
    items = p.select(F.col("p_partkey").alias("itemID"), F.concat(F.lit("k"), k).alias("key"))
    given = {"DOI": F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("doi:10.1/Z"), k)), "title": F.col("p_name"), "date": F.concat(F.lit("spring "), (1980 + F.col("p_size") % 40).cast("string")), "publicationTitle": F.when(F.col("p_partkey") % 4 < 2, "Journal"), "conferenceName": F.lit("Conference"), "abstractNote": F.lit(None).cast("string")}
    names = list(given)
    facts = p.select(F.col("p_partkey").alias("itemID"), F.explode(F.array(*[F.struct(F.lit(i).alias("fieldID"), v.alias("value")) for i, v in enumerate(given.values())])).alias("f")).select("itemID", "f.fieldID", "f.value").where("value is not null")
    values = facts.select("value").distinct().withColumn("valueID", F.xxhash64("value"))
    data = facts.select("itemID", "fieldID", F.xxhash64("value").alias("valueID"))
    fields = spark.createDataFrame(list(enumerate(names)), "fieldID int, fieldName string")
    wide = readers.library_items(items, data, values, fields, p.where("p_partkey % 7 = 0").select(F.col("p_partkey").alias("itemID")), names)
    creator = lambda *rows: F.array(*[F.struct(F.lit(c).alias("creatorID"), F.lit(o).alias("orderIndex"), F.lit(t).alias("creatorTypeID")) for c, o, t in rows])
    made = p.select(F.col("p_partkey").alias("itemID"), F.explode(F.when(F.col("p_partkey") % 3 == 0, creator((2, 0, 2), (0, 1, 1), (1, 2, 1))).otherwise(creator((2, 0, 2)))).alias("c")).select("itemID", "c.*")
    creators = spark.createDataFrame([(0, "Doe", "J"), (1, "Roe", "A"), (2, "Edit", "E")], "creatorID int, lastName string, firstName string")
    authors = readers.library_authors(made, creators, spark.createDataFrame([(1, "author"), (2, "editor")], "creatorTypeID int, creatorType string"))
    files = p.where("p_partkey % 5 = 0").select(F.col("p_partkey").alias("parentItemID"), F.concat(F.lit("a"), k).alias("key"), F.lit("storage:x.pdf").alias("path"), F.lit("application/pdf").alias("contentType"))
    out = readers.library_papers(wide, authors, readers.library_attachments(files, "/store"))
    return out.select("paper_id", "doi", "title", "year", "venue", F.array_join("authors", ";").alias("authors"), "pdf_path")


@query("SELECT item_id FROM benchmark WHERE item_id % 3 <> 0")
def inbox_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Files that arrive in a folder, in two runs that share their progress; those done before are left out."""
    box, out, progress = (scratch(spark, n) for n in ("inbox", "seen", "progress"))
    b = load(spark, sf, "benchmark").select(F.col("item_id").alias("d"), F.col("text").alias("value"))
    for half in (0, 1):
        b.where(F.col("d") % 2 == half).repartition("d").write.partitionBy("d").mode("append").option("compression", "none").text(box)
        incremental.available_now(incremental.inbox(spark, f"{box}/*", pattern="*.txt"), incremental.write_batches(out), progress)
    seen = spark.read.parquet(out).select(F.regexp_extract("path", "d=([0-9]+)/", 1).cast("long").alias("item_id"), "sha256")
    return incremental.unprocessed(seen.distinct().select("item_id"), load(spark, sf, "benchmark").where("item_id % 3 = 0"), "item_id")


@query("SELECT count(*) AS papers, count(DISTINCT p_partkey % 3) AS methods FROM part")
def batches(spark: SparkSession, sf: str) -> DataFrame:
    """Rows dealt into batches by hash: every row is in one batch, and batches are of about the size asked for."""
    p = load(spark, sf, "part").select("p_partkey")
    sizes = ingest.in_batches(p, "p_partkey", 50).groupBy("batch").agg(F.count("*").alias("n"))
    fair = sizes.agg(F.sum("n").alias("papers"), F.max("n").alias("most")).where("most < 150")
    first = ingest.first_seen(p.withColumn("key", F.col("p_partkey") % 3), F.col("key"), "p_partkey")
    return fair.select("papers").join(F.broadcast(first.agg(F.count("*").alias("methods"))), how="cross")


@query("WITH s AS (SELECT unnest(['apa', 'informal', 'mla']) AS m) SELECT CASE WHEN c_custkey % 3 = 0 THEN 'apa' WHEN c_custkey % 3 = 1 THEN 'mla' ELSE 'informal' END AS parse_method, CASE WHEN c_custkey % 3 = 2 THEN 'medium' ELSE 'high' END AS band, count(*) AS n, count(*) FILTER (c_custkey % 3 = 0) AS with_doi, count(*) AS with_year FROM customer GROUP BY ALL")
def citation_statistics(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of three kinds, parsed and counted by method and confidence."""
    k = F.col("c_custkey")
    year = (1980 + k % 40).cast("string")
    text = F.when(k % 3 == 0, F.concat(F.lit("Smith, J. A., & Jones, B. ("), year, F.lit("). Effects of daylight on people. Journal of Tests, 12. doi:10.1234/x"), k.cast("string"))).when(k % 3 == 1, F.concat(F.lit('Smith, John. "Daylight in the office at work." Journal of Tests, vol. 3, '), year)).otherwise(F.concat(F.lit("[web] "), year, F.lit(" a long note about light and people at work")))
    return P.parse_statistics(load(spark, sf, "customer").select(P.parse_citations(text).alias("citation")))


@query("""SELECT concat('r', n_regionkey, '.n', n_nationkey) AS path, CASE WHEN n_nationkey % 7 = 5 THEN 'none' WHEN n_nationkey % 3 = 1 THEN 'env' WHEN n_nationkey % 2 = 0 THEN 'over' ELSE n_name END AS value FROM nation""")
def configuration(spark: SparkSession, sf: str) -> DataFrame:
    """Settings out of a table of nations, laid over each other in depth, the environment last. Settings are the driver's, so the table is one of settings' size."""
    rows = load(spark, sf, "nation").select("n_regionkey", "n_nationkey", "n_name").collect()
    base, over, environ = {}, {}, {}
    for region, nation, name in rows:
        if nation % 7 != 5:
            base.setdefault(f"r{region}", {})[f"n{nation}"] = name
            if nation % 2 == 0:
                over.setdefault(f"r{region}", {})[f"n{nation}"] = "over"
            if nation % 3 == 1:
                environ[f"CORPUSLOOM_R{region}__N{nation}"] = "env"
    settings = config.with_environment(config.merged(base, over), environ=environ)
    return spark.createDataFrame([(p, config.get(settings, p, "none")) for p in (f"r{region}.n{nation}" for region, nation, _ in rows)], "path string, value string")


@query(cte("papers") + """, f AS (SELECT paper_id, unnest(['environmental_factors', 'settings', 'other']) AS facet, unnest([k % 10 / 10, k % 7 / 10, 0.5]) AS s, k FROM papers)
SELECT paper_id, round(0.7 * (k % 10 / 10) / 2 + 0.3 * (k % 7 / 10 + 0.5) / 2, 6) AS triage_score, CASE WHEN 0.7 * (k % 10 / 10) / 2 + 0.3 * (k % 7 / 10 + 0.5) / 2 >= 0.4 THEN 'review' ELSE 'reject' END AS decision FROM papers""")
def triage_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Triage of facet scores as the discovery run stores it, then read back as a profile."""
    p = view(spark, sf, "papers")
    facets = p.select("paper_id", F.explode(F.array(*[F.struct(F.lit(n).alias("facet_id"), s.alias("score")) for n, s in (("environmental_factors", F.col("k") % 10 / 10), ("settings", F.col("k") % 7 / 10), ("other", F.lit(0.5)))])).alias("f")).select("paper_id", "f.*")
    return taxonomy.triage(taxonomy.facet_max(facets, "paper_id"), "paper_id").withColumn("triage_score", F.round("triage_score", 6))


@query(_EXTERNAL + """, r AS (SELECT 'import' AS phase, (SELECT count(*) FROM papers) + (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'expand', count(DISTINCT d) FROM x UNION ALL SELECT 'acquire', (SELECT count(*) FROM papers WHERE doi IS NOT NULL AND pdf_path IS NULL) + (SELECT count(*) FROM customer)
 UNION ALL SELECT unnest(['classify', 'bundle', 'feedback', 'gaps', 'target']), NULL) SELECT phase, 'done' AS state, n FROM r""")
def discovery_run(spark: SparkSession, sf: str) -> DataFrame:
    """All eight phases over the corpus: their states, and the rows of three."""
    papers = view(spark, sf, "papers").select("paper_id", "doi", "title", "pdf_path")
    new = load(spark, sf, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("paper_id"), F.concat(F.lit("10.3/"), F.col("c_custkey").cast("string")).alias("doi"), F.col("c_name").alias("title"), F.lit(None).cast("string").alias("pdf_path"))
    e = load(spark, sf, "embeddings")
    facet = lambda c: F.when(c % 2 == 0, "environmental_factors").otherwise("outcomes")
    node = F.concat(F.when(F.col("label") % 2 == 0, "env.l").otherwise("out.l"), F.col("label").cast("string")).alias("node_id")
    nodes = taxonomy.centroids(e, "label").select(node, facet(F.col("label")).alias("facet_id"), F.lit(1).alias("level"), "centroid")
    none = F.array().cast(_EFFECT)
    tables = {
        "papers": papers, "rows": new.unionByName(papers), "vectors": e.select(F.concat(F.lit("p"), F.col("vec_id").cast("string")).alias("paper_id"), "embedding"), "nodes": nodes, "taxonomy": nodes.drop("centroid"),
        "citations": view(spark, sf, "citations").where("cited_doi is not null"), "files": papers.select(F.col("pdf_path").alias("path")).where("path is not null").distinct(), "claims": _claims(spark, sf).withColumn("moderators", none),
        "queue": spark.createDataFrame([], "doi string, discovery_count int, priority_score double, title string, discovered_from string"),
    }
    return discovery.discover(tables).report(spark).select("phase", "state", F.when(F.col("phase").isin("import", "expand", "acquire"), F.col("rows")).alias("n"))


_BOUNDED = cte("papers") + """, c AS (SELECT k AS seq, CASE WHEN k % 4 = 0 THEN '10.1234/P.' || k WHEN k % 4 = 1 THEN '10.66/d' || (k % 50) END AS doi, CASE WHEN k % 4 = 2 THEN 'Shared title ' || (k % 20) ELSE 'Own title ' || k END AS title, (k % 50) / 50 AS score, k % 4 AS depth FROM papers),
m AS (SELECT *, (doi IS NOT NULL AND (lower(doi) IN (SELECT lower(doi) FROM papers WHERE doi IS NOT NULL) OR seq > min(seq) OVER (PARTITION BY lower(doi)))) OR seq > min(seq) OVER (PARTITION BY lower(title)) AS dup FROM c),
o AS (SELECT *, CASE WHEN dup THEN 'duplicate' WHEN depth > 2 THEN 'rejected' WHEN score < 0.4 THEN 'rejected' ELSE 'queued' END AS outcome, CASE WHEN dup THEN 'Already' WHEN depth > 2 THEN 'Exceeds' WHEN score < 0.4 THEN 'Below' ELSE 'Relevant' END AS reason FROM m)"""


def _bounded(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers")
    c = p.selectExpr("k AS seq", "CASE WHEN k % 4 = 0 THEN concat('10.1234/P.', k) WHEN k % 4 = 1 THEN concat('10.66/d', k % 50) END AS doi", "CASE WHEN k % 4 = 2 THEN concat('Shared title ', k % 20) ELSE concat('Own title ', k) END AS title", "(k % 50) / 50 AS score", "k % 4 AS depth", "'text' AS abstract")
    return expansion.bounded(c.withColumn("top_facets", F.array().cast("array<struct<facet:string,score:double>>")), p.select("doi"), p.select("title"))


@query(_BOUNDED + " SELECT seq, outcome, reason FROM o")
def bounded_expansion(spark: SparkSession, sf: str) -> DataFrame:
    return _bounded(spark, sf).select("seq", "outcome", F.split("reason", " ")[0].alias("reason"))


@query(_BOUNDED + ", n AS (SELECT count(*) AS a, count(*) FILTER (outcome = 'duplicate') AS d, count(*) FILTER (outcome = 'queued') AS q, count(*) FILTER (outcome = 'rejected') AS r FROM o) " + _union("SELECT 'candidates' AS metric, a::DOUBLE AS n FROM n", "SELECT 'duplicates_skipped', d FROM n", "SELECT 'scored', q + r FROM n", "SELECT 'queued', q FROM n", "SELECT 'rejected', r FROM n", "SELECT 'acceptance_rate', round(q / (q + r), 6) FROM n", "SELECT reason, count(*) FROM o GROUP BY reason"))
def bounded_report(spark: SparkSession, sf: str) -> DataFrame:
    row, histogram = expansion.bounded_report(_bounded(spark, sf))
    return unpivoted(row.withColumn("acceptance_rate", F.round("acceptance_rate", 6))).unionAll(histogram.select("reason", F.col("n").cast("double")))


@query("WITH f AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN 'mechanism' ELSE 'boundary' END AS g, 'p' || (p_partkey % 40) AS paper, p_size / 50 AS p FROM part) SELECT g AS gap_type, count(*) AS queries, count(DISTINCT paper) AS papers, round(avg(p), 6) AS mean_priority, max(p) AS highest FROM f GROUP BY g")
def feedback_summary(spark: SparkSession, sf: str) -> DataFrame:
    f = load(spark, sf, "part").selectExpr("CASE WHEN p_partkey % 3 = 0 THEN 'mechanism' ELSE 'boundary' END AS gap_type", "concat('p', p_partkey % 40) AS paper_id", "p_size / 50 AS priority")
    return gaps.feedback_summary(f).withColumn("mean_priority", F.round("mean_priority", 6))


@query(_CELLS + " SELECT cell_id, CASE WHEN cell_type = 'theory' THEN 'pending' ELSE 'complete' END AS status, CASE WHEN cell_type = 'theory' THEN 0 ELSE length(cell_id) END AS papers_found, CASE WHEN cell_type <> 'theory' THEN 'timeout' END AS error FROM c")
def cell_reset(spark: SparkSession, sf: str) -> DataFrame:
    cells = gaps.search_cells(*_tree(spark, sf)).select("cell_id", "cell_type", F.lit("complete").alias("status"), F.length("cell_id").alias("papers_found"), F.lit("timeout").alias("error"))
    return gaps.reset_cells(cells, cells.where("cell_type = 'theory'"), ["papers_found"]).drop("cell_type")


@query(_NODES + " SELECT node_id, 'seed' AS seed FROM n WHERE starts_with(node_id, 'w.asia.') AND n_seeds > 0")
def node_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return taxonomy.seeds_of(_nodes(spark, sf), "w.asia")


@query(cte("papers") + " SELECT paper_id, CASE WHEN k % 2 = 0 AND status IN ('candidate', 'pending_scorer', 'downloaded') THEN 'queued_for_eater' ELSE status END AS status, CASE WHEN k % 2 = 0 THEN status IN ('candidate', 'pending_scorer', 'downloaded') END AS moved FROM papers")
def job_queue(spark: SparkSession, sf: str) -> DataFrame:
    p = view(spark, sf, "papers").select("paper_id", "k", "status")
    return ingest.enqueued(p, p.where("k % 2 = 0"), STATUS_TRANSITIONS).drop("k")
