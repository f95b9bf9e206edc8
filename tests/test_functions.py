import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import normalize as N
from corpusloom.functions import parse as P
from corpusloom.functions import similarity as S


def one(spark, values, expr, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"v {kind}").select(expr(F.col("v"))).collect()]


def test_doi_rules(spark):
    text = ["10.1234/test", "https://doi.org/10.1234/test", "See DOI: 10.1234/test for details", "", "no doi here", None]
    assert one(spark, text, N.doi_in_text) == ["10.1234/test"] * 3 + [None] * 3
    assert one(spark, ["10.1234/test", "https://doi.org/10.1234/test", "DOI:10.1234/test", "not a doi", ""], N.doi_resolver) == ["10.1234/test"] * 3 + [None] * 2
    assert one(spark, [" https://doi.org/10.1/A). ", None, "doi:10.1/b;"], N.doi_inventory) == ["10.1/a", "", "10.1/b"]
    assert one(spark, ["10.1016_j.jenvp.2020.01.001"], N.doi_in_filename) == ["10.1016.j.jenvp.2020.01.001"]
    assert one(spark, [" HTTPS://DOI.ORG/10.1/x "], N.doi_citation) == ["10.1/x"]


def test_titles_and_names(spark):
    assert one(spark, ["The Effects of Daylight on Cognitive Performance", "Effects of daylight on cognitive performance"], N.title_key) == ["cognitive daylight effects performance"] * 2
    assert {"daylight", "cognitive", "performance"} <= set(one(spark, ["Effects of natural daylight on cognitive performance in offices"], N.key_terms)[0])
    assert one(spark, ["Smith, John", "John Smith", "J. Smith", None], N.surname) == ["smith", "smith", "smith", ""]
    assert set(one(spark, [["Smith, J.", "Jones, B.C.", "Williams"]], N.surnames, "array<string>")[0]) == {"smith", "jones", "williams"}
    assert one(spark, ["Daylight_and-Alertness!"], N.inventory_key) == ["daylight and alertness"]
    assert one(spark, ["J. of Tests & More"], N.venue) == ["j. of tests and more"]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(alphabet="abcdef -_.ABC12", max_size=20), min_size=1, max_size=8))
def test_keys_are_idempotent(spark, values):
    for f in (N.title_key, N.inventory_key, N.seen_key, N.venue):
        once = one(spark, values, f)
        assert one(spark, once, f) == once


def test_inverted_index(spark):
    index = {"built": [1], "environment": [3], "for": [2], "Test": [0]}
    assert one(spark, [index], N.from_inverted_index, "map<string,array<int>>") == ["Test built for environment"]
    assert one(spark, [{"a": [0], "b": [2]}], lambda c: N.from_inverted_index(c, keep_gaps=True), "map<string,array<int>>") == ["a  b"]


def test_year_pages_notes(spark):
    assert one(spark, ["x (2020) y", "a, 1999. b", "in 2015 then", "1750", None], N.year_in_text) == [2020, 1999, 2015, None, None]
    assert one(spark, ["pp. 420-421."], N.pages) == ["420-421"]
    assert one(spark, [None, "note", "old"], lambda c: N.append_note(c, "note")) == ["note", "note", "old\nnote"]


def test_sequence_ratio_is_difflib(spark):
    pairs = [("tide", "diet"), ("diet", "tide"), ("daylight", "daylights"), ("", "a")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(S.sequence_ratio("a", "b")).collect()]
    assert got == [difflib.SequenceMatcher(None, a, b).ratio() for a, b in pairs]


def test_repair_score(spark):
    tok = lambda c: N.tokens(F.lit(c))
    score = lambda a, b, y: spark.range(1).select(S.repair_score(tok(a), tok(b), F.lit(2021), F.lit(y), F.lit("Smith"), F.array(F.lit("J. Smith")), F.lit(None).cast("string"), F.lit("10.1000/good"))).first()[0]
    assert score("Built environment and stress", "Built environment and stress", 2021) >= 0.8
    assert score("Environmental stress and cognition", "Marine ecosystems and coral bleaching", 2015) < 0.35


def test_cosine_guards(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), (None, [1.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(S.cosine(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.0]


CITATIONS = [
    "Smith, J. A., & Jones, B. C. (2020). The effects of daylight on cognitive performance. Journal of Environmental Psychology, 45(3), 100-110.",
    'Ulrich, Roger S. "View through a Window May Influence Recovery from Surgery." Science, vol. 224, no. 4647, 1984, pp. 420-421.',
    "Ledoux, J.E. Cognitive-Emotional Interactions in the Brain. Cogn. Emot. 2008, 3, 267-289. https://doi.org/10.1080/02699930802132356",
    "Williams Goldhagen, S. Welcome to Your World: How the Built Environment Shapes Our Lives; HarperCollins: New York, NY, USA, 2017.",
    "Glass & Singer 1972 Urban Stress", "", None,
]


def test_citations(spark):
    apa, mla, mdpi, book, informal, empty, null = one(spark, CITATIONS, P.parse_citations)
    assert apa["year"] == 2020 and "Smith" in apa["authors"][0] and apa["title"] and apa["confidence"] > 0.5
    assert mla["year"] == 1984 and "Window" in mla["title"] and mla["confidence"] > 0.3 and mla["pages"] == "420-421"
    assert mdpi["doi"].startswith("10.1080") and mdpi["year"] == 2008
    assert book["year"] == 2017 and informal["year"] == 1972
    assert empty["confidence"] == 0.0 and null["confidence"] == 0.0


def test_filenames(spark):
    a, b, c, d = one(spark, ["Wastiels,_L.,_&_He.pdf", "2020_Smith_Daylight_Effects.pdf", "10.1016_j.jenvp.2020.01.001.pdf", "View Through Window Ulrich 1984.pdf"], P.parse_filename)
    assert "Wastiels" in a["authors"][0] and b["year"] == 2020 and "Smith" in b["title"]
    assert "10.1016" in c["doi"] and d["year"] == 1984


def test_columns(spark):
    h = {f: c for f, (c, _) in P.match_headers(["DOI", "Title", "Authors", "Year", "Journal"]).items()}
    assert (h["doi"], h["title"], h["authors"], h["year"]) == ("DOI", "Title", "Authors", "Year")
    assert P.match_headers(["Row Number", "Reference Information"])["citation"][0] == "Reference Information"
    df = spark.createDataFrame([("10.1234/test.123", "Some Title", "2020"), ("10.5678/test.456", "Another Title", "2021")], "A string, B string, C string")
    found = P.detect_columns(df)
    assert found["doi"] == "A" and found["year"] == "C"


def test_questions(spark):
    asked = ["What affects mood?", "what does daylight affect?", "How many claims about noise", "contradictory claims about noise", "show claims about noise?", "find papers on glare", "hello", "how many claims are there about noise?"]
    assert [(r["type"], r["construct"]) for r in one(spark, asked, P.parse_question)] == [("what_affects", "mood"), ("affects_what", "daylight"), ("count_claims", "noise"), ("contradictions", "noise"), ("claims_about", "noise"), ("papers_about", "glare"), ("general_search", "hello"), ("count_claims", "noise")]
    assert one(spark, ["contradictory claims about noise"], lambda c: P.parse_question(c, compat=True))[0]["type"] == "claims_about"


@pytest.mark.parametrize("api,record", [("openalex", '{"doi":"https://doi.org/10.1/X","title":"T","publication_year":2020,"abstract_inverted_index":{"b":[1],"a":[0]},"authorships":[{"author":{"display_name":"A B"}}]}'), ("crossref", '{"DOI":"10.1/X","title":["T"],"author":[{"given":"A","family":"B"}],"published":{"date-parts":[[2020,1]]},"abstract":"<p>a b</p>"}'), ("semantic_scholar", '{"title":"T","year":2020,"abstract":"a b","authors":[{"name":"A B"}],"externalIds":{"DOI":"10.1/X"}}')])
def test_api_records(spark, api, record):
    r = one(spark, [record], lambda c: P.normalise_record(c, api))[0]
    assert (r["doi"], r["title"], r["authors"], r["year"], r["abstract"]) == ("10.1/x", "T", ["A B"], 2020, "a b")


def test_pubmed(spark):
    xml = '<PubmedArticle><Article><ArticleTitle>T</ArticleTitle><Journal><Title>J</Title><PubDate><Year>2019</Year></PubDate></Journal><Abstract><AbstractText>x</AbstractText></Abstract><AuthorList><Author><LastName>B</LastName></Author></AuthorList></Article><ArticleId IdType="doi">10.1/Z</ArticleId></PubmedArticle>'
    r = one(spark, [xml], P.normalise_pubmed)[0]
    assert (r["doi"], r["title"], r["year"], r["venue"], r["authors"]) == ("10.1/z", "T", 2019, "J", ["B"])


def test_resolve_terms(spark):
    got = {r["term"]: (r["term_id"], r["score"]) for r in P.resolve_terms(spark.createDataFrame([("Daylight",), ("daylihgt level",), ("zzz",)], "term string"), spark.createDataFrame([("env.day", "daylight"), ("env.lvl", "daylight level")], "term_id string, name string")).collect()}
    assert got["Daylight"] == ("env.day", 1.0) and got["daylihgt level"][0] == "env.lvl" and got["zzz"][0] is None
