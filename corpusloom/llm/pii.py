"""PII by information-theoretic sanitisation, all in built-in expressions.

Base spans (kinds email, ip, card, phone) are found and always stay. Protected are the entities they
stand for: the normalised value and its class (an email's domain, the first half of an address, a card's
issuer, a phone's exchange), so that a value seen once is protected through its class. A term t of the corpus
discloses an entity e by the pointwise mutual information of their documents

    PMI(t, e) = log2( N c(t, e) / (df(t) df(e)) ),   disclosure = PMI(t, e) / IC(e),   IC(e) = -log2(df(e) / N)

with N documents, df over all of them and c the documents that hold both, wherever they stand in the text.
At ``REMOVE`` or more of an entity's information a term is removed, at ``GENERALISE`` or more it is
replaced by its class: the longest of its own beginnings, from three letters on, that the corpus holds so
widely that it discloses less; without one it is removed as well. Both happen in all texts that hold an entity
the term tells, wherever in the text it stands; from ``ELSEWHERE`` on, where the term all but equals the entity, in texts
without the entity too. (Below that, a term of a family of near copies would cost words in texts that have nothing to
protect.) Pairs need ``SUPPORT`` distinct texts: one text tells nothing, and copies lend no support.

Terms are runs of three letters or more, in lower case; a run that touches a base span is none.
Counting follows the entities: only documents that hold one of them with the support pair their terms with it, and
only terms that can disclose it: as c <= df(e), a disclosure of g needs df(t) <= N^(1-g) df(e)^g. So df comes first, over the
terms of these documents, and the product of a long list of addresses with a text's vocabulary is never made (one partial
aggregate over term and entity, so a hot entity costs a row for each term and task). Texts are scanned once; only those that hold a term beyond the threshold are
scanned again for its places.

Defined results: a null text is the empty text and has no span; repeated rows and equal texts get equal spans;
spans of different kinds may overlap, terms never overlap a base span; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import clear_of, materialise
from corpusloom.llm.text import SPANS, let, located, rebuilt, sized

KINDS = ("email", "ip", "card", "phone")
SUPPORT, ELSEWHERE, REMOVE, GENERALISE, LEAST_CLASS = 3, 0.99, 0.95, 0.85, 3
# The base patterns. Possessive, since no backtracking can help them, and started at the
# head of a run (or where the last match ended) only, since a later start reaches the same end: linear
# in the text, however long a run is.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_TERM = r"\p{L}{3,}+"
#: A letter no text has, put over base spans: a run of letters that touches one is no term.
_FILL = "ﾠ"
_HOLDS = {"email": "contains(text__, '@')", "ip": "contains(text__, '.')", "card": "true", "phone": "contains(text__, '+')"}
_MARKS = "array<struct<kind:string,start:int,end:int>>"


def _luhn(d: str) -> str:
    """True for digits whose checksum is 0: every second digit from the right is doubled, 9 taken off above 9."""
    one = f"cast(substr({d}, i, 1) as int)"
    return f"aggregate(sequence(1, length({d})), 0, (a, i) -> a + case when (length({d}) - i) % 2 = 0 then {one} when {one} > 4 then 2 * {one} - 9 else 2 * {one} end) % 10 = 0"


_DIGITS = "regexp_replace(x.value, '[^0-9]', '')"


def _kept(kind: str) -> str:
    """Whether the match x passes its kind's condition."""
    if kind == "ip":
        return f"x.value rlike '^{_PART}(?:[.]{_PART}){{3}}$'"
    if kind == "card":
        return f"exists(array({_DIGITS}), d -> case when length(d) between 12 and 19 then {_luhn('d')} else false end)"
    return f"length({_DIGITS}) between 9 and 15" if kind == "phone" else "true"


def base_spans() -> str:
    """SQL for the base spans of text__ by start, then kind as listed."""
    found = [f"case when {_HOLDS[k]} then filter({located('text__', PATTERNS[k], k)}, x -> {_kept(k)}) else cast(array() as {SPANS}) end" for k in KINDS]
    rank = "case x.kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(KINDS)) + " end"
    return f"""transform(
        array_sort(transform(concat({', '.join(found)}), x -> named_struct('start', x.start, 'rank', {rank}, 'kind', x.kind, 'end', x.end, 'value', x.value))),
        x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end, 'value', x.value))"""


_VALUE = f"case when x.kind = 'email' then lower(x.value) when x.kind = 'ip' then x.value else {_DIGITS} end"
_CLASS = "case x.kind when 'email' then substring_index(v, '@', -1) when 'ip' then substring_index(v, '.', 2) when 'card' then left(v, 6) else left(v, length(v) - 4) end"
_ENTITIES = f"array_distinct(flatten(transform(base, x -> {let('v', _VALUE, f"array(concat(x.kind, ':', v), concat(x.kind, '~', {_CLASS}))")})))"
#: The text with base spans filled, so that no term is found in them or touches them.
_MASKED = f"case when size(base) = 0 then text__ else {rebuilt('text__', 'base', f"repeat('{_FILL}', greatest(m_.end - greatest(before_, m_.start), 0))")} end"


def _copy(text: Column) -> Column:
    """What tells texts apart, in 96 bits."""
    return F.struct(F.xxhash64(text).alias("x"), F.hash(text).alias("y"))


def _scanned(docs: DataFrame, keep: list[str | Column], text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(*keep, text.alias("text__"), _copy(text).alias("copy")).withColumn("base", F.expr(base_spans()))


def entities(docs: DataFrame, keep: list[str], *, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``base`` (the base spans), ``entities``, ``terms`` (both distinct) and ``copy`` (a hash of the text)."""
    runs = f"regexp_extract_all({_MASKED}, '{_TERM.replace(chr(92), chr(92) * 2)}', 0)"
    terms = f"array_distinct(transform(filter({runs}, t -> not contains(t, '{_FILL}')), t -> lower(t)))"
    return _scanned(docs, keep, text_col).select(*keep, "base", F.expr(_ENTITIES).alias("entities"), F.expr(terms).alias("terms"), "copy")


def _disclosure(n: float) -> Column:
    """By ``both``, ``df_term`` and ``df_entity`` of ``n`` documents; null for an entity of every document."""
    content = F.log2(F.lit(n) / F.col("df_entity"))
    return F.when(content > 0, F.log2(F.lit(n) * F.col("both") / (F.col("df_term") * F.col("df_entity"))) / content)


def disclosures(found: DataFrame, *, support: int = SUPPORT, least: float = GENERALISE) -> DataFrame:
    """(term, entity, disclosure) of the pairs at or above ``least``, with document counts over all of ``found`` (as ``entities`` gives it)."""
    copies = found.where("size(entities) > 0").groupBy("copy").agg(F.count("*").alias("n"), F.first("entities").alias("entities"), F.first("terms").alias("terms"))
    copies = materialise(copies, "copies")
    of_entity = copies.select("n", F.explode("entities").alias("entity")).groupBy("entity").agg(F.sum("n").alias("df_entity"), F.count("*").alias("texts"))
    of_entity = materialise(of_entity.where(F.col("texts") >= support).select("entity", "df_entity"), "of_entity")
    n = float(max(found.count(), 1))
    # the widest spread of a term that can disclose `least` of an entity, as both <= df_entity; a hair more for rounding
    most = F.pow(F.lit(n), F.lit(1 - least)) * F.pow(F.col("df_entity"), F.lit(least)) * (1 + 1e-9)
    held = copies.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("texts")).where(F.col("texts") >= support)
    held = materialise(held.select("term"), "held-terms")
    of_term = found.select(F.explode("terms").alias("term")).join(sized(held), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df_term"))
    of_term = materialise(of_term.join(F.broadcast(of_entity.agg(F.max(most).alias("widest")))).where("df_term <= widest").drop("widest"), "of_term")
    terms = copies.select("copy", F.explode("terms").alias("term")).join(sized(of_term), "term").groupBy("copy").agg(F.collect_list(F.struct("df_term", "term")).alias("terms"))
    own = copies.select("copy", "n", F.explode("entities").alias("entity")).join(sized(of_entity), "entity").withColumn("most", most).join(terms, "copy")
    met = own.select("n", "entity", F.explode(F.expr("filter(terms, t -> t.df_term <= most)")).alias("t"))
    pairs = met.groupBy(F.col("t.term").alias("term"), "entity").agg(F.sum("n").alias("both"), F.count("*").alias("texts"))
    pairs = materialise(pairs.where(F.col("texts") >= support).select("term", "entity", "both"), "pairs")
    shown = pairs.join(sized(of_term), "term").join(sized(of_entity), "entity").select("term", "entity", _disclosure(n).alias("disclosure"))
    return shown.where(F.col("disclosure") >= least)


def told_terms(disclosed: DataFrame) -> DataFrame:
    """(term, entity, disclosure): each term once, with the entity it tells most of."""
    most = disclosed.groupBy("term").agg(F.max(F.struct("disclosure", "entity")).alias("m"))
    return most.select("term", F.col("m.entity").alias("entity"), F.col("m.disclosure").alias("disclosure"))


def holders(found: DataFrame, disclosed: DataFrame, *, elsewhere: float = ELSEWHERE) -> DataFrame:
    """(copy, term): the texts that hold a disclosing term and an entity it tells, or any text for a term from ``elsewhere`` on."""
    own = found.where("size(entities) > 0").select("copy", "terms", F.explode("entities").alias("entity")).join(sized(disclosed.select("entity").distinct()), "entity", "left_semi")
    own = own.select("copy", "entity", F.explode("terms").alias("term")).join(sized(disclosed.select("term", "entity")), ["term", "entity"], "left_semi")
    strong = disclosed.where(F.col("disclosure") >= elsewhere).select("term").distinct()
    return own.select("copy", "term").unionAll(found.select("copy", F.explode("terms").alias("term")).join(sized(strong), "term", "left_semi").select("copy", "term")).distinct()


def term_spans(docs: DataFrame, held: DataFrame, told: DataFrame, *, text_col: str = "text") -> DataFrame:
    """(copy, terms): of every text in ``held`` (copy, term) the places of these terms, by start; ``told``: term, kind, put."""
    held = materialise(held.join(sized(told.select("term", "kind", "put")), "term"), "holders")
    keyed = docs.select(F.col(text_col), _copy(F.coalesce(F.col(text_col), F.lit(""))).alias("copy"))
    texts = keyed.join(sized(materialise(held.select("copy").distinct(), "held")), "copy", "left_semi").dropDuplicates(["copy"])
    places = _scanned(texts, [], text_col).select("copy", F.expr(f"explode({let('masked_', _MASKED, located('masked_', _TERM, 'term'))})").alias("t"))
    placed = places.select("copy", F.lower("t.value").alias("term"), "t.start", "t.end").join(held, ["copy", "term"])
    sort = F.array_sort(F.collect_list(F.struct("start", "end", "kind", "put")))
    return placed.groupBy("copy").agg(sort.alias("terms"))


def _judged(docs: DataFrame, keep: list[str], text_col: str, support: int, remove: float, generalise: float, classes: bool = False) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and by text the places of told terms with what is put there; both written."""
    rows = materialise(entities(docs, keep, text_col=text_col), "entities")
    kind = F.when(F.col("disclosure") >= remove, "removed").otherwise("generalised")
    disclosed = materialise(disclosures(rows, support=support, least=generalise), "disclosed")
    told = materialise(told_terms(disclosed).withColumn("kind", kind), "told")
    put = F.lit("")
    if classes:
        told, put = told.join(term_classes(rows, told, generalise=generalise), "term", "left"), F.coalesce(F.concat("class", F.lit("*")), F.lit(""))
    return rows, materialise(term_spans(docs, holders(rows, disclosed), told.withColumn("put", put), text_col=text_col), "term-spans")


def findings(docs: DataFrame, keep: list[str], *, text_col: str = "text", support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """One row for every row of ``docs``: ``keep``, ``base`` and ``terms`` (kind removed or generalised, start, end), by start."""
    rows, placed = _judged(docs, keep, text_col, support, remove, generalise)
    placed = placed.select("copy", F.expr("transform(terms, x -> named_struct('kind', x.kind, 'start', x.start, 'end', x.end))").alias("terms"))
    return rows.select(*keep, "base", "copy").join(placed, "copy", "left").select(*keep, "base", F.coalesce("terms", F.array().cast(_MARKS)).alias("terms"))


def term_classes(found: DataFrame, told: DataFrame, *, generalise: float = GENERALISE) -> DataFrame:
    """(term, class): for every told term of kind generalised the longest beginning that discloses its entity less than ``generalise``, if there is one."""
    own = told.where("kind = 'generalised'").select("term", "entity", F.explode(F.expr(f"sequence({LEAST_CLASS}, greatest(length(term) - 1, {LEAST_CLASS}))")).alias("n")).where("n < length(term)")
    own = materialise(own.select("term", "entity", F.expr("left(term, n)").alias("class")), "beginnings")
    heads = sized(own.select(F.expr(f"left(class, {LEAST_CLASS})").alias("head")).distinct())
    rows = found.select(F.monotonically_increasing_id().alias("row"), "entities", F.explode("terms").alias("t")).withColumn("head", F.expr(f"left(t, {LEAST_CLASS})")).join(heads, "head", "left_semi")
    begun = rows.select("row", "entities", F.explode(F.expr(f"transform(sequence({LEAST_CLASS}, length(t)), n -> left(t, n))")).alias("class")).join(sized(own.select("class").distinct()), "class", "left_semi")
    begun = materialise(begun.groupBy("class", "row").agg(F.first("entities").alias("entities")), "begun")
    of_class = begun.groupBy("class").agg(F.count("*").alias("df_term"))
    both = begun.join(own.select("class", "entity").distinct(), "class").where(F.expr("array_contains(entities, entity)")).groupBy("class", "entity").agg(F.count("*").alias("both"))
    of_entity = found.select(F.explode("entities").alias("entity")).join(sized(own.select("entity").distinct()), "entity", "left_semi").groupBy("entity").agg(F.count("*").alias("df_entity"))
    shown = own.join(of_class, "class").join(both, ["class", "entity"]).join(of_entity, "entity").withColumn("d", _disclosure(float(max(found.count(), 1))))
    return shown.where(F.col("d") < generalise).groupBy("term").agg(F.max_by("class", F.length("class")).alias("class"))


def sanitise(docs: DataFrame, *, text_col: str = "text", support: int = SUPPORT, remove: float = REMOVE, generalise: float = GENERALISE) -> DataFrame:
    """All columns and rows of ``docs``, entities replaced by ``[KIND]``, generalised terms by their class and ``*``, removed terms by nothing.

    What goes depends on the text alone and is joined by it, so ids may be null or repeated. Columns c__, copy__
    and marks__ have to be renamed first.
    """
    clear_of(docs.columns, "c__", "copy__", "marks__")
    rows, placed = _judged(docs, [], text_col, support, remove, generalise, classes=True)
    based = rows.where("size(base) > 0").dropDuplicates(["copy"]).select("copy", "base").join(placed, "copy", "full")
    none = "cast(array() as array<struct<start:int,end:int,put:string>>)"
    marks = f"""array_sort(concat(coalesce(transform(base, x -> named_struct('start', x.start, 'end', x.end, 'put', concat('[', upper(x.kind), ']'))), {none}),
        coalesce(transform(terms, x -> named_struct('start', x.start, 'end', x.end, 'put', x.put)), {none})))"""
    marked = materialise(based.select(F.col("copy").alias("copy__"), F.expr(marks).alias("marks__")), "marks")
    joined = docs.withColumn("c__", _copy(F.coalesce(F.col(text_col), F.lit("")))).join(marked, F.col("c__") == F.col("copy__"), "left")
    name = f"`{text_col}`"
    text = rebuilt(name, "marks__", "case when m_.start < before_ then '' else m_.put end")
    return joined.withColumn(text_col, F.expr(f"case when marks__ is null then {name} else {text} end")).select(*docs.columns)


def document_findings(docs: DataFrame) -> DataFrame:
    """The digest columns of every document."""
    shown = "x -> concat(x.kind, ':', x.start, ':', x.end)"
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.kind = '{k}')) as bigint)").alias(f"n_{k}")
    order = "array_sort(concat(transform(base, (x, i) -> named_struct('start', x.start, 'i', i, 's', concat(x.kind, ':', x.start, ':', x.end))), transform(terms, x -> named_struct('start', x.start, 'i', 2147483647, 's', concat(x.kind, ':', x.start, ':', x.end)))))"
    return findings(docs, ["doc_id"]).select(
        "doc_id", *map(count, KINDS), F.sha2(F.array_join(F.expr(f"transform(base, {shown})"), ","), 256).alias("base_sha256"),
        F.array_join(F.expr(f"transform({order}, x -> x.s)"), ",").alias("spans"),
    )
