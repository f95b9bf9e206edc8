"""Scalar normalisers as Column -> Column functions. Classes are spelt out, so that any engine agrees on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that carry no meaning in a title.
TITLE_STOP_WORDS = ["a", "an", "the", "of", "and", "or", "in", "on", "at", "to", "for", "with", "by"]

_WS = r"\s+"


def blank_to_null(c: Column) -> Column:
    """Null for null, empty or white text: what counts as missing everywhere here."""
    return F.when(F.trim(c) != "", c)


def collapse(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, _WS, " "))


def fixed(c: Column, places: int = 2) -> Column:
    """A double with ``places`` decimals as printf writes it: by its exact binary value, exact halves to the even digit.

    ``format_string`` rounds the shortest decimal half up, so it differs where that ends in a 5 behind the last place:
    there the sign of ``ten * a - q`` tells, whose products are exact because ``a`` is cut into two halves of its bits.
    """
    a, ten = F.abs(c.cast("double")), float(10 ** (places + 1))
    q = F.rint(a * ten)
    high = a * 134217729.0 - (a * 134217729.0 - a)
    behind = (high * ten - q) + (a - high) * ten
    down = (q / ten == a) & (F.pmod(q, F.lit(10.0)) == 5.0) & ((behind < 0) | ((behind == 0) & (F.pmod((q - 5) / 10, F.lit(2.0)) == 0.0)))
    return F.when(c.isNotNull(), F.format_string(f"%.{places}f", F.when(down, F.signum(c.cast("double")) * ((q - 5) / ten)).otherwise(c.cast("double"))))


# ---------------------------------------------------------------- DOI: six rules that differ on purpose
def doi_inventory(c: Column) -> Column:
    """Lower case without resolver prefixes (each taken off once, in turn) and closing punctuation; null gives ''."""
    out = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    for prefix in ("https://doi.org/", "http://doi.org/", "doi.org/", "doi:"):
        out = F.trim(F.when(F.startswith(out, F.lit(prefix)), F.substr(out, F.lit(len(prefix) + 1))).otherwise(out))
    return F.regexp_replace(out, r"[).,;\]]+$", "")


def doi_resolver(c: Column) -> Column:
    """Without one of the resolver prefixes, null unless it starts with ``10.``."""
    out = F.trim(F.regexp_replace(F.lower(F.trim(c)), r"^(?:https?://(?:dx\.)?doi\.org/|doi:)\s*", ""))
    return F.when(F.startswith(out, F.lit("10.")), out)


doi_library = doi_resolver


def doi_in_text(c: Column) -> Column:
    """The first DOI in running text, lower case, without closing punctuation; null if there is none."""
    found = F.regexp_extract(c, r"""(10\.[0-9]{4,}/[^\s\]>"']+)""", 1)
    return F.nullif(F.lower(F.regexp_replace(found, "[.,;:]+$", "")), F.lit(""))


def doi_in_document(c: Column) -> Column:
    """The same for extracted document text: registrants of 4 to 9 digits, closing brackets cut off as well."""
    found = F.regexp_extract(c, r"""(?i)(10\.[0-9]{4,9}/[^\s"<>]+)""", 1)
    return F.nullif(F.lower(F.regexp_replace(found, r"[).,;\]]+$", "")), F.lit(""))


def doi_in_filename(c: Column) -> Column:
    """The DOI of a file name that writes dots as underscores; its slash stays lost."""
    return F.nullif(F.lower(F.regexp_extract(F.replace(c, F.lit("_"), F.lit(".")), r"(10[._][0-9]{4,}[._][^\s]+)", 1)), F.lit(""))


def doi_citation(c: Column) -> Column:
    return F.replace(F.trim(F.lower(c)), F.lit("https://doi.org/"), F.lit(""))


# ---------------------------------------------------------------- titles and names
def _plain_words(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", " "), _WS), lambda w: w != "")


def title_key(c: Column) -> Column:
    """Order-free key: words of 3 letters or more without stop words, sorted."""
    stop = F.array(*map(F.lit, TITLE_STOP_WORDS))
    return F.array_join(F.array_sort(F.filter(_plain_words(c), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 2))), " ")


def key_terms(c: Column, n: int = 5) -> Column:
    """The ``n`` longest words of 4 letters or more, earlier ones first among equals."""
    stop = F.array(*map(F.lit, TITLE_STOP_WORDS))
    words = F.filter(_plain_words(c), lambda w: ~F.array_contains(stop, w) & (F.length(w) > 3))
    ranked = F.array_sort(F.transform(words, lambda w, i: F.struct((-F.length(w)).alias("l"), i.alias("i"), w.alias("w"))))
    return F.array_distinct(F.transform(F.slice(ranked, 1, n), lambda x: x["w"]))


def inventory_key(c: Column) -> Column:
    """Lower case, ``_`` and ``-`` as blanks, everything but letters, digits and blanks deleted."""
    return collapse(F.regexp_replace(F.translate(F.lower(F.coalesce(c, F.lit(""))), "_-", "  "), r"[^a-z0-9\s]", ""))


def seen_key(c: Column) -> Column:
    """Lower case with punctuation deleted, words in place."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)[^\w\s]", ""))


def signature(doi: Column, title: Column, year: Column) -> Column:
    """``doi:...`` or, without a DOI, ``title:<60 letters and digits>:<year or unknown>``."""
    plain = F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]", ""), 1, 60)
    return F.coalesce(F.concat(F.lit("doi:"), F.lower(blank_to_null(doi))), F.concat(F.lit("title:"), plain, F.lit(":"), F.coalesce(year.cast("string"), F.lit("unknown"))))


def slug_id(title: Column, row_json: Column) -> Column:
    slug = F.substring(F.regexp_replace(F.lower(F.coalesce(title, F.lit(""))), "[^a-z0-9]", ""), 1, 30)
    return F.coalesce(F.nullif(slug, F.lit("")), F.substring(F.md5(row_json), 1, 12))


def paper_id(doi: Column, title: Column) -> Column:
    return F.coalesce(F.concat(F.lit("doi:"), blank_to_null(doi)), F.concat(F.lit("sha256:"), F.substring(F.sha2(F.coalesce(title, F.lit("")), 256), 1, 12)))


def queue_key(title: Column) -> Column:
    return F.concat(F.lit("title:"), F.sha1(F.lower(F.trim(F.coalesce(title, F.lit(""))))))


def surname(c: Column) -> Column:
    """The part before a comma, else the last word of two letters or more (else the last word)."""
    plain = F.lower(F.trim(F.coalesce(c, F.lit(""))))
    parts = F.filter(F.split(F.regexp_replace(plain, r"(?U)[^\w\s-]", " "), _WS), lambda w: w != "")
    long = F.filter(parts, lambda w: F.length(w) > 1)
    last = F.when(F.size(long) > 0, F.element_at(long, -1)).when(F.size(parts) > 0, F.element_at(parts, -1)).otherwise("")
    picked = F.when(F.contains(plain, F.lit(",")), F.trim(F.get(F.split(plain, ","), F.lit(0)))).otherwise(last)
    return F.regexp_replace(picked, r"(?U)[^\w-]", "")


def surnames(authors: Column) -> Column:
    """Distinct surnames of two letters or more."""
    return F.array_distinct(F.filter(F.transform(F.filter(authors, lambda a: a.isNotNull()), surname), lambda s: F.length(s) > 1))


def authors_from_field(c: Column) -> Column:
    """A spreadsheet field: ``;``, ``|`` or `` and `` between names, else commas."""
    sep = F.when(c.rlike(r"[;|]|\sand\s"), F.split(c, r"[;|]|\sand\s")).otherwise(F.split(c, ","))
    return F.filter(F.transform(sep, lambda a: F.trim(a)), lambda a: a != "")


def venue(c: Column) -> Column:
    return collapse(F.replace(F.lower(F.trim(F.coalesce(c, F.lit("")))), F.lit("&"), F.lit("and")))


def year_in_text(c: Column) -> Column:
    """``(2020)``, then ``, 2020.``, then any year 1900 to 2029; the first that lies in 1800 to 2030."""
    def one(pattern: str) -> Column:
        y = F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int")
        return F.when(y.between(1800, 2030), y)

    return F.coalesce(one(r"\(([0-9]{4})\)"), one(r",\s*([0-9]{4})[,.\s]"), one(r"\b(19[0-9]{2}|20[0-2][0-9])\b"))


def pages(c: Column) -> Column:
    found = r"([0-9]+)\s*[-–—]\s*([0-9]+)"
    return F.when(c.rlike(found), F.concat(F.regexp_extract(c, found, 1), F.lit("-"), F.regexp_extract(c, found, 2)))


def clean_text(c: Column) -> Column:
    """Dashes and quotes in their plain forms, white space collapsed."""
    return collapse(F.translate(c, "–—−“”„‘’`", "---\"\"\"'''"))


def strip_tags(c: Column) -> Column:
    return collapse(F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", " "))


def from_inverted_index(index: Column, *, keep_gaps: bool = False) -> Column:
    """Text of a map word -> positions; gaps between positions are dropped, or kept as empty words."""
    placed = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    if not keep_gaps:
        return F.array_join(F.transform(F.array_sort(placed), lambda x: x["w"]), " ")
    by_place = F.map_from_entries(placed)
    return F.array_join(F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(by_place))), lambda i: F.coalesce(F.element_at(by_place, i), F.lit(""))), " ")


def to_inverted_index(text: Column) -> Column:
    """Map word -> positions of the text's blank-separated words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")
    return F.transform(F.array(words), lambda ws: F.map_from_entries(F.transform(F.array_distinct(ws), lambda w: F.struct(w, F.filter(F.transform(ws, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull())))))[0]


def safe_filename(c: Column) -> Column:
    return F.substring(F.translate(c, ":/\\. ", "_____"), 1, 100)


def tokens(c: Column, *, letters_only: bool = False, least: int = 3) -> Column:
    """Distinct lower-case runs of letters (and digits) of at least ``least`` characters."""
    cls = "[a-z]" if letters_only else "[a-z0-9]"
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(f"({cls}+)"), 1), lambda t: F.length(t) >= least))


def append_note(notes: Column, note: str) -> Column:
    """``notes`` with the line ``note``, unless it is there already."""
    return F.when(F.coalesce(blank_to_null(notes), F.lit("")) == "", F.lit(note)).when(F.contains(notes, F.lit(note)), notes).otherwise(F.concat(notes, F.lit("\n" + note)))


def url_key(c: Column) -> Column:
    """Scheme, www., query, fragment and closing slashes off; the host in lower case."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.trim(c), "^[A-Za-z]+://", ""), "[?#].*$", ""), "/+$", "")
    host = F.lower(F.regexp_extract(bare, "^([^/]*)", 1))
    return F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_extract(bare, "^[^/]*(.*)$", 1))
