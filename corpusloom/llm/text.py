"""Column expressions that several operators share. All are built-in functions, evaluated in the JVM, linear (or n log n) in a text and its matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space that separates words, as a Java class.
SPACE = r"[\x20\x09-\x0D]"
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"
#: Code points of a block; a piece of text is cut out of the blocks it touches, so no cut walks the whole text.
_BLOCK = 1024
#: A broadcast is asked for only below this many bytes, measured.
BROADCAST_BYTES = 8 << 20


def words(text: Column) -> Column:
    """Runs of characters other than white space; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), lambda w: w != "")


def let(name: str, value: str, body: str) -> str:
    """SQL that evaluates ``value`` once and names it in ``body``."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def running(values: str, both: str) -> str:
    """SQL for the running ``both`` (of x and y) over an array, in log2(n) passes that each add what stands 2**k places before."""
    step = both.format(x="x_", y="get(acc_, cast(i_ - shiftleft(1, k_) as int))")
    return f"aggregate(sequence(0, length(bin(greatest(size({values}) - 1, 0))) - 1), {values}, (acc_, k_) -> transform(acc_, (x_, i_) -> case when i_ >= shiftleft(1, k_) then {step} else x_ end))"


def located(text: str, pattern: str, kind: str) -> str:
    """SQL for all matches of a Java pattern in the SQL expression ``text``, in order: (kind, start, end, value), in code points.

    The gaps between the matches come from ``split``, so an end is the running sum of the lengths.
    ``pattern`` must not match the empty string.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    cut = f"zip_with(split({text}, '{p}', -1), regexp_extract_all({text}, '{p}', 0), (g, m) -> named_struct('n', length(g) + coalesce(length(m), 0), 'value', m))"
    ends = let("n_", "transform(cut_, c -> c.n)", running("n_", "{x} + {y}"))
    found = f"zip_with(slice(cut_, 1, size(cut_) - 1), slice({ends}, 1, size(cut_) - 1), (c, e) -> named_struct('kind', '{kind}', 'start', e - length(c.value), 'end', e, 'value', c.value))"
    return let("cut_", cut, f"case when size(cut_) < 2 then cast(array() as {SPANS}) else {found} end")


def _piece(a: str, b: str) -> str:
    """SQL for the code points from ``a`` to before ``b`` of the text whose blocks are blocks_."""
    at = lambda x: f"cast({x} div {_BLOCK} as int)"
    return f"""case when {b} <= {a} then '' when {at(a)} = {at(b)} then substring(get(blocks_, {at(a)}), {a} % {_BLOCK} + 1, {b} - {a})
        else concat(substring(get(blocks_, {at(a)}), {a} % {_BLOCK} + 1), array_join(slice(blocks_, {at(a)} + 2, {at(b)} - {at(a)} - 1), ''), coalesce(substring(get(blocks_, {at(b)}), 1, {b} % {_BLOCK}), '')) end"""


def rebuilt(text: str, marks: str, put: str) -> str:
    """SQL for ``text`` with each of ``marks`` (structs with start and end, sorted by start) replaced by ``put``.

    ``put`` may use the mark m_ and ``before_``, the end of what the marks before it cover; of overlapping
    marks every code point goes once.
    """
    before = "coalesce(get(reach_, m_at - 1), 0)"
    pieces = f"transform(marks_, (m_, m_at) -> {let('before_', before, f"concat({_piece('before_', 'm_.start')}, {put})")})"
    last, size = "coalesce(get(reach_, size(reach_) - 1), 0)", f"length({text})"
    tail = let("last_", last, let("size_", size, _piece("last_", "size_")))
    body = f"array_join(concat({pieces}, array({tail})), '')"
    reach = let("e_", "transform(marks_, m -> m.end)", running("e_", "greatest({x}, {y})"))
    return let("marks_", marks, let("reach_", f"case when size(marks_) > 0 then {reach} else cast(array() as array<int>) end", let("blocks_", f"regexp_extract_all({text}, '(?s).{{1,{_BLOCK}}}', 0)", body)))


def sized(df: DataFrame) -> DataFrame:
    """``df``, marked for broadcast if its columns, all strings or longs, are measured below BROADCAST_BYTES; else as it is, for a shuffled join."""
    width = sum((F.coalesce(F.octet_length(c), F.lit(0)) if t == "string" else F.lit(8)).cast("long") + F.lit(16) for c, t in df.dtypes)
    size = df.agg(F.sum(width).alias("n")).first()["n"] or 0
    return F.broadcast(df) if size <= BROADCAST_BYTES else df
