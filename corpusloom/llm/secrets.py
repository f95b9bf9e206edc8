"""Secret scans with corpus-wide ownership frequency.

Base findings (kinds assign, access, hex) always stay. The method adds candidates of other shapes
(tokens with a known prefix, signed web tokens, private key blocks, mixed random-looking strings);
the hash of every candidate, base ones included, is counted over the corpus by distinct repositories
and distinct owners. A value that several owners share is an example copied around; one that a single
owner holds is live-looking. Only live-looking candidates are added to a document's spans, base
findings carry their verdict beside them.

Values are compared by SHA-256, never shuffled in clear. Counts are partial aggregates over distinct
(hash, owner, repository), so a hot example costs a row for each pair and task; the verdict returns by
an equi-join that adaptive execution splits.

Defined results: a null text is the empty text; a null owner or repository is an owner or repository
of its own; of rows with one id each keeps its own findings; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.shared import clear_of, materialise

EXAMPLE_OWNERS = 3
KINDS = ("assign", "access", "hex", "token", "random")
# The base patterns. Runs of a class are maximal, so a least length inside the pattern
# finds what the plain pattern finds and keeps; only assign must match first and be dropped later.
_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_TOKEN = re.compile(r"(?:ghp_|gho_|ghs_|glpat-|xox[abprs]-|sk_live_|rk_live_|npm_)[A-Za-z0-9_-]{16,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY-----")
_RANDOM = re.compile(r"[A-Za-z0-9+/_-]{24,}")


def _entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def _random_looking(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value) and _entropy(value) >= 4.0


def scan(text: str) -> list[tuple[str, int, int, str, bool]]:
    """(kind, start, end, value, base) by start, then kind; candidates that overlap a base finding are left out."""
    base = [("assign", m.start(), m.end(), m.group(1)) for m in _ASSIGN.finditer(text) if len(m.group(1)) >= 8]
    base += [("access", m.start(), m.end(), m.group()) for m in _ACCESS.finditer(text)]
    base += [("hex", m.start(), m.end(), m.group()) for m in _HEX.finditer(text)]
    out, taken = [(*b, True) for b in base], [(b[1], b[2]) for b in base]
    for kind, pattern in (("token", _TOKEN), ("random", _RANDOM)):
        clear = _clear_of(taken)
        new = [m for m in pattern.finditer(text) if (kind == "token" or _random_looking(m.group())) and clear(*m.span())]
        out += [(kind, m.start(), m.end(), m.group(), False) for m in new]
        taken += [m.span() for m in new]
    return sorted(out, key=lambda f: (f[1], KINDS.index(f[0])))


def _clear_of(spans: list[tuple[int, int]]) -> Callable[[int, int], bool]:
    """Whether a span overlaps none of ``spans``."""
    starts: list[int] = []
    ends: list[int] = []
    for start, end in sorted(spans):
        if ends and start < ends[-1]:
            ends[-1] = max(ends[-1], end)
        else:
            starts.append(start)
            ends.append(end)

    def clear(start: int, end: int) -> bool:
        k = bisect_left(starts, end) - 1
        return k < 0 or ends[k] <= start

    return clear


_FOUND = "array<struct<kind:string,start:int,end:int,hash:binary,base:boolean>>"


def candidates(docs: DataFrame, keep: list[str], *, text_col: str = "text") -> DataFrame:
    """The columns ``keep`` with ``found``, the candidates of each row in order."""
    schema = ", ".join([*(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep), f"found {_FOUND}"])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                found = [[{"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).digest(), "base": b} for k, s, e, v, b in scan(t)] if t else [] for t in part.column(len(keep)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(k) for k in range(len(keep))] + [pa.array(found, kind)], names=[*keep, "found"])

    return docs.select(*keep, F.col(text_col).alias("text__")).mapInArrow(run, schema)


def ownership(found: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """hash, n_owners, n_repositories over the corpus."""
    each = found.select(owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), F.explode("found.hash").alias("hash"))
    tag = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    pairs = each.groupBy("hash", tag("owner").alias("owner"), tag("repository").alias("repository")).agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.count("*").alias("repositories"))
    return owners.groupBy("hash").agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"))


def judged(docs: DataFrame, ids: list[str], *, text_col: str = "text", owner_col: str = "source", repository_col: str = "doc_id", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row a document: the columns ``ids`` and ``findings`` (kind, start, end, base, live, n_owners, n_repositories), in order.

    A repository is ``repository_col`` within its owner. Findings that are neither base nor live are left out.
    """
    keep = list(dict.fromkeys([*ids, owner_col, repository_col]))
    rows = materialise(candidates(docs, keep, text_col=text_col).withColumn("row", F.monotonically_increasing_id()), "candidates")
    some = rows.where("size(found) > 0")
    verdict = ownership(some, F.col(owner_col), F.col(repository_col)).withColumn("live", F.col("n_owners") < example_owners)
    each = some.select("row", F.explode("found").alias("f")).select("row", "f.*")
    findings = (
        each.join(verdict, "hash").where("base or live")
        .groupBy("row").agg(F.collect_list(F.struct("start", F.expr(f"array_position(array({', '.join(repr(k) for k in KINDS)}), kind)").alias("rank"), "kind", "end", "base", "live", "n_owners", "n_repositories")).alias("findings"))
        .withColumn("findings", F.expr("transform(array_sort(findings), f -> named_struct('kind', f.kind, 'start', f.start, 'end', f.end, 'base', f.base, 'live', f.live, 'n_owners', f.n_owners, 'n_repositories', f.n_repositories))"))
    )
    return rows.select(*ids, "row").join(findings, "row", "left").select(*ids, F.coalesce("findings", F.array().cast(findings.schema["findings"].dataType)).alias("findings"))


def joined_spans(condition: str) -> Column:
    return F.array_join(F.expr(f"transform(filter(findings, f -> {condition}), f -> concat(f.kind, ':', f.start, ':', f.end))"), ",")


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """All columns of ``docs``, every finding in the text replaced by ``[SECRET]``; texts without one stay as they are.

    Findings are joined by id and a hash of the text, so rows that share an id are told apart. Columns
    hash__, findings__, i__ and h__ have to be renamed first.
    """
    clear_of(docs.columns, "hash__", "findings__", "i__", "h__")
    keyed = docs.withColumn("hash__", F.xxhash64(text_col))
    found = judged(keyed, [id_col, "hash__"], text_col=text_col, owner_col=owner_col, repository_col=id_col, example_owners=example_owners)
    found = found.where("size(findings) > 0").groupBy(F.col(id_col).alias("i__"), F.col("hash__").alias("h__")).agg(F.first("findings").alias("findings__"))
    found = materialise(found, "findings")  # its true size decides whether the texts are shuffled to meet it
    joined = keyed.join(found, F.col(id_col).eqNullSafe(F.col("i__")) & (F.col("hash__") == F.col("h__")), "left").select(*docs.columns, F.expr("transform(findings__, f -> named_struct('start', f.start, 'end', f.end))").alias("findings__"))
    at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(k) for k in range(len(names))]
            marks = batch.column(len(names))
            if marks.null_count < len(marks):
                columns[at] = pa.array([t if m is None else without(t, [(f["start"], f["end"]) for f in m]) for t, m in zip(columns[at].to_pylist(), marks.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(run, docs.schema)


def without(text: str, marks: list[tuple[int, int]]) -> str:
    """``text`` with ``[SECRET]`` for each mark (sorted by start); marks that overlap the one before lengthen it."""
    pieces, at = [], 0
    for start, end in marks:
        if start >= at:
            pieces += text[at:start], "[SECRET]"
        at = max(at, end)
    return "".join([*pieces, text[at:]])


def document_secrets(docs: DataFrame) -> DataFrame:
    """The digest columns of every document, and how its findings are judged."""
    count = lambda c: F.expr(f"cast(size(filter(findings, f -> {c})) as bigint)")
    return judged(docs, ["doc_id"]).select(
        "doc_id", *[count(f"f.base and f.kind = '{k}'").alias(f"n_{k}") for k in KINDS[:3]], F.sha2(joined_spans("f.base"), 256).alias("base_sha256"), joined_spans("true").alias("spans"),
        count("f.live").alias("n_live"), count("not f.live").alias("n_example"),
    )
