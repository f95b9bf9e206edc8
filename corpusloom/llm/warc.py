"""WARC: write whole-file gzip archives, normalise them to one gzip member a record, read by index.

``write_archives`` puts a record for every row into archives that are each a single gzip stream,
as careless tools leave them. ``normalise`` inflates such a stream once, front to back, rewrites
every record as a gzip member of its own and writes a sidecar index (one JSON line a record: offset,
length, type, id, digest). ``read_archives`` then reads members at the offsets of that index.

Archives roll over at a fixed size, so neither a file nor the memory of a task grows with the input.
Files are named by task attempt and appear by a rename, and the table of archives lists those of the
attempt that Spark committed: retries and speculative copies leave files that nothing reads. Files go to the shared folder through Arrow's file systems (local, HDFS, object stores).

Equal payloads: all of a digest group but the record with the largest id become ``revisit`` records
without a payload. The group's target is found by a partial aggregate (digest -> largest id) over digests alone;
its table is written, and the join back is a broadcast only if the file is under Spark's threshold,
else an equi-join whose hot digests adaptive execution splits.

Defined results: a null payload is the empty payload; rows with one id repeated are all targets if
it is the largest; a null id takes part as the smallest; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.shared import materialise, scratch

ROLL_BYTES = 64 << 20
MAX_TASKS = 20_000
_CHUNK = 1 << 20
_CRLF = b"\r\n"
_DATE = "2024-01-01T00:00:00Z"


def _at(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def _attempt() -> int:
    ctx = TaskContext.get()
    return ctx.taskAttemptId() if ctx else os.getpid()


class _Sink:
    """A file that appears whole, under its final name, or not at all."""

    def __init__(self, folder: str, name: str):
        self.fs, root = _at(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.temp = f"{root}/{name}", f"{root}/_{name}"
        self.out = self.fs.open_output_stream(self.temp, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temp, self.final)


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(rid: str, url: str | None, payload: bytes, refers: str | None) -> bytes:
    """A response record, or with ``refers`` a revisit record: headers only, digest and length of the payload kept."""
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if refers is not None else b"response"), f"WARC-Record-ID: <urn:record:{rid}>".encode(), b"WARC-Date: " + _DATE.encode(),
        b"WARC-Target-URI: " + " ".join((url or "").split()).encode(), f"WARC-Payload-Digest: sha1:{_digest(payload)}".encode(), f"WARC-Payload-Length: {len(payload)}".encode(),
    ]
    if refers is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:record:{refers}>".encode()]
        payload = b""
    head.append(f"Content-Length: {len(payload)}".encode())
    return _CRLF.join(head) + _CRLF * 2 + payload + _CRLF * 2


_MANIFEST = "archive string, records long, bytes long"


def write_archives(records: DataFrame, folder: str, *, roll_bytes: int = ROLL_BYTES, level: int = 1) -> DataFrame:
    """``records``: rid, url, payload (binary), refers (null: response). Returns archive, records, bytes."""
    src = records.select(F.col("rid").cast("string"), F.col("url").cast("string"), F.col("payload").cast("binary"), F.col("refers").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rolled, sink, count, done = TaskContext.get().partitionId(), 0, None, 0, []

        def finish() -> None:
            sink.write(packer.flush())
            sink.close()
            done.append((f"{folder}/{name}", count, sink.size))

        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                for rid, url, payload, refers in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)):
                    if sink is None:
                        name = f"part-{part:06d}-{_attempt()}-{rolled:04d}.warc.gz"
                        sink, packer, count = _Sink(folder, name), zlib.compressobj(level, zlib.DEFLATED, 31), 0
                    if data := packer.compress(_record("" if rid is None else rid, url, payload or b"", refers)):
                        sink.write(data)
                    count += 1
                    if sink.size >= roll_bytes:
                        finish()
                        sink, rolled = None, rolled + 1
        if sink is not None:
            finish()
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "records", "bytes"])

    return src.mapInArrow(run, _MANIFEST)


def _inflate(stream, *, chunk: int = _CHUNK) -> Iterator[bytes]:
    """The plain bytes of a gzip stream of one or more members; no more than a chunk at a time, however far the data expands."""
    unpack = zlib.decompressobj(31)
    while data := stream.read(chunk):
        while data:
            if plain := unpack.decompress(data, chunk):
                yield plain
            if unpack.eof:
                data, unpack = unpack.unused_data, zlib.decompressobj(31)
            else:
                data = unpack.unconsumed_tail
                if not data and plain and len(plain) == chunk:
                    while plain := unpack.decompress(b"", chunk):  # what the decoder still holds
                        yield plain


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record here: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def split_records(plain: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, whole record) for each record of a plain WARC stream; holds one record at a time."""
    held, at = bytearray(), 0

    def fill(upto: int) -> bool:
        while len(held) - at < upto:
            more = next(plain, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", at + max(0, looked - 3))) < 0:
            looked = len(held) - at
            if not fill(looked + 1):
                raise ValueError("a record's headers break off")
        head = parse_head(bytes(held[at:end]))
        size = end + 4 - at + int(head["content-length"]) + 4
        if not fill(size):
            raise ValueError("a record breaks off")
        yield head, bytes(held[at : at + size])
        at += size
        if at > 4 * _CHUNK:
            del held[:at]
            at = 0


def _gzip(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def normalise(archives: DataFrame, folder: str, *, level: int = 6) -> DataFrame:
    """Each ``archive`` rewritten into ``folder``, one gzip member a record, with ``<name>.idx.jsonl`` beside it.

    Returns archive, records, bytes of the new files, and the sidecar's path as ``index``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = _at(uri)
                name = path.rpartition("/")[2].replace(".warc.gz", f"-{_attempt()}.warc.gz")
                out, side, count = _Sink(folder, name), _Sink(folder, f"{name}.idx.jsonl"), 0
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, record in split_records(_inflate(stream)):
                        member = _gzip(record, level)
                        side.write((json.dumps({"offset": out.size, "length": len(member), "type": head.get("warc-type"), "id": head.get("warc-record-id"), "digest": head.get("warc-payload-digest")}) + "\n").encode())
                        out.write(member)
                        count += 1
                side.close()
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([count], pa.int64()), pa.array([out.size], pa.int64()), pa.array([f"{folder}/{name}.idx.jsonl"])], names=["archive", "records", "bytes", "index"])

    return archives.select("archive").mapInArrow(run, _MANIFEST + ", index string")


def read_member(stream, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """Headers and payload of the record in the member at ``offset``."""
    stream.seek(offset)
    record = zlib.decompress(stream.read(length), 31)
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = parse_head(head)
    return fields, rest[: int(fields["content-length"])]


_READ = T.StructType([
    T.StructField("rid", T.StringType()), T.StructField("url", T.StringType()), T.StructField("record_type", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()), T.StructField("refers", T.StringType()), T.StructField("payload", T.BinaryType()),
])


def _urn(value: str | None) -> str | None:
    return None if value is None else value.removeprefix("<urn:record:").removesuffix(">")


def read_archives(archives: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Every record of normalised archives, read at the offsets of the sidecar index.

    The digest of a response is computed from the payload read; one that differs from the record's
    header raises, as a damaged archive must not pass.
    """

    def rows(uri: str, index: str) -> Iterator[tuple]:
        fs, path = _at(uri)
        ifs, ipath = _at(index)
        with fs.open_input_file(path) as stream, ifs.open_input_stream(ipath, compression=None) as side:
            rest = b""
            while (data := side.read(_CHUNK)) or rest:
                *lines, rest = (rest + data).split(b"\n") if data else (rest, b"")
                for line in lines:
                    entry = json.loads(line)
                    head, payload = read_member(stream, entry["offset"], entry["length"])
                    digest, revisit = head["warc-payload-digest"].removeprefix("sha1:"), head["warc-type"] == "revisit"
                    if not revisit and _digest(payload) != digest:
                        raise ValueError(f"{uri}: the payload at {entry['offset']} differs from its digest")
                    yield _urn(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], int(head["warc-payload-length"]) if revisit else len(payload), digest, _urn(head.get("warc-refers-to")), payload if payloads and not revisit else None

    types = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[tuple] = []
                for row in rows(uri, index):
                    held.append(row)
                    if len(held) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate(types)], names=_READ.names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([h[k] for h in held], t) for k, t in enumerate(types)], names=_READ.names)

    return archives.select("archive", "index").mapInArrow(run, _READ)


def with_targets(pages: DataFrame, id_col: str, payload_col: str, *, min_bytes: int = 0) -> DataFrame:
    """(rid, url, payload, refers): refers is the largest id of the rows with an equal payload, null in that row."""
    src = pages.select(F.col(id_col).alias("rid"), F.col("url") if "url" in pages.columns else F.lit(None).cast("string").alias("url"), F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    keyed = src.withColumn("digest", F.sha1("payload"))
    copied = (
        src.select("rid", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n"))
        .where(F.col("n") >= min_bytes).groupBy("digest").agg(F.max("rid").alias("target"), F.count("*").alias("copies"))
        .where("copies > 1").select("digest", "target")
    )
    # Written first, so that its true size decides whether the payloads have to be shuffled to meet it.
    copied = materialise(copied, "copied")
    return keyed.join(copied, "digest", "left").select("rid", "url", "payload", F.when(F.col("target").isNotNull() & ~F.col("rid").eqNullSafe(F.col("target")), F.col("target")).alias("refers"))


def archive_roundtrip(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", min_bytes: int = 0, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write monolithic archives, normalise them, read them back; the records as ``read_archives`` returns them."""
    spark = pages.sparkSession
    home = scratch(spark, "warc")
    plain = materialise(write_archives(with_targets(pages, id_col, payload_col, min_bytes=min_bytes), f"{home}/plain", roll_bytes=roll_bytes), "plain-manifest")
    # Archives are of one size, so they are dealt out one by one, a task each up to a limit.
    tasks = min(max(1, plain.count()), MAX_TASKS)
    made = materialise(normalise(plain.repartition(tasks), f"{home}/records"), "manifest")
    return read_archives(made.repartition(tasks), payloads=False)


def resolve_revisits(records: DataFrame) -> DataFrame:
    """``records`` of read archives, length and digest of a revisit taken from the response it refers to; one that is not there, or differs, raises."""
    rows = materialise(records, "records")
    own = rows.where("record_type = 'response'").select(F.col("rid").alias("t__"), F.col("payload_digest").alias("d__"), F.col("payload_bytes").alias("b__")).distinct()
    met = rows.join(own, (F.col("refers") == F.col("t__")) & (F.col("payload_digest") == F.col("d__")), "left")
    lost = F.raise_error(F.concat(F.lit("no response for the revisit "), F.col("rid"))).cast("long")
    return met.withColumn("payload_bytes", F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(F.coalesce("b__", lost))).drop("t__", "d__", "b__")


def page_records(pages: DataFrame) -> DataFrame:
    """The digest columns of every page."""
    kind = pages.schema["page_id"].dataType
    blank = lambda c: F.when(F.col(c) == "", None).otherwise(F.col(c)).cast(kind)
    return resolve_revisits(archive_roundtrip(pages)).select(blank("rid").alias("page_id"), "payload_bytes", "payload_digest", "record_type", blank("refers").alias("refers_to"))


def oracle_sql() -> str:
    """DuckDB SQL for ``page_records``: base32 is 5 bits of the digest a letter."""
    bit = lambda j: f"(CASE WHEN substr(bits, 5 * i + {j}, 1) = '1' THEN {1 << (5 - j)} ELSE 0 END)"
    letter = f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + {' + '.join(map(bit, range(1, 6)))}, 1)"
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS target FROM pages),
d AS (SELECT page_id, target, strlen(h)::BIGINT AS payload_bytes, unhex(sha1(h))::BIT::VARCHAR AS bits FROM p)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i: {letter}), '') AS payload_digest,
       CASE WHEN page_id = target THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> target THEN target END AS refers_to
FROM d"""
