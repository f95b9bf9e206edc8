"""TIFF media columns: write byte payloads as 8-bit images, walk directories, one row per page.

Reader: II and MM files, all image directories of the chain, strips and tiles, no compression,
PackBits (32773), LZW (5) and deflate (8, 32946), predictor 2 (horizontal differencing) undone,
8-bit chunky samples. Writer: the same formats, payload rows of ``WIDTH`` samples, a new page
every ``page_rows`` rows, so that no page exceeds a fixed size however long the payload is.

Defined results: a null, empty or damaged file gives one row with ``page_index`` null and
``error`` set, and no page (strips or tiles that do not cover the image, that are too short, or an image larger than
the file can stand for are damage; samples are never filled up); repeated rows give repeated pages; an empty table gives an empty table; columns of
the input other than those named are not carried along, so their names cannot clash.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 64
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
# Fixed values of the format: field types and their sizes in bytes.
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
_CODES = {1: "B", 3: "H", 4: "I"}
_LZW_CLEAR, _LZW_END = 256, 257
#: Bytes that a byte can stand for at most: the longest match in two bits; a run; the longest string of a table in nine bits.
_MOST = {NONE: 1, DEFLATE: 1032, OLD_DEFLATE: 1032, PACKBITS: 64, LZW: 4096}


# ---------------------------------------------------------------- compression
def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        i += 1
        if head < 128:
            out += data[i : i + head + 1]
            i += head + 1
        elif head > 128:
            out += data[i : i + 1] * (257 - head)
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    out, acc, bits = bytearray(), 0, 0
    table: dict[bytes, int] = {}
    width, fresh = 9, 258

    def put(code: int) -> None:
        nonlocal acc, bits
        acc, bits = (acc << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((acc >> bits) & 255)
        acc &= (1 << bits) - 1

    put(_LZW_CLEAR)
    seen = b""
    for k in range(len(data)):
        longer = seen + data[k : k + 1]
        if len(longer) == 1 or longer in table:
            seen = longer
            continue
        put(table[seen] if len(seen) > 1 else seen[0])
        table[longer] = fresh
        fresh += 1
        if fresh == 4094:
            put(_LZW_CLEAR)
            table, width, fresh = {}, 9, 258
        elif fresh == 1 << width:
            width += 1
        seen = longer[-1:]
    if seen:
        put(table[seen] if len(seen) > 1 else seen[0])
        fresh += 1
        if fresh == 1 << width and width < 12:
            width += 1
    put(_LZW_END)
    if bits:
        out.append((acc << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int | None = None) -> bytes:
    """The decoded bytes; with ``size`` no more codes are read once so many are there."""
    out, acc, bits, width = bytearray(), 0, 0, 9
    table: list[bytes] = []
    start = [bytes((k,)) for k in range(256)] + [b"", b""]
    previous = b""
    for byte in data:
        acc, bits = (acc << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == _LZW_END:
            break
        if code == _LZW_CLEAR:
            table, previous, width = list(start), b"", 9
            continue
        if not table:
            table = list(start)
        if not previous:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            entry = table[code] if code < len(table) else previous + previous[:1]
            table.append(previous + entry[:1])
        out += entry
        if size is not None and len(out) >= size:
            break
        previous = entry
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return bytes(out)


def _pack(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 6)
    if compression == LZW:
        return lzw_encode(data)
    if compression == PACKBITS:
        return packbits_encode(data)
    return data


def _unpack(data: bytes, compression: int, size: int) -> bytes:
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return packbits_decode(data)
    if compression == NONE:
        return data
    raise ValueError(f"compression {compression} is not supported")


# ---------------------------------------------------------------- writer
def write_tiff(payload: bytes, *, compression: int = DEFLATE, predictor: int = 1, tile: tuple[int, int] | None = None, page_rows: int = 4096, strip_rows: int = 1024) -> bytes:
    """``payload`` (a positive multiple of 64 bytes) as a little-endian multi-page file."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("the payload must be a positive multiple of 64 bytes")
    parts, size, links = [b"II*\0\0\0\0\0"], 8, [4]
    for top in range(0, len(payload), page_rows * WIDTH):
        page = payload[top : top + page_rows * WIDTH]
        rows = len(page) // WIDTH
        grid = np.frombuffer(page, np.uint8).reshape(rows, WIDTH)
        if tile:
            tw, th = tile
            padded = np.zeros((-(-rows // th) * th, -(-WIDTH // tw) * tw), np.uint8)
            padded[:rows, :WIDTH] = grid
            cells = [padded[r : r + th, c : c + tw] for r in range(0, padded.shape[0], th) for c in range(0, padded.shape[1], tw)]
        else:
            cells = [grid[r : r + strip_rows] for r in range(0, rows, strip_rows)]
        blobs = []
        for cell in cells:
            if predictor == 2:
                cell = np.concatenate([cell[:, :1], np.diff(cell, axis=1)], axis=1)
            blobs.append(_pack(np.ascontiguousarray(cell).tobytes(), compression))
        offsets = []
        for blob in blobs:
            offsets.append(size)
            parts.append(blob + b"\0" * (len(blob) % 2))
            size += len(parts[-1])
        places = [(322, 3, [tile[0]]), (323, 3, [tile[1]]), (324, 4, offsets), (325, 4, [len(b) for b in blobs])] if tile else [(273, 4, offsets), (278, 4, [strip_rows]), (279, 4, [len(b) for b in blobs])]
        fields = sorted([(256, 4, [WIDTH]), (257, 4, [rows]), (258, 3, [8]), (259, 3, [compression]), (262, 3, [1]), (277, 3, [1]), (317, 3, [predictor]), *places])
        entries, extra = [], b""
        base = size + 2 + 12 * len(fields) + 4
        for tag, kind, values in fields:
            raw = struct.pack(f"<{len(values)}{_CODES[kind]}", *values)
            if len(raw) > 4:
                entries.append(struct.pack("<HHII", tag, kind, len(values), base + len(extra)))
                extra += raw + b"\0" * (len(raw) % 2)
            else:
                entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        links.append(size)
        parts.append(struct.pack("<H", len(fields)) + b"".join(entries))
        links.append(size + len(parts[-1]))
        parts.append(b"\0\0\0\0" + extra)
        size += len(parts[-2]) + len(parts[-1])
    out = bytearray(b"".join(parts))
    for at, to in zip(links[0::2], links[1::2]):
        struct.pack_into("<I", out, at, to)
    return bytes(out)


# ---------------------------------------------------------------- reader
def directories(data: bytes) -> list[dict[int, tuple]]:
    """The image directories of the chain, each as tag -> values."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    if order is None or len(data) < 8 or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    found, seen = [], set()
    at = struct.unpack_from(order + "I", data, 4)[0]
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        count = struct.unpack_from(order + "H", data, at)[0]
        fields = {}
        for k in range(count):
            tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in _CODES:
                continue
            where = at + 10 + 12 * k
            if n * _SIZES[kind] > 4:
                where = struct.unpack_from(order + "I", data, where)[0]
            fields[tag] = struct.unpack_from(f"{order}{n}{_CODES[kind]}", data, where)
        found.append(fields)
        at = struct.unpack_from(order + "I", data, at + 2 + 12 * count)[0]
    if not found:
        raise ValueError("no image directory")
    return found


def read_page(data: bytes, fields: dict[int, tuple]) -> tuple[np.ndarray, dict]:
    """Samples of one directory (rows x width*samples) and its layout."""
    one = lambda tag, default: fields.get(tag, (default,))[0]
    width, height, spp = one(256, 0), one(257, 0), one(277, 1)
    compression, predictor = one(259, 1), one(317, 1)
    if any(b != 8 for b in fields.get(258, (8,) * spp)) or one(284, 1) != 1 and spp > 1 or predictor not in (1, 2):
        raise ValueError("only chunky 8-bit samples with predictor 1 or 2 are supported")
    tiled = 322 in fields
    cw, ch = (one(322, 0), one(323, 0)) if tiled else (width, min(one(278, height), height))
    across, down = -(-width // cw), -(-height // ch)
    offsets, counts = fields[324 if tiled else 273], fields[325 if tiled else 279]
    if not len(offsets) == len(counts) == across * down:
        raise ValueError("the strips or tiles do not cover the image")
    if (down * ch if tiled else height) * across * cw * spp > len(data) * _MOST.get(compression, 0):
        raise ValueError("the image is larger than the file can hold")
    cells = []
    for k, (offset, count) in enumerate(zip(offsets, counts)):
        rows = ch if tiled else min(ch, height - k * ch)
        cells.append(_unpack(data[offset : offset + count], compression, rows * cw * spp)[: rows * cw * spp])
        if len(cells[-1]) < rows * cw * spp:
            raise ValueError("a strip or tile is too short")
    grid = np.empty((down * ch, across * cw * spp), np.uint8)
    for k, cell in enumerate(cells):
        r, c = (k // across) * ch, (k % across) * cw * spp
        cell = np.frombuffer(cell, np.uint8).reshape(-1, cw, spp)
        rows = len(cell)
        if predictor == 2:
            cell = np.cumsum(cell, axis=1, dtype=np.uint8)
        grid[r : r + rows, c : c + cw * spp] = cell.reshape(rows, cw * spp)
    return grid[:height, : width * spp], {"width": width, "height": height, "compression": compression, "predictor": predictor, "tiled": tiled}


# ---------------------------------------------------------------- operators
def layout_of(payload: bytes) -> dict:
    """The form a payload is stored in if none is asked for: by its own CRC, so that equal payloads give equal files and a corpus has all forms."""
    crc = zlib.crc32(payload)
    compression = {0: LZW, 1: PACKBITS, 2: PACKBITS, 3: NONE, 4: NONE}.get(crc & 15, DEFLATE)
    return {"compression": compression, "predictor": 1 + (crc >> 4 & 1), "tile": (32, 64) if crc >> 5 & 1 else None}


def encode_payloads(df: DataFrame, id_col: str, text: Column, *, compression: int | None = None, predictor: int = 1, tile: tuple[int, int] | None = None, page_rows: int = 4096) -> DataFrame:
    """(id, n_bytes, media): each text's UTF-8 bytes, zero-padded to a positive multiple of 64, as a TIFF; without ``compression`` in the form of ``layout_of``."""
    kind = df.schema[id_col].dataType
    src = df.select(F.col(id_col), F.coalesce(text, F.lit("")).alias("text"))
    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                sizes, media = [], []
                for value in part.column(1).cast(pa.large_binary()).to_pylist():
                    sizes.append(len(value))
                    padded = value + b"\0" * ((-len(value)) % WIDTH or (0 if value else WIDTH))
                    form = layout_of(padded) if compression is None else {"compression": compression, "predictor": predictor, "tile": tile}
                    media.append(write_tiff(padded, page_rows=page_rows, **form))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"])

    return src.mapInArrow(run, schema)


_PAGE = T.StructType([
    T.StructField("page_index", T.IntegerType()), T.StructField("n_pages", T.IntegerType()),
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()),
    T.StructField("compression", T.IntegerType()), T.StructField("predictor", T.IntegerType()),
    T.StructField("tiled", T.BooleanType()), T.StructField("samples", T.BinaryType()),
    T.StructField("bytes_so_far", T.LongType()), T.StructField("sha256_so_far", T.StringType()),
    T.StructField("tail_crc32", T.LongType()), T.StructField("feature_so_far", T.StringType()),
    T.StructField("error", T.StringType()),
])


def _feature(hist: np.ndarray) -> str:
    n = hist.sum()
    p = hist[hist > 0] / n
    levels = np.arange(256)
    mean = float((hist * levels).sum() / n)
    std = float(np.sqrt(max(0.0, (hist * levels**2).sum() / n - mean**2)))
    return f"mean={mean:.4f};std={std:.4f};entropy={float(-(p * np.log2(p)).sum()):.4f};levels={len(p)};zeros={int(hist[0])}"


def _pages(media: bytes | None, samples: bool) -> Iterator[dict]:
    try:
        dirs = directories(media or b"")
        digest, hist, total = hashlib.sha256(), np.zeros(256, np.int64), 0
        rows = []
        for k, fields in enumerate(dirs):
            grid, layout = read_page(media, fields)
            raw = grid.tobytes()
            digest.update(raw)
            hist += np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
            total += len(raw)
            rows.append(layout | {"page_index": k, "n_pages": len(dirs), "samples": raw if samples else None, "bytes_so_far": total, "sha256_so_far": digest.copy().hexdigest(), "tail_crc32": zlib.crc32(raw[-WIDTH:]), "feature_so_far": _feature(hist)})
        yield from rows
    except (ValueError, struct.error, zlib.error, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError) as e:
        yield {"error": f"{type(e).__name__}: {e}"}


def tiff_pages(df: DataFrame, media_col: str, keep: list[str], *, samples: bool = True) -> DataFrame:
    """One row per image directory of ``media_col``, with the columns ``keep`` beside it.

    ``bytes_so_far``, ``sha256_so_far`` and ``feature_so_far`` run over the file's pages in order,
    so the last page (``page_index = n_pages - 1``) has them for the whole file without a shuffle.
    ``samples=False`` leaves the samples out of the rows.
    """
    own = {f.name for f in _PAGE.fields}
    if own & set(keep):
        raise ValueError(f"rename these columns first: {sorted(own & set(keep))}")
    src = df.select(*keep, F.col(media_col).alias("media__"))
    schema = T.StructType([*[df.schema[k] for k in keep], *_PAGE.fields])
    arrow = {"page_index": pa.int32(), "n_pages": pa.int32(), "width": pa.int32(), "height": pa.int32(), "compression": pa.int32(), "predictor": pa.int32(), "tiled": pa.bool_(), "samples": pa.binary(), "bytes_so_far": pa.int64(), "sha256_so_far": pa.string(), "tail_crc32": pa.int64(), "feature_so_far": pa.string(), "error": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                rows, at = [], []
                for k, media in enumerate(part.column(len(keep)).to_pylist()):
                    for row in _pages(media, samples):
                        rows.append(row)
                        at.append(k)
                left = [part.column(k).take(pa.array(at, pa.int32())) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays(left + [pa.array([r.get(n) for r in rows], t) for n, t in arrow.items()], names=[*keep, *arrow])

    return src.mapInArrow(run, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    """The digest columns of every document: encoded as a TIFF, read back, last page kept; a file that cannot be read keeps its row, with its ``error``."""
    stored = encode_payloads(docs, "doc_id", F.col("text")).select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    pages = tiff_pages(stored, "media", ["doc_id", "n_bytes", "media_bytes", "media_sha256"], samples=False)
    return pages.where("error is not null or page_index = n_pages - 1").select(
        "doc_id", "n_bytes", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha256_so_far").alias("payload_sha256"), "tail_crc32",
        "media_bytes", "media_sha256", F.col("feature_so_far").alias("feature"), "n_pages", "compression", "predictor", "tiled", "error",
    )
