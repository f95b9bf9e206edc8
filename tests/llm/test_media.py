import hashlib
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import tiff


def _payload(n, seed=1):
    r = random.Random(seed)
    return bytes(r.choice(b"aaaabcde \n") if r.random() < 0.9 else r.randrange(256) for _ in range(n))


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 16), (32, 64)])
@pytest.mark.parametrize("size", [64, 640, 64 * 5000])
def test_round_trip(compression, predictor, tile, size):
    data = _payload(size)
    blob = tiff.write_tiff(data, compression=compression, predictor=predictor, tile=tile)
    dirs = tiff.directories(blob)
    assert b"".join(tiff.read_page(blob, d)[0].tobytes() for d in dirs) == data
    assert len(dirs) == -(-size // (4096 * 64))


def test_known_streams():
    # The example streams of the format's public specification.
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA")) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    codes, pixels = [256, 7, 258, 8, 8, 258, 6, 6, 257], bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    packed = int("".join(f"{c:09b}" for c in codes).ljust(88, "0"), 2).to_bytes(11, "big")
    assert tiff.lzw_decode(packed) == pixels and tiff.lzw_encode(pixels) == packed
    for n in (1, 300, 5000, 70000):
        assert tiff.lzw_decode(tiff.lzw_encode(_payload(n, n))) == _payload(n, n)


def test_big_endian_and_multi_sample():
    pixels = bytes(range(24))  # 2 rows of 4 pixels of 3 samples
    fields = [(256, 3, 4), (257, 3, 2), (258, 3, 8), (259, 3, 1), (262, 3, 2), (273, 4, 8), (277, 3, 3), (278, 3, 2), (279, 4, 24)]
    ifd = struct.pack(">H", len(fields)) + b"".join(struct.pack(">HHI", t, k, 1) + (struct.pack(">HH", v, 0) if k == 3 else struct.pack(">I", v)) for t, k, v in fields) + b"\0" * 4
    blob = b"MM" + struct.pack(">HI", 42, 32) + pixels + ifd
    grid, layout = tiff.read_page(blob, tiff.directories(blob)[0])
    assert grid.tobytes() == pixels and (layout["width"], layout["height"]) == (4, 2)


def test_damaged_files(spark):
    loop = bytearray(tiff.write_tiff(_payload(64)))
    at = struct.unpack_from("<I", loop, 4)[0]
    n = struct.unpack_from("<H", loop, at)[0]
    struct.pack_into("<I", loop, at + 2 + 12 * n, at)
    bad = [None, b"", b"hello", b"II*\0\xff\xff\xff\x7f", bytes(loop), tiff.write_tiff(_payload(640))[:300]]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bad)], "k int, media binary")
    got = tiff.tiff_pages(df, "media", ["k"]).collect()
    assert len(got) == len(bad) and all(r["error"] and r["page_index"] is None for r in got)


def test_one_row_a_page(spark):
    data = _payload(64 * 100)
    df = spark.createDataFrame([(1, tiff.write_tiff(data, page_rows=30))], "k int, media binary")
    got = sorted(tiff.tiff_pages(df, "media", ["k"]).collect(), key=lambda r: r["page_index"])
    assert [r["height"] for r in got] == [30, 30, 30, 10] and b"".join(bytes(r["samples"]) for r in got) == data
    assert got[-1]["sha256_so_far"] == hashlib.sha256(data).hexdigest() and got[-1]["bytes_so_far"] == len(data)


def _want(text):
    raw = (text or "").encode()
    padded = raw + b"\0" * ((-len(raw)) % 64 or (0 if raw else 64))
    return len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])


def test_digest_equals_brute_force(odd, docs, empty):
    for df in (odd, docs):
        texts = {(r["doi"] if "doi" in r else r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()}
        got = tiff.media_digest(df).collect()
        assert len(got) == df.count()
        want = sorted((str(i), *_want(t)) for i, t in texts)
        assert sorted({(str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got}) == want
        assert all(r["feature"] and r["media_bytes"] > 0 for r in got)
    assert tiff.media_digest(empty).count() == 0


def test_all_forms_are_used(docs):
    forms = {(r["compression"], r["predictor"], r["tiled"]) for r in tiff.media_digest(docs.select(F.explode(F.split("text", " ")).alias("text")).distinct().withColumn("doc_id", F.monotonically_increasing_id())).collect()}
    assert forms == {(c, p, t) for c in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS) for p in (1, 2) for t in (False, True)}


def test_stored_form_is_hashed(docs):
    stored = tiff.encode_payloads(docs.limit(5), "doc_id", F.col("text")).collect()
    got = {r["doc_id"]: r["media_sha256"] for r in tiff.media_digest(docs).collect()}
    assert all(got[r["doc_id"]] == hashlib.sha256(r["media"]).hexdigest() for r in stored)


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("tile", [None, (32, 64)])
def test_damaged_files_are_errors_and_never_filled_up(compression, tile):
    r = random.Random(compression)
    payload = bytes(r.choice(b"abcdefgh" * 30 + bytes(range(1, 256))) for _ in range(64 * 40))
    good = tiff.write_tiff(payload, compression=compression, tile=tile, page_rows=32, strip_rows=8)
    assert b"".join(p["samples"] for p in tiff._pages(good, True)) == payload
    zeros = 0
    for _ in range(1500):
        bad = bytearray(good)
        for _ in range(r.choice([1, 1, 2, 8])):
            at = r.randrange(len(bad))
            bad[at] ^= 1 << r.randrange(8)
        if r.random() < 0.1:
            del bad[r.randrange(len(bad)) :]
        rows = list(tiff._pages(bytes(bad), True))
        assert rows and all(("error" in x) != ("samples" in x) for x in rows)
        zeros += sum(x["samples"].count(0) > 64 for x in rows if "samples" in x and compression == tiff.NONE)
    assert zeros < 30


def test_missing_strips_and_absurd_sizes():
    good = tiff.write_tiff(b"x" * 64 * 32, compression=tiff.LZW, page_rows=32, strip_rows=8)
    fields = tiff.directories(good)[0]
    for tag in (273, 279):
        with pytest.raises(ValueError, match="do not cover"):
            tiff.read_page(good, fields | {tag: fields[tag][:2]})
    with pytest.raises(ValueError, match="larger than the file"):
        tiff.read_page(good, fields | {257: (1 << 30,), 278: (1 << 30,), 273: fields[273][:1], 279: fields[279][:1]})
