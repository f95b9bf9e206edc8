"""Alignment against a plain walk over both tokenizers' tokens, with document counts by brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusloom.llm import align
from corpusloom.llm.bpe import byte_characters
from corpusloom.llm.queries import BYTE_LEVEL, PIECES


@pytest.fixture(scope="module")
def plain():
    a, b = Tokenizer.from_file(BYTE_LEVEL), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    octet = {c: k for k, c in enumerate(byte_characters())}

    def groups(text):
        if not text:
            return None
        data = (" " + text).encode()
        left = [(i, bytes(octet[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        right = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        if b"".join(t for _, t in left) != data or b"".join(t for _, t in right) != data:
            return None
        ends = []
        for side in (left, right):
            at, out = 0, {}
            for k, (_, t) in enumerate(side):
                at += len(t)
                out[at] = k + 1
            ends.append(out)
        found, i, j = [], 0, 0
        for at in sorted(set(ends[0]) & set(ends[1])):
            found.append(([x for x, _ in left[i : ends[0][at]]], [x for x, _ in right[j : ends[1][at]]]))
            i, j = ends[0][at], ends[1][at]
        return found

    return groups


def _brute(plain, rows):
    held = [(i, plain(t)) for i, t in rows]
    links = [[(a, b) for x, y in g or [] for a in x for b in y] for _, g in held]
    count = Counter(p for each in links for p in set(each))
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    out = []
    for (i, g), each in zip(held, links):
        digest = hashlib.sha256(";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g).encode()).hexdigest() if g else ""
        out.append((i, sum(len(x) for x, _ in g or []), sum(len(y) for _, y in g or []), len(g or []), len(each), sum(count[p] == most[p[0]] for p in each), sum(count[p] for p in each), digest))
    return sorted(out, key=str)


def _got(df):
    return sorted((tuple(r) for r in align.align(df, a_path=BYTE_LEVEL, b_path=PIECES).collect()), key=str)


def test_table_and_odd_rows(plain, docs, odd, empty):
    for df in (docs, odd):
        assert _got(df) == _brute(plain, [tuple(r) for r in df.select("doc_id", "text").collect()])
    assert _got(empty) == []


def test_segments_encode_as_the_whole_text(plain):
    pair, r = align.Pair(BYTE_LEVEL, PIECES), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "\t", ".", "é", "日", "🙂", "<|endoftext|>", "<s>", "'s", "'", "12", "▁", "\x1c", "\xa0", " ", "x", "\x00", "tion", "　"]
    for _ in range(4000):
        text = "".join(r.choice(parts) for _ in range(r.randrange(1, 14)))
        cut = align.segments(text)
        assert "".join(cut) == " " + text
        pair.learn([cut])
        at = [pair.segment[s] for s in cut]
        got = None if any(pair.bad.data[k] for k in at) else ";".join(pair.line[k] for k in at)
        want = plain(text)
        assert got == (want and ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in want))


def test_small_blocks_caches_and_large_groups(spark, plain, monkeypatch):
    for name, value in (("BLOCK_DOCS", 2), ("CACHE", 3), ("GROUPS", 4)):
        monkeypatch.setattr(align, name, value)
    r = random.Random(4)
    words = ["antidisestablishment", "zzzzqqqqxxxx", "ﷺ", "naïve", "<0x0A>", "aaaaaaaaaaaaaaaaaaaaa", "🙂🙃", "the", "of", "▁"]
    rows = [(k % 150, " ".join(r.choice(words) for _ in range(r.randrange(0, 9)))) for k in range(200)] + [(None, "the of the"), (3, None), (4, "x " * 3000), (5, "q" * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert _got(df) == _brute(plain, rows)
