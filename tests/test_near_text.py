"""Texts alike by alignment, and terms resolved against a vocabulary: against difflib over all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusloom.functions import parse as P
from corpusloom.operators.near_text import alike

WORDS = ["daylight", "level", "air", "quality", "noise", "exposure", "light", "mood", "stress", "sleep", "work", "task", "co2", "pm", "a", "of"]


def _texts(seed, n):
    draw = random.Random(seed)
    made = []
    for _ in range(n):
        t = list(" ".join(draw.choice(WORDS) for _ in range(draw.randint(1, 3))))
        for _ in range(draw.randint(0, 3)):  # typos, the first letter as well
            i = draw.randrange(len(t))
            t[i : i + draw.randint(0, 1)] = draw.choice(["", "x", "é", t[i] * 2])
            t = t or ["q"]
        made.append("".join(t))
    return [*made, "", "a", "ab", "axb", "aaaaaaaa", "aaaaaaaaaa", "ab" * 150, "ab" * 150 + "c", None]


@pytest.mark.parametrize("least", [0.5, 0.8, 0.85, 0.93, 1.0])
def test_alike_equals_difflib_over_all_pairs(spark, least):
    left, right = _texts(1, 90), _texts(2, 90)
    frame = lambda ts: spark.createDataFrame([(t,) for t in ts], "t string")
    got = {(r["a"], r["b"]): r["ratio"] for r in alike(frame(left + left[:5]), frame(right), least=least).collect()}
    ratio = {(a, b): SequenceMatcher(None, a, b).ratio() for a in set(left) for b in set(right) if a and b}
    assert got == {k: v for k, v in ratio.items() if v >= least} and len(got) > 3


@given(st.text("abcx", min_size=1, max_size=12), st.text("abcx", min_size=1, max_size=12))
def test_pairs_of_characters_that_an_alignment_keeps(a, b):
    m, total = SequenceMatcher(None, a, b), len(a) + len(b)
    if m.ratio() >= 0.85:
        kept = sum(max(0, k.size - 1) for k in m.get_matching_blocks())
        assert kept >= 0.275 * total - 1 - 1e-9 and (kept >= 1 or total < 4) and total >= 2 * max(len(a), len(b)) / (2 - 0.85) - 1e-9


def test_terms_equal_a_plain_search(spark):
    names, terms = [*enumerate(_texts(3, 80)), (500, "daylight")], _texts(4, 80) + ["  DAYLIGHT ", "xaylight", "of"]
    got = {r["term"]: (r["term_id"], r["score"]) for r in P.resolve_terms(spark.createDataFrame([(t,) for t in terms], "term string"), spark.createDataFrame(names, "term_id int, name string")).collect()}
    for t in set(terms) - {None}:
        low = t.lower().strip()
        same = [i for i, n in names if n is not None and n.lower().strip() == low]
        found = [(-SequenceMatcher(None, low, n.lower().strip()).ratio(), i) for i, n in names if n and low]
        best = min((f for f in found if -f[0] >= 0.85), default=None)
        assert got[t] == ((min(same), 1.0) if same else (best[1], -best[0]) if best else (None, None)), t
    assert got[None] == (None, None) and got["xaylight"][0] is not None
    assert P.resolve_terms(spark.createDataFrame([], "term string"), spark.createDataFrame(names, "term_id int, name string")).count() == 0
