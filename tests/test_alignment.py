"""Alignment in parts against the whole alignment of difflib; cuts from a reference joined by places against a walk over the whole text."""

import random
from difflib import SequenceMatcher

import pytest

from tempotext.functions.blocks import matching
from tempotext.operators import alignment as A, engines as E
from tempotext.operators.engines import boundaries_by_reference


def _dealt(rng, text):
    """A text in pieces of random lengths, empty ones among them."""
    out, at = [], 0
    while at < len(text):
        size = rng.choice([0, 1, 3, 10, 40])
        out.append(text[at : at + size])
        at += size
    return out


def _edited(rng, text, rate, letters):
    out = []
    for x in text:
        k = rng.random()
        out.append(x if k > rate else "" if k < rate / 3 else rng.choice(letters) if k < rate * 2 / 3 else x + rng.choice(letters))
    return "".join(out)


def _pairs(rng, count):
    for t in range(count):
        letters = "abcdefghijklmnopqrstuvwxyz"[: rng.choice([2, 4, 26])]
        a = "".join(rng.choice(letters) for _ in range(rng.randint(0, 400)))
        if t % 4 == 1:  # a refrain
            a = (a[:30] + a[40:70] + a[:30]) * 3
        b = _edited(rng, a, rng.choice([0, 0.02, 0.1, 0.5]), letters)
        if t % 4 == 2:  # a passage that moved
            i, j = sorted((rng.randint(0, len(b)), rng.randint(0, len(b))))
            b = b[j:] + b[:i] + b[i:j] if t % 8 == 2 else b[:i] + b[j:] + b[i:j]
        if t % 4 == 3 and t % 8 == 3:
            b = "".join(rng.choice(letters) for _ in range(rng.randint(0, 300)))
        yield a, b


@pytest.mark.parametrize("gram,bin_,part,whole", [(3, 16, 1, 0), (5, 64, 40, 200), (12, 1024, 4096, A.WHOLE)])
def test_parts_give_the_whole_alignment(spark, monkeypatch, gram, bin_, part, whole):
    monkeypatch.setattr(A, "GRAM", gram), monkeypatch.setattr(A, "BIN", bin_)
    rng = random.Random(gram)
    pairs = list(_pairs(rng, 120))
    left = [(v, n, x) for v, (a, _) in enumerate(pairs) for n, x in enumerate(_dealt(rng, a))]
    right = [(v, n, x) for v, (_, b) in enumerate(pairs) for n, x in enumerate(_dealt(rng, b))]
    left, right = left + [(None, 1, "abc"), (900, 1, "abcabc"), (901, 1, None)], right + [(None, 1, "abc"), (901, 1, "abc")]
    x, y = (spark.createDataFrame(r, "video_id long, n long, text string") for r in (left, right))
    got = {}
    for r in A.align_streams(x, y, part, whole).collect():
        got.setdefault(r.video_id, []).append((r.a, r.b, r.size))
    want = {v: [(m.a, m.b, m.size) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() if m.size] for v, (a, b) in enumerate(pairs)}
    assert {v: sorted(m) for v, m in got.items()} == {v: m for v, m in want.items() if m}


def test_a_long_video_is_many_parts(spark):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    a = "".join(rng.choice(letters) for _ in range(60_000))
    a = a[:20_000] + a[3_000:3_200] + a[20_000:]  # a passage that repeats
    b = _edited(rng, a, 0.01, letters)
    x, y = (spark.createDataFrame([(1, n, s[n * 50 : n * 50 + 50]) for n in range(len(s) // 50 + 1)], "video_id long, n long, text string") for s in (a, b))
    blocks = sorted((r.a, r.b, r.size) for r in A.align_streams(x, y).collect())
    assert blocks == matching(a, b)
    bins = [A._bins(A.placed(df, "n", "text"), "text") for df in (x, y)]
    cuts = sorted((r.a, r.b) for r in A.certain_cuts(*bins).collect())
    assert len(cuts) >= 4 and all(p < q and s < t for (p, s), (q, t) in zip(cuts, cuts[1:]))


@pytest.mark.parametrize("whole", [0, 200, E.WHOLE])
def test_boundaries_against_a_plain_walk(spark, whole):
    rng = random.Random(11)
    letters, marks = "あいうえおかきくけこabcdefgＡＢ①㍍", "。！？!?…」』）)、 \n"
    units, sentences, want = [], [], []
    for v in range(40):
        ref = []
        for _ in range(rng.randint(0, 25)):
            ref.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) + rng.choice(["。", "！？", "", "？」"]))
        text = "".join(_edited(rng, x, rng.choice([0, 0.1]), letters + marks) + rng.choice(["", "。", "。」", "！！』）", "」", " 。"]) for x in ref)
        own = list(enumerate(_dealt(rng, text), 1))
        units += [(v, *x) for x in own]
        sentences += [(v, i, x) for i, x in enumerate(ref)]
        want += [(v, *x) for x in (boundaries_by_reference(own, ref) if own and ref else [])]
    u = spark.createDataFrame(units, "video_id long, n long, text string")
    r = spark.createDataFrame(sentences, "video_id long, ord long, sentence string")
    assert len(want) > 150 and sorted(map(tuple, E.reference_boundaries(u, r, whole=whole).collect())) == sorted(want)
    assert E.reference_boundaries(u.limit(0), r).count() == E.reference_boundaries(u, r.limit(0)).count() == 0


def test_texts_are_never_broadcast(spark):
    """grams and pieces of text grow with the input, and small written tables of them are many times that in the driver."""
    rng = random.Random(7)
    text = "".join(rng.choice("abcdefghijklmnop") for _ in range(4_000))
    rows = [(1, n, text[n * 50 : n * 50 + 50]) for n in range(80)]
    x, y = (spark.createDataFrame(rows, f"video_id long, {c} long, {t} string") for c, t in (("n", "text"), ("ord", "sentence")))
    bins = A._bins(A.placed(x, "n", "text"), "text")
    made = [A.certain_cuts(bins, bins), A.align_streams(x, x, whole=0), E.reference_boundaries(x, y, whole=0)]
    assert made[2].count() > 70
    assert not [df for df in made if "BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString()]
