"""Fuzzy passages: shredded copies, lone pairs by identity, whole corpora against brute force, edge cases."""

import random

import numpy as np
import pytest

from tempotext.llm import substring as B

DOC = "doc_id long, text string, lang string, source string, n_chars long, start_word string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], DOC)


def junk(rng, n):
    return [f"j{rng.randrange(10**9)}" for _ in range(n)]


def changed(rng, words, n):
    """With exactly n of the words replaced, never the first or the last."""
    out = list(words)
    for k in rng.sample(range(1, len(words) - 1), n):
        out[k] = f"c{rng.randrange(10**9)}"
    return out


def test_shredded_fuzzy_copies(spark):
    """Pieces of a passage of 120 words stand in four earlier documents; either copy has one word in 12 of its own."""
    rng, rows, pairs = random.Random(1), [], []
    for trial in range(30):
        base, at = [f"b{trial}_{k}" for k in range(120)], 10 * trial
        for k in range(4):
            rows.append((at + k, " ".join(junk(rng, 40) + base[30 * k : 30 * k + 30] + junk(rng, 40))))
        for k in (4, 5):
            rows.append((at + k, " ".join(junk(rng, 50) + changed(rng, base, 10) + junk(rng, 50))))
        pairs.append((at + 5, at + 4))
    got = B.passages(docs(spark, rows)).collect()
    found = {(r.doc_id, r.first_doc) for r in got if r.end_word - r.start_word >= 100}
    assert sum(p in found for p in pairs) >= 27 and all((r.doc_id, r.first_doc) in pairs for r in got)


@pytest.mark.parametrize("share, wide", [(0.82, 27), (0.84, 27), (0.9, 29)])
def test_lone_pairs_by_share_of_equal_words(spark, share, wide):
    rng, rows = random.Random(int(100 * share)), []
    for trial in range(30):
        base = [f"b{trial}_{k}" for k in range(120)]
        rows.append((2 * trial, " ".join(junk(rng, 70) + base + junk(rng, 90))))
        rows.append((2 * trial + 1, " ".join(junk(rng, 60) + changed(rng, base, round(120 * (1 - share))) + junk(rng, 80))))
    got = B.passages(docs(spark, rows)).collect()
    assert {(r.doc_id, r.first_doc) for r in got} <= {(2 * t + 1, 2 * t) for t in range(30)}
    assert all(60 <= r.start_word and r.end_word <= 180 and r.identity >= 0.8 for r in got)
    assert len({r.doc_id for r in got}) >= 28 and len({r.doc_id for r in got if r.end_word - r.start_word >= 100}) >= wide


def windows(x, y):
    """Longest stretch of x of 50 words or more with 4 of 5 equal on one diagonal of y, its ends equal, fewer than 10 words unequal in a row."""
    best = 0
    for d in range(-len(y) + 50, len(x) - 49):
        a, b = max(0, d), max(0, -d)
        same = np.array([u == v for u, v in zip(x[a:], y[b:])])
        where = np.nonzero(same)[0]
        if len(where) < 40:
            continue
        for part in np.split(where, np.nonzero(np.diff(where) > 10)[0] + 1):
            for i in range(len(part)):
                long_ = part[i:] - part[i] + 1
                ok = (np.arange(1, len(long_) + 1) >= 0.8 * long_) & (long_ >= 50)
                if ok.any():
                    best = max(best, int(long_[ok].max()))
    return best


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for u in x:
        before = 0
        for k, v in enumerate(y, 1):
            before, row[k] = row[k], before + 1 if u == v else max(row[k], row[k - 1])
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_corpus_equals_brute_force(spark, seed):
    """200 documents that share passages, whole or in pieces, with some words changed: whoever repeats one is reported, and no other."""
    rng, rows = random.Random(seed), []
    pool = [[f"p{p}_{k}" for k in range(rng.choice([30, 55, 80, 120]))] for p in range(25)]
    for i in range(200):
        text = junk(rng, rng.randrange(30))
        for p in rng.sample(pool, rng.randrange(3)):
            a = rng.choice([0, 0, 0, len(p) // 3])
            part = p[a : rng.choice([len(p), len(p), 2 * len(p) // 3 + a])]
            text += changed(rng, part, rng.choice([0, 0, len(part) // 20, len(part) // 12])) + junk(rng, rng.randrange(25))
        rows.append((i, " ".join(text)))
    got = B.passages(docs(spark, rows)).collect()
    texts = [t.split() for _, t in rows]
    for r in got:
        one, two = texts[r.doc_id][r.start_word : r.end_word], texts[r.first_doc][r.first_start : r.first_end]
        assert r.first_doc < r.doc_id and len(one) >= 50 and lcs(one, two) >= 0.8 * max(len(one), len(two)) - 1e-9
    words = {}
    for r in got:
        words.setdefault(r.doc_id, set()).update(range(r.start_word, r.end_word))
    missed, had = 0, 0
    for j in range(200):
        # sets first: a stretch has 40 words in common at least
        longest = max((windows(texts[j], texts[i]) for i in range(j) if len(set(texts[j]) & set(texts[i])) >= 40), default=0)
        had += longest > 0
        missed += longest > 0 and len(words.get(j, ())) < 0.8 * longest
        assert longest or j not in words
    assert had > 60 and missed <= 0.02 * had


def test_uncovered_seeds():
    m = np.array([[1, 9, 0, 0], [1, 9, 10, 0], [1, 9, 46, 0], [2, 9, 10, 0], [3, 9, 99, 0]])
    known = np.array([[1, B.NONE, 8, 50], [3, B.NONE, 0, 60]])
    assert B.uncovered(m, known).tolist() == [[1, 9, 0, 0], [1, 9, 46, 0], [2, 9, 10, 0], [3, 9, 99, 0]]


def test_edge_cases(spark):
    rng = random.Random(4)
    base, long_ = junk(rng, 70), junk(rng, 60_000)
    text = " ".join(base)
    rows = [(None, text), (1, None), (2, ""), (3, text.upper()), (3, " ".join(junk(rng, 60))), (4, text), (4, text), (5, " ".join(long_)), (6, " ".join(long_[:30_000] + base + long_[30_000:]))]
    got = sorted((r.doc_id, r.start_word, r.end_word, r.first_doc) for r in B.passages(docs(spark, rows)).collect())
    assert got == [(4, 0, 70, 3), (6, 0, 30_000, 5), (6, 30_000, 30_070, 3), (6, 30_070, 60_070, 5)]
    assert B.passages(docs(spark, [])).collect() == []
    left = {(r.doc_id, r.text) for r in B.cut_passages(docs(spark, [(1, text), (2, text + " more"), (None, text), (None, None)])).collect()}
    assert left == {(1, text), (2, " more"), (None, None)}
