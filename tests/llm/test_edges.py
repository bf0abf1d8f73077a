"""Leaks against scoring every item on every passage, noisy-or against a plain product, and edge cases of the earlier operators."""

import math
import random
import re

import numpy as np
import pytest

from tempotext.llm import decontaminate as D, embed_dedup as E, simhash as S, toxicity as X, url_rules as U, warc as Wc

DOC = "doc_id long, text string, score double, item_id long, overlap string"


def words(rng, n, size):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def docs(spark, rows):
    """Documents with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, 0.5, 7, "x") for i, t in rows], DOC)


def all_leaks(ix, text):
    """Items that some passage holds: each item scored in full on each passage, then its 5-grams counted."""
    own, found = D.tokens(text), set()
    for a in range(0, len(own), ix.longest):
        part = own[a : a + 2 * ix.longest]
        full = np.zeros(len(ix.ids))
        for t in {ix.term[w] for w in part if w in ix.term}:
            full[ix.items[t]] += ix.impact[t]
        for k in np.nonzero(full >= D.LEAST_SCORE - 1e-12)[0]:
            total, question, answer = ix.overlap(int(k), part)
            if total >= D.LEAST_OVERLAP and min(question, answer) >= D.LEAST_PART:
                found.add(ix.ids[k])
        if a + 2 * ix.longest >= len(own):
            break
    return found


@pytest.mark.parametrize("size", [150, 4000])
def test_leaks_equal_scoring_everything(spark, size):
    rng = random.Random(size)
    items = [(k, " ".join(words(rng, rng.randrange(12, 60), size))) for k in range(60)]
    items += [(60, items[3][1]), (61, items[4][1] + " more"), (62, None), (None, items[5][1])]
    rows = []
    for i in range(80):
        out = words(rng, rng.randrange(0, 400), size)
        for _ in range(rng.randrange(3)):
            own = items[rng.randrange(60)][1].split()
            own = own[: int(len(own) * rng.choice([0.5, 0.8, 0.9, 1.0]))]
            if rng.random() < 0.4:
                own[rng.randrange(len(own))] = "other"
            at = rng.randrange(len(out) + 1)
            out[at:at] = own
        rows.append((i, " ".join(out)))
    rows += [(200, None), (201, ""), (202, " \n "), (203, " ".join(words(rng, 60_000, size) + items[9][1].split()))]
    got = {(r.doc_id, r.item_id) for r in D.leaks(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    ix = D.Index.build([x for x in items if None not in x])
    assert got == {(i, k) for i, t in rows for k in all_leaks(ix, t or "")}
    assert (203, 9) in got and {k for i, k in got if i == 203} >= {9}


def test_leaks_of_repeated_rows_and_equal_items(spark):
    rng = random.Random(1)
    item = " ".join(words(rng, 30, 10**6))
    b = spark.createDataFrame([(1, item), (2, item), (1, item)], "item_id long, text string")
    d = docs(spark, [(5, item), (5, item), (None, item), (6, "clean")])
    got = sorted(((r.doc_id, r.item_id) for r in D.leaks(d, b).collect()), key=str)
    assert set(got) == {(5, 1), (5, 2), (None, 1), (None, 2)} and got.count((5, 2)) == 2
    kept = D.drop_leaks(d, b)
    assert kept.columns == d.columns and [r.doc_id for r in kept.collect()] == [6]
    assert D.leaks(d.limit(0), b).count() == 0 and D.drop_leaks(d.limit(0), b).count() == 0


def test_noisy_or_equals_plain_product(spark):
    rng = random.Random(2)
    model = X.Model({w: rng.uniform(-2, 2) for w in [f"w{k}" for k in range(50)] + ["blo", "bloc"]}, -3.0)
    texts = [". ".join(" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30))) for _ in range(40)]
    for text in texts:
        left = 1.0
        for s in X.SENTENCE.split(text.lower()):
            own = X.LETTERS.findall(s)
            if own:
                left *= 1 - model.sentence(own)
        assert math.isclose(model.document(text), 1 - left, rel_tol=1e-9, abs_tol=1e-12)
    longest = "calm words only. " * 20_000 + "w1"
    d = docs(spark, [(1, longest), (1, longest), (None, ""), (2, None), (3, "1 2 3")])
    got = X.score(d.drop("score"), model).collect()
    assert got[0].score == got[1].score == model.document(longest) and [r.score for r in got[2:]] == [0, 0, 0]
    assert X.score(d.drop("score").limit(0), model).count() == 0


def test_urls_of_a_hot_host_repeats_and_empty_tables(spark):
    rules = spark.createDataFrame([("a.com", "/x/", "block"), ("a.com", "/x/", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(k % 50, f"http://b.A.com/x/{k % 3}", "h") for k in range(600)] + [(None, "http://a.com/x/", "h"), (None, None, "h")], "page_id long, url string, host string")
    for small in (1000, 0):
        got = U.judge_urls(pages, rules, small_rules=small).collect()
        assert len(got) == 602 and sum(r.verdict == "block" for r in got) == 601 and {r.rule for r in got if r.verdict == "allow"} == {None}
        assert U.judge_urls(pages.limit(0), rules, small_rules=small).count() == 0
        assert {r.verdict for r in U.judge_urls(pages, rules.limit(0), small_rules=small).collect()} == {"allow"}


def test_simhash_of_repeats_nulls_and_long_texts(spark):
    rng = random.Random(3)
    text, big = " ".join(words(rng, 40, 10**6)), " ".join(words(rng, 100_000, 10**6))
    rows = [(9, text), (9, text), (4, text.upper()), (None, text), (7, big), (8, big), (1, None), (2, " \t")]
    got = sorted(((r.doc_id, r.component_id) for r in S.simhash_components(docs(spark, rows)).collect()), key=str)
    assert len(got) == 8 and {x for x in got if x[0] is not None} == {(9, 4), (4, 4), (7, 7), (8, 7), (1, 1), (2, 1)}
    assert S.simhash_components(docs(spark, rows).limit(0)).count() == 0


def test_embeddings_of_one_id_and_of_no_rows(spark):
    v = [1.0, 0.0, 0.0]
    df = spark.createDataFrame([(1, v, "a"), (1, v, "a"), (2, [0.0, 1.0, 0.0], "a"), (3, None, "a"), (4, v, None), (5, [0.0] * 3, "a"), (6, [float("nan"), 0.0, 0.0], "a")], "vec_id long, embedding array<double>, label string")
    got = E.cosine_links(df, tile=2).collect()
    assert len(got) == 7 and {r.vec_id: r.component_id for r in got} == {k: k for k in range(1, 7)}
    assert all(r.n_links == 0 for r in got if r.vec_id != 1)
    assert E.cosine_links(df.limit(0)).count() == 0


def test_archives_of_no_and_repeated_rows(spark, tmp_path):
    big = "b" * 1500
    df = spark.createDataFrame([(1, "http://a/", big, "x"), (1, "http://a/", big, "x"), (2, "http://b/", "", "x"), (3, "http://c/", "é" * 500, "x"), (4, "http://d/", "é" * 500, "x")], "page_id long, url string, html string, payload string")
    got = sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in Wc.round_trip(df.where("page_id > 2"), str(tmp_path / "a")).collect())
    assert got == [(3, 1000, "revisit", 4), (4, 1000, "response", None)]
    two = [r for r in Wc.round_trip(df, str(tmp_path / "b")).collect() if r.page_id == 1]
    assert len(two) == 2 and {r.payload_bytes for r in two} == {1500} and "response" in {r.record_type for r in two}
    assert Wc.round_trip(df.limit(0), str(tmp_path / "c")).count() == 0
    assert re.fullmatch("[0-9a-f]{40}", two[0].payload_digest)


def test_near_copies_take_their_links_from_simhash(spark):
    """With MinHash keys that no two unlike sets share, copies are found by fingerprints alone, and each link is verified."""
    from tempotext.llm import simhash

    words = [f"w{k}" for k in range(400)]
    texts = {1: words, 2: [*words[:-1], "other"], 3: [f"v{k}" for k in range(400)], 4: ["a", "b"], 5: ["c", "d"]}
    d = spark.createDataFrame([(k, " ".join(w)) for k, w in texts.items()], "doc_id long, text string")
    prints = {k: simhash.fingerprint(simhash.lower_words(" ".join(w)), 3, 42) for k, w in texts.items()}
    assert (prints[1] ^ prints[2]).bit_count() <= 2
    got = {r.doc_id: r.component_id for r in simhash.near_copies(d, bands=1, rows=3000).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
