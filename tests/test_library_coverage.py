"""The library's rejected saves and last changes; coverage by ratio, overlaps; equal to plain forms."""

import random

import pytest

from tempotext.functions import blocks as B, similarity as S
from tempotext.operators import cues as C, library as L

SAVE = "save_id long, kind string, lemma string, surface string, reading string, meaning string, context_key string"


def saves(spark, *rows):
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows, 1)], SAVE)


def test_blank_saves_are_rejected(spark):
    good = ("word", "食べる", "食べた", "たべる", "eat", "c1")
    bad = [("noun", *good[1:])] + [tuple(x if i != k else v for i, x in enumerate(good)) for k, v in ((1, " "), (2, "\u3000"), (4, None), (5, ""))] + [(None, *good[1:])]
    s = saves(spark, good, *bad, ("word", " 食べる ", "食べます", "", "eat ", "c2"))
    assert {r.save_id: r.reason for r in L.rejected_saves(s).collect()} == {2: "kind", 3: "lemma", 4: "surface", 5: "meaning", 6: "context_key", 7: "kind"}
    assert [r.save_id for r in L.upsert_library(s).orderBy("save_id").collect()] == [1, 8]
    tables = L.library_tables(s)
    assert sorted((r.lemma, r.display) for r in tables["entries"].collect()) == [("食べる", "食べる"), ("食べる", "食べる")]  # readings differ
    assert sorted(r.meaning for r in tables["meanings"].collect()) == ["eat", "eat"]
    assert L.rejected_saves(s.limit(0)).count() == 0 and L.library_totals(s.limit(0)).first().entries == 0


def test_saves_that_add_nothing_do_not_change_an_entry(spark):
    one, two = ("word", "a", "a", "", "m", "c1"), ("word", "b", "b", "", "m", "c1")
    s = saves(spark, one, two, one)
    assert {r.entry_key.split("␟")[1]: r.updated for r in L.library_entries(s).collect()} == {"a": 1, "b": 2}
    assert [r.line for r in L.export_glossary(s).collect()] == ["b：m", "a：m"]
    assert {r.lemma: r.updated for r in L.library_tables(s)["entries"].collect()} == {"a": 1, "b": 2}
    more = saves(spark, one, two, one[:5] + ("c2",))
    assert [r.encounters for r in L.top_library_entries(more).collect()] == [2, 1]


@pytest.mark.parametrize("product", [0, 10_000])
def test_ratio_with_a_limit_equals_the_ratio(monkeypatch, product):
    monkeypatch.setattr(B, "PRODUCT", product)
    rng = random.Random(product)
    for _ in range(400):
        a, b = ("".join(rng.choice("abcde"[: rng.randint(2, 5)]) for _ in range(rng.randint(0, 60))) for _ in range(2))
        for least in (0.0, 0.3, 0.46, 0.7, 1.0):
            assert B.reaches(a, b, least) == (B.matched_ratio(a, b) >= least)


def test_overlap_equals_trying_every_length():
    rng = random.Random(5)
    for _ in range(3000):
        a, b = ("".join(rng.choice("ab") for _ in range(rng.randint(0, 14))) for _ in range(2))
        n = max((n for n in range(1, min(len(a), len(b)) + 1) if a.endswith(b[:n])), default=0)
        assert S._overlap(a, b) == n
    assert S.joined("x" * 30_000 + "abcd", "abcd" + "y" * 9) == "x" * 30_000 + "abcd" + "y" * 9
    assert S._overlap("a" * 50_000, "a" * 50_000) == 50_000


def test_coverage_by_containment_and_by_ratio(spark):
    span = "video_id long, n long, start_ms long, end_ms long, text string"
    cues = spark.createDataFrame([(1, 1, 0, 10, "abcdefgh"), (1, 2, 0, 10, "abcdefgx"), (1, 3, 9000, 9010, "abcdefgh"), (1, 4, 0, 10, ""), (1, 5, 0, 10, None)], span)
    seen = spark.createDataFrame([(1, 1, 0, 10, "zz abcdefgh"), (1, 2, 0, 10, "q")], span)
    assert sorted(r.n for r in C.uncovered_cues(cues, seen, least=None).collect()) == [2, 3, 4, 5]
    assert sorted(r.n for r in C.uncovered_cues(cues, seen).collect()) == [3, 4, 5]
