"""Steps that many queries share: each text is shuffled once and sent to Python once, if at all; the short forms equal the long ones."""

from __future__ import annotations

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tempotext.functions import similarity as S, text as T
from tempotext.operators import cues as C

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def calls(df) -> int:
    return plan(df).count("ArrowEvalPython [")


def test_cues_are_shuffled_once(spark):
    assert plan(__spark_entry__.queries()["normalize_text"](spark, SF)).count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["character_timings", "read_timed_transcript", "read_vtt_captions", "read_json3_captions", "similar_text"])
def test_python_reads_a_text_once(spark, name):
    assert calls(__spark_entry__.queries()[name](spark, SF)) == 1


def test_texts_that_python_does_not_see(spark):
    texts = ["", "plain", "ｱ ß é", "&amp;", "a & b", "ﬁ &lt;é&gt;", None]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(T.nfkc(F.col("x")).alias("a"), T.unescape(F.col("x")).alias("b")).collect()
    assert [r.a for r in got] == [x if x is None else unicodedata.normalize("NFKC", x) for x in texts]
    assert [r.b for r in got] == ["", "plain", "ｱ ß é", "&", "a & b", "ﬁ <é>", None]


def test_normalized_equals_the_column(spark):
    texts = ["", " a \t b \r\n\n c\x0bd\x85e ", "ｆｕｌｌ　ｗｉｄｔｈ\n x ", "\t", "a\rb\r\n\tc"]
    got = spark.createDataFrame([(x,) for x in texts], "x string").select(T.normalize_text(F.col("x")).alias("y")).collect()
    assert [r.y for r in got] == [T.normalized(x) for x in texts]


def test_ratio_reaches_equals_the_ratio():
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcde ") for _ in range(n))
    for _ in range(3000):
        a = word(r.randint(0, 150))
        b = list(a) if r.random() < 0.7 else list(word(r.randint(0, 150)))
        for _ in range(r.randint(0, 40)):
            at = r.randint(0, len(b))
            b[at : at + r.randint(0, 1)] = word(r.randint(0, 2))
        b = "".join(b)
        for least in (82.0, 60.0, S.ratio(a, b), 0.0, 100.0):
            assert S.ratio_reaches(a, b, least) == (S.ratio(a, b) >= least), (a, b, least)


def test_half_milliseconds_go_to_the_even_one(spark):
    from tempotext.operators.sentences import character_timings

    rows = spark.createDataFrame([(1, 1, "ab", 0, 5), (1, 2, "ab", 0, 7)], "video_id long, n long, text string, start_ms long, end_ms long")
    assert [(r.n, r.i, r.start_ms, r.end_ms) for r in character_timings(rows).orderBy("n", "i").collect()] == [(1, 0, 0, 2), (1, 1, 2, 5), (2, 0, 0, 4), (2, 1, 4, 7)]


def test_edited_sentences_are_numbered_in_one_shuffle(spark):
    """Replaced sentences are dropped where they are numbered, without a join of all sentences; null and other videos stay."""
    from tempotext.operators.sentences import resegment_sentences

    rows = [(1, n, f"{x}.", n * 100, n * 100 + 90) for n, x in enumerate("abcd", 1)] + [(2, 1, "e.", 0, 9), (None, 1, "f.", 0, 9)]
    s = spark.createDataFrame(rows, "video_id long, n long, text string, start_ms long, end_ms long")
    e = spark.createDataFrame([(1, 1, [2, 3], "b.c.\nx."), (2, 2, [7], "y.")], "edit_id long, video_id long, ids array<long>, text string")
    got, rejects = resegment_sentences(s, e)
    assert "LeftAnti" not in plan(got)
    assert [(r.n, r.text) for r in got.where("video_id = 1").orderBy("n").collect()] == [(1, "a."), (2, "b."), (3, "c."), (4, "x."), (5, "d.")]
    assert [r.text for r in got.where("video_id is null or video_id = 2").orderBy("video_id").collect()] == ["f.", "e."]
    assert [r.edit_id for r in rejects.collect()] == [2]


def test_references_shuffle_a_text_by_block_of_segments(spark):
    """a long cue's text isn't sent to each bin and each segment that it overlaps."""
    rng = random.Random(24)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(60_000))
    cues = spark.createDataFrame([(1, 1, 0, 3_600_000, text)], "video_id long, n long, start_ms long, end_ms long, text string")
    segments = spark.createDataFrame([(1, i, 10_000 * i, 10_000 * i + 500) for i in range(300)], "video_id long, n long, start_ms long, end_ms long")
    gateway = spark.sparkContext._gateway

    def written():
        stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = written()
    rows = C.align_references(segments, cues).select("n", F.xxhash64("reference").alias("h"), F.size("reference").alias("k")).collect()
    assert sorted(r.n for r in rows) == list(range(300)) and {r.k for r in rows} == {1} and len({r.h for r in rows}) == 1
    assert sum(v for k, v in written().items() if k not in before) < 10_000_000  # 180 kB of text; all pairs would hold 54 MB


def test_references_equal_brute_force(spark):
    """Repeated numbers of cues and of segments, null and equal texts, segments without cues, several blocks, long spans, null numbers."""
    rng = random.Random(25)
    cues, segments = [], []
    for v in (1, 2):
        for i in range(150):
            a = rng.randrange(0, 200_000)
            cues.append((v, i % 140, a, a + rng.choice((-5, 0, 400, 2_000, 70_000)), rng.choice((None, "a", "b", f"t{i}"))))
        for i in range(160):
            a = rng.randrange(-3_000, 260_000)
            segments.append((v, i % 150, a, a + rng.choice((-2_000, 0, 900, 50_000))))
    cues += [(1, None, 100, 900, "no number"), (1, 7, -500, -10, "before"), (None, 1, 0, 100, "x")]
    segments += [(3, 1, 0, 100), (None, 1, 0, 100), (1, None, 0, 100)]
    got = C.align_references(spark.createDataFrame(segments, "video_id long, n long, start_ms long, end_ms long"), spark.createDataFrame(cues, "video_id long, n long, start_ms long, end_ms long, text string"))
    first = lambda x: (x is not None, x if x is not None else 0)
    want = []
    for v, n, *_ in segments:
        pairs = {(first(c[1]), (c[4] is not None, c[4] or ""), c[4]) for w, m, a, b in segments if (w, m) == (v, n) and v is not None and n is not None and a <= b + 2 * C.PAD for c in cues if c[0] == v and 0 <= c[3] and c[2] <= c[3] and c[3] >= a - C.PAD and c[2] <= b + C.PAD}
        want.append((v, n, list(dict.fromkeys(p[2] for p in sorted(pairs, key=lambda p: p[:2])))))
    assert sorted(map(repr, ((r.video_id, r.n, r.reference) for r in got.collect()))) == sorted(map(repr, want))


def test_sentences_are_not_shuffled_for_their_edits(spark):
    """the lines are read twice, as sentences and as segments, and both readings are the same shuffle; no join takes all of them."""
    df = __spark_entry__.queries()["resegment_by_source"](spark, SF)
    rows = df.collect()
    p = plan(df).split("== Initial Plan ==")[0]
    assert rows and p.count("documents.parquet") <= 2 and p.count("Exchange hashpartitioning(video_id") - p.count("ReusedExchange") <= 4


def test_named_sentences(spark):
    """Sentences that several edits name, edits of unknown and of null videos, numbers that are missing or repeat."""
    from tempotext.operators.sentences import _named

    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (None, 1, "d"), (2, None, "e"), (2, 1, "f")], "video_id long, id long, text string")
    asked = spark.createDataFrame([(7, 0, 1, 2), (8, 0, 1, 2), (8, 1, 1, 1), (9, 0, None, 1), (9, 1, 3, 1), (9, 2, 2, 5)], "edit_id long, k int, video_id long, id long")
    assert sorted((r.edit_id, r.k, r.text) for r in _named(rows, asked).collect()) == [(7, 0, "b"), (7, 0, "c"), (8, 0, "b"), (8, 0, "c"), (8, 1, "a")]
