"""Golden and brute-force tests of sentences, frames, reuse, library state and streams."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tempotext.functions import similarity as S
from tempotext.operators import frames as P, library as L, reuse as R, segments as G, sentences as N
from tempotext.streaming import replay as Z

UNITS = "video_id long, n long, text string, start_ms long, end_ms long"


def test_cut_offsets():
    assert N.cut_offsets("お電話ありがとうございます。こちらです。") == [14, 20]
    assert N.cut_offsets("そうです私は") == [4]
    assert N.cut_offsets('ab. c!" d') == [3, 7, 9]
    assert N.cut_offsets("まだ、") == [] and N.cut_offsets("") == N.cut_offsets(None) == []
    assert 5 not in N.cut_offsets("ありがとうございます")


def test_build_sentences(spark):
    u = spark.createDataFrame([(1, 1, "フリーダー", 0, 1000), (1, 2, "ですさっき病院に行ったら", 1000, 4000), (2, 1, None, 0, 1), (3, 1, "a", 0, 10), (3, 2, "b", 10, 20)], UNITS)
    cuts = spark.createDataFrame([(1, 2, 2), (1, 2, 2), (1, 2, 12), (9, 9, 1), (3, 1, 0), (3, 1, None)], "video_id long, n long, after_char long")
    got = {(r.video_id, r.n): (r.text, r.start_ms, r.end_ms, r.units) for r in N.build_sentences(u, cuts).collect()}
    assert got == {(1, 1): ("フリーダーです", 0, 1500, [1, 2]), (1, 2): ("さっき病院に行ったら", 1500, 4000, [2]), (3, 1): ("a b", 0, 20, [1, 2])}
    assert N.check_conservation(u, N.build_sentences(u, cuts)).where("video_id <> 2 and not conserved").count() == 0
    assert N.build_sentences(u.limit(0), cuts).count() == 0


def test_reattach_punctuation(spark):
    rows = [(1, 1, "。お電話", 0, 1000, [1]), (1, 2, "。こちらです", 1000, 2200, [1]), (1, 3, "。", 2200, 2300, [2]), (1, 4, "！！」", 2300, 2400, [3]), (1, 5, "？はい。", 2400, 3200, [4])]
    got = N.reattach_punctuation(spark.createDataFrame(rows, UNITS + ", units array<long>")).orderBy("n").collect()
    assert [(r.n, r.text, r.start_ms, r.end_ms, r.units) for r in got] == [(1, "。お電話。", 0, 1200, [1]), (2, "こちらです。！！」？", 1200, 2600, [1, 2, 3, 4]), (3, "はい。", 2600, 3200, [4])]


def test_edits(spark):
    s = spark.createDataFrame([(1, 1, "本物", 0, 1000), (1, 2, "です続き", 1000, 3000), (1, 3, "。", 3000, 3100), (1, 4, "終", 4000, 5000)], UNITS)
    e = spark.createDataFrame([(1, 1, [1, 2, 3], "本物です。続き。")], "edit_id long, video_id long, ids array<long>, text string")
    rows = N.resegment_sentences(s, e)[0].orderBy("n").collect()
    assert [(r.n, r.text, r.start_ms, r.end_ms) for r in rows] == [(1, "本物です。", 0, 2000), (2, "続き。", 2000, 3000), (3, "終", 4000, 5000)]
    changed = N.resegment_sentences(s, e.withColumn("text", F.lit("本物です。続きx")))[0].orderBy("n").collect()
    assert [(r.text, r.start_ms, r.end_ms) for r in changed] == [("本物です。", 0, 1771), ("続きx", 1771, 3100), ("終", 4000, 5000)]
    bad = spark.createDataFrame([(2, 1, [1, 3], "a"), (3, 1, [], "a"), (4, 1, [9], "a"), (5, 1, [1, 1], "b"), (6, 1, [1], " "), (7, 2, [1], "a"), (8, 1, [1], None)], e.schema)
    kept, rejects = N.resegment_sentences(s, bad)
    assert {r.edit_id: r.reason for r in rejects.collect()} == {2: "not contiguous", 3: "no sentence", 4: "foreign", 5: "twice", 6: "empty", 7: "foreign", 8: "empty"}
    assert [r.text for r in kept.orderBy("n").collect()] == ["本物", "です続き", "。", "終"]


FRAMES = "video_id long, frame_index long, ts_ms long, signature array<double>, visual_line_count long"


def _frames(spark, seed):
    rng, rows = random.Random(seed), []
    states = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0], [0.0, 0.0, 0.0], [1.0, 0.1, 0.0]]
    for v in (1, 2):
        now = 0
        for i in range(60):
            now = rng.randrange(5) if rng.random() < 0.3 else now
            rows.append((v, i, i * 100, states[now], 1))
    return rows, spark.createDataFrame(rows, FRAMES)


@pytest.mark.parametrize("seed", [1, 2])
def test_keyframes_and_probes_against_brute_force(spark, seed):
    rows, df = _frames(spark, seed)
    want = set()
    for v in (1, 2):
        x = [np.array(r[3]) for r in rows if r[0] == v]
        want.add((v, 0))
        anchor, wait = x[0], None
        for i in range(1, len(x)):
            if P.similarity(anchor, x[i]) >= 0.86:
                wait = None
            elif wait is None or P.similarity(x[wait], x[i]) < 0.86:
                wait = i
            else:
                want.add((v, wait))
                anchor, wait = x[wait], None
    chosen = P.select_keyframes(df)
    assert {(r.video_id, r.frame_index) for r in chosen.collect()} == want
    spans = spark.createDataFrame([(1, -50, 2400), (1, 3000, 5900), (2, 0, 5900)], "video_id long, start_ms long, end_ms long")
    taken = {(v, i): x for v, i, _, x, _ in rows if (v, i) in want}
    first = set(taken)
    for v, a, b in [(1, 0, 2400), (1, 3000, 5900), (2, 0, 5900)]:
        for t in range(a, b + 1, 300):
            x = np.array(next(r[3] for r in rows if r[0] == v and r[1] == t // 100))
            if all(P.similarity(np.array(y), x) < 0.96 for (w, j), y in taken.items() if w == v and abs(j * 100 - t) <= 600):
                taken[v, t // 100] = x
    assert {(r.video_id, r.frame_index) for r in P.probe_windows(chosen, df, spans, 300).collect()} == set(taken) - first


def test_supplemental_and_empty_frames(spark):
    f = spark.createDataFrame([(1, i, i * 500, [1.0], 2) for i in range(6)], FRAMES)
    seen = spark.createDataFrame([(1, 3, 1)], "video_id long, frame_index long, line_count long")
    gaps = spark.createDataFrame([(1, 1000, 2000)], "video_id long, start_ms long, end_ms long")
    got = {r.frame_index for r in P.supplemental_frames(f, f.where("frame_index = 3"), seen, gaps).collect()}
    assert got == {2, 4}
    assert P.select_keyframes(f.limit(0)).count() == 0 and P.similarity(P._vector(None), P._vector(None)) == 1.0


def test_representative_prefers_the_text_that_holds_the_other(spark):
    rows = [(1, 0, 0, "今日は学校", 0.9), (1, 1, 1, "今日は学校に行きます", 0.9), (1, 2, 2, "今日は学校", 0.9), (1, 3, 3, " ", 0.9)]
    r = R.representative_text(spark.createDataFrame(rows, "video_id long, ts_ms long, frame_index long, text string, confidence double"), "video_id").first()
    assert (r.text, r.alternatives, round(r.confidence, 6)) == ("今日は学校に行きます", ["今日は学校"], 0.9)


def test_reference_conflict(spark):
    rows = [(1, "メリットの1つ目は挨拶がないところです。", "ですメリットの1つ目は接客がないところ"), (2, "焼き菓子を作っています。", "今日は工場で働いています"), (3, "短い", "短く"), (4, None, "x")]
    got = {r.n: r.conflict for r in R.reference_conflict(spark.createDataFrame(rows, "n long, text string, reference string"), "n").collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}


def test_similar_and_aligned(spark):
    p = spark.createDataFrame([("abcd", "abcde"), ("abcdefgh", "abcdefgx"), ("abc", "xyz"), (None, "a")], "a string, b string")
    assert [r.x for r in p.select(R.similar_text(F.col("a"), F.col("b")).alias("x")).collect()][:3] == [True, True, False]
    got = p.limit(2).select(S.align_characters(F.col("a"), F.col("b")).alias("x")).collect()
    assert [(q.a_index, q.b_index) for q in got[0].x] == [(0, 0), (1, 1), (2, 2), (3, 3)] and len(got[1].x) == 7


def test_reuse(spark):
    cols = "video_id string, fps int, roi string, language string, model string"
    w = spark.createDataFrame([("a", "v", 10, None, "ja", "m"), ("b", "v", 10, None, "ja", "other"), ("c", None, 10, None, "ja", "m")], "job_id string, " + cols)
    saved = spark.createDataFrame([("v", 10, None, "ja", "m", 1), ("v", 10, None, "ja", "m", 2)], cols + ", revision int")
    assert {r.job_id: r.compatible for r in R.reuse_compatible(w, saved).collect()} == {"a": True, "b": False, "c": False}


def test_stage_table(spark, tmp_path):
    a = spark.createDataFrame([(v, n, f"{v}.{n}") for v in range(8) for n in range(2)], "video_id long, n long, text string")
    R.write_stage(a, str(tmp_path / "t"), a.schema, 3)
    R.write_stage(a.where("video_id = 5 and n = 0").withColumn("text", F.lit("new")), str(tmp_path / "t"), a.schema, 3)
    got = {(r.video_id, r.n): r.text for r in R.load_stage(spark, str(tmp_path / "t"), a.schema).collect()}
    assert got == {(v, n): f"{v}.{n}" for v in range(8) for n in range(2) if v != 5} | {(5, 0): "new"}


def test_transcripts_on_disk(spark, tmp_path):
    for name in ("a.md", "a.m4a", "b（整理版）.md", "c.txt"):
        (tmp_path / name).write_text('title: "T \\"x\\""\nsource_url: "u"\n', encoding="utf-8")
    got = R.discover_transcripts(R.list_files(spark, str(tmp_path))).collect()
    assert [(r.path.rsplit("/", 1)[1], r.audio.rsplit("/", 1)[1]) for r in got] == [("a.md", "a.m4a")]
    m = spark.createDataFrame([("v", 'title: "T \\"x\\""\nsource_url: "u"'), ("w", "title: broken"), ("x", None), ("y", "\n" * 30 + 'title: "late"')], "video_id string, body string")
    assert {r.video_id: (r.title, r.source_url) for r in R.read_transcript_metadata(m).collect()} == {"v": ('T "x"', "u"), "w": ("", ""), "x": ("", ""), "y": ("", "")}


def test_analysis_and_readings(spark):
    j = '```json\n{"vocabulary": [{"kind": "word", "expression": "行った", "lemma": "行く", "reading": "", "meaning": "去"}], "grammar": [{"pattern": "〜た", "lemma": "た", "explanation": "past"}]}\n```'
    df = L.flatten_analysis(spark.createDataFrame([("s", j), ("t", "none"), ("u", None)], "sentence_id string, reply string"))
    assert {(r.kind, r.surface, r.lemma, r.reading, r.meaning) for r in df.collect()} == {("word", "行った", "行く", "", "去"), ("grammar", "〜た", "た", "", "past")}
    got = L.missing_reading(df.withColumn("pos", F.when(F.col("kind") == "word", 0).otherwise(1))).collect()
    assert [(r.sentence_id, r.missing) for r in got] == [("s", [0])]


@pytest.mark.parametrize("in_order", [True, False])
def test_stream_segments_equals_batch(spark, tmp_path, in_order):
    """A stream in three files, in order of time or dealt at random, gives the batch form's segments, alternatives and clamped ends too."""
    rng, rows, end = random.Random(3), [], 89_700
    for v in (1, 2):
        for i in range(90):
            text = rng.choice(["hello there", "hello thera", "ｈｅｌｌｏ　ｔｈｅｒｅ", "goodbye now", "hello\n\n there", "", None])
            rows.append((v, i * 1000, i, text, rng.choice([0.5, 0.9, 0.1, None])))
        rows.append((v, end + 300, 90, None, None))  # the end of the video
    typed = "video_id long, ts_ms long, frame_index long, text string, confidence double"
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("ts_ms") / 1000)
    df = spark.createDataFrame(rows, typed).withColumn("at", at)
    later = spark.createDataFrame([(3, 10**7, 0, None, None)], typed).withColumn("at", at)  # moves the watermark past all
    src = str(tmp_path / "in")
    for k in range(3):
        part = df.where(f"frame_index div 31 = {k}" if in_order else f"pmod(hash(video_id, frame_index), 3) = {k}")
        (part.unionByName(later) if k == 2 else part).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = Z.replay(Z.stream_segments(stream, 500, 82.0, duration_ms=end), str(tmp_path / "out"), str(tmp_path / "ck")).collect()
    want = G.segment_observations(df.drop("at"), end, 500).collect()
    rounded = lambda rows: sorted((r.video_id, r.start_ms, r.end_ms, r.text, round(r.confidence, 9), r.observation_count, tuple(r.alternatives), r.needs_review) for r in rows)
    assert rounded(got) == rounded(want) and len(want) > 40


SOURCED = "video_id long, n long, text string, start_ms long, end_ms long, source_units array<long>, source_segments array<long>"
EDIT = "edit_id long, video_id long, ids array<long>, text string"


def test_resegmentation_moves_a_boundary_and_keeps_the_timeline(spark):
    own = spark.createDataFrame([(1, 1, "こんにちは", 0, 1000, [1], [1]), (1, 2, "フリーダー", 1000, 2000, [2], [2]), (1, 3, "ですさっき病院に行ったら", 2000, 5000, [3], [3])], SOURCED)
    edit = spark.createDataFrame([(1, 1, [1, 2, 3], "こんにちは。\nフリーダーです。\nさっき病院に行ったら")], EDIT)
    new = N.resegment_sentences(own, edit)[0].orderBy("n").collect()
    assert [r.text for r in new] == ["こんにちは。", "フリーダーです。", "さっき病院に行ったら"]
    assert (new[0].start_ms, new[0].end_ms, new[1].start_ms, new[2].end_ms) == (0, 1000, 1000, 5000) and new[1].end_ms == new[2].start_ms and 2000 < new[1].end_ms < 5000
    assert new[1].source_segments == [2, 3] and new[1].source_units == [2, 3]


def test_resegmentation_by_source_times(spark):
    """The second segment has a pause before it; the selected text begins within the first."""
    seen = spark.createDataFrame([(1, 7, "あいうえ", 0, 400), (1, 8, "", 400, 500), (1, 9, "かきくけこ", 2000, 2500)], "video_id long, n long, text string, start_ms long, end_ms long")
    own = spark.createDataFrame([(1, 1, "あ", 0, 50, [1], [5]), (1, 2, "うえ。かき", 100, 3000, [2], [7, 8, 9]), (1, 3, "くけこ", 3000, 4000, [3], [9])], SOURCED)
    edit = spark.createDataFrame([(1, 1, [2, 3], "うえか。きくけこ")], EDIT)
    new = N.resegment_sentences(own, edit, seen)[0].orderBy("n").collect()
    assert [(r.text, r.start_ms, r.end_ms, r.source_segments, r.source_units) for r in new[1:]] == [("うえか。", 200, 2100, [7, 9], [2, 3]), ("きくけこ", 2100, 2500, [9], [2, 3])]
    # a segment that is unknown, or a text that does not stand there: the sentences' own times
    for other in (seen.where("n <> 9"), seen.withColumn("text", F.lit("x"))):
        assert [r.start_ms for r in N.resegment_sentences(own, edit, other)[0].orderBy("n").collect()][1:] == [r.start_ms for r in N.resegment_sentences(own, edit)[0].orderBy("n").collect()][1:]
    changed = spark.createDataFrame([(1, 1, [2], "べつ。")], EDIT)
    got = N.resegment_sentences(own, changed, seen)[0].where("n = 2").first()
    assert (got.start_ms, got.end_ms, got.source_segments) == (100, 3000, [7, 8, 9])


def test_default_ratio_looks_up_rare_characters_only():
    """Equal to difflib's with its rule for frequent characters; a long pair took difflib a walk over all characters for each block."""
    import random
    import time
    from difflib import SequenceMatcher

    from tempotext.functions.similarity import default_ratio

    random.seed(8)
    for t in range(600):
        signs = "abcdefgh]^-\\\n'éXYZ0123456789"[: 4 + t % 26]
        a = "".join(random.choices(signs, [3 ** (12 - k // 2) for k in range(len(signs))] if t % 3 else None, k=random.choice((0, 5, 150, 199, 260, 500))))
        b = "".join(random.choice((x, x, x, x, "c", "")) for x in a) if t % 2 else "".join(random.choices(signs, k=random.choice((0, 180, 200, 330))))
        assert default_ratio(a, b) == SequenceMatcher(None, a, b).ratio()
    words = ["".join(random.choices("etaoinshr", k=5)) for _ in range(300)] + ["Quiz", "Jazz", "Vexed"]
    a = " ".join(random.choices(words, k=3000))
    b = a.replace("e", "c")
    took = []
    for f in (default_ratio, lambda x, y: SequenceMatcher(None, x, y).ratio()):
        began = time.process_time()
        took.append((f(a, b), time.process_time() - began))
    assert took[0][0] == took[1][0] and took[0][1] < took[1][1] / 2


def test_conflict_keys_are_made_once(spark):
    """Filters pushed through a projection made both keys anew for each of their tests, for equal texts too."""
    rows = [(1, "abcdefgh", "abcdefgh"), (2, "abcdefgh", "abcdefgx"), (3, None, "abcdefgh"), (4, "abcdefgh", None), (5, "abc defgh", "abcdefgh")]
    got = R.reference_conflict(spark.createDataFrame(rows, "n long, text string, reference string").repartition(2), "n")
    assert {r.n: r.conflict for r in got.collect()} == {1: False, 2: True, 3: False, 4: False, 5: False}
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    assert not [x for x in plan if "Filter" in x and "regexp_replace" in x] and [x for x in plan if "Filter" in x and "NOT (text" in x]
