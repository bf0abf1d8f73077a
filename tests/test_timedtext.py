"""Golden cases of the timed-text operators, and every query with SQL against DuckDB on the smallest data."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tempotext.functions import similarity as S, text as T
from tempotext.operators import cues as C, documents as D, segments as G
from tempotext.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OBS = "video_id long, ts_ms long, frame_index long, text string, confidence double"


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_majority_text(spark):
    a, b = "今日は学校に行きます", "今日は学枝に行きます"
    rows = [(1, 0, 0, "", 0.0), (1, 500, 1, a, 0.9), (1, 1000, 2, b, 0.6), (1, 1500, 3, a, 0.9), (1, 2000, 4, "", 0.0)]
    got = G.segment_observations(spark.createDataFrame(rows, OBS), 3000, 500, 80).collect()
    assert [(r.text, r.start_ms, r.end_ms, r.observation_count, r.needs_review) for r in got] == [(a, 500, 2000, 3, False)]


def test_distinct_texts_and_islands(spark):
    rows = [(1, 0, 0, "hello", 1.0), (1, 1000, 1, "goodbye", 1.0), (2, 0, 0, "hello", 1.0), (2, 500, 1, "", 1.0), (2, 900, 2, "hello", 1.0)]
    got = G.segment_observations(spark.createDataFrame(rows, OBS), 2000, 100, 85).orderBy("video_id", "start_ms").collect()
    assert [(r.video_id, r.text, r.start_ms, r.end_ms) for r in got] == [(1, "hello", 0, 1000), (1, "goodbye", 1000, 2000), (2, "hello", 0, 500), (2, "hello", 900, 2000)]


def test_rolling_overlap(spark):
    rows = [(1, 0, 0, "上京してそれ以降は", 0.9), (1, 500, 1, "それ以降はずっと非正規雇用で働いています", 0.9)]
    s = G.segment_observations(spark.createDataFrame(rows, OBS), 1000, 500)
    assert [r.text for r in G.merge_adjacent_segments(s, 500).collect()] == ["上京してそれ以降はずっと非正規雇用で働いています"]


def test_scalars(spark):
    assert one(spark, T.sanitize_filename(F.lit(' A/B: "test" '))) == "A_B_ _test_"
    assert one(spark, T.sanitize_filename(F.lit("..."))) == "untitled"
    assert one(spark, T.format_timestamp(F.lit(65432))) == "01:05.432"
    assert one(spark, T.format_timestamp(F.lit(3665432))) == "01:01:05.432"
    assert one(spark, T.parse_timestamp(F.lit("01:01:05.432"))) == 3665432
    assert one(spark, T.term_key(F.lit(" Straße Ａ"))) == "strassea"
    assert one(spark, T.visible_text(F.lit("a<br>b &amp; <i>c</i>"))) == "a\nb & c"


@pytest.mark.parametrize("old,new,ok", [("フリーダー", "フリーター", True), ("ですさっき病院に行ったら", "です", False), ("海外に行くって言ったら寂", "海外に行くって言ったら褒めてくれるんだろうね", False)])
def test_safe_correction(spark, old, new, ok):
    assert one(spark, S.safe_correction(F.lit(old), F.lit(new))) is ok


def test_indel_ratio():
    assert S.ratio("", "") == 100 and S.ratio("abc", "abc") == 100 and S.ratio("abcd", "bcde") == 75


def test_merge_cues(spark):
    rows = [("v", 1, 1000, 1900, "病院に"), ("v", 2, 1900, 2700, "病院に"), ("v", 3, 2800, 3500, "行きました")]
    got = C.merge_cues(spark.createDataFrame(rows, "video_id string, n long, start_ms long, end_ms long, text string")).orderBy("cue_id").collect()
    assert [(r.cue_id, r.start_ms, r.end_ms) for r in got] == [("yt000001", 1000, 2700), ("yt000002", 2800, 3500)]


def test_caption_files(spark):
    event = '{"tStartMs": %d, "dDurationMs": %d, "segs": [{"utf8": "%s"}]}'
    json3 = '{"events": [{"tStartMs": 0}, ' + ", ".join(event % x for x in [(1000, 900, "病院に"), (1900, 800, "病院に"), (2800, 700, "行きました")]) + "]}"
    vtt = "WEBVTT\n\n1\n00:01.000 --> 00:01.900 align:start\n<c>病院に</c>\n\n00:00:01.900 --> 00:00:02.700\n病院に\n\n00:02.800 --> 00:03.500\n行き\nました\n"
    df = spark.createDataFrame([("v", json3, vtt), ("w", None, None), ("x", "", "")], "video_id string, json3 string, vtt string")
    for got, last in ((D.read_json3_captions(df), "行きました"), (D.read_vtt_captions(df), "行き ました")):
        assert [(r.video_id, r.start_ms, r.end_ms, r.text) for r in got.orderBy("cue_id").collect()] == [("v", 1000, 2700, "病院に"), ("v", 2800, 3500, last)]


def test_timed_transcript(spark):
    body = "# x\n- [00:00.000–00:01.000] 今日は\n- [00:01.000-00:02.000] 学校へ<br>行きます。 ⚠️\n- [00:02.000–00:03.000]  \n* [00:03.000—00:04.000] a &amp; b"
    got = D.read_timed_transcript(spark.createDataFrame([("v", body), ("w", None)], "video_id string, body string")).orderBy("id").collect()
    assert [(r.id, r.text, r.start_ms) for r in got] == [("seg000001", "今日は", 0), ("seg000002", "学校へ行きます。", 1000), ("seg000003", "a & b", 3000)]


def test_caption_choice(spark):
    rows = [("v", "manual", "en", "json3", "u", 0), ("v", "automatic", "en", "json3", "u", 1), ("v", "automatic", "ja", "vtt", "u", 2), ("v", "automatic", "ja", "json3", "u", 3), ("w", "manual", "ja", "vtt", None, 0)]
    got = D.select_caption_track(spark.createDataFrame(rows, "video_id string, kind string, language string, ext string, url string, pos long"), ["ja"]).collect()
    assert [(r.kind, r.language, r.ext) for r in got] == [("automatic", "ja", "json3")]


def test_coverage(spark):
    cue = spark.createDataFrame([("v", 1, 1000, 2000, "お昼も一人で食べています")], "video_id string, n long, start_ms long, end_ms long, text string")
    other = cue.withColumns({"text": F.lit("前の字幕")})
    same = cue.withColumns({"start_ms": F.lit(900).cast("long"), "end_ms": F.lit(2100).cast("long"), "text": F.lit("お昼も1人で食べています")})
    assert C.uncovered_cues(cue, other).count() == 1 and C.uncovered_cues(cue, same).count() == 0
    assert C.uncovered_cues(cue.withColumn("text", F.lit("…")), same.withColumn("text", F.lit("…"))).count() == 1  # empty keys support nothing
    assert [(r.start_ms, r.end_ms) for r in C.merge_intervals(C.uncovered_cues(cue, other)).collect()] == [(1000, 2000)]


def test_normalised_segments(spark):
    rows = [(1, 0, 0, "ＡＢＣ　今日", 0.9), (1, 500, 1, "ABC 今日", 0.9), (1, 1000, 2, "\u00a0 \n", 0.0), (1, 1500, 3, None, 0.0), (1, 2000, 4, "ABC今日", 0.9)]
    got = G.segment_observations(spark.createDataFrame(rows, OBS), 3000, 500).orderBy("start_ms").collect()
    assert [(r.text, r.start_ms, r.end_ms, r.observation_count) for r in got] == [("ABC 今日", 0, 1000, 2), ("ABC今日", 2000, 3000, 1)]
    assert [r.text for r in G.merge_adjacent_segments(spark.createDataFrame([(1, 0, 500, "ＡＢＣ今日", 0.9, 1, ["x"], False), (1, 600, 900, "ABC今日", 0.9, 1, ["y"], False)], "video_id long, start_ms long, end_ms long, text string, confidence double, observation_count long, alternatives array<string>, needs_review boolean"), 500).collect()] == ["ABC今日"]


def test_units(spark):
    cut = lambda x: one(spark, T.split_terminal_units(F.lit(x)))
    assert cut("!b c. d.e...f. 今日は 学校へ。！行く") == ["!b c.", "d.e...f.", "今日は", "学校へ。！", "行く"]
    assert len(cut("a.b" * 40000 + ". c")) == 2 and cut("") == [] and cut(" . ") == ["."]


def test_coverage_equals_brute_force(spark):
    import random
    import re
    from difflib import SequenceMatcher

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(6)) for _ in range(12)]
    mixed = lambda t: " ".join(w if rng.random() < 0.6 else word() for w in t.split())
    cues = [(1, n, 700 * n, 700 * n + rng.randrange(3000), mixed(rng.choice(texts))) for n in range(80)]
    segs = [(1, n, s, s + rng.randrange(90000 if n == 0 else 2500), mixed(rng.choice(texts)) if n % 9 else "  ") for n in range(60) for s in [rng.randrange(58000)]]
    key = lambda x: re.sub(r"[\s\W_]+", "", x).lower()

    def supports(a, b):
        a, b = key(a), key(b)
        small, large = sorted((a, b), key=len)
        return bool(a and b) and (len(small) >= 4 and small in large and len(small) / len(large) >= 0.3 or SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.46)

    want = {c[1] for c in cues if not any(s[3] >= c[2] - 700 and s[2] <= c[3] + 700 and supports(c[4], s[4]) for s in segs)}
    shape = "video_id long, n long, start_ms long, end_ms long, text string"
    a, b = spark.createDataFrame(cues, shape), spark.createDataFrame(segs, shape)
    assert {r.n for r in C.uncovered_cues(a, b).collect()} == want and 0 < len(want) < 80
    near = {r.n: r.reference for r in C.align_references(a, b).collect()}
    assert all(set(near[c[1]]) == {s[4] for s in segs if s[3] >= max(0, c[2] - 650) and s[2] <= c[3] + 650} for c in cues)


def test_nearest_frame_and_sentence_at_time(spark):
    import random

    rng = random.Random(4)
    frames = sorted({(v, rng.randrange(200_000)) for v in (1, 2) for _ in range(60)})
    points = [(v, rng.randrange(-500, 260_000)) for v in (1, 2, 3) for _ in range(200)] + [(1, frames[5][1])]
    f = spark.createDataFrame([(v, i, t) for i, (v, t) in enumerate(frames)], "video_id long, frame_index long, ts_ms long")
    p = spark.createDataFrame(points, "video_id long, t long")
    got = {(r.video_id, r.t): r.frame_index for r in C.nearest_frame(p, f).collect()}
    for v, t in points:
        own = [(abs(x - max(0, t)), x, i) for i, (w, x) in enumerate(frames) if w == v]
        assert got[v, t] == (min(own)[2] if own else None)
    s = [(v, n, x, x + rng.randrange(40_000)) for v in (1, 2) for n, x in enumerate(sorted(rng.randrange(200_000) for _ in range(50)))]
    held = {(r.video_id, r.t): r.n for r in C.sentence_at_time(p, spark.createDataFrame(s, "video_id long, n long, start_ms long, end_ms long")).collect()}
    for v, t in points:
        own = [x for x in s if x[0] == v and x[2] <= t]
        assert held[v, t] == min([x[1] for x in own if t < x[3]], default=max([x[1] for x in own], default=None))


def test_align_and_ratios_equal_brute_force(spark):
    import random

    rng = random.Random(6)
    pairs = [("".join(rng.choice("abcde ") for _ in range(rng.choice([0, 3, 40, 900]))),) * 2 for _ in range(12)]
    pairs = [(a, "".join(c for c in b if rng.random() > 0.1)) for a, b in pairs]

    def lcs(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = row[:]
            for j, y in enumerate(b):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        return row[-1]

    from difflib import SequenceMatcher

    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i long, a string, b string")
    for r in df.select("i", S.indel_ratio("a", "b").alias("x"), S.align_characters("a", "b").alias("y"), S.default_matcher_ratio("a", "b").alias("z")).collect():
        a, b = pairs[r.i]
        assert abs(r.x - (200 * lcs(a, b) / (len(a) + len(b)) if a or b else 100)) < 1e-9 and abs(r.z - SequenceMatcher(None, a, b).ratio()) < 1e-12
        assert [(p.a_index, p.b_index) for p in r.y] == [(m.a + k, m.b + k) for m in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks() for k in range(m.size)]


def norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cur = duck.execute(registry.SQL[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    want = sorted((tuple(norm(x) for x in r) for r in cur.fetchall()), key=repr)
    assert sorted((tuple(norm(r[c]) for c in names) for r in df.collect()), key=repr) == want


def test_stream_equals_batch(spark, tmp_path):
    from tempotext.streaming.replay import replay, stream_windows

    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(1).write.parquet(str(tmp_path / "in"))
    got = replay(stream_windows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="0 seconds"), str(tmp_path / "out"), str(tmp_path / "cp"))
    want = {(r.start_s, r.event_type, r.n) for r in stream_windows(events).collect()}
    rows = {(r.start_s, r.event_type, r.n) for r in got.collect()}
    last = max(s for s, _, _ in want)
    assert rows <= want and {x for x in want if x[0] < last - 20} <= rows
