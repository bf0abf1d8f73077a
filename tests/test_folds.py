"""Folds in parts against one plain fold of the whole video, on noisy texts."""

import random

import pytest

from tempotext.operators import folds, segments as G

OBS = "video_id long, ts_ms long, frame_index long, text string, confidence double"
COLUMNS = ("start_ms", "end_ms", "text", "observation_count", "alternatives")


def noisy(seed, n, blanks, drift):
    """A video's texts: each caption stays for some frames with wrong characters; with ``drift`` it changes a little at a time instead."""
    r = random.Random(seed)
    letters = "あいうえおかきくけこさしすせそ"
    base, left, out = "", 0, []
    for _ in range(n):
        if left == 0:
            base, left = "".join(r.choices(letters, k=r.randint(5, 14))), r.randint(1, 9)
        if drift and r.random() < 0.5:
            i = r.randrange(len(base))
            base = base[:i] + r.choice(letters) + base[i + 1 :]
        left -= 0 if drift and r.random() < 0.8 else 1
        x = base
        if r.random() < 0.3:
            i = r.randrange(len(x))
            x = x[:i] + r.choice(letters) + x[i + 1 :]
        out.append("" if r.random() < blanks else x)
    return out


def plain_ranked(own):
    """As the reference ranks an open segment's observations, with nothing remembered."""
    texts = list(dict.fromkeys(t for t, _ in own))
    support = {t: sum(G.alike(*sorted((t, u)), G.CLUSTER) for u, _ in own) for t in texts}
    return sorted(texts, key=lambda t: (support[t], len(t), sum(u == t for u, _ in own), sum(c for u, c in own if u == t)), reverse=True)


def plain_segments(rows, duration, interval):
    out, own, start = [], [], 0

    def finish(end):
        if own:
            ranked = plain_ranked(own)
            out.append((start, min(duration, max(start + interval, end)), ranked[0], len(own), ranked[1:4]))
            own.clear()

    for ts, text, c in rows:
        if text and own and not G.alike(plain_ranked(own)[0], text, G.SIMILAR):
            finish(ts)
        if not text:
            finish(ts)
        else:
            start = start if own else ts
            own.append((text, c))
    finish(duration)
    return out


@pytest.mark.parametrize("blanks,drift", [(0.0, False), (0.0, True), (0.05, True)])
def test_parts_equal_the_whole(spark, blanks, drift):
    n, rows, want = 240, [], {}
    for v in range(4):
        own = [(100 * i, t, 0.25 + 0.5 * (i % 2)) for i, t in enumerate(noisy(v + 10 * drift, n, blanks, drift))]
        rows += [(v, ts, ts // 100, t, c) for ts, t, c in own]
        want[v] = plain_segments(own, 100 * n, 50)
    df = spark.createDataFrame(rows, OBS)
    got = {}
    for r in G.segment_observations(df, 100 * n, 50, part_rows=8).orderBy("video_id", "start_ms").collect():
        got.setdefault(r.video_id, []).append(tuple(r[c] for c in COLUMNS))
    assert got == want
    whole = G.segment_observations(df, 100 * n, 50, part_rows=10**6)
    show = lambda d: sorted(map(tuple, ((r.video_id, r.start_ms, r.end_ms, r.text, round(r.confidence, 9), r.observation_count, tuple(r.alternatives)) for r in d.collect())))
    assert show(G.merge_adjacent_segments(whole, 500, part_rows=8)) == show(G.merge_adjacent_segments(whole, 500, part_rows=10**6))


def test_parts_that_never_agree_become_one(spark):
    """Two texts in turn, alike all along: one segment over all parts; the next video starts with a part of its own."""
    rows = [(v, i, i, "今日は学校に行きます" if i % 3 else "今日は学枝に行きます", 0.9) for v in (1, 2) for i in range(100)]
    got = G.segment_observations(spark.createDataFrame(rows, OBS), 1000, 1, part_rows=4).orderBy("video_id").collect()
    assert [(r.video_id, r.start_ms, r.end_ms, r.text, r.observation_count) for r in got] == [(v, 0, 1000, "今日は学校に行きます", 100) for v in (1, 2)]


def test_cuts_of_a_video_without_blanks(spark):
    rows = [(1, i, i, t, 0.9) for i, t in enumerate(noisy(3, 400, 0.0, False))]
    df = spark.createDataFrame(rows, OBS).selectExpr("video_id", "ts_ms", "text", "ts_ms = 0 as sure")
    sizes = [r["count"] for r in folds.cut(df, ["ts_ms"], 40).groupBy("part").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 80
    static = spark.createDataFrame([(1, i, "x", i == 0) for i in range(50)], "video_id long, ts_ms long, text string, sure boolean")
    assert folds.cut(static, ["ts_ms"], 10).select("part").distinct().count() == 1


def test_empty_and_null(spark):
    assert G.segment_observations(spark.createDataFrame([], OBS), 100, 10).count() == 0
    got = G.segment_observations(spark.createDataFrame([(1, 0, 0, None, None), (1, 10, 1, "あ", None)], OBS), 100, 10).collect()
    assert [(r.start_ms, r.end_ms, r.text, r.confidence, r.needs_review) for r in got] == [(10, 100, "あ", 0.0, True)]
    m = spark.createDataFrame([(1, 0, 5, None, 0.5, 1, None, True)], "video_id long, start_ms long, end_ms long, text string, confidence double, observation_count long, alternatives array<string>, needs_review boolean")
    assert [(r.text, r.alternatives) for r in G.merge_adjacent_segments(m, 10).collect()] == [("", [])]


def test_evidence_against_a_plain_search_without_joining_all_that_a_segment_holds(spark):
    """Many observations in each segment, segments of one start, empty ones and blanks."""
    import random

    from pyspark.sql import functions as F

    from tempotext.operators import segments as G

    rng = random.Random(8)
    obs = [(v, f, rng.randint(0, 90_000), rng.choice(["", " ", "a", "b"])) for v in range(3) for f in range(150)]
    segs = [(v, s, s + rng.choice([0, 5, 2_000, 60_000])) for v in range(4) for s in [rng.randint(0, 99_000) for _ in range(20)] for _ in range(rng.choice([1, 1, 2, 3]))]
    want = []
    for v, s in sorted({(v, s) for v, s, _ in segs}):
        hits = sorted((t, f) for w, x, e in segs if (w, x) == (v, s) for u, f, t, text in obs if u == v and text.strip() and s <= t <= e)
        want += [(v, s, hits[k][1], hits[k][0]) for k in {0, len(hits) // 2, len(hits) - 1} if hits]
    o = spark.createDataFrame(obs, "video_id long, frame_index long, ts_ms long, text string")
    got = G.segment_evidence(spark.createDataFrame(segs, "video_id long, start_ms long, end_ms long"), o)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    # A span of a year is no row for each of its time bins, nor one for each observation it holds.
    plan = G.segment_evidence(o.select("video_id", F.col("ts_ms").alias("start_ms"), F.lit(1 << 40).alias("end_ms")), o)._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(" not in plan
