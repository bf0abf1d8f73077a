"""Checks of rows, counts, whole transcript files, usage, library tables."""

from tempotext.operators import corrections as K, documents as D, library as L, segments as G

SEG = "video_id long, n long, start_ms long, end_ms long, text string, source string, needs_review boolean"


def test_check_rows(spark):
    rows = [(1, 1, 0, 5, "漢字", "漢字", "", "word", 0.0, 0.65, 1.0, 0.35), (1, 2, 0, 5, "かな", "かな", None, "word", 0.5, 0.0, 0.5, 1.0), (1, 3, 5, 0, "漢字", "x", "かんじ", "noun", 0.6, 0.0, 0.5, 1.0), (1, 4, None, 5, None, None, None, None, None, 0.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "video_id long, n long, start_ms long, end_ms long, expression string, lemma string, reading string, kind string, x double, y double, width double, height double")
    got = {r.n: r.reasons for r in K.check_rows(df).collect()}
    assert got == {1: "reading", 3: "end before start; kind; region", 4: "negative time; end before start; kind; region"}
    assert K.check_rows(df.limit(0)).count() == 0


def test_run_summary(spark):
    seg = spark.createDataFrame([(1, 1, 0, 5, "a", "screen_annotation", True), (1, 2, 0, 5, "b", None, None)], SEG)
    applied = spark.createDataFrame([(1, 1, "changed"), (1, 2, "kept"), (2, 1, "rejected"), (None, 1, "kept")], "video_id long, n long, outcome string")
    none = seg.limit(0)
    got = {r.video_id: r.asDict() for r in K.run_summary(applied, seg, seg, none, none).collect()}
    assert got[1] == {"video_id": 1, "observations": 2, "segments": 2, "spoken": 1, "annotations": 1, "unresolved": 1, "changed": 1, "rejected": 0, "sentences": 0, "reused_chunks": 0}
    assert got[2]["rejected"] == 1 and len(got) == 2


def test_transcript_files(spark):
    videos = spark.createDataFrame([(1, 'say "hi"', "u", "m", "ja"), (2, None, None, None, None)], "video_id long, title string, source_url string, model string, language string")
    segments = spark.createDataFrame([(1, 1, 0, 1000, "a\nb", "youtube_primary", False), (1, 2, 500, 1500, "c", "screen_annotation", True)], SEG)
    got = {r.video_id: r.body for r in D.transcript_files(videos, segments).collect()}
    assert got[1].startswith('---\ntitle: "say \\"hi\\""\nvideo_id: "1"\nsource_url: "u"\nsubtitle_source: "youtube_primary+burned_ocr_visual_verification"\n')
    assert got[1].endswith('segments: 2\n---\n\n# say "hi"\n\n- [00:00.000–00:01.000] a<br>b\n- [00:00.500–00:01.500] 【画面补充】c ⚠️\n')
    assert got[2].endswith(f'subtitle_source: "burned_ocr"\nocr_backend: "cloud_vlm"\nocr_model: ""\nlanguage: ""\nsegments: 0\n---\n\n# \n\n{D.PLACEHOLDER}\n')


def test_usage(spark):
    rows = [("s", 2, False, {"tokens": "3", "model": "b"}), ("s", 1, True, {"tokens": "4.5", "model": "a", "none": None}), ("t", 1, None, None)]
    got = {(r.stage, r.key): (r.total, r.first_value) for r in L.usage_rollup(spark.createDataFrame(rows, "stage string, ord long, repair boolean, usage map<string,string>")).collect()}
    assert got[("s", "tokens")] == (7.5, None) and got[("s", "model")] == (None, "a") and got[("s", "calls")] == (2.0, None) and got[("s", "repairs")] == (1.0, None)
    assert ("s", "none") not in got


def test_library_tables(spark):
    rows = [(1, "word", "たべる", "たべる", "", "eat", "c1", "s1"), (2, "word", "たべる", "食べる", "", "Eat", "c1", "s2"), (3, "word", "たべる", "食べる", "", "eat", "c1", "s3"), (4, "word", "たべる", "食べる", "", "dine", "c2", "s4")]
    t = L.library_tables(spark.createDataFrame(rows, "save_id long, kind string, lemma string, surface string, reading string, meaning string, context_key string, sentence string"))
    assert [(r.display, r.created, r.updated) for r in t["entries"].collect()] == [("食べる", 1, 4)]
    assert sorted((r.save_id, r.surface) for r in t["forms"].collect()) == [(1, "たべる"), (2, "食べる")]
    assert sorted((r.save_id, r.meaning, r.sentence) for r in t["meanings"].collect()) == [(1, "eat", "s1"), (4, "dine", "s4")]
    assert sorted((r.save_id, r.context_key) for r in t["encounters"].collect()) == [(1, "c1"), (4, "c2")]


def test_sources_of_windows(spark):
    s = spark.createDataFrame([(1, 1, 0, 900, "a"), (1, 2, 21000, 22000, "b"), (1, 3, 50000, 51000, "c")], "video_id long, n long, start_ms long, end_ms long, text string")
    d = spark.createDataFrame([(1, 0, "spoken", [1, 2]), (1, 1, "annotation", [2, 2]), (1, 2, "spoken", [1])], "video_id long, window_index long, kind string, ocr_ids array<long>")
    assert {r.window_index: r.valid for r in D.validate_window_sources(d, s).collect()} == {0: True, 1: False, 2: False}


def test_models_and_batches(spark):
    o = spark.createDataFrame([(1, 1, 5, "m"), (1, 1, 6, "m"), (2, 1, 5, "old"), (2, 2, 5, "m"), (3, 1, 5, None)], "video_id long, frame_index long, ts_ms long, model string")
    assert [(r.video_id, r.ts_ms) for r in G.dedupe_observations(o, o, "m").collect()] == [(1, 6)]
    pending = spark.createDataFrame([(1, i) for i in range(3)] + [(2, 0)], "video_id long, frame_index long")
    saved = spark.createDataFrame([(1, 4), (1, 2)], "video_id long, batch long")
    assert sorted((r.video_id, r.frame_index, r.batch) for r in G.assign_batches(pending, 2, saved).collect()) == [(1, 0, 5), (1, 1, 5), (1, 2, 6), (2, 0, 0)]
