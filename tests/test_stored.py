"""Tables that are stored and merged: snapshots, the incremental library, stage files, what lies beside a transcript."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tempotext.operators import library as L, reuse as R
from tempotext.sources import snapshots
from tempotext.streaming import replay as Z

ROW = "video_id long, n long, text string"
SAVE = "save_id long, kind string, lemma string, surface string, reading string, meaning string, context_key string, sentence string"


def rows(spark, text, videos=range(12)):
    return spark.createDataFrame([(v, n, text) for v in videos for n in range(3)], ROW)


def test_readers_see_one_state(spark, tmp_path):
    path, first = str(tmp_path / "t"), rows(spark, "0")
    assert R.load_stage(spark, path, first.schema).count() == 0
    R.write_stage(first, path, first.schema, 4)
    before, seen, stop = R.load_stage(spark, path, first.schema), [], threading.Event()

    def read():
        while not stop.is_set():
            seen.append(tuple(sorted(r.text for r in R.load_stage(spark, path, first.schema).collect())))

    reader = threading.Thread(target=read)
    reader.start()
    for k in (1, 2):
        R.write_stage(rows(spark, str(k)), path, first.schema, 4)
    stop.set()
    reader.join()
    assert set(seen) <= {(str(k),) * 36 for k in range(3)}
    assert {r.text for r in before.collect()} == {"0"}  # a loaded table keeps its state
    assert {r.text for r in R.load_stage(spark, path, first.schema).collect()} == {"2"}


def test_failed_write_changes_nothing(spark, tmp_path):
    path, first = str(tmp_path / "t"), rows(spark, "0")
    R.write_stage(first, path, first.schema, 4)
    fails = first.withColumn("text", F.when(F.col("n") == 2, F.raise_error(F.lit("lost"))).otherwise("1"))
    with pytest.raises(Exception, match="lost"):
        R.write_stage(fails, path, first.schema, 4)
    assert {r.text for r in R.load_stage(spark, path, first.schema).collect()} == {"0"}
    # Files without a version are those of a writer that stopped before its end.
    fake = rows(spark, "9").withColumn("bucket", F.lit(0))
    fake.write.partitionBy("bucket").parquet(f"{path}/data/stopped")
    assert snapshots.state(spark, path)[0] == 1 and R.load_stage(spark, path, first.schema).count() == 36
    R.write_stage(first.limit(0), path, first.schema, 4)
    assert snapshots.state(spark, path)[0] == 1


def saves(spark, ids):
    out = [(i, ("word", "grammar", "slang")[i % 11 == 3 and 2 or i % 2], f"L{i % 9}", ("漢" if i % 4 == 1 else "") + f"s{i % 5}", "", f" m{i % 3}", f"c{i % 13}" if i % 17 else "", f"x{i}") for i in ids]
    return spark.createDataFrame(out, SAVE)


def shown(tables):
    return {k: sorted((tuple(sorted(r.asDict().items(), key=lambda x: x[0])) for r in t.collect()), key=str) for k, t in tables.items()}


def test_batches_equal_one(spark, tmp_path):
    ids, path = list(range(200)), str(tmp_path / "lib")
    want = L.library_tables(saves(spark, ids).withColumn("sentence", F.col("sentence")))
    for batch in (ids[120:], ids[:70], ids[60:130], ids[:70]):
        L.merge_library(saves(spark, batch), path, 8)
    got = L.stored_tables(L.load_library(spark, path))
    same = {k: got[k].select(*t.columns) for k, t in want.items()}
    assert shown(same) == shown(want)
    L.merge_library(saves(spark, [3, 14]), path, 8)  # an unknown kind, and one it holds
    assert shown({k: L.stored_tables(L.load_library(spark, path))[k].select(*t.columns) for k, t in want.items()}) == shown(want)


def test_batch_touches_its_buckets_only(spark, tmp_path):
    path = str(tmp_path / "lib")
    L.merge_library(saves(spark, range(200)), path, 16)
    before = snapshots.state(spark, path)[1]
    L.merge_library(saves(spark, [900]), path, 16)
    after = snapshots.state(spark, path)[1]
    assert sum(before[b] != after[b] for b in after) == 1 and before.keys() == after.keys()
    L.merge_library(saves(spark, []), path, 16)
    assert snapshots.state(spark, path)[1] == after


def test_stream_of_saves(spark, tmp_path):
    for part in (range(50, 100), range(50), range(100, 140)):
        saves(spark, part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(saves(spark, [0]).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = L.stored_tables(Z.stream_upsert_library(stream, str(tmp_path / "lib"), str(tmp_path / "state"), 4))
    want = L.library_tables(saves(spark, range(140)))
    assert shown({k: got[k].select(*t.columns) for k, t in want.items()}) == shown(want)


def test_stage_lines(spark):
    schema = StructType([StructField("n", LongType()), StructField("text", StringType())])
    ok = lambda n, t: f'{{"n": {n}, "text": "{t}"}}'
    lines = [
        (1, "raw", ok(1, "a")), (1, "corrected", ok(1, "b")), (2, "raw", ok(1, "a")), (3, "raw", ok(1, "a")), (3, "corrected", "{broken"), (4, "raw", ok(1, "a")), (4, "raw", '{"n": "x", "text": "a"}'),
        (5, "raw", ok(1, "a")), (5, "corrected", ok(1, "b")), (5, "corrected", '{"text": "no n"}'), (6, "raw", None), (7, "raw", ""), (8, "corrected", "[1]"),
    ]
    df = spark.createDataFrame(lines, "video_id long, stage string, value string")
    rows_of = lambda fall_back: {(r.video_id, r.n, r.text) for r in R.read_stage_lines(df, schema, fall_back)[0].collect()}
    assert rows_of(False) == {(1, 1, "b"), (2, 1, "a")}
    assert rows_of(True) == {(1, 1, "b"), (2, 1, "a"), (3, 1, "a"), (5, 1, "a")}
    assert sorted((r.video_id, r.stage) for r in R.read_stage_lines(df, schema)[1].collect()) == [(3, "corrected"), (4, "raw"), (5, "corrected"), (6, "raw"), (7, "raw"), (8, "corrected")]


def test_beside_transcripts(spark, tmp_path):
    for name in ("a.md", "a.m4a", "a（整理版）.md", "b.md", "b综合校正版.md"):
        (tmp_path / name).write_text("x", encoding="utf-8")
    s = spark.createDataFrame([("a.md", "w/2"), ("a.md", "w/1"), ("z.md", "w/3")], "source_name string, path string")
    got = {r.stem.rsplit("/", 1)[1]: r for r in R.discover_transcripts(R.list_files(spark, str(tmp_path)), sentences=s).collect()}
    a, b = got["a"], got["b"]
    assert len(got) == 2 and a.audio.endswith("a.m4a") and a.sentences == "w/1" and a.title == "a" and (b.audio, b.organized, b.sentences) == (None, None, None)
    assert a.organized is not None


def test_audio_beside_the_chosen_file_comes_first(spark):
    u = "https://youtu.be/abcdefghijk"
    r = spark.createDataFrame([(1, u), (2, "other")], "request_id long, source_url string")
    h = spark.createDataFrame([(u, "raw", "o/r.md", 1), (u, "audio", "o/old.m4a", 1)], "source_url string, kind string, path string, at long")
    t, c = spark.createDataFrame([], "path string, source_url string"), spark.createDataFrame([], "source_url string, pipeline_revision int")
    for files, want in (["o/r.m4a", "o/x.m4a"], "o/r.m4a"), (["o/x.m4a", "o/r.txt"], "o/old.m4a"):
        got = {x.request_id: (x.path, x.audio) for x in R.find_reusable(r, h, t, c, 1, spark.createDataFrame([(f,) for f in files], "path string")).collect()}
        assert got == {1: ("o/r.md", want), 2: (None, None)}


@pytest.mark.parametrize("form_bytes", [1 << 20, 12])
def test_context_equals_plain_search(spark, form_bytes):
    """With one automaton and with many: entries whose forms a sentence holds first, then by encounters and last change."""
    s = saves(spark, range(150))
    texts = ["l3 s2 今", "", None, "漢S1と漢s0", "nothing", "L1L2L3l4"]
    got = L.library_context(spark.createDataFrame([(1, n, t) for n, t in enumerate(texts)], ROW), s, 6, 4, form_bytes).collect()
    top = [r.entry_key for r in L.top_library_entries(s, 6).orderBy(F.desc("encounters"), F.desc("updated"), "entry_key").collect()]
    forms = {}
    for r in L.accepted(s).collect():
        forms.setdefault(r.entry_key, set()).update({r.form_key, r.lemma.casefold()})
    for r in got:
        t = (texts[r.n] or "").casefold().replace(" ", "")
        hit = [e for e in top if any(f in t for f in forms[e])]
        assert (r.matches, r.entries) == (min(len(hit), 4), (hit + [e for e in top if e not in hit])[:4])


def test_context_of_an_empty_library(spark):
    got = L.library_context(spark.createDataFrame([(1, 0, "x")], ROW), saves(spark, [])).collect()
    assert [(r.matches, r.entries) for r in got] == [(0, [])]
