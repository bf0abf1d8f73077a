"""Jobs with a user's function, cuts from a reference, matching blocks."""

import random
import time
from difflib import SequenceMatcher

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tempotext.functions import blocks as B
from tempotext.operators import engines as E

SEG = "video_id long, n long, start_ms long, end_ms long, text string"


def test_matching_blocks(monkeypatch):
    monkeypatch.setattr(B, "PRODUCT", 0)
    random.seed(3)
    for t in range(300):
        a = "".join(random.choice("abcd"[: 2 + t % 3]) for _ in range(random.randint(0, 40)))
        b = "".join(random.choice("abcd"[: 2 + t % 3]) for _ in range(random.randint(0, 40))) if t % 2 else "".join(x if random.random() > 0.2 else "y" for x in a)
        m = SequenceMatcher(None, a, b, autojunk=False)
        assert B.matching(a, b) == [(x.a, x.b, x.size) for x in m.get_matching_blocks() if x.size] and B.matched_ratio(a, b) == m.ratio()


@pytest.mark.parametrize("units,sentences,want", [
    (["こんにちは", "フリーター", "です さっき病院に行ったら"], ["こんにちは。", "フリーターです。", "さっき病院に行ったら。"], [(1, 5), (3, 2), (3, 13)]),
    (["お電話ありがとうございます。こちらです。"], ["お電話ありがとうございます。", "こちらです。"], [(1, 14), (1, 20)]),
    (["「はい、そうです。」次は"], ["はいそうです。", "次"], [(1, 10)]),
    (["ぜんぜん違う話"], ["こんにちは。"], []),
])
def test_reference_boundaries(spark, units, sentences, want):
    u = spark.createDataFrame([(7, i, x) for i, x in enumerate(units, 1)] + [(8, 1, None)], "video_id long, n long, text string")
    r = spark.createDataFrame([(7, i, x) for i, x in enumerate(sentences)] + [(9, 0, "x"), (7, 9, None)], "video_id long, ord long, sentence string")
    assert sorted((x.n, x.after_char) for x in E.reference_boundaries(u, r).collect()) == want


def test_recognition(spark):
    f = spark.createDataFrame([(v, i, f"t{i}") for v in (1, 2) for i in range(10)] + [(None, 1, "x"), (1, None, "x")], "video_id long, frame_index long, text string")

    def engine(batch: pd.DataFrame) -> pd.DataFrame:
        assert len(batch) <= 4 and batch["video_id"].nunique() == 1
        own = batch[batch["frame_index"] % 5 != 0] if len(batch) > 1 else batch[batch["frame_index"] != 5]
        ids = [*own["frame_index"], 999]
        return pd.DataFrame({"frame_id": ids, "text": [*own["text"], "foreign"], "confidence": 0.5, "line_count": 1})

    got = E.recognize_frames(f, engine).collect()
    assert sorted((r.video_id, r.frame_id) for r in got if r.text is not None) == [(v, i) for v in (1, 2) for i in range(10) if i != 5]
    assert sorted((r.video_id, r.frame_id) for r in got if r.text is None) == [(1, 5), (2, 5)]
    assert E.recognize_frames(f.limit(0), engine).count() == 0


def test_boundaries(spark):
    u = spark.createDataFrame([(1, i, x) for i, x in enumerate(["今日は", "学校へ行く。", "「はい！」", None, "end."], 1)], "video_id long, n long, text string")
    assert sorted((r.n, r.after_char) for r in E.decide_boundaries(u, size=2, context=1).collect()) == [(2, 6), (3, 5), (5, 4)]

    def wild(before, target, after):
        both = pd.concat([target, after, pd.DataFrame({"n": [77]})])
        return pd.DataFrame({"n": both["n"], "after_char": 4})

    assert [(r.n, r.after_char) for r in E.decide_boundaries(u, wild, size=2, context=1).collect()] == [(5, 4)]
    assert E.decide_boundaries(u.limit(0)).count() == 0


def test_corrections(spark):
    rows = [(1, 1, "フリーダーです今日は", ["フリーターです今日は"]), (1, 2, "同じ文", ["同じ文"]), (1, 3, "フリーダーです今日はいい天気ですから行く", ["フリーターです今日はいい天気ですから行くとても遠い", "べつの話"]), (1, 4, "x", [])]
    s = spark.createDataFrame(rows, "video_id long, n long, text string, reference array<string>")
    got = {r.n: (r.corrected_text, r.status) for r in E.propose_corrections(s).collect()}
    assert got == {1: ("フリーターです今日は", "kept"), 3: (None, "missing")}
    last = lambda c: pd.DataFrame({"n": [1, 1, 99], "corrected_text": ["a", "b", "c"]})
    assert {r.n: r.corrected_text for r in E.propose_corrections(s, last).collect()}[1] == "b"


def windows(spark):
    c = spark.createDataFrame([(1, 1, 0, 900, "a"), (1, 2, 19000, 21000, "b"), (1, 3, 41000, 42000, "c"), (2, 1, 0, 1, "z")], SEG)
    o = spark.createDataFrame([(1, 1, 100, 800, "A"), (1, 2, 45000, 46000, "C")], SEG)
    return c, o


def test_windows_in_order(spark):
    c, o = windows(spark)

    def fn(window, tail):
        return E.spoken_per_cue(window, tail).assign(text=lambda x: x["text"] + "<" + ",".join(tail))

    got = sorted((r.video_id, r.window_index, r.ord, r.text) for r in E.reconcile_windows(c, o, fn, in_order=True).collect())
    assert got == [(1, 0, 0, "a<"), (1, 0, 1, "b<"), (1, 2, 0, "c<a<,b<"), (2, 0, 0, "z<")]
    assert E.reconcile_windows(c.limit(0), o.limit(0)).count() == 0


def test_second_pass(spark):
    """Ids of cues and segments differ; the reread and the second decision happen in the window, and the next one sees the new tail."""
    c, o = windows(spark)
    o = o.withColumn("n", F.col("n") + 100)

    def fn(window, tail):
        again = window[window["role"] == "reread"]
        own = E.spoken_per_cue(window, tail)
        if len(again):
            return own.assign(text="again " + ",".join(again["text"]) + "<" + ",".join(tail))
        named = [[101] if t == "a" else [] for t in own["text"]]
        return own.assign(ocr_ids=named, recheck=own["text"].isin(["a", "c"]), text=own["text"] + "<" + ",".join(tail))

    def review(ids, window):
        assert set(ids) <= set(window.loc[window["role"] == "ocr", "n"])
        return pd.DataFrame({"id": ids, "text": ["A!" if n == 101 else "  " for n in ids]})

    got = sorted((r.video_id, r.window_index, r.text, r.recheck) for r in E.second_pass(c, o, fn, review).collect())
    # the flagged "c" names none, so its window's segment 102 is read again; it comes back blank and the first decision stays
    assert got == [(1, 0, "again A!<", False), (1, 0, "again A!<", False), (1, 2, "c<again A!<,again A!<", True), (2, 0, "z<", False)]


def test_ambiguous_text_is_read_again(spark):
    c = spark.createDataFrame([(1, 1, 0, 2000, "接客")], SEG)
    o = spark.createDataFrame([(1, 101, 0, 2000, "挨拶")], SEG)

    def fn(window, tail):
        final = (window["role"] == "reread").any()
        return pd.DataFrame({"kind": ["spoken"], "cue_ids": [[1]], "ocr_ids": [[101]], "text": ["接客" if final else "挨拶"], "recheck": [not final]})

    review = lambda ids, window: pd.DataFrame({"id": ids, "text": ["接客"] * len(ids)})
    (r,) = E.second_pass(c, o, fn, review).collect()
    assert (r.text, r.recheck, r.ocr_ids) == ("接客", False, [101])


def computed(table):
    return {(r.video_id, r.window_index): r["round"] for r in table.collect() if r["round"]}


def test_windows_of_20_seconds_and_reuse(spark):
    c = spark.createDataFrame([(1, 1, 1000, 3000, "一"), (1, 2, 21000, 23000, "二"), (1, 3, 40000, 41000, "三")], SEG)
    o = c.withColumn("n", F.col("n") + 100)
    first = E.incremental_windows(c, o)
    assert computed(first) == {(1, 0): 1, (1, 1): 1, (1, 2): 1}
    rows = {r.window_index: r for r in first.collect()}
    assert rows[1].tail == ["一"] and [rows[k].decisions[0].text for k in range(3)] == ["一", "二", "三"]
    again = E.incremental_windows(c, o, first)
    assert computed(again) == {} and sorted(again.select("window_index", "decisions").collect()) == sorted(first.select("window_index", "decisions").collect())
    assert computed(E.incremental_windows(c, o, first, config="other")) == {(1, 0): 1, (1, 1): 1, (1, 2): 1}


def test_changed_times_context_and_tails_are_computed_again(spark):
    def chained(window, tail):  # a text that tells the first letter of the tail, so that a change goes on while that letter changes
        return E.spoken_per_cue(window, tail).assign(text=lambda x: x["text"] + (tail[-1][0] if tail else ""))

    rows = [(1, k, 20000 * k + 5000, 20000 * k + 9000, "abcdef"[k]) for k in range(6)] + [(2, 1, 0, 10, "z")]
    c = spark.createDataFrame(rows, SEG)
    o = spark.createDataFrame([(1, 101, 21000, 22000, "seen")], SEG)
    first = E.incremental_windows(c, o, fn=chained)

    def again(cues=c, segments=o):
        got = E.incremental_windows(cues, segments, first, fn=chained)
        whole = E.incremental_windows(cues, segments, fn=chained)
        part = lambda t: sorted((r.video_id, r.window_index, r.print, r.tail, r.decisions) for r in t.collect())
        assert part(got) == part(whole)
        return computed(got)

    # the times of a row
    assert again(c.withColumn("end_ms", F.when(F.col("n") == 3, F.col("end_ms") + 1).otherwise(F.col("end_ms")))) == {(1, 3): 1}
    # a recognised row of window 1 that lies in the context of window 0 as well
    assert again(segments=o.withColumn("text", F.lit("other"))) == {(1, 0): 1, (1, 1): 1}
    # the text of window 2: the tail of 3 is another, so is its own text, but not the letter that 4 takes up
    assert again(c.withColumn("text", F.when(F.col("n") == 2, F.lit("x")).otherwise(F.col("text")))) == {(1, 2): 1, (1, 3): 2, (1, 4): 3}
    # a window that goes: the one behind it has another tail
    assert again(c.where("n <> 3 or video_id = 2")) == {(1, 4): 1, (1, 5): 2}
    assert again(c.limit(0), o.limit(0)) == {}


def test_first_answer_counts_and_missing_frames_are_named(spark):
    frames = spark.createDataFrame([(1, k) for k in range(3)], "video_id long, frame_index long")

    def fn(batch):
        rows = [(k, t, c, 1) for k in batch["frame_index"] for t, c in (("zz first", 0.9), ("aa second", 0.1)) if k < 2]
        return pd.DataFrame(rows, columns=["frame_id", "text", "confidence", "line_count"])

    got = {r.frame_id: (r.text, r.confidence) for r in E.recognize_frames(frames, fn).collect()}
    assert got == {0: ("zz first", 0.9), 1: ("zz first", 0.9), 2: (None, None)}


class Rows:
    """Stands for sorted rows of windows and gives the function that a task runs."""

    def sortWithinPartitions(self, *by):
        return self

    def mapInPandas(self, f, schema):
        return f


def test_runs_of_keys_over_frames():
    random.seed(5)
    for most in (None, 1, 3):
        keys = sorted(random.randint(0, 9) for _ in range(60))
        frame = pd.DataFrame({"k": keys, "i": range(60)})
        cuts = sorted(random.sample(range(61), 4))
        parts = [frame.iloc[a:b].reset_index(drop=True) for a, b in zip([0, *cuts], [*cuts, 60])]
        want = [(k, own[i : i + (most or 60)]) for k in sorted(set(keys)) for own in [[i for i in range(60) if keys[i] == k]] for i in range(0, len(own), most or 60)]
        assert [(k, g["i"].tolist()) for (k,), g in E._groups(iter(parts), ["k"], most, seen=["i"])] == want
    assert list(E._groups(iter([frame.iloc[:0]]), ["k"])) == []


def test_results_of_many_windows_leave_a_task_in_one_frame(monkeypatch):
    """A frame for each window cost more than the windows themselves; a window that a row only passes through has no result."""
    monkeypatch.setattr(E, "_key_type", lambda df: "long")
    rows = [(v, 0, w, [], "cue", 10 * v + w, 0, 1, "t", w != 3) for v in range(20) for w in range(5)]
    pdf = pd.DataFrame(rows, columns=["video_id", "run", "window_index", "before", "role", "n", "start_ms", "end_ms", "text", "target"])
    (made,) = E._walk(Rows(), E.spoken_per_cue, None, 3)(iter([pdf.iloc[:47], pdf.iloc[47:]]))
    assert list(zip(made["video_id"], made["window_index"])) == [(v, w) for v in range(20) for w in (0, 1, 2, 4)]
    assert made["tail"].tolist() == [[], ["t"], ["t"], ["t"]] * 20


def test_prints_of_windows_shuffle_no_text(spark):
    c, o = windows(spark)
    plan = E.window_prints(c, o)._jdf.queryExecution().executedPlan().toString().split("\n")
    below = plan[next(i for i, x in enumerate(plan) if "Exchange hashpartitioning" in x) + 1]
    assert "mark" in below and "text" not in below
    assert sorted((r.video_id, r.window_index) for r in E.window_prints(c, o).collect()) == [(1, 0), (1, 2), (2, 0)]


@pytest.mark.parametrize("short", [0, 9, 1_000_000])
def test_longest_stretches_by_grams(monkeypatch, short):
    """Both searches, with and without a bound from the part around, give difflib's blocks; ties go by places."""
    monkeypatch.setattr(B, "PRODUCT", short)
    random.seed(4)
    for t in range(200):
        a = "".join(random.choice("abc\U0001f600"[: 2 + t % 3]) for _ in range(random.randint(0, 60)))
        b = "".join(random.choice("abcd"[: 2 + t % 3]) for _ in range(random.randint(0, 60))) if t % 2 else a.replace("a", "b", t % 9)
        m = SequenceMatcher(None, a, b, autojunk=False)
        assert B.matching(a, b) == [(x.a, x.b, x.size) for x in m.get_matching_blocks() if x.size]
        assert all(B.reaches(a, b, x) == (m.ratio() >= x) for x in (0.2, 0.46, 0.8, 1.0))


def test_equal_pieces_in_a_row_are_cut_in_one_search():
    """60,000 characters of one phrase: a search of all that is left for each piece grew with the square of the length."""
    a = "the same phrase over and over. " * 2_000
    began = time.process_time()
    blocks = B.matching(a, a.replace("e", "c"))
    assert sum(n for _, _, n in blocks) == len(a) - a.count("e")
    assert time.process_time() - began < 3


def test_cuts_of_many_chunks_leave_a_task_in_one_frame(spark, monkeypatch):
    """A group and a frame for each chunk cost more than the chunks themselves."""
    seen = []

    class Stop(Exception):
        pass

    def check(cuts, units):
        seen.append(cuts)
        raise Stop

    monkeypatch.setattr(E, "_chunks", lambda *a: Rows())
    monkeypatch.setattr(E, "validate_boundaries", check)
    with pytest.raises(Stop):
        E.decide_boundaries(spark.createDataFrame([], "video_id long, n long, text string"))
    rows = [(v, c, n, f"t{n}。", n - 2 * c) for v in range(9) for c in range(4) for n in range(2 * c, 2 * c + 3)]
    pdf = pd.DataFrame(rows, columns=["video_id", "chunk", "n", "text", "part"])
    (made,) = seen[0](iter([pdf.iloc[:50], pdf.iloc[50:]]))
    assert list(zip(made["video_id"], made["n"], made["after_char"])) == [(v, 2 * c + 1, 3) for v in range(9) for c in range(4)]


def test_plain_functions_get_no_frames(spark, monkeypatch):
    """A frame for each window or batch cost milliseconds; functions marked ``plain`` take lists and decide as those with frames do."""
    c, o = windows(spark)
    o = o.withColumn("n", F.col("n") + 50)

    def decide(window, tail):
        again = list(window["role"]).count("reread")
        own = [(n, x) for r, t, n, x in zip(window["role"], window["target"], window["n"], window["text"]) if t and r == "cue"]
        return {"kind": ["spoken"] * len(own), "cue_ids": [[n] for n, _ in own], "ocr_ids": [[] for _ in own], "text": [f"{x}<{','.join(tail)}>{again}" for _, x in own], "recheck": [not again] * len(own)}

    def review(ids, window):
        return {"id": ids, "text": ["r" if n % 2 else " " for n in ids]}

    framed = lambda window, tail: pd.DataFrame(decide(window, tail))
    shown = lambda fn, rev: sorted((r.video_id, r.window_index, r.ord, r.text) for r in E.second_pass(c, o, fn, rev).collect())
    seen = lambda window, tail: decide(window, tail) if isinstance(window, dict) else 1 / 0
    assert shown(E.plain(seen), review) == shown(framed, lambda *x: pd.DataFrame(review(*x)))
    f = spark.createDataFrame([(v, i, f"t{i}") for v in (1, 2) for i in range(10)], "video_id long, frame_index long, text string")

    @E.plain
    def read(batch):
        assert isinstance(batch["text"], list) and len(batch["text"]) <= 4
        own = [k for k, n in enumerate(batch["frame_index"]) if n % 5 or len(batch["text"]) == 1]
        return {"frame_id": [batch["frame_index"][k] for k in own], "text": [batch["text"][k] for k in own], "confidence": [0.5] * len(own), "line_count": [1] * len(own)}

    assert sorted((r.video_id, r.frame_id, r.text) for r in E.recognize_frames(f, read).collect()) == [(v, i, f"t{i}") for v in (1, 2) for i in range(10)]


def test_texts_are_not_shuffled_for_the_windows_that_changed(spark):
    """lines and saved decisions are looked up by video; prints are compared, and only what is computed is written with its text."""
    import random

    rng = random.Random(3)
    text = lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(2_000))
    kind = "video_id long, n long, start_ms long, end_ms long, text string"
    rows = [(v, n, 7_000 * n, 7_000 * n + 5_000, text()) for v in (1, 2) for n in range(150)]
    c, o = spark.createDataFrame(rows, kind), spark.createDataFrame([(1, 1_000, 100, 900, "seen")], kind)
    first = E.kept(E.incremental_windows(c, o), "first")
    gateway, status = spark.sparkContext._gateway, spark.sparkContext._jsc.sc().statusStore()

    def stages():
        found = status.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i).outputBytes() for i in range(found.size())}

    before = stages()
    changed = c.withColumn("text", F.when(F.expr("video_id = 2 and n = 70"), F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    got = E.incremental_windows(changed, o, first).select("video_id", "window_index", (F.col("round") > 0).alias("computed")).collect()
    assert sum(r.computed for r in got) in (1, 2, 3) and len(got) > 100
    # of 1.8 MB of text
    assert sum(v for k, v in stages().items() if k not in before) < 600_000


def test_prints_tell_rows_and_their_windows(spark):
    """A print changes with a row's text, times, role and number, with rows that come twice or not at all, but not with their order."""
    kind = "video_id long, n long, start_ms long, end_ms long, text string"
    own = [(1, 1, 0, 900, "a"), (1, 2, 5_000, 5_900, "b")]
    none = spark.createDataFrame([], kind)
    print_of = lambda rows, other=none: [r.print for r in E.window_prints(spark.createDataFrame(rows, kind), other).collect()]
    rows = [own, own + own[1:], own[:1], [own[0], (1, 2, 5_000, 5_900, "c")], [own[0], (1, 2, 5_001, 5_900, "b")], [own[0], (1, 3, 5_000, 5_900, "b")], [own[0], (1, 2, 5_000, 5_900, None)]]
    prints = [print_of(x) for x in rows] + [print_of(own[:1], spark.createDataFrame(own[1:], kind))]
    assert all(len(x) == 1 for x in prints) and len({x[0] for x in prints}) == len(prints) and print_of(own[::-1]) == prints[0]
