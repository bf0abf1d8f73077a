"""Caption tracks and their joins with recognised segments by padded time and by text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.similarity import matches, text_contains
from ..functions.text import coverage_key
from .times import overlapping, running_max

PAD, COVER, GAP, MERGE, SPAN, CONTEXT = 650, 700, 500, 250, 20_000, 3_000
SUPPORT = 0.46
#: Segments whose references are put together in one row.
BLOCK = 64


def merge_cues(cues: DataFrame, gap_ms: int = MERGE) -> DataFrame:
    """Equal texts in a row whose gap is at most ``gap_ms`` become one cue; ids are given anew in time order."""
    w = W.partitionBy("video_id").orderBy("start_ms", "end_ms", "n")
    runs = cues.withColumn("run", F.sum(F.coalesce(F.col("text") != F.lag("text").over(w), F.lit(True)).cast("long")).over(w))
    r = W.partitionBy("video_id", "run").orderBy("start_ms", "end_ms", "n")
    reach = F.max("end_ms").over(r.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("cut", F.coalesce(F.col("start_ms") > reach + gap_ms, F.lit(True)).cast("long")).withColumn("part", F.sum("cut").over(r))
    one = runs.groupBy("video_id", "run", "part").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.first("text").alias("text"))
    return assign_ids(one, "yt", "start_ms", "end_ms", "run").select("video_id", F.col("id").alias("cue_id"), "start_ms", "end_ms", "text")


def assign_ids(rows: DataFrame, prefix: str, *order: str) -> DataFrame:
    """``id``: prefix and six digits, counted from 1 within a video in the given order."""
    return rows.withColumn("id", F.format_string(prefix + "%06d", F.row_number().over(W.partitionBy("video_id").orderBy(*order))))


def merge_intervals(spans: DataFrame, gap_ms: int = GAP) -> DataFrame:
    """Islands of spans that begin at most ``gap_ms`` after all earlier ones of the video have ended."""
    w = W.partitionBy("video_id").orderBy("start_ms", "end_ms")
    reach = F.max("end_ms").over(w.rowsBetween(W.unboundedPreceding, -1))
    cut = F.coalesce(F.col("start_ms") > reach + gap_ms, F.lit(True)).cast("long")
    return spans.withColumn("cut", cut).withColumn("island", F.sum("cut").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("video_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


def align_references(segments: DataFrame, cues: DataFrame, pad_ms: int = PAD) -> DataFrame:
    """Each segment with the distinct texts of the cues that overlap it, padded, in cue order; none: an empty list.

    Pairs are found by times and numbers alone. A text goes once to each block of BLOCK segments that it overlaps, not to each bin
    or segment, and a block's segments take their texts by place.
    """
    at, block = ["cn", "cs", "ce"], ["video_id", "block"]  # cues of one number and time pair alike, so numbers may repeat
    c = cues.select("video_id", F.col("n").alias("cn"), F.col("start_ms").alias("cs"), F.col("end_ms").alias("ce"), F.col("text").alias("ct")).where("ce >= 0")
    both = overlapping(segments.select("video_id", "n", "start_ms", "end_ms"), c.drop("ct"), ("start_ms", "end_ms"), ("cs", "ce"), pad_ms)
    # A segment's own row has no cue and comes first in its block; it counts the segments of one number.
    rows = both.select("video_id", "n", *at).unionByName(segments.select("video_id", "n"), allowMissingColumns=True).withColumn("block", F.floor(F.col("n") / BLOCK))
    rows = rows.repartition(*block).withColumn("place", F.dense_rank().over(W.partitionBy(*block).orderBy(*at)) - 1)
    own = rows.groupBy(*block, "n").agg(F.collect_set(F.when(F.col("cs").isNotNull(), F.col("place"))).alias("places"), F.count(F.when(F.col("cs").isNull(), 1)).cast("int").alias("m"))
    own = own.groupBy(*block).agg(F.collect_list(F.struct("n", "places", "m")).alias("own"))
    wanted = rows.where("cs is not null").select(*block, *at).distinct().withColumnsRenamed({"video_id": "v", "cn": "wn", "cs": "ws", "ce": "we"})
    sent = c.join(wanted, (F.col("video_id") == F.col("v")) & F.col("cn").eqNullSafe(F.col("wn")) & (F.col("cs") == F.col("ws")) & (F.col("ce") == F.col("we")))
    sent = sent.select(*block, *at, "ct").repartition(*block).groupBy(*block, *at).agg(F.collect_list(F.struct("cn", "ct")).alias("cues"))
    sent = sent.groupBy(*block).agg(F.transform(F.sort_array(F.collect_list(F.struct(*at, "cues"))), lambda x: x["cues"]).alias("texts"))
    held = lambda x: F.sort_array(F.flatten(F.transform(x["places"], lambda k: F.element_at("texts", k))))
    texts = lambda x: F.coalesce(F.array_distinct(F.transform(held(x), lambda y: y["ct"])), F.array().cast("array<string>"))
    found = own.join(sent, block, "left").select("video_id", F.explode(F.transform("own", lambda x: F.struct(x["n"].alias("n"), texts(x).alias("reference"), x["m"].alias("m")))).alias("x"))
    return found.select("video_id", "x.n", "x.reference", F.explode(F.sequence(F.lit(1), "x.m")).alias("k")).drop("k")


def uncovered_cues(cues: DataFrame, segments: DataFrame, pad_ms: int = COVER, least: float | None = SUPPORT) -> DataFrame:
    """Cues without a segment near them in time that supports their text.

    Texts are compared by keys of their letters and digits, and an empty one supports nothing. A segment supports a cue if
    one key contains the other, or by a matching blocks ratio of ``least`` (None: by containment only). That one is asked only for
    cues that no segment supports by the first test, of segments whose length allows it, those of the likest length first, until
    one supports the cue.
    """
    s = segments.select("video_id", F.col("start_ms").alias("ss"), F.col("end_ms").alias("se"), coverage_key(F.col("text")).alias("sk")).where("sk <> ''")
    c = cues.withColumn("k", coverage_key(F.col("text")))
    near = overlapping(c.where("k <> ''").select("video_id", "n", "start_ms", "end_ms", "k"), s, ("start_ms", "end_ms"), ("ss", "se"), pad_ms)
    near = near.withColumn("held", (F.col("k") == F.col("sk")) | text_contains(F.col("k"), F.col("sk")))
    held = near.where("held").select("video_id", "n").distinct()
    if least is not None:
        held = held.unionByName(_alike_cues(near.where("not held").join(held, ["video_id", "n"], "left_anti"), least))
    return c.join(held, ["video_id", "n"], "left_anti").drop("k")


def _alike_cues(near: DataFrame, least: float) -> DataFrame:
    """(video_id, n) of the pairs (video_id, n, k, sk) of which one reaches the ratio; a cue's pairs are read as a stream."""
    a, b = F.length("k"), F.length("sk")
    pairs = near.where(2 * F.least(a, b) >= least * (a + b)).select("video_id", "n", F.abs(a - b).alias("gap"), "k", "sk")

    def first(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cue, done = None, False
        for pdf in batches:
            out = []
            for v, n, k, sk in zip(pdf["video_id"], pdf["n"], pdf["k"], pdf["sk"]):
                if (v, n) != cue:
                    cue, done = (v, n), False
                if not done and matches(k, sk, least):
                    done = True
                    out.append(cue)
            if out:
                yield pd.DataFrame(out, columns=["video_id", "n"])

    kind = near.select("video_id", "n").schema
    return pairs.repartition("video_id", "n").sortWithinPartitions("video_id", "n", "gap").select("video_id", "n", "k", "sk").mapInPandas(first, kind)


def tumbling_windows(rows: DataFrame, span_ms: int = SPAN) -> DataFrame:
    """Rows and last end of each window a row starts in; empty windows are left out."""
    return rows.groupBy("video_id", F.expr(f"start_ms div {span_ms}").alias("window_index")).agg(F.count("*").alias("cues"), F.max("end_ms").alias("last_end"))


def window_bounds(cues: DataFrame, segments: DataFrame, durations: DataFrame, span_ms: int = SPAN) -> DataFrame:
    """(video_id, window_index, start_ms, end_ms, cues, segments) of windows in which a cue or a segment starts; the last ends with the video.

    The duration is that of ``effective_duration``; windows that would begin at or after it are left out, but for the first.
    """
    at = F.expr(f"start_ms div {span_ms}").alias("window_index")
    both = cues.select("video_id", at, F.lit(1).alias("c"), F.lit(0).alias("s")).unionByName(segments.select("video_id", at, F.lit(0).alias("c"), F.lit(1).alias("s")))
    w = both.groupBy("video_id", "window_index").agg(F.sum("c").alias("cues"), F.sum("s").alias("segments")).join(effective_duration(cues, segments, durations), "video_id")
    start = F.col("window_index") * span_ms
    return w.where((start < F.col("duration_ms")) | (F.col("window_index") == 0)).select("video_id", "window_index", start.alias("start_ms"), F.least("duration_ms", start + span_ms).alias("end_ms"), "cues", "segments")


def window_context(rows: DataFrame, span_ms: int = SPAN, context_ms: int = CONTEXT, *more: str) -> DataFrame:
    """(video_id, window_index, n, target) and the columns ``more``: rows that overlap a window or its context; each row finds its windows by division, not by search."""
    first, last = F.floor(F.greatest(F.lit(0), F.col("start_ms") - context_ms - 1) / span_ms), F.floor((F.col("end_ms") + context_ms) / span_ms)
    w = rows.withColumn("window_index", F.explode(F.sequence(first, last)))
    overlap = (F.col("end_ms") >= F.col("window_index") * span_ms - context_ms) & (F.col("start_ms") <= (F.col("window_index") + 1) * span_ms + context_ms)
    return w.where(overlap).select("video_id", "window_index", "n", (F.floor(F.col("start_ms") / span_ms) == F.col("window_index")).alias("target"), *more)


def chunk_with_context(rows: DataFrame, size: int = 100, context: int = 10) -> DataFrame:
    """(video_id, chunk, n, role): chunks of ``size`` rows, with ``context`` rows before and after."""
    r = rows.withColumn("i", F.row_number().over(W.partitionBy("video_id").orderBy("n")) - 1)
    own = F.floor(F.col("i") / size)
    r = r.withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0), F.floor((F.col("i") - context) / size)), F.floor((F.col("i") + context) / size))))
    last = r.groupBy("video_id").agg(F.max(own).alias("last"))
    role = F.when(F.col("chunk") == own, "target").when(F.col("chunk") > own, "before").otherwise("after")
    return r.join(last, "video_id").where("chunk <= last").select("video_id", "chunk", "n", role.alias("role"))


def nearest_frame(points: DataFrame, frames: DataFrame) -> DataFrame:
    """(video_id, t, frame_index): the frame closest to max(0, t), the earlier of two; null without frames. Two running maxima."""
    p = points.select("video_id", "t", F.greatest(F.lit(0), F.col("t")).alias("ts"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("i")).distinct()
    f = frames.select("video_id", F.lit(None).cast("long").alias("t"), F.col("ts_ms").alias("ts"), F.lit(0).alias("kind"), F.col("frame_index").alias("i"))
    frame = lambda sign: F.when(F.col("kind") == 0, F.struct((sign * F.col("ts")).alias("ts"), (sign * F.col("i")).alias("i")))
    both = running_max(p.unionByName(f), frame(1), F.col("ts"), F.col("kind"), "b")
    both = running_max(both, frame(-1), -F.col("ts"), F.col("kind"), "a").where("kind = 1")
    before, after = F.col("ts") - F.col("b.ts"), -F.col("a.ts") - F.col("ts")
    return both.select("video_id", "t", F.when(F.col("a").isNull() | (before <= after), F.col("b.i")).otherwise(-F.col("a.i")).alias("frame_index"))


def effective_duration(cues: DataFrame, segments: DataFrame, durations: DataFrame | None = None) -> DataFrame:
    """The greatest end of a video's cues and segments, and of its own duration (video_id, duration_ms) if given."""
    ends = cues.select("video_id", "end_ms").unionByName(segments.select("video_id", "end_ms"))
    if durations is not None:
        ends = ends.unionByName(durations.select("video_id", F.col("duration_ms").alias("end_ms")))
    return ends.groupBy("video_id").agg(F.max("end_ms").alias("duration_ms"))


def infer_language(rows: DataFrame, first: int = 80) -> DataFrame:
    """By the scripts among a video's first rows: kana ja, hangul ko, han zh, cyrillic ru, latin en, else auto."""
    rn = F.row_number().over(W.partitionBy("video_id").orderBy("n"))
    r = rows.withColumn("rn", rn).where(F.col("rn") <= first)
    has = lambda p: F.max(F.col("text").rlike(p))
    lang = F.when(has("[぀-ヿ]"), "ja").when(has("[가-힯]"), "ko").when(has("[一-鿿]"), "zh").when(has("[Ѐ-ӿ]"), "ru").when(has("[A-Za-z]"), "en").otherwise("auto")
    return r.groupBy("video_id").agg(lang.alias("language"))


def interpolate_unit_times(units: DataFrame) -> DataFrame:
    """Units (video_id, n, pos, unit, start_ms, end_ms of the fragment) timed by their share of characters, half-even."""
    w = W.partitionBy("video_id", "n")
    done, total = F.sum(F.length("unit")).over(w.orderBy("pos")), F.sum(F.length("unit")).over(w)
    at = lambda c: (F.col("start_ms") + F.rint((F.col("end_ms") - F.col("start_ms")) * c / total)).cast("long")
    return units.select("video_id", "n", "pos", "unit", at(done - F.length("unit")).alias("unit_start"), at(done).alias("unit_end"))


def sentence_at_time(points: DataFrame, sentences: DataFrame) -> DataFrame:
    """(video_id, t, n): the first sentence that holds t, else the last that began by then; null if none."""
    p = points.select("video_id", "t").distinct()
    s = sentences.select("video_id", "n", "start_ms", (F.col("end_ms") - 1).alias("last_ms"))
    holds = overlapping(s, p, ("start_ms", "last_ms"), ("t", "t")).groupBy("video_id", "t").agg(F.min("n").alias("held"))
    rows = p.select("video_id", "t", F.lit(None).cast("long").alias("n"), F.lit(1).alias("kind")).unionByName(s.select("video_id", F.col("start_ms").alias("t"), "n", F.lit(0).alias("kind")))
    begun = running_max(rows, F.col("n"), F.col("t"), F.col("kind"), "begun").where("kind = 1")
    return begun.join(holds, ["video_id", "t"], "left").select("video_id", "t", F.coalesce("held", "begun").alias("n"))
