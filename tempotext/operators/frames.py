"""Frames to look at: change points of signatures, frames near captions, novel frames within cue spans, frames for gaps.

Signatures are vectors; a null one counts as empty, and null components as zero. Sequential operators read a video's rows
in time order within a sorted partition, batch after batch, and hold a fixed number of signatures, whatever the video's length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.similarity import signature_similarity
from .cues import nearest_frame

SAME, COPY, EMPTY = 0.86, 0.96, 1e-9


def _vector(x) -> np.ndarray:
    return np.nan_to_num(np.array([0.0 if v is None else v for v in x] if x is not None else [], dtype=float))


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Cosine; two empty vectors are alike, an empty one and another are not."""
    p, q = np.sqrt(a @ a), np.sqrt(b @ b)
    if p < EMPTY or q < EMPTY:
        return float(p < EMPTY and q < EMPTY)
    return float(a @ b / (p * q))


def _in_order(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("video_id").sortWithinPartitions("video_id", *order)


def select_keyframes(frames: DataFrame, threshold: float = SAME) -> DataFrame:
    """(video_id, frame_index, score): the first frame, and each first of two frames in a row that differ from the last
    chosen state and not from each other; its score is how far the second one is from the old state."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video = anchor = seen = None
        for pdf in batches:
            out = []
            for v, i, x in zip(pdf["video_id"], pdf["frame_index"], pdf["signature"]):
                now = _vector(x)
                if v != video:
                    video, anchor, seen = v, now, None
                    out.append((v, i, 1.0))
                    continue
                away = similarity(anchor, now)
                if away >= threshold:
                    seen = None
                elif seen is not None and similarity(seen[1], now) >= threshold:
                    out.append((v, seen[0], 1.0 - away))
                    anchor, seen = seen[1], None
                else:
                    seen = (i, now)
            yield pd.DataFrame(out, columns=["video_id", "frame_index", "score"])

    rows = _in_order(frames.select("video_id", "ts_ms", "frame_index", "signature"), "ts_ms", "frame_index")
    return rows.mapInPandas(walk, "video_id long, frame_index long, score double")


def hint_frames(selected: DataFrame, frames: DataFrame, times: DataFrame) -> DataFrame:
    """``selected`` and the frames nearest to the times (video_id, t), these with score 0 if they are new."""
    near = nearest_frame(times, frames).where("frame_index is not null").select("video_id", "frame_index", F.lit(0.0).alias("score"))
    return selected.select("video_id", "frame_index", "score").unionByName(near).groupBy("video_id", "frame_index").agg(F.max("score").alias("score"))


def probe_windows(selected: DataFrame, frames: DataFrame, spans: DataFrame, interval_ms: int = 800, copy: float = COPY) -> DataFrame:
    """(video_id, frame_index): frames nearest to every ``interval_ms`` of the spans that show something new.

    New: no selected frame within two intervals has a similarity of ``copy``, and no frame taken before it either. Frames
    are taken in time order, so overlapping spans count as one. The first test is a join by time bins, the second a walk.
    """
    step = max(100, interval_ms)
    first, last = F.greatest(F.lit(0), F.col("start_ms")), F.greatest(F.lit(0), F.col("start_ms"), F.col("end_ms"))
    times = spans.select("video_id", F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("t"))
    near = nearest_frame(times, frames).where("frame_index is not null").select("video_id", "frame_index").distinct()
    own = frames.select("video_id", "frame_index", "ts_ms", "signature")
    bin_ = F.floor(F.col("ts_ms") / (2 * step))
    c = near.join(own, ["video_id", "frame_index"])
    c3 = c.withColumn("bin", F.explode(F.array(bin_ - 1, bin_, bin_ + 1)))
    s = selected.select("video_id", "frame_index").distinct().join(own, ["video_id", "frame_index"]).select("video_id", bin_.alias("bin"), F.col("ts_ms").alias("st"), F.col("signature").alias("ss"))
    old = c3.join(s, ["video_id", "bin"]).where(F.abs(F.col("ts_ms") - F.col("st")) <= 2 * step).where(signature_similarity(F.col("signature"), F.col("ss")) >= copy)
    fresh = c.join(old.select("video_id", "frame_index").distinct(), ["video_id", "frame_index"], "left_anti")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        video, taken = None, deque()
        for pdf in batches:
            out = []
            for v, i, t, x in zip(pdf["video_id"], pdf["frame_index"], pdf["ts_ms"], pdf["signature"]):
                if v != video:
                    video, taken = v, deque()
                while taken and t - taken[0][0] > 2 * step:
                    taken.popleft()
                now = _vector(x)
                if all(similarity(y, now) < copy for _, y in taken):
                    taken.append((t, now))
                    out.append((v, i))
            yield pd.DataFrame(out, columns=["video_id", "frame_index"])

    return _in_order(fresh, "ts_ms", "frame_index").mapInPandas(walk, "video_id long, frame_index long")


def supplemental_frames(frames: DataFrame, selected: DataFrame, observed: DataFrame, gaps: DataFrame, pad_ms: int = 400) -> DataFrame:
    """(video_id, frame_index) not observed yet: nearest to 20, 50 and 80 % of each padded gap, and the neighbours of
    selected frames that show more lines than were read (``observed``: video_id, frame_index, line_count)."""
    start = F.greatest(F.lit(0), F.col("start_ms") - pad_ms)
    span = F.greatest(start, F.col("end_ms") + pad_ms) - start
    times = gaps.select("video_id", F.explode(F.array(*[F.bround(start + span * F.lit(x)).cast("long") for x in (0.2, 0.5, 0.8)])).alias("t"))
    near = nearest_frame(times, frames).where("frame_index is not null").select("video_id", "frame_index")
    o = W.partitionBy("video_id").orderBy("ts_ms", "frame_index")
    sides = frames.select("video_id", "frame_index", "visual_line_count", F.array(F.lag("frame_index").over(o), F.lead("frame_index").over(o)).alias("sides"))
    lines = observed.groupBy("video_id", "frame_index").agg(F.max("line_count").alias("line_count"))
    short = sides.join(selected.select("video_id", "frame_index").distinct(), ["video_id", "frame_index"]).join(lines, ["video_id", "frame_index"]).where(F.col("visual_line_count") > F.greatest(F.lit(0), F.coalesce("line_count", F.lit(0))))
    beside = short.select("video_id", F.explode("sides").alias("frame_index")).where("frame_index is not null")
    return near.unionByName(beside).distinct().join(lines.select("video_id", "frame_index"), ["video_id", "frame_index"], "left_anti")
