"""Queries of the frame operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import frames as P
from . import fixtures as X
from .registry import _points, query


def _selected(s, d):
    return X.frames(s, d).where("frame_index % 10 = 0").select("video_id", "frame_index", F.lit(0.5).alias("score"))


def _spans(s, d):
    return X.frames(s, d).where("frame_index % 20 = 0").select("video_id", F.col("ts_ms").alias("start_ms"), (F.col("ts_ms") + 1500).alias("end_ms"))


@query()
def select_keyframes(s, d):
    return P.select_keyframes(X.frames(s, d)).withColumn("score", F.round("score", 6))


@query("""
, p as (select distinct video_id % 4 video_id, ts_ms % 20000 - 500 t from observations), near as (select p.video_id, arg_min(f.frame_index, (abs(f.ts_ms - greatest(0, p.t)), f.ts_ms)) frame_index from p join frames f using (video_id) group by p.video_id, p.t)
select video_id, frame_index, max(score) score from (select video_id, frame_index, 0.5::double score from frames where frame_index % 10 = 0 union all select video_id, frame_index, 0::double from near) group by 1, 2""", "observations", "frames")
def hint_frames(s, d):
    return P.hint_frames(_selected(s, d), X.frames(s, d), _points(s, d))


@query()
def probe_windows(s, d):
    return P.probe_windows(_selected(s, d), X.frames(s, d), _spans(s, d))


@query("""
, g as (select video_id, greatest(0, ts_ms - 400) a, ts_ms + 1900 b from frames where frame_index % 20 = 0), p as (select video_id, a + round_even((b - a) * unnest([0.2::double, 0.5::double, 0.8::double]), 0)::bigint t from g),
near as (select p.video_id, arg_min(f.frame_index, (abs(f.ts_ms - p.t), f.ts_ms)) frame_index from (select distinct * from p) p join frames f using (video_id) group by p.video_id, p.t),
short as (select video_id, frame_index from frames where frame_index % 5 = 0 and frame_index % 4 = 0 and frame_index % 3 > frame_index % 8 // 4),
beside as (select f.video_id, f.frame_index from short s join frames f on f.video_id = s.video_id and f.frame_index in (s.frame_index - 1, s.frame_index + 1))
select distinct video_id, frame_index from (select * from near union all select * from beside) where frame_index % 4 <> 0""", "frames")
def supplemental_frames(s, d):
    f = X.frames(s, d)
    seen = f.where("frame_index % 4 = 0").select("video_id", "frame_index", F.expr("frame_index % 8 div 4").alias("line_count"))
    return P.supplemental_frames(f, f.where("frame_index % 5 = 0"), seen, _spans(s, d))
