"""Streams replayed over the whole events table, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..sources.shared import scratch
from ..streaming import replay as Z
from . import fixtures as X
from .registry import _LIB, query


def _stream(s, d) -> DataFrame:
    return s.readStream.schema(X.read(s, d, "events").schema).parquet(f"{d}/events.parque[t]")  # a pattern: a plain path must be a folder


# A window is sent once the watermark, an hour behind the newest row, has passed its end.
@query("""with w as (select epoch_us(ts)//20000000*20 start_s, event_type, count(*) n from events group by 1, 2)
select * from w where (start_s + 20)::bigint * 1000000 <= (select max(epoch_us(ts)) from events) - 3600000000""")
def stream_windows(s, d):
    return Z.replay(Z.stream_windows(_stream(s, d)), scratch(s, "windows"), scratch(s, "windows-state"))


@query(_LIB + """, p as (select save_id, unnest([{'kind_of_key': 'entry', 'key': entry_key}, {'kind_of_key': 'form', 'key': entry_key || '␟' || surface}, {'kind_of_key': 'meaning', 'key': entry_key || '␟' || meaning}, {'kind_of_key': 'encounter', 'key': entry_key || '␟' || context_key}]) x from k)
select x.kind_of_key, x.key, min(save_id) save_id from p group by 1, 2""", "saves")
def stream_upsert_library(s, d):
    rows = Z.stream_upsert_library(X.saves_of(_stream(s, d)), scratch(s, "library"), scratch(s, "library-state"))
    key = F.when(F.col("part") == "entry", F.col("entry_key")).otherwise(F.concat_ws("␟", "entry_key", "key"))
    return rows.select(F.col("part").alias("kind_of_key"), key.alias("key"), "save_id")


@query()
def stream_segments(s, d):
    e = _stream(s, d)
    obs = X.observations_of(e.withColumn("at", F.col("ts").cast("timestamp")), "at")
    return Z.replay(Z.stream_segments(obs, X.INTERVAL, 82.0), scratch(s, "segments"), scratch(s, "segments-state"))
