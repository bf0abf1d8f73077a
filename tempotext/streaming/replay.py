"""Structured Streaming forms of batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_windows(events: DataFrame, span: str = "20 seconds", late: str = "1 hour") -> DataFrame:
    """Rows per type and event-time window; rows later than ``late`` are dropped by the watermark."""
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late).groupBy(F.window("at", span).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n")


def replay(stream: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Runs a stream over all that is there and reads what it wrote."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def stream_upsert_library(saves: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """Library of a stream of saves, stored at ``path``: for every key its first save, whatever batch brought it (``load_library``'s rows).

    Each batch is merged into the buckets it touches (``merge_library``), so what it reads and rewrites follows the batch, and a batch that is
    replayed, or comes out of order, changes nothing.
    """
    from ..operators.library import load_library, merge_library

    query = saves.writeStream.foreachBatch(lambda batch, _: merge_library(batch, path, buckets)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return load_library(saves.sparkSession, path)


def stream_segments(obs: DataFrame, interval_ms: int, threshold: float, late: str = "1 hour", duration_ms: int | None = None) -> DataFrame:
    """Streaming form of ``segment_observations`` over rows (video_id, at, ts_ms, frame_index, text, confidence); ``at`` rises with ``ts_ms``.

    Rows of a video wait until the watermark, ``late`` behind the newest row of all, has passed them, and are then read in time order,
    so it doesn't matter how they are spread over batches; rows that come later still are dropped. State is the rows that wait, as packed
    columns of numbers with each text once, and the open segment: its start, its texts with counts and scores. A segment is sent when a row closes it: send a row without text at a
    video's end to close its last one. Texts, nulls, alternatives and ends (at most ``duration_ms``) are as in the batch form.
    """
    import numpy as np
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    from ..functions.text import normalize_text
    from ..operators.segments import ALTERNATIVES, REVIEW, Votes, alike

    kinds = (np.int64, np.int64, np.int64, np.int32, np.float64)
    names = ["video_id", "start_ms", "end_ms", "text", "confidence", "observation_count", "alternatives", "needs_review"]

    def walk(key: tuple, batches, state: GroupState):
        out, votes, start, total, n = [], None, 0, 0.0, 0
        known, parts = {}, []
        if state.exists:
            start, texts, counts, scores, total, n, listed, *packed = state.get
            known = {x: k for k, x in enumerate(listed)}
            parts.append([np.frombuffer(x, t) for x, t in zip(packed, kinds)])
            if n:
                votes = Votes()
                for own in zip(texts, counts, scores):
                    votes.count(*own)
        if not state.hasTimedOut:
            for rows in batches:
                codes, found = pd.factorize(rows["text"])
                number = np.array([known.setdefault(x, len(known)) for x in found] + [0], np.int64)
                parts.append([rows[c].to_numpy(t) for c, t in zip(("at_ms", "ts_ms", "frame_index"), kinds)] + [number[codes].astype(np.int32), rows["confidence"].to_numpy(np.float64)])
        mark = state.getCurrentWatermarkMs()
        waiting = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, t) for t in kinds]
        parts.clear()
        due = waiting[0] <= mark
        ready = [x[due] for x in waiting]
        waiting = [x[~due] for x in waiting]
        order = np.lexsort((ready[2], ready[1]))
        listed = list(known)
        for k in range(0, len(order), 10_000):
            now = order[k : k + 10_000]
            rows = zip(ready[1][now].tolist(), [listed[x] for x in ready[3][now].tolist()], ready[4][now].tolist())
            for t, text, c in rows:
                if votes is not None and (text == "" or not alike(votes.head, text, threshold)):
                    ranked, end = votes.ranked(), max(start + interval_ms, t)
                    out.append((key[0], start, end if duration_ms is None else min(duration_ms, end), ranked[0], total / n, n, ranked[1 : 1 + ALTERNATIVES], total / n < REVIEW))
                    votes = None
                if text != "":
                    if votes is None:
                        votes, start, total, n = Votes(), t, 0.0, 0
                    votes.add(text, c)
                    total, n = total + c, n + 1
            if len(out) >= 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if votes is None and not len(waiting[0]):
            if state.exists:
                state.remove()
        else:
            own = list(votes.texts.items()) if votes is not None else []
            left, codes = np.unique(waiting[3], return_inverse=True)
            waiting[3] = codes.astype(np.int32)
            state.update((start, [x for x, _ in own], [int(v[0]) for _, v in own], [float(v[1]) for _, v in own], float(total), n if own else 0, [listed[x] for x in left.tolist()], *(x.tobytes() for x in waiting)))
            if len(waiting[0]):
                state.setTimeoutTimestamp(max(int(waiting[0].min()), mark + 1))
        yield pd.DataFrame(out, columns=names)

    shape = "start long, texts array<string>, counts array<long>, scores array<double>, total double, n long, w_texts array<string>, w_at binary, w_ts binary, w_frame binary, w_text binary, w_conf binary"
    rows = obs.withColumn("text", F.coalesce(normalize_text(F.col("text")), F.lit(""))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)).cast("double"))
    rows = rows.withColumn("at_ms", F.unix_millis("at")).withWatermark("at", late).groupBy("video_id")
    schema = "video_id long, start_ms long, end_ms long, text string, confidence double, observation_count long, alternatives array<string>, needs_review boolean"
    return rows.applyInPandasWithState(walk, schema, shape, "append", GroupStateTimeout.EventTimeTimeout)
