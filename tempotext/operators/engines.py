"""Jobs with a user's function: recognition, boundaries, corrections, windows and their second pass.

A function gets pandas frames of one batch, chunk or window (with its context) and returns one; what it returns is checked
against the ids it was asked for before use. One marked ``plain`` gets and gives columns as lists ({name: list}) instead: a frame
costs more than most batches and windows do. Functions are called in tasks, so they must not keep state between calls, and
a lost executor calls them again. Null texts are passed on as they are; empty tables call nothing and give empty tables.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StringType

from ..functions.blocks import matching
from ..functions.similarity import safe_correction
from ..functions.text import COMPARED
from ..sources.shared import kept
from .alignment import PART, align_streams, placed
from .cues import CONTEXT, SPAN, chunk_with_context, window_context
from .documents import retry_missing
from .reuse import reference_conflict, validate_corrections
from .sentences import CLOSING, TERMINAL, validate_boundaries
from .times import overlapping

#: Characters of units and sentences up to which a video is cut by a reference in one task.
WHOLE = 1 << 17
#: Rows of a frame that a task gives back; each costs some milliseconds on its way.
ROWS = 2_000
ANSWER = "video_id {0}, frame_id long, text string, confidence double, line_count long"
#: A window's result: the tail it was given and its decisions.
_MADE = "kind: string, cue_ids: array<bigint>, ocr_ids: array<bigint>, text: string, recheck: boolean"
RESULT = "video_id {0}, window_index long, tail array<string>, decisions array<struct<" + _MADE + ">>"


def _spread(df: DataFrame, *keys) -> DataFrame:
    """By keys over the session's shuffle partitions, not fewer for few rows: the function's time counts, not the rows' size."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _key_type(df: DataFrame) -> str:
    return df.schema["video_id"].dataType.simpleString()


def plain(fn: Callable) -> Callable:
    """Marks a function whose batches or windows are columns as lists ({name: list}), and whose result is as well."""
    fn.plain = True
    return fn


def _is_plain(fn: Callable | None) -> bool:
    return getattr(fn, "plain", False)


def _cells(made, name: str) -> list:
    """A column of a function's result."""
    return made[name] if isinstance(made[name], list) else made[name].tolist()


def _groups(
    frames: Iterator[pd.DataFrame], keys: list[str], most: int | None = None, heads: tuple[str, ...] = (), seen: list[str] | None = None, lists: bool = False
) -> Iterator[tuple[tuple, pd.DataFrame | dict[str, list]]]:
    """Runs of equal keys in sorted frames, cut at ``most`` rows; a run may go on over frames, only its rest is kept.

    Each comes with its first row's values of ``heads``, or of the keys, and with the columns ``seen``, or all, as a frame or as ``lists``.
    """
    rest: pd.DataFrame | None = None
    names = heads or keys

    def cut(pdf: pd.DataFrame, at: list[int]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        shown, first = pdf[seen] if seen else pdf, [pdf[c].iloc[at[:-1]].tolist() for c in names]
        columns = {c: shown[c].iloc[: at[-1]].tolist() for c in shown} if lists else {}
        for *head, a, b in zip(*first, at, at[1:]):
            for i in range(a, b, most or b - a):
                end = min(b, i + (most or b - a))
                yield tuple(head), {c: x[i:end] for c, x in columns.items()} if lists else shown.iloc[i:end]

    for pdf in frames:
        if not len(pdf):
            continue
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        new = np.zeros(len(pdf), bool)
        new[0] = True
        for c in keys:
            x = pdf[c].to_numpy()
            new[1:] |= x[1:] != x[:-1]
        at = np.flatnonzero(new).tolist()
        if most:
            at[-1:] = [at[-1], at[-1] + (len(pdf) - at[-1] - 1) // most * most] if len(pdf) - at[-1] > most else at[-1:]
        yield from cut(pdf, at)
        rest = pdf.iloc[at[-1] :]
    if rest is not None:
        yield from cut(rest, [0, len(rest)])


def _ask(frames: DataFrame, fn: Callable, size: int) -> DataFrame:
    schema = ANSWER.format(_key_type(frames))
    names = [x.split()[0] for x in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, rows = [], 0
        for (video,), batch in _groups(parts, ["video_id"], size, lists=_is_plain(fn)):
            got = fn(batch)
            asked, taken = set(_cells(batch, "frame_index")), []
            for k, x in enumerate(_cells(got, "frame_id")):
                if x in asked:
                    asked.discard(x)
                    taken.append(k)
            cells = [_cells(got, c) for c in names[1:]]
            out += [(video, *(c[k] for c in cells)) for k in taken]
            rows += len(taken)
            if rows >= ROWS:
                yield pd.DataFrame(out, columns=names)
                out, rows = [], 0
        yield pd.DataFrame(out, columns=names)

    by_video = _spread(frames.where("video_id is not null and frame_index is not null"), "video_id", F.expr("frame_index div 4096")).sortWithinPartitions("video_id", "frame_index")
    return by_video.mapInPandas(run, schema)


def recognize_frames(frames: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], batch_size: int = 4) -> DataFrame:
    """(video_id, frame_id, text, confidence, line_count): answers of ``fn`` for frames (video_id, frame_index, ...), one a frame.

    ``fn`` gets up to ``batch_size`` frames of one video and returns (frame_id, text, confidence, line_count), both as lists if it is ``plain``. Answers for
    other frames are dropped; of several for a frame the first counts. Frames without an answer are asked once more, alone;
    those that have none then come with null text, confidence and line count.
    """
    first = kept(_ask(frames, fn, batch_size), "answers")
    again = kept(_ask(retry_missing(frames, first), fn, 1), "answers")
    both = first.unionByName(again)
    asked = frames.where("video_id is not null and frame_index is not null").select("video_id", F.col("frame_index").cast("long").alias("frame_id")).distinct()
    return asked.join(both, ["video_id", "frame_id"], "left").select("video_id", "frame_id", "text", "confidence", "line_count")


def ends_with_mark(before: pd.DataFrame, target: pd.DataFrame, after: pd.DataFrame) -> pd.DataFrame:
    """The default boundaries: after each unit that ends in a sentence mark, closers apart."""
    marks = tuple(TERMINAL)
    own = [(n, len(x)) for n, x in zip(target["n"].tolist(), target["text"].tolist()) if x and x.rstrip(CLOSING).endswith(marks)]
    return pd.DataFrame({"n": [n for n, _ in own], "after_char": [k for _, k in own]}, dtype="int64")


def _chunks(units: DataFrame, size: int, context: int) -> DataFrame:
    """``units`` by chunk, each with ``part``: 0 before, 1 in, 2 after it; a partition holds chunks in order, and a chunk its parts in order."""
    part = F.when(F.col("role") == "before", 0).when(F.col("role") == "target", 1).otherwise(2)
    rows = chunk_with_context(units.select("video_id", "n"), size, context).join(units, ["video_id", "n"]).withColumn("part", part)
    return _spread(rows, "video_id", "chunk").sortWithinPartitions("video_id", "chunk", "part", "n")


def decide_boundaries(units: DataFrame, fn: Callable = ends_with_mark, size: int = 100, context: int = 10) -> DataFrame:
    """(video_id, n, after_char): valid cuts of units (video_id, n, text) that ``fn`` proposes for chunks of ``size`` units.

    ``fn`` gets the units (n, text) before, in and after a chunk and returns (n, after_char). Cuts of context units, of
    unknown units and at places that are no candidates are dropped.
    """
    schema = f"video_id {_key_type(units)}, n long, after_char long"

    units = kept(units.select("video_id", "n", "text"), "units")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = []
        for (video, _), chunk in _groups(frames, ["video_id", "chunk"], seen=["n", "text", "part"]):
            at, shown = np.searchsorted(chunk["part"].to_numpy(), [0, 1, 2, 3]), chunk.iloc[:, :2]
            parts = [shown.iloc[a:b] for a, b in zip(at, at[1:])]
            got, own = fn(*parts), set(parts[1]["n"].tolist())
            out += [(video, n, k) for n, k in zip(got["n"].tolist(), got["after_char"].tolist()) if n in own]
            if len(out) >= ROWS:
                yield pd.DataFrame(out, columns=["video_id", "n", "after_char"])
                out = []
        yield pd.DataFrame(out, columns=["video_id", "n", "after_char"])

    cuts = _chunks(units, size, context).mapInPandas(run, schema)
    checked = validate_boundaries(cuts, units.select("video_id", "n", "text").withColumn("target", F.lit(True)))
    return checked.where("reason = ''").select("video_id", "n", "after_char").distinct()


def adopt_reference(segments: DataFrame) -> DataFrame:
    """The default corrections of segments (video_id, n, text, reference: list): the first reference that conflicts and is safe."""
    pairs = segments.select("video_id", "n", "text", F.posexplode("reference").alias("ord", "reference"))
    safe = pairs.where(safe_correction(F.col("text"), F.col("reference")))
    hit = reference_conflict(safe, "video_id", "n", "text", "ord", "reference").where("conflict")
    first = hit.groupBy("video_id", "n").agg(F.min_by("reference", "ord").alias("corrected_text"))
    return first.select("video_id", "n", F.lit(0).cast("long").alias("ord"), "corrected_text")


def propose_corrections(segments: DataFrame, fn: Callable | None = None, size: int = 100, context: int = 10) -> DataFrame:
    """(video_id, n, corrected_text, status) for segments (video_id, n, text, reference: list of near captions).

    ``fn`` gets a chunk of ``size`` segments with context (n, text, reference, target) and returns (n, corrected_text), its
    last proposal of a segment counts; without one it is the native ``adopt_reference``. Segments in conflict with a
    reference and without a proposal are ``missing``.
    """
    if fn is None:
        made = adopt_reference(segments)
    else:
        schema = f"video_id {_key_type(segments)}, n long, ord long, corrected_text string"

        segments = kept(segments.select("video_id", "n", "text", "reference"), "segments")
        names = ["video_id", "n", "ord", "corrected_text"]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = []
            for (video, _), chunk in _groups(frames, ["video_id", "chunk"], seen=["n", "text", "reference", "target"]):
                a, b = np.searchsorted(chunk["target"].to_numpy(), [1, 2])
                own = set(chunk["n"].iloc[a:b].tolist())
                shown = chunk.assign(target=chunk["target"] == 1).sort_values("n", kind="stable")
                got = fn(shown)
                out += [(video, n, *x) for n, x in zip(got["n"].tolist(), enumerate(got["corrected_text"].tolist())) if n in own]
                if len(out) >= ROWS:
                    yield pd.DataFrame(out, columns=names)
                    out = []
            yield pd.DataFrame(out, columns=names)

        made = kept(_chunks(segments, size, context).withColumnRenamed("part", "target").mapInPandas(run, schema), "corrections")
    pairs = segments.select("video_id", "n", "text", F.explode("reference").alias("reference"))
    conflict = reference_conflict(pairs, "video_id", "n")
    targets = segments.select("video_id", "n").distinct().join(conflict, ["video_id", "n"], "left").withColumn("conflict", F.coalesce("conflict", F.lit(False)))
    return validate_corrections(made, targets)


@plain
def spoken_per_cue(window: pd.DataFrame | dict[str, list], tail: list[str]) -> pd.DataFrame | dict[str, list]:
    """The default decisions: a spoken row for each target cue; lists for lists, a frame for a frame."""
    if isinstance(window, dict):
        rows = [(n, x) for role, target, n, x in zip(window["role"], window["target"], window["n"], window["text"]) if target and role == "cue"]
        return {"kind": ["spoken"] * len(rows), "cue_ids": [[n] for n, _ in rows], "ocr_ids": [[] for _ in rows], "text": [x for _, x in rows], "recheck": [False] * len(rows)}
    own = np.flatnonzero((window["role"].to_numpy() == "cue") & window["target"].to_numpy(bool))
    return pd.DataFrame({"kind": "spoken", "cue_ids": [[n] for n in window["n"].to_numpy()[own].tolist()], "ocr_ids": [[] for _ in own], "text": window["text"].to_numpy()[own].tolist(), "recheck": False})


def _rows(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, role, n, start_ms, end_ms, text) of cues and recognised segments that have ids."""

    def side(rows: DataFrame, role: str) -> DataFrame:
        own = rows.select("video_id", F.lit(role).alias("role"), F.col("n").cast("long").alias("n"), F.col("start_ms").cast("long").alias("start_ms"), F.col("end_ms").cast("long").alias("end_ms"), "text")
        return own.where("video_id is not null and n is not null")

    return side(cues, "cue").unionByName(side(segments, "ocr"))


_SEEN = ["role", "n", "start_ms", "end_ms", "text", "target"]


def _to_see_again(made: pd.DataFrame | dict[str, list], window: pd.DataFrame | dict[str, list]) -> list[int]:
    """Recognised ids that flagged decisions name, once each; all of the window's own if a flagged spoken one and none names any."""
    flagged = [k for k, x in enumerate(_cells(made, "recheck")) if x]
    if not flagged:
        return []
    named, kind = _cells(made, "ocr_ids"), _cells(made, "kind")
    ids = [x for k in flagged for x in (named[k] if named[k] is not None else [])]
    if not ids and any(kind[k] == "spoken" for k in flagged):
        ids = [n for role, target, n in zip(*(_cells(window, c) for c in ("role", "target", "n"))) if target and role == "ocr"]
    return list(dict.fromkeys(ids))


def _with_reread(window: pd.DataFrame | dict[str, list], again) -> pd.DataFrame | dict[str, list] | None:
    """A window with the texts (id, text) that were read again and aren't blank; None if all are."""
    rows = [(n, x) for n, x in zip(_cells(again, "id"), _cells(again, "text")) if isinstance(x, str) and x.strip()]
    if not rows:
        return None
    more = {"role": ["reread"] * len(rows), "n": [n for n, _ in rows], "text": [x for _, x in rows], "target": [False] * len(rows)}
    if isinstance(window, dict):
        return {c: window[c] + more.get(c, [None] * len(rows)) for c in _SEEN}
    return pd.concat([window, pd.DataFrame(more).reindex(columns=_SEEN)], ignore_index=True)


def _walk(rows: DataFrame, fn: Callable, review: Callable | None, most: int) -> DataFrame:
    """Results of windows of rows with ``run`` and ``before``: the windows of a run go one after the other, the first with the tail ``before``.

    All rows of a run are in one partition. Windows in which no row starts, those that long rows only pass through, are left out.
    """
    schema = RESULT.format(_key_type(rows))
    fields = [x.split(":")[0] for x in _MADE.split(", ")]
    names = [x.split()[0] for x in schema.split(", ")[:4]]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, tail, out, rows = None, [], [], 0
        for (video, run_, index, before), seen in _groups(parts, ["video_id", "run", "window_index"], None, ("video_id", "run", "window_index", "before"), _SEEN, _is_plain(fn)):
            if not any(_cells(seen, "target")):
                continue
            tail = tail if (video, run_) == last else list(before)
            made = fn(seen, tail)
            ids = _to_see_again(made, seen) if review else []
            if ids:
                again = _with_reread(seen, review(ids, seen))
                if again is not None:
                    made = fn(again, tail)
            result = [dict(zip(fields, x)) for x in zip(*(_cells(made, c) for c in fields))]
            out.append((video, index, tail, result))
            rows += 1 + len(result)
            if rows >= ROWS:
                yield pd.DataFrame(out, columns=names)
                out, rows = [], 0
            last, tail = (video, run_), [x["text"] for x in result if x["kind"] == "spoken"][-most:] if most else []
        yield pd.DataFrame(out, columns=names)

    return rows.sortWithinPartitions("video_id", "run", "window_index", "role", "n").mapInPandas(run, schema)


def decisions_of(results: DataFrame) -> DataFrame:
    """(video_id, window_index, ord, kind, cue_ids, ocr_ids, text, recheck), one row for each decision of the windows' results."""
    return results.select("video_id", "window_index", F.posexplode("decisions").alias("ord", "x")).select("video_id", "window_index", F.col("ord").cast("long").alias("ord"), "x.*")


def reconcile_windows(
    cues: DataFrame, segments: DataFrame, fn: Callable = spoken_per_cue, in_order: bool = False, span_ms: int = SPAN, context_ms: int = CONTEXT, most: int = 3, review: Callable | None = None
) -> DataFrame:
    """(video_id, window_index, ord, kind, cue_ids, ocr_ids, text, recheck): decisions of ``fn`` on each window of cues and recognised segments.

    ``fn(window, tail)`` gets the rows (role: cue or ocr, n, start_ms, end_ms, text, target) of a window and its context and
    returns (kind: spoken or annotation, cue_ids, ocr_ids, text, recheck), frames or, if it is ``plain``, lists. With ``in_order`` the windows of a video run one after the
    other in one task, streamed, with the last ``most`` spoken texts of the window before; else every window runs on its own
    and ``tail`` is empty. Check the result with ``validate_window_decisions`` and ``validate_window_sources``.

    With ``review(ids, window)``, which gets the window as ``fn`` does and returns (id, text), the recognised rows that flagged decisions name are read again: those of all
    the window's own segments if a spoken one is flagged and none names any. If some text comes back, ``fn`` decides once more with
    those as rows of role ``reread`` and the same tail, and the next window's tail is of what it decides then.
    """
    # A text goes to its video's partition once and meets its windows there.
    own = _spread(_rows(cues, segments), "video_id") if in_order else _rows(cues, segments)
    rows = window_context(own, span_ms, context_ms, "role", "start_ms", "end_ms", "text")
    rows = rows.withColumn("run", F.lit(0).cast("long") if in_order else F.col("window_index")).withColumn("before", F.array().cast("array<string>"))
    rows = rows if in_order else _spread(rows, "video_id", "run")
    return decisions_of(_walk(rows, fn, review, most if in_order else 0))


def second_pass(cues: DataFrame, segments: DataFrame, fn: Callable, review: Callable, span_ms: int = SPAN, context_ms: int = CONTEXT, most: int = 3) -> DataFrame:
    """Decisions of all windows, in order, where flagged ones are read again by ``review`` and decided once more within their window."""
    return reconcile_windows(cues, segments, fn, True, span_ms, context_ms, most, review)


def printed(rows: DataFrame, config: str, span_ms: int, context_ms: int, more: Column | None = None) -> DataFrame:
    """(video_id, window_index, print) of the windows in which a row of ``_rows`` starts, and the aggregate ``more`` over the cues (n, text; else null) that start in each.

    A window's rows are added up, whatever their order: 120 bits of each one's SHA-256, for its own rows and for all. So partial sums travel, not rows.
    """
    mark = F.sha2(F.to_json(F.struct("role", "n", "start_ms", "end_ms", "text")), 256)
    part = lambda at: F.conv(F.substring("mark", at, 15), 16, 10).cast("decimal(20,0)")
    marked = rows.withColumn("mark", mark).withColumns({"mark1": part(1), "mark2": part(16)})
    w = window_context(marked, span_ms, context_ms, "role", "text", "mark1", "mark2")
    own = F.col("target") & (F.col("role") == "cue")
    w = w.select("video_id", "window_index", "target", "mark1", "mark2", F.when(own, F.col("n")).alias("n"), F.when(own, F.col("text")).alias("text"))
    sums = [F.sum(x) for c in ("mark1", "mark2") for x in (F.col(c), F.when(F.col("target"), F.col(c)))]
    sums = F.concat_ws(",", F.count("*").cast("string"), *[F.coalesce(x, F.lit(0)).cast("string") for x in sums])
    w = w.groupBy("video_id", "window_index").agg(F.max("target").alias("own_rows"), sums.alias("all"), *([] if more is None else [more])).where("own_rows")
    return w.withColumn("print", F.sha2(F.concat(F.lit(config), F.lit("\x1f"), "all"), 256)).drop("own_rows", "all")


def window_prints(cues: DataFrame, segments: DataFrame, config: str = "", span_ms: int = SPAN, context_ms: int = CONTEXT) -> DataFrame:
    """(video_id, window_index, print) of the windows in which a row starts: over all rows of a window and its context, with role, times and text, and the configuration.

    Rows are summed up before they are dealt to their windows, so texts aren't shuffled.
    """
    return printed(_rows(cues, segments), config, span_ms, context_ms)


def _met(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` of the windows (video_id, window_index) that ``asked`` names, with its other columns, without a join: rows that lie by video already are not shuffled."""
    key = ["video_id", "window_index"]
    asks = asked.select(*key, F.struct(*[c for c in asked.columns if c not in key]).alias("_ask")).repartition("video_id")
    peers = W.partitionBy("video_id").orderBy("window_index").rangeBetween(W.currentRow, W.currentRow)
    both = rows.withColumn("_row", F.lit(True)).unionByName(asks, allowMissingColumns=True).withColumn("_ask", F.max("_ask").over(peers))
    return both.where("_row and _ask is not null").select(*rows.columns, "_ask.*")


def incremental_windows(
    cues: DataFrame, segments: DataFrame, saved: DataFrame | None = None, fn: Callable = spoken_per_cue, config: str = "", span_ms: int = SPAN, context_ms: int = CONTEXT, most: int = 3, review: Callable | None = None
) -> DataFrame:
    """(video_id, window_index, print, tail, decisions, round): results of all windows, of which only those that changed are computed.

    ``saved`` is what an earlier call returned (None at first). A window is computed again where its print (rows of the
    window and its context, with times, and ``config``) is new, or where the tail that it was given is no longer what
    the window before ends in. Round 1 walks each run of windows with new prints in order, beginning with the saved tail before it; each
    further round computes the windows behind those whose tail came out otherwise, until none does. So the result is that of
    a walk over all windows, and the functions' work grows with the change. ``round`` is 0 for windows that are reused.

    Windows are compared by prints; texts and saved decisions are looked up by video where they are needed and not written. ``cues``,
    ``segments`` and ``saved`` are read again for each round.
    """
    own = _rows(cues, segments)
    key = ["video_id", "window_index"]
    now = window_prints(cues, segments, config, span_ms, context_ms)
    by_video = W.partitionBy("video_id").orderBy("window_index")
    none = F.array().cast("array<string>")
    spoken = F.filter("decisions", lambda x: x["kind"] == "spoken")
    ends = F.coalesce(F.transform(F.slice(spoken, F.greatest(F.size(spoken) - most + 1, F.lit(1)), F.lit(most)), lambda x: x["text"]) if most else none, none)
    mark = lambda c: F.unhex(F.sha2(F.to_json(F.struct(c.alias("x"))), 256))
    if saved is None:
        old = now.select(*key).limit(0).select(*key, *[F.lit(None).cast(t).alias(c) for c, t in (("old", "string"), ("given", "binary"), ("ends", "binary"))])
    else:
        old = saved.select(*key, F.col("print").alias("old"), mark(F.col("tail")).alias("given"), mark(ends).alias("ends"))
    fresh = F.col("old").isNull() | (F.col("old") != F.col("print"))
    given = F.coalesce("given", mark(F.lit(None).cast("array<string>")))
    base = kept(now.join(old, key, "left").select(*key, "print", fresh.alias("fresh"), given.alias("given"), F.coalesce("ends", mark(none)).alias("ends")), "windows")
    # Windows in order are compared by the prints of their tails; texts are fetched for those that are computed.
    # A window whose predecessor came or went gets another tail; its saved end is known, so it is seen in the first round.
    light = base.select(*key, "fresh", "given", F.lag("window_index").over(by_video).alias("prior"), F.coalesce(F.lag("ends").over(by_video), mark(none)).alias("before"), F.lag("fresh").over(by_video).alias("led"))
    light = light.withColumn("dirty", F.col("fresh") | (~F.coalesce("led", F.lit(False)) & (F.col("given") != F.col("before"))))
    light = light.withColumn("run", F.sum((~F.col("dirty")).cast("long")).over(by_video)).withColumn("start", F.min(F.when(F.col("dirty"), F.col("window_index"))).over(W.partitionBy("video_id", "run")))
    light = kept(light, "order")
    # The tail before a run is that before its first window.
    heads = light.where("dirty and window_index = start").select(*key, "prior")
    if saved is None:
        heads = heads.select(*key, none.alias("before"))
    else:
        last = _met(saved.select(*key, ends.alias("before")), heads.where("prior is not null").select("video_id", F.col("prior").alias("window_index"), F.col("window_index").alias("at")))
        heads = heads.join(last.select("video_id", F.col("at").alias("window_index"), "before"), key, "left").select(*key, F.coalesce("before", none).alias("before"))
    todo = light.where("dirty").select(*key, F.col("start").alias("run")).join(heads, key, "left")
    places = window_context(own, span_ms, context_ms, "role", "start_ms", "end_ms", "text")
    parts: list[DataFrame] = []
    while not (todo := kept(todo, "todo")).isEmpty():
        made = kept(_walk(_spread(_met(places, todo), "video_id", "run"), fn, review, most).withColumn("round", F.lit(len(parts) + 1)), "made")
        # a later round's results replace earlier ones
        parts = [p.join(made.select(*key), key, "left_anti") for p in parts] + [made]
        tails = made.select("video_id", F.col("window_index").alias("prior"), ends.alias("new"))
        used = parts[0]
        for p in parts[1:]:
            used = used.unionByName(p)
        used = used.select(*key, mark(F.col("tail")).alias("used"))
        behind = light.select(*key, "prior", "given").join(tails, ["video_id", "prior"]).join(used, key, "left")
        behind = behind.where(F.coalesce("used", "given") != mark(F.col("new")))
        todo = behind.select(*key, F.col("window_index").alias("run"), F.col("new").alias("before"))
    reused = (("tail", "array<string>"), ("decisions", f"array<struct<{_MADE}>>"))
    if saved is None:
        out = base.select(*key, "print", *[F.lit(None).cast(t).alias("_" + c) for c, t in reused])
    else:
        out = base.select(*key, "print").join(saved.select(*key, *[F.col(c).alias("_" + c) for c, _ in reused]), key, "left")
    if not parts:
        return out.select(*key, "print", F.col("_tail").alias("tail"), F.col("_decisions").alias("decisions"), F.lit(0).alias("round"))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    both = out.join(made, key, "left")
    new = F.col("round").isNotNull()
    return both.select(*key, "print", F.when(new, F.col("tail")).otherwise(F.col("_tail")).alias("tail"), F.when(new, F.col("decisions")).otherwise(F.col("_decisions")).alias("decisions"), F.coalesce("round", F.lit(0)).alias("round"))


# ---- cuts from a reference -------------------------------------------------------------------------------------------

_LEFT_OUT = frozenset(COMPARED[3:-1])


@lru_cache(maxsize=1 << 16)
def _of_char(x: str) -> str:
    return "".join(y for y in unicodedata.normalize("NFKC", x) if not y.isspace() and y not in _LEFT_OUT)


def _comparable(text: str) -> list[tuple[str, int]]:
    """Characters that are compared, with the offset of the one they come from."""
    return [(y, i) for i, x in enumerate(text) for y in _of_char(x)]


def boundaries_by_reference(units: list[tuple[int, str]], sentences: list[str], least: float = 0.72) -> list[tuple[int, int]]:
    """(n, after_char) where the sentences of a reference end in the units (n, text) of the same video.

    A sentence of three characters or more counts if ``least`` of them are aligned, its last one among them, over a stretch
    at most 1.8 times (or 4 characters) as long. Sentence marks that follow, with closers after them, stay before the cut.
    """
    raw = [(n, i + 1, x) for n, text in units for i, x in enumerate(text)]
    source = [(y, k) for k, (_, _, x) in enumerate(raw) for y, _ in _comparable(x)]
    parts = [[y for y, _ in _comparable(x)] for x in sentences]
    where: dict[int, int] = {}
    for i, j, size in matching("".join(y for p in parts for y in p), "".join(y for y, _ in source)):
        where.update(zip(range(i, i + size), range(j, j + size)))
    out, end = set(), 0
    for size in map(len, parts):
        start, end = end, end + size
        if size < 3 or end - 1 not in where:
            continue
        hits = [where[k] for k in range(start, end) if k in where]
        if len(hits) < least * size or hits[-1] - hits[0] + 1 > max(size + 4, round(1.8 * size)):
            continue
        k = stop = source[where[end - 1]][1]
        for marks in (TERMINAL, CLOSING):
            while k + 1 < len(raw) and raw[k + 1][2] in marks and (marks is TERMINAL or k > stop):
                k += 1
        out.add(raw[k][:2])
    return sorted(out)


@F.pandas_udf(StringType())
def _compared(c: pd.Series) -> pd.Series:
    return pd.Series(["".join(map(_of_char, x or "")) for x in c], dtype=object)


def _after_marks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cuts behind a unit's compared character ``k``, moved past sentence marks and then closers, into the units that follow too."""
    for pdf in batches:
        out = []
        for v, n, text, k, after in zip(pdf["video_id"], pdf["n"], pdf["text"], pdf["k"], pdf["after"]):
            at = _comparable(text)[k][1]
            raw = [(n, at + 1)]
            rest = [(n, i + 1, x) for i, x in enumerate(text) if i > at] + [(m["n"], i + 1, x) for m in after for i, x in enumerate(m["text"])]
            for marks in (TERMINAL, CLOSING):
                while len(raw) <= len(rest) and rest[len(raw) - 1][2] in marks and (marks is TERMINAL or len(raw) > 1):
                    raw.append(rest[len(raw) - 1][:2])
            out.append((v, *raw[-1]))
        yield pd.DataFrame(out, columns=["video_id", "n", "after_char"])


def _followed(units: DataFrame) -> DataFrame:
    """``units`` with ``after``: units in a row behind it that hold marks only, and the marks that begin the one behind these."""
    any_ = "[" + "".join("\\" + x if x in "[]()^-\\" else x for x in TERMINAL + CLOSING) + "]*"
    w = W.partitionBy("video_id").orderBy("n")
    u = units.withColumn("_head", F.regexp_extract("text", "^" + any_, 0)).withColumn("_more", F.length("_head") < F.length("text"))
    u = u.withColumn("_g", F.sum(F.col("_more").cast("long")).over(w))
    only = F.array_sort(F.collect_list(F.when(~F.col("_more") & (F.col("text") != ""), F.struct("n", "text"))))
    g = u.groupBy("video_id", "_g").agg(only.alias("_only"), F.min(F.when(F.col("_more"), F.struct("n", F.col("_head").alias("text")))).alias("_first"))
    g = g.withColumn("_next", F.lead("_first").over(W.partitionBy("video_id").orderBy("_g"))).drop("_first")
    behind = F.concat(F.filter("_only", lambda m: m["n"] > F.col("n")), F.filter(F.array("_next"), lambda m: m.isNotNull()))
    return u.join(g.hint("merge"), ["video_id", "_g"]).withColumn("after", behind).drop("_head", "_more", "_g", "_only", "_next")


def _whole_videos(u: DataFrame, r: DataFrame, least: float) -> DataFrame:
    schema = f"video_id {_key_type(u)}, n long, after_char long"

    def run(key: tuple, own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        own, other = own.sort_values("n", kind="stable"), other.sort_values("ord", kind="stable")
        got = boundaries_by_reference(list(zip(own["n"], own["text"])), other["sentence"].to_list(), least) if len(own) and len(other) else []
        return pd.DataFrame({"video_id": pd.Series([key[0]] * len(got), dtype=object), "n": [n for n, _ in got], "after_char": [k for _, k in got]})

    return _spread(u, "video_id").groupBy("video_id").cogroup(_spread(r, "video_id").groupBy("video_id")).applyInPandas(run, schema)


def _cut_videos(u: DataFrame, r: DataFrame, least: float, whole: int) -> DataFrame:
    u = kept(placed(u.withColumn("same", _compared("text")), "n", "same"), "units")
    r = kept(placed(r.select("video_id", F.col("ord").alias("n"), _compared("sentence").alias("same")), "n", "same"), "sentences")
    blocks = align_streams(r.select("video_id", "n", F.col("same").alias("text")), u.select("video_id", "n", F.col("same").alias("text")), whole=whole)
    blocks = blocks.select("video_id", F.col("a").alias("x0"), (F.col("a") + F.col("size") - 1).alias("x1"), (F.col("b") - F.col("a")).alias("d"))
    hit = overlapping(r.select("video_id", "pos", "last").where("last - pos >= 2"), blocks.hint("merge"), ("pos", "last"), ("x0", "x1"), 0, PART)
    first, last = F.greatest("pos", "x0"), F.least("last", "x1")
    s = hit.groupBy("video_id", "pos", "last").agg(F.sum(last - first + 1).alias("hits"), F.min(first + F.col("d")).alias("from"), F.max(last + F.col("d")).alias("to"), F.max(last).alias("x"))
    size = F.col("last") - F.col("pos") + 1
    s = s.where((F.col("x") == F.col("last")) & (F.col("hits") >= least * size) & (F.col("to") - F.col("from") + 1 <= F.greatest(size + 4, F.bround(size * 1.8))))
    at = overlapping(s.select("video_id", "to"), _followed(u).hint("merge"), ("to", "to"), ("pos", "last"), 0, PART)
    kind = f"video_id {_key_type(u)}, n long, after_char long"
    return at.select("video_id", "n", "text", (F.col("to") - F.col("pos")).alias("k"), "after").mapInPandas(_after_marks, kind).distinct()


def reference_boundaries(units: DataFrame, references: DataFrame, least: float = 0.72, whole: int = WHOLE) -> DataFrame:
    """(video_id, n, after_char): cuts of units (video_id, n, text) where the sentences (video_id, ord, sentence) of captions end.

    A video of ``whole`` characters or fewer is one task's group. Longer ones are aligned in parts (``align_streams``), and what
    surrounds the alignment is joined by places; both ways give the same cuts. Rows without a video are left out, null texts are
    empty; ``n`` and ``ord`` are unique within a video.
    """
    u = units.where("video_id is not null").select("video_id", F.col("n").cast("long").alias("n"), F.coalesce("text", F.lit("")).alias("text"))
    r = references.where("video_id is not null and sentence is not null").select("video_id", "ord", "sentence")
    u, r = kept(u, "units"), kept(r, "sentences")
    sizes = u.select("video_id", F.length("text").alias("size")).unionByName(r.select("video_id", F.length("sentence").alias("size")))
    long_ = kept(sizes.groupBy("video_id").agg(F.sum("size").alias("size")).where(F.col("size") > whole).select("video_id"), "long")
    if long_.isEmpty():
        return _whole_videos(u, r, least)
    of = lambda how: (df.join(long_.hint("merge"), "video_id", how) for df in (u, r))
    return _whole_videos(*of("left_anti"), least).unionByName(_cut_videos(*of("left_semi"), least, whole))
