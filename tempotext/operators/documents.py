"""Documents of a video: transcripts and caption files, decisions on windows, sentences, replies of recognisers.

One document belongs to one video, so lists are collected by video or by window, never over all rows. Null texts count as
empty and are left out where empty ones are; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import content_key, fingerprint, format_timestamp, join_pieces, made_once, normalize_text, parse_timestamp, squeeze, unescape, without_tags
from .cues import CONTEXT, SPAN, merge_cues, window_context

# Marks and patterns of the transcript format.
REVIEW_MARK, ANNOTATION = " ⚠️", "【画面补充】"
TIMED_LINE = r"(?s)^\s*[-*+]\s+\[(\d{2}(?::\d{2})?:\d{2}\.\d{3})\s*[–—-]\s*(\d{2}(?::\d{2})?:\d{2}\.\d{3})\]\s*(.*?)\s*$"
TIMING = r"((?:\d{2,}:)?\d{2}:\d{2}[.,]\d{3})\s*-->\s*((?:\d{2,}:)?\d{2}:\d{2}[.,]\d{3})"
SOURCES = ("youtube_primary+burned_ocr_visual_verification", "burned_ocr+youtube_reading_reference", "burned_ocr")
PLACEHOLDER = "_在配置的字幕区域中未检测到文字。_"
FORMATS = {"json3": 0, "vtt": 1, "srv3": 2, "ttml": 3}


def _listed(order: str, value: str):
    """Values of a group in the order of a column."""
    return F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])


def write_transcript(segments: DataFrame) -> DataFrame:
    """(video_id, body): a line for each segment in time order, with the marks of annotations and of doubt."""
    text = F.concat(F.when(F.col("is_annotation"), ANNOTATION).otherwise(""), F.replace(F.coalesce("text", F.lit("")), F.lit("\n"), F.lit("<br>")))
    line = F.concat(F.lit("- ["), format_timestamp(F.col("start_ms")), F.lit("–"), format_timestamp(F.col("end_ms")), F.lit("] "), text, F.when(F.col("needs_review"), REVIEW_MARK).otherwise(""))
    rows = segments.select("video_id", F.struct("start_ms", "n").alias("at"), line.alias("line"))
    return rows.groupBy("video_id").agg(F.array_join(_listed("at", "line"), "\n").alias("body"))


def transcript_files(videos: DataFrame, segments: DataFrame) -> DataFrame:
    """(video_id, body): a whole file for each video (video_id, title, source_url, model, language): front matter, heading, lines.

    Segments have ``source``, which names the front matter's subtitle source and the annotations; a video without any gets the
    placeholder. Values are JSON strings; null ones are empty.
    """
    s = segments.withColumn("is_annotation", F.coalesce(F.col("source") == "screen_annotation", F.lit(False)))
    any_ = lambda x: F.coalesce(F.bool_or(F.col("source") == x), F.lit(False))
    label = F.when(any_("youtube_primary"), SOURCES[0]).when(any_("burned_ocr_corrected"), SOURCES[1]).otherwise(SOURCES[2])
    facts = s.groupBy("video_id").agg(label.alias("label"), F.count("*").alias("size"))
    v = videos.join(write_transcript(s), "video_id", "left").join(facts, "video_id", "left")

    def line(name: str, value: Column) -> Column:
        quoted = F.regexp_extract(F.to_json(F.struct(F.coalesce(value.cast("string"), F.lit("")).alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
        return F.concat(F.lit(f"{name}: "), quoted)

    head = [line("title", F.col("title")), line("video_id", F.col("video_id")), line("source_url", F.col("source_url")), line("subtitle_source", F.coalesce("label", F.lit(SOURCES[2])))]
    head += [F.lit('ocr_backend: "cloud_vlm"'), line("ocr_model", F.col("model")), line("language", F.col("language")), F.concat(F.lit("segments: "), F.coalesce("size", F.lit(0)).cast("string"))]
    title = F.concat(F.lit("# "), F.coalesce("title", F.lit("")))
    return v.select("video_id", F.concat_ws("\n", F.lit("---"), *head, F.lit("---"), F.lit(""), title, F.lit(""), F.coalesce("body", F.lit(PLACEHOLDER)), F.lit("")).alias("body"))


def read_timed_transcript(bodies: DataFrame) -> DataFrame:
    """(video_id, id, text, start_ms, end_ms): fragments of the timed lines of ``body``; ids count the kept lines only."""
    lines = bodies.select("video_id", F.posexplode(F.split("body", r"\r\n|[\r\n]")).alias("pos", "line")).where(F.col("line").rlike(TIMED_LINE))
    part = lambda k: F.regexp_extract("line", TIMED_LINE, k)
    # The line is taken apart first, then each part is read, so no pattern is matched again wherever its part is named.
    cut = lines.select("video_id", "pos", made_once(a=part(1), b=part(2), raw=without_tags(F.regexp_replace(part(3), r"\s*⚠\x{FE0F}?\s*$", ""))))
    read = made_once(text=join_pieces(F.split(unescape(F.col("raw")), "\n")), start_ms=parse_timestamp(F.col("a")), end_ms=parse_timestamp(F.col("b")))
    kept = cut.select("video_id", "pos", read).where("text <> ''")
    rank = F.row_number().over(W.partitionBy("video_id").orderBy("pos"))
    return kept.select("video_id", F.format_string("seg%06d", rank).alias("id"), "text", "start_ms", "end_ms")


def read_vtt_captions(files: DataFrame) -> DataFrame:
    """Cues of WebVTT texts (video_id, vtt): markup and character references decoded, empty ones dropped, then merged."""
    blocks = files.select("video_id", F.posexplode(F.split(F.regexp_replace("vtt", r"\r\n?", "\n"), r"\n[ \t]*\n")).alias("n", "block")).where(F.col("block").rlike(TIMING))
    at = lambda k: F.regexp_extract("block", TIMING, k)
    cut = blocks.select("video_id", "n", made_once(a=at(1), b=at(2), raw=without_tags(F.regexp_replace("block", r"(?s)^.*?-->[^\n]*(\n|\z)", ""))))
    read = made_once(start_ms=parse_timestamp(F.col("a")), end_ms=parse_timestamp(F.col("b")), text=squeeze(unescape(F.col("raw"))))
    return merge_cues(cut.select("video_id", "n", read).where("text <> ''"))


def read_json3_captions(files: DataFrame) -> DataFrame:
    """Cues of JSON3 caption texts (video_id, json3): events without segments and empty texts are dropped, then merged."""
    schema = "events array<struct<tStartMs: long, dDurationMs: long, segs: array<struct<utf8: string>>>>"
    events = files.select("video_id", F.posexplode(F.from_json("json3", schema)["events"]).alias("n", "e")).where("e.segs is not null")
    start = F.greatest(F.lit(0), F.coalesce("e.tStartMs", F.lit(0)))
    cut = events.select("video_id", "n", made_once(start_ms=start, end_ms=start + F.greatest(F.lit(1), F.coalesce("e.dDurationMs", F.lit(0))), raw=without_tags(F.array_join("e.segs.utf8", ""))))
    rows = cut.select("video_id", "n", "start_ms", "end_ms", made_once(text=squeeze(unescape(F.col("raw")))))
    return merge_cues(rows.where("text <> ''"))


def select_caption_track(tracks: DataFrame, preferred: list[str]) -> DataFrame:
    """One track (video_id, kind, language, ext, pos) a video.

    Tracks in a preferred language (equal, or of the same base) come before all others, manual before automatic, then the
    order of preference, the language's first position, the format and the position. No url or live chat: never.
    """
    base = lambda c: F.substring_index(F.lower(c), "-", 1)
    wish = F.coalesce(*[F.when(base(F.col("language")) == x.lower().split("-")[0], i) for i, x in enumerate(preferred)], F.lit(len(preferred)))
    form = F.coalesce(*[F.when(F.col("ext") == x, i) for x, i in FORMATS.items()], F.lit(99))
    first = F.min("pos").over(W.partitionBy("video_id", "kind", "language"))
    rank = F.struct((wish == len(preferred)).cast("int").alias("a"), (F.col("kind") != "manual").cast("int").alias("b"), wish.alias("c"), F.col("first").alias("d"), form.alias("e"), F.col("pos").alias("f"))
    usable = tracks.withColumn("first", first).where("url <> '' and language <> 'live_chat'")
    return usable.groupBy("video_id").agg(F.min_by(F.struct("kind", "language", "ext", "pos"), rank).alias("x")).select("video_id", "x.*")


def resolve_output_names(files: DataFrame) -> DataFrame:
    """(id, ord, name): the first of a stem has the stem itself, others the id in brackets, counted from the second of an id."""
    firsts = files.groupBy("stem").agg(F.min(F.struct("id", "ord")).alias("first"))
    both = files.join(firsts, "stem").withColumn("own", F.struct("id", "ord") == F.col("first"))
    k = F.row_number().over(W.partitionBy("stem", "id", "own").orderBy("ord"))
    bracket = F.concat("stem", F.lit(" ["), F.col("id").cast("string"), F.when(k > 1, F.concat(F.lit("-"), k.cast("string"))).otherwise(""), F.lit("]"))
    return both.select("id", "ord", F.when(F.col("own"), F.col("stem")).otherwise(bracket).alias("name"))


# ---- decisions -------------------------------------------------------------------------------------------------------


def resolve_decision_spans(decisions: DataFrame, cues: DataFrame) -> DataFrame:
    """Decisions (video_id, ord, ids) with start, end, count and texts of the rows (video_id, n) they name; unknown ids are ignored."""
    named = decisions.select("video_id", "ord", F.posexplode("ids").alias("pos", "n")).join(cues.select("video_id", "n", "start_ms", "end_ms", F.col("text").alias("cue")), ["video_id", "n"])
    return named.groupBy("video_id", "ord").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("observation_count"), _listed("pos", "cue").alias("texts"))


def union_document(spoken: DataFrame, annotations: DataFrame, cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Spoken rows, sure (0.92) or to be seen again (0.72), and annotations with mean confidence and summed observations."""
    s = spoken.select("video_id", "ord", "text", "recheck").join(resolve_decision_spans(spoken, cues), ["video_id", "ord"])
    s = s.select("video_id", "ord", F.lit("youtube_primary").alias("source"), "start_ms", "end_ms", F.trim("text").alias("text"), F.when(F.col("recheck"), 0.72).otherwise(0.92).alias("confidence"), "observation_count")
    seen = annotations.select("video_id", "ord", F.explode("ids").alias("n")).join(segments.select("video_id", "n", "start_ms", "end_ms", "confidence", "observation_count"), ["video_id", "n"])
    seen = seen.groupBy("video_id", "ord").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.avg("confidence").alias("confidence"), F.sum("observation_count").alias("observation_count"))
    a = annotations.select("video_id", "ord", F.trim("text").alias("text")).join(seen, ["video_id", "ord"]).withColumn("source", F.lit("screen_annotation"))
    return s.unionByName(a)


def sort_reconciled(document: DataFrame) -> DataFrame:
    """``rank`` of each row in its video: by start, spoken first, then in the order of decision."""
    return document.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy("start_ms", F.col("source") == "screen_annotation", "ord")))


def validate_window_decisions(decisions: DataFrame, cues: DataFrame, span_ms: int = SPAN) -> DataFrame:
    """(video_id, window_index, valid): the decisions' ids (video_id, window_index, ord, ids) are the window's cues, once each, in order."""
    want = cues.groupBy("video_id", F.expr(f"start_ms div {span_ms}").alias("window_index")).agg(F.array_sort(F.collect_list("n")).alias("want"))
    have = decisions.groupBy("video_id", "window_index").agg(F.flatten(_listed("ord", "ids")).alias("have"))
    return want.join(have, ["video_id", "window_index"], "left").select("video_id", "window_index", F.coalesce(F.col("want") == F.col("have"), F.lit(False)).alias("valid"))


def validate_window_sources(decisions: DataFrame, segments: DataFrame, span_ms: int = SPAN, context_ms: int = CONTEXT) -> DataFrame:
    """(video_id, window_index, valid): recognised ids (``ocr_ids``) of the decisions (kind: spoken or annotation) are allowed ones.

    Those of spoken rows lie in the window or its context; those of annotations are rows that start in it, each used once.
    """
    ids = decisions.select("video_id", "window_index", "kind", F.explode("ocr_ids").alias("n"))
    known = window_context(segments.select("video_id", "n", "start_ms", "end_ms"), span_ms, context_ms)
    used = ids.groupBy("video_id", "window_index", "n").agg(F.count_if(F.col("kind") == "annotation").alias("notes")).join(known, ["video_id", "window_index", "n"], "left")
    bad = used.where("target is null or (notes > 0 and not target) or notes > 1").select("video_id", "window_index").distinct().withColumn("valid", F.lit(False))
    return decisions.select("video_id", "window_index").distinct().join(bad, ["video_id", "window_index"], "left").select("video_id", "window_index", F.coalesce("valid", F.lit(True)).alias("valid"))


def previous_tail(rows: DataFrame, span_ms: int = SPAN, most: int = 3) -> DataFrame:
    """(video_id, window_index, tail): the last ``most`` rows, as (n, text), of the window with rows before this one; none: empty."""
    w = rows.groupBy("video_id", F.expr(f"start_ms div {span_ms}").alias("window_index")).agg(F.array_sort(F.collect_list(F.struct("n", "text"))).alias("all"))
    last = F.slice("all", F.greatest(F.size("all") - most + 1, F.lit(1)), F.lit(most))
    before = F.lag(last).over(W.partitionBy("video_id").orderBy("window_index"))
    return w.select("video_id", "window_index", F.coalesce(before, F.slice("all", 1, 0)).alias("tail"))


# ---- sentences and replies -------------------------------------------------------------------------------------------


def proportional_retime(pieces: DataFrame) -> DataFrame:
    """Pieces (video_id, n, pos, unit, start_ms, end_ms of the whole) share its span by content length, one at least; the last ends with it."""
    w = W.partitionBy("video_id", "n")
    p = pieces.withColumn("weight", F.greatest(F.lit(1), F.length(content_key(F.col("unit")))))
    done, total = F.sum("weight").over(w.orderBy("pos")), F.sum("weight").over(w)
    stop = F.greatest(F.col("start_ms"), F.col("end_ms"))
    at = lambda c: (F.col("start_ms") + F.rint(F.greatest(F.lit(1), stop - F.col("start_ms")) * c / total)).cast("long")
    timed = p.select("video_id", "n", "pos", "unit", at(done - F.col("weight")).alias("unit_start"), F.when(done == total, stop).otherwise(at(done)).alias("unit_end"))
    return timed.withColumn("unit_end", F.greatest("unit_start", "unit_end"))


def parse_recognition_replies(replies: DataFrame) -> DataFrame:
    """(video_id, frame_id, text, confidence, line_count) of replies: JSON between the first and last brace, fences around it ignored.

    Texts are normalised: blank lines go. Missing confidence is 0.5; lines are those of the text or as many as the reply
    states. A reply without JSON gives no row.
    """
    schema = "frames array<struct<frame_id: long, text: string, confidence: double, line_count: long>>"
    frames = F.from_json(F.regexp_extract("reply", r"(?s)\{.*\}", 0), schema)["frames"]
    rows = replies.select("video_id", F.explode(frames).alias("f")).select("video_id", "f.*").withColumn("text", normalize_text(F.coalesce("text", F.lit(""))))
    lines = F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    return rows.select("video_id", "frame_id", "text", F.coalesce("confidence", F.lit(0.5)).alias("confidence"), F.greatest(lines, F.coalesce("line_count", F.lit(0))).alias("line_count"))


def retry_missing(requested: DataFrame, answers: DataFrame) -> DataFrame:
    """Requested frames (video_id, frame_index) that no answer names."""
    return requested.join(answers.select("video_id", F.col("frame_id").alias("frame_index")), ["video_id", "frame_index"], "left_anti")
