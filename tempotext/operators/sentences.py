"""Sentences: where units may be cut, sentences from cuts, punctuation moved back, edits and their timings.

Null texts count as empty and give no piece; repeated cuts count once; cuts of unknown units are ignored; empty tables
give empty tables. Windows run by video, so no table is ever in one task.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, LongType

from ..functions.text import conservation_key, content_key, join_pieces, made_once, split_manual_sentences, squeeze
from ..sources.shared import kept

# Marks, endings and expressions of the boundary rules.
TERMINAL, CLOSING, PAUSES = "。．.!！?？…‥", "」』）】〕〉》”’〟\"'", "、，,：:；;"
UNFINISHED = (
    "は が を に で と へ の から ので けど けれど けれども そして それで でも つまり という って たり たら なら て"
).split()
ENDINGS = (
    "ではありませんでした じゃありませんでした ませんでした ありがとうございました ではありません じゃありません ございません "
    "じゃなかった ではなかった なかった ございました いたしました お願いしました でした ました でしょうか でしょう ですか ますか "
    "ございます いたします お願いします ください ません じゃない ではない と思います と思う んです のです だった なのだ のだ "
    "ありがとう ごめんなさい すみません です ます んだ たい"
).split()
PARTICLES = "よね ですね ますね だよね かな かね ね よ か".split()
PROTECTED = (
    "ありがとうございます ありがとうございました ありがとうございません よろしくお願いします よろしくお願いいたします お願い申し上げます "
    "お願いいたします お願いできます お願いできません 失礼いたします 失礼しました いただきます いただきました いただけます いただけません "
    "ございます ございました ございません"
).split()

_RUN = re.compile(f"[{re.escape(TERMINAL)}]+[{re.escape(CLOSING)}]*")
_INNER = re.compile(f"(?:{'|'.join(ENDINGS)})(?:{'|'.join(PARTICLES)})?")
_OPEN_END = re.compile(f"(?:[{re.escape(PAUSES)}]|{'|'.join(UNFINISHED)})$")
_FIXED = [re.compile(f"(?={x})") for x in PROTECTED]
_LEAD = "^[" + re.escape(TERMINAL) + "]+[" + re.escape(CLOSING) + "]*"


def cut_offsets(text: str | None) -> list[int]:
    """Offsets after which ``text`` may end a sentence: marks, sentence endings inside, its end; none within a fixed expression."""
    if not text:
        return []
    ends = {m.end() for m in _RUN.finditer(text)}
    stops = {m.end() for m in _INNER.finditer(text)}
    ends |= {k for k in stops if k < len(text) and text[k] not in TERMINAL + PAUSES}
    if not _OPEN_END.search(text):
        ends.add(len(text))
    inside = {k for x, pattern in zip(PROTECTED, _FIXED) for m in pattern.finditer(text) for k in range(m.start() + 1, m.start() + len(x))}
    return sorted(ends - inside)


@F.pandas_udf(ArrayType(LongType()))
def boundary_candidates(s: pd.Series) -> pd.Series:
    return s.map(cut_offsets)


def validate_boundaries(cuts: DataFrame, units: DataFrame) -> DataFrame:
    """(video_id, n, after_char, reason): proposed cuts against units (video_id, n, text, target); an empty reason is a valid cut.

    One past the end counts as the end. Cuts of context units (``target`` false) are dropped, those of no unit are named.
    """
    u = units.select("video_id", "n", F.coalesce("text", F.lit("")).alias("text"), F.col("target").alias("_target"), F.lit(True).alias("_known"))
    both = cuts.join(u, ["video_id", "n"], "left").where("_known is null or _target")
    size = F.length("text")
    at = F.when(F.col("after_char") == size + 1, size).otherwise(F.col("after_char")).cast("long")
    reason = F.when(F.col("_known").isNull(), "unknown unit").when(~F.coalesce(at.between(1, size), F.lit(False)), "offset").when(~F.array_contains(boundary_candidates("text"), at), "not a candidate").otherwise("")
    return both.select("video_id", "n", at.alias("after_char"), reason.alias("reason"))


def pieces(units: DataFrame, cuts: DataFrame) -> DataFrame:
    """Units (video_id, n, text, start_ms, end_ms) cut after the given characters (video_id, n, after_char), timed by their share."""
    size = F.length("text")
    own = cuts.groupBy("video_id", "n").agg(F.collect_set(F.col("after_char").cast("int")).alias("offsets"))
    u = units.select("video_id", "n", F.coalesce("text", F.lit("")).alias("text"), "start_ms", "end_ms").where("text <> ''").join(own, ["video_id", "n"], "left")
    u = u.withColumn("offsets", F.filter(F.coalesce("offsets", F.array().cast("array<int>")), lambda x: (x > 0) & (x <= size)))
    ends = F.array_sort(F.array_union("offsets", F.array(size)))
    u = u.withColumn("ends", ends).select("*", F.posexplode("ends").alias("k", "to"))
    since = F.when(F.col("k") == 0, 0).otherwise(F.element_at("ends", F.greatest(F.col("k"), F.lit(1))))
    at = lambda c: (F.col("start_ms") + F.rint(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")) * c / size)).cast("long")
    return u.select("video_id", "n", "to", F.substr("text", since + 1, F.col("to") - since).alias("piece"), at(since).alias("start_ms"), at(F.col("to")).alias("end_ms"), F.array_contains("offsets", F.col("to")).alias("ends_here"))


def build_sentences(units: DataFrame, cuts: DataFrame) -> DataFrame:
    """(video_id, n, text, start_ms, end_ms, units): sentences between cuts, numbered from 1; the last unit always ends one."""
    order = W.partitionBy("video_id").orderBy("n", "to")
    p = pieces(units, cuts).withColumn("no", F.coalesce(F.sum(F.col("ends_here").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    listed = F.array_sort(F.collect_list(F.struct("n", "to", "piece")))
    s = p.groupBy("video_id", "no").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), listed.alias("l"))
    s = s.select("video_id", "no", join_pieces(F.col("l.piece")).alias("text"), "start_ms", "end_ms", F.array_distinct("l.n").alias("units")).where("text <> ''")
    return s.select("video_id", F.row_number().over(W.partitionBy("video_id").orderBy("no")).cast("long").alias("n"), "text", "start_ms", "end_ms", "units")


def reattach_punctuation(sentences: DataFrame) -> DataFrame:
    """Sentence marks, and closers after them, that begin a sentence go to the one before with their share of time.

    A sentence of marks only vanishes; the first stays as it is. Every row gives its marks to the last sentence that stays,
    so chains need no loop: the number of stayers up to a row names it.
    """
    order = W.partitionBy("video_id").orderBy("n")
    s = sentences.withColumn("lead", F.when(F.row_number().over(order) > 1, F.regexp_extract("text", _LEAD, 0)).otherwise(""))
    size = F.length("lead")
    s = s.withColumns({"rest": F.substr("text", size + 1, F.length("text")), "mid": (F.col("start_ms") + F.rint(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms")) * size / F.greatest(F.lit(1), F.length("text")))).cast("long")})
    stays = (F.col("rest") != "").cast("long")
    s = s.withColumn("no", F.sum(stays).over(order))
    part = lambda no, k, text, start, end: F.struct(no.alias("no"), k.alias("k"), text.alias("part"), start.alias("s"), end.alias("e"))
    none = F.lit(None).cast("long")
    both = F.array(part(F.col("no") - stays, F.lit(1), F.col("lead"), none, F.col("mid")), part(F.col("no"), F.lit(0), F.col("rest"), F.when(size > 0, F.col("mid")).otherwise(F.col("start_ms")), F.col("end_ms")))
    x = s.select("video_id", "n", "units", F.explode(both).alias("x")).select("video_id", "n", "units", "x.*").where("part <> ''")
    listed = F.array_sort(F.collect_list(F.struct("n", "k", "part", "units")))
    g = x.groupBy("video_id", "no").agg(F.min("s").alias("start_ms"), F.max("e").alias("end_ms"), listed.alias("l"))
    return g.select("video_id", F.row_number().over(W.partitionBy("video_id").orderBy("no")).cast("long").alias("n"), F.array_join("l.part", "").alias("text"), "start_ms", "end_ms", F.array_distinct(F.flatten("l.units")).alias("units"))


def fallback_sentences(units: DataFrame) -> DataFrame:
    """A sentence for each unit (video_id, n, pos, unit, unit_start, unit_end) with text."""
    u = units.withColumn("text", squeeze(F.coalesce("unit", F.lit("")))).where("text <> ''")
    rank = F.row_number().over(W.partitionBy("video_id").orderBy("n", "pos"))
    return u.select("video_id", F.format_string("s%06d", rank).alias("id"), "text", F.col("unit_start").alias("start_ms"), F.col("unit_end").alias("end_ms"))


def write_sentences(sentences: DataFrame) -> DataFrame:
    """(video_id, body): one sentence a line in the order of ``n``."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", F.coalesce("text", F.lit("")).alias("t")))), lambda x: x["t"])
    return sentences.groupBy("video_id").agg(F.array_join(listed, "\n").alias("body"))


def check_conservation(units: DataFrame, sentences: DataFrame) -> DataFrame:
    """(video_id, conserved): the characters of units and sentences agree, white space apart; a video of one side only does not."""
    # Keys are made a row at a time: no character combines across the line end between rows, and a body may be long.
    key = lambda df, name: write_sentences(df.select("video_id", "n", conservation_key(F.coalesce("text", F.lit(""))).alias("text"))).select("video_id", F.replace("body", F.lit("\n"), F.lit("")).alias(name))
    return key(units, "a").join(key(sentences, "b"), "video_id", "full").select("video_id", F.coalesce(F.col("a") == F.col("b"), F.lit(False)).alias("conserved"))


# ---- edits -----------------------------------------------------------------------------------------------------------


def character_timings(sentences: DataFrame) -> DataFrame:
    """(video_id, n, i, ch, start_ms, end_ms): every content character with its share of its sentence's time, ``i`` from 0 in the sentence."""
    s = sentences.select("video_id", "n", "start_ms", "end_ms", made_once(key=content_key(F.coalesce("text", F.lit(""))))).where("key <> ''").withColumn("size", F.length("key"))
    size = F.col("size")
    span = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    at = lambda c: (F.col("start_ms") + F.rint(span * c / size)).cast("long")
    s = s.select("video_id", "n", "start_ms", "end_ms", "size", F.posexplode(F.split("key", "")).alias("i", "ch")).where("ch <> ''")
    return s.select("video_id", "n", F.col("i").cast("long").alias("i"), "ch", at(F.col("i")).alias("start_ms"), at(F.col("i") + 1).alias("end_ms"))


def _time_at(offset: Column, last: bool) -> Column:
    """Start (or end) of the content character at ``offset`` of the selected sentences, found in their list of (from, size, start, end)."""
    hit = F.get(F.filter("parts", lambda p: (p["from"] <= offset) & (offset < p["from"] + p["size"])), F.lit(0))
    span = F.greatest(F.lit(1), hit["end_ms"] - hit["start_ms"])
    return (hit["start_ms"] + F.rint(span * (offset - hit["from"] + (1 if last else 0)) / hit["size"])).cast("long")


def _named(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``rows`` (video_id, id, ...) with each (edit_id, k) of ``asked`` (edit_id, k, video_id, id) that names them, without a join.

    Rows that lie by video already are not shuffled for it, others once; no filter goes below their shuffle, so other readers can share it.
    """
    asks = asked.select("video_id", "id", F.struct("edit_id", "k").alias("_ask")).repartition("video_id")
    peers = W.partitionBy("video_id").orderBy("id").rangeBetween(W.currentRow, W.currentRow)
    both = rows.withColumn("_row", F.lit(True)).unionByName(asks, allowMissingColumns=True).withColumn("_known", F.count("video_id").over(peers) > 0)
    both = both.withColumn("_asks", F.collect_list("_ask").over(peers)).where("_row and _known").select(*rows.columns, F.explode("_asks").alias("_ask"))
    return both.select("_ask.edit_id", "_ask.k", *rows.columns)


def check_edits(sentences: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (edit_id, video_id, ids, text) with the selected sentences in order (``chosen``) and a reason if they are rejected.

    Rejected: no ids, an id twice, an id of no sentence, ids that do not follow each other, a text without sentences.
    """
    more = [c for c in SOURCES if c in sentences.columns]
    at = sentences.select("video_id", F.col("n").alias("id"), "text", "start_ms", "end_ms", *more)
    named = _named(at, edits.select("edit_id", "video_id", F.posexplode(F.array_distinct("ids")).alias("k", "id")))
    found = named.groupBy("edit_id").agg(F.array_sort(F.collect_list(F.struct("id", "text", "start_ms", "end_ms", *more))).alias("chosen"))
    e = edits.join(found, "edit_id", "left").withColumn("pieces", split_manual_sentences(F.coalesce("text", F.lit(""))))
    n = F.coalesce(F.size("ids"), F.lit(0))
    first, last = F.element_at("chosen.id", 1), F.element_at("chosen.id", -1)
    reason = F.when(n <= 0, "no sentence").when(n != F.size(F.array_distinct("ids")), "twice").when(F.coalesce(F.size("chosen"), F.lit(0)) != n, "foreign").when(last - first + 1 != n, "not contiguous").when(F.size("pieces") == 0, "empty").otherwise("")
    return e.withColumn("reason", reason)


#: Columns of sentences that name the segments and units they were made of, as lists of numbers.
SOURCES = ("source_segments", "source_units")


@F.pandas_udf(LongType())
def _place(whole: pd.Series, part: pd.Series) -> pd.Series:
    """Where ``part`` first stands in ``whole``, -1 if nowhere; Python searches in linear time."""
    return pd.Series([w.find(x) if w is not None and x is not None else -1 for w, x in zip(whole, part)], dtype="int64")


def _distinct_of(parts: Column, name: str) -> Column:
    return F.array_distinct(F.flatten(F.transform(parts, lambda p: p[name])))


def _source_parts(valid: DataFrame, segments: DataFrame) -> DataFrame:
    """(edit_id, parts) of the edits whose selected text stands in the text of its source segments, one after the other.

    Parts are as those of sentences, but of segments, and ``from`` counts from where the selected text begins. Edits that name
    unknown segments, or none, have no row.
    """
    ids = F.array_distinct(F.flatten(F.filter(F.col("chosen.source_segments"), lambda x: x.isNotNull())))
    chosen = F.transform("chosen", lambda c: F.struct(*[c[x].alias(x) for x in SOURCES]))
    asked = valid.select("edit_id", "video_id", chosen.alias("chosen"), F.posexplode(ids).alias("k", "id"))
    # Keys are made of the segments that are named, not of all.
    seg = _named(segments.select("video_id", F.col("n").alias("id"), "start_ms", "end_ms", "text"), asked)
    seg = seg.select("edit_id", "k", "start_ms", "end_ms", content_key(F.coalesce("text", F.lit(""))).alias("key"))
    named = asked.join(seg, ["edit_id", "k"], "left").withColumn("size", F.length("key").cast("long"))
    units = F.array_distinct(F.flatten(F.transform(F.filter("chosen", lambda c: F.array_contains(c["source_segments"], F.col("id"))), lambda c: F.coalesce(c["source_units"], F.array().cast("array<bigint>")))))
    named = named.withColumn("source_units", units).withColumn("source_segments", F.array("id"))
    named = named.withColumn("from", F.sum("size").over(W.partitionBy("edit_id").orderBy("k")) - F.col("size"))
    part = F.struct("k", "from", "size", "start_ms", "end_ms", "source_segments", "source_units", "key")
    whole = named.groupBy("edit_id").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.bool_and(F.col("key").isNotNull()).alias("known")).where("known")
    found = whole.join(valid.select("edit_id", content_key(F.array_join("chosen.text", "")).alias("text")), "edit_id")
    found = found.withColumn("place", _place(F.array_join("parts.key", ""), F.col("text"))).where("place >= 0")
    moved = F.transform("parts", lambda p: F.struct(p["k"].alias("k"), (p["from"] - F.col("place")).alias("from"), p["size"].alias("size"), p["start_ms"].alias("start_ms"), p["end_ms"].alias("end_ms"), *[p[c].alias(c) for c in SOURCES]))
    return found.select("edit_id", moved.alias("by_source"))


def resegment_sentences(sentences: DataFrame, edits: DataFrame, segments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(sentences after valid edits, rejects): the selected sentences become those of the edited text, ids count anew.

    If only cuts moved (equal content) each new sentence has the times of its own characters, else the span is shared by
    content length. Sentences are numbered 1, 2, ... in a video; valid edits of a video must not overlap.

    Sentences may name their sources (``source_segments``, ``source_units``); new ones then name those of their characters, or all
    of the selection's where the content changed. With ``segments`` (video_id, n, text, start_ms, end_ms) the characters have the times of
    their segments, if the selected text stands in the text of the named segments; else those of the sentences. Checked edits are written
    to the shared folder when this is called.
    """
    checked = kept(check_edits(sentences, edits), "edits")
    valid, whole = checked.where("reason = ''"), F.array_join("chosen.text", "")
    sourced = all(c in sentences.columns for c in SOURCES)
    none = F.array().cast("array<bigint>")
    of = lambda c, name: F.coalesce(c[name], none) if sourced else none
    same = content_key(F.coalesce(whole, F.lit(""))) == content_key(F.col("text"))
    sized = F.transform("chosen", lambda c: F.struct(c["text"].alias("t"), c["start_ms"].alias("start_ms"), c["end_ms"].alias("end_ms"), *[of(c, x).alias(x) for x in SOURCES]))
    v = valid.withColumns({"same": same, "first": F.element_at("chosen.id", 1), "s0": F.element_at("chosen.start_ms", 1), "e0": F.greatest(F.element_at("chosen.start_ms", 1), F.element_at("chosen.end_ms", -1)), "sized": sized})
    # Offsets of the selected sentences' content, then of the new ones', by running sums within an edit.
    c = v.select("edit_id", F.posexplode("sized").alias("k", "c")).withColumn("size", F.length(content_key(F.coalesce("c.t", F.lit("")))).cast("long"))
    run = W.partitionBy("edit_id").orderBy("k")
    c = c.withColumn("from", F.sum("size").over(run) - F.col("size"))
    parts = c.groupBy("edit_id").agg(F.array_sort(F.collect_list(F.struct("k", "from", "size", *[F.col(f"c.{x}").alias(x) for x in ("start_ms", "end_ms", *SOURCES)]))).alias("parts"))
    if segments is not None and sourced:
        parts = parts.join(_source_parts(v.where("same"), segments), "edit_id", "left").select("edit_id", F.coalesce("by_source", "parts").alias("parts"), F.col("parts").alias("all"))
    else:
        parts = parts.withColumn("all", F.col("parts"))
    p = v.select("edit_id", "video_id", "first", "same", "s0", "e0", F.posexplode("pieces").alias("k", "piece")).withColumn("own", F.length(content_key(F.col("piece"))).cast("long"))
    p = p.withColumn("weight", F.greatest(F.lit(1), F.col("own")))
    w = W.partitionBy("edit_id")
    p = p.withColumns({"done": F.sum("own").over(run), "share": F.sum("weight").over(run), "total": F.sum("weight").over(w), "count": F.count("*").over(w)}).join(parts, "edit_id")
    span = F.greatest(F.lit(1), F.col("e0") - F.col("s0"))
    at = lambda x: (F.col("s0") + F.rint(span * x / F.col("total"))).cast("long")
    start, end = at(F.col("share") - F.col("weight")), F.when(F.col("k") == F.col("count") - 1, F.col("e0")).otherwise(at(F.col("share")))
    exact = F.col("same") & (F.col("own") > 0)
    touched = F.filter("parts", lambda x: (x["size"] > 0) & (x["from"] < F.col("done")) & (x["from"] + x["size"] > F.col("done") - F.col("own")))
    named = [F.when(exact, _distinct_of(touched, x)).otherwise(_distinct_of(F.col("all"), x)).alias(x) for x in SOURCES] if sourced else []
    new = p.select(
        "video_id", F.col("first").alias("n"), "k", F.col("piece").alias("text"), F.when(exact, _time_at(F.col("done") - F.col("own"), False)).otherwise(start).alias("start_ms"), F.when(exact, _time_at(F.col("done") - 1, True)).otherwise(F.greatest(start, end)).alias("end_ms"), *named
    )
    # Sentences, new ones and the ids of replaced ones meet by video; sentences that lie so already stay there. Which ones are replaced is seen there, as is their new number.
    old = sentences.select("video_id", "n", F.lit(0).alias("k"), "text", "start_ms", "end_ms", *(SOURCES if sourced else ()), F.lit(0).alias("_kind"))
    gone = valid.select("video_id", F.explode("ids").alias("n"), F.lit(-1).alias("k"), F.lit(1).alias("_kind"))
    rows = old.unionByName(new.withColumn("_kind", F.lit(2)).repartition("video_id")).unionByName(gone.repartition("video_id"), allowMissingColumns=True)
    replaced = F.max(F.col("_kind") == 1).over(W.partitionBy("video_id").orderBy("n").rangeBetween(W.currentRow, W.currentRow))
    all_ = rows.withColumn("_replaced", replaced).where("_kind = 2 or (_kind = 0 and not _replaced)")
    rank = F.row_number().over(W.partitionBy("video_id").orderBy("n", "k")).cast("long")
    return all_.select("video_id", rank.alias("n"), "text", "start_ms", "end_ms", *(SOURCES if sourced else ())), checked.where("reason <> ''").select("edit_id", "video_id", "reason")


def edit_log(before: DataFrame, edits: DataFrame) -> DataFrame:
    """(edit_id, video_id, before, after): texts of the selected sentences and of the new ones, of valid edits; append it to the log."""
    valid = check_edits(before, edits).where("reason = ''")
    return valid.select("edit_id", "video_id", F.col("chosen.text").alias("before"), F.col("pieces").alias("after"))


def append_edit_log(before: DataFrame, edits: DataFrame, path: str) -> None:
    """Adds the rows of ``edit_log`` to the log at ``path``; earlier rows are neither read nor written."""
    edit_log(before, edits).withColumn("edited_at", F.current_timestamp()).write.mode("append").parquet(path)
