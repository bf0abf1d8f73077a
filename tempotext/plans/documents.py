"""Queries of the document operators and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as T
from ..operators import cues as C, documents as D
from . import fixtures as X
from .registry import _UNITS, SQL, _units, query

_AT = "case when {0} >= 3600000 then printf('%02d:', {0}//3600000) else '' end || printf('%02d:%02d.%03d', {0}//60000%60, {0}//1000%60, {0}%1000)"
_LINE = f"'- [' || {_AT.format('start_ms')} || '–' || {_AT.format('end_ms')} || '] ' || case when n % 11 = 0 then '【画面补充】' else '' end || text || case when confidence < 0.55 then ' ⚠️' else '' end"
_SQUEEZED = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def _bodies(segments: DataFrame) -> DataFrame:
    return D.write_transcript(segments.withColumns({"needs_review": F.col("confidence") < 0.55, "is_annotation": F.col("n") % 11 == 0}))


@query(f"select video_id, string_agg({_LINE}, chr(10) order by start_ms, n) body from segs group by 1", "cues", "segs")
def write_transcript(s, d):
    return _bodies(X.ocr_segments(s, d))


@query(f"""select video_id, printf('seg%06d', row_number() over (partition by video_id order by start_ms, n)) id, case when n % 11 = 0 then '【画面补充】' else '' end || {_SQUEEZED} as text, start_ms, end_ms
from segs""", "cues", "segs")
def read_timed_transcript(s, d):
    return D.read_timed_transcript(_bodies(X.ocr_segments(s, d).withColumn("text", X.escaped(F.col("text")))))


def _plain(s, d) -> DataFrame:
    return X.cues(s, d).withColumn("text", X.escaped(F.col("text")))


_MERGED = SQL["merge_cues"].replace("from cues window", f"from (select video_id, n, {_SQUEEZED} as text, start_ms, end_ms from cues) window")


@query(name="read_vtt_captions")
def read_vtt_captions(s, d):
    at = lambda c: T.format_timestamp(F.col(c))
    block = F.concat(at("start_ms"), F.lit(" --> "), at("end_ms"), F.lit(" align:start\n<c>"), "text", F.lit("</c>"))
    files = _plain(s, d).groupBy("video_id").agg(F.concat(F.lit("WEBVTT\n\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", block.alias("b")))), lambda x: x["b"]), "\n\n")).alias("vtt"))
    return D.read_vtt_captions(files)


@query(name="read_json3_captions")
def read_json3_captions(s, d):
    event = F.struct("n", F.col("start_ms").alias("tStartMs"), (F.col("end_ms") - F.col("start_ms")).alias("dDurationMs"), F.array(F.struct(F.col("text").alias("utf8"))).alias("segs"))
    files = _plain(s, d).groupBy("video_id").agg(F.to_json(F.struct(F.array_sort(F.collect_list(event)).alias("events"))).alias("json3"))
    return D.read_json3_captions(files)


SQL["read_vtt_captions"] = SQL["read_json3_captions"] = _MERGED


@query("""with t as (select doc_id video_id, i pos, case when i < 3 then 'manual' else 'automatic' end kind, ['ja','en-US','en','live_chat','de','fr'][(doc_id*7+i*5)%6+1] as language, ['ttml','vtt','json3','srv3'][(doc_id+i*3)%4+1] ext, (doc_id+i)%5 <> 0 ok
  from documents, range(6) r(i)),
f as (select *, min(pos) over (partition by video_id, kind, language) first_pos, case when split_part(language, '-', 1) = 'en' then 0 when language = 'de' then 1 else 2 end wish from t),
k as (select *, row_number() over (partition by video_id order by (wish = 2)::int, (kind = 'automatic')::int, wish, first_pos, case ext when 'json3' then 0 when 'vtt' then 1 when 'srv3' then 2 else 3 end, pos) rn from f where ok and language <> 'live_chat')
select video_id, kind, language, ext, pos from k where rn = 1""")
def select_caption_track(s, d):
    v, i = F.col("video_id"), F.col("pos")
    t = X.read(s, d, "documents").select(F.col("doc_id").alias("video_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("pos"))
    one = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    t = t.select("video_id", "pos", F.when(i < 3, "manual").otherwise("automatic").alias("kind"), one(["ja", "en-US", "en", "live_chat", "de", "fr"], (v * 7 + i * 5) % 6).alias("language"), one(["ttml", "vtt", "json3", "srv3"], (v + i * 3) % 4).alias("ext"), F.when((v + i) % 5 != 0, "u").alias("url"))
    return D.select_caption_track(t, ["en", "de"])


@query("""with r as (select conv_id id, turn ord, role stem, row_number() over (partition by role order by conv_id, turn) = 1 own from conversations),
k as (select *, row_number() over (partition by stem, id, own order by ord) k from r) select id, ord, case when own then stem else stem || ' [' || id || case when k > 1 then '-' || k else '' end || ']' end as name from k""")
def resolve_output_names(s, d):
    return D.resolve_output_names(X.read(s, d, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("ord"), F.col("role").alias("stem")))


# ---- decisions -------------------------------------------------------------------------------------------------------

_SPOKEN = ", sp as (select video_id, (n-1)//2 ord, min(start_ms) start_ms, max(end_ms) end_ms, count(*) observation_count, string_agg(text, '|' order by n) texts from cues group by all) "


def _spoken(s, d) -> DataFrame:
    """A decision for each two cues, with an id that no cue has; every fifth is to be seen again."""
    g = X.cues(s, d).groupBy("video_id", F.expr("(n - 1) div 2").alias("ord")).agg(F.array_sort(F.collect_list("n")).alias("ids"))
    return g.select("video_id", "ord", F.concat("ids", F.array(F.lit(-1).cast("long"))).alias("ids"), F.concat(F.lit(" s"), F.col("ord").cast("string"), F.lit(" ")).alias("text"), (F.col("ord") % 5 == 0).alias("recheck"))


@query(_SPOKEN + "select * from sp", "cues")
def resolve_decision_spans(s, d):
    return D.resolve_decision_spans(_spoken(s, d), X.cues(s, d)).withColumn("texts", F.array_join("texts", "|"))


_DOCUMENT = _SPOKEN + """, doc as (select video_id, ord, 'youtube_primary' source, start_ms, end_ms, 's' || ord as text, case when ord % 5 = 0 then 0.72::double else 0.92::double end confidence, observation_count from sp
union all select video_id, n, 'screen_annotation', start_ms, end_ms, trim(text), confidence, observation_count from segs where n % 11 = 0) """


def _document(s, d) -> DataFrame:
    seen = X.ocr_segments(s, d)
    notes = seen.where("n % 11 = 0").select("video_id", F.col("n").alias("ord"), F.array("n").alias("ids"), "text")
    return D.union_document(_spoken(s, d), notes, X.cues(s, d), seen)


@query(_DOCUMENT + "select * from doc", "cues", "segs")
def union_document(s, d):
    return _document(s, d)


@query(_DOCUMENT + "select video_id, ord, source, row_number() over (partition by video_id order by start_ms, (source = 'screen_annotation')::int, ord) as rank from doc", "cues", "segs")
def sort_reconciled(s, d):
    return D.sort_reconciled(_document(s, d)).select("video_id", "ord", "source", "rank")


@query(", w as (select video_id, start_ms//20000 window_index, count(*) c from cues group by all) select video_id, window_index, case (video_id + window_index) % 6 when 0 then false when 1 then c = 1 else true end valid from w", "cues")
def validate_window_decisions(s, d):
    c = X.cues(s, d).withColumn("window_index", F.expr("start_ms div 20000"))
    k = (F.col("video_id") + F.col("window_index")) % 6
    firsts = c.groupBy("video_id", "window_index").agg(F.min("n").alias("first"))
    made = c.join(firsts, ["video_id", "window_index"]).where((k != 0) | (F.col("n") != F.col("first")))
    return D.validate_window_decisions(made.select("video_id", "window_index", F.when(k == 1, -F.col("n")).otherwise(F.col("n")).alias("ord"), F.array("n").alias("ids")), X.cues(s, d))


_TAIL = ", w as (select video_id, start_ms//20000 window_index, list(n order by n) ns, list(text order by n) ts from cues group by all), t as (select video_id, window_index, ts, lag(ns[-3:]) over v tail, lag(ts[-3:]) over v texts from w window v as (partition by video_id order by window_index)) "


@query(_TAIL + "select video_id, window_index, coalesce(array_to_string(tail, ','), '') tail from t", "cues")
def previous_tail(s, d):
    return D.previous_tail(X.cues(s, d)).withColumn("tail", F.array_join(F.col("tail.n").cast("array<string>"), ","))


# ---- sentences and replies -------------------------------------------------------------------------------------------


@query("select video_id, printf('s%06d', row_number() over (partition by video_id order by start_ms, n)) id, n from cues where n <> 2", "cues")
def delete_sentence(s, d):
    c = X.cues(s, d)
    return C.assign_ids(c.join(c.where("n = 2").select("video_id", "n"), ["video_id", "n"], "left_anti"), "s", "start_ms", "n").select("video_id", "id", "n")


@query(_UNITS + r"""
, q as (select *, greatest(1, length(regexp_replace(unit, '[\s。．.]', '', 'g'))) weight from e), t as (select *, sum(weight) over (partition by video_id, n order by pos) done, sum(weight) over (partition by video_id, n) total from q)
select video_id, n, pos, unit, start_ms + round_even((end_ms-start_ms)*(done-weight)/total, 0)::bigint unit_start, case when done = total then end_ms else start_ms + round_even((end_ms-start_ms)*done/total, 0)::bigint end unit_end from t""", "cues")
def proportional_retime(s, d):
    return D.proportional_retime(_units(s, d))


def _replies(s, d) -> DataFrame:
    """Answers in JSON between fences; every fifth text is written full-width, on two lines with an empty one between."""
    i = F.col("frame_index")
    text = F.when(i % 5 == 1, F.concat(F.lit("Ａ　"), "text", F.lit("\n \n "), "text")).otherwise(F.col("text"))
    f = F.struct(i.alias("frame_id"), text.alias("text"), F.when(i % 4 != 0, F.col("confidence")).alias("confidence"), F.when(i % 3 != 0, i % 3).alias("line_count"))
    made = X.observations(s, d).where("frame_index % 7 <> 0").groupBy("video_id", "batch_index").agg(F.to_json(F.struct(F.collect_list(f).alias("frames"))).alias("j"))
    return made.select("video_id", F.concat(F.lit("Here:\n```json\n"), "j", F.lit("\n```")).alias("reply"))


@query("""
, t as (select *, case when frame_index % 5 = 1 then case when text = '' then 'A' else 'A ' || text || chr(10) || text end else text end said from observations where frame_index % 7 <> 0)
select video_id, frame_index frame_id, said as text, case when frame_index % 4 = 0 then 0.5::double else confidence end confidence, greatest((said <> '')::int + (contains(said, chr(10)))::int, frame_index % 3)::bigint line_count from t""", "observations")
def parse_recognition_replies(s, d):
    return D.parse_recognition_replies(_replies(s, d))


@query("select video_id, frame_index from observations where frame_index % 7 = 0", "observations")
def retry_missing(s, d):
    return D.retry_missing(X.observations(s, d).select("video_id", "frame_index"), D.parse_recognition_replies(_replies(s, d)))
