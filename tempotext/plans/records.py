"""Queries of counts, checks, files, logs and library tables, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import corrections as K, cues as C, documents as D, library as L, segments as G, sentences as N
from ..sources.shared import scratch
from . import fixtures as X
from .documents import _DOCUMENT, _LINE, _document
from .registry import _LIB, _OUTCOME, SQL, query
from .sentences import _edits


@query(_OUTCOME + _DOCUMENT + """, a as (
select video_id, 'observations' k from observations union all select video_id, 'segments' from f union all select video_id, outcome from f where outcome <> 'kept'
union all select video_id, case source when 'screen_annotation' then 'annotations' else 'spoken' end from doc union all select video_id, 'unresolved' from doc where confidence < 0.75
union all select video_id, 'sentences' from cues union all select video_id, 'reused_chunks' from cues where n % 100 = 1)
select video_id, """ + ", ".join(f"count(*) filter (k = '{c}') {c}" for c in K.COUNTS) + " from a group by 1", "observations", "cues", "segs", "corrections")
def run_summary(s, d):
    o, c = X.ocr_segments(s, d), X.cues(s, d)
    doc = _document(s, d).withColumn("needs_review", F.col("confidence") < 0.75)
    return K.run_summary(K.apply_corrections(o, X.corrections(s, d)), X.observations(s, d), doc, c, c.where("n % 100 = 1"))


_RULES = ["case when x.start_ms < 0 or x.end_ms < 0 then 'negative time' end", "case when x.end_ms < x.start_ms then 'end before start' end", "case when x.confidence > 1 then 'confidence' end", "case when trim(x.text) = '' then 'empty text' end",
          "case when x.kind = 'other' then 'kind' end", "case when x.n % 50 = 5 then 'reading' end", "case when x.n % 50 = 6 then 'region' end"]


@query(f"""
, x as (select video_id, n, start_ms, case when n % 50 = 1 then -1 else end_ms end end_ms, case when n % 50 = 2 then confidence + 1.5 else confidence end confidence, case when n % 50 = 3 then '  ' else text end as text, case when n % 50 = 4 then 'other' else 'word' end kind from segs),
r as (select video_id, n, array_to_string(list_filter([{', '.join(_RULES)}], lambda z: z is not null), '; ') reasons from x) select * from r where reasons <> ''""", "cues", "segs")
def check_rows(s, d):
    """Six kinds of bad rows, each in one row of fifty."""
    at = lambda k, bad, good: F.when(F.col("n") % 50 == k, bad).otherwise(good)
    rows = X.ocr_segments(s, d).select(
        "video_id", "n", "start_ms", at(1, -1, F.col("end_ms")).alias("end_ms"), at(2, F.col("confidence") + 1.5, F.col("confidence")).alias("confidence"), at(3, "  ", F.col("text")).alias("text"), at(4, "other", "word").alias("kind"),
        at(5, "漢字", "kana").alias("expression"), F.lit("kana").alias("lemma"), F.lit("").alias("reading"), F.lit(0.0).alias("x"), F.lit(0.65).alias("y"), F.lit(1.0).alias("width"), at(6, 0.36, 0.35).alias("height"),
    )
    return K.check_rows(rows)


@query("""
, p as (select stage, conv_id, turn, 'tokens' k, tokens::varchar v from assets union all select stage, conv_id, turn, 'model', 'm' || (conv_id % 3) from assets union all select stage, conv_id, turn, 'calls', '1' from assets union all select stage, conv_id, turn, 'repairs', (turn % 3 = 2)::int::varchar from assets)
select stage, k as key, case when k <> 'model' then sum(try_cast(v as double)) end total, case when k = 'model' then arg_min(v, (conv_id, turn, v)) end first_value from p group by 1, 2""", "assets")
def usage_rollup(s, d):
    usage = F.create_map(F.lit("tokens"), F.col("tokens").cast("string"), F.lit("model"), F.concat(F.lit("m"), (F.col("conv_id") % 3).cast("string")))
    return L.usage_rollup(X.assets(s, d).select("stage", F.struct("conv_id", "turn").alias("ord"), (F.col("turn") % 3 == 2).alias("repair"), usage.alias("usage")))


@query("""
, j as (select page_id, case when page_id % 4 < 3 then 'v' || (page_id//8) end k from sources)
select distinct k video_key from j where k is not null and page_id % 16 < 9 and k not in (select k from j where k is not null and page_id % 16 >= 9)""", "sources")
def orphan_videos(s, d):
    j = X.sources(s, d).select(F.col("page_id").alias("job_id"), "source_url")
    return L.orphan_videos(j, j.where("job_id % 16 < 9").select("job_id"))


@query("""
, e as (select video_id, max(end_ms) m from (select video_id, end_ms from cues union all select video_id, end_ms from segs union all select doc_id, 30000 from documents) group by 1),
w as (select video_id, start_ms//20000 window_index, sum(c)::bigint cues, sum(1 - c)::bigint segments from (select video_id, start_ms, 1 c from cues union all select video_id, start_ms, 0 from segs) group by 1, 2)
select video_id, window_index, window_index * 20000 start_ms, least(m, window_index * 20000 + 20000) end_ms, cues, segments from w join e using (video_id)""", "cues", "segs")
def window_bounds(s, d):
    videos = X.read(s, d, "documents").select(F.col("doc_id").alias("video_id"), F.lit(30000).cast("long").alias("duration_ms"))
    return C.window_bounds(X.cues(s, d), X.ocr_segments(s, d), videos)


@query("""
, w as (select video_id, start_ms//20000 window_index, n from segs)
select video_id, window_index, not bool_or(n % 20 = 3 or n % 20 = 4 or n % 20 = 5) valid from w group by 1, 2""", "cues", "segs")
def validate_window_sources(s, d):
    """Annotations of all rows; one row of twenty is used twice, one by its window only as an unknown id, one also by another window."""
    w = X.ocr_segments(s, d).withColumn("window_index", F.floor(F.col("start_ms") / 20000))
    ids = F.when(F.col("n") % 20 == 3, F.array("n", "n")).when(F.col("n") % 20 == 4, F.array(-F.col("n"))).otherwise(F.array("n"))
    made = w.select("video_id", "window_index", F.when(F.col("n") % 20 == 4, "spoken").otherwise("annotation").alias("kind"), ids.alias("ocr_ids"))
    foreign = w.where("n % 20 = 5").select("video_id", "window_index", F.lit("annotation").alias("kind"), F.array(F.col("n") + 1_000_000).alias("ocr_ids"))
    return D.validate_window_sources(made.unionByName(foreign), X.ocr_segments(s, d))


@query(f"""
, l as (select video_id, count(*) c, string_agg({_LINE}, chr(10) order by start_ms, n) body from segs group by 1),
v as (select doc_id video_id, source, lang from documents)
select video_id, concat('---', chr(10), 'title: ', to_json(coalesce(source, '') || ' "t"'), chr(10), 'video_id: "', video_id, '"', chr(10), 'source_url: "u', video_id, '"', chr(10), 'subtitle_source: "burned_ocr', case when video_id % 3 = 1 and exists (select 1 from segs s where s.video_id = v.video_id and n % 11 <> 0) then '+youtube_reading_reference' else '' end, '"', chr(10),
'ocr_backend: "cloud_vlm"', chr(10), 'ocr_model: "m"', chr(10), 'language: ', to_json(coalesce(lang, '')), chr(10), 'segments: ', coalesce(c, 0), chr(10), '---', chr(10), chr(10), '# ', coalesce(source, '') || ' "t"', chr(10), chr(10), coalesce(body, '{D.PLACEHOLDER}'), chr(10)) body from v left join l using (video_id)""", "cues", "segs")
def transcript_files(s, d):
    i = F.col("doc_id")
    title = F.concat(F.coalesce("source", F.lit("")), F.lit(' "t"'))
    videos = X.read(s, d, "documents").select(i.alias("video_id"), title.alias("title"), F.concat(F.lit("u"), i.cast("string")).alias("source_url"), F.lit("m").alias("model"), F.col("lang").alias("language"))
    source = F.when(F.col("n") % 11 == 0, "screen_annotation").when(F.col("video_id") % 3 == 1, "burned_ocr_corrected").otherwise("burned_ocr")
    return D.transcript_files(videos, X.ocr_segments(s, d).withColumns({"source": source, "needs_review": F.col("confidence") < 0.55}))


@query("""
, b as (select video_id, max(batch_index) + 1 nxt from observations where frame_index % 3 = 0 group by 1)
select video_id, frame_index, (row_number() over (partition by video_id order by frame_index) - 1)//4 + coalesce(nxt, 0) as batch from observations left join b using (video_id) where frame_index % 3 <> 0""", "observations")
def continue_batches(s, d):
    o = X.observations(s, d)
    return G.assign_batches(o.where("frame_index % 3 <> 0"), 4, o.where("frame_index % 3 = 0").withColumn("batch", F.col("batch_index"))).select("video_id", "frame_index", "batch")


@query("select video_id, frame_index, ts_ms, text from observations where frame_index % 3 = 0 and video_id % 4 <> 1", "observations")
def discard_other_models(s, d):
    """Videos 1, 5, 9 and 13 have rows of an old model."""
    o = X.observations(s, d).withColumn("model", F.when((F.col("video_id") % 4 == 1) & (F.col("frame_index") % 2 == 0), "old").otherwise("new"))
    return G.dedupe_observations(o, o.where("frame_index % 3 = 0"), "new").select("video_id", "frame_index", "ts_ms", "text")


@query(SQL["append_edit_log"])
def edit_log_table(s, d):
    """The edits of every second video, then the others, added to one log."""
    path, c, e = scratch(s, "edit-log"), X.cues(s, d), _edits(s, d)
    for odd in (0, 1):
        N.append_edit_log(c, e.where(F.col("video_id") % 2 == odd), path)
    return s.read.parquet(path).select("edit_id", "video_id", F.array_join("before", "|").alias("before_texts"), F.array_join("after", "|").alias("after_texts"))


@query(_LIB + """, f as (select entry_key, min(save_id) id from k group by entry_key, surface), m as (select entry_key, min(save_id) id from k group by entry_key, meaning), c as (select entry_key, min(save_id) id from k group by entry_key, context_key),
u as (select entry_key, max(id) updated from (select * from f union all select * from m union all select * from c) group by 1)
select entry_key, any_value(kind) kind, any_value(lemma) lemma, '' reading, min(save_id) created, any_value(lemma) display, any_value(updated) updated from k join u using (entry_key) group by 1""", "saves")
def library_tables(s, d):
    return L.library_tables(X.saves(s, d))["entries"]


@query(_LIB + "select entry_key, meaning meaning_key, min(save_id) save_id, arg_min(meaning, save_id) meaning from k group by 1, 2", "saves")
def library_meanings(s, d):
    return L.library_tables(X.saves(s, d))["meanings"]


@query(_LIB + "select entry_key, context_key, min(save_id) save_id, arg_min(meaning, save_id) meaning_key from k group by 1, 2", "saves")
def library_encounters(s, d):
    return L.library_tables(X.saves(s, d))["encounters"]


@query(_LIB + "select entry_key, surface form_key, min(save_id) save_id, arg_min(surface, save_id) surface, '' reading from k group by 1, 2", "saves")
def library_forms(s, d):
    return L.library_tables(X.saves(s, d))["forms"]


@query("select save_id, case when kind = 'grammar' then 'kind' when save_id % 7 = 0 then 'lemma' when save_id % 11 = 0 then 'surface' when save_id % 13 = 0 then 'meaning' else 'context_key' end reason from saves where kind = 'grammar' or save_id % 7 = 0 or save_id % 11 = 0 or save_id % 13 = 0 or save_id % 17 = 0", "saves")
def rejected_saves(s, d):
    """Grammar goes by a name that is no kind; some fields are blank, one of them with a wide space, or null."""
    k = F.col("save_id")
    blank = lambda n, x, c: F.when(k % n == 0, F.lit(x).cast("string")).otherwise(F.col(c))
    v = X.saves(s, d).withColumn("kind", F.when(F.col("kind") == "grammar", "rule").otherwise(F.col("kind")))
    return L.rejected_saves(v.withColumns({"lemma": blank(7, " ", "lemma"), "surface": blank(11, "\u3000", "surface"), "meaning": blank(13, None, "meaning"), "context_key": blank(17, "", "context_key")}))


def _merged(s, d) -> dict[str, DataFrame]:
    """A stored library after three batches: later saves first, the earliest last, and some twice."""
    path, v, k = scratch(s, "stored-library"), X.saves(s, d), F.col("save_id")
    for batch in (v.where(k % 3 == 2), v.where(k % 3 == 1), v.where((k % 3 == 0) | (k % 7 == 0))):
        L.merge_library(batch, path, 16)
    return L.stored_tables(L.load_library(s, path))


@query(SQL["library_tables"])
def merge_library(s, d):
    return _merged(s, d)["entries"]


@query(SQL["library_encounters"])
def merge_library_encounters(s, d):
    return _merged(s, d)["encounters"].select("entry_key", "context_key", "save_id", "meaning_key")
