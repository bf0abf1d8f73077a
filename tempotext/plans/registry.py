"""Queries of the timed-text operators over whole tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import similarity as S, text as T
from ..operators import corrections as K, cues as C, library as L, segments as G
from . import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, *views: str, name: str | None = None):
    """Registers a query; its SQL may read fixture views."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = X.sql(sql, *views) if views else sql
        return f

    return add


# ---- segments --------------------------------------------------------------------------------------------------------

_PASS1 = """
, o as (select *, lead(ts_ms, 1, 2592000) over (partition by video_id order by ts_ms, frame_index) next_ms,
          sum((trim(text) = '')::int) over (partition by video_id order by ts_ms, frame_index) island,
          case when text = lag(text) over (partition by video_id order by ts_ms, frame_index) then 0 else 1 end chg from observations),
r as (select *, sum(chg) over (partition by video_id order by ts_ms, frame_index) run from o),
p1 as (select video_id, min(ts_ms) start_ms, least(2592000, greatest(min(ts_ms) + 2000, max(next_ms))) end_ms, first(text) as text, avg(confidence) confidence, count(*) observation_count
       from r where trim(text) <> '' group by video_id, island, run)"""
_PASS2 = """
, q as (select *, case when start_ms - lag(end_ms) over (partition by video_id order by start_ms) <= 2000 and text = lag(text) over (partition by video_id order by start_ms) then 0 else 1 end cut from p1),
q2 as (select *, sum(cut) over (partition by video_id order by start_ms) g from q),
p2 as (select video_id, min(start_ms) start_ms, arg_max(end_ms, start_ms) end_ms, first(text) as text, sum(confidence * observation_count) / sum(observation_count) confidence, sum(observation_count)::bigint observation_count from q2 group by video_id, g)"""
_SEGMENT = "select video_id, start_ms, end_ms, text, round(confidence, 6) confidence, observation_count::bigint observation_count, confidence < 0.55 needs_review from "


def _segments(s: SparkSession, d: str) -> DataFrame:
    return G.segment_observations(X.observations(s, d), X.DURATION, X.INTERVAL)


def _shown(df: DataFrame) -> DataFrame:
    return df.select("video_id", "start_ms", "end_ms", "text", F.round("confidence", 6).alias("confidence"), "observation_count", "needs_review")


@query(_PASS1 + _SEGMENT + "p1", "observations")
def segment_observations(s, d):
    return _shown(_segments(s, d))


@query(_PASS1 + _PASS2 + _SEGMENT + "p2", "observations")
def merge_adjacent_segments(s, d):
    return _shown(G.merge_adjacent_segments(_segments(s, d), X.INTERVAL))


@query(_PASS1 + "select video_id, count(*) segments, sum(observation_count)::bigint observations, round(sum(confidence * observation_count) / sum(observation_count), 6) mean_confidence, sum((confidence < 0.55)::int)::bigint to_review from p1 group by video_id", "observations")
def segment_stats(s, d):
    return G.segment_stats(_segments(s, d))


@query("select video_id, frame_index, ts_ms, text from observations where frame_index % 3 = 0", "observations")
def dedupe_observations(s, d):
    o = X.observations(s, d)
    return G.dedupe_observations(o.unionByName(o.where("frame_index % 2 = 0").withColumn("ts_ms", F.col("ts_ms") - 1)), o.where("frame_index % 3 = 0")).select("video_id", "frame_index", "ts_ms", "text")


@query(_PASS1 + """, h as (select s.video_id, s.start_ms, o.frame_index, o.ts_ms, row_number() over (partition by s.video_id, s.start_ms order by o.ts_ms, o.frame_index) rn, count(*) over (partition by s.video_id, s.start_ms) c
from p1 s join observations o on o.video_id = s.video_id and trim(o.text) <> '' and o.ts_ms between s.start_ms and s.end_ms) select video_id, start_ms, frame_index, ts_ms from h where rn in (1, c//2+1, c)""", "observations")
def segment_evidence(s, d):
    return G.segment_evidence(_segments(s, d), X.observations(s, d))


@query("select video_id, frame_index from observations where frame_index % 3 <> 0", "observations")
def pending_frames(s, d):
    o = X.observations(s, d)
    return o.join(o.where("frame_index % 3 = 0").select("video_id", "frame_index"), ["video_id", "frame_index"], "left_anti").select("video_id", "frame_index")


@query("select video_id, frame_index, (row_number() over (partition by video_id order by frame_index) - 1)//4 as batch from observations where frame_index % 3 <> 0", "observations")
def assign_batches(s, d):
    return G.assign_batches(X.observations(s, d).where("frame_index % 3 <> 0"), 4).select("video_id", "frame_index", "batch")


# ---- captions, joins by time -----------------------------------------------------------------------------------------


@query("""
, l as (select *, case when text = lag(text) over w then 0 else 1 end chg from cues window w as (partition by video_id order by start_ms, end_ms, n)),
r as (select *, sum(chg) over (partition by video_id order by start_ms, end_ms, n) run from l),
m as (select *, max(end_ms) over (partition by video_id, run order by start_ms, end_ms, n rows between unbounded preceding and 1 preceding) reach from r),
p as (select *, sum(case when reach is null or start_ms > reach + 250 then 1 else 0 end) over (partition by video_id, run order by start_ms, end_ms, n) part from m),
g as (select video_id, run, part, min(start_ms) start_ms, max(end_ms) end_ms, first(text) as text from p group by all)
select video_id, printf('yt%06d', row_number() over (partition by video_id order by start_ms, end_ms, run)) cue_id, start_ms, end_ms, text from g""", "cues")
def merge_cues(s, d):
    return C.merge_cues(X.cues(s, d))


@query("select s.video_id, s.n, coalesce(string_agg(distinct c.text, '|' order by c.text), '') reference from segs s left join cues c on c.video_id = s.video_id and c.end_ms >= greatest(0, s.start_ms - 650) and c.start_ms <= s.end_ms + 650 group by all", "cues", "segs")
def align_references(s, d):
    return C.align_references(X.ocr_segments(s, d), X.cues(s, d)).select("video_id", "n", F.array_join(F.array_sort("reference"), "|").alias("reference"))


_KEY = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}]', '', 'g'))"


@query()
def uncovered_cues(s, d):
    return C.uncovered_cues(X.cues(s, d), X.ocr_segments(s, d)).select("video_id", "n", "start_ms", "end_ms")


#: Cues that no near segment contains or is contained in, by keys of letters and digits.
_UNCOVERED = f"""
, ck as (select *, {_KEY.format("text")} k from cues), sk as (select video_id, start_ms, end_ms, {_KEY.format("text")} k from segs),
held as (select distinct c.video_id, c.n from ck c join sk s on s.video_id = c.video_id and s.end_ms >= c.start_ms - 700 and s.start_ms <= c.end_ms + 700 and s.k <> '' and c.k <> ''
  and (s.k = c.k or (least(length(s.k), length(c.k)) >= 4 and least(length(s.k), length(c.k)) >= 0.30 * greatest(length(s.k), length(c.k)) and (contains(s.k, c.k) or contains(c.k, s.k))))),
open as (select video_id, n, start_ms, end_ms from cues anti join held using (video_id, n)) """


@query(_UNCOVERED + "select * from open", "cues", "segs")
def uncovered_by_containment(s, d):
    return C.uncovered_cues(X.cues(s, d), X.ocr_segments(s, d), least=None).select("video_id", "n", "start_ms", "end_ms")


@query(_UNCOVERED + """
, m as (select *, max(end_ms) over (partition by video_id order by start_ms, end_ms rows between unbounded preceding and 1 preceding) reach from open),
g as (select *, sum(case when reach is null or start_ms > reach + 500 then 1 else 0 end) over (partition by video_id order by start_ms, end_ms rows between unbounded preceding and current row) i from m)
select video_id, min(start_ms) start_ms, max(end_ms) end_ms from g group by video_id, i""", "cues", "segs")
def merge_intervals(s, d):
    """Spans of the cues that no segment contains, merged."""
    return C.merge_intervals(C.uncovered_cues(X.cues(s, d), X.ocr_segments(s, d), least=None))


@query()
def coverage_windows(s, d):
    """Spans of the cues without support, merged."""
    return C.merge_intervals(C.uncovered_cues(X.cues(s, d), X.ocr_segments(s, d)))


@query("select video_id, start_ms//20000 window_index, count(*) cues, max(end_ms) last_end from cues group by all", "cues")
def tumbling_windows(s, d):
    return C.tumbling_windows(X.cues(s, d))


@query("""
, w as (select *, unnest(range((greatest(0, start_ms - 3001)//20000)::bigint, ((end_ms + 3000)//20000 + 1)::bigint)) window_index from cues)
select video_id, window_index, n, start_ms//20000 = window_index target from w where end_ms >= window_index*20000 - 3000 and start_ms <= (window_index+1)*20000 + 3000""", "cues")
def window_context_join(s, d):
    return C.window_context(X.cues(s, d))


@query("""
, r as (select video_id, n, row_number() over (partition by video_id order by n) - 1 i from cues), m as (select video_id, max(i//100) last from r group by 1),
x as (select *, unnest(range((greatest(0, i-10)//100)::bigint, ((i+10)//100 + 1)::bigint)) chunk from r)
select video_id, chunk, n, case when chunk = i//100 then 'target' when chunk > i//100 then 'before' else 'after' end as role from x join m using (video_id) where chunk <= last""", "cues")
def chunk_with_context(s, d):
    return C.chunk_with_context(X.cues(s, d))


def _points(s: SparkSession, d: str) -> DataFrame:
    return X.observations(s, d).select((F.col("video_id") % 4).alias("video_id"), (F.col("ts_ms") % 20000 - 500).alias("t")).distinct()


@query("""
, p as (select distinct video_id % 4 video_id, ts_ms % 20000 - 500 t from observations),
c as (select p.video_id, p.t, arg_min(f.frame_index, (abs(f.ts_ms - greatest(0, p.t)), f.ts_ms)) frame_index from p join frames f using (video_id) group by all) select * from c""", "observations", "frames")
def nearest_frame(s, d):
    return C.nearest_frame(_points(s, d), X.frames(s, d))


@query("""
, p as (select video_id, start_ms + 700 * n t from cues where n % 3 = 0)
select p.video_id, p.t, coalesce(min(case when p.t < c.end_ms then c.n end), max(c.n)) n from (select distinct * from p) p left join cues c on c.video_id = p.video_id and c.start_ms <= p.t group by all""", "cues")
def sentence_at_time(s, d):
    c = X.cues(s, d)
    return C.sentence_at_time(c.where("n % 3 = 0").select("video_id", (F.col("start_ms") + 700 * F.col("n")).alias("t")).distinct(), c)


@query("select video_id, max(end_ms) duration_ms from (select video_id, end_ms from cues union all select video_id, end_ms from segs) group by 1", "cues", "segs")
def effective_duration(s, d):
    return C.effective_duration(X.cues(s, d), X.ocr_segments(s, d))


@query(", r as (select *, row_number() over (partition by video_id order by n) rn from cues) select video_id, case when bool_or(regexp_matches(text, '[A-Za-z]')) then 'en' else 'auto' end as language from r where rn <= 80 group by 1", "cues")
def infer_language(s, d):
    return C.infer_language(X.cues(s, d))


@query("select video_id, printf('s%06d', row_number() over (partition by video_id order by start_ms)) id, n from segs", "cues", "segs")
def assign_ids(s, d):
    return C.assign_ids(X.ocr_segments(s, d), "s", "start_ms").select("video_id", "id", "n")


# Full stops inside a unit, those before no white space, become chr(1), twice as one may follow another; then units, cut at
# white space where kana or kanji are on both sides of some.
_UNITS = r"""
, d0 as (select video_id, n, start_ms, end_ms, regexp_replace(regexp_replace(text, '\.([^\s])', chr(1) || '\1', 'g'), '\.([^\s])', chr(1) || '\1', 'g') as text from cues),
d1 as (select *, list_filter(list_transform(regexp_extract_all(text, '(?s).[^.。！？!?]*(?:[。！？!?]+|[.]|$)'), lambda x: replace(regexp_replace(x, '^\s+|\s+$', '', 'g'), chr(1), '.')), lambda x: x <> '') parts from d0),
u as (select video_id, n, start_ms, end_ms, flatten(list_transform(parts, lambda x: case when regexp_matches(x, '[\x{3040}-\x{9fff}]\s+[\x{3040}-\x{9fff}]') then string_split_regex(x, '\s+') else [x] end)) us from d1),
e as (select video_id, n, start_ms, end_ms, unnest(us) unit, generate_subscripts(us, 1) - 1 pos from u)"""


def _units(s: SparkSession, d: str) -> DataFrame:
    return X.cues(s, d).select("video_id", "n", "start_ms", "end_ms", F.posexplode(T.split_terminal_units(F.col("text"))).alias("pos", "unit"))


@query(_UNITS + "select video_id, n, pos, unit from e", "cues")
def split_terminal_units(s, d):
    return _units(s, d).select("video_id", "n", "pos", "unit")


@query(_UNITS + """
, t as (select *, sum(length(unit)) over (partition by video_id, n order by pos) done, sum(length(unit)) over (partition by video_id, n) total from e)
select video_id, n, pos, unit, start_ms + round_even((end_ms-start_ms)*(done-length(unit))/total, 0)::bigint unit_start, start_ms + round_even((end_ms-start_ms)*done/total, 0)::bigint unit_end from t""", "cues")
def interpolate_unit_times(s, d):
    return C.interpolate_unit_times(_units(s, d))


# ---- text and time functions -----------------------------------------------------------------------------------------


def _column(name: str, make: Callable[[Column], Column], sql: str, view: str = "cues", of: str = "text", keys: tuple[str, ...] = ("video_id", "n")) -> None:
    """A query that projects a whole view: its keys and the function's value."""
    views = {"cues": ["cues"], "segs": ["cues", "segs"], "saves": ["saves"], "sources": ["sources"]}[view]
    read = {"cues": X.cues, "segs": X.ocr_segments, "saves": X.saves, "sources": X.sources}[view]
    QUERIES[name] = lambda s, d: read(s, d).select(*keys, make(F.col(of)).alias("value"))
    SQL[name] = X.sql(f"select {', '.join(keys)}, {sql} as value from {view}", *views)


_COMPARED = r"""regexp_replace({}, '[\s、。，．,.!?！？:：;；''"“”‘’]', '', 'g')"""
_column("normalize_text", T.normalize_text, r"trim(regexp_replace(text, '[ \t]+', ' ', 'g'))")
_column("term_key", T.term_key, r"replace(lower(regexp_replace(text, '\s+', '', 'g')), 'ß', 'ss')")
_column("meaning_key", T.meaning_key, r"replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')")
_column("compact_key", T.compact_key, r"regexp_replace(text, '[ \t\n]+', '', 'g')")
_column("coverage_key", T.coverage_key, _KEY.format("text"))
_column("punct_key", T.punct_key, _COMPARED.format("text"))
_column("content_key", T.content_key, r"regexp_replace(text, '[\s。．.]', '', 'g')")
_column("conservation_key", T.conservation_key, r"regexp_replace(text, '\s', '', 'g')")
_column("sanitize_filename", T.sanitize_filename, r"""regexp_replace(left(coalesce(nullif(regexp_replace(trim(regexp_replace(regexp_replace(text, '[\\/:*?"<>|]', '_', 'g'), '\s+', ' ', 'g')), '^[ .]+|[ .]+$', '', 'g'), ''), 'untitled'), 180), '[ .]+$', '')""")
_column("visible_text", lambda c: T.visible_text(F.concat(F.lit("<b>"), X.escaped(c), F.lit("</b><br/>x"))), "text || chr(10) || 'x'")
_column("format_timestamp", T.format_timestamp, "case when start_ms >= 3600000 then printf('%02d:', start_ms//3600000) else '' end || printf('%02d:%02d.%03d', start_ms//60000%60, start_ms//1000%60, start_ms%1000)", of="start_ms")
_column("parse_timestamp", lambda c: T.parse_timestamp(T.format_timestamp(c)), "start_ms", of="start_ms")
_column("has_kanji", T.has_kanji, "regexp_matches(text, '[㐀-鿿]')")
_column("split_reference_sentences", lambda c: F.array_join(T.split_reference_sentences(c), "|"), r"array_to_string(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '\[[^\]]*\]|【[^】]*】', '', 'g'), '[^。！？!?]+[。！？!?]*'), lambda x: trim(x)), lambda x: x <> ''), '|')")
_column("video_key", T.video_key, "case when page_id % 4 < 3 then 'v' || (page_id//8) end", view="sources", of="source_url", keys=("page_id",))
_column("same_source", T.source_key, "case when page_id % 4 < 3 then 'v' || (page_id//8) else trim(source_url) end", view="sources", of="source_url", keys=("page_id",))
_column("select_display_form", lambda c: T.display_form(F.col("surface"), c), "lemma", view="saves", of="lemma", keys=("save_id",))
_column("format_headword", lambda c: T.headword(c, F.when(F.col("save_id") % 2 == 0, F.col("surface")).otherwise(F.col("reading"))), "case when save_id % 2 = 0 then lemma || '（' || surface || '）' else lemma end", view="saves", of="lemma", keys=("save_id",))
_column("content_fingerprint", lambda c: T.fingerprint(F.col("video_id"), F.col("n"), c), "sha256(concat(video_id, chr(31), n, chr(31), text))")
_column("join_pieces", lambda c: T.join_pieces(F.array(F.lit(" a "), c)), r"case when trim(regexp_replace(text, '\s+', ' ', 'g')) = '' then 'a' when regexp_matches(trim(regexp_replace(text, '\s+', ' ', 'g')), '^[A-Za-z0-9([''\"]') then 'a ' || trim(regexp_replace(text, '\s+', ' ', 'g')) else 'a' || trim(regexp_replace(text, '\s+', ' ', 'g')) end")

# ---- similarity over neighbours and corrections ----------------------------------------------------------------------


def _pairs(s: SparkSession, d: str) -> DataFrame:
    w = W.partitionBy("video_id").orderBy("n")
    return X.cues(s, d).select("video_id", "n", F.col("text").alias("a"), F.lead("text").over(w).alias("b")).where("b is not null")


_PAIRS = ", pr as (select * from (select video_id, n, text a, lead(text) over (partition by video_id order by n) b from cues) where b is not null) "


@query(_PAIRS + "select video_id, n, (least(length(a), length(b)) >= 4 and least(length(a), length(b)) >= 0.30 * greatest(length(a), length(b)) and case when length(a) <= length(b) then contains(b, a) else contains(a, b) end) as value from pr", "cues")
def text_contains(s, d):
    return _pairs(s, d).select("video_id", "n", S.text_contains(F.col("a"), F.col("b")).alias("value"))


@query(_PAIRS + """, c as (select video_id, n, a, b, list_filter(range(least(length(a), length(b)), 3, -1), lambda k: k >= 0.30 * least(length(a), length(b)) and right(a, k::int) = left(b, k::int)) ks from (select video_id, n, trim(regexp_replace(a, '[ \t]+', ' ', 'g')) a, trim(regexp_replace(b, '[ \t]+', ' ', 'g')) b from pr) pr)
select video_id, n, case when len(ks) > 0 then a || substring(b, (ks[1] + 1)::int) end as value from c""", "cues")
def overlap_join(s, d):
    return _pairs(s, d).select("video_id", "n", S.overlap_join(F.col("a"), F.col("b")).alias("value"))


@query()
def indel_ratio(s, d):
    return _pairs(s, d).select("video_id", "n", S.indel_ratio("a", "b").alias("value"))


@query()
def matcher_ratio(s, d):
    return _pairs(s, d).select("video_id", "n", S.matcher_ratio("a", "b").alias("value"))


@query("""select a.video_id, a.frame_index, round(list_dot_product(a.signature::double[], b.signature::double[]) / sqrt(list_dot_product(a.signature::double[], a.signature::double[]) * list_dot_product(b.signature::double[], b.signature::double[])), 6) as value
from frames a join frames b on a.video_id = b.video_id and b.frame_index = a.frame_index + 1""", "frames")
def signature_similarity(s, d):
    f = X.frames(s, d).withColumn("next", F.lead("signature").over(W.partitionBy("video_id").orderBy("frame_index"))).where("next is not null")
    return f.select("video_id", "frame_index", F.round(S.signature_similarity(F.col("signature"), F.col("next")), 6).alias("value"))


_P = "length(" + _COMPARED + ")"
_OUTCOME = f"""
, o as (select s.video_id, s.n, s.text, c.corrected_text x, {_P.format("s.text")} a, {_P.format("c.corrected_text")} b from segs s left join corrections c using (video_id, n)),
f as (select *, case when x is null or trim(x) = '' or x = text then 'kept' when a > 0 and b > 0 and abs(a - b) <= greatest(2, round_even(a * 0.2::double, 0)) then 'changed' else 'rejected' end outcome from o) """


@query(_OUTCOME + "select video_id, n, outcome, text original_text, case when outcome = 'changed' then x else text end final_text from f", "cues", "segs", "corrections")
def apply_corrections(s, d):
    return K.apply_corrections(X.ocr_segments(s, d), X.corrections(s, d))


@query(_OUTCOME + "select video_id, n, (a > 0 and b > 0 and abs(a - b) <= greatest(2, round_even(a * 0.2::double, 0))) as value from f where x is not null", "cues", "segs", "corrections")
def safe_correction(s, d):
    return X.ocr_segments(s, d).join(X.corrections(s, d), ["video_id", "n"]).select("video_id", "n", S.safe_correction(F.col("text"), F.col("corrected_text")).alias("value"))


# ---- study library ---------------------------------------------------------------------------------------------------

_LIB = ", k as (select *, kind || '␟' || lemma || '␟' || reading entry_key from saves) "


@query(_LIB + """select save_id, row_number() over (partition by entry_key order by save_id) = 1 added_entry, row_number() over (partition by entry_key, surface order by save_id) = 1 added_form,
row_number() over (partition by entry_key, meaning order by save_id) = 1 added_meaning, row_number() over (partition by entry_key, context_key order by save_id) = 1 added_encounter from k""", "saves")
def upsert_library(s, d):
    return L.upsert_library(X.saves(s, d))


# An entry changes with a new form, meaning or encounter.
_ENTRIES = _LIB + """, m as (select entry_key, meaning, min(save_id) f from k group by all), u as (select entry_key, max(f) updated from (select entry_key, min(save_id) f from k group by entry_key, surface union all select entry_key, min(save_id) from k group by entry_key, meaning
  union all select entry_key, min(save_id) from k group by entry_key, context_key) group by 1),
e as (select entry_key, count(distinct context_key) encounters, count(distinct surface) forms, any_value(updated) updated from k join u using (entry_key) group by 1),
w as (select entry_key, arg_min(lemma, save_id) lemma, arg_min(reading, save_id) reading, arg_min(surface, save_id) filter (regexp_matches(surface, '[㐀-鿿]')) form from k group by 1),
x as (select e.*, reading, case when regexp_matches(lemma, '[㐀-鿿]') then lemma else coalesce(form, lemma) end display, (select list(meaning order by f) from m where m.entry_key = e.entry_key) meanings from e join w using (entry_key)) """


@query(_ENTRIES + "select entry_key, encounters, forms, updated, display, reading, array_to_string(meanings, ',') meanings from x", "saves")
def library_entries(s, d):
    return L.library_entries(X.saves(s, d)).withColumn("meanings", F.array_join("meanings", ","))


@query(_ENTRIES + "select count(*) entries, sum(encounters)::bigint encounters from x", "saves")
def library_totals(s, d):
    return L.library_totals(X.saves(s, d))


@query(_ENTRIES + "select entry_key, encounters, updated from x order by encounters desc, updated desc, entry_key limit 240", "saves")
def top_library_entries(s, d):
    return L.top_library_entries(X.saves(s, d))


@query(_ENTRIES.replace(_LIB, _LIB.replace("from saves", "from (select * replace (case when save_id % 5 = 0 then surface || '漢' else surface end as surface, case when user_id % 2 = 0 then 'r' || lemma else '' end as reading) from (select s.*, e.user_id from saves s join events e on e.event_id = s.save_id))"))
       + "select entry_key, updated, display || case when reading <> '' then '（' || reading || '）' else '' end || '：' || array_to_string(meanings, '；') line from x", "saves")
def export_glossary(s, d):
    """Every fifth surface has kanji, half of the users' words have readings."""
    k = F.col("save_id")
    users = X.read(s, d, "events").select(F.col("event_id").alias("save_id"), "user_id")
    v = X.saves(s, d).join(users, "save_id").withColumn("surface", F.when(k % 5 == 0, F.concat("surface", F.lit("漢"))).otherwise(F.col("surface")))
    return L.export_glossary(v.withColumn("reading", F.when(F.col("user_id") % 2 == 0, F.concat(F.lit("r"), "lemma")).otherwise("")))


@query(_LIB + ", c as (select entry_key, context_key, min(save_id) save_id, arg_min(meaning, save_id) meaning from k group by 1, 2) select *, row_number() over (partition by entry_key order by save_id desc) as rank from c", "saves")
def entry_encounters(s, d):
    return L.entry_encounters(X.saves(s, d))


@query(_LIB + "select save_id, entry_key from k where kind <> 'grammar'", "saves")
def delete_entry_cascade(s, d):
    v = X.saves(s, d)
    return L.delete_entry_cascade(v, L.keyed(v).where("kind = 'grammar'")).select("save_id", "entry_key")


@query(", g as (select distinct case when page_id % 4 < 3 then 'v' || (page_id//8) else trim(source_url) end k from sources where page_id % 10 = 0), s as (select *, case when page_id % 4 < 3 then 'v' || (page_id//8) else trim(source_url) end k from sources) select page_id from s where k not in (select k from g)", "sources")
def purge_source(s, d):
    v = X.sources(s, d)
    return L.purge_source(v, v.where("page_id % 10 = 0")).select("page_id")


@query("select distinct path from assets where conv_id % 3 = 0 and path not in (select path from assets where conv_id % 3 <> 0)", "assets")
def orphan_assets(s, d):
    a = X.assets(s, d)
    return L.orphan_assets(a, a.where("conv_id % 3 = 0").select("job_id").distinct())


@query("select job_id, max(conv_id) conv_id, count(*) results from assets group by 1 order by 2 desc, 1 limit 100", "assets")
def recent_history(s, d):
    return L.recent_history(X.assets(s, d))


from . import documents, engines, frames, records, reuse, sentences, streams  # noqa: E402,F401  (add their queries)
