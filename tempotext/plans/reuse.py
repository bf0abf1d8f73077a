"""Queries of reuse, transcripts on disk, roll-ups, library state and replies, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions import similarity as S, text as T
from ..operators import library as L, reuse as R
from ..sources.shared import scratch
from . import fixtures as X
from .documents import _DOCUMENT, _document, _spoken
from .registry import _LIB, _PAIRS, _PASS1, _pairs, _segments, query

# ---- roll-ups and text pairs -----------------------------------------------------------------------------------------


@query("""
, t as (select video_id, batch_index, text, min((ts_ms, frame_index)) f, count(*) n, sum(greatest(confidence, 0.01)) score, sum(confidence) total from observations where trim(text) <> '' group by 1, 2, 3),
r as (select *, row_number() over (partition by video_id, batch_index order by n desc, length(text) desc, score desc, f) rn from t)
select video_id, batch_index, max(case when rn = 1 then text end) as text, coalesce(string_agg(text, '|' order by rn) filter (rn between 2 and 4), '') alternatives, round(sum(total) / sum(n), 6) confidence from r group by 1, 2""", "observations")
def representative_text(s, d):
    return R.representative_text(X.observations(s, d), "video_id", "batch_index").withColumns({"alternatives": F.array_join("alternatives", "|"), "confidence": F.round("confidence", 6)})


@query("select video_id, n//10 part, round(sum(confidence * observation_count) / sum(observation_count), 6) confidence, sum(observation_count)::bigint observation_count from segs group by 1, 2", "cues", "segs")
def weighted_confidence(s, d):
    return R.weighted_confidence(X.ocr_segments(s, d).withColumn("part", F.expr("n div 10")), "video_id", "part").withColumn("confidence", F.round("confidence", 6))


@query(", f as (select video_id, text, min(n) n from cues group by 1, 2), r as (select *, row_number() over (partition by video_id order by n) rn from f) select video_id, string_agg(text, '|' order by n) as values_ from r where rn <= 3 group by 1", "cues")
def ordered_distinct(s, d):
    return R.ordered_distinct(X.cues(s, d), "video_id", "text", "n").select("video_id", F.array_join("values", "|").alias("values_"))


@query(_DOCUMENT + "select video_id, case when bool_or(source = 'youtube_primary' and video_id % 3 = 0) then 'youtube_primary+burned_ocr_visual_verification' when bool_or(video_id % 3 = 1) then 'burned_ocr+youtube_reading_reference' else 'burned_ocr' end as label from doc group by 1", "cues", "segs")
def subtitle_source_label(s, d):
    v = F.col("video_id") % 3
    return R.subtitle_source_label(_document(s, d).withColumn("source", F.when((v == 0) & (F.col("source") == "youtube_primary"), F.col("source")).when(v == 1, "burned_ocr_corrected").otherwise("burned_ocr")))


@query()
def similar_text(s, d):
    return _pairs(s, d).select("video_id", "n", R.similar_text(F.col("a"), F.col("b")).alias("value"))


def _noisy(s, d) -> DataFrame:
    c = X.cues(s, d).select("video_id", "n", F.col("text").alias("reference"))
    return X.ocr_segments(s, d).select("video_id", "n", "text").join(c, ["video_id", "n"])


@query()
def reference_conflict(s, d):
    return R.reference_conflict(_noisy(s, d), "video_id", "n")


@query()
def align_characters(s, d):
    a = _noisy(s, d).select("video_id", "n", F.explode(S.align_characters(F.col("reference"), F.col("text"))).alias("x"))
    return a.select("video_id", "n", "x.a_index", "x.b_index")


@query(r"""select video_id, n, array_to_string(string_split(regexp_replace(text, '[\s、。，．,.!?！？:：;；''"“”‘’]', '', 'g'), ''), '|') as value from cues""", "cues")
def comparable_chars(s, d):
    return X.cues(s, d).select("video_id", "n", F.array_join(T.comparable_chars(F.col("text")), "|").alias("value"))


# ---- decisions -------------------------------------------------------------------------------------------------------


@query("""
, c as (select video_id, n, case when (video_id+n)%13=0 then 'old' when (video_id+n)%11=0 then 'third' else text end x from segs where (video_id+n)%5=0 or (video_id+n)%11=0 or (video_id+n)%13=0)
select s.video_id, s.n, c.x corrected_text, case when c.n is null then 'missing' else 'kept' end status from segs s left join c using (video_id, n) where s.n % 3 <> 0 and (c.n is not null or s.n % 7 = 1)""", "cues", "segs")
def validate_corrections(s, d):
    v = F.col("video_id") + F.col("n")
    t = X.ocr_segments(s, d)
    c = t.where((v % 5 == 0) | (v % 11 == 0) | (v % 13 == 0)).select("video_id", "n", F.lit(2).alias("ord"), F.when(v % 13 == 0, "old").when(v % 11 == 0, "third").otherwise(F.col("text")).alias("corrected_text"))
    return R.validate_corrections(c.unionByName(c.withColumns({"ord": F.lit(1), "corrected_text": F.lit("zzz")})), t.where("n % 3 <> 0").withColumn("conflict", F.col("n") % 7 == 1))


@query("""
, k as (select video_id, start_ms//20000 window_index, n id, (n - 1)//2 ord from cues), named as (select distinct video_id, window_index, id from k where ord % 5 = 0 and video_id % 4 <> 0),
w as (select video_id, window_index from k where ord % 5 = 0 group by all)
select * from named union all select video_id, window_index, id from k join w using (video_id, window_index) where video_id % 4 = 0""", "cues")
def review_ids(s, d):
    c = X.cues(s, d).select("video_id", F.expr("start_ms div 20000").alias("window_index"), F.col("n").alias("id"), F.expr("(n - 1) div 2").alias("ord"))
    made = c.select("video_id", "window_index", F.lit("spoken").alias("kind"), F.when(F.col("video_id") % 4 != 0, F.array("id")).otherwise(F.array().cast("array<bigint>")).alias("ids"), (F.col("ord") % 5 == 0).alias("recheck"))
    return R.review_ids(made, c)


# ---- library ---------------------------------------------------------------------------------------------------------


@query(_LIB + """, l as (select * from k where save_id % 2 = 0 and kind <> 'grammar'), i as (select save_id item_id, entry_key, 'm' || (save_id % 7) meaning, context_key from k where save_id % 3 = 0),
e as (select entry_key, count(distinct meaning) m, count(distinct context_key) c from l group by 1)
select item_id, e.entry_key is not null entry_exists, (entry_key, i.meaning) in (select (entry_key, meaning) from l) meaning_saved, (entry_key, i.context_key) in (select (entry_key, context_key) from l) context_saved, coalesce(m, 0) meaning_count, coalesce(c, 0) encounter_count from i left join e using (entry_key)""", "saves")
def library_state(s, d):
    v = X.saves(s, d)
    items = v.where("save_id % 3 = 0").select(F.col("save_id").alias("item_id"), "kind", "lemma", "surface", "reading", F.concat(F.lit("m"), (F.col("save_id") % 7).cast("string")).alias("meaning"), "context_key")
    return L.library_state(items, v.where("save_id % 2 = 0 and kind <> 'grammar'"))


@query("""
, k as (select *, kind || '␟' || lemma || '␟' || reading entry_key from saves), upd as (select entry_key, max(f) updated from (select entry_key, min(save_id) f from k group by entry_key, surface union all select entry_key, min(save_id) from k group by entry_key, meaning
  union all select entry_key, min(save_id) from k group by entry_key, context_key) group by 1), e as (select entry_key, count(distinct context_key) enc, any_value(updated) updated, list_distinct(list_append(list(surface), any_value(lemma))) forms from k join upd using (entry_key) group by 1),
top as (select * from e order by enc desc, updated desc, entry_key limit 240), t as (select video_id, n, replace(lower(regexp_replace(text || 'w' || (n % 97), '\\s+', '', 'g')), 'ß', 'ss') t from cues),
x as (select video_id, n, entry_key, len(list_filter(forms, lambda f: contains(t, f))) > 0 hit, row_number() over (partition by video_id, n order by len(list_filter(forms, lambda f: contains(t, f))) > 0 desc, enc desc, updated desc, entry_key) rn from t, top)
select video_id, n, sum(hit::int)::bigint matches, string_agg(entry_key, ',' order by rn) entries from x where rn <= 80 group by 1, 2""", "cues", "saves")
def library_context(s, d):
    c = X.cues(s, d).withColumn("text", F.concat("text", F.lit("w"), (F.col("n") % 97).cast("string")))
    return L.library_context(c, X.saves(s, d)).withColumn("entries", F.array_join("entries", ","))


@query("select conv_id, turn, job_id, case when conv_id % 3 = 0 or conv_id % 5 = 0 then path else 'T' || conv_id end title from assets", "assets")
def encounter_titles(s, d):
    a = X.assets(s, d).select("conv_id", "turn", "job_id", F.col("path").alias("source_url"))
    h = a.where("conv_id % 3 <> 0").select("job_id", F.when(F.col("conv_id") % 5 == 0, " ").otherwise(F.concat(F.lit("T"), F.col("conv_id").cast("string"))).alias("title"))
    return L.encounter_titles(a, h).drop("source_url")


@query(_LIB + """, e as (select entry_key, any_value(lemma) lemma from k group by 1), f as (select entry_key, arg_min(surface || '漢', save_id) form from k where save_id % 3 = 0 group by 1)
select entry_key, case when lemma like '%5' then lemma || '字' else coalesce(form, lemma) end as display from e left join f using (entry_key)""", "saves")
def repair_display(s, d):
    v = X.saves(s, d)
    e = L.keyed(v).groupBy("entry_key").agg(F.min("lemma").alias("lemma"))
    return L.repair_display(e.withColumn("display", F.when(F.col("lemma").endswith("5"), F.concat("lemma", F.lit("字"))).otherwise(F.col("lemma"))), v.withColumn("surface", F.when(F.col("save_id") % 3 == 0, F.concat("surface", F.lit("漢"))).otherwise(F.col("surface"))))


# ---- analysis replies ------------------------------------------------------------------------------------------------


def _analysis(s, d) -> DataFrame:
    """A reply for each context, in a code fence with talk around it: words and grammar of its saves; every seventh has no JSON."""
    v = X.saves(s, d)
    word = F.when(F.col("kind") != "grammar", F.struct("kind", F.col("surface").alias("expression"), "lemma", "reading", "meaning"))
    rule = F.when(F.col("kind") == "grammar", F.struct(F.col("surface").alias("pattern"), "lemma", F.col("meaning").alias("explanation")))
    g = v.groupBy(F.col("context_key").alias("sentence_id")).agg(F.min("save_id").alias("first"), F.to_json(F.struct(F.lit("x").alias("translation"), F.collect_list(word).alias("vocabulary"), F.collect_list(rule).alias("grammar"))).alias("j"))
    return g.select("sentence_id", F.when(F.col("first") % 7 == 0, "no answer").otherwise(F.concat(F.lit("Sure:\n```json\n"), "j", F.lit("\n```"))).alias("reply"))


_ASKED = ", bad as (select context_key from saves group by 1 having min(save_id) % 7 = 0) "


@query(_ASKED + "select context_key sentence_id, kind, surface, lemma, reading, meaning from saves where context_key not in (select context_key from bad)", "saves")
def flatten_analysis(s, d):
    return L.flatten_analysis(_analysis(s, d))


@query(_ASKED + "select context_key sentence_id, case when context_key not in (select context_key from bad) then 'x' end translation from saves group by 1", "saves")
def parse_fenced_json(s, d):
    return _analysis(s, d).select("sentence_id", F.from_json(T.fenced_json(F.col("reply")), "translation string")["translation"].alias("translation"))


@query("select context_key sentence_id, coalesce(string_agg(save_id, ',' order by save_id) filter (save_id % 3 = 0 and save_id % 2 = 0), '') missing from saves group by 1", "saves")
def missing_reading(s, d):
    k = F.col("save_id")
    items = X.saves(s, d).select(F.col("context_key").alias("sentence_id"), k.alias("pos"), F.when(k % 3 == 0, F.concat("surface", F.lit("漢"))).otherwise(F.col("surface")).alias("surface"), "lemma", F.when(k % 2 == 0, " ").otherwise("r").alias("reading"))
    return L.missing_reading(items).withColumn("missing", F.array_join(F.col("missing").cast("array<string>"), ","))


# ---- reuse and files -------------------------------------------------------------------------------------------------


@query("select distinct 'job' || conv_id job_id, conv_id % 2 = 0 and conv_id % 3 = conv_id % 20 % 3 compatible from conversations")
def reuse_compatible(s, d):
    c = X.read(s, d, "conversations").select("conv_id").distinct()
    config = lambda v, roi, m: [v.alias("video_id"), F.lit(10).alias("fps"), roi.alias("roi"), F.lit("ja").alias("language"), F.concat(F.lit("m"), (m % 3).cast("string")).alias("model")]
    k = F.col("conv_id")
    wanted = c.select(F.concat(F.lit("job"), k.cast("string")).alias("job_id"), *config(k % 20, F.when(k % 2 != 0, "full"), k))
    return R.reuse_compatible(wanted, c.select(*config(k % 20, F.lit(None).cast("string"), k % 20)))


_SOURCE = "case when page_id % 4 < 3 then 'v' || (page_id//8) else trim(source_url) end"


@query(f""", s as (select page_id, {_SOURCE} k from sources), h as (select k, arg_max(page_id, page_id) filter (page_id % 6 = 0) r, arg_max(page_id, page_id) filter (page_id % 6 = 3) a from s where page_id % 3 = 0 group by 1),
t as (select k, min('output/' || page_id || '.md') f from s where page_id % 5 = 0 and page_id % 2 = 1 group by 1), o as (select distinct k from s where page_id % 7 = 0 and page_id % 2 = 1),
b as (select 'output/raw' || page_id stem from s where page_id % 12 = 0 union all select 'output/' || page_id from s where page_id % 3 = 0),
j as (select page_id request_id, case when o.k is null then coalesce('output/raw' || r, f) end path, a from s left join h using (k) left join t using (k) left join o using (k)) select request_id, path, case when path is not null then coalesce(b.stem || '.m4a', 'output/audio' || a) end audio from j left join b on b.stem = replace(path, '.md', '')""", "sources")
def find_reusable(s, d):
    v, k = X.sources(s, d), F.col("page_id")
    name = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y.cast("string") for y in x])
    history = v.where(k % 3 == 0).select("source_url", F.when(k % 6 == 0, "raw").otherwise("audio").alias("kind"), F.when(k % 6 == 0, name("output/raw", k)).otherwise(name("output/audio", k)).alias("path"), k.alias("at"))
    files = v.where(k % 5 == 0).select("source_url", F.when(k % 2 == 1, name("output/", k, ".md")).otherwise(name("output/", k, "（整理版）.md")).alias("path"))
    configs = v.where(k % 7 == 0).select("source_url", (k % 2).alias("pipeline_revision"))
    audio = v.where(k % 12 == 0).select(name("output/raw", k, ".m4a").alias("path")).unionByName(v.where(k % 3 == 0).select(name("output/", k, ".m4a").alias("path")))
    return R.find_reusable(v.withColumnRenamed("page_id", "request_id"), history, files, configs, 0, audio)


@query("""select 'output/t' || page_id || '.md' path, 'output/t' || page_id stem, page_id modified, case when page_id % 3 = 0 then 'output/t' || page_id || '.m4a' end audio, case when page_id % 5 = 0 then 'output/t' || page_id || '（整理版）.md' end organized,
case when page_id % 2 = 0 then url else 't' || page_id end title, case when page_id % 11 = 0 then '' else 'https://x.example/' || page_id end source_url, case when page_id % 7 = 0 then 'a/' || page_id end sentences from pages where page_id % 4 <> 0 order by page_id desc limit 100""")
def discover_transcripts(s, d):
    p, k = X.read(s, d, "pages"), F.col("page_id")
    name = lambda end: F.concat(F.lit("output/t"), k.cast("string"), F.lit(end))
    made = {".md": k % 4 != 0, "（整理版）.md": (k % 4 == 0) | (k % 5 == 0), ".m4a": k % 3 == 0}
    files = p.select(F.explode(F.filter(F.array(*[F.when(x, name(end)) for end, x in made.items()]), lambda x: x.isNotNull())).alias("path"), k.alias("modified"))
    metadata = p.where(k % 11 != 0).select(name(".md").alias("path"), F.when(k % 2 == 0, F.col("url")).alias("title"), F.concat(F.lit("https://x.example/"), k.cast("string")).alias("source_url"))
    metadata = metadata.unionByName(p.where(k % 11 == 0).select(name(".md").alias("path"), F.when(k % 2 == 0, F.col("url")).otherwise("").alias("title"), F.lit(None).cast("string").alias("source_url")))
    sentences = p.where(k % 7 == 0).select(F.concat(F.lit("t"), k.cast("string"), F.lit(".md")).alias("source_name"), F.explode(F.array(F.lit("a/"), F.lit("b/"))).alias("path"), k).select("source_name", F.concat("path", k.cast("string")).alias("path"))
    return R.discover_transcripts(files, 100, metadata, sentences)


@query("select doc_id video_id, case when doc_id % 5 = 0 then '' else trim(replace(text, chr(10), ' ')) end title, case when doc_id % 3 = 0 then '' else 'https://x.example/' || doc_id end source_url from documents")
def read_transcript_metadata(s, d):
    k, t = F.col("doc_id"), F.replace("text", F.lit("\n"), F.lit(" "))
    quoted = F.regexp_replace(F.to_json(F.array(t)), r"(?s)^\[|\]$", "")
    filler = F.when(k % 3 == 0, F.repeat(F.lit("-\n"), F.lit(20))).otherwise("")
    body = F.concat(F.lit("---\ntitle: "), F.when(k % 5 == 0, "not json").otherwise(quoted), F.lit("\n"), filler, F.lit('source_url: "https://x.example/'), k.cast("string"), F.lit('"\n---\n'), "text")
    return R.read_transcript_metadata(X.read(s, d, "documents").where("text is not null").select(k.alias("video_id"), body.alias("body")))


@query("select video_id, n, case when video_id % 3 = 0 then 'c' || n else text end as text from segs", "cues", "segs")
def read_stage(s, d):
    o = X.ocr_segments(s, d).select("video_id", "n", "text")
    return R.read_stage(o, o.where("video_id % 3 = 0").withColumn("text", F.concat(F.lit("c"), F.col("n").cast("string"))))


# One file a video and stage: every third video has a corrected one, that of 6 has a broken line, the raw one of 5 an ill-typed one.
_UNREADABLE = {(6, "corrected"): '{"start_ms": 1, ', (5, "raw"): '{"start_ms": "soon", "text": "x"}'}


def _stage_lines(s, d) -> DataFrame:
    """The segments of the observations as JSON lines in files by video and stage, read back as text."""
    g, path = _segments(s, d).select("video_id", "start_ms", "text"), scratch(s, "stage-files")
    line = lambda text: F.to_json(F.struct("start_ms", text.alias("text"))).alias("value")
    lines = g.select("video_id", F.lit("raw").alias("stage"), line(F.col("text")))
    lines = lines.unionByName(g.where("video_id % 3 = 0").select("video_id", F.lit("corrected").alias("stage"), line(F.concat(F.lit("c"), "text"))))
    bad = s.createDataFrame([(*k, v) for k, v in _UNREADABLE.items()], "video_id long, stage string, value string")
    lines.unionByName(bad.join(g.select("video_id").distinct(), "video_id", "left_semi").select(*lines.columns)).write.partitionBy("video_id", "stage").text(path)
    return s.read.schema("value string, video_id long, stage string").text(path)


_STAGE = StructType([StructField("start_ms", LongType()), StructField("text", StringType())])


@query(_PASS1 + "select video_id, start_ms, case when video_id % 3 = 0 then 'c' || text else text end as text from p1 where video_id not in (5, 6)", "observations")
def read_stage_lines(s, d):
    return R.read_stage_lines(_stage_lines(s, d), _STAGE)[0]


@query(_PASS1 + "select distinct video_id, case video_id when 5 then 'raw' else 'corrected' end stage, case video_id when 5 then '" + _UNREADABLE[5, "raw"] + "' else '" + _UNREADABLE[6, "corrected"] + "' end as value from p1 where video_id in (5, 6)", "observations")
def stage_rejects(s, d):
    return R.read_stage_lines(_stage_lines(s, d), _STAGE)[1]


@query(", w as (select distinct video_id from segs where video_id % 5 = 0 and n % 2 = 0) select video_id, n, case when video_id in (select video_id from w) then 'new' else text end as text from segs where video_id not in (select video_id from w) or n % 2 = 0", "cues", "segs")
def write_stage(s, d):
    o, path = X.ocr_segments(s, d).select("video_id", "n", "text"), scratch(s, "stage")
    R.write_stage(o, path, o.schema, 16)
    R.write_stage(o.where("video_id % 5 = 0 and n % 2 = 0").withColumn("text", F.lit("new")), path, o.schema, 16)
    return R.load_stage(s, path, o.schema)


@query("""
, r as (select video_id, n, row_number() over (partition by video_id order by n) - 1 i from cues), m as (select video_id, max(i//100) last from r group by 1), x as (select *, unnest(range((greatest(0, i-10)//100)::bigint, ((i+10)//100 + 1)::bigint)) chunk from r)
select distinct video_id, chunk from x join m using (video_id) where chunk <= last and (n % 150 = 97 or n % 400 = 211)""", "cues")
def incremental_chunks(s, d):
    c = X.cues(s, d).withColumn("references", F.array("text"))
    old = c.withColumns({"text": F.when(F.col("n") % 150 == 97, F.concat("text", F.lit("~"))).otherwise(F.col("text")), "references": F.when(F.col("n") % 400 != 211, F.col("references"))})
    return R.incremental_chunks(c, R.chunk_fingerprints(old))
