"""Timed-text tables over the given star schema: each is a view, so every query's work grows with the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

DURATION, INTERVAL = 2_592_000, 2_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def observations(spark: SparkSession, d: str) -> DataFrame:
    return observations_of(read(spark, d, "events"))


def observations_of(events: DataFrame, *more: str) -> DataFrame:
    return events.select(
        *more,
        (F.col("user_id") % 16).alias("video_id"), F.col("event_id").alias("frame_index"), (F.unix_seconds(F.col("ts").cast("timestamp")) - 1704067200).alias("ts_ms"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"), F.least(F.col("value") / 500.0, F.lit(1.0)).alias("confidence"), F.expr("event_id div 4").alias("batch_index"),
    )


def cues(spark: SparkSession, d: str) -> DataFrame:
    lines = read(spark, d, "documents").select(F.col("doc_id").alias("video_id"), F.posexplode(F.split("text", "\n")).alias("p", "t")).where(F.trim("t") != "")
    # Numbers and running lengths have one key and one order, so texts are shuffled and sorted once.
    upto = W.partitionBy("video_id").orderBy("p").rowsBetween(W.unboundedPreceding, W.currentRow)
    k = lines.select("video_id", "p", F.trim("t").alias("text")).withColumns({"n": F.row_number().over(upto).cast("long"), "end": F.sum(F.length("text")).over(upto)})
    return k.select("video_id", "n", "text", (60 * (F.col("end") - F.length("text"))).alias("start_ms"), (60 * F.col("end") + 500).alias("end_ms"))


def escaped(c: Column) -> Column:
    """Markup characters as references, as files with markup hold them."""
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def ocr_segments(spark: SparkSession, d: str) -> DataFrame:
    return segments_of(cues(spark, d))


def segments_of(cues: DataFrame) -> DataFrame:
    # Said without a null in it, as a filter for null videos would go below the cues' shuffle, and both sides couldn't share it.
    c = cues.where(F.coalesce((F.col("video_id") * 31 + F.col("n")) % 7, F.lit(0)) != 0)
    noisy = (F.col("video_id") + F.col("n")) % 5 == 0
    return c.select(
        "video_id", "n", (F.col("start_ms") + 40).alias("start_ms"), (F.col("end_ms") - 40).alias("end_ms"), F.when(noisy, F.replace("text", F.lit("e"), F.lit("c"))).otherwise(F.col("text")).alias("text"),
        (((F.col("video_id") * 7 + F.col("n") * 13) % 100) / 100.0).alias("confidence"), (1 + F.col("n") % 4).alias("observation_count"),
    )


def corrections(spark: SparkSession, d: str) -> DataFrame:
    s, c = ocr_segments(spark, d).select("video_id", "n"), cues(spark, d).select("video_id", "n", "text")
    v = F.col("video_id") + F.col("n")
    new = F.when(v % 13 == 0, "").when(v % 11 == 0, F.substr(F.col("text"), F.lit(1), F.expr("length(text) div 3"))).otherwise(F.col("text"))
    return s.join(c, ["video_id", "n"]).where((v % 13 == 0) | (v % 11 == 0) | (v % 5 == 0)).select("video_id", "n", new.alias("corrected_text"))


def frames(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "embeddings").withColumn("video_id", F.col("vec_id") % 4)
    i = F.row_number().over(W.partitionBy("video_id").orderBy("label", "vec_id")).cast("long")
    return e.select("video_id", i.alias("frame_index"), "embedding", "vec_id").select("video_id", "frame_index", ((F.col("frame_index") - 1) * 100).alias("ts_ms"), F.col("embedding").alias("signature"), (F.col("frame_index") % 3).alias("visual_line_count"), "vec_id")


def saves(spark: SparkSession, d: str) -> DataFrame:
    return saves_of(read(spark, d, "events"))


def saves_of(events: DataFrame) -> DataFrame:
    u, w = F.col("user_id"), F.concat(F.lit("w"), (F.col("user_id") % 97).cast("string"))
    return events.select(
        F.col("event_id").alias("save_id"), F.when(u % 3 == 0, "word").when(u % 3 == 1, "collocation").otherwise("grammar").alias("kind"), w.alias("lemma"), F.concat(w, "event_type").alias("surface"), F.lit("").alias("reading"),
        F.concat(F.lit("m"), (F.col("event_id") % 5).cast("string")).alias("meaning"), F.concat(u.cast("string"), F.lit(":"), F.date_format("ts", "yyyy-MM-dd")).alias("context_key"),
    )


def sources(spark: SparkSession, d: str) -> DataFrame:
    v = F.concat(F.lit("v"), F.expr("page_id div 8").cast("string"))
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("https://www.youtube.com/watch?v="), v, F.lit("&si=x"))).when(k == 1, F.concat(F.lit("https://youtu.be/"), v, F.lit("?si=y"))).when(k == 2, F.concat(F.lit("https://m.youtube.com/shorts/"), v)).otherwise(F.col("url"))
    return read(spark, d, "pages").select("page_id", url.alias("source_url"))


def assets(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("turn") % 4
    return read(spark, d, "conversations").select(
        F.concat(F.lit("job"), F.col("conv_id").cast("string")).alias("job_id"), (F.col("conv_id") % 20).alias("source_no"), F.col("conv_id"), F.col("turn"), F.when(t == 0, "raw").when(t == 1, "corrected").when(t == 2, "organized").otherwise("audio").alias("kind"),
        F.concat(F.lit("out/"), (F.col("conv_id") % 20).cast("string"), F.lit("/"), t.cast("string")).alias("path"), F.col("role").alias("stage"), F.length("text").cast("long").alias("tokens"),
    )


#: The same views in DuckDB SQL, for ``with`` clauses.
SQL = {
    "observations": "select user_id % 16 video_id, event_id frame_index, epoch_us(ts)//1000000 - 1704067200 ts_ms, case event_type when 'error' then '' else event_type end text, least(value/500.0::double, 1.0::double) confidence, event_id//4 batch_index from events",
    "cues": "select doc_id video_id, n, text, (60*(sum(length(text)) over (partition by doc_id order by n) - length(text)))::bigint start_ms, (60*(sum(length(text)) over (partition by doc_id order by n)) + 500)::bigint end_ms from (select doc_id, trim(t) as text, row_number() over (partition by doc_id order by p) n from (select doc_id, unnest(string_split(text,chr(10))) t, generate_subscripts(string_split(text,chr(10)),1) p from documents) where trim(t) <> '')",
    "segs": "select video_id, n, start_ms+40 start_ms, end_ms-40 end_ms, case when (video_id+n)%5=0 then replace(text,'e','c') else text end as text, ((video_id*7+n*13)%100)/100.0::double confidence, 1+n%4 observation_count from cues where (video_id*31+n)%7<>0",
    "corrections": "select s.video_id, s.n, case when (s.video_id+s.n)%13=0 then '' when (s.video_id+s.n)%11=0 then substring(c.text,1,(length(c.text)//3)::int) else c.text end corrected_text from segs s join cues c using (video_id,n) where (video_id+n)%5=0 or (video_id+n)%11=0 or (video_id+n)%13=0",
    "frames": "select vec_id%4 video_id, row_number() over (partition by vec_id%4 order by label, vec_id) frame_index, (row_number() over (partition by vec_id%4 order by label, vec_id)-1)*100 ts_ms, embedding signature, (row_number() over (partition by vec_id%4 order by label, vec_id))%3 visual_line_count, vec_id from embeddings",
    "saves": "select event_id save_id, case user_id%3 when 0 then 'word' when 1 then 'collocation' else 'grammar' end kind, concat('w', user_id%97) lemma, concat('w', user_id%97, event_type) surface, '' reading, concat('m', event_id%5) meaning, concat(user_id, ':', strftime(ts,'%Y-%m-%d')) context_key from events",
    "sources": "select page_id, case page_id%4 when 0 then concat('https://www.youtube.com/watch?v=v',page_id//8,'&si=x') when 1 then concat('https://youtu.be/v',page_id//8,'?si=y') when 2 then concat('https://m.youtube.com/shorts/v',page_id//8) else url end source_url from pages",
    "assets": "select concat('job',conv_id) job_id, conv_id%20 source_no, conv_id, turn, case turn%4 when 0 then 'raw' when 1 then 'corrected' when 2 then 'organized' else 'audio' end kind, concat('out/',conv_id%20,'/',turn%4) path, role stage, length(text)::bigint tokens from conversations",
}


def sql(body: str, *views: str) -> str:
    """``body`` after the views it reads, in order."""
    return "with " + ", ".join(f"{v} as ({SQL[v]})" for v in views) + body
