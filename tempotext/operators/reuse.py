"""Reuse of earlier results, transcripts on disk, stage tables, and small roll-ups of segments.

Keys that are null never match, except configurations, which compare null-safe; empty tables give empty tables.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType

from ..functions.similarity import default_matcher_ratio, ratio_reaches
from ..functions.text import fingerprint, normalize_text, normalized, source_key
from ..sources import snapshots
from ..sources.shared import kept
from .cues import chunk_with_context
from .segments import ALTERNATIVES, Votes

# Name marks of derived transcripts, and the marks that conflicts with references ignore.
DERIVED = ("（整理版", "综合校正版")
ORGANIZED = "（整理版）"
IGNORED = r"""[\s、。，．,.!?！？:：;；'"“”‘’]+"""
CONFIG = ("fps", "roi", "language", "model")


def reuse_compatible(wanted: DataFrame, saved: DataFrame) -> DataFrame:
    """(job_id, compatible): a saved run of the job's video has the same rate, region, language and model; revisions may differ."""
    b = saved.select(F.col("video_id").alias("_v"), *[F.col(c).alias(f"_{c}") for c in CONFIG]).distinct()
    same = F.col("video_id") == F.col("_v")
    for c in CONFIG:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    hit = wanted.join(b, same, "left_semi").select("job_id").distinct().withColumn("compatible", F.lit(True))
    return wanted.select("job_id").distinct().join(hit, "job_id", "left").select("job_id", F.coalesce("compatible", F.lit(False)).alias("compatible"))


def find_reusable(requests: DataFrame, history: DataFrame, transcripts: DataFrame, configs: DataFrame, revision: int, audio: DataFrame | None = None) -> DataFrame:
    """(request_id, path, audio): newest result of each kind of the same source, else its transcript file with the least path.

    Requests (request_id, source_url); history (source_url, kind, path, at); transcripts (path, source_url); configs (source_url,
    pipeline_revision): a source whose saved revision is another one has no reusable result. Newest by ``at``, then path.
    ``audio`` (path): audio files there are; the one beside the chosen result, of its name but for the end, comes before the history's.
    """
    key = source_key(F.col("source_url"))
    r = requests.select("request_id", key.alias("k"))
    h = history.where("path is not null").groupBy(key.alias("k")).agg(*[F.max_by(F.when(F.col("kind") == x, F.col("path")), F.when(F.col("kind") == x, F.struct("at", "path"))).alias(f"_{x}") for x in ("raw", "audio")])
    t = transcripts.where(~_derived(F.col("path"))).groupBy(key.alias("k")).agg(F.min("path").alias("_file"))
    old = configs.where(~F.col("pipeline_revision").eqNullSafe(F.lit(revision))).select(key.alias("k")).distinct()
    found = r.join(h, "k", "left").join(t, "k", "left").join(old.withColumn("_old", F.lit(True)), "k", "left")
    path = F.when(F.col("_old").isNull(), F.coalesce("_raw", "_file"))
    found = found.select("request_id", path.alias("path"), "_audio").withColumn("_own", F.lit(None).cast("string"))
    if audio is not None:
        beside = audio.select("path").distinct().select(F.regexp_replace("path", r"\.[^./]+$", "").alias("_stem"), F.col("path").alias("_own"))
        beside = beside.where(F.lower(F.substring_index("_own", ".", -1)) == "m4a").groupBy("_stem").agg(F.min("_own").alias("_own"))
        found = found.drop("_own").withColumn("_stem", F.regexp_replace("path", r"\.[^./]+$", "")).join(beside, "_stem", "left")
    return found.select("request_id", "path", F.when(F.col("path").isNotNull(), F.coalesce("_own", "_audio")).alias("audio"))


def _derived(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.contains(name, F.lit(DERIVED[0])) | F.contains(name, F.lit(DERIVED[1]))


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of the files of a folder, their content unread."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("modificationTime").alias("modified"), "length")


def discover_transcripts(files: DataFrame, most: int = 100, metadata: DataFrame | None = None, sentences: DataFrame | None = None) -> DataFrame:
    """(path, stem, modified, audio, organized, title, source_url, sentences): the newest ``most`` transcripts, derived ones left out, with what belongs to each.

    Audio and organised text lie beside it. ``metadata`` (path, title, source_url) is read from its first lines; a blank title is the name without its end.
    ``sentences`` (source_name, path) are sentence files by the name of their transcript, the least path first. Ties of ``modified`` go by path.
    """
    f = files.withColumns({"stem": F.regexp_replace("path", r"\.[^./]+$", ""), "ext": F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))})
    new = f.where("ext = 'md'").where(~_derived(F.col("path"))).orderBy(F.desc("modified"), "path").limit(most)
    # At most ``most`` rows ask: what lies beside them is found by semi-join before anything is grouped.
    asked = new.select("stem")
    beside = lambda ext, name: f.where(F.col("ext") == ext).join(asked, "stem", "left_semi").groupBy("stem").agg(F.min("path").alias(name))
    organized = f.where("ext = 'md'").where(F.endswith("stem", F.lit(ORGANIZED))).withColumn("stem", F.expr(f"substring(stem, 1, length(stem) - {len(ORGANIZED)})"))
    organized = organized.join(asked, "stem", "left_semi").groupBy("stem").agg(F.min("path").alias("organized"))
    found = new.join(beside("m4a", "audio"), "stem", "left").join(organized, "stem", "left")
    if metadata is None:
        found = found.withColumns({"title": F.lit(""), "source_url": F.lit("")})
    else:
        found = found.join(metadata.select("path", "title", "source_url"), "path", "left")
    name = F.substring_index("path", "/", -1)
    title = F.when(F.coalesce("title", F.lit("")) == "", F.substring_index("stem", "/", -1)).otherwise(F.col("title"))
    found = found.withColumns({"title": title, "source_url": F.coalesce("source_url", F.lit("")), "_name": name})
    if sentences is None:
        found = found.withColumn("sentences", F.lit(None).cast("string"))
    else:
        found = found.join(sentences.groupBy(F.col("source_name").alias("_name")).agg(F.min("path").alias("sentences")), "_name", "left")
    return found.select("path", "stem", "modified", "audio", "organized", "title", "source_url", "sentences")


def read_transcript_metadata(files: DataFrame, lines: int = 20) -> DataFrame:
    """(video_id, title, source_url) from the first lines ``title: "..."`` and ``source_url: "..."`` of ``body``; what is no JSON string is empty."""
    head = F.slice(F.split(F.coalesce("body", F.lit("")), r"\r\n|[\r\n]"), 1, lines)

    def value(name: str) -> Column:
        own = F.try_element_at(F.filter(head, lambda x: x.startswith(f"{name}:")), F.lit(-1)) if name == "title" else F.get(F.filter(head, lambda x: x.startswith(f"{name}:")), F.lit(0))
        raw = F.trim(F.substring(own, len(name) + 2, 1 << 30))
        text = F.when(raw.rlike(r'^".*"$'), F.get_json_object(F.concat(F.lit('{"x":'), raw, F.lit("}")), "$.x"))
        return F.trim(F.coalesce(text, F.lit(""))).alias(name)

    return files.select("video_id", value("title"), value("source_url"))


def write_stage(rows: DataFrame, path: str, schema: StructType, buckets: int = 64) -> None:
    """Replaces the rows of the videos in ``rows`` within a stage table; other videos stay, and untouched buckets are not read.

    Readers see the table before or after the write (``sources.snapshots``); a write that fails changes nothing. A table keeps one number of buckets.
    """
    new = kept(rows.select(*schema.names).withColumn("bucket", snapshots.bucket_of("video_id", buckets)), "stage")
    own = snapshots.touched(new)
    old = load_stage(rows.sparkSession, path, schema, own).join(new.select("video_id").distinct(), "video_id", "left_anti")
    snapshots.commit(new.unionByName(old.withColumn("bucket", snapshots.bucket_of("video_id", buckets))), path, own)


def load_stage(spark: SparkSession, path: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    """A stage table as the last ``write_stage`` left it, or some of its buckets; empty if there was none."""
    return snapshots.load(spark, path, schema, buckets)


def read_stage(raw: DataFrame, corrected: DataFrame, unreadable: DataFrame | None = None) -> DataFrame:
    """Segments of each video: the corrected ones if it has any, else the raw ones; columns of ``raw``. Videos that are ``unreadable`` have none."""
    c = corrected.select(*raw.columns)
    if unreadable is not None:
        bad = unreadable.select("video_id").distinct()
        raw, c = raw.join(bad, "video_id", "left_anti").select(*raw.columns), c.join(bad, "video_id", "left_anti").select(*raw.columns)
    return c.unionByName(raw.join(c.select("video_id").distinct(), "video_id", "left_anti").select(*raw.columns))


def parse_stage(lines: DataFrame, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of JSON lines (video_id, stage, value), one segment each: rows with ``schema``'s fields besides, and what can't be read.

    A line is rejected if it is null, no JSON object, or has a field of another type or a null one; rejects keep the line as ``value``.
    """
    # The parser needs a nullable field to put the broken line in.
    shape = StructType([*[StructField(f.name, f.dataType) for f in schema.fields], StructField("_corrupt_record", StringType())])
    read = lines.withColumn("_x", F.from_json("value", shape, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = F.col("_x").isNotNull() & F.col("_x._corrupt_record").isNull()
    for f in schema.fields:
        good = good & F.col(f"_x.{f.name}").isNotNull()
    good = F.coalesce(good, F.lit(False))
    return read.where(good).select("video_id", "stage", *[F.col(f"_x.{f.name}") for f in schema.fields]), read.where(~good).select("video_id", "stage", "value")


def read_stage_lines(lines: DataFrame, schema: StructType, fall_back: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segments, rejects) of the JSON lines (video_id, stage, value) of stage files, ``stage`` being raw or corrected.

    A file with a rejected line is unreadable as a whole. A video with a corrected file has that one's segments, none if it is unreadable
    (with ``fall_back``: then the raw file's); one without has the raw file's. An unreadable file is a file: it is no reason to take another one.
    """
    rows, rejects = parse_stage(lines, schema)
    bad = lambda stage: rejects.where(F.col("stage") == stage).select("video_id").distinct()
    fields = ["video_id", *schema.names]
    raw = rows.where("stage = 'raw'").join(bad("raw"), "video_id", "left_anti").select(*fields)
    corrected = rows.where("stage = 'corrected'").join(bad("corrected"), "video_id", "left_anti").select(*fields)
    return read_stage(raw, corrected, None if fall_back else bad("corrected")), rejects


def incremental_chunks(rows: DataFrame, saved: DataFrame, size: int = 100, context: int = 10, config: str = "") -> DataFrame:
    """(video_id, chunk) whose ids, texts and references, with context and configuration, have no equal fingerprint among ``saved``."""
    return chunk_fingerprints(rows, size, context, config).join(saved, ["video_id", "chunk", "print"], "left_anti").select("video_id", "chunk")


def chunk_fingerprints(rows: DataFrame, size: int = 100, context: int = 10, config: str = "") -> DataFrame:
    """(video_id, chunk, print) over rows (video_id, n, text) that may have ``references``, an array of texts; null and empty texts are alike."""
    own = [F.coalesce("text", F.lit("")).alias("t")]
    if "references" in rows.columns:
        own.append(F.coalesce("references", F.array().cast("array<string>")).alias("r"))
    both = chunk_with_context(rows, size, context).join(rows.select("video_id", "n", F.to_json(F.struct("n", *own)).alias("unit")), ["video_id", "n"])
    listed = F.transform(F.array_sort(F.collect_list(F.struct("n", "role", "unit"))), lambda x: F.concat_ws("\x1e", x["role"], x["unit"]))
    return both.groupBy("video_id", "chunk").agg(fingerprint(F.lit(config), F.array_join(listed, "\x1f")).alias("print"))


# ---- roll-ups of segments --------------------------------------------------------------------------------------------

_RANKED = StructType([StructField("text", StringType()), StructField("alternatives", ArrayType(StringType()))])


@F.pandas_udf(_RANKED)
def _ranked(texts: pd.Series) -> pd.DataFrame:
    out = []
    for own in texts:
        votes = Votes()
        for x in own:
            votes.count(x["text"], x["n"], x["score"])
        ranked = votes.ranked()
        out.append((ranked[0], ranked[1 : 1 + ALTERNATIVES]))
    return pd.DataFrame(out, columns=["text", "alternatives"])


def representative_text(obs: DataFrame, *keys: str) -> DataFrame:
    """(keys, text, alternatives, confidence): the normalised text most observations are like. Rows of a text are counted before Python sees it."""
    texts = obs.withColumn("text", normalize_text(F.col("text"))).where("text <> ''").groupBy(*keys, "text").agg(F.min(F.struct("ts_ms", "frame_index")).alias("first"), F.count("*").alias("n"), F.sum(F.greatest("confidence", F.lit(0.01))).alias("score"), F.sum("confidence").alias("total"))
    g = texts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("first", "text", "n", "score"))).alias("texts"), (F.sum("total") / F.sum("n")).alias("confidence"))
    return g.withColumn("r", _ranked("texts")).select(*keys, "r.text", "r.alternatives", "confidence")


def weighted_confidence(segments: DataFrame, *keys: str) -> DataFrame:
    return segments.groupBy(*keys).agg((F.sum(F.col("confidence") * F.col("observation_count")) / F.sum("observation_count")).alias("confidence"), F.sum("observation_count").alias("observation_count"))


def ordered_distinct(rows: DataFrame, key: str, value: str, order: str, most: int = 3) -> DataFrame:
    """(key, values): the first ``most`` distinct values of each key in the order they come; earlier rows are cut before any list is made."""
    one = rows.groupBy(key, value).agg(F.min(order).alias("_first"))
    top = one.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy("_first"))).where(F.col("_rn") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", value))), lambda x: x[value]).alias("values"))


def subtitle_source_label(segments: DataFrame) -> DataFrame:
    """(video_id, label) by the sources of a video's segments: captions first, then corrected text, then recognised text."""
    any_ = lambda x: F.coalesce(F.bool_or(F.col("source") == x), F.lit(False))
    label = F.when(any_("youtube_primary"), "youtube_primary+burned_ocr_visual_verification").when(any_("burned_ocr_corrected"), "burned_ocr+youtube_reading_reference").otherwise("burned_ocr")
    return segments.groupBy("video_id").agg(label.alias("label"))


def _alike(x: str | None, y: str | None, threshold: float, least: int = 4, share: float = 0.30) -> bool | None:
    texts = [normalized(t) for t in (x, y) if t is not None]
    keys = sorted((t.replace("\n", "").replace(" ", "") for t in texts), key=len)
    if len(texts) < 2:
        return False if keys and len(keys[0]) < least else None
    small, large = keys
    return len(small) >= max(least, len(large) * share) and small in large or ratio_reaches(*texts, threshold)


def similar_text(a: Column, b: Column, threshold: float = 82.0) -> Column:
    """Normalised texts contain each other or have an indel ratio of ``threshold``.

    Both are normalised and compared in one call, so that no text is normalised again wherever its key is named. Null if one is null
    and the other one's key is not too short to hold anything, or if both are.
    """

    @F.pandas_udf(BooleanType())
    def alike(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([_alike(p, q, threshold) for p, q in zip(x, y)], dtype="object")

    return alike(a, b)


def reference_conflict(pairs: DataFrame, *keys: str, least: int = 6, share: float = 0.74) -> DataFrame:
    """(keys, conflict): some reference of ``pairs`` (keys, text, reference) is close to the text, and neither holds the other.

    Texts under ``least`` characters (white space and marks apart) never conflict. Only pairs that pass the native tests are compared.
    """
    # Equal texts hold each other. Keys come from a generator, or the filters that are pushed through a projection would make them anew for each test.
    bare = lambda c, name: F.regexp_replace(c, "(?U)" + IGNORED, "").alias(name)
    k = pairs.where("text <> reference").select(*keys, F.inline(F.array(F.struct(bare("text", "a"), bare("reference", "b")))))
    near = (F.length("a") >= least) & (F.col("b") != "") & ~F.contains("a", "b") & ~F.contains("b", "a")
    # The ratio is twice the matches over both lengths: lengths too far apart cannot reach it.
    near = near & (2 * F.least(F.length("a"), F.length("b")) >= share * (F.length("a") + F.length("b")))
    hit = k.where(near).where(default_matcher_ratio("a", "b") >= share).select(*keys).distinct().withColumn("conflict", F.lit(True))
    return pairs.select(*keys).distinct().join(hit, list(keys), "left").select(*keys, F.coalesce("conflict", F.lit(False)).alias("conflict"))


def validate_corrections(corrections: DataFrame, targets: DataFrame) -> DataFrame:
    """(video_id, n, corrected_text, status): the last correction of each target, and conflicts without one as ``missing``.

    Corrections (video_id, n, ord, corrected_text) of rows that are no target are dropped; ties of ``ord`` go to the greater text.
    """
    c = corrections.groupBy("video_id", "n").agg(F.max_by("corrected_text", F.struct("ord", "corrected_text")).alias("corrected_text"), F.lit(True).alias("_has"))
    both = targets.select("video_id", "n", "conflict").join(c, ["video_id", "n"], "left")
    return both.where("_has or conflict").select("video_id", "n", "corrected_text", F.when(F.col("_has"), "kept").otherwise("missing").alias("status"))


def review_ids(decisions: DataFrame, targets: DataFrame) -> DataFrame:
    """(video_id, window_index, id): rows to be seen again: those that flagged decisions (kind, ids, recheck) name; all the
    window's target ids if a spoken decision is flagged and none names any."""
    flagged = decisions.where("recheck")
    named = flagged.select("video_id", "window_index", F.explode("ids").alias("id")).distinct()
    bare = flagged.where("kind = 'spoken'").select("video_id", "window_index").distinct().join(named, ["video_id", "window_index"], "left_anti")
    return named.unionByName(targets.join(bare, ["video_id", "window_index"], "left_semi").select("video_id", "window_index", "id").distinct())
