"""The study library: first save wins, by unique keys; counts, rankings, deletes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import fenced_json, has_kanji, headword, meaning_key, source_key, term_key, video_key
from ..sources import snapshots
from ..sources.shared import kept


def keyed(saves: DataFrame) -> DataFrame:
    """Saves with the keys of entry, form and meaning."""
    entry = F.concat_ws("␟", "kind", term_key(F.col("lemma")), term_key(F.col("reading")))
    return saves.withColumns({"entry_key": entry, "form_key": term_key(F.col("surface")), "meaning_key": meaning_key(F.col("meaning"))})


#: Kinds of items. Fields that must not be blank.
KINDS = ("word", "collocation", "grammar")
NEEDED = ("lemma", "surface", "meaning", "context_key")


def _stripped(c: str) -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^\s+|\s+$", "")


def rejected_saves(saves: DataFrame) -> DataFrame:
    """(save_id, reason) of saves that the library doesn't take: of an unknown kind, or without lemma, surface, meaning or context key."""
    reason = F.when(~F.coalesce(F.col("kind").isin(*KINDS), F.lit(False)), "kind")
    for c in NEEDED:
        reason = reason.when(_stripped(c) == "", c)
    return saves.select("save_id", reason.alias("reason")).where("reason is not null")


def accepted(saves: DataFrame) -> DataFrame:
    """Keyed saves that the library takes, with white space around their fields gone; context keys stay as they are."""
    ok = F.col("kind").isin(*KINDS)
    for c in NEEDED:
        ok = ok & (_stripped(c) != "")
    return keyed(saves.where(ok).withColumns({c: _stripped(c) for c in ("lemma", "surface", "reading", "meaning")}))


def upsert_library(saves: DataFrame) -> DataFrame:
    """(save_id, added_entry, added_form, added_meaning, added_encounter): what each save added, in save order; rejected ones are left out."""
    first = lambda *k: F.row_number().over(W.partitionBy(*k).orderBy("save_id")) == 1
    return accepted(saves).select("save_id", first("entry_key").alias("added_entry"), first("entry_key", "form_key").alias("added_form"), first("entry_key", "meaning_key").alias("added_meaning"), first("entry_key", "context_key").alias("added_encounter"))


def library_entries(saves: DataFrame) -> DataFrame:
    """Entries with distinct encounters, forms, the meanings in the order of their first save, display and reading.

    The display is the first save's lemma; if that has no kanji, the first form with some, whichever save brought it.
    ``updated`` is the last save that added a form, a meaning or an encounter.
    """
    k = accepted(saves)
    written = has_kanji(F.col("surface"))
    meanings = k.groupBy("entry_key", "meaning_key").agg(F.min("save_id").alias("first"), F.min_by("meaning", "save_id").alias("meaning"))
    meanings = meanings.groupBy("entry_key").agg(F.max("first").alias("_m"), F.transform(F.array_sort(F.collect_list(F.struct("first", "meaning"))), lambda x: x["meaning"]).alias("meanings"))
    first = lambda key, name, last: k.groupBy("entry_key", key).agg(F.min("save_id").alias("s")).groupBy("entry_key").agg(F.count("*").alias(name), F.max("s").alias(last))
    main = first("context_key", "encounters", "_e").join(first("form_key", "forms", "_f"), "entry_key")
    lemma, form = F.min_by("lemma", "save_id"), F.min_by(F.when(written, F.col("surface")), F.when(written, F.col("save_id")))
    shown = k.groupBy("entry_key").agg(F.when(has_kanji(lemma), lemma).otherwise(F.coalesce(form, lemma)).alias("display"), F.min_by("reading", "save_id").alias("reading"))
    return main.join(meanings, "entry_key").join(shown, "entry_key").select("entry_key", "encounters", "forms", F.greatest("_e", "_f", "_m").alias("updated"), "meanings", "display", "reading")


def library_totals(saves: DataFrame) -> DataFrame:
    e = accepted(saves).select("entry_key", "context_key").distinct().groupBy("entry_key").agg(F.count("*").alias("n"))
    return e.agg(F.count("*").alias("entries"), F.sum("n").alias("encounters"))


def top_library_entries(saves: DataFrame, most: int = 240) -> DataFrame:
    return library_entries(saves).select("entry_key", "encounters", "updated").orderBy(F.desc("encounters"), F.desc("updated"), "entry_key").limit(most)


def entry_encounters(saves: DataFrame) -> DataFrame:
    """Encounters of every entry with the meaning of their first save, ranked from the newest."""
    k = accepted(saves).groupBy("entry_key", "context_key").agg(F.min("save_id").alias("save_id"), F.min_by("meaning", "save_id").alias("meaning"))
    return k.withColumn("rank", F.row_number().over(W.partitionBy("entry_key").orderBy(F.desc("save_id"))))


def export_glossary(saves: DataFrame) -> DataFrame:
    """(entry_key, updated, line): a line for each entry, its head word and meanings in order; those changed last come first."""
    line = F.concat(headword(F.col("display"), F.col("reading")), F.lit("："), F.array_join("meanings", "；"))
    return library_entries(saves).select("entry_key", "updated", line.alias("line")).orderBy(F.desc("updated"), "entry_key")


def delete_entry_cascade(saves: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of all entries but the given ones."""
    return keyed(saves).join(entries.select("entry_key").distinct(), "entry_key", "left_anti")


def purge_source(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """Rows whose source (video id, or trimmed url) is none of ``gone``'s, whatever form its url has."""
    g = gone.select(source_key(F.col("source_url")).alias("k")).distinct()
    return rows.withColumn("k", source_key(F.col("source_url"))).join(g, "k", "left_anti")


def orphan_assets(assets: DataFrame, gone: DataFrame) -> DataFrame:
    """Paths of deleted jobs that no remaining job refers to."""
    keep = assets.join(gone, "job_id", "left_anti").select("path").distinct()
    return assets.join(gone, "job_id", "left_semi").select("path").distinct().join(keep, "path", "left_anti")


def orphan_videos(jobs: DataFrame, gone: DataFrame) -> DataFrame:
    """Video keys of deleted jobs (job_id, source_url) that no remaining job has: their own files may go. Other urls have none."""
    k = jobs.select("job_id", video_key(F.col("source_url")).alias("video_key")).where("video_key is not null")
    keep = k.join(gone, "job_id", "left_anti").select("video_key").distinct()
    return k.join(gone, "job_id", "left_semi").select("video_key").distinct().join(keep, "video_key", "left_anti")


def usage_rollup(calls: DataFrame) -> DataFrame:
    """(stage, key, total, first_value) of calls (stage, ord, repair, usage: map of strings), with the keys ``calls`` and ``repairs``.

    A key whose values are all numbers has their sum, another the first value in the order of calls; null values are left out.
    """
    own = F.map_from_arrays(F.array(F.lit("calls"), F.lit("repairs")), F.array(F.lit("1"), F.when(F.coalesce("repair", F.lit(False)), "1").otherwise("0")))
    pairs = calls.select("stage", "ord", F.explode(F.map_concat(F.map_filter("usage", lambda k, v: ~k.isin("calls", "repairs")), own)).alias("key", "value"))
    pairs = pairs.where("value is not null").withColumn("number", F.expr("try_cast(value as double)"))
    g = pairs.groupBy("stage", "key").agg(F.sum("number").alias("sum"), F.bool_and(F.col("number").isNotNull()).alias("all"), F.min_by("value", F.struct("ord", "value")).alias("first"))
    return g.select("stage", "key", F.when(F.col("all"), F.col("sum")).alias("total"), F.when(~F.col("all"), F.col("first")).alias("first_value"))


def library_tables(saves: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a library: entries, forms, meanings, encounters. By each unique key the first save (least save_id) wins.

    Saves have the columns of ``keyed``'s input, and may have source_url, job_id, sentence_id and sentence. ``updated`` is the
    last save that added anything. Saves that ``rejected_saves`` names are left out. An earlier library is a table of saves, so its union with new ones is the upsert.
    """
    k = accepted(saves)
    more = [c for c in ("source_url", "job_id", "sentence_id", "sentence") if c in saves.columns]

    def firsts(key: str, *columns: str) -> DataFrame:
        rows = k.groupBy("entry_key", key).agg(F.min_by(F.struct("save_id", *columns), "save_id").alias("x"))
        return rows.select("entry_key", key, "x.*")

    forms, meanings = firsts("form_key", "surface", "reading"), firsts("meaning_key", "meaning", *more[-1:])
    encounters = firsts("context_key", "meaning_key", *more)
    added = forms.select("entry_key", "save_id").unionByName(meanings.select("entry_key", "save_id")).unionByName(encounters.select("entry_key", "save_id"))
    updated = added.groupBy("entry_key").agg(F.max("save_id").alias("updated"))
    first = k.groupBy("entry_key").agg(F.min_by(F.struct("kind", "lemma", "reading"), "save_id").alias("x"), F.min("save_id").alias("created")).select("entry_key", "x.*", "created")
    shown = library_entries(saves).select("entry_key", "display")
    return {"entries": first.join(shown, "entry_key").join(updated, "entry_key"), "forms": forms, "meanings": meanings, "encounters": encounters}


#: A row of a stored library: the first save of one of the four unique keys, with what it says.
_VALUE = ["kind", "lemma", "surface", "reading", "meaning", "meaning_key", "source_url", "job_id", "sentence_id", "sentence"]
STORED = StructType([*[StructField(c, StringType()) for c in ("part", "entry_key", "key")], StructField("save_id", LongType()), StructField("value", StructType([StructField(c, StringType()) for c in _VALUE]))])


def stored_rows(saves: DataFrame) -> DataFrame:
    """The first save of each key among the accepted ``saves``, as a stored library holds it; columns that saves lack are null."""
    k = accepted(saves)
    value = F.struct(*[(F.col(c) if c in k.columns else F.lit(None)).cast("string").alias(c) for c in _VALUE])
    keys = {"entry": F.lit(""), "form": F.col("form_key"), "meaning": F.col("meaning_key"), "encounter": F.col("context_key")}
    parts = F.array(*[F.struct(F.lit(name).alias("part"), key.alias("key")) for name, key in keys.items()])
    return _firsts(k.select("entry_key", F.col("save_id").cast("long"), value.alias("value"), F.explode(parts).alias("x")).select("x.part", "entry_key", "x.key", "save_id", "value"))


def _firsts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("part", "entry_key", "key").agg(F.min("save_id").alias("save_id"), F.min_by("value", "save_id").alias("value"))


def merge_library(saves: DataFrame, path: str, buckets: int = 64) -> None:
    """Upserts a batch of saves into the library stored at ``path``: the first save of each key stays, whatever batch brings it.

    Entries are spread over buckets by key; a batch reads and rewrites those it touches only, as one new state (``sources.snapshots``). A batch
    that comes twice, or after later ones, changes nothing that the order of save ids does not. A library keeps one number of buckets.
    """
    bucket = snapshots.bucket_of("entry_key", buckets)
    new = kept(stored_rows(saves).withColumn("bucket", bucket), "saves")
    own = snapshots.touched(new)
    if own:
        both = load_library(saves.sparkSession, path, own).unionByName(new.drop("bucket"))
        snapshots.commit(_firsts(both).withColumn("bucket", bucket), path, own)


def load_library(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The stored rows (part, entry_key, key, save_id, value) of a library, or of some of its buckets; empty if there is none."""
    return snapshots.load(spark, path, STORED, buckets)


def stored_tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The four tables of a stored library, as ``library_tables`` makes them from all saves."""
    part = lambda name, key, *columns: rows.where(F.col("part") == name).select("entry_key", F.col("key").alias(key), "save_id", *[f"value.{c}" for c in columns])
    first, form = rows.where("part = 'entry'").select("entry_key", "value.kind", "value.lemma", "value.reading", F.col("save_id").alias("created")), F.col("part") == "form"
    written = form & has_kanji(F.col("value.surface"))
    more = rows.where("part <> 'entry'").groupBy("entry_key").agg(F.min_by(F.when(written, F.col("value.surface")), F.when(written, F.col("save_id"))).alias("_form"), F.max("save_id").alias("updated"))
    shown = F.when(has_kanji(F.col("lemma")), F.col("lemma")).otherwise(F.coalesce("_form", "lemma"))
    entries = first.join(more, "entry_key").withColumn("display", shown).select("entry_key", "kind", "lemma", "reading", "created", "display", "updated")
    told = ("source_url", "job_id", "sentence_id", "sentence")
    return {"entries": entries, "forms": part("form", "form_key", "surface", "reading"), "meanings": part("meaning", "meaning_key", "meaning", "sentence"), "encounters": part("encounter", "context_key", "meaning_key", *told)}


def recent_history(jobs: DataFrame, most: int = 100) -> DataFrame:
    return jobs.groupBy("job_id").agg(F.max("conv_id").alias("conv_id"), F.count("*").alias("results")).orderBy(F.desc("conv_id"), "job_id").limit(most)


def library_state(items: DataFrame, saves: DataFrame) -> DataFrame:
    """(item_id, entry_exists, meaning_saved, context_saved, meaning_count, encounter_count) of items against the saved library; absent: zeros."""
    k, i = accepted(saves), keyed(items)
    entry = k.groupBy("entry_key").agg(F.countDistinct("meaning_key").alias("_m"), F.countDistinct("context_key").alias("_e"))
    has = lambda c: k.select("entry_key", c).distinct().withColumn(f"_has_{c}", F.lit(True))
    x = i.join(entry, "entry_key", "left").join(has("meaning_key"), ["entry_key", "meaning_key"], "left").join(has("context_key"), ["entry_key", "context_key"], "left")
    flag = lambda c: F.coalesce(c, F.lit(False))
    return x.select("item_id", F.col("_m").isNotNull().alias("entry_exists"), flag(F.col("_has_meaning_key")).alias("meaning_saved"), flag(F.col("_has_context_key")).alias("context_saved"), F.coalesce("_m", F.lit(0)).alias("meaning_count"), F.coalesce("_e", F.lit(0)).alias("encounter_count"))


#: UTF-8 bytes of forms that one automaton holds, about; more are spread over several.
FORM_BYTES = 8 << 20


def library_context(sentences: DataFrame, saves: DataFrame, most: int = 240, keep: int = 80, form_bytes: int = FORM_BYTES) -> DataFrame:
    """(video_id, n, matches, entries): the ``keep`` entries to know for each sentence, of the ``most`` met most often.

    Entries with a form or lemma in the sentence come first, then those met most often and last; a null text holds none. The forms of
    the ``most`` entries are measured first: each ``form_bytes`` of them make one automaton, sent to the executors, that reads a
    sentence once however many forms it has. Sentences are neither shuffled nor multiplied.
    """
    top = [r["entry_key"] for r in top_library_entries(saves, most).orderBy(F.desc("encounters"), F.desc("updated"), "entry_key").select("entry_key").collect()]  # ``most`` keys
    spark = sentences.sparkSession
    places = spark.createDataFrame(list(enumerate(top)), "place int, entry_key string")
    k = accepted(saves).join(F.broadcast(places), "entry_key")
    forms = k.select("place", F.explode(F.array("form_key", term_key(F.col("lemma")))).alias("form")).where("form <> ''").groupBy("form").agg(F.array_sort(F.collect_set("place")).alias("places"))
    forms = kept(forms, "forms")
    size = forms.agg(F.sum(F.octet_length("form"))).first()[0] or 0
    parts = -(-size // form_bytes)
    found = F.array().cast("array<int>")
    for part in range(parts):
        own = forms.where(F.pmod(F.xxhash64("form"), F.lit(parts)) == part).collect()  # about ``form_bytes``
        found = F.array_union(found, _holds(spark, {r["form"]: tuple(r["places"]) for r in own})(F.col("t")))
    s = sentences.select("video_id", "n", F.coalesce(term_key(F.col("text")), F.lit("")).alias("t")).withColumn("hits", F.array_sort(found))
    every = F.array(*[F.lit(i) for i in range(len(top))]).cast("array<int>")
    r = F.slice(F.concat("hits", F.array_except(every, "hits")), 1, keep)
    keys = F.array(*[F.lit(x) for x in top]).cast("array<string>")
    return s.select("video_id", "n", F.least(F.size("hits"), F.lit(keep)).cast("long").alias("matches"), F.transform(r, lambda i: F.get(keys, i)).alias("entries"))


def _holds(spark: SparkSession, forms: dict[str, tuple[int, ...]]):
    """A column function: the places whose forms a text holds, each once."""
    import ahocorasick

    sent = spark.sparkContext.broadcast(forms)
    made: list = []

    @F.pandas_udf(ArrayType(IntegerType()))
    def hits(texts: pd.Series) -> pd.Series:
        if not made:  # once a task
            automaton = ahocorasick.Automaton()
            for form, places in sent.value.items():
                automaton.add_word(form, places)
            automaton.make_automaton()
            made.append(automaton)
        return pd.Series([sorted({p for _, places in made[0].iter(t) for p in places}) if made[0] else [] for t in texts], index=texts.index)

    return hits


def encounter_titles(encounters: DataFrame, history: DataFrame) -> DataFrame:
    """Encounters (job_id, source_url) with ``title``: their job's title, or the source url where it has none or a blank one."""
    h = history.groupBy("job_id").agg(F.max("title").alias("_title"))
    return encounters.join(h, "job_id", "left").withColumn("title", F.coalesce(F.nullif(F.trim("_title"), F.lit("")), "source_url")).drop("_title")


def repair_display(entries: DataFrame, saves: DataFrame) -> DataFrame:
    """(entry_key, display): displays without kanji become the entry's first form with kanji, else its lemma; others stay."""
    k = keyed(saves).where(has_kanji(F.col("surface")))
    first = k.groupBy("entry_key").agg(F.min_by("surface", "save_id").alias("_form"))
    e = entries.join(first, "entry_key", "left")
    return e.select("entry_key", F.when(has_kanji(F.col("display")), F.col("display")).otherwise(F.coalesce("_form", "lemma")).alias("display"))


def flatten_analysis(replies: DataFrame) -> DataFrame:
    """(sentence_id, kind, surface, lemma, reading, meaning): words and grammar of analysis replies; a reply without JSON gives no row."""
    word, rule = "kind: string, expression: string, lemma: string, reading: string, meaning: string", "pattern: string, lemma: string, explanation: string"
    a = replies.select("sentence_id", F.from_json(fenced_json(F.col("reply")), f"vocabulary array<struct<{word}>>, grammar array<struct<{rule}>>").alias("a"))
    v = a.select("sentence_id", F.explode("a.vocabulary").alias("x")).select("sentence_id", "x.kind", F.col("x.expression").alias("surface"), "x.lemma", "x.reading", "x.meaning")
    g = a.select("sentence_id", F.explode("a.grammar").alias("x")).select("sentence_id", F.lit("grammar").alias("kind"), F.col("x.pattern").alias("surface"), "x.lemma", F.lit("").alias("reading"), F.col("x.explanation").alias("meaning"))
    return v.unionByName(g)


def missing_reading(items: DataFrame) -> DataFrame:
    """(sentence_id, missing): positions, from 0, of the items (sentence_id, pos, surface, lemma, reading) with kanji and no reading."""
    blank = has_kanji(F.concat(F.coalesce("surface", F.lit("")), F.coalesce("lemma", F.lit("")))) & (F.trim(F.coalesce("reading", F.lit(""))) == "")
    return items.groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.when(blank, F.col("pos")))).alias("missing"))
