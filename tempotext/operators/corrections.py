"""Corrections: kept where safe, rejected and counted where not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.similarity import safe_correction
from ..functions.text import has_kanji


def apply_corrections(segments: DataFrame, corrections: DataFrame) -> DataFrame:
    """Segments with ``original_text``, ``final_text`` and ``outcome`` (changed, rejected, kept); blank or missing corrections keep the text.

    ``reason`` and ``references`` of a correction, if it has them, stay with the rows that it changed; else they are null.
    """
    both = segments.join(corrections, ["video_id", "n"], "left")
    blank = F.coalesce(F.trim("corrected_text") == "", F.lit(True))
    safe = safe_correction(F.col("text"), F.col("corrected_text"))
    outcome = F.when(blank | (F.col("corrected_text") == F.col("text")), "kept").when(safe, "changed").otherwise("rejected")
    more = [F.when(F.col("outcome") == "changed", F.col(c)).alias(c) for c in ("reason", "references") if c in corrections.columns]
    final = F.when(F.col("outcome") == "changed", F.col("corrected_text")).otherwise(F.col("text"))
    return both.withColumn("outcome", outcome).select("video_id", "n", "outcome", F.col("text").alias("original_text"), final.alias("final_text"), *more)


COUNTS = ("observations", "segments", "spoken", "annotations", "unresolved", "changed", "rejected", "sentences", "reused_chunks")


def run_summary(applied: DataFrame, observations: DataFrame, document: DataFrame, sentences: DataFrame, reused: DataFrame) -> DataFrame:
    """Nine counts a video, zero where it has no such rows, in one shuffle: every row is one of a few counts before it travels.

    ``document`` has source and needs_review; ``reused`` a row for each chunk taken from an earlier run. Null ids are left out.
    """

    def counts(rows: DataFrame, **made) -> DataFrame:
        return rows.where("video_id is not null").groupBy("video_id").agg(*[(F.count_if(made[c]) if c in made else F.lit(0)).cast("long").alias(c) for c in COUNTS])

    every, is_ = F.lit(True), lambda c, x: F.coalesce(F.col(c) == x, F.lit(False))
    note = is_("source", "screen_annotation")
    parts = counts(applied, segments=every, changed=is_("outcome", "changed"), rejected=is_("outcome", "rejected"))
    parts = parts.unionByName(counts(document, spoken=~note, annotations=note, unresolved=F.coalesce("needs_review", F.lit(False))))
    for rows, name in ((observations, "observations"), (sentences, "sentences"), (reused, "reused_chunks")):
        parts = parts.unionByName(counts(rows, **{name: every}))
    return parts.groupBy("video_id").agg(*[F.sum(c).alias(c) for c in COUNTS])


KINDS = ("word", "collocation", "grammar")


def check_rows(rows: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """(video_id, n, reasons): rows that break a constraint of the columns they have; a null breaks it, apart from readings, which it lacks.

    Times are not negative and in order, confidence is from 0 to 1, text is not empty, kind is known, words with kanji have a
    reading, a region (x, y, width, height as shares) lies within the frame.
    """
    has = lambda *names: set(names) <= set(rows.columns)
    rules = []

    def rule(good: Column, name: str) -> None:
        rules.append(F.when(~F.coalesce(good, F.lit(False)), F.lit(name)))

    if has("start_ms", "end_ms"):
        rule((F.col("start_ms") >= 0) & (F.col("end_ms") >= 0), "negative time")
        rule(F.col("end_ms") >= F.col("start_ms"), "end before start")
    if has("confidence"):
        rule(F.col("confidence").between(0, 1), "confidence")
    if has("text"):
        rule(F.trim("text") != "", "empty text")
    if has("kind"):
        rule(F.col("kind").isin(*kinds), "kind")
    if has("expression", "lemma", "reading"):
        written = F.concat(*[F.coalesce(c, F.lit("")) for c in ("expression", "lemma")])
        rule(~has_kanji(written) | (F.trim(F.coalesce("reading", F.lit(""))) != ""), "reading")
    if has("x", "y", "width", "height"):
        inside = lambda a, b: (F.col(a) >= 0) & (F.col(b) > 0) & (F.col(a) + F.col(b) <= 1.000001)
        rule(inside("x", "width") & inside("y", "height"), "region")
    bad = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return rows.select("video_id", "n", F.array_join(bad, "; ").alias("reasons")).where("reasons <> ''")
