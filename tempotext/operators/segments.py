"""Recognised text over time: fuzzy sessions, their representatives, and merging of neighbours."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType

from ..functions.similarity import contains, joined, ratio
from ..functions.text import normalize_text
from .folds import ROWS, in_parts
from .times import BIN_MS, running_max

SIMILAR, CLUSTER, REVIEW, ALTERNATIVES = 82.0, 72.0, 0.55, 3
_FIELDS = {"video_id": LongType(), "start_ms": LongType(), "end_ms": LongType(), "text": StringType(), "confidence": DoubleType(), "observation_count": LongType(), "alternatives": ArrayType(StringType()), "needs_review": BooleanType()}
SEGMENT = StructType([StructField(k, t) for k, t in _FIELDS.items()])


def alike(a: str, b: str, threshold: float) -> bool:
    """Equal, contained, or close by indel ratio; lengths too far apart cannot be close."""
    if a == b or contains(_compact(a), _compact(b)):
        return True
    return 200.0 * min(len(a), len(b)) >= threshold * (len(a) + len(b)) and ratio(a, b) >= threshold


def _compact(x: str) -> str:
    return x.replace("\n", "").replace(" ", "")


class Votes:
    """Counts and scores of an open segment's texts in first-seen order, and the text that leads.

    A new text is compared with each one before it once; after that a vote only raises the supports of the texts like its own.
    """

    def __init__(self) -> None:
        self.texts: dict[str, list[float]] = {}
        self.near: dict[str, list[str]] = {}
        self.place: dict[str, list[int]] = {}
        self.head = ""

    def add(self, text: str, confidence: float) -> None:
        self.count(text, 1, max(confidence, 0.01))

    def count(self, text: str, times: int, score: float) -> None:
        if text not in self.texts:
            close = [u for u in self.texts if alike(*sorted((u, text)), CLUSTER)]
            # Place, length and support of the text.
            self.place[text] = [len(self.texts), len(_compact(text)), sum(self.texts[u][0] for u in close)]
            self.texts[text], self.near[text] = [0, 0.0], [*close, text]
            for u in close:
                self.near[u].append(text)
        own = self.texts[text]
        own[0] += times
        own[1] += score
        for u in self.near[text]:
            self.place[u][2] += times
        # All others stand as they stood behind the head of before.
        self.head = min([self.head or text, *self.near[text]], key=self._rank)

    def _rank(self, t: str) -> tuple:
        (first, size, support), (n, score) = self.place[t], self.texts[t]
        return -support, -size, -n, -score, first

    def ranked(self) -> list[str]:
        """By observations of similar texts, then length, own observations and confidence; ties in first-seen order."""
        return sorted(self.texts, key=self._rank)


def segment_observations(obs: DataFrame, duration_ms: int, interval_ms: int, threshold: float = SIMILAR, part_rows: int = ROWS) -> DataFrame:
    """(video_id, start_ms, end_ms, text, confidence, observation_count, alternatives, needs_review).

    Observations in time order: a blank text ends the open segment; another joins it if it is like the current
    representative, else ends it at its own time and opens the next. The end of data ends it at ``duration_ms``.
    Texts are normalised first; null ones are blank, a null confidence is 0. A video is folded in parts of about ``part_rows`` rows
    (``in_parts``), cut at blanks if there are some, else between unlike texts.
    """
    seen = ["ts_ms", "frame_index", "text", "confidence"]
    order = W.partitionBy("video_id").orderBy(*seen)
    rows = obs.withColumn("text", F.coalesce(normalize_text(F.col("text")), F.lit(""))).withColumn("confidence", F.coalesce("confidence", F.lit(0.0)).cast("double")).withColumn("next_ms", F.coalesce(F.lead("ts_ms").over(order), F.lit(duration_ms).cast("long")))
    rows = rows.withColumn("sure", F.coalesce(F.lag("text").over(order), F.lit("")) == "").where("text <> ''")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out, votes, start, conf = [], None, 0, []

        def finish(end: int) -> None:
            ranked = votes.ranked()
            mean = sum(conf) / len(conf)
            out.append((pdf["video_id"].iat[0], start, min(duration_ms, max(start + interval_ms, end)), ranked[0], mean, len(conf), ranked[1 : 1 + ALTERNATIVES], mean < REVIEW))

        for ts, text, c, sure, before in zip(pdf["ts_ms"], pdf["text"], pdf["confidence"], pdf["sure"], pdf["next_ms"].shift(fill_value=0)):
            if votes is None or sure or not alike(votes.head, text, threshold):
                if votes is not None:
                    finish(int(before))
                votes, start, conf = Votes(), int(ts), []
            votes.add(text, c)
            conf.append(c)
        finish(int(pdf["next_ms"].iat[-1]))
        return pd.DataFrame(out, columns=SEGMENT.names)

    @F.pandas_udf("boolean")
    def joins(head: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and alike(x, y, threshold) for x, y in zip(head, text)], dtype="bool")

    return in_parts(rows.select("video_id", *seen, "next_ms", "sure"), seen, fold, joins, SEGMENT, part_rows)


def merge_adjacent_segments(segments: DataFrame, interval_ms: int, threshold: float = SIMILAR, part_rows: int = ROWS) -> DataFrame:
    """Neighbours within ``interval_ms`` become one if alike (weighted confidence, longer text) or if one's end begins the next.

    Texts are normalised first, null ones are empty. The fold runs in parts of about ``part_rows`` rows (``in_parts``), cut at gaps above the
    interval if there are some, else between unlike texts.
    """
    seen = ["start_ms", "end_ms", "text", "observation_count", "confidence"]
    order = W.partitionBy("video_id").orderBy(*seen)
    rows = segments.select(*SEGMENT.names).withColumns({"text": F.coalesce(normalize_text(F.col("text")), F.lit("")), "alternatives": F.coalesce("alternatives", F.array().cast("array<string>"))})
    rows = rows.withColumn("sure", F.coalesce(F.col("start_ms") - F.lag("end_ms").over(order) > interval_ms, F.lit(True)))

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[dict] = []
        for row, sure in zip(pdf[SEGMENT.names].to_dict("records"), pdf["sure"]):
            last = out[-1] if out and not sure else None
            both = None
            if last and (same := alike(last["text"], row["text"], threshold)) | bool(both := joined(last["text"], row["text"])):
                n = last["observation_count"] + row["observation_count"]
                seen = [*last["alternatives"], *row["alternatives"]]
                if same:
                    text = row["text"] if len(row["text"]) > len(last["text"]) else last["text"]
                else:
                    text, seen = both, [*seen, row["text"]]
                mean = (last["confidence"] * last["observation_count"] + row["confidence"] * row["observation_count"]) / n
                last |= {"end_ms": row["end_ms"], "text": text, "confidence": mean, "observation_count": n, "alternatives": list(dict.fromkeys(seen))[:ALTERNATIVES], "needs_review": mean < REVIEW}
            else:
                out.append(row)
        return pd.DataFrame(out, columns=SEGMENT.names)

    @F.pandas_udf("boolean")
    def joins(head: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([x is not None and y is not None and (alike(x, y, threshold) or bool(joined(x, y))) for x, y in zip(head, text)], dtype="bool")

    return in_parts(rows, seen, fold, joins, SEGMENT, part_rows)


def segment_stats(segments: DataFrame) -> DataFrame:
    """Per video: segments, observations, mean confidence and segments to review."""
    return segments.groupBy("video_id").agg(
        F.count("*").alias("segments"), F.sum("observation_count").alias("observations"), F.bround(F.sum(F.col("confidence") * F.col("observation_count")) / F.sum("observation_count"), 6).alias("mean_confidence"), F.sum(F.col("needs_review").cast("long")).alias("to_review"),
    )


def dedupe_observations(obs: DataFrame, selected: DataFrame, model: str | None = None) -> DataFrame:
    """The last row of each frame, of selected frames only; with ``model``, none of a video that has a selected row of another model."""
    if model is not None:
        own = obs.join(selected.select("video_id", "frame_index").distinct(), ["video_id", "frame_index"], "left_semi")
        obs = obs.join(own.where(~F.col("model").eqNullSafe(model)).select("video_id").distinct(), "video_id", "left_anti")
    last = F.row_number().over(W.partitionBy("video_id", "frame_index").orderBy(F.col("ts_ms").desc()))
    return obs.join(selected.select("video_id", "frame_index").distinct(), ["video_id", "frame_index"], "left_semi").withColumn("_last", last).where("_last = 1").drop("_last")


def segment_evidence(segments: DataFrame, obs: DataFrame) -> DataFrame:
    """First, middle and last non-blank observation within each segment, both ends included; segments of one start are taken together.

    Observations are numbered by time, and a segment's ends are looked up among them by running maxima, so no segment is joined to all that it holds.
    """
    points = obs.where(normalize_text(F.col("text")) != "").where("video_id is not null and ts_ms is not null").select("video_id", "frame_index", "ts_ms")
    points = points.withColumn("_bin", F.floor(F.col("ts_ms") / BIN_MS)).withColumn("_rn", F.row_number().over(W.partitionBy("video_id", "_bin").orderBy("ts_ms", "frame_index")))
    sizes = points.groupBy("video_id", "_bin").agg(F.count("*").alias("_n"))
    sizes = sizes.select("video_id", "_bin", F.coalesce(F.sum("_n").over(W.partitionBy("video_id").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    points = points.join(sizes, ["video_id", "_bin"]).select("video_id", "frame_index", "ts_ms", (F.col("_before") + F.col("_rn")).alias("no"))
    own = segments.where("start_ms <= end_ms")
    side = lambda df, t, kind, start, no: df.select("video_id", F.col(t).alias("t"), F.lit(kind).alias("kind"), start.alias("start_ms"), no.alias("no"))
    none = F.lit(None).cast("long")
    rows = side(points, "ts_ms", 1, none, F.col("no")).unionByName(side(own, "start_ms", 0, F.col("start_ms"), none)).unionByName(side(own, "end_ms", 2, F.col("start_ms"), none))
    found = running_max(rows, F.col("no"), F.col("t"), F.col("kind"), "upto").where("kind <> 1").withColumn("upto", F.coalesce("upto", F.lit(0)).cast("long"))
    s = found.groupBy("video_id", "start_ms").agg(F.min(F.when(F.col("kind") == 0, F.col("upto"))).alias("lo"), F.array_sort(F.collect_list(F.when(F.col("kind") == 2, F.col("upto")))).alias("his"))
    s = s.withColumn("counts", F.transform("his", lambda x: x - F.col("lo"))).withColumn("c", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y)).where("c > 0")
    s = s.select("video_id", "start_ms", "lo", "counts", F.explode(F.array_distinct(F.expr("array(0L, c div 2, c - 1)"))).alias("at"))
    # Of m segments of one start, what the shortest holds counts m times, what the next one holds besides m - 1 times, and so on.
    state = F.struct(F.col("at").alias("q"), F.lit(0).cast("long").alias("seen"), F.size("counts").cast("long").alias("m"), none.alias("hit"))

    def step(x: Column, n: Column) -> Column:
        width = (n - x["seen"]) * x["m"]
        here = x["hit"].isNull() & (x["q"] < width)
        hit = F.when(here, (x["seen"] + F.floor(x["q"] / x["m"])).cast("long")).otherwise(x["hit"])
        return F.struct((x["q"] - width).alias("q"), n.alias("seen"), (x["m"] - 1).alias("m"), hit.alias("hit"))

    s = s.select("video_id", "start_ms", (F.col("lo") + F.aggregate("counts", state, step)["hit"] + 1).alias("no"))
    return s.join(points, ["video_id", "no"]).select("video_id", "start_ms", "frame_index", "ts_ms")


def assign_batches(pending: DataFrame, size: int, saved: DataFrame | None = None) -> DataFrame:
    """Rows of a video in frame order to batches of ``size``, numbered from 0, or on from the largest ``batch`` of its ``saved`` rows."""
    rn = F.row_number().over(W.partitionBy("video_id").orderBy("frame_index"))
    batches = pending.withColumn("batch", F.floor((rn - 1) / size))
    if saved is None:
        return batches
    last = saved.groupBy("video_id").agg((F.max("batch") + 1).alias("_next"))
    return batches.join(last, "video_id", "left").withColumn("batch", F.col("batch") + F.coalesce("_next", F.lit(0))).drop("_next")
