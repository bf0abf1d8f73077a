"""Order-dependent folds of a video's rows, cut into parts that run side by side and checked where they meet."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from ..sources.shared import kept

#: Rows of a part, about. Characters of a text that the choice of a cut looks at.
ROWS, SEEN = 4096, 64


def cut(rows: DataFrame, order: list[str], most: int = ROWS) -> DataFrame:
    """Numbers a video's rows in ``order`` (``rn``) and gives each a ``part``; every ``most`` rows have one cut, where there is a place for it.

    A cut before a row that is ``sure`` to begin anew is best, then one where the texts on either side share the fewest characters;
    there is none between equal texts. Which places are taken matters for speed only: ``in_parts`` checks them.
    """
    rows = rows.withColumn("rn", F.row_number().over(W.partitionBy("video_id").orderBy(*order)).cast("long"))
    rows = rows.withColumn("_last", F.lag("text").over(W.partitionBy("video_id").orderBy("rn")))
    chars = lambda c: F.split(F.substring(c, 1, SEEN), "")
    shared = F.size(F.array_intersect(chars("text"), chars("_last"))) / F.size(F.array_union(chars("text"), chars("_last")))
    rank = F.when(F.col("sure"), F.lit(0.0)).when(F.col("text") != F.col("_last"), 1 + shared)
    rows = rows.withColumn("_rank", rank)
    best = F.min(F.when(F.col("_rank").isNotNull(), F.struct("_rank", "rn"))).over(W.partitionBy("video_id", F.floor((F.col("rn") - 1) / most)))
    at = F.coalesce((best["rn"] == F.col("rn")).cast("long"), F.lit(0))
    return rows.withColumn("_cut", at).withColumn("part", F.sum("_cut").over(W.partitionBy("video_id").orderBy("rn"))).drop("_last", "_rank", "_cut")


def in_parts(rows: DataFrame, order: list[str], fold: Callable[[pd.DataFrame], pd.DataFrame], joins: Callable[[Column, Column], Column], schema: StructType, most: int = ROWS) -> DataFrame:
    """What ``fold`` makes of each video's rows in ``order``, as if it ran over the whole video, with parts of about ``most`` rows in tasks of their own.

    Rows have video_id, text and ``sure``: no state goes into this row. ``fold`` takes rows in order and gives one row or more with a ``text``, which
    of the last one is all that decides whether the next row joins it: ``joins(text, next text)``. Each part is folded from its first row
    on; where the last text of one joins the first row of the next, the parts become one and are folded again, in rounds that take
    twice as many parts each, until no end joins: by induction from a video's first part, all parts then began rightly. Every round's rows
    are written to the shared folder.
    """
    rows = cut(rows, order, most)
    shape = StructType([*schema.fields, StructField("first", StringType()), StructField("sure", BooleanType()), StructField("parts", ArrayType(LongType())), StructField("run", LongType())])

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rn", kind="stable")
        out = fold(pdf)
        ends: list[list[int] | None] = [None] * len(out)
        ends[-1] = sorted(set(pdf["part"].tolist()))
        return out.assign(first=pdf["text"].iat[0], sure=bool(pdf["sure"].iat[0]), parts=ends, run=pdf["run"].iat[0])

    folded = lambda df: df.groupBy("video_id", "run").applyInPandas(one, shape)
    # Over the session's shuffle partitions, not fewer for few rows: the fold's time counts, not the rows' size.
    spread = rows.withColumn("run", F.col("part")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id", "run")
    done, reach = kept(folded(spread), "folded"), 1
    while True:
        in_order = W.partitionBy("video_id").orderBy("run")
        ends = done.where("parts is not null").withColumn("_next", F.when(~F.lead("sure").over(in_order), F.lead("first").over(in_order)))
        ends = ends.withColumn("_open", F.coalesce(joins(F.when(F.col("_next").isNotNull(), F.col("text")), F.col("_next")), F.lit(False)))
        led = ~F.col("sure") & F.coalesce(F.max("_open").over(in_order.rowsBetween(-reach, -1)), F.lit(False))
        ends = ends.withColumn("_head", F.when(~led, F.col("run"))).withColumn("into", F.max("_head").over(in_order.rowsBetween(W.unboundedPreceding, 0)))
        ends = ends.withColumn("_n", F.count("*").over(W.partitionBy("video_id", "into"))).where("_n > 1")
        moved = kept(ends.select("video_id", "run", "into", "parts"), "moved")
        if moved.isEmpty():
            return done.select(*schema.names)
        again = rows.join(moved.select("video_id", F.col("into").alias("run"), F.explode("parts").alias("part")), ["video_id", "part"])
        done = kept(done.join(moved.select("video_id", "run"), ["video_id", "run"], "left_anti").select(*shape.names).unionByName(folded(again)), "folded")
        reach *= 2
