"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums, whole epochs before fractions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import WORD, stage
from .shards import positions

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """Document weight in [0.2, 1]: 1 less four times the share of ``#$%&*|{}<>`` among the characters; 0.2 for empty texts."""
    size = F.length(text)
    plain = F.length(F.translate(text, "#$%&*|{}<>", ""))
    return F.when(size > 0, F.greatest(F.lit(0.2), F.lit(1.0) - F.lit(4.0) * (size - plain) / size)).otherwise(F.lit(0.2))


def uniform(id_: Column, seed: int) -> Column:
    """A number in (0, 1) from 48 bits of the MD5 of id and seed: the same in every run and on every cluster layout."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary")), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) -> with ``target``: ``share`` of all words split by weight, none above ``most`` times its size.

    A source is full once the level (words per unit of weight) reaches most*size/weight; sorted by that ratio, the
    sources below the final level are full and the rest share what is left, so no iteration is needed. The table has
    a row for each source, which is what a single window may hold.
    """
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.withColumn("w", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
    t = t.withColumn("r", F.col("cap") / F.col("w"))
    up = W.orderBy("r", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    all_ = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    t = t.withColumn("full", F.coalesce(F.sum("cap").over(up), F.lit(0.0)))
    t = t.withColumn("open", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(up), F.lit(0.0)))
    t = t.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(all_) - F.col("full")) / F.col("open"))
    # the first source in this order that the level doesn't fill gives the final level
    t = t.withColumn("place", F.row_number().over(W.orderBy("r", F.col("source").asc_nulls_last())))
    level = F.min_by("level", F.when(F.col("level") <= F.col("r"), F.col("place"))).over(all_)
    t = t.withColumn("final", F.coalesce(level, F.max("r").over(all_)))
    return t.select("source", "source_size", F.least(F.col("cap"), F.col("final") * F.col("w")).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, size, source_size, target, taken) for each row of ``docs``, plus the columns named in ``keep``.

    ``taken`` are the words the mix takes of the document: every whole epoch of its source first, then, in the order
    of the keys -ln(u)/quality, documents until the words left of the target are used up; the last one in part. So a
    source's taken words are the floor of its target. Null texts have size 0; null sources are one source, ordered
    last; equal keys (repeated rows) are ordered by id and size, and equal rows are interchangeable. An empty table
    gives no rows.

    All rows are laid out once in the order of source, key, id and size by Spark's range partitioning, which also cuts between rows
    equal in all of these, and written; prefix sums run over blocks of rows, then over the totals of blocks and partitions
    (``shards.positions``), so no source, id or key has a window of its own. Texts are read once; what is known of them is written.
    """
    cols = [F.col(c).alias(f"keep_{k}") for k, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), (-F.log(uniform(F.col(id_col), seed)) / quality(F.col(text_col))).alias("key"), *cols)
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()), "keys")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, share, most, weights)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)))
    plan = plan.withColumn("rest", F.floor(F.col("target")) - F.col("epochs") * F.col("source_size"))
    before = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    plan = plan.withColumn("base", F.coalesce(F.sum("source_size").over(before), F.lit(0))).withColumnRenamed("source", "s")
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("id"), F.col("size"), F.col("tie")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id())
    rows = positions(stage(laid, "laid")).join(plan, F.col("source").eqNullSafe(F.col("s")))
    prefix = F.col("offset") - F.col("base")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - prefix))
    taken = (F.col("epochs") * F.col("size") + part).cast("long").alias("taken")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target", taken, *[F.col(f"keep_{k}").alias(c) for k, c in enumerate(keep)])
