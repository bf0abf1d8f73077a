"""Sharding by bytes: per-partition totals, global prefix sums, cuts at equal targets. Native columns only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import fresh, number_rows, stage

#: Rows of a block, whose totals are summed before those of a partition; partitions of a group, summed before all groups.
BLOCK_BITS, GROUP = 13, 1000
#: Bits of ``monotonically_increasing_id`` below the partition's number.
ROW_BITS = 33


def _before(what: str, by: list[str], order: str) -> Column:
    """Sum of ``what`` over the rows before this one."""
    return F.coalesce(F.sum(what).over(W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def positions(rows: DataFrame, size: str = "size") -> DataFrame:
    """``rows`` with ``place`` (0, 1, ...) and ``offset`` (sum of ``size`` before) in the order they lie in, partition after partition.

    ``rows`` must be a written table with a column ``at`` from ``monotonically_increasing_id``. Sums run over blocks of
    2**BLOCK_BITS rows, then a partition's blocks, then GROUP partitions, then the groups: no window is longer.
    """
    part, block, group = "part", "block", "group"
    rows = rows.withColumn(block, F.shiftright("at", BLOCK_BITS))
    blocks = rows.groupBy(block).agg(F.sum(size).alias("b"), F.count("*").alias("n"))
    blocks = blocks.withColumn(part, F.shiftright(block, ROW_BITS - BLOCK_BITS))
    parts = blocks.groupBy(part).agg(F.sum("b").alias("b"), F.sum("n").alias("n")).withColumn(group, F.floor(F.col(part) / GROUP))
    groups = parts.groupBy(group).agg(F.sum("b").alias("b"), F.sum("n").alias("n"))
    every = groups.withColumn("one", F.lit(0))
    every = every.select(group, _before("b", ["one"], group).alias("gb"), _before("n", ["one"], group).alias("gn"))
    parts = parts.join(every, group).select(part, (F.col("gb") + _before("b", [group], part)).alias("pb"), (F.col("gn") + _before("n", [group], part)).alias("pn"))
    blocks = blocks.join(parts, part).select(block, (F.col("pb") + _before("b", [part], block)).alias("bb"), (F.col("pn") + _before("n", [part], block)).alias("bn"))
    rows = rows.join(blocks, block)
    own = W.partitionBy(block).orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    place = F.col("bn") + F.row_number().over(W.partitionBy(block).orderBy("at")) - 1
    return rows.withColumn("place", place).withColumn("offset", F.col("bb") + F.coalesce(F.sum(size).over(own), F.lit(0))).drop(block, "bb", "bn", "at")


def byte_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard): contiguous shards of near equal bytes, in the order of the ids.

    ``size`` is the text's UTF-8 bytes plus 1, a null text's is 1. A document lies in the shard that holds the middle of
    its bytes, counted over all documents before it: a shard's bytes differ from the target by less than the largest
    document at either end, and only a document longer than the target can leave a shard empty. ``slot`` counts a shard's
    documents from 0. ``grown_shard`` is null: cuts move when the number of shards changes. Equal texts are not kept together.

    Null ids come first; rows of one id are ordered by checksum and size, and rows equal in all three are
    interchangeable, so the result does not depend on the cluster's layout, and a range of many equal rows is still cut
    between them. Texts are read once. An empty table gives no rows.
    """
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    rows = docs.select(F.col(id_col).alias("id"), (F.length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("crc"))
    rows = stage(rows.withColumn("tie", F.monotonically_increasing_id()), "sizes")
    order = [F.col("id").asc_nulls_first(), F.col("crc"), F.col("size"), F.col("tie")]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = positions(stage(rows.drop("tie").withColumn("at", F.monotonically_increasing_id()), "ordered"))
    rows = stage(rows, "positions")
    total = rows.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    shard = F.floor((2 * F.col("offset") + F.col("size")) * F.lit(shards).cast("decimal(20,0)") / F.lit(2 * max(total, 1)).cast("decimal(20,0)"))
    rows = rows.withColumn("shard", shard.cast("int"))
    starts = rows.groupBy("shard").agg(F.min("place").alias("start"))  # one row a shard
    rows = rows.join(F.broadcast(starts), "shard")
    return rows.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("place") - F.col("start")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, path: str, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes ``docs``, all columns, as Parquet under ``path`` in folders ``shard=0``, ``shard=1``, ... of ``byte_shards``.

    Files of a shard hold ranges of its slots in order; a shard is written by as many tasks as its rows need. Rows of null and
    repeated ids come after all others, each by its own number.
    """
    rows, row = number_rows(docs, id_col)
    name, slot = fresh(docs, "shard"), fresh(docs, "slot")
    dealt = byte_shards(rows, shards, row, text_col).select(row, F.col("shard").alias(name), F.col("slot").alias(slot))
    rows.join(dealt, row).drop(row).repartitionByRange(name, slot).sortWithinPartitions(name, slot).write.partitionBy(name).parquet(path)
