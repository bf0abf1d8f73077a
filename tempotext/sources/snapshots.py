"""Bucketed tables whose readers see the state before a write or after it, never one between.

Under ``path``, ``data/<id>/bucket=<k>`` holds files that are written once and never changed, and ``versions`` one small file a write:
(version, id, bucket, folder) of every bucket of the state it made. That file comes last and by one rename, so a write that fails, or
is still going on, leaves the state as it was, and a table that was loaded keeps its own state. One writer at a time; of two that
wrote the same version, readers take the one of greater id, whole. Nothing deletes the files of old states.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_VERSIONS = "version long, id string, bucket int, folder string"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def state(spark: SparkSession, path: str) -> tuple[int, dict[int, str]]:
    """The newest version, 0 if there is none, and the folder of each of its buckets: as many rows as the table has buckets."""
    try:
        versions = spark.read.schema(_VERSIONS).parquet(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0, {}
    newest = versions.groupBy("version", "id").agg(F.collect_list(F.struct("bucket", "folder")).alias("x")).orderBy(F.desc("version"), F.desc("id")).limit(1).first()
    return (newest["version"], {r["bucket"]: r["folder"] for r in newest["x"] if r["folder"] is not None}) if newest else (0, {})


def load(spark: SparkSession, path: str, schema: StructType, buckets: list[int] | None = None) -> DataFrame:
    """The newest state, or some of its buckets; a table that was never written is empty."""
    folders = [f for b, f in sorted(state(spark, path)[1].items()) if buckets is None or b in buckets]
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*folders)


def touched(rows: DataFrame) -> list[int]:
    """The buckets that ``rows`` fall in: at most as many numbers as there are buckets."""
    return sorted(r["bucket"] for r in rows.select("bucket").distinct().collect())


def commit(rows: DataFrame, path: str, buckets: list[int]) -> None:
    """Makes ``rows``, with a column ``bucket``, the whole content of ``buckets``; all others stay. A hot bucket is written in several files."""
    if not buckets:
        return
    spark, own = rows.sparkSession, uuid.uuid4().hex
    version, now = state(spark, path)
    folder = f"{path}/data/{own}"
    rows.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(folder)
    full = touched(spark.read.schema("bucket int").parquet(folder))
    now = {b: f for b, f in now.items() if b not in buckets} | {b: f"{folder}/bucket={b}" for b in full}
    made = [(version + 1, own, b, f) for b, f in sorted(now.items())] or [(version + 1, own, -1, None)]
    spark.createDataFrame(made, _VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
