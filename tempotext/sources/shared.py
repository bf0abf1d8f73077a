"""Where tables that Spark derives are kept: the folder that the driver and all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under ``spark.checkpoint.dir``; unset, under a folder of the application's own in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/tempotext-{label}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a written table: it is computed once, and lost executors don't bring its past back."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
