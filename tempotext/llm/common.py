"""What the training-data operators share: staging in the cluster's folder, ids of connected groups, words."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: A word is a run of characters that are none of space, tab, LF, VT, FF, CR; ``bytes.split()`` cuts at the same six.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: ``spark.checkpoint.dir``; unset, one of our own in local mode, else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"/tmp/checkpoints/{spark.sparkContext.applicationId}"
    return base.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tempotext-{label}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage ends there, so a lost executor costs no recomputation."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def unstage(df: DataFrame) -> None:
    """Deletes what ``stage`` wrote; only for tables nothing reads any more."""
    path = getattr(df, "_staged_at", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it (Spark's names don't tell cases apart)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def number_rows(docs: DataFrame, id_col: str = "doc_id") -> tuple[DataFrame, str]:
    """``docs`` with a column, whose name is returned, that tells all rows apart.

    A row whose id no other row has keeps it; rows of null or repeated ids are numbered from 2**62 on, so any decision by
    number is about one row. Those are written first, as their numbers depend on how they are read.
    """
    name = fresh(docs, "row_id")
    repeated = docs.groupBy(id_col).agg(F.count("*").alias("n")).where(F.col("n") > 1).select(F.col(id_col).alias(name)).where(F.col(name).isNotNull())
    own = docs.withColumn(name, F.col(id_col).cast("long"))
    loose = docs.where(F.col(id_col).isNull())
    if not repeated.isEmpty():
        repeated = stage(repeated, "repeated")
        loose = loose.unionByName(docs.join(repeated, F.col(id_col) == F.col(name), "left_semi"))
        own = own.join(repeated, name, "left_anti").select(own.columns)
    own = own.where(F.col(name).isNotNull())
    if loose.isEmpty():
        return own, name
    return own.unionByName(stage(loose.withColumn(name, F.lit(1 << 62) + F.monotonically_increasing_id()), "loose")), name


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lower_words(text: str | None) -> list[bytes]:
    """Words of a text in UTF-8 with A-Z lowered (``bytes.lower`` and ``bytes.split`` know ASCII only); none for null."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def crc_mod(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n; the fold rule of the scoring operators. A null id falls to fold 0's side as null."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def components(edges: DataFrame) -> DataFrame:
    """Connected groups of an edge table ``(a, b)`` -> ``(node, root)``, root the smallest node; only nodes with an edge appear.

    Alternates large-star and small-star steps: each turns every neighbourhood into a star around its smallest
    node, so the number of rounds grows with the logarithm of a group's diameter. Minima are partial aggregates and
    the join back is one that Spark can split, so a node with very many links does not land in one task. Each round
    is a written table. Null ends and loops are dropped, repeated edges count once.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()
    e, seen = stage(e, "edges"), None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).union(e.select("b", "a"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = large.where("a > b")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.*")
        new = stage(small.where("a > b").distinct(), "edges")
        unstage(e)
        e = new
