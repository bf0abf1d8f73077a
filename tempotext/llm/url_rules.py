"""URL filtering: a sort-merge range join of canonical url keys with nested prefix rules."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from .common import lower_ascii

#: Rule sets of up to this many rows and characters are sent to every task; larger ones are range partitioned with the urls.
SMALL_RULES, SMALL_CHARS = 100_000, 16_000_000
#: Urls whose keys choose the cuts of the range partitioning (a sample; cuts only balance the work).
CUT_SAMPLE = 20_000


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; null or no ``://``: empty."""
    rest = F.when(F.instr(url, "://") > 0, F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1))
    return lower_ascii(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def reversed_host(host: Column) -> Column:
    """Canonical order: ``www.example.com`` -> ``com.example.www.``, so that a domain is a prefix of its subdomains."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def sweep(keys: list[str], paths: list[str], rules: list[tuple[str, str, str, str]]) -> list[tuple[str | None, str | None]]:
    """Merges sorted url keys with sorted rules; the stack holds the rules whose interval covers the current key.

    A rule ``(reversed host, path, name, verdict)`` opens at its reversed host and stays while the host is a prefix of
    the key; intervals nest, so those that end are on top. Of the open rules whose path begins the url's path the
    longest name wins; of equally long ones the deeper host, then block before allow.
    """
    out, stack, at = [], [], 0
    for key, path in zip(keys, paths):
        while at < len(rules) and rules[at][0] <= key:
            rule = rules[at]
            while stack and not rule[0].startswith(stack[-1][0]):
                stack.pop()
            stack.append(rule)
            at += 1
        while stack and not key.startswith(stack[-1][0]):
            stack.pop()
        best = max((r for r in stack if path.startswith(r[1])), key=lambda r: (len(r[2]), len(r[0]), r[3]), default=None)
        out.append((best[2], best[3]) if best else (None, None))
    return out


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", small_rules: int = SMALL_RULES) -> DataFrame:
    """(id_col, host, path, rule, verdict) for each row of ``pages``; ``rules`` has (host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's; the longest ``host + path`` wins;
    no rule: ``rule`` null and the ``default`` verdict (allow). A null or unparsable url has empty host and path and
    no rule. Rules with a null or empty host fit nothing, a null path is an empty one. Repeated rows and null ids stay
    as they are, other columns are not read.
    """
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    urls = urls.withColumn("key", F.concat(reversed_host(F.col("host")), "path"))
    table = rules.select(lower_ascii(F.col("host")).alias("h"), F.coalesce("path", F.lit("")).alias("p"), F.col("verdict").alias("v")).where("h is not null and h <> ''").distinct()
    table = table.select(reversed_host(F.col("h")).alias("key"), "p", F.concat("h", "p").alias("rule"), "v")
    n, chars = table.agg(F.count("*"), F.coalesce(F.sum(F.length("key") + F.length("p")), F.lit(0))).first()
    schema = "id long, host string, path string, rule string, verdict string"
    if n <= small_rules and chars <= SMALL_CHARS:
        return _sweep_local(urls, sorted(map(tuple, table.collect())), default, schema).withColumnRenamed("id", id_col)
    return _sweep_ranges(urls, table, default, schema).withColumnRenamed("id", id_col)


def _sweep_local(urls: DataFrame, rules: list[tuple[str, str, str, str]], default: str, schema: str) -> DataFrame:
    """Each batch is sorted and swept with all rules: no shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pdf = pdf.sort_values("key", ignore_index=True)
            found = sweep(pdf["key"].tolist(), pdf["path"].tolist(), rules)
            yield pdf[["id", "host", "path"]].assign(rule=[r for r, _ in found], verdict=[v or default for _, v in found])

    return urls.mapInPandas(run, schema)


def _sweep_ranges(urls: DataFrame, rules: DataFrame, default: str, schema: str) -> DataFrame:
    """Urls and rules meet in key ranges; a rule goes to each range its interval touches, so each range has its whole stack.

    A range that is one hot key is salted: its urls are dealt over as many cells as it has shares, its rules go to all.
    """
    spark = urls.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = max(1, urls.count())
    sample = sorted(r[0] for r in urls.select("key").sample(min(1.0, CUT_SAMPLE / total), seed=3).limit(2 * CUT_SAMPLE).collect())
    cuts = sorted({sample[k * len(sample) // parts] for k in range(1, parts)} if sample else set())

    @F.pandas_udf("int")
    def part_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: bisect_left(cuts, k)).astype("int32")

    placed = urls.withColumn("part", part_of("key"))
    share = -(-total // parts)
    wide = placed.groupBy("part").agg(F.ceil(F.count("*") / share).cast("int").alias("salts"))  # at most one row a range
    placed = placed.join(F.broadcast(wide), "part").withColumn("salt", F.pmod(F.xxhash64("id", "path"), F.col("salts")).cast("int"))
    placed = placed.select("part", "salt", "key", F.lit(1).alias("kind"), "id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("v"))
    last = F.concat("key", F.lit("\U0010ffff"))
    spread = rules.withColumn("part", F.explode(F.sequence(part_of("key"), part_of(last)))).join(F.broadcast(wide), "part")
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))
    spread = spread.select("part", "salt", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("string").alias("host"), F.col("p").alias("path"), "rule", "v")
    both = placed.unionByName(spread).repartition("part", "salt").sortWithinPartitions("part", "salt", "key", "kind", "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stack: list[tuple] = []
        cell = None
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                if (row.part, row.salt) != cell:
                    stack, cell = [], (row.part, row.salt)
                while stack and not row.key.startswith(stack[-1][0]):
                    stack.pop()
                if row.kind == 0:
                    stack.append((row.key, row.path, row.rule, row.v))
                else:
                    rule, verdict = sweep([row.key], [row.path], stack)[0]
                    out.append((row.id, row.host, row.path, rule, verdict or default))
            yield pd.DataFrame(out, columns=["id", "host", "path", "rule", "verdict"])

    return both.mapInPandas(run, schema)
