"""Ranked lexical search: posting lists with range-maximum sparse tables, best-first over document intervals."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from .common import stage

#: Documents of an item that are returned.
BEST = 20
#: Postings of one index block; a task holds one block at a time.
BLOCK_POSTINGS = 400_000
#: Intervals split at once, those of the highest bounds.
AT_ONCE = 32
#: Items whose terms one scan of the corpus looks for: their number and the bytes of their texts. More take more scans.
MOST_ITEMS, MOST_ITEM_BYTES = 20_000, 32 << 20
#: Groups of tasks whose best are ranked before the groups' best are.
GROUPS = 64

#: ASCII that is no letter or digit parts terms; all else belongs to them. A-Z becomes a-z.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, in order; none for null."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Block:
    """Index of some documents: posting lists in document order, with one range-maximum table for each list.

    The lists stand one after the other in arrays; level k of the table has, for each place, where the highest of the
    2**k impacts from there on is. A list is never asked beyond its ends.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, weight: np.ndarray) -> None:
        impact = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[doc]))
        some = impact > 0
        key = term[some] * len(ids) + doc[some]
        order = np.argsort(key, kind="stable")
        self.ids, self.key, self.impact = ids, key[order], impact[some][order]
        longest = int(np.bincount(term[some]).max(initial=1))
        self.table = [np.arange(len(order), dtype=np.int32)]
        half = 1
        while 2 * half <= longest:
            a = self.table[-1]
            b = np.append(a[half:], a[len(a) - half :])
            self.table.append(np.where(self.impact[b] > self.impact[a], b, a))
            half *= 2
        self.flat = np.concatenate(self.table) if len(order) else np.empty(0, np.int32)

    def maxima(self, a: np.ndarray, b: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sum of the highest impacts in the places [a, b) of each list, document of the highest) for each row of lists."""
        size = b - a
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        base = level.astype(np.int64) * len(self.key)
        full = size > 0
        one = self.flat[np.where(full, base + a, 0)]
        two = self.flat[np.where(full, base + b - (1 << level), 0)]
        at = np.where(self.impact[two] > self.impact[one], two, one)
        value = np.where(full, self.impact[at] * times, 0)
        top = value.argmax(1)
        return value.sum(1), self.key[at[np.arange(len(top)), top]] % len(self.ids)

    def search(self, terms: np.ndarray, times: np.ndarray, best: "Best") -> None:
        """Gives ``best`` all documents that may be among its highest.

        The intervals of the highest bounds are split at the document of their highest single impact, which is scored
        exactly; what is left and right of it goes on with the bounds of its own ranges. It ends when no bound reaches the
        lowest of the documents kept.
        """
        n = len(self.ids)
        if not n or not len(self.key):
            return
        low = terms * n
        edges = np.linspace(0, n, min(n, AT_ONCE) + 1).astype(np.int64)
        cut = np.searchsorted(self.key, low[None, :] + edges[:, None])
        first, a, b = edges[:-1], cut[:-1], cut[1:]
        bound, doc = self.maxima(a, b, times)
        while True:
            open_ = (bound > best.least) | ((bound == best.least) & (bound > 0) & (self.ids[first] < best.last))
            if not open_.all():
                first, a, b, bound, doc = first[open_], a[open_], b[open_], bound[open_], doc[open_]
            if not len(bound):
                return
            if len(bound) > AT_ONCE:
                now = np.argpartition(-bound, AT_ONCE)[:AT_ONCE]
                rest = np.ones(len(bound), bool)
                rest[now] = False
            else:
                now, rest = np.arange(len(bound)), np.zeros(len(bound), bool)
            d = doc[now]
            want = low[None, :] + d[:, None]
            at = np.searchsorted(self.key, want)
            has = self.key[np.minimum(at, len(self.key) - 1)] == want
            best.add((self.impact[np.where(has, at, 0)] * times * has).sum(1), self.ids[d])
            a2, b2 = np.concatenate([a[now], at + has]), np.concatenate([at, b[now]])
            some = (b2 > a2).any(1)
            first2, a2, b2 = np.concatenate([first[now], np.minimum(d + 1, n - 1)])[some], a2[some], b2[some]
            bound2, doc2 = self.maxima(a2, b2, times) if len(a2) else (bound[:0], doc[:0])
            first, a, b = np.concatenate([first[rest], first2]), np.concatenate([a[rest], a2]), np.concatenate([b[rest], b2])
            bound, doc = np.concatenate([bound[rest], bound2]), np.concatenate([doc[rest], doc2])


class Best:
    """The highest scores above 0 of an item so far; of equal ones those of the smallest ids."""

    def __init__(self, k: int) -> None:
        self.k, self.scores, self.ids = k, np.empty(0, np.int64), np.empty(0, np.int64)
        self.least, self.last = 0, 1 << 63

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        may = scores >= max(self.least, 1)
        if not may.any():
            return
        scores, ids = np.append(self.scores, scores[may]), np.append(self.ids, ids[may])
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[order], ids[order]
        if len(order) == self.k:
            self.least, self.last = int(self.scores[-1]), int(self.ids[-1])


#: Stands for a null id: after all others.
NO_ID = (1 << 63) - 1


def _item_blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """(item, item's terms) in blocks that fit the driver and a broadcast; ``items``: columns item, text."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row["item"], Counter(terms_of(row["text"]))))
        size += len(row["text"] or "")
        if len(block) >= MOST_ITEMS or size >= MOST_ITEM_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def postings(docs: DataFrame, known: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, terms, tfs) of the documents with a term: n all their terms; numbers and counts, as int32, of those in ``known``."""
    names = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = names.value.get
        for pdf in batches:
            out = []
            for doc, text in zip(pdf["doc_id"], pdf["text"]):
                found = terms_of(text)
                if found:
                    own = np.fromiter((k for k in map(number, found) if k is not None), np.int32)
                    term, tf = np.unique(own, return_counts=True)
                    out.append((None if doc is None or doc != doc else int(doc), len(found), term.tobytes(), tf.astype(np.int32).tobytes()))
            made = pd.DataFrame(out, columns=["doc_id", "n", "terms", "tfs"])
            yield made.astype({"doc_id": "Int64"})

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("text is not null")
    # an id that passes as a float would lose digits; as text it keeps them
    rows = rows.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.mapInPandas(count, "doc_id long, n long, terms binary, tfs binary")


def statistics(lists: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, their terms, documents of each numbered term), counted over all rows; no more rows than terms come to the driver."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, docs, total = np.zeros(n_terms, np.int64), 0, 0
        for pdf in batches:
            docs, total = docs + len(pdf), total + int(pdf["n"].sum())
            df += np.bincount(np.frombuffer(b"".join(pdf["terms"]), np.int32), minlength=n_terms)
        some = np.nonzero(df)[0]
        yield pd.DataFrame({"term": np.append(some, [-1, -2]), "df": np.append(df[some], [docs, total])})

    out = {r["term"]: r["df"] for r in lists.select("n", "terms").mapInPandas(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()}
    return out.get(-1, 0), out.get(-2, 0), np.array([out.get(k, 0) for k in range(n_terms)], np.int64)


def _blocks(batches: Iterator[pd.DataFrame], weight: np.ndarray, n_docs: int, n_all: int) -> Iterator[Block]:
    """Index blocks of about BLOCK_POSTINGS postings; documents stand in the order of their ids."""
    held: list[tuple] = []
    size = 0

    def made() -> Block:
        held.sort(key=lambda x: x[0])
        ids, n = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.int64)
        doc = np.repeat(np.arange(len(held)), [len(x[2]) // 4 for x in held])
        term, tf = (np.frombuffer(b"".join(x[k] for x in held), np.int32).astype(np.int64) for k in (2, 3))
        return Block(ids, 75 + (25 * n * n_docs) // n_all, doc, term, tf, weight)

    for pdf in batches:
        for row in zip(pdf["doc_id"], pdf["n"], pdf["terms"], pdf["tfs"]):
            held.append(row)
            size += len(row[2]) // 4 + 1
            if size >= BLOCK_POSTINGS:
                yield made()
                held, size = [], 0
    if held:
        yield made()


def rank(docs: DataFrame, items: DataFrame, best: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of ``items`` its ``best`` documents with a score above 0, by score, then id.

    Terms, weights, lengths and scores are integers as in ``Block``; counts are over all documents, and every document is
    indexed, for the terms that any item has. A task indexes its documents block by block, asks each block for every item
    and carries an item's lowest kept score on; the tasks' best are ranked in groups, then the groups' best.

    Null and empty texts have no terms: as items they return nothing, as documents they don't count. Documents of a null id
    count and come last among equal scores; repeated ids are documents of their own, as repeated items are items. Items
    are read in blocks of MOST_ITEMS rows or MOST_ITEM_BYTES bytes, each with its own scan. Empty tables give no rows.
    """
    spark, kind = docs.sparkSession, items.schema[item_col].dataType.simpleString()
    asked = items.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    schema = f"place int, item {kind}, doc_id long, score long"
    out = None
    for block in _item_blocks(asked):
        found = _search(docs, block, best, schema, id_col, text_col)
        if found is None:
            continue
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
        found = found.withColumn("r", F.row_number().over(W.partitionBy("place", "part").orderBy(*order))).where(F.col("r") <= best)
        found = found.withColumn("r", F.row_number().over(W.partitionBy("place").orderBy(*order))).where(F.col("r") <= best)
        found = found.select(F.col("item").alias(item_col), F.col("r").alias("rank"), F.col("doc_id").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"{item_col} {kind}, rank int, {id_col} long, score long")
    return out


def _search(docs: DataFrame, block: list[tuple], best: int, schema: str, id_col: str, text_col: str) -> DataFrame | None:
    """The best rows of each task for a block of items; None where nothing can be found."""
    spark: SparkSession = docs.sparkSession
    known = {t: k for k, t in enumerate(sorted({t for _, own in block for t in own}))}
    if not known:
        return None
    lists = stage(postings(docs, known, id_col, text_col), "postings")
    n_docs, n_all, df = statistics(lists, len(known))
    if not n_docs:
        return None
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)
    asked = []
    for place, (item, own) in enumerate(block):
        # terms of no weight or no document add nothing
        some = [(known[t], c) for t, c in own.items() if df[known[t]] and weight[known[t]]]
        if some:
            asked.append((place, item, np.array([x[0] for x in some], np.int64), np.array([x[1] for x in some], np.int64)))
    told = spark.sparkContext.broadcast((asked, weight))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        queries, w = told.value
        found = [Best(best) for _ in queries]
        for index in _blocks(batches, w, n_docs, n_all):
            for (_, _, terms, times), kept in zip(queries, found):
                index.search(terms, times, kept)
        out = [(place, item, None if d == NO_ID else int(d), int(s)) for (place, item, _, _), kept in zip(queries, found) for s, d in zip(kept.scores, kept.ids)]
        yield pd.DataFrame({"place": pd.array([x[0] for x in out], "int32"), "item": pd.Series([x[1] for x in out], dtype="object"), "doc_id": pd.array([x[2] for x in out], "Int64"), "score": pd.array([x[3] for x in out], "int64")})

    lists = lists.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    return lists.mapInPandas(search, schema)
