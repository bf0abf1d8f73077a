"""SimHash near-duplicates: 64-bit fingerprints compared in vertical bit planes."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import components, lower_words, number_rows, stage

#: Rows of one comparison tile; whole buckets are packed together up to this many.
TILE = 512
#: A bucket with more distinct fingerprints than this is cut into blocks, and each pair of blocks is a tile of its own.
HEAVY = 4096
#: Shingle sets of a block; a task holds two blocks of a larger bucket.
BLOCK = 256


def fingerprint(words: list[bytes], shingle: int, seed: int) -> int:
    """Majority bits of the XXH64 of all word shingles; fewer words: of the whole sequence; none: 0."""
    n = len(words)
    if not n:
        return 0
    line = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(line, seed)
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    stop = np.cumsum(sizes)
    start = (stop - sizes)[: n - shingle + 1].tolist()
    stop = (stop[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(line[a:b], seed) for a, b in zip(start, stop)], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 8192):  # bounded memory for very long texts
        ones += np.unpackbits(h[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id_col, fp BIGINT) for each row; whole texts, null as empty."""

    @F.pandas_udf("long")
    def fp(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(np.array([fingerprint(lower_words(t), shingle, seed) for t in part], np.uint64).view(np.int64))

    return docs.select(F.col(id_col), fp(F.col(text_col)).alias("fp"))


def exact_masks(radius: int, blocks: int) -> list[int]:
    """Bit masks such that two values with at most ``radius`` different bits agree under one of them at least."""
    cut = [round(64 * i / blocks) for i in range(blocks + 1)]
    part = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:])]
    return [sum(x) for x in combinations(part, blocks - radius)]


def close_pairs(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All i < j of a tile whose values differ in at most ``radius`` bits.

    Bit planes are stored vertically (64 members a word). Each row takes planes two at a time through a carry-save
    adder into saturating vertical counters that start at an offset, so that a carry out of the top says "beyond the
    radius"; a row is abandoned once all its members are beyond.
    """
    n = len(fp)
    width = -(-n // 64)
    bits = np.zeros((64, width * 64), np.uint8)
    bits[:, :n] = np.unpackbits(fp.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").T
    planes = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
    flips = np.where(bits[:, :n].astype(bool), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    levels = (radius + 1).bit_length()
    offset = (1 << levels) - 1 - radius
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    rows = np.arange(n)
    # members up to the row itself, and those past the end, count as beyond from the start
    beyond = np.packbits(np.arange(width * 64)[None, :] <= rows[:, None], axis=1, bitorder="little").view(np.uint64)
    beyond |= np.packbits(np.arange(width * 64) >= n, bitorder="little").view(np.uint64)[None, :]
    count = [np.full((n, width), full if offset >> k & 1 else 0, np.uint64) for k in range(levels)]
    for p in range(0, 64, 2):
        x = planes[p][None, :] ^ flips[p][rows, None]
        y = planes[p + 1][None, :] ^ flips[p + 1][rows, None]
        half = count[0] ^ x
        carry = (count[0] & x) | (half & y)
        count[0] = half ^ y
        for k in range(1, levels):
            carry, count[k] = count[k] & carry, count[k] ^ carry
        beyond |= carry
        if p % 8 == 6:
            alive = (beyond != full).any(1)
            if not alive.any():
                return np.empty(0, np.int64), np.empty(0, np.int64)
            if alive.mean() < 0.7:
                rows, beyond, count = rows[alive], beyond[alive], [c[alive] for c in count]
    i, j = np.nonzero(np.unpackbits((~beyond).view(np.uint8), axis=1, bitorder="little"))
    return rows[i], j


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest reachable member of each of n members, over the pairs (i, j)."""
    label = np.arange(n)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (before == label).all():
            break
    return label


def fingerprint_links(classes: DataFrame, radius: int, masks: list[int]) -> DataFrame:
    """Edges ``(a, b)`` that join the distinct values ``fp`` of ``classes`` at ``radius`` or fewer different bits.

    A value goes to one bucket per mask. Tiles of whole buckets are compared, each tile gives the edges of a spanning
    forest of its close pairs, so a group of m values gives less than m edges a table. Buckets above HEAVY are cut into blocks and dealt
    out as pairs of blocks, which keeps the work of a task bounded and loses no pair.
    """
    parts = np.array(masks, np.uint64)

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            key = (fp.view(np.uint64)[:, None] & parts[None, :]).view(np.int64)
            yield pd.DataFrame({"part": np.tile(np.arange(len(parts), dtype=np.int32), len(fp)), "key": key.ravel(), "fp": np.repeat(fp, len(parts))})

    keyed = classes.select("fp").mapInPandas(keys, "part int, key long, fp long")
    many = stage(keyed.groupBy("part", "key").count().where(F.col("count") > HEAVY), "heavy")
    cells = keyed.withColumns({"x": F.lit(0), "y": F.lit(0)})
    if not many.isEmpty():
        cut = many.select("part", "key", F.ceil(F.col("count") / (HEAVY // 2)).cast("int").alias("k"))
        both = keyed.join(cut, ["part", "key"], "left").withColumn("k", F.coalesce("k", F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("k")).cast("int")
        both = both.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
        cells = both.select("part", "key", "fp", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def links(fp: np.ndarray) -> pd.DataFrame:
            fp = np.unique(fp)
            root = forest(len(fp), *close_pairs(fp.view(np.uint64), radius))
            own = np.nonzero(root != np.arange(len(fp)))[0]
            return pd.DataFrame({"a": fp[own], "b": fp[root[own]]})

        held: list[np.ndarray] = []
        size, last = 0, None
        for pdf in batches:
            fp = pdf["fp"].to_numpy(np.int64)
            cell = pdf[["part", "key", "x", "y"]].to_numpy(np.int64)
            new = np.ones(len(fp), bool)
            new[1:] = (cell[1:] != cell[:-1]).any(1)
            if len(fp):
                new[0] = last is None or (cell[0] != last).any()
                last = cell[-1]
            starts = np.append(np.nonzero(new)[0], len(fp))
            if starts[0]:
                held.append(fp[: starts[0]])
                size += starts[0]
            for a, b in zip(starts, starts[1:]):
                if size >= TILE:
                    yield links(np.concatenate(held))
                    held, size = [], 0
                held.append(fp[a:b])
                size += b - a
        if size:
            yield links(np.concatenate(held))

    dealt = cells.repartition("part", "key", "x", "y").sortWithinPartitions("part", "key", "x", "y")
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, seed: int = 42, radius: int = 2, masks: list[int] | None = None) -> DataFrame:
    """(id_col, fp, component_id) for each row of ``docs``.

    Rows with equal fingerprints are one class, whatever their number, so copies are never paired with each other.
    Null and empty texts share fingerprint 0 and link like any other. Repeated rows give repeated rows. A null id is
    kept but never names a group (a group of null ids only has a null component_id). An empty table gives no rows;
    other columns of ``docs`` are not read. With the default masks no pair within the radius is missed.
    """
    prints = stage(fingerprints(docs, id_col, text_col, shingle, seed).select(F.col(id_col).alias("id"), "fp"), "prints")
    classes = stage(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    roots = components(fingerprint_links(classes, radius, masks or exact_masks(radius, radius + 2)))
    grouped = classes.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    by_print = stage(grouped.join(named, "root").select("fp", "component_id"), "named")
    return prints.join(by_print, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def shingle_set(words: list[bytes], shingle: int) -> np.ndarray:
    """Distinct XXH64 of the word shingles, sorted; fewer words: of the whole sequence; none: empty."""
    line, at, starts, stops = b" ".join(words), 0, [], []
    for w in words:
        starts.append(at)
        at += len(w) + 1
        stops.append(at - 1)
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - shingle + 1)
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts[:last], stops[min(shingle, len(words)) - 1 :])] if words else [], np.uint64))


def band_keys(tokens: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """``bands`` hashes of ``rows`` MinHash values each: two sets of Jaccard similarity J share one with probability J**rows."""
    rng = np.random.default_rng(11)
    times = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    plus = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    least = np.full(bands * rows, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(tokens), 4096):  # bounded memory for very long texts
        np.minimum(least, (tokens[at : at + 4096, None] * times + plus).min(0), out=least)
    key = np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        key = (key ^ (least[r::rows] >> np.uint64(29)) ^ least[r::rows]) * np.uint64(0x9E3779B97F4A7C15)
    return (key ^ (key >> np.uint64(32))).view(np.int64)


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more of two sorted sets, exactly."""
    if 5 * min(len(x), len(y)) < 4 * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 5 * common >= 4 * (len(both) - common)


def near_copies(docs: DataFrame, bands: int = 32, rows: int = 5, shingle: int = 5, radius: int = 2) -> DataFrame:
    """(doc_id, component_id) for each row: connected groups of pairs whose five-word shingle sets have Jaccard 0.8 or more.

    Candidates are SimHash neighbours, fingerprints of op7 (``fingerprint``, three words) that differ in ``radius`` bits or fewer, found
    under exact masks (``fingerprint_links``). As a pair at 0.8 is often further apart than that, pairs that share one of ``bands`` MinHash keys are
    candidates besides; a pair at 0.8 does with probability 1 - (1 - 0.8**5)**32 = 0.999997 and closer ones more surely. Each link
    of either kind is verified on the whole shingle sets, so no estimate joins rows.
    Rows of equal sets are one class. Each member of a bucket is first verified against the bucket's least class; then
    all pairs of a bucket that are still in different groups are. Null and empty texts are one class; a null id never
    names a group. Repeated rows give repeated rows, an empty table none, other columns are not read.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            cls, fp, found = np.empty(len(pdf), np.uint64), np.empty(len(pdf), np.uint64), []
            for k, t in enumerate(pdf["text"]):
                words = lower_words(t)
                own, fp[k] = shingle_set(words, shingle), fingerprint(words, 3, 42)
                cls[k] = xxhash.xxh64_intdigest(own.tobytes())
                found.append(band_keys(own, bands, rows) if len(own) else own.view(np.int64))
            yield pd.DataFrame({"row": pdf["row"], "id": pdf["id"].astype("Int64"), "cls": cls.view(np.int64), "fp": fp.view(np.int64), "keys": found})

    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"cls": pdf["cls"], "own": [shingle_set(lower_words(t), shingle).tobytes() for t in pdf["text"]]})

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok = [alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(pdf["own"], pdf["other"])]
            yield pdf.loc[np.array(ok, bool), ["a", "b"]]

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links between different groups of each cell; what is linked already isn't compared again."""

        def links(cell: list[tuple]) -> pd.DataFrame:
            label: dict[int, int] = {}

            def find(r: int) -> int:
                while label.get(r, r) != r:
                    r = label[r]
                return r

            out = []
            for j, (cls, root, own) in enumerate(cell):
                for cls2, root2, own2 in cell[:j]:
                    r, r2 = find(root), find(root2)
                    if r != r2 and alike(own, own2):
                        label[r] = r2
                        out.append((cls, cls2))
            return pd.DataFrame(np.array(out, np.int64).reshape(-1, 2), columns=["a", "b"])

        last, held = None, []
        for pdf in batches:
            for key, x, y, cls, root, own in zip(pdf["key"], pdf["x"], pdf["y"], pdf["cls"], pdf["root"], pdf["own"]):
                if (key, x, y) != last:
                    if len(held) > 1:
                        yield links(held)
                    last, held = (key, x, y), []
                held.append((cls, root, np.frombuffer(own, np.uint64)))
        if len(held) > 1:
            yield links(held)

    numbered, row = number_rows(docs)
    texts = numbered.select(F.col(row).alias("row"), F.col("doc_id").cast("long").alias("id"), "text")
    prints = stage(texts.mapInPandas(keys, "row long, id long, cls long, fp long, keys array<long>"), "prints")
    classes = stage(prints.groupBy("cls").agg(F.min("id").alias("least"), F.min("row").alias("row")), "classes")
    keyed = prints.select("cls", F.explode("keys").alias("key")).distinct()
    shared = stage(keyed.groupBy("key").agg(F.min("cls").alias("first"), F.max("cls").alias("last")).where("first < last").drop("last"), "shared")
    members = stage(keyed.join(shared.hint("merge"), "key"), "members")
    # Neighbours by SimHash: a class against the least one of its fingerprint, and those of close fingerprints.
    printed = stage(prints.select("fp", "cls").distinct(), "fingerprints")
    heads = stage(printed.groupBy("fp").agg(F.min("cls").alias("head")), "heads")
    close = stage(fingerprint_links(heads.select("fp"), radius, exact_masks(radius, radius + 2)), "close")
    one = lambda c, name: heads.select(F.col("fp").alias(c), F.col("head").alias(name)).hint("merge")
    close = close.withColumnsRenamed({"a": "x", "b": "y"}).join(one("x", "a"), "x").join(one("y", "b"), "y").select("a", "b")
    close = close.unionByName(printed.join(heads.hint("merge"), "fp").select(F.col("cls").alias("a"), F.col("head").alias("b"))).where("a <> b")
    close = stage(close.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "close")
    seen = members.select("cls").unionByName(close.select(F.col("a").alias("cls"))).unionByName(close.select(F.col("b").alias("cls"))).distinct()
    asked = classes.join(seen.hint("merge"), "cls").select("cls", "row")  # a row of each class
    sets = stage(texts.join(asked.hint("merge"), "row").select("cls", "text").mapInPandas(tokens, "cls long, own binary"), "sets")
    pairs = members.where("cls <> first").select(F.col("cls").alias("a"), F.col("first").alias("b")).unionByName(close).distinct()
    one, two = sets.select(F.col("cls").alias("a"), "own"), sets.select(F.col("cls").alias("b"), F.col("own").alias("other"))
    first = stage(pairs.join(one.hint("merge"), "a").join(two.hint("merge"), "b").select("a", "b", "own", "other").mapInPandas(verify, "a long, b long"), "links")
    roots = components(first)

    grouped = members.select("key", "cls").join(roots.select(F.col("node").alias("cls"), "root").hint("merge"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    grouped = stage(grouped, "grouped")
    mixed = grouped.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"))
    mixed = mixed.where("low < high").select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    open_ = grouped.join(mixed.hint("merge"), "key").withColumn("mine", F.pmod(F.xxhash64("cls"), F.col("k")).cast("int"))
    open_ = open_.withColumn("theirs", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    open_ = open_.select("key", F.least("mine", "theirs").alias("x"), F.greatest("mine", "theirs").alias("y"), "cls", "root").join(sets.hint("merge"), "cls")
    dealt = open_.select("key", "x", "y", "cls", "root", "own").repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
    more = stage(dealt.mapInPandas(compare, "a long, b long"), "links")
    if not more.isEmpty():
        roots = components(first.union(more))
    named = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = stage(named.join(least, "root").select("cls", "component_id"), "named")
    return prints.join(by_class, "cls").select(F.col("id").alias("doc_id"), "component_id")


def keep_one(docs: DataFrame, **params) -> DataFrame:
    """One row of each near-duplicate group, that of the smallest id, with all its columns.

    Rows are judged one by one: of rows that share an id but not a group each can stay; rows of null ids come after all
    others, so one stays only if its group has no other row that does.
    """
    rows, row = number_rows(docs)
    groups = near_copies(rows.select(F.col(row).alias("doc_id"), "text"), **params)  # all ids differ, so its numbers are these
    keep = groups.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias(row))
    return rows.join(stage(keep, "keep"), row, "left_semi").select(docs.columns)
