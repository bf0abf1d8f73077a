"""Near-duplicate vectors: exact cosine links by PCA-ordered tiles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import components, stage
from .simhash import forest

#: Vectors of one block; two blocks make a tile of at most TILE x TILE cosines.
TILE = 1024
#: Rows the PCA basis is fitted on, at most. Any orthonormal basis gives the same links; this only orders dimensions.
PCA_ROWS = 20_000


def pca_basis(vectors: DataFrame, rows: int = PCA_ROWS) -> dict[int, np.ndarray]:
    """Orthonormal bases by vector length, largest variance first, from a bounded sample of unit vectors."""
    total = vectors.count()
    sample = vectors.select("v").sample(min(1.0, 1.2 * rows / max(total, 1)), seed=5).limit(rows).toPandas()["v"]
    bases = {}
    for size, part in sample.groupby(sample.map(len)):
        x = np.stack([np.asarray(v, np.float64) for v in part])
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        bases[int(size)] = np.linalg.eigh(x.T @ x)[1][:, ::-1].copy()
    return bases


def tile_links(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) of PCA-ordered unit vectors with cosine >= threshold.

    Products of the leading dimensions come first; the rest of a product is at most the product of the suffix norms.
    Rows and columns that no partner can lift to the threshold any more leave the tile, and once few pairs are open
    only those are finished.
    """
    rows, cols = np.arange(len(a)), np.arange(len(b))
    dims = a.shape[1]
    sa = np.sqrt(np.maximum(np.cumsum((a * a)[:, ::-1], axis=1)[:, ::-1], 0))
    sb = np.sqrt(np.maximum(np.cumsum((b * b)[:, ::-1], axis=1)[:, ::-1], 0))
    dot, at = np.zeros((len(a), len(b))), 0
    for to in [x for x in (4, 12, 28) if x < dims] + [dims]:
        dot += a[rows, at:to] @ b[cols, at:to].T
        at = to
        if at == dims:
            i, j = np.nonzero(dot >= threshold)
            return rows[i], cols[j]
        open_ = dot + sa[rows, at][:, None] * sb[cols, at][None, :] >= threshold - 1e-9
        if open_.sum() * 8 < open_.size:
            i, j = np.nonzero(open_)
            i, j = rows[i], cols[j]
            hit = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + 65536]], b[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)] or [np.empty(0, bool)])
            return i[hit], j[hit]
        r, c = open_.any(1), open_.any(0)
        rows, cols, dot = rows[r], cols[c], dot[np.ix_(r, c)]
    return np.empty(0, np.int64), np.empty(0, np.int64)


def cosine_links(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = 0.98, tile: int = TILE) -> DataFrame:
    """(id_col, n_links, component_id, kept) for each row of ``vectors``.

    Rows link when labels are equal and not null and the cosine in double precision reaches the threshold. A vector
    that is null, empty, zero, or holds a null or a non-finite component links with nothing, and so does a row with a
    null label: n_links 0, its own component, kept. Vectors of unequal length never link. A null id is kept with a
    null component and kept null; ties and repeated rows link like any others (a repeated row is another vector with
    the same id). Extra columns are not read; an empty table gives no rows.

    Equal vectors of a label are one class, weighted by its rows and named by 128 bits of hashes. Unit vectors whose cosine
    reaches the threshold are within reach = sqrt(2 - 2 * threshold) of each other in every component. So classes are
    dealt to strips of that width by the leading component and sorted by the second within a strip, and blocks of
    them are compared only within a strip or with the next one, if their second components come within reach as well.
    A tile gives link counts per class and the edges of a spanning forest, never its pairs. Cosines are of the rotated
    unit vectors; rounding can decide pairs within about 1e-14 of the threshold.
    """
    raw = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fit = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
    fit &= ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    raw = raw.withColumn("fit", F.coalesce(fit, F.lit(False)))
    key = F.concat(F.hex(F.xxhash64("label", "v")), F.lit("-"), F.hex(F.xxhash64(F.lit(7), "v", "label")))
    raw = stage(raw.withColumn("key", F.when(F.col("fit"), key)).withColumn("v", F.when(F.col("fit"), F.col("v"))), "vectors")
    classes = stage(raw.where("fit").groupBy("key", "label").agg(F.first("v").alias("v"), F.count("*").alias("n"), F.min("id").alias("least")), "classes")
    bases = pca_basis(classes)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-9

    def rotate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for v in pdf["v"]:
                v = np.asarray(v, np.float64)
                v = v / np.max(np.abs(v))  # so that squares neither overflow nor vanish
                v = v / np.sqrt(v @ v)
                out.append(v @ bases[len(v)] if len(v) in bases else v)
            lead = [(v[0], v[1] if len(v) > 1 else 0.0) for v in out]
            yield pd.DataFrame({"label": pdf["label"], "dims": [len(v) for v in out], "strip": [int(np.floor(x / reach)) for x, _ in lead], "second": [y for _, y in lead], "key": pdf["key"], "n": pdf["n"], "w": out})

    kind = dict(classes.dtypes)["label"]
    shape = f"label {kind}, dims int, strip int, second double, key string, n long, w array<double>"
    order = ["label", "dims", "strip", "second", "key"]
    ordered = classes.mapInPandas(rotate, shape).repartitionByRange(*order).sortWithinPartitions(*order)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, block, last, size = TaskContext.get().partitionId(), 0, None, 0
        for pdf in batches:
            ids = np.empty(len(pdf), np.int64)
            for k, group in enumerate(zip(pdf["label"], pdf["dims"], pdf["strip"])):
                if group != last or size == tile:
                    block, last, size = block + 1, group, 0
                ids[k] = (part << 32) + block
                size += 1
            yield pdf.assign(block=ids)

    blocks = stage(ordered.mapInPandas(cut, shape + ", block long"), "blocks")
    spans = blocks.groupBy("label", "dims", "strip", "block").agg(F.min("second").alias("lo"), F.max("second").alias("hi"))
    left = spans.select("label", "dims", F.explode(F.array(F.col("strip"), F.col("strip") + 1)).alias("strip"), F.col("strip").alias("own"), F.col("block").alias("x"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi"))
    near = ((F.col("own") != F.col("strip")) | (F.col("x") <= F.col("block"))) & (F.col("xlo") <= F.col("hi") + reach) & (F.col("lo") <= F.col("xhi") + reach)
    pairs = left.join(spans, ["label", "dims", "strip"]).where(near).select("x", F.col("block").alias("y"))
    ends = pairs.select("x", "y", F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    dealt = blocks.select("block", "key", "n", "w").join(stage(ends, "tiles"), "block").select("x", "y", "block", "key", "n", "w")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = pdf["x"].iat[0], pdf["y"].iat[0]
        a, b = pdf[pdf["block"] == x], pdf[pdf["block"] == y]
        wa, wb = np.stack(a["w"].to_numpy()), np.stack(b["w"].to_numpy())
        i, j = tile_links(wa, wb, threshold)
        if x == y:
            i, j = i[i != j], j[i != j]
            keys, n = a["key"].to_numpy(), a["n"].to_numpy()
            seen = np.bincount(i, n[j], len(keys))
            root = forest(len(keys), i, j)
        else:
            keys, n = np.concatenate([a["key"], b["key"]]), np.concatenate([a["n"], b["n"]])
            j = j + len(a)
            seen = np.bincount(i, n[j], len(keys)) + np.bincount(j, n[i], len(keys))
            root = forest(len(keys), i, j)
        own = np.nonzero(seen)[0]
        return pd.DataFrame({"key": keys[own], "links": seen[own].astype(np.int64), "root": keys[root[own]]})

    found = stage(dealt.groupBy("x", "y").applyInPandas(compare, "key string, links long, root string"), "found")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    grouped = classes.select("key", "n", "least").join(links, "key", "left").join(roots.select(F.col("node").alias("key"), "root"), "key", "left")
    grouped = grouped.withColumn("root", F.coalesce("root", "key"))
    named = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    known = stage(grouped.join(named, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    out = raw.join(known, "key", "left").select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id")).cast("long").alias("component_id"))
    return out.withColumn("kept", F.col(id_col) == F.col("component_id"))
