"""Toxicity by multiple-instance learning: sentence probabilities joined by noisy-or, learned from document labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, expm1, log1p

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, fresh, stage

#: Labelled documents of each class that the classifier is fitted on, at most, in the order of a hash of the id.
FIT_ROWS = 6_000
#: Features with a weight, the documents of the sample a feature must be in, and the standard errors by which its shares must differ.
FEATURES, LEAST_DOCS, LEAST_Z = 4000, 6, 4.0
#: A word's features are itself and its beginnings of these lengths (inflected and compound forms share those).
PREFIXES = (4, 5, 6)
SENTENCE = re.compile(r"[.!?\n]+")
LETTERS = re.compile(r"[^\W\d_]+")


def features(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]


class Weights(dict):
    """Summed feature weights of words, remembered."""

    def __init__(self, of: dict[str, float]) -> None:
        super().__init__()
        self.of = of

    def __missing__(self, word: str) -> float:
        z = sum(self.of.get(f, 0.0) for f in features(word))
        if len(self) < 100_000:
            self[word] = z
        return z


@dataclass
class Model:
    """Weights of features and the base of every sentence, in log odds."""

    weights: dict[str, float]
    base: float

    def __post_init__(self) -> None:
        self.words = Weights(self.weights)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "base": self.base}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def sentence(self, words: list[str]) -> float:
        """Probability that a sentence is toxic; each word counts once."""
        z = self.base + sum(map(self.words.__getitem__, set(words)))
        return 1.0 / (1.0 + np.exp(-min(max(z, -40.0), 40.0)))

    def document(self, text: str | None) -> float:
        """1 - product over sentences of (1 - p); 0 for a text without sentences."""
        clean, get = 0.0, self.words.__getitem__
        for s in SENTENCE.split(text.lower()) if text else ():
            words = LETTERS.findall(s)
            if words:
                z = self.base + sum(map(get, set(words)))
                clean -= log1p(exp(min(z, 30.0)))  # log(1 - p)
        return -expm1(clean)


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, most: int = FEATURES, seed: int = 11) -> Model:
    """Fits the model on labelled rows outside fold 0 of crc32(doc_id) mod 5; only texts and ``toxic`` are read.

    At most ``fit_rows`` documents of each class take part (the classifier's one bounded sample); they are weighted back
    to the classes' shares of all labelled rows. Null ids, labels and texts don't take part. Without rows of both
    classes every document scores 0.
    """
    train = labels.where((crc_mod("doc_id", 5) != 0) & F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").alias("y"))
    shares = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(shares) < 2:
        return Model({}, float("-inf"))
    order = F.xxhash64(F.col("doc_id"), F.lit(seed))
    ids = [train.where(F.col("y") == y).orderBy(order, "doc_id").limit(fit_rows) for y in (0, 1)]
    chosen = F.broadcast(ids[0].union(ids[1]))
    sample = stage(docs.select("doc_id", "text").join(chosen, "doc_id").where("text is not null").select("y", "text"), "labelled")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            seen = (Counter(), Counter())
            for y, text in zip(pdf["y"], pdf["text"]):
                seen[y].update({f for w in set(LETTERS.findall(text.lower())) for f in features(w)})
            words = list(seen[0].keys() | seen[1].keys())
            yield pd.DataFrame({"word": words, "n0": [seen[0][w] for w in words], "n1": [seen[1][w] for w in words]})

    sizes = {r["y"]: r["n"] for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model({}, float("-inf"))
    words = sample.mapInPandas(count, "word string, n0 long, n1 long").groupBy("word").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    p0, p1 = (F.col("n0") + 0.5) / (sizes[0] + 1.0), (F.col("n1") + 0.5) / (sizes[1] + 1.0)
    both = (F.col("n0") + F.col("n1")) / float(sizes[0] + sizes[1])
    z = F.abs(p1 - p0) / F.sqrt(both * (1.0 - F.least(both, F.lit(0.999))) * (1.0 / sizes[0] + 1.0 / sizes[1]))
    best = words.where((F.col("n0") + F.col("n1") >= LEAST_DOCS) & (z >= LEAST_Z)).orderBy(z.desc(), "word").limit(most)
    index = {r["word"]: k for k, r in enumerate(best.select("word").collect())}

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for y, text in zip(pdf["y"], pdf["text"]):
                marked, plain = [], 0
                for s in SENTENCE.split(text.lower()):
                    words = LETTERS.findall(s)
                    ids = sorted(index[f] for w in set(words) for f in features(w) if f in index)
                    plain += bool(words) and not ids
                    marked += [ids] if ids else []
                rows.append((y, plain, [i for ids in marked for i in ids], [len(ids) for ids in marked]))
            yield pd.DataFrame(rows, columns=["y", "plain", "ids", "sizes"])

    rows = sample.mapInPandas(encode, "y int, plain int, ids array<int>, sizes array<int>").toPandas()
    w, b = _train(rows, len(index), shares)
    return Model({word: float(w[k]) for word, k in index.items() if abs(w[k]) > 1e-3}, float(b))


def _train(rows: pd.DataFrame, n: int, shares: dict[int, int], steps: int = 400, rate: float = 0.1, decay: float = 3e-4) -> tuple[np.ndarray, float]:
    """Noisy-or log likelihood by Adam over all documents at once; weights decay to zero."""
    rows = rows.sort_values(["y", "plain"], kind="stable", ignore_index=True)
    ids = np.concatenate([np.asarray(x, np.int64) for x in rows["ids"]])
    sizes = [np.asarray(x, np.int64) for x in rows["sizes"]]
    bag = np.repeat(np.arange(len(rows)), [len(x) for x in sizes])
    flat = np.concatenate(sizes)
    sent = np.repeat(np.arange(len(flat)), flat)
    y, plain = rows["y"].to_numpy(float), rows["plain"].to_numpy(float)
    share = np.array([shares[0], shares[1]], float) / sum(shares.values())
    weight = np.where(y == 1, share[1] / max(y.mean(), 1e-9), share[0] / max(1 - y.mean(), 1e-9)) / len(y)
    w, b = np.zeros(n), -6.0
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = np.clip(b + np.bincount(sent, w[ids], len(flat)), -30, 30)
        p, pb = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-b))
        clean = np.bincount(bag, np.log1p(-np.minimum(p, 1 - 1e-12)), len(y)) + plain * np.log1p(-pb)
        doc = np.clip(-np.expm1(clean), 1e-9, 1 - 1e-12)
        # d log L / d clean, through log(1 - exp(clean)) for toxic and clean itself for others
        up = weight * np.where(y == 1, -(1 - doc) / doc, 1.0)
        gz = -up[bag] * p
        g = np.append(np.bincount(ids, gz[sent], n), gz.sum() - (up * plain).sum() * pb)
        g = -g
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a column ``out`` in [0, 1]; whole texts, null and empty texts score 0."""

    @F.pandas_udf("double")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([model.document(t) for t in part], dtype="float64")

    return docs.withColumn(out, run(F.col(text_col)))


def classify(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``.

    A null id is not held out. Repeated rows score alike; extra columns of either table are not read; an empty table
    gives no rows and empty labels give score 0 throughout.
    """
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, **params))
    held = F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def offending_sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, end, probability): sentences at ``least`` or more, by code point offsets into the text."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for id_, text in zip(pdf["doc_id"], pdf["text"]):
                at = 0
                for m in [*SENTENCE.finditer(text or ""), None]:
                    end = m.start() if m else len(text or "")
                    p = model.sentence(LETTERS.findall((text or "")[at:end].lower())) if end > at else 0.0
                    if p >= least:
                        rows.append((id_, at, end, p))
                    at = m.end() if m else end
            yield pd.DataFrame(rows, columns=["doc_id", "start", "end", "probability"])

    return docs.where("doc_id is not null").select("doc_id", "text").mapInPandas(find, "doc_id long, start int, end int, probability double")


def drop_toxic(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """Rows of ``docs`` that score below 0.5, with all their columns.

    Each row is judged by its own text: null ids and repeated rows like any others, null and empty texts score 0 and stay.
    Without labels of both kinds all rows stay; an empty table stays empty.
    """
    out = fresh(docs, "toxicity")
    return score(docs, fit(docs, labels, **params), out=out).where(F.col(out) < 0.5).select(docs.columns)
