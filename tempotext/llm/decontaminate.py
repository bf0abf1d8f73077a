"""Benchmark decontamination: a BM25 index of test items searched with block-max WAND by every passage of the corpus."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import number_rows, stage

K1, B = 1.2, 0.75
#: Share of an item's score for itself that a passage must reach, then shares of its word 5-grams that must be there.
LEAST_SCORE, LEAST_OVERLAP, LEAST_PART = 0.65, 0.8, 0.6
SHINGLE = 5
#: Lists keep a maximum for each block of items; an index has this many blocks at most.
BLOCKS = 1024
#: Share of an item's score that words common among the items may give together.
COMMON = 0.3
#: Items and characters of one index, which every task holds; more items make more indexes, searched one after the other.
INDEX_ITEMS, INDEX_CHARS = 50_000, 64_000_000


def bare(word: str) -> str:
    """A word without the marks at its ends."""
    a, b = 0, len(word)
    while a < b and not word[a].isalnum():
        a += 1
    while a < b and not word[b - 1].isalnum():
        b -= 1
    return word[a:b]


def tokens(text: str | None) -> list[str]:
    return [w for w in map(bare, text.lower().split()) if w] if text else []


class Terms(dict):
    """Term numbers of words as they stand in texts, remembered; ``none`` for words of no item, -1 for mere marks."""

    def __init__(self, term: dict[str, int]) -> None:
        super().__init__()
        self.term = term

    def __missing__(self, word: str) -> int:
        own = bare(word)
        k = self.term.get(own, len(self.term)) if own else -1
        if len(self) < 500_000:
            self[word] = k
        return k


@dataclass
class Index:
    """Inverted lists of the items; impacts are BM25 shares of an item's own score, so one threshold serves all items."""

    ids: list[int] = field(default_factory=list)
    words: list[list[str]] = field(default_factory=list)
    term: dict[str, int] = field(default_factory=dict)
    items: list[np.ndarray] = field(default_factory=list)
    impact: list[np.ndarray] = field(default_factory=list)
    block: list[np.ndarray] = field(default_factory=list)
    block_max: list[np.ndarray] = field(default_factory=list)
    most: np.ndarray = field(default_factory=lambda: np.zeros(1))
    begin: np.ndarray | None = None
    flat_block: np.ndarray | None = None
    flat_max: np.ndarray | None = None
    rare: np.ndarray | None = None
    common: float = 0.0
    longest: int = 1
    width: int = 1

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "of"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.of = Terms(self.term)

    @classmethod
    def build(cls, rows: list[tuple[int, str]]) -> "Index":
        ix = cls()
        for id_, text in rows:
            if words := tokens(text):
                ix.ids.append(id_)
                ix.words.append(words)
        n = len(ix.ids)
        if not n:
            return ix
        ix.width = -(-n // BLOCKS)
        counts = [Counter(w) for w in ix.words]
        df = Counter(t for c in counts for t in c)
        mean = sum(map(len, ix.words)) / n
        lists: dict[str, list[tuple[int, float]]] = {}
        for k, c in enumerate(counts):
            norm = K1 * (1 - B + B * len(ix.words[k]) / mean)
            own = {t: np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * f * (K1 + 1) / (f + norm) for t, f in c.items()}
            total = sum(own.values())
            for t, x in own.items():
                lists.setdefault(t, []).append((k, x / total))
        for t, posts in lists.items():
            ix.term[t] = len(ix.items)
            ix.items.append(np.array([k for k, _ in posts]))
            ix.impact.append(np.array([x for _, x in posts]))
            blocks, first = np.unique(ix.items[-1] // ix.width, return_index=True)
            ix.block.append(blocks)
            ix.block_max.append(np.maximum.reduceat(ix.impact[-1], first))
        ix.most = np.append([x.max() for x in ix.impact], 0.0)  # the last is for words of no item
        ix.longest = max(map(len, ix.words))
        # a passage that reaches the threshold has LEAST_SCORE less what all of an item's common words can give in rare ones
        shares = np.zeros(n)
        limit = np.array([df[t] for t in lists])
        for most_items in np.unique(limit)[::-1]:
            more = shares.copy()
            for t in np.nonzero(limit == most_items)[0]:
                more[ix.items[t]] += ix.impact[t]
            if more.max() > COMMON:
                break
            shares = more
            limit[limit == most_items] = -1
        ix.common = float(shares.max())
        # blocks and maxima of all lists, end to end; those of rare words come first in each passage's bound
        ix.rare = np.append(limit >= 0, False)
        ix.begin = np.append(0, np.cumsum([len(b) for b in ix.block] + [0]))
        ix.flat_block, ix.flat_max = np.concatenate(ix.block), np.concatenate(ix.block_max)
        ix.of = Terms(ix.term)
        return ix

    def search(self, terms: list[int], least: float) -> list[tuple[int, float]]:
        """All items at ``least`` or more for a set of terms, by block-max WAND.

        Cursors are kept in item order. The pivot is the first item at which the lists' maxima reach the threshold;
        if the maxima of the current blocks don't, all lists before it skip to the end of the nearest block.
        """
        at = {t: 0 for t in terms}
        live, out = list(terms), []
        while live:
            live.sort(key=lambda t: self.items[t][at[t]])
            total, pivot = 0.0, None
            for k, t in enumerate(live):
                total += self.most[t]
                if total >= least - 1e-12:
                    pivot = k
                    break
            if pivot is None:
                return out
            item = self.items[live[pivot]][at[live[pivot]]]
            while pivot + 1 < len(live) and self.items[live[pivot + 1]][at[live[pivot + 1]]] == item:
                pivot += 1
            head = live[: pivot + 1]
            place = {t: at[t] + int(np.searchsorted(self.items[t][at[t] :], item)) for t in head}
            own, bound = item // self.width, 0.0
            for t in head:
                k = int(np.searchsorted(self.block[t], own))
                if k < len(self.block[t]) and self.block[t][k] == own:
                    bound += self.block_max[t][k]
            if bound >= least - 1e-12:
                score = sum(self.impact[t][place[t]] for t in head if place[t] < len(self.items[t]) and self.items[t][place[t]] == item)
                if score >= least - 1e-12:
                    out.append((int(item), float(score)))
                skip = item + 1
            else:
                skip = (own + 1) * self.width
                if pivot + 1 < len(live):
                    skip = min(skip, self.items[live[pivot + 1]][at[live[pivot + 1]]])
                skip = max(skip, item + 1)
            for t in head:
                at[t] += int(np.searchsorted(self.items[t][at[t] :], skip))
            live = [t for t in live if at[t] < len(self.items[t])]
        return out

    def overlap(self, k: int, words: list[str]) -> tuple[float, float, float]:
        """Shares of item k's 5-grams found among ``words``: of all, of the question's, of the answer's.

        The answer is the last quarter of the item (8 words at least); a 5-gram that ends in it is the answer's.
        """
        own = self.words[k]
        size = min(SHINGLE, len(own))
        have = {tuple(words[i : i + size]) for i in range(len(words) - size + 1)}
        hit = np.array([tuple(own[i : i + size]) in have for i in range(len(own) - size + 1)], float)
        answer = max(8, len(own) // 4)
        cut = max(0, len(hit) - answer)
        return hit.mean(), hit[:cut].mean() if cut else 1.0, hit[cut:].mean()

    def bounds(self, terms: np.ndarray, part: np.ndarray, parts: int) -> np.ndarray:
        """Sums of the terms' maxima by part and block of items."""
        sizes = self.begin[terms + 1] - self.begin[terms]
        flat = np.repeat(self.begin[terms] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        blocks = (len(self.ids) - 1) // self.width + 1
        return np.bincount(np.repeat(part, sizes) * blocks + self.flat_block[flat], self.flat_max[flat], parts * blocks).reshape(parts, blocks)

    def leaks(self, text: str | None) -> Iterator[tuple[int, int, float, float]]:
        """(item id, first word of the passage, score, overlap) for the items a text holds, by passages of twice the longest item.

        A passage whose rare words' block maxima add up to less than they must give in every block is not searched further.
        """
        if not text or not self.ids:
            return
        raw, none = text.lower().split(), len(self.items)
        ids = np.fromiter(map(self.of.__getitem__, raw), np.int64, len(raw))
        ids = ids[ids >= 0]
        if not len(ids):
            return
        words: list[str] = []
        step, least = self.longest, LEAST_SCORE - self.common - 1e-9
        parts = -(-len(ids) // step)
        # sums of block maxima of the rare words, each once in a stretch of ``step`` words
        spot = np.nonzero(self.rare[ids])[0]
        spot = np.unique(spot // step * (none + 1) + ids[spot])
        sums = self.bounds(spot % (none + 1), spot // (none + 1), parts + 1)
        reach = (sums[:-1] + sums[1:]).max(1)
        best: dict[int, tuple[int, float, float]] = {}
        for a in range(0, len(ids), step):
            b = min(a + 2 * step, len(ids))
            if reach[a // step] >= least:
                terms = np.unique(ids[a:b])
                terms = terms[terms < none]
                if self.bounds(terms, np.zeros_like(terms), 1).max() >= LEAST_SCORE - 1e-9:
                    for k, score in self.search(terms.tolist(), LEAST_SCORE):
                        words = words or tokens(text)
                        total, question, answer = self.overlap(k, words[a:b])
                        if total >= LEAST_OVERLAP and question >= LEAST_PART and answer >= LEAST_PART and total > best.get(k, (0, 0, 0))[2]:
                            best[k] = (a, score, total)
            if b == len(ids):
                break
        for k, (a, score, total) in best.items():
            yield self.ids[k], a, score, total


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, first_word, score, overlap): the test items that each document holds, none for clean ones.

    Every passage of every text is a query. Items are indexed in blocks of bounded size, so any number of them is
    searched. Null or wordless items match nothing, null or empty texts hold nothing; documents without id are searched
    and come with a null doc_id. Repeated rows give repeated leaks, items with equal texts are all reported. Extra
    columns are not read.
    """
    items = benchmark.select("item_id", "text").where("item_id is not null and text is not null")
    n, chars = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-n // INDEX_ITEMS), -(-chars // INDEX_CHARS))
    out = None
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        index = Index.build([tuple(r) for r in part.orderBy("item_id").collect()])

        def search(batches: Iterator[pd.DataFrame], index: Index = index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(id_, *x) for id_, text in zip(pdf["doc_id"], pdf["text"]) for x in index.leaks(text)]
                out = pd.DataFrame(rows, columns=["doc_id", "item_id", "first_word", "score", "overlap"])
                yield out.astype({"doc_id": "Int64"})

        found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(search, "doc_id long, item_id long, first_word int, score double, overlap double")
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` that hold no test item, with all their columns.

    Rows of null and of repeated ids are judged one by one. An empty benchmark keeps all rows.
    """
    rows, row = number_rows(docs)
    held = stage(leaks(rows, benchmark, id_col=row).select(F.col("doc_id").alias(row)).distinct(), "leaks")
    return rows.join(held, row, "left_anti").select(docs.columns)
