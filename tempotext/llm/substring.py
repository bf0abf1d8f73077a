"""Fuzzy repeated passages: shared k-mer seeds, collinear chains through a Fenwick tree, alignment of the chains."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import WORD, fresh, lower_words, number_rows, stage

#: Words of a seed; k-mers of a window of which the smallest hash is a seed; words of a passage; its share of equal words.
K, WINDOW, LEAST_WORDS, LEAST_IDENTITY = 5, 4, 50, 0.8
#: Window of the sparser seeds that runs are made of; below half of a passage's k-mers, so that a run has two seeds.
RUN_WINDOW = 20
#: Words at either end of a passage that may hold no seed.
SLACK = 21
#: No document: an id that none has.
NONE = -(1 << 63)
#: A seed that a sample of one document in SAMPLE holds HOT times or more is dealt to SALTS tasks; at most MOST_HOT of them.
SAMPLE, HOT, SALTS, MOST_HOT = 64, 16, 64, 20_000
#: Rows of one hash that a task holds to find the first of them.
MOST_HELD = 200_000
#: Words that a task makes seeds of in one go; a longer text is alone.
AT_ONCE = 200_000
#: Seeds further apart than this begin a new chain. A slice fetched for alignment begins and ends at multiples of GRID.
MAX_GAP, GRID = 60, 64
#: Cost of a word left out on one side: within chains of seeds, and in alignment, where a chain goes on as long as more than
#: 3 of 5 words equal; what is kept of it has LEAST_IDENTITY.
SEED_COST, ALIGN_COST = 0.1, 0.75
#: Words left out in a row that end a passage; words beyond the seeds at either end that alignment sees.
BREAK, PAD = 10, 45


class Hashes(dict):
    """XXH64 of words, remembered for the task's common words."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < 100_000:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(x: np.ndarray, window: int, best: np.ufunc) -> np.ndarray:
    """``best`` of every ``window`` values in a row, by doubling."""
    size = 1
    while 2 * size <= window:
        x = best(x[:-size], x[size:])
        size *= 2
    return best(x[: len(x) - (window - size)], x[window - size :]) if window > size else x


def kmers(h: np.ndarray) -> np.ndarray:
    """Hashes of K words in a row."""
    n = len(h) - K + 1
    mixed = np.zeros(n, np.uint64)
    for j in range(K):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    return mixed


def minimizers(mixed: np.ndarray, left: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the smallest of the ``window`` k-mers from each place on, whether they lie within one document).

    ``left``: k-mers from a place to the end of its document, itself included; of equal ones the first is smallest.
    """
    place, low = np.arange(len(mixed)), 0xFFFFFF  # the place goes to the low bits of the hash, modulo 2**24
    least = rolling((mixed & np.uint64(~low & (1 << 64) - 1)) | (place & low).astype(np.uint64), window, np.minimum)
    place = place[: len(least)]
    return place + ((least.view(np.int64) - place) & low), left[: len(least)] >= window


def seeds(mixed: np.ndarray, left: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Places of the minimizers: every ``window`` k-mers in a row of a document hold one at least."""
    own, whole = minimizers(mixed, left, window)
    own = own[whole]
    return own[np.append(True, own[1:] != own[:-1])] if len(own) else own


def frames(mixed: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, words from the first to the last seed, hash) of the runs of sparser seeds that LEAST_WORDS words alone determine.

    Equal stretches of LEAST_WORDS words have the same run, whatever is around them, and a text has at most two runs a seed.
    """
    inside = LEAST_WORDS - K - RUN_WINDOW + 2  # windows of k-mers that lie wholly in LEAST_WORDS words
    own, whole = minimizers(mixed, left, RUN_WINDOW)
    n = len(own) - inside + 1
    if n < 1:
        return (np.empty(0, np.int64),) * 3
    at = own[whole]
    at = at[np.append(True, at[1:] != at[:-1])] if len(at) else at
    ok = left[:n] >= RUN_WINDOW + inside - 1
    first, last = own[:n][ok], own[inside - 1 :][ok]
    new = np.append(True, (first[1:] != first[:-1]) | (last[1:] != last[:-1])) if len(first) else np.empty(0, bool)
    new &= first < last
    first, last = first[new], last[new]
    if not len(first):
        return (np.empty(0, np.int64),) * 3
    a, b = np.searchsorted(at, first), np.searchsorted(at, last)
    u = mixed[at]
    odd, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    up, down = np.full(len(at), odd, np.uint64), np.full(len(at), inverse, np.uint64)
    up[0] = down[0] = 1
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(u * np.cumprod(up), dtype=np.uint64)])
    span = last - first
    key = (total[b + 1] - total[a]) * np.cumprod(down)[a] + span.astype(np.uint64)
    key = (key ^ (key >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return first, span, (key ^ (key >> np.uint64(32))).view(np.int64)


def marks(docs: np.ndarray, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, position, span, hash) of the seeds, whose span is 0, and runs of some documents' word hashes together."""
    sizes = np.array([len(x) for x in texts])
    starts = np.cumsum(sizes) - sizes
    mixed = kmers(np.concatenate(texts))
    own = np.repeat(np.arange(len(texts)), sizes)[: len(mixed)]
    left = (starts + sizes)[own] - np.arange(len(mixed)) - K + 1
    one = seeds(mixed, left)
    two, span, key = frames(mixed, left)
    at = np.concatenate([one, two])
    doc = own[at]
    return docs[doc], at - starts[doc], np.append(np.zeros(len(one), np.int64), span), np.append(mixed[one].view(np.int64), key)


def chains(start: np.ndarray, other: np.ndarray, size: np.ndarray, cost: float, overlap: int) -> list[tuple[float, list[int]]]:
    """Disjoint chains of segments ``[start, start+size) ~ [other, other+size)``, best first.

    score(j) = size(j) + max(0, max over segments i that end before j on both sides (but for ``overlap`` words) of
    score(i) - cost * words between them on both sides). The gap cost splits into terms of i and of j, so a Fenwick tree
    of prefix maxima over the ends on the other side gives the best i. Segments enter the tree once the sweep over
    starts has passed their end.
    """
    n = len(start)
    order = np.lexsort((other, start)).tolist()
    ends, tails = start + size, other + size
    ranks = np.unique(tails)
    place = (np.searchsorted(ranks, tails) + 1).tolist()
    below = np.searchsorted(ranks, other + overlap, "right").tolist()
    start, other, size, end, tail = (x.tolist() for x in (start, other, size, ends, tails))
    top, none = len(ranks), float("-inf")
    tree_score, tree_seg = [none] * (top + 1), [-1] * (top + 1)
    score, back = [0.0] * n, [-1] * n
    waiting: list[tuple[int, int]] = []
    for j in order:
        s, o = start[j], other[j]
        while waiting and waiting[0][0] - overlap <= s:
            _, i = heapq.heappop(waiting)
            value, at = score[i] + cost * (end[i] + tail[i]), place[i]
            while at <= top:
                if value > tree_score[at]:
                    tree_score[at], tree_seg[at] = value, i
                at += at & -at
        best, seg, at = none, -1, below[j]
        while at > 0:
            if tree_score[at] > best:
                best, seg = tree_score[at], tree_seg[at]
            at -= at & -at
        gain = best - cost * (s + o)
        if seg >= 0 and s > start[seg] and o > other[seg]:
            over = max(0, end[seg] - s, tail[seg] - o)
            gain -= over + min(0, s - end[seg]) * cost + min(0, o - tail[seg]) * cost if over else 0
        else:
            seg = -1
        better = seg >= 0 and gain > 0
        score[j] = size[j] + (gain if better else 0)
        back[j] = seg if better else -1
        heapq.heappush(waiting, (end[j], j))
    out, used = [], [False] * n
    for j in sorted(range(n), key=lambda j: -score[j]):
        path, k = [], j
        while k >= 0 and not used[k]:
            used[k] = True
            path.append(k)
            k = back[k]
        if path:
            out.append((score[j] - (score[k] if k >= 0 else 0), path[::-1]))
    return out


def segments(pair: np.ndarray, pos: np.ndarray, apos: np.ndarray, size: int, gap: int) -> tuple[np.ndarray, ...]:
    """Runs of matches of a pair on one diagonal with at most ``gap`` words between: pair, start, start on the other side, words spanned."""
    order = np.lexsort((pos, pos - apos, pair))
    pair, pos, apos = pair[order], pos[order], apos[order]
    cut = np.ones(len(pos), bool)
    cut[1:] = (pair[1:] != pair[:-1]) | (np.diff(pos - apos) != 0) | (np.diff(pos) > size + gap)
    first = np.nonzero(cut)[0]
    last = np.append(first[1:], len(pos)) - 1
    return pair[first], pos[first], apos[first], pos[last] + size - pos[first]


def candidates(m: np.ndarray) -> np.ndarray:
    """Rows (document, other document, start, end, other start, other end, lowest and highest diagonal) of the chains of seeds.

    ``m``: rows (document, other document, position, other position) in order. Pairs of one segment need no chaining.
    """
    new = np.append(True, (m[1:, :2] != m[:-1, :2]).any(1))
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(m)) - 1
    wide = m[last, 2] - m[first, 2] >= K  # two seeds at least
    pair = np.cumsum(new) - 1
    kept = wide[pair]
    if not kept.any():
        return np.empty((0, 8), np.int64)
    pair, start, other, size = segments(pair[kept], m[kept, 2], m[kept, 3], K, SLACK - K)
    edge = np.append(np.nonzero(np.append(True, pair[1:] != pair[:-1]))[0], len(pair))
    count = np.diff(edge)
    least = LEAST_WORDS - 2 * SLACK
    one = edge[:-1][count == 1]
    one = one[(size[one] > 2 * K) & (size[one] >= least)]
    diag = start - other
    out = [np.stack([start[one], start[one] + size[one], other[one], other[one] + size[one], diag[one], diag[one]], 1)]
    whose = [pair[one]]
    more = []
    for a, b in zip(edge[:-1][count > 1], edge[1:][count > 1]):
        s, o, z, d = start[a:b], other[a:b], size[a:b], diag[a:b]
        for _, path in chains(s, o, z, SEED_COST, K):
            if len(path) == 1 and z[path[0]] <= 2 * K:
                continue
            for part in np.split(np.array(path), np.nonzero(s[path[1:]] - (s + z)[path[:-1]] > MAX_GAP)[0] + 1) if len(path) > 1 else [np.array(path)]:
                i, j = part[0], part[-1]
                if s[j] + z[j] - s[i] >= least and (z[part].sum() > 2 * K or len(part) > 1):
                    more.append((s[i], s[j] + z[j], o[i], o[j] + z[j], d[part].min(), d[part].max()))
                    whose.append(pair[a : a + 1])
    rows = np.concatenate([out[0], np.array(more, np.int64).reshape(-1, 6)])
    return np.concatenate([m[first[np.concatenate(whose)], :2], rows], 1)


def stretches(size: np.ndarray, gap: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, last) of the longest runs of a chain that keep LEAST_IDENTITY over LEAST_WORDS words, longest first.

    ``size``: equal words of each run, ``gap``: words left out before it. What is left of the chain on either side of a stretch
    is searched on its own. The longest comes from the prefix minima of equal words less LEAST_IDENTITY of all.
    """
    todo = [(0, len(size))]
    while todo:
        a, b = todo.pop()
        if b <= a:
            continue
        words = size[a:b] + np.append(0, gap[a + 1 : b])
        up = np.append(0, np.cumsum(words))
        if up[-1] < LEAST_WORDS:
            continue
        gain = np.append(0, np.cumsum(size[a:b] - LEAST_IDENTITY * words))
        # before run k: its own gap does not count where a stretch begins with it
        start = gain[:-1] - LEAST_IDENTITY * np.append(0, gap[a + 1 : b])
        low = np.minimum.accumulate(start)
        begin = np.searchsorted(-low, -(gain[1:] + 1e-9))  # the first run from which the share holds up to each run
        begin = np.minimum(begin, np.arange(b - a))
        length = up[1:] - up[begin] - np.append(0, gap[a + 1 : b])[begin]
        length[gain[1:] - start[begin] < -1e-9] = 0
        k = int(length.argmax())
        if length[k] < LEAST_WORDS:
            continue
        first, last = a + int(begin[k]), a + k
        yield first, last
        todo += [(a, first), (last + 1, b)]


def uncovered(m: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Rows (document, ..., position, ...) of ``m`` whose seed does not lie in a stretch (document, ..., start, end) of ``known``; both in order."""
    docs = np.unique(known[:, 0])
    base = np.searchsorted(docs, known[:, 0])
    wide = int(max(known[:, 3].max(), m[:, 2].max(initial=0) + K)) + 1
    start, end = base * wide + known[:, 2], base * wide + known[:, 3]
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    at = np.searchsorted(docs, m[:, 0])
    has = docs[np.minimum(at, len(docs) - 1)] == m[:, 0]
    place = at * wide + m[:, 2]
    k = np.searchsorted(start, place, "right") - 1
    inside = has & (k >= 0) & (reach[np.maximum(k, 0)] >= place + K)
    return m[~inside]


def align(x: np.ndarray, y: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int, int, float]]:
    """Passages (start, end, other start, other end, share of equal words) of two word sequences in a band of diagonals.

    Runs of equal words on each diagonal are chained, single words only on diagonals that have longer runs. No chain ends in words that
    cost more than they give; it is cut where BREAK words or more are left out, and the longest stretches with LEAST_IDENTITY are kept.
    """
    starts, others, sizes = [], [], []
    for d in range(low, high + 1):
        a, b = max(0, d), max(0, -d)
        n = min(len(x) - a, len(y) - b)
        if n < 2:
            continue
        same = np.concatenate([[False], x[a : a + n] == y[b : b + n], [False]])
        edge = np.nonzero(same[1:] != same[:-1])[0]
        s, e = edge[::2], edge[1::2]
        size = e - s
        if not len(size) or size.max() < 3:
            keep = size >= 2
        else:  # single words within reach of a longer run of their diagonal
            long_ = np.nonzero(size >= 2)[0]
            after = np.append(s[long_], 1 << 40)[np.searchsorted(long_, np.arange(len(s)))] - e
            before = s - np.append(-(1 << 40), e[long_])[np.searchsorted(long_, np.arange(len(s)), "right")]
            keep = (size >= 2) | (np.minimum(after, before) < BREAK)
        starts.append(s[keep] + a)
        others.append(s[keep] + b)
        sizes.append(size[keep])
    if not starts or not sum(map(len, starts)):
        return
    start, other, size = np.concatenate(starts), np.concatenate(others), np.concatenate(sizes)
    for score, path in chains(start, other, size, ALIGN_COST, 0):
        path = np.array(path)
        s, t, z = start[path], other[path], size[path]
        gap = np.append(0, np.maximum(s[1:] - (s + z)[:-1], t[1:] - (t + z)[:-1]))
        for part in np.split(np.arange(len(path)), np.nonzero(gap >= BREAK)[0]):
            for i, j in stretches(z[part], gap[part]):
                i, j = part[i], part[j]
                a, b, c, d = int(s[i]), int(s[j] + z[j]), int(t[i]), int(t[j] + z[j])
                if b - a >= LEAST_WORDS:
                    yield a, b, c, d, float(z[i : j + 1].sum()) / max(b - a, d - c)


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start_word, end_word, first_doc, first_start, first_end, identity): passages that an earlier document holds.

    A passage has LEAST_WORDS words or more of which LEAST_IDENTITY or more equal those of a document with a smaller
    id, in order; ends are exclusive, words are as in ``common.WORD`` with A-Z lowered. There are two rounds. In the first, each seed
    is joined to its first occurrence (smallest id) only, so a passage in m documents gives m-1 candidates and copies are never
    paired with each other; so is each run of seeds in LEAST_WORDS words, hence a passage whose pieces occur singly in
    earlier documents meets the first document that holds LEAST_WORDS words of it in a row. In the second, the seeds that no
    passage of the first covers are joined to the document that holds them just before, so of fuzzy copies whose pieces have other first
    holders the later still meets the earlier; one that has such pieces in documents on both sides of the earlier copy is missed.
    Very frequent seeds are dealt to SALTS classes of ids; they are joined to the first of their class, and those firsts
    to the first of all; the document before is that of the class.

    Rows with a null id or fewer words have none; rows that repeat an id are one document; other columns
    are not read. The first document of a passage is not reported. An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text")).where("doc is not null and text is not null")

    def salt(doc: np.ndarray) -> np.ndarray:
        return ((doc % SALTS) + 1) * 0x9E3779B97F4A7C1

    def find(batches: Iterator[pd.DataFrame], hot: np.ndarray = np.empty(0, np.int64)) -> Iterator[pd.DataFrame]:
        hashes, held, ids, size = Hashes(), [], [], 0

        def made() -> pd.DataFrame:
            doc, at, span, h = marks(np.array(ids, np.int64), held)
            often = np.isin(h, hot)
            return pd.DataFrame({"h": np.where(often, h ^ salt(doc), h), "doc": doc, "at": at << 7 | often << 6 | span})

        for pdf in batches:
            for doc, text in zip(pdf["doc"], pdf["text"]):
                words = lower_words(text)
                if len(words) >= LEAST_WORDS:
                    if held and size + len(words) > AT_ONCE:
                        yield made()
                        held, ids, size = [], [], 0
                    held.append(hashes.of(words))
                    ids.append(doc)
                    size += len(words)
        if held:
            yield made()

    names = ["doc", "anchor", "pos", "apos", "h", "prior", "ppos"]

    def resolve(m: np.ndarray, part: bool = False) -> pd.DataFrame:
        """Links of the rows (h, doc, at) of whole groups to the first of their group, as rows of ``names``.

        A seed's link also names the document before it in its group, if that is another. The first rows of groups
        of frequent hashes, or of a ``part`` of a group, come with ``h`` and their ``at`` as well.
        """
        new = np.append(True, m[1:, 0] != m[:-1, 0])[: len(m)]
        group = np.cumsum(new) - 1
        shared = (np.bincount(group, minlength=1)[group] > 1) | (m[:, 2] >> 6 & 1 != 0) | part if len(m) else np.empty(0, bool)
        m, group = m[shared], group[shared]
        order = np.lexsort((m[:, 2], m[:, 1], group))
        m, group = m[order], group[order]
        head_of = np.append(True, group[1:] != group[:-1])[: len(group)]
        first = np.nonzero(head_of)[0]
        to = m[np.repeat(first, np.diff(np.append(first, len(group))))] if len(group) else m
        often = m[first][:, 2] >> 6 & 1 != 0
        head = m[first][often | part]
        h = np.where(often, m[first][:, 0] ^ salt(m[first][:, 1]), m[first][:, 0])[often | part]
        # the row before a document's first row in a group is of the document before it
        own = np.maximum.accumulate(np.where(head_of | np.append(True, m[1:, 1] != m[:-1, 1])[: len(m)], np.arange(len(m)), 0)) if len(m) else first
        prior = m[np.maximum(own - 1, 0)]
        k = m[:, 1] != to[:, 1]
        m, to, prior = m[k], to[k], prior[k]
        span, pos, apos = m[:, 2] & 63, m[:, 2] >> 7, to[:, 2] >> 7
        run = span > 0  # a run gives its first and its last seed
        more = ~run & (prior[:, 1] != to[:, 1])
        none = 0 * head[:, 0]
        before, at = np.where(more, prior[:, 1], NONE), np.where(more, prior[:, 2] >> 7, 0)
        parts = ((m[:, 1], m[run, 1], head[:, 1]), (to[:, 1], to[run, 1], none), (pos, (pos + span)[run], head[:, 2]), (apos, (apos + span)[run], none), (0 * pos, 0 * pos[run], h), (before, before[run], none + NONE), (at, at[run], none))
        return pd.DataFrame(dict(zip(names, map(np.concatenate, parts))))

    most = MOST_HELD

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Links to the first row of each ``h``; a group of more than MOST_HELD rows is resolved in parts of that size."""
        held, parted = np.empty((0, 3), np.int64), False
        for pdf in batches:
            held = np.concatenate([held, np.stack([pdf[c].to_numpy(np.int64) for c in ("h", "doc", "at")], 1)])
            if not len(held):
                continue
            last = int(np.argmax(held[:, 0] == held[-1, 0]))  # where the last group begins: equal hashes come together
            if last:
                if parted:
                    end = int(np.argmax(held[:, 0] != held[0, 0]))
                    yield resolve(held[:end], True)
                    held, last, parted = held[end:], last - end, False
                yield resolve(held[:last])
                held = held[last:]
            if len(held) > most:
                yield resolve(held, True)
                held, parted = held[:0], True
        yield resolve(held, parted)

    # seeds of one document only are the most by far: they are shuffled once, never staged
    typed = "h long, doc long, at long"
    some = rows.where(F.pmod(F.xxhash64("doc"), F.lit(SAMPLE)) == 0).mapInPandas(find, typed)
    common = some.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= HOT).orderBy(F.desc("n")).limit(MOST_HOT).select("h").collect()
    hot = docs.sparkSession.sparkContext.broadcast(np.array(sorted(r["h"] for r in common), np.int64))
    found = rows.mapInPandas(lambda batches: find(batches, hot.value), typed)
    # one sort column of eight bytes: Spark sorts it by radix
    met = found.repartition("h").sortWithinPartitions("h").mapInPandas(meet, "doc long, anchor long, pos long, apos long, h long, prior long, ppos long")
    met = stage(met, "links")
    found = met.where("h = 0").drop("h", "prior", "ppos")
    # the firsts of a hash's salts or parts, few for any number of rows, link to the first of all
    firsts = met.where("h <> 0").groupBy("h").agg(F.array_sort(F.collect_list(F.struct("doc", "pos"))).alias("all"))
    firsts = firsts.select(F.get("all", F.lit(0)).alias("to"), F.explode(F.slice("all", 2, 1 << 30)).alias("x")).where("x.doc <> to.doc")
    at = lambda x, last: (F.shiftright(x, 7) + (F.col("x.pos").bitwiseAND(63) if last else 0)).alias("p" if x == "x.pos" else "q")
    for last in (False, True):
        some = firsts.where(F.col("x.pos").bitwiseAND(63) > 0) if last else firsts
        found = found.union(some.select("x.doc", F.col("to.doc").alias("anchor"), at("x.pos", last), at("to.pos", last)))

    one = stage(_aligned(rows, found), "passages")
    # covered stretches travel as links of anchor NONE
    covered = one.select(F.col("doc_id").alias("doc"), F.lit(NONE).alias("anchor"), F.col("start_word").alias("pos"), F.col("end_word").alias("apos"))
    rest = met.where(F.col("prior") != NONE).select("doc", F.col("prior").alias("anchor"), "pos", F.col("ppos").alias("apos"))
    return one.unionByName(_aligned(rows, rest.unionByName(covered)))


def _aligned(rows: DataFrame, links: DataFrame) -> DataFrame:
    """The passages of ``rows`` (doc, text) in the chains of ``links`` (doc, anchor, pos, apos).

    A link of anchor NONE says that [pos, apos) of its document is known: links of seeds in it are left out.
    """

    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc", "anchor", "s", "e", "t", "u", "low", "high"]

        def groups(m: np.ndarray) -> pd.DataFrame:
            known = m[:, 1] == NONE
            if known.any():
                m = uncovered(m[~known], m[known])
            return pd.DataFrame(candidates(m) if len(m) else np.empty((0, 8), np.int64), columns=names)

        held = np.empty((0, 4), np.int64)
        for pdf in batches:
            held = np.concatenate([held, pdf[["doc", "anchor", "pos", "apos"]].to_numpy(np.int64)])
            whole = int(np.searchsorted(held[:, 0], held[-1, 0])) if len(held) else 0
            if whole:
                yield groups(held[:whole])
                held = held[whole:]
        if len(held):
            yield groups(held)

    dealt = links.repartition("doc").sortWithinPartitions("doc", "anchor", "pos", "apos")
    spans = dealt.mapInPandas(chain, "doc long, anchor long, s long, e long, t long, u long, low long, high long")
    down = lambda c: F.greatest(F.lit(0), F.floor((F.col(c) - PAD) / GRID) * GRID).cast("long")
    up = lambda c: (F.ceil((F.col(c) + PAD) / GRID) * GRID).cast("long")
    spans = spans.select("doc", "anchor", "low", "high", down("s").alias("s"), up("e").alias("e"), down("t").alias("t"), up("u").alias("u"))
    spans = stage(spans.distinct(), "spans")
    asked = spans.select("doc", "s", "e").union(spans.select("anchor", "t", "u")).distinct()
    asked = asked.groupBy("doc").agg(F.collect_set(F.struct("s", "e")).alias("asked"))  # bounded by the document's length

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = Hashes()
        for pdf in batches:
            out = []
            for doc, text, wanted in zip(pdf["doc"], pdf["text"], pdf["asked"]):
                h = (hashes.of(lower_words(text)) & np.uint64(0x7FFFFFFF)).astype(np.int32)
                out += [(doc, x["s"], x["e"], h[x["s"] : x["e"]].tobytes()) for x in wanted]
            yield pd.DataFrame(out, columns=["doc", "s", "e", "words"])

    # none of these tables has a bound, so none is broadcast, however small it is now
    slices = rows.join(asked.hint("merge"), "doc").mapInPandas(cut, "doc long, s long, e long, words binary")
    slices = stage(slices.dropDuplicates(["doc", "s", "e"]), "slices")
    theirs = slices.select(F.col("doc").alias("anchor"), F.col("s").alias("t"), F.col("e").alias("u"), F.col("words").alias("theirs"))
    pairs = spans.join(slices.hint("merge"), ["doc", "s", "e"]).join(theirs.hint("merge"), ["anchor", "t", "u"])

    def refine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "start_word", "end_word", "first_doc", "first_start", "first_end", "identity"]
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                shift = r.s - r.t
                for s, e, t, u, share in align(np.frombuffer(r.words, np.int32), np.frombuffer(r.theirs, np.int32), r.low - shift - 3, r.high - shift + 3):
                    out.append((r.doc, s + r.s, e + r.s, r.anchor, t + r.t, u + r.t, share))
            yield pd.DataFrame(out, columns=names)

    return pairs.mapInPandas(refine, "doc_id long, start_word long, end_word long, first_doc long, first_start long, first_end long, identity double").distinct()


def cut_passages(docs: DataFrame) -> DataFrame:
    """``docs`` without the passages that an earlier document holds; white space around what stays is kept.

    A document of which no word stays goes; ``n_chars`` becomes the length of the new text. All other rows are as they were.
    Rows of null and of repeated ids are documents of their own that come after all others.
    """
    rows, row = number_rows(docs)
    own, new = fresh(rows, "spans"), fresh(rows, "new")
    spans = passages(rows, id_col=row).groupBy(F.col("doc_id").alias(row)).agg(F.collect_list(F.struct("start_word", "end_word")).alias(own))
    word = re.compile(WORD)

    @F.pandas_udf("string")
    def rest(texts: pd.Series, spans: pd.Series) -> pd.Series:
        def one(text: str, own) -> str | None:
            if own is None:
                return text
            ends = [m.span() for m in word.finditer(text)]
            out, at = [], 0
            for s, e in sorted((x["start_word"], x["end_word"]) for x in own):
                if ends[s][0] > at:
                    out.append(text[at : ends[s][0]])
                at = max(at, ends[e - 1][1])
            out.append(text[at:])
            new = "".join(out)
            return new if word.search(new) else None

        return pd.Series([one(t, s) for t, s in zip(texts, spans)], dtype="object")

    joined = rows.join(stage(spans, "cuts").hint("merge"), row, "left")
    rest = rest.asNondeterministic()  # so that the filter below does not run it a second time
    cut = F.when(F.col(own).isNull(), F.col("text")).otherwise(rest(F.coalesce("text", F.lit("")), F.col(own)))
    out = joined.withColumn(new, cut).where(F.col(new).isNotNull() | F.col("text").isNull())
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(own).isNull(), F.col("n_chars")).otherwise(F.length(new).cast("long")))
    return out.withColumn("text", F.col(new)).select(docs.columns)
