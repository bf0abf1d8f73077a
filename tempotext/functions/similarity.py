"""Similarity of texts and vectors, as columns over candidate pairs. Cheap native tests come before Python ones."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from .blocks import matched_ratio, matching, reaches
from .text import normalize_text, punct_key


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit of an integer for each character of ``a``."""
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    open_, mask = (1 << len(a)) - 1, (1 << len(a)) - 1
    for y in b:
        hit = open_ & where.get(y, 0)
        open_ = (open_ + hit | open_ - hit) & mask
    return len(a) - open_.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * common_length(a, b) / (len(a) + len(b)) if a or b else 100.0


def _alike_to(a: str, i: int, b: str, j: int, most: int, step: int = 1) -> int:
    """Equal characters, ``most`` at most, of ``a`` from ``i`` and ``b`` from ``j`` on, or before them with a step of -1; slices that double are compared."""
    part = (lambda x, at, k, n: x[at + k : at + k + n]) if step > 0 else (lambda x, at, k, n: x[at - k - n : at - k])
    done, n = 0, 16
    while n and done < most:
        n = min(n, most - done)
        if part(a, i, done, n) == part(b, j, done, n):
            done, n = done + n, 2 * n
        elif n == 1:
            break
        else:
            n //= 2
    return done


def ratio_reaches(a: str, b: str, least: float) -> bool:
    """Whether ``ratio`` is ``least`` or more. Lengths and counts of characters, which bound it, come first; equal ends are cut off,
    and the search ends as soon as the rest can't change the answer."""
    both = len(a) + len(b)
    if not both:
        return 100.0 >= least
    need = max(0, int(least * both / 200) - 1)
    while 200.0 * need / both < least:
        need += 1
    if len(a) < len(b):
        a, b = b, a
    if len(b) < need or (Counter(a) & Counter(b)).total() < need:
        return False
    head = _alike_to(a, 0, b, 0, len(b))
    tail = _alike_to(a, len(a), b, len(b), len(b) - head, -1)
    need -= head + tail
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    where: dict[str, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    open_ = mask = (1 << len(a)) - 1
    for k in range(0, len(b), 64):
        done = len(a) - open_.bit_count()
        if done >= need or done + len(b) - k < need:
            break
        for y in b[k : k + 64]:
            hit = open_ & where.get(y, 0)
            open_ = (open_ + hit | open_ - hit) & mask
    return len(a) - open_.bit_count() >= need


@F.pandas_udf(DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Matching blocks ratio 0-1; the order of arguments matters."""
    return pd.Series([matched_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def default_ratio(a: str, b: str) -> float:
    """As ``SequenceMatcher(None, a, b).ratio()``; only characters that may begin a match are looked up, so work follows the rare ones of a long ``b``."""
    n = len(b)
    if n < 200:
        return matched_ratio(a, b)
    rare = "".join(re.escape(x) for x, k in Counter(b).items() if k <= n // 100 + 1)
    find = re.compile(f"[{rare}]", re.S).finditer if rare else lambda x: iter(())
    where: dict[str, list[int]] = {}
    for m in find(b):
        where.setdefault(m.group(), []).append(m.start())
    places = [m.start() for m in find(a)]
    todo, total = [(0, len(a), 0, n)], 0
    while todo:
        a0, a1, b0, b1 = todo.pop()
        at, to, size, last, prior = a0, b0, 0, -2, {}
        for i in places[bisect_left(places, a0) : bisect_left(places, a1)]:
            here, prior = {}, prior if i == last + 1 else {}
            hits = where[a[i]]
            for j in hits[bisect_left(hits, b0) :]:
                if j >= b1:
                    break
                k = here[j] = prior.get(j - 1, 0) + 1
                if k > size:
                    at, to, size = i - k + 1, j - k + 1, k
            prior, last = here, i
        back = _alike_to(a, at, b, to, min(at - a0, to - b0), -1)
        at, to, size = at - back, to - back, size + back
        size += _alike_to(a, at + size, b, to + size, min(a1 - at, b1 - to) - size)
        if size:
            total += size
            if a0 < at and b0 < to:
                todo.append((a0, at, b0, to))
            if at + size < a1 and to + size < b1:
                todo.append((at + size, a1, to + size, b1))
    return 2.0 * total / (len(a) + n)


@F.pandas_udf(DoubleType())
def default_matcher_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """As ``matcher_ratio``, but characters that make up more than one in a hundred of a ``b`` of 200 or more begin no match."""
    return pd.Series([default_ratio(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="float64")


def matches(a: str, b: str, least: float) -> bool:
    """Matching blocks ratio of ``least`` or more; its upper bounds, by lengths and by counts of characters, come first."""
    if not a or not b or 2 * min(len(a), len(b)) < least * (len(a) + len(b)):
        return False
    return SequenceMatcher(None, a, b, autojunk=False).quick_ratio() >= least and reaches(a, b, least)


def contains(a: str, b: str, least: int = 4, share: float = 0.30) -> bool:
    small, large = sorted((a, b), key=len)
    return len(small) >= least and small in large and len(small) / len(large) >= share


def text_contains(a: Column, b: Column, least: int = 4, share: float = 0.30) -> Column:
    small, large = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return (small >= least) & (small >= large * share) & F.when(F.length(a) <= F.length(b), F.contains(b, a)).otherwise(F.contains(a, b))


def _overlap(x: str, y: str) -> int:
    """Length of the longest end of ``x`` that begins ``y``, by the prefix function of ``y`` read over ``x``: linear."""
    n = min(len(x), len(y))
    y, x = y[:n], x[len(x) - n :]
    back, k = [0] * n, 0
    for i in range(1, n):
        while k and y[i] != y[k]:
            k = back[k - 1]
        k += y[i] == y[k]
        back[i] = k
    k = 0
    for ch in x:
        while k and (k == n or ch != y[k]):
            k = back[k - 1]
        k += k < n and ch == y[k]
    return k


def joined(a: str, b: str, least: int = 4, share: float = 0.30) -> str | None:
    """``a`` with the rest of ``b`` at their longest overlap, line ends left out; None if too short."""
    x, y = a.replace("\n", ""), b.replace("\n", "")
    n = _overlap(x, y)
    return x + y[n:] if n >= least and n >= share * min(len(x), len(y)) else None


@F.pandas_udf(StringType())
def _joined(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([joined(x, y) if x is not None and y is not None else None for x, y in zip(a, b)], dtype="object")


def overlap_join(a: Column, b: Column) -> Column:
    """``a`` + rest of ``b``, both normalised, at the longest suffix of one that begins the other; null if too short."""
    return _joined(normalize_text(a), normalize_text(b))


def safe_correction(old: Column, new: Column) -> Column:
    """Both have content and the length changes by two characters or a fifth (half-even) at most."""
    a, b = F.length(punct_key(old)), F.length(punct_key(new))
    return (a > 0) & (b > 0) & (F.abs(a - b) <= F.greatest(F.lit(2), F.bround(a * F.lit(0.2)).cast("int")))


def signature_similarity(a: Column, b: Column, empty: float = 1e-9) -> Column:
    """Cosine of two vectors; two empty ones (norm below ``empty``) are alike, an empty and another are not."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    na, nb = F.sqrt(dot(a, a)), F.sqrt(dot(b, b))
    return F.when((na < empty) & (nb < empty), 1.0).when((na < empty) | (nb < empty), 0.0).otherwise(dot(a, b) / (na * nb))


@F.pandas_udf(ArrayType(StructType([StructField(x, LongType()) for x in ("a_index", "b_index", "size")])))
def matching_blocks(a: pd.Series, b: pd.Series) -> pd.Series:
    """Blocks of equal characters of two texts, in order."""
    return pd.Series([matching(x, y) if x is not None and y is not None else [] for x, y in zip(a, b)])


def align_characters(a: Column, b: Column) -> Column:
    """(a_index, b_index) of every aligned character."""
    return F.flatten(F.transform(matching_blocks(a, b), lambda m: F.transform(F.sequence(F.lit(0).cast("long"), m["size"] - 1), lambda k: F.struct((m["a_index"] + k).alias("a_index"), (m["b_index"] + k).alias("b_index")))))
