"""Spelling variants: the vocabulary's minimised acceptor, a one-edit transducer and the acceptor again, composed."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import stage

#: Code points of a word, its occurrences, and how much more frequent its form is, at least.
LEAST_LENGTH, LEAST_COUNT, TIMES = 7, 2, 10
#: One run in so many loses a code point (the contract's misprints).
MISPRINT = 31
#: Words that a task counts before it hands them on.
COUNTED = 300_000
#: Words of one initial state that are composed; larger ones are joined by what deletions leave.
MOST_WORDS = 50_000
#: Letters (rows times width) of the initial states that are composed at once, and states followed at once.
AT_ONCE, FOLLOWED = 1_500_000, 400_000


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misprint: int | None = MISPRINT) -> DataFrame:
    """(word, n): runs of ``[A-Za-z\\u00C0-\\u00FF]`` with A-Z lowered, of LEAST_LENGTH code points and LEAST_COUNT occurrences or more.

    With ``misprint``, a run whose crc32 with its document's id is divided by it loses a code point. A null id is
    written as nothing, a null text has no words. Each task counts its own words first.
    """
    run = re.compile(rb"[a-z\xc0-\xff]{%d,}" % LEAST_LENGTH)  # in Latin-1 a code point is a byte; others become "?"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def made() -> pd.DataFrame:
            return pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": pd.array(list(held.values()), "int64")})

        for pdf in batches:
            for doc, text in zip(pdf["doc"], pdf["text"]):
                for w, n in Counter(run.findall(text.encode("latin-1", "replace").lower())).items():
                    if misprint:
                        h = zlib.crc32(f"{doc}:".encode() + (w if w.isascii() else w.decode("latin-1").encode()))
                        if h % misprint == 0:
                            k = h % len(w)
                            w = w[:k] + w[k + 1 :]
                    if len(w) >= LEAST_LENGTH:
                        held[w] += n
                if len(held) > COUNTED:
                    yield made()
                    held = Counter()
        if held:
            yield made()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("doc"), F.col(text_col).alias("text")).where("text is not null")
    return rows.mapInPandas(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def initial_states(words: DataFrame) -> DataFrame:
    """(size, back, key, word, n): the initial states that each word belongs to.

    Two near words of lengths m and m or m+1 share either the first m//2 code points or, read backwards, the last m - m//2.
    So a word enters, with its own length and with one less as ``size``, the state after its beginning and that before its end.
    """
    length = F.length("word")
    each = []
    for less in (0, 1):
        for back in (False, True):
            m = length - less
            h = F.floor(m / 2).cast("int")
            key = F.substring(F.col("word"), length - (m - h) + 1, m - h) if back else F.substring(F.col("word"), F.lit(1), h)
            each.append(F.struct(m.alias("size"), F.lit(back).alias("back"), key.alias("key")))
    rows = words.select(F.explode(F.array(*each)).alias("x"), "word", "n").select("x.*", "word", "n")
    return rows.where(F.col("size") >= LEAST_LENGTH)


class Acceptor:
    """Minimal deterministic acceptor of several sets of words at once, one initial state for each set.

    ``sets`` is in order, ``letters`` (0 beyond a word's end) in lexicographic order within a set. A state is what can
    still be read from it; states are found from the ends of the words on, by a hash of that, which is checked. Each
    transition carries the number of words that come before those it leads to, so a path gives the word's row.
    """

    def __init__(self, sets: np.ndarray, letters: np.ndarray, length: np.ndarray) -> None:
        n, width = letters.shape
        depth_of = np.full(n, -1)
        if n > 1 and width:
            differ = letters[1:] != letters[:-1]
            shared = np.where(differ.any(1), differ.argmax(1), width)
            depth_of[1:] = np.where(sets[1:] == sets[:-1], shared, -1)
        for seed in range(1, 9):
            if self._minimise(letters, length, depth_of, seed):
                break
        new = np.nonzero(depth_of == -1)[0]
        self.row = new  # first row of each set
        self.initial = self.state_of_root

    def _minimise(self, letters: np.ndarray, length: np.ndarray, shared: np.ndarray, seed: int) -> bool:
        """Tries one hash; False if it gave one number to two states."""
        mul = np.uint64(0x9E3779B97F4A7C15 + 2 * seed)

        def mix(x: np.ndarray) -> np.ndarray:
            x = (x ^ (x >> np.uint64(29))) * mul
            x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            return x ^ (x >> np.uint64(31))

        width = letters.shape[1]
        levels = []  # (first row, hash, words, final, first child, children) of the trie's nodes of each depth, deepest first
        below: tuple | None = None
        for depth in range(width, -1, -1):
            rows = np.nonzero((shared < depth) & (length >= depth))[0]
            final = length[rows] == depth
            h = mix(np.where(final, np.uint64(3), np.uint64(5)))
            words = np.bincount(np.searchsorted(rows, np.nonzero(length >= depth)[0], "right") - 1, minlength=len(rows)) if len(rows) else np.empty(0, np.int64)
            first_child = children = np.zeros(len(rows), np.int64)
            if below is not None and len(below[0]):
                child_rows, child_h = below
                parent = np.searchsorted(rows, child_rows, "right") - 1
                label = letters[child_rows, depth].astype(np.uint64)
                np.add.at(h, parent, mix(child_h + mix(label + np.uint64(11))))
                children = np.bincount(parent, minlength=len(rows))
                first_child = np.cumsum(children) - children
            levels.append((rows, h, words, final, first_child, children))
            below = (rows, h)
        offset = np.cumsum([0] + [len(x[0]) for x in levels])
        every = np.concatenate([x[1] for x in levels])
        _, example, state = np.unique(every, return_index=True, return_inverse=True)
        final, words, children = (np.concatenate([x[k] for x in levels]) for k in (3, 2, 5))
        # nodes of depth d + 1 stand before those of d
        first = np.concatenate([x[4] + (offset[i - 1] if i else 0) for i, x in enumerate(levels)])
        label = np.concatenate([letters[x[0], width - i - 1] if i < width else np.zeros(len(x[0]), letters.dtype) for i, x in enumerate(levels)])
        own = children[example]
        if (children != own[state]).any() or (final != final[example][state]).any() or (words != words[example][state]).any():
            return False
        # the j-th child of every node against that of its state's example
        for j in range(int(children.max(initial=0))):
            some = np.nonzero(children > j)[0]
            a, b = first[some] + j, first[example[state[some]]] + j
            if (label[a] != label[b]).any() or (state[a] != state[b]).any():
                return False
        self.final, self.words = final[example], words[example]
        self.start = np.cumsum(own) - own
        self.degree = own
        node = np.repeat(first[example], own) + np.arange(own.sum()) - np.repeat(self.start, own)
        self.label, self.target = label[node].astype(np.int64), state[node]
        source = np.repeat(np.arange(len(own)), own)
        self.key = source * 256 + self.label
        run = np.concatenate([[0], np.cumsum(words[node])])
        self.skip = run[:-1] - run[self.start[source]] + self.final[source]
        self.state_of_root = state[offset[-2] : offset[-1]]
        return True


def _expand(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, number within the row) for ``count`` places of each row."""
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)


def _together(f: Acceptor, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, transition of x, transition of y) that read the same letter."""
    turn = f.degree[x] > f.degree[y]
    p, q = np.where(turn, y, x), np.where(turn, x, y)
    row, j = _expand(f.degree[p])
    one = f.start[p[row]] + j
    want = q[row] * 256 + f.label[one]
    two = np.searchsorted(f.key, want)
    ok = two < len(f.key)
    ok[ok] = f.key[two[ok]] == want[ok]
    row, one, two = row[ok], one[ok], two[ok]
    t = turn[row]
    return row, np.where(t, two, one), np.where(t, one, two)


def compose(f: Acceptor, same: np.ndarray, longer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the words that are one replaced letter apart, within each set of ``same``, and of those of ``longer``'s
    first set that are one inserted letter shorter than those of its second.

    The states of acceptor, one-edit transducer and acceptor are followed together from the initial states on, before the edit
    and after it. An insertion that could stand at several places of a run is made at the last of them: the letter
    read after it must not be the inserted one. So every pair is found once.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    # kind 0: before a replacement (x = y), 1: before an insertion, 2: after the edit; ban: letter that may not come next
    init, row = f.initial, f.row
    stack = []
    if len(same):
        stack.append((0, init[same], init[same], row[same], row[same], np.zeros(len(same), np.int64)))
    if len(longer):
        stack.append((1, init[longer[:, 0]], init[longer[:, 1]], row[longer[:, 0]], row[longer[:, 1]], np.zeros(len(longer), np.int64)))
    while stack:
        kind, *held = stack.pop()
        if len(held[0]) > FOLLOWED:
            stack.append((kind, *(v[FOLLOWED:] for v in held)))
            held = [v[:FOLLOWED] for v in held]
        x, y, i, j, ban = held
        if kind == 0:
            some = f.words[x] > 1
            x, i = x[some], i[some]
            at, k = _expand(f.degree[x])
            t = f.start[x[at]] + k
            stack.append((0, f.target[t], f.target[t], i[at] + f.skip[t], i[at] + f.skip[t], np.zeros(len(t), np.int64)))
            # each transition with those after it of the same state
            more, k2 = _expand(f.degree[x[at]] - k - 1)
            a, b = t[more], t[more] + 1 + k2
            base = i[at[more]]
            stack.append((2, f.target[a], f.target[b], base + f.skip[a], base + f.skip[b], np.zeros(len(a), np.int64)))
        elif kind == 1:
            at, k = _expand(f.degree[y])
            t = f.start[y[at]] + k
            stack.append((2, x[at], f.target[t], i[at], j[at] + f.skip[t], f.label[t]))
            at, a, b = _together(f, x, y)
            stack.append((1, f.target[a], f.target[b], i[at] + f.skip[a], j[at] + f.skip[b], np.zeros(len(a), np.int64)))
        else:
            end = f.final[x] & f.final[y]
            if end.any():
                found.append((i[end], j[end]))
            at, a, b = _together(f, x, y)
            ok = f.label[a] != ban[at]
            at, a, b = at[ok], a[ok], b[ok]
            stack.append((2, f.target[a], f.target[b], i[at] + f.skip[a], j[at] + f.skip[b], np.zeros(len(a), np.int64)))
        while stack and not len(stack[-1][1]):
            stack.pop()
        stack = [s for s in stack if len(s[1])]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def near_in(size: np.ndarray, back: np.ndarray, key: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of near words among rows of whole initial states; the words are Latin-1 strings, the arrays of objects.

    A state holds words of length ``size`` and one more; pairs of two of the longer belong to another state. Pairs that
    also share the beginning are left to the states of beginnings.
    """
    length = np.fromiter(map(len, word), np.int64, len(word))
    role = (length > size).astype(np.int64)
    rest = [w[: len(w) - len(k)][::-1] if b else w[len(k) :] for w, k, b in zip(word, key, back)]
    raw = np.array([r.encode("latin-1") for r in rest], "S")
    which = pd.MultiIndex.from_arrays([size, back, key])
    group = pd.factorize(which)[0]
    sets = group * 2 + role
    order = np.lexsort((raw, sets))
    sets, raw = sets[order], raw[order]
    letters = raw.view(np.uint8).reshape(len(raw), -1)
    left = length[order] - np.fromiter(map(len, key), np.int64, len(key))[order]
    f = Acceptor(sets, letters, left)
    name = sets[f.row]
    place = dict(zip(name.tolist(), range(len(name))))
    same = np.nonzero(name % 2 == 0)[0]
    longer = np.array([(k, place[s + 1]) for s, k in place.items() if s % 2 == 0 and s + 1 in place], np.int64).reshape(-1, 2)
    a, b = compose(f, same, longer)
    a, b = order[a], order[b]
    turned = np.nonzero(back[a])[0]
    h = size // 2
    twice = [k for k in turned if word[a[k]][: h[a[k]]] == word[b[k]][: h[a[k]]]]
    ok = np.ones(len(a), bool)
    ok[twice] = False
    return a[ok], b[ok]


_NEAR = "word string, n_near long, form_n long, form string"


def _best(pairs: DataFrame) -> DataFrame:
    """(word, n_near, form_n, form) from rows of that kind, of parts: their sum and the form of largest n, then smallest."""
    top = F.min(F.struct((-F.col("form_n")).alias("n"), F.col("form").alias("form")))
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select("word", "n_near", (-F.col("top.n")).alias("form_n"), F.col("top.form").alias("form"))


def near_words(words: DataFrame, most: int = MOST_WORDS) -> DataFrame:
    """(word, n_near, form_n, form): for each word with a near one, how many there are, and the most frequent (ties: the smallest) with its n.

    Initial states of up to ``most`` words are composed in tasks, many at once. The words of larger ones are joined by what is left
    of them without one letter, of which no more than an alphabet of words can have the same.
    """
    states = initial_states(words)
    by = ["size", "back", "key"]
    large = stage(states.groupBy(*by).agg(F.count("*").alias("rows")).where(F.col("rows") > most).drop("rows"), "large")
    hot = None
    if not large.isEmpty():
        hot = states.join(large, by, "left_semi")
        states = states.join(large, by, "left_anti")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def made(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
            size, back, key, word, n = (pdf[c].to_numpy() for c in (*by, "word", "n"))
            a, b = near_in(size.astype(np.int64), back.astype(bool), key, word)
            if not len(a):
                return
            one, two = np.append(a, b), np.append(b, a)
            order = np.lexsort((word[two].astype("U"), -n[two], one))
            one, two = one[order], two[order]
            first = np.nonzero(np.append(True, one[1:] != one[:-1]))[0]
            count = np.diff(np.append(first, len(one)))
            yield pd.DataFrame({"word": word[one[first]], "n_near": count, "form_n": n[two[first]], "form": word[two[first]]})

        held: list[pd.DataFrame] = []
        letters = 0
        for pdf in batches:
            while len(pdf):
                # what belongs to the state that began before goes with it
                width = len(pdf["word"].iloc[0])
                take = min(len(pdf), max(1, AT_ONCE // width))
                part, pdf = pdf.iloc[:take], pdf.iloc[take:]
                held.append(part)
                letters += int(part["word"].str.len().max()) * len(part)
                if letters >= AT_ONCE:
                    whole = pd.concat(held, ignore_index=True)
                    last = whole[by].ne(whole[by].iloc[-1]).any(axis=1).to_numpy()
                    cut = int(np.nonzero(last)[0][-1]) + 1 if last.any() else 0
                    if cut:
                        yield from made(whole.iloc[:cut])
                    held = [whole.iloc[cut:]]
                    letters = int(held[0]["word"].str.len().max()) * len(held[0]) if len(held[0]) else 0
        if held:
            whole = pd.concat(held, ignore_index=True)
            if len(whole):
                yield from made(whole)

    found = states.repartition(*by).sortWithinPartitions(*by).mapInPandas(find, _NEAR)
    if hot is not None:
        found = found.unionByName(_by_deletions(hot))
    return _best(found)


def _by_deletions(states: DataFrame) -> DataFrame:
    """Rows as ``near_words`` gathers them, one for each near word, from the words of large initial states."""
    h, length = F.floor(F.col("size") / 2), F.length("word")
    own = states.withColumn("from", F.when(F.col("back"), F.lit(0)).otherwise(h).cast("int")).withColumn("to", F.when(F.col("back"), length - (F.col("size") - h)).otherwise(length).cast("int"))
    own = own.withColumn("longer", length > F.col("size"))
    without = own.where("from < to").select("size", "back", "key", "word", "n", "longer", F.explode(F.expr("sequence(from, to - 1)")).alias("at"))
    without = without.withColumn("left", F.concat(F.expr("substring(word, 1, at)"), F.expr("substring(word, at + 2)")))
    a, b = (without.where("not longer").select("size", "back", "key", "at", "left", F.col("word").alias(w), F.col("n").alias(n)) for w, n in (("u", "nu"), ("v", "nv")))
    replaced = a.join(b, ["size", "back", "key", "at", "left"]).where("u < v").select("u", "nu", "v", "nv")
    short = own.where("not longer").select("size", "back", "key", F.col("word").alias("u"), F.col("n").alias("nu"))
    long_ = without.where("longer").select("size", "back", "key", F.col("left").alias("u"), F.col("word").alias("v"), F.col("n").alias("nv")).distinct()
    inserted = short.join(long_, ["size", "back", "key", "u"])
    inserted = inserted.where("not back or substring(u, 1, cast(floor(size / 2) as int)) <> substring(v, 1, cast(floor(size / 2) as int))").select("u", "nu", "v", "nv")
    pairs = replaced.unionByName(inserted)
    one = lambda w, n, form: F.struct(F.col(w).alias("word"), F.lit(1).cast("long").alias("n_near"), F.col(n).alias("form_n"), F.col(form).alias("form"))
    two = F.explode(F.array(one("u", "nv", "v"), one("v", "nu", "u")))
    return pairs.select(two.alias("x")).select("x.*")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for a table (word, form) without circles: the last word that forms lead to.

    Each round jumps twice as far; as a form is TIMES as frequent as its word, a chain has at most as many steps as the
    counts have digits, and rounds are few.
    """
    at = stage(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        on = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = stage(at.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if new.where("moved").isEmpty():
            return new.drop("moved")
        at = new.drop("moved")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", misprint: int | None = MISPRINT, most: int = MOST_WORDS) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``vocabulary``.

    Words are near if one inserted, deleted or replaced code point makes one the other. ``form`` is the near word of the
    largest n (ties: the smallest) if that is TIMES the word's n or more, else null, as is ``form_n``; ``root`` is the last
    word that forms lead to, the word itself if it has none. Other columns are not read; an empty table gives no rows.
    """
    words = stage(vocabulary(docs, id_col, text_col, misprint), "words")
    near = near_words(words, most).withColumnRenamed("word", "w")
    all_ = words.join(near, F.col("word") == F.col("w"), "left").drop("w")
    has = F.col("form_n") >= TIMES * F.col("n")
    all_ = all_.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("form")).alias("form"), F.when(has, F.col("form_n")).alias("form_n"))
    all_ = stage(all_, "forms")
    last = roots(all_.where("form is not null")).withColumnRenamed("word", "w")
    return all_.join(last, F.col("word") == F.col("w"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
