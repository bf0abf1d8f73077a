"""Language-model scoring: a gated recurrent network with a class-factored softmax, trained by truncated backpropagation."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import lower_words, stage

#: Words the network knows, in CLASSES classes of equal size by frequency; all others are one outcome, spelled out by their counts.
VOCAB, CLASSES = 4096, 64
#: Widths of embedding and state; documents side by side and words of a window in training. Every training document is learned from.
EMBED, STATE, STREAMS, STEPS = 16, 16, 512, 16
#: Words of a document that a stream trains on in one go, so that long documents don't leave the other streams idle.
PIECE = 1024
#: Rounds of training between which the replicas' weights are averaged.
ROUNDS = 2
#: Rate of the first step.
RATE = 0.04
#: Words whose counts every task holds; counts of rarer ones are joined.
HELD_WORDS = 1 << 18
#: Documents scored side by side, words after which a task learns from what it has gathered, and after which it scores it: a
#: long document's last words are scored with few lanes beside it, so fewer, larger lots cost less.
LANES, AT_ONCE, SCORED_AT_ONCE = 512, 1_500_000, 4_000_000
#: Different words that a task counts before it sends them on.
COUNTED = 400_000
#: Tree of the weights' average: replicas are summed in so many groups, these in so many, whose sums go to the driver.
TREE = (1024, 16)
END = b"\n"  # no word holds a line feed, so this can stand for the end of a document
HELD = "coalesce(crc32(cast(cast({} as string) as binary)) % 7 = 2, false)"


class Index(dict):
    """Places of words; ``none`` for any other word, which is not remembered."""

    none = 0

    @classmethod
    def of(cls, words: list[bytes], none: int) -> Index:
        out = cls(zip(words, range(len(words))))
        out.none = none
        return out

    def __missing__(self, word: bytes) -> int:
        return self.none

    def __reduce__(self):
        return Index.of, (list(self), self.none)

    def encode(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.get, words, repeat(self.none)), np.int32, len(words))


def keep_freed_memory(size: int = 1 << 24) -> None:
    """Has malloc keep freed arrays of up to ``size`` bytes for the next ones: glibc takes the largest block freed so far as the bound.

    Else each step's arrays come from the system anew, and their page faults take a third of a training step.
    """
    np.empty(size, np.uint8)


class Adam:
    """Steps along running means of the gradient, clipped to norm 1; the rate falls with the root of the steps taken."""

    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size, np.float32), np.zeros(size, np.float32), 0, rate

    def apply(self, flat: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        grad *= np.float32(min(1.0, 1.0 / (float(np.linalg.norm(grad)) + 1e-9)))
        self.m += np.float32(0.1) * (grad - self.m)
        self.v += np.float32(0.01) * (grad * grad - self.v)
        now = self.rate / np.sqrt(1 + self.t / 40) * np.sqrt(1 - 0.99**self.t) / (1 - 0.9**self.t)
        flat -= np.float32(now) * self.m / (np.sqrt(self.v) + np.float32(1e-6))


class Network:
    """Parameters as one flat vector; word ids 0..VOCAB-1 by frequency, VOCAB for any other."""

    def __init__(self, logs: np.ndarray | None = None, seed: int = 3) -> None:
        """logs: log probabilities of the VOCAB words and of the others, from counts; the biases begin there."""
        size = VOCAB // CLASSES
        self.shapes = {"E": (VOCAB + 1, EMBED), "W": (EMBED, 3 * STATE), "U": (STATE, 3 * STATE), "b": (3 * STATE,), "C": (STATE, CLASSES + 1), "c": (CLASSES + 1,), "O": (CLASSES, STATE, size), "o": (CLASSES, size)}
        self.flat = np.zeros(sum(int(np.prod(s)) for s in self.shapes.values()), np.float32)
        self.view(self.flat)
        if logs is not None:
            rng = np.random.default_rng(seed)
            for name, scale in (("E", 0.3), ("W", 0.3), ("U", 0.2), ("C", 0.05), ("O", 0.02)):
                getattr(self, name)[...] = rng.normal(0, scale, self.shapes[name])
            known = logs[:VOCAB].reshape(CLASSES, size)
            top = known.max(1, keepdims=True)
            total = top[:, 0] + np.log(np.exp(known - top).sum(1))
            self.c[...] = np.append(total, logs[VOCAB])
            self.o[...] = known - total[:, None]

    def view(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """Named parts of a vector of parameters; those of ``flat`` itself become attributes."""
        at, out = 0, {}
        for name, shape in self.shapes.items():
            n = int(np.prod(shape))
            out[name] = flat[at : at + n].reshape(shape)
            at += n
        if flat is self.flat:
            self.__dict__.update(out)
        return out

    def gates(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step: x holds the input's share of the gates. Arrays lie column by column, so each gate's values lie side by side."""
        g = (self.U.T @ h.T).T
        rz = x[:, : 2 * STATE] + g[:, : 2 * STATE]
        np.negative(rz, out=rz)
        np.exp(rz, out=rz)
        rz += 1
        np.reciprocal(rz, out=rz)
        r, z = rz[:, :STATE], rz[:, STATE:]
        n = r * g[:, 2 * STATE :]
        n += x[:, 2 * STATE :]
        np.tanh(n, out=n)
        new = h - n
        new *= z
        new += n
        return new, r, z, n, g[:, 2 * STATE :]

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of the classes and of the words within each, their biases as one more row, which a state's last 1 takes."""
        return np.concatenate([self.C, self.c[None]]), np.concatenate([self.O, self.o[:, None]], axis=1)

    def log_probs(self, h: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log of the class's probability times the word's within it, for states and targets."""
        classes, words = self.heads()
        order, edge = by_class(np.minimum(y // (VOCAB // CLASSES), CLASSES))
        hs, word, row = with_one(h[order]), y[order] % (VOCAB // CLASSES), np.arange(len(y))
        logits = level(hs @ classes)
        found = logits[row, np.repeat(np.arange(CLASSES + 1), np.diff(edge))]
        found -= np.log(row_sums(np.exp(logits, out=logits)))
        inner = within(hs, words, edge)
        row, word = row[: len(inner)], word[: len(inner)]
        found[: len(inner)] += inner[row, word]
        found[: len(inner)] -= np.log(row_sums(np.exp(inner, out=inner)))
        out = np.empty_like(found)
        out[order] = found
        return out

    def step(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, start: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Gradient over one window of (STEPS, streams) words, truncated at its first word; the state goes on.

        start marks words that begin a document (the state is reset there), mask those that count.
        """
        grad = np.zeros_like(self.flat)
        d = self.view(grad)
        t_max, n = x.shape
        inputs, into = with_one(self.E)[x], np.concatenate([self.W, self.b[None]])
        gx = shares(inputs, into)
        states, parts = [], []
        for t in range(t_max):
            if start[t].any():
                h = (h.T * ~start[t]).T
            states.append(h)
            h, *rest = self.gates(gx[t], h)
            parts.append((h, *rest))
        hs = np.stack([p[0] for p in parts]).reshape(-1, STATE)  # row by row
        counted = np.nonzero(mask.ravel())[0]
        ys, size = y.ravel()[counted], VOCAB // CLASSES
        order, edge = by_class(np.minimum(ys // size, CLASSES))
        counted = counted[order]
        hc, word, cls = with_one(hs[counted]), ys[order] % size, np.repeat(np.arange(CLASSES + 1), np.diff(edge))
        classes, words = self.heads()
        row = np.arange(len(hc))
        p = level(hc @ classes)
        # A row's gradient is its exponentials, less their sum at the target, over that sum, which the narrower states are divided by.
        np.exp(p, out=p)
        total = row_sums(p)
        loss = -np.log(p[row, cls] / total + 1e-30).sum(dtype=float)
        p[row, cls] -= total
        total = 1 / total
        both = (hc * total[:, None]).T @ p
        d["C"] += both[:STATE]
        d["c"] += both[STATE]
        dc = p @ self.C.T
        dc *= total[:, None]
        q = within(hc, words, edge)
        np.exp(q, out=q)
        total = row_sums(q)
        at = row[: len(q)], word[: len(q)]
        loss -= np.log(q[at] / total + 1e-30).sum(dtype=float)
        q[at] -= total
        total = 1 / total
        scaled, dq = hc[: len(q)] * total[:, None], np.empty((len(q), STATE), np.float32)
        for k in np.nonzero(edge[1:-1] > edge[:-2])[0]:
            part = slice(edge[k], edge[k + 1])
            both = scaled[part].T @ q[part]
            d["O"][k] += both[:STATE]
            d["o"][k] += both[STATE]
            np.matmul(q[part], self.O[k].T, out=dq[part])
        dq *= total[:, None]
        dc[: len(q)] += dq
        dh = np.zeros_like(hs)
        dh[counted] = dc
        dh = by_column(dh.reshape(t_max, n, STATE))
        dgx, dgh = (np.empty((t_max, 3 * STATE, n), np.float32).transpose(0, 2, 1) for _ in range(2))
        carry = np.zeros((STATE, n), np.float32).T
        for t in range(t_max - 1, -1, -1):
            _, r, z, new, gn = parts[t]
            g = dh[t]
            g += carry
            rest, both = 1 - z, dgx[t]
            dr, dz, dn = both[:, :STATE], both[:, STATE : 2 * STATE], both[:, 2 * STATE :]
            np.subtract(states[t], new, out=dz)
            dz *= g
            dz *= z
            dz *= rest
            np.multiply(new, new, out=dn)
            np.subtract(1, dn, out=dn)
            dn *= g
            dn *= rest
            np.subtract(1, r, out=dr)
            dr *= r
            dr *= gn
            dr *= dn
            dgh[t] = both
            dgh[t, :, 2 * STATE :] *= r
            carry = (self.U @ dgh[t].T).T
            g *= z
            carry += g
            if start[t].any():
                carry = (carry.T * ~start[t]).T
        d["U"] += np.matmul(by_column(np.stack(states)).transpose(0, 2, 1), dgh).sum(0)
        both = np.matmul(inputs.transpose(0, 2, 1), dgx).sum(0)
        d["W"] += both[:EMBED]
        d["b"] += both[EMBED]
        ids = x.ravel()
        order = np.argsort(ids.astype(np.int16), kind="stable")
        ids = ids[order]
        first = np.nonzero(np.append(True, ids[1:] != ids[:-1]))[0]
        d["E"][ids[first]] += np.add.reduceat(np.matmul(dgx, self.W.T).reshape(-1, EMBED)[order], first)  # by word
        return grad, h, loss

    def train(self, texts: list[np.ndarray], adam: Adam) -> int:
        """One pass over documents dealt to parallel streams; returns the words seen."""
        pieces = [(t[a : a + PIECE], t[a - 1]) for t in texts for a in range(0, len(t), PIECE)]  # and the word before, or the end
        lanes = deal([len(t) for t, _ in pieces], STREAMS)
        length = max((sum(len(pieces[k][0]) for k in lane) for lane in lanes), default=0)
        if not length:
            return 0
        length = -(-length // STEPS) * STEPS
        y = np.zeros((length, len(lanes)), np.int32)
        x, mask, start = np.zeros_like(y), np.zeros(y.shape, np.float32), np.zeros(y.shape, bool)
        for j, lane in enumerate(lanes):
            at = 0
            for k in lane:
                text, before = pieces[k]
                n = len(text)
                y[at : at + n, j], x[at + 1 : at + n, j], mask[at : at + n, j], start[at, j] = text, text[:-1], 1, True
                x[at, j] = before
                at += n
        h = np.zeros((len(lanes), STATE), np.float32)
        for t in range(length // STEPS):
            part = slice(t * STEPS, (t + 1) * STEPS)
            words = mask[part].sum()
            if words:
                grad, h, _ = self.step(x[part], y[part], mask[part], start[part], h)
                adam.apply(self.flat, grad / words)
        return int(mask.sum())

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """Log likelihood of each whole document. Lanes run side by side, longest first; states go on from window to window."""
        out = np.zeros(len(texts))
        lanes = deal([len(t) for t in texts], LANES)
        lanes.sort(key=lambda lane: -sum(len(texts[k]) for k in lane))
        sizes = np.array([sum(len(texts[k]) for k in lane) for lane in lanes])
        if not len(sizes):
            return out
        window, base = 32 * LANES, np.append(0, np.cumsum(sizes))  # words of a window, so it is longer where few lanes are left
        y = np.concatenate([texts[k] for lane in lanes for k in lane]).astype(np.int32)  # lane after lane
        starts = np.append(0, np.cumsum([len(texts[k]) for lane in lanes for k in lane]))[:-1]
        x = np.roll(y, 1)  # every document ends alike, so each begins after an end
        new, logp = np.zeros(len(y), bool), np.zeros(len(y), np.float32)
        new[starts] = True
        inputs, into = with_one(self.E), np.concatenate([self.W, self.b[None]])
        h = np.zeros((len(lanes), STATE), np.float32)
        a = steps = 0
        while (a := a + steps) < sizes[0]:
            live = int((sizes > a).sum())
            h = h[:live]
            steps = min(window // live, int(sizes[0]) - a)
            real = (a + np.arange(steps))[:, None] < sizes[None, :live]
            at = np.where(real, base[None, :live] + (a + np.arange(steps))[:, None], 0)
            hs = np.empty((steps, live, STATE), np.float32)
            gx, first = shares(inputs[x[at]], into), new[at]
            begins = first.any(1)
            for t in range(steps):
                if begins[t]:
                    h = (h.T * ~first[t]).T
                h = hs[t] = self.gates(gx[t], h)[0]
            logp[at[real]] = self.log_probs(hs[real], y[at[real]])
        out[[k for lane in lanes for k in lane]] = np.add.reduceat(logp, starts, dtype=np.float64)
        return out


def by_column(rows: np.ndarray) -> np.ndarray:
    """The same array of (steps, rows, columns), each step stored column by column."""
    return np.ascontiguousarray(rows.transpose(0, 2, 1)).transpose(0, 2, 1)


def shares(inputs: np.ndarray, into: np.ndarray) -> np.ndarray:
    """The inputs' shares of the gates, each step stored column by column."""
    return np.matmul(into.T, inputs.transpose(0, 2, 1)).transpose(0, 2, 1)


def with_one(h: np.ndarray) -> np.ndarray:
    """States (or embeddings) with a 1 behind each, which takes the biases."""
    out = np.ones((len(h), STATE + 1), np.float32)
    out[:, :STATE] = h
    return out


def level(logits: np.ndarray) -> np.ndarray:
    """Logits, in place, that can be raised to exponentials: less each row's greatest, unless all are small as they are."""
    if logits.size and not (logits.max() < 60 and logits.min() > -60):
        logits -= logits.max(1, keepdims=True)
    return logits


def row_sums(rows: np.ndarray) -> np.ndarray:
    return rows @ np.ones(rows.shape[1], np.float32)


def within(hs: np.ndarray, words: np.ndarray, edge: np.ndarray) -> np.ndarray:
    """Logits of the words within each row's class, for rows in the order of their classes; none for rows of the outcome "other"."""
    out = np.empty((edge[CLASSES], VOCAB // CLASSES), np.float32)
    for k in np.nonzero(edge[1:-1] > edge[:-2])[0]:
        np.matmul(hs[edge[k] : edge[k + 1]], words[k], out=out[edge[k] : edge[k + 1]])
    return level(out)


def by_class(cls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by class, and where each class begins in it."""
    order = np.argsort(cls.astype(np.uint8), kind="stable")
    return order, np.append(0, np.cumsum(np.bincount(cls, minlength=CLASSES + 1)))


def deal(sizes: list[int], lanes: int) -> list[list[int]]:
    """Documents to lanes of about equal length: longest first, each to the shortest lane."""
    import heapq

    heap = [(0, k) for k in range(max(1, min(lanes, len(sizes))))]
    out: list[list[int]] = [[] for _ in heap]
    for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
        total, lane = heapq.heappop(heap)
        out[lane].append(k)
        heapq.heappush(heap, (total + sizes[k], lane))
    return [x for x in out if x]


def word_counts(train: DataFrame) -> DataFrame:
    """(word BINARY, c): counts of words over all rows of ``train``; an end for each row is counted under END."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for pdf in batches:
            for text in pdf["text"]:
                seen.update(lower_words(text))
            seen[END] += len(pdf)
            if len(seen) > COUNTED:
                yield pd.DataFrame({"word": list(seen.keys()), "c": list(seen.values())})
                seen = Counter()
        yield pd.DataFrame({"word": list(seen.keys()), "c": list(seen.values())})

    return train.select("text").mapInPandas(count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(counts: DataFrame, most: int) -> dict[bytes, int]:
    """The ``most`` most frequent words with their counts in that order; equal counts are ordered by XXH64 of the word.

    No sort: the place to cut is found on a logarithmic scale of counts, then among the counts of one step of it, then
    among 65,536 ranges of the hash, each from a small table of sizes; what lies before it is collected.
    """
    step, place = F.floor(F.log2(F.col("c").cast("double")) * 64), F.shiftrightunsigned(F.xxhash64("word"), 48)
    chosen, rest, left = F.lit(False), F.lit(True), most
    for scale in (-step, -F.col("c"), place):
        sizes = counts.where(rest).groupBy(scale.alias("s")).agg(F.count("*").alias("n")).orderBy("s").collect()
        at = 0
        while at < len(sizes) and sizes[at]["n"] <= left:
            left -= sizes[at]["n"]
            at += 1
        if at == len(sizes):
            chosen = chosen | rest
            break
        chosen, rest = chosen | (rest & (scale < sizes[at]["s"])), rest & (scale == sizes[at]["s"])
    else:
        chosen = chosen | rest  # one range of the hash among equal counts, cut below
    words = counts.where(chosen).select("word", "c", F.xxhash64("word").alias("h")).toArrow()
    rows = zip(words["c"].to_pylist(), (h % (1 << 64) for h in words["h"].to_pylist()), words["word"].to_pylist())
    return {w: c for c, _, w in sorted(rows, key=lambda r: (-r[0], r[1], r[2]))[:most]}


def train_network(train: DataFrame, ids: Index, logs: np.ndarray, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """Replicas learn from their own documents; weights are averaged by words seen, as a tree, after each round.

    Each round takes its own share of the documents, by a hash, so every document of ``train`` is learned from once. A
    task holds no more encoded words than AT_ONCE and one document.
    """
    flat = Network(logs).flat
    sums = "part long, n long, weights binary"

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(len(flat))
        for x in rows["weights"]:
            total += np.frombuffer(x, np.float64)
        return pd.DataFrame({"part": rows["part"].iloc[:1], "n": [int(rows["n"].sum())], "weights": [total.tobytes()]})

    share = F.pmod(F.xxhash64("doc_id", "text", F.lit(23)), F.lit(rounds))
    for k in range(rounds):

        def learn(batches: Iterator[pd.DataFrame], start: np.ndarray = flat, rate: float = rate / (1 + k)) -> Iterator[pd.DataFrame]:
            from pyspark import TaskContext

            keep_freed_memory()
            net, n, texts, size = Network(), 0, [], 0
            net.flat[:] = start
            adam = Adam(len(start), rate)
            for pdf in batches:
                for text in pdf["text"]:
                    words = lower_words(text)
                    words.append(END)
                    texts.append(ids.encode(words))
                    size += len(words)
                    if size > AT_ONCE:
                        n += net.train(texts, adam)
                        texts, size = [], 0
            n += net.train(texts, adam)
            if n:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [n], "weights": [(net.flat.astype(np.float64) * n).tobytes()]})

        part = train.where(share == k).select("text").mapInPandas(learn, sums)
        for groups in TREE:
            part = part.groupBy(F.pmod("part", F.lit(groups))).applyInPandas(add, sums)
        found = part.collect()  # TREE[-1] rows at most
        if found:
            flat = (sum(np.frombuffer(r["weights"], np.float64) for r in found) / sum(r["n"] for r in found)).astype(np.float32)
    net = Network()
    net.flat[:] = flat
    return net


def score_documents(docs: DataFrame, held_words: int = HELD_WORDS) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of ``docs``.

    Counts and the network are of all training rows; a null id is a training row, a null text is empty (its end alone is
    scored), repeated rows count and score as often as they occur, other columns are not read, an empty table gives no rows.
    The probability of a word outside the network's vocabulary is that of the outcome "other" times its add-one share
    of the counts of all such words. Counts of the ``held_words`` most frequent words go to every task (a bound on
    what is broadcast); counts of the rest are joined.
    """
    rows = docs.select("doc_id", "text", F.expr(HELD.format("doc_id")).alias("held_out"))
    train = rows.where("not held_out")
    counts = stage(word_counts(train), "counts")
    v, n = counts.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    held = frequent(counts, held_words)
    first = [w for w in list(held)[: VOCAB - 1] if w != END]
    vocab = sorted([*first[: VOCAB - 1], END], key=lambda w: -held.get(w, 0))
    ids = Index.of(vocab, VOCAB)
    known = sum(held.get(w, 0) for w in vocab)
    other = (n - known) + (v - len(vocab)) + 1  # add-one total of the words outside the vocabulary
    share = np.full(VOCAB + 1, 1e-12)
    share[: len(vocab)] = [held.get(w, 0) + 1 for w in vocab]
    share[VOCAB] = max(other, 1)
    network = train_network(train, ids, np.log(share / share.sum()).astype(np.float32)).flat
    listed = list(dict.fromkeys([*vocab, *held]))  # the network's words first, so that a place below VOCAB is its word
    number = np.array([held.get(w, 0) for w in listed] + [0], np.int64)
    sent = docs.sparkSession.sparkContext.broadcast((Index.of(listed, len(listed)), number, len(vocab), network))
    total = float(n + v + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        keep_freed_memory()
        index, number, known, flat = sent.value
        net = Network()
        net.flat[:] = flat
        at = TaskContext.get().partitionId() << 40
        logs = np.log10(number + 1.0)
        for pdf in batches:
            if not len(pdf):
                continue
            codes, scores, size, rare, done = [], [], 0, [], 0
            for text in pdf["text"]:
                words = lower_words(text)
                words.append(END)
                own = index.encode(words)
                rare.append([words[k] for k in np.nonzero(number[own] == 0)[0]])
                if size > SCORED_AT_ONCE:
                    scores.append(net.score([np.where(c < known, c, VOCAB) for c in codes[done:]]))
                    done, size = len(codes), 0
                size += len(words)
                codes.append(own)
            scores = np.concatenate([*scores, net.score([np.where(c < known, c, VOCAB) for c in codes[done:]])]) / np.log(10.0)
            sizes = np.array([len(c) for c in codes])
            all_ = np.concatenate(codes)
            sums = lambda x: np.add.reduceat(x, np.cumsum(sizes) - sizes)
            have = number[all_] > 0
            outside = have & (all_ >= known)
            n_known = sums(have.astype(np.int64))
            base = sums(np.where(have, logs[all_], 0.0)) - n_known * np.log10(total)
            extra = sums(np.where(outside, logs[all_], 0.0)) - sums(outside.astype(np.int64)) * np.log10(max(other, 1))
            uid = at + np.arange(len(pdf))
            at += len(pdf)
            yield pd.DataFrame({"uid": uid, "doc_id": pdf["doc_id"].astype("Int64"), "held_out": pdf["held_out"], "n_tokens": sizes, "n_known": n_known, "base": base, "score": scores + extra, "rare": rare})

    part = stage(rows.mapInPandas(run, "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<binary>"), "scored")
    lone = part.select("uid", F.explode("rare").alias("word")).groupBy("uid", "word").agg(F.count("*").alias("f"))
    c = F.coalesce("c", F.lit(0))
    lone = lone.join(counts, "word", "left").groupBy("uid").agg(
        F.sum(F.when(c > 0, F.col("f")).otherwise(0)).alias("more"),
        F.sum(F.col("f") * (F.log10(c + 1.0) - float(np.log10(total)))).alias("base_more"),
        F.sum(F.col("f") * (F.log10(c + 1.0) - float(np.log10(max(other, 1))))).alias("score_more"),
    )
    zero = F.lit(0.0)
    out = part.join(lone, "uid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", zero)).alias("base_score"), (F.col("score") + F.coalesce("score_more", zero)).alias("score"),
    )
    return out
