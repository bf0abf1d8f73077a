"""Ranked search, byte shards and spelling variants against brute force, with nulls, ties, repeats, long texts and empty tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tempotext.llm import lexical as X, shards as S, variants as V

DOC = "doc_id long, text string, rank string, shard string, word string, n string"  # names that clash with results


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "r", "s", "w", "n") for i, t in rows], DOC)


def near(u, v):
    if u == v or abs(len(u) - len(v)) > 1:
        return False
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    u, v = sorted((u, v), key=len)
    return any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def forms(rows, misprint=31):
    count = Counter()
    for doc, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            if misprint and h % misprint == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    count = {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}
    form, out = {}, {}
    for w, n in count.items():
        others = sorted((-m, v) for v, m in count.items() if near(w, v))
        out[w] = (n, len(others))
        form[w] = others[0][1] if others and -others[0][0] >= 10 * n else None
    rows = set()
    for w, (n, n_near) in out.items():
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, n, n_near, count[form[w]] if form[w] else None))
    return rows


@pytest.mark.parametrize("most", [50_000, 6])
def test_variants_equal_brute_force(spark, most):
    rng = random.Random(most)
    base = ["".join(rng.choice("abézß×") for _ in range(rng.randint(6, 11))) for _ in range(60)]
    rows = []
    for i in range(120):
        said = [rng.choice(base[: 1 + rng.randrange(60)]) for _ in range(40)]
        for k in range(0, 40, 7):
            w, p = said[k], rng.randrange(6)
            said[k] = rng.choice([w[:p] + w[p + 1 :], w[:p] + "a" + w[p:], w[:p] + "b" + w[p + 1 :], w.upper()])
        rows.append((i, rng.choice([" ", "1", "中", "\U0001f600"]).join(said)))
    # one beginning for many words, runs of one letter, a word of 3000 letters, nulls, empty texts, repeated ids and texts
    rows += [(200 + i, " ".join(["commonword" + c, "commonwor" + c] * 2)) for i, c in enumerate("abcdefghijklmnop")]
    rows += [(300, "aaaaaaa aaaaaaaa aaaaaaaaa " * 30), (301, ("q" * 3000 + " ") * 2 + ("q" * 2999 + " ") * 2), (302, None), (303, ""), (None, "commonworda"), (5, rows[5][1]), (5, rows[5][1])]
    got = V.variants(docs(spark, rows), most=most).collect()
    assert {tuple(r) for r in got} == forms(rows) and len(got) == len(forms(rows))


def test_composed_acceptors_in_small_pieces(monkeypatch):
    monkeypatch.setattr(V, "FOLLOWED", 7)
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(7, 10))) for _ in range(150)})
    rows = sorted((m, back, w[len(w) - (m - m // 2) :] if back else w[: m // 2], w) for w in words for m in (len(w), len(w) - 1) if m >= 7 for back in (False, True))
    size, back, key, word = (np.array(x, dtype=t) for x, t in zip(zip(*rows), (np.int64, bool, object, object)))
    a, b = V.near_in(size, back, key, word)
    found = [tuple(sorted((word[i], word[j]))) for i, j in zip(a, b)]
    assert len(found) == len(set(found)) and set(found) == {(u, v) for u in words for v in words if u < v and near(u, v)}


def test_acceptor_is_minimal():
    words = np.array([b"walking", b"walks", b"talking", b"talks"], "S")
    words.sort()
    f = V.Acceptor(np.zeros(4, np.int64), words.view(np.uint8).reshape(4, -1), np.array([len(w) for w in words]))
    assert len(f.final) == 8  # one for each different rest: of nothing, w or t, a, l, k, i, n, and the end
    assert f.words[f.initial[0]] == 4


def test_variants_of_empty_tables(spark):
    assert V.variants(docs(spark, [])).collect() == []
    assert V.variants(docs(spark, [(1, None), (2, "short words only")])).collect() == []


def test_roots_follow_long_chains(spark):
    chain = [(f"w{k}", f"w{k + 1}") for k in range(11)] + [("x", "w3")]
    got = {r.word: r.root for r in V.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {**{f"w{k}": "w11" for k in range(11)}, "x": "w11"}


def shard_rows(rows, n=16):
    made = sorted(((i is not None, i or 0, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1), i) for i, t in rows)
    total, before, out, slots = sum(k[3] for k, _ in made), 0, [], Counter()
    for k, i in made:
        shard = (2 * before + k[3]) * n // (2 * total)
        out.append((i, k[3], k[2], "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += k[3]
    return out


def same(a, b):
    assert sorted(map(repr, a)) == sorted(map(repr, b))


@pytest.mark.parametrize("bits", [13, 3])
def test_byte_shards(spark, monkeypatch, bits):
    monkeypatch.setattr(S, "BLOCK_BITS", bits)
    monkeypatch.setattr(S, "GROUP", 2)
    rng = random.Random(bits)
    rows = [(rng.choice([None, 7, i]), "éx" * rng.randrange(60)) for i in range(400)] + [(None, "same")] * 200 + [(9, "中" * 30_000), (10, None), (11, "")]
    got = [tuple(r) for r in S.byte_shards(docs(spark, rows).repartition(5)).collect()]
    same(got, shard_rows(rows))


def test_byte_shards_of_few_and_no_rows(spark):
    assert S.byte_shards(docs(spark, [])).collect() == []
    same([tuple(r) for r in S.byte_shards(docs(spark, [(1, None)])).collect()], [(1, 1, 0, "bytes", 8, 0, None)])


def test_shards_are_balanced_and_native(spark):
    rows = [(i, "a" * (i * 37 % 101)) for i in range(3000)]
    out = S.byte_shards(docs(spark, rows))
    sizes = [r["sum(size)"] for r in out.groupBy("shard").sum("size").collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) <= 2 * 102
    assert "Python" not in out._jdf.queryExecution().toString() and "InPandas" not in out._jdf.queryExecution().toString()


def test_written_shards_hold_the_texts(spark, tmp_path):
    rows = [(i if i % 5 else None, f"text {i % 9}") for i in range(100)]
    S.write_shards(docs(spark, rows), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted((r.doc_id or -1, r.text) for r in back.collect()) == sorted((i or -1, t) for i, t in rows)
    assert {r.shard_ for r in back.collect()} == {0, 1, 2, 3} and {"rank", "word", "shard"} <= set(back.columns)


def search(rows, items, best=20):
    term = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
    made = [(i, Counter(term(t))) for i, t in rows if term(t)]
    n_docs, n_all = len(made), sum(sum(c.values()) for _, c in made)
    df = Counter(t for _, c in made for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in made:
            m = 75 + 25 * sum(c.values()) * n_docs // n_all
            score = sum(k * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, k in Counter(term(text)).items() if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(found)[:best])]
    return out


ITEMS = "item_id long, text string, doc_id string, score string"


@pytest.mark.parametrize("postings", [400_000, 60])
def test_ranks_equal_brute_force(spark, monkeypatch, postings):
    rng = random.Random(postings)
    word = lambda: f"{rng.choice(['W', 'w', 'é', '中'])}{int(rng.paretovariate(0.6)) % 400}"
    rows = [(i, rng.choice([" ", "_", "\n", "-"]).join(word() for _ in range(rng.randint(0, 60)))) for i in range(500)]
    rows += [(i, rows[3][1]) for i in range(600, 640)]  # many equal scores
    rows += [(700, "w1 w2 " * 30_000), (701, None), (702, ""), (703, " .,;"), (None, rows[3][1]), (5, rows[5][1]), (5, rows[5][1])]
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 40)))) for k in range(25)] + [(90, rows[3][1]), (91, None), (92, ""), (None, "w1 w2"), (3, "w1"), (3, "w2 w2"), (93, "unheard of")]
    if postings == 60:
        monkeypatch.setattr(X, "MOST_ITEMS", 7)
    blocks = X._blocks
    monkeypatch.setattr(X, "BLOCK_POSTINGS", postings)
    table = spark.createDataFrame([(k, t, "d", "s") for k, t in items], ITEMS)
    got = [tuple(r) for r in X.rank(docs(spark, rows).repartition(3), table).collect()]
    assert blocks is X._blocks
    same(got, search(rows, items))


def test_block_search_in_process():
    rng = np.random.default_rng(5)
    n, terms = 800, 30
    doc = np.repeat(np.arange(n), 12)
    term = np.concatenate([rng.choice(terms, 12, replace=False) for _ in range(n)])
    tf = rng.integers(1, 5, len(doc))
    weight = rng.integers(0, 4000, terms)
    m = rng.integers(75, 200, n)
    block = X.Block(np.arange(n), m, doc, term, tf, weight)
    asked, times = np.arange(0, terms, 3), rng.integers(1, 3, 10)
    best = X.Best(20)
    block.search(asked, times, best)
    score = np.zeros(n, np.int64)
    np.add.at(score, doc, weight[term] * ((10**9 * tf) // (1000 * tf + 12 * m[doc])) * np.where(term % 3 == 0, times[np.minimum(term // 3, 9)], 0))
    want = np.lexsort((np.arange(n), -score))[:20]
    assert best.ids.tolist() == want.tolist() and best.scores.tolist() == score[want].tolist()


def test_search_of_empty_tables(spark):
    empty, items = docs(spark, []), spark.createDataFrame([(1, "a b", "", "")], ITEMS)
    assert X.rank(empty, items).collect() == []
    assert X.rank(docs(spark, [(1, "a")]), items.limit(0)).collect() == []
    assert X.rank(docs(spark, [(1, "a")]), items).columns == ["item_id", "rank", "doc_id", "score"]
