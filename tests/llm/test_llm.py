"""Operators of tempotext.llm against brute force, round trips and planted cases, with nulls, ties, repeats and empty tables."""

import random
import time

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tempotext.llm import decontaminate as D, embed_dedup as E, html_extract as H, lm, mixing, queries, simhash as S, substring as B, toxicity as X, url_rules as U, warc as Wc

DOC = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(rng, n, size=3000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def docs(spark, texts, **more):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or "")) for i, t in texts], DOC)


def groups(n, links):
    label = list(range(n))
    for _ in range(n):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


def test_simhash_equals_brute_force(spark):
    rng = random.Random(1)
    base = words(rng, 300)
    texts = [" ".join(base)] * 3 + [" ".join(base[:k] + ["x"] + base[k + 1 :]) for k in range(0, 200, 9)] + [" ".join(words(rng, 20)) for _ in range(40)] + ["", None, "A b", "a B", "one"]
    got = {r.doc_id: r for r in S.simhash_components(docs(spark, list(enumerate(texts)))).collect()}

    def fp(t):
        w = (t or "").lower().split()
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    f = [fp(t) for t in texts]
    want = groups(len(f), [(a, b) for a in range(len(f)) for b in range(a) if (f[a] ^ f[b]).bit_count() <= 2])
    assert [got[i].fp % (1 << 64) for i in range(len(f))] == f
    assert [got[i].component_id for i in range(len(f))] == want


@pytest.mark.parametrize("radius", [0, 2, 5, 10])
def test_bit_planes(radius):
    rng = np.random.default_rng(radius)
    fp = rng.integers(0, 1 << 63, 150, dtype=np.uint64)
    fp[100:] = fp[:50] ^ (np.uint64(1) << rng.integers(0, 63, 50, dtype=np.uint64)) ^ np.uint64(6)
    i, j = S.close_pairs(fp, radius)
    want = {(a, b) for a in range(150) for b in range(a + 1, 150) if int(fp[a] ^ fp[b]).bit_count() <= radius}
    assert set(zip(i.tolist(), j.tolist())) == want


def test_heavy_bucket_loses_no_link(spark, monkeypatch):
    monkeypatch.setattr(S, "HEAVY", 8)
    rows = [(k,) for k in range(40)]
    links = S.fingerprint_links(spark.createDataFrame(rows, "fp long"), 1, S.exact_masks(1, 3)).collect()
    assert groups(40, [(r.a, r.b) for r in links]) == [0] * 40


def test_keep_one(spark):
    rng = random.Random(2)
    base = words(rng, 400)
    near = " ".join(base[:200] + ["new"] + base[201:])
    alone = " ".join(words(rng, 400))
    d = docs(spark, [(1, " ".join(base)), (2, near), (3, alone), (3, "again"), (3, alone), (None, "no id"), (None, near), (None, "no id"), (3, near)])
    got = S.keep_one(d).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, " ".join(base)), (3, alone), (3, "again"), (None, "no id")], key=str)
    assert S.keep_one(d.limit(0)).count() == 0


def test_stages_judge_rows_one_by_one_with_clashing_columns(spark):
    rng = random.Random(41)
    item = words(rng, 40, 20000)
    mk = lambda mid: " ".join(words(rng, 60, 20000) + mid + words(rng, 60, 20000))
    clean, leak = mk([]), mk(item)
    rows = [(1, clean), (2, leak), (2, mk([])), (None, mk(item)), (None, mk([])), (4, None), (4, ""), (2, leak)]
    d = docs(spark, rows)
    for c in ("row_id", "spans", "new", "toxicity", "row_id_"):
        d = d.withColumn(c, d.doc_id)
    b = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    kept = D.drop_leaks(d, b)
    assert kept.columns == d.columns
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [rows[k] for k in (0, 2, 4, 5, 6)]))
    p = words(rng, 80, 10**6)
    d2 = docs(spark, [(5, mk(p)), (7, mk(p)), (7, mk([])), (None, mk(p)), (None, None)]).withColumn("spans", F.lit(1)).withColumn("new", F.lit(2))
    left = B.cut_passages(d2).collect()
    assert len(left) == 5 and sorted(len((r.text or "").split()) for r in left) == [0, 120, 120, 120, 200] and all(r.spans == 1 and r.new == 2 for r in left)
    assert next(r for r in left if len((r.text or "").split()) == 200).doc_id == 5
    lab = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert X.drop_toxic(d, lab).count() == len(rows) and X.drop_toxic(d, lab).columns == d.columns
    m = mixing.mix(d.withColumn("keep_0", F.lit(3)), keep=("source", "keep_0"))
    assert m.columns[-2:] == ["source", "keep_0"] and m.count() == len(rows)


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(12)
    texts = []
    for _ in range(40):  # lone pairs around similarity 0.8, where fingerprints of 64 bits are wider apart than 10 about as often as not
        base = words(rng, 150)
        at = rng.sample(range(0, 150, 6), rng.choice([2, 3, 4]))
        texts += [" ".join(base), " ".join("new" if k in at else w for k, w in enumerate(base))]
    base = words(rng, 120)
    texts += [" ".join(base[: 20 * k] + ["x"] + base[20 * k + 1 :]) for k in range(6)] + ["", None, "A b", "a B", "one"]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in ((t or "").lower().split() for t in texts)]
    same = lambda x, y: x == y or 5 * len(x & y) >= 4 * len(x | y)
    want = groups(len(texts), [(a, b) for a in range(len(texts)) for b in range(a) if same(sets[a], sets[b])])
    got = {r.doc_id: r.component_id for r in S.near_copies(docs(spark, list(enumerate(texts)))).collect()}
    assert [got[i] for i in range(len(texts))] == want


def test_cosine_links_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 8))
    x[20:40] = x[:20] + rng.normal(size=(20, 8)) * 0.1
    rows = [(i, [float(v) for v in row], i % 2) for i, row in enumerate(x)] + [(60, None, 0), (61, [0.0] * 8, 0), (62, [float("nan")] * 8, 0), (63, [1.0] * 8, None), (64, [float(v) for v in x[0]], 0), (65, [1.0, 2.0], 0), (66, [None, 1.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r for r in E.cosine_links(df, tile=7).collect()}
    ok = [i for i, (_, v, l) in enumerate(rows) if v and l is not None and all(a is not None and np.isfinite(a) for a in v) and any(v)]
    cos = lambda a, b: np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b))
    links = [(a, b) for a in ok for b in ok if b < a and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]) and cos(rows[a][1], rows[b][1]) >= 0.98]
    want = groups(len(rows), links)
    assert [got[i].component_id for i in range(len(rows))] == want
    assert [got[i].n_links for i in range(len(rows))] == [sum(i in p for p in links) for i in range(len(rows))]
    assert all(got[i].kept == (want[i] == i) for i in got) and E.cosine_links(df.limit(0)).count() == 0


def test_cosine_links_of_one_hot_label(spark):
    rng = np.random.default_rng(13)
    x = np.repeat(rng.normal(size=(50, 6)), 8, axis=0) + rng.normal(size=(400, 6)) * 0.08
    df = spark.createDataFrame([(i, [float(v) for v in row], 7, 0) for i, row in enumerate(x)] + [(None, [1.0] * 6, 7, 0)], "vec_id long, embedding array<double>, label int, key int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.98) & ~np.eye(400, dtype=bool)
    got = {r.vec_id: r for r in E.cosine_links(df, tile=16).collect()}
    want = groups(400, [(int(a), int(b)) for a, b in zip(*np.nonzero(near)) if b < a])
    assert near.sum() > 1000 and [got[i].n_links for i in range(400)] == near.sum(1).tolist() and [got[i].component_id for i in range(400)] == want and None in got


def test_urls_by_both_paths(spark):
    rng = random.Random(4)
    rules = [(h, p, rng.choice(["allow", "block"])) for h in ("com", "a.com", "b.a.com", "org") for p in ("/", "/en/", "/en/x/", "")] + [(None, "/", "block")]
    hosts = ["com", "a.com", "x.A.com", "b.a.com", "c.b.a.com", "org", "q.org", "ba.com", "net"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/en/', '/en/x/y?z#/q', '/enx'])}" for _ in range(300)] + [None, "nothing", "://a.com/en/", ""]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    table = spark.createDataFrame(rules, "host string, path string, verdict string")

    def brute(u):
        if u is None or "://" not in u:
            return "", "", None, "allow"
        rest = u.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host, tail = rest[:cut].lower(), rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h and (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best and best[3], best[2] if best else "allow"

    want = {i: brute(u) for i, u in enumerate(urls)}
    for small in (1000, 0):
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df, table, small_rules=small).collect()}
        assert got == want


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 2000
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://c/", None), (4, "http://d/", "short"), (5, "x", "short"), (None, "y", big), (7, "z", "x" * (17 << 20))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in Wc.round_trip(df, str(tmp_path / "w")).collect()}
    assert len(got) == 7 and [got[k].record_type for k in (1, 2, None, 3, 4, 5, 7)] == ["revisit", "response", "revisit", *["response"] * 4]
    assert got[1].refers_to == 2 and bytes(got[2].payload) == big.encode() and got[1].payload_bytes == len(big.encode()) and got[7].payload_bytes == 17 << 20
    import gzip

    files = list((tmp_path / "w").glob("part-*"))
    assert sum(gzip.decompress(f.read_bytes()).count(b"WARC/1.1\r\n") for f in files) == 7
    with pytest.raises(ValueError):
        Wc.parse_record(b"WARC/1.1\r\nContent-Length: 5\r\n\r\nabc\r\n\r\n")


def test_html():
    page = """<html><head><title>t</title></head><body><header>Site of the day</header><nav><a href=/>Home</a></nav><div class="ad">Buy the best of the things that are for you and for all of them now</div>
    <article><h1>Big&amp;bold</h1><p>The   cat and the dog were in the house for all of the time that they had, and it was good.<p>Short one.</p><script>if (a<b) "</p>";</script><div class="comments"><p>The worst of all the things that I have ever read in the whole of my life, and it is not for me.</p></div></article>
    <footer>The end</footer><!-- x --></body></html>"""
    assert H.main_text(page) == "Big&bold The cat and the dog were in the house for all of the time that they had, and it was good. Short one."
    assert H.main_text(None) == "" and H.main_text("") == "" and H.main_text("<p") is not None
    assert H.main_text("<a" * 20000) is not None


PROSE = "The cat and the dog were in the house for all of the time that they had, and it was good for them."
OTHER = "Kissa ja koira olivat talossa koko sen ajan, jonka heilla oli, eika kukaan tiennyt mita tapahtuisi seuraavaksi, kun aurinko laski metsan taakse ja ilta pimeni hiljalleen. " * 2


@pytest.mark.parametrize("page, want", [
    (f"<html><head><title>t</title><body><h1>T</h1><p>{PROSE}", f"T {PROSE}"),  # no end of the head
    (f"<head><title>t</title>bare {PROSE}", f"bare {PROSE}"),
    (f"<body><div class='content no-sidebar'><p>{PROSE}</div><div class='sidebar'><p>{PROSE} aside</div>", PROSE),
    (f"<body class=sidebar><div id='page' class='with-social'><p>{PROSE}</div><div class=social>Share</div>", PROSE),
    (f"<body><div class='sidebar layout'><main><p>{PROSE}</main></div>", PROSE),
    (f"<body><div id=c><h1>Otsikko</h1><p>{OTHER}<p>{OTHER}</div><nav>x</nav>", f"Otsikko {OTHER}{OTHER}".strip()),  # none of the listed languages
    (f'<body><article><img alt="{"x > y " * 4000}"><p>{PROSE}</article>', PROSE),  # a very long attribute
    (f"<body><ul><li class=ad><p>Buy<li><p>{PROSE}</ul>", PROSE),  # end tags left out
    (f"<body><article><p>{PROSE}<p>{PROSE}<p>Near it.<p>Between.<div class=x><a href=1>{PROSE}</a></div></article>", f"{PROSE} {PROSE} Near it."),  # the nearest decides
])
def test_html_pages(page, want):
    assert H.main_text(page) == want


def test_extract(spark):
    page = f"<body><article><p>{PROSE}</article>"
    long_ = "<body><article>" + f"<p>{PROSE}" * 3000 + "</article>"
    rows = [(1, "u", page), (1, "u", page), (None, None, page), (2, "u", None), (3, "u", ""), (4, "u", long_)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("other")).withColumn("n_chars", F.lit(0))
    got = sorted(((r.page_id or 0, r.text, r.n_chars) for r in H.extract(d).collect()), key=str)
    assert got == sorted([(i or 0, t, len(t)) for i, t in ((1, PROSE), (1, PROSE), (None, PROSE), (2, ""), (3, ""), (4, " ".join([PROSE] * 3000)))], key=str)
    assert H.extract(d.limit(0)).count() == 0


GOOD = "The cat and the dog were in the house for all of the time that they had, and it was good. " * 3


@pytest.mark.parametrize("page", ["<div>" * 20_000 + GOOD, "<div>" * 20_000 + GOOD + "</b>" * 20_000, "<div class='box menu'><p>x</p>" * 20_000 + "<article><p>" + GOOD, "".join(f"<article><p>short {k}</p></article>" for k in range(4000)) + f"<article><p>{GOOD}"])
def test_html_of_deep_and_many_elements_is_read_in_linear_time(page):
    began = time.process_time()
    assert H.main_text(page).endswith(GOOD.strip())
    assert time.process_time() - began < 3


def test_names_alone_do_not_empty_a_page():
    assert H.main_text(f'<div id="search-results-page"><p>{GOOD}</p></div>') == GOOD.strip()
    assert H.main_text(f'<div class="sidebar"><p>{GOOD}</p></div><div><p>{GOOD}</p></div>') == GOOD.strip()
    assert H.main_text(f'<nav><p>{GOOD}</p></nav>') == ""


def test_mixing_of_many_null_and_repeated_ids(spark):
    """Half of the rows have no id, a third one id, texts repeat: no window is by source, id or key, and the words add up."""
    rows = [(None if k % 2 else 7 if k % 3 else k, " ".join(["w"] * (k % 5))) for k in range(6000)]
    d = docs(spark, rows).withColumn("source", F.when(F.col("n_chars") > 4, "a"))
    out = mixing.mix(d.repartition(3), keep=("source",))
    got = out.collect()
    assert len(got) == 6000 and sorted(map(str, got)) == sorted(map(str, mixing.mix(d, keep=("source",)).collect()))
    for name in (None, "a"):
        own = [r for r in got if r.source == name]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1 and all(r.taken <= 2 * r["size"] for r in own)


def test_mixing(spark):
    rng = random.Random(5)
    d = spark.createDataFrame([(i, " ".join(["w"] * rng.randrange(30)), ["a", "b", None, "d"][i % 4]) for i in range(200)] + [(3, None, "a"), (3, None, "a"), (None, "x y", "b")], "doc_id long, text string, source string")
    rows = mixing.mix(d).collect()
    assert len(rows) == 203 and sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(d.repartition(3)).collect()), key=str)
    by = {}
    for r in rows:
        assert 0 <= r.taken <= 2 * r.size
        t = by.setdefault((r.target, r.source_size), [0, 0])
        t[0] += r.taken
        t[1] += r.size
    assert all(t[0] == int(k[0]) and t[1] == k[1] for k, t in by.items())
    assert mixing.mix(d.limit(0)).count() == 0


def test_leaks(spark):
    rng = random.Random(6)
    items = [(k, " ".join(words(rng, 40, 20000)) + ".") for k in range(30)] + [(30, None), (31, "")]
    text = lambda k, cut: " ".join(words(rng, 500, 20000) + items[k][1].split()[:cut] + words(rng, 300, 20000))
    d = docs(spark, [(0, text(3, 40)), (1, text(4, 15)), (2, " ".join(words(rng, 800, 20000))), (3, ""), (4, None), (5, items[7][1].upper())])
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in D.leaks(d, b).collect()} == {(0, 3), (5, 7)}
    assert {r.doc_id for r in D.drop_leaks(d, b).collect()} == {1, 2, 3, 4}
    assert D.leaks(d, b.limit(0)).count() == 0


def test_wand_equals_full_scoring():
    rng = random.Random(7)
    ix = D.Index.build([(k, " ".join(words(rng, 30, 120))) for k in range(300)])
    for _ in range(30):
        terms = sorted({ix.term[w] for w in words(rng, 60, 120) if w in ix.term})
        full = np.zeros(300)
        for t in terms:
            full[ix.items[t]] += ix.impact[t]
        got = dict(ix.search(terms, 0.4))
        assert set(got) == set(np.nonzero(full >= 0.4 - 1e-12)[0]) and all(abs(full[k] - v) < 1e-9 for k, v in got.items())


def test_passages(spark):
    rng = random.Random(8)
    p = words(rng, 80, 10**6)
    fuzzy = p[:30] + ["new"] + p[31:55] + ["add"] + p[55:]
    mk = lambda a, mid, b: " ".join(words(rng, a, 10**6) + mid + words(rng, b, 10**6))
    d = docs(spark, [(1, mk(100, p, 20)), (2, mk(7, fuzzy, 300)), (3, mk(50, p[:30], 50)), (4, " ".join(p)), (5, None), (6, ""), (None, " ".join(p))])
    got = {r.doc_id: r for r in B.passages(d).collect()}
    assert set(got) == {2, 4} and (got[2].start_word, got[2].end_word) == (7, 88) and (got[2].first_start, got[2].first_end) == (100, 180) and got[4].identity == 1.0
    left = {r.doc_id: r for r in B.cut_passages(d).collect()}
    assert set(left) == {1, 2, 3, 5, 6} and len(left[2].text.split()) == 307 and left[2].n_chars == len(left[2].text)


def test_passage_of_pieces_in_earlier_documents(spark):
    for seed in range(5):
        rng = random.Random(20 + seed)
        p = words(rng, 60, 10**6)
        mk = lambda a, mid, b: " ".join(words(rng, a, 10**6) + mid + words(rng, b, 10**6))
        d = docs(spark, [(1, mk(60, p[:30], 40)), (2, mk(20, p[30:], 70)), (3, mk(90, p, 30)), (4, mk(33, p, 80)), (5, mk(11, p[:30], 80)), (6, mk(70, p[5:], 9))])
        got = {(r.doc_id, r.start_word, r.end_word, r.first_doc) for r in B.passages(d).collect()}
        assert {(4, 33, 93, 3), (6, 70, 125, 3)} <= got and {x[0] for x in got} == {4, 6}


def test_fuzzy_passages(spark):
    rng = random.Random(31)
    rows, want = [], set()
    for k in range(60):  # 80 words of which one in ten differs
        p = words(rng, 80, 10**6)
        fuzzy = [f"new{rng.random()}" if i in (7, 15, 23, 31, 40, 48, 56, 64) else w for i, w in enumerate(p)]
        rows += [(2 * k, " ".join(words(rng, 70, 10**6) + p + words(rng, 70, 10**6))), (2 * k + 1, " ".join(words(rng, 70, 10**6) + fuzzy + words(rng, 70, 10**6)))]
        want.add((2 * k + 1, 70, 150, 2 * k))
    assert {(r.doc_id, r.start_word, r.end_word, r.first_doc) for r in B.passages(docs(spark, rows)).collect()} == want


@pytest.mark.parametrize("hot, held", [(3, 200_000), (10**9, 10)])
def test_hot_seeds_lose_no_copy(spark, monkeypatch, hot, held):
    monkeypatch.setattr(B, "SAMPLE", 1)
    monkeypatch.setattr(B, "HOT", hot)
    monkeypatch.setattr(B, "MOST_HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7 if held == 10 else 10_000)
    rng = random.Random(32)
    p = words(rng, 60, 10**6)
    d = docs(spark, [(k, " ".join(words(rng, 30, 10**6) + p + words(rng, 30, 10**6))) for k in range(5, 100)])
    got = B.passages(d).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    assert {r.doc_id for r in got if (r.start_word, r.end_word, r.first_start, r.first_end) == (30, 90, 30, 90)} == set(range(6, 100)) and all(r.first_doc < r.doc_id for r in got)


def test_toxicity(spark):
    rng = random.Random(9)
    rows, labels = [], []
    for i in range(600):
        w = words(rng, 60, 400)
        toxic = i % 4 == 0
        if toxic:
            w[30] = "blockhead" + rng.choice(["s", "", "ed"])
        rows.append((i, " ".join(w[:30]) + ". " + " ".join(w[30:])))
        labels.append((i, 1, int(toxic)))
    d, lab = docs(spark, [*rows, (700, None), (701, ""), (None, "x")]), spark.createDataFrame(labels + [(None, 1, 1), (702, None, None)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in X.classify(d, lab).collect()}
    assert all(got[i].predicted == t for i, _, t in labels) and got[700].score == 0 and got[701].score == 0 and sum(r.held_out for r in got.values()) > 50
    spans = X.offending_sentences(d, X.fit(d, lab)).collect()
    assert {r.doc_id for r in spans} == {i for i, _, t in labels if t} and all(r.start > 0 for r in spans)
    assert X.classify(d, lab.limit(0)).where("score > 0").count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    net = lm.Network(np.log(np.full(lm.VOCAB + 1, 1 / (lm.VOCAB + 1))).astype(np.float32))
    y = rng.integers(0, lm.VOCAB + 1, (5, 3))
    x, mask, start = np.roll(y, 1, 0), np.ones((5, 3), np.float32), np.zeros((5, 3), bool)
    start[0], start[2, 1] = True, True
    h0 = np.zeros((3, lm.STATE), np.float32)
    grad, _, _ = net.step(x, y, mask, start, h0)
    at = np.argsort(-np.abs(grad))[[0, 40, 200, 800]]
    for k in at:
        keep, loss = net.flat[k], []
        for e in (1e-2, -1e-2):
            net.flat[k] = keep + e
            loss.append(net.step(x, y, mask, start, h0)[2])
        net.flat[k] = keep
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[k]) < 0.05 * max(0.1, abs(grad[k]))


def test_lm_counts_and_scores(spark):
    d = docs(spark, [(i, t) for i, t in enumerate(["a b a", "A c", "", None, "zz yy a"] * 12)])
    rows = {r.doc_id: r for r in lm.score_documents(d, held_words=2).collect()}
    import zlib

    train = [(t or "").lower().split() + ["\n"] for i, t in enumerate(["a b a", "A c", "", None, "zz yy a"] * 12) if zlib.crc32(str(i).encode()) % 7 != 2]
    from collections import Counter

    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(["a b a", "A c", "", None, "zz yy a"] * 12):
        w = (t or "").lower().split() + ["\n"]
        r = rows[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 7 == 2) and r.n_tokens == len(w) and r.train_tokens == n
        assert abs(r.base_score - sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w)) < 1e-9 and r.score < 0


def test_lm_learns_from_every_training_document(spark):
    rng = random.Random(33)
    rows = [(i, " ".join(words(rng, 40, 50))) for i in range(60)]
    score = lambda r: {x.doc_id: x.score for x in lm.score_documents(docs(spark, r).coalesce(1)).collect()}
    first = score(rows)
    assert first == score(rows)
    for k in (0, 31, 59):  # the same words in another order: the counts stay, what the network learns does not
        other = [(i, " ".join(reversed(t.split())) if i == k else t) for i, t in rows]
        changed = score(other)
        held = [i for i in first if i != k and abs(changed[i] - first[i]) > 1e-7]
        import zlib

        assert bool(held) == (zlib.crc32(str(k).encode()) % 7 != 2)


def test_lane_scoring_equals_plain_loop():
    rng = np.random.default_rng(5)
    net = lm.Network(np.log(np.full(lm.VOCAB + 1, 1 / (lm.VOCAB + 1))).astype(np.float32))
    net.flat += rng.normal(0, 0.3, len(net.flat)).astype(np.float32)
    end = 7
    texts = [np.append(rng.integers(0, lm.VOCAB + 1, n), end).astype(np.int32) for n in (0, 1, 3, 40, 90, 31, 32, 33)]

    def plain(text):
        h, before, total = np.zeros((1, lm.STATE), np.float32), end, 0.0
        for w in text:
            h = net.gates((net.E @ net.W + net.b)[[before]], h)[0]
            logits = (h @ net.C + net.c)[0].astype(float)
            k = min(int(w) // (lm.VOCAB // lm.CLASSES), lm.CLASSES)
            total += logits[k] - np.log(np.exp(logits).sum())
            if k < lm.CLASSES:
                inner = (h @ net.O[k] + net.o[k])[0].astype(float)
                total += inner[int(w) % (lm.VOCAB // lm.CLASSES)] - np.log(np.exp(inner).sum())
            before = w
        return total

    assert np.allclose(net.score(texts), [plain(t) for t in texts], rtol=1e-4)
    net.c[:] = 200.0  # large logits stay finite
    assert np.isfinite(net.score(texts)).all()


def test_frequent_words_are_exactly_the_most_frequent(spark):
    rows = [(f"w{k}".encode(), 5) for k in range(50)] + [(b"x", 9), (b"y", 9), (b"z", 1000), *[(f"q{k}".encode(), 4) for k in range(30)]]
    table = spark.createDataFrame(rows, "word binary, c long")
    for most in (0, 1, 2, 3, 10, 52, 53, 60, 83, 100):
        got = lm.frequent(table, most)
        assert len(got) == min(most, 83) and sorted(got.values(), reverse=True) == sorted((c for _, c in rows), reverse=True)[:most]
        assert set(got) <= set(lm.frequent(table, most + 1))


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    cur = con.execute(queries.SQL[name])
    cols = [x[0] for x in cur.description]
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, cur.fetchall()))


def test_pipeline_keeps_columns(spark):
    import corpus_pipeline as P

    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = d
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, out, SF)
        assert out.columns == d.columns
    assert 0 < P.run(spark, SF).count() <= d.count()
    empty = d.limit(0)
    for name, stage in P.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_logits_large_or_small_give_the_same_probabilities():
    """Large logits are levelled row by row, small ones are raised as they are: log probabilities equal the plain formula either way."""
    import numpy as np

    from tempotext.llm import lm

    rng = np.random.default_rng(7)
    size = lm.VOCAB // lm.CLASSES
    for scale in (1.0, 200.0):
        net = lm.Network()
        net.flat[:] = rng.normal(0, 0.3, len(net.flat)) * scale
        h = rng.uniform(-1, 1, (300, lm.STATE)).astype(np.float32)
        y = rng.integers(0, lm.VOCAB + 1, 300)
        want = []
        for state, word in zip(h.astype(float), y):
            c = state @ net.C.astype(float) + net.c
            k = min(word // size, lm.CLASSES)
            p = c[k] - np.logaddexp.reduce(c)
            if k < lm.CLASSES:
                o = state @ net.O[k].astype(float) + net.o[k]
                p += o[word % size] - np.logaddexp.reduce(o)
            want.append(p)
        assert np.allclose(net.log_probs(h, y), want, rtol=1e-4, atol=1e-3)


def test_training_steps_reuse_memory():
    """A step of training takes its arrays from memory that the step before has freed: hardly any page faults, in a process of its own."""
    import subprocess
    import sys

    code = """
import resource, numpy as np
from tempotext.llm import lm
lm.keep_freed_memory()
rng = np.random.default_rng(2)
net, h = lm.Network(np.log(np.full(lm.VOCAB + 1, 1 / (lm.VOCAB + 1))).astype(np.float32)), np.zeros((lm.STREAMS, lm.STATE), np.float32)
x = rng.integers(0, lm.VOCAB + 1, (lm.STEPS, lm.STREAMS)).astype(np.int32)
for k in range(12):
    if k == 2:
        before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    _, h, _ = net.step(x, x[::-1], np.ones(x.shape, np.float32), rng.random(x.shape) < 0.01, h)
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""
    faults = int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout)
    assert faults < 3000  # ten steps; each faulted in more than a thousand pages before


def test_gradient_equals_plain_loop():
    """Gradients of the arrays stored by column equal differences of the loss in every group of parameters, with resets and words left out."""
    rng = np.random.default_rng(4)
    net = lm.Network(np.log(np.full(lm.VOCAB + 1, 1 / (lm.VOCAB + 1))).astype(np.float32))
    net.flat += rng.normal(0, 0.2, len(net.flat)).astype(np.float32)
    x, y = rng.integers(0, lm.VOCAB + 1, (2, 6, 5))
    mask, start = (rng.random((6, 5)) < 0.8).astype(np.float32), rng.random((6, 5)) < 0.3
    h = rng.normal(0, 0.5, (5, lm.STATE)).astype(np.float32)
    grad = net.step(x, y, mask, start, h)[0]
    at = 0
    for shape in net.shapes.values():
        size = int(np.prod(shape))
        k = at + int(np.argmax(np.abs(grad[at : at + size])))
        keep, loss = net.flat[k], []
        for e in (1e-2, -1e-2):
            net.flat[k] = keep + e
            loss.append(net.step(x, y, mask, start, h)[2])
        net.flat[k] = keep
        assert abs((loss[0] - loss[1]) / 2e-2 - grad[k]) < 0.03 * max(0.1, abs(grad[k]))
        at += size
