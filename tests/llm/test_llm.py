"""The training-data operators against brute force, round trips and held-out accuracy."""

import base64
import collections
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pactlens.llm import ann, byte_bpe, decontaminate, entries, html_extract, jaccard_join, langid, license_scan, substring_dedup, token_store, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, k long, h long, rest string, score double"
ODD = [None, "", " \n\t ", "one", "Ünï çödé 漢字 🙂", "the same text again and again " * 30, "the same text again and again " * 30, "x" * 20000, "word " * 5000]


def odd_docs(spark, rows=ODD):
    """Nulls, empty and long texts, repeated rows, columns whose names clash."""
    data = [(i if i != 3 else None, t, "en", None, len(t or ""), 1, 2, "r", 0.5) for i, t in enumerate(rows)]
    return spark.createDataFrame(data + data[-3:-2], DOCS) if rows else spark.createDataFrame([], DOCS)


def test_byte_bpe_equals_tiktoken(spark):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    bpe = byte_bpe.tokenizer(path, P.PATTERN)
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    rng = random.Random(1)
    alphabet = "aaab the  e\n\t1234.,!?'s've éß漢字🙂  \x1c\x85ıΣn't"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(400)] + ["ab" * 400, "\n" * 50] + ODD[3:]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), "<u4").tolist() == own.encode_ordinary(t)
        assert bpe.decode(bpe.encode(t)) == t.encode()
    out = byte_bpe.round_trip_digests(odd_docs(spark), path, P.PATTERN).collect()
    assert collections.Counter(r.decoded_sha256 for r in out) == collections.Counter(hashlib.sha256((r.text or "").encode()).hexdigest() for r in odd_docs(spark).collect())
    back = byte_bpe.decode(byte_bpe.encode(odd_docs(spark), path, P.PATTERN), path, P.PATTERN)
    assert {bytes(r.bytes).decode() for r in back.collect()} == {t or "" for t in ODD}
    assert not byte_bpe.round_trip_digests(odd_docs(spark, []), path, P.PATTERN).count()


def test_token_store(spark):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    docs = odd_docs(spark).select("doc_id", "text")
    manifest, folder = token_store.write_shards(docs, path, 1, max_docs=3)
    got = token_store.read_shards(manifest, folder).orderBy("start").collect()
    ids = {t: library.encode(t or "", add_special_tokens=False).ids + [1] for t in ODD}
    want = collections.Counter((r.doc_id, len(ids[r.text]), zlib.crc32(np.array(ids[r.text], "<u4").tobytes())) for r in docs.collect())
    assert collections.Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.start for r in got] == [0, *np.cumsum([r.n_tokens for r in got])[:-1].tolist()]
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in got), key=lambda x: (x is not None, x))
    asked = spark.createDataFrame([(0,), (6,), (6,), (7,), (None,), (10**9,), (-5,)], "doc_id long")
    found = token_store.lookup(manifest, folder, asked).collect()
    want = collections.Counter((r.doc_id, tuple(ids[r.text])) for r in docs.collect() if r.doc_id in (0, 6, 7, None))
    assert collections.Counter((r.key, tuple(r.ids)) for r in found) == want
    m, f = token_store.write_shards(odd_docs(spark, []), path, 1)
    assert token_store.read_shards(m, f).count() == token_store.lookup(m, f, asked).count() == 0


def test_token_store_finds_keys_in_their_shards(spark):
    docs = spark.createDataFrame([(i // 2 * 3, f"w{i} x") for i in range(400)], "doc_id long, text string")
    manifest, folder = token_store.write_shards(docs, P.path("word_bpe_49k.json"), 1, max_docs=7)
    assert manifest.count() > 50
    found = token_store.lookup(manifest, folder, spark.range(-10, 700).toDF("doc_id"))
    assert collections.Counter(r.key for r in found.collect()) == {k: 2 for k in range(0, 600, 3)}


def test_perfect_hash_is_minimal():
    h = token_store.key_hash(np.arange(5000), np.zeros(5000, bool), np.zeros(5000, int))
    table, _ = token_store.PerfectHash.load(token_store.PerfectHash.build(h).dump())
    assert sorted(table.slots(h).tolist()) == list(range(5000))


def cut_words(rows, window):
    words = [(t or "").encode().split() for _, t in rows]
    seen = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, words):
        cut = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                cut[i : i + window] = [True] * window
        out.append((d, len(w), sum(cut), b" ".join(x for x, z in zip(w, cut) if not z)))
    return collections.Counter(out)


@pytest.mark.parametrize("window", [10, 35])
def test_substrings(spark, window):
    rng = random.Random(window)
    base = [str(rng.randint(0, 999)) for _ in range(500)]
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for i in range(60, 140):
        a = rng.randint(0, 480)
        rows.append((i, " ".join([str(i)] + base[a : rng.randint(a, 500)] + [f"z{i}"] + base[: rng.randint(0, 40)])))
    rows += [(r.doc_id, r.text) for r in odd_docs(spark).collect()]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id long, text string"), window)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, bytes(r.kept)) for r in got.collect()) == cut_words(rows, window)


def test_factors_are_the_longest_from_the_left():
    packed = lambda *spans: np.array([lo << 31 | hi for lo, hi in spans], np.int64)
    assert substring_dedup.factor(packed(), 5) == []
    assert substring_dedup.factor(packed((3, 3), (0, 2), (0, 4), (9, 9)), 5) == [(0, 9), (9, 5)]
    rng = random.Random(5)
    for _ in range(200):
        spans = [(a, a + rng.randint(0, 9)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        found = substring_dedup.factor(packed(*spans), 4)
        want = {w for lo, hi in spans for w in range(lo, hi + 4)}
        assert set(np.flatnonzero(substring_dedup.covered(80, found))) == want
        assert all(n >= 4 for _, n in found) and found == sorted(found)


def test_substrings_empty_and_carry(spark):
    assert substring_dedup.dedup_substrings(odd_docs(spark, [])).count() == 0
    assert substring_dedup.dedup_substrings(odd_docs(spark), carry=("rest", "h", "k")).select("rest.h").distinct().count() == 1


def components(rows, n, num, den):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * len(sets[i] | sets[j]):
                top[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return collections.Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (2, 60, 100)])
def test_jaccard(spark, n, num, den):
    rng = random.Random(n)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for size in (3, 10, 14, 40, 150):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for _ in range(6):
                v = list(base)
                for _ in range(rng.choice([0, 0, 1, 1, 2, size // 25])):
                    v[rng.randrange(size)] = rng.choice(words)
                rows.append((len(rows) * 7 % 1999, " ".join(v)))
    rows += [(r.doc_id, r.text) for r in odd_docs(spark).where("doc_id is null or doc_id > 1").withColumn("doc_id", F.col("doc_id") + 5000).collect()]
    got = jaccard_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), n, num, den).collect()
    assert collections.Counter(tuple(r)[:3] for r in got) == components(rows, n, num, den)


def test_one_of_each(spark):
    kept = jaccard_join.one_of_each(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns
    assert collections.Counter(r.text for r in kept.collect()) == collections.Counter(dict.fromkeys(ODD, 1))
    assert jaccard_join.one_of_each(odd_docs(spark, [])).count() == 0


def test_decontamination(spark):
    b = spark.createDataFrame([(1, "A train with Alice Smith travels 60 miles in 3 hours. What is its average speed, in miles an hour, if it rests for 10 minutes?"), (2, "short one"), (3, None), (4, "Each of these six words counts")], "item_id long, text string")
    texts = ["x y. A train with Bob travels 75 km in 5 hours. What is its average speed, in miles an hour, if it rests for 12 minutes? yes", "we say each of these six words counts, ok", "1 2 3 4 5 6 7 8 9 10 11 12", *ODD]
    docs = odd_docs(spark, texts)
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(docs, b).collect()}
    assert got == {(0, 1): False, (1, 4): True}
    clean = decontaminate.clean(docs, b)
    assert clean.columns == docs.columns and clean.count() == docs.count() - 2
    assert decontaminate.clean(docs, b.limit(0)).count() == docs.count()


def test_decontamination_of_items_with_few_words(spark):
    items = ["Compute 12 + 7 - 3 + 9", "What is 15 % of 240?", "Solve 3 x + 5 = 20 for x", "Convert 60 miles to km", "If 3 + 4 = 7 and 5 + 6 = 11 what is 7 + 8?", "Name Boyle's law", "17 23 5", "Who wrote Emma?", "!?"]
    texts = [f"some words before {t} and some after" for t in items] + ["Now. What is 20 % of 300? Yes", "Solve 4 x + 6 = 20 for x", "please convert 75 km to km", "If 3 + 4 = 7 and 5 + 6 = 11 what is 3 + 8?", "18 24 6", None]
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.verbatim) for r in decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b).collect()}
    assert got == {(i, i): (1.0, True) for i in range(8)} | {(9, 1): (1.0, False), (10, 2): (1.0, False), (11, 3): (1.0, False)}


@pytest.mark.parametrize("blank", ["\t", "\x0b", "\x0c", "\r", "\r\n", "\xa0", "\u2003", " \t\xa0"])
def test_decontamination_at_other_blanks(blank):
    item = "a train with two coaches travels 60 miles in 3 hours and then rests; what is its average speed?"
    h, kind, raw = decontaminate.template(item)
    for ours in (decontaminate.template(item.replace(" ", blank)), decontaminate.template(f"{blank}{item}{blank}".replace(" ", blank))):
        assert ours[0].tolist() == h.tolist() and ours[1].tolist() == kind.tolist() and ours[2] == raw
    lines = decontaminate.template("so said\rAlice and\r\n\r\nBob to Carol")
    assert lines[1].tolist() == [0, 0, 0, 0, 0, 0, decontaminate.CAPITAL]


def test_decontamination_of_tabbed_text(spark):
    item = "A train with Alice Smith travels 60 miles in 3 hours. What is its average speed, in miles an hour, if it rests for 10 minutes?"
    b = spark.createDataFrame([(1, item), (2, item.replace("train", "ship").replace(" ", "\t"))], "item_id long, text string")
    texts = [f"x y.\t{item}".replace(" ", "\t"), item.replace(" ", "\xa0"), item.replace("train", "ship")]
    got = {(r.doc_id, r.item_id): r.verbatim for r in decontaminate.contaminated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b).collect()}
    assert got.items() >= {(0, 1): True, (1, 1): True, (2, 2): True}.items()


def test_language(spark):
    d = entries.table(spark, "/root/testdata/sf0.01", "documents")
    out = entries.language_id(spark, "/root/testdata/sf0.01").join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.95 and all(0 <= r.score <= 1 for r in out)
    model = langid.fit(d)
    odd = {r.text: r for r in langid.identify(odd_docs(spark), model).collect()}
    assert odd[None].lang_pred == odd[""].lang_pred == odd[" \n\t "].lang_pred == "und"
    assert langid.identify(odd_docs(spark), langid.fit(odd_docs(spark, []))).where("lang_pred <> 'und'").count() == 0


def test_gradient():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (5, 3)).astype(np.uint8)
    cell = [rng.normal(0, 0.3, s).astype(np.float32) for s in ((256, 4), (256, 4), (4, 4), (4, 4))]
    weight = rng.normal(size=(5, 3, 4)).astype(np.float32)
    grads = langid._backward(x, langid.layer(x, *cell), weight, *cell)
    for k, g in enumerate(grads):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        values = []
        for step in (1e-3, -1e-3):
            moved = [c.copy() for c in cell]
            moved[k][at] += step
            values.append(float((langid.layer(x, *moved) * weight).sum()))
        assert abs((values[0] - values[1]) / 2e-3 - g[at]) < 0.02 * max(1, abs(g[at]))


def test_licenses(spark):
    mit = "Copyright (c) 2020 Someone\n\n" + license_scan.KNOWN[0][1].upper().replace("SOFTWARE", "software")
    docs = odd_docs(spark, [mit, "Text.\nReleased under the MIT Licence!\nMore.", *ODD])
    got = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    assert got[0].license_id == "MIT" and got[1].license_id is None and got[1].notices == "MIT"
    assert got[2].text_digest is None and license_scan.scan(odd_docs(spark, [])).count() == 0


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "p"), (2, "http://b/y", "p"), (3, None, None), (4, "u\nv", ""), (None, "u", "p"), (5, "u", "é" * 5000)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    assert (got[1].record_type, got[1].refers_to, got[2].record_type, got[None].refers_to) == ("revisit", 2, "response", 2)
    assert got[5].payload_bytes == 10000 and got[5].payload_digest == base64.b32encode(hashlib.sha1(("é" * 5000).encode()).digest()).decode()
    path = warc.new_dir(spark, "w")
    warc.write_pages(pages, path, compression="gzip")
    archive = spark.read.format("warc").load(path)
    assert archive.where("record_type = 'response' AND target_uri LIKE 'http://b%'").count() == 1
    assert spark.read.format("warc").option("payload", "false").load(path).where("payload IS NOT NULL").count() == 0
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8)).astype(np.float32)
    x[300:600] = x[300]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, []), (1020, [1.0])]
    got = collections.defaultdict(list)
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    v = x.astype(float)
    for q in range(0, 900, 20):
        s = [(-float(np.cumsum(v[q] * v[i])[-1]), i) for i in range(900) if i != q]
        assert [i for i, _ in got[q]] == [i for _, i in sorted(s)[:20]]
    assert len(got) == 45
    assert ann.nearest(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


@pytest.mark.parametrize("shape", ["signs", "sparse", "huge"])
def test_neighbours_with_ties_and_huge_norms(shape):
    rng = np.random.default_rng(2)
    x = {"signs": lambda: rng.choice([-1.0, 1.0], (6000, 16)), "sparse": lambda: (rng.random((6000, 64)) < 0.1).astype(float), "huge": lambda: rng.normal(size=(6000, 8)).astype(np.float32).astype(float)}[shape]()
    if shape == "huge":
        x[17] *= 1e8
    x = x[x.any(axis=1)]
    ids = rng.permutation(len(x)) * 3
    asked = np.arange(0, len(x), 120)
    got = collections.defaultdict(list)
    for q, i, s in zip(*ann.shard_neighbours(ids, x, ids[asked], x[asked], float(np.sqrt((x**2).sum(axis=1).max())) * (1 + 1e-12), 20, 1.0)):
        got[q].append((-s, i))
    for a in asked:
        s = np.cumsum(x[a] * x, axis=1)[:, -1]
        order = [j for j in np.lexsort((ids, -s)) if j != a][:20]
        assert got[ids[a]] == [(-s[j], ids[j]) for j in order]


def test_html(spark):
    page = "<html><body><header><h1>Site</h1></header><div id=menu><a>x</a></div><div class=content><h2>T&eacute;st &amp;amp; co</h2><p>One<br>two <b>bold</b></p><div class='cookie-notice'>ok?</div><table><tr><td>1<td>2</table></div><div class=comments><p>no</p></div><form>f</form><p>end"
    assert html_extract.text_of(html_extract.parse(page)) == "Tést &amp; co\n\nOne two bold\n\n1\n\n2\n\nend"
    site = [(i, f"http://h.org/{i}", f"<body><div><p>Same words on every page</p><p>Own story {i}</p><span>Always here</span></div></body>") for i in range(12)]
    rows = site + [(20, "http://h.org/x", None), (21, None, "<p>alone"), (22, "http://h.org/y", ""), (1, "http://h.org/1", site[1][2])]
    got = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[5].text == "Own story 5" and got[5].n_chars == 11
    assert got[20].text == got[22].text == "" and got[21].text == "alone"


def extracted(spark, pages):
    rows = [(i, f"http://h.org/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_html_keeps_the_whole_main_text():
    text = lambda page: html_extract.text_of(html_extract.parse(page))
    assert text("<nav>n</nav><main><h1>T</h1><p>intro</p><article>short</article><p>long tail</p></main><footer>f</footer>") == "T\n\nintro\n\nshort\n\nlong tail"
    assert text("<p>top</p><article><p>one</p></article><div>between</div><article><p>two</p></article>") == "one\n\ntwo"
    assert text("<article><p>a</p><div class='related-work'>b</div><div class='related-posts'>c</div><ul class=related>d</ul></article>") == "a\n\nb"
    assert text("<article class=comment-free>yes<article class=comment>no</article></article>") == "yes"
    assert text("<article><article class=comment>no</article></article><p>body</p>") == "body"


def test_html_template_of_neutral_names(spark):
    """No article and no telling names: the template is what recurs, whatever it is called;
    an odd page does not become the reference."""
    words = lambda i, n: " ".join(f"w{i}x{k}" for k in range(n))
    page = lambda i: f"<body><div class=a1><span>Our shop</span><b>Call us</b></div><div class=a2><p>{words(i, 9)}</p>{'<p>' + words(i + 100, 5) + '</p>' if i % 3 else ''}<p>Read more of us</p></div><div class=a3>All rights with us</div></body>"
    got = extracted(spark, [page(i) for i in range(14)] + ["<body><table><tr><td>odd</table></body>"])
    for i in range(14):
        assert got[i] == words(i, 9) + ("\n\n" + words(i + 100, 5) if i % 3 else "")
    assert got[14] == "odd"


def test_html_one_article_printed_again_is_no_template(spark):
    page = lambda i: f"<body><i>ad {i}</i><article><p>The long story that this host prints again</p><p>second part of it</p></article></body>"
    got = extracted(spark, [page(i) for i in range(12)])
    assert set(got.values()) == {"The long story that this host prints again\n\nsecond part of it"}


def test_html_deep_pages(spark):
    deep = lambda own: "<div>" * 3000 + own + "</div>" * 3000
    n, pairs = html_extract.match(html_extract.parse(deep("<p>a</p>b")), html_extract.parse(deep("c")))
    assert n == 3002 and len(pairs) == 1
    assert extracted(spark, [deep(f"<p>own {i}</p><b>same</b>" * (1 + i % 2)) for i in range(5)])[2] == "own 2"


def test_html_long_lists():
    page = lambda n, own: html_extract.parse("<body><p>Top</p>" + "".join(f"<p>{own} {i}</p>" for i in range(n)) + "<p>Bottom</p></body>")
    n, pairs = html_extract.match(page(160, "one"), page(260, "two"))
    texts = [(a.text, b.text) for a, b in pairs]
    assert ("Top", "Top") in texts and ("Bottom", "Bottom") in texts and len(texts) == 162 and n == 2 + 2 * 162


def test_html_match_is_largest():
    def largest(a, b):
        if a.label != b.label:
            return 0
        rows = [[0] * (len(b.kids) + 1) for _ in range(len(a.kids) + 1)]
        for i, x in enumerate(a.kids):
            for j, y in enumerate(b.kids):
                rows[i + 1][j + 1] = max(rows[i][j + 1], rows[i + 1][j], rows[i][j] + largest(x, y))
        return 1 + rows[-1][-1]

    rng = random.Random(5)
    make = lambda depth, most: "".join(f"<{t}>{make(depth - 1, 4) if depth else rng.choice('xy')}</{t}>" for t in (rng.choice(["div", "section", "b"]) for _ in range(rng.randint(0, most))))
    for most in [6] * 60 + [90] * 4:
        a, b = html_extract.parse(make(2, most)), html_extract.parse(make(2, most))
        n, pairs = html_extract.match(a, b)
        assert n == largest(a, b)
        assert len({x.number for x, _ in pairs}) == len({y.number for _, y in pairs}) == len(pairs)
        inner = sorted((x.number, y.number) for x, y in pairs)
        assert [y for _, y in inner] == sorted(y for _, y in inner)


def test_pipeline_stages(spark, tmp_path):
    rng = random.Random(3)
    words = [w for r in entries.table(spark, "/root/testdata/sf0.001", "documents").where("lang = 'en'").limit(40).collect() for w in r.text.split()]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item, passage, base = text(30), text(60), text(200)
    texts = [text(120) for _ in range(60)] + [base, base + " more", f"{text(50)} {item} {text(50)}", f"{text(40)} {passage}", f"{passage} {text(40)}", None, "12 34"]
    rows = [(i, t, "en" if i % 2 else "de", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(out) == set(range(67)) - {61, 62, 65, 66}
    want = dict(enumerate(texts))
    want[63], want[64] = " ".join(texts[63].split()[:40]), " ".join(texts[64].split()[60:])
    for i, r in out.items():
        assert r.decoded_sha256 == hashlib.sha256(want[i].encode()).hexdigest()


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    from pactlens.llm.components import components

    rng = random.Random(3)
    nodes = [rng.getrandbits(60) - (1 << 59) for _ in range(60)]
    links = {"chain": list(zip(nodes, nodes[1:])), "star": [(nodes[7], x) for x in nodes], "random": [(rng.choice(nodes), rng.choice(nodes)) for _ in range(45)], "none": []}[shape]
    group = {x: x for ab in links if ab[0] != ab[1] for x in ab}
    for _ in group:
        for a, b in links:
            if a != b:
                group[a] = group[b] = min(group[a], group[b])
    got = components(spark.createDataFrame(links + links[:3], "a long, b long"))
    assert sorted(map(tuple, got.collect())) == sorted(group.items())


def test_html_empty_elements(spark):
    """Elements that are empty on one page of a host and filled on another."""
    forms = ["<td></td>", "<td>1</td>"], ["<div></div>", "<div>x</div>"], ["<li></li>", "<li><b>y</b></li>"]
    for empty, full in forms:
        for a, b in ((empty, full), (full, empty), (f"<table><tr>{empty}</tr></table>", f"<table><tr>{full}{empty}</tr></table>")):
            x, y = html_extract.parse(a), html_extract.parse(b)
            assert html_extract.match(x, y)[0] == html_extract.match(y, x)[0] == min(x.size, y.size)
    rows = []
    for k in range(24):
        cells = "".join(forms[j % 3][(k + j) % 2] for j in range(4))
        rows.append((k, f"http://h{k % 2}.example/{k}", f"<html><body><nav>menu</nav><article><p>Story {k} is told here.</p><table><tr>{cells}</tr></table></article><footer></footer></body></html>"))
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(out) == 24 and all(f"Story {r.page_id} is told here." in r.text for r in out)


def test_html_names_inside_an_article():
    page = "<nav>menu</nav><article><p>Long enough to be the article of this page.</p>{}</article>"
    got = lambda inner: html_extract.text_of(html_extract.parse(page.format(inner))).split("\n\n")[1:]
    kept = ["<h2 class='banner-title'>x y</h2>", "<div class='widget-review'>x y</div>", "<p class='reply'>x y</p>", "<a class='skip'>x y</a>", "<section id='notice'>x y</section>", "<div class='share-price'>x y</div>", "<figure class='ad'>x y</figure>"]
    assert [got(x) for x in kept] == [["x y"]] * len(kept)
    gone = ["<div class='ad'>x</div>", "<div id='comments'>x</div>", "<section class='comment-list'>x</section>", "<div class='share-buttons'>x</div>", "<aside>x</aside>", "<form>x</form>", "<div class='newsletter'>x</div>", "<div class='related-posts'>x</div>", "<p hidden>x</p>"]
    assert [got(x) for x in gone] == [[]] * len(gone)
    assert html_extract.text_of(html_extract.parse("<div><p>this is the main part of the whole page</p></div><article><p>tiny teaser</p></article>")) == "this is the main part of the whole page\n\ntiny teaser"


LICENSES = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(LICENSES), reason="the published texts are not on this machine")
def test_whole_licences_by_digest(spark):
    """Published texts, as they are, indented, in capitals and with another holder."""
    names = {"Apache-2.0": "Apache-2.0", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}
    rows, want = [], {}
    for file, name in names.items():
        with open(f"{LICENSES}/{file}", encoding="utf-8", errors="replace") as f:
            text = f.read()
        for change in (lambda t: t, str.upper, lambda t: "Copyright (c) 2031 Someone Else\n" + t.replace("License", "Licence"), lambda t: t.replace("\n", "\r\n\t"), lambda t: "/*\n * " + t.replace("\n", "\n * ") + "\n */"):
            want[len(rows)] = name
            rows.append((len(rows), change(text)))
        rows.append((len(rows), text.replace(" not ", " ", 1)))  # another meaning is another text
    got = {r.doc_id: r.license_id for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: want.get(k) for k in got}
    unlicense = license_scan._UNLICENSE.replace("\n\n", "\n")
    assert license_scan.scan(spark.createDataFrame([(1, unlicense)], "doc_id long, text string")).first().license_id == "Unlicense"
