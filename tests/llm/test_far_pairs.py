"""Sets that share a passage, but little else, in the Jaccard join."""

import random

import numpy as np

from pactlens.llm import jaccard_join


def _documents(seed: int) -> list[str]:
    """Documents about one passage, and two later copies, near each other, of some of them."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage = [word() for _ in range(60)]
    out = []
    for k in range(500):
        own = [word() for _ in range(rng.randrange(60, 90))]
        out.append(own[: k % 50] + passage + own[k % 50 :])
    for k in range(0, 200, 5):
        near = list(out[k])
        near[3] = word()
        out.append(near)
        out.append(near[:-2] + [word()])
    return [" ".join(x) for x in out]


def _plain(texts: list[str], n: int, num: int, den: int) -> list[int]:
    sets = [set(jaccard_join.shingles(t.encode(), n).tolist()) for t in texts]
    least = list(range(len(sets)))

    def top(k: int) -> int:
        while least[k] != k:
            k = least[k]
        return k

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = sorted((top(i), top(j)))
                least[y] = x
    return [top(k) for k in range(len(sets))]


def test_far_sets_of_one_head_carry_no_differences(spark, monkeypatch):
    texts = _documents(5)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    elements, write = [], jaccard_join.work_table

    def counted(df, name, *more):
        out = write(df, name, *more)
        if name == "compared":
            elements.append(out.selectExpr("sum(greatest(size(differ), 0)) AS n").first().n or 0)
        return out

    monkeypatch.setattr(jaccard_join, "work_table", counted)
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 5, 80, 100).collect()}
    assert [found[k] for k in range(len(texts))] == _plain(texts, 5, 80, 100)
    assert elements[0] < 20_000


def test_pairs_of_one_head_are_found_by_parities(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "NOT_FAR", 0)
    monkeypatch.setattr(jaccard_join, "FAR", 1.0)
    for seed in (1, 2):
        texts = _documents(seed)
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 3, 90, 100, seed=seed).collect()}
        assert [found[k] for k in range(len(texts))] == _plain(texts, 3, 90, 100)


def test_parities_are_no_more_than_elements():
    rng = np.random.default_rng(3)
    for size in (1, 40, 3000):
        a, b = (np.unique(rng.integers(0, 2**63, size).astype(np.uint64)) for _ in range(2))
        a = np.unique(np.concatenate((a, b[: size // 2])))
        odd = np.bitwise_count(jaccard_join.parities(a) ^ jaccard_join.parities(b)).sum()
        assert 0 < odd <= len(np.setxor1d(a, b))


def test_what_parities_rule_out_is_far(spark):
    odd = lambda n: [(1 << n) - 1] + [0] * (jaccard_join.WORDS - 1)
    marks = spark.createDataFrame([(1, 100, odd(0)), (2, 100, odd(22)), (3, 100, odd(23))], "h long, size int, odd array<long>")
    pairs = spark.createDataFrame([(1, 2, True), (1, 3, True)], "a long, b long, among_more boolean")
    assert {r.b: r.far for r in jaccard_join._parted(pairs, marks, 80, 100).collect()} == {2: False, 3: True}


def test_large_far_sets_carry_no_differences(spark, monkeypatch):
    rng = random.Random(7)
    word = lambda: f"w{rng.randrange(10**9)}"
    passage, texts = [word() for _ in range(2500)], []
    for k in range(24):
        own = passage + [word() for _ in range(2700 + 10 * k)]
        texts.append(own)
        if k % 4 == 0:
            texts.append([word() if rng.random() < 0.01 else w for w in own])
    texts = [" ".join(x) for x in texts]
    elements, write = [], jaccard_join.work_table

    def counted(df, name, *more):
        out = write(df, name, *more)
        if name == "compared":
            elements.append(out.selectExpr("sum(greatest(size(differ), 0)) AS n").first().n or 0)
        return out

    monkeypatch.setattr(jaccard_join, "work_table", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in jaccard_join.jaccard_components(docs, 5, 80, 100).collect()}
    assert [found[k] for k in range(len(texts))] == _plain(texts, 5, 80, 100)
    assert elements[0] < 10_000


def test_parities_of_large_sets_of_unlike_sizes(spark):
    rng = np.random.default_rng(4)
    draw = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    base = draw(6000)
    sets = [base, np.union1d(base[:5600], draw(500)), base[:4000], np.union1d(base[:2500], draw(3000)), np.union1d(base[:1500], draw(2500)), base[:900], base[:1400]]
    rows = [(k, len(s), np.concatenate((jaccard_join.parities(s), jaccard_join.parities_of_large(s))).tolist()) for k, s in enumerate(sets)]
    assert [len(r[2]) for r in rows] == [288, 288, 160, 288, 160, 32, 96]
    marks = spark.createDataFrame(rows, "h long, size int, odd array<long>")
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    apart = {p: len(np.setxor1d(sets[p[0]], sets[p[1]])) for p in pairs}
    both = spark.createDataFrame(pairs, "i long, j long").join(marks.selectExpr("h AS i", "odd AS p"), "i").join(marks.selectExpr("h AS j", "odd AS q"), "j")
    for r in both.selectExpr("i", "j", "size(p) AS m", "size(q) AS n", f"{jaccard_join._wide_apart('p', 'q')} AS wide").collect():
        told = min(r.m, r.n) > 32 and max(r.m, r.n) - 32 <= 2 * (min(r.m, r.n) - 32)
        assert r.wide <= apart[r.i, r.j] and (r.wide > 0.4 * apart[r.i, r.j] if told else r.wide == 0)
    far = jaccard_join._parted(spark.createDataFrame([(*p, True) for p in pairs], "a long, b long, among_more boolean"), marks, 80, 100)
    far = {(r.a, r.b): r.far for r in far.collect()}
    assert not far[1, 0] and far[3, 0] and far[4, 2] and far[4, 3]
    assert not any(far[p] and 10 * len(np.intersect1d(sets[p[0]], sets[p[1]])) >= 8 * len(np.union1d(sets[p[0]], sets[p[1]])) for p in pairs)
