"""Windows of many quotes are bounded together, and counts need no ratio that a bound decides."""

import random

import numpy as np
from pactlens.functions import text as T
from pactlens.operators import audit


def _cases(rng):
    words = ["notice", "shall", "pay", "Fee", "é–x", "term", "z", "　", "agreement"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    return [(text(rng.choice([1, 3, 9, 14, 30])), text(rng.choice([0, 1, 5, 40]))) for _ in range(150)]


def test_bounds_of_many_are_those_of_each():
    pairs = [(q, T.Haystack(t)) for q, t in [*_cases(random.Random(3)), ("", "abc"), ("x" * 64, "x" * 200), ("x" * 128, "ax" * 100)]]
    for sizes, clamp in (((1.0, 1.2, 0.8), False), ((1.0, 1.2, 1.5, 0.8), True)):
        for (needle, hay), found in zip(pairs, T.window_bounds(pairs, sizes, clamp)):
            at, width = T._windows(len(needle), len(hay.text), sizes, clamp)
            own = [T.ratio_bound(needle, hay.text[a : a + w]) for a, w in zip(at.tolist(), width.tolist())]
            np.testing.assert_allclose(found, own)


def test_statuses_are_those_of_the_search(spark, monkeypatch):
    rng = random.Random(5)
    rows, docs = [], []
    for k, (quote, text) in enumerate(_cases(rng)):
        docs.append((k, text + " " + quote + " end" if k % 3 else text))
        near = quote[:3] + "#" * (k % 4) + quote[3:]
        rows += [(k, 1, "a", "obligation", quote), (k, 2, "b", "risk_flag", near), (k, 3, "c", "obligation", None), (k, 4, "d", "obligation", "nothing of this kind stands here")]
    items = spark.createDataFrame(rows, "doc_id long, ord int, item_id string, item_type string, source_text string")
    texts = spark.createDataFrame(docs, "doc_id long, raw_text string")
    for threshold in (0.5, 0.85, 0.99):
        whole = audit.verify_quotes(items, texts, threshold).select("doc_id", "ord", "item_type", "status")
        assert sorted(audit.quote_statuses(items, texts, threshold).collect()) == sorted(whole.collect())


def test_no_ratio_where_the_bound_decides(monkeypatch):
    monkeypatch.setattr(audit, "best_window", None)
    doc = audit._open("AGREEMENT\n\nThe tenant keeps the garden and the fence in order at all times.")
    assert audit._match_all([(doc, {"source_text": "Nothing of the kind stands in number 4."})], least=0.85) == [(0.0, None)]
