"""Sentences of many documents are compared with their quotes together."""

import random

from pactlens.functions import text as T
from pactlens.operators import audit


def test_likeness_of_many_is_that_of_each(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(audit, "_known", T.Ratios())
    text = lambda n: " ".join(rng.choice(["the Tenant", "shall", "pay", "é–x", "rent", " ", "x" * 60]) for _ in range(rng.randint(0, n)))
    asked = [([text(8) for _ in range(rng.randint(0, 5))] + rng.choice([[], [" "], [""]]), text(8)) for _ in range(200)]
    for enough in (0.7, 2.0):
        got = audit._likeness([(audit._others(quotes), {"sentence": s}) for quotes, s in asked], enough)
        for (quotes, s), (found,) in zip(asked, got):
            best = audit._open_quotes(quotes)({"sentence": s})[0]
            assert found == best or found >= enough and best >= enough


def test_pairs_that_recur_are_compared_once(spark, monkeypatch):
    pairs = []
    monkeypatch.setattr(audit, "_known", T.Ratios())
    monkeypatch.setattr(T, "ratios", lambda asked, own=T.ratios: pairs.extend(asked) or own(asked))
    asked = [(audit._others(["Goods are inspected", "the rent is  paid"]), {"sentence": "The rent is payed"})] * 50
    assert audit._likeness(asked, 2.0) == [(max(T.ratio("the rent is payed", q) for q in ("goods are inspected", "the rent is paid")),)] * 50
    assert len(pairs) == 2
