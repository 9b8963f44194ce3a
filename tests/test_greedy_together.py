"""Documents are matched together, each as it is alone."""

import random

from pactlens.functions import text as T
from pactlens.operators import evaluate as E


def _rows(rng, many):
    text = lambda: rng.choice([None, "", " ", "Duty", "x" * 230, *(" ".join(rng.choice(["pay", "the Fee", "é–x", "within ten days", "Notice"]) for _ in range(rng.randint(1, 14))) for _ in range(4))])
    return [{"ord": k, "row": {"source_text": text(), "description": text(), "title": text(), "party": rng.choice(["A", "b", None]), "type": rng.choice(["t", "u"]), "category": rng.choice("cd"), "severity": rng.choice("hl")}} for k in range(many)]


def _alone(mine, others, score, threshold):
    left, out = dict(enumerate(others)), []
    for one in mine:
        best, at = 0.0, None
        for i, other in left.items():
            if (x := score(one["row"], other["row"])) > best:
                best, at = x, i
        taken = left.pop(at) if at is not None and best >= threshold else None
        out.append((one["ord"], taken and taken["ord"], best, taken is not None))
    return out


def test_documents_together_are_matched_as_alone():
    rng = random.Random(4)
    docs = []
    for _ in range(150):
        others = _rows(rng, rng.randint(0, 6))
        docs.append((_rows(rng, rng.randint(0, 5)) + [{"ord": 9 + k, "row": dict(x["row"])} for k, x in enumerate(rng.sample(others, len(others) // 2))], others))
    for parts, score in ((E.obligation_parts, E.obligation_score), (E.risk_parts, E.risk_score)):
        for threshold in (0.5, 0.6):
            assert E._together([E._matches(m, o, parts, threshold) for m, o in docs]) == [_alone(m, o, score, threshold) for m, o in docs]


def test_a_text_that_recurs_takes_one_ratio(monkeypatch):
    asked = []
    monkeypatch.setattr(E, "_known", T.Ratios())
    monkeypatch.setattr(T, "ratios", lambda pairs, own=T.ratios: asked.extend(pairs) or own(pairs))
    row = lambda text: [{"ord": 1, "row": {"source_text": text, "description": "same", "party": "A", "type": "t"}}]
    E._together([E._matches(row("The tenant pays"), row("The landlord gives"), E.obligation_parts, 0.6) for _ in range(5)])
    assert asked == [("the tenant pays", "the landlord gives")]


def test_ratios_together_are_those_of_each(monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(T, "PAIRS", 7)
    for alphabet in ("ab", "abc é", "abcdefgh ", "日本語 x"):
        pairs = [tuple("".join(rng.choice(alphabet) for _ in range(rng.choice([0, 3, 64, 65, 130, 199, 200, 230]))) for _ in range(2)) for _ in range(60)]
        assert T.ratios(pairs) == [T.ratio(a, b) for a, b in pairs]
    monkeypatch.setattr(T, "KNOWN", 3)
    known = T.Ratios()
    for _ in range(3):
        assert known.learn(pairs) == {p: T.ratio(*p) for p in pairs}
    assert len(known.new) <= 3 and len(known.old) <= 3
