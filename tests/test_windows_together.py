"""Windows of many quotes are compared together, not one at a time."""

import random
from difflib import SequenceMatcher

import numpy as np
from pactlens.functions import blocks
from pactlens.functions import text as T
from pactlens.operators import audit, verify


def _texts(rng, many, most):
    alphabet = rng.choice(["ab", "abc é", "abcdefgh ", "a"])
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, most))) for _ in range(many)]


def test_blocks_of_many_are_those_of_each():
    rng = random.Random(1)
    for most in (5, 64, 65, 150) * 4:
        pairs = list(zip(_texts(rng, 40, most), _texts(rng, 40, 180)))
        words = max(-(-len(a) // 64) for a, _ in pairs)
        masks = [np.pad(m, ((0, words - len(m)), (0, 0))) for m in (T.Haystack(b).masks(a) for a, b in pairs)]
        n, width = (np.array([len(p[k]) for p in pairs]) for k in (0, 1))
        at, masks = np.cumsum(width) - width, list(np.concatenate(masks, axis=1))
        want = np.array([sum(x.size for x in SequenceMatcher(None, a, b).get_matching_blocks()) for a, b in pairs])
        least = np.array([rng.randint(0, 60) for _ in pairs])
        for listed in (None, blocks.Listed(masks, at)):
            assert (blocks.matched_all(masks, n, at, width, least * 0, listed) == want).all()
            assert (blocks.matched_all(masks, n, at, width, least, listed) == np.where(want >= least, want, -1)).all()


def test_best_windows_are_those_of_each(monkeypatch):
    rng = random.Random(2)
    for words, listed in ((T.TOGETHER, blocks.LISTED), (50, 0)):
        monkeypatch.setattr(T, "TOGETHER", words)
        monkeypatch.setattr(blocks, "LISTED", listed)
        for most in (9, 80, 230):
            hays = [T.Haystack(t) for t in _texts(rng, 12, 400)] + [T.Haystack("")]
            pairs = [(q, rng.choice(hays)) for q in _texts(rng, 60, most)]
            for sizes, clamp in ((audit.WINDOW_SIZES, False), (verify.WINDOW_SIZES, True)):
                alone = [T.best_window(q, T.Haystack(hay.text), sizes, clamp) for q, hay in pairs]
                assert T.best_windows(pairs, sizes, clamp) == alone
                for (score, at, size), own, bounds in zip(T.best_windows(pairs, sizes, clamp, 0.8), alone, T.window_bounds(pairs, sizes, clamp)):
                    assert (score, at, size) == (own if bounds.max(initial=0.0) >= 0.8 else (0.0, -1, 0))


def test_quotes_of_a_page_take_no_search_of_their_own(monkeypatch):
    monkeypatch.setattr(T, "_search", None)
    body = "AGREEMENT\n\nThe tenant keeps the garden and the fence in order at all times."
    quote = {"source_text": "Nothing of the kind stands in number 4.", "phrases": [], "source_location": None}
    assert 0 < verify._find_all([(verify._open(body), quote)])[0][0] < 1
    assert 0 < audit._match_all([(audit._open(body), quote)])[0][0] < 1
