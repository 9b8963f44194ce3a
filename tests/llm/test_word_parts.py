"""Ids of texts are those of their words and marks, whatever stands in them."""

import random

import numpy as np
import public_tokenizers
from pactlens.llm import token_store as ts

PATH = public_tokenizers.path("word_bpe_49k.json")
MARKS_AND_LETTERS = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", *"abcSTZÀéßÿªµİŉΣσςǅ", "'s", "'LL", "é", "n̈", "́", "9", "²", "٣", "中", "가", "", "　", "\t", "\r", "\x85", "\x1c", " ", "\n", "😀", "<|endoftext|>", "<|ENDOFTEXT|>", "|", "͸", "Ⅷ", "K", "ſ"]


def test_ids_are_those_of_whole_texts():
    rng = random.Random(4)
    texts = ["".join(rng.choice(MARKS_AND_LETTERS) for _ in range(rng.randint(0, 12))) for _ in range(20_000)]
    texts += [a + b + c for a in MARKS_AND_LETTERS for b in MARKS_AND_LETTERS for c in ("", "x", ",")]
    ids = ts.WordIds(PATH, "<u2", limit=5_000)
    whole = [np.array(e.ids, "<u2").tobytes() for e in ids.library.encode_batch_fast(texts, add_special_tokens=False)]
    got = [x for k in range(0, len(texts), 500) for x in ids.encode(texts[k : k + 500])]
    assert got == whole


def test_words_with_other_marks_are_encoded_once(monkeypatch):
    ids, asked = ts.WordIds(PATH, "<u2"), []
    learn = ids._learn
    monkeypatch.setattr(ids, "_learn", lambda words: (asked.extend(words), learn(words)))
    ids.encode(["Agreement, agreement... AGREEMENT", "agreement;\nagreement,"])
    assert sorted(asked) == sorted({"agreement", ",", "...", ";"})
