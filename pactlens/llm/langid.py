"""Language identification by a bidirectional gated recurrent network over bytes.

Two recurrent layers read the bytes of a text, one from either end; at every byte both
states together give the probabilities of the languages, and a text's probabilities are
the mean over its bytes. Each layer has an update gate and no reset gate; gate and candidate
are clipped lines in place of sigmoids, which cost little. Training is
backpropagation through time in numpy, on a bounded sample of labelled texts: the
``per_language`` texts with the least id hash of each language and from each a snippet of
``snippet`` bytes. Prediction reads whole texts, cut into runs of ``run`` bytes that are
read side by side; no shuffle, memory bounded by ``lanes`` times ``run`` bytes.

Edges: a text that is null or has no letter is ``und`` with score 0; invalid labels
(null) are never learned; if no text is labelled, all texts are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

UNKNOWN = "und"


#: Byte and state weights of a layer's gate and candidate.
CELL = ("wz", "wc", "uz", "uc")


def cell(w: dict, side: str) -> tuple[np.ndarray, ...]:
    return tuple(w[side + b] for b in CELL)


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]  # f and b with each of CELL: both layers; fv, bv, c: output


def layer(x: np.ndarray, wz: np.ndarray, wc: np.ndarray, uz: np.ndarray, uc: np.ndarray) -> np.ndarray:
    """States after each step; ``x`` is (steps, lanes) of bytes.

    z = clip(0.25 (wz[x] + h uz) + 0.5), c = clip(wc[x] + h uc, -1, 1),
    h' = c + z (h - c).
    """
    steps, lanes = x.shape
    n = len(uz)
    out = np.empty((steps, lanes, n), np.float32)
    h = np.zeros((lanes, n), np.float32)
    z, c, a = (np.empty_like(h) for _ in range(3))
    wz = wz * np.float32(0.25) + np.float32(0.5)
    uz = uz * np.float32(0.25)
    for t in range(steps):
        np.take(wz, x[t], axis=0, out=z, mode="clip")
        z += np.matmul(h, uz, out=a)
        np.maximum(z, 0, out=z)
        np.minimum(z, 1, out=z)
        np.take(wc, x[t], axis=0, out=c, mode="clip")
        c += np.matmul(h, uc, out=a)
        np.maximum(c, -1, out=c)
        np.minimum(c, 1, out=c)
        h = np.subtract(h, c, out=out[t])
        h *= z
        h += c
    return out


def _backward(x: np.ndarray, hs: np.ndarray, dh_out: np.ndarray, wz: np.ndarray, wc: np.ndarray, uz: np.ndarray, uc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Gradients of the four weights, given those of all states."""
    steps, lanes = x.shape
    n = len(uz)
    dz_all, dc_all = (np.empty((steps, lanes, n), np.float32) for _ in range(2))
    duz, duc = np.zeros_like(uz), np.zeros_like(uc)
    carry = zero = np.zeros((lanes, n), np.float32)
    for t in range(steps - 1, -1, -1):
        before = hs[t - 1] if t else zero
        pz = np.float32(0.25) * (wz[x[t]] + before @ uz) + np.float32(0.5)
        pc = wc[x[t]] + before @ uc
        z, c = np.clip(pz, 0, 1), np.clip(pc, -1, 1)
        dh = dh_out[t] + carry
        dc = dh * (1 - z) * (np.abs(pc) < 1)
        dz = dh * (before - c) * (np.abs(pz - np.float32(0.5)) < 0.5) * np.float32(0.25)
        dz_all[t], dc_all[t] = dz, dc
        duz += before.T @ dz
        duc += before.T @ dc
        carry = dh * z + dz @ uz.T + dc @ uc.T
    flat = x.ravel()
    dwz, dwc = (np.stack([np.bincount(flat, d[:, :, j].ravel(), 256) for j in range(n)], axis=1).astype(np.float32) for d in (dz_all, dc_all))
    return dwz, dwc, duz, duc


def flip(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each lane's first ``lengths`` steps in reverse order; the rest stays."""
    if (lengths == len(x)).all():
        return np.ascontiguousarray(x[::-1])
    steps = np.arange(len(x))[:, None]
    at = np.where(steps < lengths, lengths - 1 - steps, steps)
    return np.take_along_axis(x, at.reshape(at.shape + (1,) * (x.ndim - 2)), 0)


def train(texts: list[bytes], labels: list[str], hidden: int = 8, steps: int = 64, lanes: int = 128, updates: int = 350, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam on the cross-entropy of every position's label."""
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    k, n = len(languages), hidden
    y_all = np.array([languages.index(x) for x in labels])
    share = 1 / np.bincount(y_all, minlength=k)[y_all]
    share /= share.sum()
    w = {name: rng.normal(0, 0.3, shape).astype(np.float32) for name, shape in ((a + b, (256, n) if b[0] == "w" else (n, n)) for a in "fb" for b in CELL)}
    w |= {"fv": rng.normal(0, 0.3, (n, k)).astype(np.float32), "bv": rng.normal(0, 0.3, (n, k)).astype(np.float32)}
    w["c"] = np.zeros(k, np.float32)
    m1, m2 = ({a: np.zeros_like(b) for a, b in w.items()} for _ in range(2))
    for step in range(1, updates + 1):
        pick = rng.choice(len(texts), lanes, p=share)
        x = np.zeros((steps, lanes), np.uint8)
        lengths = np.zeros(lanes, np.int64)
        for j, i in enumerate(pick):
            raw = texts[i]
            want = min(len(raw), int(rng.integers(8, steps + 1)))
            at = int(rng.integers(0, len(raw) - want + 1))
            x[:want, j] = np.frombuffer(raw, np.uint8, want, at)
            lengths[j] = want
        y = y_all[pick]
        xb = flip(x, lengths)
        cf, cb = cell(w, "f"), cell(w, "b")
        hf, hb = layer(x, *cf), layer(xb, *cb)
        back = flip(hb, lengths)
        logits = hf @ w["fv"] + back @ w["bv"] + w["c"]
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(lanes), y] -= 1
        p *= (np.arange(steps)[:, None] < lengths)[:, :, None] / np.float32(lengths.sum())
        p = p.astype(np.float32)
        grad = {"fv": np.einsum("tbh,tbk->hk", hf, p), "bv": np.einsum("tbh,tbk->hk", back, p), "c": p.sum(axis=(0, 1))}
        grad |= zip(("f" + b for b in CELL), _backward(x, hf, p @ w["fv"].T, *cf))
        grad |= zip(("b" + b for b in CELL), _backward(xb, hb, flip(p @ w["bv"].T, lengths), *cb))
        lr = rate * min(1, 2 * (1 - step / (updates + 1)))
        for a, g in grad.items():
            m1[a] = 0.9 * m1[a] + 0.1 * g
            m2[a] = 0.99 * m2[a] + 0.01 * g * g
            w[a] -= (lr * (m1[a] / (1 - 0.9**step)) / (np.sqrt(m2[a] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return Model(languages, w)


def positions(model: Model, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(steps, lanes, languages): probabilities at every byte."""
    w = model.weights
    steps, lanes = x.shape
    n, k = w["fv"].shape
    out = (layer(x, *cell(w, "f")).reshape(-1, n) @ w["fv"]).reshape(steps, lanes, k)
    out += flip((layer(flip(x, lengths), *cell(w, "b")).reshape(-1, n) @ w["bv"]).reshape(steps, lanes, k), lengths)
    out += w["c"]
    np.exp(out, out=out)  # states are within -1 and 1, so this is finite
    out /= (out.reshape(-1, k) @ np.ones((k, 1), np.float32)).reshape(steps, lanes, 1)
    return out


def predict(model: Model, texts: list[bytes], run: int = 128, lanes: int = 2048) -> np.ndarray:
    """(texts, languages): the mean probabilities of each whole text (zeros if empty)."""
    sums = np.zeros((len(texts), len(model.languages)))
    pieces = [(min(run, len(t) - at), i, at) for i, t in enumerate(texts) for at in range(0, len(t), run)]
    pieces.sort(key=lambda p: -p[0])
    for k in range(0, len(pieces), lanes):
        part = pieces[k : k + lanes]
        x = np.zeros((len(part), part[0][0]), np.uint8)
        for j, (n, i, at) in enumerate(part):
            x[j, :n] = np.frombuffer(texts[i], np.uint8, n, at)
        lengths = np.array([p[0] for p in part])
        p = positions(model, np.ascontiguousarray(x.T), lengths)
        if lengths[-1] < len(p):
            p *= (np.arange(len(p))[:, None] < lengths)[:, :, None]
        np.add.at(sums, [q[1] for q in part], p.sum(axis=0))
    return sums / np.maximum([[len(t)] for t in texts], 1)


# --- Spark ---------------------------------------------------------------------------


def fit(docs: DataFrame, per_language: int = 300, snippet: int = 600, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> Model:
    """Train on at most ``per_language`` texts of each language among ``docs``."""
    order = F.xxhash64(F.col(id_col))
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.substring(F.col(text_col), 1 + F.pmod(order, F.greatest(F.length(text_col) - snippet, F.lit(1))).cast("int"), F.lit(snippet)).alias("text"), order.alias("o"))
    best = Window.partitionBy("lang").orderBy("o", "text")
    sample = rows.withColumn("n", F.row_number().over(best)).where(F.col("n") <= per_language).orderBy("lang", "n").select("lang", "text").collect()
    sample = [(r.lang, r.text.encode()) for r in sample if r.text]
    if not sample:
        return Model([], {})
    return train([t for _, t in sample], [x for x, _ in sample], **options)


def label(texts: list[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    known = np.array([bool(model.languages) and t is not None and any(map(str.isalpha, t)) for t in texts], bool)
    score, lang = np.zeros(len(texts)), np.full(len(texts), UNKNOWN, object)
    if known.any():
        p = predict(model, [t.encode() for t, z in zip(texts, known) if z])
        lang[known] = np.array(model.languages, object)[p.argmax(axis=1)]
        score[known] = np.clip(p.max(axis=1), 0, 1)
    return lang.tolist(), score


def identify(docs: DataFrame, model: Model, text_col: str = "text", lang_as: str = "lang_pred", score_as: str = "score") -> DataFrame:
    """``docs`` with two more columns, the language of every whole text and its score;
    input columns of these names are replaced."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1024):
                part = b.slice(k, 1024)
                lang, score = label(part.column(part.num_columns - 1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], names=[*part.schema.names[:-1], lang_as, score_as])

    small_batches(docs.sparkSession)
    src = docs.drop(*[c for c in (lang_as, score_as) if c != text_col])
    schema = T.StructType([*src.schema.fields, T.StructField(lang_as, T.StringType()), T.StructField(score_as, T.DoubleType())])
    return src.select("*", F.col(text_col).cast("string").alias("__text")).mapInArrow(go, schema)
