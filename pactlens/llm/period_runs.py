"""Periodic runs of words: stretches that repeat one block at least four times.

A run is a stretch of words with smallest period q (words q apart are equal), at least
``max(6, 4 q)`` words long, that no neighbour extends. At lag q it shows as an island of
``length - q`` consecutive places whose word stands again q words later.

How many places match at each lag is counted first, heavy and light words apart: a word
that occurs more than sqrt(n) times adds the autocorrelation of its places, taken exactly
by FFT (counts are whole numbers, so rounding removes the error); a rare word adds the
differences of its places. Only lags with as many matches as an island needs are looked
at. Their islands are sought by probes a quarter of the island apart: four probes in a row
must match, and what lies about them is then compared in full. A run of period d also
matches at every multiple of d; these matches are taken off those lags' counts when the
run is found, so a long run costs no scans of its multiples. (Nothing else is lost by
that: a run of period k d shares fewer than k d words with it, hence no match.)

Documents are independent and no row is shuffled. A document of n words takes memory of
a few times its text and at most n ** 1.5 pair differences.

Edges: a null text has no words; texts of fewer than 6 words have no runs. Repeated rows
give repeated rows. A null id is kept. Other columns are carried where asked for, whatever
their names. Fewer words than four periods are no run; equal lengths go by the smallest
start, then period. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches

LEAST, TIMES = 6, 4
#: Cells of the indicator rows that are transformed at once: 32 MB.
CELLS = 1 << 22
#: Differences that are gathered before they are counted: 16 MB.
GATHERED = 1 << 21
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def fft_size(n: int) -> int:
    """A length that transforms fast: the least 2, 3 or 5 times a power of two from ``n``."""
    return min(m << max(0, (-(-n // m) - 1).bit_length()) for m in (2, 3, 5))


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """At each lag up to ``most``, how many words equal the word so far behind them."""
    n = len(ids)
    counts = np.zeros(most + 1, np.int64)
    times = np.bincount(ids)
    limit = math.isqrt(n)
    order = np.argsort(ids, kind="stable")
    often = times[ids[order]]
    place = order[(often > 1) & (often <= limit)]
    word, gathered, size = ids[place], [], 0
    for step in range(1, limit):
        if step & 7 == 0:  # words with fewer places have no pairs left
            place = place[times[word] > step]
            word = ids[place]
        if len(place) <= step:
            break
        gap = (place[step:] - place[:-step])[word[step:] == word[:-step]]
        gathered.append(gap[gap <= most])
        size += len(gathered[-1])
        if size >= GATHERED:
            counts += np.bincount(np.concatenate(gathered), minlength=most + 1)
            gathered, size = [], 0
    if size:
        counts += np.bincount(np.concatenate(gathered), minlength=most + 1)
    heavy = np.flatnonzero(times > limit)
    if len(heavy):
        width = fft_size(n + most)
        at_once = max(1, CELLS // width)
        for k in range(0, len(heavy), at_once):
            part = heavy[k : k + at_once]
            row = np.full(len(times), -1)
            row[part] = np.arange(len(part))
            here = row[ids]
            at = np.flatnonzero(here >= 0)
            shown = np.zeros((len(part), width))
            shown[here[at], at] = 1.0
            spectrum = np.fft.rfft(shown)
            power = (spectrum.real**2 + spectrum.imag**2).sum(axis=0)
            counts += np.rint(np.fft.irfft(power, width)[: most + 1]).astype(np.int64)
    counts[0] = 0
    return counts


def stretches(hit: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of each stretch of at least ``least`` true places."""
    edges = np.flatnonzero(np.diff(hit.view(np.int8), prepend=0, append=0))
    start, end = edges[::2], edges[1::2]
    long = end - start >= least
    return zip(start[long].tolist(), end[long].tolist())


def islands(ids: np.ndarray, lag: int, least: int) -> Iterator[tuple[int, int]]:
    """(start, end) of the islands of at least ``least`` matches at one lag."""
    m = len(ids) - lag
    step = max(1, least // 4)
    probes = ids[:m:step] == ids[lag::step]
    if step == 1:
        yield from stretches(probes, least)
        return
    for first, last in stretches(probes, least // step):
        low, high = max(0, (first - 1) * step + 1), min(m, last * step)
        for start, end in stretches(ids[low:high] == ids[low + lag : high + lag], least):
            yield low + start, low + end


def prime_factors(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return out + [n] if n > 1 else out


def is_power(block: np.ndarray) -> bool:
    """Whether the block is a shorter one repeated."""
    n = len(block)
    return any(np.array_equal(block[: n - n // p], block[n // p :]) for p in prime_factors(n))


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n, found = len(ids), []
    most = n // TIMES
    if n < LEAST or most < 1:
        return found
    lags = np.arange(most + 1)
    needed = np.maximum(LEAST, TIMES * lags) - lags
    counts = lag_counts(ids, most)
    for q in np.flatnonzero(counts >= needed).tolist():
        least = int(needed[q])
        if q == 0 or counts[q] < least:
            continue
        for start, end in islands(ids, q, least):
            if not is_power(ids[start : start + q]):
                length = end - start + q
                found.append((start, length, q))
                further = lags[2 * q : min(most, length) + 1 : q]
                counts[further] -= length - further
    return sorted(found, key=lambda r: (r[0], r[2]))


def number(words: list[bytes]) -> np.ndarray:
    """Equal words get equal numbers."""
    seen = dict.fromkeys(words)
    for k, w in enumerate(seen):
        seen[w] = k
    return np.fromiter(map(seen.__getitem__, words), np.int64, len(words))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        depth[start + q] += 1
        depth[start + length] -= 1
    return list(compress(words, (np.cumsum(depth[:-1]) == 0).tolist()))


def planted_tail(words: list[bytes], seed: int) -> list[bytes]:
    """Where ``seed`` is a multiple of ten, the words from a place on become repetitions
    of a block that starts there; place and block length follow from the seed."""
    n, g = len(words), seed // 10
    if seed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def period_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), seed: Column | None = None, change: Callable[[list[bytes], int], list[bytes]] | None = None) -> DataFrame:
    """(the id, ``carry``, n_words, runs, kept) of each document: its runs, and its words
    without their repetitions, joined by one blank.

    ``change`` may put other words in a document's place, given ``seed``'s value (null: 1).
    """
    small_batches(docs.sparkSession)
    chosen = [id_col, *carry]
    src = docs.select(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(chosen)]).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), F.coalesce(seed if seed is not None else F.lit(1), F.lit(1)).cast("long").alias("seed"))
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, runs, kept = [], [], []
            for text, s in zip(b.column(1), b.column(2).to_pylist()):
                words = text.as_buffer().to_pybytes().split()
                if change is not None:
                    words = change(words, s)
                got = find_runs(number(words)) if len(words) >= LEAST else []
                sizes.append(len(words))
                runs.append([{"start": a, "length": n, "period": q} for a, n, q in got])
                kept.append(b" ".join(without_repeats(words, got)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(runs, kinds), pa.array(kept, pa.string())], names=["row", "n_words", "runs", "kept"])

    schema = T.StructType([src.schema["row"], T.StructField("n_words", T.LongType()), *T._parse_datatype_string(f"runs {RUNS}, kept string").fields])
    out = src.mapInArrow(run, schema)
    return out.select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(chosen)], "n_words", "runs", "kept")


def run_digests(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The greatest run of each document, and digests of all its runs and of its words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    out = found.withColumn("best", best)
    return out.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("kept", 256).alias("collapsed_sha256"),
    )
