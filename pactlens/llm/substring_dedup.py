"""Substring deduplication: documents factored against an index of all blocks.

Words are runs of anything but ASCII white space. A window of ``window`` words that
starts at two places or more, in one document or several, is a duplicate; every word
that a duplicate window covers goes.

Reference blocks. In each window the run of ``anchor`` words with the least hash is its
anchor; consecutive windows with one anchor form a block, the words from the first
window's start to the last one's end. Equal windows have equal anchors at equal places,
so a window can only recur in blocks with the same anchor. The blocks of all documents
are the reference, indexed by (anchor, block) hash.

Factors. What a document has in common with the reference is found by hash, not by
extending a text comparison word by word: a block that occurs elsewhere as a whole
matches from its first window to its last. At the border, where only its anchor occurs
elsewhere, its windows are looked up one by one among those of all other blocks of the
same anchor, one of each kind of whole copies included, so a hot anchor costs a row a
window and no pairs. Each match says where in the reference it lies: at the first place
that the index has of it or, for what is itself there, at the last. Neighbouring matches
that lie as far from each other there as here (on one diagonal) are one longer match.
The parse (``factor``) walks a document from left to right and takes, of the matches that
begin at or before each place, the one that reaches furthest; what matches nothing stays
literal. Each factor has ``window`` words or more, and all its words go. The index keeps
two places of each block, not all, so a factor may end where those two part from the
document though a third place goes on; the next factor starts there, and no word is lost.

Scale. About one row for 14 words is shuffled, pre-aggregated by hash; the counts are
joined back, and Spark splits frequent keys there (AQE skew join). Windows are only
shuffled for blocks with shared anchors. No group is ever collected but the spans of
one document. Keys have 128 bits: the anchor's hash with the block's or the window's.

Edges: a null text has no words; empty and short texts lose nothing; a text repeated
in full loses all words of all copies if it has a window; rows are told apart by
doc_id and text, and rows equal in both are returned each.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, drop_work_table, mix, rolling, small_batches, work_table

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WINDOW, ANCHOR = 35, 8

_hashes = WordHashes()


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def blocks_of(words: np.ndarray, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, block hash, first window, last window) of each block, in order."""
    n = len(words) - window + 1
    if n < 1:
        none = np.zeros(0, np.uint64)
        return none, none, none.astype(np.int64), none.astype(np.int64)
    grams = rolling(words, anchor)
    span = window - anchor + 1
    at = np.empty(n, np.int64)
    for k in range(0, n, 1 << 16):
        view = np.lib.stride_tricks.sliding_window_view(grams[k : k + (1 << 16) + span - 1], span)[: n - k]
        at[k : k + len(view)] = view.argmin(axis=1) + np.arange(k, k + len(view))
    lo = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    hi = np.concatenate((lo[1:] - 1, [n - 1]))
    place = at[lo]
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(words) * powers(len(words), BASE), dtype=np.uint64)))
    body = (total[hi + window] - total[lo]) * powers(len(words), INVERSE)[lo]
    shape = (hi - lo).astype(np.uint64) * np.uint64(1 << 20) + (place - lo).astype(np.uint64)
    return grams[place], mix(mix(body) + shape), lo, hi


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _words(text: bytes | None) -> list[bytes]:
    return text.split() if text else []


def _blocks(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            rows = [[] for _ in range(6)]
            size = 0
            for i, text in enumerate(b.column(2)):
                words = _words(text.as_py())
                if len(words) < window:
                    continue
                parts = blocks_of(_hashes.of(words), window, anchor)
                n = len(parts[0])
                for out, x in zip(rows, (*parts, np.full(n, k1[i]), np.full(n, k2[i]))):
                    out.append(x)
                size += n
                if size > 200_000:
                    yield pack(rows)
                    rows, size = [[] for _ in range(6)], 0
            if size:
                yield pack(rows)

    def pack(rows: list) -> pa.RecordBatch:
        h, run_, lo, hi, k1, k2 = map(np.concatenate, rows)
        return pa.RecordBatch.from_arrays([_signed(h), _signed(run_), pa.array(k1), pa.array(k2), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32))], names=["h", "run", "k1", "k2", "lo", "hi"])

    return docs.select("k1", "k2", "raw").mapInArrow(run, "h long, run long, k1 long, k2 long, lo int, hi int")


def _windows(edges: DataFrame, window: int, anchor: int) -> DataFrame:
    """The windows of chosen blocks; ``spans`` holds (lo, hi, copies) of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k1, k2 = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, (text, spans) in enumerate(zip(b.column(2), b.column(3))):
                words = _hashes.of(_words(text.as_py()))
                chosen = np.unique(np.array(spans.as_py(), np.int64))
                lo, hi, copies = chosen >> 33, chosen >> 2 & 0x7FFFFFFF, chosen & 3
                n = hi - lo + 1
                start = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                copies = np.repeat(copies, n)
                w = rolling(words, window)[start]
                g = rolling(words[::-1], window)[::-1][start]  # a second hash: together 128 bits
                for k in range(0, len(w), 1 << 17):
                    s = slice(k, k + (1 << 17))
                    yield pa.RecordBatch.from_arrays([_signed(w[s]), _signed(np.ascontiguousarray(g[s])), pa.array(np.full(len(w[s]), k1[i])), pa.array(np.full(len(w[s]), k2[i])), pa.array(start[s].astype(np.int32)), pa.array(copies[s].astype(np.int32))], names=["w", "g", "k1", "k2", "lo", "copies"])

    return edges.mapInArrow(run, "w long, g long, k1 long, k2 long, lo int, copies int")


def duplicate_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(k1, k2, spans): for each document with duplicate windows, the ranges of their
    starts, each as (range, packed as ``first << 31 | last``; k1 of the document where it
    stands again; how much further on it starts there). ``docs`` has k1, k2 and raw."""
    # where else: the first place, or the last for what stands at the first
    other = F.when((F.col("one.k1") == F.col("k1")) & (F.col("one.lo") == F.col("lo")), F.col("two")).otherwise(F.struct("one.k1", "one.lo"))
    ends = lambda hi: F.struct((F.shiftleft(F.col("lo").cast("long"), 31) + F.col(hi)).alias("span"), other["k1"].alias("source"), (other["lo"] - F.col("lo")).alias("further")).alias("span")
    blocks = work_table(_blocks(docs, window, anchor), "blocks")
    index = blocks.groupBy("h", "run").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("k1", "k2", "lo", "hi")).alias("one"), F.max(F.struct("k1", "lo")).alias("two"))
    index = work_table(index, "block-index")
    anchors = index.groupBy("h").agg(F.count(F.lit(1)).alias("kinds"), F.max((F.col("n") == 1).cast("int")).alias("single")).where("kinds > 1 AND single = 1").select("h")
    whole = blocks.join(index.where("n > 1").select("h", "run", "one", "two"), ["h", "run"]).select("k1", "k2", ends("hi"))
    border = index.join(anchors, "h", "left_semi").select("one.*", F.least(F.col("n"), F.lit(2)).alias("copies"))
    border = border.groupBy("k1", "k2").agg(F.collect_list(F.shiftleft(F.col("lo").cast("long"), 33) + F.shiftleft(F.col("hi").cast("long"), 2) + F.col("copies")).alias("chosen"))
    # equal rows share k1 and k2: one of them will do
    windows = _windows(docs.join(border, ["k1", "k2"]).select("k1", "k2", "raw", "chosen"), window, anchor)
    windows = work_table(windows, "border-windows")
    again = windows.groupBy("w", "g").agg(F.sum("copies").alias("n"), F.min("copies").alias("least"), F.min(F.struct("k1", "lo")).alias("one"), F.max(F.struct("k1", "lo")).alias("two")).where("n > 1 AND least = 1").select("w", "g", "one", "two")
    found = windows.where("copies = 1").join(again, ["w", "g"]).select("k1", "k2", ends("lo"))
    spans = work_table(whole.unionByName(found).groupBy("k1", "k2").agg(F.collect_set("span").alias("spans")), "spans")
    for table in (blocks, index, windows):
        drop_work_table(table)
    return spans


def on_diagonals(spans: np.ndarray, source: np.ndarray, further: np.ndarray) -> np.ndarray:
    """Packed ranges of windows, neighbouring ones on one diagonal joined."""
    order = np.lexsort((spans, further, source))
    lo, hi, source, further = spans[order] >> 31, spans[order] & 0x7FFFFFFF, source[order], further[order]
    new = np.ones(len(lo), bool)
    new[1:] = (source[1:] != source[:-1]) | (further[1:] != further[:-1]) | (lo[1:] > hi[:-1] + 1)
    starts = np.flatnonzero(new)
    return (lo[starts] << 31) + np.maximum.reduceat(hi, starts)


def factor(spans: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Greedy parse of a document into (first word, words) of its factors, in order;
    ``spans`` are the matched ranges of window starts, packed. The windows that two
    neighbouring factors share words with belong to one of them, so none is lost at
    a boundary."""
    spans = np.sort(spans)
    los, his = (spans >> 31).tolist(), (spans & 0x7FFFFFFF).tolist()
    out, at, reach, i = [], 0, -1, 0
    while i < len(los) or reach >= at:
        while i < len(los) and los[i] <= at:
            reach = max(reach, his[i])
            i += 1
        if reach >= at:
            out.append((at, reach - at + window))
            at = reach + 1
        elif i < len(los):
            at = los[i]
    return out


def covered(n_words: int, factors: list[tuple[int, int]]) -> np.ndarray:
    """Whether any factor covers each word."""
    out = np.zeros(n_words, bool)
    for first, words in factors:
        out[first : first + words] = True
    return out


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """k1, k2 (what tells rows apart) and raw (the text's bytes) beside all columns."""
    return docs.withColumns({"k1": F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), "k2": F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col)), "raw": F.col(text_col).cast("string").cast("binary")})


def dedup_substrings(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_words, n_removed, n_factors, kept, rest): ``kept`` holds the words that
    stay, as bytes of UTF-8, joined by one blank; ``rest`` the columns named in ``carry``."""
    small_batches(docs.sparkSession)
    rest = F.struct(*[F.col(c) for c in carry]) if carry else F.lit(None).cast("boolean")
    src = keyed(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), rest.alias("rest")), "doc_id", "text").drop("text")
    spans = duplicate_spans(src, window, anchor)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, parts, kept = [], [], [], []
            for text, spans in zip(b.column(1), b.column(2)):
                words = _words(text.as_py())
                n.append(len(words))
                found = factor(on_diagonals(*(x.to_numpy() for x in spans.values.flatten())), window) if spans.is_valid else []
                cut = covered(len(words), found)
                parts.append(len(found))
                gone.append(int(cut.sum()))
                if found:
                    words = compress(words, (~cut).tolist())
                kept.append(b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(parts, pa.int64()), pa.array(kept, pa.binary()), b.column(3)], names=["doc_id", "n_words", "n_removed", "n_factors", "kept", "rest"])

    kind, rest_kind = (src.schema[c].dataType.simpleString() for c in ("doc_id", "rest"))
    joined = src.join(spans, ["k1", "k2"], "left").select("doc_id", "raw", "spans", "rest")
    return joined.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, n_factors long, kept binary, rest {rest_kind}")
