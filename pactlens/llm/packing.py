"""Documents packed into as few token sequences as can be, by reduction and best fit.

Every document is encoded, ended by an end id, and cut only if it is longer than a
sequence. Pieces of equal length are as good as each other, so a packing is a matter of
how many pieces there are of each length: at most ``capacity`` numbers, counted by Spark,
are all that the driver sees. Over them the packing is planned in whole groups:

1. Reduction (Martello and Toth): for a length, from the longest on, a set with at most
   two companions is sought that dominates every other set with it: whatever else may
   share its sequence could be put in the companions' places. Such a set is fixed for good,
   as many times as its lengths occur, and the instance shrinks. A length that nothing
   fits beside, an exact complement, the longest fitting one where no two others fit
   together, and a pair that no other pair beats are such cases.
2. What is left is packed by best fit, longest first, again many equal pieces at a time.

The plan says which ranks of a length go to which sequences. Each task numbered its pieces
of each length; the tasks' counts, summed up before it, make these numbers ranks over all
documents. So pieces find their sequence by one join on (task, length) and a search in the
plan; no length is gathered anywhere, however many documents have it.

Bounds: a sequence has pieces of at most sqrt(2 capacity) different lengths, so the plan
has under 6 capacity sqrt(2 capacity) rows (0.8 million for 2048) and usually a few
thousand.

Edges: a null or empty text is the end id alone. Repeated rows are packed once each. A null
id stays null. Equal lengths go by task and place. An empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, work_table

#: How byte-level vocabularies part a text before merging; a fixed value of the format.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Texts from this size on are encoded straight into an array.
LONG_TEXT = 1 << 20


class Encoder:
    """Token ids of a byte-level BPE file of the tokenizers library.

    Where merges are listed in the order of their ids, merging by rank gives the same ids
    three times as fast; the file is looked at for that. Texts that hold an added token,
    and files of any other kind, go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [t["content"] for t in told.get("added_tokens") or []]
        self.fast = self._by_rank(told)

    @staticmethod
    def _by_rank(told: dict):
        import tiktoken

        pre, model = told.get("pre_tokenizer") or {}, told["model"]
        plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer")
        if not plain or model.get("type") != "BPE" or any(model.get(k) for k in ("dropout", "ignore_merges", "byte_fallback", "end_of_word_suffix", "continuing_subword_prefix")):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # these bytes stand for themselves
        hidden = [b for b in range(256) if b not in set(shown)]
        byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
        added = {t["content"] for t in told.get("added_tokens") or []}
        vocab = {t: i for t, i in model["vocab"].items() if t not in added}
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ordered = all(a < b for a, b in zip(made, made[1:])) and len(set(vocab.values()) - set(made)) == 256
        if not ordered or any(c not in byte for t in vocab for c in t):
            return None
        ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
        return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or any(t in text for t in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        if len(text) >= LONG_TEXT:
            return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4")
        return np.array(self.fast.encode_ordinary(text), "<u4")


@lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


# --- the plan ------------------------------------------------------------------------


class Counts:
    """How many pieces there are of each length."""

    def __init__(self, counts: dict[int, int]):
        self.of = {n: k for n, k in counts.items() if k > 0}
        self.sizes = sorted(self.of)

    def take(self, size: int, n: int) -> None:
        self.of[size] -= n
        if not self.of[size]:
            del self.of[size]
            self.sizes.remove(size)

    def add(self, size: int, n: int) -> None:
        if size not in self.of:
            bisect.insort(self.sizes, size)
        self.of[size] = self.of.get(size, 0) + n

    def largest(self, most: int) -> int:
        """The longest length up to ``most``; 0 if there is none."""
        k = bisect.bisect_right(self.sizes, most)
        return self.sizes[k - 1] if k else 0

    def smallest(self, n: int, above: int = 0, below: int | None = None) -> list[int]:
        """The ``n`` shortest pieces between two lengths, both left out."""
        out: list[int] = []
        for size in self.sizes[bisect.bisect_right(self.sizes, above) :]:
            if len(out) >= n or below is not None and size >= below:
                break
            out += [size] * min(n - len(out), self.of[size])
        return out

    def best_pair(self, room: int) -> int:
        """The largest sum of two pieces that fit; 0 if no two do."""
        best, i, j = 0, 0, bisect.bisect_right(self.sizes, room) - 1
        while i <= j:
            total = self.sizes[i] + self.sizes[j]
            if total > room or i == j and self.of[self.sizes[i]] < 2:
                j -= 1
            else:
                best, i = max(best, total), i + 1
        return best


def dominating(rest: Counts, size: int, capacity: int) -> tuple[int, ...] | None:
    """The companions with which a piece of ``size`` is provably best off, among sets of
    at most two; None if these rules prove none. ``rest`` has the other pieces."""
    room = capacity - size
    first = rest.largest(room)
    if not first:
        return ()
    small = rest.smallest(3)
    if first == room or sum(small[:2]) > room or len(small) < 2:
        return (first,)
    if len(small) == 3 and sum(small) <= room:
        return None
    second = rest.largest(room - first)
    if second == first and rest.of[first] < 2:
        second = rest.largest(min(room - first, first - 1))
    if not second:
        return (first,) if first >= rest.best_pair(room) else None
    between = rest.smallest(2, above=second, below=first)
    return (first, second) if len(between) < 2 or sum(between) > room else None


class Plan:
    """Which ranks of each length go where: rows (length, first rank, pieces, pieces a
    sequence, first sequence, offset)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.next = dict.fromkeys(counts, 0)
        self.fixed = 0
        left = Counts(counts)
        self._reduce(left)
        self._best_fit(left)

    def _put(self, size: int, sequences: int, each: int, first: int, offset: int) -> None:
        self.rows.append((size, self.next[size], sequences * each, each, first, offset))
        self.next[size] += sequences * each

    def _reduce(self, left: Counts) -> None:
        changed = True
        while changed:
            changed = False
            for size in reversed(left.sizes[:]):
                while left.of.get(size):
                    left.take(size, 1)
                    with_ = dominating(left, size, self.capacity)
                    left.add(size, 1)
                    if with_ is None:
                        break
                    members = {m: (size, *with_).count(m) for m in (size, *with_)}
                    n = min(left.of[m] // k for m, k in members.items())
                    offset = 0
                    for m, k in members.items():
                        self._put(m, n, k, self.sequences, offset)
                        offset += k * m
                        left.take(m, n * k)
                    self.sequences += n
                    self.fixed += n
                    changed = True

    def _best_fit(self, left: Counts) -> None:
        open_: dict[int, list[tuple[int, int]]] = {}  # room left: ranges of sequences (first, how many)
        rooms: list[int] = []

        def push(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in open_:
                    bisect.insort(rooms, room)
                open_.setdefault(room, []).append((first, n))

        for size in reversed(left.sizes):
            todo = left.of[size]
            while todo:
                k = bisect.bisect_left(rooms, size)
                if k < len(rooms):
                    room = rooms[k]
                    first, n = open_[room].pop()
                    if not open_[room]:
                        del open_[room], rooms[k]
                else:
                    room, first, n = self.capacity, self.sequences, -(-todo // (self.capacity // size))
                    self.sequences += n
                each = room // size
                full, some = min(n, todo // each), 0
                if full:
                    self._put(size, full, each, first, self.capacity - room)
                    push(room - each * size, first, full)
                if full < n:
                    some = todo - full * each
                    if some:
                        self._put(size, 1, some, first + full, self.capacity - room)
                        push(room - some * size, first + full, 1)
                    push(room, first + full + bool(some), n - full - bool(some))
                todo -= full * each + some


# --- Spark ---------------------------------------------------------------------------

PIECES = "id {}, task int, piece int, start bigint, length int, ids_crc32 bigint, nth bigint"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: whole sequences, the rest first."""
    first = n % capacity or capacity
    return [(0, first)] + [(k, capacity) for k in range(first, n, capacity)]


def token_pieces(docs: DataFrame, path: str, capacity: int, end_id: int, id_col: str, text_col: str, with_ids: bool) -> DataFrame:
    """The pieces of every document, each with its number among its task's of that length."""
    small_batches(docs.sparkSession)
    src = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, met, task = encoder(path), np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for b in batches:
            rows, of, ids = [], [], []
            for k, text in enumerate(b.column(1).to_pylist()):
                got = np.append(enc.encode(text), np.array([end_id], "<u4"))
                for piece, (start, length) in enumerate(cut(len(got), capacity)):
                    part = got[start : start + length]
                    rows.append((piece, start, length, zlib.crc32(part.tobytes()), int(met[length])))
                    met[length] += 1
                    of.append(k)
                    if with_ids:
                        ids.append(part)
            piece, start, length, crc, nth = (list(c) for c in zip(*rows)) if rows else ([],) * 5
            columns = [b.column(0).take(pa.array(of, pa.int64())), pa.array([task] * len(rows), pa.int32()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64()), pa.array(nth, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "task", "piece", "start", "length", "ids_crc32", "nth", *["ids"] * with_ids])

    schema = PIECES.format(src.schema["id"].dataType.simpleString()) + ", ids array<bigint>" * with_ids
    return src.mapInArrow(run, schema)


def placed(ranked: DataFrame, plan: Plan) -> DataFrame:
    """``ranked`` (.., length, rank) with sequence_id and offset."""
    rows = np.array(sorted(plan.rows), np.int64).reshape(-1, 6)
    key = (rows[:, 0] << 44) + rows[:, 1]
    _, low, _, each, first, offset = rows.T

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy().astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 44) + rank, "right") - 1
            nth = rank - low[at]
            where = {"sequence_id": first[at] + nth // each[at], "offset": offset[at] + nth % each[at] * length}
            columns = {n: c for n, c in zip(b.schema.names, b.columns) if n != "rank"}
            yield pa.RecordBatch.from_pydict(columns | {n: pa.array(v, pa.int64()) for n, v in where.items()})

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(run, f"{kind}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(the id, piece, start, length, ids_crc32, sequence_id, offset[, ids]) of every piece."""
    pieces = work_table(token_pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), "packing-pieces")
    by_task = pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = work_table(by_task.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "packing-counts")
    counts = {r["length"]: r["n"] for r in bases.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    ids = ["ids"] if with_ids else []
    ranked = pieces.join(bases.drop("n"), ["task", "length"]).select("id", "piece", "start", "length", "ids_crc32", *ids, (F.col("base") + F.col("nth")).alias("rank"))
    out = placed(ranked, Plan(counts, capacity))
    return out.select(F.col("id").alias(id_col), "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset", *ids)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_pieces, n_tokens, ids): the sequences themselves, of a packing with
    ids; a sequence holds at most its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    out = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    flat = F.flatten(F.transform("parts", lambda p: p["ids"]))
    return out.select("sequence_id", F.size("parts").alias("n_pieces"), F.size(flat).alias("n_tokens"), flat.alias("ids"))
