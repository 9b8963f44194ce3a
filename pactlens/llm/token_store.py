"""Token ids as binary shards with a minimal perfect hash index.

A shard file holds, in this order: the raw ids of its documents, one after another
(little-endian uint16 where the vocabulary allows, else uint32); the documents' keys
in file order; the index; a footer with the sections' places. The index is a minimal
perfect hash of the keys: a key claims one bit in a bit array, keys that clash move to
the next, smaller array, and the rank of a key's bit is its slot. A slot stores a
fingerprint of the key and the place of its ids, so any document is found with a few
reads, and a key that was never stored is known by its fingerprint.

Documents are range-partitioned by key, so shards ascend, and the manifest holds each
one's least and largest key: a key leads to its shard (or shards, where equal keys go
over a border) by binary search, and there to its ids. A task writes files under fresh
names and reports them in the manifest; only files in the manifest count, so a
lost or repeated task leaves no trace. Memory: one batch of texts and the index of one
shard, which ``max_docs`` and ``max_ids`` bound.

Edges: a null text counts as empty, and each document ends with the end id, so none
has no ids. Null keys come first. A key that occurs k times has the k entries
(key, 0) .. (key, k - 1), in the order of their texts' hashes.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import filesystem, mix, new_dir, work_table

MAGIC = b"PLTOKS01"
FOOTER = struct.Struct("<QQQQB7x8s")  # documents, ids, place of keys, place of index, bytes of an id, magic
GAMMA, LEVELS = 2.0, 48
MANIFEST = "partition int, seq int, file string, n_docs bigint, n_ids bigint, nulls boolean, least bigint, most bigint"
#: Documents that one task reads back of a shard at once.
PIECE = 1 << 16
#: Tasks that share the keys of one shard, each with the shard's index.
TASKS_A_SHARD = 4
#: Shards whose key ranges the driver holds at most: 24 MB.
MOST_SHARDS = 1_000_000


# --- the tokenizer -------------------------------------------------------------------


#: ASCII marks that may follow a word: not an apostrophe, which may begin a piece with
#: letters (``'s``), nor the bar, which the separator and added tokens hold.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{}~"
#: Letters of Latin-1: each is one letter in lower case, in any version of Unicode.
LETTERS = "".join(chr(c) for c in range(256) if chr(c).isalpha())
AFTER_WORD = re.compile(rf"([{re.escape(MARKS)}])(?<=[{LETTERS}].)([{re.escape(MARKS)}]*)(?![^ \n])", re.S)


def spaced(text: str) -> str:
    """A text of the same ids with fewer different words: marks after a word stand by
    themselves, for the tokenizer cuts between a letter and a mark; and letters are small
    where its lower case and Python's are the same and no added token can arise."""
    if "|" not in text:
        try:
            text.encode("latin-1")
            text = text.lower()
        except UnicodeEncodeError:
            pass
    return AFTER_WORD.sub(r" \1\2", text)


class WordIds:
    """word between blanks -> packed ids; a bounded memo over the tokenizers library.

    Blanks separate the pieces of this tokenizer and have no ids of their own, so a
    text's ids are those of its words, one after another. New words are encoded some
    thousands at a time as one text with a separator between them: a call for each word
    takes twice the time. Words that hold the separator are encoded one by one.
    """

    SEPARATOR, TOGETHER = "|", 4096

    def __init__(self, path: str, kind: str, limit: int = 700_000):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals out the work
        from tokenizers import Tokenizer

        self.kind, self.limit = kind, limit
        self.library = Tokenizer.from_file(path)
        self.between = self._ids([self.SEPARATOR])[0]
        self.known: dict[str, bytes] = {"": b""}

    def _ids(self, words: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        alone = [w for w in words if self.SEPARATOR in w] if len(self.between) == 1 else words
        self.known.update(zip(alone, (x.tobytes() for x in self._ids(alone))))
        if alone is words:
            return
        words = [w for w in words if self.SEPARATOR not in w]
        for k in range(0, len(words), self.TOGETHER):
            part = words[k : k + self.TOGETHER]
            ids = self._ids([f" {self.SEPARATOR} ".join(part)])[0]
            ends = [*np.flatnonzero(ids == self.between[0]).tolist(), len(ids)]
            if len(ends) != len(part):
                raise ValueError("the tokenizer does not keep the separator apart")
            raw, width, start = ids.tobytes(), ids.itemsize, 0
            for w, end in zip(part, ends):
                self.known[w] = raw[start * width : end * width]
                start = end + 1

    def encode(self, texts: list[str]) -> list[bytes]:
        words = [spaced(t).replace("\n", " ").split(" ") for t in texts]
        met = set().union(*words)
        new = met.difference(self.known)
        if len(self.known) + len(new) > self.limit:
            self.known = {"": b""}
            new = met - {""}
        self._learn(list(new))
        of = self.known.__getitem__
        return [b"".join(map(of, ws)) for ws in words]


@lru_cache(2)
def word_ids(path: str, kind: str) -> WordIds:
    return WordIds(path, kind)


# --- the index -----------------------------------------------------------------------


def key_hash(keys: np.ndarray, null: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64 bits for (key, null?, how many equal keys came before)."""
    which = nth.astype(np.uint64) * np.uint64(2) + null.astype(np.uint64)
    return mix(mix(keys.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + mix(~which))


def _bit(h: np.ndarray, level: int, size: int) -> np.ndarray:
    return (mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix(~h) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit hashes: ``n`` keys to 0 .. n - 1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, done = [], 0
        for bits in levels:
            counts = np.cumsum(bits.astype(np.int64))
            self.ranks.append(counts - 1 + done)
            done += int(counts[-1]) if len(counts) else 0

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        levels = []
        while len(h):
            if len(levels) == LEVELS:
                raise ValueError("equal key hashes")
            size = max(8, int(GAMMA * len(h)))
            at = _bit(h, len(levels), size)
            once = np.bincount(at, minlength=size) == 1
            levels.append(once)
            h = h[~once[at]]
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash; -1 where no level has its bit."""
        out = np.full(len(h), -1, np.int64)
        rest = np.arange(len(h))
        for level, bits in enumerate(self.levels):
            at = _bit(h[rest], level, len(bits))
            hit = bits[at]
            out[rest[hit]] = self.ranks[level][at[hit]]
            rest = rest[~hit]
        return out

    def dump(self) -> bytes:
        sizes = np.array([len(x) for x in self.levels], "<u8")
        return struct.pack("<Q", len(sizes)) + sizes.tobytes() + b"".join(np.packbits(x).tobytes() for x in self.levels)

    @classmethod
    def load(cls, raw: bytes) -> tuple[PerfectHash, int]:
        n = struct.unpack_from("<Q", raw)[0]
        sizes, at, levels = np.frombuffer(raw, "<u8", n, 8), 8 + 8 * n, []
        for size in sizes.tolist():
            width = (size + 7) // 8
            levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, width, at), count=size).astype(bool))
            at += width
        return cls(levels), at


SLOT = np.dtype([("fingerprint", "<u4"), ("start", "<u8"), ("length", "<u8")])
KEY = np.dtype([("key", "<i8"), ("null", "u1"), ("nth", "<u4")])


class ShardWriter:
    """One file; closed when full."""

    def __init__(self, folder: str, kind: str):
        self.fs, root = filesystem(folder)
        self.name = f"ids-{uuid.uuid4().hex}.bin"
        self.kind, self.n_ids, self.lengths, self.keys = kind, 0, [], []
        self.out = self.fs.open_output_stream(f"{root}/{self.name}")

    def add(self, key: int | None, nth: int, packed: bytes) -> None:
        self.out.write(packed)
        n = len(packed) // np.dtype(self.kind).itemsize
        self.lengths.append(n)
        self.keys.append((key or 0, key is None, nth))
        self.n_ids += n

    def close(self) -> None:
        keys = np.array(self.keys, KEY)
        h = key_hash(keys["key"], keys["null"], keys["nth"])
        table = PerfectHash.build(h)
        slots = np.zeros(len(keys), SLOT)
        lengths = np.array(self.lengths, np.int64)
        at = table.slots(h)
        slots["fingerprint"][at] = fingerprint(h)
        slots["start"][at] = np.cumsum(lengths) - lengths
        slots["length"][at] = lengths
        width = np.dtype(self.kind).itemsize
        self.out.write(keys.tobytes())
        self.out.write(table.dump() + slots.tobytes())
        place = self.n_ids * width
        self.out.write(FOOTER.pack(len(keys), self.n_ids, place, place + keys.nbytes, width, MAGIC))
        self.out.close()


class ShardReader:
    """Keyed access to one file: the index in memory, ids read on demand."""

    def __init__(self, folder: str, name: str):
        fs, root = filesystem(folder)
        self.file = fs.open_input_file(f"{root}/{name}")
        size = self.file.size()
        self.n, self.n_ids, at_keys, at_index, self.width, magic = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{name} is no shard of token ids")
        self.keys = np.frombuffer(self.file.read_at(at_index - at_keys, at_keys), KEY)
        raw = self.file.read_at(size - FOOTER.size - at_index, at_index)
        self.table, at = PerfectHash.load(raw)
        self.slots = np.frombuffer(raw, SLOT, self.n, at)

    def find(self, keys: np.ndarray, null: np.ndarray, nth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(found, start, length) of each key."""
        h = key_hash(keys, null, nth)
        at = self.table.slots(h) if self.n else np.full(len(h), -1)
        found = at >= 0
        slot = self.slots[np.where(found, at, 0)] if self.n else np.zeros(len(h), SLOT)
        found &= slot["fingerprint"] == fingerprint(h)
        return found, slot["start"].astype(np.int64), slot["length"].astype(np.int64)

    def ids(self, start: int, length: int) -> np.ndarray:
        raw = self.file.read_at(length * self.width, start * self.width)
        return np.frombuffer(raw, f"<u{self.width}").astype("<u4")


# --- Spark ---------------------------------------------------------------------------


def write_shards(docs: DataFrame, path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", wide: bool = False, max_docs: int = 1 << 19, max_ids: int = 1 << 28) -> tuple[DataFrame, str]:
    """Encode and write all documents; (manifest, folder).

    One shuffle: a range partitioning by key. Equal keys are dealt by their texts'
    hashes, so one frequent key does not fill one task.
    """
    spark = docs.sparkSession
    folder = folder or new_dir(spark, "token-ids")
    fs, root = filesystem(folder)
    fs.create_dir(root, recursive=True)
    kind = "<u4" if wide else "<u2"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]
    dealt = src.repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = pa.schema([("partition", pa.int32()), ("seq", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("nulls", pa.bool_()), ("least", pa.int64()), ("most", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = word_ids(path, kind), np.array([end_id], kind).tobytes()
        writer, before, nth, done = None, object(), 0, []
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            for k in range(0, len(ids), 512):
                for key, packed in zip(ids[k : k + 512], words.encode(texts.slice(k, 512).to_pylist())):
                    if writer and (len(writer.keys) >= max_docs or writer.n_ids >= max_ids):
                        writer.close()
                        done.append(writer)
                        writer = None
                    if writer is None:
                        writer, before = ShardWriter(folder, kind), object()
                    nth = nth + 1 if key == before else 0
                    before = key
                    writer.add(key, nth, packed + end)
        if writer:
            writer.close()
            done.append(writer)
        part = TaskContext.get().partitionId()
        rows = []
        for seq, w in enumerate(done):
            known = [key for key, null, _ in w.keys if not null]
            rows.append({"partition": part, "seq": seq, "file": w.name, "n_docs": len(w.keys), "n_ids": w.n_ids, "nulls": len(known) < len(w.keys), "least": known[0] if known else None, "most": known[-1] if known else None})
        yield pa.RecordBatch.from_pylist(rows, schema)

    manifest = work_table(dealt.mapInArrow(run, MANIFEST), "token-ids-manifest")
    return manifest, folder


def read_shards(manifest: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, by its key.

    ``start`` counts the ids of all shards and documents before it. The manifest has
    one row a shard, so its running sum is the only step in one task. Shards are read
    in pieces of PIECE documents, dealt to as many tasks as the session shuffles to; the
    number is given, lest small rows that stand for much reading are merged into one task.
    """
    before = Window.orderBy("partition", "seq").rowsBetween(Window.unboundedPreceding, -1)
    shards = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, base, first in zip(frame["file"], frame["base"], frame["first"]):
                shard = ShardReader(folder, name)
                for k in range(first, min(first + PIECE, shard.n), 1 << 14):
                    keys = shard.keys[k : min(k + (1 << 14), first + PIECE)]
                    found, start, length = shard.find(keys["key"], keys["null"], keys["nth"])
                    if not found.all():
                        raise ValueError(f"{name}: a stored key was not found")
                    crc = [zlib.crc32(shard.ids(s, n).tobytes()) for s, n in zip(start.tolist(), length.tolist())]
                    yield pd.DataFrame({"doc_id": pd.arrays.IntegerArray(keys["key"].astype(np.int64), keys["null"].astype(bool)), "start": start + base, "n_tokens": length, "ids_crc32": crc})

    pieces = shards.select("file", "base", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_docs") - 1, F.lit(PIECE).cast("long"))).alias("first"))
    tasks = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, "file", "first").mapInPandas(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def lookup(manifest: DataFrame, folder: str, keys: DataFrame, key_col: str = "doc_id") -> DataFrame:
    """(key, nth, ids) of the stored documents with the keys in ``keys``, ``nth`` counting
    equal keys within a shard: keys never
    stored give no row, a key stored k times gives k, and repeated keys count once; a
    null key finds the documents without one.

    The directory, one range a shard, is a bounded array in every task: more than
    MOST_SHARDS shards stop the job (then write larger ones). It deals keys to shards;
    a task opens each of its shards once and takes a few reads a key; a shard that many keys
    ask for is shared by TASKS_A_SHARD tasks.
    """
    rows = manifest.select("file", "nulls", "least", "most", "partition", "seq").orderBy("partition", "seq").limit(MOST_SHARDS + 1).collect()
    if len(rows) > MOST_SHARDS:
        raise ValueError("too many shards for the directory: write larger ones")
    files = [r.file for r in rows]
    full = [k for k, r in enumerate(rows) if r.least is not None]
    least, most = (np.array([rows[k][c] for k in full], np.int64) for c in ("least", "most"))
    without = [k for k, r in enumerate(rows) if r.nulls]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = b.column(0).to_pylist()
            known = np.array([k or 0 for k in key], np.int64)
            lo, hi = np.searchsorted(most, known, "left").tolist(), np.searchsorted(least, known, "right").tolist()
            met = [(k, f) for k, a, z in zip(key, lo, hi) for f in (without if k is None else full[a:z])]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in met], pa.int64()), pa.array([files[f] for _, f in met], pa.string())], names=["key", "file"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, shard = None, None
        for b in batches:
            out, size = [], 0
            for key, file in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if file != name:
                    name, shard = file, ShardReader(folder, file)
                nth = 0
                while True:
                    found, start, length = shard.find(np.array([key or 0], np.int64), np.array([key is None]), np.array([nth], np.int64))
                    if not found[0]:
                        break
                    out.append({"key": key, "nth": nth, "ids": shard.ids(int(start[0]), int(length[0])).tolist()})
                    nth, size = nth + 1, size + int(length[0])
                    if size > 1 << 20:
                        yield pa.RecordBatch.from_pylist(out, found_schema)
                        out, size = [], 0
            yield pa.RecordBatch.from_pylist(out, found_schema)

    found_schema = pa.schema([("key", pa.int64()), ("nth", pa.int32()), ("ids", pa.list_(pa.int64()))])
    asked = keys.select(F.col(key_col).cast("long").alias("key")).distinct().mapInArrow(route, "key long, file string")
    tasks = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given: a few keys stand for much reading
    dealt = asked.repartition(tasks, "file", F.pmod(F.xxhash64("key"), F.lit(TASKS_A_SHARD)))
    return dealt.sortWithinPartitions("file", "key").mapInArrow(read, "key long, nth int, ids array<bigint>")
