"""Byte-level BPE encoding and decoding with exact merges in linear time.

A rank file lists byte strings by the order in which they were merged. Instead of
repeating merges, an Aho-Corasick automaton over the vocabulary (bytes mapped to
Latin-1) yields every token at every place of a piece. The encoder takes the longest
one and goes on; it keeps a token only if the merges would keep it beside the one
before it, which depends on the two tokens alone and is memoised. Where no token
fits, it goes back one token and tries the next shorter. A position that led nowhere
is closed for good, so the steps are linear in the piece.

Edges: a null text counts as empty; an empty text has no ids; texts of any length
are read piece by piece; repeated rows and further columns are left as they are.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

#: Texts longer than this (in characters) are split into pieces by parts.
PART = 1 << 20


#: Latin letters up to U+00FF but for the two ordinal signs; then what is beyond such text.
LATIN = "A-Za-z\u00b5\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
NOT_LATIN = re.compile(rf"[^\x00-\x7f{LATIN}]")


def latin_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts of ASCII and LATIN alone, where plain character ranges
    stand for the Unicode classes; None if it uses other classes."""
    plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^ \t-\r{LATIN}0-9]").replace(r"\p{L}", f"[{LATIN}]").replace(r"\p{N}", "[0-9]")
    plain = plain.replace(r"\s", r"[ \t-\r]").replace(r"\S", r"[^ \t-\r]")
    return None if re.search(r"\\[a-qsu-zA-Z]", plain) else re.compile(plain)


class ByteBpe(dict):
    """piece (str) -> its ids as packed little-endian uint32; a bounded memo."""

    def __init__(self, path: str, pattern: str, limit: int = 500_000):
        import ahocorasick
        import regex

        super().__init__()
        self.limit = limit
        self.find = regex.compile(pattern)
        self.latin = latin_pattern(pattern)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        size = max(self.ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.ranks.items():
            self.bytes_of[i] = token
        self.length = [len(t) for t in self.bytes_of]
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in sorted(self.ranks.items(), key=lambda x: x[1]):
            if len(token) > 1 and (parts := self._parts(token, i)):
                self.left[i], self.right[i] = parts
                self.merged[parts] = i
        self.automaton = ahocorasick.Automaton()
        for token, i in self.ranks.items():
            self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        #: each token's longest proper prefix that is a token, -1 for a single byte
        self.shorter = [next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1) for t in self.bytes_of]
        self.fits: dict[tuple[int, int], bool] = {}

    def _parts(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one, by the merges before it."""
        ids = [self.ranks[token[k : k + 1]] for k in range(len(token))]
        while len(ids) > 2:
            best = min((self.merged.get(p, rank) for p in zip(ids, ids[1:])), default=rank)
            if best >= rank:
                return None
            out, k = [], 0
            while k < len(ids):
                if k + 1 < len(ids) and self.merged.get((ids[k], ids[k + 1])) == best:
                    out.append(best)
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return (ids[0], ids[1]) if len(ids) == 2 else None

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave ``a`` and ``b`` side by side.

        Undo the later merge of the two over and over; were a pair across their
        border ever merged before the merge being undone, they would not meet.
        """
        known = self.fits.get((a, b))
        if known is not None:
            return known
        x, y, before, good = a, b, len(self.length), True
        while True:
            if self.merged.get((x, y), before) < before:
                good = False
                break
            if x > y:
                undo_left = self.left[x] != x
            else:
                undo_left = self.left[y] == y and self.left[x] != x
            if undo_left:
                before, x = x, self.right[x]
            elif self.left[y] != y:
                # of two equal merges the one further left came first
                before, y = y + 1, self.left[y]
            else:
                break
        if len(self.fits) > 2_000_000:
            self.fits.clear()
        self.fits[a, b] = good
        return good

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one match of the pattern."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        text = piece.decode("latin-1")
        longest = [token for _, token in self.automaton.iter_long(text)]
        fits = self.fits
        for k, pair in enumerate(zip(longest, longest[1:])):
            if not (fits[pair] if pair in fits else self.compatible(*pair)):
                return self._backtrack(text, longest, k + 1)
        return longest

    def _backtrack(self, text: str, ids: list[int], sure: int) -> list[int]:
        """As encode_piece(), where the longest token after ``ids[:sure]`` does not fit."""
        length, shorter, fits, longest = self.length, self.shorter, self.fits, self.automaton.iter_long
        n = len(text)
        is_open = bytearray(b"\x01") * (n + 1)
        token = ids[sure]
        ids = ids[:sure]
        pos, last = sum(map(length.__getitem__, ids)), ids[-1]
        while True:
            while token >= 0:
                end = pos + length[token]
                if is_open[end]:
                    if last < 0:
                        break
                    good = fits.get((last, token))
                    if good or good is None and self.compatible(last, token):
                        break
                token = shorter[token]
            if token >= 0:
                ids.append(token)
                if end == n:
                    return ids
                pos, last = end, token
                token = next(longest(text, pos))[1]
            else:
                is_open[pos] = 0
                token = ids.pop()
                pos -= length[token]
                token = shorter[token]
                last = ids[-1] if ids else -1

    def __missing__(self, piece: str) -> bytes:
        packed = array("I", self.encode_piece(piece.encode())).tobytes()
        if len(piece) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """All ids of a text, packed."""
        if len(text) <= PART:
            simple = self.latin and (text.isascii() or not NOT_LATIN.search(text))
            return b"".join(map(self.__getitem__, (self.latin if simple else self.find).findall(text)))
        pieces = (m.group() for m in self.find.finditer(text))
        out = []
        while part := list(islice(pieces, 1 << 16)):
            out.append(b"".join(map(self.__getitem__, part)))
        return b"".join(out)

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(2)
def tokenizer(path: str, pattern: str) -> ByteBpe:
    """One tokenizer for each Python worker; workers outlive tasks."""
    return ByteBpe(path, pattern)


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids binary): packed little-endian uint32 ids of every whole text.

    A narrow transformation: no shuffle, memory bounded by one batch of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            ids = [bpe.encode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary())], names=["id", "ids"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(id, ids, bytes binary): the bytes that the ids stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        for b in batches:
            raw = [bpe.decode(x or b"") for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(raw, pa.binary())], names=["id", "ids", "bytes"])

    kind = encoded.schema["id"].dataType.simpleString()
    return encoded.select("id", "ids").mapInArrow(run, f"id {kind}, ids binary, bytes binary")


def round_trip_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``decode(encode(docs))``, and
    the packed ids if asked for.

    Both steps run in one pass over a batch, so the ids need not leave the worker.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path, pattern)
        sha = hashlib.sha256
        for b in batches:
            n, a, d, ids = [], [], [], []
            for t in b.column(1):
                packed = bpe.encode(t.as_py() or "")
                n.append(len(packed) // 4)
                ids.append(packed if with_ids else None)
                a.append(sha(packed).hexdigest())
                d.append(sha(bpe.decode(packed)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string()), pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = src.schema["doc_id"].dataType.simpleString()
    out = src.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, ids binary")
    return out if with_ids else out.drop("ids")
