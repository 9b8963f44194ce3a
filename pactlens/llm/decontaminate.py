"""Benchmark decontamination by template canonicalisation.

Texts are split at all white space, as Unicode has it, and line breaks end sentences.
They become templates: numbers turn into <num>, units after a number into <unit>, runs
of capitalised words inside a sentence into one <name>, other words are lower-cased and
stripped of outer punctuation. Every window of ``window`` template tokens is a key; a
document's windows are hash-joined to the benchmark's. Windows on one diagonal (document
position less item position) make an alignment; its slots must be consistent: one value
of the item always meets the same value in the document. A document is contaminated by
an item if consistent alignments cover ``coverage`` of the item's windows, so questions
whose numbers, names or units were changed are caught as well as verbatim ones.

A window needs ``literal`` words that are no placeholders, so tables of numbers or lists
of names match nothing. Items of fewer than ``window`` tokens are windows of their own
length, down to ``shortest``. An item without any such window (too short, or with too few
words) is looked for as a whole, at any length: a run of the document must equal its whole
template, with consistent slots; where the template has no word at all, with equal slots.
A whole item has two templates: the usual one, and one that keeps capitalised words as
words, so that a copy is found where no sentence starts as well.

Scale: documents' windows are first tested against a bitmap of the benchmark's hashes of
fixed size (2 MB, whatever the benchmark's size), inside the task that reads the text;
only survivors are shuffled to the hash join, whose frequent keys Spark splits (AQE skew
join). Slot values travel with survivors only.

Edges: null and empty texts, and items of punctuation alone, have no windows; repeated rows and repeated items are
reported each by their ids; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, mix, rolling, rolling_many, small_batches

WINDOW, LITERAL, SHORTEST, COVERAGE = 8, 5, 5, 0.5
BITS = 24

#: Units that may follow a number; fixed values.
UNITS = frozenset(
    "% percent ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "mm cm m km inch inches ft foot feet yard yards mile miles mg g kg gram grams kilogram kilograms ton tons lb lbs pound pounds ounce ounces oz "
    "ml l liter liters litre litres gallon gallons k c f degree degrees w kw watt watts v volt volts hz khz mhz ghz b kb mb gb tb byte bytes "
    "dollar dollars cent cents euro euros usd eur gbp mph kmh".split()
)
LITERAL_KIND, BREAK, NUMBER, UNIT, CAPITAL, EMPTY = range(6)
#: Kinds of keys: windows, whole items, whole items whose capitalised words are words.
WINDOWS, WHOLE, WHOLE_WORDS = range(3)
PLACEHOLDER = {NUMBER: 0x6E756D, UNIT: 0x756E6974, CAPITAL: 0x6E616D65}
NUMERIC = re.compile(r"[$€£]?[+-]?\d[\d.,:/]*(?:[a-zµ%°]{0,4})?", re.I)
#: Line breaks; any other white space only parts words.
LINE_END = re.compile("\r\n|[\n\r\x85\u2028\u2029]")
_EDGE = re.compile(r"^[^\w$€£%]+|[^\w%]+$")


class Tokens(dict):
    """raw token -> place in the arrays of: hash of the lower-cased word, kind, whether it
    ends a sentence. A bounded memo, emptied between two texts."""

    LIMIT = 400_000

    def __init__(self):
        super().__init__()
        self.hashes, self.kinds, self.ends = array("Q"), array("b"), array("b")

    def __missing__(self, raw: str) -> int:
        from xxhash import xxh3_64_intdigest

        # most tokens are letters, perhaps with one mark behind: no pattern is needed for these
        plain = raw if raw.isalpha() else raw[:-1] if raw[-1] in ",;.!?:" and raw[:-1].isalpha() else ""
        core = plain or _EDGE.sub("", raw)
        low = core.lower()
        if plain:
            kind = UNIT if low in UNITS else CAPITAL if core[0].isupper() else LITERAL_KIND
        elif raw == "\n":
            kind = BREAK
        elif not core:
            kind = EMPTY
        elif NUMERIC.fullmatch(core):
            kind = NUMBER
        elif low in UNITS:
            kind = UNIT
        elif core[0].isupper():
            kind = CAPITAL
        else:
            kind = LITERAL_KIND
        self[raw] = place = len(self.hashes)
        self.hashes.append(xxh3_64_intdigest(low.encode()))
        self.kinds.append(kind)
        self.ends.append(raw[-1] in ".!?:" if plain else kind == BREAK or raw.rstrip("\"')]»”’")[-1:] in ".!?:")
        return place

    def of(self, raw: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if len(self) > self.LIMIT:
            self.clear()
            del self.hashes[:], self.kinds[:], self.ends[:]
        at = np.fromiter(map(self.__getitem__, raw), np.int64, len(raw))
        return np.frombuffer(self.hashes, np.uint64)[at], np.frombuffer(self.kinds, np.int8)[at].astype(np.int64), np.frombuffer(self.ends, np.int8)[at] != 0


_tokens = Tokens()


def tokens_of(text: str) -> tuple[list[str], tuple[np.ndarray, np.ndarray, np.ndarray] | None]:
    """The raw tokens of a text and what is known of each."""
    raw = []
    for line in LINE_END.split(text):
        raw += line.split()
        raw.append("\n")
    raw.pop()
    return raw, _tokens.of(raw) if raw else None


def template(text: str, names: bool = True) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """(hash, kind, raw token) of each template token; without ``names`` capitalised
    words are words."""
    h, kind, kept = template_of(*tokens_of(text), names)
    return h, kind, [kept[i] for i in range(len(h))]


def template_of(raw: list[str], known: tuple[np.ndarray, np.ndarray, np.ndarray] | None, names: bool) -> tuple[np.ndarray, np.ndarray, Kept]:
    if known is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), Kept(raw, np.zeros(0, np.int64))
    h, kind, ends = known[0], known[1].copy(), known[2]
    starts = np.concatenate(([True], ends[:-1]))
    kind[(kind == CAPITAL) & (starts | (not names))] = LITERAL_KIND
    solid = np.flatnonzero(kind != BREAK)  # a line may end between a number and its unit
    after_number = np.zeros(len(kind), bool)
    after_number[solid[1:]] = kind[solid[:-1]] == NUMBER
    kind[(kind == UNIT) & ~after_number] = LITERAL_KIND
    again = np.concatenate(([False], (kind[1:] == CAPITAL) & (kind[:-1] == CAPITAL)))
    keep = np.flatnonzero(~again & (kind != BREAK) & (kind != EMPTY))
    h, kind = h[keep], kind[keep]
    for k, code in PLACEHOLDER.items():
        h[kind == k] = code
    return h, kind, Kept(raw, keep)


class Kept:
    """Some of a text's raw tokens; few of them are ever looked at."""

    def __init__(self, raw: list[str], keep: np.ndarray):
        self.raw, self.keep = raw, keep

    def __getitem__(self, i: int) -> str:
        return self.raw[self.keep[i]]


def windows(h: np.ndarray, kind: np.ndarray, lengths: list[int], literal: int, rolled: dict[int, np.ndarray] | None = None) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(length, starts, hashes) of the windows of each length that have enough words."""
    out = []
    words = np.concatenate(([0], np.cumsum(kind == LITERAL_KIND)))
    rolled = rolling_many(h, lengths) if rolled is None else rolled
    for n in lengths:
        if len(h) >= n:
            w = rolled[n] + np.uint64(n)
            good = np.flatnonzero(words[n:] - words[:-n] >= min(literal, n)) if literal else np.arange(len(w))
            out.append((n, good, mix(w[good])))
    return out


def _slots(kind: np.ndarray, raw: list[str], start: int, n: int) -> list[str]:
    return [f"{i - start}:{kind[i]}:{_EDGE.sub('', raw[i]).lower()}" for i in range(start, start + n) if kind[i] != LITERAL_KIND]


def _wholes(text: str) -> list[tuple[int, int, np.ndarray, np.ndarray, list[str]]]:
    """(form, length, hash, kind, raw token) of both templates of a whole item."""
    both = [(form, *template(text, form == WHOLE)) for form in (WHOLE, WHOLE_WORDS)]
    return [(form, len(h), h, kind, raw) for form, h, kind, raw in both if len(h)]


ROW = pa.schema([("id", pa.int64()), ("k", pa.int64()), ("form", pa.int32()), ("length", pa.int32()), ("total", pa.int32()), ("pos", pa.int32()), ("w", pa.int64()), ("strict", pa.bool_()), ("slots", pa.list_(pa.string()))])


def _rows(src: DataFrame, window: int, literal: int, shortest: int, lengths: dict[int, list[int]] | None, bitmap: np.ndarray | None) -> DataFrame:
    """The windows of texts: of items (``lengths`` None) those of their own length, of
    documents all lengths asked for of each form, if the bitmap has them. ``strict``: an
    item's window without words."""

    def of_item(text: str) -> Iterator[tuple]:
        h, kind, raw = template(text)
        found = windows(h, kind, [min(window, len(h))] if len(h) >= shortest else [], literal)
        if any(len(starts) for _, starts, _ in found):
            yield from ((WINDOWS, n, starts, w, kind, raw) for n, starts, w in found)
            return
        for form, n, h, kind, raw in _wholes(text):
            yield form, n, np.zeros(1, np.int64), mix(rolling(h, n) + np.uint64(n)), kind, raw

    def of_document(text: str) -> Iterator[tuple]:
        known, made = tokens_of(text), {}
        for form, own in lengths.items():
            names = form != WHOLE_WORDS
            if names not in made:
                t = template_of(*known, names)
                made[names] = t, rolling_many(t[0], sorted({n for f, ns in lengths.items() if (f != WHOLE_WORDS) == names for n in ns}))
            (h, kind, raw), rolled = made[names]
            yield from ((form, n, starts, w, kind, raw) for n, starts, w in windows(h, kind, own, literal if form == WINDOWS else 0, rolled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [[] for _ in ROW]
            for key, k, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = text.as_py() or ""
                for form, n, starts, w, kind, raw in of_item(text) if lengths is None else of_document(text):
                    total = len(starts)
                    if bitmap is not None:
                        bit = w >> np.uint64(64 - BITS)
                        hit = bitmap[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1 == 1
                        starts, w = starts[hit], w[hit]
                    met = set()
                    for at, x in zip(starts.tolist(), w.view(np.int64).tolist()):
                        slots = _slots(kind, raw, at, n)
                        if form != WINDOWS:  # a whole item's copies with equal slots count once
                            if (x, *slots) in met:
                                continue
                            met.add((x, *slots))
                        for col, v in zip(cols, (key, k, form, n, total, at, x, LITERAL_KIND not in kind[at : at + n], slots)):
                            col.append(v)
                if len(cols[0]) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ROW)], schema=ROW)
                    cols = [[] for _ in ROW]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, ROW)], schema=ROW)

    return src.mapInArrow(run, "id long, k long, form int, length int, total int, pos int, w long, strict boolean, slots array<string>")


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, literal: int = LITERAL, shortest: int = SHORTEST, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, k, item_id, coverage, verbatim): the items found in each document; ``k``
    is the hash of id and text that tells rows apart, ``verbatim`` whether all slots of
    the covered windows have the item's own values."""
    key = lambda i, t: F.xxhash64(F.coalesce(F.col(i).cast("string"), F.lit("null")), F.col(t))
    items = benchmark.select(F.col(item_col).cast("long").alias("id"), F.lit(0).cast("long").alias("k"), F.col(item_text_col).cast("string").alias("text"))
    items = _rows(items, window, literal, shortest, None, None)
    # 2^19 words of 32 bits at most, whatever the benchmark's size
    bits = items.select(F.shiftrightunsigned("w", 64 - BITS).alias("bit"))
    held = bits.groupBy(F.expr("shiftright(bit, 5)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 31 AS INT)))").alias("bits")).collect()
    bitmap = np.zeros(1 << (BITS - 5), np.uint32)
    for r in held:
        bitmap[r.word] = r.bits
    bitmap = bitmap.astype("<u4").view(np.uint8)
    lengths: dict[int, list[int]] = {}
    for form, n in sorted(map(tuple, items.select("form", "length").distinct().collect())):
        lengths.setdefault(form, []).append(n)
    small_batches(docs.sparkSession)
    src = docs.select(F.col(id_col).cast("long").alias("id"), key(id_col, text_col).alias("k"), F.col(text_col).cast("string").alias("text"))
    ours = _rows(src, window, literal, shortest, lengths, bitmap)
    theirs = items.select("w", "form", "length", F.col("id").alias("item_id"), "total", "strict", F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"))
    met = ours.drop("total", "strict").join(theirs, ["w", "form", "length"])
    pair = F.zip_with("item_slots", "slots", lambda a, b: F.struct(F.regexp_replace(a, "^[0-9]+:", "").alias("item"), F.regexp_replace(b, "^[0-9]+:", "").alias("ours")))
    aligned = met.withColumn("pairs", pair).groupBy("id", "k", "item_id", "form", "strict", "total", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.collect_set("item_pos").alias("places"), F.array_distinct(F.flatten(F.collect_set("pairs"))).alias("pairs"))
    consistent = F.size("pairs") == F.size(F.array_distinct(F.transform("pairs", lambda p: p["item"])))
    equal = F.forall("pairs", lambda p: p["item"] == p["ours"])
    good = aligned.where(consistent & (equal | (F.col("form") == WINDOWS) | ~F.col("strict"))).groupBy("id", "k", "item_id", "total").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.min(equal).alias("verbatim"))
    share = F.size("places") / F.col("total")
    return good.withColumn("coverage", share).where(F.col("coverage") >= coverage).select(F.col("id").alias("doc_id"), "k", "item_id", "coverage", "verbatim")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    key = fresh(docs, "k")
    bad = contaminated(docs, benchmark, id_col=id_col, text_col=text_col, **options).select(F.col("k").alias(key)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(text_col)))
    return keyed.join(bad, key, "left_anti").drop(key)
