"""Column expressions for text, and the sequence-matching ratio as an Arrow UDF."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Listed, matched_all


#: What (?U)\s matches in Java: the white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not blanks alone. A text that neither starts nor ends
    with any is not looked through."""
    return F.btrim(text, F.lit(WHITE))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, though lambda functions in it use it often."""
    return F.get(F.transform(F.array(value), body), 0)


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(r"(?U)\S")


def norm_text(text: Column) -> Column:
    """Form in which quotes are compared: lower case, one blank for white space, a
    backtick as a double quote, dashes as hyphens."""
    x = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))  # what is left at the ends is one blank
    text = F.col(text) if isinstance(text, str) else text
    odd = F.contains(text, F.lit("`")) | F.contains(text, F.lit("–")) | F.contains(text, F.lit("—"))
    return F.when(odd, F.translate(x, "`–—", '"--')).otherwise(x)  # most texts have none, and it is slow


def audit_norm(text: Column) -> Column:
    """Form in which annotations are audited: as norm_text, punctuation unchanged."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def truncate(text: Column, length: int = 100) -> Column:
    """At most ``length`` characters, the last three dots if some are cut."""
    return F.when(F.char_length(text) > length, F.concat(F.left(text, F.lit(length - 3)), F.lit("..."))).otherwise(text)


def location_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.format_string("Page %d", start)).otherwise(F.format_string("Pages %d-%d", start, end))


def ratio(a: str, b: str, autojunk: bool = True) -> float:
    """Share of matching characters; not symmetric, and lower for long ``b`` with autojunk."""
    return SequenceMatcher(None, a, b, autojunk).ratio()


def similarity(a: str | None, b: str | None) -> float:
    """Ratio of the stripped lower-case texts; 0 if one is missing."""
    if not a or not b:
        return 0.0
    a, b = a.lower().strip(), b.lower().strip()
    return 1.0 if a == b else ratio(a, b)


def similarity_bound(a: str | None, b: str | None) -> float:
    """At least their similarity: by the characters in common, order left out."""
    if not a or not b:
        return 0.0
    a, b = a.lower().strip(), b.lower().strip()
    return 2.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)) if a or b else 1.0


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


@lru_cache(1024)
def _places(needle: str, symbols: bytes) -> np.ndarray:
    """(words, symbols): the needle's places of each of the code points, 64 to a word."""
    known = {c: k for k, c in enumerate(np.frombuffer(symbols, np.uint32).tolist())}
    rows = [[0] * len(known) for _ in range(-(-len(needle) // 64))]
    for i, c in enumerate(needle):
        k = known.get(ord(c))
        if k is not None:
            rows[i // 64][k] |= 1 << i % 64
    return np.array(rows, np.uint64).reshape(len(rows), len(known))


ASCII = np.arange(128, dtype=np.uint32)


class Haystack:
    """A text in which several needles are sought; what they share is made once."""

    def __init__(self, text: str):
        self.text = text
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.symbols, self.of = (ASCII, self.codes) if text.isascii() else np.unique(self.codes, return_inverse=True)
        self.found: dict[tuple, tuple[float, int, int]] = {}

    def masks(self, needle: str) -> np.ndarray:
        """(words, characters): the needle's places of each character, 64 to a word."""
        return _places(needle, self.symbols.tobytes())[:, self.of]


def common_subsequences(masks: np.ndarray, n: int | np.ndarray, starts: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of a needle of ``n`` characters and each
    window; no ratio matches more. ``masks`` has the needle's places of each character,
    ``widths`` must not ascend. All windows advance together, a character at a time, each
    with one bit for each place of the needle. Windows may have needles of their own, with
    an ``n`` each, where all of these fill the words of ``masks``."""
    words = len(masks)
    open_ = np.full((words, len(starts)), ~np.uint64(0))
    open_[-1] >>= np.asarray(64 * words - n, np.uint64)
    full = open_.copy() if np.ndim(n) else open_[:, :1].copy()
    active = len(starts)
    ends = np.searchsorted(-widths, -np.arange(int(widths[0])), "left")  # windows wider than each place
    for j in range(int(widths[0])):
        active = int(ends[j])
        p = masks[:, starts[:active] + j]
        carry = None
        for k in range(words):
            o = open_[k, :active]
            hit = o & p[k]
            total = o + hit
            over = total < o
            if carry is not None:
                total += carry
                over |= total < carry
            open_[k, :active] = (total | (o ^ hit)) & full[k, :active]
            if words > 1:
                carry = over.astype(np.uint64)
    return n - np.bitwise_count(open_).sum(axis=0, dtype=np.int64)


def _runs(needle: str, text: str | np.ndarray) -> np.ndarray:
    """Length of the run of equal characters that ends at each (needle, text) place;
    ``text`` may be its code points."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) if isinstance(text, str) else text
    own = np.frombuffer(needle.encode("utf-32-le", "surrogatepass"), np.uint32)
    n, m = len(own), len(codes)
    # row i stands i places to the left of the row before it, so that diagonals are columns
    wide = m + 2 * n
    flat = np.zeros((n, wide), np.bool_)
    flat[:, n - 1 : n - 1 + m] = own[:, None] == codes
    skewed = np.lib.stride_tricks.as_strided(flat, (n, m + n - 1), (wide + 1, 1))
    row = np.arange(1, n + 1, dtype=np.int32)[:, None]
    out = np.zeros((n, wide), np.int32)
    runs = np.lib.stride_tricks.as_strided(out, (n, m + n - 1), (4 * (wide + 1), 4))
    np.subtract(row, np.maximum.accumulate(np.where(skewed, np.int32(0), row), axis=0), out=runs)
    return out[:, n - 1 : n - 1 + m]


def _edges(rows: int, columns: int) -> np.ndarray:
    """Longest run that fits between the upper left corner and each place."""
    return np.minimum.outer(np.arange(1, rows + 1, dtype=np.int32), np.arange(1, columns + 1, dtype=np.int32))


def matched(runs: np.ndarray, edges: np.ndarray, least: int) -> int:
    """Characters in matching blocks: the longest block first, the earliest of equals,
    then what lies before and after it; -1 as soon as fewer than ``least`` can match."""
    got, todo = 0, [(0, runs.shape[0], 0, runs.shape[1])]
    hope = min(runs.shape)
    while todo and got + hope >= least:
        top, bottom, left, right = todo.pop()
        hope -= min(bottom - top, right - left)
        block = np.minimum(runs[top:bottom, left:right], edges[: bottom - top, : right - left])
        i, j = divmod(int(block.argmax()), right - left)
        size = int(block[i, j])
        if size:
            got += size
            i, j = i + top + 1, j + left + 1
            for part in ((top, i - size, left, j - size), (i, bottom, j, right)):
                if part[0] < part[1] and part[2] < part[3]:
                    todo.append(part)
                    hope += min(part[1] - part[0], part[3] - part[2])
    return got if got >= least and not todo else -1


#: Texts of so many characters and more have their frequent characters left out when
#: blocks are sought, as the ratio is defined; a fixed value.
JUNK_FROM = 200
#: Cells of a run table at most; longer texts are left to the library.
TABLE = 4_000_000
#: Cells of a run table of a whole text, of which each window takes a part; above, each
#: window that is compared has its own.
SHARED_TABLE = 250_000


def ratio_bound(a: str, b: str) -> float:
    """At least the ratio: by the longest common subsequence, all places of ``a`` at once."""
    if not a or not b:
        return float(not a and not b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    rest = whole = (1 << len(a)) - 1
    for c in b:
        hit = rest & places.get(c, 0)
        rest = (rest + hit | rest - hit) & whole
    return 2.0 * (len(a) - rest.bit_count()) / (len(a) + len(b))


def ratio_from(a: str, b: str, least: float) -> float:
    """The ratio; a negative number where it is below ``least``, seen as soon as it can be."""
    if not a or not b or len(b) >= JUNK_FROM or len(a) * len(b) > TABLE:
        return ratio(a, b)
    n = len(a) + len(b)
    return 2.0 * matched(_runs(a, b), _edges(len(a), len(b)), math.ceil(least * n / 2 - 1e-6)) / n


#: Pairs compared together, and entries of their tables of places.
PAIRS, ENTRIES = 2048, 2_000_000


def _pair_masks(pairs: list[tuple[str, str]], words: int) -> list[np.ndarray]:
    """For each character of the second texts, one after another, its places in the first
    text of its pair, 64 to a word."""
    firsts = {a: k for k, a in enumerate(dict.fromkeys(a for a, _ in pairs))}
    codes = np.frombuffer("".join([*firsts, *(b for _, b in pairs)]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    symbols = 128
    if codes.max(initial=0) >= symbols:
        found, codes = np.unique(codes, return_inverse=True)
        symbols = len(found)
    long = np.array([len(a) for a in firsts])
    own, rest = codes[: long.sum()], codes[long.sum() :]
    place = np.arange(len(own)) - np.repeat(np.cumsum(long) - long, long)
    key = np.repeat(np.arange(len(long)) * symbols, long) + own
    asked = np.repeat([firsts[a] * symbols for a, _ in pairs], [len(b) for _, b in pairs]) + rest
    out = []
    for w in range(words):
        here = place >> 6 == w
        table = np.zeros(len(long) * symbols, np.uint64)
        np.bitwise_or.at(table, key[here], np.uint64(1) << (place[here] & 63).astype(np.uint64))
        out.append(table[asked])
    return out


def ratios(pairs: list[tuple[str, str]]) -> list[float]:
    """ratio() of each pair, compared together where the first is of at most JUNK_FROM
    characters and the second of less."""
    out: list[float] = [0.0] * len(pairs)
    short: dict[tuple[int, bool], list[int]] = {}
    for k, (a, b) in enumerate(pairs):
        if a and 0 < len(b) < JUNK_FROM and len(a) <= JUNK_FROM:
            short.setdefault((-(-len(a) // 64), a.isascii() and b.isascii()), []).append(k)
        else:
            out[k] = ratio(a, b)
    for (words, plain), members in short.items():
        many = PAIRS if plain else math.isqrt(ENTRIES // JUNK_FROM)  # other texts may have as many symbols as characters
        for part in (members[k : k + many] for k in range(0, len(members), many)):
            own = [pairs[k] for k in part]
            n, width = (np.array([len(p[i]) for p in own]) for i in (0, 1))
            got = matched_all(_pair_masks(own, words), n, np.cumsum(width) - width, width, np.zeros(len(own), np.int64))
            for k, x in zip(part, (2.0 * got / (n + width)).tolist()):
                out[k] = x
    return out


#: Pairs whose ratio is kept, in each of two generations.
KNOWN = 65_536


class Ratios:
    """Ratios of pairs of texts, with those of the latest pairs kept: texts recur in
    agreements. What is asked for again goes from the old generation to the new one."""

    def __init__(self):
        self.new: dict[tuple[str, str], float] = {}
        self.old: dict[tuple[str, str], float] = {}

    def get(self, pair: tuple[str, str]) -> float | None:
        x = self.new.get(pair)
        if x is None and (x := self.old.get(pair)) is not None:
            self._keep(pair, x)
        return x

    def _keep(self, pair: tuple[str, str], x: float) -> None:
        if len(self.new) >= KNOWN:
            self.old, self.new = self.new, {}
        self.new[pair] = x

    def learn(self, pairs: list[tuple[str, str]]) -> dict[tuple[str, str], float]:
        """The ratios of all pairs; those not known are worked out together."""
        out = {p: self.get(p) for p in dict.fromkeys(pairs)}
        missing = [p for p, x in out.items() if x is None]
        for p, x in zip(missing, ratios(missing)):
            out[p] = x
            if len(p[0]) + len(p[1]) <= 2 * JUNK_FROM:
                self._keep(p, x)
        return out


@lru_cache(4096)
def _windows(n: int, length: int, sizes: tuple[float, ...], clamp: bool) -> tuple[np.ndarray, np.ndarray]:
    """(start, width) of the windows of a text of ``length`` characters, size by size."""
    widths = [w for w in (min(int(n * r), length) if clamp else int(n * r) for r in sizes) if 1 <= w <= length]
    if not widths:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = [np.arange(0, length - w + 1, max(1, w // 4)) for w in widths]
    return np.concatenate(starts), np.repeat(widths, [len(s) for s in starts])


#: Windows whose subsequences advance together, where they are of several needles.
TOGETHER = 65_536


class _Part(NamedTuple):
    """Windows that advance together: of the pairs ``members``, a run of windows each."""

    members: list[int]
    masks: np.ndarray
    first: np.ndarray
    of: np.ndarray
    n: np.ndarray
    at: np.ndarray
    width: np.ndarray
    bounds: np.ndarray


def _parts(pairs: list[tuple[str, Haystack]], windows: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[_Part]:
    """The windows of many pairs, with at least the ratio of each, by the words of their needles."""
    order = sorted((k for k in range(len(pairs)) if len(windows[k][0])), key=lambda k: -(-len(pairs[k][0]) // 64))
    order.reverse()
    while order:
        words, part, many = -(-len(pairs[order[-1]][0]) // 64), [], 0
        while order and -(-len(pairs[order[-1]][0]) // 64) == words and (not part or many + len(windows[order[-1]][0]) <= TOGETHER):
            part.append(order.pop())
            many += len(windows[part[-1]][0])
        counts = [len(windows[k][0]) for k in part]
        first = np.cumsum([0, *(len(pairs[k][1].text) for k in part)])[:-1]
        starts = np.concatenate([windows[k][0] for k in part]) + np.repeat(first, counts)
        widths = np.concatenate([windows[k][1] for k in part])
        n = np.repeat([len(pairs[k][0]) for k in part], counts)
        masks = np.concatenate([pairs[k][1].masks(pairs[k][0]) for k in part], axis=1)
        wide = np.argsort(-widths, kind="stable")
        most = np.empty(len(wide), np.int64)
        most[wide] = common_subsequences(masks, n[wide], starts[wide], widths[wide])
        yield _Part(part, masks, first, np.repeat(np.arange(len(part)), counts), n, starts, widths, 2.0 * most / (n + widths))


def window_bounds(pairs: list[tuple[str, Haystack]], sizes: tuple[float, ...], clamp: bool) -> list[np.ndarray]:
    """For each (needle, text), at least the ratio of each of its windows. Windows of many
    pairs advance together: a text of a page has too few for a step of its own."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pairs)
    for p in _parts(pairs, [_windows(len(needle), len(hay.text), sizes, clamp) for needle, hay in pairs]):
        for k, found in zip(p.members, np.split(p.bounds, np.flatnonzero(np.diff(p.of)) + 1)):
            out[k] = found
    return out


#: Windows of a pair whose ratios are taken first; twice as many each time after that.
FIRST = 4


def _best_of(p: _Part, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(score, window) of each pair of a part, -1 where it has none; none is looked at where
    all bounds are below ``least``."""
    best, where = np.zeros(len(p.members)), np.full(len(p.members), -1)
    masks = list(p.masks)
    listed = Listed(masks, p.first)
    rest = np.lexsort((-p.bounds, p.of))
    top = p.bounds[rest[np.searchsorted(p.of, np.arange(len(p.members)))]]
    rest = rest[(top >= least)[p.of[rest]]]
    take = FIRST
    while len(rest):
        of, bound = p.of[rest], p.bounds[rest]
        keep = (bound > best[of]) | (bound == best[of]) & (rest < where[of])
        rest, of = rest[keep], of[keep]
        rank = np.arange(len(rest)) - np.searchsorted(of, of)
        now, of, rest = rest[rank < take], of[rank < take], rest[rank >= take]
        total = p.n[now] + p.width[now]
        score = 2.0 * matched_all(masks, p.n[now], p.at[now], p.width[now], np.ceil(best[of] * total / 2 - 1e-6).astype(np.int64), listed) / total
        first = np.lexsort((now, -score, of))
        first = first[np.concatenate(([True], np.diff(of[first]) > 0))[: len(first)]]
        of, score, now = of[first], score[first], now[first]
        better = (score > best[of]) | (score == best[of]) & (score > 0) & (now < where[of])
        best[of[better]], where[of[better]] = score[better], now[better]
        take *= 2
    return best, where


def best_windows(pairs: list[tuple[str, Haystack]], sizes: tuple[float, ...], clamp: bool, least: float = 0.0) -> list[tuple[float, int, int]]:
    """best_window() of each (needle, text), their windows compared together; (0, -1, 0)
    where all bounds are below ``least``. Pairs with windows of JUNK_FROM characters and
    more are left to best_window()."""
    out = [(0.0, -1, 0)] * len(pairs)
    windows = [_windows(len(needle), len(hay.text), sizes, clamp) for needle, hay in pairs]
    long = [k for k, (_, width) in enumerate(windows) if width.max(initial=0) >= JUNK_FROM]
    for k, bounds in zip(long, window_bounds([pairs[k] for k in long], sizes, clamp)):
        if bounds.max() >= least:
            out[k] = best_window(*pairs[k], sizes, clamp, bounds)
    same: dict[tuple[str, int], list[int]] = {}
    for k in sorted(set(range(len(pairs))) - set(long)):
        same.setdefault((pairs[k][0], id(pairs[k][1])), []).append(k)
    members = list(same.values())
    for p in _parts([pairs[ks[0]] for ks in members], [windows[ks[0]] for ks in members]):
        best, where = _best_of(p, least)
        for m, score, at in zip(p.members, best.tolist(), where.tolist()):
            if at >= 0:
                start, width = windows[members[m][0]]
                k = at - int(np.searchsorted(p.of, p.of[at]))
                for pair in members[m]:
                    out[pair] = score, int(start[k]), int(width[k])
    return out


def best_window(needle: str, text: str | Haystack, sizes: tuple[float, ...], clamp: bool, bounds: np.ndarray | None = None) -> tuple[float, int, int]:
    """(score, start, length) of the window of ``text`` most like ``needle``.

    Windows of each relative size step by a quarter; the first best stays. The ratio is
    taken of the windows by their longest common subsequence, the longest first, until
    none that is left could exceed the best. ``bounds`` may give window_bounds() of the two.
    """
    hay = text if isinstance(text, Haystack) else Haystack(text)
    key = needle, sizes, clamp
    if key not in hay.found:
        hay.found[key] = _search(needle, hay, sizes, clamp, bounds)[:3]
    return hay.found[key]


def _search(needle: str, hay: Haystack, sizes: tuple[float, ...], clamp: bool, bounds: np.ndarray | None = None) -> tuple[float, int, int, int, int]:
    """The best window, how many windows there are, and of how many the ratio was taken."""
    n, text = len(needle), hay.text
    at, width = _windows(n, len(text), sizes, clamp)
    if not len(at):
        return 0.0, -1, 0, 0, 0
    widths = np.unique(width).tolist()
    bounds = window_bounds([(needle, hay)], sizes, clamp)[0] if bounds is None else bounds
    best, where, taken = 0.0, -1, 0
    edges = _edges(n, max((w for w in widths if w < JUNK_FROM), default=0))
    whole = _runs(needle, hay.codes) if n * len(text) <= SHARED_TABLE and min(widths) < JUNK_FROM else None
    matcher = SequenceMatcher(None, "", "")
    matcher.set_seq1(needle)
    for k in np.argsort(-bounds, kind="stable").tolist():
        bound, low, w = bounds[k], int(at[k]), int(width[k])
        if bound < best or bound == 0:
            break
        if bound == best and k > where:
            continue
        taken += 1
        if w < JUNK_FROM:
            least = math.ceil(best * (n + w) / 2 - 1e-6)
            runs = _runs(needle, hay.codes[low : low + w]) if whole is None else whole[:, low : low + w]
            score = 2.0 * matched(runs, edges, least) / (n + w)
        else:
            matcher.set_seq2(text[low : low + w])
            score = matcher.ratio()
        if score > best or score == best > 0 and k < where:
            best, where = score, k
    return (best, int(at[where]), int(width[where]), len(at), taken) if where >= 0 else (0.0, -1, 0, len(at), taken)
