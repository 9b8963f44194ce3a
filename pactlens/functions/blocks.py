"""Matching blocks of many pairs of texts at once.

The ratio of two texts counts the characters of the longest run that both hold, then those
of the runs before and after it, and so on. A needle's places are bits here: a column has
those where its character stands in the needle, so a step to the left and an `and` leave
the ends of the runs that are one longer. All pairs, and all parts that their blocks leave,
take these steps together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

ALL, ONE = ~np.uint64(0), np.uint64(1)


def _lowest(n: np.ndarray) -> np.ndarray:
    """Words with the lowest ``n`` bits set: none below 1, all from 64 on."""
    n = np.clip(n, 0, 64)
    return np.where(n == 64, ALL, (ONE << (n & 63).astype(np.uint64)) - ONE)


def _step(left: list[np.ndarray], here: list[np.ndarray]) -> list[np.ndarray]:
    """Ends of the runs in ``here`` that are one longer than those in the columns ``left`` of it."""
    out = [h & (x << ONE) for x, h in zip(left, here)]
    for k in range(1, len(out)):
        out[k] |= here[k] & (left[k - 1] >> np.uint64(63))
    return out


def _any(words: list[np.ndarray]) -> np.ndarray:
    out = words[0]
    for w in words[1:]:
        out = out | w
    return out


def _earliest(own: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part, row, place) of the lowest row, and the first place that has it, among the
    places of each part; ``own`` has their parts, in order."""
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    many = np.diff(first, append=len(own))
    ends = [np.bitwise_or.reduceat(x, first) for x in values]
    word = np.argmax(np.array(ends) != 0, axis=0) if len(ends) > 1 else np.zeros(len(first), np.int64)
    bit = np.choose(word, ends) if len(ends) > 1 else ends[0]
    bit = bit & (~bit + ONE)
    of = np.array(values)[np.repeat(word, many), np.arange(len(own))] if len(ends) > 1 else values[0]
    hit = np.flatnonzero(of & np.repeat(bit, many))
    return own[first], 64 * word + np.bitwise_count(bit - ONE), hit[np.searchsorted(hit, first)]


def _longest(masks: list[np.ndarray], top: np.ndarray, bottom: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(length, row, column) of each part's longest run and where it ends, the earliest of
    equals; a length of 0 where nothing is equal. Runs of two and more are few, so they are
    listed; ``found`` has those of each length."""
    size, row, column = (np.zeros(len(top), np.int64) for _ in range(3))
    lens = right - left
    starts = np.cumsum(lens) - lens
    part = np.repeat(np.arange(len(top)), lens)
    columns = np.arange(len(part)) + np.repeat(left - starts, lens)
    runs = [m[columns] & np.repeat(_lowest(bottom - 64 * k) & ~_lowest(top - 64 * k), lens) for k, m in enumerate(masks)]
    found = []
    for at, values in _levels(runs, starts):
        own = part[at]
        size[own] = len(found) + 2
        found.append((own, at, values))
    at = np.flatnonzero(_any(runs) * (size == 0)[part])
    size[part[at]] = 1
    found.insert(0, (part[at], at, [x[at] for x in runs]))
    last = [np.flatnonzero(size[own] == k) for k, (own, _, _) in enumerate(found, 1)]
    own, at = (np.concatenate([f[i][k] for f, k in zip(found, last)]) for i in (0, 1))
    if len(own):
        order = np.argsort(own, kind="stable")
        values = [np.concatenate([f[2][w][k] for f, k in zip(found, last)])[order] for w in range(len(masks))]
        of, rows, places = _earliest(own[order], values)
        row[of], column[of] = rows, columns[at[order[places]]]
    return size, row, column


def _levels(runs: list[np.ndarray], starts: np.ndarray) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Of the runs of two, of three and so on: the places where some end, and their rows."""
    longer = [np.concatenate((np.zeros(1, np.uint64), x)) for x in _step([x[:-1] for x in runs], [x[1:] for x in runs])]
    for x in longer:
        x[starts] = 0
    at = np.flatnonzero(_any(longer))
    values = [x[at] for x in longer]
    while len(at):
        yield at, values
        # a part's first column ends no run of two, so columns side by side are of one part
        near = np.flatnonzero(at[1:] - at[:-1] == 1)
        values = _step([x[near] for x in values], [x[near + 1] for x in values])
        some = np.flatnonzero(_any(values))
        at, values = at[near[some] + 1], [x[some] for x in values]


#: Parts from which on it pays to bound what they can match; a fixed value.
BOUNDED = 64
#: Runs that are listed of whole texts, as a multiple of their columns; a fixed value.
LISTED = 8


class Listed:
    """The runs of whole texts, of which each of their windows takes its own."""

    def __init__(self, masks: list[np.ndarray], starts: np.ndarray):
        self.levels, many = [], 0
        for level in _levels(masks, starts):
            many += len(level[0])
            if many > LISTED * len(masks[0]):
                break  # what is longer is sought part by part
            self.levels.append(level)
        self.whole = many <= LISTED * len(masks[0])

    def longest(self, masks: list[np.ndarray], n: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """_longest() of windows with their whole needles of ``n`` characters."""
        if not self.whole:
            return _longest(masks, np.zeros(len(n), np.int64), n, left, right)
        size, row, column = (np.zeros(len(n), np.int64) for _ in range(3))
        open_, first, last = np.arange(len(n)), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
        for length, (at, _) in enumerate(self.levels, 2):
            a, b = np.searchsorted(at, left[open_] + (length - 1)), np.searchsorted(at, right[open_])
            some = np.flatnonzero(a < b)
            if not len(some):
                break
            open_ = open_[some]
            size[open_], first[open_], last[open_] = length, a[some], b[some]
        for length, (at, values) in enumerate(self.levels, 2):
            of = np.flatnonzero(size == length)
            if len(of):
                many = last[of] - first[of]
                places = np.arange(int(many.sum())) + np.repeat(first[of] - np.cumsum(many) + many, many)
                own, rows, hit = _earliest(np.repeat(of, many), [x[places] for x in values])
                row[own], column[own] = rows, at[places[hit]]
        few = np.flatnonzero(size == 0)
        if len(few):
            size[few], row[few], column[few] = _longest(masks, np.zeros(len(few), np.int64), n[few], left[few], right[few])
        return size, row, column


def _common(masks: list[np.ndarray], top: np.ndarray, bottom: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of each part's longest common subsequence: no blocks hold more. All parts
    advance a column at a time; a row is closed when it is used."""
    order = np.argsort(left - right, kind="stable")
    width, left = (right - left)[order], left[order]
    rows = [(_lowest(bottom - 64 * k) & ~_lowest(top - 64 * k))[order] for k in range(len(masks))]
    open_ = [np.full(len(order), ALL) for _ in masks]
    ends = np.searchsorted(-width, -np.arange(int(width.max(initial=0))), "left")  # parts wider than each place
    for j, some in enumerate(ends.tolist()):
        at, carry = left[:some] + j, None
        for k, m in enumerate(masks):
            o = open_[k][:some]
            hit = m[at]
            hit &= rows[k][:some]
            hit &= o
            total = o + hit
            if len(masks) > 1:
                over = total < o
                if carry is not None:
                    total += carry
                    over |= total < carry
                carry = over.astype(np.uint64)
            o ^= hit
            o |= total
    out = np.empty(len(order), np.int64)
    out[order] = 64 * len(masks) - sum(np.bitwise_count(o).astype(np.int64) for o in open_)
    return out


def matched_all(masks: list[np.ndarray], n: np.ndarray, at: np.ndarray, width: np.ndarray, least: np.ndarray, listed: Listed | None = None) -> np.ndarray:
    """Characters in the matching blocks of each needle of ``n`` characters and ``width``
    columns of ``masks`` from ``at`` on; -1 where fewer than ``least`` match. ``masks`` has,
    for 64 places a word, those that a column's character has in its needle. ``listed`` may
    give the runs of the texts. What parts can still match is bounded before each step."""
    got = np.zeros(len(at), np.int64)
    pair, top, bottom, left, right = np.arange(len(at)), np.zeros(len(at), np.int64), n, at, at + width
    few, bounded = np.minimum(n, width), bool((least > 0).any())
    while True:
        keep = (few > 0) & (got + np.bincount(pair, few, minlength=len(at)) >= least)[pair]
        if not keep.any():
            break
        pair, top, bottom, left, right = (x[keep] for x in (pair, top, bottom, left, right))
        if listed is None:
            size, row, column = _longest(masks, top, bottom, left, right)
        else:
            size, row, column = listed.longest(masks, bottom, left, right)
            listed = None
        got += np.bincount(pair, size, minlength=len(at)).astype(np.int64)
        some = size > 0
        pair, top, bottom, left, right, size, row, column = (x[some] for x in (pair, top, bottom, left, right, size, row, column))
        pair, top, bottom, left, right = (np.concatenate(x) for x in ((pair, pair), (top, row + 1), (row + 1 - size, bottom), (left, column + 1), (column + 1 - size, right)))
        few = np.minimum(bottom - top, right - left)
        open_ = (few > 0) & (got + np.bincount(pair, few, minlength=len(at)) >= least)[pair]
        pair, top, bottom, left, right = (x[open_] for x in (pair, top, bottom, left, right))
        few = _common(masks, top, bottom, left, right) if bounded and len(pair) >= BOUNDED else few[open_]
    return np.where(got >= least, got, -1)
