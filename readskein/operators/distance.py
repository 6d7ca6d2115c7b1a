"""Distances between two base strings, and the registry that clustering takes them from.

A distance gets two strings, the strand is settled before by complementing the second. Each comes as a function of
numpy arrays; ``scored_pairs`` runs it on groups of pairs that the filters have left over.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ClusterConfig, EditCosts
from ..session import Durable
from .beside import Group, beside


_CODE = np.full(256, 255, np.uint8)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i

_COMPLEMENT = np.append(3 - np.arange(4), np.full(252, 255)).astype(np.uint8)

#: Cells of the equality matrix held at once; longer reads are done in blocks of rows.
CELLS = 4_000_000


def codes(bases: str) -> np.ndarray:
    return _CODE[np.frombuffer(bases.encode("ascii", "replace"), np.uint8)]


def _words(x: np.ndarray, k: int) -> np.ndarray:
    n = len(x) - k + 1
    out = np.zeros(max(0, n), np.int64)
    for i in range(k if n > 0 else 0):
        out = out * 256 + x[i : i + n] if k <= 7 else out * 5 + np.minimum(x[i : i + n], 4)
    return out


_SPACE: dict[str, np.ndarray] = {}


def _space(name: str, size: int, kind) -> np.ndarray:
    """Memory that is used again, as fresh one of this size would be asked for page by page each time."""
    need = size * np.dtype(kind).itemsize
    if name not in _SPACE or len(_SPACE[name]) < need:
        _SPACE[name] = np.empty(need + need // 2, np.uint8)
    return _SPACE[name][:need].view(kind)


def _places(flags: np.ndarray) -> np.ndarray:
    """``flatnonzero`` of flags of which few are set; their number is a multiple of 8."""
    octets = np.flatnonzero(flags.view(np.uint64))
    k, inside = np.nonzero(flags.reshape(-1, 8)[octets])
    return octets[k] * 8 + inside


def _squares(w: np.ndarray, n: int) -> np.ndarray:
    """Sum of squared word counts of each window of n words: n and twice the pairs of equal words in it."""
    change, size = np.zeros(len(w) + 1, np.int64), len(w)
    beyond = np.append(w, np.full(n, w.max() + 1 if size else 0, w.dtype))  # words that are never equal to others
    rows = max(1, CELLS // n)
    for at in range(0, size if n > 1 else 0, rows):
        m = min(rows, size - at)
        same = _space("own", -(-m * (n - 1) // 8) * 8, bool)
        same[m * (n - 1) :] = False
        after = np.lib.stride_tricks.as_strided(beyond[at + 1 :], (m, n - 1), (beyond.itemsize, beyond.itemsize))
        np.equal(after, beyond[at : at + m, None], out=same[: m * (n - 1)].reshape(m, n - 1))
        p, d = np.divmod(_places(same), n - 1)
        p += at
        # equal words at p and p + d + 1 are in the windows that begin from p + d + 2 - n to p
        change += np.bincount(np.maximum(0, p + d + 2 - n), minlength=len(change)) - np.bincount(p + 1, minlength=len(change))
    return n + 2 * np.cumsum(change)[: len(w) - n + 1]


def _sums(x: np.ndarray, n: int, step: int, out: np.ndarray) -> np.ndarray:
    """Sums of each n numbers that stand ``step`` apart, by doubling."""
    size, power, at, width, turn = len(x) - (n - 1) * step, x, 0, 1, 0
    out = out[:size]
    while True:
        if n & width:
            piece = power[at * step : at * step + size]
            if at:
                np.add(out, piece, out=out)
            else:
                out[:] = piece
            at += width
        if 2 * width > n:
            return out
        longer = _space(f"power{turn}", len(power) - width * step, x.dtype)
        np.add(power[: len(longer)], power[width * step :], out=longer)
        power, width, turn = longer, width * 2, 1 - turn


@lru_cache(4096)
def _window_words(bases: bytes, word: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, ``_squares``) of a string's codes."""
    x = np.frombuffer(bases, np.uint8)
    if word <= 7 and not (x > 3).any():
        small = np.zeros(max(0, len(x) - word + 1), np.uint16)
        for i in range(word):
            small = small << 2 | x[i : i + len(small)]
        return small, _squares(small, n)
    w = _words(x, word)
    return w, _squares(w, n)


def d2_windows(a: np.ndarray, b: np.ndarray, window: int, word: int, skip: int = 1) -> int | None:
    """Least sum of squared differences of word counts over all pairs of windows; null if a string is shorter.

    With counts c and d it is sum(c^2) + sum(d^2) - 2 sum(c d), and the last sum is the number of equal words of a
    pair of windows, a box of the matrix of word equality.
    """
    n = window - word + 1
    if n < 1 or len(a) < window or len(b) < window:
        return None
    (x, left), (y, right) = _window_words(a.tobytes(), word, n), _window_words(b.tobytes(), word, n)
    if x.dtype != y.dtype:
        x, y = _words(a, word), _words(b, word)
    best, kind = None, np.int16 if 2 * n * n < 1 << 15 else np.int32
    size = len(y)
    rows = max(1, CELLS // max(1, size) - n)
    for at in range(0, len(left), rows):
        part, of = x[at : at + rows + n - 1], left[at : at + rows]
        cells = len(part) * size
        same = _space("same", -(-cells // 8) * 8, bool)
        same[cells:] = False
        np.equal(part[:, None], y[None, :], out=same[:cells].reshape(len(part), size))
        first = (-at) % skip
        if first >= len(of):
            continue
        if FEW * np.count_nonzero(same) ** 2 < cells:
            least = _least_of_few(_places(same), size, of, right, n, first, skip, kind)
        else:
            least = int(_least_of_rows(same[:cells].view(np.uint8), size, right, n, kind, of)[first::skip].min())
        best = least if best is None or least < best else best
    return best


#: Where this times the square of the number of equal cells is below the matrix, windows are told apart by their places.
FEW = 8


def _least_of_few(equal: np.ndarray, size: int, left: np.ndarray, right: np.ndarray, n: int, first: int, skip: int, kind) -> int:
    """Least distance of windows by the cells of equal words. The sum of a box changes only where a row or column of the
    matrix with such a cell enters or leaves it, so windows between these places are one, with the least of their squares."""
    p, q = np.divmod(equal, size)
    sides = []
    for place, squares, begin, step in ((p, left, first, skip), (q, right, 0, 1)):
        enter, leave = np.maximum(place - n + 1, 0), place + 1
        mark = np.zeros(size + len(left) + n + 1, bool)
        mark[0] = mark[enter] = mark[leave] = True
        rank, starts = np.cumsum(mark) - 1, np.flatnonzero(mark[: len(squares)])
        if step > 1:
            some = np.full(len(squares), 1 << 40, np.int64)
            some[begin::step] = squares[begin::step]
            squares = some
        sides.append((rank[enter], np.minimum(rank[leave], len(starts)), np.minimum.reduceat(squares, starts)))
    (top, bottom, left), (low, high, right) = sides
    wide = len(right) + 1
    change = np.zeros((len(left) + 1) * wide, kind)
    np.add.at(change, np.concatenate([top * wide + low, bottom * wide + high]), kind(1))
    np.add.at(change, np.concatenate([top * wide + high, bottom * wide + low]), kind(-1))
    box = change.reshape(-1, wide)
    np.cumsum(box, axis=0, out=box)
    np.cumsum(box, axis=1, out=box)
    box *= -2
    box += np.append(right, 0).astype(kind)
    return int((box[:-1, :-1].min(1) + left).min())


def _least_of_rows(same: np.ndarray, size: int, right: np.ndarray, n: int, kind, left: np.ndarray) -> np.ndarray:
    """The least distance of each window of ``left`` by sums over the whole matrix."""
    # sums down the columns and then along all rows as one; what runs on into the next row is cut off
    cells = len(same)
    narrow = same if n < 256 else same.astype(kind)
    narrow = _sums(narrow, n, size, _space("narrow", cells, narrow.dtype))
    down, score = _space("down", len(narrow), kind), _space("score", len(narrow), kind)
    down[:] = narrow
    _sums(down, n, 1, score)
    score = score.reshape(-1, size)[:, : size - n + 1]
    score *= -2
    score += right.astype(kind)
    return score.min(1) + left


def d2_whole(a: np.ndarray, b: np.ndarray, word: int) -> int:
    """The same over all words of both strings."""
    if word <= 6 and not (a > 3).any() and not (b > 3).any():
        d = np.zeros(4**word, np.int64)
        for x, sign in ((a, 1), (b, -1)):
            w = np.zeros(max(0, len(x) - word + 1), np.int64)
            for i in range(word if len(w) else 0):
                w = w << 2 | x[i : i + len(w)]
            d += sign * np.bincount(w, minlength=len(d))
        return int(d @ d)
    both, ids = np.unique(np.concatenate([_words(a, word), _words(b, word)]), return_inverse=True)
    n = max(0, len(a) - word + 1)
    d = np.bincount(ids[:n], minlength=len(both)) - np.bincount(ids[n:], minlength=len(both))
    return int((d * d).sum())


def ends(a: np.ndarray, b: np.ndarray, word: int) -> int:
    """Lesser of the distances of a's end to b's beginning and of a's beginning to b's end, over the shorter length."""
    n = min(len(a), len(b))
    return min(d2_whole(a[len(a) - n :], b[:n], word), d2_whole(a[:n], b[len(b) - n :], word))


def local_edit(a: np.ndarray, b: np.ndarray, costs: EditCosts) -> int:
    """Cost of the best local alignment with affine gaps; matches cost less than nothing, so lower is better."""
    table = np.full((256, 256), max(map(max, costs.table)), np.int64)
    table[:4, :4] = np.array(costs.table)
    m, n = len(a), len(b)
    if not m or not n:
        return 0
    big = np.int64(1 << 40)
    # anti-diagonals indexed by the place in a, from 0 (before the first base) to m
    two = np.where(np.arange(m + 1) >= 0, 0, 0).astype(np.int64)
    one = two.copy()
    up = np.full(m + 1, big)
    side = np.full(m + 1, big)
    best = 0
    for d in range(2, m + n + 1):
        low, high = max(1, d - n), min(m, d - 1)
        i = np.arange(low, high + 1)
        new = np.zeros(m + 1, np.int64)
        new_up, new_side = np.full(m + 1, big), np.full(m + 1, big)
        new_up[i] = np.minimum(up[i - 1], one[i - 1] + costs.open) + costs.extend
        new_side[i] = np.minimum(side[i], one[i] + costs.open) + costs.extend
        new[i] = np.minimum(np.minimum(0, two[i - 1] + table[a[i - 1], b[d - i - 1]]), np.minimum(new_up[i], new_side[i]))
        best = min(best, int(new[i].min()))
        two, one, up, side = one, new, new_up, new_side
    return best


def local_edits(pairs: list[tuple[np.ndarray, np.ndarray]], costs: EditCosts, together: int = 256) -> list[int]:
    """``local_edit`` of many pairs, those of similar lengths at once."""
    most = max(map(max, costs.table))
    if costs.extend < 0 or costs.open + costs.extend < 0 or min(len(costs.table), *map(len, costs.table)) < 4:
        return [local_edit(a, b, costs) for a, b in pairs]
    plain = _plain_costs(costs)
    work = (lambda held: _edits_by_letters(held, costs, *plain)) if plain else lambda held: _edits_by_table(held, costs, most)
    out, sides = [0] * len(pairs), [(a, b) if len(a) <= len(b) or not plain else (b, a) for a, b in pairs]
    order = sorted((k for k, (a, b) in enumerate(sides) if len(a) and len(b)), key=lambda k: len(sides[k][0]))
    wide = together * max(1, math.isqrt(len(order) // together))  # those of similar a, and among them those of similar b
    for lo in range(0, len(order), wide):
        left = sorted(order[lo : lo + wide], key=lambda k: -len(sides[k][1]))
        while left:
            held = left[: max(1, min(together, 2_000_000 // max(len(sides[left[0]][1]), len(sides[order[min(lo + wide, len(order)) - 1]][0]))))]
            left = left[len(held) :]
            for k, value in zip(held, work([sides[k] for k in held]).tolist(), strict=True):
                out[k] = value
    return out


def _plain_costs(costs: EditCosts) -> tuple[int, int] | None:
    """(cost of equal bases, cost of others) if the table knows no more than these, and only equal bases can be gained by."""
    equal, other = costs.table[0][0], costs.table[0][1]
    plain = all(c == (equal if x == y else other) for x, row in enumerate(costs.table) for y, c in enumerate(row))
    return (equal, other) if plain and len(costs.table) == 4 and equal <= other and 0 <= other and other - equal < 1 << 11 else None


def _edits_by_letters(held: list[tuple[np.ndarray, np.ndarray]], costs: EditCosts, equal: int, other: int) -> np.ndarray:
    """The costs of pairs at once, negated while they are worked out: ``extend`` is added for each base passed, so that gaps
    get no longer and E and F are the most that a row and a column have had."""
    m, n, w = max(len(a) for a, _ in held), max(len(b) for _, b in held), len(held)
    most = (max(0, -equal) + other + 2 * costs.extend) * (m + n + 2) + abs(costs.open)
    kind = np.int16 if most < 1 << 15 else np.int32 if most < 1 << 31 else np.int64
    gain, base = other - equal, 2 * costs.extend - other
    letter = np.append(np.array([1, 2, 4, 8]) << max(0, gain).bit_length(), np.zeros(252)).astype(kind)  # what two have in common is 0 or above the gain
    a, b = np.zeros((m, w), kind), np.zeros((n, w), kind)
    for c, (x, y) in enumerate(held):
        a[: len(x), c], b[n - len(y) :, c] = letter[x], letter[y[::-1]]
    two, one, new = (np.zeros((m + 2, w), kind) for _ in range(3))
    side, up = np.zeros((m + 2, w), kind), np.zeros((n, w), kind)
    limit, floor, gap, half = np.full((m, w), gain, kind), np.empty((m, w), kind), np.empty((m, w), kind), np.empty((m // 2 + 1, w), kind)
    best, gone = np.zeros(w, kind), costs.extend
    one[:2] = gone  # before the first base of either
    for d in range(2, m + n + 1):
        gone = costs.extend * d
        low, high = max(1, d - n), min(m, d - 1)
        i, before, j, k = slice(low, high + 1), slice(low - 1, high), slice(n - d + low, n - d + high + 1), high + 1 - low
        got, row, column, g, f = new[i], side[i], up[j], gap[:k], floor[:k]
        np.maximum(row, one[i], out=row)
        np.maximum(column, one[before], out=column)
        np.maximum(row, column, out=g)
        if costs.open:
            g -= costs.open
        np.bitwise_and(a[before], b[j], out=got)
        np.minimum(got, limit[:k], out=got)
        got += two[before]
        if base:
            got += base
        np.maximum(got, g, out=got)
        f.fill(gone)
        np.maximum(got, f, out=got)
        top = got
        while len(top) > 16:
            h = (len(top) + 1) // 2
            top = np.maximum(top[:h], top[len(top) - h :], out=half[:h] if top is got else None)
        np.maximum(best, top.max(0) - kind(gone), out=best)
        new[high + 1] = gone
        if low == 1:
            new[0] = gone
        two, one, new = one, new, two
    return -best.astype(np.int64)


def _edits_by_table(held: list[tuple[np.ndarray, np.ndarray]], costs: EditCosts, most: int) -> np.ndarray:
    table = np.full((6, 6), most, np.int32)  # codes 0 to 3, others, and what fills up shorter strings
    table[:4, :4] = np.array(costs.table)
    table[5], table[:, 5] = 1 << 20, 1 << 20
    table, big = table.ravel(), np.int32(1 << 28)
    m, n, w = max(len(a) for a, _ in held), max(len(b) for _, b in held), len(held)
    a, b = np.full((m, w), 30, np.uint8), np.full((n, w), 5, np.uint8)
    for c, (x, y) in enumerate(held):
        a[: len(x), c], b[n - len(y) :, c] = np.minimum(x, 4) * 6, np.minimum(y, 4)[::-1]
    two, one, new = (np.zeros((m + 2, w), np.int32) for _ in range(3))
    up, side, new_up, new_side = (np.full((m + 2, w), big, np.int32) for _ in range(4))
    best = np.zeros(w, np.int32)
    for d in range(2, m + n + 1):
        low, high = max(1, d - n), min(m, d - 1)
        i, before = slice(low, high + 1), slice(low - 1, high)
        np.minimum(up[before], one[before] + costs.open, out=new_up[i])
        np.minimum(side[i], one[i] + costs.open, out=new_side[i])
        new_up[i] += costs.extend
        new_side[i] += costs.extend
        got = np.take(table, a[before] + b[n - d + low : n - d + high + 1])
        got += two[before]
        np.minimum(got, new_up[i], out=got)
        np.minimum(got, new_side[i], out=got)
        np.minimum(got, 0, out=new[i])
        np.minimum(best, new[i].min(0), out=best)
        new[high + 1], new_up[high + 1], new_side[high + 1] = 0, big, big  # before the first base of b
        two, one, new, up, new_up, side, new_side = one, new, two, new_up, up, new_side, side
    return best


class WordSet:
    """The words of 8 codes of a string: those of A, C, G and T as flags, further ones as sorted numbers."""

    def __init__(self, a: np.ndarray):
        word, plain = _octets(a)
        self.flags = np.zeros(1 << 16, bool)
        self.flags[word[plain]] = True
        self.others = np.unique(_words(a, 8)[~plain]) if not plain.all() else None


def _octets(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of 8 codes as base-4 numbers, which of them have no further codes)"""
    n = len(x) - 7
    if n < 1:
        return np.zeros(0, np.uint16), np.zeros(0, bool)
    two = (x[:-1].astype(np.uint16) & 3) << 2 | x[1:] & 3
    four = two[:-2] << 4 | two[2:]
    word = (four[:-4] << 8 | four[4:]).astype(np.uint16)
    other = x > 3
    if not other.any():
        return word, np.ones(n, bool)
    bad = np.append(0, np.cumsum(other))
    return word, bad[8:] == bad[:-8]


def word_hits(a: np.ndarray | WordSet, b: np.ndarray, window: int) -> tuple[int, int]:
    """(sample hits, most windowed hits) of b's words of 8 bases among those of a.

    Samples are the words at places 8k, 1 <= k <= length div 8 - 2; windows are window + 7 consecutive words.
    """
    own = a if isinstance(a, WordSet) else WordSet(a)
    word, plain = _octets(b)
    hit = own.flags[word] & plain
    if own.others is not None and not plain.all():
        hit |= ~plain & np.isin(_words(b, 8), own.others)
    last = len(b) // 8 - 2
    sample = int(np.count_nonzero(hit[8 : 8 * last + 1 : 8])) if last >= 1 else 0
    if not len(hit):
        return sample, 0
    total = np.zeros(len(hit) + 1, np.int64)
    np.cumsum(hit, out=total[1:])
    w = window + 7
    if w >= len(hit):
        return sample, int(total[-1])
    return sample, int((total[w:] - total[:-w]).max())


def pair_hits(pairs: list[tuple[np.ndarray, np.ndarray]], window: int, together: int = 64, most: int = 1_000_000) -> list[tuple[int, int]]:
    """``word_hits`` of many pairs; words of A, C, G and T are looked up in flags of many pairs at once."""
    out, held, size = [(0, 0)] * len(pairs), [], 0
    for k, (a, b) in enumerate(pairs):
        if len(a) > 7 and len(b) > 7:
            held.append(k)
            size += len(a) + len(b)
        if held and (len(held) == together or size > most or k == len(pairs) - 1):
            for x, found in zip(held, _hits_at_once([pairs[x] for x in held], window), strict=True):
                out[x] = found
            held, size = [], 0
    return out


def _hits_at_once(pairs: list[tuple[np.ndarray, np.ndarray]], window: int) -> list[tuple[int, int]]:
    (x, _, x_plain, x_bad), (y, start, y_plain, y_bad) = _strung([a for a, _ in pairs]), _strung([b for _, b in pairs])
    if "flags" not in _SPACE or len(_SPACE["flags"]) < len(pairs) << 16:
        _SPACE["flags"] = np.zeros(len(pairs) << 16, bool)
    flags = _SPACE["flags"]  # none is set between two calls
    try:
        flags[x if x_plain is None else x[x_plain]] = True
        hit = flags[y] if y_plain is None else flags[y] & y_plain
    finally:
        flags[x] = False
    first, n = start[:-1], np.diff(start)
    total = np.zeros(len(hit) + 1, np.int32)
    np.cumsum(hit, out=total[1:])
    samples = np.maximum((n + 7) // 8 - 2, 0)
    upto = np.append(0, np.cumsum(samples))
    at = np.repeat(first - 8 * upto[:-1], samples) + 8 * np.arange(1, upto[-1] + 1)
    sampled = np.append(0, np.cumsum(hit[at]))
    end = np.minimum(np.arange(len(hit)) + window + 7, np.repeat(start[1:], n))  # what a window has behind the string is cut off
    hits = np.maximum.reduceat(total[end] - total[:-1], first)
    found = list(zip((sampled[upto[1:]] - sampled[upto[:-1]]).tolist(), hits.tolist(), strict=True))
    return [word_hits(*pair, window) if other else f for pair, other, f in zip(pairs, (x_bad & y_bad).tolist(), found, strict=True)]


def _strung(strings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray | None, np.ndarray]:
    """(words of 8 codes of strings one after the other, with the string's number above 16 bits; where each string's begin,
    with the end; which words have no further codes, None if all; which strings have further codes)"""
    length, all_ = np.array([len(x) for x in strings]), np.concatenate(strings)
    begin = np.append(0, np.cumsum(length))
    two = (all_[:-1].astype(np.uint16) & 3) << 2 | all_[1:] & 3
    four = two[:-2] << 4 | two[2:]
    word, keep = four[:-4] << 8 | four[4:], np.ones(len(all_) - 7, bool)
    keep[(begin[1:-1, None] - np.arange(1, 8)).ravel()] = False
    word = word[keep].astype(np.int64) + np.repeat(np.arange(len(strings)) << 16, length - 7)
    other = all_ > 3
    if not other.any():
        return word, np.append(0, np.cumsum(length - 7)), None, np.zeros(len(strings), bool)
    bad = np.append(0, np.cumsum(other, dtype=np.int32))
    return word, np.append(0, np.cumsum(length - 7)), (bad[8:] == bad[:-8])[keep], bad[begin[1:]] > bad[begin[:-1]]


@dataclass(frozen=True)
class Distance:
    """``match(a, b, window, theta, config)``: a value not above theta exactly if the strings match; ``exact`` is free
    of theta. ``theta`` and ``word_len`` replace those of the configuration where set. ``many`` does the pairs of a
    batch, given as (a, b, window), at once."""

    exact: Callable[[np.ndarray, np.ndarray, int, ClusterConfig], int | None]
    theta: int | None = None
    word_len: int | None = None
    many: Callable[[list[tuple[np.ndarray, np.ndarray, int]], ClusterConfig], list[int | None]] | None = None


DISTANCES: dict[str, Distance] = {
    "d2": Distance(lambda a, b, window, c: d2_windows(a, b, window, c.word_len, c.skip)),
    "whole": Distance(lambda a, b, window, c: d2_whole(a, b, c.word_len)),
    "ends": Distance(lambda a, b, window, c: ends(a, b, c.word_len)),
    "ed": Distance(lambda a, b, window, c: local_edit(a, b, c.costs or EditCosts()), -20, 1, lambda pairs, c: local_edits([p[:2] for p in pairs], c.costs or EditCosts())),
    "heuristic": Distance(lambda a, b, window, c: 1),
}


def register_distance(name: str, distance: Distance | Callable) -> None:
    """Makes a distance usable in ``ClusterConfig.distance``; a plain function of two strings' codes will do."""
    DISTANCES[name] = distance if isinstance(distance, Distance) else Distance(lambda a, b, window, c: distance(a, b))


def settled(config: ClusterConfig) -> ClusterConfig:
    """The configuration with what its distance prescribes; an unknown distance is an error."""
    if config.distance not in DISTANCES:
        raise ValueError(f"unknown distance {config.distance}; known: {', '.join(sorted(DISTANCES))}")
    d = DISTANCES[config.distance]
    return config.but(**{k: v for k, v in (("theta", d.theta), ("word_len", d.word_len)) if v is not None and getattr(config, k) == getattr(ClusterConfig(), k)})


#: Pairs and strands, of whatever groups, whose distances are worked out at once.
TOGETHER = 4000
SCORES = "i bigint, j bigint, strand int, window int, sample int, hits int, dist bigint"


def scored_pairs(pairs: DataFrame, reads: DataFrame, config: ClusterConfig, filtered: bool = True, counted: bool = True) -> DataFrame:
    """(i, j, strand, window, sample, hits, dist) of each pair and strand.

    ``window`` is the shorter of the window and both lengths; with ``filtered`` the distance is null where the sample
    or the windowed hits miss their thresholds, scaled to short reads, so it is not computed there. Unknown reads
    have no row. Without ``counted``, for distances that are not filtered, sample and hits are null. ``reads`` has one row per seq_id; bases go to the pairs as in ``beside``.
    """
    config = settled(config)
    if filtered and not counted:
        raise ValueError("filters need counts")
    exact, many = DISTANCES[config.distance].exact, DISTANCES[config.distance].many
    strands = [1, -1] if config.rc_check else [1]
    def score(groups: Iterator[Group]) -> Iterator[pa.RecordBatch]:
        rows, asked = [], []
        for g in groups:
            known = np.flatnonzero(g.at_two >= 0)
            for at in range(0, len(known), 500):
                look(g, known[at : at + 500], rows, asked)
                if len(rows) >= TOGETHER or sum(len(a) + len(b) for _, (a, b, _) in asked) > 1000 * TOGETHER:
                    yield scored(rows, asked)
                    rows, asked = [], []
        if rows:
            yield scored(rows, asked)

    def look(g: Group, pairs: np.ndarray, rows: list, asked: list) -> None:
        last, found = None, []
        one, two = np.frombuffer(g.one, np.uint8), np.frombuffer(g.two, np.uint8)
        for x, y in zip(g.at_one[pairs].tolist(), g.at_two[pairs].tolist(), strict=True):
            if x != last:
                a, last = _CODE[one[g.one_offsets[x] : g.one_offsets[x + 1]]], x
            b = _CODE[two[g.two_offsets[y] : g.two_offsets[y + 1]]]
            found += [(a, b if s > 0 else _COMPLEMENT[b[::-1]]) for s in strands]
        counts = pair_hits(found, config.window_len) if counted else [(None, None)] * len(found)
        for k, (i, j) in enumerate(zip(g.i[g.at_one[pairs]].tolist(), g.j[pairs].tolist(), strict=True)):
            own = slice(k * len(strands), (k + 1) * len(strands))
            some = counted and max(sample for sample, _ in counts[own]) > 1
            for s, (a, b), (sample, hits) in zip(strands, found[own], counts[own], strict=True):
                window = min(config.window_len, len(a), len(b))
                _, common, least = thresholds(config, len(a), len(b))
                if not filtered or (some and sample > least and hits >= common):
                    asked.append((len(rows), (a, b, window)))
                rows.append([i, j, s, window, sample, hits, None])

    def scored(rows: list, asked: list) -> pa.RecordBatch:
        values = many([x for _, x in asked], config) if many else [exact(*x, config) for _, x in asked]
        for (at, _), value in zip(asked, values, strict=True):
            rows[at][6] = value
        cols = zip(*rows, strict=True)
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["i", "j", "strand", "window", "sample", "hits", "dist"])

    held = reads.where("seq_id is not null and bases is not null").select(F.col("seq_id").cast("bigint").alias("seq"), ascii_bytes("bases").alias("data"))
    held, _ = Durable(reads.sparkSession, "scored").keep(held)
    size = int(held.agg(F.sum(F.length("data"))).first()[0] or 0)
    known = pairs.where("i is not null and j is not null").select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j"))
    return beside(known, held, score, SCORES, size)


def ascii_bytes(bases: str) -> Column:
    """One byte a character; one outside ASCII becomes a question mark, as in ``codes``."""
    return F.encode(F.regexp_replace(bases, r"[^\x00-\x7F]", "?"), "UTF-8")


def thresholds(config: ClusterConfig, len_i: int, len_j: int) -> tuple[int, int, int]:
    """(theta, windowed hits, sample hits) for reads of these lengths: short reads get proportionally less."""
    window = min(config.window_len, len_i, len_j)
    theta = window * config.theta // config.window_len if config.theta >= 0 else config.theta
    common = config.common_word - (config.window_len - window)
    least = config.sample_thresh - ((116 - len_j) >> 4) if len_j < 100 else config.sample_thresh
    return theta, common, least


def matching(scores: DataFrame, config: ClusterConfig) -> DataFrame:
    """(i, j, strand, dist) of the pairs within theta, which is scaled to the window."""
    config = settled(config)
    theta = F.floor(F.col("window") * config.theta / config.window_len) if config.theta >= 0 else F.lit(config.theta)
    return scores.where(F.col("dist") <= theta).select("i", "j", "strand", "dist")
