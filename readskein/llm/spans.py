"""Long exact spans shared between records, by recompression.

Rounds alternately name runs of one symbol and pairs of adjacent symbols (left class, right class). A name is a
64-bit hash of what it stands for, so all records agree on it without an exchange. Of each symbol the stretch of text
that alone decides it is known (its context); a symbol whose context lies inside a window occurs at the same place in
every window of equal text. Each window of the least length is put under one of its symbols, which depends on the
window's text alone: of the highest level with several symbols in the window, the one with the least name. Windows next
to one another mostly share it, so a symbol stands for a stretch of windows.

Stretches are brought together by symbol, once, with their text. A symbol of one record only shares nothing. Of the
others, stretches of equal text in two records are shared as a whole; only where stretches under one symbol differ are
their windows compared, as numbers holding all their characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import flat, packed, slices, windows_ok
from ..functions.buckets import SCHEMA, bucket_number, bucket_of, bundled, frequent_keys, mix, partitions, shuffled, whole_buckets
from ..session import Durable

#: Rounds of naming; higher symbols stand for longer stretches, and windows without some fall back to lower ones.
ROUNDS = 4
#: Symbols of a level that a window must hold for one of them to be chosen; at the lowest level one is enough.
SEVERAL = 4
#: Rows of a bucket; each may stand for some dozen windows.
ROWS = 250_000
#: Positions of a record that are counted together.
STRIP = 1 << 20
_FAR = np.int64(1) << np.int64(60)


def _shift(x: np.ndarray, by: int, fill: int) -> np.ndarray:
    out = np.full_like(x, fill)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def _runs(name, low, high, part, level):
    """Maximal runs of one symbol become one; every symbol's context then holds its neighbours."""
    before_low, after_high = _shift(low, 1, -_FAR), _shift(high, -1, _FAR)
    same = np.zeros(len(name), bool)
    same[1:] = part[1:] == part[:-1]
    before_low[~same] = -_FAR
    ends = np.ones(len(name), bool)
    ends[:-1] = ~same[1:]
    after_high[ends] = _FAR
    first = np.ones(len(name), bool)
    first[1:] = ~same[1:] | (name[1:] != name[:-1])
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(name)) - 1
    length = (last - at + 1).astype(np.uint64)
    with np.errstate(over="ignore"):
        named = np.where(length > 1, mix(name[at] * np.uint64(3) + length * np.uint64(0x9E3779B97F4A7C15) + np.uint64(2 * level)), name[at])
    return named, np.minimum(low[at], before_low[at]), np.maximum(high[last], after_high[last]), part[at]


def _pairs(name, low, high, part, level):
    """A symbol of the left class and one of the right class after it become one."""
    right = (mix(name + np.uint64(7919 * (level + 1))) & np.uint64(1)).astype(bool)
    same = np.zeros(len(name), bool)
    same[1:] = part[1:] == part[:-1]
    joins = np.zeros(len(name), bool)  # joins the symbol before
    joins[1:] = same[1:] & right[1:] & ~right[:-1]
    joined = np.zeros(len(name), bool)  # is joined by the symbol after
    joined[:-1] = joins[1:]
    after = np.zeros(len(name), bool)
    after[:-1] = same[1:]
    # what stays alone does so because of its neighbour on the side where it could have been joined
    after_high = np.where(after, _shift(high, -1, _FAR), _FAR)
    before_low = np.where(same, _shift(low, 1, -_FAR), -_FAR)
    alone = ~joins & ~joined
    new_low = np.where(alone & right, np.minimum(low, before_low), low)
    new_high = np.where(joined, _shift(high, -1, _FAR), np.where(alone & ~right, np.maximum(high, after_high), high))
    with np.errstate(over="ignore"):
        pair = mix(name * np.uint64(0xD6E8FEB86659FD93) + mix(_shift(name, -1, 0)) + np.uint64(2 * level + 1))
    named = np.where(joined, pair, name)
    keep = ~joins
    return named[keep], new_low[keep], new_high[keep], part[keep]


def _texts(codes: np.ndarray):
    """A function giving a hash of the text of each stretch (low, high)."""
    base = 0x9E3779B97F4A7C15
    n = len(codes)
    with np.errstate(over="ignore"):
        power = np.concatenate([np.ones(1, np.uint64), np.full(n, base, np.uint64)]).cumprod(dtype=np.uint64)
        inverse = np.concatenate([np.ones(1, np.uint64), np.full(n, pow(base, -1, 1 << 64), np.uint64)]).cumprod(dtype=np.uint64)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(codes.astype(np.uint64) + np.uint64(5)) * power[:n], out=sums[1:])

    def text(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64)

    return text


def anchors(codes: np.ndarray, offsets: np.ndarray, span: int, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, count, symbol): ``count`` windows from ``start`` (absolute) on are put under ``symbol``."""
    starts, rows = windows_ok(codes, offsets, span)
    none = np.zeros(0, np.int64)
    if not len(starts):
        return none, none, none, none
    at = np.flatnonzero(codes <= 3)
    edge = np.zeros(len(codes) + 1, np.int64)
    edge[1:] = np.cumsum(codes > 3)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    part = (edge[at] + row[at] * (edge[-1] + 1)).astype(np.int64)  # a run of A, C, G, T within a row
    name, low, high = mix(codes[at].astype(np.uint64) + np.uint64(11)), at.astype(np.int64), at.astype(np.int64) + 1
    levels = [(name, low, high)]
    for level in range(rounds):
        name, low, high, part = _runs(name, low, high, part, level)
        name, low, high, part = _pairs(name, low, high, part, level)
        levels.append((name, low, high))
    text = _texts(codes)
    symbol, chosen = np.zeros(len(starts), np.uint64), np.full(len(starts), -1, np.int64)
    open_ = np.arange(len(starts))
    for level in range(rounds, -1, -1):
        name, low, high = levels[level]
        inside = (low > -_FAR) & (high < _FAR)
        name, low, high = name[inside], low[inside], high[inside]
        if not len(low):
            continue
        # the text of its context is the same wherever the window is, so it makes the symbol more telling
        with np.errstate(over="ignore"):
            full = mix(name + np.uint64(level) * np.uint64(0xA24BAED4963EE407)) ^ mix(text(low, high))
        s = starts[open_]
        k, to = np.searchsorted(low, s), np.searchsorted(high, s + span, "right")
        fits = to - k >= (SEVERAL if level else 1)
        hit, k, to = open_[fits], k[fits], to[fits]
        best = _least(full, k, to)
        symbol[hit] = full[best]
        chosen[hit] = best * (rounds + 1) + level
        open_ = open_[~fits]
        if not len(open_):
            break
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (starts[1:] != starts[:-1] + 1) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    return rows[first], starts[first], np.diff(np.append(first, len(starts))), symbol[first].view(np.int64)


def _least(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The place of the least value from low to below high, the first of equal ones, for each of the ranges."""
    out = np.zeros(len(low), np.int64)
    if not len(low):
        return out
    step = np.frexp((high - low).astype(np.float64))[1] - 1  # the power of two that covers at least half the range
    table = np.arange(len(values))
    for d in range(int(step.max()) + 1):
        use = np.flatnonzero(step == d)
        if len(use):
            a, b = table[low[use]], table[high[use] - (1 << d)]
            out[use] = np.where(values[b] < values[a], b, a)
        if len(table) > 1 << d:
            a, b = table[: -(1 << d)], table[1 << d :]
            table = np.where(values[b] < values[a], b, a)
    return out


def _kind(span: int) -> np.dtype:
    return np.dtype([("key", "i8"), ("id", "i8"), ("start", "i4"), ("count", "i2"), ("text", "i8", (-(-(2 * span - 1) // 30),))])


def stretches(codes: np.ndarray, offsets: np.ndarray, ids: np.ndarray, span: int, rounds: int) -> np.ndarray:
    """The stretches of windows of each row under their symbols, with their text, 30 bases in a number."""
    row, start, count, symbol = anchors(codes, offsets, span, rounds)
    # a stretch of many windows of one symbol is cut, so that its text has a bounded length
    parts = -(-count // span)
    row, symbol, at = np.repeat(row, parts), np.repeat(symbol, parts), np.repeat(start, parts)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
    count = np.minimum(span, np.repeat(count, parts) - nth * span)
    at = at + nth * span
    out = np.zeros(len(row), _kind(span))
    out["key"], out["id"], out["start"], out["count"] = symbol, ids[row], at - offsets[row], count
    length = count + span - 1
    if len(row):
        word = packed(np.append(codes & 3, np.zeros(60, np.uint8)), 30)
        for i in range(out["text"].shape[1]):
            left = np.clip(length - 30 * i, 0, 30)  # bases of the stretch in this number
            mask = ((np.int64(1) << (2 * left)) - 1) << (60 - 2 * left)
            out["text"][:, i] = word[np.minimum(at + 30 * i, len(word) - 1)] & mask
    return out


def _windows(text: np.ndarray, at: np.ndarray, span: int) -> list[np.ndarray]:
    """The window from each place of a stretch's text as numbers of 30 bases."""
    out, mask = [], (np.int64(1) << 60) - 1
    for i in range(-(-span // 30)):
        p = at + min(30 * i, span - 30)
        q, r = p // 30, 2 * (p % 30)
        n = np.arange(len(at))
        out.append(((text[n, q] << r) & mask) | (text[n, np.minimum(q + 1, text.shape[1] - 1)] >> (60 - r)))
    return out


def _runs_of(id_: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(id, from, to) of the runs of consecutive places, which are sorted by id and place."""
    if not len(at):
        return id_, at, at
    new = np.append(True, (id_[1:] != id_[:-1]) | (at[1:] != at[:-1] + 1))
    first = np.flatnonzero(new)
    return id_[first], at[first], at[np.append(first[1:], len(at)) - 1]


_SHARED = np.dtype([("key", "i8"), ("id", "i8"), ("strip", "i4"), ("low", "i4"), ("high", "i4")])


def _open_kind(span: int) -> np.dtype:
    return np.dtype([("key", "i8"), ("id", "i8"), ("at", "i4"), ("shared", "i4"), ("window", "i8", (-(-span // 30),))])


def _intervals(id_, low, high, span: int, n: int, strip_len: int) -> pa.RecordBatch:
    """Windows from low to high cover the positions from low to high + span - 1; these go to the bucket of their strip."""
    low, high = low.astype(np.int64), high.astype(np.int64) + span  # the end is outside
    parts = (high - 1) // strip_len - low // strip_len + 1
    id_, strip = np.repeat(id_, parts), np.repeat(low // strip_len, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    out = np.zeros(len(id_), _SHARED)
    out["id"], out["strip"] = id_, strip
    out["low"], out["high"] = np.maximum(np.repeat(low, parts) - strip * strip_len, 0), np.minimum(np.repeat(high, parts) - strip * strip_len, strip_len)
    out["key"] = (mix(id_) + strip.astype(np.uint64)).view(np.int64)
    return bundled(out, bucket_of(out["key"], n).astype(np.int64))


def _groups(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, number of the group of each in that order) of rows equal in all columns."""
    order = np.lexsort(columns[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            c = c[order]
            new[1:] |= c[1:] != c[:-1]
    return order, np.cumsum(new) - 1


def _several(ids: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether each group, of rows in the order of groups, has more than one id."""
    if not len(ids):
        return np.zeros(0, bool)
    starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    return np.minimum.reduceat(ids, starts) < np.maximum.reduceat(ids, starts)


def verified(rows: np.ndarray, span: int, hot: np.ndarray) -> tuple[tuple, np.ndarray]:
    """((id, from, to) of the runs of shared windows among the stretches of whole symbols; windows left open, which belong
    to symbols in ``hot``, of which other buckets hold more)."""
    split = np.isin(rows["key"], hot)
    order, group = _groups(rows["key"])
    rows, split = rows[order], split[order]
    live = _several(rows["id"], group)[group] | split if len(rows) else split
    rows = rows[live]
    words = [rows["text"][:, i] for i in range(rows["text"].shape[1])]
    order, same = _groups(rows["key"], rows["count"], *words)
    rows = rows[order]
    whole = _several(rows["id"], same)  # of each text, whether two records have it
    done = whole[same] if len(rows) else np.zeros(0, bool)
    shared = (rows["id"][done], rows["start"][done], rows["start"][done] + rows["count"][done] - 1)
    # the first stretch of each text that is shared stands for it; symbols with one text only are settled
    head = np.append(True, same[1:] != same[:-1])[: len(rows)]
    _, symbol = np.unique(rows["key"], return_inverse=True)
    texts = np.bincount(symbol, head)
    open_ = (head | ~done) & ((texts[symbol] > 1) | np.isin(rows["key"], hot)) if len(rows) else done
    some, settled = rows[open_], done[open_]
    n = some["count"].astype(np.int64)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    text, ids, start, settled = np.repeat(some["text"], n, 0), np.repeat(some["id"], n), np.repeat(some["start"], n) + at, np.repeat(settled, n)
    window = _windows(text, at, span)
    order, group = _groups(*window)
    ids, start, settled = ids[order], start[order], settled[order]
    if len(ids):
        firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        common = (_several(ids, group) | np.maximum.reduceat(settled, firsts))[group]
    else:
        firsts, common = np.zeros(0, np.int64), np.zeros(0, bool)
    mine = common & ~settled
    by = np.lexsort((start[mine], ids[mine]))
    runs = _runs_of(ids[mine][by], start[mine][by])
    out = tuple(np.concatenate([a, b]) for a, b in zip(shared, runs, strict=True))
    left = np.zeros(0, _open_kind(span))
    if len(hot) and len(ids):
        belongs = np.repeat(np.isin(some["key"], hot), n)[order]
        head = np.zeros(len(ids), bool)
        head[firsts] = True
        keep = belongs & (~common | head)  # of a shared window one row tells the others
        left = np.zeros(keep.sum(), _open_kind(span))
        left["id"], left["at"], left["shared"] = ids[keep], start[keep], common[keep]
        for i, w in enumerate(window):
            left["window"][:, i] = w[order][keep]
        left["key"] = mix(left["window"].view(np.uint64).sum(1, dtype=np.uint64)).view(np.int64)
    return out, left


def shared_spans(records: DataFrame, id: str = "seq_id", text: str = "bases", span: int = 60, rounds: int = ROUNDS) -> DataFrame:
    """(id, n_shared): the number of a record's characters in stretches of at least ``span`` characters that
    also occur in a record of another id; records without any have no row.

    Case is ignored; any character other than A, C, G, T ends a stretch; null, empty and short texts have none.
    Rows repeating id and text count once; an id with several texts has all of them, each from position 0 on.
    ``span`` must be at least 30. Rows without id are dropped; an empty table gives an empty result. A symbol of very
    many stretches is dealt to several buckets, and windows that one of these can't settle meet once more.
    """
    if span < 30:
        raise ValueError("span must be at least 30")
    spark = records.sparkSession
    rows = records.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & (F.length("text") >= span)).distinct()
    rows, _ = Durable(spark, "spans").keep(rows)
    size = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    buckets = bucket_number(spark, (size[1] or 0) // 15, ROWS)
    kind, open_kind, strip_len = _kind(span), _open_kind(span), STRIP
    of = lambda batch: stretches(*flat(batch.column(1)), batch.column(0).to_numpy(), span, rounds)
    hot = {} if buckets == partitions(spark) else frequent_keys(rows, size[0], lambda batch: of(batch)["key"], buckets)
    names = np.array(sorted(hot), np.int64)
    ways = np.array([hot[x] for x in names.tolist()], np.int64)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=100_000):
                out = of(part)
                key = out["key"].copy()
                if len(names):
                    at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                    among = names[at] == key
                    key[among] += (mix(out["id"][among]) % ways[at[among]].astype(np.uint64)).astype(np.int64)
                yield bundled(out, bucket_of(key, buckets).astype(np.int64))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in whole_buckets(batches, kind):
            runs, left = verified(held, span, names)
            yield _intervals(*runs, span, buckets, strip_len)
            if len(left):
                yield bundled(left, -1 - bucket_of(left["key"], buckets).astype(np.int64))

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in whole_buckets(batches, open_kind):
            order, group = _groups(*(held["window"][:, i] for i in range(held["window"].shape[1])))
            held = held[order]
            firsts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            common = (_several(held["id"], group) | (np.maximum.reduceat(held["shared"], firsts) > 0))[group]
            held = held[common & (held["shared"] == 0)]
            held = held[np.lexsort((held["at"], held["id"]))]
            yield _intervals(*_runs_of(held["id"], held["at"]), span, buckets, strip_len)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in whole_buckets(batches, _SHARED):
            held = held[np.lexsort((held["low"], held["strip"], held["id"]))]
            new = np.append(True, (held["id"][1:] != held["id"][:-1]) | (held["strip"][1:] != held["strip"][:-1]))[: len(held)]
            shift = (np.cumsum(new) - 1) * (2 * strip_len)
            low, high = held["low"] + shift, held["high"] + shift
            reached = np.append(np.int64(-1), np.maximum.accumulate(high)[:-1]) if len(high) else high
            covered = np.maximum(0, high - np.maximum(low, reached))
            first = np.flatnonzero(new)
            if len(first):
                yield pa.RecordBatch.from_arrays([pa.array(held["id"][first]), pa.array(np.add.reduceat(covered, first))], ["id", "n"])

    bundles = shuffled(rows.mapInArrow(spread, SCHEMA)).mapInArrow(verify, SCHEMA)
    if len(names):
        bundles, _ = Durable(spark, "spans").keep(bundles)
        bundles = bundles.where("bucket >= 0").unionByName(shuffled(bundles.where("bucket < 0").withColumn("bucket", -1 - F.col("bucket"))).mapInArrow(settle, SCHEMA))
    counted = shuffled(bundles).mapInArrow(add, "id bigint, n bigint")
    return counted.groupBy(F.col("id").alias(id)).agg(F.sum("n").alias("n_shared"))
