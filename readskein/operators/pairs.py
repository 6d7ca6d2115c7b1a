"""Pairs of reads that may match."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClusterConfig
from ..functions.arrays import flat, packed, slices, turned, windows_ok
from ..functions.buckets import SCHEMA, bucket_blobs, bucket_number, bucket_of, bundled, bundled_blobs, frequent_keys, mix, partitions, shuffled, squeezed, unsqueezed
from ..session import Durable
from .beside import Group, beside


def _counted(codes: np.ndarray, offsets: np.ndarray, k: int, either_strand: bool) -> tuple[np.ndarray, ...]:
    """(row, word, n, first, last, twofold) of the distinct words of each row; places count from the row's start."""
    at, row = windows_ok(codes, offsets, k)
    word = packed(codes, k)[at]
    twofold = np.zeros(len(word), bool)
    if either_strand:
        other = turned(codes, k)[at]
        twofold, word = word == other, np.minimum(word, other)
    order = np.lexsort((word, row))
    row, word, place = row[order], word[order], (at - offsets[row])[order]
    new = np.ones(len(word), bool)
    new[1:] = (row[1:] != row[:-1]) | (word[1:] != word[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(word)) - 1
    # the order is stable, so equal words stand by place
    return row[first], word[first], (last - first + 1).astype(np.int32), place[first].astype(np.int32), place[last].astype(np.int32), twofold[order][first]


def word_table(reads: DataFrame, k: int, either_strand: bool) -> DataFrame:
    """(seq_id, word, n, first, last, twofold): the distinct words of k <= 31 bases of each read as base-4 numbers,
    with how often they occur and their outermost places; with ``either_strand`` a word and its reverse complement are
    one, named by the lesser, and twofold tells whether they are the same.

    ``reads`` has one row per seq_id. Words with a character other than A, C, G, T are left out, null and short bases
    have none. Counted in Arrow batches, before anything is shuffled.
    """
    if not 1 <= k <= 31:
        raise ValueError("words have 1 to 31 bases")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, *rest = _counted(*flat(part.column(1)), k, either_strand)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), *map(pa.array, rest)], ["seq_id", "word", "n", "first", "last", "twofold"])

    rows = reads.where(F.length("bases") >= k).select(F.col("seq_id").cast("bigint").alias("seq_id"), "bases")
    return rows.mapInArrow(count, "seq_id bigint, word bigint, n int, first int, last int, twofold boolean")


#: Rows of one word that meet in one task; the rows of more frequent words meet in blocks of so many.
BLOCK = 2048
#: Bases of the reads whose words are shuffled at once; those of more reads travel in several passes over the buckets.
PASS_BASES = 100_000_000
#: Words of more reads are big: pairs meet by them only where nothing rarer can bring together what they need.
BIG_READS = 64
_WORD = np.dtype([("key", "i8"), ("seq", "i8"), ("n", "i4"), ("first", "i4"), ("last", "i4"), ("flags", "i4")])
_TWOFOLD, _LEFT, _RIGHT, _SHORT, _WIDE = 1, 2, 4, 8, 16


def in_blocks(rows: DataFrame, key: str, block: int = BLOCK) -> DataFrame:
    """All pairs of rows of the same ``key``, as columns one and two (structs of the other columns): each two rows in both
    orders, and each row with itself.

    A key's rows are dealt into blocks by hash, as many as its number of rows asks for, and every pair of blocks meets
    under a key of its own. So the pairs of a hot key are spread over many tasks; rows are copied once per block.
    """
    rest = [c for c in rows.columns if c != key]
    blocks = rows.groupBy(key).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = rows.join(blocks, key).select(key, F.struct(*rest).alias("_row"), F.pmod(F.xxhash64(*rest), F.col("_n")).cast("int").alias("_own"), F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_other"))
    one = dealt.select(key, F.col("_own").alias("_x"), F.col("_other").alias("_y"), F.col("_row").alias("one"))
    two = dealt.select(key, F.col("_other").alias("_x"), F.col("_own").alias("_y"), F.col("_row").alias("two"))
    return one.hint("merge").join(two.hint("merge"), [key, "_x", "_y"]).select(key, "one", "two")


def candidates(reads: DataFrame, config: ClusterConfig, left: DataFrame | None = None, right: DataFrame | None = None, symmetric: bool = False) -> DataFrame:
    """(i, j, shared, span): pairs i < j of which i's words meet those of j or of its reverse complement.

    A pair needs ``alpha`` shared words, occurrences counted on both sides, whose outermost places in i are at least
    ``beta`` apart; if i is shorter than the window, one word and a quarter of beta. Reads below ``min_len`` take no
    part. ``left`` and ``right`` (seq_id) restrict i and j; ``symmetric`` gives both orders and no relief for short
    reads. Stretches of consecutive words with the same least part are shuffled as packed bases; what the pairs of
    reads share is added up in the bucket of the words and shuffled packed by i. Of the words of more than ``BIG_READS``
    reads those bring pairs together that lie outside one stretch of i (``with_wide``); the others count for pairs that
    share another word too. Words in more than ``max_word_freq`` reads nominate nobody if that is set.
    """
    spark = reads.sparkSession
    flags = F.when(F.length("bases") < config.window_len, _SHORT).otherwise(0)
    rows = reads.where(F.length("bases") >= config.min_len).select(F.col("seq_id").cast("bigint").alias("seq_id"), "bases")
    for bit, side in ((_LEFT, left), (_RIGHT, right)):
        if side is None:
            flags = flags + bit
        else:
            rows = rows.join(side.select("seq_id").distinct().withColumn(f"side{bit}", F.lit(bit)), "seq_id", "left")
            flags = flags + F.coalesce(f"side{bit}", F.lit(0))
    rows, rows_at = Durable(spark, "reads").keep(rows.select("seq_id", "bases", flags.alias("flags")).where(F.col("flags").bitwiseAND(_LEFT | _RIGHT) > 0))
    k, either, limit, block, rare = config.kmer_len, config.rc_check, config.max_word_freq, BLOCK, min(BIG_READS, BLOCK)
    size = rows.agg(F.count("*"), F.sum(F.length("bases"))).first()
    buckets = bucket_number(spark, size[1] or 0)
    hot = {} if buckets == partitions(spark) else frequent_keys(rows, size[0], lambda batch: _counted(*flat(batch.column(1)), k, either)[1], buckets)
    hot = np.array(sorted(hot), np.int64)  # words that no bucket should hold
    m, to = least_part(k, buckets), buckets if buckets == partitions(spark) else 4 * buckets
    passes = max(1, min(buckets // partitions(spark), math.ceil((size[1] or 0) / PASS_BASES)))

    def spread(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        chosen = np.arange(buckets) * passes // buckets == turn
        for batch in batches:
            for part in slices(batch, most=4_000_000):
                part = part.take(pa.array(np.argsort(part.column(0).to_numpy(), kind="stable")))
                yield spread_runs(part.column(0).to_numpy(), *flat(part.column(1)), part.column(2).to_numpy(), k, m, either, hot, buckets, chosen)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                row, word, n, first, last, twofold = _counted(*flat(part.column(1)), k, either)
                at = np.flatnonzero(np.isin(word, hot))
                out = np.empty(len(at), _WORD)
                out["key"], out["n"], out["first"], out["last"] = word[at], n[at], first[at], last[at]
                out["seq"], out["flags"] = part.column(0).to_numpy()[row[at]], part.column(2).to_numpy()[row[at]] | (twofold[at] * _TWOFOLD)
                yield _rows(out)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in bucket_blobs(batches):
            words_ = counted_runs(blobs, k, either)
            order = np.argsort(words_["key"], kind="stable")
            words_ = words_[order]
            starts = np.flatnonzero(np.append(True, words_["key"][1:] != words_["key"][:-1]))
            sizes = np.diff(np.append(starts, len(words_)))
            yield _rows(words_[np.repeat(sizes > rare, sizes)])
            for met in _meetings(words_[np.repeat((sizes > 1) & (sizes <= rare) & (sizes <= limit if limit is not None else True), sizes)], symmetric):
                yield _bundled_pairs(met, to)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in bucket_blobs(batches):
            held = np.concatenate([np.frombuffer(x, _DEALT) for x in blobs])
            held = held[np.lexsort((held["block"], held["key"]))]
            change = np.any([held[c][1:] != held[c][:-1] for c in ("key", "block")], axis=0)
            for part in np.split(held, np.flatnonzero(change) + 1):
                for met in _block_meetings(part, symmetric):
                    yield _bundled_pairs(met, to)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in bucket_blobs(batches):
            yield from _added([unpacked(x) for x in blobs], None, config, symmetric)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i, first, last = (c.to_numpy() for c in batch.columns)
            yield _bundled_pairs((i, i, np.zeros(len(i), np.int64), first, last, np.zeros(len(i), np.int32)), to)

    def by_seq(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty(batch.num_rows, _BIG)
            for c in _BIG.names:
                out[c] = batch.column(batch.schema.get_field_index(c)).to_numpy()
            yield bundled(out, bucket_of(out["seq"], to).astype(np.int64))

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blobs in bucket_blobs(batches):
            held, starts = with_wide(np.concatenate([np.frombuffer(x, _BIG) for x in blobs]), config, symmetric)
            data = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer((starts * _BIG.itemsize).astype(np.int64).tobytes()), pa.py_buffer(held.tobytes())])
            low, high = np.minimum.reduceat(held["first"], starts[:-1]), np.maximum.reduceat(held["last"], starts[:-1])
            yield pa.RecordBatch.from_arrays([pa.array(held["seq"][starts[:-1]]), pa.array(low), pa.array(high), data.cast(pa.binary())], ["seq", "first", "last", "data"])

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = np.frombuffer(b"".join(batch.column(0).to_pylist()), _BIG)
            yield pa.RecordBatch.from_arrays([pa.array(held[c]) for c in _BIG.names], list(_BIG.names))

    def summed(pairs: DataFrame) -> list[tuple[DataFrame, str]]:
        own = lambda turn: pairs.where((F.col("bucket").cast("bigint") * passes / to).cast("int") == turn)
        return [durable.keep(shuffled(own(turn)).mapInArrow(add, SUMS)) for turn in range(passes)]

    durable = Durable(spark, "met")
    parts = [durable.keep(shuffled(rows.mapInArrow(lambda batches, turn=turn: spread(batches, turn), SCHEMA)).mapInArrow(meet, MET)) for turn in range(passes)]
    met = reduce(DataFrame.unionByName, [part for part, _ in parts])
    big = met.where("bucket is null").drop("bucket", "data")
    if len(hot):
        big = big.unionByName(rows.mapInArrow(raw, MET).drop("bucket", "data"))
    pairs = met.where("bucket is not null").select("bucket", "data")
    if big.isEmpty():
        durable.drop(rows_at)
        sums = reduce(DataFrame.unionByName, [x.select("i", "j", "shared", "span") for x, _ in summed(pairs)])
        for _, at in parts:
            durable.drop(at)
        return sums
    counts = big.groupBy("word").agg(F.count("*").alias("count"))
    if limit is not None:
        counts = counts.where(F.col("count") <= limit)
    lists, _ = durable.keep(shuffled(big.join(counts, "word").select(*_BIG.names).mapInArrow(by_seq, SCHEMA)).mapInArrow(listed, "seq bigint, first int, last int, data binary"))
    singles = lists.select("data").mapInArrow(single, BIG)
    met_words = singles.where(F.col("flags").bitwiseAND(_WIDE) > 0).select("word").distinct()
    dealt = shuffled(singles.join(met_words, "word", "left_semi").select(*_BIG.names).mapInArrow(lambda batches: _dealt(batches, buckets, block), SCHEMA))
    marks = lists.select("seq", "first", "last").mapInArrow(mark, MET).select("bucket", "data")
    parts.append(durable.keep(dealt.mapInArrow(blocks, MET).select("bucket", "data").unionByName(marks)))
    durable.drop(rows_at)
    sums = reduce(DataFrame.unionByName, [x for x, _ in summed(pairs.unionByName(parts[-1][0]))])
    for _, at in parts:
        durable.drop(at)
    opened = sums.where("opened").select("i", "j", "shared", "first", "last", F.col("short").cast("int").alias("short"))
    both = beside(opened, lists.select("seq", "data"), lambda groups: _with_lists(groups, config, symmetric), "i bigint, j bigint, shared bigint, span int", (size[0] or 0) * _BIG.itemsize * 4)
    return sums.where("not opened").select("i", "j", "shared", "span").unionByName(both)


#: A bundle of pairs, or with null bucket a row of a word of too many reads.
MET = "bucket int, data binary, word bigint, seq bigint, n int, first int, last int, flags int"
SUMS = "i bigint, j bigint, shared bigint, span int, first int, last int, short boolean, opened boolean"
BIG = "word bigint, seq bigint, count bigint, n int, first int, last int, flags int"
_BIG = np.dtype([("word", "i8"), ("seq", "i8"), ("count", "i8"), ("n", "i4"), ("first", "i4"), ("last", "i4"), ("flags", "i4")])
_DEALT = np.dtype([("key", "i8"), ("block", "i4"), ("seq", "i8"), ("n", "i4"), ("first", "i4"), ("last", "i4"), ("flags", "i4")])


def least_part(k: int, buckets: int) -> int:
    """Length of the parts whose least one settles a word's bucket: long enough that none of them fills a bucket."""
    m = min(k, 7)
    while m < k and 4**m < 8 * (k - m + 1) * buckets:
        m += 1
    return m


def spread_runs(seq: np.ndarray, codes: np.ndarray, offsets: np.ndarray, flags: np.ndarray, k: int, m: int, either: bool, hot: np.ndarray, buckets: int, chosen: np.ndarray | None = None) -> pa.RecordBatch:
    """(bucket, data): the words of reads without those in ``hot``, as runs of consecutive words whose least part of
    m bases, of either strand, is the same; a run has at most 31 bases. ``chosen`` tells which buckets are asked for, else all."""
    start, n, least = [], [], []
    reads = np.arange(len(offsets) - 1)
    for part in np.split(reads, np.flatnonzero(np.diff(offsets[:-1] // 100_000)) + 1) if len(reads) else []:  # what fits in a cache
        lo, hi = int(offsets[part[0]]), int(offsets[part[-1] + 1])
        for x, y in zip((start, n, least), _runs(codes[lo:hi], offsets[part[0] : part[-1] + 2] - lo, k, m, either, hot), strict=True):
            x.append(y + lo if x is start else y)
    if not sum(map(len, start)):
        return bundled_blobs([], [])
    start, n, least = (np.concatenate(x) for x in (start, n, least))
    row = np.searchsorted(offsets, start, side="right") - 1
    bucket = (mix(least) >> np.uint64(8)) % np.uint64(buckets)
    if chosen is not None and not chosen.all():
        keep = np.flatnonzero(chosen[bucket.astype(np.int64)])
        if not len(keep):
            return bundled_blobs([], [])
        bucket, start, n, row = bucket[keep], start[keep], n[keep], row[keep]
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    bucket, start, n, row = bucket[order], start[order], n[order], row[order]
    padded, bases = np.append(codes & 3, np.zeros(31, np.uint8)), np.zeros(len(start), np.uint64)
    for i in range(31):
        bases = (bases << np.uint64(2)) | padded[start + i]
    bases <<= np.uint64(2)
    seq, place, flags = seq[row], start - offsets[row], flags[row]
    octets, length = bases.astype(">u8").view(np.uint8).reshape(-1, 8), (n + k + 2) // 4
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket))
    blobs = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        size, held = length[lo:hi], octets[lo:hi]
        blobs.append(squeezed([np.diff(seq[lo:hi], prepend=0), place[lo:hi], n[lo:hi], flags[lo:hi]], b"".join(held[size > i, i].tobytes() for i in range(8))))
    return bundled_blobs(bucket[edges[:-1]], blobs)


def _runs(codes: np.ndarray, offsets: np.ndarray, k: int, m: int, either: bool, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, number of words, least part) of the runs of words of some reads, none of more than 32 - k words."""
    size = len(codes) - k + 1
    if size < 1:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    ok = np.ones(size, bool)
    across = (offsets[1:-1, None] - np.arange(1, k)).ravel()
    ok[across[(across >= 0) & (across < size)]] = False
    if (codes > 3).any():
        bad = np.append(0, np.cumsum(codes > 3))
        ok &= bad[k:] == bad[:-k]
    least, held = _part_names(codes, m), 1
    while held < k - m + 1:
        step = min(held, k - m + 1 - held)
        least, held = np.minimum(least[: len(least) - step], least[step:]), held + step
    if len(hot):
        word = packed(codes, k)
        ok &= ~np.isin(np.minimum(word, turned(codes, k)) if either else word, hot)
    change = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (ok[1:] != ok[:-1])]))
    n = np.diff(np.append(change, size))
    keep = ok[change]
    start, n = change[keep], n[keep]
    if len(n) and n.max() > 32 - k:
        pieces = -(-n // (32 - k))
        inside = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        start, n = np.repeat(start, pieces) + inside * (32 - k), np.minimum(np.repeat(n, pieces) - inside * (32 - k), 32 - k)
    return start, n, least[start]


def _part_names(codes: np.ndarray, m: int) -> np.ndarray:
    """Numbers that look random for the parts of m codes, the same for a part and its reverse complement."""
    if m > 9:
        return mix(np.minimum(packed(codes, m), turned(codes, m)))
    if m not in _NAMES:
        x = np.arange(4**m, dtype=np.int64)
        back = np.zeros_like(x)
        for i in range(m):
            back = back << 2 | 3 - (x >> 2 * i & 3)
        _NAMES[m] = np.argsort(np.argsort(mix(np.minimum(x, back)), kind="stable"), kind="stable").astype(np.int32)
        _NAMES[m] = np.minimum(_NAMES[m], _NAMES[m][back])
    codes, part = (codes & 3).astype(np.int32), np.zeros(len(codes) - m + 1, np.int32)
    for i in range(m):
        part = part << 2 | codes[i : i + len(part)]
    return _NAMES[m][part]


_NAMES: dict[int, np.ndarray] = {}


def counted_runs(blobs: list, k: int, either: bool) -> np.ndarray:
    """The words of runs, one row for each word and read, of those words that more than one read has."""
    parts = []
    for blob in blobs:
        (seq, place, n, flags), rest = unsqueezed(blob)
        octets, length, at = np.zeros((len(n), 8), np.uint8), (n + k + 2) // 4, 0
        for i in range(8):
            which = np.flatnonzero(length > i)
            octets[which, i] = np.frombuffer(rest, np.uint8, len(which), at)
            at += len(which)
        parts.append((np.cumsum(seq), place, n, flags, octets.view(">u8").ravel().astype(np.uint64)))
    seq, place, n, flags, bases = (np.concatenate(x) for x in zip(*parts, strict=True))
    # the words of a run one place after the other, in a pass for each place
    words_, runs, places, twofolds = [], [], [], []
    low = np.uint64(2 * k)
    for i in range(int(n.max()) if len(n) else 0):
        which = np.flatnonzero(n > i)
        word = (bases[which] << np.uint64(2 * i)) >> (np.uint64(64) - low)
        if either:
            other = _turned_words(word, k)
            twofolds.append(word == other)
            word = np.minimum(word, other)
        words_.append(word)
        runs.append(which)
        places.append(place[which] + i)
    if not words_:
        return np.empty(0, _WORD)
    word = np.concatenate(words_)
    # most words have a number that no other word of the bucket has; they are left out before words are sorted
    bits = max(16, int(len(word)).bit_length() + 2)
    name = ((word * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)
    seen = np.zeros(1 << bits, np.int32)
    seen[name] = np.arange(len(name), dtype=np.int32)
    again = np.zeros(1 << bits, bool)
    again[name[seen[name] != np.arange(len(name), dtype=np.int32)]] = True
    kept = np.flatnonzero(again[name])
    word, run, place = word[kept], np.concatenate(runs)[kept], np.concatenate(places)[kept]
    twofold = np.concatenate(twofolds)[kept] if either else np.zeros(len(word), bool)
    word = word.astype(np.int64)
    reads, own = np.unique(seq, return_inverse=True)
    own = own[run]
    bits = int(len(reads)).bit_length()
    order = np.argsort(word << bits | own) if 2 * k + bits < 63 else np.lexsort((own, word))
    word, own = word[order], own[order]
    if not len(word):
        return np.empty(0, _WORD)
    start = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
    several = own[start] != own[np.append(start[1:], len(word)) - 1]
    keep = np.repeat(several, np.diff(np.append(start, len(word))))
    word, own, order = word[keep], own[keep], order[keep]
    out = np.empty(0, _WORD)
    if len(word):
        start = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (own[1:] != own[:-1])))
        out = np.empty(len(start), _WORD)
        out["key"], out["seq"], out["n"] = word[start], reads[own[start]], np.diff(np.append(start, len(word)))
        out["first"], out["last"] = np.minimum.reduceat(place[order], start), np.maximum.reduceat(place[order], start)
        out["flags"] = flags[run[order[start]]] | (twofold[order[start]] * _TWOFOLD)
    return out


def _turned_words(word: np.ndarray, k: int) -> np.ndarray:
    x = (~word).byteswap()
    for shift, mask in ((4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333)):
        x = ((x >> np.uint64(shift)) & np.uint64(mask)) | ((x & np.uint64(mask)) << np.uint64(shift))
    return x >> np.uint64(64 - 2 * k)


def _rows(rows: np.ndarray) -> pa.RecordBatch:
    n = len(rows)
    cols = [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), *(pa.array(rows[c]) for c in ("key", "seq", "n", "first", "last", "flags"))]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "data", "word", "seq", "n", "first", "last", "flags"])


def with_wide(rows: np.ndarray, config: ClusterConfig, symmetric: bool) -> tuple[np.ndarray, np.ndarray]:
    """(rows by read, offsets of the reads with the end last), where the big words that a read meets others by are wide.

    A candidate of a read shares words with it whose outermost places are ``beta`` apart, so at least one of them lies
    not wholly inside a stretch that is shorter, whichever it is. Here it is the stretch whose words most reads have.
    """
    rows = rows[np.lexsort((rows["word"], rows["first"], rows["seq"]))].copy()
    starts = np.append(np.flatnonzero(np.append(True, rows["seq"][1:] != rows["seq"][:-1])), len(rows))
    sizes = np.diff(starts)
    read = np.repeat(np.arange(len(sizes)), sizes)
    short = (np.bitwise_or.reduceat(rows["flags"], starts[:-1]) & _SHORT) > 0
    need = np.where(short & (not symmetric), config.beta >> 2, config.beta)
    # stretches begin at each word; a word that ends behind one counts there although it isn't inside, which is no harm
    far = int(rows["first"].max()) + int(need.max()) + 2
    place = read * far + rows["first"]
    end = np.searchsorted(place, place + need[read])
    sums = np.append(0, np.cumsum(rows["count"]))
    held = sums[end] - sums[: len(rows)]
    most = np.lexsort((-held, read))[starts[:-1]]
    begin = rows["first"][most][read]
    inside = (rows["first"] >= begin) & (rows["last"] < begin + need[read])
    rows["flags"] = (rows["flags"] & ~_WIDE) | np.where(inside, 0, _WIDE)
    return rows, starts


def _with_lists(groups: Iterator[Group], config: ClusterConfig, symmetric: bool) -> Iterator[pa.RecordBatch]:
    """The candidates among pairs with what small words they share, when the big words of both are added."""
    for g in groups:
        own, theirs = np.frombuffer(g.one, _BIG), np.frombuffer(g.two, _BIG)
        one, two = g.one_offsets // _BIG.itemsize, g.two_offsets // _BIG.itemsize
        words_, number = np.unique(theirs["word"], return_inverse=True)
        key = np.repeat(np.arange(len(two) - 1), np.diff(two)) * len(words_) + number
        by_key = np.argsort(key)
        key = key[by_key]
        sizes = np.diff(one)[g.at_one]
        step = np.append(0, np.cumsum(sizes))
        lo = 0
        while lo < len(sizes):
            hi = max(lo + 1, int(np.searchsorted(step, step[lo] + 1_000_000, side="right")) - 1)
            pair = np.repeat(np.arange(lo, hi), sizes[lo:hi])
            entry = one[g.at_one[pair]] + np.arange(len(pair)) - (step[pair] - step[lo])
            word = own["word"][entry]
            at = np.minimum(np.searchsorted(words_, word), len(words_) - 1)
            asked = g.at_two[pair] * len(words_) + at
            found = np.minimum(np.searchsorted(key, asked), len(key) - 1) if len(key) else np.zeros(len(asked), np.int64)
            keep = (words_[at] == word) & (key[found] == asked) & (g.at_two[pair] >= 0) if len(key) else np.zeros(len(asked), bool)
            entry, met, pair = entry[keep], by_key[found[keep]], pair[keep] - lo
            shared, first, last, short = (x[lo:hi].copy() for x in g.numbers)
            np.add.at(shared, pair, own["n"][entry].astype(np.int64) * theirs["n"][met] * np.where(own["flags"][entry] & _TWOFOLD, 2, 1))
            np.minimum.at(first, pair, own["first"][entry])
            np.maximum.at(last, pair, own["last"][entry])
            keep = _enough(shared, last - first, short > 0, config, symmetric)
            cols = [g.i[g.at_one[lo:hi]], g.j[lo:hi], shared, (last - first).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in cols], ["i", "j", "shared", "span"])
            lo = hi


def _enough(shared: np.ndarray, span: np.ndarray, short: np.ndarray, config: ClusterConfig, symmetric: bool) -> np.ndarray:
    keep = (shared >= config.alpha) & (span >= config.beta)
    return keep if symmetric else (span >= config.beta >> 2) & (short | keep)


def _dealt(batches: Iterator[pa.RecordBatch], buckets: int, block: int) -> Iterator[pa.RecordBatch]:
    """Each row of a big word once, as a second read in a block of the word; rows that are wide also as first reads in all
    of them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        word, seq, count, n, first, last, flags = (c.to_numpy() for c in batch.columns)
        blocks = -(-count // block)
        wide, right = np.flatnonzero((flags & (_WIDE | _LEFT)) == _WIDE | _LEFT), np.flatnonzero(flags & _RIGHT)
        parts = [(right, (mix(seq[right] ^ word[right]) % blocks[right].astype(np.uint64)).astype(np.int64), flags[right] & ~(_WIDE | _LEFT))]
        lo, step = 0, np.append(0, np.cumsum(blocks[wide]))
        while lo < len(wide):
            hi = max(lo + 1, int(np.searchsorted(step, step[lo] + 1_000_000, side="right")) - 1)
            row = np.repeat(np.arange(lo, hi), blocks[wide[lo:hi]])
            parts.append((wide[row], np.arange(len(row)) - (step[row] - step[lo]), (flags[wide[row]] & ~_RIGHT)))
            lo = hi
        for at, of, flag in parts:
            out = np.empty(len(at), _DEALT)
            out["key"], out["block"], out["seq"], out["n"], out["first"], out["last"], out["flags"] = word[at], of, seq[at], n[at], first[at], last[at], flag
            if len(out):
                yield bundled(out, bucket_of(mix(out["key"]) + out["block"].astype(np.uint64), buckets).astype(np.int64))


def _block_meetings(rows: np.ndarray, symmetric: bool, most: int = 500_000) -> Iterator[tuple[np.ndarray, ...]]:
    """The pairs of the wide rows of one word and those of one of its blocks. They share nothing yet: big words are
    counted for all pairs at the end."""
    left, right = rows[(rows["flags"] & _WIDE) > 0], rows[(rows["flags"] & _RIGHT) > 0]
    step = max(1, most // max(1, len(right)))
    for at in range(0, len(left) if len(right) else 0, step):
        part = left[at : at + step]
        a, b = np.repeat(np.arange(len(part)), len(right)), np.tile(np.arange(len(right)), len(part))
        x, y = part["seq"][a], right["seq"][b]
        keep = x != y if symmetric else x < y
        a, x, y = a[keep], x[keep], y[keep]
        if len(a):
            yield x, y, np.zeros(len(a), np.int64), part["first"][a], part["last"][a], part["flags"][a] & _SHORT


def _bundled_pairs(met: tuple[np.ndarray, ...], buckets: int) -> pa.RecordBatch:
    """Sums of pairs of reads, those of the i of one bucket as one value."""
    i, j, shared, first, last, short = met
    bucket = bucket_of(i, buckets).astype(np.int64)
    order = np.lexsort((j, i, bucket))
    bucket, i, j = bucket[order], i[order], j[order]
    shared, first, last, short = shared[order], first[order], last[order], short[order]
    edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
    blobs = []
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        x, y = i[lo:hi], j[lo:hi]
        blobs.append(squeezed([np.diff(x, prepend=0), np.where(np.diff(x, prepend=x[0] - 1) == 0, np.diff(y, prepend=0), y), shared[lo:hi], first[lo:hi], last[lo:hi] - first[lo:hi], short[lo:hi]]))
    out = bundled_blobs(bucket[edges[:-1]], blobs)
    n = out.num_rows
    return pa.RecordBatch.from_arrays([*out.columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *[pa.nulls(n, pa.int32())] * 4], ["bucket", "data", "word", "seq", "n", "first", "last", "flags"])


def unpacked(blob) -> tuple[np.ndarray, ...]:
    """What ``_bundled_pairs`` packed."""
    (i, j, shared, first, span, short), _ = unsqueezed(blob)
    new = i != 0
    new[0] = True
    i = np.cumsum(i)
    total, start = np.cumsum(j), np.flatnonzero(new)
    j = total - np.repeat(total[start] - j[start], np.diff(np.append(start, len(j))))
    return i, j, shared, first, first + span, short


def _added(parts: list, which: bool | None, config: ClusterConfig, symmetric: bool) -> Iterator[pa.RecordBatch]:
    """The candidates of a bucket; of reads i that are marked by a pair with themselves the pairs that can become
    candidates by the places, first and last, of their marks, which are called opened. ``which`` asks for the opened pairs
    only or for the others only."""
    i, j, shared, first, last, short = (np.concatenate(x) for x in zip(*parts, strict=True))
    marked = i == j
    known, begin, end = i[marked], first[marked], last[marked]
    i, j, shared, first, last, short = (x[~marked] for x in (i, j, shared, first, last, short))
    if not len(i):
        return
    order = np.lexsort((j, i))
    i, j = i[order], j[order]
    start = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
    i, j, short = i[start], j[start], short[order[start]] > 0
    shared, first, last = np.add.reduceat(shared[order], start), np.minimum.reduceat(first[order], start), np.maximum.reduceat(last[order], start)
    span = last - first
    opened, keep = np.isin(i, known), _enough(shared, span, short, config, symmetric)
    if len(known):
        at = np.argsort(known)
        at = at[np.minimum(np.searchsorted(known[at], i), len(at) - 1)]
        reach = np.maximum(last, end[at]) - np.minimum(first, begin[at]) >= np.where(short & (not symmetric), config.beta >> 2, config.beta)
        keep = np.where(opened, reach, keep)
    if which is not None:
        keep = keep & (opened == which)
    cols = [x[keep] for x in (i, j, shared, span.astype(np.int32), first.astype(np.int32), last.astype(np.int32), short, opened)]
    for at in range(0, len(cols[0]), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in cols], ["i", "j", "shared", "span", "first", "last", "short", "opened"])


def _meetings(rows: np.ndarray, symmetric: bool, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, shared, first, last, short): what each two reads of a bucket share, added up over about ``most`` meetings
    at a time. ``rows`` are ordered by word and then by read."""
    if not len(rows):
        return
    seqs, own = np.unique(rows["seq"], return_inverse=True)
    starts = np.flatnonzero(np.append(True, rows["key"][1:] != rows["key"][:-1]))
    sizes = np.diff(np.append(starts, len(rows)))
    after = np.repeat(starts + sizes, sizes) - np.arange(len(rows)) - 1  # rows of the word that follow
    done = np.append(0, np.cumsum(after))
    weight = rows["n"].astype(np.int64) * np.where(rows["flags"] & _TWOFOLD, 2, 1)
    at = 0
    while at < len(rows) and done[at] < done[-1]:
        to = max(at + 1, int(np.searchsorted(done, done[at] + most, side="right")) - 1)
        a = np.repeat(np.arange(at, to), after[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(done[at:to] - done[at], after[at:to])
        if symmetric:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        keep = ((rows["flags"][a] & _LEFT) > 0) & ((rows["flags"][b] & _RIGHT) > 0) & (own[a] != own[b])
        a, b = a[keep], b[keep]
        at = to
        if not len(a):
            continue
        pair = own[a] * len(seqs) + own[b]
        order = np.argsort(pair)
        a, b, pair = a[order], b[order], pair[order]
        first = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        yield seqs[own[a[first]]], seqs[own[b[first]]], np.add.reduceat(weight[a] * rows["n"][b], first), np.minimum.reduceat(rows["first"][a], first), np.maximum.reduceat(rows["last"][a], first), rows["flags"][a[first]] & _SHORT


#: Reads and bytes of a block of the all-pairs search.
BLOCK_READS, BLOCK_BYTES = 25_000, 20_000_000
HITS = "i bigint, j bigint, strand int, hits bigint"
_UPPER, _TURNED = np.full(256, 255, np.uint8), np.arange(256, dtype=np.uint8)
for _i, (_b, _c) in enumerate(zip("ACGT", "TGCA", strict=True)):
    _UPPER[ord(_b)], _TURNED[ord(_b)], _TURNED[ord(_b.lower())] = _i, ord(_c), ord(_c.lower())


def sample_hits(reads: DataFrame, config: ClusterConfig, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """(i, j, strand, hits) of pairs i < j with more than ``sample_thresh`` sample words of j among the words of 8
    bases of i (strand 1) or of its reverse complement (-1); i is at least a window long, j of any length.

    This is the all-pairs search: it finds exactly the pairs that the sample filter lets through. Reads are packed in
    blocks by seq_id, and each two blocks meet in a task of their own, where what pairs share is counted; only pairs that
    are let through leave it. ``reads`` has one row per seq_id; a character outside ASCII is taken for a question mark.
    """
    return _met_blocks(reads, left, right, lambda one, two: _counted_hits(one, two, config, _strands(config)), HITS)


def filtered_pairs(reads: DataFrame, config: ClusterConfig, left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """(i, j): the pairs of ``sample_hits`` without those of which windowed hits show that no strand passes the filters of
    ``scored_pairs``. Of reads with other characters than A, C, G, T all pairs stay."""
    return _met_blocks(reads, left, right, lambda one, two: _passing_pairs(one, two, config, _strands(config)), "i bigint, j bigint")


def _strands(config: ClusterConfig) -> tuple[int, ...]:
    return (1, -1) if config.rc_check else (1,)


def _met_blocks(reads: DataFrame, left: DataFrame | None, right: DataFrame | None, work: Callable[[tuple, _Samples], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """What ``work`` makes of each two blocks of reads, the first of which has reads before some of the second."""
    spark = reads.sparkSession
    side = lambda ids, bit: F.lit(bit) if ids is None else F.coalesce(f"side{bit}", F.lit(0))
    rows = reads.where("seq_id is not null and bases is not null").select(F.col("seq_id").cast("bigint").alias("seq_id"), F.encode(F.regexp_replace("bases", r"[^\x00-\x7F]", "?"), "UTF-8").alias("bases"))
    for bit, ids in ((_LEFT, left), (_RIGHT, right)):
        if ids is not None:
            rows = rows.join(ids.select("seq_id").distinct().withColumn(f"side{bit}", F.lit(bit)), "seq_id", "left")
    durable = Durable(spark, "blocks")
    rows, rows_at = durable.keep(rows.select("seq_id", "bases", (side(left, _LEFT) + side(right, _RIGHT)).alias("flags")).where("flags > 0"))
    count, size = rows.agg(F.count("*"), F.sum(F.length("bases"))).first()
    n = max(math.ceil(count / BLOCK_READS), math.ceil((size or 0) / BLOCK_BYTES), math.ceil(math.sqrt(2 * partitions(spark))))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.column(1).nbytes
            if size > 2 * BLOCK_BYTES:
                yield _block(held)
                held, size = [], 0
        if held:
            yield _block(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs, sides = [None, None], [None, None]
        for batch in batches:
            for two in zip(batch.column(0), batch.column(1), strict=True):
                for k, made in ((0, _owners), (1, _Samples)):
                    blob = two[k].as_py()
                    if blob != blobs[k]:
                        blobs[k], sides[k] = blob, made(*_unpacked_block(blob))
                yield from work(*sides)

    packed_ = rows.repartitionByRange(n, "seq_id").sortWithinPartitions("seq_id").mapInArrow(pack, "first bigint, last bigint, data binary").withColumn("block", F.spark_partition_id())
    packed_, _ = durable.keep(packed_)
    durable.drop(rows_at)
    one, two = (packed_.repartitionById(n, "block").select(*(F.col(c).alias(f"{c}{k}") for c in ("first", "last", "data"))) for k in (1, 2))
    return one.hint("shuffle_replicate_nl").join(two, F.col("first1") < F.col("last2")).select("data1", "data2").mapInArrow(meet, schema)


def _block(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Reads in order as one row: their least and largest seq_id, and numbers, lengths, flags and bases packed."""
    seq, flags = (np.concatenate([b.column(k).to_numpy() for b in batches]) for k in (0, 2))
    data = pa.concat_arrays([b.column(1).cast(pa.large_binary()) for b in batches])
    offsets = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, data.offset * 8)
    raw = bytes(memoryview(data.buffers()[2] or b"")[offsets[0] : offsets[-1]])
    blob = squeezed([np.diff(seq, prepend=0), np.diff(offsets), flags.astype(np.int64)], np.int64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True))
    return pa.RecordBatch.from_arrays([pa.array(seq[:1]), pa.array(seq[-1:]), pa.array([blob], pa.binary())], ["first", "last", "data"])


def _unpacked_block(blob: bytes) -> tuple[np.ndarray, ...]:
    """(seq_ids, offsets, flags, bytes) of ``_block``."""
    (seq, length, flags), rest = unsqueezed(blob)
    raw = pa.decompress(rest[8:], int(np.frombuffer(rest, np.int64, 1)[0]), codec="zstd", asbytes=True)
    return np.cumsum(seq), np.append(0, np.cumsum(length)), flags, np.frombuffer(raw, np.uint8)


def _owners(seq: np.ndarray, offsets: np.ndarray, flags: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, ...]:
    """The block, which of its characters are A, C, G or T, and the words of 8 bases from each place as base-4 numbers."""
    codes = _UPPER[raw]
    two = (codes[:-1].astype(np.uint16) & 3) << 2 | codes[1:] & 3
    four = two[:-2] << 4 | two[2:]
    return seq, offsets, flags, raw, codes <= 3, four[:-4] << 8 | four[4:]


def _eights(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of 8 bases at these places as base-4 numbers, which have other characters, these words as they are)"""
    codes = _UPPER[raw]
    number, other = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
    for k in range(8):
        c = codes[at + k]
        number = number << 2 | c & 3
        other |= c > 3
    return number, other, np.lib.stride_tricks.sliding_window_view(raw, 8)[at[other]].copy().view(np.int64).ravel() if other.any() else np.zeros(0, np.int64)


class _Samples:
    """Which reads of a block have each word as a sample, as often as they have it."""

    def __init__(self, seq: np.ndarray, offsets: np.ndarray, flags: np.ndarray, raw: np.ndarray):
        length = np.where(flags & _RIGHT, np.diff(offsets), 0)
        n = np.maximum(0, length // 8 - 2)
        row = np.repeat(np.arange(len(seq)), n)
        at = offsets[row] + 8 * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + 1)
        number, other, words_ = _eights(raw, at)
        self.block, self.seq, self.others = (seq, offsets, flags, raw), seq, np.unique(words_)
        number[other] = (1 << 16) + np.searchsorted(self.others, words_)
        order = np.argsort(number, kind="stable")
        self.row = row[order]
        self.starts = np.append(0, np.cumsum(np.bincount(number, minlength=(1 << 16) + len(self.others))))

    def hits(self, words_: np.ndarray) -> np.ndarray:
        """How many samples of each read are among these distinct words."""
        start = self.starts[words_]
        n = self.starts[words_ + 1] - start
        before = np.cumsum(n)
        at = np.repeat(start - before + n, n)
        at += np.arange(len(at))
        return np.bincount(self.row[at], minlength=len(self.seq))

    def known(self, raw: np.ndarray) -> np.ndarray:
        """The distinct words of 8 characters of a string that a sample can have."""
        number, other, words_ = _eights(raw, np.arange(len(raw) - 7))
        if len(words_) and len(self.others):
            at = np.minimum(np.searchsorted(self.others, words_), len(self.others) - 1)
            return np.unique(np.concatenate([number[~other], (1 << 16) + at[self.others[at] == words_]]))
        return np.unique(number[~other])


def _turned_eights() -> np.ndarray:
    """The numbers of the reverse complements of all words of 8 bases."""
    x = np.arange(1 << 16, dtype=np.int64)
    return sum((3 - (x >> 2 * k & 3)) << 2 * (7 - k) for k in range(8))


def _found(block: tuple[np.ndarray, ...], samples: _Samples, config: ClusterConfig, strands: tuple[int, ...]) -> Iterator[tuple[int, int, list[tuple[int, np.ndarray, np.ndarray]]]]:
    """(place of i in the block, place of the first later read in the other, for each strand (strand, words, samples
    shared with each read of the other from that place)) of the reads of a block that have later ones in another."""
    seq, offsets, flags, raw, plain, words_ = block
    turned_ = _turned_eights()
    for x in np.flatnonzero((flags & _LEFT > 0) & (np.diff(offsets) >= max(8, config.window_len)) & (seq < samples.seq[-1])).tolist():
        lo, hi = offsets[x], offsets[x + 1]
        all_plain = bool(plain[lo:hi].all())
        if all_plain:
            own = np.sort(words_[lo : hi - 7])
            own = own[np.append(True, own[1:] != own[:-1])].astype(np.int64)
        else:
            own = samples.known(raw[lo:hi])
        after, sides = int(np.searchsorted(samples.seq, seq[x], side="right")), []
        for strand in strands:
            if strand < 0:
                own = turned_[own] if all_plain else samples.known(_TURNED[raw[lo:hi]][::-1])
            sides.append((strand, own, samples.hits(own)[after:]))
        yield x, after, sides


def _counted_hits(block: tuple[np.ndarray, ...], samples: _Samples, config: ClusterConfig, strands: tuple[int, ...], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """The pairs of a read of one block and a later one of another that the sample filter lets through."""
    found, n, least = [], 0, max(config.sample_thresh, 0)

    def rows() -> pa.RecordBatch:
        i, strand, j, hits = (np.concatenate(c) for c in zip(*found, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(strand.astype(np.int32)), pa.array(hits.astype(np.int64))], ["i", "j", "strand", "hits"])

    for x, after, sides in _found(block, samples, config, strands):
        for strand, _, hits in sides:
            j = np.flatnonzero(hits > least)
            if len(j):
                found.append((np.full(len(j), block[0][x]), np.full(len(j), strand), samples.seq[j + after], hits[j]))
                n += len(j)
        if n > most:
            yield rows()
            found, n = [], 0
    if n:
        yield rows()


def _passing_pairs(block: tuple[np.ndarray, ...], samples: _Samples, config: ClusterConfig, strands: tuple[int, ...], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Those pairs of ``_counted_hits`` of which a strand can pass the filters; windows are those of ``word_hits``."""
    seq, offsets, _, _, plain, _ = block
    _, starts, _, _, their_plain, their_words = _owners(*samples.block)
    lengths, bad = np.diff(starts), np.append(0, np.cumsum(~their_plain))
    other = bad[starts[1:]] > bad[starts[:-1]]
    # as distance.thresholds: i is at least a window long
    common = config.common_word - (config.window_len - np.minimum(config.window_len, lengths))
    least = config.sample_thresh - np.where(lengths < 100, (116 - lengths) >> 4, 0)
    width, flags, found, n = config.window_len + 7, np.zeros(1 << 16, bool), [], 0

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["i", "j"])

    for x, after, sides in _found(block, samples, config, strands):
        chosen = np.zeros(len(lengths) - after, bool)
        for _, _, hits in sides:
            chosen |= hits > max(config.sample_thresh, 0)
        j = np.flatnonzero(chosen)
        if not len(j):
            continue
        at = j + after
        passing = other[at] | (not plain[offsets[x] : offsets[x + 1]].all())
        if not passing.all():
            for _, own, hits in sides:
                asked = np.flatnonzero(~passing & (hits[j] > least[at]))
                own = own[own < 1 << 16]
                flags[own] = True
                passing[asked] = _windows_reach(flags, their_words, starts[at[asked]], lengths[at[asked]] - 7, common[at[asked]], width)
                flags[own] = False
        j = at[passing]
        if len(j):
            found.append((np.full(len(j), seq[x]), samples.seq[j]))
            n += len(j)
        if n > most:
            yield rows()
            found, n = [], 0
    if n:
        yield rows()


def _windows_reach(flags: np.ndarray, words_: np.ndarray, start: np.ndarray, n: np.ndarray, least: np.ndarray, width: int) -> np.ndarray:
    """Which stretches of n words from start have at least so many flagged ones in some window of ``width`` words."""
    n = np.maximum(n, 0)
    end = np.cumsum(n)
    at = np.repeat(start - end + n, n)
    at += np.arange(len(at))
    total = np.append(0, np.cumsum(flags[words_[at]], dtype=np.int32))
    reach = total[end] - total[end - n] >= least
    for k in np.flatnonzero(reach & (n > width)).tolist():
        own = total[end[k] - n[k] : end[k] + 1]
        reach[k] = (own[width:] - own[:-width]).max() >= least[k]
    return reach


def ranged(pairs: DataFrame, low: int, high: int) -> DataFrame:
    """Those pairs whose i is at least ``low`` and below ``high``; j is any later read."""
    return pairs.where((F.col("i") >= low) & (F.col("i") < high))


def stepped(pairs: DataFrame, step: int = 17) -> DataFrame:
    """Every ``step``-th partner of each read, beginning with the next one."""
    return pairs.where(F.pmod(F.col("j") - F.col("i") - 1, F.lit(step)) == 0)
