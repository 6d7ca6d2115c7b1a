"""Pairs of reads with what belongs to each read, without a copy of it for each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import bucket_number, bucket_of, partitions, squeezed, unsqueezed

#: Bytes of what belongs to the reads of a bucket, on average.
BYTES = 24_000_000
_ROWS = "bucket int, kind int, data binary"


@dataclass
class Group:
    """Pairs k of i[at_one[k]] and j[k]. ``one`` has the bytes of the first reads, from one_offsets[x] to
    one_offsets[x + 1] those of i[x]; ``two`` those of the second, where at_two[k] is j's number or -1 if it has none.
    ``numbers`` are the pairs' other columns."""

    i: np.ndarray
    at_one: np.ndarray
    one: bytes
    one_offsets: np.ndarray
    j: np.ndarray
    at_two: np.ndarray
    two: bytes
    two_offsets: np.ndarray
    numbers: list[np.ndarray]


def _blob(columns: list[np.ndarray], rest: bytes) -> bytes:
    return squeezed(columns, np.int64(len(rest)).tobytes() + (pa.compress(rest, codec="zstd", asbytes=True) if rest else b""))


def _unblob(blob) -> tuple[list[np.ndarray], bytes]:
    columns, rest = unsqueezed(blob)
    size = int(np.frombuffer(rest, np.int64, 1)[0])
    return columns, pa.decompress(rest[8:], size, codec="zstd", asbytes=True) if size else b""


def _batch(bucket: list[int], kind: int, blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "kind", "data"])


def _edges(bucket: np.ndarray) -> np.ndarray:
    return np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _chosen(data: np.ndarray, offsets: np.ndarray, which: np.ndarray) -> bytes:
    raw = memoryview(data)
    return b"".join(raw[offsets[x] : offsets[x + 1]] for x in which.tolist())


def beside(pairs: DataFrame, rows: DataFrame, work: Callable[[Iterator[Group]], Iterator[pa.RecordBatch]], schema: str, size: int) -> DataFrame:
    """What ``work`` makes of the pairs (i, j, further numbers) and ``rows`` (seq, data binary; one for each read, some
    ``size`` bytes in all). Pairs whose i has no row are left out.

    Pairs meet the rows of their i in buckets of i and go from there to buckets of j, where an i's data stands once for
    all pairs of that bucket. So a read of many pairs is copied once a bucket at most, and its pairs are many tasks.
    """
    n = bucket_number(pairs.sparkSession, size, BYTES)

    def side(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                seq = batch.column(0).to_numpy()
                data, offsets = _bytes_of(batch.column(1))
                bucket = bucket_of(seq, n).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = _edges(bucket[order])
                held = [order[lo:hi] for lo, hi in zip(edges[:-1], edges[1:], strict=True)]
                yield _batch(bucket[order][edges[:-1]].tolist(), 0, [_blob([seq[x], np.diff(offsets)[x]], _chosen(data, offsets, x)) for x in held])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                columns = [c.to_numpy() for c in batch.columns]
                bucket = bucket_of(columns[0], n).astype(np.int64)
                order = np.lexsort((columns[1], columns[0], bucket))
                edges = _edges(bucket[order])
                yield _batch(bucket[order][edges[:-1]].tolist(), 1, [_blob([c[order[lo:hi]] for c in columns], b"") for lo, hi in zip(edges[:-1], edges[1:], strict=True)])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, memoryview]]:
        """((reads in order, their numbers, offsets, bytes) of a bucket, one of its values of pairs)"""
        now, parts, known = None, [], None
        for batch in batches:
            for bucket, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if bucket != now:
                    now, parts, known = bucket, [], None
                if kind == 0:
                    parts.append(_unblob(data.as_buffer()))
                    continue
                if known is None:
                    seq, lengths = (np.concatenate([np.zeros(0, np.int64), *(c[k] for c, _ in parts)]) for k in (0, 1))
                    order = np.argsort(seq)
                    known, parts = (seq[order], order, np.append(0, np.cumsum(lengths)), b"".join(r for _, r in parts)), []
                yield known, memoryview(data.as_buffer())

    def number(known: tuple, seq: np.ndarray) -> np.ndarray:
        reads, order = known[:2]
        if not len(reads):
            return np.full(len(seq), -1)
        at = np.minimum(np.searchsorted(reads, seq), len(reads) - 1)
        return np.where(reads[at] == seq, order[at], -1)

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, of = [], None
        for known, data in stream(batches):
            columns = _unblob(data)[0]
            if held and (known is not of or sum(len(c[0]) for c in held) > 500_000):
                yield attached(of, held)
                held = []
            held.append(columns)
            of = known
        if held:
            yield attached(of, held)

    def attached(known: tuple, held: list) -> pa.RecordBatch:
        i, j, *rest = (np.concatenate(x) for x in zip(*held, strict=True))
        at = number(known, i)
        bucket = bucket_of(j, n).astype(np.int64)
        order = np.lexsort((j, i, bucket))
        order = order[at[order] >= 0]
        edges, out = _edges(bucket[order]), []
        data = np.frombuffer(known[3], np.uint8)
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            part = order[lo:hi]
            first = _edges(i[part])
            which = at[part[first[:-1]]]
            pair = _blob([c[part] for c in (j, *rest)], b"")
            one = _blob([i[part[first[:-1]]], np.diff(first), np.diff(known[2])[which]], _chosen(data, known[2], which))
            out.append(np.int64(len(pair)).tobytes() + pair + one)
        return _batch(bucket[order][edges[:-1]].tolist(), 1, out)

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[Group]:
        for known, data in stream(batches):
            size = 8 + int(np.frombuffer(data, np.int64, 1)[0])
            (j, *rest), _ = _unblob(data[8:size])
            (i, count, lengths), one = _unblob(data[size:])
            yield Group(i, np.repeat(np.arange(len(i)), count), one, np.append(0, np.cumsum(lengths)), j, number(known, j), known[3], known[2], rest)

    parts = partitions(pairs.sparkSession)
    placed = lambda df: df.repartitionById(parts, F.col("bucket") % parts).sortWithinPartitions("bucket", "kind")
    sides = rows.mapInArrow(side, _ROWS)
    ones = placed(sides.unionByName(pairs.mapInArrow(packed, _ROWS))).mapInArrow(attach, _ROWS)
    return placed(sides.unionByName(ones)).mapInArrow(lambda batches: work(groups(batches)), schema)
