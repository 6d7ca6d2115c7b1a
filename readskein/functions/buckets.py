"""Shuffling rows in packed form.

Rows that Arrow stages make and take are of fixed size and many; as Spark rows each of them would be written, shuffled,
sorted and read one by one. Here the rows of a batch that go to the same bucket travel as one binary value, and a bucket
is handed over as one numpy array. Buckets are as many as the number of rows asks for, so that one fits in a worker.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a bucket is to hold; of keys with more than a bucket's rows ``frequent_keys`` tells, so that they can be split.
ROWS = 1_000_000
SCHEMA = "bucket int, data binary"
#: Rows of the sample that frequent keys are found in.
SAMPLE = 20_000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: a bijection of 64-bit numbers that looks random."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> _S30
        x *= _M1
        x ^= x >> _S27
        x *= _M2
        x ^= x >> _S31
    return x


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucket_number(spark: SparkSession, rows: int, each: int = ROWS) -> int:
    """Buckets for so many rows: a multiple of the shuffle partitions, none over ``each`` rows on average."""
    n = partitions(spark)
    return n * max(1, math.ceil(rows / each / n))


def bucket_of(key: np.ndarray, n: int) -> np.ndarray:
    return (mix(key) >> np.uint64(8)).astype(np.uint64) % np.uint64(n)


def bundled(rows: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """(bucket, data): the rows of each bucket as one value."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    offsets = (np.append(starts, len(bucket)) * rows.dtype.itemsize).astype(np.int64)
    data = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows[order].tobytes())])
    return pa.RecordBatch.from_arrays([pa.array(bucket[starts].astype(np.int32)), data.cast(pa.binary())], ["bucket", "data"])


def shuffled(df: DataFrame) -> DataFrame:
    """The bundles of each bucket behind one another in one partition, every partition with as many buckets."""
    n = partitions(df.sparkSession)
    return df.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket")


def whole_buckets(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, its rows) of batches that come as ``shuffled`` leaves them."""
    now, parts = None, []
    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != now and parts:
                yield now, np.concatenate(parts)
                parts = []
            now = b
            parts.append(np.frombuffer(data.as_buffer(), dtype))
    if parts:
        yield now, np.concatenate(parts)


def bucket_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list]]:
    """(bucket, its values as they are) of batches that come as ``shuffled`` leaves them."""
    now, parts = None, []
    for batch in batches:
        for b, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if b != now and parts:
                yield now, parts
                parts = []
            now = b
            parts.append(data.as_buffer())
    if parts:
        yield now, parts


def bundled_blobs(bucket, blobs: list[bytes]) -> pa.RecordBatch:
    """(bucket, data) of values that are packed already."""
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(bucket).astype(np.int32), pa.int32()), pa.array(blobs, pa.binary())], ["bucket", "data"])


def squeezed(columns: list[np.ndarray], rest: bytes = b"") -> bytes:
    """Whole numbers as planes of their octets that aren't all 0, compressed; ``rest`` follows as it is."""
    planes, used = [], []
    for c in columns:
        c = c.astype(np.int64)
        c = (c << 1) ^ (c >> 63)
        used.append((int(np.bitwise_or.reduce(c.view(np.uint64))).bit_length() + 7) // 8 if len(c) else 0)
        planes.append(np.ascontiguousarray(c.astype("<i8").view(np.uint8).reshape(-1, 8)[:, : used[-1]].T).tobytes())
    data = b"".join(planes)
    packed = pa.compress(data, codec="zstd", asbytes=True)
    return np.array([len(columns[0]), len(data), len(packed), len(used), *used], "<i4").tobytes() + packed + rest


def unsqueezed(blob) -> tuple[list[np.ndarray], memoryview]:
    """The columns and the rest of ``squeezed``."""
    blob = memoryview(blob)
    n, size, packed, columns = np.frombuffer(blob, "<i4", 4).tolist()
    used = np.frombuffer(blob, "<i4", columns, 16).tolist()
    at = 16 + 4 * columns
    data, out, done = np.frombuffer(pa.decompress(blob[at : at + packed], size, codec="zstd"), np.uint8), [], 0
    for u in used:
        c = np.zeros((n, 8), np.uint8)
        c[:, :u] = data[done : done + u * n].reshape(u, n).T
        done += u * n
        c = c.view("<u8").ravel()
        out.append((c >> np.uint64(1)).astype(np.int64) ^ -(c & np.uint64(1)).astype(np.int64))
    return out, blob[at + packed :]


def frequent_keys(df: DataFrame, n_rows: int, keys: Callable[[pa.RecordBatch], np.ndarray], buckets: int) -> dict[int, int]:
    """{key: number of parts} of the keys that would fill more than half a bucket, judged by a random sample of about
    ``SAMPLE`` of the ``n_rows`` rows of ``df``. They are at most two for each bucket, and the sample settles only where
    rows are sent. ``keys`` gives the keys of a batch."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k, n = np.unique(keys(batch), return_counts=True)
                total, some = n.sum(), n > n.sum() / buckets / 16  # others are far from frequent in this batch
                k, n = k[some], n[some]
                yield pa.RecordBatch.from_arrays([pa.array([None, *k.astype(np.int64).tolist()], pa.int64()), pa.array([int(total), *n.tolist()], pa.int64())], ["key", "n"])

    # the row without key holds the sum over all
    counts = df.sample(False, min(1.0, SAMPLE / max(1, n_rows)), 1).mapInArrow(count, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
    top = {r.key: r.n for r in counts.orderBy(F.col("key").isNull().desc(), F.col("n").desc()).limit(2 * buckets + 1).collect()}
    total = top.pop(None, 0)
    least = max(total / buckets / 2, 20)
    return {k: max(2, math.ceil(2 * n * buckets / total)) for k, n in top.items() if n > least}
