"""Base strings of an Arrow batch as flat arrays, for the stages that work on whole batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CODE = np.full(256, 255, np.uint8)
for _i, _c in enumerate("ACGT"):
    CODE[ord(_c)] = CODE[ord(_c.lower())] = _i


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(codes of all characters, start offsets with the end last) of a string column without nulls.

    A character that isn't A, C, G or T in either case has code 255; one outside ASCII counts as several of these.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8, offsets[-1] - offsets[0], offsets[0]) if data and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return CODE[raw], offsets - offsets[0]


def windows_ok(codes: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, row) of each window of k characters A, C, G, T that lies inside one row."""
    n = len(codes)
    if n < k:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bad = np.zeros(n + 1, np.int64)
    np.cumsum(codes > 3, out=bad[1:])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    ok = (bad[k:] - bad[:-k] == 0) & (row[: n - k + 1] == row[k - 1 :])
    at = np.flatnonzero(ok)
    return at, row[at]


def packed(codes: np.ndarray, k: int) -> np.ndarray:
    """The k <= 31 codes from each position as a base-4 number; other codes give numbers without meaning."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    power, done, at, part = codes.astype(np.int64) & 3, None, 0, 1
    while True:
        if k & part:
            piece = power[at : at + n]
            # pieces are taken from the smallest up, each following the ones before
            done = piece.copy() if done is None else (done << (2 * part)) | piece
            at += part
        part *= 2
        if part > k:
            return done
        m = len(power) - part // 2
        power = (power[:m] << part) | power[part // 2 : part // 2 + m]


def turned(codes: np.ndarray, k: int) -> np.ndarray:
    """The reverse complement of the k codes from each position, as ``packed`` gives them."""
    return packed((3 - (codes & 3))[::-1], k)[::-1]


def slices(batch: pa.RecordBatch, column: int = 1, most: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most so many characters in a column each, or one row."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    at, held = 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            yield batch.slice(at, i - at)
            at, held = i, 0
        held += int(n)
    yield batch.slice(at)
