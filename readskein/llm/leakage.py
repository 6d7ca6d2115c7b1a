"""Evaluation texts leaking into training text.

Windows of a fixed number of words are taken from the items and from every place of every document. Random walks (CGK)
embed each window into a longer sequence such that few edits become few unequal places; a repetition hashes a random
sample of the places of a walk, and windows with the same hash meet. As many repetitions are made as the target recall
asks for. What met is verified by its exact edit distance in words, unless it lacks too many of the item's words.

Words that no item holds are one and the same symbol: this leaves every distance to an item as it is. A window with
more of them than edits allowed can't match, and is not embedded.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.buckets import mix
from ..session import Durable
from .tex import words

#: Items are held by the executors in blocks of about so many characters.
BLOCK_CHARS = 8_000_000
#: Places of a walk that a repetition hashes, and repetitions that use the same walk.
SAMPLE, EACH = 10, 4
#: Windows that are embedded at a time.
CHUNK = 32_768


@lru_cache
def repetitions(size: int, edits: int, recall: float, trials: int = 1000) -> int:
    """Repetitions that find a window with so many edits with probability ``recall``.

    Windows without edit always meet, so one is enough. Else it is measured on ``trials`` random windows and their
    copies with that many random edits: repetitions are added until the share found reaches the target.
    """
    if not edits:
        return 1
    draw = random.Random(17)
    plain, changed = [], []
    for _ in range(trials):
        w = [draw.randrange(1, 1 << 30) for _ in range(size)]
        plain.append(w)
        for _ in range(edits):
            at = draw.randrange(len(w))
            w = draw.choice((w[:at] + w[at + 1 :], w[:at] + [draw.randrange(1 << 30)] + w[at + 1 :], w[:at] + [draw.randrange(1 << 30)] + w[at:]))
        changed.append((w + [0] * edits * 2)[:size])
    starts = np.arange(trials) * size
    one, two = np.array(plain).ravel(), np.array(changed).ravel()
    found = np.zeros(trials, bool)
    for r, (x, y) in enumerate(zip(keys(one, starts, size, 1000), keys(two, starts, size, 1000), strict=True)):
        found |= x == y
        if found.mean() >= recall:
            return r + 1
    raise ValueError(f"{edits} edits in {size} words can't be found with recall {recall}")


def walk(symbols: np.ndarray, starts: np.ndarray, size: int, number: int) -> np.ndarray:
    """The embedded window of ``size`` symbols at each start, one row a step: in each step the symbol where the walk
    stands is written, and its coin for that step tells whether the walk goes on to the next."""
    salt = np.uint64(random.Random(1000 + number).getrandbits(62) | 1)
    coin = mix(symbols.astype(np.uint64) + salt)  # bit t of it is the symbol's coin in step t
    place, end, top = starts.astype(np.int64), starts + size, len(symbols) - 1
    out = np.empty((3 * size, len(starts)), np.uint64)
    for t in range(3 * size):
        inside = place < end
        c = coin[np.minimum(place, top)]
        out[t] = np.where(inside, c, np.uint64(0x1234567))
        place = place + (inside & ((c >> np.uint64(t % 64)) & np.uint64(1)).astype(bool))
    return out


def keys(symbols: np.ndarray, starts: np.ndarray, size: int, n: int, sample: int = SAMPLE, each: int = EACH) -> Iterator[np.ndarray]:
    """The hashes of the windows in each of ``n`` repetitions."""
    for r in range(n):
        if r % each == 0:
            steps = walk(symbols, starts, size, r // each)
        draw = random.Random(r)
        key = np.zeros(len(starts), np.uint64)
        with np.errstate(over="ignore"):
            for t in draw.sample(range(len(steps)), min(sample, len(steps))):
                key += steps[t] * np.uint64(draw.getrandbits(63) | 1)
        yield mix(key)


def edit_distance(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Least edit distance of each row of symbols on the left to any beginning of that row on the right."""
    n, size = left.shape
    row = np.tile(np.arange(right.shape[1] + 1), (n, 1))
    for i in range(size):
        before = row
        row = np.empty_like(before)
        row[:, 0] = i + 1
        for j in range(right.shape[1]):
            row[:, j + 1] = np.minimum(np.minimum(before[:, j + 1], row[:, j]) + 1, before[:, j] + (left[:, i] != right[:, j]))
    return row.min(1)


class ItemIndex:
    """The windows of a block of items, hashed once for each repetition."""

    def __init__(self, items: list[tuple[int, str]], size: int, edits: int, recall: float):
        self.size, self.edits = size, edits
        self.vocabulary: dict[str, int] = {}
        flat: list[int] = []
        starts: list[int] = []
        owner: list[int] = []
        for item, text in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            starts += range(len(flat), len(flat) + len(own) - size + 1)
            owner += [item] * max(0, len(own) - size + 1)
            flat += own
        self.symbols, self.starts, self.owner = np.array(flat + [0], np.int64), np.array(starts, np.int64), np.array(owner, np.int64)
        self.n = repetitions(size, edits, recall)
        self.bits = max(12, min(24, 4 + len(starts).bit_length()))
        self.tables = []
        for key in keys(self.symbols, self.starts, size, self.n):
            order = np.argsort(key, kind="stable")
            some = np.zeros(1 << self.bits, bool)  # most windows meet nothing, which this tells at once
            some[(key >> np.uint64(64 - self.bits)).astype(np.int64)] = True
            self.tables.append((key[order], order, some))
        self.signs = signs(self.symbols, self.starts, size)

    def match(self, symbols: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Distinct (document number, item, least edits) of the windows within the allowed edits. A document must end with
        as many symbols 0 as edits are allowed, so that a window whose last words are missing has its full size."""
        size, n = self.size, len(symbols) - self.size + 1
        found = []
        if n > 0 and len(self.owner):
            unknown = np.append(0, np.cumsum(symbols == 0))
            longer = np.append(symbols, np.full(self.edits, -1))
            starts = np.flatnonzero((unknown[size:] - unknown[:n] <= self.edits) & (doc[:n] == doc[size - 1 :]))
            for at in range(0, len(starts), CHUNK):
                found += self._near(symbols, longer, doc, starts[at : at + CHUNK])
        if not found:
            return np.zeros((0, 3), np.int64)
        found = np.concatenate(found)
        found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
        return found[np.append(True, (found[1:, :2] != found[:-1, :2]).any(1))[: len(found)]]

    def _near(self, symbols: np.ndarray, longer: np.ndarray, doc: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
        """What the windows at these starts meet, verified, in parts."""
        size, met = self.size, []
        own = signs(longer, starts, size + self.edits)
        for key, (known, order, some) in zip(keys(symbols, starts, size, self.n), self.tables, strict=True):
            may = np.flatnonzero(some[(key >> np.uint64(64 - self.bits)).astype(np.int64)])
            low, high = np.searchsorted(known, key[may], "left"), np.searchsorted(known, key[may], "right")
            count = high - low
            for part in np.array_split(np.arange(len(may)), max(1, int(count.sum()) // 1_000_000)):
                c = count[part]
                where = np.repeat(may[part], c)
                entry = order[np.repeat(low[part], c) + np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)]
                near = np.bitwise_count(self.signs[entry] & ~own[where]) <= self.edits
                met.append(np.sort(where[near] * len(self.owner) + entry[near]))
        met = np.sort(np.concatenate(met))
        met = met[np.append(True, met[1:] != met[:-1])[: len(met)]]
        for at in range(0, len(met), 200_000):
            where, entry = np.divmod(met[at : at + 200_000], len(self.owner))
            b = self.symbols[self.starts[entry][:, None] + np.arange(size)]
            a = longer[starts[where][:, None] + np.arange(size + self.edits)]
            edits = edit_distance(b, a) if self.edits else (a != b).any(1).astype(np.int64)
            near = edits <= self.edits
            yield np.column_stack([doc[starts[where[near]]], self.owner[entry[near]], edits[near]])


def signs(symbols: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    """One bit for each word of a window: within e edits all bits of an item's window but e are among those of a text's."""
    bit = np.uint64(1) << (mix(symbols.astype(np.int64).view(np.uint64)) >> np.uint64(58))
    out = np.zeros(len(starts), np.uint64)
    for i in range(size):
        out |= bit[np.minimum(starts + i, len(symbols) - 1)]
    return out


def leaked_items(documents: DataFrame, items: DataFrame, size: int = 12, edits: int = 0, recall: float = 0.95, id: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, edits) of each document and each item of which a window of ``size`` words stands in the document
    with at most ``edits`` inserted, deleted or replaced words, and the least number of these.

    Null or empty texts and items shorter than a window match nothing; repeated rows give one result; null ids are
    dropped. Items are taken in blocks of about ``BLOCK_CHARS`` characters, so what executors hold doesn't grow with the
    number of items; where there are several, the documents' words are read out of their markup once and kept.
    ``recall`` is that of windows with ``edits`` edits; those without edit are all found.
    """
    spark = documents.sparkSession
    items = items.select(F.col(item).cast("bigint").alias("item"), F.col(item_text).alias("text")).dropna()
    blocks = max(1, math.ceil((items.agg(F.sum(F.length("text"))).first()[0] or 0) / BLOCK_CHARS))
    docs = documents.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).dropna()
    read = words
    if blocks > 1:

        def plain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([" ".join(words(t)) for t in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

        docs, _ = Durable(spark, "words").keep(docs.mapInArrow(plain, "id bigint, text string"))
        read = str.split
    out = None
    for b in range(blocks):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b)
        index = spark.sparkContext.broadcast(ItemIndex([tuple(r) for r in block.collect()], size, edits, recall))

        def scan(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            get = index.value.vocabulary.get
            for batch in batches:
                ids = batch.column(0).to_numpy()
                symbols, doc, held = [], [], 0
                for i, t in enumerate(batch.column(1).to_pylist()):
                    own = [get(w, 0) for w in read(t)] + [0] * edits
                    symbols.append(np.array(own, np.int64))
                    doc.append(np.full(len(own), i))
                    held += len(own)
                    if held > 500_000 or i == batch.num_rows - 1:
                        pairs = index.value.match(np.concatenate(symbols), np.concatenate(doc))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[pairs[:, 0]]), pa.array(pairs[:, 1]), pa.array(pairs[:, 2].astype(np.int32))], ["doc_id", "item_id", "edits"])
                        symbols, doc, held = [], [], 0

        found = docs.mapInArrow(scan, "doc_id bigint, item_id bigint, edits int")
        out = found if out is None else out.unionByName(found)
    return out.groupBy(F.col("doc_id").alias(id), F.col("item_id").alias(item)).agg(F.min("edits").alias("edits"))
