"""Near-duplicate records: a MinHash LSH forest, followed by exact verification.

Every record has in each of the forest's trees a label of minimum hashes. The labels of a tree, sorted, are a prefix trie:
two records match in it as far as their labels agree. Only nodes at the shortest prefix that may be needed are set up,
and the bucket of such a node sorts what lies below it and tells for each two of its records how long a prefix they match.

The prefix to match is then shortened one hash at a time, beginning with the longest. Pairs that match that far are
verified exactly; each of them, of similarity s, was to be found with a probability of 1 - (1 - s^d)^trees, so the number
of pairs that there are is estimated from those found, and the prefix is shortened until the share found reaches the
target recall. At the shortest prefix pairs at the threshold itself reach it.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import flat, packed, slices, turned, windows_ok
from ..functions.buckets import SCHEMA, bucket_number, bucket_of, bundled, frequent_keys, mix, partitions, shuffled, whole_buckets
from ..operators.pairs import in_blocks
from ..session import Durable

RECALL = 0.999
#: The shortest prefix has at most so many hashes, and the longest so many more.
SHORTEST, MORE = 8, 2
#: Hashes that one hash function gives: minima of its values in so many parts of its range.
PARTS = 20
#: Bits of the sketch, one of a hash each, and how many standard deviations below the threshold it may tell two records
#: apart. Records of fewer words than bits are not told apart by it.
BITS, SIGMAS = 192, 4.0
#: Records of a node that meet in one task; those of larger nodes meet in blocks.
BLOCK = 2048


def forest_shape(threshold: float, recall: float = RECALL, shortest: int = SHORTEST) -> tuple[int, int]:
    """(trees, shortest prefix): a prefix that about one in eight pairs at the threshold match, and trees enough for these
    pairs to match in one of them with probability ``recall``."""
    prefix = max(1, min(shortest, int(math.log(0.12) / math.log(threshold)))) if threshold < 1 else shortest
    chance = threshold**prefix
    return (math.ceil(math.log(1 - recall) / math.log(1 - chance)) if chance < 1 else 1), prefix


def found_share(similarity, prefix: int, trees: int):
    """The probability that two records match a prefix in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def sketch_limit(threshold: float, bits: int = BITS, sigmas: float = SIGMAS) -> int:
    """Most unequal bits of two sketches of records at the threshold, but for a chance of some hundred thousandths."""
    unequal = (1 - threshold) / 2
    return math.ceil(bits * unequal + sigmas * math.sqrt(bits * unequal * (1 - unequal)))


def minima(words: np.ndarray, row: np.ndarray, n_rows: int, n: int, parts: int = PARTS) -> np.ndarray:
    """``n`` minimum hashes of each row's words. One hash function gives ``parts`` of them, each over the words whose value
    falls in one part of its range; a part without words takes the minimum of the next that has some, told apart by the
    distance. Rows must be ascending and none empty."""
    functions = -(-n // parts)
    x = mix(words.astype(np.uint64) + np.uint64(1))
    seeds = mix(np.arange(1, 2 * functions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    out = np.empty((n_rows, functions, parts), np.uint64)
    base = row.astype(np.int64) * parts
    h = np.empty_like(x)
    with np.errstate(over="ignore"):
        for f in range(functions):
            np.multiply(x, seeds[2 * f], out=h)
            np.add(h, seeds[2 * f + 1], out=h)
            part = (((h >> np.uint64(40)) * np.uint64(parts)) >> np.uint64(24)).astype(np.int64)
            least = np.full(n_rows * parts, empty, np.uint64)
            np.minimum.at(least, base + part, (h << np.uint64(24)) | (h >> np.uint64(40)))  # what chose the part orders last
            least = least.reshape(n_rows, parts)
            filled, missing = least.copy(), least == empty
            for step in range(1, parts):
                if not missing.any():
                    break
                taken = np.roll(least, -step, 1)
                use = missing & (taken != empty)
                filled[use] = mix(taken[use] + np.uint64(step))
                missing &= ~use
            out[:, f] = filled
    # neighbours in a label come from different functions
    return np.ascontiguousarray(mix(out.transpose(0, 2, 1).reshape(n_rows, functions * parts)[:, :n]))


class _Words:
    """Word sets of texts. Called with a column of texts it gives (word, row) of the distinct words of each, as numbers
    that may be hashes; ``compared`` gives the numbers of words of pairs exactly."""

    def compared(self, left: pa.Array, right: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words both have, words of the left, words of the right) of each pair of texts."""
        both = pa.chunked_array([left, right]).combine_chunks().dictionary_encode()
        which = both.indices.to_numpy(zero_copy_only=False)
        word, row = self.exact(both.dictionary)
        sizes = np.bincount(row, minlength=len(both.dictionary))
        starts = np.cumsum(sizes) - sizes
        n = len(left)
        bits = max(1, int(word.max()).bit_length()) if len(word) else 1

        def keys(side: np.ndarray) -> np.ndarray:
            m = sizes[side]
            at = np.repeat(starts[side] - np.cumsum(m) + m, m) + np.arange(m.sum())
            return (np.repeat(np.arange(n), m) << bits) | word[at]

        one, two = keys(which[:n]), keys(which[n:])
        place = np.minimum(np.searchsorted(one, two), max(0, len(one) - 1))
        common = np.bincount((two >> bits)[one[place] == two], minlength=n) if len(one) and len(two) else np.zeros(n, np.int64)
        return common, sizes[which[:n]], sizes[which[n:]]

    def exact(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(word, row), by row and word, with numbers below 2^40 that are equal for equal words of these texts only."""
        raise NotImplementedError


class base_words(_Words):
    """The distinct words of k <= 31 bases of each text, a word and its reverse complement being one; texts with fewer
    than ``least`` have none."""

    def __init__(self, k: int, least: int):
        if not 1 <= k <= 31:
            raise ValueError("words have 1 to 31 bases")
        self.k, self.least = k, least

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        codes, offsets = flat(texts)
        at, row = windows_ok(codes, offsets, self.k)
        word = np.minimum(packed(codes, self.k)[at], turned(codes, self.k)[at])
        bits = 2 * self.k
        if bits + len(texts).bit_length() <= 62:
            both = np.sort((row.astype(np.int64) << bits) | word)
            both = both[np.append(True, both[1:] != both[:-1])[: len(both)]]
            row, word = both >> bits, both & ((1 << bits) - 1)
        else:
            order = np.lexsort((word, row))
            word, row = word[order], row[order]
            new = np.append(True, (word[1:] != word[:-1]) | (row[1:] != row[:-1]))[: len(word)]
            word, row = word[new], row[new]
        keep = (np.bincount(row, minlength=len(texts)) >= self.least)[row]
        return word[keep], row[keep]

    def exact(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        word, row = self(texts)
        return (word, row) if self.k <= 20 else (np.unique(word, return_inverse=True)[1].reshape(-1), row)


_TOKENS = re.compile(r"[^\W_]+").findall


class text_words(_Words):
    """The distinct shingles of n words of each text, words being runs of letters or digits in either case; texts with
    fewer words are one shingle. Shingles are hashed for the forest and compared word by word in verification."""

    def __init__(self, n: int = 5, least: int = 1):
        self.n, self.least = n, least

    def _shingles(self, texts: pa.Array, exact: bool) -> tuple[np.ndarray, np.ndarray]:
        tokens, sizes, known = [], [], {}
        for text in texts.to_pylist():
            own = _TOKENS(text.lower())
            tokens += [known.setdefault(w, len(known) + 1) for w in own]
            sizes.append(len(own))
        codes, sizes = np.array(tokens, np.int64), np.array(sizes, np.int64)
        if not exact and len(known):
            import xxhash

            codes = np.array([0, *(xxhash.xxh64_intdigest(w) >> 1 for w in known)], np.int64)[codes]
        ends = np.cumsum(sizes)
        count = np.where(sizes > 0, np.maximum(1, sizes - self.n + 1), 0)
        row = np.repeat(np.arange(len(sizes)), count)
        at = np.repeat(ends - sizes - np.cumsum(count) + count, count) + np.arange(count.sum())
        name = np.zeros(len(at), np.int64)
        for j in range(self.n):
            inside = at + j < ends[row]
            token = np.where(inside, codes[np.minimum(at + j, max(0, len(codes) - 1))] if len(codes) else 0, 0)
            if exact:  # a shingle of j + 1 words is named by that of j words and the next word, both numbered from 0 on
                name = np.unique(name * (len(known) + 1) + token, return_inverse=True)[1].reshape(-1)
            else:
                with np.errstate(over="ignore"):
                    name = mix(name.view(np.uint64) * np.uint64(1099511628211) + token.astype(np.uint64) + np.uint64(j)).view(np.int64)
        name = (name.view(np.uint64) >> np.uint64(1)).astype(np.int64) if not exact else name
        order = np.lexsort((name, row))
        name, row = name[order], row[order]
        new = np.append(True, (name[1:] != name[:-1]) | (row[1:] != row[:-1]))[: len(name)]
        name, row = name[new], row[new]
        keep = (np.bincount(row, minlength=len(texts)) >= self.least)[row]
        return name[keep], row[keep]

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._shingles(texts, False)

    def exact(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self._shingles(texts, True)


_LABEL = np.dtype([("node", "u8"), ("rest", "u4")])
_ROW = np.dtype([("key", "i8"), ("id", "i8"), ("rest", "u4"), ("size", "i4"), ("sketch", "u8", (BITS // 64,))])
_SKETCH = [f"s{i}" for i in range(BITS // 64)]
FOUND = "a bigint, b bigint, depth int, node bigint, rest bigint, size int, " + ", ".join(f"{s} bigint" for s in _SKETCH)


def labels(least: np.ndarray, trees: int, prefix: int) -> np.ndarray:
    """The node at the shortest prefix, and what follows it, of every tree for each row of minima."""
    n = len(least)
    least = least[:, : trees * (prefix + MORE)].reshape(n, trees, prefix + MORE)
    out = np.empty((n, trees), _LABEL)
    node = np.broadcast_to(np.arange(1, trees + 1, dtype=np.uint64), (n, trees)).copy()
    with np.errstate(over="ignore"):
        for d in range(prefix):
            node = mix(node * np.uint64(31) + least[:, :, d])
    out["node"], out["rest"] = node, (least[:, :, prefix] & np.uint64(0xFFFF)) << np.uint64(16) | (least[:, :, prefix + 1] & np.uint64(0xFFFF))
    return out


def _matches(rows: np.ndarray, threshold: float, block: int, most: int = 1_000_000) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, depth beyond the shortest prefix) of the records that meet in a node of the sorted trie of a bucket and are
    not told apart by size or sketch; each pair once with its longest prefix. Large nodes come as their rows, depth None."""
    rows = rows[np.lexsort((rows["id"], rows["rest"], rows["key"]))]
    key = rows["key"]
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    sizes = np.diff(np.append(starts, len(rows)))
    for s, n in zip(starts[sizes > block], sizes[sizes > block], strict=True):
        yield rows[s : s + n], None, None
    keep = np.repeat((sizes > 1) & (sizes <= block), sizes)
    after = np.where(keep, np.repeat(starts + sizes, sizes) - np.arange(len(rows)) - 1, 0)
    done = np.append(0, np.cumsum(after))
    limit, at = sketch_limit(threshold), 0
    while at < len(rows) and done[at] < done[-1]:
        to = max(at + 1, int(np.searchsorted(done, done[at] + most, side="right")) - 1)
        a = np.repeat(np.arange(at, to), after[at:to])
        b = a + 1 + np.arange(len(a)) - np.repeat(done[at:to] - done[at], after[at:to])
        at = to
        less, more = np.minimum(rows["size"][a], rows["size"][b]), np.maximum(rows["size"][a], rows["size"][b])
        some = (less >= more * threshold) & (rows["id"][a] != rows["id"][b])
        a, b, less = a[some], b[some], less[some]
        unequal = np.bitwise_count(rows["sketch"][a] ^ rows["sketch"][b]).sum(1, dtype=np.int64)
        some = (unequal <= limit) | (less < BITS)
        a, b = a[some], b[some]
        if not len(a):
            continue
        differ = rows["rest"][a] ^ rows["rest"][b]
        depth = np.where(differ == 0, 2, np.where(differ < 65536, 1, 0)).astype(np.int32)
        x, y = rows["id"][a], rows["id"][b]
        x, y = np.minimum(x, y), np.maximum(x, y)
        order = np.lexsort((-depth, y, x))
        x, y, depth = x[order], y[order], depth[order]
        first = np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))
        yield x[first], y[first], depth[first]


def _found(a, b, depth, rows=None) -> pa.RecordBatch:
    n = len(a)
    if rows is None:
        rest = [pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), *(pa.nulls(n, pa.int64()) for _ in _SKETCH)]
        cols = [pa.array(a), pa.array(b), pa.array(depth), *rest]
    else:
        cols = [pa.array(rows["id"]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(rows["key"]), pa.array(rows["rest"].astype(np.int64)), pa.array(rows["size"])]
        cols += [pa.array(np.ascontiguousarray(rows["sketch"][:, i]).view(np.int64)) for i in range(len(_SKETCH))]
    return pa.RecordBatch.from_arrays(cols, ["a", "b", "depth", "node", "rest", "size", *_SKETCH])


def similar_records(records: DataFrame, words: _Words, id: str = "seq_id", text: str = "bases", threshold: float = 0.8, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(pairs, members). pairs: (a, b, similarity) of class representatives a < b whose Jaccard similarity of word
    sets is at least ``threshold``; members: (id, rep) of every record that has words, the representative being the
    least id with the same word set (told by 128 bits of hashes of its words).

    ``words`` is ``base_words`` or ``text_words``. Rows with null id or text are dropped; of several texts of an id the
    last in order counts; records without words are in no class. Copies meet in their class and never as pairs. Where
    a node of a tree holds very many records, they meet in blocks, each two of which are a task's.
    """
    trees, prefix = forest_shape(threshold, recall)
    n_hashes = max(trees * (prefix + MORE), BITS)
    spark = records.sparkSession
    durable = Durable(spark, "neardup")
    rows = records.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).dropna().groupBy("id").agg(F.max("text").alias("text"))
    rows, _ = durable.keep(rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, most=200_000):
                word, row = words(part.column(1))
                if not len(word):
                    continue
                new = np.append(True, row[1:] != row[:-1])
                which, row = row[new], np.cumsum(new) - 1
                least = minima(word, row, len(which), n_hashes)
                label = labels(least, trees, prefix)
                bits = np.packbits((least[:, :BITS] & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").view(np.int64)
                starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                with np.errstate(over="ignore"):
                    one = np.add.reduceat(mix(word.astype(np.uint64) + np.uint64(77)), starts)
                    two = np.add.reduceat(mix(word.astype(np.uint64) ^ np.uint64(0x5DEECE66D)), starts)
                offsets = np.arange(len(which) + 1, dtype=np.int32) * np.int32(trees * _LABEL.itemsize)
                blob = pa.Array.from_buffers(pa.binary(), len(which), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(label.tobytes())])
                cols = [part.column(0).to_numpy()[which], one.view(np.int64), two.view(np.int64), np.diff(np.append(starts, len(row))).astype(np.int32), *(np.ascontiguousarray(bits[:, i]) for i in range(len(_SKETCH)))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, cols), blob], ["id", "one", "two", "size", *_SKETCH, "labels"])

    signed, _ = durable.keep(rows.mapInArrow(sign, f"id bigint, one bigint, two bigint, size int, {', '.join(f'{c} bigint' for c in _SKETCH)}, labels binary"))
    reps = signed.groupBy("one", "two").agg(F.min("id").alias("rep"))
    members, _ = durable.keep(signed.select("id", "one", "two").join(reps, ["one", "two"]).select("id", "rep"))
    leaders = signed.join(members.where("id = rep").select("id"), "id", "left_semi").select("id", "size", *_SKETCH, "labels")
    n = members.where("id = rep").count()
    buckets = bucket_number(spark, n * trees)
    own = lambda batch: np.frombuffer(b"".join(batch.column(len(_SKETCH) + 2).to_pylist()), _LABEL)
    hot = {} if buckets == partitions(spark) else frequent_keys(leaders, n, lambda batch: own(batch)["node"].view(np.int64) if batch.num_rows else np.zeros(0, np.int64), buckets)
    hot = np.array(sorted(hot), np.int64)  # nodes that no bucket should hold

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            label, at = own(batch), np.repeat(np.arange(batch.num_rows), trees)
            out = np.empty(len(label), _ROW)
            out["key"], out["rest"] = np.ascontiguousarray(label["node"]).view(np.int64), label["rest"]
            out["id"], out["size"] = batch.column(0).to_numpy()[at], batch.column(1).to_numpy()[at]
            for i in range(len(_SKETCH)):
                out["sketch"][:, i] = batch.column(2 + i).to_numpy().view(np.uint64)[at]
            to = bucket_of(out["key"], buckets).astype(np.int64)
            to[np.isin(out["key"], hot)] = -1
            yield bundled(out, to)

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in whole_buckets(batches, _ROW):
            for a, b, depth in _matches(held, threshold, BLOCK):
                yield _found(a, b, depth, a if depth is None else None)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, held in whole_buckets(batches, _ROW):
            yield _found(held, None, None, held)

    bundles = leaders.mapInArrow(spread, SCHEMA)
    if len(hot):
        bundles, _ = durable.keep(bundles)
    met, _ = durable.keep(shuffled(bundles.where("bucket >= 0")).mapInArrow(match, FOUND))
    big = met.where("b is null")
    if len(hot):
        big = big.unionByName(bundles.where("bucket < 0").mapInArrow(raw, FOUND))
    pairs = met.where("b is not null").select("a", "b", "depth")
    if not big.isEmpty():
        two = in_blocks(big.select("node", "a", "rest", "size", *_SKETCH), "node", BLOCK).where("one.a < two.a")
        unequal = sum((F.bit_count(F.col(f"one.{c}").bitwiseXOR(F.col(f"two.{c}"))) for c in _SKETCH), F.lit(0))
        less, more = F.least("one.size", "two.size"), F.greatest("one.size", "two.size")
        differ = F.col("one.rest").bitwiseXOR(F.col("two.rest"))
        two = two.where((less >= more * threshold) & ((unequal <= sketch_limit(threshold)) | (less < BITS)))
        pairs = pairs.unionByName(two.select(F.col("one.a").alias("a"), F.col("two.a").alias("b"), F.when(differ == 0, 2).when(differ < 65536, 1).otherwise(0).alias("depth")))
    pairs, _ = durable.keep(pairs.groupBy("a", "b").agg(F.max("depth").alias("depth")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                common, left, right = words.compared(part.column(1), part.column(3))
                union = left + right - common
                alike = np.where(union > 0, common / np.maximum(union, 1), 0.0)
                keep = np.flatnonzero(alike >= threshold)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), part.column(2).take(pa.array(keep)), pa.array(alike[keep])], ["a", "b", "similarity"])

    found = None
    for beyond in range(MORE, -1, -1):
        level = pairs.where(F.col("depth") == beyond).select("a", "b")
        level = level.join(rows.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(rows.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
        level, _ = durable.keep(level.select("a", "ta", "b", "tb").mapInArrow(verify, "a bigint, b bigint, similarity double"))
        found = level if found is None else found.unionByName(level)
        if beyond and estimated_recall(found, prefix + beyond, trees) >= recall:
            break
    return found, members


def estimated_recall(found: DataFrame, prefix: int, trees: int) -> float:
    """The share of all pairs that those found (column similarity) are, as each stands for as many as its own chance of
    being found says; 0 where none is found."""
    chance = 1 - F.pow(1 - F.pow("similarity", F.lit(prefix)), F.lit(trees))
    n, all_ = found.agg(F.count("*"), F.sum(1 / chance)).first()
    return n / all_ if n else 0.0


def expand_pairs(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b) of all records: pairs of representatives with all their copies, and the copies of each class."""
    m = members.select("id", "rep")
    across = pairs.select("a", "b").join(m.select(F.col("id").alias("x"), F.col("rep").alias("a")), "a").join(m.select(F.col("id").alias("y"), F.col("rep").alias("b")), "b")
    copied = members.where("id <> rep").select("rep").distinct()
    copies = m.join(copied, "rep", "left_semi").select("rep", "id")
    within = in_blocks(copies, "rep").where("one.id < two.id").select(F.col("one.id").alias("x"), F.col("two.id").alias("y"))
    both = across.select("x", "y").unionByName(within)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
