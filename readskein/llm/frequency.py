"""Frequency of every distinct term, by a distributed suffix array with common-prefix intervals.

The suffixes of all token sequences are sorted: they are dealt to buckets by ranges of their first token, so the buckets
one after another are the suffix array, and a bucket is sorted by itself, suffixes that agree to the length asked for by
record. An n-gram is an interval of suffixes with a common prefix of n tokens; its occurrences are the interval's length.
In the interval, ordered by record, a suffix next to one of the same record is a duplicate, and occurrences less
duplicates are the records. A token that would fill more than a bucket is dealt to several by record; both numbers are
sums over the interval, so those of its n-grams are put together by adding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.buckets import SCHEMA, bucket_number, bundled, mix, shuffled, whole_buckets
from ..operators.chunks import number_in_key
from ..session import Durable

#: Tokens of the sample that the ranges of the buckets come from.
SAMPLE = 100_000
_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _narrow(low: int, high: int) -> np.dtype:
    """The smallest type of whole numbers from low to high; small ones sort and travel faster."""
    return np.result_type(np.min_scalar_type(low), np.min_scalar_type(high))


def _numbers(values: DataFrame, name: str) -> DataFrame:
    """(name, number): the distinct values of a column numbered in order."""
    return number_in_key(values.select(name).distinct().withColumn("_one", F.lit(0)), "_one", [name]).select(name, F.col("_number").alias("number"))


def suffix_rows(ids: np.ndarray, offsets: np.ndarray, values: np.ndarray, valid: np.ndarray, kind: np.dtype) -> np.ndarray:
    """The suffixes of the sequences, each as its first tokens, how many of them there are, its record and how often the
    record has it in this batch. A missing token ends a suffix."""
    n = kind["t"].shape[0]
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(valid)
    out = np.zeros(len(at), kind)
    out["id"], out["count"] = ids[row[at]], 1
    alive = np.ones(len(at), bool)
    for k in range(n):
        to = np.minimum(at + k, len(values) - 1)
        alive &= (at + k < offsets[row[at] + 1]) & valid[to]
        out["t"][:, k] = np.where(alive, values[to], 0)
        out["len"] += alive.astype(np.uint8)
    order = np.lexsort((out["len"], out["id"], *(out["t"][:, k] for k in range(n - 1, -1, -1))))
    out = out[order]
    same = np.zeros(len(out), bool)
    same[1:] = (out["id"][1:] == out["id"][:-1]) & (out["len"][1:] == out["len"][:-1]) & (out["t"][1:] == out["t"][:-1]).all(1)
    first = np.flatnonzero(~same)
    sums = np.diff(np.append(first, len(out)))
    out = out[first]
    out["count"] = sums
    return out


def intervals(rows: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(k, tokens, occurrences, records) of the intervals of each length k of a bucket's suffixes."""
    n = rows["t"].shape[1]
    rows = rows[np.lexsort((rows["id"], *(rows["t"][:, k] for k in range(n - 1, -1, -1))))]
    t, ids, count, length = rows["t"], rows["id"], rows["count"].astype(np.int64), rows["len"]
    lcp = np.zeros(len(rows), np.int64)  # tokens that a suffix shares with the one before it
    alike = np.ones(max(0, len(rows) - 1), bool)
    for k in range(n):
        alike &= (t[1:, k] == t[:-1, k]) & (length[1:] > k) & (length[:-1] > k)
        lcp[1:] += alike
    for k in range(1, n + 1):
        some = np.flatnonzero(length >= k)
        if not len(some):
            return
        # suffixes too short stand between no two of an interval that are next to one another but as a gap of the prefix
        new = lcp[some] < k
        if len(some) < len(rows):
            new[1:] = (t[some[1:], :k] != t[some[:-1], :k]).any(1)
        new[0] = True
        interval = np.cumsum(new) - 1
        own = ids[some]
        if k < n:
            order = np.lexsort((own, interval))
            own, interval_, weight = own[order], interval[order], count[some][order]
        else:
            interval_, weight = interval, count[some]
        again = weight - 1  # of one record's equal suffixes all but one are duplicates
        again[1:] += (own[1:] == own[:-1]) & (interval_[1:] == interval_[:-1])
        starts = np.flatnonzero(new)
        occurrences = np.add.reduceat(weight, starts)
        yield k, t[some[starts], :k], occurrences, occurrences - np.add.reduceat(again, starts)


def ngram_counts(records: DataFrame, id: str, tokens: str, longest: int = 1) -> DataFrame:
    """(ngram, occurrences, records) of every n-gram of 1 to ``longest`` tokens.

    ``tokens`` is an array of numbers or strings; an id may have many rows, whose sequences are each read by themselves
    and whole. Null ids, null or empty arrays add nothing; a null token ends an n-gram and is in none. Suffixes are told
    apart up to the longest n-gram asked for, as what follows changes no interval that short. Tokens and ids other than
    whole numbers are numbered in order first. Empty input gives an empty result.
    """
    spark = records.sparkSession
    kind = records.schema[tokens].dataType.elementType
    base = records.select(F.col(id).alias("id"), F.col(tokens).alias("t")).where(F.col("id").isNotNull() & (F.size("t") > 0))
    if not isinstance(records.schema[id].dataType, _WHOLE):
        base = base.join(_numbers(base, "id"), "id").select(F.col("number").alias("id"), "t")
    names = None
    if not isinstance(kind, _WHOLE):
        placed, _ = Durable(spark, "tokens").keep(base.withColumn("row", F.monotonically_increasing_id()))
        flat = placed.select("row", "id", F.posexplode("t").alias("at", "token"))
        names, _ = Durable(spark, "names").keep(_numbers(flat.where("token is not null"), "token"))
        one = F.sort_array(F.collect_list(F.struct("at", "number")))
        base = flat.join(names, "token", "left").groupBy("row").agg(F.first("id").alias("id"), one.alias("l")).select("id", F.col("l.number").alias("t"))
    base = base.select(F.col("id").cast("bigint").alias("id"), F.col("t").cast("array<bigint>").alias("t"))
    if names is not None:
        base, _ = Durable(spark, "numbered").keep(base)
    seen = base.agg(F.sum(F.size("t")), F.min("id"), F.max("id"), F.min(F.array_min("t")), F.max(F.array_max("t")), F.count("*")).first()
    schema = T.StructType([T.StructField("ngram", T.ArrayType(T.LongType() if names is not None else kind)), T.StructField("occurrences", T.LongType()), T.StructField("records", T.LongType()), T.StructField("part", T.BooleanType())])
    if seen[3] is None:
        return spark.createDataFrame([], T.StructType([T.StructField("ngram", T.ArrayType(kind)), *schema.fields[1:3]]))
    suffix = np.dtype([("t", _narrow(seen[3], seen[4]), (longest,)), ("id", _narrow(seen[1], seen[2])), ("count", "u4"), ("len", "u1")])
    buckets = bucket_number(spark, seen[0])
    some = base.sample(False, min(1.0, SAMPLE / seen[0]), 1).select(F.explode("t").alias("x")).where("x is not null").limit(2 * SAMPLE).collect()
    drawn = np.sort(np.array([r.x for r in some] or [0], np.int64))
    bounds = drawn[(np.arange(1, buckets) * len(drawn)) // buckets]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 5000):
                part = batch.slice(at, 5000)
                lists = part.column(1)
                values = lists.flatten()
                offsets = np.append(0, np.cumsum(np.diff(lists.offsets.to_numpy())))
                valid = np.asarray(values.is_valid())
                rows = suffix_rows(part.column(0).to_numpy(), offsets, values.fill_null(0).to_numpy(), valid, suffix)
                first = rows["t"][:, 0].astype(np.int64)
                low, high = np.searchsorted(bounds, first, "left"), np.searchsorted(bounds, first, "right")
                yield bundled(rows, low + (mix(rows["id"]) % (high - low + 1).astype(np.uint64)).astype(np.int64))

    arrow = pa.list_(pa.int64()) if names is not None else pa.list_({T.ByteType: pa.int8(), T.ShortType: pa.int16(), T.IntegerType: pa.int32(), T.LongType: pa.int64()}[type(kind)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in whole_buckets(batches, suffix):
            for k, grams, occurrences, recs in intervals(rows):
                first = grams[:, 0].astype(np.int64)
                part = np.searchsorted(bounds, first, "left") < np.searchsorted(bounds, first, "right")
                for at in range(0, len(grams), 50_000):
                    to = min(at + 50_000, len(grams))
                    lists = pa.ListArray.from_arrays(np.arange(0, (to - at) * k + 1, k, dtype=np.int32), pa.array(grams[at:to].ravel().astype(np.int64))).cast(arrow)
                    yield pa.RecordBatch.from_arrays([lists, *(pa.array(x[at:to]) for x in (occurrences, recs, part))], ["ngram", "occurrences", "records", "part"])

    found = shuffled(base.mapInArrow(spread, SCHEMA)).mapInArrow(count, schema)
    columns = ["ngram", "occurrences", "records"]
    if len(np.unique(bounds)) < len(bounds) or np.isin(bounds, drawn).any():
        found, _ = Durable(spark, "ngrams").keep(found)
        divided = found.where("part").groupBy("ngram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        found = found.where("not part").select(*columns).unionByName(divided)
    if names is None:
        return found.select(*columns)
    # back to the tokens that the numbers stand for
    keyed, _ = Durable(spark, "numbered").keep(found.select(*columns).withColumn("row", F.monotonically_increasing_id()))
    spelt = keyed.select("row", F.posexplode("ngram").alias("at", "number")).join(names, "number").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("l"))
    return keyed.join(spelt, "row").select(F.col("l.token").alias("ngram"), "occurrences", "records")


def marked_terms(counts: DataFrame, total: int, rare: int = 2, common: float = 0.02) -> DataFrame:
    """Adds ``mark``: rare if in at most ``rare`` records, else common if in more than the share ``common`` of all
    ``total`` records, else null."""
    return counts.withColumn("mark", F.when(F.col("records") <= rare, "rare").when(F.col("records") > common * total, "common"))


def _lists(wordlists: DataFrame) -> tuple[DataFrame, int]:
    """(seq_id, words) without filler, and the number of different reads with at least one word."""
    lists = wordlists.select("seq_id", F.transform("word_seen", lambda w: F.when(w != -1, w)).alias("words"))
    total = lists.where(F.exists("words", lambda w: w.isNotNull()) & F.col("seq_id").isNotNull()).agg(F.countDistinct("seq_id")).first()[0]
    return lists, total


def word_marks(wordlists: DataFrame) -> DataFrame:
    """(word, occurrences, records, mark) of every word of the lists; -1 and null are filler.

    A read counts once for a word however many blocks or repeated entries list it; the share is taken of the different
    reads that have at least one word. The words are the intervals of length 1.
    """
    lists, total = _lists(wordlists)
    return marked_terms(ngram_counts(lists, "seq_id", "words", 1), total).select(F.col("ngram")[0].alias("word"), "occurrences", "records", "mark")


def ngram_marks(wordlists: DataFrame, longest: int) -> DataFrame:
    """(ngram, occurrences, records, mark) of every run of 1 to ``longest`` words of the lists, the words separated by
    blanks; filler divides runs."""
    lists, total = _lists(wordlists)
    return marked_terms(ngram_counts(lists, "seq_id", "words", longest), total).select(F.concat_ws(" ", F.col("ngram").cast("array<string>")).alias("ngram"), "occurrences", "records", "mark")
