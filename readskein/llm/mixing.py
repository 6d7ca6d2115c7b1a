"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Durable

#: Sources up to which their plan is broadcast; plans of more are joined by shuffle.
MOST_TARGETS = 1_000
PLAN = "_source string, weight double, max_repeat int, tokens bigint, docs bigint, rate double, first bigint, below array<double>"


def source_name(column: str) -> Column:
    """Spellings of a source that differ in case, surrounding blanks, or blanks and hyphens for underscores are one."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s\-_]+", "_")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


_LOADED: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path, pattern] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path, pattern]


def token_counts(documents: DataFrame, id: str, text: str, path: str, pattern: str, *keep: str) -> DataFrame:
    """(id, ``keep`` columns, n_tokens): tokens of each whole text; null texts have none."""
    cols = [id, *keep]
    df = documents.select(*cols, F.col(text).alias("_text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(path, pattern).encode_ordinary
        for batch in batches:
            n = pa.array([len(encode(t)) if t else 0 for t in batch.column(len(cols)).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*cols, "n_tokens"])

    from pyspark.sql import types as T

    return df.mapInArrow(count, T.StructType([*df.schema.fields[:-1], T.StructField("n_tokens", T.LongType())]))


def capped_counts(mean: float, cap: int) -> tuple[int, list[float]]:
    """(first, below): P(count <= first + k) for each k of ``below``, of a Poisson count cut off at ``cap`` whose mean is
    ``mean``. Counts below ``first`` have no chance that a double could tell, and those beyond ``below`` neither, so the
    list grows as the square root of the cap. A mean at the cap or above gives the cap always; one of 0 or a cap below 1
    gives 0 always.
    """
    if cap < 1 or mean <= 0:
        return 0, [1.0]
    if mean >= cap:
        return cap, []

    def below(rate: float) -> tuple[int, np.ndarray]:
        wide = 10 * math.sqrt(rate) + 40
        low, high = max(0, int(rate - wide)), min(cap, int(rate + wide) + 1)
        k = np.arange(low, max(low, high))
        p = np.exp(k * math.log(rate) - rate - _log_factorial(k))
        return min(low, cap), np.minimum(1.0, np.cumsum(p))

    def reached(rate: float) -> float:
        low, c = below(rate)
        return low + float((1 - c).sum())

    low, high = 0.0, 1.0
    while reached(high) < mean:
        high *= 2
    for _ in range(100):
        rate = (low + high) / 2
        low, high = (rate, high) if reached(rate) < mean else (low, rate)
    first, c = below((low + high) / 2)
    return first, c.tolist()


def _log_factorial(k: np.ndarray) -> np.ndarray:
    """Logarithms of the factorials of consecutive numbers."""
    if not len(k):
        return np.zeros(0)
    return math.lgamma(k[0] + 1) + np.append(0.0, np.cumsum(np.log(k[1:].astype(np.float64))))


class Mixture:
    """The plan of a mixture and what comes of it.

    ``targets`` has source, weight, max_repeat; its weights are taken relative to the sum over those sources that
    documents have. Rates are worked out in a table, so there may be any number of sources. Without ``total`` the mixture gets the most tokens that all weights can be reached with, so the
    scarcest source uses each document max_repeat times. Documents without a target source, with null source, or
    without tokens take no part; targets that are null, not positive or repeated (after the first by name) take no part.
    """

    def __init__(self, documents: DataFrame, targets: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", total: int | None = None, seed: int = 0, path: str | None = None, pattern: str | None = None):
        import public_tokenizers

        spark = documents.sparkSession
        self.documents, self.id, self.text, self.source, self.seed = documents, id, text, source, seed
        named = documents.select(F.col(id).alias("key"), source_name(source).alias("_source"), F.col(text).alias("text"))
        self.sizes, _ = Durable(spark, "mixing").keep(token_counts(named, "key", "text", path or vocabulary_path(), pattern or public_tokenizers.PATTERN, "_source"))
        wanted = targets.select(source_name("source").alias("_source"), F.col("weight").cast("double").alias("weight"), F.col("max_repeat").cast("int").alias("max_repeat"))
        wanted = wanted.where("weight > 0 and max_repeat > 0 and _source is not null").groupBy("_source").agg(F.max(F.struct("weight", "max_repeat")).alias("t")).select("_source", "t.*")
        sums = self.sizes.groupBy("_source").agg(F.sum("n_tokens").alias("tokens"), F.count_if(F.col("n_tokens") > 0).alias("docs"))
        joined, _ = Durable(spark, "mixing").keep(wanted.join(sums, "_source", "left").fillna(0, ["tokens", "docs"]))
        present = joined.where("tokens > 0").agg(F.count("*").alias("n"), F.sum("weight").alias("weights"), F.min(F.col("max_repeat") * F.col("tokens") / F.col("weight")).alias("least")).first()
        if total is None:  # the scarcest source is used up
            total = present.least * present.weights if present.n else 0
        self.total = total
        mean = F.when(F.col("tokens") > 0, F.col("weight") / F.lit(present.weights or 1.0) * F.lit(float(total)) / F.col("tokens")).otherwise(0.0)

        def plan(pdf: pd.DataFrame) -> pd.DataFrame:
            counts = [capped_counts(r, c) for r, c in zip(pdf["rate"], pdf["max_repeat"], strict=True)]
            return pdf.assign(first=[f for f, _ in counts], below=[b for _, b in counts])

        planned = joined.withColumn("rate", mean).select("_source", "weight", "max_repeat", "tokens", "docs", "rate")
        self.rates, _ = Durable(spark, "mixing").keep(planned.mapInPandas(lambda batches: map(plan, batches), PLAN))
        drawn = self.rates.select("_source", "first", "below")
        self.drawn = F.broadcast(drawn) if joined.count() <= MOST_TARGETS and (self.rates.agg(F.sum(F.size("below"))).first()[0] or 0) <= 1_000_000 else drawn

    def _times(self, key: Column) -> Column:
        """How often a row is used, given its source's ``first`` and ``below``. It depends on the row's id, the seed and the
        rate only."""
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(self.seed), key), 11).cast("double") + 0.5) / float(1 << 53)
        return (F.col("first") + F.size(F.filter("below", lambda c: c < u))).cast("int")

    def documents_mixed(self) -> DataFrame:
        """All columns of the documents, with copy (from 1 on) and place, a random number that gives the order; rows
        are spread over partitions and sorted within them by place, whatever their source. Columns of the documents
        named copy or place are replaced."""
        kept = [c for c in self.documents.columns if c not in ("copy", "place")]
        rows = self.documents.where(F.length(self.text) > 0).select(F.struct(*[F.col(c) for c in kept]).alias("row"), F.col(self.id).alias("key"), source_name(self.source).alias("_source"))
        used = rows.join(self.drawn, "_source").select("row", "key", self._times(F.col("key")).alias("times")).where("times > 0")
        copies = used.select("row", "key", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("copy"))
        placed = copies.withColumn("place", F.xxhash64(F.lit(self.seed + 1), "key", "copy"))
        # adaptive execution settles how many partitions the size of the mixture asks for
        return placed.hint("rebalance", "place").sortWithinPartitions("place").select(*[F.col("row").getField(c).alias(c) for c in kept], "copy", "place")

    def shares(self) -> DataFrame:
        """(source, target_share, max_repeat, tokens, docs, rate, tokens_used, docs_used, copies, actual_share): of
        each target; target_share is the given weight, actual_share the share of all tokens of the mixture."""
        drawn = self.sizes.join(self.drawn, "_source").select("_source", "n_tokens", self._times(F.col("key")).alias("_times"))
        used = drawn.where("_times > 0 and n_tokens > 0").groupBy("_source").agg(F.sum(F.col("n_tokens") * F.col("_times")).alias("tokens_used"), F.count("*").alias("docs_used"), F.sum("_times").alias("copies"))
        both = self.rates.drop("first", "below").join(used, "_source", "left").fillna(0, ["tokens_used", "docs_used", "copies"])
        whole = F.sum("tokens_used").over(Window.partitionBy(F.lit(0)))  # over one row a target
        return both.withColumn("_all", whole).select(F.col("_source").alias("source"), F.col("weight").alias("target_share"), "max_repeat", "tokens", "docs", "rate", "tokens_used", "docs_used", "copies", F.when(F.col("_all") > 0, F.col("tokens_used") / F.col("_all")).alias("actual_share"))
