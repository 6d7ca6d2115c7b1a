"""Per-key processing in order without long tasks: exact offset chunking.

A few keys may hold most rows, so no task may be bound to one key. Rows are range-partitioned and sorted by
(key, order), which cuts large keys at row boundaries; rows are counted per key and partition; prefix sums of
these counts give every row its exact number within its key; number div size is the row's chunk. A chunk holds
at most ``size`` rows of one key, so any window over (key, chunk) is bounded, and the ordered states at the chunk
boundaries (a table ``size`` times smaller) are merged afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import Durable

#: Rows of a chunk; bounds what one window group holds.
CHUNK_ROWS = 65536


def _numbered(df: DataFrame, key: str, order: Sequence[str], size: int) -> DataFrame:
    """(row, key, number, chunk) with the whole row as a struct, so that its columns can have any names."""
    at = ["key", *(f"order{i}" for i in range(len(order)))]
    packed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"), F.col(key).alias("key"), *[F.col(c).alias(f"order{i}") for i, c in enumerate(order)])
    placed = packed.repartitionByRange(*at).sortWithinPartitions(*at).select("row", "key", F.monotonically_increasing_id().alias("id"))
    # Written once: numbers stay the same whatever is computed again later.
    placed, _ = Durable(df.sparkSession, "chunks").keep(placed)
    placed = placed.withColumn("part", F.shiftright("id", 33))
    counts = placed.groupBy("key", "part").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("key").alias("k"), F.col("part").alias("p"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    joined = placed.join(offsets, F.col("key").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p")))
    number = F.col("offset") + F.col("id") - F.col("first")
    return joined.select("row", "key", number.alias("number")).withColumn("chunk", F.floor(F.col("number") / size).cast("bigint"))


def number_in_key(df: DataFrame, key: str, order: Sequence[str], size: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``_number`` (0-based rank within ``key`` by ``order``) and ``_chunk`` (``_number`` div ``size``).

    Rows with null ``key`` form a key of their own; nulls in ``order`` come first; rows equal in key and
    order are numbered in an arbitrary but fixed order. An empty table stays empty. Other columns pass through
    unchanged, whatever their names, but columns named like the two added ones are replaced.
    """
    kept = [F.col("row").getField(c).alias(c) for c in df.columns if c not in ("_number", "_chunk")]
    return _numbered(df, key, order, size).select(*kept, F.col("number").alias("_number"), F.col("chunk").alias("_chunk"))


def next_in_key(df: DataFrame, key: str, order: str, out: Column | str, name: str = "link", size: int = CHUNK_ROWS) -> DataFrame:
    """Adds ``name``: ``out`` of the next row of the same key by ``order``; null on the key's last row.

    Nulls, ties, empty input and other columns as in ``number_in_key``; a column named ``name`` is replaced.
    """
    value = F.col(out) if isinstance(out, str) else out
    rest = [c for c in df.columns if c != name]
    wrapped = df.select(F.struct(*[F.col(c) for c in rest]).alias("inner"), value.alias("value"), F.col(key).alias("key"), F.col(order).alias("order"))
    numbered = _numbered(wrapped, "key", ["order"], size).select("row", "key", "number", "chunk")
    inside = Window.partitionBy("key", "chunk").orderBy("number")
    linked = numbered.withColumn("next", F.lead(F.struct(F.col("row.value").alias("value"))).over(inside))
    # The first row of each later chunk is the successor of the last row of the chunk before.
    first = numbered.where((F.col("number") % size == 0) & (F.col("chunk") > 0)).select(
        F.col("key").alias("k"), (F.col("chunk") - 1).alias("before"), F.col("row.value").alias("boundary")
    )
    last = linked.where(F.col("next").isNull()).join(first, F.col("key").eqNullSafe(F.col("k")) & (F.col("chunk") == F.col("before")), "left")
    cols = [F.col("row.inner").getField(c).alias(c) for c in rest]
    return linked.where(F.col("next").isNotNull()).select(*cols, F.col("next.value").alias(name)).unionByName(last.select(*cols, F.col("boundary").alias(name)))


def by_read(df: DataFrame, key: str = "seq_id") -> DataFrame:
    """Rows over all shuffle partitions by ``key``. Grouping by it, or by it and more, then needs no further shuffle.

    The number of partitions is explicit, because adaptive execution joins small partitions into few, and tables that
    are small as reads are large as words.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def current_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row per ``key``: the one with the largest ``order``; nulls in ``order`` count as smallest.

    Of rows equal in key and order the one with the largest remaining columns is taken, so the result does not
    depend on the order of the input. Aggregated before the shuffle, so hot keys cost no more than others.
    Rows with null key are dropped.
    """
    rest = [c for c in df.columns if c != key and c not in order]
    best = F.max(F.struct(*order, *rest)).alias("_best")
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(best).select(key, *[F.col(f"_best.{c}").alias(c) for c in (*order, *rest)])


def members_with_successor(forest: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """Members of each cluster in order, each with its successor (null for the largest member).

    Takes ``forest`` rows (round, seq_id, cluster, saved_at and others); rows with null seq_id or a current row
    without cluster take no part. Result: cluster, seq_id, link.
    """
    current = current_rows(forest.select("seq_id", "round", "saved_at", "cluster"), "seq_id", ["round", "saved_at"])
    members = current.where(F.col("cluster").isNotNull()).select("cluster", "seq_id")
    return next_in_key(members, "cluster", "seq_id", "seq_id", "link", size)
