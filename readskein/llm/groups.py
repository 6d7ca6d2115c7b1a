"""Consolidating pairwise matches into groups: large-star and small-star rewrites until unchanged."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Durable


def _pairs(df: DataFrame, a: Column | str, b: Column | str) -> DataFrame:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return (
        df.select(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
        .where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the least of the node and its neighbours."""
    least = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
    return edges.join(least, F.col("lo") == F.col("node"), "left").select(F.coalesce("least", "lo").alias("lo"), "hi")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its neighbours below are linked to the least of these neighbours."""
    least = edges.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("least"))
    joined = edges.join(least, F.col("hi") == F.col("node")).select("lo", "hi", "least")
    both = joined.select(F.explode(F.array("lo", "hi")).alias("hi"), F.col("least").alias("lo"))
    return both.where(F.col("lo") != F.col("hi")).select("lo", "hi").distinct()


def connected_groups(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, group_id) for each node with a link to another; group_id is the least node of its component.

    Nulls and links of a node with itself link nothing; repeated rows and both directions are one link; an empty
    table gives an empty result. Each round is a large-star and a small-star, both joins on aggregates that are
    combined before the shuffle; a round's result is written to the shared folder, which cuts the lineage, and the
    round before is removed. It ends when a round leaves the edges unchanged; not ending within ``max_rounds``
    (rounds grow as the logarithm of the component's size) is an error, never a partial result.
    """
    durable = Durable(links.sparkSession, "groups")
    edges, path = durable.keep(_pairs(links, a, b).distinct())
    mark = _fingerprint(edges)
    for _ in range(max_rounds):
        following, next_path = durable.keep(_small_star(_large_star(edges)))
        following_mark = _fingerprint(following)
        durable.drop(path)
        edges, path = following, next_path
        if following_mark == mark:
            members = edges.select(F.col("hi").alias("node"), F.col("lo").alias("group_id"))
            roots = edges.select(F.col("lo").alias("node"), F.col("lo").alias("group_id")).distinct()
            return members.unionByName(roots)
        mark = following_mark
    raise RuntimeError(f"links still changed after {max_rounds} rounds")


def _fingerprint(edges: DataFrame) -> tuple:
    """Row count and two sums of row hashes; the rows are distinct, so equal sets have equal marks."""
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("lo", "hi").cast("decimal(20,0)")), F.sum(F.hash("hi", "lo").cast("bigint"))
    ).first()
    return tuple(row)


def clone_links(reads: DataFrame, id: str = "seq_id", clone: str = "clone") -> DataFrame:
    """(a, b): each read with the least read of the same clone.

    Clones are equal without surrounding blanks and ignoring case; a null clone or one without letter or digit
    is missing and links nothing.
    """
    named = reads.select(F.col(id).alias("b"), F.lower(F.regexp_replace(clone, r"^\s+|\s+$", "")).alias("clone")).where(
        F.col("b").isNotNull() & F.col("clone").rlike(r"[\p{L}\p{N}]")
    ).distinct()
    least = named.groupBy("clone").agg(F.min("b").alias("a"), F.max("b").alias("top")).where("a < top").drop("top")
    return named.join(least, "clone").where("a <> b").select("a", "b")


def read_groups(reads: DataFrame, reads2: DataFrame, edges: DataFrame, forest: DataFrame) -> DataFrame:
    """(seq_id, group_id) of all reads linked with another read over edges, forest rows or clones.

    Links whose end is null, -1 or no known read link nothing. Ids known: those of ``reads`` and ``reads2``.
    """
    known = reads.select("seq_id").unionByName(reads2.select("seq_id")).where(F.col("seq_id").isNotNull()).distinct()
    ends = F.explode(F.array("cluster", "match", "next")).alias("other")
    raw = [
        _pairs(edges, "i", "j"),
        _pairs(forest.select("seq_id", ends), "seq_id", "other"),
    ]
    raw = reduce(DataFrame.unionByName, raw).where("lo >= 0").distinct()
    real = raw.join(known, F.col("hi") == F.col("seq_id"), "left_semi").join(known, F.col("lo") == F.col("seq_id"), "left_semi")
    clones = clone_links(reads.select("seq_id", "clone").unionByName(reads2.select("seq_id", "clone")))
    links = real.select(F.col("lo").alias("a"), F.col("hi").alias("b")).unionByName(clones)
    return connected_groups(links).select(F.col("node").alias("seq_id"), "group_id")
