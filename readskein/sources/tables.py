"""Reads and matches as the tables hold them, brought into shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bases import clone_name, steady_bases
from ..operators.chunks import by_read, current_rows


def clean_reads(reads: DataFrame) -> DataFrame:
    """(seq_id, id, clone, bases, len): one row per seq_id, capitals only, other characters replaced steadily.

    Of several rows the largest non-null value of each column counts; null bases are empty; rows without seq_id are
    dropped. A null id becomes the number of the read; a clone without letter or digit is null.
    """
    one = by_read(reads.where(F.col("seq_id").isNotNull()).select("seq_id", "id", "clone", "bases")).groupBy("seq_id").agg(F.max("id").alias("id"), F.max(clone_name("clone")).alias("clone"), F.max("bases").alias("bases"))
    bases = steady_bases(F.coalesce("bases", F.lit("")), "seq_id")
    return one.select("seq_id", F.coalesce("id", F.col("seq_id").cast("string")).alias("id"), "clone", bases.alias("bases")).withColumn("len", F.length("bases"))


def clean_edges(edges: DataFrame, *reads: DataFrame) -> DataFrame:
    """(i, j, strand), i < j and distinct: matches between known reads; strand is -1 or 1, and 1 where missing.

    A match with both strands has two rows. Self matches and rows with null or unknown ends are dropped.
    """
    known = reads[0].select("seq_id")
    for r in reads[1:]:
        known = known.unionByName(r.select("seq_id"))
    known = known.distinct()
    strand = F.when(F.col("strand") < 0, -1).otherwise(1)
    both = edges.where("i is not null and j is not null and i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), strand.alias("strand")).distinct()
    return both.join(known, F.col("i") == F.col("seq_id"), "left_semi").join(known, F.col("j") == F.col("seq_id"), "left_semi")


def forest_clustering(forest: DataFrame, round: int | None = None) -> DataFrame:
    """(seq_id, cluster_id): each read's root in its current row, or its latest row of one round; rows without root
    are left out."""
    rows = forest if round is None else forest.where(F.col("round") == round)
    return current_rows(rows.select("seq_id", "round", "saved_at", "cluster"), "seq_id", ["round", "saved_at"]).where("cluster is not null").select("seq_id", F.col("cluster").alias("cluster_id"))


def asked_reads(progopts: DataFrame, reads: DataFrame) -> DataFrame:
    """(seq_id): the distinct known reads that past runs were asked to show."""
    return progopts.select(F.col("index").alias("seq_id")).distinct().join(reads.select("seq_id").distinct(), "seq_id", "left_semi")
