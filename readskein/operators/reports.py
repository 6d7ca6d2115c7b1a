"""Reports on clusterings and selections of reads."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .chunks import number_in_key


def sizes(clusters: DataFrame) -> DataFrame:
    """(cluster_id, size)"""
    return clusters.groupBy("cluster_id").agg(F.count("*").alias("size"))


def histogram(clusters: DataFrame) -> DataFrame:
    """(size, n_clusters)"""
    return sizes(clusters).groupBy("size").agg(F.count("*").alias("n_clusters"))


def mean_square(clusters: DataFrame) -> DataFrame:
    """(n_clusters_total, mean_sq): mean of squared sizes in whole numbers; null for no cluster."""
    n = F.count("*")
    total = F.sum(F.col("size") * F.col("size"))
    return sizes(clusters).agg(n.alias("n_clusters_total"), F.when(n > 0, F.floor(total / n)).cast("bigint").alias("mean_sq"))


def members(clusters: DataFrame) -> DataFrame:
    """(cluster_id, members): ascending lists."""
    return clusters.groupBy("cluster_id").agg(F.sort_array(F.collect_list("seq_id")).alias("members"))


def big_clusters(clusters: DataFrame, above: int) -> DataFrame:
    """(cluster_id, members) of clusters with more than so many reads."""
    return members(clusters).where(F.size("members") > above)


def thinned(clusters: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the given reads; clusters left empty vanish."""
    return clusters.join(ids.select("seq_id").distinct(), "seq_id", "left_anti")


def chosen(reads: DataFrame, ids: DataFrame) -> DataFrame:
    return reads.join(ids.select("seq_id").distinct(), "seq_id", "left_semi")


def parted(reads: DataFrame, ids: DataFrame) -> DataFrame:
    """All reads with column included: whether they are among the given ones."""
    marked = ids.select("seq_id").distinct().withColumn("included", F.lit(True))
    return reads.join(marked, "seq_id", "left").withColumn("included", F.coalesce("included", F.lit(False)))


def first_reads(reads: DataFrame, n: int) -> DataFrame:
    return reads.where(F.col("seq_id") < n)


def index_range(reads: DataFrame, first: int, last: int) -> DataFrame:
    return reads.where(F.col("seq_id").between(first, last))


def until_total(reads: DataFrame, target: int, size: int = 4096, sums_size: int = 65536) -> DataFrame:
    """The first reads, by id, up to the one with which their lengths first reach ``target``.

    The running sum is taken over ranges of ids: within a range in order, before it from the sums of ranges, and before
    these from the sums of ranges of ranges.
    """
    numbered = number_in_key(reads.select("seq_id", "len").withColumn("key", F.lit(0)), "key", ["seq_id"], size)
    sums = number_in_key(numbered.groupBy("_chunk").agg(F.sum("len").alias("n")).select("_chunk", "n").withColumnRenamed("_chunk", "chunk").withColumn("key", F.lit(0)), "key", ["chunk"], sums_size)
    # chunks of chunks are so few that their sums are run over in one task
    above = sums.groupBy(F.col("_chunk").alias("block")).agg(F.sum("n").alias("m"))
    above = above.select("block", F.coalesce(F.sum("m").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("_chunk").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sums.withColumn("inside", inside).join(above, F.col("_chunk") == F.col("block")).select("chunk", (F.col("base") + F.col("inside")).alias("before"))
    w = Window.partitionBy("_chunk").orderBy("_number").rowsBetween(Window.unboundedPreceding, -1)
    running = numbered.join(before, F.col("_chunk") == F.col("chunk")).withColumn("so_far", F.col("before") + F.coalesce(F.sum("len").over(w), F.lit(0)))
    return reads.join(running.where(F.col("so_far") < target).select("seq_id"), "seq_id", "left_semi")


def file_buckets(clusters: DataFrame, least: int) -> DataFrame:
    """(seq_id, bucket): reads of clusters with at least ``least`` members get the number of their cluster among
    these, counted from 0 by least read; the others -1 (they share one file)."""
    big = sizes(clusters).where(F.col("size") >= least)
    named = number_in_key(big.withColumn("key", F.lit(0)), "key", ["cluster_id"]).select("cluster_id", F.col("_number").alias("bucket"))
    return clusters.join(named, "cluster_id", "left").select("seq_id", F.coalesce("bucket", F.lit(-1)).cast("bigint").alias("bucket"))


def file_name(bucket: Column, prefix: str = "C", width: int = 6) -> Column:
    """C000001.fasta and so on; S0.fasta for the shared file."""
    return F.when(bucket < 0, F.lit("S0.fasta")).otherwise(F.concat(F.lit(prefix), F.lpad(bucket.cast("string"), width, "0"), F.lit(".fasta")))


def write_cluster_files(reads: DataFrame, clusters: DataFrame, least: int, path: str) -> None:
    """One folder of FASTA text for each cluster of at least ``least`` reads, and one for the others."""
    from ..functions.bases import fasta_record

    named = reads.join(file_buckets(clusters, least), "seq_id").withColumn("file", file_name(F.col("bucket")))
    named.select("file", fasta_record("id", "clone", "bases").alias("value")).repartition("file").write.partitionBy("file").text(path)


def split_members(clusters: DataFrame, least: int) -> DataFrame:
    """(file, seq_id): clusters of at least ``least`` members, numbered by least read; smaller ones are left out."""
    return file_buckets(clusters, least).where("bucket >= 0").select(F.col("bucket").alias("file"), "seq_id")


def size_bins(clusters: DataFrame, most: int, chunk: int = 100_000) -> DataFrame:
    """(cluster_id, bin): clusters in order of their id fill bins of at most ``most`` reads; one that doesn't fit opens
    the next bin, and a larger one has a bin of its own.

    Filling is sequential by nature. It runs over cluster sizes only, in chunks of ``chunk`` clusters: first each chunk
    tells, for every fill of the bin it may come to, how many bins it opens and how full it leaves the last; these maps
    are followed from chunk to chunk; then each chunk is filled from the bin it comes to.
    """
    sized = number_in_key(sizes(clusters).withColumn("key", F.lit(0)), "key", ["cluster_id"], chunk).select("cluster_id", "size", "_chunk", "_number")

    def passage(pdf):
        at, opened, fill = bin_passage(pdf.sort_values("_number")["size"].to_numpy(), most)
        return pd.DataFrame({"_chunk": pdf["_chunk"].iloc[:1].to_numpy(), "at": [at], "opened": [opened], "fill": [fill]})

    def entries(pdf):
        rows, bin, used = [], 0, 0
        for c, at, opened, fill in pdf.sort_values("_chunk")[["_chunk", "at", "opened", "fill"]].itertuples(index=False):
            rows.append((c, bin, used))
            k = int(np.searchsorted(at, min(used, max(most, 1)), side="right")) - 1
            bin, used = bin + int(opened[k]), int(fill[k]) + (used if opened[k] == 0 else 0)
        return pd.DataFrame(rows, columns=["_chunk", "bin", "used"])

    def fill(pdf):
        pdf = pdf.sort_values("_number")
        bins, used, at = [], int(pdf["used"].iloc[0]), int(pdf["bin"].iloc[0])
        for n in pdf["size"]:
            if used and used + n > most:
                at, used = at + 1, 0
            used += n
            bins.append(at)
        return pdf.assign(bin=bins)[["cluster_id", "bin"]]

    maps = sized.groupBy("_chunk").applyInPandas(passage, "_chunk bigint, at array<bigint>, opened array<bigint>, fill array<bigint>")
    begun = maps.withColumn("key", F.lit(0)).groupBy("key").applyInPandas(entries, "_chunk bigint, bin bigint, used bigint")
    return sized.join(begun, "_chunk").groupBy("_chunk").applyInPandas(fill, "cluster_id bigint, bin bigint")


def bin_passage(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(at, opened, fill): what a run of clusters of these sizes does to a bin of at most ``most`` reads. Entry k holds
    for fills from at[k] to below at[k + 1]: bins opened, and reads in the last one; of no bin, the reads added."""
    n, total = len(sizes), np.cumsum(sizes)
    before = total - sizes
    # the cluster that opens the bin after the one that cluster k opens
    following = np.maximum(np.searchsorted(total, before + most, side="right"), np.arange(n) + 1)
    opened, fill = np.ones(n + 1, np.int64), np.empty(n + 1, np.int64)
    opened[n], fill[n] = 0, total[-1]
    for k in range(n - 1, -1, -1):
        f = following[k]
        if f == n:
            fill[k] = total[-1] - before[k]
        else:
            opened[k], fill[k] = opened[f] + 1, fill[f]
    # a bin with fill u > 0 ends at the first cluster whose running total exceeds most - u; an empty one takes any cluster
    ends = np.arange(min(n, int(np.searchsorted(total, most - 1, side="right"))), -1, -1)
    least = np.maximum(1, most + 1 - np.append(total, most)[ends])
    empty = (0, fill[0]) if following[0] == n else (opened[0] - 1, fill[0])
    at, opened, fill = np.append(0, least), np.append(empty[0], opened[ends]), np.append(empty[1], fill[ends])
    new = np.append(True, (opened[1:] != opened[:-1]) | (fill[1:] != fill[:-1]))
    return at[new], opened[new], fill[new]


def word_statistics(words: DataFrame) -> DataFrame:
    """(n_words, mean_block, mean_sq_block, max_block) of a column word: distinct words, mean and mean square of their
    numbers of occurrences (6 digits), and the largest."""
    per = words.groupBy("word").agg(F.count("*").alias("n"))
    return per.agg(F.count("*").alias("n_words"), F.round(F.avg("n"), 6).alias("mean_block"), F.round(F.avg(F.col("n").cast("double") * F.col("n")), 6).alias("mean_sq_block"), F.max("n").alias("max_block"))


def distance_histogram(scores: DataFrame, width: int = 10, buckets: int = 40) -> DataFrame:
    """(bucket, n) of distances in steps of ``width``; what lies beyond is in the last bucket."""
    return scores.where("dist is not null").groupBy(F.least(F.floor(F.col("dist") / width), F.lit(buckets - 1)).alias("bucket")).agg(F.count("*").alias("n"))


def gap_run(hits: Column, gap: int = 6) -> Column:
    """Longest run of an array of 0 and 1 in which fewer than ``gap`` zeros stand together: number of ones in it."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("zeros"), F.lit(0).alias("best"))

    def step(s, h):
        zeros = F.when(h > 0, 0).otherwise(s["zeros"] + 1)
        run = F.when(zeros >= gap, 0).otherwise(s["run"] + F.when(h > 0, 1).otherwise(0))
        return F.struct(run.alias("run"), zeros.alias("zeros"), F.greatest(s["best"], run).alias("best"))

    return F.aggregate(hits, zero, step, lambda s: s["best"])


def counters(scores: DataFrame, n_reads: DataFrame, config) -> DataFrame:
    """(prefilter_calls, full_calls, distance_calls, matches, half_square) of a run: strands sampled, strands whose
    windowed hits were asked for, distances computed, strands within theta, and n * n / 2 of n_reads (one row, n)."""
    from .distance import settled

    c = settled(config)
    theta = F.floor(F.col("window") * c.theta / c.window_len) if c.theta >= 0 else F.lit(c.theta)
    names = ("prefilter_calls", "full_calls", "distance_calls", "matches")
    n = scores.agg(F.count("*").alias("prefilter_calls"), F.count_if(F.col("sample") > c.sample_thresh).alias("full_calls"), F.count("dist").alias("distance_calls"), F.count_if(F.col("dist") <= theta).alias("matches"))
    nothing = F.lit(None).cast("bigint")
    half = n_reads.select(*[nothing.alias(c) for c in names], F.floor(F.col("n") * F.col("n") / 2).cast("bigint").alias("half_square"))
    return n.withColumn("half_square", nothing).unionByName(half).agg(*[F.max(c).alias(c) for c in (*names, "half_square")])
