"""Clustering of reads: from candidate pairs over filters and distance to connected components, and what refines it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ClusterConfig
from ..session import Durable
from .components import apart_labels, min_labels
from .distance import matching, scored_pairs
from .pairs import candidates, filtered_pairs, in_blocks


def match_edges(reads: DataFrame, config: ClusterConfig, mode: str = "candidates", left: DataFrame | None = None, right: DataFrame | None = None) -> DataFrame:
    """(i, j, strand, dist) of all matching pairs; ``mode`` is candidates (shared long words) or all_pairs (every pair
    that the sample filter lets through; those that the windowed hits stop are left out where samples are counted)."""
    if mode == "candidates":
        pairs = candidates(reads, config, left, right)
    elif mode == "all_pairs":
        pairs = filtered_pairs(reads, config, left, right)
    else:
        raise ValueError(f"unknown mode {mode}")
    pairs, _ = Durable(reads.sparkSession, "pairs").keep(pairs.select("i", "j"))
    return matching(scored_pairs(pairs, reads, config), config)


def star_edges(clusters: DataFrame) -> DataFrame:
    """(i, j): each member of a clustering with the least member of its cluster."""
    least = clusters.groupBy("cluster_id").agg(F.min("seq_id").alias("i"))
    return clusters.join(least, "cluster_id").where("i <> seq_id").select("i", F.col("seq_id").alias("j"))


def clone_edges(reads: DataFrame) -> DataFrame:
    """(i, j): each read with the least read of its (clean) clone; null clones link nothing."""
    named = reads.where(F.col("clone").isNotNull())
    least = named.groupBy("clone").agg(F.min("seq_id").alias("i"))
    return named.join(least, "clone").where("i <> seq_id").select("i", F.col("seq_id").alias("j"))


def active_reads(reads: DataFrame, constraints: DataFrame | None) -> DataFrame:
    """(seq_id) of the reads that take part: of cluster-only and reset the listed ones, of cluster-others and
    reset-others the rest; all of them where none of these directives is given."""
    ids = reads.select("seq_id").distinct()
    if constraints is None:
        return ids
    of = lambda *names: constraints.where(F.col("directive").isin(*names)).select("seq_id")
    only = of("cluster-only", "reset")
    if only.limit(1).count():
        ids = ids.join(only.distinct(), "seq_id", "left_semi")
    return ids.join(of("cluster-others", "reset-others").where("seq_id is not null").distinct(), "seq_id", "left_anti")


def reset_clusters(init: DataFrame, listed: DataFrame) -> DataFrame:
    """The clustering after the listed reads have left their clusters, each for one of its own.

    What is left of a cluster is named by its least read, which keeps it apart from a read that gave it its name.
    """
    stay = init.join(listed.select("seq_id").distinct(), "seq_id", "left_anti").select("seq_id", "cluster_id")
    least = stay.groupBy("cluster_id").agg(F.min("seq_id").alias("least"))
    stay = stay.join(least, "cluster_id").select("seq_id", F.col("least").alias("cluster_id"))
    gone = init.join(listed.select("seq_id").distinct(), "seq_id", "left_semi").select("seq_id", F.col("seq_id").alias("cluster_id"))
    return stay.unionByName(gone)


def cluster(reads: DataFrame, config: ClusterConfig | None = None, mode: str = "candidates", init: DataFrame | None = None, constraints: DataFrame | None = None, clone_link: bool = False, edges: DataFrame | None = None) -> DataFrame:
    """(seq_id, cluster_id) of all reads; a cluster is named by its least read.

    ``edges`` (i, j, strand) stands for the match search where matches are known. ``init`` (seq_id, cluster_id) is kept,
    but for reads that are reset. Reads fixed by ``constraints`` never share a cluster.
    """
    config = config or ClusterConfig()
    active = active_reads(reads, constraints)
    if edges is None:
        edges = match_edges(reads.join(active, "seq_id", "left_semi"), config, mode)
    elif constraints is not None:
        edges = edges.join(active.select(F.col("seq_id").alias("i")), "i", "left_semi").join(active.select(F.col("seq_id").alias("j")), "j", "left_semi")
    links = edges.select("i", "j", F.col("strand").cast("int").alias("strand"))
    if init is not None:
        if constraints is not None:
            init = reset_clusters(init, constraints.where(F.col("directive").isin("reset", "reset-others")).select("seq_id"))
        links = star_edges(init).withColumn("strand", F.lit(1)).unionByName(links)
    if clone_link:
        links = links.unionByName(clone_edges(reads.join(active, "seq_id", "left_semi")).withColumn("strand", F.lit(1)))
    fixed = constraints.where(F.col("directive") == "fix").select("seq_id") if constraints is not None else None
    if fixed is not None and fixed.limit(1).count():
        return apart_labels(links, fixed, reads.select("seq_id"))
    return min_labels(links, nodes=reads.select("seq_id"))


def add(old: DataFrame, clusters: DataFrame, new: DataFrame, config: ClusterConfig | None = None, edges: DataFrame | None = None) -> DataFrame:
    """The clustering of old and new reads: the old one is kept, and only pairs with a new read are compared.

    ``new`` must have ids above those of ``old``; with ``edges`` the matches of such pairs are given.
    """
    config = config or ClusterConfig()
    both = old.unionByName(new)
    if edges is None:
        edges = match_edges(both, config, right=new.select("seq_id"))
    return min_labels(star_edges(clusters).unionByName(edges.select("i", "j")), nodes=both.select("seq_id"))


def merge(first: DataFrame, first_clusters: DataFrame, second: DataFrame, second_clusters: DataFrame, shift: int, config: ClusterConfig | None = None, edges: DataFrame | None = None) -> DataFrame:
    """The clustering of two files with given clusterings: only pairs across the files are compared. The second file's
    ids are raised by ``shift``, which must exceed the first file's ids."""
    config = config or ClusterConfig()
    moved = second.withColumn("seq_id", F.col("seq_id") + shift)
    moved_clusters = second_clusters.select((F.col("seq_id") + shift).alias("seq_id"), (F.col("cluster_id") + shift).alias("cluster_id"))
    both = first.unionByName(moved)
    if edges is None:
        edges = match_edges(both, config, left=first.select("seq_id"), right=moved.select("seq_id"))
    links = star_edges(first_clusters).unionByName(star_edges(moved_clusters)).unionByName(edges.select("i", "j"))
    return min_labels(links, nodes=both.select("seq_id"))


def recluster(reads: DataFrame, clusters: DataFrame, config: ClusterConfig | None = None, edges: DataFrame | None = None) -> DataFrame:
    """The clustering of each given cluster by itself, usually with stricter parameters. ``edges`` may give matches, of
    which those within a cluster count. Candidates come from shared words, not from all pairs of a large cluster."""
    config = config or ClusterConfig()
    if edges is None:
        edges = match_edges(reads.join(clusters.select("seq_id"), "seq_id", "left_semi"), config)
    a = clusters.select(F.col("seq_id").alias("i"), F.col("cluster_id").alias("ci"))
    b = clusters.select(F.col("seq_id").alias("j"), F.col("cluster_id").alias("cj"))
    inside = edges.select("i", "j").join(a, "i").join(b, "j").where("ci = cj").select("i", "j")
    return min_labels(inside, nodes=clusters.select("seq_id"))


def adjacency(reads: DataFrame, edges: DataFrame, symmetric: bool = True) -> DataFrame:
    """(seq_id, neighbours) of every read: with ``symmetric`` all neighbours and itself, else the later ones only."""
    pairs = edges.select(F.col("i").alias("seq_id"), F.col("j").alias("n"))
    if symmetric:
        pairs = pairs.unionByName(edges.select(F.col("j").alias("seq_id"), F.col("i").alias("n"))).unionByName(reads.select("seq_id", F.col("seq_id").alias("n")))
    lists = pairs.groupBy("seq_id").agg(F.sort_array(F.collect_set("n")).alias("neighbours"))
    return reads.select("seq_id").distinct().join(lists, "seq_id", "left").select("seq_id", F.coalesce("neighbours", F.array().cast("array<bigint>")).alias("neighbours"))


def linked_reads(reads: DataFrame, config: ClusterConfig, mode: str = "candidates", symmetric: bool = True) -> DataFrame:
    """``adjacency`` from a search of its own."""
    return adjacency(reads, match_edges(reads, config, mode), symmetric)


def compared_clusters(reads: DataFrame, first: DataFrame, second: DataFrame, config: ClusterConfig | None = None) -> DataFrame:
    """(i, j, d2, d2_rc): the distances on both strands of each read of one list (seq_id) and each of another. A read in
    both lists is left out with itself; unknown reads have no row. The lists meet in blocks."""
    config = (config or ClusterConfig()).but(distance="d2", rc_check=True)
    both = first.select("seq_id").distinct().withColumn("side", F.lit(0)).unionByName(second.select("seq_id").distinct().withColumn("side", F.lit(1)))
    met = in_blocks(both.withColumn("all", F.lit(0)), "all").where("one.side = 0 and two.side = 1 and one.seq_id <> two.seq_id")
    pairs, _ = Durable(reads.sparkSession, "pairs").keep(met.select(F.col("one.seq_id").alias("i"), F.col("two.seq_id").alias("j")))
    scores = scored_pairs(pairs, reads, config, filtered=False)
    return scores.groupBy("i", "j").agg(F.max(F.when(F.col("strand") > 0, F.col("dist"))).alias("d2"), F.max(F.when(F.col("strand") < 0, F.col("dist"))).alias("d2_rc"))


def checked_ids(reads: DataFrame, ids: DataFrame, fixed: int, config: ClusterConfig | None = None) -> DataFrame:
    """Each listed read (seq_id) compared with the read ``fixed``, as in ``compared_clusters``."""
    one = reads.select("seq_id").where(F.col("seq_id") == fixed)
    return compared_clusters(reads, ids, one, config)


def witnesses(edges: DataFrame) -> DataFrame:
    """(seq_id, witness): the least read that each read matches."""
    both = edges.select(F.col("i").alias("seq_id"), F.col("j").alias("w")).unionByName(edges.select(F.col("j").alias("seq_id"), F.col("i").alias("w")))
    return both.groupBy("seq_id").agg(F.min("w").alias("witness"))


def winnow(reads: DataFrame, config: ClusterConfig, word_thresholds: list[int], big: int = 100, most: int | None = None) -> DataFrame:
    """(seq_id, cluster_id) by a schedule of decreasing thresholds of common words.

    After each step clusters of at least ``big`` reads are set aside; a step whose largest cluster exceeds ``most`` is
    undone and the schedule ends there. The loop is over parameters; no rows come to the driver.
    """
    durable = Durable(reads.sparkSession, "winnow")
    done, _ = durable.keep(reads.select("seq_id", F.col("seq_id").alias("cluster_id")))
    rest = reads
    for h in sorted(word_thresholds, reverse=True):
        open_ = done.join(rest.select("seq_id"), "seq_id", "left_semi")
        step, _ = durable.keep(cluster(rest, config.but(common_word=h), init=open_))
        sizes = step.groupBy("cluster_id").count()
        if most is not None and sizes.where(F.col("count") > most).limit(1).count():
            break
        kept = done.join(rest.select("seq_id"), "seq_id", "left_anti")
        done, _ = durable.keep(kept.unionByName(step))
        large = step.join(sizes.where(F.col("count") >= big), "cluster_id", "left_semi").select("seq_id")
        rest, _ = durable.keep(rest.join(large, "seq_id", "left_anti"))
    return done
