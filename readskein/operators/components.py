"""Single-linkage clusters as connected components, with orientation and with reads that must stay apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import Durable


def low_high(df: DataFrame, a: Column | str, b: Column | str) -> DataFrame:
    """(lo, hi): the ends of each link in order; nulls and links of a node with itself are left out."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    ends = df.select(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")).where("a is not null and b is not null and a <> b")
    return ends.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))


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


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node is either a centre or has one link to a centre. Both rewrites leave exactly such edges as they are."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("lo").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("high")), F.struct(F.col("hi").alias("node"), F.lit(0).alias("low"), F.lit(1).alias("high")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.max("low").alias("low"), F.sum("high").alias("high")).where("high > 1 or (high > 0 and low > 0)").isEmpty()


def components(links: DataFrame, a: str = "i", b: str = "j", max_rounds: int | None = None) -> DataFrame:
    """(node, root) for each node with a link to another; root is the least node of its component.

    Large-star and small-star rewrites alternate until they leave the links unchanged, when each node is linked with
    the least of its component and nothing else. Both are joins on aggregates that are combined before the shuffle, so
    a node with most of the links is no longer task. Every round is written to the shared folder and the one before
    removed. Nulls and links of a node with itself link nothing; repeated rows and both directions are one link; an
    empty table gives an empty result. Rounds grow as the logarithm of the components; with ``max_rounds`` not ending
    within them is an error, never a partial result.
    """
    durable = Durable(links.sparkSession, "components")
    edges, path = durable.keep(low_high(links, a, b).distinct())
    rounds = 0
    while not _all_stars(edges):
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"links still changed after {max_rounds} rounds")
        following, next_path = durable.keep(_small_star(_large_star(edges)))
        durable.drop(path)
        edges, path, rounds = following, next_path, rounds + 1
    members = edges.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return members.unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())


def min_labels(edges: DataFrame, a: str = "i", b: str = "j", nodes: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(seq_id, cluster_id): each node and the least node of its component.

    Nodes are the ends of the edges and those of ``nodes`` (seq_id), which may be alone. Ends of edges are as in
    ``components``.
    """
    out = components(edges, a, b, max_rounds).select(F.col("node").alias("seq_id"), F.col("root").alias("cluster_id"))
    if nodes is None:
        return out
    alone = nodes.select("seq_id").distinct().join(out, "seq_id", "left_anti").select("seq_id", F.col("seq_id").alias("cluster_id"))
    return out.unionByName(alone)


def signed_labels(edges: DataFrame, nodes: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """(seq_id, cluster_id, orient) over edges (i, j, strand): orient is the product of strands on a path to the
    least read, which has 1. In a component where paths disagree every read has 1.

    Each read stands twice, as 2 id and, turned, as 2 id + 1; a match joins equal sides, one with strand -1 opposite
    ones. The least of a read's component is then the least read of its cluster, turned or not. Ids must be below 2^62.
    """
    turned = F.when(F.col("strand") < 0, 1).otherwise(0)
    sides = edges.where("i is not null and j is not null and i <> j").select("i", "j", turned.alias("t"), F.explode(F.array(F.lit(0), F.lit(1))).alias("side"))
    both = sides.select((2 * F.col("i") + F.col("side")).alias("i"), (2 * F.col("j") + (F.col("side") + F.col("t")) % 2).alias("j"))
    # integer halves also of negative ids
    own = components(both, max_rounds=max_rounds).where(F.pmod("node", F.lit(2)) == 0)
    out = own.select(F.shiftright("node", 1).alias("seq_id"), F.shiftright("root", 1).alias("cluster_id"), F.when(F.pmod("root", F.lit(2)) == 0, 1).otherwise(-1).alias("orient"))
    if nodes is None:
        return out
    alone = nodes.select("seq_id").distinct().join(out, "seq_id", "left_anti")
    return out.unionByName(alone.select("seq_id", F.col("seq_id").alias("cluster_id"), F.lit(1).alias("orient")))


def apart_labels(edges: DataFrame, fixed: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(seq_id, cluster_id) where no cluster holds two reads of ``fixed`` (seq_id).

    The result is that of merging matches one by one in the order (i, j, strand descending) and leaving out those
    that would join two clusters with a fixed read each. That is Kruskal's forest of the graph whose fixed reads
    hang on a common root, so it is found in parallel: in each round every tree takes its first match that leads
    outside (Boruvka), and the root's branches are the clusters. Components with at most one fixed read are left alone.
    """
    spark = edges.sparkSession
    durable = Durable(spark, "apart")
    fixed, _ = durable.keep(fixed.select("seq_id").where("seq_id is not null").distinct())
    free, _ = durable.keep(min_labels(edges, nodes=nodes.select("seq_id").unionByName(fixed) if nodes is not None else fixed))
    several = free.join(fixed, "seq_id", "left_semi").groupBy("cluster_id").count().where("count > 1").select("cluster_id")
    inner = free.join(several, "cluster_id", "left_semi")
    order = F.struct("i", "j", (-F.col("strand")).alias("d"))
    ranked = edges.where("i <> j").select("i", "j", order.alias("at")).join(inner.select(F.col("seq_id").alias("i")), "i", "left_semi")
    ranked, _ = durable.keep(ranked.groupBy("i", "j").agg(F.min("at").alias("at")))
    # the root of all fixed reads is their least id
    root = F.lit(fixed.agg(F.min("seq_id")).first()[0]).cast("bigint")
    trees, _ = durable.keep(inner.join(fixed.withColumn("f", F.lit(True)), "seq_id", "left").select("seq_id", F.when(F.col("f"), root).otherwise(F.col("seq_id")).alias("tree")))
    taken = None
    while True:
        ends = ranked.join(trees.select(F.col("seq_id").alias("i"), F.col("tree").alias("ti")), "i").join(trees.select(F.col("seq_id").alias("j"), F.col("tree").alias("tj")), "j").where("ti <> tj")
        first = ends.select(F.explode(F.array("ti", "tj")).alias("tree"), "at", "ti", "tj").groupBy("tree").agg(F.min(F.struct("at", "ti", "tj")).alias("m")).select("m.*").distinct()
        first, _ = durable.keep(first)
        if not first.limit(1).count():
            break
        chosen = first.select(F.col("at.i").alias("i"), F.col("at.j").alias("j"))
        taken = chosen if taken is None else taken.unionByName(chosen)
        joined = min_labels(first, "ti", "tj").select(F.col("seq_id").alias("tree"), F.col("cluster_id").alias("new"))
        trees, _ = durable.keep(trees.join(joined, "tree", "left").select("seq_id", F.coalesce("new", "tree").alias("tree")))
    outer = free.join(several, "cluster_id", "left_anti").select("seq_id", "cluster_id")
    if taken is None:
        return outer.unionByName(inner.select("seq_id", F.col("seq_id").alias("cluster_id")))
    return outer.unionByName(min_labels(taken, nodes=inner.select("seq_id")).join(inner.select("seq_id"), "seq_id", "left_semi"))
