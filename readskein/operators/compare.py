"""How far two clusterings agree."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _both(a: DataFrame, b: DataFrame, missing: bool) -> DataFrame:
    left = a.select("seq_id", F.col("cluster_id").alias("ca"))
    right = b.select("seq_id", F.col("cluster_id").alias("cb"))
    if not missing:
        return left.join(right, "seq_id").select("seq_id", "ca", "cb")
    alone = (-F.col("seq_id") - 1).alias("alone")  # a cluster of its own that no other read has
    full = left.join(right, "seq_id", "full").withColumn("alone", alone)
    return full.select("seq_id", F.coalesce("ca", "alone").alias("ca"), F.coalesce("cb", "alone").alias("cb"))


def pair_counts(a: DataFrame, b: DataFrame, missing_alone: bool = False) -> DataFrame:
    """(tp, fp, fn, tn): pairs of reads together in both, in a only, in b only, in neither, from counts of shared
    clusters. Reads of one clustering only are left out, or with ``missing_alone`` clusters of their own in the other."""
    both = _both(a, b, missing_alone)
    cross = both.groupBy("ca", "cb").agg(F.count("*").alias("n"))
    sides = [("tp", cross), ("pa", cross.groupBy("ca").agg(F.sum("n").alias("n"))), ("pb", cross.groupBy("cb").agg(F.sum("n").alias("n")))]
    pairs = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint")
    sums = reduce(DataFrame.unionByName, [d.agg(pairs.alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("all")).withColumn("of", F.lit(k)) for k, d in sides])
    one = sums.agg(*[F.max(F.when(F.col("of") == k, F.col("v"))).alias(k) for k, _ in sides], F.max("all").alias("all"))
    tn = (F.col("all") * (F.col("all") - 1) / 2).cast("bigint") - F.col("pa") - F.col("pb") + F.col("tp")
    return one.select("tp", (F.col("pa") - F.col("tp")).alias("fp"), (F.col("pb") - F.col("tp")).alias("fn"), tn.alias("tn"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, F.round(a.cast("double") / b, 6))


def pair_indices(counts: DataFrame) -> DataFrame:
    """Adds ji, ri, se, sp, ppv, npv, cc, rounded to 6 digits; null where the denominator is 0."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return counts.withColumns({
        "ji": _ratio(tp, tp + fp + fn), "ri": _ratio(tp + tn, tp + fp + fn + tn), "se": _ratio(tp, tp + fn), "sp": _ratio(tn, tn + fp),
        "ppv": _ratio(tp, tp + fp), "npv": _ratio(tn, tn + fn),
        "cc": _ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * (tn + fn) * (tp + fn) * (tn + fp))),
    })


def index_table(clusterings: dict[str, DataFrame], index: str = "ri") -> DataFrame:
    """(name, one column for each clustering): an index of each pair of clusterings."""
    rows = [
        pair_indices(pair_counts(clusterings[a], clusterings[b])).select(F.lit(a).alias("name"), F.lit(b).alias("other"), F.col(index).alias("value"))
        for a in clusterings for b in clusterings
    ]
    return reduce(DataFrame.unionByName, rows).groupBy("name").pivot("other", list(clusterings)).agg(F.first("value"))


def pair_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j): pairs together in a and apart in b, of reads that both hold.

    Only the clusters of a that b splits are expanded.
    """
    both = _both(a, b, False)
    split = both.groupBy("ca").agg(F.min("cb").alias("x"), F.max("cb").alias("y")).where("x < y").select("ca")
    rows = both.join(split, "ca", "left_semi")
    other = rows.select("ca", F.col("seq_id").alias("j"), F.col("cb").alias("cj"))
    return rows.select("ca", F.col("seq_id").alias("i"), "cb").join(other, "ca").where("i < j and cb <> cj").select("i", "j")


def ticked_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(i, j): for each read that b parts from its a-cluster's least read, that pair once; a short form of the difference."""
    both = _both(a, b, False)
    first = both.groupBy("ca").agg(F.min(F.struct("seq_id", "cb")).alias("f"))
    return both.join(first, "ca").where("cb <> f.cb").select(F.col("f.seq_id").alias("i"), F.col("seq_id").alias("j"))


def quality(flagged: DataFrame, matched: DataFrame, n_pairs: DataFrame) -> DataFrame:
    """(tp, fp, fn, tn) of a filter: pairs flagged (i, j) against pairs matched (i, j) out of n_pairs (one row, n)."""
    f = flagged.select("i", "j").distinct().withColumn("f", F.lit(1))
    m = matched.select("i", "j").distinct().withColumn("m", F.lit(1))
    has_f, has_m, n = F.col("f").isNotNull(), F.col("m").isNotNull(), F.lit(None).cast("bigint")
    got = f.join(m, ["i", "j"], "full").agg(F.count_if(has_f & has_m).alias("tp"), F.count_if(has_f & ~has_m).alias("fp"), F.count_if(~has_f & has_m).alias("fn"))
    nothing = F.lit(None).cast("bigint")
    both = got.withColumn("n", n).unionByName(n_pairs.select(nothing.alias("tp"), nothing.alias("fp"), nothing.alias("fn"), "n"))
    one = both.agg(*[F.max(c).alias(c) for c in ("tp", "fp", "fn", "n")])
    return one.select("tp", "fp", "fn", (F.col("n") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"))
