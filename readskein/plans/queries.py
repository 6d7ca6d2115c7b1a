"""Queries of the core, by name. Each takes a session and the folder of the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRESETS, ClusterConfig
from ..functions import bases as B
from ..operators import cluster as C
from ..operators import compare as M
from ..operators import reports as R
from ..operators.chunks import members_with_successor
from ..operators.components import apart_labels, min_labels, signed_labels
from ..operators.distance import scored_pairs
from ..operators.pairs import candidates, ranged, sample_hits, stepped
from ..session import Durable, table
from ..sources import files as S
from ..sources.tables import asked_reads, clean_edges, clean_reads, forest_clustering

Query = Callable[[SparkSession, str], DataFrame]
_ALL: dict[str, Query] = {}
CONFIG = ClusterConfig()


def query(f: Query) -> Query:
    _ALL[f.__name__] = f
    return f


def reads_of(spark: SparkSession, base: str) -> DataFrame:
    return clean_reads(table(spark, base, "reads"))


def reads2_of(spark: SparkSession, base: str) -> DataFrame:
    return clean_reads(table(spark, base, "reads2"))


def all_reads(spark: SparkSession, base: str) -> DataFrame:
    return reads_of(spark, base).unionByName(reads2_of(spark, base))


def ids_of(spark: SparkSession, base: str) -> DataFrame:
    """(seq_id) of the reads of both tables."""
    both = table(spark, base, "reads").select("seq_id").unionByName(table(spark, base, "reads2").select("seq_id"))
    return both.where("seq_id is not null").distinct()


def edges_of(spark: SparkSession, base: str) -> DataFrame:
    return clean_edges(table(spark, base, "edges"), table(spark, base, "reads"), table(spark, base, "reads2"))


def current(spark: SparkSession, base: str) -> DataFrame:
    return forest_clustering(table(spark, base, "forest"))


def first_round(spark: SparkSession, base: str) -> DataFrame:
    return forest_clustering(table(spark, base, "forest"), 1)


def asked(spark: SparkSession, base: str) -> DataFrame:
    return asked_reads(table(spark, base, "progopts"), ids_of(spark, base))


def directive(spark: SparkSession, base: str, name: str) -> DataFrame:
    return asked(spark, base).select(F.lit(name).alias("directive"), "seq_id")


def candidate_pairs(spark: SparkSession, base: str) -> DataFrame:
    """The candidates of all reads, written once so that no later step searches again."""
    return Durable(spark, "candidates").keep(candidates(reads_of(spark, base), CONFIG).select("i", "j"))[0]


# Scans, projections, words


@query
def reads_scan(spark: SparkSession, base: str) -> DataFrame:
    return reads_of(spark, base)


@query
def reads_count_bases(spark: SparkSession, base: str) -> DataFrame:
    return reads_of(spark, base).agg(F.count("*").alias("n_reads"), F.sum("len").cast("bigint").alias("n_bases"))


@query
def base_composition(spark: SparkSession, base: str) -> DataFrame:
    counts = [F.sum(F.col("len") - F.length(F.replace("bases", F.lit(b)))).cast("bigint").alias(b) for b in "ACGT"]
    one = reads_of(spark, base).agg(*counts)
    return one.select(F.explode(F.array(*[F.struct(F.lit(b).alias("base"), B.base_code(F.lit(b)).alias("code"), F.col(b).alias("n")) for b in "ACGT"])).alias("r")).select("r.*")


@query
def revcomp(spark: SparkSession, base: str) -> DataFrame:
    return reads_of(spark, base).select("seq_id", B.reverse_complement("bases").alias("rc"))


@query
def mirror_union(spark: SparkSession, base: str) -> DataFrame:
    r = reads_of(spark, base).select("seq_id", "id", "bases")
    return r.withColumn("part", F.lit(0)).unionByName(r.withColumns({"bases": B.reverse_complement("bases"), "part": F.lit(1)}))


@query
def kmer_explode_all(spark: SparkSession, base: str) -> DataFrame:
    return all_reads(spark, base).select("seq_id", F.posexplode(B.words("bases", 8)).alias("pos", "word"))


@query
def sample_word_numbers(spark: SparkSession, base: str) -> DataFrame:
    words = reads_of(spark, base).select("seq_id", F.posexplode(B.sample_words("bases")).alias("place", "word"))
    return words.select("seq_id", "place", B.word_number("word").alias("number"), B.word_string(B.word_number("word"), 8).alias("word"))


@query
def kmer_frequency_stats(spark: SparkSession, base: str) -> DataFrame:
    return R.word_statistics(reads_of(spark, base).select(F.explode(B.words("bases", 16)).alias("word")))


@query
def low_complexity_words(spark: SparkSession, base: str) -> DataFrame:
    raw = table(spark, base, "reads").where("seq_id is not null").select("seq_id", F.upper("bases").alias("b")).distinct()
    words = raw.select("seq_id", F.explode(B.words("b", 12)).alias("word"))
    return words.groupBy("seq_id").agg(F.count("*").alias("n_words"), F.count_if(B.simple_word("word")).alias("n_kept"))


@query
def strip_non_acgt(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "reads").select("seq_id", B.strip_other("bases").alias("bases")).distinct()


@query
def homopolymer_collapse(spark: SparkSession, base: str) -> DataFrame:
    return reads_of(spark, base).select("seq_id", B.collapse_runs("bases", 7).alias("bases"))


@query
def complement_codes(spark: SparkSession, base: str) -> DataFrame:
    return table(spark, base, "reads").select("seq_id", B.complement_ambiguous("bases").alias("complement")).distinct()


@query
def fasta_records(spark: SparkSession, base: str) -> DataFrame:
    return reads_of(spark, base).select("seq_id", B.fasta_record("id", "clone", "bases").alias("record"))


@query
def printed_reads(spark: SparkSession, base: str) -> DataFrame:
    """The reads that past runs were asked to show, forward and complemented, in lines of 60."""
    shown = all_reads(spark, base).join(asked(spark, base), "seq_id", "left_semi")
    return shown.select("seq_id", B.wrapped("bases").alias("forward"), B.wrapped(B.reverse_complement("bases")).alias("backward"))


@query
def accessions(spark: SparkSession, base: str) -> DataFrame:
    return reads_of(spark, base).select("seq_id", B.accession("id").alias("accession"))


@query
def mutated_reads(spark: SparkSession, base: str) -> DataFrame:
    return reads_of(spark, base).select("seq_id", B.mutated("bases", "seq_id", 5).alias("bases"))


# Candidates, filters and distances


@query
def candidates_kmer(spark: SparkSession, base: str) -> DataFrame:
    return candidates(reads_of(spark, base), CONFIG)


@query
def candidates_short_read(spark: SparkSession, base: str) -> DataFrame:
    """Candidates under the parameters for very short reads."""
    return candidates(reads_of(spark, base), PRESETS["solexa"])


@query
def candidates_symmetric(spark: SparkSession, base: str) -> DataFrame:
    return candidates(reads_of(spark, base), CONFIG, symmetric=True)


@query
def sample_hit_pairs(spark: SparkSession, base: str) -> DataFrame:
    return sample_hits(reads_of(spark, base), CONFIG)


@query
def window_hits(spark: SparkSession, base: str) -> DataFrame:
    heuristic = CONFIG.but(distance="heuristic")
    return scored_pairs(candidate_pairs(spark, base), reads_of(spark, base), heuristic, filtered=False).select("i", "j", "strand", "sample", "hits")


@query
def prefilter_pairs(spark: SparkSession, base: str) -> DataFrame:
    heuristic = CONFIG.but(distance="heuristic")
    return scored_pairs(candidate_pairs(spark, base), reads_of(spark, base), heuristic).where("dist is not null").select("i", "j", "strand", "sample", "hits")


@query
def d2_whole_candidates(spark: SparkSession, base: str) -> DataFrame:
    """Distance of whole reads for the candidates among all reads."""
    r = all_reads(spark, base)
    pairs, _ = Durable(spark, "candidates").keep(candidates(r, CONFIG).select("i", "j"))
    return scored_pairs(pairs, r, CONFIG.but(distance="whole", rc_check=False), filtered=False, counted=False).select("i", "j", F.col("dist").alias("d2"))


@query
def d2_window_min(spark: SparkSession, base: str) -> DataFrame:
    return scored_pairs(candidate_pairs(spark, base), reads_of(spark, base), CONFIG.but(rc_check=False), filtered=False, counted=False).select("i", "j", F.col("dist").alias("d2"))


@query
def d2_both_strands(spark: SparkSession, base: str) -> DataFrame:
    scores = scored_pairs(candidate_pairs(spark, base), reads_of(spark, base), CONFIG, filtered=False, counted=False)
    return scores.groupBy("i", "j").agg(F.max(F.when(F.col("strand") > 0, F.col("dist"))).alias("d2"), F.max(F.when(F.col("strand") < 0, F.col("dist"))).alias("d2_rc"))


@query
def ends_distance(spark: SparkSession, base: str) -> DataFrame:
    return scored_pairs(candidate_pairs(spark, base), reads_of(spark, base), CONFIG.but(distance="ends", rc_check=False), filtered=False, counted=False).select("i", "j", F.col("dist").alias("ends"))


@query
def edit_local(spark: SparkSession, base: str) -> DataFrame:
    return scored_pairs(candidate_pairs(spark, base), reads_of(spark, base), CONFIG.but(distance="ed", rc_check=False)).where("dist is not null").select("i", "j", F.col("dist").alias("cost"))


@query
def pair_report(spark: SparkSession, base: str) -> DataFrame:
    """Samples, windowed hits and distance of both strands for the pairs of the match dump."""
    scores = scored_pairs(edges_of(spark, base).select("i", "j").distinct(), all_reads(spark, base), CONFIG, filtered=False)
    of = lambda c, s: F.max(F.when(F.col("strand") == s, F.col(c)))
    return scores.groupBy("i", "j").agg(of("sample", 1).alias("samp_pos"), of("sample", -1).alias("samp_rc"), of("hits", 1).alias("win_pos"), of("hits", -1).alias("win_rc"), of("dist", 1).alias("d2_pos"), of("dist", -1).alias("d2_rc"), F.max("window").alias("window_len"))


@query
def gap_runs(spark: SparkSession, base: str) -> DataFrame:
    """Longest run of common words with small gaps, for the pairs of the match dump."""
    r = all_reads(spark, base).select("seq_id", B.words("bases", 8).alias("w"))
    pairs = edges_of(spark, base).select("i", "j").distinct().join(r.select(F.col("seq_id").alias("i"), F.col("w").alias("wi")), "i").join(r.select(F.col("seq_id").alias("j"), F.col("w").alias("wj")), "j")
    hits = F.transform("wj", lambda x: F.array_contains(F.col("own"), x).cast("int"))
    return pairs.withColumn("own", F.array_distinct("wi")).select("i", "j", R.gap_run(hits).alias("run"))


@query
def distance_histogram(spark: SparkSession, base: str) -> DataFrame:
    return R.distance_histogram(scored_pairs(candidate_pairs(spark, base), reads_of(spark, base), CONFIG, filtered=False, counted=False))


@query
def run_counters(spark: SparkSession, base: str) -> DataFrame:
    r = reads_of(spark, base)
    return R.counters(scored_pairs(candidate_pairs(spark, base), r, CONFIG), r.agg(F.count("*").alias("n")), CONFIG)


@query
def match_edges_d2(spark: SparkSession, base: str) -> DataFrame:
    return C.match_edges(reads_of(spark, base), CONFIG)


@query
def all_pairs_edges(spark: SparkSession, base: str) -> DataFrame:
    return C.match_edges(reads_of(spark, base), CONFIG, "all_pairs")


@query
def no_rc_edges(spark: SparkSession, base: str) -> DataFrame:
    return C.match_edges(reads_of(spark, base), CONFIG.but(rc_check=False))


@query
def range_slice_edges(spark: SparkSession, base: str) -> DataFrame:
    return ranged(edges_of(spark, base), 500, 1000)


@query
def step_sample(spark: SparkSession, base: str) -> DataFrame:
    return stepped(edges_of(spark, base))


@query
def edge_dump(spark: SparkSession, base: str) -> DataFrame:
    return edges_of(spark, base)


# Clustering


@query
def clusters_cc(spark: SparkSession, base: str) -> DataFrame:
    return min_labels(edges_of(spark, base), nodes=ids_of(spark, base))


@query
def range_search_edges(spark: SparkSession, base: str) -> DataFrame:
    """Matches of the reads of a range with later ones, from a search for them only."""
    r = reads_of(spark, base)
    return C.match_edges(r, CONFIG, left=R.index_range(r, 500, 999))


@query
def klink_search(spark: SparkSession, base: str) -> DataFrame:
    return C.linked_reads(reads_of(spark, base), CONFIG)


@query
def edit_costs_edges(spark: SparkSession, base: str) -> DataFrame:
    """Matches by the edit distance with the costs of the manual."""
    return C.match_edges(reads_of(spark, base), CONFIG.but(distance="ed", costs=S.MANUAL_COSTS, rc_check=False))


@query
def clusters_by_name(spark: SparkSession, base: str) -> DataFrame:
    """The current clustering with names for numbers; a name that two reads have is completed by the number."""
    named = all_reads(spark, base).select("seq_id", F.concat_ws("#", "id", F.col("seq_id").cast("string")).alias("id"))
    return S.translated(current(spark, base), named)[0]


@query
def cluster_line_parts(spark: SparkSession, base: str) -> DataFrame:
    """Lines of a cluster file, none with more than 50 ids."""
    return S.cluster_line_parts(current(spark, base), 50)


@query
def compared_clusters(spark: SparkSession, base: str) -> DataFrame:
    """Distances between the reads that past runs were asked to show and those of the earlier run."""
    return C.compared_clusters(all_reads(spark, base), asked(spark, base), reads2_of(spark, base))


@query
def clusters_candidates(spark: SparkSession, base: str) -> DataFrame:
    r = reads_of(spark, base)
    return min_labels(candidates(r, CONFIG), nodes=r.select("seq_id"))


@query
def clusters_d2(spark: SparkSession, base: str) -> DataFrame:
    return C.cluster(reads_of(spark, base), CONFIG)


@query
def cluster_histogram(spark: SparkSession, base: str) -> DataFrame:
    return R.histogram(clusters_candidates(spark, base))


@query
def cluster_mean_sq(spark: SparkSession, base: str) -> DataFrame:
    return R.mean_square(current(spark, base))


@query
def cluster_lines(spark: SparkSession, base: str) -> DataFrame:
    return S.cluster_lines(current(spark, base))


@query
def ext_table(spark: SparkSession, base: str) -> DataFrame:
    """The extended table of the current clustering, with witnesses of the match dump."""
    w = C.witnesses(edges_of(spark, base)).withColumn("orient", F.lit(1))
    return S.extended_table(current(spark, base), w)


@query
def comp_to_ext(spark: SparkSession, base: str) -> DataFrame:
    return S.extended_table(current(spark, base))


@query
def ext_to_comp(spark: SparkSession, base: str) -> DataFrame:
    return S.cluster_lines(S.from_extended(S.extended_table(current(spark, base))), stop=False)


@query
def header_clusters(spark: SparkSession, base: str) -> DataFrame:
    return S.header_clusters(reads_of(spark, base))


@query
def clone_link_clusters(spark: SparkSession, base: str) -> DataFrame:
    r = all_reads(spark, base)
    return min_labels(C.clone_edges(r), nodes=r.select("seq_id"))


@query
def init_clusters(spark: SparkSession, base: str) -> DataFrame:
    """The first round's clustering as start, with the match dump."""
    known = ids_of(spark, base)
    init = first_round(spark, base).join(known, "seq_id", "left_semi")
    return C.cluster(known, init=init, edges=edges_of(spark, base))


@query
def merge_clusters(spark: SparkSession, base: str) -> DataFrame:
    """The earlier run's reads and the current ones, each with its first-round clusters, and the matches across."""
    a, b = reads2_of(spark, base).select("seq_id"), reads_of(spark, base).select("seq_id")
    init = first_round(spark, base)
    of = lambda ids: init.join(ids, "seq_id", "left_semi")
    e = edges_of(spark, base)
    across = e.join(a.select(F.col("seq_id").alias("i")), "i", "left_semi").join(b.select(F.col("seq_id").alias("j")), "j", "left_semi")
    return C.merge(a, of(a), b, of(b), 0, edges=across)


@query
def add_clusters(spark: SparkSession, base: str) -> DataFrame:
    """The current reads added to the earlier run's clusters: matches with at least one current read."""
    a, b = reads2_of(spark, base).select("seq_id"), reads_of(spark, base).select("seq_id")
    old = first_round(spark, base).join(a, "seq_id", "left_semi")
    e = edges_of(spark, base).join(b.select(F.col("seq_id").alias("j")), "j", "left_semi")
    return C.add(a, old, b, edges=e)


@query
def recluster(spark: SparkSession, base: str) -> DataFrame:
    return C.recluster(ids_of(spark, base), current(spark, base), edges=edges_of(spark, base))


@query
def cluster_only(spark: SparkSession, base: str) -> DataFrame:
    return C.cluster(ids_of(spark, base), edges=edges_of(spark, base), constraints=directive(spark, base, "cluster-only"))


@query
def cluster_others(spark: SparkSession, base: str) -> DataFrame:
    return C.cluster(ids_of(spark, base), edges=edges_of(spark, base), constraints=directive(spark, base, "cluster-others"))


@query
def reset_ids(spark: SparkSession, base: str) -> DataFrame:
    known = ids_of(spark, base)
    init = current(spark, base).join(known, "seq_id", "left_semi")
    return C.cluster(known, init=init, edges=edges_of(spark, base), constraints=directive(spark, base, "reset"))


@query
def fixed_clusters(spark: SparkSession, base: str) -> DataFrame:
    return apart_labels(edges_of(spark, base), asked(spark, base), ids_of(spark, base))


@query
def signed_orientation(spark: SparkSession, base: str) -> DataFrame:
    return signed_labels(edges_of(spark, base), ids_of(spark, base))


@query
def klink_sym(spark: SparkSession, base: str) -> DataFrame:
    return C.adjacency(ids_of(spark, base), edges_of(spark, base), True)


@query
def klink_asym(spark: SparkSession, base: str) -> DataFrame:
    return C.adjacency(ids_of(spark, base), edges_of(spark, base), False)


@query
def witness_reads(spark: SparkSession, base: str) -> DataFrame:
    return C.witnesses(edges_of(spark, base))


@query
def winnowed_clusters(spark: SparkSession, base: str) -> DataFrame:
    return C.winnow(reads_of(spark, base), CONFIG, [90, 70], big=10)


@query
def p2_found(spark: SparkSession, base: str) -> DataFrame:
    return members_with_successor(table(spark, base, "forest")).where("link is not null")


# Comparison and reports


@query
def pair_confusion(spark: SparkSession, base: str) -> DataFrame:
    return M.pair_counts(first_round(spark, base), current(spark, base))


@query
def pair_indices(spark: SparkSession, base: str) -> DataFrame:
    return M.pair_indices(pair_confusion(spark, base))


@query
def missing_as_singletons(spark: SparkSession, base: str) -> DataFrame:
    return M.pair_counts(clusters_cc(spark, base), current(spark, base), missing_alone=True)


@query
def pair_index_table(spark: SparkSession, base: str) -> DataFrame:
    return M.index_table({"first": first_round(spark, base), "current": current(spark, base)})


@query
def pair_diff(spark: SparkSession, base: str) -> DataFrame:
    return M.pair_difference(current(spark, base), first_round(spark, base))


@query
def ticked_diff(spark: SparkSession, base: str) -> DataFrame:
    return M.ticked_difference(current(spark, base), first_round(spark, base))


@query
def heuristic_quality(spark: SparkSession, base: str) -> DataFrame:
    """Candidates of the k-mer search against the pairs of the match dump within the same reads."""
    r = reads_of(spark, base)
    n = r.agg((F.count("*") * (F.count("*") - 1) / 2).cast("bigint").alias("n"))
    ids = r.select(F.col("seq_id").alias("i"))
    e = edges_of(spark, base).join(ids, "i", "left_semi").join(ids.withColumnRenamed("i", "j"), "j", "left_semi")
    return M.quality(candidates(r, CONFIG), e, n)


@query
def thin_clusters(spark: SparkSession, base: str) -> DataFrame:
    return R.thinned(current(spark, base), asked(spark, base))


@query
def big_clusters(spark: SparkSession, base: str) -> DataFrame:
    return R.big_clusters(current(spark, base), 20)


@query
def cluster_members(spark: SparkSession, base: str) -> DataFrame:
    return R.members(current(spark, base))


@query
def subset_reads(spark: SparkSession, base: str) -> DataFrame:
    return R.chosen(reads_of(spark, base), asked(spark, base))


@query
def split_inc_exc(spark: SparkSession, base: str) -> DataFrame:
    return R.parted(reads_of(spark, base), asked(spark, base)).select("seq_id", "included")


@query
def limit_reads(spark: SparkSession, base: str) -> DataFrame:
    return R.first_reads(reads_of(spark, base), 300)


@query
def range_reads(spark: SparkSession, base: str) -> DataFrame:
    return R.index_range(reads_of(spark, base), 100, 499)


@query
def until_total(spark: SparkSession, base: str) -> DataFrame:
    return R.until_total(reads_of(spark, base), 100_000).select("seq_id", "len")


@query
def size_bins(spark: SparkSession, base: str) -> DataFrame:
    return R.size_bins(current(spark, base), 200)


@query
def produce_files(spark: SparkSession, base: str) -> DataFrame:
    return R.file_buckets(current(spark, base), 5).withColumn("file", R.file_name(F.col("bucket")))


@query
def split_files(spark: SparkSession, base: str) -> DataFrame:
    return R.split_members(current(spark, base), 5)


def queries() -> dict[str, Query]:
    return dict(_ALL)


