import pytest
from pyspark.sql import functions as F

from readskein.operators import reports as R
from readskein.sources import files as S


def lines(spark, *x):
    return spark.createDataFrame([(n, v) for n, v in enumerate(x)], "place bigint, value string")


TABLE = ("0 1 3.", "2.", "4.", "5 7.", "6 8 9.", "10.")


def test_cluster_table_of_the_manual(spark):
    c = S.parse_clusters(lines(spark, *TABLE))
    assert c.count() == 11
    assert {(r.size, r.n_clusters) for r in R.histogram(c).collect()} == {(1, 3), (2, 1), (3, 2)}
    m = R.mean_square(c).first()
    assert (m.n_clusters_total, m.mean_sq) == (6, 4)
    assert {r.line for r in S.cluster_lines(c).collect()} == set(TABLE)
    split = S.parse_clusters(lines(spark, "0 1", "3.", "2."))
    assert {(r.cluster_id, r.seq_id) for r in split.collect()} == {(0, 0), (0, 1), (0, 3), (2, 2)}
    bare = S.parse_clusters(lines(spark, "0 1", "5 3"), 10)
    assert {(r.cluster_id, r.seq_id) for r in bare.collect()} == {(10, 10), (10, 11), (13, 15), (13, 13)}


def test_extended_table(spark):
    c = S.parse_clusters(lines(spark, *TABLE)).select("seq_id", "cluster_id")
    rows = {r["index"]: r for r in S.extended_table(c).collect()}
    assert rows[0].link == 1 and rows[1].link == 3 and rows[3].link == -1 and rows[3].orient == 0 and rows[3].witness == -1
    assert {r.line for r in S.cluster_lines(S.from_extended(S.extended_table(c))).collect()} == set(TABLE)


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">R0001 clone IMAGE:42 anything\nACGTACGT\nAC*GT\n>R2\nTT\n\n>\nGGNN-\n")
    r = {x.seq_id: x for x in S.read_fasta(spark, str(tmp_path / "a.fa"), 100).collect()}
    assert (r[100].id, r[100].clone, r[100].bases, r[100].len) == ("R0001", "IMAGE:42", "ACGTACGTACGT", 12)
    assert (r[101].id, r[101].clone, r[102].id, r[102].bases) == ("R2", None, "102", "GGNN-")
    df = S.read_fasta(spark, str(tmp_path / "a.fa"))
    S.write_fasta(df, str(tmp_path / "out"))
    again = S.read_fasta(spark, str(tmp_path / "out"))
    assert {(x.id, x.clone, x.bases) for x in again.collect()} == {(x.id, x.clone, x.bases) for x in df.collect()}
    assert S.read_fasta(spark, str(tmp_path / "a.fa"), limit=2).count() == 2
    c = S.parse_clusters(lines(spark, *TABLE))
    S.write_clusters(c, str(tmp_path / "c"))
    assert {(x.cluster_id, x.seq_id) for x in S.read_clusters(spark, str(tmp_path / "c")).collect()} == {(x.cluster_id, x.seq_id) for x in c.collect()}
    e = S.extended_table(c.select("seq_id", "cluster_id"))
    S.write_extended(e, str(tmp_path / "e"))
    assert set(S.read_extended(spark, str(tmp_path / "e")).collect()) == set(e.collect())


def test_split_of_the_manual(spark):
    c = S.parse_clusters(lines(spark, "0 40 300.", "6.", "1 5 7 8."))
    files = {}
    for r in R.split_members(c, 1).collect():
        files.setdefault(r.file, set()).add(r.seq_id)
    assert sorted(map(len, files.values())) == [1, 3, 4]
    assert {r.seq_id for r in R.split_members(c, 4).collect()} == {1, 5, 7, 8}
    reads = spark.createDataFrame([(i, f"r{i}", None, "ACGT" * 30) for i in (0, 40, 300, 6, 1, 5, 7, 8)], "seq_id bigint, id string, clone string, bases string")
    names = {r.file for r in R.file_buckets(c, 3).withColumn("file", R.file_name(F.col("bucket"))).collect()}
    assert names == {"C000000.fasta", "C000001.fasta", "S0.fasta"} and reads.count() == 8


def test_other_lines(spark):
    k = S.parse_klinks(lines(spark, "0:0 1 5 9.", "2:2.", "3:3 4 7."))
    assert {(r.seq_id, tuple(r.neighbours)) for r in k.collect()} == {(0, (0, 1, 5, 9)), (2, (2,)), (3, (3, 4, 7))}
    assert {r.line for r in S.klink_lines(k).collect()} == {"0:0 1 5 9.", "2:2.", "3:3 4 7."}
    e = S.parse_edges(lines(spark, "1 2 1", "3: 4 5 -1", "6 7 0", "junk"))
    assert {tuple(r) for r in e.collect()} == {(1, 2, 1), (4, 5, -1), (6, 7, -1)}
    d = S.parse_constraints(lines(spark, "FIX 1 17 325.", "cluster-others."))
    assert {tuple(r) for r in d.collect()} == {("fix", 1), ("fix", 17), ("fix", 325), ("cluster-others", None)}
    assert {r.seq_id for r in S.literal_ids(spark, "1, 2 3.").collect()} == {1, 2, 3}
    h = S.header_clusters(spark.createDataFrame([(0, "a_1"), (1, "b_1"), (2, "a_2")], "seq_id bigint, id string"))
    assert {(r.cluster_id, r.seq_id) for r in h.collect()} == {(0, 0), (1, 1), (0, 2)}


def test_cluster_files(spark, tmp_path):
    c = S.parse_clusters(lines(spark, "0 1.", "2."))
    reads = spark.createDataFrame([(i, f"r{i}", None, "ACGT") for i in range(3)], "seq_id bigint, id string, clone string, bases string")
    R.write_cluster_files(reads, c, 2, str(tmp_path / "f"))
    got = {(r.file, r.value) for r in spark.read.text(str(tmp_path / "f")).collect() if r.value.startswith(">")}
    assert got == {("C000000.fasta", ">r0"), ("C000000.fasta", ">r1"), ("S0.fasta", ">r2")}


def test_reports_on_empty_tables(spark):
    empty = spark.createDataFrame([], "seq_id bigint, cluster_id bigint")
    assert R.histogram(empty).count() == 0 and R.mean_square(empty).first().mean_sq is None
    assert R.file_buckets(empty, 2).count() == 0 and S.extended_table(empty).count() == 0


@pytest.mark.parametrize("target,want", [(0, 0), (1, 1), (10, 2), (1000, 4)])
def test_until_total(spark, target, want):
    reads = spark.createDataFrame([(i, 5) for i in range(4)], "seq_id bigint, len int")
    assert R.until_total(reads, target).count() == want


def test_names_for_numbers_and_back(spark):
    clusters = spark.createDataFrame([(1, 1), (2, 1), (5, 5), (9, 9), (None, 9)], "seq_id bigint, cluster_id bigint")
    reads = spark.createDataFrame([(1, "a"), (2, "b"), (5, "c"), (None, "x"), (7, None)], "seq_id bigint, id string")
    named, missing = S.translated(clusters, reads)
    assert {tuple(x) for x in named.collect()} == {(1, "a"), (1, "b"), (5, "c")} and [x.seq_id for x in missing.collect()] == [9]
    back, lost = S.translated(named.unionByName(spark.createDataFrame([(5, "zz")], named.schema)), reads, "seq_id")
    assert {tuple(x) for x in back.collect()} == {(1, 1), (1, 2), (5, 5)} and [x.id for x in lost.collect()] == ["zz"]
    with pytest.raises(ValueError):
        S.translated(clusters, reads.unionByName(spark.createDataFrame([(8, "a")], reads.schema)))


def test_large_clusters_take_several_lines(spark, tmp_path):
    clusters = spark.createDataFrame([(i, 0) for i in range(25)] + [(30, 30), (31, 30)], "seq_id bigint, cluster_id bigint")
    lines = S.cluster_line_parts(clusters, 10).orderBy("cluster_id", "part")
    got = [x.line for x in lines.collect()]
    assert got == ["0 1 2 3 4 5 6 7 8 9", "10 11 12 13 14 15 16 17 18 19", "20 21 22 23 24.", "30 31."]
    lines.select(F.col("line").alias("value")).coalesce(1).write.text(str(tmp_path / "c"))
    back = S.read_clusters(spark, str(tmp_path / "c"))
    assert {(x.cluster_id, x.seq_id, x.ord) for x in back.collect()} == {(0, i, i) for i in range(25)} | {(30, 30, 0), (30, 31, 1)}


def test_two_lists(spark, tmp_path):
    (tmp_path / "two.txt").write_text("3 1 2.\n\n7 8\n9\n")
    a, b = S.read_two_clusters(spark, str(tmp_path / "two.txt"), 10)
    assert sorted(x.seq_id for x in a.collect()) == [11, 12, 13] and sorted(x.seq_id for x in b.collect()) == [17, 18]
