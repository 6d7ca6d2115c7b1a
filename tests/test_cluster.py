import random

import numpy as np
import pytest

from readskein.config import ClusterConfig
from readskein.operators import cluster as C
from readskein.operators import compare as M
from readskein.operators import pairs as P
from readskein.operators import reports as R
from readskein.operators.distance import scored_pairs
from readskein.operators.components import apart_labels, min_labels, signed_labels
from readskein.operators.pairs import candidates, sample_hits
from readskein.sources import files as S


def frame(spark, rows, schema="i bigint, j bigint, strand int"):
    return spark.createDataFrame(rows, schema)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.cluster_id, set()).add(r.seq_id)
    return {frozenset(x) for x in out.values()}


def clustering(spark, text):
    lines = [(n, x) for n, x in enumerate(text.strip().split("\n"))]
    return S.parse_clusters(spark.createDataFrame(lines, "place bigint, value string")).select("seq_id", "cluster_id")


def plain(nodes, edges):
    at = {n: n for n in nodes}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        at[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_labels_match_union_find(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300), 1) for _ in range(220)] + [(n, n + 1, 1) for n in range(400, 460)] + [(None, 3, 1), (4, None, 1)]
    got = {x.seq_id: x.cluster_id for x in min_labels(frame(spark, edges), nodes=spark.range(500).withColumnRenamed("id", "seq_id")).collect()}
    assert got == plain(range(500), [(a, b) for a, b, _ in edges if a is not None and b is not None])


def test_no_edges(spark):
    assert min_labels(frame(spark, [])).collect() == []
    assert groups(min_labels(frame(spark, []), nodes=spark.range(2).withColumnRenamed("id", "seq_id"))) == {frozenset({0}), frozenset({1})}


def test_orientation_is_the_parity_of_a_path(spark):
    edges = [(0, 1, -1), (1, 2, -1), (2, 3, 1), (3, 9, -1), (5, 6, 1)]
    got = {x.seq_id: (x.cluster_id, x.orient) for x in signed_labels(frame(spark, edges)).collect()}
    assert got == {0: (0, 1), 1: (0, -1), 2: (0, 1), 3: (0, 1), 9: (0, -1), 5: (5, 1), 6: (5, 1)}


@pytest.mark.parametrize("seed", range(3))
def test_fixed_reads_stay_apart_as_in_a_sequential_run(spark, seed):
    r = random.Random(seed)
    edges = sorted({(min(a, b), max(a, b), r.choice((1, -1))) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(60)) if a != b})
    fixed = set(r.sample(range(40), 6))
    at = {n: n for n in range(40)}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b, _ in sorted(edges, key=lambda e: (e[0], e[1], -e[2])):
        a, b = find(a), find(b)
        holds = [any(find(f) == x for f in fixed) for x in (a, b)]
        if a != b and not all(holds):
            at[max(a, b)] = min(a, b)
    want = {}
    for n in range(40):
        want.setdefault(find(n), set()).add(n)
    got = groups(apart_labels(frame(spark, edges), frame(spark, [(f,) for f in fixed], "seq_id bigint"), spark.range(40).withColumnRenamed("id", "seq_id")))
    assert got == {frozenset(x) for x in want.values()}


A = "0 1 2 12 13 14.\n3.\n4 5 6 8.\n7 9 10 11."
B = "0 2 4 10.\n1 3 5.\n6 7 8 9 11."


def test_merge_of_the_manual(spark):
    a, b = clustering(spark, A), clustering(spark, B)
    across = frame(spark, [(3, 21, 1), (4, 16, 1), (7, 18, 1)])
    got = groups(C.merge(a.select("seq_id"), a, b.select("seq_id"), b, 15, edges=across))
    assert got == {frozenset(x) for x in ({0, 1, 2, 12, 13, 14}, {3, 21, 22, 23, 24, 26}, {4, 5, 6, 7, 8, 9, 10, 11, 16, 18, 20}, {15, 17, 19, 25})}


INIT = "0 1 4.\n2 3 7.\n5.\n6 8.\n9."


def constraints(spark, *lines):
    return S.parse_constraints(spark.createDataFrame([(x,) for x in lines], "value string"))


def test_cluster_only_and_reset_of_the_manual(spark):
    init = clustering(spark, INIT)
    reads = init.select("seq_id")
    edges = frame(spark, [(3, 8, 1), (0, 5, 1)])
    only = C.cluster(reads, init=init, edges=edges, constraints=constraints(spark, "Cluster-Only 2 3 6 7 8."))
    assert groups(only) == {frozenset(x) for x in ({0, 1, 4}, {2, 3, 6, 7, 8}, {5}, {9})}
    reset = C.cluster(reads, init=init, edges=edges, constraints=constraints(spark, "reset 2 3 6 7 8."))
    assert groups(reset) == {frozenset(x) for x in ({0, 1, 4}, {5}, {9}, {2}, {6}, {7}, {3, 8})}
    others = C.cluster(reads, init=init, edges=edges, constraints=constraints(spark, "cluster-others 8."))
    assert frozenset({3, 2, 7}) in groups(others) and frozenset({0, 1, 4, 5}) in groups(others)
    empty = C.cluster(reads, init=init, edges=edges, constraints=constraints(spark, "cluster-others."))
    assert frozenset({2, 3, 7, 6, 8}) in groups(empty)
    fix = C.cluster(reads, edges=frame(spark, [(1, 2, 1), (2, 3, 1)]), constraints=constraints(spark, "fix 1 3 8."))
    assert frozenset({1, 2}) in groups(fix) and frozenset({3}) in groups(fix)
    with pytest.raises(ValueError):
        constraints(spark, "reset 1.", "cluster-only 2.")


def test_add_keeps_old_clusters(spark):
    old = clustering(spark, "0 1.\n2.")
    new = frame(spark, [(3,), (4,)], "seq_id bigint")
    assert groups(C.add(old.select("seq_id"), old, new, edges=frame(spark, [(2, 3, 1)]))) == {frozenset({0, 1}), frozenset({2, 3}), frozenset({4})}


def some_reads(spark, n=40):
    r = random.Random(11)
    base = "".join(r.choice("ACGT") for _ in range(900))
    turn = str.maketrans("ACGT", "TGCA")
    rows = []
    for i in range(n):
        if i % 4 == 0:
            b = "".join(r.choice("ACGT") for _ in range(220))
        else:
            at = r.randrange(0, 600)
            b = base[at : at + 220]
            if i % 3 == 0:
                b = b.translate(turn)[::-1]
        rows.append((i, b))
    return spark.createDataFrame([*rows, (98, ""), (99, "ACGT")], "seq_id bigint, bases string"), dict(rows)


def test_candidates_find_planted_overlaps_and_modes_agree(spark):
    reads, rows = some_reads(spark)
    config = ClusterConfig()
    turn = str.maketrans("ACGT", "TGCA")
    want = set()
    for i, a in rows.items():
        for j, b in rows.items():
            if i < j:
                both = [b[p : p + 16] for p in range(205)] + [b.translate(turn)[::-1][p : p + 16] for p in range(205)]
                hits = [p for p in range(205) for w in both if a[p : p + 16] == w]
                if len(hits) >= 3 and max(hits) - min(hits) >= 45:
                    want.add((i, j, len(hits)))
    got = {(r.i, r.j, r.shared) for r in candidates(reads, config).collect()}
    assert got == want and want
    found = C.match_edges(reads, config)
    pairs = {(r.i, r.j) for r in found.collect()}
    assert pairs and pairs <= {(i, j) for i, j, _ in want}
    assert {(r.i, r.j) for r in C.match_edges(reads, config, "all_pairs").collect()} >= pairs
    assert groups(C.cluster(reads, config)) == groups(min_labels(found, nodes=reads.select("seq_id")))
    assert sample_hits(reads, config).count() >= len(pairs)
    with pytest.raises(ValueError):
        C.match_edges(reads, config, "guess")


def test_incremental_adding_gives_the_batch_result(spark):
    from readskein.streaming.incremental import GrowingClusters

    reads, _ = some_reads(spark)
    first = reads.where("seq_id < 20")
    grown = GrowingClusters(first, C.cluster(first))
    for n, (a, b) in enumerate(((20, 30), (30, 100))):
        batch = reads.where(f"seq_id >= {a} and seq_id < {b}")
        grown.absorb(batch, n)
        grown.absorb(batch, n)
    assert groups(grown.clusters) == groups(C.cluster(reads))


def test_stream_of_files(spark, tmp_path):
    from readskein.streaming.incremental import GrowingClusters

    reads, _ = some_reads(spark, 16)
    reads.where("seq_id >= 8").write.parquet(str(tmp_path / "in"))
    first = reads.where("seq_id < 8")
    grown = GrowingClusters(first, C.cluster(first))
    stream = spark.readStream.schema(reads.schema).parquet(str(tmp_path / "in"))
    q = grown.follow(stream, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert groups(grown.clusters) == groups(C.cluster(reads))


def test_winnow_never_joins_what_plain_clustering_keeps_apart(spark):
    reads, _ = some_reads(spark, 24)
    full = groups(C.cluster(reads, ClusterConfig(common_word=70)))
    for g in groups(C.winnow(reads, ClusterConfig(), [90, 70], big=4)):
        assert any(g <= f for f in full)


def test_adjacency(spark):
    reads = spark.range(4).withColumnRenamed("id", "seq_id")
    e = frame(spark, [(0, 1, 1), (0, 1, -1), (1, 3, 1)])
    sym = {r.seq_id: r.neighbours for r in C.adjacency(reads, e).collect()}
    assert sym == {0: [0, 1], 1: [0, 1, 3], 2: [2], 3: [1, 3]}
    asym = {r.seq_id: r.neighbours for r in C.adjacency(reads, e, False).collect()}
    assert asym == {0: [1], 1: [3], 2: [], 3: []}


def test_agreement(spark):
    a, b = clustering(spark, "0 1 2.\n3 4."), clustering(spark, "0 1.\n2 3 4.")
    r = M.pair_indices(M.pair_counts(a, b)).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 2, 2, 4) and r.ji == round(2 / 6, 6) and r.ri == 0.6
    assert {(x.i, x.j) for x in M.pair_difference(a, b).collect()} == {(0, 2), (1, 2)}
    assert M.pair_indices(M.pair_counts(a.limit(0), b)).first().ji is None
    alone = M.pair_counts(a, clustering(spark, "0 1."), missing_alone=True).first()
    assert (alone.tp, alone.fp, alone.fn, alone.tn) == (1, 3, 0, 6)


def test_size_bins_fill_in_order(spark):
    c = clustering(spark, "0 1 2.\n3 4.\n5.\n6 7 8 9 10 11.\n12.")
    got = [r.bin for r in R.size_bins(c, 5).orderBy("cluster_id").collect()]
    assert got == [0, 0, 1, 2, 3]


def test_size_bins_go_on_across_chunks(spark):
    r = random.Random(5)
    sizes = [r.randrange(1, 9) for _ in range(40)]
    want, used, at = [], 0, 0
    for n in sizes:
        if used and used + n > 7:
            at, used = at + 1, 0
        used += n
        want.append(at)
    c = spark.createDataFrame([(k * 100 + x, k * 100) for k, n in enumerate(sizes) for x in range(n)], "seq_id bigint, cluster_id bigint")
    for chunk in (1, 3, 100):
        assert [x.bin for x in R.size_bins(c, 7, chunk).orderBy("cluster_id").collect()] == want


def test_bin_passage_tells_what_filling_does():
    r = random.Random(6)
    for _ in range(500):
        most, sizes = r.randrange(1, 12), [r.randrange(1, r.choice([3, 15])) for _ in range(r.randrange(1, 9))]
        at, opened, fill = R.bin_passage(np.array(sizes), most)
        for u in range(most + 1):
            used, bins = u, 0
            for n in sizes:
                if used and used + n > most:
                    bins, used = bins + 1, 0
                used += n
            k = int(np.searchsorted(at, u, side="right")) - 1
            assert (opened[k], fill[k] + (u if opened[k] == 0 else 0)) == (bins, used)


def test_sample_hits_take_later_reads_below_the_window(spark):
    r = random.Random(7)
    b = "".join(r.choice("ACGT") for _ in range(150))
    reads = spark.createDataFrame([(0, b[30:120]), (1, b), (2, b[40:130]), (3, b[20:140]), (4, None)], "seq_id bigint, bases string")
    got = {(x.i, x.j) for x in sample_hits(reads, ClusterConfig()).where("strand = 1").collect()}
    assert got == {(1, 2), (1, 3)}
    assert (1, 2) in {(x.i, x.j) for x in C.match_edges(reads.where("bases is not null"), ClusterConfig(), "all_pairs").collect()}


@pytest.mark.parametrize("rc_check", [True, False])
def test_sample_hits_are_counted_in_blocks_without_a_join_on_words(spark, monkeypatch, rc_check):
    monkeypatch.setattr(P, "BLOCK_READS", 7)
    r = random.Random(11)
    b = "".join(r.choice("ACGT") for _ in range(900))
    turned = lambda s: s.translate(str.maketrans("ACGTacgt", "TGCAtgca"))[::-1]
    texts = [x if r.random() < 0.5 else turned(x) for x in (b[at : at + r.choice([90, 130, 160])] for at in (r.randrange(700) for _ in range(40)))]
    texts += ["ACGTN" * 40, "NACGT" * 30, "A" * 200, "ACGTN" * 3, "acgtTTGA" * 20, ""]
    own = lambda s: {s[p : p + 8] for p in range(len(s) - 7)}
    config, want = ClusterConfig(rc_check=rc_check), set()
    for i, x in enumerate(texts):
        for j in range(i + 1, len(texts)):
            for strand, side in ((1, x), (-1, turned(x)))[: 1 + rc_check]:
                hits = sum(texts[j][8 * k : 8 * k + 8] in own(side) for k in range(1, len(texts[j]) // 8 - 1))
                if len(x) >= config.window_len and hits > config.sample_thresh:
                    want.add((3 * i, 3 * j, strand, hits))
    found = sample_hits(spark.createDataFrame([(3 * i, x) for i, x in enumerate(texts)], "seq_id bigint, bases string").repartition(3), config)
    assert set(map(tuple, found.collect())) == want and found.count() == len(want) > 50
    # what was joined by word outgrew the disk on larger tables
    assert "SortMergeJoin" not in found._jdf.queryExecution().toString()


@pytest.mark.parametrize("config", [ClusterConfig(), ClusterConfig(rc_check=False, sample_thresh=2, common_word=36, window_len=80)])
def test_all_pairs_are_filtered_where_samples_are_counted(spark, monkeypatch, config):
    monkeypatch.setattr(P, "BLOCK_READS", 20)
    r = random.Random(5)
    b = "".join(r.choice("ACGT") for _ in range(1500))
    texts = [b[at : at + r.choice([60, 90, 130, 250])] for at in (r.randrange(1200) for _ in range(60))]
    texts += ["".join(c if r.random() > 0.12 else r.choice("ACGT") for c in x) for x in texts] + [x[:50] + "N" + x[51:] for x in texts[:5]]
    texts += [x.translate(str.maketrans("ACGT", "TGCA"))[::-1] for x in texts[:30]]
    reads = spark.createDataFrame(list(enumerate(texts)), "seq_id bigint, bases string")
    hits = sample_hits(reads, config).select("i", "j").distinct()
    passed = scored_pairs(hits, reads, config.but(distance="heuristic")).where("dist is not null").select("i", "j").distinct()
    rows = [tuple(x) for x in P.filtered_pairs(reads, config).collect()]
    got, want, other = set(rows), set(map(tuple, passed.collect())), set(range(120, 125))
    assert len(got) == len(rows) and want <= got
    assert all(set(x) & other for x in got - want)
    assert len(want) < hits.count()


def test_words_are_shuffled_in_passes_and_pairs_come_out_whole(spark, monkeypatch):
    r = random.Random(21)
    b = "".join(r.choice("ACGT") for _ in range(3000))
    reads = spark.createDataFrame([(i, b[at : at + 200]) for i, at in enumerate(r.randrange(2800) for _ in range(80))], "seq_id bigint, bases string")
    want = set(map(tuple, candidates(reads, ClusterConfig()).collect()))
    monkeypatch.setattr(P, "bucket_number", lambda spark, rows: 16)
    monkeypatch.setattr(P, "PASS_BASES", 5000)
    kept, run = [], P.spread_runs
    monkeypatch.setattr(P.Durable, "keep", lambda self, df, keep=P.Durable.keep: kept.append(self.base.rpartition("/")[2]) or keep(self, df))
    assert set(map(tuple, candidates(reads, ClusterConfig()).collect())) == want and len(want) > 50
    assert sum(x.startswith("met-") for x in kept) == 2 * 4  # a pass for words and one for sums each
    seq, (codes, offsets) = np.arange(2), P.flat(P.pa.array([b[:200], b[100:300]]))
    of = [run(seq, codes, offsets, np.zeros(2, np.int64), 16, 7, True, np.zeros(0, np.int64), 16, np.arange(16) * 4 // 16 == t).column(0).to_pylist() for t in range(4)]
    assert sorted(sum(of, [])) == run(seq, codes, offsets, np.zeros(2, np.int64), 16, 7, True, np.zeros(0, np.int64), 16).column(0).to_pylist()
    assert all(x // 4 == t for t, own in enumerate(of) for x in own)


def test_a_long_chain_of_random_ids_ends_in_few_rounds(spark):
    ids = list(range(100_000))
    random.Random(1).shuffle(ids)
    chain = spark.createDataFrame(list(zip(ids, ids[1:])), "i bigint, j bigint").repartition(4)
    got = min_labels(chain, max_rounds=40).agg({"cluster_id": "max", "seq_id": "count"}).first()
    assert tuple(got) == (0, 100_000) or tuple(got) == (100_000, 0)


def test_paths_that_disagree_leave_every_read_unturned(spark):
    edges = frame(spark, [(4, 5, 1), (5, 6, -1), (4, 6, 1), (7, 8, -1), (8, 8, -1), (None, 7, 1)])
    got = {x.seq_id: (x.cluster_id, x.orient) for x in signed_labels(edges, spark.range(4, 10).withColumnRenamed("id", "seq_id")).collect()}
    assert got == {4: (4, 1), 5: (4, 1), 6: (4, 1), 7: (7, 1), 8: (7, -1), 9: (9, 1)}


@pytest.mark.parametrize("symmetric", [False, True])
def test_words_of_many_reads_meet_in_blocks(spark, monkeypatch, symmetric):
    from readskein.operators import pairs as P

    r = random.Random(9)
    common = "".join(r.choice("ACGT") for _ in range(70))
    rows = [(i, "".join(r.choice("ACGT") for _ in range(30)) + common + "N" * (i % 3)) for i in range(30)]
    reads = spark.createDataFrame([*rows, (50, None), (51, "")], "seq_id bigint, bases string")
    config = ClusterConfig(kmer_len=8)
    plain = {tuple(x) for x in candidates(reads, config, symmetric=symmetric).collect()}
    assert len(plain) >= (870 if symmetric else 435)
    monkeypatch.setattr(P, "BLOCK", 7)
    assert {tuple(x) for x in candidates(reads, config, symmetric=symmetric).collect()} == plain
    some = spark.createDataFrame([(i,) for i in range(10)], "seq_id bigint")
    assert {(x.i, x.j) for x in candidates(reads, config, left=some, symmetric=symmetric).collect()} == {(x[0], x[1]) for x in plain if x[0] < 10}
    assert candidates(reads, config.but(max_word_freq=3)).count() <= len(plain)
    with pytest.raises(ValueError):
        P.word_table(reads, 40, True)


def test_frequent_keys_and_buckets(spark):
    from readskein.functions import buckets as B

    rows = spark.range(5000).selectExpr("if(id % 3 = 0, 7, id) as k")
    assert set(B.frequent_keys(rows, 5000, lambda b: b.column(0).to_numpy(), 16)) == {7}
    kind = np.dtype([("key", "i8"), ("x", "i4")])

    def spread(batches):
        for b in batches:
            out = np.zeros(b.num_rows, kind)
            out["key"] = b.column(0).to_numpy()
            yield B.bundled(out, B.bucket_of(out["key"], 16))

    def count(batches):
        import pyarrow as pa

        for n, x in B.whole_buckets(batches, kind):
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([len(x)], pa.int64()), pa.array([len(set(x["key"].tolist()))], pa.int64())], ["bucket", "n", "keys"])

    got = B.shuffled(rows.mapInArrow(spread, B.SCHEMA)).mapInArrow(count, "bucket int, n bigint, keys bigint").collect()
    assert len({r.bucket for r in got}) == len(got) and sum(r.n for r in got) == 5000 and sum(r.keys for r in got) == 5000 - 1667


def test_a_running_total_goes_on_across_ranges_of_ranges(spark):
    r = random.Random(3)
    rows = [(i, r.randrange(1, 9)) for i in range(200)]
    reads = spark.createDataFrame(rows, "seq_id bigint, len int").repartition(3)
    for target in (1, 50, 400, 10_000):
        total, want = 0, set()
        for i, n in rows:
            if total < target:
                want.add(i)
            total += n
        assert {x.seq_id for x in R.until_total(reads, target, 4, 5).collect()} == want


def test_lists_of_reads_are_compared_and_links_searched(spark):
    from readskein.operators import distance as D

    reads, rows = some_reads(spark, 8)
    got = {(x.i, x.j): (x.d2, x.d2_rc) for x in C.compared_clusters(reads, spark.createDataFrame([(1,), (2,), (77,)], "seq_id bigint"), spark.createDataFrame([(2,), (3,)], "seq_id bigint")).collect()}
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    want = {(i, j): tuple(D.d2_windows(D.codes(rows[i]), D.codes(b), 100, 6) for b in (rows[j], turn(rows[j]))) for i, j in ((1, 2), (1, 3), (2, 3))}
    assert got == want
    assert {x.i for x in C.checked_ids(reads, spark.createDataFrame([(1,), (2,)], "seq_id bigint"), 5).collect()} == {1, 2}
    edges = {(x.i, x.j) for x in C.match_edges(reads, ClusterConfig()).collect()}
    links = {x.seq_id: x.neighbours for x in C.linked_reads(reads, ClusterConfig(), symmetric=False).collect()}
    assert {(i, j) for i, n in links.items() for j in n} == edges


def test_a_run_is_resumed_from_its_folder(spark, tmp_path):
    from readskein.streaming.incremental import GrowingClusters

    reads, _ = some_reads(spark, 24)
    first = reads.where("seq_id < 8")
    grown = GrowingClusters(first, C.cluster(first), folder=str(tmp_path / "run"))
    grown.absorb(reads.where("seq_id >= 8 and seq_id < 16"), 0)
    again = GrowingClusters.resume(spark, str(tmp_path / "run"))
    assert again.done == {0} and groups(again.clusters) == groups(grown.clusters)
    again.absorb(reads.where("seq_id >= 8 and seq_id < 16"), 0)
    again.absorb(reads.where("seq_id >= 16"), 1)
    assert groups(again.clusters) == groups(C.cluster(reads)) and again.reads.count() == reads.count()
    with pytest.raises(ValueError):
        GrowingClusters.resume(spark, str(tmp_path / "nothing"))


@pytest.mark.parametrize(("k", "either"), [(16, True), (14, True), (31, True), (5, False)])
def test_words_travel_as_runs_and_come_out_whole(k, either):
    from readskein.functions import buckets as B
    from readskein.functions.arrays import flat
    from readskein.operators import pairs as P

    pa = pytest.importorskip("pyarrow")
    r = random.Random(k)
    source = "".join(r.choice("ACGT") for _ in range(3000))
    bases = ["A" * 50, "ACGT" * 20, "", "N" * 40, *(source[at : at + 400] + "n" + source[at : at + 90] for at in range(0, 2600, 60)), "A" * 31]
    codes, offsets = flat(pa.array(bases))
    seq = np.arange(len(bases), dtype=np.int64) * 7 + 2**40
    row, word, n, first, last, twofold = P._counted(codes, offsets, k, either)
    several = {int(w) for w in np.unique(word) if len(np.unique(row[word == w])) > 1}
    hot = np.array(sorted(several)[:2], np.int64)
    want = {(int(w), int(seq[x]), int(c), int(a), int(z), bool(t)) for x, w, c, a, z, t in zip(row, word, n, first, last, twofold, strict=True) if int(w) in several - set(hot.tolist())}
    sent = P.spread_runs(seq, codes, offsets, np.full(len(seq), 6, np.int32), k, P.least_part(k, 8), either, hot, 8)
    got = [x for _, blobs in B.bucket_blobs([sent]) for x in P.counted_runs(blobs, k, either)]
    assert {(int(x["key"]), int(x["seq"]), int(x["n"]), int(x["first"]), int(x["last"]), bool(x["flags"] & P._TWOFOLD)) for x in got} == want and len(got) == len(want)
    if 10 < k < 20:
        assert sum(len(x) for x in sent.column(1).to_pylist()) < 4 * len(word)  # 32 as rows


def test_sums_of_pairs_come_out_as_they_were_packed():
    from readskein.functions import buckets as B
    from readskein.operators import pairs as P

    r = np.random.default_rng(4)
    i, j = r.integers(0, 40, 500) + 2**41, r.integers(-5, 2**42, 500)
    rest = [r.integers(0, 900, 500) for _ in range(3)]
    met = (i, j, rest[0], rest[1].astype(np.int32), (rest[1] + rest[2]).astype(np.int32), r.integers(0, 2, 500) * P._SHORT)
    back = [P.unpacked(x) for _, blobs in B.bucket_blobs([P._bundled_pairs(met, 5)]) for x in blobs]
    assert sorted(zip(*(np.concatenate(x).tolist() for x in zip(*back, strict=True)), strict=True)) == sorted(zip(*(x.tolist() for x in met), strict=True))
    assert P._bundled_pairs(tuple(x[:0] for x in met), 5).num_rows == 0


@pytest.mark.parametrize("symmetric", [False, True])
def test_big_words_count_for_pairs_of_other_words(spark, monkeypatch, symmetric):
    from readskein.operators import pairs as P

    r = random.Random(12)
    some = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    tail, ends = "A" * 12, some(9)
    rows = []
    for i in range(24):
        own = some(90 if i % 5 else 30)
        rows += [(3 * i, own + tail), (3 * i + 1, some(20) + own[-25:] + tail), (3 * i + 2, ends + some(60) + ends if i % 4 else own[:12] + some(55) + tail)]
    reads = spark.createDataFrame(rows, "seq_id bigint, bases string")
    config = ClusterConfig(kmer_len=9, beta=40)
    plain = {tuple(x) for x in candidates(reads, config, symmetric=symmetric).collect()}
    monkeypatch.setattr(P, "BLOCK", 9)
    assert {tuple(x) for x in candidates(reads, config, symmetric=symmetric).collect()} == plain and len(plain) > 24
    row = np.zeros(20, P._DEALT)
    row["seq"], row["n"], row["flags"] = np.arange(20), 1, P._LEFT | P._RIGHT | np.where(np.arange(20) == 3, P._WIDE, 0)
    sent = [(int(i), int(j)) for met in P._block_meetings(row, symmetric) for i, j in zip(met[0], met[1], strict=True)]
    assert sorted(sent) == [(3, j) for j in range(20) if (j != 3 if symmetric else j > 3)]


def test_pairs_too_narrow_even_with_big_words_are_left_out_early():
    from readskein.operators import pairs as P

    i, j = np.array([5, 5, 5, 6, 7, 7]), np.array([5, 8, 9, 8, 7, 9])
    first, last = np.array([60, 55, 10, 0, 50, 58]), np.array([70, 65, 20, 50, 60, 75])
    parts = [(i, j, np.array([0, 3, 1, 4, 0, 9]), first, last, np.zeros(6, np.int64))]
    got = lambda opened: [(x["i"], x["j"]) for b in P._added(parts, opened, ClusterConfig(), False) for x in b.to_pylist()]
    assert got(True) == [(5, 9)] and got(False) == [(6, 8)]


@pytest.mark.parametrize("symmetric", [False, True])
def test_words_of_many_reads_bring_pairs_together_outside_one_stretch_only(spark, monkeypatch, symmetric):
    from readskein.operators import pairs as P

    r = random.Random(21)
    some = lambda n: "".join(r.choice("ACGT") for _ in range(n))
    linker, tail = some(20), "A" * 14
    rows = [(i, (linker if i % 2 else "") + some(30 + i % 9 * 10) + (tail if i % 3 else "") + (some(50) + linker if i % 7 == 0 else "")) for i in range(40)]
    reads = spark.createDataFrame(rows, "seq_id bigint, bases string")
    config = ClusterConfig(kmer_len=9, beta=40)
    few, many = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "seq_id bigint"), spark.createDataFrame([(i,) for i in range(30)], "seq_id bigint")
    found = lambda: [{tuple(x) for x in candidates(reads, config, *sides, symmetric=symmetric).collect()} for sides in ((), (few, many))]
    plain = found()
    monkeypatch.setattr(P, "BIG_READS", 4)
    assert found() == plain and all(plain)


def test_the_stretch_of_a_read_that_needs_no_meeting():
    from readskein.operators import pairs as P

    rows = np.zeros(6, P._BIG)
    rows["seq"], rows["word"] = [1, 1, 1, 2, 2, 2], [5, 6, 7, 5, 6, 8]
    rows["first"], rows["count"] = [0, 60, 70, 0, 10, 44], [900, 500, 500, 900, 500, 80]
    rows["last"] = rows["first"] + [0, 0, 0, 0, 50, 0]
    held, starts = P.with_wide(rows, ClusterConfig(), False)
    assert starts.tolist() == [0, 3, 6]
    # of read 1 the two words at 60 and 70 need no meeting; of read 2 the one that ends far off does
    assert {(int(x["seq"]), int(x["word"])) for x in held if x["flags"] & P._WIDE} == {(1, 5), (2, 6)}


def test_what_was_shuffled_for_a_kept_table_is_removed(spark):
    import time

    from readskein.session import Durable

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {x for x in (files.apply(k).getName() for k in range(files.size())) if x.startswith("shuffle")}

    before = held()
    kept, _ = Durable(spark, "test").keep(spark.range(1000).repartition(5, "id"))
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before and kept.count() == 1000
