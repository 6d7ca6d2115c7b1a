import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from readskein.functions.buckets import mix
from readskein.llm.frequency import marked_terms, ngram_counts, ngram_marks, word_marks
from readskein.llm.groups import clone_links, connected_groups, read_groups


def plain(edges):
    at = {}

    def find(x):
        at.setdefault(x, x)
        while at[x] != x:
            x = at[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = find(a), find(b)
            at[max(a, b)] = min(a, b)
    return {n: find(n) for n in list(at)}


@pytest.mark.parametrize("seed", range(2))
def test_groups_match_union_find(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(260)]
    edges += [(1000 + i, 1001 + i) for i in range(70)]  # a long chain
    edges += [(5000, 5000 + i) for i in range(1, 300)]  # a node with most of the links
    edges += edges[:50] + [(b, a) for a, b in edges[:50]] + [(3, 3), (None, 4), (7, None)]
    df = spark.createDataFrame(edges, "a bigint, b bigint").withColumns({"node": F.lit(1), "lo": F.lit(2), "least": F.lit(3)})
    rows = connected_groups(df).collect()
    assert len(rows) == len({x.node for x in rows})
    assert {x.node: x.group_id for x in rows} == plain(edges)


def test_no_links(spark):
    assert connected_groups(spark.createDataFrame([(1, 1), (None, None)], "a bigint, b bigint")).collect() == []
    assert connected_groups(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_not_ending_is_an_error(spark):
    with pytest.raises(RuntimeError):
        connected_groups(spark.createDataFrame([(i, i + 1) for i in range(50)], "a bigint, b bigint"), max_rounds=1)


def test_links_of_reads(spark):
    reads = spark.createDataFrame([(10, " X1 "), (11, "x1"), (12, " - "), (13, "-"), (14, None), (15, ""), (10, " X1 "), (16, "y")], "seq_id bigint, clone string").withColumn("a", F.lit(0))
    reads2 = spark.createDataFrame([(1, "Y"), (2, None)], "seq_id bigint, clone string").withColumn("b", F.lit(0))
    edges = spark.createDataFrame([(12, 13, 1), (13, 99, 1), (14, 14, None)], "i bigint, j bigint, strand int")
    forest = spark.createDataFrame([(1, 14, -1, None, 15), (1, 15, 15, -1, -1), (2, None, 10, 11, 12)], "round int, seq_id bigint, cluster bigint, next bigint, match bigint")
    assert {(r.a, r.b) for r in clone_links(reads).collect()} == {(10, 11)}
    got = {tuple(r) for r in read_groups(reads, reads2, edges, forest).collect()}
    assert got == {(10, 10), (11, 10), (12, 12), (13, 12), (14, 14), (15, 14), (1, 1), (16, 1)}


def brute(rows, longest):
    occ, rec = Counter(), defaultdict(set)
    for i, t in rows:
        for a in range(len(t or [])):
            for n in range(1, longest + 1):
                g = tuple(t[a : a + n])
                if i is not None and len(g) == n and None not in g:
                    occ[g] += 1
                    rec[g].add(i)
    return {(g, n, len(rec[g])) for g, n in occ.items()}


@pytest.mark.parametrize("longest", [1, 3, 5])
def test_counts_match_brute_force(spark, longest):
    r = random.Random(longest)
    rows = [(r.randrange(25), [r.choice([1, 1, 1, 2, 3, None, r.randrange(50)]) for _ in range(r.randrange(0, 30))]) for _ in range(60)]
    rows += [(None, [1, 2]), (3, None), (4, []), rows[0], rows[0]]
    df = spark.createDataFrame(rows, "id bigint, t array<int>").withColumns({"n": F.lit(1), "t0": F.lit(9), "lcp": F.lit(1)}).repartition(5)
    got = [(tuple(x.ngram), x.occurrences, x.records) for x in ngram_counts(df, "id", "t", longest).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, longest)


def test_strings_and_empty_input(spark):
    df = spark.createDataFrame([("a", ["x", "y", "x"]), ("b", ["x", ""])], "id string, t array<string>")
    got = {(tuple(x.ngram), x.occurrences, x.records) for x in ngram_counts(df, "id", "t", 2).collect()}
    assert got == {(("x",), 3, 2), (("y",), 1, 1), (("",), 1, 1), (("x", "y"), 1, 1), (("y", "x"), 1, 1), (("x", ""), 1, 1)}
    assert ngram_counts(df.limit(0), "id", "t", 2).collect() == []


def test_marks(spark):
    rows = [(0, i, [7, 7, -1, i]) for i in range(100)] + [(1, i, [7]) for i in range(100)] + [(1, 3, [5]), (0, 4, [5]), (0, 6, [5]), (0, 500, [-1]), (0, 501, None), (0, 502, [])]
    got = {r.word: (r.occurrences, r.records, r.mark) for r in word_marks(spark.createDataFrame(rows, "block bigint, seq_id bigint, word_seen array<int>")).collect()}
    assert got[5][1:] == (4, "common") and -1 not in got and got[50] == (1, 1, "rare")
    assert got[7][1] == 100 and got[7][2] == "common"
    assert word_marks(spark.createDataFrame([], "block bigint, seq_id bigint, word_seen array<int>")).collect() == []
    counts = spark.createDataFrame([([1], 5, 3)], "ngram array<int>, occurrences bigint, records bigint")
    assert marked_terms(counts, 1000).first().mark is None and marked_terms(counts, 100).first().mark == "common"


def test_a_token_of_every_record_is_spread_over_tasks(spark):
    r = random.Random(4)
    rows = [(i, [7] * r.randrange(1, 4) + [100 + r.randrange(300), 7, 8]) for i in range(3000)]
    df = spark.createDataFrame(rows, "id bigint, t array<bigint>").repartition(3)
    for longest in (1, 2):
        got = {(tuple(x.ngram), x.occurrences, x.records) for x in ngram_counts(df, "id", "t", longest).collect()}
        assert got == brute(rows, longest)
    parts = set()
    bounds = np.array([5, 7, 7, 7, 90])
    low, high = np.searchsorted(bounds, 7, "left"), np.searchsorted(bounds, 7, "right")
    parts = {int(low + mix(np.array([i]))[0] % np.uint64(high - low + 1)) for i in range(3000)}
    assert len(parts) == 4


def test_ngrams_of_wordlists(spark):
    rows = [(0, 1, [5, 6, -1, 5, 6]), (1, 2, [5, 6, 7]), (1, 3, [6, None, 5])]
    got = {x.ngram: (x.occurrences, x.records, x.mark) for x in ngram_marks(spark.createDataFrame(rows, "block bigint, seq_id bigint, word_seen array<int>"), 3).collect()}
    assert got == {"5": (4, 3, "common"), "6": (4, 3, "common"), "7": (1, 1, "rare"), "5 6": (3, 2, "rare"), "6 7": (1, 1, "rare"), "5 6 7": (1, 1, "rare")}
