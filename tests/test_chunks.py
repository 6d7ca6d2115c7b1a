import random

from readskein.operators.chunks import current_rows, members_with_successor, next_in_key, number_in_key

FOREST = "round int, seq_id bigint, cluster bigint, saved_at timestamp, extra string, number int, row string"


def test_successors_across_chunks_match_a_plain_loop(spark):
    r = random.Random(1)
    rows = [(k, v) for k, n in ((1, 500), (2, 3), (3, 1), (None, 40)) for v in r.sample(range(10_000), n)]
    df = spark.createDataFrame(rows, "k bigint, v bigint").repartition(7)
    got = {(x.k, x.v): x.link for x in next_in_key(df, "k", "v", "v", size=7).collect()}
    want = {}
    for k in {k for k, _ in rows}:
        vs = sorted(v for a, v in rows if a == k)
        want |= {(k, a): b for a, b in zip(vs, [*vs[1:], None])}
    assert got == want


def test_numbers_are_exact_and_chunks_bounded(spark):
    df = spark.range(1000).selectExpr("id % 2 as k", "id as v", "id as _number", "'x' as part", "id as row")
    out = number_in_key(df, "k", ["v"], 64)
    rows = out.collect()
    assert sorted(out.columns) == sorted(["k", "v", "part", "row", "_number", "_chunk"])
    assert all(x._number == x.v // 2 and x._chunk == x._number // 64 for x in rows)


def test_ties_and_repeated_rows_are_numbered_once_each(spark):
    df = spark.createDataFrame([(1, 5)] * 20 + [(1, None)] * 3, "k int, v int")
    rows = number_in_key(df, "k", ["v"], 4).collect()
    assert sorted(x._number for x in rows) == list(range(23))
    assert {x._number for x in rows if x.v is None} == {0, 1, 2}


def test_members_take_the_current_row(spark):
    rows = [
        (1, 5, 0, None, "a", 1, "r"), (2, 5, 9, None, "a", 1, "r"), (2, 5, 9, None, "a", 1, "r"), (1, 7, 9, None, None, 1, "r"),
        (1, 8, None, None, None, 1, "r"), (None, 9, 9, None, None, 1, "r"), (1, None, 9, None, None, 1, "r"), (1, 6, 9, None, None, 1, "r"),
    ]
    got = {(x.cluster, x.seq_id, x.link) for x in members_with_successor(spark.createDataFrame(rows, FOREST), 2).collect()}
    assert got == {(9, 5, 6), (9, 6, 7), (9, 7, 9), (9, 9, None)}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], FOREST)
    assert members_with_successor(empty).collect() == []
    assert current_rows(empty, "seq_id", ["round"]).collect() == []
