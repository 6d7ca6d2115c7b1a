import random
from collections import Counter

import numpy as np
import pytest

from readskein.config import ClusterConfig
from readskein.operators import distance as D
from readskein.config import EditCosts
from readskein.sources.files import MANUAL_COSTS, parse_costs

R = random.Random(3)


def bases(n):
    return "".join(R.choice("ACGT") for _ in range(n))


def brute_d2(a, b, window, word):
    def counts(s):
        return [Counter(s[x + i : x + i + word] for i in range(window - word + 1)) for x in range(len(s) - window + 1)]

    return min(sum((p[w] - q[w]) ** 2 for w in p.keys() | q.keys()) for p in counts(a) for q in counts(b))


def brute_edit(a, b, c):
    code = {x: i for i, x in enumerate("ACGT")}
    big = 10**9
    h, e, f = ([[0] * (len(b) + 1) for _ in range(len(a) + 1)], [[big] * (len(b) + 1) for _ in range(len(a) + 1)], [[big] * (len(b) + 1) for _ in range(len(a) + 1)])
    best = 0
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            e[i][j] = min(e[i][j - 1], h[i][j - 1] + c.open) + c.extend
            f[i][j] = min(f[i - 1][j], h[i - 1][j] + c.open) + c.extend
            h[i][j] = min(0, e[i][j], f[i][j], h[i - 1][j - 1] + c.table[code[a[i - 1]]][code[b[j - 1]]])
            best = min(best, h[i][j])
    return best


@pytest.mark.parametrize("skip_cells", [4_000_000, 400])
def test_windows_match_brute_force(monkeypatch, skip_cells):
    monkeypatch.setattr(D, "CELLS", skip_cells)
    for _ in range(4):
        a, b = bases(45), bases(40)
        b = b[:10] + a[8:30] + b[32:]
        assert D.d2_windows(D.codes(a), D.codes(b), 20, 4) == brute_d2(a, b, 20, 4)


def test_properties():
    a, b = bases(150), bases(140)
    x, y = D.codes(a), D.codes(b)
    assert D.d2_windows(x, x, 100, 6) == 0
    assert D.d2_windows(x, y, 100, 6) == D.d2_windows(y, x, 100, 6)
    assert D.d2_windows(x[:50], y, 100, 6) is None
    turn = lambda s: s.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    assert D.d2_windows(x, D.codes(turn(b)), 100, 6) == D.d2_windows(D.codes(turn(a)), y, 100, 6)


def test_edit_matches_brute_force():
    for costs in (EditCosts(), MANUAL_COSTS):
        for _ in range(5):
            a, b = bases(30), bases(26)
            b = b[:5] + a[4:15] + a[17:25] + b[20:]
            assert D.local_edit(D.codes(a), D.codes(b), costs) == brute_edit(a, b, costs)
    a = bases(60)
    assert D.local_edit(D.codes(a), D.codes(a), EditCosts()) == -60
    assert D.local_edit(D.codes(""), D.codes(a), EditCosts()) == 0


def test_ends():
    a, b, m = bases(60), bases(60), bases(40)
    assert D.ends(D.codes(m), D.codes(m), 6) == 0
    whole = lambda s, t: sum((Counter(s[i : i + 6] for i in range(len(s) - 5))[w] - Counter(t[i : i + 6] for i in range(len(t) - 5))[w]) ** 2 for w in {s[i : i + 6] for i in range(len(s) - 5)} | {t[i : i + 6] for i in range(len(t) - 5)})
    assert D.ends(D.codes(a), D.codes(b[:40]), 6) == min(whole(a[-40:], b[:40]), whole(a[:40], b[:40]))


def test_cost_file_and_registry(spark):
    c = parse_costs("-1 3 3 3\n3 -1 3 3\n3 3 -1 3\n3 3 3 -1\n5 2\n")
    assert c == MANUAL_COSTS
    with pytest.raises(ValueError):
        parse_costs("1 2 3")
    with pytest.raises(ValueError):
        D.settled(ClusterConfig(distance="nothing"))
    D.register_distance("lengths", lambda a, b: abs(len(a) - len(b)))
    reads = spark.createDataFrame([(1, bases(120)), (2, bases(118)), (3, bases(60))], "seq_id bigint, bases string")
    pairs = spark.createDataFrame([(1, 2), (1, 3), (1, 9)], "i bigint, j bigint")
    got = D.scored_pairs(pairs, reads, ClusterConfig(distance="lengths", rc_check=False, theta=5), filtered=False)
    assert {(r.i, r.j, r.dist) for r in got.collect()} == {(1, 2, 2), (1, 3, 60)}
    assert {(r.i, r.j) for r in D.matching(got, ClusterConfig(distance="lengths", theta=5)).collect()} == {(1, 2)}


def test_short_reads_get_scaled_thresholds():
    c = ClusterConfig()
    assert D.thresholds(c, 200, 200) == (40, 70, 4)
    assert D.thresholds(c, 200, 80) == (80 * 40 // 100, 50, 4 - ((116 - 80) >> 4))


def test_word_hits():
    a = bases(200)
    sample, hits = D.word_hits(D.codes(a), D.codes(a), 100)
    assert sample == 200 // 8 - 2 and hits == 107
    assert D.word_hits(D.codes(a), D.codes("ACGT"), 100) == (0, 0)
    assert isinstance(np.int64(hits), np.int64)


def test_edit_costs_of_many_pairs_are_those_of_each():
    import random

    from readskein.config import EditCosts
    from readskein.sources.files import MANUAL_COSTS

    r = random.Random(2)
    some = lambda n: "".join(r.choice("ACGTN") for _ in range(n))
    pairs = [(D.codes(""), D.codes("ACGT")), (D.codes("ACGT"), D.codes("")), (D.codes("A"), D.codes("A"))]
    for _ in range(70):
        a = some(r.randrange(1, 90))
        pairs.append((D.codes(a), D.codes(a[r.randrange(len(a)) :] + some(r.randrange(60)) + a[:20])))
    for costs in (EditCosts(), MANUAL_COSTS, EditCosts(open=3, extend=0), EditCosts(open=-3, extend=1)):
        assert D.local_edits(pairs, costs, together=9) == [D.local_edit(a, b, costs) for a, b in pairs]


def test_scores_come_from_as_many_tasks_as_the_session_asks_for(spark):
    reads = spark.createDataFrame([(i, "ACGTTGCA" * 15 + "ACGT" * (i % 7)) for i in range(40)], "seq_id bigint, bases string")
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40)], "i bigint, j bigint")
    got = D.scored_pairs(pairs, reads, ClusterConfig(distance="ed"), filtered=False)
    assert got.count() == 2 * 780
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_bases_of_a_read_stand_once_for_many_pairs(spark):
    from readskein.operators.beside import Group, beside

    rows = spark.createDataFrame([(k, bytes([65 + k % 26]) * (k % 50)) for k in range(120)], "seq bigint, data binary")
    pairs = spark.createDataFrame([(i, j, i * 1000 + j) for i in (3, 7, 60, 500) for j in range(118, 130)] + [(i, i + 1, 5) for i in range(110)], "i bigint, j bigint, x bigint")

    def look(groups):
        for g in groups:
            assert isinstance(g, Group) and len(set(g.i.tolist())) == len(g.i)
            first = [bytes(g.one[g.one_offsets[x] : g.one_offsets[x + 1]]) for x in g.at_one]
            second = [bytes(g.two[g.two_offsets[x] : g.two_offsets[x + 1]]) if x >= 0 else None for x in g.at_two]
            import pyarrow as pa

            cols = [pa.array(g.i[g.at_one]), pa.array(g.j), pa.array(g.numbers[0]), pa.array(first, pa.binary()), pa.array(second, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["i", "j", "x", "a", "b"])

    got = sorted((r.i, r.j, r.x, bytes(r.a), bytes(r.b) if r.b is not None else None) for r in beside(pairs, rows, look, "i bigint, j bigint, x bigint, a binary, b binary", 10).collect())
    of = lambda k: bytes([65 + k % 26]) * (k % 50) if k < 120 else None
    want = sorted((r.i, r.j, r.x, of(r.i), of(r.j)) for r in pairs.collect() if r.i < 120)
    assert [x[:4] for x in got] == [x[:4] for x in want] and [x[4] for x in got] == [x[4] for x in want]


def test_word_hits_with_other_characters():
    import random

    r = random.Random(5)
    for n in (7, 8, 40, 130, 300):
        a = "".join(r.choice("ACGTACGTACGTN") for _ in range(n))
        b = a[n // 3 :] + "".join(r.choice("ACGTRN") for _ in range(60)) + a[: n // 2]
        own = {a[k : k + 8].replace("R", "N") for k in range(n - 7)}
        hit = [b[k : k + 8].replace("R", "N") in own for k in range(len(b) - 7)]
        last = len(b) // 8 - 2
        want = sum(hit[8 : 8 * last + 1 : 8]), max((sum(hit[max(0, k - 57) : k]) for k in range(1, len(hit) + 1)), default=0)
        assert D.word_hits(D.codes(a), D.codes(b), 50) == want == D.word_hits(D.WordSet(D.codes(a)), D.codes(b), 50)


def test_windows_of_strings_of_several_kinds_and_sizes():
    import random

    r = random.Random(8)
    for window, word, skip, letters in ((20, 4, 1, "ACGT"), (33, 6, 3, "ACGTN"), (30, 3, 1, "AAAC"), (300, 6, 1, "ACGT"), (290, 8, 1, "ACGT")):
        a = "".join(r.choice(letters) for _ in range(window + 40))
        b = "".join(r.choice("ACGT") for _ in range(9)) + a[5 : window + 20] + "".join(r.choice(letters) for _ in range(20))
        n = window - word + 1
        count = lambda s, at: Counter(s[at + k : at + k + word] for k in range(n))
        right = [count(b, y) for y in range(len(b) - window + 1)]
        want = min(sum((c[w] - d[w]) ** 2 for w in c.keys() | d.keys()) for c in (count(a, x) for x in range(0, len(a) - window + 1, skip)) for d in right)
        assert D.d2_windows(D.codes(a), D.codes(b), window, word, skip) == want


def test_distances_alone_are_those_with_counts(spark):
    reads = spark.createDataFrame([(i, bases(150)) for i in range(6)], "seq_id bigint, bases string")
    pairs = spark.createDataFrame([(i, j) for i in range(6) for j in range(i)], "i bigint, j bigint")
    of = lambda **k: {(r.i, r.j, r.strand): r.dist for r in D.scored_pairs(pairs, reads, ClusterConfig(), filtered=False, **k).collect()}
    assert of(counted=False) == of() and len(of()) == 30
    with pytest.raises(ValueError):
        D.scored_pairs(pairs, reads, ClusterConfig(), counted=False)


def test_edit_costs_by_letters_at_any_width(monkeypatch):
    table = lambda equal, other: tuple(tuple(equal if x == y else other for y in range(4)) for x in range(4))
    some = lambda n: "".join(R.choice("ACGTN") for _ in range(n))
    pairs = [(D.codes(x), D.codes(y)) for x, y in (("", "A"), ("A", ""), ("N", "N"), ("A", "A"), ("A", "C"), ("ACGTACGTA", "A"))]
    for _ in range(60):
        a = some(R.randrange(1, 70))
        pairs.append((D.codes(a), D.codes(a[R.randrange(len(a)) :] + some(R.randrange(40)) + a[:20])))
    plain = (EditCosts(), MANUAL_COSTS, EditCosts(open=-1), EditCosts(table=table(-1, 0)), EditCosts(table(-300, 200), 90, 7), EditCosts(table(-1000, 900), 90, 70), EditCosts(table(2, 2)), EditCosts(open=40_000))
    with monkeypatch.context() as m:
        m.setattr(D, "_edits_by_table", None)  # none of these asks for the table
        for costs in plain:
            for together in (1, 9, 256):
                assert D.local_edits(pairs, costs, together) == [D.local_edit(a, b, costs) for a, b in pairs]
    odd = tuple(tuple(-1 if x == y else 2 + abs(x - y) for y in range(4)) for x in range(4))
    for costs in (EditCosts(odd), EditCosts(table(3, 2)), EditCosts(table(-2000, 900), 1, 1)):
        assert D.local_edits(pairs, costs) == [D.local_edit(a, b, costs) for a, b in pairs]


def test_pairs_of_several_groups_are_scored_at_once(spark):
    D.register_distance("together", D.Distance(lambda *_: None, many=lambda pairs, c: [len(pairs)] * len(pairs)))
    reads = spark.createDataFrame([(i, bases(50)) for i in range(40)], "seq_id bigint, bases string")
    pairs = spark.createDataFrame([(i, j) for i in range(40) for j in range(i + 1, 40)], "i bigint, j bigint")
    got = [r.dist for r in D.scored_pairs(pairs, reads, ClusterConfig(distance="together", rc_check=False), filtered=False).collect()]
    assert len(got) == 780 and round(sum(1 / n for n in got)) <= int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_word_hits_of_many_pairs_are_those_of_each():
    some = lambda n, letters="ACGT": "".join(R.choice(letters) for _ in range(n))
    pairs = []
    for n in (0, 1, 7, 8, 9, 15, 16, 23, 24, 31, 40, 107, 113, 114, 115, 150, 300) * 3:
        a = some(n, R.choice(["ACGT", "ACGT", "ACGTN"]))
        b = a[n // 3 :] + some(R.randrange(60), R.choice(["ACGT", "ACGTR"])) + a[: n // 2]
        pairs += [(D.codes(a), D.codes(b)), (D.codes(b), D.codes(a)), (D.codes(a), D.codes(a)), (D.codes(a), D.codes(some(9)))]
    for window, together, most in ((100, 64, 1_000_000), (50, 3, 1_000_000), (20, 64, 300)):
        assert D.pair_hits(pairs, window, together, most) == [D.word_hits(a, b, window) for a, b in pairs]
