import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readskein.llm import neardup as N
from readskein.functions.arrays import flat, packed, turned, windows_ok
from readskein.llm.spans import anchors, shared_spans

TURN = str.maketrans("ACGT", "TGCA")


def brute_spans(rows, span):
    where, out = {}, {}
    for i, b in rows:
        for m in re.finditer(f"[ACGT]{{{span},}}", (b or "").upper()):
            for p in range(m.start(), m.end() - span + 1):
                where.setdefault(b.upper()[p : p + span], set()).add(i)
    for i, b in dict(rows).items():
        seen = set()
        for m in re.finditer(f"[ACGT]{{{span},}}", (b or "").upper()):
            for p in range(m.start(), m.end() - span + 1):
                if len(where[b.upper()[p : p + span]]) > 1:
                    seen.update(range(p, p + span))
        if seen and i is not None:
            out[i] = len(seen)
    return out


def reads(seed, n=60, low=False):
    r = random.Random(seed)
    letters = "AAAAAAC" if low else "ACGT"
    pool = ["".join(r.choice(letters) for _ in range(400)) for _ in range(5)]
    rows = []
    for i in range(n):
        b = "".join(r.choice(letters) for _ in range(r.randrange(0, 150)))
        if r.random() < 0.6:
            p, at, k = r.choice(pool), r.randrange(300), r.randrange(20, 200)
            b = b[: len(b) // 2] + p[at : at + k] + b[len(b) // 2 :]
        if r.random() < 0.2 and b:
            at = r.randrange(len(b))
            b = b[:at] + r.choice("NnX-é") + b[at:]
        rows.append((i, b.lower() if r.random() < 0.2 else b))
    return [*rows, (900, None), (901, ""), (902, "ACGT"), rows[0], (None, pool[0]), (903, "A" * 500), (904, "A" * 300 + "C" + "A" * 70)]


@pytest.mark.parametrize("seed,low,span", [(1, False, 60), (2, True, 60), (3, False, 31), (4, False, 100)])
def test_spans_match_brute_force(spark, seed, low, span):
    rows = reads(seed, low=low)
    df = spark.createDataFrame(rows, "seq_id bigint, bases string").withColumns({"id": F.lit("x"), "text": F.lit("y"), "symbol": F.lit(1)}).repartition(4)
    known = [x for x in rows if x[0] is not None]
    got = shared_spans(df, span=span).collect()
    assert {r.seq_id: r.n_shared for r in got} == brute_spans(known, span) and len(got) == len({r.seq_id for r in got})


def test_spans_of_nothing(spark):
    assert shared_spans(spark.createDataFrame([], "seq_id bigint, bases string")).collect() == []
    with pytest.raises(ValueError):
        shared_spans(spark.createDataFrame([], "seq_id bigint, bases string"), span=10)


def test_equal_windows_get_equal_symbols():
    r = random.Random(8)
    core = "".join(r.choice("ACGT") for _ in range(140))
    texts = ["".join(r.choice("ACGT") for _ in range(r.randrange(0, 90))) + core + "".join(r.choice("ACGT") for _ in range(r.randrange(0, 90))) for _ in range(30)]
    codes, offsets = flat(pa.array(texts))
    row, start, count, symbol = anchors(codes, offsets, 60)
    assert count.sum() == sum(len(t) - 59 for t in texts)
    of = {}
    for w, s, c, x in zip(row, start, count, symbol, strict=True):
        for k in range(c):
            of.setdefault(texts[w][s - offsets[w] + k : s - offsets[w] + k + 60], set()).add(int(x))
    assert all(len(x) == 1 for x in of.values())


def test_a_very_long_read(spark):
    r = random.Random(4)
    long = "".join(r.choice("ACGT") for _ in range(300_000))
    df = spark.createDataFrame([(1, long), (2, long[1000:1100]), (3, long[299_000:])], "seq_id bigint, bases string")
    assert {x.seq_id: x.n_shared for x in shared_spans(df).collect()} == {1: 1100, 2: 100, 3: 1000}


def test_words():
    text = "ACGTNACGTTGCAacgtta"
    codes, offsets = flat(pa.array([text, "", "AC", "GGGTTTACC"]))
    at, row = windows_ok(codes, offsets, 4)
    word = np.minimum(packed(codes, 4)[at], turned(codes, 4)[at])
    number = lambda w: int("".join(str("ACGT".index(c)) for c in w), 4)
    want = []
    for i, t in enumerate([text, "", "AC", "GGGTTTACC"]):
        for p in range(len(t) - 3):
            w = t[p : p + 4].upper()
            if set(w) <= set("ACGT"):
                want.append((min(number(w), number(w.translate(TURN)[::-1])), i))
    assert sorted(zip(word.tolist(), row.tolist(), strict=True)) == sorted(want)
    r = random.Random(2)
    b = "".join(r.choice("ACGT") for _ in range(80))
    for k in (1, 7, 12, 30, 31):
        assert packed(flat(pa.array([b]))[0], k).tolist() == [number(b[p : p + k]) for p in range(81 - k)]


def word_set(b, k=12):
    out = set()
    for p in range(len(b or "") - k + 1):
        w = b[p : p + k].upper()
        if set(w) <= set("ACGT"):
            out.add(min(w, w.translate(TURN)[::-1]))
    return out


def test_similar_reads_match_brute_force(spark):
    r = random.Random(12)
    rows = []
    for f in range(40):
        root = "".join(r.choice("ACGT") for _ in range(300))
        for m in range(4):
            b = list(root)
            for _ in range(r.randrange(0, 14)):
                b[r.randrange(300)] = r.choice("ACGTN")
            b = "".join(b)
            b = b.translate(TURN)[::-1] if r.random() < 0.5 else b
            rows.append((10 * f + m, b.lower() if m == 1 else b))
        rows.append((10 * f + 7, rows[-1][1]))  # an exact copy
        rows.append((10 * f + 8, "".join(r.choice("ACGT") for _ in range(60)) + "A" * 40))  # alike tails only
    rows += [(1000, None), (1001, ""), (1002, "ACGTAC"), rows[0], (None, rows[0][1])]
    sets = {i: word_set(b) for i, b in rows if i is not None}
    sets = {i: s for i, s in sets.items() if len(s) >= 40}
    want = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    df = spark.createDataFrame(rows, "seq_id bigint, bases string").withColumns({"id": F.lit(0), "text": F.lit(""), "node": F.lit(0), "rep": F.lit(1)})
    pairs, members = N.similar_records(df, N.base_words(12, 40), threshold=0.5)
    got = [tuple(x) for x in N.expand_pairs(pairs, members).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(set(got)) >= 0.995 * len(want)
    assert {x.id for x in members.collect()} == set(sets)
    reps = {x.id: x.rep for x in members.collect()}
    assert all(reps[10 * f + 7] == reps[10 * f + 3] for f in range(40))


def test_similar_texts_at_the_usual_setting(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for f in range(30):
        t = [r.choice(vocabulary) for _ in range(120)]
        rows.append((2 * f, " ".join(t)))
        t[r.randrange(120)] = "changed"
        rows.append((2 * f + 1, ", ".join(t).upper()))
    rows += [(500, "two words"), (501, "Two  words!"), (502, "..."), (503, None), (504, "")]
    pairs, members = N.similar_records(spark.createDataFrame(rows, "doc_id bigint, text string"), N.text_words(), "doc_id", "text")
    assert {(x.a, x.b) for x in pairs.collect()} == {(2 * f, 2 * f + 1) for f in range(30)}
    assert {x.id: x.rep for x in members.where("id >= 500").collect()} == {500: 500, 501: 500}


def test_nothing_similar(spark):
    pairs, members = N.similar_records(spark.createDataFrame([], "seq_id bigint, bases string"), N.base_words(12, 40), threshold=0.5)
    assert pairs.collect() == [] and members.collect() == []


def test_forest_shape_reaches_the_recall():
    for t in (0.3, 0.5, 0.8, 0.95):
        trees, d = N.forest_shape(t)
        assert 1 - (1 - t**d) ** trees >= N.RECALL
    assert N.forest_shape(0.8)[1] > N.forest_shape(0.5)[1]


def test_minima_agree_as_often_as_words_do():
    r = np.random.default_rng(3)
    for size in (60, 400):
        agree = []
        for _ in range(60):
            common, one, two = r.integers(0, 1 << 40, size), r.integers(0, 1 << 40, size // 2), r.integers(0, 1 << 40, size // 2)
            word = np.concatenate([common, one, common, two])
            row = np.repeat([0, 1], [size + size // 2] * 2)
            least = N.minima(word, row, 2, 260)
            agree.append((least[0] == least[1]).mean())
        assert abs(np.mean(agree) - 0.5) < 0.02
    few = N.minima(np.array([5, 9, 5, 9, 1]), np.array([0, 0, 1, 1, 2]), 3, 260)
    assert (few[0] == few[1]).all() and not (few[0] == few[2]).all() and len(np.unique(few[2])) > 100


def test_the_prefix_is_shortened_until_the_recall_is_reached(spark):
    trees, d = N.forest_shape(0.5)
    of = lambda *s: spark.createDataFrame([(x,) for x in s], "similarity double")
    assert N.estimated_recall(of(0.95, 1.0), d + 2, trees) >= N.RECALL
    assert N.estimated_recall(of(0.95, 0.5, 0.5), d + 2, trees) < 0.9 < N.estimated_recall(of(0.5), d + 1, trees) < N.RECALL
    assert N.estimated_recall(of(0.5), d, trees) >= N.RECALL and N.estimated_recall(of(0.5).limit(0), d, trees) == 0


@pytest.mark.parametrize("k", [5, 12, 20, 25, 31])
def test_words_of_any_length_are_compared_exactly(k):
    r = random.Random(k)
    texts = ["".join(r.choice("ACGTN") if r.random() < 0.03 else r.choice("ACGT") for _ in range(r.randrange(0, 120))) for _ in range(20)]
    texts += [t[3:] + "ACG" for t in texts]
    left, right = [r.choice(texts) for _ in range(60)], [r.choice(texts) for _ in range(60)]
    common, a, b = N.base_words(k, 1).compared(pa.array(left), pa.array(right))
    for x, y, c, m, n in zip(left, right, common, a, b, strict=True):
        u, v = word_set(x, k), word_set(y, k)
        assert (c, m, n) == (len(u & v), len(u), len(v))
    with pytest.raises(ValueError):
        N.base_words(32, 1)


def test_shingles_are_compared_word_by_word():
    r = random.Random(6)
    texts = [" ".join(r.choice(["a", "b", "É", "d1"]) for _ in range(r.randrange(0, 14))) for _ in range(30)]
    left, right = [r.choice(texts) for _ in range(80)], [r.choice(texts) for _ in range(80)]
    shingles = lambda t: {tuple(t.lower().split()[p : p + 5]) for p in range(max(1, len(t.split()) - 4))} - {()}
    common, a, b = N.text_words().compared(pa.array(left), pa.array(right))
    for x, y, c, m, n in zip(left, right, common, a, b, strict=True):
        assert (c, m, n) == (len(shingles(x) & shingles(y)), len(shingles(x)), len(shingles(y)))


def test_a_node_of_many_records_meets_in_blocks(spark, monkeypatch):
    r = random.Random(8)
    root = "".join(r.choice("ACGT") for _ in range(300))
    rows = []
    for i in range(60):
        b = list(root)
        b[r.randrange(300)] = "ACGT"[i % 4]
        rows.append((i, "".join(b)))
    df = spark.createDataFrame(rows, "seq_id bigint, bases string")
    run = lambda: {tuple(x) for x in N.expand_pairs(*N.similar_records(df, N.base_words(12, 40), threshold=0.5)).collect()}
    plain = run()
    monkeypatch.setattr(N, "BLOCK", 16)
    assert run() == plain == {(a, b) for a in range(60) for b in range(a + 1, 60)}


def test_a_symbol_of_very_many_records_is_dealt_out(spark, monkeypatch):
    from readskein.llm import spans as S

    rows = [(i, "ACGTTGCA"[i % 5 :] + "A" * (70 + i % 9) + "C" * (i % 3)) for i in range(60)] + reads(6, 40)
    rows = [x for x in rows if x[0] is not None and x[0] < 900] + [(2000, "T" * 200)]
    rows = [(1000 + k, b) for k, (_, b) in enumerate(rows)]
    df = spark.createDataFrame(rows, "seq_id bigint, bases string")
    want = brute_spans(rows, 60)
    assert {r.seq_id: r.n_shared for r in shared_spans(df).collect()} == want
    monkeypatch.setattr(S, "ROWS", 100)
    monkeypatch.setattr(S, "STRIP", 64)
    asked = []
    monkeypatch.setattr(S, "frequent_keys", lambda df, n, keys, buckets: asked.append({int(k): 3 for k in np.unique(keys(pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows]), pa.array([b for _, b in rows])], ["id", "text"])))}) or asked[-1])
    assert {r.seq_id: r.n_shared for r in shared_spans(df).collect()} == want and asked
