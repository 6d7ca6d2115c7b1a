import random
from collections import Counter

from readskein.plans import queries as Q

READ = "seq_id bigint, id string, clone string, bases string, len int"


def tables(spark, tmp_path, reads, reads2):
    """Folder with reads and reads2 of these (seq_id, bases)."""
    for name, rows in (("reads", reads), ("reads2", reads2)):
        spark.createDataFrame([(i, f"r{i}", None, b, len(b)) for i, b in rows], READ).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_words_of_all_reads(spark, tmp_path):
    rows = [(1, "ACGTTGCAAC"), (70, "TTGCAAACCGG"), (71, "ACG")]
    base = tables(spark, tmp_path, rows[1:], rows[:1])
    got = {(r.seq_id, r.pos, r.word) for r in Q.queries()["kmer_explode_all"](spark, base).collect()}
    assert got == {(i, p, b[p : p + 8]) for i, b in rows for p in range(len(b) - 7)}


def test_whole_distance_of_candidates_among_all_reads(spark, tmp_path):
    r = random.Random(2)
    one = "".join(r.choice("ACGT") for _ in range(300))
    rows = {1: one[:200], 70: one[20:240], 71: one[60:300], 72: "".join(r.choice("ACGT") for _ in range(200))}
    base = tables(spark, tmp_path, [(i, b) for i, b in rows.items() if i > 64], [(1, rows[1])])
    count = lambda b: Counter(b[p : p + 6] for p in range(len(b) - 5))
    want = {(i, j): sum((count(rows[i])[w] - count(rows[j])[w]) ** 2 for w in count(rows[i]) | count(rows[j])) for i, j in ((1, 70), (1, 71), (70, 71))}
    assert {(x.i, x.j): x.d2 for x in Q.queries()["d2_whole_candidates"](spark, base).collect()} == want
