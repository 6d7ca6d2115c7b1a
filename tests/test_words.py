from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from readskein.functions import bases as B

TURN = str.maketrans("ACGT", "TGCA")


def one(spark, value, expr):
    return spark.createDataFrame([(1, value)], "seq_id bigint, b string").select(expr.alias("x")).first().x


def test_words_and_samples(spark):
    b = "ACGTTGCAAACCGGTTACGTACGTACGTACGTAA"
    assert one(spark, b, B.words("b", 8)) == [b[i : i + 8] for i in range(len(b) - 7)]
    assert one(spark, b, B.sample_words("b")) == [b[8 * k : 8 * k + 8] for k in range(1, len(b) // 8 - 1)]
    assert one(spark, "ACG", B.words("b", 8)) == [] and one(spark, None, B.words("b", 8)) is None and one(spark, "ACG", B.sample_words("b")) == []


@settings(max_examples=15, deadline=None)
@given(st.text("ACGT", min_size=1, max_size=40))
def test_numbers_and_complements_round_trip(spark, w):
    df = spark.createDataFrame([(w,)], "b string")
    k = min(len(w), 20)
    row = df.select(B.reverse_complement("b").alias("r"), B.reverse_complement(B.reverse_complement("b")).alias("rr"), B.word_string(B.word_number(F.substring("b", 1, k)), k).alias("w")).first()
    assert row.r == w.translate(TURN)[::-1] and row.rr == w and row.w == w[:k]


def test_scalars(spark):
    assert one(spark, "acgN-T", B.strip_other("b")) == "acgT"
    assert one(spark, "AAAAACCG", B.collapse_runs("b", 3)) == "CCG"
    assert one(spark, "ACGTN-R", B.complement_ambiguous("b")) == "TGCAXX"
    assert one(spark, "ANGT", B.steady_bases("b", "seq_id")) == "A" + "ACGT"[(31 + 1) % 4] + "GT"
    assert one(spark, "x" * 130, B.wrapped("b", 60)).split("\n") == ["x" * 60, "x" * 60, "x" * 10]
    assert one(spark, "x" * 120, B.wrapped("b", 60)).split("\n") == ["x" * 60, "x" * 60]
    assert one(spark, " QV:H0 ", B.clone_name("b")) == "qv:h0" and one(spark, " - ", B.clone_name("b")) is None
    assert one(spark, ">gi|123|gb|AB77.1| text", B.accession("b")) == "AB77.1" and one(spark, "gi|123|x", B.accession("b")) == "123" and one(spark, "r1 clone 5", B.accession("b")) == "r1"
    assert one(spark, "g", B.base_code("b")) == 2 and one(spark, "N", B.base_code("b")) is None
    assert spark.range(1).select(B.base_letter(F.lit(3)).alias("x")).first().x == "T" and spark.range(1).select(B.base_letter(F.lit(9)).alias("x")).first().x == "M"
    assert one(spark, "ACXXXXXXNN", B.simple_word("b")) is False and one(spark, "ACGTACGTAX", B.simple_word("b")) is True
    m = one(spark, "ACGT" * 100, B.mutated("b", "seq_id", 20))
    assert len(m) == 400 and 40 < sum(a != b for a, b in zip(m, "ACGT" * 100)) < 130
