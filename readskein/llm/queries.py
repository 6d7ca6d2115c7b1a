"""The registered queries of this subpackage and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .frequency import ngram_marks, word_marks
from .groups import read_groups
from .leakage import leaked_items
from .mixing import Mixture
from .neardup import base_words, expand_pairs, similar_records
from .privacy import personal_items, redacted
from .spans import shared_spans


def p1_found(spark: SparkSession, base: str) -> DataFrame:
    return read_groups(*(table(spark, base, t) for t in ("reads", "reads2", "edges", "forest")))


def p3_found(spark: SparkSession, base: str) -> DataFrame:
    return shared_spans(table(spark, base, "reads"))


def p4_found(spark: SparkSession, base: str) -> DataFrame:
    pairs, members = similar_records(table(spark, base, "reads"), base_words(12, 40), threshold=0.5)
    return expand_pairs(pairs, members).select(F.col("a").alias("seq_a"), F.col("b").alias("seq_b"))


def p5_found(spark: SparkSession, base: str) -> DataFrame:
    return word_marks(table(spark, base, "wordlists")).where("mark is not null").select(F.col("word").cast("int").alias("word"), "mark")


def p5_ngrams(spark: SparkSession, base: str) -> DataFrame:
    """Runs of up to three words."""
    return ngram_marks(table(spark, base, "wordlists"), 3)


def p6_found(spark: SparkSession, base: str) -> DataFrame:
    return leaked_items(table(spark, base, "documents"), table(spark, base, "benchmark")).select("doc_id", "item_id")


def p6_near(spark: SparkSession, base: str) -> DataFrame:
    """Also passages of which one word is inserted, missing or another."""
    return leaked_items(table(spark, base, "documents"), table(spark, base, "benchmark"), edits=1)


def _mixture(spark: SparkSession, base: str) -> Mixture:
    return Mixture(table(spark, base, "documents"), table(spark, base, "mixture"))


def p7_mixed(spark: SparkSession, base: str) -> DataFrame:
    """The mixture itself: the documents' texts, as often as drawn, in random order."""
    return _mixture(spark, base).documents_mixed().select("place", "doc_id", "copy", "source", "text")


def p7_shares(spark: SparkSession, base: str) -> DataFrame:
    return _mixture(spark, base).shares()


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    return personal_items(table(spark, base, "documents")).select("doc_id", "kind", "value").distinct()


def p8_redacted(spark: SparkSession, base: str) -> DataFrame:
    return redacted(table(spark, base, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (p1_found, p3_found, p4_found, p5_found, p5_ngrams, p6_found, p6_near, p7_mixed, p7_shares, p8_found, p8_redacted)
    return {q.__name__: q for q in own}


P1_SQL = """
WITH RECURSIVE known AS (SELECT seq_id, clone FROM reads UNION ALL SELECT seq_id, clone FROM reads2),
ids AS (SELECT DISTINCT seq_id FROM known WHERE seq_id IS NOT NULL),
named AS (SELECT DISTINCT seq_id, lower(regexp_replace(clone, '^\\s+|\\s+$', '', 'g')) AS c FROM known
          WHERE regexp_matches(clone, '[\\p{L}\\p{N}]')),
raw AS (
  SELECT i AS a, j AS b FROM edges UNION SELECT seq_id, cluster FROM forest
  UNION SELECT seq_id, "match" FROM forest UNION SELECT seq_id, "next" FROM forest),
links AS (
  SELECT a, b FROM raw WHERE a <> b AND a IN (SELECT seq_id FROM ids) AND b IN (SELECT seq_id FROM ids)
  UNION SELECT n.seq_id, m.m FROM named n JOIN (SELECT c, min(seq_id) AS m FROM named GROUP BY c) m USING (c) WHERE n.seq_id <> m.m),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, seen) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.node, e.b FROM reach r JOIN both_ways e ON e.a = r.seen)
SELECT node AS seq_id, min(seen) AS group_id FROM reach GROUP BY node
"""

_ONE = "one AS (SELECT seq_id, upper(max(bases)) AS b FROM reads WHERE seq_id IS NOT NULL GROUP BY seq_id)"

P3_SQL = f"""
WITH {_ONE}, w AS MATERIALIZED (SELECT seq_id, p, substr(b, p, 60) AS s FROM (SELECT seq_id, b, unnest(generate_series(1, length(b) - 59)) AS p FROM one)
  WHERE NOT regexp_matches(substr(b, p, 60), '[^ACGT]')),
d AS (SELECT s FROM w GROUP BY s HAVING min(seq_id) < max(seq_id)),
h AS (SELECT seq_id, p, lead(p) OVER (PARTITION BY seq_id ORDER BY p) AS q FROM w WHERE s IN (SELECT s FROM d))
SELECT seq_id, CAST(sum(least(60, coalesce(q - p, 60))) AS BIGINT) AS n_shared FROM h GROUP BY seq_id
"""

P4_SQL = f"""
WITH {_ONE}, raw AS (SELECT seq_id, substr(b, p, 12) AS s FROM (SELECT seq_id, b, unnest(generate_series(1, length(b) - 11)) AS p FROM one)),
w AS MATERIALIZED (SELECT DISTINCT seq_id, least(s, reverse(translate(s, 'ACGT', 'TGCA'))) AS s FROM raw WHERE NOT regexp_matches(s, '[^ACGT]')),
n AS (SELECT seq_id, count(*) AS n FROM w GROUP BY seq_id HAVING count(*) >= 40),
v AS MATERIALIZED (SELECT w.* FROM w JOIN n USING (seq_id)),
c AS (SELECT x.seq_id AS a, y.seq_id AS b, count(*) AS c FROM v x JOIN v y ON x.s = y.s AND x.seq_id < y.seq_id GROUP BY ALL)
SELECT a AS seq_a, b AS seq_b FROM c JOIN n x ON x.seq_id = a JOIN n y ON y.seq_id = b WHERE c >= 0.5 * (x.n + y.n - c)
"""

P5_SQL = """
WITH w AS (SELECT seq_id, unnest(word_seen) AS word FROM wordlists WHERE seq_id IS NOT NULL),
v AS (SELECT * FROM w WHERE word IS NOT NULL AND word <> -1),
n AS (SELECT count(DISTINCT seq_id) AS n FROM v),
c AS (SELECT word, count(DISTINCT seq_id) AS r FROM v GROUP BY word)
SELECT word, CASE WHEN r <= 2 THEN 'rare' ELSE 'common' END AS mark FROM c, n WHERE r <= 2 OR r > 0.02 * n
"""

P5_NGRAMS_SQL = """
WITH l AS (SELECT row_number() OVER () AS line, seq_id, word_seen AS w FROM wordlists WHERE seq_id IS NOT NULL),
t AS (SELECT line, seq_id, generate_subscripts(w, 1) AS p, unnest(w) AS word FROM l),
v AS MATERIALIZED (SELECT * FROM t WHERE word IS NOT NULL AND word <> -1),
n AS (SELECT count(DISTINCT seq_id) AS n FROM v),
g AS (SELECT seq_id, CAST(word AS VARCHAR) AS ngram FROM v
  UNION ALL SELECT a.seq_id, concat(a.word, ' ', b.word) FROM v a JOIN v b ON a.line = b.line AND b.p = a.p + 1
  UNION ALL SELECT a.seq_id, concat(a.word, ' ', b.word, ' ', c.word) FROM v a JOIN v b ON a.line = b.line AND b.p = a.p + 1 JOIN v c ON c.line = a.line AND c.p = a.p + 2),
c AS (SELECT ngram, count(*) AS occurrences, count(DISTINCT seq_id) AS records FROM g GROUP BY ngram)
SELECT ngram, occurrences, records, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.02 * n THEN 'common' END AS mark FROM c, n
"""


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_SQL, "p3_found": P3_SQL, "p4_found": P4_SQL, "p5_found": P5_SQL, "p5_ngrams": P5_NGRAMS_SQL}
