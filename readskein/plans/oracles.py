"""SQL that gives the same rows as the queries of the core, for DuckDB on the same tables."""

from __future__ import annotations

_CLONE = r"CASE WHEN regexp_matches(clone, '[\p{L}\p{N}]') THEN lower(regexp_replace(clone, '^\s+|\s+$', '', 'g')) END"


def _clean(source: str, name: str) -> str:
    """Common table expressions of the reads of a table in shape."""
    return rf"""
{name}_one AS (SELECT seq_id, max(id) AS id, max({_CLONE}) AS clone, upper(coalesce(max(bases), '')) AS b FROM {source} WHERE seq_id IS NOT NULL GROUP BY seq_id),
{name} AS MATERIALIZED (SELECT seq_id, coalesce(id, CAST(seq_id AS VARCHAR)) AS id, clone,
  CASE WHEN regexp_matches(b, '[^ACGT]') THEN array_to_string(list_transform(generate_series(1, length(b)), lambda p:
    CASE WHEN substr(b, p, 1) IN ('A', 'C', 'G', 'T') THEN substr(b, p, 1) ELSE substr('ACGT', ((seq_id * 31 + p - 1) % 4) + 1, 1) END), '') ELSE b END AS bases FROM {name}_one)"""


R1 = _clean("reads", "r")
R2 = _clean("reads2", "r2")
ALL = R1 + "," + R2 + ",\nra AS (SELECT * FROM r UNION ALL SELECT * FROM r2)"
RC = "reverse(translate({0}, 'ACGT', 'TGCA'))"
IDS = "ids AS (SELECT DISTINCT seq_id FROM (SELECT seq_id FROM reads UNION ALL SELECT seq_id FROM reads2) WHERE seq_id IS NOT NULL)"
EDGES = IDS + """,
e AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, CASE WHEN strand < 0 THEN -1 ELSE 1 END AS strand FROM edges
  WHERE i <> j AND i IN (SELECT seq_id FROM ids) AND j IN (SELECT seq_id FROM ids))"""


def _forest(name: str, where: str = "") -> str:
    return f"""{name} AS MATERIALIZED (SELECT seq_id, cluster AS cluster_id FROM (
  SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY round DESC NULLS LAST, saved_at DESC NULLS LAST, cluster DESC NULLS LAST) AS rn FROM forest WHERE seq_id IS NOT NULL {where})
  WHERE rn = 1 AND cluster IS NOT NULL)"""


CUR, FIRST = _forest("cur"), _forest("fst", "AND round = 1")
ASKED = 'asked AS (SELECT DISTINCT "index" AS seq_id FROM progopts WHERE "index" IN (SELECT seq_id FROM ids))'


def _components(links: str, nodes: str = "ids") -> str:
    """The end of a recursive query: components of ``links`` (i, j) over ``nodes`` (seq_id)."""
    return f"""
both_ways AS MATERIALIZED (SELECT i AS a, j AS b FROM ({links}) UNION SELECT j, i FROM ({links})),
reach(node, seen) AS (SELECT DISTINCT a, a FROM both_ways UNION SELECT r.node, x.b FROM reach r JOIN both_ways x ON x.a = r.seen),
labelled AS (SELECT n.seq_id, coalesce(min(r.seen), n.seq_id) AS cluster_id FROM {nodes} n LEFT JOIN reach r ON r.node = n.seq_id GROUP BY n.seq_id)"""


def _clusters(ctes: str, links: str, nodes: str = "ids", select: str = "SELECT seq_id, cluster_id FROM labelled") -> str:
    return f"WITH RECURSIVE {ctes},{_components(links, nodes)}\n{select}"


def _words(k: int, both: bool, name: str, source: str = "r", where: str = "") -> str:
    def part(b: str) -> str:
        return f"SELECT seq_id, p - 1 AS pos, substr({b}, p, {k}) AS word FROM (SELECT seq_id, bases, unnest(generate_series(1, length(bases) - {k - 1})) AS p FROM {source} WHERE length(bases) >= {k} {where})"

    return f"{name} AS MATERIALIZED ({part('bases')}" + (f" UNION ALL {part(RC.format('bases'))}" if both else "") + ")"


def _table(words: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT seq_id, word, count(*) AS n, min(pos) AS f, max(pos) AS l FROM {words} GROUP BY ALL)"


def _candidates(k: int = 16, alpha: int = 3, beta: int = 45, window: int = 100, symmetric: bool = False, reads: str = R1) -> str:
    long = "AND length(bases) >= 40"
    last = (
        f"shared >= {alpha} AND span >= {beta}"
        if symmetric
        else f"((SELECT length(bases) FROM r WHERE r.seq_id = i) < {window} AND span >= {beta >> 2}) OR (shared >= {alpha} AND span >= {beta})"
    )
    return f"""{reads}, {_words(k, False, "wf", where=long)}, {_words(k, True, "wa", where=long)}, {_table("wf", "tf")}, {_table("wa", "ta")},
met AS (SELECT a.seq_id AS i, b.seq_id AS j, CAST(sum(a.n * b.n) AS BIGINT) AS shared, CAST(max(a.l) - min(a.f) AS INTEGER) AS span
  FROM tf a JOIN ta b ON a.word = b.word AND a.seq_id {"<>" if symmetric else "<"} b.seq_id GROUP BY 1, 2),
cand AS MATERIALIZED (SELECT * FROM met WHERE {last})"""


HITS = f"""{_candidates()},
pr AS (SELECT i, j, x.bases AS bi, y.bases AS bj FROM cand JOIN r x ON x.seq_id = i JOIN r y ON y.seq_id = j),
sides AS MATERIALIZED (SELECT i, j, 1 AS strand, bi, bj AS b FROM pr UNION ALL SELECT i, j, -1, bi, {RC.format("bj")} FROM pr),
w8 AS MATERIALIZED (SELECT DISTINCT seq_id, substr(bases, p, 8) AS word FROM (SELECT seq_id, bases, unnest(generate_series(1, length(bases) - 7)) AS p FROM r WHERE length(bases) >= 8)),
wj AS (SELECT i, j, strand, length(b) AS n, p - 1 AS pos, substr(b, p, 8) AS word FROM (SELECT *, unnest(generate_series(1, length(b) - 7)) AS p FROM sides)),
hit AS (SELECT wj.*, CASE WHEN w8.word IS NULL THEN 0 ELSE 1 END AS h FROM wj LEFT JOIN w8 ON w8.seq_id = wj.i AND w8.word = wj.word),
run AS (SELECT *, sum(h) OVER (PARTITION BY i, j, strand ORDER BY pos ROWS BETWEEN 106 PRECEDING AND CURRENT ROW) AS t FROM hit),
hits AS MATERIALIZED (SELECT i, j, CAST(strand AS INTEGER) AS strand, CAST(sum(CASE WHEN pos % 8 = 0 AND pos >= 8 AND pos // 8 <= n // 8 - 2 THEN h ELSE 0 END) AS INTEGER) AS sample, CAST(max(t) AS INTEGER) AS hits FROM run GROUP BY 1, 2, 3)"""

_RECORD = (
    "concat('>', id, CASE WHEN clone IS NULL THEN '' ELSE concat(' clone ', clone) END, chr(10), "
    "array_to_string(list_transform(generate_series(0, greatest(0, (length(bases) - 1) // 80)), lambda q: substr(bases, q * 80 + 1, 80)), chr(10)))"
)


def _wrap(b: str) -> str:
    return f"array_to_string(list_transform(generate_series(0, greatest(0, (length({b}) - 1) // 60)), lambda q: substr({b}, q * 60 + 1, 60)), chr(10))"


def _pairs_of(n: str) -> str:
    return f"CAST(coalesce(sum({n} * ({n} - 1) / 2), 0) AS BIGINT)"


def _confusion(ctes: str) -> str:
    """Ends with ``conf`` from ``m`` (ca, cb)."""
    return f"""{ctes},
x AS MATERIALIZED (SELECT ca, cb, count(*) AS n FROM m GROUP BY ALL),
pa AS (SELECT {_pairs_of("n")} AS v FROM (SELECT CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY ca)),
pb AS (SELECT {_pairs_of("n")} AS v FROM (SELECT CAST(sum(n) AS BIGINT) AS n FROM x GROUP BY cb)),
tt AS (SELECT {_pairs_of("n")} AS tp, CAST(coalesce(sum(n), 0) AS BIGINT) AS al FROM x),
conf AS (SELECT tp, pa.v - tp AS fp, pb.v - tp AS fn, CAST(al * (al - 1) / 2 AS BIGINT) - pa.v - pb.v + tp AS tn FROM tt, pa, pb)"""


def _ratio(a: str, b: str) -> str:
    return f"CASE WHEN ({b}) <> 0 THEN round(CAST({a} AS DOUBLE) / ({b}), 6) END"


_AB = f"WITH {CUR}, {FIRST}, m AS (SELECT fst.cluster_id AS ca, cur.cluster_id AS cb FROM fst JOIN cur USING (seq_id))"
_CONF = _confusion(_AB)
INDICES = f"""tp, fp, fn, tn, {_ratio("tp", "tp + fp + fn")} AS ji, {_ratio("tp + tn", "tp + fp + fn + tn")} AS ri, {_ratio("tp", "tp + fn")} AS se, {_ratio("tn", "tn + fp")} AS sp,
{_ratio("tp", "tp + fp")} AS ppv, {_ratio("tn", "tn + fn")} AS npv,
{_ratio("(CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn)", "sqrt(CAST(tp + fp AS DOUBLE) * (tn + fn) * (tp + fn) * (tn + fp))")} AS cc"""

def _star(t: str) -> str:
    return f"SELECT s.c AS i, {t}.seq_id AS j FROM {t} JOIN (SELECT cluster_id, min(seq_id) AS c FROM {t} GROUP BY 1) s USING (cluster_id) WHERE s.c <> {t}.seq_id"


def _part(t: str, ids: str, name: str) -> str:
    return f"{name} AS MATERIALIZED (SELECT * FROM {t} WHERE seq_id IN (SELECT seq_id FROM {ids}))"


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["reads_scan"] = f"WITH {R1} SELECT seq_id, id, clone, bases, CAST(length(bases) AS INTEGER) AS len FROM r"
    q["reads_count_bases"] = f"WITH {R1} SELECT count(*) AS n_reads, CAST(sum(length(bases)) AS BIGINT) AS n_bases FROM r"
    q["base_composition"] = f"""WITH {R1}, c AS (SELECT unnest(string_split(bases, '')) AS base FROM r WHERE bases <> ''), z AS (SELECT base, count(*) AS n FROM c GROUP BY base)
SELECT v.base, CAST(v.code AS INTEGER) AS code, coalesce(n, 0) AS n FROM (VALUES ('A', 0), ('C', 1), ('G', 2), ('T', 3)) v(base, code) LEFT JOIN z USING (base)"""
    q["revcomp"] = f"WITH {R1} SELECT seq_id, {RC.format('bases')} AS rc FROM r"
    q["mirror_union"] = f"WITH {R1} SELECT seq_id, id, bases, 0 AS part FROM r UNION ALL SELECT seq_id, id, {RC.format('bases')}, 1 FROM r"
    q["kmer_explode_all"] = f"WITH {ALL}, {_words(8, False, 'w', 'ra')} SELECT seq_id, CAST(pos AS INTEGER) AS pos, word FROM w"
    q["sample_word_numbers"] = f"""WITH {R1}, w AS (SELECT seq_id, k - 1 AS place, substr(bases, k * 8 + 1, 8) AS word FROM (SELECT seq_id, bases, unnest(generate_series(1, length(bases) // 8 - 2)) AS k FROM r))
SELECT seq_id, CAST(place AS INTEGER) AS place, CAST(list_sum(list_transform(generate_series(1, 8), lambda p: (position(substr(word, p, 1) IN 'ACGT') - 1) * CAST(pow(4, 8 - p) AS BIGINT))) AS BIGINT) AS number, word FROM w"""
    q["kmer_frequency_stats"] = f"""WITH {R1}, {_words(16, False, "w")}, n AS (SELECT count(*) AS n FROM w GROUP BY word)
SELECT count(*) AS n_words, round(avg(n), 6) AS mean_block, round(avg(CAST(n AS DOUBLE) * n), 6) AS mean_sq_block, max(n) AS max_block FROM n"""
    q["low_complexity_words"] = """WITH b AS (SELECT DISTINCT seq_id, upper(bases) AS b FROM reads WHERE seq_id IS NOT NULL),
w AS (SELECT seq_id, substr(b, p, 12) AS word FROM (SELECT seq_id, b, unnest(generate_series(1, length(b) - 11)) AS p FROM b))
SELECT seq_id, count(*) AS n_words, count(*) FILTER ((12 - length(replace(replace(word, 'X', ''), 'N', ''))) * 3 < 12) AS n_kept FROM w GROUP BY seq_id"""
    q["strip_non_acgt"] = "SELECT DISTINCT seq_id, regexp_replace(bases, '[^ACGTacgt]', '', 'g') AS bases FROM reads"
    runs = "bases"
    for b in "ACGT":
        runs = f"regexp_replace({runs}, '{b}{{8,}}', '', 'g')"
    q["homopolymer_collapse"] = f"WITH {R1} SELECT seq_id, {runs} AS bases FROM r"
    q["complement_codes"] = "SELECT DISTINCT seq_id, replace(translate(upper(bases), 'ACGTXRYSWKMBDHVN', 'TGCAXXXXXXXXXXXX'), '-', '') AS complement FROM reads"
    q["fasta_records"] = f"WITH {R1} SELECT seq_id, {_RECORD} AS record FROM r"
    q["printed_reads"] = f"WITH {ALL}, {IDS}, {ASKED} SELECT seq_id, {_wrap('bases')} AS forward, {_wrap('rc')} AS backward FROM (SELECT seq_id, bases, {RC.format('bases')} AS rc FROM ra WHERE seq_id IN (SELECT seq_id FROM asked))"
    q["accessions"] = rf"""WITH {R1} SELECT seq_id, coalesce(nullif(regexp_extract(id, 'gb\|([^|\s]+)', 1), ''), nullif(regexp_extract(id, 'gi\|(\d+)', 1), ''), nullif(regexp_extract(id, '^>?\s*([^|\s]+)', 1), '')) AS accession FROM r"""
    q["candidates_kmer"] = f"WITH {_candidates()} SELECT i, j, shared, span FROM cand"
    q["candidates_short_read"] = f"WITH {_candidates(14, 3, 10, 58)} SELECT i, j, shared, span FROM cand"
    q["candidates_symmetric"] = f"WITH {_candidates(symmetric=True)} SELECT i, j, shared, span FROM cand"
    q["sample_hit_pairs"] = f"""WITH {R1}, l AS (SELECT seq_id, bases FROM r WHERE length(bases) >= 100),
own AS MATERIALIZED (SELECT DISTINCT seq_id, strand, substr(b, p, 8) AS word FROM (SELECT seq_id, strand, b, unnest(generate_series(1, length(b) - 7)) AS p FROM (
  SELECT seq_id, 1 AS strand, bases AS b FROM l UNION ALL SELECT seq_id, -1, {RC.format("bases")} FROM l))),
s AS MATERIALIZED (SELECT seq_id, substr(bases, k * 8 + 1, 8) AS word, count(*) AS n FROM (SELECT seq_id, bases, unnest(generate_series(1, length(bases) // 8 - 2)) AS k FROM l) GROUP BY ALL)
SELECT own.seq_id AS i, s.seq_id AS j, CAST(strand AS INTEGER) AS strand, CAST(sum(n) AS BIGINT) AS hits FROM own JOIN s ON own.word = s.word AND own.seq_id < s.seq_id GROUP BY 1, 2, 3 HAVING sum(n) > 4"""
    q["window_hits"] = f"WITH {HITS} SELECT i, j, strand, sample, hits FROM hits"
    q["prefilter_pairs"] = f"""WITH {HITS}, t AS (SELECT h.*, max(sample) OVER (PARTITION BY h.i, h.j) AS top, least(100, length(bi), length(bj)) AS lw, length(bj) AS lj FROM hits h JOIN pr USING (i, j))
SELECT i, j, strand, sample, hits FROM t WHERE top > 1 AND sample > (CASE WHEN lj < 100 THEN 4 - ((116 - lj) // 16) ELSE 4 END) AND hits >= 70 - (100 - lw)"""
    both = _clean("(SELECT seq_id, id, clone, bases FROM reads UNION ALL SELECT seq_id, id, clone, bases FROM reads2)", "r")
    q["d2_whole_candidates"] = f"""WITH {_candidates(reads=both)}, {_words(6, False, "w")}, t AS MATERIALIZED (SELECT seq_id, word, count(*) AS n FROM w GROUP BY ALL), q AS (SELECT seq_id, sum(n * n) AS q FROM t GROUP BY 1),
s AS (SELECT i, j, sum(a.n * b.n) AS c FROM cand JOIN t a ON a.seq_id = i JOIN t b ON b.seq_id = j AND b.word = a.word GROUP BY 1, 2)
SELECT i, j, CAST(a.q + b.q - 2 * coalesce(c, 0) AS BIGINT) AS d2 FROM cand JOIN q a ON a.seq_id = i JOIN q b ON b.seq_id = j LEFT JOIN s USING (i, j)"""
    q["ends_distance"] = f"""WITH {_candidates()},
p AS (SELECT i, j, x.bases AS bi, y.bases AS bj, least(length(x.bases), length(y.bases)) AS n FROM cand JOIN r x ON x.seq_id = i JOIN r y ON y.seq_id = j),
k AS (SELECT i, j, 0 AS side, right(bi, n) AS a, left(bj, n) AS b FROM p UNION ALL SELECT i, j, 1, left(bi, n), right(bj, n) FROM p),
u AS (SELECT i, j, side, substr(a, z, 6) AS w, 1 AS s FROM (SELECT *, unnest(generate_series(1, length(a) - 5)) AS z FROM k)
  UNION ALL SELECT i, j, side, substr(b, z, 6), -1 FROM (SELECT *, unnest(generate_series(1, length(b) - 5)) AS z FROM k)),
d AS (SELECT i, j, side, w, sum(s) AS c FROM u GROUP BY ALL)
SELECT i, j, CAST(min(v) AS BIGINT) AS ends FROM (SELECT i, j, side, sum(c * c) AS v FROM d GROUP BY ALL) GROUP BY 1, 2"""
    q["range_slice_edges"] = f"WITH {EDGES} SELECT i, j, CAST(strand AS INTEGER) AS strand FROM e WHERE i >= 500 AND i < 1000"
    q["step_sample"] = f"WITH {EDGES} SELECT i, j, CAST(strand AS INTEGER) AS strand FROM e WHERE (j - i - 1) % 17 = 0"
    q["edge_dump"] = f"WITH {EDGES} SELECT i, j, CAST(strand AS INTEGER) AS strand FROM e"
    q["clusters_cc"] = _clusters(EDGES, "SELECT i, j FROM e")
    q["clusters_candidates"] = _clusters(_candidates(), "SELECT i, j FROM cand", "r")
    q["cluster_histogram"] = _clusters(_candidates(), "SELECT i, j FROM cand", "r", "SELECT size, count(*) AS n_clusters FROM (SELECT count(*) AS size FROM labelled GROUP BY cluster_id) GROUP BY size")
    q["cluster_mean_sq"] = f"WITH {CUR} SELECT count(*) AS n_clusters_total, CAST(sum(n * n) // count(*) AS BIGINT) AS mean_sq FROM (SELECT count(*) AS n FROM cur GROUP BY cluster_id)"
    line = "array_to_string(list(CAST(seq_id AS VARCHAR) ORDER BY seq_id), ' ')"
    q["cluster_lines"] = f"WITH {CUR} SELECT cluster_id, concat({line}, '.') AS line FROM cur GROUP BY cluster_id"
    q["ext_to_comp"] = f"WITH {CUR} SELECT cluster_id, {line} AS line FROM cur GROUP BY cluster_id"
    link = 'seq_id AS "index", cluster_id AS cluster, coalesce(lead(seq_id) OVER (PARTITION BY cluster_id ORDER BY seq_id), -1) AS link'
    wit = "wit AS (SELECT s, min(w) AS w FROM (SELECT i AS s, j AS w FROM e UNION ALL SELECT j, i FROM e) GROUP BY s)"
    q["ext_table"] = f"WITH {EDGES}, {CUR}, {wit} SELECT {link}, CAST(1 AS INTEGER) AS orient, coalesce(w, -1) AS witness FROM cur LEFT JOIN wit ON s = seq_id"
    q["comp_to_ext"] = f"WITH {CUR} SELECT {link}, CAST(0 AS INTEGER) AS orient, CAST(-1 AS BIGINT) AS witness FROM cur"
    q["header_clusters"] = f"WITH {R1} SELECT min(seq_id) OVER (PARTITION BY split_part(id, '_', 1)) AS cluster_id, seq_id FROM r"
    q["clone_link_clusters"] = f"WITH {ALL} SELECT seq_id, CASE WHEN clone IS NULL THEN seq_id ELSE min(seq_id) OVER (PARTITION BY clone) END AS cluster_id FROM ra"
    q["init_clusters"] = _clusters(f"{EDGES}, {FIRST}, {_part('fst', 'ids', 'fi')}", f"SELECT i, j FROM e UNION ALL {_star('fi')}")
    two = f"{EDGES}, {FIRST}, a AS (SELECT DISTINCT seq_id FROM reads2), b AS (SELECT DISTINCT seq_id FROM reads WHERE seq_id IS NOT NULL), {_part('fst', 'a', 'fa')}, {_part('fst', 'b', 'fb')}"
    across = "SELECT i, j FROM e WHERE i IN (SELECT seq_id FROM a) AND j IN (SELECT seq_id FROM b)"
    q["merge_clusters"] = _clusters(two, f"{across} UNION ALL {_star('fa')} UNION ALL {_star('fb')}")
    q["add_clusters"] = _clusters(two, f"SELECT i, j FROM e WHERE j IN (SELECT seq_id FROM b) UNION ALL {_star('fa')}")
    q["recluster"] = _clusters(f"{EDGES}, {CUR}", "SELECT i, j FROM e JOIN cur x ON x.seq_id = i JOIN cur y ON y.seq_id = j WHERE x.cluster_id = y.cluster_id", "cur")
    q["cluster_only"] = _clusters(f"{EDGES}, {ASKED}", "SELECT i, j FROM e WHERE i IN (SELECT seq_id FROM asked) AND j IN (SELECT seq_id FROM asked)")
    q["cluster_others"] = _clusters(f"{EDGES}, {ASKED}", "SELECT i, j FROM e WHERE i NOT IN (SELECT seq_id FROM asked) AND j NOT IN (SELECT seq_id FROM asked)")
    q["reset_ids"] = _clusters(f"{EDGES}, {CUR}, {ASKED}, ci AS MATERIALIZED (SELECT * FROM cur WHERE seq_id IN (SELECT seq_id FROM ids) AND seq_id NOT IN (SELECT seq_id FROM asked))", f"SELECT i, j FROM e WHERE i IN (SELECT seq_id FROM asked) AND j IN (SELECT seq_id FROM asked) UNION ALL {_star('ci')}")
    sides = "SELECT 2 * i + s AS i, 2 * j + (s + CASE WHEN strand < 0 THEN 1 ELSE 0 END) % 2 AS j FROM e, (VALUES (0), (1)) v(s)"
    q["signed_orientation"] = _clusters(EDGES + ", sided AS (SELECT 2 * seq_id AS seq_id FROM ids)", sides, "sided", "SELECT seq_id // 2 AS seq_id, cluster_id // 2 AS cluster_id, CAST(CASE WHEN cluster_id % 2 = 0 THEN 1 ELSE -1 END AS INTEGER) AS orient FROM labelled")
    q["clusters_by_name"] = f"WITH {ALL}, {CUR} SELECT cluster_id, concat(id, '#', CAST(seq_id AS VARCHAR)) AS id FROM cur JOIN ra USING (seq_id)"
    q["cluster_line_parts"] = f"""WITH {CUR}, n AS (SELECT cluster_id, seq_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY seq_id) - 1) // 50 AS part, (count(*) OVER (PARTITION BY cluster_id) - 1) // 50 AS last FROM cur)
SELECT cluster_id, part, concat(array_to_string(list(CAST(seq_id AS VARCHAR) ORDER BY seq_id), ' '), CASE WHEN part = max(last) THEN '.' ELSE '' END) AS line FROM n GROUP BY cluster_id, part"""
    q["klink_sym"] = f"WITH {EDGES} SELECT seq_id, list(n ORDER BY n) AS neighbours FROM (SELECT i AS seq_id, j AS n FROM e UNION SELECT j, i FROM e UNION SELECT seq_id, seq_id FROM ids) GROUP BY seq_id"
    q["klink_asym"] = f"WITH {EDGES} SELECT seq_id, coalesce(list(DISTINCT j ORDER BY j) FILTER (j IS NOT NULL), []) AS neighbours FROM ids LEFT JOIN e ON i = seq_id GROUP BY seq_id"
    q["witness_reads"] = f"WITH {EDGES}, {wit} SELECT s AS seq_id, w AS witness FROM wit"
    q["p2_found"] = f"WITH {CUR} SELECT * FROM (SELECT cluster_id AS cluster, seq_id, lead(seq_id) OVER (PARTITION BY cluster_id ORDER BY seq_id) AS link FROM cur) WHERE link IS NOT NULL"
    q["pair_confusion"] = f"{_CONF} SELECT tp, fp, fn, tn FROM conf"
    q["pair_indices"] = f"{_CONF} SELECT {INDICES} FROM conf"
    q["missing_as_singletons"] = "WITH RECURSIVE " + _confusion(f"{EDGES},{_components('SELECT i, j FROM e')}, {CUR}, m AS (SELECT coalesce(l.cluster_id, -seq_id - 1) AS ca, coalesce(cur.cluster_id, -seq_id - 1) AS cb FROM labelled l FULL JOIN cur USING (seq_id))") + " SELECT tp, fp, fn, tn FROM conf"
    q["pair_index_table"] = f"""{_CONF}, v AS (SELECT {INDICES} FROM conf),
one AS (SELECT CASE WHEN count(*) > 1 THEN CAST(1.0 AS DOUBLE) END AS f FROM fst), two AS (SELECT CASE WHEN count(*) > 1 THEN CAST(1.0 AS DOUBLE) END AS c FROM cur)
SELECT 'first' AS name, f AS "first", ri AS "current" FROM v, one UNION ALL SELECT 'current', ri, c FROM v, two"""
    q["pair_diff"] = f"WITH {CUR}, {FIRST}, b AS (SELECT cur.seq_id, cur.cluster_id AS ca, fst.cluster_id AS cb FROM cur JOIN fst USING (seq_id)) SELECT x.seq_id AS i, y.seq_id AS j FROM b x JOIN b y ON x.ca = y.ca AND x.cb <> y.cb AND x.seq_id < y.seq_id"
    q["ticked_diff"] = f"WITH {CUR}, {FIRST}, b AS (SELECT cur.seq_id, cur.cluster_id AS ca, fst.cluster_id AS cb, min(cur.seq_id) OVER (PARTITION BY cur.cluster_id) AS m FROM cur JOIN fst USING (seq_id)) SELECT y.seq_id AS i, x.seq_id AS j FROM b x JOIN b y ON y.seq_id = x.m AND y.ca = x.ca WHERE x.cb <> y.cb"
    q["heuristic_quality"] = f"""WITH {_candidates()}, {EDGES}, ee AS (SELECT DISTINCT i, j FROM e WHERE i IN (SELECT seq_id FROM r) AND j IN (SELECT seq_id FROM r)),
n AS (SELECT CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS n FROM r), x AS (SELECT count(*) FILTER (f AND m) AS tp, count(*) FILTER (f AND NOT m) AS fp, count(*) FILTER (NOT f AND m) AS fn
  FROM (SELECT c.i IS NOT NULL AS f, ee.i IS NOT NULL AS m FROM cand c FULL JOIN ee ON c.i = ee.i AND c.j = ee.j)) SELECT tp, fp, fn, n - tp - fp - fn AS tn FROM x, n"""
    q["thin_clusters"] = f"WITH {IDS}, {ASKED}, {CUR} SELECT seq_id, cluster_id FROM cur WHERE seq_id NOT IN (SELECT seq_id FROM asked)"
    q["cluster_members"] = f"WITH {CUR} SELECT cluster_id, list(seq_id ORDER BY seq_id) AS members FROM cur GROUP BY cluster_id"
    q["big_clusters"] = q["cluster_members"] + " HAVING count(*) > 20"
    q["subset_reads"] = f"WITH {R1}, {IDS}, {ASKED} SELECT seq_id, id, clone, bases, CAST(length(bases) AS INTEGER) AS len FROM r WHERE seq_id IN (SELECT seq_id FROM asked)"
    q["split_inc_exc"] = f"WITH {R1}, {IDS}, {ASKED} SELECT seq_id, seq_id IN (SELECT seq_id FROM asked) AS included FROM r"
    q["limit_reads"] = q["reads_scan"] + " WHERE seq_id < 300"
    q["range_reads"] = q["reads_scan"] + " WHERE seq_id BETWEEN 100 AND 499"
    q["until_total"] = f"WITH {R1}, s AS (SELECT seq_id, CAST(length(bases) AS INTEGER) AS len, coalesce(sum(length(bases)) OVER (ORDER BY seq_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM r) SELECT seq_id, len FROM s WHERE b < 100000"
    buckets = f"WITH {CUR}, big AS (SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) - 1 AS k FROM cur GROUP BY cluster_id HAVING count(*) >= 5)"
    q["produce_files"] = f"{buckets} SELECT seq_id, coalesce(k, -1) AS bucket, CASE WHEN k IS NULL THEN 'S0.fasta' ELSE concat('C', lpad(CAST(k AS VARCHAR), 6, '0'), '.fasta') END AS file FROM cur LEFT JOIN big USING (cluster_id)"
    q["split_files"] = f"{buckets} SELECT k AS file, seq_id FROM cur JOIN big USING (cluster_id)"
    return q
