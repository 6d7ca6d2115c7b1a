import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from readskein.llm import leakage as L
from readskein.llm import mixing as X
from readskein.llm import privacy as V
from readskein.llm.persons import candidates
from readskein.llm.samples import sample
from readskein.llm.tex import words


def test_words_of_tex():
    t = r"""\newcommand{\hv}{deep vacancy\xspace}\def\q{the  \hv{} near}
% a com-
%% ment\cite{x}, and \textbf{the} {\em old} word~\cite[p. 3]{a,b} pr\'e{}cis S{\o}ren vor\-vorex see \ref{eq:1} \q end \hv{}s"""
    got = words(t)
    text = " ".join(got)
    assert "a comment and the old word precis soren vorvorex see the deep vacancy near end deep vacancys" in text
    assert words(None) == [] and words("") == [] and words("%%% \\ { }") == []
    assert words("one-\r\ntwo three-\r\n% four") == ["onetwo", "threefour"]
    assert words("\\newcommand{\\a}{unclosed words") != [] and words("\\cite{never closed") != []
    assert words("a\\\\[2pt] b\\footnotemark[3] c-%\nd e\\-\nf \\begin{tabular}{ll} g") == ["a", "b", "cd", "ef", "g"]
    assert words("Ünder_score ÉT") == ["under", "score", "et"]


def test_abbreviations_within_abbreviations():
    names = ["a" * (k + 1) for k in range(40)]
    chain = "".join(f"\\def\\{a}{{{a}x \\{b}}}" for a, b in zip(names, names[1:])) + f"\\def\\{names[-1]}{{deep}}"
    for start in (0, 30, 36):
        got = words(f"{chain} begin \\{names[start]} end")
        assert got[got.index("begin") :] == ["begin", *(a + "x" for a in names[start:-1]), "deep", "end"]
    assert words(r"\def\p{one \p two} start \p end")[-4:] == ["start", "one", "two", "end"]
    long = words(r"\def\w{a \v}\def\v{b \u}\def\u{c} go \w" + " z" * 2_100_000)
    assert long[-2_100_004:-2_099_999] == ["go", "a", "b", "c", "z"]


def plan(docs, items, size):
    at = {}
    for i, t in items:
        w = words(t)
        for p in range(len(w) - size + 1):
            at.setdefault(tuple(w[p : p + size]), set()).add(i)
    return {(d, i) for d, t in docs for p in range(len(words(t)) - size + 1) for i in at.get(tuple(words(t)[p : p + size]), ())}


def collection(r):
    vocabulary = [f"w{i}x" for i in range(60)]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(8, 40)))) for i in range(25)]
    docs = []
    for d in range(80):
        t = [r.choice([*vocabulary, "other", "more"]) for _ in range(r.randrange(0, 120))]
        if r.random() < 0.6:
            own = r.choice(items)[1].split()
            a = r.randrange(max(1, len(own) - 12))
            at = r.randrange(len(t) + 1)
            t[at:at] = own[a : a + r.randrange(6, 30)]
        docs.append((d, " ".join(t)))
    return items, docs


def test_leaks_match_brute_force(spark, monkeypatch):
    items, docs = collection(random.Random(2))
    docs += [(100, None), (101, ""), (None, items[3][1]), docs[0], (102, items[0][1].upper().replace(" ", ",\n% "))]
    items += [(50, None), (51, ""), (52, "too short")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("item_id", F.lit(7)).withColumn("item", F.lit(8))
    i = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    want = plan([x for x in docs if x[0] is not None], items, 12)
    got = [tuple(x) for x in L.leaked_items(d, i).select("doc_id", "item_id").collect()]
    assert set(got) == want and len(got) == len(want) and (102, 0) in want or len(words(items[0][1])) < 12
    monkeypatch.setattr(L, "BLOCK_CHARS", 1000)  # several blocks of items
    assert {(x.doc_id, x.item_id) for x in L.leaked_items(d, i).collect()} == want
    assert L.leaked_items(d, i.limit(0)).collect() == [] and L.leaked_items(d.limit(0), i).collect() == []


def edits(a, b):
    row = list(range(len(b) + 1))
    for x, c in enumerate(a):
        new = [x + 1]
        for y, e in enumerate(b):
            new.append(min(row[y + 1] + 1, new[y] + 1, row[y] + (c != e)))
        row = new
    return min(row)


def test_edit_distance_and_recall_with_edits():
    r = random.Random(3)
    a = np.array([[r.randrange(4) for _ in range(9)] for _ in range(60)])
    b = np.array([[r.randrange(4) for _ in range(9)] for _ in range(60)])
    assert L.edit_distance(a, b).tolist() == [edits(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    names = [f"v{i}" for i in range(400)]
    items = [(i, " ".join(r.choice(names) for _ in range(12))) for i in range(150)]
    index = L.ItemIndex(items, 12, 1, 0.95)
    found = 0
    for i, t in items:
        w = t.split()
        p = r.randrange(12)
        w = r.choice((w[:p] + ["strange"] + w[p + 1 :], w[:p] + w[p + 1 :], w[:p] + ["strange"] + w[p:]))
        w = ["before"] * r.randrange(3) + w + ["after"] * r.randrange(3)
        s = np.array([index.vocabulary.get(x, 0) for x in w] + [0])
        found += (i in index.match(s, np.zeros(len(s), np.int64))[:, 1].tolist())
    assert found >= 0.9 * len(items)
    assert L.repetitions(12, 0, 0.99) == 1 and L.repetitions(12, 2, 0.99) > L.repetitions(12, 1, 0.99)


@pytest.mark.parametrize("n", [1, 2])
def test_edited_passages_in_documents_are_found(spark, n):
    r = random.Random(10 + n)
    names = [f"v{i}" for i in range(300)]
    items = [(i, " ".join(r.choice(names) for _ in range(r.randrange(14, 30)))) for i in range(40)]
    docs, planted = [], set()
    for d in range(240):
        i, t = r.choice(items)
        w = t.split()
        at = r.randrange(len(w) - 11)
        w = w[at : at + 12]
        for _ in range(n):
            p = r.randrange(1, len(w) - 1)
            w = r.choice((w[:p] + ["strange"] + w[p + 1 :], w[:p] + w[p + 1 :], w[:p] + [r.choice(names)] + w[p:]))
        around = lambda: [r.choice([*names, "other"]) for _ in range(r.randrange(0, 60))]
        docs.append((d, " ".join(around() + w + around())))
        planted.add((d, i))
    got = {(x.doc_id, x.item_id): x.edits for x in L.leaked_items(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), edits=n).collect()}
    assert len(planted & got.keys()) >= 0.9 * len(planted)
    for (d, i), e in got.items():  # every result is one
        a, b = docs[d][1].split(), items[i][1].split()
        windows = (edits(b[p : p + 12], a[q : q + 12 + n]) for p in range(len(b) - 11) for q in range(len(a) - 11 + n))
        assert e <= n and any(x <= e for x in windows)


@pytest.mark.parametrize("mean,cap", [(0.3, 1), (0.99, 1), (1.7, 2), (3.9, 4), (2.0, 50), (640.0, 1000), (740.0, 1000), (900.0, 1000), (999.5, 1000), (740.0, 2000), (1500.0, 2000), (3e6, 4_000_000)])
def test_rates_are_inverted(mean, cap):
    first, below = X.capped_counts(mean, cap)
    assert abs(first + sum(1 - c for c in below) - mean) < 1e-6 * mean and first + len(below) <= cap
    assert len(below) < 40 * cap**0.5 + 100 and all(x <= y for x, y in zip(below, below[1:]))


def test_rates_at_the_ends():
    assert X.capped_counts(4, 4) == (4, []) and X.capped_counts(9, 4) == (4, [])
    assert X.capped_counts(0, 3) == (0, [1.0]) and X.capped_counts(2, 0) == (0, [1.0])


def test_shares_are_those_of_the_documents_drawn(spark, monkeypatch):
    import public_tokenizers as P

    r = random.Random(2)
    docs = [(i, "some words " * r.randrange(1, 9), f"s{i % 7}") for i in range(400)] + [(1000, None, "s1"), (1001, "", "s2")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    t = spark.createDataFrame([(f"s{i}", 1.0 + i, 900 if i == 3 else 2) for i in range(7)], "source string, weight double, max_repeat int")
    shares = {}
    for most in (1000, 2):  # a plan that is broadcast and one that is not
        monkeypatch.setattr(X, "MOST_TARGETS", most)
        m = X.Mixture(d, t)
        drawn = X.token_counts(m.documents_mixed().withColumnRenamed("copy", "nth"), "doc_id", "text", X.vocabulary_path(), P.PATTERN, "source", "nth")
        want = {x.source: (x.n, x.docs, x.copies) for x in drawn.groupBy("source").agg(F.sum("n_tokens").alias("n"), F.countDistinct("doc_id").alias("docs"), F.count("*").alias("copies")).collect()}
        got = {x.source: x for x in m.shares().collect()}
        assert {s: (x.tokens_used, x.docs_used, x.copies) for s, x in got.items()} == want
        assert abs(sum(x.actual_share for x in got.values()) - 1) < 1e-9
        shares[most] = want
    assert shares[1000] == shares[2]


def test_mixture_reaches_its_shares(spark):
    r = random.Random(1)
    docs = [(i, "word " * r.randrange(5, 60), "Big Source") for i in range(3000)] + [(3000 + i, "word " * r.randrange(5, 60), " small-source") for i in range(400)]
    docs += [(9000, None, "big_source"), (9001, "", "big_source"), (9002, "lost words", None), (9003, "x y", "nowhere"), (None, "no id here", "big_source")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, source string").withColumns({"copy": F.lit(9), "below": F.lit(1), "place": F.lit(2), "weight": F.lit(3)})
    t = spark.createDataFrame([("big_source", 0.6, 1), ("Small_Source", 0.3, 3), ("absent", 0.1, 2), ("off", 0.0, 2), (None, 0.5, 1)], "source string, weight double, max_repeat int")
    m = X.Mixture(d, t)
    s = {x.source: x for x in m.shares().collect()}
    assert set(s) == {"big_source", "small_source", "absent"} and s["absent"].tokens_used == 0
    assert abs(s["big_source"].actual_share - 2 / 3) < 0.03 and abs(s["small_source"].actual_share - 1 / 3) < 0.03
    mixed = m.documents_mixed()
    rows = mixed.collect()
    times = {}
    for x in rows:
        times[x.doc_id] = times.get(x.doc_id, 0) + 1
    assert all(n <= (3 if i is not None and 3000 <= i < 9000 else 1) for i, n in times.items())
    assert all(times[3000 + i] == 3 for i in range(400))  # the scarcest source is used up
    assert not {9000, 9001, 9002, 9003} & times.keys() and mixed.columns.count("copy") == 1
    assert len(rows) == sum(x.copies for x in s.values())
    assert sorted(tuple(x) for x in rows) == sorted(tuple(x) for x in X.Mixture(d.repartition(3), t).documents_mixed().collect())
    fewer = {x.source: x for x in X.Mixture(d, t, total=10_000).shares().collect()}
    assert abs(sum(x.tokens_used for x in fewer.values()) - 10_000) < 1500
    assert all(x.tokens_used == 0 for x in X.Mixture(d.limit(0), t).shares().collect()) and X.Mixture(d, t.limit(0)).documents_mixed().collect() == []


def test_tokens_are_those_of_the_vocabulary(spark):
    import public_tokenizers as P

    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "<|endoftext|>")], "id bigint, text string")
    n = {x.id: x.n_tokens for x in X.token_counts(df, "id", "text", X.vocabulary_path(), P.PATTERN).collect()}
    assert n[1] == 2 and n[2] == n[3] == 0 and n[4] > 1


TEXT = r"""\author{J\"urgen Larmann\thanks{Email: j.larmann@phys.uni.example} \and Voss, Clara}
% proofs to Olga M.~Petrov-Hale; olga-p [at] cs [dot] lab [dot] test
The car of ZOE HARTE stood at 17B Elm Street, 10117 Berlin, telephone +49~(0)30~12345-678.
Access was given to Samuel Okoye (SSN: 945 19 6809). Supported by Grant No. 8518-83-9197 (ISSN 5056-2875).
The Harte Collaboration proved the Larmann inequality; see the Hugo array, J.~Voss, Ann. Petrov Stud. 34 (1999) 34--56.
"""


def test_items_in_a_text(spark):
    want = {
        ("name", r'J\"urgen Larmann'), ("email", "j.larmann@phys.uni.example"), ("name", "Voss, Clara"), ("name", "Olga M.~Petrov-Hale"), ("email", "olga-p [at] cs [dot] lab [dot] test"),
        ("name", "ZOE HARTE"), ("address", "17B Elm Street"), ("phone", "+49~(0)30~12345-678"), ("name", "Samuel Okoye"), ("id_number", "945 19 6809"),
    }
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, ""), (None, "Nothing."), (1, TEXT)], "doc_id bigint, text string").withColumns({"id": F.lit(5), "kind": F.lit("x"), "start": F.lit(1)})
    rows = V.personal_items(df).collect()
    assert {(x.kind, x.value) for x in rows} == want and len(rows) == 2 * len(want)
    assert all(TEXT[x.start : x.end] == x.value for x in rows)
    red = {x.doc_id: x for x in V.redacted(df).collect()}
    assert red[2].text is None and red[3].text == "" and red[1].items == len(want) and red[None].items == 0
    assert "stood at [ADDRESS], 10117 Berlin, telephone [PHONE]." in red[1].text and "Grant No. 8518-83-9197" in red[1].text
    assert V.personal_items(df.limit(0)).collect() == []


def test_held_out_accuracy():
    draw = random.Random(4321)
    texts = [sample(draw) for _ in range(250)]
    right = found = known = 0
    for (_, gold), got in zip(texts, V._scan(V.trained(), [t for t, _ in texts]), strict=True):
        right += len(set(gold) & set(got))
        found += len(set(got))
        known += len(set(gold))
    assert right / found > 0.98 and right / known > 0.97


def test_propagation_is_exact_on_a_tree():
    r = np.random.default_rng(1)
    p, pairs = r.normal(size=(4, 3)), r.normal(size=(2, 3, 3))
    links = np.array([[0, 1, 0], [1, 2, 1], [1, 3, 0]])
    total = np.zeros((4, 3))
    for y in np.ndindex(3, 3, 3, 3):
        w = np.exp(sum(p[i, y[i]] for i in range(4)) + sum(pairs[t, y[a], y[b]] for a, b, t in links))
        for i in range(4):
            total[i, y[i]] += w
    assert np.allclose(V.propagate(p, links, pairs, 10), total / total.sum(1, keepdims=True))
    assert V.propagate(np.zeros((0, 6)), np.zeros((0, 3), np.int64), np.zeros((4, 6, 6))).shape == (0, 6)


@pytest.mark.parametrize("text", ["JOHN SMITH AND MARY JONES " * 20_000, "a@b.example, " * 20_000, "555-0167 " * 20_000, "x" * 500_000, "\\'" * 100_000, "Anna " * 50_000])
def test_very_long_texts(text):
    found = candidates(text)
    V._scan(V.trained(), [text])
    assert len(found) <= len(text)
    assert words(text) is not None


#: Frames, names and numbers that no training line has, written for this test; {} stands for an item.
UNSEEN = [
    ("The committee chaired by {} met in June.", "name", "Škarda Šimková"), ("Our host was {}; the talk lasted an hour.", "name", "Łukasz Żeromski"), ("Photographs: {} (private collection).", "name", "Ivan Čapek"),
    ("A letter from {} arrived later.", "name", "Ludwig van Beethoven"), ("{} painted the original.", "name", "Vincent van der Berg"), ("Contact {} for access.", "name", "Mario Rossi"), ("Dear {}, the proofs are ready.", "name", "Hanna Lindqvist"),
    ("The speaker, {}, was late.", "name", "Peter Okafor"), ("Translated by {} in spring.", "name", "Maria Papadopoulou"), ("Editors: {} and others.", "name", "Thomas Brennan"), ("It was {} who first saw this.", "name", "Elena Dragomirova"),
    ("Mail the form to {} today.", "email", "office.desk@archive.example"), ("({})", "email", "k_lund@uni.test"), ("Reach us: {}!", "email", "team-7 [at] lab [dot] example"), ("Ring the desk, {}, after noon.", "phone", "+44 20 7946 0958"),
    ("The hotline is {}.", "phone", "(555) 201-3344"), ("Her passport number {} had expired.", "id_number", "K8812345"), ("His SSN is {} on file.", "id_number", "219-09-9999"), ("The shop at {} closed.", "address", "221 Harbour Street"), ("They moved to {} last May.", "address", "14 Rosewood Lane"),
    ("The Fourier Transform and the Navier Stokes Equations are used.", None, None), ("Data from the Sloan Digital Survey and the Hubble Archive.", None, None), ("See Table 4 on pages 1203-1219 of volume 88.", None, None), ("Der Mittelwert von Messung und Modell bleibt gleich.", None, None),
    ("The Boltzmann Constant was held fixed in Section Two.", None, None), ("New York and Buenos Aires hosted it.", None, None), ("Grant no. 55-812-9034 paid for this.", None, None), ("La Universidad de Granada y el Banco de Datos.", None, None),
]


def unseen_figures():
    """(right, found, known) over the texts above."""
    texts = [frame.format(value) if kind else frame for frame, kind, value in UNSEEN]
    want = [{(kind, value)} if kind else set() for _, kind, value in UNSEEN]
    got = [{(k, t[a:b]) for a, b, k in s} for t, s in zip(texts, V._scan(V.trained(), texts), strict=True)]
    return sum(len(w & g) for w, g in zip(want, got, strict=True)), sum(map(len, got)), sum(map(len, want)), [(w, g) for w, g in zip(want, got, strict=True) if w != g]


def test_texts_unlike_the_training_lines():
    right, found, known, _ = unseen_figures()
    assert right / found >= 0.75 and right / known >= 0.75


def test_names_with_any_capitals_and_particles_are_candidates():
    for name in ("Škarda Šimková", "Łukasz Żeromski", "Ivan Čapek", "Ludwig van Beethoven", "Vincent van der Berg", "Ζωή Παππά", "Иван Петров", r"\v{S}imon \v{C}apek", r"{\L}ukasz Nowak"):
        found = candidates(f"we met {name} there")
        assert [c[2] for c in found] == ["word", "word"] and (found[0][0], found[-1][1]) == (7, 7 + len(name)), name
    assert not candidates("we saw von der Leyen there")


def test_long_chains_and_many_addresses_agree():
    # the first mention is clear, and equal tokens in a chain of any length take it on
    pairs = np.zeros((4, 6, 6))
    pairs[V.SAME, 5, 5] = pairs[V.SAME, 0, 0] = 6.0
    potential = np.zeros((60, 6))
    potential[:, 1:5] = -1e9
    potential[0, 5] = 8.0
    p = V.propagate(potential, np.array([[i, i + 1, V.SAME] for i in range(59)]), pairs)
    assert (p[:, 5] > 0.5).all()
    mails = " ".join(f"user{k:02d}.x@uni.example" for k in range(30))
    text = "Anna Marlowe and Ben Carver wrote. " + mails + " marlowe@uni.example carver@uni.example"
    found = candidates(text)
    made = [(found[a][3], found[b][3]) for a, b, t in V.edges(found) if t == V.MADE]
    assert ("marlowe", "marlowe@uni.example") in made and ("carver", "carver@uni.example") in made
    long = "a" * 300 + "@uni.example"
    assert [c[:3] for c in candidates(f"write to {long}")] == [(9, 9 + len(long), "email")]
