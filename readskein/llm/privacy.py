"""Personal information in free text: a skip-chain conditional random field over candidates.

Every candidate of a document (see ``persons``) is a variable whose values are its possible kinds and none. Weights
of observed features (form, neighbouring words, shape) give its own potentials; neighbouring candidates share chain
potentials, and distant ones that are the same token or that belong together (a name and an address made of it) share
skip potentials. Loopy belief propagation, on all documents of a batch at once, gives each variable its marginal. The
weights are learnt by pseudo-likelihood from texts that are made up here.
"""

from __future__ import annotations

import random
import re
from bisect import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .persons import GIVEN, KINDS, candidates

#: Which kinds each form may be.
ALLOWED = {"email": (1,), "number": (2, 3), "code": (3,), "address": (4,), "word": (5,)}
#: Edges: words of one run, neighbours in the text, equal tokens, a name and an address made of it.
RUN, NEXT, SAME, MADE = range(4)
#: Messages are passed until none changes by more than this; where they don't settle, they are damped after so many rounds
#: and stopped after ten times as many.
SETTLED, ROUNDS = 1e-3, 50
NEAR = 60
#: Letters of a name that an address is looked up by; longer names go by their first ones.
LONGEST = 24

_WORDS = re.compile(r"\\?[^\W\d_]+|\d+|[^\w\s]")
_DIGITS = re.compile(r"\d+")


def features(text: str, found: list[tuple[int, int, str, str, int]]) -> list[list[str]]:
    """Names of the features of each candidate."""
    out = []
    runs: dict[int, list[int]] = {}
    for i, c in enumerate(found):
        if c[4] >= 0:
            runs.setdefault(c[4], []).append(i)
    about = {}
    for part, own in runs.items():
        keys = [found[j][3] for j in own]
        given = [k in GIVEN or k.split("-")[0] in GIVEN for k in keys]
        start = found[own[0]][0]
        about[part] = own, given, any(given), "," in text[start : found[own[-1]][1]], text[max(0, start - 30) : start].isupper()
    for i, (a, b, form, key, part) in enumerate(found):
        before = _WORDS.findall(text[max(0, a - 70) : a].lower())[-7:]
        after = _WORDS.findall(text[b : b + 30].lower())[:3]
        f = [f"{form}", f"{form} <{before[-1] if before else ''}", f"{form} >{after[0] if after else ''}"]
        if len(before) > 1:
            f.append(f"{form} <<{before[-2]} {before[-1]}")
        if form == "word":
            own, given, some, comma, loud = about[part]
            at, n = bisect(own, i) - 1, len(own)
            f += [f"given {given[at]}", f"is {key}", f"place {min(at, 3)} of {min(n, 4)}", f"last {at == n - 1} given before {at > 0 and given[at - 1]}"]
            f.append(f"given after {at + 1 < n and given[at + 1]} comma {comma}")
            caps = text[a:b].isupper()
            f.append(f"caps {caps} first given {given[0]}")
            f.append(f"caps {caps} of {min(n, 4)} given {some} before {loud}")
            if at + 1 < n:
                gap = text[b : found[own[at + 1]][0]]
                f.append(f"line after {chr(10) in gap} comma {',' in gap}")
            if at:
                gap = text[found[own[at - 1]][1] : a]
                f.append(f"line before {chr(10) in gap} comma {',' in gap} given {given[at - 1]}")
            f += [f"in {w}" for w in before if w in _PLACES]
            f.append(f"initial {bool(before[-2:]) and len(before) > 1 and before[-1] in '.~' and any(len(w) == 1 and w.isalpha() for w in before[-3:])}")
        else:
            f += [f"{form} ~{w}" for w in before if w[-1].isalpha()]
            if form in ("number", "code"):
                s = text[a:b]
                f += [f"{form} shape {_shape(s)}", f"{form} starts {s[0] if not s[0].isdigit() else s[:2] if s[:2] == '00' else '9'}", f"{form} digits {sum(map(str.isdigit, s))}"]
            elif form == "email":
                f += [f"sign {'@' in text[a:b]}", f"dots {min(3, key.count('.') + key.count('dot'))}", f"short {b - a < 9}"]
            elif form == "address":
                f.append(f"street {key.rsplit(None, 1)[-1].strip('.') if key[0].isdigit() else key.split()[0].split('~')[0][-6:]}")
        out.append(f)
    return out


_PLACES = {"\\bibitem", "bibitem", "\\author", "author", "\\title", "proc", "ann", "acta", "journal", "\\cite"}


def _shape(s: str) -> str:
    return re.sub(r"\\[, ]|[~\s]+", " ", _DIGITS.sub(lambda m: str(len(m.group())), s))


def edges(found: list[tuple[int, int, str, str, int]]) -> list[tuple[int, int, int]]:
    """(earlier, later, type) between the candidates of a document. Equal tokens are linked in a chain, and a name with
    such an address among the nearest ones, so the number of edges grows as the number of candidates."""
    out: list[tuple[int, int, int]] = []
    last: dict[tuple[str, str], int] = {}
    parts: dict[str, list[int]] = {}  # addresses by what stands in their local part, in order
    for i, c in enumerate(found):
        if c[2] == "email":
            local_part = re.split(r"@|\W+at\W+", c[3])[0]
            for x in {local_part[a:b] for a in range(len(local_part)) for b in range(a + 4, min(len(local_part), a + LONGEST) + 1)}:
                parts.setdefault(x, []).append(i)
    for i, c in enumerate(found):
        if i and c[0] - found[i - 1][1] <= NEAR:
            out.append((i - 1, i, RUN if c[4] >= 0 and c[4] == found[i - 1][4] else NEXT))
        at = last.get((c[2], c[3]))
        if at is not None and at != i - 1:
            out.append((at, i, SAME))
        last[c[2], c[3]] = i
        if parts and c[2] == "word" and len(c[3]) > 3:
            mails = parts.get(c[3].split("-")[0][:LONGEST], ())
            m = bisect(mails, i)
            near = sorted(mails[max(0, m - 2) : m + 2], key=lambda x: abs(x - i))[:2]
            out += [(min(i, x), max(i, x), MADE) for x in near]
    return out


class Field:
    """Weights, and inference with them."""

    def __init__(self, names: dict[str, int], own: np.ndarray, pairs: np.ndarray):
        self.names, self.own, self.pairs = names, own, pairs

    def marginals(self, found: list[list], feats: list[list[list[str]]]) -> np.ndarray:
        """Marginals of all candidates of the documents, in order."""
        rows, mask, links = encode(self.names, found, feats)
        return propagate(local(self.own, rows, mask), links, self.pairs)


def encode(names: dict[str, int], found: list[list], feats: list[list[list[str]]]):
    """(flat feature numbers and their rows, allowed kinds, edges) of the documents' candidates."""
    flat, row, mask, links = [], [], [], []
    n = 0
    get = names.get
    for cands, fs in zip(found, feats, strict=True):
        for i, (c, f) in enumerate(zip(cands, fs, strict=True)):
            for x in f:
                k = get(x)
                if k is not None:
                    flat.append(k)
                    row.append(n + i)
            mask.append(_MASK[c[2]])
        links += [(n + a, n + b, t) for a, b, t in edges(cands)]
        n += len(cands)
    return (np.array(flat, np.int64), np.array(row, np.int64)), np.array(mask, np.float64).reshape(n, len(KINDS)), np.array(links, np.int64).reshape(-1, 3)


_MASK = {f: [0.0 if k == 0 or k in ks else -1e9 for k in range(len(KINDS))] for f, ks in ALLOWED.items()}


def local(own: np.ndarray, rows, mask: np.ndarray) -> np.ndarray:
    out = mask.copy()
    flat, row = rows
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(row, own[flat, k], minlength=len(out))
    return out


def propagate(potential: np.ndarray, links: np.ndarray, pairs: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Loopy belief propagation (sum-product, in logarithms) on a graph of all documents at once, until messages settle;
    those that have are not computed again unless what they depend on changes. On a tree the result is exact."""
    n, kinds = potential.shape
    if not n:
        return potential
    a, b, t = links.T if len(links) else np.zeros((3, 0), np.int64)
    source, target = np.concatenate([a, b]), np.concatenate([b, a])
    tables = np.exp(np.concatenate([pairs[t], pairs[t].transpose(0, 2, 1)])) if len(a) else np.zeros((0, kinds, kinds))
    back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
    message = np.zeros((len(source), kinds))
    belief = potential.copy()
    active = np.arange(len(source))
    for r in range(10 * rounds):
        if not len(active):
            break
        sent = belief[source[active]] - message[back[active]]
        sent -= sent.max(1, keepdims=True)
        new = np.log(np.einsum("ek,ekl->el", np.exp(sent), tables[active]) + 1e-300)
        new -= new.max(1, keepdims=True)
        if r >= rounds:
            new = (new + message[active]) / 2
        change = new - message[active]
        message[active] = new
        for k in range(kinds):
            belief[:, k] += np.bincount(target[active], change[:, k], minlength=n)
        moved = np.zeros(n, bool)
        moved[target[active[np.abs(change).max(1) > SETTLED]]] = True
        active = np.flatnonzero(moved[source])
    belief -= belief.max(1, keepdims=True)
    e = np.exp(belief)
    return e / e.sum(1, keepdims=True)


def train(documents: int = 2500, seed: int = 7, steps: int = 120) -> Field:
    """Weights learnt by pseudo-likelihood from ``documents`` made-up texts (a bound on the sample)."""
    from .samples import sample

    found, feats, gold = [], [], []
    draw = random.Random(seed)
    for _ in range(documents):
        text, spans = sample(draw)
        cands = candidates(text)
        found.append(cands)
        feats.append(features(text, cands))
        for a, b, form, _, _ in cands:
            if form == "word":
                gold.append(5 if any(k == "name" and x <= a and b <= y for x, y, k in spans) else 0)
            else:
                kind = next((KINDS.index(k) for x, y, k in spans if x == a and y == b), 0)
                gold.append(kind if kind in ALLOWED[form] else 0)
    counts: dict[str, int] = {}
    for fs in feats:
        for f in fs:
            for x in f:
                counts[x] = counts.get(x, 0) + 1
    names = {x: i for i, x in enumerate(sorted(x for x, c in counts.items() if c > 2))}
    rows, mask, links = encode(names, found, feats)
    y, kinds = np.array(gold), len(KINDS)
    n = len(y)
    one = np.eye(kinds)[y]
    own, pairs = np.zeros((len(names), kinds)), np.zeros((4, kinds, kinds))
    moment = [np.full_like(own, 1e-8), np.full_like(pairs, 1e-8)]
    a, b, t = links.T
    flat, row = rows
    for _ in range(steps):
        logit = local(own, rows, mask)
        np.add.at(logit, a, pairs[t, :, y[b]])
        np.add.at(logit, b, pairs[t, y[a], :])
        logit -= logit.max(1, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(1, keepdims=True)
        off = (one - p) / n * 1000
        g_own = np.stack([np.bincount(flat, off[row, k], minlength=len(names)) for k in range(kinds)], 1) - 0.02 * own
        g_pairs = np.zeros_like(pairs)
        np.add.at(g_pairs, (t, slice(None), y[b]), off[a])
        np.add.at(g_pairs, (t, y[a]), off[b])
        g_pairs -= 0.02 * pairs
        for w, g, m in ((own, g_own, moment[0]), (pairs, g_pairs, moment[1])):
            m += g * g
            w += 0.4 * g / np.sqrt(m)
    return Field(names, own, pairs)


def spans(text: str, found: list, kinds: np.ndarray) -> list[tuple[int, int, str]]:
    """(start, end, kind) from the candidates' kinds. Words of a run that are names and stand together are one name if
    they are two or more; a comma between two single ones joins a family and a given name, any other divides names."""
    out = [(c[0], c[1], KINDS[k]) for c, k in zip(found, kinds, strict=True) if k and c[2] != "word"]
    runs: dict[int, list[tuple[int, int]]] = {}
    for i, (c, k) in enumerate(zip(found, kinds, strict=True)):
        if c[2] == "word" and k:
            runs.setdefault(c[4], []).append((i, c[0]))
    for own in runs.values():
        pieces: list[list[int]] = []
        joined: list[str] = []
        for i, _ in own:
            if pieces and pieces[-1][-1] == i - 1:
                gap = text[found[i - 1][1] : found[i][0]]
                if "," not in gap:
                    pieces[-1].append(i)
                    continue
                joined.append("comma")
            else:
                joined.append("apart")
            pieces.append([i])
        j = 0
        while j < len(pieces):
            first, last = pieces[j][0], pieces[j][-1]
            if len(pieces[j]) == 1:
                if j + 1 < len(pieces) and joined[j + 1] == "comma" and len(pieces[j + 1]) == 1:
                    last = pieces[j + 1][0]
                    j += 1
                else:
                    j += 1
                    continue
                tail = re.match(r"[ ~][A-Z]\.(?![\w.])", text[found[last][1] : found[last][1] + 4])
                end = found[last][1] + (tail.end() if tail else 0)
            else:
                end = found[last][1]
            out.append((found[first][0], end, "name"))
            j += 1
    return sorted(out)


def _scan(field: Field, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    found = [candidates(t) if t else [] for t in texts]
    feats = [features(t, c) if c else [] for t, c in zip(texts, found, strict=True)]
    best = field.marginals(found, feats)
    best = best.argmax(1) if len(best) else np.zeros(0, np.int64)
    out, n = [], 0
    for t, c in zip(texts, found, strict=True):
        out.append(spans(t, c, best[n : n + len(c)]) if c else [])
        n += len(c)
    return out


_FIELD: list[Field] = []


def trained() -> Field:
    if not _FIELD:
        _FIELD.append(train())
    return _FIELD[0]


def _batches(texts: list, most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    at, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held > most:
            yield at, i + 1
            at, held = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def personal_items(documents: DataFrame, id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, kind, value, start, end) of every personal item; value is text[start:end), counted in characters.

    Null and empty texts have none; rows with null id are kept with it; texts are read whole, and repeated rows give
    repeated results.
    """
    weights = documents.sparkSession.sparkContext.broadcast(field or trained())  # its size depends on the training sample only

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for a, b in _batches(texts):
                rows = [(a + i, k, texts[a + i][x:y], x, y) for i, s in enumerate(_scan(weights.value, texts[a:b])) for x, y, k in s]
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32())], ["id", "kind", "value", "start", "end"])

    df = documents.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return df.mapInArrow(scan, "id bigint, kind string, value string, start int, end int").withColumnRenamed("id", id)


def redacted(documents: DataFrame, id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """(doc_id, text, items): each document's text with every personal item replaced by [EMAIL], [PHONE], [ID_NUMBER],
    [ADDRESS] or [NAME], and the number of replacements. Null texts stay null with 0 items."""
    weights = documents.sparkSession.sparkContext.broadcast(field or trained())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            out, n = [], []
            for a, b in _batches(texts):
                for t, s in zip(texts[a:b], _scan(weights.value, texts[a:b]), strict=True):
                    n.append(len(s))
                    for x, y, k in reversed(s):
                        t = f"{t[:x]}[{k.upper()}]{t[y:]}"
                    out.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int32())], ["id", "text", "items"])

    df = documents.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    return df.mapInArrow(scan, "id bigint, text string, items int").withColumnRenamed("id", id)
