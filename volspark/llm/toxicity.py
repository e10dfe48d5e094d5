"""Toxicity: a support vector machine on a gapped-subsequence string kernel with Nystrom landmarks, over sentences.

The kernel of two words compares their weighted subsequences: ORDERS letters within SPAN places, each place spanned
costing a factor DECAY, so an insult with a letter put in between or left out stays near the plain one. The inner product
is scaled to 1 for equal words and raised to POWER, which keeps words that share only common syllables apart. The
kernel of two sentences is the sum over their distinct words. Powers, sums and products of kernels are kernels.

Nystrom: a sentence is described by its kernel values with the landmarks, words of the labelled sentences, whitened by
the landmarks' kernel matrix. A linear machine there is one coefficient per landmark, so a sentence's margin is a sum over
its words, and a word is scored once.

Labels are of documents, margins of sentences: a toxic document has at least one toxic sentence, a clean one has none. The
machine is fitted to all sentences first, then a few times over to the worst sentence of each toxic document against
sentences of clean ones, the worst of each clean document among them. A document's score is that of its worst sentence.
"""

from __future__ import annotations

import itertools
import pickle
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import fold, text_bytes
from volspark.llm.quality import training_rows

ORDERS, SPAN, DECAY, POWER = (3, 4), 5, 0.85, 2
#: Added to a squared norm, so that a word of one or two subsequences is near nothing.
SMALL = 2.0
#: Subsequences are told apart by so many bits of a hash of their letters, of whatever script.
BITS = 20
#: Most words of a sentence; longer ones are cut there.
LONGEST = 40
UNIT = re.compile(r"[^\W\d_]+(?:['*.\-_@$!0-9]+[^\W\d_]+)*")
LETTERS = re.compile(r"[^\W\d_]+")
SPELLED = re.compile(r"(?<!\S)(?:[^\W\d_]\s){2,}[^\W\d_](?!\w)")
REMEMBERED = 120_000
#: Highest score of all texts if the labels teach nothing; under the threshold, so that all are kept.
UNKNOWN = 0.25
#: Bytes of text whose words are scored together.
CHUNK = 1 << 21

_PATTERNS = [(0, *rest) for order in ORDERS for rest in itertools.combinations(range(1, SPAN), order - 1)]
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def units(token: str) -> tuple[str, ...]:
    """The words of a token between white space; words with single marks inside also joined without them."""
    out: list[str] = []
    for unit in UNIT.findall(token):
        parts = LETTERS.findall(unit)
        out += parts if len(parts) == 1 else [*parts, "".join(parts)]
    return tuple(dict.fromkeys(out))


def lines(text: str) -> list[list[str]]:
    """Lower-case tokens of each line; a run of three or more single letters is one token."""
    text = SPELLED.sub(lambda m: "".join(m[0].split()), text.lower())
    return [t for line in text.split("\n") if (t := line.split())]


def sentences(text: str) -> list[list[str]]:
    """Distinct words of each sentence; sentences end at a line's end, after a token that ends in . ! or ?, and at LONGEST tokens."""
    out = []
    for line in lines(text):
        ends = _ends(np.array([t[-1] in ".!?" for t in line]), np.array([len(line)]))
        for a, z in itertools.pairwise([0, *ends.tolist()]):
            out.append(list(dict.fromkeys(u for t in line[a:z] for u in units(t))))
    return [s for s in out if s]


def _ends(stops: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """End places of sentences over lines of `sizes` tokens with stops after some."""
    last = np.union1d(np.flatnonzero(stops) + 1, np.cumsum(sizes))
    last = last[last > 0]
    width = np.diff(last, prepend=0)
    if width.max(initial=0) <= LONGEST:
        return last
    more = [np.arange(e - w + LONGEST, e, LONGEST) for e, w in zip(last[width > LONGEST].tolist(), width[width > LONGEST].tolist(), strict=True)]
    return np.union1d(last, np.concatenate(more))


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, subsequence, weight), a row for each distinct subsequence of a string, by owner; the front of a string is a
    letter, too. A pad inside a pattern's reach breaks it off, so no subsequence crosses into the next string."""
    flat = "".join("\x01" + s + "\x00" * SPAN for s in strings)
    points = np.frombuffer(flat.encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(strings)), [len(s) + 1 + SPAN for s in strings])
    n = len(points) - SPAN
    keys, weight = [], []
    for pattern in _PATTERNS:
        key, whole = points[:n].copy(), points[:n] > 0
        for p in pattern[1:]:
            part = points[p : p + n]
            key = (key * _M1) ^ (part * _M2)
            key ^= key >> np.uint64(29)
            whole &= part > 0
        here = np.flatnonzero(whole)
        name = (key[here] * _M2 + np.uint64(len(pattern))) >> np.uint64(64 - BITS)
        keys.append((owner[here] << BITS) + name.astype(np.int64))
        weight.append(np.full(len(here), DECAY ** pattern[-1]))
    keys, weight = np.concatenate(keys), np.concatenate(weight)
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1])))
    total = np.add.reduceat(weight[order], first) if len(first) else weight
    keys = keys[first]
    return keys >> BITS, keys & ((1 << BITS) - 1), total


def _norms(owner: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    return np.sqrt(np.bincount(owner, weight * weight, n) + SMALL)


class Landmarks:
    """Words that others are compared with, as a list of (landmark, weight) for each of their subsequences."""

    def __init__(self, words: list[str]):
        self.words = words
        owner, sub, weight = subsequences(words)
        order = np.argsort(sub, kind="stable")
        self.owner, self.weight = owner[order], (weight / _norms(owner, weight, len(words))[owner])[order]
        self.kinds, self.first, self.many = np.unique(sub[order], return_index=True, return_counts=True)

    def kernel(self, strings: list[str]) -> np.ndarray:
        """(string, landmark) kernel values."""
        n = len(self.words)
        out = np.zeros((len(strings), n), np.float32)
        if not len(self.kinds):
            return out
        for at in range(0, len(strings), 1024):
            part = strings[at : at + 1024]
            owner, sub, weight = subsequences(part)
            norm = _norms(owner, weight, len(part))
            place = np.minimum(np.searchsorted(self.kinds, sub), len(self.kinds) - 1)
            hit = np.flatnonzero(self.kinds[place] == sub)
            many = self.many[place[hit]]
            own = np.repeat(owner[hit], many)
            entry = np.arange(len(own)) - np.repeat(np.cumsum(many) - many - self.first[place[hit]], many)
            value = np.bincount(own * n + self.owner[entry], np.repeat(weight[hit], many) * self.weight[entry], len(part) * n)
            out[at : at + len(part)] = (value.reshape(-1, n) / norm[:, None]) ** POWER
        return out


@dataclass
class Machine:
    landmarks: Landmarks | None
    alpha: np.ndarray
    bias: float
    slope: float
    shift: float

    def parts(self, words: list[str]) -> np.ndarray:
        """What each word adds to the margin of its sentence."""
        if self.landmarks is None:
            return np.zeros(len(words))
        step = 1 << 14
        return np.concatenate([self.landmarks.kernel(words[i : i + step]) @ self.alpha for i in range(0, len(words), step)] or [np.zeros(0)])

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, damp: float = 1e-3, rounds: int = 120) -> tuple[np.ndarray, float]:
    """Squared-hinge support vector machine by accelerated gradients; y is -1 or 1."""
    z = np.concatenate((x, np.ones((len(x), 1), x.dtype)), 1)
    w = v = np.zeros(z.shape[1])
    weight = weight / weight.sum()
    step = 1 / (2 * np.linalg.eigvalsh((z * weight[:, None]).T @ z)[-1] + damp)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (z @ v))
        grad = -2 * z.T @ (weight * y * slack) + damp * np.append(v[:-1], 0)
        new = v - step * grad
        v, w = new + i / (i + 3) * (new - w), new
    return w[:-1], float(w[-1])


def _distinct(texts: list[str]) -> np.ndarray:
    """Texts that are no near copies of an earlier one: two of four minima over hashed 3-word shingles agree in copies."""
    seen: set[tuple] = set()
    keep = []
    odd = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], np.uint64)
    for i, t in enumerate(texts):
        words = t.lower().split()
        h = np.array([zlib.crc32(" ".join(words[a : a + 3]).encode()) for a in range(max(1, len(words) - 2))], np.uint64)
        low = ((h[:, None] * odd + odd[::-1]) & np.uint64(0xFFFFFFFF)).min(0).tolist()
        pairs = {(a, b, low[a], low[b]) for a, b in itertools.combinations(range(4), 2)}
        if not pairs & seen:
            keep.append(i)
        seen |= pairs
    return np.array(keep, np.int64)


def _spoiled(word: str, rng: np.random.Generator) -> str:
    """The word with one letter put in, as those do who want to pass a list."""
    at = int(rng.integers(1, len(word))) if len(word) > 2 else len(word)
    return word[:at] + "abcdefghijklmnopqrstuvwxyz"[rng.integers(26)] + word[at:]


def fit(texts: list[str], labels: np.ndarray, landmarks: int = 256, most_clean: int = 12_000, rounds: int = 4, spoiled: float = 2.0) -> Machine:
    """Learn from labelled documents, sentence by sentence.

    Half of the landmarks are words that toxic documents have oftener than clean ones, a quarter are frequent words, the rest
    are any words; the coefficients of all come from the machine. It sees at most `most_clean` sentences of clean
    documents drawn at random, the worst sentence of every clean document, and those of the toxic ones, these also with a letter
    put into each word, at `spoiled` times their weight.
    """
    one = _distinct(texts)
    labels = np.asarray(labels, np.int64)[one]
    n1, n0 = int(labels.sum()), int(len(labels) - labels.sum())
    # nothing tells texts apart: all have the prior probability, but at most UNKNOWN, as nothing speaks against any of them
    never = Machine(None, np.zeros(0), 0.0, 0.0, float(min(np.log((n1 + 1) / (n0 + 1)), np.log(UNKNOWN / (1 - UNKNOWN)))))
    place: dict[str, int] = {}
    doc, size, ids = [], [], []
    for d, i in enumerate(one.tolist()):
        for s in sentences(texts[i]):
            doc.append(d), size.append(len(s))
            ids.append(np.fromiter((place.setdefault(u, len(place)) for u in s), np.int32, len(s)))
    if not n1 or not n0 or not ids:
        return never
    doc, size, ids, words = np.array(doc), np.array(size), np.concatenate(ids), list(place)
    start, toxic = np.cumsum(size) - size, labels[doc] == 1
    pairs = np.unique(np.repeat(doc, size).astype(np.int64) * len(words) + ids)
    t, c = (np.bincount(pairs[labels[pairs // len(words)] == y] % len(words), minlength=len(words)) for y in (1, 0))
    rng = np.random.default_rng(5)
    telling = np.argsort(-(t / n1 - c / n0) / np.sqrt(t + c + 1), kind="stable")[: landmarks // 2]
    often = np.argsort(-(t + c), kind="stable")[: landmarks // 4]
    chosen = dict.fromkeys([*telling.tolist(), *often.tolist(), *rng.permutation(len(words))[: landmarks // 4].tolist()])
    marks = Landmarks([words[i] for i in chosen])
    kernel = marks.kernel(marks.words).astype(float)
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    good = values > 1e-4 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])

    def described(some: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(some), whiten.shape[1]), np.float32)
        for at in range(0, len(some), 500):
            part = some[at : at + 500]
            used = {u: i for i, u in enumerate(dict.fromkeys(u for s in part for u in s))}
            values = (marks.kernel(list(used)) @ whiten).astype(np.float32)
            width = np.array([len(s) for s in part])
            out[at : at + len(part)] = np.add.reduceat(values[[used[u] for s in part for u in s]], np.cumsum(width) - width, axis=0)
        return out

    def features(some: np.ndarray) -> np.ndarray:
        return described([[words[i] for i in ids[start[s] : start[s] + size[s]].tolist()] for s in some.tolist()])

    bad, clean = np.flatnonzero(toxic), np.flatnonzero(~toxic)
    if len(clean) > most_clean:
        clean = np.sort(rng.choice(clean, most_clean, replace=False))
    x_clean, pull = features(clean), 1 / np.bincount(doc, minlength=len(labels))[doc[bad]]
    if not len(bad) or not len(clean):
        return never
    for _ in range(rounds):
        odd = [[_spoiled(words[i], rng) for i in ids[start[b] : start[b] + size[b]].tolist()] for b in bad.tolist()]
        x = np.concatenate((features(bad), described(odd), x_clean))
        y = np.concatenate((np.ones(2 * len(bad)), -np.ones(len(clean))))
        w, bias = _svm(x, y, np.concatenate((pull / pull.sum(), spoiled * pull / pull.sum(), np.full(len(clean), 1 / len(clean)))))
        machine = Machine(marks, whiten @ w, bias, 1.0, 0.0)
        margin = np.add.reduceat(machine.parts(words)[ids], start) + bias
        order = np.lexsort((margin, doc))
        worst = order[np.flatnonzero(np.append(doc[order][1:] != doc[order][:-1], True))]
        bad = worst[toxic[worst]]
        pull = np.ones(len(bad))
        hard = np.setdiff1d(worst[~toxic[worst]], clean)
        clean, x_clean = np.concatenate((clean, hard)), np.concatenate((x_clean, features(hard)))
    top = np.full(len(labels), bias)
    top[doc[worst]] = margin[worst]
    machine.slope, machine.shift = _platt(top, labels.astype(float))
    return machine if machine.slope > 0 else never


def _platt(margin: np.ndarray, y: np.ndarray, damp: float = 1e-3) -> tuple[float, float]:
    """Logistic fit of labels to margins by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - y) * margin).sum() + damp * (a - 1), (p - y).sum()])
        q = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(q * margin**2).sum() + damp, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-9]])
        move = np.linalg.solve(h, g)
        move *= min(1.0, 5 / max(np.abs(move).max(), 1e-9))
        a, b = a - move[0], b - move[1]
        if np.abs(move).max() < 1e-6:
            break
    return float(max(a, 0.0)), float(b)


def _score(batches, machine: Machine):
    """Tokens are looked up once a task; of a group of texts all sentences are summed at once."""
    place: dict[str, int] = {}
    names: dict[tuple[str, ...], int] = {}
    word, stops, value = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0)

    def learn_tokens(fresh: list[str]) -> None:
        nonlocal word, stops, value
        own, new = [], []
        for t in fresh:
            u = units(t)
            if u not in names:
                names[u] = len(names)
                new.append(u)
            own.append(names[u])
        flat = list(dict.fromkeys(u for us in new for u in us))
        part = dict(zip(flat, machine.parts(flat).tolist(), strict=True))
        word, stops = np.append(word, np.array(own, np.int64)), np.append(stops, np.array([t[-1] in ".!?" for t in fresh], bool))
        value = np.append(value, [sum(map(part.__getitem__, us)) for us in new])

    def margins(texts: list[bytes]) -> np.ndarray:
        nonlocal word, stops, value
        if len(place) > REMEMBERED:
            place.clear(), names.clear()
            word, stops, value = word[:0], stops[:0], value[:0]
        known, flat, sizes, first = len(place), [], [], [0]
        for raw in texts:
            for line in lines(raw.decode("utf-8", "replace")):
                flat += [place.setdefault(t, len(place)) for t in line]
                sizes.append(len(line))
            first.append(len(flat))
        if len(place) > known:
            learn_tokens(list(itertools.islice(place, known, None)))
        out = np.full(len(texts), machine.bias)
        if not flat:
            return out
        ids = np.array(flat)
        ends = _ends(stops[ids], np.array(sizes))
        keys = np.unique(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)) * len(names) + word[ids])
        sums = np.bincount(keys // len(names), value[keys % len(names)], len(ends)) + machine.bias
        some = np.flatnonzero(np.diff(first))
        out[some] = np.maximum.reduceat(sums, np.searchsorted(ends, np.array(first)[some], side="right"))
        return out

    for b in batches:
        texts, at, top = b.column(b.num_columns - 1), 0, [np.zeros(0)]
        while at < b.num_rows:
            group, size = [], 0
            while at < b.num_rows and size < CHUNK:
                group.append(texts[at].as_py())
                size += len(group[-1])
                at += 1
            top.append(margins(group))
        own = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(machine.probability(np.concatenate(top)))], [*b.schema.names[:-1], "score"])


def _fit(frames, **fitting):
    """One row with the machine of all frames, whose order does not count."""
    rows = pd.concat([*frames, pd.DataFrame({"doc_id": [], "text": [], "y": []})])
    rows = rows.assign(text=[t or "" for t in rows["text"]]).drop_duplicates().sort_values(["doc_id", "text", "y"])
    yield pd.DataFrame({"machine": [pickle.dumps(fit(rows["text"].tolist(), rows["y"].to_numpy(int), **fitting))]})


def learn(docs: DataFrame, labels: DataFrame, parts: int = 5, most_training: int = 4000, **fitting) -> Machine:
    """A machine from at most `most_training` labelled documents outside the held-out fold (crc32 of the id mod `parts` is 0).

    That bounded sample is fitted in one task, which Spark runs again elsewhere if it is lost; rows repeated count once,
    several labels of one document as several documents. Only the machine comes to the driver.
    """
    rows = training_rows(docs, labels, "toxic", fold("doc_id", parts) != 0, most_training).select("doc_id", "text", "y")
    found = rows.repartition(1).mapInPandas(lambda it: _fit(it, **fitting), "machine binary").collect()
    return pickle.loads(found[0]["machine"]) if found else fit([], np.zeros(0))


def score_toxicity(docs: DataFrame, machine: Machine, keep: list[str] = ()) -> DataFrame:
    """(keep, score) of every row of docs: the probability of its worst sentence. Null and wordless texts have the score
    of a sentence without words; a text of any length is scored whole, equal texts score the same."""
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes().alias("__text"))
    shared_machine = docs.sparkSession.sparkContext.broadcast(machine)
    return rows.mapInArrow(lambda it: _score(it, shared_machine.value), rows.drop("__text").schema.add("score", "double"))


def classify(docs: DataFrame, labels: DataFrame, parts: int = 5, most_training: int = 4000, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text); other columns are ignored. A score of just
    `threshold` is predicted toxic; null labels are skipped, a null id is in the fold of the empty text."""
    machine = learn(docs, labels, parts, most_training)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold("doc_id", parts) == 0).alias("held_out"), "text")
    scored = score_toxicity(rows, machine, ["doc_id", "held_out"])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
