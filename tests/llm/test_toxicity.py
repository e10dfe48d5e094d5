"""The string kernel, its machine and its scores against plain versions."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa

from volspark.llm import toxicity as T


def plain_vector(word):
    """{(order, letters): weight} of all gapped subsequences, the front of the word being a letter."""
    word = "\x01" + word
    out = {}
    for order in T.ORDERS:
        for at in itertools.combinations(range(len(word)), order):
            if at[-1] - at[0] < T.SPAN:
                key = (order, *(word[i] for i in at))
                out[key] = out.get(key, 0) + T.DECAY ** (at[-1] - at[0])
    return out


def plain_kernel(a, b):
    u, v = plain_vector(a), plain_vector(b)
    size = lambda x: math.sqrt(sum(w * w for w in x.values()) + T.SMALL)
    return (sum(w * v.get(k, 0) for k, w in u.items()) / size(u) / size(v)) ** T.POWER


def test_kernel():
    rng = random.Random(3)
    words = ["idiot", "idxiot", "id", "x", "banana", "ананас", "naïve", "aaaaaa", *("".join(rng.choices("abcdeéж", k=rng.randint(1, 9))) for _ in range(40))]
    got = T.Landmarks(words[:20]).kernel(words)
    want = np.array([[plain_kernel(a, b) for b in words[:20]] for a in words])
    assert np.allclose(got, want, atol=1e-4)
    assert T.Landmarks(words[:3]).kernel([]).shape == (0, 3)


def planted(n=240):
    rng = random.Random(5)
    syllables = ["ra", "ne", "to", "mi", "sol", "ken", "dar", "lu", "pi", "vo"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    insults = ["blaggard", "snivelwit", "muckface"]
    texts, labels = [], []
    for i in range(n):
        own = [[word() for _ in range(rng.randint(4, 12))] for _ in range(rng.randint(1, 5))]
        toxic = i % 3 == 0
        if toxic:
            rng.choice(own).insert(1, insults[i // 3 % 3])
        texts.append(". ".join(map(" ".join, own)) + ".")
        labels.append(int(toxic))
    return texts, np.array(labels)


def scores(machine, texts):
    batch = pa.RecordBatch.from_arrays([pa.array([t.encode() for t in texts], pa.binary())], ["t"])
    return next(T._score([batch], machine)).column(0).to_numpy()


def test_machine_on_planted_insults():
    texts, labels = planted()
    machine = T.fit(texts[:180], labels[:180])
    assert ((scores(machine, texts[180:]) >= 0.5) == labels[180:]).mean() >= 0.95
    spelled = ["ra tone blaggard mi", "tone blag.gard mi", "tone b l a g g a r d mi", "tone sniv*elwit mi", "tone mucxkface mi", "tone blagggard mi", "Ra tone. MUCKFACE"]
    clean = ["ra tone mi", "", "?!", "soldar luvo", "ra " * 500, "b l"]
    assert (scores(machine, spelled) >= 0.5).all(), scores(machine, spelled)
    assert (scores(machine, clean) < 0.5).all(), scores(machine, clean)


def test_scores_are_those_of_the_worst_sentence():
    texts, labels = planted()
    machine = T.fit(texts, labels)
    odd = ["", "a", "\n\n", "x. y! z? w", "w " * 130 + "muckface " + "v " * 90, "one\ntwo muckface\nthree", "muckface muckface muckface", "naïve ÜBER muck-face", texts[0] * 30]
    many = odd + texts[:40]
    plain = [max((machine.parts(s).sum() for s in T.sentences(t)), default=0.0) + machine.bias for t in many]
    # a sentence without a word has the margin of an empty one
    got = scores(machine, many)
    want = machine.probability(np.maximum(plain, [machine.bias if any(c for c in T.lines(t)) and any(not T.units(w) for line in T.lines(t) for w in line) else -9 for t in many]))
    assert np.allclose(got, want, atol=1e-4)
    small = [scores(machine, [t])[0] for t in many]
    assert np.allclose(small, got, atol=1e-9)


def test_rows_in_any_order_teach_the_same(spark):
    texts, labels = planted(60)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "x"), (61, None)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(y)) for i, y in enumerate(labels)] + [(3, int(labels[3])), (5, 1), (5, 0), (61, 0)], "doc_id long, toxic int")
    a, b = (T.learn(docs.repartition(n), marks.repartition(n)) for n in (1, 7))
    assert np.array_equal(a.alpha, b.alpha) and (a.bias, a.slope, a.shift) == (b.bias, b.slope, b.shift)
