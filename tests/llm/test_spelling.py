"""Spelling groups against all pairs of words."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from volspark.llm import spelling
from volspark.llm.common import table

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def counts(rows):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if c >= 2 and len(w) >= 7}


def expected(n):
    by_size, form, got = {}, {}, {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    for w in n:
        own = [v for s in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(s, []) if near(w, v)]
        best = min(own, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
        got[w] = len(own)
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], got[w], n[form[w]] if form[w] else None))
    return sorted(out)


def variants(rng, w):
    i, c = rng.randrange(len(w)), rng.choice("abcxyzéß")
    return rng.choice([w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :], w + c, c + w])


def corpus():
    """Words with repeated letters, variants of them and of these, in many sizes of groups."""
    rng = random.Random(5)
    base = ["committee", "banana" * 2, "aaaaaaaa", "abababab", "missïssippi", "Ävernünftig", "separate", "necessary", "zzzzzzzzzz", "rhythmic"]
    rows = []
    for i, w in enumerate(base * 3):
        one = variants(rng, w)
        rows.append((i, " ".join([w] * 240 + [one] * 20 + [variants(rng, one)] * 2 + [variants(rng, w) for _ in range(30)])))
    rows += [(100, None), (101, ""), (None, "separate seperate seperate ×÷×÷×÷× " * 3), (102, "x" * 3000 + " " + "x" * 3000 + " " + "x" * 2999 + " " + "x" * 2999), rows[0], rows[0]]
    return rows


def test_groups(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4).withColumns({c: F.lit("a") for c in ("word", "n", "size", "run", "form", "root")})
    want = expected(counts(rows))
    assert sorted(map(tuple, spelling.spelling_groups(df).collect())) == want
    assert sum(w[1] is not None and w[2] != w[1] for w in want) > 3  # chains of forms


def test_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, spelling.spelling_groups(docs).collect())) == expected(counts(rows))


def test_no_words(spark, empty):
    assert spelling.spelling_groups(empty).count() == 0
    assert spelling.spelling_groups(spark.createDataFrame([(1, "a bb ccc"), (2, None)], "doc_id long, text string")).count() == 0
