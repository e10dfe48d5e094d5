"""Learnt cutoffs of the quality rules hold their bound in every stratum."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.llm import rules


@pytest.fixture(scope="module")
def labelled(spark):
    """Stratum a is large and plain. Good documents of b, c and d have longer words than a's bad ones, and are too few to learn from."""
    sizes = {"a": (3000, 300), "b": (150, 40), "c": (30, 10), "d": (3000, 300)}
    rows = [(s, 10_000 * k + i, int(i < good), (4.0 + i % 10 / 10) if i < good and s == "a" else 7.5 if i < good else 7.0 + (s == "d")) for k, (s, (good, bad)) in enumerate(sizes.items()) for i in range(good + bad)]
    out = spark.createDataFrame(rows, "stratum string, doc_id long, good int, word_length double")
    return out.withColumns({name: F.lit(1.0) for name, _ in rules.RULES if name != "word_length"}).cache()


def rejected(labelled, chosen, s):
    return labelled.where((F.col("stratum") == s) & (F.col("good") == 1) & rules._fails(F.array(*[F.lit(c) for c in chosen[s]]))).count() if s in chosen else 0


def test_strata_that_fail_reject_nothing(labelled):
    """b and c have too few rows for the bound: neither takes the pooled cutoffs of a."""
    chosen = rules.cutoffs(labelled.where("stratum <> 'd'"))
    assert "a" in chosen and not {"b", "c", rules.POOLED} & set(chosen)
    assert rejected(labelled, chosen, "a") <= 60


def test_pooled_cutoffs_only_where_they_pass(labelled):
    """With no stratum of its own, one takes the pooled cutoffs only if its own good documents stay."""
    chosen = rules.cutoffs(labelled.where("stratum <> 'b'"), most_strata=0)
    assert set(chosen) == {"a", "d"} and all(rejected(labelled, chosen, s) <= 60 for s in chosen)
    one = rules.cutoffs(labelled.where("stratum = 'a' or stratum = 'd' and doc_id % 20 = 0"), most_strata=0)
    assert "d" not in one


def plain(rows, loss=0.02, risk=0.1):
    """Cutoffs of one stratum with its own family, in numpy; rows (second, good, signed statistics)."""
    second, good, x = (np.array([r[i] for r in rows]) for i in range(3))
    at = lambda v, q: np.sort(v)[max(int(np.ceil(q * len(v))) - 1, 0)]
    g0, b0, g1 = x[~second & (good == 1)], x[~second & (good == 0)], x[second & (good == 1)]
    mid, unit, used = [], [], []
    for i in range(x.shape[1]):
        m = at(g0[:, i], 0.5)
        mid.append(m)
        unit.append(next((q - m for q in (at(g0[:, i], t) for t in rules.TAILS) if q > m), 1e-6 * max(1, abs(m))))
        tail = at(g0[:, i], 0.99)
        used.append((b0[:, i] > tail).mean() > max(rules.FOUND, (g0[:, i] > tail).mean()))
    mid, unit, used = np.array(mid), np.array(unit), np.array(used)
    excess = ((g0 - mid) / unit)[:, used].max(axis=1)
    best, most = None, -1
    for t in [b * max(excess.max(), 0.0) for b in rules.BEYOND] + [at(excess, 1 - level) for level in rules.LEVELS]:
        cuts = mid + (t + 1e-9 * max(1, abs(t))) * unit
        fails = lambda v, cuts=cuts: (v > cuts)[:, used].any(axis=1)
        if rules.upper_bound(int(fails(g1).sum()), len(g1), risk) > loss:
            break
        if fails(x[good == 0]).sum() > most:
            best, most = [c if u else None for c, u in zip(cuts.tolist(), used, strict=True)], fails(x[good == 0]).sum()
    return best


def test_cutoffs_equal_plain_code(spark):
    """Random statistics with tails, ties and a constant rule."""
    rng = np.random.default_rng(5)
    names = list(dict.fromkeys(name for name, _ in rules.RULES))
    good = (rng.random(3000) < 0.85).astype(int)
    x = rng.gamma(2.0, 1.0, (3000, len(names))) + (good == 0)[:, None] * rng.gamma(1.0, 6.0, (3000, len(names))) * (rng.random((3000, len(names))) < 0.3)
    x[:, 1], x[:, 2] = 1.0, np.round(x[:, 2])
    rows = [("s", i, int(g), *v.tolist()) for i, (g, v) in enumerate(zip(good, x, strict=True))]
    df = spark.createDataFrame(rows, "stratum string, doc_id long, good int, " + ", ".join(f"{n} double" for n in names))
    halves = df.select((F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(3)) > 0).alias("s"), "good", F.array(*rules._signed()).alias("x")).collect()
    want, got = plain([(r["s"], r["good"], r["x"]) for r in halves]), rules.cutoffs(df)["s"]
    assert want is not None and [w is None for w in want] == [g is None for g in got]
    assert [g for g in got if g is not None] == pytest.approx([w for w in want if w is not None], rel=1e-9)


def test_filter_quality_with_planted_rows(spark):
    """Shouting documents go although the base rules pass them; plain ones stay, in a null stratum and an unlabelled one too."""
    rng = random.Random(3)
    some = "the river and a stone of summer in winter table for garden with window is paper that silver letter to cloud".split()
    text = lambda: " ".join(rng.choice(some) + rng.choice(["", "s", "ly", "er"]) for _ in range(rng.randrange(60, 90)))
    rows, marks = [], []
    for i in range(2700):
        bad = i % 9 == 0
        t = text()
        rows.append((i, t.upper().replace(" ", "!!! ") if bad else t, None if i % 2 else "en", 1.0))
        if i % 10 < 8:
            marks.append((i, int(not bad), 0))
    rows += [(2700, None, "en", 1.0), (2701, text(), "xx", 1.0), (2702, "", None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, stratum double")
    out = {r["doc_id"]: r for r in rules.filter_quality(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()}
    assert len(out) == 2703 and not any(out[i]["base_failed"] for i in range(2700))
    assert not any(out[i]["kept"] for i in range(0, 2700, 9))
    lost = sum(not out[i]["kept"] for i in range(2700) if i % 9)
    assert lost <= 48 and out[2701]["kept"] and out[2700]["base_failed"] and out[2702]["base_failed"]
