"""Quality rules whose cutoffs come with a bound on good documents lost."""

from __future__ import annotations

from math import lgamma, log

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.llm import simhash
from volspark.llm.common import shared
from volspark.llm.textstats import COUNTS, text_stats
from volspark.operators.labels import small

#: (statistic, 1: large values are bad, -1: small values are bad)
RULES = [
    ("symbols_per_word", 1), ("dup_line_share", 1), ("repeat_share", 1), ("upper_share", 1), ("shouts_per_word", 1),
    ("bars_per_word", 1), ("top_word_share", 1), ("echo_share", 1), ("long_word_share", 1), ("word_length", 1), ("word_length", -1), ("stops_per_word", -1),
]
#: Share of good documents that all rules together may cut off, as seen by the cutoffs' own fold, from lenient to strict.
LEVELS = [0.0002, 0.0005, 0.001, 0.002, 0.003, 0.005, 0.0075, 0.01, 0.0125, 0.015]
#: More lenient still: this often the largest excess of the cutoffs' own fold.
BEYOND = [4.0, 2.0, 1.5, 1.25]
N_LEVELS = len(BEYOND) + len(LEVELS)
#: A rule counts if it finds over this share of bad documents beyond the first of TAILS, and a larger one than of good documents.
FOUND = 0.05
#: A rule's unit is the distance from good documents' median to the first of these quantiles that lies beyond it.
TAILS = [0.99, 0.999, 1.0]
POOLED = "*"


def upper_bound(k: int, n: int, risk: float) -> float:
    """Exact binomial (Clopper-Pearson) upper bound on a rate after k of n, wrong with probability `risk` at most."""
    if n == 0 or k >= n:
        return 1.0
    i = np.arange(k + 1)
    choose = np.array([lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) for j in i.tolist()])
    lo, hi = k / n, 1.0
    for _ in range(60):
        p = (lo + hi) / 2
        if p >= 1 or np.exp(choose + i * log(p) + (n - i) * np.log1p(-p)).sum() <= risk:
            hi = p
        else:
            lo = p
    return hi


def _signed() -> list[Column]:
    """The statistics of RULES, large values bad."""
    return [F.col(stat) * F.lit(float(sign)) for stat, sign in RULES]


def _fails(cuts: Column) -> Column:
    """Some rule rejects; cuts hold the largest value that stays, of each of RULES; a null is no cutoff."""
    bad = F.lit(False)
    for i, x in enumerate(_signed()):
        bad = bad | F.coalesce(x > cuts[i], F.lit(False))
    return bad


def _family(good: DataFrame, bad: DataFrame) -> dict[str, list[list[float | None]]]:
    """{stratum: cutoffs of each of LEVELS, each in the order of RULES} from the first fold (stratum, statistics).

    One family a stratum, each level's cutoffs within the next one's: a document's excess is the largest, over the rules, of its
    distance from the good documents' median in units of their tail. A level's cutoffs are the excess that this share of
    good documents exceeds, or for the first ones a multiple of the largest. Rules that find too few bad documents (FOUND) are left out.
    """
    quantiles = [F.percentile_approx(x, [0.5, *TAILS], 100_000).alias(f"q{i}") for i, x in enumerate(_signed())]
    tails = [(r["stratum"], [r[f"q{i}"] for i in range(len(RULES))]) for r in good.groupBy("stratum").agg(*quantiles).collect()]
    if not tails:
        return {}
    units = []
    for stratum, rules in tails:
        spread = [next((q - rule[0] for q in rule[1:] if q > rule[0]), 1e-6 * max(1.0, abs(rule[0]))) for rule in rules]
        units.append((stratum, [rule[0] for rule in rules], spread, [rule[1] for rule in rules]))
    known = F.broadcast(good.sparkSession.createDataFrame(units, "stratum string, mid array<double>, unit array<double>, tail array<double>"))
    beyond = [F.avg((x > F.col("tail")[i]).cast("int")).alias(f"s{i}") for i, x in enumerate(_signed())]
    share = {name: {r["stratum"]: r for r in rows.join(known, "stratum").groupBy("stratum").agg(*beyond).collect()} for name, rows in (("good", good), ("bad", bad))}
    used = [(s, [s in share["bad"] and share["bad"][s][f"s{i}"] > max(FOUND, share["good"][s][f"s{i}"]) for i in range(len(RULES))]) for s, *_ in units]
    known = known.join(F.broadcast(good.sparkSession.createDataFrame(used, "stratum string, used array<boolean>")), "stratum")
    excess = F.greatest(*[F.when(F.col("used")[i], (x - F.col("mid")[i]) / F.col("unit")[i]) for i, x in enumerate(_signed())])
    scored = good.join(F.broadcast(known), "stratum").groupBy("stratum").agg(F.percentile_approx(excess, [1.0, *(1 - x for x in LEVELS)], 100_000).alias("t")).collect()
    at, use = {r["stratum"]: [*(b * max(r["t"][0], 0.0) for b in BEYOND), *r["t"][1:]] for r in scored if r["t"]}, dict(used)
    # a little more than the quantile, so that documents just at it stay whatever the rounding
    return {s: [[m + (t + 1e-9 * max(1.0, abs(t))) * u if on else None for m, u, on in zip(mid, unit, use[s], strict=True)] for t in at[s]] for s, mid, unit, _ in units if s in at}


def _broken(rows: DataFrame, families: dict[str, list[list[float | None]]]) -> dict[str, tuple[int, list[int]]]:
    """{stratum: (rows, of these the rejected ones at each level)} of the strata with a family."""
    table = rows.sparkSession.createDataFrame(list(families.items()), "stratum string, cuts array<array<double>>")
    counts = [F.sum(_fails(F.col("cuts")[v]).cast("int")).alias(f"k{v}") for v in range(N_LEVELS)]
    out = rows.join(F.broadcast(table), "stratum").groupBy("stratum").agg(F.count("*").alias("n"), *counts).collect()
    return {r["stratum"]: (r["n"], [r[f"k{v}"] for v in range(N_LEVELS)]) for r in out}


def cutoffs(labelled: DataFrame, loss: float = 0.02, risk: float = 0.1, most_strata: int = 64, least: int = 200) -> dict[str, list[float | None]]:
    """{stratum: cutoffs in the order of RULES, large values bad} from labelled statistics (stratum, doc_id, good, RATIOS).

    All labelled documents count, in two folds by the hash of their id, one third and two thirds. The first gives a nested family of
    cutoffs, one for each level (see `_family`): to each of the `most_strata` largest strata with `least` good documents in it its own, to all others
    the pooled one of all rows. Good documents of the second fold, which no cutoff has seen, give each level's false rejections; the levels
    are tested from lenient to strict and pass as long as the exact upper bound stays within `loss`; of those that pass, the
    most lenient one counts that rejects most bad documents. Such an ordered
    test needs no correction for the number of levels; the risk is divided by the number of tested strata (Bonferroni), so all
    strata keep their bound at once with probability 1 - risk. Strata whose good documents are too few to pass even without a false
    rejection are not tested. They, and those where no level passes, have no cutoffs and reject nothing.
    """
    labelled = labelled.withColumn("second", F.pmod(F.xxhash64(F.lit("rules"), "doc_id"), F.lit(3)) > 0)
    good, bad = labelled.where("good = 1"), labelled.where("good = 0")
    sizes = good.groupBy("stratum").agg(F.count_if(~F.col("second")).alias("n0"), F.count_if("second").alias("n1"))
    own = [r["stratum"] for r in sizes.where(F.col("n0") >= least).orderBy(F.desc("n0"), "stratum").limit(most_strata).collect()]
    could = [(r["n1"], r["stratum"]) for r in sizes.where(F.col("n1") >= log(risk) / np.log1p(-loss)).orderBy(F.desc("n1"), "stratum").collect()]
    tested = [s for i, (n, s) in enumerate(could) if n >= log(risk / (i + 1)) / np.log1p(-loss)]
    strata = F.array(F.lit(POOLED), F.when(F.col("stratum").isin(own), F.col("stratum"))) if own else F.array(F.lit(POOLED))
    first = [rows.where("not second").withColumn("stratum", F.explode(strata)).where("stratum is not null") for rows in (good, bad)]
    families = _family(*first)
    plan = {s: families[f] for s in tested if (f := s if s in own else POOLED) in families}
    if not plan:
        return {}
    lost, caught, chosen = _broken(good.where("second"), plan), _broken(bad, plan), {}
    for s in plan:
        n, k = lost[s]
        passed = next((v for v in range(N_LEVELS) if upper_bound(k[v], n, risk / len(tested)) > loss), N_LEVELS)
        found = caught.get(s, (0, [0] * N_LEVELS))[1][:passed]
        if found:
            chosen[s] = plan[s][found.index(max(found))]
    return chosen


def filter_quality(docs: DataFrame, labels: DataFrame, least_words: int = 50, most_repeat: int = 50, **risk) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, stratum) of every row of docs.

    base_failed: fewer than `least_words` words, or over `most_repeat` percent of them in repeated 3-word windows. Of the rest
    those go that break a rule of their stratum (lang; null is one of its own). Cutoffs are learnt from labels.quality,
    near copies (4 bits of the text fingerprint) counted once; a value just at a cutoff stays, null labels are skipped, null texts are empty, other columns are ignored.
    """
    stats = text_stats(docs.select("doc_id", "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("stratum")), ["stratum"])
    stats = shared(stats.withColumn("base_failed", (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeat * F.col("n_words"))))
    marked = labels.where("quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("good"))
    # fingerprints of all rows, as texts would have to be shuffled to find the labelled ones first
    prints = simhash.fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).join(marked, "doc_id", "left_semi")
    groups = simhash.components_of(shared(prints)).groupBy("doc_id").agg(F.min("component_id").alias("copies"))
    labelled = stats.where("not base_failed").join(marked, "doc_id").join(groups, "doc_id")
    # near copies are one draw, not several: the row of the least id stands for them
    labelled = labelled.groupBy("stratum", "good", "copies").agg(F.min(F.struct("doc_id", *dict.fromkeys(stat for stat, _ in RULES))).alias("r")).select("stratum", "good", "r.*")
    chosen = cutoffs(shared(labelled), **risk)
    cuts = small(docs.sparkSession.createDataFrame(sorted(chosen.items()), "stratum string, __cuts array<double>"))
    kept = ~F.col("base_failed") & ~_fails(F.col("__cuts"))
    return stats.join(cuts, "stratum", "left").select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "stratum")
