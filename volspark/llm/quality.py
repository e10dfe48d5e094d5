"""Quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import fold, text_bytes
from volspark.llm.textstats import RATIOS, measure, text_stats


@dataclass
class Trees:
    """All trees as flat arrays; a leaf is its own child."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Every row walks every tree at once, one level a step."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.cut[at], self.left[at], self.right[at])
        return self.base + self.value[at].sum(1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _best_split(gh: np.ndarray, cuts: np.ndarray, damp: float, least: float) -> tuple[float, int, int]:
    """(gain, column, bin) of the best split of one node; gh: (column, 2, bin) sums of gradients and curvatures."""
    left = gh.cumsum(2)
    g, h = left[:, 0], left[:, 1]
    g_all, h_all = g[:, -1:], h[:, -1:]
    gain = g**2 / (h + damp) + (g_all - g) ** 2 / (h_all - h + damp) - g_all**2 / (h_all + damp)
    gain[(h < least) | (h_all - h < least) | (np.arange(gain.shape[1]) >= cuts[:, None])] = -1
    j, b = np.unravel_index(np.argmax(gain), gain.shape)
    return float(gain[j, b]), int(j), int(b)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, damp: float = 1.0, least: float = 3.0) -> Trees:
    """Logistic boosting on binned columns; with no rows or one class only the smoothed base rate is left."""
    n, k = x.shape
    base = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def leaf(v: float) -> int:
        name = len(value)
        for column, x in ((feature, 0), (cut, np.inf), (left, name), (right, name), (value, v)):
            column.append(x)
        return name

    if 0 < y.sum() < n:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(k)]
        binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
        cuts = np.array([len(e) for e in edges])
        margin = np.full(n, base)
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(leaf(0.0))
            level, at = [roots[-1]], np.zeros(n, np.int64)  # the nodes of this depth; each row's place in them, or -1
            for _depth in range(depth):
                live = np.flatnonzero(at >= 0)
                cell = at[live, None] * bins + binned[live]
                gh = np.stack([[np.bincount(cell[:, j], w[live], len(level) * bins).reshape(-1, bins) for w in (g, h)] for j in range(k)])
                deeper, goes = [], np.full(n, -1)
                for s, name in enumerate(level):
                    gain, j, b = _best_split(gh[:, :, s], cuts, damp, least)
                    if gain <= 1e-6:
                        continue
                    own = np.flatnonzero(at == s)
                    low = binned[own, j] <= b
                    feature[name], cut[name] = j, float(edges[j][b])
                    for side, rows in ((left, own[low]), (right, own[~low])):
                        side[name] = leaf(-rate * g[rows].sum() / (h[rows].sum() + damp))
                        goes[rows] = len(deeper)
                        deeper.append(side[name])
                at[:] = goes
                if not deeper:
                    break
                level = deeper
            flat = Trees(*(np.array(a) for a in (feature, cut, left, right, value)), np.array(roots[-1:]), depth, 0.0)
            margin += flat.margin(x)
    if not roots:
        leaf(0.0)
    return Trees(*(np.array(a) for a in (feature, cut, left, right, value)), np.array(roots, np.int64), depth, base)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, keep, most: int) -> DataFrame:
    """(doc_id, text, y): labelled documents that `keep` admits, at most `most` of them by the hash of their id."""
    marked = labels.where(F.col(label).isNotNull() & keep).select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(most)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(marked), "doc_id")


def _score(batches, trees: Trees):
    for b in batches:
        x = np.array([measure(t)[1] for t in b.column(2).to_pylist()]).reshape(-1, len(RATIOS))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate([trees.score(x[i : i + 4096]) for i in range(0, len(x), 4096)] or [np.zeros(0)]))], ["doc_id", "held_out", "score"])


def classify(docs: DataFrame, labels: DataFrame, parts: int = 4, held: int = 2, threshold: float = 0.7, most_training: int = 20_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text), trained on labels.quality.

    Training sees at most `most_training` labelled documents outside the held-out fold. Null texts are empty,
    null labels are skipped, null ids read as the empty text in the fold; other columns are ignored.
    """
    out = fold("doc_id", parts) == held
    got = text_stats(training_rows(docs, labels, "quality", ~out, most_training), ["y"]).select("y", *RATIOS).toPandas()
    trees = fit(got[RATIOS].to_numpy(float).reshape(-1, len(RATIOS)), got["y"].to_numpy(float))
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), out.alias("held_out"), text_bytes().alias("text"))
    scored = scored.mapInArrow(lambda it: _score(it, trees), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
