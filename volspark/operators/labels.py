"""Label maps (vol_id, i, j, k, label): counts, algebra, boxes, overlap, editing. A voxel that is missing has label 0."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOXEL = ["i", "j", "k"]
PLACE = ["vol_id", *VOXEL]
#: Rows up to which a caller's mapping is broadcast; 256 labels of some hundred models fit.
SMALL = 100_000
#: Rows of a partition where a step needs more partitions than the session gives.
PART = 1 << 18


def small(df: DataFrame) -> DataFrame:
    """Broadcast if its size is proven; a larger table takes part in a shuffle."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of so many rows dealt by keys into partitions of about PART rows, so that a task's memory does not grow with the table; as it is
    if the session's number of partitions will do."""
    parts = -(-rows // PART)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def histogram(lab: DataFrame) -> DataFrame:
    return lab.groupBy("vol_id", "label").agg(F.count("*").alias("n"))


def volumes(lab: DataFrame, spacing: tuple[float, float, float], names: DataFrame) -> DataFrame:
    """(vol_id, label, name, n, ml); names (label, name): a label without one is named by its number."""
    ml = F.col("n") * spacing[0] * spacing[1] * spacing[2] / 1000.0
    named = histogram(lab).join(small(names.select("label", "name")), "label", "left")
    return named.select("vol_id", "label", F.coalesce("name", F.concat(F.lit("label_"), F.col("label").cast("string"))).alias("name"), "n", ml.alias("ml"))


def keep(lab: DataFrame, wanted: list[int]) -> DataFrame:
    """Other labels become 0."""
    return lab.withColumn("label", F.when(F.col("label").isin(wanted), F.col("label")).otherwise(0))


def overlay(parts: DataFrame, mapping: DataFrame) -> DataFrame:
    """One map from parts (vol_id, i, j, k, part, label): the latest part that assigns a label wins, 0 if none does.

    mapping (part, label, task_label) has (part, label) as its key, so the greatest struct of a voxel is unique.
    """
    named = parts.join(small(mapping), ["part", "label"], "left")
    best = F.max(F.when(F.col("task_label").isNotNull(), F.struct("part", "task_label")))
    return named.groupBy(*PLACE).agg(F.coalesce(best["task_label"], F.lit(0)).alias("label"))


def mask(lab: DataFrame, roi: list[int]) -> DataFrame:
    return lab.select(*PLACE, F.col("label").isin(roi).cast("int").alias("mask"))


def any_label(lab: DataFrame) -> DataFrame:
    """(vol_id, some): whether a map has a label at all."""
    return lab.groupBy("vol_id").agg(F.max(F.col("label") > 0).alias("some"))


def boxes(lab: DataFrame, *by: str) -> DataFrame:
    """Smallest boxes, ends included, of each volume and key."""
    return lab.groupBy("vol_id", *by).agg(*[f(c).alias(f"{n}_{c}") for c in VOXEL for n, f in (("lo", F.min), ("hi", F.max))])


def grown(box: DataFrame, margin: tuple[int, int, int], shape) -> DataFrame:
    """Boxes with a margin, within the grid."""
    lo = [F.greatest(F.col(f"lo_{c}") - m, F.lit(0)).alias(f"lo_{c}") for c, m in zip(VOXEL, margin, strict=True)]
    hi = [F.least(F.col(f"hi_{c}") + m, F.lit(n - 1)).alias(f"hi_{c}") for c, m, n in zip(VOXEL, margin, shape, strict=True)]
    return box.select("vol_id", *lo, *hi)


def nonzero_boxes(lab: DataFrame, shape) -> DataFrame:
    """The box of the labels over 0 of each volume, the whole grid of a volume without any."""
    own = boxes(lab.where("label <> 0"))
    every = lab.select("vol_id").distinct().join(own, "vol_id", "left")
    ends = [F.coalesce(f"{n}_{c}", F.lit(0 if n == "lo" else s - 1)).alias(f"{n}_{c}") for c, s in zip(VOXEL, shape, strict=True) for n in ("lo", "hi")]
    return every.select("vol_id", *ends)


def _inside() -> Column:
    ok = F.lit(True)
    for c in VOXEL:
        ok = ok & F.col(c).between(F.col(f"lo_{c}"), F.col(f"hi_{c}"))
    return ok


def cropped(vol: DataFrame, box: DataFrame) -> DataFrame:
    """vol within its volume's box, counted from the box's corner; a volume without a box has no voxels left."""
    rest = [c for c in vol.columns if c not in PLACE]
    return vol.join(box, "vol_id").where(_inside()).select("vol_id", *[(F.col(c) - F.col(f"lo_{c}")).alias(c) for c in VOXEL], *rest)


def pasted(grid: DataFrame, part: DataFrame, box: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """The grid's voxels with the labels of a cropped map put back at the box's corner; 0 elsewhere and for unwanted labels."""
    moved = part.join(box, "vol_id").select("vol_id", *[(F.col(c) + F.col(f"lo_{c}")).alias(c) for c in VOXEL], F.col("label").alias("__label"))
    label = F.coalesce("__label", F.lit(0))
    if wanted:
        label = F.when(label.isin(wanted), label).otherwise(0)
    return grid.select(*PLACE).join(moved, PLACE, "left").select(*PLACE, label.alias("label"))


def padded(vol: DataFrame, shape, patch) -> DataFrame:
    """vol in the middle of a grid of at least the patch's size; what is added holds no voxels, that is zeros."""
    return vol.withColumns({c: F.col(c) + max(p - n, 0) // 2 for c, n, p in zip(VOXEL, shape, patch, strict=True)})


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vol_id, i, j, k, a, b): two maps voxel by voxel; a voxel that one lacks is 0 there."""
    both = a.withColumnRenamed("label", "a").join(b.withColumnRenamed("label", "b"), PLACE, "full")
    return both.select(*PLACE, F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))


def dice(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vol_id, label, n_a, n_b, n_both, dice, identical) of the labels over 0 that either map has; two partial sums a voxel."""
    own = paired(a, b).select("vol_id", F.explode(F.array_distinct(F.array("a", "b"))).alias("label"), "a", "b").where("label > 0")
    n = own.groupBy("vol_id", "label").agg(*[F.sum(c.cast("long")).alias(x) for x, c in (("n_a", F.col("a") == F.col("label")), ("n_b", F.col("b") == F.col("label")), ("n_both", F.col("a") == F.col("b")))])
    return n.withColumn("dice", 2.0 * F.col("n_both") / (F.col("n_a") + F.col("n_b"))).withColumn("identical", (F.col("n_a") == F.col("n_both")) & (F.col("n_b") == F.col("n_both")))


def worst_dice(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vol_id, n_labels, n_identical, dice, label): labels present, those equal in all voxels, and the worst; 1.0 where no label is present."""
    every = a.select("vol_id").union(b.select("vol_id")).distinct()
    own = dice(a, b).groupBy("vol_id").agg(F.count("*").alias("n_labels"), F.sum(F.col("identical").cast("long")).alias("n_identical"), F.min(F.struct("dice", "label")).alias("w"))
    got = every.join(own, "vol_id", "left")
    return got.select("vol_id", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), F.coalesce("n_identical", F.lit(0)).alias("n_identical"), F.coalesce("w.dice", F.lit(1.0)).alias("dice"), F.col("w.label").alias("label"))


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vol_id, n, n_diff, percent, same_size): same_size is false if a map has voxels where the other has none."""
    both = a.withColumnRenamed("label", "a").join(b.withColumnRenamed("label", "b"), PLACE, "full")
    differ = F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))
    n = both.groupBy("vol_id").agg(F.count("*").alias("n"), F.sum(differ.cast("long")).alias("n_diff"), (F.count("a") == F.count("b")).alias("same_size"))
    return n.select("vol_id", "n", "n_diff", (100.0 * F.col("n_diff") / F.col("n")).alias("percent"), "same_size")


def confused(a: DataFrame, b: DataFrame) -> DataFrame:
    """(vol_id, label): labels of either map in voxels that differ."""
    return paired(a, b).where("a <> b").select("vol_id", F.explode(F.array("a", "b")).alias("label")).distinct()


def place_of(shape) -> Column:
    """A voxel's place in the dense array, last axis fastest."""
    _, ny, nz = shape
    return (F.col("i").cast("long") * ny + F.col("j")) * nz + F.col("k")


def centroids(lab: DataFrame, shape, every: int = 7) -> DataFrame:
    """Mean voxel of each label over each `every`-th place of the dense array."""
    return lab.where((place_of(shape) % every == 0) & (F.col("label") > 0)).groupBy("vol_id", "label").agg(*[F.avg(c).alias(f"c{c}") for c in VOXEL])


def _near(centre, radius_mm: float, spacing, fixed: str | None) -> Column:
    far = sum(((F.col(c) - x) * s) * ((F.col(c) - x) * s) for c, x, s in zip(VOXEL, centre, spacing, strict=True))
    near = far <= radius_mm * radius_mm
    for c, x in zip(VOXEL, centre, strict=True):
        if c == fixed:
            near = near & (F.col(c) == x)
    return near


def stamp(lab: DataFrame, centre, radius_mm: float, spacing, label: int, protect: bool = False, hu: tuple[float, float] | None = None, fixed: str | None = None) -> DataFrame:
    """A ball of `label`, or a disc in the plane of the axis `fixed`; other labels stay if protected, and so do voxels
    whose hu (a column of lab then) is out of the window."""
    ok = _near(centre, radius_mm, spacing, fixed)
    if protect:
        ok = ok & F.col("label").isin(0, label)
    if hu:
        ok = ok & F.col("hu").between(*hu)
    return lab.withColumn("label", F.when(ok, label).otherwise(F.col("label")))


def erased(lab: DataFrame, centre, radius_mm: float, spacing, label: int, every: bool = False, fixed: str | None = None) -> DataFrame:
    """The ball or disc set to 0 where it has `label`, or any label."""
    ok = _near(centre, radius_mm, spacing, fixed)
    if not every:
        ok = ok & (F.col("label") == label)
    return lab.withColumn("label", F.when(ok, 0).otherwise(F.col("label")))


def stroke(start, end, spacing, radius_mm: float) -> list[tuple[int, int, int]]:
    """Centres of the stamps between two voxels, half a radius apart, rounded half up."""
    gap = math.hypot(*((e - s) * m for s, e, m in zip(start, end, spacing, strict=True)))
    n = max(1, math.ceil(gap / max(0.3, radius_mm / 2)))
    return [tuple(math.floor(s + (e - s) * t / n + 0.5) for s, e in zip(start, end, strict=True)) for t in range(1, n + 1)]


def replayed(lab: DataFrame, log: DataFrame, upto: int) -> DataFrame:
    """lab after the edits (vol_id, i, j, k, step, label) up to a step; earlier steps give way to later ones. Undo is a smaller
    step, redo a larger one."""
    last = log.where(F.col("step") <= upto).groupBy(*PLACE).agg(F.max(F.struct("step", "label"))["label"].alias("edited"))
    return lab.join(last, PLACE, "left").select(*PLACE, F.coalesce("edited", "label").alias("label"))


def touched(log: DataFrame) -> DataFrame:
    """(vol_id, step, labels): sorted labels over 0 that a step (old, label) removed or set."""
    both = log.select("vol_id", "step", F.explode(F.array("old", "label")).alias("x")).where("x > 0")
    return both.groupBy("vol_id", "step").agg(F.sort_array(F.collect_set("x")).alias("labels"))


def picked(lab: DataFrame, points: DataFrame) -> DataFrame:
    """points (vol_id, i, j, k, ...) with the columns of the voxels there; null where there is none."""
    return points.join(lab, PLACE, "left")
