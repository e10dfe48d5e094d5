"""From class scores to labels, and the stages of a segmentation task over many volumes at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.functions.numeric import half
from volspark.operators import geometry, labels
from volspark.operators.graph import shared
from volspark.operators.labels import PLACE, VOXEL
from volspark.operators.planning import CROP, MARGIN_MM, Plan
from volspark.operators.tiles import best_class

#: Millimetres of the rough pass.
ROUGH_MM = 6.0
#: A model: (voxels, grids) -> labels on the same grids.
Model = Callable[[DataFrame, DataFrame], DataFrame]


def unpadded(scores: DataFrame, plan: DataFrame, patch: tuple[int, int, int]) -> DataFrame:
    """scores (vol_id, i, j, k, ..) of grids that were padded to a patch, counted from the content's corner; the padding goes."""
    extra = [F.greatest(F.lit(p) - F.col(n), F.lit(0)) for p, n in zip(patch, geometry.SIDES, strict=True)]
    padded = plan.select("vol_id", *geometry.SIDES, *[F.floor(e / 2).cast("int").alias(f"__{c}") for e, c in zip(extra, VOXEL, strict=True)])
    moved = padded.withColumns({n: F.col(n) + e for n, e in zip(geometry.SIDES, extra, strict=True)})  # the padded grid
    own = geometry.on_grid(scores, moved, *geometry.SIDES, *[f"__{c}" for c in VOXEL])
    out = own.withColumns({c: F.col(c) - F.col(f"__{c}") for c in VOXEL}).drop(*geometry.SIDES, *[f"__{c}" for c in VOXEL])
    return geometry.on_grid(out, plan)


def finished(scores: DataFrame, plan: DataFrame, have: tuple[float, float, float]) -> DataFrame:
    """(vol_id, i, j, k, label) in each whole volume, from scores (vol_id, i, j, k, class, logit) on the grids of a model of spacing `have`.

    plan (vol_id, nx, ny, nz, mx, my, mz, affine, lo_i, lo_j, lo_k): the model's grid, the cropped image's grid and affine, and the crop's
    corner. Each class is resized by order 1 in grid mode, slice by slice where a spacing is uneven, kept within its own range in
    the volume and rounded to half precision; the first class of the greatest score wins and goes to its place.
    """
    scores = scores.select(*PLACE, "class", F.col("logit").cast("double").alias("v"))
    axes = geometry.slice_axis([F.lit(float(h)) for h in have], geometry.zooms(F.col("affine")))
    out = geometry.resized(scores, plan, 1, axes, ("class",))
    ends = geometry.ranges(scores, plan, "class")
    kept = geometry._within(out, ends, ["vol_id", "class"])
    best = best_class(kept.select(*PLACE, "class", half(F.col("v")).alias("logit")))
    boxes = plan.select("vol_id", *[F.col(m).alias(n) for m, n in zip(geometry.OUT, geometry.SIDES, strict=True)], *[f"lo_{c}" for c in VOXEL])
    return geometry.uncropped(best, boxes)


def run(vox: DataFrame, grids: DataFrame, plan: Plan, models: dict[int, Model], mapping: DataFrame, crop_labels: list[int], keep: list[int], order: int = 1) -> DataFrame:
    """(vol_id, i, j, k, label): the labels over 0 that a task finds in volumes (vol_id, i, j, k, v) on grids.

    With a region to crop to, the crop model sees every volume at 6 mm; the box of `crop_labels` in its map, with a margin of 20 mm,
    is what the task's models see, at the task's spacing, each volume its own. A volume without such a label has no box
    and an empty map. The models' labels become the task's by mapping (part, label, task_label), later models win; a task of one
    model keeps its labels. The map goes back to the volume's grid; with `keep`, other labels are dropped.
    """
    if plan.crop:
        rough, rough_grids = geometry.to_spacing(vox, grids, (ROUGH_MM,) * 3, order)
        found = geometry.labels_back(models[CROP](rough, rough_grids), rough_grids, grids)
        parts = shared(geometry.crop_grids(found.where(F.col("label").isin(crop_labels)), grids, MARGIN_MM))
    else:
        parts = grids.withColumns({f"lo_{c}": F.lit(0) for c in VOXEL})
    inside = geometry.cropped(vox, grids, parts).withColumn("v", F.col("v").cast("int"))
    fine, fine_grids = geometry.to_spacing(inside, parts, plan.spacing, order)
    fine = shared(fine)
    seen = [models[m](fine, fine_grids).select(*PLACE, F.lit(n).alias("rank"), F.lit(m).alias("model"), "label") for n, m in enumerate(plan.models)]
    merged = seen[0].select(*PLACE, "label")
    if len(seen) > 1:
        ranks = F.create_map(*[x for n, m in enumerate(plan.models) for x in (F.lit(m), F.lit(n))])
        ranked = mapping.select(F.element_at(ranks, F.col("part")).alias("part"), "label", "task_label").where("part is not null")
        every = seen[0]
        for s in seen[1:]:
            every = every.unionByName(s)
        merged = labels.overlay(every.select(*PLACE, F.col("rank").alias("part"), "label"), ranked)
    back = geometry.labels_back(merged.where("label > 0"), fine_grids, parts)
    out = geometry.uncropped(back, parts)
    return out.where(F.col("label").isin(keep)) if keep else out
