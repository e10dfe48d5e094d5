"""Grids: reorientation, interpolation of order 0, 1 and 3, and the choice of spacings."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.operators.labels import PLACE, VOXEL

#: Values added at both ends of a line before the spline filter.
EDGE = 12
POLE = math.sqrt(3.0) - 2.0


def output_shape(shape, zoom) -> tuple[int, ...]:
    """Rounded half to even."""
    return tuple(round(n * z) for n, z in zip(shape, zoom, strict=True))


def taps(n: int, m: int, order: int, grid: bool = False, pad: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(places, weights), both (m, order + 1): where m outputs fall on a line of n inputs that has `pad` more at both ends.

    Ends meet ends; in grid mode cells do. Places beyond the line are its last ones.
    """
    out = np.arange(m, dtype=float)
    if grid:
        at = (out + 0.5) * (n / m) - 0.5
    else:
        at = out * ((n - 1) / (m - 1) if m > 1 else 1.0)
    at = at + pad
    base = np.floor(at + 0.5) if order == 0 else np.floor(at) - order // 2
    place = np.clip(base[:, None].astype(int) + np.arange(order + 1), 0, n + 2 * pad - 1)
    x = at - np.floor(at)
    if order == 0:
        weight = np.ones((m, 1))
    elif order == 1:
        weight = np.stack((1.0 - x, 1.0 - (1.0 - x)), 1)
    else:
        z = 1.0 - x
        own = [z**3 / 6.0, (x * x * (x - 2.0) * 3.0 + 4.0) / 6.0, (z * z * (z - 2.0) * 3.0 + 4.0) / 6.0]
        weight = np.stack((*own, 1.0 - own[0] - own[1] - own[2]), 1)
    return place, weight


def _coefficients(lines: np.ndarray) -> np.ndarray:
    """Cubic B-spline coefficients of lines whose ends are mirrored half a cell out: one pass forward, one back."""
    n = lines.shape[1]
    c = lines * ((1.0 - POLE) * (1.0 - 1.0 / POLE))
    powers = POLE ** np.arange(1, n)
    last = POLE**n
    first = c[:, 0] + last * c[:, -1] + ((c[:, 1:] + last * c[:, -2::-1]) * powers).sum(1)
    c[:, 0] += first * POLE / (1.0 - last * last)
    for i in range(1, n):
        c[:, i] += POLE * c[:, i - 1]
    c[:, -1] *= POLE / (POLE - 1.0)
    for i in range(n - 2, -1, -1):
        c[:, i] = POLE * (c[:, i + 1] - c[:, i])
    return c


def line_values(lines: np.ndarray, m: int, order: int, grid: bool) -> np.ndarray:
    """Lines of n values as lines of m."""
    n = lines.shape[1]
    if grid and n == m:
        return lines
    if order < 3:
        place, weight = taps(n, m, order, grid)
    else:
        lines = _coefficients(np.pad(lines, ((0, 0), (EDGE, EDGE)), mode="edge"))
        place, weight = taps(n, m, 3, grid, EDGE)
    return sum(lines[:, place[:, t]] * weight[:, t] for t in range(place.shape[1]))


def zoomed_axis(vol: DataFrame, axis: str, n: int, m: int, order: int, grid: bool = False) -> DataFrame:
    """vol (vol_id, i, j, k, v) with m places along an axis instead of n; a line that has a voxel is whole, its missing ones are 0.

    Lines are gathered by their place on the other axes, each at most n values, and go through numpy by Arrow batches.
    """
    if grid and n == m:
        return vol.select(*PLACE, "v")
    rest = [c for c in PLACE if c != axis]

    @F.pandas_udf("array<double>")
    def resampled(places: pd.Series, values: pd.Series) -> pd.Series:
        dense = np.zeros((len(places), n))
        rows = np.repeat(np.arange(len(places)), [len(p) for p in places])
        if len(rows):
            dense[rows, np.concatenate(places.to_list()).astype(int)] = np.concatenate(values.to_list())
        return pd.Series(list(line_values(dense, m, order, grid)))

    lines = vol.groupBy(*rest).agg(F.collect_list(F.struct(F.col(axis).alias("p"), F.col("v").cast("double").alias("v"))).alias("c"))
    out = lines.select(*rest, F.posexplode(resampled(F.col("c.p"), F.col("c.v"))).alias(axis, "v"))
    return out.select(*PLACE, "v")


def zoomed(vol: DataFrame, shape, out_shape, order: int, grid: bool = False) -> DataFrame:
    """vol on another grid, one axis after the other; order 0, 1 or 3."""
    if order not in (0, 1, 3):
        raise ValueError("order must be 0, 1 or 3")
    for axis, n, m in zip(VOXEL, shape, out_shape, strict=True):
        vol = zoomed_axis(vol, axis, n, m, order, grid)
    return vol


def zoomed_by_slices(vol: DataFrame, shape, out_shape, axis: int, order: int) -> DataFrame:
    """Each slice across `axis` resized for itself and kept within its own range, then the nearest slices along the axis."""
    name, out = VOXEL[axis], vol
    ends = vol.groupBy("vol_id", name).agg(F.least(F.min("v"), F.when(F.count("*") < math.prod(shape) // shape[axis], 0.0)).alias("lo"), F.greatest(F.max("v"), F.when(F.count("*") < math.prod(shape) // shape[axis], 0.0)).alias("hi"))
    for c, n, m in zip(VOXEL, shape, out_shape, strict=True):
        if c != name:
            out = zoomed_axis(out, c, n, m, order, True)
    out = out.join(ends, ["vol_id", name]).select(*PLACE, F.least(F.greatest("v", "lo"), F.col("hi")).alias("v"))
    n, m = shape[axis], out_shape[axis]
    if n == m:
        return out
    at = np.clip(np.floor(n / m * (np.arange(m) + 0.5) - 0.5 + 0.5), 0, n - 1).astype(int)
    near = vol.sparkSession.createDataFrame([(o, int(a)) for o, a in enumerate(at)], "__o int, __a int")
    moved = out.join(F.broadcast(near), F.col(name) == F.col("__a")).withColumn(name, F.col("__o"))  # one row an output slice
    return moved.select(*PLACE, "v")


def slice_axis(current, new) -> int | None:
    """The axis to resample apart: that of the one greatest spacing, if the current or else the new spacing has a ratio over 3."""
    uneven = next((s for s in (current, new) if max(s) / min(s) > 3.0), None)
    if uneven is None or sum(x == max(uneven) for x in uneven) != 1:
        return None
    return list(uneven).index(max(uneven))


def to_spacing(vol: DataFrame, shape, affine: list[float], spacing, order: int) -> tuple[DataFrame, tuple, list[float]]:
    """(integer voxels, shape, affine) on a grid of `spacing` millimetres; 0 or the present spacing keeps the grid."""
    from volspark.operators.images import truncated, zooms

    have = zooms(affine)
    zoom = [1.0 if not s or s == h else h / s for h, s in zip(have, spacing, strict=True)]
    out_shape = output_shape(shape, zoom)
    out = vol if all(z == 1.0 for z in zoom) else zoomed(vol, shape, out_shape, order)
    moved = [affine[4 * r + c] / zoom[c] if r < 3 and c < 3 else affine[4 * r + c] for r in range(4) for c in range(4)]
    return truncated(out, F.col("v")), out_shape, moved


def model_input(vol: DataFrame, shape, have, want) -> tuple[DataFrame, tuple]:
    """A network's input at its spacing: order 3, slice by slice where the spacing is uneven, within the input's range."""
    from volspark.operators.images import clipped

    out_shape = tuple(round(h / w * n) for h, w, n in zip(have, want, shape, strict=True))
    if out_shape == tuple(shape):
        return vol, out_shape
    axis = slice_axis(have, want)
    out = zoomed(vol, shape, out_shape, 3, True) if axis is None else zoomed_by_slices(vol, shape, out_shape, axis, 3)
    return clipped(out, vol).withColumn("v", F.col("v").cast("float").cast("double")), out_shape


def axis_table(spark: SparkSession, name: str, n_in: int, n_out: int, order: int) -> DataFrame:
    """(o, at, frac): where each output index falls on the input axis; one row an index of one axis."""
    scale = (n_in - 1) / (n_out - 1) if n_out > 1 else 1.0
    at = F.col("o") * F.lit(scale)
    base = F.floor(at + 0.5) if order == 0 else F.floor(at)
    base = F.least(base, F.lit(n_in - 1)) if order == 0 else F.least(base, F.lit(max(n_in - 2, 0)))
    return spark.range(n_out).select(F.col("id").cast("int").alias("o")).select(F.col("o").alias(f"o{name}"), base.cast("int").alias(name), (at - base).alias(f"f{name}"))


def zoomed_nearest(lab: DataFrame, shape, out_shape) -> DataFrame:
    """Labels on another grid; an equi-join with three index tables of one row an output index, one row an output voxel."""
    out = lab
    for c, n, m in zip(VOXEL, shape, out_shape, strict=True):
        out = out.join(F.broadcast(axis_table(lab.sparkSession, c, n, m, 0)), c)
    return out.select("vol_id", F.col("oi").alias("i"), F.col("oj").alias("j"), F.col("ok").alias("k"), "label")


def zoomed_linear(ct: DataFrame, shape, out_shape, grid: bool = False) -> DataFrame:
    """Order 1 of integer voxels (.., hu): every voxel goes to the outputs that it is a tap of, then each output sums its eight taps in their order."""
    out = ct.withColumnsRenamed({c: f"v{c}" for c in VOXEL})
    for c, n, m in zip(VOXEL, shape, out_shape, strict=True):
        place, weight = taps(n, m, 1, grid)
        rows = [(o, int(place[o, t]), float(weight[o, t]), t) for o in range(m) for t in range(2)]
        out = out.join(F.broadcast(ct.sparkSession.createDataFrame(rows, f"o{c} int, v{c} int, w{c} double, t{c} int")), f"v{c}")  # two rows an output index
    tap = F.struct((4 * F.col("ti") + 2 * F.col("tj") + F.col("tk")).alias("t"), (F.col("hu") * F.col("wi") * F.col("wj") * F.col("wk")).alias("p"))
    total = F.aggregate(F.sort_array(F.collect_list(tap)), F.lit(0.0), lambda s, x: s + x["p"])
    return out.groupBy("vol_id", F.col("oi").alias("i"), F.col("oj").alias("j"), F.col("ok").alias("k")).agg(total.alias("v"))


def canonical_plan(shape, affine: list[float]) -> tuple[list[int], list[bool], tuple, list[float]]:
    """(input axis of each output axis, flips of the input axes, shape, affine) that bring a grid nearest to right, front, up.

    Each input axis in turn takes the world axis, of those left, that it leans to most.
    """
    a = np.array(affine, float).reshape(4, 4)
    size = np.sqrt((a[:3, :3] ** 2).sum(0))
    lean = np.abs(a[:3, :3] / np.where(size == 0, 1, size))
    source, flips = [0, 0, 0], [False] * 3
    for axis in range(3):
        to = int(np.argmax(lean[:, axis]))
        if lean[to, axis] < 1e-6:
            raise ValueError("an axis of the affine points nowhere")
        source[to], flips[axis] = axis, bool(a[to, axis] < 0)
        lean[to] = 0
    out = a.copy()
    for axis in range(3):
        if flips[axis]:
            out[:3, 3] += a[:3, axis] * (shape[axis] - 1)
    for to, axis in enumerate(source):
        out[:3, to] = -a[:3, axis] if flips[axis] else a[:3, axis]
    return source, flips, tuple(shape[s] for s in source), out.ravel().tolist()


def reoriented(vol: DataFrame, shape, source: list[int], flips: list[bool]) -> DataFrame:
    """Voxels with permuted and flipped indices; three expressions, no shuffle."""
    old = [F.col(c) if not f else n - 1 - F.col(c) for c, n, f in zip(VOXEL, shape, flips, strict=True)]
    return vol.withColumns({c: old[s] for c, s in zip(VOXEL, source, strict=True)})
