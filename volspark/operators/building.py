"""Volumes from image slices (series_uid, file, localizer, nrows, ncols, ipp, iop, gap, thickness, instance, raw, bits_allocated, bits_stored, signed, slope, intercept).

ipp: place of the first pixel, null if unknown; iop: direction of rows and of columns, six numbers; gap: millimetres between rows and
between columns; raw: little-endian pixel words, row after row. Files are in the order of their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.functions.numeric import f32
from volspark.operators.graph import shared
from volspark.operators.labels import spread
from volspark.operators.series import usable_slices

#: Orientations differ from here, gaps are uneven beyond this share of their mean and this much, a stack is tilted beyond this angle.
TURNED, UNEVEN, TILT = 1e-4, (0.05, 1e-3), 0.5 * 3.14159265358979 / 180


def _dot(a, b) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def placed(slices: DataFrame) -> DataFrame:
    """The slices that each series' volume is built from, without their pixels, with k, their place in the stack, rows, columns and normal of
    the series' first file, and what the checks need. Sorted along the normal where all have a place, else by instance; ties by file.

    A series is one group, of as many rows as its scan has images.
    """
    # a task sorts its series several times over, so its memory goes with its rows
    own = usable_slices(spread(slices.drop("raw"), slices.count(), "series_uid")).where("used")
    every = Window.partitionBy("series_uid")
    size = F.count("*").over(every)
    own = own.withColumns({"n": size, "n_others": F.col("total") - size, "have": F.count("ipp").over(every) == size, "first": F.min(F.struct("file", "iop")).over(every)["iop"]})
    r, c = [F.col("first")[x] for x in range(3)], [F.col("first")[x] for x in range(3, 6)]
    # 0.0 is added so that a zero has no sign of its own: which of its two products was negative is of no meaning, and SQL drops it too
    normal = F.array(*[r[x] * c[y] - r[y] * c[x] + F.lit(0.0) for x, y in ((1, 2), (2, 0), (0, 1))])
    own = own.withColumn("normal", normal).withColumn("pos", _dot(F.col("ipp"), F.col("normal")))
    own = own.withColumn("turned", F.greatest(*[F.abs(F.col("iop")[x] - F.col("first")[x]) for x in range(6)]) > TURNED)
    order = every.orderBy(F.when(F.col("have"), F.col("pos")).otherwise(F.col("instance")), "file")
    own = own.withColumn("k", (F.row_number().over(order) - 1).cast("int")).withColumn("before", F.lag("ipp").over(order))
    return own.withColumn("d", F.when(F.col("have"), sum((F.col("ipp")[x] - F.col("before")[x]) * F.col("normal")[x] for x in range(3))))


def volume_grids(slices: DataFrame) -> DataFrame:
    """(vol_id, nx, ny, nz, affine, problem, warnings) of every series: columns, rows, slices, and the affine to right, front, up in single
    precision. problem: why no volume can be built; its affine is null then. A series without usable slices has no images of its own size.
    """
    own = placed(slices)
    at = lambda c, last=False: F.max_by(c, F.when(F.col("k") == (F.col("n") - 1 if last else 0), 1))
    g = own.groupBy("series_uid").agg(
        F.first("n").alias("n"), F.first("n_others").alias("n_others"), F.first("have").alias("have"), F.first("normal").alias("normal"), F.first("first").alias("first"), F.max("turned").alias("turned"), F.min("d").alias("dmin"), F.max("d").alias("dmax"), F.sum("d").alias("dsum"),
        at("ipp").alias("lo"), at("ipp", True).alias("hi"), at("gap").alias("gap"), at("thickness").alias("thickness"), F.first("nrows").alias("ny"), F.first("ncols").alias("nx"),
    )
    alone = slices.groupBy("series_uid").agg(F.count("*").alias("files"))
    g = alone.join(g, "series_uid", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    thick = F.when(F.col("thickness") > 0, F.col("thickness")).otherwise(1.0)
    step = [F.when(F.col("have"), (F.col("hi")[x] - F.col("lo")[x]) / (F.col("n") - 1).cast("double")).otherwise(F.col("normal")[x] * thick) for x in range(3)]
    problem = F.when(F.col("n") < 2, "fewer than 2 slices").when(F.col("turned"), "slices with different orientations").when(F.col("have") & (F.col("dmin") <= 0), "duplicate slice positions")
    g = shared(g.withColumn("problem", problem).withColumn("step", F.when(F.col("problem").isNull(), F.array(*step))))
    along = F.sqrt(_dot(F.col("step"), F.col("step")))
    lean = F.when(along > 0, F.abs(_dot(F.col("step"), F.col("normal"))) / along).otherwise(1.0)
    mean = F.col("dsum") / (F.col("n") - 1)
    origin = lambda x: F.coalesce(F.col("lo")[x], F.lit(0.0))
    rows = [(F.col("first")[x] * F.col("gap")[1], F.col("first")[3 + x] * F.col("gap")[0], F.col("step")[x], origin(x)) for x in range(3)]
    cells = [f32(-c if x < 2 else c) for x, r in enumerate(rows) for c in r]
    said = F.array_compact(F.array(
        F.when(F.coalesce("n_others", "files") > 0, F.concat(F.coalesce("n_others", "files").cast("string"), F.lit(" localizers or images of other sizes ignored"))),
        F.when(~F.col("have"), "no positions, sorted by instance"),
        F.when(F.col("have") & (F.col("dmax") - F.col("dmin") > UNEVEN[0] * F.abs(mean) + UNEVEN[1]), "uneven gaps"),
        F.when(F.col("have") & (lean < math.cos(TILT)), "tilted stack"),
        F.when(~F.col("have"), "gap taken from the slice thickness"),
    ))
    affine = F.when(F.col("problem").isNull(), F.array(*cells, *map(F.lit, (0.0, 0.0, 0.0, 1.0))))
    return g.select(F.col("series_uid").alias("vol_id"), "nx", "ny", F.col("n").cast("int").alias("nz"), affine.alias("affine"), "problem", said.alias("warnings"))


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def _values(raw: pa.Array, bits: pa.Array, size: pa.Array, top: pa.Array, slope: pa.Array, intercept: pa.Array) -> pa.Array:
    """Each image's words below `size`, those from `top` on less `size`, times slope plus intercept, in single precision. All images of a batch at once."""
    bits = bits.to_numpy(zero_copy_only=False)
    count = pc.binary_length(raw).to_numpy(zero_copy_only=False) * 8 // bits
    starts = np.cumsum(count) - count
    words = np.empty(int(count.sum()), np.int64)
    for b in np.unique(bits):
        rows = bits == b
        own = np.frombuffer(b"".join(raw.filter(pa.array(rows)).to_pylist()), f"<u{b // 8}").astype(np.int64)
        if rows.all():
            words = own
        else:
            words[np.repeat((starts - np.cumsum(count * rows) + count)[rows], count[rows]) + np.arange(len(own))] = own
    each = lambda x: np.repeat(x.to_numpy(zero_copy_only=False), count)
    size = each(size)
    words &= size - 1
    words -= np.where(words >= each(top), size, 0)
    with np.errstate(over="ignore"):
        v = (words.astype(float) * each(slope) + each(intercept)).astype(np.float32).astype(float)
    unknown = pc.or_(slope.is_null(), intercept.is_null())
    v = pa.array(v, mask=each(unknown) if pc.any(unknown).as_py() else None)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), v)


def pixels(slices: DataFrame, *keep: str) -> DataFrame:
    """(series_uid, file, i, j, v, keep..) of every slice: columns, rows and stored words masked to their bits, with their sign, times slope plus
    intercept, in single precision. 8- and 32-bit words are whole; a word count that is not rows by columns is an error."""
    count = F.col("nrows") * F.col("ncols") * (F.col("bits_allocated") / 8)
    raw = F.when(F.octet_length("raw") == count, F.col("raw")).otherwise(F.raise_error(F.concat(F.lit("short pixel data: "), F.col("file"))).cast("binary"))
    own = slices.withColumn("bits", F.when(F.col("bits_allocated") == 16, F.least("bits_stored", F.lit(16))).otherwise(F.col("bits_allocated")))
    top = F.when(F.col("signed"), F.expr("shiftleft(1L, bits - 1)")).otherwise(F.lit((1 << 63) - 1))
    v = _values(raw, "bits_allocated", F.expr("shiftleft(1L, bits)"), top, F.col("slope").cast("double"), F.col("intercept").cast("double"))
    cells = own.select("series_uid", "file", "ncols", *keep, F.posexplode(v).alias("p", "v"))
    i, j = (F.col("p") % F.col("ncols")).cast("int"), F.floor(F.col("p") / F.col("ncols")).cast("int")
    return cells.select("series_uid", "file", i.alias("i"), j.alias("j"), "v", *keep)


def built(slices: DataFrame, grids: DataFrame) -> DataFrame:
    """(vol_id, i, j, k, v): the voxels of the series that can be built (volume_grids): i along a row, j down the rows, k up the stack.

    Headers decide which file is which slice; a file then takes its place in the stack, one row a file, before its pixels are unpacked.
    """
    ok = grids.where("problem is null").select(F.col("vol_id").alias("series_uid"))
    stack = placed(slices).join(ok, "series_uid", "left_semi").select("series_uid", "file", "k")
    return pixels(slices.join(stack, ["series_uid", "file"]), "k").select(F.col("series_uid").alias("vol_id"), "i", "j", "k", "v")
