"""NIfTI-1 images as tables: a header a file, a row a voxel, and back."""

from __future__ import annotations

import gzip
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.functions.numeric import real, signed, uint
from volspark.operators.labels import place_of

#: Bytes of a voxel of each scalar type, and its numpy name.
BYTES = {2: 1, 4: 2, 8: 4, 16: 4, 64: 8, 256: 1, 512: 2, 768: 4}
KINDS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
HEADER = 352


@F.pandas_udf(T.BinaryType())
def _unzipped(raw: pd.Series) -> pd.Series:
    return raw.map(gzip.decompress)


def files(spark: SparkSession, folder: str, glob: str = "*.nii*") -> DataFrame:
    """(path, content) of the images in a folder and those below; zipped ones unzipped."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder).select("path", "content")
    zipped = F.hex(F.substring("content", 1, 2)) == "1F8B"
    return found.where(~zipped).union(found.where(zipped).select("path", _unzipped("content").alias("content")))


def headers(found: DataFrame, *keep: str) -> DataFrame:
    """(path, content, nx, ny, nz, datatype, big, offset, slope, inter, affine, problem, keep) of files (path, content).

    With a column size, content may be the header alone and size tells the file's bytes (null: not known).

    Either byte order; a fourth axis is read at its first place. The affine is the sform, else the qform's rotation, else the
    voxel sizes. A slope of 0 is no scaling. Files that cannot be read keep a row that says why.
    """
    raw = F.col("content")
    long_ = F.octet_length(raw) >= 348
    little, big = uint(raw, 0, 4) == 348, uint(raw, 0, 4, F.lit(True)) == 348
    h = found.withColumn("big", F.when(long_ & big, True).when(long_ & little, False))
    b = F.col("big")
    i16 = lambda at: signed(uint(raw, at, 2, b), 16)
    f32 = lambda at: real(uint(raw, at, 4, b))
    h = h.withColumns({
        "nx": i16(42).cast("int"), "ny": i16(44).cast("int"), "nz": F.greatest(i16(46), F.lit(1)).cast("int"), "datatype": i16(70).cast("int"),
        "__pix": F.array(f32(80), f32(84), f32(88)), "__fac": F.when(f32(76) < 0, -1.0).otherwise(1.0), "offset": F.greatest(F.lit(float(HEADER)), F.rint(f32(108))).cast("int"),
        "slope": f32(112), "inter": f32(116), "__q": i16(252), "__s": i16(254), "__srow": F.array(*[f32(280 + 4 * n) for n in range(12)]), "__quat": F.array(*[f32(256 + 4 * n) for n in range(6)]),
    })
    h = h.withColumn("__a", F.sqrt(F.greatest(F.lit(0.0), 1.0 - F.col("__quat")[0] * F.col("__quat")[0] - F.col("__quat")[1] * F.col("__quat")[1] - F.col("__quat")[2] * F.col("__quat")[2])))
    q = _rotation(F.col("__a"), *(F.col("__quat")[n] for n in range(3)))
    size = [F.col("__pix")[0], F.col("__pix")[1], F.col("__pix")[2] * F.col("__fac")]
    qrow = [x for r in range(3) for x in (*(q[3 * r + c] * size[c] for c in range(3)), F.col("__quat")[3 + r])]
    zero = F.lit(0.0)
    plain = [F.col("__pix")[r] if r == c else zero for r in range(3) for c in range(4)]
    affine = F.when(F.col("__s") > 0, F.col("__srow")).when(F.col("__q") > 0, F.array(*qrow)).otherwise(F.array(*plain))
    width = F.coalesce(*[F.when(F.col("datatype") == t, F.lit(n)) for t, n in BYTES.items()])
    need = F.col("offset") + F.col("nx").cast("long") * F.col("ny") * F.col("nz") * width
    have = F.col("size") if "size" in found.columns else F.octet_length("content")
    problem = (
        F.when(F.col("big").isNull(), "not a NIfTI-1 file").when(width.isNull(), "unsupported scalar type")
        .when((F.col("nx") < 1) | (F.col("ny") < 1), "no voxels").when(have < need, "truncated file")
    )
    scale = F.when(F.col("slope") == 0, 1.0).otherwise(F.col("slope"))
    inter = F.when(F.col("slope") == 0, 0.0).otherwise(F.col("inter"))
    return h.select("path", "content", "nx", "ny", "nz", "datatype", "big", "offset", scale.alias("slope"), inter.alias("inter"), F.concat(affine, F.array(zero, zero, zero, F.lit(1.0))).alias("affine"), problem.alias("problem"), *keep)


def _rotation(a: Column, b: Column, c: Column, d: Column) -> list[Column]:
    """Rows of the rotation of a unit quaternion."""
    return [
        a * a + b * b - c * c - d * d, 2 * (b * c - a * d), 2 * (b * d + a * c),
        2 * (b * c + a * d), a * a + c * c - b * b - d * d, 2 * (c * d - a * b),
        2 * (b * d - a * c), 2 * (c * d + a * b), a * a + d * d - b * b - c * c,
    ]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _decoded(raw: pd.Series, datatype: pd.Series, big: pd.Series) -> pd.Series:
    return pd.Series([np.frombuffer(r, np.dtype(KINDS[t]).newbyteorder(">" if b else "<")).astype(float) for r, t, b in zip(raw, datatype, big, strict=True)])


def voxels(heads: DataFrame) -> DataFrame:
    """(path, i, j, k, v) of all readable images: stored value times slope plus intercept, in double precision.

    A file is cut into its slices first, so that what is decoded at once is one slice.
    """
    width = F.coalesce(*[F.when(F.col("datatype") == t, F.lit(n)) for t, n in BYTES.items()])
    size = F.col("nx") * F.col("ny") * width
    slices = heads.where("problem is null").withColumn("k", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)))
    cut = slices.select("path", "nx", "slope", "inter", "datatype", "big", "k", F.substring(F.col("content"), F.col("offset") + F.col("k") * size + 1, size).alias("raw"))
    return slice_voxels(cut)


def slice_voxels(cut: DataFrame) -> DataFrame:
    """(path, i, j, k, v) of slices (path, nx, slope, inter, datatype, big, k, raw)."""
    cells = cut.select("path", "nx", "slope", "inter", "k", F.posexplode(_decoded("raw", "datatype", "big")).alias("p", "x"))
    return cells.select("path", (F.col("p") % F.col("nx")).alias("i"), F.floor(F.col("p") / F.col("nx")).cast("int").alias("j"), "k", (F.col("x") * F.col("slope") + F.col("inter")).alias("v"))


def canonical(heads: DataFrame) -> DataFrame:
    """(path, nx, ny, nz, affine): readable images' grids, what a catalogue of volumes keeps of them."""
    return heads.where("problem is null").select("path", "nx", "ny", "nz", "affine")


def bad_files(heads: DataFrame) -> DataFrame:
    """(problem, n, example): what could not be read."""
    return heads.where("problem is not null").groupBy("problem").agg(F.count("*").alias("n"), F.min("path").alias("example"))


def header_bytes(shape, affine: list[float], code: int = 2) -> bytes:
    """The header of an image with an sform in millimetres; code: the scalar type, unsigned bytes by default."""
    from volspark.operators.images import zooms

    head = bytearray(HEADER)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, 8 * BYTES[code])
    struct.pack_into("<4f", head, 76, 1.0, *zooms(affine))
    struct.pack_into("<3f", head, 108, float(HEADER), 1.0, 0.0)
    head[123] = 10  # fixed value: millimetres and seconds
    struct.pack_into("<2h", head, 252, 0, 1)
    struct.pack_into("<12f", head, 280, *affine[:12])
    head[344:348] = b"n+1\0"
    return bytes(head)


def written(lab: DataFrame, shape, affine: list[float]) -> DataFrame:
    """(vol_id, content): an image of unsigned bytes of each label map, first axis fastest; missing voxels are 0. One volume's
    labels over 0 are gathered in one row."""
    head, (nx, ny, nz) = header_bytes(shape, affine), shape

    @F.pandas_udf("binary")
    def packed(places: pd.Series, values: pd.Series) -> pd.Series:
        out = []
        for p, v in zip(places, values, strict=True):
            grid = np.zeros(nx * ny * nz, np.uint8)
            grid[np.asarray(p, int)] = v
            out.append(head + grid.reshape(shape).tobytes(order="F"))
        return pd.Series(out)

    cells = lab.groupBy("vol_id").agg(F.collect_list(F.when(F.col("label") > 0, F.struct(place_of(shape).alias("p"), "label"))).alias("c"))
    return cells.select("vol_id", packed(F.col("c.p"), F.col("c.label")).alias("content"))
