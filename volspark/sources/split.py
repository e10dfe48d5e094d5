"""NIfTI and npy files as rows of planes, by a reader that splits a file: no file is one row, and no task reads a whole large one.

The driver only lists files; headers are read by the tasks. Files have to be where pyarrow opens them; for other stores there is
`nifti.files`. A zipped file is one task, which unzips it plane by plane.
"""

from __future__ import annotations

import gzip
import io
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from volspark.sources import nifti

#: A plain file is split into parts of about so many bytes.
PART = 32 << 20
ROWS = "path string, size long, head binary, shape array<int>, at int, raw binary"


@dataclass
class _Part(InputPartition):
    path: str
    size: int
    part: int
    parts: int


def _nifti_layout(head: bytes) -> tuple[int, list[int], int] | None:
    """(first byte, shape, bytes of a plane of the third axis); None where the header does not tell."""
    order = next((o for o in "<>" if len(head) >= 348 and struct.unpack_from(f"{o}i", head)[0] == 348), None)
    if order is None:
        return None
    nx, ny, nz = struct.unpack_from(f"{order}3h", head, 42)
    (kind,), (first,) = struct.unpack_from(f"{order}h", head, 70), struct.unpack_from(f"{order}f", head, 108)
    if kind not in nifti.BYTES or nx < 1 or ny < 1 or not first < 1 << 40:
        return None
    return max(nifti.HEADER, round(first)), [nx, ny, max(nz, 1)], nx * ny * nifti.BYTES[kind]


def _npy_layout(head: bytes) -> tuple[int, list[int], int] | None:
    """The same of an array in C order, in planes of its first axis."""
    from_ = io.BytesIO(head)
    try:
        version = np.lib.format.read_magic(from_)
        shape, fortran, kind = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(from_)
    except ValueError:
        return None
    if fortran or kind.hasobject or not shape:
        return None
    return from_.tell(), [int(n) for n in shape], int(np.prod(shape[1:], dtype=np.int64)) * kind.itemsize


LAYOUTS = {"nifti": (_nifti_layout, nifti.HEADER, 2, (".nii", ".nii.gz")), "npy": (_npy_layout, 4096, 0, (".npy", ".npy.gz"))}


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.kind, self.bytes = options["path"], options.get("kind", "nifti"), int(options.get("partBytes", PART))

    def partitions(self) -> list[_Part]:
        from pyarrow.fs import FileSelector, FileSystem

        fs, root = FileSystem.from_uri(self.path)
        found = [f for f in fs.get_file_info(FileSelector(root, recursive=True)) if f.is_file and f.path.endswith(LAYOUTS[self.kind][3])]
        counts = [1 if f.path.endswith(".gz") else max(1, -(-f.size // self.bytes)) for f in found]
        return [_Part(f.path, f.size, p, n) for f, n in zip(found, counts, strict=True) for p in range(n)]

    def read(self, part: _Part):
        """Planes of one part, and from the first part the file's own row, whose plane is null; a plane that is not whole is left out."""
        from pyarrow.fs import FileSystem

        layout, most, axis, _ = LAYOUTS[self.kind]
        fs, _ = FileSystem.from_uri(self.path)
        with fs.open_input_file(part.path) as raw:
            zipped = raw.read(2) == b"\x1f\x8b"
            raw.seek(0)
            source, size = (gzip.GzipFile(fileobj=raw), None) if zipped else (raw, part.size)
            head, seen, told = b"", 0, None
            try:
                head = source.read(most)
                seen, told = len(head), layout(head)
                if told:
                    first, shape, width = told
                    n = shape[axis]
                    low, high = n * part.part // part.parts, n * (part.part + 1) // part.parts
                    source.seek(first + low * width)
                    for at in range(low, high):
                        content = source.read(width)
                        seen = first + at * width + len(content)
                        if len(content) < width:
                            break
                        yield part.path, size, head, shape, at, content
            except (EOFError, gzip.BadGzipFile, zlib.error):
                pass
            if part.part == 0:
                yield part.path, seen if zipped else size, head, told[1] if told else None, None, None


class PlaneFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volspark_planes"

    def schema(self) -> str:
        return ROWS

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def planes(spark: SparkSession, folder: str, kind: str = "nifti", part_bytes: int = PART) -> DataFrame:
    """(path, size, head, shape, at, raw): a row a plane of each image in a folder and those below, and one a file with a null plane.

    kind: nifti (planes of the third axis) or npy (C order, planes of the first axis; other orders and object arrays have no planes).
    """
    spark.dataSource.register(PlaneFiles)
    return spark.read.format(PlaneFiles.name()).option("kind", kind).option("partBytes", part_bytes).load(folder)


def headers(rows: DataFrame) -> DataFrame:
    """`nifti.headers` of planes' files, a row a file; files cut off within their voxels have the problem `truncated file`."""
    return nifti.headers(rows.where("at is null").select("path", F.col("head").alias("content"), "size"))


def voxels(rows: DataFrame) -> DataFrame:
    """(path, i, j, k, v) of all readable images, as `nifti.voxels` gives them, from planes."""
    bad = headers(rows).where("problem is not null").select("path")
    cut = rows.where("at is not null").join(bad, "path", "left_anti").select("path", F.col("head").alias("content"), "size", F.col("at").alias("k"), "raw")
    return nifti.slice_voxels(nifti.headers(cut, "k", "raw"))


def npy_values(rows: DataFrame, dtype: str) -> DataFrame:
    """(path, i, p, v) of npy planes: the plane, the place in it in C order, and the value; dtype is what the files hold, such as <f4."""

    @F.pandas_udf("array<double>")
    def decoded(raw):
        return raw.map(lambda r: np.frombuffer(r, dtype).astype(float))

    return rows.where("at is not null").select("path", F.col("at").alias("i"), F.posexplode(decoded("raw")).alias("p", "v"))
