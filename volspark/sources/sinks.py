"""Volumes, meshes and records as files. A file is a table of pieces (file, part, at, content); a data source writer puts
them together, so no task ever holds more of a file than one piece."""

from __future__ import annotations

import gzip
import io
import uuid
from contextlib import closing
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from volspark.operators import mesh
from volspark.sources.nifti import header_bytes

SIZES = {"i": "nx", "j": "ny", "k": "nz"}
PIECE = "file string, part int, at long, content binary"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class _Writer(DataSourceWriter):
    """Every attempt of a task writes under names of its own; the commit moves the files of the attempts that count."""

    def __init__(self, path: str, replace: bool):
        self.path, self.replace, self.temp = path, replace, f"_writing_{uuid.uuid4().hex}"

    def _place(self):
        from pyarrow.fs import FileSystem

        fs, root = FileSystem.from_uri(self.path)
        return fs, root.rstrip("/")

    def write(self, rows) -> Written:
        fs, root = self._place()
        own, done, now, out = f"{root}/{self.temp}/{uuid.uuid4().hex}", {}, None, None
        fs.create_dir(own, recursive=True)
        try:
            for row in rows:
                if row.file != now:
                    if out is not None:
                        out.close()
                    if row.file in done or not row.file or ".." in row.file.split("/") or row.file.startswith("/"):
                        raise ValueError(f"pieces out of order or a bad file name: {row.file!r}")
                    now, done[row.file] = row.file, f"{own}/{len(done)}"
                    out = _stream(fs.open_output_stream(done[now]), now)
                if row.content:
                    out.write(row.content)
        finally:
            if out is not None:
                out.close()
        return Written(list(done.items()))

    def commit(self, messages) -> None:
        fs, root = self._place()
        moves = [m for message in messages if message is not None for m in message.files]
        names = [name for name, _ in moves]
        there = [f.path for f in fs.get_file_info([f"{root}/{n}" for n in names]) if f.type.value] if names and not self.replace else []
        if there or len(set(names)) < len(names):
            self.abort(messages)
            raise FileExistsError(f"{there[0] if there else 'one file'} would be written twice")
        for name, temp in moves:
            fs.create_dir(f"{root}/{name}".rsplit("/", 1)[0], recursive=True)
            fs.move(temp, f"{root}/{name}")
        self.abort(messages)

    def abort(self, messages) -> None:
        from pyarrow.fs import FileType

        fs, root = self._place()
        if fs.get_file_info(f"{root}/{self.temp}").type != FileType.NotFound:
            fs.delete_dir(f"{root}/{self.temp}")


def _stream(raw, name: str):
    """raw, or one that zips what it is given; the time stamp is 0, so equal rows make equal files."""
    if not name.endswith(".gz"):
        return raw
    inner = gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0)
    close = inner.close

    def both():
        with closing(raw):
            close()

    inner.close = both
    return inner


class PieceFiles(DataSource):
    """`df.write.format("volspark_files").mode("append").save(folder)`; names that end in .gz are zipped.

    Rows have to come file by file in order (`save` sees to that). Mode overwrite replaces files of the same names, append
    refuses them. A job that fails leaves no file.
    """

    @classmethod
    def name(cls) -> str:
        return "volspark_files"

    def schema(self) -> str:
        return PIECE

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], overwrite)


def save(pieces: DataFrame, folder: str, replace: bool = False) -> None:
    """The files of pieces in a folder that all executors see (any address that pyarrow opens)."""
    pieces.sparkSession.dataSource.register(PieceFiles)
    rows = pieces.select("file", F.col("part").cast("int").alias("part"), F.col("at").cast("long").alias("at"), "content")
    rows = rows.repartition("file").sortWithinPartitions("file", "part", "at")
    rows.write.format(PieceFiles.name()).mode("overwrite" if replace else "append").save(folder)


def planes(cells: DataFrame, grids: DataFrame, value: str, axes: str, kind: str) -> DataFrame:
    """(vol_id, at, content): the bytes of each plane of each volume in grids (vol_id, nx, ny, nz).

    axes: the plane's axis, its slow and its fast axis, as "kji". Missing voxels are 0; a value that the numpy type `kind` cannot hold is an error. What is gathered
    at once are the voxels of one plane.
    """
    plane, slow, fast = axes

    @F.pandas_udf("binary")
    def packed(n_slow: pd.Series, n_fast: pd.Series, a: pd.Series, b: pd.Series, v: pd.Series) -> pd.Series:
        out, whole = [], np.dtype(kind).kind in "iu"
        for rows, width, p, q, x in zip(n_slow, n_fast, a, b, v, strict=True):
            grid = np.zeros((rows, width), kind)
            if p is not None and len(p):
                x = np.asarray(x)
                if whole and (x.min() < np.iinfo(kind).min or x.max() > np.iinfo(kind).max):
                    raise ValueError(f"a value does not fit {kind}")
                grid[np.asarray(p, int), np.asarray(q, int)] = x
            out.append(grid.tobytes())
        return pd.Series(out)

    held = cells.where(F.col(value) != 0).groupBy("vol_id", plane).agg(F.collect_list(F.struct(F.col(slow).alias("a"), F.col(fast).alias("b"), F.col(value).alias("v"))).alias("c"))
    every = grids.select("vol_id", "nx", "ny", "nz", F.explode(F.sequence(F.lit(0), F.col(SIZES[plane]) - 1)).alias(plane))
    return every.join(held, ["vol_id", plane], "left").select("vol_id", F.col(plane).cast("long").alias("at"), packed(SIZES[slow], SIZES[fast], "c.a", "c.b", "c.v").alias("content"))


def _pieces(file: Column, head: DataFrame, body: DataFrame) -> DataFrame:
    """Pieces of files with a head (.., content) and a body (.., at, content)."""
    first = head.select(file.alias("file"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), "content")
    return first.unionByName(body.select(file.alias("file"), F.lit(1).alias("part"), "at", "content"))


def nifti_pieces(cells: DataFrame, grids: DataFrame, value: str = "label", kind: str = "u1", file: Column | None = None) -> DataFrame:
    """Images of bytes (kind u1) or short integers (i2) of volumes (vol_id, i, j, k, value) on grids (vol_id, nx, ny, nz, affine)."""
    code = {"u1": 2, "i2": 4}[kind]

    @F.pandas_udf("binary")
    def head(nx: pd.Series, ny: pd.Series, nz: pd.Series, affine: pd.Series) -> pd.Series:
        return pd.Series([header_bytes((int(x), int(y), int(z)), list(a), code) for x, y, z, a in zip(nx, ny, nz, affine, strict=True)])

    file = F.concat(F.col("vol_id").cast("string"), F.lit(".nii.gz")) if file is None else file
    return _pieces(file, grids.select("vol_id", head("nx", "ny", "nz", "affine").alias("content")), planes(cells, grids, value, "kji", f"<{kind}"))


def npy_pieces(cells: DataFrame, grids: DataFrame, value: str, kind: str, file: Column | None = None) -> DataFrame:
    """npy files in C order of volumes on grids (vol_id, nx, ny, nz); kind is a numpy type such as <f4."""

    @F.pandas_udf("binary")
    def head(nx: pd.Series, ny: pd.Series, nz: pd.Series) -> pd.Series:
        out = []
        for shape in zip(nx, ny, nz, strict=True):
            to = io.BytesIO()
            np.lib.format.write_array_header_1_0(to, {"descr": np.dtype(kind).str, "fortran_order": False, "shape": tuple(int(n) for n in shape)})
            out.append(to.getvalue())
        return pd.Series(out)

    file = F.concat(F.col("vol_id").cast("string"), F.lit(".npy")) if file is None else file
    return _pieces(file, grids.select("vol_id", head("nx", "ny", "nz").alias("content")), planes(cells, grids, value, "ijk", kind))


def stl_pieces(tri: DataFrame, ver: DataFrame, title: str = "surface, RAS mm") -> DataFrame:
    """Binary STL files <mesh_id>.stl: an 80-byte head, the count, and 50 bytes a triangle in the order of tid."""

    @F.pandas_udf("binary")
    def facet(normal: pd.Series, points: pd.Series) -> pd.Series:
        out = np.zeros(len(normal), np.dtype([("x", "<f4", 12), ("attribute", "<u2")]))
        if len(normal):
            out["x"] = np.hstack([np.stack(normal.to_list()), np.stack(points.to_list())])
        return pd.Series([row.tobytes() for row in out])

    start = title.encode()[:80].ljust(80, b"\0")

    @F.pandas_udf("binary")
    def head(n: pd.Series) -> pd.Series:
        return n.map(lambda count: start + np.uint32(count).tobytes())

    file = F.concat(F.col("mesh_id").cast("string"), F.lit(".stl"))
    counts = tri.groupBy("mesh_id").agg(F.count("*").alias("n"))
    return _pieces(file, counts.select("mesh_id", head("n").alias("content")), mesh.stl(tri, ver).select("mesh_id", F.col("tid").cast("long").alias("at"), facet("normal", "points").alias("content")))


def obj_lines(tri: DataFrame, ver: DataFrame) -> DataFrame:
    """(mesh_id, part, at, line): vertices, vertex normals and faces of OBJ files. Vertices are numbered from 1 in the order of vid."""
    place = F.row_number().over(Window.partitionBy("mesh_id").orderBy("vid")).cast("long")
    ver = ver.select("mesh_id", "vid", "x", "y", "z", place.alias("at"))
    normals = mesh.normals(tri, ver).join(ver.select("mesh_id", "vid", "at"), ["mesh_id", "vid"])
    faces = tri.select("mesh_id", F.col("tid").cast("long").alias("at"), "a", "b", "c")
    for p in "abc":
        faces = faces.join(ver.select("mesh_id", F.col("vid").alias(p), F.col("at").alias(f"{p}_")), ["mesh_id", p])
    parts = [
        ver.select("mesh_id").distinct().select("mesh_id", F.lit(0), F.lit(0).cast("long"), F.lit("# surface, RAS mm")),
        ver.select("mesh_id", F.lit(1), "at", F.format_string("v %.4f %.4f %.4f", "x", "y", "z")),
        normals.select("mesh_id", F.lit(2), "at", F.format_string("vn %.4f %.4f %.4f", "nx", "ny", "nz")),
        faces.select("mesh_id", F.lit(3), "at", F.format_string("f %d//%d %d//%d %d//%d", *[f"{p}_" for p in "aabbcc"])),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.toDF("mesh_id", "part", "at", "line")


def obj_pieces(tri: DataFrame, ver: DataFrame) -> DataFrame:
    """OBJ files <mesh_id>.obj with normals."""
    return obj_lines(tri, ver).select(F.concat(F.col("mesh_id").cast("string"), F.lit(".obj")).alias("file"), "part", "at", F.concat("line", F.lit("\n")).cast("binary").alias("content"))


def run_records(runs: DataFrame) -> DataFrame:
    """(file, json): a record for each case and task of runs (environment, path, case_id, task, rep, secs, hash), its runs by repetition."""
    entry = F.struct("rep", F.col("secs").alias("seconds"), F.col("path").alias("backend"), "hash")
    name = F.format_string("%s/%d__%d.json", "environment", "case_id", "task")
    record = F.struct(F.col("case_id").alias("case"), "task", F.size("runs").alias("n_runs"), "runs")
    return runs.groupBy("environment", "case_id", "task").agg(F.sort_array(F.collect_list(entry)).alias("runs")).select(name.alias("file"), F.to_json(record).alias("json"))


def text_pieces(records: DataFrame, text: str = "json") -> DataFrame:
    """Files (file, text) of one piece each."""
    return records.select("file", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.col(text).cast("binary").alias("content"))
