"""The reader that splits files: any split gives the voxels of the reader that takes a file whole."""

import gzip
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.sources import nifti, split


def image(a, kind="<i2", code=4, slope=1.0, inter=0.0, offset=352):
    order, head = kind[0], bytearray(offset)
    struct.pack_into(f"{order}i", head, 0, 348)
    struct.pack_into(f"{order}8h", head, 40, 3, *a.shape, 1, 1, 1, 1)
    struct.pack_into(f"{order}h", head, 70, code)
    struct.pack_into(f"{order}4f", head, 76, 1.0, 0.5, 0.5, 2.0)
    struct.pack_into(f"{order}3f", head, 108, float(offset), slope, inter)
    return bytes(head) + a.astype(kind).tobytes(order="F")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    out, rng = tmp_path_factory.mktemp("images"), np.random.default_rng(2)
    a, b = rng.integers(-1000, 1000, (5, 4, 9)), rng.integers(0, 99, (3, 7, 4))
    whole = image(b, ">f4", 16, 2.0, -1.0, offset=400)
    files = {"a.nii": image(a), "b.nii": whole, "d/c.nii.gz": gzip.compress(image(b)), "short.nii": image(a)[:-1], "short.nii.gz": gzip.compress(image(b))[:-30], "less.nii.gz": gzip.compress(image(b)[:-2]), "none.nii": b"text", "empty.nii": b"", "kind.nii": image(b, "<i2", 128)}
    (out / "d").mkdir()
    for name, content in files.items():
        (out / name).write_bytes(content)
    return str(out), {"a.nii": a, "b.nii": 2.0 * b - 1, "c.nii.gz": b}


@pytest.mark.parametrize("part", [40, 100, 1 << 20])
def test_nifti_split_anywhere(spark, folder, part):
    """Both byte orders, scaling, an offset, zipped files; files that cannot be read are rows that say why."""
    path, arrays = folder
    rows = split.planes(spark, path, part_bytes=part)
    got = {}
    for r in split.voxels(rows).collect():
        got.setdefault(r["path"].split("/")[-1], {})[r["i"], r["j"], r["k"]] = r["v"]
    assert got == {name: {p: float(x) for p, x in np.ndenumerate(a)} for name, a in arrays.items()}
    why = {r["path"].split("/")[-1]: r["problem"] for r in split.headers(rows).collect()}
    cut, no = "truncated file", "not a NIfTI-1 file"
    assert why == {"a.nii": None, "b.nii": None, "c.nii.gz": None, "short.nii": cut, "short.nii.gz": cut, "less.nii.gz": cut, "none.nii": no, "empty.nii": no, "kind.nii": "unsupported scalar type"}
    if part == 40:
        assert rows.where(F.col("path").endswith("a.nii")).select(F.spark_partition_id()).distinct().count() > 5


def test_same_as_whole_files(spark, folder):
    path, _ = folder
    name = F.element_at(F.split("path", "/"), -1).alias("file")
    good = [split.headers(split.planes(spark, path)), nifti.headers(nifti.files(spark, path, "[abd]*.nii"))]
    a, b = ({tuple(r) for r in h.where("problem is null").select(name, "nx", "ny", "nz", F.col("affine").cast("string")).where("file in ('a.nii', 'b.nii')").collect()} for h in good)
    assert a == b and len(a) == 2


def test_npy(spark, tmp_path):
    """C order in planes of the first axis; Fortran order and objects have no planes."""
    a = np.arange(60, dtype=">f8").reshape(5, 4, 3)
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "f.npy", np.asfortranarray(a))
    np.save(tmp_path / "o.npy", np.array([None, 1]), allow_pickle=True)
    rows = split.planes(spark, str(tmp_path), "npy", 100)
    assert {(r["path"].split("/")[-1], tuple(r["shape"] or ())) for r in rows.where("at is null").collect()} == {("a.npy", (5, 4, 3)), ("f.npy", ()), ("o.npy", ())}
    got = split.npy_values(rows, ">f8").collect()
    assert len(got) == 60 and all(r["v"] == r["i"] * 12 + r["p"] and r["path"].endswith("a.npy") for r in got)
