"""Files that the sinks write, read back by numpy, gzip and the NIfTI reader."""

import gzip
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.operators import mesh
from volspark.sources import nifti, sinks

GRIDS = [(0, 5, 4, 3, [0.0, -0.8, 0.0, 10.0, 0.7, 0.0, 0.0, -20.0, 0.0, 0.0, 1.5, 5.0, 0.0, 0.0, 0.0, 1.0]), (1, 2, 3, 6, [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]), (2, 2, 2, 2, [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0])]


@pytest.fixture(scope="module")
def grids(spark):
    return spark.createDataFrame([(v, x, y, z, [float(a) for a in m]) for v, x, y, z, m in GRIDS], "vol_id int, nx int, ny int, nz int, affine array<double>")


@pytest.fixture(scope="module")
def arrays():
    """Volumes of unlike sizes; the last one is empty."""
    rng = np.random.default_rng(1)
    return {v: (rng.integers(0, 200, (x, y, z)) * (v < 2)) for v, x, y, z, _ in GRIDS}


@pytest.fixture(scope="module")
def cells(spark, arrays):
    rows = [(v, *map(int, p), int(x)) for v, a in arrays.items() for p, x in np.ndenumerate(a) if x or sum(p) % 2]
    return spark.createDataFrame(rows, "vol_id int, i int, j int, k int, label int")


def files(folder):
    return sorted(os.path.relpath(os.path.join(d, f), folder) for d, _, found in os.walk(folder) for f in found)


def test_nifti_zipped_and_plain(spark, grids, arrays, cells, tmp_path):
    """Bytes zipped and short integers plain; the reader gives the voxels and the affine back."""
    sinks.save(sinks.nifti_pieces(cells, grids), str(tmp_path / "a"))
    low = cells.withColumn("hu", F.col("label") * -100)
    sinks.save(sinks.nifti_pieces(low, grids, "hu", "i2", F.concat(F.lit("ct/"), F.col("vol_id"), F.lit(".nii"))), str(tmp_path / "b"))
    assert files(tmp_path / "a") == ["0.nii.gz", "1.nii.gz", "2.nii.gz"] and files(tmp_path / "b") == ["ct/0.nii", "ct/1.nii", "ct/2.nii"]
    for v, a in arrays.items():
        raw = gzip.decompress((tmp_path / "a" / f"{v}.nii.gz").read_bytes())
        assert raw[123] == 10 and (np.frombuffer(raw[352:], np.uint8).reshape(a.shape, order="F") == a).all()
        assert (np.frombuffer((tmp_path / "b/ct" / f"{v}.nii").read_bytes()[352:], "<i2").reshape(a.shape, order="F") == -100 * a).all()
    heads = nifti.headers(nifti.files(spark, str(tmp_path)))
    got = {(r["path"].split("/")[-1], r["datatype"]): r["affine"] for r in heads.collect()}
    assert {t for _, t in got} == {2, 4} and got["0.nii.gz", 2] == pytest.approx(GRIDS[0][4], abs=1e-6)
    back = {(r["i"], r["j"], r["k"]): r["v"] for r in nifti.voxels(heads.where("path like '%ct/1.nii'")).collect()}
    assert back == {p: -100.0 * x for p, x in np.ndenumerate(arrays[1])}


def test_npy(grids, arrays, cells, tmp_path):
    sinks.save(sinks.npy_pieces(cells, grids, "label", "<f4"), str(tmp_path))
    for v, a in arrays.items():
        got = np.load(tmp_path / f"{v}.npy")
        assert got.dtype == np.float32 and (got == a).all()


def test_values_that_do_not_fit_leave_no_file(grids, cells, tmp_path):
    with pytest.raises(Exception, match="does not fit"):
        sinks.save(sinks.nifti_pieces(cells.withColumn("label", F.when(F.col("vol_id") == 1, 300).otherwise(F.col("label"))), grids), str(tmp_path))
    assert files(tmp_path) == []


def test_written_twice(spark, tmp_path):
    """append refuses a file that is there, overwrite replaces it, bad names and rows out of order fail; nothing is half written."""
    one = spark.createDataFrame([("x.json", "{}"), ("d/y.json", "[]")], "file string, json string")
    sinks.save(sinks.text_pieces(one), str(tmp_path))
    with pytest.raises(Exception, match="written twice"):
        sinks.save(sinks.text_pieces(one.withColumn("json", F.lit("1")).unionByName(one.limit(0))), str(tmp_path))
    assert (tmp_path / "x.json").read_text() == "{}" and files(tmp_path) == ["d/y.json", "x.json"]
    sinks.save(sinks.text_pieces(one.withColumn("json", F.lit("1"))), str(tmp_path), replace=True)
    assert (tmp_path / "d/y.json").read_text() == "1"
    with pytest.raises(Exception, match="bad file name"):
        sinks.save(sinks.text_pieces(one.withColumn("file", F.lit("../z"))), str(tmp_path / "e"))
    assert files(tmp_path) == ["d/y.json", "x.json"]


def test_meshes(spark, tmp_path):
    """Two tetrahedra whose vertices are numbered with gaps: STL facets and OBJ indices, with normals of length 1."""
    points = [(0.0, 0.0, 0.0), (1.0, 0.0, 0.0), (0.0, 2.0, 0.0), (0.0, 0.0, 3.0)]
    faces = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]
    ver = spark.createDataFrame([(m, 10 * v, *(m * x for x in p)) for m in (1, 2) for v, p in enumerate(points)], "mesh_id int, vid int, x double, y double, z double")
    tri = spark.createDataFrame([(m, t, *(10 * x for x in f)) for m in (1, 2) for t, f in enumerate(faces)], "mesh_id int, tid int, a int, b int, c int")
    sinks.save(sinks.stl_pieces(tri, ver).unionByName(sinks.obj_pieces(tri, ver)), str(tmp_path))
    normals = {(r["mesh_id"], r["vid"]): (r["nx"], r["ny"], r["nz"]) for r in mesh.normals(tri, ver).collect()}
    for m in (1, 2):
        raw = (tmp_path / f"{m}.stl").read_bytes()
        assert len(raw) == 84 + 50 * 4 and np.frombuffer(raw[80:84], "<u4")[0] == 4 and not raw.startswith(b"solid")
        got = np.frombuffer(raw[84:], np.dtype([("n", "<f4", 3), ("p", "<f4", (3, 3)), ("a", "<u2")]))
        assert (got["p"] == m * np.array(points)[np.array(faces)]).all() and np.linalg.norm(got["n"], axis=1) == pytest.approx(np.ones(4))
        lines = (tmp_path / f"{m}.obj").read_text().splitlines()
        assert [x.split()[0] for x in lines] == ["#"] + ["v"] * 4 + ["vn"] * 4 + ["f"] * 4
        assert lines[-1] == "f 2//2 3//3 4//4" and lines[2] == f"v {m:.4f} 0.0000 0.0000"
        assert [float(x) for x in lines[6].split()[1:]] == pytest.approx(normals[m, 10], abs=1e-4)


def test_run_records(spark, tmp_path):
    runs = spark.createDataFrame([("lab", "cpu", 7, 1, 2, 0.5, 11), ("lab", "gpu", 7, 1, 1, 0.25, 12)], "environment string, path string, case_id long, task int, rep int, secs double, hash long")
    sinks.save(sinks.text_pieces(sinks.run_records(runs)), str(tmp_path))
    got = json.loads((tmp_path / "lab/7__1.json").read_text())
    assert got == {"case": 7, "task": 1, "n_runs": 2, "runs": [{"rep": 1, "seconds": 0.25, "backend": "gpu", "hash": 12}, {"rep": 2, "seconds": 0.5, "backend": "cpu", "hash": 11}]}
