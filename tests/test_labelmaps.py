"""Label maps from files: checks, orientation, names, ids and merging."""

import numpy as np
import pytest

from volspark.sources import labelmaps

CELLS = "file string, i int, j int, k int, v double"
PLAIN = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
FLIPPED = [0, -2.0, 0, 0, 1.0, 0, 0, 0, 0, 0, 3.0, 0, 0, 0, 0, 1.0]


def grids(spark, rows):
    return spark.createDataFrame([(f, *s, [float(x) for x in a]) for f, s, a in rows], "file string, nx int, ny int, nz int, affine array<double>")


@pytest.fixture(scope="module")
def targets(spark):
    return spark.createDataFrame([(1, 3, 4, 2)], "vol_id int, nx int, ny int, nz int")


def test_checks(spark, targets):
    """Each reason in its turn; a value within 1e-3 of a whole number passes, and so does a file without a voxel."""
    values = {"half": 1.5, "minus": -1.0, "nan": float("nan"), "big": 256.0, "near": 2.0009, "far": 2.0011, "top": 255.0009, "shape": 1.0, "else": 1.0, "flat": 1.0, "lost": 1.0}
    cells = spark.createDataFrame([(f, 0, 0, 0, v) for f, v in values.items()] + [("null", 0, 0, 0, None)], CELLS)
    every = [*values, "null", "empty"]
    files = spark.createDataFrame([(f, 9 if f == "else" else 1) for f in every], "file string, vol_id int")
    own = grids(spark, [(f, (4, 3, 2) if f == "shape" else (3, 4, 2), [0.0] * 16 if f == "flat" else PLAIN) for f in every if f != "lost"])
    got, bad = labelmaps.imported(files, cells, own, targets)
    why = {r["file"]: r["problem"] for r in bad.collect()}
    whole = "label values that are not whole numbers from 0 to 255"
    assert why == {"half": whole, "minus": whole, "nan": whole, "null": whole, "far": whole, "big": "label values over 255", "shape": "grid 4x3x2 instead of 3x4x2", "else": "no such volume", "flat": "an axis points nowhere", "lost": "no grid"}
    assert {(r["file"], r["label"]) for r in got.collect()} == {("near", 2), ("top", 255)}


def test_orientation(spark, targets):
    """A file stored front to back and with its first two axes exchanged lands on the volume's grid."""
    a = np.arange(24).reshape(4, 3, 2)
    cells = spark.createDataFrame([("f", *map(int, p), float(x)) for p, x in np.ndenumerate(a)], CELLS)
    got, bad = labelmaps.imported(spark.createDataFrame([("f", 1)], "file string, vol_id int"), cells, grids(spark, [("f", (4, 3, 2), FLIPPED)]), targets)
    assert bad.count() == 0
    want = np.flip(a.transpose(1, 0, 2), axis=0)
    assert {(r["i"], r["j"], r["k"]): r["label"] for r in got.collect()} == {tuple(map(int, p)): int(x) for p, x in np.ndenumerate(want) if x}


def test_side_cars(spark):
    texts = [("a", '{"labels":[{"id":1,"name":"x"},{"id":1,"name":"liver","color":[0,0.5,1],"verified":true,"source":"manual"},{"id":2,"name":"","color":[0,2,0],"source":""},{"name":"y"},{"id":4,"color":[1,1]}]}'), ("b", '{"labels":'), ("c", "{}"), ("d", None)]
    side = spark.createDataFrame(texts, "file string, json string")
    got = {(r["file"], r["label"]): tuple(r)[2:] for r in labelmaps.sidecar_labels(side).collect()}
    assert got == {("a", 1): ("liver", [0.0, 0.5, 1.0], True, "manual"), ("a", 2): ("", None, False, None), ("a", 4): (None, None, False, None)}
    assert [r["file"] for r in labelmaps.broken_sidecars(side).collect()] == ["b"]
    paths = spark.createDataFrame([(x,) for x in ("/d/case.nii.gz", "/d/case.nii", "s3://b/case.json", "case.meta.json")], "p string")
    assert {r[0] for r in paths.select(labelmaps.stem(paths["p"])).collect()} == {"case"}


@pytest.mark.parametrize("replace", [False, True])
def test_merge_and_replace(spark, replace):
    """Two files of one volume and a volume without a file."""
    cells = spark.createDataFrame([("a", 1, 0, 0, 0, 1), ("a", 1, 0, 0, 1, 2), ("b", 1, 0, 0, 1, 1)], "file string, vol_id int, i int, j int, k int, label int")
    known = spark.createDataFrame([("a", 1, "liver"), ("b", 1, "spleen")], "file string, label int, name string")
    have = spark.createDataFrame([(1, 1, "spleen"), (1, 3, "kidney"), (2, 1, "bone")], "vol_id int, label int, name string")
    current = spark.createDataFrame([(1, 0, 0, 0, 3), (1, 0, 0, 2, 3), (2, 0, 0, 0, 1)], "vol_id int, i int, j int, k int, label int")
    new, after = labelmaps.ids(labelmaps.label_names(cells, known), have, replace)
    want = {("a", 1): 1, ("a", 2): 2, ("b", 1): 3} if replace else {("a", 1): 2, ("a", 2): 4, ("b", 1): 1}
    assert {(r["file"], r["label"]): r["new"] for r in new.collect()} == want
    rows = {(r["vol_id"], r["name"]): r["label"] for r in after.collect()}
    assert rows == ({(1, "liver"): 1, (1, "label_2"): 2, (1, "spleen"): 3, (2, "bone"): 1} if replace else {(1, "spleen"): 1, (1, "liver"): 2, (1, "kidney"): 3, (1, "label_2"): 4, (2, "bone"): 1})
    got = {(r["vol_id"], r["k"]): r["label"] for r in labelmaps.merged(current, cells, new, replace).collect()}
    assert got == ({(1, 0): 1, (1, 1): 3, (2, 0): 1} if replace else {(1, 0): 2, (1, 1): 1, (1, 2): 3, (2, 0): 1})
