"""Volume operators that SQL does not express, against plain numpy on small grids."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.operators import components, hashing, labels, planning, registry, resample, series, tiles
from volspark.sources import nifti


def frame(spark, grids, name="v"):
    """A DataFrame of dense arrays, a volume each."""
    rows = [(n, *map(int, at), g[at].item()) for n, g in enumerate(grids) for at in np.ndindex(g.shape)]
    kind = "int" if np.issubdtype(grids[0].dtype, np.integer) else "double"
    return spark.createDataFrame(rows, f"vol_id int, i int, j int, k int, {name} {kind}")


def dense(df, shape, n=1, name="v"):
    out = np.zeros((n, *shape))
    for r in df.collect():
        out[r["vol_id"], r["i"], r["j"], r["k"]] = r[name]
    return out


def spline_line(line, at):
    """Cubic spline through a line that goes on with its end values, by solving for its coefficients."""
    n, pad = len(line), 60
    x = np.concatenate((np.full(pad, line[0]), line, np.full(pad, line[-1])))
    a = np.eye(len(x)) * 4 / 6 + np.eye(len(x), k=1) / 6 + np.eye(len(x), k=-1) / 6
    a[0, 0] = a[-1, -1] = 5 / 6
    c = np.linalg.solve(a, x)

    def basis(t):
        t = abs(t)
        return (4 - 6 * t * t + 3 * t**3) / 6 if t < 1 else (2 - t) ** 3 / 6 if t < 2 else 0.0

    at = np.clip(at, -1e9, 1e9) + pad
    return np.array([sum(c[m] * basis(p - m) for m in range(max(0, int(p) - 2), min(len(x), int(p) + 4))) for p in at])


@pytest.mark.parametrize("order, grid", [(1, False), (3, False), (1, True), (3, True)])
def test_zoom(spark, order, grid):
    rng = np.random.default_rng(0)
    shape, out = (7, 6, 5), (10, 4, 5)
    grids = [np.rint(rng.normal(0, 300, shape)) for _ in range(2)]
    want = np.stack(grids)
    for axis, (n, m) in enumerate(zip(shape, out, strict=True), 1):
        if grid and n == m:
            continue
        at = (np.arange(m) + 0.5) * n / m - 0.5 if grid else np.arange(m) * (n - 1) / (m - 1)
        line = (lambda v: spline_line(v, at)) if order == 3 else (lambda v: np.interp(at, np.arange(n), v))
        want = np.apply_along_axis(line, axis, want)
    got = dense(resample.zoomed(frame(spark, grids), shape, out, order, grid), out, 2)
    assert np.allclose(got, want, atol=1e-5)


def test_zoom_by_slices(spark):
    rng = np.random.default_rng(1)
    shape, out = (6, 5, 4), (9, 7, 8)
    grid = rng.normal(0, 10, shape)
    want = np.zeros((9, 7, 4))
    for k in range(4):
        s = grid[:, :, k]
        for axis, (n, m) in enumerate(((6, 9), (5, 7))):
            s = np.apply_along_axis(lambda v, n=n, m=m: spline_line(v, (np.arange(m) + 0.5) * n / m - 0.5), axis, s)
        want[:, :, k] = np.clip(s, grid[:, :, k].min(), grid[:, :, k].max())
    want = want[:, :, [0, 0, 1, 1, 2, 2, 3, 3]]
    got = dense(resample.zoomed_by_slices(frame(spark, [grid]), shape, out, 2, 3), out)[0]
    assert np.allclose(got, want, atol=1e-5)


def test_spacing_choices():
    assert resample.slice_axis((1, 1, 5), (1, 1, 1)) == 2
    assert resample.slice_axis((1, 1, 1), (4, 1, 1)) == 0
    assert resample.slice_axis((1, 5, 5), (1, 1, 1)) is None and resample.slice_axis((1, 1, 3), (1, 1, 3)) is None
    assert resample.output_shape((5, 7, 9), (0.5, 0.5, 0.5)) == (2, 4, 4)


def test_to_spacing_keeps_the_grid(spark):
    grid = np.array([[[1.7, -1.7]]])
    affine = [0.5, 0, 0, 1.0, 0, 0.5, 0, 2.0, 0, 0, 2.0, 3.0, 0, 0, 0, 1.0]
    out, shape, moved = resample.to_spacing(frame(spark, [grid]), (1, 1, 2), affine, (0, 0.5, 2.0), 1)
    assert shape == (1, 1, 2) and moved == affine
    assert sorted(r["v"] for r in out.collect()) == [-1, 1]


def test_canonical(spark):
    rng = np.random.default_rng(2)
    shape = (4, 3, 2)
    grid = rng.normal(size=shape)
    for order, signs in itertools.product(itertools.permutations(range(3)), itertools.product((1, -1), repeat=3)):
        a = np.eye(4)
        a[:3, :3] = 0
        for axis in range(3):
            a[order[axis], axis] = signs[axis] * (axis + 1)
        a[:3, 3] = 5, 6, 7
        source, flips, out, moved = resample.canonical_plan(shape, a.ravel().tolist())
        m = np.array(moved).reshape(4, 4)
        assert (np.diag(m)[:3] > 0).all() and np.count_nonzero(m[:3, :3]) == 3
        flipped = grid[tuple(slice(None, None, -1 if f else 1) for f in flips)]
        assert out == tuple(np.array(shape)[source])
        for at in np.ndindex(shape):  # every voxel keeps its place in the world
            old = [n - 1 - p if f else p for p, n, f in zip(at, shape, flips, strict=True)]
            assert np.allclose(m @ [*(old[s] for s in source), 1], a @ [*at, 1])
        if order == (2, 0, 1):
            got = dense(resample.reoriented(frame(spark, [grid]), shape, source, flips), out)[0]
            assert np.array_equal(got, flipped.transpose(source))
    with pytest.raises(ValueError):
        resample.canonical_plan(shape, [0.0] * 16)


def pieces(grid, corners, axes=(0, 1, 2)):
    """{voxel: least voxel of its piece}, by search."""
    steps = [s for s in itertools.product((-1, 0, 1), repeat=3) if any(s) and all(s[a] == 0 for a in range(3) if a not in axes) and (corners or sum(map(abs, s)) == 1)]
    root = {}
    for at in np.ndindex(grid.shape):
        if grid[at] and at not in root:
            todo = [at]
            root[at] = at
            while todo:
                p = todo.pop()
                for s in steps:
                    q = tuple(np.add(p, s))
                    if all(0 <= x < n for x, n in zip(q, grid.shape, strict=True)) and grid[q] == grid[p] and q not in root:
                        root[q] = at
                        todo.append(q)
    return root


@pytest.mark.parametrize("corners", [False, True])
def test_components(spark, corners):
    rng = np.random.default_rng(3)
    shape = (8, 7, 9)
    grids = [rng.integers(0, 3, shape) * (rng.random(shape) < 0.6) for _ in range(2)]
    lab = frame(spark, grids, "label")
    got = {(r["vol_id"], r["i"], r["j"], r["k"]): r["piece"] for r in components.components(lab, shape, corners).collect()}
    want = {}
    for n, g in enumerate(grids):
        for at, root in pieces(g, corners).items():
            want[n, *at] = n * g.size + int(np.ravel_multi_index(root, shape))
    assert got == want
    assert components.components(lab.where("false"), shape).count() == 0


def test_largest_and_specks(spark):
    rng = np.random.default_rng(4)
    shape = (8, 7, 9)
    grid = rng.integers(0, 3, shape) * (rng.random(shape) < 0.5)
    lab = frame(spark, [grid], "label")
    for corners, got in ((False, components.largest(lab, shape)), (True, components.without_specks(lab, shape, 5))):
        root = pieces(grid, corners)
        size = {}
        for at, r in root.items():
            size.setdefault(r, []).append(at)
        if corners:
            keep = {at for own in size.values() if len(own) >= 5 for at in own}
        else:
            keep = {at for label in (1, 2) for at in max((own for r, own in sorted(size.items()) if grid[r] == label), key=len)}
        assert {(r["i"], r["j"], r["k"]) for r in got.collect()} == keep
    assert components.least_voxels(0.03, (0.8, 0.8, 1.5)) == math.ceil(30 / 0.96)


def test_fills(spark):
    rng = np.random.default_rng(5)
    shape = (9, 8, 3)
    grid = rng.integers(0, 3, shape)
    hu = rng.integers(0, 10, shape)
    lab = frame(spark, [grid], "label").join(frame(spark, [hu], "hu"), labels.PLACE)
    seeds = spark.createDataFrame([(0, 4, 4, 1), (0, 0, 0, 2)], "vol_id int, i int, j int, k int")
    for window in (None, (0, 6)):
        ok = np.ones(shape, bool) if window is None else (hu >= 0) & (hu <= 6)
        root = pieces(np.where(ok, grid + 1, 0), False, (0, 1))
        want = grid.copy()
        for s in ((4, 4, 1), (0, 0, 2)):
            for at, r in root.items():
                if s in root and r == root[s]:
                    want[at] = 7
        assert np.array_equal(dense(components.filled(lab, seeds, shape, 7, hu=window), shape, name="label")[0], want)
    root = pieces(grid, True)
    want = grid.copy()
    for s in ((4, 4, 1), (0, 0, 2)):
        for at, r in root.items():
            if s in root and r == root[s]:
                want[at] = 7
    assert np.array_equal(dense(components.relabelled(lab, seeds, shape, 7), shape, name="label")[0], want)


def test_importance():
    g = tiles.importance((8, 12, 10))
    assert g.max() == 10 and g[4, 6, 5] == 10 and g.min() > 0 and (g == g.astype(np.float16)).all()


def test_hash_of_a_dense_array(spark):
    rng = np.random.default_rng(6)
    shape = (5, 4, 7)
    grids = [rng.integers(0, 256, shape) * (rng.random(shape) < 0.3) for _ in range(2)] + [np.zeros(shape, int)]

    def fnv(data):
        h = 2166136261
        for b in data.tolist():
            h = (h ^ b) * 16777619 % (1 << 32)
        return h

    lab = frame(spark, grids, "label")
    want = {n: fnv(g.ravel()) for n, g in enumerate(grids)}
    own = lab.select("vol_id").distinct().selectExpr("vol_id", "5 nx", "4 ny", "7 nz")
    assert {r["vol_id"]: r["hash"] for r in hashing.dense_hash(lab, own).collect()} == want
    assert {r["vol_id"]: r["hash"] for r in hashing.dense_hash(lab.where("label > 0 or i = 0"), own).collect()} == want


def test_series_without_a_usable_one(spark):
    rows = [("s", "1", "a", "CT", 512, 512, False, 0.0, 1.0, 1, "f1"), ("s", "1", "a", "CT", 512, 512, False, 0.0, 1.0, 2, "f2"), ("s", "2", "b", "CT", 9, 9, True, 0.0, None, 1, "g1")]
    headers = spark.createDataFrame(rows, "study string, series_uid string, description string, modality string, nrows int, ncols int, localizer boolean, tilt double, pos double, instance int, file string")
    got = {r["series_uid"]: r["problem"] for r in series.catalogue(headers).collect()}
    assert got == {"1": "duplicate slice positions", "2": "localizer only"}
    with pytest.raises(Exception, match="no usable series"):
        series.default_series(series.catalogue(headers)).collect()
    assert series.default_series(series.catalogue(headers), strict=False).count() == 0


def test_plans(spark):
    lines = ["task total 1 spleen", "task total 5 liver", "part 291 1 liver", "part 293 1 spleen", "nonsense"]
    classes = planning.class_map(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert planning.plan("total", ["spleen"], classes).model_ids() == [298, 293]
    assert planning.plan("total", [], classes).model_ids() == [291, 293]
    assert planning.plan("liver_vessels", [], classes).model_ids() == [298, 8]
    assert planning.plan("custom:12:liver+spleen", [], classes) == planning.Plan("custom:12:liver+spleen", (0.0, 0.0, 0.0), 0.5, [12], ["liver", "spleen"], [])
    for task, roi in (("odd", []), ("total", ["heart"])):
        with pytest.raises(ValueError):
            planning.plan(task, roi, classes)
    with pytest.raises(Exception, match="no such class"):
        planning.part_to_task(classes.where("not (kind = 'task' and name = 'liver')"), "total").collect()
    assert planning.margin_voxels((0.8, 0.8, 1.5)) == (25, 25, 13)


def test_registry_errors(spark):
    reg = spark.createDataFrame([(1, i, f"n{i}") for i in range(1, 256)], "vol_id int, label int, name string")
    with pytest.raises(Exception, match="255"):
        registry.ensured(reg, spark.createDataFrame([(1, "new", 1)], "vol_id int, name string, place int")).collect()
    with pytest.raises(Exception, match="taken"):
        registry.renamed(reg, 1, "n2").collect()
    got = {r["label"]: r["name"] for r in registry.renamed(reg.where("label < 3"), 1, " left  lung ").collect()}
    assert got == {1: "left_lung", 2: "n2"}
    assert [r["label"] for r in registry.stale(spark.createDataFrame([(1, 1)], "vol_id int, label int"), reg.where("label < 3")).collect()] == [2]


def test_nifti(spark, tmp_path):
    import gzip
    import struct

    rng = np.random.default_rng(7)
    shape = (3, 4, 2)
    kinds = [(2, "u1"), (4, "i2"), (8, "i4"), (16, "f4"), (64, "f8"), (256, "i1"), (512, "u2"), (768, "u4")]
    images = {}
    for code, kind in kinds:
        for big in (False, True):
            data = rng.integers(0, 100, shape) if kind[0] != "f" else rng.normal(0, 50, shape)
            data = (data - (50 if kind[0] == "i" else 0)).astype((">" if big else "<") + kind)
            head, e = bytearray(352), ">" if big else "<"
            struct.pack_into(e + "i", head, 0, 348)
            struct.pack_into(e + "8h", head, 40, 3, *shape, 1, 1, 1, 1)
            struct.pack_into(e + "2h", head, 70, code, data.itemsize * 8)
            struct.pack_into(e + "8f", head, 76, -1, 2, 3, 4, 0, 0, 0, 0)
            struct.pack_into(e + "3f", head, 108, 352, 2, -5)
            struct.pack_into(e + "2h", head, 252, 1, 0)
            struct.pack_into(e + "6f", head, 256, 0, 0, 0, 7, 8, 9)
            raw = bytes(head) + data.tobytes(order="F")
            name = f"{code}{e == '>'}.nii"
            images[name] = data
            (tmp_path / name).write_bytes(gzip.compress(raw) if big else raw)
    (tmp_path / "bad.nii").write_bytes(b"no image")
    (tmp_path / "cut.nii").write_bytes(raw[:360])
    heads = nifti.headers(nifti.files(spark, str(tmp_path))).cache()
    got = {r["path"].rsplit("/", 1)[1]: r for r in heads.collect()}
    assert {n: got[n]["problem"] for n in ("bad.nii", "cut.nii")} == {"bad.nii": "not a NIfTI-1 file", "cut.nii": "truncated file"}
    assert {r["problem"]: r["n"] for r in nifti.bad_files(heads).collect()} == {"not a NIfTI-1 file": 1, "truncated file": 1}
    for name in images:
        h = got[name]
        assert h["problem"] is None and (h["nx"], h["ny"], h["nz"]) == shape and f"{h['datatype']}{h['big']}.nii" == name
        assert h["affine"] == [2, 0, 0, 7, 0, 3, 0, 8, 0, 0, -4, 9, 0, 0, 0, 1]
    vox = {(r["path"].rsplit("/", 1)[1], r["i"], r["j"], r["k"]): r["v"] for r in nifti.voxels(heads).collect()}
    assert vox == {(name, *at): float(data[at]) * 2 - 5 for name, data in images.items() for at in np.ndindex(shape)}


def test_nifti_written(spark, tmp_path):
    rng = np.random.default_rng(8)
    shape = (4, 3, 5)
    grids = [rng.integers(0, 255, shape) for _ in range(2)]
    affine = [0.5, 0, 0, 1.5, 0, 0.75, 0, 2, 0, 0, 2, 3, 0, 0, 0, 1]
    out = nifti.written(frame(spark, grids, "label").where("label > 40"), shape, affine)
    for r in out.collect():
        (tmp_path / f"{r['vol_id']}.nii").write_bytes(r["content"])
    back = nifti.headers(nifti.files(spark, str(tmp_path)))
    assert all(r["affine"] == affine and r["datatype"] == 2 for r in back.collect())
    vox = nifti.voxels(back).withColumn("vol_id", F.regexp_extract("path", r"(\d+)\.nii", 1).cast("int"))
    assert np.array_equal(dense(vox, shape, 2), np.where(np.stack(grids) > 40, grids, 0))
