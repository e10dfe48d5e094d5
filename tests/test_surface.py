"""Surfaces of balls and odd shapes."""

import math
from collections import Counter

import numpy as np
import pytest

from volspark.operators import mesh, surface

AFFINE = [0.0, 0.9, 0.0, 4.0, -1.1, 0.0, 0.0, 7.0, 0.0, 0.0, 1.3, -2.0, 0.0, 0.0, 0.0, 1.0]
PLAIN = [0.8, 0.0, 0.0, 0.0, 0.0, 0.8, 0.0, 0.0, 0.0, 0.0, 0.8, 0.0, 0.0, 0.0, 0.0, 1.0]


@pytest.fixture(scope="module")
def scene(spark):
    """A ball of 12 mm in volume 0, one of 9 mm with a speck far off in volume 1."""
    rows, sizes = [], {0: ((30, 36, 28), (1.1, 0.9, 1.3), 12.0), 1: ((32, 32, 32), (0.8, 0.8, 0.8), 9.0)}
    for v, (shape, step, r) in sizes.items():
        at = np.stack(np.meshgrid(*[(np.arange(n) - n / 2 + 0.2) * s for n, s in zip(shape, step, strict=True)], indexing="ij"))
        rows += [(v, *map(int, p), 3 + v) for p in np.argwhere((at**2).sum(0) <= r * r)]
    rows += [(1, 1, 1, 1, 4), (1, 1, 1, 2, 4)]
    lab = spark.createDataFrame(rows, "vol_id int, i int, j int, k int, label int").repartition(3)
    grids = spark.createDataFrame([(0, 30, 36, 28, AFFINE), (1, 32, 32, 32, PLAIN)], "vol_id int, nx int, ny int, nz int, affine array<double>")
    return lab, grids, rows


def closed(triangles):
    """Every edge belongs to two triangles that pass it in opposite directions."""
    n = Counter()
    for t in triangles:
        for p, q in ((t["a"], t["b"]), (t["b"], t["c"]), (t["c"], t["a"])):
            n[t["mesh_id"], p, q] += 1
    return all(c == 1 and n[m, q, p] == 1 for (m, p, q), c in n.items())


def test_balls(spark, scene):
    lab, grids, rows = scene
    opts = spark.createDataFrame([(3, 1.0, 1.5, 20, 0.0), (4, 0.0, 1.0, 20, 0.03)], "label int, target_mm double, sigma_mm double, taubin int, least_ml double")
    vertices, triangles = (df.cache() for df in surface.surfaces(lab, grids, opts))
    assert closed(triangles.collect())
    got = {r["mesh_id"]: r["ml"] for r in mesh.volumes(triangles, vertices).collect()}
    # a blur of width s moves the half level of a ball of radius r inwards by s * s / r
    want = {m: 4 / 3 * math.pi * (r - s * s / r) ** 3 / 1000 for m, r, s in ((3, 12.0, 1.5), (260, 9.0, 1.0))}
    assert set(got) == set(want) and all(abs(abs(got[m]) / want[m] - 1) < 0.02 for m in want)
    assert got[260] > 0  # normals point outwards where the affine keeps the hand
    points = np.array([(r["x"], r["y"], r["z"]) for r in vertices.where("mesh_id = 260").collect()])
    assert np.abs(points.mean(0) - 12.64).max() < 0.1  # no vertex of the speck


def test_bricks(spark, scene, monkeypatch):
    """The size of bricks changes nothing."""
    lab, grids, _ = scene
    opts = spark.createDataFrame([(4, 0.0, 0.0, 2)], "label int, target_mm double, sigma_mm double, taubin int")
    one = lab.where("label = 4")
    own = surface.frames(one, grids, opts)
    vertices, triangles = surface.net(surface.crossed_cells(surface.blocks(one, own)).cache())
    whole = sorted(map(tuple, surface.smoothed(vertices, triangles, own).collect()))
    monkeypatch.setattr(surface, "BRICK", 9)
    monkeypatch.setattr(surface, "TURNS", 2)
    assert sorted(map(tuple, surface.smoothed(vertices, triangles, own).collect())) == whole


def test_blur(spark, scene):
    lab, grids, rows = scene
    opts = spark.createDataFrame([(3, 2.0, 2.5, 0)], "label int, target_mm double, sigma_mm double, taubin int")
    one = lab.where("label = 3")
    own = surface.frames(one, grids, opts)
    f = own.first()
    got = {(r["gi"], r["gj"], r["gk"]): r["v"] for r in surface.blurred(surface.blocks(one, own)).collect()}
    grid = np.zeros([f[f"g{n}"] for n in range(3)])
    lo = [min(r[1 + n] for r in rows if r[0] == 0) for n in range(3)]
    for r in rows:
        if r[0] == 0:
            grid[tuple((r[1 + n] - lo[n]) // f[f"f{n}"] + f[f"p{n}"] for n in range(3))] += 1 / math.prod(f[f"f{n}"] for n in range(3))
    for n in range(3):
        sigma = f[f"b{n}"]
        t = np.arange(-max(1, math.ceil(3 * sigma)), max(1, math.ceil(3 * sigma)) + 1)
        w = np.exp(-0.5 * t * t / sigma**2)
        if sigma >= 0.3:
            grid = np.apply_along_axis(lambda a, w=w: np.convolve(a, w / w.sum(), "same") if len(a) >= len(w) else np.convolve(a, w / w.sum())[len(w) // 2 : len(w) // 2 + len(a)], n, grid)
    for p in np.ndindex(grid.shape):
        assert abs(got.get(p, 0.0) - grid[p]) < 1e-5


def test_options_and_nothing(spark, scene):
    lab, grids, _ = scene
    named = spark.createDataFrame([(1, "spleen"), (2, "portal_vein"), (3, "hepatic_veins")], "label int, name string")
    got = {r["name"]: (r["target_mm"], r["sigma_mm"], r["taubin"], r["least_ml"]) for r in surface.options(named).collect()}
    assert got == {"spleen": (1.0, 1.5, 20, 0.0), "portal_vein": (0.0, 1.0, 20, 0.03), "hepatic_veins": (0.0, 0.0, 30, 0.03)}
    vertices, triangles = surface.surfaces(lab, grids, surface.options(named.where("label = 1")))
    assert vertices.count() == triangles.count() == 0


def test_one_voxel(spark, scene):
    """Taubin without blur keeps a voxel's octahedron closed."""
    _, grids, _ = scene
    one = spark.createDataFrame([(1, 0, 0, 0, 9)], "vol_id int, i int, j int, k int, label int")
    opts = spark.createDataFrame([(9, 0.0, 0.0, 0, 0.0)], "label int, target_mm double, sigma_mm double, taubin int, least_ml double")
    vertices, triangles = surface.surfaces(one, grids, opts)
    assert vertices.count() == 8 and triangles.count() == 12 and closed(triangles.collect())
    # each vertex is a third of half a cell from the voxel's middle, along all axes
    assert math.isclose(mesh.volumes(triangles, vertices).first()["ml"] * 1000, (0.8 / 3) ** 3, rel_tol=1e-5)


def test_rows_of_the_blur(spark, scene):
    """Blocks are gathered as lines before they are smoothed and before they become cells; no row is multiplied by the taps or by the eight corners."""
    lab, grids, _ = scene
    own = surface.frames(lab.where("label = 3"), grids, spark.createDataFrame([(3, 2.0, 2.5, 0)], "label int, target_mm double, sigma_mm double, taubin int"))
    cells = surface.blocks(lab.where("label = 3"), own)
    cells = spark.createDataFrame(cells.collect(), cells.schema)
    plan = surface.blurred(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate posexplode") == 3 and "Generate explode" not in plan
    plan = surface.crossed_cells(cells)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("explode(") == 1 and plan.count("collect_list") == 2
