"""Queries over the surfaces of structures, and their SQL. Registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from volspark.operators import mesh, surface
from volspark.operators.graph import shared
from volspark.plans.catalogue import _CTE, _query
from volspark.plans.grids import _SIZE
from volspark.sources import fixtures as fx

_V = [f"v{c}" for c in range(8)]
_INSIDE = "+".join(f"CAST({v}>0.5e0 AS INT)" for v in _V)
_SINGLE = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
_CUT = [(f"(v{a}>0.5e0)<>(v{b}>0.5e0)", a, b, f"{_SINGLE.format(f'0.5e0-v{a}')}/{_SINGLE.format(f'v{b}-v{a}')}") for a, b in [(0, 1), (2, 3), (4, 5), (6, 7), (0, 2), (1, 3), (4, 6), (5, 7), (0, 4), (1, 5), (2, 6), (3, 7)]]
_MEAN = ["(" + "+".join(f"CASE WHEN {cut} THEN {a >> d & 1}+{t}*{(b >> d & 1) - (a >> d & 1)}e0 ELSE 0e0 END" for cut, a, b, t in _CUT) + ")/(" + "+".join(f"CAST({cut} AS INT)" for cut, *_ in _CUT) + ")" for d in range(3)]
_CTE |= {
    "mesh_frame": "SELECT b.*, affine, " + ", ".join(f"greatest(1, CAST(floor(2e0/{s}+0.5e0) AS INT)) f{n}" for n, s in enumerate(_SIZE)) + " FROM (SELECT vol_id, label, min(i) li, max(i) hi, min(j) lj, max(j) hj, min(k) lk, max(k) hk FROM own_lab WHERE label IN (2,5) GROUP BY 1,2) b JOIN own_grid g ON g.vol_id=b.vol_id",
    "mesh_block": "SELECT l.vol_id, l.label, (i-li)//f0+2 gi, (j-lj)//f1+2 gj, (k-lk)//f2+2 gk, " + _SINGLE.format(f"count(*)*{_SINGLE.format('1e0/any_value(f0*f1*f2)')}") + " v FROM own_lab l JOIN mesh_frame m ON m.vol_id=l.vol_id AND m.label=l.label GROUP BY 1,2,3,4,5",
    "mesh_cell": "SELECT * FROM (SELECT vol_id, label, gi-x gi, gj-y gj, gk-z gk, " + ", ".join(f"max(CASE WHEN x+2*y+4*z={c} THEN v ELSE 0e0 END) v{c}" for c in range(8)) + f" FROM mesh_block, (VALUES (0),(1)) a(x), (VALUES (0),(1)) b(y), (VALUES (0),(1)) c(z) GROUP BY 1,2,3,4,5) WHERE {_INSIDE} BETWEEN 1 AND 7",
}


def _cells(spark, d):
    """Cells of labels 2 and 5 at about 2 mm, not blurred."""
    lab, opts = shared(fx.own_labels(spark, d)), spark.createDataFrame([(2, 2.0, 0.0, 0), (5, 2.0, 0.0, 0)], "label int, target_mm double, sigma_mm double, taubin int")
    lab = lab.where("label in (2, 5)")
    return surface.crossed_cells(surface.blurred(surface.blocks(lab, surface.frames(lab, fx.grids(spark, d), opts))))


@_query("SELECT vol_id, label, (CAST(gi AS BIGINT)*16384+gj)*16384+gk AS vid, " + ", ".join(f"{_SINGLE.format(f'{g}+{m}')} AS {c}" for g, m, c in zip(("gi", "gj", "gk"), _MEAN, "xyz", strict=True)) + " FROM mesh_cell")
def surface_vertices(spark, d):
    return surface.net(_cells(spark, d))[0]


_ID = "((CAST({} AS BIGINT)*16384+({}))*16384+({}))"
_AROUND = [[("gi", "gj-1", "gk-1"), ("gi", "gj", "gk-1"), ("gi", "gj", "gk"), ("gi", "gj-1", "gk")], [("gi-1", "gj", "gk-1"), ("gi-1", "gj", "gk"), ("gi", "gj", "gk"), ("gi", "gj", "gk-1")], [("gi-1", "gj-1", "gk"), ("gi", "gj-1", "gk"), ("gi", "gj", "gk"), ("gi-1", "gj", "gk")]]
_TRI = " UNION ALL ".join(
    f"SELECT vol_id, label, {_ID.format('gi', 'gj', 'gk')}*6+{2 * axis + n} AS tid, {_ID.format(*quad[0])} AS a, CASE WHEN v0>0.5e0 THEN {_ID.format(*quad[n + 1])} ELSE {_ID.format(*quad[n + 2])} END AS b, CASE WHEN v0>0.5e0 THEN {_ID.format(*quad[n + 2])} ELSE {_ID.format(*quad[n + 1])} END AS c FROM mesh_cell WHERE (v0>0.5e0)<>(v{1 << axis}>0.5e0)"
    for axis, quad in enumerate(_AROUND)
    for n in (0, 1)
)


@_query(_TRI)
def surface_triangles(spark, d):
    return surface.net(_cells(spark, d))[1]


@_query(None)
def surface_volumes(spark, d):
    """Millilitres inside the smoothed surface of each named structure of each volume."""
    named = spark.createDataFrame([(2, "liver"), (5, "portal_vein")], "label int, name string")
    vertices, triangles = surface.surfaces(fx.organs(spark, d), fx.grids(spark, d), surface.options(named))
    return mesh.volumes(triangles, vertices)
