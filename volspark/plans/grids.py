"""Queries over volumes that each have a grid of their own, and their SQL. Registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from volspark.operators import components, geometry, hashing, tiles
from volspark.operators.graph import shared
from volspark.plans.catalogue import _CTE, _query
from volspark.sources import fixtures as fx

_VOL = "CAST(l_orderkey//4096 AS INT)"
_CELL = "CAST(l_orderkey%(32-4*(vol_id%3)) AS INT) i, CAST(l_partkey%(28+2*(vol_id%2)) AS INT) j, CAST(l_suppkey%(24-3*(vol_id%4)) AS INT) k"
_SIZE = [f"CAST(CAST(sqrt(affine[{c}]*affine[{c}]+affine[{c + 4}]*affine[{c + 4}]+affine[{c + 8}]*affine[{c + 8}]) AS FLOAT) AS DOUBLE)" for c in (1, 2, 3)]
_P = "vol_id, i, j, k"


def _first_most(cells: list[str]) -> str:
    return f"list_position([{','.join(cells)}],list_max([{','.join(cells)}]))-1"


_LEAN = [[f"abs(affine[{4 * r + c + 1}]/sqrt(affine[{c + 1}]*affine[{c + 1}]+affine[{c + 5}]*affine[{c + 5}]+affine[{c + 9}]*affine[{c + 9}]))" for r in range(3)] for c in range(3)]
_MOVED = ",".join(
    f"CASE WHEN [f0,f1,f2][s{c}+1] THEN -1 ELSE 1 END*affine[{4 * r}+s{c}+1]" if c < 3 else "+".join([f"affine[{4 * r + 4}]", *[f"CASE WHEN f{x} THEN affine[{4 * r + x + 1}]*({n}-1) ELSE 0e0 END" for x, n in enumerate(("nx", "ny", "nz"))]])
    for r in range(3)
    for c in range(4)
)
_CTE |= {
    "own_grid": "SELECT vol_id, CAST(32-4*(vol_id%3) AS INT) nx, CAST(28+2*(vol_id%2) AS INT) ny, CAST(24-3*(vol_id%4) AS INT) nz, CASE vol_id%3 WHEN 0 THEN [-sx,0e0,0e0,90e0,0e0,-0.8e0,0e0,80.5e0,0e0,0e0,sz,-7e0,0e0,0e0,0e0,1e0]"
    " WHEN 1 THEN [0e0,0.8e0,0e0,-3e0,0e0,0e0,-sz,12e0,sx,0e0,0e0,4.25e0,0e0,0e0,0e0,1e0] ELSE [sx*0.96e0,0.8e0*-0.28e0,0e0,1e0,sx*0.28e0,0.8e0*0.96e0,0e0,2e0,0e0,0e0,sz,3e0,0e0,0e0,0e0,1e0] END AS affine"
    f" FROM (SELECT vol_id, 0.7e0+0.1e0*(vol_id%3) sx, CASE WHEN vol_id%2=0 THEN 1.5e0 ELSE 5e0 END sz FROM (SELECT DISTINCT {_VOL} vol_id FROM lineitem))",
    "own_ct": f"SELECT vol_id, {_CELL}, CAST(max(40*l_quantity-1000) AS INT) v FROM (SELECT *, {_VOL} vol_id FROM lineitem) GROUP BY 1,2,3,4",
    "own_lab": f"SELECT vol_id, {_CELL}, CAST(max(p_size%6) AS INT) AS label FROM (SELECT *, {_VOL} vol_id FROM lineitem JOIN part ON l_partkey=p_partkey) GROUP BY 1,2,3,4",
    "own_plan": "SELECT vol_id, s0, s1, s2, f0, f1, f2, [nx,ny,nz][s0+1] mx, [nx,ny,nz][s1+1] my, [nx,ny,nz][s2+1] mz, nx, ny, nz, [" + _MOVED + ",0e0,0e0,0e0,1e0] AS moved FROM"
    " (SELECT *, " + ", ".join(f"CAST(CASE WHEN t0={r} THEN 0 WHEN t1={r} THEN 1 ELSE 2 END AS INT) s{r}, affine[4*t{r}+{r + 1}]<0 f{r}" for r in range(3))
    + " FROM (SELECT *, 3-t0-t1 t2 FROM (SELECT *, " + _first_most([f"CASE WHEN t0={r} THEN -1 ELSE {x} END" for r, x in enumerate(_LEAN[1])]) + " t1 FROM (SELECT *, " + _first_most(_LEAN[0]) + " t0 FROM own_grid))))",
    "own_box": "SELECT vol_id, CAST(greatest(li-CAST(trunc(2e0/x) AS INT),0) AS INT) lo_i, CAST(least(hi+CAST(trunc(2e0/x) AS INT),nx-1) AS INT) hi_i, CAST(greatest(lj-CAST(trunc(2e0/y) AS INT),0) AS INT) lo_j, CAST(least(hj+CAST(trunc(2e0/y) AS INT),ny-1) AS INT) hi_j, CAST(greatest(lk-CAST(trunc(2e0/z) AS INT),0) AS INT) lo_k, CAST(least(hk+CAST(trunc(2e0/z) AS INT),nz-1) AS INT) hi_k, affine a"
    f" FROM (SELECT g.*, b.* EXCLUDE (vol_id), {_SIZE[0]} x, {_SIZE[1]} y, {_SIZE[2]} z FROM own_grid g JOIN (SELECT vol_id, min(i) li, max(i) hi, min(j) lj, max(j) hj, min(k) lk, max(k) hk FROM own_lab WHERE label=5 AND i BETWEEN 3 AND 12 AND j BETWEEN 8 AND 20 AND k<9 AND vol_id%4<3 GROUP BY 1) b ON b.vol_id=g.vol_id)",
    "own_zoom": "SELECT vol_id, nx, ny, nz, CAST(20+vol_id%5 AS INT) mx, CAST(33 AS INT) my, CAST(5+vol_id%4*9 AS INT) mz FROM own_grid",
    "own_step": "SELECT vol_id, nx, ny, nz, CAST(round_even(nx*zx,0) AS INT) mx, CAST(round_even(ny*zy,0) AS INT) my, CAST(round_even(nz*zz,0) AS INT) mz, [" + ",".join(f"affine[{4 * r + c + 1}]" + (f"/z{'xyz'[c]}" if c < 3 and r < 3 else "") for r in range(4) for c in range(4)) + f"] AS moved FROM (SELECT *, {_SIZE[0]}/1.5e0 zx, 1e0 zy, CASE WHEN {_SIZE[2]}=1.5e0 THEN 1e0 ELSE {_SIZE[2]}/1.5e0 END zz FROM own_grid)",
}


def _linear(plan: str, grid: bool, src: str = "own_ct", key: str = "") -> str:
    """Order 1 of a table of voxels by the sizes of a plan; outputs with a voxel among their taps. key: one more column of the table."""

    def axis(n: str, m: str) -> str:
        c = "(o+0.5e0)*(n/m)-0.5e0" if grid else "o*CASE WHEN m>1 THEN (n-1)/(m-1) ELSE 1e0 END"
        return f"(SELECT vol_id, o, least(greatest(floor(c),0),n-1) p0, least(greatest(floor(c)+1,0),n-1) p1, 1e0-(c-floor(c)) w0, 1e0-(1e0-(c-floor(c))) w1 FROM (SELECT *, {c} c FROM (SELECT vol_id, CAST({n} AS DOUBLE) n, CAST({m} AS DOUBLE) m, unnest(range({m})) o FROM {plan})))"

    taps = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    total = "+".join(f"coalesce(t{a}{b}{c}.v*x.w{a}*y.w{b}*z.w{c},0e0)" for a, b, c in taps)
    joins = " ".join(f"LEFT JOIN {src} t{a}{b}{c} ON t{a}{b}{c}.vol_id=x.vol_id AND{f" t{a}{b}{c}.{key}=e.{key} AND" if key else ""} t{a}{b}{c}.i=x.p{a} AND t{a}{b}{c}.j=y.p{b} AND t{a}{b}{c}.k=z.p{c}" for a, b, c in taps)
    some = " OR ".join(f"t{a}{b}{c}.v IS NOT NULL" for a, b, c in taps)
    every = f"JOIN (SELECT DISTINCT vol_id, {key} FROM {src}) e ON e.vol_id=x.vol_id" if key else ""
    return f"SELECT x.vol_id, CAST(x.o AS INT) AS i, CAST(y.o AS INT) AS j, CAST(z.o AS INT) AS k, {f'e.{key}, ' if key else ''}{total} AS v FROM {axis('nx', 'mx')} x {every} JOIN {axis('ny', 'my')} y ON y.vol_id=x.vol_id JOIN {axis('nz', 'mz')} z ON z.vol_id=x.vol_id {joins} WHERE {some}"


def _zoom_plan(spark, d):
    vol = F.col("vol_id")
    sizes = {"mx": 20 + vol % 5, "my": F.lit(33), "mz": 5 + vol % 4 * 9}
    return fx.grids(spark, d).withColumns({m: c.cast("int") for m, c in sizes.items()})


@_query(f"SELECT vol_id, nx, ny, nz, affine, {_SIZE[0]} zx, {_SIZE[1]} zy, {_SIZE[2]} zz FROM own_grid")
def grid_zooms(spark, d):
    sizes = geometry.zooms(F.col("affine"))
    return fx.grids(spark, d).withColumns(dict(zip(("zx", "zy", "zz"), sizes, strict=True)))


@_query("SELECT * EXCLUDE (nx, ny, nz) FROM own_plan")
def grid_canonical_plan(spark, d):
    return geometry.canonical_plan(fx.grids(spark, d)).drop("nx", "ny", "nz", "affine", "problem")


_OLD = "[CASE WHEN f0 THEN nx-1-i ELSE i END, CASE WHEN f1 THEN ny-1-j ELSE j END, CASE WHEN f2 THEN nz-1-k ELSE k END]"


@_query(f"SELECT c.vol_id, {_OLD}[s0+1] AS i, {_OLD}[s1+1] AS j, {_OLD}[s2+1] AS k, v FROM own_ct c JOIN own_plan p ON p.vol_id=c.vol_id")
def grid_reorient(spark, d):
    return geometry.reoriented(fx.own_ct(spark, d), geometry.canonical_plan(fx.grids(spark, d)))


def _boxes(spark, d):
    mask = fx.own_labels(spark, d).where("label = 5 and i between 3 and 12 and j between 8 and 20 and k < 9 and vol_id % 4 < 3")
    return geometry.crop_grids(mask, fx.grids(spark, d), 2.0)


@_query("SELECT vol_id, hi_i-lo_i+1 nx, hi_j-lo_j+1 ny, hi_k-lo_k+1 nz, lo_i, lo_j, lo_k, [" + ",".join([f"a[{4 * r + c + 1}]" if c < 3 else f"a[{4 * r + 1}]*lo_i+a[{4 * r + 2}]*lo_j+a[{4 * r + 3}]*lo_k+a[{4 * r + 4}]" for r in range(3) for c in range(4)]) + ",a[13],a[14],a[15],a[16]] AS affine FROM own_box")
def grid_crop_boxes(spark, d):
    return _boxes(spark, d)


_INBOX = "i BETWEEN lo_i AND hi_i AND j BETWEEN lo_j AND hi_j AND k BETWEEN lo_k AND hi_k"


@_query(f"SELECT c.vol_id, i-lo_i AS i, j-lo_j AS j, k-lo_k AS k, v FROM own_ct c JOIN own_box b ON b.vol_id=c.vol_id WHERE {_INBOX}")
def grid_crop(spark, d):
    return geometry.cropped(fx.own_ct(spark, d), fx.grids(spark, d), _boxes(spark, d))


@_query(f"SELECT c.vol_id, i, j, k, v FROM own_ct c JOIN own_box b ON b.vol_id=c.vol_id WHERE {_INBOX}")
def grid_uncrop(spark, d):
    boxes = _boxes(spark, d)
    return geometry.uncropped(geometry.cropped(fx.own_ct(spark, d), fx.grids(spark, d), boxes), boxes)


def _nearest(plan: str, src: str) -> str:
    """Order 0 of a table of labels."""
    return f"SELECT l.vol_id, CAST(x.o AS INT) AS i, CAST(y.o AS INT) AS j, CAST(z.o AS INT) AS k, label FROM {src} l" + "".join(f" JOIN (SELECT vol_id, o, least(floor(o*CASE WHEN m>1 THEN (n-1)/(m-1) ELSE 1e0 END+0.5e0),n-1) p FROM (SELECT vol_id, CAST({n} AS DOUBLE) n, CAST({m} AS DOUBLE) m, unnest(range({m})) o FROM {plan})) {t} ON {t}.vol_id=l.vol_id AND {t}.p={c}" for t, c, n, m in (("x", "i", "nx", "mx"), ("y", "j", "ny", "my"), ("z", "k", "nz", "mz")))


@_query(_nearest("own_zoom", "own_lab"))
def grid_zoom_nearest(spark, d):
    return geometry.zoomed(fx.own_labels(spark, d), _zoom_plan(spark, d), 0, value="label")


@_query(_linear("own_zoom", False))
def grid_zoom_linear(spark, d):
    return geometry.zoomed(fx.own_ct(spark, d), _zoom_plan(spark, d), 1)


@_query(_linear("own_zoom", True))
def grid_zoom_cells(spark, d):
    """Order 1 in grid mode."""
    return geometry.zoomed(fx.own_ct(spark, d), _zoom_plan(spark, d), 1, grid=True)


@_query(f"SELECT {_P}, CAST(trunc(v) AS INT) AS v FROM ({_linear('own_step', False)})")
def grid_to_spacing(spark, d):
    return geometry.to_spacing(fx.own_ct(spark, d), fx.grids(spark, d), (1.5, 0.0, 1.5), 1)[0]


@_query("SELECT vol_id, mx AS nx, my AS ny, mz AS nz, moved AS affine FROM own_step")
def grid_to_spacing_plan(spark, d):
    return geometry.to_spacing(fx.own_ct(spark, d), fx.grids(spark, d), (1.5, 0.0, 1.5), 1)[1]


@_query(None)
def grid_model_input(spark, d):
    return geometry.model_input(shared(fx.own_ct(spark, d)), fx.grids(spark, d), (1.2, 1.2, 2.0))[0]


@_query(
    "SELECT vol_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list(CAST(b AS BIGINT) ORDER BY p)), lambda h, b: (xor(h,b)*16777619) & 4294967295) AS hash"
    " FROM (SELECT c.vol_id, p, coalesce(label,0) b FROM (SELECT vol_id, ny, nz, unnest(range(nx*ny*nz)) p FROM own_grid) c LEFT JOIN own_lab l ON l.vol_id=c.vol_id AND (l.i*ny+l.j)*nz+l.k=p) GROUP BY vol_id"
)
def grid_label_hash(spark, d):
    return hashing.dense_hash(fx.own_labels(spark, d), fx.grids(spark, d))


@_query(None)
def grid_component_sizes(spark, d):
    return components.sizes(components.components(fx.own_labels(spark, d), components.BOUND))


def _own_starts(n: str, t: int, c: str) -> str:
    return f"(SELECT vol_id, m n{c}, t t{c}, CAST(CASE WHEN m>1 THEN round_even(greatest({n}-{t},0)/CAST(m-1 AS DOUBLE)*t,0) ELSE 0 END AS INT) s{c} FROM (SELECT *, unnest(range(m)) t FROM (SELECT vol_id, {n}, CAST(ceil(greatest({n}-{t},0)/({t}*0.5e0))+1 AS INT) m FROM own_grid)))"


@_query(f"SELECT a.vol_id, CAST((ti*nj+tj)*nk+tk AS INT) AS tile, si, sj, sk FROM {_own_starts('nx', 12, 'i')} a JOIN {_own_starts('ny', 30, 'j')} b ON b.vol_id=a.vol_id JOIN {_own_starts('nz', 10, 'k')} c ON c.vol_id=a.vol_id")
def tile_list(spark, d):
    return tiles.tile_list(fx.grids(spark, d), (12, 30, 10), 0.5)
