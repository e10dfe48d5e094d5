"""Queries that build volumes from slices, and their SQL. Registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from volspark.operators import building, geometry
from volspark.plans.catalogue import _CTE, _query
from volspark.sources import fixtures as fx

_F32 = "CAST(CAST({} AS FLOAT) AS DOUBLE)"
_CTE |= {
    "img": "SELECT CAST(l_orderkey AS VARCHAR) vol_id, l_orderkey key, l_linenumber line, l_linenumber||'_'||l_partkey||'_'||l_suppkey AS file, l_discount>=0.09 loc, CASE WHEN l_tax>0.07 THEN 6 ELSE 4 END cols, CASE WHEN l_orderkey%7<>0 THEN [CAST(l_orderkey%9 AS DOUBLE), CASE WHEN l_orderkey%11=0 THEN l_linenumber*0.5e0 ELSE -3.5e0 END, l_linenumber*2.5e0] END ipp,"
    " list_concat(CASE WHEN l_orderkey%4=1 THEN [0.96e0,0.28e0,0e0,-0.28e0,0.96e0] ELSE [1e0,0e0,0e0,0e0,1e0] END, [CASE WHEN l_orderkey%5=0 AND l_linenumber=2 THEN 0.001e0 ELSE 0e0 END]) iop, CASE WHEN l_orderkey%2=0 THEN 2.5e0 ELSE 1e0 END th, l_partkey, l_suppkey FROM lineitem",
    "img_size": "SELECT vol_id, cols FROM (SELECT vol_id, cols, row_number() OVER (PARTITION BY vol_id ORDER BY count(*) DESC, cols) r FROM img WHERE NOT loc GROUP BY 1,2) WHERE r=1",
    "img_use": "SELECT i.*, count(*) OVER (PARTITION BY i.vol_id) n, count(ipp) OVER (PARTITION BY i.vol_id)=count(*) OVER (PARTITION BY i.vol_id) have, first_value(iop) OVER (PARTITION BY i.vol_id ORDER BY file) f FROM img i JOIN img_size s ON s.vol_id=i.vol_id AND s.cols=i.cols WHERE NOT loc",
    "img_pos": "SELECT *, row_number() OVER (PARTITION BY vol_id ORDER BY CASE WHEN have THEN ipp[1]*nn[1]+ipp[2]*nn[2]+ipp[3]*nn[3] ELSE line END, file)-1 AS k FROM (SELECT *, [f[2]*f[6]-f[3]*f[5], f[3]*f[4]-f[1]*f[6], f[1]*f[5]-f[2]*f[4]] nn FROM img_use)",
    "img_gap": "SELECT *, CASE WHEN have THEN list_sum(list_transform([1,2,3], lambda x: (ipp[x]-before[x])*nn[x])) END d FROM (SELECT *, lag(ipp) OVER (PARTITION BY vol_id ORDER BY k) before FROM img_pos)",
    "img_sum": "SELECT a.vol_id, a.key, coalesce(n,0) n, a.files-coalesce(n,0) others, have, f, nn, cols, th, lo, hi, dmin, dmax, ds, CASE WHEN coalesce(n,0)<2 THEN 'fewer than 2 slices' WHEN turned THEN 'slices with different orientations' WHEN have AND dmin<=0 THEN 'duplicate slice positions' END problem FROM (SELECT vol_id, key, count(*) files FROM img GROUP BY 1,2) a"
    " LEFT JOIN (SELECT vol_id, count(*) n, bool_and(have) have, any_value(f) f, any_value(nn) nn, any_value(cols) cols, any_value(th) th, arg_min(ipp,k) lo, arg_max(ipp,k) hi, min(d) dmin, max(d) dmax, sum(d) ds, bool_or(list_max(list_transform(range(1,7), lambda x: abs(iop[x]-f[x])))>1e-4) turned FROM img_gap GROUP BY 1) g ON g.vol_id=a.vol_id",
    "img_step": "SELECT *, CASE WHEN have THEN [(hi[1]-lo[1])/(n-1),(hi[2]-lo[2])/(n-1),(hi[3]-lo[3])/(n-1)] ELSE [nn[1]*th,nn[2]*th,nn[3]*th] END st FROM img_sum",
}
_ROWS = ",".join(_F32.format(("-" if x < 3 else "") + f"({c})") for x in (1, 2, 3) for c in (f"f[{x}]*(0.75e0+0.25e0*(key%3))", f"f[{x + 3}]*0.5e0", f"st[{x}]", f"coalesce(lo[{x}],0e0)"))
_SAID = [
    "CASE WHEN others>0 THEN others||' localizers or images of other sizes ignored' END", "CASE WHEN NOT have THEN 'no positions, sorted by instance' END", "CASE WHEN have AND dmax-dmin>0.05e0*abs(ds/(n-1))+1e-3 THEN 'uneven gaps' END",
    "CASE WHEN have AND problem IS NULL AND abs(st[1]*nn[1]+st[2]*nn[2]+st[3]*nn[3])/sqrt(st[1]*st[1]+st[2]*st[2]+st[3]*st[3])<cos(0.5e0*3.14159265358979e0/180e0) THEN 'tilted stack' END", "CASE WHEN NOT have THEN 'gap taken from the slice thickness' END",
]


@_query(f"SELECT vol_id, CAST(cols AS INT) nx, CASE WHEN n>0 THEN 3 END ny, CAST(n AS INT) nz, CASE WHEN problem IS NULL THEN [{_ROWS},0e0,0e0,0e0,1e0] END AS affine, problem FROM img_step")
def build_grids(spark, d):
    return building.volume_grids(fx.images(spark, d)).drop("warnings")


@_query(f"SELECT vol_id, warning FROM (SELECT vol_id, unnest([{','.join(_SAID)}]) warning FROM img_step) WHERE warning IS NOT NULL")
def build_warnings(spark, d):
    return building.volume_grids(fx.images(spark, d)).select("vol_id", F.explode("warnings").alias("warning"))


_WORD = "(l_partkey*7+l_suppkey*13+q*q*911+line*31)%65536"
_STORED = f"({_WORD})&(CASE WHEN key%2=0 THEN 4095 ELSE 65535 END)"
_VALUE = f"CAST(CAST(((CASE WHEN key%3=0 AND w>=CASE WHEN key%2=0 THEN 2048 ELSE 32768 END THEN w-CASE WHEN key%2=0 THEN 4096 ELSE 65536 END ELSE w END)*CASE WHEN key%4=0 THEN 0.5e0 ELSE 1e0 END)-1024e0 AS FLOAT) AS DOUBLE)"


@_query(f"SELECT vol_id, CAST(p%cols AS INT) i, CAST(p//cols AS INT) j, CAST(k AS INT) k, {_VALUE} AS v FROM (SELECT *, {_STORED} w FROM (SELECT *, CASE WHEN p>=12 THEN p-12 ELSE p END q FROM (SELECT g.*, unnest(range(g.cols*3)) p FROM img_gap g JOIN img_sum s ON s.vol_id=g.vol_id AND s.problem IS NULL)))")
def build_voxels(spark, d):
    slices = fx.images(spark, d)
    return building.built(slices, building.volume_grids(slices))


@_query(None)
def build_canonical(spark, d):
    """Built volumes in the nearest orientation to right, front, up."""
    slices = fx.images(spark, d)
    grids = building.volume_grids(slices).where("problem is null")
    return geometry.reoriented(building.built(slices, grids), geometry.canonical_plan(grids.select("vol_id", "nx", "ny", "nz", "affine")))
