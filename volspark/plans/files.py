"""Queries of files' pieces, imported label maps and the edit history, and their SQL. Registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from volspark.operators import geometry, history
from volspark.operators.graph import shared
from volspark.plans import grids  # noqa: F401
from volspark.plans.catalogue import _CTE, _query
from volspark.sources import fixtures as fx
from volspark.sources import labelmaps, sinks

STEPS, BYTES = 4, 60
_POPPED = "list_slice({0},1,len({0})-1)"
_KEPT = f"list_filter(list_append(w.u,{{'s':a.seq,'b':6*a.n}}), lambda x, q: q=len(w.u)+1 OR (len(w.u)+1-q<{STEPS} AND list_sum(list_transform(list_append(w.u,{{'s':a.seq,'b':6*a.n}})[q:], lambda y: y.b))<={BYTES}))"
_CTE |= {
    "hist_act": "SELECT user_id vol_id, row_number() OVER (PARTITION BY user_id ORDER BY ts,event_id) seq, CASE WHEN event_id%7<4 THEN 'edit' WHEN event_id%7<6 THEN 'undo' ELSE 'redo' END AS action, 1+event_id%3 AS n, event_id FROM events",
    "hist_walk": "WITH RECURSIVE walk AS (SELECT DISTINCT vol_id, CAST(0 AS BIGINT) seq, '' AS action, CAST(NULL AS BIGINT) target, CAST([] AS STRUCT(s BIGINT, b BIGINT)[]) u, CAST([] AS STRUCT(s BIGINT, b BIGINT)[]) r FROM hist_act UNION ALL"
    f" SELECT a.vol_id, a.seq, a.action, CASE a.action WHEN 'edit' THEN a.seq WHEN 'undo' THEN w.u[len(w.u)].s ELSE w.r[len(w.r)].s END, CASE WHEN a.action='edit' THEN {_KEPT} WHEN a.action='undo' THEN {_POPPED.format('w.u')} WHEN len(w.r)>0 THEN list_append(w.u,w.r[len(w.r)]) ELSE w.u END,"
    f" CASE WHEN a.action='edit' THEN [] WHEN a.action='redo' THEN {_POPPED.format('w.r')} WHEN len(w.u)>0 THEN list_append(w.r,w.u[len(w.u)]) ELSE w.r END FROM walk w JOIN hist_act a ON a.vol_id=w.vol_id AND a.seq=w.seq+1) SELECT * FROM walk WHERE seq>0",
    "hist_span": "SELECT vol_id, target AS edit, seq AS since, until FROM (SELECT *, lead(seq) OVER (PARTITION BY vol_id, target ORDER BY seq) until FROM hist_walk WHERE target IS NOT NULL) WHERE action<>'undo'",
}


def _steps(spark, d):
    return history.walked(fx.actions(spark, d), STEPS, BYTES)


@_query("SELECT vol_id, seq, action, target, CAST(len(u) AS BIGINT) undos, CAST(len(r) AS BIGINT) redos FROM hist_walk")
def history_steps(spark, d):
    return _steps(spark, d)


@_query("SELECT * FROM hist_span")
def history_intervals(spark, d):
    return history.intervals(_steps(spark, d))


_VOXELS = "SELECT h.vol_id, h.seq, (event_id+5*x)%16 p, event_id%5 AS label FROM hist_act h, (VALUES (0),(1),(2)) t(x) WHERE x<n AND action='edit'"


@_query(f"SELECT vol_id, CAST(p%4 AS INT) i, CAST(p//4 AS INT) j, CAST(vol_id%3 AS INT) k, CAST(arg_max(label,seq) AS INT) AS label, max(seq) AS edit FROM ({_VOXELS}) v JOIN hist_span s USING (vol_id) WHERE s.edit=v.seq AND s.until IS NULL GROUP BY vol_id, p")
def history_voxels(spark, d):
    """The map of edits after the whole log."""
    return history.edited_voxels(fx.edit_voxels(fx.actions(spark, d)), history.intervals(shared(_steps(spark, d))))


@_query("SELECT g.vol_id, CAST(g.k AS BIGINT) AS at, string_agg(printf('%02X', coalesce(l.label,0)), '' ORDER BY g.j, g.i) AS content FROM (SELECT vol_id, i, j, k FROM own_grid, range(nx) a(i), range(ny) b(j), range(nz) c(k)) g LEFT JOIN own_lab l ON l.vol_id=g.vol_id AND l.i=g.i AND l.j=g.j AND l.k=g.k GROUP BY 1,2")
def nifti_planes(spark, d):
    """The bytes of every plane of the label images that `sinks.nifti_pieces` writes, as hexadecimal digits."""
    out = sinks.planes(fx.own_labels(spark, d), fx.grids(spark, d), "label", "kji", "u1")
    return out.select("vol_id", "at", F.hex("content").alias("content"))


_CTE |= {
    "imp_cell": "SELECT x||l.vol_id AS file, l.vol_id, l.i, l.j, l.k, label+CASE WHEN x='f' OR l.i%2=0 THEN 0.0004e0 WHEN l.vol_id%2=1 THEN 0.5e0 ELSE 300e0 END v FROM own_lab l, (VALUES ('f'),('g')) t(x)",
    "imp_bad": "SELECT c.file, p.vol_id, CASE WHEN p.vol_id%8=2 THEN 'no such volume' WHEN off THEN 'label values that are not whole numbers from 0 to 255' WHEN most>=255.5 THEN 'label values over 255' WHEN p.vol_id%4=3 THEN 'grid '||mx||'x'||my||'x'||mz||' instead of '||mx||'x'||my||'x'||(mz+1) END AS problem"
    " FROM own_plan p JOIN (SELECT file, vol_id, bool_or(abs(v-floor(v+0.5e0))>1e-3) off, max(v) most FROM imp_cell GROUP BY 1,2) c ON c.vol_id=p.vol_id",
    "imp_lab": "SELECT p.file, p.vol_id, [o0,o1,o2][s0+1] AS i, [o0,o1,o2][s1+1] AS j, [o0,o1,o2][s2+1] AS k, CAST(floor(v+0.5e0) AS INT) AS label FROM (SELECT c.file, c.vol_id, v, s0, s1, s2, CASE WHEN f0 THEN nx-1-i ELSE i END o0, CASE WHEN f1 THEN ny-1-j ELSE j END o1, CASE WHEN f2 THEN nz-1-k ELSE k END o2 FROM imp_cell c JOIN own_plan q ON q.vol_id=c.vol_id) p JOIN imp_bad b ON b.file=p.file WHERE b.problem IS NULL AND v>=0.5e0",
    "imp_name": "SELECT file, vol_id, label, CASE WHEN vol_id%7<>6 AND vol_id%3<2 AND label=1 THEN 'one' WHEN vol_id%7<>6 AND vol_id%3<2 AND label=3 THEN 'lever' ELSE 'label_'||label END AS name FROM (SELECT DISTINCT file, vol_id, label FROM imp_lab)",
}


def _imported(spark, d):
    files, cells, grids, sidecars = fx.label_files(spark, d)
    plan = geometry.canonical_plan(fx.grids(spark, d)).select("vol_id", "mx", "my", "mz")
    targets = plan.where("vol_id % 8 <> 2").select("vol_id", F.col("mx").alias("nx"), F.col("my").alias("ny"), F.when(F.col("vol_id") % 4 == 3, F.col("mz") + 1).otherwise(F.col("mz")).alias("nz"))
    return *labelmaps.imported(files, shared(cells), grids, targets), sidecars


@_query("SELECT * FROM imp_bad WHERE problem IS NOT NULL")
def label_import_refusals(spark, d):
    return _imported(spark, d)[1]


@_query("SELECT * FROM imp_lab")
def label_import_voxels(spark, d):
    return _imported(spark, d)[0]


@_query("SELECT n.file, n.vol_id, n.label, n.name, CAST(CASE n.name WHEN 'label_4' THEN 1 WHEN 'lever' THEN 2 ELSE 2+row_number() OVER (PARTITION BY n.vol_id, n.name IN ('label_4','lever') ORDER BY n.label) END AS INT) AS new FROM imp_name n")
def label_import_ids(spark, d):
    """Imported labels under the ids of volumes that have label_4 and lever already."""
    cells, _, sidecars = _imported(spark, d)
    names = labelmaps.label_names(shared(cells), labelmaps.sidecar_labels(sidecars))
    have = names.select("vol_id").distinct().select("vol_id", F.inline(F.array(*[F.struct(F.lit(n).alias("label"), F.lit(x).alias("name")) for n, x in ((1, "label_4"), (2, "lever"))])))
    return labelmaps.ids(names, have)[0]
