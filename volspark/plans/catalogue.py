"""name -> Spark query over the driver's tables, and name -> the SQL that gives the same rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from volspark.functions.numeric import half
from volspark.operators import components, hashing, images, labels, mesh, planning, registry, resample, series, tiles, verify
from volspark.sources import fixtures as fx

SHAPE = fx.SHAPE
SPACING = (0.8, 0.8, 1.5)
TILE, STEP = (12, 12, 10), 0.5
AFFINE = [0.0, -0.8, 0.0, 10.0, 0.8, 0.0, 0.0, -20.0, 0.0, 0.0, 1.5, 5.0, 0.0, 0.0, 0.0, 1.0]

_VOXEL = "CAST(l_orderkey//4096 AS INT) vol_id, CAST(l_orderkey%32 AS INT) i, CAST(l_partkey%32 AS INT) j, CAST(l_suppkey%24 AS INT) k"
_P, _ON = "vol_id, i, j, k", "x.vol_id=y.vol_id AND x.i=y.i AND x.j=y.j AND x.k=y.k"
_LABELS = f"SELECT {_VOXEL}, CAST({{}}(p_size%6) AS INT) AS label FROM lineitem JOIN part ON l_partkey=p_partkey GROUP BY 1,2,3,4"
_CTE = {
    "fx_ct": f"SELECT {_VOXEL}, CAST(max(40*l_quantity-1000) AS INT) hu FROM lineitem GROUP BY 1,2,3,4",
    "fx_lab": _LABELS.format("max"),
    "fx_lab2": _LABELS.format("min"),
    "fx_names": "SELECT CAST(r_regionkey AS INT) AS label, lower(r_name) AS name FROM region",
    "fx_slices": "SELECT o_custkey study, CAST(l_orderkey AS VARCHAR) series_uid, CASE WHEN o_orderpriority='1-URGENT' THEN 'Portal venous' ELSE o_orderpriority END AS description, CASE WHEN o_orderstatus='P' THEN 'MR' ELSE 'CT' END modality,"
    " CASE WHEN l_returnflag='R' THEN 256 ELSE 512 END nrows, CASE WHEN l_linestatus='O' THEN 512 ELSE 256 END ncols, l_discount>=0.09 localizer, CASE WHEN l_orderkey%5=0 AND l_linenumber=2 THEN 0.001e0 ELSE 0e0 END tilt,"
    " CASE WHEN l_orderkey%7<>0 THEN 5e0*l_linenumber END pos, l_linenumber AS instance, l_linenumber||'_'||l_partkey||'_'||l_suppkey AS file FROM lineitem JOIN orders ON l_orderkey=o_orderkey",
    "fx_runs": "SELECT *, case_id*10+task+CASE WHEN case_id%5=0 AND rep=2 THEN 1 ELSE 0 END+CASE WHEN case_id%3=0 AND path='cpu' THEN 2 ELSE 0 END AS hash FROM (SELECT event_type environment, CASE WHEN event_id%4<2 THEN 'cpu' ELSE 'webgpu' END path, user_id case_id, event_id%3 task, row_number() OVER (PARTITION BY event_type,user_id,event_id%3 ORDER BY ts,event_id) rep, value AS secs FROM events)",
    "fx_want": "SELECT case_id, task, path, max(hash) AS want FROM fx_runs WHERE case_id%2=0 AND rep=1 GROUP BY 1,2,3",
    "fx_both": "SELECT coalesce(x.vol_id,y.vol_id) vol_id, coalesce(x.i,y.i) i, coalesce(x.j,y.j) j, coalesce(x.k,y.k) k, coalesce(x.label,0) a, coalesce(y.label,0) b FROM fx_lab x FULL JOIN fx_lab2 y ON x.vol_id=y.vol_id AND x.i=y.i AND x.j=y.j AND x.k=y.k",
    "modal": "SELECT series_uid, nrows, ncols, n FROM (SELECT *, row_number() OVER (PARTITION BY series_uid ORDER BY n DESC, nrows, ncols) r FROM (SELECT series_uid, nrows, ncols, count(*) n FROM fx_slices WHERE NOT localizer GROUP BY 1,2,3)) WHERE r=1",
    "used": "SELECT s.*, pos-lag(pos) OVER (PARTITION BY s.series_uid ORDER BY pos, file) d FROM fx_slices s JOIN modal m ON s.series_uid=m.series_uid AND s.nrows=m.nrows AND s.ncols=m.ncols WHERE NOT localizer",
    "firsts": "SELECT series_uid, study, description, modality FROM (SELECT s.*, row_number() OVER (PARTITION BY s.series_uid ORDER BY u.series_uid IS NULL, s.file, s.study, s.description, s.modality) r FROM fx_slices s LEFT JOIN (SELECT DISTINCT series_uid, file FROM used) u ON u.series_uid=s.series_uid AND u.file=s.file) WHERE r=1",
    "cat": "SELECT f.study, f.series_uid, f.description, f.modality, coalesce(u.n,0) n_slices, t.total-coalesce(u.n,0) AS n_others, ds[len(ds)//2+1] AS gap, CASE WHEN len(ds)>0 THEN hi-lo END AS extent, least_gap, CASE WHEN least_gap<=1e-6 THEN 'duplicate slice positions' WHEN u.n>=2 AND t1-t0>1e-4 THEN 'slices with different orientations' WHEN coalesce(u.n,0)=0 THEN 'localizer only' WHEN u.n<2 THEN 'single image' END AS problem"
    " FROM firsts f JOIN (SELECT series_uid, count(*) total FROM fx_slices GROUP BY 1) t ON f.series_uid=t.series_uid LEFT JOIN (SELECT series_uid, count(*) n, min(d) least_gap, list_sort(list(d) FILTER (d IS NOT NULL)) ds, min(pos) lo, max(pos) hi, min(tilt) t0, max(tilt) t1 FROM used GROUP BY 1) u ON u.series_uid=f.series_uid",
    "ranked": "SELECT *, row_number() OVER (PARTITION BY study ORDER BY problem IS NOT NULL, modality<>'CT', n_slices DESC, series_uid) AS place FROM cat",
    "inside": "SELECT vol_id, greatest(min(i)-2,0) li, least(max(i)+2,31) hi, greatest(min(j)-2,0) lj, least(max(j)+2,31) hj, greatest(min(k)-1,0) lk, least(max(k)+1,23) hk FROM fx_lab WHERE label=5 AND i BETWEEN 6 AND 12 AND j BETWEEN 8 AND 20 AND k<9 GROUP BY 1",
    "fx_cls": "SELECT 'task' kind, 'total' AS owner, CAST(n_nationkey+1 AS INT) idx, lower(replace(n_name,' ','_')) AS name FROM nation UNION ALL SELECT 'part', CAST(n_regionkey+291 AS VARCHAR), CAST(n_nationkey%5+1+n_nationkey//5*5 AS INT), lower(replace(n_name,' ','_')) FROM nation",
    "fx_ver": "SELECT CAST(c_custkey//30 AS INT) mesh_id, CAST(c_custkey%30 AS INT) vid, CAST(c_custkey*3%17 AS DOUBLE) x, CAST(c_custkey*5%23 AS DOUBLE) y, CAST(c_custkey*7%29 AS DOUBLE) z FROM customer",
    "fx_tri": "SELECT mesh_id, vid AS tid, vid AS a, vid+1 AS b, CAST(vid*7%29 AS INT) AS c FROM fx_ver WHERE vid BETWEEN 1 AND 27",
    "pts": "SELECT t.mesh_id, t.tid, t.a, t.b, t.c, p.x ax, p.y ay, p.z az, q.x bx, q.y b_y, q.z bz, r.x cx, r.y cy, r.z cz FROM fx_tri t JOIN fx_ver p ON p.mesh_id=t.mesh_id AND p.vid=t.a JOIN fx_ver q ON q.mesh_id=t.mesh_id AND q.vid=t.b JOIN fx_ver r ON r.mesh_id=t.mesh_id AND r.vid=t.c",
    "facets": "SELECT *, (b_y-ay)*(cz-az)-(bz-az)*(cy-ay) u, (bz-az)*(cx-ax)-(bx-ax)*(cz-az) v, (bx-ax)*(cy-ay)-(b_y-ay)*(cx-ax) w FROM pts",
}

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _needs(sql: str) -> list[str]:
    found: list[str] = []
    for name, body in _CTE.items():
        if name in sql.replace(",", " ").replace("(", " ").replace(")", " ").split():
            found += [x for x in [*_needs(body), name] if x not in found]
    return found


def _query(sql: str | None):
    """Registers a query under its function's name."""

    def take(f):
        QUERIES[f.__name__] = f
        if sql:
            names = _needs(sql)
            ORACLE_SQL[f.__name__] = ("WITH " + ", ".join(f"{n} AS ({_CTE[n]})" for n in names) + " " if names else "") + sql
        return f

    return take


@_query("SELECT vol_id, label, count(*) n FROM fx_lab GROUP BY 1,2")
def label_histogram(spark, d):
    return labels.histogram(fx.labels(spark, d))


@_query("SELECT vol_id, l.label, coalesce(n.name, 'label_'||l.label) AS name, count(*) n, count(*)*0.8e0*0.8e0*1.5e0/1000e0 AS ml FROM fx_lab l LEFT JOIN fx_names n ON n.label=l.label GROUP BY 1,2,3")
def label_volumes(spark, d):
    return labels.volumes(fx.labels(spark, d), SPACING, fx.names(spark, d))


@_query(f"SELECT {_P}, CASE WHEN label IN (1,3) THEN label ELSE 0 END AS label FROM fx_lab")
def label_keep_filter(spark, d):
    return labels.keep(fx.labels(spark, d), [1, 3])


@_query(f"SELECT x.vol_id, x.i, x.j, x.k, CASE y.label WHEN 3 THEN 3 WHEN 5 THEN 4 ELSE CASE x.label WHEN 1 THEN 1 WHEN 2 THEN 2 ELSE 0 END END AS label FROM fx_lab x JOIN fx_lab2 y ON {_ON}")
def label_remap_merge(spark, d):
    parts = fx.labels(spark, d).withColumn("part", F.lit(0)).unionByName(fx.labels(spark, d, F.min).withColumn("part", F.lit(1)))
    return labels.overlay(parts, spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 3), (1, 5, 4)], "part int, label int, task_label int"))


@_query(f"SELECT {_P}, CAST(label IN (2,4) AS INT) AS mask FROM fx_lab")
def label_union_mask(spark, d):
    return labels.mask(fx.labels(spark, d), [2, 4])


@_query("SELECT vol_id, bool_or(label>0) AS some FROM fx_lab GROUP BY 1")
def any_label(spark, d):
    return labels.any_label(fx.labels(spark, d))


_BOX = "min(i) lo_i, max(i) hi_i, min(j) lo_j, max(j) hi_j, min(k) lo_k, max(k) hi_k"


@_query(f"SELECT vol_id, label, {_BOX} FROM fx_lab GROUP BY 1,2")
def bbox_per_label(spark, d):
    return labels.boxes(fx.labels(spark, d), "label")


@_query(
    f"SELECT v.vol_id, coalesce(lo_i,0) lo_i, coalesce(hi_i,31) hi_i, coalesce(lo_j,0) lo_j, coalesce(hi_j,31) hi_j, coalesce(lo_k,0) lo_k, coalesce(hi_k,23) hi_k FROM (SELECT DISTINCT vol_id FROM fx_lab) v LEFT JOIN (SELECT vol_id, {_BOX} FROM fx_lab WHERE label=5 AND vol_id%2=0 AND i>20 GROUP BY 1) b ON b.vol_id=v.vol_id"
)
def crop_to_nonzero(spark, d):
    some = (F.col("label") == 5) & (F.col("vol_id") % 2 == 0) & (F.col("i") > 20)
    return labels.nonzero_boxes(fx.labels(spark, d).withColumn("label", F.when(some, 5).otherwise(0)), SHAPE)


def _box(spark, d):
    own = fx.labels(spark, d).where("label = 5 and i between 6 and 12 and j between 8 and 20 and k < 9")
    return labels.grown(labels.boxes(own), tuple(int(2 / s) for s in SPACING), SHAPE)


_IN = "i BETWEEN li AND hi AND j BETWEEN lj AND hj AND k BETWEEN lk AND hk"


@_query(f"SELECT c.vol_id, i-li AS i, j-lj AS j, k-lk AS k, hu FROM fx_ct c JOIN inside b ON b.vol_id=c.vol_id WHERE {_IN}")
def crop_with_margin(spark, d):
    return labels.cropped(fx.ct(spark, d), _box(spark, d))


@_query(f"SELECT l.vol_id, i, j, k, CASE WHEN {_IN} AND label IN (2,5) THEN label ELSE 0 END AS label FROM fx_lab l LEFT JOIN inside b ON b.vol_id=l.vol_id")
def uncrop_paste(spark, d):
    lab, box = fx.labels(spark, d), _box(spark, d)
    return labels.pasted(lab, labels.cropped(lab, box), box, [2, 5])


@_query("SELECT vol_id, i+4 AS i, j AS j, k+20 AS k, hu FROM fx_ct")
def pad_to_patch(spark, d):
    return labels.padded(fx.ct(spark, d), SHAPE, (40, 32, 64))


@_query(f"SELECT {_P}, CAST((least(greatest(CAST(hu AS FLOAT),CAST(-900 AS FLOAT)),CAST(800 AS FLOAT))-CAST(12.5 AS FLOAT))/CAST(300.25 AS FLOAT) AS DOUBLE) AS v FROM fx_ct")
def ct_normalise_f32(spark, d):
    return images.normalised(fx.ct(spark, d), -900.0, 800.0, 12.5, 300.25)


@_query(f"SELECT {_P}, CAST(trunc(hu/7e0) AS INT) AS v FROM fx_ct")
def truncate_int32(spark, d):
    return images.truncated(fx.ct(spark, d), F.col("hu") / 7.0)


@_query("SELECT c.vol_id, i, j, k, least(greatest(hu*2, lo), hi) AS v FROM fx_ct c JOIN (SELECT vol_id, min(hu) lo, max(hu) hi FROM fx_ct WHERE k<4 GROUP BY 1) r ON r.vol_id=c.vol_id")
def clip_to_range(spark, d):
    ct = fx.ct(spark, d)
    return images.clipped(ct.withColumn("v", F.col("hu") * 2), ct.where("k < 4").withColumn("v", F.col("hu")))


@_query(f"SELECT {_P}, CAST(least(greatest(floor(hu*40.25e0+0.5e0),-32768e0),32767e0) AS INT) AS v FROM fx_ct")
def display_int16(spark, d):
    return images.displayed(fx.ct(spark, d), F.col("hu") * 40.25)


_GRAY = "CAST(floor(least(greatest((hu-({0}-{1}/2e0))/{1}*255e0,0e0),255e0)) AS INT)"


@_query(f"SELECT {_P}, preset, {_GRAY.format('level', 'width')} AS gray FROM fx_ct, (VALUES ('soft',50e0,400e0),('bone',400e0,1800e0),('lung',-600e0,1500e0)) p(preset,level,width)")
def window_level(spark, d):
    presets = [("soft", 50.0, 400.0), ("bone", 400.0, 1800.0), ("lung", -600.0, 1500.0)]
    return images.windowed(fx.ct(spark, d), spark.createDataFrame(presets, "preset string, level double, width double"))


_MIX = "CAST(CASE WHEN m.label IS NULL THEN gray ELSE floor(gray*(1-0.4e0)+{0}*0.4e0) END AS INT) AS {0}"


@_query(
    f"SELECT vol_id, i, j, k, {', '.join(_MIX.format(c) for c in ('red', 'green', 'blue'))} FROM (SELECT x.vol_id, x.i, x.j, x.k, y.label, {_GRAY.format('-200e0', '1600e0')} AS gray FROM fx_ct x LEFT JOIN fx_lab y ON {_ON}) v LEFT JOIN (VALUES (1,200,20,30),(3,10,250,90)) m(label,red,green,blue) ON m.label=v.label"
)
def overlay_blend(spark, d):
    colors = spark.createDataFrame([(1, 200, 20, 30, True), (3, 10, 250, 90, True), (4, 9, 9, 9, False)], "label int, red int, green int, blue int, visible boolean")
    return images.blended(fx.ct(spark, d), fx.labels(spark, d), colors, -200.0, 1600.0, 0.4)


_HALF = "CASE WHEN x=0 OR isnan(x) THEN x WHEN abs(x)>=65520 THEN sign(x)*CAST('inf' AS DOUBLE) ELSE round_even(x/pow(2e0,greatest(floor(log2(abs(x))),-14)-10),0)*pow(2e0,greatest(floor(log2(abs(x))),-14)-10) END"


@_query(f"SELECT vec_id, place, {_HALF} AS h FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) x, generate_subscripts(embedding,1)-1 AS place FROM embeddings)")
def fp16_round(spark, d):
    cells = fx.scores(spark, d).select("vec_id", F.posexplode("scores").alias("place", "x"))
    return cells.select("vec_id", F.col("place").cast("long"), half(F.col("x").cast("double")).alias("h"))


@_query(f"SELECT vec_id, place, {_HALF} AS h FROM (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE)/3e0 x, generate_subscripts(embedding,1)-1 AS place FROM embeddings)")
def fp16_of_double(spark, d):
    """A double rounded once, not by way of single precision."""
    cells = fx.scores(spark, d).select("vec_id", F.posexplode("scores").alias("place", "x"))
    return cells.select("vec_id", F.col("place").cast("long"), half(F.col("x").cast("double") / 3.0).alias("h"))


@_query("SELECT vec_id, CAST(list_position(embedding,list_max(embedding))-1 AS BIGINT) AS class FROM embeddings")
def logits_argmax(spark, d):
    return tiles.argmax(fx.scores(spark, d))


@_query("SELECT vol_id, 31-j AS i, i AS j, k, hu FROM fx_ct")
def reorient_canonical(spark, d):
    source, flips, _, _ = resample.canonical_plan(SHAPE, AFFINE)
    return resample.reoriented(fx.ct(spark, d), SHAPE, source, flips)


@_query("SELECT vol_id, i, j, k, hu, 0e0*i+-0.8e0*j+0e0*k+10e0 AS x, 0.8e0*i+0e0*j+0e0*k+-20e0 AS y, 0e0*i+0e0*j+1.5e0*k+5e0 AS z FROM fx_ct")
def voxel_to_world(spark, d):
    return images.world(fx.ct(spark, d), AFFINE)


@_query("SELECT vol_id, n, s/n AS mean, q/n-s/n*(s/n) AS variance FROM (SELECT vol_id, count(*) n, CAST(sum(CAST(hu AS HUGEINT)) AS DOUBLE) s, CAST(sum(CAST(hu AS HUGEINT)*hu) AS DOUBLE) q FROM fx_ct GROUP BY 1)")
def channel_moments(spark, d):
    return images.moments(fx.ct(spark, d))


@_query(
    f"SELECT vol_id, count(*) n, CAST(sum(CAST(a<>b AS INT)) AS BIGINT) n_diff, max(abs(a-b)) max_abs FROM (SELECT vol_id, (SELECT {_HALF} FROM (SELECT hu*1.0001e0 AS x)) a, (SELECT {_HALF} FROM (SELECT CAST(hu AS DOUBLE) AS x)) b FROM fx_ct) GROUP BY 1"
)
def half_mismatch(spark, d):
    ct = fx.ct(spark, d)
    return images.half_differences(ct.select(*labels.PLACE, (F.col("hu") * 1.0001).alias("v")), ct.select(*labels.PLACE, F.col("hu").cast("double").alias("v")))


@_query("SELECT vol_id, max(abs(hu%7)) max_abs, sqrt(CAST(sum((hu%7)*(hu%7)) AS DOUBLE)/(CAST(sum(CAST(hu-hu%7 AS BIGINT)*(hu-hu%7)) AS DOUBLE)+1e-30)) rel_rms FROM fx_ct GROUP BY 1")
def relative_rms(spark, d):
    ct = fx.ct(spark, d)
    return images.relative_rms(ct, ct.withColumn("hu", F.col("hu") - F.col("hu") % 7))


_BELL = "(SELECT t, CAST(g/sum(g) OVER () AS FLOAT) w FROM (SELECT t, CAST(CAST(exp(-0.5e0*t*t/(0.9e0*0.9e0)) AS FLOAT) AS DOUBLE) g FROM (SELECT unnest(range(-3,4)) t)))"


@_query(
    "SELECT vol_id, i, j, o AS k, CAST(list_reduce(list_prepend(CAST(0 AS FLOAT), list(p ORDER BY t)), lambda s, x: s+x) AS DOUBLE) AS v FROM (SELECT vol_id, i, j, CAST(k-t AS INT) o, t, CAST(w*CAST(hu AS FLOAT) AS FLOAT) p"
    f" FROM fx_ct, {_BELL} f) WHERE o BETWEEN 0 AND 23 GROUP BY 1,2,3,4"
)
def gaussian_blur(spark, d):
    return images.blurred(fx.ct(spark, d).withColumn("v", F.col("hu")), "k", SHAPE[2], 0.9)


@_query("SELECT series_uid, nrows, ncols, n FROM modal")
def series_modal_size(spark, d):
    return series.modal_size(fx.slices(spark, d))


@_query("SELECT * FROM cat")
def series_catalogue(spark, d):
    return series.catalogue(fx.slices(spark, d))


@_query("SELECT * FROM ranked")
def series_order(spark, d):
    return series.ranked(series.catalogue(fx.slices(spark, d)))


@_query("SELECT * EXCLUDE (place) FROM ranked WHERE place=1 AND problem IS NULL")
def default_series(spark, d):
    return series.default_series(series.catalogue(fx.slices(spark, d)), strict=False)


@_query("SELECT study, series_uid, n_slices FROM cat WHERE n_slices>=2 AND problem IS NULL")
def usable_series(spark, d):
    return series.catalogue(fx.slices(spark, d)).where("n_slices >= 2 and problem is null").select("study", "series_uid", "n_slices")


@_query(
    "SELECT study, series_uid, fits AS matched FROM (SELECT *, row_number() OVER (PARTITION BY study ORDER BY NOT fits, NOT ct, NOT ok, place) r FROM (SELECT *, ct AND regexp_matches(description,'portal|venous|\\bpv\\b|門脈','i') AND n_slices>=0.8e0*most AS fits FROM"
    " (SELECT *, max(CASE WHEN ct THEN n_slices END) OVER (PARTITION BY study) most FROM (SELECT *, ok AND modality='CT' AS ct FROM (SELECT *, n_slices>=2 AND problem IS NULL AS ok FROM ranked))))) WHERE r=1"
)
def suggest_series(spark, d):
    out = series.suggested_series(series.catalogue(fx.slices(spark, d)))
    return out.withColumn("matched", F.coalesce("matched", F.lit(False)))


@_query("SELECT series_uid, min(d) AS least, max(d) most, sum(d)/count(*) AS mean, max(d)-min(d)>0.05e0*abs(sum(d)/count(*))+1e-3 AS uneven FROM (SELECT series_uid, pos-lag(pos) OVER (PARTITION BY series_uid ORDER BY pos, file) d FROM used WHERE pos IS NOT NULL) WHERE d IS NOT NULL GROUP BY 1")
def spacing_check(spark, d):
    return series.spacing_check(fx.slices(spark, d))


@_query("SELECT series_uid, file, row_number() OVER (PARTITION BY series_uid ORDER BY CASE WHEN whole THEN pos ELSE instance END, file)-1 AS k FROM (SELECT *, count(pos) OVER (PARTITION BY series_uid)=count(*) OVER (PARTITION BY series_uid) whole FROM used)")
def slice_order(spark, d):
    return series.stacked(fx.slices(spark, d))


@_query("SELECT series_uid, series_uid||chr(9)||coalesce(description,'')||chr(9)||modality||chr(9)||n_slices||chr(9)||n_others||chr(9)||coalesce(problem,'') AS line FROM cat")
def series_listing(spark, d):
    return series.listing(series.catalogue(fx.slices(spark, d)))


@_query(
    "SELECT vol_id, CAST(x.o AS INT) AS i, CAST(y.o AS INT) AS j, CAST(z.o AS INT) AS k, label FROM fx_lab"
    + "".join(
        f" JOIN (SELECT o, CAST(least(floor(o*({n - 1}e0/{m - 1}e0)+0.5e0),{n - 1}) AS INT) p FROM (SELECT unnest(range({m})) o)) {t} ON {t}.p={c}"
        for t, c, n, m in (("x", "i", 32, 20), ("y", "j", 32, 41), ("z", "k", 24, 24))
    )
)
def zoom_nearest(spark, d):
    return resample.zoomed_nearest(fx.labels(spark, d), SHAPE, (20, 41, 24))


def _linear_sql(out, grid: bool) -> str:
    def axis(n, m):
        c = f"(o+0.5e0)*({n}e0/{m}e0)-0.5e0" if grid else f"o*({n - 1}e0/{m - 1}e0)"
        return f"(SELECT o, least(greatest(floor(c),0),{n - 1}) p0, least(greatest(floor(c)+1,0),{n - 1}) p1, 1e0-(c-floor(c)) w0, 1e0-(1e0-(c-floor(c))) w1 FROM (SELECT o, {c} c FROM (SELECT unnest(range({m})) o)))"

    ax = [axis(n, m) for n, m in zip(SHAPE, out, strict=True)]
    taps = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    total = "+".join(f"coalesce(t{a}{b}{c}.hu*x.w{a}*y.w{b}*z.w{c},0e0)" for a, b, c in taps)
    joins = " ".join(f"LEFT JOIN fx_ct t{a}{b}{c} ON t{a}{b}{c}.vol_id=v.vol_id AND t{a}{b}{c}.i=x.p{a} AND t{a}{b}{c}.j=y.p{b} AND t{a}{b}{c}.k=z.p{c}" for a, b, c in taps)
    some = " OR ".join(f"t{a}{b}{c}.hu IS NOT NULL" for a, b, c in taps)
    return f"SELECT v.vol_id, CAST(x.o AS INT) AS i, CAST(y.o AS INT) AS j, CAST(z.o AS INT) AS k, {total} AS v FROM (SELECT DISTINCT vol_id FROM fx_ct) v CROSS JOIN {ax[0]} x CROSS JOIN {ax[1]} y CROSS JOIN {ax[2]} z {joins} WHERE {some}"


@_query(_linear_sql((20, 20, 15), False))
def zoom_linear(spark, d):
    return resample.zoomed_linear(fx.ct(spark, d), SHAPE, (20, 20, 15))


@_query(_linear_sql((20, 24, 15), True))
def zoom_grid_linear(spark, d):
    return resample.zoomed_linear(fx.ct(spark, d), SHAPE, (20, 24, 15), grid=True)


@_query(None)
def zoom_cubic(spark, d):
    return resample.zoomed(fx.ct(spark, d).withColumn("v", F.col("hu")), SHAPE, (20, 24, 15), 3)


@_query(None)
def zoom_separate_z(spark, d):
    return resample.zoomed_by_slices(fx.ct(spark, d).withColumn("v", F.col("hu")), SHAPE, (20, 24, 15), 2, 3)


@_query(None)
def resample_to_spacing(spark, d):
    return resample.to_spacing(fx.ct(spark, d).withColumn("v", F.col("hu")), SHAPE, AFFINE, (1.5, 1.5, 1.5), 1)[0]


@_query("SELECT vol_id, CAST(i//4 AS INT) AS i, CAST(j//4 AS INT) AS j, CAST(k//4 AS INT) AS k, sum(CAST(label IN (2,4) AS INT))*(1e0/64) AS v FROM fx_lab GROUP BY 1,2,3,4")
def block_average(spark, d):
    return images.block_average(labels.mask(fx.labels(spark, d), [2, 4]), 4)


@_query("SELECT vol_id, 31-i AS u, 31-j AS v, hu FROM fx_ct WHERE k=4")
def slice_axial(spark, d):
    return images.axial(fx.ct(spark, d), 4, SHAPE)


@_query("SELECT vol_id, 31-i AS u, 23-k AS v, hu FROM fx_ct WHERE j=11")
def slice_coronal(spark, d):
    return images.coronal(fx.ct(spark, d), 11, SHAPE)


@_query("SELECT vol_id, 31-j AS u, 23-k AS v, hu FROM fx_ct WHERE i=11")
def slice_sagittal(spark, d):
    return images.sagittal(fx.ct(spark, d), 11, SHAPE)


@_query("SELECT p.vol_id, p.i, p.j, p.k, y.label, x.hu FROM (SELECT DISTINCT CAST(l_orderkey//4096 AS INT) vol_id, CAST(l_linenumber AS INT) i, CAST(l_quantity AS INT)%32 j, 5 AS k FROM lineitem WHERE l_orderkey%50=0) p LEFT JOIN fx_lab y ON p.vol_id=y.vol_id AND p.i=y.i AND p.j=y.j AND p.k=y.k LEFT JOIN fx_ct x ON p.vol_id=x.vol_id AND p.i=x.i AND p.j=x.j AND p.k=x.k")
def voxel_probe(spark, d):
    lines = fx.table(spark, d, "lineitem").where("l_orderkey % 50 = 0")
    points = lines.select(F.floor(F.col("l_orderkey") / 4096).cast("int").alias("vol_id"), F.col("l_linenumber").cast("int").alias("i"), (F.col("l_quantity").cast("int") % 32).alias("j"), F.lit(5).alias("k")).distinct()
    return labels.picked(fx.ct(spark, d), labels.picked(fx.labels(spark, d), points))


def _starts(n: int, t: int, name: str) -> str:
    return f"(SELECT CAST(round_even({n - t}e0/(c-1)*x,0) AS INT) {name} FROM (SELECT c, unnest(range(c)) x FROM (SELECT CAST(ceil({n - t}/({t}*{STEP}e0))+1 AS INT) c)))"


_COVER = "SELECT c.*, si, sj, sk FROM fx_ct c" + "".join(f" JOIN {_starts(n, t, f's{a}')} t{a} ON s{a}<={a} AND {a}<s{a}+{t}" for a, n, t in zip("ijk", SHAPE, TILE, strict=True))


@_query(f"SELECT vol_id, si, sj, sk, count(*) n FROM ({_COVER}) GROUP BY 1,2,3,4")
def tile_voxel_counts(spark, d):
    return tiles.covering(fx.ct(spark, d), SHAPE, TILE, STEP).groupBy("vol_id", "si", "sj", "sk").agg(F.count("*").alias("n"))


_FOLD = "list_reduce(list_prepend(0e0, list({0} ORDER BY si,sj,sk)), lambda s, p: list_transform([s+p], lambda x: " + _HALF + ")[1])"


@_query(f"SELECT {_P}, count(*) n, {_FOLD.format('p')} AS total FROM (SELECT *, hu*0.37e0+si+sj*0.1e0+sk*0.01e0 AS p FROM ({_COVER})) GROUP BY vol_id,i,j,k")
def tile_accumulate_fp16(spark, d):
    return tiles.accumulated_half(fx.ct(spark, d), SHAPE, TILE, STEP, lambda v, si, sj, sk: v["hu"] * 0.37 + si + sj * 0.1 + sk * 0.01)


def _line(n: int, c: str) -> str:
    """A Gaussian of an eighth of a tile's side, cut at four widths, with sum 1."""
    sigma, reach = n / 8, int(4 * n / 8 + 0.5)
    return f"(SELECT x s{c}, CASE WHEN abs(x-{n // 2})<={reach} THEN exp(-0.5e0/({sigma}e0*{sigma}e0)*(x-{n // 2})*(x-{n // 2}))/(SELECT sum(exp(-0.5e0/({sigma}e0*{sigma}e0)*y*y)) FROM (SELECT unnest(range(-{reach},{reach + 1})) y)) ELSE 0e0 END g{c} FROM (SELECT unnest(range({n})) x))"


_CTE["fx_bell"] = f"SELECT *, CASE WHEN h=0 THEN min(h) FILTER (h>0) OVER () ELSE h END AS weight FROM (SELECT xi, xj, xk, list_transform([CAST(CAST(g/(max(g) OVER ()/10e0) AS FLOAT) AS DOUBLE)], lambda x: {_HALF})[1] h FROM (SELECT si xi, sj xj, sk xk, gi*gj*gk g FROM {_line(12, 'i')}, {_line(12, 'j')}, {_line(10, 'k')}))"
_BLEND = (
    f"SELECT {_P}, class, list_transform([CAST(CAST({_FOLD.format('p')} AS FLOAT)/CAST({_FOLD.format('weight')} AS FLOAT) AS DOUBLE)], lambda x: {_HALF})[1] AS logit"
    f" FROM (SELECT *, list_transform([(CASE class WHEN 0 THEN hu*0.25e0 ELSE si-sj+k*class END)*weight], lambda x: {_HALF})[1] AS p FROM (SELECT c.*, weight, class FROM ({_COVER}) c JOIN fx_bell ON xi=i-si AND xj=j-sj AND xk=k-sk, (VALUES (0),(1),(2)) f(class))) GROUP BY vol_id,i,j,k,class"
)


def _blended(spark, d):
    def score(v, si, sj, sk):
        return np.stack([v["hu"] * 0.25, (si - sj + v["k"]).astype(float), (si - sj + v["k"] * 2).astype(float)])

    return tiles.blended(fx.ct(spark, d), SHAPE, TILE, STEP, score)


@_query(_BLEND)
def tile_blend_gaussian(spark, d):
    """Class scores of the volumes' tiles, blended with the tiles' importance."""
    return _blended(spark, d).select(*labels.PLACE, F.posexplode("logits").alias("class", "logit"))


@_query(f"SELECT {_P}, CAST(arg_min(class, struct_pack(a := -logit, b := class)) AS INT) AS label FROM ({_BLEND}) GROUP BY vol_id,i,j,k")
def tile_finish_argmax(spark, d):
    return tiles.first_greatest(_blended(spark, d))


_DICE = (
    "SELECT vol_id, l AS label, CAST(sum(CAST(a=l AS INT)) AS BIGINT) n_a, CAST(sum(CAST(b=l AS INT)) AS BIGINT) n_b, CAST(sum(CAST(a=l AND b=l AS INT)) AS BIGINT) n_both, 2e0*sum(CAST(a=l AND b=l AS INT))/(sum(CAST(a=l AS INT))+sum(CAST(b=l AS INT))) AS dice,"
    " sum(CAST(a=l AS INT))=sum(CAST(a=l AND b=l AS INT)) AND sum(CAST(b=l AS INT))=sum(CAST(a=l AND b=l AS INT)) AS identical FROM fx_both, (VALUES (1),(2),(3),(4),(5)) v(l) WHERE a=l OR b=l GROUP BY vol_id, l"
)


@_query(_DICE)
def dice_per_label(spark, d):
    return labels.dice(fx.labels(spark, d), fx.labels(spark, d, F.min))


@_query(f"SELECT vol_id, count(*) n_labels, CAST(sum(CAST(identical AS INT)) AS BIGINT) n_identical, min(dice) AS dice, arg_min(label, struct_pack(a := dice, b := label)) AS label FROM ({_DICE}) GROUP BY 1")
def worst_dice(spark, d):
    return labels.worst_dice(fx.labels(spark, d), fx.labels(spark, d, F.min))


@_query("SELECT vol_id, count(*) n, CAST(sum(CAST(a<>b AS INT)) AS BIGINT) n_diff, 100e0*sum(CAST(a<>b AS INT))/count(*) AS percent, true AS same_size FROM fx_both GROUP BY 1")
def diff_report(spark, d):
    return labels.differences(fx.labels(spark, d), fx.labels(spark, d, F.min))


@_query("SELECT vol_id, count(*) n, CAST(sum(CAST(a<>b AS INT)) AS BIGINT) n_diff, 100e0*sum(CAST(a<>b AS INT))/count(*) AS percent, bool_and(i<30) AS same_size FROM (SELECT vol_id, i, j, k, a, CASE WHEN i<30 THEN b ELSE 0 END b FROM fx_both) GROUP BY 1")
def diff_report_of_sizes(spark, d):
    return labels.differences(fx.labels(spark, d), fx.labels(spark, d, F.min).where("i < 30"))


@_query("SELECT DISTINCT vol_id, unnest([a,b]) AS label FROM fx_both WHERE a<>b")
def confused_labels(spark, d):
    return labels.confused(fx.labels(spark, d), fx.labels(spark, d, F.min))


@_query("SELECT vol_id, label, avg(i) ci, avg(j) cj, avg(k) ck FROM fx_lab WHERE ((i*32+j)*24+k)%7=0 AND label>0 GROUP BY 1,2")
def label_centroid(spark, d):
    return labels.centroids(fx.labels(spark, d), SHAPE)


@_query(
    "SELECT vol_id, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list(CAST(b AS BIGINT) ORDER BY p)), lambda h, b: (xor(h,b)*16777619) & 4294967295) AS hash"
    " FROM (SELECT z.vol_id, p, coalesce(label,0) b FROM (SELECT DISTINCT vol_id FROM fx_lab) z CROSS JOIN (SELECT unnest(range(24576)) p) c LEFT JOIN fx_lab l ON l.vol_id=z.vol_id AND (l.i*32+l.j)*24+l.k=p) GROUP BY vol_id"
)
def label_hash_fnv1a(spark, d):
    lab = fx.labels(spark, d)
    return hashing.dense_hash(lab, lab.select("vol_id").distinct().withColumns({n: F.lit(s) for n, s in zip(("nx", "ny", "nz"), SHAPE, strict=True)}))


_BALL = "((i-15)*0.8e0)*((i-15)*0.8e0)+((j-15)*0.8e0)*((j-15)*0.8e0)+((k-11)*1.5e0)*((k-11)*1.5e0)<=36e0"


@_query(f"SELECT x.vol_id, x.i, x.j, x.k, x.hu, CASE WHEN {_BALL.replace('(i', '(x.i').replace('(j', '(x.j').replace('(k', '(x.k')} AND label IN (0,2) AND hu BETWEEN -600 AND 500 THEN 2 ELSE label END AS label FROM fx_ct x JOIN fx_lab y ON {_ON}")
def brush_stamp(spark, d):
    return labels.stamp(fx.ct(spark, d).join(fx.labels(spark, d), labels.PLACE), (15, 15, 11), 6.0, SPACING, 2, protect=True, hu=(-600.0, 500.0))


@_query(f"SELECT {_P}, CASE WHEN {_BALL} AND k=11 AND label=5 THEN 0 ELSE label END AS label FROM fx_lab")
def erase_disc(spark, d):
    return labels.erased(fx.labels(spark, d), (15, 15, 11), 6.0, SPACING, 5, fixed="k")


_CENTRES = labels.stroke((4, 6, 11), (24, 20, 11), SPACING, 4.0)


_PATH = "SELECT floor(4+20*t/n+0.5e0) ci, floor(6+14*t/n+0.5e0) cj, 11 AS ck FROM (SELECT n, unnest(range(1,CAST(n AS INT)+1)) t FROM (SELECT ceil(sqrt((20*0.8e0)*(20*0.8e0)+(14*0.8e0)*(14*0.8e0))/greatest(0.3e0,4e0/2)) n))"


@_query(f"SELECT {_P}, CASE WHEN EXISTS (SELECT 1 FROM ({_PATH}) WHERE ((i-ci)*0.8e0)*((i-ci)*0.8e0)+((j-cj)*0.8e0)*((j-cj)*0.8e0)+((k-ck)*1.5e0)*((k-ck)*1.5e0)<=16e0) THEN 9 ELSE label END AS label FROM fx_lab")
def brush_stroke(spark, d):
    lab = fx.labels(spark, d)
    for centre in _CENTRES:
        lab = labels.stamp(lab, centre, 4.0, SPACING, 9)
    return lab


def _edits(lab):
    edit = lambda ok, step, to: lab.where(ok).select(*labels.PLACE, F.lit(step).alias("step"), F.col("label").alias("old"), F.lit(to).alias("label"))
    return edit("i < 8", 1, 8).union(edit("label % 2 = 0 and j < 16", 2, 9)).union(edit("k = 0", 3, 1))


@_query(f"SELECT {_P}, CASE WHEN label%2=0 AND j<16 THEN 9 WHEN i<8 THEN 8 ELSE label END AS label FROM fx_lab")
def edit_replay(spark, d):
    lab = fx.labels(spark, d)
    return labels.replayed(lab, _edits(lab).drop("old"), 2)


@_query("SELECT vol_id, step, list_sort(list(DISTINCT x)) AS labels FROM (SELECT vol_id, step, unnest([old, n]) x FROM (SELECT vol_id, 1 AS step, label AS old, 8 AS n FROM fx_lab WHERE i<8 UNION ALL SELECT vol_id, 2, label, 9 FROM fx_lab WHERE label%2=0 AND j<16 UNION ALL SELECT vol_id, 3, label, 1 FROM fx_lab WHERE k=0)) WHERE x>0 GROUP BY 1,2")
def edit_touched_labels(spark, d):
    return labels.touched(_edits(fx.labels(spark, d)))


_REG = "SELECT vol_id, label, name FROM (SELECT DISTINCT vol_id FROM fx_lab) CROSS JOIN (VALUES (1,'asia'),(3,'lung')) r(label,name)"


def _registry(spark, d):
    return fx.labels(spark, d).select("vol_id").distinct().withColumn("r", F.explode(F.array(*[F.struct(F.lit(i).alias("label"), F.lit(n).alias("name")) for i, n in ((1, "asia"), (3, "lung"))]))).select("vol_id", "r.label", "r.name")


_IDS = (
    "CASE coalesce(n.name, 'label_'||x.label) WHEN 'asia' THEN 1 ELSE (list_filter([2,4,5,6,7,8], lambda v: true))[CAST((SELECT count(DISTINCT w.label) FROM fx_lab2 w LEFT JOIN fx_names m ON m.label=w.label WHERE w.vol_id=x.vol_id AND w.label>0 AND w.label<=x.label AND coalesce(m.name,'')<>'asia') AS INT)] END"
)


@_query(f"SELECT DISTINCT x.vol_id, {_IDS} AS label, coalesce(n.name, 'label_'||x.label) AS name, coalesce(n.name,'')<>'asia' AS fresh FROM fx_lab2 x LEFT JOIN fx_names n ON n.label=x.label WHERE x.label>0 AND coalesce(n.name,'')<>'asia' UNION ALL SELECT vol_id, label, name, false FROM ({_REG})")
def registry_ensure(spark, d):
    lab = fx.labels(spark, d, F.min).where("label > 0").join(fx.names(spark, d).select("label", "name"), "label", "left")
    wanted = lab.select("vol_id", F.coalesce("name", F.concat(F.lit("label_"), F.col("label").cast("string"))).alias("name"), F.col("label").alias("place")).distinct()
    return registry.ensured(_registry(spark, d), wanted)


@_query(f"SELECT coalesce(y.vol_id,x.vol_id) vol_id, coalesce(y.i,x.i) i, coalesce(y.j,x.j) j, coalesce(y.k,x.k) k, coalesce(x.new, y.label, 0) AS label FROM (SELECT x.vol_id, x.i, x.j, x.k, {_IDS} AS new FROM fx_lab2 x LEFT JOIN fx_names n ON n.label=x.label WHERE x.label>0) x FULL JOIN fx_lab y ON {_ON}")
def registry_merge(spark, d):
    return registry.applied(fx.labels(spark, d), fx.labels(spark, d, F.min), fx.names(spark, d), _registry(spark, d))


@_query("SELECT label, name FROM fx_names WHERE contains(name,'a')")
def label_search(spark, d):
    return registry.found(fx.names(spark, d), "A").select("label", "name")


@_query("SELECT label, " + ", ".join(f"CAST(floor((0.55e0-0.27e0*greatest(-1e0,least(t{k}-3,9-t{k},1e0)))*255+0.5e0) AS INT) AS {c}" for k, c in ((0, "red"), (8, "green"), (4, "blue"))) + " FROM (SELECT label, " + ", ".join(f"fmod({k}+h*12,12) t{k}" for k in (0, 8, 4)) + " FROM (SELECT label, fmod(label*137.508e0,360)/360 h FROM fx_names))")
def label_colors(spark, d):
    return registry.color_table(fx.names(spark, d))


@_query("""SELECT vol_id, '{"labels":['||string_agg('{"label":'||label||',"name":"'||name||'","voxels":'||n||'}', ',' ORDER BY label)||']}' AS json FROM (SELECT vol_id, l.label, coalesce(n.name,'label_'||l.label) AS name, count(*) n FROM fx_lab l LEFT JOIN fx_names n ON n.label=l.label WHERE l.label>0 GROUP BY 1,2,3) GROUP BY 1""")
def label_metadata(spark, d):
    return registry.metadata(fx.labels(spark, d), fx.names(spark, d))


@_query("SELECT kind, owner, idx, name FROM fx_cls")
def class_maps(spark, d):
    return planning.class_map(fx.class_lines(spark, d))


@_query("SELECT CAST(p.owner AS INT) part, p.idx AS label, t.idx task_label FROM fx_cls p JOIN fx_cls t ON t.kind='task' AND t.name=p.name WHERE p.kind='part'")
def class_task_index(spark, d):
    return planning.part_to_task(planning.class_map(fx.class_lines(spark, d)), "total")


@_query("SELECT DISTINCT CAST(owner AS INT) part FROM fx_cls WHERE kind='part' AND name IN ('nation_3','nation_11')")
def roi_to_models(spark, d):
    return planning.models_of(planning.class_map(fx.class_lines(spark, d)), ["nation_3", "nation_11"])


@_query("SELECT name, CASE WHEN contains(name,'ira') THEN 'organ' ELSE 'organ' END AS kind, CAST(NULL AS INT) taubin_iterations, 0e0 AS min_piece_ml FROM fx_cls WHERE kind='task' UNION ALL SELECT * FROM (VALUES ('portal_vein','trunk',20,0.03e0),('hepatic_veins','tree',30,0.03e0))")
def mesh_options(spark, d):
    names = planning.class_map(fx.class_lines(spark, d)).where("kind = 'task'").select("name").union(spark.createDataFrame([("portal_vein",), ("hepatic_veins",)], "name string"))
    return planning.mesh_options(names)


@_query("SELECT mesh_id, sum(ax*(b_y*cz-bz*cy)+ay*(bz*cx-bx*cz)+az*(bx*cy-b_y*cx))/6e0/1000e0 AS ml FROM pts GROUP BY 1")
def mesh_volume(spark, d):
    return mesh.volumes(fx.triangles(spark, d), fx.vertices(spark, d))


@_query(
    "SELECT v.mesh_id, v.vid, coalesce(CASE WHEN s>0 THEN u/s END,0e0) nx, coalesce(CASE WHEN s>0 THEN v_/s END,0e0) ny, coalesce(CASE WHEN s>0 THEN w/s END,0e0) nz FROM fx_ver v LEFT JOIN (SELECT *, sqrt(u*u+v_*v_+w*w) s FROM (SELECT mesh_id, vid, sum(u) u, sum(v) v_, sum(w) w FROM (SELECT mesh_id, unnest([a,b,c]) vid, u, v, w FROM facets) GROUP BY 1,2)) n ON n.mesh_id=v.mesh_id AND n.vid=v.vid"
)
def mesh_normals(spark, d):
    return mesh.normals(fx.triangles(spark, d), fx.vertices(spark, d))


@_query("SELECT DISTINCT mesh_id, least(p,q) u, greatest(p,q) v FROM (SELECT mesh_id, a p, b q FROM fx_tri UNION ALL SELECT mesh_id, b, c FROM fx_tri UNION ALL SELECT mesh_id, c, a FROM fx_tri) WHERE p<>q")
def mesh_edges(spark, d):
    return mesh.edges(fx.triangles(spark, d))


@_query("SELECT t.mesh_id, a-low+base AS a, b-low+base AS b, c-low+base AS c FROM fx_tri t JOIN (SELECT mesh_id, low, CAST(sum(n) OVER (ORDER BY mesh_id)-n AS BIGINT) base FROM (SELECT mesh_id, count(*) n, min(vid) low FROM fx_ver GROUP BY 1)) m ON m.mesh_id=t.mesh_id")
def mesh_concat(spark, d):
    return mesh.joined(fx.triangles(spark, d), fx.vertices(spark, d))


@_query("SELECT mesh_id, 0 AS part, CAST(0 AS BIGINT) AS at, 'o mesh_'||mesh_id AS line FROM (SELECT DISTINCT mesh_id FROM fx_ver) UNION ALL SELECT mesh_id, 1, vid, printf('v %.4f %.4f %.4f', x, y, z) FROM fx_ver UNION ALL SELECT mesh_id, 2, tid, printf('f %d %d %d', a+1, b+1, c+1) FROM fx_tri")
def mesh_obj(spark, d):
    return mesh.obj_lines(fx.triangles(spark, d), fx.vertices(spark, d))


@_query("SELECT mesh_id, tid, [coalesce(CASE WHEN s>0 THEN u/s END,0e0), coalesce(CASE WHEN s>0 THEN v/s END,0e0), coalesce(CASE WHEN s>0 THEN w/s END,0e0)] AS normal, [ax,ay,az,bx,b_y,bz,cx,cy,cz] AS points FROM (SELECT *, sqrt(u*u+v*v+w*w) s FROM facets)")
def mesh_stl(spark, d):
    return mesh.stl(fx.triangles(spark, d), fx.vertices(spark, d))


_RAY = "SELECT *, ux*hx+uy*hy+uz*hz det, sy*uz-sz*uy qx, sz*ux-sx*uz qy, sx*uy-sy*ux qz FROM (SELECT *, 0.6e0*vz-0.5e0*vy hx, 0.5e0*vx-0.7e0*vz hy, 0.7e0*vy-0.6e0*vx hz FROM (SELECT mesh_id, tid, bx-ax ux, b_y-ay uy, bz-az uz, cx-ax vx, cy-ay vy, cz-az vz, -50e0-ax sx, -40e0-ay sy, -30e0-az sz FROM pts))"


@_query(f"SELECT mesh_id, CAST(arg_min(tid, struct_pack(a := t, b := tid)) AS INT) AS tid, min(t) AS t FROM (SELECT *, (sx*hx+sy*hy+sz*hz)/det p, (0.7e0*qx+0.6e0*qy+0.5e0*qz)/det q, (vx*qx+vy*qy+vz*qz)/det t FROM ({_RAY}) WHERE abs(det)>1e-12) WHERE p>=0 AND q>=0 AND p+q<=1 AND t>0 GROUP BY 1")
def mesh_pick(spark, d):
    return mesh.picked(fx.triangles(spark, d), fx.vertices(spark, d), (-50.0, -40.0, -30.0), (0.7, 0.6, 0.5))


@_query("SELECT x.vol_id, x.i, x.j, x.k, x.label, count(y.i) n FROM fx_lab x LEFT JOIN fx_lab y ON x.vol_id=y.vol_id AND x.label=y.label AND abs(x.i-y.i)+abs(x.j-y.j)+abs(x.k-y.k)=1 AND y.i BETWEEN x.i-1 AND x.i+1 AND y.j BETWEEN x.j-1 AND x.j+1 WHERE x.label>0 GROUP BY 1,2,3,4,5")
def voxel_neighbours(spark, d):
    return components.neighbours(fx.labels(spark, d))


@_query(None)
def component_sizes(spark, d):
    return components.sizes(components.components(fx.labels(spark, d), SHAPE))


@_query(None)
def largest_component(spark, d):
    return components.largest(fx.labels(spark, d), SHAPE)


@_query(None)
def drop_small_pieces(spark, d):
    return components.without_specks(fx.labels(spark, d), SHAPE, components.least_voxels(0.004, SPACING))


def _seeds(spark, d):
    return fx.labels(spark, d).where("label = 5 and (i * 7 + j * 3 + k) % 211 = 0").select(*labels.PLACE)


@_query(None)
def flood_fill_2d(spark, d):
    return components.filled(fx.labels(spark, d), _seeds(spark, d), SHAPE, 9)


@_query(None)
def relabel_3d(spark, d):
    return components.relabelled(fx.labels(spark, d), _seeds(spark, d), SHAPE, 9)


@_query("SELECT environment, case_id, task, count(*) n, min(hash)=max(hash) AS identical FROM fx_runs GROUP BY 1,2,3")
def runs_identical(spark, d):
    return verify.identical_runs(fx.runs(spark, d))


@_query("SELECT environment, case_id, task, CAST(sum(CAST(secs AS DECIMAL(18,6))) AS DOUBLE)/count(*) AS mean, count(*) n FROM fx_runs WHERE rep IN (2,3) AND path='webgpu' GROUP BY 1,2,3")
def gpu_mean_runs_2_3(spark, d):
    return verify.mean_of_later(fx.runs(spark, d).where(verify.path() == "webgpu"), [2, 3])


def _want(spark, d):
    runs = fx.runs(spark, d).withColumn("path", verify.path())
    return runs.where("case_id % 2 = 0 and rep = 1").groupBy("case_id", "task", "path").agg(F.max("hash").alias("want"))


_RESULT = (
    "SELECT environment, r.case_id, r.task, count(*) n, count(want) compared, min(hash)=max(hash) AS identical, CASE WHEN count(want)=0 THEN 'no record' WHEN bool_and(hash=want) FILTER (want IS NOT NULL) THEN 'match' ELSE 'different' END AS verdict"
    " FROM fx_runs r LEFT JOIN fx_want w ON r.case_id=w.case_id AND r.task=w.task AND r.path=w.path GROUP BY 1,2,3"
)


@_query(_RESULT)
def hash_results(spark, d):
    return verify.results(fx.runs(spark, d), _want(spark, d))


@_query(f"SELECT environment, count(*) FILTER (verdict='match') matches, count(*) FILTER (verdict='different') different, count(*) FILTER (verdict='no record') no_record, count(*) FILTER (NOT identical) not_identical FROM ({_RESULT}) GROUP BY 1")
def hash_verdict(spark, d):
    return verify.verdicts(fx.runs(spark, d), _want(spark, d))


@_query("SELECT case_id, task, path, want FROM fx_want w WHERE NOT EXISTS (SELECT 1 FROM fx_runs r WHERE r.environment='click' AND r.rep>=3 AND r.case_id=w.case_id AND r.task=w.task)")
def hashes_not_run(spark, d):
    return verify.not_run(fx.runs(spark, d).where("rep >= 3"), _want(spark, d), "click")
