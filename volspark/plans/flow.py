"""Queries from class scores to labels and through a whole task, and their SQL. Registered with those of the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from volspark.functions.numeric import half
from volspark.operators import planning, tasks
from volspark.plans.catalogue import _CTE, _HALF, _query
from volspark.plans.grids import _P, _SIZE, _linear, _nearest, _zoom_plan
from volspark.sources import fixtures as fx

_ROUND = "list_transform([{}], lambda x: " + _HALF + ")[1]"
_CTE |= {
    "own_scores": f"SELECT vol_id, i, j, k, class, {_ROUND.format('CASE class WHEN 0 THEN v*0.25e0 WHEN 1 THEN (i-j+k)*3.5e0 ELSE (v%97)*1.5e0 END')} AS v FROM own_ct, (VALUES (0),(1),(2)) c(class)",
    "own_ends": "SELECT vol_id, class, CASE WHEN c<size THEN least(lo,0e0) ELSE lo END lo, CASE WHEN c<size THEN greatest(hi,0e0) ELSE hi END hi FROM (SELECT s.vol_id, class, min(v) lo, max(v) hi, count(*) c, any_value(nx*ny*nz) size FROM own_scores s JOIN own_grid g ON g.vol_id=s.vol_id GROUP BY 1,2)",
}


def _scores(spark, d):
    v = F.col("v")
    classes = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))
    score = F.when(F.col("class") == 0, v * 0.25).when(F.col("class") == 1, (F.col("i") - F.col("j") + F.col("k")) * 3.5).otherwise((v % 97) * 1.5)
    return fx.own_ct(spark, d).withColumn("class", classes).select("vol_id", "i", "j", "k", "class", half(score).alias("logit"))


@_query(f"SELECT b.vol_id, CAST(i+b.vol_id%3 AS INT) i, j+1 AS j, k+2 AS k, CAST(arg_min(class, struct_pack(a := -logit, b := class)) AS INT) AS label FROM (SELECT x.vol_id, i, j, k, x.class, {_ROUND.format('least(greatest(v,lo),hi)')} AS logit FROM ({_linear('own_zoom', True, 'own_scores', 'class')}) x JOIN own_ends e ON e.vol_id=x.vol_id AND e.class=x.class) b GROUP BY b.vol_id, b.i, b.j, b.k")
def scores_to_labels(spark, d):
    corner = {"lo_i": F.col("vol_id") % 3, "lo_j": F.lit(1), "lo_k": F.lit(2)}
    plan = _zoom_plan(spark, d).withColumns(corner).withColumn("affine", F.array(*[F.lit(float(x)) for x in (1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1)]))
    return tasks.finished(_scores(spark, d), plan, (1.0, 1.0, 2.0))


def _step(src: str, to: tuple) -> str:
    """Sizes of grids at a spacing."""
    zoom = [f"CASE WHEN {s}={t}e0 THEN 1e0 ELSE {s}/{t}e0 END" for s, t in zip(_SIZE, to, strict=True)]
    return "SELECT vol_id, nx, ny, nz, " + ", ".join(f"CAST(round_even({n}*{z},0) AS INT) {m}" for n, m, z in zip(("nx", "ny", "nz"), ("mx", "my", "mz"), zoom, strict=True)) + f" FROM {src}"


def _swapped(src: str) -> str:
    return f"SELECT vol_id, mx nx, my ny, mz nz, nx mx, ny my, nz mz FROM {src}"


def _margin(n: int) -> str:
    return f"CAST(trunc(20e0/{_SIZE[n]}) AS INT)"


_CTE |= {
    "rough_step": _step("own_grid", (6, 6, 6)),
    "rough_back": _swapped("rough_step"),
    "rough_ct": f"SELECT {_P}, CAST(trunc(v) AS INT) v FROM ({_linear('rough_step', False)})",
    "rough_lab": f"SELECT {_P}, 5 AS label FROM rough_ct WHERE v>430 AND (vol_id%4<3 OR i<0)",
    "rough_full": _nearest("rough_back", "rough_lab"),
    "task_box": "SELECT g.vol_id, affine, nx ox, ny oy, nz oz, " + ", ".join(f"greatest(l{c}-{_margin(n)},0) lo_{c}, least(h{c}+{_margin(n)},n{x}-1) hi_{c}" for n, (c, x) in enumerate(zip("ijk", "xyz", strict=True))) + " FROM own_grid g JOIN (SELECT vol_id, min(i) li, max(i) hi, min(j) lj, max(j) hj, min(k) lk, max(k) hk FROM rough_full GROUP BY 1) b ON b.vol_id=g.vol_id",
    "task_grid": "SELECT vol_id, affine, CAST(hi_i-lo_i+1 AS INT) nx, CAST(hi_j-lo_j+1 AS INT) ny, CAST(hi_k-lo_k+1 AS INT) nz FROM task_box",
    "task_in": "SELECT c.vol_id, i-lo_i i, j-lo_j j, k-lo_k k, v FROM own_ct c JOIN task_box b ON b.vol_id=c.vol_id AND i BETWEEN lo_i AND hi_i AND j BETWEEN lo_j AND hi_j AND k BETWEEN lo_k AND hi_k",
    "task_step": _step("task_grid", (1.5, 1.5, 1.5)),
    "task_back": _swapped("task_step"),
    "task_ct": f"SELECT {_P}, CAST(trunc(v) AS INT) v FROM ({_linear('task_step', False, 'task_in')})",
    "task_seg": f"SELECT {_P}, CASE WHEN v>600 AND v%5<>0 THEN 7 WHEN v>0 AND v%3=0 THEN 2 WHEN v>0 AND v%2=0 THEN 4 END AS label FROM task_ct WHERE v>600 AND v%5<>0 OR v>0 AND (v%3=0 OR v%2=0)",
    "task_full": _nearest("task_back", "task_seg"),
}


def _labelled(rules):
    """A model that labels voxels by conditions, the first that holds."""

    def model(vox, grids):
        label = F.lit(None).cast("int")
        for condition, n in reversed(rules):
            label = F.when(F.expr(condition), n).otherwise(label)
        return vox.select("vol_id", "i", "j", "k", label.alias("label")).where("label is not null")

    return model


@_query("SELECT f.vol_id, i+lo_i AS i, j+lo_j AS j, k+lo_k AS k, label FROM task_full f JOIN task_box b ON b.vol_id=f.vol_id WHERE label IN (2,7)")
def task_total(spark, d):
    """The task total with a region: rough pass, boxes, two part models, merge, and back. The models are conditions on voxels."""
    models = {planning.CROP: _labelled([("v > 430 and vol_id % 4 < 3", 5)]), 291: _labelled([("v > 0 and v % 3 = 0", 1), ("v > 0 and v % 2 = 0", 3)]), 293: _labelled([("v > 600 and v % 5 <> 0", 2)])}
    mapping = spark.createDataFrame([(291, 1, 2), (291, 3, 4), (293, 2, 7)], "part int, label int, task_label int")
    plan = planning.Plan("total", *planning.TASKS["total"], [291, 293], ["region"], ["region"])
    return tasks.run(fx.own_ct(spark, d), fx.grids(spark, d), plan, models, mapping, [5], [2, 7])
