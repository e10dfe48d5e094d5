"""Volumes, series, runs, class maps and meshes derived from the relational tables; their number grows with the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from volspark.operators.labels import PLACE, spread

SHAPE = (32, 32, 24)
#: Orders whose lines fill one volume.
ORDERS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _voxel():
    cells = [(F.col(c) % n).cast("int").alias(v) for c, n, v in zip(("l_orderkey", "l_partkey", "l_suppkey"), SHAPE, "ijk", strict=True)]
    return [F.floor(F.col("l_orderkey") / ORDERS).cast("int").alias("vol_id"), *cells]


def ct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vol_id, i, j, k, hu)."""
    return table(spark, sf_dir, "lineitem").groupBy(*_voxel()).agg(F.max(40 * F.col("l_quantity") - 1000).cast("int").alias("hu"))


def _sized(spark: SparkSession, sf_dir: str, voxel) -> DataFrame:
    """(vol_id, i, j, k, size): a row for each line, from 0 to 5 by its part; in more partitions if there are more lines."""
    lines, parts = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    rows = lines.count()
    met = spread(lines, rows, "l_partkey").join(spread(parts, rows, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
    return spread(met.select(*voxel, (F.col("p_size") % 6).alias("size")), rows, *PLACE)


def labels(spark: SparkSession, sf_dir: str, pick=F.max) -> DataFrame:
    """(vol_id, i, j, k, label); pick F.min gives a second map over the same voxels."""
    return _sized(spark, sf_dir, _voxel()).groupBy(*PLACE).agg(pick("size").cast("int").alias("label"))


def _own_sides(vol):
    """Sides of a volume's own grid."""
    return [32 - 4 * (vol % 3), 28 + 2 * (vol % 2), 24 - 3 * (vol % 4)]


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vol_id, nx, ny, nz, affine): a grid of its own shape, spacing and orientation for each volume of own_ct and own_labels."""
    vol = F.col("vol_id")
    sx, sy, sz = 0.7 + 0.1 * (vol % 3), F.lit(0.8), F.when(vol % 2 == 0, 1.5).otherwise(5.0)
    o, one = F.lit(0.0), F.lit(1.0)
    flipped = F.array(-sx, o, o, F.lit(90.0), o, -sy, o, F.lit(80.5), o, o, sz, F.lit(-7.0), o, o, o, one)
    swapped = F.array(o, sy, o, F.lit(-3.0), o, o, -sz, F.lit(12.0), sx, o, o, F.lit(4.25), o, o, o, one)
    turned = F.array(sx * 0.96, sy * -0.28, o, F.lit(1.0), sx * 0.28, sy * 0.96, o, F.lit(2.0), o, o, sz, F.lit(3.0), o, o, o, one)
    vols = table(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / ORDERS).cast("int").alias("vol_id")).distinct()
    sides = [n.cast("int").alias(s) for n, s in zip(_own_sides(vol), ("nx", "ny", "nz"), strict=True)]
    return vols.select("vol_id", *sides, F.when(vol % 3 == 0, flipped).when(vol % 3 == 1, swapped).otherwise(turned).alias("affine"))


def _own_voxel():
    vol = F.floor(F.col("l_orderkey") / ORDERS).cast("int")
    cells = [(F.col(c) % n).cast("int").alias(v) for c, n, v in zip(("l_orderkey", "l_partkey", "l_suppkey"), _own_sides(vol), "ijk", strict=True)]
    return [vol.alias("vol_id"), *cells]


def own_ct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vol_id, i, j, k, v): images on grids of their own."""
    return table(spark, sf_dir, "lineitem").groupBy(*_own_voxel()).agg(F.max(40 * F.col("l_quantity") - 1000).cast("int").alias("v"))


def own_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vol_id, i, j, k, label): label maps on the same grids."""
    return _sized(spark, sf_dir, _own_voxel()).groupBy(*PLACE).agg(F.max("size").cast("int").alias("label"))


def slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(study, series_uid, description, modality, nrows, ncols, localizer, tilt, pos, instance, file): image headers.

    One series for each order, one study for each customer; tilt is a component of the orientation, pos the place along
    the series' normal, null where a file has none.
    """
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return lines.select(
        F.col("o_custkey").alias("study"),
        F.col("l_orderkey").cast("string").alias("series_uid"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "Portal venous").otherwise(F.col("o_orderpriority")).alias("description"),
        F.when(F.col("o_orderstatus") == "P", "MR").otherwise("CT").alias("modality"),
        F.when(F.col("l_returnflag") == "R", 256).otherwise(512).alias("nrows"),
        F.when(F.col("l_linestatus") == "O", 512).otherwise(256).alias("ncols"),
        (F.col("l_discount") >= 0.09).alias("localizer"),
        F.when((F.col("l_orderkey") % 5 == 0) & (F.col("l_linenumber") == 2), 0.001).otherwise(0.0).alias("tilt"),
        F.when(F.col("l_orderkey") % 7 != 0, 5.0 * F.col("l_linenumber")).alias("pos"),
        F.col("l_linenumber").alias("instance"),
        F.concat_ws("_", "l_linenumber", "l_partkey", "l_suppkey").alias("file"),
    )


def organs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vol_id, i, j, k, label): two ellipsoids in each volume, on the grids of own_labels."""
    cells = grids(spark, sf_dir)
    for c, n in zip("ijk", ("nx", "ny", "nz"), strict=True):
        cells = cells.withColumn(c, F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    far = lambda x, y, z, r: sum(F.pow((F.col(c) - F.col(n) * f) / s, 2) for c, n, f, s in zip("ijk", ("nx", "ny", "nz"), (x, y, z), r, strict=True))
    label = F.when(far(0.3, 0.4, 0.5, (6.5, 8.0, 5.5)) <= 1, 2).when(far(0.75, 0.6, 0.45, (4.0, 5.0, 6.0)) <= 1, 5)
    return cells.select("vol_id", "i", "j", "k", label.alias("label")).where("label is not null")


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image slices with their pixels (operators.building), a series for each order: unpositioned, tilted, uneven, doubled and turned ones among
    them. Images of 4 x 3 words of 16 bits, of which 12 or all are stored."""
    key, line = F.col("l_orderkey"), F.col("l_linenumber")
    # named once, as each is used many times; 16-bit words with their bytes swapped, three at once behind a one that keeps leading zeros
    word = lambda p: F.col("__word") + p * p * 911
    swapped = lambda p: F.shiftleft(word(p).bitwiseAND(255), 8).bitwiseOR(F.shiftright(word(p), 8).bitwiseAND(255))
    three = lambda p: F.shiftleft(F.shiftleft(swapped(p).bitwiseOR(65536), 16).bitwiseOR(swapped(p + 1)), 16).bitwiseOR(swapped(p + 2))
    raw = F.unhex(F.concat(*[F.substring(F.hex(three(p)), 2, 12) for p in range(0, 12, 3)]))
    rows = table(spark, sf_dir, "lineitem").withColumn("__word", F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + line * 31).withColumn("__raw", raw)
    bent = F.when((key % 5 == 0) & (line == 2), 0.001).otherwise(0.0)
    iop = F.when(key % 4 == 1, F.array(*map(F.lit, (0.96, 0.28, 0.0, -0.28, 0.96)), bent)).otherwise(F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0, 1.0)), bent))
    ipp = F.array((key % 9).cast("double"), F.when(key % 11 == 0, line * 0.5).otherwise(-3.5), line * 2.5)
    return rows.select(
        key.cast("string").alias("series_uid"), F.concat_ws("_", "l_linenumber", "l_partkey", "l_suppkey").alias("file"), (F.col("l_discount") >= 0.09).alias("localizer"), F.lit(3).alias("nrows"), F.when(F.col("l_tax") > 0.07, 6).otherwise(4).alias("ncols"),
        F.when(key % 7 != 0, ipp).alias("ipp"), iop.alias("iop"), F.array(F.lit(0.5), 0.75 + 0.25 * (key % 3)).alias("gap"), F.when(key % 2 == 0, 2.5).otherwise(0.0).alias("thickness"), line.alias("instance"), F.when(F.col("l_tax") > 0.07, F.concat("__raw", F.substring("__raw", 1, 12))).otherwise(F.col("__raw")).alias("raw"),
        F.lit(16).alias("bits_allocated"), F.when(key % 2 == 0, 12).otherwise(16).alias("bits_stored"), (key % 3 == 0).alias("signed"), F.when(key % 4 == 0, 0.5).otherwise(1.0).alias("slope"), F.lit(-1024.0).alias("intercept"),
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, scores): one voxel's class scores a row."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("scores"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(environment, backend, case_id, task, rep, secs, hash): benchmark records."""
    order = Window.partitionBy("event_type", "user_id", F.col("event_id") % 3).orderBy("ts", "event_id")
    found = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("environment"), F.when(F.col("event_id") % 4 == 0, "cpu (after failure)").when(F.col("event_id") % 4 == 1, "cpu").otherwise("webgpu").alias("backend"),
        F.col("user_id").alias("case_id"), (F.col("event_id") % 3).alias("task"),
        F.row_number().over(order).cast("long").alias("rep"), F.col("value").alias("secs"),
    )
    # some cases come out otherwise the second time, some on the other path
    case = F.col("case_id")
    other = F.when((case % 5 == 0) & (F.col("rep") == 2), 1).otherwise(0) + F.when((case % 3 == 0) & F.col("backend").startswith("cpu"), 2).otherwise(0)
    return found.withColumn("hash", case * 10 + F.col("task") + other)


def class_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): lines of a class map, every nation a structure of the task and of its region's model; one comment."""
    n = table(spark, sf_dir, "nation")
    task = n.select(F.concat_ws(" ", F.lit("task total"), F.col("n_nationkey") + 1, F.lower(F.regexp_replace("n_name", " ", "_"))).alias("value"))
    part = n.select(F.concat_ws(" ", F.lit("part"), F.col("n_regionkey") + 291, F.col("n_nationkey") % 5 + 1 + F.floor(F.col("n_nationkey") / 5) * 5, F.lower(F.regexp_replace("n_name", " ", "_"))).alias("value"))
    return task.union(part).union(spark.createDataFrame([("# classes",)], "value string"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, name, color): a registry of structures; label 5 is unnamed."""
    return table(spark, sf_dir, "region").select((F.col("r_regionkey")).cast("int").alias("label"), F.lower("r_name").alias("name"), (F.col("r_regionkey") * 40).cast("int").alias("color"))


def vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mesh_id, vid, x, y, z), a mesh for each thirty customers."""
    c = table(spark, sf_dir, "customer")
    xyz = [(F.col("c_custkey") * a % m).cast("double").alias(v) for a, m, v in ((3, 17, "x"), (5, 23, "y"), (7, 29, "z"))]
    return c.select(F.floor(F.col("c_custkey") / 30).cast("int").alias("mesh_id"), (F.col("c_custkey") % 30).cast("int").alias("vid"), *xyz)


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(mesh_id, tid, a, b, c): neighbouring vertices of each mesh."""
    v = vertices(spark, sf_dir).where("vid between 1 and 27")
    return v.select("mesh_id", F.col("vid").alias("tid"), F.col("vid").alias("a"), (F.col("vid") + 1).alias("b"), (F.col("vid") * 7 % 29).cast("int").alias("c"))


def actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vol_id, seq, action, n, event_id): what each user edited, undid and redid."""
    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    kind = F.col("event_id") % 7
    action = F.when(kind < 4, "edit").when(kind < 6, "undo").otherwise("redo")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("vol_id"), seq.alias("seq"), action.alias("action"), (1 + F.col("event_id") % 3).alias("n"), "event_id")


def edit_voxels(actions: DataFrame) -> DataFrame:
    """(vol_id, seq, i, j, k, label): the n voxels of each edit."""
    rows = actions.where("action = 'edit'").withColumn("x", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    p = (F.col("event_id") + 5 * F.col("x")) % 16
    return rows.select("vol_id", "seq", (p % 4).cast("int").alias("i"), F.floor(p / 4).cast("int").alias("j"), (F.col("vol_id") % 3).cast("int").alias("k"), (F.col("event_id") % 5).cast("int").alias("label"))


def label_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Files (file, vol_id), cells (file, i, j, k, v), grids and side-cars of the own label maps: f<volume> as they are, g<volume> with
    values that are not whole or over 255."""
    vol, odd = F.col("vol_id"), F.col("i") % 2 == 1
    named = F.explode(F.array(*[F.concat(F.lit(x), vol.cast("string")) for x in "fg"]))
    wrong = F.when(odd & (vol % 2 == 1), 0.5).when(odd, 300.0).otherwise(0.0004)
    cells = own_labels(spark, sf_dir).select("*", named.alias("file")).withColumn("v", F.col("label") + F.when(F.col("file").startswith("g"), wrong).otherwise(0.0004))
    own = grids(spark, sf_dir).select("*", named.alias("file"))
    text = F.when(vol % 7 == 6, '{"labels":').when(vol % 3 < 2, '{"labels":[{"id":1,"name":"one"},{"id":2,"name":""},{"id":3,"name":"x"},{"id":3,"name":"lever","color":[0.1,0.2,0.3],"verified":true}]}')
    sidecars = own.select("file", text.alias("json")).where("json is not null")
    return own.select("file", "vol_id"), cells.select("file", "i", "j", "k", "v"), own.drop("vol_id"), sidecars
