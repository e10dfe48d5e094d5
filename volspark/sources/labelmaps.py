"""Label maps from files: what is refused and why, names from a side-car, and how a map joins what a volume has.

Files are (file, vol_id): the volume that each is meant for. Their voxels are (file, i, j, k, v), their grids (file, nx, ny,
nz, affine), as a reader of images gives them; side-cars are (file, json).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.operators import geometry, registry
from volspark.operators.labels import PLACE

#: How far a value may be from a whole number.
NEAR = 1e-3
SIDECAR = "labels array<struct<id: int, name: string, color: array<double>, verified: boolean, source: string>>, broken string"


def stem(path: Column) -> Column:
    """A file's name without folder and ending, by which a side-car is found."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"(\.nii)?(\.gz)?$|(\.meta)?\.json$", "")


def _as_volume(df: DataFrame) -> DataFrame:
    """Rows by file as rows by volume, for operators over grids."""
    return df.drop("vol_id").withColumnRenamed("file", "vol_id")


def _shape(names: tuple[str, str, str]) -> Column:
    return F.concat_ws("x", *names)


def refusals(files: DataFrame, cells: DataFrame, plan: DataFrame, targets: DataFrame) -> DataFrame:
    """(file, vol_id, problem) of files that cannot be used, with the first of these reasons: no such volume among targets (vol_id, nx, ny, nz), no
    grid, an axis that points nowhere, a value that is negative or not whole, one over 255, another shape than the volume's.

    plan: `geometry.canonical_plan` of the files' grids, under the name vol_id. A value that is no number is not whole.
    """
    v = F.col("v")
    off = v.isNull() | F.isnan("v") | (v < 0) | (F.abs(v - F.floor(v + 0.5)) > NEAR)
    worst = cells.groupBy("file").agg(F.count_if(off).alias("n_off"), F.max("v").alias("most"))
    own = plan.select(F.col("vol_id").alias("file"), F.col("problem").alias("__turn"), _shape(("mx", "my", "mz")).alias("__have"))
    want = targets.select("vol_id", _shape(("nx", "ny", "nz")).alias("__want"))
    out = files.select("file", "vol_id").join(own, "file", "left").join(want, "vol_id", "left").join(worst, "file", "left")
    problem = (
        F.when(F.col("__want").isNull(), "no such volume").when(F.col("__have").isNull(), "no grid").when(F.col("__turn").isNotNull(), F.col("__turn"))
        .when(F.col("n_off") > 0, "label values that are not whole numbers from 0 to 255").when(F.col("most") >= 255.5, "label values over 255")
        .when(F.col("__have") != F.col("__want"), F.concat(F.lit("grid "), "__have", F.lit(" instead of "), "__want"))
    )
    return out.select("file", "vol_id", problem.alias("problem")).where("problem is not null")


def imported(files: DataFrame, cells: DataFrame, grids: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((file, vol_id, i, j, k, label) over 0 on the volumes' grids, refusals): files turned to the nearest orientation to right, front, up
    and rounded; a file with a problem gives a refusal and no voxel."""
    plan = geometry.canonical_plan(_as_volume(grids))
    bad = refusals(files, cells, plan, targets)
    good = files.select("file", "vol_id").join(bad.select("file"), "file", "left_anti")
    whole = cells.select("file", "i", "j", "k", F.floor(F.col("v") + 0.5).cast("int").alias("label")).where("label > 0")
    turned = geometry.reoriented(_as_volume(whole), plan).withColumnRenamed("vol_id", "file")
    return turned.join(good, "file").select("file", *PLACE, "label"), bad


def sidecar_labels(sidecars: DataFrame) -> DataFrame:
    """(file, label, name, color, verified, source) of side-cars (file, json) with an array `labels`; of entries with one id the last
    counts. A colour of other than three numbers from 0 to 1 is null, as is an empty source; a text that is no JSON has no row."""
    read = sidecars.select("file", F.from_json("json", SIDECAR, {"columnNameOfCorruptRecord": "broken"}).alias("s")).where("s.broken is null")
    rows = read.select("file", F.posexplode("s.labels").alias("at", "l")).select("file", "at", "l.*").where("id is not null")
    last = rows.groupBy("file", F.col("id").alias("label")).agg(F.max(F.struct("at", "name", "color", "verified", "source")).alias("l"))
    color = F.when((F.size("l.color") == 3) & F.forall("l.color", lambda x: x.isNotNull() & x.between(0, 1)), F.col("l.color"))
    return last.select("file", "label", "l.name", color.alias("color"), F.coalesce("l.verified", F.lit(False)).alias("verified"), F.when(F.col("l.source") != "", F.col("l.source")).alias("source"))


def broken_sidecars(sidecars: DataFrame) -> DataFrame:
    """(file, problem) of side-cars that are no JSON."""
    read = sidecars.select("file", F.from_json("json", SIDECAR, {"columnNameOfCorruptRecord": "broken"}).alias("s"))
    return read.where("s.broken is not null").select("file", F.lit("the side-car is no JSON").alias("problem"))


def label_names(cells: DataFrame, known: DataFrame) -> DataFrame:
    """(file, vol_id, label, name) of the labels that imported cells have; label_<number> where known (file, label, name) has no name."""
    present = cells.select("file", "vol_id", "label").distinct()
    named = present.join(known.select("file", "label", "name"), ["file", "label"], "left")
    return named.select("file", "vol_id", "label", F.coalesce(F.when(F.col("name") != "", F.col("name")), F.concat(F.lit("label_"), F.col("label").cast("string"))).alias("name"))


def ids(names: DataFrame, have: DataFrame, replace: bool = False) -> tuple[DataFrame, DataFrame]:
    """((file, vol_id, label, name, new), the registry afterwards): imported labels under the volume's ids.

    have: the registry (vol_id, label, name). A name that a volume has keeps its id, others take free ones in the order of the files and their labels. With
    replace, volumes with an import lose their registry first.
    """
    if replace:
        have = have.join(names.select("vol_id").distinct(), "vol_id", "left_anti")
    place = F.row_number().over(Window.partitionBy("vol_id").orderBy("file", "label"))
    after = registry.ensured(have.select("vol_id", "label", "name"), names.select("vol_id", "name", place.alias("place")))
    new = names.join(after.select("vol_id", "name", F.col("label").alias("new")), ["vol_id", "name"])
    return new.select("file", "vol_id", "label", "name", "new"), after


def merged(current: DataFrame, cells: DataFrame, new: DataFrame, replace: bool = False) -> DataFrame:
    """(vol_id, i, j, k, label): current maps under imported ones with their new ids; of several files for one voxel the last by name
    wins. With replace, nothing else is left of volumes with an import."""
    named = cells.join(new.select("file", "label", "new"), ["file", "label"])
    top = named.groupBy(*PLACE).agg(F.max(F.struct("file", "new"))["new"].alias("new"))
    if replace:
        current = current.join(new.select("vol_id").distinct(), "vol_id", "left_anti")
    return current.select(*PLACE, "label").join(top, PLACE, "full").select(*PLACE, F.coalesce("new", "label").alias("label"))
