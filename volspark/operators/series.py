"""Catalogue of image series from slice headers (study, series_uid, description, modality, nrows, ncols, localizer, tilt, pos, instance, file)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PORTAL = r"(?i)portal|venous|\bpv\b|門脈"


def modal_size(slices: DataFrame) -> DataFrame:
    """(series_uid, nrows, ncols, n): the commonest image size without localizers; of equal ones that of fewest rows, then columns."""
    sizes = slices.where("not localizer").groupBy("series_uid", "nrows", "ncols").agg(F.count("*").alias("n"))
    best = F.max(F.struct("n", (-F.col("nrows")).alias("r"), (-F.col("ncols")).alias("c")))
    return sizes.groupBy("series_uid").agg(best.alias("b")).select("series_uid", (-F.col("b.r")).alias("nrows"), (-F.col("b.c")).alias("ncols"), F.col("b.n").alias("n"))


def usable_slices(slices: DataFrame) -> DataFrame:
    """The slices a series' volume is built from, with `total`: all of its files. One shuffle by series: the size of most
    slices comes from window counts over the same partitions."""
    own = Window.partitionBy("series_uid")
    counted = slices.withColumn("total", F.count("*").over(own)).withColumn("__n", F.sum((~F.col("localizer")).cast("int")).over(Window.partitionBy("series_uid", "nrows", "ncols")))
    best = F.max(F.when(~F.col("localizer"), F.struct("__n", (-F.col("nrows")).alias("r"), (-F.col("ncols")).alias("c")))).over(own)
    ranked = counted.withColumn("__b", best)
    ok = ~F.col("localizer") & (F.col("nrows") == -F.col("__b.r")) & (F.col("ncols") == -F.col("__b.c"))
    return ranked.withColumn("used", F.coalesce(ok, F.lit(False))).drop("__n", "__b")


def catalogue(slices: DataFrame) -> DataFrame:
    """(study, series_uid, description, modality, n_slices, n_others, gap, extent, least_gap, problem), a row for each series.

    Attributes are those of the first usable file, or of the first file of a series that has none. The gap is the upper
    median of neighbouring positions' differences.
    """
    # slices without a position do not take part in the gaps
    d = usable_slices(slices).withColumn("d", F.when(F.col("used") & F.col("pos").isNotNull(), F.col("pos") - F.lag("pos").over(Window.partitionBy("series_uid", "used").orderBy("pos", "file"))))
    use = lambda c: F.when(F.col("used"), F.col(c))
    first = F.min(F.struct((~F.col("used")).alias("u"), "file", "study", "description", "modality"))
    g = d.groupBy("series_uid").agg(
        first.alias("f"), F.sum(F.col("used").cast("long")).alias("n_slices"), F.count("*").alias("total"), F.min("d").alias("least_gap"), F.sort_array(F.collect_list("d")).alias("ds"),
        F.min(use("pos")).alias("lo"), F.max(use("pos")).alias("hi"), F.min(use("tilt")).alias("t0"), F.max(use("tilt")).alias("t1"),
    )
    problem = (
        F.when(F.col("least_gap") <= 1e-6, "duplicate slice positions").when((F.col("n_slices") >= 2) & (F.col("t1") - F.col("t0") > 1e-4), "slices with different orientations")
        .when(F.col("n_slices") == 0, "localizer only").when(F.col("n_slices") < 2, "single image")
    )
    gaps = F.size("ds") > 0
    return g.select(
        "f.study", "series_uid", "f.description", "f.modality", "n_slices", (F.col("total") - F.col("n_slices")).alias("n_others"),
        F.when(gaps, F.element_at("ds", F.floor(F.size("ds") / 2).cast("int") + 1)).alias("gap"), F.when(gaps, F.col("hi") - F.col("lo")).alias("extent"), "least_gap", problem.alias("problem"),
    )


def spacing_check(slices: DataFrame) -> DataFrame:
    """(series_uid, least, most, mean, uneven) of the gaps between a series' slices that have positions: uneven if they differ by
    over 5 % of the mean and 0.001."""
    own = usable_slices(slices).where("used and pos is not null")
    d = own.withColumn("d", F.col("pos") - F.lag("pos").over(Window.partitionBy("series_uid").orderBy("pos", "file"))).where("d is not null")
    g = d.groupBy("series_uid").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.sum("d").alias("s"), F.count("*").alias("n"))
    mean = F.col("s") / F.col("n")
    return g.select("series_uid", "least", "most", mean.alias("mean"), (F.col("most") - F.col("least") > 0.05 * F.abs(mean) + 1e-3).alias("uneven"))


def stacked(slices: DataFrame) -> DataFrame:
    """(series_uid, file, k): the usable slices' order, by position where all have one, else by instance number; ties by file."""
    own = usable_slices(slices).where("used")
    placed = own.withColumn("all", F.count("pos").over(Window.partitionBy("series_uid")) == F.count("*").over(Window.partitionBy("series_uid")))
    key = F.when(F.col("all"), F.col("pos")).otherwise(F.col("instance"))
    return placed.withColumn("key", key).select("series_uid", "file", (F.row_number().over(Window.partitionBy("series_uid").orderBy("key", "file")) - 1).cast("long").alias("k"))


def _order() -> list:
    return [F.col("problem").isNotNull(), F.coalesce(F.col("modality") != "CT", F.lit(True)), F.desc("n_slices"), F.col("series_uid")]


def ranked(series: DataFrame) -> DataFrame:
    """series with `place` in its study: those without a problem, then CT, then most slices, then the smallest id."""
    return series.withColumn("place", F.row_number().over(Window.partitionBy("study").orderBy(*_order())).cast("long"))


def default_series(series: DataFrame, strict: bool = True) -> DataFrame:
    """The first series of each study; a study whose first series has a problem is an error, or left out if not strict."""
    first = ranked(series).where("place = 1").drop("place")
    if not strict:
        return first.where("problem is null")
    said = F.raise_error(F.concat(F.lit("no usable series: "), F.col("problem"))).cast("string")
    return first.withColumn("problem", F.when(F.col("problem").isNotNull(), said))


def suggested_series(series: DataFrame, pattern: str = PORTAL) -> DataFrame:
    """(study, series_uid, matched): of each study's buildable CT series (or of unknown modality) with two slices or more the first in
    order whose description fits and that has 0.8 times the most slices; else the first; without any the study's first buildable, or first, series."""
    ok = (F.col("n_slices") >= 2) & F.col("problem").isNull()
    ct = ok & (F.coalesce(F.col("modality"), F.lit("")).isin("CT", ""))
    r = ranked(series).withColumn("ct", ct).withColumn("most", F.max(F.when(ct, F.col("n_slices"))).over(Window.partitionBy("study")))
    fits = F.col("ct") & F.coalesce(F.col("description").rlike(pattern), F.lit(False)) & (F.col("n_slices") >= 0.8 * F.col("most"))
    best = F.min(F.struct((~fits).alias("a"), (~F.col("ct")).alias("b"), (~ok).alias("c"), "place", "series_uid"))
    return r.groupBy("study").agg(best.alias("x")).select("study", "x.series_uid", (~F.col("x.a")).alias("matched"))


def listing(series: DataFrame) -> DataFrame:
    """(series_uid, line): tab-separated text of a series; tabs and line ends inside a value become blanks."""
    clean = [F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), r"[\t\r\n]", " ") for c in ("series_uid", "description", "modality", "n_slices", "n_others", "problem")]
    return series.select("series_uid", F.concat_ws("\t", *clean).alias("line"))
