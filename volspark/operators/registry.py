"""Structures of a volume: names, ids, colours, and what a user sees of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from volspark.operators.labels import PLACE, histogram, small


def auto_color(label: Column) -> list[Column]:
    """Red, green and blue from 0 to 1 of an id: hues a golden angle apart, saturation 0.6, lightness 0.55."""
    hue = label * 137.508 % 360 / 360

    def channel(k: int) -> Column:
        t = (F.lit(k) + hue * 12) % 12
        return 0.55 - 0.27 * F.greatest(F.lit(-1.0), F.least(t - 3, 9 - t, F.lit(1.0)))

    return [channel(0), channel(8), channel(4)]


def color_table(labels: DataFrame) -> DataFrame:
    """(label, red, green, blue) of each label, 0 to 255, rounded half up."""
    return labels.select("label", *[F.floor(c * 255 + 0.5).cast("int").alias(n) for c, n in zip(auto_color(F.col("label")), ("red", "green", "blue"), strict=True)])


def clean_name(name: Column) -> Column:
    """Trimmed, with _ for white space."""
    return F.regexp_replace(F.trim(name), r"\s+", "_")


def ensured(registry: DataFrame, wanted: DataFrame) -> DataFrame:
    """(vol_id, label, name, fresh) of registry (vol_id, label, name) and the names in wanted (vol_id, name, place) it lacks.

    New names get a volume's free ids from 1 to 255 in the order of their places; more names than ids are an error.
    """
    lacking = wanted.groupBy("vol_id", "name").agg(F.min("place").alias("place")).join(registry, ["vol_id", "name"], "left_anti")
    lacking = lacking.withColumn("r", F.row_number().over(Window.partitionBy("vol_id").orderBy("place", "name")))
    ids = lacking.select("vol_id").distinct().withColumn("label", F.explode(F.sequence(F.lit(1), F.lit(255))))
    free = ids.join(registry.select("vol_id", "label"), ["vol_id", "label"], "left_anti")
    free = free.withColumn("r", F.row_number().over(Window.partitionBy("vol_id").orderBy("label")))
    given = lacking.join(free, ["vol_id", "r"], "left")
    label = F.coalesce("label", F.raise_error(F.lit("over 255 labels")).cast("int"))
    return registry.select("vol_id", "label", "name", F.lit(False).alias("fresh")).union(given.select("vol_id", label.alias("label"), "name", F.lit(True).alias("fresh")))


def applied(current: DataFrame, result: DataFrame, names: DataFrame, registry: DataFrame) -> DataFrame:
    """(vol_id, i, j, k, label): the current map under a result, whose labels over 0 win under the ids of their names.

    names (label, name); a label without one is called label_<number>.
    """
    called = result.where("label > 0").join(small(names.select("label", "name")), "label", "left").withColumn("name", F.coalesce("name", F.concat(F.lit("label_"), F.col("label").cast("string"))))
    ids = ensured(registry, called.select("vol_id", "name", F.col("label").alias("place")).distinct())
    new = called.select(*PLACE, "name").join(ids.select("vol_id", "name", F.col("label").alias("new")), ["vol_id", "name"]).select(*PLACE, "new")
    return current.join(new, PLACE, "full").select(*PLACE, F.coalesce("new", "label", F.lit(0)).alias("label"))


def found(registry: DataFrame, text: str) -> DataFrame:
    """Labels whose name has the text in it, in any case, in order."""
    return registry.where(F.lower("name").contains(text.lower()))


def renamed(registry: DataFrame, label: int, name: str) -> DataFrame:
    """A structure under another name, white space as _; a name that another structure of the volume has is an error."""
    new = clean_name(F.lit(name))
    taken = F.max((F.col("name") == new) & (F.col("label") != label)).over(Window.partitionBy("vol_id"))
    own = registry.withColumn("__t", taken)
    changed = F.when(F.col("__t"), F.raise_error(F.lit("the name is taken")).cast("string")).otherwise(new)
    return own.withColumn("name", F.when(F.col("label") == label, changed).otherwise(F.col("name"))).drop("__t")


def metadata(lab: DataFrame, names: DataFrame) -> DataFrame:
    """(vol_id, json): the labels of each map with names and voxel counts, by label."""
    named = histogram(lab.where("label > 0")).join(small(names.select("label", "name")), "label", "left")
    entry = F.struct("label", F.coalesce("name", F.concat(F.lit("label_"), F.col("label").cast("string"))).alias("name"), F.col("n").alias("voxels"))
    return named.groupBy("vol_id").agg(F.to_json(F.struct(F.sort_array(F.collect_list(entry)).alias("labels"))).alias("json"))


def stale(lab: DataFrame, registry: DataFrame) -> DataFrame:
    """Structures of the registry (vol_id, label, ..) without a voxel."""
    return registry.join(lab.select("vol_id", "label").distinct(), ["vol_id", "label"], "left_anti")
