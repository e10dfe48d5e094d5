"""Connected components of a link table, by alternating star contractions."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shared(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the folder that all executors share.

    A local session that names no folder (tests, a notebook) gets one of its own; on a cluster that is an error, as no
    machine's own folder serves the others. Spark removes the files of frames no longer used if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(os.path.join(tempfile.gettempdir(), "volspark-checkpoints"))
    return df.checkpoint()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def connected_components(links: DataFrame, a: str, b: str, most_rounds: int = 60) -> DataFrame:
    """(node, root) of every node that has a link; root is the smallest node reachable.

    Each round hangs every node's larger neighbours on its smallest one, then every node's smaller
    neighbours likewise, until nothing moves. The minimum of a neighbourhood is a partial aggregate, so a
    node with very many neighbours is never gathered. Links to itself and null ends are ignored;
    no links give no rows.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct()
    edges = shared(edges)
    before = _state(edges)
    for _ in range(most_rounds):
        if not before[0]:
            break
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(small, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
        edges = shared(moved.union(small.select("u", F.col("m").alias("v"))).distinct())
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("the links did not settle")
    roots = edges.select("v").distinct().join(edges.select(F.col("u").alias("v")), "v", "left_anti")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
