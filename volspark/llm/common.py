"""Helpers that the text operators share."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.operators.graph import shared  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A key is hot if it holds over 1 of HEAVY rows.
HEAVY = 1000
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else."""
    return F.translate(c, UPPER, LOWER)


def text_bytes(c: str | Column = "text") -> Column:
    """The UTF-8 bytes of a text; a null text reads as the empty one."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(c.cast("string"), F.lit("")).cast("binary")


def fold(c: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo the number of parts; a null id reads as the empty text."""
    c = F.col(c) if isinstance(c, str) else c
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % parts


def join_skewed(big: DataFrame, small: DataFrame, keys: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """big joined with small, whose keys are unique, where some keys hold many rows of big.

    hot: the keys of over 1/HEAVY of big's rows, which are at most HEAVY rows by that bound. Their part of small is
    broadcast, so big's rows of such a key stay where they are; all others meet in a shuffle.
    """
    few = F.broadcast(small.join(F.broadcast(hot.select(*keys)), keys, "left_semi"))
    marked = F.broadcast(hot.select(*keys).withColumn("__hot", F.lit(True)))
    tagged = big.join(marked, keys, "left")
    heavy = tagged.where("__hot").drop("__hot").join(few, keys, how)
    rest = tagged.where("__hot is null").drop("__hot").join(small, keys, how)
    return heavy.unionByName(rest)


def released() -> None:
    """Gives memory that earlier tasks of a reused worker have freed back to the machine, where the C library can."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def doc_slices(offsets: np.ndarray, most: int):
    """Runs of whole rows of at most `most` bytes (one row may be longer): (first row, end row)."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        yield first, min(end, rows)
        first = end


def binary_buffers(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow binary array without a copy; nulls have no bytes."""
    import pyarrow as pa

    if pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]
