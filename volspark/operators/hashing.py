"""32-bit FNV-1a over the dense label bytes of each volume, from parts that combine in any grouping.

A step takes h to (h xor b) * p. As b is a byte, that is p * h plus a term that depends on h's low byte alone, and the next low byte
depends on this one alone, too. So what any stretch of bytes does to h is a power of p, given by its length, and a table of 256
terms; two neighbouring stretches give the table of both.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The hash's prime and start.
PRIME, START, WORD = 16777619, 2166136261, 1 << 32


def _powers(n: np.ndarray) -> np.ndarray:
    """The prime to the n-th."""
    out, base, n = np.ones(n.shape, np.uint32), PRIME, n.astype(np.int64).copy()
    while n.any():
        out = np.where(n & 1, out * np.uint32(base), out)
        base, n = base * base % WORD, n >> 1
    return out


def stretches(places: list, steps: list, lengths: np.ndarray, spans: list | None = None) -> np.ndarray:
    """Tables (rows, 256) of stretches: row r has bytes or tables steps[r] at the increasing places[r], zeros elsewhere, lengths[r] in all.

    A step is a byte or, with spans, the table of as many bytes. All rows go on together, one step at a time.
    """
    rows, most = len(places), max((len(p) for p in places), default=0)
    low = np.tile(np.arange(256, dtype=np.uint32), (rows, 1))
    c = np.zeros((rows, 256), np.uint32)
    at = np.zeros(rows, np.int64)
    for t in range(most):
        on = np.flatnonzero([len(p) > t for p in places])
        place = np.array([places[r][t] for r in on], np.int64)
        gap = _powers(place - at[on])[:, None]
        own_c, own_low = c[on] * gap, low[on] * gap & np.uint32(255)
        if spans is None:
            mixed = own_low ^ np.array([steps[r][t] for r in on], np.uint32)[:, None]
            own_c, own_low = (own_c + mixed - own_low) * np.uint32(PRIME), mixed * np.uint32(PRIME) & np.uint32(255)
            at[on] = place + 1
        else:
            span = np.array([spans[r][t] for r in on], np.int64)
            term = np.take_along_axis(np.stack([np.frombuffer(steps[r][t], np.uint32) for r in on]), own_low.astype(np.int64), 1)
            power = _powers(span)[:, None]
            own_c, own_low = own_c * power + term, (own_low * power + term) & np.uint32(255)
            at[on] = place + span
        c[on], low[on] = own_c, own_low
    return c * _powers(lengths - at)[:, None]


@F.pandas_udf(T.BinaryType())
def _of_bytes(places: pd.Series, values: pd.Series, lengths: pd.Series) -> pd.Series:
    return pd.Series([t.tobytes() for t in stretches(list(places), list(values), lengths.to_numpy(np.int64))])


@F.pandas_udf(T.BinaryType())
def _of_tables(places: pd.Series, spans: pd.Series, tables: pd.Series, lengths: pd.Series) -> pd.Series:
    return pd.Series([t.tobytes() for t in stretches(list(places), list(tables), lengths.to_numpy(np.int64), list(spans))])


@F.pandas_udf(T.LongType())
def _ended(table: pd.Series, length: pd.Series) -> pd.Series:
    terms = np.array([np.frombuffer(t, np.uint32)[START & 255] for t in table], np.uint32)
    return pd.Series((_powers(length.to_numpy(np.int64)) * np.uint32(START) + terms).astype(np.int64))


def dense_hash(lab: DataFrame, grids: DataFrame) -> DataFrame:
    """(vol_id, hash) of every grid (vol_id, nx, ny, nz): FNV-1a over its label bytes in the order of the dense array, the last axis fastest;
    voxels missing in lab (vol_id, i, j, k, label) are 0.

    Lines along the last axis become tables of 1 KB, lines planes, planes volumes: no row holds more than a line of voxels or the
    tables of a plane's lines or a volume's planes. Lines and planes of zeros have no row.
    """
    from volspark.operators.geometry import on_grid

    own = on_grid(lab.where("label > 0"), grids, "nx", "ny", "nz")
    cell = F.sort_array(F.collect_list(F.struct("k", F.col("label").cast("int").alias("b"))))
    lines = own.groupBy("vol_id", "i", "j", "nx", "ny", "nz").agg(cell.alias("c"))
    lines = lines.select("vol_id", "i", "j", "nx", "ny", "nz", _of_bytes("c.k", "c.b", F.col("nz").cast("long")).alias("t"))

    def joined(rows: DataFrame, place: str, span, length, keys: list[str]) -> DataFrame:
        some = F.sort_array(F.collect_list(F.struct((F.col(place) * span).cast("long").alias("p"), span.cast("long").alias("n"), "t")))
        out = rows.groupBy(*keys).agg(some.alias("s"))
        return out.select(*keys, _of_tables("s.p", "s.n", "s.t", length.cast("long")).alias("t"))

    planes = joined(lines, "j", F.col("nz"), F.col("ny") * F.col("nz"), ["vol_id", "i", "nx", "ny", "nz"])
    size = F.col("nx").cast("long") * F.col("ny") * F.col("nz")
    whole = joined(planes, "i", F.col("ny") * F.col("nz"), size, ["vol_id", "nx", "ny", "nz"]).select("vol_id", "t")
    zeros = F.lit(bytes(1024))
    return grids.select("vol_id", size.alias("n")).join(whole, "vol_id", "left").select("vol_id", _ended(F.coalesce("t", zeros), F.col("n")).alias("hash"))
