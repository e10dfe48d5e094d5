"""Volumes from slices, and why some cannot be built."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from volspark.operators import building, geometry

SCHEMA = (
    "series_uid string, file string, localizer boolean, nrows int, ncols int, ipp array<double>, iop array<double>, gap array<double>, thickness double, instance int,"
    " raw binary, bits_allocated int, bits_stored int, signed boolean, slope double, intercept double"
)
AXIAL = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
RNG = np.random.default_rng(2)


def image(uid, n, z, bits=16, stored=12, signed=False, iop=AXIAL, shape=(3, 4), localizer=False, ipp=True, kind=None):
    words = RNG.integers(0, 1 << bits, shape, dtype=np.uint64).astype(f"<u{bits // 8}")
    return (uid, f"f{n}", localizer, *shape, [1.0, 2.0, z] if ipp else None, iop, [0.5, 0.75], 2.0, n, bytearray(words.tobytes()), bits, stored, signed, 0.5, -10.0), words


def values(words, bits, stored, signed):
    v = words.astype(np.int64) & ((1 << stored) - 1 if bits == 16 else (1 << bits) - 1)
    top = stored if bits == 16 else bits
    return (np.where(signed & (v >= 1 << (top - 1)), v - (1 << top), v) * 0.5 - 10.0).astype(np.float32)


@pytest.fixture(scope="module")
def slices(spark):
    some, kept = [], {}
    for uid, bits, stored, signed in (("a", 16, 12, True), ("b", 16, 16, True), ("c", 8, 8, True), ("d", 32, 20, False), ("e", 16, 10, False)):
        for n, z in enumerate((9.0, 3.0, 6.0)):
            row, words = image(uid, n, z, bits, stored, signed)
            some.append(row)
            kept[uid, z] = values(words, bits, stored, signed)
    bent = [*AXIAL[:5], 0.001]
    some += [image("one", 0, 1.0)[0], image("local", 0, 1.0, localizer=True)[0]]
    some += [image("twice", n, z)[0] for n, z in enumerate((1.0, 1.0, 2.0))] + [image("bent", n, n * 1.0, iop=bent if n == 2 else AXIAL)[0] for n in range(3)]
    some += [image("nowhere", n, 0.0, ipp=False)[0] for n in (2, 0, 1)] + [image("uneven", n, z)[0] for n, z in enumerate((0.0, 1.0, 3.0))] + [image("uneven", 9, 5.0, shape=(2, 2))[0]]
    return spark.createDataFrame(some, SCHEMA).repartition(3), kept


def test_problems_and_warnings(slices):
    got = {r["vol_id"]: r for r in building.volume_grids(slices[0]).collect()}
    assert {u: r["problem"] for u, r in got.items() if r["problem"]} == {"one": "fewer than 2 slices", "local": "fewer than 2 slices", "twice": "duplicate slice positions", "bent": "slices with different orientations"}
    assert got["nowhere"]["warnings"] == ["no positions, sorted by instance", "gap taken from the slice thickness"]
    assert got["uneven"]["warnings"] == ["1 localizers or images of other sizes ignored", "uneven gaps"]
    assert got["a"]["warnings"] == [] and (got["a"]["nx"], got["a"]["ny"], got["a"]["nz"]) == (4, 3, 3)
    want = [-0.75, 0, 0, -1, 0, -0.5, 0, -2, 0, 0, 3, 3, 0, 0, 0, 1]
    assert got["a"]["affine"] == [float(x) for x in want]


def test_pixels_in_canonical_order(slices):
    frame, kept = slices
    grids = building.volume_grids(frame).where("problem is null")
    plan = geometry.canonical_plan(grids.select("vol_id", "nx", "ny", "nz", "affine"))
    out = geometry.reoriented(building.built(frame, grids), plan).where(F.col("vol_id").isin(*"abcde")).collect()
    assert len(out) == 5 * 36
    for r in out:
        own = kept[r["vol_id"], (3.0, 6.0, 9.0)[r["k"]]]
        assert r["v"] == own[2 - r["j"], 3 - r["i"]]


def test_short_pixels_and_no_slices(spark, slices):
    short = slices[0].withColumn("raw", F.expr("substring(raw, 1, 5)"))
    with pytest.raises(Exception, match="short pixel data"):
        building.pixels(short).collect()
    none = spark.createDataFrame([], SCHEMA)
    assert building.volume_grids(none).count() == 0 and building.built(none, building.volume_grids(none)).count() == 0


def test_zeros_without_a_sign_of_their_own(spark):
    """A normal of turned rows whose zero comes from two products of either sign; the affine's zeros are negated in the first two rows only."""
    rows = [image("turned", n, 0.0, iop=[0.96, 0.28, 0.0, -0.28, 0.96, 0.0], ipp=False)[0] for n in range(2)]
    affine = building.volume_grids(spark.createDataFrame(rows, SCHEMA)).first()["affine"]
    assert [repr(affine[n]) for n in (2, 6, 8, 9)] == ["-0.0", "-0.0", "0.0", "0.0"]


def test_words_of_several_sizes_in_one_batch(spark):
    """a batch's words at once; an unknown slope gives no value, an image without words no rows, 32-bit words keep their sign."""
    rows, kept = [], {}
    for n, (bits, stored, signed) in enumerate(((16, 12, True), (8, 8, False), (32, 32, True), (16, 16, False), (8, 8, True))):
        row, words = image("s", n, 0.0, bits=bits, stored=stored, signed=signed, shape=(2, n + 1))
        rows.append(row)
        kept[f"f{n}"] = values(words, bits, stored, signed).ravel()
    rows += [(*image("s", 8, 0.0)[0][:-2], None, 1.0), image("s", 9, 0.0, shape=(0, 4))[0]]
    got = {}
    for r in building.pixels(spark.createDataFrame(rows, SCHEMA).coalesce(1)).orderBy("file", "j", "i").collect():
        got.setdefault(r["file"], []).append(r["v"])
    assert got.pop("f8") == [None] * 12 and "f9" not in got
    assert {f: v.tolist() for f, v in kept.items()} == got


def test_fixture_words_without_a_list_for_each_image(spark):
    """the fixture's pixel words are made by plain expressions, and are the words that they were."""
    from volspark.sources import fixtures as fx

    images = fx.images(spark, "/root/testdata/sf0.001")
    assert "transform(" not in images._jdf.queryExecution().toString()
    rows = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").toPandas()
    want = {}
    for r in rows.itertuples():
        p = np.concatenate((np.arange(12), np.arange(6 if r.l_tax > 0.07 else 0)))
        words = (r.l_partkey * 7 + r.l_suppkey * 13 + p * p * 911 + r.l_linenumber * 31) % 65536
        want.setdefault((str(r.l_orderkey), f"{r.l_linenumber}_{r.l_partkey}_{r.l_suppkey}"), set()).add(words.astype("<u2").tobytes())
    got = images.select("series_uid", "file", "raw").collect()
    assert len(got) == len(rows) and all(bytes(r["raw"]) in want[r["series_uid"], r["file"]] for r in got)
