"""Surfaces of structures, as a relation: cells of eight corners, a vertex in each cell that the surface passes, quads around crossed edges.

Structures are (vol_id, label). A structure's own grid is its box in blocks of about a wanted size, padded with empty cells.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.functions.numeric import f32
from volspark.operators import components, geometry, lines
from volspark.operators.graph import shared
from volspark.operators.labels import PLACE, VOXEL, small
from volspark.operators.planning import mesh_options

KEY = ["vol_id", "label"]
CELL = ["gi", "gj", "gk"]
#: The surface lies where the smoothed mask is a half; steps of the smoothing forth and back; millimetres and widths of organs and trunks.
ISO, STEPS = 0.5, (0.5, -0.53)
SETTINGS = {"organ": (1.0, 1.5, 20), "trunk": (0.0, 1.0, 20), "tree": (0.0, 0.0, 30)}
#: Corners 0 to 7 of a cell, x in the lowest bit; its edges along x, then y, then z.
EDGES = [(c, c | bit) for bit in (1, 2, 4) for c in range(8) if not c & bit]
#: Cells of a brick's side, and turns of smoothing between which bricks are dealt anew.
BRICK, TURNS = 64, 20


def options(named: DataFrame) -> DataFrame:
    """(label, name, target_mm, sigma_mm, taubin, least_ml) of structures (label, name), by what their names say."""
    own = named.select("label", "name").join(mesh_options(named.select("name").distinct()).select("name", "kind", F.col("min_piece_ml").alias("least_ml")), "name")
    pick = lambda n: F.coalesce(*[F.when(F.col("kind") == k, F.lit(v[n])) for k, v in SETTINGS.items()])
    return own.select("label", "name", pick(0).alias("target_mm"), pick(1).alias("sigma_mm"), pick(2).alias("taubin"), "least_ml")


def whole_pieces(lab: DataFrame, grids: DataFrame, opts: DataFrame) -> DataFrame:
    """lab without pieces, joined over faces, edges and corners, of fewer millilitres than their structure's least_ml."""
    wanted = lab.where("label > 0").join(small(opts.select("label", "least_ml")), "label")
    keep, check = wanted.where("least_ml = 0").select(*PLACE, "label"), wanted.where("least_ml > 0").select(*PLACE, "label")
    pieces = shared(components.components(check, components.BOUND, corners=True))
    size = geometry.zooms(F.col("affine"))
    voxel = grids.select("vol_id", (size[0] * size[1] * size[2]).alias("mm3"))
    large = components.sizes(pieces).join(voxel, "vol_id").join(small(opts.select("label", "least_ml")), "label").where(F.col("n") >= F.ceil(F.col("least_ml") * 1000.0 / F.col("mm3")))
    return keep.unionByName(pieces.join(large.select(*KEY, "piece"), [*KEY, "piece"], "left_semi").select(*PLACE, "label"))


def frames(lab: DataFrame, grids: DataFrame, opts: DataFrame) -> DataFrame:
    """A row for each structure: its box, blocks (f0..2), blur (b0..2, in blocks), padding (p0..2), grid (g0..2), affine and taubin."""
    box = lab.groupBy(*KEY).agg(*[f(c).alias(f"{n}_{c}") for c in VOXEL for n, f in (("lo", F.min), ("hi", F.max))])
    out = box.join(grids.select("vol_id", "affine"), "vol_id").join(small(opts.select("label", "target_mm", "sigma_mm", "taubin")), "label")
    for n, (c, size) in enumerate(zip(VOXEL, geometry.zooms(F.col("affine")), strict=True)):
        out = out.withColumn(f"f{n}", F.greatest(F.lit(1), F.floor(F.col("target_mm") / size + 0.5).cast("int")))
        out = out.withColumn(f"b{n}", F.col("sigma_mm") / (size * F.col(f"f{n}"))).withColumn(f"p{n}", F.ceil(3 * F.col(f"b{n}")).cast("int") + 2)
        out = out.withColumn(f"g{n}", F.ceil((F.col(f"hi_{c}") - F.col(f"lo_{c}") + 1) / F.col(f"f{n}")).cast("int") + 2 * F.col(f"p{n}"))
    return shared(out.drop("target_mm", "sigma_mm"))


def blocks(lab: DataFrame, own: DataFrame) -> DataFrame:
    """(vol_id, label, gi, gj, gk, b0..2, g0..2, v): the share of each block that a structure fills, in single precision; empty ones are left
    out. A structure's frame meets its voxels by the planes of the first axis, so a large one is not one key."""
    planes = own.withColumn("i", F.explode(F.sequence("lo_i", "hi_i")))
    met = lab.select(*PLACE, "label").join(small(planes), [*KEY, "i"])
    cells = [(F.floor((F.col(c) - F.col(f"lo_{c}")) / F.col(f"f{n}")).cast("int") + F.col(f"p{n}")).alias(g) for n, (c, g) in enumerate(zip(VOXEL, CELL, strict=True))]
    rest = [f"{x}{n}" for x in "bg" for n in range(3)]
    share = f32(F.count("*") * f32(1.0 / F.first(F.col("f0") * F.col("f1") * F.col("f2"))))
    return met.select(*KEY, *cells, *rest, "f0", "f1", "f2").groupBy(*KEY, *CELL, *rest).agg(share.alias("v"))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _bell_line(places: pd.Series, values: pd.Series, weights: pd.Series, n: pd.Series) -> pd.Series:
    """Lines of n cells after their weights; products and sums in single precision, from the least place on."""
    out: list = [None] * len(n)
    kinds: dict = {}
    for r, kind in enumerate(zip(n, (w.tobytes() for w in weights), strict=True)):
        kinds.setdefault(kind, []).append(r)
    for (size, _), every in kinds.items():
        w = np.asarray(weights.iloc[every[0]], np.float32)
        reach = len(w) // 2
        for some in (every[x : x + 1024] for x in range(0, len(every), 1024)):
            dense, total = np.zeros((len(some), size + 2 * reach), np.float32), np.zeros((len(some), size), np.float32)
            count = [len(places.iloc[r]) for r in some]
            dense[np.repeat(np.arange(len(some)), count), np.concatenate([places.iloc[r] for r in some]) + reach] = np.concatenate([values.iloc[r] for r in some])
            for t, x in enumerate(w):
                total += x * dense[:, t : t + size]
            for r, line in zip(some, total.astype(float), strict=True):
                out[r] = line
    return pd.Series(out)


def blurred(cells: DataFrame) -> DataFrame:
    """Blocks smoothed along the three axes one after the other, each structure by its own widths; zero outside, and a width under 0.3 changes
    nothing. Lines of one axis are gathered, never more than one line a group. Values are added in single precision and in the order of
    their places; cells that are 0 are left out."""
    rest = [f"{x}{n}" for x in "bg" for n in range(3)]
    for n, g in enumerate(CELL):
        if cells.where(F.col(f"b{n}") >= 0.3).isEmpty():
            continue
        width = F.col(f"b{n}")
        reach = F.greatest(F.lit(1), F.ceil(3 * width).cast("int"))
        taps = F.when(width < 0.3, F.array(F.lit(1.0).cast("float"))).otherwise(F.transform(_bell(F.sequence(-reach, reach), width), lambda x: x["w"]))
        others = [c for c in CELL if c != g]
        gathered = cells.groupBy(*KEY, *others, *rest).agg(F.collect_list(F.struct(F.col(g).alias("p"), "v")).alias("c")).withColumn("w", taps)
        cells = gathered.select(*KEY, *others, *rest, F.posexplode(_bell_line(F.col("c.p"), F.col("c.v"), F.col("w"), F.col(f"g{n}"))).alias(g, "v")).where("v <> 0")
    return cells


def _bell(places: Column, width: Column) -> Column:
    """[(t, w)]: single-precision weights of a Gaussian that add up to 1."""
    bell = F.transform(places, lambda t: F.exp(-0.5 * t * t / (width * width)).cast("float").cast("double"))
    total = F.aggregate(bell, F.lit(0.0), lambda s, x: s + x)
    return F.transform(places, lambda t: F.struct(t.alias("t"), (F.exp(-0.5 * t * t / (width * width)).cast("float").cast("double") / total).cast("float").alias("w")))


def crossed_cells(cells: DataFrame) -> DataFrame:
    """(vol_id, label, gi, gj, gk, v0..v7) of the cells with corners inside and outside. Each line of blocks along the last axis is sent to the
    four lines of cells that it is an edge of; a missing corner is 0."""
    rest = [f"{x}{n}" for x in "bg" for n in range(3)]
    gathered = cells.groupBy(*KEY, "gi", "gj", *rest).agg(F.collect_list(F.struct("gk", F.col("v").cast("float").alias("v"))).alias("c"))
    edges = F.array(*[F.struct(F.lit(c).alias("c"), F.lit(c & 1).alias("x"), F.lit(c >> 1).alias("y")) for c in range(4)])
    sent = gathered.withColumn("o", F.explode(edges)).withColumns({g: F.col(g) - F.col(f"o.{x}") for g, x in (("gi", "x"), ("gj", "y"))})
    sent = sent.where(F.col("gi").between(0, F.col("g0") - 2) & F.col("gj").between(0, F.col("g1") - 2))
    met = sent.groupBy(*KEY, "gi", "gj", "g2").agg(F.collect_list(F.struct(F.col("o.c").alias("c"), F.col("c.gk").alias("p"), F.col("c.v").alias("v"))).alias("e"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in met.schema if f.name in KEY]
    return met.mapInArrow(_crossings, ", ".join([*kinds, *[f"{g} int" for g in CELL], *[f"v{c} double" for c in range(8)]]))


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The crossed cells of lines of cells, from the blocks on the four edges (e) of each; g2: blocks of a whole line."""
    for batch in batches:
        for some, sizes in lines.chunks(batch, batch["g2"].to_numpy().astype(np.int64)):
            ends = np.cumsum(sizes)
            (corner,), at, values = lines.spread(some["e"], ends - sizes)
            dense = np.zeros((4, ends[-1]))
            dense[corner, at] = values
            inside = (dense > ISO).sum(axis=0)
            inside = inside[:-1] + inside[1:]
            inside[ends[:-1] - 1] = 0  # from one line to the next
            hit = np.flatnonzero((inside > 0) & (inside < 8))
            row = np.searchsorted(ends, hit, "right")
            own = some.select([*KEY, "gi", "gj"]).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array((hit - (ends - sizes)[row]).astype(np.int32)), *dense[:, hit], *dense[:, hit + 1]], [*own.schema.names, "gk", *[f"v{c}" for c in range(8)]])


def _vid(i: Column, j: Column, k: Column) -> Column:
    """A cell's number in its structure's grid, of at most 2 ** 14 cells along an axis."""
    return (i.cast("long") * (1 << 14) + j) * (1 << 14) + k


def net(crossed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of crossed cells, in cells: (vol_id, label, vid, x, y, z), the mean of a cell's crossed edges' crossings, and
    (vol_id, label, tid, a, b, c). The four cells around a crossed edge are known by their places, so triangles need no join."""
    inside = [F.col(f"v{c}") > ISO for c in range(8)]
    sums, count = [F.lit(0.0)] * 3, F.lit(0)
    for a, b in EDGES:
        cut = inside[a] != inside[b]
        t = f32(ISO - F.col(f"v{a}")) / f32(F.col(f"v{b}") - F.col(f"v{a}"))
        sums = [s + F.when(cut, (a >> d & 1) + t * float((b >> d & 1) - (a >> d & 1))).otherwise(0.0) for d, s in enumerate(sums)]
        count = count + cut.cast("int")
    i, j, k = map(F.col, CELL)
    points = [f32(g + s / count).alias(c) for g, s, c in zip((i, j, k), sums, "xyz", strict=True)]
    vertices = crossed.select(*KEY, _vid(i, j, k).alias("vid"), *points)
    around = [
        [_vid(i, j - 1, k - 1), _vid(i, j, k - 1), _vid(i, j, k), _vid(i, j - 1, k)],
        [_vid(i - 1, j, k - 1), _vid(i - 1, j, k), _vid(i, j, k), _vid(i, j, k - 1)],
        [_vid(i - 1, j - 1, k), _vid(i, j - 1, k), _vid(i, j, k), _vid(i - 1, j, k)],
    ]
    quads = []
    for axis, (p, q, r, s) in enumerate(around):
        tri = lambda n, a, b, c, axis=axis: F.struct((_vid(i, j, k) * 6 + 2 * axis + n).alias("tid"), a.alias("a"), b.alias("b"), c.alias("c"))
        out, into = F.array(tri(0, p, q, r), tri(1, p, r, s)), F.array(tri(0, p, r, q), tri(1, p, s, r))
        quads.append(F.when(inside[0] != inside[1 << axis], F.when(inside[0], out).otherwise(into)))
    triangles = crossed.select(*KEY, F.explode(F.flatten(F.array_compact(F.array(*quads)))).alias("t")).select(*KEY, "t.tid", "t.a", "t.b", "t.c")
    return vertices, triangles


def _relaxed(first: int, turns: int):
    """Turns `first` and on of a brick's vertices and those around it; only the brick's own ones are given back."""

    def relaxed(some: pd.DataFrame) -> pd.DataFrame:
        if not some["own"].any():  # a brick beside the structure
            return some[[*KEY, "vid", "x", "y", "z", "near", "taubin"]].head(0)
        some = some.sort_values("vid", ignore_index=True)
        vid, xyz = some["vid"].to_numpy(), some[["x", "y", "z"]].to_numpy(np.float32)
        ends, sizes = np.concatenate(some["near"].to_list()).astype(np.int64), some["near"].map(len).to_numpy()
        at = np.minimum(np.searchsorted(vid, ends), len(vid) - 1)
        pairs = np.unique(np.stack((np.repeat(np.arange(len(some)), sizes), at), 1)[vid[at] == ends], axis=0)  # in the order of their numbers
        count = np.bincount(pairs[:, 0], minlength=len(some))
        places = np.full((len(some), max(count.max(), 1)), len(some))
        places[pairs[:, 0], np.arange(len(pairs)) - np.repeat(np.cumsum(count) - count, count)] = pairs[:, 1]
        live, limit = count > 0, 2 * some["taubin"].to_numpy()
        for turn in range(first, first + turns):
            padded, total = np.vstack((xyz, np.zeros((1, 3), np.float32))), np.zeros_like(xyz)
            for column in places.T:
                total += padded[column]
            on = live & (turn < limit)
            mean = total[on] / count[on, None].astype(np.float32)
            xyz[on] += np.float32(STEPS[turn % 2]) * (mean - xyz[on])
        out = some[some["own"]].copy()
        out[["x", "y", "z"]] = xyz[some["own"].to_numpy()].astype(float)
        return out[[*KEY, "vid", "x", "y", "z", "near", "taubin"]]

    return relaxed


def smoothed(vertices: DataFrame, triangles: DataFrame, rounds: DataFrame) -> DataFrame:
    """vertices after the iterations (vol_id, label, taubin) of their structures: half a step to the mean of the neighbours, then a little more
    back, so that the volume stays.

    A neighbour is at most one cell away along an axis. So a brick of BRICK cells with TURNS cells around it can go TURNS turns
    for itself, and what is wrong at its rim does not reach it; then bricks are dealt anew. A group holds the surface
    in one brick, however large the structure is.
    """
    most = 2 * (rounds.agg(F.max("taubin")).first()[0] or 0)
    ends = F.array(*[F.struct(F.col(p).alias("vid"), F.col(q).alias("to")) for a, b in ("ab", "bc", "ca") for p, q in ((a, b), (b, a))])
    near = triangles.select(*KEY, F.inline(ends)).groupBy(*KEY, "vid").agg(F.collect_set("to").alias("near"))
    state = vertices.join(near, [*KEY, "vid"], "left").join(small(rounds.select(*KEY, "taubin")), KEY)
    state = shared(state.select(*KEY, "vid", "x", "y", "z", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"), "taubin"))
    kind = state.schema
    bricks = ["bi", "bj", "bk"]
    for first in range(0, most, TURNS):
        turns = min(TURNS, most - first)
        cells = [F.shiftright("vid", 14 * (2 - n)).bitwiseAND(F.lit((1 << 14) - 1).cast("long")) for n in range(3)]
        own, dealt = F.lit(True), state
        for c, b in zip(cells, bricks, strict=True):
            dealt = dealt.withColumn(b, F.explode(F.sequence(F.greatest(F.floor((c - TURNS) / BRICK), F.lit(0)), F.floor((c + TURNS) / BRICK))))
            own = own & (F.col(b) == F.floor(c / BRICK))
        done = dealt.withColumn("own", own).groupBy(*KEY, *bricks).applyInPandas(_relaxed(first, turns), kind)
        state = shared(done)
    return state.select(*KEY, "vid", "x", "y", "z")


def to_world(vertices: DataFrame, own: DataFrame) -> DataFrame:
    """Vertices of structures' grids in millimetres, in single precision."""
    met = vertices.join(small(own), KEY)
    at = [F.col(f"lo_{c}") + (F.col(x) - F.col(f"p{n}")) * F.col(f"f{n}") + (F.col(f"f{n}") - 1) * 0.5 for n, (c, x) in enumerate(zip(VOXEL, "xyz", strict=True))]
    a = F.col("affine")
    out = [f32(a[4 * r] * at[0] + a[4 * r + 1] * at[1] + a[4 * r + 2] * at[2] + a[4 * r + 3]).alias(c) for r, c in enumerate("xyz")]
    return met.select(*KEY, "vid", *out)


def mesh_id() -> Column:
    """A number for a structure of a volume, for the operators on meshes."""
    return (F.col("vol_id").cast("long") * 256 + F.col("label")).alias("mesh_id")


def surfaces(lab: DataFrame, grids: DataFrame, opts: DataFrame, largest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(vertices, triangles) of the structures of opts (label, target_mm, sigma_mm, taubin, least_ml) in label maps: (mesh_id, vid, x, y, z) in
    millimetres and (mesh_id, tid, a, b, c). Structures without a voxel have no rows. largest: only each structure's largest piece."""
    lab = lab.select(*PLACE, "label").join(small(opts.select("label")), "label", "left_semi").select(*PLACE, "label")
    if largest:
        lab = components.largest(lab, components.BOUND)
    lab = shared(whole_pieces(lab, grids, opts))
    own = frames(lab, grids, opts)
    crossed = shared(crossed_cells(blurred(blocks(lab, own))))
    vertices, triangles = net(crossed)
    vertices = to_world(smoothed(vertices, triangles, own), own)
    return vertices.select(mesh_id(), "vid", "x", "y", "z"), triangles.select(mesh_id(), "tid", "a", "b", "c")
