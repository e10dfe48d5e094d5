"""Surfaces as tables: vertices (mesh_id, vid, x, y, z) and triangles (mesh_id, tid, a, b, c)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def corners(tri: DataFrame, ver: DataFrame) -> DataFrame:
    """Triangles with the points ax..cz of their three vertices."""
    out = tri
    for p in "abc":
        own = ver.select("mesh_id", F.col("vid").alias(p), *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
        out = out.join(own, ["mesh_id", p])
    return out


def _cross(u, v) -> list[Column]:
    return [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]


def _facet() -> list[Column]:
    edge = lambda p: [F.col(f"{p}{c}") - F.col(f"a{c}") for c in "xyz"]
    return _cross(edge("b"), edge("c"))


def volumes(tri: DataFrame, ver: DataFrame) -> DataFrame:
    """(mesh_id, ml): signed tetrahedra from the origin."""
    n = _cross([F.col(f"b{c}") for c in "xyz"], [F.col(f"c{c}") for c in "xyz"])
    six = F.col("ax") * n[0] + F.col("ay") * n[1] + F.col("az") * n[2]
    return corners(tri, ver).groupBy("mesh_id").agg((F.sum(six) / 6.0 / 1000.0).alias("ml"))


def normals(tri: DataFrame, ver: DataFrame) -> DataFrame:
    """(mesh_id, vid, nx, ny, nz): the sum of a vertex's facet normals at length 1; zeros where it is zero or there is none."""
    n = corners(tri, ver).select("mesh_id", F.explode(F.array("a", "b", "c")).alias("vid"), *[c.alias(x) for c, x in zip(_facet(), "uvw", strict=True)])
    s = ver.select("mesh_id", "vid").join(n.groupBy("mesh_id", "vid").agg(*[F.sum(x).alias(x) for x in "uvw"]), ["mesh_id", "vid"], "left")
    size = F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v") + F.col("w") * F.col("w"))
    return s.select("mesh_id", "vid", *[F.coalesce(F.when(size > 0, F.col(x) / size), F.lit(0.0)).alias(f"n{c}") for x, c in zip("uvw", "xyz", strict=True)])


def edges(tri: DataFrame) -> DataFrame:
    """(mesh_id, u, v) of the distinct edges, u < v."""
    pairs = F.array(*[F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    return tri.select("mesh_id", F.explode(pairs).alias("e")).select("mesh_id", "e.u", "e.v").where("u < v").distinct()


def joined(tri: DataFrame, ver: DataFrame) -> DataFrame:
    """(a, b, c, mesh_id): the triangles of all meshes over one list of vertices, mesh after mesh.

    The offsets are a running sum over one row a mesh."""
    base = ver.groupBy("mesh_id").agg(F.count("*").alias("n"), F.min("vid").alias("low"))
    base = base.select("mesh_id", "low", (F.sum("n").over(Window.orderBy("mesh_id")) - F.col("n")).alias("base"))
    out = tri.join(base, "mesh_id")
    return out.select("mesh_id", *[(F.col(p) - F.col("low") + F.col("base")).alias(p) for p in "abc"])


def obj_lines(tri: DataFrame, ver: DataFrame) -> DataFrame:
    """(mesh_id, part, at, line): text of an OBJ file, in the order of (mesh_id, part, at); vertices count from 1."""
    v = ver.select("mesh_id", F.lit(1).alias("part"), F.col("vid").cast("long").alias("at"), F.format_string("v %.4f %.4f %.4f", "x", "y", "z").alias("line"))
    f = tri.select("mesh_id", F.lit(2).alias("part"), F.col("tid").cast("long").alias("at"), F.format_string("f %d %d %d", *[(F.col(p) + 1) for p in "abc"]).alias("line"))
    o = ver.select("mesh_id").distinct().select("mesh_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("at"), F.format_string("o mesh_%d", "mesh_id").alias("line"))
    return o.union(v).union(f)


def picked(tri: DataFrame, ver: DataFrame, start, direction) -> DataFrame:
    """(mesh_id, tid, t): the nearest triangle of each mesh that a ray from `start` meets, of equal ones the first."""
    d = [F.lit(float(x)) for x in direction]
    u, v = ([F.col(f"{p}{c}") - F.col(f"a{c}") for c in "xyz"] for p in "bc")
    dot = lambda p, q: p[0] * q[0] + p[1] * q[1] + p[2] * q[2]
    h = _cross(d, v)
    s = [F.lit(float(x)) - F.col(f"a{c}") for x, c in zip(start, "xyz", strict=True)]
    q = _cross(s, u)
    hit = corners(tri, ver).withColumn("det", dot(u, h)).where(F.abs("det") > 1e-12)
    hit = hit.withColumns({"p": dot(s, h) / F.col("det"), "q": dot(d, q) / F.col("det"), "t": dot(v, q) / F.col("det")})
    near = hit.where("p >= 0 and q >= 0 and p + q <= 1 and t > 0").groupBy("mesh_id").agg(F.min(F.struct("t", "tid")).alias("m"))
    return near.select("mesh_id", "m.tid", "m.t")


def stl(tri: DataFrame, ver: DataFrame) -> DataFrame:
    """(mesh_id, tid, normal, points): rows of an STL file, facet normals at length 1, points as nine numbers."""
    n = _facet()
    size = F.sqrt(n[0] * n[0] + n[1] * n[1] + n[2] * n[2])
    unit = F.array(*[F.coalesce(F.when(size > 0, c / size), F.lit(0.0)) for c in n])
    return corners(tri, ver).select("mesh_id", "tid", unit.alias("normal"), F.array(*[F.col(f"{p}{c}") for p in "abc" for c in "xyz"]).alias("points"))
