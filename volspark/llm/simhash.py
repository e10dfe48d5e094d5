"""SimHash near-duplicate groups by multi-index hashing."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import shared, text_bytes
from volspark.operators.graph import connected_components

#: Cells of the shingle-by-bit table that are unpacked at once.
BLOCK = 1 << 14


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """A bit is 1 if it is set in over half of the shingles' XXH64 (seed 42); 0 for a text without words."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    if n <= 1:
        return digest(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: n - 1])).tolist()
    stops = (ends[shingle - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, n, BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=True)], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n).view(">u8")[0])


def _fingerprints(batches, shingle: int):
    for b in batches:
        *own, text = b.columns
        fp = np.array([fingerprint(t, shingle) for t in text.to_pylist()], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([*own, pa.array(fp, pa.int64())], [*b.schema.names[:-1], "fp"])


def fingerprints(docs: DataFrame, shingle: int = 4, keep: tuple[Column, ...] = ()) -> DataFrame:
    """(doc_id, keep, fp): the 64 bits as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_bytes().alias("__text"))
    return rows.mapInArrow(lambda it: _fingerprints(it, shingle), rows.drop("__text").schema.add("fp", "long"))


def _segments(bits: int, parts: int) -> list[tuple[int, int]]:
    """(lowest bit, width) of each segment."""
    edges = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in itertools.pairwise(edges)]


def _balls(fps: np.ndarray, masks: np.ndarray) -> np.ndarray:
    return (fps[:, None] ^ masks[None, :]).ravel()


def _midpoints(batches, radius: int):
    """(z, fp): every z within `radius` bits of each fingerprint."""
    flips = [sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(64), r)]
    masks = np.array(flips, np.uint64).view(np.int64)
    for b in batches:
        fps = b.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(fps), 64):
            part = fps[at : at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(_balls(part, masks)), pa.array(np.repeat(part, len(masks)))], ["z", "fp"])


def segments_for(n: int, distance: int = 4) -> int:
    """How many segments make the fewest probes and fetched entries for a table of n fingerprints.

    With more segments the balls are smaller but the keys shorter, so that more entries share one: 3 segments of 21 bits
    up to some ten million fingerprints, 2 of 32 bits beyond. The links are the same for any number.
    """

    def cost(parts: int) -> float:
        probes = [sum(math.comb(width, r) for r in range(distance // parts + 1)) for _, width in _segments(64, parts)]
        return sum(p * (4 + n / 2**width) for p, (_, width) in zip(probes, _segments(64, parts), strict=True))

    return min(range(2, 5), key=cost)


def links(fps: DataFrame, distance: int = 4, parts: int | None = None, most_per_key: int = 256) -> DataFrame:
    """(a, b): links that connect exactly the distinct fingerprints (fp) at `distance` bits or fewer.

    Multi-index hashing: two fingerprints that differ in at most `distance` bits differ in at most
    distance // parts of one of the `parts` segments. Each fingerprint enumerates that small ball round
    each of its segments, fetches the table's entries of those keys, and the whole distance is verified in
    the join. Without a number of segments the one is taken that fits the table's size.

    A key that over `most_per_key` fingerprints more share than chance gives a key (near copies of one text) is not
    fetched, as it would pair its group with itself. A pair that only such keys join has
    both ends under such keys. Those fingerprints enumerate all points within distance / 2 bits instead: two
    of them are within `distance` exactly if they share a point, and each hangs on the point's smallest
    fingerprint, so a group of g gives some g links and not g * g.
    """
    if distance % 2:
        raise ValueError("an odd distance has no midpoint")
    n = fps.count()
    parts = parts or segments_for(n, distance)
    radius = distance // parts
    table, probes = [], []

    def ball(s, key, masks):
        return F.transform(F.lit(masks).cast("array<bigint>"), lambda m: F.struct(F.lit(s).alias("s"), key.bitwiseXOR(m).alias("k")))

    for s, (low, width) in enumerate(_segments(64, parts)):
        key = F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))
        table.append(F.struct(F.lit(s).alias("s"), key.alias("k")))
        masks = [sum(1 << i for i in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)]
        probes.append(ball(s, key, masks))
    chance = n // 2 ** min(width for _, width in _segments(64, parts))
    own = fps.select("fp", F.explode(F.array(*table)).alias("x")).select("x.s", "x.k", F.col("fp").alias("y"))
    hot = own.groupBy("s", "k").agg(F.count("*").alias("n")).where(F.col("n") > most_per_key + 8 * chance).select("s", "k")
    hot = shared(hot)
    cold = own.join(hot, ["s", "k"], "left_anti")
    asked = fps.select("fp", F.explode(F.concat(*probes)).alias("x")).select("x.s", "x.k", F.col("fp").alias("x"))
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= distance
    found = asked.alias("p").join(cold.alias("t"), (F.col("p.s") == F.col("t.s")) & (F.col("p.k") == F.col("t.k")) & (F.col("x") != F.col("y")) & near)
    found = found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    dense = own.join(hot, ["s", "k"], "left_semi").select(F.col("y").alias("fp")).distinct()
    points = dense.mapInArrow(lambda it: _midpoints(it, distance // 2), "z long, fp long")
    least = F.min("fp").over(_by("z"))
    stars = points.select(least.alias("a"), F.col("fp").alias("b")).where("a <> b")
    return found.union(stars).distinct()


def _by(*keys):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)


def one_of_each(docs: DataFrame, shingle: int = 4, distance: int = 4, parts: int | None = None, most_per_key: int = 256) -> DataFrame:
    """One row of docs (doc_id, text, any others) of each near-duplicate group: of the smallest id, and of its rows in the
    group that of the smallest hash. Groups are told by their fingerprints, so rows of one id may be in several."""
    marked = shared(fingerprints(docs, shingle, (F.xxhash64(*docs.columns).alias("row"),)))
    distinct = shared(marked.select("fp").distinct())
    roots = connected_components(links(distinct, distance, parts, most_per_key), "a", "b")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))
    # the minimum of each fingerprint first, so that copies of one text are never gathered
    least = marked.groupBy("fp").agg(F.min(F.struct("doc_id", "row")).alias("first"))
    first = least.join(placed, "fp").groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("__id"), F.col("first.row").alias("__first"))
    rows = docs.withColumn("__row", F.xxhash64(*docs.columns))
    kept = rows.join(first, rows["doc_id"].cast("long").eqNullSafe(first["__id"]) & (rows["__row"] == first["__first"]), "left_semi")
    return kept.dropDuplicates(["doc_id", "__row"]).select(*docs.columns)


def near_duplicates(docs: DataFrame, shingle: int = 4, distance: int = 4, parts: int | None = None, most_per_key: int = 256) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text).

    Fingerprints link at `distance` or fewer differing bits; component_id is the smallest doc_id reachable.
    Null and wordless texts have the fingerprint zero and link like any other; rows repeated or with a null
    id stay, a null id never names a component unless all its ids are null.
    """
    return components_of(shared(fingerprints(docs, shingle)), distance, parts, most_per_key)


def components_of(marked: DataFrame, distance: int = 4, parts: int | None = None, most_per_key: int = 256) -> DataFrame:
    """`near_duplicates` of documents whose fingerprints (doc_id, fp) are known; marked is read more than once."""
    distinct = shared(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = connected_components(links(distinct.select("fp"), distance, parts, most_per_key), "a", "b")
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(names, "root").select("fp", "component_id")
    return marked.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
