"""Exact removal of long repeated byte strings.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Whole corpora do not fit
one suffix array, so equal strings are first brought together by a mark that depends on the string alone:

1. Each window of `length` bytes picks its smallest GRAM-byte hash (the leftmost of equal ones). Runs of
   neighbouring windows pick the same gram; such a run is a snippet, under half of `length` bytes longer than
   `length`. Equal windows pick equal grams, so a window's copies are in snippets of the same gram hash.
2. Snippets are counted by (gram hash, content hash). A content seen twice repeats in all of its windows;
   a gram hash with one content seen once repeats nowhere. Only the different contents that share a gram
   hash are left open.
3. Open contents meet by gram hash in blocks of bounded size. A Burrows-Wheeler transform of each block gives,
   by breadth-first backward extension, the common prefixes of neighbouring suffixes by increasing value;
   the search stops at `length`, and what has no value by then is a repeat.
4. A gram hash with more open contents than a block holds is split: windows with the gram in their left half
   and in their right half part, keyed by what all windows of that half contain, halving until the contents
   are few or each is one window.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.llm.common import HEAVY, binary_buffers, join_skewed, shared, text_bytes

GRAM = 128
CHUNK = 1 << 21
#: Most bytes of open contents in one transform.
BLOCK = 1 << 20
#: Most open contents of one gram hash that may meet in one block.
MOST = 512

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position, for all that have so many; GRAM is a power of two."""
    h = (data.astype(np.uint64) + np.uint64(1)) * _M1
    h ^= h >> np.uint64(29)
    width, step = 1, 0x2545F4914F6CDD1D
    while width < GRAM:
        if len(h) <= width:
            return h[:0]
        h = h[:-width] * np.uint64(step) + h[width:]
        h ^= h >> np.uint64(31)
        step = step * 0x9E3779B97F4A7C15 % (1 << 64)
        width *= 2
    h *= _M2
    h ^= h >> np.uint64(30)
    return h


def _slide_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum over v[i : i + width]."""
    out, have = v, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return np.minimum(out[: len(out) - (width - have)], out[width - have :]) if width > have else out


def snippets(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gram hash, gram position, first window, last window) of each run of windows with the same gram."""
    empty = np.zeros(0, np.int64)
    if len(data) < length:
        return np.zeros(0, np.uint64), empty, empty, empty
    h = gram_hashes(data)
    place = np.uint64(len(h).bit_length())
    packed = ((h >> place) << place) | np.arange(len(h), dtype=np.uint64)
    at = (_slide_min(packed, length - GRAM + 1) & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
    last = np.concatenate((first[1:] - 1, [len(at) - 1]))
    return h[at[first]], at[first], first, last


def _windows(doc: np.ndarray, length: int):
    """Snippets of one text by pieces of CHUNK windows: (gram hash, gram position, first byte, bytes)."""
    for base in range(0, max(1, len(doc) - length + 1), CHUNK):
        h, at, first, last = snippets(doc[base : base + CHUNK + length - 1], length)
        yield h.view(np.int64), at + base, first + base, last - first + length


def _marks(batches, length: int):
    """Rows (doc, copy, g, c, gram, start, size) of each snippet; c is the content's hash."""
    for b in batches:
        data, offsets = binary_buffers(b.column(2))
        keys = b.columns[:2]
        for r in range(b.num_rows):
            if offsets[r + 1] - offsets[r] < length:
                continue
            doc = data[offsets[r] : offsets[r + 1]]
            raw = memoryview(doc)
            for h, gram, start, size in _windows(doc, length):
                c = np.fromiter((xxhash.xxh3_64_intdigest(raw[s : s + n]) for s, n in zip(start.tolist(), size.tolist(), strict=True)), np.uint64, len(h))
                own = [pa.array(np.full(len(h), k[r].as_py(), np.int64)) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(h), pa.array(c.view(np.int64)), pa.array(gram), pa.array(start), pa.array(size)], ["doc", "copy", "g", "c", "gram", "start", "size"])


def order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first `depth` symbols or more, by doubling."""
    rank = symbols.astype(np.int64)
    width, n = 1, len(rank)
    while True:
        shifted = np.zeros(n, np.int64)
        shifted[: n - width] = rank[width:] + 1
        key = rank * (int(rank.max()) + 2) + shifted
        sa = np.argsort(key)
        new = np.empty(n, np.int64)
        new[sa] = np.cumsum(np.concatenate(([0], key[sa][1:] != key[sa][:-1])))
        rank, width = new, width * 2
        if width >= depth or rank[sa[-1]] == n - 1:
            return sa


class _Ranks:
    """Wavelet matrix of a transform: the intervals of all one-symbol extensions of many intervals at once."""

    def __init__(self, bwt: np.ndarray):
        self.bits = max(1, int(bwt.max()).bit_length())
        self.zeros, self.counts = [], []
        v = bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (v >> level) & 1
            self.counts.append(np.concatenate(([0], np.cumsum(bit))).astype(np.int32))
            self.zeros.append(int(len(v) - bit.sum()))
            v = np.concatenate((v[bit == 0], v[bit == 1]))
        self.smaller = np.concatenate(([0], np.cumsum(np.bincount(bwt, minlength=1 << self.bits))))

    def extend(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-open intervals of cw for each interval of w and each symbol c before it; symbol 0 leads nowhere."""
        base, symbol = np.zeros(len(lo), np.int64), np.zeros(len(lo), np.int64)
        for counts, zeros in zip(self.counts, self.zeros, strict=True):
            l1, h1 = counts[lo].astype(np.int64), counts[hi].astype(np.int64)
            l0, h0 = lo - l1, hi - h1
            z, o = h0 > l0, h1 > l1
            lo = np.concatenate((l0[z], l1[o] + zeros))
            hi = np.concatenate((h0[z], h1[o] + zeros))
            symbol = np.concatenate((symbol[z] * 2, symbol[o] * 2 + 1))
        # at the lowest level each symbol's occurrences lie together, from its first place on
        first = self._first()
        base = self.smaller[symbol]
        keep = symbol > 0
        return (base + lo - first[symbol])[keep], (base + hi - first[symbol])[keep]

    def _first(self) -> np.ndarray:
        if not hasattr(self, "first"):
            sizes = np.diff(self.smaller)
            names = np.arange(len(sizes))
            back = np.zeros(len(sizes), np.int64)
            for i in range(self.bits):
                back |= ((names >> i) & 1) << (self.bits - 1 - i)
            seen = np.argsort(back, kind="stable")
            self.first = np.empty(len(sizes), np.int64)
            self.first[seen] = np.concatenate(([0], np.cumsum(sizes[seen])[:-1]))
        return self.first


def repeats(contents: list[bytes], length: int) -> list[np.ndarray]:
    """For each content, which of its windows of `length` bytes also start elsewhere in the contents.

    Interval expansion: level l holds the intervals of strings of l symbols. Each is extended backwards by
    every symbol before it; the end of an extension that no shorter string ended marks a neighbour pair with
    a common prefix of l symbols, and only such extensions go on. After `length` levels the unmarked pairs
    have at least `length` symbols in common.
    """
    ends = np.cumsum([len(c) + 1 for c in contents])
    symbols = np.zeros(int(ends[-1]), np.int64)
    for c, e in zip(contents, ends.tolist(), strict=True):
        symbols[e - 1 - len(c) : e - 1] = np.frombuffer(c, np.uint8).astype(np.int64) + 1
    n = len(symbols)
    ranked = symbols + len(contents)  # the ends sort first, each as a symbol of its own
    ranked[ends - 1] = np.arange(len(contents))
    sa = order(ranked, length)
    bwt = symbols[sa - 1]
    ranks = _Ranks(bwt)
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    known[: len(contents) + 1] = True  # an end has nothing in common with its neighbours
    lo, hi = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for level in range(length):
        lo, hi = ranks.extend(lo, hi)
        fresh = ~known[hi]
        lo, hi = lo[fresh], hi[fresh]
        if level == 0:  # each end is a string of one symbol, too
            lo, hi = np.concatenate((lo, np.arange(len(contents)))), np.concatenate((hi, np.arange(len(contents)) + 1))
        if not len(lo):
            break
        known[hi] = True
    same = ~known
    twin = np.zeros(n, bool)
    twin[sa] = same[:-1] | same[1:]
    return [twin[e - 1 - len(c) : e - length] for c, e in zip(contents, ends.tolist(), strict=True)]


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _blocks(batches, length: int):
    """Open contents (g, c, low, text) in the order of g to rows (g, c, first, last) of repeated windows.

    A block ends where a gram hash ends, and holds BLOCK bytes or one gram hash's contents.
    """

    def solve(rows):
        if len({r[0] for r in rows}) == len(rows):
            return
        found = [(g, c, a + low, z + low - 1) for (g, c, low, _), flags in zip(rows, repeats([r[3] for r in rows], length), strict=True) for a, z in zip(*map(np.ndarray.tolist, _runs(flags)), strict=True)]
        if found:
            g, c, a, z = zip(*found, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(a, pa.int64()), pa.array(z, pa.int64())], ["g", "c", "first", "last"])

    rows, size = [], 0
    for b in batches:
        for key, g, c, low, text in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            if size >= BLOCK and rows[-1][4] != key:
                yield from solve([r[:4] for r in rows])
                rows, size = [], 0
            rows.append((g, c, low, text, key))
            size += len(text)
    if rows:
        yield from solve([r[:4] for r in rows])


def _cut(batches):
    """Texts of open contents: (key, g, c, gram, text) from whole documents and lists of (g, c, gram, start, size)."""
    for b in batches:
        texts, spans = b.column(0), b.column(1)
        out = []
        for text, own in zip(texts, spans, strict=True):
            text = text.as_py()
            out += [(s["g"], s["c"], s["gram"] - s["start"], text[s["start"] : s["start"] + s["size"]]) for s in own.as_py()]
        if out:
            g, c, gram, t = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(c, pa.int64()), pa.array(gram, pa.int64()), pa.array(t, pa.binary())], ["g", "c", "gram", "text"])


def _remove(batches):
    """The columns before the last two, then kept bytes, n_bytes, n_removed, n_spans from (text, spans to remove)."""
    for b in batches:
        kept, counts = [], []
        for text, spans in zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1), strict=True):
            text = text.as_py()
            cover = []
            for start, end in sorted((s["start"], s["end"]) for s in (spans.as_py() or [])):
                if cover and start <= cover[-1][1]:
                    cover[-1][1] = max(end, cover[-1][1])
                else:
                    cover.append([start, end])
            parts, at = [], 0
            for start, end in cover:
                parts.append(text[at:start])
                at = end
            parts.append(text[at:])
            kept.append(b"".join(parts))
            counts.append((len(text), len(text) - len(kept[-1]), len(cover)))
        n = np.array(counts, np.int64).reshape(-1, 3)
        own = [b.column(i) for i in range(b.num_columns - 2)]
        yield pa.RecordBatch.from_arrays([*own, pa.array(kept, pa.binary()), *(pa.array(n[:, i]) for i in range(3))], [*b.schema.names[:-2], "kept", "n_bytes", "n_removed", "n_spans"])


def _split_hot(hot: DataFrame, length: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(blocks to solve, solved rows) of gram hashes with more than MOST open contents.

    A node is a range lo..hi of distances from a window's start to its gram, first of all distances, then
    halved. A piece stands for those windows of a content that are in the node, at distances a..b. All windows
    of a node contain the bytes from lo before the gram to length - hi after it, so pieces meet by that common
    part; a piece's hull reaches from b before to length - a after. Equal hulls repeat in all windows; a common
    part with one hull needs nothing more; one with few hulls goes to a block; the others are halved, down to
    single distances, where the common part is the window.
    """
    cut = lambda before, after: F.substring(F.col("text"), (F.col("gram") - before + 1).cast("int"), (before + after).cast("int"))
    full = F.lit(length).cast("long")
    pieces = hot.select(
        "g", "c", "gram", "text", F.lit(0).cast("long").alias("lo"), F.lit(length - GRAM).cast("long").alias("hi"),
        (F.col("gram") - F.octet_length("text") + full).alias("a"), F.col("gram").alias("b"),
    )
    todo, solved = [], []
    while True:
        pieces = pieces.withColumn("key", F.xxhash64("g", "lo", "hi", cut(F.col("lo"), full - F.col("hi"))))
        pieces = shared(pieces.withColumn("hull", F.xxhash64("key", "a", "b", cut(F.col("b"), full - F.col("a")))))
        hulls = pieces.groupBy("key", "hull").agg(F.count("*").alias("n"))
        keys = hulls.groupBy("key").agg(F.count("*").alias("hulls"))
        state = shared(pieces.join(hulls, ["key", "hull"]).join(keys, "key").where("n > 1 or hulls > 1"))
        first = (F.col("gram") - F.col("b")).alias("first")
        solved.append(state.where("n > 1").select("g", "c", first, (F.col("gram") - F.col("a")).alias("last")))
        one = state.where((F.col("hulls") > 1) & (F.col("hulls") <= MOST)).dropDuplicates(["key", "hull"])
        todo.append(one.select("key", "g", "c", first.alias("low"), cut(F.col("b"), full - F.col("a")).alias("text")))
        left = state.where(F.col("hulls") > MOST)
        if left.isEmpty():
            return todo, solved
        mid = F.floor((F.col("lo") + F.col("hi")) / 2)
        half = lambda lo, hi: F.struct(lo.alias("lo"), hi.alias("hi"), F.greatest("a", lo).alias("a"), F.least("b", hi).alias("b"))
        left = left.withColumn("half", F.explode(F.array(half(F.col("lo"), mid), half(mid + 1, F.col("hi")))))
        pieces = left.where("half.a <= half.b").select("g", "c", "gram", "text", "half.lo", "half.hi", "half.a", "half.b")


def repeated_windows(docs: DataFrame, length: int) -> DataFrame:
    """(doc, copy, start, end): byte spans of docs (doc, copy, text) that repeat, several of them overlapping.

    A content in very many documents is no hot key: the few contents that hold over 1 of HEAVY snippets are broadcast, and
    as each is there more than once, their snippets are repeats as they stand.
    """
    marks = shared(docs.mapInArrow(lambda it: _marks(it, length), "doc long, copy long, g long, c long, gram long, start long, size long"))
    contents = marks.groupBy("g", "c").agg(F.count("*").alias("n"), F.min(F.struct("doc", "copy", "gram", "start", "size")).alias("at"))
    grams = contents.groupBy("g").agg(F.count("*").alias("contents"))
    contents = shared(contents.join(grams, "g").where("n > 1 or contents > 1"))
    one = contents.where("contents > 1").select("at.doc", "at.copy", F.struct("g", "c", "at.gram", "at.start", "at.size").alias("s"))
    asked = one.groupBy("doc", "copy").agg(F.collect_list("s").alias("spans"))
    texts = docs.join(asked, ["doc", "copy"]).select("text", "spans").mapInArrow(_cut, "g long, c long, gram long, text binary").dropDuplicates(["g", "c"])
    texts = shared(texts.join(contents.select("g", "c", "contents"), ["g", "c"]))
    few = texts.where(F.col("contents") <= MOST).select(F.col("g").alias("key"), "g", "c", F.lit(0).cast("long").alias("low"), "text")
    todo, solved = [few], []
    many = texts.where(F.col("contents") > MOST).select("g", "c", "gram", "text")
    if not many.isEmpty():
        more, solved = _split_hot(many, length)
        todo += more
    blocks = todo[0]
    for t in todo[1:]:
        blocks = blocks.union(t)
    found = blocks.repartition("key").sortWithinPartitions("key").mapInArrow(lambda it: _blocks(it, length), "g long, c long, first long, last long")
    for s in solved:
        found = found.union(s)
    whole = contents.where("n > 1").select("g", "c", F.lit(0).cast("long").alias("first"), (F.col("at.size") - length).alias("last"))
    ranges = shared(found.union(whole).groupBy("g", "c").agg(F.collect_set(F.struct("first", "last")).alias("r")))
    total = marks.count()
    hot = contents.where(F.col("n") > total // HEAVY + 1).select("g", "c")
    hits = join_skewed(marks.select("doc", "copy", "g", "c", "start"), ranges, ["g", "c"], hot)
    hits = hits.select("doc", "copy", "start", F.explode("r").alias("r"))
    return hits.select("doc", "copy", (F.col("start") + F.col("r.first")).alias("start"), (F.col("start") + F.col("r.last") + length).alias("end"))


def remove_repeats(docs: DataFrame, length: int = 400) -> DataFrame:
    """docs without `text` but with kept (binary), n_bytes, n_removed and n_spans, for every row.

    Null texts are empty, rows repeated count as documents of their own and so remove each other, null ids
    and other columns pass through. Bytes are judged on the input: all copies go, and so do overlapping copies
    inside one text. A cut may fall inside a character. Rows are told apart by their id and a 64-bit hash of id and text,
    so only texts under one id could be mixed up.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} bytes or more")
    rest = [c for c in docs.columns if c != "text"]
    # Equal rows share a key and get the same spans, each of them counted.
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("__doc"), F.xxhash64("doc_id", text_bytes()).alias("__copy")]
    keyed = docs.select(*[F.col(f"`{c}`") for c in rest], text_bytes().alias("__text"), *key)
    spans = repeated_windows(keyed.select(F.col("__doc").alias("doc"), F.col("__copy").alias("copy"), F.col("__text").alias("text")), length)
    spans = spans.groupBy(F.col("doc").alias("__doc"), F.col("copy").alias("__copy")).agg(F.collect_set(F.struct("start", "end")).alias("__spans"))
    joined = keyed.join(spans, ["__doc", "__copy"], "left").select(*[F.col(f"`{c}`") for c in rest], "__text", "__spans")
    out = T.StructType([*joined.schema.fields[:-2], T.StructField("kept", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans"))])
    return joined.mapInArrow(_remove, out)
