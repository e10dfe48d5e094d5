"""Benchmark decontamination by templates: numbers, names and units become typed slots before windows are matched."""

from __future__ import annotations

import re
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import HEAVY, join_skewed, released, shared, text_bytes

WINDOW, LEAST_WORDS, SHORTEST = 10, 5, 6
#: Exact windows of fewer words count only as a whole sentence.
ALONE = 3
FILTER_BITS = 24
REMEMBERED = 200_000
#: Item windows up to which they are broadcast.
SMALL = 200_000
UNITS = frozenset("mm cm m km in ft yd mi mg g kg lb lbs oz t ml l s sec secs min mins h hr hrs day days ms hz khz mhz ghz w kw v kb mb gb tb usd eur gbp % $ € £ °c °f c f k kmh mph".split())
NUMBER = re.compile(r"[+-]?\d+(?:[.,:/]\d+)*")
QUANTITY = re.compile(r"([$€£]?)([+-]?\d+(?:[.,:/]\d+)*)([^\W\d_]{0,4}|%|°[cf])$")
EDGES = re.compile(r"^[^\w$€£+%°-]+|[^\w%$€£°]+$|_+$|^_+")
NUM, UNIT, NAME = "<num>", "<unit>", "<name>"
SLOTS = (NUM, UNIT, NAME)
#: In front of exact words; no template word is this mark.
EXACT = "= "
PAUSES = ".,;:!?"

_WEIGHTS = np.array([xxhash.xxh64_intdigest(f"place {i}") | 1 for i in range(WINDOW)], np.uint64)
_CODE = {s: xxhash.xxh64_intdigest(s, 7) for s in SLOTS}
_CAPS, _END = 1, 2


def forms(token: str) -> tuple[list[tuple[str, str]], int]:
    """([(template word, value)], flags) of a token between white space; tokens without letters or digits have none.

    _CAPS: the one word is a name unless it opens a sentence. _END: a sentence ends here.
    """
    plain = token[:-1] if token[-1] in PAUSES else token
    if plain.isalpha():  # most tokens: a word and at most one mark, no number among them
        low, flags = plain.lower(), _END if token[-1] in ".!?:" else 0
        if low in UNITS and len(low) > 1:
            return [(UNIT, low)], flags
        return [(low, low)], flags | _CAPS if plain[0].isupper() and plain[1:].islower() else flags
    flags = _END if token[-1:] in ".!?:" or token[-2:-1] in (".", "!", "?") else 0
    bare = EDGES.sub("", token)
    low = bare.lower()
    if m := QUANTITY.match(low):
        out = [(NUM, m[2])]
        if m[1] or m[3]:
            unit = m[1] + m[3]
            out.append((UNIT if unit in UNITS else unit, unit))
        return out, flags
    if low in UNITS and len(low) > 1:
        return [(UNIT, low)], flags
    if not any(c.isalnum() for c in low):
        return [], flags
    if bare[0].isupper() and bare[1:].islower() and bare.isalpha():
        flags |= _CAPS
    return [(low, low)], flags


class Templates(dict):
    """Token -> id, and the codes of the tokens' template words, then of their values if asked for; remembers tokens, up to a bound.

    The words themselves are not kept: few windows need them, and `forms` gives them again.
    """

    def __init__(self, values: bool) -> None:
        self.values = values
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.tokens: list[str] = []
        self.flags, self.codes = array("b"), array("Q")
        self._table, self._flags, self._done = np.zeros((0, 4 if self.values else 2), np.uint64), np.zeros(0, np.int8), 0

    def __missing__(self, token: str) -> int:
        words, flags = forms(token)
        self._put([_CODE.get(w) or xxhash.xxh64_intdigest(w, 7) for w, _ in words[:2]])
        if self.values:
            self._put([xxhash.xxh64_intdigest(v, 8) for _, v in words[:2]])
        self.flags.append(flags)
        self[token] = at = len(self.tokens)
        self.tokens.append(token)
        return at

    def _put(self, own: list[int]) -> None:
        own += [0] * (2 - len(own))
        self.codes.fromlist(own)

    def read(self, text: str) -> np.ndarray:
        """Token ids of a text; earlier ids hold until the next call."""
        if len(self.tokens) > REMEMBERED:
            self.clear()
        own = text.split()
        return np.fromiter(map(self.__getitem__, own), np.int64, len(own))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(codes, flags) by token id; grown in steps, as tokens are added with every text."""
        n = len(self.flags)
        if n > len(self._flags):
            more = max(n, len(self._flags) * 2)
            table, flags = np.zeros((more, self._table.shape[1]), np.uint64), np.zeros(more, np.int8)
            table[: self._done], flags[: self._done] = self._table[: self._done], self._flags[: self._done]
            self._table, self._flags = table, flags
        if n > self._done:
            self._table[self._done : n] = np.frombuffer(self.codes, np.uint64).reshape(n, -1)[self._done :]
            self._flags[self._done : n] = np.frombuffer(self.flags, np.int8)[self._done :]
            self._done = n
        return self._table, self._flags


def _template(ids: np.ndarray, codes: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes of words with names as plain words, the token of each, whether it looks like a name, whether it is one)."""
    opens = np.concatenate(([True], (flags[ids[:-1]] & _END) > 0)) if len(ids) else np.zeros(0, bool)
    caps = (flags[ids] & _CAPS) > 0
    flat = codes[ids, :2].ravel()
    keep = np.flatnonzero(flat)
    token = keep // 2
    return flat[keep], token, caps[token], (caps & ~opens)[token]


def _window_hashes(code: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each window of `size` template words, whether it has LEAST_WORDS words that are no slots)."""
    n = len(code) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h += code[i : i + n] * _WEIGHTS[i]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    plain = np.concatenate(([0], np.cumsum(~np.isin(code, np.array(list(_CODE.values()), np.uint64)))))
    return h, plain[size:] - plain[:-size] >= min(LEAST_WORDS, size)


def _bits(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def _named(code: np.ndarray, name: np.ndarray) -> np.ndarray:
    return np.where(name, np.uint64(_CODE[NAME]), code)


def _item_windows(code: np.ndarray, caps: np.ndarray, name: np.ndarray, values: np.ndarray):
    """(size, hashes, which count, names or None for exact words) of an item, in all forms that documents may give it: as it
    is, with its first word as a name (quoted in mid-sentence), without names (in lower case), and, where the template
    has too few plain words, by its exact words."""
    size = min(WINDOW, len(code))
    forms_of = [name]
    if caps[0] and not name[0]:
        forms_of.append(np.concatenate(([True], name[1:])))
    if name.any():
        forms_of.append(np.zeros(len(name), bool))
    left = np.ones(len(code) - size + 1, bool)
    for i, own in enumerate(forms_of if size >= SHORTEST else []):
        h, firm = _window_hashes(_named(code, own), size)
        yield size, h, firm, own
        if i == 0:
            left = ~firm
    if left.any():
        yield size, _window_hashes(values, size)[0], left, None


def _text_windows(code: np.ndarray, name: np.ndarray, values: np.ndarray | None, ends: np.ndarray, sizes: tuple, bitmap: np.ndarray):
    """The same of a document: windows that the bitmap admits."""
    named = _named(code, name)
    for size, exact in [(WINDOW, False), *((x, False) for x in sizes[0]), *((x, True) for x in sizes[1])]:
        h, firm = _window_hashes(values if exact else named, size)
        if exact and size < ALONE and len(h):
            firm &= np.concatenate(([True], ends[:-1]))[: len(h)] & ends[size - 1 :]
        where = _bits(h)
        yield size, h, firm & ((bitmap[where >> 3] >> (where & 7)) & 1 == 1), None if exact else name


def _windows(batches, sizes, bitmap: np.ndarray | None):
    """(id, copy, at, size, of, h, template, slots): windows of texts, of all words; with a bitmap only those that may match,
    of the sizes for templates and the sizes for exact words.

    copy is a hash of the text, as one id may have several;
    slots are the values in the template's slots, in order; of is the number of template words of the text. The template of
    exact words starts with EXACT and has no slots.
    """
    released()
    memory = Templates(values=bitmap is None or bool(sizes[1]))
    for b in batches:
        out = [[] for _ in range(8)]
        for key, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            raw = raw.as_py()
            ids = memory.read(raw.decode("utf-8", "replace"))
            if not len(ids):
                continue
            table, flags = memory.arrays()
            code, token, caps, name = _template(ids, table, flags)
            if not len(code):
                continue
            values = ends = None
            if memory.values:
                values = table[ids, 2:].ravel()
                values = values[values != 0]
                ends = np.append(((flags[ids[token[:-1]]] & _END) > 0) & (token[1:] != token[:-1]), True)
            found = _item_windows(code, caps, name, values) if bitmap is None else _text_windows(code, name, values, ends, sizes, bitmap)
            copy = None
            for size, h, firm, named in found:
                for at in np.flatnonzero(firm).tolist():
                    copy = xxhash.xxh64_intdigest(raw) - (1 << 63) if copy is None else copy
                    words, slots = [], []
                    for i in range(at, at + size):
                        own = forms(memory.tokens[ids[token[i]]])[0]
                        word, value = own[1] if i and token[i] == token[i - 1] else own[0]
                        word = value if named is None else NAME if named[i] else word
                        words.append(word)
                        if named is not None and word in SLOTS:
                            slots.append(value)
                    for col, x in zip(out, (key, copy, at, size, len(code), h[at].astype(np.int64), ("" if named is not None else EXACT) + " ".join(words), slots), strict=True):
                        col.append(x)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "copy", "at", "size", "of", "h", "template", "slots"])


_SCHEMA = "id long, copy long, at long, size long, of long, h long, template string, slots array<string>"


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, reparameterised): documents (doc_id, text) that hold windows of benchmark items (item_id, text).

    Both sides become template words: lower-case words, with numbers, units and names inside sentences as typed slots. An
    item's windows are WINDOW template words long (all of an item that is shorter, down to SHORTEST), with LEAST_WORDS
    words that are no slots; the first word also as a name, and names also as plain words. Shorter items and windows with fewer
    plain words are looked up by their exact words, in any case; those of under ALONE words only as a whole sentence. Windows meet by the hash of the template and then by the template. An occurrence is the windows of one
    text and one item at the same distance. It stands if, over all its windows, equal slot values of the item are equal in the
    document, so that a question with other numbers or names is found but not a form that is filled in at random; windows
    with slots that break this drop out, unless their own values are the item's. Several occurrences do not disturb each other.
    coverage is the share of the item's windows found; reparameterised: some slot value differs.

    Documents send on only windows that a bitmap of all item windows admits; the bitmap has 2**FILTER_BITS bits, whatever
    the benchmark's size. Null texts and ids match nothing; repeated documents and items count once; other columns are ignored.
    """
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("id"), text_bytes().alias("text")).distinct()
    own = shared(items.mapInArrow(lambda it: _windows(it, ((), ()), None), _SCHEMA).distinct())
    kinds = own.select("size", F.col("template").startswith(EXACT).alias("exact")).distinct().collect()
    sizes = [r["size"] for r in kinds if not r["exact"] and r["size"] < WINDOW], [r["size"] for r in kinds if r["exact"]]
    place = own.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).alias("place"))
    cells = place.selectExpr("place div 8 as cell", "shiftleft(1, cast(place % 8 as int)) as bit").groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow()
    bitmap = np.zeros(1 << FILTER_BITS - 3, np.uint8)
    bitmap[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("id"), text_bytes().alias("text"))
    seen = rows.mapInArrow(lambda it: _windows(it, sizes, sent.value), _SCHEMA)
    seen = seen.select(F.col("id").alias("doc_id"), "copy", F.col("at").alias("place"), "h", "template", F.col("slots").alias("have")).distinct()
    known = own.select(F.col("id").alias("item_id"), F.col("copy").alias("item_copy"), "h", "template", "at", F.col("slots").alias("want"), (F.col("of") - F.col("size") + 1).alias("windows"))
    one = ["doc_id", "copy", "item_id", "item_copy", "shift"]
    if own.count() <= SMALL:
        met = seen.join(F.broadcast(known), ["h", "template"])
    else:
        seen = shared(seen)
        hot = seen.groupBy("h", "template").agg(F.count("*").alias("n")).where(F.col("n") > seen.count() // HEAVY + 1)
        met = join_skewed(seen, known, ["h", "template"], shared(hot))
    pairs = shared(met.select(*one[:-1], (F.col("place") - F.col("at")).alias("shift"), "at", "want", "have", "windows"))
    slots = pairs.select(*one, F.explode(F.arrays_zip("want", "have")).alias("s")).select(*one, "s.want", "s.have")
    broken = slots.groupBy(*one, "want").agg(F.min("have").alias("a"), F.max("have").alias("b")).where("a <> b")
    broken = broken.groupBy(*one).agg(F.collect_set("want").alias("broken"))
    kept = pairs.join(broken, one, "left").where(F.col("broken").isNull() | (F.col("want") == F.col("have")) | ~F.arrays_overlap("want", "broken"))
    return kept.groupBy("doc_id", "item_id").agg(
        F.countDistinct("at").alias("n_windows"), (F.countDistinct("at") / F.max("windows")).alias("coverage"), F.max(F.col("want") != F.col("have")).alias("reparameterised")
    )
