"""Documents' token ids packed into training sequences with next to no padding."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import text_bytes

#: A space between two other characters that are no white space: a pre-token ends before it, so a text can be cut there.
BORDER = re.compile(r"(?<=\S) (?=\S)")
#: Texts without these have no characters that the two libraries may class by different versions of Unicode, and no special string.
FOREIGN = re.compile(r"[^\t\n\r -~\u00A1-\u024F]|<\|")
#: Letters of a text that are encoded at once.
BLOCK = 1 << 20
#: Tokens of open pieces that a task holds at once; they are packed together.
HELD = 1 << 22
#: Bits of a sequence's number within its partition.
BITS = 40


@cache
def _models(tokenizer: str, ranks: str | None):
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(tokenizer))
    if ranks is None:
        return own, None
    with open(public_tokenizers.path(ranks), "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return own, tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})


def blocks(text: str):
    """text in parts of about BLOCK letters, cut where pre-tokens end; a stretch without such a place is one part."""
    at = 0
    while at < len(text):
        m = BORDER.search(text, at + BLOCK)
        end = m.start() if m else len(text)
        yield text[at:end]
        at = end


def encoded(text: str, tokenizer: str, ranks: str | None) -> np.ndarray:
    """The text's ids by the tokenizer. Where `ranks` names the same vocabulary as ranks, Latin texts take the library for that, which
    gives the same ids in a fifth of the time."""
    own, fast = _models(tokenizer, ranks)
    parts = []
    for part in blocks(text):
        if fast and not FOREIGN.search(part):
            parts.append(fast.encode_to_numpy(part).astype("<u4"))
        else:
            parts.append(np.array(own.encode_batch_fast([part], add_special_tokens=False)[0].ids, "<u4"))
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


class OpenWindows:
    """Open windows by what is free in them. A segment tree over the capacities holds whether any window of a range is open, so
    the tightest one that a piece fits into is found by one walk up and one down."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.at = [[] for _ in range(most + 1)]

    def add(self, free: int, window: int) -> None:
        self.at[free].append(window)
        node = self.leaves + free
        while node:
            self.open[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """(free, window) of the open window of least free space, but `need`; it is open no more."""
        node = self.leaves + need
        if not self.open[node]:
            while node > 1 and not (node % 2 == 0 and self.open[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.open[2 * node] else 2 * node + 1
        free = node - self.leaves
        while node:
            self.open[node] -= 1
            node >>= 1
        return free, self.at[free].pop()


def best_fit(lengths: list[int], most: int) -> list[list[int]]:
    """Windows as lists of pieces: each piece, the longest first, goes where least space is left over, else opens a window."""
    windows, free = [], OpenWindows(most)
    for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        found = free.take(lengths[p])
        left, w = found or (most, len(windows))
        if found is None:
            windows.append([])
        windows[w].append(p)
        if left > lengths[p]:
            free.add(left - lengths[p], w)
    return windows


def topped_up(windows: list[list[tuple]], most: int, least: int) -> list[list[tuple]]:
    """Windows of pieces (piece, start, length) with gaps of `least` or more filled from the emptiest windows, whose pieces are cut
    for that; the last window that is left over is cut into powers of two, which need no padding."""
    size = lambda w: sum(p[2] for p in w)
    whole = lambda n: n & (n - 1) == 0
    done = [w for w in windows if most - size(w) < least or whole(size(w))]
    gaps = sorted((w for w in windows if not (most - size(w) < least or whole(size(w)))), key=size, reverse=True)

    def move(source: list[tuple], to: list[tuple], n: int) -> int:
        """Up to n tokens from the end of a window; what is moved."""
        p, start, length = source.pop()
        n = min(n, length)
        if n < length:
            source.append((p, start, length - n))
        to.append((p, start + length - n, n))
        return n

    i, j = 0, len(gaps) - 1
    while i < j:
        need = most - size(gaps[i])
        while need and i < j:
            need -= move(gaps[j], gaps[i], need)
            if not gaps[j]:
                j -= 1
        if not need:
            done.append(gaps[i])
            i += 1
    if i <= j and gaps[i]:
        last, left = gaps[i], size(gaps[i])
        while left:
            to, need = [], 1 << (left.bit_length() - 1)
            left -= need
            while need:
                need -= move(last, to, need)
            done.append(to)
    return done


def _packed(batches, tokenizer: str, ranks: str | None, end: int, most: int, least: int):
    from pyspark import TaskContext

    n_sequences, last = TaskContext.get().partitionId() << BITS, np.array([end], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    rows: list[tuple] = []
    held: list[tuple] = []

    def put(window: list[tuple]) -> None:
        """A sequence of pieces (doc_id, start, ids, doc_tokens)."""
        nonlocal n_sequences
        at = 0
        for doc, start, ids, total in window:
            rows.append((doc, start, len(ids) // 4, ids, total, n_sequences, at))
            at += len(ids) // 4
        n_sequences += 1

    def close() -> None:
        lengths = [len(h[2]) // 4 for h in held]
        windows = [[(p, 0, lengths[p]) for p in w] for w in best_fit(lengths, most)]
        for w in topped_up(windows, most, least):
            put([(held[p][0], held[p][1] + start, held[p][2][4 * start : 4 * (start + n)], held[p][3]) for p, start, n in w])
        held.clear()

    def batch():
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
        rows.clear()
        return out

    size = out = 0
    for b in batches:
        for doc, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids = encoded(raw.as_py().decode("utf-8", "replace"), tokenizer, ranks).tobytes() + last
            total, at = len(ids) // 4, 0
            while total - at >= most:  # whole windows of a long document
                put([(doc, at, ids[4 * at : 4 * (at + most)], total)])
                at, out = at + most, out + most
                if out >= HELD:
                    yield batch()
                    out = 0
            if at < total:
                held.append((doc, at, ids[4 * at :], total))
                size += total - at
            if size >= HELD:
                close()
                size = 0
                yield batch()
    close()
    if rows:
        yield batch()


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", ranks: str | None = "byte_bpe_50k.tiktoken", end: int = 1, most: int = 2048, least: int = 16) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset): a row for each piece of each row of docs (doc_id, text).

    A document is its ids and `end`; null texts are empty and have `end` only, null ids stay null, repeated rows are packed each,
    other columns are ignored, no rows give none. ranks: the tokenizer's vocabulary as ranks, if there is one. ids are little-endian unsigned 32-bit integers. Documents of `most` tokens
    or more first give whole windows; best-fit decreasing packs what is left of them and all shorter ones. Gaps of `least`
    tokens or more are then filled by cutting the pieces of the emptiest windows, and the one window that may be left over
    becomes sequences of powers of two. Ties go to the document that came first.

    Each task packs its own documents, some four million tokens together, so no id crosses the network and a task that runs
    again gives the same pieces. A sequence's number holds its partition's; it is unique, not dense.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    kind = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(lambda it: _packed(it, tokenizer, ranks, end, most, least), kind)


def sequences(packed: DataFrame, most: int = 2048, pad: int = 0) -> DataFrame:
    """(sequence_id, length, ids): what a trainer reads. Each sequence's pieces in order, padded to `most` ids unless its length is a
    power of two. A sequence has `most` pieces at most."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: F.hex(x["ids"]))
    own = packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_join(parts, "").alias("h"))
    more = F.when(F.bit_count(F.col("length")) == 1, 0).otherwise(most - F.col("length")).cast("int")
    filler = int(pad).to_bytes(4, "little").hex().upper()
    return own.select("sequence_id", "length", F.unhex(F.concat("h", F.repeat(F.lit(filler), more))).alias("ids"))
