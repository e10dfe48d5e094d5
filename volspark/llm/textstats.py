"""Counts over one text that the quality operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from volspark.llm.common import text_bytes

SPACES = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = [
    "log_words", "word_length", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share",
    "shouts_per_word", "stops_per_word", "commas_per_word", "beyond_ascii_share", "distinct_share", "lines_per_word",
    "bars_per_word", "top_word_share", "echo_share", "long_word_share",
]
_SPACE = np.frombuffer(SPACES, np.uint8)
_SYMBOL = np.frombuffer(SYMBOLS, np.uint8)


def repeated_positions(ids: np.ndarray, kinds: int, width: int = 3) -> int:
    """Words that lie in a window of `width` words that occurs twice or more."""
    n = len(ids) - width + 1
    if n < 2:
        return 0
    key, most = ids[:n], kinds
    for i in range(1, width):
        if most > (1 << 62) // max(kinds, 1):
            key = np.unique(key, return_inverse=True)[1]
            most = n
        key, most = key * kinds + ids[i : i + n], most * kinds
    ordered = np.argsort(key, kind="stable")
    same = key[ordered][1:] == key[ordered][:-1]
    twice = np.zeros(n, bool)
    twice[ordered[1:]] = same
    twice[ordered[:-1]] |= same
    cover = np.zeros(len(ids), bool)
    for i in range(width):
        cover[i : i + n] |= twice
    return int(cover.sum())


def measure(text: bytes) -> tuple[list[int], list[float]]:
    """(COUNTS, RATIOS) of a text; a text without words has zeros."""
    words = text.split()
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    points = int(hist.sum() - hist[0x80:0xC0].sum() - hist[_SPACE].sum())
    symbols = int(hist[_SYMBOL].sum())
    lines = [x for x in text.split(b"\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    again = repeated_positions(ids, len(seen))
    m, p = max(n, 1), max(points, 1)
    upper, lower = int(hist[65:91].sum()), int(hist[97:123].sum())
    freq = np.bincount(ids, minlength=1)
    ratios = [
        float(np.log1p(n)), points / m, symbols / m, dup / max(len(lines), 1), again / m, upper / max(upper + lower, 1), int(hist[48:58].sum()) / p,
        int(hist[33]) / m, int(hist[46]) / m, int(hist[44]) / m, int(hist[0xC0:].sum()) / p, len(seen) / m, len(lines) / m,
        int(hist[124]) / m, int(freq.max()) / m, float((ids[1:] == ids[:-1]).sum()) / m, sum(len(w) > 25 for w in words) / m,
    ]
    return [n, points, symbols, dup, again], ratios


def _measure(batches):
    """The columns before the last one, then COUNTS and RATIOS of the last one's texts."""
    for b in batches:
        got = [measure(t) for t in b.column(b.num_columns - 1).to_pylist()]
        counts = np.array([g[0] for g in got], np.int64).reshape(-1, len(COUNTS))
        ratios = np.array([g[1] for g in got], np.float64).reshape(-1, len(RATIOS))
        own = [b.column(i) for i in range(b.num_columns - 1)]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(counts[:, i]) for i in range(len(COUNTS))), *(pa.array(ratios[:, i]) for i in range(len(RATIOS)))], [*b.schema.names[:-1], *COUNTS, *RATIOS])


def text_stats(docs: DataFrame, keep: list[str] = ()) -> DataFrame:
    """(doc_id, columns to keep, COUNTS as long, RATIOS as double) of every row of docs; null texts are empty."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_bytes().alias("text"))
    own = T.StructType(rows.schema.fields[:-1])
    for kind, names in ((T.LongType(), COUNTS), (T.DoubleType(), RATIOS)):
        for c in names:
            own.add(c, kind)
    return rows.mapInArrow(_measure, own)
