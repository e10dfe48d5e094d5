"""Fill-in-the-middle against plain Python."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from volspark.llm import fim

UNIT = re.compile(fim.LINES)


def expected(doc, text, unit=UNIT, percent=100, spm=50):
    text = text or ""
    h = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(h[8 * g : 8 * g + 8], 16) for g in range(4)]
    ends = [0] + [m.end() for m in unit.finditer(text)]
    a, b = sorted((h[0] % len(ends), h[1] % len(ends)))
    prefix, middle, suffix = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    if not text or any(m in text for m in fim.MARKS) or h[2] % 100 >= percent:
        return doc, len(ends) - 1, "plain", None, None, text, text
    form = "spm" if h[3] % 100 < spm else "psm"
    out = f"<P>{prefix}<S>{suffix}<M>{middle}" if form == "psm" else f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc, len(ends) - 1, form, len(prefix), len(middle), out, text


def key(r):
    return tuple((v is not None, v) for v in r)


EXTRA = [(200 + i, t, "en", "m", 0) for i, t in enumerate(("a <P> b\nc", "<M>", "\n", "\n\n\n", "no end", "one\n", "x<\n>P>\n<\nS\n>", "Ωmega\n日本\n\r\nlast", "<S\n>", "line\n" * 50_000))]


@pytest.mark.parametrize("unit", [fim.LINES, r"\S+\s*"])
@pytest.mark.parametrize("percent", [100, 60, 0])
def test_documents(spark, docs, rows, unit, percent):
    extra = spark.createDataFrame(EXTRA, "doc_id long, text string, lang string, source string, n_chars int")
    both = docs.select(*extra.columns).union(extra).withColumns({c: F.lit(1) for c in ("form", "output", "h", "c", "n")})
    out = fim.fill_in_middle(both, unit, percent=percent).withColumn("restored", fim.restored(F.col("output"), F.col("form")))
    want = [expected(r[0], r[1], re.compile(unit), percent) for r in rows + EXTRA]
    assert sorted(map(tuple, out.collect()), key=key) == sorted(want, key=key)
    assert {w[2] for w in want} == ({"plain", "psm", "spm"} if percent else {"plain"})


def test_empty_table(empty):
    assert fim.fill_in_middle(empty).count() == 0


def test_borders_at_every_rank():
    text = "a\nb\nc"
    for a in range(4):
        for b in range(4):
            low, high = sorted((a, b))
            assert fim.cuts(text, UNIT, a, b) == (3, min(2 * low, 5), min(2 * high, 5))
