"""Documents rearranged for fill-in-the-middle training."""

from __future__ import annotations

import re
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
LINES = r"[^\n]*\n|[^\n]+"


def cuts(text: str, unit: re.Pattern, first: int, second: int) -> tuple[int, int, int]:
    """(units, end of the prefix, end of the middle) in code points.

    Two passes of the matcher over the text: one counts the units, one goes on lazily to the lower and then to the upper
    rank, so that nothing is held but the counters. The ranks are the given numbers modulo one more than the units.
    """
    n = sum(1 for _ in unit.finditer(text))
    low, high = sorted((first % (n + 1), second % (n + 1)))
    matches, at, ends = unit.finditer(text), 0, []
    for rank, before in ((low, 0), (high, low)):
        if rank > before:
            at = next(islice(matches, rank - before - 1, None)).end()
        ends.append(at)
    return n, ends[0], ends[1]


def _number(digest: Column, group: int) -> Column:
    return F.conv(F.substring(digest, 8 * group + 1, 8), 16, 10).cast("long")


def fill_in_middle(docs: DataFrame, unit: str = LINES, seed: int = 7, percent: int = 100, spm_percent: int = 50, marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every row of docs (doc_id, text).

    The hash of `seed` and the id picks two borders between units, and the form: psm, spm, or plain for 100 - `percent` of the
    documents, for empty texts and for those that hold a mark. Plain texts stay as they are and have no lengths. Null texts
    are empty; a null id hashes as the empty one and stays null; repeated rows give equal rows; other columns are ignored.
    Texts of any length are matched whole, one at a time.
    """
    pattern = re.compile(unit)

    @F.pandas_udf("n long, low long, high long")
    def found(text: pd.Series, first: pd.Series, second: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([cuts(t, pattern, a, b) for t, a, b in zip(text, first, second, strict=True)], columns=["n", "low", "high"], dtype="int64")

    doc, text = F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc_id"), text.alias("text"), F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))), 256).alias("h"))
    marked = F.lit(False)
    for m in marks:
        marked = marked | F.contains("text", F.lit(m))
    form = F.when((F.col("text") == "") | marked | (_number(F.col("h"), 2) % 100 >= percent), "plain").when(_number(F.col("h"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), found("text", _number(F.col("h"), 0), _number(F.col("h"), 1)).alias("c"))
    low, high = F.col("c.low").cast("int"), F.col("c.high").cast("int")
    prefix, middle, suffix = F.substr("text", F.lit(1), low), F.substr("text", low + 1, high - low), F.substr("text", high + 1)
    p, s, m = map(F.lit, marks)
    output = F.when(F.col("form") == "plain", F.col("text")).when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle)).otherwise(F.concat(s, suffix, p, prefix, m, middle))
    own = lambda c: F.when(F.col("form") != "plain", c.cast("long"))
    return rows.select("doc_id", F.col("c.n").alias("n"), "form", own(low).alias("prefix_chars"), own(high - low).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text that an output of a form was made from. No mark is in it, and no mark begins with the end of another, so
    the first of each mark is the one that was put there."""
    p, s, m = marks

    def parts(first: str, second: str) -> list[Column]:
        body = F.substr(output, F.lit(len(first) + 1))
        a = F.substring_index(body, second, 1)
        tail = F.substr(body, F.length(a) + len(second) + 1)
        b = F.substring_index(tail, m, 1)
        return [a, b, F.substr(tail, F.length(b) + len(m) + 1)]

    psm, spm = parts(p, s), parts(s, p)
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)
