"""Token counts of whole texts without their ids."""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import text_bytes

PRE_TOKEN = re.compile(r" *[^ ]+| +")
#: Bytes of text whose pre-tokens are counted together, and pre-tokens whose piece counts a task remembers.
CHUNK = 1 << 23
REMEMBERED = 200_000


@cache
def _model(name: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(name))


def pre_tokens(text: str) -> list[str]:
    """Spaces with the word after them. No piece of the vocabulary has a space mark behind another character, so no merge
    crosses these borders; the mark's own character reads as a space, and a text that is not empty gets one in front."""
    if not text:
        return []
    text = " " + text.replace("▁", " ")
    if "  " in text or text[-1] == " ":
        return PRE_TOKEN.findall(text)
    return [" " + w for w in text[1:].split(" ")]


def piece_counts(words: list[str], name: str) -> np.ndarray:
    """Pieces of each pre-token, which starts with a space: a letter before it keeps the library from adding one."""
    model = _model(name)
    alone = len(model.encode("a"))
    return np.array([len(p) - alone for p in model.encode(["a" + w for w in words])], np.int64)


def _count(batches, name: str):
    known: dict[str, int] = {}

    def join(owner: list, words: list, freq: list, docs: int) -> np.ndarray:
        nonlocal known
        fresh = [w for w in set(words) if w not in known]
        if len(known) + len(fresh) > REMEMBERED:
            known, fresh = {}, list(set(words))
        known.update(zip(fresh, piece_counts(fresh, name).tolist(), strict=True))
        pieces = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        return np.bincount(np.array(owner, np.int64), pieces * np.array(freq, np.int64), docs).astype(np.int64)

    from collections import Counter

    for b in batches:
        n_bytes, n_tokens, done = [], np.zeros(b.num_rows, np.int64), 0
        owner, words, freq, size = [], [], [], 0
        for i, raw in enumerate(b.column(1)):
            raw = raw.as_py()
            n_bytes.append(len(raw))
            own = Counter(pre_tokens(raw.decode("utf-8", "replace")))
            owner += [i - done] * len(own)
            words += own.keys()
            freq += own.values()
            size += len(raw)
            if size >= CHUNK:
                n_tokens[done : i + 1] = join(owner, words, freq, i + 1 - done)
                done, owner, words, freq, size = i + 1, [], [], [], 0
        if done < b.num_rows:
            n_tokens[done:] = join(owner, words, freq, b.num_rows - done)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens)], ["doc_id", "n_bytes", "n_tokens"])


def count_tokens(docs: DataFrame, model: str = "piece_bpe_32k.model", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of docs (doc_id, text); null texts are empty.

    Each task keeps a dictionary of pre-tokens with their piece counts, joins it to the pre-token frequencies of its
    documents and sums; a document's ids never exist, and no row is shuffled. Words repeat so much that the pieces of a
    pre-token are computed once for very many uses; the dictionary's size is bounded, and it starts anew beyond that.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))
    counted = rows.mapInArrow(lambda it: _count(it, model), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
