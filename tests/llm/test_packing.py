"""Packing against the tokenizer itself and against a plain best-fit search."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from volspark.llm import packing
from volspark.llm.common import table

MODEL = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return [*MODEL.encode(text or "", add_special_tokens=False).ids, 1]


def check(df, rows):
    """Each row's ids lie in exactly one piece each, sequences have no holes; returns the sequences' lengths."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in df.collect():
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        assert len(ids) == r["length"] > 0
        pieces[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    got, want = Counter(), Counter()
    for (doc, total), own in pieces.items():
        by_start = defaultdict(list)
        for start, ids in own:
            by_start[start].append(ids)
        while by_start[0]:  # repeated rows with equal cuts or not: follow one from its start
            at, ids = 0, []
            while at < total:
                ids += by_start[at].pop()
                at = len(ids)
            got[doc, tuple(ids)] += 1
        assert not any(by_start.values())
    for doc, text in rows:
        want[doc, tuple(ids_of(text))] += 1
    assert got == want
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    return [sum(n for _, n in own) for own in sequences.values()]


def padding(lengths):
    return sum(0 if n & (n - 1) == 0 else 2048 - n for n in lengths) / sum(lengths)


def test_documents(docs, rows, empty):
    unique = [(r[0], r[1]) for r in {(r[0], r[1]): r for r in rows}.values()]
    single = docs.dropDuplicates(["doc_id", "text"])
    assert padding(check(packing.pack(single), unique)) < 0.008
    both = packing.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"))
    want = Counter()
    for r in rows:
        want[r[0]] += len(ids_of(r[1]))
    assert {r["doc_id"]: r["n"] for r in both.collect()} == want
    assert packing.pack(empty).count() == 0
    again = [packing.pack(docs.coalesce(1)).select("doc_id", "start", "length", "sequence_id", "offset").collect() for _ in range(2)]
    assert again[0] == again[1]


def test_query_on_table(spark):
    from volspark.llm.queries import op11_packing

    sf = "/root/testdata/sf0.001"
    out = op11_packing(spark, sf).collect()
    texts = {r["doc_id"]: r["text"] for r in table(spark, sf, "documents").collect()}
    assert {r["doc_id"] for r in out} == set(texts)
    for r in out:
        ids = ids_of(texts[r["doc_id"]])
        own = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
        assert (r["doc_tokens"], r["ids_crc32"]) == (len(ids), zlib.crc32(own.tobytes()))


def test_sequences(docs):
    packed = packing.pack(docs).cache()
    out = {r["sequence_id"]: r for r in packing.sequences(packed, pad=7).collect()}
    for s, r in out.items():
        ids = np.frombuffer(bytes(r["ids"]), "<u4").tolist()
        own = sorted(packed.where(F.col("sequence_id") == s).collect(), key=lambda p: p["offset"]) if s % 5 == 0 else []
        joined = [x for p in own for x in np.frombuffer(bytes(p["ids"]), "<u4").tolist()]
        assert not own or ids[: r["length"]] == joined
        assert len(ids) in (2048, r["length"]) and set(ids[r["length"] :]) <= {7}
    packed.unpersist()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\r\tab'sé9!_<|>日\u00a0\u0085²½ªº×ß"), st.characters(min_codepoint=32, max_codepoint=0x24F)), max_size=60), st.booleans(), st.integers(1, 9))
def test_ids_are_the_tokenizers(text, special, block):
    text = text + " <|endoftext|>x" if special else text
    whole, packing.BLOCK = packing.BLOCK, block
    ids = packing.encoded(text, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken").tolist()
    packing.BLOCK = whole
    assert ids == MODEL.encode(text, add_special_tokens=False).ids


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 63), max_size=60), st.integers(1, 9))
def test_best_fit(lengths, least):
    free, windows = [], []
    for p in sorted(range(len(lengths)), key=lambda p: (-lengths[p], p)):
        fits = [f for f in free if f >= lengths[p]]
        if fits:
            free.remove(min(fits))
        free.append((min(fits) if fits else 64) - lengths[p])
    windows = packing.best_fit(lengths, 64)
    assert sorted(64 - sum(lengths[p] for p in w) for w in windows) == sorted(free)
    full = packing.topped_up([[(p, 0, lengths[p]) for p in w] for w in windows], 64, least)
    sizes = [sum(p[2] for p in w) for w in full]
    assert all(s <= 64 and (64 - s < least or s & (s - 1) == 0) for s in sizes)
    covered = sorted((p, start + i) for w in full for p, start, n in w for i in range(n))
    assert covered == [(p, i) for p, n in enumerate(lengths) for i in range(n)]


def test_long_word_and_long_document():
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefgh") for _ in range(20_000)) + " " + "word " * 400_000
    assert packing.encoded(long, "byte_bpe_50k.json", "byte_bpe_50k.tiktoken").tolist() == MODEL.encode(long, add_special_tokens=False).ids
