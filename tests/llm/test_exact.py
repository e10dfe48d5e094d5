"""Operators whose every value can be computed by brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import xxhash

from volspark.llm import bpe, lm, rules, simhash, suffix, tokens

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(r):
    return tuple((v is not None, v) for v in r)


def same(df, expected):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(expected, key=key)


def fingerprint(text):
    w = WORDS.findall((text or "").translate(LOWER))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def groups(fps):
    """{fingerprint: smallest one reachable} by comparing all pairs."""
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ordered = sorted(root)
    for i, a in enumerate(ordered):
        for b in ordered[:i]:
            if (a ^ b).bit_count() <= 4:
                low, high = sorted((find(a), find(b)))
                root[high] = low
    return {f: find(f) for f in ordered}


def test_simhash(docs, rows, empty):
    fps = [fingerprint(r[1]) for r in rows]
    root = groups(set(fps))
    least = {}
    for r, f in zip(rows, fps, strict=True):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    expected = [(r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fps, strict=True)]
    same(simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id"), expected)
    same(simhash.near_duplicates(docs, most_per_key=1).select("doc_id", "fingerprint", "component_id"), expected)
    assert simhash.near_duplicates(empty).count() == 0


def test_simhash_links_of_crowded_keys(spark):
    rng = np.random.default_rng(1)
    base = int(rng.integers(1 << 62))
    fps = {base}
    while len(fps) < 150:
        f = base
        for bit in rng.choice(64, int(rng.integers(1, 6)), replace=False):
            f ^= 1 << int(bit)
        fps.add(f & (1 << 63) - 1)
    from volspark.operators.graph import connected_components

    expected = groups(fps)
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    for parts, most in ((None, 4), (2, 1000), (2, 4), (3, 1000), (4, 20)):
        got = {r["node"]: r["root"] for r in connected_components(simhash.links(frame, parts=parts, most_per_key=most), "a", "b").collect()}
        assert {f: got.get(f, f) for f in fps} == expected
    assert simhash.segments_for(10**5) == 3 and simhash.segments_for(10**9) == 2


def removed(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int), [0])))
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((len(t), int(gone.sum()), int((edges == 1).sum()), kept))
    return out


def test_suffix(docs, rows, empty):
    texts = [(r[1] or "").encode() for r in rows]
    expected = [(r[0], *x) for r, x in zip(rows, removed(texts, 400), strict=True)]
    got = suffix.remove_repeats(docs).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "kept")
    assert sorted((tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in got.collect()), key=key) == sorted(expected, key=key)
    assert suffix.remove_repeats(empty).count() == 0


def test_suffix_of_many_contents_with_one_gram(spark, monkeypatch):
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(map(chr, rng.integers(97, 123, n)))
    core = letters(330)
    tails = [letters(40) for _ in range(6)]
    texts = [letters(300) + tails[i % 6] + core + tails[(i * 5 + i // 6) % 6] + letters(200) for i in range(60)]
    expected = [(i, *x[1:3]) for i, x in enumerate(removed([t.encode() for t in texts], 400))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(suffix, "MOST", 4)
    same(suffix.remove_repeats(frame).select("doc_id", "n_removed", "n_spans"), expected)
    assert any(e[1] for e in expected)


def test_token_counts(docs, rows, empty):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = []
    for r in rows:
        n = len(model.encode(r[1] or ""))
        expected.append((r[0], len((r[1] or "").encode()), n, n > 4096))
    same(tokens.count_tokens(docs), expected)
    assert tokens.count_tokens(empty).count() == 0


def test_bpe(docs, rows, empty):
    import public_tokenizers
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    expected = []
    for r in rows:
        ids = enc.encode_ordinary(r[1] or "")
        expected.append((r[0], len(ids), sha(",".join(map(str, ids)).encode()), sha((r[1] or "").encode())))
    same(bpe.encode_digests(docs), expected)
    assert bpe.encode_digests(empty).count() == 0


def test_lm(docs, rows, empty):
    fold = lambda r: zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 10
    toks = [WORDS.findall((r[1] or "").translate(LOWER)) + [None] for r in rows]
    counts = Counter(t for r, ts in zip(rows, toks, strict=True) if fold(r) for t in ts)
    n, v = sum(counts.values()), len(counts)
    for frequent in (100_000, 20):
        got = sorted(lm.score_texts(docs, vocabulary=16, frequent=frequent, width=4, samples=8, inside=2).collect(), key=key)
        expected = sorted(
            ((r[0], fold(r) == 0, len(ts), sum(t in counts for t in ts), n, sum(math.log10((counts[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)) for r, ts in zip(rows, toks, strict=True)), key=key
        )
        assert [tuple(g)[:5] for g in got] == [e[:5] for e in expected]
        assert np.allclose([g[5] for g in got], [e[5] for e in expected], rtol=1e-9)
        assert all(g[6] < 0 and math.isfinite(g[6]) for g in got)
    assert lm.score_texts(empty).count() == 0
    few = lm.score_texts(docs.where("doc_id in (1, 66, 67)"), vocabulary=16)
    assert few.count() == 3 and not few.where("score is null or score >= 0").count()


def test_lm_normalises():
    """Over all words, with one unseen word for each spelling class, probabilities sum to 1 after every context."""
    rng = np.random.default_rng(0)
    place = {w: i for i, w in enumerate(sorted((f"w{i}".encode() for i in range(130)), key=lambda w: w[::-1]))}
    n = len(place) + lm.SPELLINGS
    shape = lambda *s: rng.normal(size=s).astype("f4")
    m = lm.LogBilinear(place, shape(n + 2, 3), shape(n + 2, 3), shape(3 + lm.SPELLINGS + 1, 4), shape(130, 4))
    e = np.arange(n + 1)
    for c2, c1 in ((0, 1), (n + 1, n + 1), (140, 20), (130, n)):
        assert abs(np.exp(m.log_probabilities(np.full(n + 1, c2), np.full(n + 1, c1), e)).sum() - 1) < 1e-4


def test_lm_scores_by_hand(spark):
    """The score of a text is the sum of its tokens' probabilities, whatever the number of partitions."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.4, 60) % 90) for _ in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = [sorted((r["doc_id"], r["score"]) for r in lm.score_texts(docs.repartition(n), vocabulary=20, frequent=30, shard=2000).collect()) for n in (1, 6)]
    # scores are sums of single-precision products (eps 6e-8), whose last bits depend on the batch and the machine's matrix library
    assert np.allclose([x[1] for x in got[0]], [x[1] for x in got[1]], rtol=1e-7)
    train = [t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10]
    counts = Counter(w for t in train for w in [*t.encode().split(), None])
    top = sorted((w for w in counts if w), key=lambda w: (-counts[w], w))[:20]
    rare = np.full(lm.SPELLINGS, 0.1)
    for w in counts:
        if w and w not in top:
            rare[lm.spelling(w)] += counts[w] + 0.1
    frame = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0").selectExpr("xxhash64(doc_id, cast(text as binary)) row", "cast(text as binary) text")
    model = lm.fit(frame, [(w, counts[w]) for w in top], rare, counts[None], sum(counts.values()), shard=2000)
    for i in (0, 7, 40):
        words = texts[i].encode().split()
        ids = lm.ids_of(words, model.place)
        want = model.log_probabilities(ids[:-2], ids[1:-1], ids[2:]).sum() / math.log(10)
        want += sum(math.log10((counts[w] + 0.1) / rare[lm.spelling(w)]) for w in words if w not in model.place)
        assert math.isclose(want, got[0][i][1], rel_tol=1e-5)


def test_lm_beats_the_unigrams(spark):
    """On held-out rows at sf0.01 the model is at least 2 % better than the base score."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    r = lm.score_texts(d).where("held_out").selectExpr("sum(score) s", "sum(base_score) b").first()
    assert r["s"] > 0.98 * r["b"]


def base_rules(text):
    w = WORDS.findall(text or "")
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    twice = Counter(windows)
    covered = {i + d for i, x in enumerate(windows) if twice[x] > 1 for d in range(3)}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), n < 50 or 100 * len(covered) > 50 * n


def test_quality_counts(spark, docs, rows, empty):
    labels = spark.createDataFrame([(r[0], 1, 0) for r in rows[:40]] + [(None, None, None)], "doc_id long, quality int, toxic int")
    got = rules.filter_quality(docs, labels)
    same(got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"), [(r[0], *base_rules(r[1])) for r in rows])
    assert not got.where("base_failed and kept").count()
    assert rules.filter_quality(empty, labels).count() == 0
    assert rules.filter_quality(docs, labels.where("false")).where("kept = base_failed").count() == 0


def test_template_memory_hashes_values_only_where_they_are_compared():
    """F: op10 worked out four codes and kept the words of every new token of a document, which was most of its time."""
    from volspark.llm.decontam import Templates

    short, full = Templates(values=False), Templates(values=True)
    text = "In 1999, Mary ran 5km to Rome. Mary, 5km; -- go.é"
    a, b = short.read(text), full.read(text)
    assert a.tolist() == b.tolist() and [short.tokens[i] for i in a] == text.split()
    (two, flags), (four, same) = short.arrays(), full.arrays()
    n = len(short.tokens)
    assert two.shape[1] == 2 and four.shape[1] == 4 and (two[:n] == four[:n, :2]).all() and (flags[:n] == same[:n]).all()
    assert (four[:n, 0] == 0).tolist() == [t == "--" for t in short.tokens] and (four[:n, 2] != 0).tolist() == [t != "--" for t in short.tokens]


def test_words_of_letters_are_the_patterns_matches():
    """F: every piece was searched by the pattern; and a task held the results of a whole batch at once, not of one chunk."""
    import pyarrow as pa
    import public_tokenizers

    from volspark.llm import bpe

    split = bpe.splitter(public_tokenizers.PATTERN)
    letters = [c for c in map(chr, [*range(0xD800), *range(0xE000, 0x110000)]) if c.isalpha()]
    runs = ["".join(letters[i : i + 500]) for i in range(0, len(letters), 500)]
    for piece in [*runs, *(" " + r + "," for r in runs), "a", "a.", " a", " a?", " .", ".", " ", "  ab", "ab's", "'s.", " 's,", "ab.,", "a1.", " ab\n", "", "ab:"]:
        assert bpe.words_of(piece, split) == [w.encode() for w in split(piece)], piece
    texts = [("word%d, " % i).encode() * 300_000 for i in range(6)]
    batch = pa.record_batch([pa.array(range(6)), pa.array(texts, pa.binary())], ["doc_id", "text"])
    out = list(bpe._encode(iter([batch]), bpe.VOCABULARY))
    assert len(out) > 1 and [x for o in out for x in o.column(0).to_pylist()] == list(range(6)) and [x for o in out for x in o.column(3).to_pylist()] == texts
