"""Stages of the corpus pipeline on planted rows."""

import hashlib
import random

from test_exact import fingerprint, groups, removed
from test_toxicity import planted, scores

import corpus_pipeline
from volspark.llm import bpe, toxicity


def test_no_labels_keep_everything(spark, docs, tmp_path):
    """Labels that teach nothing drop no document."""
    docs = docs.select("doc_id", "text", "lang")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for toxic, n in ((1, 0), (1, 40), (0, 40)):
        labels = spark.createDataFrame([(i, 1, toxic) for i in range(n)], "doc_id long, quality int, toxic int")
        labels.write.mode("overwrite").parquet(str(tmp_path / "labels.parquet"))
        assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == docs.count(), (toxic, n)


def test_one_of_each_group(spark):
    """Repeated ids with different texts, and null ids and texts."""
    a, b, c, d = (" ".join(f"{w}{i}" for i in range(40)) for w in ("river", "stone", "cloud", "paper"))
    rows = [(1, a), (1, a), (1, b), (2, b), (3, c), (2, c), (None, d), (None, c), (None, d), (4, None), (5, None), (6, ""), (7, " \n")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string").repartition(3)
    got = sorted(((r["doc_id"], r["text"]) for r in corpus_pipeline.one_of_each_group(spark, docs, "").collect()), key=repr)
    assert got == sorted([(1, a), (1, b), (2, c), (None, d), (None, c), (None, d), (4, None), (5, None), (6, "")], key=repr)


def test_one_row_of_one_id(spark):
    """Different near copies under one id in one group leave one row."""
    words = [f"w{i}" for i in range(600)]
    docs = spark.createDataFrame([(1, " ".join(words)), (1, " ".join([*words[:-1], "W599"]))], "doc_id long, text string")
    assert corpus_pipeline.one_of_each_group(spark, docs, "").count() == 1


def test_replay(spark, rows, tmp_path):
    """All five stages by plain code on rows with copies, near copies, shared passages, a leak, nulls and repeated ids."""
    import public_tokenizers
    import tiktoken

    texts, marks = planted(90)
    item = "the quiet harbour keeps seven wooden boats beside a lantern that nobody has lit since winter"
    rng = random.Random(1)
    more = [(1000 + i, t, "en", "x", 0) for i, t in enumerate(texts)]
    more += [(2000, f"so {item} indeed " + " ".join(rng.choice("ab cd ef gh".split()) + str(rng.randrange(99)) for _ in range(80)), "en", "x", 0), (5, "another text under an id that is taken", "en", "x", 0)]
    docs = spark.createDataFrame(rows + more, "doc_id long, text string, lang string, source string, n_chars int").repartition(3)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + i, 1, int(y)) for i, y in enumerate(marks)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = sorted((tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()), key=repr)

    left = [(r[0], r[1]) for r in rows + more]
    machine = toxicity.learn(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    left = [r for r, s in zip(left, scores(machine, [r[1] or "" for r in left]), strict=True) if s < 0.5]
    assert sum(r[0] is not None and 1000 <= r[0] < 2000 for r in left) == 60  # the toxic third is gone

    whole = [r for r in left if r[0] is not None and r[1] is not None]
    root = groups({fingerprint(r[1]) for r in whole})
    first = {}
    for r in whole:
        own = root[fingerprint(r[1])]
        if own not in first or r[0] < first[own][0]:
            first[own] = r
    left = [*first.values(), *(r for r in left if r[0] is None or r[1] is None)]

    cut = removed([(r[1] or "").encode() for r in left], 400)
    left = [(r[0], c[3].decode("utf-8", "replace")) for r, c in zip(left, cut, strict=True)]
    left = [r for r in left if item not in r[1]]
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(bpe.VOCABULARY), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(r[0], len(ids := enc.encode_ordinary(r[1])), sha(",".join(map(str, ids)).encode()), sha(r[1].encode())) for r in left]
    assert got == sorted(want, key=repr)


def test_columns_of_any_names(spark, docs, tmp_path):
    """Extra columns with names that operators use inside pass through all stages."""
    from pyspark.sql import functions as F

    names = ("score", "kept", "n_bytes", "n_removed", "n_spans", "__text", "fp", "row", "__row", "leak", "item_id", "a.b", "component_id")
    few = docs.select("doc_id", "text").limit(30).withColumns({c: F.lit(c) for c in names})
    few.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "what is the capital of the country that lies between the two rivers")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, few, str(tmp_path))
        assert out.columns == few.columns, name
        for r in out.collect():
            assert [r[c] for c in names] == list(names), name
    assert corpus_pipeline.STAGES[-1][1](spark, few, str(tmp_path)).count() == few.count()


def test_links_with_a_url_inside(spark):
    """A relative link that carries another url is no link to that host."""
    from volspark.llm import urlfilter

    html = '<a href="/r?u=http://bad.org/es/1">a</a><a href="https://good.com/x?u=http://bad.org/">b</a><a href="//third.net/p">c</a><a href="q//bad.org">d</a>'
    pages = spark.createDataFrame([("own.io", html)], "host string, html string")
    assert sorted((r["src"], r["dst"]) for r in urlfilter.host_edges(pages).collect()) == [("own.io", "good.com"), ("own.io", "third.net")]
