"""Operators that learn or walk a graph: rules and planted cases."""

import re
import zlib

import pytest

from volspark.llm import decontam, quality, toxicity, urlfilter

RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def plain(url):
    if url is None or "://" not in url:
        return "", "", None, None
    host, path = re.fullmatch(r"([^/?#]*)([^?#]*).*", url.split("://", 1)[1], re.S).groups()
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_urls(spark):
    urls = ["https://Example.COM/en/7a?x", "http://a.com/en/", "http://com/en/x", "http://xcom/en/x", "http://example.net/de/81", "http://net/de/", "http://b.org/es/1#f", "no scheme", None, "x://", "http://q?a://b/c", "http://b.org/es/1#f"]
    html = ['<a href="http://a.com/en/">', None, "", '<a href="//b.org/es/2">'] * 3
    pages = spark.createDataFrame([(i, u, h, "x") for i, (u, h) in enumerate(zip(urls, html, strict=True))], "page_id long, url string, html string, host string").drop("host")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(pages).collect()}
    for i, u in enumerate(urls):
        host, path, rule, verdict = plain(u)
        assert got[i][:3] == (host, path, rule)
        assert got[i][3] in ("allow", "block") and (verdict is None or got[i][3] == verdict)
    assert urlfilter.judge(pages.where("false")).count() == 0


def test_distrust_walks_back(spark):
    """A host that links to blocked hosts only is blocked, one that trusted hosts link to is not."""
    rows = [(i, "http://bad.org/es/1", "") for i in range(3)] + [(10, "http://feeder.io/x", '<a href="http://bad.org/es/1">')]
    rows += [(20, "http://good.net/de/1", '<a href="http://fine.io/">'), (21, "http://fine.io/y", "")]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "block", 1: "block", 2: "block", 10: "block", 20: "allow", 21: "allow"}


def test_distrust_of_a_popular_host(spark):
    """Who links only to a blocked host is blocked, however many others do; one link of ten does not block."""
    rows = [(0, "http://bad.org/es/1", "")] + [(i, f"http://feeder{i}.io/x", '<a href="http://bad.org/es/1">') for i in range(1, 31)]
    rows += [(50, "http://mixed.io/x", '<a href="http://bad.org/es/1">' + "".join(f'<a href="http://n{i}.io/">' for i in range(9)))]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert {v for i, v in got.items() if i < 50} == {"block"} and got[50] == "allow"


def test_distrust_of_partly_blocked_hosts(spark):
    """Hosts that the rules block in part give their other pages a verdict; the real table has some, and no links."""
    rows = [(i, f"http://most.org/es/{i}", "") for i in range(7)] + [(i, f"http://most.org/x/{i}", "") for i in range(7, 10)]
    rows += [(i, f"http://few.org/{'es' if i == 20 else 'x'}/{i}", "") for i in range(20, 30)]
    got = {r["page_id"]: r["verdict"] for r in urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == "block" for i in range(10)) and [i for i in range(20, 30) if got[i] == "block"] == [20]
    real = urlfilter.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet")).where("rule is null and host <> ''")
    assert real.where("verdict = 'block'").count() > 0 and real.where("host_distrust > 0").count() > 0


def test_leaks(spark, docs, empty):
    item = "A farmer in Holland sells 12 baskets with 30 red apples each to the traders of the market before noon"
    other = "A farmer in Belgium sells 47 baskets with 55 red apples each to the traders of the market before noon"
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (None, item, 0), (3, "", 0)], "item_id long, text string, doc_id int").drop("doc_id")
    texts = spark.createDataFrame([(100, f"before this. {item} after"), (101, f"x {other} y"), (102, "the traders of the market"), (103, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["item_id"], r["reparameterised"]) for r in decontam.find_leaks(texts, bench).collect()}
    assert got == {100: (1, False), 101: (1, True)}
    assert decontam.find_leaks(docs, bench).count() == 0
    assert decontam.find_leaks(empty, bench).count() == 0
    assert decontam.find_leaks(texts, bench.where("false")).count() == 0


def test_leaks_of_several_variants(spark):
    """Variants of one item in one document, and rows of one id, do not disturb each other; a form filled at random stays clean."""
    item = "Please count the {} apples that a quiet farmer will sell"
    form = "we put {} red apples beside {} green apples and then we ate"
    bench = spark.createDataFrame([(1, item.format(12)), (2, form.format(3, 3))], "item_id long, text string")
    texts = [(1, item.format(12) + ". " + item.format(13)), (2, f"1. {item.format(20)}. 2. {item.format(21)}."), (3, item.format(14)), (3, item.format(15)), (4, form.format(5, 7)), (5, form.format(5, 7) + ". " + form.format(3, 3))]
    got = {r["doc_id"]: (r["item_id"], r["coverage"]) for r in decontam.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), bench).collect()}
    assert {i: x[0] for i, x in got.items()} == {1: 1, 2: 1, 3: 1, 5: 2} and all(got[i][1] == 1 for i in (1, 2, 3, 5))


def test_leaks_of_short_and_dense_items(spark):
    """Exact copies of items that have no template window, or one that starts or is spelled otherwise in the document."""
    items = [(1, "What is the capital?"), (2, "12 13 14 15 16 17 18 19 20 21 22"), (3, "Apples grow on old trees here"), (4, "the river near Paris and the hills of London are old"), (5, "Why?"), (6, "Ask Anna Bert Carl Dora Emil Fritz Gustav Hans Ida")]
    texts = [(10, "he asked what is the capital? then left"), (20, "sum 12 13 14 15 16 17 18 19 20 21 22 up"), (21, "sum 12 13 14 15 16 99 18 19 20 21 22 up"), (30, "they say Apples grow on old trees here today"), (40, "by the river near paris and the hills of london are old things")]
    texts += [(50, "He left. Why? No word."), (51, "that is why it is"), (60, "then ask Anna Bert Carl Dora Emil Fritz Gustav Hans Ida"), (61, "then ask Anna Bert Carl Dora Emil Fritz Gustav Hans Otto"), (70, "what is a capital?")]
    got = decontam.find_leaks(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(10, 1), (20, 2), (30, 3), (40, 4), (50, 5), (60, 6)}
    assert all(r["coverage"] == 1 for r in got)


def crc(i, parts):
    return zlib.crc32(str(i).encode()) % parts


def accuracy(out, labels, column):
    got = out.join(labels, "doc_id").where(f"held_out and {column} is not null").selectExpr(f"avg(cast(predicted = {column} as double)) a", f"avg(cast({column} = 0 as double)) b").first()
    return got["a"], max(got["b"], 1 - got["b"])


@pytest.mark.parametrize("module, column, parts, held", [(toxicity, "toxic", 5, 0), (quality, "quality", 4, 2)])
def test_classifiers_on_held_out_rows(spark, module, column, parts, held):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = module.classify(d, labels).cache()
    assert out.count() == d.count() and not out.where("score < 0 or score > 1 or score is null").count()
    assert all(r["held_out"] == (crc(r["doc_id"], parts) == held) for r in out.collect())
    right, blind = accuracy(out, labels, column)
    assert right > blind, (column, right, blind)


def test_classifiers_without_rows(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for module in (toxicity, quality):
        assert module.classify(docs, none).count() == docs.count()
        assert module.classify(empty, none).count() == 0


def test_walk_against_power_iteration(spark):
    """Trust and distrust of a graph with cycles, against plain iteration in numpy."""
    import numpy as np

    rng = np.random.default_rng(9)
    n = 12
    paths = {0: "/es/", 1: "/es/", 2: "/de/", 3: "/de/"}
    hosts = [f"h{i}.{'org' if i < 2 else 'net'}" for i in range(n)]
    links = [[j for j in rng.permutation(n)[:3].tolist() if j != i] for i in range(n)]
    rows = [(i, f"http://{hosts[i]}{paths.get(i, '/x/')}1", "".join(f'<a href="http://{hosts[j]}/">' for j in links[i]), None) for i in range(n)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in urlfilter.judge(pages).collect()}
    a = np.zeros((n, n))
    for i, own in enumerate(links):
        a[i, own] = 1
    good, bad = (np.array([float(paths.get(i) == p) for i in range(n)]) for p in ("/de/", "/es/"))

    def share(seed, m):
        step = m / np.maximum(m.sum(1, keepdims=True), 1)
        out = []
        for s in (seed, np.ones(n)):
            total, x = np.zeros(n), s
            for _ in range(400):
                x = 0.85 * x @ step
                total += x
            out.append(total)
        return np.divide(out[0], out[1], out=np.zeros(n), where=out[1] > 0)

    free = 0.85 * (1 - good - bad)
    trust, distrust = good + free * share(good, a), bad + free * share(bad, a.T)
    assert np.allclose([got[i]["host_trust"] for i in range(n)], trust, atol=1e-3)
    assert np.allclose([got[i]["host_distrust"] for i in range(n)], distrust, atol=1e-3)
    with pytest.raises(RuntimeError, match="settle"):
        urlfilter.judge(pages, rounds=2)


def test_trees_against_plain_ones():
    """The flat arrays give what walking node by node gives, and the first split is the best of all cuts."""
    import numpy as np

    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = ((x[:, 1] > 0.3) ^ (rng.random(300) < 0.1)).astype(float)
    trees = quality.fit(x, y, rounds=5, depth=3)

    def walk(row):
        total = trees.base
        for at in trees.roots.tolist():
            while trees.left[at] != at:
                at = trees.left[at] if row[trees.feature[at]] <= trees.cut[at] else trees.right[at]
            total += trees.value[at]
        return total

    assert np.allclose(trees.margin(x), [walk(r) for r in x])
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))
    gain = lambda m: g[m].sum() ** 2 / (h[m].sum() + 1) + g[~m].sum() ** 2 / (h[~m].sum() + 1)
    best = max((gain(x[:, j] <= c), j) for j in range(4) for c in np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1]) if 3 <= h[x[:, j] <= c].sum() <= h.sum() - 3)
    assert best[1] == trees.feature[trees.roots[0]] == 1
    assert np.isclose(gain(x[:, 1] <= trees.cut[trees.roots[0]]), best[0])
