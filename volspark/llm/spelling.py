"""Words of a corpus with their rarer misspellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import ascii_lower, shared

#: What lies between words.
BETWEEN = "[^A-Za-zÀ-ÿ]+"
#: An edit touches two bigrams at most, so of any three of a word one is left alone.
RAREST = 3
#: Letters of a word's equal side from which few words share it.
STRONG = 6


def word_counts(docs: DataFrame, least_length: int = 7, least_count: int = 2, every: int = 31) -> DataFrame:
    """(word, n, size): maximal runs of letters in docs (doc_id, text), A to Z in lower case, of `least_length` code points and
    `least_count` occurrences or more; all documents count.

    A run loses a letter if its hash with the id is a multiple of `every`. Null texts have no words, a null id hashes as the
    empty one, repeated rows count each, other columns are ignored. Counts are partial sums before the shuffle, so a word
    that is everywhere is a row a task.
    """
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    runs = docs.select(doc.alias("doc"), F.explode(F.split(ascii_lower(F.coalesce(F.col("text").cast("string"), F.lit(""))), BETWEEN)).alias("run"))
    runs = runs.where(F.length("run") >= least_length).withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2))
    own = runs.select(F.when(F.col("h") % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return own.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count).withColumn("size", F.length("word"))


def rarest_bigrams(words: DataFrame) -> DataFrame:
    """(word, n, size, at): where the three bigrams of each word are that come first if all words' bigrams are ordered by how many
    there are, rare ones first, then by letters and place."""
    grams = words.select("word", "n", "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("at"))
    grams = grams.withColumn("gram", F.substr("word", F.col("at"), F.lit(2)))
    # two of the 90 letters that a word can have: 8,100 rows at most
    order = F.broadcast(grams.groupBy("gram").agg(F.count("*").alias("f")))
    ranked = grams.join(order, "gram").groupBy("word", "n", "size").agg(F.sort_array(F.collect_list(F.struct("f", "gram", "at"))).alias("g"))
    return ranked.select("word", "n", "size", F.explode(F.slice("g", 1, RAREST)).alias("g")).select("word", "n", "size", F.col("g.at").alias("at"))


def _keys(size: Column, at: Column, differ: int, behind: bool) -> Column:
    """Keys of a word's bigram under which it meets words that have an edit behind the bigram, or else before it. size and at are those of
    the shorter word of a pair whose sizes differ by 0 or 1; `word` may be either of the two.

    All on the bigram's side of the edit is equal. Where that side is short, what lies across is halved: the edit is in one
    half, so the other half is equal, too.
    """
    left = lambda n: F.substr("word", F.lit(1), n)
    right = lambda n: F.substr("word", F.length("word") - n + 1)
    key = lambda kind, *parts: F.xxhash64(F.lit(4 * kind + 2 * differ + behind), size, at, *parts)
    side = at + 1 if behind else size - at + 1
    own, other = (left, right) if behind else (right, left)
    near = F.floor((size - side) / 2).cast("int")
    return F.when(side >= STRONG, F.array(key(0, own(side)))).otherwise(F.array(key(1, own(side + near)), key(2, own(side), other(size - side - near))))


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): both directions of all pairs of words (word, n, size) that differ by one inserted, deleted or replaced
    code point; the words are distinct and have four letters or more.

    Two such words share a bigram that the edit leaves alone among the three rarest of each, in the same place if the edit is behind
    it, else moved by the difference in size. The join is on hashes of the bigram's place, the size and the part of the word
    that must then be equal; candidates are compared whole.
    """
    rare, at, size = rarest_bigrams(words), F.col("at"), F.col("size")
    keys = lambda less, moved: [_keys(size - less, at, less, True), _keys(size - less, at - moved, less, False)]
    shorter = rare.select(F.col("word").alias("a"), F.col("n").alias("na"), F.explode(F.concat(*keys(0, 0), *[_keys(size, at, 1, behind) for behind in (True, False)])).alias("k"))
    longer = rare.select(F.col("word").alias("b"), F.col("n").alias("nb"), F.explode(F.concat(*keys(0, 0), *keys(1, 1))).alias("k"))
    met = shorter.join(longer, "k").where((F.length("a") < F.length("b")) | (F.col("a") < F.col("b"))).where(F.levenshtein("a", "b", 1) == 1)
    pairs = met.select("a", "na", "b", "nb").distinct()
    both = F.array(F.struct(F.col("a").alias("word"), F.col("na").alias("n"), F.col("b").alias("near"), F.col("nb").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("nb").alias("n"), F.col("a").alias("near"), F.col("na").alias("near_n")))
    return pairs.select(F.inline(both))


def _last(links: DataFrame) -> DataFrame:
    """(word, root) of links (word, form): the last of the forms that follow from a word. A form has at least twice the count of its word,
    so a chain has at most 63 links and six doublings reach its end."""
    out = shared(links.select("word", F.col("form").alias("root")))
    for _ in range(6):
        onward = out.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        moved = shared(out.join(onward, "root", "left").select("word", "root", "onward"))
        out = moved.select("word", F.coalesce("onward", "root").alias("root"))
        if moved.where("onward is not null").isEmpty():
            break
    return out


def spelling_groups(docs: DataFrame, times: int = 10, **counting) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of docs (word_counts).

    form: the near word of most occurrences, of equal ones the first in code-point order, if they are `times` (2 or more) as many as the
    word's; else null. root: the end of the chain of forms, the word itself without one. No documents give no rows.
    """
    words = shared(word_counts(docs, **counting))
    best = F.min(F.struct((-F.col("near_n")).alias("m"), "near"))
    own = near_words(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("b"))
    enough = -F.col("b.m") >= times * F.col("n")
    own = shared(own.select("word", "n_near", F.when(enough, F.col("b.near")).alias("form"), F.when(enough, -F.col("b.m")).alias("form_n")))
    roots = _last(own.where("form is not null"))
    out = words.join(own, "word", "left").join(roots, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
