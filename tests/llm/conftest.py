import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
LABELS = "doc_id long, quality int, toxic int"


def words(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice("alpha beta gamma delta river stone cloud Mountain summer winter table garden window paper silver letter".split()) + str(rng.randrange(60)) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, an empty text, a long text and repeated rows."""
    rng = random.Random(7)
    passage = words(rng, 90)
    out = [(i, words(rng, rng.choice([1, 3, 30, 120, 300])), "en", "web", 0) for i in range(60)]
    base = words(rng, 400)
    near = base.split()
    near[200] = "changed"
    out += [(60, base, "de", "a", 0), (61, base, "de", "a", 0), (62, " ".join(near), "de", None, 0)]
    out += [(63, f"one {passage} two", "en", "b", 0), (64, f"Three. {passage} four", "en", "b", 0), (65, passage + " ü€ " + passage, None, "b", 0)]
    out += [(66, None, None, None, None), (67, "", "en", "web", 0), (68, " \t\n ", "en", "web", 0), (69, "aa" * 500, "fr", "c", 0)]
    out += [(70, words(rng, 20_000), "en", "c", 0), (71, "<|endoftext|> naïve  日本語\n\ntext ▁ 123456 ", "ja", "c", 0)]
    out += [out[5], (None, words(rng, 50), "en", "web", 0)]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    # names that the operators use inside
    return df.withColumns({c: F.lit(1) for c in ("fp", "h", "word", "g", "start", "score", "key")})


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
