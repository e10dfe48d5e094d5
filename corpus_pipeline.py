"""A corpus from raw documents to token ids: five stages, each over all rows that the one before kept.

Every stage takes (spark, docs, sf_dir). The first four return the columns of documents; rows with null ids or texts
pass through them, as do other columns under any names. The last returns the ids' digests for every document that is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volspark.llm import bpe, decontam, simhash, suffix, toxicity
from volspark.llm.common import shared, table

#: The column that holds all columns but doc_id and text while an operator runs.
REST = "__rest"


def _slim(docs: DataFrame) -> DataFrame:
    """doc_id and text, and all other columns in one, so that none of them can have a name that an operator uses."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", (F.struct(*rest) if rest else F.lit(0)).alias(REST))


def _full(slim: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of documents again."""
    return slim.select(*[F.col(c) if c in ("doc_id", "text") else F.col(REST).getField(c).alias(c) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is under 0.5; the machine learns from all labelled documents of sf_dir that are not held out."""
    machine = toxicity.learn(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    slim = _slim(docs)
    return _full(toxicity.score_toxicity(slim, machine, slim.columns).where("score < 0.5"), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each near-duplicate group, one row of it; texts without words are one group.

    Rows with a null id or text belong to no group and stay, all of them.
    """
    slim, whole = _slim(docs), F.col("doc_id").isNotNull() & F.col("text").isNotNull()
    return _full(simhash.one_of_each(slim.where(whole)).union(slim.where(~whole)), docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of repeated 400-byte strings; those with nothing left stay, empty."""
    out = suffix.remove_repeats(_slim(docs))
    text = F.when(F.col("n_removed") > 0, F.make_valid_utf8(F.col("kept").cast("string"))).otherwise(F.col("kept").cast("string"))
    return _full(out.withColumn("text", text), docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    slim = _slim(docs)
    leaks = decontam.find_leaks(slim.select("doc_id", "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("__leak")).distinct()
    return _full(slim.join(leaks, F.col("doc_id").cast("long") == F.col("__leak"), "left_anti"), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document."""
    return bpe.encode_digests(docs.select("doc_id", "text"))


STAGES = [("toxicity", drop_toxic), ("simhash", one_of_each_group), ("suffix", cut_repeats), ("decontamination", drop_leaks), ("bpe", encode)]

#: Learning, interval expansion and merge tables are beyond SQL. tests/llm replays the stages by plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Each stage's rows are cut off from the stages before, as operators read them more than once."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = shared(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
