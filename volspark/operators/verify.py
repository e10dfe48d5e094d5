"""Verdicts over benchmark records (environment, backend, case_id, task, rep, secs, hash)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["environment", "case_id", "task"]


def identical_runs(runs: DataFrame) -> DataFrame:
    return runs.groupBy(*KEY).agg(F.count("*").alias("n"), (F.min("hash") == F.max("hash")).alias("identical"))


def mean_of_later(runs: DataFrame, reps: list[int]) -> DataFrame:
    """(KEY, mean, n): mean seconds of some repetitions, summed as decimals so that their order does not count."""
    total = F.sum(F.col("secs").cast("decimal(18,6)")).cast("double")
    return runs.where(F.col("rep").isin(reps)).groupBy(*KEY).agg((total / F.count("*")).alias("mean"), F.count("*").alias("n"))


def path() -> Column:
    """Which record a run is held against: cpu for all that ran there in the end."""
    return F.when(F.col("backend").startswith("cpu"), "cpu").otherwise("webgpu")


def results(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """(KEY, n, compared, identical, verdict): all runs of a result that have a record must have its hash.

    expected (case_id, task, path, want). verdict: match, different, or no record if no run has one.
    """
    held = runs.withColumn("path", path()).join(expected, ["case_id", "task", "path"], "left")
    g = held.groupBy(*KEY).agg(F.count("*").alias("n"), F.count("want").alias("compared"), (F.min("hash") == F.max("hash")).alias("identical"), F.min(F.col("hash") == F.col("want")).alias("ok"))
    verdict = F.when(F.col("compared") == 0, "no record").when(F.col("ok"), "match").otherwise("different")
    return g.select(*KEY, "n", "compared", "identical", verdict.alias("verdict"))


def verdicts(runs: DataFrame, expected: DataFrame) -> DataFrame:
    """(environment, matches, different, no_record, not_identical)."""
    count = lambda c: F.sum(c.cast("long"))
    kinds = (("matches", "match"), ("different", "different"), ("no_record", "no record"))
    return results(runs, expected).groupBy("environment").agg(*[count(F.col("verdict") == v).alias(n) for n, v in kinds], count(~F.col("identical")).alias("not_identical"))


def not_run(runs: DataFrame, expected: DataFrame, environment: str) -> DataFrame:
    return expected.join(runs.where(F.col("environment") == environment), ["case_id", "task"], "left_anti")
