"""Partitions that go with the rows."""

from volspark.operators import building, labels
from volspark.plans import build  # noqa: F401
from volspark.plans.catalogue import QUERIES
from volspark.sources import fixtures as fx

SMALL = "/root/testdata/sf0.001"


def test_more_rows_get_more_partitions(spark, monkeypatch):
    df = spark.range(100).withColumnRenamed("id", "vol_id")
    assert labels.spread(df, 100, "vol_id") is df
    monkeypatch.setattr(labels, "PART", 10)
    assert labels.spread(df, 100, "vol_id").rdd.getNumPartitions() == 10


def test_many_slices_and_voxels(spark, monkeypatch):
    few = {q: sorted(map(str, QUERIES[q](spark, SMALL).collect())) for q in ("build_grids", "label_remap_merge")}
    monkeypatch.setattr(labels, "PART", 500)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" in plan(building.placed(fx.images(spark, SMALL)))
    assert "RepartitionByExpression" in plan(fx.labels(spark, SMALL))
    assert few == {q: sorted(map(str, QUERIES[q](spark, SMALL).collect())) for q in few}
