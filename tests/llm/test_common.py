"""Connected components, by broadcast minima and by settled ones."""

import random

import pytest
from pyspark.sql import functions as F

from eventlens.llm import common


def roots(edges):
    root = {}

    def find(i):
        while root.setdefault(i, i) != i:
            i = root[i]
        return i

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


@pytest.mark.parametrize("most", [100_000, 0])
def test_components(spark, most):
    random.seed(most)
    edges = [(k, k + 1) for k in range(30)] + [(1000, 1000 + k) for k in range(1, 200)]
    edges += [(random.randrange(2000, 2400), random.randrange(2000, 2400)) for _ in range(180)]
    edges = [(a, b) for a, b in edges if a != b]
    found = common.components(spark.createDataFrame(edges, "a long, b long"), most).collect()
    assert len(found) == len({r["id"] for r in found})
    assert {r["id"]: r["root"] for r in found} == roots(edges)


def test_a_hub_is_split(spark):
    """The join with a settled minimum of an id that has most rows takes more than one task."""
    keep = {k: spark.conf.get(k) for k in (
        "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes")}
    try:
        for k, v in zip(keep, ("-1", "16k", "16k")):
            spark.conf.set(k, v)
        rows = spark.range(0, 200_000, 1, 8).select(
            F.when(F.col("id") % 5 > 0, 0).otherwise(F.col("id")).alias("x"), F.col("id").alias("y"))
        least = common.settle(rows.groupBy(F.col("x").alias("_x")).agg(F.min("y").alias("m")))
        joined = rows.join(least, F.col("x") == F.col("_x"))
        plan = joined._jdf.queryExecution().executedPlan()
        joined._jdf.queryExecution().toRdd().count()
        assert "skew=true" in plan.toString()
    finally:
        for k, v in keep.items():
            spark.conf.set(k, v)
