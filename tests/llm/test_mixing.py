"""Targets and samples of the mix."""

import random

import pytest
from conftest import ODD
from pyspark.sql import functions as F

from eventlens.llm import mixing


def level(sizes, weights, most):
    """Targets by handing out what is left again and again."""
    target, left, open_ = {s: 0.0 for s in sizes}, float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        share = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_}
        left = 0.0
        for s in list(open_):
            target[s] += share[s]
            if target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                open_.discard(s)
    return target


@pytest.mark.parametrize("seed", range(6))
def test_targets(spark, seed):
    random.seed(seed)
    names = sorted(random.sample("abcdefghijklmnop", random.randint(1, 12))) + [None] * (seed % 2)
    sizes = {s: random.choice([0, 1, 5, 100, 1000, 10_000]) for s in names}
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    found = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    assert found == pytest.approx(level(sizes, weights, 3), abs=1e-6)


def test_many_sources_are_ranked_in_ranges(spark, monkeypatch):
    random.seed(7)
    sizes = {**{f"host{i}": random.choice([0, 1, 5, 100, 1000, 10_000]) for i in range(2000)}, None: 77}
    names = sorted(x for x in sizes if x) + [None]
    weights = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(3)
    dealt = []

    def settle(df, keep=mixing.settle):
        kept = keep(df)
        if "_range" in kept.columns:
            dealt.append([r["count"] for r in kept.groupBy("_range").count().collect()])
        return kept

    monkeypatch.setattr(mixing, "settle", settle)
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        found = {r["source"]: r["target"] for r in mixing.targets(sources).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found == pytest.approx(level(sizes, weights, 3), abs=1e-6)
    assert len(dealt) == 2 and all(sum(n) == 2001 and max(n) < 600 for n in dealt)


def test_mix_of_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    again = mixing.mix(docs.repartition(5)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    source = {r["doc_id"]: r["source"] for r in docs.select("doc_id", "source").collect()}
    for name in set(source.values()):
        own = [r for r in rows if source[r["doc_id"]] == name]
        assert sum(r["size"] for r in own) == own[0]["source_size"]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own) / 2 + 1
        expected = own[0]["target"] / own[0]["source_size"]
        assert all(int(expected) <= r["copies"] <= int(expected) + 1 for r in own if r["size"])
    assert all(r["taken"] == r["copies"] * r["size"] <= 3 * r["size"] for r in rows)
    out = mixing.mixed_rows(docs)
    assert out.columns == docs.columns
    counts = {r["doc_id"]: r["n"] for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {r["doc_id"]: r["copies"] for r in rows if r["copies"]}


def test_no_python_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for frame in (mixing.mix(docs), mixing.mixed_rows(docs)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_odd_rows(spark, odd, nothing):
    rows = mixing.mix(odd).collect()
    assert len(rows) == len(ODD)
    assert all(r["copies"] == 0 for r in rows if r["size"] == 0)
    assert sorted(r["size"] for r in rows) == sorted(len((x[1] or "").split()) for x in ODD)
    assert mixing.mixed_rows(odd).columns == odd.columns
    assert mixing.mix(nothing).count() == mixing.mixed_rows(nothing).count() == 0
    blank = odd.withColumn("text", F.lit(" "))
    assert {(r["target"], r["taken"]) for r in mixing.mix(blank).collect()} == {(0.0, 0)}
