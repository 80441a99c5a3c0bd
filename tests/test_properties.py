"""Relations that must hold whatever the data."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from eventlens import analytics, compare, gauge, timeseries
from eventlens.functions.percentiles import exact_percentile
from eventlens.plans.adapter import sample_events

SMALL = "/root/testdata/sf0.001"
MONTH = dict(start="2024-01-01T00:00:00Z", end="2024-01-30T23:59:59Z")
FEW = dict(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))


@pytest.fixture(scope="module")
def events(spark):
    return sample_events(spark, SMALL).cache()


def only(df):
    return df.first()["value"]


@pytest.mark.parametrize("interval, grid", [("hour", 720), ("day", 30), ("week", 5), ("month", 1)])
def test_fill_covers_grid_times_series_and_keeps_the_sum(events, interval, grid):
    found = timeseries(events, interval=interval, group_by=["service", "level"], fill_zeros=True, **MONTH)
    series = events.select("service", "level").distinct().count()
    assert found.count() == grid * series
    assert found.select("bucket", "group_0", "group_1").distinct().count() == grid * series
    assert only(found.agg(F.sum("value").alias("value"))) == only(gauge(events, **MONTH))


def test_filled_and_unfilled_agree_where_there_are_events(events):
    arguments = dict(interval="hour", group_by="name", aggregation="max", field="data.value", **MONTH)
    plain, filled = timeseries(events, **arguments), timeseries(events, fill_zeros=True, **arguments)
    assert plain.exceptAll(filled).count() == 0
    assert filled.exceptAll(plain).filter("value <> 0").count() == 0


def test_groups_add_up_to_the_gauge(events):
    whole = only(gauge(events, aggregation="sum", field="data.value"))
    parts = analytics(events, aggregation="sum", field="data.value", group_by=["user_id", "name"])
    assert only(parts.agg(F.sum("value").alias("value"))) == pytest.approx(whole)


@settings(**FEW)
@given(st.integers(0, 2_400_000), st.integers(0, 1_200_000), st.sampled_from(["count", "p90", "count_unique"]))
def test_compare_is_two_gauges(events, offset, length, aggregation):
    field = "user_id" if aggregation == "count_unique" else "data.value"
    start = datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=offset)
    end = start + timedelta(seconds=length)
    row = compare(events, start=start, end=end, aggregation=aggregation, field=field).first()
    asked = dict(aggregation=aggregation, field=field)
    assert row["current"] == pytest.approx(only(gauge(events, start=start, end=end, **asked)))
    assert row["previous"] == pytest.approx(only(gauge(events, start=start - (end - start), end=start, **asked)))
    assert row["change"] == row["current"] - row["previous"]


doubles = st.one_of(
    st.floats(allow_nan=False, allow_infinity=False, width=64),
    st.floats(-1000, 1000), st.sampled_from([0.0, -0.0, 5e-324, -5e-324, 1.0, 1.0000000001, 1e300, -1e300]))


@settings(**FEW)
@given(
    st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), doubles)), min_size=1, max_size=60),
    st.sampled_from([0.5, 0.9, 0.95, 0.99]))
def test_percentiles_are_exact(spark, drawn, fraction):
    rows = spark.createDataFrame(drawn, "k string, _num double").select(F.struct("k").alias("_k"), "_num")
    found = {r["k"]: r["value"] for r in exact_percentile(rows, fraction).select("_k.k", "value").collect()}
    assert found.keys() == {k for k, _ in drawn}
    for key, value in found.items():
        numbers = sorted(n for k, n in drawn if k == key and n is not None)
        if not numbers:
            assert value is None
            continue
        position = (len(numbers) - 1) * fraction
        low, high = numbers[math.floor(position)], numbers[math.ceil(position)]
        share = position - math.floor(position)
        assert value == pytest.approx(low * (1 - share) + high * share, rel=1e-9)


def test_percentiles_do_not_overflow(spark):
    rows = spark.createDataFrame([(-1.7e308,), (1.7e308,)], "_num double").select(
        F.struct(F.lit("one").alias("k")).alias("_k"), "_num")
    assert exact_percentile(rows, 0.5).first()["value"] == 0.0


@pytest.mark.parametrize("shape", ["normal", "lognormal", "ties", "hot"])
def test_percentiles_of_large_groups(spark, shape):
    random = np.random.default_rng(7)
    size = 50_000
    values = {
        "normal": lambda: random.normal(100, 0.01, size),
        "lognormal": lambda: random.lognormal(0, 8, size),
        "ties": lambda: random.integers(0, 3, size).astype(float),
        "hot": lambda: np.where(random.random(size) < 0.4, 7.0, random.normal(0, 1, size)),
    }[shape]()
    rows = spark.createDataFrame([(float(v),) for v in values], "_num double").select(
        F.struct(F.lit("one").alias("k")).alias("_k"), "_num")
    for fraction in (0.5, 0.99):
        found = exact_percentile(rows, fraction).first()["value"]
        assert found == pytest.approx(float(np.quantile(values, fraction)), rel=1e-12)
