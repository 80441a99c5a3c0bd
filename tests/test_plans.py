"""What the executed plans must look like."""

import re

import pytest
from golden import trace
from pyspark.sql import functions as F

from eventlens import (
    CLUSTER, analytics, append_events, apply_filters, compare, gauge, matching_events, read_events, search_events, timeseries,
    topn,
)
from eventlens.functions.percentiles import exact_percentile
from eventlens.plans.adapter import sample_events

WEEK = dict(start="2024-01-08T00:00:00Z", end="2024-01-14T23:59:59Z")


@pytest.fixture(scope="module")
def table(spark):
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    import tempfile

    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/events"
    append_events(sample_events(spark, "/root/testdata/sf0.001"), path)
    yield read_events(spark, path)
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def plan(df):
    """The plan as it ran, with adaptive changes."""
    df.collect()
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.split("+- == Initial Plan ==")[0]


def scans(text):
    return re.findall(r"FileScan parquet.*", text)


OPERATIONS = {
    "analytics": lambda df: analytics(df, group_by=["service", "data.code"], filters={"level": "error"}, **WEEK),
    "percentile": lambda df: analytics(df, aggregation="p95", field="data.value", group_by="name", **WEEK),
    "unique": lambda df: analytics(df, aggregation="count_unique", field="user_id", group_by="name", **WEEK),
    "gauge": lambda df: gauge(df, aggregation="p50", field="data.value", **WEEK),
    "topn": lambda df: topn(df, group_by="user_id", **WEEK),
    "compare": lambda df: compare(df, aggregation="sum", field="data.value", **WEEK),
    "compare_unique": lambda df: compare(df, aggregation="count_unique", field="user_id", **WEEK),
    "filled": lambda df: timeseries(df, fill_zeros=True, **WEEK),
    "filled_grouped": lambda df: timeseries(df, group_by="name", fill_zeros=True, **WEEK),
    "filled_percentile": lambda df: timeseries(
        df, interval="day", group_by="name", aggregation="p99", field="data.value", fill_zeros=True, **WEEK),
    "search": lambda df: search_events(df, filters={"name": "error"}, limit=5, **WEEK),
}


@pytest.mark.parametrize("name", OPERATIONS)
def test_one_pruned_scan_and_no_python(table, name):
    text = plan(OPERATIONS[name](table))
    assert "Python" not in text and "Pandas" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    # A dropped branch may have held the scan: then the shuffle it filled is reused.
    found = scans(text)
    assert len(found) == 1 or (not found and "ReusedExchange" in text), text
    for scan in found:
        days = re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", scan).group(1)
        assert re.search(r"event_date#\d+ >= 2024-01-0[18]", days) and re.search(r"event_date#\d+ <= 2024-01-14", days)
        assert "(timestamp," in re.search(r"PushedFilters: \[(.*?)\], ReadSchema", scan).group(1)


def test_recommended_settings_exist_and_change_no_answer(spark, table):
    wanted = analytics(table, aggregation="p95", field="data.value", group_by="name").collect()
    before = {key: spark.conf.get(key) for key in CLUSTER}
    try:
        for key, value in CLUSTER.items():
            spark.conf.set(key, value if "partitions" not in key else "64")
        assert analytics(table, aggregation="p95", field="data.value", group_by="name").collect() == wanted
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def test_only_needed_columns_are_read(table):
    (scan,) = scans(plan(gauge(table, filters={"level": "error"})))
    assert "ReadSchema: struct<level:string>" in scan
    (scan,) = scans(plan(topn(table, group_by="name", aggregation="sum", field="data.value")))
    assert "ReadSchema: struct<name:string,data:string>" in scan


@pytest.mark.parametrize("spec, pushed", [
    ({"service": "svc_1"}, "EqualTo(service,svc_1)"),
    ({"level__in": "error,debug"}, "In(level, ["),
    ({"level__neq": "info"}, "Or(Not(EqualTo(level,info)),IsNull(level))"),
    ({"name__contains": "err"}, "StringContains(name,err)"),
    ({"name__startswith": "err"}, "StringStartsWith(name,err)"),
    ({"name__endswith": "or"}, "StringEndsWith(name,or)"),
    ({"user_id__gte": "5"}, "GreaterThanOrEqual(user_id,5)"),
    ({"user_id": ""}, "Or(EqualTo(user_id,),IsNull(user_id))"),
])
def test_column_filters_reach_the_scan(table, spec, pushed):
    (scan,) = scans(plan(matching_events(table, filters=spec)))
    assert pushed in scan


def test_top_rows_are_taken_without_a_full_sort(table):
    last = search_events(table, limit=20).tail(1)[0]
    for found in (topn(table, group_by="user_id"), analytics(table, group_by="user_id", limit=100),
                  search_events(table, offset=20), search_events(table, after=last)):
        text = plan(found)
        assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_aggregates_combine_before_the_shuffle(table):
    text = plan(analytics(table, group_by="service", aggregation="sum", field="data.value"))
    below = text[text.index("Exchange hashpartitioning"):]
    assert "partial_sum" in below
    # exact distinct counts are shuffled by group and value, not by group alone
    text = plan(analytics(table, group_by="service", aggregation="count_unique", field="user_id"))
    assert re.search(r"Exchange hashpartitioning\(group_0#\d+L?, coalesce\(user_id#\d+, \)#\d+,", text) or re.search(
        r"Exchange hashpartitioning\([^,]+, [^,]+(, [^,]+)?, \d+\)", text)


def test_a_page_behind_an_event_bounds_the_scan(table):
    last = search_events(table, limit=20).tail(1)[0]
    (scan,) = scans(plan(search_events(table, after=last)))
    assert "LessThanOrEqual(timestamp," in scan
    pages = [search_events(table, limit=20, offset=20), search_events(table, limit=20, after=last)]
    assert pages[0].collect() == pages[1].collect()


def test_percentiles_of_a_group_of_millions_spread_over_tasks(spark):
    """No operator holds a group: pairs are counted by group and value, and joined with slots."""
    rows = spark.range(2_000_000).select(
        F.struct(F.lit("hot").alias("k")).alias("_k"), (F.col("id") * 1.000001 + 1).alias("_num"))
    found = exact_percentile(rows, 0.95)
    text = plan(found)
    assert found.first()["value"] == pytest.approx(1_999_999 * 0.95 * 1.000001 + 1, rel=1e-12)
    assert "percentile(" not in text and re.search(r"hashpartitioning\(\[hot\]#\d+, _num#", text)
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_bloom_filters_skip_row_groups(spark, table):
    """The id columns carry bloom filters: a lookup of an absent id reads no rows."""
    def rows_read(value):
        found = apply_filters(table, {"trace_id": value})
        found.collect()
        metrics = found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
        return metrics.apply("numOutputRows").value()

    present, absent = rows_read(trace(7)), rows_read("00000000-0000-4000-8000-00000000007x")
    assert 0 < present < 1000
    assert absent < present


def test_data_is_parsed_once(table):
    found = analytics(
        table, filters={"data.code__in": "200,300,400", "data.value__gt": 5}, group_by=["data.endpoint", "data.code"],
        aggregation="sum", field="data.value")
    text = plan(found)
    assert text.count("parseJson(") == 1 and "get_json_object" not in text
    assert found.count() > 3
