"""Answers worked out by hand for eight events."""

from datetime import date

import pytest
from golden import ids
from pyspark.sql import functions as F

from eventlens import (
    Filter, analytics, apply_filters, compare, data_keys, data_values, decode_data, gauge, label_values,
    matching_events, retained, search_events, search_page, search_total, timeseries, topn,
)
from eventlens.functions.predicates import value_text


def pairs(df, *columns):
    return [tuple(row[c] for c in columns) for row in df.collect()]


def utc(df, column="bucket"):
    return df.withColumn(column, F.date_format(column, "MM-dd HH:mm"))


@pytest.mark.parametrize("aggregation, field, expected", [
    ("count", None, 8), ("sum", "data.latency", 1060), ("avg", "data.latency", 265),
    ("min", "data.latency", 10), ("max", "data.latency", 1000),
    ("p50", "data.latency", 25), ("p90", "data.latency", 709), ("p95", "data.latency", 854.5),
    ("p99", "data.latency", 970.9), ("count_unique", "user_id", 4), ("count_unique", "data.path", 4),
])
def test_gauge(golden, aggregation, field, expected):
    (row,) = gauge(golden, aggregation=aggregation, field=field).collect()
    assert row.asDict().keys() == {"value"}
    assert isinstance(row["value"], float)
    assert row["value"] == pytest.approx(expected, abs=1e-9)


@pytest.mark.parametrize("aggregation", ["sum", "avg", "min", "max", "p50", "p99", "count_unique", "count"])
@pytest.mark.parametrize("approx", [False, True])
def test_gauge_of_nothing_is_one_zero(golden, aggregation, approx):
    found = gauge(golden, aggregation=aggregation, field="data.latency", filters={"service": "none"}, approx=approx)
    assert pairs(found, "value") == [(0.0,)]


@pytest.mark.parametrize("aggregation, expected", [("p50", 20), ("p99", 1000), ("count_unique", 4)])
def test_approx(golden, aggregation, expected):
    field = "user_id" if aggregation == "count_unique" else "data.latency"
    assert pairs(gauge(golden, aggregation=aggregation, field=field, approx=True), "value") == [(expected,)]


def test_default_order_is_ascending(golden):
    assert pairs(analytics(golden, group_by=["service"]), "group_0", "value") == [("job", 1), ("web", 3), ("api", 4)]


def test_groups_without_numbers_give_zero(golden):
    for aggregation, api in [("sum", 1060), ("p50", 25)]:
        found = analytics(golden, aggregation=aggregation, field="data.latency", group_by="service", order_by="service")
        assert pairs(found, "group_0", "value") == [("api", api), ("job", 0), ("web", 0)]


def test_group_by_data_key(golden):
    found = analytics(golden, group_by=["data.path"], order_by="data.path")
    assert pairs(found, "group_0", "value") == [("", 2), ("/a", 3), ("/b", 2), ("/c", 1)]


def test_order_and_limit(golden):
    found = analytics(golden, group_by=["service", "env"], order_by="env", descending=True, limit=2)
    assert pairs(found, "group_0", "group_1", "value") == [("web", "staging", 2), ("api", "prod", 4)]
    unknown = analytics(golden, group_by="service", order_by="nonsense", descending=True, limit=1)
    assert pairs(unknown, "group_0") == [("api",)]
    assert analytics(golden, group_by="trace_id").count() == 8
    for bad in (0, -5, 2.5, True):
        with pytest.raises(ValueError):
            analytics(golden, group_by="service", limit=bad)


def test_groups_as_map(golden):
    found = analytics(golden, group_by=["service", "data.ok"], groups_as_map=True, limit=1)
    assert pairs(found, "groups", "value") == [({"service": "job", "data.ok": "true"}, 1)]


FILTERS = [
    ({"data.latency__gt": 15}, [2, 3, 8]), ({"data.latency__gt": "15"}, [2, 3, 8]),
    ({"data.latency__lte": 20}, [1, 2]), ({"data.latency__lt": 20}, [1]), ({"data.latency__gte": 30}, [3, 8]),
    ({"data.latency": 40}, [5]), ({"data.latency": "40"}, [5]), ({"data.status": 200}, [1, 2]),
    ({"data.ok": True}, [7]), ({"data.ok__neq": "true"}, [1, 2, 3, 4, 5, 6, 8]),
    ({"data.path__neq": "/a"}, [2, 5, 6, 7, 8]), ({"data.path__in": ["/b", "/c"]}, [2, 5, 8]),
    ({"data.path__in": ["", "/c"]}, [5, 6, 7]), ({"data.path": ""}, [6, 7]),
    ({"data.path__contains": "b"}, [2, 8]), ({"data.path__startswith": "/"}, [1, 2, 3, 4, 5, 8]),
    ({"data.status__endswith": "0"}, [1, 2, 3]), ({"data.tag__contains": "x"}, [8]),
    ({"level__in": "error,warn"}, [3, 7, 8]), ({"level__in": ["error"]}, [3, 8]),
    ({"name__contains": "."}, [1, 2, 3, 4, 5, 7, 8]), ({"name__contains": "r_l"}, [6]),
    ({"name__contains": "p_r"}, [1, 2, 3, 8]), ({"name__contains": "r\\_l"}, [6]), ({"name__contains": "p\\_r"}, []),
    ({"name__contains": "h\\t"}, []), ({"name__contains": ""}, [1, 2, 3, 4, 5, 6, 7, 8]),
    ({"name__startswith": "http"}, [1, 2, 3, 8]), ({"name__endswith": ".view"}, [4, 5]),
    ({"service__lt": "job"}, [1, 2, 3, 8]), ({"service__lte": "job"}, [1, 2, 3, 7, 8]),
    ({"service__gt": "job"}, [4, 5, 6]), ({"service__gte": "job"}, [4, 5, 6, 7]),
    ({"user_id__neq": "u1"}, [2, 4, 5, 6, 7, 8]), ({"env": ""}, [7]), ({"service__eq": "web"}, [4, 5, 6]),
    ({"service": "api", "level": "error"}, [3, 8]),
    ([("service", "eq", "api"), Filter("data.status", "gte", 500)], [3, 8]),
    ([{"field": "service", "operator": "", "value": "web"}, {"field": "env", "value": "prod"}], [4]),
    ({}, [1, 2, 3, 4, 5, 6, 7, 8]),
]


@pytest.mark.parametrize("spec, expected", FILTERS, ids=[str(f[0]) for f in FILTERS])
def test_filters(golden, spec, expected):
    assert sorted(ids(apply_filters(golden, spec))) == expected


@pytest.mark.parametrize("spec, expected", FILTERS, ids=[str(f[0]) for f in FILTERS])
def test_a_missing_string_reads_as_empty(golden, spec, expected):
    absent = golden.select(*[
        F.when(F.col(c) != "", F.col(c)).alias(c) if c in ("env", "user_id") else F.col(c) for c in golden.columns
    ])
    assert sorted(ids(matching_events(absent, filters=spec))) == expected


@pytest.mark.parametrize("bounds, expected", [
    (dict(start="2026-02-01T00:00:00Z", end="2026-02-02T00:00:00Z"), [2, 3, 4, 5]),
    (dict(start="2026-02-07T23:59:00Z"), [7, 8]),
    (dict(end="2026-02-01T01:30:00+01:00"), [1, 2, 3]),
    (dict(end=1769904000), [1, 2]), (dict(end="1769904000"), [1, 2]),
    (dict(start="", end=None), [1, 2, 3, 4, 5, 6, 7, 8]),
])
def test_time_bounds_are_inclusive(golden, bounds, expected):
    assert sorted(ids(apply_filters(golden, None, **bounds))) == expected
    dated = golden.withColumn("event_date", F.to_date("timestamp"))
    assert sorted(ids(apply_filters(dated, None, **bounds))) == expected
    local = golden.withColumn("timestamp", F.col("timestamp").cast("timestamp_ntz"))
    assert sorted(ids(apply_filters(local, None, **bounds))) == expected


@pytest.mark.parametrize("interval, expected", [
    ("day", [("01-31 00:00", 1), ("02-01 00:00", 3), ("02-02 00:00", 2), ("02-07 00:00", 1), ("02-08 00:00", 1)]),
    ("week", [("01-25 00:00", 1), ("02-01 00:00", 6), ("02-08 00:00", 1)]),
    ("month", [("01-01 00:00", 1), ("02-01 00:00", 7)]),
])
def test_buckets(golden, interval, expected):
    assert pairs(utc(timeseries(golden, interval=interval)), "bucket", "value") == expected


def test_minute_and_hour_buckets(golden):
    day = dict(start="2026-02-01T00:00:00Z", end="2026-02-01T23:59:59Z")
    minutes = utc(timeseries(golden, interval="minute", **day))
    assert pairs(minutes, "bucket", "value") == [("02-01 00:00", 1), ("02-01 00:30", 1), ("02-01 02:15", 1)]
    hours = utc(timeseries(golden, **day))
    assert pairs(hours, "bucket", "value") == [("02-01 00:00", 2), ("02-01 02:00", 1)]


MORNING = dict(start="2026-02-01T00:00:00Z", end="2026-02-01T03:00:00Z", interval="hour", fill_zeros=True)


def test_zero_fill(golden):
    found = timeseries(golden, **MORNING)
    assert pairs(utc(found), "bucket", "name", "value") == [
        ("02-01 00:00", "", 2), ("02-01 01:00", "", 0), ("02-01 02:00", "", 1), ("02-01 03:00", "", 0)]
    by_service = timeseries(golden, group_by="service", **MORNING).orderBy("group_0", "bucket")
    assert pairs(by_service, "group_0", "name", "value") == [
        *[("api", "api", v) for v in (2, 0, 0, 0)], *[("web", "web", v) for v in (0, 0, 1, 0)]]


@pytest.mark.parametrize("aggregation, field", [("count", None), ("p95", "data.latency"), ("count_unique", "user_id")])
def test_zero_fill_of_nothing(golden, aggregation, field):
    none = dict(filters={"service": "none"}, aggregation=aggregation, field=field, **MORNING)
    assert pairs(timeseries(golden, **none), "name", "value") == [("", 0)] * 4
    keyed = timeseries(golden, group_by=["service", "data.path"], **none)
    assert pairs(keyed, "group_0", "group_1", "name", "value") == [(None, None, "", 0)] * 4


def test_fill_needs_both_bounds(golden):
    found = timeseries(golden, interval="day", fill_zeros=True, start="2026-02-02T00:00:00Z")
    assert found.count() == 3
    assert timeseries(golden, filters={"service": "none"}, fill_zeros=True).count() == 0


def test_fill_of_a_reversed_range_is_empty(golden):
    backwards = dict(interval="hour", fill_zeros=True, start="2026-02-02T00:00:00Z", end="2026-02-01T00:00:00Z")
    assert timeseries(golden, **backwards).count() == 0
    assert timeseries(golden, group_by="service", **backwards).count() == 0


@pytest.mark.parametrize("interval, days", [("week", ["01-25", "02-01", "02-08"]), ("month", ["01-01", "02-01"])])
def test_fill_of_calendar_steps(golden, interval, days):
    found = timeseries(golden, interval=interval, group_by="service", fill_zeros=True,
                       start="2026-01-31T12:00:00Z", end="2026-02-10T00:00:00Z")
    found = found.filter(F.col("group_0") == "job").withColumn("bucket", F.date_format("bucket", "MM-dd"))
    assert pairs(found, "bucket") == [(d,) for d in days]
    assert sum(v for (v,) in pairs(found, "value")) == 1


def test_nested_series(golden):
    (api, web) = timeseries(golden, group_by="service", nested=True, **MORNING).collect()
    assert (api["name"], api["group_0"], web["name"]) == ("api", "api", "web")
    assert [p["value"] for p in api["data_points"]] == [2, 0, 0, 0]
    (only,) = timeseries(golden, nested=True, **MORNING).collect()
    assert only["name"] == "" and [p["value"] for p in only["data_points"]] == [2, 0, 1, 0]
    assert timeseries(golden, nested=True, filters={"service": "none"}, start="2026-02-01T00:00:00Z", end="2026-02-02T00:00:00Z").count() == 0


def test_groups_stay_apart_when_names_coincide(golden):
    odd = golden.withColumn("service", F.when(F.col("service") == "api", "a|b").otherwise("a")).withColumn(
        "env", F.when(F.col("service") == "a", "b|c").otherwise("c"))
    found = timeseries(odd, interval="month", group_by=["service", "env"], start="2026-02-01T00:00:00Z")
    assert pairs(found, "group_0", "group_1", "name") == [("a", "b|c", "a|b|c"), ("a|b", "c", "a|b|c")]


DAY = dict(start="2026-02-01T00:00:00Z", end="2026-02-02T00:00:00Z")


def test_compare(golden):
    columns = ["current", "previous", "change", "change_percent"]
    found = compare(golden, **DAY)
    assert found.columns == columns
    assert pairs(found, *columns) == [(4, 2, 2, 100)]
    zero = compare(golden, aggregation="sum", field="data.latency", compare_start="2020-01-01T00:00:00Z",
                   compare_end="2020-01-02T00:00:00Z", **DAY)
    assert pairs(zero, *columns) == [(50, 0, 50, 0)]
    one_bound = compare(golden, compare_start="2020-01-01T00:00:00Z", **DAY)
    assert pairs(one_bound, *columns) == [(4, 2, 2, 100)]
    overlap = compare(golden, aggregation="p50", field="data.latency", compare_start="2026-01-01T00:00:00Z",
                      compare_end="2026-03-01T00:00:00Z", **DAY)
    assert pairs(overlap, "current", "previous") == [(25, 25)]


def test_topn(golden):
    assert pairs(topn(golden, group_by="data.path", limit=2), "key", "value") == [("/a", 3), ("", 2)]
    assert pairs(topn(golden, group_by="service"), "key") == [("api",), ("web",), ("job",)]


def test_search(golden):
    page = search_page(golden, limit=3, offset=2)
    assert ids(page.events) == [6, 5, 4]
    assert (page.total, page.next_offset, page.prev_offset) == (8, 5, 0)
    last = search_page(golden, limit=5000, offset=4)
    assert (last.limit, last.next_offset, last.prev_offset) == (5000, None, 0)
    first = search_page(golden, filters={"service": "api"})
    assert (first.total, first.prev_offset, ids(first.events)) == (4, None, [8, 3, 2, 1])
    assert pairs(search_total(golden, filters={"level": "error"}), "total") == [(2,)]


def test_pages_join_up_to_the_whole_list(golden):
    pages = [ids(search_events(golden, limit=3, offset=o)) for o in (0, 3, 6)]
    assert sum(pages, []) == [8, 7, 6, 5, 4, 3, 2, 1]


def test_decoded_data(golden):
    found = decode_data(golden).select("trace_id", F.schema_of_variant("data").alias("kind"))
    kinds = {int(r["trace_id"][-12:]): r["kind"] for r in found.collect()}
    assert kinds[6] is None and kinds[4] == "OBJECT<path: STRING>"
    assert search_events(golden, decode=True).schema["data"].dataType.typeName() == "variant"


def test_label_values(golden):
    assert pairs(label_values(golden, "env"), "value") == [("prod",), ("staging",)]
    assert pairs(label_values(golden, "user_id"), "value") == [("u1",), ("u2",), ("u3",)]
    own = label_values(golden, "service", filters={"service": "web", "level": "error"})
    assert pairs(own, "value") == [("api",)]


def test_data_keys_and_values(golden):
    assert pairs(data_keys(golden), "key") == [("latency",), ("n%",), ("ok",), ("path",), ("status",), ("tag",)]
    assert pairs(data_values(golden, "path"), "value") == [("/a",), ("/b",), ("/c",)]
    texts = [("10",), ("1000.0",), ("20",), ("30",), ("40",)]
    assert pairs(data_values(golden, "latency"), "value") == texts
    assert pairs(data_values(golden, "tag"), "value") == [('{"x":1}',)]
    assert pairs(data_values(golden, "n%"), "value") == [("1",)]


@pytest.mark.parametrize("key", ["a.b", "a'b", "a?b", "*", "a b", "a[0]", 'a"b', "ä"])
def test_data_values_of_odd_keys(golden, key):
    import json

    odd = golden.withColumn("data", F.lit(json.dumps({key: "v", "a": {"b": "nested"}}, ensure_ascii=False)))
    assert pairs(data_values(odd, key), "value") == [("v",)]


def test_retention(golden):
    assert sorted(ids(retained(golden, date(2026, 3, 5)))) == [7, 8]


@pytest.mark.parametrize("call", [
    lambda df: gauge(df, aggregation="sum", field="service"),
    lambda df: gauge(df, aggregation="sum"),
    lambda df: gauge(df, aggregation="p95"),
    lambda df: gauge(df, aggregation="count_unique"),
    lambda df: gauge(df, aggregation="median", field="data.x"),
    lambda df: gauge(df, aggregation="count_unique", field="nope"),
    lambda df: gauge(df, aggregation="sum", field="data.a-b"),
    lambda df: gauge(df, filters={"nope": 1}),
    lambda df: gauge(df, filters={"data.a-b": 1}),
    lambda df: gauge(df, filters=[("service", "like", "x")]),
    lambda df: gauge(df, filters=[("service", "in", "x")]),
    lambda df: gauge(df, filters=[("service", "in", [])]),
    lambda df: gauge(df, filters=[("data.latency", "gt", "fast")]),
    lambda df: gauge(df, filters=[("service", "eq", None)]),
    lambda df: gauge(df, start="yesterday"),
    lambda df: gauge(df, start="2026-02-01"),
    lambda df: search_events(df, limit=0),
    lambda df: search_events(df, offset=-1),
    lambda df: topn(df, group_by="service", limit=-1),
    lambda df: label_values(df, "service", limit=0),
    lambda df: timeseries(df, group_by="service", nested=True),
    lambda df: analytics(df, group_by=["timestamp"]),
    lambda df: topn(df, group_by="data.a b"),
    lambda df: topn(df, group_by=""),
    lambda df: label_values(df, "trace_id"),
    lambda df: data_values(df, ""),
    lambda df: timeseries(df, interval="year"),
    lambda df: timeseries(df, interval="minute", start="2026-01-01T00:00:00Z", end="2026-01-08T00:00:00Z",
                          fill_zeros=True, most_buckets=10_000),
    lambda df: compare(df, start="2026-01-01T00:00:00Z", end=None),
])
def test_refused_requests(golden, call):
    with pytest.raises(ValueError):
        call(golden)


def test_unknown_suffix_belongs_to_the_field(golden):
    with pytest.raises(ValueError, match="service__like"):
        apply_filters(golden, {"service__like": "x"})
    nested = golden.withColumn("data", F.lit('{"a__b": 3}'))
    assert apply_filters(nested, {"data.a__b__gt": 2}).count() == 8
    assert apply_filters(nested, {"data.a__b": 3}).count() == 8


@pytest.mark.parametrize("value, text", [
    (42.0, "42"), (-0.5, "-0.5"), (1e20, "1" + "0" * 20), (1e21, "1e+21"), (0.0001, "0.0001"), (0.00001, "1e-05"), (0.0, "0"),
    (True, "true"), (7, "7"), (-2.5e-7, "-2.5e-07"),
])
def test_values_as_text(value, text):
    assert value_text(value) == text


def test_nothing_is_cut_unasked(spark):
    rows = spark.range(12_000).selectExpr(
        "timestamp_seconds(1767225600 + id) AS timestamp", "concat('s', id) AS service", "'e' AS env", "'' AS job_id",
        "'' AS request_id", "'' AS trace_id", "'' AS user_id", "'n' AS name", "'i' AS level",
        "concat('{\"k', id, '\":', id, '}') AS data")
    assert analytics(rows, group_by="service").count() == 12_000
    assert analytics(rows, group_by="service", limit=11_000).count() == 11_000
    assert topn(rows, group_by="service", limit=5000).count() == 5000
    assert search_events(rows, limit=5000).count() == 5000
    assert label_values(rows, "service").count() == 12_000
    assert data_keys(rows).count() == 12_000
    assert analytics(rows, group_by=["service", "env", "name", "level"] * 3, limit=1).count() == 1
    assert timeseries(rows, interval="day", start="2020-01-01T00:00:00Z", end="2026-12-31T00:00:00Z").count() == 1


def test_the_last_of_two_equal_keys_counts(golden):
    doubled = golden.withColumn("data", F.lit('{"k":1,"k":2}'))
    assert apply_filters(doubled, {"data.k": 2}).count() == 8
    assert apply_filters(doubled, {"data.k__gt": 1.5}).count() == 8
    assert pairs(analytics(doubled, group_by="data.k"), "group_0", "value") == [("2", 8.0)]
