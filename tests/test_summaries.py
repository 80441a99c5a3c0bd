"""Summaries by hour: the same rows as from events, whatever is late, cut, stale or not in them."""

from datetime import date

import pytest
from golden import trace
from pyspark.sql import functions as F

from eventlens import (
    Summary, analytics, data_keys, data_values, days_to_publish, days_to_summarise, drop_expired, fresh_days, label_values,
    publish_days, read_live, summarise_days, summary_analytics, summary_data_keys, summary_data_values,
    summary_label_values, summary_timeseries, timeseries, write_batch,
)

DAYS = [date(2026, 2, d) for d in (1, 2, 3)]


def lines(spark, rows):
    form = ('{{"timestamp":"2026-02-{:02d}T{:02d}:{:02d}:07.5Z","service":"{}","name":"{}","user_id":"{}","level":"info",'
            '"trace_id":"{}","data":{}}}')
    return spark.createDataFrame(
        [(form.format(d, h, m, s, n, u, trace(k), data),) for k, (d, h, m, s, n, u, data) in enumerate(rows)], "value string")


def events_of(first, n, day=None):
    return [(day or 1 + i % 3, i * 5 % 24, i * 7 % 60, f"s{i % 4}", f"n{i % 3}", f"u{i % 11}" if i % 5 else "",
             '{"x": %d, "e": "/%d"%s}' % (i % 17, i % 6, ', "only_%d": null' % (i % 2) if i % 4 == 0 else ""))
            for i in range(first, first + n)]


@pytest.fixture(scope="module")
def summary(spark):
    import tempfile

    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    summary = Summary(f"{folder}/landing", f"{folder}/table", f"{folder}/summary",
                      group_by=("service", "name", "data.e"), numbers=("data.x",), distinct=("user_id",))
    land(spark, summary, 0, events_of(0, 300))
    return summary


def land(spark, summary, batch, rows):
    write_batch(lines(spark, rows), batch, summary.landing, summary.path + "-quarantine", "s")


def rows(df):
    return [tuple(r) for r in df.collect()]


REQUESTS = [
    dict(group_by=["name", "service"], order_by="name"),
    dict(group_by="data.e", aggregation="sum", field="data.x", descending=True, limit=4),
    dict(aggregation="avg", field="data.x", group_by="service", filters={"name__in": "n1,n2"}),
    dict(aggregation="min", field="data.x", start="2026-02-01T05:30:00Z", end="2026-02-03T05:06:59Z"),
    dict(aggregation="max", field="data.x", group_by="name", start="2026-02-02T05:00:00Z", end="2026-02-02T05:59:59.999Z"),
    dict(aggregation="count_unique", field="data.e", group_by="name", start="2026-02-02T00:00:00Z"),
    dict(aggregation="count_unique", field="user_id", group_by="name"),  # from events
    dict(aggregation="p90", field="data.x", group_by="name"),  # from events
    dict(group_by="user_id", filters={"data.x__gt": 3}),  # from events
    dict(filters={"service": "no_such"}),
    dict(start="2026-02-01T05:10:00Z", end="2026-02-01T05:20:00Z"),
]
SERIES = [
    dict(interval="hour", group_by="service"), dict(interval="minute"),
    dict(interval="week", aggregation="sum", field="data.x", group_by="data.e"),
    dict(interval="day", aggregation="avg", field="data.x", fill_zeros=True, start="2026-01-30T10:00:00Z",
         end="2026-02-02T10:06:00Z"),
    dict(interval="hour", group_by="name", fill_zeros=True, nested=True, start="2026-02-02T01:01:00Z",
         end="2026-02-02T09:00:00Z"),
]


def check(spark, summary):
    live = read_live(spark, summary.landing, summary.table).cache()
    for request in REQUESTS:
        assert rows(summary_analytics(spark, summary, **request)) == rows(analytics(live, **request)), request
    for request in SERIES:
        assert rows(summary_timeseries(spark, summary, **request)) == rows(timeseries(live, **request)), request
    late = dict(start="2026-02-01T07:08:00Z", filters={"name__neq": "n0"})
    assert rows(summary_label_values(spark, summary, "service", **late)) == rows(label_values(live, "service", **late))
    assert rows(summary_label_values(spark, summary, "user_id")) == rows(label_values(live, "user_id"))
    assert rows(summary_data_keys(spark, summary, **late)) == rows(data_keys(live, **late))
    assert rows(summary_data_values(spark, summary, "e", **late)) == rows(data_values(live, "e", **late))
    assert rows(summary_data_values(spark, summary, "x")) == rows(data_values(live, "x"))
    live.unpersist()


def test_from_landing_to_late_rows(spark, summary):
    assert fresh_days(spark, summary) == days_to_summarise(spark, summary) == []
    assert rows(summary_analytics(spark, summary)) == [(300.0,)]  # nothing is published
    publish_days(spark, summary.landing, summary.table, DAYS[0], DAYS[2])
    assert days_to_summarise(spark, summary) == DAYS and fresh_days(spark, summary) == []
    summarise_days(spark, summary, DAYS[0], DAYS[2])
    assert days_to_summarise(spark, summary) == [] and fresh_days(spark, summary) == DAYS
    check(spark, summary)
    # no event is read for whole hours, and none of other days for those that are cut
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "trace_id" not in plan(summary_analytics(spark, summary, group_by="service"))
    found = summary_analytics(spark, summary, start="2026-02-02T00:00:00Z", end="2026-02-03T09:59:59.999Z")
    assert not any("/table/" in f for f in found.inputFiles())
    # late rows: their day is stale, the others are not
    land(spark, summary, 1, events_of(300, 40, day=2))
    assert fresh_days(spark, summary) == [DAYS[0], DAYS[2]]
    assert rows(summary_analytics(spark, summary)) == [(340.0,)]
    check(spark, summary)
    # published and not summarised
    publish_days(spark, summary.landing, summary.table, DAYS[1], DAYS[1])
    assert days_to_publish(spark, summary.landing, summary.table) == []
    assert days_to_summarise(spark, summary) == [DAYS[1]]
    assert rows(summary_analytics(spark, summary)) == [(340.0,)]
    summarise_days(spark, summary, DAYS[1], DAYS[1])
    assert fresh_days(spark, summary) == DAYS
    assert rows(summary_analytics(spark, summary)) == [(340.0,)]
    # expired days are in no answer
    drop_expired(spark, summary.table, date(2026, 3, 3))
    assert rows(summary_timeseries(spark, summary, interval="day")) == rows(
        timeseries(read_live(spark, summary.landing, summary.table), interval="day"))
    assert fresh_days(spark, summary) == DAYS[1:]


def test_sketches(spark, folder):
    summary = Summary(f"{folder}/landing", f"{folder}/table", f"{folder}/summary", group_by=("service",),
                      numbers=("data.x",), distinct=("user_id",))
    land(spark, summary, 0, [
        (1 + i % 3, i % 24, 0, "a", "n", f"u{i % 5000}", '{"x": %d}' % (i * 7919 % 20011)) for i in range(20_000)])
    land(spark, summary, 1, [(1, 0, 0, "none", "n", "", '{"x": "text"}')])
    publish_days(spark, summary.landing, summary.table, DAYS[0], DAYS[2])
    summarise_days(spark, summary, DAYS[0], DAYS[2])
    live = read_live(spark, summary.landing, summary.table)
    number = F.try_variant_get(F.parse_json("data"), "$.x", "double")
    for name, fraction in (("p50", 0.5), ("p99", 0.99)):
        found = dict(rows(summary_analytics(
            spark, summary, aggregation=name, field="data.x", group_by="service", approx=True)))
        assert found["none"] == 0.0
        share = live.where("service = 'a'").agg(F.avg((number <= found["a"]).cast("double"))).first()[0]
        assert abs(share - fraction) <= 0.004
    found = dict(rows(summary_analytics(
        spark, summary, aggregation="count_unique", field="user_id", group_by="service", approx=True)))
    assert found["none"] == 1 and abs(found["a"] / 5000 - 1) < 0.03
