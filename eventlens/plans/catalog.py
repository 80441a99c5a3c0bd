"""The registered queries: each operator over the whole events table."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators.analytics import analytics, gauge, topn
from eventlens.operators.compare import compare
from eventlens.operators.search import (
    data_keys, data_values, label_values, matching_events, search_events, search_page, search_total,
)
from eventlens.operators.timeseries import timeseries
from eventlens.plans.adapter import sample_events
from eventlens.functions.settings import configure
from eventlens.plans.session import scratch_dir
from eventlens.schema import LABEL_COLUMNS
from eventlens.sources.ndjson import (
    accepted, event_line, ingest_counts, parse_lines, read_lines, to_lines,
)
from eventlens.sources.summaries import (
    DISTINCT_ERROR, RANK_ERROR, Summary, days_to_summarise, summarise_days, summary_analytics, summary_data_keys,
    summary_data_values, summary_label_values, summary_timeseries,
)
from eventlens.sources.table import (
    append_events, days_to_publish, drop_expired, publish_days, read_events, read_live, register_view, retained,
)
from eventlens.streaming.ingest import ingest_progress, start_ingest, stream_lines

Query = Callable[[SparkSession, str], DataFrame]

# One week, the week before it, and days the table has no events on.
WEEK = dict(start="2024-01-08T00:00:00Z", end="2024-01-14T23:59:59Z")
AS_OF = date(2024, 2, 10)

COLUMN_FILTERS = {
    "eq": {"service": "svc_1"}, "neq": {"level__neq": "info"}, "in": {"level__in": "error,debug"},
    "contains": {"name__contains": "i"}, "startswith": {"service__startswith": "svc"},
    "endswith": {"name__endswith": "_k"}, "lt": {"service__lt": "svc_2"}, "gt": {"name__gt": "error"},
    "lte": {"user_id__lte": "12"}, "gte": {"user_id__gte": "77"},
}
DATA_FILTERS = {
    "eq": {"data.k": 42}, "neq": {"data.endpoint__neq": "/e/1"}, "in": {"data.code__in": "300,400"},
    "contains": {"data.endpoint__contains": "e/"}, "startswith": {"data.code__startswith": "3"},
    "endswith": {"data.endpoint__endswith": "5"}, "lt": {"data.value__lt": 25}, "gt": {"data.value__gt": 100.5},
    "lte": {"data.k__lte": "9"}, "gte": {"data.k__gte": 90},
}


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Sums differ in the last bits with the order of addition; compare without those."""
    doubles = {f.name for f in df.schema.fields if f.dataType.typeName() == "double"}
    return df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns])


def _on_events(build: Callable[[DataFrame], DataFrame]) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(build(sample_events(configure(spark), sf_dir)))

    return query


def _run(operator, **arguments) -> Query:
    return _on_events(lambda events: operator(events, **arguments))


# -- ingest and table --------------------------------------------------------


def spoiled_lines(events: DataFrame) -> DataFrame:
    """Every event as a line; some kinds of event get one kind of fault each."""
    line, name, service, env = event_line(), F.col("name"), F.col("service"), F.col("env")
    staging = env == "staging"
    return events.select(
        F.when((name == "signup") & staging, F.substring(line, F.lit(1), F.length(line) - 1))
        .when((name == "signup") & (service == "svc_3"), F.lit(""))
        .when((name == "purchase") & staging, F.replace(line, F.concat(F.lit('"'), service, F.lit('"')), F.lit('""')))
        .when((name == "purchase") & (service == "svc_2"), F.replace(line, F.lit('"timestamp"'), F.lit('"time"')))
        .when((name == "view") & staging, F.replace(line, F.lit('"job_id":""'), F.lit('"job_id":"job_x"')))
        .when((name == "view") & (service == "svc_1"), F.replace(line, F.lit('"job_id":""'), F.lit('"job_id":7')))
        .when((name == "click") & staging, F.replace(line, F.lit("-4000-8000-"), F.lit("")))
        # a line feed behind an id or a time, as an escape of the JSON
        .when((name == "error") & staging, F.replace(line, F.lit('","user_id":'), F.lit('\\n","user_id":')))
        .when((name == "error") & (service == "svc_1"), F.replace(line, F.lit('Z","service":'), F.lit('Z\\n","service":')))
        .otherwise(line).alias("value")
    )


def _ingest_roundtrip(events: DataFrame) -> DataFrame:
    parsed = accepted(parse_lines(to_lines(events)))
    return parsed.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"),
        "service", "env", "job_id", "request_id", "trace_id", "user_id", "name", "level", "event_date",
        F.array_join(F.json_object_keys("data"), ",").alias("keys"),
        F.get_json_object("data", "$.k").cast("long").alias("k"),
        F.get_json_object("data", "$.value").cast("double").alias("number"),
        F.get_json_object("data", "$.code").alias("code"),
        F.coalesce(F.get_json_object("data", "$.endpoint"), F.lit("")).alias("endpoint"),
    )


def _rejects_by_reason(events: DataFrame) -> DataFrame:
    return ingest_counts(parse_lines(spoiled_lines(events)))


def _gzip(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    path = scratch_dir(spark) + "/lines"
    to_lines(events).write.option("compression", "gzip").text(path)
    return analytics(accepted(parse_lines(read_lines(spark, path))), group_by=["name", "level"])


def _ingest(events: DataFrame, folder: str, stream: str) -> tuple[str, str]:
    """Runs the events, some spoiled, through a stream with a source and a checkpoint of its own."""
    spark = events.sparkSession
    spoiled_lines(events).write.text(f"{folder}/{stream}/lines")
    landing, quarantine = f"{folder}/landing", f"{folder}/quarantine"
    lines = stream_lines(spark, f"{folder}/{stream}/lines", max_files=8)
    start_ingest(lines, landing, quarantine, f"{folder}/{stream}/checkpoint", available_now=True).awaitTermination()
    return landing, quarantine


def _stream(events: DataFrame) -> tuple[str, str]:
    return _ingest(events, scratch_dir(events.sparkSession), "only")


def _by_day(found: DataFrame) -> DataFrame:
    return found.groupBy("event_date", "service").agg(F.count(F.lit(1)).alias("events"))


def _two_streams(events: DataFrame) -> DataFrame:
    """Two services ingest into one landing dataset; both number their batches from 0."""
    folder = scratch_dir(events.sparkSession)
    for env in ("production", "staging"):
        landing, _ = _ingest(events.filter(F.col("env") == env), folder, env)
    return _by_day(read_events(events.sparkSession, landing))


def _new_checkpoint(events: DataFrame) -> DataFrame:
    """Half of the events, published; then the other half by a stream whose checkpoint is new."""
    spark = events.sparkSession
    folder, early = scratch_dir(spark), F.crc32("trace_id") % 2 == 0
    landing, _ = _ingest(events.filter(early), folder, "first")
    table = f"{folder}/table"
    _publish_open_days(spark, landing, table)
    _ingest(events.filter(~early), folder, "second")
    _publish_open_days(spark, landing, table)
    return _by_day(read_events(spark, table))


def _publish_open_days(spark: SparkSession, landing: str, table: str, **options) -> None:
    days = days_to_publish(spark, landing, table)
    if days:
        publish_days(spark, landing, table, days[0], days[-1], **options)


def _live_with_late_rows(events: DataFrame) -> DataFrame:
    """Events that land after their days were published are seen without publishing again."""
    spark = events.sparkSession
    folder, late = scratch_dir(spark), F.col("env") == "staging"
    landing, _ = _ingest(events.filter(~late), folder, "first")
    table = f"{folder}/table"
    _publish_open_days(spark, landing, table)
    _ingest(events.filter(late), folder, "late")
    return _by_day(read_live(spark, landing, table))


def _typed_events(events: DataFrame) -> DataFrame:
    """Live events with stored VARIANTs: some days published with them, some without, some rows not yet published."""
    spark = events.sparkSession
    folder, day = scratch_dir(spark), F.dayofmonth("timestamp")
    table = f"{folder}/table"
    for name, rows, options in (
        ("typed", day % 3 == 0, {"typed": True}), ("text", day % 3 == 1, {}), ("late", day % 3 == 2, None),
    ):
        landing, _ = _ingest(events.filter(rows), folder, name)
        if options is not None:
            _publish_open_days(spark, landing, table, **options)
    return read_live(spark, landing, table, typed=True)


def _typed_sums(events: DataFrame) -> DataFrame:
    return analytics(
        _typed_events(events), aggregation="sum", field="data.value", group_by=["data.endpoint", "data.code"],
        filters={"data.value__gt": 20, "data.code__neq": "300"}).withColumn("value", F.round("value", 6))


def _summary(events: DataFrame) -> Summary:
    """Most events landed, published and summarised by hour; then late ones on every other day."""
    spark = events.sparkSession
    folder, late = scratch_dir(spark), (F.col("service") == "svc_4") & (F.dayofmonth("timestamp") % 2 == 0)
    landing, _ = _ingest(events.filter(~late), folder, "first")
    summary = Summary(
        landing, f"{folder}/table", f"{folder}/summary", group_by=("service", "name", "level", "data.endpoint"),
        numbers=("data.value",), distinct=("user_id",))
    _publish_open_days(spark, landing, summary.table)
    days = days_to_summarise(spark, summary)
    if days:
        summarise_days(spark, summary, days[0], days[-1])
    _ingest(events.filter(late), folder, "late")
    return summary


def _summary_counts(events: DataFrame) -> DataFrame:
    """Bounds within an hour: the hours that they cut are read from events."""
    return summary_analytics(
        events.sparkSession, _summary(events), group_by=["service", "data.endpoint"], filters={"level__neq": "debug"},
        start="2024-01-08T00:30:00Z", end="2024-01-21T22:59:59Z")


def _summary_averages(events: DataFrame) -> DataFrame:
    return summary_analytics(
        events.sparkSession, _summary(events), aggregation="avg", field="data.value", group_by="name")


def _summary_sums_by_day(events: DataFrame) -> DataFrame:
    found = summary_timeseries(
        events.sparkSession, _summary(events), interval="day", aggregation="sum", field="data.value", group_by="service",
        **WEEK)
    return found.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def _summary_quantiles(events: DataFrame) -> DataFrame:
    """Whether the share of values up to a merged sketch's percentile is off by no more than its bound, one event aside."""
    spark, summary = events.sparkSession, _summary(events)
    found = summary_analytics(
        spark, summary, aggregation="p95", field="data.value", group_by="name", approx=True, order_by="name")
    value = F.try_variant_get(F.try_parse_json("data"), "$.value", "double")
    live = read_live(spark, summary.landing, summary.table).select("name", value.alias("x"))
    share = F.avg((F.col("x") <= F.col("value")).cast("double"))
    return live.join(F.broadcast(found), F.col("name") == F.col("group_0")).groupBy("name").agg(
        F.count("x").alias("numbers"),
        (F.abs(share - 0.95) <= RANK_ERROR + 1 / F.count("x")).alias("within"))


def _summary_distinct(events: DataFrame) -> DataFrame:
    """Whether merged sketches count users as exactly as four standard errors allow; a user of many days counts once."""
    spark, summary = events.sparkSession, _summary(events)
    request = dict(aggregation="count_unique", field="user_id", group_by="service")
    found = summary_analytics(spark, summary, approx=True, **request)
    exact = analytics(read_live(spark, summary.landing, summary.table), **request)
    return exact.select(F.col("group_0").alias("service"), F.col("value").alias("users")).join(
        F.broadcast(found), F.col("service") == F.col("group_0")
    ).select("service", "users", (F.abs(F.col("value") / F.col("users") - 1) <= 4 * DISTINCT_ERROR).alias("within"))


def _summary_discovery(events: DataFrame) -> DataFrame:
    spark, summary = events.sparkSession, _summary(events)
    request = dict(filters={"level__neq": "debug"}, start="2024-01-03T10:20:30Z")
    kinds = {
        "label": summary_label_values(spark, summary, "service", **request),
        "key": summary_data_keys(spark, summary, **request),
        "value": summary_data_values(spark, summary, "endpoint", **request),
    }
    named = [found.select(F.lit(kind).alias("kind"), F.col(found.columns[0]).alias("value")) for kind, found in kinds.items()]
    return named[0].unionAll(named[1]).unionAll(named[2])


def _retention_live(events: DataFrame) -> DataFrame:
    """Days that have expired from the table are not live, listed or published again, though they are in landing."""
    spark = events.sparkSession
    landing, _ = _stream(events)
    table = landing.replace("/landing", "/table")
    _publish_open_days(spark, landing, table)
    drop_expired(spark, table, AS_OF)
    _publish_open_days(spark, landing, table)
    return _by_day(read_live(spark, landing, table))


def _replayed_source(events: DataFrame) -> DataFrame:
    """The same files by a second stream, whose checkpoint is new: nothing lands twice."""
    spark = events.sparkSession
    folder = scratch_dir(spark)
    landing, quarantine = _ingest(events, folder, "first")
    lines = stream_lines(spark, f"{folder}/first/lines", max_files=3)
    start_ingest(lines, landing, quarantine, f"{folder}/second", available_now=True).awaitTermination()
    refused = spark.read.parquet(quarantine).groupBy(
        F.lit(None).cast("date").alias("event_date"), F.col("reject_reason").alias("service"))
    return _by_day(read_events(spark, landing)).unionAll(refused.agg(F.count(F.lit(1)).alias("events")))


def _stream_progress(events: DataFrame) -> DataFrame:
    """One environment's files have landed, the other's wait in the same folder."""
    spark = events.sparkSession
    folder, done = scratch_dir(spark), F.col("env") == "production"
    landing, _ = _ingest(events.filter(done), folder, "one")
    spoiled_lines(events.filter(~done)).write.mode("append").text(f"{folder}/one/lines")
    found = ingest_progress(spark, f"{folder}/one/lines", landing)
    return found.select("enqueued", "accepted", "refused", "pending")


def _stored_lookup(events: DataFrame) -> DataFrame:
    register_view(_evolved(events), "stored_events")
    return events.sparkSession.sql(
        "SELECT trace_id, env, name, user_id FROM stored_events WHERE user_id = '' AND"
        " trace_id = '00000000-0000-4000-8000-000000000007'")


def _stream_ingest(events: DataFrame) -> DataFrame:
    landing, _ = _stream(events)
    return _by_day(read_events(events.sparkSession, landing))


def _stream_quarantine(events: DataFrame) -> DataFrame:
    _, quarantine = _stream(events)
    refused = events.sparkSession.read.parquet(quarantine)
    return refused.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("lines"))


def _table(events: DataFrame) -> DataFrame:
    path = scratch_dir(events.sparkSession) + "/events"
    append_events(events, path)
    return read_events(events.sparkSession, path)


def _table_roundtrip(events: DataFrame) -> DataFrame:
    found = timeseries(_table(events), interval="day", group_by="service", **WEEK)
    return found.withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def _evolved(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    path = scratch_dir(spark) + "/events"
    ids = F.col("env") == "production"
    append_events(events.filter(ids), path)
    # Days written before the column existed: files without it in the same table.
    days = F.to_date("timestamp").alias("event_date")
    old = events.filter(~ids).drop("user_id").select("*", days)
    old.withColumn("timestamp", F.col("timestamp").cast("timestamp")).write.mode("append").partitionBy(
        "event_date"
    ).parquet(path)
    return read_events(spark, path)


def _schema_evolution(events: DataFrame) -> DataFrame:
    return analytics(_evolved(events), group_by=["env", "user_id"], order_by="env")


def _view_absent_column(events: DataFrame) -> DataFrame:
    register_view(_evolved(events), "evolved_events")
    return events.sparkSession.sql(
        "SELECT env, count(*) AS events FROM evolved_events WHERE user_id = '' GROUP BY env")


def _drop_expired(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    path = scratch_dir(spark) + "/events"
    append_events(events, path)
    drop_expired(spark, path, AS_OF)
    return read_events(spark, path).groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


def _insert_stamp(events: DataFrame) -> DataFrame:
    parsed = accepted(parse_lines(to_lines(events)))
    stamped = (F.col("_inserted_at") > F.col("timestamp")) & (
        F.col("_inserted_at") == F.date_trunc("MILLISECOND", "_inserted_at"))
    return parsed.agg(F.count(F.lit(1)).alias("events"), F.count(F.when(stamped, 1)).alias("stamped"))


def _page_positions(events: DataFrame) -> DataFrame:
    page = search_page(events, filters={"env": "production"}, limit=25, offset=40)
    return events.sparkSession.createDataFrame(
        [(page.total, page.next_offset, page.prev_offset)], "total long, next_offset long, prev_offset long")


def _publish(events: DataFrame) -> DataFrame:
    spark = events.sparkSession
    landing, _ = _stream(events)
    table = landing.replace("/landing", "/table")
    _publish_open_days(spark, landing, table)
    found = read_events(spark, table)
    return found.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("events"),
        F.min("timestamp").cast("timestamp_ntz").alias("first"),
        F.max("timestamp").cast("timestamp_ntz").alias("last"),
        F.count_distinct("trace_id").alias("traces"),
    )


def _sql_view(events: DataFrame) -> DataFrame:
    register_view(events, "monitoring_events")
    return events.sparkSession.sql(
        "SELECT * FROM monitoring_events WHERE trace_id = '00000000-0000-4000-8000-000000000007'"
        " AND timestamp >= TIMESTAMP_NTZ '2024-01-01 00:00:00'"
    )


def _sql_functions(events: DataFrame) -> DataFrame:
    """Analytics in SQL alone, over text that is parsed by the registered functions."""
    register_view(events, "function_events")
    found = events.sparkSession.sql(
        "SELECT CAST(event_bucket(timestamp, 'week') AS TIMESTAMP_NTZ) AS week, event_text(data, 'endpoint') AS endpoint,"
        " count(*) AS events, count(event_number(data, 'code')) AS quoted,"
        " event_value(sum(event_number(data, 'value'))) AS total,"
        " event_value(percentile(event_number(data, 'value'), 0.9)) AS high"
        " FROM function_events WHERE event_number(data, 'k') > 10 AND event_text(data, 'code') <> '300' GROUP BY ALL")
    return found.withColumns({c: F.round(c, 6) for c in ("total", "high")})


def _decoded_page(events: DataFrame) -> DataFrame:
    page = search_events(events, filters={"name": "error"}, limit=50, decode=True)
    return page.select(
        "timestamp", "trace_id",
        F.try_variant_get("data", "$.k", "long").alias("k"),
        F.try_variant_get("data", "$.value", "double").alias("number"),
        F.try_variant_get("data", "$.endpoint", "string").alias("endpoint"),
    )


def _search_after(events: DataFrame) -> DataFrame:
    """The page behind the first 40 rows, found by the last of them; the same as by an offset of 40."""
    wanted = dict(filters={"env": "production"})
    before = search_events(events, limit=40, **wanted).tail(1)
    return search_events(events, limit=25, after=before[0] if before else None, **wanted)


def _nested(events: DataFrame) -> DataFrame:
    series = timeseries(events, interval="day", group_by="name", fill_zeros=True, nested=True, **WEEK)
    return series.select(
        "name", "group_0", F.size("data_points").alias("points"),
        F.array_join(F.transform("data_points", lambda p: F.format_string(
            "%s=%s", F.date_format(p["timestamp"], "yyyy-MM-dd"), p["value"].cast("long"))), " ").alias("data_points"),
    )


def _groups_map(events: DataFrame) -> DataFrame:
    found = analytics(events, group_by=["service", "data.code"], order_by="service", groups_as_map=True)
    return found.select(
        F.col("groups")["service"].alias("service"), F.col("groups")["data.code"].alias("code"), "value"
    )


# -- the list ----------------------------------------------------------------


def _build() -> dict[str, Query]:
    q: dict[str, Query] = {}

    q["analytics_count_by_service"] = _run(analytics, group_by="service", descending=True)
    for name in ("sum", "avg", "min", "max"):
        q[f"analytics_{name}_by_service"] = _run(
            analytics, aggregation=name, field="data.value", group_by="service", descending=True)
    for name in ("p50", "p90", "p95", "p99"):
        q[f"analytics_{name}_by_name"] = _run(
            analytics, aggregation=name, field="data.value", group_by="name", descending=True)
    q["analytics_count_unique_users"] = _run(analytics, aggregation="count_unique", field="user_id", group_by="name")
    q["analytics_count_unique_data_key"] = _run(
        analytics, aggregation="count_unique", field="data.endpoint", group_by="service")
    q["analytics_multi_key"] = _run(
        analytics, group_by=["service", "env", "level"], order_by="service", limit=1000)
    q["analytics_data_key_groups"] = _run(analytics, group_by="data.endpoint", descending=True)
    q["analytics_quoted_number_sum"] = _run(
        analytics, aggregation="sum", field="data.code", group_by="service")
    q["analytics_quoted_number_p95"] = _run(
        analytics, aggregation="p95", field="data.code", group_by="service")
    q["analytics_default_order_limit"] = _run(analytics, group_by="user_id", limit=100)
    q["analytics_all_groups"] = _run(analytics, group_by=["user_id", "name", "env"])
    q["analytics_order_by_group_desc"] = _run(
        analytics, group_by=["name", "env"], order_by="env", descending=True, limit=7)
    q["analytics_groups_map"] = _on_events(_groups_map)

    for name, spec in COLUMN_FILTERS.items():
        q[f"filter_{name}_column"] = _run(matching_events, filters=spec)
    for name, spec in DATA_FILTERS.items():
        q[f"filter_{name}_data"] = _run(matching_events, filters=spec)
    q["filter_eq_data_float"] = _run(matching_events, filters={"data.k": 42.0})
    q["filter_conjunction_time_range"] = _run(
        matching_events, filters=[("service", "eq", "svc_1"), ("data.value", "gte", 50), ("level", "neq", "debug")],
        **WEEK)
    q["filter_spec"] = _run(
        matching_events, filters={"level__in": "error,debug", "data.value__gt": "100", "name__contains": "r"},
        start="1704672000", end="2024-01-15T01:59:59+02:00")

    for name in ("minute", "hour", "day", "week", "month"):
        q[f"timeseries_{name}"] = _run(timeseries, interval=name)
    q["timeseries_grouped"] = _run(
        timeseries, interval="day", aggregation="avg", field="data.value", group_by=["service", "data.code"])
    q["timeseries_p95_grouped"] = _run(
        timeseries, interval="day", aggregation="p95", field="data.value", group_by="name")
    q["timeseries_filled"] = _run(
        timeseries, interval="hour", filters={"name": "purchase", "service": "svc_3"}, fill_zeros=True, **WEEK)
    q["timeseries_filled_grouped"] = _run(
        timeseries, interval="hour", group_by=["service", "env"], fill_zeros=True, **WEEK)
    q["timeseries_filled_week"] = _run(
        timeseries, interval="week", group_by="name", aggregation="sum", field="data.k", fill_zeros=True,
        start="2023-12-01T00:00:00Z", end="2024-02-20T00:00:00Z")
    q["timeseries_filled_empty"] = _run(
        timeseries, interval="hour", group_by="service", filters={"service": "no_such"}, fill_zeros=True,
        start="2024-01-08T00:30:00Z", end="2024-01-08T06:00:00Z")
    q["timeseries_nested"] = _on_events(_nested)

    q["topn_name"] = _run(topn, group_by="name", limit=3)
    q["topn_data_endpoint"] = _run(topn, group_by="data.endpoint", aggregation="sum", field="data.value", limit=5)
    q["topn_p99_users"] = _run(topn, group_by="user_id", aggregation="p99", field="data.value")

    q["gauge_count_errors"] = _run(gauge, filters={"level": "error"}, **WEEK)
    q["gauge_p95_value"] = _run(gauge, aggregation="p95", field="data.value")
    q["gauge_unique_traces"] = _run(gauge, aggregation="count_unique", field="trace_id")
    q["gauge_empty"] = _run(gauge, aggregation="p50", field="data.value", filters={"service": "no_such"})
    q["compare_auto_period"] = _run(compare, **WEEK)
    q["compare_explicit_p95"] = _run(
        compare, aggregation="p95", field="data.value", compare_start="2024-01-01T00:00:00Z",
        compare_end="2024-01-10T12:00:00Z", **WEEK)
    q["compare_unique_users"] = _run(compare, aggregation="count_unique", field="user_id", **WEEK)
    q["compare_zero_previous"] = _run(
        compare, aggregation="sum", field="data.value", start="2024-01-01T00:00:00Z", end="2024-01-15T00:00:00Z")

    q["search_page"] = _run(search_events, filters={"env": "production"}, limit=25, offset=40)
    q["search_large_page"] = _run(search_events, filters={"env": "production"}, limit=5000)
    q["search_after"] = _on_events(_search_after)
    q["search_page_decoded"] = _on_events(_decoded_page)
    q["search_total"] = _run(search_total, filters={"level__neq": "info"}, **WEEK)
    for label in LABEL_COLUMNS:
        q[f"label_values_{label}"] = _run(label_values, label=label, filters={label: "x", "level__neq": "debug"})
    q["data_keys"] = _run(data_keys, filters={"service": "svc_1"})
    q["data_values_endpoint"] = _run(data_values, key="endpoint", filters={"level": "info"})

    q["ingest_roundtrip"] = _on_events(_ingest_roundtrip)
    q["ingest_rejects_by_reason"] = _on_events(_rejects_by_reason)
    q["ingest_gzip"] = _on_events(_gzip)
    q["stream_ingest_count"] = _on_events(_stream_ingest)
    q["stream_quarantine"] = _on_events(_stream_quarantine)
    q["table_roundtrip"] = _on_events(_table_roundtrip)
    q["table_schema_evolution"] = _on_events(_schema_evolution)
    q["table_publish_days"] = _on_events(_publish)
    q["stream_two_sources"] = _on_events(_two_streams)
    q["stream_new_checkpoint"] = _on_events(_new_checkpoint)
    q["live_with_late_rows"] = _on_events(_live_with_late_rows)
    q["retention_live"] = _on_events(_retention_live)
    q["stream_replayed_source"] = _on_events(_replayed_source)
    q["stream_progress"] = _on_events(_stream_progress)
    q["summary_counts"] = _on_events(_summary_counts)
    q["summary_averages"] = _on_events(_summary_averages)
    q["summary_sums_by_day"] = _on_events(_summary_sums_by_day)
    q["summary_quantiles"] = _on_events(_summary_quantiles)
    q["summary_distinct"] = _on_events(_summary_distinct)
    q["summary_discovery"] = _on_events(_summary_discovery)
    q["sql_view_stored_lookup"] = _on_events(_stored_lookup)
    q["sql_functions_by_week"] = _on_events(_sql_functions)
    q["typed_sums"] = _on_events(_typed_sums)
    q["ingest_insert_stamp"] = _on_events(_insert_stamp)
    q["retention_cutoff"] = _run(_retained_by_day)
    q["retention_drop"] = _on_events(_drop_expired)
    q["sql_view_absent_column"] = _on_events(_view_absent_column)
    q["search_page_positions"] = _on_events(_page_positions)
    q["sql_view_trace_lookup"] = _on_events(_sql_view)
    return q


def _retained_by_day(events: DataFrame) -> DataFrame:
    kept = retained(_table(events), AS_OF)
    return kept.groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))


QUERIES = _build()
