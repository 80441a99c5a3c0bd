"""Summaries of the events table by hour, kept by day beside it, and requests answered from them.

A summary has two datasets in daily ``event_date`` partitions: ``groups`` with a row for each hour and group, which holds
what the aggregates need and what merges (counts, sums, extremes, KLL sketches of numbers, HLL sketches of texts), and
``keys`` with a row for each hour, group and top-level key of ``data``. ``batches``, written last, names the batches that
a day's rows were made from. A day is *fresh* while that list is the published one and nothing of the day waits
in landing. Requests take whole hours of fresh days from the summary, and everything else (other days, hours that a time
bound cuts) from live events by the same aggregation; so late rows are in every answer at once, and summarising a day
anew only makes it cheaper. What a summary cannot answer is answered from events as a whole.

Counts, extremes and distinct values are exact; sums are too, but for the order of additions. With ``approx``, percentiles
have a rank error of at most ``RANK_ERROR`` and distinct counts a relative standard error of ``DISTINCT_ERROR``.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.functions.aggregates import check_aggregation
from eventlens.functions.buckets import bucket_start, check_interval
from eventlens.functions.fields import data_key, number_field, text_field
from eventlens.functions.predicates import (
    apply_filters, as_filters, filtered, parse_time, predicate, time_literal,
)
from eventlens.operators.analytics import analytics, limited, ordered
from eventlens.operators.search import data_keys, data_values, label_values
from eventlens.operators.timeseries import arranged, timeseries
from eventlens.schema import LABEL_COLUMNS, PERCENTILES
from eventlens.sources import table as stored

#: Size of a KLL sketch, and the rank error that its authors give for it (99 % confidence).
KLL_SIZE, RANK_ERROR = 800, 0.004
#: log2 of the registers of an HLL sketch, and its relative standard error.
HLL_LOG, DISTINCT_ERROR = 14, 0.0081
GROUPS, KEYS, BATCHES = "groups", "keys", "batches"


@dataclass(frozen=True)
class Summary:
    """Where a summary is kept, of which table, and what it holds.

    ``group_by`` are text columns or ``data.<key>``; ``numbers`` are ``data.<key>`` with sums, extremes and quantiles;
    ``distinct`` are fields whose values are counted. A summary has as many rows as there are hours and
    groups: fields of many values belong into ``distinct``."""

    landing: str
    table: str
    path: str
    group_by: tuple[str, ...]
    numbers: tuple[str, ...] = ()
    distinct: tuple[str, ...] = ()


def _name(field: str) -> str:
    """The column of a summary that holds a group field."""
    key = data_key(field)
    return field if key is None else f"data_{key}"


def _groups(events: DataFrame, summary: Summary) -> DataFrame:
    """Events as rows of ``groups``."""
    rows = filtered(events, fields=[*summary.group_by, *summary.numbers, *summary.distinct]).select(
        "event_date", F.date_trunc("hour", "timestamp").alias("hour"),
        *[text_field(f).alias(_name(f)) for f in summary.group_by],
        *[number_field(f).alias(f"x_{i}") for i, f in enumerate(summary.numbers)],
        # sketches leave out empty texts, which are values here
        *[F.concat(F.lit("="), text_field(f)).alias(f"t_{i}") for i, f in enumerate(summary.distinct)],
    )
    partials = [F.count(F.lit(1)).alias("events")]
    for i in range(len(summary.numbers)):
        x = F.col(f"x_{i}")
        partials += [
            F.count(x).alias(f"n_{i}"), F.sum(x).alias(f"sum_{i}"), F.min(x).alias(f"min_{i}"), F.max(x).alias(f"max_{i}"),
            F.kll_sketch_agg_double(x, KLL_SIZE).alias(f"quantiles_{i}"),
        ]
    partials += [F.hll_sketch_agg(f"t_{i}", HLL_LOG).alias(f"distinct_{i}") for i in range(len(summary.distinct))]
    return rows.groupBy("event_date", "hour", *map(_name, summary.group_by)).agg(*partials)


def _keys(events: DataFrame, summary: Summary) -> DataFrame:
    """Events as rows of ``keys``."""
    rows = filtered(events, fields=summary.group_by).select(
        "event_date", F.date_trunc("hour", "timestamp").alias("hour"),
        *[text_field(f).alias(_name(f)) for f in summary.group_by], F.explode(F.json_object_keys("data")).alias("key"))
    return rows.groupBy("event_date", "hour", *map(_name, summary.group_by), "key").agg(F.count(F.lit(1)).alias("events"))


# -- keeping it ----------------------------------------------------------------------


def _listed(spark: SparkSession, summary: Summary) -> DataFrame:
    lists = stored.read_or_none(spark, stored.PUBLISHED_SCHEMA, f"{summary.path}/{BATCHES}")
    return lists.select("event_date", *stored.BATCH_COLUMNS)


def _differing(spark: SparkSession, summary: Summary) -> DataFrame:
    """Days (``event_date``) on which the summary is not of what is live."""
    on = ["event_date", *stored.BATCH_COLUMNS]
    own, published = _listed(spark, summary), stored._published(spark, summary.table)
    return (
        own.join(published, on, "left_anti").select("event_date")
        .unionAll(published.join(own, on, "left_anti").select("event_date"))
        .unionAll(stored._missing(spark, summary.landing, summary.table).select("event_date"))
    )


def _kept(spark: SparkSession, summary: Summary, df: DataFrame) -> DataFrame:
    return stored._kept(spark, df, summary.table, summary.landing)


def fresh_days(spark: SparkSession, summary: Summary) -> list[date]:
    """Days that are answered from the summary. The driver gets days, no events."""
    own = _listed(spark, summary).select("event_date").distinct()
    return stored._days_of(_kept(spark, summary, own.join(_differing(spark, summary), "event_date", "left_anti")))


def days_to_summarise(spark: SparkSession, summary: Summary) -> list[date]:
    """Published days whose summary is absent or of other batches; a day that waits for publication is none."""
    on = ["event_date", *stored.BATCH_COLUMNS]
    own, published = _listed(spark, summary), stored._published(spark, summary.table)
    stale = published.join(own, on, "left_anti").select("event_date").unionAll(
        own.join(published, on, "left_anti").join(published, "event_date", "left_semi").select("event_date"))
    return stored._days_of(_kept(spark, summary, stale))


def _replace(rows: DataFrame, path: str) -> None:
    (
        rows.hint("rebalance", "event_date").sortWithinPartitions("event_date", "hour").write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(path)
    )


def summarise_days(spark: SparkSession, summary: Summary, first: date, last: date) -> None:
    """Make the summary of the published days from ``first`` to ``last`` anew, replacing theirs. The list of batches is
    read before the events and written last, so a day that is published again meanwhile, or a run that breaks
    off, leaves the day stale and no wrong answer. A job for each call and dataset, each of one scan."""
    published = stored.read_or_none(spark, stored.PUBLISHED_SCHEMA, f"{summary.table}/{stored.PUBLISHED}")
    lists = _kept(spark, summary, published.where(stored._between(first, last))).persist()
    try:
        days = stored._days_of(lists)
        if not days:
            return
        events = stored.read_events(spark, summary.table, first, last).where(F.col("event_date").isin(days))
        _replace(_groups(events, summary), f"{summary.path}/{GROUPS}")
        _replace(_keys(events, summary), f"{summary.path}/{KEYS}")
        (
            lists.select("events", *stored.BATCH_COLUMNS, "event_date").repartition("event_date").write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy("event_date").parquet(f"{summary.path}/{BATCHES}")
        )
    finally:
        lists.unpersist()


# -- reading it ----------------------------------------------------------------------


def _hour(moment: datetime) -> datetime:
    return moment.replace(minute=0, second=0, microsecond=0)


def _rows(spark: SparkSession, summary: Summary, kind: str, filters, start, end) -> DataFrame:
    """Rows of ``kind`` for the events that filters on group columns and time bounds leave: of whole hours of fresh days
    as they are kept, of all others made from live events. Events are only opened where there is such a day."""
    make = _groups if kind == GROUPS else _keys
    lower, upper = parse_time(start), parse_time(end)
    # times are whole milliseconds, so an hour ends a millisecond before the next
    from_hour = None if lower is None else _hour(lower + timedelta(hours=1) - timedelta(microseconds=1))
    to_hour = None if upper is None else _hour(upper + timedelta(milliseconds=1))
    first, last = lower and lower.date(), upper and upper.date()
    fresh = [d for d in fresh_days(spark, summary) if (first is None or d >= first) and (last is None or d <= last)]
    cut = {d for d, whole, bound in ((first, from_hour, lower), (last, to_hour, upper and upper + timedelta(milliseconds=1)))
           if d is not None and whole != bound}

    live = stored._published(spark, summary.table).select("event_date").unionAll(
        stored.read_batches(spark, summary.landing).select("event_date"))
    live = stored._days_of(_kept(spark, summary, live.where(stored._between(first, last))))
    from_events = [d for d in live if d not in fresh or d in cut]

    def kept_hours(hour: Column) -> Column:
        found = F.lit(True)
        if from_hour is not None:
            found = found & (hour >= time_literal(from_hour, False))
        return found & (hour < time_literal(to_hour, False)) if to_hour is not None else found

    parts = []
    if fresh:
        rows = spark.read.parquet(f"{summary.path}/{kind}").where(
            F.col("event_date").isin(fresh) & kept_hours(F.col("hour")))
        for f in as_filters(filters):
            rows = rows.where(predicate(f))
        parts.append(rows)
    if from_events or not parts:
        events = stored.read_live(spark, summary.landing, summary.table, first, last)
        days = F.col("event_date")
        events = events.where(days.isin(from_events) if from_events else F.lit(False))
        if cut:
            events = events.where(~days.isin(fresh) | ~kept_hours(F.date_trunc("hour", "timestamp")))
        parts.append(make(apply_filters(events, filters, lower, upper), summary))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def _answers(summary: Summary, aggregation: str, field: str | None, fields, filters, approx: bool) -> bool:
    known = set(summary.group_by)
    if not known.issuperset(fields) or any(
        f.field not in known or data_key(f.field) is not None for f in as_filters(filters)
    ):
        return False
    if aggregation == "count":
        return True
    if aggregation == "count_unique":
        return field in known or (approx and field in summary.distinct)
    return field in summary.numbers and (approx or aggregation not in PERCENTILES)


def _merged(summary: Summary, rows: DataFrame, keys: list[Column], aggregation: str, field: str | None) -> DataFrame:
    """One aggregate of each group of summary rows: the key columns and ``value``."""
    if aggregation == "count":
        value = F.sum("events")
    elif aggregation == "count_unique" and field in summary.group_by:
        value = F.count_distinct(_name(field))
    elif aggregation == "count_unique":
        value = F.hll_sketch_estimate(F.hll_union_agg(f"distinct_{summary.distinct.index(field)}"))
    else:
        i = summary.numbers.index(field)
        if aggregation in PERCENTILES:
            some = F.when(F.col(f"n_{i}") > 0, F.col(f"quantiles_{i}"))
            sketch = F.when(F.sum(f"n_{i}") > 0, F.kll_merge_agg_double(some))
            value = F.kll_sketch_get_quantile_double(sketch, F.lit(PERCENTILES[aggregation]))
        elif aggregation == "avg":
            value = F.try_divide(F.sum(f"sum_{i}"), F.sum(f"n_{i}"))
        else:
            value = {"sum": F.sum, "min": F.min, "max": F.max}[aggregation](f"{aggregation}_{i}")
    return rows.groupBy(*keys).agg(F.coalesce(value.cast("double"), F.lit(0.0)).alias("value"))


def _names(group_by) -> list[str]:
    return [group_by] if isinstance(group_by, str) else list(group_by)


def summary_analytics(
    spark: SparkSession, summary: Summary, *, aggregation: str = "count", field: str | None = None, group_by=(), filters=None,
    start=None, end=None, order_by: str = "value", descending: bool = False, limit: int | None = None,
    approx: bool = False,
) -> DataFrame:
    """``analytics`` of the live events, from the summary where it can answer. Without ``group_by`` it is a gauge."""
    check_aggregation(aggregation, field)
    fields = _names(group_by)
    request = dict(aggregation=aggregation, field=field, approx=approx)
    if not _answers(summary, aggregation, field, fields, filters, approx):
        events = stored.read_live(spark, summary.landing, summary.table, *_days(start, end))
        return analytics(events, **request, group_by=fields, filters=filters, start=start, end=end, order_by=order_by,
                         descending=descending, limit=limit)
    keys = [F.col(_name(f)).alias(f"group_{i}") for i, f in enumerate(fields)]
    found = _merged(summary, _rows(spark, summary, GROUPS, filters, start, end), keys, aggregation, field)
    return ordered(found, fields, order_by, descending, limit)


def summary_timeseries(
    spark: SparkSession, summary: Summary, *, interval: str = "hour", aggregation: str = "count", field: str | None = None,
    group_by=(), filters=None, start=None, end=None, fill_zeros: bool = False, approx: bool = False, nested: bool = False,
    most_buckets: int | None = None,
) -> DataFrame:
    """``timeseries`` of the live events, from the summary where it can answer: minutes come from events."""
    check_aggregation(aggregation, field)
    check_interval(interval)
    fields = _names(group_by)
    shape = dict(interval=interval, start=start, end=end, fill_zeros=fill_zeros, nested=nested, most_buckets=most_buckets)
    if interval == "minute" or not _answers(summary, aggregation, field, fields, filters, approx):
        events = stored.read_live(spark, summary.landing, summary.table, *_days(start, end))
        return timeseries(events, aggregation=aggregation, field=field, group_by=fields, filters=filters, approx=approx,
                          **shape)
    keys = [bucket_start(F.col("hour"), interval, False).alias("bucket")]
    keys += [F.col(_name(f)).alias(f"group_{i}") for i, f in enumerate(fields)]
    rows = _rows(spark, summary, GROUPS, filters, start, end)
    return arranged(_merged(summary, rows, keys, aggregation, field), len(fields), ntz=False, **shape)


def _days(start, end) -> tuple[date | None, date | None]:
    lower, upper = parse_time(start), parse_time(end)
    return lower and lower.date(), upper and upper.date()


def summary_label_values(
    spark: SparkSession, summary: Summary, label: str, *, filters=None, start=None, end=None, limit: int | None = None,
) -> DataFrame:
    """``label_values`` of the live events, from the summary where it has the label and the filters' columns."""
    others = [f for f in as_filters(filters) if f.field != label]
    if label not in LABEL_COLUMNS or not _answers(summary, "count", None, [label], others, False):
        events = stored.read_live(spark, summary.landing, summary.table, *_days(start, end))
        return label_values(events, label, filters=filters, start=start, end=end, limit=limit)
    return _distinct(_rows(spark, summary, GROUPS, others, start, end), label, "value", limit)


def summary_data_values(
    spark: SparkSession, summary: Summary, key: str, *, filters=None, start=None, end=None, limit: int | None = None,
) -> DataFrame:
    """``data_values`` of the live events, from a summary that groups by the key."""
    if not _answers(summary, "count", None, [f"data.{key}"], filters, False):
        events = stored.read_live(spark, summary.landing, summary.table, *_days(start, end))
        return data_values(events, key, filters=filters, start=start, end=end, limit=limit)
    return _distinct(_rows(spark, summary, GROUPS, filters, start, end), _name(f"data.{key}"), "value", limit)


def summary_data_keys(
    spark: SparkSession, summary: Summary, *, filters=None, start=None, end=None, limit: int | None = None,
) -> DataFrame:
    """``data_keys`` of the live events, from the summary where it has the filters' columns."""
    if not _answers(summary, "count", None, [], filters, False):
        events = stored.read_live(spark, summary.landing, summary.table, *_days(start, end))
        return data_keys(events, filters=filters, start=start, end=end, limit=limit)
    return _distinct(_rows(spark, summary, KEYS, filters, start, end), "key", "key", limit)


def _distinct(rows: DataFrame, column: str, name: str, limit: int | None) -> DataFrame:
    values = rows.select(F.col(column).alias(name)).distinct()
    return limited((values.where(F.col(name) != "") if name == "value" else values).orderBy(name), limit)
