"""One aggregate over two periods, in one scan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.aggregates import aggregate, check_aggregation
from eventlens.functions.predicates import filtered, parse_time, time_range


def compare(
    df: DataFrame, *, start, end, aggregation: str = "count", field: str | None = None, filters=None,
    compare_start=None, compare_end=None, approx: bool = False,
) -> DataFrame:
    """``current``, ``previous``, ``change`` and ``change_percent`` (0 if previous is 0).

    Without both compare bounds the previous period is the one of equal length that
    ends where the current one starts; that instant belongs to both, so an event on
    it is counted twice. Each event is tagged with its periods, which makes the
    period a normal group key for every aggregate.
    """
    check_aggregation(aggregation, field)
    start, end = parse_time(start), parse_time(end)
    if start is None or end is None:
        raise ValueError("compare needs both start and end")
    compare_start, compare_end = parse_time(compare_start), parse_time(compare_end)
    if compare_start is None or compare_end is None:
        compare_start, compare_end = start - (end - start), start

    current = time_range(df, start, end)
    previous = time_range(df, compare_start, compare_end)
    tagged = filtered(df.filter(current | previous), filters, fields=[field]).select(
        "*",
        F.explode(
            F.when(current & previous, F.array(F.lit("current"), F.lit("previous")))
            .when(current, F.array(F.lit("current")))
            .otherwise(F.array(F.lit("previous")))
        ).alias("_period"),
    )
    values = aggregate(tagged, [F.col("_period")], aggregation, field, approx)

    def value_of(period: str):
        return F.coalesce(F.max(F.when(F.col("_period") == period, F.col("value"))), F.lit(0.0))

    both = values.agg(value_of("current").alias("current"), value_of("previous").alias("previous"))
    change = F.col("current") - F.col("previous")
    percent = F.when(F.col("previous") != 0, change / F.col("previous") * 100).otherwise(0.0)
    return both.select("*", change.alias("change"), percent.alias("change_percent"))
