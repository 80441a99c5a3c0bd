"""The ten aggregates, all giving doubles, with 0.0 where there is no value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.fields import number_field, text_field
from eventlens.functions.percentiles import exact_percentile
from eventlens.schema import AGGREGATIONS, PERCENTILES

#: 1/accuracy is the rank error bound of approximate percentiles.
APPROX_ACCURACY = 10_000


def check_aggregation(aggregation: str, field: str | None) -> None:
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"no aggregate {aggregation!r}: choose from {', '.join(AGGREGATIONS)}")
    if aggregation != "count" and not field:
        raise ValueError(f"{aggregation} needs to know of which field")


def reads_once(aggregation: str, approx: bool) -> bool:
    """Whether an aggregate's plan meets its rows once; exact percentiles join them to their slots."""
    return approx or aggregation not in PERCENTILES


def _aggregate_column(aggregation: str, field: str | None, approx: bool) -> Column:
    if aggregation == "count":
        return F.count(F.lit(1))
    if aggregation == "count_unique":
        text = text_field(field)
        return F.approx_count_distinct(text) if approx else F.count_distinct(text)
    number = number_field(field)
    if aggregation in PERCENTILES:
        return F.percentile_approx(number, PERCENTILES[aggregation], APPROX_ACCURACY)
    return {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[aggregation](number)


def aggregate(
    df: DataFrame, keys: list[Column], aggregation: str, field: str | None = None, approx: bool = False
) -> DataFrame:
    """One aggregate per group, as the key columns followed by ``value``.

    Without keys there is always exactly one row. All of these aggregate before
    the shuffle, and exact distinct counts and percentiles also spread the values
    of one group over many tasks, so a hot group does not end up in one task.
    """
    check_aggregation(aggregation, field)
    if aggregation in PERCENTILES and not approx:
        return _percentile(df, keys, field, PERCENTILES[aggregation])
    value = F.coalesce(_aggregate_column(aggregation, field, approx).cast("double"), F.lit(0.0))
    return df.groupBy(*keys).agg(value.alias("value"))


def _percentile(df: DataFrame, keys: list[Column], field: str, fraction: float) -> DataFrame:
    group = F.struct(*(keys or [F.lit(0).alias("all")]))
    found = exact_percentile(df.select(group.alias("_k"), number_field(field).alias("_num")), fraction)
    if not keys:
        return found.agg(F.coalesce(F.max("value"), F.lit(0.0)).alias("value"))
    return found.select("_k.*", F.coalesce("value", F.lit(0.0)).alias("value"))
