"""Grouped aggregation, top-N and gauge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.aggregates import aggregate, check_aggregation, reads_once
from eventlens.functions.fields import group_columns
from eventlens.functions.predicates import filtered
from eventlens.schema import TOPN_LIMIT


def check_limit(limit: int | None) -> None:
    """A limit is a whole number above zero, or None for all rows; anything else is refused."""
    if limit is not None and (isinstance(limit, bool) or not isinstance(limit, int) or limit < 1):
        raise ValueError(f"a limit is a whole number above zero, not {limit!r}")


def limited(df: DataFrame, limit: int | None) -> DataFrame:
    check_limit(limit)
    return df if limit is None else df.limit(limit)


def ordered(result: DataFrame, fields: list[str], order_by: str, descending: bool, limit: int | None) -> DataFrame:
    """``group_0...`` and ``value`` by value or one of the group fields, ties by the keys, up to a limit."""
    names = [f"group_{i}" for i in range(len(fields))]
    first = f"group_{fields.index(order_by)}" if order_by in fields else "value"
    rest = [n for n in [*names, "value"] if n != first]
    order = [F.col(first).desc() if descending else F.col(first).asc(), *rest]
    return limited(result.orderBy(*order), limit)


def analytics(
    df: DataFrame, *, aggregation: str = "count", field: str | None = None, group_by=(), filters=None,
    start=None, end=None, order_by: str = "value", descending: bool = False, limit: int | None = None,
    approx: bool = False, groups_as_map: bool = False,
) -> DataFrame:
    """Filter, group by any number of fields, aggregate, order and limit.

    Columns ``group_0...`` and ``value``. ``order_by`` names ``value`` or one of the
    group fields; anything else means ``value``. The default order is ascending, so
    a limit keeps the smallest groups; without one all groups result. Ties are
    broken by the group keys.
    ``groups_as_map`` returns the keys as one map {field: value} instead.
    """
    fields = [group_by] if isinstance(group_by, str) else list(group_by)
    keys = group_columns(fields)
    once = reads_once(aggregation, approx)
    result = aggregate(filtered(df, filters, start, end, [*fields, field], once), keys, aggregation, field, approx)
    result = ordered(result, fields, order_by, descending, limit)
    if groups_as_map and fields:
        pairs = [part for i, f in enumerate(fields) for part in (F.lit(f), F.col(f"group_{i}"))]
        return result.select(F.create_map(*pairs).alias("groups"), "value")
    return result


def topn(
    df: DataFrame, *, group_by: str, aggregation: str = "count", field: str | None = None, filters=None,
    start=None, end=None, limit: int | None = TOPN_LIMIT, approx: bool = False,
) -> DataFrame:
    """The ``limit`` groups of one field with the largest values: ``key``, ``value``."""
    if not isinstance(group_by, str) or not group_by:
        raise ValueError("name the one field whose top groups are wanted")
    (key,) = group_columns(group_by)
    once = reads_once(aggregation, approx)
    result = aggregate(filtered(df, filters, start, end, [group_by, field], once), [key], aggregation, field, approx)
    return limited(result.withColumnRenamed("group_0", "key").orderBy(F.desc("value"), F.asc("key")), limit)


def gauge(
    df: DataFrame, *, aggregation: str = "count", field: str | None = None, filters=None,
    start=None, end=None, approx: bool = False,
) -> DataFrame:
    """One aggregate over all matching events; always one row."""
    check_aggregation(aggregation, field)
    once = reads_once(aggregation, approx)
    return aggregate(filtered(df, filters, start, end, [field], once), [], aggregation, field, approx)
