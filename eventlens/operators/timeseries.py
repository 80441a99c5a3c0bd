"""Time series: one aggregate per time bucket and group, with optional zero fill."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventlens.functions.aggregates import aggregate, check_aggregation
from eventlens.functions.buckets import bucket_start, bucket_step, check_grid
from eventlens.functions.fields import group_columns
from eventlens.functions.predicates import filtered, is_ntz, parse_time, time_literal


def timeseries(
    df: DataFrame, *, interval: str = "hour", aggregation: str = "count", field: str | None = None,
    group_by=(), filters=None, start=None, end=None, fill_zeros: bool = False, approx: bool = False,
    nested: bool = False, most_buckets: int | None = None,
) -> DataFrame:
    """``bucket``, ``group_0...``, ``name``, ``value``, ordered by bucket and group.

    ``name`` is the group values joined by '|', for display. ``fill_zeros`` gives each
    series every bucket from ``start`` to ``end`` (only if both are set), so grid times
    series rows result, whatever the key; if nothing matches at all, one unnamed series
    of zeros. ``most_buckets`` refuses to fill a longer grid. ``nested`` returns one row
    per series with ``data_points``, an array of (timestamp, value), and needs both
    bounds, which bound that array.
    """
    check_aggregation(aggregation, field)
    lower, upper = parse_time(start), parse_time(end)
    fields = [group_by] if isinstance(group_by, str) else list(group_by)
    keys = group_columns(fields)
    bucket = bucket_start(F.col("timestamp"), interval, is_ntz(df)).alias("bucket")
    events = filtered(df, filters, lower, upper, [*fields, field])
    points = aggregate(events, [bucket, *keys], aggregation, field, approx)
    return arranged(
        points, len(keys), interval=interval, start=lower, end=upper, fill_zeros=fill_zeros, nested=nested,
        most_buckets=most_buckets, ntz=is_ntz(df))


def arranged(
    points: DataFrame, n_keys: int, *, interval: str, start, end, fill_zeros: bool, nested: bool,
    most_buckets: int | None, ntz: bool,
) -> DataFrame:
    """Points (``bucket``, ``group_0...``, ``value``) as the series that ``timeseries`` gives."""
    lower, upper = parse_time(start), parse_time(end)
    if nested and (lower is None or upper is None):
        raise ValueError("nested series need a start and an end; ask for long rows without them")
    if fill_zeros and lower is not None and upper is not None:
        check_grid(lower, upper, interval, most_buckets)
    names = [f"group_{i}" for i in range(n_keys)]
    if fill_zeros and lower is not None and upper is not None:
        points = _fill(points, names, lower, upper, interval, ntz)

    name = F.concat_ws("|", *names) if names else F.lit("")
    if nested:
        pairs = F.sort_array(F.collect_list(F.struct(F.col("bucket").alias("timestamp"), "value")))
        if not names:  # no series at all rather than an empty one
            series = points.agg(pairs.alias("data_points")).filter(F.size("data_points") > 0)
        else:
            series = points.groupBy(*names).agg(pairs.alias("data_points"))
        return series.select(name.alias("name"), *names, "data_points").orderBy(*names, "name")
    return points.select("bucket", *names, name.alias("name"), "value").orderBy("bucket", *names)


def _fill(points: DataFrame, names: list[str], lower, upper, interval: str, ntz: bool) -> DataFrame:
    """Zeros between the points of each series, over the grid from ``lower`` to ``upper``.

    The window below sorts the points of a series, one for each bucket at most, however
    many events they stand for.
    """
    if lower > upper:
        return points.filter(F.lit(False))
    first = bucket_start(time_literal(lower, ntz), interval, ntz)
    last, step = time_literal(upper, ntz), bucket_step(interval)
    grid = points.sparkSession.range(1).select(F.explode(F.sequence(first, last, step)).alias("bucket"))

    if not names:
        filled = grid.join(points, "bucket", "left")
        return filled.select("bucket", F.coalesce("value", F.lit(0.0)).alias("value"))

    series = Window.partitionBy(*names).orderBy("bucket")
    after = F.lead("bucket").over(series)
    run = F.sequence(
        F.when(F.lag("bucket").over(series).isNull(), first).otherwise(F.col("bucket")),
        F.when(after.isNull(), last).otherwise(after - step),
        step,
    )
    filled = (
        points.select("bucket", *names, "value", run.alias("_run"))
        .select(F.explode("_run").alias("_at"), "bucket", *names, "value")
        .select(
            F.col("_at").alias("bucket"), *names,
            F.when(F.col("_at") == F.col("bucket"), F.col("value")).otherwise(0.0).alias("value"),
        )
    )
    # One unnamed series of zeros if there is no point at all. Values are never
    # NULL, so the maximum is NULL just then; the points' shuffle is reused, not redone.
    nothing = points.agg(F.max("value").alias("most")).filter(F.col("most").isNull())
    zeros = nothing.select(
        F.explode(F.sequence(first, last, step)).alias("bucket"),
        *[F.lit(None).cast("string").alias(n) for n in names],
        F.lit(0.0).alias("value"),
    )
    return reduce(DataFrame.unionByName, [filled, zeros])
