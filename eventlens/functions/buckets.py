"""Time buckets in UTC. Weeks start on Sunday, in data and in the fill grid alike."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventlens.schema import INTERVALS

#: Seconds of a bucket; a month counts as its shortest length.
SECONDS = {"minute": 60, "hour": 3600, "day": 86_400, "week": 604_800, "month": 28 * 86_400}


def check_interval(interval: str) -> None:
    if interval not in INTERVALS:
        raise ValueError(f"no interval {interval!r}: choose from {', '.join(INTERVALS)}")


def bucket_start(ts: Column, interval: str, ntz: bool) -> Column:
    """Start of the bucket that holds ``ts``, in the type of ``ts``."""
    check_interval(interval)
    if interval == "week":
        day = F.date_trunc("day", ts)
        start = day - F.make_dt_interval(days=F.dayofweek(ts) - 1)
    else:
        start = F.date_trunc(interval, ts)
    return start.cast("timestamp_ntz") if ntz else start


def bucket_step(interval: str) -> Column:
    check_interval(interval)
    return F.expr(f"INTERVAL 1 {interval.upper()}")


def check_grid(start: datetime, end: datetime, interval: str, most: int | None) -> None:
    """Refuses to fill a grid of more than ``most`` buckets; None sets no bound."""
    check_interval(interval)
    buckets = (end - start).total_seconds() // SECONDS[interval] + 1
    if most is not None and buckets > most:
        raise ValueError(f"filling would make some {buckets:.0f} buckets of each series; {most} are allowed")
