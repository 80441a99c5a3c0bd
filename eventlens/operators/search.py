"""Event search with pages, and discovery of label values, data keys and data values."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from eventlens.functions.fields import DATA_PREFIX, text_of_any_key, text_of_key
from eventlens.functions.predicates import apply_filters, as_filters, filtered, is_ntz, parse_time, time_literal
from eventlens.operators.analytics import check_limit, limited
from eventlens.schema import EVENT_COLUMNS, IDENTIFIER_PATTERN, LABEL_COLUMNS, PAGE_LIMIT, SORT_COLUMNS, TEXT_COLUMNS

_TIE_BREAK = [c for c in SORT_COLUMNS if c != "timestamp"] + ["name", "data"]
_TIE_BREAK += [c for c in TEXT_COLUMNS if c not in _TIE_BREAK]


@dataclass(frozen=True)
class Page:
    """One page of a search and where its neighbours start (None: there is none)."""

    events: DataFrame
    total: int
    limit: int
    offset: int

    @property
    def next_offset(self) -> int | None:
        following = self.offset + self.limit
        return following if following < self.total else None

    @property
    def prev_offset(self) -> int | None:
        return max(0, self.offset - self.limit) if self.offset > 0 else None


def event_columns(df: DataFrame) -> DataFrame:
    """The ten public columns; a string missing from an old file reads as ''."""
    columns = [F.coalesce(F.col(c), F.lit("{}" if c == "data" else "")).alias(c)
               for c in EVENT_COLUMNS if c != "timestamp"]
    return df.select("timestamp", *columns)


def decode_data(df: DataFrame) -> DataFrame:
    """``data`` as VARIANT, NULL for an empty bag."""
    empty = F.col("data").isin("", "{}")
    return df.withColumn("data", F.when(~empty, F.try_parse_json("data")))


def matching_events(df: DataFrame, *, filters=None, start=None, end=None) -> DataFrame:
    return event_columns(apply_filters(df, filters, start, end))


def search_events(
    df: DataFrame, *, filters=None, start=None, end=None, limit: int = PAGE_LIMIT, offset: int = 0,
    after: Mapping | Row | None = None, decode: bool = False,
) -> DataFrame:
    """One page of matching events, newest first; ties in table order.

    ``after`` is the last event of the page before (a row, or a mapping with the ten columns): the page starts
    behind it. That is a filter, of which the time bound reaches the scan, so any page costs what the
    first one does. An ``offset`` has to order all rows it skips; use it for pages near the start.
    Events equal in all columns stand side by side and count as one place for ``after``.
    """
    check_limit(limit)
    check_offset(offset)
    order = [F.desc("timestamp"), *_TIE_BREAK]
    found = matching_events(df, filters=filters, start=start, end=end)
    if after is not None:
        found = found.filter(_behind(after, is_ntz(df)))
    page = found.orderBy(*order)
    page = limited(page.offset(offset) if offset else page, limit)
    return decode_data(page) if decode else page


def check_offset(offset: int) -> None:
    if isinstance(offset, bool) or not isinstance(offset, int) or offset < 0:
        raise ValueError(f"an offset is a whole number from zero on, not {offset!r}")


def _behind(last: Mapping | Row, ntz: bool) -> Column:
    """Events that come after ``last`` in the order of pages."""
    values = last.asDict() if isinstance(last, Row) else dict(last)
    moment = time_literal(parse_time(values["timestamp"]), ntz)
    later = F.lit(False)
    for c in reversed(_TIE_BREAK):
        text = values.get(c) or ("{}" if c == "data" else "")
        later = (F.col(c) > F.lit(text)) | ((F.col(c) == F.lit(text)) & later)
    # the first part says what the second implies, in a form that scans understand
    return (F.col("timestamp") <= moment) & ((F.col("timestamp") < moment) | later)


def search_total(df: DataFrame, *, filters=None, start=None, end=None) -> DataFrame:
    """How many events match: one row, ``total``."""
    return apply_filters(df, filters, start, end).agg(F.count(F.lit(1)).alias("total"))


def search_page(
    df: DataFrame, *, filters=None, start=None, end=None, limit: int = PAGE_LIMIT, offset: int = 0,
    decode: bool = False,
) -> Page:
    """A page with the total and the neighbouring offsets. Runs the count."""
    bounds = dict(filters=filters, start=start, end=end)
    events = search_events(df, **bounds, limit=limit, offset=offset, decode=decode)
    return Page(events, search_total(df, **bounds).first()["total"], limit, offset)


def label_values(
    df: DataFrame, label: str, *, filters=None, start=None, end=None, limit: int | None = None,
) -> DataFrame:
    """Distinct non-empty values of a label under all filters but its own: ``value``, in order."""
    if label not in LABEL_COLUMNS:
        raise ValueError(f"{label!r} is no label: choose from {', '.join(LABEL_COLUMNS)}")
    others = [f for f in as_filters(filters) if f.field != label]
    values = apply_filters(df, others, start, end).select(F.coalesce(F.col(label), F.lit("")).alias("value"))
    return limited(values.filter(F.col("value") != "").distinct().orderBy("value"), limit)


def data_keys(df: DataFrame, *, filters=None, start=None, end=None, limit: int | None = None) -> DataFrame:
    """Distinct top-level keys of ``data``: ``key``, in order."""
    keys = apply_filters(df, filters, start, end).select(F.explode(F.json_object_keys("data")).alias("key"))
    return limited(keys.distinct().orderBy("key"), limit)


def data_values(
    df: DataFrame, key: str, *, filters=None, start=None, end=None, limit: int | None = None,
) -> DataFrame:
    """Distinct non-empty texts of one data key, which may hold any characters: ``value``, in order."""
    if not key:
        raise ValueError("say of which key the values are wanted")
    spelled = re.fullmatch(IDENTIFIER_PATTERN, key) is not None
    found = filtered(df, filters, start, end, [DATA_PREFIX + key] if spelled else [])
    text = text_of_key(key) if spelled else text_of_any_key(key)
    values = found.select(text.alias("value")).distinct()
    return limited(values.filter(F.col("value") != "").orderBy("value"), limit)
