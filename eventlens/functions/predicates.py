"""Filters and time bounds -> Column predicates.

Predicates on columns are written on the bare column so that they reach the
Parquet scan; a missing string counts as '' and is admitted by a separate
``IS NULL`` branch only where '' itself would match.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Mapping
from datetime import date, datetime, timezone
from decimal import Decimal
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.fields import PARSED, data_key, needs_data, number_of_key, parsed_data, text_of_key
from eventlens.functions.settings import check_session
from eventlens.schema import OPERATORS, TEXT_COLUMNS

RFC3339 = re.compile(r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2})(\.\d+)?(Z|[+-]\d{2}:\d{2})")


class Filter(NamedTuple):
    field: str
    operator: str = "eq"
    value: Any = ""


# -- reading filter specs ----------------------------------------------------


def parse_filter_key(key: str) -> tuple[str, str]:
    """``level__in`` -> ('level', 'in'); an unknown suffix belongs to the field."""
    field, sep, operator = key.rpartition("__")
    if sep and operator in OPERATORS:
        return field, operator
    return key, "eq"


def as_filters(spec) -> list[Filter]:
    """Accepts ``{"level__in": "error,warn"}``, or a list of Filters, tuples or
    ``{"field", "operator", "value"}`` mappings."""
    if not spec:
        return []
    if isinstance(spec, Mapping):
        filters = []
        for key, value in spec.items():
            field, operator = parse_filter_key(key)
            if operator == "in" and isinstance(value, str):
                value = value.split(",")
            filters.append(Filter(field, operator, value))
        return filters
    filters = []
    for item in spec:
        if isinstance(item, Mapping):
            item = Filter(item["field"], item.get("operator") or "eq", item.get("value", ""))
        field, operator, value = Filter(*item)
        filters.append(Filter(field, operator or "eq", value))
    return filters


# -- one predicate -----------------------------------------------------------


def value_text(value) -> str:
    """The text form a value is compared by: booleans as JSON writes them, floats by their shortest
    digits, whole ones without a fraction, and with an exponent below -4 or from 21 on."""
    if value is None:
        raise ValueError("a filter needs a value")
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and math.isfinite(value):
        sign, digits, _ = Decimal(repr(value)).normalize().as_tuple()
        exponent = Decimal(repr(value)).adjusted()
        if value and not -4 <= exponent < 21:
            text = "".join(map(str, digits))
            return f"{'-' * sign}{text[0]}{'.' * (len(text) > 1)}{text[1:]}e{exponent:+03d}"
        return f"{Decimal(repr(value)).normalize():f}"
    return str(value)


def like_pattern(pattern: str) -> str:
    """Keep % _ and their escapes; double any other backslash, which Spark refuses."""
    return re.sub(r"\\([%_\\])|\\", lambda m: m.group(0) if m.group(1) else "\\\\", pattern)


def _text_list(value) -> list[str]:
    if isinstance(value, (str, bytes)) or not isinstance(value, Iterable):
        raise ValueError("the in operator needs a list")
    items = [value_text(v) for v in value]
    if not items:
        raise ValueError("the in operator needs at least one value")
    return items


def _text_predicate(text: Column, operator: str, value) -> tuple[Column, bool]:
    """The predicate on a text, and whether the empty text would satisfy it."""
    if operator == "in":
        items = _text_list(value)
        return text.isin(items), "" in items
    v = value_text(value)
    if operator in ("contains", "startswith", "endswith"):
        before = "%" if operator != "startswith" else ""
        after = "%" if operator != "endswith" else ""
        pattern = like_pattern(before + v + after)
        return text.like(pattern), not pattern.strip("%")
    other = F.lit(v)
    if operator == "eq":
        return text == other, v == ""
    if operator == "neq":
        return text != other, v != ""
    if operator == "lt":
        return text < other, v != ""
    if operator == "lte":
        return text <= other, True
    if operator == "gt":
        return text > other, False
    if operator == "gte":
        return text >= other, v == ""
    raise ValueError(f"no operator {operator!r}")


def _number_predicate(number: Column, operator: str, value) -> Column:
    if isinstance(value, bool):
        raise ValueError(f"{operator} on a data key needs a number")
    try:
        other = F.lit(float(value))
    except (TypeError, ValueError):
        raise ValueError(f"{operator} on a data key needs a number, got {value!r}") from None
    return {
        "lt": number < other, "gt": number > other,
        "lte": number <= other, "gte": number >= other,
    }[operator]


def predicate(spec: Filter) -> Column:
    if spec.operator not in OPERATORS:
        raise ValueError(f"no operator {spec.operator!r}: choose from {', '.join(OPERATORS)}")
    key = data_key(spec.field)
    if key is not None:
        if spec.operator in ("lt", "gt", "lte", "gte"):
            return _number_predicate(number_of_key(key), spec.operator, spec.value)
        return _text_predicate(text_of_key(key), spec.operator, spec.value)[0]
    if spec.field not in TEXT_COLUMNS:
        raise ValueError(f"cannot filter by {spec.field!r}: it is neither a text column nor a data.<key>")
    column = F.col(spec.field)
    condition, empty_matches = _text_predicate(column, spec.operator, spec.value)
    return condition | column.isNull() if empty_matches else condition


# -- time --------------------------------------------------------------------


def parse_time(value) -> datetime | None:
    """RFC3339 text, Unix seconds or a datetime (naive = UTC) -> UTC; None/'' = unbounded."""
    if value is None or value == "":
        return None
    if isinstance(value, datetime):
        moment = value if value.tzinfo else value.replace(tzinfo=timezone.utc)
    elif isinstance(value, int) or (isinstance(value, str) and re.fullmatch(r"[+-]?\d+", value)):
        moment = datetime.fromtimestamp(int(value), timezone.utc)
    else:
        match = RFC3339.fullmatch(value) if isinstance(value, str) else None
        if match is None:
            raise ValueError(f"not an RFC3339 time or Unix seconds: {value!r}")
        head, fraction, zone = match.groups()
        moment = datetime.fromisoformat(head + (fraction or "")[:7] + zone.replace("Z", "+00:00"))
    return moment.astimezone(timezone.utc)


def is_ntz(df: DataFrame) -> bool:
    return isinstance(df.schema["timestamp"].dataType, T.TimestampNTZType)


def time_literal(moment: datetime, ntz: bool) -> Column:
    """A literal of the type of the timestamp column, so that the comparison is pushed down."""
    utc = moment.astimezone(timezone.utc).replace(tzinfo=None)
    text = utc.isoformat(sep=" ", timespec="microseconds")
    return F.lit(text).cast("timestamp_ntz") if ntz else F.lit(text + "+00:00").cast("timestamp")


def date_literal(day: date) -> Column:
    return F.lit(day.isoformat()).cast("date")


def time_range(df: DataFrame, start=None, end=None) -> Column | None:
    """``start <= timestamp <= end``. On the partitioned table the same bounds are
    put on ``event_date`` too: Spark does not derive partition filters from them."""
    ntz, partitioned = is_ntz(df), "event_date" in df.columns
    parts = []
    lower, upper = parse_time(start), parse_time(end)
    if lower is not None:
        parts.append(F.col("timestamp") >= time_literal(lower, ntz))
        if partitioned:
            parts.append(F.col("event_date") >= date_literal(lower.date()))
    if upper is not None:
        parts.append(F.col("timestamp") <= time_literal(upper, ntz))
        if partitioned:
            parts.append(F.col("event_date") <= date_literal(upper.date()))
    return reduce(lambda a, b: a & b, parts) if parts else None


def apply_filters(df: DataFrame, filters=None, start=None, end=None) -> DataFrame:
    """All filters and the time bounds, joined by AND."""
    found = filtered(df, filters, start, end)
    return found.drop(PARSED) if PARSED in found.columns else found


def filtered(
    df: DataFrame, filters=None, start=None, end=None, fields: Iterable[str | None] = (), once: bool = False,
) -> DataFrame:
    """As ``apply_filters``; also has ``PARSED`` if a filter or one of ``fields`` is a ``data.<key>``. Time
    and columns are looked at first, and only what they leave is parsed. ``once`` as in ``parsed_data``."""
    check_session(df.sparkSession)
    specs = as_filters(filters)
    on_data = [predicate(f) for f in specs if needs_data(f.field)]
    parts = [predicate(f) for f in specs if not needs_data(f.field)]
    bounds = time_range(df, start, end)
    if bounds is not None:
        parts.insert(0, bounds)
    if parts:
        df = df.filter(reduce(lambda a, b: a & b, parts))
    if on_data or needs_data(*fields):
        df = parsed_data(df, once)
    return df.filter(reduce(lambda a, b: a & b, on_data)) if on_data else df
