"""The event table: columns, types, limits and allowed names."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. Column names, limits, the id pattern and the names of
# aggregates, intervals and operators are part of the data contract.
# ---------------------------------------------------------------------------
EVENT_COLUMNS = [
    "timestamp", "service", "env", "job_id", "request_id",
    "trace_id", "user_id", "name", "level", "data",
]
TEXT_COLUMNS = ["service", "env", "job_id", "request_id", "trace_id", "user_id", "name", "level"]
LABEL_COLUMNS = ["service", "env", "user_id", "name", "level"]
REQUIRED_TEXT = ["service", "name"]
UUID_COLUMNS = ["job_id", "request_id", "trace_id"]
SORT_COLUMNS = ["timestamp", "service", "trace_id", "request_id"]
BLOOM_COLUMNS = ["trace_id", "request_id", "job_id", "name", "user_id"]

AGGREGATIONS = ["count", "sum", "avg", "min", "max", "count_unique", "p50", "p90", "p95", "p99"]
PERCENTILES = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
INTERVALS = ["minute", "hour", "day", "week", "month"]
OPERATORS = ["eq", "neq", "lt", "gt", "lte", "gte", "contains", "startswith", "endswith", "in"]

IDENTIFIER_PATTERN = r"[a-zA-Z_][a-zA-Z0-9_]*"
UUID_PATTERN = r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"

TOPN_LIMIT = 10
PAGE_LIMIT = 100
LINE_MAX_BYTES = 1024 * 1024
RETENTION_DAYS = 30
FLUSH_INTERVAL = "5 seconds"
# ---------------------------------------------------------------------------

#: What a column reads as in files older than it.
DEFAULTS = {c: "{}" if c == "data" else "" for c in EVENT_COLUMNS if c != "timestamp"}


def _text(column: str) -> T.StructField:
    # the name under which Spark's readers look for the value of a column that a file lacks
    return T.StructField(column, T.StringType(), True, {"EXISTS_DEFAULT": f"'{DEFAULTS[column]}'"})


#: Schema given to every read of the table. Reading with a fixed schema (and
#: not with ``mergeSchema``) needs no footer scan: of a file written before a
#: column existed the reader itself gives the column's default, so filters on it reach the scan.
EVENT_SCHEMA = T.StructType(
    [T.StructField("timestamp", T.TimestampType())]
    + [_text(c) for c in EVENT_COLUMNS if c != "timestamp"]
    + [T.StructField("_inserted_at", T.TimestampType()), T.StructField("event_date", T.DateType())]
)
