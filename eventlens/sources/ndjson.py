"""NDJSON lines -> typed, validated events, with a reason for every refused line."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.settings import check_session
from eventlens.schema import EVENT_COLUMNS, LINE_MAX_BYTES, REQUIRED_TEXT, TEXT_COLUMNS, UUID_COLUMNS, UUID_PATTERN

# The texts a refused line is filed under, and the time format.
INVALID_JSON = "invalid JSON"
LINE_TOO_LONG = "line too long"
REQUIRED = "{} is required"
NOT_A_UUID = "{} must be a valid UUID"
RFC3339_PATTERN = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})\z"
ZERO_TIME = "0001-01-01 00:00:00Z"

LINE_FEED = "\n"
#: The column that says which file a line comes from.
SOURCE = "source"
END_MARK = "<end of the line>"
_LINE_SCHEMA = T.ArrayType(T.StructType([T.StructField(c, T.VariantType()) for c in [*EVENT_COLUMNS, END_MARK]]))
_STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def read_lines(spark: SparkSession, path) -> DataFrame:
    """One line per row as ``value``; ``.gz`` files are unpacked by their extension. Lines end with a line
    feed, or a carriage return and one; a carriage return elsewhere is white space of the JSON."""
    return without_return(spark.read.text(path, lineSep=LINE_FEED))


def without_return(lines: DataFrame) -> DataFrame:
    """Lines that were split at line feeds, without one carriage return at their end."""
    return lines.withColumn("value", F.regexp_replace("value", r"\r\z", ""))


def _is_text(member: Column) -> Column:
    """A string, JSON null or missing; and not a number, a boolean, an object or a list."""
    return F.coalesce(F.schema_of_variant(member), F.lit("VOID")).isin("STRING", "VOID")


def parse_lines(lines: DataFrame, max_bytes: int = LINE_MAX_BYTES) -> DataFrame:
    """``value`` -> the event columns, ``event_date``, ``_inserted_at``, ``line`` and
    ``reject_reason`` (NULL = accepted); ``source`` is kept if lines have it.

    Empty lines are skipped. A wrong JSON type is an invalid line (no casting of 5 to
    '5'); unknown members are ignored; null counts as missing. Member names are exact
    and lower case. Lines of ``max_bytes`` or more are refused, and kept like all refused
    ones. The first failing rule gives the reason.
    """
    check_session(lines.sparkSession)
    kept = [SOURCE] if SOURCE in lines.columns else []
    # The JSON reader stops at the end of the first value. Read as a list with a mark
    # behind the line, a line with anything else on it gives another list, or none.
    marked = F.concat(F.lit("["), "value", F.lit(f',{{"{END_MARK}":""}}]'))
    read = lines.filter(F.col("value") != "").select(
        *kept, F.col("value").alias("line"), F.from_json(marked, _LINE_SCHEMA, _STRICT).alias("_list")
    )
    event, end = F.get("_list", F.lit(0)), F.get("_list", F.lit(1))
    whole = (F.size("_list") == 2) & end[END_MARK].isNotNull() & event.isNotNull()
    members = read.select(
        *kept, "line",
        F.coalesce(whole, F.lit(False)).alias("_whole"),
        reduce(and_, [_is_text(event[c]) for c in ["timestamp", *TEXT_COLUMNS]]).alias("_text"),
        F.try_variant_get(event["timestamp"], "$", "string").alias("_raw_time"),
        *[F.coalesce(F.try_variant_get(event[c], "$", "string"), F.lit("")).alias(c) for c in TEXT_COLUMNS],
        F.to_json(event["data"]).alias("_data"),
    )
    time = F.when(F.col("_raw_time").rlike(RFC3339_PATTERN), F.try_to_timestamp("_raw_time"))
    no_data = F.col("_data").isNull() | (F.col("_data") == "null")
    typed = members.select(
        *kept, "line",
        (F.col("_whole") & F.col("_text")).alias("_well_typed"),
        "_raw_time",
        F.date_trunc("MILLISECOND", time).alias("timestamp"),
        *TEXT_COLUMNS,
        F.when(no_data, "{}").otherwise(F.col("_data")).alias("data"),
    )
    bad_time = F.col("_raw_time").isNotNull() & F.col("timestamp").isNull()
    no_time = F.col("timestamp").isNull() | (F.col("timestamp") == F.lit(ZERO_TIME).cast("timestamp"))
    reason = (
        F.when(F.octet_length("line") >= max_bytes, LINE_TOO_LONG)
        .when(~F.col("_well_typed") | bad_time | ~F.col("data").startswith("{"), INVALID_JSON)
        .when(no_time, REQUIRED.format("timestamp"))
    )
    for c in REQUIRED_TEXT:
        reason = reason.when(F.col(c) == "", REQUIRED.format(c))
    for c in UUID_COLUMNS:
        reason = reason.when((F.col(c) != "") & ~F.col(c).rlike(UUID_PATTERN), NOT_A_UUID.format(c))
    # The partition id makes the reason an expression that filters are not pushed below:
    # they would evaluate all the parsing a second time. It is never negative.
    reason = F.when(F.spark_partition_id() >= 0, reason)
    return typed.select(
        *EVENT_COLUMNS,
        F.date_trunc("MILLISECOND", F.current_timestamp()).alias("_inserted_at"),
        F.to_date("timestamp").alias("event_date"),
        "line",
        reason.alias("reject_reason"),
        *kept,
    )


def accepted(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNull()).drop("line", "reject_reason", SOURCE)


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.filter(F.col("reject_reason").isNotNull()).drop(*EVENT_COLUMNS, "_inserted_at", "event_date")


def ingest_counts(parsed: DataFrame) -> DataFrame:
    """How many lines were accepted (reason '') and refused, by reason."""
    return parsed.groupBy(F.coalesce("reject_reason", F.lit("")).alias("reason")).agg(
        F.count(F.lit(1)).alias("lines")
    )


def event_line() -> Column:
    """One event of the canonical columns as an NDJSON line."""
    time = F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("timestamp")
    rest = F.to_json(F.struct(time, *TEXT_COLUMNS))
    return F.concat(F.substring(rest, F.lit(1), F.length(rest) - 1), F.lit(',"data":'), "data", F.lit("}"))


def to_lines(events: DataFrame) -> DataFrame:
    """Events -> lines as ``value``, the inverse of ``parse_lines``."""
    return events.select(event_line().alias("value"))
