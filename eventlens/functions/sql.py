"""SQL functions for ad-hoc queries, with the meaning that the DataFrame functions have.

They are defined in Spark SQL itself, so a query that uses them is optimised as if their bodies stood in it,
and there is no Python in them.

* ``event_text(data, key)``: text of a top-level key of JSON text; '' if it is missing or JSON null.
* ``event_number(data, key)``: its double if it is a JSON number, else NULL; a quoted "42" is a text.
* ``event_bucket(time, interval)``: start of the minute, hour, day, week (from Sunday) or month in UTC; an error
  for any other interval.
* ``event_value(x)``: an aggregate as a double, 0.0 without any value.

A key may hold any characters but a single quote and a backslash. ``data`` that is NULL or no JSON has no keys.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from eventlens.functions.settings import check_session
from eventlens.schema import INTERVALS

_NAMED = ", ".join(f"'{i}'" for i in INTERVALS)
#: Name, parameters, type and body. Members are parameters of inner functions, so that a body which
#: looks at one more than once parses no text twice.
FUNCTIONS = [
    ("event_member", "data STRING, key STRING", "VARIANT",
     "try_variant_get(try_parse_json(data), concat('$[''', key, ''']'), 'variant')"),
    ("event_member_text", "member VARIANT", "STRING",
     "coalesce(CASE schema_of_variant(member) WHEN 'STRING' THEN CAST(member AS STRING) WHEN 'VOID' THEN NULL"
     " ELSE to_json(member) END, '')"),
    ("event_text", "data STRING, key STRING", "STRING", "event_member_text(event_member(data, key))"),
    ("event_number", "data STRING, key STRING", "DOUBLE", "try_cast(to_json(event_member(data, key)) AS DOUBLE)"),
    ("event_bucket", "time TIMESTAMP, interval_name STRING", "TIMESTAMP",
     "CASE WHEN interval_name = 'week' THEN date_trunc('DAY', time) - make_dt_interval(dayofweek(time) - 1)"
     f" WHEN interval_name IN ({_NAMED}) THEN date_trunc(interval_name, time)"
     " ELSE raise_error(concat('no interval ', interval_name)) END"),
    ("event_value", "x DOUBLE", "DOUBLE", "coalesce(x, 0.0D)"),
]


def register_functions(spark: SparkSession) -> None:
    """Make the functions known to ``spark.sql`` of this session."""
    check_session(spark)
    for name, parameters, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
