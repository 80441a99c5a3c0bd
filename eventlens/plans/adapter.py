"""The benchmark's ``events`` table as canonical events.

Gives every column a value, with an absent key (``endpoint``), a quoted number
(``code``), plain numbers (``k``, ``value``) and empty strings (``user_id``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# TEXT and QUARTER stand for the two spellings that differ between SQL dialects.
_COLUMNS = {
    "timestamp": "ts",
    "service": "concat('svc_', cast(user_id % 5 AS TEXT))",
    "env": "CASE WHEN user_id % 4 = 0 THEN 'staging' ELSE 'production' END",
    "job_id": "''",
    "request_id": "''",
    "trace_id": "concat('00000000-0000-4000-8000-', lpad(cast(QUARTER AS TEXT), 12, '0'))",
    "user_id": "CASE WHEN user_id % 10 = 0 THEN '' ELSE cast(user_id AS TEXT) END",
    "name": "event_type",
    "level": "CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'debug' ELSE 'info' END",
    "data": """concat(substr(props, 1, length(props) - 1), ', "value": ', cast(value AS TEXT),
        ', "code": "', cast(200 + user_id % 3 * 100 AS TEXT), '"',
        CASE WHEN user_id % 3 <> 0 THEN concat(', "endpoint": "/e/', cast(user_id % 7 AS TEXT), '"') ELSE '' END,
        '}')""",
}


def _select_list(text: str, quarter: str) -> list[str]:
    return [f"{sql.replace('TEXT', text).replace('QUARTER', quarter)} AS {name}" for name, sql in _COLUMNS.items()]


SPARK = _select_list("string", "event_id div 4")
DUCKDB = "SELECT " + ",\n  ".join(_select_list("varchar", "event_id // 4")) + "\nFROM events"


def sample_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(*SPARK)
