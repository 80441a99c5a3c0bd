"""Session settings that right results depend on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Buckets and days are UTC, and the last of two equal JSON keys wins instead of making the whole object NULL.
REQUIRED = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in REQUIRED.items():
        spark.conf.set(key, value)
    return spark


def check_session(spark: SparkSession) -> None:
    """Every entry point calls this: a session with other settings would answer with other days."""
    for key, value in REQUIRED.items():
        if (found := spark.conf.get(key)) != value:
            raise ValueError(f"{key} is {found!r} and has to be {value!r}: call eventlens.configure(spark) first")
