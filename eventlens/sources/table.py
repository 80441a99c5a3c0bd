"""The events table: Parquet in daily ``event_date`` partitions.

Two datasets share the layout. The *landing* dataset takes ingest batches as they
come, in ``event_date``/``stream``/``batch_id`` directories: a batch is named by its
stream and its number in it, so streams cannot touch each other's batches. A batch
counts as landed once it is in the ledger ``_batches`` beside the days, which is written
last. The *table* holds whole days rewritten from landed batches: range-partitioned
and sorted by (timestamp, service, trace_id, request_id), with bloom filters on the
id columns. ``_published`` in it lists the batches that each day holds. A day's list is taken away
before the day is rewritten and written after it: a day without a list is being
published, or broke off, and readers take all of it from landing. So what is missing is
known from the two lists, and no event is read for it.

Publishing a day replaces its partition, so it can be repeated after any failure.

``_retained`` beside the days of either dataset holds the first day that is kept, as the name of an empty file:
the latest counts. Reads, publication and the list of what is to publish leave out what is before it, so
what has expired stays away, whether its files are deleted yet, land anew or were never published.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.functions.fields import PARSED
from eventlens.functions.predicates import date_literal
from eventlens.functions.settings import check_session
from eventlens.functions.sql import register_functions
from eventlens.schema import BLOOM_COLUMNS, DEFAULTS, EVENT_COLUMNS, EVENT_SCHEMA, RETENTION_DAYS, SORT_COLUMNS

STORED_COLUMNS = [*EVENT_COLUMNS, "_inserted_at", "event_date"]
#: The stream and the number of the batch that brought a row.
BATCH_COLUMNS = ["stream", "batch_id"]
BATCHES, PUBLISHED, RETAINED = "_batches", "_published", "_retained"
BLOOM_FALSE_POSITIVE = 0.01  # fixed value

_BATCH_FIELDS = [T.StructField("stream", T.StringType()), T.StructField("batch_id", T.LongType())]
BATCH_SCHEMA = T.StructType(EVENT_SCHEMA.fields + _BATCH_FIELDS)
#: The ledger has one row for each day a batch has events of (event_date, events), for each reason it refused lines
#: for (reason, events) and for each file it took lines from (source, events).
LEDGER_SCHEMA = T.StructType([
    T.StructField("event_date", T.DateType()), T.StructField("reason", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("events", T.LongType()),
] + _BATCH_FIELDS)
#: ``typed``: the day's files hold ``data`` as VARIANT too.
PUBLISHED_SCHEMA = T.StructType(
    [T.StructField("events", T.LongType())] + _BATCH_FIELDS
    + [T.StructField("typed", T.BooleanType()), T.StructField("event_date", T.DateType())]
)
TYPED_SCHEMA = T.StructType(BATCH_SCHEMA.fields + [T.StructField(PARSED, T.VariantType())])


def bloom_options() -> dict[str, str]:
    options = {}
    for c in BLOOM_COLUMNS:
        options[f"parquet.bloom.filter.enabled#{c}"] = "true"
        options[f"parquet.bloom.filter.fpp#{c}"] = str(BLOOM_FALSE_POSITIVE)
        options[f"parquet.bloom.filter.adaptive.enabled#{c}"] = "true"
    return options


def stored(events: DataFrame) -> DataFrame:
    """Events with every stored column: missing ones get their default, times are cut
    to milliseconds and ``event_date`` is derived from the timestamp."""
    check_session(events.sparkSession)
    for c in EVENT_COLUMNS[1:]:
        default = F.lit(DEFAULTS[c])
        events = events.withColumn(c, F.coalesce(F.col(c), default) if c in events.columns else default)
    inserted = F.col("_inserted_at") if "_inserted_at" in events.columns else F.current_timestamp()
    time = F.date_trunc("MILLISECOND", F.col("timestamp").cast("timestamp"))
    return (
        events.withColumn("timestamp", time)
        .withColumn("_inserted_at", F.date_trunc("MILLISECOND", inserted))
        .withColumn("event_date", F.to_date("timestamp"))
        .select(*STORED_COLUMNS)
    )


def append_events(events: DataFrame, path: str) -> None:
    """Append a batch of events. Rows are brought together by day, and AQE splits a
    day too big for one task, so neither file count nor task size follows the skew."""
    (
        stored(events)
        .hint("rebalance", "event_date")
        .sortWithinPartitions("event_date", *SORT_COLUMNS)
        .write.mode("append").options(**bloom_options()).partitionBy("event_date").parquet(path)
    )


def _read_days(
    spark: SparkSession, path: str, schema: T.StructType, first: date | None, last: date | None
) -> DataFrame:
    reader = spark.read.schema(schema)
    if first is None or last is None:
        return reader.parquet(path)
    days = ",".join((first + timedelta(days=i)).isoformat() for i in range((last - first).days + 1))
    try:
        return reader.option("basePath", path).parquet(f"{path}/event_date={{{days}}}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _files(spark: SparkSession, path: str):
    """Spark's file system and the path in it. Needs a classic session: Spark Connect has no way to files."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop


def read_or_none(spark: SparkSession, schema: T.StructType, path: str) -> DataFrame:
    """A dataset, or no rows if there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def retained_from(spark: SparkSession, *paths: str) -> date | None:
    """The first day that all of some datasets keep; None if nothing has expired yet."""
    days = []
    for path in paths:
        files, marks = _files(spark, f"{path}/{RETAINED}/[0-9]*")
        days += [date.fromisoformat(s.getPath().getName()) for s in files.globStatus(marks) or []]
    return max(days, default=None)


def _kept(spark: SparkSession, df: DataFrame, *paths: str) -> DataFrame:
    """Rows of days that have not expired; the filter prunes partitions."""
    mark = retained_from(spark, *paths)
    return df if mark is None else df.where(F.col("event_date") >= date_literal(mark))


def read_events(spark: SparkSession, path: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """The table (or the landing dataset), without days that have expired. Of a column that files are older
    than, the reader gives '', and '{}' for ``data``.

    With ``first`` and ``last`` only the folders of these days are listed, however many days and
    batches the dataset holds; a day without a folder has no events."""
    return _kept(spark, _read_days(spark, path, EVENT_SCHEMA, first, last), path).select(*STORED_COLUMNS)


def _may_be_null(events: DataFrame, column: str) -> bool:
    field = events.schema[column]
    return field.nullable and "EXISTS_DEFAULT" not in field.metadata


def register_view(events: DataFrame, name: str = "events", absent_as_empty: tuple[str, ...] | None = None) -> None:
    """Make the events available to ``spark.sql`` under a name.

    Columns of the stored table are taken as they are: the reader fills in what files lack, and filters on them
    reach the scan with their statistics and bloom filters. Of other events, NULL reads '' ('{}' for
    ``data``) in the view; ``absent_as_empty`` names the columns that this is done for, where it is known.
    The SQL functions of ``eventlens.functions.sql`` are registered with it.
    """
    register_functions(events.sparkSession)
    names = [c for c in DEFAULTS if c in events.columns and _may_be_null(events, c)]
    names = names if absent_as_empty is None else absent_as_empty
    filled = {c: F.coalesce(F.col(c), F.lit(DEFAULTS[c])).alias(c) for c in names}
    events.withColumns(filled).createOrReplaceTempView(name)


# -- landing and publication -------------------------------------------------


def read_ledger(spark: SparkSession, landing: str) -> DataFrame:
    """What each landed batch did: ``LEDGER_SCHEMA``."""
    return read_or_none(spark, LEDGER_SCHEMA, f"{landing}/{BATCHES}")


def read_batches(spark: SparkSession, landing: str) -> DataFrame:
    """The landed batches: event_date, events, stream, batch_id; one row for each day a batch has events of, without
    days that have expired."""
    days = read_ledger(spark, landing).where(F.col("event_date").isNotNull())
    return _kept(spark, days, landing).select("event_date", "events", *BATCH_COLUMNS)


def _published(spark: SparkSession, table: str) -> DataFrame:
    """Day, stream and batch of what the table holds, by its lists. A table without any list, from before
    there were lists, is asked for its rows."""
    files, lists = _files(spark, f"{table}/{PUBLISHED}")
    columns = ["event_date", *BATCH_COLUMNS]
    if files.exists(lists):
        return read_or_none(spark, PUBLISHED_SCHEMA, f"{table}/{PUBLISHED}").select(*columns)
    return read_or_none(spark, BATCH_SCHEMA, table).select(*columns).distinct()


def _missing(spark: SparkSession, landing: str, table: str) -> DataFrame:
    """Day, stream and batch of what has landed and is not in the table."""
    missing = read_batches(spark, landing).join(
        _published(spark, table), ["event_date", *BATCH_COLUMNS], "left_anti")
    return _kept(spark, missing.select("event_date", *BATCH_COLUMNS), table)


def _days_of(df: DataFrame) -> list[date]:
    """The days of a list; one date for each comes to the driver."""
    return [row["event_date"] for row in df.select("event_date").distinct().orderBy("event_date").collect()]


def days_to_publish(spark: SparkSession, landing: str, table: str) -> list[date]:
    """Days with landed batches that the table does not hold, late ones of published days among them, expired
    ones not."""
    return _days_of(_missing(spark, landing, table))


def _between(first: date | None, last: date | None) -> Column:
    day, bounds = F.col("event_date"), F.lit(True)
    if first is not None:
        bounds = bounds & (day >= date_literal(first))
    return bounds & (day <= date_literal(last)) if last is not None else bounds


def _list_days(batches: DataFrame, table: str, typed: bool = False) -> None:
    (
        batches.select("events", *BATCH_COLUMNS, F.lit(typed).alias("typed"), "event_date").repartition("event_date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("event_date")
        .parquet(f"{table}/{PUBLISHED}")
    )


def publish_days(
    spark: SparkSession, landing: str, table: str, first: date, last: date, files: int | None = None,
    typed: bool = False,
) -> None:
    """Rewrite the days ``first`` to ``last`` of the table from the landed batches.

    A range shuffle on the sort key cuts a big day into many files of disjoint time
    ranges, whose min/max statistics serve time filters. ``files`` fixes how many
    ranges there are; by default there are up to ``spark.sql.shuffle.partitions``, which
    AQE merges to the advisory size. The landing dataset has to keep a day for as long as
    it may be published again; days that it has no rows of, and expired ones, stay as they are.

    ``typed`` stores ``data`` as VARIANT beside its text. Spark's writer shreds it into columns for the keys that
    many events have, so aggregates of ``read_live(typed=True)`` read these columns in place of parsing text.
    """
    # one listing of the ledger for the rows and for the list of them
    batches = _kept(spark, read_batches(spark, landing).where(_between(first, last)), table)
    days = _days_of(batches)
    if not days:
        return
    system, lists = _files(spark, f"{table}/{PUBLISHED}")
    if not system.exists(lists):
        held = _published(spark, table).withColumn("events", F.lit(None).cast("long"))
        _list_days(held, table)
    for day in days:
        system.delete(_files(spark, f"{table}/{PUBLISHED}/event_date={day.isoformat()}")[1], True)
    rows = _read_days(spark, landing, BATCH_SCHEMA, first, last).where(F.col("event_date").isin(days))
    rows = rows.join(batches.select(*BATCH_COLUMNS).distinct(), BATCH_COLUMNS, "left_semi")
    order = ["event_date", *SORT_COLUMNS]
    rows = rows.select(*STORED_COLUMNS, *BATCH_COLUMNS)
    if typed:
        check_session(spark)
        rows = rows.withColumn(PARSED, F.try_parse_json("data"))
    ranged = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    (
        ranged.sortWithinPartitions(*order)
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .options(**bloom_options()).partitionBy("event_date").parquet(table)
    )
    _list_days(batches, table, typed)


def _typed_days(spark: SparkSession, table: str) -> DataFrame:
    """Days whose files hold ``data`` as VARIANT."""
    lists = read_or_none(spark, PUBLISHED_SCHEMA, f"{table}/{PUBLISHED}")
    return lists.groupBy("event_date").agg(F.bool_and(F.coalesce("typed", F.lit(False))).alias("typed")).where("typed")


def read_live(
    spark: SparkSession, landing: str, table: str, first: date | None = None, last: date | None = None,
    typed: bool = False,
) -> DataFrame:
    """Every landed event that has not expired: the published days, and the batches that they do not hold yet from
    landing.

    What is missing is known from the lists of both before any event is read, so only the listed days of the
    table and the days with missing batches of landing are. A batch that lands late on a published
    day is seen at once, and published again or not makes no difference; a day whose publication
    broke off is read from landing.

    With ``typed`` the rows also have ``data`` as VARIANT: from the files of days that were published so, without a
    look at the text, and parsed for all other rows. ``analytics``, ``topn`` and ``gauge`` take ``data.<key>`` from it.
    Exact percentiles and other operators refuse ``data.<key>`` of such rows, which Spark 4.1.2 cannot plan for them: read
    without ``typed``. Whoever changes ``data`` has to drop that column."""
    held = _days_of(_kept(spark, _published(spark, table).where(_between(first, last)), table, landing))
    missing = _missing(spark, landing, table).where(_between(first, last))
    waiting = _days_of(missing)

    def of_days(path: str, schema: T.StructType, days: list[date]) -> DataFrame:
        rows = _read_days(spark, path, schema, first, last)
        return rows.where(F.col("event_date").isin(days))

    def columns(rows: DataFrame) -> DataFrame:
        if typed and PARSED not in rows.columns:
            rows = rows.withColumn(PARSED, F.try_parse_json("data"))
        return rows.select(*STORED_COLUMNS, *([PARSED] if typed else []))

    check_session(spark)
    parsed = set(_days_of(_typed_days(spark, table).where(_between(first, last)))) if typed else set()
    parts = []
    if days := [d for d in held if d in parsed]:
        parts.append(columns(of_days(table, TYPED_SCHEMA, days)))
    if days := [d for d in held if d not in parsed]:
        parts.append(columns(of_days(table, BATCH_SCHEMA, days)))
    if waiting:
        recent = of_days(landing, BATCH_SCHEMA, waiting).join(missing, ["event_date", *BATCH_COLUMNS], "left_semi")
        parts.append(columns(recent))
    return reduce(DataFrame.unionByName, parts) if parts else columns(spark.createDataFrame([], EVENT_SCHEMA))


# -- retention ---------------------------------------------------------------


def _day(moment: date | datetime) -> date:
    return moment.date() if isinstance(moment, datetime) else moment


def first_retained_day(as_of: date | datetime, days: int = RETENTION_DAYS) -> date:
    """A day expires at midnight ``days`` days after it."""
    return _day(as_of) - timedelta(days=days - 1)


def retained(events: DataFrame, as_of: date | datetime, days: int = RETENTION_DAYS) -> DataFrame:
    """Events not yet expired as of a day; prunes partitions of the table."""
    check_session(events.sparkSession)
    day = F.col("event_date") if "event_date" in events.columns else F.to_date("timestamp")
    return events.filter(day >= date_literal(first_retained_day(as_of, days)))


def drop_expired(spark: SparkSession, path: str, as_of: date | datetime, days: int = RETENTION_DAYS) -> list[date]:
    """Delete the ``event_date`` directories that have expired; returns their days.

    The first day that is kept is written down before anything is deleted, and never goes back: from then on no
    reader sees an earlier day, and none is published, from this dataset or, by ``read_live`` and
    ``publish_days``, from the one that it belongs to. Lists of the expired days, and the ledger of landed batches that
    have no other days, are deleted too. Works on whole directories, so nothing is rewritten, and the driver
    only sees names.
    """
    cutoff, dropped = first_retained_day(as_of, days), []
    mark = max(cutoff, retained_from(spark, path) or cutoff)
    files, root = _files(spark, path)
    if not files.exists(root):
        return []
    files.create(_files(spark, f"{path}/{RETAINED}/{mark.isoformat()}")[1], True).close()
    day_names = "event_date=[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9]"
    for folder in (path, f"{path}/{PUBLISHED}"):
        for status in files.globStatus(_files(spark, f"{folder}/{day_names}")[1]) or []:
            day = date.fromisoformat(status.getPath().getName().split("=")[1])
            if day < mark:
                files.delete(status.getPath(), True)
                dropped += [day] if folder == path else []
    past = read_ledger(spark, path).groupBy(*BATCH_COLUMNS).agg(F.max("event_date").alias("last"))
    for batch in past.where(F.col("last") < date_literal(mark)).toLocalIterator():
        ledger = f"{path}/{BATCHES}/stream={batch['stream']}/batch_id={batch['batch_id']}"
        files.delete(_files(spark, ledger)[1], True)
    return sorted(dropped)
