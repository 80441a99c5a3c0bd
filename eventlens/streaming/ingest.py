"""Streaming ingest: NDJSON files -> landing dataset + quarantine."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from eventlens.schema import FLUSH_INTERVAL, SORT_COLUMNS
from eventlens.sources.ndjson import (
    LINE_FEED, SOURCE, accepted, parse_lines, read_lines, rejected, without_return,
)
from eventlens.sources.table import BATCH_COLUMNS, BATCHES, LEDGER_SCHEMA, bloom_options, read_ledger, read_or_none

#: Files of a micro-batch if the caller sets no bound.
MAX_FILES = 1000


@dataclass(frozen=True)
class BatchCounts:
    """What one micro-batch did: every line that is not empty is in one of the two."""

    batch_id: int
    accepted: int
    rejected: dict[str, int]


def _overwrite(df: DataFrame, path: str, *partitions: str, **options: str) -> None:
    (
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .options(**options).partitionBy(*partitions).parquet(path)
    )


def _file_id() -> Column:
    """What the file that a row was read from is known by: path, size and time of change."""
    at = F.col("_metadata")
    changed = F.unix_micros(at["file_modification_time"]).cast("string")
    return F.concat_ws("|", at["file_path"], at["file_size"].cast("string"), changed)


def _ledger_rows(parsed: DataFrame) -> DataFrame:
    """The batch's rows of the ledger: events by day, refused lines by reason, lines by source file."""
    has_source = SOURCE in parsed.columns
    by = parsed.groupBy(
        "event_date", "reject_reason", F.col(SOURCE) if has_source else F.lit(None).cast("string").alias(SOURCE)
    ).agg(F.count(F.lit(1)).alias("n"))
    refused = F.col("reject_reason").isNotNull()
    day, reason, source = (F.lit(None).cast(t) for t in ("date", "string", "string"))
    outcome = F.struct(
        F.when(~refused, F.col("event_date")).alias("event_date"), F.col("reject_reason").alias("reason"),
        source.alias("source"))
    of_file = F.struct(day.alias("event_date"), reason.alias("reason"), F.col(SOURCE).alias("source"))
    kinds = F.array(outcome, of_file) if has_source else F.array(outcome)
    return by.select(F.explode(kinds).alias("k"), "n").groupBy("k").agg(F.sum("n").alias("events")).select("k.*", "events")


def write_batch(
    lines: DataFrame, batch_id: int, landing: str, quarantine: str, stream: str,
    delivered: DataFrame | None = None, flush_events: int | None = None,
) -> BatchCounts:
    """Parse one batch once and write its accepted and its refused lines.

    All writes replace the partitions of this ``stream`` and ``batch_id`` and no others, so a batch
    replayed after a failure leaves the same rows, and another stream's batches stay. The batch is entered
    in the ledger ``_batches`` last: before, nobody reads it. It says how many events each day got, how many
    lines were refused and why, and which files they came from. Lines of files in ``delivered`` (``source``)
    are left out: others have landed them. A batch has a few files for each day, sorted, of at most
    ``flush_events`` events if that is set; AQE splits a day too big for one task. ``publish_days``
    makes large files of them.
    """
    if delivered is not None:
        lines = lines.join(delivered, SOURCE, "left_anti")
    parsed = parse_lines(lines)
    # of accepted lines only the parsed columns are kept while the batch is written
    kept = F.when(F.col("reject_reason").isNotNull(), F.col("line")).alias("line")
    parsed = parsed.select(
        *[c for c in parsed.columns if c != "line"], kept, F.lit(stream).alias("stream"), F.lit(batch_id).alias("batch_id")
    ).persist()
    most = {"maxRecordsPerFile": str(flush_events)} if flush_events else {}
    try:
        events = accepted(parsed)
        _overwrite(
            # the writer sorts by the partition columns; with these in front it finds its order there
            events.hint("rebalance", "event_date").sortWithinPartitions("event_date", *BATCH_COLUMNS, *SORT_COLUMNS),
            landing, "event_date", *BATCH_COLUMNS, **bloom_options(), **most,
        )
        _overwrite(rejected(parsed), quarantine, *BATCH_COLUMNS, **most)
        own = _ledger_rows(parsed).withColumns({"stream": F.lit(stream), "batch_id": F.lit(batch_id)})
        _overwrite(own.coalesce(1), f"{landing}/{BATCHES}", *BATCH_COLUMNS)
    finally:
        parsed.unpersist()
    # one row for each day and reason, read back from what was written
    own = read_or_none(
        lines.sparkSession, LEDGER_SCHEMA, f"{landing}/{BATCHES}/stream={stream}/batch_id={batch_id}")
    counts = own.where("source is null").groupBy("reason").agg(F.sum("events").alias("events")).collect()
    by_reason = {row["reason"]: row["events"] for row in counts}
    return BatchCounts(batch_id, by_reason.pop(None, 0), by_reason)


def delivered_by_others(spark: SparkSession, landing: str, stream: str) -> DataFrame | None:
    """The source files that other streams have landed (``source``), None if there are none."""
    others = read_ledger(spark, landing).where(F.col("source").isNotNull() & (F.col("stream") != stream))
    found = others.select(SOURCE).distinct()
    return found.persist() if not others.isEmpty() else None


def ingest_progress(spark: SparkSession, source: str, landing: str) -> DataFrame:
    """How far ingest from a folder has come, one row: ``enqueued``, ``accepted``, ``refused`` and ``pending`` lines,
    ``pending_files`` and ``pending_bytes``.

    What was accepted and refused is in the ledger, which each batch is entered in as it lands: the numbers are of whole
    batches, of all streams, and the same after any failure. Pending are the files of the folder that no landed
    batch has read; only these are opened, to count their lines. The driver gets their names."""
    ledger = read_ledger(spark, landing)
    files = spark.read.format("binaryFile").load(source).select("path", "length", _file_id().alias(SOURCE))
    waiting = files.join(ledger.where("source is not null").select(SOURCE), SOURCE, "left_anti")
    names = [(r["path"], r["length"]) for r in waiting.select("path", "length").collect()]
    pending = read_lines(spark, [n for n, _ in names]).where("value <> ''").count() if names else 0
    outcome = F.col("source").isNull()
    return ledger.agg(
        F.coalesce(F.sum(F.when(outcome, F.col("events"))), F.lit(0)).alias("done"),
        F.coalesce(F.sum(F.when(outcome & F.col("reason").isNull(), F.col("events"))), F.lit(0)).alias("accepted"),
        F.coalesce(F.sum(F.when(outcome & F.col("reason").isNotNull(), F.col("events"))), F.lit(0)).alias("refused"),
    ).select(
        (F.col("done") + pending).alias("enqueued"), "accepted", "refused", F.lit(pending).cast("long").alias("pending"),
        F.lit(len(names)).cast("long").alias("pending_files"), F.lit(sum(n for _, n in names)).cast("long").alias("pending_bytes"),
    )


def stream_lines(
    spark: SparkSession, source: str, max_files: int | None = MAX_FILES, max_bytes: str | None = None,
    clean: str | None = None, archive: str | None = None,
) -> DataFrame:
    """NDJSON files (also ``.gz``) dropped into a directory, as a stream of lines with their ``source``.

    ``max_files``, or ``max_bytes`` instead, bounds a micro-batch: a flood waits in the source
    directory instead of filling memory. Only with ``max_files=None`` there is no bound. ``clean``
    ("delete", or "archive" with a directory) takes files away that are done, so that the directory
    stays short.
    """
    reader = spark.readStream.option("lineSep", LINE_FEED)
    if max_bytes:
        reader = reader.option("maxBytesPerTrigger", max_bytes)
    elif max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if clean:
        reader = reader.option("cleanSource", clean)
    if archive:
        reader = reader.option("sourceArchiveDir", archive)
    return without_return(reader.text(source).select("value", _file_id().alias(SOURCE)))


def start_ingest(
    lines: DataFrame, landing: str, quarantine: str, checkpoint: str, *,
    interval: str = FLUSH_INTERVAL, available_now: bool = False,
    on_batch: Callable[[BatchCounts], None] | None = None, flush_events: int | None = None,
) -> StreamingQuery:
    """Start writing a stream of lines; ``available_now`` takes what is there and ends.

    Batches are named by the id that Spark keeps in the checkpoint, so a stream that goes on from its
    checkpoint replaces its own batches, and one with another or a new checkpoint adds to them. Files that another
    stream has landed by then are left out, known by path, size and time of change: a checkpoint that is lost and
    begun anew lands nothing twice. Two streams that run over the same folder at the same time are not kept
    apart. ``flush_events`` bounds the events of a written file.
    """
    names: list[str] = []
    others: list[DataFrame | None] = []
    started = threading.Event()

    def each_batch(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        if not others:  # once for each run: what this stream itself lands, its checkpoint knows
            known = SOURCE in batch.columns
            others.append(delivered_by_others(batch.sparkSession, landing, names[0]) if known else None)
        counts = write_batch(batch, batch_id, landing, quarantine, names[0], others[0], flush_events)
        if on_batch is not None:
            on_batch(counts)

    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    query = (
        lines.writeStream.foreachBatch(each_batch)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )
    names.append(str(query.id))
    started.set()
    return query
