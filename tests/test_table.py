"""Writing, reading, publishing and expiring the events table; streaming ingest."""

import os
import re
from datetime import date, datetime, timedelta, timezone
from types import SimpleNamespace

import pyarrow.parquet as pq
import pytest
from golden import ids, trace
from pyspark.sql import functions as F

from eventlens import (
    analytics, append_events, apply_filters, days_to_publish, drop_expired, publish_days, read_batches, read_events,
    ingest_progress, read_ledger, read_live, register_view, retained_from, search_events, start_ingest, stream_lines,
    timeseries, write_batch,
)
from eventlens.plans.session import scratch_dir
from eventlens.sources import table as tables
from eventlens.sources.table import STORED_COLUMNS


def days_in(path):
    return sorted(d for d in os.listdir(path) if d.startswith("event_date="))


def test_append_and_read(spark, golden, folder):
    path = f"{folder}/events"
    append_events(golden.filter("service = 'api'"), path)
    append_events(golden.filter("service <> 'api'"), path)
    table = read_events(spark, path)
    assert sorted(ids(table)) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert table.columns == STORED_COLUMNS
    assert days_in(path) == [f"event_date=2026-{d}" for d in ("01-31", "02-01", "02-02", "02-07", "02-08")]
    assert table.filter("_inserted_at IS NULL OR event_date <> to_date(timestamp)").count() == 0
    assert ids(search_events(table, limit=3)) == [8, 7, 6]
    assert ids(apply_filters(table, start="2026-02-07T00:00:00Z", end="2026-02-07T23:59:59Z")) == [7]


def test_times_are_cut_to_milliseconds(spark, folder):
    moment = datetime(2026, 2, 1, 0, 0, 0, 123999, tzinfo=timezone.utc)
    append_events(spark.createDataFrame([(moment, "s", "n")], "timestamp timestamp, service string, name string"), folder + "/t")
    (row,) = read_events(spark, folder + "/t").collect()
    assert row["timestamp"].microsecond == 123000
    assert (row["env"], row["data"], row["user_id"]) == ("", "{}", "")


def test_files_without_a_column_read_as_empty(spark, golden, folder):
    path = f"{folder}/events"
    append_events(golden.filter("service = 'api'"), path)
    old = golden.filter("service <> 'api'").drop("user_id").withColumn("event_date", F.to_date("timestamp"))
    old.write.mode("append").partitionBy("event_date").parquet(path)
    table = read_events(spark, path)
    found = {r["group_0"]: r["value"] for r in analytics(table, group_by="user_id").collect()}
    assert found == {"": 4, "u1": 2, "u2": 2}
    assert sorted(ids(apply_filters(table, {"user_id": ""}))) == [4, 5, 6, 7]
    assert sorted(ids(apply_filters(table, {"user_id__neq": "u1"}))) == [2, 4, 5, 6, 7, 8]
    register_view(table, "evolved", absent_as_empty=("user_id",))
    assert spark.sql("SELECT * FROM evolved WHERE user_id = '' AND service = 'web'").count() == 3
    register_view(table, "all_filled")
    assert spark.sql("SELECT * FROM all_filled WHERE user_id = '' AND service = 'web'").count() == 3
    register_view(table)
    found = spark.sql(f"SELECT * FROM events WHERE trace_id = '{trace(3)}' AND timestamp >= '2026-02-01 00:00:00'")
    assert ids(found) == [3]
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    assert f"EqualTo(trace_id,{trace(3)})" in found._jdf.queryExecution().executedPlan().toString()
    # also of the column that some files lack
    found = spark.sql("SELECT * FROM events WHERE user_id = '' AND service = 'web'")
    assert found.count() == 3
    assert "EqualTo(user_id,)" in found._jdf.queryExecution().executedPlan().toString()
    assert "coalesce" not in found._jdf.queryExecution().executedPlan().toString()


def test_nulls_of_other_events_read_as_empty_in_the_view(spark):
    events = spark.createDataFrame([(None, "s", None)], "timestamp timestamp, service string, user_id string")
    register_view(events, "foreign")
    assert spark.sql("SELECT * FROM foreign WHERE user_id = ''").count() == 1


def test_drop_expired(spark, golden, folder):
    path = f"{folder}/events"
    append_events(golden, path)
    gone = drop_expired(spark, path, date(2026, 3, 5))
    assert gone == [date(2026, 1, 31), date(2026, 2, 1), date(2026, 2, 2)]
    assert sorted(ids(read_events(spark, path))) == [7, 8]
    assert drop_expired(spark, path, datetime(2026, 3, 5, 23, 59)) == []


def land(spark, folder, batch_id, *pairs):
    lines = [(LINE.format(ts, "s", trace(i)),) for ts, i in pairs]
    write_batch(spark.createDataFrame(lines, "value string"), batch_id, f"{folder}/landing", f"{folder}/quarantine", "s")
    return f"{folder}/landing", f"{folder}/table"


def publish_all(spark, landing, table):
    for day in days_to_publish(spark, landing, table):
        publish_days(spark, landing, table, day, day)


DAYS = [(f"2026-02-{d:02d}T10:00:00Z", d) for d in range(1, 8)]


def test_expired_days_stay_away(spark, folder):
    """From the table, while landing still has them; then from landing, with its ledger."""
    landing, table = land(spark, folder, 0, *DAYS[:2])
    land(spark, folder, 1, *DAYS[1:])
    publish_all(spark, landing, table)
    gone = drop_expired(spark, table, date(2026, 2, 5), days=3)
    assert gone == [date(2026, 2, 1), date(2026, 2, 2)] and retained_from(spark, table) == date(2026, 2, 3)
    for _ in range(2):
        assert days_to_publish(spark, landing, table) == []
        assert sorted(ids(read_live(spark, landing, table))) == [3, 4, 5, 6, 7] == sorted(ids(read_events(spark, table)))
        publish_days(spark, landing, table, date(2026, 2, 1), date(2026, 2, 9))
    land(spark, folder, 2, DAYS[0], ("2026-02-05T11:00:00Z", 50))  # an expired day and an open one
    assert days_to_publish(spark, landing, table) == [date(2026, 2, 5)]
    assert sorted(ids(read_live(spark, landing, table))) == [3, 4, 5, 6, 7, 50]
    assert drop_expired(spark, table, date(2026, 1, 1)) == []  # the mark never goes back
    assert retained_from(spark, table) == date(2026, 2, 3)
    drop_expired(spark, landing, date(2026, 2, 5), days=3)
    assert {r["batch_id"] for r in read_ledger(spark, landing).collect()} == {1, 2}  # batch 0 had expired days alone
    assert sorted(ids(read_live(spark, landing, table))) == [3, 4, 5, 6, 7, 50]
    assert sorted(ids(read_events(spark, landing))) == [3, 4, 5, 6, 7, 50]
    assert drop_expired(spark, f"{folder}/none", date(2026, 2, 5)) == []


def test_a_publication_that_broke_off(spark, folder, monkeypatch):
    """The day is rewritten with a late batch, its list is not: every event is live once."""
    landing, table = land(spark, folder, 0, *DAYS[:3])
    publish_all(spark, landing, table)
    land(spark, folder, 1, ("2026-02-02T11:00:00Z", 20))

    def breaks(*_):
        raise OSError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(tables, "_list_days", breaks)
        with pytest.raises(OSError):
            publish_days(spark, landing, table, date(2026, 2, 2), date(2026, 2, 2))
    assert sorted(ids(read_events(spark, table))) == [1, 2, 3, 20]
    assert sorted(ids(read_live(spark, landing, table))) == [1, 2, 3, 20]
    assert days_to_publish(spark, landing, table) == [date(2026, 2, 2)]
    publish_all(spark, landing, table)
    assert days_to_publish(spark, landing, table) == []
    assert sorted(ids(read_live(spark, landing, table))) == [1, 2, 3, 20]


def test_a_table_without_lists_is_listed_by_its_rows(spark, folder):
    landing, table = land(spark, folder, 0, *DAYS[:3])
    publish_all(spark, landing, table)
    os.rename(f"{table}/_published", f"{folder}/lists")
    assert days_to_publish(spark, landing, table) == []
    land(spark, folder, 1, ("2026-02-02T11:00:00Z", 20))
    assert days_to_publish(spark, landing, table) == [date(2026, 2, 2)]
    publish_all(spark, landing, table)
    assert sorted(d for d in os.listdir(f"{table}/_published") if "=" in d) == days_in(table)
    assert sorted(ids(read_live(spark, landing, table))) == [1, 2, 3, 20]


def test_live_reads_only_the_asked_and_listed_days(spark, folder):
    landing, table = land(spark, folder, 0, *DAYS[:4])
    publish_all(spark, landing, table)
    land(spark, folder, 1, *DAYS[3:])
    found = read_live(spark, landing, table, date(2026, 2, 3), date(2026, 2, 5))
    assert sorted(ids(found)) == [3, 4, 4, 5]
    events = [f for f in found.inputFiles() if "/_batches/" not in f and "/_published/" not in f]
    assert events and all(re.search("event_date=2026-02-0[345]", f) for f in events)
    # what is missing is known without reading an event
    lists = tables._missing(spark, landing, table).inputFiles()
    assert lists and all("/_batches/" in f or "/_published/" in f for f in lists)
    text = read_live(spark, landing, table)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan parquet [timestamp") == 2 and "Distinct" not in text


LINE = '{{"timestamp":"{}","service":"{}","name":"n","trace_id":"{}"}}'


def write_lines(folder, name, lines):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}", "w") as file:
        file.write("\n".join(lines) + "\n")


def run_stream(spark, folder):
    seen = []
    query = start_ingest(
        stream_lines(spark, f"{folder}/in", max_files=1), f"{folder}/landing", f"{folder}/quarantine",
        f"{folder}/checkpoint", available_now=True, on_batch=seen.append)
    query.awaitTermination()
    return seen


def test_stream(spark, folder):
    write_lines(f"{folder}/in", "1.json", [LINE.format("2026-02-01T10:00:00Z", "a", trace(1)), "{bad", "",
                                          LINE.format("2026-02-02T10:00:00Z", "a", trace(2))])
    write_lines(f"{folder}/in", "2.json", [LINE.format("2026-01-01T10:00:00Z", "late", trace(3)),
                                          LINE.format("2026-02-01T11:00:00Z", "", trace(4))])
    first, second = sorted(run_stream(spark, folder), key=lambda c: c.batch_id)
    assert {(first.accepted, tuple(first.rejected)), (second.accepted, tuple(second.rejected))} == {
        (2, ("invalid JSON",)), (1, ("service is required",))}
    landing = read_events(spark, f"{folder}/landing")
    assert sorted(ids(landing)) == [1, 2, 3]
    assert days_in(f"{folder}/landing")[0] == "event_date=2026-01-01"  # late events go to their own day
    reasons = {r["reject_reason"]: r["line"] for r in spark.read.parquet(f"{folder}/quarantine").collect()}
    assert reasons["invalid JSON"] == "{bad" and len(reasons) == 2

    write_lines(f"{folder}/in", "3.json", [LINE.format("2026-02-02T12:00:00Z", "b", trace(5))])
    (third,) = run_stream(spark, folder)
    assert (third.batch_id, third.accepted, third.rejected) == (2, 1, {})
    assert sorted(ids(read_events(spark, f"{folder}/landing"))) == [1, 2, 3, 5]
    assert run_stream(spark, folder) == []


def test_a_replayed_batch_changes_nothing(spark, folder):
    def batch(*pairs):
        lines = [(LINE.format(ts, "s", trace(i)),) for ts, i in pairs] + [("{bad",)]
        return spark.createDataFrame(lines, "value string")

    paths = f"{folder}/landing", f"{folder}/quarantine"
    early = batch(("2026-02-01T10:00:00Z", 1), ("2026-02-02T10:00:00Z", 2))
    write_batch(early, 0, *paths, "s")
    write_batch(batch(("2026-02-01T12:00:00Z", 3)), 1, *paths, "s")
    for _ in range(2):
        counts = write_batch(early, 0, *paths, "s")
        assert (counts.accepted, counts.rejected) == (2, {"invalid JSON": 1})
    assert sorted(ids(read_events(spark, paths[0]))) == [1, 2, 3]
    assert spark.read.parquet(paths[1]).count() == 2


def test_publishing_days(spark, folder):
    start = datetime(2026, 2, 1, tzinfo=timezone.utc)
    lines = [(LINE.format((start + timedelta(minutes=7 * i)).strftime("%Y-%m-%dT%H:%M:%SZ"), f"s{i % 3}", trace(i)),)
             for i in range(600)]
    landing, table = f"{folder}/landing", f"{folder}/table"
    write_batch(spark.createDataFrame(lines, "value string"), 0, landing, f"{folder}/quarantine", "s")
    for _ in range(2):  # repeating a publication changes nothing
        publish_days(spark, landing, table, date(2026, 2, 1), date(2026, 2, 2), files=4)
    published = read_events(spark, table)
    assert sorted(ids(published)) == [i for i in range(600) if 7 * i < 2 * 24 * 60]
    spans = published.groupBy(F.input_file_name().alias("file")).agg(
        F.min("timestamp").alias("low"), F.max("timestamp").alias("high")).orderBy("low").collect()
    assert 4 <= len(spans) <= 5
    assert all(a["high"] <= b["low"] for a, b in zip(spans, spans[1:]))  # disjoint time ranges

    late = spark.createDataFrame([(LINE.format("2026-02-01T00:00:01Z", "late", trace(999)),)], "value string")
    write_batch(late, 1, landing, f"{folder}/quarantine", "s")
    assert read_live(spark, landing, table).count() == 601  # late rows of a published day, and open days
    assert days_to_publish(spark, landing, table) == [date(2026, 2, d) for d in (1, 3)]
    publish_days(spark, landing, table, date(2026, 2, 1), date(2026, 2, 1))
    again = read_events(spark, table)  # files were replaced: a table is opened anew
    assert again.count() == len([i for i in range(600) if 7 * i < 2 * 24 * 60]) + 1

    live = read_live(spark, landing, table)
    assert live.count() == 601
    assert read_live(spark, landing, table, date(2026, 2, 3), date(2026, 2, 9)).count() == 600 - len(
        [i for i in range(600) if 7 * i < 2 * 24 * 60])
    assert timeseries(live, interval="day").count() == 3


def test_streams_do_not_touch_each_others_batches(spark, folder):
    paths = f"{folder}/landing", f"{folder}/quarantine"
    for stream, n in (("first", 5), ("second", 2)):
        lines = [(LINE.format("2026-02-01T10:00:00Z", stream, trace(i)),) for i in range(n)]
        write_batch(spark.createDataFrame(lines, "value string"), 0, *paths, stream)
    assert read_events(spark, paths[0]).count() == 7
    assert {(r["stream"], r["events"]) for r in read_batches(spark, paths[0]).collect()} == {("first", 5), ("second", 2)}


def test_a_new_checkpoint_adds_to_what_landed(spark, folder):
    write_lines(f"{folder}/in", "1.json", [LINE.format("2026-02-01T10:00:00Z", "a", trace(1))])
    (first,) = run_stream(spark, folder)
    os.rename(f"{folder}/checkpoint", f"{folder}/lost")
    os.rename(f"{folder}/in/1.json", f"{folder}/done.json")
    write_lines(f"{folder}/in", "2.json", [LINE.format("2026-02-01T11:00:00Z", "a", trace(2))])
    (second,) = run_stream(spark, folder)
    assert first.batch_id == second.batch_id == 0
    assert sorted(ids(read_events(spark, f"{folder}/landing"))) == [1, 2]


def test_files_that_landed_are_not_landed_again(spark, folder):
    """A lost checkpoint begun anew over the same folder: rows, refused lines and ledger stay; a new file lands."""
    write_lines(f"{folder}/in", "1.json", [LINE.format("2026-02-01T10:00:00Z", "a", trace(1)), "{bad"])
    write_lines(f"{folder}/in", "2 b.json", ["{worse"])
    run_stream(spark, folder)
    ledger = sorted(map(str, read_ledger(spark, f"{folder}/landing").collect()))
    os.rename(f"{folder}/checkpoint", f"{folder}/lost")
    assert {(c.accepted, tuple(c.rejected)) for c in run_stream(spark, folder)} == {(0, ())}
    assert ids(read_events(spark, f"{folder}/landing")) == [1]
    assert spark.read.parquet(f"{folder}/quarantine").count() == 2
    assert sorted(map(str, read_ledger(spark, f"{folder}/landing").collect())) == ledger
    write_lines(f"{folder}/in", "3.json", [LINE.format("2026-02-01T11:00:00Z", "a", trace(2))])
    run_stream(spark, folder)
    assert sorted(ids(read_events(spark, f"{folder}/landing"))) == [1, 2]
    write_lines(f"{folder}/in", "1.json", [LINE.format("2026-02-01T12:00:00Z", "a", trace(3)), "{bad", ""])
    os.rename(f"{folder}/checkpoint", f"{folder}/lost again")
    run_stream(spark, folder)  # the same name, but another file
    assert sorted(ids(read_events(spark, f"{folder}/landing"))) == [1, 2, 3]


def test_a_batch_that_did_not_land_delivers_nothing(spark, folder):
    """Files of a batch that broke off before its ledger entry are taken by the next stream."""
    write_lines(f"{folder}/in", "1.json", [LINE.format("2026-02-01T10:00:00Z", "a", trace(1))])
    run_stream(spark, folder)
    os.rename(f"{folder}/landing/_batches", f"{folder}/torn")
    os.rename(f"{folder}/checkpoint", f"{folder}/lost")
    (again,) = run_stream(spark, folder)
    assert again.accepted == 1
    assert ids(read_live(spark, f"{folder}/landing", f"{folder}/table")) == [1]


def test_progress_and_flushes_of_bounded_size(spark, folder):
    good = [LINE.format(f"2026-02-01T10:{i % 60:02d}:00Z", "a", trace(i)) for i in range(250)]
    write_lines(f"{folder}/in", "1.json", good + ["{bad", "", "{bad"])
    query = start_ingest(
        stream_lines(spark, f"{folder}/in"), f"{folder}/landing", f"{folder}/quarantine", f"{folder}/checkpoint",
        available_now=True, flush_events=100)
    query.awaitTermination()
    sizes = [pq.read_metadata(f"{at}/{name}").num_rows for at, _, names in os.walk(f"{folder}/landing")
             for name in names if name.endswith(".parquet") and "_batches" not in at]
    assert sum(sizes) == 250 and max(sizes) <= 100
    write_lines(f"{folder}/in", "2.json", good[:3] + [""] + ["{bad"])
    (row,) = ingest_progress(spark, f"{folder}/in", f"{folder}/landing").collect()
    size = os.path.getsize(f"{folder}/in/2.json")
    assert row.asDict() == {"enqueued": 256, "accepted": 250, "refused": 2, "pending": 4, "pending_files": 1,
                            "pending_bytes": size}
    run_stream(spark, folder)
    (row,) = ingest_progress(spark, f"{folder}/in", f"{folder}/landing").collect()
    assert tuple(row) == (256, 253, 3, 0, 0, 0)


def test_batches_that_broke_off_are_not_published(spark, folder):
    landing, table = f"{folder}/landing", f"{folder}/table"
    lines = spark.createDataFrame([(LINE.format("2026-02-01T10:00:00Z", "a", trace(1)),)], "value string")
    write_batch(lines, 0, landing, f"{folder}/quarantine", "s")
    torn = read_events(spark, landing).withColumn("stream", F.lit("s")).withColumn("batch_id", F.lit(1))
    torn.write.mode("append").partitionBy("event_date", "stream", "batch_id").parquet(landing)
    publish_days(spark, landing, table, date(2026, 2, 1), date(2026, 2, 1))
    assert read_events(spark, table).count() == 1
    assert read_live(spark, landing, table).count() == 1
    assert days_to_publish(spark, landing, table) == []


def test_landing_files_are_few_and_sorted(spark, folder):
    lines = [(LINE.format(f"2026-02-0{1 + i % 2}T{i * 7 % 24:02d}:{i * 13 % 60:02d}:00Z", f"s{i % 5}", trace(i)),)
             for i in range(500)]
    batch = spark.createDataFrame(lines, "value string").repartition(8)
    write_batch(batch, 0, f"{folder}/landing", f"{folder}/quarantine", "s")
    files = [f"{at}/{name}" for at, _, names in os.walk(f"{folder}/landing")
             for name in names if name.endswith(".parquet") and "_batches" not in at]
    assert len(files) == 2  # one for each day
    for file in files:
        rows = [(r["timestamp"], r["service"], r["trace_id"]) for r in pq.read_table(file).to_pylist()]
        assert rows == sorted(rows)


def test_only_the_asked_days_are_listed(spark, golden, folder):
    append_events(golden, f"{folder}/t")
    found = read_events(spark, f"{folder}/t", date(2026, 2, 2), date(2026, 2, 7))
    assert sorted(ids(found)) == [5, 6, 7]
    assert all("2026-02-02" in f or "2026-02-07" in f for f in found.inputFiles())
    assert read_events(spark, f"{folder}/t", date(2020, 1, 1), date(2020, 1, 2)).count() == 0


def test_other_zones_are_refused(spark, golden):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        with pytest.raises(ValueError, match="timeZone"):
            timeseries(golden, interval="day")
        with pytest.raises(ValueError, match="timeZone"):
            append_events(golden, "/tmp/never")
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_scratch_follows_the_cluster_setting(spark):
    def session(**settings):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: settings.get(key, default)))

    shared = session(**{"spark.checkpoint.dir": "hdfs://cluster/scratch/"})
    assert scratch_dir(shared).startswith("hdfs://cluster/scratch/eventlens-")
    assert scratch_dir(shared) != scratch_dir(shared)
    assert scratch_dir(session(**{"spark.master": "local[4]"})).startswith("/tmp/run-")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_dir(session(**{"spark.master": master}))
    assert scratch_dir(spark)
