"""NDJSON lines: what is accepted, what is refused and why."""

import gzip
import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from eventlens import accepted, ingest_counts, parse_lines, read_lines, rejected, to_lines
from eventlens.schema import EVENT_COLUMNS, LINE_MAX_BYTES, TEXT_COLUMNS

OK = '{"timestamp":"2026-02-06T23:01:02.123Z","service":"u","name":"n"'
UUID = "01234567-89ab-cdef-0123-456789ABCDEF"

ACCEPTED = [
    (OK + "}", {"data": "{}", "env": "", "level": ""}),
    (OK + ',"data":{"b":1,"a":"<"}}', {"data": '{"a":"<","b":1}'}),
    (OK + ',"data":{"n":12345678901234567890}}', {"data": '{"n":12345678901234567890}'}),
    (OK + ',"data":null}', {"data": "{}"}),
    (OK + ',"user_id":"42","extra":1}', {"user_id": "42"}),
    (OK + ',"env":null}', {"env": ""}),
    (OK + f',"job_id":"{UUID}","request_id":"","trace_id":"{UUID}"' + "}", {"job_id": UUID, "request_id": ""}),
    (OK + ',"user_id":"not-a-uuid"}', {"user_id": "not-a-uuid"}),
    (OK + ',"Env":"x"}', {"env": ""}),
    (OK + ',"env":"a","env":"b"}', {"env": "b"}),
    (OK + ',"data":{"user_id":42,"env":{"x":null}},"user_id":"7"}', {"user_id": "7", "data": '{"env":{"x":null},"user_id":42}'}),
    (OK + ',"\\u0065nv":"escaped","level":"a\\"b\\n"}', {"env": "escaped", "level": 'a"b\n'}),
    ('{"timestamp":"2026-02-06T23:01:02.123456789Z","service":"ü","name":"n"}',
     {"timestamp": datetime(2026, 2, 6, 23, 1, 2, 123000), "service": "ü"}),
    ('{"timestamp":"2026-02-06T23:01:02.1239+02:00","service":"u","name":"n"}',
     {"timestamp": datetime(2026, 2, 6, 21, 1, 2, 123000)}),
    ('  {"timestamp":"1969-12-31T23:59:59.9999Z","service":"u","name":"n"} ',
     {"timestamp": datetime(1969, 12, 31, 23, 59, 59, 999000)}),
]
INVALID = "invalid JSON"
REFUSED = [
    ("{bad", INVALID), ("   ", INVALID), ("[1]", INVALID), ("null", INVALID), ('"text"', INVALID),
    (OK + ',"data":[1]}', INVALID), (OK + ',"data":"{}"}', INVALID), (OK + ',"env":5}', INVALID),
    (OK + ',"env":{"a":1}}', INVALID), (OK + ',"service":false}', INVALID),
    *[(OK + "}" + rest, INVALID) for rest in (" x", "{}", ",{}", ',"a"', "]", ',0]}', ',"x":{}', "}", OK + "}")],
    ("{'timestamp':'2026-02-06T23:01:02Z','service':'u','name':'n'}", INVALID),
    (OK + ',"data":{"x":NaN}}', INVALID),
    ('{"timestamp":1770418862,"service":"u","name":"n"}', INVALID),
    ('{"timestamp":"2026-02-06","service":"u","name":"n"}', INVALID),
    ('{"timestamp":"2026-02-06 23:01:02Z","service":"u","name":"n"}', INVALID),
    ('{"timestamp":"2026-02-30T23:01:02Z","service":"u","name":"n"}', INVALID),
    ('{"timestamp":"","service":"u","name":"n"}', INVALID),
    ('{"service":"u","name":"n"}', "timestamp is required"),
    ('{"timestamp":null,"service":"u","name":"n"}', "timestamp is required"),
    ('{"timestamp":"0001-01-01T00:00:00Z","service":"u","name":"n"}', "timestamp is required"),
    ('{}', "timestamp is required"),
    ('{"timestamp":"2026-02-06T23:01:02Z","service":"","name":"n"}', "service is required"),
    ('{"timestamp":"2026-02-06T23:01:02Z","name":""}', "service is required"),
    ('{"timestamp":"2026-02-06T23:01:02Z","service":"u"}', "name is required"),
    (OK + ',"job_id":"job_x","trace_id":"t"}', "job_id must be a valid UUID"),
    (OK + ',"request_id":"r"}', "request_id must be a valid UUID"),
    (OK + ',"trace_id":"0123456789abcdef0123456789abcdef"}', "trace_id must be a valid UUID"),
    (OK + f',"trace_id":"{UUID}0"' + "}", "trace_id must be a valid UUID"),
    (OK + f',"trace_id":"{UUID}\\n"' + "}", "trace_id must be a valid UUID"),
    ('{"timestamp":"2026-02-06T23:01:02Z\\n","service":"u","name":"n"}', INVALID),
]


def parse(spark, lines):
    return parse_lines(spark.createDataFrame([(line,) for line in lines], "value string"))


def test_accepted_lines(spark):
    rows = {r["line"]: r for r in parse(spark, [line for line, _ in ACCEPTED]).collect()}
    for line, expected in ACCEPTED:
        assert rows[line]["reject_reason"] is None, line
        for column, value in expected.items():
            assert rows[line][column] == value, line


def test_refused_lines(spark):
    found = parse(spark, [line for line, _ in REFUSED]).select("line", "reject_reason").collect()
    assert {r["line"]: r["reject_reason"] for r in found} == dict(REFUSED)


def test_empty_lines_are_skipped_and_the_rest_is_split(spark):
    parsed = parse(spark, ["", OK + "}", "", "{bad", OK + ',"env":5}'])
    assert accepted(parsed).columns == [*EVENT_COLUMNS, "_inserted_at", "event_date"]
    assert [str(r["event_date"]) for r in accepted(parsed).collect()] == ["2026-02-06"]
    assert sorted(tuple(r) for r in rejected(parsed).collect()) == sorted(
        [("{bad", INVALID), (OK + ',"env":5}', INVALID)])
    assert {r["reason"]: r["lines"] for r in ingest_counts(parsed).collect()} == {"": 1, INVALID: 2}


@pytest.mark.parametrize("size, reason", [(LINE_MAX_BYTES - 1, None), (LINE_MAX_BYTES, "line too long")])
def test_line_length(spark, size, reason):
    head = OK + ',"data":{"x":"'
    line = head + "y" * (size - len(head) - 3) + '"}}'
    assert len(line) == size
    (row,) = parse(spark, [line]).collect()
    assert row["reject_reason"] == reason


def test_gzip_and_plain_files(spark, folder):
    text = "\r\n".join(line for line, _ in ACCEPTED) + "\n\n"
    with gzip.open(f"{folder}/a.json.gz", "wt", encoding="utf-8", newline="") as file:
        file.write(text)
    with open(f"{folder}/b.json", "w", encoding="utf-8", newline="") as file:
        file.write("\n".join(line for line, _ in REFUSED))
    counts = {r["reason"]: r["lines"] for r in ingest_counts(parse_lines(read_lines(spark, folder))).collect()}
    assert counts.pop("") == len(ACCEPTED)
    assert sum(counts.values()) == len(REFUSED)


def test_a_lone_carriage_return_is_white_space(spark, folder):
    with open(f"{folder}/a.json", "w", encoding="utf-8", newline="") as file:
        file.write(OK + ',\r"env":"x"}\r\n' + OK + "}\n")
    found = accepted(parse_lines(read_lines(spark, folder))).collect()
    assert sorted(r["env"] for r in found) == ["", "x"]


def test_the_longest_line_is_an_argument(spark):
    lines = spark.createDataFrame([(OK + "}",)], "value string")
    assert [r["reject_reason"] for r in parse_lines(lines, max_bytes=20).collect()] == ["line too long"]


json_values = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**30), 10**30) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=5), inner, max_size=3), max_leaves=8)
printable = st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cc")), min_size=1, max_size=10)
events = st.lists(st.fixed_dictionaries({
    "timestamp": st.datetimes(datetime(1970, 1, 1), datetime(2100, 1, 1)),
    "service": printable, "name": printable, "user_id": st.text(max_size=6),
    "data": st.dictionaries(st.text(max_size=6), json_values, max_size=4),
}), min_size=1, max_size=20)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(events)
def test_any_event_survives_writing_and_parsing(spark, drawn):
    lines = []
    for event in drawn:
        stamp = event["timestamp"].isoformat(timespec="milliseconds") + "Z"
        lines.append(json.dumps({**event, "timestamp": stamp}))
    first = accepted(parse(spark, lines))
    again = accepted(parse_lines(to_lines(first)))
    columns = ["timestamp", *TEXT_COLUMNS, "data"]
    rows = sorted(map(tuple, first.select(*columns).collect()))
    assert rows == sorted(map(tuple, again.select(*columns).collect()))
    assert len(rows) == len(drawn)
    wanted = sorted(json.dumps(e["data"], sort_keys=True) for e in drawn)
    assert sorted(json.dumps(json.loads(r[-1]), sort_keys=True) for r in rows) == wanted
