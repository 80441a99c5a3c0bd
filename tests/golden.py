"""Eight events with hand-computed answers; ``trace_id`` ends in the row's number."""

from datetime import datetime, timezone

from eventlens.schema import EVENT_COLUMNS

HTTP, VIEW = "http.request", "page.view"
ROWS = [
    (1, "2026-01-31T23:59:59.999", "api", "prod", "u1", HTTP, "info", '{"latency":10,"path":"/a","status":200}'),
    (2, "2026-02-01T00:00:00", "api", "prod", "u2", HTTP, "info", '{"latency":20,"path":"/b","status":200}'),
    (3, "2026-02-01T00:30:00", "api", "prod", "u1", HTTP, "error", '{"latency":30,"path":"/a","status":500}'),
    (4, "2026-02-01T02:15:00", "web", "prod", "", VIEW, "debug", '{"path":"/a"}'),
    (5, "2026-02-02T00:00:00", "web", "staging", "u3", VIEW, "info", '{"latency":"40","path":"/c"}'),
    (6, "2026-02-02T10:00:00", "web", "staging", "u3", "user_login", "info", "{}"),
    (7, "2026-02-07T23:59:00", "job", "", "", "batch.done", "warn", '{"latency":null,"n%":1,"ok":true}'),
    (8, "2026-02-08T00:00:00", "api", "prod", "u2", HTTP, "error",
     '{"latency":1e3,"path":"/b","status":503,"tag":{"x":1}}'),
]


def trace(i):
    return f"00000000-0000-4000-8000-{i:012d}"


def golden_events(spark):
    rows = [
        (datetime.fromisoformat(ts).replace(tzinfo=timezone.utc), service, env, "", "", trace(i), user, name, level, data)
        for i, ts, service, env, user, name, level, data in ROWS
    ]
    kinds = ", ".join(f"{c} {'timestamp' if c == 'timestamp' else 'string'}" for c in EVENT_COLUMNS)
    return spark.createDataFrame(rows, kinds)


def ids(df):
    return [int(row["trace_id"][-12:]) for row in df.select("trace_id").collect()]
