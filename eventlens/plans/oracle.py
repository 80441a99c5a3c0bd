"""For each registered query the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

from eventlens.plans.adapter import DUCKDB
from eventlens.schema import LABEL_COLUMNS

EVENT = "timestamp, service, env, job_id, request_id, trace_id, user_id, name, level, data"
WEEK = "timestamp BETWEEN TIMESTAMP '2024-01-08 00:00:00' AND TIMESTAMP '2024-01-14 23:59:59'"
NUMBER_TYPES = "('BIGINT', 'UBIGINT', 'HUGEINT', 'DOUBLE')"


def txt(key: str) -> str:
    return f"coalesce(json_extract_string(data, '$.{key}'), '')"


def num(key: str) -> str:
    return (f"(CASE WHEN json_type(data, '$.{key}') IN {NUMBER_TYPES}"
            f" THEN TRY_CAST(json_extract_string(data, '$.{key}') AS DOUBLE) END)")


def value(aggregate: str) -> str:
    return f"round(coalesce(CAST({aggregate} AS DOUBLE), 0.0), 6) AS value"


def q(fraction: float, key: str = "value") -> str:
    return f"quantile_cont({num(key)}, {fraction})"


def on_events(sql: str) -> str:
    return f"WITH e AS (\n{DUCKDB}\n)\n{sql}"


def analytics(keys: list[str], aggregate: str, order: str = "value", desc: bool = False,
              limit: int | None = None, where: str = "true") -> str:
    names = [f"group_{i}" for i in range(len(keys))]
    rest = ", ".join(n for n in [*names, "value"] if n != order)
    groups = ", ".join(f"{k} AS {n}" for k, n in zip(keys, names))
    return (f"SELECT {groups}, {value(aggregate)} FROM e WHERE {where} GROUP BY {', '.join(names)}"
            f" ORDER BY {order} {'DESC' if desc else 'ASC'}, {rest}" + (f" LIMIT {limit}" if limit else ""))


def events_where(where: str) -> str:
    return f"SELECT {EVENT} FROM e WHERE {where}"


BUCKET = {
    "minute": "date_trunc('minute', timestamp)",
    "hour": "date_trunc('hour', timestamp)",
    "day": "date_trunc('day', timestamp)",
    "week": "date_trunc('day', timestamp) - to_days(CAST(dayofweek(timestamp) AS INTEGER))",
    "month": "date_trunc('month', timestamp)",
}


def series(interval: str, keys: list[str], aggregate: str, where: str = "true") -> str:
    names = [f"group_{i}" for i in range(len(keys))]
    groups = "".join(f", {k} AS {n}" for k, n in zip(keys, names))
    label = "concat_ws('|', " + ", ".join(keys) + ")" if keys else "''"
    by = ", ".join(str(i + 1) for i in range(len(keys) + 2))
    return (f"SELECT CAST({BUCKET[interval]} AS TIMESTAMP) AS bucket{groups}, {label} AS name, {value(aggregate)}"
            f" FROM (SELECT *, name AS event_name FROM e) e WHERE {where} GROUP BY {by}")


def filled(points: str, first: str, last: str, step: str, names: list[str]) -> str:
    keys = ", ".join([*names, "name"])
    same = " AND ".join(f"p.{n} = s.{n}" for n in [*names, "name"])
    shown = "".join(f", s.{n}" for n in names)
    return f""", points AS ({points}),
grid AS (SELECT unnest(generate_series(TIMESTAMP '{first}', TIMESTAMP '{last}', INTERVAL 1 {step})) AS bucket),
series AS (SELECT DISTINCT {keys} FROM points)
SELECT CAST(grid.bucket AS TIMESTAMP) AS bucket{shown}, s.name, coalesce(p.value, 0.0) AS value
FROM grid CROSS JOIN series s LEFT JOIN points p ON p.bucket = grid.bucket AND {same}"""


def on_filled(points: str, first: str, last: str, step: str, names: list[str]) -> str:
    return f"WITH e AS (\n{DUCKDB}\n)" + filled(points, first, last, step, names)


def compare(aggregate, current: str, previous: str) -> str:
    return f"""SELECT round(c, 6) AS current, round(p, 6) AS previous, round(c - p, 6) AS change,
round(CASE WHEN p <> 0 THEN (c - p) / p * 100 ELSE 0 END, 6) AS change_percent FROM (
SELECT coalesce(CAST({aggregate} FILTER (WHERE {current}) AS DOUBLE), 0.0) AS c,
       coalesce(CAST({aggregate} FILTER (WHERE {previous}) AS DOUBLE), 0.0) AS p FROM e)"""


def between(first: str, last: str) -> str:
    return f"timestamp BETWEEN TIMESTAMP '{first}' AND TIMESTAMP '{last}'"


COLUMN_FILTERS = {
    "eq": "service = 'svc_1'", "neq": "level <> 'info'", "in": "level IN ('error', 'debug')",
    "contains": "name LIKE '%i%'", "startswith": "service LIKE 'svc%'", "endswith": "name LIKE '%_k'",
    "lt": "service < 'svc_2'", "gt": "name > 'error'", "lte": "user_id <= '12'", "gte": "user_id >= '77'",
}
DATA_FILTERS = {
    "eq": f"{txt('k')} = '42'", "neq": f"{txt('endpoint')} <> '/e/1'", "in": f"{txt('code')} IN ('300', '400')",
    "contains": f"{txt('endpoint')} LIKE '%e/%'", "startswith": f"{txt('code')} LIKE '3%'",
    "endswith": f"{txt('endpoint')} LIKE '%5'", "lt": f"{num('value')} < 25", "gt": f"{num('value')} > 100.5",
    "lte": f"{num('k')} <= 9", "gte": f"{num('k')} >= 90",
}

# The faults put into the lines, in the order in which a line is tested for them.
FAULT = """CASE
  WHEN name = 'signup' AND env = 'staging' THEN 'invalid JSON'
  WHEN name = 'signup' AND service = 'svc_3' THEN NULL
  WHEN name = 'purchase' AND env = 'staging' THEN 'service is required'
  WHEN name = 'purchase' AND service = 'svc_2' THEN 'timestamp is required'
  WHEN name = 'view' AND env = 'staging' THEN 'job_id must be a valid UUID'
  WHEN name = 'view' AND service = 'svc_1' THEN 'invalid JSON'
  WHEN name = 'click' AND env = 'staging' THEN 'trace_id must be a valid UUID'
  WHEN name = 'error' AND env = 'staging' THEN 'trace_id must be a valid UUID'
  WHEN name = 'error' AND service = 'svc_1' THEN 'invalid JSON'
  ELSE '' END"""
MS = "date_trunc('milliseconds', timestamp)"
TIE_BREAK = "timestamp DESC, service, trace_id, request_id, name, data, env, job_id, user_id, level"


def _build() -> dict[str, str]:
    o: dict[str, str] = {}
    o["analytics_count_by_service"] = analytics(["service"], "count(*)", desc=True)
    for name in ("sum", "avg", "min", "max"):
        o[f"analytics_{name}_by_service"] = analytics(["service"], f"{name}({num('value')})", desc=True)
    for name, fraction in {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}.items():
        o[f"analytics_{name}_by_name"] = analytics(["name"], q(fraction), desc=True)
    o["analytics_count_unique_users"] = analytics(["name"], "count(DISTINCT user_id)")
    o["analytics_count_unique_data_key"] = analytics(["service"], f"count(DISTINCT {txt('endpoint')})")
    o["analytics_multi_key"] = analytics(["service", "env", "level"], "count(*)", order="group_0", limit=1000)
    o["analytics_data_key_groups"] = analytics([txt("endpoint")], "count(*)", desc=True)
    o["analytics_quoted_number_sum"] = analytics(["service"], f"sum({num('code')})")
    o["analytics_quoted_number_p95"] = analytics(["service"], q(0.95, "code"))
    o["analytics_default_order_limit"] = analytics(["user_id"], "count(*)", limit=100)
    o["analytics_all_groups"] = analytics(["user_id", "name", "env"], "count(*)")
    o["analytics_order_by_group_desc"] = analytics(["name", "env"], "count(*)", order="group_1", desc=True, limit=7)
    o["analytics_groups_map"] = (
        f"SELECT service, {txt('code')} AS code, {value('count(*)')} FROM e GROUP BY 1, 2 ORDER BY 1, 2")

    for name, where in COLUMN_FILTERS.items():
        o[f"filter_{name}_column"] = events_where(where)
    for name, where in DATA_FILTERS.items():
        o[f"filter_{name}_data"] = events_where(where)
    o["filter_eq_data_float"] = events_where(f"{txt('k')} = '42'")
    o["filter_conjunction_time_range"] = events_where(
        f"service = 'svc_1' AND {num('value')} >= 50 AND level <> 'debug' AND {WEEK}")
    o["filter_spec"] = events_where(
        f"level IN ('error', 'debug') AND {num('value')} > 100 AND name LIKE '%r%' AND "
        + between("2024-01-08 00:00:00", "2024-01-14 23:59:59"))

    for name in BUCKET:
        o[f"timeseries_{name}"] = series(name, [], "count(*)")
    o["timeseries_grouped"] = series("day", ["service", txt("code")], f"avg({num('value')})")
    o["timeseries_p95_grouped"] = series("day", ["event_name"], q(0.95))
    o["timeseries_nested"] = f"""SELECT name, name AS group_0, count(*) AS points, string_agg(
  strftime(bucket, '%Y-%m-%d') || '=' || CAST(CAST(value AS BIGINT) AS VARCHAR), ' ' ORDER BY bucket) AS data_points
FROM (SELECT s.name, g.bucket, count(e.timestamp) AS value
  FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-08', TIMESTAMP '2024-01-14', INTERVAL 1 DAY)) AS bucket) g
  CROSS JOIN (SELECT DISTINCT name FROM e WHERE {WEEK}) s
  LEFT JOIN e ON e.name = s.name AND date_trunc('day', e.timestamp) = g.bucket AND {WEEK.replace('timestamp', 'e.timestamp', 1)}
  GROUP BY 1, 2) GROUP BY name"""

    o["topn_name"] = f"SELECT name AS key, {value('count(*)')} FROM e GROUP BY key ORDER BY value DESC, key LIMIT 3"
    o["topn_data_endpoint"] = (
        f"SELECT {txt('endpoint')} AS key, {value(f'sum({num('value')})')} FROM e GROUP BY key"
        " ORDER BY value DESC, key LIMIT 5")
    o["topn_p99_users"] = (
        f"SELECT user_id AS key, {value(q(0.99))} FROM e GROUP BY key ORDER BY value DESC, key LIMIT 10")

    o["gauge_count_errors"] = f"SELECT {value('count(*)')} FROM e WHERE level = 'error' AND {WEEK}"
    o["gauge_p95_value"] = f"SELECT {value(q(0.95))} FROM e"
    o["gauge_unique_traces"] = f"SELECT {value('count(DISTINCT trace_id)')} FROM e"
    o["gauge_empty"] = f"SELECT {value(q(0.5))} FROM e WHERE service = 'no_such'"
    before = between("2024-01-01 00:00:01", "2024-01-08 00:00:00")
    o["compare_auto_period"] = compare("count(*)", WEEK, before)
    o["compare_explicit_p95"] = compare(q(0.95), WEEK, between("2024-01-01 00:00:00", "2024-01-10 12:00:00"))
    o["compare_unique_users"] = compare("count(DISTINCT user_id)", WEEK, before)
    o["compare_zero_previous"] = compare(
        f"sum({num('value')})", between("2024-01-01 00:00:00", "2024-01-15 00:00:00"),
        between("2023-12-18 00:00:00", "2024-01-01 00:00:00"))

    o["search_page"] = events_where("env = 'production'") + f" ORDER BY {TIE_BREAK} LIMIT 25 OFFSET 40"
    o["search_large_page"] = events_where("env = 'production'") + f" ORDER BY {TIE_BREAK} LIMIT 5000"
    o["search_after"] = o["search_page"]
    o["search_page_decoded"] = (
        f"SELECT timestamp, trace_id, CAST({num('k')} AS BIGINT) AS k, round({num('value')}, 6) AS number,"
        " json_extract_string(data, '$.endpoint') AS endpoint"
        f" FROM e WHERE name = 'error' ORDER BY {TIE_BREAK} LIMIT 50")
    o["search_total"] = f"SELECT count(*) AS total FROM e WHERE level <> 'info' AND {WEEK}"
    for label in LABEL_COLUMNS:
        rest = "true" if label == "level" else "level <> 'debug'"
        o[f"label_values_{label}"] = (
            f"SELECT DISTINCT {label} AS value FROM e WHERE {rest} AND {label} <> '' ORDER BY value")
    o["data_keys"] = (
        "SELECT DISTINCT unnest(json_keys(data)) AS key FROM e WHERE service = 'svc_1' ORDER BY key")
    o["data_values_endpoint"] = (
        f"SELECT DISTINCT {txt('endpoint')} AS value FROM e WHERE level = 'info' AND {txt('endpoint')} <> ''"
        " ORDER BY value")

    o["ingest_roundtrip"] = f"""SELECT {MS} AS timestamp, service, env, job_id, request_id, trace_id, user_id, name,
level, CAST(timestamp AS DATE) AS event_date,
(SELECT string_agg(key, ',' ORDER BY key) FROM (SELECT unnest(json_keys(data)) AS key)) AS keys,
CAST({num('k')} AS BIGINT) AS k, round({num('value')}, 6) AS number, {txt('code')} AS code,
{txt('endpoint')} AS endpoint FROM e"""
    o["ingest_rejects_by_reason"] = (
        f"SELECT reason, count(*) AS lines FROM (SELECT {FAULT} AS reason FROM e) WHERE reason IS NOT NULL GROUP BY 1")
    o["ingest_gzip"] = analytics(["name", "level"], "count(*)")
    o["stream_ingest_count"] = (
        f"SELECT CAST(timestamp AS DATE) AS event_date, service, count(*) AS events FROM e WHERE {FAULT} = ''"
        " GROUP BY 1, 2")
    o["stream_quarantine"] = (
        f"SELECT reject_reason, count(*) AS lines FROM (SELECT {FAULT} AS reject_reason FROM e)"
        " WHERE reject_reason <> '' GROUP BY 1")
    o["table_roundtrip"] = series("day", ["service"], "count(*)", WEEK)
    o["table_schema_evolution"] = analytics(
        ["env", "CASE WHEN env = 'production' THEN user_id ELSE '' END"], "count(*)", order="group_0")
    o["table_publish_days"] = (
        f"SELECT CAST(timestamp AS DATE) AS event_date, count(*) AS events, min({MS}) AS first, max({MS}) AS last,"
        f" count(DISTINCT trace_id) AS traces FROM e WHERE {FAULT} = '' GROUP BY 1")
    o["retention_cutoff"] = (
        "SELECT CAST(timestamp AS DATE) AS event_date, count(*) AS events FROM e"
        " WHERE CAST(timestamp AS DATE) + 30 > DATE '2024-02-10' GROUP BY 1")
    o["retention_drop"] = o["retention_cutoff"]
    for same in ("stream_two_sources", "stream_new_checkpoint", "live_with_late_rows"):
        o[same] = o["stream_ingest_count"]
    o["retention_live"] = (
        f"SELECT CAST(timestamp AS DATE) AS event_date, service, count(*) AS events FROM e WHERE {FAULT} = ''"
        " AND CAST(timestamp AS DATE) + 30 > DATE '2024-02-10' GROUP BY 1, 2")
    o["stream_replayed_source"] = (
        f"{o['stream_ingest_count']} UNION ALL SELECT NULL AS event_date, reject_reason AS service, lines AS events"
        f" FROM ({o['stream_quarantine']})")
    landed = "count(CASE WHEN env = 'production' AND reason {} THEN 1 END)"
    waiting = "count(CASE WHEN env <> 'production' THEN reason END)"
    o["stream_progress"] = (
        f"SELECT count(reason) AS enqueued, {landed.format("= ''")} AS accepted, {landed.format("<> ''")} AS refused,"
        f" {waiting} AS pending FROM (SELECT env, {FAULT} AS reason FROM e)")
    landed_rows = f"{FAULT} = ''"
    o["summary_counts"] = analytics(
        ["service", txt("endpoint")], "count(*)",
        where=f"{landed_rows} AND level <> 'debug' AND {MS} BETWEEN TIMESTAMP '2024-01-08 00:30:00' AND TIMESTAMP '2024-01-21 22:59:59'")
    o["summary_averages"] = analytics(["name"], f"avg({num('value')})", where=landed_rows)
    o["summary_sums_by_day"] = series(
        "day", ["service"], f"sum({num('value')})", f"{landed_rows.replace('name', 'event_name')} AND {WEEK}")
    o["summary_quantiles"] = (
        f"SELECT name, count({num('value')}) AS numbers, true AS within FROM e WHERE {landed_rows} GROUP BY name")
    o["summary_distinct"] = (
        "SELECT service, CAST(count(DISTINCT user_id) AS DOUBLE) AS users, true AS within"
        f" FROM e WHERE {landed_rows} GROUP BY service")
    since = f"FROM e WHERE {landed_rows} AND level <> 'debug' AND {MS} >= TIMESTAMP '2024-01-03 10:20:30'"
    o["summary_discovery"] = (
        f"SELECT DISTINCT 'label' AS kind, service AS value {since}"
        f" UNION ALL SELECT DISTINCT 'key' AS kind, unnest(json_keys(data)) AS value {since}"
        f" UNION ALL SELECT DISTINCT 'value' AS kind, {txt('endpoint')} AS value {since} AND {txt('endpoint')} <> ''")
    o["sql_view_stored_lookup"] = (
        "SELECT trace_id, env, name, CASE WHEN env = 'production' THEN user_id ELSE '' END AS user_id FROM e"
        " WHERE trace_id = '00000000-0000-4000-8000-000000000007' AND (env <> 'production' OR user_id = '')")
    o["sql_functions_by_week"] = (
        f"SELECT {BUCKET['week']} AS week, {txt('endpoint')} AS endpoint, count(*) AS events, count({num('code')}) AS quoted,"
        f" round(coalesce(sum({num('value')}), 0.0), 6) AS total, round(coalesce({q(0.9)}, 0.0), 6) AS high"
        f" FROM e WHERE {num('k')} > 10 AND {txt('code')} <> '300' GROUP BY 1, 2")
    o["typed_sums"] = analytics(
        [txt("endpoint"), txt("code")], f"sum({num('value')})",
        where=f"{landed_rows} AND {num('value')} > 20 AND {txt('code')} <> '300'")
    o["ingest_insert_stamp"] = "SELECT count(*) AS events, count(*) AS stamped FROM e"
    o["sql_view_absent_column"] = (
        "SELECT env, count(*) AS events FROM e WHERE env <> 'production' OR user_id = '' GROUP BY env")
    o["search_page_positions"] = (
        "SELECT total, CASE WHEN 65 < total THEN 65 END AS next_offset, 15 AS prev_offset"
        " FROM (SELECT count(*) AS total FROM e WHERE env = 'production')")
    o["sql_view_trace_lookup"] = events_where(
        "trace_id = '00000000-0000-4000-8000-000000000007' AND timestamp >= TIMESTAMP '2024-01-01 00:00:00'")

    oracles = {name: on_events(sql) for name, sql in o.items()}
    oracles["timeseries_filled"] = on_filled(
        series("hour", [], "count(*)", f"event_name = 'purchase' AND service = 'svc_3' AND {WEEK}"),
        "2024-01-08 00:00:00", "2024-01-14 23:59:59", "HOUR", [])
    oracles["timeseries_filled_grouped"] = on_filled(
        series("hour", ["service", "env"], "count(*)", WEEK),
        "2024-01-08 00:00:00", "2024-01-14 23:59:59", "HOUR", ["group_0", "group_1"])
    oracles["timeseries_filled_week"] = on_filled(
        series("week", ["event_name"], f"sum({num('k')})", between("2023-12-01 00:00:00", "2024-02-20 00:00:00")),
        "2023-11-26 00:00:00", "2024-02-20 00:00:00", "WEEK", ["group_0"])
    oracles["timeseries_filled_empty"] = on_events(
        "SELECT CAST(bucket AS TIMESTAMP) AS bucket, CAST(NULL AS VARCHAR) AS group_0, '' AS name,"
        " CAST(0.0 AS DOUBLE) AS value"
        " FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-08 00:00:00', TIMESTAMP '2024-01-08 06:00:00',"
        " INTERVAL 1 HOUR)) AS bucket) WHERE NOT EXISTS (SELECT 1 FROM e WHERE service = 'no_such')")
    return oracles


ORACLES = _build()
