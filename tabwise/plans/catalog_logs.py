"""Queries: event-log operators, in batch and as Structured Streaming over the same events."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabwise.plans.catalog import load, query, rounded
from tabwise.session import shared_dir
from tabwise.streaming import logs


def event_stream(spark, d, glob: str = "events.parquet"):
    """The events table as a file-source stream."""
    schema = load(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", 1).parquet(d)


def drain(stream, mode: str):
    run = uuid.uuid4().hex
    out = logs.run_available(stream, mode, f"{shared_dir(stream.sparkSession).rstrip('/')}/stream-{run}")
    zoned = [f.name for f in out.schema.fields if f.dataType.typeName() == "timestamp"]
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in zoned})


# ---------------------------------------------------------------- R1 status fold


def _jobs(events):
    phase = F.when(F.col("event_type") == "purchase", "done").when(F.col("event_type") == "signup", "cancelled").otherwise(F.col("event_type"))
    return events.select(
        F.col("user_id").alias("job"), F.col("event_id").alias("ord"), phase.alias("phase"), F.when(F.col("event_type") != "view", F.col("value")).alias("percent"),
        F.when(F.col("event_id") % 3 > 0, F.col("props")).otherwise("").alias("message"),
    )


_JOBS = """(SELECT user_id AS job, event_id AS ord, CASE event_type WHEN 'purchase' THEN 'done' WHEN 'signup' THEN 'cancelled' ELSE event_type END AS phase,
    CASE WHEN event_type <> 'view' THEN value END AS percent, CASE WHEN event_id % 3 > 0 THEN props ELSE '' END AS message FROM events)"""
_R1 = f"""SELECT job, CASE arg_max(phase, ord) WHEN 'done' THEN 'done' WHEN 'cancelled' THEN 'cancelled' WHEN 'error' THEN 'failed' ELSE 'running' END AS status, arg_max(phase, ord) AS phase,
    arg_max(percent, ord) FILTER (WHERE percent IS NOT NULL) AS percent, arg_max(message, ord) FILTER (WHERE message <> '') AS message, arg_max(message, ord) FILTER (WHERE phase = 'error') AS error, count(*) AS events FROM {_JOBS} GROUP BY job"""


@query("r1_status_fold", _R1)
def r1(spark, d):
    return logs.job_status(_jobs(load(spark, d, "events")))


@query("r1_status_fold_stream", _R1)
def r1_stream(spark, d):
    return drain(logs.job_status(_jobs(event_stream(spark, d))), "complete")


# ---------------------------------------------------------------- R2 idempotent submits


@query("r2_idempotent", "SELECT user_id, props, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS rn FROM events WHERE event_type NOT IN ('error', 'signup')) WHERE rn = 1")
def r2(spark, d):
    rows = load(spark, d, "events").select("user_id", "props", "event_id", "event_type")
    return logs.first_submits(rows, ["user_id", "props"], ["event_id"], ~F.col("event_type").isin("error", "signup"))


@query("r2_idempotent_stream", "SELECT DISTINCT user_id, props FROM events WHERE event_type NOT IN ('error', 'signup')")
def r2_stream(spark, d):
    rows = logs.watermarked(event_stream(spark, d), late="60 days").select("ts", "user_id", "props", "event_type")
    kept = logs.first_submits(rows, ["user_id", "props"], [], ~F.col("event_type").isin("error", "signup"))
    return drain(kept.select("user_id", "props"), "append")


# ---------------------------------------------------------------- R3 trace logs


def _trace_lines(spark, d):
    """Every event written as a log line; every fifth with noise around its JSON."""
    k, kind = F.regexp_extract("props", r"([0-9]+)", 1), F.col("event_type")
    payload = (
        F.when(kind == "click", F.concat(F.lit('{"source_name": "file'), k, F.lit('.csv", "shape": [10, 2]}')))
        .when(kind == "view", F.concat(F.lit('{"kpis": ['), F.array_join(F.slice(F.array(*[F.lit(x) for x in ("1", "2", "3")]), F.lit(1), (F.col("event_id") % 4).cast("int")), ", "), F.lit("]}")))
        .when(kind == "purchase", F.concat(F.lit('{"charts_suggested_count": '), (F.col("event_id") % 7).cast("string"), F.lit("}")))
        .when(kind == "signup", F.lit('{"final_status": "SUCCESS", "errors": ["late", "thin"]}'))
        .otherwise(F.lit('{"error": "boom"}'))
    )
    name = (
        F.when(kind == "click", "initial_state").when(kind == "view", "kpi_generation").when(kind == "purchase", "chart_selection").when(kind == "signup", "pipeline_end").otherwise("custom_event_x")
    )
    ts = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    body = F.concat(F.lit('{"trace_id": "u'), F.col("user_id").cast("string"), F.lit('", "timestamp": "'), ts, F.lit('", "event_type": "'), name, F.lit('", "payload": '), payload, F.lit("}"))
    line = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("INFO PIPELINE_TRACE:: note "), body, F.lit(" tail"))).otherwise(F.concat(F.lit("PIPELINE_TRACE::"), body))
    return load(spark, d, "events").select(line.alias("value"))


_R3 = """SELECT 'u' || user_id AS trace_id, coalesce(arg_max('file' || regexp_extract(props, '([0-9]+)', 1) || '.csv', ts) FILTER (WHERE event_type = 'click'), 'unknown') AS dataset_name,
    CASE WHEN bool_or(event_type = 'signup') THEN 'SUCCESS' ELSE 'UNKNOWN' END AS status, sum(CASE event_type WHEN 'signup' THEN 2 WHEN 'error' THEN 1 ELSE 0 END)::BIGINT AS n_errors, count(*) AS n_events,
    coalesce(arg_max((event_id % 4)::INT, ts) FILTER (WHERE event_type = 'view'), 0) AS kpi_count, coalesce(arg_max((event_id % 7)::INT, ts) FILTER (WHERE event_type = 'purchase'), 0) AS chart_count,
    round(epoch_us(max(ts)) / 1e6 - epoch_us(min(ts)) / 1e6, 4) AS duration_seconds FROM events GROUP BY user_id"""


@query("r3_trace", f"SELECT *, chart_count = 0 AND kpi_count = 0 AS missing_eda FROM ({_R3})")
def r3(spark, d):
    out = logs.trace_analysis(logs.parse_trace_lines(_trace_lines(spark, d)))
    return rounded(out.drop("first_ts", "last_ts"), duration_seconds=4)


@query("f19_json_lines", "SELECT 'u' || user_id AS trace_id, CASE event_type WHEN 'click' THEN 'initial_state' WHEN 'view' THEN 'kpi_generation' WHEN 'purchase' THEN 'chart_selection' WHEN 'signup' THEN 'pipeline_end' ELSE 'custom_event_x' END AS event_type, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp FROM events")
def f19(spark, d):
    return logs.parse_trace_lines(_trace_lines(spark, d)).select("trace_id", "event_type", "timestamp")


# ---------------------------------------------------------------- R4 burn rate

_R4 = """WITH b AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS t, count(*) AS n, count_if(event_type = 'error') AS e FROM events GROUP BY 1),
    r(rule, steps, factor) AS (VALUES ('fast', 12, 14.4), ('slow', 72, 6.0)), x AS (SELECT rule, factor, steps, t - k * INTERVAL 5 MINUTE AS start, n, e FROM b, r, range(72) u(k) WHERE k < steps)
    SELECT rule, start, start + any_value(steps) * INTERVAL 5 MINUTE AS "end", sum(n)::BIGINT AS total, sum(e)::BIGINT AS errors, round(sum(e)::DOUBLE / sum(n), 8) AS ratio, sum(e)::DOUBLE / sum(n) > any_value(factor) * 0.005 AS firing FROM x GROUP BY rule, start"""


@query("r4_burn_rate", _R4)
def r4(spark, d):
    return rounded(logs.burn_rate(load(spark, d, "events"), F.col("event_type") == "error"), ratio=8)


@query("r4_burn_rate_stream", _R4)
def r4_stream(spark, d):
    stream = logs.watermarked(event_stream(spark, d))
    parts = None
    for rule in logs.BURN_RULES:
        one = drain(logs.burn_rate(stream, F.col("event_type") == "error", rules=(rule,)), "complete")
        parts = one if parts is None else parts.unionByName(one)
    return rounded(parts, ratio=8)


# ---------------------------------------------------------------- R5 quantile from buckets


def _quantile_sql(bounds, q=0.95):
    les = ", ".join(f"count_if(value <= {b}) AS le{i}" for i, b in enumerate(bounds))
    cases = " ".join(
        f"WHEN le{i} >= {q} * n THEN {bounds[i - 1] if i else 0.0}::DOUBLE + ({b - (bounds[i - 1] if i else 0.0)})::DOUBLE * ({q} * n - {f'le{i - 1}' if i else 0}) / greatest(le{i} - {f'le{i - 1}' if i else 0}, 1)" for i, b in enumerate(bounds)
    )
    return f"SELECT event_type, start, n, round(CASE {cases} ELSE {bounds[-1]} END, 6) AS quantile FROM (SELECT event_type, time_bucket(INTERVAL 6 HOUR, ts) AS start, count(value) AS n, {les} FROM events GROUP BY ALL)"


@query("r5_p95", _quantile_sql(logs.PIPELINE_BUCKETS))
def r5(spark, d):
    return rounded(logs.windowed_quantile(load(spark, d, "events"), "value", "6 hours", bounds=logs.PIPELINE_BUCKETS, by=("event_type",)), quantile=6)


@query("r5_p95_stream", _quantile_sql(logs.PIPELINE_BUCKETS))
def r5_stream(spark, d):
    stream = logs.watermarked(event_stream(spark, d))
    return rounded(drain(logs.windowed_quantile(stream, "value", "6 hours", bounds=logs.PIPELINE_BUCKETS, by=("event_type",)), "complete"), quantile=6)


# ---------------------------------------------------------------- R6 - R9


@query(
    "r6_sustained",
    """WITH t AS (SELECT time_bucket(INTERVAL 1 MINUTE, ts) AS tick, min(value) AS low FROM events WHERE value IS NOT NULL GROUP BY 1),
    n AS (SELECT tick, low, low > 50 AS hot, lead(tick) OVER (ORDER BY tick) AS later, row_number() OVER (ORDER BY tick) - row_number() OVER (PARTITION BY low > 50 ORDER BY tick) AS run FROM t)
    SELECT min(tick) AS start, max(coalesce(later, tick)) AS stop, count(*) AS steps, min(low) AS low, max(coalesce(later, tick)) >= min(tick) + INTERVAL 5 MINUTE AS firing FROM n WHERE hot GROUP BY run""",
)
def r6(spark, d):
    return logs.sustained(load(spark, d, "events"), "value", 50.0)


_R7 = "SELECT user_id, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1"


@query("r7_rate_limit", _R7)
def r7(spark, d):
    return logs.rate_limit_violations(load(spark, d, "events"), "user_id", 1, "1 hour")


@query("r7_rate_limit_stream", _R7)
def r7_stream(spark, d):
    return drain(logs.rate_limit_violations(logs.watermarked(event_stream(spark, d)), "user_id", 1, "1 hour"), "complete")


@query("r8_ttl", "SELECT user_id, event_id, expires_at FROM (SELECT user_id, event_id, ts + (event_id % 97) * INTERVAL 1 HOUR AS expires_at, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1 AND expires_at > TIMESTAMP '2024-01-31 12:00:00'")
def r8(spark, d):
    e = load(spark, d, "events")
    hours = F.make_dt_interval(F.lit(0), (F.col("event_id") % 97).cast("int"))
    entries = e.select("user_id", "event_id", "ts", (F.col("ts") + hours).alias("expires_at"))
    now = F.lit("2024-01-31 12:00:00").cast("timestamp_ntz")
    return logs.newest_live(entries, "user_id", now, ["ts", "event_id"]).drop("ts")


@query("r9_cursor", "SELECT user_id, event_id, seq FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq > 20")
def r9(spark, d):
    e = load(spark, d, "events").withColumn("day", F.to_date("ts"))
    return logs.after_cursor(e, "user_id", ["ts", "event_id"], 20, slices="day").select("user_id", "event_id", "seq")
