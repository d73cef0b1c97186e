"""Event-log operators. Each takes a batch or a streaming DataFrame and builds the same plan.

Streaming callers set a watermark first (``watermarked``), so state is bounded by the allowed lateness.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwise.operators import blocks
from tabwise.session import cut_lineage

# ---- Fixed values: alert rules ------------------------------------------------------------------
ERROR_BUDGET = 0.005
BURN_RULES = (("fast", "1 hour", 14.4), ("slow", "6 hours", 6.0))
LATENCY_BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)
PIPELINE_BUCKETS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0, 300.0)
TRACE_PREFIX = "PIPELINE_TRACE::"
# -------------------------------------------------------------------------------------------------


def watermarked(events: DataFrame, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Bound the state of a streaming plan; a watermark needs a zoned timestamp column."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late) if events.isStreaming else events


def job_status(events: DataFrame) -> DataFrame:
    """Fold of (job, ord, phase, percent, message) into the latest state of every job.

    A non-null percent or non-empty message replaces the former one; the last phase sets the status.
    """
    at = F.col("ord")
    last = lambda c, ok: F.max_by(c, F.when(ok, at))
    folded = events.groupBy("job").agg(
        last("phase", F.lit(True)).alias("last_phase"),
        last("phase", F.col("phase").isNotNull() & (F.col("phase") != "")).alias("named_phase"),
        last("percent", F.col("percent").isNotNull()).alias("percent"),
        last("message", F.coalesce(F.col("message"), F.lit("")) != "").alias("message"),
        last("message", F.col("phase") == "error").alias("error"),
        F.count(F.lit(1)).alias("events"),
    )
    p = F.col("last_phase")
    status = F.when(p == "done", "done").when(p == "cancelled", "cancelled").when(p == "error", "failed").otherwise("running")
    return folded.select("job", status.alias("status"), F.col("named_phase").alias("phase"), "percent", "message", "error", "events")


def first_submits(submits: DataFrame, keys: list[str], order: list[str], blocking: Column | None = None) -> DataFrame:
    """One live run per (session, content) key; failed and cancelled runs do not block a new one.

    Batch: the earliest blocking run per key. Streaming: the same keys, deduplicated within the watermark.
    """
    rows = submits.filter(blocking) if blocking is not None else submits
    if submits.isStreaming:
        return rows.dropDuplicatesWithinWatermark(keys)
    rest = [c for c in rows.columns if c not in keys]
    first = rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return first.select(*keys, "r.*").select(*rows.columns)


def parse_trace_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Log lines to (trace_id, timestamp, event_type, payload): after the prefix, or the {...} part of the line."""
    v = F.col(value)
    after = F.trim(F.expr(f"substring(`{value}`, locate('{TRACE_PREFIX}', `{value}`) + {len(TRACE_PREFIX)})"))
    schema = "trace_id string, timestamp string, event_type string, payload string"
    tagged = lines.filter(v.contains(TRACE_PREFIX))
    braces = F.regexp_extract(v, r"(\{.*\})", 1)
    parsed = tagged.select(F.coalesce(_json(after, schema), _json(braces, schema)).alias("e")).filter("e is not null")
    return parsed.select("e.*").filter(F.coalesce("trace_id", F.lit("")) != "")


def _json(text: Column, schema: str) -> Column:
    got = F.from_json(text, schema, {"mode": "PERMISSIVE"})
    return F.when(got["event_type"].isNotNull() | got["trace_id"].isNotNull(), got)


def trace_analysis(events: DataFrame) -> DataFrame:
    """Per trace: dataset, status, errors, first/last time, duration, KPI and chart counts, missing_eda.

    ``events``: (trace_id, timestamp, event_type, payload JSON text).
    """
    p = F.col("payload")
    get = lambda path: F.get_json_object(p, path)
    kind = F.col("event_type")
    ts = F.try_to_timestamp("timestamp")
    order = F.struct("timestamp", "event_type")
    last = lambda value, ok: F.max_by(value, F.when(ok & value.isNotNull(), order))
    name = F.when(kind == "initial_state", get("$.source_name")).when(kind == "profiling_decision", get("$.dataset_profile.source_name"))
    kpis = F.coalesce(F.json_array_length(get("$.kpis")), F.lit(0))
    # a stated count of 0 falls back to the length of the spec list
    stated = F.nullif(get("$.charts_suggested_count").try_cast("int"), F.lit(0))
    charts = F.coalesce(stated, F.json_array_length(get("$.specs")), F.lit(0))
    listed = F.when(kind == "pipeline_end", F.from_json(get("$.errors"), "array<string>"))
    single = F.when(F.coalesce(get("$.error"), F.lit("")) != "", F.array(get("$.error")))
    found = F.concat(F.coalesce(listed, F.array().cast("array<string>")), F.coalesce(single, F.array().cast("array<string>")))
    e = events.withColumn("found", found)
    out = e.groupBy("trace_id").agg(
        F.coalesce(last(name, name != ""), F.lit("unknown")).alias("dataset_name"),
        F.coalesce(last(F.when(kind == "pipeline_end", get("$.final_status")), kind == "pipeline_end"), F.lit("UNKNOWN")).alias("status"),
        F.sum(F.size("found")).alias("n_errors"),
        F.count(F.lit(1)).alias("n_events"),
        F.try_to_timestamp(F.min("timestamp")).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.coalesce(last(kpis, kind == "kpi_generation"), F.lit(0)).alias("kpi_count"),
        F.coalesce(last(charts, kind == "chart_selection"), F.lit(0)).alias("chart_count"),
    )
    seconds = (F.unix_micros("last_ts") - F.unix_micros("first_ts")) / 1e6
    return out.withColumn("duration_seconds", F.when(F.col("first_ts").isNotNull(), seconds)).withColumn(
        "missing_eda", (F.col("chart_count") == 0) & (F.col("kpi_count") == 0)
    )


def burn_rate(events: DataFrame, failed: Column, slide: str = "5 minutes", budget: float = ERROR_BUDGET, rules=BURN_RULES) -> DataFrame:
    """(rule, start, end, total, errors, ratio, firing) over sliding windows of 1 and 6 hours.

    Batch: events are counted per slide step once, windows then add up those few counts. Streaming: one
    windowed aggregation per rule, unioned.
    """
    parts = []
    for rule, size, factor in rules:
        base = events.select("ts", failed.cast("int").alias("bad"))
        if not events.isStreaming:
            base = base.groupBy(F.window("ts", slide).alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("b")).select(F.col("s.start").alias("ts"), "n", "b")
            total, errors = F.sum("n"), F.sum("b")
        else:
            total, errors = F.count(F.lit(1)), F.sum("bad")
        w = base.groupBy(F.window("ts", size, slide).alias("w")).agg(total.cast("bigint").alias("total"), errors.cast("bigint").alias("errors"))
        ratio = F.col("errors") / F.col("total")
        parts.append(
            w.select(F.lit(rule).alias("rule"), F.col("w.start").alias("start"), F.col("w.end").alias("end"), "total", "errors", ratio.alias("ratio"), (ratio > factor * budget).alias("firing"))
        )
    return reduce(DataFrame.unionByName, parts)


def bucket_bound(value: Column, bounds: tuple[float, ...]) -> Column:
    """Upper bound of the fixed bucket a measurement falls into (infinity past the last)."""
    out = F.lit(float("inf"))
    for b in reversed(bounds):
        out = F.when(value <= b, F.lit(b)).otherwise(out)
    return out


def windowed_quantile(events: DataFrame, value: str, size: str = "10 minutes", q: float = 0.95, bounds: tuple[float, ...] = LATENCY_BUCKETS, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., start, n, quantile): interpolated inside the fixed bucket that holds the rank.

    One aggregation of one counter per bucket; a value past the last bucket reports that bound.
    """
    counts = [F.count_if(F.col(value) <= b).alias(f"le{i}") for i, b in enumerate(bounds)]
    w = events.groupBy(F.window("ts", size).alias("w"), *by).agg(*counts, F.count(value).alias("n"))
    rank = F.lit(q) * F.col("n")
    out = F.lit(bounds[-1])
    for i in reversed(range(len(bounds))):
        low = bounds[i - 1] if i else 0.0
        before = F.col(f"le{i - 1}") if i else F.lit(0)
        inside = F.col(f"le{i}") - before
        value_ = F.lit(low) + F.lit(bounds[i] - low) * (rank - before) / F.when(inside == 0, 1).otherwise(inside)
        out = F.when(F.col(f"le{i}") >= rank, value_).otherwise(out)
    return w.filter("n > 0").select(*by, F.col("w.start").alias("start"), "n", out.alias("quantile"))


def sustained(events: DataFrame, value: str, threshold: float, hold: str = "5 minutes", step: str = "1 minute", block_steps: int = 500_000) -> DataFrame:
    """(start, stop, steps, low, firing): runs of steps in which the gauge stayed above ``threshold``.

    Samples are brought to one row per step first, so what is ordered grows with the time covered, not with the
    samples, in blocks that carry the run they end in. Steps without a sample keep what was last seen; a run fires once it has lasted for ``hold``.
    """
    ticks = events.filter(F.col(value).isNotNull()).groupBy(F.window("ts", step).start.alias("at")).agg(F.min(value).alias("low"))
    placed = blocks.numbered(blocks.in_order(ticks.withColumn("over", F.col("low") > threshold), ["at"], block_steps))
    line = Window.partitionBy("halo").orderBy("idx")
    near = blocks.with_halo(placed, "idx", 1, block_steps)
    turn = F.when(F.coalesce(F.lag("over").over(line) == F.col("over"), F.lit(False)), 0).otherwise(1)
    ended = near.withColumns({"turn": turn, "next": F.lead("at").over(line)}).filter("own").withColumn(blocks.BLOCK, F.col("halo").cast("int"))
    ended = cut_lineage(ended)
    before = blocks.starts(ended, _turns=F.sum("turn"))
    ended = ended.join(F.broadcast(before), blocks.BLOCK).withColumn("run", F.col("_turns") + F.sum("turn").over(line))
    runs = ended.filter("over").groupBy("run").agg(F.min("at").alias("start"), F.max(F.coalesce("next", "at")).alias("stop"), F.count(F.lit(1)).alias("steps"), F.min("low").alias("low"))
    return runs.select("start", "stop", "steps", "low", (F.col("stop") >= F.col("start") + F.expr(f"INTERVAL {hold}")).alias("firing"))


def rate_limit_violations(events: DataFrame, key: str, limit: int, size: str = "1 minute") -> DataFrame:
    """(key, start, n) windows in which a key exceeded its limit."""
    w = events.groupBy(F.window("ts", size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.filter(F.col("n") > limit).select(key, F.col("w.start").alias("start"), "n")


def newest_live(entries: DataFrame, key: str, now: Column, order: list[str], expires: str = "expires_at") -> DataFrame:
    """Newest entry of every key, if it has not expired by ``now``."""
    rest = [c for c in entries.columns if c != key]
    newest = entries.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return newest.select(key, "r.*").filter(F.col(expires) > now)


def after_cursor(events: DataFrame, key: str, order: list[str], since: int, slices: str | None = None) -> DataFrame:
    """Events of every key past its first ``since`` ones, in order.

    With ``slices`` (a column that never decreases along the order, such as the day) a key's events are
    numbered slice by slice: counts per slice give the offset, so a hot key is spread over tasks.
    """
    if slices is None:
        numbered = events.withColumn("seq", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
        return numbered.filter(F.col("seq") > since)
    per = events.groupBy(key, slices).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy(slices).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.withColumn("_off", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, slices).orderBy(*order))
    placed = events.withColumn("_in", inside).join(offsets, [key, slices])
    return placed.withColumn("seq", (F.col("_off") + F.col("_in")).cast("bigint")).filter(F.col("seq") > since).drop("_off", "_in")


def run_available(stream: DataFrame, mode: str, folder: str) -> DataFrame:
    """Drive a streaming plan over everything now available and return what it wrote (tests, backfills).

    Executors write every batch as Parquet under ``folder``, by batch number, so a batch that is run again replaces
    itself. In complete mode the last batch is the result, in append mode all of them together.
    """
    spark, rows = stream.sparkSession, f"{folder}/rows"

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{rows}/batch={number}")

    q = stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    written = spark.read.schema(stream.schema.add("batch", "long")).parquet(rows)
    if mode == "complete":
        written = written.filter(F.col("batch") == written.agg(F.max("batch")).first()[0])
    return written.drop("batch")
