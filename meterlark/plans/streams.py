"""Registered queries that run the streaming chain, the batch run and the sinks over scratch folders.

Each starts its streams on empty folders, waits until all there is has been read, and returns what was stored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterlark.operators import silver
from meterlark.plans import batch
from meterlark.plans.catalog import _CHECKED, _FLAGS, _MINUTE, _RAW, _clean, _raw, _round, _t, query
from meterlark.session import scratch_path
from meterlark.sources import adapter
from meterlark.sources.readers import stream_events_json
from meterlark.sources.schemas import SILVER_TABLE
from meterlark.streaming import runner
from meterlark.streaming.sinks import BatchTable, append_files, start

#: Lines of these events are broken in the landing folder.
BROKEN = "sequence_number % 40 = 5"
#: What is left of the raw events in Silver, and its closed minutes at a watermark of one minute.
_STORED = """,
stored AS (SELECT DISTINCT event_id, tenant_id, plan_tier, status_code, event_timestamp, billing_units, endpoint_id, api_key_id, was_rate_limited,
  CASE WHEN epoch_us(ingested_at) // 1000000 - epoch_us(event_timestamp) // 1000000 > 3600 THEN 'very_late'
  WHEN epoch_us(ingested_at) // 1000000 - epoch_us(event_timestamp) // 1000000 > 300 THEN 'late' ELSE 'on_time' END AS late_category FROM ruled WHERE len(flags) = 0 AND n % 40 <> 5),
closed AS (SELECT *, request_count * 100.0::DOUBLE / lim AS usage_percent, request_count > lim AS is_over_limit FROM (SELECT *,
  CASE plan_tier WHEN 'starter' THEN 300 WHEN 'professional' THEN 1000 WHEN 'enterprise' THEN 5000 ELSE 60 END::BIGINT AS lim FROM (SELECT tenant_id, date_trunc('minute', event_timestamp) AS window_start,
  count(*) AS request_count, sum(billing_units) AS billing_units, count(*) FILTER (status_code >= 400) AS error_count, count(DISTINCT endpoint_id) AS unique_endpoints,
  count(DISTINCT api_key_id) AS unique_api_keys, any_value(plan_tier) AS plan_tier FROM stored GROUP BY 1, 2)
  WHERE epoch_us(window_start) + 60000000 <= (SELECT max(epoch_us(event_timestamp)) // 1000 * 1000 - 60000000 FROM stored)))"""


def _landed(events: DataFrame) -> str:
    """Raw events as lines of JSON in a folder, some of them broken."""
    nested = adapter.nested_events(_raw(events))
    path = scratch_path(events.sparkSession, "landing")
    lines = nested.select(F.when(F.expr(BROKEN), "{broken").otherwise(F.to_json(F.struct(*nested.columns))).alias("value"))
    lines.write.text(path)
    return path


def _chain(events: DataFrame, layers: int, **options) -> runner.Paths:
    """Bronze, Silver and Gold (the first ``layers`` of them) of the landed events."""
    spark, chosen = events.sparkSession, runner.Options(watermark="1 minute", **options)
    paths, landing = runner.Paths(scratch_path(spark, "lake")), _landed(events)
    runner.run_bronze(spark, landing, paths, chosen).awaitTermination()
    if layers > 1:
        runner.run_silver(spark, paths, chosen).awaitTermination()
    if layers > 2:
        for q in runner.run_gold(spark, paths, chosen):
            q.awaitTermination()
    return paths


def _stored(paths: runner.Paths, name: str, spark) -> DataFrame:
    return paths.table(name).read(spark)


@query(f"SELECT event_id, tenant_id, plan_tier, status_code, {_t('event_timestamp')} AS event_timestamp, late_category FROM stored", _RAW, _FLAGS, _STORED)
def stream_silver(events):
    """Silver by streams: parsed, validated, flagged late, each event once."""
    rows = _stored(_chain(events, 2), "silver", events.sparkSession)
    return _round(rows.select("event_id", "tenant_id", "plan_tier", "status_code", "event_timestamp", F.col("_late_category").alias("late_category")))


@query("SELECT 'dead_letters' AS part, count(*) AS n FROM raw WHERE n % 40 = 5 UNION ALL SELECT 'bronze', count(*) FROM raw WHERE n % 40 <> 5", _RAW)
def stream_bronze(events):
    """Bronze and its dead letters by streams."""
    paths = _chain(events, 1)
    counted = lambda name: _stored(paths, name, events.sparkSession).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return counted("dead_letters").unionByName(counted("bronze"))


@query("SELECT event_id, array_to_string(flags, ',') AS quality_flags FROM ruled WHERE len(flags) > 0 AND n % 40 <> 5", _RAW, _FLAGS)
def stream_quarantine(events):
    rows = _stored(_chain(events, 2), "quarantine", events.sparkSession)
    return rows.select("event_id", F.array_join("_quality_flags", ",").alias("quality_flags"))


@query(f"""SELECT tenant_id, {_t('window_start')} AS window_start, request_count, round(billing_units, 6) AS billing_units, error_count, unique_endpoints, unique_api_keys, plan_tier,
lim AS limit_requests_per_min, is_over_limit FROM closed""", _RAW, _FLAGS, _STORED)
def stream_minutes(events):
    """The minute table by streams: windows that a watermark of one minute has closed."""
    rows = _stored(_chain(events, 3), "usage_minute", events.sparkSession)
    names = "tenant_id window_start request_count billing_units error_count unique_endpoints unique_api_keys plan_tier limit_requests_per_min is_over_limit"
    return _round(rows.select(*names.split()))


@query(f"""SELECT md5(tenant_id || chr(31) || epoch_us(window_start) || chr(31) || kind) AS alert_id, tenant_id, kind AS alert_type, {_t('window_start')} AS window_start, request_count,
CASE WHEN is_over_limit THEN 'critical' WHEN usage_percent >= 90 THEN 'warning' ELSE 'info' END AS severity FROM (SELECT *, CASE WHEN is_over_limit THEN 'over_limit' ELSE 'approaching_limit' END AS kind
FROM closed WHERE usage_percent >= 80)""", _RAW, _FLAGS, _STORED)
def stream_alerts(events):
    """The alerts raised beside the minute table."""
    rows = _stored(_chain(events, 3), "alerts", events.sparkSession)
    return _round(rows.select("alert_id", "tenant_id", "alert_type", "window_start", "request_count", "severity"))


@query("""SELECT 'silver' AS layer, count(*) AS total_records, count(*) FILTER (len(nulls) + len(vals) = 0) AS valid_records, count(*) FILTER (len(nulls) > 0) AS schema_errors,
count(*) FILTER (len(vals) > 0) AS value_errors FROM checked WHERE n % 40 <> 5""", _RAW, _CHECKED)
def stream_quality(events):
    """Quality metrics written beside Silver."""
    paths = _chain(events, 2, with_metrics=True)
    rows = BatchTable(f"{paths.root}/metrics/quality_metrics_silver").read(events.sparkSession)
    return rows.select("layer", "total_records", "valid_records", "schema_errors", "value_errors")


@query("""SELECT layer, count(*) AS batches, sum(n)::BIGINT AS record_count FROM (SELECT 'bronze' AS layer, count(*) AS n FROM raw UNION ALL SELECT 'silver', count(*) FROM raw WHERE n % 40 <> 5) GROUP BY 1""", _RAW)
def stream_health(events):
    """Health metrics written beside Bronze and Silver."""
    paths = _chain(events, 2, with_metrics=True)
    parts = [BatchTable(f"{paths.root}/metrics/observability_metrics_{layer}").read(events.sparkSession) for layer in ("bronze", "silver")]
    return parts[0].unionByName(parts[1]).groupBy("layer").agg(F.count("*").alias("batches"), F.sum("record_count").alias("record_count"))


@query(f"SELECT tenant_id, {_t('window_start')} AS window_start, request_count FROM minute", _MINUTE)
def stream_live_counts(events):
    """Counts in update mode: the last value of each key."""
    spark, root = events.sparkSession, scratch_path(events.sparkSession, "live")
    flat = _clean(events).select("tenant_id", "event_timestamp")
    flat.write.parquet(f"{root}/in/batch=0")
    counts = runner.live_counters(BatchTable(f"{root}/in").stream(spark, "tenant_id string, event_timestamp timestamp"))
    out = BatchTable(f"{root}/out")
    start(counts, f"{root}/checkpoint", out.write, "live", mode="update", reused=False).awaitTermination()
    last = out.read(spark).groupBy("tenant_id", F.col("w.start").alias("window_start")).agg(F.max_by("request_count", "batch").alias("request_count"))
    return _round(last)


@query("SELECT count(DISTINCT event_id) AS events, count(DISTINCT event_id) AS distinct_events FROM raw WHERE event_timestamp IS NOT NULL", _RAW)
def stream_bounded_dedup(events):
    """Duplicates dropped by bounded state, all within the watermark."""
    spark, root = events.sparkSession, scratch_path(events.sparkSession, "dedup")
    _raw(events).filter("event_timestamp is not null").select("event_id", "event_timestamp").write.parquet(f"{root}/in/batch=0")
    kept = silver.keep_first_streaming(BatchTable(f"{root}/in").stream(spark, "event_id string, event_timestamp timestamp"))
    append_files(kept, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/out").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("distinct_events"))


@query("SELECT strftime(event_timestamp, '%Y-%m-%d %H') AS event_hour, plan_tier, count(*) AS event_count, round(sum(billing_units), 6) AS billing_units FROM clean GROUP BY 1, 2")
def stream_json_files(events):
    """Events written as JSON lines, streamed by their schema and appended as partitioned Parquet."""
    spark, root = events.sparkSession, scratch_path(events.sparkSession, "files")
    batch.write_events(adapter.nested_events(_clean(events)), f"{root}/in")
    flat = silver.flatten(stream_events_json(spark, f"{root}/in")).withColumn("event_hour", F.date_format("event_timestamp", "yyyy-MM-dd HH"))
    append_files(flat.select("event_hour", "plan_tier", "billing_units"), f"{root}/out", f"{root}/checkpoint", ("event_hour",)).awaitTermination()
    stored = spark.read.schema("plan_tier string, billing_units double, event_hour string").parquet(f"{root}/out")
    return _round(stored.groupBy("event_hour", "plan_tier").agg(F.count("*").alias("event_count"), F.sum("billing_units").alias("billing_units")))


_BATCH = """,
kept AS (SELECT DISTINCT event_id, tenant_id, plan_tier, status_code, event_timestamp, billing_units, was_rate_limited, endpoint_path, http_method, n FROM raw
  WHERE tenant_id IS NOT NULL AND event_timestamp IS NOT NULL AND NOT coalesce(latency_ms < 0 OR latency_ms > 30000 OR risk_score > 100 OR billing_units < 0 OR status_code IS NULL, false))"""


@query("""SELECT tenant_id, plan_tier, count(*) AS total_requests, count(*) FILTER (status_code < 400) AS successful_requests, count(*) FILTER (was_rate_limited) AS rate_limited_count,
round(sum(billing_units), 6) AS total_billing_units FROM kept GROUP BY 1, 2""", _RAW, _BATCH)
def batch_tenant_usage(events):
    """The local run from JSON files to Gold: one of its tables."""
    root = scratch_path(events.sparkSession, "run")
    batch.write_events(adapter.nested_events(_raw(events)), f"{root}/in")
    rows = batch.run(events.sparkSession, f"{root}/in", f"{root}/out")["tenant_usage"]
    return _round(rows.select("tenant_id", "plan_tier", "total_requests", "successful_requests", "rate_limited_count", "total_billing_units"))


@query("""SELECT 'bronze' AS part, count(*) FILTER (tenant_id IS NOT NULL AND event_timestamp IS NOT NULL) AS n FROM raw
UNION ALL SELECT 'dlq', count(*) FILTER (tenant_id IS NULL OR event_timestamp IS NULL) FROM raw UNION ALL SELECT 'with_file', count(*) FILTER (tenant_id IS NOT NULL AND event_timestamp IS NOT NULL) FROM raw
UNION ALL SELECT 'with_batch', count(*) FILTER (tenant_id IS NOT NULL AND event_timestamp IS NOT NULL) FROM raw""", _RAW)
def batch_bronze(events):
    """The local run's first layer: the gate of required fields, the file and the batch of each row."""
    spark, root = events.sparkSession, scratch_path(events.sparkSession, "bronze")
    batch.write_events(adapter.nested_events(_raw(events)), f"{root}/in")
    good = batch.bronze_layer(spark, f"{root}/in", f"{root}/out", "run-7")
    counted = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return (
        counted(good, "bronze")
        .unionByName(counted(spark.read.parquet(f"{root}/out/bronze_dlq"), "dlq"))
        .unionByName(counted(good.filter(F.col("_source_file").endswith(".json")), "with_file"))
        .unionByName(counted(good.filter("_batch_id = 'run-7'"), "with_batch"))
    )

