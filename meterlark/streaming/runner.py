"""The streaming chain over folders: messages to Bronze, Silver and Gold.

Silver has no stateful operator: duplicates are found by joining a batch with what is stored, so late
rows are flagged and kept. Gold windows close with the watermark and lose later rows; ``reconcile`` in
``operators.gold`` recomputes them from Silver.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from meterlark.operators import alerts, bronze, gold, silver
from meterlark.sources.readers import as_source_rows, stream_messages, stream_text
from meterlark.sources.schemas import BRONZE_TABLE, HOUR_TABLE, MINUTE_TABLE, SILVER_TABLE, conform
from meterlark.streaming.monitor import Monitor
from meterlark.streaming.sinks import BatchTable, export_latest, same_days, start

log = logging.getLogger(__name__)

WATERMARK = "1 hour"


@dataclass(frozen=True)
class Paths:
    root: str
    checkpoints: str | None = None  # below the root unless given

    def table(self, name: str, *partition_by: str) -> BatchTable:
        return BatchTable(f"{self.root}/{name}", partition_by)

    def checkpoint(self, name: str) -> str:
        return f"{self.checkpoints or self.root + '/_checkpoints'}/{name}"


@dataclass(frozen=True)
class Options:
    """How the chain runs; times as Spark writes them."""

    interval: str | None = None  # a trigger to keep running with; without one everything there is, once
    max_files: int | None = None  # files of a batch at most
    watermark: str = WATERMARK
    brokers: str | None = None  # with them messages come from the broker's topic, not from a folder
    topic: str = "api-usage-events.v1"
    starting_offsets: str = "earliest"
    max_offsets: int | None = None
    with_metrics: bool = False  # quality and health tables beside each layer
    counters: str | None = None  # where the latest counts go, as JSON


def _monitored(options: Options, paths: Paths, layer: str, handle: Callable, history: str | None = None) -> Callable:
    if not options.with_metrics:
        return handle
    return Monitor(layer, f"{paths.root}/metrics", history=paths.table(history) if history else None).beside(handle)


def run_bronze(spark: SparkSession, landing: str, paths: Paths, options: Options = Options()) -> StreamingQuery:
    """Messages to Bronze, and those that don't parse to the dead letters, in one pass over the source."""
    table, letters = paths.table("bronze", "_event_date"), paths.table("dead_letters", "_dlq_date")

    def keep(batch: DataFrame, batch_id: int) -> None:
        table.write(bronze.valid(batch), batch_id)
        letters.write(bronze.dead_letters(batch), batch_id)

    if options.brokers:
        source = stream_messages(spark, options.brokers, options.topic, options.starting_offsets, options.max_offsets)
    else:
        source = as_source_rows(stream_text(spark, landing, options.max_files), options.topic)
    handle = _monitored(options, paths, "bronze", keep, "bronze")
    return start(bronze.to_bronze(source), paths.checkpoint("bronze"), handle, "bronze", options.interval)


def run_silver(spark: SparkSession, paths: Paths, options: Options = Options()) -> StreamingQuery:
    """Bronze to Silver and the quarantine: flatten, validate, flag late, insert if absent."""
    table, bad = paths.table("silver", "_event_date"), paths.table("quarantine", "_event_date")

    def keep(flat: DataFrame, batch_id: int) -> None:
        good, invalid = silver.validate(flat)
        rows = conform(silver.flag_late(good), SILVER_TABLE)
        table.insert_absent(rows, batch_id, order=("event_timestamp", "_source_partition", "_source_offset"), recent=same_days(rows, "_event_date"))
        bad.write(silver.quarantine(invalid), batch_id)

    handle = _monitored(options, paths, "silver", keep, "silver")
    rows = paths.table("bronze").stream(spark, BRONZE_TABLE(), options.max_files)
    return start(silver.flatten(rows), paths.checkpoint("silver"), handle, "silver", options.interval)


def run_gold(spark: SparkSession, paths: Paths, options: Options = Options()) -> list[StreamingQuery]:
    """Silver to the minute table with its alerts, and to the hour table, each with its own watermark."""
    source = lambda: paths.table("silver").stream(spark, SILVER_TABLE, options.max_files).withWatermark("event_timestamp", options.watermark)
    minutes, hours = paths.table("usage_minute", "_partition_date"), paths.table("usage_hour", "_partition_date")
    raised = paths.table("alerts", "_alert_date", "severity")

    def keep_minutes(batch: DataFrame, batch_id: int) -> None:
        # the alerts come from the rows just stored, so the windows are aggregated once
        minutes.write(conform(batch, MINUTE_TABLE).withColumn("_partition_date", F.to_date("window_start")), batch_id)
        stored = batch.sparkSession.read.schema(MINUTE_TABLE).parquet(f"{minutes.path}/batch={batch_id}")
        found = alerts.limit_alerts(stored).persist()
        try:
            raised.write(found.withColumn("_alert_date", F.to_date("window_start")), batch_id)
            counts = {r["severity"]: r["n"] for r in found.groupBy("severity").agg(F.count("*").alias("n")).collect()}
            if counts:
                log.log(logging.CRITICAL if "critical" in counts else logging.INFO, "minute batch %s: alerts %s", batch_id, counts)
        finally:
            found.unpersist()
        if options.counters:
            export_latest(stored).write.mode("overwrite").json(options.counters)

    def keep_hours(batch: DataFrame, batch_id: int) -> None:
        hours.write(conform(batch, HOUR_TABLE).withColumn("_partition_date", F.to_date("window_start")), batch_id)

    parts = {"usage_minute": (gold.minute_usage(source(), streaming=True), keep_minutes), "usage_hour": (gold.hourly_usage_streaming(source()), keep_hours)}
    return [start(df, paths.checkpoint(name), handle, name, options.interval, reused=False) for name, (df, handle) in parts.items()]


def live_counters(silver_stream: DataFrame) -> DataFrame:
    """Counts by tenant and minute for update mode: early numbers that later ones replace."""
    return silver_stream.groupBy("tenant_id", F.window("event_timestamp", "1 minute").alias("w")).agg(F.count("*").alias("request_count"))


def run_all(spark: SparkSession, landing: str, root: str, options: Options = Options(), checkpoints: str | None = None) -> Paths:
    """Everything there is now, layer by layer; any query's failure is raised."""
    paths, options = Paths(root, checkpoints), replace(options, interval=None)
    run_bronze(spark, landing, paths, options).awaitTermination()
    run_silver(spark, paths, options).awaitTermination()
    for query in run_gold(spark, paths, options):
        query.awaitTermination()
    return paths


def run_forever(spark: SparkSession, landing: str, root: str, options: Options = Options(interval="1 minute"), checkpoints: str | None = None) -> None:
    """All queries side by side until one of them stops."""
    paths = Paths(root, checkpoints)
    run_bronze(spark, landing, paths, options)
    run_silver(spark, paths, options)
    run_gold(spark, paths, options)
    spark.streams.awaitAnyTermination()
