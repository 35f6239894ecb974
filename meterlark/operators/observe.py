"""Pipeline health: metrics of a batch, threshold alerts and reports over the metrics table."""

from __future__ import annotations

import time as clock
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.functions.ids import stable_id
from meterlark.functions.times import parse_time, seconds

METRICS_TABLE = (
    "metric_timestamp timestamp, layer string, app_name string, batch_id bigint, record_count bigint, valid_records bigint, invalid_records bigint, "
    "batch_duration_sec double, throughput_rec_per_sec double, avg_processing_lag_sec double, data_freshness_sec double, kafka_lag_messages bigint, "
    "error_rate_pct double, quality_pass_rate_pct double, min_event_time timestamp, max_event_time timestamp"
)


@dataclass(frozen=True)
class Thresholds:
    """(warning, critical) for each figure; with ``low`` figures smaller is worse."""

    processing_lag: tuple = (60, 300)
    data_freshness: tuple = (120, 600)
    kafka_lag: tuple = (10_000, 50_000)
    throughput: tuple = (100.0, 10.0)
    error_rate: tuple = (1.0, 5.0)
    quality_pass_rate: tuple = (95.0, 80.0)
    batch_duration: tuple = (30, 120)


#: Alert family: column of the metrics table, and whether smaller is worse.
FAMILIES = {
    "processing_lag": ("avg_processing_lag_sec", False),
    "data_freshness": ("data_freshness_sec", False),
    "kafka_lag": ("kafka_lag_messages", False),
    "throughput": ("throughput_rec_per_sec", True),
    "error_rate": ("error_rate_pct", False),
    "quality_pass_rate": ("quality_pass_rate_pct", True),
    "batch_duration": ("batch_duration_sec", False),
}

#: Lag limits by layer.
LAYERS = {
    "bronze": Thresholds(),
    "silver": replace(Thresholds(), processing_lag=(120, 600)),
    "gold": replace(Thresholds(), processing_lag=(180, 900)),
}


def batch_metrics(batch: DataFrame, layer: str, batch_id: int, as_of: Column, duration_s: float = 1.0, app: str = "meterlark", time: str = "event_timestamp", latest_offsets: DataFrame | None = None) -> DataFrame:
    """One row of figures of a batch, in one pass over it.

    ``latest_offsets`` (partition, latest) gives the source's ends, for the lag in messages.
    """
    checked = "quality_check_passed" in batch.columns
    has_time = time in batch.columns
    moment = F.col(time) if has_time else F.lit(None).cast("timestamp")
    if has_time and dict(batch.dtypes)[time] == "string":  # Bronze keeps the time as text
        moment = parse_time(moment)
    lag = seconds(as_of) - seconds(moment)
    figures = batch.agg(
        F.count("*").alias("record_count"),
        (F.count_if("quality_check_passed") if checked else F.count("*")).alias("valid_records"),
        F.avg(lag).alias("avg_processing_lag_sec"),
        F.min(moment).alias("min_event_time"),
        F.max(moment).alias("max_event_time"),
    )
    figures = figures.withColumn("kafka_lag_messages", F.lit(None).cast("long"))
    if latest_offsets is not None and {"_source_partition", "_source_offset"} <= set(batch.columns):
        done = batch.groupBy(F.col("_source_partition").alias("partition")).agg(F.max("_source_offset").alias("done"))
        behind = latest_offsets.join(done, "partition", "left").agg(
            F.sum(F.greatest(F.col("latest") - F.coalesce("done", F.lit(-1)), F.lit(0))).alias("kafka_lag_messages")
        )
        figures = figures.drop("kafka_lag_messages").crossJoin(F.broadcast(behind))
    n = F.col("record_count")
    share = lambda part, empty: F.when(n == 0, empty).otherwise(F.try_divide(part * 100.0, n))
    bad = n - F.col("valid_records")
    return figures.select(
        as_of.alias("metric_timestamp"),
        F.lit(layer).alias("layer"),
        F.lit(app).alias("app_name"),
        F.lit(batch_id).cast("long").alias("batch_id"),
        "record_count",
        "valid_records",
        bad.alias("invalid_records"),
        F.lit(float(duration_s)).alias("batch_duration_sec"),
        (F.try_divide(n.cast("double"), F.lit(float(duration_s)))).alias("throughput_rec_per_sec"),
        "avg_processing_lag_sec",
        (seconds(as_of) - seconds(F.col("max_event_time"))).cast("double").alias("data_freshness_sec"),
        "kafka_lag_messages",
        share(bad, 0.0).alias("error_rate_pct"),
        share(F.col("valid_records"), 100.0).alias("quality_pass_rate_pct"),
        "min_event_time",
        "max_event_time",
    )


def threshold_alerts(metrics: DataFrame, thresholds: Thresholds | None = None, families: tuple = tuple(FAMILIES)) -> DataFrame:
    """A row for each of the families whose figure reaches a threshold; the critical one hides the warning."""
    found = []
    for family in families:
        column, low = FAMILIES[family]
        warning, critical = getattr(thresholds or Thresholds(), family)
        value = F.col(column).cast("double")
        beyond = lambda limit: value <= limit if low else value >= limit  # noqa: B023, E731
        entry = lambda severity, limit: F.struct(
            F.lit(f"{family}_{severity}").alias("alert_type"),  # noqa: B023
            F.lit(severity).alias("severity"),
            value.alias("metric_value"),  # noqa: B023
            F.lit(float(limit)).alias("threshold"),
        )
        found.append(F.when(beyond(critical), entry("critical", critical)).when(beyond(warning), entry("warning", warning)))
    app = F.col("app_name") if "app_name" in metrics.columns else F.lit(None).cast("string")
    each = metrics.select("metric_timestamp", "layer", app.alias("app_name"), "batch_id", F.explode(F.array_compact(F.array(*found))).alias("a"))
    message = F.concat_ws(" ", F.col("layer"), F.replace("a.alert_type", F.lit("_"), F.lit(" ")), F.lit("at"), F.col("a.metric_value").cast("string"), F.lit("against"), F.col("a.threshold").cast("string"))
    return each.select(
        stable_id(F.col("layer"), F.col("batch_id"), F.col("a.alert_type")).alias("alert_id"),
        F.col("metric_timestamp").alias("alert_timestamp"),
        "layer",
        "app_name",
        "batch_id",
        "a.*",
        message.alias("message"),
    )


@contextmanager
def timed() -> Iterator[dict]:
    """Duration of the body, in ``duration_s`` afterwards."""
    out, start = {}, clock.monotonic()
    try:
        yield out
    finally:
        out["duration_s"] = clock.monotonic() - start


def _recent(table: DataFrame, time: str, as_of: Column, hours: float) -> DataFrame:
    return table.filter(F.col(time) >= F.timestamp_micros((F.unix_micros(as_of) - hours * 3_600_000_000).cast("long")))


def health_summary(metrics: DataFrame, as_of: Column, hours: float = 24) -> DataFrame:
    """Figures by layer, in order of layers (a handful of rows)."""
    figures = {
        "avg_throughput": (F.avg, "throughput_rec_per_sec"),
        "avg_batch_duration": (F.avg, "batch_duration_sec"),
        "avg_processing_lag": (F.avg, "avg_processing_lag_sec"),
        "avg_data_freshness": (F.avg, "data_freshness_sec"),
        "avg_quality_pass_rate": (F.avg, "quality_pass_rate_pct"),
        "max_data_freshness": (F.max, "data_freshness_sec"),
        "max_processing_lag": (F.max, "avg_processing_lag_sec"),
    }
    totals = F.count_distinct("batch_id").alias("total_batches"), F.sum("record_count").alias("total_records")
    found = _recent(metrics, "metric_timestamp", as_of, hours).groupBy("layer").agg(*totals, *[f(c).alias(n) for n, (f, c) in figures.items()])
    return found.orderBy("layer")


def recent_alerts(alerts: DataFrame, as_of: Column, hours: float = 24, severity: str | None = None) -> DataFrame:
    """Alerts of the last ``hours``, the latest first."""
    found = _recent(alerts, "alert_timestamp", as_of, hours)
    return (found if severity is None else found.filter(F.col("severity") == severity)).orderBy(F.desc("alert_timestamp"), "layer", "alert_type")


def pipeline_status(metrics: DataFrame, as_of: Column, minutes: float = 5) -> DataFrame:
    """One row over the last ``minutes``: the status by mean lag and freshness, mean throughput and quality.

    Nothing within the limits (no row, or no lag known) is Unhealthy.
    """
    lag, age = F.avg("avg_processing_lag_sec"), F.avg("data_freshness_sec")
    below = lambda k: (lag < Thresholds.processing_lag[k]) & (age < Thresholds.data_freshness[k])
    return _recent(metrics, "metric_timestamp", as_of, minutes / 60).agg(
        F.when(below(0), "Healthy").when(below(1), "Degraded").otherwise("Unhealthy").alias("pipeline_status"),
        F.avg("throughput_rec_per_sec").alias("avg_throughput"),
        F.avg("quality_pass_rate_pct").alias("avg_quality"),
    )


def layer_status(metrics: DataFrame) -> DataFrame:
    """Each layer's latest batch: Unhealthy at a critical figure, Degraded at a warning, else Healthy."""
    last = Window.partitionBy("layer").orderBy(F.desc("metric_timestamp"), F.desc("batch_id"))
    latest = metrics.withColumn("_rn", F.row_number().over(last)).filter("_rn = 1")
    beyond = lambda k: F.coalesce(
        (F.col("avg_processing_lag_sec") >= Thresholds.processing_lag[k])
        | (F.col("error_rate_pct") >= Thresholds.error_rate[k])
        | (F.col("quality_pass_rate_pct") <= Thresholds.quality_pass_rate[k]),
        F.lit(False),
    )
    return latest.select("layer", "batch_id", F.when(beyond(1), "Unhealthy").when(beyond(0), "Degraded").otherwise("Healthy").alias("status"))


def freshness_status(metrics: DataFrame, only_violations: bool = False) -> DataFrame:
    warning, critical = Thresholds.data_freshness
    age = F.col("data_freshness_sec")
    status = F.when(age >= critical, "CRITICAL").when(age >= warning, "WARNING").otherwise("OK")
    out = metrics.select("layer", "batch_id", "data_freshness_sec", status.alias("status"))
    return out.filter(age >= warning) if only_violations else out


def lag_percentiles(metrics: DataFrame) -> DataFrame:
    lag = "avg_processing_lag_sec"
    return metrics.groupBy("layer").agg(F.avg(lag).alias("avg_lag_sec"), F.max(lag).alias("max_lag_sec"), F.percentile_approx(lag, 0.95).alias("p95_lag_sec"))


def hourly_metrics(metrics: DataFrame, column: str = "avg_processing_lag_sec") -> DataFrame:
    return metrics.groupBy(F.date_trunc("hour", "metric_timestamp").alias("hour"), "layer").agg(F.avg(column).alias("avg_value"), F.max(column).alias("max_value"))


def deviations(metrics: DataFrame, column: str = "avg_processing_lag_sec", factor: float = 3.0) -> DataFrame:
    """Batches beyond ``factor`` times their layer's median."""
    base = metrics.groupBy("layer").agg(F.percentile_approx(column, 0.5).alias("median"))
    return metrics.join(base, "layer").filter(F.col(column) > factor * F.col("median")).select("layer", "batch_id", F.col(column).alias("value"), "median")


def noisiest_layers(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("layer").agg(F.count("*").alias("alert_count"), F.count_if(F.col("severity") == "critical").alias("critical_count"))
