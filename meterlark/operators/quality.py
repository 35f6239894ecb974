"""Data quality: checks by layer, volume anomalies, metrics and the alerts they raise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.functions.ids import stable_id
from meterlark.functions.once import once
from meterlark.functions.rules import Rule, in_range, one_of, violations

#: Fields that a layer's rows must have.
CRITICAL = {
    "bronze": ("event_id", "event_timestamp", "tenant_id", "_source_partition", "_source_offset"),
    "silver": ("event_id", "event_timestamp", "tenant_id", "api_key_id", "endpoint_id", "http_method", "status_code", "plan_tier"),
    "gold": ("tenant_id", "window_start", "window_end", "request_count", "plan_tier"),
}
#: Ranges, both ends included.
RANGES = {
    "status_code": (100, 599),
    "latency_ms": (0, 300_000),
    "request_size_bytes": (0, 100_000_000),
    "response_size_bytes": (0, 500_000_000),
    "risk_score": (0.0, 100.0),
    "velocity_1min": (0, 10_000),
    "velocity_5min": (0, 50_000),
}
#: Enumerations.
ENUMS = {
    "http_method": ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"),
    "plan_tier": ("free", "starter", "professional", "enterprise"),
    "rate_limit_status": ("allowed", "rate_limited", "quota_exceeded"),
    "abuse_detected": ("true", "false"),  # NULL is allowed: no check was made
}
Z_ANOMALY, Z_CRITICAL, MIN_WINDOWS = 3.0, 4.0, 12
PASS_WARNING, PASS_CRITICAL = 0.95, 0.80


def schema_rules(columns: list[str], layer: str) -> list[Rule]:
    """A critical field that is no column is missing in every row; one that is NULL is null there."""
    return [
        Rule(f"null_{c}", F.col(c).isNull(), "schema") if c in columns else Rule(f"missing_{c}", F.lit(True), "schema")
        for c in CRITICAL[layer]
    ]


def null_rules(columns: list[str], layer: str) -> list[Rule]:
    return [Rule(f"null_{c}", F.col(c).isNull(), "null") for c in CRITICAL[layer] if c in columns]


def value_rules(columns: list[str]) -> list[Rule]:
    rules = [in_range(c, *limits) for c, limits in RANGES.items() if c in columns]
    rules += [one_of(c, values) for c, values in ENUMS.items() if c in columns]
    if {"event_timestamp", "ingested_at"} <= set(columns):
        rules.append(Rule("event_after_ingestion", F.col("event_timestamp") > F.col("ingested_at"), "value"))
    if "tenant_id" in columns:
        rules.append(Rule("empty_tenant_id", F.length("tenant_id") == 0, "value"))
    if "event_id" in columns:
        rules.append(Rule("invalid_event_id_length", F.length("event_id") != 36, "value"))
    return rules


#: Formats that the contract asks of some fields, for ``format_rules``.
FORMATS = {
    "event_id": r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "event_version": r"^\d+\.\d+\.\d+$",
    "country_code": r"^[A-Z]{2}$",
    "endpoint_path": r"^/",
}


def format_rules(columns: list[str]) -> list[Rule]:
    return [Rule(f"invalid_format_{c}", ~F.col(c).rlike(p), "value") for c, p in FORMATS.items() if c in columns]


def check(df: DataFrame, layer: str, at: Column | None = None, formats: bool = False) -> DataFrame:
    """Adds ``quality_check_passed``, the map ``quality_check_errors`` and ``quality_check_timestamp``."""
    columns = df.columns
    more = format_rules(columns) if formats else []
    found = {
        "schema_errors": violations(schema_rules(columns, layer)),
        "value_errors": violations(value_rules(columns) + more),
        "null_fields": violations(null_rules(columns, layer)),
    }
    errors = F.create_map(*[x for name, column in found.items() for x in (F.lit(name), column)])
    checked = once(df, "quality_check_errors", errors)
    none = [F.size(F.col("quality_check_errors")[name]) == 0 for name in found]
    return checked.withColumns(
        {"quality_check_passed": none[0] & none[1] & none[2], "quality_check_timestamp": F.current_timestamp() if at is None else at}
    )


def split_checked(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.filter("quality_check_passed"), checked.filter("not quality_check_passed")


def error_counts(checked: DataFrame, n: int | None = None) -> DataFrame:
    """Rows per error name, most frequent first, ties by name."""
    each = checked.select(F.explode(F.flatten(F.map_values("quality_check_errors"))).alias("error"))
    counts = each.groupBy("error").agg(F.count("*").alias("error_count"))
    return counts if n is None else counts.orderBy(F.desc("error_count"), "error").limit(n)


def error_share(checked: DataFrame) -> DataFrame:
    """Error counts with their share of all errors and of all rows."""
    counts = error_counts(checked)
    # one row beside few rows
    total = F.broadcast(checked.agg(F.count("*").alias("rows")))
    shares = counts.crossJoin(total)
    return shares.select(
        "error",
        "error_count",
        F.round(F.col("error_count") * 100.0 / F.sum("error_count").over(Window.partitionBy()), 2).alias("percent_of_errors"),
        F.round(F.try_divide(F.col("error_count") * 100.0, F.col("rows")), 2).alias("percent_of_rows"),
    )


def with_error_like(checked: DataFrame, pattern: str, category: str = "null_fields") -> DataFrame:
    return checked.filter(F.exists(F.col("quality_check_errors")[category], lambda x: x.like(pattern)))


def with_error(checked: DataFrame, name: str, category: str = "value_errors") -> DataFrame:
    return checked.filter(F.array_contains(F.col("quality_check_errors")[category], name))


def hourly_trend(checked: DataFrame, time: str = "event_timestamp") -> DataFrame:
    return checked.groupBy(F.date_trunc("hour", time).alias("hour")).agg(
        F.count("*").alias("total_records"), F.count_if("quality_check_passed").alias("valid_records")
    )


#: Figure of a metrics row: the category of errors whose rows it counts.
ERROR_ROWS = {"schema_errors": "schema_errors", "value_errors": "value_errors", "null_errors": "null_fields"}


def pass_rates(checked: DataFrame, layer: str, *by: str) -> DataFrame:
    """Totals, pass rate (1 without rows) and rows with errors of each category, one row or one for each ``by``."""
    rows = [F.count_if(F.size(F.col("quality_check_errors")[c]) > 0).alias(n) for n, c in ERROR_ROWS.items()]
    totals = checked.groupBy(*by).agg(F.count("*").alias("total_records"), F.count_if("quality_check_passed").alias("valid_records"), *rows)
    return totals.select(
        F.lit(layer).alias("layer"),
        *by,
        "total_records",
        "valid_records",
        (F.col("total_records") - F.col("valid_records")).alias("invalid_records"),
        F.when(F.col("total_records") == 0, 1.0).otherwise(F.try_divide("valid_records", "total_records")).alias("quality_pass_rate"),
        *ERROR_ROWS,
    )


def quality_metrics(checked: DataFrame, layer: str, top: int = 10) -> DataFrame:
    """``pass_rates`` of all rows beside the ``top`` errors by name, and how many kinds of errors there are."""
    counts = error_counts(checked)
    listed = counts.agg(
        F.count("*").alias("distinct_error_kinds"),
        F.map_from_entries(
            F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("error_count")).alias("n"), "error"))), 1, top), lambda x: F.struct(x["error"], -x["n"]))
        ).alias("top_error_types"),
    )
    return pass_rates(checked, layer).crossJoin(F.broadcast(listed))  # one row each


def volume_by_window(table: DataFrame, time: str, width: str = "60 minutes") -> DataFrame:
    return table.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("record_count")).select(F.col("w.start").alias("window_start"), "record_count")


def time_column(columns: list[str]) -> str | None:
    """The column that tells when a row came, by priority."""
    return next((c for c in ("quality_check_timestamp", "ingested_at", "_ingested_at", "event_timestamp") if c in columns), None)


def volume_anomaly(history: DataFrame, current: Column, as_of: Column, time: str | None = None, hours: int = 24, width: str = "60 minutes") -> DataFrame:
    """One row: the baseline of the windows since ``hours`` before ``as_of`` and the z-score of ``current``.

    Fewer than ``MIN_WINDOWS`` windows are no history and no anomaly; no deviation is a score of 0.
    """
    time = time or time_column(history.columns)
    since = F.timestamp_micros(F.unix_micros(as_of) - hours * 3_600_000_000)
    stats = volume_by_window(history.filter(F.col(time) >= since), time, width).agg(
        F.avg("record_count").alias("mean_volume"), F.stddev("record_count").alias("stddev_volume"), F.count("*").alias("sample_windows")
    )
    enough = F.col("sample_windows") >= MIN_WINDOWS
    z = F.when(~enough | (F.coalesce("stddev_volume", F.lit(0.0)) == 0), 0.0).otherwise(F.try_divide(current - F.col("mean_volume"), F.col("stddev_volume")))
    return stats.withColumn("z_score", z).withColumns(
        {"insufficient_history": ~enough, "is_anomaly": F.abs("z_score") > Z_ANOMALY, "severity": F.when(F.abs("z_score") >= Z_CRITICAL, "critical").when(F.abs("z_score") > Z_ANOMALY, "warning")}
    )


def volume_scores(table: DataFrame, time: str, width: str = "60 minutes") -> DataFrame:
    """Each window's count against all windows: z-score and status."""
    windows = volume_by_window(table, time, width)
    every = Window.partitionBy()
    z = F.try_divide(F.col("record_count") - F.avg("record_count").over(every), F.nullif(F.stddev("record_count").over(every), F.lit(0.0)))
    return windows.withColumn("z_score", z).withColumn(
        "status", F.when(F.abs("z_score") >= Z_CRITICAL, "critical").when(F.abs("z_score") > Z_ANOMALY, "warning").otherwise("normal")
    )


def quality_alerts(metrics: DataFrame, anomaly: DataFrame | None = None, by: tuple = ()) -> DataFrame:
    """Alerts of each metrics row: a pass rate below 0.8 raises both the warning and the critical one."""
    rate = F.col("quality_pass_rate")
    raised = F.array_compact(
        F.array(
            F.when(rate < PASS_WARNING, F.struct(F.lit("low_quality_rate").alias("alert_type"), F.lit("warning").alias("severity"))),
            F.when(rate < PASS_CRITICAL, F.struct(F.lit("critical_quality_rate").alias("alert_type"), F.lit("critical").alias("severity"))),
        )
    )
    details = F.to_json(F.struct("total_records", "invalid_records", "quality_pass_rate"))
    out = metrics.select("layer", *by, F.explode(raised).alias("a"), details.alias("details"))
    out = out.select("layer", *by, "a.alert_type", "a.severity", "details")
    if anomaly is not None:
        found = anomaly.filter("is_anomaly").crossJoin(F.broadcast(metrics.select("layer")))
        out = out.unionByName(found.select("layer", F.lit("volume_anomaly").alias("alert_type"), "severity", F.to_json(F.struct("z_score", "mean_volume")).alias("details")))
    return out.withColumn("alert_id", stable_id(F.col("layer"), *map(F.col, by), F.col("alert_type"), F.col("details")))


def quarantine_summary(quarantined: DataFrame, date: str = "quarantine_date") -> DataFrame:
    sizes = [F.sum(F.size(F.col("quality_check_errors")[c])).alias(c) for c in ("schema_errors", "value_errors", "null_fields")]
    return quarantined.groupBy(date).agg(*sizes, F.count("*").alias("total_quarantined"))


def expire(table: DataFrame, as_of: Column, days: int, time: str, also: Column | None = None) -> DataFrame:
    """What a retention of ``days`` keeps; ``also`` limits what may be deleted."""
    old = F.col(time) < F.timestamp_micros(F.unix_micros(as_of) - days * 86_400_000_000)
    old = old if also is None else old & also
    return table.filter(~F.coalesce(old, F.lit(False)))
