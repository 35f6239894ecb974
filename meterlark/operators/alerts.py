"""Alerts from usage, and the decision whether a request may pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.functions.ids import stable_id
from meterlark.functions.limits import overage, plan_limit

INFO_FROM, WARNING_FROM = 80.0, 90.0


def limit_alerts(usage: DataFrame) -> DataFrame:
    """Windows of the minute table at ``INFO_FROM`` percent of the limit or beyond it."""
    used, over = F.col("usage_percent"), F.col("is_over_limit")
    near = used >= INFO_FROM
    kind = F.when(over, "over_limit").when(near, "approaching_limit")
    response = F.to_json(F.struct(F.lit(429).alias("status_code"), F.lit(60).alias("retry_after_seconds"), F.col("window_end").alias("reset_at")))
    return usage.withColumn("alert_type", kind).filter("alert_type is not null").select(
        stable_id(F.col("tenant_id"), F.unix_micros("window_start"), F.col("alert_type")).alias("alert_id"),
        "tenant_id",
        "alert_type",
        F.when(over, "critical").when(used >= WARNING_FROM, "warning").otherwise("info").alias("severity"),
        "window_start",
        "window_end",
        "plan_tier",
        "request_count",
        F.col("limit_requests_per_min").alias("limit_value"),
        "usage_percent",
        overage(F.col("request_count"), F.col("limit_requests_per_min")).alias("overage"),
        F.when(over, "block").when(used >= WARNING_FROM, "throttle").otherwise("alert_only").alias("recommended_action"),
        F.when(over, response).alias("response_config"),
    )


def sustained_usage(usage: DataFrame, percent: float = WARNING_FROM, minutes: int = 3) -> DataFrame:
    """Runs of at least ``minutes`` consecutive minutes at ``percent`` or more; a missing minute ends a run."""
    minute = F.expr("unix_micros(window_start) div 60000000")
    high = usage.filter(F.col("usage_percent") >= percent).withColumn("minute", minute)
    place = F.row_number().over(Window.partitionBy("tenant_id").orderBy("minute"))
    return (
        high.withColumn("island", F.col("minute") - place)
        .groupBy("tenant_id", "island")
        .agg(
            F.min("window_start").alias("run_start"),
            F.max("window_end").alias("run_end"),
            F.count("*").alias("minutes"),
            F.max("usage_percent").alias("peak_percent"),
        )
        .filter(F.col("minutes") >= minutes)
        .select(F.lit("sustained_high_usage").alias("alert_type"), "tenant_id", "run_start", "run_end", "minutes", "peak_percent")
    )


def tenant_alerts(events: DataFrame) -> DataFrame:
    """One verdict for each tenant; the first condition that holds decides."""
    kinds = (
        (F.col("max_risk_score") > 75, "ABUSE_DETECTED", "CRITICAL", "block_key"),
        (F.col("rate_limited_requests") > 10, "RATE_LIMIT_BREACH", "HIGH", "enforce_limit"),
        (F.col("avg_quota_pct") > 80, "QUOTA_WARNING", "MEDIUM", "send_quota_notice"),
        (F.col("suspicious_requests") > 5, "SUSPICIOUS_ACTIVITY", "HIGH", "monitor_closely"),
    )
    verdict = F.struct(F.lit("HEALTHY").alias("alert_type"), F.lit("LOW").alias("severity"), F.lit("none").alias("recommended_action"))
    for condition, *values in reversed(kinds):
        named = F.struct(*[F.lit(v).alias(n) for v, n in zip(values, ("alert_type", "severity", "recommended_action"))])
        verdict = F.when(condition, named).otherwise(verdict)
    return (
        events.groupBy("tenant_id", "plan_tier")
        .agg(
            F.max("velocity_1min").alias("peak_velocity_1min"),
            F.max("risk_score").alias("max_risk_score"),
            F.count_if(F.coalesce("was_rate_limited", F.lit(False))).alias("rate_limited_requests"),
            F.count_if(F.coalesce("is_suspicious", F.lit(False))).alias("suspicious_requests"),
            F.count("*").alias("total_requests"),
            F.avg("quota_used_percent").alias("avg_quota_pct"),
        )
        .withColumn("v", verdict)
        .select("*", "v.*")
        .drop("v")
    )


def abuse_alerts(events: DataFrame, history: int = 24, endpoints: int = 50, error_share: float = 0.5, ips: int = 10) -> DataFrame:
    """Velocity, enumeration, error rate and key sharing, one row for each rule that holds.

    Velocity compares a tenant's hour with twice the mean of its ``history`` hours before.
    """
    hour = F.date_trunc("hour", "event_timestamp").alias("window_start")
    hours = events.groupBy("tenant_id", hour).agg(
        F.count("*").alias("n"),
        F.count_distinct("endpoint_id").alias("endpoints"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
    )
    mean = F.avg("n").over(Window.partitionBy("tenant_id").orderBy("window_start").rowsBetween(-history, -1))
    judged = hours.withColumn("mean", mean)
    row = lambda rule, df, value, subject="tenant_id": df.select(
        F.lit(rule).alias("rule"), "tenant_id", F.col(subject).alias("subject"), "window_start", value.cast("double").alias("observed")
    )
    keys = events.groupBy("tenant_id", "api_key_id", F.date_trunc("day", "event_timestamp").alias("window_start")).agg(
        F.count_distinct("client_ip_hash").alias("ips")
    )
    return (
        row("velocity", judged.filter("n > 2 * mean"), F.col("n"))
        .unionByName(row("enumeration", hours.filter(F.col("endpoints") > endpoints), F.col("endpoints")))
        .unionByName(row("error_rate", hours.filter(F.col("errors") > error_share * F.col("n")), F.col("errors") / F.col("n")))
        .unionByName(row("key_sharing", keys.filter(F.col("ips") > ips), F.col("ips"), "api_key_id"))
    )


def suspicious_keys(events: DataFrame, risk: float = 70, ips: int = 10) -> DataFrame:
    return (
        events.groupBy("api_key_id")
        .agg(F.avg("risk_score").alias("avg_risk"), F.count_distinct("client_ip_hash").alias("distinct_ips"), F.count("*").alias("requests"))
        .filter((F.col("avg_risk") > risk) | (F.col("distinct_ips") > ips))
    )


def decision(counts: DataFrame, used: str = "request_count", tier: str = "plan_tier") -> DataFrame:
    """Whether the next request passes: 429 once the count in the window has reached the limit."""
    limit = plan_limit(F.col(tier))
    full = F.coalesce(F.col(used) >= limit, F.lit(False))  # an unknown count lets the request pass
    return counts.withColumns(
        {"limit_value": limit, "allowed": ~full, "http_status": F.when(full, 429).otherwise(200), "remaining": F.greatest(limit - F.col(used), F.lit(0))}
    )


def numbered_requests(events: DataFrame, plans: dict | None = None) -> DataFrame:
    """Each request's place in its tenant's minute and whether it is within the limit."""
    minute = F.date_trunc("minute", "event_timestamp")
    place = F.row_number().over(Window.partitionBy("tenant_id", minute).orderBy("event_timestamp", "event_id"))
    return events.withColumn("place_in_minute", place).withColumn(
        "within_limit", F.col("place_in_minute") <= plan_limit(F.col("plan_tier"), "per_minute", plans)
    )


def suppress(alerts: DataFrame, keys: tuple = ("alert_type", "layer"), time: str = "alert_timestamp", seconds: int = 3600) -> DataFrame:
    """The first alert of each key in every clock slot of ``seconds``."""
    slot = F.expr(f"unix_micros({time}) div {seconds * 1_000_000}")
    by = Window.partitionBy(*keys, slot).orderBy(time, *[c for c in ("alert_id",) if c in alerts.columns])
    return alerts.withColumn("_rn", F.row_number().over(by)).filter("_rn = 1").drop("_rn")


def alert_frequency(alerts: DataFrame, keys: tuple = ("alert_type", "severity"), time: str = "window_start") -> DataFrame:
    return alerts.groupBy(*keys).agg(F.count("*").alias("alert_count"), F.min(time).alias("first_seen"), F.max(time).alias("last_seen"))


def by_severity(alerts: DataFrame, *severities: str) -> DataFrame:
    return alerts.filter(F.col("severity").isin(*severities)) if severities else alerts


SEVERITY_RANK = {"critical": 1, "warning": 2, "info": 3}


def severity_rank(severity: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SEVERITY_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(severity)), F.lit(9))
