"""Silver: flat typed events, validated, flagged for lateness and free of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlark.functions.rules import Rule, flag, holds, required, split
from meterlark.functions.times import parse_time, seconds

LATE_S, VERY_LATE_S = 300, 3600

#: Silver column: path in the Bronze record.
FLAT = {
    "subscription.subscription_id": "subscription_id", "subscription.plan_tier": "plan_tier", "subscription.billing_cycle_id": "billing_cycle_id",
    "identity.api_key_id": "api_key_id", "identity.user_id": "user_id", "identity.auth_method": "auth_method",
    "request.request_id": "request_id", "request.trace_id": "trace_id", "request.method": "http_method", "request.path": "endpoint_path",
    "request.endpoint_id": "endpoint_id", "request.api_version": "api_version", "request.content_length": "request_size_bytes",
    "response.status_code": "status_code", "response.status_category": "status_category", "response.content_length": "response_size_bytes",
    "response.latency_ms": "latency_ms", "response.upstream_latency_ms": "upstream_latency_ms", "response.error_code": "error_code",
    "client.ip_address_hash": "client_ip_hash", "client.sdk_name": "sdk_name", "client.sdk_version": "sdk_version",
    "geo.country_code": "country_code", "geo.region": "geo_region", "geo.is_datacenter": "is_datacenter", "geo.is_vpn": "is_vpn",
    "rate_limiting.was_rate_limited": "was_rate_limited", "rate_limiting.limit": "rate_limit", "rate_limiting.remaining": "rate_limit_remaining",
    "rate_limiting.quota_used_percent": "quota_used_percent",
    "abuse_signals.risk_score": "risk_score", "abuse_signals.velocity_1min": "velocity_1min", "abuse_signals.is_suspicious": "is_suspicious",
    "abuse_signals.action_taken": "action_taken",
    "gateway.gateway_region": "gateway_region", "billing.billable": "is_billable", "billing.billing_units": "billing_units",
    "billing.cost_estimate_usd": "cost_estimate_usd", "metadata.source": "event_source", "metadata.environment": "environment",
}


def flatten(bronze: DataFrame) -> DataFrame:
    """One flat row per Bronze record; text times become timestamps, or NULL if they don't parse."""
    ingested = F.coalesce(parse_time(F.col("ingestion_timestamp")), F.col("_ingested_at") if "_ingested_at" in bronze.columns else F.lit(None).cast("timestamp"))
    return bronze.select(
        "event_id",
        F.col("event_timestamp").alias("event_timestamp_raw"),
        parse_time(F.col("event_timestamp")).alias("event_timestamp"),
        ingested.alias("ingested_at"),
        "tenant_id",
        *[F.col(path).alias(name) for path, name in FLAT.items()],
        (F.col("response.cache_status") == "hit").alias("cache_hit"),
        F.try_element_at(F.col("client.user_agent_parsed"), F.lit("is_bot")).try_cast("boolean").alias("is_bot"),
        *[F.col(c) for c in ("_source_partition", "_source_offset", "_ingested_at", "_event_date", "_event_hour") if c in bronze.columns],
    )


def stream_rules(as_of: Column | None = None, raw: str | None = None) -> list[Rule]:
    """Required fields, business rules and, with ``raw``, the time's text, in this order.

    An event is in the future if it is later than ``as_of``; by default, than its own ingestion. With
    ``raw`` the text is the required field, and one that is no time fails the parse rule alone.
    """
    rules = [required(c) for c in ("event_id", "tenant_id")]
    rules.append(required("event_timestamp") if raw is None else Rule("missing_event_timestamp", F.col(raw).isNull(), "schema"))
    rules += [
        holds("valid_status_code", "status_code BETWEEN 100 AND 599"),
        holds("valid_latency", "latency_ms IS NULL OR latency_ms >= 0"),
        holds("valid_risk_score", "risk_score IS NULL OR risk_score BETWEEN 0 AND 100"),
        Rule("failed_not_future_event", F.col("event_timestamp") > (F.col("ingested_at") if as_of is None else as_of), "business"),
        holds("valid_billing_units", "billing_units IS NULL OR billing_units >= 0"),
    ]
    return rules if raw is None else [*rules, unparseable(raw)]


def unparseable(raw: str = "event_timestamp_raw") -> Rule:
    return Rule("unparseable_timestamp", F.col(raw).isNotNull() & parse_time(F.col(raw)).isNull(), "parse")


def batch_rules() -> list[Rule]:
    """The local runner's rules."""
    return [
        Rule("missing_status_code", F.col("status_code").isNull()),
        Rule("negative_latency", F.col("latency_ms") < 0),
        Rule("extreme_latency", F.col("latency_ms") > 30_000),
        Rule("invalid_risk_score", F.col("risk_score") > 100),
        Rule("negative_billing", F.col("billing_units") < 0),
    ]


def validate(events: DataFrame, rules: list[Rule] | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, invalid) rows, both with ``_quality_flags``; flattened rows also pass the parse rule."""
    raw = "event_timestamp_raw" if "event_timestamp_raw" in events.columns else None
    return split(flag(events, stream_rules(raw=raw) if rules is None else rules))


def flag_late(events: DataFrame, late: int = LATE_S, very_late: int = VERY_LATE_S) -> DataFrame:
    """Delay in whole seconds and its category; an unknown delay is on time, its flag NULL."""
    delay = seconds(F.col("ingested_at")) - seconds(F.col("event_timestamp"))
    return events.withColumn("_arrival_delay_s", delay).withColumns(
        {
            "_is_late_arriving": F.col("_arrival_delay_s") > late,
            "_late_category": F.when(F.col("_arrival_delay_s") > very_late, "very_late")
            .when(F.col("_arrival_delay_s") > late, "late")
            .otherwise("on_time"),
        }
    )


def keep_first(events: DataFrame, keys: tuple = ("event_id",), order: tuple = ("event_timestamp", "src_offset")) -> DataFrame:
    """The first row of each key by all of ``order``; a row without a time comes last."""
    by = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return events.withColumn("_rn", F.row_number().over(by)).filter("_rn = 1").drop("_rn")


def keep_first_streaming(events: DataFrame, keys: tuple = ("event_id",), time: str = "event_timestamp", delay: str = "1 hour") -> DataFrame:
    """First arrival of each key within the watermark: bounded state, but later rows are dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def quarantine(invalid: DataFrame, reason: str = "validation_failure", at: Column | None = None) -> DataFrame:
    at = F.current_timestamp() if at is None else at
    return invalid.withColumns({"_quarantine_reason": F.lit(reason), "_quarantined_at": at, "_event_date": F.to_date("event_timestamp")})


def revalidate(quarantined: DataFrame, rules: list[Rule], at: Column) -> tuple[DataFrame, DataFrame]:
    """Replay of a quarantine: (rows that pass now, the quarantine with those marked)."""
    fresh = flag(quarantined.filter("not coalesce(reprocessed, false)"), rules)
    passes = fresh.filter(F.size("_quality_flags") == 0)
    passed = passes.select("event_id").distinct().withColumn("_passed", F.lit(True))
    marked = quarantined.join(passed, "event_id", "left").withColumns(
        {
            "reprocessed_timestamp": F.when(F.col("_passed") & ~F.coalesce("reprocessed", F.lit(False)), at).otherwise(F.col("reprocessed_timestamp")),
            "reprocessed": F.coalesce("reprocessed", F.lit(False)) | F.coalesce("_passed", F.lit(False)),
        }
    )
    return passes, marked.drop("_passed")
