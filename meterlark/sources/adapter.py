"""Usage events derived from the plain ``events`` table.

Time is compressed and tenants are skewed so that minute limits are reached; ids, timestamps, delays
and defects follow the event number, so any engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.functions.limits import UNIT_PRICE_USD
from meterlark.functions.once import once

EPOCH_US = 1_704_067_200_000_000
COMPRESSION = 2160
TIERS = ("free", "starter", "professional", "enterprise")
COUNTRIES = ("US", "GB", "DE", "JP", "IN")
REGIONS = ("us-east-1", "eu-west-1", "ap-northeast-1")


def _choice(values: tuple, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def usage_events(events: DataFrame) -> DataFrame:
    """Clean, flat usage events, one for each row of ``events``."""
    n, user, kind = F.col("n"), F.col("user_id"), F.col("event_type")
    base = once(events, "k", F.get_json_object("props", "$.k").cast("int")).select(
        F.col("event_id").alias("n"),
        "user_id",
        "event_type",
        "value",
        F.col("ts").cast("timestamp").alias("original"),
        "k",
        F.floor(F.sqrt(F.col("user_id") % 150)).cast("int").alias("tn"),
    )
    compressed = F.timestamp_micros((F.lit(EPOCH_US) + F.expr(f"(unix_micros(original) - {EPOCH_US}) div {COMPRESSION}")).cast("long"))
    timed = base.withColumn("event_timestamp", compressed).withColumn(
        "status_code",
        F.when(kind == "error", _choice((500, 429, 404), n % 3)).when(kind == "signup", 201).otherwise(200).cast("int"),
    )
    delay = F.when(n % 100 == 7, 4000).when(n % 20 == 0, 400).otherwise(n % 3).cast("long")
    units = F.when(kind == "purchase", 5.0).when(kind == "signup", 2.0).when(kind == "error", 0.0).otherwise(1.0)
    return timed.withColumn("billing_units", units).select(
        F.concat(F.lit("00000000-0000-7000-8000-"), F.lpad(n.cast("string"), 12, "0")).alias("event_id"),
        "event_timestamp",
        F.timestamp_micros(F.unix_micros("event_timestamp") + delay * 1_000_000).alias("ingested_at"),
        F.concat(F.lit("tenant-"), F.lpad(F.col("tn").cast("string"), 2, "0")).alias("tenant_id"),
        _choice(TIERS, F.col("tn") % 4).alias("plan_tier"),
        F.date_format("original", "yyyy-MM").alias("billing_cycle_id"),
        F.concat(F.lit("key-"), user.cast("string")).alias("api_key_id"),
        F.concat(F.lit("ep-"), kind, F.lit("-"), (n % 3).cast("string")).alias("endpoint_id"),
        F.concat(F.lit("/v1/"), kind).alias("endpoint_path"),
        F.when(kind.isin("signup", "purchase"), "POST").otherwise("GET").alias("http_method"),
        "status_code",
        F.concat(F.floor(F.col("status_code") / 100).cast("string"), F.lit("xx")).alias("status_category"),
        F.col("value").alias("latency_ms"),
        "billing_units",
        (F.col("billing_units") * UNIT_PRICE_USD).alias("cost_estimate_usd"),
        F.col("k").cast("double").alias("risk_score"),
        (F.col("status_code") == 429).alias("was_rate_limited"),
        (F.col("status_code") < 400).alias("is_billable"),
        (F.col("k") > 90).alias("is_suspicious"),
        F.col("k").cast("double").alias("quota_used_percent"),
        (F.col("k") * 10).cast("int").alias("velocity_1min"),
        _choice(COUNTRIES, user % 5).alias("country_code"),
        _choice(REGIONS, n % 3).alias("gateway_region"),
        F.concat(F.lit("ip-"), (n % 13).cast("string")).alias("client_ip_hash"),
        (n % 4).cast("int").alias("src_partition"),
        F.expr("n div 4").alias("src_offset"),
        "n",
    )


def raw_usage_events(events: DataFrame) -> DataFrame:
    """Usage events with duplicates, missing fields and values out of range."""
    clean = usage_events(events)
    again = clean.filter(F.col("n") % 50 == 1).withColumns(
        {
            "ingested_at": F.col("ingested_at") + F.expr("INTERVAL 5 SECONDS"),
            "latency_ms": F.col("latency_ms") + 1,
            "src_offset": F.col("src_offset") + 1_000_000,
        }
    )
    at = lambda step: F.col("n") % step == 13
    return clean.unionByName(again).withColumns(
        {
            "event_timestamp": F.when(~at(103), F.col("event_timestamp")),
            "tenant_id": F.when(~at(89), F.col("tenant_id")),
            "status_code": F.when(at(97), 999).otherwise(F.col("status_code")).cast("int"),
            "latency_ms": F.when(at(101), -1.0).otherwise(F.col("latency_ms")),
        }
    )


def nested_events(flat: DataFrame) -> DataFrame:
    """Flat usage events as nested contract records, for tests and writers.

    What the flat events lack follows the event number ``n``: one in three is served from a cache, one in
    five comes from a bot, and client errors carry an error code.
    """
    n = F.col("n")
    flat = flat.withColumns(
        {
            "cache_status": F.when(n % 3 == 0, "hit").otherwise("miss"),
            "user_agent_parsed": F.create_map(F.lit("is_bot"), F.when(n % 5 == 0, "true").otherwise("false")),
            "error_code": F.when(F.col("status_code") >= 400, F.concat(F.lit("ERR_"), F.col("status_code").cast("string"))),
            "event_version": F.lit("1.0.0"),
            "country_name": F.lit("Unknown"),
            "subscription_id": F.concat(F.lit("sub-"), F.col("tenant_id")),
            "user_id": F.concat(F.lit("user-"), F.col("api_key_id")),
            "auth_method": F.lit("api_key"),
            "request_id": F.concat(F.lit("req-"), n.cast("string")),
            "trace_id": F.concat(F.lit("trace-"), n.cast("string")),
            "api_version": F.lit("v1"),
            "request_bytes": 64 + n % 100,
            "response_bytes": 256 + n % 1000,
            "upstream": F.col("latency_ms") / 2,
            "sdk_name": F.when(n % 4 == 0, "python-sdk"),
            "sdk_version": F.when(n % 4 == 0, "2.1.0"),
            "geo_region": F.col("country_code"),
            "is_datacenter": n % 6 == 0,
            "is_vpn": F.lit(False),
            "rate_limit": F.lit(60),
            "rate_remaining": (n % 60).cast("int"),
            "action_taken": F.when(F.col("was_rate_limited"), "throttled").otherwise("allowed"),
            "source": F.lit("gateway"),
            "environment": F.lit("production"),
        }
    )
    text = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    group = lambda **cols: F.struct(*[F.col(v).alias(k) for k, v in cols.items()])
    return flat.select(
        "event_id",
        "event_version",
        text("event_timestamp").alias("event_timestamp"),
        text("ingested_at").alias("ingestion_timestamp"),
        F.col("n").alias("sequence_number"),
        "tenant_id",
        group(subscription_id="subscription_id", plan_tier="plan_tier", billing_cycle_id="billing_cycle_id").alias("subscription"),
        group(api_key_id="api_key_id", user_id="user_id", auth_method="auth_method").alias("identity"),
        group(request_id="request_id", trace_id="trace_id", method="http_method", path="endpoint_path", api_version="api_version", endpoint_id="endpoint_id", content_length="request_bytes").alias("request"),
        group(status_code="status_code", status_category="status_category", content_length="response_bytes", latency_ms="latency_ms", upstream_latency_ms="upstream", cache_status="cache_status", error_code="error_code").alias("response"),
        group(ip_address_hash="client_ip_hash", user_agent_parsed="user_agent_parsed", sdk_name="sdk_name", sdk_version="sdk_version").alias("client"),
        group(country_code="country_code", country_name="country_name", region="geo_region", is_datacenter="is_datacenter", is_vpn="is_vpn").alias("geo"),
        group(limit="rate_limit", remaining="rate_remaining", was_rate_limited="was_rate_limited", quota_used_percent="quota_used_percent").alias("rate_limiting"),
        group(risk_score="risk_score", velocity_1min="velocity_1min", is_suspicious="is_suspicious", action_taken="action_taken").alias("abuse_signals"),
        group(gateway_region="gateway_region").alias("gateway"),
        group(billable="is_billable", billing_units="billing_units", cost_estimate_usd="cost_estimate_usd").alias("billing"),
        group(source="source", environment="environment").alias("metadata"),
    )
