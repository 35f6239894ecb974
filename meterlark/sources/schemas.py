"""Schemas of the event contract and of the engine's tables, and how rows are made to fit them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The fields of a usage event, group by group.
GROUPS = {
    "subscription": "subscription_id string, plan_tier string, billing_cycle_id string",
    "identity": "api_key_id string, api_key_prefix string, user_id string, auth_method string, oauth_client_id string, scopes array<string>",
    "request": "request_id string, trace_id string, span_id string, method string, path string, path_raw string, query_params_hash string, "
    "api_version string, endpoint_id string, received_at string, content_length bigint, content_type string",
    "response": "status_code int, status_category string, content_length bigint, latency_ms double, upstream_latency_ms double, "
    "cache_status string, error_code string, error_message string",
    "client": "ip_address string, ip_address_hash string, ip_version string, user_agent string, user_agent_parsed map<string,string>, "
    "sdk_name string, sdk_version string",
    "geo": "country_code string, country_name string, region string, city string, postal_code string, latitude double, longitude double, "
    "timezone string, asn int, as_org string, is_datacenter boolean, is_vpn boolean, is_tor boolean, is_proxy boolean",
    "rate_limiting": "limit int, remaining int, reset_at string, window_size_seconds int, was_rate_limited boolean, rate_limit_policy string, "
    "quota_used_percent double",
    "abuse_signals": "risk_score double, risk_factors array<string>, velocity_1min int, velocity_5min int, velocity_1hour int, "
    "unique_ips_24h int, unique_endpoints_1h int, is_suspicious boolean, action_taken string, fingerprint_hash string",
    "gateway": "gateway_id string, gateway_region string, gateway_version string, upstream_service string, upstream_instance string",
    "billing": "billable boolean, billing_units double, pricing_tier string, cost_estimate_usd double",
    "metadata": "source string, environment string, partition_key string, retention_days int",
}
ENVELOPE = "event_id string, event_version string, event_timestamp string, ingestion_timestamp string, processing_timestamp string, sequence_number bigint, tenant_id string"


def _parse(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


def event_schema() -> T.StructType:
    """The nested usage event; every field may be missing."""
    fields = list(_parse(ENVELOPE).fields)
    for name, ddl in GROUPS.items():
        if name == "metadata":
            fields.append(T.StructField("custom_attributes", T.MapType(T.StringType(), T.StringType())))
        fields.append(T.StructField(name, _parse(ddl)))
    return T.StructType(fields)


def BRONZE_TABLE() -> str:  # noqa: N802
    """The Bronze table as DDL: the event without its processing time and sequence number, and its lineage."""
    event = [f for f in event_schema().fields if f.name not in ("processing_timestamp", "sequence_number")]
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in event) + ", " + BRONZE_LINEAGE


BRONZE_LINEAGE = (
    "_raw_payload string, _is_valid boolean, _source_topic string, _source_partition int, _source_offset bigint, _source_timestamp timestamp, "
    "_source_timestamp_type int, _ingested_at timestamp, _ingestion_job string, _row_hash bigint, _event_date date, _event_hour int, _ingestion_date date"
)
SILVER_TABLE = (
    "event_id string, event_timestamp_raw string, event_timestamp timestamp, ingested_at timestamp, tenant_id string, subscription_id string, "
    "plan_tier string, billing_cycle_id string, api_key_id string, user_id string, auth_method string, request_id string, trace_id string, "
    "http_method string, endpoint_path string, endpoint_id string, api_version string, request_size_bytes bigint, status_code int, "
    "status_category string, response_size_bytes bigint, latency_ms double, upstream_latency_ms double, error_code string, client_ip_hash string, "
    "sdk_name string, sdk_version string, country_code string, geo_region string, is_datacenter boolean, is_vpn boolean, was_rate_limited boolean, "
    "rate_limit int, rate_limit_remaining int, quota_used_percent double, risk_score double, velocity_1min int, is_suspicious boolean, "
    "action_taken string, gateway_region string, is_billable boolean, billing_units double, cost_estimate_usd double, event_source string, "
    "environment string, cache_hit boolean, is_bot boolean, _source_partition int, _source_offset bigint, _ingested_at timestamp, "
    "_quality_flags array<string>, _arrival_delay_s bigint, _is_late_arriving boolean, _late_category string, _event_date date, _event_hour int"
)
SOURCE_ROW = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp, timestampType int"
MINUTE_TABLE = (
    "tenant_id string, window_start timestamp, window_end timestamp, request_count bigint, billing_units double, error_count bigint, "
    "avg_latency_ms double, p99_latency_ms double, unique_endpoints bigint, unique_api_keys bigint, rate_limited_count bigint, "
    "plan_tier string, limit_requests_per_min bigint, usage_percent double, is_over_limit boolean"
)
HOUR_TABLE = (
    "tenant_id string, window_start timestamp, window_end timestamp, request_count bigint, billing_units double, avg_requests_per_min double, "
    "peak_requests_per_min bigint, plan_tier string, hourly_quota bigint, quota_percent_used double, anomaly_score double"
)
ALERT_TABLE = (
    "alert_id string, tenant_id string, alert_type string, severity string, window_start timestamp, window_end timestamp, plan_tier string, "
    "request_count bigint, limit_value bigint, usage_percent double, overage bigint, recommended_action string, response_config string"
)


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """The schema's columns, in its order and types; missing ones are NULL, others are dropped."""
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in _parse(ddl).fields]
    )
