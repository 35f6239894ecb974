"""Synthetic usage events, a function of the row number and the seed alone.

Every random choice is a hash of (seed, row, purpose), so the same rows come out on any cluster and any
number of partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.functions.ids import short_hash

#: Tenants by tier, the middle of their requests a minute, the tier's name in ids and its keys a tenant.
TENANTS = {"free": (30, 22.5, "free", 2), "starter": (12, 125.0, "starter", 4), "professional": (6, 450.0, "pro", 8), "enterprise": (2, 2000.0, "ent", 16)}
#: Method, path, share of calls, billing units and typical latency.
ENDPOINTS = (
    ("GET", "/v1/users/{id}", 0.25, 1.0, 45),
    ("POST", "/v1/users", 0.05, 2.0, 120),
    ("POST", "/v1/search", 0.20, 3.0, 200),
    ("GET", "/v1/documents/{id}", 0.15, 1.0, 60),
    ("POST", "/v1/documents", 0.08, 5.0, 350),
    ("GET", "/v1/analytics/reports", 0.10, 2.0, 150),
    ("POST", "/v1/webhooks", 0.02, 1.0, 30),
    ("GET", "/v1/health", 0.05, 0.0, 5),
    ("POST", "/v1/auth/token", 0.05, 0.5, 80),
    ("GET", "/v1/files/{id}/download", 0.05, 4.0, 500),
)
#: Country and region of clients, and their share.
PLACES = (
    ("US", "California", 0.30),
    ("US", "Virginia", 0.15),
    ("GB", "England", 0.12),
    ("DE", "Hesse", 0.10),
    ("JP", "Tokyo", 0.08),
    ("SG", "Central", 0.07),
    ("IN", "Maharashtra", 0.08),
    ("BR", "S\u00e3o Paulo", 0.05),
    ("AU", "NSW", 0.05),
)
#: The gateways' regions, equally likely.
GATEWAYS = ("us-east-1", "us-west-2", "eu-west-1", "ap-northeast-1", "ap-southeast-1")
#: Status codes and their shares, of usual and of abusive calls.
STATUSES = ((200, 0.70), (201, 0.05), (204, 0.03), (301, 0.01), (400, 0.05), (401, 0.02), (404, 0.04), (429, 0.03), (500, 0.03), (502, 0.02), (503, 0.02))
ABUSE_STATUSES = ((200, 0.10), (400, 0.15), (401, 0.20), (403, 0.15), (404, 0.15), (429, 0.20), (500, 0.05))
#: Categories of status codes; others are client errors.
CATEGORIES = {
    200: "success", 201: "success", 204: "success", 301: "success", 304: "success", 400: "client_error", 401: "unauthorized", 403: "unauthorized",
    404: "client_error", 422: "client_error", 429: "rate_limited", 500: "server_error", 502: "server_error", 503: "server_error",
}


def uniform(seed: int, purpose: str, row: str = "id") -> Column:
    """A number in [0, 1) for each row."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), F.col(row)), F.lit(1 << 48)) / float(1 << 48)


def weighted(draw: Column, values: list, weights: list) -> Column:
    """The value in whose share of the weights ``draw`` falls."""
    total, upto, out = float(sum(weights)), 0.0, F.lit(values[-1])
    steps = []
    for value, weight in zip(values, weights):
        upto += weight
        steps.append((upto / total, value))
    for edge, value in reversed(steps[:-1]):
        out = F.when(draw < edge, F.lit(value)).otherwise(out)
    return out


def day_factor(hour: Column) -> Column:
    """Traffic of an hour: a bell around noon above a floor."""
    return 0.3 + 0.7 * F.exp(-0.5 * F.pow((hour - 12) / 4, 2))


def generate(spark: SparkSession, count: int = 10_000, start: str = "2024-01-15 00:00:00", hours: int = 24, seed: int = 42, duplicates: float = 0.02, late: float = 0.05, abuse: float = 0.03) -> DataFrame:
    """Flat usage events; duplicates repeat an earlier row's id and content and arrive later."""
    u = lambda purpose, row="src": uniform(seed, purpose, row)
    rows = spark.range(count).withColumn("is_duplicate", (uniform(seed, "duplicate") < duplicates) & (F.col("id") > 0))
    rows = rows.withColumn("src", F.when(F.col("is_duplicate"), F.floor(uniform(seed, "of") * F.col("id"))).otherwise(F.col("id")).cast("long"))
    # hours by their share of the day's traffic
    weights = [0.3 + 0.7 * 2.718281828459045 ** (-0.5 * ((h % 24 - 12) / 4) ** 2) for h in range(hours)]
    hour = weighted(u("hour"), list(range(hours)), weights)
    tiers, tenants = [], []
    for n, rate, *_ in TENANTS.values():
        tiers += [n * rate]
        tenants.append(F.floor(u("tenant") * n).cast("int"))
    tier = weighted(u("tier"), list(TENANTS), tiers)
    number = F.element_at(F.create_map(*[x for t, c in zip(TENANTS, tenants) for x in (F.lit(t), c)]), F.col("plan_tier"))
    is_abuse, is_late = u("abuse") < abuse, u("late") < late
    delay = F.when(F.col("is_late"), 300 + u("delay") * 2400).otherwise(u("delay") * 3)
    status = F.when(F.col("is_abuse"), weighted(u("status"), [s for s, _ in ABUSE_STATUSES], [w for _, w in ABUSE_STATUSES])).otherwise(
        weighted(u("status"), [s for s, _ in STATUSES], [w for _, w in STATUSES])
    )
    normal = F.sqrt(-2 * F.log(F.greatest(u("n1"), F.lit(1e-12)))) * F.cos(2 * F.pi() * u("n2"))
    endpoint = weighted(u("endpoint"), list(range(len(ENDPOINTS))), [e[2] for e in ENDPOINTS])
    place = weighted(u("place"), [c for c, *_ in PLACES], [w for *_, w in PLACES])
    named = lambda table, key: F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    of = lambda i: F.element_at(F.array(*[F.lit(e[i]) for e in ENDPOINTS]), F.col("endpoint") + 1)
    tenant_id = F.concat(F.lit("tenant-"), named({t: v[2] for t, v in TENANTS.items()}, F.col("plan_tier")), F.lit("-"), F.lpad((F.col("tenant") + 1).cast("string"), 3, "0"))
    key = F.floor(u("key") * named({t: v[3] for t, v in TENANTS.items()}, F.col("plan_tier")))
    made = rows.withColumns({"plan_tier": tier, "hour": hour, "is_abuse": is_abuse, "is_late": is_late}).withColumns(
        {"status_code": status.cast("int"), "endpoint": endpoint, "place": place, "tenant": number}
    )
    event_time = F.timestamp_micros(F.unix_micros(F.lit(start).cast("timestamp")) + (F.col("hour") * 3_600_000_000 + u("second") * 3_600_000_000).cast("long"))
    digest = F.md5(F.concat_ws(":", F.lit(seed), F.col("src")))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    units = F.when(F.col("status_code") < 400, of(3)).otherwise(0.0)
    return (
        made.withColumns({"event_timestamp": event_time, "billing_units": units})
        .withColumn("extra", F.when(F.col("is_duplicate"), 5.0).otherwise(0.0))
        .select(
            uuid.alias("event_id"),
            "event_timestamp",
            F.timestamp_micros(F.unix_micros("event_timestamp") + ((delay + F.col("extra")) * 1_000_000).cast("long")).alias("ingested_at"),
            tenant_id.alias("tenant_id"),
            "plan_tier",
            F.date_format("event_timestamp", "yyyy-MM").alias("billing_cycle_id"),
            short_hash(F.concat(tenant_id, F.lit(":"), key.cast("string"))).alias("api_key_id"),
            of(1).alias("endpoint_path"),
            F.concat(F.lit("ep_"), short_hash(F.concat(of(0), F.lit(" "), of(1)), 8)).alias("endpoint_id"),
            of(0).alias("http_method"),
            "status_code",
            F.coalesce(named(CATEGORIES, F.col("status_code")), F.lit("client_error")).alias("status_category"),
            F.round(of(4) * F.exp(0.5 * normal), 2).alias("latency_ms"),
            "billing_units",
            (F.col("billing_units") * 0.001).alias("cost_estimate_usd"),
            F.when(F.col("is_abuse"), 70 + u("risk") * 30).otherwise(u("risk") * 30).alias("risk_score"),
            (F.col("status_code") == 429).alias("was_rate_limited"),
            (F.col("status_code") < 400).alias("is_billable"),
            F.col("is_abuse").alias("is_suspicious"),
            F.round(u("quota") * 100, 2).alias("quota_used_percent"),
            F.when(F.col("is_abuse"), 500 + u("v") * 1500).otherwise(u("v") * 50).cast("int").alias("velocity_1min"),
            F.col("place").alias("country_code"),
            F.element_at(F.array(*[F.lit(g) for g in GATEWAYS]), (F.floor(u("gateway") * len(GATEWAYS)) + 1).cast("int")).alias("gateway_region"),
            short_hash(F.concat_ws(":", F.col("src"), F.lit("ip"))).alias("client_ip_hash"),
            F.pmod(F.col("id"), F.lit(64)).cast("int").alias("src_partition"),
            F.expr("id div 64").alias("src_offset"),
            F.col("id").alias("n"),
            "is_late",
            "is_duplicate",
        )
    )
