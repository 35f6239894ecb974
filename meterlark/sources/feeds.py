"""Records of public activity feeds as usage events: projections, no calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.functions.ids import short_hash
from meterlark.functions.limits import plan_limit
from meterlark.sources.generator import uniform, weighted

#: What a page's namespace says about the plan.
NAMESPACE_TIER = {0: "enterprise", 1: "professional", 2: "starter", 3: "starter", 4: "professional", 6: "enterprise", 14: "starter"}
#: Method, endpoint and typical latency of an edit feed's event types.
EDIT_KINDS = {
    "edit": ("PUT", "/v1/documents/{id}", 180),
    "new": ("POST", "/v1/documents", 250),
    "log": ("POST", "/v1/audit/logs", 50),
    "categorize": ("PATCH", "/v1/documents/{id}/categories", 90),
    "external": ("GET", "/v1/search", 120),
}
OTHER_EDIT = ("GET", "/v1/documents/{id}", 100)
#: Status codes of an edit feed's calls and their shares.
EDIT_STATUSES = {200: 0.75, 201: 0.10, 400: 0.04, 401: 0.02, 404: 0.03, 429: 0.03, 500: 0.03}
#: Method of a code host's event types; the endpoint is the type's name.
CODE_METHODS = {
    "PushEvent": "POST",
    "CreateEvent": "POST",
    "DeleteEvent": "DELETE",
    "PullRequestEvent": "PUT",
    "IssuesEvent": "POST",
    "WatchEvent": "GET",
    "ForkEvent": "POST",
    "IssueCommentEvent": "POST",
    "PullRequestReviewEvent": "PUT",
    "ReleaseEvent": "POST",
}
#: Plans and status codes of a code host's calls and their shares.
CODE_TIERS = {"free": 0.6, "starter": 0.3, "professional": 0.1}
CODE_STATUSES = {200: 0.75, 201: 0.10, 400: 0.05, 404: 0.04, 429: 0.03, 500: 0.03}
#: The operator of the feed's default site, and the endpoint whose calls are free.
DEFAULT_SITE, UNBILLED = "en.wikipedia.org", "/v1/audit/logs"
EDIT_SCHEMA = "id bigint, type string, namespace int, title string, user string, bot boolean, timestamp bigint, server_name string, length struct<old:bigint,new:bigint>"
CODE_SCHEMA = "id string, type string, actor struct<login:string>, repo struct<name:string>, created_at string, public boolean"


def _look(table: dict, key: Column, default: object) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key), F.lit(default))


def _share(draw: Column, shares: dict) -> Column:
    return weighted(draw, list(shares), list(shares.values()))


def from_edits(records: DataFrame, seed: int = 42) -> DataFrame:
    """Edit-feed records to flat usage events; sizes have floors, bots carry risk."""
    kind = F.coalesce("type", F.lit("edit"))
    method, path, base = (_look({k: v[i] for k, v in EDIT_KINDS.items()}, kind, OTHER_EDIT[i]) for i in range(3))
    site, user, bot = F.coalesce("server_name", F.lit(DEFAULT_SITE)), F.coalesce("user", F.lit("anonymous")), F.coalesce("bot", F.lit(False))
    old, new = F.coalesce("length.old", F.lit(0)), F.coalesce("length.new", F.lit(0))
    draw = lambda purpose: uniform(seed, f"edit-{purpose}")
    rows = records.withColumns(
        {
            "_path": path,
            "_tier": _look(NAMESPACE_TIER, F.coalesce("namespace", F.lit(0)), "free"),
            "_status": F.when(kind == "new", 201).otherwise(_share(draw("status"), EDIT_STATUSES)).cast("int"),
            "_risk": F.round(F.when(bot, 50 + draw("risk") * 40).otherwise(draw("risk") * 15), 2),
        }
    )
    limit = plan_limit(F.col("_tier"))
    velocity = (1 + F.floor(draw("velocity") * F.floor(limit * 0.8))).cast("int")
    billable = (F.col("_status") < 400) & (F.col("_path") != UNBILLED)
    units = F.when(billable, F.round(1 + draw("units") * 4, 2)).otherwise(0.0)
    return rows.select(
        short_hash(F.concat_ws(":", F.lit("edit"), F.col("id").cast("string"), site), 32).alias("event_id"),
        F.timestamp_seconds("timestamp").alias("event_timestamp"),
        F.concat(F.lit("tenant-"), short_hash(site, 12)).alias("tenant_id"),
        short_hash(F.concat(F.lit("key-"), short_hash(user, 12))).alias("api_key_id"),
        F.col("_tier").alias("plan_tier"),
        method.alias("http_method"),
        F.col("_path").alias("endpoint_path"),
        F.greatest(F.abs(new - old), F.lit(64)).alias("request_size_bytes"),
        F.greatest(new, F.lit(256)).alias("response_size_bytes"),
        F.col("_status").alias("status_code"),
        F.round(base * (0.5 + draw("latency") * 2), 2).alias("latency_ms"),
        F.col("_risk").alias("risk_score"),
        (bot & (F.col("_risk") > 60)).alias("is_suspicious"),
        velocity.alias("velocity_1min"),
        F.round(velocity / limit * 100, 2).alias("quota_used_percent"),
        (F.col("_status") == 429).alias("was_rate_limited"),
        billable.alias("is_billable"),
        units.alias("billing_units"),
        F.round(units * 0.001, 6).alias("cost_estimate_usd"),
    )


def from_code_host(records: DataFrame, seed: int = 42) -> DataFrame:
    """Code-host records to flat usage events."""
    kind, login = F.coalesce("type", F.lit("PushEvent")), F.coalesce("actor.login", F.lit("anonymous"))
    draw = lambda purpose: uniform(seed, f"code-{purpose}")
    rows = records.withColumns({"_tier": _share(draw("tier"), CODE_TIERS), "_status": _share(draw("status"), CODE_STATUSES).cast("int")})
    limit = plan_limit(F.col("_tier"))
    velocity = (1 + F.floor(draw("velocity") * F.floor(limit * 0.7))).cast("int")
    return rows.select(
        short_hash(F.concat_ws(":", F.lit("code"), F.col("id")), 32).alias("event_id"),
        F.try_to_timestamp("created_at").alias("event_timestamp"),
        F.concat(F.lit("tenant-gh-"), short_hash(login, 10)).alias("tenant_id"),
        short_hash(login).alias("api_key_id"),
        F.col("_tier").alias("plan_tier"),
        _look(CODE_METHODS, kind, "GET").alias("http_method"),
        F.concat(F.lit("/v1/repos/"), F.lower(F.replace(kind, F.lit("Event"), F.lit("")))).alias("endpoint_path"),
        F.col("_status").alias("status_code"),
        F.round(20 + draw("latency") * 480, 2).alias("latency_ms"),
        F.round(draw("risk") * 10, 2).alias("risk_score"),
        F.lit(False).alias("is_suspicious"),
        velocity.alias("velocity_1min"),
        F.round(velocity / limit * 100, 2).alias("quota_used_percent"),
        (F.col("_status") == 429).alias("was_rate_limited"),
        (F.col("_status") < 400).alias("is_billable"),
        F.when(F.col("_status") < 400, F.round(1 + draw("units") * 2, 2)).otherwise(0.0).alias("billing_units"),
        F.round(0.001 + draw("cost") * 0.004, 6).alias("cost_estimate_usd"),
    )
