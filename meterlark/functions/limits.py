"""Plan limits, defined once and used as expressions or as a table."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Plan:
    per_minute: int
    per_hour: int
    per_month: int
    price_usd: float | None


#: The tiers' limits and list prices.
PLANS = {
    "free": Plan(60, 1_000, 10_000, 0.0),
    "starter": Plan(300, 10_000, 100_000, 49.0),
    "professional": Plan(1_000, 50_000, 1_000_000, 199.0),
    "enterprise": Plan(5_000, 200_000, 10_000_000, None),
}
FALLBACK = "free"
#: Price of a billing unit where none is agreed.
UNIT_PRICE_USD = 0.001


def plan_limit(tier: Column, period: str = "per_minute", plans: dict[str, Plan] | None = None) -> Column:
    """The tier's limit; unknown and null tiers get the fallback tier's."""
    plans = plans or PLANS
    table = F.create_map(*[x for name, plan in plans.items() for x in (F.lit(name), F.lit(getattr(plan, period)))])
    return F.coalesce(F.try_element_at(table, F.coalesce(tier, F.lit(FALLBACK))), F.lit(getattr(plans[FALLBACK], period))).cast("long")


def is_known_plan(tier: Column) -> Column:
    return F.coalesce(tier.isin(*PLANS), F.lit(False))


def with_changed(tier: str, **limits: int) -> dict[str, Plan]:
    """The plans with other limits for one tier, for what-if questions."""
    return PLANS | {tier: replace(PLANS[tier], **limits)}


def plan_table(spark: SparkSession, plans: dict[str, Plan] | None = None) -> DataFrame:
    rows = [(n, p.per_minute, p.per_hour, p.per_month, p.price_usd) for n, p in (plans or PLANS).items()]
    return spark.createDataFrame(rows, "plan_tier string, per_minute int, per_hour int, per_month int, price_usd double")


def usage_percent(used: Column, limit: Column) -> Column:
    return F.try_divide(used * 100.0, limit)


def overage(used: Column, limit: Column) -> Column:
    """What exceeds the limit; exactly at the limit is within it."""
    return F.greatest(used - limit, F.lit(0))
