"""Audits of stored tables: offsets, duplicates, lateness, limits under other plans, skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meterlark.functions.limits import plan_limit, with_changed


def offset_gaps(table: DataFrame, partition: str = "src_partition", offset: str = "src_offset") -> DataFrame:
    """Offsets a partition should hold between its ends, and how many rows it has."""
    ends = table.groupBy(partition).agg(
        F.min(offset).alias("min_offset"), F.max(offset).alias("max_offset"), F.count_distinct(offset).alias("actual_count")
    )
    expected = F.col("max_offset") - F.col("min_offset") + 1
    return ends.withColumn("expected_count", expected).withColumn("missing", expected - F.col("actual_count"))


def duplicate_keys(table: DataFrame, key: str = "event_id") -> DataFrame:
    return table.groupBy(key).agg(F.count("*").alias("copies")).filter("copies > 1")


def late_summary(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("_late_category").agg(F.count("*").alias("event_count"), F.avg("_arrival_delay_s").alias("avg_delay_s"))


def plan_what_if(usage: DataFrame, tier: str, per_minute: int) -> DataFrame:
    """Windows by tier that are over the limit now and would be with another limit for ``tier``."""
    now, then = plan_limit(F.col("plan_tier")), plan_limit(F.col("plan_tier"), plans=with_changed(tier, per_minute=per_minute))
    n = F.col("request_count")
    return usage.groupBy("plan_tier").agg(
        F.count("*").alias("windows"),
        F.count_if(n > now).alias("over_now"),
        F.count_if(n > then).alias("over_then"),
        F.count_if((n > now) & (n <= then)).alias("freed"),
    )


def partition_skew(table: DataFrame, partition: str = "src_partition", most: float = 3.0) -> DataFrame:
    """Rows by partition, their ratio to the mean and whether it exceeds ``most``."""
    counts = table.groupBy(partition).agg(F.count("*").alias("rows"))
    mean = F.broadcast(counts.agg(F.avg("rows").alias("mean_rows")))  # one row
    return counts.crossJoin(mean).select(partition, "rows", (F.col("rows") / F.col("mean_rows")).alias("skew")).withColumn("is_skewed", F.col("skew") > most)


def hot_key(table: DataFrame, key: str = "tenant_id", spread_by: str = "api_key_id", hot: int = 1000, parts: int = 8) -> DataFrame:
    """A composite partition key: rows of keys with over ``hot`` rows are spread over ``parts`` parts."""
    heavy = table.groupBy(key).agg(F.count("*").alias("_n")).filter(F.col("_n") > hot).select(key)
    part = F.pmod(F.crc32(F.col(spread_by).cast("binary")), F.lit(parts)).cast("string")
    marked = table.join(heavy.withColumn("_hot", F.lit(True)), key, "left")
    return marked.withColumn("partition_key", F.when(F.col("_hot"), F.concat(key, F.lit("#"), part)).otherwise(F.col(key))).drop("_hot")


def summary(events: DataFrame) -> DataFrame:
    """Totals of a set of events: one row."""
    return events.agg(
        F.count("*").alias("total_events"),
        F.count_distinct("event_id").alias("unique_events"),
        (F.count("*") - F.count_distinct("event_id")).alias("duplicates"),
        F.count_distinct("tenant_id").alias("tenants"),
        F.count_if(F.col("status_code") >= 400).alias("errors"),
        F.count_if(F.coalesce("was_rate_limited", F.lit(False))).alias("rate_limited"),
        F.sum("billing_units").alias("billing_units"),
    )


def mix_of(events: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Events by a column's values and their share of all in percent, the most frequent first."""
    counts = events.groupBy(column).agg(F.count("*").alias("event_count"))
    shares = counts.withColumn("percent", F.round(F.col("event_count") * 100.0 / F.sum("event_count").over(Window.partitionBy()), 1))  # a row for each value
    ordered = shares.orderBy(F.desc("event_count"), column)
    return ordered if n is None else ordered.limit(n)


def plan_as_of(events: DataFrame, history: DataFrame) -> DataFrame:
    """Events with the plan of their tenant's latest ``valid_from`` at or before the event.

    An as-of join by one sort: both sides in one timeline per tenant, the last plan carried forward.
    """
    plans = history.select("tenant_id", F.col("valid_from").alias("_t"), F.lit(0).alias("_side"), F.col("plan_tier").alias("_plan"), F.lit(None).cast("string").alias("event_id"))
    facts = events.select("tenant_id", F.col("event_timestamp").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast("string").alias("_plan"), "event_id")
    line = Window.partitionBy("tenant_id").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = plans.unionByName(facts).withColumn("plan_as_of", F.last("_plan", ignorenulls=True).over(line))
    return carried.filter("_side = 1").select("event_id", "tenant_id", F.col("_t").alias("event_timestamp"), "plan_as_of")
