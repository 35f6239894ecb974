"""Bronze: messages to parsed records with lineage, and the split-off of what doesn't parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlark.functions.once import once
from meterlark.functions.rules import required, split, violations
from meterlark.functions.times import parse_time
from meterlark.sources.schemas import GROUPS, event_schema

JOB = "bronze_ingestion"
REQUIRED = ("event_id", "tenant_id", "event_timestamp")


def parse(messages: DataFrame) -> DataFrame:
    """Adds ``parsed``, the text ``_raw_payload`` and ``_is_valid`` (parsed, and the event has an id)."""
    texts = once(messages, "_raw_payload", F.col("value").cast("string"))
    parsed = once(texts, "parsed", F.from_json("_raw_payload", event_schema(), {"mode": "PERMISSIVE"}))
    return parsed.withColumn("_is_valid", F.coalesce(F.col("parsed.event_id").isNotNull(), F.lit(False)))


def to_bronze(messages: DataFrame, job: str = JOB, ingested_at: Column | None = None) -> DataFrame:
    """Source rows (value, topic, partition, offset, timestamp, timestampType) to the Bronze table."""
    time = parse_time(F.col("parsed.event_timestamp"))
    scalars = ["event_id", "event_version", "event_timestamp", "ingestion_timestamp", "tenant_id"]
    groups = [g for g in GROUPS if g != "metadata"] + ["custom_attributes", "metadata"]
    lineage = {"topic": "_source_topic", "partition": "_source_partition", "offset": "_source_offset", "timestamp": "_source_timestamp", "timestampType": "_source_timestamp_type"}
    return parse(messages).select(
        *[F.col(f"parsed.{c}").alias(c) for c in scalars + groups],
        "_raw_payload",
        "_is_valid",
        *[F.col(c).alias(to) for c, to in lineage.items()],
        (F.current_timestamp() if ingested_at is None else ingested_at).alias("_ingested_at"),
        F.lit(job).alias("_ingestion_job"),
        F.xxhash64("_raw_payload").alias("_row_hash"),
        F.to_date(time).alias("_event_date"),
        F.hour(time).alias("_event_hour"),
        F.to_date(F.col("timestamp")).alias("_ingestion_date"),
    )


def valid(bronze: DataFrame) -> DataFrame:
    return bronze.filter("_is_valid")


def dead_letters(bronze: DataFrame) -> DataFrame:
    """Rows that didn't parse, with text and lineage."""
    return bronze.filter(~F.col("_is_valid")).select(
        "_raw_payload",
        "_source_topic",
        "_source_partition",
        "_source_offset",
        "_source_timestamp",
        "_ingested_at",
        F.lit("parse_failure").alias("_error_type"),
        F.to_date("_ingested_at").alias("_dlq_date"),
    )


def required_split(events: DataFrame, columns: tuple = REQUIRED) -> tuple[DataFrame, DataFrame]:
    """(rows that have all required fields, the others)."""
    flagged = events.withColumn("_missing", violations([required(c) for c in columns]))
    good, bad = split(flagged, "_missing")
    return good.drop("_missing"), bad.drop("_missing")


def with_file_lineage(events: DataFrame, batch_id: str) -> DataFrame:
    """File and batch of rows from a file scan."""
    return events.withColumns({"_source_file": F.col("_metadata.file_path"), "_batch_id": F.lit(batch_id)})


def partition_counts(bronze: DataFrame, column: str = "_source_partition") -> DataFrame:
    return bronze.groupBy(column).agg(F.count("*").alias("record_count"))


def dead_letter_counts(letters: DataFrame) -> DataFrame:
    return letters.groupBy("_error_type", "_dlq_date").agg(F.count("*").alias("error_count"))


def archive(table: DataFrame, as_of: Column, days: int = 365, date: str = "_event_date") -> tuple[DataFrame, DataFrame]:
    """(rows to keep, rows older than ``days``)."""
    old = F.col(date) < F.date_sub(as_of.cast("date"), days)
    return table.filter(F.coalesce(~old, F.lit(True))), table.filter(old)


def replay_range(table: DataFrame, first: str, last: str, date: str = "_event_date") -> DataFrame:
    """The partitions of a range of dates, both ends included; prunes on the partition column."""
    return table.filter(F.col(date).between(F.lit(first).cast("date"), F.lit(last).cast("date")))
