"""Batch and streaming scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meterlark.sources.schemas import event_schema

CORRUPT = "_corrupt_record"


def read_events_json(spark: SparkSession, path: str) -> DataFrame:
    """Events from JSON lines with the contract's schema; text that doesn't parse is kept beside them."""
    schema = T.StructType([*event_schema().fields, T.StructField(CORRUPT, T.StringType())])
    return spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def stream_events_json(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(event_schema())
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).json(path)


def stream_text(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A directory of text files as a source of messages: value, and its place in the source.

    A file is a partition, numbered by a hash of its name. A stream doesn't number a file's lines, so a hash
    of the line stands for its offset: the same whenever a batch is read again, but no order.
    """
    reader = spark.readStream.schema("value string")
    lines = (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).format("text").load(path)
    file = F.expr("cast(crc32(_metadata.file_name) & 2147483647 as int)")
    return lines.select("value", file.alias("partition"), F.crc32("value").alias("offset"))


def stream_table(spark: SparkSession, path: str, schema: T.StructType | str, max_files: int | None = 100) -> DataFrame:
    """A Parquet table as a stream: new files are new rows. Each downstream query scans it for itself."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_source_rows(lines: DataFrame, topic: str = "api-usage-events.v1") -> DataFrame:
    """Text lines (value) in the shape of a message source; order in a file stands for the offset."""
    return lines.select(
        F.lit(None).cast("binary").alias("key"),
        F.col("value").cast("binary").alias("value"),
        F.lit(topic).alias("topic"),
        F.col("partition").cast("int") if "partition" in lines.columns else F.lit(0).alias("partition"),
        F.col("offset").cast("long") if "offset" in lines.columns else F.lit(None).cast("long").alias("offset"),
        (F.col("timestamp") if "timestamp" in lines.columns else F.current_timestamp()).cast("timestamp").alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )


def stream_messages(spark: SparkSession, brokers: str, topic: str, starting: str = "earliest", max_offsets: int | None = None) -> DataFrame:
    """The message broker as a stream; needs Spark's connector for it on the class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", brokers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
        .option("failOnDataLoss", "false")
    )
    return (reader.option("maxOffsetsPerTrigger", max_offsets) if max_offsets else reader).load()


def send_messages(messages: DataFrame, brokers: str, topic: str) -> None:
    """Messages (key, value) to the broker's topic; needs Spark's connector for it on the class path."""
    messages.write.format("kafka").option("kafka.bootstrap.servers", brokers).option("topic", topic).save()


def to_messages(events: DataFrame, key: str = "tenant_id") -> DataFrame:
    """Events as (key, value) for a message sink, keyed so that a tenant's events stay in order."""
    return events.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))
