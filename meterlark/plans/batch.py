"""The local batch run: JSON files to Bronze, Silver and six Gold tables.

Every layer is written once and read back, so counts and tables agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterlark.functions.times import parse_time
from meterlark.operators import alerts, bronze, gold, silver
from meterlark.sources.readers import CORRUPT, read_events_json


def _stored(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.parquet(path)


def bronze_layer(spark: SparkSession, landing: str, out: str, batch_id: str = "batch-0") -> DataFrame:
    events = bronze.with_file_lineage(read_events_json(spark, landing), batch_id)
    events = events.withColumns({"_event_date": F.to_date(parse_time(F.col("event_timestamp"))), "_bronze_ingested_at": F.current_timestamp()})
    good, bad = bronze.required_split(events)
    _stored(bad, f"{out}/bronze_dlq")
    return _stored(good.drop(CORRUPT), f"{out}/bronze", "_event_date")


def silver_layer(stored: DataFrame, out: str) -> DataFrame:
    """Duplicates go before validation, so the earliest copy of an event is judged."""
    first = silver.keep_first(stored, order=("event_timestamp", "_source_file", "sequence_number"))
    good, bad = silver.validate(silver.flatten(first), silver.batch_rules())
    _stored(silver.quarantine(bad), f"{out}/silver_quarantine")
    return _stored(good, f"{out}/silver", "_event_date")


def gold_layer(events: DataFrame, out: str) -> dict[str, DataFrame]:
    verdicts = alerts.tenant_alerts(events)
    tables = {
        "tenant_usage": gold.tenant_summary(events),
        "endpoint_analytics": gold.endpoint_analytics(events),
        "enforcement_alerts": verdicts,
        "status_distribution": gold.status_distribution(events),
        "geo_distribution": gold.geo_distribution(events),
        "pipeline_metrics": gold.run_summary(events, verdicts),
    }
    return {name: _stored(df, f"{out}/gold/{name}") for name, df in tables.items()}


def run(spark: SparkSession, landing: str, out: str) -> dict[str, DataFrame]:
    stored = bronze_layer(spark, landing, out)
    return gold_layer(silver_layer(stored, out), out)


def write_events(nested: DataFrame, path: str, kind: str = "json") -> None:
    """Events in order of their time, as JSON lines or Parquet."""
    getattr(nested.orderBy("event_timestamp", "event_id").write.mode("overwrite"), kind)(path)
