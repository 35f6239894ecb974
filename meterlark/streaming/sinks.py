"""Micro-batch sinks that a retry leaves unchanged.

A batch is written aside and then renamed to its folder ``batch=<id>``: a folder that exists is a whole batch,
and the second try of it writes nothing. So a query that reads the table as a stream never sees part of a
batch, nor its rows twice under new file names. One writer per table; a checkpoint that is reset needs its
table rebuilt, as batch ids start anew. The rename is atomic on file systems with folders.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from meterlark.operators.upsert import insert_absent


@dataclass(frozen=True)
class BatchTable:
    path: str
    partition_by: tuple = ()

    def _files(self, spark: SparkSession):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        return path, path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, spark: SparkSession) -> bool:
        """Whether any row has been written."""
        path, files = self._files(spark)
        depths = range(len(self.partition_by), len(self.partition_by) + 3)
        return any(len(files.globStatus(path(f"{self.path}/batch=*{'/*' * k}/*.parquet")) or ()) > 0 for k in depths)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        path, files = self._files(rows.sparkSession)
        done = path(f"{self.path}/batch={batch_id}")
        if files.exists(done):
            return
        aside = f"{self.path}/_aside/batch={batch_id}"
        writer = rows.write.mode("overwrite")
        if self.partition_by:
            writer = writer.partitionBy(*self.partition_by)
        writer.parquet(aside)
        if not files.rename(path(aside), done):
            raise OSError(f"could not move {aside} to {done}")

    def read(self, spark: SparkSession) -> DataFrame | None:
        """All batches; None before the first row."""
        return spark.read.option("basePath", self.path).parquet(f"{self.path}/batch=*") if self.exists(spark) else None

    def stream(self, spark: SparkSession, schema: str, max_files: int | None = None) -> DataFrame:
        """The table as a stream of its batches, also before there is any; ``schema`` as DDL."""
        path, files = self._files(spark)
        files.mkdirs(path(self.path))
        reader = spark.readStream.schema(schema).option("basePath", self.path)
        return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(f"{self.path}/batch=*")

    def insert_absent(self, rows: DataFrame, batch_id: int, keys: tuple = ("event_id",), order: tuple = ("event_timestamp",), recent: Column | None = None) -> None:
        """Writes the first of each key that no other batch holds; ``recent`` limits where is looked (see ``same_days``)."""
        held = self.read(rows.sparkSession)
        if held is None:
            held = rows.limit(0).withColumn("batch", F.lit(-1))
        held = held.filter(F.col("batch") != batch_id)
        self.write(insert_absent(rows, held if recent is None else held.filter(recent), keys, order), batch_id)


#: Most days of a batch that limit where its keys are looked up; a batch of more is looked up everywhere.
MOST_DAYS = 400


def same_days(rows: DataFrame, day: str) -> Column | None:
    """The partitions of a table that rows with these keys can be in: copies of an event share its day."""
    found = [r[0] for r in rows.select(day).distinct().limit(MOST_DAYS + 1).collect()]
    if len(found) > MOST_DAYS:
        return None
    known = F.col(day).isin([d for d in found if d is not None])
    return known | F.col(day).isNull() if None in found else known


def on_batch(handle: Callable[[DataFrame, int], None], reused: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch callback. A batch that the handler reads more than once is computed once.

    Batches of stateful queries are handed on as they are; their handlers read them once.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        if not reused:
            handle(batch, batch_id)
            return
        batch.persist()
        try:
            if not batch.isEmpty():
                handle(batch, batch_id)
        finally:
            batch.unpersist()

    return run


def start(df: DataFrame, checkpoint: str, handle: Callable[[DataFrame, int], None], name: str, interval: str | None = None, mode: str = "append", reused: bool = True) -> StreamingQuery:
    """Starts the query: as soon as there is data for ``interval``, or all there is now and then stops."""
    writer: DataStreamWriter = df.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(on_batch(handle, reused))
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def append_files(df: DataFrame, path: str, checkpoint: str, partition_by: tuple = (), interval: str | None = None) -> StreamingQuery:
    """The plain file sink: exactly once by its own log."""
    writer = df.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def export_latest(usage: DataFrame, ttl_s: int = 120) -> DataFrame:
    """The counters that a gateway looks up: a key for each tenant, its latest window and when it expires."""
    latest = usage.groupBy("tenant_id").agg(F.max_by(F.struct("window_start", "window_end", "request_count", "limit_requests_per_min"), "window_start").alias("w"))
    return latest.select(
        F.concat(F.lit("usage:"), "tenant_id").alias("key"),
        F.to_json(F.struct("w.request_count", "w.limit_requests_per_min")).alias("value"),
        F.timestamp_micros(F.unix_micros("w.window_end") + ttl_s * 1_000_000).alias("expires_at"),
    )
