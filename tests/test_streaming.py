import glob
import os
import shutil
import time

import pytest

from pyspark.sql import functions as F

from meterlark.operators import bronze, gold, silver
from meterlark.plans import batch
from meterlark.sources import adapter
from meterlark.sources.generator import generate
from meterlark.sources.readers import as_source_rows
from meterlark.streaming import runner
from meterlark.streaming.sinks import BatchTable, same_days
from tests.conftest import SMALL, rows_of


ONE = runner.Options(max_files=1)


def _landing(spark, path, parts=4):
    """Raw events as JSON in several files, shuffled, with broken lines."""
    events = spark.read.parquet(f"{SMALL}/events.parquet")
    nested = adapter.nested_events(adapter.raw_usage_events(events))
    text = F.to_json(F.struct(*nested.columns))
    lines = nested.select(F.when(F.col("sequence_number") % 40 == 5, "{broken").otherwise(text).alias("value"))
    lines.repartition(parts, F.xxhash64("value")).write.mode("overwrite").text(path)


def test_stream_equals_batch(spark, tmp_path):
    landing, root = f"{tmp_path}/in", f"{tmp_path}/out"
    _landing(spark, landing)
    paths = runner.Paths(root)
    runner.run_bronze(spark, landing, paths, ONE).awaitTermination()
    runner.run_silver(spark, paths, ONE).awaitTermination()
    for q in runner.run_gold(spark, paths):
        q.awaitTermination()
    stored = paths.table("silver").read(spark)

    table = bronze.to_bronze(as_source_rows(spark.read.text(landing)))
    good, bad = silver.validate(silver.flatten(bronze.valid(table)))
    assert paths.table("dead_letters").read(spark).count() == bronze.dead_letters(table).count() > 0
    assert rows_of(stored.select("event_id")) == rows_of(good.select("event_id").distinct())
    assert paths.table("quarantine").read(spark).count() == bad.count() > 0
    assert stored.filter("_late_category = 'very_late'").count() > 0  # late rows are kept

    # closed minutes equal the batch result; the last ones wait for the watermark
    minutes = gold.minute_usage(stored)
    closed = paths.table("usage_minute").read(spark)
    if closed is not None:
        names = ["tenant_id", "window_start", "request_count", "unique_endpoints", "unique_api_keys"]
        assert set(rows_of(closed.select(*names))) <= set(rows_of(minutes.select(*names)))


def test_replay_leaves_tables_unchanged(spark, tmp_path):
    landing, root = f"{tmp_path}/in", f"{tmp_path}/out"
    _landing(spark, landing, parts=3)
    paths = runner.Paths(root)
    runner.run_bronze(spark, landing, paths, ONE).awaitTermination()
    runner.run_silver(spark, paths, ONE).awaitTermination()
    before = rows_of(paths.table("silver").read(spark).select("event_id", "_source_offset"))
    for name in ("bronze", "silver"):  # the last commit is lost
        commits = [f for f in glob.glob(f"{paths.checkpoint(name)}/commits/*") if os.path.basename(f).isdigit()]
        last = max(commits, key=lambda f: int(os.path.basename(f)))
        os.remove(last)
        crc = f"{os.path.dirname(last)}/.{os.path.basename(last)}.crc"
        if os.path.exists(crc):
            os.remove(crc)
    runner.run_bronze(spark, landing, paths, ONE).awaitTermination()
    runner.run_silver(spark, paths, ONE).awaitTermination()
    assert rows_of(paths.table("silver").read(spark).select("event_id", "_source_offset")) == before


def test_retried_batch_replaces_itself(spark, tmp_path):
    table = BatchTable(f"{tmp_path}/t")
    rows = spark.createDataFrame([("a", 1), ("b", 2), ("a", 0)], "event_id string, event_timestamp int")
    for _ in range(2):
        table.insert_absent(rows, 0)
    table.insert_absent(spark.createDataFrame([("b", 0), ("c", 1)], "event_id string, event_timestamp int"), 1)
    assert rows_of(table.read(spark).select("event_id", "event_timestamp")) == [("a", "0"), ("b", "2"), ("c", "1")]


def test_bounded_dedup_on_a_stream(spark, tmp_path):
    adapter.raw_usage_events(spark.read.parquet(f"{SMALL}/events.parquet")).filter("event_timestamp is not null").write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    stream = silver.keep_first_streaming(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("bounded").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert spark.table("bounded").count() == spark.table("bounded").select("event_id").distinct().count()


def test_live_counters_in_update_mode(spark, tmp_path):
    adapter.usage_events(spark.read.parquet(f"{SMALL}/events.parquet")).write.parquet(f"{tmp_path}/in")
    schema = spark.read.parquet(f"{tmp_path}/in").schema
    counts = runner.live_counters(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = counts.writeStream.outputMode("update").format("memory").queryName("live").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c").start()
    q.awaitTermination()
    assert spark.table("live").agg(F.sum("request_count")).first()[0] == 1000


def test_batch_run(spark, tmp_path):
    flat = generate(spark, 2000, seed=7)
    batch.write_events(adapter.nested_events(flat), f"{tmp_path}/in")
    tables = batch.run(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    unique = flat.select("event_id").distinct().count()
    assert tables["pipeline_metrics"].first().total_events_processed == unique < 2000
    assert tables["tenant_usage"].agg(F.sum("total_requests")).first()[0] == unique
    shutil.rmtree(f"{tmp_path}/out")


def test_generator_does_not_depend_on_partitions(spark):
    a = generate(spark, 500, seed=3)
    spark.conf.set("spark.sql.leafNodeDefaultParallelism", "7")
    try:
        b = generate(spark, 500, seed=3)
        assert rows_of(a) == rows_of(b)
    finally:
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
    share = generate(spark, 5000).agg(F.avg(F.col("is_duplicate").cast("int")), F.avg(F.col("is_late").cast("int")), F.avg(F.col("is_suspicious").cast("int"))).first()
    assert abs(share[0] - 0.02) < 0.01 and abs(share[1] - 0.05) < 0.015 and abs(share[2] - 0.03) < 0.01


def test_monitored_batches(spark, tmp_path):
    from meterlark.streaming.monitor import Monitor

    raw = adapter.raw_usage_events(spark.read.parquet(f"{SMALL}/events.parquet"))
    seen = []
    monitor = Monitor("silver", str(tmp_path), as_of=F.lit("2024-01-01 00:30:00").cast("timestamp"))
    for _ in range(2):  # a retry replaces the batch's rows
        monitor.around(lambda good, k: seen.append(good.count()))(raw, 3)
    assert seen[0] == seen[1] < raw.count()
    read = lambda name: monitor.table(name).read(spark)
    assert read("quarantine").count() == raw.count() - seen[0]
    row = read("quality_metrics").first()
    assert row.total_records == raw.count() and row.valid_records == seen[0] and read("quality_metrics").count() == 1
    assert read("observability_metrics").first().record_count == raw.count()
    assert "processing_lag_critical" in {r.alert_type for r in read("observability_alerts").collect()}


@pytest.mark.xfail(reason="open: Silver had stored nothing 150 s after a cold start of all streams", strict=False)
def test_cold_start_and_retry_with_readers_attached(spark, tmp_path):
    """All streams start on an empty root; a Silver batch that is tried again adds nothing to Gold."""
    landing, root = f"{tmp_path}/in", f"{tmp_path}/out"
    paths, options = runner.Paths(root), runner.Options(interval="1 second")
    os.makedirs(landing)
    queries = [runner.run_bronze(spark, landing, paths, options), runner.run_silver(spark, paths, options), *runner.run_gold(spark, paths, options)]
    try:
        _landing(spark, f"{tmp_path}/made", parts=2)
        for k, f in enumerate(sorted(glob.glob(f"{tmp_path}/made/*.txt"))):
            shutil.copy(f, f"{landing}/{k}.txt")
        for _ in range(60):
            time.sleep(1)
            if paths.table("silver").exists(spark):
                break
        assert all(q.isActive for q in queries)
    finally:
        for q in queries:
            q.stop()
    stored = paths.table("silver").read(spark)
    assert stored.count() == stored.select("event_id").distinct().count() > 0
    table = BatchTable(f"{tmp_path}/t")
    rows = spark.range(100).withColumn("event_timestamp", F.lit("2024-01-01").cast("timestamp"))
    read = lambda k: table.stream(spark, "id long, event_timestamp timestamp").writeStream.format("parquet").option("path", f"{tmp_path}/copy").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    for k in range(2):
        table.write(rows, 0)
        read(k)
    assert spark.read.parquet(f"{tmp_path}/copy").count() == 100


def test_keys_are_looked_up_on_their_days(spark, tmp_path):
    table = BatchTable(f"{tmp_path}/t", ("day",))
    rows = spark.createDataFrame([("a", 1, "d1"), ("b", 2, "d2"), ("c", 3, None)], "event_id string, event_timestamp int, day string")
    table.insert_absent(rows, 0)
    again = spark.createDataFrame([("a", 5, "d1"), ("c", 6, None), ("d", 7, "d1")], "event_id string, event_timestamp int, day string")
    table.insert_absent(again, 1, recent=same_days(again, "day"))
    assert sorted(r.event_id for r in table.read(spark).collect()) == ["a", "b", "c", "d"]


def test_command_line():
    from meterlark.__main__ import parser

    given = parser().parse_args("stream --input i --out o --interval x --watermark y --with-metrics --max-files 3 --starting-offsets latest --max-offsets 9 --checkpoints c".split())
    assert given.with_metrics and given.watermark == "y" and given.max_offsets == 9 and given.checkpoints == "c"
