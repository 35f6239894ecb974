import datetime as dt
import hashlib

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterlark.operators import gold, silver, upsert
from meterlark.plans import catalog
from meterlark.sources import adapter, feeds
from meterlark.sources.schemas import MINUTE_TABLE, conform, event_schema
from tests.conftest import SF, rows_of

T0 = dt.datetime(2024, 1, 1)
ROWS = st.lists(st.tuples(st.sampled_from("abc"), st.integers(0, 5), st.integers(0, 3)), min_size=1, max_size=12)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def _frame(spark, rows):
    return spark.createDataFrame([(k, T0 + dt.timedelta(seconds=t), o) for k, t, o in rows], "event_id string, event_timestamp timestamp, src_offset long")


@FEW
@given(ROWS)
def test_dedup_is_idempotent_and_ignores_order(spark, rows):
    once = silver.keep_first(_frame(spark, rows))
    assert rows_of(once) == rows_of(silver.keep_first(once)) == rows_of(silver.keep_first(_frame(spark, rows[::-1])))


@FEW
@given(ROWS, ROWS)
def test_inserting_twice_adds_nothing(spark, a, b):
    target = silver.keep_first(_frame(spark, a))
    added = upsert.insert_absent(_frame(spark, b), target)
    assert upsert.insert_absent(_frame(spark, b), target.unionByName(added)).count() == 0


def test_valid_and_quarantine_are_all_rows(spark):
    raw = adapter.raw_usage_events(spark.read.parquet(f"{SF}/events.parquet"))
    good, bad = silver.validate(raw)
    assert good.count() + bad.count() == raw.count()
    assert bad.count() == 413


def test_minutes_and_hours_count_all_rows(spark):
    clean = adapter.usage_events(spark.read.parquet(f"{SF}/events.parquet"))
    total = lambda df: df.agg(F.sum("request_count")).first()[0]
    assert total(gold.minute_usage(clean)) == total(gold.hourly_usage(clean)) == clean.count()


def test_no_python_in_any_plan(spark):
    for name, f in catalog.QUERIES.items():
        plan = f(spark, SF)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan, name


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    clean = adapter.usage_events(spark.read.parquet(f"{SF}/events.parquet"))
    clean.withColumn("_event_date", F.to_date("event_timestamp")).write.partitionBy("_event_date").parquet(f"{tmp_path}/t")
    stored = spark.read.parquet(f"{tmp_path}/t")
    plan = stored.filter("_event_date = date'2024-01-01' and status_code = 429").select("tenant_id")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(status_code), EqualTo(status_code,429)]" in plan
    assert "PartitionFilters: [isnotnull(_event_date" in plan
    assert "latency_ms" not in plan


def test_conform(spark):
    df = conform(spark.createDataFrame([("t", 1)], "tenant_id string, extra int"), MINUTE_TABLE)
    assert df.columns[0] == "tenant_id" and "extra" not in df.columns and len(df.columns) == 15
    assert len(event_schema().fields) == 19


def test_feeds(spark):
    edits = spark.createDataFrame(
        [(1, "edit", 0, "p", "u", False, 1704067200, "en.example", (10, 500)), (2, "odd", 99, "p", "bot", True, 1704067200, "de.example", None), (3, "log", 6, "p", "u", False, 1704067200, None, None), (4, "new", 10, "p", None, None, 1704067200, "x", None)],
        feeds.EDIT_SCHEMA,
    )
    got = feeds.from_edits(edits).collect()
    assert (got[0].plan_tier, got[0].http_method, got[0].request_size_bytes, got[0].response_size_bytes) == ("enterprise", "PUT", 490, 500)
    assert (got[1].plan_tier, got[1].http_method, got[1].endpoint_path, got[1].request_size_bytes, got[1].response_size_bytes) == ("free", "GET", "/v1/documents/{id}", 64, 256)
    assert got[1].risk_score >= 50 and got[0].risk_score < 15 and got[1].is_suspicious == (got[1].risk_score > 60)
    assert (got[2].plan_tier, got[2].http_method, got[2].is_billable, got[2].billing_units) == ("enterprise", "POST", False, 0.0)
    assert (got[3].plan_tier, got[3].status_code) == ("free", 201)
    code = spark.createDataFrame([(str(i), k, ("me",), ("org/repo",), "2024-01-01T00:00:00Z", True) for i, k in enumerate(["PushEvent", "PullRequestEvent", "WatchEvent", "OddEvent"])], feeds.CODE_SCHEMA)
    rows = feeds.from_code_host(code).orderBy("endpoint_path").collect()
    assert [(r.http_method, r.endpoint_path) for r in rows] == [("GET", "/v1/repos/odd"), ("PUT", "/v1/repos/pullrequest"), ("POST", "/v1/repos/push"), ("GET", "/v1/repos/watch")]
    assert {r.tenant_id for r in rows} == {"tenant-gh-" + hashlib.sha256(b"me").hexdigest()[:10]} and rows[0].event_timestamp == T0


def test_shared_folder_is_an_error_on_a_cluster():
    from meterlark.session import shared_folder

    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
