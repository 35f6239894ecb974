"""Rows at the edges of every rule."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from meterlark.functions.limits import plan_limit
from meterlark.functions.rules import flag, in_range, one_of
from meterlark.functions.times import parse_time
from meterlark.operators import alerts, audits, bronze, gold, observe, quality, silver, upsert
from meterlark.sources.readers import as_source_rows

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + dt.timedelta(seconds=seconds)


def test_late_flag(spark):
    cases = {-1: "on_time", 0: "on_time", 300: "on_time", 301: "late", 3600: "late", 3601: "very_late"}
    df = spark.createDataFrame([(d, T0, at(d)) for d in cases], "d int, event_timestamp timestamp, ingested_at timestamp")
    got = {r.d: (r._late_category, r._is_late_arriving) for r in silver.flag_late(df).collect()}
    assert got == {d: (c, d > 300) for d, c in cases.items()}
    none = spark.createDataFrame([(T0, None)], "event_timestamp timestamp, ingested_at timestamp")
    row = silver.flag_late(none).first()
    assert row._is_late_arriving is None and row._late_category == "on_time"


@pytest.mark.parametrize("n,over,extra", [(59, False, 0), (60, False, 0), (61, True, 1)])
def test_limit(spark, n, over, extra):
    df = spark.createDataFrame([("t", T0, at(60), n, "free")], "tenant_id string, window_start timestamp, window_end timestamp, request_count long, plan_tier string")
    row = alerts.limit_alerts(gold.with_limit(df)).first()
    assert (row.alert_type == "over_limit") == over and row.overage == extra
    assert (row.response_config is not None) == over
    assert alerts.decision(df).first().allowed == (n < 60)


def test_unknown_plan_falls_back(spark):
    df = spark.createDataFrame([("gold",), (None,), ("enterprise",)], "p string")
    assert [r[0] for r in df.select(plan_limit(F.col("p"))).collect()] == [60, 60, 5000]


def test_alert_bands(spark):
    bands = {79.99: None, 80.0: "info", 89.99: "info", 90.0: "warning", 100.0: "warning", 100.01: "critical"}
    rows = [("t", T0, at(60), int(p * 100), 10000, p, p > 100, "free") for p in bands]
    df = spark.createDataFrame(rows, "tenant_id string, window_start timestamp, window_end timestamp, request_count long, limit_requests_per_min long, usage_percent double, is_over_limit boolean, plan_tier string")
    got = {r.usage_percent: r.severity for r in alerts.limit_alerts(df).collect()}
    assert got == {p: s for p, s in bands.items() if s}


def test_business_rules_fire_on_definite_violations(spark):
    rows = [("a", 99, 0.0, 0.0), ("b", 100, -0.01, 0.0), ("c", 599, None, 100.0), ("d", 600, 0.0, 100.1), ("e", None, 0.0, None), ("f", 200, 0.0, -1.0)]
    df = spark.createDataFrame([(i, "t", T0, T0, s, x, r, 1.0) for i, s, x, r in rows], "event_id string, tenant_id string, event_timestamp timestamp, ingested_at timestamp, status_code int, latency_ms double, risk_score double, billing_units double")
    got = {r.event_id: r._quality_flags for r in flag(df, silver.stream_rules()).collect()}
    assert got == {"a": ["failed_valid_status_code"], "b": ["failed_valid_latency"], "c": [], "d": ["failed_valid_status_code", "failed_valid_risk_score"], "e": [], "f": ["failed_valid_risk_score"]}


def test_future_events_compare_with_ingestion(spark):
    df = spark.createDataFrame([(s, "t", at(s), T0, 200, 1.0, 1.0, 1.0) for s in (-1, 0, 1)], "event_id int, tenant_id string, event_timestamp timestamp, ingested_at timestamp, status_code int, latency_ms double, risk_score double, billing_units double")
    got = {r.event_id: r._quality_flags for r in flag(df, silver.stream_rules()).collect()}
    assert got == {-1: [], 0: [], 1: ["failed_not_future_event"]}


def test_batch_rules(spark):
    df = spark.createDataFrame([(1, None, 1.0, 1.0, 1.0), (2, 200, 30000.0, 100.0, 0.0), (3, 200, 30000.01, 100.1, -0.01)], "i int, status_code int, latency_ms double, risk_score double, billing_units double")
    got = {r.i: r._quality_flags for r in flag(df, silver.batch_rules()).collect()}
    assert got == {1: ["missing_status_code"], 2: [], 3: ["extreme_latency", "invalid_risk_score", "negative_billing"]}


@pytest.mark.parametrize("risk,limited,quota,odd,kind", [(75, 10, 80, 5, "HEALTHY"), (75.1, 11, 90, 6, "ABUSE_DETECTED"), (75, 11, 90, 6, "RATE_LIMIT_BREACH"), (75, 10, 80.1, 6, "QUOTA_WARNING"), (75, 10, 80, 6, "SUSPICIOUS_ACTIVITY")])
def test_tenant_taxonomy(spark, risk, limited, quota, odd, kind):
    rows = [("t", "free", 1, float(risk), i < limited, i < odd, float(quota)) for i in range(20)]
    df = spark.createDataFrame(rows, "tenant_id string, plan_tier string, velocity_1min int, risk_score double, was_rate_limited boolean, is_suspicious boolean, quota_used_percent double")
    assert alerts.tenant_alerts(df).first().alert_type == kind


def test_first_of_duplicates(spark):
    rows = [("a", at(5), 1), ("a", at(1), 9), ("b", at(1), 7), ("b", at(1), 3), ("c", None, 1), ("c", at(9), 2), (None, at(1), 1), (None, at(2), 2)]
    df = spark.createDataFrame(rows, "event_id string, event_timestamp timestamp, src_offset long")
    got = {r.event_id: r.src_offset for r in silver.keep_first(df).collect()}
    assert got == {"a": 9, "b": 3, "c": 2, None: 1}


def test_parse(spark):
    lines = ['{"event_id":"1","tenant_id":"t","event_timestamp":"2024-01-01T00:00:00Z","response":{"status_code":"oops","latency_ms":2.5},"client":{"user_agent_parsed":{"is_bot":true}}}', "{broken", "{}", "", None, '{"event_id":"2","unknown":1}']
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    table = bronze.to_bronze(as_source_rows(df))
    assert sorted(r.event_id for r in bronze.valid(table).collect()) == ["1", "2"]
    assert bronze.dead_letters(table).count() == 4
    flat = {r.event_id: r for r in silver.flatten(bronze.valid(table)).collect()}
    assert flat["1"].latency_ms == 2.5 and flat["1"].status_code is None and flat["1"].is_bot is True
    assert flat["2"].event_timestamp is None


def test_timestamps(spark):
    texts = ["2024-01-01T00:00:00Z", "2024-01-01T00:00:00+00:00", "2024-01-01T00:00:00.5+00:00Z", "garbage", None]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(parse_time(F.col("t"))).collect()]
    assert got[0] == got[1] == T0 and got[2] == T0 + dt.timedelta(milliseconds=500) and got[3] is None and got[4] is None


def test_ranges_and_enums(spark):
    df = spark.createDataFrame([(0.0, "GET"), (100.0, "get"), (-0.1, None), (100.1, "POST"), (None, "GET")], "x double, m string")
    got = [r._quality_flags for r in flag(df, [in_range("x", 0, 100), one_of("m", ("GET", "POST", None))]).collect()]
    assert got == [[], ["invalid_enum_m"], ["invalid_range_x"], ["invalid_range_x"], []]


def test_event_id_length_and_tenant(spark):
    df = spark.createDataFrame([("x" * n, "t" if n != 37 else "") for n in (35, 36, 37)], "event_id string, tenant_id string")
    got = [r._quality_flags for r in flag(df, quality.value_rules(df.columns)).collect()]
    assert got == [["invalid_event_id_length"], [], ["empty_tenant_id", "invalid_event_id_length"]]


def test_missing_columns_are_reported(spark):
    row = quality.check(spark.createDataFrame([("e",)], "event_id string"), "gold").first()
    assert not row.quality_check_passed and "missing_tenant_id" in row.quality_check_errors["schema_errors"]


@pytest.mark.parametrize("good,kinds", [(9500, set()), (9499, {"low_quality_rate"}), (8000, {"low_quality_rate"}), (7999, {"low_quality_rate", "critical_quality_rate"})])
def test_pass_rates(spark, good, kinds):
    metrics = spark.createDataFrame([("silver", 10000, good, 10000 - good, good / 10000)], "layer string, total_records long, valid_records long, invalid_records long, quality_pass_rate double")
    assert {r.alert_type for r in quality.quality_alerts(metrics).collect()} == kinds


def test_empty_batch_passes(spark):
    empty = quality.check(spark.createDataFrame([], "event_id string"), "silver")
    row = quality.quality_metrics(empty, "silver").first()
    assert row.total_records == 0 and row.quality_pass_rate == 1.0 and row.top_error_types == {}


def _history(spark, counts):
    rows = [(at(3600 * h + i),) for h, n in enumerate(counts) for i in range(n)]
    return spark.createDataFrame(rows, "event_timestamp timestamp")


def test_volume_score(spark):
    as_of = F.lit(at(3600 * 20))
    mean10 = [9, 11] * 6
    score = lambda counts, n: quality.volume_anomaly(_history(spark, counts), F.lit(n), as_of).first()
    assert score(mean10[:11], 100).insufficient_history and not score(mean10[:11], 100).is_anomaly
    assert score([10] * 12, 100).z_score == 0
    sd = (12 / 11) ** 0.5
    found = score(mean10, 15)
    assert found.sample_windows == 12 and abs(found.z_score - 5 / sd) < 1e-9 and found.is_anomaly and found.severity == "critical"


def test_thresholds(spark):
    base = {"avg_processing_lag_sec": 0.0, "data_freshness_sec": 0.0, "kafka_lag_messages": 0, "throughput_rec_per_sec": 1000.0, "error_rate_pct": 0.0, "quality_pass_rate_pct": 100.0, "batch_duration_sec": 1.0}
    names = ", ".join(f"{k} {'long' if k == 'kafka_lag_messages' else 'double'}" for k in base)

    def kinds(**over):
        row = base | over
        df = spark.createDataFrame([(T0, "silver", 1, *row.values())], f"metric_timestamp timestamp, layer string, batch_id long, {names}")
        return [r.alert_type for r in observe.threshold_alerts(df).collect()]

    assert kinds() == []
    for column, family, warning, critical, low in (("avg_processing_lag_sec", "processing_lag", 60.0, 300.0, False), ("throughput_rec_per_sec", "throughput", 100.0, 10.0, True), ("quality_pass_rate_pct", "quality_pass_rate", 95.0, 80.0, True), ("batch_duration_sec", "batch_duration", 30.0, 120.0, False)):
        safe = warning + (1e-6 if low else -1e-6)
        assert kinds(**{column: safe}) == []
        assert kinds(**{column: warning}) == [f"{family}_warning"]
        assert kinds(**{column: critical}) == [f"{family}_critical"]


def test_sustained_runs(spark):
    def runs(minutes):
        df = spark.createDataFrame([("t", at(60 * m), at(60 * m + 60), 95.0) for m in minutes], "tenant_id string, window_start timestamp, window_end timestamp, usage_percent double")
        return [r.minutes for r in alerts.sustained_usage(df).collect()]

    assert runs([0, 1]) == [] and runs([0, 1, 2]) == [3] and runs([0, 1, 2, 3]) == [4]
    assert runs([0, 1, 3, 4]) == []


def test_last_write_and_changes(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "k string, v int, version int")
    new = spark.createDataFrame([("a", 2, 2), ("b", 9, 0), ("c", 3, 1)], "k string, v int, version int")
    merged = {r.k: r.v for r in upsert.last_write(new, old, ("k",), "version").collect()}
    assert merged == {"a": 2, "b": 1, "c": 3}
    assert {r.k for r in upsert.changed_rows(old, new, ("k",), ("v",)).collect()} == {"a", "b"}


def test_plan_as_of(spark):
    facts = spark.createDataFrame([("e1", "t", at(0)), ("e2", "t", at(10)), ("e3", "t", at(20))], "event_id string, tenant_id string, event_timestamp timestamp")
    history = spark.createDataFrame([("t", at(10), "free"), ("t", at(15), "starter")], "tenant_id string, valid_from timestamp, plan_tier string")
    assert {r.event_id: r.plan_as_of for r in audits.plan_as_of(facts, history).collect()} == {"e1": None, "e2": "free", "e3": "starter"}


def test_source_lag(spark):
    batch = spark.createDataFrame([(0, 5), (0, 7), (1, 3)], "_source_partition int, _source_offset long")
    ends = spark.createDataFrame([(0, 10), (1, 3), (2, 4)], "partition int, latest long")
    row = observe.batch_metrics(batch, "bronze", 1, F.lit(T0), latest_offsets=ends).first()
    assert row.kafka_lag_messages == 3 + 0 + 5
