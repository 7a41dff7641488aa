"""Live quality at the edges; whole results are compared with SQL in ``test_queries.py``."""

from quillstream.operators import live_quality, metrics, delivery
from pyspark.sql import functions as F


def windows(spark, rows, columns="stream_id long, ts_ms long, stage string, pause_ms double, measurement_age_ms double, queue_depth double", **kw):
    out = live_quality.live_quality(spark.createDataFrame(rows, columns), ["stream_id"], **kw)
    return {r.end_ms: r for r in out.collect()}


def test_a_window_holds_both_its_ends(spark):
    got = windows(spark, [(1, 60_000, "tts", 5.0, None, None), (1, 60_001, "tts", 7.0, None, None)])
    assert sorted(got) == list(range(60_000, 130_000, 10_000))
    assert [got[e].tts for e in sorted(got)] == [1, 2, 2, 2, 2, 2, 2]
    assert [got[e].p95_pause_ms for e in (60_000, 70_000, 120_000)] == [5.0, 7.0, 7.0]


def test_a_listener_counts_while_it_is_fresh(spark):
    got = windows(spark, [(1, 10_000, "listener_telemetry", None, 5_000.0, 9.0), (1, 10_000, "whisper", None, None, 1.0)])
    assert {e: (r.listener_status, r.p95_queue_depth) for e, r in got.items() if e <= 50_000} == {
        10_000: ("live", 9.0), 20_000: ("live", 9.0), 30_000: ("live", 9.0), 40_000: ("stale", 1.0), 50_000: ("stale", 1.0)}
    unknown = windows(spark, [(1, 10_000, "listener_telemetry", None, None, 9.0)])[10_000]
    assert (unknown.listener_status, unknown.p95_queue_depth, unknown.cause_listener_drift, unknown.state) == ("unknown", None, "unknown", "unknown")


def test_states_and_causes(spark):
    assert windows(spark, [(1, 0, "whisper", 12_000.0, None, None)])[0].main_cause == "whisper_delay"
    both = windows(spark, [(1, 0, "whisper", 7_000.0, None, 6.0)])[0]
    assert (both.state, both.main_cause, both.cause_whisper_delay, both.cause_queue_pressure) == ("critical", "queue_pressure", "degraded", "critical")
    negative = windows(spark, [(1, 0, "whisper", -5.0, None, None)])[0]
    assert (negative.p95_pause_ms, negative.confidence, negative.samples) == (0.0, 0.2, 1)


def test_missing_columns_null_times_and_no_rows(spark):
    few = windows(spark, [(1, 5_000, "translation"), (1, None, "translation")], "stream_id long, ts_ms long, stage string")
    assert few[10_000].translations == few[10_000].emissions == 1 and few[10_000].emission_status == "missing"
    assert windows(spark, [], "stream_id long, ts_ms long, stage string") == {}


def test_probes_without_requests(spark):
    requests = spark.createDataFrame([(1, "a", 0, 10, 5), (1, "b", 2, 20, 2)], "k long, id string, start long, end long, attempt_start long")
    probes = spark.createDataFrame([(1, 1), (1, 7), (1, 7), (1, 10), (1, 20), (2, 5)], "k long, at long")
    got = {(r.k, r.at): (r.in_flight, r.oldest, r.oldest_age, r.oldest_attempt_age) for r in metrics.in_flight_at(requests, probes, ["k"], 4).collect()}
    assert got == {(1, 1): (1, "a", 1, 0), (1, 7): (2, "a", 7, 2), (1, 10): (1, "b", 8, 8), (1, 20): (0, None, None, None), (2, 5): (0, None, None, None)}


def test_writes_beyond_the_session_limit(spark):
    rows = [(1, "a", "x", 1), (1, "b", "x", 2), (1, "a", "y", 3), (1, "c", "x", 4), (1, "a", "x", 5), (1, "c", "x", 6), (2, "c", "x", 1)]
    out = delivery.accepted_writes(spark.createDataFrame(rows, "s long, id string, body string, at long"), ["s"], "id", F.col("body"), ["at"], 2)
    assert {(r.s, r.at): r.verdict for r in out.collect()} == {(1, 1): "accepted", (1, 2): "accepted", (1, 3): "conflict", (1, 4): "full", (1, 5): "duplicate", (1, 6): "full", (2, 1): "accepted"}
