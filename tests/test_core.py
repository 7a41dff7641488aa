import random

from quillstream.operators import core, fold, health, metrics, session, stabilize, text
from pyspark.sql import functions as F


def test_floor_rank_is_not_the_discrete_percentile(spark):
    df = spark.createDataFrame([("a", float(v)) for v in range(4)] + [("a", None)], "g string, v double")
    row = core.floor_rank_summary(df, ["g"], "v").first()
    assert (row.n, row.p50, row.p95) == (4, 2.0, 3.0)  # index floor(0.5 * 4) = 2


def test_merge_intervals_is_idempotent(spark):
    rng = random.Random(1)
    spans = [(rng.randrange(3), s := rng.randrange(500), s + rng.randrange(0, 30)) for _ in range(200)]
    df = spark.createDataFrame(spans, "k int, start long, end long")
    once = core.merge_intervals(df, ["k"], "start", "end")
    twice = core.merge_intervals(once.select("k", "start", "end"), ["k"], "start", "end")
    rows = lambda d: sorted((r.k, r.start, r.end) for r in d.collect())
    assert rows(once) == rows(twice)
    want = set()
    for k, s, e in spans:
        want |= {(k, x) for x in range(s, e)}
    assert {(k, x) for k, s, e in rows(once) for x in range(s, e)} == want


def test_bucketed_overlap_join_gives_each_pair_once(spark):
    rng = random.Random(2)
    make = lambda p: [(rng.randrange(2), i, s := rng.randrange(300), s + rng.randrange(0, 90)) for i in range(60)]
    a, b = make("a"), make("b")
    da = spark.createDataFrame(a, "k int, a_id int, a_start long, a_end long")
    db = spark.createDataFrame(b, "k int, b_id int, b_start long, b_end long")
    got = sorted((r.a_id, r.b_id, r.overlap) for r in core.bucketed_overlap_join(da, db, ["k"], 37).collect())
    want = sorted((i, j, min(e, f) - max(s, t)) for k, i, s, e in a for m, j, t, f in b if k == m and s < e and t < f and min(e, f) > max(s, t))
    assert got == want


def test_band_pairs_are_the_rows_before(spark):
    df = spark.createDataFrame([(k, i) for k in "ab" for i in range(13)], "k string, i int")
    got = sorted((r.k, r.cur.i, r.old.i) for r in core.band_pairs(df, ["k"], ["i"], 4).collect())
    assert got == sorted((k, i, j) for k in "ab" for i in range(13) for j in range(max(0, i - 4), i))


def test_rate_alert_fires_once_until_it_falls(spark):
    times = [0, 10, 20, 30, 1000, 1010, 1020]
    df = spark.createDataFrame([("s", t, i) for i, t in enumerate(times)], "stream_id string, ts_ms long, seq long")
    got = [r.seq for r in health.rate_alerts(df, ["stream_id"], 3, 100).orderBy("seq").collect()]
    assert got == [2, 6]


def test_confirmed_prefix_only_grows(spark):
    rows = [("s", 1, "a b c"), ("s", 2, "a b d"), ("s", 3, "x"), ("s", 4, "a b d e")]
    out = stabilize.local_agreement(spark.createDataFrame(rows, "stream_id string, p int, text string"), ["stream_id"], "p").orderBy("p").collect()
    assert [r.confirmed for r in out] == [0, 2, 2, 2]


def test_redaction(spark):
    df = spark.createDataFrame([("Bearer abc.def  and token=xyz",)], "t string")
    assert df.select(text.redact(F.col("t"))).first()[0] == "Bearer [REDACTED] and token=[REDACTED]"


def plain_fold(rows, step):
    state, out = {}, []
    for row in rows:
        state, got = step(state, row)
        if got is not None:
            out.append(got)
    return out


def test_batch_fold_equals_a_plain_fold_per_key(spark):
    rng = random.Random(3)
    rows = [{"stream_id": rng.randrange(5), "ts_ms": rng.randrange(10_000), "seq": i} for i in range(300)]
    df = spark.createDataFrame(rows, "stream_id long, ts_ms long, seq long")
    got = fold.ordered_fold(df, ["stream_id"], ["ts_ms", "seq"], fold.limit_step(3, 900), fold.LIMIT_SCHEMA).collect()
    want = []
    for k in range(5):
        own = sorted((r for r in rows if r["stream_id"] == k), key=lambda r: (r["ts_ms"], r["seq"]))
        want += plain_fold(own, fold.limit_step(3, 900))
    key = lambda r: r["seq"]
    assert sorted((r.asDict() for r in got), key=key) == sorted(want, key=key)


def test_stream_fold_equals_the_batch_fold(spark, tmp_path):
    from quillstream.streaming.stateful import stream_fold

    rows = [(k, t, 10 * k + t) for k in range(3) for t in range(8)]
    df = spark.createDataFrame(rows, "stream_id long, ts_ms long, seq long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    step, schema = fold.limit_step(3, 100), fold.LIMIT_SCHEMA
    stream = stream_fold(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["stream_id"], ["ts_ms", "seq"], step, schema)
    q = stream.writeStream.format("memory").queryName("limited").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("limited").collect()))
    want = sorted(map(tuple, fold.ordered_fold(df, ["stream_id"], ["ts_ms", "seq"], step, schema).collect()))
    assert got == want and want


#: A mean of 40.5; the sum in this order is a little less.
HALF = [12.48, 39.79, 15.88, 99.52, 86.33, 11.96, 26.14, 49.52, 15.32, 48.06]


def test_a_mean_at_a_half_is_rounded_as_its_sum_in_order_whatever_the_dealing(spark):
    rows = [(k, "a", i, v) for k in (1, None) for i, v in enumerate(HALF)] + [(2, "a", i, v) for i, v in enumerate(reversed(HALF))] + [(3, "a", 0, None), (4, None, 0, 1.25), (4, None, 1, None)]
    columns = "stream_id long, stage string, seq long, value double"
    for dealt in (spark.createDataFrame(rows, columns).coalesce(1), spark.createDataFrame(rows[::-1], columns).coalesce(1), spark.createDataFrame(rows, columns).repartition(7)):
        got = {(r.stream_id, r.stage): (r.n, r.avg) for r in metrics.stream_breakdown(dealt, ["stream_id", "stage"]).collect()}
        assert got == {(1, "a"): (10, 40), (None, "a"): (10, 40), (2, "a"): (10, 41), (3, "a"): (1, None), (4, None): (2, 1)}


def test_the_report_of_a_language_rounds_latencies_in_order_and_has_keys_without_a_name(spark):
    rows = [(k, i, 0, 0, 0, 1000 * i, False, v) for k in (1, None) for i, v in enumerate(HALF)]
    columns = "stream_id long, seq long, repeats long, bigrams long, trigrams long, pause_ms long, speaker boolean, latency_ms double"
    for dealt in (spark.createDataFrame(rows, columns).coalesce(1), spark.createDataFrame(rows[::-1], columns).coalesce(1), spark.createDataFrame(rows, columns).repartition(7)):
        got = {r.stream_id: (r.emissions, r.pause_min, r.pause_avg, r.latency_max, r.latency_avg, r.latency_median) for r in session.language_report(dealt, ["stream_id"]).collect()}
        assert got == {1: (10, 1000, 5000, 99.52, 40, 39.79), None: (10, 1000, 5000, 99.52, 40, 39.79)}
