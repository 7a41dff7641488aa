"""Latency, counters and percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import bucketed_overlap_join, floor_rank_summary, half_up_mean, rounded


def stage_latencies(events: DataFrame, legs: dict[str, tuple[str, str]], tx: str = "tx_id", without: str | None = None) -> DataFrame:
    """Differences between stage times of each transaction; a later write (``seq``) of a stage wins, a missing stage gives null.

    ``legs``: name -> (from stage, to stage).  A leg named ``capture`` is never negative.  ``without``: only transactions that end
    without this stage, whose legs to and from it are null.
    """
    stages = sorted({s for pair in legs.values() for s in pair} | ({without} if without else set()))
    at = events.groupBy(tx).agg(*[F.max_by(F.when(F.col("stage") == s, F.col("ts_ms")), F.when(F.col("stage") == s, F.struct("seq", "ts_ms"))).alias(f"at_{s}") for s in stages])
    out = [(F.col(f"at_{b}") - F.col(f"at_{a}")).alias(n) if n != "capture" else F.greatest(F.col(f"at_{b}") - F.col(f"at_{a}"), F.lit(0)).alias(n) for n, (a, b) in legs.items()]
    return (at.where(F.col(f"at_{without}").isNull()) if without else at).select(tx, *out)


def first_ack_join(tx: DataFrame, acks: DataFrame, key: str = "tx_id") -> DataFrame:
    """``sent_ms`` of each transaction with the earliest acknowledgement: ``ack_ms, delivery_ms`` (never negative); unknown transactions go."""
    first = acks.groupBy(key).agg(F.min(F.struct("received_ms", "arrival_seq"))["received_ms"].alias("ack_ms"))
    return tx.join(first, key, "left").withColumn("delivery_ms", F.greatest(F.lit(0), F.col("ack_ms") - F.col("sent_ms")) + F.col("ack_ms") * 0)


def last_n_stats(df: DataFrame, by: Sequence[str], n: int, value: str = "value", order: Sequence[str] = ("ts_ms", "seq")) -> DataFrame:
    """Floor-rank summary over the newest ``n`` rows of each key."""
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return floor_rank_summary(df.withColumn("no_", F.row_number().over(newest)).where(F.col("no_") <= n), by, value)


def recent_top_k(df: DataFrame, by: Sequence[str], k: int = 10, order: Sequence[str] = ("ts_ms", "seq")) -> DataFrame:
    """The newest ``k`` rows of each key, numbered from the newest."""
    newest = Window.partitionBy(*by).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= k)


def stream_breakdown(df: DataFrame, by: Sequence[str], value: str = "value", order: Sequence[str] = ("seq",)) -> DataFrame:
    """Rows and half-up rounded average (of the sum in ``order``) of each key."""
    found = df.groupBy(*by).agg(F.count("*").alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("avg"))
    return half_up_mean(found, df, by, value, order).select(*by, "n", "avg")


def emission_summary(df: DataFrame) -> DataFrame:
    """Counts by stream, by stage and by action, and where the runtime's action differs from the controller's, in one pass."""
    filled = df.select(
        *[F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(n) for c, n in (("stream_id", "stream"), ("stage", "stage"), ("controller_action", "action"))],
        (F.col("controller_action") != F.col("runtime_action")).alias("differs"),
    )
    sets = filled.groupingSets([["stream"], ["stage"], ["action"], []], "stream", "stage", "action")
    kind = F.when(F.grouping("stream") == 0, "stream").when(F.grouping("stage") == 0, "stage").when(F.grouping("action") == 0, "action").otherwise("all")
    counted = sets.agg(kind.alias("kind"), F.count("*").alias("n"), F.count_if("differs").alias("mismatches"))
    return counted.select("kind", F.coalesce("stream", "stage", "action", F.lit("all")).alias("name"), "n", "mismatches")


def emission_decision_metric(df: DataFrame) -> DataFrame:
    """Normalised decision and mode by age: to 3 s quality, to 7 s fast, to 12 s catch-up, then no audio."""
    decision = F.when(F.col("decision") == "text_only", "audio_skip").when(F.col("decision").isin("tts", "normal_tts"), "emit").otherwise(F.coalesce("decision", F.lit("emit")))
    age = F.greatest(F.lit(0.0), F.coalesce(F.col("age_ms").cast("double"), F.lit(0.0)))
    mode = (
        F.when(F.col("decision_") == "drop", "drop").when(F.col("decision_") == "audio_skip", "audio_skip")
        .when(F.col("age_") <= 3000, "quality").when(F.col("age_") <= 7000, "fast").when(F.col("age_") <= 12000, "catchup").otherwise("audio_skip")
    )
    out = df.withColumn("decision_", decision).withColumn("age_", age).withColumn("mode", mode)
    return out.select("seq", F.col("decision_").alias("decision"), "mode", F.col("age_").alias("age_ms"), F.greatest(F.lit(0), F.coalesce("queue_depth", F.lit(0))).alias("queue_depth"))


def request_lifecycle(events: DataFrame, key: Sequence[str]) -> DataFrame:
    """Attempts, total age, age of the last attempt and its HTTP code for each request."""
    last = F.max_by("message", F.struct("ts_ms", "seq"))
    return events.groupBy(*key).agg(
        F.count("*").alias("attempts"), (F.max("ts_ms") - F.min("ts_ms")).alias("age_ms"),
        F.regexp_extract(last, r"^HTTP (\d{3})", 1).alias("code"),
    )


def in_flight_profile(intervals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Most intervals open at once, and when first, for each key: running sum of +1 at starts and -1 at ends.

    Equal instants are summed before the running sum, ends first in effect: an interval is open on [start, end).
    """
    steps = intervals.select(*by, F.explode(F.array(F.struct(F.col("start").alias("at"), F.lit(1).alias("d")), F.struct(F.col("end").alias("at"), F.lit(-1).alias("d")))).alias("s"))
    net = steps.groupBy(*by, F.col("s.at").alias("at")).agg(F.sum("s.d").alias("d"))
    running = net.withColumn("open", F.sum("d").over(Window.partitionBy(*by).orderBy("at")))
    return running.groupBy(*by).agg(F.max("open").alias("most"), F.max(F.struct("open", -F.col("at")))["col2"].alias("at_")).select(*by, "most", (-F.col("at_")).alias("first_at"))


def chunk_rate_anomaly(df: DataFrame, by: Sequence[str], duration_ms: int, most: float) -> DataFrame:
    """Chunks per second of each key and window of ``duration_ms``, and whether it is above ``most``."""
    counted = df.groupBy(*by, F.floor(F.col("ts_ms") / duration_ms).alias("window")).agg(F.count("*").alias("chunks"))
    rate = F.col("chunks") * 1000.0 / duration_ms
    return counted.select(*by, "window", "chunks", rounded(rate, 6).alias("rate"), (rate > most).alias("anomalous"))


def in_flight_at(requests: DataFrame, probes: DataFrame, by: Sequence[str], width: int = 65_536) -> DataFrame:
    """At each probe: requests in flight, the oldest one's id, age and age of its attempt.

    ``requests``: by, ``id, start, end`` and ``attempt_start``, in flight on [start, end); ``probes``: by, ``at``.  The oldest is the one that started
    first (ties: the smallest id).  Both meet by an interval join on buckets; probes without any have 0 and nulls, probes that repeat are one.
    """
    by = list(by)
    a = probes.select(*by, F.col("at").alias("a_id"), F.col("at").alias("a_start"), (F.col("at") + 1).alias("a_end")).distinct()
    b = requests.select(*by, F.struct("start", "id", "attempt_start").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = bucketed_overlap_join(a, b, by, width).groupBy(*by, F.col("a_id").alias("at")).agg(F.count("*").alias("in_flight"), F.min("b_id").alias("o_"))
    out = a.select(*by, F.col("a_id").alias("at")).join(met, [*by, "at"], "left")
    return out.select(
        *by, "at", F.coalesce("in_flight", F.lit(0)).alias("in_flight"), F.col("o_.id").alias("oldest"), (F.col("at") - F.col("o_.start")).alias("oldest_age"),
        F.when(F.col("o_").isNotNull(), F.col("at") - F.greatest("o_.start", F.least(F.col("at"), F.col("o_.attempt_start")))).alias("oldest_attempt_age"),
    )
