"""Live quality of streams over sliding windows: series, counters, rates, freshness, causes and state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import floor_rank_summary, rounded

SERIES = ("first_text_ms", "first_audio_ms", "segment_age_ms", "pause_ms", "queue_depth", "listener_buffer_depth", "listener_drift_ms", "whisper_ms", "gpt_ms", "tts_ms", "confirmation_ms", "stall_ms")
#: Listener records count for these only while their measurement is fresh.
OF_LISTENER = ("queue_depth", "listener_buffer_depth", "listener_drift_ms")
COUNTERS = ("emissions", "translations", "tts", "drops", "audio_skips", "duplicates", "fallbacks", "source_stalls")
STREAMS = ("listener", "whisper", "translation", "tts", "emission")
EMISSION_STAGES = ("emission_decision", "emission_controller_runtime", "emission_controller_shadow")
#: Fixed values: (degraded, critical) of p95s and rates.
LIMITS = {
    "pause_ms": (7000, 12000), "whisper_ms": (3000, 6000), "first_text_ms": (5000, 9000), "confirmation_ms": (5000, 9000), "first_audio_ms": (6000, 10000), "tts_ms": (6000, 10000), "gpt_ms": (1500, 3500),
    "listener_buffer_depth": (2, 5), "listener_drift_ms": (6000, 12000), "queue_depth": (2, 5), "stall_ms": (7000, 12000), "duplicate_rate": (0.08, 0.18), "drop_rate": (0.05, 0.15), "fallback_rate": (0.08, 0.2),
}
#: Causes in order of priority, and what each is judged by.
CAUSES = {
    "listener_drift": ("listener_buffer_depth", "listener_drift_ms"), "tts_backlog": ("first_audio_ms", "tts_ms", "drop_rate"), "gpt_latency": ("gpt_ms",),
    "whisper_delay": ("whisper_ms", "first_text_ms", "confirmation_ms", "pause_ms"), "duplicate_risk": ("duplicate_rate",), "queue_pressure": ("queue_depth",), "source_stall": ("stall_ms", "fallback_rate"),
}
RECORD = ("ts_ms", "stage", "decision", "reason", "duplicates", "emission_id", "latency_ms", "measurement_age_ms", *SERIES)


def _counted(n: dict[str, Column]) -> dict[str, Column]:
    """What one record adds to each counter."""
    of = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    stage, decision, reason = n["stage"], n["decision"], n["reason"]
    return {
        "emissions": of(stage.isin(*EMISSION_STAGES, "translation") | n["emission_id"].isNotNull()), "translations": of(stage == "translation"), "tts": of(stage == "tts"),
        "drops": of(decision.isin("drop", "drop_stale")), "audio_skips": of(decision.isin("audio_skip", "text_only", "text_only_stale")),
        "duplicates": F.greatest(F.lit(0), F.coalesce(n["duplicates"].cast("long"), F.lit(0))),
        "fallbacks": of(F.coalesce(stage == "fallback", F.lit(False)) | F.coalesce(decision == "fallback", F.lit(False)) | F.coalesce(reason == "partial_fallback", F.lit(False))),
        "source_stalls": of(F.coalesce(stage == "source_stall", F.lit(False)) | F.coalesce(reason == "hasNew_false", F.lit(False))),
    }


def _severity(x: Column, name: str) -> Column:
    degraded, critical = LIMITS[name]
    return F.when(x >= critical, 2).when(x >= degraded, 1).otherwise(0)


def live_quality(records: DataFrame, by: list[str], window_ms: int = 60_000, slide_ms: int = 10_000, listener_ms: int = 30_000) -> DataFrame:
    """A row for each key and window end (multiples of ``slide_ms``) whose trailing window has records, both its ends included.

    ``records`` has columns of ``RECORD``; missing ones are null.  For each window: count and floor-rank p95 of twelve series (negative
    values count as 0), eight counters, three rates per emission, the freshness of five record streams (the newest record up to the end: live within the
    window, else stale; missing before the first; a listener's own measurement age counts, and is unknown where it isn't reported), seven
    causes (listener drift only while the listener is live), state, main cause and confidence (five samples make 1).

    Records are added up per pane of ``slide_ms`` first (values counted, counters summed, newest kept) and each pane goes to its windows
    afterwards, so what is copied is a pane's distinct values, not its records; sums and counts merge in any order.
    """
    if window_ms % slide_ms:
        raise ValueError("the window must be a multiple of the slide")
    n = {c: F.col(c) if c in records.columns else F.lit(None) for c in RECORD}
    of_stage = lambda stage, series: F.coalesce(n[series].cast("double"), F.when(n["stage"] == stage, n["latency_ms"].cast("double")))
    value = {s: n[s].cast("double") for s in SERIES} | {"whisper_ms": of_stage("whisper", "whisper_ms"), "gpt_ms": of_stage("translation", "gpt_ms"), "tts_ms": of_stage("tts", "tts_ms")}
    listener = F.coalesce(n["stage"] == "listener_telemetry", F.lit(False))
    pane, panes = F.ceil(n["ts_ms"] / slide_ms), window_ms // slide_ms
    last = pane + panes - 1 + (n["ts_ms"] % slide_ms == 0).cast("long")  # a record on a window's first instant belongs to it
    fresh_to = F.when(n["measurement_age_ms"].isNotNull(), F.floor((n["ts_ms"] + listener_ms - F.greatest(F.lit(0.0), n["measurement_age_ms"].cast("double"))) / slide_ms)).otherwise(pane - 1)
    rows = records.where(n["ts_ms"].isNotNull()).select(
        *by, n["ts_ms"].cast("long").alias("ts_"), pane.alias("pane_"), last.alias("last_"), F.when(listener, F.least(last, fresh_to)).otherwise(last).alias("fresh_"),
        n["measurement_age_ms"].cast("double").alias("age_"), *[c.alias(f"c_{k}") for k, c in _counted(n).items()],
        F.array_compact(F.array(*[F.when(value[s].isNotNull() & ~F.isnan(value[s]), F.struct(F.lit(s).alias("series"), F.greatest(F.lit(0.0), value[s]).alias("v"))) for s in SERIES])).alias("values_"),
        *[c.alias(f"s_{k}") for k, c in {
            "listener": listener, "whisper": F.coalesce(n["stage"] == "whisper", F.lit(False)) | n["whisper_ms"].isNotNull(), "translation": F.coalesce(n["stage"] == "translation", F.lit(False)) | n["gpt_ms"].isNotNull(),
            "tts": F.coalesce(n["stage"] == "tts", F.lit(False)) | n["tts_ms"].isNotNull(), "emission": F.coalesce(n["stage"].isin(*EMISSION_STAGES), F.lit(False)),
        }.items()],
    )
    to = lambda until: F.explode(F.when(until >= F.col("pane_"), F.sequence("pane_", until)).otherwise(F.array().cast("array<bigint>"))).alias("end_")

    each = rows.select(*by, "pane_", "last_", "fresh_", F.explode("values_").alias("x"))
    until = F.when(F.col("x.series").isin(*OF_LISTENER), F.col("fresh_")).otherwise(F.col("last_"))
    counted = each.select(*by, "pane_", until.alias("until_"), "x.series", "x.v").groupBy(*by, "pane_", "until_", "series", "v").agg(F.count("*").alias("w_"))
    merged = counted.select(*by, "series", "v", "w_", to(F.col("until_"))).groupBy(*by, "end_", "series", "v").agg(F.sum("w_").alias("w_"))
    ranked = floor_rank_summary(merged, [*by, "end_", "series"], "v", weight="w_")
    series = ranked.groupBy(*by, "end_").agg(
        *[F.max(F.when(F.col("series") == s, F.col("p95"))).alias(s) for s in SERIES], F.sum("n").alias("n_values"),
    )
    newest = lambda s: F.max(F.when(F.col(f"s_{s}"), F.struct("ts_", "age_")))
    pane_sums = rows.groupBy(*by, "pane_", "last_").agg(*[F.sum(f"c_{k}").alias(k) for k in COUNTERS], *[newest(s).alias(f"new_{s}") for s in STREAMS])
    sums = pane_sums.select("*", to(F.col("last_"))).groupBy(*by, "end_").agg(*[F.sum(k).alias(k) for k in COUNTERS], *[F.max(f"new_{s}").alias(f"new_{s}") for s in STREAMS])

    now = F.col("end_") * slide_ms
    upto = Window.partitionBy(*by).orderBy("end_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # two halves of a row meet by grouping: each column comes from one of them
    whole = sums.unionByName(series, allowMissingColumns=True).groupBy(*by, "end_").agg(*[F.max(c).alias(c) for c in (*COUNTERS, *[f"new_{s}" for s in STREAMS], *SERIES, "n_values")])
    seen = whole.select(*by, "end_", *COUNTERS, *SERIES, F.coalesce("n_values", F.lit(0)).alias("n_values"), *[F.max(f"new_{s}").over(upto).alias(f"new_{s}") for s in STREAMS])

    def status(s: str) -> Column:
        rec = F.col(f"new_{s}")
        age = now - rec["ts_"]
        live = age <= window_ms
        if s == "listener":
            live = F.greatest(F.lit(0.0), rec["age_"]) + F.greatest(F.lit(0), age) <= listener_ms
            return F.when(rec.isNull(), "missing").when(rec["age_"].isNull(), "unknown").when(live, "live").otherwise("stale")
        return F.when(rec.isNull(), "missing").when(live, "live").otherwise("stale")

    per = lambda *up: rounded(sum((F.col(c) for c in up), F.lit(0)) / F.greatest(F.lit(1), F.col("emissions")))
    x = seen.withColumn("drop_rate", per("drops", "audio_skips")).withColumn("duplicate_rate", per("duplicates")).withColumn("fallback_rate", per("fallbacks"))
    for s in STREAMS:
        x = x.withColumn(f"is_{s}", status(s))
    for cause, parts in CAUSES.items():
        worst = F.greatest(*[_severity(F.col(p), p) for p in parts], F.lit(0))
        if cause == "source_stall":
            worst = F.greatest(worst, (F.col("source_stalls") > 0).cast("int"))
        x = x.withColumn(f"cause_{cause}", F.when(F.col("is_listener") == "live", worst) if cause == "listener_drift" else worst)
    worst = F.greatest(*[F.coalesce(f"cause_{c}", F.lit(0)) for c in CAUSES])
    first = lambda level: F.coalesce(*[F.when(F.col(f"cause_{c}") == level, F.lit(c)) for c in CAUSES])
    samples = F.col("n_values") + sum((F.col(c) for c in COUNTERS), F.lit(0))
    all_live = F.lit(True)
    for s in STREAMS:
        all_live = all_live & (F.col(f"is_{s}") == "live")
    name = lambda level: F.when(level == 2, "critical").when(level == 1, "degraded").when(level == 0, "good")
    return x.select(
        *by, now.alias("end_ms"), F.when(worst > 0, name(worst)).when(~all_live, "unknown").otherwise("good").alias("state"), F.coalesce(first(2), first(1), F.lit("healthy")).alias("main_cause"),
        rounded(F.least(F.lit(1.0), samples / 5.0)).alias("confidence"), samples.alias("samples"), *[F.col(s).alias(f"p95_{s}") for s in SERIES], *COUNTERS, "drop_rate", "duplicate_rate", "fallback_rate",
        *[F.col(f"is_{s}").alias(f"{s}_status") for s in STREAMS], *[F.coalesce(name(F.col(f"cause_{c}")), F.lit("unknown")).alias(f"cause_{c}") for c in CAUSES],
    )
