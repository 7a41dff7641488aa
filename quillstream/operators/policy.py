"""Replay of logged policy decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replay_emission_policy(
    df: DataFrame, *, quality_ms: float = 3000, fast_ms: float = 7000, catchup_ms: float = 12000, drop_ms: float = 20000, unhealthy: int = 4, overloaded: int = 8
) -> DataFrame:
    """Action and mode of each row from age, queue depth and health."""
    age = F.greatest(F.lit(0.0), F.coalesce("age_ms", F.lit(0.0)))
    depth = F.greatest(F.lit(0), F.coalesce("queue_depth", F.lit(0)))
    unstable = ~(F.coalesce("asr_stable", F.lit(True)) & F.coalesce("semantic_complete", F.lit(True)))
    verdict = (
        F.when(age >= drop_ms, "drop/drop/too_old")
        .when(~F.coalesce("tts_enabled", F.lit(True)), "audio_skip/audio_skip/tts_disabled")
        .when(~F.coalesce("provider_healthy", F.lit(True)), "audio_skip/audio_skip/provider_unhealthy")
        .when((depth >= overloaded) & (age >= fast_ms), "merge/catchup/queue_overloaded")
        .when((depth >= unhealthy) & (age >= catchup_ms), "audio_skip/audio_skip/age_and_queue")
        .when(unstable & (age < quality_ms), "hold/quality/young_unstable")
        .when(unstable & (age < fast_ms), "emit/fast/age_forces_unstable")
        .when(age <= quality_ms, "emit/quality/fresh")
        .when(age <= fast_ms, "emit/fast/getting_old")
        .when(age <= catchup_ms, "merge/catchup/catchup_age")
        .otherwise("audio_skip/audio_skip/over_catchup")
    )
    parts = F.split("verdict_", "/")
    return df.withColumn("verdict_", verdict).withColumns({"action": parts[0], "mode": parts[1], "reason": parts[2]}).drop("verdict_")


def replay_age_budget(df: DataFrame, *, cautious_ms: float = 8000, text_only_ms: float = 12000, drop_ms: float = 20000, unhealthy: int = 4) -> DataFrame:
    """normal_tts, text_only_stale or drop_stale from age and queue depth."""
    age, depth = F.greatest(F.lit(0.0), F.coalesce("age_ms", F.lit(0.0))), F.greatest(F.lit(0), F.coalesce("queue_depth", F.lit(0)))
    return df.withColumn(
        "budget",
        F.when(age > drop_ms, "drop_stale").when(age > text_only_ms, "text_only_stale").when((age > cautious_ms) & (depth >= unhealthy), "text_only_stale").otherwise("normal_tts"),
    )


def policy_disagreement(df: DataFrame, logged: str, replayed: str) -> DataFrame:
    """Rows for every pair of logged and replayed action."""
    return df.groupBy(F.col(logged).alias("logged"), F.col(replayed).alias("replayed")).agg(F.count("*").alias("n"))


#: Profile for each state and main cause; ``*`` is any other cause.
PROFILES = {
    "critical": {"tts_backlog": "text_only", "whisper_delay": "catchup", "source_stall": "catchup", "*": "critical"},
    "degraded": {"tts_backlog": "text_only", "queue_pressure": "catchup", "listener_drift": "catchup", "duplicate_risk": "normal", "*": "fast"},
}


def recommend_profile(df: DataFrame, least_confidence: float = 0.6) -> DataFrame:
    """Profile for each row's state and main cause; normal where confidence is low or the state is good or unknown."""
    by_state = None
    for state, causes in PROFILES.items():
        own = F.coalesce(*[F.when(F.col("main_cause") == c, F.lit(p)) for c, p in causes.items() if c != "*"], F.lit(causes["*"]))
        by_state = F.when(F.col("state") == state, own) if by_state is None else by_state.when(F.col("state") == state, own)
    return df.withColumn("profile", F.when(F.col("confidence") < least_confidence, "normal").otherwise(F.coalesce(by_state, F.lit("normal"))))


#: Age in ms from which a stable prefix may be released, by profile.
RELEASE_AGES = {"fast": 5000, "catchup": 3500, "critical": 2500}
#: Short words that are held back when a text has nothing else.
HELD_WORDS = ("amen", "ja", "nein", "und", "oder", "aber", "also")


def replay_flow_policy(df: DataFrame) -> DataFrame:
    """hold, micro_emit, soft_commit, fallback or merge for each text from its profile, age and stable words.

    Completeness: 0.85 with a stop, 0.65 with a soft mark and 6 words, 0.55 with 10 words, else 0.25.
    """
    text = F.regexp_replace(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "), "^ | $", "")
    x = df.withColumn("t_", text).withColumn("w_", F.filter(F.split("t_", " "), lambda w: w != ""))
    n, stop, soft = F.size("w_"), F.col("t_").rlike("[.!?]$"), F.col("t_").rlike("[,;:]$")
    complete = F.when(n == 0, 0.0).when(stop, 0.85).when(soft & (n >= 6), 0.65).when(n >= 10, 0.55).otherwise(0.25)
    bare = F.transform("w_", lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}\p{N}]", ""))
    risky = (n > 0) & (n <= 3) & F.forall(F.filter(bare, lambda w: w != ""), lambda w: w.isin(*HELD_WORDS))
    ages = F.coalesce(*[F.when(F.col("profile") == p, F.lit(a)) for p, a in RELEASE_AGES.items()])
    quick = F.col("profile").isin(*RELEASE_AGES)
    stable = F.array_join(F.slice("w_", 1, F.greatest(F.lit(0), F.least(F.col("stable_words"), F.size("w_")))), " ")
    commit = quick & (F.col("age_ms") >= ages) & (F.col("stable_words") >= 5) & (F.length(stable) >= 28) & (F.length(stable) * 100 >= F.length("t_") * 55) & (complete >= 0.45)
    fallback = quick & (F.col("age_ms") >= F.when(F.col("profile") == "critical", 4500).otherwise(7000)) & (n >= 4) & (complete >= 0.45)
    micro = (n >= 4) & (F.length("t_") >= 24) & (stop | (quick & soft & (F.col("age_ms") >= ages) & (complete >= 0.75)))
    verdict = (
        F.when(n == 0, "hold").when(risky, F.when(F.col("age_ms") >= 12000, "merge").otherwise("hold")).when(fallback, "fallback").when(commit, "soft_commit").when(micro, "micro_emit")
        .when(F.col("age_ms") >= 12000, "merge").otherwise("hold")
    )
    return x.withColumn("decision", verdict).drop("t_", "w_")
