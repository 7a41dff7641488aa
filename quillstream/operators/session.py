"""Session quality: repeats, pauses, filters and the objective score."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from .core import floor_rank_summary, half_up_mean, islands, rounded


def adjacent_repeats(text: Column) -> Column:
    """Equal neighbours among a text's tokens."""
    w = tokens(text)
    return F.size(F.filter(F.arrays_zip(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))).alias("a"), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"]))


def effective_repeats(raw: Column, source: Column) -> Column:
    """Repeats that the source doesn't have: max(0, raw - min(raw, source))."""
    return F.greatest(F.lit(0), raw - F.least(raw, source))


def pause_bucket(ms: Column) -> Column:
    return F.when(ms < 3000, "0-3s").when(ms < 7000, "3-7s").when(ms < 15000, "7-15s").when(ms >= 15000, ">15s")


def pause_analysis(emissions: DataFrame, inputs: DataFrame, by: list[str]) -> DataFrame:
    """Gap of each emission to the one before, its bucket, and the last input at or before that previous emission (as-of join).

    Both tables are put in one order per key; inputs sort before emissions of the same time.  A pause is the speaker's if that
    input lies ``pause`` or more before the emission.
    """
    both = emissions.select(*by, "ts_ms", "seq", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("input_ms")).unionByName(
        inputs.select(*by, "ts_ms", "seq", F.lit(0).alias("kind"), F.col("ts_ms").alias("input_ms"))
    )
    w = Window.partitionBy(*by).orderBy("ts_ms", "kind", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = both.withColumn("last_input", F.last("input_ms", ignorenulls=True).over(w)).where("kind = 1")
    own = Window.partitionBy(*by).orderBy("ts_ms", "seq")
    out = seen.withColumn("pause_ms", F.col("ts_ms") - F.lag("ts_ms").over(own)).withColumn("input_before", F.lag("last_input").over(own))
    return out.select(*by, "seq", "pause_ms", pause_bucket(F.col("pause_ms")).alias("bucket"), "input_before", (F.col("ts_ms") - F.col("input_before") >= F.col("pause_ms") + 3000).alias("speaker"))


def filter_tally(actions: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Rows of each key for every action."""
    return actions.groupBy(*by).pivot("action", names).agg(F.count(F.lit(1))).fillna(0, names)


def session_split(df: DataFrame, by: list[str], config: Column, idle_ms: int) -> DataFrame:
    """Number of each row's session: a new one when the configuration changes or after an idle gap."""
    w = Window.partitionBy(*by).orderBy("ts_ms", "seq")
    marked = df.withColumn("config_", config)
    starts = F.lag("config_").over(w).isNull() | (F.lag("config_").over(w) != F.col("config_")) | (F.col("ts_ms") - F.lag("ts_ms").over(w) > idle_ms)
    return islands(marked.withColumn("new_", starts), by, ["ts_ms", "seq"], F.col("new_"), "session").drop("config_", "new_")


def config_hash(settings: Column) -> Column:
    """12 characters of SHA-256 over the key-sorted entries of a map of strings."""
    entries = F.array_sort(F.map_entries(settings))
    return F.substring(F.sha2(F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";"), 256), 1, 12)


def objective_score(log: DataFrame, sessions: DataFrame, by: list[str]) -> DataFrame:
    """Weighted repeats, long pauses and starvation of each session, with rejection and confidence.

    ``log``: a row per emission with ``lang, repeats, long_pause (boolean), latency_ms``; ``sessions``: ``segments, duration_min``.  Pauses are
    averaged over languages without weights; weights are 1, 2 and 5; the target is 8 segments a minute.
    """
    per_lang = log.groupBy(*by, "lang").agg(F.count("*").alias("e"), F.count_if("long_pause").alias("p"), F.sum("repeats").alias("r"))
    sums = per_lang.groupBy(*by).agg(F.sum("e").alias("emissions"), F.sum("r").alias("repeats"), F.avg(F.col("p") / F.col("e")).alias("p_norm"), F.count("*").alias("langs"))
    median = floor_rank_summary(log, by, "latency_ms", (0.5,)).select(*by, F.col("p50").alias("median_ms"))
    x = sessions.join(sums, by).join(median, by, "left").withColumn("median_ms", F.coalesce("median_ms", F.lit(0)))
    per_min = F.when(F.col("duration_min") > 0, F.col("segments") / F.col("duration_min")).otherwise(F.lit(0.0))
    x = x.withColumn("per_min", per_min).withColumn("r_norm", F.col("repeats") / F.col("emissions")).withColumn("s_norm", F.greatest(F.lit(0.0), 1 - F.col("per_min") / 8.0))
    base = F.col("r_norm") + 2 * F.col("p_norm") + 5 * F.col("s_norm")
    confidence = F.greatest(F.lit(0.1), F.least(F.lit(1.0), F.col("segments") / 500.0))
    rejection = F.when(F.col("segments") < 10, "few_segments").when(F.col("median_ms") > 6000, "latency").when(F.col("per_min") < 3.0, "starvation")
    return x.select(
        *by, "segments", "emissions", "langs", rejection.alias("rejection"), F.when(rejection.isNotNull(), F.lit(1e9)).otherwise(rounded(base)).alias("score"),
        F.when(rejection.isNotNull(), F.lit(1e9)).otherwise(rounded(base / confidence)).alias("weighted_score"), rounded(confidence, 3).alias("confidence"),
        ((F.col("segments") < 150) | (F.col("duration_min") < 15)).alias("low_confidence"),
    )


BUCKETS = ("0-3s", "3-7s", "7-15s", ">15s")


def _spread(log: DataFrame, by: list[str], column: str, name: str, order: list[str]) -> DataFrame:
    """Least, most, rounded mean (of the sum in ``order``) and floor-rank median of a column's values per key, whose columns end in ``_``."""
    s = half_up_mean(floor_rank_summary(log, by, column, (0.5,)), log, by, column, order)
    return s.select(*[F.col(c).alias(f"{c}_") for c in by], F.col("min").alias(f"{name}_min"), F.col("max").alias(f"{name}_max"), F.col("avg").alias(f"{name}_avg"), F.col("p50").alias(f"{name}_median"))


def language_report(log: DataFrame, by: list[str]) -> DataFrame:
    """Each key's emissions: repeats of words, 2-grams and 3-grams, pauses by bucket and speaker, and how pauses and latencies spread.

    ``log``: a row per emission with ``seq, repeats, bigrams, trigrams, pause_ms, speaker, latency_ms``.  Only pauses above 0 count; missing ones
    and missing latencies are left out, and a key without any has nulls there.  Means are those of sums in order of ``seq``.
    """
    paused = log.withColumn("pause_ms", F.when(F.col("pause_ms") > 0, F.col("pause_ms")))
    bucket = pause_bucket(F.col("pause_ms"))
    counts = paused.groupBy(*by).agg(
        F.count("*").alias("emissions"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("repeats", "bigrams", "trigrams")],
        *[F.count_if(bucket == b).alias(f"pauses_{b}") for b in BUCKETS], F.count_if(F.col("pause_ms").isNotNull() & F.coalesce("speaker", F.lit(False))).alias("speaker_pauses"),
        F.count_if(bucket.isin(*BUCKETS[2:]) & ~F.coalesce("speaker", F.lit(False))).alias("long_pauses"),
    )
    for df, column, name in ((paused, "pause_ms", "pause"), (log, "latency_ms", "latency")):
        spread = _spread(df, by, column, name, ["seq"])
        counts = counts.join(spread, reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in by]), "left").drop(*[f"{c}_" for c in by])
    return counts


def session_summary(log: DataFrame, sessions: DataFrame, actions: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """Roll-up of each session: its report over all languages, what filters did (``actions``: by, action), and its objective.

    ``log`` as for ``language_report``, with ``lang``; ``sessions``: ``segments, duration_min``.  Sessions without filter actions have zeros.
    """
    report = language_report(log, by)
    scored = objective_score(log.withColumn("long_pause", pause_bucket(F.col("pause_ms")).isin(*BUCKETS[2:]) & ~F.coalesce("speaker", F.lit(False))), sessions, by)
    tally = filter_tally(actions, by, names)
    out = report.join(scored.drop("emissions"), by).join(tally, by, "left")
    return out.fillna(0, names)
