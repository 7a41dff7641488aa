"""Alignment of texts with timed words, audio frames, and replay of the flow policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def align_exact(texts: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """``texts`` and ``words`` hold ``pos, token``; exact where both have the same tokens at the same places."""
    both = texts.select(*key, "pos", F.col("token").alias("a")).join(words.select(*key, "pos", F.col("token").alias("b")), [*key, "pos"], "full")
    g = both.groupBy(*key).agg(F.count("a").alias("n_text"), F.count("b").alias("n_words"), F.count_if(F.col("a") == F.col("b")).alias("equal"))
    reason = F.when(F.col("n_text") == 0, "no_text").when(F.col("n_words") == 0, "no_words").when(F.col("n_text") != F.col("n_words"), "count").when(F.col("equal") != F.col("n_text"), "tokens")
    return g.withColumn("status", F.when(reason.isNull(), "exact").otherwise("unaligned")).withColumn("reason", reason)


def align_unique_run(texts: DataFrame, words: DataFrame, key: list[str]) -> DataFrame:
    """The one offset at which all tokens of a text run through the words; none if there are two or more."""
    size = texts.groupBy(*key).agg(F.count("*").alias("n_"))
    met = texts.select(*key, F.col("pos").alias("p_"), "token").join(words.select(*key, F.col("pos").alias("q_"), "token"), [*key, "token"])
    runs = met.groupBy(*key, (F.col("q_") - F.col("p_")).alias("offset")).agg(F.count("*").alias("c_")).join(size, key).where("c_ = n_")
    return runs.groupBy(*key).agg(F.min("offset").alias("offset"), F.count("*").alias("runs")).select(*key, "runs", F.when(F.col("runs") == 1, F.col("offset")).alias("offset"))


def compose_lineage(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Word offset of each part in its whole, and whether starts never fall from part to part."""
    w = Window.partitionBy(*by).orderBy(order)
    return parts.withColumn("offset", F.sum("n_words").over(w) - F.col("n_words")).withColumn("monotone", F.coalesce(F.col("start") >= F.lag("start").over(w), F.lit(True)))


def timestamp_audit(words: DataFrame, by: list[str]) -> DataFrame:
    """Counts of words by the state of their times, and a digest of the spans in order."""
    state = F.when(F.col("start").isNull() | F.col("end").isNull(), "missing").when(F.col("end") < F.col("start"), "reversed").when(F.col("end") == F.col("start"), "empty").otherwise("positive")
    x = words.withColumn("state_", state)
    span = F.concat_ws(":", F.col("word").cast("string"), F.coalesce(F.col("start").cast("string"), F.lit("-")), F.coalesce(F.col("end").cast("string"), F.lit("-")))
    ordered = F.array_sort(F.collect_list(F.struct("word", "start", "end", span.alias("s"))))
    return x.groupBy(*by).agg(*[F.count_if(F.col("state_") == s).alias(s) for s in ("missing", "reversed", "empty", "positive")], F.substring(F.sha2(F.array_join(F.transform(ordered, lambda r: r["s"]), ";"), 256), 1, 16).alias("digest"))


def supersession_pairs(chunks: DataFrame, by: list[str], order: str) -> DataFrame:
    """Each older generation of a family with the generation that directly replaces it."""
    w = Window.partitionBy(*by).orderBy(order)
    return chunks.withColumn("newer", F.lead(order).over(w)).where(F.col("newer") > F.col(order))


def reconcile_playout(broadcasts: DataFrame, outcomes: DataFrame, key: list[str]) -> DataFrame:
    """State of every broadcast chunk: starts, completions, completions without a start and starts after a drop."""
    w = Window.partitionBy(*key).orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    seen = lambda o: F.coalesce(F.max((F.col("outcome") == o).cast("int")).over(w), F.lit(0)) == 1
    marked = outcomes.withColumn("bad_", F.when((F.col("outcome") == "completed") & ~seen("started"), "no_start").when((F.col("outcome") == "started") & seen("dropped"), "after_drop"))
    g = marked.groupBy(*key).agg(*[F.count_if(F.col("outcome") == o).alias(o) for o in ("started", "completed", "dropped")], F.count_if(F.col("bad_") == "no_start").alias("no_start"), F.count_if(F.col("bad_") == "after_drop").alias("after_drop"))
    return broadcasts.join(g, key, "left").fillna(0, ["started", "completed", "dropped", "no_start", "after_drop"])


def frame_levels(frames: DataFrame, by: list[str], samples: str = "samples") -> DataFrame:
    """Level of each frame and of the whole: RMS, peak and noise floor (mean RMS of the quietest 20% of frames, one at least)."""
    rms = F.sqrt(F.aggregate(samples, F.lit(0.0), lambda a, x: a + x * x) / F.size(samples))
    levels = frames.where(F.size(samples) > 0).select(*by, "frame", F.round(rms, 9).alias("rms"), F.array_max(F.transform(samples, lambda x: F.abs(x))).alias("peak"))
    own = Window.partitionBy(*by)
    ranked = levels.withColumn("r_", F.row_number().over(own.orderBy("rms", "frame"))).withColumn("n_", F.count("*").over(own))
    quiet = F.when(F.col("r_") <= F.greatest(F.lit(1), F.floor(F.col("n_") * 0.2)), F.col("rms"))
    return ranked.groupBy(*by).agg(F.count("*").alias("frames"), F.round(F.avg("rms"), 6).alias("rms"), F.round(F.max("peak"), 6).alias("peak"), F.round(F.avg(quiet), 6).alias("floor"))


def audio_score(levels: DataFrame) -> DataFrame:
    """Score from 0 to 100 by penalties for level, headroom and noise, and its name."""
    snr = F.when(F.col("floor") > 0, 20 * F.log10(F.col("rms") / F.col("floor"))).otherwise(F.lit(60.0))
    score = 100 - F.when(F.col("rms") < 0.02, 30).when(F.col("rms") > 0.8, 40).when(F.col("rms") < 0.1, 15).otherwise(0) - F.when(snr < 1, 30).when(snr < 2, 10).otherwise(0) - F.when(F.col("peak") >= 0.99, 20).when(F.col("peak") >= 0.95, 10).otherwise(0)
    out = levels.withColumn("score", F.greatest(F.lit(0), score))
    return out.withColumn("level", F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 50, "acceptable").when(F.col("score") >= 25, "poor").otherwise("unusable"))


def speech_segments(frames: DataFrame, by: list[str], order: list[str], speech: Column) -> DataFrame:
    """Runs of speech rows: first, last and rows of each."""
    w = Window.partitionBy(*by).orderBy(*order)
    marked = frames.withColumn("on_", speech).withColumn("new_", F.col("on_") & ~F.coalesce(F.lag("on_").over(w), F.lit(False)))
    run = marked.withColumn("segment", F.sum(F.col("new_").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).where("on_")
    return run.groupBy(*by, "segment").agg(F.min(order[0]).alias("first"), F.max(order[0]).alias("last"), F.count("*").alias("rows"))


#: Least and most level, target level, least, good and excellent signal to noise (dB), volume gate (dB).
LEVELS, SNRS, GATE_DB = (0.01, 0.9, 0.2), (10.0, 20.0, 30.0), -45.0


def audio_quality(frames: DataFrame, by: list[str], samples: str = "samples") -> DataFrame:
    """Level of each key's audio in numbers and decibels, its noise floor, what a transcriber would do with it, score, level and issues.

    The level is that of all samples; the noise floor the mean level of the quietest 20% of frames (one at least), signal to noise 0 where either is
    silent.  The gate opens above -45 dB.  Decibels of silence are null.  The score starts at 100: too quiet, too loud, far from the target, noise and
    clipping take from it, an excellent signal adds 5.  Empty frames and null samples are left out.
    """
    clean = F.filter(F.coalesce(F.col(samples), F.array().cast("array<double>")), lambda x: x.isNotNull())
    sums = frames.withColumn("s_", clean).where(F.size("s_") > 0).select(
        *by, "frame", F.aggregate("s_", F.lit(0.0), lambda a, x: a + x * x).alias("e_"), F.size("s_").alias("k_"), F.array_max(F.transform("s_", F.abs)).alias("p_"),
    ).withColumn("level_", F.sqrt(F.col("e_") / F.col("k_")))
    own = Window.partitionBy(*by)
    ranked = sums.withColumn("r_", F.row_number().over(own.orderBy("level_", "frame"))).withColumn("n_", F.count("*").over(own))
    quiet = F.when(F.col("r_") <= F.greatest(F.lit(1), F.floor(F.col("n_") * 0.2)), F.col("level_"))
    x = ranked.groupBy(*by).agg(F.count("*").alias("frames"), F.sqrt(F.sum("e_") / F.sum("k_")).alias("rms"), F.max("p_").alias("peak"), F.avg(quiet).alias("noise"))
    db = lambda c: F.when(F.col(c) > 0, 20 * F.log10(c))
    x = x.select("*", db("rms").alias("db"), db("peak").alias("peak_db"), db("noise").alias("noise_db"))
    x = x.withColumn("snr", F.coalesce(F.col("db") - F.col("noise_db"), F.lit(0.0))).withColumn("gate", F.coalesce(20 * F.log10(F.col("rms") + 1e-10) > GATE_DB, F.lit(False)))
    (low, high, target), (least, good, best) = LEVELS, SNRS
    level = F.when(F.col("rms") < low, 30 * (1 - F.col("rms") / low)).when(F.col("rms") > high, 40).when(F.col("rms") < target / 2, 15).when(F.col("rms") > target * 2, 10).otherwise(0)
    noise = F.when(F.col("snr") < least, 30 * (1 - F.col("snr") / least)).when(F.col("snr") < good, 10).when(F.col("snr") >= best, -5).otherwise(0)
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.floor(100 - level - noise - F.when(F.col("peak") >= 0.99, 20).when(F.col("peak") >= 0.95, 10).otherwise(0) + 0.5)))
    issues = F.array_join(F.array_compact(F.array(
        F.when(F.col("rms") < low, "too_quiet"), F.when(F.col("peak") >= 0.99, "clipping").when(F.col("peak") >= 0.95, "near_clipping"), F.when(F.col("snr") < least, "high_noise").when(F.col("snr") < good, "moderate_noise"),
    )), ",")
    name = F.when(F.col("score") >= 90, "excellent").when(F.col("score") >= 75, "good").when(F.col("score") >= 50, "acceptable").when(F.col("score") >= 25, "poor").otherwise("unusable")
    out = x.withColumn("score", score).withColumn("quality", name)
    numbers = ("rms", "peak", "noise", "db", "peak_db", "noise_db", "snr")
    return out.select(*by, "frames", *[F.round(c, 5).alias(c) for c in numbers], F.round(F.col("peak_db") - F.col("noise_db"), 5).alias("dynamic_range"), "gate", "score", "quality", issues.alias("issues"))
