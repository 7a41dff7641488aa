"""Interval lineage: merging, overlap and coverage of spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import bucketed_overlap_join, merge_intervals


def overlap_join(a: DataFrame, b: DataFrame, by: list[str], width: int = 2048) -> DataFrame:
    """Overlapping pairs of two span sets with the samples in which they overlap."""
    return bucketed_overlap_join(a, b, by, width)


def to_sample_spans(words: DataFrame, by: list[str], rate: int = 16000) -> DataFrame:
    """Seconds to half-open samples with the first reason that rejects a word: missing, negative, reversed, empty or a start before the last."""
    start, end = F.bround(F.col("start_s") * rate).cast("long"), F.bround(F.col("end_s") * rate).cast("long")
    w = Window.partitionBy(*by).orderBy("pos")
    out = words.withColumn("start", start).withColumn("end", end).withColumn("prev_", F.lag("start").over(w))
    reason = (
        F.when(F.col("start_s").isNull() | F.col("end_s").isNull(), "missing").when(F.col("start_s") < 0, "negative").when(F.col("end") < F.col("start"), "reversed")
        .when(F.col("end") == F.col("start"), "empty").when(F.col("start") < F.col("prev_"), "not_monotone")
    )
    return out.withColumn("reason", reason).drop("prev_")


def coverage_map(spans: DataFrame, by: list[str]) -> DataFrame:
    """Words with a proof, their share, and the samples that the proofs cover."""
    merged = merge_intervals(spans.where(F.col("end") > F.col("start")), by, "start", "end").groupBy(*by).agg(F.sum(F.col("end") - F.col("start")).alias("covered"), F.count("*").alias("ranges"))
    counts = spans.groupBy(*by).agg(F.count("*").alias("n_words"), F.count_if(F.col("end") > F.col("start")).alias("proven"))
    status = F.when(F.col("proven") == F.col("n_words"), "complete").when(F.col("proven") > 0, "partial").otherwise("missing")
    return counts.join(merged, by, "left").select(*by, "n_words", "proven", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("ranges", F.lit(0)).alias("ranges"), status.alias("status"))


def revision_relation(pairs: DataFrame) -> DataFrame:
    """Relation of two intervals: same, newer contains older, older contains newer, partial, adjacent or disjoint."""
    rel = (
        F.when((F.col("a_start") == F.col("b_start")) & (F.col("a_end") == F.col("b_end")), "same_source")
        .when((F.col("b_start") <= F.col("a_start")) & (F.col("b_end") >= F.col("a_end")), "newer_contains_older")
        .when((F.col("a_start") <= F.col("b_start")) & (F.col("a_end") >= F.col("b_end")), "older_contains_newer")
        .when((F.col("a_start") < F.col("b_end")) & (F.col("b_start") < F.col("a_end")), "partial")
        .when((F.col("a_end") == F.col("b_start")) | (F.col("b_end") == F.col("a_start")), "adjacent").otherwise("disjoint")
    )
    return pairs.withColumn("relation", rel)


def sequence_audit(df: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """Equal and negative steps between neighbours, and whether a key's values never fall."""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order))
    x = df.withColumn("step_", step)
    return x.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("step_") == 0).alias("equal_steps"), F.count_if(F.col("step_") < 0).alias("negative_steps"), (F.count_if(F.col("step_") < 0) == 0).alias("monotone"))


def committed_prefix(words: DataFrame, ranges: DataFrame, by: list[str], key: list[str], width: int = 2048) -> DataFrame:
    """Leading words of each text that lie wholly inside committed ranges.

    ``ranges`` are merged first, so that each word overlaps one range at most as a whole.
    """
    merged = merge_intervals(ranges, by, "start", "end").select(*by, F.col("start").alias("b_start"), F.col("end").alias("b_end"), F.lit(0).alias("b_id"))
    a = words.select(*by, *key, F.struct(*key, "word").alias("a_id"), "word", F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    inside = bucketed_overlap_join(a, merged, by, width).where((F.col("b_start") <= F.col("a_start")) & (F.col("b_end") >= F.col("a_end"))).select(
        *by, *key, "word", F.col("a_start").alias("start"), F.col("a_end").alias("end")
    ).distinct()
    marked = words.join(inside.withColumn("in_", F.lit(True)), [*by, *key, "word", "start", "end"], "left")
    return marked.groupBy(*by, *key).agg(F.count("*").alias("n_words"), F.min(F.when(F.col("in_").isNull(), F.col("word"))).alias("first_open"), F.max("word").alias("last")).select(
        *by, *key, "n_words", F.coalesce(F.col("first_open") - 1, F.col("last")).alias("committed")
    )


def token_sequence_audit(df: DataFrame, by: list[str], order: list[str], value: str, digits: int = 2) -> DataFrame:
    """How timestamps of a sequence step: equal, equal only when rounded, or back; runs of equal values; zeros that lead it.

    A null or non-finite value is unmeasurable: it makes no pair and breaks a run.  ``runs`` and ``rounded_runs`` list the lengths of two and more with
    their counts, ``longest`` and ``rounded_longest`` the longest run (1 where nothing repeats, 0 without values).  ``monotone`` is null without pairs.
    Counts come from one sort per key; runs are counted after they are grouped.
    """
    w = Window.partitionBy(*by).orderBy(*order)
    x = F.col(value).cast("double")
    rows = df.select(*by, F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x).alias("v_"), F.row_number().over(w).alias("i_"))
    own = Window.partitionBy(*by).orderBy("i_")
    rows = rows.withColumn("r_", F.round("v_", digits)).withColumn("p_", F.lag("v_").over(own)).withColumn("q_", F.lag("r_").over(own))
    new = lambda now, before: F.coalesce((F.col(now) != F.col(before)), F.lit(True)).cast("int")
    upto = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("run_", F.sum(new("v_", "p_")).over(upto)).withColumn("rrun_", F.sum(new("r_", "q_")).over(upto))
    step = F.col("v_") - F.col("p_")
    counts = rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.count("v_").alias("measurable"), F.countDistinct("v_").alias("distinct_values"), F.countDistinct("r_").alias("distinct_rounded"), F.count(step).alias("pairs"),
        F.count_if(step == 0).alias("equal_steps"), F.count_if((step != 0) & (F.col("r_") == F.col("q_"))).alias("rounded_steps"), F.count_if(step < 0).alias("negative_steps"),
        F.round(F.min(F.when(step > 0, step)), 6).alias("least_step"), F.coalesce(F.min(F.when(F.coalesce(F.col("v_") != 0, F.lit(True)), F.col("i_"))) - 1, F.count("*")).alias("leading_zeros"),
    )

    def lengths(island: str, name: str, longest: str) -> DataFrame:
        each = rows.where("v_ is not null").groupBy(*by, island).agg(F.count("*").alias("len_")).groupBy(*by, "len_").agg(F.count("*").alias("c_"))
        listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("len_") > 1, F.struct("len_", "c_")))), lambda s: F.concat_ws(":", s["len_"].cast("string"), s["c_"].cast("string"))), ",")
        return each.groupBy(*by).agg(F.max("len_").alias(longest), listed.alias(name))

    out = counts.join(lengths("run_", "runs", "longest"), by, "left").join(lengths("rrun_", "rounded_runs", "rounded_longest"), by, "left")
    out = out.fillna(0, ["longest", "rounded_longest"]).fillna("", ["runs", "rounded_runs"])
    return out.withColumn("monotone", F.when(F.col("pairs") > 0, F.col("negative_steps") == 0))
