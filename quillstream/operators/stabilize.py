"""Stabilisation of revised hypotheses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words


def common_prefix_words(a: Column, b: Column) -> Column:
    """Number of leading words that two arrays share."""
    differ = F.transform(a, lambda w, i: F.when(w == F.get(b, i), F.lit(None)).otherwise(i))
    return F.coalesce(F.array_min(differ), F.size(a))


def local_agreement(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """Words confirmed by two passes in a row: the longest common prefix so far (confirmed text only grows)."""
    w = Window.partitionBy(*by).orderBy(order)
    rows = df.withColumn("w_", words(F.col("text")))
    pair = rows.withColumn("both_", F.when(F.lag("w_").over(w).isNotNull(), common_prefix_words(F.col("w_"), F.lag("w_").over(w))).otherwise(F.lit(0)))
    confirmed = F.max("both_").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return pair.withColumn("confirmed", confirmed).select(*by, order, F.size("w_").alias("n_words"), F.col("both_").alias("agreed"), "confirmed")


def hold_last_n(df: DataFrame, by: list[str], order: str, n: int) -> DataFrame:
    """Words of each row that are emitted when all but the last ``n`` words seen so far go out, and words held after it."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("n_words", F.size(words(F.col("text"))))
    upto = rows.withColumn("upto_", F.sum("n_words").over(w)).withColumn("out_", F.greatest(F.lit(0), F.col("upto_") - n))
    before = F.coalesce(F.lag("out_").over(Window.partitionBy(*by).orderBy(order)), F.lit(0))
    return upto.withColumn("emitted", F.col("out_") - before).withColumn("held", F.col("upto_") - F.col("out_")).select(*by, order, "n_words", "emitted", "held")


def release_guard(df: DataFrame, by: list[str], seq: str, digest: Column) -> DataFrame:
    """accept a new highest sequence number, duplicate for a repeat of its text, conflict for another text, stale below."""
    w = Window.partitionBy(*by).orderBy("ts_ms", "arrival")
    rows = df.withColumn("digest_", digest)
    top = F.max(F.col(seq)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first("digest_").over(Window.partitionBy(*by, seq).orderBy("ts_ms", "arrival"))
    place = F.row_number().over(Window.partitionBy(*by, seq).orderBy("ts_ms", "arrival"))
    rows = rows.withColumn("top_", top).withColumn("first_", first).withColumn("place_", place)
    verdict = F.when(F.col("place_") > 1, F.when(F.col("digest_") == F.col("first_"), "duplicate").otherwise("conflict")).when(F.col("top_").isNull() | (F.col(seq) > F.col("top_")), "accept").otherwise("stale")
    return rows.withColumn("verdict", verdict).drop("digest_", "top_", "first_", "place_")


def trim_points(words_: DataFrame, by: list[str], margin: int = 200) -> DataFrame:
    """Where to cut each buffer: behind its last sentence end plus ``margin``, else at the word end nearest to its middle."""
    ends = F.max(F.when(F.col("sentence_end"), F.col("end")))
    half = F.max("end").over(Window.partitionBy(*by)) / 2
    near = F.min(F.struct(F.abs(F.col("end") - F.col("half_")).alias("far"), F.col("end").alias("end")))["end"]
    g = words_.withColumn("half_", half).groupBy(*by).agg(ends.alias("sentence"), near.alias("word"))
    return g.select(*by, F.coalesce(F.col("sentence") + margin, F.col("word")).alias("cut"), F.when(F.col("sentence").isNotNull(), "sentence").otherwise("word").alias("kind"))


def overlap_words(words_: DataFrame, cuts: DataFrame, by: list[str], k: int = 15) -> DataFrame:
    """The last ``k`` words of each key that end after its cut, in order."""
    kept = words_.join(cuts, by).where(F.col("end") > F.col("cut"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("start"), F.desc("end"), F.desc("word")))
    last = kept.withColumn("place_", place).where(F.col("place_") <= k)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", F.col("word").cast("string").alias("w")))), lambda s: s["w"]), " ")
    return last.groupBy(*by).agg(joined.alias("context"), F.count("*").alias("n"))


#: Announcements that a repeat is meant.
CUES = (
    r"\bich\s+sage\s+es\s+(?:nochmals|noch\s+einmal|wieder)\b",
    r"\bich\s+wiederhole\s+(?:es|das|dies)\b",
    r"\bich\s+möchte\s+(?:es|das|dies)\s+wiederholen\b",
)
REPEAT_CUES = "(?i)" + "|".join(CUES)


def protect_rhetorical(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """A proposed skip becomes emit where the text announces its repeat, unless it equals the text right before it."""
    norm = F.trim(F.regexp_replace(F.lower(F.col("text")), r"[^\p{L}\p{N}]+", " "))
    before = F.lag("norm_").over(Window.partitionBy(*by).orderBy(order))
    x = df.withColumn("norm_", norm).withColumn("same_", (F.length("norm_") > 0) & (F.col("norm_") == F.coalesce(before, F.lit(""))))
    saved = (F.col("proposed") == "skip") & ~F.col("same_") & F.col("text").rlike(REPEAT_CUES)
    return x.withColumn("action", F.when(saved, "emit").otherwise(F.col("proposed"))).drop("norm_", "same_")
