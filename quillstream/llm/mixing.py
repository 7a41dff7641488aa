"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, join_facts, null_last_key, scratch, seeded_hash, table, written


def source_targets(sizes: DataFrame, weights: tuple[float, ...], share: float, most: float) -> DataFrame:
    """Targets of sources: ``share`` of all sizes dealt by weight, no target above ``most`` times the source's size.

    ``sizes`` has ``s_`` (sort key) and ``source_size``; sources take the weights in turn, in key order.
    What a capped source cannot take is dealt again by weight to the others.  That has a closed form: with
    sources ordered by cap over weight, a prefix is capped and the rest shares one level.  One row per source.
    """
    one = Window.orderBy("s_")
    numbered = sizes.withColumn("k_", (F.row_number().over(one) - 1) % len(weights)).withColumn(
        "w_", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k_") + 1).cast("int"))
    )
    by_cap = Window.orderBy("c_", "s_")
    rest = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    return (
        numbered.withColumn("c_", most * F.col("source_size") / F.col("w_"))
        .withColumn("all_", F.sum("source_size").over(every) * share)
        .withColumn("level_", (F.col("all_") - F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("w_").over(rest))
        .withColumn("level_", F.min(F.when(F.col("level_") <= F.col("c_"), F.struct("c_", "s_", "level_"))).over(every)["level_"])
        .withColumn("target", F.coalesce(F.least(F.col("level_") * F.col("w_"), most * F.col("source_size")), most * F.col("source_size")))
        .select("s_", "source_size", "target")
    )


def pareto_mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    most: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    odds_weight: Column | None = None,
    short_words: int = 100,
    seed: str = "mix",
    buckets: int = 2048,
) -> DataFrame:
    """How many whole copies of each document the mixture takes.

    A source's expected copies are its target over its size.  The whole part is certain for each of its documents; the
    fraction f is its documents' mean inclusion probability.  Single probabilities differ: p = f + min(f, 1 - f) * (w - mean of w), with w
    the document's ``odds_weight`` over the source's largest and the mean taken by size, so that the expected words stay the target
    and no p leaves 0 to 1.  By default w is size / (size + ``short_words``): of a source that isn't taken whole, very short
    documents come less often.  Documents are ranked
    within the source by the Pareto key (u / (1 - u)) / (p / (1 - p)) with u a seeded hash of the id, and taken in
    that order until the words reach the source's target, so the sample's size is fixed.  Reruns agree.

    Rank ranges (``buckets`` per source) are summed before rows are put in order, and rows of sources that hold much of
    the table meet their source's facts where they are, so no task holds a source.

    Returns ``doc_id, source, size, source_size, target, copies, taken``.  Null text has size 0 and is
    never counted; null source is a source of its own; a source without words has target 0; null and negative odds weights count
    as 0; repeated rows are sampled as rows; an empty table gives no rows.  Other columns are ignored.
    """
    weigh = dict(id_col=id_col, text_col=text_col, source_col=source_col, odds_weight=odds_weight, short_words=short_words, seed=seed)
    drawn, _ = _drawn(docs, weights, share, most, buckets, weigh)
    return drawn


def _drawn(docs: DataFrame, weights: tuple[float, ...], share: float, most: int, buckets: int, weigh: dict) -> tuple[DataFrame, DataFrame]:
    """The rows with their copies, and the written facts of each source (``s_``, what keys are made of, ``rows_``)."""
    rows = _weighed(docs, **weigh).select("doc_id", "source", "s_", "size", "u_", "w_")
    rows = written(rows, "mix-sizes")
    sizes = rows.groupBy("s_").agg(F.sum("size").alias("source_size"), F.sum(F.col("w_") * F.col("size")).alias("ws_"), F.max("w_").alias("top_"), F.count("*").alias("rows_"))
    sizes = written(sizes, "mix-sources")
    sources = source_targets(sizes.select("s_", "source_size"), weights, share, float(most)).join(sizes.drop("source_size"), "s_")
    copies = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    sources = (
        sources.withColumn("e_", copies).withColumn("sure_", F.floor("e_")).withColumn("mean_", F.col("e_") - F.col("sure_"))
        .withColumn("open_", F.col("target") - F.col("sure_") * F.col("source_size"))
        .withColumn("slack_", F.when(F.col("top_") > 0, F.least("mean_", 1 - F.col("mean_")) / F.col("top_")).otherwise(F.lit(0.0)))
        .withColumn("middle_", F.when(F.col("source_size") > 0, F.col("ws_") / F.col("source_size")).otherwise(F.lit(0.0)))
    )
    sources = written(sources, "mix-targets")
    keyed = (
        _with_key(join_facts(rows, sources, ["s_"], "rows_"))
        # scaled so that equal probabilities give back u: ranges of about the same size
        .withColumn("v_", F.col("q_") * F.when((F.col("mean_") > 0) & (F.col("mean_") < 1), _odds("mean_")).otherwise(F.lit(1.0)))
        .withColumn("v_", F.when(F.col("q_") == float("inf"), F.lit(1.0)).otherwise(F.col("v_") / (1 + F.col("v_"))))
        .withColumn("v_", F.when(F.col("mean_") > 0, F.col("v_")).otherwise(F.col("u_")))
        .withColumn("b_", F.least(F.floor(F.col("v_") * buckets), F.lit(buckets - 1)).cast("int"))
        .select("doc_id", "source", "s_", "size", "source_size", "target", "u_", "sure_", "q_", "open_", "b_")
    )
    keyed = written(keyed, "mix-keys")
    spread = keyed.groupBy("s_", "b_").agg(F.sum("size").alias("n_"))
    starts = spread.select("s_", "b_", (F.sum("n_").over(Window.partitionBy("s_").orderBy("b_")) - F.col("n_")).alias("before_"))
    order = Window.partitionBy("s_", "b_").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    drawn = (
        keyed.withColumn("upto_", F.sum("size").over(order))
        .join(starts, ["s_", "b_"])
        .withColumn("middle_", F.col("before_") + F.col("upto_") - F.col("size") / 2)
        .withColumn("copies", (F.col("sure_") + F.when((F.col("middle_") <= F.col("open_")) & (F.col("sure_") < most), 1).otherwise(0)).cast("int"))
    )
    out = drawn.select("doc_id", "source", "size", "source_size", F.col("target").cast("double").alias("target"), "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))
    last = drawn.where(F.col("copies") > F.col("sure_")).groupBy("s_").agg(F.max(F.struct(*_ORDER)).alias("last_"))
    return out, sources.join(last, "s_", "left")


_ORDER = ("q_", "u_", "doc_id", "size")


def _odds(p: str) -> Column:
    return F.col(p) / (1 - F.col(p))


def _weighed(docs: DataFrame, id_col: str, text_col: str, source_col: str, odds_weight: Column | None, short_words: int, seed: str, rest: Column | None = None) -> DataFrame:
    """``doc_id, source, s_, size, u_, w_`` of each row, and ``rest`` beside them."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        null_last_key(F.col(source_col)).alias("s_"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        ((seeded_hash(F.col(id_col), seed) + 0.5) / F.lit(float(1 << 60))).alias("u_"),
        (F.lit(None) if odds_weight is None else F.greatest(F.lit(0.0), F.coalesce(odds_weight.cast("double"), F.lit(0.0)))).cast("double").alias("w_"),
        (F.lit(None) if rest is None else rest).alias("rest_"),
    )
    return rows if odds_weight is not None else rows.withColumn("w_", F.col("size") / (F.col("size") + F.lit(float(short_words))))


def _with_key(rows: DataFrame) -> DataFrame:
    """The Pareto key ``q_`` of rows that have their source's facts."""
    return rows.withColumn("p_", F.col("mean_") + F.col("slack_") * (F.col("w_") - F.col("middle_"))).withColumn(
        "q_", F.when(F.col("p_") >= 1, F.lit(0.0)).when(F.col("p_") > 0, _odds("u_") / _odds("p_")).otherwise(F.lit(float("inf")))
    )


def mixed_documents(
    docs: DataFrame, *, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", odds_weight: Column | None = None, short_words: int = 100, seed: str = "mix", buckets: int = 2048,
) -> DataFrame:
    """The rows of ``docs`` as often as ``pareto_mix`` takes them, columns unchanged.

    A row's copies follow from its own key and from the last key that its source takes, so texts are read where they lie and
    not shuffled.  Repeated rows have one key and share its outcome: a source may then miss its target by these rows.
    """
    weigh = dict(id_col=id_col, text_col=text_col, source_col=source_col, odds_weight=odds_weight, short_words=short_words, seed=seed)
    with scratch() as keep:
        facts = keep(_drawn(docs, weights, share, most, buckets, weigh)[1], "mix-facts")
    rows = _weighed(docs, **weigh, rest=F.struct(*[docs[c] for c in docs.columns]))
    keyed = _with_key(join_facts(rows, facts, ["s_"], "rows_"))
    taken = F.col("last_").isNotNull() & (F.struct(*_ORDER) <= F.col("last_")) & (F.col("sure_") < most)
    copies = F.col("sure_").cast("int") + F.when(taken, 1).otherwise(0)
    often = keyed.withColumn("copies_", copies).where("copies_ > 0").withColumn("copy_", F.explode(F.sequence(F.lit(1), F.col("copies_"))))
    return often.select("rest_.*")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` mixed: weights 5, 2, 1, 150% of all words, at most twice a source's words."""
    return pareto_mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies"
    )
