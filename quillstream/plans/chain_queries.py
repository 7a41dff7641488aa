"""Queries of the filter chain, of unit clean-up and of operators whose state ends by time.

Their steps depend on what earlier rows became, so there is no SQL; ``tests/test_chain.py`` and ``tests/test_timed.py`` hold them against plain
restatements and stated cases.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from ..functions import text as tx
from ..operators import chain, fold, semantic, timed, units
from ..sources import tables
from .registry import query


@query()
def g4_echo_trim(spark, d):
    return chain.echo_trim(tables.texts(spark, d), ["doc_id"]).select("doc_id", "n_words", "n_cut", F.sha2("kept", 256).alias("kept"))


@query()
def g5_unit_pair_cleanup(spark, d):
    out = units.unit_pair_cleanup(tables.texts(spark, d), ["doc_id"])
    return out.select("doc_id", "action", "n_units", F.array_join("removed", ",").alias("removed"), "collapsed", F.array_join("reasons", ",").alias("reasons"), F.sha2("cleaned", 256).alias("cleaned"))


@query()
def g6_unit_pair_cleanup_vectors(spark, d):
    out = units.unit_pair_cleanup(tables.texts(spark, d), ["doc_id"], limits=units.Limits(dry_run=False), vectors=units.hashed_vectors)
    return out.select("doc_id", "action", "n_units", F.array_join("removed", ",").alias("removed"), "candidates", "held_back", F.sha2("cleaned", 256).alias("cleaned"))


@query()
def g13_filter_chain(spark, d):
    return fold.ordered_fold(tables.emissions(spark, d), ["stream_id"], ["release_seq"], chain.chain_step(), chain.CHAIN_SCHEMA)


@query()
def h3_word_time_dedup(spark, d):
    """Each emission as a pass over a buffer that is cut every other pass; a word takes 0.35 s."""
    word = lambda w, i: F.struct(w.alias("text"), (i * 0.35).alias("start"), (i * 0.35 + 0.3).alias("end"))
    passes = tables.emissions(spark, d).select(
        "stream_id", F.col("release_seq").alias("pass"), "ts_ms", (F.floor(F.col("release_seq") / 2) * 7.0).alias("offset_s"), F.transform(tx.words(F.col("text")), word).alias("words"),
    )
    return fold.ordered_fold(passes, ["stream_id"], ["pass"], timed.word_time_step(), timed.WORD_TIME_SCHEMA)


@query()
def h1_local_agreement_fuzzy(spark, d):
    return fold.ordered_fold(tables.emissions(spark, d), ["stream_id"], ["release_seq"], timed.agreement_step(3), timed.AGREEMENT_SCHEMA).drop("sentence")


@query()
def h2_stable_sentences(spark, d):
    return fold.ordered_fold(tables.emissions(spark, d), ["stream_id"], ["release_seq"], timed.agreement_step(2, sentence_words=3), timed.AGREEMENT_SCHEMA)


@query()
def g16_fallback_windows(spark, d):
    t = tables.telemetry(spark, d)
    origin = F.when(F.col("k") % 3 == 0, "partial_fallback").when(F.col("k") % 3 == 1, "deadline_fallback").otherwise("confirmed")
    kind = F.when(F.col("k") % 11 == 0, "commit").when(F.col("k") % 13 == 0, "broadcast").when(F.col("k") % 17 == 0, "cancel").otherwise("enqueue")
    release = F.when(kind == "enqueue", F.col("seq")).otherwise(F.lag("seq", 1).over(Window.partitionBy("stream_id").orderBy("ts_ms", "seq")))
    rows = t.select("stream_id", "ts_ms", "seq", origin.alias("origin"), kind.alias("kind"), F.lit("e").alias("epoch"), release.alias("release_seq"))
    return fold.ordered_fold(rows, ["stream_id"], ["ts_ms", "seq"], timed.fallback_step(40_000_000, 80_000_000), timed.WINDOW_SCHEMA, timed.window_at_end(80_000_000))


@query()
def g15_supersede_ledger(spark, d):
    """Every third emission is provisional, with its first words or whole, and comes before the finals of its time."""
    e = tables.emissions(spark, d)
    said = F.when(F.col("release_seq") % 2 == 0, F.array_join(F.slice(tx.words(F.col("text")), 1, 4), " ")).otherwise(F.col("text"))
    early = e.where("release_seq % 3 = 0").select("stream_id", F.lit(None).cast("long").alias("seq"), "ts_ms", F.lit("provisional").alias("kind"), said.alias("text"))
    finals = e.select("stream_id", F.col("release_seq").alias("seq"), (F.col("ts_ms") + F.col("release_seq") % 4 * 9000).alias("ts_ms"), F.lit("final").alias("kind"), "text")
    rows = early.unionByName(finals).withColumn("late_", (F.col("kind") == "final").cast("int"))
    return fold.ordered_fold(rows, ["stream_id"], ["ts_ms", "late_", "seq"], timed.supersede_step(), timed.SUPERSEDE_SCHEMA)


@query()
def g9_semantic_verdicts(spark, d):
    """Emissions as units, with their content words hashed as vectors."""
    vectors = F.pandas_udf(lambda texts: texts.map(lambda t: units.hashed_vectors([t or ""])[0]), ArrayType(DoubleType()))
    rows = tables.emissions(spark, d).select("stream_id", F.col("release_seq").alias("seq"), "release_seq", "ts_ms", "text", vectors(F.col("text")).alias("vec"))
    return semantic.semantic_verdicts(rows, ["stream_id"])
