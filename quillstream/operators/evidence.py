"""Lineage built and sliced, provisional text and what supersedes it, late rows, dictionary look-ups and open cuts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens, words
from .lineage import align_exact
from .text import OPEN_WORDS, safe_boundary


def build_lineage(texts: DataFrame, spans: DataFrame, inputs: DataFrame, key: list[str]) -> DataFrame:
    """``complete`` where words, ranges, bounds, order and identity of a text's spans all hold, else the first reason that doesn't.

    ``texts``: key, pos, token; ``spans``: key, pos, token, start, end; ``inputs``: key, aligned, input_start, input_end, chunk_id, one row
    a key.  A key without text is ``missing``, one without spans too; the others are ``ambiguous``.  Null bounds and times fail their rule.
    """
    w = Window.partitionBy(*key).orderBy("pos", "start", "end")
    ranged = F.coalesce(F.col("end") > F.col("start"), F.lit(False))
    back = F.coalesce((F.col("start") < F.lag("start").over(w)) | (F.col("end") < F.lag("end").over(w)), F.lit(False))
    held = spans.withColumn("ranged_", ranged).withColumn("back_", back).groupBy(*key).agg(F.min("ranged_").alias("ranged"), F.max("back_").alias("back"), F.min("start").alias("first"), F.max("end").alias("last"))
    out = inputs.join(align_exact(texts, spans, key).drop("reason"), key, "left").join(held, key, "left")
    n_text, n_words = F.coalesce("n_text", F.lit(0)), F.coalesce("n_words", F.lit(0))
    within = F.coalesce((F.col("input_end") > F.col("input_start")) & (F.col("first") >= F.col("input_start")) & (F.col("last") <= F.col("input_end")), F.lit(False))
    reason = (
        F.when(n_text == 0, "empty_text").when(~F.coalesce("aligned", F.lit(False)), "alignment_incomplete").when(F.coalesce(F.col("status"), F.lit("")) != "exact", "word_mismatch").when(~F.col("ranged"), "invalid_range")
        .when(~within, "outside_input").when(F.col("back"), "not_monotone").when(F.col("chunk_id").isNull(), "no_identity")
    )
    status = F.when(reason.isNull(), "complete").when((n_text == 0) | (n_words == 0), "missing").otherwise("ambiguous")
    return out.select(*key, status.alias("status"), reason.alias("reason"), n_text.alias("n_words"))


def slice_lineage(lineage: DataFrame, spans: DataFrame, slices: DataFrame, key: list[str]) -> DataFrame:
    """Status of word ranges of built lineages.

    ``lineage``: key, status, n_words; ``spans``: key, pos, start, end; ``slices``: key, from, n.  A slice is met word by word through an
    equi-join, so its cost is its own length.  Null, negative or zero ranges are ``missing``; one past the end is not provable.
    """
    asked = slices.join(lineage.select(*key, F.col("status").alias("parent_"), F.col("n_words").alias("of_")), key, "left")
    bad = F.coalesce((F.col("from") < 0) | (F.col("n") <= 0), F.lit(True)) | F.col("of_").isNull()
    beyond = F.col("from") + F.col("n") > F.col("of_")
    ids = [*key, "from", "n"]
    each = asked.where(~bad & ~beyond).select(*ids, F.explode(F.sequence(F.col("from"), F.col("from") + F.col("n") - 1)).alias("pos")).distinct().join(spans.select(*key, "pos", "start", "end"), [*key, "pos"])
    w = Window.partitionBy(*ids).orderBy("pos", "start", "end")
    back = F.coalesce((F.col("start") < F.lag("start").over(w)) | (F.col("end") < F.lag("end").over(w)), F.lit(False)) | F.coalesce(F.col("end") <= F.col("start"), F.lit(True))
    met = each.withColumn("back_", back).groupBy(*ids).agg(F.count("*").alias("met_"), F.countDistinct("pos").alias("places_"), F.max("back_").alias("back_"))
    out = asked.join(met, ids, "left")
    n, invalid = F.coalesce("met_", F.lit(0)), F.coalesce("back_", F.lit(False))
    whole = (n == F.col("n")) & (F.col("places_") == F.col("n"))
    status = (
        F.when(bad, "missing").when(beyond, F.when(F.col("parent_") == "missing", "missing").otherwise("ambiguous")).when(invalid | (F.col("parent_") == "ambiguous"), "ambiguous")
        .when(whole & (F.col("parent_") == "complete"), "complete").when(n > 0, "partial").otherwise("missing")
    )
    reason = F.when(bad, "invalid_slice").when(beyond, "not_provable").when(status == "complete", None).when(invalid, "invalid_spans").when(whole, "parent_not_complete").otherwise("partial_coverage")
    return out.select(*ids, status.alias("status"), reason.alias("reason"), n.alias("met"))


def provisional_delta(df: DataFrame, emitted: str, latest: str) -> DataFrame:
    """New words of ``latest`` behind what was emitted; ``diverged`` where the emitted words are not its beginning.  Null text is empty."""
    old, new = tokens(F.col(emitted)), tokens(F.col(latest))
    # the first place that differs, or the shorter length where one begins the other
    apart = F.array_position(F.transform(F.zip_with(F.slice(old, F.lit(1), F.least(F.size(old), F.size(new))), F.slice(new, F.lit(1), F.least(F.size(old), F.size(new))), lambda a, b: a != b), lambda x: x), True)
    matched = F.when(apart > 0, apart - 1).otherwise(F.least(F.size(old), F.size(new)).cast("long"))
    rows = df.withColumn("matched", matched).withColumn("diverged", F.col("matched") < F.size(old))
    return rows.withColumn("new_words", F.when(F.col("diverged"), F.lit(0).cast("long")).otherwise(F.size(new) - F.col("matched")))


def supersede(finals: DataFrame, provisional: DataFrame, by: list[str], ttl_ms: int = 25_000, least: int = 3) -> DataFrame:
    """What to do with each final: ``pass``, ``suppress`` or ``emit_tail``, by the longest provisional text of the last ``ttl_ms`` that begins it.

    ``finals``: by, seq, ts_ms, text; ``provisional``: by, ts_ms, text.  Both meet by an equi-join on the first token and the time's bucket.
    Finals are judged one by one: a provisional text that one final used is not withdrawn from the next.  Wordless finals pass.
    """
    said = lambda df: df.withColumn("t_", tokens(F.col("text"))).withColumn("head_", F.get("t_", F.lit(0)))
    bucket = F.floor(F.col("ts_ms") / ttl_ms)
    f = said(finals).select(*by, "seq", F.col("ts_ms").alias("now_"), "t_", "head_", F.explode(F.array(bucket, bucket - 1)).alias("bucket_"))
    p = said(provisional).where("size(t_) > 0").select(*by, "ts_ms", F.col("t_").alias("p_"), "head_", bucket.alias("bucket_")).distinct()
    near = f.join(p, [*by, "head_", "bucket_"]).where((F.col("now_") - F.col("ts_ms")).between(0, ttl_ms) & (F.slice("t_", F.lit(1), F.size("p_")) == F.col("p_")))
    best = near.groupBy(*by, "seq").agg(F.max(F.size("p_")).cast("long").alias("covered"))
    out = finals.select(*by, "seq", F.size(tokens(F.col("text"))).cast("long").alias("n_")).join(best, [*by, "seq"], "left")
    tail = F.col("n_") - F.col("covered")
    action = F.when(F.col("covered").isNull(), "pass").when(tail < least, "suppress").otherwise("emit_tail")
    return out.select(*by, "seq", action.alias("action"), "covered", tail.alias("tail_words"))


def late_rows(df: DataFrame, by: list[str], arrival: list[str], ts: str, ttl_ms: int) -> DataFrame:
    """``late``: a row older than the newest one that arrived before it by more than ``ttl_ms``.  A null time is never late.

    The streaming form is ``withWatermark(ts, ttl)`` before the stateful operator.
    """
    w = Window.partitionBy(*by).orderBy(*arrival).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("late", F.coalesce(F.col(ts) < F.max(ts).over(w) - ttl_ms, F.lit(False)))


def dictionary_stats(terms: DataFrame) -> DataFrame:
    """Terms of each category, counted.  A null category is one of them."""
    return terms.groupBy("category").agg(F.count("*").alias("terms"), F.countDistinct("term").alias("distinct_terms"))


def lookup_terms(asked: DataFrame, terms: DataFrame) -> DataFrame:
    """Each asked ``term`` with the dictionary's: the equal one, else the first that is equal in lower case.

    ``terms``: term, category, target; those without a target are never found.  Repeated terms give the smallest category and target.
    """
    known = terms.where("target is not null").select(F.col("term").alias("source"), "category", "target", F.lower("term").alias("low_"))
    met = asked.select("term").distinct().withColumn("low_", F.lower("term")).join(known, "low_")
    best = met.groupBy("term").agg(F.min(F.struct((F.col("source") != F.col("term")).alias("other"), "source", "category", "target")).alias("m"))
    return best.select("term", "m.source", "m.category", "m.target", (~F.col("m.other")).alias("exact"))


def closed_thought(text: Column, open_words: tuple[str, ...] = OPEN_WORDS) -> Column:
    """The text ends with a stop, behind a word that leaves no construction open."""
    last = F.regexp_replace(F.lower(F.coalesce(F.try_element_at(F.filter(words(text), lambda w: w.rlike(r"[\p{L}\p{N}]")), F.lit(-1)), F.lit(""))), r"[^\p{L}\p{N}]", "")
    return text.rlike(r"[.!?]+[\"')\]]*\s*$") & ~last.isin(*open_words)


def replay_open_cut(df: DataFrame, most_ms: int = 8_000) -> DataFrame:
    """What may be said of each held ``text`` given the flow policy's ``decision`` and the time held: never an open cut but behind the cap.

    A closed text goes whole.  Beyond ``most_ms`` (null: not held yet) its safe head goes, or all of it where it has none.  Before, a decision to
    emit gives the safe head, and without one the text is held.  ``said`` counts the words that go, ``held`` those that stay.
    """
    n = F.size(words(F.col("text")))
    rows = df.withColumn("n_", n).withColumn("head_", safe_boundary(F.col("text")).cast("int"))
    capped, emits = F.coalesce(F.col("held_ms") >= most_ms, F.lit(False)), F.col("decision").isin("micro_emit", "soft_commit", "fallback")
    action = (
        F.when(F.coalesce(closed_thought(F.col("text")), F.lit(False)), "emit_full").when(capped & (F.col("head_") > 0), "emergency_trim").when(capped, "forced_open")
        .when(emits & (F.col("head_") > 0), "emit_prefix_hold").otherwise("hold")
    )
    rows = rows.withColumn("action", action)
    whole = F.col("action").isin("emit_full", "forced_open")
    tag = (
        F.when(F.col("action") == "emit_full", "closed").when(F.col("action") == "emit_prefix_hold", F.when(F.col("head_") == F.col("n_"), "closed").otherwise("closed_prefix_held_tail"))
        .when(F.col("action") == "hold", F.when(F.col("decision") == "merge", "merged").otherwise("held")).otherwise(F.col("action"))
    )
    said = F.when(whole, F.col("n_")).when(F.col("action") == "hold", 0).otherwise(F.col("head_")).cast("long")
    return rows.withColumn("completeness", tag).withColumn("said", said).withColumn("held", F.col("n_") - F.col("said")).drop("n_", "head_")
