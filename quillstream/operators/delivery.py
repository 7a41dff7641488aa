"""Delivery reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def committed_releases(ledger: DataFrame, by: list[str]) -> DataFrame:
    """Releases all of whose sentences 0 to n - 1 started, with one total and no conflict."""
    g = ledger.groupBy(*by).agg(
        F.countDistinct("total").alias("totals"), F.max("total").alias("total"), F.count_if("conflicted").alias("conflicts"),
        F.countDistinct(F.when(F.col("started"), F.col("sentence_index"))).alias("started"),
    )
    return g.withColumn("committed", (F.col("totals") == 1) & (F.col("conflicts") == 0) & (F.col("started") == F.col("total")))


def playback_report(plays: DataFrame, by: list[str]) -> DataFrame:
    """Overlaps, longest silence and rate (0.5 to 2) of each session's plays."""
    w = Window.partitionBy(*by).orderBy("start", "end")
    gap = F.col("start") - F.lag("end").over(w)
    x = plays.withColumn("gap_", gap).withColumn("rate_", F.greatest(F.lit(0.5), F.least(F.lit(2.0), F.col("rate"))))
    return x.groupBy(*by).agg(
        F.count("*").alias("plays"), F.count_if(F.col("gap_") < 0).alias("overlaps"), F.max(F.greatest(F.col("gap_"), F.lit(0))).alias("longest_silence"),
        F.max("rate_").alias("max_rate"), (F.max("end") - F.min("start")).alias("duration"),
    )


def budget_drops(pending: DataFrame, by: list[str], age_ms: int = 10_000, backlog_ms: int = 15_000, chunk_ms: int = 4_000) -> DataFrame:
    """Rows to drop, with the reason: those older than ``age_ms`` before ``now_ms``, then the oldest beyond a backlog of ``backlog_ms``.

    ``pending``: by, seq, ts_ms, now_ms.  Each row stands for ``chunk_ms`` of the backlog; a null time has no age and is the oldest.
    """
    newest = Window.partitionBy(*by).orderBy(F.desc_nulls_last("ts_ms"), F.desc("seq"))
    aged = F.coalesce(F.col("now_ms") - F.col("ts_ms") > age_ms, F.lit(False))
    rows = pending.withColumn("aged_", aged).withColumn("kept_", F.sum((~F.col("aged_")).cast("int")).over(newest.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    reason = F.when(F.col("aged_"), "age_budget").when(F.col("kept_") * chunk_ms > backlog_ms, "backlog_budget")
    return rows.withColumn("reason", reason).where("reason is not null").drop("aged_", "kept_")


def next_pending(chunks: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """The first chunk of each key."""
    first = chunks.groupBy(*by).agg(F.min(F.struct(*order)).alias("f_"))
    return first.select(*by, "f_.*")


def release_funnel(audited: DataFrame, outcomes: DataFrame, by: list[str], ranks: dict[str, int]) -> DataFrame:
    """Terminal outcome of every audited release: that of highest rank; ``lost`` without one."""
    rank = F.coalesce(*[F.when(F.col("outcome") == o, F.lit(r)) for o, r in ranks.items()], F.lit(0))
    best = outcomes.withColumn("r_", rank).groupBy(*by).agg(F.max(F.struct("r_", "outcome"))["outcome"].alias("terminal"), F.count("*").alias("outcomes"))
    return audited.select(*by).distinct().join(best, by, "left").select(*by, F.coalesce("terminal", F.lit("lost")).alias("terminal"), F.coalesce("outcomes", F.lit(0)).alias("outcomes"))


def dedupe_idempotent(df: DataFrame, key: list[str], payload: Column, order: list[str]) -> DataFrame:
    """First write of each id, how often it came, and whether another payload came under it."""
    digest = F.sha2(payload, 256)
    first = F.min(F.struct(*order, digest.alias("digest")))
    out = df.groupBy(*key).agg(first.alias("f_"), F.count("*").alias("writes"), F.countDistinct(digest).alias("payloads"))
    return out.select(*key, *[F.col(f"f_.{o}").alias(o) for o in order], "writes", (F.col("payloads") > 1).alias("conflict"))


def accepted_writes(df: DataFrame, session: list[str], key: str, payload: Column, order: list[str], most: int = 500) -> DataFrame:
    """What becomes of each write: ``accepted`` (the first of its id), ``duplicate``, ``conflict`` (another payload), or ``full`` beyond the session's ``most`` ids.

    Ids count in the order of their first writes; later writes of an id that was full are full too.  Rows that tie in ``order`` are ordered by payload.
    """
    digest = F.sha2(payload, 256)
    own = Window.partitionBy(*session, key).orderBy(*order, "digest_")
    rows = df.withColumn("digest_", digest).withColumn("no_", F.row_number().over(own)).withColumn("first_", F.first("digest_").over(own))
    ids = rows.where("no_ = 1").withColumn("place_", F.row_number().over(Window.partitionBy(*session).orderBy(*order, key))).select(*session, key, "place_")
    x = rows.join(ids, [*session, key])
    verdict = F.when(F.col("place_") > most, "full").when(F.col("no_") == 1, "accepted").when(F.col("digest_") == F.col("first_"), "duplicate").otherwise("conflict")
    return x.withColumn("verdict", verdict).drop("digest_", "no_", "first_", "place_")
