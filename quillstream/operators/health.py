"""Windowed health, alerts, circuits and rate control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import islands, rounded


def rolling_quality_metrics(df: DataFrame, by: list[str], window_ms: int = 60_000) -> DataFrame:
    """Trailing-window count, mean, floor-rank p95 and error share of each row's key, the row included."""
    w = Window.partitionBy(*by).orderBy("ts_ms").rangeBetween(-window_ms, 0)
    values = F.sort_array(F.collect_list(F.greatest(F.lit(0.0), F.col("value"))).over(w))
    n = F.size("values_")
    out = df.withColumn("values_", values).withColumn("errors", F.count(F.when(F.col("stage") == "error", 1)).over(w)).withColumn("n", F.count("*").over(w))
    return out.withColumn("p95", F.when(n > 0, F.get("values_", F.least(n - 1, F.floor(n * F.lit(0.95)).cast("int"))))).withColumn(
        "error_rate", rounded(F.col("errors") / F.greatest(F.lit(1), F.col("n")))
    ).drop("values_")


def severity(x: Column, degraded: float, critical: float) -> Column:
    return F.when(x >= critical, "critical").when(x >= degraded, "degraded").otherwise("good")


def quality_state(df: DataFrame, causes: dict[str, Column]) -> DataFrame:
    """State, main cause and confidence from severities; the first cause in the given order wins within a severity."""
    scored = df.select("*", *[c.alias(f"cause_{n}") for n, c in causes.items()])
    first = lambda level: F.coalesce(*[F.when(F.col(f"cause_{n}") == level, F.lit(n)) for n in causes])
    state = F.when(first("critical").isNotNull(), "critical").when(first("degraded").isNotNull(), "degraded").otherwise("good")
    return scored.withColumn("state", state).withColumn("main_cause", F.coalesce(first("critical"), first("degraded"), F.lit("healthy"))).withColumn(
        "confidence", F.least(F.lit(1.0), F.col("n") / 5.0)
    )


def rate_alerts(df: DataFrame, by: list[str], n: int = 3, window_ms: int = 60_000) -> DataFrame:
    """Rows that raise an alert: ``n`` events in the trailing window, once until the pruned count falls below ``n``.

    An alert is active while the count that is left after pruning, before the next event is added, stays at n or more; so an
    alert is raised exactly where the count with the event is n.
    """
    span = Window.partitionBy(*by).orderBy("ts_ms").rangeBetween(-window_ms, 0)
    later = Window.partitionBy(*by, "ts_ms").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    counted = df.withColumn("count", F.count("*").over(span) - F.count("*").over(later))
    return counted.where(F.col("count") == n)


def circuit_replay(df: DataFrame, by: list[str], ok: Column, threshold: int = 3, cooldown_ms: int = 30_000) -> DataFrame:
    """Consecutive failures since the last success, and until when the circuit is open, after every call."""
    marked = df.withColumn("ok_", ok)
    runs = islands(marked, by, ["ts_ms", "seq"], F.col("ok_"), "run_")
    w = Window.partitionBy(*by, "run_").orderBy("ts_ms", "seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    failures = F.sum(F.when(F.col("ok_"), 0).otherwise(1)).over(w)
    opened = F.when(F.col("failures") >= threshold, F.col("ts_ms") + cooldown_ms)
    return runs.withColumn("failures", failures).withColumn("open_until", F.max(opened).over(w)).drop("ok_", "run_")


def systematic_sample(df: DataFrame, by: list[str], actionable: Column, every: int = 20) -> DataFrame:
    """Every actionable row and every ``every``-th other row of each key."""
    w = Window.partitionBy(*by, "act_").orderBy("ts_ms", "seq")
    return df.withColumn("act_", actionable).withColumn("no_", F.row_number().over(w)).where(F.col("act_") | (F.col("no_") % every == 0)).drop("act_", "no_")
