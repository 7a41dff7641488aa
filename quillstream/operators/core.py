"""Building blocks of ordered operators: ranks, islands, interval and band joins."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def floor_rank_summary(df: DataFrame, by: Sequence[str], value: str, ranks: Sequence[float] = (0.5, 0.95, 0.99), weight: str | None = None) -> DataFrame:
    """count, min, max, avg and the values at 0-based index min(n - 1, floor(p n)) of each group; null values are left out.

    With ``weight`` a row stands for as many.

    Equal values are counted before the shuffle, so a group costs its distinct values, not its rows.
    """
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v_")).agg((F.sum(weight) if weight else F.count("*")).alias("c_"))
    own = Window.partitionBy(*by)
    placed = counts.withColumn("upto_", F.sum("c_").over(own.orderBy("v_"))).withColumn("n_", F.sum("c_").over(own))
    index = lambda p: F.least(F.col("n_") - 1, F.floor(F.lit(p) * F.col("n_")))
    at = lambda p: F.min(F.when(F.col("upto_") > index(p), F.col("v_")))
    return placed.groupBy(*by).agg(
        F.max("n_").alias("n"), F.min("v_").alias("min"), F.max("v_").alias("max"), (F.sum(F.col("v_") * F.col("c_")) / F.max("n_")).alias("avg"),
        *[at(p).alias(f"p{round(100 * p)}") for p in ranks],
    )


def half_up_mean(found: DataFrame, df: DataFrame, by: Sequence[str], value: str, order: Sequence[str]) -> DataFrame:
    """``found`` with ``avg`` rounded half up to a whole number, as its sum in ``order`` (ties by value) has it, however the rows are dealt.

    ``found``: a row per key with ``n, min, max, avg`` of the values in ``df`` (``n`` may count nulls too).  A sum of doubles differs in its last bits with the order of its terms, and
    these decide a mean that lies at a half.  Two orders of n terms differ by at most n * 2^-52 times the sum of their absolute values; only keys for
    which that leaves two answers (rounding of mean and products included) are summed in order, from rows that a semi join picks.  Whole numbers add up
    to the same in any order.
    """
    by = list(by)
    if dict(df.dtypes)[value] in ("tinyint", "smallint", "int", "bigint"):
        return found.withColumn("avg", F.floor(F.col("avg") + 0.5).cast("long"))
    slack = (F.col("n") + 4) * 2.0**-51 * (F.greatest(F.abs("min"), F.abs("max")) + 1)
    found = found.withColumn("open_", F.floor(F.col("avg") + 0.5 - slack) != F.floor(F.col("avg") + 0.5 + slack))
    keyed = lambda a: [F.col(c).alias(f"{c}{a}") for c in by]
    same = lambda a: reduce(and_, [F.col(c).eqNullSafe(F.col(f"{c}{a}")) for c in by])
    rows = df.where(F.col(value).isNotNull()).join(found.where("open_").select(*keyed("_o")), same("_o"), "left_semi")
    own = Window.partitionBy(*by).orderBy(*order, value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = rows.select(*keyed("_m"), F.sum(value).over(own).alias("sum_"), F.count(value).over(own).alias("no_"))
    means = upto.groupBy(*[f"{c}_m" for c in by]).agg((F.max_by("sum_", "no_") / F.max("no_")).alias("mean_"))
    mean = F.when(F.col("open_"), F.col("mean_")).otherwise(F.col("avg"))
    return found.join(means, same("_m"), "left").withColumn("avg", F.floor(mean + 0.5).cast("long")).drop("open_", "mean_", *[f"{c}_m" for c in by])


def islands(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], starts: Column, name: str = "island") -> DataFrame:
    """Number of the island that a row is in: it grows by one where ``starts`` holds."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(F.coalesce(starts.cast("int"), F.lit(0))).over(w))


def rounded(x: Column, digits: int = 4) -> Column:
    """Half up, as floor(x * 10^d + 0.5) / 10^d."""
    ten = float(10**digits)
    return F.floor(x * ten + 0.5) / ten


def bucketed_overlap_join(a: DataFrame, b: DataFrame, by: Sequence[str], width: int) -> DataFrame:
    """Pairs of half-open intervals of one key that overlap, as an equi-join on the fixed-width buckets that they touch.

    ``a`` has ``a_id, a_start, a_end``, ``b`` has ``b_id, b_start, b_end`` and both the key columns.  A pair is given once: in the
    bucket where the later of the starts lies.  Empty and inverted intervals overlap nothing.
    """
    by = list(by)
    spread = lambda df, p: df.where(F.col(f"{p}_end") > F.col(f"{p}_start")).withColumn(
        "bucket_", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / width), F.floor((F.col(f"{p}_end") - 1) / width)))
    )
    joined = spread(a, "a").join(spread(b, "b"), [*by, "bucket_"])
    start = F.greatest("a_start", "b_start")
    end = F.least("a_end", "b_end")
    return joined.where((end > start) & (F.col("bucket_") == F.floor(start / width))).withColumn("overlap", end - start).drop("bucket_")


def merge_intervals(spans: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Union of overlapping or touching half-open intervals of each key: ``by, start, end, n_spans``."""
    by = list(by)
    before = Window.partitionBy(*by).orderBy(start, end).rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max(end).over(before)
    marked = spans.where(F.col(end) > F.col(start)).withColumn("new_", reach.isNull() | (F.col(start) > reach))
    return (
        islands(marked, by, [start, end], F.col("new_")).groupBy(*by, "island")
        .agg(F.min(start).alias("start"), F.max(end).alias("end"), F.count("*").alias("n_spans")).drop("island")
    )


def band_pairs(df: DataFrame, by: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Each row with up to ``most`` rows before it of its key: columns ``cur`` and ``old`` (structs of the row) and ``gap``.

    Rows are numbered per key; pairs meet by an equi-join on blocks of ``most`` numbers (own and previous block), so
    the pairs made are bounded by 2 * most per row.
    """
    by = list(by)
    numbered = df.withColumn("no_", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    cur = numbered.select(*by, F.struct("*").alias("cur"), F.explode(F.array(F.floor(F.col("no_") / most), F.floor(F.col("no_") / most) - 1)).alias("block_"))
    old = numbered.select(*by, F.struct("*").alias("old"), F.floor(F.col("no_") / most).alias("block_"))
    return cur.join(old, [*by, "block_"]).withColumn("gap", F.col("cur.no_") - F.col("old.no_")).where((F.col("gap") > 0) & (F.col("gap") <= most)).drop("block_")
