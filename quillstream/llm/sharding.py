"""Sharding by proportional stratified interleaving (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import null_last_key, seeded_hash, table, written


def interleave_shards(
    docs: DataFrame,
    n_shards: int = 8,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    seed: str = "shard",
    buckets: int = 2048,
) -> DataFrame:
    """Deal every row into ``n_shards`` shards whose source mixture matches the whole table's.

    Rows are shuffled by a seeded hash within their source; row r of n gets the fractional rank
    (2r - 1) / 2n; all rows are sorted by that rank and the order is cut into ``n_shards`` parts
    whose row counts differ by one at most.

    Ranks are taken without a task that holds a whole source: the hash splits each source into
    ``buckets`` ranges, their counts give each range's offset, and only rows of one range are
    numbered together.  The global order is numbered the same way over ranges of the fractional rank.

    Returns ``doc_id, source, size (UTF-8 bytes + 1), text_crc32, shard, slot`` (slots are gapless from
    0 within a shard, in interleaved order).  Null text counts as empty, null source is a source of its
    own, null ids hash as empty text, repeated rows each get a slot; an empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    if n_shards < 1 or buckets < 1:
        raise ValueError("n_shards and buckets must be positive")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        null_last_key(F.col(source_col)).alias("s_"),
        seeded_hash(F.col(id_col), seed).alias("h_"),
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    ).withColumn("b_", F.floor(F.col("h_") * F.lit(buckets / float(1 << 60))).cast("int"))

    per = rows.groupBy("s_", "b_").agg(F.count("*").alias("n_"))
    offsets = per.select(
        "s_",
        "b_",
        (F.sum("n_").over(Window.partitionBy("s_").orderBy("b_")) - F.col("n_")).alias("before_"),
        F.sum("n_").over(Window.partitionBy("s_")).alias("of_"),
    )
    order = ["h_", "doc_id", "text_crc32", "size"]
    ranked = (
        rows.withColumn("r_", F.row_number().over(Window.partitionBy("s_", "b_").orderBy(*order)))
        .join(offsets, ["s_", "b_"])
        .withColumn("r_", F.col("r_") + F.col("before_"))
        .withColumn("f_", (2 * F.col("r_") - 1) / (2.0 * F.col("of_")))
        .withColumn("g_", F.least(F.floor(F.col("f_") * buckets), F.lit(buckets - 1)).cast("int"))
        .select("doc_id", "source", "s_", "h_", "size", "text_crc32", "f_", "g_")
    )
    ranked = written(ranked, "shard-ranks")
    # at most ``buckets`` rows, however large the table
    starts = ranked.groupBy("g_").agg(F.count("*").alias("n_")).select(
        "g_",
        (F.sum("n_").over(Window.orderBy("g_")) - F.col("n_")).alias("before_"),
        F.sum("n_").over(Window.partitionBy(F.lit(1))).alias("all_"),
    )
    in_range = Window.partitionBy("g_").orderBy("f_", "h_", "doc_id", "s_", "text_crc32", "size")
    placed = (
        ranked.withColumn("r_", F.row_number().over(in_range))
        .join(F.broadcast(starts), "g_")
        .withColumn("p_", F.col("before_") + F.col("r_") - 1)
        .withColumn("shard", F.expr(f"(p_ * {n_shards}) div all_").cast("int"))
        .withColumn("slot", F.col("p_") - F.expr(f"(shard * all_ + {n_shards - 1}) div {n_shards}"))
    )
    return placed.select("doc_id", "source", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in shards 0 to 7 under the law ``rows``."""
    out = interleave_shards(table(spark, sf_dir, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "source",
    )
