"""Inputs of the operators from the driver's tables; each view has its DataFrame and the same view as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str):
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({column} as timestamp_ntz))")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stream_id, stage, value, ts_ms, seq, k of every event."""
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("stream_id"), F.col("event_type").alias("stage"), "value", epoch_ms("ts").alias("ts_ms"),
        F.col("event_id").alias("seq"), F.regexp_extract("props", r"(\d+)", 1).cast("long").alias("k"),
    )


TELEMETRY = "telemetry as (select user_id as stream_id, event_type as stage, value, epoch_us(ts) // 1000 as ts_ms, event_id as seq, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as k from events)"

_ACTIONS = ("emit", "merge", "hold", "audio_skip", "drop")


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry as emission decisions: age, queue depth, health flags, the logged and the runtime action."""
    actions = F.array(*[F.lit(a) for a in _ACTIONS])
    return telemetry(spark, sf_dir).select(
        "stream_id", "stage", "ts_ms", "seq", (F.col("value") * 200).alias("age_ms"), (F.col("k") % 11).alias("queue_depth"),
        (F.col("k") % 4 != 0).alias("asr_stable"), (F.col("k") % 3 != 0).alias("semantic_complete"), (F.col("k") % 13 != 0).alias("provider_healthy"), (F.col("k") % 17 != 0).alias("tts_enabled"),
        F.get(actions, (F.col("k") % 5).cast("int")).alias("controller_action"), F.get(actions, (F.col("seq") % 5).cast("int")).alias("runtime_action"),
    )


DECISIONS = TELEMETRY + f""", decisions as (
  select stream_id, stage, ts_ms, seq, value * 200 as age_ms, k % 11 as queue_depth, k % 4 <> 0 as asr_stable, k % 3 <> 0 as semantic_complete, k % 13 <> 0 as provider_healthy, k % 17 <> 0 as tts_enabled,
    {list(_ACTIONS)}[k % 5 + 1] as controller_action, {list(_ACTIONS)}[seq % 5 + 1] as runtime_action from telemetry)"""


def emissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as emissions of a stream, some of which repeat the turn before or its tail."""
    own = Window.partitionBy("conv_id").orderBy("turn")
    tail = F.expr("array_join(slice(split(before, ' '), greatest(-8, -size(split(before, ' '))), 8), ' ')")
    code = F.col("conv_id") * 7 + F.col("turn")
    return (
        read(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null")
        .select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("said"))
        .withColumn("before", F.lag("said").over(own))
        .select(
            F.col("conv_id").alias("stream_id"), F.col("turn").alias("release_seq"), (F.col("turn") * 4000 + F.col("conv_id") % 7 * 1000).alias("ts_ms"),
            F.when(F.col("before").isNull(), F.col("said")).when(code % 5 == 0, F.col("before")).when(code % 3 == 0, F.concat(tail, F.lit(" "), F.col("said"))).otherwise(F.col("said")).alias("text"),
        )
    )


EMISSIONS = """said as (
  select conv_id, turn, coalesce(text, '') as said, lag(coalesce(text, '')) over (partition by conv_id order by turn) as before from conversations
  where conv_id is not null and turn is not null),
emissions as (
  select conv_id as stream_id, turn as release_seq, turn * 4000 + conv_id % 7 * 1000 as ts_ms,
    case when before is null then said when (conv_id * 7 + turn) % 5 = 0 then before
      when (conv_id * 7 + turn) % 3 = 0 then array_to_string(list_slice(string_split(before, ' '), greatest(1, len(string_split(before, ' ')) - 7), len(string_split(before, ' '))), ' ') || ' ' || said
      else said end as text from said)"""


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "lang", "source")


TEXTS = "texts as (select doc_id, coalesce(text, '') as text, lang, source from documents)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as half-open sample intervals of a coordinate space."""
    start = F.col("l_orderkey") * 40 + F.col("l_linenumber") * 10
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("space"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("word"),
        start.cast("long").alias("start"), (start + (F.col("l_quantity") * 20).cast("long")).cast("long").alias("end"),
    )


SPANS = """spans as (
  select l_suppkey as space, l_orderkey as id, cast(l_linenumber as bigint) as word, cast(l_orderkey * 40 + l_linenumber * 10 as bigint) as start,
    cast(l_orderkey * 40 + l_linenumber * 10 + cast(l_quantity * 20 as bigint) as bigint) as "end" from lineitem)"""
