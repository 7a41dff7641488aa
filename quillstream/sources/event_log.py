"""Reading and writing event logs (JSON lines), with a quarantine for lines that don't parse."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


def read_event_log(spark: SparkSession, path: str, schema: StructType, stream: bool = False) -> DataFrame:
    """Records of ``schema`` plus ``_corrupt_record``: the text of a line that doesn't parse, else null.  Blank lines are skipped."""
    reader = (spark.readStream if stream else spark.read).schema(StructType([*schema.fields, StructField("_corrupt_record", StringType())]))
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def split_quarantine(lines: DataFrame, schema: StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """Parsed records, and the lines that don't parse with their digest; an unterminated last line is kept if it parses."""
    own = StructType([*schema.fields, StructField("_corrupt_record", StringType())])
    parsed = lines.where(F.trim(value) != "").withColumn("r_", F.from_json(value, own, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    good = parsed.where("r_._corrupt_record is null").select("r_.*").drop("_corrupt_record")
    bad = parsed.where("r_._corrupt_record is not null").select(F.col(value).alias("line"), F.sha2(value, 256).alias("digest"))
    return good, bad


def write_event_log(df: DataFrame, path: str, ts: str = "ts") -> None:
    """Append as JSON lines, one set of files a UTC day."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").json(path)


def stream_event_log(df: DataFrame, path: str, checkpoint: str, ts: str = "ts"):
    """The same as a stream; exactly once by the checkpoint."""
    return df.withColumn("day", F.to_date(ts)).writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day").outputMode("append")


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that hold: the reasons to refuse a row."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for n, c in rules.items()]))


def validate_feedback(df: DataFrame) -> DataFrame:
    """Reports with their violated rules and normalised id."""
    general = F.col("kind") == "general_feedback"
    rules = {
        "id": ~F.col("report_id").rlike("^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"),
        "kind": ~F.col("kind").isin("issue", "general_feedback"),
        "note": F.coalesce(F.length("note") > F.when(general, 3000).otherwise(200), F.lit(False)),
        "email": F.coalesce(F.col("email").isNotNull() & (~general | ~F.col("email").rlike(r"^[^\s@]+@[^\s@]+\.[^\s@]+$")), F.lit(False)),
        "empty": general & F.col("note").isNull() & F.col("email").isNull(),
        "time": F.expr("try_cast(occurred_at as timestamp)").isNull(),
    }
    return df.withColumn("violations", violations(rules)).withColumn("report_id", F.lower("report_id"))


def sanitize_outcomes(df: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """Delivery outcomes with clipped ids and bounded numbers; rows without id, chunk or an allowed outcome are refused."""
    ok = F.col("outcome").isin(*allowed) & (F.col("outcome_id") != "") & (F.col("chunk_key") != "")
    bounded = lambda c, most: F.when(F.col(c).between(0, most), F.col(c))
    return df.where(ok).select(
        F.substring("outcome_id", 1, 128).alias("outcome_id"), F.substring("chunk_key", 1, 256).alias("chunk_key"), "outcome",
        F.coalesce(bounded("sentence_index", 10_000), F.lit(0)).alias("sentence_index"), F.when(F.col("outcome") == "play_completed", bounded("duration_ms", 3_600_000)).alias("duration_ms"),
    )


def explode_drop_reasons(df: DataFrame, key: list[str], reasons: str, allowed: DataFrame) -> DataFrame:
    """A row per counter of the map ``reasons``, and whether its name is allowed."""
    rows = df.select(*key, F.explode(reasons).alias("reason", "n"))
    return rows.join(allowed.select("reason").distinct().withColumn("allowed", F.lit(True)), "reason", "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def load_dictionary(entries: DataFrame, scopes: DataFrame) -> DataFrame:
    """Entries ``term, lang, target`` that a row's scope sees: its own, else those of the scope ``default``.

    ``scopes`` names the scope of each request with its ``term`` and ``lang``, so default entries meet requests by an equi-join.
    """
    own = entries.where("scope <> 'default'").select("scope", "term", "lang", F.col("target").alias("own_"))
    base = entries.where("scope = 'default'").select("term", "lang", F.col("target").alias("base_"))
    out = scopes.join(own, ["scope", "term", "lang"], "left").join(base, ["term", "lang"], "left")
    return out.select(*scopes.columns, F.coalesce("own_", "base_").alias("target")).where("target is not null")


#: What a provenance field may hold.
PROVENANCE_ENUMS = {
    "transcribe_status": ("accepted", "filtered_preprocess", "filtered_chunk_rate", "empty_model_output"),
    "provenance_status": ("complete", "incomplete_provenance", "no_delta", "delta_filtered", "no_confirmed_delta"),
    "provenance_reason": ("invalid_timestamp", "missing_span", "non_monotonic"),
    "alignment_status": ("exact", "unaligned", "filtered_window"),
}
#: Reasons of an alignment that may be logged.
ALIGNMENT_REASONS = (
    "invalid_timestamp:non_numeric", "invalid_timestamp:non_finite", "invalid_timestamp:negative_start", "invalid_timestamp:zero_or_reversed", "invalid_timestamp:rounds_to_empty",
    "invalid_timestamp:beyond_input", "non_monotonic_start", "non_word_level_chunk", "no_word_timestamps", "token_count_mismatch", "token_sequence_mismatch",
    "empty_accepted_text_without_filter_signal", "window_rejected_by_filter",
)


def _number(raw: Column) -> Column:
    """A finite number below 1e15 that ``raw`` spells, else null."""
    n = raw.try_cast("double")
    return F.when(F.abs(n) < 1e15, n)


def sanitize_provenance(df: DataFrame, key: list[str], ints: list[str], numbers: list[str], hashes: list[str], spans: str) -> DataFrame:
    """Provenance whose columns hold raw text, as typed values; nothing else of the text comes through.

    Integers, numbers and SHA-256 digests that don't parse become null and their names go to ``rejected``; null and empty fields are absent,
    not rejected.  Enum columns (``PROVENANCE_ENUMS``) hold one of their values or ``unclassified``; ``alignment_reason`` becomes a listed code, with the
    number of tokens apart.  ``spans``, an array of ``start, end``, becomes its size, least start and greatest end.
    """
    raw = lambda c: F.when(F.col(c) != "", F.col(c))
    whole = lambda c: F.when(_number(raw(c)) == F.floor(_number(raw(c))), _number(raw(c)).cast("long"))
    typed = {c: whole(c) for c in ints} | {c: _number(raw(c)) for c in numbers} | {c: F.when(raw(c).rlike("^[0-9a-f]{64}$"), raw(c)) for c in hashes}
    rejected = F.array_compact(F.array(*[F.when(raw(c).isNotNull() & v.isNull(), F.lit(c)) for c, v in typed.items()]))
    enums = [F.when(raw(c).isNotNull(), F.when(raw(c).isin(*allowed), raw(c)).otherwise("unclassified")).alias(c) for c, allowed in PROVENANCE_ENUMS.items()]
    code = F.regexp_extract("alignment_reason", "^([a-z_]+(:[a-z_]+)?)", 1)
    tokens_ = F.regexp_extract("alignment_reason", r"^non_word_level_chunk:tokens=(\d+)$", 1).try_cast("long")
    reason = F.when(raw("alignment_reason").isNotNull(), F.when(tokens_.isNotNull(), "non_word_level_chunk").when(code.isin(*ALIGNMENT_REASONS), code).otherwise("unclassified"))
    edges = [F.size(spans).alias("n_spans"), F.array_min(F.transform(spans, lambda s: s["start"])).alias("span_start"), F.array_max(F.transform(spans, lambda s: s["end"])).alias("span_end")]
    counted = [F.when(F.col(spans).isNotNull(), edges[0]).alias("n_spans"), *edges[1:]]
    return df.select(*key, *[v.alias(c) for c, v in typed.items()], *enums, reason.alias("alignment_code"), tokens_.alias("chunk_tokens"), *counted, rejected.alias("rejected"))


SNAPSHOT = (
    "queueDepth long, chunksReceived long, chunksPlayed long, chunksStarted long, chunksCompleted long, chunksPending long, currentPlaybackRate double, chunkAgeAtPlay_avg_ms double, "
    "source_coverage_lag_ms double, realSilence_max_ms double, last_release_seq_played long, last_source_hash_played string"
)


def listener_snapshot_fact(df: DataFrame, key: list[str], snapshot: str = "snapshot") -> DataFrame:
    """Typed facts of listener snapshots (JSON text), with what stands in for a count that an older client doesn't send.

    Negative counts are null; starts fall back to plays and pending ones to the queue's depth; ages are 0 and the rate is 1 where absent or zero;
    lags, silences and the last sequence stay null.  Null text and text that doesn't parse give the defaults.
    """
    s = df.select(*key, F.from_json(snapshot, SNAPSHOT).alias("s_")).select(*key, "s_.*")
    count = lambda *cs: F.when(F.coalesce(*[F.col(c) for c in cs]) >= 0, F.coalesce(*[F.col(c) for c in cs]))
    return s.select(
        *key, F.col("queueDepth").alias("queue_depth"), F.col("chunksReceived").alias("received"), F.coalesce("chunksPlayed", F.lit(0)).alias("played"), count("chunksStarted", "chunksPlayed").alias("started"),
        count("chunksCompleted").alias("completed"), count("chunksPending", "queueDepth").alias("pending"), F.coalesce(F.nullif("currentPlaybackRate", F.lit(0.0)), F.lit(1.0)).alias("rate"),
        F.coalesce("chunkAgeAtPlay_avg_ms", F.lit(0.0)).alias("age_ms"), F.col("source_coverage_lag_ms").alias("lag_ms"), F.col("realSilence_max_ms").alias("silence_ms"),
        F.col("last_release_seq_played").alias("last_played"), F.substring("last_source_hash_played", 1, 64).alias("last_hash"),
    )
