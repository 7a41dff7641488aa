"""Quality rules with adaptive thresholds from mergeable quantile sketches."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import join_facts, null_last_key, table, written

#: Leading binary digits of a sketch's bins: integers below 2 ** DIGITS have bins of their own, wider ones lose their last digits.
DIGITS = 11

#: metric -> (margin: least distance of a threshold from the upper quartile, also a lower threshold?)
METRICS = {
    "symbols": (50, False),  # symbols per 1000 word characters
    "dup_lines": (300, False),  # repeated lines per 1000 lines
    "repeats": (300, False),  # words in repeated windows per 1000 words
    "upper": (300, False),  # upper-case characters per 1000 word characters
    "word_length": (300, True),  # word characters per word, times 100
}

_SPACE = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"
_FEATURES = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, n_upper long"
#: Is the code point an upper-case letter (Unicode category Lu)?  Beyond the first plane: no.
_UPPER = np.array([unicodedata.category(chr(c)) == "Lu" for c in range(0x10000)] + [False])


def _repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    codes, kinds = pd.factorize(np.array(words, dtype=object))
    k = len(kinds)
    if k == n:
        return 0
    pairs = codes[:-1].astype(np.int64) * k + codes[1:]
    pairs, many = pd.factorize(pairs)
    windows = pairs[:-1].astype(np.int64) * k + codes[2:]
    _, inverse, counts = np.unique(windows, return_inverse=True, return_counts=True)
    hit = counts[inverse] > 1
    if not hit.any():
        return 0
    covered = np.zeros(n, dtype=bool)
    covered[:-2] |= hit
    covered[1:-1] |= hit
    covered[2:] |= hit
    return int(covered.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_upper of one text."""
    if not text:
        return (0,) * 7
    words = text.encode("utf-8", "surrogatepass").split()  # bytes split at ASCII white space only
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACE)),
        sum(map(text.count, _SYMBOLS)),
        len(lines),
        len(lines) - len(set(lines)),
        _repeat_words(words),
        int(_UPPER[np.minimum(codes, 0x10000)].sum()),
    )


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper"]
    for f in frames:
        counts = pd.DataFrame([text_counts(t) for t in f["text"]], columns=names, index=f.index, dtype="int64")
        yield pd.concat([f[["doc_id", "lang", "source"]], counts], axis=1)


def quality_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Counts of each whole text, as a written table (the text is read once)."""
    few = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.col(text_col).cast("string").alias("text"),
    )
    return written(few.mapInPandas(_features, _FEATURES), "quality-features")


def _with_metrics(features: DataFrame) -> DataFrame:
    def ratio(up: str, by: int, down: str):
        return F.when(F.col(down) > 0, F.expr(f"({up} * {by}) div {down}")).otherwise(0).cast("long")

    return features.select(
        "*",
        null_last_key(F.col("lang")).alias("l_"),
        null_last_key(F.col("source")).alias("s_"),
        ratio("n_symbols", 1000, "word_chars").alias("symbols"),
        ratio("n_dup_lines", 1000, "n_lines").alias("dup_lines"),
        ratio("n_repeat_words", 1000, "n_words").alias("repeats"),
        ratio("n_upper", 1000, "word_chars").alias("upper"),
        ratio("word_chars", 100, "n_words").alias("word_length"),
    )


def sketches(metrics: DataFrame) -> DataFrame:
    """Quantile sketches per language, source and metric: counts of integer bins, each named by its least value.

    Two sketches merge by adding the counts of equal bins, in any order, so they combine before the shuffle and the
    result doesn't depend on the partitions; a quantile read from one is exact below 2 ** DIGITS, and less than
    one part in 2 ** (DIGITS - 1) too low from there on.
    """
    stacked = "stack({}, {}) as (metric, value)".format(len(METRICS), ", ".join(f"'{m}', {m}" for m in METRICS))
    lost = f"length(bin(value)) - {DIGITS}"
    least = F.when(F.col("value") < 1 << DIGITS, F.col("value")).otherwise(F.expr(f"shiftleft(shiftright(value, {lost}), {lost})"))
    return metrics.select("l_", "s_", F.expr(stacked)).withColumn("bin", least).groupBy("l_", "s_", "metric", "bin").agg(F.count("*").alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """n, q1 and q3 of each key's sketch."""
    own = Window.partitionBy(*keys)
    cut = (
        sketch.groupBy(*keys, "bin").agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(own.orderBy("bin")))
        .withColumn("all", F.sum("n").over(own))
    )
    at = lambda p: F.min(F.when(F.col("upto") * 4 >= F.col("all") * p, F.col("bin")))
    return cut.groupBy(*keys).agg(F.max("all").alias("n"), at(1).alias("q1"), at(3).alias("q3"))


def thresholds(sketch: DataFrame, spread: int = 3, least_rows: int = 50) -> DataFrame:
    """One row per language and source with ``rows_`` and ``<metric>_high`` (and ``_low``): quartile +- max(spread * range, margin).

    A group of fewer than ``least_rows`` rows takes its language's merged sketch, and that of all rows where
    the language has as few.
    """
    fine = _quartiles(sketch, ["l_", "s_", "metric"])
    by_lang = _quartiles(sketch, ["l_", "metric"]).select("l_", "metric", F.struct("n", "q1", "q3").alias("lang_"))
    overall = _quartiles(sketch, ["metric"]).select("metric", F.struct("n", "q1", "q3").alias("all_"))
    used = (
        fine.join(by_lang, ["l_", "metric"]).join(F.broadcast(overall), "metric")  # len(METRICS) rows
        .withColumn("use", F.when(F.col("n") >= least_rows, F.struct("n", "q1", "q3")).when(F.col("lang_.n") >= least_rows, F.col("lang_")).otherwise(F.col("all_")))
        .withColumn("range", (F.col("use.q3") - F.col("use.q1")) * spread)
    )
    columns = [F.max("n").alias("rows_")]
    for m, (margin, low) in METRICS.items():
        of = F.col("metric") == m
        columns.append(F.max(F.when(of, F.col("use.q3") + F.greatest(F.col("range"), F.lit(margin)))).alias(f"{m}_high"))
        if low:
            columns.append(F.max(F.when(of, F.col("use.q1") - F.greatest(F.col("range"), F.lit(margin)))).alias(f"{m}_low"))
    return used.groupBy("l_", "s_").agg(*columns)


def quality_rules(docs: DataFrame, **columns) -> DataFrame:
    """Counts and verdict of every document.

    ``base_failed``: under 50 words, or over half of the words in repeated windows.  Otherwise ``kept`` unless a metric
    lies outside its language's and source's adaptive threshold; ``failed_rules`` names those metrics.  Null or empty
    texts have counts 0 and fail; null languages and sources are groups of their own; repeated rows are
    judged as rows; an empty table gives no rows.  Other columns are ignored.
    """
    metrics = _with_metrics(quality_features(docs, **columns))
    judged = join_facts(metrics, written(thresholds(sketches(metrics)), "quality-thresholds"), ["l_", "s_"], "rows_")
    rules = []
    for m, (_, low) in METRICS.items():
        rules.append(F.when(F.col(m) > F.col(f"{m}_high"), F.lit(m)))
        if low:
            rules.append(F.when(F.col(m) < F.col(f"{m}_low"), F.lit(f"{m}_low")))
    base = (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    return judged.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), F.array_compact(F.array(*rules)).alias("failed_rules"),
    ).withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` under the base rules and the adaptive thresholds."""
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.array_join("failed_rules", ",").alias("failed_rules"),
    )
