"""Cutting long segments, segments by pauses, and repeats collapsed in place."""

from __future__ import annotations

from itertools import groupby

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..functions.text import words
from .fold import State, ordered_fold

#: German words that begin a new thought.
STARTERS = (
    "Aber", "Denn", "Deshalb", "Darum", "Also", "Nun", "Jetzt", "Jedoch", "Trotzdem", "Dennoch", "Sondern", "Doch", "Weil", "Obwohl", "Wenn", "Falls", "Sobald", "Nachdem", "Bevor",
    "Damit", "Sodass", "Indem", "Während", "Seit", "Bis", "Erstens", "Zweitens", "Drittens", "Schließlich", "Zuletzt", "Außerdem", "Zusätzlich", "Übrigens", "Jedenfalls", "Immerhin",
)
#: Conjunctions behind a comma.
CONJUNCTIONS = ("und", "oder", "aber", "denn", "sondern")
_START = r"(?iu)(?<![\p{L}\p{N}_])(?=(?:" + "|".join(STARTERS) + r")(?![\p{L}\p{N}_]))"
_CLAUSE = r"(?i),\s*(" + "|".join(CONJUNCTIONS) + r")\s+"
_CUT = "\u0001"


def _trimmed(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")


def _at_starters(text: Column, least: int) -> Column:
    """Parts of ``text`` cut before each starter that begins behind ``least`` characters."""
    parts = F.split(text, _START)
    # a part behind the first begins with a starter of three letters or more, so only the first few can begin too early
    early = [F.when((F.size(parts) > j) & (F.length(F.array_join(F.slice(parts, 1, j), "")) <= least), 1).otherwise(0) for j in range(1, least // 3 + 2)]
    n = sum(early, F.lit(1))
    return F.concat(F.array(F.array_join(F.slice(parts, F.lit(1), n), "")), F.slice(parts, n + 1, F.size(parts)))


def _packed(text: Column, most: int) -> Column:
    """Words of ``text`` packed into lines of at most ``most`` characters; a longer word is a line of its own."""
    empty = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(acc: Column, word: Column) -> Column:
        full = (acc["line"] != "") & (F.length(acc["line"]) + 1 + F.length(word) > most)
        more = F.when(acc["line"] == "", word).otherwise(F.concat(acc["line"], F.lit(" "), word))
        return F.struct(F.when(full, F.concat(acc["lines"], F.array(acc["line"]))).otherwise(acc["lines"]).alias("lines"), F.when(full, word).otherwise(more).alias("line"))

    return F.aggregate(words(text), empty, add, lambda acc: F.concat(acc["lines"], F.array(acc["line"])))


def split_long_segments(df: DataFrame, key: list[str], text: str = "text", most: int = 150, least: int = 15) -> DataFrame:
    """A row per part of each text: cut before starters, then at commas with a conjunction (a part of its own), then by packing words.

    Each cut is made only in what is still longer than ``most`` characters.  Starters are whole words by letters and digits.  Null and
    blank texts have no parts; U+0001 counts as white space; repeated rows are cut alike.
    """
    said = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), _CUT, " "), r"^\s+|\s+$", "")
    long = lambda p: F.length(p) > most
    each = lambda parts, cut: F.flatten(F.transform(parts, lambda p: F.when(long(p), cut(p)).otherwise(F.array(p))))
    first = each(F.array(said), lambda p: _trimmed(_at_starters(p, least)))
    second = each(first, lambda p: _trimmed(F.split(F.regexp_replace(p, _CLAUSE, f"{_CUT}$1{_CUT}"), _CUT)))
    parts = F.filter(each(second, lambda p: _packed(p, most)), lambda p: p != "")
    return df.select(*key, F.posexplode(parts).alias("part", "piece"))


def segment_by_pauses(words_: DataFrame, by: list[str], order: list[str], gap_ms: int = 800, least: int = 15) -> DataFrame:
    """Segments of ``word, start, end`` rows: cut at a pause of ``gap_ms`` once ``least`` characters are held.

    Pauses are places in order, not word texts.  Words between pauses are joined first, so the fold takes one step a pause and holds
    one segment.  A null time makes no pause; a null word is empty; words that tie in ``order`` are ordered by start, end and word.
    """
    w = Window.partitionBy(*by).orderBy(*order, "start", "end", "word")
    pause = F.coalesce(F.col("start") - F.lag("end").over(w) >= gap_ms, F.lit(False))
    rows = words_.withColumn("pause_", pause).withColumn("run_", F.sum(F.col("pause_").cast("long")).over(w)).withColumn("i_", F.row_number().over(w))
    in_order = lambda name: F.array_sort(F.collect_list(F.struct("i_", name)))
    runs = rows.withColumn("word_", F.coalesce(F.col("word").cast("string"), F.lit(""))).groupBy(*by, "run_").agg(F.count("*").alias("n_"), F.array_join(F.transform(in_order("word_"), lambda s: s["word_"]), " ").alias("said_"))

    def told(state: State) -> list[dict]:
        return [{**state["key"], "segment": state["segment"], "text": " ".join(state["said"]), "n_words": state["n"]}] if state["said"] else []

    def step(state: State, row: dict) -> tuple[State, list[dict]]:
        state = state or {"key": {c: row[c] for c in by}, "segment": 0, "said": [], "chars": 0, "n": 0}
        state = state | {"said": [*state["said"], row["said_"]], "chars": state["chars"] + len(row["said_"]) + bool(state["said"]), "n": state["n"] + row["n_"]}
        if state["chars"] < least:
            return state, []
        return state | {"segment": state["segment"] + 1, "said": [], "chars": 0, "n": 0}, told(state)

    schema = ", ".join(f"{c} {words_.schema[c].dataType.simpleString()}" for c in by)
    return ordered_fold(runs, by, ["run_"], step, f"{schema}, segment int, text string, n_words long", told)


_EDGES = regex.compile(r"^\p{P}+|\p{P}+$")


def _without_repeats(said: list[str], n: int) -> list[str]:
    """``said`` with each ``n``-gram that follows itself taken once, from left to right."""
    bare = [_EDGES.sub("", w.lower()) for w in said]
    alike = 0  # words from here on that equal the word n places on
    run = [0] * (len(said) + 1)
    for i in range(len(said) - n - 1, -1, -1):
        alike = alike + 1 if bare[i] == bare[i + n] else 0
        run[i] = alike
    kept, i = [], 0
    while i < len(said):
        twice = run[i] >= n
        kept += said[i : i + (n if twice else 1)]
        i += 2 * n if twice else 1
    return kept


def collapsed(text: str | None) -> tuple[str | None, int, int, int]:
    """Text without adjacent repeats, and how many words went as single words, in 3-grams and in 2-grams."""
    said = regex.split(r"\s+", text) if text else []
    if text is None or len(text) < 3 or len(said) < 2:
        return text, 0, 0, 0
    one = [max(group, key=len) for _, group in groupby(said, key=lambda w: _EDGES.sub("", w.lower()))]
    three = _without_repeats(one, 3)
    two = _without_repeats(three, 2)
    return " ".join(two), len(said) - len(one), len(one) - len(three), len(three) - len(two)


_COLLAPSED = StructType([StructField("text", StringType()), *[StructField(n, LongType()) for n in ("adjacent", "trigrams", "bigrams")]])


@F.pandas_udf(_COLLAPSED)
def _collapse(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([collapsed(t) for t in texts], columns=["text", "adjacent", "trigrams", "bigrams"])


def collapse_repeats(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``repeats_``: the text with adjacent equal words (the longest form stays), then 3-grams, then 2-grams taken once.

    Words are compared in lower case without punctuation at their edges.  Null and one-word texts come back as they are.
    """
    return df.withColumn("repeats_", _collapse(F.col(text)))
