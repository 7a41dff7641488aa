"""Sentence segmentation, unit merging, boundaries, redaction and identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import identity, tokens, words
from .dictionary import SHIPPED_CHARS, phrases_in, shipped_phrases

#: Sentence ends.
_SENTENCE = r"[^.!?。！？]+[.!?。！？]*|[.!?。！？]+"
#: Words that leave a construction open.
OPEN_WORDS = (
    "und", "oder", "aber", "denn", "weil", "dass", "als", "wenn", "sondern", "doch", "sowie", "obwohl", "damit", "falls", "bevor", "nachdem", "waehrend", "während", "sobald", "wie",
    "in", "an", "auf", "fuer", "für", "mit", "von", "zu", "bei", "nach", "ueber", "über", "unter", "vor", "durch", "um", "aus", "gegen", "ohne", "seit", "trotz", "zwischen",
    "der", "die", "das", "ein", "eine", "einen", "einem", "einer", "eines", "dem", "den", "des", "dieser", "diese", "dieses",
    "was", "welche", "welcher", "welches", "welchem", "welchen", "deren", "dessen", "denen",
)
#: Patterns of text that addresses the translator.
INJECTIONS = (
    r"ignore\s+(all\s+)?previous\s+instructions", r"you\s+are\s+now", r"system\s*:\s*", r"\[INST\]", r"forget\s+(everything|all|your)", r"act\s+as\s+(if|a)", r"new\s+instructions",
    r"override\s+(your|the|all)", r"disregard\s+(all|your|the|previous)", r"do\s+not\s+translate", r"output\s+(the|your)\s+system\s+prompt", r"reveal\s+(your|the)\s+(instructions|prompt|system)",
)


def segment_sentences(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """A row per sentence: index, text, length, words and whether it ends with a stop."""
    parts = F.filter(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({_SENTENCE})"), F.lit(1)), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")
    rows = df.select(*key, F.posexplode(parts).alias("sentence", "piece"))
    return rows.select(*key, "sentence", "piece", F.length("piece").alias("chars"), F.size(words(F.col("piece"))).alias("n_words"), F.col("piece").rlike(r"[.!?。！？]$").alias("complete"))


def merge_short_units(sentences: DataFrame, key: list[str], least: int = 25) -> DataFrame:
    """Sentences joined into units: one shorter than ``least`` joins the unit before."""
    w = Window.partitionBy(*key).orderBy("sentence")
    starts = (F.col("sentence") == 0) | (F.col("chars") >= least)
    units = sentences.withColumn("unit", F.sum(starts.cast("int")).over(w) - 1)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence", "piece"))), lambda s: s["piece"]), " ")
    return units.groupBy(*key, "unit").agg(joined.alias("text"), F.count("*").alias("n_sentences"))


def sentence_features(text: Column) -> Column:
    """Ends with a stop, begins with a capital, words, likely complete."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    n, ends = F.size(words(t)), t.rlike(r"[.!?]$")
    return F.struct(ends.alias("ends"), t.rlike("^[A-ZÄÖÜ]").alias("capital"), n.alias("n_words"), (ends & (n >= 3)).alias("likely_complete"))


def source_units(sentences: DataFrame) -> DataFrame:
    """Token count of each unit and whether it is closed and long enough (4 tokens) to be scored."""
    n = F.size(tokens(F.col("piece")))
    return sentences.withColumn("n_tokens", n).withColumn("scorable", F.col("complete") & (n >= 4))


def safe_boundary(text: Column, open_words: tuple[str, ...] = OPEN_WORDS) -> Column:
    """Words of the head that ends at the last clause mark behind a word that doesn't leave a construction open; the rest is the tail."""
    w = words(text)
    opens = F.array(*[F.lit(x) for x in open_words])
    bare = lambda x: F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}]", "")
    ok = lambda x: x.rlike(r"[.!?,;:][\"')\]]*$") & (bare(x) != "") & ~F.array_contains(opens, bare(x))
    return F.coalesce(F.array_max(F.filter(F.transform(w, lambda x, i: F.when(ok(x), i + 1).otherwise(F.lit(0))), lambda i: i > 0)), F.lit(0))


def confirm_boundaries(df: DataFrame, by: list[str], order: str, pause_ms: int) -> DataFrame:
    """A text that ends with a stop is confirmed by a pause before the next row, or by a next row that begins with it."""
    w = Window.partitionBy(*by).orderBy(order)
    nxt = df.withColumn("next_", F.lead("text").over(w)).withColumn("gap_", F.lead("ts_ms").over(w) - F.col("ts_ms"))
    ends = F.regexp_replace("text", r"\s+$", "").rlike(r"[.!?]+[\"')\]]*$")
    how = F.when(~ends, "open").when(F.col("gap_") >= pause_ms, "pause").when(F.startswith(F.col("next_"), F.col("text")), "next").otherwise("unconfirmed")
    return nxt.withColumn("boundary", how).drop("next_", "gap_")


def flag_injection(text: Column) -> Column:
    return text.rlike("(?i)" + "|".join(INJECTIONS))


def redact(text: Column, most: int = 500) -> Column:
    """Bearer tokens, keys and secrets masked; white space squeezed; cut to ``most``."""
    t = F.regexp_replace(text, r"(?i)Bearer\s+\S+", "Bearer [REDACTED]")
    t = F.regexp_replace(t, r"(?i)((?:api[-_ ]?key|authorization|token|secret)\s*[:=]\s*)\S+", "$1[REDACTED]")
    t = F.regexp_replace(t, r"\b(?:sk|key)-[a-zA-Z0-9_-]{16,}\b", "[REDACTED]")
    return F.substring(F.regexp_replace(F.regexp_replace(t, r"\s+", " "), "^ | $", ""), 1, most)


def text_identity(df: DataFrame, text: str = "text") -> DataFrame:
    """Digest of the normalised tokens, their number, and how many rows share it."""
    out = df.withColumn("identity", identity(F.col(text))).withColumn("n_tokens", F.size(tokens(F.col(text))))
    counts = out.groupBy("identity").agg(F.count("*").alias("n_same"))
    return out.join(counts, "identity")


def phrases_within(texts: DataFrame, phrases: DataFrame, key: list[str], head: int = 4, shipped_chars: int = SHIPPED_CHARS) -> DataFrame:
    """Distinct rows of ``key``, ``text_`` and the phrase's columns where the phrase's tokens lie in a row in the text.

    ``texts``: key and tokens ``t_``; ``phrases``: tokens ``p_`` and other columns.  Phrases of ``shipped_chars`` in all go to the tasks as one
    automaton, and each text is read once, where it lies.  More phrases are joined on their first ``head`` tokens (all of a shorter
    phrase), and the whole phrase is checked; both ways give the same rows.
    """
    p = phrases.where(F.size("p_") > 0).withColumn("norm_", F.array_join("p_", " "))
    whole = texts.where(F.size("t_") > 0).select(*key, F.array_join("t_", " ").alias("text_"))
    shipped = shipped_phrases(p, "norm_", shipped_chars)
    if shipped is not None:
        found = phrases_in(whole, [*key, "text_"], "text_", shipped, "norm_")
        return found.join(p.drop("p_"), "norm_").select(*key, "text_", *[c for c in p.columns if c not in ("p_", "norm_")]).distinct()
    p = p.withColumn("head_", F.array_join(F.slice("p_", 1, head), " ")).drop("p_")
    t = texts.where(F.size("t_") > 0)
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.size("t_"), F.lit(head))), lambda n: F.transform(F.sequence(F.lit(1), F.size("t_") - n + 1), lambda i: F.array_join(F.slice(F.col("t_"), i, n), " "))))
    near = t.select(*[F.col(c).alias(f"key_{c}") for c in key], F.explode(F.array_distinct(grams)).alias("head_")).join(p, "head_").drop("head_").distinct()
    same = [F.col(c).eqNullSafe(F.col(f"key_{c}")) for c in key]
    found = near.join(whole, same).where(F.contains(F.concat(F.lit(" "), "text_", F.lit(" ")), F.concat(F.lit(" "), "norm_", F.lit(" "))))
    return found.select(*key, "text_", *[c for c in p.columns if c not in ("head_", "norm_")]).distinct()


def match_terms(df: DataFrame, terms: DataFrame, key: list[str], k: int = 25, shipped_chars: int = SHIPPED_CHARS) -> DataFrame:
    """Whole-word terms of any length in each text, longest first, at most ``k`` (the feature's limit).

    ``terms``: ``term_id, norm`` with the tokens joined by spaces.  ``dictionary.with_targets`` takes terms to their translations,
    with English and German to fall back on, before they are matched: terms without any don't count.
    """
    t = df if "t_" in df.columns else df.select(*key, tokens(F.col("text")).alias("t_"))
    found = phrases_within(t, terms.select("term_id", "norm", F.split("norm", " ").alias("p_")), key, shipped_chars=shipped_chars).select(*key, "norm", "term_id").distinct()
    w = Window.partitionBy(*key).orderBy(F.desc(F.length("norm")), "norm", "term_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


#: Tiers of a phrase match, best first.
TIERS = ("exact", "normalized", "contained", "contains")


def match_phrases(df: DataFrame, phrases: DataFrame, key: list[str]) -> DataFrame:
    """Pairs of text and phrase (``phrase_id, text``) with their best tier; ``place`` 1 is the text's answer.

    exact: equal in lower case; normalized: equal without punctuation; contained: the text holds a phrase of over 15 characters;
    contains: a text of 5 characters or more, and of at least 0.6 of the phrase's length, lies in the phrase.  ``place`` orders a
    text's phrases by tier, then ``phrase_id``.  Containment joins on the part's first characters and then checks the whole part.
    """
    bare = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    low = bare(F.lower("text"))
    norm = bare(F.regexp_replace(F.regexp_replace(F.lower("text"), "[.,!?;:'\"]", ""), r"\s+", " "))
    t = df.where("text is not null").select(*key, low.alias("low_"), norm.alias("norm_")).distinct()
    p = phrases.where("text is not null").select("phrase_id", low.alias("plow_"), norm.alias("pnorm_")).distinct()
    tier = lambda rows, n: rows.select(*key, "phrase_id", F.lit(n).alias("tier_"))

    def heads(rows: DataFrame, ids: list[str], text: str, size: int | F.Column) -> DataFrame:
        """A row per distinct substring of ``size`` characters."""
        size = F.lit(size) if isinstance(size, int) else size
        places = rows.where(F.length(text) >= size).select(*ids, text, size.alias("size_")).withColumn("at_", F.explode(F.sequence(F.lit(1), F.length(text) - F.col("size_") + 1)))
        return places.select(*ids, "size_", F.substring(F.col(text), F.col("at_"), F.col("size_")).alias("head_")).distinct()

    long = p.where(F.length("plow_") > 15).withColumn("head_", F.substring("plow_", 1, 16))
    near = heads(t, key, "low_", 16).join(long, "head_").select(*key, "phrase_id", "plow_").distinct()
    contained = near.join(t, key).where(F.contains("low_", "plow_"))
    # a text's head: 5 characters, or the greatest power of two from 8 on that it has; a phrase's parts of at least 0.6 have at most two such sizes
    power = lambda n: F.pow(F.lit(2), F.floor(F.log2(n))).cast("int")
    short = t.where(F.length("norm_") >= 5).withColumn("size_", F.when(F.length("norm_") < 8, 5).otherwise(power(F.length("norm_")))).withColumn("head_", F.expr("substring(norm_, 1, size_)"))
    n = F.length("pnorm_")
    sizes = F.filter(F.concat(F.array(F.lit(5)), F.when(n >= 8, F.transform(F.sequence(F.lit(3), F.floor(F.log2(n)).cast("int")), lambda i: F.pow(F.lit(2), i).cast("int"))).otherwise(F.array().cast("array<int>"))), lambda x: (x <= n) & (x > 0.3 * n))
    parts = heads(p.withColumn("each_", F.explode(sizes)), ["phrase_id"], "pnorm_", F.col("each_")).join(short, ["size_", "head_"]).select(*key, "norm_", "phrase_id").distinct()
    contains = parts.join(p, "phrase_id").where(F.contains("pnorm_", "norm_") & (F.length("norm_") / n >= 0.6))

    found = tier(t.join(p, F.col("low_") == F.col("plow_")), 0).unionByName(tier(t.join(p, F.col("norm_") == F.col("pnorm_")), 1)).unionByName(tier(contained, 2)).unionByName(tier(contains, 3))
    best = found.groupBy(*key, "phrase_id").agg(F.min("tier_").alias("tier_"))
    w = Window.partitionBy(*key).orderBy("tier_", "phrase_id")
    named = F.element_at(F.array(*[F.lit(x) for x in TIERS]), F.col("tier_") + 1)
    return best.select(*key, "phrase_id", named.alias("tier"), F.row_number().over(w).alias("place"))
