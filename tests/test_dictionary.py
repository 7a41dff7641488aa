"""Dialect mappings, phrases by automaton and translated terms against brute force."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from quillstream.operators import dictionary, text

MAPPING = "tier string, dialect string, standard string"


def plain(t, entries):
    """Every entry in turn, phrases first, longest first."""
    for tier in ("phrase", "word"):
        for d, s in sorted(sorted((d, s) for x, d, s in entries if x == tier), key=lambda p: -len(p[0])):
            t = regex.sub(rf"(?<![\p{{L}}\p{{N}}\p{{M}}_]){regex.escape(d)}(?![\p{{L}}\p{{N}}\p{{M}}_])", lambda _: s, t, flags=regex.IGNORECASE)  # noqa: B023
    return t


@pytest.mark.parametrize(("said", "want"), [
    ("Mer sind ds Volk, ds isch guet.", "wir sind das Volk, das ist gut."),
    ("mermer mer_ mer-mer", "mermer mer_ wir-wir"),
    ("Grüezi mitenand und guete Morge", "Guten Tag zusammen und guten Morgen"),
    ("e chli meh", "ein wenig mehr"), ("é e", "é ein"), ("", ""), (None, None),
])
def test_stated_cases(spark, said, want):
    entries = [("word", "mer", "wir"), ("word", "ds", "das"), ("word", "isch", "ist"), ("word", "guet", "gut"), ("word", "e", "ein"), ("word", "meh", "mehr"),
               ("phrase", "grüezi mitenand", "Guten Tag zusammen"), ("phrase", "guete morge", "guten Morgen"), ("phrase", "e chli", "ein wenig"), ("word", None, "x"), ("word", " ", "x"), ("word", "mer", "zzz")]
    df = spark.createDataFrame([(1, said, "x")], "doc_id long, text string, standard string")
    assert dictionary.normalize_dialect(df, spark.createDataFrame(entries, MAPPING), ["doc_id"]).first().normalized == want


def test_mapping_equals_one_pattern_after_the_other():
    rng = random.Random(3)
    tokens = ["a", "b", "ab", "abc", "ä", "x_", "b.c", "1", "B"]
    for _ in range(400):
        pairs = {}
        for _ in range(rng.randrange(1, 9)):
            pairs[" ".join(rng.choice(tokens) for _ in range(rng.randrange(1, 4)))] = " ".join(rng.choice(tokens) for _ in range(rng.randrange(1, 3)))
        said = "".join(rng.choice(tokens) + rng.choice([" ", " ", ", ", "-"]) for _ in range(rng.randrange(0, 14)))
        assert dictionary.Mapping(sorted(pairs.items())).apply(said)[0] == plain(said, [("word", d, s) for d, s in pairs.items()])


def test_mapping_of_the_wrong_size_or_no_rows(spark):
    df = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    big = spark.range(12).select(F.lit("word").alias("tier"), F.col("id").cast("string").alias("dialect"), F.lit("x").alias("standard"))
    with pytest.raises(ValueError):
        dictionary.normalize_dialect(df, big, ["doc_id"], most_rows=10)
    assert dictionary.normalize_dialect(df, big.limit(0), ["doc_id"]).first().normalized == "a"
    assert dictionary.normalize_dialect(df.limit(0), big, ["doc_id"]).count() == 0


def test_both_ways_of_finding_phrases_agree(spark):
    rng = random.Random(2)
    words = ["ka", "lo", "mi", "su"]
    phrases = [(i, [rng.choice(words) for _ in range(1 + i % 7)]) for i in range(40)] + [(41, [])]
    texts = [(i, [rng.choice(words) for _ in range(rng.randrange(0, 25))]) for i in range(80)] + [(7, ["ka"])]
    p, t = spark.createDataFrame(phrases, "phrase_id long, p_ array<string>"), spark.createDataFrame(texts, "doc_id long, t_ array<string>")
    rows = lambda chars: sorted((r.doc_id, r.text_, r.phrase_id) for r in text.phrases_within(t, p, ["doc_id"], shipped_chars=chars).collect())
    want = {(i, " ".join(w), j) for i, w in texts for j, x in phrases if x and f" {' '.join(x)} " in f" {' '.join(w)} "}
    assert rows(10**6) == rows(0) == sorted(want)


def test_targets_fall_back(spark):
    rows = [(1, {"pl": "a", "en": "b"}), (2, {"en": "b", "de": "c"}), (3, {"de": "c"}), (4, {"fr": "d"}), (5, {"pl": "", "en": "b"}), (6, None)]
    got = dictionary.with_targets(spark.createDataFrame(rows, "term_id long, translations map<string,string>"), "pl").collect()
    assert sorted((r.term_id, r.target, r.fallback) for r in got) == [(1, "a", False), (2, "b", True), (3, "c", True), (5, "b", True)]
