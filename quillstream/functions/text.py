"""Tokens, stems and text identity as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and what they become, place by place.
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
TOKEN = r"[\p{L}\p{N}]+"


def folded(text: Column) -> Column:
    """Lower case without the marks of Latin letters."""
    return F.translate(F.lower(text), MARKED, PLAIN)


def tokens(text: Column) -> Column:
    """Letter and digit runs of the folded text; null text has none."""
    return F.regexp_extract_all(folded(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})"), F.lit(1))


def words(text: Column) -> Column:
    """White-space separated words of the trimmed text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def stems(text: Column, length: int = 4) -> Column:
    """Words in lower-case letters (a-z, ä, ö, ü, ß), cut to ``length``."""
    bare = F.transform(words(text), lambda w: F.substring(F.regexp_replace(F.lower(w), "[^a-zäöüß]", ""), 1, length))
    return bare


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays taken as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def identity(text: Column) -> Column:
    """24 characters of SHA-256 over the tokens joined by spaces."""
    return F.substring(F.sha2(F.array_join(tokens(text), " "), 256), 1, 24)
