"""Verdicts on units that are close in meaning to one before: guards, eligible matches, ladder."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .core import band_pairs
from .stabilize import REPEAT_CUES
from .units import Unit, common_run

_RAW = re.compile(r"[^\W_]+")


def pair_guards(before: str, now: str) -> tuple[int, list[str]]:
    """(content words that only ``now`` has, guards that keep it): numbers, negation, quote, rhetorical, expansion.

    An expansion says all of the older unit again and more: dropping it would lose what was never said in full.
    """
    a, b = Unit(before), Unit(now)
    why = []
    if a.numbers and b.numbers and a.numbers != b.numbers:
        why.append("guard_numbers")
    if a.negated != b.negated:
        why.append("guard_negation")
    if a.protected or b.protected:
        why.append("guard_quote")
    if re.search(REPEAT_CUES, now):
        why.append("guard_rhetorical")
    raw = [_RAW.findall(t.lower().replace("ß", "ss")) for t in (before, now)]
    if len(raw[1]) > len(raw[0]) and common_run(*raw) == len(raw[0]):
        why.append("guard_expansion")
    return len(b.bag - a.bag), why


def _guarded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        found = [pair_guards(a, b) for a, b in zip(f["before"], f["now"], strict=True)]
        f = f.drop(columns=["before", "now"])
        yield f.assign(fresh=[n for n, _ in found], guards=[",".join(g) for _, g in found])


def semantic_verdicts(
    units: DataFrame, by: list[str], window_ms: int = 150_000, cap: int = 32, exploratory: float = 0.70, precise: float = 0.75, most_fresh: int = 2,
) -> DataFrame:
    """Is a unit a repeat in meaning of one of the ``cap`` units before it, in another release, at most ``window_ms`` ago?

    ``units``: by, ``seq`` (orders the units of a key), ``release_seq, ts_ms, text, vec``.  The best raw match is the unit of highest cosine
    (ties: the oldest); the best eligible one has no guard, ``most_fresh`` new content words at most, and a cosine of ``exploratory``.  An
    eligible match makes a candidate, of high precision from ``precise`` on.  Without one, a raw match below ``exploratory`` is kept (so is a unit without
    history), a guarded one is ``guarded`` with its guards, any other is ``related_with_new_content``.

    Cosines are taken in the JVM for the bounded band of pairs; words are looked at only for pairs that reach ``exploratory``.  A vector
    that is null or zero is compared with nothing; null texts are empty.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    rows = units.select(*by, "seq", "release_seq", "ts_ms", F.coalesce("text", F.lit("")).alias("text"), "vec", F.sqrt(dot(F.col("vec"), F.col("vec"))).alias("norm_"))
    pairs = band_pairs(rows, by, ["seq"], cap).where((F.col("cur.ts_ms") - F.col("old.ts_ms") <= window_ms) & (F.col("cur.release_seq") != F.col("old.release_seq")))
    pairs = pairs.where((F.col("cur.norm_") > 0) & (F.col("old.norm_") > 0) & (F.size("cur.vec") == F.size("old.vec")))
    scored = pairs.select(
        *by, F.col("cur.seq").alias("seq"), F.col("old.seq").alias("old"), (dot(F.col("cur.vec"), F.col("old.vec")) / (F.col("cur.norm_") * F.col("old.norm_"))).alias("cosine"),
        F.col("old.text").alias("before"), F.col("cur.text").alias("now"),
    )
    near = scored.where(F.col("cosine") >= exploratory)
    schema = ", ".join(f"`{c}` {units.schema[c].dataType.simpleString()}" for c in by)
    judged = near.mapInPandas(_guarded, f"{schema}, seq {units.schema['seq'].dataType.simpleString()}, old {units.schema['seq'].dataType.simpleString()}, cosine double, fresh long, guards string")
    first = lambda when: F.max(F.when(when, F.struct("cosine", (-F.col("old")).alias("older"), "fresh", "guards")))
    told = judged.groupBy(*by, "seq").agg(first(F.lit(True)).alias("raw_"), first((F.col("guards") == "") & (F.col("fresh") <= most_fresh)).alias("fit_"))
    compared = scored.groupBy(*by, "seq").agg(F.count("*").alias("compared"), F.max(F.struct("cosine", (-F.col("old")).alias("older"))).alias("near_"))
    x = units.select(*by, "seq").join(compared, [*by, "seq"], "left").join(told, [*by, "seq"], "left")
    verdict = (
        F.when(F.col("compared").isNull(), "keep").when(F.col("fit_").isNotNull(), F.when(F.col("fit_.cosine") >= precise, "candidate_high_precision").otherwise("candidate_exploratory"))
        .when(F.col("raw_").isNull(), "keep").when(F.col("raw_.guards") != "", "guarded").otherwise("related_with_new_content")
    )
    reason = (
        F.when(F.col("compared").isNull(), "no_history").when(F.col("fit_").isNotNull(), F.when(F.col("fit_.cosine") >= precise, "above_high_precision_tau").otherwise("above_exploratory_tau"))
        .when(F.col("raw_").isNull(), "below_exploratory_tau").when(F.col("raw_.guards") != "", F.col("raw_.guards")).otherwise("new_lexical_tokens_above_max")
    )
    return x.select(
        *by, "seq", F.coalesce("compared", F.lit(0)).alias("compared"), verdict.alias("verdict"), reason.alias("reason"), F.round("near_.cosine", 5).alias("cosine"), (-F.col("near_.older")).alias("match"),
        F.round("fit_.cosine", 5).alias("eligible_cosine"), (-F.col("fit_.older")).alias("eligible"),
    )
