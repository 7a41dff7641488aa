"""Quality classifier by positive-unlabelled learning."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import seeded_hash, table, written
from .quality_rules import _repeat_words

#: What a text is judged by; only its characters count.
FEATURES = (
    "log_words", "symbols", "exclamations", "upper", "digits", "stops", "other_marks", "beyond_ascii", "adjacent_repeats",
    "distinct_words", "repeated_windows", "repeated_lines", "word_length", "word_length_spread", "one_letter_words", "line_words", "longest_word",
)
#: Standardised features are cut at this many standard deviations.
CUT = 6.0

_CLASSES = {name: np.array([chr(i) in chars for i in range(256)]) for name, chars in {
    "symbols": "#*$%&|<>~^_={}[]\\/@", "exclamations": "!?", "digits": "0123456789", "stops": ".,;:", "other_marks": "\"'()-+`",
    "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
}.items()}
_MANY_UPPER = frozenset(chr(c) for c in range(0xC0, 0xDF))


def text_features(text: str | None) -> list[float]:
    """The features of one whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = max(1, len(words))
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    chars = max(1, sum(map(len, words)))
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1, dtype=np.int64)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    share = {name: float(counts[of].sum()) / chars for name, of in _CLASSES.items()}
    upper = share["upper"] + (sum(map(text.count, _MANY_UPPER)) / chars if counts[0xC3] else 0.0)
    return [
        float(np.log1p(len(words))), share["symbols"], share["exclamations"], upper, share["digits"], share["stops"], share["other_marks"],
        float(counts[128:].sum()) / chars, sum(map(eq, words, words[1:])) / n, len(set(words)) / n, _repeat_words(words) / n,
        (len(lines) - len(set(lines))) / max(1, len(lines)), float(lengths.mean()), float(lengths.std()), float((lengths == 1).sum()) / n,
        float(np.log1p(n / max(1, len(lines)))), float(np.log1p(lengths.max())),
    ]


def _features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"doc_id": f["doc_id"], "x": [text_features(t) for t in f["text"]]})


@dataclass(frozen=True)
class Classifier:
    """Logistic scores over standardised, cut features."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def standardised(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -CUT, CUT)

    def score(self, x: Column) -> Column:
        total = F.lit(float(self.bias))
        for i, (m, s, w) in enumerate(zip(self.mean, self.spread, self.weights, strict=True)):
            z = (x[i] - float(m)) / float(s)
            total = total + F.greatest(F.lit(-CUT), F.least(F.lit(CUT), z)) * float(w)
        return 1.0 / (1.0 + F.exp(-total))


def standard(positive: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of the positives' features."""
    mean, spread = positive.mean(axis=0), positive.std(axis=0)
    return mean, np.maximum(spread, 0.02 * np.maximum(1.0, np.abs(mean)))


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1, least_share: float = 0.8) -> float:
    """Share of positives among the unlabelled, estimated from scores of either that no label but the positives' has shaped.

    Whatever the threshold, the share of unlabelled rows above it over the share of positives above it is at least the prior, and
    equals it where no negative scores as high: the estimate is the ratio whose upper confidence is least (the best bin), among thresholds
    that at least ``least_share`` of the positives pass, since few positives make a noisy ratio.  Half of what is unsure is added, so
    that with little data a document is rather kept; it vanishes as the rows grow.
    """
    tops = np.sort(positive)[::-1]
    rest = np.sort(unlabelled)[::-1]
    at = np.unique(np.linspace(0, len(tops) - 1, min(len(tops), 400)).astype(int))
    share_p = (at + 1) / len(tops)
    share_u = np.searchsorted(-rest, -tops[at], side="right") / len(rest)
    at, share_u, share_p = at[share_p >= least_share], share_u[share_p >= least_share], share_p[share_p >= least_share]
    unsure = np.sqrt(np.log(4 / delta) / (2 * len(rest))) + np.sqrt(np.log(4 / delta) / (2 * len(tops)))
    best = int(np.argmin((share_u + unsure) / share_p))
    return float(min(0.99, (share_u[best] + unsure / 2) / share_p[best]))


class Risk:
    """The positive-unlabelled risk of the logistic loss, with its slope and curvature.

    prior * E_P[l(g)] + E_U[l(-g)] - prior * E_P[l(-g)], of which the last two terms estimate the negatives' risk.  ``unlabelled``
    gives, for given weights, the sums over all unlabelled rows of l(-g), its slope and its curvature, and their number.
    """

    def __init__(self, positive: np.ndarray, unlabelled: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray, int]], prior: float, decay: float) -> None:
        self.positive, self.unlabelled, self.prior, self.decay = positive, unlabelled, prior, decay

    def at(self, w: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Risk, its part of the negatives, slope and curvature.  l(g) - l(-g) is -g, so the positives' part is linear."""
        loss, slope, curve, n = self.unlabelled(w)
        g = self.positive @ w
        shrunk = self.decay * np.append(w[:-1], 0.0)
        negative = loss / n - self.prior * np.logaddexp(0, g).mean()
        risk = loss / n - self.prior * g.mean() + (shrunk @ w) / 2
        return risk, negative, slope / n - self.prior * self.positive.mean(axis=0) + shrunk, curve / n + self.decay * np.diag(np.append(np.ones(len(w) - 1), 1e-3))


def fit_positive_unlabelled(risk: Risk, width: int, steps: int = 12) -> np.ndarray:
    """Minimise the non-negative risk by Newton's method, the step halved until the risk falls.

    The risk is convex.  A step that takes the negatives' part, which no true risk can, below 0 is halved as well: there
    the model fits the sample's noise, and the walk ends.
    """
    w = np.zeros(width)
    value, _, slope, curve = risk.at(w)
    for _ in range(steps):
        step = np.linalg.solve(curve, slope)
        for halves in range(6):
            tried = w - step / 2**halves
            new = risk.at(tried)
            if new[0] <= value and new[1] >= 0:
                break
        else:
            return w
        done = value - new[0] < 1e-6
        w, (value, _, slope, curve) = tried, new
        if done:
            return w
    return w


def _sums(mean: np.ndarray, spread: np.ndarray, w: np.ndarray):
    """Per partition: sums of the loss, its slope and curvature over the rows as unlabelled ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2 + len(w) + len(w) ** 2)
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False)
            x = np.clip((flat.reshape(-1, len(mean)) - mean) / spread, -CUT, CUT)
            total += sums(np.c_[x, np.ones(len(x))], w)
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "v"])

    return run


def sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number of rows, loss, slope and curvature of l(-g) summed over rows, in one array."""
    g = x @ w
    s = 1 / (1 + np.exp(-g))
    return np.concatenate(([len(x), np.logaddexp(0, g).sum()], s @ x, (x.T * (s * (1 - s)) @ x).ravel()))


def _parted(total: np.ndarray, width: int) -> tuple[float, np.ndarray, np.ndarray, int]:
    return total[1], total[2 : 2 + width], total[2 + width :].reshape(width, width), max(1, int(total[0]))


def _matrix(rows: DataFrame, seed: str, most: int) -> np.ndarray:
    """Features of at most ``most`` rows, those of least seeded hash."""
    got = rows.select(seeded_hash(F.col("doc_id"), seed).alias("h_"), "doc_id", "x").orderBy("h_", "doc_id", "x").limit(most).select("x").toPandas()
    return np.array(got["x"].tolist(), dtype=np.float64).reshape(-1, len(FEATURES))


def fitted(learned: DataFrame, positive: np.ndarray, sample: np.ndarray, decay: float = 1e-3) -> Classifier:
    """The model of least risk over all rows of ``learned``; ``sample`` of them serves the prior."""
    mean, spread = standard(positive)
    with_one = lambda x: np.c_[np.clip((x - mean) / spread, -CUT, CUT), np.ones(len(x))]
    p, u = with_one(positive), with_one(sample)
    decay += 4 / len(p)  # few positives say little of single features
    width = len(FEATURES) + 1
    # told apart on every other row, and scored on the others, both ways round
    scores: list[list[np.ndarray]] = [[], []]
    for one, other in ((0, 1), (1, 0)):
        rough = fit_positive_unlabelled(Risk(p[one::2], lambda w: _parted(sums(u[one::2], w), width), 0.5, decay), width)  # noqa: B023
        for kind, x in zip(scores, (p, u), strict=True):
            kind.append(x[other::2] @ rough)
    prior = class_prior(*map(np.concatenate, scores)) if min(len(p), len(u)) > 3 else 0.5

    def everywhere(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, int]:
        rows = learned.select("x").mapInArrow(_sums(mean, spread, w), "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        return _parted(np.array([r["v"] for r in sorted(rows)]), width)

    w = fit_positive_unlabelled(Risk(p, everywhere, prior, decay), width)
    return Classifier(mean, spread, w[:-1], float(w[-1]), prior)


def held_out(doc_id: Column) -> Column:
    """Is crc32 of the id as text, modulo 3, equal to 1?"""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def quality_scores(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = 20_000) -> DataFrame:
    """Quality score of every whole text: ``doc_id, held_out, score, predicted``.

    Trusted positives are documents whose labels in the training part are all 1: at most ``sample_rows`` of them, of least
    seeded hash.  All documents of the training part are the unlabelled rows.  No label 0 is used.  The class
    prior is estimated from positives and unlabelled rows (``class_prior``) by the scores of a model that tells one from the other,
    on as many unlabelled rows; with it, the risk is minimised over all unlabelled rows, whose sums are taken where the rows are: a pass
    for each step, of which the driver gets one row per entry of the curvature.
    Labels, language, source and id are no inputs; all documents are scored.  Null and empty texts are scored by their features like
    all others; null ids and null labels train nothing; repeated rows count and are scored as rows; without positives
    or training documents every score is 0.5; an empty table gives no rows.  Other columns are ignored.
    """
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    features = written(few.mapInPandas(_features, "doc_id long, x array<double>"), "quality-x")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    known = known.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    trusted = known.groupBy("doc_id").agg(F.min("label").alias("l_")).where("l_ = 1").select("doc_id")
    learned = features.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    positive = _matrix(learned.join(trusted, "doc_id", "left_semi"), "positive", sample_rows)
    unlabelled = _matrix(learned, "unlabelled", sample_rows)
    model = Classifier(np.zeros(len(FEATURES)), np.ones(len(FEATURES)), np.zeros(len(FEATURES)), 0.0, 0.5)
    if len(positive) and len(unlabelled):
        model = fitted(learned, positive, unlabelled)
    scored = features.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every whole text of ``documents``, learned from ``labels.quality``."""
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
