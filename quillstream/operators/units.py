"""Clean-up of repeated and corrected units inside one text."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Words without content of their own.
COMMON = frozenset(
    "aber alle allem allen aller alles als also am an auch auf aus bei bin bis bist da damit dann das dass dein dem den der des die dies diese dieser dieses doch du "
    "ein eine einem einen einer eines er es für fur ganz hat hast hatte haben ich im in ist ja jetzt man mit nicht noch nun oder sich sie sind so und uns von war was wenn wer wie wir wird zu zum zur".split()
)
#: Negations.
NEGATIONS = frozenset("nicht kein keine keinen keinem keiner nie niemals without not no".split())

_TOKEN = re.compile(r"[^\W_]+")
_UNIT = re.compile(r"[^.!?]+[.!?]+[\"'»”]?|[^.!?]+$")
_QUOTED = re.compile(r"«[^«»]*»|„[^„“”]*[“”]|\"[^\"]{3,}\"")
_MARKER = re.compile(r"^\d+[.)]|\b\d+\s*[,.:]\s*\d+\b", re.ASCII)
_NUMBER = re.compile("[0-9]+")
_GAPS = re.compile(r"\s{2,}")
_MARKS = re.compile("[\u0300-\u036f]")
_LIST = re.compile(r"(?:^|\s)\d+[.)]\s+[^\W\d_]")


@dataclass(frozen=True)
class Limits:
    """Thresholds of the clean-up; the values given are the fixed defaults."""

    run: int = 4  # least tokens of a block that counts as repeated
    run_share: float = 0.7
    content: int = 5
    contained: float = 0.72
    prefix: int = 4
    new: int = 2
    jaccard: float = 0.58
    removed: float = 0.5  # more than this part removed: all stays
    ahead: int = 2
    cosine: float = 0.78
    cosine_contained: float = 0.25
    dry_run: bool = True  # corrections found by vectors are counted, not made


def units_of(text: str) -> list[str]:
    """Sentence-like pieces with their marks, trimmed."""
    return [u for u in (m.strip() for m in _UNIT.findall(text.strip())) if u]


def tokens_of(text: str) -> list[str]:
    """Letter and digit runs in lower case without marks."""
    low = text.lower()
    return _TOKEN.findall(low if low.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", low)).replace("ß", "ss"))


@lru_cache(maxsize=1 << 16)
def _name(token: str) -> str:
    return (tokens_of(token) or [token.lower()])[0]


def grams_of(tokens: Sequence[str], n: int) -> set[tuple[str, ...]]:
    """Distinct runs of ``n`` tokens."""
    return set(zip(*(tokens[i:] for i in range(n)), strict=False))


def _first_square(codes: np.ndarray, least: int) -> tuple[int, int] | None:
    """(start, length) of the longest block that follows itself at once, the first one of that length.

    A block of ``p`` tokens that follows itself is a run of ``p`` equal tokens at distance ``p``; only distances at which some
    ``least``-gram comes again are looked at.
    """
    n = len(codes)
    grams = np.zeros(n - least + 1, dtype=np.uint64)
    for i in range(least):  # a hash of each gram: equal ones only add distances to look at
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + codes[i : n - least + 1 + i].astype(np.uint64)
    _, which, counts = np.unique(grams, return_inverse=True, return_counts=True)
    again = np.flatnonzero(counts[which.ravel()] > 1)
    if not len(again):
        return None
    widest = min(n // 2, int(again[-1] - again[0]))
    for p in range(widest, least - 1, -1):
        same = codes[:-p] == codes[p:]
        if np.count_nonzero(same) < p:
            continue
        ends = np.flatnonzero(np.diff(np.concatenate(([0], same.view(np.int8), [0]))))
        starts, lengths = ends[::2], ends[1::2] - ends[::2]
        long = np.flatnonzero(lengths >= p)
        if len(long):
            return int(starts[long[0]]), p
    return None


def collapsed(text: str, least: int = 4, most: int = 50) -> tuple[str, list[str], tuple | None]:
    """The text without the first copy of each block of ``least`` tokens or more that follows itself, what was cut, and its tokens and grams if known."""

    def tidy(s: str) -> str:
        return re.sub(r"\s{2,}", " ", re.sub(r"\s+([,.;:!?])", r"\1", s)).strip()

    tokens = tokens_of(text)
    grams = grams_of(tokens, least)
    if len(grams) == max(0, len(tokens) - least + 1) and (text.isascii() or len(_TOKEN.findall(text)) == len(tokens)):  # else a token falls apart without its marks
        return (text if "  " not in text and text.isprintable() else _GAPS.sub(" ", text).strip()), [], (tokens, grams)
    cut: list[str] = []
    while len(cut) < most:
        places = [m.start() for m in _TOKEN.finditer(text)]
        names = [_name(t) for t in _TOKEN.findall(text)]
        if len(names) < 2 * least or len(grams_of(names, least)) == len(names) - least + 1:
            break
        found = _first_square(pd.factorize(np.array(names, dtype=object))[0], least)
        if found is None:
            break
        start, end = places[found[0]], places[sum(found)]
        cut.append(tidy(text[start:end]))
        text = tidy(text[:start] + text[end:])
    return re.sub(r"\s{2,}", " ", text).strip(), cut, None


def common_run(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest run of tokens that both have."""
    if not a or not b:
        return 0
    codes = pd.factorize(np.array([*a, *b], dtype=object))[0]
    left, right = codes[: len(a)], codes[len(a) :]
    run, best = np.zeros(len(right) + 1, dtype=np.int64), 0
    for code in left:
        run[1:] = np.where(right == code, run[:-1] + 1, 0)
        best = max(best, int(run.max()))
    return best


def _shared_prefix(a: Sequence[str], b: Sequence[str]) -> int:
    if not a or not b or a[0] != b[0]:
        return 0
    return next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))


class Unit:
    """One unit with what pairs of units are judged by; most of it is only worked out for units that have something in common."""

    def __init__(self, text: str, known: tuple[list[str], set[tuple[str, ...]]] | None = None, n: int = 0) -> None:
        self.text = text
        self.tokens, grams = known or (tokens_of(text), None)
        self.bag = {t for t in self.tokens if len(t) > 2} - COMMON
        self._grams = {} if grams is None else {n: grams}

    @cached_property
    def content(self) -> list[str]:
        return [t for t in self.tokens if t in self.bag]

    @cached_property
    def numbers(self) -> set[str]:
        return set(_NUMBER.findall(self.text))

    @cached_property
    def protected(self) -> bool:
        quoted = any(q in self.text for q in "«„\"") and _QUOTED.search(self.text)
        return bool(quoted or self.numbers and _MARKER.search(self.text.strip()))

    @cached_property
    def negated(self) -> bool:
        return not NEGATIONS.isdisjoint(self.tokens)

    def grams(self, n: int) -> set[tuple[str, ...]]:
        if n not in self._grams:
            self._grams[n] = grams_of(self.tokens, n)
        return self._grams[n]


def guard(a: Unit, b: Unit) -> str | None:
    """Why the pair must stay, whatever its likeness."""
    if a.protected or b.protected:
        return "protected_repeat"
    if a.numbers and b.numbers and a.numbers != b.numbers:
        return "conflicting_numbers"
    return "negation_flip" if a.negated != b.negated else None


def pair_verdict(a: Unit, b: Unit, limits: Limits = Limits(), similarity: float | None = None) -> tuple[str, str]:
    """(action, reason) for unit ``b`` after unit ``a``: drop the previous one, drop the current one, keep both or blocked."""
    apart = a.bag.isdisjoint(b.bag) and a.grams(limits.run).isdisjoint(b.grams(limits.run))
    if apart and similarity is None:  # nothing to drop, guarded or not
        return "keep", "too_short" if min(len(a.bag), len(b.bag)) < limits.content else "different_content"
    alike = similarity is not None and similarity >= limits.cosine
    why = guard(a, b)
    if why:
        return ("blocked" if alike else "keep"), why
    both = len(a.bag & b.bag)
    contained = both / min(len(a.bag), len(b.bag)) if a.bag and b.bag else 0.0
    union = len(a.bag | b.bag)
    jaccard = both / union if union else 0.0
    fresh = len(b.bag - a.bag)
    prefix, raw_prefix = _shared_prefix(a.content, b.content), _shared_prefix(a.tokens, b.tokens)
    headed = raw_prefix >= 5
    if (len(a.bag) >= max(3, limits.content - 2) or headed) and contained >= 0.95 and fresh >= limits.new and (prefix >= max(2, limits.prefix - 1) or headed):
        return "drop_previous", "prefix_fragment_correction"
    if alike and contained >= limits.cosine_contained and len(a.bag) >= 2 and len(b.bag) >= 3 and fresh >= limits.new and len(b.text) >= len(a.text):
        return "drop_previous", "semantic_correction"
    run = 0 if a.grams(limits.run).isdisjoint(b.grams(limits.run)) else common_run(a.tokens, b.tokens)
    shorter = min(len(a.tokens), len(b.tokens))
    if run >= limits.run and run / shorter >= limits.run_share:
        return ("drop_previous" if len(a.tokens) <= len(b.tokens) else "drop_current"), "repeated_phrase"
    if min(len(a.bag), len(b.bag)) < limits.content:
        return "keep", "too_short"
    if contained >= limits.contained and fresh >= limits.new and (prefix >= limits.prefix or jaccard >= limits.jaccard):
        return "drop_previous", "expanded_correction"
    if jaccard == 1 and a.text.strip().lower() == b.text.strip().lower() and len(a.tokens) >= limits.run:
        return "drop_current", "exact_duplicate"
    return "keep", "different_content"


def worth_comparing(a: Unit, b: Unit, limits: Limits) -> bool:
    """Could vectors change the verdict on this pair?"""
    if a.protected or b.protected or len(a.bag) < 2 or len(b.bag) < 3 or len(a.bag & b.bag) < limits.cosine_contained * min(len(a.bag), len(b.bag)):
        return False
    return guard(a, b) is not None or (len(b.text) >= len(a.text) and len(b.bag - a.bag) >= limits.new)


def cosines(vectors: np.ndarray) -> np.ndarray:
    """All cosines of the rows, by one product; NaN beside a zero vector."""
    size = np.sqrt((vectors * vectors).sum(axis=1))
    with np.errstate(invalid="ignore", divide="ignore"):
        unit = np.where(size[:, None] > 0, vectors / size[:, None], np.nan)
    return unit @ unit.T


def clean_units(text: str | None, limits: Limits = Limits(), vectors: Callable[[list[str]], np.ndarray] | None = None) -> dict:
    """What becomes of one text: ``action`` (emit, trim or blocked), ``cleaned``, the removed units and the reasons.

    Blocks that follow themselves inside a unit collapse first.  Then each unit that still stands meets the next two: a
    correction drops the earlier one, a repeat one of both, unless a guard or an anaphora (a gap that shares their content) protects them.
    If over half of the characters would go, the text stays as it was.  With ``vectors`` (one row for each unit), likeness of meaning
    may drop an earlier unit too.  Null and empty texts are emitted as they are.
    """
    text = text or ""
    out = {"action": "emit", "cleaned": text, "n_units": 0, "removed": [], "collapsed": 0, "reasons": [], "candidates": 0, "held_back": 0}
    if _LIST.search(text):
        return out
    pieces = [collapsed(u, limits.run) for u in units_of(text)]
    units, folds = [Unit(p, known, limits.run) for p, _, known in pieces], sum(len(c) for _, c, _ in pieces)
    out |= {"n_units": len(units), "collapsed": folds, "reasons": ["internal_repeat"] * folds}
    if len(units) < 2 and not folds:
        return out
    near = cosines(vectors([u.text for u in units])) if vectors and len(units) > 1 else None
    keep = [True] * len(units)
    for i, a in enumerate(units):
        for j in range(i + 1, min(len(units), i + 1 + limits.ahead)):
            if not keep[i]:
                break
            if not keep[j]:
                continue
            b = units[j]
            action, why = pair_verdict(a, b, limits)
            if action == "keep" and near is not None and np.isfinite(near[i, j]) and worth_comparing(a, b, limits):
                action, why = pair_verdict(a, b, limits, float(near[i, j]))
            if why == "repeated_phrase" and any(not (a.bag | b.bag).isdisjoint(u.bag) for u in units[i + 1 : j]):
                action, why = "keep", "protected_anaphora_gap"
            by_meaning = why == "semantic_correction"
            out["candidates"] += by_meaning
            out["held_back"] += action == "blocked"
            if action != "keep":
                out["reasons"].append(why)
            if action == "drop_previous":
                keep[i] = by_meaning and limits.dry_run
                break
            if action == "drop_current":
                keep[j] = False
    removed = [i for i, k in enumerate(keep) if not k]
    if not removed and not folds:
        return out
    cleaned = " ".join(u.text for u, k in zip(units, keep, strict=True) if k).strip()
    out["removed"] = removed
    if not cleaned or len(text) - len(cleaned) > limits.removed * len(text):
        return out | {"action": "blocked"}
    return out | {"action": "trim", "cleaned": cleaned}


def hashed_vectors(units: list[str], dim: int = 256) -> np.ndarray:
    """Content tokens of each unit as counts by hash: vectors where no embedding is at hand."""
    out = np.zeros((len(units), dim))
    for row, unit in zip(out, units, strict=True):
        for t in Unit(unit).content:
            row[zlib.crc32(t.encode()) % dim] += 1
    return out


CLEANED = "action string, cleaned string, n_units int, removed array<int>, collapsed int, reasons array<string>, candidates int, held_back int"


def unit_pair_cleanup(df: DataFrame, key: Sequence[str], text_col: str = "text", limits: Limits = Limits(), vectors: Callable[[list[str]], np.ndarray] | None = None) -> DataFrame:
    """``clean_units`` of every text, row by row where it lies (no exchange); ``vectors`` gives a matrix for a text's units.

    Null and empty texts are emitted; rows that repeat a key are rows; an empty table gives none.  Other columns are ignored.
    """
    key = list(key)
    names = [c.split()[0] for c in CLEANED.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [clean_units(t, limits, vectors) for t in f["text_"]]
            yield pd.concat([f[key].reset_index(drop=True), pd.DataFrame(rows, columns=names)], axis=1)

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)
    few = df.select(*key, df[text_col].cast("string").alias("text_"))
    return few.mapInPandas(run, f"{schema}, {CLEANED}")
