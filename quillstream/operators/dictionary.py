"""Many phrases in texts at once: an automaton over token-bounded phrases, dialect mappings, translated terms."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Phrases are shipped to the tasks up to this many characters in all; beyond it they are joined.
SHIPPED_CHARS = 2_000_000


def shipped_phrases(phrases: DataFrame, column: str, most_chars: int = SHIPPED_CHARS) -> list[str] | None:
    """The distinct phrases, if they have ``most_chars`` characters at most; else None, and nothing is collected."""
    distinct = phrases.select(column).where(F.length(column) > 0).distinct()
    if (distinct.agg(F.sum(F.length(column))).first()[0] or 0) > most_chars:
        return None
    return sorted(r[0] for r in distinct.collect())


def phrases_in(texts: DataFrame, key: Sequence[str], column: str, phrases: Sequence[str], name: str = "phrase") -> DataFrame:
    """``key`` and each distinct phrase whose tokens lie in a row in ``column`` (tokens joined by one space): one pass per text.

    All phrases are looked for together; the work is in proportion to the text and its matches.
    """
    key = list(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = ahocorasick.Automaton()
        for p in phrases:
            automaton.add_word(f" {p} ", p)
        automaton.make_automaton()
        for f in frames:
            at, found = [], []
            for i, t in enumerate(f["said_"]):
                own = {p for _, p in automaton.iter(f" {t} ")} if t else ()
                at += [i] * len(own)
                found += sorted(own)
            out = f[key].iloc[at].reset_index(drop=True)
            out[name] = pd.Series(found, dtype=object)
            yield out

    schema = ", ".join(f"`{c}` {texts.schema[c].dataType.simpleString()}" for c in key)
    if not phrases:
        return texts.select(*key, F.lit("").alias(name)).limit(0)
    return texts.select(*key, F.col(column).alias("said_")).mapInPandas(run, f"{schema}, `{name}` string")


_INSIDE = r"\p{L}\p{N}\p{M}_"
_TOKENS = regex.compile(rf"[{_INSIDE}]+")
_PIECES = regex.compile(rf"([{_INSIDE}]+)")


def _fold(token: str) -> str:
    return token.lower().replace("ς", "σ")


class Mapping:
    """Replacements that neither start nor end inside a word, longest first; each sees what the ones before have made.

    Entries of one token are looked up, all those between two longer entries in one pass over the text; a longer entry is
    tried where its first two tokens stand side by side.  So a text costs a pass, and one more for each longer entry it may have.
    """

    def __init__(self, pairs: Sequence[tuple[str, str]]) -> None:
        ordered = sorted(pairs, key=lambda p: -len(p[0]))
        self.standard = [s for _, s in ordered]
        self.single: dict[str, list[int]] = {}
        self.longer: dict[tuple[str, ...], list[tuple[int, regex.Pattern]]] = {}
        for i, (d, _) in enumerate(ordered):
            tokens = [_fold(t) for t in _TOKENS.findall(d)]
            if tokens == [_fold(d)]:
                self.single.setdefault(tokens[0], []).append(i)
            else:
                pattern = regex.compile(rf"(?<![{_INSIDE}]){regex.escape(d, literal_spaces=True)}(?![{_INSIDE}])", regex.IGNORECASE)
                self.longer.setdefault(tuple(tokens[:2]), []).append((i, pattern))
        #: Tokens that entries of one token make, and the longer entries that may come to stand by them.
        self.made = {_fold(t) for found in self.single.values() for i in found for t in _TOKENS.findall(self.standard[i])}
        self.heads = {k[0] for k in self.longer if k}
        self.loose = [k for k in self.longer if not self.made.isdisjoint(k)]

    def _due(self, tokens: list[str], after: int) -> dict[int, regex.Pattern]:
        """Longer entries behind ``after`` that a text may have, now or once entries of one token have made theirs."""
        if not self.longer:
            return {}
        there, heads = set(tokens), self.heads
        keys = {()} | {(t,) for t in there & heads} | {(t, tokens[i + 1]) for i, t in enumerate(tokens[:-1]) if t in heads}
        keys |= {k for k in self.loose if all(t in there or t in self.made for t in k)}
        return {i: p for k in keys & self.longer.keys() for i, p in self.longer[k] if i > after}

    def _looked_up(self, pieces: list[str], tokens: list[str], after: int, before: int) -> int:
        """Put all entries of one token between two places of the order into ``pieces``; how many were there?"""
        made = 0
        for place, token in enumerate(tokens):
            if token in self.single:
                at = next((i for i in self.single[token] if after < i < before), None)
                if at is not None:
                    inner = _PIECES.split(self.standard[at])
                    made += 1 + self._looked_up(inner, [_fold(t) for t in inner[1::2]], at, before)
                    pieces[2 * place + 1] = "".join(inner)
        return made

    def apply(self, text: str) -> tuple[str, int]:
        """The text with all replacements, and their number."""
        at, made, end = -1, 0, len(self.standard)
        while at < end:
            pieces = _PIECES.split(text)  # between tokens, and tokens at odd places
            tokens = _fold("\n".join(pieces[1::2])).split("\n")
            due = self._due(tokens, at)
            after, at = at, min(due, default=end)
            n = self._looked_up(pieces, tokens, after, at)
            made, text = made + n, "".join(pieces) if n else text
            if at < end:
                standard = self.standard[at]
                text, n = due[at].subn(lambda _: standard, text)  # noqa: B023
                made += n
        return text, made


def normalize_dialect(df: DataFrame, mapping: DataFrame, key: Sequence[str], text_col: str = "text", most_rows: int = 100_000) -> DataFrame:
    """``key, normalized, n_phrases, n_words``: phrases, then words, replaced by their standard form.

    ``mapping``: ``tier`` (phrase or word), ``dialect``, ``standard``.  Matches ignore case and are bounded by tokens (letters, digits, marks and
    the underscore); longer entries go first (ties: in order of the entry), and a replacement may be replaced by a shorter entry.  The
    mapping is a dictionary of at most ``most_rows`` entries, which is checked before it is shipped; a larger one is an error.  Entries that are null or
    empty are left out, of one dialect form the first standard form (in order) is taken.  Null texts stay null; rows that
    repeat a key are rows; an empty table gives none.
    """
    key = list(key)
    entries = mapping.where(F.col("dialect").isNotNull() & (F.trim("dialect") != "") & F.col("standard").isNotNull() & F.col("tier").isin("phrase", "word"))
    rows = entries.groupBy("tier", "dialect").agg(F.min("standard").alias("standard")).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a mapping of more than {most_rows} entries")
    pairs = {tier: sorted((r["dialect"], r["standard"]) for r in rows if r["tier"] == tier) for tier in ("phrase", "word")}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        phrases, words = Mapping(pairs["phrase"]), Mapping(pairs["word"])
        for f in frames:
            out = []
            for t in f["text_"]:
                if t is None:
                    out.append((None, 0, 0))
                    continue
                t, n = phrases.apply(t)
                t, m = words.apply(t)
                out.append((t, n, m))
            yield pd.concat([f[key].reset_index(drop=True), pd.DataFrame(out, columns=["normalized", "n_phrases", "n_words"])], axis=1)

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)
    few = df.select(*key, df[text_col].cast("string").alias("text_"))
    return few.mapInPandas(run, f"{schema}, normalized string, n_phrases long, n_words long")


def with_targets(terms: DataFrame, lang: str | Column) -> DataFrame:
    """Terms with ``target``: their translation into ``lang``, else English, else German (``fallback``); terms with none are left out.

    ``terms`` has ``translations``, a map from language to text; empty translations count as missing.
    """
    lang = F.lit(lang) if isinstance(lang, str) else lang
    text = lambda to: F.nullif(F.try_element_at("translations", to), F.lit(""))
    own = text(lang)
    target = F.coalesce(own, text(F.lit("en")), text(F.lit("de")))
    return terms.withColumn("target", target).withColumn("fallback", own.isNull()).where("target is not null")
