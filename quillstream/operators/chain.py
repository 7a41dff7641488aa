"""The chain of filters over an ordered text stream, and the steps it is made of.

Every stage keeps its own history, and sees only what the stages before it let through, already trimmed; so one ordered pass
carries one state, in batch (``fold.ordered_fold``) and in streams (``streaming.stateful.stream_fold``).
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame

from .dedup import STOP
from .fold import State, Step, _cosine
from .units import Limits, clean_units

_LETTERS = re.compile("[^a-zäöüß]")
_ENDED = re.compile(r"[.!?]$")
_STOP = frozenset(STOP)
#: Words of an n-gram, misses in a row that end an old prefix, least words of a prefix worth cutting.
GRAM, MISSES, OLD_WORDS = 6, 4, 10


def stem(word: str) -> str:
    """Lower-case letters of a word, cut to four."""
    return _LETTERS.sub("", word.lower())[:4]


def content(words: Sequence[str]) -> list[str]:
    """Stems of two letters or more that are no stop words."""
    return [s for s in map(stem, words) if len(s) > 1 and s not in _STOP]


def _ends(words: Sequence[str], n: int) -> bool:
    """Is there a sentence end before place ``n``?"""
    return 0 < n <= len(words) and bool(_ENDED.search(words[n - 1]))


def history_verdict(words: Sequence[str], seen: dict) -> tuple[str, int]:
    """(action, words to cut) of a text whose stem n-grams may have been ``seen``: emit, warn, trim or skip."""
    stems = list(map(stem, words))
    grams = ["|".join(stems[i : i + GRAM]) for i in range(len(stems) - GRAM + 1)]
    marks = "".join("o" if g in seen else "n" for g in grams)
    share = marks.count("o") / len(marks) if marks else 0.0
    if share <= 0.2:
        return "emit", 0
    cut = marks.find("n" * MISSES)
    if cut >= OLD_WORDS:
        near = (p for off in range(6) for p in (cut - off, cut + off) if (p <= cut or p < len(words)) and _ends(words, p))
        snapped = next(near, cut)
        return "trim", snapped if snapped >= OLD_WORDS else cut
    if cut < 0 and share > 0.7:
        return "skip", len(words)
    return ("warn" if share > 0.3 else "emit"), 0


def remember_grams(words: Sequence[str], seen: dict, cap: int = 500) -> None:
    """Add a text's n-grams to the ``cap`` newest ones, oldest first out; one seen again keeps its place."""
    stems = list(map(stem, words))
    for i in range(len(stems) - GRAM + 1):
        seen.setdefault("|".join(stems[i : i + GRAM]))
    for old in list(islice(seen, max(0, len(seen) - cap))):
        del seen[old]


def overlap_verdict(words: Sequence[str], bags: Sequence[frozenset], tau: float = 0.5, least_new: int = 5) -> tuple[str, int]:
    """(action, words to cut) against the content stems of the texts before: above ``tau`` the new tail is all that goes on."""
    own = set(content(words))
    best = max((len(own & b) / len(own | b) for b in bags if own or b), default=0.0)
    if best <= tau:
        return "emit", 0
    old = frozenset().union(*bags[-2:])
    start = 1 + max((i for i, w in enumerate(words) if (s := content([w])) and s[0] in old), default=-1)
    if len(words) - start < least_new:
        return "skip", len(words)
    return "trim", next((p for p in range(start, start - 4, -1) if _ends(words, p)), start)


def tail_overlap(words: Sequence[str], tail: Sequence[str], least: int = 4) -> int:
    """Words at a text's head whose stems stand in a row somewhere in ``tail`` (0: fewer than ``least``)."""
    stems, last = list(map(stem, words)), list(map(stem, tail))
    if min(len(stems), len(last)) < least:
        return 0
    most = next((i for i, s in enumerate(stems) if not s), len(stems))
    for n in range(min(most, len(last)), least - 1, -1):
        if any(last[i : i + n] == stems[:n] for i in range(len(last) - n + 1)):
            return n
    return 0


def without_echoes(words: Sequence[str], n: int = GRAM) -> list[str]:
    """Words without later copies of runs of ``n`` stems or more, at least twice that far behind the first."""
    stems, first, out, i = list(map(stem, words)), {}, [], 0
    while i < len(words):
        end = i
        if i + n <= len(words):
            at = first.setdefault("|".join(stems[i : i + n]), i)
            if i - at >= 2 * n:
                end = i + n
                while end < len(words) and stems[end] == stems[at + end - i]:
                    end += 1
        if end == i:
            out.append(words[i])
            end += 1
        i = end
    return out


def echoes_cut(text: str) -> str:
    """The text without its echoes; as it is where it has none, is short, or over 70% of it would go."""
    words = text.split()
    kept = " ".join(without_echoes(words)) if len(words) >= 2 * GRAM else text
    return text if len(kept) < len(text) * 0.3 or len(kept.split()) == len(words) else kept


def echo_trim(df: DataFrame, key: Sequence[str], text_col: str = "text") -> DataFrame:
    """``key, kept, n_words, n_cut`` of every text, row by row where it lies.  Null and empty texts come back as they are."""
    key = list(key)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            kept = [None if t is None else echoes_cut(t) for t in f["text_"]]
            n = [len((t or "").split()) for t in f["text_"]]
            out = pd.DataFrame({"kept": kept, "n_words": n, "n_cut": [m - len((k or "").split()) for m, k in zip(n, kept, strict=True)]})
            yield pd.concat([f[key].reset_index(drop=True), out], axis=1)

    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in key)
    return df.select(*key, df[text_col].cast("string").alias("text_")).mapInPandas(run, f"{schema}, kept string, n_words long, n_cut long")


def gate(text: str) -> str | None:
    """Why a text goes no further: few letters, or a short piece without a sentence end."""
    solid = re.sub(r"\s", "", text)
    if len(solid) > 10 and len(re.findall("[a-zA-ZäöüÄÖÜß]", text)) < 0.4 * len(solid):
        return "letters"
    return "fragment" if len(text.strip()) < 50 and not _ENDED.search(text.strip()) else None


@dataclass(frozen=True)
class Chain:
    """What the chain does; the values given are the fixed defaults."""

    hold_words: int = 0  # last words held back for the next text
    similar: float = 0.70  # cosine with the last kept text above which, with few shared words, a text is a correction
    shared_words: float = 0.50
    tail: int = 20
    cap: int = 500
    bags: int = 3
    units: Limits = field(default_factory=Limits)


class _Pass:
    """One text on its way through the chain."""

    def __init__(self, text: str, state: State, chain: Chain, vec) -> None:
        self.text, self.state, self.chain, self.vec = text, state, chain, vec
        self.actions: dict[str, str] = {}
        self.trims: list[str] = []

    def becomes(self, stage: str, text: str) -> bool:
        """Go on with ``text``; is there enough of it?"""
        if stage in ("overlap", "echo", "units") and text != self.text:
            self.trims.append(f"{stage}:{len(self.text.split())}>{len(text.split())}")
        self.text = text
        return len(text.strip()) >= 3

    def gates(self) -> str | None:
        why = gate(self.text)
        self.actions |= {"letters": "reject"} if why == "letters" else {"letters": "pass", "fragment": "hold" if why else "pass"}
        return why

    def history(self) -> str | None:
        words, seen = self.text.split(), self.state.setdefault("seen", {})
        action, cut = history_verdict(words, seen) if len(words) >= GRAM else ("emit", 0)
        remember_grams(words, seen, self.chain.cap)
        rest = " ".join(words[cut:]) if cut else self.text
        self.actions["history"] = "skip" if action == "trim" and len(rest) < 3 else action
        return None if self.becomes("history", rest) else "history"

    def hold(self) -> str | None:
        if not self.chain.hold_words:
            return None
        words = (self.state.pop("held", []) + self.text.split())
        keep = max(0, len(words) - self.chain.hold_words)
        self.state["held"] = words[keep:]
        self.actions["hold"] = "emit" if keep else "hold"
        self.text = " ".join(words[:keep])
        return None if keep else "hold"

    def meaning(self) -> str | None:
        if self.vec is None:
            return None
        words, last = set(re.findall(r"[a-z0-9_]+", self.text.lower())), self.state.get("kept")
        if last:
            both = len(words | last["words"])
            shared = len(words & last["words"]) / both if both else 0.0
            if _cosine(last["vec"], self.vec) >= self.chain.similar and shared < self.chain.shared_words:
                self.actions["meaning"] = "drop"
                return "meaning"
        self.state["kept"] = {"vec": self.vec, "words": words}
        self.actions["meaning"] = "translate"
        return None

    def overlap(self) -> str | None:
        words, bags = self.text.split(), self.state.setdefault("bags", [])
        stems = content(words)
        action, cut = "emit", 0
        if len(words) >= 6 and len(stems) >= 3:
            action, cut = overlap_verdict(words, bags) if bags else ("emit", 0)
            self.state["bags"] = [*bags, frozenset(stems)][-self.chain.bags :]
        self.actions["overlap"] = action
        rest = "" if action == "skip" else " ".join(words[cut:]) if action == "trim" else self.text
        if action == "skip":
            return "overlap"
        return None if self.becomes("overlap", rest) else "overlap"

    def tail(self) -> str | None:
        words = self.text.split()
        cut = tail_overlap(words, self.state.get("tail", []))
        self.actions["tail"] = "trim" if cut else "emit"
        return None if self.becomes("tail", " ".join(words[cut:]) if cut else self.text) else "tail"

    def echo(self) -> str | None:
        kept = echoes_cut(self.text)
        self.actions["echo"] = "emit" if kept == self.text else "trim"
        return None if self.becomes("echo", kept) else "echo"

    def units(self) -> str | None:
        got = clean_units(self.text, self.chain.units)
        self.actions["units"] = got["action"]
        if got["action"] == "trim":
            self.becomes("units", got["cleaned"])
        return None


#: The stages in order.
STAGES = ("gates", "history", "hold", "meaning", "overlap", "tail", "echo", "units")


def chain_step(chain: Chain = Chain()) -> Step:
    """One text of a stream through all stages: outcome, blocking stage, what each stage did, cuts in words, and the text that goes on.

    A text enters a stage's history when it reaches that stage, emitted or not (the tail is that of emitted texts only); a blocked text
    leaves the later stages untouched.  Null and empty texts are fragments.
    """

    def step(state: State, row: dict) -> tuple[State, dict]:
        text = row["text"] if isinstance(row["text"], str) else ""
        one = _Pass(text, state, chain, row.get("vec"))
        blocked = next((why for stage in STAGES if (why := getattr(one, stage)())), None)
        if blocked is None:
            state["tail"] = one.text.split()[-chain.tail :]
        return state, {
            "stream_id": row["stream_id"], "release_seq": row["release_seq"], "outcome": "blocked" if blocked else "emitted", "blocked_by": blocked,
            "actions": ",".join(f"{k}={v}" for k, v in one.actions.items()), "trims": ",".join(one.trims), "text": None if blocked else one.text,
        }

    return step


CHAIN_SCHEMA = "stream_id long, release_seq long, outcome string, blocked_by string, actions string, trims string, text string"


def tail_step(least: int = 4, tail: int = 20) -> Step:
    """The tail stage alone: words cut from each text's head; the tail is that of the trimmed output."""

    def step(state: State, row: dict) -> tuple[State, dict]:
        words = (row["text"] or "").split()
        cut = tail_overlap(words, state.get("tail", []), least)
        state = {"tail": words[cut:][-tail:]} if cut < len(words) else state
        return state, {"stream_id": row["stream_id"], "release_seq": row["release_seq"], "n_words": len(words), "trimmed": cut}

    return step
