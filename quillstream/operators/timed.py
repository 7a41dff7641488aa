"""Ordered operators whose state ends by time: words by their place in the audio, agreement of passes, fallback windows."""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections.abc import Sequence

import numpy as np

from .fold import AtEnd, State, Step

_ENDS = (".", "!", "?")
_EDGES = ".,!?;:"


# --- words by time ---------------------------------------------------------------------------------------------------------


class Heard:
    """Confirmed words as intervals of absolute seconds, in the order in which they were first heard."""

    def __init__(self, words: Sequence[tuple[str, float, float]] = ()) -> None:
        self.names = [w.lower().strip(_EDGES) for w, _, _ in words]
        self.spans = np.array([(s, e) for _, s, e in words], dtype=float).reshape(-1, 2)

    def meet(self, word: str, start: float, end: float, tolerance: float, same_audio: float) -> str:
        """``new``, ``duplicate`` (same text over more than ``tolerance`` of its length) or ``replaced`` (other text over ``same_audio``)."""
        name, what = word.lower().strip(_EDGES), "new"
        if end > start and len(self.names):
            share = (np.minimum(self.spans[:, 1], end) - np.maximum(self.spans[:, 0], start)) / (end - start)
            for i in np.flatnonzero(share > tolerance):
                if self.names[i] == name:
                    return "duplicate"
                if share[i] > same_audio:
                    self.names[i], self.spans[i] = name, (start, end)
                    return "replaced"
        self.names.append(name)
        self.spans = np.vstack((self.spans, [(start, end)]))
        return what

    def forget(self, before: float) -> None:
        """Drop what ended by then."""
        kept = self.spans[:, 1] > before
        self.names = [n for n, k in zip(self.names, kept, strict=True) if k]
        self.spans = self.spans[kept]


def _samples(start: float, end: float, offset: float, rate: int) -> tuple[int, int] | None:
    """Absolute half-open samples of relative seconds; None where they prove nothing."""
    if not (math.isfinite(start) and math.isfinite(end)) or start < 0 or end <= start:
        return None
    origin = round(offset * rate)
    span = origin + round(start * rate), origin + round(end * rate)
    return span if span[1] > span[0] else None


def word_time_step(tolerance: float = 0.1, same_audio: float = 0.8, least_words: int = 2, most_words: int = 80, keep_s: float = 60.0, rate: int = 16_000) -> Step:
    """One pass of timed words over a growing buffer: the words that no earlier pass has given.

    A word is a duplicate where a heard word with its text overlaps more than ``tolerance`` of its length; another text over more than
    ``same_audio`` is the same audio heard better, and replaces it without being given.  New words wait until there are
    ``least_words`` or a sentence end; more than ``most_words`` at once are a re-transcription and go.  Words that ended ``keep_s``
    before the buffer's offset are forgotten.  ``provenance`` is complete if each word of the delta has a span and the spans don't go back.
    Words without text or with a null time are passed over; a pass without words gives a row without a delta.
    """

    def step(state: State, row: dict) -> tuple[State, dict]:
        heard = state.get("heard") or Heard()
        pending, counts = list(state.get("pending", [])), {"new": 0, "duplicate": 0, "replaced": 0}
        offset, words = float(row["offset_s"] or 0.0), row["words"] if row["words"] is not None else []
        for w in words:
            text, start, end = (w["text"] or "").strip(), w["start"], w["end"]
            if not text or start is None or end is None:
                continue
            what = heard.meet(text, offset + start, offset + end, tolerance, same_audio)
            counts[what] += 1
            if what == "new":
                pending.append((text, _samples(start, end, offset, rate)))
        if len(words) and offset > keep_s:
            heard.forget(offset - keep_s)
        out = {
            "stream_id": row["stream_id"], "pass": row["pass"], "status": "waiting", "delta": None, "n_words": len(pending), **counts,
            "start_sample": None, "end_sample": None, "provenance": None,
        }
        if len(words) and pending and (len(pending) >= least_words or pending[-1][0].endswith(_ENDS)):
            spans = [s for _, s in pending]
            if len(pending) > most_words:
                out["status"] = "rejected"
            else:
                out |= {"status": "emitted", "delta": " ".join(t for t, _ in pending)}
                if None in spans:
                    out["provenance"] = "invalid_timestamp"
                elif any(b[0] < a[0] for a, b in zip(spans, spans[1:], strict=False)):
                    out["provenance"] = "non_monotonic"
                else:
                    out |= {"provenance": "complete", "start_sample": spans[0][0], "end_sample": max(e for _, e in spans)}
            pending = []
        return {"heard": heard, "pending": pending, "at_ms": row.get("ts_ms")}, out

    return step


WORD_TIME_SCHEMA = (
    "stream_id long, pass long, status string, delta string, n_words long, new long, duplicate long, replaced long, start_sample long, end_sample long, provenance string"
)


# --- agreement of passes ---------------------------------------------------------------------------------------------------

#: What letters count as when words are compared.
ALIKE = {"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss", "é": "e", "è": "e", "ê": "e", "à": "a", "â": "a"}
_MARKS = re.compile("[.,!?;:'\"()\\-–—„“‚‘»«]")


def bare(word: str) -> str:
    """A word as it is compared: lower case, without marks, letters by ``ALIKE``."""
    return _MARKS.sub("", unicodedata.normalize("NFC", word).lower()).translate(str.maketrans(ALIKE)).strip()


def agree(words: Sequence[str], tau: float) -> bool:
    """Does every word match the first, exactly or by a ratio of ``tau`` or more?"""
    first = bare(words[0])
    return all((other := bare(w)) == first or difflib.SequenceMatcher(None, first, other).ratio() >= tau for w in words[1:])


def agreed_prefix(passes: Sequence[Sequence[str]], tau: float) -> list[str]:
    """Words on which all passes agree from the start, each in its most frequent form (ties: the oldest pass)."""
    out = []
    for words in zip(*passes, strict=False):
        if not agree(words, tau):
            break
        out.append(max(words, key=words.count))
    return out


def agreement_step(n: int = 2, tau: float = 0.75, sentence_words: int | None = None) -> Step:
    """Words confirmed by the last ``n`` passes; the confirmed text only grows in characters.

    With ``sentence_words``, a confirmed text of as many words that ends a sentence is given as ``sentence``, and the buffer
    starts anew.  ``tentative`` is what follows the confirmed text in the newest pass.  Null texts are empty passes.
    """

    def step(state: State, row: dict) -> tuple[State, dict]:
        text = unicodedata.normalize("NFC", row["text"] or "").strip()
        passes, confirmed = [*state.get("passes", []), text][-n:], state.get("confirmed", "")
        grown = False
        if len(passes) >= n:
            prefix = " ".join(agreed_prefix([p.split() for p in passes], tau))
            grown = len(prefix) > len(confirmed)
            confirmed = prefix if grown else confirmed
        if len(passes) < n or not confirmed:
            tentative = text
        elif text.startswith(confirmed):
            tentative = text[len(confirmed) :].strip()
        else:
            have, now = [bare(w) for w in confirmed.split()], text.split()
            same = next((i for i, (a, b) in enumerate(zip(have, now, strict=False)) if a != bare(b)), min(len(have), len(now)))
            tentative = " ".join(now[same:])
        sentence = None
        state = {"passes": passes, "confirmed": confirmed, "at_ms": row.get("ts_ms")}
        if sentence_words is not None and confirmed.endswith(_ENDS) and len(confirmed.split()) >= sentence_words:
            sentence, state = confirmed, {}
        return state, {"stream_id": row["stream_id"], "release_seq": row["release_seq"], "confirmed": confirmed, "tentative": tentative, "grown": grown or sentence is not None, "sentence": sentence}

    return step


AGREEMENT_SCHEMA = "stream_id long, release_seq long, confirmed string, tentative string, grown boolean, sentence string"


# --- fallback windows ------------------------------------------------------------------------------------------------------

#: Origins that compete for a window, and how many texts of the other origin wait in it.
ORIGINS, MOST_WAITING = ("partial_fallback", "deadline_fallback"), 4


def _window_row(state: State, ts: int, decision: str, row: dict | None = None, **more) -> dict:
    w = state["winner"]
    return {
        "stream_id": state["stream_id"], "seq": row["seq"] if row else None, "ts_ms": ts, "decision": decision, "winner_origin": w["origin"], "winner_release": w["release_seq"],
        "age_ms": ts - w["at"], "waiting": len(state["waiting"]), "overflow": state["overflow"], "candidates": None, **more,
    }


def _same_release(a: dict, b: dict) -> bool:
    return a["epoch"] is not None and a["release_seq"] is not None and (a["epoch"], a["release_seq"]) == (b["epoch"], b["release_seq"])


def window_end(keep_ms: int):
    """When a stream's window is given up: ``keep_ms`` after its end, if no broadcast has closed it."""

    def end(state: State) -> int | None:
        return state["winner"]["until"] + keep_ms if state.get("winner") else None

    return end


def window_at_end(keep_ms: int) -> AtEnd:
    def rows(state: State) -> list[dict]:
        end = window_end(keep_ms)(state)
        return [] if end is None else [_window_row(state, end, "expired")]

    return rows


def fallback_step(ttl_ms: int = 5_000, keep_ms: int = 60_000) -> Step:
    """Windows of competing fallback texts: rows of ``kind`` enqueue, commit, broadcast and cancel.

    The first text of a fallback origin arms a window of ``ttl_ms``.  Inside it the same origin changes nothing; a text of the other
    origin is to be evaluated again: at once if the winner's history is committed, else it waits (the last four) for the commit, which gives
    the waiting releases as ``candidates``.  The winner's first broadcast closes the window, a cancelled winner clears it, a cancelled waiter
    leaves it.  A window that nothing closes is given up ``keep_ms`` after its end (``expired``), by the next row or by a timer.
    Rows of other origins, and acknowledgements of other releases, give no row.
    """

    def step(state: State, row: dict) -> tuple[State, list[dict]]:
        out, ts = [], row["ts_ms"]
        end = window_end(keep_ms)(state)
        if end is not None and ts >= end:
            out, state = [_window_row(state, end, "expired")], {}
        winner, kind = state.get("winner"), row["kind"]
        if kind == "enqueue":
            if row["origin"] not in ORIGINS:
                return state, out
            mine = {"origin": row["origin"], "epoch": row["epoch"], "release_seq": row["release_seq"], "at": ts}
            if winner is None or ts >= winner["until"]:
                state = {"stream_id": row["stream_id"], "winner": mine | {"until": ts + ttl_ms, "committed": False}, "waiting": [], "overflow": 0}
                return state, [*out, _window_row(state, ts, "armed", row)]
            if winner["origin"] == mine["origin"]:
                return state, [*out, _window_row(state, ts, "same_origin", row)]
            if winner["committed"]:
                return state, [*out, _window_row(state, ts, "reevaluate_now", row, candidates=str(mine["release_seq"]))]
            full = len(state["waiting"]) >= MOST_WAITING
            state = state | {"waiting": [*state["waiting"], mine][-MOST_WAITING:], "overflow": state["overflow"] + full}
            return state, [*out, _window_row(state, ts, "reevaluate", row)]
        if winner is None:
            return state, out
        if kind == "cancel":
            state = {} if _same_release(winner, row) else state | {"waiting": [x for x in state["waiting"] if not _same_release(x, row)]}
        elif kind == "commit" and _same_release(winner, row) and not winner["committed"]:
            out.append(_window_row(state, ts, "committed", row, candidates=",".join(str(x["release_seq"]) for x in state["waiting"])))
            state = state | {"winner": winner | {"committed": True}, "waiting": [], "overflow": 0}
        elif kind == "broadcast" and _same_release(winner, row):
            out.append(_window_row(state, ts, "broadcast", row))
            state = {}
        return state, out

    return step


WINDOW_SCHEMA = "stream_id long, seq long, ts_ms long, decision string, winner_origin string, winner_release long, age_ms long, waiting long, overflow long, candidates string"


# --- provisional texts -----------------------------------------------------------------------------------------------------

#: Negations that make a short tail matter.
TURNS = frozenset("nicht kein keine keinen keinem keiner niemals nie nichts niemand ohne nein weder noch".split())
_WORD = re.compile(r"[^\W_]+")
_SAID = re.compile(r"\S+")


def _said(text: str) -> list[tuple[str, int]]:
    """(normal form, start) of each word that has letters or digits."""
    return [(name, m.start()) for m in _SAID.finditer(text) if (name := "".join(_WORD.findall(m.group().lower())))]


def supersede_end(ttl_ms: int = 25_000):
    def end(state: State) -> int | None:
        return max((e["at"] for e in state["ledger"]), default=0) + ttl_ms if state else None

    return end


def supersede_step(ttl_ms: int = 25_000, least: int = 3, cumulative: bool = False, least_tail: int | None = None) -> Step:
    """Rows of ``kind`` provisional and final in order: what becomes of each final, ``pass``, ``suppress`` or ``emit_tail``.

    The longest provisional text of the last ``ttl_ms`` that begins the final covers it, and is withdrawn: no later final meets it again.  A tail
    of fewer than ``least`` words is suppressed with it, a longer one is given alone, as it stands in the final.  With ``cumulative``
    all provisional words since the last final count as one text: a final inside it is suppressed, one that leaves it passes, a tail below
    ``least_tail`` words goes out all the same if it has digits or a negation; every final closes the text.  Words are compared in lower case by
    letters and digits.  Texts without words pass; provisional rows give no row.
    """
    floor = least if least_tail is None else least_tail

    def step(state: State, row: dict) -> tuple[State, dict | None]:
        text, now = row["text"] or "", row["ts_ms"]
        ledger = [e for e in state.get("ledger", []) if now - e["at"] <= ttl_ms]
        if row["kind"] == "provisional":
            words = _WORD.findall(text.lower())
            if cumulative and ledger and words:
                ledger = [{"words": ledger[0]["words"] + words, "at": now}]
            elif words:
                ledger = [*ledger, {"words": words, "at": now}]
            return ({"ledger": ledger} if ledger else {}), None
        words, said = _WORD.findall(text.lower()), _said(text)
        out = {"stream_id": row["stream_id"], "seq": row["seq"], "action": "pass", "covered": None, "tail_words": None, "text": text}
        covering = [e for e in ledger if words[: len(e["words"])] == e["words"]]
        best = max(covering, key=lambda e: len(e["words"]), default=None)
        if cumulative and words and ledger and ledger[0]["words"][: len(words)] == words:
            out |= {"action": "suppress", "covered": len(words), "tail_words": 0, "text": None}
        elif best is not None and words:
            covered = len(best["words"])
            tail, rest = len(words) - covered, text[said[covered][1] :].strip() if covered < len(said) else ""
            matters = cumulative and (any(c.isdigit() for c in rest) or not TURNS.isdisjoint(_WORD.findall(rest.lower())))
            gone = not rest or tail < (floor if cumulative else least) and not matters
            out |= {"action": "suppress" if gone else "emit_tail", "covered": covered, "tail_words": tail, "text": None if gone else rest}
            ledger = [e for e in ledger if e is not best]
        if cumulative:
            ledger = []
        return ({"ledger": ledger} if ledger else {}), out

    return step


SUPERSEDE_SCHEMA = "stream_id long, seq long, action string, covered long, tail_words long, text string"
