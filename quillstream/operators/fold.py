"""Sequential operators: an ordered fold of each key, in batch.

A step function takes (state, row as dict) and returns (state, row to give, list of rows or None); the streaming form in
``quillstream.streaming.stateful`` calls the same step.  Rows are dealt by key and sorted within partitions, and the fold
reads them as a stream, so a task holds one batch and one key's state, however long the key.  A key itself can't be
split: an accepted row changes what later rows meet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

State = dict
Step = Callable[[State, dict], tuple[State, dict | list[dict] | None]]
#: Rows to give when a key's state ends: at the end of its rows, or when its time is over.
AtEnd = Callable[[State], list[dict]]


def values_of(got: dict | list[dict] | None, names: Sequence[str]) -> list[list]:
    """A step's result as rows of values."""
    return [[r.get(n) for n in names] for r in ([] if got is None else got if isinstance(got, list) else [got])]


def whole_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if f.dataType.typeName() in ("byte", "short", "integer", "long")]


def records(frame: pd.DataFrame, whole: Sequence[str]) -> list[dict]:
    """Rows as dicts; whole numbers stay whole (and null None) beside nulls, which pandas reads as floats."""
    for c in whole:
        if frame[c].dtype.kind == "f":
            frame[c] = pd.Series([None if v != v else int(v) for v in frame[c]], index=frame.index, dtype=object)
    return frame.to_dict("records")


def ordered_fold(df: DataFrame, by: Sequence[str], order: Sequence[str], step: Step, schema: str, at_end: AtEnd | None = None) -> DataFrame:
    """Results of ``step`` over each key's rows in order, then of ``at_end``; the state of a key starts empty."""
    by, whole = list(by), whole_columns(df)
    names = [part.split()[0] for part in schema.split(",")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, {}
        for frame in frames:
            out = []
            for row in records(frame, whole):
                own = tuple(None if v is None or v != v else v for v in (row[c] for c in by))
                if own != key:
                    if at_end and state:
                        out += values_of(at_end(state), names)
                    key, state = own, {}
                state, got = step(state, row)
                out += values_of(got, names)
            if out:
                yield pd.DataFrame(out, columns=names)
        if at_end and state and (out := values_of(at_end(state), names)):
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInPandas(run, schema)


def limit_step(most: int = 500, window_ms: int = 60_000) -> Step:
    """Fixed window from a key's first event after the last reset: allowed, warned once above ``most``, closed above twice that."""

    def step(state: State, row: dict) -> tuple[State, dict]:
        if not state or row["ts_ms"] > state["reset"]:
            state = {"count": 0, "reset": row["ts_ms"] + window_ms, "warned": False}
        state["count"] += 1
        allowed = state["count"] <= most
        warn = not allowed and not state["warned"]
        state["warned"] = state["warned"] or warn
        return state, {"stream_id": row["stream_id"], "seq": row["seq"], "allowed": allowed, "warn": warn, "close": state["count"] > 2 * most}

    return step


LIMIT_SCHEMA = "stream_id long, seq long, allowed boolean, warn boolean, close boolean"


def _cosine(a: np.ndarray, b: np.ndarray) -> float:
    size = float(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))
    return float((a * b).sum()) / size if size else 0.0


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def predecessor_step(similar: float = 0.70, most_words: float = 0.50) -> Step:
    """Drop a unit close in meaning (cosine) but not in words (Jaccard) to the last kept unit; only a kept unit replaces it."""

    def step(state: State, row: dict) -> tuple[State, dict]:
        vec, words = np.asarray(row["vec"], dtype=float), set(str(row["text"]).lower().split())
        action, cosine = "translate", None
        if state:
            cosine = round(_cosine(state["vec"], vec), 6)
            if cosine >= similar and _jaccard(state["words"], words) < most_words:
                action = "drop"
        if action != "drop":
            state = {"vec": vec, "words": words}
        return state, {"stream_id": row["stream_id"], "seq": row["seq"], "action": action, "cosine": cosine}

    return step


PREDECESSOR_SCHEMA = "stream_id long, seq long, action string, cosine double"


def history_step(k: int = 5, paraphrase: float = 0.45, overlap: float = 0.85, short: int = 30) -> Step:
    """Two verdicts on a text against the ``k`` emitted texts before it: by exact or Jaccard match, and by overlap of its words.

    Texts under 10 characters always go out; short ones are only compared as a whole; history holds what the first verdict emits.
    """

    def step(state: State, row: dict) -> tuple[State, dict]:
        text = str(row["text"] or "")
        words = [w for w in "".join(c.lower() if c.isalnum() else " " for c in text).split() if len(w) > 2]
        bag, history = set(words), state.get("history", [])
        legacy = v2 = "emit"
        if len(text) >= 10:
            if any(h["exact"] == text.strip().lower() for h in history):
                legacy = v2 = "exact"
            elif len(text) < short:
                legacy = v2 = "short_repeat" if any(h["words"] == words for h in history) else "emit"
            elif len(bag) >= 3 and history:
                best = max(history, key=lambda h: _jaccard(bag, h["bag"]))
                legacy = "paraphrase" if _jaccard(bag, best["bag"]) > paraphrase else "emit"
                v2 = "near" if len(bag & best["bag"]) / len(bag) >= overlap else "emit"
        if legacy == "emit":
            history = [*history, {"exact": text.strip().lower(), "words": words, "bag": bag}][-k:]
        return {"history": history}, {"stream_id": row["stream_id"], "release_seq": row["release_seq"], "legacy": legacy, "overlap": v2}

    return step


HISTORY_SCHEMA = "stream_id long, release_seq long, legacy string, overlap string"


def playback_rate_step(cap: float = 1.2) -> Step:
    """Playback rate from queue depth and age; a lower rate is only taken once both lie a margin below the level's threshold."""

    def step(state: State, row: dict) -> tuple[State, dict]:
        depth, age, before = max(0, row["queue_depth"]), max(0.0, row["age_ms"]), state.get("rate", 1.0)
        levels = ((cap, depth > 6 or age > 10_000, depth > 5 or age > 9_000), (1.15, depth >= 4 or age >= 6_000, depth >= 3 or age >= 5_000), (1.08, depth >= 2 or age >= 3_000, depth >= 1 or age >= 2_000))
        rate = next((r for r, on, _ in levels if on), 1.0)
        if rate < before:
            rate = next((r for r, _, still in levels if before >= r and still), rate)
        return {"rate": rate}, {"stream_id": row["stream_id"], "seq": row["seq"], "rate": rate}

    return step


RATE_SCHEMA = "stream_id long, seq long, rate double"


def recovery_step(first_ms: int = 60_000, most_ms: int = 600_000, successes: int = 2) -> Step:
    """Mode of each key: full until a block, then source only with a doubling wait, and a half-open probe after enough successes."""

    def step(state: State, row: dict) -> tuple[State, dict]:
        ready = state and state["good"] >= successes and row["ts_ms"] >= state["probe_at"]
        mode = "full" if not state else "half_open" if ready else "source_only"
        if row["blocked"]:
            wait = min(most_ms, max(first_ms, state["wait"] * 2)) if state else first_ms
            state = {"wait": wait, "probe_at": row["ts_ms"] + wait, "good": 0}
        elif mode == "half_open":
            state = {}
        elif state:
            state = state | {"good": state["good"] + 1}
        return state, {"stream_id": row["stream_id"], "lang": row.get("lang"), "seq": row["seq"], "mode": mode}

    return step


RECOVERY_SCHEMA = "stream_id long, lang string, seq long, mode string"


def utterance_step(silence: int = 500, most: int = 30_000) -> Step:
    """Speech runs closed by ``silence`` ms without speech, or at ``most`` ms of speech; a row per closed run."""

    def step(state: State, row: dict) -> tuple[State, dict | None]:
        state = dict(state) or {"on": False, "quiet": 0, "speech": 0, "start": 0}
        if row["speech"]:
            if not state["on"]:
                state |= {"on": True, "start": row["ts_ms"], "speech": 0}
            state |= {"quiet": 0, "speech": state["speech"] + row["ms"]}
            closed = state["speech"] >= most
        else:
            state["quiet"] += row["ms"] if state["on"] else 0
            closed = state["on"] and state["quiet"] >= silence
        if not closed:
            return state, None
        return {"on": False, "quiet": 0, "speech": 0, "start": 0}, {"stream_id": row["stream_id"], "start_ms": state["start"], "end_ms": row["ts_ms"] + row["ms"], "speech_ms": state["speech"]}

    return step


UTTERANCE_SCHEMA = "stream_id long, start_ms long, end_ms long, speech_ms long"


def ewma_step(alpha: float = 0.1) -> Step:
    """Noise floor as a moving average that only rows without speech change."""

    def step(state: State, row: dict) -> tuple[State, dict]:
        floor = state.get("floor")
        if not row["speech"]:
            floor = row["level"] if floor is None else (1 - alpha) * floor + alpha * row["level"]
        return {"floor": floor}, {"stream_id": row["stream_id"], "seq": row["seq"], "floor": floor}

    return step


EWMA_SCHEMA = "stream_id long, seq long, floor double"


def sentence_step(sentences: int = 2, chars: int = 50, early_ms: int = 7_000, timeout_ms: int = 10_000) -> Step:
    """Accumulated texts are released at enough sentences and characters, early with one sentence, or at the timeout."""

    def step(state: State, row: dict) -> tuple[State, dict | None]:
        text = " ".join(x for x in (state.get("text", ""), str(row["text"] or "").strip()) if x)
        since = state.get("since", row["ts_ms"])
        ends, waited = sum(text.count(c) for c in ".!?"), row["ts_ms"] - since
        reason = "sentences" if ends >= sentences and len(text) >= chars else "early" if ends and waited >= early_ms else "timeout" if waited >= timeout_ms else None
        if reason is None or not text:
            return {"text": text, "since": since}, None
        return {}, {"stream_id": row["stream_id"], "release_seq": row["release_seq"], "reason": reason, "chars": len(text)}

    return step


SENTENCE_SCHEMA = "stream_id long, release_seq long, reason string, chars long"


TAIL_SCHEMA = "stream_id long, release_seq long, n_words long, trimmed long"
