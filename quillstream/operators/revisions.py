"""Revisions of a text stream: families of releases, overlaps at the boundary, and what committed audio proves."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .core import bucketed_overlap_join, islands
from .fold import State, Step
from .units import common_run

_WORD = re.compile(r"[^\W_]+")


# --- families --------------------------------------------------------------------------------------------------------------


def merged_ranges(spans: Sequence[dict]) -> list[tuple[str, int, int]]:
    """Union of touching spans (``space, start, end``), in order; none at all if one of them is no range."""
    rows = sorted((s["space"], s["start"], s["end"]) for s in spans) if all(s["space"] is not None and s["start"] is not None and s["end"] is not None for s in spans) else []
    if any(start < 0 or end <= start for _, start, end in rows):
        return []
    out: list[tuple[str, int, int]] = []
    for space, start, end in rows:
        if out and out[-1][0] == space and start <= out[-1][2]:
            out[-1] = (space, out[-1][1], max(out[-1][2], end))
        else:
            out.append((space, start, end))
    return out


def _overlaps(families: list[dict], ranges: Sequence[tuple[str, int, int]]) -> np.ndarray:
    """Samples that each family shares with the ranges: all families' ranges as columns, one comparison per range."""
    owner = np.array([i for i, f in enumerate(families) for _ in f["ranges"]], dtype=np.int64)
    rows = [r for f in families for r in f["ranges"]]
    total = np.zeros(len(families), dtype=np.int64)
    if rows:
        spaces, starts, ends = np.array([r[0] for r in rows], dtype=object), np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        for space, start, end in ranges:
            shared = np.where(spaces == space, np.minimum(ends, end) - np.maximum(starts, start), 0)
            np.add.at(total, owner, np.maximum(shared, 0))
    return total


def _best(scores: np.ndarray, least: int) -> tuple[int | None, bool]:
    """(place of the only highest score of ``least`` or more, is it shared?)"""
    if not len(scores) or scores.max() < least:
        return None, False
    top = np.flatnonzero(scores == scores.max())
    return (None, True) if len(top) > 1 else (int(top[0]), False)


def family_step(window_ms: int = 180_000, most_families: int = 128, anchor: int = 4, most_words: int = 256, remembered: int = 512) -> Step:
    """Assign each release of a stream to the one family whose audio it overlaps most, else to the one it shares the longest word run with.

    A tie of the best families is ambiguous, and founds a family that isn't scorable.  A joined release is the family's next
    generation and replaces the one before.  Without overlap a run of ``anchor`` words joins, but is never eligible for action.  Families
    rest ``window_ms`` after their last release; of more than ``most_families`` the oldest go.  A release number seen again is its
    ``duplicate`` (same text and spans) or a conflict, a lower one stale; a new ``epoch`` starts a stream anew.  Null epochs and numbers are unscorable.
    """

    def step(state: State, row: dict) -> tuple[State, dict]:
        spans, words = row["spans"] if row["spans"] is not None else [], _WORD.findall((row["text"] or "").lower())[:most_words]
        out = {
            "stream_id": row["stream_id"], "release_seq": row["release_seq"], "family": None, "generation": None, "replaces": None,
            "eligible": False, "scorable": False, "overlap_samples": 0, "word_run": 0,
        }
        if row["epoch"] is None or row["release_seq"] is None:
            return state, out | {"evidence": "missing_identity"}
        if state.get("epoch") != row["epoch"]:
            state = {"epoch": row["epoch"], "families": [], "next": 1, "latest": None, "releases": {}}
        now, seq = row["ts_ms"], row["release_seq"]
        families = [f for f in state["families"] if f["at"] >= now - window_ms]
        families = sorted(families, key=lambda f: f["at"])[-most_families:]
        families.sort(key=lambda f: f["family"])
        print_ = (row["text"], tuple((s["space"], s["start"], s["end"]) for s in spans))
        if seq in state["releases"]:
            known, result = state["releases"][seq]
            return state | {"families": families}, result | {"evidence": "duplicate"} if known == print_ else out | {"evidence": "release_identity_conflict"}
        if state["latest"] is not None and seq < state["latest"]:
            return state | {"families": families}, out | {"evidence": "stale_release_seq"}
        ranges = merged_ranges(spans)
        complete = row["status"] == "complete"
        shared = _overlaps(families, ranges)
        place, tied = _best(shared, 1)
        if place is not None:
            out |= {"evidence": "span_overlap", "scorable": True, "eligible": complete and families[place]["complete"], "overlap_samples": int(shared[place])}
        elif tied:
            out["evidence"] = "ambiguous_span_families"
        else:
            runs = np.array([common_run(f["words"], words) for f in families])
            place, tied = _best(runs, anchor)
            if place is not None:
                apart = bool(families[place]["ranges"] and ranges)
                out |= {"evidence": "lexical_disjoint_span" if apart else "lexical", "scorable": True, "word_run": int(runs[place])}
            elif tied:
                out["evidence"] = "ambiguous_lexical_families"
            else:
                out |= {"evidence": "new_span_family" if ranges else "new_unproven_family", "scorable": bool(ranges) or len(words) >= anchor, "eligible": complete and bool(ranges)}
        if place is None:
            families.append({"family": state["next"], "generation": 0})
            state, place = state | {"next": state["next"] + 1}, -1
        own = families[place]
        out |= {"family": own["family"], "generation": own["generation"] + 1, "replaces": own["generation"] or None}
        families[place] = {"family": own["family"], "generation": own["generation"] + 1, "ranges": ranges, "words": words, "complete": complete, "at": now}
        releases = state["releases"] | {seq: (print_, out)}
        for old in list(releases)[: len(releases) - remembered]:
            del releases[old]
        return state | {"families": families, "latest": seq, "releases": releases}, out

    return step


FAMILY_SCHEMA = (
    "stream_id long, release_seq long, evidence string, family long, generation long, replaces long, eligible boolean, scorable boolean, overlap_samples long, word_run long"
)


# --- boundaries ------------------------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)?")
_LEADING = re.compile(r"^[\s,;:.!?–—-]+")
#: Endings that long words lose before they are compared.
ENDINGS = re.compile("(owego|owej|ami|ach|ego|ymi|ing|tion|mente|ung|keit|heit|en|em|er|es|ie|y|i|a|o)$")


def _tokens(text: str) -> list[tuple[str, str, int]]:
    """(normal form, stem, end) of each word."""
    out = []
    for m in _TOKEN.finditer(text):
        name = "".join(c for c in unicodedata.normalize("NFKD", m.group().lower()) if not "̀" <= c <= "ͯ").strip("'’")
        if name:
            out.append((name, ENDINGS.sub("", name) if len(name) > 6 else name, m.end()))
    return out


def _rest(text: str, end: int) -> str:
    return _LEADING.sub("", text[end:]).strip()


def boundary_step(
    ttl_ms: int = 120_000, exact: tuple[int, int] = (2, 8), window: int = 14, rest: tuple[int, int] = (2, 8), least: int = 3, detect: float = 0.72,
    apply_ratio: float = 0.8, long_ratio: float = 0.7, long_words: int = 5, lexical: float = 0.6, make_exact: bool = True, make_stemmed: bool = True,
) -> Step:
    """Cut from each text the head that repeats the tail of the text given before it, at most ``ttl_ms`` ago.

    The longest head of ``exact`` many words that equals the tail goes, if ``rest`` (words, characters) of the text is left.  Else the
    stems of the head's content words are compared with those of the last ``window``: the longest head with a share of ``detect`` in them
    is cut behind its last shared word where the share is ``apply_ratio``, or behind its leading shared run of ``long_words`` where it is ``long_ratio``; always
    only if a ``lexical`` share of its words stands there as it is.  What isn't made is reported as ``would_``.  The tail is that of the
    trimmed text.  Texts without words change nothing.
    """

    def step(state: State, row: dict) -> tuple[State, dict]:
        text = row["text"] or ""
        tokens, given, action, cut, ratio = _tokens(text), text, "emit", 0, None
        enough = lambda s: len(s) >= rest[1] and len(_tokens(s)) >= rest[0]
        tail = state.get("tail", []) if state and row["ts_ms"] - state["at"] <= ttl_ms else []
        if tokens and tail:
            most = min(exact[1], len(tail), len(tokens))
            same = next((n for n in range(most, exact[0] - 1, -1) if [t[0] for t in tail[-n:]] == [t[0] for t in tokens[:n]]), 0)
            if same:
                cut, safe = same, enough(text[tokens[same - 1][2] :].strip())
                made = make_exact and safe
                action = "exact_trim" if made else "would_exact_trim" if safe else "protected_full_overlap"
            else:
                made, action, cut, ratio = _stemmed(text, tokens, tail, enough)
            if made:
                given = _rest(text, tokens[cut - 1][2])
        if tokens:
            state = {"tail": _tokens(given)[-window:], "at": row["ts_ms"]}
        return state, {"stream_id": row["stream_id"], "lang": row.get("lang"), "release_seq": row["release_seq"], "action": action, "overlap": cut, "ratio": ratio, "text": given}

    def _stemmed(text, tokens, tail, enough):
        keys, names = {t[1] for t in tail if len(t[1]) > 2}, {t[0] for t in tail}
        head = [(i, t) for i, t in enumerate(tokens) if len(t[1]) > 2][:window]
        found = None
        for n in range(least, len(head) + 1) if len(keys) >= least else ():
            own = {t[1] for _, t in head[:n]}
            if len(own & keys) >= least and len(own & keys) / len(own) >= detect:
                found = n
        if found is None:
            return False, "emit", 0, None
        span = head[:found]
        own, words = {t[1] for _, t in span}, {t[0] for _, t in span}
        ratio = len(own & keys) / len(own)
        lead = next((i for i, (_, t) in enumerate(head) if t[1] not in keys), len(head))
        last = max(i for i, t in span if t[1] in keys)
        at = last if ratio >= apply_ratio else head[lead - 1][0] if lead >= long_words and ratio >= long_ratio else None
        made = make_stemmed and at is not None and len(words & names) / len(words) >= lexical and enough(_rest(text, tokens[at][2]))
        return made, "stemmed_trim" if made else "would_stemmed_trim", 0 if at is None else at + 1, round(ratio, 4)

    return step


BOUNDARY_SCHEMA = "stream_id long, lang string, release_seq long, action string, overlap long, ratio double, text string"


# --- committed prefixes ----------------------------------------------------------------------------------------------------


def committed_prefix_plan(
    words: DataFrame, ranges: DataFrame, boundaries: DataFrame, unit: list[str], *, least_removed: int = 3, bridge: int = 2, width: int = 2048,
) -> DataFrame:
    """What to do with each source unit whose audio was partly committed before: ``suppress``, ``resegment`` at a safe word, or nothing.

    ``words``: ``unit`` columns, ``word`` (gapless from 0), ``space, start, end``.  ``ranges``: committed ``space, start, end`` with their
    ``release`` and ``committed_at``.  ``boundaries``: ``unit`` columns and ``boundary``, a number of words after which a cut is safe.
    A word is covered by one range that holds all of it.  Proofs count in the order of their commits: the frontier
    grows by words that a proof covers from there on, so a later proof can't fill a gap behind an earlier one.  The topology of all coverage
    decides: all words in order are ``full``, a prefix without islands ``proved_prefix``; anything else stays.  A prefix is cut at the last boundary up to
    ``bridge`` words before the frontier that removes ``least_removed`` words or more.

    Words meet ranges by an equality on buckets (an interval join), coverage becomes runs per unit and proof, and the frontier walks a unit's
    proofs in the row; nothing larger than a unit is in one place.  Units without ranges or boundaries have rows; a word without a proper
    span makes its unit ``source_not_provable``; ranges that are none are left out; an empty table gives no rows.
    """
    sized = words.groupBy(*unit).agg(F.count("*").alias("n_words"), F.count_if(F.coalesce(F.col("end") > F.col("start"), F.lit(False)) & F.col("space").isNotNull()).alias("sound_"))
    a = words.select("space", F.struct(*unit, "word").alias("a_id"), F.col("start").alias("a_start"), F.col("end").alias("a_end"))
    b = ranges.select("space", F.struct("committed_at", "release").alias("b_id"), F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    met = bucketed_overlap_join(a, b, ["space"], width).select(
        "a_id.*", F.col("b_id").alias("proof"), ((F.col("b_start") <= F.col("a_start")) & (F.col("b_end") >= F.col("a_end"))).alias("whole"),
    )
    by_word = met.groupBy(*unit, "word").agg(F.max("whole").alias("whole"))
    cover = by_word.groupBy(*unit).agg(
        F.count_if("whole").alias("covered"), F.count_if(~F.col("whole")).alias("touched"), F.min(F.when(F.col("whole"), F.col("word"))).alias("first"),
        F.array_sort(F.collect_set(F.when(F.col("whole"), F.col("word")))).alias("in_"),
    )
    # runs of words that one proof covers
    each = met.where("whole").select(*unit, "proof", "word").distinct()
    marked = each.withColumn("new_", F.col("word") - F.coalesce(F.lag("word").over(Window.partitionBy(*unit, "proof").orderBy("word")), F.lit(-2)) > 1)
    runs = islands(marked, [*unit, "proof"], ["word"], F.col("new_")).groupBy(*unit, "proof", "island").agg(F.min("word").alias("from_"), (F.max("word") + 1).alias("to_"))
    proofs = runs.groupBy(*unit, "proof").agg(F.collect_list(F.struct("from_", "to_")).alias("runs_")).groupBy(*unit).agg(F.array_sort(F.collect_list(F.struct("proof", "runs_"))).alias("proofs_"))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("by"))

    def grown(acc, p):
        to = F.array_max(F.transform(F.filter(p["runs_"], lambda r: (r["from_"] <= acc["at"]) & (r["to_"] > acc["at"])), lambda r: r["to_"])).cast("long")
        return F.when(to.isNull(), acc).otherwise(F.struct(to.alias("at"), F.concat(acc["by"], F.array(p["proof"]["release"].cast("long"))).alias("by")))

    walked = proofs.select(*unit, F.aggregate("proofs_", zero, grown).alias("walk_"))
    safe = boundaries.groupBy(*unit).agg(F.array_sort(F.collect_set("boundary")).alias("safe_"))
    x = sized.join(cover, unit, "left").join(walked, unit, "left").join(safe, unit, "left")
    n, covered, at = F.col("n_words"), F.coalesce("covered", F.lit(0)), F.coalesce(F.col("walk_.at"), F.lit(0))
    # the leading words of the sorted covered ones are those that equal their place
    prefix = F.coalesce(F.size(F.filter("in_", lambda w, i: w == i)), F.lit(0))
    topology = (
        F.when(covered == 0, F.when(F.coalesce("touched", F.lit(0)) > 0, "boundary_overlap_only").otherwise("none"))
        .when(covered == n, F.when(at == n, "full").otherwise("fragmented"))
        .when((prefix > 0) & (covered == prefix) & (at == prefix), "proved_prefix")
        .when(prefix == 0, F.when(covered == n - F.col("first"), "suffix").otherwise("committed_infix")).otherwise("fragmented")
    )
    x = x.withColumn("topology", F.when(F.col("sound_") < n, "source_not_provable").otherwise(topology)).withColumn("frontier", at)
    cut = F.array_max(F.filter("safe_", lambda s: (s > 0) & (s < n) & (s <= F.col("frontier")) & (F.col("frontier") - s <= bridge) & (s >= least_removed)))
    cut = F.when(F.col("topology") == "full", n).when(F.col("topology") == "proved_prefix", F.coalesce(cut, F.lit(0))).otherwise(0)
    reason = (
        F.when(F.col("topology") == "full", "source_fully_committed").when(F.col("topology") != "proved_prefix", F.col("topology"))
        .when(F.col("cut") > 0, "proved_prefix_safe_boundary").when(F.col("frontier") < least_removed, "below_benefit").otherwise("no_safe_boundary")
    )
    action = F.when(F.col("topology") == "full", "suppress").when(F.col("cut") > 0, "resegment").otherwise("unchanged")
    return x.withColumn("cut", cut).select(
        *unit, "n_words", "topology", "frontier", covered.alias("committed_words"), F.array_join(F.coalesce("walk_.by", F.array().cast("array<bigint>")), ",").alias("releases"),
        action.alias("action"), reason.alias("reason"), F.col("cut").cast("long").alias("safe_word"),
        F.when(action == "resegment", F.col("frontier") - F.col("cut")).otherwise(0).cast("long").alias("bridge"),
    )


# --- playout ---------------------------------------------------------------------------------------------------------------

#: Outcomes that end a chunk unheard, and those that change nothing.
DROPS, NOTICES = ("explicit_drop", "superseded", "null_audio", "playback_error"), ("chunk_received", "supersession_shadow")


def playout_end(ttl_ms: int = 6 * 3_600_000):
    """When a listener's ledger is over: ``ttl_ms`` after its last change."""

    def end(state: State) -> int | None:
        return state["touched"] + ttl_ms if state else None

    return end


def playout_step(ttl_ms: int = 6 * 3_600_000) -> Step:
    """Broadcasts and outcomes of a listener in the order in which they arrive: is each accepted, a duplicate, worth sending again, or why not?

    A chunk's first broadcast counts; the same again is a duplicate, another ``payload`` under its key a conflict, after which no
    outcome of the chunk is accepted.  An outcome id seen before is a duplicate, or a conflict if it says something else.  An
    outcome before its broadcast is ``retryable``.  A start after a drop, a completion without a start, another epoch and an unknown outcome are refused, and
    leave the chunk and the id untouched.  ``started``, ``completed`` and ``dropped`` are the chunk's state after the row.  Entries rest
    ``ttl_ms`` after their last change.  Rows without a chunk, and outcomes without an id, are invalid.
    """

    def step(state: State, row: dict) -> tuple[State, dict]:
        ts, chunk, kind = row["ts_ms"], row["chunk_key"], row["kind"]
        chunks = {k: c for k, c in state.get("chunks", {}).items() if c["at"] >= ts - ttl_ms}
        seen = {k: o for k, o in state.get("seen", {}).items() if o[1] >= ts - ttl_ms}
        entry = chunks.get(chunk)
        accepted, duplicate, retryable, reason = False, False, False, None
        if chunk is None or kind == "outcome" and row["outcome_id"] is None:
            reason = "invalid_identity"
        elif kind == "broadcast":
            if entry is None:
                accepted, chunks[chunk] = True, {"print": (row["payload"], row["epoch"]), "epoch": row["epoch"], "started": False, "completed": False, "dropped": False, "conflicted": False, "at": ts}
            elif entry["print"] == (row["payload"], row["epoch"]):
                accepted = duplicate = True
            else:
                reason, chunks[chunk] = "broadcast_fingerprint_conflict", entry | {"conflicted": True, "at": ts}
        else:
            said = (chunk, row["epoch"], row["outcome"], row["occurred_ms"], row["reason"])
            before, new = seen.get(row["outcome_id"]), dict(entry or {})
            if before is not None:
                accepted = duplicate = before[0] == said
                reason = None if duplicate else "outcome_id_conflict"
            elif entry is None:
                retryable, reason = True, "broadcast_not_observed"
            elif entry["epoch"] != row["epoch"]:
                reason = "epoch_mismatch"
            elif entry["conflicted"]:
                reason = "broadcast_conflicted"
            elif row["outcome"] == "play_started":
                reason = "start_after_terminal_drop" if entry["dropped"] and not entry["started"] else None
                new["started"] = True
            elif row["outcome"] == "play_completed":
                reason = None if entry["started"] else "completed_without_start"
                new["completed"] = True
            elif row["outcome"] in DROPS:
                new["dropped"] = True
            elif row["outcome"] not in NOTICES:
                reason = "unsupported_outcome"
            if before is None and entry is not None and reason is None:
                accepted, chunks[chunk], seen[row["outcome_id"]] = True, new | {"at": ts}, (said, ts)
        now = chunks.get(chunk) or {}
        flags = {f: bool(now.get(f)) for f in ("started", "completed", "dropped", "conflicted")}
        out = {"stream_id": row["stream_id"], "seq": row["seq"], "accepted": accepted, "duplicate": duplicate, "retryable": retryable, "reason": reason, **flags}
        return {"chunks": chunks, "seen": seen, "touched": ts}, out

    return step


PLAYOUT_SCHEMA = "stream_id long, seq long, accepted boolean, duplicate boolean, retryable boolean, reason string, started boolean, completed boolean, dropped boolean, conflicted boolean"
