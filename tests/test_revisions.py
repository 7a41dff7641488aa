"""Families, boundaries and committed prefixes: stated cases and plain restatements."""

import random

import pytest

from quillstream.operators import fold, revisions


def play(step, rows):
    state, out = {}, []
    for row in rows:
        state, got = step(state, row)
        out.append(got)
    return state, out


def span(start, end, space="a"):
    return {"space": space, "start": start, "end": end}


def release(seq, text, spans, status="complete", ts=None, epoch="e"):
    return {"stream_id": 1, "release_seq": seq, "ts_ms": 10_000 if ts is None else ts, "text": text, "epoch": epoch, "status": status, "spans": spans}


def families(*rows, **kw):
    return play(revisions.family_step(**kw), rows)[1]


def test_overlapping_audio_joins_a_family():
    a, b = families(release(1, "Alpha beta gamma delta", [span(0, 1000)]), release(2, "Gamma delta epsilon zeta", [span(600, 1500)]))
    assert (a["family"], b["family"], a["generation"], b["generation"], b["replaces"]) == (1, 1, 1, 2, 1)
    assert (a["evidence"], b["evidence"], b["eligible"], b["overlap_samples"]) == ("new_span_family", "span_overlap", True, 400)
    a, b = families(release(1, "Alpha beta gamma delta", [span(0, 1000)]), release(2, "Epsilon zeta eta theta", [span(0, 1000, "b")]))
    assert (b["family"], b["evidence"], b["generation"]) == (2, "new_span_family", 1)
    assert families(release(1, "a", [span(0, 1000)], "partial"), release(2, "b", [span(0, 1000)]))[1]["eligible"] is False


def test_a_common_run_of_words_joins_but_is_not_eligible():
    a, b = families(release(1, "Heute alpha beta gamma delta endet hier", [span(0, 500)]), release(2, "Neu alpha beta gamma delta mit Fortsetzung", [span(2000, 2600)]))
    assert (b["family"], b["evidence"], b["eligible"], b["word_run"]) == (1, "lexical_disjoint_span", False, 4)
    a, b, c = families(release(1, "eins zwei drei", []), release(2, "eins zwei drei vier", []), release(3, "und eins zwei drei vier", []))
    assert [r["evidence"] for r in (a, b, c)] == ["new_unproven_family", "new_unproven_family", "lexical"]
    assert [r["scorable"] for r in (a, b, c)] == [False, True, True]


def test_ties_are_ambiguous_and_found_a_family():
    out = families(release(1, "a", [span(0, 100)]), release(2, "b", [span(200, 300)]), release(3, "c", [span(50, 100), span(200, 250)]))
    assert (out[2]["evidence"], out[2]["family"], out[2]["scorable"], out[2]["eligible"]) == ("ambiguous_span_families", 3, False, False)
    out = families(release(1, "x eins zwei drei vier", []), release(2, "z sieben acht neun zehn", []), release(3, "eins zwei drei vier und sieben acht neun zehn", []))
    assert (out[2]["evidence"], out[2]["family"]) == ("ambiguous_lexical_families", 3)


def test_release_numbers():
    one = release(5, "eins zwei drei vier", [span(0, 10)])
    out = families(one, one, one | {"text": "anders"}, release(4, "alt", []), release(None, "x", []), release(6, "x", [], epoch=None), release(1, "neu", [], epoch="f"))
    assert [r["evidence"] for r in out] == ["new_span_family", "duplicate", "release_identity_conflict", "stale_release_seq", "missing_identity", "missing_identity", "new_unproven_family"]
    assert out[1]["family"] == 1 and out[6]["family"] == 1


def test_families_rest_and_are_bounded():
    out = families(release(1, "a", [span(0, 10)], ts=0), release(2, "b", [span(0, 10)], ts=181_000), release(3, "c", [span(0, 10)], ts=361_000))
    assert [r["family"] for r in out] == [1, 2, 2]
    rows = [release(i, "a", [span(100 * i, 100 * i + 10)], ts=i) for i in range(6)] + [release(9, "a", [span(0, 10)], ts=10)]
    assert families(*rows, most_families=3)[-1]["evidence"] == "new_span_family"
    assert revisions.merged_ranges([span(5, 9), span(0, 5), span(20, 30), span(1, 2, "b")]) == [("a", 0, 9), ("a", 20, 30), ("b", 1, 2)]
    assert revisions.merged_ranges([span(5, 9), span(9, 9)]) == [] == revisions.merged_ranges([{"space": None, "start": 1, "end": 2}])


def test_families_against_sets_of_samples(spark):
    """Overlap counted sample by sample, runs by all substrings."""
    rng = random.Random(6)
    vocabulary, rows = [f"w{i}" for i in range(9)], []
    for stream in range(5):
        for seq in range(40):
            s = rng.randrange(0, 900)
            spans = [span(s + k * 40, s + k * 40 + rng.choice([10, 25, 60]), rng.choice("ab")) for k in range(rng.randrange(0, 3))]
            rows.append(release(seq, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 12))), spans, rng.choice(["complete", "partial"]), ts=seq * 9000) | {"stream_id": stream})
    schema = "stream_id long, release_seq long, ts_ms long, text string, epoch string, status string, spans array<struct<space string, start long, end long>>"
    df = spark.createDataFrame([{k: v for k, v in r.items()} for r in rows], schema)
    got = {(r.stream_id, r.release_seq): (r.family, r.generation, r.evidence, r.eligible) for r in fold.ordered_fold(df, ["stream_id"], ["release_seq"], revisions.family_step(), revisions.FAMILY_SCHEMA).collect()}
    want = {}
    for stream in range(5):
        known, n = [], 0
        for r in (r for r in rows if r["stream_id"] == stream):
            known = [f for f in known if f["at"] >= r["ts_ms"] - 180_000]
            samples = {(s["space"], i) for s in r["spans"] for i in range(s["start"], s["end"])}
            words = r["text"].split()
            runs = {tuple(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)}
            for scores, least, name in (
                ([len(f["samples"] & samples) for f in known], 1, "span"),
                ([max([len(x) for x in runs if x in f["runs"]], default=0) for f in known], 4, "lexical"),
            ):
                top = max(scores, default=0)
                if top >= least:
                    break
            complete, chosen = r["status"] == "complete", None
            if top < least:
                evidence, eligible = ("new_span_family" if samples else "new_unproven_family"), complete and bool(samples)
            elif scores.count(top) > 1:
                evidence, eligible = f"ambiguous_{name}_families", False
            else:
                chosen = known[scores.index(top)]
                evidence = "span_overlap" if name == "span" else "lexical_disjoint_span" if samples and chosen["samples"] else "lexical"
                eligible = name == "span" and complete and chosen["complete"]
            if chosen is None:
                n += 1
                chosen = {"id": n, "generation": 0}
                known.append(chosen)
            chosen |= {"generation": chosen["generation"] + 1, "samples": samples, "runs": runs, "complete": complete, "at": r["ts_ms"]}
            want[stream, r["release_seq"]] = (chosen["id"], chosen["generation"], evidence, eligible)
    assert got == want
    assert {e for _, _, e, _ in want.values()} >= {"span_overlap", "new_span_family", "new_unproven_family", "ambiguous_span_families"}


# --- boundaries ------------------------------------------------------------------------------------------------------------


def boundary(*texts, gap=1000, **kw):
    return play(revisions.boundary_step(**kw), [{"stream_id": 1, "lang": "x", "release_seq": i, "ts_ms": i * gap, "text": t} for i, t in enumerate(texts)])[1]


def test_exact_overlap_is_cut():
    out = boundary("To wszystko dzieje sie przez Jezusa Chrystusa.", "Jezusa Chrystusa widzimy teraz w tej historii.")
    assert (out[1]["action"], out[1]["text"], out[1]["overlap"]) == ("exact_trim", "widzimy teraz w tej historii.", 2)
    out = boundary("On jest dobry.", "jest dobry")
    assert (out[1]["action"], out[1]["text"]) == ("protected_full_overlap", "jest dobry")
    assert boundary("On jest dobry.", "jest dobry i wierny na wieki", gap=120_001)[1]["action"] == "emit"
    assert boundary("On jest dobry.", "jest dobry i wierny na wieki", gap=120_000)[1]["action"] == "exact_trim"
    assert boundary("a b c d", "c d e f g h i j", make_exact=False)[1]["action"] == "would_exact_trim"
    assert [r["action"] for r in boundary(None, "", "...", "eins zwei")] == ["emit"] * 4


def test_the_tail_is_that_of_the_trimmed_text():
    out = boundary("eins zwei drei vier", "drei vier fünf sechs sieben", "sechs sieben acht neun zehn elf")
    assert [r["text"] for r in out] == ["eins zwei drei vier", "fünf sechs sieben", "acht neun zehn elf"]


def test_stemmed_overlap_has_tiers():
    first, second = "Patience and composure are absolutely essential.", "Patience and composure are absolutely central, and I want to explain more."
    loose = {"detect": 0.6, "apply_ratio": 0.6, "lexical": 0.5, "least": 2}
    out = boundary(first, second, **loose)[1]
    assert (out["action"], out["text"]) == ("stemmed_trim", "I want to explain more.")  # behind the last shared word, the second "and"
    assert boundary(first, second, **(loose | {"lexical": 0.99}))[1]["action"] == "would_stemmed_trim"
    assert boundary(first, second, **loose, make_stemmed=False)[1]["text"] == second
    assert boundary("We receive grace, mercy, and peace from God.", "Grace and mercy from God are now visible in this passage.", detect=0.6)[1]["action"] in ("would_stemmed_trim", "stemmed_trim")
    # a stem in common isn't a word in common
    assert boundary("verstehung vergebung hoffnung", "verstehen vergeben hoffnungen und noch mehr davon", apply_ratio=0.6)[1]["text"].startswith("verstehen")


@pytest.mark.parametrize("seed", range(4))
def test_boundary_against_a_plain_one(seed):
    rng = random.Random(seed)
    vocabulary = ["haus", "hausung", "garten", "gartenes", "verstehen", "verstehung", "ja", "wort", "laufen", "laufenes", "berg"]
    texts = []
    for _ in range(150):
        head = texts[-1].split()[-rng.randrange(0, 12) :] if texts and rng.random() < 0.7 else []
        if rng.random() < 0.4:
            head = [rng.choice(vocabulary) if rng.random() < 0.2 else w for w in head]
        texts.append(" ".join(head + [rng.choice(vocabulary) for _ in range(rng.randrange(1, 9))]))
    endings = "owego owej ami ach ego ymi ing tion mente ung keit heit en em er es ie y i a o".split()

    def stem(w):
        cut = max([len(e) for e in endings if w.endswith(e)], default=0) if len(w) > 6 else 0
        return w[: len(w) - cut]

    tail, want = [], []
    for t in texts:
        w, given, what = t.split(), t, "emit"
        exact = max([n for n in range(2, 9) if n <= len(w) and w[:n] == tail[-n:] and len(tail) >= n], default=0)
        left = lambda n: " ".join(w[n:])
        enough = lambda n: len(w) - n >= 2 and len(left(n)) >= 8
        if exact:
            what = "exact_trim" if enough(exact) else "protected_full_overlap"
            given = left(exact) if enough(exact) else t
        elif tail:
            keys = {stem(x) for x in tail[-14:] if len(stem(x)) > 2}
            head = [i for i, x in enumerate(w) if len(stem(x)) > 2][:14]
            found = [n for n in range(3, len(head) + 1) if len(keys) >= 3 and len({stem(w[i]) for i in head[:n]} & keys) >= 3 and len({stem(w[i]) for i in head[:n]} & keys) >= 0.72 * len({stem(w[i]) for i in head[:n]})]
            if found:
                head_, names = head[: found[-1]], {w[i] for i in head[: found[-1]]}
                stems = {stem(w[i]) for i in head_}
                ratio, pure = len(stems & keys) / len(stems), next((k for k, i in enumerate(head) if stem(w[i]) not in keys), len(head))
                cut = max(i for i in head_ if stem(w[i]) in keys) + 1 if ratio >= 0.8 else head[pure - 1] + 1 if pure >= 5 else None
                ok = cut is not None and enough(cut) and len(names & set(tail[-14:])) / len(names) >= 0.6
                what, given = ("stemmed_trim", left(cut)) if ok else ("would_stemmed_trim", t)
        tail = given.split()[-14:]
        want.append((what, given))
    got = [(r["action"], r["text"]) for r in boundary(*texts, gap=1)]
    assert got == want
    assert {a for a, _ in want} >= {"exact_trim", "emit", "stemmed_trim"}


# --- committed prefixes ----------------------------------------------------------------------------------------------------


def plan(spark, ranges, boundaries, n=6):
    """One unit of ``n`` words of 100 samples; ranges are (start, end, release, committed_at)."""
    words = spark.createDataFrame([(1, i, "a", i * 100, i * 100 + 100) for i in range(n)], "id long, word long, space string, start long, end long")
    r = spark.createDataFrame([("a", *x) for x in ranges], "space string, start long, end long, release long, committed_at long")
    b = spark.createDataFrame([(1, x) for x in boundaries], "id long, boundary long")
    out = revisions.committed_prefix_plan(words, r, b, ["id"]).collect()
    assert len(out) == 1
    return out[0]


@pytest.mark.parametrize(("ranges", "boundaries", "want"), [
    ([(0, 400, 1, 1)], [3], ("resegment", "proved_prefix", "proved_prefix_safe_boundary", 4, 3, 1)),
    ([(0, 200, 1, 1)], [1], ("unchanged", "proved_prefix", "below_benefit", 2, 0, 0)),
    ([(0, 400, 1, 1)], [5], ("unchanged", "proved_prefix", "no_safe_boundary", 4, 0, 0)),
    ([(0, 500, 1, 1)], [2], ("unchanged", "proved_prefix", "no_safe_boundary", 5, 0, 0)),
    ([(200, 400, 1, 1)], [3], ("unchanged", "committed_infix", "committed_infix", 0, 0, 0)),
    ([(300, 600, 1, 1)], [3], ("unchanged", "suffix", "suffix", 0, 0, 0)),
    ([(0, 50, 1, 1)], [3], ("unchanged", "boundary_overlap_only", "boundary_overlap_only", 0, 0, 0)),
    ([], [3], ("unchanged", "none", "none", 0, 0, 0)),
    ([(0, 200, 1, 1000), (400, 600, 1, 1000), (200, 400, 2, 2000)], [3], ("unchanged", "fragmented", "fragmented", 4, 0, 0)),
    ([(0, 600, 1, 1)], [], ("suppress", "full", "source_fully_committed", 6, 6, 0)),
    ([(0, 200, 1, 1), (200, 600, 2, 2)], [], ("suppress", "full", "source_fully_committed", 6, 6, 0)),
    ([(0, 300, 2, 2), (300, 600, 1, 1)], [], ("unchanged", "fragmented", "fragmented", 3, 0, 0)),
    ([(0, 150, 1, 1), (150, 600, 1, 1)], [3], ("unchanged", "fragmented", "fragmented", 1, 0, 0)),  # no range holds the second word
])
def test_committed_prefix_plan(spark, ranges, boundaries, want):
    r = plan(spark, ranges, boundaries)
    assert (r.action, r.topology, r.reason, r.frontier, r.safe_word, r.bridge) == want


def test_committed_prefix_plan_edges(spark):
    words = spark.createDataFrame([(1, 0, "a", 0, 100), (1, 1, None, 100, 200), (2, 0, "a", 5, 5)], "id long, word long, space string, start long, end long")
    r = spark.createDataFrame([("a", 0, 300, 1, 1)], "space string, start long, end long, release long, committed_at long")
    b = spark.createDataFrame([], "id long, boundary long")
    assert {x.id: x.reason for x in revisions.committed_prefix_plan(words, r, b, ["id"]).collect()} == {1: "source_not_provable", 2: "source_not_provable"}
    assert revisions.committed_prefix_plan(words.limit(0), r, b, ["id"]).count() == 0


# --- playout ---------------------------------------------------------------------------------------------------------------


def sent(seq, chunk="c", payload="p", epoch="e", ts=None):
    return {"stream_id": 1, "seq": seq, "ts_ms": seq if ts is None else ts, "kind": "broadcast", "chunk_key": chunk, "payload": payload, "epoch": epoch, "outcome": None, "outcome_id": None, "occurred_ms": None, "reason": None}


def told(seq, outcome, oid=None, chunk="c", epoch="e", at=5, ts=None):
    return {"stream_id": 1, "seq": seq, "ts_ms": seq if ts is None else ts, "kind": "outcome", "chunk_key": chunk, "payload": None, "epoch": epoch, "outcome": outcome, "outcome_id": oid or f"o{seq}", "occurred_ms": at, "reason": None}


def ledger(*rows, **kw):
    return [(r["accepted"], r["duplicate"], r["retryable"], r["reason"]) for r in play(revisions.playout_step(**kw), rows)[1]]


YES, AGAIN = (True, False, False, None), (True, True, False, None)


def no(reason, retryable=False):
    return (False, False, retryable, reason)


def test_playout_identities():
    assert ledger(told(1, "play_started"), sent(2), told(1, "play_started", ts=3), told(1, "play_started", ts=4), told(5, "play_completed", "o1"), sent(6), sent(7, payload="q"), told(8, "play_completed")) == [
        no("broadcast_not_observed", True), YES, YES, AGAIN, no("outcome_id_conflict"), AGAIN, no("broadcast_fingerprint_conflict"), no("broadcast_conflicted")]
    assert ledger(sent(1), told(2, "play_started", epoch="x"), told(3, "weird"), told(4, "chunk_received"), sent(5, chunk=None)) == [YES, no("epoch_mismatch"), no("unsupported_outcome"), YES, no("invalid_identity")]


def test_playout_transitions():
    assert ledger(sent(1), told(2, "play_completed"), told(3, "play_started"), told(4, "play_completed"), told(5, "explicit_drop"), told(6, "play_started")) == [YES, no("completed_without_start"), YES, YES, YES, YES]
    assert ledger(sent(1), told(2, "superseded"), told(3, "play_started")) == [YES, YES, no("start_after_terminal_drop")]
    # a refused outcome doesn't use up its id
    assert ledger(sent(1), told(2, "play_completed", "o"), told(3, "play_started"), told(4, "play_completed", "o")) == [YES, no("completed_without_start"), YES, YES]


def test_playout_entries_rest():
    assert ledger(sent(1, ts=0), told(2, "play_started", ts=1001), ttl_ms=1000) == [YES, no("broadcast_not_observed", True)]
    assert ledger(sent(1, ts=0), told(2, "play_started", ts=900), told(3, "play_completed", ts=1800), ttl_ms=1000) == [YES, YES, YES]


def test_playout_against_scans_of_the_past(spark):
    """Each row judged by reading all accepted rows before it."""
    rng = random.Random(12)
    rows = []
    for seq in range(500):
        chunk = rng.choice("abcd")
        if rng.random() < 0.3:
            rows.append(sent(seq, chunk, rng.choice("pppq"), rng.choice("eeeeef")))
        else:
            rows.append(told(seq, rng.choice(["play_started", "play_completed", "explicit_drop", "chunk_received", "odd"]), f"o{rng.randrange(250)}", chunk, rng.choice("eeeef"), at=rng.randrange(2)))
    rows = [r | {"stream_id": r["seq"] % 9} for r in rows]
    state_of, want = {}, {}
    for r in rows:
        past = state_of.setdefault(r["stream_id"], [])
        own = [p for p in past if p["chunk_key"] == r["chunk_key"]]
        first = next((p for p in own if p["kind"] == "broadcast"), None)
        done = {p["outcome"] for p in own if p["kind"] == "outcome"}
        if r["kind"] == "broadcast":
            same = first and (first["payload"], first["epoch"]) == (r["payload"], r["epoch"])
            got = YES if not first else AGAIN if same else no("broadcast_fingerprint_conflict")
            if got == YES or not (got == AGAIN):
                past.append(r if got == YES else r | {"kind": "conflict"})
        else:
            twin = next((p for p in past if p["kind"] == "outcome" and p["outcome_id"] == r["outcome_id"]), None)
            key = lambda p: (p["chunk_key"], p["epoch"], p["outcome"], p["occurred_ms"])
            if twin:
                got = AGAIN if key(twin) == key(r) else no("outcome_id_conflict")
            elif not first:
                got = no("broadcast_not_observed", True)
            elif first["epoch"] != r["epoch"]:
                got = no("epoch_mismatch")
            elif any(p["kind"] == "conflict" for p in own):
                got = no("broadcast_conflicted")
            elif r["outcome"] == "odd":
                got = no("unsupported_outcome")
            elif r["outcome"] == "play_started" and "explicit_drop" in done and "play_started" not in done:
                got = no("start_after_terminal_drop")
            elif r["outcome"] == "play_completed" and "play_started" not in done:
                got = no("completed_without_start")
            else:
                got = YES
                past.append(r)
        want[r["stream_id"], r["seq"]] = got
    schema = "stream_id long, seq long, ts_ms long, kind string, chunk_key string, payload string, epoch string, outcome string, outcome_id string, occurred_ms long, reason string"
    out = fold.ordered_fold(spark.createDataFrame(rows, schema), ["stream_id"], ["ts_ms", "seq"], revisions.playout_step(), revisions.PLAYOUT_SCHEMA).collect()
    assert {(r.stream_id, r.seq): (r.accepted, r.duplicate, r.retryable, r.reason) for r in out} == want
    assert len({w[3] for w in want.values()}) >= 7
