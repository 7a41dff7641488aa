"""Verdicts on repeats in meaning against a plain restatement."""

import random

import numpy as np
import pytest

from quillstream.operators import semantic


@pytest.mark.parametrize(("before", "now", "fresh", "guards"), [
    ("Gott ist die Antwort auf alles.", "Gott ist die Antwort auf alles.", 0, []),
    ("Das Beben hatte Stärke 8.", "Das Beben hatte Stärke 7.", 0, ["guard_numbers"]),
    ("Er kommt morgen wieder.", "Er kommt morgen nicht wieder.", 0, ["guard_negation"]),
    ("«Der Herr ist mein Hirte» sagt er", "Der Herr ist mein Hirte sagt er", 0, ["guard_quote"]),
    ("Der Herr ist treu", "Ich wiederhole das: treu ist der Herr", 1, ["guard_rhetorical"]),
    ("Der Herr ist treu", "Wirklich, der Herr ist treu und gut", 2, ["guard_expansion"]),
])
def test_pair_guards(before, now, fresh, guards):
    assert semantic.pair_guards(before, now) == (fresh, guards)


def restated(rows, exploratory=0.70, precise=0.75):
    out, history = [], []
    for seq, release, ts, text, vec in rows:
        seen = [h for h in history if ts - h[2] <= 150_000][-32:]
        matches = []
        for h in seen:
            if h[1] != release and vec is not None and h[4] is not None and np.any(vec) and np.any(h[4]):
                matches.append((float(np.dot(vec, h[4]) / np.linalg.norm(vec) / np.linalg.norm(h[4])), h[0], *semantic.pair_guards(h[3] or "", text or "")))
        history.append((seq, release, ts, text, vec))
        best = max(matches, key=lambda m: (round(m[0], 12), -m[1]), default=None)
        fit = max((m for m in matches if m[0] >= exploratory and not m[3] and m[2] <= 2), key=lambda m: (round(m[0], 12), -m[1]), default=None)
        if best is None:
            verdict = ("keep", "no_history")
        elif fit:
            verdict = ("candidate_high_precision", "above_high_precision_tau") if fit[0] >= precise else ("candidate_exploratory", "above_exploratory_tau")
        elif best[0] < exploratory:
            verdict = ("keep", "below_exploratory_tau")
        elif best[3]:
            verdict = ("guarded", ",".join(best[3]))
        else:
            verdict = ("related_with_new_content", "new_lexical_tokens_above_max")
        out.append((seq, *verdict, best[1] if best else None, fit[1] if fit else None))
    return out


def test_verdicts_equal_a_plain_ladder(spark):
    rng = random.Random(4)
    words = "Haus Garten Berg nicht 7 8 laufen sehen Himmel Wort «ja» gut".split()
    rows, want = [], []
    for stream in range(4):
        own = []
        for seq in range(70):
            vec = None if rng.random() < 0.05 else np.array([rng.choice([0, 0, 1, 2]) for _ in range(4)], dtype=float)
            own.append((seq, seq // 2, seq * rng.choice([4000, 4000, 9000]), rng.choice([None, ""]) if rng.random() < 0.05 else " ".join(rng.choice(words) for _ in range(rng.randrange(2, 9))), vec))
        own = [(s, r, max(x[2] for x in own[: s + 1]), t, v) for s, r, _, t, v in own]
        want += [(stream, *x) for x in restated(own)]
        rows += [(stream, s, r, ts, t, None if v is None else v.tolist()) for s, r, ts, t, v in own]
    df = spark.createDataFrame(rows, "stream_id long, seq long, release_seq long, ts_ms long, text string, vec array<double>")
    got = [(r.stream_id, r.seq, r.verdict, r.reason, r.match, r.eligible) for r in semantic.semantic_verdicts(df, ["stream_id"]).collect()]
    assert sorted(x[:3] for x in got) == sorted(x[:3] for x in want)
    assert {x[2] for x in want} == {"keep", "candidate_high_precision", "candidate_exploratory", "guarded", "related_with_new_content"}
    # of equal cosines the oldest counts; beyond the last digits these matches are the same
    same = sum(a[4:] == b[4:] for a, b in zip(sorted(got), sorted(want), strict=True))
    assert same > 0.97 * len(want)
