"""The filter chain and unit clean-up against plain restatements, stage by stage, and stated cases."""

import random
import re

import numpy as np
import pytest

from quillstream.operators import chain, dedup, fold, units

TRIMMED = {
    "Hiob sagt, ich will reden über die Ruhe. Hiob sagt, ich will reden über die Ruhe und über die Besonnenheit in der Prüfung.":
        "Hiob sagt, ich will reden über die Ruhe und über die Besonnenheit in der Prüfung.",
    "Mehrheit hat es nicht geschafft. essen, dann bekommt man ein Zweiziger. Die Mehrheit hat es nicht geschafft. Es gab drei Kategorien von":
        "essen, dann bekommt man ein Zweiziger. Die Mehrheit hat es nicht geschafft. Es gab drei Kategorien von",
    "Das Spannende ist nämlich, dass Gott Hiob keine Frage beantwortet, Das Spannende ist nämlich, dass Gott Hiob keine Frage beantwortet, sondern er fragt zurück.":
        "Das Spannende ist nämlich, dass Gott Hiob keine Frage beantwortet, sondern er fragt zurück.",
    "als alles, was du hast. Gelassenheit ist besser als alles, was du hast. Du kannst dein Leben kosmetisch aufarbeiten.":
        "Gelassenheit ist besser als alles, was du hast. Du kannst dein Leben kosmetisch aufarbeiten.",
    "ab cd ef gh ij kl ab cd ef gh ij kl mn": "ab cd ef gh ij kl mn",
}
KEPT = {
    "Gott ist gut. Gott ist gut. Und seine Treue bleibt.": "emit",
    "Heilig, heilig, heilig ist der Herr.": "emit",
    "1. Wir behalten die Ruhe in der Prüfung. 2. Wir behalten die Ruhe in der Prüfung und bleiben wach.": "emit",
    "«Der Herr ist mein Hirte und mir wird nichts mangeln.» Der Herr ist mein Hirte und mir wird nichts mangeln in dieser Zeit.": "emit",
    "Das Erdbeben hatte die Stärke 8 und traf die ganze Stadt. Das Erdbeben hatte die Stärke 7 und traf die ganze Stadt.": "emit",
    "» Er weiss nicht, warum. «Warum, warum, warum ? » Er weiss nicht, warum. In Kapitel 4 «Er ist in Staub und": "emit",
    "ab cd ef gh ij kl ab cd ef gh ij kl": "blocked",  # 18 of 35 characters would go
}


@pytest.mark.parametrize("text", TRIMMED)
def test_units_trimmed(text):
    got = units.clean_units(text)
    assert (got["action"], got["cleaned"]) == ("trim", TRIMMED[text])


@pytest.mark.parametrize("text", KEPT)
def test_units_kept(text):
    got = units.clean_units(text)
    assert (got["action"], got["cleaned"]) == (KEPT[text], text)


def test_units_removal_over_the_cap_is_blocked():
    text = "Gott selber ist die Antwort. Gott selber ist die Antwort."
    got = units.clean_units(text, units.Limits(removed=0.1))
    assert (got["action"], got["cleaned"]) == ("blocked", text)


def test_units_by_meaning():
    text = "Erdbeben auf Richterseiten. Erdbeben auf der Richterskala Stärke acht."
    near = lambda us: np.array([[1.0, 0.2], [1.0, 0.3]])[: len(us)]
    far = lambda us: np.eye(len(us))
    assert units.clean_units(text)["action"] == "emit"
    made = units.clean_units(text, units.Limits(dry_run=False), near)
    assert (made["action"], made["cleaned"], made["candidates"]) == ("trim", "Erdbeben auf der Richterskala Stärke acht.", 1)
    dry = units.clean_units(text, units.Limits(), near)
    assert (dry["action"], dry["cleaned"], dry["candidates"]) == ("emit", text, 1)
    assert units.clean_units(text, units.Limits(dry_run=False), far)["candidates"] == 0
    numbers = "Das Erdbeben hatte die Stärke 8 und traf die Stadt. Das Erdbeben hatte die Stärke 7 und traf die ganze Stadt."
    assert units.clean_units(numbers, units.Limits(dry_run=False), near)["held_back"] == 1
    # where no vector fires, the rows are those without vectors
    for t in [*TRIMMED, *KEPT]:
        assert units.clean_units(t, units.Limits(dry_run=False), far) == units.clean_units(t)


def test_blocks_against_brute_force():
    rng = random.Random(4)
    for _ in range(300):
        words = [rng.choice("abc") for _ in range(rng.randrange(0, 26))]
        found = units._first_square(np.array([ord(w) for w in words]), 4) if len(words) >= 8 else None
        want = next(((i, p) for p in range(len(words) // 2, 3, -1) for i in range(len(words) - 2 * p + 1) if words[i : i + p] == words[i + p : i + 2 * p]), None)
        assert found == want
        other = [rng.choice("abcd") for _ in range(rng.randrange(0, 26))]
        run = max((n for n in range(27) for i in range(len(words) - n + 1) if any(other[j : j + n] == words[i : i + n] for j in range(len(other) - n + 1))), default=0)
        assert units.common_run(words, other) == run


def test_unit_cleanup_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (3, "...", "x"), (4, " ".join(f"wort{i % 5000}" for i in range(20_000)), "x"), (5, "ja nein " * 4000, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, action string")
    got = {r.doc_id: r for r in units.unit_pair_cleanup(df, ["doc_id"]).collect()}
    assert {k: r.action for k, r in got.items()} == {1: "emit", 2: "emit", 3: "emit", 4: "blocked", 5: "blocked"}
    assert units.unit_pair_cleanup(df.limit(0), ["doc_id"]).count() == 0


# --- the chain, restated --------------------------------------------------------------------------------------------------


def stems(words):
    return ["".join(c for c in w.lower() if c in "abcdefghijklmnopqrstuvwxyzäöüß")[:4] for w in words]


def ended(word):
    return word[-1:] in tuple(".!?")


def restated_history(rows, cap=500):
    """(seq, text) -> (seq, text or None, action), n-grams kept in a plain list."""
    seen, out = [], []
    for seq, text in rows:
        w = text.split()
        grams = [tuple(stems(w)[i : i + 6]) for i in range(len(w) - 5)]
        old = [g in seen for g in grams]
        share = sum(old) / len(old) if old else 0
        result = (text, "emit")
        if share > 0.2:
            cut = next((i for i in range(len(old) - 3) if not any(old[i : i + 4])), -1)
            if cut >= 10:
                snap = cut
                for off in range(6):
                    if cut - off - 1 >= 0 and ended(w[cut - off - 1]):
                        snap = cut - off
                        break
                    if 0 < cut + off < len(w) and ended(w[cut + off - 1]):
                        snap = cut + off
                        break
                result = (" ".join(w[snap if snap >= 10 else cut :]), "trim")
            elif cut < 0 and share > 0.7:
                result = (None, "skip")
            elif share > 0.3:
                result = (text, "warn")
        for g in grams:
            if g not in seen:
                seen.append(g)
        seen = seen[-cap:]
        out.append((seq, *result))
    return out


def restated_overlap(rows):
    past, out = [], []
    for seq, text in rows:
        w = text.split()
        bare = [s for s in stems(w) if len(s) > 1 and s not in dedup.STOP]
        if len(w) < 6 or len(bare) < 3:
            out.append((seq, text, "emit"))
            continue
        best = max([len(set(bare) & set(p)) / len(set(bare) | set(p)) for p in past[-3:]] or [0])
        result = (text, "emit")
        if best > 0.5:
            old = {s for p in past[-3:][-2:] for s in p}
            start = len(w)
            while start and not (len(s := stems([w[start - 1]])[0]) > 1 and s not in dedup.STOP and s in old):
                start -= 1
            if len(w) - start < 5:
                result = (None, "skip")
            else:
                for off in range(4):
                    if start - off - 1 >= 0 and ended(w[start - off - 1]):
                        start -= off
                        break
                result = (" ".join(w[start:]), "trim")
        past.append(bare)
        out.append((seq, *result))
    return out


def restated_tail(text, tail):
    w, a, b = text.split(), stems(text.split()), stems(tail)
    best = 0
    for s in range(len(b)):
        n = 0
        while n < len(a) and s + n < len(b) and a[n] == b[s + n] and a[n]:
            n += 1
        best = max(best, n)
    return " ".join(w[best:]) if best >= 4 else text


def restated_echo(text):
    w, s = text.split(), stems(text.split())
    if len(w) < 12:
        return text
    keep, first, i = [True] * len(w), {}, 0
    while i <= len(s) - 6:
        g = tuple(s[i : i + 6])
        if g in first and i >= first[g] + 12:
            end = i
            while end < len(s) and s[end] == s[first[g] + end - i]:
                keep[end] = False
                end += 1
            i = end
            continue
        first.setdefault(g, i)
        i += 1
    new = " ".join(x for x, k in zip(w, keep, strict=True) if k)
    return text if len(new) < 0.3 * len(text) or all(keep) else new


def restated_chain(rows):
    """Each stage over all texts that reach it, one stage after the other; the last three go together, since the tail is that of the result."""
    out, held = {}, []
    for seq, text in rows:
        t = text or ""
        solid = "".join(t.split())
        if len(solid) > 10 and sum(c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZäöüÄÖÜß" for c in t) / len(solid) < 0.4:
            out[seq] = ("letters", None)
        elif not ended(t.strip()[-1:]) and len(t.strip()) < 50:
            out[seq] = ("fragment", None)
        else:
            held.append((seq, t))
    for name, stage in (("history", restated_history), ("overlap", restated_overlap)):
        judged, held = stage(held), []
        for seq, t, _ in judged:
            if t is None or len(t.strip()) < 3:
                out[seq] = (name, None)
            else:
                held.append((seq, t))
    tail = []
    for seq, t in held:
        t = restated_tail(t, tail)
        if len(t.strip()) < 3:
            out[seq] = ("tail", None)
            continue
        t = units.clean_units(restated_echo(t))["cleaned"]
        tail = t.split()[-20:]
        out[seq] = (None, t)
    return out


def stream_rows(seed, n=60):
    rng = random.Random(seed)
    roots = ["".join(rng.choice(c) for c in ("bdfgklmnprst", "aeiouäö", "lmnrst", "aeiu")) for _ in range(220)]
    vocabulary = [root + end for root in roots for end in ("", "n", "ten")] + ["und", "der", "ist"] * 20
    sentence = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k)).capitalize() + rng.choice(".!?")
    texts = []
    for i in range(n):
        kind, before = rng.randrange(9), texts[-1] if texts else ""
        text = " ".join(sentence(rng.randrange(4, 16)) for _ in range(rng.randrange(1, 5)))
        if kind == 0:
            text = before
        elif kind == 1:
            text = before + " " + text
        elif kind == 2:
            text = " ".join(before.split()[-7:]) + " " + text
        elif kind == 3:
            text = text + " " + sentence(14) + " " + text
        elif kind == 4:
            w = before.split()
            rng.shuffle(w)
            text = " ".join(w) + rng.choice(["", " " + sentence(7)])
        elif kind == 6:  # a sentence, then the same one with more words
            first = sentence(9)
            text += f" {first} {first[:-1]} {sentence(6).lower()} " + sentence(12)
        elif kind == 5:
            text = rng.choice(["", "1234567890123456 !", "kurz", None, "Nur ein Wort"])
        texts.append(text or "")
        yield i, text


def test_chain_equals_the_stages_one_by_one(spark):
    streams = {s: list(stream_rows(s)) for s in range(12)}
    rows = [(s, seq, text, "x") for s, own in streams.items() for seq, text in own]
    df = spark.createDataFrame(rows, "stream_id long, release_seq long, text string, outcome string").repartition(3)
    got = fold.ordered_fold(df.drop("outcome"), ["stream_id"], ["release_seq"], chain.chain_step(), chain.CHAIN_SCHEMA).collect()
    assert len(got) == len(rows)
    want = {(s, seq): r for s, own in streams.items() for seq, r in restated_chain(own).items()}
    assert {(r.stream_id, r.release_seq): (r.blocked_by, r.text) for r in got} == want
    stages = {why for why, _ in want.values()}
    assert stages >= {None, "letters", "fragment", "history", "overlap"}
    done = " ".join(r.actions for r in got)
    assert all(f"{stage}=trim" in done for stage in ("history", "overlap", "tail", "echo", "units")) and "history=warn" in done
    assert all(re.fullmatch(r"(\w+:\d+>\d+,?)*", r.trims) for r in got)


def test_streamed_chain_equals_the_batch(spark, tmp_path):
    from quillstream.streaming.stateful import stream_fold

    rows = [(s, seq, text) for s in range(3) for seq, text in stream_rows(s, 30)]
    df = spark.createDataFrame(rows, "stream_id long, release_seq long, text string")
    df.where("release_seq < 15").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream = stream_fold(source, ["stream_id"], ["release_seq"], chain.chain_step(), chain.CHAIN_SCHEMA)
    start = lambda: stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    start().awaitTermination(120)
    df.where("release_seq >= 15").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))  # the state goes on from here
    start().awaitTermination(120)
    got = sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect()))
    want = sorted(map(str, fold.ordered_fold(df, ["stream_id"], ["release_seq"], chain.chain_step(), chain.CHAIN_SCHEMA).collect()))
    assert got == want


def test_predecessor_and_hold_inside_the_chain():
    step = chain.chain_step(chain.Chain(hold_words=2))
    texts = ["Der erste lange Satz kommt jetzt ganz in Ruhe an.", "Etwas ganz anderes folgt darauf und bleibt stehen."]
    state, got = {}, []
    for i, t in enumerate(texts):
        state, row = step(state, {"stream_id": 1, "release_seq": i, "text": t, "vec": np.array([1.0, 0.1 * i])})
        got.append(row)
    assert got[0]["text"] == "Der erste lange Satz kommt jetzt ganz in"
    assert got[1]["blocked_by"] == "meaning" and state["held"] == ["bleibt", "stehen."]


def test_native_history_and_overlap_equal_the_restated_ones(spark):
    rows = [(s, seq, text or "") for s in range(6) for seq, text in stream_rows(s, 18)]
    df = spark.createDataFrame(rows, "stream_id long, release_seq long, text string")
    for native, restated in ((dedup.ngram_history, lambda own: restated_history(own, 10**9)), (dedup.jaccard_window_dedup, restated_overlap)):
        got = {(r.stream_id, r.release_seq): (r.action, r.cut) for r in native(df, ["stream_id"], "release_seq").collect()}
        want = {}
        for s in range(6):
            for seq, text, action in restated([(q, t) for k, q, t in rows if k == s]):
                n = len(next(t for k, q, t in rows if (k, q) == (s, seq)).split())
                want[s, seq] = (action, n - len((text or "").split()))
        assert got == want


def test_echo_trim_equals_the_restated_one(spark):
    rng = random.Random(6)
    texts = [None, "", "kurz", "a b c d e f " * 40]
    for _ in range(80):
        block = " ".join(rng.choice("alpha beta gamma delta eins zwei drei vier".split()) + rng.choice(["", ".", "n"]) for _ in range(rng.randrange(6, 25)))
        texts.append(" ".join([block, *(f"wort{rng.randrange(999)}" for _ in range(rng.randrange(0, 20))), block, "ende"]))
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, kept string")
    got = {r.doc_id: (r.kept, r.n_cut) for r in chain.echo_trim(df, ["doc_id"]).collect()}
    assert got == {i: (t if t is None else restated_echo(t), len((t or "").split()) - len((t if t is None else restated_echo(t)) .split() if t else [])) for i, t in enumerate(texts)}
    assert sum(n > 0 for _, n in got.values()) > 20
