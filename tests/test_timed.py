"""Words by time, agreement of passes and fallback windows: stated cases, plain restatements, and streams whose state ends."""

import difflib
import random

import pytest
from pyspark.sql import functions as F

from quillstream.operators import fold, timed
from quillstream.streaming.stateful import stream_fold


def play(step, rows):
    state, out = {}, []
    for row in rows:
        state, got = step(state, row)
        out += got if isinstance(got, list) else [got] if got else []
    return state, out


def heard(*passes, offsets=None, **limits):
    rows = [
        {"stream_id": 1, "pass": i, "offset_s": (offsets or [0.0] * len(passes))[i], "words": [{"text": t, "start": s, "end": e} for t, s, e in p]}
        for i, p in enumerate(passes)
    ]
    return play(timed.word_time_step(**limits), rows)


def deltas(*args, **kw):
    return [r["delta"] for r in heard(*args, **kw)[1]]


def test_words_heard_again_are_not_given_again():
    one = [("Hiob", 0.0, 0.5), ("sprach", 0.5, 1.0)]
    state, out = heard(one, one)
    assert [r["delta"] for r in out] == ["Hiob sprach", None] and out[1]["duplicate"] == 2
    assert deltas([("Du", 0.5, 0.8), ("hast", 0.8, 1.2)], [("Ja", 0.2, 0.4), ("Du", 0.5, 0.8), ("hast", 0.8, 1.2), ("recht", 1.2, 1.6)]) == ["Du hast", "Ja recht"]
    assert deltas([("eins", 0.0, 1.0)], [("zwei", 0.95, 1.95)], least_words=1) == ["eins", "zwei"]


def test_overlap_is_a_share_of_the_word():
    assert deltas([("kurz", 0.0, 0.3)], [("kurz", 0.2, 0.5)], least_words=1) == ["kurz", None]
    assert deltas([("lang", 0.0, 2.0)], [("lang", 1.9, 3.9)], least_words=1) == ["lang", "lang"]


def test_other_text_over_the_same_audio_replaces_the_word():
    state, out = heard([("Felser", 0.0, 0.5)], [("Felsen", 0.0, 0.5)], least_words=1)
    assert out[1]["delta"] is None and out[1]["replaced"] == 1 and state["heard"].names == ["felsen"]


def test_words_wait_and_sentence_ends_release():
    assert deltas([("eins", 0.0, 0.3)], [("zwei", 0.3, 0.6)], [("drei", 0.6, 0.9)], least_words=3) == [None, None, "eins zwei drei"]
    assert deltas([("Amen.", 0.0, 0.4)], least_words=5) == ["Amen."]
    state, out = heard([(f"w{i}", i * 0.1, i * 0.1 + 0.09) for i in range(85)], least_words=1)
    assert (out[0]["status"], out[0]["delta"], state["pending"]) == ("rejected", None, [])


def test_words_lie_on_the_absolute_axis():
    assert deltas([("alt", 0.0, 0.5)], [("alt", 0.0, 0.5)], offsets=[0.0, 10.0], least_words=1) == ["alt", "alt"]
    assert deltas([("Wort", 12.0, 12.5)], [("Wort", 0.0, 0.5)], offsets=[0.0, 12.0], least_words=1) == ["Wort", None]
    state, _ = heard(*[[(f"w{i}", 0.0, 0.5)] for i in range(400)], offsets=[float(i) for i in range(400)], least_words=1)
    assert state["heard"].names == [f"w{i}" for i in range(400) if i + 0.5 > 399 - 60]
    assert len(heard(*[[(f"w{i}", float(i), i + 0.5)] for i in range(400)], least_words=1)[0]["heard"].names) == 400  # the offset, not the audio, forgets


def test_samples_of_a_delta():
    _, out = heard([("x", 0.5, 1.0)], offsets=[2.0], least_words=1)
    assert (out[0]["start_sample"], out[0]["end_sample"], out[0]["provenance"]) == (40_000, 48_000, "complete")
    assert heard([("a", 0.5, 0.5), ("b", 0.6, 0.9)])[1][0]["provenance"] == "invalid_timestamp"
    assert heard([("b", 0.6, 0.9), ("a", 0.1, 0.2)])[1][0]["provenance"] == "non_monotonic"
    assert heard([(None, 0.1, 0.2), ("b", None, 0.9)], [])[1][0]["delta"] is None


def restated_words(rows):
    """The same rule over plain lists."""
    known, wait, out = [], [], []
    for row in rows:
        skipped = replaced = 0
        for w in row["words"]:
            s, e, name = row["offset_s"] + w["start"], row["offset_s"] + w["end"], w["text"].lower().strip(".,!?;:")
            hit = None
            for k, (n, a, b) in enumerate(known):
                share = (min(e, b) - max(s, a)) / (e - s) if e > s else 0
                if share > 0.1 and (n == name or share > 0.8):
                    hit = k
                    break
            if hit is None:
                known.append((name, s, e))
                wait.append(w["text"])
            elif known[hit][0] == name:
                skipped += 1
            else:
                known[hit] = (name, s, e)
                replaced += 1
        if row["offset_s"] > 60 and row["words"]:
            known = [k for k in known if k[2] > row["offset_s"] - 60]
        delta = None
        if wait and row["words"] and (len(wait) >= 2 or wait[-1][-1] in ".!?"):
            delta = " ".join(wait) if len(wait) <= 80 else None
            wait = []
        out.append((row["stream_id"], row["pass"], delta, skipped, replaced))
    return out


def timed_rows(seed, n=40):
    rng = random.Random(seed)
    said = [(rng.choice(["ja", "nein", "Haus", "Hauses", "und.", "Wort,"]) + str(rng.randrange(4)) * (i % 3), 0.3 * i, 0.3 * i + rng.choice([0.2, 0.3, 0.35])) for i in range(900)]
    for i in range(n):
        offset = float(rng.choice([0, 1, 2]) * 3 + (i // 3) * 9)
        words = [w for w in said if offset <= w[1] < offset + rng.choice([3, 6, 12])]
        words = [(t if rng.random() > 0.15 else t + "x", s - offset, e - offset) for t, s, e in words]
        yield {"stream_id": seed, "pass": i, "ts_ms": 1000 + i * 1000, "offset_s": offset, "words": [{"text": t, "start": s, "end": e} for t, s, e in words]}


WORDS = "stream_id long, pass long, ts_ms long, offset_s double, words array<struct<text string, start double, end double>>"


def test_word_time_fold_equals_plain_lists_and_the_stream(spark, tmp_path):
    rows = [r for seed in range(4) for r in timed_rows(seed)]
    df = spark.createDataFrame(rows, WORDS)
    out = fold.ordered_fold(df, ["stream_id"], ["pass"], timed.word_time_step(), timed.WORD_TIME_SCHEMA)
    got = sorted(tuple(r) for r in out.select("stream_id", "pass", "delta", "duplicate", "replaced").collect())
    want = sorted(x for seed in range(4) for x in restated_words([r for r in rows if r["stream_id"] == seed]))
    assert got == want and any(r[4] for r in want) and any(r[3] for r in want)

    timed_df = df.withColumn("at", F.timestamp_millis("ts_ms"))
    for part in range(2):
        timed_df.where((F.col("pass") >= 20) == bool(part)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(timed_df.schema).parquet(str(tmp_path / "in"))
        stream = stream_fold(source, ["stream_id"], ["pass"], timed.word_time_step(), timed.WORD_TIME_SCHEMA, event_time="at", expires=lambda s: s["at_ms"] + 3_600_000)
        run(stream, tmp_path)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == sorted(map(str, out.collect()))


def run(stream, tmp_path):
    q = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None


# --- agreement -------------------------------------------------------------------------------------------------------------


def passes(*texts, **kw):
    return play(timed.agreement_step(**kw), [{"stream_id": 1, "release_seq": i, "text": t} for i, t in enumerate(texts)])[1]


def test_agreement_is_fuzzy_and_only_grows():
    out = passes("Die Kirche ist gross", "Die Kirchen ist klein", "Die", "Die Kirche ist klein und schön")
    assert [r["confirmed"] for r in out] == ["", "Die Kirche ist", "Die Kirche ist", "Die Kirche ist"]
    assert [r["tentative"] for r in out] == ["Die Kirche ist gross", "Kirchen ist klein", "", "klein und schön"]
    assert [r["grown"] for r in out] == [False, True, False, False]
    assert passes("Straße lang", "strasse, lang")[1]["confirmed"] == "Straße lang"
    assert passes("a b", "a b", "a c", n=3)[2]["confirmed"] == "a"
    assert passes("b a", "c a", "c a", n=3, tau=0.0)[2]["confirmed"] == "c a"  # the most frequent form
    assert passes(None, None)[1]["confirmed"] == ""


def test_sentences_reset_the_buffer():
    out = passes("Das ist gut.", "Das ist gut.", "Und dann", "Und dann kam", sentence_words=3)
    assert [r["sentence"] for r in out] == [None, "Das ist gut.", None, None]
    assert [r["confirmed"] for r in out] == ["", "Das ist gut.", "", "Und dann"]
    assert passes("Gut so.", "Gut so.", sentence_words=3)[1]["sentence"] is None


@pytest.mark.parametrize("n", [2, 3])
def test_agreement_against_a_plain_one(n):
    rng = random.Random(n)
    vocabulary = ["Kirche", "Kirchen", "kirche,", "Felsen", "Felser", "größe", "Groesse", "und", "so."]
    texts = []
    for _ in range(200):
        base = texts[-1].split()[: rng.randrange(0, 8)] if texts else []
        texts.append(" ".join(base + [rng.choice(vocabulary) for _ in range(rng.randrange(0, 4))]))
    best, got = "", passes(*texts, n=n)
    strip = lambda w: "".join({"ä": "ae", "ö": "oe", "ü": "ue", "ß": "ss"}.get(c, c) for c in w.lower() if c not in ".,")
    for i in range(len(texts)):
        if i + 1 >= n:
            own, prefix = [t.split() for t in texts[i + 1 - n : i + 1]], []
            for k in range(min(map(len, own))):
                column = [p[k] for p in own]
                if min(difflib.SequenceMatcher(None, strip(column[0]), strip(c)).ratio() for c in column) < 0.75:
                    break
                prefix.append(sorted(column, key=lambda c: (-column.count(c), column.index(c)))[0])
            if len(" ".join(prefix)) > len(best):
                best = " ".join(prefix)
        assert got[i]["confirmed"] == best


# --- windows ---------------------------------------------------------------------------------------------------------------


def event(seq, ts, kind="enqueue", origin="partial_fallback", release=None):
    return {"stream_id": 1, "seq": seq, "ts_ms": ts, "kind": kind, "origin": origin, "epoch": "e", "release_seq": seq if release is None else release}


def test_windows():
    other = "deadline_fallback"
    _, out = play(timed.fallback_step(100, 1000), [
        event(1, 0), event(2, 10), event(3, 20, origin="confirmed"), event(4, 30, origin=other), event(5, 40, "commit", release=9), event(6, 50, "commit", release=1),
        event(7, 60, "commit", release=1), event(8, 70, origin=other), event(9, 99, origin=other), event(10, 100, origin=other), event(11, 120, "broadcast", release=10), event(12, 130, "broadcast", release=10),
    ])
    assert [(r["seq"], r["decision"], r["candidates"]) for r in out] == [
        (1, "armed", None), (2, "same_origin", None), (4, "reevaluate", None), (6, "committed", "4"), (8, "reevaluate_now", "8"), (9, "reevaluate_now", "9"), (10, "armed", None), (11, "broadcast", None),
    ]
    assert [r["age_ms"] for r in out] == [0, 10, 30, 50, 70, 99, 0, 20]
    assert {r["winner_origin"] for r in out[:6]} == {"partial_fallback"} and out[6]["winner_origin"] == other


def test_windows_hold_four_waiters_and_cancel():
    other = "deadline_fallback"
    _, out = play(timed.fallback_step(100, 1000), [event(1, 0), *[event(i, i, origin=other) for i in range(2, 8)], event(8, 8, "cancel", release=5), event(9, 9, "commit", release=1)])
    assert (out[-2]["waiting"], out[-2]["overflow"], out[-1]["candidates"]) == (4, 2, "4,6,7")
    state, out = play(timed.fallback_step(100, 1000), [event(1, 0), event(2, 5, "cancel", release=1), event(3, 6, origin=other)])
    assert [r["decision"] for r in out] == ["armed", "armed"]


def test_windows_nobody_closes_are_given_up():
    _, out = play(timed.fallback_step(100, 1000), [event(1, 0), event(2, 5000, "commit", release=1), event(3, 5001)])
    assert [(r["decision"], r["ts_ms"], r["seq"]) for r in out] == [("armed", 0, 1), ("expired", 1100, None), ("armed", 5001, 3)]


def test_streamed_windows_equal_the_batch(spark, tmp_path):
    rng = random.Random(8)
    rows, ts = [], 1000  # a first watermark is 0
    for i in range(400):
        ts += rng.choice([3, 30, 700])
        kind = rng.choice(["enqueue"] * 5 + ["commit", "broadcast", "cancel"])
        release = i if kind == "enqueue" else max(0, i - rng.randrange(1, 4))
        rows.append((rng.randrange(3), i, ts, kind, rng.choice([*timed.ORIGINS, "confirmed"]), "e", release))
    schema = "stream_id long, seq long, ts_ms long, kind string, origin string, epoch string, release_seq long"
    df = spark.createDataFrame(rows, schema).withColumn("at", F.timestamp_millis("ts_ms"))
    step, end = timed.fallback_step(200, 1000), timed.window_at_end(1000)
    want = sorted(map(str, fold.ordered_fold(df, ["stream_id"], ["ts_ms", "seq"], step, timed.WINDOW_SCHEMA, end).collect()))
    assert any("expired" in w for w in want) and sum("decision='expired'" in w for w in want) >= 3
    later = spark.createDataFrame([(99, 9999, 10**9, "cancel", "confirmed", "e", 0)], schema).withColumn("at", F.timestamp_millis("ts_ms"))  # moves the watermark
    for part in (df.where("seq < 200"), df.where("seq >= 200"), later):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        run(stream_fold(source, ["stream_id"], ["ts_ms", "seq"], step, timed.WINDOW_SCHEMA, event_time="at", late="0 seconds", expires=timed.window_end(1000), at_end=end), tmp_path)
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "out")).collect())) == want


# --- provisional texts -----------------------------------------------------------------------------------------------------


def early(ts, text):
    return {"stream_id": 1, "seq": None, "ts_ms": ts, "kind": "provisional", "text": text}


def final(seq, text, ts=None):
    return {"stream_id": 1, "seq": seq, "ts_ms": seq if ts is None else ts, "kind": "final", "text": text}


def finals(*rows, **kw):
    return [(r["action"], r["text"]) for r in play(timed.supersede_step(**kw), rows)[1]]


def test_a_provisional_text_covers_one_final():
    assert finals(early(0, "Das ist der Anfang"), final(1, "Das ist der Anfang, und noch mehr davon."), final(2, "Das ist der Anfang, und noch mehr davon.")) == [
        ("emit_tail", "und noch mehr davon."), ("pass", "Das ist der Anfang, und noch mehr davon.")]
    assert finals(early(0, "Das ist der Anfang"), final(1, "Das ist der Anfang von etwas")) == [("suppress", None)]
    assert finals(early(0, "eins zwei"), early(1, "eins zwei drei"), final(2, "eins zwei drei vier fünf sechs"), final(3, "eins zwei drei")) == [("emit_tail", "vier fünf sechs"), ("suppress", None)]
    assert finals(early(0, "eins zwei"), final(1, "eins zwei", ts=25_001)) == [("pass", "eins zwei")]
    assert finals(early(0, "eins zwei"), final(1, "zwei eins"), final(2, None), final(3, "...")) == [("pass", "zwei eins"), ("pass", ""), ("pass", "...")]


def test_provisional_texts_add_up():
    kw = {"cumulative": True}
    assert finals(early(0, "eins zwei"), early(1, "drei vier"), final(2, "eins zwei drei vier fünf sechs sieben"), **kw) == [("emit_tail", "fünf sechs sieben")]
    assert finals(early(0, "eins zwei drei"), final(1, "eins zwei"), final(2, "eins zwei"), **kw) == [("suppress", None), ("pass", "eins zwei")]
    assert finals(early(0, "eins zwei"), final(1, "eins zwei nicht"), **kw) == [("emit_tail", "nicht")]
    assert finals(early(0, "Hiob sagt"), final(1, "Hiob sagt 42"), **kw) == [("emit_tail", "42")]
    assert finals(early(0, "Hiob sagt"), final(1, "Hiob sagt etwas"), **kw) == [("suppress", None)]
    assert finals(early(0, "Hiob sagt"), final(1, "Hiob fragt etwas"), **kw) == [("pass", "Hiob fragt etwas")]
    assert finals(early(0, "Hiob sagt"), final(1, "Hiob sagt etwas"), least_tail=1, **kw) == [("emit_tail", "etwas")]


def test_withdrawal_against_a_plain_ledger(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for stream in range(6):
        book = []
        for i in range(80):
            ts = i * 1000
            words = [rng.choice("abc") for _ in range(rng.randrange(0, 7))]
            if rng.random() < 0.5:
                rows.append((stream, 1000 + i, ts, "provisional", " ".join(words)))
                book.append([ts, words, False])
                continue
            rows.append((stream, i, ts, "final", " ".join(words) + "."))
            open_ = [b for b in book if not b[2] and b[1] and ts - b[0] <= 25_000 and b[1] == words[: len(b[1])]]
            longest = max((len(b[1]) for b in open_), default=0)
            if not open_:
                want[stream, i] = ("pass", " ".join(words) + ".")
            else:
                next(b for b in open_ if len(b[1]) == longest)[2] = True
                tail = words[longest:]
                want[stream, i] = ("suppress", None) if len(tail) < 3 else ("emit_tail", " ".join(tail) + ".")
    df = spark.createDataFrame(rows, "stream_id long, seq long, ts_ms long, kind string, text string")
    out = fold.ordered_fold(df, ["stream_id"], ["ts_ms", "seq"], timed.supersede_step(), timed.SUPERSEDE_SCHEMA).collect()
    assert {(r.stream_id, r.seq): (r.action, r.text) for r in out} == want
    assert {a for a, _ in want.values()} == {"pass", "suppress", "emit_tail"}
