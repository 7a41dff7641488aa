"""The pattern detector against brute force over the reference's list."""

import random
import re

import pytest
from pyspark.sql import functions as F
from quillstream.operators import detect

#: The reference's reasons and patterns, in its order.
REFERENCE = [
    ("subtitles", r"[Ss]ubtitles?\s*(by|created|provided)"),
    ("subtitles", r"[Aa]mara\.org"),
    ("subtitles", r"[Tt]hanks?\s*for\s*watching"),
    ("subtitles", r"[Pp]lease\s*(like|subscribe|comment)"),
    ("subtitles", r"[Ss]ubscribe\s*(to|now|here)"),
    ("repetition", r"(.{5,}?)\1{3,}"),
    ("music", r"[♪♫]|[Mm]usic\s*playing"),
    ("bracketed", r"\[.*\]"),
    ("punctuation", r"^\s*\.\s*$"),
    ("punctuation", r"^[\s\.\,\!\?]+$"),
    ("comma_list", r"^[\w\sÀ-ɏß«»„“‚‘]+(?:,\s*[\w\sÀ-ɏß«»„“‚‘]+){4,}\.{0,4}$"),
]


def prose(text):
    items = [i.strip() for i in text.split(",") if i.strip()]
    normal = [" ".join(i.lower().split()) for i in items]
    return len(items) >= 2 and max(map(normal.count, normal)) <= 2 and sum(len(i.split()) for i in items) / len(items) >= 2.5


def brute(text, guard):
    text = (text or "").strip()
    if len(text) >= 3:
        for reason, pattern in REFERENCE:
            m = re.search(pattern, text)
            if m and not (guard and reason == "comma_list" and prose(m.group(0))):
                return reason, m.group(0)[:200], m.start() if reason == "repetition" else None
    return None


@pytest.mark.parametrize("guard", [True, False])
def test_patterns_equal_the_reference(spark, guard):
    rng = random.Random(6)
    parts = ["Grossrat", "Schäupte", "we went home then", "„da“ war er", "so", "", " ", "x-y", "Zeit 7"]
    texts = [", ".join(rng.choice(parts) for _ in range(rng.randrange(3, 9))) + rng.choice(["", ".", "...", ".....", "!"]) for _ in range(150)]
    texts += ["say " + "hello again " * 5, "ok [Music] then", "thanks for watching, subscribe now", "Please like. Subtitles by me", "...", ". , !", "..", None, "", "♪ la", "a,b,c,d,e", "\na, b, c, d, e.\n", "a, b,\n c, d, e", "x" * 300, "a, " * 5000 + "b", "plain words.", "a b, c, d, e, „f“", " .　.! ?", "Subtitles by"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string").select("id", detect.detect_patterns(F.col("t"), guard).alias("found"))
    got = {r.id: None if r.found is None else tuple(r.found) for r in df.collect()}
    assert got == {i: brute(t, guard) for i, t in enumerate(texts)}
    assert "comma_list" in {g[0] for g in got.values() if g}


def test_loops_equal_the_pattern():
    rng = random.Random(3)
    pattern = re.compile(r"(.{5,}?)\1{3,}")
    for _ in range(3000):
        block = "".join(rng.choice("ab") for _ in range(rng.randrange(1, 14)))
        text = "".join(rng.choice("abc\n") for _ in range(rng.randrange(0, 20))) + block * rng.randrange(1, 30) + "".join(rng.choice("ab\n") for _ in range(rng.randrange(0, 20))) + "xyzuv" * rng.randrange(0, 6)
        m = pattern.search(text)
        assert detect.loop(text) == ((m.group(0)[:200], m.start()) if m else (None, None)), text
    assert detect.loop(None) == detect.loop("") == (None, None)


def test_loops_of_long_texts_are_found_fast():
    import time

    words = [f"wort{i * 7919 % 20011}" for i in range(20_000)]
    began = time.perf_counter()
    assert detect.loop(" ".join(words)) == (None, None)
    span, start = detect.loop(" ".join(words) + "langer block, der wiederkehrt " * 5000)
    assert start == len(" ".join(words)) and span.startswith("langer block") and len(span) == 200
    assert detect.loop("x" * 200_000)[1] == 0
    assert time.perf_counter() - began < 20


def test_loops_of_many_texts_equal_the_pattern(monkeypatch):
    import pandas as pd

    rng = random.Random(9)
    pattern = re.compile(r"(.{5,}?)\1{3,}")
    texts = [None, "", "\n"]
    for _ in range(800):
        blocks = ["".join(rng.choice("ab \U0001f600") for _ in range(rng.randrange(1, 25))) * rng.choice([1, 3, 4, 5, 60]) for _ in range(rng.randrange(4))]
        texts.append(rng.choice(["", "\n", "c"]).join(blocks))
    want = [(m.group(0)[:200], m.start()) if (m := pattern.search(t or "")) else (None, None) for t in texts]
    assert detect.loops(texts) == want and len({w[0] for w in want}) > 100
    monkeypatch.setattr(detect, "_CHARS_AT_ONCE", 500)
    found = detect._loops.func(pd.Series(texts))
    assert [(None, None) if pd.isna(s) else (s, i) for s, i in zip(found["span"], found["start"], strict=True)] == want


def test_ordinary_text_is_not_looked_through_gram_by_gram(monkeypatch):
    rng = random.Random(1)
    seen, repeats = [], detect._repeats
    monkeypatch.setattr(detect, "_repeats", lambda line, *a: seen.append(len(line)) or repeats(line, *a))
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(600)) for _ in range(30)] + ["before " + "again and " * 6 + "after"]
    assert [detect.loop(t)[1] for t in texts] == [None] * 30 + [6]
    assert 0 < sum(seen) < sum(map(len, texts)) / 20


def test_the_blanks_that_are_trimmed_are_the_reference_s():
    assert set(detect._BLANK) == {c for c in map(chr, range(0x110000)) if c.isspace()}
