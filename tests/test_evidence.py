"""Cutting segments, collapsing repeats and edges of lineage, against brute force."""

import random
import re

from pyspark.sql import functions as F

from quillstream.operators import evidence, segments


def letters(c):
    return bool(c) and (c.isalnum() or c == "_")


def parts_of(text, most, least):
    """Cuts by walking over characters and words."""
    out = []
    text = (text or "").strip()
    starters = [s.lower() for s in segments.STARTERS]
    first = [text]
    if len(text) > most:
        cuts = [i for i in range(least + 1, len(text)) for s in starters if text[i : i + len(s)].lower() == s and not letters(text[i - 1]) and not letters(text[i + len(s) : i + len(s) + 1])]
        edges = [0, *sorted(set(cuts)), len(text)]
        first = [text[a:b].strip() for a, b in zip(edges, edges[1:], strict=False)]
    for a in filter(None, first):
        second = [a] if len(a) <= most else [p.strip() for p in re.split(r"(?i),\s*(und|oder|aber|denn|sondern)\s+", a)]
        for b in filter(None, second):
            if len(b) <= most:
                out.append(b)
                continue
            line = ""
            for w in b.split():
                if line and len(line) + 1 + len(w) > most:
                    out.append(line)
                    line = w
                else:
                    line = f"{line} {w}" if line else w
            out.append(line)
    return out


def test_long_segments_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = ["Aber", "und", "weil", "Haus,", "Haus", "geht", "Seither", "seit", "langes-Wort", ", oder", "Während", "a", "Bisschen"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 60)))) for i in range(60)] + [(100, None), (101, "  "), (102, "x" * 90), (103, "Nun " * 30)]
    df = spark.createDataFrame(rows, "id long, text string")
    got = {}
    for r in segments.split_long_segments(df, ["id"], most=40, least=15).orderBy("id", "part").collect():
        got.setdefault(r.id, []).append(r.piece)
    assert got == {i: parts_of(t, 40, 15) for i, t in rows if parts_of(t, 40, 15)}
    assert segments.split_long_segments(df.limit(0), ["id"]).count() == 0


def without(said, bare, n):
    i = 0
    while i + 2 * n <= len(said):
        if [bare(w) for w in said[i : i + n]] == [bare(w) for w in said[i + n : i + 2 * n]]:
            del said[i + n : i + 2 * n]
            i += n
        else:
            i += 1
    return said


def test_repeats_equal_brute_force(spark):
    rng = random.Random(6)
    bare = lambda w: w.lower().strip(".,!")
    rows = [(i, " ".join(rng.choice(["a", "A,", "b", "b.", "c", "!d"]) for _ in range(rng.randrange(0, 40)))) for i in range(200)] + [(900, None), (901, ""), (902, "ab"), (903, "...  ... x")]
    got = {r.id: r.repeats_ for r in segments.collapse_repeats(spark.createDataFrame(rows, "id long, text string")).collect()}
    for i, text in rows:
        said = re.split(r"\s+", text) if text else []
        if text is None or len(text) < 3 or len(said) < 2:
            assert (got[i].text, got[i].adjacent, got[i].trigrams, got[i].bigrams) == (text, 0, 0, 0)
            continue
        one = []
        for w in said:
            if one and bare(one[-1]) == bare(w):
                one[-1] = w if len(w) > len(one[-1]) else one[-1]
            else:
                one.append(w)
        three = without(list(one), bare, 3)
        two = without(list(three), bare, 2)
        assert (got[i].text, got[i].adjacent, got[i].trigrams, got[i].bigrams) == (" ".join(two), len(said) - len(one), len(one) - len(three), len(three) - len(two))


def test_pauses_cut_only_once_enough_is_held(spark):
    words = [("k", 1, "one", 0, 10), ("k", 2, "two", 900, 910), ("k", 3, "three-and-more", 920, 930), ("k", 4, "four", 2000, 2010), ("k", 5, None, 2010, None)]
    df = spark.createDataFrame(words, "k string, i int, word string, start long, end long")
    got = [(r.segment, r.text, r.n_words) for r in segments.segment_by_pauses(df, ["k"], ["i"]).orderBy("segment").collect()]
    assert got == [(0, "one two three-and-more", 3), (1, "four ", 2)]
    assert segments.segment_by_pauses(df.limit(0), ["k"], ["i"]).count() == 0


def test_lineage_names_the_first_rule_that_fails(spark):
    texts = spark.createDataFrame([(i, p, t) for i in range(1, 7) for p, t in enumerate(["a", "b"])], "k long, pos int, token string")
    times = {1: [(0, 10), (10, 20)], 2: [(0, 10), (10, 10)], 3: [(0, 10), (10, 99)], 4: [(10, 20), (0, 10)], 5: [(0, 10), (10, 20)]}
    spans = spark.createDataFrame([(i, p, "ab"[p], s, e) for i, v in times.items() for p, (s, e) in enumerate(v)], "k long, pos int, token string, start long, end long")
    inputs = spark.createDataFrame([(i, True, 0, 50, None if i == 5 else "c") for i in range(1, 8)], "k long, aligned boolean, input_start long, input_end long, chunk_id string")
    built = evidence.build_lineage(texts, spans, inputs, ["k"])
    assert {r.k: (r.status, r.reason) for r in built.collect()} == {
        1: ("complete", None), 2: ("ambiguous", "invalid_range"), 3: ("ambiguous", "outside_input"), 4: ("ambiguous", "not_monotone"), 5: ("ambiguous", "no_identity"),
        6: ("missing", "word_mismatch"), 7: ("missing", "empty_text"),
    }
    asked = spark.createDataFrame([(1, 0, 2), (1, 1, 1), (1, 1, 2), (1, 0, 0), (2, 0, 1), (6, 0, 1), (99, 0, 1), (1, None, 1)], "k long, from long, n long")
    got = {(r.k, r["from"], r.n): (r.status, r.reason) for r in evidence.slice_lineage(built, spans, asked, ["k"]).collect()}
    assert got == {
        (1, 0, 2): ("complete", None), (1, 1, 1): ("complete", None), (1, 1, 2): ("ambiguous", "not_provable"), (1, 0, 0): ("missing", "invalid_slice"), (2, 0, 1): ("ambiguous", "parent_not_complete"),
        (6, 0, 1): ("missing", "partial_coverage"), (99, 0, 1): ("missing", "invalid_slice"), (1, None, 1): ("missing", "invalid_slice"),
    }


def test_open_cut_and_supersede_take_nulls(spark):
    rows = spark.createDataFrame([(None, "hold", None), ("Das ist gut.", None, 0), ("weil er", "micro_emit", 9000), ("Ja, weil er", "fallback", 10), ("Ja, weil er", "merge", 9000)], "text string, decision string, held_ms long")
    assert [(r.action, r.said, r.held) for r in evidence.replay_open_cut(rows).collect()] == [("hold", 0, 0), ("emit_full", 3, 0), ("forced_open", 2, 0), ("emit_prefix_hold", 1, 2), ("emergency_trim", 1, 2)]
    finals = spark.createDataFrame([("s", 1, 10_000, "a b c d e f"), ("s", 2, 10_000, "a b c"), ("s", 3, 90_000, "a b c"), ("s", 4, 10_000, None)], "k string, seq long, ts_ms long, text string")
    before = finals.limit(0).select("k", "ts_ms", "text").union(spark.createDataFrame([("s", 5_000, "A, b!"), ("s", 5_000, "a"), ("s", 5_000, "x"), ("s", 6_000, None)], "k string, ts_ms long, text string"))
    got = {r.seq: (r.action, r.covered, r.tail_words) for r in evidence.supersede(finals, before, ["k"]).collect()}
    assert got == {1: ("emit_tail", 2, 4), 2: ("suppress", 2, 1), 3: ("pass", None, None), 4: ("pass", None, None)}
    assert evidence.supersede(finals.limit(0), before, ["k"]).count() == 0
    assert evidence.late_rows(finals.withColumn("ts_ms", F.lit(None).cast("long")), ["k"], ["seq"], "ts_ms", 5).where("late").count() == 0


def test_an_event_log_reads_back(spark, tmp_path):
    from quillstream.sources import event_log

    rows = spark.createDataFrame([(1, "2026-01-01 10:00:00", "a"), (2, "2026-01-02 10:00:00", None)], "seq long, ts string, said string").withColumn("ts", F.col("ts").cast("timestamp"))
    for part in (rows, rows.limit(0)):
        event_log.write_event_log(part, str(tmp_path / "log"))
    (tmp_path / "log" / "day=2026-01-02" / "cut.json").write_text('\n{"seq": 3, "sa')
    back = event_log.read_event_log(spark, str(tmp_path / "log"), rows.select("seq", "said").schema)
    assert sorted((r.seq, r.said, str(r.day), r["_corrupt_record"]) for r in back.collect() if r["_corrupt_record"] is None) == [(1, "a", "2026-01-01", None), (2, None, "2026-01-02", None)]
    assert [r["_corrupt_record"] for r in back.collect() if r["_corrupt_record"]] == ['{"seq": 3, "sa']
