"""Each operator against brute force on small fixtures, with nulls, empty and repeated rows, ties, empty tables and clashing columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from quillstream.llm import chat, common, html_text, jaccard, mixing, quality_classifier, quality_rules, sentencepiece_ops, sharding, suffix_dedup, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, n string, key string, taken string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), "x", "y", "z", "w") for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    words = ["ta", "re", "mi", "solo", "Ünder", "lambda,", "xy.", "ok"]
    base = [" ".join(rng.choice(words) + str(rng.randrange(60)) for _ in range(rng.randrange(20, 120))) for _ in range(25)]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["s0", "s0", "s1", None])) for i, t in enumerate(base)]
    for j in range(25, 50):  # near copies
        w = base[j % 6].split(" ")
        for _ in range(j % 4):
            w[rng.randrange(len(w))] = f"new{j}"
        out.append((j, " ".join(w), "en", "s0"))
    out += [(50, None, "en", "s1"), (51, "", "en", "s1"), (52, base[0], None, None), (53, "one", "en", "s2"), (54, "two words", "en", "s2"), (None, base[1], "en", "s1"), (55, base[2] + "\n" + base[3], "de", "s0"), (56, "é" * 200, "fr", "s1"), (56, "é" * 200, "fr", "s1")]
    return out


def words_of(text):
    return (text or "").encode().split()


def test_sharding(spark, rows):
    out = sharding.interleave_shards(docs_of(spark, rows), 8, buckets=16).collect()
    assert len(out) == len(rows)
    counts = [sum(r.shard == k for r in out) for k in range(8)]
    assert max(counts) - min(counts) <= 1
    for k in range(8):
        assert sorted(r.slot for r in out if r.shard == k) == list(range(counts[k]))
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in out) == want
    assert sharding.interleave_shards(docs_of(spark, []), 8).count() == 0


def test_mixing_meets_targets(spark, rows):
    many = [(i, "w " * (5 + i % 40), "en", s) for i, s in enumerate(["a"] * 900 + ["b"] * 60 + ["c"] * 40 + [None] * 20)]
    out = mixing.pareto_mix(docs_of(spark, many)).collect()
    again = mixing.pareto_mix(docs_of(spark, many[::-1])).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)
    size = {}
    for i, t, _, s in many:
        size[s] = size.get(s, 0) + len(words_of(t))
    # plain water filling
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[j % 3] for j, s in enumerate(order)}
    left, open_, target = 1.5 * sum(size.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not full:
            target |= {s: level * weight[s] for s in open_}
            break
        for s in full:
            target[s] = 2 * size[s]
            left -= target[s]
        open_ -= full
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6 and r.taken <= 2 * r.size and r.source_size == size[r.source]
    for s in order:
        assert abs(sum(r.taken for r in out if r.source == s) - target[s]) <= 45
    assert mixing.pareto_mix(docs_of(spark, rows)).count() == len(rows)
    assert mixing.pareto_mix(docs_of(spark, [])).count() == 0
    mixed = mixing.mixed_documents(docs_of(spark, rows[:40]))
    assert mixed.columns == docs_of(spark, []).columns


def test_mixing_with_unequal_odds_keeps_targets(spark):
    many = [(i, "w " * (5 + i % 40), "en", "a" if i % 3 else "b") for i in range(600)]
    out = mixing.pareto_mix(docs_of(spark, many), odds_weight=F.col("doc_id") % 5 + 1).collect()
    for s in "ab":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.02 * own[0].target + 45
    heavy = sum(r.copies for r in out if r.source == "b" and r.doc_id % 5 == 4)
    light = sum(r.copies for r in out if r.source == "b" and r.doc_id % 5 == 0)
    assert heavy > light


def test_quality_rules(spark, rows):
    out = {(r.doc_id, r.n_words): r for r in quality_rules.quality_rules(docs_of(spark, rows)).collect()}
    for i, t, *_ in rows:
        t = t or ""
        w = words_of(t)
        grams = list(zip(w, w[1:], w[2:], strict=False))
        hit = {k for j, g in enumerate(grams) if grams.count(g) > 1 for k in (j, j + 1, j + 2)}
        lines = [x for x in t.split("\n") if x.split()]
        r = out[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_repeat_words) == (sum(len(x.decode()) for x in w), sum(t.count(c) for c in "#*$%&|<>"), len(hit))
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and (not r.base_failed or not r.kept)
    assert quality_rules.quality_rules(docs_of(spark, [])).count() == 0


def test_quality_rules_judge_long_words(spark):
    text = lambda chars: " ".join("ab"[j % 2] + chr(97 + j // 2 % 26) * (chars - 2) + chr(97 + j % 25) for j in range(60))
    rows = [(i, text(8), "de", "s0") for i in range(60)] + [(100, text(11), "de", "s0"), (101, text(12), "de", "s0"), (102, text(400), "de", "s0")]
    rows += [(200 + i, text(300), "ja", "s0") for i in range(60)] + [(300, text(150), "ja", "s0"), (301, text(299), "ja", "s0"), (302, text(320), "ja", "s0")]
    out = {r.doc_id: r.failed_rules for r in quality_rules.quality_rules(docs_of(spark, rows)).collect()}
    assert {i: x for i, x in out.items() if x} == {101: ["word_length"], 102: ["word_length"], 300: ["word_length_low"], 302: ["word_length"]}


def test_quality_sketch_bins(spark):
    values = [0, 1000, 1001, 2047, 2048, 2049, 2050, 4095, 4097, 123_456_789]
    same = [F.lit(0).cast("long").alias(m) for m in quality_rules.METRICS if m != "word_length"]
    metrics = spark.createDataFrame([(v,) for v in values], "word_length long").select(F.lit("l").alias("l_"), F.lit("s").alias("s_"), "word_length", *same)
    bins = quality_rules.sketches(metrics).where("metric = 'word_length'").collect()
    want = {}
    for v in values:
        lost = max(0, v.bit_length() - 11)
        want[v >> lost << lost] = want.get(v >> lost << lost, 0) + 1
    assert {r.bin: r.n for r in bins} == want


def brute_components(rows, percent, k):
    sets = {}
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        if i is not None and w:
            sets.setdefault(i, []).append(frozenset([tuple(w)]) if len(w) < k else frozenset(zip(*(w[j:] for j in range(k)), strict=False)))
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if label[b] < label[a] and any(100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                    label[a], changed = label[b], True
    return label


@pytest.mark.parametrize(("percent", "k"), [(90, 3), (80, 5)])
def test_jaccard_components(spark, rows, percent, k):
    out = jaccard.jaccard_join(docs_of(spark, rows), percent=percent, k=k).collect()
    label = brute_components(rows, percent, k)
    assert len(out) == len(rows)
    for r in out:
        assert r.component_id == (None if r.doc_id is None else label.get(r.doc_id, r.doc_id))
    assert jaccard.jaccard_join(docs_of(spark, [])).count() == 0


@pytest.mark.parametrize(("percent", "k"), [(90, 3), (80, 5), (60, 2)])
def test_jaccard_components_of_large_groups(spark, percent, k, monkeypatch):
    monkeypatch.setattr(jaccard, "PART_ROWS", 8)
    monkeypatch.setattr(jaccard, "SLICE_ENTRIES", 700)
    rng = random.Random(percent)
    line = " ".join(f"licence{j}" for j in range(30))
    base = [[f"w{rng.randrange(900)}" for _ in range(60)] for _ in range(6)]
    many = []
    for i in range(240):  # near copies of six texts, a line that most share, texts of their own
        w = list(base[i % 6]) if i % 4 else [f"v{rng.randrange(900)}" for _ in range(40)]
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(99)}"
        many.append((i, (line + " " if i % 3 else "") + " ".join(w), "en", "s0"))
    many += [(300 + i, many[5][1], "en", "s0") for i in range(20)] + [(7, many[7][1], "en", "s0")]
    label = brute_components(many, percent, k)
    out = jaccard.jaccard_join(docs_of(spark, many), percent=percent, k=k).collect()
    assert len(out) == len(many)
    assert {r.doc_id: r.component_id for r in out} == label


def test_likely_rows(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("if(id = 7, null, id * 7 - 9000) as id", "'t' as text").union(spark.createDataFrame([(-8993, "u")], "id long, text string"))
    wanted = common.written(spark.createDataFrame([(i * 7 - 9000,) for i in range(1, 4000, 40)] + [(-8993,), (5,), (None,)], "w long"), "likely-test")
    exact = sorted((r.id, r.text) for r in rows.join(wanted.distinct(), F.col("id") == F.col("w"), "left_semi").collect())
    met = common.likely(rows, wanted, "id", "w")
    got = sorted((r.id, r.text) for r in met.collect())
    assert met.columns == rows.columns and len(exact) == 101
    assert set(exact) <= set(got) and len(got) == len(set(got)) <= len(exact) + 40
    assert common.likely(rows, wanted.where("w is null"), "id", "w").count() == 0
    monkeypatch.setattr(common, "MOST_BITS", 8)
    assert sorted((r.id, r.text) for r in common.likely(rows, wanted, "id", "w").collect()) == exact


@pytest.mark.parametrize("bits", [8, 1 << 15, 1 << 28])
def test_jaccard_moves_only_what_links(spark, bits, monkeypatch):
    """Texts and sets stay where they are unless rows of the product need them; pairs are told apart as pairs, not as entries."""
    monkeypatch.setattr(common, "MOST_BITS", bits)
    plans, write = {}, jaccard.written

    def seen(df, name):
        plans.setdefault(name, []).append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(jaccard, "written", seen)
    rng = random.Random(5)
    shared = [f"licence{j}" for j in range(44)]
    many = []
    for i in range(120):  # under the bound by two, all with all; some copies, some texts of their own
        own = [f"own{i % 110}x{rng.randrange(3) if i % 9 == 0 else j}" for j in range(12)]
        many.append((i, " ".join(shared + own if i % 5 else [f"alone{i}x{j}" for j in range(30)]), "en", "s0"))
    # ids with two texts, of which the larger counts; one of them repeated
    many += [(3, many[4][1] + " more", "en", "s0"), (8, "few words of it", "en", "s0"), (8, "few words of it", "en", "s0"), (6, many[6][1], "en", "s0")]
    one = {}
    for r in many:
        if r[0] not in one or len(set(r[1].split())) > len(set(one[r[0]][1].split())):
            one[r[0]] = r
    label = brute_components(list(one.values()), 80, 2)
    out = jaccard.jaccard_join(docs_of(spark, many), percent=80, k=2).collect()
    assert len(out) == len(many)
    assert {r.doc_id: r.component_id for r in out} == label
    told = [p for p in plans["jaccard-pairs"] if "LeftAnti" in p]
    assert told and not any("Aggregate" in p for p in told)
    if bits > 8:
        assert all("strategy=broadcast" in plans[n][0] for n in ("jaccard-texts", "jaccard-sets", "jaccard-links"))


def test_jaccard_product_of_near_misses(spark, monkeypatch):
    """Edited copies just under the bound: a pair is one entry of the product, and few pairs that don't link get their sets read."""
    tables, write = {}, jaccard.written

    def seen(df, name):
        out = write(df, name)
        tables.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard, "written", seen)
    monkeypatch.setattr(jaccard, "GO_PIVOTS", 4)
    monkeypatch.setattr(jaccard, "PART_ROWS", 16)
    entries, meeting = [], jaccard._meeting

    def met(*args):
        out = meeting(*args)
        entries.append((out.count(), out.select("a", "b").distinct().count()))
        return out

    monkeypatch.setattr(jaccard, "_meeting", met)
    rng = random.Random(11)
    base = [f"base{j}" for j in range(200)]
    many = []
    for i in range(90):  # pairs of the first differ in some 60 of 400 columns, where 44 are allowed; the others link
        words = list(base)
        for j in rng.sample(range(200), 16 if i < 80 else 3):
            words[j] = f"own{i}x{j}"
        many.append((i, " ".join(words), "en", "s0"))
    label = brute_components(many, 80, 2)
    assert len(set(label.values())) == 81
    out = jaccard.jaccard_join(docs_of(spark, many), percent=80, k=2).collect()
    assert {r.doc_id: r.component_id for r in out} == label
    assert all(rows == pairs for rows, pairs in entries)
    assert len(entries) > 2 and sum(tables["jaccard-pairs"]) < 300  # of 3,160 pairs that don't link


def test_jaccard_bound_never_rules_out_a_link(spark):
    rng, rows = random.Random(3), []
    for _ in range(300):
        shared = {rng.getrandbits(64) - (1 << 63) for _ in range(rng.randrange(1, 60))}
        x, y = ([v for v in shared if rng.random() < 0.9] for _ in range(2))
        rows.append((x, y, rng.randrange(4), rng.randrange(4)))
    df = spark.createDataFrame(rows, "x array<long>, y array<long>, i long, j long")
    of = lambda c, alone: {"n": F.size(c) + F.col(alone), "alone": F.col(alone)} | {p: jaccard.parity(F.col(c), w) for w, p in enumerate(jaccard._PARITY)}
    bits = sum(F.bit_count(of("x", "i")[p].bitwiseXOR(of("y", "j")[p])) for p in jaccard._PARITY)
    told = 0
    for r in df.select("*", jaccard.within(of("x", "i"), of("y", "j"), 80).alias("in_"), bits.alias("bits")).collect():
        both, apart = len(set(r.x) & set(r.y)), len(set(r.x) ^ set(r.y))
        assert r.bits <= apart and (apart - r.bits) % 2 == 0
        assert r.in_ or 180 * both < 80 * (len(r.x) + len(r.y) + r.i + r.j)
        told += not r.in_
    assert told > 100


def brute_suffix(rows, length):
    seen, out = {}, []
    for i, t, *_ in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - length + 1):
                w = b[p : p + length]
                seen[w] = min(seen.get(w, i), i)
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if i is not None:
            for p in range(len(b) - length + 1):
                if seen[b[p : p + length]] < i:
                    gone[p : p + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((i, len(b), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("params", [{}, {"hot_blocks": 3, "run_entries": 40, "part_bytes": 2000}, {"length": 20}])
def test_suffix_dedup(spark, rows, params):
    more = rows + [(60, "abc " * 300, "en", "s"), (61, "x" + "abc " * 200 + "y", "en", "s"), (62, "bc a" * 90, "en", "s")]
    out = suffix_dedup.suffix_dedup(docs_of(spark, more), **params).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in out), key=str) == brute_suffix(more, params.get("length", 50))
    assert suffix_dedup.suffix_dedup(docs_of(spark, [])).count() == 0


def test_loser_tree_merges_runs_with_right_prefixes():
    rng = random.Random(11)
    runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randrange(16, 22))) for _ in range(rng.randrange(0, 30))) for _ in range(7)]
    coded = [suffix_dedup.front_coded([(s, b"", 1, 0, 5, 6) for s in run]) for run in runs]
    got = list(suffix_dedup.merged(coded))
    assert [e[0] for _, e in got] == sorted(s for run in runs for s in run)
    for (_, x), (n, y) in zip(got, got[1:], strict=False):
        assert n == suffix_dedup.common_prefix(x[0], y[0], 0)


def test_topk(spark):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(6)], "a") for i in range(300)]
    rows += [(i, rows[7][1], "b") for i in range(300, 330)] + [(400, None, "c"), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], "c"), (402, [float("nan")] * 6, "c"), (None, rows[3][1], "d"), (500, [0.5, 0.5], "e"), (600, [], "f")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, dim string").withColumn("rank", F.lit(1))
    out = topk.top_k(df, F.col("vec_id") % 20 == 0, 5, shard_rows=8, block_rows=4).collect()
    import numpy as np

    good = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows if i is not None and v and all(x is not None and x == x for x in v)]
    want = []
    for q, x in good:
        if q % 20 == 0:
            found = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), c) for c, y in good if c != q and len(x) == len(y))[:5]
            want += [(q, k, c, -s) for k, (s, c) in enumerate(found, 1)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in out) == sorted(want)
    assert topk.top_k(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0, 5).count() == 0


def test_chat_paths_rank_and_read_back(spark):
    m = [  # tree, id, parent, role, text, score
        (1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad \\</s>", 1.0), (1, 3, 1, "assistant", "good [INST]", 5.0), (1, 4, 2, "user", "x\\", 1.0),
        (2, 9, 77, "tool", None, 0.0), (None, 1, None, "system", "[ROLE] a [TEXT] b", None), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0), (1, None, 1, "user", "no id", 9.0), (2, 9, 77, "tool", None, 0.0),
    ]
    df = spark.createDataFrame(m, "tree long, mid long, up long, role string, text string, score double").withColumn("path_", F.lit(1))
    out = chat.format_reply_trees(df, tree_col="tree", id_col="mid", parent_col="up", score_col="score", branches=None)
    got = {(r.tree, r.branch): (r.leaf_id, r.score, [(t.role, t.text) for t in r.turns]) for r in out.withColumn("turns", chat.read_turns(F.col("formatted"))).collect()}
    assert got == {
        (1, 1): (3, 5.0, [("user", "q"), ("assistant", "good [INST]")]), (1, 2): (4, 2.0, [("user", "q"), ("assistant", "bad \\</s>"), ("user", "x\\")]),
        (2, 1): (9, 0.0, [("tool", "")]), (None, 1): (1, 0.0, [("system", "[ROLE] a [TEXT] b")]),
    }
    assert chat.format_reply_trees(df.limit(0), tree_col="tree", id_col="mid", parent_col="up").count() == 0


def test_html():
    page = '<html><body><nav><p>menu, menu, menu</p></nav><div class="cookie-notice">We, use, cookies</div><article><header><h1>T &amp; t</h1></header><p>One,  two<br>three<p>Four <a href="/x">five</a></article><div id="comments"><p>nice, very, nice</p></div><footer>end</footer><script>var a="<p>x</p>"</script></body>'
    assert html_text.main_text(page) == "T & t\n\nOne, two three\n\nFour five"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    assert html_text.main_text("<p>short") == "short"


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>a</p>", "x"), (1, "u", "<p>a</p>", "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in html_text.extract_text(df).collect()) == [(0, "", 0), (1, "a", 1), (1, "a", 1)]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_classifier_on_held_out_labels(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = quality_classifier.quality_scores(docs, labels).where("held_out").join(labels, "doc_id").toPandas()
    right = ((out["score"] >= 0.5).astype(int) == out["quality"]).mean()
    assert right > 0.95


def test_classifier_edges(spark, rows):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_classifier.quality_scores(docs_of(spark, rows), none).collect()
    assert len(out) == len(rows) and all(abs(r.score - 0.5) < 1e-6 for r in out)
    some = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, quality int")
    out = quality_classifier.quality_scores(docs_of(spark, rows), some).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert quality_classifier.quality_scores(docs_of(spark, []), some).count() == 0
    assert [r.held_out for r in out if r.doc_id == 5][0] == (zlib.crc32(b"5") % 3 == 1)


def unigram_model():
    """The model file's content with its type set to unigram."""
    with open(sentencepiece_ops.DEFAULT_MODEL, "rb") as f:
        content = f.read()

    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def packed(field, value):
        return number(field << 3) + number(value) if isinstance(value, int) else number(field << 3 | 2) + number(len(value)) + value

    out = b""
    for field, value in sentencepiece_ops._fields(content):
        if field == 2:
            value = packed(3, 1) + b"".join(packed(f, v) for f, v in sentencepiece_ops._fields(value) if f != 3 and isinstance(v, int))
        out += packed(field, value)
    return out


@pytest.mark.parametrize("unigram", [False, True])
def test_sentencepiece_equals_the_library(spark, rows, tmp_path, unigram):
    import sentencepiece

    path = sentencepiece_ops.DEFAULT_MODEL
    if unigram:
        path = str(tmp_path / "unigram.model")
        with open(path, "wb") as f:
            f.write(unigram_model())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    more = rows + [(70, " two  spaces\tand\n\nlines \n", "en", "s"), (71, "漢字かな😀 mixed", "ja", "s"), (72, "a" * 3000, "en", "s")]
    out = sentencepiece_ops.encode(docs_of(spark, more), path, dictionary_words=1 << 16).collect()
    want = sorted((str(i), library.encode(t or "")) for i, t, *_ in more)
    assert sorted((str(r.doc_id), r.ids) for r in out) == want
    back = sentencepiece_ops.decode(spark.createDataFrame([(r.doc_id, r.ids) for r in out], "doc_id long, ids array<int>"), path)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(i), t or "") for i, t, *_ in more)
    assert sentencepiece_ops.encode(docs_of(spark, []), path).count() == 0


def test_html_text_keeps_short_sections_beside_the_best():
    long = "Words of the article, one after the other. " * 70
    page = f"<html><body><div><div><p>{long}</p></div><div><p>Short close.</p></div><ul><li>A point</li></ul><div><a href='x'>More like this</a></div></div></body></html>"
    assert html_text.main_text(page).split("\n\n") == [long.strip(), "Short close.", "A point"]


@pytest.mark.parametrize(("page", "want"), [
    ("<script>// if x<y don't stop\n</script><div><p>He said it's fine, really.</p></div>", "He said it's fine, really."),
    ('<div class="site has-sidebar"><div class="post comments-open"><p>Text, long enough.</p></div><div class="sidebar"><p>Side, text.</p></div></div>', "Text, long enough."),
    ("<form><div><p>A page, inside a form.</p></div></form>", "A page, inside a form."),
    ('<article><h2 class="post-header">Head</h2><p>Words, words.</p><div class="alert-level"><p>Level, five.</p></div></article>', "Head\n\nWords, words.\n\nLevel, five."),
    ("<p>&am<b>p;lt;</b></p>", "&amp;lt;"),
    ('<div><p>Main, text, of, the, page.</p></div><ol class="comment-list"><li><article class="comment"><p>Nice, nice, nice, nice, nice, nice.</p></article></li></ol>', "Main, text, of, the, page."),
    ('<div class="wrap"><article><p>Body, of it.</p></article><div id="comments"><p>One, two, three, four, five, six, seven.</p></div></div>', "Body, of it."),
    ('<div class="cookie-notice">Cookies, all</div><div class="alert alert-info">Alert, now</div><div class="site-header">Name, of site</div><p>Text, here.</p>', "Text, here."),
])
def test_html_pages_from_the_wild(page, want):
    assert html_text.main_text(page) == want


def test_html_deep_nesting_is_linear():
    import time

    def seconds(n):
        page = "<div>" * n + "<p>deep, text</p>" + "</span></div>" * n + "<b>" * n + "x" + "</i>" * n
        start = time.perf_counter()
        assert "deep, text" in html_text.main_text(page)
        return time.perf_counter() - start

    seconds(500)
    assert seconds(16_000) < 20 * max(seconds(2_000), 0.02)


def test_html_equals_a_plain_reading_of_all_pages(sf):
    """The tables' pages have one article and nothing nested in it but inline marks: cut it out with expressions."""
    import html
    import re

    import pyarrow.parquet as pq

    for page in pq.read_table(f"{sf}/pages.parquet", columns=["html"]).column("html").to_pylist():
        article = re.search(r"(?s)<article[^>]*>(.*?)</article>", page)[1]
        article = re.sub(r"(?s)<(script|style)[^>]*>.*?</\1>|<div[^>]*class=\"ad\".*?</div>", "", article)
        parts = re.split(r"</?(?:h1|h2|h3|p|li|ul|div)(?:\s[^>]*)?>", article)
        texts = [" ".join(html.unescape(re.sub(r"<[^>]+>", "", re.sub(r"<br */?>", " ", t))).split()) for t in parts]
        assert html_text.main_text(page) == "\n\n".join(t for t in texts if t)


def test_classifier_risk_slope_and_prior_against_plain_sums():
    import numpy as np

    rng = np.random.default_rng(8)
    positive = np.c_[rng.normal(1, 1, (300, 3)), np.ones(300)]
    mixed = np.c_[np.concatenate((rng.normal(1, 1, (700, 3)), rng.normal(-3, 1, (300, 3)))), np.ones(1000)]
    parted = lambda w: quality_classifier._parted(quality_classifier.sums(mixed, w), 4)
    risk = quality_classifier.Risk(positive, parted, 0.7, 1e-3)

    def plain(w):
        loss = lambda g: np.log(1 + np.exp(-g))
        negative = loss(-(mixed @ w)).mean() - 0.7 * loss(-(positive @ w)).mean()
        return 0.7 * loss(positive @ w).mean() + negative + 1e-3 * (w[:-1] @ w[:-1]) / 2, negative

    w = rng.normal(0, 0.3, 4)
    value, negative, slope, curve = risk.at(w)
    assert np.allclose((value, negative), plain(w))
    for i in range(4):
        e = np.eye(4)[i] * 1e-5
        assert abs((plain(w + e)[0] - plain(w - e)[0]) / 2e-5 - slope[i]) < 1e-6
        assert np.allclose((risk.at(w + e)[2] - risk.at(w - e)[2]) / 2e-5, curve[i], atol=2e-3)
    found = quality_classifier.fit_positive_unlabelled(risk, 4)
    assert plain(found)[0] < plain(w)[0] and plain(found)[1] >= 0
    assert abs(quality_classifier.class_prior(positive @ found, mixed @ found) - 0.7) < 0.06


def test_mixing_ranks_by_unequal_probabilities(spark):
    """Short documents of a source that isn't taken whole come less often; targets hold all the same."""
    many = [(i, "w " * (10 if i % 2 else 400), "en", f"s{i % 3}") for i in range(1800)]
    out = mixing.pareto_mix(docs_of(spark, many)).collect()
    for s in ("s1", "s2"):
        own = [r for r in out if r.source == s]
        share = lambda words: sum(r.copies for r in own if r.size == words) / sum(r.size == words for r in own)  # noqa: B023, E731
        assert abs(sum(r.taken for r in own) - own[0].target) <= 400
        assert own[0].target % own[0].source_size == 0 or share(10) < share(400)
