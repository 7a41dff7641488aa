"""Phrases and terms in texts against brute force."""

import random
import re

import duckdb
from quillstream.operators import text
from quillstream.plans.queries import ORACLES, QUERIES


def test_short_phrases_are_found_inside_texts_as_by_sql(spark, tmp_path):
    texts = [(1, "our quality assurance framework was kept in use"), (2, "the quality assurance framework"), (3, "Internationalisation, then more words"), (4, "nothing here"), (5, None)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in texts], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    items = [(1, "quality assurance framework"), (2, "internationalisation"), (3, "in use"), (4, "the quality assurance framework"), (5, "assurance framework was kept in use")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(con.execute(ORACLES["e12_match_phrases"]).fetchall())
    got = sorted((r.doc_id, r.item_id, r.tier) for r in QUERIES["e12_match_phrases"](spark, str(tmp_path)).select("doc_id", "item_id", "tier").collect())
    assert (1, 1, "contains") in got and (3, 2, "contains") in got and got == want


def tier_of(said, phrase):
    normal = lambda s: re.sub(r"\s+", " ", re.sub(r"[.,!?;:'\"]", "", s.lower())).strip()
    low, key, norm, other = said.lower().strip(), phrase.lower().strip(), normal(said), normal(phrase)
    if low == key:
        return "exact"
    if norm == other:
        return "normalized"
    if len(key) > 15 and key in low:
        return "contained"
    return "contains" if len(norm) >= 5 and norm in other and len(norm) / len(other) >= 0.6 else None


def test_phrase_tiers_equal_brute_force(spark):
    rng = random.Random(8)
    words = ["amen", "Lord,", "have", "mercy!", "us", "O", "everlasting", "praise;"]
    phrases = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(40)]
    texts = [(100, "  AMEN "), (101, None), (102, ""), (103, "lord")]
    for i, (_, p) in enumerate(phrases):
        cut = rng.randrange(0, 1 + len(p) // 2)
        texts += [(4 * i + 200, p.upper()), (4 * i + 201, p.replace(",", "").replace(";", " ")), (4 * i + 202, "xy " + p + " zz"), (4 * i + 203, p[cut // 2 : len(p) - cut + cut // 2])]
    got = text.match_phrases(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(phrases, "phrase_id long, text string"), ["doc_id"]).collect()
    want = {(i, j): x for i, t in texts if t is not None for j, p in phrases if (x := tier_of(t, p))}
    assert {(r.doc_id, r.phrase_id): r.tier for r in got} == want and set(want.values()) == set(text.TIERS)
    for i in {i for i, _ in want}:
        first = min((text.TIERS.index(x), j) for (d, j), x in want.items() if d == i)[1]
        assert [r.phrase_id for r in got if r.doc_id == i and r.place == 1] == [first]


def test_terms_of_any_length_are_found_whole(spark):
    rng = random.Random(9)
    words = ["ka", "lo", "mi", "su"]
    terms = [(i, " ".join(rng.choice(words) for _ in range(1 + i % 9))) for i in range(30)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(12)) + ", " + terms[i % 30][1].upper() + ".") for i in range(60)] + [(60, None), (61, "")]
    got = text.match_terms(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(terms, "term_id long, norm string"), ["doc_id"], k=100).collect()
    flat = {i: " " + " ".join(re.findall(r"\w+", (t or "").lower())) + " " for i, t in texts}
    assert sorted((r.doc_id, r.term_id) for r in got) == sorted((i, j) for i, t in flat.items() for j, term in terms if f" {term} " in t)
    for i in flat:
        own = [r for r in sorted(got, key=lambda r: r.place) if r.doc_id == i]
        assert [len(r.norm) for r in own] == sorted((len(r.norm) for r in own), reverse=True)
