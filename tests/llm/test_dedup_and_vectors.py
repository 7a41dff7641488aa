"""Whitening, line dedup and importance resampling against plain restatements of their definitions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillstream.llm import importance, line_dedup, whitening

VECTORS = "vec_id long, embedding array<float>, x string, component string, n string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c") for i, v in rows], VECTORS)


def plain_whitening(rows, most=4):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = {i: [math.floor(256 * float(np.float32(c))) for c in v] for i, v in good}
    fit = np.array(sorted(set(map(tuple, x.values()))), dtype=float)
    n, mean = len(fit), fit.mean(axis=0)
    values, columns = np.linalg.eigh((fit - mean).T @ (fit - mean) / n)
    order = np.argsort(-values)[:most]
    sums = fit.sum(axis=0).astype(int).tolist()
    return x, n, sums, mean, values, order, columns


@pytest.mark.parametrize("scale", [0.25, 40.0])
def test_whitening(spark, scale):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 7)) * np.array([3, 2, 1.5, 1, 0.5, 0.2, 0.0]) * scale
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(200 + j, rows[4][1]) for j in range(120)]  # copies count once in the fit
    rows += [(400, None), (401, [1.0, None] + [0.0] * 5), (402, [float("nan")] + [0.0] * 6), (403, [float("-inf")] + [0.0] * 6), (404, []), (7, rows[7][1]), (7, rows[7][1])]
    x, n, sums, mean, values, order, columns = plain_whitening(rows)
    out = whitening.whiten(vectors_of(spark, rows)).collect()
    assert len(out) == 4 * (150 + 120 + 2)
    assert {r.n for r in out} == {n}
    signs = {}
    for r in out:
        assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x[r.vec_id], sums, strict=True))
        k = order[r.component - 1]
        want = float((np.array(x[r.vec_id]) - mean) @ columns[:, k] / math.sqrt(values[k]))
        sign = signs.setdefault(r.component, 1 if want * r.whitened >= 0 else -1)
        assert abs(want * sign - r.whitened) < 1e-7 * max(1, abs(want))
        assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
        assert r.identity_error < 1e-9
    assert len({r.identity_error for r in out}) == 1


def test_whitening_edges(spark):
    assert whitening.whiten(vectors_of(spark, [])).count() == 0
    assert whitening.whiten(vectors_of(spark, [(1, None), (2, [])])).count() == 0
    # no variance, then fewer vectors than components, then two lengths
    assert whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    two = whitening.whiten(vectors_of(spark, [(1, [1.0, 2.0, 0.0]), (None, [3.0, 1.0, 5.0])])).collect()
    assert sorted((r.vec_id is None, r.component, round(abs(r.whitened), 9)) for r in two) == [(False, 1, 1.0), (True, 1, 1.0)]
    mixed = whitening.whiten(vectors_of(spark, [(1, [1.0]), (2, [3.0]), (3, [1.0, 2.0]), (4, [2.0, 1.0])])).collect()
    assert {(r.vec_id, r.component, r.n) for r in mixed} == {(1, 1, 2), (2, 1, 2), (3, 1, 2), (4, 1, 2)}


def test_shifted_cholesky_qr_of_ill_conditioned_rows():
    rng = np.random.default_rng(1)
    u, _ = np.linalg.qr(rng.normal(size=(400, 6)))
    v, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    spread = np.array([1e6, 1e3, 1, 1e-3, 1e-6, 0])  # the Gram matrix's condition is beyond doubles
    x = u * spread @ v.T

    def gram_after(factors):
        q = x.T
        for r in factors:
            q = whitening._lower_solve(r.T, q)
        return q @ q.T

    found = np.linalg.svd(whitening.shifted_cholesky_qr(gram_after, len(x)))[1]
    assert np.allclose(found[:4], spread[:4], rtol=1e-6)
    assert found[5] < 1e-8


def test_deviation_is_exact_or_an_error():
    x = np.array([[2**30, -(2**30)]], dtype=np.int64)
    assert whitening._deviation(x, 1, np.array([1, 2]))[0] == (2**30 - 1) ** 2 + (2**30 + 2) ** 2
    with pytest.raises(OverflowError):
        whitening._deviation(x, 10, np.array([1, 2]))


DOCS = "doc_id long, text string, h string, at int, n string, bucket string, rank string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "a", 1, "b", "c", "d") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def line_rows():
    rng = random.Random(5)
    shared = [f"  This Line number {i} IS shared, again and again, ÄÖ by many. " for i in range(6)]
    rows = []
    for i in range(60):
        own = [f"own line {i} {j} with enough characters to be looked at, really" for j in range(3)]
        for j, line in enumerate(shared):
            if i % (j + 2) == 0 and i < 4 + 11 * j:
                own.insert(rng.randrange(len(own) + 1), rng.choice([line, line.lower().replace("ÄÖ", "ÄÖ"), line.strip() + "\t\r"]).replace("äö", "ÄÖ"))
        own.insert(0, "short")
        if i % 7 == 0:
            own += [shared[5], shared[5]]
        rows.append((i, "\n".join(own) + "\n" * (i % 3)))
    rows += [(61, None), (62, ""), (63, "\n\n"), (64, "\n".join(["x" * 39, "y" * 40])), (3, "another text\n" + shared[0]), (3, "another text\n" + shared[0]), (None, shared[1]), (None, shared[0] + "\n" + shared[1])]
    rows += [(70 + k, "\n".join(["x" * 39, "y" * 40, " " + "z" * 39])) for k in range(5)]
    rows.append((90, "\n".join(shared * 3000)))  # long
    return rows


def plain_line_dedup(rows, least_chars=40, least_docs=5):
    strip = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(strip))
    held = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                held[key(line)].add(-1 if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held[key(x)]) < least_docs or max(held[key(x)]) == (-1 if i is None else i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_line_dedup(spark, line_rows):
    got = [tuple(r) for r in line_dedup.line_dedup(docs_of(spark, line_rows).repartition(5)).select("doc_id", "n_lines", "n_dropped", "kept").collect()]
    want = plain_line_dedup(line_rows)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert sum(r[2] for r in got) > 50
    assert line_dedup.line_dedup(docs_of(spark, [])).count() == 0


def test_line_dedup_stays_in_the_jvm(spark, line_rows):
    plan = line_dedup.line_dedup(docs_of(spark, line_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_crc_matrices():
    rng = random.Random(2)
    features = [rng.randbytes(n) for n in [0, 1, 2, 2, 2, 7, 255, 256, 257, 511, 512, 513, 5000, 70_001]] + [b"", b"abc"]
    assert importance.crc32s(features).tolist() == [zlib.crc32(f) for f in features]
    assert importance.crc32s([]).tolist() == []


def plain_resample(docs, target, percent=25, least=20, k=10_000):
    def features(t):
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return len(w), [zlib.crc32(f.encode()) % k for f in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    raw, goal = Counter(), Counter()
    for _, t in docs:
        raw.update(features(t)[1])
    for t in target:
        goal.update(features(t)[1])
    s, t_ = sum(raw.values()), sum(goal.values())
    rows = []
    for i, t in docs:
        n, f = features(t)
        weight = sum(math.floor(1000 * math.log((goal[b] + 1.0) * (s + k) / ((raw[b] + 1.0) * (t_ + k)))) for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    enough = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    for place, r in enumerate(enough[: percent * len(enough) // 100], 1):
        r[5] = place
    return sorted((tuple(r) for r in rows), key=repr)


@pytest.mark.parametrize("empty_target", [False, True])
def test_importance_resampling(spark, empty_target):
    rng = random.Random(9)
    vocabulary = ["Alpha", "beta", "gamma", "Straße", "日本語", "x1", "don't", "e-mail", "delta", "eps"]
    docs = [(i, " ".join(rng.choice(vocabulary[: 4 + i % 7]) for _ in range(rng.randrange(5, 60)))) for i in range(90)]
    docs += [(91, None), (92, ""), (93, "?!"), (94, "one"), (None, docs[0][1] * 3), (95, "q" * 3000 + " " + "r" * 600 + " w" * 30)]
    docs += [(7, docs[7][1] + " beta" * 40), (7, docs[7][1] + " beta" * 40)] + [(500, docs[3][1] * 2)] * 40
    target = [] if empty_target else ["alpha beta gamma", None, "", "alpha beta"]
    made = spark.createDataFrame([(j, t, "a") for j, t in enumerate(target)], "item_id long, text string, doc_id string")
    got = importance.importance_resample(docs_of(spark, docs).repartition(7), made)
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()), key=repr) == plain_resample(docs, target)


def test_importance_resampling_of_nothing(spark):
    made = spark.createDataFrame([], "item_id long, text string")
    assert importance.importance_resample(docs_of(spark, []), made).count() == 0
