"""The pipeline against a plain version of its stages, on the smallest tables."""

from collections import Counter

import corpus_pipeline
from quillstream.llm import mixing, quality_classifier, sentencepiece_ops
from quillstream.llm.common import table

from .test_operators import brute_components


def plain_cut(rows, length=50):
    """Texts without the strings that smaller ids have, as text without broken characters."""
    first = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            first[w] = min(first.get(w, i), i)
    out = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if first[b[p : p + length]] < i:
                gone[p : p + length] = b"\1" * length
        out[i] = bytes(x for x, g in zip(b, gone, strict=True) if not g).decode("utf-8", "ignore") if any(gone) else t
    return {i: t for i, t in out.items() if t != ""}


def test_pipeline_equals_its_plain_stages(spark, sf):
    import sentencepiece

    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    bad = {r.doc_id for r in quality_classifier.quality_scores(docs, labels).where("predicted = 0").collect()}
    rows = [(r.doc_id, r.text, r.lang, r.source) for r in docs.collect() if r.doc_id not in bad]
    label = brute_components(rows, 80, 5)
    rows = [r for r in rows if label.get(r[0], r[0]) == r[0]]
    texts = plain_cut(rows)
    cut = spark.createDataFrame([(i, texts[i], lang, s) for i, _, lang, s in rows if i in texts], "doc_id long, text string, lang string, source string")
    copies = {r.doc_id: r.copies for r in mixing.pareto_mix(cut).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_ops.DEFAULT_MODEL)
    want = Counter()
    for i, t in texts.items():
        want[i, tuple(library.encode(t or ""))] += copies[i]
    got = Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, sf).collect())
    assert got == +want


def test_stages_keep_the_columns_of_documents(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), sf).columns == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0
