"""Corpus cleaning: the stages that turn ``documents`` into training data.

Each stage takes (spark, docs, folder of tables) and returns a DataFrame; all but the last return the columns of
``documents``.  Rows with a null id pass the stages that decide by id unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm.common import discard, scratch, table
from quillstream.llm.jaccard import jaccard_join
from quillstream.llm.mixing import mixed_documents
from quillstream.llm.quality_classifier import quality_scores
from quillstream.llm.sentencepiece_ops import encoded_documents
from quillstream.llm.suffix_dedup import suffix_dedup


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the rows whose id is in ``ids``, columns unchanged."""
    gone = ids.select(F.col("doc_id").alias("gone_")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_"], "left_anti")


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts.

    Null and empty texts are judged by their features; repeated rows of one id go together if one of them is rejected; an empty table gives none.  Extra columns pass through but for the last stage.
    """
    scores = quality_scores(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.where("predicted = 0"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each component of 5-word shingle Jaccard 0.8 or more.

    Null and wordless texts stay; rows that repeat an id stay together; ties have no part in it; an empty table gives none.  Extra columns pass through but for the last stage.
    """
    components = jaccard_join(docs, percent=80, k=5)
    return _without(docs, components.where("doc_id <> component_id"))


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-byte strings that smaller ids have too; documents of which nothing is left go.

    Null texts stay null, rows that share an id take nothing from each other; an empty table gives none.  Extra columns pass through but for the last stage.
    """
    others = [c for c in docs.columns if c != "text"]
    marked = docs.select("*", F.col("text").isNull().alias("no_text_"))
    cut = suffix_dedup(marked, with_text=True, carry=[*others, "no_text_"]).where("n_removed = 0 or kept <> ''")
    text = F.when(~F.col("carried.no_text_"), F.col("kept"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("carried.n_chars"))}
    return cut.select(*[(new[c] if c in new else F.col("carried")[c]).alias(c) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole copies of documents at the sources' target weights.

    A null source is one source; texts without words are never counted; ties of the key are broken by id and size; an empty table gives none.  Extra columns pass through but for the last stage.
    """
    return mixed_documents(docs)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row.

    Null and empty texts have no ids; each copy of a row is a row; an empty table gives none.
    """
    return encoded_documents(docs)


STAGES = [
    ("quality-classifier", drop_low_quality),
    ("jaccard-join", drop_near_copies),
    ("suffix-dedup", drop_repeated_passages),
    ("mixing", mix_sources),
    ("sentencepiece", encode_texts),
]
#: SQL can express neither the classifier nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` through all stages; each result is written and read again by the next, and a stage's own tables go."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch() as keep:
            docs, before = keep(stage(spark, docs, sf_dir), f"pipeline-{name}"), docs
        if name != STAGES[0][0]:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
