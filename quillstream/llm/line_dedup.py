"""Line dedup: lines that many documents share stay in one of them (DataFrame functions only)."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_facts, table, written

_SPACE = " \t\n\x0b\x0c\r"


def lines_of(text: Column) -> Column:
    """The text cut at ``\\n``; a null or empty text is one empty line."""
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    """The line without ASCII white space at both ends, A-Z in lower case."""
    bare = F.btrim(line, F.lit(_SPACE))
    # in ASCII lines ``lower`` changes A-Z only, and much faster than ``translate``
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, string.ascii_uppercase, string.ascii_lowercase))


def _without(lines: Column, gone: Column) -> Column:
    """``lines`` but for the places in the sorted array ``gone`` (from 0): the runs between these places, in linear time."""
    ends = F.concat(gone, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda i: i + 1))
    return F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, b - a)))


def line_dedup(docs: DataFrame, *, least_chars: int = 40, least_docs: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text without the lines that other documents keep: ``doc_id, n_lines, n_dropped, kept``.

    A line's key is the stripped line in lower case.  Keys of ``least_chars`` code points or more that ``least_docs`` documents
    hold lose all their lines but those of the document of largest id; all other lines stay, in place.

    Long lines go into a table as (128-bit hash of the key, document, place).  Documents per hash are counted in
    two steps, first per hash and document, so a line that all documents share is added up before it meets.  Hashes over the threshold
    come back to their lines (``join_facts``: the few that hold most lines by broadcast, others by hash), and a document gets one
    list of places to leave out, by which its lines are put together again.

    Null and empty texts have one empty line.  Rows that share an id are one document, cut each by its own text; rows without
    id are one document, smaller than all others.  Exact copies of a row give equal rows.  An empty table gives none.
    Other columns are ignored, whatever their names.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("row_"))
    places = F.filter(
        F.transform(lines_of(F.col("text")), lambda line, i: F.struct(line_key(line).alias("key"), i.alias("at"))),
        lambda x: F.length(x["key"]) >= least_chars,
    )
    exploded = rows.select("doc_id", "row_", F.explode(places).alias("p"))
    at = written(exploded.select(F.unhex(F.md5("p.key")).alias("h"), "doc_id", "row_", F.col("p.at").alias("at")), "line-hashes")
    held = at.groupBy("h", "doc_id").agg(F.count("*").alias("n")).groupBy("h")
    common = held.agg(F.count("*").alias("docs_"), F.max("doc_id").alias("keeper_"), F.sum("n").alias("lines_")).where(F.col("docs_") >= least_docs)
    found = join_facts(at, written(common, "line-common"), ["h"], "lines_").where(~F.col("doc_id").eqNullSafe(F.col("keeper_")))
    gone = found.groupBy("doc_id", "row_").agg(F.array_sort(F.collect_set("at")).alias("gone_")).select(F.col("doc_id").alias("id_"), F.col("row_").alias("r_"), "gone_")
    joined = rows.join(gone, (rows["row_"] == gone["r_"]) & rows["doc_id"].eqNullSafe(gone["id_"]), "left")
    lines, places = lines_of(F.col("text")), F.coalesce("gone_", F.array().cast("array<int>"))
    kept = F.when(F.col("gone_").isNull(), F.col("text")).otherwise(F.array_join(_without(F.col("lines_"), F.col("gone_")), "\n"))
    return joined.withColumn("lines_", lines).select(
        "doc_id", F.size("lines_").cast("long").alias("n_lines"), F.size(places).cast("long").alias("n_dropped"), kept.alias("kept"),
    )


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 40 code points or more in 5 or more ``documents`` stay in the document of largest id only."""
    return line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))
