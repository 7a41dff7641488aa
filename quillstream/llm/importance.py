"""Importance resampling towards a target distribution, over hashed word features."""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Bytes as words have them: A-Z in lower case, other ASCII but for letters and digits as a space.
_AS_WORDS = bytes(c if c >= 128 or chr(c) in string.ascii_lowercase + string.digits else c + 32 if chr(c) in string.ascii_uppercase else 32 for c in range(256))
#: Longest row of a CRC matrix; longer features go on in blocks of this many bytes.
WIDTH = 256


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


_TABLE = _crc_table()


def _updated(crc: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """CRC registers after the bytes of each row, column by column."""
    for column in matrix.T:
        crc = _TABLE[(crc ^ column) & 0xFF] ^ (crc >> 8)
    return crc


def _past_zeros(n: int) -> list[np.ndarray]:
    """Tables of what each of a register's four bytes becomes over ``n`` zero bytes (the update is linear)."""
    zeros = np.zeros((256, n), dtype=np.uint8)
    return [_updated(np.arange(256, dtype=np.uint32) << (8 * k), zeros) for k in range(4)]


_PAST = _past_zeros(WIDTH)


def crc32s(features: Sequence[bytes]) -> np.ndarray:
    """CRC-32 of each of many byte strings.

    Strings of equal length are the rows of one uint8 matrix, whose CRCs are updated together, a column a step, and
    scattered back to their strings.  A string longer than ``WIDTH`` has its first length modulo ``WIDTH`` bytes there; its
    further blocks of ``WIDTH`` bytes are rows of one more matrix, updated from zero, and join by linearity.
    """
    lengths = np.fromiter(map(len, features), dtype=np.int64, count=len(features))
    heads = lengths % WIDTH
    out = np.full(len(features), 0xFFFFFFFF, dtype=np.uint32)
    order = np.argsort(heads, kind="stable")
    cuts = np.flatnonzero(np.diff(heads[order])) + 1
    for group in np.split(order, cuts):
        n = int(heads[group[0]]) if len(group) else 0
        if n:
            rows = np.frombuffer(b"".join([features[i][:n] for i in group]), dtype=np.uint8).reshape(-1, n)
            out[group] = _updated(out[group], rows)
    for i in np.flatnonzero(lengths >= WIDTH):
        blocks = np.frombuffer(features[i], dtype=np.uint8, offset=int(heads[i])).reshape(-1, WIDTH)
        crc = int(out[i])
        for own in _updated(np.zeros(len(blocks), dtype=np.uint32), blocks).tolist():
            crc = int(_PAST[0][crc & 255] ^ _PAST[1][crc >> 8 & 255] ^ _PAST[2][crc >> 16 & 255] ^ _PAST[3][crc >> 24]) ^ own
        out[i] = crc
    return out ^ np.uint32(0xFFFFFFFF)


def text_words(text: str | None) -> list[bytes]:
    """UTF-8 words of a whole text: runs of a-z (A-Z in lower case), digits and all beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_AS_WORDS).split()


def feature_buckets(texts: Sequence[str | None], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words per text, features per text, and the buckets of all features (of words, then of pairs, text by text)."""
    words = [text_words(t) for t in texts]
    n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = np.empty(int(n_words.sum()), dtype=object)
    flat[:] = [w for ws in words for w in ws]
    codes, kinds = pd.factorize(flat)
    owner = np.repeat(np.arange(len(texts)), n_words)
    inside = owner[:-1] == owner[1:] if len(owner) else np.zeros(0, dtype=bool)
    pairs, pair_kinds = pd.factorize((codes[:-1].astype(np.int64) * max(1, len(kinds)) + codes[1:])[inside])
    first, second = pair_kinds // max(1, len(kinds)), pair_kinds % max(1, len(kinds))
    features = list(kinds) + [b"%b %b" % (kinds[a], kinds[b]) for a, b in zip(first.tolist(), second.tolist(), strict=True)]
    own = (crc32s(features) % buckets).astype(np.int32)
    every = np.concatenate((own[codes], own[len(kinds) + pairs])) if len(flat) else np.zeros(0, dtype=np.int32)
    owners = np.concatenate((owner, owner[:-1][inside])) if len(flat) else owner
    by_text = np.argsort(owners, kind="stable")
    return n_words, np.bincount(owners, minlength=len(texts)), every[by_text]


#: Texts are worked on together up to this many characters, so a task's dictionary of features is bounded.
CHUNK_CHARS = 1_500_000


def _chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= CHUNK_CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _hashed(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for start, end in _chunks(texts):
                n_words, n_features, flat = feature_buckets(texts[start:end], buckets)
                offsets = np.concatenate(([0], np.cumsum(n_features))).astype(np.int32)
                yield pa.record_batch(
                    [batch.column("doc_id").slice(start, end - start), pa.array(n_words), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                    names=["doc_id", "n_words", "buckets"],
                )

    return run


def hashed_features(docs: DataFrame, buckets: int, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, n_words, buckets`` of each whole text: one bucket for each run of one or two words."""
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return few.mapInArrow(_hashed(buckets), "doc_id long, n_words long, buckets array<int>")


def _flat(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("buckets").flatten().to_numpy(zero_copy_only=False)


def bucket_counts(features: DataFrame, buckets: int) -> np.ndarray:
    """Features per bucket: added up where the rows are, ``buckets`` rows to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            n += np.bincount(_flat(batch), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for row in features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row["bucket"]] = row["n"]
    return out


def bucket_gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of each bucket's smoothed share in the target to that in the raw texts, floored."""
    k = float(len(raw))
    up = (target + 1).astype(np.float64) * (float(raw.sum()) + k)
    down = (raw + 1).astype(np.float64) * (float(target.sum()) + k)
    return np.floor(1000 * np.log(up / down)).astype(np.int64)


def _weighed(gains: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("buckets")
            n = np.diff(lists.offsets.to_numpy()).astype(np.int64)
            upto = np.concatenate(([0], np.cumsum(gains[_flat(batch)])))
            ends = np.cumsum(n)
            weight = (upto[ends] - upto[ends - n]) // np.maximum(n, 1)
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_words"), pa.array(n), pa.array(weight)], names=["doc_id", "n_words", "n_features", "weight"])

    return run


def importance_resample(
    docs: DataFrame, target: DataFrame, *, percent: int = 25, least_words: int = 20, buckets: int = 10_000, seed: int = 7,
    id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
) -> DataFrame:
    """Draw ``percent`` of the documents of ``least_words`` words or more, without replacement, by importance towards ``target``.

    Returns ``doc_id, n_words, n_features, weight, score, rank`` of every row.  Features are runs of one or two words,
    hashed by CRC-32 into ``buckets``.  A document's weight is the floored mean of its features' gains (see ``bucket_gains``), its score the
    weight plus seeded Gumbel noise; the highest scores are drawn (ties: smaller id, then fewer features), and ``rank`` numbers them.

    Whole texts are hashed once, into a table of buckets; bucket counts are added up per task and only ``buckets`` rows leave.  Ranks come
    from one distributed sort: each part's rows are numbered in place and moved by the parts before it, so no task sees all rows.

    Null and empty texts have no features, weight 0 and too few words to be drawn; a null id is hashed as empty text and
    comes last among ties; repeated rows are rows, which may be drawn each.  An empty target gives the weights of the smoothed counts
    alone; an empty table gives no rows.  Other columns are ignored, whatever their names.
    """
    hashed = written(hashed_features(docs, buckets, id_col, text_col), "importance-features")
    wanted = hashed_features(target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_col).alias("text")), buckets, "doc_id", "text")
    gains = bucket_gains(bucket_counts(hashed, buckets), bucket_counts(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    weighed = hashed.mapInArrow(_weighed(gains), "doc_id long, n_words long, n_features long, weight long")
    scored = written(weighed.withColumn("score", F.col("weight") + noise), "importance-scores")

    enough = scored.where(F.col("n_words") >= least_words).withColumn("salt_", F.monotonically_increasing_id())
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("salt_")]  # the salt parts even equal rows
    placed = enough.orderBy(*order).withColumn("m_", F.monotonically_increasing_id()).drop("salt_")
    placed = written(placed.withColumn("part_", F.shiftright("m_", 33)).withColumn("i_", F.col("m_").bitwiseAND((1 << 33) - 1)), "importance-order")
    sizes = placed.groupBy("part_").agg(F.count("*").alias("n_"))  # a row for each part of the sort
    before = sizes.select("part_", (F.sum("n_").over(Window.orderBy("part_")) - F.col("n_")).alias("before_"), F.sum("n_").over(Window.partitionBy()).alias("all_"))
    rank = F.col("before_") + F.col("i_") + 1
    drawn = placed.join(F.broadcast(before), "part_").withColumn("rank", F.when(rank * 100 <= F.col("all_") * percent, rank))
    columns = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.select(*columns).unionByName(rest.select(*columns))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the ``documents`` of 20 words or more, drawn towards the words of ``benchmark``."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")
