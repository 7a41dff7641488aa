"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of code points other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master that names none (tests, a single machine) a fresh local folder is made and set, so that
    ``checkpoint()`` works too; elsewhere executors could not see it, so that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quillstream-")
        spark.conf.set("spark.checkpoint.dir", path)
        spark.sparkContext.setCheckpointDir(path)
    return path


_scopes: list[list[tuple[SparkSession, str]]] = []


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append((spark, path))
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables that ``written`` makes inside are deleted at the end, but for those that the given function writes.

    A lazy result that leaves must read no other table made inside.
    """

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        kept = _scopes[-1].pop()
        if len(_scopes) > 1:
            _scopes[-2].append(kept)
        return out

    _scopes.append([])
    try:
        yield keep
    finally:
        for spark, path in _scopes.pop():
            _delete(spark, path)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``written`` that nothing reads any more."""
    for df in tables:
        for name in df.inputFiles()[:1]:
            spark = df.sparkSession
            path = spark._jvm.org.apache.hadoop.fs.Path(name).getParent()
            if path.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark)).toUri().getPath()):
                _delete(spark, path.toString())


#: A key with more than this part of all rows is joined by broadcast: there are fewer than this many such keys.
HEAVY = 1000


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], n_col: str) -> DataFrame:
    """Inner join of ``rows`` with one row of facts per key, where a few keys may hold most rows.

    ``n_col`` of the facts says how many rows a key has, so at most ``HEAVY`` keys have a ``HEAVY``-th of all rows: these facts are
    broadcast and their rows stay where they are; all others are joined by key as the optimiser likes.  Both inputs are
    read twice and should be written tables.  Keys must not be null.
    """
    total = facts.agg(F.coalesce(F.sum(n_col), F.lit(0)).alias("n")).first()["n"]
    heavy = F.broadcast(facts.where(F.col(n_col) * HEAVY > total))
    light = facts.where(F.col(n_col) * HEAVY <= total)
    rest = rows.join(F.broadcast(facts.where(F.col(n_col) * HEAVY > total).select(*keys)), keys, "left_anti")
    return rows.join(heavy, keys).unionByName(rest.join(light, keys))


#: Bits of a bitmap of keys: for each key, and at most (32 MB).
KEY_BITS, MOST_BITS = 32, 1 << 28
#: Bits of a row of it, which Spark's bitmap functions fix.
ROW_BITS = 1 << 15


def likely(rows: DataFrame, wanted: DataFrame, key: str, wanted_key: str | None = None) -> DataFrame:
    """The rows whose ``key`` is among the keys of ``wanted``, and about one in 250 of the others; the rows stay where they are.

    Two bits for each wanted key are broadcast as a bitmap, so wide rows that nothing wants are not shuffled.  More
    keys than ``MOST_BITS`` has room for (an eighth of the bits) are met by an exact semi join instead.  ``wanted`` is read
    twice and should be a written table; its keys may repeat.  Null keys are dropped.
    """
    keys = wanted.select(F.col(wanted_key or key).alias("key_"))
    n = keys.count()
    if 8 * n > MOST_BITS:
        return rows.join(keys, rows[key] == keys["key_"], "left_semi")
    chunks = max(1, min(MOST_BITS, max(16 * ROW_BITS, KEY_BITS * n)) // ROW_BITS)
    spots = lambda c: [F.pmod(F.shiftright(F.xxhash64(c), by), F.lit(ROW_BITS)) for by in (0, 20)]
    chunk = lambda c: F.pmod(F.shiftright(F.xxhash64(c), 40), F.lit(chunks))
    told = keys.where("key_ is not null").select(chunk("key_").alias("chunk_"), F.explode(F.array(*spots("key_"))).alias("spot_"))
    bitmap = told.repartition("chunk_").groupBy("chunk_").agg(F.bitmap_construct_agg("spot_").alias("bits_"))
    byte = lambda at: F.conv(F.hex(F.substring(F.col("bits_"), (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
    held = [F.getbit(byte(at), F.pmod(at, F.lit(8)).cast("int")) == 1 for at in spots(key)]
    met = rows.withColumn("chunk_", chunk(key)).where(F.col(key).isNotNull()).join(F.broadcast(bitmap), "chunk_")
    return met.where(held[0] & held[1]).select(*rows.columns)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def null_last_key(col: Column) -> Column:
    """A non-null string that orders and groups as ``col`` does with nulls last."""
    return F.when(col.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), col.cast("string")))


def seeded_hash(col: Column, seed: str) -> Column:
    """60 bits of MD5 over the seed and the value (null: empty text), as a long.

    MD5 rather than a Spark hash, so that any SQL engine can repeat the order.
    """
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(col.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
