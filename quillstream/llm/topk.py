"""Exact top-k inner-product search: ball-tree branch and bound per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Rows of a ball-tree leaf.
LEAF = 48


class BallTree:
    """A binary tree of balls over integer vectors; nodes hold a centre and a radius."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.vectors = ids, vectors
        self.order = np.arange(len(ids))
        self.nodes: list[tuple[int, int, int, int]] = []  # first row, end, left child, right child
        centres, radii = [], []
        todo = [(0, len(ids), -1, 0)]
        points = vectors.astype(np.float64)
        while todo:
            a, b, parent, side = todo.pop()
            here = len(self.nodes)
            if parent >= 0:
                node = list(self.nodes[parent])
                node[2 + side] = here
                self.nodes[parent] = tuple(node)
            rows = points[self.order[a:b]]
            centre = rows.mean(axis=0)
            far = np.sqrt(((rows - centre) ** 2).sum(axis=1))
            self.nodes.append((a, b, -1, -1))
            centres.append(centre)
            radii.append(far.max())
            if b - a > LEAF and far.max() > 0:
                # split between the row farthest from the centre and the row farthest from that one
                one = rows[far.argmax()]
                two = rows[((rows - one) ** 2).sum(axis=1).argmax()]
                along = rows @ (two - one)
                middle = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(along, middle)]
                todo += [(a, a + middle, here, 0), (a + middle, b, here, 1)]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def search(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, list, list]:
        """For each query up to ``k`` best (score, id) with score >= its ``floor``; the row with id ``own`` is left out.

        Nodes are opened by their upper bound (query . centre + |query| radius); search ends when no bound reaches the
        current k-th score, which starts at the floor that other shards have found.
        """
        q = queries.astype(np.float64)
        norms = np.sqrt((q * q).sum(axis=1))
        bounds = q @ self.centres.T + norms[:, None] * self.radii
        bounds += 1e-6 * (1 + np.abs(bounds) + norms[:, None] * np.sqrt((self.centres**2).sum(axis=1)))  # above rounding
        counts, ids, scores = np.zeros(len(q), dtype=np.int64), [], []
        for i in range(len(q)):
            best: list[tuple[int, int]] = []  # (score, -id), smallest first
            least = floor[i]
            heap = [(-bounds[i, 0], 0)]
            while heap:
                bound, node = heapq.heappop(heap)
                if -bound < least:
                    break
                a, b, left, right = self.nodes[node]
                if left >= 0:
                    heapq.heappush(heap, (-bounds[i, left], left))
                    heapq.heappush(heap, (-bounds[i, right], right))
                    continue
                rows = self.order[a:b]
                got = self.vectors[rows] @ queries[i]
                at = np.flatnonzero((got >= least) & (self.ids[rows] != own[i]))
                for s, r in zip(got[at].tolist(), self.ids[rows[at]].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (s, -r))
                    elif (s, -r) > best[0]:
                        heapq.heapreplace(best, (s, -r))
                if len(best) == k:
                    least = max(least, best[0][0])
            counts[i] = len(best)
            scores += [s for s, _ in best]
            ids += [-r for _, r in best]
        return counts, ids, scores


_HITS = "query_id long, vec_id long, score long"


def _whole_numbers(rows: pd.Series) -> np.ndarray:
    """Integer vectors, wide enough that no inner product overflows."""
    out = np.stack(rows.to_numpy())
    most = float(np.abs(out).max()) if out.size else 0.0
    return out.astype(np.int64) if most * most * max(1, out.shape[1]) < 2**62 else np.array([[int(x) for x in r] for r in out], dtype=object)


def _search(k: int):
    def run(key: tuple, queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries) or not len(shard):
            return empty
        vectors = _whole_numbers(shard["vector"])
        sought = _whole_numbers(queries["vector"])
        tree = BallTree(shard["vec_id"].to_numpy(), vectors)
        floor = queries["floor"].to_numpy(dtype="float64", na_value=-np.inf)
        counts, ids, scores = tree.search(sought, queries["vec_id"].to_numpy(), floor, k)
        long = 2**63
        scores = [min(max(s, -long), long - 1) for s in scores]
        return pd.DataFrame({"query_id": np.repeat(queries["vec_id"].to_numpy(), counts), "vec_id": ids, "score": scores}).astype("int64")

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    scale: int = 1024,
    shard_rows: int = 4096,
    block_rows: int = 1024,
) -> DataFrame:
    """The ``k`` candidates of highest integer inner product for every query row, exactly.

    Components become floor(scale * x).  Rows are dealt by a hash of the id into shards of about ``shard_rows`` rows, queries into
    blocks of about ``block_rows``.  First each query block is searched in one shard, which gives every query a k-th score; then
    in all other shards with that score as the floor, so that most balls are never opened.  A query never finds its own id;
    ties go to the smaller id.

    Returns ``query_id, rank (from 1), vec_id, score``.  Rows with a null id, a null vector, or null or non-finite components
    take no part; a vector is only compared with vectors as long as itself; rows that repeat an id are candidates
    each, but the query among them is the first; an empty table gives no rows.  Other columns are ignored.
    """
    x = F.transform(F.col(vector_col), lambda v: F.floor(v.cast("double") * scale).cast("double"))
    good = ~F.exists(F.col(vector_col), lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & good).select(
        F.col(id_col).cast("long").alias("vec_id"), x.alias("vector"), is_query.alias("is_query_"), F.size(vector_col).alias("dim")
    )
    rows = written(rows.where("dim > 0"), "topk-vectors")
    # as many shards and blocks as the counts ask for; one row per vector length
    sizes = rows.groupBy("dim").agg(F.count("*").alias("n"), F.sum(F.col("is_query_").cast("long")).alias("m"))
    sizes = sizes.select(
        "dim",
        F.ceil(F.col("n") * F.col("dim") / (shard_rows * 64)).cast("int").alias("shards"),
        F.greatest(F.lit(1), F.ceil(F.coalesce("m", F.lit(0)) / block_rows)).cast("int").alias("blocks"),
    )
    placed = rows.join(sizes, "dim")
    candidates = placed.withColumn("shard", F.pmod(F.xxhash64("vec_id"), "shards").cast("int"))
    queries = placed.where("is_query_").groupBy("dim", "shards", "blocks", "vec_id").agg(F.min("vector").alias("vector"))
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), "blocks").cast("int")), "topk-queries")
    keys = ["dim", "shard", "block"]

    def round_(queries: DataFrame, shards: str, blocks: str) -> DataFrame:
        asked = queries.select("dim", F.explode(F.expr(shards)).alias("shard"), "block", "vec_id", "vector", "floor")
        met = candidates.select("dim", "shard", F.explode(F.expr(blocks)).alias("block"), "vec_id", "vector")
        hits = asked.groupBy(*keys).cogroup(met.groupBy(*keys)).applyInPandas(_search(k), _HITS)
        return written(hits, "topk-hits")

    # each block's first shard is the one of its own number
    near = round_(queries.withColumn("floor", F.lit(None).cast("double")), "array(block % shards)", "filter(sequence(0, blocks - 1), b -> b % shards = shard)")
    floors = near.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("floor"))
    floors = floors.withColumnRenamed("query_id", "vec_id")
    far = round_(
        queries.join(floors, "vec_id", "left"),
        "filter(sequence(0, shards - 1), s -> s <> block % shards)",
        "filter(sequence(0, blocks - 1), b -> b % shards <> shard)",
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        near.unionByName(far).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best rows of ``embeddings`` for every row whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
