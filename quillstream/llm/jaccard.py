"""Exact n-gram Jaccard join as a blocked sparse matrix product.

Rows of the incidence matrix are distinct shingle sets, columns are shingle hashes.  Two sets of sizes a and b link if they
share at least p (a + b) / (100 + p) columns, so each lacks at most e = n - ceil(p n / 100) of its own n columns in the other.
The product is taken where it can be that large, and nowhere else:

1. *Columns of one row go first.*  Of any e + l columns taken in one order over all rows, two linked rows share l.  Each row sends
   its least e + l hashes; a row of which fewer than l have a second row leaves.  Columns that several rows of
   one slice hold are counted there and sent once, so a frequent column sends as many rows as there are slices.
2. *Rarity.*  All columns of the rows left are counted.  Columns of one row come first in the order by count, then by hash; a row
   with more than e of them leaves, and the columns up to place e + 1 are the row's part of the product.
3. *Product by rounds.*  Each column offers its first rows as pivots (1, then 16, 256, ...).  The product goes row by row: a row
   unites the pivots of its columns that are not connected with it yet, so a pair is one entry however many columns it
   shares.  Columns of one row, which surely differ, and 256 parity bits of all others bound the overlap from above; for pairs
   within the bound it is accumulated over the columns block by block until it is reached or out of reach.
   Links join components, and columns whose rows lie in one component are finished.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, join_facts, likely, scratch, table, written
from .components import connected_components
from .shingles import mix, shingle_sets

#: Column blocks over which the overlap of a pair is accumulated.
PRODUCT_BLOCKS = 8
#: Entries in which a task looks for columns that several of its rows share.
SLICE_ENTRIES = 1 << 20
#: Rows of one column that a task multiplies with the column's pivots.
PART_ROWS = 4096
#: Pivots of one column that are united in one go, about.
GO_PIVOTS = 256
_PARITY = ["p1", "p2", "p3", "p4"]
_FACTS = ["doc_id", "label", "n", "alone", *_PARITY]


def lacking(n: int, percent: int) -> int:
    """Most of the ``n`` columns of a row that a linked row can lack."""
    return n * (100 - percent) // 100


def sure(n: int, percent: int) -> int:
    """How many of a row's first ``lacking + sure`` columns each linked row has among its own first."""
    e = lacking(n, percent)
    return min(n - e, e // 2 + 1)


def parity(keys: Column, word: int) -> Column:
    """64 of 256 bits, each the parity of the keys that hash to it: two sets differ in as many keys as bits at least."""
    none = F.lit(0).cast("long")
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(63).cast("int"))
    return F.aggregate(keys, none, lambda odd, x: odd.bitwiseXOR(F.when(F.shiftright(x, 6).bitwiseAND(3) == word, bit(x)).otherwise(none)))


def _slices(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[tuple[list[int], pa.RecordBatch, list[np.ndarray]]]:
    """Places in the batch, the batch and the sets of runs of rows with about ``SLICE_ENTRIES`` entries."""
    for batch in batches:
        places, sets, held = [], [], 0
        for i, values in enumerate(shingle_sets(batch.column("text"), k)):
            places.append(i)
            sets.append(values)
            held += len(values)
            if held >= SLICE_ENTRIES:
                yield places, batch, sets
                places, sets, held = [], [], 0
        if places:
            yield places, batch, sets


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values.astype(np.int64)))


def fingerprints(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, in two signed numbers."""
    spread = mix(values ^ np.uint64(0x5851F42D4C957F2D))
    return int(values.sum(dtype=np.uint64).astype(np.int64)), int(spread.sum(dtype=np.uint64).astype(np.int64))


def _told(places: list[int], batch: pa.RecordBatch, sets: list[np.ndarray]) -> list[np.ndarray]:
    """The sets, but for those of other rows of an id: where a batch names an id's fingerprints, its set has these."""
    named = zip(*(batch.column(c).take(pa.array(places)).to_pylist() for c in ("f1", "f2")), strict=True)
    return [v if e[0] is None or fingerprints(v) == e else v[:0] for v, e in zip(sets, named, strict=True)]


def _rows(k: int, percent: int):
    names = ["doc_id", "n", "f1", "f2", "credit"]
    schema = pa.schema([(c, pa.int64()) for c in names] + [("of_slice", pa.bool_()), ("keys", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places, batch, sets in _slices(batches, k):
            least = [v[: lacking(len(v), percent) + sure(len(v), percent)] for v in sets]
            flat, row = np.concatenate(least), np.repeat(np.arange(len(sets)), [len(v) for v in least])
            _, which, times = np.unique(flat, return_inverse=True, return_counts=True)
            local = times[which] > 1
            prints = np.array([fingerprints(v) for v in sets], dtype=np.int64)
            credit = np.bincount(row[local], minlength=len(sets))
            own = np.bincount(row[~local], minlength=len(sets))
            columns = [pa.array(x, pa.int64()) for x in ([len(v) for v in sets], *prints.T, credit)]
            rows = [batch.column("doc_id").take(pa.array(places)), *columns, pa.array(np.zeros(len(sets), dtype=bool)), _lists(flat[~local], own)]
            yield pa.record_batch(rows, schema=schema)
            again = np.unique(flat[local])
            yield pa.record_batch([pa.nulls(1, pa.int64())] * len(names) + [pa.array([True]), _lists(again, np.array([len(again)]))], schema=schema)

    return run


def _entries(k: int):
    """A row for every column of a slice: the column, a row that has it, and the other rows of the slice that do."""
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("more", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places, batch, sets in _slices(batches, k):
            sets = _told(places, batch, sets)
            flat, docs = np.concatenate(sets), np.repeat(batch.column("doc_id").to_numpy()[places], [len(v) for v in sets])
            order = np.argsort(flat, kind="stable")
            flat, docs = flat[order], docs[order]
            first = np.ones(len(flat), dtype=bool)
            first[1:] = flat[1:] != flat[:-1]
            others = np.diff(np.append(np.flatnonzero(first), len(flat))) - 1
            yield pa.record_batch([pa.array(flat[first].astype(np.int64)), pa.array(docs[first]), _lists(docs[~first], others)], schema=schema)

    return run


def _blocks(k: int):
    """Each set cut into column blocks, which are equal ranges of the hash."""
    edges = (np.arange(1, PRODUCT_BLOCKS, dtype=np.float64) * (2.0**64 / PRODUCT_BLOCKS)).astype(np.uint64)
    schema = pa.schema([("doc_id", pa.int64()), ("blocks", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for places, batch, sets in _slices(batches, k):
            kept = [(i, v) for i, v in zip(places, _told(places, batch, sets), strict=True) if len(v)]
            if not kept:
                continue
            places, sets = [list(x) for x in zip(*kept, strict=True)]
            cuts = np.array([np.concatenate(([0], np.searchsorted(v, edges), [len(v)])) for v in sets])
            blocks = _lists(np.concatenate(sets), np.diff(cuts, axis=1).ravel())
            outer = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1) * PRODUCT_BLOCKS, pa.int32()), blocks)
            yield pa.record_batch([batch.column("doc_id").take(pa.array(places)), outer], schema=schema)

    return run


def accumulated(x: Column, y: Column, need: Column) -> Column:
    """Overlap of two sets summed over their column blocks; -1 as soon as the blocks still to come can't bring it to ``need``."""

    def add(acc: Column, i: Column) -> Column:
        a, b = F.get(x, i), F.get(y, i)
        rest = acc["rest"] - F.least(F.size(a), F.size(b))
        return F.when(acc["got"] + acc["rest"] < need, F.struct(F.lit(-1).alias("got"), F.lit(0).alias("rest"))).otherwise(
            F.struct((acc["got"] + F.size(F.array_intersect(a, b))).alias("got"), rest.alias("rest"))
        )

    most = F.aggregate(F.sequence(F.lit(0), F.lit(PRODUCT_BLOCKS - 1)), F.lit(0), lambda n, i: n + F.least(F.size(F.get(x, i)), F.size(F.get(y, i))))
    start = F.struct(F.lit(0).alias("got"), most.alias("rest"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(PRODUCT_BLOCKS - 1)), start, add)["got"]


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (with the sum ``n`` of their sizes) whose overlap is as large as their sizes require; only sets of the pairs are shuffled."""
    of = lambda c, s: likely(sets, pairs.select(c).distinct(), "doc_id", c).select(F.col("doc_id").alias(c), F.col("blocks").alias(s))
    need = F.expr(f"cast((n * {percent} + {99 + percent}) div {100 + percent} as int)")
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", accumulated(F.col("x"), F.col("y"), need).alias("overlap"), need.alias("need"))
    return both.where("overlap >= need").select("a", "b")


def _entering(texts: DataFrame, distinct: DataFrame, k: int, percent: int) -> DataFrame:
    """Each row of the product: ``doc_id, n``, ``alone`` (how many of its columns no other row has), parity bits of all others, and
    ``columns`` (``rows_, key``) with which it enters, in its order by rarity.

    ``distinct`` has ``doc_id, n`` of the rows; ``texts`` may hold more, whose columns count in the order, which any one order
    may be.
    """
    entries = texts.mapInArrow(_entries(k), "key long, doc_id long, more array<long>")
    counted = entries.withColumn("rows_", F.sum(F.array_size("more") + 1).over(Window.partitionBy("key"))).where("rows_ > 1")
    shared = counted.select("key", "rows_", F.explode(F.concat(F.array("doc_id"), "more")).alias("doc_id"))
    # a row's columns in order: those that it has alone (no entry here), then by count and hash
    ordered = shared.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("rows_", "key"))).alias("c_"))
    ordered = ordered.join(distinct.select("doc_id", "n"), "doc_id").withColumn("alone", F.col("n") - F.size("c_"))
    lack = F.expr(f"n * {100 - percent} div 100")
    bits = [parity(F.col("c_.key"), word).alias(c) for word, c in enumerate(_PARITY)]
    return ordered.where(F.col("alone") <= lack).select("doc_id", "n", "alone", *bits, F.slice("c_", 1, (lack + 1 - F.col("alone")).cast("int")).alias("columns"))


def within(x: Column, y: Column, percent: int) -> Column:
    """Whether two rows may overlap as much as their sizes require; each has ``n, alone`` and parity bits.  A link is never ruled out."""
    both = x["n"] + y["n"]
    # a column that a row has alone is one in which they differ
    differ = sum((F.bit_count(x[c].bitwiseXOR(y[c])) for c in _PARITY), x["alone"] + y["alone"])
    enough = lambda most: most * (100 + percent) >= both * percent
    return enough(F.least(x["n"] - x["alone"], y["n"] - y["alone"])) & enough(F.floor((both - differ) / 2))


def _meeting(now: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """``a, b, n``: each row ``b`` with each smaller pivot ``a`` of its columns that is not connected with it and within the bound, once."""
    spread = chosen.select("key", "go", "ps", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    row = {c: F.col(c) for c in _FACTS}
    apart = lambda p: (p["doc_id"] < row["doc_id"]) & (p["label"] != row["label"]) & within(p, row, percent)
    pair = lambda p: F.struct(p["doc_id"].alias("a"), (p["n"] + row["n"]).alias("n"))
    met = now.join(spread, ["key", "part"]).select("doc_id", "go", F.transform(F.filter("ps", apart), pair).alias("ps")).where(F.size("ps") > 0)
    met = met.groupBy("doc_id", "go").agg(F.collect_set("ps").alias("ps")).select("doc_id", F.explode(F.array_distinct(F.flatten("ps"))).alias("p"))
    return met.select("p.a", F.col("doc_id").alias("b"), "p.n")


def jaccard_join(docs: DataFrame, *, percent: int = 90, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Component of every document under links of Jaccard similarity ``percent`` / 100 or more.

    Sets are the distinct ``k``-word shingles of the lower-cased (A-Z) whole text.  Equal sets collapse to their smallest id.
    Every pair of rows that can link meets in a column, where one of them becomes a pivot before the other leaves, so
    each pair is multiplied unless links connect it already: a group of n near copies costs about n
    products, and no link between components is lost.

    Returns ``doc_id, n_shingles, component_id``: one row per input row.  Null or wordless texts have no shingles
    and link with nothing; rows with a null id link with nothing and have a null component; rows that share
    an id are one document (where their texts differ, the one with the largest set and fingerprint counts); an empty table gives no rows.
    Other columns are ignored.
    """
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    with scratch() as keep:
        return keep(_components(docs, percent, k, id_col, text_col), "jaccard-result")


def _components(docs: DataFrame, percent: int, k: int, id_col: str, text_col: str) -> DataFrame:
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = few.where(F.col("doc_id").isNotNull() & (F.length("text") > 0))
    numbers = ["n", "f1", "f2", "credit"]
    rows = few.mapInArrow(_rows(k, percent), "doc_id long, " + ", ".join(f"{c} long" for c in numbers) + ", of_slice boolean, keys array<long>")
    rows = written(rows, "jaccard-rows")
    all_ids = written(rows.where("not of_slice").select("doc_id", *numbers), "jaccard-ids")

    # 1. columns of one row go: sharing few of its least columns, a row leaves
    sent = rows.where("of_slice or doc_id is not null").select("doc_id", F.explode("keys").alias("key"))
    second = sent.withColumn("rows_", F.count("*").over(Window.partitionBy("key"))).where("rows_ > 1 and doc_id is not null")
    met = second.groupBy("doc_id").agg(F.count("*").alias("met"))
    lack = f"n * {100 - percent} div 100"
    able = all_ids.where("doc_id is not null and n > 0").join(met, "doc_id", "left").where(f"credit + coalesce(met, 0) >= least(n - {lack}, {lack} div 2 + 1)")
    able = able.groupBy("doc_id").agg(F.max(F.struct("n", "f1", "f2")).alias("s_")).select("doc_id", "s_.*")
    about = written(able, "jaccard-able")
    distinct = about.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))
    distinct = written(distinct, "jaccard-distinct")
    discard(rows)

    # 2. the rows' rarest columns
    of_id = all_ids.where("doc_id is not null").groupBy("doc_id")
    several = of_id.agg(F.min(F.struct("n", "f1", "f2")).alias("least"), F.max(F.struct("n", "f1", "f2")).alias("most")).where("least <> most")
    several = written(several.select("doc_id").join(distinct.select("doc_id", "f1", "f2"), "doc_id"), "jaccard-several")
    texts = written(likely(named, distinct, "doc_id").join(several, "doc_id", "left"), "jaccard-texts")
    nodes = written(_entering(texts, distinct, k, percent), "jaccard-nodes")
    sets = likely(texts, nodes, "doc_id").mapInArrow(_blocks(k), "doc_id long, blocks array<array<long>>")
    sets = written(sets.groupBy("doc_id").agg(F.first("blocks").alias("blocks")), "jaccard-sets")
    discard(texts)

    # 3. product by rounds of pivots
    parts = F.ceil(F.col("c_.rows_") / PART_ROWS).cast("int")
    facts = nodes.drop("columns")
    members = nodes.select(*facts.columns, F.explode("columns").alias("c_")).select(F.col("c_.key").alias("key"), parts.alias("parts"), *facts.columns)
    members = members.withColumn("part", F.expr("pmod(xxhash64(doc_id), parts)").cast("int"))
    labels = nodes.select(F.col("doc_id").alias("node"), F.col("doc_id").alias("label"))
    tested = None
    pivots = 1
    while True:
        now = members.withColumn("label", F.col("doc_id")) if tested is None else members.join(labels.withColumnRenamed("node", "doc_id"), "doc_id").join(facts, "doc_id")
        now = written(now, "jaccard-now")
        first = F.min(F.struct(*_FACTS)).alias("p")
        open_ = now.groupBy("key").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), first, F.first("parts").alias("parts")).where("l1 < l2")
        if pivots == 1:
            chosen = open_.select("key", "parts", F.lit(0).alias("go"), F.array("p").alias("ps"))
        else:
            ranked = now.withColumn("r_", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))).where(F.col("r_") <= pivots)
            ranked = ranked.join(open_.select("key"), "key").withColumn("go", F.expr(f"pmod(xxhash64(doc_id), {max(1, pivots // GO_PIVOTS)})").cast("int"))
            chosen = ranked.groupBy("key", "parts", "go").agg(F.collect_list(F.struct(*_FACTS)).alias("ps"))
        chosen = written(chosen, "jaccard-pivots")
        if chosen.isEmpty():
            break
        pairs = written(_meeting(now, chosen, percent), "jaccard-pairs")
        if tested is not None:
            pairs, found = written(pairs.join(tested, ["a", "b"], "left_anti"), "jaccard-pairs"), pairs
            discard(found)
        done = pairs.select("a", "b")
        tested = done if tested is None else tested.unionByName(done)
        labels = connected_components(written(_linked(pairs, sets, percent), "jaccard-links"), labels)
        # rows behind the pivots of a column that was open stay
        last = chosen.groupBy("key", "parts").agg(F.max(F.array_max(F.col("ps.doc_id"))).alias("last"))
        last = last.select("key", "last", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        members, before = written(now.select("key", "parts", "part", "doc_id").join(last, ["key", "part"]).where("doc_id > last").drop("last"), "jaccard-members"), members
        discard(now, chosen)
        if pivots > 1:
            discard(before)
        pivots *= 16

    component = distinct.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    component = written(component.select("n", "f1", "f2", F.coalesce("label", "doc_id").alias("component_id"), "copies"), "jaccard-components")
    # a row that is not able has no link, and no equal row
    found = join_facts(about, component, ["n", "f1", "f2"], "copies").select("doc_id", "component_id")
    out = all_ids.select("doc_id", F.col("n").alias("n_shingles")).join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all ``documents`` at Jaccard 0.9 over 3-word shingles."""
    return jaccard_join(table(spark, sf_dir, "documents"))
