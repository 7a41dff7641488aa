"""Removal of repeated passages by a common-prefix-aware distributed merge sort of suffixes.

Every window of ``length`` bytes has an anchor: its 16-byte gram of least hash, the leftmost of equals.  Equal windows
have equal anchors at equal places.  Consecutive windows with one anchor form a block, and a block is one suffix
(from its anchor on) with its left context, so the suffixes to sort are the anchors' rather than one for every byte.

1. Blocks meet by anchor, each as a fingerprint of its bytes.  Those of an anchor that lies in one document only leave.  Of equal
   blocks only that of the smallest document stays, since all windows of the others are in a smaller one; so a passage
   that many documents share whole is one suffix.  An anchor with one block needs no sorting.
2. Each task sorts the suffixes of its documents that are left into a run and
   front-codes the run: the length of the prefix shared with the suffix before, and the rest.
3. Runs are exchanged by a hash of the anchor and merged by a loser tree that carries common-prefix lengths:
   two suffixes whose lengths of common prefix with the last winner differ are ordered by these alone, others are
   compared behind that prefix.
4. In merged order, suffixes with one anchor are neighbours.  Windows that reach no farther than the common prefix with a
   neighbour are looked up by their bytes; those that a smaller document has too are removed.

Suffixes of an anchor with very many blocks go through steps 2 to 4 window by window, dealt by a
hash of the window, so that one frequent passage is spread over all tasks.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written
from .shingles import mix, utf8_slices

#: Bytes of an anchor's gram.
GRAM = 16

_rng = np.random.Generator(np.random.PCG64(977))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Blocks:
    """Blocks of a slice of texts: start, windows, anchor place, anchor hash, fingerprint and row of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, length: int) -> None:
        n, width = len(data), length - GRAM + 1
        self.start = self.windows = self.place = self.row = np.zeros(0, dtype=np.int64)
        self.anchor = self.print_ = np.zeros(0, dtype=np.uint64)
        if n < length:
            return
        back = _powers(_INVERSE, n + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * _powers(_BASE, n), out=sums[1:])
        grams = mix((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
        least = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while step * 2 <= width:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        if width > step:
            least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
        # windows that start at p and end inside the row of p
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(least)]
        ok = np.arange(len(least)) + length <= offsets[row + 1]
        place = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.empty(len(least), dtype=bool)
        first[:1] = True
        first[1:] = (place[1:] != place[:-1]) | ~ok[:-1]
        start = np.flatnonzero(first & ok)
        if not len(start):
            return
        # a block ends where the next begins or where windows stop fitting
        stops = np.flatnonzero(first | ~ok)
        after = np.searchsorted(stops, start, side="right")
        ends = np.append(stops, len(least))[after]
        self.start, self.windows, self.place, self.row = start, ends - start, place[start], row[start]
        self.anchor = grams[self.place] >> np.uint64(16)
        tails = ends + length - 1
        self.print_ = mix((sums[tails] - sums[start]) * back[start] + (tails - start).astype(np.uint64)) >> np.uint64(8)


#: Blocks among which a task looks for equal ones.
SLICE_BLOCKS = 1 << 20
#: What a document's list says of a block: a smaller document has it, or it is to be sorted (window by window if hot).
GONE, COLD, HOT = 0, 1, 2


def _found(length: int, bits: int):
    """Distinct blocks of a slice: ``key`` (anchor, even), fingerprint, smallest document; and the others', which are gone.

    What is gone needs to meet nothing but its own document's list, so its (odd) key is the document's: a line that all documents
    share has as many keys as documents.
    """
    schema = pa.schema([("key", pa.int64()), ("print", pa.int64()), ("doc_id", pa.int64())])

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        anchor, print_, doc = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((doc, print_, anchor))
        anchor, print_, doc = anchor[order], print_[order], doc[order]
        block = np.ones(len(order), dtype=bool)
        block[1:] = (anchor[1:] != anchor[:-1]) | (print_[1:] != print_[:-1])
        new = block.copy()
        new[1:] |= doc[1:] != doc[:-1]
        least = doc[np.flatnonzero(block)][np.cumsum(block) - 1] == doc
        own = (mix(doc.astype(np.uint64)) >> np.uint64(24)).astype(np.int64)
        key = np.where(least, anchor << 1, own << 1 | 1)
        order = np.argsort(doc[new], kind="stable")  # runs of one document pack better
        return pa.record_batch([pa.array(x[new][order]) for x in (key, print_, doc)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            held, n = [], 0
            for at, _, data, offsets in utf8_slices(batch.column("text")):
                b = Blocks(data, offsets, length)
                if len(b.row):
                    held.append(((b.anchor >> np.uint64(48 - bits)).astype(np.int64), b.print_.astype(np.int64), ids[at + b.row].astype(np.int64)))
                    n += len(b.row)
                if n >= SLICE_BLOCKS:
                    yield flush(held)
                    held, n = [], 0
            if held:
                yield flush(held)

    return run


def _blocks_of_documents(long: DataFrame, length: int, bits: int, hot_blocks: int) -> DataFrame:
    """``doc_id, blocks``: fingerprints of a document's blocks that matter, four times, plus what is to be done with each."""
    found = long.mapInArrow(_found(length, bits), "key long, print long, doc_id long")
    dealt = found.repartition("key").sortWithinPartitions("key", "print", "doc_id")
    of_anchor, of_block = Window.partitionBy("key"), Window.partitionBy("key", "print")
    said = (
        F.when((F.col("key") % 2 == 1) | (F.col("doc_id") > F.col("owner")), GONE)
        .when((F.col("low") < F.col("high")) & (F.col("first") < F.col("last")), F.when(F.col("n") >= hot_blocks, HOT).otherwise(COLD))
    )
    told = (
        dealt.withColumn("low", F.min("doc_id").over(of_anchor)).withColumn("high", F.max("doc_id").over(of_anchor))
        .withColumn("first", F.min("print").over(of_anchor)).withColumn("last", F.max("print").over(of_anchor))
        .withColumn("n", F.count("*").over(of_anchor)).withColumn("owner", F.min("doc_id").over(of_block))
        .select("doc_id", (F.col("print") * 4 + said).alias("b")).where("b is not null")
    )
    return told.groupBy("doc_id").agg(F.collect_list("b").alias("blocks"))


def common_prefix(x: bytes, y: bytes, known: int) -> int:
    """Length of the common prefix of two strings that share ``known`` bytes."""
    a, b = x[known:], y[known:]
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return known + n - (differ.bit_length() + 7) // 8


Entry = tuple[bytes, bytes, int, int, int, int]  # suffix, left context, windows, first window, document, fingerprint


def _pack(*columns: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(b"".join(c if isinstance(c, bytes) else c.tobytes() for c in columns))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def front_coded(entries: list[Entry]) -> bytes:
    """A sorted run as one packed string, column by column: of each suffix only what follows the prefix it shares with the one before."""
    shared, rests, last = bytearray(), [], b""
    for e in entries:
        n = common_prefix(last, e[0], 0)
        shared.append(n)
        rests.append(e[0][n:])
        last = e[0]
    column = lambda j, kind: np.array([e[j] for e in entries], dtype=kind)
    lefts = [e[1] for e in entries]
    return _pack(
        struct.pack("<q", len(entries)), bytes(shared), bytes(map(len, rests)), bytes(map(len, lefts)), column(2, np.uint8), column(3, np.uint8),
        column(4, np.int64), column(5, np.uint64), b"".join(rests), b"".join(lefts),
    )


def decoded(run: bytes) -> Iterator[tuple[int, Entry]]:
    """The entries of a front-coded run, each with its common prefix with the one before."""
    raw = _unpack(run)
    n = struct.unpack_from("<q", raw)[0]
    shared, rest, left, windows, first = (raw[8 + j * n : 8 + (j + 1) * n] for j in range(5))
    docs = np.frombuffer(raw, np.int64, n, 8 + 5 * n).tolist()
    prints = np.frombuffer(raw, np.uint64, n, 8 + 13 * n).tolist()
    a = 8 + 21 * n
    b, last = a + sum(rest), b""
    for j in range(n):
        last = last[: shared[j]] + raw[a : a + rest[j]]
        a += rest[j]
        yield shared[j], (last, raw[b : b + left[j]], windows[j], first[j], docs[j], prints[j])
        b += left[j]


def merged(runs: list[bytes]) -> Iterator[tuple[int, Entry]]:
    """All entries of sorted runs in order, each with its common prefix with the one before: a loser tree of prefix lengths.

    A node keeps the loser of its game and the length of the prefix which that loser shares with the winner.  The last winner's
    successor brings its own length from the front coding.  Longer shared prefix with the last winner wins
    unseen; only equals are compared, from there on.
    """
    streams = [decoded(r) for r in runs]
    k = 1
    while k < max(1, len(streams)):
        k *= 2
    heads: list[tuple[int, Entry] | None] = [next(s, None) for s in streams] + [None] * (k - len(streams))
    shared = [0 if h is not None else -1 for h in heads]  # with the last winner
    losers = [0] * k

    def play(i: int, j: int) -> tuple[int, int]:
        """Winner and loser of a game; sets the loser's length."""
        a, b = shared[i], shared[j]
        if a != b:
            return (i, j) if a > b else (j, i)
        if a < 0:
            return i, j
        x, y = heads[i][1][0], heads[j][1][0]
        h = common_prefix(x, y, a)
        if x[h : h + 1] <= y[h : h + 1]:
            shared[j] = h
            return i, j
        shared[i] = h
        return j, i

    def build(node: int) -> int:
        if node >= k:
            return node - k
        winner, losers[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        entry = heads[winner][1]
        yield shared[winner], entry
        heads[winner] = nxt = next(streams[winner], None)
        shared[winner] = nxt[0] if nxt is not None else -1
        node = (winner + k) // 2
        while node:
            other = losers[node]
            a, b = shared[winner], shared[other]
            if a > b:
                pass
            elif a < b:
                losers[node], winner = winner, other
            else:
                winner, losers[node] = play(winner, other)
            node //= 2


def removed_windows(group: list[Entry], reach: list[int], length: int) -> Iterator[tuple[int, int, int]]:
    """(document, fingerprint, mask) of the windows that a smaller document has too, in suffixes of one anchor.

    ``reach``: the longer of the common prefixes with the suffix before and after.  A window of a block lies a bytes left
    of the anchor and length - a bytes from it on; where that is more than the reach, no other block has it.
    """
    first: dict[tuple[bytes, bytes], int] = {}
    for e in group:
        key = (e[1], e[0])
        if first.get(key, e[4]) >= e[4]:
            first[key] = e[4]
    holders: dict[bytes, int] = {}
    several = len(first) > 1
    if several:
        for (suffix, left, windows, _, doc, _), r in zip(group, reach, strict=True):
            if doc == first[left, suffix]:
                whole = left + suffix
                for j in range(windows):
                    if length - (len(left) - j) > r:
                        break
                    w = whole[j : j + length]
                    if holders.get(w, doc) >= doc:
                        holders[w] = doc
    for (suffix, left, windows, at, doc, fingerprint), r in zip(group, reach, strict=True):
        if first[left, suffix] < doc:
            yield doc, fingerprint, ((1 << windows) - 1) << at
        elif several:
            whole, mask = left + suffix, 0
            for j in range(windows):
                if length - (len(left) - j) > r:
                    break
                if holders[whole[j : j + length]] < doc:
                    mask |= 1 << j
            if mask:
                yield doc, fingerprint, mask << at


def _runs(length: int, parts: int, run_entries: int):
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("run", pa.binary())])

    def flush(by_part: dict[int, list[Entry]], windows: dict[tuple[bytes, int], set[tuple[int, int]]]) -> Iterator[pa.RecordBatch]:
        gone: dict[int, list[tuple[int, int, int]]] = {}
        for (w, j), holders in windows.items():
            # the holders of the smallest document stay; from the others a smaller document takes the window
            least, part = min(holders)[0], int.from_bytes(hashlib.blake2b(w, digest_size=6).digest(), "big") % parts
            for doc, fingerprint in holders:
                if doc == least:
                    by_part.setdefault(part, []).append((w, b"", 1, j, doc, fingerprint))
                else:
                    gone.setdefault(doc % parts, []).append((doc, fingerprint, 1 << j))
        rows: list[tuple[int, int, bytes]] = []
        for part, own in by_part.items():
            own.sort(key=itemgetter(0))
            rows.append((part, 0, front_coded(own)))
        for part, own in gone.items():
            docs, prints, masks = zip(*sorted(own), strict=True)
            rows.append((part, 1, _pack(struct.pack("<q", len(own)), np.array(docs, dtype=np.int64), np.array(prints, dtype=np.uint64), np.array(masks, dtype=np.uint64))))
        by_part.clear()
        windows.clear()
        for i in range(0, len(rows), 1000):
            part, kind, run = zip(*rows[i : i + 1000], strict=True)
            yield pa.record_batch([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(run, pa.binary())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[Entry]] = {}
        windows: dict[tuple[bytes, int], set[tuple[int, int]]] = {}
        held = 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            known = batch.column("blocks")
            cuts = known.offsets.to_numpy()
            values = known.values.to_numpy(zero_copy_only=False)
            for at, rows, data, offsets in utf8_slices(batch.column("text")):
                sought = [values[cuts[at + r] : cuts[at + r + 1]] for r in range(rows)]
                sought = [np.sort(v[(v & 3) != GONE]) for v in sought]
                if not any(map(len, sought)):
                    continue
                b = Blocks(data, offsets, length)
                raw = data.tobytes()
                bounds = np.searchsorted(b.row, np.arange(rows + 1))
                for r in np.flatnonzero([len(v) > 0 for v in sought]).tolist():
                    lo, hi, mine = bounds[r], bounds[r + 1], sought[r]
                    print_, which = np.unique(b.print_[lo:hi].astype(np.int64), return_index=True)  # a block that comes again is one
                    spot = np.minimum(np.searchsorted(mine >> 2, print_), len(mine) - 1)
                    hit = np.flatnonzero(mine[spot] >> 2 == print_)
                    i = lo + which[hit]
                    doc = int(ids[at + r])
                    columns = (b.start[i], b.windows[i], b.place[i], b.anchor[i] % np.uint64(parts), print_[hit], mine[spot[hit]] & 3)
                    for s, k, q, part, fingerprint, what in zip(*(c.tolist() for c in columns), strict=True):
                        if what == COLD:
                            by_part.setdefault(part, []).append((raw[q : s + k - 1 + length], raw[s:q], k, 0, doc, fingerprint))
                            held += 1
                        else:
                            for j in range(k):
                                windows.setdefault((raw[s + j : s + j + length], j), set()).add((doc, fingerprint))
                            held += k
                if held >= run_entries:
                    yield from flush(by_part, windows)
                    held = 0
        yield from flush(by_part, windows)

    return run


def _merge(length: int):
    def run(key: tuple, blobs: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, int]] = []
        for blob in blobs.loc[blobs["kind"] == 1, "run"]:
            raw = _unpack(blob)
            n = struct.unpack_from("<q", raw)[0]
            columns = (np.frombuffer(raw, kind, n, 8 + 8 * n * j).tolist() for j, kind in enumerate((np.int64, np.uint64, np.uint64)))
            found += zip(*columns, strict=True)
        group: list[Entry] = []
        shared: list[int] = []

        def close() -> None:
            if len(group) > 1:
                reach = [max(a, b) for a, b in zip([0, *shared[1:]], [*shared[1:], 0], strict=True)]
                found.extend(removed_windows(group, reach, length))

        for n, entry in merged(list(blobs.loc[blobs["kind"] == 0, "run"])):
            if n < GRAM:
                close()
                group, shared = [], []
            group.append(entry)
            shared.append(n)
        close()
        docs, prints, masks = zip(*found, strict=True) if found else ((), (), ())
        return pd.DataFrame({
            "doc_id": np.array(docs, dtype=np.int64), "print": np.array(prints, dtype=np.uint64).astype(np.int64), "mask": np.array(masks, dtype=np.uint64).astype(np.int64),
        })

    return run


def _marked(length: int, with_text: bool, carried: bool):
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + [("kept", pa.string())] * with_text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in schema]  # a row for each of the batch, in its order
            marks, blocks = batch.column("marks"), batch.column("blocks")
            cuts, ends = marks.offsets.to_numpy(), blocks.offsets.to_numpy()
            prints = marks.values.field("print").to_numpy(zero_copy_only=False)
            masks = marks.values.field("mask").to_numpy(zero_copy_only=False)
            values = blocks.values.to_numpy(zero_copy_only=False)
            ids = batch.column("doc_id").to_pylist()
            for at, rows, data, offsets in utf8_slices(batch.column("text")):
                touched = cuts[at + rows] > cuts[at] or ends[at + rows] > ends[at]
                b = Blocks(data if touched else data[:0], offsets, length)
                bounds = np.searchsorted(b.row, np.arange(rows + 1))
                for r in range(rows):
                    text = data[offsets[r] : offsets[r + 1]]
                    lo, hi, x, y = bounds[r], bounds[r + 1], cuts[at + r], cuts[at + r + 1]
                    whole = values[ends[at + r] : ends[at + r + 1]]
                    whole = whole[(whole & 3) == GONE] >> 2
                    gone = np.zeros(len(text), dtype=bool)
                    if hi > lo and (y > x or len(whole)):
                        known, inverse = np.unique(np.concatenate((prints[x:y], whole)), return_inverse=True)
                        bits = np.zeros(len(known), dtype=np.int64)
                        np.bitwise_or.at(bits, inverse, np.concatenate((masks[x:y], np.full(len(whole), -1, dtype=np.int64))))
                        mine = b.print_[lo:hi].astype(np.int64)
                        spot = np.minimum(np.searchsorted(known, mine), len(known) - 1)
                        hit = np.flatnonzero(known[spot] == mine)
                        spread = np.arange(length, dtype=np.int64)
                        on = (bits[spot[hit]][:, None] >> spread) & (spread < b.windows[lo:hi][hit][:, None])
                        which, j = np.nonzero(on)
                        p = b.start[lo:hi][hit[which]] + j - offsets[r]
                        step = np.zeros(len(text) + 1, dtype=np.int64)
                        np.add.at(step, p, 1)
                        np.add.at(step, p + length, -1)
                        gone = np.cumsum(step[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
                    kept = text[~gone].tobytes()
                    row = [ids[at + r], len(text), int(gone.sum()), edge.tolist(), hashlib.sha256(kept).hexdigest()]
                    if with_text:
                        row.append(kept.decode("utf-8", "ignore"))
                    for c, v in zip(out, row, strict=True):
                        c.append(v)
            columns = [pa.array(c, f.type) for c, f in zip(out, schema, strict=True)]
            if carried:
                yield pa.record_batch([*columns, batch.column("carried")], names=[*schema.names, "carried"])
            else:
                yield pa.record_batch(columns, schema=schema)

    return run


def suffix_dedup(
    docs: DataFrame, *, length: int = 50, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False,
    carry: list[str] | None = None, hot_blocks: int = 4096, part_bytes: int = 16 << 20, run_entries: int = 250_000,
) -> DataFrame:
    """Each whole text without the bytes covered by a ``length``-byte string that also starts in a smaller document.

    Returns ``doc_id, n_bytes, n_removed, spans (removed byte ranges: start, end, start, end, ...), kept_sha256`` and, if asked for, ``kept``
    (the remaining bytes as text; characters cut in two are dropped) and ``carried``, a struct of the columns named by ``carry``.  Matches never cross documents and are judged on the
    input.  Null or short texts lose nothing; rows with a null id lose nothing and take nothing; rows that share an id
    are one document to each other: they take nothing from each other; an empty table gives no rows.  Other columns are ignored.

    ``hot_blocks``: an anchor with at least so many blocks is handled window by window.  ``part_bytes``: text per
    merge partition.  ``run_entries``: suffixes that a task holds before it writes a sorted run.
    """
    if not GRAM < length <= 63:
        raise ValueError(f"length must be from {GRAM + 1} to 63")
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *([F.struct(*[docs[c] for c in carry]).alias("carried")] if carry else []))
    own = few.columns
    long = few.select("doc_id", "text").where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= length))
    size = long.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    parts = max(48, -(-size // part_bytes))
    # wide enough that few anchors meet by chance: an anchor for every 18 bytes or so, 4 values for every byte
    bits = min(48, max(16, size.bit_length() + 2))

    blocks = written(_blocks_of_documents(long, length, bits, hot_blocks), "suffix-blocks")
    # both joins read one and the same shuffle of the texts by id: for the runs, and again for the cutting
    texts = few.where("doc_id is not null")
    runs = texts.join(blocks, "doc_id").select(*own, "blocks").mapInArrow(_runs(length, parts, run_entries), "part int, kind int, run binary")
    marks = runs.groupBy("part").applyInPandas(_merge(length), "doc_id long, print long, mask long")

    per_doc = marks.groupBy("doc_id").agg(F.collect_list(F.struct("print", "mask")).alias("marks"))
    no_block = F.array().cast("array<bigint>")
    none = F.array().cast("array<struct<print:bigint,mask:bigint>>")
    ready = texts.join(blocks, "doc_id", "left").join(per_doc, "doc_id", "left").select(*own, F.coalesce("blocks", no_block).alias("blocks"), F.coalesce("marks", none).alias("marks"))
    nameless = few.where("doc_id is null").select(*own, no_block.alias("blocks"), none.alias("marks"))
    schema = "doc_id long, n_bytes long, n_removed long, spans array<long>, kept_sha256 string" + (", kept string" if with_text else "")
    if carry:
        schema += f", carried {few.schema['carried'].dataType.simpleString()}"
    cut = lambda df: df.mapInArrow(_marked(length, with_text, bool(carry)), schema)
    return cut(ready).unionByName(cut(nameless))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` without the 50-byte strings that smaller documents have."""
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), "kept_sha256")
