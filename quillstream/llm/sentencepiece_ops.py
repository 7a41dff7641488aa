"""SentencePiece encoding and decoding from a relational lattice of pieces.

Words' bounded-length substrings are joined to the piece table; the hits are the edges of the word's lattice, grouped by word
and folded into its best path: by Viterbi for a unigram model, by merging for a BPE model (whose scores are merge ranks, so
that a path of highest sum isn't its segmentation).
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
#: Words: newlines, and runs of spaces with what follows.  No piece has a space behind another character, or a newline.
_WORDS = f"\\n|{SPACE}*[^{SPACE}\\n]+|{SPACE}+"
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words encoded inside a task that it remembers at most.
REMEMBERED = 250_000


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol-buffer message: number and value (bytes for strings, messages and floats)."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, message[at : at + size]
            at += size


@dataclass(frozen=True)
class PieceModel:
    """Pieces of a model file: text, score and kind by id, and whether paths are unigram or BPE."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[int, ...]
    unigram: bool

    @staticmethod
    def load(path: str) -> PieceModel:
        """Read a model file on the driver; models that rewrite characters are refused."""
        with open(path, "rb") as f:
            return PieceModel.parse(f.read())

    @staticmethod
    def parse(content: bytes) -> PieceModel:
        pieces, scores, kinds, model_type = [], [], [], 1
        for field, value in _fields(content):
            if field == 1:
                own = dict(_fields(value))
                pieces.append(own.get(1, b"").decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, _NORMAL))
            elif field == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif field == 3 and dict(_fields(value)).get(2):
                raise NotImplementedError("the model normalises characters")
        if model_type not in (1, 2):
            raise NotImplementedError("only unigram and BPE models")
        if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for p, k in zip(pieces, kinds, strict=True) if k == _NORMAL):
            raise NotImplementedError("pieces that cross words")
        return PieceModel(tuple(pieces), tuple(scores), tuple(kinds), model_type == 1)

    @property
    def normal(self) -> list[int]:
        return [i for i, k in enumerate(self.kinds) if k == _NORMAL]

    @property
    def bytes_(self) -> list[int]:
        """Ids of the 256 byte pieces; the unknown piece where the model has none."""
        unknown = self.kinds.index(_UNKNOWN) if _UNKNOWN in self.kinds else 0
        own = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == _BYTE}
        return [own.get(b, unknown) for b in range(256)]

    @property
    def unknown_score(self) -> float:
        return min((self.scores[i] for i in self.normal), default=0.0) - 10.0

    def table(self, spark: SparkSession) -> DataFrame:
        """``piece, piece_id, piece_score``: as many rows as the vocabulary."""
        return spark.createDataFrame([(self.pieces[i], i, self.scores[i]) for i in self.normal], "piece string, piece_id int, piece_score double")


def lattice(words: DataFrame, model: PieceModel) -> DataFrame:
    """``word, edges``: all pieces in each distinct word, as (start from 1, size, score, id).

    The vocabulary is broadcast: its size is the model's, whatever the corpus.
    """
    longest = max((len(model.pieces[i]) for i in model.normal), default=1)
    n = F.length("word")
    spans = words.select("word", F.explode(F.sequence(F.lit(1), n)).alias("start")).select(
        "word", "start", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), n - F.col("start") + 1))).alias("size")
    )
    hits = spans.withColumn("piece", F.substring("word", F.col("start"), F.col("size"))).join(F.broadcast(model.table(words.sparkSession)), "piece")
    edge = F.struct("start", "size", F.col("piece_score").alias("score"), F.col("piece_id").alias("id"))
    grouped = hits.groupBy("word").agg(F.collect_list(edge).alias("edges"))
    none = F.array().cast("array<struct<start:int,size:int,score:double,id:int>>")
    return words.join(grouped, "word", "left").select("word", F.coalesce("edges", none).alias("edges"))


def _byte_ids(character: Column, model: PieceModel) -> Column:
    """Ids of the bytes of a character that no piece has."""
    ids = F.array(*[F.lit(i) for i in model.bytes_])
    pairs = F.regexp_extract_all(F.hex(F.encode(character, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(pairs, lambda p: F.get(ids, F.conv(p, 16, 10).cast("int")))


def viterbi(model: PieceModel) -> Column:
    """Fold over the ends of a word: the best path to each, then the way back from the last."""
    step = "struct<score:double,start:int,id:int>"

    def to(best: Column, end: Column) -> Column:
        into = F.filter("edges", lambda e: e["start"] + e["size"] == end)
        # the largest score wins, of equals the smallest start
        tries = F.transform(into, lambda e: F.struct((F.get(best, e["start"] - 1)["score"] + e["score"]).alias("score"), (-e["start"]).alias("start"), e["id"].alias("id")))
        alone = F.exists(into, lambda e: e["size"] == 1)
        byte = F.struct((F.get(best, end - 2)["score"] + model.unknown_score).alias("score"), (1 - end).alias("start"), F.lit(-1).alias("id"))
        win = F.array_max(F.when(alone, tries).otherwise(F.concat(tries, F.array(byte))))
        return F.concat(best, F.array(F.struct(win["score"].alias("score"), (-win["start"]).alias("start"), win["id"].alias("id")).cast(step)))

    n = F.length("word")
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("start"), F.lit(0).alias("id")).cast(step))
    best = F.aggregate(F.sequence(F.lit(2), n + 1), start, to)
    path = F.aggregate(
        F.sequence(n, F.lit(1), F.lit(-1)),
        F.struct((n + 1).alias("at"), F.array().cast("array<struct<start:int,id:int>>").alias("path"), best.alias("best")),
        lambda acc, _: F.when(acc["at"] <= 1, acc).otherwise(
            F.struct(
                F.get(acc["best"], acc["at"] - 1)["start"].alias("at"),
                F.concat(F.array(F.struct(F.get(acc["best"], acc["at"] - 1)["start"].alias("start"), F.get(acc["best"], acc["at"] - 1)["id"].alias("id"))), acc["path"]).alias("path"),
                acc["best"].alias("best"),
            )
        ),
    )["path"]
    return F.flatten(F.transform(path, lambda p: F.when(p["id"] >= 0, F.array(p["id"])).otherwise(_byte_ids(F.substring(F.col("word"), p["start"], F.lit(1)), model))))


def merging(model: PieceModel) -> Column:
    """Fold over the lattice's boundaries: each step takes away the boundary inside the best edge that spans two symbols."""
    n = F.length("word")

    def step(bounds: Column, _: Column) -> Column:
        at = lambda e: F.array_position(bounds, e["start"]).cast("int")
        fits = F.filter("edges", lambda e: (at(e) > 0) & (F.get(bounds, at(e) + 1) == e["start"] + e["size"]))
        tries = F.transform(fits, lambda e: F.struct((-e["score"]).alias("score"), e["start"].alias("start"), F.get(bounds, at(e)).alias("middle")))
        best = F.array_min(tries)["middle"]
        return F.when(best.isNull(), bounds).otherwise(F.array_remove(bounds, F.coalesce(best, F.lit(0))))

    bounds = F.aggregate(F.sequence(F.lit(1), n), F.sequence(F.lit(1), n + 1), step)

    def ids(start: Column, i: Column) -> Column:
        own = F.get(F.filter("edges", lambda e: (e["start"] == start) & (e["start"] + e["size"] == F.get(F.col("bounds"), i + 1))), F.lit(0))["id"]
        return F.when(own.isNotNull(), F.array(own)).otherwise(_byte_ids(F.substring(F.col("word"), start, F.lit(1)), model))

    return bounds, F.flatten(F.transform(F.slice("bounds", 1, F.size("bounds") - 1), ids))


def encode_words(words: DataFrame, model: PieceModel) -> DataFrame:
    """``word, ids`` of distinct non-empty words, from their lattices."""
    edges = lattice(words, model)
    if model.unigram:
        return edges.select("word", viterbi(model).alias("ids"))
    bounds, ids = merging(model)
    return edges.withColumn("bounds", bounds).select("word", ids.alias("ids"))


def merge_symbols(word: str, score: dict[str, float]) -> list[str]:
    """Symbols of a word by merging; a heap where the word is long."""
    parts = list(word)
    get, none = score.get, float("-inf")
    if len(parts) <= 512:
        pairs = [get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while pairs:
            most = max(pairs)
            if most == none:
                break
            i = pairs.index(most)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
        return parts
    after = [*range(1, len(parts)), -1]
    before = list(range(-1, len(parts) - 1))
    heap = [(-s, i, a + b) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if (s := get(a + b, none)) != none]
    heapq.heapify(heap)
    while heap:
        _, i, both = heapq.heappop(heap)
        j = after[i]
        if j < 0 or not parts[i] or parts[i] + parts[j] != both:
            continue
        parts[i], parts[j], after[i] = both, "", after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] >= 0 and (s := get(parts[a] + parts[after[a]], none)) != none:
                heapq.heappush(heap, (-s, a, parts[a] + parts[after[a]]))
    return [p for p in parts if p]


def best_path(word: str, score: dict[str, float], longest: int, unknown: float) -> list[str]:
    """Pieces of a word by Viterbi."""
    best = [(0.0, 0)] + [(float("-inf"), 0)] * len(word)
    for end in range(1, len(word) + 1):
        win = (float("-inf"), 0)
        for start in range(max(0, end - longest), end):
            s = score.get(word[start:end])
            if s is None and start == end - 1:
                s = unknown
            if s is not None and best[start][0] + s > win[0]:
                win = (best[start][0] + s, start)
        best[end] = win
    out, at = [], len(word)
    while at:
        out.append(word[best[at][1] : at])
        at = best[at][1]
    return out[::-1]


class PairTable:
    """Values of pairs of ids, looked up many at a time: open addressing with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        self.bits = max(4, int(len(keys) * 2.5).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, dtype=np.int64), np.zeros(1 << self.bits, dtype=np.int64)
        slot = self._slot(keys)
        left = np.arange(len(keys))
        while len(left):
            _, first = np.unique(slot[left], return_index=True)
            placed = left[first[self.keys[slot[left[first]]] < 0]]
            self.keys[slot[placed]], self.values[slot[placed]] = keys[placed], values[placed]
            left = left[self.keys[slot[left]] != keys[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Value of each pair; 0 for pairs that aren't there or have a negative id."""
        keys = np.where((a >= 0) & (b >= 0), a << 24 | b, -2).ravel()
        slot, out = self._slot(keys), np.zeros(keys.size, dtype=np.int64)
        todo = np.flatnonzero(keys >= 0)
        while len(todo):
            held = self.keys[slot[todo]]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[slot[todo[hit]]]
            todo = todo[~hit & (held >= 0)]
            slot[todo] = (slot[todo] + 1) & ((1 << self.bits) - 1)
        return out.reshape(np.shape(a))


@dataclass(frozen=True)
class _Tables:
    """What a task needs of a model, made once a worker."""

    score: dict[str, float]
    ids: dict[str, bytes]  # little-endian int32
    symbols: np.ndarray  # id of the piece of each code point, -1 without one
    pairs: PairTable
    starts: np.ndarray  # of each id in ``text``
    sizes: np.ndarray
    text: np.ndarray


@lru_cache(maxsize=2)
def _tables(model: PieceModel) -> _Tables:
    score = {model.pieces[i]: model.scores[i] for i in model.normal}
    number = {model.pieces[i]: i for i in model.normal}
    place = {s: k for k, s in enumerate(sorted(set(score.values())), 1)}
    keys, values = [], []
    for piece, i in number.items():
        for cut in range(1, len(piece)):
            left, right = number.get(piece[:cut]), number.get(piece[cut:])
            if left is not None and right is not None:
                keys.append(left << 24 | right)
                values.append(place[score[piece]] << 24 | i)
    symbols = np.full(0x110000, -1, dtype=np.int32)
    for p, i in number.items():
        if len(p) == 1:
            symbols[ord(p)] = i
    raw = [
        p.replace(SPACE, " ").encode() if k == _NORMAL else bytes([int(p[3:5], 16)]) if k == _BYTE else " ⁇ ".encode() if k == _UNKNOWN else b""
        for p, k in zip(model.pieces, model.kinds, strict=True)
    ]
    sizes = np.array([len(x) for x in raw], dtype=np.int64)
    return _Tables(
        score, {p: struct.pack("<i", i) for p, i in number.items()}, symbols, PairTable(np.array(keys, dtype=np.int64), np.array(values, dtype=np.int64)),
        np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(raw), dtype=np.uint8),
    )


def merge_many(words: list[str], t: _Tables) -> list[bytes | None]:
    """Ids (little-endian int32) of many short words by merging, all words a step at a time; None for words that ``merge_symbols`` must take.

    A row holds a word's symbols and the place of each neighbouring pair's merged piece in the order of scores; in each step every
    row merges its leftmost best pair.  Words with a character that has no piece, with two spaces (whose pieces have
    equal scores) or over 32 characters are left out.
    """
    out: list[bytes | None] = [None] * len(words)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    symbols = t.symbols[codes]
    starts = np.cumsum(sizes) - sizes
    doubled = np.zeros(len(codes), dtype=bool)
    doubled[1:] = (codes[1:] == ord(SPACE)) & (codes[:-1] == ord(SPACE))
    bad = np.add.reduceat((symbols < 0) | doubled, starts) > 0 if len(words) else np.zeros(0, dtype=bool)
    for low, high in ((0, 6), (6, 10), (10, 14), (14, 20), (20, 32)):
        mine = np.flatnonzero((sizes > low) & (sizes <= high) & ~bad)
        if not len(mine):
            continue
        column = np.arange(high)
        inside = column < sizes[mine][:, None]
        rows = np.where(inside, symbols[np.minimum(starts[mine][:, None] + column, len(symbols) - 1)], -1).astype(np.int64)
        best = t.pairs.find(rows[:, :-1], rows[:, 1:])
        left = np.arange(len(mine))
        while len(left):
            at = best.argmax(axis=1)
            most = best[np.arange(len(left)), at]
            on = most > 0
            done = rows[~on]
            ids = done[done >= 0].astype("<i4").tobytes()
            ends = (4 * np.cumsum((done >= 0).sum(axis=1))).tolist()
            for w, a, b in zip(mine[left[~on]].tolist(), [0, *ends], ends, strict=False):
                out[w] = ids[a:b]
            left, rows, best, at, most = left[on], rows[on], best[on], at[on], most[on]
            if not len(left):
                break
            here, new = np.arange(len(left)), most & 0xFFFFFF
            rows[here, at] = new
            rows = np.concatenate((np.take_along_axis(rows, column[:-1] + (column[:-1] > at[:, None]), axis=1), np.full((len(left), 1), -1)), axis=1)
            best = np.concatenate((np.take_along_axis(best, column[:-2] + (column[:-2] >= at[:, None]), axis=1), np.zeros((len(left), 1), dtype=np.int64)), axis=1)
            before = at > 0
            best[here[before], at[before] - 1] = t.pairs.find(rows[here[before], at[before] - 1], new[before])
            behind = at < high - 1
            best[here[behind], at[behind]] = t.pairs.find(new[behind], rows[here[behind], at[behind] + 1])
    return out


def _encoder(model: PieceModel, known):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = re.compile(_WORDS)
        t = _tables(model)
        longest, unknown = max(map(len, t.score), default=1), model.unknown_score
        bytes_ = [struct.pack("<i", i) for i in model.bytes_]
        frequent, own = known.value, {}

        def slow(word: str) -> bytes:
            parts = best_path(word, t.score, longest, unknown) if model.unigram else merge_symbols(word, t.score)
            return b"".join([t.ids.get(p) or b"".join([bytes_[b] for b in p.encode("utf-8", "surrogatepass")]) for p in parts])

        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                found = [words.findall(SPACE + text.replace(" ", SPACE)) if text else () for text in batch.column("text").to_pylist()]
                if len(own) >= REMEMBERED:
                    own.clear()
                new = list(set().union(*found) - frequent.keys() - own.keys())
                fast = [None] * len(new) if model.unigram else merge_many(new, t)
                own.update({w: slow(w) if x is None else x for w, x in zip(new, fast, strict=True)})
                flat = [b"".join([frequent.get(w) or own[w] for w in ws]) for ws in found]
                ids = np.frombuffer(b"".join(flat), dtype="<i4")
                cuts = np.cumsum([0, *(len(x) // 4 for x in flat)]).astype(np.int32)
                yield pa.record_batch([batch.column("doc_id"), pa.ListArray.from_arrays(cuts, pa.array(ids)), pa.array(decode_ids(ids, cuts, model), pa.string())], schema=schema)

    return run


def decode_ids(ids: np.ndarray, cuts: np.ndarray, model: PieceModel) -> list[str]:
    """Texts of runs of ids: byte pieces join into characters (broken ones become U+FFFD), the first space goes."""
    t = _tables(model)
    sizes = t.sizes[ids]
    ends = np.cumsum(sizes)
    spread = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(t.starts[ids] - ends + sizes, sizes)
    text = t.text[spread].tobytes()
    at = np.concatenate(([0], ends))[cuts].tolist()
    out = [text[a:b].decode("utf-8", "replace") for a, b in zip(at, at[1:], strict=False)]
    return [x[1:] if x.startswith(" ") else x for x in out]


def decode(tokens: DataFrame, model_path: str = DEFAULT_MODEL, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Text of each row's ids: ``doc_id, text``; null ids give an empty text, ids outside the vocabulary are left out."""
    model = PieceModel.load(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[i for i in x or () if i is not None and 0 <= i < len(model.pieces)] for x in batch.column("ids").to_pylist()]
            cuts = np.cumsum([0, *map(len, rows)])
            texts = decode_ids(np.array([i for r in rows for i in r], dtype=np.int64), cuts, model)
            yield pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    few = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return few.mapInArrow(run, "doc_id long, text string")


def encode(docs: DataFrame, model_path: str = DEFAULT_MODEL, *, id_col: str = "doc_id", text_col: str = "text", dictionary_words: int = 1 << 21) -> DataFrame:
    """Ids of every whole text: ``doc_id, ids, decoded`` (the text that the ids give back).

    Words that occur at least as often as characters / ``dictionary_words`` (so there are at most that many; usually far fewer)
    are encoded once for the corpus from the relational lattice and broadcast; other words take the same path inside the
    task that reads them.  Null and empty texts have no ids; rows are independent, so null ids and repeated rows
    stay; characters that no piece has become bytes; an empty table gives no rows.  Other columns are ignored.
    """
    model = PieceModel.load(model_path)
    few = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    size = few.agg(F.coalesce(F.sum(F.length("text").cast("long")), F.lit(0)).alias("n")).first()["n"]
    least = max(2, -(-size // dictionary_words))
    escaped = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    split = F.regexp_extract_all(escaped, F.lit(_WORDS), F.lit(0))
    counts = few.where(F.length("text") > 0).select(F.explode(split).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    # longer words than these are not worth a lattice of rows
    frequent = counts.where((F.col("n") >= least) & (F.length("word") <= 64)).select("word")
    known = {r["word"]: np.array(r["ids"], dtype="<i4").tobytes() for r in encode_words(frequent, model).collect()}
    return few.mapInArrow(_encoder(model, docs.sparkSession.sparkContext.broadcast(known)), "doc_id long, ids array<int>, decoded string")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded, and whether decoding gives it back."""
    docs = table(spark, sf_dir, "documents")
    return encoded_documents(docs)


def encoded_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256`` of every document."""
    return encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
