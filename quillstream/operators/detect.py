"""Bad-output detectors."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from ..functions.text import words

#: Function words of a comma burst.
FUNCTION_WORDS = ("die", "der", "das", "des", "dem", "den", "wobei", "dass", "weil", "wenn", "obwohl")
#: White space as in the reference's patterns: Unicode's.
_SPACE = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters, digits, white space and quotes of a comma list's item; combining marks stand for composed letters.
_ITEM = rf"[\p{{L}}\p{{M}}\p{{N}}_{_SPACE}\u00c0-\u024f\u00ab\u00bb\u201e\u201c\u201a\u2018]"
#: White space as characters, Java's ``\s`` included, to trim by.
_BLANK = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Reason, pattern and strings of which a match holds one (none: the pattern is for the whole of a trimmed text), in order; the first that is found is the reason.
PATTERNS = (
    ("subtitles", rf"[Ss]ubtitles?[{_SPACE}]*(by|created|provided)", ("ubtitle",)),
    ("subtitles", r"[Aa]mara\.org", ("mara.org",)),
    ("subtitles", rf"[Tt]hanks?[{_SPACE}]*for[{_SPACE}]*watching", ("watching",)),
    ("subtitles", rf"[Pp]lease[{_SPACE}]*(like|subscribe|comment)", ("lease",)),
    ("subtitles", rf"[Ss]ubscribe[{_SPACE}]*(to|now|here)", ("ubscribe",)),
    ("repetition", r"(.{5,}?)\1{3,}", ()),  # found by ``loops``, by sorted grams
    ("music", rf"[♪♫]|[Mm]usic[{_SPACE}]*playing", ("♪", "♫", "usic")),
    ("bracketed", r"(?d)\[.*\]", ("[",)),
    ("punctuation", rf"^[{_SPACE}\.\,\!\?]+$", ()),
    ("comma_list", rf"^{_ITEM}++(?:,{_ITEM}++){{4,}}+\.{{0,4}}$", ()),
)


def _repeats(line: str, least: int, times: int) -> Iterator[tuple[int, int]]:
    """(start, period) of blocks of ``least`` characters or more that come ``times`` times in a row; the first start of each run.

    Of grams of length L, a power of two, a repeat of primitive period p <= L has its next occurrence exactly p places on, all along the run; so one
    sort of the grams of each length finds all periods from L / 2 to L.  Periods below ``least`` count by their multiples.
    """
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    n = len(codes)
    for q in range(1, least):
        p = q * -(-least // q)
        if n >= times * p:
            yield from ((s, p) for s, run in _runs(codes[:-q] == codes[q:]) if run + q >= times * p)
    ranks, size = np.unique(codes, return_inverse=True)[1].astype(np.int64), 1
    while 2 * size <= n and n >= times * least:
        ranks = np.unique(ranks[: n - 2 * size + 1] * (n + 1) + ranks[size : n - size + 1], return_inverse=True)[1].astype(np.int64)
        size *= 2
        if size < least:
            continue
        order = np.argsort(ranks, kind="stable")
        follows = np.flatnonzero(ranks[order[1:]] == ranks[order[:-1]])
        ahead = np.zeros(len(ranks), dtype=np.int64)
        ahead[order[follows]] = order[follows + 1] - order[follows]
        ahead[(ahead > size) | (ahead <= size // 2) & (ahead >= least) | (ahead < least)] = 0
        for start, run in _runs((ahead[1:] == ahead[:-1]) & (ahead[1:] > 0)) if len(ahead) > 1 else ():
            # run + 1 places in a row with one period, the last of which reaches size + period on
            if run + 1 + int(ahead[start]) + size - 1 >= times * int(ahead[start]):
                yield start, int(ahead[start])


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), (edges[1::2] - edges[::2]).tolist(), strict=True))


#: Characters that are looked through at once in a task, and rounds of the filter before what is left counts as a candidate; both bear on the time only.
_CHARS_AT_ONCE, _ROUNDS = 1 << 20, 30


def _candidates(codes: np.ndarray, least: int, times: int) -> list[tuple[int, int]]:
    """(start, end) of stretches that may hold a block that comes ``times`` times in a row inside a line; every such block lies in one, starts too.

    All but the last ``least`` - 1 places of all copies but the last of a block of p characters have their gram of ``least`` characters again p places on, so
    no place's next one is further than p, and (times - 1) * p - least + 1 places in a row are of this kind.  Grams are told apart by hashes: equal ones by
    chance may leave more candidates, not fewer.
    """
    n = len(codes) - least + 1
    if n <= 0:
        return []
    upto = np.concatenate(([0], np.cumsum(codes == 10)))
    hashes = upto[:n].astype(np.uint64)
    for j in range(least):
        hashes = hashes * np.uint64(0x9E3779B97F4A7C15) + codes[j : n + j]
        hashes ^= hashes >> np.uint64(29)
    bits = np.uint64(n.bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    places = (hashes * np.uint64(0xBF58476D1CE4E5B9) & ~low | np.arange(n, dtype=np.uint64))[upto[least:] == upto[:n]]
    places.sort()
    at = (places & low).astype(np.int64)
    again = np.flatnonzero((places[1:] ^ places[:-1]) <= low)
    ahead = np.zeros(n, dtype=np.int64)
    ahead[at[again]] = at[again + 1] - at[again]
    at = np.flatnonzero(ahead)
    ahead = ahead[at]
    for _ in range(_ROUNDS):
        edges = np.concatenate(([0], np.flatnonzero(np.diff(at) != 1) + 1, [len(at)]))
        run = np.repeat(np.diff(edges), np.diff(edges))
        stays = (run >= (times - 2) * least + 1) & (ahead * (times - 1) <= run + least - 1)
        if stays.all():
            break
        at, ahead = at[stays], ahead[stays]
    edges = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    lengths = np.diff(edges, append=len(at))
    breaks = np.append(np.flatnonzero(codes == 10), len(codes))
    starts = at[edges]
    ends = np.minimum(starts + lengths + (lengths + least - 1) // (times - 1) + least, breaks[np.searchsorted(breaks, starts)])
    return list(zip(starts.tolist(), ends.tolist(), strict=True))


def loops(texts: Sequence[str | None], least: int = 5, times: int = 4) -> list[tuple[str | None, int | None]]:
    """Of each text the first block of ``least`` characters or more that comes ``times`` times in a row inside a line: all its copies (cut to 200 characters) and its start.

    Of the blocks at that start the shortest one counts.  None where there is no such block.
    """
    joined = "\n".join(t or "" for t in texts)
    begins = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
    best: dict[int, tuple[int, int]] = {}
    for a, b in _candidates(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), least, times):
        i = int(np.searchsorted(begins, a, "right")) - 1
        if i not in best or a <= best[i][0]:
            found = min(_repeats(joined[a:b], least, times), default=None)
            if found is not None:
                best[i] = min(best.get(i, (b, 0)), (a + found[0], found[1]))
    out: list[tuple[str | None, int | None]] = [(None, None)] * len(texts)
    for i, (start, p) in best.items():
        block, end = joined[start : start + p], start + p
        while end < start + 200 and joined.startswith(block, end):
            end += p
        out[i] = joined[start:end][:200], start - int(begins[i])
    return out


def loop(text: str | None, least: int = 5, times: int = 4) -> tuple[str | None, int | None]:
    """``loops`` of one text."""
    return loops([text], least, times)[0]


@F.pandas_udf(StructType([StructField("span", StringType()), StructField("start", IntegerType())]))
def _loops(texts: pd.Series) -> pd.DataFrame:
    found, some, size = [], [], 0
    for t in texts:
        some.append(t)
        size += len(t or "") + 1
        if size >= _CHARS_AT_ONCE:
            found.extend(loops(some))
            some, size = [], 0
    return pd.DataFrame(found + loops(some), columns=["span", "start"]).astype({"start": "Int32"})


def detect_patterns(text: Column, guard: bool = True) -> Column:
    """First reason whose pattern is found in a text of 3 or more characters: ``reason, span, loop_start``, or null.

    ``span`` is the match, cut to 200 characters; ``loop_start`` is where a repetition begins, from 0.  With ``guard`` (a flag
    of the reference), a comma list that is prose is no reason.
    """
    t = F.btrim(text, F.lit(_BLANK))

    def hit(reason: str, pattern: str, parts: tuple[str, ...]) -> Column:
        if reason == "repetition":
            found = _loops(t)
            return F.when(found["span"].isNotNull(), F.struct(F.lit(reason).alias("reason"), found["span"].alias("span"), found["start"].alias("loop_start")))
        inside = text if parts else t  # no match with such a part begins or ends with white space, so the text needs no trimming first
        is_hit = reduce(or_, [text.contains(p) for p in parts]) & text.rlike(pattern) if parts else t.rlike(pattern)
        if reason == "comma_list" and guard:
            is_hit = is_hit & ~prose_guard(t)
        match = F.regexp_extract(inside, pattern, 0)
        return F.when(is_hit, F.struct(F.lit(reason).alias("reason"), F.substring(match, 1, 200).alias("span"), F.lit(None).cast("int").alias("loop_start")))

    return F.when(F.length(t) >= 3, F.coalesce(*[hit(*p) for p in PATTERNS]))


def comma_items(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, ","), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


def _most(items: Column) -> Column:
    """Count of the most frequent element."""
    ordered = F.array_sort(items)
    run = F.aggregate(
        ordered, F.struct(F.lit("").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("most")),
        lambda acc, x: F.struct(
            x.alias("last"), F.when(x == acc["last"], acc["run"] + 1).otherwise(F.lit(1)).alias("run"),
            F.greatest(acc["most"], F.when(x == acc["last"], acc["run"] + 1).otherwise(F.lit(1))).alias("most"),
        ),
    )
    return run["most"]


def prose_guard(text: Column, mean_words: float = 2.5, most_equal: int = 2) -> Column:
    """A comma list of two or more items is prose if no item comes more than ``most_equal`` times and items are long."""
    items = comma_items(text)
    normal = F.transform(items, lambda i: F.array_join(words(F.lower(i)), " "))
    total = F.aggregate(items, F.lit(0), lambda acc, i: acc + F.size(words(i)))
    return (F.size(items) >= 2) & (_most(normal) <= most_equal) & (total >= mean_words * F.size(items))


def comma_burst(text: Column) -> Column:
    """Three commas and four items or more of under 2.5 words, over half of which begin alike or hold a function word."""
    items = comma_items(text)
    n = F.size(items)
    total = F.aggregate(items, F.lit(0), lambda acc, i: acc + F.size(words(i)))
    firsts = F.transform(items, lambda i: F.lower(F.get(words(i), F.lit(0))))
    functional = F.size(F.filter(items, lambda i: F.arrays_overlap(words(F.lower(i)), F.array(*[F.lit(w) for w in FUNCTION_WORDS]))))
    dense = (F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) >= 3) & (n >= 4) & (total < 2.5 * n)
    return F.coalesce(dense & ((_most(firsts) * 2 > n) | (functional * 2 > n)), F.lit(False))


def guillemets(text: Column, most: int = 10) -> Column:
    """More than ``most`` quoted tokens."""
    return F.regexp_count(text, F.lit("[«»„“‚‘][^«»„“‚‘]*?[«»„“‚‘]")) > most


def detect_repetition(df: DataFrame, key: list[str], text: str = "text", least: int = 10) -> DataFrame:
    """Texts of ``least`` or more words with a 3-word phrase more than twice, a 2-word phrase four times, or a word four times running.

    Phrases are token windows (the reference counts substrings), counted per text and phrase before the shuffle.
    """
    rows = df.select(*key, F.posexplode(words(F.col(text))).alias("i", "w"))
    own = Window.partitionBy(*key).orderBy("i")
    nxt = rows.select(*key, "i", "w", *[F.lead("w", j).over(own).alias(f"w{j}") for j in (1, 2, 3)])
    tri = nxt.where("w2 is not null").groupBy(*key, "w", "w1", "w2").agg(F.count("*").alias("c")).groupBy(*key).agg(F.max("c").alias("trigram"))
    bi = nxt.where("w1 is not null").groupBy(*key, F.lower("w").alias("w"), F.lower("w1").alias("w1")).agg(F.count("*").alias("c")).groupBy(*key).agg(F.max("c").alias("bigram"))
    run = nxt.groupBy(*key).agg(F.count("*").alias("n_words"), F.count_if((F.col("w") == F.col("w1")) & (F.col("w1") == F.col("w2")) & (F.col("w2") == F.col("w3"))).alias("runs"))
    out = run.join(tri, key, "left").join(bi, key, "left")
    reason = F.when(F.col("n_words") < least, None).when(F.col("trigram") > 2, "trigram").when(F.col("bigram") >= 4, "bigram").when(F.col("runs") > 0, "word_run")
    return out.select(*key, "n_words", F.coalesce("trigram", F.lit(0)).alias("trigram"), F.coalesce("bigram", F.lit(0)).alias("bigram"), "runs", reason.alias("reason"))


def clean_text(text: Column) -> Column:
    """Trimmed, squeezed text; null if under 3 characters or only marks."""
    t = F.regexp_replace(F.regexp_replace(text, r"\s+", " "), "^ | $", "")
    return F.when((F.length(t) >= 3) & t.rlike(r"[\p{L}\p{N}]"), t)


def source_gates(text: Column) -> Column:
    """reject: over 10 marks with under 40% letters; hold: under 50 characters without a stop; else pass."""
    t = F.regexp_replace(text, r"\s", "")
    letters = F.length(t) - F.length(F.regexp_replace(t, "[a-zA-ZäöüÄÖÜß]", ""))
    trimmed = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when((F.length(t) > 10) & (letters * 10 < F.length(t) * 4), "reject").when(~trimmed.rlike("[.!?]$") & (F.length(trimmed) < 50), "hold").otherwise("pass")


def burst_runs(df: DataFrame, by: list[str], rejected: Column, n: int = 3) -> DataFrame:
    """Rows that complete ``n`` rejected rows in a row; the count begins anew after each burst."""
    own = Window.partitionBy(*by).orderBy("ts_ms", "seq")
    marked = df.withColumn("no_", rejected).withColumn("run_", F.sum(F.when(F.col("no_"), 0).otherwise(1)).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    place = F.row_number().over(Window.partitionBy(*by, "run_", "no_").orderBy("ts_ms", "seq"))
    return marked.withColumn("place_", place).where(F.col("no_") & (F.col("place_") % n == 0)).drop("no_", "run_", "place_")


def evaluate_detector(predictions: DataFrame, labels: DataFrame, key: str, bad: Column) -> DataFrame:
    """Confusion counts of each reason against the labels."""
    joined = predictions.join(labels, key).withColumn("bad_", bad)
    return joined.groupBy(F.coalesce("reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.count_if("bad_").alias("bad"), F.count_if(~F.col("bad_")).alias("good"))
