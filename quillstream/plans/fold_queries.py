"""Queries of sequential operators: a fold over each stream in order, and SQL that walks each stream by recursion."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain, fold
from ..sources import tables
from ..sources.tables import DECISIONS, EMISSIONS, TELEMETRY
from .registry import query


def _walk(source: str, columns: str, first: str, then: str, out: str) -> str:
    """SQL that numbers each stream's rows and carries a state from one to the next."""
    return f"""with recursive {source}, n as (select *, row_number() over (partition by stream_id order by ts_ms, seq) as i from (select {columns})),
walk as (select n.*, {first} from n where i = 1 union all select n.*, {then} from walk w join n on n.stream_id = w.stream_id and n.i = w.i + 1)
select stream_id, seq, {out} from walk"""


_LIMIT = _walk(
    TELEMETRY, "stream_id, ts_ms, seq from telemetry", "1::bigint as c, ts_ms + 7200000 as reset, false as warned",
    "case when n.ts_ms > w.reset then 1 else w.c + 1 end, case when n.ts_ms > w.reset then n.ts_ms + 7200000 else w.reset end, n.ts_ms <= w.reset and (w.warned or w.c > 3)",
    "c <= 3 as allowed, c > 3 and not warned as warn, c > 6 as close",
)
_FLOOR = _walk(
    TELEMETRY, "stream_id, ts_ms, seq, value as level, k % 3 <> 0 as speech from telemetry", "case when not speech then level::double end as f",
    "case when n.speech then w.f when w.f is null then n.level else 0.9::double * w.f + 0.1::double * n.level end", "f as floor",
)
_RATES = "case when {d} > 6 or {a} > 10000 then 1.2 when {d} >= 4 or {a} >= 6000 then 1.15 when {d} >= 2 or {a} >= 3000 then 1.08 else 1.0 end"
_UP = _RATES.format(d="greatest(0, n.queue_depth)", a="greatest(0, n.age_ms)")
_HELD = """case when w.r >= 1.2 and (greatest(0, n.queue_depth) > 5 or greatest(0, n.age_ms) > 9000) then 1.2
  when w.r >= 1.15 and (greatest(0, n.queue_depth) >= 3 or greatest(0, n.age_ms) >= 5000) then 1.15
  when w.r >= 1.08 and (greatest(0, n.queue_depth) >= 1 or greatest(0, n.age_ms) >= 2000) then 1.08 else """ + _UP + " end"
_RATE = _walk(
    DECISIONS, "stream_id, ts_ms, seq, queue_depth, age_ms from decisions", f"({_UP})::double as r",
    f"(case when {_UP} < w.r then {_HELD} else {_UP} end)::double", "r as rate",
)


@query(_LIMIT)
def c6_fixed_window_limit(spark, d):
    t = tables.telemetry(spark, d).select("stream_id", "ts_ms", "seq")
    return fold.ordered_fold(t, ["stream_id"], ["ts_ms", "seq"], fold.limit_step(3, 7_200_000), fold.LIMIT_SCHEMA)


# a stream's key is its stage's first letter too, as a service keeps a mode for each language
_RECOVERY = f"""with recursive {TELEMETRY}, n as (select stream_id, lang, ts_ms, seq, blocked, row_number() over (partition by stream_id, lang order by ts_ms, seq) as i from (
  select stream_id, case when k % 2 = 0 then 'de' else 'en' end as lang, ts_ms, seq, stage = 'error' as blocked from telemetry)),
walk as (
  select n.*, 'full' as mode, case when blocked then 3600000 else 0 end::bigint as wait, case when blocked then ts_ms + 3600000 end as probe_at, 0::bigint as good from n where i = 1
  union all
  select stream_id, lang, ts_ms, seq, blocked, i, mode, case when blocked then next_ when mode = 'half_open' or wait = 0 then 0 else wait end, case when blocked then ts_ms + next_ when mode = 'half_open' or wait = 0 then null else probe_at end,
    case when blocked or mode = 'half_open' or wait = 0 then 0 else good + 1 end
  from (select n.*, w.wait, w.probe_at, w.good, case when w.wait = 0 then 'full' when w.good >= 2 and n.ts_ms >= w.probe_at then 'half_open' else 'source_only' end as mode,
      case when w.wait = 0 then 3600000 else least(86400000, greatest(3600000, w.wait * 2)) end as next_
    from walk w join n on n.stream_id = w.stream_id and n.lang = w.lang and n.i = w.i + 1))
select stream_id, lang, seq, mode from walk"""


@query(_RECOVERY)
def c8_recovery_replay(spark, d):
    t = tables.telemetry(spark, d).select("stream_id", F.when(F.col("k") % 2 == 0, "de").otherwise("en").alias("lang"), "ts_ms", "seq", (F.col("stage") == "error").alias("blocked"))
    return fold.ordered_fold(t, ["stream_id", "lang"], ["ts_ms", "seq"], fold.recovery_step(3_600_000, 86_400_000), fold.RECOVERY_SCHEMA)


_W = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
_S = "list_transform({w}, lambda w: substr(regexp_replace(lower(w), '[^a-zäöüß]', '', 'g'), 1, 4))"
_LAST = "list_slice({w}, greatest(1, len({w}) - 19), len({w}))"
_TAIL = f"""with recursive {EMISSIONS}, n as (select stream_id, release_seq, row_number() over (partition by stream_id order by release_seq) as i, {_W.format(c="text")} as w from emissions),
s as (select *, {_S.format(w="w")} as st from n),
walk as (
  select stream_id, release_seq, i, len(w)::bigint as n_words, 0::bigint as cut, {_LAST.format(w="st")} as tail from s where i = 1
  union all
  select stream_id, release_seq, i, len(st), c, case when c < len(st) then {_LAST.format(w="st[c + 1:]")} else tail end
  from (select s.stream_id, s.release_seq, s.i, s.st, w.tail, coalesce(list_max(list_filter(range(4, least(len(s.st), len(w.tail)) + 1), lambda k: len(list_filter(s.st[1:k], lambda x: x = '')) = 0 and len(list_filter(range(1, len(w.tail) - k + 2), lambda j: w.tail[j:j + k - 1] = s.st[1:k])) > 0)), 0) as c
    from walk w join s on s.stream_id = w.stream_id and s.i = w.i + 1))
select stream_id, release_seq, n_words, cut as trimmed from walk"""


@query(_TAIL)
def g3_tail_overlap_trim(spark, d):
    return fold.ordered_fold(tables.emissions(spark, d), ["stream_id"], ["release_seq"], chain.tail_step(), fold.TAIL_SCHEMA)


_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1] * z[2]))"
_PREDECESSOR = f"""with recursive n as (
  select vec_id % 10 as stream_id, vec_id as seq, list_transform(embedding, lambda x: x::double) as vec, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\\s+'), lambda w: w <> '')) as w,
    row_number() over (partition by vec_id % 10 order by vec_id) as i from embeddings join documents on vec_id = doc_id),
walk as (
  select stream_id, seq, i, 'translate' as action, null::double as cosine, vec as kept, w as words from n where i = 1
  union all
  select stream_id, seq, i, case when dropped then 'drop' else 'translate' end, cosine, case when dropped then kept else vec end, case when dropped then words else w end
  from (select *, cosine >= 0.7 and coalesce(len(list_intersect(words, w)) * 1.0::double / nullif(len(list_distinct(list_concat(words, w))), 0), 0) < 0.5 as dropped
    from (select n.stream_id, n.seq, n.i, n.vec, n.w, k.kept, k.words, round({_DOT.format(a="k.kept", b="n.vec")} / (sqrt({_DOT.format(a="k.kept", b="k.kept")}) * sqrt({_DOT.format(a="n.vec", b="n.vec")})), 6) as cosine
      from walk k join n on n.stream_id = k.stream_id and n.i = k.i + 1)))
select stream_id, seq, action, cosine from walk"""


@query(_PREDECESSOR)
def g7_semantic_predecessor_drop(spark, d):
    v = tables.read(spark, d, "embeddings").select(F.col("vec_id").alias("seq"), (F.col("vec_id") % 10).alias("stream_id"), F.col("embedding").alias("vec"))
    units = v.join(tables.texts(spark, d).select(F.col("doc_id").alias("seq"), "text"), "seq")
    return fold.ordered_fold(units, ["stream_id"], ["seq"], fold.predecessor_step(), fold.PREDECESSOR_SCHEMA)


_HISTORY = f"""with recursive {EMISSIONS}, n as (
  select stream_id, release_seq, row_number() over (partition by stream_id order by release_seq) as i, text, lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) as exact,
    list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', ' ', 'g'), '\\s+'), lambda w: length(w) > 2) as w from emissions),
m as (select *, list_distinct(w) as bag from n),
walk as (
  select stream_id, release_seq, i, 'emit' as legacy, 'emit' as v2, [{{'e': exact, 'w': w, 'b': bag}}] as h from m where i = 1
  union all
  select stream_id, release_seq, i, legacy, v2, case when legacy = 'emit' then list_slice(list_append(h, {{'e': exact, 'w': w, 'b': bag}}), greatest(1, len(h) - 3), len(h) + 1) else h end
  from (select *, case when length(text) < 10 then 'emit' when same then 'exact' when length(text) < 30 then case when again then 'short_repeat' else 'emit' end when len(bag) >= 3 and len(h) > 0 and best > 0.45 then 'paraphrase' else 'emit' end as legacy,
      case when length(text) < 10 then 'emit' when same then 'exact' when length(text) < 30 then case when again then 'short_repeat' else 'emit' end when len(bag) >= 3 and len(h) > 0 and len(list_intersect(bag, near.b)) * 1.0::double / len(bag) >= 0.85 then 'near' else 'emit' end as v2
    from (select *, h[list_position(js, best)] as near from (select *, list_max(js) as best from (
      select m.stream_id, m.release_seq, m.i, m.text, m.exact, m.w, m.bag, k.h, len(list_filter(k.h, lambda x: x.e = m.exact)) > 0 as same, len(list_filter(k.h, lambda x: x.w = m.w)) > 0 as again,
        list_transform(k.h, lambda x: coalesce(len(list_intersect(m.bag, x.b)) * 1.0::double / nullif(len(list_distinct(list_concat(m.bag, x.b))), 0), 0)) as js
      from walk k join m on m.stream_id = k.stream_id and m.i = k.i + 1)))))
select stream_id, release_seq, legacy, v2 as overlap from walk"""


@query(_HISTORY)
def g8_translated_dedup(spark, d):
    return fold.ordered_fold(tables.emissions(spark, d), ["stream_id"], ["release_seq"], fold.history_step(), fold.HISTORY_SCHEMA)


def _reason(t: str, since: str) -> str:
    """SQL of why the accumulated text ``t`` is released, if it is."""
    ends = f"length({t}) - length(regexp_replace({t}, '[.!?]', '', 'g'))"
    return f"case when {ends} >= 2 and length({t}) >= 50 then 'sentences' when {ends} > 0 and ts_ms - {since} >= 7000 then 'early' when ts_ms - {since} >= 10000 then 'timeout' end"


_SENTENCE = f"""with recursive {EMISSIONS}, n as (select stream_id, release_seq, ts_ms, regexp_replace(text, '^\\s+|\\s+$', '', 'g') as said, row_number() over (partition by stream_id order by release_seq) as i from emissions),
walk as (
  select stream_id, release_seq, ts_ms, i, said as t, ts_ms as since, case when said <> '' then {_reason("said", "ts_ms")} end as reason from n where i = 1
  union all
  select stream_id, release_seq, ts_ms, i, t, since, case when t <> '' then {_reason("t", "since")} end
  from (select n.stream_id, n.release_seq, n.ts_ms, n.i, case when w.reason is not null or w.t = '' then n.said when n.said = '' then w.t else w.t || ' ' || n.said end as t, case when w.reason is not null then n.ts_ms else w.since end as since
    from walk w join n on n.stream_id = w.stream_id and n.i = w.i + 1))
select stream_id, release_seq, reason, length(t) as chars from walk where reason is not null"""


@query(_SENTENCE)
def h4_accumulate_sentences(spark, d):
    return fold.ordered_fold(tables.emissions(spark, d), ["stream_id"], ["release_seq"], fold.sentence_step(), fold.SENTENCE_SCHEMA)


_UTTERANCE = f"""with recursive {TELEMETRY}, n as (select stream_id, ts_ms, k % 4 <> 0 as speech, k * 20 as ms, row_number() over (partition by stream_id order by ts_ms, seq) as i from telemetry),
first as (select *, case when speech then ms else 0 end as said, 0::bigint as quiet, ts_ms as start, speech as on_ from n where i = 1),
walk as (
  select *, on_ and said >= 30000 as closed from first
  union all
  select stream_id, ts_ms, speech, ms, i, said, quiet, start, on_, on_ and (case when speech then said >= 30000 else quiet >= 500 end)
  from (select n.*, case when n.speech then (case when was then w.said else 0 end) + n.ms else case when was then w.said else 0 end end as said, case when n.speech then 0 else case when was then w.quiet + n.ms else 0 end end as quiet,
      case when n.speech and not was then n.ts_ms else w.start end as start, n.speech or was as on_
    from (select *, on_ and not closed as was from walk) w join n on n.stream_id = w.stream_id and n.i = w.i + 1))
select stream_id, start as start_ms, ts_ms + ms as end_ms, said as speech_ms from walk where closed"""


@query(_UTTERANCE)
def h6_utterances(spark, d):
    t = tables.telemetry(spark, d).select("stream_id", "ts_ms", "seq", (F.col("k") % 4 != 0).alias("speech"), (F.col("k") * 20).alias("ms"))
    return fold.ordered_fold(t, ["stream_id"], ["ts_ms", "seq"], fold.utterance_step(), fold.UTTERANCE_SCHEMA)


@query(_RATE)
def j9_playback_rate_replay(spark, d):
    t = tables.decisions(spark, d).select("stream_id", "ts_ms", "seq", "queue_depth", "age_ms")
    return fold.ordered_fold(t, ["stream_id"], ["ts_ms", "seq"], fold.playback_rate_step(), fold.RATE_SCHEMA)


@query(_FLOOR)
def k4_noise_floor_ewma(spark, d):
    t = tables.telemetry(spark, d).select("stream_id", "ts_ms", "seq", F.col("value").alias("level"), (F.col("k") % 3 != 0).alias("speech"))
    return fold.ordered_fold(t, ["stream_id"], ["ts_ms", "seq"], fold.ewma_step(), fold.EWMA_SCHEMA)
