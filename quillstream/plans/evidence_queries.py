"""Queries of segments, lineage, provisional text, dictionaries and reports, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evidence, segments, text
from ..sources import event_log, tables
from ..sources.tables import EMISSIONS, SPANS, TELEMETRY
from .lineage_queries import _TOKENROWS, _token_rows
from .more_queries import l1_replay_flow_policy
from .registry import ORACLES, query

_TOKENS = "regexp_extract_all(translate(lower({c}), '" + tx.MARKED + "', '" + tx.PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"
_WORDS = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"


@query()
def e2_split_long_segments(spark, d):
    """Parts of every document's sentences; compared with brute force in ``tests/test_evidence.py``."""
    s = text.segment_sentences(tables.texts(spark, d), ["doc_id"])
    out = segments.split_long_segments(s, ["doc_id", "sentence"], "piece")
    return out.select("doc_id", F.col("sentence").cast("long").alias("sentence"), F.col("part").cast("long").alias("part"), F.length("piece").cast("long").alias("chars"), F.sha2("piece", 256).alias("piece"))


@query(f"""with recursive {SPANS}, o as (select space, cast(word as varchar) as said, row_number() over w as i, coalesce(start - lag("end") over w >= 800, false) as cut from spans window w as (partition by space order by id, word, start, "end")),
r as (select *, sum(case when cut then 1 else 0 end) over (partition by space order by i) as run from o),
runs as (select space, count(*) as n, string_agg(said, ' ' order by i) as said, row_number() over (partition by space order by run) as k from r group by space, run),
walk as (select space, k, said as held, n, 0::bigint as segment from runs where k = 1 union all select r.space, r.k, case when length(w.held) >= 15 then r.said else w.held || ' ' || r.said end, case when length(w.held) >= 15 then r.n else w.n + r.n end,
  w.segment + case when length(w.held) >= 15 then 1 else 0 end from walk w join runs r on r.space = w.space and r.k = w.k + 1)
select space, segment, sha256(arg_max(held, k)) as text, cast(max(n) as bigint) as n_words from walk group by space, segment""")
def e3_segment_by_pauses(spark, d):
    out = segments.segment_by_pauses(tables.spans(spark, d), ["space"], ["id", "word"])
    return out.select("space", F.col("segment").cast("long").alias("segment"), F.sha2("text", 256).alias("text"), "n_words")


@query()
def q3_collapse_repeats(spark, d):
    """Every document without adjacent repeats; compared with brute force in ``tests/test_evidence.py``."""
    out = segments.collapse_repeats(tables.texts(spark, d))
    return out.select("doc_id", "repeats_.adjacent", "repeats_.trigrams", "repeats_.bigrams", F.sha2("repeats_.text", 256).alias("text"))


_TERMS = "terms as (select case when p_partkey % 2 = 0 then p_name else upper(p_name) end as term, p_type as category, case when p_size % 7 <> 0 then p_brand end as target from part)"


def _terms(spark, d):
    return tables.read(spark, d, "part").selectExpr("case when p_partkey % 2 = 0 then p_name else upper(p_name) end as term", "p_type as category", "case when p_size % 7 <> 0 then p_brand end as target")


@query(f"with {_TERMS} select category, count(*) as terms, count(distinct term) as distinct_terms from terms group by category")
def e11_dictionary_stats(spark, d):
    return evidence.dictionary_stats(_terms(spark, d))


@query(f"""with {_TERMS}, asked as (select p_name as term from part union select upper(p_name) from part union select upper(p_name[1:1]) || p_name[2:] from part),
m as (select a.term, t.term as source, category, target, t.term = a.term as exact, row_number() over (partition by a.term order by t.term <> a.term, t.term, category, target) as i from asked a join terms t on lower(a.term) = lower(t.term) where target is not null)
select term, source, category, target, exact from m where i = 1""")
def e11_lookup_terms(spark, d):
    p = tables.read(spark, d, "part")
    asked = p.selectExpr("p_name as term").union(p.selectExpr("upper(p_name)")).union(p.selectExpr("concat(upper(substring(p_name, 1, 1)), substring(p_name, 2))"))
    return evidence.lookup_terms(asked, _terms(spark, d))


_TIMED = """timed as (select stream_id, release_seq, pos, token, pos * 100 - case when pos = 5 and release_seq % 5 = 0 then 300 else 0 end as start,
  pos * 100 + 90 - case when pos = 5 and release_seq % 5 = 0 then 300 when pos = 1 and release_seq % 7 = 0 then 90 else 0 end as "end" from b),
inputs as (select stream_id, release_seq, release_seq % 6 <> 5 as aligned, 0 as input_start, case when stream_id % 5 = 0 then 400 else 1000000 end as input_end, case when stream_id % 9 <> 0 then 'c' end as chunk_id from emissions)"""
_LINEAGE = f"""{EMISSIONS}, {_TOKENROWS}, {_TIMED},
same as (select coalesce(a.stream_id, b.stream_id) as stream_id, coalesce(a.release_seq, b.release_seq) as release_seq, count(a.token) as n_text, count(b.token) as n_timed, count(*) filter (a.token = b.token) as equal
  from a full join b on a.stream_id = b.stream_id and a.release_seq = b.release_seq and a.pos = b.pos group by 1, 2),
back as (select *, coalesce(start < lag(start) over w or "end" < lag("end") over w, false) as back from timed window w as (partition by stream_id, release_seq order by pos, start, "end")),
held as (select stream_id, release_seq, bool_and("end" > start) as ranged, bool_or(back) as back, min(start) as first, max("end") as last from back group by all),
judged as (select i.stream_id, i.release_seq, coalesce(n_text, 0) as n_words, coalesce(n_timed, 0) as n_timed, case when coalesce(n_text, 0) = 0 then 'empty_text' when not aligned then 'alignment_incomplete' when not (n_timed > 0 and n_text = n_timed and equal = n_text) then 'word_mismatch'
  when not ranged then 'invalid_range' when not (first >= input_start and last <= input_end) then 'outside_input' when back then 'not_monotone' when chunk_id is null then 'no_identity' end as reason
  from inputs i left join same using (stream_id, release_seq) left join held using (stream_id, release_seq)),
lineage as (select stream_id, release_seq, case when reason is null then 'complete' when n_words = 0 or n_timed = 0 then 'missing' else 'ambiguous' end as status, reason, n_words from judged)"""


def _timed(b):
    late = F.when((F.col("pos") == 5) & (F.col("release_seq") % 5 == 0), 300)
    return b.withColumn("start", F.col("pos") * 100 - F.coalesce(late, F.lit(0))).withColumn("end", F.col("pos") * 100 + 90 - late.when((F.col("pos") == 1) & (F.col("release_seq") % 7 == 0), 90).otherwise(0))


def _lineage(spark, d):
    a, b = _token_rows(spark, d)
    inputs = tables.emissions(spark, d).selectExpr("stream_id", "release_seq", "release_seq % 6 <> 5 as aligned", "0 as input_start", "if(stream_id % 5 = 0, 400, 1000000) as input_end", "if(stream_id % 9 <> 0, 'c', null) as chunk_id")
    return evidence.build_lineage(a, _timed(b), inputs, ["stream_id", "release_seq"]), _timed(b)


@query(f"with {_LINEAGE} select * from lineage")
def i9_build_lineage(spark, d):
    return _lineage(spark, d)[0]


@query(f"""with {_LINEAGE}, asked as (select stream_id, release_seq, release_seq % 4 as "from", stream_id % 5 as n, status as parent, n_words from lineage),
each as (select k.*, pos, start < lag(start) over w or "end" < lag("end") over w or "end" <= start as wrong from asked k join timed t on k.stream_id = t.stream_id and k.release_seq = t.release_seq and pos >= "from" and pos < "from" + n where "from" + n <= n_words window w as (partition by k.stream_id, k.release_seq order by pos)),
met as (select stream_id, release_seq, count(*) as met, bool_or(coalesce(wrong, false)) as wrong from each group by all), j as (select k.*, coalesce(met, 0) as met, coalesce(wrong, false) as wrong from asked k left join met using (stream_id, release_seq)),
s as (select *, case when n <= 0 then 'missing' when "from" + n > n_words then case when parent = 'missing' then 'missing' else 'ambiguous' end when wrong or parent = 'ambiguous' then 'ambiguous' when met = n and parent = 'complete' then 'complete' when met > 0 then 'partial' else 'missing' end as status from j)
select stream_id, release_seq, "from", n, status, case when n <= 0 then 'invalid_slice' when "from" + n > n_words then 'not_provable' when status = 'complete' then null when wrong then 'invalid_spans' when met = n then 'parent_not_complete' else 'partial_coverage' end as reason, met from s""")
def i11_slice_lineage(spark, d):
    built, timed = _lineage(spark, d)
    asked = tables.emissions(spark, d).selectExpr("stream_id", "release_seq", "release_seq % 4 as from", "stream_id % 5 as n")
    return evidence.slice_lineage(built, timed, asked, ["stream_id", "release_seq"])


@query(f"""with {EMISSIONS}, p as (select *, coalesce(lag(text) over (partition by stream_id order by release_seq), '') as before from emissions), t as (select stream_id, release_seq, {_TOKENS.format(c='before')} as a, {_TOKENS.format(c='text')} as b from p),
m as (select *, coalesce(list_min(list_filter(range(1, least(len(a), len(b)) + 1), lambda i: a[i] <> b[i])) - 1, least(len(a), len(b))) as matched from t)
select stream_id, release_seq, matched, matched < len(a) as diverged, case when matched < len(a) then 0 else len(b) - matched end as new_words from m""")
def g15_provisional_delta(spark, d):
    before = F.coalesce(F.lag("text").over(Window.partitionBy("stream_id").orderBy("release_seq")), F.lit(""))
    return evidence.provisional_delta(tables.emissions(spark, d).withColumn("before", before), "before", "text").select("stream_id", "release_seq", "matched", "diverged", "new_words")


@query(f"""with {EMISSIONS}, f as (select stream_id, release_seq as seq, ts_ms + release_seq % 4 * 9000 as now_, {_TOKENS.format(c='text')} as t from emissions),
p as (select distinct stream_id, ts_ms, ({_TOKENS.format(c='text')})[1:case when release_seq % 2 = 0 then 4 else 1000000 end] as p from emissions where release_seq % 3 = 0),
b as (select f.stream_id, seq, max(len(p)) as covered from f join p on f.stream_id = p.stream_id and now_ - ts_ms between 0 and 25000 and len(p) > 0 and t[1:len(p)] = p group by all)
select f.stream_id, f.seq, case when covered is null then 'pass' when len(t) - covered < 3 then 'suppress' else 'emit_tail' end as action, covered, len(t) - covered as tail_words from f left join b on f.stream_id = b.stream_id and f.seq = b.seq""")
def g15_supersede(spark, d):
    e = tables.emissions(spark, d)
    finals = e.select("stream_id", F.col("release_seq").alias("seq"), (F.col("ts_ms") + F.col("release_seq") % 4 * 9000).alias("ts_ms"), "text")
    said = F.when(F.col("release_seq") % 2 == 0, F.array_join(F.slice(tx.tokens(F.col("text")), 1, 4), " ")).otherwise(F.col("text"))
    return evidence.supersede(finals, e.where("release_seq % 3 = 0").select("stream_id", "ts_ms", said.alias("text")), ["stream_id"])


@query(f"with {TELEMETRY} select stream_id, seq, ts_ms, coalesce(ts_ms < max(ts_ms) over (partition by stream_id order by k, seq rows between unbounded preceding and 1 preceding) - 21600000, false) as late from telemetry")
def h9_late_rows(spark, d):
    return evidence.late_rows(tables.telemetry(spark, d), ["stream_id"], ["k", "seq"], "ts_ms", 21_600_000).select("stream_id", "seq", "ts_ms", "late")


_OPEN = "[" + ", ".join(f"'{w}'" for w in text.OPEN_WORDS) + "]"
_BARE = "regexp_replace(lower({w}), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


@query(f"""with {EMISSIONS}, policy as ({ORACLES['l1_replay_flow_policy']}), t as (select e.stream_id, e.release_seq, text, decision, case when e.release_seq % 3 > 0 then (e.stream_id * 37 + e.release_seq * 1300) % 14000 end as held_ms, {_WORDS.format(c='text')} as w from emissions e join policy p on e.stream_id = p.stream_id and e.release_seq = p.release_seq),
h as (select *, len(w) as n, coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: regexp_matches(w[i], '[.!?,;:]["'')\\]]*$') and {_BARE.format(w='w[i]')} <> '' and not list_contains({_OPEN}, {_BARE.format(w='w[i]')}))), 0) as head,
  regexp_matches(text, '[.!?]+["'')\\]]*\\s*$') and not list_contains({_OPEN}, coalesce({_BARE.format(w="list_filter(w, lambda x: regexp_matches(x, '[\\p{L}\\p{N}]'))[-1]")}, '')) as closed from t),
a as (select *, case when closed then 'emit_full' when held_ms >= 8000 then case when head > 0 then 'emergency_trim' else 'forced_open' end when decision in ('micro_emit', 'soft_commit', 'fallback') and head > 0 then 'emit_prefix_hold' else 'hold' end as action from h)
select stream_id, release_seq, action, case action when 'emit_full' then 'closed' when 'emit_prefix_hold' then case when head = n then 'closed' else 'closed_prefix_held_tail' end when 'hold' then case when decision = 'merge' then 'merged' else 'held' end else action end as completeness,
  case when action in ('emit_full', 'forced_open') then n when action = 'hold' then 0 else head end as said, n - case when action in ('emit_full', 'forced_open') then n when action = 'hold' then 0 else head end as held from a""")
def l4_replay_open_cut(spark, d):
    held = F.when(F.col("release_seq") % 3 > 0, (F.col("stream_id") * 37 + F.col("release_seq") * 1300) % 14000)
    rows = tables.emissions(spark, d).withColumn("held_ms", held).join(l1_replay_flow_policy(spark, d), ["stream_id", "release_seq"])
    return evidence.replay_open_cut(rows).select("stream_id", "release_seq", "action", "completeness", "said", "held")


_REPORTS = """reports as (select seq, 'A1B2C3D4-0000-0000-0000-' || lpad(cast(seq as varchar), case when k % 9 = 0 then 11 else 12 end, '0') as report_id, case k % 5 when 0 then 'issue' when 1 then 'other' else 'general_feedback' end as kind,
  case when k % 4 > 0 then repeat('x', cast(k * 7 as integer)) end as note, case when k % 6 < 2 then 'a@b.ch' when k % 6 = 2 then 'nobody' end as email, case when k % 8 = 0 then 'soon' else '2026-01-02 03:04:05' end as occurred_at from telemetry)"""


@query(f"""with {TELEMETRY}, {_REPORTS} select seq, lower(report_id) as report_id, concat_ws(',', case when not regexp_full_match(report_id, '[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}') then 'id' end, case when kind = 'other' then 'kind' end,
  case when length(note) > case when kind = 'general_feedback' then 3000 else 200 end then 'note' end, case when email is not null and (kind <> 'general_feedback' or email = 'nobody') then 'email' end,
  case when kind = 'general_feedback' and note is null and email is null then 'empty' end, case when occurred_at = 'soon' then 'time' end) as violations from reports""")
def a4_validate_feedback(spark, d):
    rows = tables.telemetry(spark, d).selectExpr(
        "seq", "concat('A1B2C3D4-0000-0000-0000-', lpad(cast(seq as string), if(k % 9 = 0, 11, 12), '0')) as report_id", "case k % 5 when 0 then 'issue' when 1 then 'other' else 'general_feedback' end as kind",
        "if(k % 4 > 0, repeat('x', cast(k * 7 as int)), null) as note", "case when k % 6 < 2 then 'a@b.ch' when k % 6 = 2 then 'nobody' end as email", "if(k % 8 = 0, 'soon', '2026-01-02 03:04:05') as occurred_at",
    )
    return event_log.validate_feedback(rows).select("seq", "report_id", F.array_join("violations", ",").alias("violations"))


@query("""with e as (select case p_size % 3 when 0 then 'default' else 's' || p_size % 3 end as scope, p_name as term, p_type as lang, min(p_brand) as target from part group by all), asked as (select distinct 's' || cast(s as varchar) as scope, term, lang from e, range(1, 4) r(s))
select a.scope, a.term, a.lang, coalesce(o.target, b.target) as target from asked a left join e o on o.scope = a.scope and o.term = a.term and o.lang = a.lang left join e b on b.scope = 'default' and b.term = a.term and b.lang = a.lang where coalesce(o.target, b.target) is not null""")
def a9_load_dictionary(spark, d):
    entries = tables.read(spark, d, "part").selectExpr("if(p_size % 3 = 0, 'default', concat('s', p_size % 3)) as scope", "p_name as term", "p_type as lang", "p_brand").groupBy("scope", "term", "lang").agg(F.min("p_brand").alias("target"))
    asked = entries.select(F.explode(F.array(F.lit("s1"), F.lit("s2"), F.lit("s3"))).alias("scope"), "term", "lang").distinct()
    return event_log.load_dictionary(entries, asked)


def _one_of(column: str, values: tuple[str, ...]) -> str:
    return f"case when {column} <> '' then case when {column} in ({', '.join(repr(v) for v in values)}) then {column} else 'unclassified' end end"


_RAW = (
    "case when k % 11 = 0 then 'x' || seq when k % 11 = 1 then '' when k % 11 = 2 then seq || '.5' when k % 11 > 3 then cast(seq as varchar(30)) end as decode_id",
    "case when k % 13 = 0 then 'slow' when k % 13 > 1 then k || '.25' end as inference_ms",
    "case when k % 5 = 0 then 'ABC' when k % 5 > 1 then repeat('0f', 32) end as input_sha256",
    "case when k % 3 = 0 then 'accepted' when k % 3 = 1 then 'said aloud' end as transcribe_status",
    "case when k % 4 = 0 then 'complete' else '' end as provenance_status",
    "case when k % 7 = 0 then 'missing_span' when k % 7 = 1 then 'word' end as provenance_reason",
    "case when k % 2 = 0 then 'exact' end as alignment_status",
    "case when k % 6 = 0 then 'non_word_level_chunk:tokens=' || k when k % 6 = 1 then 'invalid_timestamp:negative_start of a word' when k % 6 = 2 then 'Gelassenheit' when k % 6 = 3 then 'token_count_mismatch' end as alignment_reason",
)
_NUMBER = "case when abs(try_cast(nullif({c}, '') as double)) < 1e15 then try_cast(nullif({c}, '') as double) end"


@query(f"""with {TELEMETRY}, raw as (select seq, k, {', '.join(_RAW)} from telemetry), t as (select *, {_NUMBER.format(c='decode_id')} as d, {_NUMBER.format(c='inference_ms')} as m from raw)
select seq, case when d = floor(d) then cast(d as bigint) end as decode_id, m as inference_ms, case when regexp_full_match(input_sha256, '[0-9a-f]{{64}}') then input_sha256 end as input_sha256, {", ".join(_one_of(c, v) + " as " + c for c, v in event_log.PROVENANCE_ENUMS.items())},
  case when alignment_reason is not null then case when starts_with(alignment_reason, 'non_word') then 'non_word_level_chunk' when k % 6 = 2 then 'unclassified' else split_part(alignment_reason, ' ', 1) end end as alignment_code, case when k % 6 = 0 then k end as chunk_tokens,
  case when k % 3 <> 2 then k % 3 end as n_spans, case when k % 3 = 1 then k end as span_start, case when k % 3 = 1 then k + 5 end as span_end,
  concat_ws(',', case when decode_id <> '' and (d is null or d <> floor(d)) then 'decode_id' end, case when inference_ms = 'slow' then 'inference_ms' end, case when input_sha256 = 'ABC' then 'input_sha256' end) as rejected from t""")
def a8_sanitize_provenance(spark, d):
    spans = "if(k % 3 = 2, null, if(k % 3 = 1, array(struct(k as start, k + 5 as end)), cast(array() as array<struct<start: bigint, end: bigint>>))) as spans"
    rows = tables.telemetry(spark, d).selectExpr("seq", "k", *_RAW, spans)
    out = event_log.sanitize_provenance(rows, ["seq"], ["decode_id"], ["inference_ms"], ["input_sha256"], "spans")
    return out.withColumn("n_spans", F.col("n_spans").cast("long")).withColumn("rejected", F.array_join("rejected", ","))


@query(f"""with {TELEMETRY} select seq, case when k % 5 > 0 then k end as queue_depth, seq as received, case when k % 3 > 0 then k * 2 else 0 end as played, case when k % 4 > 0 then case when k >= 3 then k - 3 end when k % 3 > 0 then k * 2 end as started, cast(null as bigint) as completed,
  case when k % 5 > 0 then k end as pending, case when k % 2 = 0 then 1.0::double else 1.25::double end as rate, case when k % 7 > 0 then k * 1.5::double else 0.0::double end as age_ms, cast(null as double) as lag_ms, case when k % 6 > 0 then k * 100.0::double end as silence_ms, k as last_played, repeat('h', 64) as last_hash from telemetry""")
def a10_listener_snapshot_fact(spark, d):
    said = F.to_json(F.expr("struct(if(k % 5 > 0, k, null) as queueDepth, seq as chunksReceived, if(k % 3 > 0, k * 2, null) as chunksPlayed, if(k % 4 > 0, k - 3, null) as chunksStarted, if(k % 2 = 0, 0.0D, 1.25D) as currentPlaybackRate, if(k % 7 > 0, k * 1.5D, null) as chunkAgeAtPlay_avg_ms, if(k % 6 > 0, k * 100.0D, null) as realSilence_max_ms, k as last_release_seq_played, repeat('h', 90) as last_source_hash_played)"))
    return event_log.listener_snapshot_fact(tables.telemetry(spark, d).select("seq", said.alias("snapshot")), ["seq"])
