"""Queries of texts, detectors, deduplication, hypotheses, spans and delivery, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dedup, delivery, detect, spans, stabilize, text
from ..operators.core import merge_intervals
from ..sources import tables
from ..sources.tables import EMISSIONS, SPANS, TEXTS
from .registry import query

_TOKENS = "regexp_extract_all(translate(lower({c}), '" + tx.MARKED + "', '" + tx.PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"
_WORDS = "list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> '')"
_TRIM = "regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"

# --- texts ---------------------------------------------------------------------------------------------------------

_SENTENCES = f"""{TEXTS}, parts as (select doc_id, list_filter(list_transform(regexp_extract_all(text, '[^.!?。！？]+[.!?。！？]*|[.!?。！？]+'), lambda s: {_TRIM.format(c="s")}), lambda s: s <> '') as p from texts),
sentences as (select doc_id, unnest(range(len(p))) as sentence, unnest(p) as piece from parts)"""


@query(f"with {_SENTENCES} select doc_id, cast(sentence as integer) as sentence, sha256(piece) as piece, length(piece) as chars, len({_WORDS.format(c='piece')}) as n_words, regexp_matches(piece, '[.!?。！？]$') as complete from sentences")
def e1_segment_sentences(spark, d):
    out = text.segment_sentences(tables.texts(spark, d), ["doc_id"])
    return out.withColumn("piece", F.sha2("piece", 256)).withColumn("chars", F.col("chars").cast("long")).withColumn("n_words", F.col("n_words").cast("long"))


@query(f"with {TEXTS}, t as (select doc_id, {_TRIM.format(c='text')} as t from texts) select doc_id, regexp_matches(t, '[.!?]$') as ends, regexp_matches(t, '^[A-ZÄÖÜ]') as capital, len({_WORDS.format(c='t')}) as n_words, regexp_matches(t, '[.!?]$') and len({_WORDS.format(c='t')}) >= 3 as likely_complete from t")
def e4_sentence_features(spark, d):
    out = tables.texts(spark, d).select("doc_id", text.sentence_features(F.col("text")).alias("f")).select("doc_id", "f.*")
    return out.withColumn("n_words", F.col("n_words").cast("long"))


@query(f"""with {_SENTENCES}, u as (select *, sum(case when sentence = 0 or length(piece) >= 25 then 1 else 0 end) over (partition by doc_id order by sentence) - 1 as unit from sentences)
select doc_id, cast(unit as bigint) as unit, sha256(string_agg(piece, ' ' order by sentence)) as text, count(*) as n_sentences from u group by doc_id, unit""")
def e5_merge_short_units(spark, d):
    s = text.segment_sentences(tables.texts(spark, d), ["doc_id"])
    return text.merge_short_units(s, ["doc_id"]).withColumn("text", F.sha2("text", 256))


@query(f"with {_SENTENCES} select doc_id, cast(sentence as integer) as sentence, len({_TOKENS.format(c='piece')}) as n_tokens, regexp_matches(piece, '[.!?。！？]$') and len({_TOKENS.format(c='piece')}) >= 4 as scorable from sentences")
def e6_source_units(spark, d):
    s = text.segment_sentences(tables.texts(spark, d), ["doc_id"])
    return text.source_units(s).select("doc_id", "sentence", F.col("n_tokens").cast("long").alias("n_tokens"), "scorable")


_OPEN = "[" + ", ".join(f"'{w}'" for w in text.OPEN_WORDS) + "]"


@query(f"""with {TEXTS}, w as (select doc_id, unnest({_WORDS.format(c='text')}) as w, generate_subscripts({_WORDS.format(c='text')}, 1) as i from texts),
s as (select doc_id, max(i) as head from w where regexp_matches(w, '[.!?,;:]["'')\\]]*$') and regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]', '', 'g') <> '' and not list_contains({_OPEN}, regexp_replace(lower(w), '[^\\p{{L}}\\p{{N}}]', '', 'g')) group by doc_id)
select doc_id, coalesce(head, 0) as head from texts left join s using (doc_id)""")
def e7_safe_boundary(spark, d):
    return tables.texts(spark, d).select("doc_id", text.safe_boundary(F.col("text")).cast("long").alias("head"))


@query(f"""with {EMISSIONS}, n as (select *, lead(text) over w as nxt, lead(ts_ms) over w - ts_ms as gap from emissions window w as (partition by stream_id order by release_seq))
select stream_id, release_seq, case when not regexp_matches(regexp_replace(text, '\\s+$', ''), '[.!?]+["'')\\]]*$') then 'open' when gap >= 5000 then 'pause' when starts_with(nxt, text) then 'next' else 'unconfirmed' end as boundary from n""")
def e8_confirm_boundaries(spark, d):
    return text.confirm_boundaries(tables.emissions(spark, d), ["stream_id"], "release_seq", 5000).select("stream_id", "release_seq", "boundary")


@query(f"with {TEXTS} select doc_id, regexp_matches(text, '(?i)" + "|".join(text.INJECTIONS) + "') as flagged from texts")
def e13_flag_injection(spark, d):
    return tables.texts(spark, d).select("doc_id", text.flag_injection(F.col("text")).alias("flagged"))


@query(f"""with {TEXTS}, a as (select doc_id, regexp_replace(text, 'Bearer\\s+\\S+', 'Bearer [REDACTED]', 'gi') as t from texts),
b as (select doc_id, regexp_replace(t, '((?:api[-_ ]?key|authorization|token|secret)\\s*[:=]\\s*)\\S+', '\\1[REDACTED]', 'gi') as t from a),
c as (select doc_id, regexp_replace(t, '\\b(?:sk|key)-[a-zA-Z0-9_-]{{16,}}\\b', '[REDACTED]', 'g') as t from b)
select doc_id, sha256(substr(regexp_replace(regexp_replace(t, '\\s+', ' ', 'g'), '^ | $', '', 'g'), 1, 500)) as redacted from c""")
def e14_redact(spark, d):
    return tables.texts(spark, d).select("doc_id", F.sha2(text.redact(F.col("text")), 256).alias("redacted"))


@query(f"""with {TEXTS}, i as (select doc_id, substr(sha256(array_to_string({_TOKENS.format(c='text')}, ' ')), 1, 24) as identity, len({_TOKENS.format(c='text')}) as n_tokens from texts)
select doc_id, identity, n_tokens, count(*) over (partition by identity) as n_same from i""")
def e15_text_identity(spark, d):
    out = text.text_identity(tables.texts(spark, d))
    return out.select("doc_id", "identity", F.col("n_tokens").cast("long").alias("n_tokens"), "n_same")


# --- detectors -----------------------------------------------------------------------------------------------------


@query()
def f1_detect_patterns(spark, d):
    return tables.texts(spark, d).select("doc_id", detect.detect_patterns(F.col("text")).alias("found")).select("doc_id", "found.reason", "found.span", "found.loop_start")


_ITEMS = "list_filter(list_transform(string_split(text, ','), lambda s: " + _TRIM.format(c="s") + "), lambda s: s <> '')"


@query(f"""with {TEXTS}, i as (select doc_id, unnest({_ITEMS}) as item from texts), n as (select doc_id, array_to_string({_WORDS.format(c='lower(item)')}, ' ') as norm, len({_WORDS.format(c='item')}) as w from i),
c as (select doc_id, norm, count(*) as c, sum(w) as w from n group by doc_id, norm), g as (select doc_id, sum(c) as n, max(c) as most, sum(w) as w from c group by doc_id)
select doc_id, coalesce(n >= 2 and most <= 2 and w >= 2.5 * n, false) as prose from texts left join g using (doc_id)""")
def f2_prose_guard(spark, d):
    return tables.texts(spark, d).select("doc_id", detect.prose_guard(F.col("text")).alias("prose"))


@query(f"""with {TEXTS}, r as (select doc_id, unnest({_WORDS.format(c='text')}) as w, generate_subscripts({_WORDS.format(c='text')}, 1) as i from texts),
n as (select doc_id, i, w, lead(w, 1) over o as w1, lead(w, 2) over o as w2, lead(w, 3) over o as w3 from r window o as (partition by doc_id order by i)),
tri as (select doc_id, max(c) as trigram from (select doc_id, count(*) as c from n where w2 is not null group by doc_id, w, w1, w2) group by doc_id),
bi as (select doc_id, max(c) as bigram from (select doc_id, count(*) as c from n where w1 is not null group by doc_id, lower(w), lower(w1)) group by doc_id),
run as (select doc_id, count(*) as n_words, count(*) filter (w = w1 and w1 = w2 and w2 = w3) as runs from n group by doc_id)
select doc_id, n_words, coalesce(trigram, 0) as trigram, coalesce(bigram, 0) as bigram, runs, case when n_words < 10 then null when trigram > 2 then 'trigram' when bigram >= 4 then 'bigram' when runs > 0 then 'word_run' end as reason
from run left join tri using (doc_id) left join bi using (doc_id)""")
def f3_detect_repetition(spark, d):
    return detect.detect_repetition(tables.texts(spark, d), ["doc_id"])


_FUNCTION = "[" + ", ".join(f"'{w}'" for w in detect.FUNCTION_WORDS) + "]"


@query(f"""with {TEXTS}, i as (select doc_id, unnest({_ITEMS}) as item from texts), n as (select doc_id, lower({_WORDS.format(c='item')}[1]) as head, len({_WORDS.format(c='item')}) as w, list_has_any({_WORDS.format(c='lower(item)')}, {_FUNCTION}) as fn from i),
c as (select doc_id, head, count(*) as c, sum(w) as w, count(*) filter (fn) as fn from n group by doc_id, head), g as (select doc_id, sum(c) as n, max(c) as most, sum(w) as w, sum(fn) as fn from c group by doc_id)
select doc_id, coalesce(length(text) - length(replace(text, ',', '')) >= 3 and n >= 4 and w < 2.5 * n and (most * 2 > n or fn * 2 > n), false) as burst from texts left join g using (doc_id)""")
def f4_comma_burst(spark, d):
    return tables.texts(spark, d).select("doc_id", detect.comma_burst(F.col("text")).alias("burst"))


@query(f"with {TEXTS} select doc_id, len(regexp_extract_all(text, '[«»„“‚‘][^«»„“‚‘]*?[«»„“‚‘]')) > 10 as quoted from texts")
def f5_guillemets(spark, d):
    return tables.texts(spark, d).select("doc_id", detect.guillemets(F.col("text")).alias("quoted"))


@query(f"with {TEXTS}, t as (select doc_id, regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g') as t from texts) select doc_id, case when length(t) >= 3 and regexp_matches(t, '[\\p{{L}}\\p{{N}}]') then sha256(t) end as cleaned from t")
def f6_clean_text(spark, d):
    return tables.texts(spark, d).select("doc_id", F.sha2(detect.clean_text(F.col("text")), 256).alias("cleaned"))


_GATE = f"""case when length(regexp_replace(text, '\\s', '', 'g')) > 10 and (length(regexp_replace(text, '\\s', '', 'g')) - length(regexp_replace(regexp_replace(text, '\\s', '', 'g'), '[a-zA-ZäöüÄÖÜß]', '', 'g'))) * 10 < length(regexp_replace(text, '\\s', '', 'g')) * 4 then 'reject'
  when not regexp_matches({_TRIM.format(c='text')}, '[.!?]$') and length({_TRIM.format(c='text')}) < 50 then 'hold' else 'pass' end"""


@query(f"with {TEXTS} select doc_id, {_GATE} as gate from texts")
def f7_source_gates(spark, d):
    return tables.texts(spark, d).select("doc_id", detect.source_gates(F.col("text")).alias("gate"))


@query(f"""with {tables.TELEMETRY}, m as (select *, value > 15 as no from telemetry), r as (select *, sum(case when no then 0 else 1 end) over (partition by stream_id order by ts_ms, seq) as run from m),
p as (select *, row_number() over (partition by stream_id, run, no order by ts_ms, seq) as place from r) select stream_id, seq, value from p where no and place % 3 = 0""")
def f8_burst_runs(spark, d):
    return detect.burst_runs(tables.telemetry(spark, d), ["stream_id"], F.col("value") > 15).select("stream_id", "seq", "value")


@query(f"with {TEXTS}, g as (select doc_id, {_GATE} as reason from texts) select reason, count(*) as n, count(*) filter (quality = 0) as bad, count(*) filter (quality <> 0) as good from g join labels using (doc_id) group by reason")
def f9_evaluate_detector(spark, d):
    predictions = tables.texts(spark, d).select("doc_id", detect.source_gates(F.col("text")).alias("reason"))
    return detect.evaluate_detector(predictions, tables.read(spark, d, "labels"), "doc_id", F.col("quality") == 0)


# --- deduplication -------------------------------------------------------------------------------------------------

_STEMS = "list_transform(" + _WORDS.format(c="text") + ", lambda w: substr(regexp_replace(lower(w), '[^a-zäöüß]', '', 'g'), 1, 4))"
_STOP = "[" + ", ".join(f"'{w}'" for w in dedup.STOP) + "]"


def _snapped(within: int, ahead: bool) -> str:
    """SQL of the place nearest ``cut0`` that follows a sentence end, else ``cut0``."""
    places = ", ".join(p for off in range(within + 1) for p in ([f"cut0 - {off}", f"cut0 + {off}"] if ahead else [f"cut0 - {off}"]))
    return f"coalesce(list_filter([{places}], lambda p: p > 0 and (p <= cut0 or p < len(w)) and coalesce(regexp_matches(w[p], '[.!?]$'), false))[1], cut0)"


@query(f"""with {EMISSIONS}, s as (select stream_id, release_seq, {_WORDS.format(c="text")} as w, {_STEMS} as sa from emissions),
f as (select *, list_filter(sa, lambda s: length(s) > 1 and not list_contains({_STOP}, s)) as st from s),
q as (select *, row_number() over (partition by stream_id order by release_seq) as no from f where len(w) >= 6 and len(st) >= 3),
b as (select a.stream_id, a.release_seq, max(len(list_intersect(a.st, o.st)) * 1.0::double / len(list_distinct(list_concat(a.st, o.st)))) as best,
  coalesce(flatten(list(o.st) filter (o.no >= a.no - 2)), []) as old from q a left join q o on a.stream_id = o.stream_id and o.no between a.no - 3 and a.no - 1 group by all),
n as (select e.*, b.stream_id is not null as enough, best, case when best > 0.5 then coalesce(list_max(list_filter(range(1, len(w) + 1), lambda i: list_contains(old, sa[i]) and length(sa[i]) > 1 and not list_contains({_STOP}, sa[i]))), 0) end as cut0
  from s e left join b on e.stream_id = b.stream_id and e.release_seq = b.release_seq)
select stream_id, release_seq, case when enough then round(coalesce(best, 0), 6) end as best, case when cut0 is null then 'emit' when len(w) - cut0 < 5 then 'skip' else 'trim' end as action,
  cast(case when cut0 is null then 0 when len(w) - cut0 < 5 then len(w) else {_snapped(3, False)} end as bigint) as cut from n""")
def g2_jaccard_window_dedup(spark, d):
    return dedup.jaccard_window_dedup(tables.emissions(spark, d), ["stream_id"], "release_seq")


@query(f"""with {EMISSIONS}, s as (select stream_id, release_seq, {_WORDS.format(c="text")} as w, {_STEMS} as st from emissions), g as (select stream_id, release_seq, i, array_to_string(st[i:i + 5], ' ') as gram from (select *, unnest(range(1, len(st) - 4)) as i from s where len(st) >= 6)),
f as (select *, min(release_seq) over (partition by stream_id, gram) < release_seq as seen from g),
m as (select stream_id, release_seq, count(*) as grams, count(*) filter (seen) as old, string_agg(case when seen then 'o' else 'n' end, '' order by i) as marks from f group by all),
t as (select s.*, coalesce(grams, 0) as grams, coalesce(old, 0) as old, case when old > 0.2 * grams then instr(marks, 'nnnn') - 1 end as cut0 from s left join m on s.stream_id = m.stream_id and s.release_seq = m.release_seq),
c as (select *, case when cut0 >= 10 then case when {_snapped(5, True)} >= 10 then {_snapped(5, True)} else cut0 end end as c from t),
a as (select *, case when c is not null then length(array_to_string(w[c + 1:], ' ')) < 3 else coalesce(cut0 < 0 and old > 0.7 * grams, false) end as skip from c)
select stream_id, release_seq, grams, old, case when skip then 'skip' when c is not null then 'trim' when cut0 is not null and old > 0.3 * grams then 'warn' else 'emit' end as action,
  cast(case when skip then len(w) else coalesce(c, 0) end as bigint) as cut from a""")
def g1_ngram_history(spark, d):
    return dedup.ngram_history(tables.emissions(spark, d), ["stream_id"], "release_seq")


@query("""with u as (select vec_id % 10 as stream_id, vec_id as seq, vec_id * 5000 as ts_ms, list_transform(embedding, lambda x: x::double) as vec, row_number() over (partition by vec_id % 10 order by vec_id) as no from embeddings),
p as (select a.stream_id, a.seq, o.seq as old_seq, round(list_sum(list_transform(list_zip(a.vec, o.vec), lambda z: z[1] * z[2])) / (sqrt(list_sum(list_transform(a.vec, lambda x: x * x))) * sqrt(list_sum(list_transform(o.vec, lambda x: x * x)))), 5) as cosine
  from u a join u o on a.stream_id = o.stream_id and o.no between a.no - 32 and a.no - 1 and a.ts_ms - o.ts_ms <= 150000)
select u.stream_id, u.seq, count(old_seq) as compared, max(cosine) as cosine, max(old_seq) filter (cosine = m) as match, coalesce(max(cosine) >= 0.7, false) as repeat from u left join (select *, max(cosine) over (partition by stream_id, seq) as m from p) p on u.stream_id = p.stream_id and u.seq = p.seq group by u.stream_id, u.seq""")
def g9_semantic_repeats(spark, d):
    v = tables.read(spark, d, "embeddings")
    units = v.select((F.col("vec_id") % 10).alias("stream_id"), F.col("vec_id").alias("seq"), (F.col("vec_id") * 5000).alias("ts_ms"), F.col("embedding").cast("array<double>").alias("vec"))
    return dedup.semantic_repeats(units, ["stream_id"])


_NO = "[" + ", ".join(f"'{w}'" for w in dedup.NEGATIONS) + "]"


@query(f"""with {EMISSIONS}, n as (select stream_id, release_seq, ts_ms, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') as w, regexp_matches(text, '["“”„«»]') as quote, row_number() over (partition by stream_id order by release_seq) as no from emissions),
q as (select *, len(w) as n, ' ' || array_to_string(w, ' ') || ' ' as s, list_sort(list_filter(w, lambda x: regexp_full_match(x, '[0-9]+'))) as numbers, list_sort(list_filter(w, lambda x: list_contains({_NO}, x))) as negs from n),
p as (select a.stream_id, a.release_seq, o.release_seq as match, o.no, a.n, o.n as m, a.ts_ms - o.ts_ms as delta_ms, len(list_intersect(a.w, o.w)) as shared, a.w = o.w as same, contains(o.s, a.s) as inside, o.n >= 3 and starts_with(a.s, o.s) as headed,
    list_max(list_filter(range(3, least(a.n - 1, o.n) + 1), lambda k: a.w[1:k] = o.w[o.n - k + 1:o.n])) as suffix,
    concat_ws(',', case when a.numbers <> o.numbers then 'number_changed' end, case when a.negs <> o.negs then 'negation_changed' end, case when a.quote or o.quote then 'quote_present' end, case when a.w = o.w and a.n <= 8 then 'short_exact_repeat' end) as signals
  from q a join q o on a.stream_id = o.stream_id and o.no between a.no - 32 and a.no - 1 and a.ts_ms - o.ts_ms <= 150000 where a.n between 3 and 256 and o.n <= 256),
k as (select *, case when same then 'exact' when inside then 'current_inside_previous' when headed then 'previous_is_current_prefix' when suffix is not null then 'previous_suffix_current_prefix' when shared >= 3 then 'lexical_partial' end as kind from p),
c as (select *, case kind when 'exact' then n when 'current_inside_previous' then n when 'previous_is_current_prefix' then m when 'previous_suffix_current_prefix' then suffix end as covered,
  case kind when 'exact' then 4 when 'current_inside_previous' then 3 when 'lexical_partial' then 1 else 2 end as rank from k where kind is not null),
b as (select *, row_number() over (partition by stream_id, release_seq order by rank desc, coalesce(covered, shared) desc, no desc) as place from c)
select q.stream_id, q.release_seq, q.n as n_words, case when q.n > 256 then 'unscorable_truncated' when q.n < 3 then 'unscorable' when b.kind is null then 'new_content' else ['partial_overlap_guarded', 'overlap_with_new_tail', 'contained_replay', 'exact_replay'][rank] end as verdict,
  coalesce(kind, 'none') as kind, match, cast(covered as bigint) as covered, cast(b.n - covered as bigint) as new_tail, case when kind = 'lexical_partial' then shared end as shared, delta_ms, coalesce(signals, '') as signals
from q left join b on q.stream_id = b.stream_id and q.release_seq = b.release_seq and b.place = 1""")
def g10_text_replay_ledger(spark, d):
    return dedup.text_replay_ledger(tables.emissions(spark, d), ["stream_id"], "release_seq")


@query(f"""with {EMISSIONS}, t as (select stream_id, release_seq, {_TOKENS.format(c='text')} as t from emissions), g as (select stream_id, release_seq, array_to_string(t[i:i + 7], ' ') as gram from (select *, unnest(range(1, len(t) - 6)) as i from t where len(t) >= 8))
select stream_id, substr(sha256(gram), 1, 16) as fingerprint, min(release_seq) as first, count(distinct release_seq) as texts, count(*) as occurrences from g group by stream_id, fingerprint having count(*) > 1""")
def g12_echo_ledger(spark, d):
    return dedup.echo_ledger(tables.emissions(spark, d), ["stream_id"], "release_seq")


_ECHO = """d as (select *, stream_id * 7 + release_seq as code, release_seq * 40000 - case when (stream_id + release_seq) % 3 = 0 then 40000 else 0 end as base, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as tokens from emissions),
w as (select *, case when code % 11 = 0 then [{'s': base + 5000, 'e': base + 9000}] else [] end as taints, unnest(range(len(tokens) - 7)) as i from d where len(tokens) >= 8),
g as (select stream_id, release_seq, i, array_to_string(tokens[i + 1:i + 8], ' ') as gram, base + i * 4800 as start, base + (i + 7) * 4800 + case when (i + 7) % 50 = 49 then 0 else 4000 end as "end", taints, tokens, text from w where len(list_filter(range(i, i + 8), lambda k: k % 50 = 49)) = 0),
f as (select *, first_value({'r': release_seq, 'i': i, 's': start, 'e': "end"}) over (partition by stream_id, gram order by release_seq, i) as f from g),
r as (select stream_id, release_seq as since, unnest(taints) as t from (select distinct stream_id, release_seq, taints from w)),
c as (select f.*, len(list_filter(f.taints, lambda t: f.start < t.e and f."end" > t.s)) > 0 or exists (select 1 from r where r.stream_id = f.stream_id and r.since >= f.f.r and r.since <= f.release_seq and f.f.s < r.t.e and f.f.e > r.t.s) as tainted,
  abs(start - f.f.s) <= 160 and abs("end" - f.f.e) <= 160 as same,
  concat_ws(',', case when len(list_filter(tokens, lambda x: regexp_full_match(x, '[0-9]+'))) > 0 then 'contains_number' end, case when len(list_intersect(tokens, ['nicht', 'nie', 'kein', 'keine', 'keinen', 'nichts', 'ohne'])) > 0 then 'contains_negation' end,
    case when regexp_matches(text, '["«»„“]') then 'quotation' end) as signals from f where f.f.r <> f.release_seq or f.f.i <> f.i)"""


@query(f"""with {EMISSIONS}, {_ECHO} select stream_id, release_seq, i as first_word, f.r as prior, case when f.r = release_seq then 'intra' else 'cross' end as scope, substr(sha256(gram), 1, 16) as fingerprint,
  case when same then 'same' when start < f.e and "end" > f.s then 'overlapping' else 'disjoint' end as relation,
  case when tainted then 'fuzzy_replacement_tainted' when same then 'timestamp_dedup_escape' when signals <> '' then 'intentional_repeat_possible' else 'stale_echo_new_audio' end as class, tainted, signals, greatest(0, "end" - f.e) as age_samples from c""")
def g12_echo_candidates(spark, d):
    """Emissions as decodes, some over the audio of the one before; every fiftieth word has an empty span."""
    base = F.col("release_seq") * 40000 - F.when((F.col("stream_id") + F.col("release_seq")) % 3 == 0, 40000).otherwise(0)
    x = tables.emissions(spark, d).withColumn("tokens", dedup.plain_words(F.col("text"))).withColumn("base", base)
    taint = F.array(F.struct((F.col("base") + 5000).alias("start"), (F.col("base") + 9000).alias("end")))
    x = x.select(
        "stream_id", "release_seq", "text", "tokens", F.transform("tokens", lambda t, i: F.col("base") + i * 4800).alias("starts"),
        F.transform("tokens", lambda t, i: F.col("base") + i * 4800 + F.when(i % 50 == 49, 0).otherwise(4000)).alias("ends"), F.when((F.col("stream_id") * 7 + F.col("release_seq")) % 11 == 0, taint).otherwise(F.slice(taint, 1, 0)).alias("taints"),
    )
    return dedup.echo_candidates(x, ["stream_id"], "release_seq")


@query(f"""with {TEXTS}, t as (select doc_id, {_TOKENS.format(c='text')} as t from texts), g as (select doc_id, len(t) as n_words, i, array_to_string(t[i:i + 5], ' ') as gram from (select *, unnest(range(1, len(t) - 4)) as i from t where len(t) >= 6)),
f as (select *, min(i) over (partition by doc_id, gram) as first_ from g), c as (select distinct doc_id, n_words, unnest(range(i, i + 6)) as w from f where i - first_ >= 12)
select t.doc_id, len(t.t) as n_words, count(w) as covered, case when count(w) = 0 or count(w) * 10 > len(t.t) * 7 then 'keep' else 'trim' end as action from t left join c on t.doc_id = c.doc_id group by t.doc_id, len(t.t)""")
def g4_intra_line_dedup(spark, d):
    return dedup.intra_line_dedup(tables.texts(spark, d), ["doc_id"]).withColumn("n_words", F.col("n_words").cast("long"))


# --- hypotheses ----------------------------------------------------------------------------------------------------


@query(f"""with {EMISSIONS}, w as (select stream_id, release_seq, {_WORDS.format(c='text')} as w, lag({_WORDS.format(c='text')}) over (partition by stream_id order by release_seq) as v from emissions),
a as (select stream_id, release_seq, len(w) as n_words, case when v is null then 0 else coalesce(list_min(list_filter(range(1, len(w) + 1), lambda i: i > len(v) or w[i] <> v[i])) - 1, len(w)) end as agreed from w)
select stream_id, release_seq, n_words, agreed, max(agreed) over (partition by stream_id order by release_seq) as confirmed from a""")
def h1_local_agreement(spark, d):
    out = stabilize.local_agreement(tables.emissions(spark, d), ["stream_id"], "release_seq")
    return out.select("stream_id", "release_seq", *[F.col(c).cast("long").alias(c) for c in ("n_words", "agreed", "confirmed")])


@query(f"""with {EMISSIONS}, n as (select stream_id, release_seq, len({_WORDS.format(c='text')}) as n_words from emissions), u as (select *, cast(sum(n_words) over (partition by stream_id order by release_seq) as bigint) as upto from n)
select stream_id, release_seq, n_words, greatest(0, upto - 5) - greatest(0, upto - n_words - 5) as emitted, upto - greatest(0, upto - 5) as held from u""")
def h5_hold_last_n(spark, d):
    out = stabilize.hold_last_n(tables.emissions(spark, d), ["stream_id"], "release_seq", 5)
    return out.select("stream_id", "release_seq", *[F.col(c).cast("long").alias(c) for c in ("n_words", "emitted", "held")])


@query(f"""with {tables.TELEMETRY}, r as (select *, stage as digest, max(k) over (partition by stream_id order by ts_ms, seq rows between unbounded preceding and 1 preceding) as top,
  first_value(stage) over (partition by stream_id, k order by ts_ms, seq) as first_, row_number() over (partition by stream_id, k order by ts_ms, seq) as place from telemetry)
select stream_id, seq, k, case when place > 1 then case when digest = first_ then 'duplicate' else 'conflict' end when top is null or k > top then 'accept' else 'stale' end as verdict from r""")
def h7_release_guard(spark, d):
    t = tables.telemetry(spark, d).withColumn("arrival", F.col("seq"))
    return stabilize.release_guard(t, ["stream_id"], "k", F.col("stage")).select("stream_id", "seq", "k", "verdict")


# --- spans and delivery --------------------------------------------------------------------------------------------

_MERGED = f"""{SPANS}, o as (select *, max("end") over (partition by space order by start, "end" rows between unbounded preceding and 1 preceding) as reach from spans where "end" > start),
i as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (partition by space order by start, "end" rows between unbounded preceding and current row) as island from o),
merged as (select space, min(start) as start, max("end") as "end", count(*) as n_spans from i group by space, island)"""


@query(f"with {_MERGED} select * from merged")
def i4_merge_intervals(spark, d):
    return merge_intervals(tables.spans(spark, d), ["space"], "start", "end")


@query(f"""with {SPANS} select a.space, a.id as a_id, a.word as a_word, b.id as b_id, b.word as b_word, least(a."end", b."end") - greatest(a.start, b.start) as overlap
from spans a join spans b on a.space = b.space and a.start < b."end" and b.start < a."end" and a."end" > a.start and b."end" > b.start where a.id < b.id""")
def i5_overlap_join(spark, d):
    s = tables.spans(spark, d)
    side = lambda p: s.select("space", F.struct("id", "word").alias(f"{p}_id"), F.col("start").alias(f"{p}_start"), F.col("end").alias(f"{p}_end"))
    out = spans.overlap_join(side("a"), side("b"), ["space"]).where("a_id.id < b_id.id")
    return out.select("space", F.col("a_id.id").alias("a_id"), F.col("a_id.word").alias("a_word"), F.col("b_id.id").alias("b_id"), F.col("b_id.word").alias("b_word"), "overlap")


@query(f"with {SPANS}, a as (select space, id, word, start, lag(start) over (partition by space order by id, word) as before from spans) select space, count(*) as n, count(*) filter (start = before) as equal_steps, count(*) filter (start < before) as negative_steps, count(*) filter (start < before) = 0 as monotone from a group by space")
def i8_sequence_audit(spark, d):
    return spans.sequence_audit(tables.spans(spark, d), ["space"], ["id", "word"], "start")


@query(f"""with {_MERGED}, c as (select space, count(*) as n_words, count(*) filter ("end" > start) as proven from spans group by space), m as (select space, cast(sum("end" - start) as bigint) as covered, count(*) as ranges from merged group by space)
select space, n_words, proven, coalesce(covered, 0) as covered, coalesce(ranges, 0) as ranges, case when proven = n_words then 'complete' when proven > 0 then 'partial' else 'missing' end as status from c left join m using (space)""")
def i12_coverage_map(spark, d):
    return spans.coverage_map(tables.spans(spark, d), ["space"])


@query(f"""with {SPANS}, p as (select space, id, word, start as a_start, "end" as a_end, lead(start) over w as b_start, lead("end") over w as b_end from spans window w as (partition by space order by start, "end", id, word))
select space, id, word, case when a_start = b_start and a_end = b_end then 'same_source' when b_start <= a_start and b_end >= a_end then 'newer_contains_older' when a_start <= b_start and a_end >= b_end then 'older_contains_newer'
  when a_start < b_end and b_start < a_end then 'partial' when a_end = b_start or b_end = a_start then 'adjacent' else 'disjoint' end as relation from p where b_start is not null""")
def i13_revision_relation(spark, d):
    w = Window.partitionBy("space").orderBy("start", "end", "id", "word")
    s = tables.spans(spark, d).select("space", "id", "word", F.col("start").alias("a_start"), F.col("end").alias("a_end"), F.lead("start").over(w).alias("b_start"), F.lead("end").over(w).alias("b_end"))
    return spans.revision_relation(s.where("b_start is not null")).select("space", "id", "word", "relation")


@query(f"""with {SPANS}, r as (select * from spans where "end" - start > 400), o as (select *, max("end") over (partition by space order by start, "end" rows between unbounded preceding and 1 preceding) as reach from r where "end" > start),
i as (select *, sum(case when reach is null or start > reach then 1 else 0 end) over (partition by space order by start, "end" rows between unbounded preceding and current row) as island from o),
m as (select space, min(start) as start, max("end") as "end" from i group by space, island),
c as (select s.space, s.id, s.word, exists (select 1 from m where m.space = s.space and m.start <= s.start and m."end" >= s."end") as inside from spans s)
select space, id, count(*) as n_words, coalesce(min(word) filter (not inside) - 1, max(word)) as committed from c group by space, id""")
def j3_committed_prefix(spark, d):
    s = tables.spans(spark, d)
    return spans.committed_prefix(s, s.where(F.col("end") - F.col("start") > 400).select("space", "start", "end"), ["space"], ["id"])


@query("""with l as (select l_orderkey as release, l_linenumber - 1 as sentence_index, count(*) over (partition by l_orderkey) as total, l_returnflag <> 'R' as started, l_tax > 0.07 as conflicted from lineitem),
g as (select release, count(distinct total) as totals, max(total) as total, count(*) filter (conflicted) as conflicts, count(distinct case when started then sentence_index end) as started from l group by release)
select *, totals = 1 and conflicts = 0 and started = total as committed from g""")
def j2_committed_releases(spark, d):
    li = tables.read(spark, d, "lineitem")
    ledger = li.select(F.col("l_orderkey").alias("release"), (F.col("l_linenumber") - 1).alias("sentence_index"), F.count("*").over(Window.partitionBy("l_orderkey")).alias("total"), (F.col("l_returnflag") != "R").alias("started"), (F.col("l_tax") > 0.07).alias("conflicted"))
    return delivery.committed_releases(ledger, ["release"])


@query(f"""with {SPANS}, g as (select id, start, "end", start - lag("end") over (partition by id order by start, "end") as gap, greatest(0.5, least(2.0, word * 0.4::double)) as rate from spans)
select id, count(*) as plays, count(*) filter (gap < 0) as overlaps, max(case when gap is not null then greatest(gap, 0) else 0 end) as longest_silence, cast(max(rate) as double) as max_rate, max("end") - min(start) as duration from g group by id""")
def j4_playback_report(spark, d):
    return delivery.playback_report(tables.spans(spark, d).withColumn("rate", F.col("word") * 0.4), ["id"])


@query(f"""with {tables.TELEMETRY}, n as (select stream_id, seq, ts_ms, max(ts_ms) over (partition by stream_id) - ts_ms > 1000000000 as aged from telemetry),
r as (select *, count(*) filter (not aged) over (partition by stream_id order by ts_ms desc, seq desc) as kept from n)
select stream_id, seq, case when aged then 'age_budget' else 'backlog_budget' end as reason from r where aged or kept * 4000 > 60000""")
def j5_budget_drops(spark, d):
    pending = tables.telemetry(spark, d).withColumn("now_ms", F.max("ts_ms").over(Window.partitionBy("stream_id")))
    return delivery.budget_drops(pending, ["stream_id"], 1_000_000_000, 60_000).select("stream_id", "seq", "reason")


@query(f"with {SPANS}, n as (select *, row_number() over (partition by space order by id, word) as no from spans) select space, id, word from n where no = 1")
def j7_next_pending(spark, d):
    return delivery.next_pending(tables.spans(spark, d), ["space"], ["id", "word"])


@query("""with o as (select l_orderkey as release, case l_returnflag when 'R' then 'dropped' when 'A' then 'started' else 'completed' end as outcome from lineitem where l_quantity > 20),
b as (select release, arg_max(outcome, case outcome when 'completed' then 3 when 'started' then 2 else 1 end) as terminal, count(*) as outcomes from o group by release)
select o_orderkey as release, coalesce(terminal, 'lost') as terminal, coalesce(outcomes, 0) as outcomes from (select distinct o_orderkey from orders) left join b on o_orderkey = release""")
def j8_release_funnel(spark, d):
    flag = F.when(F.col("l_returnflag") == "R", "dropped").when(F.col("l_returnflag") == "A", "started").otherwise("completed")
    outcomes = tables.read(spark, d, "lineitem").where("l_quantity > 20").select(F.col("l_orderkey").alias("release"), flag.alias("outcome"))
    audited = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("release"))
    return delivery.release_funnel(audited, outcomes, ["release"], {"completed": 3, "started": 2, "dropped": 1})


@query(f"""with {tables.TELEMETRY}, f as (select stream_id, k, min(ts_ms) as ts_ms, count(*) as writes, count(distinct stage) > 1 as conflict from telemetry group by stream_id, k) select * from f""")
def a5_dedupe_idempotent(spark, d):
    return delivery.dedupe_idempotent(tables.telemetry(spark, d), ["stream_id", "k"], F.col("stage"), ["ts_ms"])
