"""Live quality of streams, roll-ups of sessions and audits of sequences, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import delivery, lineage, live_quality, metrics, session, spans
from ..operators.live_quality import CAUSES, COUNTERS, EMISSION_STAGES, LIMITS, OF_LISTENER, SERIES, STREAMS
from ..sources import tables
from ..sources.tables import SPANS, TELEMETRY
from .registry import query
from .stream_queries import _SCORE

_STAGES = ("listener_telemetry", "whisper", "translation", "tts", "emission_decision", "fallback", "source_stall", "emission_controller_runtime", "other", "whisper", "translation")
_DECISIONS = ("emit", "drop", "audio_skip", "emit", "text_only", "fallback", "emit", "emit")
_WINDOW, _SLIDE, _LISTENER = 7_200_000, 1_200_000, 3_600_000


def quality_records(spark, d):
    """Events as records of eleven kinds; each has some of the series."""
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    t = tables.telemetry(spark, d).withColumn("stage", pick(_STAGES, F.col("k") % 11)).withColumn("decision", F.when(F.col("k") % 3 == 0, pick(_DECISIONS, F.col("seq") % 8)))
    series = {s: F.when((F.col("seq") + i) % 5 == 0, (F.col("value") - 5) * (0.4 if s.endswith("depth") else 150)) for i, s in enumerate(SERIES)}
    return t.select(
        "stream_id", "ts_ms", "stage", "decision", F.when(F.col("k") % 37 == 0, "partial_fallback").when(F.col("k") % 41 == 0, "hasNew_false").alias("reason"), F.when(F.col("k") % 9 == 0, F.col("k") % 4).alias("duplicates"),
        F.when(F.col("seq") % 13 == 0, F.col("seq")).alias("emission_id"), F.when(F.col("seq") % 4 == 0, F.col("value") * 100).alias("latency_ms"), F.when(F.col("k") % 5 != 4, F.col("k") * 40_000 - 100_000).alias("measurement_age_ms"),
        *[c.alias(s) for s, c in series.items()],
    )


_CASES = ", ".join(f"case when (seq + {i}) % 5 = 0 then (value - 5) * {0.4 if s.endswith('depth') else 150}::double end as {s}" for i, s in enumerate(SERIES))
_RECORDS = f"""{TELEMETRY}, rec as (
  select stream_id, ts_ms, row_number() over () as rid, {list(_STAGES)}[k % 11 + 1] as stage, case when k % 3 = 0 then {list(_DECISIONS)}[seq % 8 + 1] end as decision,
    case when k % 37 = 0 then 'partial_fallback' when k % 41 = 0 then 'hasNew_false' end as reason, case when k % 9 = 0 then k % 4 end as duplicates, case when seq % 13 = 0 then seq end as emission_id,
    case when seq % 4 = 0 then value * 100 end as latency_ms, case when k % 5 <> 4 then k * 40000 - 100000 end as age, {_CASES} from telemetry)"""
_ENDS = f"ends as (select distinct stream_id, e * {_SLIDE} as end_ms from (select stream_id, unnest(range(cast(ceil(ts_ms / {_SLIDE}.0) as bigint), (ts_ms + {_WINDOW}) // {_SLIDE} + 1)) as e from rec))"
_VALUES = " union all ".join(
    f"select stream_id, end_ms, '{s}' as series, greatest(0, {v}) as v from win where {v} is not null" + (" and fresh" if s in OF_LISTENER else "")
    for s in SERIES for v in [{"whisper_ms": "coalesce(whisper_ms, case when stage = 'whisper' then latency_ms end)", "gpt_ms": "coalesce(gpt_ms, case when stage = 'translation' then latency_ms end)", "tts_ms": "coalesce(tts_ms, case when stage = 'tts' then latency_ms end)"}.get(s, s)]
)
_EMISSION = ", ".join(f"'{s}'" for s in EMISSION_STAGES)
_COUNTS = {
    "emissions": f"count(*) filter (stage in ({_EMISSION}, 'translation') or emission_id is not null)", "translations": "count(*) filter (stage = 'translation')", "tts": "count(*) filter (stage = 'tts')",
    "drops": "count(*) filter (decision = 'drop')", "audio_skips": "count(*) filter (decision in ('audio_skip', 'text_only'))", "duplicates": "cast(coalesce(sum(duplicates), 0) as bigint)",
    "fallbacks": "count(*) filter (stage = 'fallback' or decision = 'fallback' or reason = 'partial_fallback')", "source_stalls": "count(*) filter (stage = 'source_stall' or reason = 'hasNew_false')",
}
_OF = {"listener": "stage = 'listener_telemetry'", "whisper": "stage = 'whisper' or whisper_ms is not null", "translation": "stage = 'translation' or gpt_ms is not null", "tts": "stage = 'tts' or tts_ms is not null", "emission": f"stage in ({_EMISSION})"}
_SEEN = ", ".join(f"max(ts_ms) filter ({cond}) as ts_{s}" for s, cond in _OF.items())


def _rank(name: str) -> str:
    column = name if name.endswith("_rate") else f"p95_{name}"
    return f"case when {column} >= {LIMITS[name][1]} then 2 when {column} >= {LIMITS[name][0]} then 1 else 0 end"


_RANKS = ", ".join(
    (f"case when listener_status = 'live' then greatest({', '.join(map(_rank, p))}) end" if c == "listener_drift" else f"greatest({', '.join(map(_rank, p))}, case when {'source_stalls > 0' if c == 'source_stall' else 'false'} then 1 else 0 end)") + f" as r_{c}"
    for c, p in CAUSES.items()
)
_FIRST = lambda level: "coalesce(" + ", ".join(f"case when r_{c} = {level} then '{c}' end" for c in CAUSES) + ")"
_SQL = f"""with {_RECORDS}, {_ENDS},
win as (select r.*, e.end_ms, stage <> 'listener_telemetry' or age is not null and greatest(0, age) + e.end_ms - ts_ms <= {_LISTENER} as fresh
  from ends e join rec r on r.stream_id = e.stream_id and r.ts_ms between e.end_ms - {_WINDOW} and e.end_ms),
vals as ({_VALUES}), num as (select *, row_number() over (partition by stream_id, end_ms, series order by v) - 1 as i, count(*) over (partition by stream_id, end_ms, series) as n from vals),
p as (select stream_id, end_ms, count(*) as n_values, {", ".join(f"max(case when series = '{s}' and i = least(n - 1, floor(n * 0.95)) then v end) as p95_{s}" for s in SERIES)} from num group by all),
cnt as (select stream_id, end_ms, {", ".join(f"{e} as {c}" for c, e in _COUNTS.items())} from win group by all),
seen as (select e.stream_id, e.end_ms, {_SEEN}, arg_max(coalesce(age, -1e18), ts_ms * 1000000 + coalesce(age, -900000)) filter (stage = 'listener_telemetry') as age_l from ends e join rec r on r.stream_id = e.stream_id and r.ts_ms <= e.end_ms group by all),
x as (select cnt.*, coalesce(n_values, 0) + {" + ".join(COUNTERS)} as samples, {", ".join(f"p95_{s}" for s in SERIES)},
    floor((drops + audio_skips) / greatest(1, emissions)::double * 10000 + 0.5) / 10000 as drop_rate, floor(duplicates / greatest(1, emissions)::double * 10000 + 0.5) / 10000 as duplicate_rate, floor(fallbacks / greatest(1, emissions)::double * 10000 + 0.5) / 10000 as fallback_rate,
    case when ts_listener is null then 'missing' when age_l < -1e17 then 'unknown' when greatest(0, age_l) + cnt.end_ms - ts_listener <= {_LISTENER} then 'live' else 'stale' end as listener_status,
    {", ".join(f"case when ts_{s} is null then 'missing' when cnt.end_ms - ts_{s} <= {_WINDOW} then 'live' else 'stale' end as {s}_status" for s in STREAMS if s != "listener")}
  from cnt join seen on cnt.stream_id = seen.stream_id and cnt.end_ms = seen.end_ms left join p on cnt.stream_id = p.stream_id and cnt.end_ms = p.end_ms),
r as (select *, {_RANKS} from x)
select stream_id, end_ms, case when {_FIRST(2)} is not null then 'critical' when {_FIRST(1)} is not null then 'degraded' when {" or ".join(f"{s}_status <> 'live'" for s in STREAMS)} then 'unknown' else 'good' end as state,
  coalesce({_FIRST(2)}, {_FIRST(1)}, 'healthy') as main_cause, floor(least(1.0::double, samples / 5.0::double) * 10000 + 0.5) / 10000 as confidence, samples, {", ".join(f"p95_{s}" for s in SERIES)}, {", ".join(COUNTERS)}, drop_rate, duplicate_rate, fallback_rate,
  {", ".join(f"{s}_status" for s in STREAMS)}, {", ".join(f"coalesce(['good', 'degraded', 'critical'][r_{c} + 1], 'unknown') as cause_{c}" for c in CAUSES)} from r"""


@query(_SQL)
def c1_live_quality(spark, d):
    return live_quality.live_quality(quality_records(spark, d), ["stream_id"], _WINDOW, _SLIDE, _LISTENER)


def quality_log(spark, d):
    """Events as emissions of a session in a language."""
    t = tables.telemetry(spark, d)
    pause = F.when(F.col("seq") % 7 != 0, (F.col("value") * 200).cast("long") % 20_000)
    return t.select(
        "stream_id", "seq", F.col("stage").alias("lang"), (F.col("k") % 3).alias("repeats"), (F.col("k") % 2).alias("bigrams"), (F.col("k") % 5 == 0).cast("long").alias("trigrams"), pause.alias("pause_ms"),
        F.when(F.col("k") % 4 != 0, F.col("k") % 3 == 0).alias("speaker"), F.when(F.col("k") % 6 != 0, F.col("value") * 100).alias("latency_ms"),
    )


_LOG = f"""{TELEMETRY}, qlog as (select stream_id, stage as lang, k % 3 as repeats, k % 2 as bigrams, cast(k % 5 = 0 as bigint) as trigrams, case when seq % 7 <> 0 then cast(floor(value * 200) as bigint) % 20000 end as pause0,
    case when k % 4 <> 0 then k % 3 = 0 end as speaker, case when k % 6 <> 0 then value * 100 end as latency_ms from telemetry),
plog as (select *, case when pause0 > 0 then pause0 end as p from qlog)"""


def _report(keys: str, one: bool) -> str:
    bucket = {"0-3s": "p < 3000", "3-7s": "p >= 3000 and p < 7000", "7-15s": "p >= 7000 and p < 15000", ">15s": "p >= 15000"}
    spread = lambda c, name: f"""min({c}) as {name}_min, max({c}) as {name}_max, cast(floor(avg({c}) + 0.5) as bigint) as {name}_avg, list_sort(list({c}) filter ({c} is not null))[cast(least(count({c}) - 1, floor(0.5 * count({c}))) as integer) + 1] as {name}_median"""
    return f"""select {keys}, count(*) as emissions, cast(sum(repeats) as bigint) as repeats, cast(sum(bigrams) as bigint) as bigrams, cast(sum(trigrams) as bigint) as trigrams,
  {", ".join(f'count(*) filter ({c}) as "pauses_{b}"' for b, c in bucket.items())}, count(*) filter (p is not null and coalesce(speaker, false)) as speaker_pauses, count(*) filter (p >= 7000 and not coalesce(speaker, false)) as long_pauses,
  {spread("p", "pause")}, {spread("latency_ms", "latency")} from plog group by {keys}"""


@query(f"with {_LOG} {_report('stream_id, lang', False)}")
def q10_language_pauses(spark, d):
    return session.language_report(quality_log(spark, d), ["stream_id", "lang"])


_NAMES = ("pass", "skip", "trim")
_OBJECTIVE = _SCORE.split("log as (", 1)[1].split("s as (", 1)[1]
_OBJECTIVE = _OBJECTIVE.replace("md as (select stream_id, list_sort(list(latency_ms))[cast(least(count(*) - 1, floor(0.5 * count(*))) as integer) + 1] as median_ms from log", "md as (select stream_id, latency_median as median_ms from rep").replace("from log", "from olog").replace("from rep group by stream_id", "from rep")


@query(f"""with {_LOG}, rep as ({_report('stream_id', True)}), olog as (select stream_id, lang, repeats, coalesce(pause0 >= 7000 and not coalesce(speaker, false), false) as long_pause, latency_ms from qlog),
s as ({_OBJECTIVE}, o as (select stream_id, segments, langs, rejection, case when rejection is not null then 1e9 else floor((r_norm + 2 * p_norm + 5 * s_norm) * 10000 + 0.5) / 10000 end as score,
  case when rejection is not null then 1e9 else floor((r_norm + 2 * p_norm + 5 * s_norm) / conf * 10000 + 0.5) / 10000 end as weighted_score, floor(conf * 1000 + 0.5) / 1000 as confidence, segments < 150 or duration_min < 15 as low_confidence from y),
f as (select stream_id, {", ".join(f"count(*) filter (k % 11 = {i}) as {n}" for i, n in enumerate(_NAMES))} from telemetry where k % 11 < 3 group by stream_id)
select rep.*, o.segments, o.langs, o.rejection, o.score, o.weighted_score, o.confidence, o.low_confidence, {", ".join(f"coalesce({n}, 0) as {n}" for n in _NAMES)} from rep join o using (stream_id) left join f using (stream_id)""")
def q9_session_rollup(spark, d):
    t = tables.telemetry(spark, d)
    sessions = t.groupBy("stream_id").agg(F.count("*").alias("segments"), ((F.max("ts_ms") - F.min("ts_ms")) / 60000.0 / 100).alias("duration_min"))
    actions = t.where(F.col("k") % 11 < 3).select("stream_id", F.get(F.array(*[F.lit(n) for n in _NAMES]), (F.col("k") % 11).cast("int")).alias("action"))
    return session.session_summary(quality_log(spark, d), sessions, actions, ["stream_id"], list(_NAMES))


_TIMES = f"""{TELEMETRY}, ts as (select stream_id, seq, case when k % 23 = 0 then null when seq < 900 then 0.0 else cast(floor(seq / 160) as double) / 8 - case when k % 19 = 0 then 0.5 when k % 5 = 0 then 0.001 else 0 end end as v from telemetry),
n as (select *, round(v, 2) as r, row_number() over w as i, lag(v) over w as p, lag(round(v, 2)) over w as q from ts window w as (partition by stream_id order by seq)),
m as (select *, sum(case when v = p then 0 else 1 end) over (partition by stream_id order by i) as run, sum(case when r = q then 0 else 1 end) over (partition by stream_id order by i) as rrun from n)"""
_RUNS = "select stream_id, max(len) as {longest}, coalesce(string_agg(len || ':' || c, ',' order by len) filter (len > 1), '') as {name} from (select stream_id, len, count(*) as c from (select stream_id, count(*) as len from m where v is not null group by stream_id, {island}) group by stream_id, len) group by stream_id"


@query(f"""with {_TIMES}, a as ({_RUNS.format(longest="longest", name="runs", island="run")}), b as ({_RUNS.format(longest="rounded_longest", name="rounded_runs", island="rrun")}),
c as (select stream_id, count(*) as n, count(v) as measurable, count(distinct v) as distinct_values, count(distinct r) as distinct_rounded, count(v - p) as pairs, count(*) filter (v = p) as equal_steps, count(*) filter (v <> p and r = q) as rounded_steps,
  count(*) filter (v < p) as negative_steps, round(min(v - p) filter (v > p), 6) as least_step, coalesce(min(i) filter (v is null or v <> 0) - 1, count(*)) as leading_zeros from m group by stream_id)
select c.*, coalesce(longest, 0) as longest, coalesce(runs, '') as runs, coalesce(rounded_longest, 0) as rounded_longest, coalesce(rounded_runs, '') as rounded_runs, case when pairs > 0 then negative_steps = 0 end as monotone
from c left join a using (stream_id) left join b using (stream_id)""")
def i8_token_sequence_audit(spark, d):
    """Events as timestamps: zeros first, then slow steps with nulls, steps back and steps that only rounding hides."""
    off = F.when(F.col("k") % 19 == 0, 0.5).when(F.col("k") % 5 == 0, 0.001).otherwise(0.0)
    v = F.when(F.col("k") % 23 == 0, None).when(F.col("seq") < 900, 0.0).otherwise(F.floor(F.col("seq") / 160).cast("double") / 8 - off)
    return spans.token_sequence_audit(tables.telemetry(spark, d).select("stream_id", "seq", v.alias("v")), ["stream_id"], ["seq"], "v")


@query(f"""with {SPANS}, r as (select space, id * 10 + word as rid, start, max("end") as "end" from spans group by all), p as (select distinct space, start + 7 as at_ from spans where word % 3 = 1),
j as (select p.space, p.at_, rid, start from p join r on r.space = p.space and r.start <= p.at_ and p.at_ < r."end"), c as (select space, at_, count(*) as n, min((start, rid)) as o from j group by all)
select p.space, p.at_ as "at", coalesce(n, 0) as in_flight, o[2] as oldest, p.at_ - o[1] as oldest_age, case when o is not null then p.at_ - greatest(o[1], least(p.at_, o[1] + 50)) end as oldest_attempt_age from p left join c on p.space = c.space and p.at_ = c.at_""")
def b11_in_flight_at(spark, d):
    s = tables.spans(spark, d)
    requests = s.groupBy("space", (F.col("id") * 10 + F.col("word")).alias("id"), "start").agg(F.max("end").alias("end")).withColumn("attempt_start", F.col("start") + 50)
    return metrics.in_flight_at(requests, s.where("word % 3 = 1").select("space", (F.col("start") + 7).alias("at")), ["space"])


@query(f"""with {TELEMETRY}, r as (select stream_id, seq, k, stage, ts_ms, row_number() over w as no, first_value(stage) over w as f from telemetry window w as (partition by stream_id, k order by ts_ms, seq)),
i as (select stream_id, k, row_number() over (partition by stream_id order by ts_ms, seq, k) as place from r where no = 1)
select r.stream_id, r.seq, case when place > 40 then 'full' when no = 1 then 'accepted' when stage = f then 'duplicate' else 'conflict' end as verdict from r join i on r.stream_id = i.stream_id and r.k = i.k""")
def a5_accepted_writes(spark, d):
    t = tables.telemetry(spark, d)
    return delivery.accepted_writes(t, ["stream_id"], "k", F.col("stage"), ["ts_ms", "seq"], 40).select("stream_id", "seq", "verdict")


_DB = "case when {c} > 0 then 20 * log10({c}) end"


@query(f"""with f as (select label, vec_id as frame, list_transform(embedding, lambda v: v::double * case label % 3 when 0 then 0.02 when 1 then 1 else 4 end * case when vec_id % 4 = 0 then 0.05 else 1 end) as s from embeddings),
e as (select label, frame, list_sum(list_transform(s, lambda v: v * v)) as e, len(s) as k, list_max(list_transform(s, lambda v: abs(v))) as p from f where len(s) > 0),
r as (select *, sqrt(e / k) as lv, row_number() over (partition by label order by sqrt(e / k), frame) as r, count(*) over (partition by label) as n from e),
x as (select label, count(*) as frames, sqrt(sum(e) / sum(k)) as rms, max(p) as peak, avg(lv) filter (r <= greatest(1, floor(n * 0.2))) as noise from r group by label),
y as (select *, {_DB.format(c="rms")} as db, {_DB.format(c="peak")} as peak_db, {_DB.format(c="noise")} as noise_db from x), z as (select *, coalesce(db - noise_db, 0) as snr from y),
s as (select *, greatest(0, least(100, floor(100 - case when rms < 0.01 then 30 * (1 - rms / 0.01) when rms > 0.9 then 40 when rms < 0.1 then 15 when rms > 0.4 then 10 else 0 end
  - case when snr < 10 then 30 * (1 - snr / 10) when snr < 20 then 10 when snr >= 30 then -5 else 0 end - case when peak >= 0.99 then 20 when peak >= 0.95 then 10 else 0 end + 0.5))) as score from z)
select label, frames, {", ".join(f"round({c}, 5) as {c}" for c in ("rms", "peak", "noise", "db", "peak_db", "noise_db", "snr"))}, round(peak_db - noise_db, 5) as dynamic_range, 20 * log10(rms + 1e-10) > -45 as gate, cast(score as bigint) as score,
  case when score >= 90 then 'excellent' when score >= 75 then 'good' when score >= 50 then 'acceptable' when score >= 25 then 'poor' else 'unusable' end as quality,
  concat_ws(',', case when rms < 0.01 then 'too_quiet' end, case when peak >= 0.99 then 'clipping' when peak >= 0.95 then 'near_clipping' end, case when snr < 10 then 'high_noise' when snr < 20 then 'moderate_noise' end) as issues from s""")
def k1_audio_quality(spark, d):
    """Vectors as frames of samples; labels differ in gain, and every fourth frame is quiet."""
    gain = F.when(F.col("label") % 3 == 0, 0.02).when(F.col("label") % 3 == 1, 1.0).otherwise(4.0) * F.when(F.col("vec_id") % 4 == 0, 0.05).otherwise(1.0)
    frames = tables.read(spark, d, "embeddings").select("label", F.col("vec_id").alias("frame"), F.transform(F.col("embedding").cast("array<double>"), lambda v: v * gain).alias("samples"))
    return lineage.audio_quality(frames, ["label"])
