"""Queries of metrics, health, policy and sessions, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import core, health, metrics, policy, session
from ..sources import tables
from ..sources.tables import DECISIONS, EMISSIONS, SPANS, TELEMETRY, TEXTS
from .registry import query

_TOKENS = "regexp_extract_all(translate(lower({c}), '" + tx.MARKED + "', '" + tx.PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"


# --- metrics -------------------------------------------------------------------------------------------------------


def _ranks(by: str, source: str, value: str = "value") -> str:
    at = lambda p: f"list_sort(list({value}))[cast(least(count(*) - 1, floor({p} * count(*))) as integer) + 1]"
    return f"select {by}, count(*) as n, min({value}) as min, max({value}) as max, round(sum({value}) / count(*), 8) as avg, {at(0.5)} as p50, {at(0.95)} as p95, {at(0.99)} as p99 from {source} where {value} is not null group by {by}"


@query(f"with {TELEMETRY} {_ranks('stage', 'telemetry')}")
def b4_floor_rank_summary(spark, d):
    return core.floor_rank_summary(tables.telemetry(spark, d), ["stage"], "value").withColumn("avg", F.round("avg", 8))


@query(f"with {TELEMETRY}, newest as (select *, row_number() over (partition by stream_id, stage order by ts_ms desc, seq desc) as no from telemetry) {_ranks('stream_id, stage', '(select * from newest where no <= 50)')}")
def b5_last_n_stats(spark, d):
    return metrics.last_n_stats(tables.telemetry(spark, d), ["stream_id", "stage"], 50).withColumn("avg", F.round("avg", 8))


@query(f"with {TELEMETRY} select stream_id, seq, ts_ms, cast(place as integer) as place from (select *, row_number() over (partition by stream_id order by ts_ms desc, seq desc) as place from telemetry) where place <= 10")
def b6_recent_top_k(spark, d):
    return metrics.recent_top_k(tables.telemetry(spark, d), ["stream_id"]).select("stream_id", "seq", "ts_ms", "place")


@query(f"with {TELEMETRY} select stream_id, stage, count(*) as n, cast(floor(avg(value) + 0.5) as bigint) as avg from telemetry group by stream_id, stage")
def b7_stream_breakdown(spark, d):
    return metrics.stream_breakdown(tables.telemetry(spark, d), ["stream_id", "stage"])


@query(f"""with {DECISIONS}, r as (select cast(stream_id as varchar) as stream, stage, controller_action as action, controller_action <> runtime_action as differs from decisions)
select case when grouping(stream) = 0 then 'stream' when grouping(stage) = 0 then 'stage' when grouping(action) = 0 then 'action' else 'all' end as kind,
  coalesce(stream, stage, action, 'all') as name, count(*) as n, count(*) filter (differs) as mismatches from r group by grouping sets ((stream), (stage), (action), ())""")
def b8_emission_summary(spark, d):
    return metrics.emission_summary(tables.decisions(spark, d))


@query(f"""with {DECISIONS}, x as (select seq, case when controller_action = 'hold' then 'text_only' when controller_action = 'merge' then 'tts' else controller_action end as decision, greatest(0.0, age_ms - 5000) as age_ms, queue_depth from decisions),
y as (select seq, case when decision = 'text_only' then 'audio_skip' when decision = 'tts' then 'emit' else decision end as decision, age_ms, queue_depth from x)
select seq, decision, case when decision = 'drop' then 'drop' when decision = 'audio_skip' then 'audio_skip' when age_ms <= 3000 then 'quality' when age_ms <= 7000 then 'fast' when age_ms <= 12000 then 'catchup' else 'audio_skip' end as mode, age_ms, queue_depth from y""")
def b9_emission_decision_metric(spark, d):
    alias = F.when(F.col("controller_action") == "hold", "text_only").when(F.col("controller_action") == "merge", "tts").otherwise(F.col("controller_action"))
    return metrics.emission_decision_metric(tables.decisions(spark, d).withColumn("decision", alias).withColumn("age_ms", F.col("age_ms") - 5000))


@query(f"""with {TELEMETRY} select stream_id, k, count(*) as attempts, max(ts_ms) - min(ts_ms) as age_ms, arg_max(cast(400 + k as varchar), (ts_ms, seq)) as code from telemetry group by stream_id, k""")
def b10_request_lifecycle(spark, d):
    events = tables.telemetry(spark, d).withColumn("message", F.concat(F.lit("HTTP "), (F.col("k") + 400).cast("string"), F.lit(" from provider")))
    return metrics.request_lifecycle(events, ["stream_id", "k"])


@query(f"""with {SPANS}, net as (select space, pos, sum(d) as d from (select space, start as pos, 1 as d from spans union all select space, "end", -1 from spans) group by space, pos),
running as (select space, pos, cast(sum(d) over (partition by space order by pos) as bigint) as n_open from net)
select space, max(n_open) as most, min(pos) filter (n_open = m) as first_at from (select *, max(n_open) over (partition by space) as m from running) group by space""")
def b11_in_flight_profile(spark, d):
    return metrics.in_flight_profile(tables.spans(spark, d), ["space"])


@query(f"""with {TELEMETRY} select stream_id, cast(floor(ts_ms / 3600000) as bigint) as "window", count(*) as chunks, floor(count(*) * 1000.0::double / 3600000 * 1000000 + 0.5) / 1000000 as rate, count(*) * 1000.0::double / 3600000 > 0.0005 as anomalous from telemetry group by stream_id, "window" """)
def b12_chunk_rate_anomaly(spark, d):
    return metrics.chunk_rate_anomaly(tables.telemetry(spark, d), ["stream_id"], 3_600_000, 0.0005)


# --- health --------------------------------------------------------------------------------------------------------

_ROLLING = f"""{TELEMETRY}, rolled as (
  select *, list_sort(list(greatest(0.0, value)) over w) as vals, count(*) over w as n, count(*) filter (stage = 'error') over w as errors
  from telemetry window w as (partition by stream_id order by ts_ms range between 7200000 preceding and current row)),
rolling as (select stream_id, seq, n, errors, vals[cast(least(n - 1, floor(n * 0.95)) as integer) + 1] as p95, floor(errors * 1.0::double / n * 10000 + 0.5) / 10000 as error_rate from rolled)"""


@query(f"with {_ROLLING} select * from rolling")
def c1_rolling_quality_metrics(spark, d):
    out = health.rolling_quality_metrics(tables.telemetry(spark, d), ["stream_id"], 7_200_000)
    return out.select("stream_id", "seq", "n", "errors", "p95", "error_rate")


@query(f"""with {_ROLLING}, scored as (select *, case when p95 >= 60 then 'critical' when p95 >= 30 then 'degraded' else 'good' end as latency, case when error_rate >= 0.5 then 'critical' when error_rate >= 0.2 then 'degraded' else 'good' end as failures from rolling)
select stream_id, seq, case when 'critical' in (latency, failures) then 'critical' when 'degraded' in (latency, failures) then 'degraded' else 'good' end as state,
  case when latency = 'critical' then 'latency' when failures = 'critical' then 'failures' when latency = 'degraded' then 'latency' when failures = 'degraded' then 'failures' else 'healthy' end as main_cause,
  least(1.0::double, n / 5.0::double) as confidence from scored""")
def c3_quality_state(spark, d):
    rolled = health.rolling_quality_metrics(tables.telemetry(spark, d), ["stream_id"], 7_200_000)
    causes = {"latency": health.severity(F.col("p95"), 30, 60), "failures": health.severity(F.col("error_rate"), 0.2, 0.5)}
    return health.quality_state(rolled, causes).select("stream_id", "seq", "state", "main_cause", "confidence")


@query(f"""with {TELEMETRY}, e as (select *, count(*) over (partition by stream_id order by ts_ms range between 7200000 preceding and current row) - (count(*) over (partition by stream_id, ts_ms) - row_number() over (partition by stream_id, ts_ms order by seq)) as c from telemetry where stage <> 'view')
select stream_id, seq, c as count from e where c = 2""")
def c5_rate_alerts(spark, d):
    return health.rate_alerts(tables.telemetry(spark, d).where("stage <> 'view'"), ["stream_id"], 2, 7_200_000).select("stream_id", "seq", "count")


@query(f"""with {TELEMETRY}, m as (select *, value < 20 as ok from telemetry),
r as (select *, sum(ok::int) over (partition by stream_id order by ts_ms, seq) as run from m),
f as (select *, cast(sum(case when ok then 0 else 1 end) over (partition by stream_id, run order by ts_ms, seq) as bigint) as failures from r)
select stream_id, seq, failures, max(case when failures >= 3 then ts_ms + 30000 end) over (partition by stream_id, run order by ts_ms, seq) as open_until from f""")
def c7_circuit_replay(spark, d):
    return health.circuit_replay(tables.telemetry(spark, d), ["stream_id"], F.col("value") < 20).select("stream_id", "seq", "failures", "open_until")


@query(f"""with {TELEMETRY}, n as (select *, row_number() over (partition by stream_id, stage = 'error' order by ts_ms, seq) as no from telemetry) select stream_id, seq, stage from n where stage = 'error' or no % 20 = 0""")
def c9_systematic_sample(spark, d):
    return health.systematic_sample(tables.telemetry(spark, d), ["stream_id"], F.col("stage") == "error").select("stream_id", "seq", "stage")


# --- policy --------------------------------------------------------------------------------------------------------

_POLICY = f"""{DECISIONS}, replayed as (select *, case when age_ms >= 20000 then 'drop/drop/too_old' when not tts_enabled then 'audio_skip/audio_skip/tts_disabled' when not provider_healthy then 'audio_skip/audio_skip/provider_unhealthy'
  when queue_depth >= 8 and age_ms >= 7000 then 'merge/catchup/queue_overloaded' when queue_depth >= 4 and age_ms >= 12000 then 'audio_skip/audio_skip/age_and_queue'
  when not (asr_stable and semantic_complete) and age_ms < 3000 then 'hold/quality/young_unstable' when not (asr_stable and semantic_complete) and age_ms < 7000 then 'emit/fast/age_forces_unstable'
  when age_ms <= 3000 then 'emit/quality/fresh' when age_ms <= 7000 then 'emit/fast/getting_old' when age_ms <= 12000 then 'merge/catchup/catchup_age' else 'audio_skip/audio_skip/over_catchup' end as v from decisions)"""


@query(f"with {_POLICY} select seq, split_part(v, '/', 1) as action, split_part(v, '/', 2) as mode, split_part(v, '/', 3) as reason from replayed")
def l2_replay_emission_policy(spark, d):
    return policy.replay_emission_policy(tables.decisions(spark, d)).select("seq", "action", "mode", "reason")


@query(f"with {DECISIONS} select seq, case when age_ms > 20000 then 'drop_stale' when age_ms > 12000 then 'text_only_stale' when age_ms > 8000 and queue_depth >= 4 then 'text_only_stale' else 'normal_tts' end as budget from decisions")
def l3_replay_age_budget(spark, d):
    return policy.replay_age_budget(tables.decisions(spark, d)).select("seq", "budget")


@query(f"with {_POLICY} select runtime_action as logged, split_part(v, '/', 1) as replayed, count(*) as n from replayed group by all")
def l5_policy_disagreement(spark, d):
    return policy.policy_disagreement(policy.replay_emission_policy(tables.decisions(spark, d)), "runtime_action", "action")


# --- sessions ------------------------------------------------------------------------------------------------------


@query(f"with {TEXTS}, t as (select doc_id, {_TOKENS.format(c='text')} as w from texts) select doc_id, len(list_filter(list_zip(w[:-2], w[2:]), lambda p: p[1] = p[2])) as repeats from t")
def q1_adjacent_repeats(spark, d):
    return tables.texts(spark, d).select("doc_id", session.adjacent_repeats(F.col("text")).cast("long").alias("repeats"))


@query(f"""with {EMISSIONS}, t as (select stream_id, release_seq, {_TOKENS.format(c='text')} as w, {_TOKENS.format(c="coalesce(text, '') || ' so so'")} as v from emissions),
n as (select stream_id, release_seq, len(list_filter(list_zip(v[:-2], v[2:]), lambda p: p[1] = p[2])) as raw, len(list_filter(list_zip(w[:-2], w[2:]), lambda p: p[1] = p[2])) as source from t)
select stream_id, release_seq, raw, greatest(0, raw - least(raw, source)) as effective from n""")
def q2_effective_repeats(spark, d):
    raw = session.adjacent_repeats(F.concat("text", F.lit(" so so"))).cast("long")
    out = tables.emissions(spark, d).select("stream_id", "release_seq", raw.alias("raw"), session.adjacent_repeats(F.col("text")).cast("long").alias("source"))
    return out.select("stream_id", "release_seq", "raw", session.effective_repeats(F.col("raw"), F.col("source")).cast("long").alias("effective"))


_PAUSES = f"""{TELEMETRY}, em as (select stream_id, ts_ms, seq from telemetry where stage <> 'view'), inp as (select stream_id, ts_ms, seq from telemetry where stage = 'view'),
seen as (select e.*, (select max(i.ts_ms) from inp i where i.stream_id = e.stream_id and i.ts_ms <= e.ts_ms) as last_input from em e),
pauses as (select stream_id, seq, ts_ms, ts_ms - lag(ts_ms) over w as pause_ms, lag(last_input) over w as input_before from seen window w as (partition by stream_id order by ts_ms, seq))"""


@query(f"""with {_PAUSES} select stream_id, seq, pause_ms, case when pause_ms < 3000 then '0-3s' when pause_ms < 7000 then '3-7s' when pause_ms < 15000 then '7-15s' when pause_ms >= 15000 then '>15s' end as bucket, input_before,
  ts_ms - input_before >= pause_ms + 3000 as speaker from pauses""")
def q4_pause_analysis(spark, d):
    t = tables.telemetry(spark, d)
    return session.pause_analysis(t.where("stage <> 'view'"), t.where("stage = 'view'"), ["stream_id"])


@query(f"with {DECISIONS} select stream_id, " + ", ".join(f"count(*) filter (controller_action = '{a}') as {a}" for a in tables._ACTIONS) + " from decisions group by stream_id")
def q5_filter_tally(spark, d):
    return session.filter_tally(tables.decisions(spark, d).withColumnRenamed("controller_action", "action"), ["stream_id"], list(tables._ACTIONS))


@query(f"""with {TELEMETRY}, m as (select *, k // 50 as config, lag(k // 50) over w as before, lag(ts_ms) over w as last from telemetry window w as (partition by stream_id order by ts_ms, seq))
select stream_id, seq, cast(sum(case when before is null or before <> config or ts_ms - last > 7200000 then 1 else 0 end) over (partition by stream_id order by ts_ms, seq) as bigint) as session from m""")
def q6_session_split(spark, d):
    return session.session_split(tables.telemetry(spark, d), ["stream_id"], F.floor(F.col("k") / 50), 7_200_000).select("stream_id", "seq", "session")


@query(f"with {TELEMETRY} select seq, substr(sha256('k=' || k || ';stage=' || stage || ';stream=' || stream_id), 1, 12) as config from telemetry")
def q7_config_hash(spark, d):
    settings = F.create_map(F.lit("stream"), F.col("stream_id").cast("string"), F.lit("stage"), F.col("stage"), F.lit("k"), F.col("k").cast("string"))
    return tables.telemetry(spark, d).select("seq", session.config_hash(settings).alias("config"))


_SCORE = f"""{TELEMETRY}, log as (select stream_id, stage as lang, k % 3 as repeats, value > 40 as long_pause, value * 100 as latency_ms from telemetry),
s as (select stream_id, count(*) as segments, (max(ts_ms) - min(ts_ms)) / 60000.0::double / 100 as duration_min from telemetry group by stream_id),
pl as (select stream_id, lang, count(*) as e, count(*) filter (long_pause) as p, sum(repeats) as r from log group by stream_id, lang),
su as (select stream_id, sum(e) as emissions, sum(r) as repeats, avg(p * 1.0::double / e) as p_norm, count(*) as langs from pl group by stream_id),
md as (select stream_id, list_sort(list(latency_ms))[cast(least(count(*) - 1, floor(0.5 * count(*))) as integer) + 1] as median_ms from log group by stream_id),
x as (select s.stream_id, segments, emissions, langs, median_ms, duration_min, repeats * 1.0::double / emissions as r_norm, p_norm, case when duration_min > 0 then segments / duration_min else 0 end as per_min from s join su using (stream_id) join md using (stream_id)),
y as (select *, greatest(0.0::double, 1 - per_min / 8.0::double) as s_norm, greatest(0.1::double, least(1.0::double, segments / 500.0::double)) as conf, case when segments < 10 then 'few_segments' when median_ms > 6000 then 'latency' when per_min < 3.0 then 'starvation' end as rejection from x)"""


@query(f"""with {_SCORE} select stream_id, segments, cast(emissions as bigint) as emissions, langs, rejection, case when rejection is not null then 1e9 else round(r_norm + 2 * p_norm + 5 * s_norm, 3) end as score,
  case when rejection is not null then 1e9 else round((r_norm + 2 * p_norm + 5 * s_norm) / conf, 3) end as weighted_score, round(conf, 3) as confidence, segments < 150 or duration_min < 15 as low_confidence from y""")
def q8_objective_score(spark, d):
    t = tables.telemetry(spark, d)
    log = t.select("stream_id", F.col("stage").alias("lang"), (F.col("k") % 3).alias("repeats"), (F.col("value") > 40).alias("long_pause"), (F.col("value") * 100).alias("latency_ms"))
    sessions = t.groupBy("stream_id").agg(F.count("*").alias("segments"), ((F.max("ts_ms") - F.min("ts_ms")) / 60000.0 / 100).alias("duration_min"))
    out = session.objective_score(log, sessions, ["stream_id"])
    return out.withColumn("score", F.round("score", 3)).withColumn("weighted_score", F.round("weighted_score", 3))


@query(f"""with {TELEMETRY} select coalesce(cast(stream_id as varchar), 'all') as stream, coalesce(stage, 'all') as lang, count(*) as n, min(value) as least, max(value) as most, round(avg(value), 8) as mean from telemetry group by rollup (stream_id, stage)""")
def q10_language_report(spark, d):
    r = tables.telemetry(spark, d).rollup("stream_id", "stage").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 8).alias("mean"))
    return r.select(F.coalesce(F.col("stream_id").cast("string"), F.lit("all")).alias("stream"), F.coalesce("stage", F.lit("all")).alias("lang"), "n", "least", "most", "mean")
