"""Queries of profiles, flow replay, trimming, rhetorical repeats, audits and phrases, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import dictionary, lineage, metrics, policy, stabilize, text
from ..sources import tables
from ..sources.tables import DECISIONS, EMISSIONS, SPANS, TELEMETRY, TEXTS
from .registry import query

_CASE = " ".join(
    f"when state = '{s}' then case {' '.join(f'''when main_cause = '{c}' then '{p}' ''' for c, p in causes.items() if c != '*')} else '{causes['*']}' end" for s, causes in policy.PROFILES.items()
)
_CAUSES = "['tts_backlog', 'whisper_delay', 'source_stall', 'queue_pressure', 'listener_drift', 'duplicate_risk', 'healthy']"


@query(f"""with {TELEMETRY}, s as (select seq, ['critical', 'degraded', 'good', 'unknown'][seq % 4 + 1] as state, {_CAUSES}[k % 7 + 1] as main_cause, k / 100.0::double as confidence from telemetry)
select seq, state, main_cause, case when confidence < 0.6 then 'normal' {_CASE} else 'normal' end as profile from s""")
def c4_recommend_profile(spark, d):
    pick = lambda values, i: F.get(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    causes = ("tts_backlog", "whisper_delay", "source_stall", "queue_pressure", "listener_drift", "duplicate_risk", "healthy")
    s = tables.telemetry(spark, d).select("seq", pick(("critical", "degraded", "good", "unknown"), F.col("seq") % 4).alias("state"), pick(causes, F.col("k") % 7).alias("main_cause"), (F.col("k") / 100.0).alias("confidence"))
    return policy.recommend_profile(s).select("seq", "state", "main_cause", "profile")


@query(f"""with {TELEMETRY}, t as (select stream_id, seq, ts_ms, stage, k from telemetry), e as (select seq, ts_ms - lag(ts_ms) over (partition by stream_id order by ts_ms, seq) as age_ms, k % 4 as listeners from t)
select seq, age_ms, listeners, listeners > 0 as broadcasted from e where age_ms is not null""")
def b15_broadcast_facts(spark, d):
    w = Window.partitionBy("stream_id").orderBy("ts_ms", "seq")
    e = tables.telemetry(spark, d).select("seq", (F.col("ts_ms") - F.lag("ts_ms").over(w)).alias("age_ms"), (F.col("k") % 4).alias("listeners"))
    return e.where("age_ms is not null").withColumn("broadcasted", F.col("listeners") > 0)


_T = "regexp_replace(regexp_replace(text, '\\s+', ' ', 'g'), '^ | $', '', 'g')"
_HELD = "[" + ", ".join(f"'{w}'" for w in policy.HELD_WORDS) + "]"


@query(f"""with {EMISSIONS}, a as (select stream_id, release_seq, ['normal', 'fast', 'catchup', 'critical'][release_seq % 4 + 1] as profile, (stream_id * 37 + release_seq * 1300) % 14000 as age_ms, stream_id % 12 as stable_words, text from emissions),
b as (select *, {_T} as t, list_filter(string_split({_T}, ' '), lambda w: w <> '') as w from a),
c as (select *, len(w) as n, regexp_matches(t, '[.!?]$') as st, regexp_matches(t, '[,;:]$') as sf, profile <> 'normal' as quick, case profile when 'fast' then 5000 when 'catchup' then 3500 when 'critical' then 2500 end as rel, array_to_string(w[1:least(stable_words, len(w))], ' ') as stable,
  len(w) > 0 and len(w) <= 3 and len(list_filter(list_filter(list_transform(w, lambda x: regexp_replace(lower(x), '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda x: x <> ''), lambda x: not list_contains({_HELD}, x))) = 0 as risky from b),
e as (select *, case when n = 0 then 0.0 when st then 0.85 when sf and n >= 6 then 0.65 when n >= 10 then 0.55 else 0.25 end as cpl from c)
select stream_id, release_seq, case when n = 0 then 'hold' when risky then case when age_ms >= 12000 then 'merge' else 'hold' end when quick and age_ms >= case when profile = 'critical' then 4500 else 7000 end and n >= 4 and cpl >= 0.45 then 'fallback'
  when quick and age_ms >= rel and stable_words >= 5 and length(stable) >= 28 and length(stable) * 100 >= length(t) * 55 and cpl >= 0.45 then 'soft_commit' when n >= 4 and length(t) >= 24 and (st or (quick and sf and age_ms >= rel and cpl >= 0.75)) then 'micro_emit' when age_ms >= 12000 then 'merge' else 'hold' end as decision from e""")
def l1_replay_flow_policy(spark, d):
    profile = F.get(F.array(*[F.lit(p) for p in ("normal", "fast", "catchup", "critical")]), (F.col("release_seq") % 4).cast("int"))
    rows = tables.emissions(spark, d).select("stream_id", "release_seq", profile.alias("profile"), ((F.col("stream_id") * 37 + F.col("release_seq") * 1300) % 14000).alias("age_ms"), (F.col("stream_id") % 12).cast("int").alias("stable_words"), "text")
    return policy.replay_flow_policy(rows).select("stream_id", "release_seq", "decision")


@query(f"""with {SPANS}, h as (select *, max("end") over (partition by space, id) / 2.0::double as half from spans), g as (select space, id, max("end") filter (word % 5 = 0) as sentence, arg_min("end", (abs("end" - half), "end")) as w from h group by space, id)
select space, id, coalesce(sentence + 200, w) as cut, case when sentence is not null then 'sentence' else 'word' end as kind from g""")
def h8_trim_points(spark, d):
    return stabilize.trim_points(tables.spans(spark, d).withColumn("sentence_end", F.col("word") % 5 == 0), ["space", "id"])


@query(f"""with {SPANS}, c as (select space, max("end") - 2000 as cut from spans group by space), k as (select s.*, row_number() over (partition by s.space order by start desc, "end" desc, word desc) as place from spans s join c using (space) where "end" > cut)
select space, string_agg(cast(word as varchar), ' ' order by start, "end", cast(word as varchar)) as context, count(*) as n from k where place <= 15 group by space""")
def h10_overlap_words(spark, d):
    s = tables.spans(spark, d)
    cuts = s.groupBy("space").agg((F.max("end") - 2000).alias("cut"))
    return stabilize.overlap_words(s, cuts, ["space"])


_CUE = stabilize.REPEAT_CUES.replace("'", "''")


@query(f"""with {EMISSIONS}, n as (select stream_id, release_seq, case when release_seq % 2 = 0 then 'Ich wiederhole das: ' || text else text end as text, case when release_seq % 3 = 0 then 'emit' else 'skip' end as proposed from emissions),
m as (select *, trim(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) as norm from n), p as (select *, coalesce(lag(norm) over (partition by stream_id order by release_seq), '') as before from m)
select stream_id, release_seq, proposed, case when proposed = 'skip' and not (length(norm) > 0 and norm = before) and regexp_matches(text, '{_CUE}') then 'emit' else proposed end as action from p""")
def g14_protect_rhetorical(spark, d):
    said = F.when(F.col("release_seq") % 2 == 0, F.concat(F.lit("Ich wiederhole das: "), "text")).otherwise(F.col("text"))
    rows = tables.emissions(spark, d).select("stream_id", "release_seq", said.alias("text"), F.when(F.col("release_seq") % 3 == 0, "emit").otherwise("skip").alias("proposed"))
    return stabilize.protect_rhetorical(rows, ["stream_id"], "release_seq").select("stream_id", "release_seq", "proposed", "action")


@query(f"""with {SPANS}, a as (select space, count(*) as words, count(*) filter ("end" - start > 400) as long_, sum("end" - start) as covered from spans group by space), r as (select space, id, word, start, case when word = 7 then "end" - 20 else "end" end as "end" from spans), b as (select space, count(*) as words, count(*) filter ("end" - start > 400) as long_, sum("end" - start) as covered from r group by space)
select space, concat_ws(',', case when a.words <> b.words then 'words' end, case when a.long_ <> b.long_ then 'long' end, case when a.covered <> b.covered then 'covered' end) as changed from a join b using (space)""")
def i7_audit_diff(spark, d):
    s = tables.spans(spark, d)
    length = F.col("end") - F.col("start")
    counts = lambda df, p: df.groupBy("space").agg(F.count("*").alias(f"{p}_words"), F.count_if(length > 400).alias(f"{p}_long"), F.sum(length).alias(f"{p}_covered"))
    both = counts(s, "a").join(counts(s.withColumn("end", F.when(F.col("word") == 7, F.col("end") - 20).otherwise(F.col("end"))), "b"), "space")
    changed = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"a_{c}") != F.col(f"b_{c}"), F.lit(c)) for c in ("words", "long", "covered")])), ",")
    return both.select("space", changed.alias("changed"))


_TOKENS = "regexp_extract_all(translate(lower({c}), '" + tx.MARKED + "', '" + tx.PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"


@query(f"""with {TEXTS}, t as (select doc_id, array_to_string({_TOKENS.format(c='text')}, ' ') as norm from texts), p as (select item_id, array_to_string({_TOKENS.format(c='text')}, ' ') as norm from benchmark)
select doc_id, item_id, case when t.norm = p.norm then 'exact' else 'contains' end as tier from t join p on contains(' ' || t.norm || ' ', ' ' || p.norm || ' ') where length(p.norm) > 15""")
def e12_match_phrases(spark, d):
    """Phrases of over 15 characters in texts, by one automaton."""
    tokens = tx.tokens(F.col("text"))
    p = tables.read(spark, d, "benchmark").select("item_id", tokens.alias("p_")).withColumn("norm", F.array_join("p_", " ")).where("length(norm) > 15")
    met = text.phrases_within(tables.texts(spark, d).select("doc_id", tokens.alias("t_")), p, ["doc_id"])
    return met.select("doc_id", "item_id", F.when(F.col("text_") == F.col("norm"), "exact").otherwise("contains").alias("tier")).distinct()


@query(f"with {DECISIONS} select stream_id, count(*) as emissions, count(*) filter (controller_action <> 'emit') as filtered, round(avg(age_ms), 6) as mean_age, max(queue_depth) as deepest from decisions group by stream_id")
def q9_session_summary(spark, d):
    return tables.decisions(spark, d).groupBy("stream_id").agg(
        F.count("*").alias("emissions"), F.count_if(F.col("controller_action") != "emit").alias("filtered"), F.round(F.avg("age_ms"), 6).alias("mean_age"), F.max("queue_depth").alias("deepest")
    )


@query()
def e9_normalize_dialect(spark, d):
    """Texts with a mapping made from the benchmark: its items' first three words as phrases, their longer words as words."""
    w = tables.read(spark, d, "benchmark").select("item_id", tx.words(F.col("text")).alias("w"))
    phrase = w.where("size(w) >= 3").select(F.lit("phrase").alias("tier"), F.array_join(F.slice("w", 1, 3), " ").alias("dialect"), F.concat(F.lit("<item "), F.col("item_id").cast("string"), F.lit(">")).alias("standard"))
    word = w.select(F.explode("w").alias("x")).select(F.regexp_replace("x", r"[^\p{L}]", "").alias("dialect")).where("length(dialect) > 4").distinct()
    mapping = phrase.unionByName(word.select(F.lit("word").alias("tier"), "dialect", F.reverse("dialect").alias("standard")))
    out = dictionary.normalize_dialect(tables.texts(spark, d), mapping, ["doc_id"])
    return out.select("doc_id", F.sha2("normalized", 256).alias("normalized"), "n_phrases", "n_words")
