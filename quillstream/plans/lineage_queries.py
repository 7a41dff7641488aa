"""Queries of stage latencies, provider outcomes, phrases, alignment, audio and playout, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import lineage, metrics, spans, text
from ..sources import event_log, tables
from ..sources.tables import EMISSIONS, SPANS, TELEMETRY, TEXTS
from .registry import query

_TOKENS = "regexp_extract_all(translate(lower({c}), '" + tx.MARKED + "', '" + tx.PLAIN + "'), '[\\p{{L}}\\p{{N}}]+')"

_STAGES = """stages as (select l_orderkey as tx_id, 'shipped' as stage, epoch_us(l_shipdate) // 1000 as ts_ms, cast(l_linenumber as bigint) as seq from lineitem
  union all select o_orderkey, 'received', epoch_us(o_orderdate) // 1000, 0 from orders union all select l_orderkey, 'done', epoch_us(l_shipdate) // 1000 + cast(l_quantity as bigint) * 60000, cast(l_linenumber as bigint) from lineitem where l_returnflag <> 'R')"""


def _stage_events(spark, d):
    li = tables.read(spark, d, "lineitem")
    ship = tables.epoch_ms("l_shipdate")
    one = lambda stage, ts: li.select(F.col("l_orderkey").alias("tx_id"), F.lit(stage).alias("stage"), ts.alias("ts_ms"), F.col("l_linenumber").cast("long").alias("seq"), "l_returnflag")
    received = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("tx_id"), F.lit("received").alias("stage"), tables.epoch_ms("o_orderdate").alias("ts_ms"), F.lit(0).cast("long").alias("seq"))
    done = li.withColumn("q", F.col("l_quantity").cast("long") * 60000).where("l_returnflag <> 'R'").select(F.col("l_orderkey").alias("tx_id"), F.lit("done").alias("stage"), (ship + F.col("q")).alias("ts_ms"), F.col("l_linenumber").cast("long").alias("seq"))
    return one("shipped", ship).drop("l_returnflag").unionByName(received).unionByName(done)


_LEGS = {"capture": ("received", "shipped"), "handling": ("shipped", "done"), "whole": ("received", "done")}


@query(f"""with {_STAGES}, a as (select tx_id, arg_max(ts_ms, (seq, ts_ms)) filter (stage = 'shipped') as s, arg_max(ts_ms, (seq, ts_ms)) filter (stage = 'received') as r, arg_max(ts_ms, (seq, ts_ms)) filter (stage = 'done') as d from stages group by tx_id)
select tx_id, case when s is not null or r is not null then greatest(s - r, 0) end as capture, d - s as handling, d - r as whole from a""")
def b1_stage_latencies(spark, d):
    return metrics.stage_latencies(_stage_events(spark, d), _LEGS)


@query(f"""with {_STAGES}, a as (select tx_id, arg_max(ts_ms, (seq, ts_ms)) filter (stage = 'shipped') as s, arg_max(ts_ms, (seq, ts_ms)) filter (stage = 'received') as r, count(*) filter (stage = 'done') as d from stages group by tx_id)
select tx_id, case when s is not null or r is not null then greatest(s - r, 0) end as capture, cast(null as bigint) as handling, cast(null as bigint) as whole from a where d = 0""")
def b2_single_stage_latencies(spark, d):
    return metrics.stage_latencies(_stage_events(spark, d), _LEGS, without="done")


@query("""with acks as (select l_orderkey as tx_id, min(epoch_us(l_shipdate) // 1000) as ack_ms from lineitem where l_returnflag = 'N' group by l_orderkey)
select o_orderkey as tx_id, ack_ms, greatest(0, ack_ms - epoch_us(o_orderdate) // 1000) + ack_ms * 0 as delivery_ms from orders left join acks on tx_id = o_orderkey""")
def b3_first_ack_join(spark, d):
    tx_ = tables.read(spark, d, "orders").select(F.col("o_orderkey").alias("tx_id"), tables.epoch_ms("o_orderdate").alias("sent_ms"))
    acks = tables.read(spark, d, "lineitem").where("l_returnflag = 'N'").select(F.col("l_orderkey").alias("tx_id"), tables.epoch_ms("l_shipdate").alias("received_ms"), F.col("l_linenumber").alias("arrival_seq"))
    return metrics.first_ack_join(tx_, acks).select("tx_id", "ack_ms", "delivery_ms")


#: Kinds of provider failures, in the order in which they are tried.
_KINDS = (
    ("circuit_open", "status is null and message like '%circuit%'"), ("content_filter", "code = 'content_filter'"), ("rate_limit", "status = 429"), ("timeout", "message like '%timed out%'"),
    ("auth_or_deployment", "status in (401, 403, 404)"), ("request_invalid", "status in (400, 409, 422)"), ("provider_5xx", "status >= 500"), ("network", "status is null and message like '%connection%'"),
)
_PROVIDER = "select seq, stage, case when k % 4 = 0 then null else 399 + k * 2 end as status, case when k % 10 = 3 then 'content_filter' else 'none' end as code, case k % 3 when 0 then 'request timed out' when 1 then 'connection reset' else 'circuit is open' end as message from telemetry"


@query(f"with {TELEMETRY}, p as ({_PROVIDER}) select seq, case " + " ".join(f"when {c} then '{k}'" for k, c in _KINDS) + " else 'unknown' end as kind from p")
def b13_provider_outcomes(spark, d):
    rows = tables.telemetry(spark, d).selectExpr("seq", "case when k % 4 = 0 then null else 399 + k * 2 end as status", "case when k % 10 = 3 then 'content_filter' else 'none' end as code", "case k % 3 when 0 then 'request timed out' when 1 then 'connection reset' else 'circuit is open' end as message")
    return rows.select("seq", F.coalesce(*[F.when(F.expr(c), F.lit(k)) for k, c in _KINDS], F.lit("unknown")).alias("kind"))


@query(f"with {TELEMETRY}, p as ({_PROVIDER}) select stage, count(*) filter (code = 'content_filter') as blocks, count(*) filter (status >= 500) as failures, count(*) filter (status in (400, 409, 422)) as invalid from p group by stage")
def b14_provider_counters(spark, d):
    rows = tables.telemetry(spark, d).selectExpr("stage", "case when k % 4 = 0 then null else 399 + k * 2 end as status", "k % 10 = 3 as blocked")
    return rows.groupBy("stage").agg(F.count_if("blocked").alias("blocks"), F.count_if(F.col("status") >= 500).alias("failures"), F.count_if(F.col("status").isin(400, 409, 422)).alias("invalid"))


@query(f"with {TELEMETRY}, n as (select max(ts_ms) as t from telemetry) select stream_id, stage, max(ts_ms) as newest, case when (select t from n) - max(ts_ms) <= 86400000 then 'live' else 'stale' end as status from telemetry group by stream_id, stage")
def c2_stream_freshness(spark, d):
    t = tables.telemetry(spark, d)
    now = t.agg(F.max("ts_ms").alias("t"))  # one row
    g = t.groupBy("stream_id", "stage").agg(F.max("ts_ms").alias("newest"))
    return g.join(F.broadcast(now), F.lit(True)).select("stream_id", "stage", "newest", F.when(F.col("t") - F.col("newest") <= 86_400_000, "live").otherwise("stale").alias("status"))


@query(f"""with {TEXTS}, t as (select doc_id, ' ' || array_to_string({_TOKENS.format(c='text')}, ' ') || ' ' as t from texts), terms as (select distinct item_id as term_id, array_to_string({_TOKENS.format(c='text')}, ' ') as norm from benchmark),
p as (select doc_id, norm, term_id, row_number() over (partition by doc_id order by length(norm) desc, norm, term_id) as place from t join terms on norm <> '' and contains(t, ' ' || norm || ' '))
select doc_id, norm, term_id, cast(place as integer) as place from p where place <= 25""")
def e10_match_terms(spark, d):
    """Whole benchmark items as terms in every document."""
    terms = tables.read(spark, d, "benchmark").select(F.col("item_id").alias("term_id"), F.array_join(tx.tokens(F.col("text")), " ").alias("norm")).where("norm <> ''").distinct()
    return text.match_terms(tables.texts(spark, d), terms, ["doc_id"]).select("doc_id", "norm", "term_id", "place")


@query(f"with {SPANS} select space, id, word, case when start % 7 = 0 then 'missing' when start % 11 = 0 then 'negative' when lag(start) over (partition by space, id order by word, start, \"end\") > start then 'not_monotone' end as reason from spans")
def i1_to_sample_spans(spark, d):
    s = tables.spans(spark, d).withColumn("start_s", F.when(F.col("start") % 7 == 0, None).when(F.col("start") % 11 == 0, -1.0).otherwise(F.col("start") / 1.0)).withColumn("end_s", F.col("end") / 1.0)
    from pyspark.sql import Window

    w = Window.partitionBy("space", "id").orderBy("word", "start", "end")
    ordered = s.withColumn("pos", F.row_number().over(w)).withColumn("kept", F.col("start"))
    out = spans.to_sample_spans(ordered.drop("start", "end"), ["space", "id"], 1)
    late = F.lag("kept").over(Window.partitionBy("space", "id").orderBy("pos")) > F.col("kept")
    return out.select("space", "id", "word", F.when(F.col("reason").isin("missing", "negative"), F.col("reason")).when(late, "not_monotone").alias("reason"))


_TOKENROWS = f"""tt as (select stream_id, release_seq, {_TOKENS.format(c='text')} as t from emissions), a as (select stream_id, release_seq, unnest(range(len(t))) as pos, unnest(t) as token from tt),
b as (select stream_id, release_seq, pos, case when (stream_id + release_seq) % 3 = 0 and pos = 2 then 'zzz' else token end as token from a where not (release_seq % 4 = 1 and pos = 0))"""


def _token_rows(spark, d):
    a = tables.emissions(spark, d).select("stream_id", "release_seq", F.posexplode(tx.tokens(F.col("text"))).alias("pos", "token"))
    b = a.where(~((F.col("release_seq") % 4 == 1) & (F.col("pos") == 0))).withColumn("token", F.when(((F.col("stream_id") + F.col("release_seq")) % 3 == 0) & (F.col("pos") == 2), "zzz").otherwise(F.col("token")))
    return a, b


@query(f"""with {EMISSIONS}, {_TOKENROWS}, g as (select coalesce(a.stream_id, b.stream_id) as stream_id, coalesce(a.release_seq, b.release_seq) as release_seq, count(a.token) as n_text, count(b.token) as n_words, count(*) filter (a.token = b.token) as equal from a full join b on a.stream_id = b.stream_id and a.release_seq = b.release_seq and a.pos = b.pos group by 1, 2)
select *, case when n_text > 0 and n_words > 0 and n_text = n_words and equal = n_text then 'exact' else 'unaligned' end as status, case when n_text = 0 then 'no_text' when n_words = 0 then 'no_words' when n_text <> n_words then 'count' when equal <> n_text then 'tokens' end as reason from g""")
def i2_align_exact(spark, d):
    a, b = _token_rows(spark, d)
    return lineage.align_exact(a, b, ["stream_id", "release_seq"])


@query(f"""with {EMISSIONS}, {_TOKENROWS}, s as (select stream_id, release_seq, pos - 3 as pos, token from a where pos between 3 and 6), n as (select stream_id, release_seq, count(*) as n from s group by all),
r as (select s.stream_id, s.release_seq, b.pos - s.pos as off, count(*) as c from s join b using (stream_id, release_seq, token) group by all), m as (select * from r join n using (stream_id, release_seq) where c = n)
select stream_id, release_seq, count(*) as runs, case when count(*) = 1 then min(off) end as "offset" from m group by stream_id, release_seq""")
def i3_align_unique_run(spark, d):
    a, b = _token_rows(spark, d)
    part = a.where("pos between 3 and 6").withColumn("pos", F.col("pos") - 3)
    return lineage.align_unique_run(part, b, ["stream_id", "release_seq"]).withColumn("offset", F.col("offset").cast("long"))


@query(f"""with {SPANS} select space, count(*) filter (start is null) as missing, count(*) filter ("end" < start) as reversed, count(*) filter ("end" = start) as empty, count(*) filter ("end" > start) as positive,
  substr(sha256(string_agg(word || ':' || start || ':' || "end", ';' order by word, start, "end")), 1, 16) as digest from spans group by space""")
def i6_timestamp_audit(spark, d):
    return lineage.timestamp_audit(tables.spans(spark, d), ["space"])


@query(f"""with {SPANS}, p as (select space, id, count(*) as n_words, min(start) as start from spans group by space, id)
select space, id, n_words, start, cast(sum(n_words) over w - n_words as bigint) as "offset", coalesce(start >= lag(start) over w, true) as monotone from p window w as (partition by space order by id)""")
def i10_compose_lineage(spark, d):
    parts = tables.spans(spark, d).groupBy("space", "id").agg(F.count("*").alias("n_words"), F.min("start").alias("start"))
    return lineage.compose_lineage(parts, ["space"], "id")


_PLAYOUT = f"{TELEMETRY}, o as (select stream_id, k, ts_ms as at_, seq, case stage when 'click' then 'started' when 'view' then 'completed' else 'dropped' end as outcome from telemetry)"


@query(f"""with {_PLAYOUT}, m as (select *, max(outcome = 'started') over w as s, max(outcome = 'dropped') over w as x from o window w as (partition by stream_id, k order by at_, seq rows between unbounded preceding and 1 preceding))
select stream_id, k, count(*) filter (outcome = 'started') as started, count(*) filter (outcome = 'completed') as completed, count(*) filter (outcome = 'dropped') as dropped,
  count(*) filter (outcome = 'completed' and not coalesce(s, false)) as no_start, count(*) filter (outcome = 'started' and coalesce(x, false)) as after_drop from m group by stream_id, k""")
def j1_reconcile_playout(spark, d):
    t = tables.telemetry(spark, d)
    outcomes = t.select("stream_id", "k", F.col("ts_ms").alias("at"), "seq", F.when(F.col("stage") == "click", "started").when(F.col("stage") == "view", "completed").otherwise("dropped").alias("outcome"))
    return lineage.reconcile_playout(t.select("stream_id", "k").distinct(), outcomes, ["stream_id", "k"])


@query("""with c as (select distinct l_partkey as family, l_orderkey as generation from lineitem), n as (select *, lead(generation) over (partition by family order by generation) as newer from c) select * from n where newer > generation""")
def j6_supersession_pairs(spark, d):
    c = tables.read(spark, d, "lineitem").select(F.col("l_partkey").alias("family"), F.col("l_orderkey").alias("generation")).distinct()
    return lineage.supersession_pairs(c, ["family"], "generation")


@query(f"with {TELEMETRY} select stream_id, cast(floor(ts_ms / 86400000) as bigint) as day, round(sum(k * 160) / 16000.0::double / 60, 6) as minutes from telemetry group by stream_id, day")
def j10_audio_minutes(spark, d):
    return tables.telemetry(spark, d).groupBy("stream_id", F.floor(F.col("ts_ms") / 86_400_000).alias("day")).agg(F.round(F.sum(F.col("k") * 160) / 16000.0 / 60, 6).alias("minutes"))


_LEVELS = """f as (select label, vec_id as frame, round(sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double)) / len(embedding)), 9) as rms, list_max(list_transform(embedding, lambda x: abs(x::double))) as peak from embeddings where len(embedding) > 0),
r as (select *, row_number() over (partition by label order by rms, frame) as r, count(*) over (partition by label) as n from f),
levels as (select label, count(*) as frames, round(avg(rms), 6) as rms, round(max(peak), 6) as peak, round(avg(rms) filter (r <= greatest(1, floor(n * 0.2))), 6) as floor_ from r group by label)"""


def _levels(spark, d):
    frames = tables.read(spark, d, "embeddings").select("label", F.col("vec_id").alias("frame"), F.col("embedding").cast("array<double>").alias("samples"))
    return lineage.frame_levels(frames, ["label"])


@query(f"with {_LEVELS} select label, frames, rms, peak, floor_ as floor from levels")
def k1_frame_levels(spark, d):
    return _levels(spark, d)


@query(f"""with {_LEVELS}, s as (select *, case when floor_ > 0 then 20 * log10(rms / floor_) else 60.0 end as snr from levels), t as (select label, greatest(0, 100 - case when rms < 0.02 then 30 when rms > 0.8 then 40 when rms < 0.1 then 15 else 0 end - case when snr < 1 then 30 when snr < 2 then 10 else 0 end - case when peak >= 0.99 then 20 when peak >= 0.95 then 10 else 0 end) as score from s)
select label, score, case when score >= 90 then 'excellent' when score >= 75 then 'good' when score >= 50 then 'acceptable' when score >= 25 then 'poor' else 'unusable' end as level from t""")
def k2_audio_score(spark, d):
    return lineage.audio_score(_levels(spark, d)).select("label", "score", "level")


@query(f"""with {TELEMETRY}, m as (select *, value > 10 as on_, coalesce(lag(value > 10) over (partition by stream_id order by ts_ms, seq), false) as before from telemetry),
r as (select *, cast(sum(case when on_ and not before then 1 else 0 end) over (partition by stream_id order by ts_ms, seq rows between unbounded preceding and current row) as bigint) as segment from m)
select stream_id, segment, min(ts_ms) as first, max(ts_ms) as last, count(*) as rows from r where on_ group by stream_id, segment""")
def k3_speech_segments(spark, d):
    return lineage.speech_segments(tables.telemetry(spark, d), ["stream_id"], ["ts_ms", "seq"], F.col("value") > 10)


@query(f"with {TELEMETRY}, r as (select stream_id, unnest(['late', 'error', 'other']) as reason, unnest([k % 3, k % 5, k % 7]) as n from telemetry) select stream_id, reason, reason <> 'other' as allowed, sum(n) as n from r group by all")
def a7_explode_drop_reasons(spark, d):
    t = tables.telemetry(spark, d).withColumn("reasons", F.create_map(F.lit("late"), F.col("k") % 3, F.lit("error"), F.col("k") % 5, F.lit("other"), F.col("k") % 7))
    allowed = spark.createDataFrame([("late",), ("error",)], "reason string")
    return event_log.explode_drop_reasons(t, ["stream_id"], "reasons", allowed).groupBy("stream_id", "reason", "allowed").agg(F.sum("n").alias("n"))


@query(f"""with {TELEMETRY}, o as (select 'o' || seq as outcome_id, 'c' || k as chunk_key, case stage when 'click' then 'play_started' when 'view' then 'play_completed' when 'error' then 'junk' else 'explicit_drop' end as outcome, k * 150 - 100 as sentence_index, seq * 1000 as duration_ms from telemetry)
select outcome_id, chunk_key, outcome, case when sentence_index between 0 and 10000 then sentence_index else 0 end as sentence_index, case when outcome = 'play_completed' and duration_ms between 0 and 3600000 then duration_ms end as duration_ms from o where outcome <> 'junk'""")
def a6_sanitize_outcomes(spark, d):
    outcome = F.when(F.col("stage") == "click", "play_started").when(F.col("stage") == "view", "play_completed").when(F.col("stage") == "error", "junk").otherwise("explicit_drop")
    rows = tables.telemetry(spark, d).select(F.concat(F.lit("o"), "seq").alias("outcome_id"), F.concat(F.lit("c"), "k").alias("chunk_key"), outcome.alias("outcome"), (F.col("k") * 150 - 100).alias("sentence_index"), (F.col("seq") * 1000).alias("duration_ms"))
    return event_log.sanitize_outcomes(rows, ("play_started", "play_completed", "explicit_drop"))


@query(f"""with {TELEMETRY} select sha256(v) as line, k is null as bad from (select case when k % 10 = 0 then '{{"seq": ' else '{{"seq": ' || seq || '}}' end as v, case when k % 10 = 0 then null else 1 end as k from telemetry)""")
def a3_quarantine(spark, d):
    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([StructField("seq", LongType())])
    lines = tables.telemetry(spark, d).select(F.when(F.col("k") % 10 == 0, '{"seq": ').otherwise(F.concat(F.lit('{"seq": '), F.col("seq").cast("string"), F.lit("}"))).alias("value"))
    good, bad = event_log.split_quarantine(lines, schema)
    kept = good.select(F.sha2(F.concat(F.lit('{"seq": '), F.col("seq").cast("string"), F.lit("}")), 256).alias("line"), F.lit(False).alias("bad"))
    return kept.unionByName(bad.select(F.col("digest").alias("line"), F.lit(True).alias("bad")))
