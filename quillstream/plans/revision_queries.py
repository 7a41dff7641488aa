"""Queries of revision families, boundary overlaps and committed prefixes.

The planner has SQL that walks the proofs in order; families and boundaries depend on earlier verdicts, and ``tests/test_revisions.py``
holds them against plain restatements and stated cases.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fold, revisions
from ..sources import tables
from .registry import query


@query()
def i14_revision_families(spark, d):
    """Emissions as releases; some have spans, which reach back over the ones before."""
    code = F.col("stream_id") * 7 + F.col("release_seq") * 3
    start = F.greatest(F.lit(0), F.col("release_seq") * 1000 - code % 3 * 700)
    span = F.struct(F.concat(F.lit("space"), code % 2).alias("space"), start.alias("start"), (start + 1200).alias("end"))
    rows = tables.emissions(spark, d).select(
        "stream_id", "release_seq", "ts_ms", "text", F.lit("e").alias("epoch"), F.when(code % 5 == 0, "partial").otherwise("complete").alias("status"),
        F.when(code % 4 == 0, F.array().cast("array<struct<space:string,start:bigint,end:bigint>>")).otherwise(F.array(span)).alias("spans"),
    )
    return fold.ordered_fold(rows, ["stream_id"], ["ts_ms", "release_seq"], revisions.family_step(), revisions.FAMILY_SCHEMA)


@query()
def g11_boundary_overlap_trim(spark, d):
    rows = tables.emissions(spark, d).withColumn("lang", F.lit("de"))
    return fold.ordered_fold(rows, ["stream_id", "lang"], ["release_seq"], revisions.boundary_step(), revisions.BOUNDARY_SCHEMA)


_UNITS = """o as (select l_orderkey as id, l_suppkey as s, l_partkey as p, row_number() over (partition by l_orderkey order by l_linenumber, l_suppkey, l_partkey, l_extendedprice) as n from lineitem),
w as (
  select id, n - 1 as word, cast(id % 97 as varchar) as space, id * 4000 + n * 100 as start, id * 4000 + n * 100 + 100 as "end",
    id * 3 + (n * s) % 3 as release, (id * 31 + s * 17 + n // 3) % 1000 as committed_at, p % 8 as k from o),
r as (select space, case when k = 1 then start + 40 else start - 5 end as start, case when k = 2 then "end" + 150 else "end" + 5 end as "end", release, committed_at from w where k > 0)"""


@query(f"""with recursive {_UNITS},
b as (select id, 1 + max(word) // 2 as boundary from w group by id union select id, max(word) from w group by id),
m as (select w.id, w.word, r.release, r.committed_at, r.start <= w.start and r."end" >= w."end" as whole from w join r on w.space = r.space and r.start < w."end" and w.start < r."end"),
u as (select w.id, w.word, coalesce(max(case when whole then 1 else 0 end), 0) as covered, count(m.word) as met from w left join m on w.id = m.id and w.word = m.word group by w.id, w.word),
t as (select id, count(*) as n, sum(covered) as covered, count(*) filter (covered = 0 and met > 0) as touched, min(word) filter (covered = 1) as first, coalesce(min(word) filter (covered = 0), count(*)) as prefix from u group by id),
c as (select distinct id, word, committed_at, release from m where whole),
p as (select *, row_number() over (partition by id order by committed_at, release) as no from (select distinct id, committed_at, release from c)),
walk as (
  select id, 0::bigint as no, 0::bigint as at_, [] :: bigint[] as by_ from t union all
  select k.id, p.no, k.to_, case when k.to_ > k.at_ then list_append(k.by_, p.release) else k.by_ end
  from (select walk.*, (select min(x.i) from (select unnest(range(walk.at_, t.n + 1)) as i) x where x.i = t.n or not exists (
      select 1 from c where c.id = walk.id and c.word = x.i and (c.committed_at, c.release) = (select (p2.committed_at, p2.release) from p p2 where p2.id = walk.id and p2.no = walk.no + 1))) as to_
    from walk join t on t.id = walk.id) k join p on p.id = k.id and p.no = k.no + 1),
f as (select id, arg_max(at_, no) as at_, arg_max(by_, no) as by_ from walk group by id),
top as (
  select t.*, f.at_, f.by_, case when covered = 0 then case when touched > 0 then 'boundary_overlap_only' else 'none' end when covered = n then case when at_ = n then 'full' else 'fragmented' end
    when prefix > 0 and covered = prefix and at_ = prefix then 'proved_prefix' when prefix = 0 then case when covered = n - first then 'suffix' else 'committed_infix' end else 'fragmented' end as topology
  from t join f using (id)),
cut as (
  select top.*, case when topology = 'full' then n when topology = 'proved_prefix' then coalesce((select max(boundary) from b where b.id = top.id and boundary > 0 and boundary < n and boundary <= at_ and at_ - boundary <= 2 and boundary >= 3), 0) else 0 end as cut from top)
select id, n as n_words, topology, at_ as frontier, cast(covered as bigint) as committed_words, array_to_string(by_, ',') as releases,
  case when topology = 'full' then 'suppress' when cut > 0 then 'resegment' else 'unchanged' end as action,
  case when topology = 'full' then 'source_fully_committed' when topology <> 'proved_prefix' then topology when cut > 0 then 'proved_prefix_safe_boundary' when at_ < 3 then 'below_benefit' else 'no_safe_boundary' end as reason,
  cut as safe_word, case when topology <> 'full' and cut > 0 then at_ - cut else 0 end as bridge from cut""")
def i15_committed_prefix_plan(spark, d):
    """Orders as units of words; ranges committed by up to three releases each, some too short, some over two words."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")).cast("long")
    o = tables.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"), place.alias("n"))
    start = F.col("id") * 4000 + F.col("n") * 100
    w = o.select(
        "id", (F.col("n") - 1).alias("word"), (F.col("id") % 97).cast("string").alias("space"), start.alias("start"), (start + 100).alias("end"),
        (F.col("id") * 3 + F.col("n") * F.col("s") % 3).alias("release"), ((F.col("id") * 31 + F.col("s") * 17 + F.floor(F.col("n") / 3)) % 1000).alias("committed_at"), (F.col("p") % 8).alias("k"),
    )
    r = w.where("k > 0").select(
        "space", F.when(F.col("k") == 1, F.col("start") + 40).otherwise(F.col("start") - 5).alias("start"), F.when(F.col("k") == 2, F.col("end") + 150).otherwise(F.col("end") + 5).alias("end"), "release", "committed_at",
    )
    last = w.groupBy("id").agg(F.max("word").alias("m"))
    b = last.select("id", F.explode(F.array((1 + F.floor(F.col("m") / 2)).cast("long"), F.col("m"))).alias("boundary"))
    return revisions.committed_prefix_plan(w, r, b, ["id"])


@query()
def j1_playout_ledger(spark, d):
    """Events as broadcasts and outcomes of chunks: some come early, twice, with another payload or epoch."""
    t = tables.telemetry(spark, d)
    outcome = F.get(F.array(*[F.lit(o) for o in ("play_started", "play_completed", "chunk_received", "explicit_drop", "play_started", "other")]), (F.col("k") % 6).cast("int"))
    rows = t.select(
        "stream_id", "seq", "ts_ms", F.when(F.col("stage").isin("click", "view"), "broadcast").otherwise("outcome").alias("kind"), F.concat(F.lit("c"), F.col("k") % 7).alias("chunk_key"),
        F.concat(F.lit("p"), (F.col("k") % 29 == 0).cast("int")).alias("payload"), F.when(F.col("k") % 31 == 0, "f").otherwise("e").alias("epoch"), outcome.alias("outcome"),
        F.concat(F.lit("o"), F.floor(F.col("seq") / 2)).alias("outcome_id"), F.col("ts_ms").alias("occurred_ms"), F.lit(None).cast("string").alias("reason"),
    )
    return fold.ordered_fold(rows, ["stream_id"], ["ts_ms", "seq"], revisions.playout_step(7 * 86_400_000), revisions.PLAYOUT_SCHEMA)
