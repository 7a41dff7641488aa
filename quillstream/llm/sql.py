"""DuckDB statements that give the same rows as the queries, where SQL can express them."""

_WORD = r"[^\x20\x09-\x0D]+"
_HASH60 = "('0x' || substr(md5('{seed}|' || coalesce(cast(doc_id as varchar), '')), 1, 15))::bigint"
_KEY = "case when {c} is null then '1' else '0' || {c} end"

_CRC_TABLE = []
for _i in range(256):
    for _ in range(8):
        _i = (_i >> 1) ^ (0xEDB88320 if _i & 1 else 0)
    _CRC_TABLE.append(_i)

OP8 = f"""
with crc as (select {_CRC_TABLE}::bigint[] as t),
rows_ as (
  select doc_id, source, {_KEY.format(c="source")} as s, {_HASH60.format(seed="shard")} as h,
    coalesce(text, '') as text from documents),
bytes_ as (
  select *, strlen(text) + 1 as size,
    [('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::bigint for i in range(1, strlen(text) + 1)] as b from rows_),
summed as (
  select doc_id, source, s, h, size,
    xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) as text_crc32
  from bytes_, crc),
ranked as (
  select *, (2 * row_number() over (partition by s order by h, doc_id nulls first, text_crc32, size) - 1)
    / (2.0::double * count(*) over (partition by s)) as f from summed),
placed as (
  select *, row_number() over (order by f, h, doc_id nulls first, s, text_crc32, size) - 1 as p, count(*) over () as n from ranked)
select doc_id, size, text_crc32, 'rows' as law, cast((p * 8) // n as integer) as shard,
  p - ((((p * 8) // n) * n + 7) // 8) as slot, cast(null as integer) as grown_shard, source from placed
"""

OP2 = f"""
with rows_ as (
  select doc_id, source, {_KEY.format(c="source")} as s,
    cast(len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) as bigint) as size,
    ({_HASH60.format(seed="mix")} + 0.5::double) / 1152921504606846976::double as u from documents),
sizes as (select s, cast(sum(size) as bigint) as source_size from rows_ group by s),
weighed as (select *, [5.0::double, 2.0::double, 1.0::double][1 + (row_number() over (order by s) - 1) % 3] as w from sizes),
caps as (select *, 2.0::double * source_size / w as c, sum(source_size) over () * 1.5::double as total from weighed),
levels as (
  select *, (total - coalesce(sum(2.0::double * source_size) over (order by c, s rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by c, s rows between current row and unbounded following) as level from caps),
level_ as (select level from levels where level <= c order by c, s limit 1),
targets as (
  select s, source_size, coalesce(least((select level from level_) * w, 2.0::double * source_size), 2.0::double * source_size) as target from levels),
facts as (
  select s, any_value(t.source_size) as source_size, any_value(t.target) as target, any_value(case when t.source_size > 0 then t.target / t.source_size else 0 end) as e,
    max(w) as top, sum(size * w) as ws
  from (select *, size / (size + 100.0::double) as w from rows_) r join targets t using (s) group by s),
opened as (
  select r.*, f.source_size, f.target, floor(e) as sure, f.target - floor(e) * f.source_size as open_,
    e - floor(e) + case when top > 0 then least(e - floor(e), 1 - (e - floor(e))) / top else 0 end
      * (size / (size + 100.0::double) - case when f.source_size > 0 then ws / f.source_size else 0 end) as p
  from rows_ r join facts f using (s)),
ranked as (
  select *, sum(size) over (partition by s order by
      case when p >= 1 then 0 when p > 0 then (u / (1 - u)) / (p / (1 - p)) else 'infinity'::double end, u, doc_id nulls first, size
      rows between unbounded preceding and current row) - size / 2 as middle from opened),
taken as (select *, cast(sure + case when middle <= open_ and sure < 2 then 1 else 0 end as integer) as copies from ranked)
select doc_id, size, source_size, cast(target as double) as target, cast(copies * size as bigint) as taken, source, copies from taken
"""

_ESCAPED = r"regexp_replace({c}, '(\\*)(</?s>|\[/?(?:INST|SYS|ROLE|TEXT)\])', '\1\1\\\2', 'g')"

OP5 = f"""
with every as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized as (
  select *, length({_ESCAPED.format(c="text")}) + case role when 'user' then 16 when 'assistant' then 10 when 'system' then 14
    else 23 + length({_ESCAPED.format(c="role")}) end as chars from every)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  cast(sum(chars) as bigint) as formatted_chars
from sized group by conv_id
"""

_METRICS = {"symbols": (50, False), "dup_lines": (300, False), "repeats": (300, False), "upper": (300, False), "word_length": (300, True)}
_RATIO = "case when {down} > 0 then ({up} * {by}) // {down} else 0 end"


def _quartile_sql(keys: str) -> str:
    return f"""select {keys}, max(total) as n, min(case when upto * 4 >= total then bin end) as q1, min(case when upto * 4 >= total * 3 then bin end) as q3
      from (select {keys}, bin, sum(n) over (partition by {keys} order by bin) as upto, sum(n) over (partition by {keys}) as total
            from (select {keys}, bin, sum(n) as n from sketch group by {keys}, bin)) group by {keys}"""


_RULES = []
for _m, (_margin, _low) in _METRICS.items():
    _RULES.append((_m, f"{_m} > max(case when metric = '{_m}' then q3 + greatest((q3 - q1) * 3, {_margin}) end)"))
    if _low:
        _RULES.append((f"{_m}_low", f"{_m} < max(case when metric = '{_m}' then q1 - greatest((q3 - q1) * 3, {_margin}) end)"))

OP9 = f"""
with d as (
  select doc_id, row_number() over () as rid, {_KEY.format(c="lang")} as l, {_KEY.format(c="source")} as s, coalesce(text, '') as text from documents),
w as (
  select rid, i, lower_.w as a, lead(lower_.w, 1) over (partition by rid order by i) as b, lead(lower_.w, 2) over (partition by rid order by i) as c
  from (select rid, unnest(regexp_extract_all(text, '{_WORD}')) as w, generate_subscripts(regexp_extract_all(text, '{_WORD}'), 1) as i from d) lower_),
windows_ as (select rid, i, c is not null and count(*) over (partition by rid, a, b, c) > 1 as hit from w),
covered as (
  select rid, count(*) as n_words, count(*) filter (hit or h1 or h2) as n_repeat_words
  from (select *, coalesce(lag(hit, 1) over (partition by rid order by i), false) as h1, coalesce(lag(hit, 2) over (partition by rid order by i), false) as h2 from windows_)
  group by rid),
lines as (
  select rid, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select rid, unnest(string_split(text, chr(10))) as line from d) where regexp_matches(line, '{_WORD}') group by rid),
counted as (
  select doc_id, rid, l, s, coalesce(n_words, 0) as n_words, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0) as n_dup_lines,
    length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    length(text) - length(regexp_replace(text, '\\p{{Lu}}', '', 'g')) as n_upper
  from d left join covered using (rid) left join lines using (rid)),
m as (
  select *, {_RATIO.format(up="n_symbols", by=1000, down="word_chars")} as symbols, {_RATIO.format(up="n_dup_lines", by=1000, down="n_lines")} as dup_lines,
    {_RATIO.format(up="n_repeat_words", by=1000, down="n_words")} as repeats, {_RATIO.format(up="n_upper", by=1000, down="word_chars")} as upper,
    {_RATIO.format(up="word_chars", by=100, down="n_words")} as word_length,
    n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed from counted),
sketch as (
  select l, s, metric, case when value < 2048 then value else (value >> (length(bin(value)) - 11)) << (length(bin(value)) - 11) end as bin, count(*) as n
  from (unpivot (select l, s, symbols, dup_lines, repeats, upper, word_length from m) on symbols, dup_lines, repeats, upper, word_length into name metric value value) group by all),
fine as ({_quartile_sql("l, s, metric")}), by_lang as ({_quartile_sql("l, metric")}), overall as ({_quartile_sql("metric")}),
used as (
  select f.l, f.s, f.metric, case when f.n >= 50 then f.q1 when b.n >= 50 then b.q1 else o.q1 end as q1,
    case when f.n >= 50 then f.q3 when b.n >= 50 then b.q3 else o.q3 end as q3
  from fine f join by_lang b on f.l = b.l and f.metric = b.metric join overall o on f.metric = o.metric),
judged as (
  select any_value(m.doc_id) as doc_id, m.rid, any_value(n_words) as n_words, any_value(word_chars) as word_chars, any_value(n_symbols) as n_symbols,
    any_value(n_dup_lines) as n_dup_lines, any_value(n_repeat_words) as n_repeat_words, any_value(base_failed) as base_failed,
    concat_ws(',', {", ".join(f"case when any_value(m.{m.removesuffix('_low')}) {rule.split(' ', 1)[1]} then '{m}' end" for m, rule in _RULES)}) as failed_rules
  from m join used u on m.l = u.l and m.s = u.s group by m.rid)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed_rules = '' as kept, failed_rules from judged
"""

OP4 = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * x::double) as bigint)) as e, len(embedding) as dim from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (
  select q.vec_id as query_id, c.vec_id,
    cast(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) as bigint) as score
  from v q join v c on q.dim = c.dim and q.vec_id <> c.vec_id where q.vec_id % 100 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from pairs) where rank <= 10
"""

_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP12 = f"""
with l as (
  select doc_id, rid, unnest(lines) as line, generate_subscripts(lines, 1) as i
  from (select doc_id, row_number() over () as rid, string_split(coalesce(text, ''), chr(10)) as lines from documents)),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_LETTERS}) as key from l),
common as (
  select key, max(doc_id) as keeper from k where length(key) >= 40 group by key
  having count(distinct doc_id) + max(case when doc_id is null then 1 else 0 end) >= 5),
judged as (select k.*, c.key is not null and k.doc_id is distinct from c.keeper as gone from k left join common c on k.key = c.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (not gone), '')) as kept_sha256
from judged group by rid
"""

OP13 = f"""
with crc as (select {_CRC_TABLE}::bigint[] as t),
d as (select doc_id, row_number() over () as rid, false as target, text from documents union all select null, null, true, text from benchmark),
w as (select doc_id, rid, target, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as ws from d),
f as (
  select rid, target, unnest(ws) as feature from w
  union all select rid, target, unnest(list_transform(list_zip(ws[:-2], ws[2:]), lambda p: p[1] || ' ' || p[2])) from w where len(ws) > 1),
kinds as (
  select feature, [('0x' || substr(hex(encode(feature)), 2 * i - 1, 2))::bigint for i in range(1, strlen(feature) + 1)] as b
  from (select distinct feature from f)),
hashed as (
  select feature, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]), 4294967295::bigint), 4294967295::bigint) % 10000 as bucket
  from kinds, crc),
counts as (
  select bucket, count(*) filter (not target) as s, count(*) filter (target) as t from f join hashed using (feature) group by bucket),
gains as (
  select bucket, cast(floor(1000 * ln((t + 1)::double * ((sum(s) over ())::double + 10000) / ((s + 1)::double * ((sum(t) over ())::double + 10000)))) as bigint) as gain
  from counts),
weights as (
  select rid, count(*) as n_features, cast(sum(gain) as bigint) as total
  from f join hashed using (feature) join gains using (bucket) where not target group by rid),
scored as (
  select doc_id, rid, len(ws) as n_words, coalesce(n_features, 0) as n_features,
    coalesce((total - ((total % n_features) + n_features) % n_features) // n_features, 0) as weight,
    ('0x' || substr(sha256('7:' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint as h
  from w left join weights using (rid) where not target),
noisy as (select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double))) as bigint) as score from scored),
ranked as (
  select *, row_number() over (order by score desc, doc_id nulls last, n_features) as r, count(*) over () as n
  from noisy where n_words >= 20)
select doc_id, n_features, weight, score, case when r * 100 <= n * 25 then r end as rank from ranked
union all select doc_id, n_features, weight, score, null from noisy where n_words < 20
"""
