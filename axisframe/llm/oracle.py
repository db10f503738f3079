"""DuckDB SQL for the operators whose whole result SQL can express."""

SPACE = r"\x20\x09-\x0D"

PAGES = """
with p as (select page_id, encode(coalesce(html, '')) b, coalesce(html, '') h from pages),
q as (select page_id, cast(octet_length(b) as bigint) n, sha256(h) d, min(page_id) over (partition by h) least, row_number() over (partition by h order by page_id nulls last) r from p)
select page_id, n as payload_bytes, d as payload_digest,
  case when n >= 100 and r > 1 then 'revisit' else 'response' end as record_type,
  case when n >= 100 and r > 1 then least end as refers_to
from q
"""

CHATS = r"""
with t as (
  select conv_id, turn, coalesce(role, '') r, coalesce(text, '') x from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]' union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(x) + length(regexp_replace(x, '[^\\<\[]', '', 'g')) ex, length(r) + length(regexp_replace(r, '[^\\<\[]', '', 'g')) er from t),
f as (select *, ex + case r when 'system' then 14 when 'user' then 16 when 'assistant' then 12 else er + 19 end fx from e)
select cast(conv_id as bigint) conv_id, cast(count(*) as bigint) n_turns,
  sha256(string_agg(r || chr(10) || x || chr(10), '' order by turn, r, x)) turns_sha256,
  cast(coalesce(sum(case when r = 'assistant' then length(x) end), 0) as bigint) loss_chars,
  sha256(coalesce(string_agg(case when r = 'assistant' then x end, '' order by turn, r, x), '')) loss_sha256,
  cast(sum(fx) as bigint) formatted_chars
from f group by 1
"""

NEAR = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^{SPACE}]+') ws from documents),
s as materialized (
  select distinct doc_id, unnest(case when len(ws) = 0 then [] when len(ws) = 1 then [ws[1]] else list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) end) g from w),
n as materialized (select doc_id, count(*) n from s group by 1),
l as materialized (
  select x.a, x.b from (select p.doc_id a, q.doc_id b, count(*) c from s p join s q on p.g = q.g and p.doc_id <> q.doc_id group by 1, 2) x
  join n na on na.doc_id = x.a join n nb on nb.doc_id = x.b where 100 * c >= 80 * (na.n + nb.n - c)),
r(a, b) as (select doc_id, doc_id from w union select r.a, l.b from r join l on r.b = l.a),
k as (select a, min(b) component_id from r group by 1)
select w.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, k.component_id, w.doc_id = k.component_id kept
from w left join n using (doc_id) join k on k.a = w.doc_id
"""

QUALITY = rf"""
with w as (
  select row_number() over () rid, doc_id, source, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') ws,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) ls from documents),
x as (select rid, i, ws[i:i+2] g from (select rid, ws, unnest(range(1, len(ws) - 1)) i from w)),
c as (select rid, i from (select rid, i, count(*) over (partition by rid, g) n from x) where n > 1),
d as (select rid, count(distinct p) n from (select rid, unnest([i, i + 1, i + 2]) p from c) group by 1),
m as (
  select w.rid, doc_id, source, cast(len(ws) as bigint) n_words, cast(length(t) - length(regexp_replace(t, '[^{SPACE}]+', '', 'g')) as bigint) word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols, cast(len(ls) - len(list_distinct(ls)) as bigint) n_dup_lines,
    len(ls) n_lines, cast(coalesce(d.n, 0) as bigint) n_repeat_words from w left join d using (rid)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed,
    20 * n_symbols > word_chars or 10 * n_dup_lines > 3 * n_lines or 100 * n_repeat_words > 25 * n_words or word_chars < 2 * n_words or word_chars > 20 * n_words soft_failed from m),
h as (select source, count(*) n, count(*) filter (base_failed or soft_failed) failed from f group by 1),
p as (select sum(failed) / sum(n) mean, avg((failed / n) * (failed / n)) - avg(failed / n) * avg(failed / n) - (sum(failed) / sum(n)) * (1 - sum(failed) / sum(n)) * avg(1.0::double / n) between_ from h),
q as (select mean, case when between_ > 0 then least(1000.0::double, greatest(1.0::double, mean * (1 - mean) / between_ - 1)) else 1000.0::double end strength from p),
v as (select source, (failed + mean * strength) / (n + strength) > 0.5 bad from h, q)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not (base_failed or (bad and soft_failed)) kept
from f join v on f.source is not distinct from v.source
"""
