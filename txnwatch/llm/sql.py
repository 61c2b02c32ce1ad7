"""DuckDB SQL for the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""
with d as (select row_number() over () as rid, doc_id, text from documents),
w as (select rid, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from d),
raw as (select rid, unnest(string_split(text, chr(10))) as l from w),
line as (select rid, l, t, len(t) as n from (select rid, l, regexp_extract_all(l, '{WORD}') as t from raw) where len(t) > 0),
judged as (
  select rid, l, n,
    100 * (length(l) - length(regexp_replace(l, '[#*$%&|<>]', '', 'g'))) > 20 * n
    or 100 * ((length(l) - length(replace(l, '!!', ''))) // 2 + (length(l) - length(replace(l, '??', ''))) // 2) > 25 * n
    or (n < 8 and not regexp_matches(l, '[.!?:;…]'))
    or 100 * len(list_filter(t, lambda x: x in ('|', '/', '-', '>', '»', '›', '·', '•'))) > 20 * n
    or (n >= 5 and 100 * (length(l) - length(regexp_replace(l, '[A-Z]', '', 'g'))) > 50 * (length(l) - length(regexp_replace(l, '[A-Za-z]', '', 'g'))))
    or (n <= 20 and regexp_matches(lower(l), 'all rights reserved|privacy policy|terms of use|terms of service|cookie|enable javascript|click here|sign up|log in|subscribe to|share this'))
    as bad
  from line),
per_line as (
  select rid, count(*) as n_lines, count(*) - count(distinct l) as n_dup, sum(bad::int) as n_bad, sum(case when bad then 0 else n end) as kept_words
  from judged group by rid),
win as (select rid, i, array_to_string(ws[i:i + 7], ' ') as k from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
twice as (select rid, i from (select rid, i, count(*) over (partition by rid, k) as c from win) where c >= 2),
rep as (select rid, count(distinct p) as n_rep from (select rid, unnest(range(i, i + 8)) as p from twice) group by rid),
base as (
  select doc_id, len(ws)::bigint as n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    coalesce(n_dup, 0)::bigint as n_dup_lines, coalesce(n_rep, 0)::bigint as n_repeat_words,
    coalesce(n_lines, 0)::bigint as n_lines, coalesce(n_bad, 0)::bigint as n_bad_lines, coalesce(kept_words, 0)::bigint as kept_words
  from w left join per_line using (rid) left join rep using (rid))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  (not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and 100 * kept_words >= 50 * n_words) as kept,
  n_lines, n_bad_lines, kept_words
from base
"""

OP2 = rf"""
with s as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as hash
  from documents),
per as (
  select source, sum(size)::bigint as source_size, [5, 2, 1][(row_number() over (order by source asc nulls last) - 1) % 3 + 1]::bigint as weight
  from s group by source),
run as (
  select *, sum(source_size) over () as total, sum(weight) over () as all_weight,
    coalesce(sum(source_size) over o, 0) as size_before, coalesce(sum(weight) over o, 0) as weight_before
  from per
  window o as (order by source_size / weight, source asc nulls last rows between unbounded preceding and 1 preceding)),
mark as (select *, weight * (total - 3 * size_before) > 3 * source_size * (all_weight - weight_before) as stopped from run),
goal as (
  select source, source_size,
    case when stopped then (3 * source_size)::double
      else (weight * (total - 3 * sum(case when stopped then source_size else 0 end) over ()))::double
        / (sum(case when stopped then 0 else weight end) over ())::double end as target
  from mark),
plan as (
  select *, case when source_size = 0 then 0 else floor(target / source_size)::bigint end as whole,
    case when source_size = 0 then 0 else floor(target - floor(target / source_size) * source_size)::bigint end as rest
  from goal),
cum as (
  select source, hash, size, sum(size) over (partition by source order by hash) as upto, sum(size) over (partition by source, hash) as words from s),
edge as (
  select c.source, min(struct_pack(hash := c.hash, upto := c.upto, words := c.words, rest := p.rest)) as x
  from cum c join plan p on c.source is not distinct from p.source where c.upto > p.rest group by c.source),
below as (
  select source, x.hash + case when x.upto - x.rest < x.rest - (x.upto - x.words) then 1 else 0 end as below from edge)
select s.doc_id, s.source, s.size, p.source_size, p.target,
  (s.size * (p.whole + case when b.below is not null and s.hash < b.below then 1 else 0 end))::bigint as taken
from s join plan p on s.source is not distinct from p.source left join below b on s.source is not distinct from b.source
"""

OP9 = r"""
with u as (
  select page_id, url, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) as path
  from pages),
rules(verdict, host, path) as (values ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
best as (
  select u.*, (select max(struct_pack(n := length(r.host || r.path), rule := r.host || r.path, verdict := r.verdict)) from rules r
    where (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.path)) as x
  from u)
select page_id, url, host, path, x.rule as rule,
  coalesce(x.verdict, case when regexp_matches('.' || host, 'casino|poker|-bets\.|porn|\.adult-|xxx|viagra|pills|\.spam-|\.ads\.|\.ads-|\.adserver\.')
    or regexp_matches(path, '/ads/|/banner/|/login|/signup|\.exe$|\.zip$') then 'block' else 'allow' end) as verdict
from best
"""

SQL: dict[str, str] = {"op1_quality_rules": OP1, "op2_mixing": OP2, "op9_url_filter": OP9}
