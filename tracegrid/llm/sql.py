"""Independent DuckDB forms of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# The sketches hold whole groups at the sizes this form is run at, so their quartiles are exact.
QUALITY_RULES = rf"""
with d as (
  select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text, {WORDS} as w
  from documents),
win as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select r, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from d)),
rep as (
  select r, i from win qualify count(*) over (partition by r, g) > 1),
cov as (
  select r, count(distinct i + k) as n_repeat_words from rep, (values (0), (1), (2)) o(k) group by r),
ln as (
  select r, count(*) as n_lines, count(*) - count(distinct line) as n_dup_lines
  from (select r, unnest(string_split(text, chr(10))) as line from d)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
c as (
  select d.r, doc_id, lang, source, len(w)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')))::bigint as n_upper,
    coalesce(n_lines, 0) as n_lines, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join cov using (r) left join ln using (r)),
s as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    case when word_chars > 0 then n_symbols / word_chars else 0.0 end::double as s1,
    case when word_chars > 0 then n_upper / word_chars else 0.0 end::double as s2,
    case when n_lines > 0 then n_dup_lines / n_lines else 0.0 end::double as s3,
    case when n_words > 0 then n_repeat_words / n_words else 0.0 end::double as s4,
    case when n_words > 0 then word_chars / n_words else 0.0 end::double as s5
  from c),
q as (
  select grouping(lang) as gl, grouping(source) as gs, lang, source, count(*) as n,
    quantile_disc(s1, [0.25, 0.75]) as q1, quantile_disc(s2, [0.25, 0.75]) as q2, quantile_disc(s3, [0.25, 0.75]) as q3,
    quantile_disc(s4, [0.25, 0.75]) as q4, quantile_disc(s5, [0.25, 0.75]) as q5
  from s where not base_failed group by grouping sets ((lang, source), (lang), ())),
lim as (
  select a.lang, a.source,
    [(a.n * a.q1[1] + 10 * ((b.n * b.q1[1] + 10 * e.q1[1]) / (b.n + 10))) / (a.n + 10), (a.n * a.q1[2] + 10 * ((b.n * b.q1[2] + 10 * e.q1[2]) / (b.n + 10))) / (a.n + 10)] as q1,
    [(a.n * a.q2[1] + 10 * ((b.n * b.q2[1] + 10 * e.q2[1]) / (b.n + 10))) / (a.n + 10), (a.n * a.q2[2] + 10 * ((b.n * b.q2[2] + 10 * e.q2[2]) / (b.n + 10))) / (a.n + 10)] as q2,
    [(a.n * a.q3[1] + 10 * ((b.n * b.q3[1] + 10 * e.q3[1]) / (b.n + 10))) / (a.n + 10), (a.n * a.q3[2] + 10 * ((b.n * b.q3[2] + 10 * e.q3[2]) / (b.n + 10))) / (a.n + 10)] as q3,
    [(a.n * a.q4[1] + 10 * ((b.n * b.q4[1] + 10 * e.q4[1]) / (b.n + 10))) / (a.n + 10), (a.n * a.q4[2] + 10 * ((b.n * b.q4[2] + 10 * e.q4[2]) / (b.n + 10))) / (a.n + 10)] as q4,
    [(a.n * a.q5[1] + 10 * ((b.n * b.q5[1] + 10 * e.q5[1]) / (b.n + 10))) / (a.n + 10), (a.n * a.q5[2] + 10 * ((b.n * b.q5[2] + 10 * e.q5[2]) / (b.n + 10))) / (a.n + 10)] as q5
  from q a join q b on a.lang is not distinct from b.lang and b.gl = 0 and b.gs = 1 join q e on e.gl = 1
  where a.gl = 0 and a.gs = 0)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and coalesce(
    s1 <= q1[2] + greatest(0.05, 6 * (q1[2] - q1[1])) and s2 <= q2[2] + greatest(0.25, 6 * (q2[2] - q2[1]))
    and s3 <= q3[2] + greatest(0.4, 6 * (q3[2] - q3[1])) and s4 <= q4[2] + greatest(0.35, 6 * (q4[2] - q4[1]))
    and s5 <= q5[2] + greatest(2.0, 6 * (q5[2] - q5[1])) and s5 >= q5[1] - greatest(2.0, 6 * (q5[2] - q5[1])),
    true) as kept
from s left join lim on s.lang is not distinct from lim.lang and s.source is not distinct from lim.source
"""

MIX_SOURCES = rf"""
with d as (
  select doc_id, source, len({WORDS})::bigint as size from documents),
s as (
  select source, sum(size)::bigint as size, row_number() over (order by source nulls last) as rank from d group by source),
w as (
  select *, 3 * size as cap, ((rank - 1) % 3 + 1)::double as weight, sum(size) over () as total, count(*) over () as n from s),
l as (
  select *, (total - coalesce(sum(cap) over (order by cap / weight, rank rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, rank rows between current row and unbounded following) as level from w),
t as (
  select *, least(cap, coalesce((select min_by(level, cap / weight) from l where cap / weight > level), 0) * weight)::double
    as target from l),
a as (
  select rank, least(cap, floor(target + 0.5))::bigint as quota from t),
o as (
  select d.*, s.rank, coalesce(sum(d.size) over (partition by d.source
    order by md5(concat_ws('|', 'mix-1', doc_id::varchar, d.size::varchar)), doc_id, d.size
    rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from d join s on d.source is not distinct from s.source)
select doc_id, o.size, t.size as source_size, target,
  (greatest(0, least(quota - start, o.size)) + greatest(0, least(quota - start - t.size, o.size))
  + greatest(0, least(quota - start - 2 * t.size, o.size)))::bigint as taken
from o join t using (rank) join a using (rank)
"""

JACCARD_JOIN = rf"""
with recursive d as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x20\x09-\x0D]+') as w
  from documents),
g as (
  select distinct r, doc_id, case when len(w) < 5 then array_to_string(w, ' ')
    else array_to_string(w[i : i + 4], ' ') end as t
  from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)),
n as (select r, doc_id, count(*) as n from g group by r, doc_id),
s as (select r, n.doc_id, n, list_sort(list(hash(t))) as k from g join n using (r) group by r, n.doc_id, n),
c as (select k, n, min(doc_id) as rep from s group by k, n),
m as (select s.r, s.doc_id, c.rep from s join c on s.k = c.k and s.n = c.n),
f as (select x.rep, g.t, n.n from (select distinct rep from m) x join n on n.doc_id = x.rep join g on g.r = n.r),
p as (
  select a.rep as a, b.rep as b from f a join f b on a.t = b.t and a.rep <> b.rep
  group by a.rep, b.rep, a.n, b.n having 100 * count(*) >= 75 * (a.n + b.n - count(*))),
reach(a, b) as (
  select rep, rep from (select distinct rep from m) union select reach.a, p.b from reach join p on reach.b = p.a),
o as (select a, min(b) as component_id from reach group by a)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, coalesce(o.component_id, d.doc_id) as component_id
from d left join n using (r) left join m using (r) left join o on o.a = m.rep
"""

TOP_K = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 20
"""

_RULED = """
  case when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/en/1') then 'example.org/en/1'
    when (host = 'example.org' or host like '%.example.org') and starts_with(path, '/es/') then 'example.org/es/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/fr/') then 'com/fr/'
    when (host = 'com' or host like '%.com') and starts_with(path, '/de/') then 'com/de/'
    when (host = 'org' or host like '%.org') and starts_with(path, '/') then 'org/' end
"""

_ROUNDS = ",".join(
    f"""
r{i} as materialized (
  select kind, host, sum(m) as m from (
    select e.kind, e.dst as host, 0.85 * e.share * r.m as m from e join r{i - 1} r on r.kind = e.kind and r.host = e.src
    union all select * from r0) group by kind, host)"""
    for i in range(1, 16)
)

URL_FILTER = rf"""
with u as (
  select page_id, html, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path from pages),
p as (select *, {_RULED} as rule from u),
v as (select *, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as ruled from p),
h as (select host, count(*) filter (ruled = 'allow') as good, count(*) filter (ruled = 'block') as bad from v group by host),
a as (
  select host as src, unnest(regexp_extract_all(html, '(?i)<a\s(?:[^>]*?\s)?href\s*=\s*["'']?([^"''\s>]+)', 1)) as link from v),
w as (
  select src, translate(regexp_extract(case when starts_with(link, '//') then 'http:' || link else link end, '://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as dst
  from a where starts_with(link, '//') or regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.\-]*://')),
up as (
  select b.host as src, c.host as dst from h b join h c on b.host like '%.' || c.host and c.host <> ''
  qualify row_number() over (partition by b.host order by length(c.host) desc) = 1),
l as (
  select src, dst, count(*) as n from (
    select src, dst from w where src <> dst and src <> '' and dst <> '' and dst in (select host from h)
    union all select src, dst from up union all select dst, src from up) group by src, dst),
k as (select 'trust' as kind, src, dst, n from l union all select 'distrust', dst, src, n from l),
e as materialized (select kind, src, dst, n / sum(n) over (partition by kind, src) as share from k),
r0 as materialized (
  select 'trust' as kind, host, 0.15::double * good as m from h where good > 0
  union all select 'distrust', host, 0.15::double * bad from h where bad > 0),{_ROUNDS},
j as (select host, sum(m) filter (kind = 'distrust') / sum(m) as share from r15 group by host)
select page_id, v.host, path, rule,
  coalesce(ruled, case when coalesce(share, 0) >= 0.8 then 'block' else 'allow' end) as verdict
from v left join j using (host)
"""

FILL_IN_MIDDLE = """
with u as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as l,
    sha256('7:' || coalesce(doc_id::varchar, '')) as x
  from documents),
h as (
  select *, len(l) as n, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2,
    ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from u),
f as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 100 then 'plain'
      when h4 % 100 < 50 then 'spm' else 'psm' end as form from h),
c as (
  select *, array_to_string(l[1:a], '') as p, array_to_string(l[a + 1:b], '') as m, array_to_string(l[b + 1:], '') as s
  from f)
select doc_id, n::bigint as n, form,
  case when form <> 'plain' then length(p)::bigint end as prefix_chars,
  case when form <> 'plain' then length(m)::bigint end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from c
"""

EMBEDDING_DEDUP = """
with recursive v as (
  select row_number() over () as r, vec_id, embedding::double[] as e from embeddings),
u as (
  select r, vec_id, case when len(e) > 0 and len([x for x in e if x is null or not isfinite(x)]) = 0
    and len([x for x in e if x <> 0]) > 0 then [x / list_max([abs(y) for y in e]) for x in e] end as e
  from v),
p as (
  select a.r as a, b.r as b from u a join u b on a.r <> b.r and len(a.e) = len(b.e)
  where list_cosine_similarity(a.e, b.e) >= 0.9),
w as (
  select r as a, r as b from u union select w.a, p.b from w join p on w.b = p.a),
n as (select a, count(*) as n from p group by a)
select u.vec_id, coalesce(any_value(n.n), 0)::bigint as n_links, min(o.vec_id) as component_id,
  u.vec_id is not distinct from min(o.vec_id) as kept
from u join w on w.a = u.r join u o on o.r = w.b left join n on n.a = u.r
group by u.r, u.vec_id
"""
