"""The registered queries again, as SQL for DuckDB, from their definitions."""

from __future__ import annotations

# 28 bits of a text's MD5.
HASH = "('0x' || substr(md5({0}), 1, 7))::bigint"

DECONTAMINATION = r"""
with worded as (
  select 'doc' as kind, doc_id as id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') as w
  from documents where doc_id is not null
  union all
  select 'item', item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')
  from benchmark where item_id is not null),
shingled as (
  select distinct kind, id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as s
  from worded where len(w) >= 5),
sizes as (select id, count(*) as n from shingled where kind = 'item' group by id)
select d.id as doc_id, i.id as item_id, count(*) as n_shared, any_value(z.n) as n_shingles
from shingled d join shingled i on d.s = i.s and d.kind = 'doc' and i.kind = 'item' join sizes z on z.id = i.id
group by d.id, i.id having 100 * count(*) >= 80 * any_value(z.n)
"""

URL_FILTERS = rf"""
with captures as (
  select page_id, date '2024-01-01' + ({HASH.format("page_id::varchar")} % 366)::int as fetched,
    lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)) as host,
    rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/') as path,
    regexp_extract(url, '(\?[^#]*)', 1) as query
  from pages),
named as (
  select distinct 'domain' as kind, host as key, {HASH.format("host")} as h from captures
  union all
  select distinct 'path', host || '/' || split_part(path, '/', 2), {HASH.format("'path' || host || '/' || split_part(path, '/', 2)")}
  from captures where path <> ''
  union all
  select distinct 'address', host || path || query, {HASH.format("host || path || query")} from captures),
entries as (
  select kind, key, ['adult', 'malware', 'spam'][h % 3 + 1] as list, h % 200 as day, true as listed
  from named where kind = 'domain' and h % 4 < 3
  union all
  select kind, key, ['adult', 'malware', 'spam'][h % 3 + 1], h % 200 + 60, false from named where kind = 'domain' and h % 4 < 3 and h % 2 = 0
  union all
  select kind, key, ['adult', 'malware', 'spam'][h % 3 + 1], h % 200 + 120, true from named where kind = 'domain' and h % 8 = 0
  union all
  select 'path', key, 'paths', h % 366, true from named where kind = 'path' and h % 5 = 0
  union all
  select 'address', key, 'addresses', h % 366, true from named where kind = 'address' and h % 50 = 0
  union all
  select distinct 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1), 'parked', 100, true from captures
  union all
  select distinct 'domain', regexp_extract(host, '([^.]+\.[^.]+)$', 1), 'parked', 110, false from captures),
matched as (
  select c.page_id, e.list, e.kind, e.key, arg_max(e.listed, e.day) as listed
  from captures c join entries e on date '2024-01-01' + e.day::int <= c.fetched and (
    e.kind = 'domain' and (c.host = e.key or ends_with(c.host, '.' || e.key))
    or e.kind = 'path' and starts_with(c.host || c.path || '/', e.key || '/')
    or e.kind = 'address' and c.host || c.path || c.query = e.key)
  group by all)
select c.page_id, c.fetched, count(distinct m.list) as n_lists,
  coalesce(string_agg(distinct m.list, ',' order by m.list), '') as lists
from captures c left join matched m on m.page_id = c.page_id and m.listed group by all
"""

LINE_DEDUP = """
with lined as (select doc_id, string_split(coalesce(text, ''), chr(10)) as l, text is null as none from documents),
lines as (select doc_id, unnest(l) as line, generate_subscripts(l, 1) as i from lined),
neighbours as (
  select doc_id, i as a, lead(i) over (partition by doc_id order by i) as b from lines where trim(line) <> ''),
pairs as (
  select doc_id, a, b, array_to_string(l[a:b], chr(10)) as body from neighbours join lined using (doc_id) where b is not null),
again as (select doc_id, a, b from pairs qualify row_number() over (partition by body order by doc_id, a) > 1),
gone as (select distinct doc_id, unnest(range(a, b + 1)) as i from again),
kept as (
  select doc_id, count(*) as n, string_agg(line, chr(10) order by i) as t
  from lines anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, if(none, 0, len(l))::bigint as n_lines, (len(l) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(t, '')) as kept_sha256
from lined d left join kept using (doc_id)
"""

SUBSTRING_DEDUP = r"""
with worded as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (
  select doc_id, unnest(k) as k, generate_subscripts(k, 1) as i
  from (select doc_id, list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i : i + 19], ' ')) as k
    from worded where len(w) >= 20)),
again as (select doc_id, i from windows qualify row_number() over (partition by k order by doc_id, i) > 1),
gone as (select distinct doc_id, i from (select doc_id, unnest(range(i, i + 20)) as i from again)),
words as (select doc_id, unnest(w) as x, generate_subscripts(w, 1) as i from worded),
kept as (
  select doc_id, count(*) as n, string_agg(x, ' ' order by i) as t
  from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, len(d.w)::bigint as n_words, (len(d.w) - coalesce(k.n, 0))::bigint as n_removed,
  sha256(coalesce(k.t, '')) as kept_sha256
from worded d left join kept k using (doc_id)
"""

NEAR_DUPLICATES = r"""
with recursive worded as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
sets as (
  select doc_id, list_distinct(case when len(w) = 1 then w
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from worded),
links as (
  select a.doc_id as a, b.doc_id as b from sets a join sets b on a.doc_id < b.doc_id
    and 100 * least(len(a.s), len(b.s)) >= 80 * greatest(len(a.s), len(b.s)) and len(a.s) > 0
  where 180 * len(list_intersect(a.s, b.s)) >= 80 * (len(a.s) + len(b.s))),
both_ways as (select a, b from links union all select b, a from links),
reached as (
  select doc_id as a, doc_id as b from sets
  union
  select r.a, l.b from reached r join both_ways l on l.a = r.b)
select a as doc_id, any_value(len(s.s))::bigint as n_shingles, min(b) as component_id, min(b) = a as kept
from reached join sets s on s.doc_id = a group by a
"""

_NEAREST = """
d{n} as (
  select v.vec_id, v.copy, v.p, c.c,
    list_sum(list_transform(list_zip(v.p, c.p), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::bigint as distance
  from v, c{n} c),
a{n} as (select * from d{n} qualify row_number() over (partition by vec_id, copy order by distance, c) = 1),"""

_MOVED = """
m{n} as (
  select c, i, floor(sum(x) / count(*))::bigint as x from (
    select c, unnest(p)::hugeint as x, generate_subscripts(p, 1) as i from a{n}) group by c, i),
c{next} as (
  select o.c, coalesce(w.p, o.p) as p from c{n} o
  left join (select c, list(x order by i) as p from m{n} group by c) w on w.c = o.c),"""

CENTROIDS = (
    """
with v as materialized (
  select vec_id, row_number() over (partition by vec_id order by embedding) as copy,
    list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as p
  from embeddings
  where vec_id is not null and len(embedding) = 64
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = 64),
c0 as (
  select row_number() over (order by sha256('1:' || vec_id::varchar), copy) - 1 as c, p
  from v qualify row_number() over (order by sha256('1:' || vec_id::varchar), copy) <= 16),"""
    + "".join(_NEAREST.format(n=n) + _MOVED.format(n=n, next=n + 1) for n in range(3))
    + _NEAREST.format(n=3)
    + """
named as (select c, sha256(array_to_string(p, ',')) as centroid_sha256 from c3)
select a.vec_id, a.c::int as cluster, a.distance,
  (sum(a.distance) over (partition by a.c))::bigint as cluster_inertia,
  (sum(a.distance) over ())::bigint as inertia, n.centroid_sha256
from a3 a join named n on n.c = a.c
"""
)

# The CRC-32 of a text of ASCII characters, a bit at a time.
CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda x: ascii(x)::bigint)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
      lambda c, z: xor(c >> 1, (c & 1) * 3988292384::bigint + z))), 4294967295::bigint)"""

CONVERSATION_TRIE = f"""
with whole as (
  select conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}}
    order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as turns
  from conversations where conv_id is not null group by conv_id),
cut as (select *, {CRC32.format("conv_id::varchar")} % 9 as h from whole),
rebuilt as (
  select c.conv_id, list_concat(coalesce(b.turns, [])[1 : c.h], c.turns[c.h + 1 :]) as turns
  from cut c left join whole b on b.conv_id = c.conv_id - c.conv_id % 5),
prefixes as (
  select conv_id, d as depth, turns[1 : d] as path, turns[1 : d - 1] as parent, d = len(turns) as ends
  from (select *, unnest(range(len(turns) + 1)) as d from rebuilt)),
nodes as (
  select depth, path, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs,
    coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '') as ends
  from prefixes group by depth, path),
child as (select parent as path, count(*) as n from nodes where depth > 0 group by parent),
weighed as (
  select n.*, coalesce(c.n, 0) as n_children,
    case when depth = 0 then 0 else (n_convs - 1) * strlen(n.path[-1].text) end as saved
  from nodes n left join child c on c.path = n.path),
below as (
  select a.path, sum(b.saved) as saved, count(*) filter (b.n_children = 0) as leaves
  from weighed a join weighed b on b.depth >= a.depth and b.path[1 : a.depth] = a.path group by a.path)
select n.conv_id, n.depth::bigint as depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, b.leaves as n_leaves,
  b.saved::bigint as saved_tokens, sha256(n.ends) as ends_sha256
from weighed n join below b on b.path = n.path
left join weighed p on n.depth > 0 and p.path = n.parent
"""

SQL = {
    "op2_decontamination": DECONTAMINATION,
    "op3_url_filters": URL_FILTERS,
    "op6_substring_dedup": SUBSTRING_DEDUP,
    "op8_near_duplicates": NEAR_DUPLICATES,
    "op10_line_dedup": LINE_DEDUP,
    "op11_centroid_clustering": CENTROIDS,
    "op13_prefix_trie": CONVERSATION_TRIE,
}
