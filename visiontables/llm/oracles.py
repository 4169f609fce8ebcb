"""DuckDB texts for the queries that SQL can state."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op3_embedding_links": """
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
 n as (select vec_id, e, sqrt(list_dot_product(e, e)) as l from v),
 p as materialized (select a.vec_id as x, b.vec_id as y from n a join n b on a.vec_id <> b.vec_id and a.l > 0 and b.l > 0 and list_dot_product(a.e, b.e) / (a.l * b.l) >= 0.9),
 r(x, y) as (select vec_id, vec_id from v union select r.x, p.y from r join p on p.x = r.y),
 c as (select x, count(*) as k from p group by 1)
select v.vec_id, coalesce(any_value(c.k), 0)::bigint as n_links, min(r.y) as component_id, min(r.y) = v.vec_id as kept
 from v join r on r.x = v.vec_id left join c on c.x = v.vec_id group by v.vec_id""",
    "op7_jaccard_join": f"""
with recursive d as (select doc_id, regexp_extract_all({_LOW}, '[^\\x20\\x09-\\x0D]+') as w from documents),
 s as materialized (select distinct doc_id, hash(array_to_string(list_slice(w, k, k + 3), ' ')) as h from (select doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) as k from d where len(w) > 0)),
 c as (select doc_id, count(*) as n from s group by 1),
 o as (select a.doc_id as x, b.doc_id as y, count(*) as i from s a join s b on a.h = b.h and a.doc_id <> b.doc_id group by 1, 2),
 p as materialized (select x, y from o join c a on a.doc_id = x join c b on b.doc_id = y where 100 * i >= 85 * (a.n + b.n - i)),
 r(x, y) as (select doc_id, doc_id from d union select r.x, p.y from r join p on p.x = r.y)
select d.doc_id, coalesce(any_value(c.n), 0)::bigint as n_shingles, min(r.y) as component_id from d join r on r.x = d.doc_id left join c on c.doc_id = d.doc_id group by d.doc_id""",
    "op8_benchmark_passages": f"""
with d as materialized (select doc_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from documents),
 i as (select item_id, regexp_extract_all({_LOW}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') as w from benchmark),
 p as materialized (select distinct item_id, least(len(w), 10) as m, array_to_string(list_slice(w, k, k + least(len(w), 10) - 1), ' ') as t
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as k from i where len(w) > 0)),
 q as (select doc_id, m, k, array_to_string(list_slice(w, k, k + m - 1), ' ') as t from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as k from d, (select distinct m from p) where len(w) >= m)),
 f as materialized (select doc_id, k, q.m, item_id from q join p on p.t = q.t and p.m = q.m),
 h as (select doc_id, count(distinct x) as n from (select doc_id, unnest(range(k, k + m)) as x from f) group by 1),
 a as (select doc_id, count(*) as n, string_agg(item_id::varchar, ',' order by item_id::varchar) as ids from (select distinct doc_id, item_id from f) group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(h.n, 0)::bigint as n_hit, coalesce(a.n, 0)::bigint as n_items, sha256(coalesce(a.ids, '')) as items_sha256, coalesce(h.n, 0) > 0 as contaminated
 from d left join h on h.doc_id = d.doc_id left join a on a.doc_id = d.doc_id""",
    "op10_repeated_spans": """
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as b from documents),
 w as materialized (select doc_id, k, hash(substr(b, (2 * k + 1)::bigint, 100)) as h from (select doc_id, b, unnest(range(0, (len(b) // 2 - 49)::bigint)) as k from d)),
 f as (select h, min(doc_id) as first from w group by h having min(doc_id) < max(doc_id)),
 c as (select doc_id, k, coalesce(lag(k) over (partition by doc_id order by k) + 50 < k, true) as new from w join f using (h) where first < doc_id),
 g as (select doc_id, k, sum(new::integer) over (partition by doc_id order by k) as run from c),
 s as materialized (select doc_id, run, min(k) as a, max(k) + 50 as z from g group by 1, 2),
 e as (select doc_id, a, z, coalesce(lag(z) over (partition by doc_id order by a), 0) as before from s),
 t as (select doc_id, sum(z - a) as removed, count(*) as spans, max(z) as last, string_agg(substr(b, (2 * before + 1)::bigint, (2 * (a - before))::bigint), '' order by a) as kept from e join d using (doc_id) group by doc_id)
select d.doc_id, (len(b) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(spans, 0)::bigint as n_spans,
 sha256(unhex(coalesce(kept, '') || substr(b, (2 * coalesce(last, 0) + 1)::bigint))) as kept_sha256 from d left join t using (doc_id)""",
    "op11_prefix_trie": """
with o as materialized (select conv_id as c, coalesce(role, '') as r, coalesce(text, '') as x,
  row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as p from conversations where conv_id is not null),
 i as materialized (select c, c - c % 20 as base, xor(4294967295, list_reduce(list_transform(string_split(c::varchar, ''), lambda y: ord(y)::bigint),
   lambda s, y: list_reduce(range(8), lambda t, k: case when t % 2 = 1 then xor(t // 2, 3988292384) else t // 2 end, xor(s, y)), 4294967295::bigint)) % 4 as h from (select distinct c from o)),
 w as (select i.c, p, r, x from i join o on o.c = i.base and p <= h union all select i.c, p, r, x from i join o on o.c = i.c and p > h),
 s as (select c, row_number() over (partition by c order by p) as d, sha256(to_json([r, x])) as k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as n from w),
 l as materialized (select i.c, coalesce(list(k order by d) filter (k is not null), []) as ks, coalesce(list(n order by d) filter (k is not null), []) as ns from i left join s using (c) group by i.c),
 m as materialized (select c, d, sha256(array_to_string(list_slice(ks, 1, d), '')) as k, case when d > 0 then sha256(array_to_string(list_slice(ks, 1, d - 1), '')) end as pk, case when d > 0 then ns[d] else 0 end as n, len(ks) = d as last
  from (select c, ks, ns, unnest(range(0, len(ks) + 1)) as d from l)),
 v as materialized (select d, k, any_value(pk) as pk, min(c) as c, count(*) as convs, any_value(n) as n, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (last), '')) as ends from m group by d, k),
 q as materialized (select v.d, v.k, any_value(v.pk) as pk, any_value(v.c) as c, any_value(v.convs) as convs, any_value(v.n) as n, any_value(v.ends) as ends, count(u.k) as children from v left join v u on u.pk = v.k and u.d = v.d + 1 group by v.d, v.k),
 t as (select a.d, a.k, sum((q.children = 0)::bigint)::bigint as leaves, sum((q.convs - 1) * q.n)::bigint as saved from q join m a on a.c = q.c and a.d <= q.d group by a.d, a.k)
select q.c as conv_id, q.d as depth, u.c as parent_conv_id, q.convs as n_convs, q.children as n_children, leaves as n_leaves, saved as saved_tokens, q.ends as ends_sha256
 from q join t on t.d = q.d and t.k = q.k left join q u on u.k = q.pk and u.d = q.d - 1""",
    "op12_phrases": f"""
with d as materialized (select coalesce(lang, 'und') as lang, list_transform(string_split_regex({_LOW}, '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+')) as ps from documents),
 p as materialized (select lang, w from (select lang, unnest(ps) as w from d) where len(w) > 0),
 n as (select lang, sum(len(w))::bigint as n from p group by 1),
 g as (select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as t from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from p, (select unnest([1, 2, 3]) as k) where len(w) >= k)),
 f as materialized (select lang, k, t, count(*) as a from g group by all having count(*) >= 10),
 c as (select lang, k, t, a, string_split(t, ' ') as w from f where k > 1),
 u as (select lang, k, t, a, unnest(range(1, k)) as cut, w from c),
 x as (select u.lang, u.k, u.t, u.a, cut, l.a as l, r.a as r, ((1000000::hugeint * u.a * u.a) // (l.a::hugeint * r.a))::bigint as score
  from u join f l on l.lang = u.lang and l.t = array_to_string(list_slice(w, 1, cut), ' ') join f r on r.lang = u.lang and r.t = array_to_string(list_slice(w, cut + 1, u.k), ' ')),
 y as (select * from x qualify row_number() over (partition by lang, t order by score, cut) = 1),
 o as (select lang, array_to_string(list_slice(w, i, i + 1), ' ') as t, max(a) as a from (select lang, w, a, unnest([1, 2]) as i from c where k = 3) group by all),
 z as (select y.lang, y.t as phrase, y.a, l, r, score from y left join o on y.k = 2 and o.lang = y.lang and o.t = y.t where o.a is null or 100 * o.a < 50 * y.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from z join n using (lang) qualify rank <= 2000""",
}
