"""The queries of this subpackage that SQL can say, in DuckDB's dialect over whole tables."""

from __future__ import annotations

_REACH = """reach as (select id as node, id as other from nodes union select r.node, l.y from reach r join both_ways l on r.other = l.x),
roots as (select node, min(other) as root from reach group by 1)"""

OP2 = f"""with recursive v as (select vec_id, label, cast(embedding as double[]) as e from embeddings),
ok as (select * from v where label is not null and e is not null and len(e) > 0 and len(list_filter(e, lambda c: c is null or not isfinite(c))) = 0 and list_dot_product(e, e) > 0),
links as (select a.vec_id as x, b.vec_id as y from ok a join ok b on a.label = b.label and a.vec_id < b.vec_id and len(a.e) = len(b.e) and list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
both_ways as (select x, y from links union all select y, x from links), nodes as (select vec_id as id from embeddings),
{_REACH},
counts as (select x, count(*) as n from both_ways group by 1)
select vec_id, coalesce(n, 0) as n_links, root as component_id, root = vec_id as kept from embeddings left join counts on x = vec_id join roots on node = vec_id"""

OP5 = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as words from documents),
d as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')] else list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) end) as s from w),
sizes as (select doc_id, count(*) as n from d group by 1),
links as (select x, y from (select a.doc_id as x, b.doc_id as y, count(*) as c from d a join d b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2) join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
both_ways as (select x, y from links union all select y, x from links), nodes as (select doc_id as id from documents),
{_REACH}
select t.doc_id, coalesce(n, 0) as n_shingles, root as component_id from documents t left join sizes using (doc_id) join roots on node = t.doc_id"""

_DIGITS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast((cast('0x' || substr(h, {1 + 5 * i}, 5) as bigint) >> {15 - 5 * k}) & 31 as int) + 1, 1)" for i in range(8) for k in range(4))

OP7 = f"""select page_id, octet_length(encode(p)) as payload_bytes, {_DIGITS} as payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type, case when page_id <> first then first end as refers_to
from (select page_id, coalesce(html, '') as p, sha1(coalesce(html, '')) as h, min(page_id) over (partition by coalesce(html, '')) as first from pages)"""

ORACLE_SQL = {"op2_itq_neardup": OP2, "op5_jaccard_join": OP5, "op7_warc_chain": OP7}
