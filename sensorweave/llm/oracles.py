"""DuckDB SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
with d as (select row_number() over () as r, doc_id, coalesce({_WORDS.format('text')}, []) as w from documents),
i as (select cast(item_id as varchar) as item_id, {_WORDS.format('text')} as w from benchmark where item_id is not null and text is not null),
s as (select item_id, w, len(w) as n, least(13, len(w)) as k from i where len(w) > 0),
win as (select item_id, k, array_to_string(w[p : p + k - 1], ' ') as g from (select item_id, w, k, unnest(range(1, n - k + 2)) as p from s)),
grams as (select r, k, p, array_to_string(w[p : p + k - 1], ' ') as g from (select r, k, w, unnest(range(1, len(w) - k + 2)) as p from d, (select distinct k from win) where len(w) >= k)),
hit as (select r, item_id, p, grams.k as k from grams join win on grams.g = win.g and grams.k = win.k),
pos as (select r, count(distinct q) as n_hit from (select distinct r, unnest(range(p, p + k)) as q from hit) group by r),
its as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct r, item_id from hit) group by r)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
 sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join pos using (r) left join its using (r)
"""

OP3 = """
with p as (select page_id, coalesce(html, '') as h from pages),
d as (select page_id, octet_length(encode(h)) as n, sha1(h) as x, row_number() over (partition by h order by page_id desc) as k, max(page_id) over (partition by h) as top from p),
bits as (select *, (select string_agg(lpad(bin(('0x' || substr(x, i, 1))::int), 4, '0'), '' order by i) from (select unnest(range(1, 41)) as i)) as b from d)
select page_id, cast(n as bigint) as payload_bytes,
 (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum([(substr(b, 5 * j + 1 + q, 1))::int * cast(pow(2, 4 - q) as int) for q in range(0, 5)])::int, 1), '' order by j) from (select unnest(range(0, 32)) as j)) as payload_digest,
 case when k = 1 then 'response' else 'revisit' end as record_type, case when k > 1 then top end as refers_to
from bits
"""

OP10 = """
with rules(action, h, q) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
u as (select row_number() over () as r, page_id,
 coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
 coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path from pages),
best as (select r, arg_max(h || q, length(h || q)) as rule, arg_max(action, length(h || q)) as action from u join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, q) group by r)
select page_id, host, path, rule, coalesce(action, 'allow') as verdict from u left join best using (r)
"""

OP8 = """
with e as (select vec_id, label, embedding from embeddings where vec_id is not null and label is not null and embedding is not null and list_count(embedding) = len(embedding)
  and len(list_filter(embedding, lambda x: not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
p as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id <> b.vec_id and len(a.embedding) = len(b.embedding)
  where list_cosine_similarity(a.embedding::double[], b.embedding::double[]) >= 0.98),
r as (with recursive w(n, m) as (select a, b from p union select w.n, p.b from w join p on p.a = w.m) select n, min(m) as m from w group by n),
c as (select a, count(*) as n from p group by a)
select vec_id, coalesce(c.n, 0) as n_links, least(vec_id, coalesce(r.m, vec_id)) as component_id, vec_id = least(vec_id, coalesce(r.m, vec_id)) as kept
from embeddings left join c on c.a = vec_id left join r on r.n = vec_id
"""

OP12 = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)) as x
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0 and list_count(embedding) = len(embedding) and len(list_filter(embedding, lambda c: not isfinite(c))) = 0),
s as (select a.vec_id as anchor_id, a.label as own, b.vec_id, b.label, cast(list_inner_product(a.x, b.x) as bigint) as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id and len(a.x) = len(b.x)),
p as (select anchor_id, vec_id as positive_id, own, score as positive_score from s where label = own qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, cast(row_number() over w as int) as rank, s.vec_id as negative_id, positive_score, s.score as negative_score
from p join s using (anchor_id) where s.label <> p.own and 80 * positive_score <= 100 * s.score and s.score <= positive_score
window w as (partition by anchor_id, positive_id order by s.score desc, s.vec_id) qualify row_number() over w <= 5
"""


def _sketch(text: str) -> str:
    return f"""(select case when len(list_filter(h, lambda x: x < '2')) > 0 or len(h) = 0 then list_sort(list_distinct([left(x, 16) for x in h if x < '2'])) else [left(list_min(h), 16)] end
  from (select case when len(w) = 0 then [] else [md5(array_to_string(w[i : i + 4], ' ')) for i in range(1, greatest(len(w) - 4, 1) + 1)] end as h from (select {_WORDS.format(text)} as w)))"""


OP13 = f"""
with d as (select doc_id, coalesce(text, '') as t, length(coalesce(text, '')) as n from documents),
o as (select *, coalesce(lead(doc_id) over w, first_value(doc_id) over w) as next_id, coalesce(lead(t) over w, first_value(t) over w) as next_t from d window w as (order by doc_id desc)),
e as (select *, substr(t, 1, n - n // 3) || substr(next_t, 1, n // 3) as edited from o),
s as (select doc_id, next_id, n, edited, {_sketch('t')} as s, {_sketch('edited')} as x from e),
j as (select s.*, b.s as y from s join s b on b.doc_id = s.next_id),
c as (select *, len(list_intersect(s, x)) as sx, len(list_intersect(s, y)) as sy from j)
select doc_id, n as n_chars, sha256(edited) as edited_sha256, array_to_string(s, '') as fingerprint, array_to_string(x, '') as edited_fingerprint,
 case when len(s) + len(x) = 0 then 1.0::double else sx / (len(s) + len(x) - sx) end as near_edited, case when len(s) + len(y) = 0 then 1.0::double else sy / (len(s) + len(y) - sy) end as near_next,
 case when len(s) = 0 then 1.0::double else sx / len(s) end as in_edited, case when len(s) = 0 then 1.0::double else sy / len(s) end as in_next
from c
"""

ORACLES: dict[str, str] = {"op1_decontaminate": OP1, "op3_warc": OP3, "op8_vectors": OP8, "op10_urlfilter": OP10, "op12_negatives": OP12, "op13_fingerprints": OP13}
