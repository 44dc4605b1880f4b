"""DuckDB SQL of the queries that SQL can express, by plain brute force."""

from __future__ import annotations

import string

_SPACED = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_PLAIN = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

_NEAR = f"""
with recursive words as (select doc_id, {_SPACED} as w from documents),
runs as (
  select doc_id, array_to_string(w[s : s + 4], ' ') as run, count(*) as c
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as s from words where len(w) > 0) as x
  group by all),
sizes as (select doc_id, sum(c) as n from runs group by doc_id),
common_runs as (
  select x.doc_id as a, y.doc_id as b, sum(least(x.c, y.c)) as common
  from runs as x join runs as y on x.run = y.run and x.doc_id <> y.doc_id group by all),
links as (
  select a, b, common = x.n and common = y.n as same
  from common_runs join sizes as x on a = x.doc_id join sizes as y on b = y.doc_id
  where common::double / (x.n + y.n - common) >= 0.8::double),
reached(a, b) as (
  select doc_id, doc_id from documents union select r.a, l.b from reached as r join links as l on r.b = l.a)
select doc_id, least(doc_id, (select min(b) from links where a = doc_id and same)) as bag_id,
  class_id, class_id = doc_id as kept
from documents join (select a, min(b) as class_id from reached group by a) as g on a = doc_id"""

_REPEATS = f"""
with words as (select doc_id, {_SPACED} as w from documents),
windows as (
  select doc_id, s, array_to_string(w[s : s + 19], ' ') as run
  from (select doc_id, w, unnest(range(1, len(w) - 18)) as s from words where len(w) >= 20) as x),
later as (select * from windows qualify row_number() over (partition by run order by doc_id, s) > 1),
gone as (select distinct doc_id, unnest(range(s, s + 20)) as place from later),
kept as (
  select x.doc_id, string_agg(word, ' ' order by x.place) as text, count(*) as n
  from (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as place from words) as x
  anti join gone using (doc_id, place) group by x.doc_id)
select w.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
  sha256(coalesce(text, '')) as kept_sha256
from words as w left join kept using (doc_id)"""

_LINKS = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings),
links as (
  select x.vec_id as a, y.vec_id as b from v as x join v as y on x.vec_id <> y.vec_id
  where list_cosine_similarity(x.e, y.e) >= 0.95::double),
reached(a, b) as (
  select vec_id, vec_id from v union select r.a, l.b from reached as r join links as l on r.b = l.a)
select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, component_id = vec_id as kept
from v join (select a, min(b) as component_id from reached group by a) as g on a = vec_id"""

_LEAKS = f"""
with words as (select doc_id, {_PLAIN} as w from documents),
windows as (
  select distinct item_id, array_to_string(w[s : s + 9], ' ') as run, least(len(w), 10) as n
  from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as s
        from (select item_id, {_PLAIN} as w from benchmark) as b where len(w) > 0) as x),
places as (
  select doc_id, s, n, array_to_string(w[s : s + n - 1], ' ') as run
  from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s
        from words, (select distinct n from windows) as l where len(w) >= n) as x),
found as (select doc_id, s, p.n, item_id from places as p join windows as i on p.run = i.run),
hit as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(s, s + n)) as place from found) as x group by doc_id),
items as (
  select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as ids
  from (select distinct doc_id, item_id::varchar as item from found) as x group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from words as w left join hit using (doc_id) left join items using (doc_id)"""

_TERMS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), "
    r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
)

_DIVERGENCE = f"""
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, {_TERMS} as w,
             row_number() over () as r from documents),
groups as (select distinct lang, source from d),
gt as (select lang, source, term, count(*) as c, count(distinct r) as n
       from (select lang, source, r, unnest(w) as term from d) as x group by all),
kept as (select lang, term, sum(c) as lc from gt group by all having sum(n) >= 30),
v as (select lang, count(*) as vv, sum(lc) as ln from kept group by lang),
gn as (select g.lang, g.source, coalesce(sum(gt.c), 0) as nn
       from groups as g left join (gt semi join kept using (lang, term)) as gt using (lang, source) group by all),
p as (select g.lang, g.source, k.term, coalesce(gt.c, 0) as c,
        1 + (1000000000::hugeint * (coalesce(gt.c, 0) + 5)) // (gn.nn + 5 * v.vv) as p
      from groups as g join kept as k using (lang) join v using (lang) join gn using (lang, source)
      left join gt using (lang, source, term)),
q as (select lang, term, 1 + (1000000000::hugeint * (lc + 5)) // (ln + 5 * vv) as q from kept join v using (lang)),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value
  from groups as a join groups as b on a.lang = b.lang and a.source <> b.source
  left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value
             from p as x join p as y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) as s
    on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (
  select lang, source, term as item, p - q as value from p join q using (lang, term) where c > 0 and p > q)
select lang, source, part, item, value::bigint as value, rank::integer as rank from (
  select *, 'pair' as part, row_number() over (partition by lang, source order by value desc, item) as rank from pairs
  union all
  select *, 'term' as part, row_number() over (partition by lang, source order by value desc, item) as rank from terms)
where part = 'pair' or rank <= 50"""

_NEGATIVES = """
with r as (
  select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (
  select a.vec_id as anchor_id, a.label as al, a.v as av, b.vec_id, b.label,
    coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2])), 0)::bigint as score
  from (select * from r where vec_id % 100 = 0) as a, r as b),
pos as (
  select *, row_number() over (partition by anchor_id, al, av order by score desc, vec_id) as k
  from scored where label = al and vec_id <> anchor_id qualify k <= 5),
neg as (
  select p.anchor_id, p.vec_id as positive_id, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score,
    row_number() over (partition by p.anchor_id, p.al, p.av, p.k order by n.score desc, n.vec_id) as rank
  from pos as p join scored as n on n.anchor_id = p.anchor_id and n.al = p.al and n.av = p.av and n.label <> p.al
  where 80 * p.score <= 100 * n.score and n.score <= p.score qualify rank <= 5)
select anchor_id, positive_id, rank::integer as rank, negative_id, positive_score, negative_score from neg"""

ORACLES = {
    "op1_near_dedup": _NEAR,
    "op2_substring_dedup": _REPEATS,
    "op7_embedding_dedup": _LINKS,
    "op9_decontamination": _LEAKS,
    "op11_source_divergence": _DIVERGENCE,
    "op12_hard_negatives": _NEGATIVES,
}
