"""Registered queries of the subpackage and their SQL statements."""

from __future__ import annotations

from .decontamination import op3_decontamination
from .exact_dedup import op7_exact_dedup
from .html_extract import op4_html_extract
from .jaccard_join import op8_jaccard_join
from .mixing import op1_mixing
from .prefix_trie import op13_prefix_trie
from .sharding import op10_sharding
from .substring_dedup import op2_substring_dedup
from .suffix_dedup import op9_suffix_dedup
from .token_counts import op11_token_counts
from .toxicity import op5_toxicity
from .vector_codes import op12_vector_codes
from .warc_zip import op6_warc_zip

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontamination": op3_decontamination,
    "op4_html_extract": op4_html_extract,
    "op5_toxicity": op5_toxicity,
    "op6_warc_zip": op6_warc_zip,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sharding": op10_sharding,
    "op11_token_counts": op11_token_counts,
    "op12_vector_codes": op12_vector_codes,
    "op13_prefix_trie": op13_prefix_trie,
}

_OP2 = r"""
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as k
        from (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50) t),
again as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by k) as f from win) t where f < doc_id),
gone as (select distinct doc_id, i + j as pos from again, (select unnest(range(0, 50)) as j) o),
words as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as pos from w),
kept as (select words.doc_id, count(*) as n_kept, string_agg(word, ' ' order by words.pos) as t
         from words left join gone on words.doc_id = gone.doc_id and words.pos = gone.pos
         where gone.pos is null group by words.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(len(ws) - coalesce(n_kept, 0) as bigint) as n_removed,
       sha256(coalesce(t, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id"""

_OP3 = r"""
with a as (select cast(item_id as varchar) as item,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
asked as (select distinct item, n, array_to_string(ws[s:s + n - 1], ' ') as k
          from (select item, ws, least(len(ws), 13) as n, unnest(range(1, len(ws) - least(len(ws), 13) + 2)) as s
                from a where len(ws) > 0) t),
d as (select doc_id,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
places as (select doc_id, n, s, array_to_string(ws[s:s + n - 1], ' ') as k
           from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as s
                 from d, (select distinct n from asked) l where len(ws) >= n) t),
found as (select doc_id, s, places.n, item from places join asked on places.n = asked.n and places.k = asked.k),
hit as (select doc_id, count(distinct pos) as n_hit from (select doc_id, unnest(range(s, s + n)) as pos from found) t group by doc_id),
which as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
          from (select distinct doc_id, item from found) t group by doc_id),
post as (select doc_id, unnest(ws) as term, unnest(range(0, len(ws))) as pos from d),
freq as (select term, count(*) as df from post group by term),
places_of as (select k, unnest(string_split(k, ' ')) as term, unnest(range(0, n)) as off from (select distinct n, k from asked) t),
ranks as (select k, term, off, row_number() over (partition by k order by coalesce(df, 0), off) as r,
                 min(coalesce(df, 0)) over (partition by k) as least_df from places_of left join freq using (term)),
rare as (select k, term, off, r, count(*) over (partition by k) as asks from ranks where r <= 2 and least_df > 0),
lists as (select k, doc_id, pos - off as at, r, asks from post join rare using (term)),
close as (select distinct a.k, a.doc_id from lists a left join lists b on a.k = b.k and a.doc_id = b.doc_id and b.r = 2
          where a.r = 1 and (a.asks = 1 or abs(a.at - b.at) <= 5)),
near as (select doc_id, count(distinct item) as n_near from close join asked using (k) group by doc_id)
select d.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
       cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
       coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(ws) as contaminated,
       cast(coalesce(n_near, 0) as bigint) as n_near
from d left join hit on d.doc_id = hit.doc_id left join which on d.doc_id = which.doc_id left join near on d.doc_id = near.doc_id"""

_OP7 = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       cast(count(*) over (partition by coalesce(text, '')) as bigint) as group_size,
       doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept, sha256(coalesce(text, '')) as text_sha256
from documents"""

_NEAREST12 = """
d{r} as (select c.vec_id, c.part, min(64 * dd + entry) as best from
           (select c.vec_id, c.part, b.entry, sum((c.v - b.v) * (c.v - b.v)) as dd from comp c join cb{r} b using (part, pos)
            group by c.vec_id, c.part, b.entry) c group by c.vec_id, c.part),
"""

_ROUND12 = """
cb{n} as (select b.part, b.entry, b.pos, coalesce(m.v, b.v) as v from cb{r} b left join
           (select c.part, d.best % 64 as entry, c.pos, cast(floor(sum(c.v)::double / count(*)) as bigint) as v
            from comp c join d{r} d using (vec_id, part) group by all) m using (part, entry, pos)),
"""

_OP12 = """
with kept as (select vec_id, label, embedding as e from embeddings
              where len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
spots as (select vec_id, unnest(range(1, len(e) + 1)) as i, len(e) // 16 as w, e from kept),
comp as (select vec_id, (i - 1) // w as part, (i - 1) % w as pos, cast(floor(256 * e[i]::double) as bigint) as v from spots),
seeds as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < 64),
cb0 as (select part, entry, pos, v from comp join seeds using (vec_id)),
""" + _NEAREST12.format(r=0) + _ROUND12.format(r=0, n=1) + _NEAREST12.format(r=1) + _ROUND12.format(r=1, n=2) + _NEAREST12.format(r=2) + """
book as (select sha256(string_agg(v::varchar, ',' order by part, entry, pos)) as codebooks_sha256 from cb2),
codes as (select vec_id, string_agg(printf('%02x', (best % 64)::int), '' order by part) as code, cast(sum(best // 64) as bigint) as error
          from d2 group by vec_id)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error, codebooks_sha256, label
from codes join kept using (vec_id), book"""

_OP13 = """
with turns as (select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
                      row_number() over (partition by conv_id order by turn nulls first) as i
               from conversations where conv_id is not null),
bits as (select conv_id, list_transform(range(8 * length(conv_id::varchar)),
                lambda j: ((ascii(substr(conv_id::varchar, (j // 8 + 1)::int, 1)) >> (j % 8)::int) & 1)::bigint) as b
         from (select distinct conv_id from turns) t),
convs as (select conv_id, xor(list_reduce([4294967295::bigint] || b, lambda c, x: xor(c >> 1, (xor(c, x) & 1) * 3988292384::bigint)),
                              4294967295::bigint) % 6 as h from bits),
again as (select c.conv_id, 0 as own, t.i, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id - c.conv_id % 100 and t.i <= h
          union all select c.conv_id, 1, t.i, t.role, t.text from convs c join turns t on t.conv_id = c.conv_id and t.i > h),
paths as (select c.conv_id, coalesce(list({'role': role, 'text': text} order by own, i) filter (i is not null), []) as t
          from convs c left join again a using (conv_id) group by c.conv_id),
steps as (select conv_id, len(t) as n, t, unnest(range(0, len(t) + 1)) as depth from paths),
nodes as (select t[1:depth] as p, depth, min(conv_id) as conv_id, count(*) as n_convs,
                 sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth), '')) as ends_sha256
          from steps group by 1, 2),
kids as (select p[1:depth - 1] as p, count(*) as n_children from nodes where depth > 0 group by 1),
own as (select n.*, coalesce(n_children, 0) as n_children, case when depth = 0 then 0 else (n_convs - 1) * length(n.p[depth].text) end as saved
        from nodes n left join kids k using (p)),
over as (select p, depth, n_children, saved, unnest(range(0, depth + 1)) as top from own),
sums as (select p[1:top] as p, sum((n_children = 0)::int) as n_leaves, sum(saved) as saved_tokens from over group by 1)
select o.conv_id, cast(o.depth as bigint) as depth, u.conv_id as parent_conv_id, o.n_convs, o.n_children,
       cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, o.ends_sha256
from own o join sums s using (p) left join nodes u on o.depth > 0 and u.p = o.p[1:o.depth - 1]"""

#: the others are compared with brute force in tests/llm: SQL has no learnt model, no HTML parser, no CRC-32 or base32,
#: no seeded shuffle of ours, or takes too long on whole tables
ORACLE: dict[str, str] = {
    "op2_substring_dedup": _OP2,
    "op3_decontamination": _OP3,
    "op7_exact_dedup": _OP7,
    "op12_vector_codes": _OP12,
    "op13_prefix_trie": _OP13,
}
