"""SQL twins of those queries that SQL can express on whole tables, for DuckDB."""

from __future__ import annotations

OP6 = r"""
with d as (
  select doc_id, row_number() over () as r, coalesce(text, '') as t,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    string_split(coalesce(text, ''), chr(10)) as l
  from documents),
windows as (select r, i, array_to_string(w[i:i + 7], ' ') as k from d, unnest(range(1, len(w) - 6)) as u(i)),
twice as (select r, i from windows qualify count(*) over (partition by r, k) > 1),
covered as (
  select r, sum(least(8, coalesce(following - i, 8))) as n
  from (select r, i, lead(i) over (partition by r order by i) as following from twice) as s
  group by r),
m as (
  select d.*, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
    len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))
      - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as n_dup_lines,
    coalesce(covered.n, 0) as n_repeat_words,
    len(regexp_extract_all(t, '\p{L}')) as letters
  from d left join covered on d.r = covered.r),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
  n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not (base_failed
    or n_symbols > 0.1::double * n_words
    or len(regexp_extract_all(t, '\p{Lu}')) > 0.4::double * letters
    or len(regexp_extract_all(t, '!')) > 0.1::double * n_words
    or letters < 0.6::double * word_chars
    or word_chars > 15 * n_words or word_chars < 2 * n_words
    or len(list_filter(range(1, n_words), lambda i: w[i] = w[i + 1])) > 0.2::double * n_words
    or (len(l) >= 10 and n_dup_lines > 0.5::double * len(l))) as kept
from b
"""

OP7 = """
with p as (select page_id, coalesce(html, '') as payload from pages),
heads as (select payload, max(page_id) as head from p where strlen(payload) >= 1000 group by payload)
select page_id, strlen(p.payload)::bigint as payload_bytes, sha1(p.payload) as payload_digest,
  case when head is null or head = page_id then 'response' else 'revisit' end as record_type,
  case when head is not null and head <> page_id then head end as refers_to
from p left join heads on p.payload = heads.payload
"""

OP11 = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
  row_number() over (partition by t order by doc_id desc nulls last) = 1 as kept, sha256(t) as text_sha256
from (select doc_id, coalesce(text, '') as t from documents) as d
window same as (partition by t)
"""

OP12 = """
with h as (select doc_id, coalesce(text, '') as t, length(coalesce(text, ''))::bigint as n, sha256('1:' || coalesce(doc_id::varchar, '')) as x from documents),
d as (select *, ('0x' || x[1:8])::bigint as h1, ('0x' || x[9:16])::bigint as h2, ('0x' || x[17:24])::bigint as h3, ('0x' || x[25:32])::bigint as h4 from h),
c as (select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when n = 0 or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= 90 then 'plain'
      when h4 % 100 < 20 then 'spm' else 'psm' end as form from d),
p as (select *, substr(t, 1, a) as prefix, substr(t, a + 1, b - a) as middle, substr(t, b + 1) as suffix from c)
select doc_id, n, form, case when form <> 'plain' then a end as prefix_chars, case when form <> 'plain' then b - a end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(t) as restored_sha256
from p
"""

ORACLES = {"op6_quality_rules": OP6, "op7_warc": OP7, "op11_exact_dedup": OP11, "op12_fill_in_middle": OP12}
