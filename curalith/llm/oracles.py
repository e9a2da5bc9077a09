"""DuckDB SQL of the queries that SQL can express."""

ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
with split as (
  select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as lines from documents
), lines as (
  select r, doc_id, unnest(lines) as line, unnest(range(len(lines))) as pos from split
), keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from lines
), frequent as (
  select k from keyed where length(k) >= 1 group by k having count(distinct r) >= 10
), marked as (
  select keyed.*, frequent.k is not null as dropped from keyed left join frequent on keyed.k = frequent.k
)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256
from marked group by r, doc_id
""",
    "op2_quality": r"""
with base as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), grams as (
  select r, unnest(range(1, greatest(len(w) - 1, 1))) as i, w from base where len(w) >= 3
), keyed as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from grams
), often as (
  select r, i from keyed qualify count(*) over (partition by r, g) > 1
), covered as (
  select r, count(distinct i + k) as n from often, (values (0), (1), (2)) o(k) group by r
), stats as (
  select b.*, len(w) as n_words, list_sum(list_transform(w, lambda x: length(x))) as chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols, len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(c.n, 0) as n_repeat_words,
         length(regexp_replace(text, '[^\p{L}]', '', 'g')) as letters, len(list_distinct(w)) as kinds, len(list_filter(lines, lambda x: regexp_matches(x, '^\s*[-*•]'))) as bullets,
         coalesce(list_max(list_transform(w, lambda x: length(x))), 0) as longest
  from base b left join covered c using (r)
)
select doc_id, n_words::bigint as n_words, coalesce(chars, 0)::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
  n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
  not (n_words < 50 or 100 * n_repeat_words > 50 * n_words or chars < 2 * n_words or chars > 14 * n_words or 10 * n_symbols > n_words
       or len(lines) >= 4 and 100 * n_dup_lines > 50 * len(lines) or 100 * letters < 50 * chars or 100 * kinds < 8 * least(n_words, 1000)
       or len(lines) >= 4 and 100 * bullets > 90 * len(lines) or longest > 1000) as kept
from stats
""",
    "op6_ngram_join": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, g from (
    select doc_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] as g from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from w where len(w) >= 5)
    union all select doc_id, array_to_string(w, ' ') from w where len(w) between 1 and 4)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), c as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all
), links as (
  select c.a, c.b from c join n x on x.doc_id = c.a join n y on y.doc_id = c.b where 100 * k >= 80 * (x.n + y.n - k)
), reach as (
  select doc_id, doc_id as other from documents union select r.doc_id, l.b from reach r join links l on l.a = r.other
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, (select min(other) from reach r where r.doc_id = d.doc_id) as component_id from documents d left join n using (doc_id)
""",
    "op9_substring_dedup": r"""
with base as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents
), windows as (
  select r, i, md5(array_to_string(w[i:i + 34], ' ')) as h from (select r, w, unnest(range(1, len(w) - 33)) as i from base where len(w) >= 35)
), often as (
  select r, i from windows qualify count(*) over (partition by h) > 1
), covered as (
  select distinct r, i + k as p from often, (select unnest(range(0, 35)) as k)
), words as (
  select r, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from base
), kept as (
  select r, string_agg(word, ' ' order by p) as t from words anti join covered using (r, p) group by r
)
select doc_id, len(w)::bigint as n_words, coalesce((select count(*) from covered c where c.r = base.r), 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from base left join kept using (r)
""",
}
