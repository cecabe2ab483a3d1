"""DuckDB SQL for the queries that SQL can express."""

SQL: dict[str, str] = {}

SQL["op1_line_dedup"] = r"""
with lines as (
  select doc_id, text, i - 1 as line_no, trim(regexp_replace(raw, '[\x09-\x0D ]+', ' ', 'g'), ' ') as plain
  from (select doc_id, text, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)), 1) as i
        from documents where doc_id is not null)
), masks as (
  select doc_id, text, line_no, plain, string_split(regexp_replace(plain, '[^ ]*[0-9][^ ]*', '<*>', 'g'), ' ') as toks
  from lines where plain <> ''
), occ as (
  select *, len(toks) as n, array_to_string(toks, ' ') as line, array_to_string(toks[1:4], ' ') as lead from masks
), cand as (
  select n, lead from occ where n > 4 group by n, lead having min(doc_id) <> max(doc_id) and count(distinct line) > 1
), dl as (
  select distinct n, lead, line, toks from occ join cand using (n, lead)
), tok as (
  select n, lead, line, generate_subscripts(toks, 1) as pos, unnest(toks) as token from dl
), shared as (
  select n, lead, pos, token from tok where pos > 4 group by all having count(*) > 1
), tpl as (
  select n, lead, line, string_agg(case when pos <= 4 or s.token is not null then t.token else '<*>' end, ' ' order by pos) as template
  from tok t left join shared s using (n, lead, pos, token) group by n, lead, line
), gen as (
  select n, lead, line, template from tpl
  where template <> line and (length(template) - length(replace(template, '<*>', ''))) / 3 <= (1 - 0.7) * n
), keyed as (
  select doc_id, text, line_no, says, case when says then coalesce(template, line) else plain end as tkey
  from (select occ.*, gen.template, (length(line) - length(replace(line, '<*>', ''))) / 3 * 2 <= n as says
        from occ left join gen using (n, lead, line))
), rec as (
  select says, tkey from keyed group by all having count(distinct doc_id) >= 2
), ranked as (
  select k.*, rank() over (partition by says, tkey order by doc_id, text, line_no) as r
  from keyed k join rec using (says, tkey)
), gone as (
  select doc_id, text, list(line_no) as drops from ranked where r > 1 group by doc_id, text
)
select d.doc_id,
  case when drops is null then d.text else
    coalesce(array_to_string(list_transform(list_filter(range(len(string_split(d.text, chr(10)))), lambda i: not list_contains(drops, i)),
      lambda i: string_split(d.text, chr(10))[i + 1]), chr(10)), '') end as text,
  case when d.text is null then 0 else len(string_split(d.text, chr(10))) end::int as n_lines,
  coalesce(len(drops), 0)::int as n_dropped
from documents d left join gone g on g.doc_id = d.doc_id and g.text = d.text
"""

SQL["op2_mix_sources"] = r"""
with rows_ as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
    md5(coalesce(doc_id::varchar, '') || chr(10) || coalesce(text, '')) as k
  from documents
), sizes as (
  select source, sum(size)::bigint as source_size from rows_ group by source
), weighted as (
  select source, source_size, 3 * source_size as most,
    1 + (row_number() over (order by source is null, source) - 1) % 3 as w from sizes
), ordered as (
  select *, sum(source_size) over ()::double as total, sum(w) over ()::double as all_w,
    coalesce(sum(most) over p, 0)::double as most_before, coalesce(sum(w) over p, 0)::double as w_before
  from weighted window p as (order by most / w, source is null, source rows between unbounded preceding and 1 preceding)
), flagged as (
  select *, most / w <= (total - most_before) / (all_w - w_before) as full_ from ordered
), levels as (
  select *, (total - sum(case when full_ then most else 0 end) over ()) / nullif(all_w - sum(case when full_ then w else 0 end) over (), 0) as level
  from flagged
), targets as (
  select source, source_size, case when full_ then most::double else level * w end as target from levels
), placed as (
  select r.*, source_size, target,
    coalesce(sum(size) over (partition by r.source order by k, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
  from rows_ r join targets t on r.source is not distinct from t.source
), epochs as (
  select *, case when source_size = 0 then 0 else floor(target)::bigint // source_size end as whole from placed
)
select doc_id, size, source_size, target,
  (whole * size + greatest(0, least(size, floor(target)::bigint - whole * source_size - before)))::bigint as taken
from epochs
"""

SQL["op10_chat_format"] = r"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized as (
  select *, md5(coalesce(turn::varchar, 'null') || chr(10) || role || chr(10) || text) as key, length(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'))
    + length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;')) + 8 + 8 + 8 as chars from said
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls last, role, key)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls last, role, key) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id
"""

SQL["op12_fill_in_middle"] = r"""
with lines as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units,
    sha256('7:' || coalesce(doc_id::varchar, '')) as hex
  from documents
), draws as (
  select *, len(units) as n, ('0x' || hex[1:8])::bigint as h1, ('0x' || hex[9:16])::bigint as h2, ('0x' || hex[17:24])::bigint as h3, ('0x' || hex[25:32])::bigint as h4
  from lines
), ends as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as lo, greatest(h1 % (n + 1), h2 % (n + 1)) as hi,
    text = '' or text like '%<P>%' or text like '%<S>%' or text like '%<M>%' or h3 % 100 >= 100 as plain, h4 % 100 < 50 as spm
  from draws
), lengths as (
  select *, coalesce(list_sum(list_transform(units[1:lo], lambda u: length(u))), 0)::bigint as prefix_chars,
    coalesce(list_sum(list_transform(units[1:hi], lambda u: length(u))), 0)::bigint as both_chars
  from ends
), parts as (
  select *, text[1:prefix_chars] as prefix, text[prefix_chars + 1:both_chars] as middle, text[both_chars + 1:] as suffix from lengths
)
select doc_id, n::bigint as n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
  case when not plain then prefix_chars end as prefix_chars, case when not plain then both_chars - prefix_chars end as middle_chars,
  sha256(case when plain then text when spm then '<S>' || suffix || '<P>' || prefix || '<M>' || middle else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from parts
"""

SQL["op13_quality_rules"] = r"""
with base as (
  select row_number() over () as k, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), windows as (
  select k, i, words[i:i + 2] as w from (select k, words, unnest(range(1, len(words) - 1)) as i from base)
), twice as (
  select k, i from (select k, i, count(*) over (partition by k, w) as n from windows) where n > 1
), spread as (
  select k, count(distinct i + j)::bigint as n_repeat_words from twice, (values (0), (1), (2)) t(j) group by k
), counts as (
  select b.*, len(words)::bigint as n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from base b left join spread s using (k)
), judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•‣▪·]'))) as bullets,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as ellipses,
    len(list_filter(words, lambda w: regexp_matches(w, '\p{L}'))) as lettered,
    length(regexp_replace(text, '\P{L}+', '', 'g')) as letters, length(regexp_replace(text, '\P{Lu}+', '', 'g')) as capitals,
    len(regexp_extract_all(text, '[!?]{2,}')) as marks
  from counts
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not (base_failed or word_chars < 3 * n_words or word_chars > 10 * n_words or 10 * n_symbols > n_words or 10 * n_dup_lines > 3 * len(lines)
    or 10 * bullets > 9 * len(lines) or 10 * ellipses > 3 * len(lines) or 10 * lettered < 8 * n_words or 10 * marks > n_words
    or 10 * capitals > 4 * letters or contains(lower(text), 'lorem ipsum')) as kept
from judged
"""
