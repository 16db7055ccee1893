"""DuckDB SQL for the training-data queries that SQL can express, by plain definitions over whole tables."""

from __future__ import annotations

from tessella.llm.quality import BOILERPLATE, QualityRules

DECONTAMINATION = r"""
with words as (
  select 'd' as kind, doc_id as id, row_number() over () as rid, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') as ws from documents
  union all
  select 'i', item_id, row_number() over (), regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') from benchmark
),
widths as (select distinct least(5, len(ws)) as w from words where kind = 'i' and len(ws) > 0),
grams as (
  select distinct kind, id, rid, w, array_to_string(ws[k : k + w - 1], ' ') as g
  from (select kind, id, rid, w, ws, unnest(range(1, cast(len(ws) - w + 2 as bigint))) as k from words, widths where kind = 'd' or w = least(5, len(ws)))
),
items as (select id, rid, w, g, count(*) over (partition by rid) as n from grams where kind = 'i'),
met as (
  select d.id as doc_id, d.rid as doc_rid, i.id as item_id, i.rid as item_rid, max(i.n) as n_shingles, count(*) as n_found
  from items i join grams d on d.kind = 'd' and d.w = i.w and d.g = i.g group by 1, 2, 3, 4
)
select doc_id, item_id, n_shingles, n_found, n_found / n_shingles as containment from met where n_found * 5 >= n_shingles * 4
"""

WARC = """
with p as (select page_id, coalesce(html, '') as body, strlen(coalesce(html, '')) as n from pages),
tops as (select body, max(page_id) as top from p where n >= 1000 group by body)
select page_id, n as payload_bytes, sha1(body) as payload_digest,
  case when top is not null and (page_id is null or page_id < top) then 'revisit' else 'response' end as record_type,
  case when top is not null and (page_id is null or page_id < top) then top end as refers_to
from p left join tops using (body)
"""


def quality(rules: QualityRules = QualityRules()) -> str:
    """The measures and the verdict of the line-first rules."""
    space = r"[\x20\x09-\x0D]"
    end = rf"""[.!?…。！？]["'”’»)\]]*({space}|$)""".replace("'", "''")
    boiler = BOILERPLATE.replace("'", "''")
    separators = rf"len(regexp_extract_all(' ' || regexp_replace(line, '{space}+', '  ', 'g') || ' ', ' [|»›•>·]+ '))"
    shouted = rf"len(regexp_extract_all(' ' || regexp_replace(line, '{space}+', '  ', 'g') || ' ', '[!#*$%&]{{2,}} '))"
    words = rf"len(list_filter(regexp_split_to_array({{}}, '{space}+'), lambda x: x <> ''))"
    return rf"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as t from documents),
w as (select rid, doc_id, t, list_filter(regexp_split_to_array(t, '{space}+'), lambda x: x <> '') as ws from d),
spots as (select rid, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] as g from (select rid, ws, unnest(range(1, cast(len(ws) - 1 as bigint))) as k from w)),
twice as (select rid, k from (select rid, k, count(*) over (partition by rid, g) as n from spots) where n > 1),
covered as (select rid, count(distinct k + o) as n from twice, range(3) r(o) group by rid),
lines as (select rid, line from (select rid, unnest(string_split(t, chr(10))) as line from d) where regexp_matches(line, '[^\x20\x09-\x0D]')),
judged as (
  select rid, line, {words.format("line")} as n,
    coalesce(case when {separators} > {words.format("line")} * {rules.max_separators} then true when {shouted} > {words.format("line")} * {rules.max_shouted} then true
      when not regexp_matches(line, '{end}') and ({separators} > 0 or {words.format("line")} >= {rules.min_prose_words}) then true else regexp_matches(line, '{boiler}') end, false) as bad from lines
),
per as (select rid, count(*) - count(distinct line) as n_dup_lines, coalesce(sum(n) filter (bad), 0) as lost_words, count(*) filter (bad) as n_bad_lines from judged group by rid),
m as (
  select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(coalesce(n_dup_lines, 0) as bigint) as n_dup_lines, cast(coalesce(covered.n, 0) as bigint) as n_repeat_words, cast(coalesce(lost_words, 0) as bigint) as lost_words, cast(coalesce(n_bad_lines, 0) as bigint) as n_bad_lines
  from w left join covered using (rid) left join per using (rid)
)
select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed,
  not (n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words) and lost_words <= n_words * {rules.max_lost} as kept from m
"""


REPEATS = """
with d as (select row_number() over () as rid, doc_id, hex(encode(coalesce(text, ''))) as h from documents),
spots as (select rid, k, substr(h, 2 * k + 1, 800) as s from (select rid, h, unnest(range(0, cast(len(h) // 2 - 399 as bigint))) as k from d)),
keyed as (select rid, k, md5_number(s) as s from spots),
hit as (select rid, k from (select rid, k, count(*) over (partition by s) as n from keyed) where n > 1),
runs as (select rid, min(k) as a, max(k) + 400 as b from (select rid, k, sum(fresh) over (partition by rid order by k) as g from
  (select rid, k, case when k - lag(k) over (partition by rid order by k) <= 400 then 0 else 1 end as fresh from hit)) group by rid, g),
gaps as (select rid, lag(b, 1, 0) over (partition by rid order by a) as a, a as b from runs union all select rid, max(b), null from runs group by rid),
left_over as (select rid, string_agg(substr(h, 2 * gaps.a + 1, 2 * (coalesce(gaps.b, len(h) // 2) - gaps.a)), '' order by gaps.a) as kept from gaps join d using (rid) group by rid),
gone as (select rid, sum(b - a) as n_removed, count(*) as n_spans from runs group by rid),
words as (select row_number() over () as rid, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
passages as (select rid, k, md5_number(array_to_string(ws[k : k + 49], ' ')) as s from (select rid, ws, unnest(range(1, cast(len(ws) - 48 as bigint))) as k from words)),
again as (select rid, k, k - lag(k) over (partition by rid order by k) as apart from (select rid, k, count(*) over (partition by s) as n from passages) where n > 1),
told as (select rid, sum(least(coalesce(apart, 50), 50)) as n_passage_words from again group by rid)
select doc_id, cast(len(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when gone.rid is null then h else coalesce(kept, '') end)) as kept_sha256, cast(coalesce(n_passage_words, 0) as bigint) as n_passage_words
from d left join gone using (rid) left join left_over using (rid) left join told using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_decontamination": DECONTAMINATION, "op3_warc_segments": WARC, "op4_line_quality": quality(), "op6_suffix_array": REPEATS}
