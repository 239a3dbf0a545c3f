"""SQL counterparts of the corpus queries that SQL can express, for DuckDB.

They are written from the contracts, not from the operators: rows are unfolded into words, windows and
matches and joined. That costs far more than the operators do and is meant for small tables.
"""

from __future__ import annotations

from tallyscope.llm.fill_in_middle import SQL as FILL_IN_MIDDLE
from tallyscope.llm.quality_rules import STOP_WORDS
from tallyscope.llm.secrets import ACCESS, ASSIGN, ENDPOINT, HEX, IDENT, SCOPE, SECRET


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _secret_scan() -> str:
    """Every kind's matches with places from running sums; weak parts join all parts of their scope."""
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "ident": IDENT, "endpoint": ENDPOINT, "secret": SECRET, "scope": SCOPE}
    cuts = " union all ".join(
        f"select r, {n} as k, '{kind}' as kind, regexp_extract_all(text, {_text(p)}) as ms, "
        f"regexp_split_to_array(text, {_text(p)}) as gaps from t"
        for n, (kind, p) in enumerate(patterns.items())
    )
    return f"""
with t as (select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
cuts as ({cuts}),
matches as (select r, k, kind, unnest(range(1, len(ms) + 1)) as i, ms, gaps from cuts),
lengths as (select r, k, kind, i, ms[i] as m, length(ms[i]) as n, length(gaps[i]) as gap from matches),
placed as (
  select r, k, kind, m, n, (sum(gap + n) over (partition by r, k order by i))::bigint as stop from lengths),
part as (
  select r, k, kind, stop - n as start, stop from placed
  where case kind when 'assign' then length(regexp_extract(m, {_text(ASSIGN)}, 1)) >= 8
                  when 'access' then n >= 16
                  when 'secret' then regexp_matches(m, '[0-9]') and regexp_matches(m, '[A-Za-z]')
                  else true end),
base as (select * from part where kind in ('assign', 'access', 'hex')),
scoped as (
  select *, count(*) filter (kind = 'scope') over (partition by r order by start, k, stop rows unbounded preceding) as scope from part),
weak as (
  select w.* from scoped w where w.kind in ('ident', 'endpoint', 'secret')
    and not exists (select 1 from base b where b.r = w.r and b.start < w.stop and b.stop > w.start)),
linked as (
  select distinct w.r, w.k, w.kind, w.start, w.stop from weak w join scoped c on c.r = w.r and c.scope = w.scope
    and (c.stop <= w.start or c.start >= w.stop) and (
      (w.kind = 'secret' and c.kind in ('access', 'ident', 'endpoint'))
      or (w.kind in ('ident', 'endpoint') and c.kind in ('assign', 'hex', 'secret')))),
spans as (select r, k, kind, start, stop from base union all select r, k, kind, start, stop from linked),
sums as (
  select r, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access,
    count(*) filter (kind = 'hex') as n_hex,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, k, stop) filter (k < 3) as base,
    string_agg(kind || ':' || start || ':' || stop, ',' order by start, k, stop) as spans
  from spans group by r)
select t.doc_id, coalesce(n_assign, 0) as n_assign, coalesce(n_access, 0) as n_access, coalesce(n_hex, 0) as n_hex,
  sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join sums using (r)"""


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATE = f"""
with d as (
  select row_number() over () as r, doc_id, {_LOWER} as text from documents),
dw as (select r, regexp_extract_all(text, '{WORD}') as words, regexp_split_to_array(text, '{WORD}') as gaps from d),
word as (select r, unnest(range(1, len(words) + 1)) as i, words, gaps from dw),
place as (
  select r, i, (sum(length(gaps[i]) + length(words[i])) over (partition by r order by i))::bigint as stop,
    length(words[i]) as n from word),
iw as (select item_id::varchar as item_id, regexp_extract_all({_LOWER}, '{WORD}') as words from benchmark),
win as (
  select distinct item_id, least(len(words), 10) as l, array_to_string(words[i:i + least(len(words), 10) - 1], ' ') as g
  from (select *, unnest(range(1, greatest(len(words) - 9, 1) + 1)) as i from iw where len(words) > 0)),
sizes as (select distinct l from win),
gram as (
  select r, l, i, array_to_string(words[i:i + l - 1], ' ') as g
  from (select r, words, l, unnest(range(1, len(words) - l + 2)) as i from dw cross join sizes where len(words) >= l)),
occurs as (select r, gram.l, i, item_id from gram join win using (l, g)),
hit as (select distinct r, unnest(range(i, i + l)) as i from (select distinct r, l, i from occurs)),
island as (select r, i, i - row_number() over (partition by r order by i) as run from hit),
span as (
  select r, min(stop - n) as start, max(stop) as stop from island join place using (r, i) group by r, run),
spans as (select r, string_agg(start || ':' || stop, ',' order by start) as spans from span group by r),
n_hits as (select r, count(*) as n_hit from hit group by r),
items as (
  select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as items
  from (select distinct r, item_id from occurs where item_id is not null) group by r)
select doc_id, len(words)::bigint as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
  coalesce(items, '') as items, coalesce(spans, '') as spans
from d join dw using (r) left join n_hits using (r) left join items using (r) left join spans using (r)"""


QUALITY_RULES = rf"""
with t as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text from documents),
w as (
  select r, doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines,
    length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as n_symbols,
    strlen(text) * 2 <= length(text) * 3 as is_latin
  from t),
tri as (
  select r, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] as g
  from (select r, words, unnest(range(1, len(words) - 1)) as i from w)),
often as (select r, i from (select r, i, count(*) over (partition by r, g) as n from tri) where n > 1),
covered as (select r, count(distinct j) as n_repeat_words from (select r, unnest([i, i + 1, i + 2]) as j from often) group by r),
n as (
  select r, doc_id, len(words)::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, is_latin,
    len(lines)::bigint as n_lines, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
    len(list_filter(words, lambda x: lower(x) in ({", ".join(map(_text, dict.fromkeys(STOP_WORDS)))})))::bigint as n_stop_words
  from w left join covered using (r)),
judged as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
    concat_ws(',',
      case when word_chars / greatest(n_words, 1) not between 1.5 and 20 then 'mean_word_chars' end,
      case when n_symbols / greatest(n_words, 1) > 0.5 then 'symbols_per_word' end,
      case when n_dup_lines / greatest(n_lines, 1) > 0.5 then 'dup_line_share' end,
      case when is_latin and n_stop_words / greatest(n_words, 1) < 0.01 then 'stop_word_share' end) as broken_rules
  from n)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and broken_rules = '' as kept, n_stop_words, broken_rules
from judged"""

SQL = {"op2_secret_scan": _secret_scan(), "op7_decontaminate": DECONTAMINATE, "op9_quality_rules": QUALITY_RULES, "op11_fill_in_middle": FILL_IN_MIDDLE}
