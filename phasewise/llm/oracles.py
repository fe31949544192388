"""DuckDB SQL for the subpackage's queries that SQL can express."""

from __future__ import annotations

import string

_LOWER = f"'{string.ascii_uppercase}', '{string.ascii_lowercase}'"
_BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

LINE_DEDUP = f"""
with rows as (
  select doc_id, row_number() over () as r, string_split(coalesce(text, ''), chr(10)) as ls
  from documents),
lines as (
  select r, doc_id, unnest(ls) as line, unnest(range(len(ls))) as pos from rows),
keyed as (
  select *, translate(trim(line, {_BLANKS}), {_LOWER}) as key from lines),
shared as (
  select key, min(doc_id) as first from keyed where length(key) >= 10
  group by key having count(distinct doc_id) >= 2),
judged as (
  select r, k.doc_id, line, pos, coalesce(k.doc_id <> first, false) as gone
  from keyed k left join shared s on k.key = s.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count_if(gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from judged group by r
"""

PREFERENCES = """
with ends as (
  select conv_id, max(turn) as last from conversations where role = 'assistant' group by conv_id),
sides as (
  select conv_id as pair_id, 'chosen' as side, turn, role, text from conversations
  union all
  select c.conv_id, 'rejected', turn, role, text from conversations c join ends using (conv_id)
  where turn < last
  union all
  select c.conv_id - 1, 'rejected', 1099511627776, role, text
  from conversations c join ends using (conv_id)
  where turn = last and role = 'assistant'
    and c.conv_id - 1 in (select conv_id from conversations)),
numbered as (
  select pair_id, side, coalesce(role, '') as role, coalesce(text, '') as text,
    row_number() over (partition by pair_id, side order by turn nulls first,
      coalesce(role, ''), coalesce(text, '')) as n
  from sides where pair_id is not null),
sizes as (
  select pair_id, count_if(side = 'chosen') as c, count_if(side = 'rejected') as r
  from numbered group by pair_id),
differing as (
  select a.pair_id, min(a.n) as n from numbered a join numbered b
  on a.pair_id = b.pair_id and a.n = b.n and a.side = 'chosen' and b.side = 'rejected'
  where a.role <> b.role or a.text <> b.text group by a.pair_id),
common as (
  select pair_id, coalesce(d.n - 1, least(c, r)) as n_common
  from sizes left join differing d using (pair_id)),
rendered as (
  select pair_id, side, n, n > n_common as own, '<|' || role || '|>' || chr(10) as head,
    text || '<|end|>' || chr(10) as body, (role = 'assistant')::int as train, n_common
  from numbered join common using (pair_id)),
masked as (
  select *, length(head) || ':0,' || length(body) || ':' || train as mask from rendered)
select pair_id, any_value(n_common) as n_common,
  coalesce(string_agg(head || body, '' order by n) filter (side = 'chosen' and not own), '') as prompt,
  coalesce(string_agg(head || body, '' order by n) filter (side = 'chosen' and own), '') as chosen,
  coalesce(string_agg(mask, ',' order by n) filter (side = 'chosen' and own), '') as chosen_mask,
  coalesce(string_agg(head || body, '' order by n) filter (side = 'rejected' and own), '') as rejected,
  coalesce(string_agg(mask, ',' order by n) filter (side = 'rejected' and own), '') as rejected_mask
from masked group by pair_id
"""

SHARDING = """
with rows as (
  select row_number() over () as r, doc_id, strlen(coalesce(text, '')) as bytes,
    ('0x' || substr(md5(coalesce(doc_id::varchar, '') || chr(31) || coalesce(text, '')), 1, 15))
      ::bigint as hash
  from documents),
levels as (
  select r, doc_id, bytes, hash, d, hash >> (60 - d) as prefix
  from rows, (select unnest(range(61))::int as d)),
buckets as (
  select d, prefix, sum(bytes)::bigint as shard_bytes, count(*) as shard_docs from levels
  group by d, prefix having sum(bytes) <= 1048576 or min(hash) = max(hash)),
leaves as (
  select r, doc_id, hash, min(l.d) as depth from levels l join buckets b
  on l.d = b.d and l.prefix = b.prefix group by r, doc_id, hash)
select doc_id, case when depth = 0 then '' else lpad(bin(hash >> (60 - depth)), depth, '0') end
  as shard, depth, shard_bytes, shard_docs
from leaves join buckets on d = depth and prefix = hash >> (60 - depth)
"""


_TERMS = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"

LEXICAL_SEARCH = f"""
with docs as (
  select row_number() over () as rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), {_LOWER}), {_TERMS}) as ts
  from documents),
counted as (select rid, doc_id, len(ts)::bigint as n, ts from docs where len(ts) > 0),
totals as (select count(*)::bigint as big_n, sum(n)::bigint as big_l from counted),
tf as (
  select rid, term, count(*)::bigint as tf from (select rid, unnest(ts) as term from counted)
  group by rid, term),
df as (select term, count(*)::bigint as df from tf group by term),
weights as (
  select term, floor(1000 * ln((2.0 * big_n + 2) / (2.0 * df + 1)))::bigint as w
  from df, totals),
asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), {_LOWER}),
    {_TERMS})) as term
  from benchmark),
norms as (select rid, doc_id, 10 + (90 * n * big_n) // big_l as m from counted, totals),
scored as (
  select a.item_id, d.rid, d.doc_id,
    sum(w.w * ((1000000000 * t.tf) // (1000 * t.tf + 8 * d.m)))::bigint as score
  from asked a join weights w using (term) join tf t using (term) join norms d using (rid)
  group by a.item_id, d.rid, d.doc_id),
ranked as (
  select item_id, doc_id, score, row_number() over (partition by item_id
    order by score desc, doc_id asc nulls last, rid) as rank
  from scored where score > 0)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


def llm_oracles() -> dict[str, str]:
    return {
        "op4_preferences": PREFERENCES,
        "op5_line_dedup": LINE_DEDUP,
        "op7_sharding": SHARDING,
        "op13_lexical_search": LEXICAL_SEARCH,
    }
