"""DuckDB SQL of the queries that SQL can say, other than by the way they work in Spark."""

from __future__ import annotations


def crc_table() -> list[int]:
    """The 256 remainders of the reflected polynomial 0xEDB88320."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of an ASCII text."""
    return (
        f"xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({text}, ''), lambda c: ascii(c)::bigint)), "
        f"lambda a, b: xor(a >> 8, ({crc_table()}::bigint[])[(xor(a, b) & 255) + 1])), 4294967295)"
    )


def encoded(*values: str) -> str:
    """SQL for the values one after another, '-' or byte count, ':' and value each."""
    return " || ".join(f"case when {v} is null then '-' else strlen(({v})::varchar)::varchar || ':' || ({v})::varchar end" for v in values)


#: op11: trees as lists, level by level; each leaf's siblings by the bits of its place; folds as list_reduce.
OP11_SQL = f"""
with recursive rows as (
  select doc_id, lang, sha256({encoded("doc_id", "source", "lang", "n_chars", "text")}) as leaf,
    coalesce({crc32("doc_id::varchar")} % 7 = 0 and n_chars is not null, false) as tampered,
    sha256({encoded("doc_id", "source", "lang", "n_chars + 1", "text")}) as altered from documents),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from rows),
trees as (
  select lang, 0 as level, list(leaf order by i) as nodes from placed group by lang
  union all
  select lang, level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], ''))) from trees where len(nodes) > 1),
subroots as (select lang, nodes[1] as subroot, row_number() over (order by lang nulls first) - 1 as i from trees where len(nodes) = 1),
over_trees as (
  select 0 as level, list(subroot order by i) as nodes from subroots
  union all
  select level + 1, list_transform(range(0, len(nodes), 2), lambda k: sha256(nodes[k + 1] || coalesce(nodes[k + 2], ''))) from over_trees where len(nodes) > 1),
nodes as (select lang, level, unnest(nodes) as h, unnest(range(0, len(nodes))) as i from trees where len(nodes) > 1),
over_nodes as (select level, unnest(nodes) as h, unnest(range(0, len(nodes))) as i from over_trees where len(nodes) > 1),
sides as (
  select p.doc_id, p.leaf, p.lang, p.i, list(case when n.h is null then 'N' when (p.i >> t.level) & 1 = 1 then 'L' || n.h else 'R' || n.h end order by t.level) as path
  from placed p join (select distinct lang, level from nodes) t on t.lang is not distinct from p.lang
  left join nodes n on n.lang is not distinct from p.lang and n.level = t.level and n.i = xor(p.i >> t.level, 1) group by all),
over_sides as (
  select s.lang, s.subroot, list(case when n.h is null then 'N' when (s.i >> t.level) & 1 = 1 then 'L' || n.h else 'R' || n.h end order by t.level) as path
  from subroots s join (select distinct level from over_nodes) t on true left join over_nodes n on n.level = t.level and n.i = xor(s.i >> t.level, 1) group by all),
proofs as (
  select p.doc_id, p.leaf, s.subroot, (select nodes[1] from over_trees where len(nodes) = 1) as root, if(p.tampered, p.altered, p.leaf) as now,
    list_concat(coalesce(a.path, []), coalesce(o.path, [])) as path
  from placed p join subroots s on s.lang is not distinct from p.lang
  left join sides a on a.i = p.i and a.lang is not distinct from p.lang left join over_sides o on o.lang is not distinct from p.lang),
folded as (
  select *, list_reduce(list_prepend('N' || now, path), lambda a, s: 'N' || sha256(case s[1] when 'L' then s[2:] || a[2:] when 'R' then a[2:] || s[2:] else a[2:] end))[2:] as folded_root from proofs)
select doc_id, leaf, subroot, root, sha256(list_aggregate(list_transform(path, lambda s: s[2:]), 'string_agg', '')) as proof_sha256, folded_root, folded_root = root as verified from folded
"""

_FATE = crc32("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")
#: op12: forwards over the rows, the least (cost, edits) for each state, with what has been said so far.
OP12_SQL = f"""
with recursive fated as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, {_FATE} % 20 as fate from conversations),
live as (
  select conv_id, turn, if(fate = 4, 'user', role) as role, case fate when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select unnest(range(if(fate = 3, 2, 1))), * from fated where fate <> 0)),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from live),
faulty as (
  select *, row_number() over (partition by conv_id, role, text order by i) > 1 as again, regexp_extract(text, '([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*$', 1) as last,
    greatest(1, coalesce(nullif(instr('sua', role[1]), 0), 4)) as initial, lead(role[1]) over (partition by conv_id order by i) as follows from numbered),
marked as (select *, last = '' as blank, last <> '' and again as duplicate, last not in ('', '.', '!', '?') and not again as truncated from faulty),
chains(st, letters, price, leads, says) as (values
  (0, '', 0, 0, []), (0, 'I', 5, 2, ['user:']), (0, 'II', 10, 3, ['user:', 'assistant:']), (1, '', 0, 1, []), (1, 'I', 5, 2, ['user:']), (1, 'II', 10, 3, ['user:', 'assistant:']),
  (2, '', 0, 2, []), (2, 'I', 5, 3, ['assistant:']), (2, 'II', 10, 2, ['assistant:', 'user:']), (3, '', 0, 3, []), (3, 'I', 5, 2, ['user:']), (3, 'II', 10, 3, ['user:', 'assistant:'])),
moves(st, letter, initial, leads, price) as (values
  (0, 'K', 1, 1, 0), (0, 'K', 2, 2, 0), (1, 'K', 2, 2, 0), (2, 'K', 3, 3, 0), (3, 'K', 2, 2, 0), (0, 'R', null, 2, 1), (1, 'R', null, 2, 1), (2, 'R', null, 3, 1), (3, 'R', null, 2, 1),
  (0, 'D', null, 0, 2), (1, 'D', null, 1, 2), (2, 'D', null, 2, 2), (3, 'D', null, 3, 2)),
best as (
  select conv_id, 0::bigint as i, 0 as st, '000000' as edits, []::varchar[] as says from (select distinct conv_id from fated)
  union all
  select conv_id, i, st, min(edits), arg_min(says, edits) from (
    select b.conv_id, m.i, v.leads as st, lpad((b.edits[1:6]::bigint + c.price + v.price + if(v.letter <> 'D' and m.truncated, 5, 0))::varchar, 6, '0') || b.edits[7:] || c.letters || v.letter as edits,
      list_concat(list_concat(b.says, c.says), case v.letter when 'K' then [m.role || ':' || m.text] when 'R' then [if(v.leads = 2, 'user:', 'assistant:') || m.text] else [] end) as says
    from best b join marked m on m.conv_id is not distinct from b.conv_id and m.i = b.i + 1 join chains c on c.st = b.st
    join moves v on v.st = c.leads and (v.initial is null or v.initial = m.initial) and (v.letter = 'D' or not (m.blank or m.duplicate))) group by conv_id, i, st),
ended as (
  select b.conv_id, min(lpad((b.edits[1:6]::bigint + c.price)::varchar, 6, '0') || b.edits[7:] || c.letters) as edits,
    arg_min(list_concat(b.says, c.says), lpad((b.edits[1:6]::bigint + c.price)::varchar, 6, '0') || b.edits[7:] || c.letters) as says
  from best b join chains c on c.st = b.st and c.leads in (0, 3)
  where b.i = (select count(*) from marked m where m.conv_id is not distinct from b.conv_id) group by b.conv_id),
counted as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (duplicate) as duplicate, count(*) filter (truncated) as truncated,
    count(*) filter (follows is not null and role[1] || follows not in ('su', 'ua', 'au')) as illegal from marked group by conv_id)
select e.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  e.edits[1:6]::bigint as cost, e.edits[7:] as audit, sha256(coalesce(list_aggregate(says, 'string_agg', chr(10)), '')) as repaired_sha256
from ended e left join counted c on c.conv_id is not distinct from e.conv_id
"""

#: op13, for tables whose pages name their article and nest no element in it but inline ones and paragraphs.
OP13_SQL = """
with article as (select page_id, url, coalesce(regexp_extract(html, '<article>(.*?)</article>', 1, 's'), '') as body from pages),
plain as (select page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') as body from article),
decoded as (select page_id, url, trim(regexp_replace(replace(replace(replace(replace(replace(replace(body, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) as text from plain)
select page_id, url, text, length(text) as n_chars from decoded
"""
