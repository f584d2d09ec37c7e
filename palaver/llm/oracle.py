"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from palaver.llm.mixing import MOST_COPIES, SLICE_FACTOR
from palaver.llm.queries import MIX_SEED, URL_RULES
from palaver.llm.url_filter import CANONICAL, HREF, REFRESH, REFRESH_URL, TAG

MIXING = f"""
with docs as (
  select doc_id, source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::bigint as size,
    md5(concat_ws('|', coalesce(doc_id::varchar, ''), coalesce(source, ''), coalesce(text, '')))
      as k
  from documents
), sources as (
  select source, count(*) as n, sum(size)::bigint as source_size,
    row_number() over (order by source nulls last) - 1 as no
  from docs group by source
), limits as (
  select *, (no % 3 + 1)::double as weight, source_size * {MOST_COPIES}::double as most
  from sources
), levels as (
  select *,
    ((sum(source_size) over ())::double - coalesce(sum(most) over before, 0::double))
      / (sum(weight) over () - coalesce(sum(weight) over before, 0::double)) as level
  from limits
  window before as (order by most / weight, no rows between unbounded preceding and 1 preceding)
), targets as (
  select *,
    least(max(case when level * weight <= most then level end) over () * weight, most) as target
  from levels
), rates as (
  select *, case when source_size > 0 then target / source_size else 0::double end as rate,
    ceil(sqrt(n) / {SLICE_FACTOR})::bigint as slices,
    ('0x' || substr(md5('{MIX_SEED}|' || coalesce(source, '')), 1, 8))::bigint
      / 4294967296::double as start_at
  from targets
), sliced as (
  select d.doc_id, d.size, d.k, r.*,
    ('0x' || substr(d.k, 1, 8))::bigint % r.slices as slice
  from docs d join rates r on d.source is not distinct from r.source
), ranked as (
  select s.*, row_number() over (
      partition by no order by slice, case when slice % 2 = 0 then size else -size end, k
    ) as place
  from sliced s
), drawn as (
  select *, least(
      floor(place::double * rate + start_at) - floor((place - 1)::double * rate + start_at),
      ceil(rate))::bigint as copies
  from ranked
)
select doc_id, size, source_size, target, copies, copies * size as taken from drawn
"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _url_filter() -> str:
    rules = ", ".join(f"('{r.verdict}', '{r.host}', '{r.path}')" for r in URL_RULES)
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    host = lower.format("regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1)")
    path = "regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2)"
    query = r"regexp_extract(coalesce(url, ''), '(?s)^[^#?]*(\?[^#]*)', 1)"
    node = f"case when {host} <> '' then {host} || regexp_replace({path}, '/$', '') || {query} end"
    return f"""
with recursive rules(verdict, host, path) as (values {rules}),
parsed as (
  select page_id, url, html, {host} as host, {path} as path, {node} as node from pages
), tags as (
  select node, host, regexp_extract(url, '(?s)^(.*?:)//', 1) as scheme,
    unnest(regexp_extract_all(html, {_quoted(TAG)})) as tag
  from parsed where node is not null
), targets as (
  select node, host, scheme,
    case when regexp_matches(tag, {_quoted(CANONICAL)}) then regexp_extract(tag, {_quoted(HREF)}, 1)
      when regexp_matches(tag, {_quoted(REFRESH)}) then regexp_extract(tag, {_quoted(REFRESH_URL)}, 1)
    end as target
  from tags
), links as (
  select distinct node as source, case when contains(target, '://') then target
    when starts_with(target, '//') then scheme || target
    when starts_with(target, '/') then scheme || '//' || host || target end as url
  from targets
), named as (
  select source, url, {host} as host, {path} as path, {node} as node
  from links where url is not null
), edges as (
  select source as a, node as b from named where node is not null
  union select node, source from named where node is not null
), nodes as (
  select node, host, path from parsed where node is not null
  union select node, host, path from named where node is not null
), reach(a, b) as (
  select node, node from nodes
  union select reach.a, edges.b from reach join edges on reach.b = edges.a
), fits as (
  select n.node, n.host, n.path, r.host || r.path as rule, r.verdict,
    row_number() over (partition by n.node, n.host, n.path
      order by length(r.host || r.path) desc, r.host || r.path) as place
  from nodes n join rules r
    on (n.host = r.host or ends_with(n.host, '.' || r.host)) and starts_with(n.path, r.path)
), decided as (select * from fits where place = 1),
blocked as (
  select reach.a as node from reach join decided on reach.b = decided.node
  group by reach.a having min(verdict) = 'block' and max(verdict) = 'block'
)
select p.page_id, p.host, p.path, d.rule,
  coalesce(d.verdict, case when b.node is not null then 'block' else 'allow' end) as verdict,
  d.rule is null and b.node is not null as by_alias
from parsed p
left join decided d on p.node = d.node and p.host = d.host and p.path = d.path
left join blocked b on p.node = b.node
"""


ORACLE: dict[str, str] = {
    "op4_mixing": MIXING,
    "op9_url_filter": _url_filter(),
}
