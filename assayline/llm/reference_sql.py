"""DuckDB SQL for the queries of this package that SQL can express."""

from __future__ import annotations

from assayline.llm import secret_scan

WORD = r"[^\x20\x09-\x0D]+"

MIXING = rf"""
with rows as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size,
    substr(md5(coalesce(doc_id::varchar, '') || ':mix'), 1, 16) as key
  from documents),
sources as (select source, sum(size)::bigint as source_size from rows group by source),
weighed as (
  select *, list_extract([3, 1, 2], (((row_number() over (order by source nulls last)) - 1) % 3 + 1)::int) as weight,
    2 * source_size as cap
  from sources),
levels as (
  select *, cap / weight as ratio,
    (sum(source_size) over () * 1.5::double
      - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by cap / weight, source nulls last rows between current row and unbounded following) as level
  from weighed),
final as (select min_by(level, ratio) as level from levels where level * weight <= cap),
targets as (
  select l.source, l.source_size, least(l.cap::double, coalesce(f.level * l.weight, l.cap::double)) as target
  from levels l, final f),
placed as (
  select r.*, t.source_size, t.target,
    sum(r.size) over (partition by r.source order by r.key, r.doc_id, r.size rows unbounded preceding) as reached,
    case when t.source_size > 0 then floor(t.target / t.source_size)::bigint else 0 end as epochs
  from rows r join targets t on r.source is not distinct from t.source),
counted as (
  select *, least(epochs + case when target - epochs * source_size > 0 and reached - size / 2 <= target - epochs * source_size
    then 1 else 0 end, 2)::bigint as copies
  from placed)
select doc_id, size, source_size, target, (copies * size)::bigint as taken, copies from counted
"""

TOP_K = """
with vectors as (
  select vec_id, [floor(256 * x::double) for x in embedding] as v
  from embeddings
  where vec_id is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
scored as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score
  from vectors q join vectors c on q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""



def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def secrets() -> str:
    """Rules by their patterns, windows one by one."""
    patterns = (secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.CANDIDATE)
    group = {0: 2}
    found = " union all ".join(
        f"select id, {i} as place, string_split_regex(text, {_text(p)}) as parts, regexp_extract_all(text, {_text(p)}) as found, "
        f"regexp_extract_all(text, {_text(p)}, {group.get(i, 0)}) as val from docs"
        for i, p in enumerate(patterns)
    )
    width = secret_scan.WINDOW
    harmless = "|".join(f"(?:{a})" for a in secret_scan.ALLOWED).replace("*+", "*")
    most = [secret_scan.highest_sum(width, b) for b in (secret_scan.HEX_BITS, secret_scan.MIXED_BITS)]
    kinds = [*secret_scan.BASE_KINDS, *secret_scan.ENTROPY_KINDS]
    spans = "coalesce(string_agg(kind || ':' || first || ':' || past, ',' order by first, place, past)"
    return f"""
with docs as (select row_number() over () as id, doc_id, coalesce(text, '') as text from documents),
lists as ({found}),
placed as (
  select id, place, val, found, sum(length(part) + length(found)) over (partition by id, place order by k) as past
  from (
    select id, place, unnest(val) as val, unnest(found) as found, unnest(parts) as part, generate_subscripts(parts, 1) as k
    from lists)
  where found is not null),
base as (
  select id, place, past - length(found) as first, past from placed
  where place < 3 and (place > 0 or length(val) >= {secret_scan.VALUE_LENGTH})),
candidates as (
  select id, past - length(found) as start, found,
    case when regexp_full_match(found, '[0-9A-Fa-f]+') then 0 else 1 end as mixed
  from placed where place = 3 and not regexp_full_match(found, {_text(harmless)})),
windows as (
  select *, substring(found, w + 1, {width}) as part
  from (select *, unnest(range(0, length(found) - {width - 1})) as w from candidates)),
high as (
  select id, start, mixed, w from windows
  where list_sum([{list(secret_scan.weights(width))}[n::int + 1] for n in
      map_values(list_aggregate(string_split(part, ''), 'histogram'))])
    <= {most}[mixed + 1]),
marked as (
  select *, case when w <= lag(w) over (partition by id, start order by w) + {width} then 0 else 1 end as opens from high),
islands as (select *, sum(opens) over (partition by id, start order by w) as island from marked),
added as (
  select id, 3 + mixed as place, start + min(w) as first, start + max(w) + {width} as past
  from islands group by id, start, mixed, island),
spans as (
  select *, {kinds}[place + 1] as kind from (select * from base union all select * from added)),
joined as (
  select id, count(*) filter (place = 0) as n_assign, count(*) filter (place = 1) as n_access, count(*) filter (place = 2) as n_hex,
    {spans} filter (place < 3), '') as base, {spans}, '') as spans
  from spans group by id)
select doc_id, coalesce(n_assign, 0)::bigint as n_assign, coalesce(n_access, 0)::bigint as n_access,
  coalesce(n_hex, 0)::bigint as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from docs left join joined using (id)
"""


ORACLE_SQL: dict[str, str] = {"op5_mixing": MIXING, "op8_top_k": TOP_K, "op13_secret_scan": secrets()}
