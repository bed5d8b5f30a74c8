"""DuckDB SQL of the queries that SQL can express, over the same tables."""

from __future__ import annotations

from .mixing import PACKET
from .pii import BASE_PATTERNS, CONTEXT_AFTER, CONTEXT_BEFORE, IBAN_PATTERN, KINDS, MIN_SCORE, OCTETS, SSN_PATTERN

WORDS = r"[^\x20\x09-\x0D]+"

_PATTERNS = BASE_PATTERNS | {"iban": IBAN_PATTERN, "ssn": SSN_PATTERN}

_VALID = {
    "ip": f"regexp_matches(match, '{OCTETS}')",
    "card": """length(digits) between 12 and 19 and list_sum(list_transform(range(1, length(digits) + 1),
        lambda i: case when i % 2 = 1 then cast(digits[-i] as int)
                       when cast(digits[-i] as int) > 4 then 2 * cast(digits[-i] as int) - 9
                       else 2 * cast(digits[-i] as int) end)) % 10 = 0""",
    "phone": "length(digits) between 9 and 15",
    "iban": """length(plain) between 15 and 34 and list_reduce(list_prepend(0, list_transform(string_split(plain[5:] || plain[:4], ''),
        lambda c: case when c >= 'A' then ascii(c) - 55 else ascii(c) - 48 end)),
        lambda a, v: (a * case when v > 9 then 100 else 10 end + v) % 97) = 1""",
}


def _kind_rows(rank: int, name: str) -> str:
    """Rows (rid, rank, kind, start, stop) of confirmed spans of one kind, positions from gap and match lengths."""
    pattern, valid = _PATTERNS[name], _VALID.get(name, "true")
    first = "case when match[1:1] between 'A' and 'Z' then 0 else 1 end" if name == "iban" else "0"
    return f"""
      select rid, {rank} as rank, '{name}' as kind, stop - length(match) + {first} as start, stop from (
        select *, sum(length(gap) + length(match)) over (partition by rid order by i) as stop,
               regexp_replace(match, '[^0-9]', '', 'g') as digits, regexp_replace(match, '[^A-Z0-9]', '', 'g') as plain
        from (select rid, unnest(range(1, len(matches) + 1)) as i, unnest(matches) as match, unnest(gaps[:len(matches)]) as gap
              from (select rid, regexp_extract_all(text, '{pattern}') as matches, string_split_regex(text, '{pattern}') as gaps from d)))
      where {valid}"""


_SCORES = " ".join(
    f"when '{k.name}' then {k.score} + case when regexp_matches(near, '{k.context}') then {k.bonus} else 0.0 end" for k in KINDS
)
_BASE = ", ".join(f"'{k.name}'" for k in KINDS if k.base)
_COUNTS = ", ".join(f"count(*) filter (where kind = '{k.name}') as n_{k.name}" for k in KINDS if k.base)

PII = f"""
with d as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(_kind_rows(i, k.name) for i, k in enumerate(KINDS))}),
seen as (
  select found.*, concat_ws(' ', text[greatest(start - {CONTEXT_BEFORE}, 0) + 1:start], text[stop + 1:stop + {CONTEXT_AFTER}]) as near
  from found join d using (rid)),
kept as (select * from seen where kind in ({_BASE}) or case kind {_SCORES} end >= {MIN_SCORE})
select doc_id, {_COUNTS},
       sha256(coalesce(string_agg(concat_ws(':', kind, start::bigint, stop::bigint), ',' order by start, rank) filter (where kind in ({_BASE})), '')) as base_sha256,
       coalesce(string_agg(concat_ws(':', kind, start::bigint, stop::bigint), ',' order by start, rank), '') as spans
from d left join kept using (rid) group by rid, doc_id
"""

MIX = f"""
with d as (
  select row_number() over () as rid, doc_id, source, md5(coalesce(doc_id::varchar, '')) as key,
         coalesce(len(regexp_extract_all(text, '{WORDS}')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size from d group by source),
ranked as (select *, [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from per),
levelled as (
  select *, ((sum(source_size) over ()) - coalesce(sum(3 * source_size) over (w rows between unbounded preceding and 1 preceding), 0))::double
            / (sum(weight) over (w rows between current row and unbounded following))::double as level
  from ranked window w as (order by (3 * source_size)::double / weight, source nulls last)),
cut as (select coalesce(max(level) filter (where (3 * source_size)::double / weight >= level), 0) as v from levelled),
t as (select source, source_size, weight, least((3 * source_size)::double, weight * v) as target from ranked, cut),
queued as (
  select *, coalesce(sum(size) over (partition by source order by key, doc_id nulls first, size, rid rows between unbounded preceding and 1 preceding), 0)::bigint as before from d),
placed as (select rid, doc_id, q.source, size, source_size, target, weight, before from queued q join t on q.source is not distinct from t.source),
packets as (
  select rid, source, before, copy, first, least({PACKET}, size - first) as words, (before + copy * source_size + first + least({PACKET}, size - first))::double / weight::double as finish
  from (select *, unnest(range(0, size, {PACKET})) as first from placed), (select unnest([0, 1, 2]) as copy)),
served as (
  select rid, greatest(0, least(words, (select sum(size) from d) - coalesce(sum(words) over (order by finish, source nulls last, before, copy, first rows between unbounded preceding and 1 preceding), 0))) as words from packets)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken from placed left join (select rid, sum(words) as taken from served group by rid) using (rid)
"""


TOP_K = """
with v as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::hugeint) as v from embeddings
  where embedding is not null and vec_id is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)),
s as (
  select q.rid, q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])), 0) as score
  from v q join v c on q.vec_id % 20 = 0 and c.rid <> q.rid)
select query_id, rank::int as rank, vec_id, greatest(least(score, 9223372036854775807), -9223372036854775808)::bigint as score
from (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from s) where rank <= 20
"""


_SOUND = "embedding is not null and not list_contains(list_transform(embedding, lambda x: coalesce(isfinite(x), false)), false)"


def _assigned(turn: int) -> str:
    """Each vector's nearest centroid of a round."""
    square = "list_sum(list_transform(list_zip(k.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    return f"a{turn} as materialized (select rid, vec_id, v, near.c as c, near.d as d from (select k.rid, any_value(k.vec_id) as vec_id, any_value(k.v) as v, min({{'d': {square}, 'c': c.c}}) as near from k, c{turn} c group by k.rid))"


def _moved(turn: int) -> str:
    """The centroids of a round: floors of means, or the ones before."""
    return f"""c{turn + 1} as materialized (
  select o.c, coalesce(n.v, o.v) as v from c{turn} o left join (
    select c, list((s - ((s % n) + n) % n) // n order by i) as v
    from (select c, i, sum(x)::bigint as s, count(*) as n from (select c, unnest(v) as x, unnest(range(64)) as i from a{turn}) group by c, i) group by c) n using (c))"""


KMEANS = f"""
with k as materialized (select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings where len(embedding) = 64 and {_SOUND}),
c0 as materialized (
  select (row_number() over (order by h, vec_id, v) - 1)::int as c, v from (select sha256('1:' || vec_id) as h, vec_id, v from k order by h, vec_id, v limit 16)),
{", ".join(f"{_assigned(t)}, {_moved(t)}" for t in range(3))}, {_assigned(3)}
select vec_id, c as cluster, d::bigint as distance, (sum(d) over (partition by c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, sha256(array_to_string(c3.v, ',')) as centroid_sha256
from a3 join c3 using (c)
"""

METRIC_JOIN = f"""
with recursive v as materialized (select row_number() over () as rid, vec_id, label, embedding::double[] as e, label is not null and vec_id is not null and {_SOUND} and list_max(list_transform(embedding, lambda x: abs(x))) > 0 as sound from embeddings),
links as materialized (
  select a.rid as a, b.rid as b, b.vec_id as other from v a join v b on a.label = b.label and a.rid <> b.rid and a.sound and b.sound and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.98),
reached(a, b) as (select rid, rid from v union select reached.a, links.b from reached join links on reached.b = links.a),
parts as (select reached.a as rid, min(v.vec_id) as component_id from reached join v on v.rid = reached.b group by 1)
select v.vec_id, (select count(*) from links where links.a = v.rid) as n_links, component_id, coalesce(v.vec_id = component_id, true) as kept from v join parts using (rid)
"""

HARD_NEGATIVES = f"""
with v as materialized (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::hugeint) as v
  from embeddings where label is not null and vec_id is not null and {_SOUND}),
s as materialized (
  select a.rid, a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))), 0)::hugeint as score
  from v a join v b on a.vec_id % 100 = 0 and a.rid <> b.rid),
p as (select *, row_number() over (partition by rid order by score desc, vec_id) as slot from s where same qualify slot <= 5)
select p.anchor_id, p.vec_id as positive_id, (row_number() over w)::int as rank, n.vec_id as negative_id, p.score::bigint as positive_score, n.score::bigint as negative_score
from p join s n on p.rid = n.rid and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
window w as (partition by p.rid, p.slot order by n.score desc, n.vec_id) qualify rank <= 5
"""

SUBSTRINGS = f"""
with d as materialized (select row_number() over () as rid, doc_id, regexp_extract_all(coalesce(text, ''), '{WORDS}') as w from documents),
g as materialized (select rid, doc_id, i, array_to_string(w[i:i + 49], ' ') as run from (select *, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
hits as (select g.rid, g.i from g join (select run, min(doc_id) as first from g group by run) using (run) where g.doc_id > first),
gone as materialized (select distinct rid, unnest(range(i, i + 50)) as p from hits),
kept as (select d.rid, string_agg(d.word, ' ' order by d.p) as text from (select rid, unnest(w) as word, unnest(range(1, len(w) + 1)) as p from d) d anti join gone using (rid, p) group by d.rid)
select doc_id, len(w) as n_words, (select count(*) from gone where gone.rid = d.rid) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept using (rid)
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substrings": SUBSTRINGS, "op5_topk": TOP_K, "op8_pii": PII, "op9_mix": MIX, "op11_ballkmeans": KMEANS, "op12_metricjoin": METRIC_JOIN, "op13_hardnegatives": HARD_NEGATIVES}
