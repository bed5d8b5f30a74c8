"""DuckDB SQL of every registered event query, in forms of its own."""

from __future__ import annotations

from .. import constants as C
from . import standins as S
from .queries import FIRST_MATCHES, FOCUS_CAUSE, FOCUS_MAP, MIN_WEAPON_EVENTS


def _rows(name: str, text: str) -> str:
    return f"{name} as ({text})"


_LISTED = f"""{_rows('r', S.SAMPLES)}, i as (select *, unnest(range(json_array_length(value, '$.data.relationships.matches.data')::bigint))::int as position from r),
  m as (select window_name, position, json_extract_string(value, '$.data.relationships.matches.data[' || position || '].id') as match_id from i), l as (select * from m where match_id <> '')"""


def _csv_profile(quantity: str) -> str:
    filled = "count(try_cast(part_id as bigint)) as filled_part_id, max(try_cast(part_id as bigint)) as most_part_id, count(try_cast(quantity as {0})) as filled_quantity, max(try_cast(quantity as {0})) as most_quantity, count(shipped) as filled_shipped, max(shipped) as most_shipped"
    return f"with {_rows('r', S.CSV_ROWS)} select file as folder, count(*) as row_count, {filled.format(quantity)} from r group by 1"


_E, _D, _A = _rows("e", S.EVENTS), _rows("d", S.DEATHS), _rows("a", S.AGGREGATE)


def _cells(size: int) -> str:
    return f"""select map, killed_by, floor(victim_position_x / {size * 100})::int as grid_x, floor(victim_position_y / {size * 100})::int as grid_y,
      count(*) as n, count(distinct match_id) as m, count(distinct date) as t, min(date) as t0, max(date) as t1 from e group by all"""


def _grid(size: int) -> str:
    return f"""select map, killed_by, {size} as grid_size_m, grid_x, grid_y, grid_x * {size} as grid_min_x_m, least((grid_x + 1) * {size}, 8160) as grid_max_x_m,
      grid_y * {size} as grid_min_y_m, least((grid_y + 1) * {size}, 8160) as grid_max_y_m, n as death_count, m as distinct_match_count, t as distinct_date_count, t0 as first_death_date, t1 as last_death_date,
      round(n::double / nullif(m, 0), 4) as deaths_per_match, round(n::double / sum(n) over (partition by map, killed_by) * 100, 4) as death_share_pct,
      dense_rank() over (partition by map, killed_by order by m desc, t desc, n desc)::int as hotspot_candidate_rank
    from ({_cells(size)}) qualify hotspot_candidate_rank <= 10"""


def _ranked(size: int, rank: str) -> str:
    return f"select *, sum(n) over (partition by map, killed_by) as total, row_number() over (partition by map, killed_by order by n desc, m desc, grid_x, grid_y)::int as {rank} from ({_cells(size)})"


_KM = "concat('X ', round(grid_min_x_m / 1000.0, 2), '~', round(grid_max_x_m / 1000.0, 2), 'km, Y ', round(grid_min_y_m / 1000.0, 2), '~', round(grid_max_y_m / 1000.0, 2), 'km')"
_SAID = "death_count, '건, ', distinct_match_count, '개 경기, ', distinct_date_count, '개 날짜에서 관측, 원인 내 비중 ', round(death_share_pct, 2), '%. '"

REPORT = f"""with {_E}, g as ({_grid(250)})
select concat(map, '-', killed_by, '-G', grid_x, '-', grid_y) as candidate_id, map as map_name_ko, killed_by as death_cause_ko, {_KM} as coordinate_range_km, death_count, distinct_match_count, distinct_date_count,
  first_death_date as observed_from, last_death_date as observed_to, deaths_per_match as deaths_per_affected_match, death_share_pct, hotspot_candidate_rank as candidate_rank,
  concat(map, ' ', killed_by, ' ', hotspot_candidate_rank, '순위 후보(', {_KM}, '): ', {_SAID}, '100m 상세 분석 후보.') as report_summary, map, killed_by, grid_x, grid_y from g"""

COMPARISON = f"""with {_E}, f as ({_grid(100)}), c as ({_grid(250)}),
o as (
  select f.map, f.killed_by, f.grid_x, f.grid_y, c.grid_x as cx, c.grid_y as cy, c.hotspot_candidate_rank as cr,
    ((least(f.grid_max_x_m, c.grid_max_x_m) - greatest(f.grid_min_x_m, c.grid_min_x_m)) * (least(f.grid_max_y_m, c.grid_max_y_m) - greatest(f.grid_min_y_m, c.grid_min_y_m)))::double as area
  from f join c on f.map = c.map and f.killed_by = c.killed_by and f.grid_min_x_m < c.grid_max_x_m and f.grid_max_x_m > c.grid_min_x_m and f.grid_min_y_m < c.grid_max_y_m and f.grid_max_y_m > c.grid_min_y_m
  qualify row_number() over (partition by f.map, f.killed_by, f.grid_x, f.grid_y order by area desc, cr, cx, cy) = 1),
j as (select f.*, cx, cy, cr, round(area / nullif((grid_max_x_m - grid_min_x_m) * (grid_max_y_m - grid_min_y_m), 0) * 100, 2) as pct from f left join o using (map, killed_by, grid_x, grid_y))
select concat(map, '-', killed_by, '-100-G', grid_x, '-', grid_y) as candidate_id_100m, map as map_name_ko, killed_by as death_cause_ko, {_KM} as coordinate_range_100m, death_count, distinct_match_count, distinct_date_count,
  first_death_date as observed_from, last_death_date as observed_to, deaths_per_match as deaths_per_affected_match, death_share_pct, hotspot_candidate_rank as candidate_rank_100m, grid_x as grid_x_100m, grid_y as grid_y_100m,
  cx as grid_250_x, cy as grid_250_y, cr as candidate_rank_250m, pct as overlap_with_250m_pct,
  case when cr <= 3 then '250m 우선 후보와 일치' when cr <= 10 then '250m 상위 후보와 일치' else '100m 신규 후보' end as resolution_status,
  concat(map, ' ', killed_by, ' 100m ', hotspot_candidate_rank, '순위 후보(', {_KM}, '): ', {_SAID}, case when cr is null then '250m 상위 10순위와 겹치지 않는 신규 후보.' else concat('250m ', cr, '순위 후보와 ', pct, '% 겹침.') end) as report_summary,
  map, killed_by from j"""

PARENTS = f"""with {_E}, k as ({" union all ".join(f"select {m} as size, map, killed_by, grid_x as x, grid_y as y, n, grid_x * {m} as x0, least((grid_x + 1) * {m}, 8160) as x1, grid_y * {m} as y0, least((grid_y + 1) * {m}, 8160) as y1 from ({_cells(m)})" for m in (100, 250, 500))}),
o as (
  select f.map, f.killed_by, f.x as grid_x, f.y as grid_y, f.n as fn, (f.x1 - f.x0) * (f.y1 - f.y0) as own, c.size as parent_size_m, c.x as parent_x, c.y as parent_y, c.n as cn, ((least(f.x1, c.x1) - greatest(f.x0, c.x0)) * (least(f.y1, c.y1) - greatest(f.y0, c.y0)))::double as area
  from k f join k c on f.size = 100 and c.size > 100 and f.map = c.map and f.killed_by = c.killed_by and f.x0 < c.x1 and f.x1 > c.x0 and f.y0 < c.y1 and f.y1 > c.y0)
select map, killed_by, grid_x, grid_y, parent_size_m, count(*) over w as overlapped, parent_x, parent_y, round(area / own * 100, 2) as overlap_pct, round(sum(area) over w / own * 100, 2) as covered_pct, round(fn::double / cn * 100, 2) as parent_death_share_pct
from o window w as (partition by map, killed_by, grid_x, grid_y, parent_size_m) qualify row_number() over (partition by map, killed_by, grid_x, grid_y, parent_size_m order by area desc, cn desc, parent_x, parent_y) = 1"""

LIFT = f"""with {_E}, k as (select * from ({_ranked(100, 'count_rank')}) where map = '{FOCUS_MAP}' and killed_by = '{FOCUS_CAUSE}' and count_rank = 2),
p as (select e.*, floor(victim_position_x / 10000) - k.grid_x as dx, floor(victim_position_y / 10000) - k.grid_y as dy, e.killed_by = k.killed_by as same, e.map = k.map as here from e, k),
r as (select count(*) as all_rows, count(*) filter (killed_by in ('F', 'O')) as causes, count(*) filter (here and dx = 0 and dy = 0) as cell_n, count(*) filter (here and dx = 0 and dy = 0 and same) as cell_c,
  count(*) filter (here and abs(dx) <= 1 and abs(dy) <= 1 and not (dx = 0 and dy = 0)) as ring_n, count(*) filter (here and same and abs(dx) <= 1 and abs(dy) <= 1 and not (dx = 0 and dy = 0)) as ring_c from p),
t as (select max(n) as one, sum(n) as three from (select count(*) as n from p where here and same and dx = 0 and dy = 0 group by floor(victim_position_x / 1000), floor(victim_position_y / 1000) order by n desc limit 3))
select map, killed_by, count_rank, grid_x, grid_y, n as death_count, m as match_count, k.t as date_count, all_rows as raw_input_rows, causes as raw_environmental_rows, (select count(*) from e) as final_analysis_rows,
  cell_n as cell_all_death_count, round(cell_c::double / nullif(cell_n, 0) * 100, 2) as cell_cause_share_pct, ring_n as neighbor_all_death_count, ring_c as neighbor_cause_death_count, round(ring_c::double / nullif(ring_n, 0) * 100, 2) as neighbor_cause_share_pct,
  round(cell_c::double / nullif(cell_n, 0) / nullif(ring_c::double / nullif(ring_n, 0), 0), 2) as neighbor_lift, one as top_detail_death_count, round(one::double / nullif(n, 0) * 100, 2) as top_detail_share_pct, round(three::double / nullif(n, 0) * 100, 2) as top_three_detail_share_pct
from k, r, t"""

DETAIL = f"""with {_E}, p as (select * from ({_ranked(100, 'parent_rank')}) where parent_rank <= 3),
x as (select e.map, e.killed_by, parent_rank, p.grid_x as parent_grid_x, p.grid_y as parent_grid_y, floor(victim_position_x / 1000)::int as detail_grid_x, floor(victim_position_y / 1000)::int as detail_grid_y,
  count(*) as death_count, count(distinct match_id) as match_count, count(distinct date) as date_count, p.n as total
  from e join p on e.map = p.map and e.killed_by = p.killed_by and floor(victim_position_x / 10000) = p.grid_x and floor(victim_position_y / 10000) = p.grid_y group by all)
select * exclude (total), 10 as grid_size_m, round(death_count::double / total * 100, 4) as parent_share_pct, row_number() over (partition by map, killed_by, parent_rank order by death_count desc, match_count desc, detail_grid_x, detail_grid_y)::int as detail_rank from x"""

_CLASSES = " ".join(f"when killed_by in ({', '.join(repr(w) for w in ws)}) then '{c}'" for c, ws in C.WEAPON_CLASSES.items())
_PROFILES = f"""{_D}, v as (
  select upper(trim(map)) as map, killed_by, case {_CLASSES} end as weapon_class, sqrt((killer_position_x - victim_position_x) ** 2 + (killer_position_y - victim_position_y) ** 2) / 100 as m from d
  where upper(trim(map)) in ('ERANGEL', 'MIRAMAR') and killer_name <> victim_name and killer_position_x between 0 and 816000 and killer_position_y between 0 and 816000 and victim_position_x between 0 and 816000 and victim_position_y between 0 and 816000
    and not (killer_position_x = 0 and killer_position_y = 0) and not (victim_position_x = 0 and victim_position_y = 0)),
w as (select * from v where weapon_class is not null and m between 0 and 2000),
g as (
  select case when grouping(map) = 1 then 'ALL' else map end as scope, weapon_class, killed_by, count(*) as event_count, grouping(killed_by) as whole,
    round(quantile_cont(m, 0.5), 1) as median_distance_m, round(quantile_cont(m, 0.75), 1) as p75_distance_m, round(quantile_cont(m, 0.9), 1) as p90_distance_m, round(quantile_cont(m, 0.99), 1) as p99_distance_m,
    round(count(*) filter (m >= 100)::double / count(*) * 100, 2) as share_above_100m_pct, round(count(*) filter (m >= 300)::double / count(*) * 100, 2) as share_above_300m_pct
  from w group by grouping sets ((map, weapon_class, killed_by), (weapon_class, killed_by), (map, weapon_class), (weapon_class))),
f as (select * exclude (whole), (select count(*) from w) as valid_event_count from g where whole = 1 or event_count >= {MIN_WEAPON_EVENTS})"""
_GAPS = """select weapon_class, killed_by, a.event_count as first_event_count, b.event_count as second_event_count, a.median_distance_m as first_median_m, b.median_distance_m as second_median_m,
  round(b.median_distance_m - a.median_distance_m, 1) as median_gap_m, abs(round(b.median_distance_m - a.median_distance_m, 1)) as absolute_gap_m
from f a join f b using (weapon_class, killed_by) where a.scope = 'ERANGEL' and b.scope = 'MIRAMAR' and killed_by in (select killed_by from f where scope = 'ALL')"""
_ORDER = f"list_position([{', '.join(map(repr, C.CLASS_ORDER))}], weapon_class)"
SUMMARY = f"""with {_PROFILES}, y as ({_GAPS}), a as (select * from f where scope = 'ALL' and killed_by is not null), k as (select * from f where scope = 'ALL' and killed_by is null),
dmr as (select * from a where weapon_class = 'DMR')
select (select max(valid_event_count) from f) as valid_event_count, (select count(*) from a) as weapon_count, (select count(*) from k) as class_count, (select count(*) from y) as map_comparison_count,
  (select round(median(absolute_gap_m), 1) from y) as median_map_gap_m, (select median_distance_m from k where weapon_class = 'Shotgun') as shotgun_median_m, (select median_distance_m from k where weapon_class = 'SR') as sr_median_m,
  round((select median_distance_m from k where weapon_class = 'SR') - (select median_distance_m from k where weapon_class = 'Shotgun'), 1) as role_median_spread_m,
  (select killed_by from dmr order by median_distance_m, killed_by limit 1) as shortest_dmr, (select min(median_distance_m) from dmr) as shortest_dmr_median_m,
  (select killed_by from dmr order by median_distance_m desc, killed_by limit 1) as longest_dmr, (select max(median_distance_m) from dmr) as longest_dmr_median_m,
  (select killed_by from a order by median_distance_m desc, {_ORDER}, killed_by limit 1) as longest_weapon, (select max(median_distance_m) from a) as longest_weapon_median_m"""

_CLEAN = f"""{_D}, u as (select distinct * from d where killed_by in ('Falling', 'Drown')),
c as (
  select md5(to_json(struct_pack({', '.join(f'{n} := {n}' for n in 'killed_by killer_name killer_placement killer_position_x killer_position_y map match_id time victim_name victim_placement victim_position_x victim_position_y'.split())}))) as event_id,
    trim(killed_by) as killed_by, upper(trim(map)) as map, trim(match_id) as match_id, victim_position_x, victim_position_y from u),
q as (
  select *, case when map is null or map = '' then 'missing_map' when map not in ('ERANGEL', 'MIRAMAR') then 'unsupported_map' when match_id is null or match_id = '' then 'missing_match_id'
    when victim_position_x is null or victim_position_y is null then 'missing_coordinates' when victim_position_x = 0 and victim_position_y = 0 then 'zero_zero'
    when victim_position_x not between 0 and 816000 or victim_position_y not between 0 and 816000 then 'out_of_bounds' else 'quality_valid' end as quality_status from c)"""
_DATES = f"""{_A}, m as (select nullif(trim(match_id), '') as match_id, min(try_cast(left(trim(date), 10) as date)) as match_date, count(distinct try_cast(left(trim(date), 10) as date)) as date_count from a where nullif(trim(match_id), '') is not null group by 1)"""
_LINKED = f"""{_CLEAN}, {_DATES}, l as (
  select q.*, case when date_count = 1 then match_date end as date, case when m.match_id is null then 'unmatched_match_id' when date_count = 0 then 'missing_or_unparseable_date' when date_count > 1 then 'ambiguous_date' else 'valid_date' end as date_status
  from q left join m using (match_id))"""

_FUNNEL = {
    "environmental_input_rows": "(select count(*) from d where killed_by in ('Falling', 'Drown'))",
    "exact_duplicate_rows_removed": "(select count(*) from d where killed_by in ('Falling', 'Drown')) - (select count(*) from u)",
    "rows_after_deduplication": "(select count(*) from u)",
} | {
    f"{name}_rows": f"(select count(*) from q where quality_status = '{status}')"
    for name, status in (("missing_map", "missing_map"), ("unsupported_map", "unsupported_map"), ("missing_match_id", "missing_match_id"), ("missing_coordinate", "missing_coordinates"), ("zero_zero", "zero_zero"), ("out_of_bounds", "out_of_bounds"), ("quality_valid", "quality_valid"))
} | {
    f"{s}_rows": f"(select count(*) from l where quality_status = 'quality_valid' and date_status = '{s}')" for s in ("unmatched_match_id", "missing_or_unparseable_date", "ambiguous_date")
} | {
    "final_analysis_rows": "(select count(*) from l where quality_status = 'quality_valid' and date_status = 'valid_date')",
    "total_excluded_rows": "(select count(*) from d where killed_by in ('Falling', 'Drown')) - (select count(*) from l where quality_status = 'quality_valid' and date_status = 'valid_date')",
}

_RULES = [
    "event_id is null or trim(event_id) = ''",
    "map is null or trim(map) not in ('ERANGEL', 'MIRAMAR')",
    "match_id is null or trim(match_id) = ''",
    "victim_position_x is null or victim_position_y is null",
    "victim_position_x = 0 and victim_position_y = 0",
    "victim_position_x < 0 or victim_position_y < 0 or victim_position_x > 816000 or victim_position_y > 816000",
    "date is null",
    "killed_by is null or killed_by not in ('Falling', 'Drown')",
    "copy > 1",
]
_ANY = " or ".join(f"({r})" for r in _RULES[:-2]) + " or killed_by not in ('Falling', 'Drown') or copy > 1"
# of equal event ids the one that breaks another rule counts as the first
_FIRST = " or ".join(f"coalesce({r}, false)" for r in _RULES[:-2]) + " or coalesce(killed_by not in ('Falling', 'Drown'), false)"
CHECKS = f"with {_rows('g', S.GATED)}, t as (select *, row_number() over (partition by event_id order by ({_FIRST}) desc) as copy from g)\n" + "\nunion all\n".join(
    f"select {i} as rule_order, '{name}' as check_name, count(*) as checked_rows, count(*) filter ({rule}) as error_count from t" for i, (name, rule) in enumerate(zip(C.RULE_NAMES, [_ANY, *_RULES]), 1)
)

_P = f"""{_D}, p as (
  select killed_by as killed_by_raw, map as map_raw, match_id as match_id_raw, nullif(trim(killed_by), '') as killed_by, nullif(trim(map), '') as map, nullif(trim(match_id), '') as match_id,
    victim_position_x as x, victim_position_y as y, time from d)"""
_RP = f"""{_rows("raw", S.RAW_DEATHS)}, p as (
  select nullif(trim(killed_by), '') as killed_by, nullif(trim(map), '') as map, nullif(trim(match_id), '') as match_id, nullif(trim(killer_name), '') as killer_name, nullif(trim(victim_name), '') as victim_name,
    try_cast(nullif(trim(victim_position_x), '') as double) as x, try_cast(nullif(trim(victim_position_y), '') as double) as y, try_cast(nullif(trim(killer_position_x), '') as double) as kx, try_cast(nullif(trim(killer_position_y), '') as double) as ky,
    try_cast(nullif(trim(victim_placement), '') as double) as placement, source_file from raw)"""
_COLUMNS = "killed_by, killer_name, killer_placement, killer_position_x, killer_position_y, map, match_id, time, victim_name, victim_placement, victim_position_x, victim_position_y"
_COPIES = f"{_rows('raw', S.RAW_DEATHS)}, g as (select killed_by, count(*) as n, count(distinct source_file) as files from raw group by {_COLUMNS} having count(*) > 1)"
_KEYS = {"k1": "nullif(trim(match_id), '')", "k2": "nullif(trim(victim_name), '')", "k3": "try_cast(nullif(trim(time), '') as double)", "k4": "nullif(trim(killed_by), '')"}
_CANDIDATES = f"""{_rows('raw', S.RAW_DEATHS)}, k as (select *, {', '.join(f'{v} as {k}' for k, v in _KEYS.items())} from raw),
o as (select k1, k2, k3, k4, count(*) as n, list(distinct source_file) as fs from k where k1 is not null and k2 is not null and k3 is not null and k4 is not null group by k1, k2, k3, k4, {_COLUMNS}),
g as (select k4 as killed_by, sum(n)::bigint as n, count(*) as v, len(list_distinct(flatten(list(fs)))) as files from o group by k1, k2, k3, k4 having sum(n) > 1)"""
_KNOWN = "map in ('ERANGEL', 'MIRAMAR')"
_OFF = "(x < 0 or x > 816000 or y < 0 or y > 816000)"
_CAUSED = "killed_by in ('Falling', 'Drown')"


def _counts(**conditions: str) -> str:
    return ", ".join(f"count(*) filter ({c}) as {n}" for n, c in conditions.items())


CORE = f"""with {_P} select count(*) as total_rows, count(distinct match_id) as distinct_match_ids, """ + _counts(
    **{f"null_{c}": f"{c}_raw is null" for c in ("killed_by", "map", "match_id")},
    **{f"blank_{c}": f"trim({c}_raw) = ''" for c in ("killed_by", "map", "match_id")},
    **{f"missing_{c}": f"{c} is null" for c in ("killed_by", "map", "match_id")},
    **{f"null_victim_{a}": f"{a} is null" for a in "xy"},
    **{f"blank_victim_{a}": "false" for a in "xy"},
    **{f"invalid_numeric_victim_{a}": "false" for a in "xy"},
    **{f"zero_victim_{a}": f"{a} = 0" for a in "xy"},
    both_coordinates_missing="x is null and y is null",
    one_coordinate_missing="(x is null) <> (y is null)",
    zero_zero_coordinates="x = 0 and y = 0",
    negative_coordinates="x < 0 or y < 0",
    non_finite_coordinates="not isfinite(x) or not isfinite(y)",
    out_of_bounds_coordinates=f"{_KNOWN} and {_OFF}",
    **{f"victim_{a}_below_zero": f"{_KNOWN} and {a} < 0" for a in "xy"},
    **{f"victim_{a}_above_max": f"{_KNOWN} and {a} > 816000" for a in "xy"},
    complete_required_fields="killed_by is not null and map is not null and match_id is not null and isfinite(x) and isfinite(y)",
    environmental_rows=_CAUSED,
    complete_environmental_rows=f"{_CAUSED} and map is not null and match_id is not null and isfinite(x) and isfinite(y)",
    environmental_zero_zero_rows=f"{_CAUSED} and x = 0 and y = 0",
) + " from p"

_MATCH = "h as (select match_id, count(*) as n, count(*) filter (map is null) as lack, count(distinct map) as known from p group by match_id)"

_F = f"""{_D}, {_A}, dim as (select nullif(trim(match_id), '') as match_id, count(distinct nullif(trim(date), '')) as date_count from a where nullif(trim(match_id), '') is not null group by 1),
o as (select trim(killed_by) as cause, * exclude (killed_by), count(*) as copies from d where trim(killed_by) in ('Falling', 'Drown') group by all),
s as (
  select cause as killed_by, nullif(trim(o.map), '') as map, nullif(trim(o.match_id), '') as match_id, copies, coalesce(nullif(trim(o.map), '') not in ('ERANGEL', 'MIRAMAR'), true) as fm, victim_position_x = 0 and victim_position_y = 0 as fz,
    nullif(trim(o.map), '') in ('ERANGEL', 'MIRAMAR') and (victim_position_x < 0 or victim_position_x > 816000 or victim_position_y < 0 or victim_position_y > 816000) as fb, coalesce(date_count <> 1, true) as fd
  from o left join dim on nullif(trim(o.match_id), '') = dim.match_id)"""

_T = _rows("t", S.TELEMETRY) + """, k as (
  select match_id, event, json_type(event) = 'OBJECT' as is_event, case when json_type(event) = 'OBJECT' then coalesce(nullif(json_extract_string(event, '$._T'), ''), 'UNKNOWN') end as kind,
    case when json_type(event, '$.victim.location.x') in ('BIGINT', 'UBIGINT', 'DOUBLE') then json_extract_string(event, '$.victim.location.x')::double end as x,
    case when json_type(event, '$.victim.location.y') in ('BIGINT', 'UBIGINT', 'DOUBLE') then json_extract_string(event, '$.victim.location.y')::double end as y from t)"""
_KILL = "kind in ('LogPlayerKill', 'LogPlayerKillV2')"


def _damage(name: str) -> str:
    return f"count(*) filter ({_KILL} and json_type(event, '$.{name}') = 'OBJECT') as \"with_{name}\""


_TELEMETRY = f"""select match_id, count(*) as event_count, count(*) filter (is_event) as object_events, count(distinct kind) as event_types, count(*) filter (kind = 'UNKNOWN') as untyped_events, count(*) filter ({_KILL}) as kill_events,
  count(*) filter ({_KILL} and x is not null and y is not null) as located_kills, count(*) filter ({_KILL} and x = 0 and y = 0) as zero_zero_kills, {', '.join(map(_damage, ('killerDamageInfo', 'finishDamageInfo', 'dBNODamageInfo')))},
  array_to_string(list_sort(list_distinct(flatten(coalesce(list(json_keys(event)) filter ({_KILL}), [])))), ',') as kill_keys from k group by match_id"""
_M = f"""{_T}, mp as (select d.match_id, coalesce(nullif(json_extract_string(value, '$.data.attributes.mapName'), ''), 'UNKNOWN') as map_name, coalesce(nullif(json_extract_string(value, '$.data.attributes.gameMode'), ''), 'UNKNOWN') as game_mode,
  json_extract_string(value, '$.data.attributes.createdAt') as created_at, y.* exclude (match_id) from ({S.MATCHES}) d join ({_TELEMETRY}) y on d.match_id = y.match_id)"""
_MEMBERS = [(c, f, m) for c, m in (("damage_type", "damageTypeCategory"), ("damage_causer", "damageCauserName"), ("damage_reason", "damageReason")) for f in ("killerDamageInfo", "finishDamageInfo", "dBNODamageInfo")]

#: Columns that the registered queries return as text.
_TEXT = {name: ("first_death_date", "last_death_date") for name in ("grid_250", "grid_100")} | {
    "grid_pyramid": ("first_date", "last_date"),
    "hotspot_report": ("observed_from", "observed_to"),
    "resolution_comparison": ("observed_from", "observed_to"),
    "match_date_quality": ("match_date",),
    "clean_events": ("date",),
    "latest_runs": ("started_at", "finished_at"),
    "quality_run_summary": ("started_at",),
}


def oracle_sql() -> dict[str, str]:
    found = _oracle_sql()
    found["served_hotspots"] = found["written_cells"] = found["heatmap_cells"]
    return found | {name: f"select * replace ({', '.join(f'{c}::varchar as {c}' for c in columns)}) from ({found[name]})" for name, columns in _TEXT.items()}


def _oracle_sql() -> dict[str, str]:
    rate = "printf('%.9f%%', {} * 100.0 / {})"
    return {
        "grid_250": f"with {_E} {_grid(250)}",
        "grid_100": f"with {_E} {_grid(100)}",
        "heatmap_cells": f"with {_E} select map, killed_by, 100 as grid_size_m, grid_x, grid_y, n as death_count, m as match_count, t as date_count, round(n::double / total * 100, 4) as share_pct, heat_rank from ({_ranked(100, 'heat_rank')}) where heat_rank <= 400",
        "detail_cells": DETAIL,
        "hotspot_report": REPORT,
        "report_extras": f"with {_E}, g as ({_grid(100)}) select map, killed_by, grid_x, grid_y, round(distinct_match_count::double / death_count, 4) as repeat_rate, least(grid_min_x_m, 8192) as pixel_x, least(grid_min_y_m, 8192) as pixel_y from g",
        "resolution_comparison": COMPARISON,
        "grid_pyramid": f"with {_E} " + " union all ".join(f"select map, killed_by, {m} as grid_size_m, grid_x, grid_y, n as death_count, m as match_count, t as date_count, t0 as first_date, t1 as last_date from ({_cells(m)})" for m in (10, 100, 250, 500)),
        "cell_parents": PARENTS,
        "csv_types": f"with {_rows('r', S.CSV_ROWS)}, v as (select file as folder, unnest(['order_id', 'part_id', 'quantity', 'shipped', 'flag']) as column, unnest([order_id, part_id, quantity, shipped, flag]) as x from r) select folder, \"column\", case when count(x) = 0 then 'void' when bool_and(try_cast(x as date) is not null) filter (x is not null) then 'date' when bool_or(try_cast(x as double) is null) filter (x is not null) then 'string' when bool_or(x like '%.%') then 'double' when bool_or(try_cast(x as int) is null) filter (x is not null) then 'bigint' else 'int' end as type, count(x) as filled from v group by 1, 2",
        "collection_report": f"with {_rows('d', S.DOCUMENTS)}, {_rows('t', S.DOCUMENT_EVENTS)}, n as (select match_id, count(*) as n from t group by 1), j as (select coalesce(n, 0) as n, case when not json_valid(value) then 'NOT_JSON' when coalesce(json_type(case when json_valid(value) then value end, '$.data'), '') <> 'OBJECT' then 'NO_DATA' when coalesce(json_type(case when json_valid(value) then value end, '$.included'), '') <> 'ARRAY' then 'NO_INCLUDED' when value not like '%\"telemetry\",\"URL\":\"u\"%' then 'NO_TELEMETRY' when n is null then 'NO_EVENTS' end as why from d left join n using (match_id)) select count(*) as requested, " + _counts(succeeded="why is null", failed="why is not null", **{w.lower(): f"why = '{w}'" for w in ("NOT_JSON", "NO_DATA", "NO_INCLUDED", "NO_TELEMETRY", "NO_EVENTS")}) + ", coalesce(sum(n) filter (why is null), 0)::bigint as event_count from j",
        "damage_keys": f"with {_T} select field, key, count(*) as event_count from (" + " union all ".join(f"select '{f}' as field, unnest(json_keys(event, '$.{f}')) as key from k where {_KILL} and json_type(event, '$.{f}') = 'OBJECT'" for f in ("killerDamageInfo", "finishDamageInfo", "dBNODamageInfo")) + ") group by 1, 2",
        "telemetry_totals": f"with {_T} select * exclude (match_id) from ({_TELEMETRY.replace('from k group by match_id', 'from (select * replace (0 as match_id) from k) group by match_id')})",
        "candidate_lift": LIFT,
        "distance_profiles": f"with {_PROFILES} select * from f",
        "distance_map_gap": f"with {_PROFILES} {_GAPS}",
        "distance_summary": SUMMARY,
        "classify_status": f"with {_CLEAN} select map, killed_by, quality_status, count(*) as row_count from q group by all",
        "classified_events": f"with {_CLEAN} select * from q",
        "match_date_quality": f"with {_DATES} select * from m",
        "date_link_status": f"with {_LINKED} select date_status, killed_by, count(*) as row_count, count(distinct date) as dates from l where quality_status = 'quality_valid' group by all",
        "clean_events": f"with {_LINKED} select event_id, killed_by, map, match_id, date, victim_position_x, victim_position_y from l where quality_status = 'quality_valid' and date_status = 'valid_date'",
        "stage_funnel": f"with {_LINKED} " + " union all ".join(f"select {i} as stage_order, '{n}' as metric, ({v})::bigint as row_count" for i, (n, v) in enumerate(_FUNNEL.items(), 1)),
        "quality_checks": CHECKS,
        "exact_duplicates": f"with {_COPIES} select count(*) as duplicate_groups, coalesce(sum(n), 0)::bigint as duplicate_rows, coalesce(sum(n - 1), 0)::bigint as excess_rows, coalesce(max(n), 0) as most_copies, count(*) filter (files = 1) as within_file_groups, count(*) filter (files > 1) as cross_file_groups from g",
        "exact_duplicates_by_cause": f"with {_COPIES} select killed_by, count(*) as duplicate_groups, sum(n)::bigint as duplicate_rows, sum(n - 1)::bigint as excess_rows, max(n) as most_copies from g where killed_by in ('Falling', 'Drown') group by killed_by",
        "event_candidates": f"with {_CANDIDATES} select count(*) as candidate_groups, coalesce(sum(n), 0)::bigint as candidate_rows, coalesce(sum(n - 1), 0)::bigint as excess_rows, coalesce(max(n), 0) as max_rows_per_key, count(*) filter (v = 1) as equal_groups, count(*) filter (v > 1) as variant_groups, count(*) filter (files > 1) as cross_file_groups from g",
        "event_candidates_by_cause": f"with {_CANDIDATES} select killed_by, count(*) as candidate_groups, sum(n)::bigint as candidate_rows, sum(n - 1)::bigint as excess_rows, max(n) as max_rows_per_key, count(*) filter (v = 1) as equal_groups, count(*) filter (v > 1) as variant_groups from g where killed_by in ('Falling', 'Drown') group by killed_by",
        "key_completeness": f"with {_rows('raw', S.RAW_DEATHS)} select count(*) as total_rows, " + _counts(**{n: f"{_KEYS[k]} is null" for k, n in (("k1", "missing_match_id"), ("k2", "missing_victim_name"), ("k3", "invalid_or_missing_time"), ("k4", "missing_killed_by"))}, complete_keys=" and ".join(f"{v} is not null" for v in _KEYS.values())) + " from raw",
        "aggregate_profile": f"with {_rows('a', S.PLAYERS)}, g as (select count(*) as n from a group by match_id, player_name having count(*) > 1) select count(*) as row_count, count(*) filter (match_id is null) as null_match_id, count(*) filter (player_name is null) as null_player_name, min(player_kills) as min_kills, max(player_kills) as max_kills, min(player_dmg) as min_damage, max(player_dmg) as max_damage, (select count(*) from g) as duplicate_groups, (select coalesce(sum(n - 1), 0)::bigint from g) as duplicate_rows from a",
        "aggregate_head": f"with {_rows('a', S.PLAYERS)} select * from a order by match_id nulls first, player_name nulls first, player_kills nulls first, player_dmg nulls first limit 5",
        "csv_union": _csv_profile("double"),
        "csv_typed": _csv_profile("varchar"),
        "written_report": f"with {_E} select map, killed_by, grid_x::varchar as grid_x, grid_y::varchar as grid_y, death_count::varchar as death_count, first_death_date::date::varchar as first_death_date from ({_grid(250)})",
        "sample_matches": f"with {_LISTED} select * from l",
        "sample_summary": f"with {_LISTED} select window_name, count(*) as reference_count, count(distinct match_id) as unique_matches from l group by 1",
        "sample_totals": f"with {_LISTED} select (select count(distinct window_name) from r) as window_count, count(*) as match_reference_count, count(distinct match_id) as unique_match_id_count from l",
        "first_matches": f"with {_LISTED} select match_id from (select match_id, min((window_name, position)) as place from l group by 1) order by place, match_id limit {FIRST_MATCHES}",
        "file_checksums": f"with {_rows('r', S.LINES)}, o as (select file, line, sum(strlen(line) + 1) over (partition by file order by line, n) - strlen(line) - 1 as begins from (select *, row_number() over (partition by file, line) as n from r)), b as (select file, greatest(begins - 1, 0) // 65536 as k, count(*) as lines, sum(strlen(line) + 1) as bytes, sha256(string_agg(line || chr(10), '' order by begins)) as digest from o group by all) select file::varchar as file, sum(bytes)::bigint as bytes, count(*) as ranges, sum(lines)::bigint as lines, sha256(sum(bytes)::bigint::varchar || ':65536:' || string_agg(digest, ',' order by k)) as sha256 from b group by file",
        "eligibility_funnel": f"with {_F} select killed_by, sum(copies)::bigint as raw_rows, count(*) as after_exact_dedup, sum(copies - 1)::bigint as exact_duplicate_excess, " + _counts(after_map="not fm", after_zero_zero="not fm and not fz", after_bounds="not fm and not fz and not fb", final_eligible_rows="not fm and not fz and not fb and not fd") + " from s group by killed_by",
        "primary_reasons": f"with {_F} select killed_by, case when fm then 'MISSING_MAP' when fz then 'INVALID_OR_UNAVAILABLE_POSITION' when fb then 'OUT_OF_MAP_BOUNDS' when fd then 'DATE_NOT_FOUND_OR_CONFLICT' else 'ELIGIBLE' end as primary_status, count(*) as unique_rows from s group by all",
        "exclusion_combos": f"with {_F} select killed_by, concat_ws('|', case when fm then 'MISSING_MAP' end, case when fz then 'ZERO_ZERO' end, case when fb then 'OUT_OF_BOUNDS' end, case when fd then 'DATE_NOT_FOUND_OR_CONFLICT' end) as exclusion_combination, count(*) as unique_rows from s where fm or fz or fb or fd group by all",
        "eligible_by_map": f"with {_F} select map, killed_by, count(*) as eligible_rows, count(distinct match_id) as distinct_matches from s where not fm and not fz and not fb and not fd group by all",
        "reconciliation": f"with {_F} select sum(copies)::bigint as raw_rows, sum(copies - 1)::bigint as duplicate_excess, count(*) as deduplicated_rows, count(*) filter (fm or fz or fb or fd) as excluded_rows, count(*) filter (not (fm or fz or fb or fd)) as eligible_rows, (sum(copies) - sum(copies - 1) - count(*) filter (fm or fz or fb or fd) - count(*) filter (not (fm or fz or fb or fd)))::bigint as difference from s",
        "core_profile": CORE,
        "group_profile": f"with {_P} select coalesce(map, '<NULL_OR_BLANK>') as map, count(*) as row_count, count(distinct match_id) as distinct_match_ids, min(x) filter (isfinite(x)) as min_victim_x, max(x) filter (isfinite(x)) as max_victim_x, min(y) filter (isfinite(y)) as min_victim_y, max(y) filter (isfinite(y)) as max_victim_y, " + _counts(zero_zero_rows="x = 0 and y = 0", out_of_bounds_rows=f"{_KNOWN} and {_OFF}", falling_rows="killed_by = 'Falling'", drown_rows="killed_by = 'Drown'") + " from p group by p.map",
        "map_completeness": f"with {_P}, {_MATCH} select sum(n)::bigint as total_rows, sum(lack)::bigint as missing_map_rows, count(*) filter (lack > 0) as matches_with_missing_map, sum(case when known = 1 then lack else 0 end)::bigint as recoverable_rows, sum(case when known = 0 then lack else 0 end)::bigint as unrecoverable_rows, count(*) filter (lack > 0 and known = 0) as all_missing_matches, count(*) filter (known > 1) as conflicting_map_matches from h",
        "missing_maps_by_cause": f"with {_P}, {_MATCH} select killed_by, count(*) as missing_map_rows, " + _counts(recoverable_rows="known = 1", unrecoverable_rows="known = 0", conflict_rows="known > 1") + f" from p join h using (match_id) where map is null and {_CAUSED} group by killed_by",
        "bounds_report": f"with {_P} select map, killed_by, count(*) as cause_rows, count(*) filter {_OFF} as out_of_bounds_rows, {rate.format(f'count(*) filter {_OFF}', 'count(*)')} as out_of_bounds_rate from p where {_KNOWN} and {_CAUSED} group by all",
        "bounds_examples": f"with {_P} select killed_by, map, match_id, x as victim_x, y as victim_y, concat_ws(', ', case when x < 0 then 'X_BELOW_0' end, case when x > 816000 then 'X_ABOVE_816000' end, case when y < 0 then 'Y_BELOW_0' end, case when y > 816000 then 'Y_ABOVE_816000' end) as violation from p where {_KNOWN} and {_OFF} order by case when {_CAUSED} then 0 else 1 end, greatest(-x, x - 816000, -y, y - 816000) desc, match_id nulls first, x, y limit 12",
        "sentinel_profile": f"with {_P} select count(*) as cause_rows, count(*) filter (x = 0 and y = 0) as zero_zero_rows, count(distinct match_id) as cause_matches, count(distinct match_id) filter (x = 0 and y = 0) as zero_zero_matches, " + _counts(only_x_zero="x = 0 and y <> 0", only_y_zero="x <> 0 and y = 0", nonzero_within_10m_square="x between 0 and 1000 and y between 0 and 1000 and not (x = 0 and y = 0)", nonzero_within_100m_square="x between 0 and 10000 and y between 0 and 10000 and not (x = 0 and y = 0)") + f", {rate.format('count(*) filter (x = 0 and y = 0)', 'count(*)')} as zero_zero_rate from p where killed_by = 'Drown'",
        "sentinel_by_map": f"with {_P} select coalesce(map, '<NULL_OR_BLANK>') as map, count(*) as cause_rows, count(*) filter (x = 0 and y = 0) as zero_zero_rows, {rate.format('count(*) filter (x = 0 and y = 0)', 'count(*)')} as zero_zero_rate, count(distinct match_id) filter (x = 0 and y = 0) as zero_zero_matches from p where killed_by = 'Drown' group by p.map",
        "time_quantiles": f"with {_P} select case when x = 0 and y = 0 then 'ZERO_ZERO' else 'NON_ZERO' end as position_group, count(*) as row_count, min(time)::double as min_time, quantile_cont(time::double, 0.25) as p25_time, quantile_cont(time::double, 0.5) as median_time, quantile_cont(time::double, 0.75) as p75_time, quantile_cont(time::double, 0.95) as p95_time, max(time)::double as max_time, avg(time::double) as avg_time, count(*) filter (time >= 120 and time < 300) as early_rows from p where killed_by = 'Drown' group by 1",
        "latest_runs": f"with {_rows('r', S.RUNS)} select * from r qualify row_number() over (partition by pipeline_name order by started_at desc, run_id desc) = 1",
        "latest_hotspots": f"with {_rows('h', S.HOTSPOTS)}, {_rows('r', S.RUNS)}, l as (select run_id from r where pipeline_name = 'p1' and status = 'SUCCEEDED' order by finished_at desc nulls last, run_id desc limit 1) select h.* from h join l on source_run_id = run_id",
        "quality_run_summary": f"with {_rows('r', S.RUNS)}, {_rows('c', S.RESULTS)} select r.run_id, batch_id, started_at, quality_status, count(check_name) as check_count, count(*) filter (c.status = 'FAIL') as failed_check_count, coalesce(sum(error_count), 0)::bigint as rule_error_count from r left join c on r.run_id = c.run_id group by all",
        "json_event_profile": f"with {_T} {_TELEMETRY}",
        "event_type_counts": f"with {_T} select kind as event_type, count(*) as event_count from k where is_event group by kind",
        "damage_values": f"with {_T}, v as (" + " union all ".join(f"select '{c}' as counter, nullif(json_extract_string(event, '$.{f}.{m}'), '') as value from k where {_KILL}" for c, f, m in _MEMBERS) + ") select counter, value, count(*) as event_count from v where value is not null group by all",
        "match_profiles": f"with {_M} select * from mp",
        "pilot_counts": f"with {_M} select 'map_name' as counter, map_name as value, count(*) as match_count from mp group by all union all select 'game_mode', game_mode, count(*) from mp group by all",
        "pilot_summary": f"with {_M} select count(*) as successful_match_count, min(created_at) as created_at_min, max(created_at) as created_at_max, sum(object_events)::bigint as event_count, sum(kill_events)::bigint as kill_event_count, sum(located_kills)::bigint as victim_location_count, sum(zero_zero_kills)::bigint as zero_zero_count from mp",
        "file_profile": f"with {_RP} select source_file, count(*) as row_count, count(distinct match_id) as distinct_match_ids, min(x) filter (isfinite(x)) as min_victim_x, max(x) filter (isfinite(x)) as max_victim_x, min(y) filter (isfinite(y)) as min_victim_y, max(y) filter (isfinite(y)) as max_victim_y, " + _counts(zero_zero_rows="x = 0 and y = 0", out_of_bounds_rows=f"{_KNOWN} and {_OFF}", falling_rows="killed_by = 'Falling'", drown_rows="killed_by = 'Drown'") + " from p group by source_file",
        "sentinel_by_file": f"with {_RP} select source_file, count(*) as cause_rows, count(*) filter (x = 0 and y = 0) as zero_zero_rows, {rate.format('count(*) filter (x = 0 and y = 0)', 'count(*)')} as zero_zero_rate, count(distinct match_id) filter (x = 0 and y = 0) as zero_zero_matches from p where killed_by = 'Drown' group by source_file",
        "sentinel_related": f"with {_RP} select case when x = 0 and y = 0 then 'ZERO_ZERO' else 'NON_ZERO' end as position_group, count(*) as row_count, " + _counts(killer_zero_zero="kx = 0 and ky = 0", killer_coordinate_missing="kx is null or ky is null", same_named_actor="killer_name = victim_name", missing_killer_name="killer_name is null", missing_victim_placement="placement is null") + " from p where killed_by = 'Drown' group by 1",
    }
