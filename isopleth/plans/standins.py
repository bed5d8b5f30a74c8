"""Inputs of the registered queries: the driver's tables in the roles of the domain's.

Every expression below is SQL that Spark and DuckDB read alike, so each stand-in is stated once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Line items as located events: flag and status are map and cause, the order is the match.
EVENTS = """
select l_returnflag as map, l_linestatus as killed_by, cast(l_orderkey as string) as match_id, cast(l_shipdate as date) as date,
       l_extendedprice as victim_position_x, cast(l_partkey % 2000 * 50 as double) as victim_position_y
from lineitem"""

_DEATH = """
select case when l_linestatus = 'F' then 'Falling' when l_linenumber % 3 = 0 then 'Drown' when l_linenumber % 3 = 2 then case when l_suppkey % 2 = 0 then 'Kar98k' else 'AWM' end
            when l_suppkey % 5 = 0 then 'AKM' when l_suppkey % 5 = 1 then 'SKS' when l_suppkey % 5 = 2 then 'Mini 14' when l_suppkey % 5 = 3 then 'S686' else 'M416' end as killed_by,
       case when l_suppkey % 23 = 0 then null else concat('k', cast(l_suppkey % 50 as string)) end as killer_name,
       cast(l_linenumber as double) as killer_placement,
       l_extendedprice * 7 as killer_position_x,
       cast(l_partkey % 2000 * 400 as double) as killer_position_y,
       case when l_returnflag = 'A' then ' erangel ' when l_returnflag = 'N' then 'MIRAMAR' when l_orderkey % 7 = 0 then null when l_orderkey % 7 = 1 then 'SANHOK' else 'ERANGEL' end as map,
       case when l_orderkey % 11 = 0 then ' ' else cast(l_orderkey as string) end as match_id,
       cast(l_linenumber * 60 as bigint) as time,
       concat('k', cast(l_partkey % 50 as string)) as victim_name,
       cast(l_linenumber + 1 as double) as victim_placement,
       case when l_suppkey % 19 = 0 then 0.0 when l_partkey % 13 = 0 then null else l_extendedprice * 8 end as victim_position_x,
       case when l_suppkey % 19 = 0 then 0.0 else cast(l_partkey % 2000 * 410 as double) end as victim_position_y
from lineitem"""

#: Raw events with missing, unsupported and off-map values; rows of every 50th order stand twice.
DEATHS = f"{_DEATH} union all {_DEATH} where l_orderkey % 50 = 0"

#: The same as text of two files, with blanks, spaces and times that are no numbers.
RAW_DEATHS = f"""
select case when victim_name = 'k7' then concat(' ', killed_by, ' ') else killed_by end as killed_by, killer_name, cast(killer_placement as string) as killer_placement,
       cast(killer_position_x as string) as killer_position_x, cast(killer_position_y as string) as killer_position_y, map, match_id,
       case when victim_name = 'k3' then 'n/a' when victim_name = 'k4' then ' ' when killer_name = 'k5' then concat(' ', cast(time as string), '.0') else cast(time as string) end as time,
       case when killer_name = 'k9' then ' ' else victim_name end as victim_name, cast(victim_placement as string) as victim_placement,
       cast(victim_position_x as string) as victim_position_x, cast(victim_position_y as string) as victim_position_y,
       source_file
from (select d.*, 'a.csv' as source_file from ({_DEATH}) d union all select d.*, case when time = 60 then 'a.csv' else 'b.csv' end as source_file from ({_DEATH} where l_orderkey % 50 = 0) d) d"""

#: Players' results, some without a match or a name, some twice.
PLAYERS = """
select case when l_suppkey % 37 = 0 then null else cast(l_orderkey as string) end as match_id, case when l_partkey % 29 = 0 then null else concat('k', cast(l_linenumber % 3 as string)) end as player_name,
       cast(l_quantity as bigint) as player_kills, cast(floor(l_extendedprice) as bigint) as player_dmg
from lineitem"""

#: Match dates with unparseable, missing, repeated and conflicting ones; every fifth match is one without deaths.
AGGREGATE = """
select case when o_orderkey % 5 = 0 then concat('x', cast(o_orderkey as string)) else cast(o_orderkey as string) end as match_id, case when o_orderkey % 9 = 0 then null when o_orderkey % 9 = 1 then '2017-10' else concat(substring(cast(o_orderdate as string), 1, 10), 'T10:00:00+0000') end as date
from orders
union all
select cast(o_orderkey as string) as match_id, case when o_orderkey % 9 = 2 then '2017-10-20T00:00:00+0000' else concat(substring(cast(o_orderdate as string), 1, 10), 'T11:00:00+0000') end as date
from orders where o_orderkey % 5 <> 0 and o_orderkey % 9 in (2, 3)"""

#: Clean events for the gate, with a few that break its rules.
GATED = """
select cast(l_orderkey * 10 + l_linenumber as string) as event_id,
       case when l_suppkey % 41 = 0 then null when l_linestatus = 'F' then 'Falling' when l_suppkey % 43 = 0 then 'AKM' else 'Drown' end as killed_by,
       case when l_suppkey % 47 = 0 then ' ' when l_returnflag = 'N' then 'MIRAMAR' else ' ERANGEL' end as map,
       case when l_orderkey % 53 = 0 then '' else cast(l_orderkey as string) end as match_id,
       case when l_orderkey % 59 = 0 then null else cast(l_shipdate as date) end as date,
       case when l_suppkey % 19 = 0 then 0.0 else l_extendedprice * 8 end as victim_position_x,
       case when l_suppkey % 19 = 0 then 0.0 when l_partkey % 61 = 0 then null else cast(l_partkey % 2000 * 400 as double) end as victim_position_y
from lineitem"""

RUNS = """
select cast(o_orderkey as string) as run_id, concat('p', cast(o_custkey % 7 as string)) as pipeline_name, concat('b', cast(o_orderkey % 100 as string)) as batch_id,
       case when o_orderstatus = 'F' then 'FAILED' when o_orderkey % 10 = 0 then 'RUNNING' else 'SUCCEEDED' end as status,
       case when o_orderstatus = 'F' then 'FAIL' else 'PASS' end as quality_status,
       o_orderdate as started_at, case when o_orderkey % 10 = 0 then null else o_orderdate end as finished_at
from orders"""

#: Rule results; a third is of runs that are not known.
RESULTS = """
select case when l_orderkey % 3 = 0 then concat('x', cast(l_orderkey as string)) else cast(l_orderkey as string) end as run_id, concat('c', cast(l_linenumber as string)) as check_name, case when l_discount > 0.05 then 'FAIL' else 'PASS' end as status, cast(l_quantity as bigint) as error_count
from lineitem"""

HOTSPOTS = """
select cast(l_orderkey as string) as source_run_id, l_returnflag as map, l_linestatus as killed_by, l_linenumber as heat_rank, cast(l_quantity as bigint) as death_count
from lineitem"""

#: Elements of telemetry: types, none in some, a place in some, as text in a few, damage objects in some; a few are no objects.
TELEMETRY = """
select cast(user_id % 20 as string) as match_id,
       case when event_id % 17 = 0 then '7' when event_id % 19 = 0 then '[1, 2]' when event_id % 23 = 0 then null else
       concat('{', case when event_id % 13 = 0 then '' when event_id % 29 = 0 then '"_T":"",' else concat('"_T":"', case when event_type = 'click' then 'LogPlayerKill' when event_id % 5 = 0 then 'LogPlayerKillV2' else event_type end, '",') end,
              case when event_id % 11 = 0 then '"victim":{"location":{"x":"12","y":"0"}}' else concat('"victim":{"location":{"x":', cast(event_id % 3 as string), ',"y":', cast(event_id % 2 as string), '.0}}') end,
              case when event_id % 4 = 0 then ',"killerDamageInfo":{"damageTypeCategory":"Damage_Gun","damageReason":""}' when event_id % 4 = 1 then ',"killerDamageInfo":7' else '' end,
              case when event_id % 6 = 0 then ',"finishDamageInfo":{"damageCauserName":"W","damageReason":"Head"},"dBNODamageInfo":{"damageTypeCategory":"Damage_Gun"}' else '' end, '}') end as event
from events"""

#: Match documents of the same matches, some without a map or a mode.
MATCHES = """
select distinct cast(user_id % 20 as string) as match_id,
       concat('{"data":{"attributes":{', case when user_id % 20 < 3 then '' when user_id % 20 < 6 then '"mapName":"",' when user_id % 2 = 0 then '"mapName":"Baltic",' else '"mapName":"Desert",' end,
              case when user_id % 20 = 7 then '' else '"gameMode":"squad",' end, '"createdAt":"2020-01-0', cast(user_id % 20 % 9 + 1 as string), '"}}}') as value
from events"""


#: Line items as the text of four CSV files: a column that holds words in one file, one empty in another, one wider than an int in a third.
CSV_ROWS = """
select cast(l_linenumber % 4 as string) as file, cast(l_orderkey as string) as order_id, case when l_linenumber % 4 = 1 then cast(l_orderkey * 3000000000 as string) else cast(l_partkey as string) end as part_id,
       case when l_linenumber % 4 = 3 and l_suppkey % 7 = 0 then 'n/a' when l_linenumber % 4 = 2 then cast(cast(floor(l_quantity) as bigint) as string) else cast(l_quantity as string) end as quantity,
       case when l_linenumber % 4 = 0 then null when l_suppkey % 3 = 0 then null else cast(cast(l_shipdate as date) as string) end as shipped, l_returnflag as flag
from lineitem"""

#: Sample lists of matches, some entries without an id, some lists missing.
SAMPLES = """
select concat('w', cast(o_orderkey as string)) as window_name,
       case when o_orderkey % 11 = 0 then '{"data":{}}' else
       concat('{"data":{"relationships":{"matches":{"data":[{"id":"c', cast(o_custkey as string), '"},', case when o_orderkey % 7 = 0 then '{"id":""},' when o_orderkey % 7 = 1 then '{"type":"match"},' else '' end,
              '{"id":"d', cast(o_custkey % 100 as string), '"},{"id":"c', cast(o_custkey as string), '"}]}}}}') end as value
from orders"""

#: Line items as lines of text, dealt to files by ranges of orders.
LINES = """
select cast(floor(l_orderkey / 10000) as bigint) as file, concat(cast(l_orderkey as string), ',', cast(l_linenumber as string), ',', cast(l_partkey as string), ',', l_returnflag) as line
from lineitem"""

#: Match documents by customer, some of them broken in each of the ways that are told apart.
DOCUMENTS = """
select cast(o_orderkey as string) as match_id,
       case when o_orderkey % 11 = 0 then '{"data": ' when o_orderkey % 11 = 1 then '{"included":[]}' when o_orderkey % 11 = 2 then '{"data":{},"included":7}' when o_orderkey % 11 = 3 then '{"data":{},"included":[{"type":"asset","attributes":{"name":"other","URL":"u"}}]}'
            when o_orderkey % 11 = 4 then '{"data":{},"included":[{"type":"asset","attributes":{"name":"telemetry","URL":""}}]}'
            else '{"data":{"attributes":{"mapName":"M"}},"included":[{"type":"asset","attributes":{"name":"telemetry","URL":"u"}}]}' end as value
from orders"""

#: Telemetry events of those matches; some have none.
DOCUMENT_EVENTS = """
select cast(l_orderkey as string) as match_id, '{"_T":"LogPlayerKill"}' as event from lineitem where l_orderkey % 13 <> 0"""


def stand_in(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A stand-in's rows, over the tables of a folder."""
    names = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "orders", "events") if f"from {t}" in text}
    for name, rows in names.items():
        text = text.replace(f"from {name}", f"from {{{name}}}")
    escaped = text.replace("{", "{{").replace("}", "}}")
    for name in names:
        escaped = escaped.replace(f"{{{{{name}}}}}", f"{{{name}}}")
    return spark.sql(escaped, **names)
