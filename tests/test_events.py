"""Event operators on small hand-built inputs: rule order, ranks, edges, rounding, drift, publication."""

import datetime as dt
import gzip
import hashlib
import json
import os
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from isopleth import schemas
from isopleth.functions import expr
from isopleth.operators import clean, distance, grid, profiling, quality, serving, telemetry
from isopleth.sources import checksums, commits, csv, database, sinks

DAY = dt.date(2017, 10, 20)
CLEAN = "event_id string, killed_by string, map string, match_id string, date date, victim_position_x double, victim_position_y double"


def death(killed_by="Falling", map="ERANGEL", match_id="m1", x=10.0, y=10.0, **other):
    row = dict(killed_by=killed_by, killer_name="a", killer_placement=1.0, killer_position_x=1.0, killer_position_y=1.0, map=map, match_id=match_id, time=60, victim_name="b", victim_placement=2.0, victim_position_x=x, victim_position_y=y)
    return tuple((row | other)[f.name] for f in schemas.DEATHS)


def test_expressions(spark):
    rows = spark.createDataFrame([(1.005, " x ", "2017-10"), (2.675, "  ", "2017-10-20T01:00:00+0000"), (None, None, "2017-13-40")], "v double, t string, d string")
    got = rows.select(expr.round_to("v", 2), expr.blank_to_null("t"), expr.safe_date("d"), expr.is_blank("t")).collect()
    assert [tuple(r) for r in got] == [(1.0, "x", None, False), (2.68, None, DAY, True), (None, None, None, True)]
    odd = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.0,)], "v double")
    assert [r[0] for r in odd.select(expr.is_finite("v")).collect()] == [False, False, True]


@pytest.mark.parametrize(
    "row, status",
    [
        (death(), "quality_valid"),
        (death(map=None), "missing_map"),
        (death(map="  "), "missing_map"),
        (death(map=" erangel "), "quality_valid"),
        (death(map="SANHOK"), "unsupported_map"),
        (death(match_id=" "), "missing_match_id"),
        (death(x=None), "missing_coordinates"),
        (death(x=0.0, y=0.0), "zero_zero"),
        (death(x=0.0, y=5.0), "quality_valid"),
        (death(x=-1.0), "out_of_bounds"),
        (death(x=816000.0), "quality_valid"),
        (death(x=816000.1), "out_of_bounds"),
        (death(map=None, x=0.0, y=0.0), "missing_map"),
    ],
)
def test_first_rule_wins(spark, row, status):
    assert clean.classify_events(spark.createDataFrame([row], schemas.DEATHS)).first().quality_status == status


def test_clean_build(spark):
    raw = spark.createDataFrame([death()] * 3 + [death(x=11.0), death(match_id="m2"), death(match_id="m3"), death(match_id="m4"), death(killed_by=" Falling "), death(killed_by="AKM")], schemas.DEATHS)
    dates = [("m1", "2017-10-20T01:00:00+0000"), ("m1", "2017-10-20T02:00:00+0000"), ("m2", "2017-10-20"), ("m2", "2017-10-21"), ("m3", "2017-10"), ("m3", None)]
    aggregate = spark.createDataFrame(dates, "match_id string, date string")
    events = clean.clean_events(raw, aggregate).collect()
    assert len(events) == 2 and {e.date for e in events} == {DAY} and len({e.event_id for e in events}) == 2
    funnel = {r.metric: r.row_count for r in clean.stage_funnel(raw, aggregate).collect()}
    assert funnel["environmental_input_rows"] == 7 and funnel["exact_duplicate_rows_removed"] == 2
    assert [funnel[f"{k}_rows"] for k in ("ambiguous_date", "missing_or_unparseable_date", "unmatched_match_id", "final_analysis", "total_excluded")] == [1, 1, 1, 2, 5]
    with pytest.raises(ValueError):
        clean.assert_same_rows(raw, aggregate)


def events_at(spark, points):
    return spark.createDataFrame([(f"e{i}", cause, "ERANGEL", match, DAY, float(x), float(y)) for i, (cause, match, x, y) in enumerate(points)], CLEAN)


def test_grid_edges_and_ties(spark):
    edge = grid.grid_metrics(events_at(spark, [("Drown", "m", 816000, 9999.99), ("Drown", "m", 10000, 10000)]), 100).orderBy("grid_x").collect()
    assert [(r.grid_x, r.grid_y, r.grid_min_x_m, r.grid_max_x_m) for r in edge] == [(1, 1, 100, 200), (81, 0, 8100, 8160)]
    assert [r.hotspot_candidate_rank for r in edge] == [1, 1] and sum(r.death_share_pct for r in edge) == 100
    heat = grid.heatmap_cells(events_at(spark, [("Drown", "m", 5 * 10000, 0), ("Drown", "m", 0, 0), ("Drown", "n", 0, 0)]), top=1).first()
    assert (heat.grid_x, heat.heat_rank, heat.share_pct) == (0, 1, 66.6667)


def test_overlap_takes_the_better_parent_and_ignores_edges(spark):
    kind = "map string, killed_by string, grid_size_m int, grid_x int, grid_y int, grid_min_x_m int, grid_max_x_m int, grid_min_y_m int, grid_max_y_m int, death_count long, distinct_match_count long, distinct_date_count long, first_death_date date, last_death_date date, deaths_per_match double, death_share_pct double, hotspot_candidate_rank int"

    def cells(size, places):
        return spark.createDataFrame([("ERANGEL", "Falling", size, x, y, x * size, (x + 1) * size, y * size, (y + 1) * size, 1, 1, 1, DAY, DAY, 1.0, 1.0, rank) for x, y, rank in places], kind)

    got = grid.resolution_comparison(cells(100, [(2, 0, 1), (5, 0, 2), (0, 0, 3)]), cells(250, [(0, 0, 4), (1, 0, 2)])).orderBy("candidate_rank_100m").collect()
    assert [(r.grid_250_x, r.candidate_rank_250m, r.overlap_with_250m_pct, r.resolution_status) for r in got] == [
        (1, 2, 50.0, "250m 우선 후보와 일치"),
        (None, None, None, "100m 신규 후보"),
        (0, 4, 100.0, "250m 상위 후보와 일치"),
    ]
    assert got[0].candidate_id_100m == "ERA-FAL-100-G2-0" and got[0].report_summary.startswith("에란겔 추락 100m 1순위 후보(X 0.2~0.3km, Y 0.0~0.1km): 1건")


def test_lift_without_ring_or_focus(spark):
    events = events_at(spark, [("Falling", "m", 0, 0), ("Falling", "m", 0, 0), ("Falling", "m", 50 * 10000, 0)])
    lone = grid.candidate_lift(events, events, "ERANGEL", "Falling").first()
    assert lone.neighbor_all_death_count == 0 and lone.neighbor_lift is None and lone.cell_cause_share_pct == 100
    assert grid.candidate_lift(events, events, "MIRAMAR", "Falling").count() == 0


def test_distances(spark):
    def shot(meters, weapon="AKM", **other):
        return death(killed_by=weapon, killer_position_x=1000.0, killer_position_y=1000.0, x=1000.0 + meters * 100, y=1000.0, **other)

    rows = [shot(10), shot(20), shot(2000), shot(2001), shot(5, "Unknown"), shot(5, killer_name="b"), shot(5, killer_name=None), shot(5, map="SANHOK"), death(killed_by="AKM", killer_position_x=0.0, killer_position_y=0.0)]
    profiles = distance.distance_profiles(distance.distance_events(spark.createDataFrame(rows, schemas.DEATHS)), least=4).collect()
    assert [(r.scope, r.weapon_class, r.killed_by, r.event_count, r.median_distance_m) for r in sorted(profiles, key=lambda r: r.scope)] == [("ALL", "AR", None, 3, 20.0), ("ERANGEL", "AR", None, 3, 20.0)]
    assert profiles[0].share_above_300m_pct == 33.33 and profiles[0].valid_event_count == 3


def test_distance_percentiles_without_whole_groups_in_a_task(spark):
    rnd = random.Random(3)
    rows = [(map, "AR", gun, float(rnd.choice([rnd.random() * 1500, rnd.randrange(40), 7.001 + rnd.random() / 1000]))) for map in ("ERANGEL", "MIRAMAR") for gun in ("AKM", "M416") for _ in range(rnd.randrange(50, 400))]
    profiles = distance.distance_profiles(spark.createDataFrame(rows, "map string, weapon_class string, killed_by string, distance_m double"), least=1)
    assert "percentile(" not in profiles._jdf.queryExecution().toString()
    got = {(r.scope, r.killed_by): r for r in profiles.collect()}
    assert len(got) == 9
    for (scope, gun), r in got.items():
        own = [d for m, _, g, d in rows if scope in ("ALL", m) and gun in (None, g)]
        assert r.event_count == len(own) and r.valid_event_count == len(rows)
        for name, q in distance.QUANTILES.items():
            assert r[f"{name}_distance_m"] == pytest.approx(np.quantile(own, q), abs=0.0501)
        assert r.share_above_100m_pct == pytest.approx(100 * np.mean([d >= 100 for d in own]), abs=0.00501)


GOOD = ("e1", "Falling", "ERANGEL", "m", DAY, 1.0, 1.0)


@pytest.mark.parametrize(
    "broken, rules",
    [
        ({0: " "}, {1, 2}), ({2: "SANHOK"}, {1, 3}), ({3: None}, {1, 4}), ({5: None}, {1, 5}), ({5: 0.0, 6: 0.0}, {1, 6}), ({6: 816001.0}, {1, 7}), ({4: None}, {1, 8}), ({1: "AKM"}, {1, 9}), ({1: None}, {9}), ({0: "e1"}, {1, 10}),
    ],
)
def test_each_rule(spark, broken, rules):
    row = tuple(broken.get(i, "e2" if i == 0 else v) for i, v in enumerate(GOOD))
    for name in ("date", "match_date"):
        events = spark.createDataFrame([GOOD, row], CLEAN).withColumnRenamed("date", name)
        checks = quality.quality_checks(events).collect()
        assert {c.rule_order for c in checks if c.error_count} == rules and all(c.checked_rows == 2 for c in checks)


def test_publication(spark, tmp_path):
    store, events = quality.Store(str(tmp_path)), spark.createDataFrame([GOOD, ("e2", *GOOD[1:])], CLEAN)
    first = quality.publish(events, store)
    second = quality.publish(events.repartition(3), store)
    failed = quality.publish(spark.createDataFrame([(None, *GOOD[1:])], CLEAN), store)
    runs = quality.current_runs(spark.read.parquet(store.path("pipeline_runs")))
    assert {r.run_id: r.status for r in runs.collect()} == {first: "SUCCEEDED", second: "SUCCEEDED", failed: "FAILED"}
    hotspots = spark.read.parquet(store.path("environmental_hotspots"))
    assert hotspots.count() == 1 and quality.latest_hotspots(hotspots, runs).first().source_run_id == second
    assert quality.latest_runs(runs).first().run_id == failed
    summary = {r.run_id: r for r in quality.quality_summary(runs, spark.read.parquet(store.path("quality_check_results"))).collect()}
    assert summary[first].check_count == 10 and summary[first].failed_check_count == 0 and summary[failed].failed_check_count == 2
    raw_runs = spark.read.parquet(store.path("pipeline_runs"))
    assert raw_runs.count() == 6 and quality.latest_runs(raw_runs).first().status == "FAILED"
    assert {r.run_id: r.quality_status for r in quality.quality_summary(raw_runs, spark.read.parquet(store.path("quality_check_results"))).collect()} == {first: "PASS", second: "PASS", failed: "FAIL"}
    none = quality.quality_summary(runs, spark.read.parquet(store.path("quality_check_results")).limit(0)).first()
    assert (none.check_count, none.rule_error_count) == (0, 0)


@pytest.mark.parametrize("writes", range(6))
def test_publication_breaks_off(spark, tmp_path, monkeypatch, writes):
    store, events = quality.Store(str(tmp_path)), spark.createDataFrame([GOOD, ("e2", *GOOD[1:])], CLEAN)
    first = quality.publish(events, store)
    done = []

    def broken(self, *args, then=None):
        if len(done) == writes:
            raise KeyboardInterrupt
        done.append(then(self, *args))
        return done[-1]

    for name in ("append", "commit", "drop_run"):
        monkeypatch.setattr(quality.Store, name, lambda self, *a, f=getattr(quality.Store, name): broken(self, *a, then=f))
    try:
        last = quality.publish(events, store)
    except KeyboardInterrupt:
        last = None
    runs, hotspots = (spark.read.parquet(store.path(n)) for n in ("pipeline_runs", "environmental_hotspots"))
    seen = quality.latest_hotspots(hotspots, runs).collect()
    succeeded = [r.run_id for r in quality.current_runs(runs).where("status = 'SUCCEEDED'").collect()]
    assert len(seen) == 1 and seen[0].source_run_id in succeeded and (writes > 2 or seen[0].source_run_id == first)
    assert last is None or seen[0].source_run_id == last
    current = store.current(spark, "environmental_hotspots").collect()
    assert len(current) == 1 and (current[0].source_run_id == first) == (writes < 3)
    assert store.drop_leftovers(spark, "environmental_hotspots", dt.datetime.now(dt.timezone.utc) + dt.timedelta(seconds=5)) == (1 if writes in (2, 3, 4) else 0)
    assert [r.asDict() for r in store.current(spark, "environmental_hotspots").collect()] == [r.asDict() for r in current]


def test_two_publishers_of_one_batch(spark, tmp_path, monkeypatch):
    """A second publisher runs between the first one's write and its commit; the first gives way, others' batches do not matter."""
    store, events = quality.Store(str(tmp_path)), spark.createDataFrame([GOOD, ("e2", *GOOD[1:])], CLEAN)
    other = spark.createDataFrame([("e9", *GOOD[1:])], CLEAN)
    commit, between = quality.Store.commit, []

    def interleaved(self, *args):
        monkeypatch.setattr(quality.Store, "commit", commit)
        between.extend(quality.publish(e, self) for e in meanwhile)
        return commit(self, *args)

    for meanwhile, conflict in (([other], False), ([events, other], True)):
        between.clear()
        monkeypatch.setattr(quality.Store, "commit", interleaved)
        if conflict:
            with pytest.raises(commits.ConcurrentPublication):
                quality.publish(events, store)
        else:
            between.append(quality.publish(events, store))
        found = store.current(spark, "environmental_hotspots").collect()
        assert {r.source_run_id for r in found} == set(between) and len(found) == 2
        assert spark.read.parquet(store.path("environmental_hotspots")).count() == 2
    states = [r.status for r in quality.current_runs(spark.read.parquet(store.path("pipeline_runs"))).collect()]
    assert sorted(states) == ["FAILED"] + ["SUCCEEDED"] * 4


def test_one_writer_a_number(spark, tmp_path):
    log = commits.CommitLog(spark, str(tmp_path / "log"))
    assert log.version() == -1 and log.commit(-1, "a", "r1") is None
    assert not log._put({"version": 0, "batch_id": "b", "run_id": "r2"}) and log.live() == {"a": "r1"}
    assert log.commit(-1, "b", "r2") is None and log.commit(0, "a", "r3") == "r1"
    assert log.live() == {"a": "r3", "b": "r2"} and log.live(1) == {"a": "r1", "b": "r2"} and log.version() == 2
    assert sorted(p for p in os.listdir(tmp_path / "log") if not p.endswith(".crc")) == [f"{i:020d}.json" for i in range(3)]


def test_profiles_of_text(spark):
    names = [f.name for f in schemas.DEATHS]
    text = [tuple(None if v is None else str(v) for v in death(x=x)) for x in ("abc", "NaN", "Infinity", None, " ", "5", "-3")]
    raw = spark.createDataFrame(text, ", ".join(f"{n} string" for n in names))
    core = profiling.core_profile(profiling.typed(raw)).first()
    assert (core.invalid_numeric_victim_x, core.non_finite_coordinates, core.null_victim_x, core.blank_victim_x, core.one_coordinate_missing, core.negative_coordinates) == (1, 2, 1, 1, 3, 1)
    again = raw.unionByName(raw.where("victim_position_x = '5'"))
    copies = profiling.exact_duplicates(again, names).first()
    assert (copies.duplicate_groups, copies.duplicate_rows, copies.excess_rows) == (1, 2, 1)
    variants = profiling.event_candidates(again, names).first()
    assert (variants.candidate_groups, variants.candidate_rows, variants.variant_groups, variants.max_rows_per_key) == (1, 8, 1, 8)


def raw_deaths(spark, *rows):
    names = [f.name for f in schemas.DEATHS]
    text = [(*(None if v is None else str(v) for v in death(**{k: v for k, v in row.items() if k != "file"})), row.get("file", "f1")) for row in rows]
    return spark.createDataFrame(text, ", ".join(f"{n} string" for n in [*names, "source_file"]))


def test_event_keys(spark):
    names = [f.name for f in schemas.DEATHS]
    same = dict(time="60")
    raw = raw_deaths(spark, same, same, same | {"time": " 60.0", "file": "f2"}, same | {"killed_by": " Falling "}, same | {"match_id": " "}, same | {"match_id": " "}, same | {"time": "n/a"}, same | {"time": "n/a"}, same | {"victim_name": None}, same | {"killed_by": "AKM"}, same | {"killed_by": "AKM"})
    got = profiling.event_candidates(raw, names, "source_file").first()
    assert (got.candidate_groups, got.candidate_rows, got.excess_rows, got.max_rows_per_key, got.equal_groups, got.variant_groups, got.cross_file_groups) == (2, 6, 4, 4, 1, 1, 1)
    cause = profiling.event_candidates_by_cause(raw, names).collect()
    assert [(r.killed_by, r.candidate_groups, r.candidate_rows, r.variant_groups) for r in cause] == [("Falling", 1, 4, 1)]
    exact = profiling.exact_duplicates_by_cause(raw, names).collect()
    assert [(r.killed_by, r.duplicate_groups, r.duplicate_rows, r.excess_rows, r.most_copies) for r in exact] == [("Falling", 3, 6, 3, 2)]
    keys = profiling.key_completeness(raw).first()
    assert (keys.total_rows, keys.missing_match_id, keys.missing_victim_name, keys.invalid_or_missing_time, keys.missing_killed_by, keys.complete_keys) == (11, 2, 1, 2, 0, 6)


def test_related_fields_of_a_sentinel(spark):
    zero = dict(killed_by="Drown", x=0.0, y=0.0)
    raw = raw_deaths(spark, zero | {"killer_position_x": 0.0, "killer_position_y": 0.0}, zero | {"killer_name": " ", "victim_placement": "x"}, dict(killed_by="Drown", killer_name="b", killer_position_x="?"), dict(killed_by="Falling"))
    got = {r.position_group: tuple(r)[1:] for r in profiling.sentinel_related(profiling.typed(raw), "Drown").collect()}
    assert got == {"ZERO_ZERO": (2, 1, 0, 0, 1, 1), "NON_ZERO": (1, 0, 1, 1, 0, 0)}


def test_aggregate_profile(spark):
    rows = spark.createDataFrame([("m", "a", 1, 5), ("m", "a", 3, None), (None, "a", 0, 9), (None, "a", 2, 2), ("m", None, 7, 1)], "match_id string, player_name string, player_kills long, player_dmg long")
    assert tuple(profiling.aggregate_profile(rows).first()) == (5, 2, 1, 0, 7, 1, 9, 2, 2)
    assert tuple(profiling.aggregate_profile(rows.limit(0)).first()) == (0, 0, 0, None, None, None, None, 0, 0)
    assert profiling.aggregate_profile(rows, 3).first().row_count == 3


def test_distance_summary(spark):
    def at(scope, kind, gun, median, n=50):
        return (scope, kind, gun, n, median, 300)

    rows = [at("ALL", "SR", None, 90.0), at("ALL", "Shotgun", None, 9.5), at("ALL", "DMR", None, 60.0), at("ALL", "SR", "AWM", 95.0), at("ALL", "DMR", "SKS", 70.0), at("ALL", "DMR", "Mk14", 70.0), at("ALL", "DMR", "VSS", 30.0), at("ALL", "AR", "AKM", 95.0)]
    rows += [at("ERANGEL", "SR", "AWM", 90.0), at("MIRAMAR", "SR", "AWM", 80.0), at("ERANGEL", "DMR", "SKS", 60.0), at("MIRAMAR", "DMR", "SKS", 61.0), at("ERANGEL", "DMR", "VSS", 30.0), at("ERANGEL", "AR", "M416", 1.0), at("MIRAMAR", "AR", "M416", 9.0)]
    profiles = spark.createDataFrame(rows, "scope string, weapon_class string, killed_by string, event_count long, median_distance_m double, valid_event_count long")
    assert [(r.killed_by, r.median_gap_m, r.absolute_gap_m) for r in distance.distance_map_gaps(profiles).collect()] == [("AWM", -10.0, 10.0), ("SKS", 1.0, 1.0)]
    got = distance.distance_summary(profiles).first().asDict()
    assert got == dict(valid_event_count=300, weapon_count=5, class_count=3, map_comparison_count=2, median_map_gap_m=5.5, shotgun_median_m=9.5, sr_median_m=90.0, role_median_spread_m=80.5, shortest_dmr="VSS", shortest_dmr_median_m=30.0, longest_dmr="Mk14", longest_dmr_median_m=70.0, longest_weapon="AKM", longest_weapon_median_m=95.0)
    listed = [(r.scope, r.weapon_class, r.killed_by) for r in distance.report_order(profiles).collect()]
    assert listed[:5] == [("ALL", "Shotgun", None), ("ALL", "AR", "AKM"), ("ALL", "DMR", None), ("ALL", "DMR", "Mk14"), ("ALL", "DMR", "SKS")]


def test_eligibility_with_missing_positions(spark):
    raw = spark.createDataFrame([death(), death(), death(x=None), death(map=None)], schemas.DEATHS)
    dates = profiling.match_dimension(spark.createDataFrame([("m1", "2017-10-20")], "match_id string, date string"))
    flags = profiling.eligibility(raw, dates, [n for n in raw.columns if n != "killed_by"])
    funnel = profiling.eligibility_funnel(flags).first()
    assert (funnel.raw_rows, funnel.after_exact_dedup, funnel.after_map, funnel.final_eligible_rows) == (4, 3, 2, 1)
    assert {r.primary_status: r.unique_rows for r in profiling.primary_reasons(flags).collect()} == {"ELIGIBLE": 2, "MISSING_MAP": 1}


def test_csv_union_by_name_and_drift(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("x,y\n1,p\n,q\n")
    (tmp_path / "a2.csv").write_text("y,x\nr,2\n")
    (tmp_path / "b.csv").write_text("x,z\nfoo,1\n")
    both = csv.read_csv(spark, f"{tmp_path}/a*.csv")
    assert sorted(map(tuple, both.collect()), key=str) == [("1", "p"), ("2", "r"), (None, "q")]
    assert csv.schema_check(spark, f"{tmp_path}/a1.csv") == []
    assert len(csv.schema_check(spark, f"{tmp_path}/a*.csv")) == 1
    with pytest.raises(ValueError):
        csv.require_same_schema(spark, f"{tmp_path}/*.csv")
    every = csv.read_csv(spark, f"{tmp_path}/*.csv", with_file=True)
    assert every.count() == 4 and every.where("z = '1'").first().source_file.endswith("b.csv")
    typed = csv.read_typed_csv(spark, f"{tmp_path}/a*.csv")
    assert dict(typed.dtypes) == {"x": "int", "y": "string"} and typed.agg(F.sum("x")).first()[0] == 3
    assert dict(csv.read_typed_csv(spark, f"{tmp_path}/*.csv").dtypes) == {"x": "string", "y": "string", "z": "int"}
    assert csv.inferred(spark, f"{tmp_path}/a1.csv", rows=1)["x"].dataType.simpleString() == "int"
    with gzip.open(tmp_path / "c.csv.gz", "wt") as out:
        out.write('\ufeff"x, y",z\n1,2\n')
    assert csv.header(spark, f"{tmp_path}/c.csv.gz") == ["x, y", "z"]
    os.utime(tmp_path / "a1.csv", (4e9, 4e9))
    assert csv.newest_file(spark, f"{tmp_path}/*.csv").endswith("a1.csv")


def test_sinks_replace_whole(spark, tmp_path):
    path = f"{tmp_path}/out"
    for n in (3, 2):
        sinks.write_parquet(spark.range(n), path)
        assert spark.read.parquet(path).count() == n
    (tmp_path / "out").rename(tmp_path / "out.old")  # as a write leaves it that broke off between its renames
    with pytest.raises(Exception):
        sinks._replace(spark, f"{tmp_path}/none", path)
    assert spark.read.parquet(path).count() == 2
    sinks.write_csv(spark.range(3), path, F.desc("id"))
    assert [r[0] for r in spark.read.option("header", True).csv(path).collect()] == ["2", "1", "0"]
    page = sinks.html_report("<script>__DATA__</script>", "__DATA__", spark.createDataFrame([("</script>",)], "t string"))
    assert page.count("</script>") == 1 and json.loads(page[8:-9].replace("<\\/", "</"))["rows"] == [{"t": "</script>"}]


def test_telemetry(spark):
    gun = {"damageTypeCategory": "Gun", "damageReason": "", "damageCauserName": 0}
    events = [{"_T": "LogPlayerKillV2", "victim": {"location": {"x": 0, "y": 0.0}}, "finishDamageInfo": gun}, {"_T": "LogPlayerKill", "victim": {"location": {"x": "12", "y": 1}}, "killerDamageInfo": gun, "dBNODamageInfo": 5}, {"victim": {}}, 7, "text", None, [], {"_T": ""}, {"_T": "Other"}]
    files = spark.createDataFrame([("m", json.dumps(events)), ("n", "[1]")], "match_id string, value string")
    each = telemetry.explode_events(files)
    got = {r.match_id: r for r in telemetry.telemetry_profile(each).collect()}
    m = got["m"]
    assert (m.event_count, m.object_events, m.event_types, m.kill_events, m.located_kills, m.zero_zero_kills, m.untyped_events, m.with_finishDamageInfo, m.with_dBNODamageInfo) == (9, 5, 4, 2, 1, 1, 2, 1, 0)
    assert m.kill_keys == ["_T", "dBNODamageInfo", "finishDamageInfo", "killerDamageInfo", "victim"] and (got["n"].event_count, got["n"].object_events) == (1, 0)
    assert {r.event_type: r.event_count for r in telemetry.event_type_counts(each).collect()} == {"UNKNOWN": 2, "LogPlayerKill": 1, "LogPlayerKillV2": 1, "Other": 1}
    assert [tuple(r) for r in telemetry.damage_values(each).collect()] == [("damage_type", "Gun", 2)]
    details = spark.createDataFrame([("m", "E", None, "2020"), ("n", "", "solo", None)], "match_id string, map_name string, game_mode string, created_at string")
    profiles = telemetry.match_profiles(details, each)
    assert {tuple(r) for r in telemetry.pilot_counts(profiles).collect()} == {("map_name", "E", 1), ("map_name", "UNKNOWN", 1), ("game_mode", "solo", 1), ("game_mode", "UNKNOWN", 1)}
    assert tuple(telemetry.pilot_summary(profiles).first()) == (2, "2020", "2020", 5, 2, 1, 1)
    windows = telemetry.sample_windows(dt.datetime(2020, 3, 1, 23, 30, tzinfo=dt.timezone(dt.timedelta(hours=-2))), 3)
    assert windows == [("latest_2020-03-02", None), ("ending_2020-03-01", "2020-03-01T00:00:00Z"), ("ending_2020-02-29", "2020-02-29T00:00:00Z")]
    lists = [("w1", ["a", "b", "a", ""]), ("w2", ["b", "c"])]
    samples = spark.createDataFrame([(w, json.dumps({"data": {"relationships": {"matches": {"data": [{"id": i} for i in ids]}}}})) for w, ids in lists], "window string, value string")
    assert [tuple(r) for r in telemetry.sample_summary(samples).orderBy("window").collect()] == [("w1", 3, 2), ("w2", 2, 2)]
    assert tuple(telemetry.sample_totals(samples).first()) == (2, 5, 3)
    assert [r[0] for r in telemetry.first_matches(samples, 3).collect()] == ["a", "b", "c"]
    with pytest.raises(ValueError):
        telemetry.first_matches(samples, 4)
    detail = {"data": {"attributes": {"mapName": "E", "gameMode": "solo", "createdAt": "t"}}, "included": [{"type": "asset", "attributes": {"name": "telemetry", "URL": "u"}}]}
    assert tuple(telemetry.match_details(spark.createDataFrame([(json.dumps(detail),)], "value string")).first()) == ("E", "solo", "t", "u")


def test_types_of_csv_columns_merge_over_files(spark, tmp_path):
    (tmp_path / "a1.csv").write_text("n,m,d,t,e\n1,1,2020-01-01,x,\n,2.5,2020-02-30,,\n")
    (tmp_path / "a2.csv").write_text("m,n,d\n3000000000,-7,2020-03-01\n1e3,+8,\n")
    (tmp_path / "a3.csv").write_text("n,q\n99999999999999999999,1\n")
    (tmp_path / "a4.csv").write_text("n\n")
    kinds = csv.column_kinds(spark, f"{tmp_path}/*.csv")
    own = {(r.file[-6:-4], r["column"]): (r.type, r.filled) for r in csv.column_types(kinds, "file", "column").collect()}
    assert own == {
        ("a1", "n"): ("int", 1), ("a1", "m"): ("double", 2), ("a1", "d"): ("string", 2), ("a1", "t"): ("string", 1), ("a1", "e"): ("void", 0),
        ("a2", "m"): ("double", 2), ("a2", "n"): ("int", 2), ("a2", "d"): ("date", 1), ("a3", "n"): ("double", 1), ("a3", "q"): ("int", 1), ("a4", "n"): ("void", 0),
    }
    merged = {r["column"]: (r.type, r.files) for r in csv.column_types(kinds, "column").collect()}
    assert merged == {"n": ("double", 4), "m": ("double", 2), "d": ("string", 2), "t": ("string", 1), "e": ("void", 1), "q": ("int", 1)}
    assert dict(csv.read_typed_csv(spark, f"{tmp_path}/a[12].csv").dtypes) == {"n": "int", "m": "double", "d": "string", "t": "string", "e": "string"}
    assert any("d is date, not string" in what for _, what in csv.schema_check(spark, f"{tmp_path}/a[12].csv"))


def test_date_link_fails_on_a_doubled_match(spark):
    events = spark.createDataFrame([("m1", 1), ("m2", 2)], "match_id string, n int")
    dates = spark.createDataFrame([("m1", DAY, 1), ("m2", DAY, 1)], "match_id string, match_date date, date_count long")
    assert clean.link_dates(events, dates).where("date_status = 'valid_date'").count() == 2
    with pytest.raises(Exception, match="match_id m1 is not unique"):
        clean.link_dates(events, dates.unionByName(dates.limit(1))).collect()
    grouped = clean.match_dates(spark.createDataFrame([("m1", "2017-10-20")], "match_id string, date string"))
    exchanges = [d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") for d in (grouped, clean.unique_by(grouped, "match_id"))]
    assert exchanges[0] == exchanges[1]


def test_broken_documents_are_counted(spark, tmp_path):
    asset = lambda name, url: {"type": "asset", "attributes": {"name": name, "URL": url}}
    good = {"data": {}, "included": [asset("telemetry", "u")]}
    documents = [good, good, {"data": 1, "included": []}, {"data": {}}, {"data": {}, "included": [asset("x", "u")]}, {"data": {}, "included": [asset("telemetry", "")]}]
    rows = [(str(i), json.dumps(d)) for i, d in enumerate(documents)] + [("6", "{"), ("7", None)]
    checked = telemetry.checked_matches(spark.createDataFrame(rows, "match_id string, value string"))
    assert {r.match_id: r.fault for r in checked.collect()} == {"0": None, "1": None, "2": "NO_DATA", "3": "NO_INCLUDED", "4": "NO_TELEMETRY", "5": "NO_TELEMETRY", "6": "NOT_JSON", "7": "NOT_JSON"}
    report = telemetry.collection_report(checked, spark.createDataFrame([("0", "{}"), ("0", "{}"), ("2", "{}")], "match_id string, event string")).first()
    assert report.asDict() == dict(requested=8, succeeded=1, failed=7, not_json=2, no_data=1, no_included=1, no_telemetry=2, no_events=1, event_count=2)
    for value in (report.asDict(), {"again": "é"}):
        sinks.write_json(spark, value, f"{tmp_path}/summary.json")
        assert json.loads((tmp_path / "summary.json").read_text()) == value
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.endswith(".crc")) == ["summary.json"]


def test_cells_of_several_sizes_and_their_parents(spark):
    rnd = random.Random(5)
    events = events_at(spark, [(rnd.choice(["Drown", "Falling"]), f"m{rnd.randrange(9)}", rnd.choice([0, 816000, rnd.random() * 816000]), rnd.random() * 90000) for _ in range(300)] + [("Drown", None, 5, 5)])
    cells = grid.cell_pyramid(events, (100, 250, 500))
    for size in (100, 250, 500):
        own = cells.where(F.col("grid_size_m") == size).drop("grid_size_m")
        assert sorted(map(tuple, own.collect())) == sorted(map(tuple, grid.cell_counts(events, size).collect()))
    parents = grid.cell_parents(cells).collect()
    fine = cells.where("grid_size_m = 100").count()
    assert len(parents) == 2 * fine and all(r.covered_pct == 100 or r.parent_size_m == 250 for r in parents)
    assert {r.overlapped for r in parents if r.parent_size_m == 500} == {1} and max(r.overlapped for r in parents if r.parent_size_m == 250) > 1
    assert "NestedLoop" not in grid.cell_parents(cells)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sizes", [(10, 100, 250, 500), (7, 11, 1)])
def test_pyramid_of_odd_places_and_days(spark, sizes):
    """Missing and negative places, days before 1970, no date, no match: as counted size by size, and no row for each event and size."""
    rnd, far = random.Random(8), [None, -1.0, -99_999.5, 0.0, 816_000.0]
    place, day = (lambda: rnd.choice([*far, *(rnd.random() * 90_000 for _ in range(20))])), (lambda: rnd.choice([None, DAY, dt.date(1969, 12, 31), dt.date(1, 1, 3), dt.date(1970, 1, 1) + dt.timedelta(rnd.randrange(200))]))
    rows = [(f"e{i}", rnd.choice(["Falling", None]), rnd.choice(["ERANGEL", None]), rnd.choice([None, " ", *(f"m{j}" for j in range(9))]), day(), place(), place()) for i in range(400)]
    events = spark.createDataFrame([*rows, ("n", "Drown", "ERANGEL", None, None, 1.0, 1.0)], CLEAN)
    cells = grid.cell_pyramid(events, sizes)
    for size in sizes:
        own = cells.where(F.col("grid_size_m") == size).drop("grid_size_m")
        plain = grid.cell_counts(events, size)
        assert own.dtypes == plain.dtypes and Counter(map(tuple, own.collect())) == Counter(map(tuple, plain.collect()))
    plan = cells._jdf.queryExecution().optimizedPlan().toString()
    assert not any("match_id" in line and "grid_size_m" in line for line in plan.splitlines())


def test_duplicates_when_the_filter_is_full(spark, monkeypatch):
    monkeypatch.setattr(profiling, "FILTER_LOG", 7)
    rnd = random.Random(2)
    rows = [dict(match_id=rnd.choice(["m", "n", " ", f"r{i}"]), time=str(rnd.randrange(3)), file=rnd.choice("ab"), killed_by=rnd.choice(["Falling", "Drown"])) for i in range(400)]
    raw, names = raw_deaths(spark, *rows), [f.name for f in schemas.DEATHS]
    sizes, keys = {}, {}
    for r in raw.collect():
        sizes.setdefault(tuple(r)[:-1], []).append(r.source_file)
        if r.match_id.strip():
            keys.setdefault((r.match_id, r.time, r.killed_by), []).append(r)
    several = [v for v in sizes.values() if len(v) > 1]
    got = profiling.exact_duplicates(raw, names, "source_file").first()
    assert (got.duplicate_groups, got.duplicate_rows, got.cross_file_groups) == (len(several), sum(map(len, several)), sum(len(set(v)) > 1 for v in several))
    found = profiling.event_candidates(raw, names, "source_file").first()
    assert (found.candidate_groups, found.candidate_rows) == (sum(len(v) > 1 for v in keys.values()), sum(len(v) for v in keys.values() if len(v) > 1))


def a_database(spark):
    return database.Database(spark, f"jdbc:derby:memory:test-{uuid.uuid4()};create=true")


def test_publication_to_a_database(spark):
    db = a_database(spark)
    assert db.create(serving.TABLES) == list(serving.TABLES) and db.create(serving.TABLES) == []
    events = spark.createDataFrame([GOOD, ("e2", *GOOD[1:]), ("e3", *GOOD[1:5], 500000.0, 1.0)], CLEAN)
    first, second = serving.publish(events, db), serving.publish(events.repartition(3), db)
    failed = serving.publish(spark.createDataFrame([(None, *GOOD[1:])], CLEAN), db)
    runs = {r.run_id: r for r in db.read("pipeline_runs").collect()}
    assert {k: (r.status, r.quality_status, r.output_rows, r.input_rows) for k, r in runs.items()} == {first: ("SUCCEEDED", "PASS", 2, 3), second: ("SUCCEEDED", "PASS", 2, 3), failed: ("FAILED", "FAIL", 0, 1)}
    assert runs[first].batch_id == runs[second].batch_id != runs[failed].batch_id and runs[failed].error_message
    spots = db.read("environmental_hotspots").collect()
    assert len(spots) == 2 and {r.source_run_id for r in spots} == {second} and db.read("staged_hotspots").count() == 0
    checks = db.read("quality_check_results").groupBy("run_id").agg(F.count("*").alias("n"), F.sum("error_count").alias("e")).collect()
    assert {r.run_id: (r.n, r.e > 0) for r in checks} == {first: (10, False), second: (10, False), failed: (10, True)}
    # rows that a task staged twice count once
    cells = grid.heatmap_cells(events)
    assert serving.replace_batch(db, cells.unionByName(cells), "again", "other", []) == [0, 2]


def test_a_database_that_executors_do_not_reach(spark, monkeypatch):
    """Rows of an embedded database never go by Spark's own writer and reader, which run on the executors."""
    kinds = "name varchar(20), n bigint, x double, seen timestamp"
    rows = [("a ' \" ,", 1, 0.1 + 0.2, dt.datetime(2020, 1, 2, 3, 4, 5, 678)), (None, None, None, None), ("é", -(2**60), 1e-7, dt.datetime(2020, 1, 2))] + [(f"r{i}", i, i / 7, None) for i in range(2100)]
    db = database.Database(spark, f"jdbc:derby:memory:test-{uuid.uuid4()};create=true", embedded=True)
    db.create({"told": kinds})
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.jdbc", None)
    db.append(spark.createDataFrame(rows, "name string, n long, x double, seen timestamp").repartition(3), "told")
    found = db.read("(select * from told where n is null or n < 3000) as t")
    assert "JDBC" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.dtypes == [("name", "string"), ("n", "bigint"), ("x", "double"), ("seen", "timestamp")]
    assert Counter(map(tuple, found.collect())) == Counter(rows)
    with pytest.raises(Exception, match="Invalid character string format"):
        db.append(spark.createDataFrame([("b", "1"), ("b", "x")], "name string, n string").coalesce(1), "told")
    assert db.read("(select * from told where name = 'b') as t").count() == 0


def test_served_hotspots_on_a_cluster(spark, monkeypatch):
    """As if on a cluster: nothing asks where the executors are, and none of them opens the database."""
    from isopleth.plans import queries

    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    monkeypatch.setattr("pyspark.sql.DataFrameWriter.jdbc", None)
    found = queries.queries()["served_hotspots"](spark, "/root/testdata/sf0.001")
    assert "JDBC" not in found._jdf.queryExecution().executedPlan().toString()
    plain = queries.queries()["heatmap_cells"](spark, "/root/testdata/sf0.001").select(*found.columns)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, plain.collect()))


@pytest.mark.parametrize("broken", range(14))
def test_database_publication_breaks_off(spark, monkeypatch, broken):
    db = a_database(spark)
    events = spark.createDataFrame([GOOD, ("e2", *GOOD[1:])], CLEAN)
    first, execute, done = serving.publish(events, db), database.Database._execute, []

    def at_most(self, connection, statement):
        if statement[0].startswith(("delete from env", "insert into env", "insert into qual", "update")) and "FAILED" not in statement[1]:
            if len(done) == broken:
                done.append(None)
                raise KeyboardInterrupt
            done.append(statement)
        return execute(self, connection, statement)

    monkeypatch.setattr(database.Database, "_execute", at_most)
    try:
        last = serving.publish(events, db)
    except KeyboardInterrupt:
        last = None
    monkeypatch.setattr(database.Database, "_execute", execute)
    spots = db.read("environmental_hotspots").collect()
    statuses = sorted(r.status for r in db.read("pipeline_runs").collect())
    assert [r.source_run_id for r in spots] == [last or first] and statuses == (["SUCCEEDED"] * 2 if last else ["FAILED", "SUCCEEDED"])
    assert (last is None) == (broken < 13) and db.read("quality_check_results").count() == (20 if last else 10) and db.read("staged_hotspots").count() == 0


def checksum(data, size):
    """Number of ranges, lines and the digest of a file's bytes, line by line."""
    lines = data.split(b"\n")
    if lines[-1] == b"":
        lines.pop()
    at, parts = 0, {}
    for line in lines:
        text = line.removeprefix(b"\xef\xbb\xbf") if at == 0 else line
        parts.setdefault(max(at - 1, 0) // size, []).append(text + b"\n")
        at += len(line) + 1
    digests = [hashlib.sha256(b"".join(parts[k])).hexdigest() for k in sorted(parts)]
    return len(digests), len(lines), hashlib.sha256(f"{len(data)}:{size}:{','.join(digests)}".encode()).hexdigest()


def test_checksums_of_files(spark, tmp_path):
    rng = random.Random(3)
    files = {
        "empty": b"", "line": b"a", "closed": b"a\n", "blank": b"\n\n\n", "returns": b"a\r\nb\rc\n", "marked": b"\xef\xbb\xbfa\n", "not utf-8": b"\xff\xfe\n\x00\xc3", "long": b"x" * 500 + b"\n" + b"y" * 130,
        "mixed": b"".join(bytes(rng.randrange(256) for _ in range(rng.randrange(40))) + b"\n" for _ in range(300)), "even": b"1234567\n" * 64,
    }
    files["copy"] = files["mixed"]
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.file).replace("%20", " "): r for r in checksums.file_digests(spark, f"file:{tmp_path}/*", 64).collect()}
    assert {n: (got[n].bytes, got[n].ranges, got[n].lines, got[n].sha256) for n in got} == {n: (len(d), *checksum(d, 64)) for n, d in files.items()}
    assert len({r.sha256 for r in got.values()}) == len(files) - 1
    names = checksums.file_digests(spark, f"file:{tmp_path}/*", 64).select("file", "sha256")
    before = quality.content_digest(names)
    (tmp_path / "line").write_bytes(b"b")
    assert quality.content_digest(names) != before
    many = checksums.file_digests(spark, f"file:{tmp_path}/*").where("file like '%mixed'").collect()  # the whole file in one range
    assert (many[0].ranges, many[0].lines) == (1, checksum(files["mixed"], 64)[1])


def test_first_rows_and_columns(spark):
    rows = spark.createDataFrame([("b", 1, "x"), (None, 2, "y"), ("b", None, "x"), ("a", 3, None)], "match_id string, `odd name` int, text string")
    assert [tuple(r) for r in profiling.first_rows(rows, 3).collect()] == [(None, 2, "y"), ("a", 3, None), ("b", None, "x")]
    assert profiling.first_rows(rows.limit(0)).count() == 0
    assert profiling.column_list(rows) == [(0, "match_id", "string", True), (1, "odd name", "int", True), (2, "text", "string", True)]


def test_kinds_of_values_are_found_once(spark, tmp_path):
    """A value is held against each pattern once, in one projection."""
    values = ["7", " -7 ", "+3000000000", "99999999999999999999", "1.5", ".5e3", "1e", "2020-02-29", "2020-02-30", "x", "", "  "]
    (tmp_path / "a.csv").write_text("v\n" + "".join(f'"{v}"\n' for v in values))
    found = csv.column_kinds(spark, f"{tmp_path}/*.csv")
    row = found.first()
    assert (row.kinds, row.filled) == (1 | 2 | 4 | 8 | 16, 10)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(p) for p in (r"[+-]?\d+$", r"(\d+\.?\d*|", r"\d{4}-")] == [1, 1, 1]
    each = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    assert [r[0] for r in each.orderBy("i").select(csv._kind(F.col("v"))).collect()] == [1, 1, 2, 4, 4, 4, 16, 8, 16, 16, 0, 0]
