"""Registered queries of the event operators, over stand-ins for the domain's inputs."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import clean, distance, grid, profiling, quality, serving, telemetry
from ..schemas import DEATHS
from ..sources import checksums, csv, database, sinks
from ..sources.interim import settled, shared_folder
from . import standins as S

Query = Callable[[SparkSession, str], DataFrame]
FOCUS_MAP, FOCUS_CAUSE = "A", "F"
#: Weapons of the raw stand-in have some dozens of events on a map at the smallest scale.
MIN_WEAPON_EVENTS = 20
#: Matches that a pilot looks at.
FIRST_MATCHES = 12
#: Bytes of a range in file_checksums, small enough that files have several.
RANGE_BYTES = 65_536
DEATH_COLUMNS = [f.name for f in DEATHS]


def _events(then: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: then(S.stand_in(spark, sf_dir, S.EVENTS))


def _deaths(then: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: then(S.stand_in(spark, sf_dir, S.DEATHS))


def _profiled(then: Callable[[DataFrame], DataFrame]) -> Query:
    return _deaths(lambda raw: then(profiling.typed(raw)))


def _raw(then: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: then(S.stand_in(spark, sf_dir, S.RAW_DEATHS))


def _raw_profiled(then: Callable[[DataFrame], DataFrame]) -> Query:
    return _raw(lambda raw: then(profiling.typed(raw)))


def _both(then: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: then(S.stand_in(spark, sf_dir, S.DEATHS), S.stand_in(spark, sf_dir, S.AGGREGATE))


def _flags(then: Callable[[DataFrame], DataFrame]) -> Query:
    columns = [c for c in DEATH_COLUMNS if c != "killed_by"]
    return _both(lambda raw, aggregate: then(profiling.eligibility(raw, profiling.match_dimension(aggregate), columns)))


def _telemetry(then: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: then(S.stand_in(spark, sf_dir, S.TELEMETRY))


def _matches(then: Callable[[DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        details = telemetry.match_details(S.stand_in(spark, sf_dir, S.MATCHES))
        return then(telemetry.match_profiles(details, S.stand_in(spark, sf_dir, S.TELEMETRY)))

    return run


def _profiles(raw: DataFrame) -> DataFrame:
    tidy = raw.withColumn("map", F.upper(F.trim("map")))
    return distance.distance_profiles(distance.distance_events(tidy), MIN_WEAPON_EVENTS)


def _resolutions(events: DataFrame) -> DataFrame:
    cells = settled(grid.cell_pyramid(events, (100, 250)))
    return grid.resolution_comparison(*(grid.candidates(cells.where(F.col("grid_size_m") == m), m) for m in (100, 250)))


def _csv_files(spark: SparkSession, sf_dir: str) -> str:
    """CSV files in four folders; the glob that names them."""
    folder = f"{shared_folder(spark)}/csv-{uuid.uuid4()}"
    S.stand_in(spark, sf_dir, S.CSV_ROWS).write.partitionBy("file").option("header", True).csv(folder)
    return f"{folder}/*/*.csv"


def _folder(file: str) -> Column:
    return F.regexp_extract(file, "/file=([^/]*)/", 1)


def _csv_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of the columns of CSV files, by the folder that they lie in."""
    kinds = csv.column_kinds(spark, _csv_files(spark, sf_dir))
    return csv.column_types(kinds.withColumn("folder", _folder("file")), "folder", "column").select("folder", "column", "type", "filled")


def _csv_profile(rows: DataFrame) -> DataFrame:
    told = (f(c).alias(f"{n}_{c}") for c in ("part_id", "quantity", "shipped") for n, f in (("filled", F.count), ("most", F.max)))
    return rows.groupBy(_folder("source_file").alias("folder")).agg(F.count("*").alias("row_count"), *told)


def _csv_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV files read under a schema, values that do not parse being null, with the file of each row."""
    schema = T.StructType.fromDDL("order_id long, part_id long, quantity double, shipped date, flag string")
    return _csv_profile(csv.read_csv(spark, _csv_files(spark, sf_dir), schema, with_file=True))


def _csv_typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files read under the types that all their rows bear out: quantity is text, as some rows of one file are words."""
    return _csv_profile(csv.read_typed_csv(spark, _csv_files(spark, sf_dir), with_file=True))


def _written_cells(events: DataFrame) -> DataFrame:
    """Heatmap cells written to Parquet twice, the second time in place of the first, and read back."""
    spark = events.sparkSession
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4()}"
    cells = settled(grid.heatmap_cells(events))
    for _ in range(2):
        sinks.write_parquet(cells, path)
    return spark.read.parquet(path)


def _written_report(events: DataFrame) -> DataFrame:
    """The hotspot report's cells as one sorted CSV file, read back as text."""
    spark = events.sparkSession
    path = f"{shared_folder(spark)}/report-{uuid.uuid4()}"
    sinks.write_csv(grid.grid_metrics(events, 250).select(*grid.GROUP, "grid_x", "grid_y", "death_count", "first_death_date"), path, *grid.GROUP, "grid_x", "grid_y")
    return csv.read_csv(spark, f"{path}/*.csv")


def _checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of text files, each of the lines of a range of orders in order."""
    folder = f"{shared_folder(spark)}/lines-{uuid.uuid4()}"
    S.stand_in(spark, sf_dir, S.LINES).repartition("file").sortWithinPartitions("file", "line").write.partitionBy("file").text(folder)
    found = checksums.file_digests(spark, f"{folder}/*/*.txt", RANGE_BYTES)
    return found.withColumn("file", _folder("file"))


def _collection(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = telemetry.checked_matches(S.stand_in(spark, sf_dir, S.DOCUMENTS))
    return telemetry.collection_report(checked, S.stand_in(spark, sf_dir, S.DOCUMENT_EVENTS))


def _served(events: DataFrame) -> DataFrame:
    """Hotspots, which are bounded for each group, published twice to a database in the driver's process and read back."""
    spark = events.sparkSession
    db = database.Database(spark, f"jdbc:derby:memory:isopleth-{uuid.uuid4()};create=true", embedded=True)
    db.create(serving.TABLES)
    cells = settled(grid.heatmap_cells(events))
    for run in ("first", "second"):
        serving.replace_batch(db, cells, run, "batch", [])
    found = db.read("(select * from environmental_hotspots where source_run_id = 'second') as served")
    return found.drop("batch_id", "source_run_id", "published_at")


def _linked(raw: DataFrame, aggregate: DataFrame) -> DataFrame:
    valid = clean.classify_events(raw).where("quality_status = 'quality_valid'")
    return clean.link_dates(valid, clean.match_dates(aggregate))


def _samples(then: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: then(S.stand_in(spark, sf_dir, S.SAMPLES))


def _plain(query: Query) -> Query:
    """Dates and times as text, so that any two engines' results compare."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = query(spark, sf_dir)
        return found.select(*(F.col(c).cast("string").alias(c) if kind in ("date", "timestamp", "timestamp_ntz") else F.col(c) for c, kind in found.dtypes))

    return run


def queries() -> dict[str, Query]:
    return {name: _plain(query) for name, query in _queries().items()}


def _queries() -> dict[str, Query]:
    return {
        "grid_250": _events(lambda e: grid.grid_metrics(e, 250)),
        "grid_100": _events(lambda e: grid.grid_metrics(e, 100)),
        "heatmap_cells": _events(grid.heatmap_cells),
        "detail_cells": _events(grid.detail_cells),
        "hotspot_report": _events(lambda e: grid.hotspot_report(grid.grid_metrics(e, 250))),
        "report_extras": _events(lambda e: grid.with_report_extras(grid.grid_metrics(e, 100)).select(*grid.GROUP, "grid_x", "grid_y", "repeat_rate", "pixel_x", "pixel_y")),
        "resolution_comparison": _events(_resolutions),
        "grid_pyramid": _events(grid.cell_pyramid),
        "cell_parents": _events(lambda e: grid.cell_parents(settled(grid.cell_pyramid(e, (100, 250, 500))))),
        "candidate_lift": _events(lambda e: grid.candidate_lift(e, e, FOCUS_MAP, FOCUS_CAUSE, 2, (FOCUS_CAUSE, "O"))),
        "distance_profiles": _deaths(lambda raw: distance.report_order(_profiles(raw))),
        "distance_map_gap": _deaths(lambda raw: distance.distance_map_gaps(_profiles(raw))),
        "distance_summary": _deaths(lambda raw: distance.distance_summary(_profiles(raw))),
        "classify_status": _deaths(lambda raw: clean.classify_events(raw).groupBy("map", "killed_by", "quality_status").agg(F.count("*").alias("row_count"))),
        "classified_events": _deaths(clean.classify_events),
        "match_date_quality": lambda spark, sf_dir: clean.match_dates(S.stand_in(spark, sf_dir, S.AGGREGATE)),
        "date_link_status": _both(lambda raw, aggregate: _linked(raw, aggregate).groupBy("date_status", "killed_by").agg(F.count("*").alias("row_count"), F.count_distinct("date").alias("dates"))),
        "clean_events": _both(clean.clean_events),
        "stage_funnel": _both(clean.stage_funnel),
        "quality_checks": lambda spark, sf_dir: quality.quality_checks(S.stand_in(spark, sf_dir, S.GATED)),
        "exact_duplicates": _raw(lambda raw: profiling.exact_duplicates(raw, DEATH_COLUMNS, "source_file")),
        "exact_duplicates_by_cause": _raw(lambda raw: profiling.exact_duplicates_by_cause(raw, DEATH_COLUMNS)),
        "event_candidates": _raw(lambda raw: profiling.event_candidates(raw, DEATH_COLUMNS, "source_file")),
        "event_candidates_by_cause": _raw(lambda raw: profiling.event_candidates_by_cause(raw, DEATH_COLUMNS)),
        "key_completeness": _raw(profiling.key_completeness),
        "aggregate_profile": lambda spark, sf_dir: profiling.aggregate_profile(S.stand_in(spark, sf_dir, S.PLAYERS)),
        "aggregate_head": lambda spark, sf_dir: profiling.first_rows(S.stand_in(spark, sf_dir, S.PLAYERS)),
        "eligibility_funnel": _flags(profiling.eligibility_funnel),
        "primary_reasons": _flags(profiling.primary_reasons),
        "exclusion_combos": _flags(profiling.exclusion_combinations),
        "eligible_by_map": _flags(profiling.final_by_map),
        "reconciliation": _flags(profiling.reconciliation),
        "core_profile": _profiled(profiling.core_profile),
        "group_profile": _profiled(lambda p: profiling.group_profile(p, "map")),
        "file_profile": _raw_profiled(lambda p: profiling.group_profile(p, "source_file")),
        "map_completeness": _profiled(profiling.map_completeness),
        "missing_maps_by_cause": _profiled(profiling.missing_maps_by_cause),
        "bounds_report": _profiled(profiling.bounds_report),
        "bounds_examples": _profiled(profiling.bounds_examples),
        "sentinel_profile": _profiled(lambda p: profiling.sentinel_summary(p, "Drown")),
        "sentinel_by_map": _profiled(lambda p: profiling.sentinel_by(p, "Drown", "map")),
        "sentinel_by_file": _raw_profiled(lambda p: profiling.sentinel_by(p, "Drown", "source_file")),
        "sentinel_related": _raw_profiled(lambda p: profiling.sentinel_related(p, "Drown")),
        "time_quantiles": _profiled(lambda p: profiling.sentinel_times(p, "Drown")),
        "latest_runs": lambda spark, sf_dir: quality.latest_runs(S.stand_in(spark, sf_dir, S.RUNS)),
        "latest_hotspots": lambda spark, sf_dir: quality.latest_hotspots(S.stand_in(spark, sf_dir, S.HOTSPOTS), S.stand_in(spark, sf_dir, S.RUNS), "p1"),
        "served_hotspots": _events(_served),
        "quality_run_summary": lambda spark, sf_dir: quality.quality_summary(S.stand_in(spark, sf_dir, S.RUNS), S.stand_in(spark, sf_dir, S.RESULTS)),
        "json_event_profile": _telemetry(lambda e: telemetry.telemetry_profile(e).withColumn("kill_keys", F.array_join("kill_keys", ","))),
        "event_type_counts": _telemetry(telemetry.event_type_counts),
        "damage_values": _telemetry(telemetry.damage_values),
        "damage_keys": _telemetry(telemetry.damage_keys),
        "telemetry_totals": _telemetry(lambda e: telemetry.telemetry_profile(e, None).withColumn("kill_keys", F.array_join("kill_keys", ","))),
        "collection_report": _collection,
        "csv_types": _csv_types,
        "csv_union": _csv_union,
        "csv_typed": _csv_typed,
        "file_checksums": _checksums,
        "written_cells": _events(_written_cells),
        "written_report": _events(_written_report),
        "sample_matches": _samples(lambda s: telemetry.sample_matches(s, window="window_name")),
        "sample_summary": _samples(lambda s: telemetry.sample_summary(s, window="window_name")),
        "sample_totals": _samples(lambda s: telemetry.sample_totals(s, window="window_name")),
        "first_matches": _samples(lambda s: telemetry.first_matches(s, FIRST_MATCHES, window="window_name")),
        "match_profiles": _matches(lambda m: m.withColumn("kill_keys", F.array_join("kill_keys", ","))),
        "pilot_counts": _matches(telemetry.pilot_counts),
        "pilot_summary": _matches(telemetry.pilot_summary),
    }
