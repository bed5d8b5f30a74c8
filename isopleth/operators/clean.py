"""Clean event build: deduplicate, normalise, classify by the first rule that fits, link dates, count the stages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.expr import blank_to_null, is_blank, outside, safe_date
from ..schemas import DEATHS

X, Y = "victim_position_x", "victim_position_y"


def quality_status(maps: Sequence[str] = C.MAPS) -> Column:
    """First rule that a normalised row fails, else quality_valid."""
    rules = [
        ("missing_map", is_blank("map")),
        ("unsupported_map", ~F.col("map").isin(*maps)),
        ("missing_match_id", is_blank("match_id")),
        ("missing_coordinates", F.col(X).isNull() | F.col(Y).isNull()),
        ("zero_zero", (F.col(X) == 0) & (F.col(Y) == 0)),
        ("out_of_bounds", outside(X, C.COORD_MIN, C.COORD_MAX) | outside(Y, C.COORD_MIN, C.COORD_MAX)),
    ]
    out = F.lit("quality_valid")
    for name, fails in reversed(rules):
        out = F.when(fails, name).otherwise(out)
    return out


def event_id(columns: Sequence[str]) -> Column:
    """Digest of the raw columns, so that names need not be kept; not a business key."""
    return F.md5(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))


def classify_events(raw: DataFrame, causes: Sequence[str] = C.CAUSES, maps: Sequence[str] = C.MAPS) -> DataFrame:
    """Rows of the given causes, exact copies once, with event_id, upper-case trimmed map, trimmed match_id and quality_status."""
    columns = [f.name for f in DEATHS]
    once = raw.where(F.col("killed_by").isin(*causes)).select(*columns).dropDuplicates()
    named = once.select(event_id(columns).alias("event_id"), F.trim("killed_by").alias("killed_by"), F.upper(F.trim("map")).alias("map"), F.trim("match_id").alias("match_id"), X, Y)
    return named.withColumn("quality_status", quality_status(maps))


def match_dates(aggregate: DataFrame) -> DataFrame:
    """One row per match: its least date and how many dates it has. Keys are trimmed; blank ones are left out."""
    keyed = aggregate.select(blank_to_null("match_id").alias("match_id"), safe_date(F.trim("date")).alias("day")).where("match_id is not null")
    return keyed.groupBy("match_id").agg(F.min("day").alias("match_date"), F.count_distinct("day").alias("date_count"))


def unique_by(rows: DataFrame, key: str) -> DataFrame:
    """`rows`, which fail where they are read if a key stands on more than one of them.

    The check is part of the plan, an aggregation by the key: no job of its own, and no shuffle if the rows are
    grouped by the key already.
    """
    others = [c for c in rows.columns if c != key]
    counted = rows.groupBy(key).agg(F.count("*").alias("rows_of_key"), *(F.first(c).alias(c) for c in others))
    fault = F.raise_error(F.concat(F.lit(f"{key} "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(" is not unique")))
    return counted.where(F.when(F.col("rows_of_key") > 1, fault).isNull()).select(rows.columns)


def link_dates(events: DataFrame, dates: DataFrame) -> DataFrame:
    """Events with date and date_status; a match with several dates links to none. `dates` must have a match once, so that no event is doubled; if it has not, the result fails as it is read."""
    found = events.join(unique_by(dates, "match_id"), "match_id", "left")
    n = F.col("date_count")
    status = F.when(n.isNull(), "unmatched_match_id").when(n == 0, "missing_or_unparseable_date").when(n > 1, "ambiguous_date").otherwise("valid_date")
    return found.select(*events.columns, F.when(n == 1, F.col("match_date")).alias("date"), status.alias("date_status"))


def assert_same_rows(before: DataFrame, after: DataFrame) -> None:
    """Fail if a join changed the number of rows."""
    n, m = before.count(), after.count()
    if n != m:
        raise ValueError(f"date link changed the number of rows: {n} before, {m} after")


def clean_events(raw: DataFrame, aggregate: DataFrame) -> DataFrame:
    """The clean event table: valid rows with one valid date."""
    linked = link_dates(classify_events(raw).where("quality_status = 'quality_valid'"), match_dates(aggregate))
    return linked.where("date_status = 'valid_date'").select("event_id", "killed_by", "map", "match_id", "date", X, Y)


STATUSES = ("missing_map", "unsupported_map", "missing_match_id", "missing_coordinates", "zero_zero", "out_of_bounds")
DATE_STATUSES = ("unmatched_match_id", "missing_or_unparseable_date", "ambiguous_date")


def stage_funnel(raw: DataFrame, aggregate: DataFrame, causes: Sequence[str] = C.CAUSES) -> DataFrame:
    """Fifteen ordered counts from input to final rows (stage_order, metric, row_count), from one pass over each input.

    Every classified row is linked, whatever its status, so one aggregation counts all stages.
    """
    inputs = raw.agg(F.count_if(F.col("killed_by").isin(*causes)).alias("input"))
    linked = link_dates(classify_events(raw, causes), match_dates(aggregate))
    valid = F.col("quality_status") == "quality_valid"
    counts = linked.agg(
        F.count("*").alias("kept"),
        *(F.count_if(F.col("quality_status") == s).alias(s) for s in STATUSES),
        F.count_if(valid).alias("quality_valid"),
        *(F.count_if(valid & (F.col("date_status") == s)).alias(s) for s in DATE_STATUSES),
        F.count_if(valid & (F.col("date_status") == "valid_date")).alias("final"),
    )
    names = {
        "environmental_input_rows": F.col("input"),
        "exact_duplicate_rows_removed": F.col("input") - F.col("kept"),
        "rows_after_deduplication": F.col("kept"),
        "missing_map_rows": F.col("missing_map"),
        "unsupported_map_rows": F.col("unsupported_map"),
        "missing_match_id_rows": F.col("missing_match_id"),
        "missing_coordinate_rows": F.col("missing_coordinates"),
        "zero_zero_rows": F.col("zero_zero"),
        "out_of_bounds_rows": F.col("out_of_bounds"),
        "quality_valid_rows": F.col("quality_valid"),
        "unmatched_match_id_rows": F.col("unmatched_match_id"),
        "missing_or_unparseable_date_rows": F.col("missing_or_unparseable_date"),
        "ambiguous_date_rows": F.col("ambiguous_date"),
        "final_analysis_rows": F.col("final"),
        "total_excluded_rows": F.col("input") - F.col("final"),
    }
    rows = F.array(*(F.struct(F.lit(i).alias("stage_order"), F.lit(name).alias("metric"), value.alias("row_count")) for i, (name, value) in enumerate(names.items(), 1)))
    return inputs.crossJoin(F.broadcast(counts)).select(F.inline(rows))
