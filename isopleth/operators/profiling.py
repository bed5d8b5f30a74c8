"""Profiles of raw events read as text: completeness, numbers, bounds, sentinels, duplicates, eligibility.

Each profile is one aggregation, or two chained ones; none collects rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.expr import blank_to_null, is_finite, outside, ratio
from ..sources.interim import settled
from .quantiles import exact_quantiles, slice_of

MISSING = "<NULL_OR_BLANK>"
#: What tells an event apart, as its row may stand in several exports.
EVENT_KEY = ("match_id", "victim_name", "time", "killed_by")
_RELATED = {"killer_position_x": "killer_x", "killer_position_y": "killer_y", "victim_placement": "victim_placement"}


def typed(raw: DataFrame) -> DataFrame:
    """Raw text columns as *_raw, with killed_by, map, match_id trimmed to null and victim_x, victim_y as numbers where they are any.

    Names of actors, the killer's place and the victim's placement come along in the same forms where there are any.
    """

    def number(name: str) -> Column:
        return blank_to_null(F.col(name).cast("string")).try_cast("double")

    kept = [F.col(c) for c in ("source_file", "time") if c in raw.columns]
    kept += [blank_to_null(F.col(c).cast("string")).alias(c) for c in ("killer_name", "victim_name") if c in raw.columns]
    kept += [number(c).alias(n) for c, n in _RELATED.items() if c in raw.columns]
    texts = [F.col(c).alias(f"{c}_raw") for c in ("killed_by", "map", "match_id")] + [blank_to_null(c).alias(c) for c in ("killed_by", "map", "match_id")]
    places = [F.col(f"victim_position_{a}").cast("string").alias(f"victim_{a}_raw") for a in "xy"] + [number(f"victim_position_{a}").alias(f"victim_{a}") for a in "xy"]
    return raw.select(*texts, *places, *kept)


def _known_map() -> Column:
    return F.col("map").isin(*C.MAPS)


def _off_map() -> Column:
    return outside("victim_x", C.COORD_MIN, C.COORD_MAX) | outside("victim_y", C.COORD_MIN, C.COORD_MAX)


def _at_origin() -> Column:
    return (F.col("victim_x") == 0) & (F.col("victim_y") == 0)


def core_profile(profiled: DataFrame) -> DataFrame:
    """One row of counters over `typed` rows."""
    counters: dict[str, Column] = {}
    for name in ("killed_by", "map", "match_id", "victim_x", "victim_y"):
        text = F.col(f"{name}_raw")
        counters[f"null_{name}"] = text.isNull()
        counters[f"blank_{name}"] = F.trim(text) == ""
        if name.startswith("victim"):
            counters[f"invalid_numeric_{name}"] = (F.trim(text) != "") & F.col(name).isNull()
            counters[f"zero_{name}"] = F.col(name) == 0
        else:
            counters[f"missing_{name}"] = F.col(name).isNull()
    x, y = F.col("victim_x"), F.col("victim_y")
    finite, caused = is_finite(x) & is_finite(y), F.col("killed_by").isin(*C.CAUSES)
    keyed = F.col("map").isNotNull() & F.col("match_id").isNotNull()
    counters |= {
        "both_coordinates_missing": x.isNull() & y.isNull(),
        "one_coordinate_missing": x.isNull() != y.isNull(),
        "zero_zero_coordinates": _at_origin(),
        "negative_coordinates": (x < 0) | (y < 0),
        "non_finite_coordinates": ~is_finite(x) | ~is_finite(y),
        "out_of_bounds_coordinates": _known_map() & _off_map(),
    }
    for name in ("victim_x", "victim_y"):
        counters[f"{name}_below_zero"] = _known_map() & (F.col(name) < C.COORD_MIN)
        counters[f"{name}_above_max"] = _known_map() & (F.col(name) > C.COORD_MAX)
    counters |= {
        "complete_required_fields": F.col("killed_by").isNotNull() & keyed & finite,
        "environmental_rows": caused,
        "complete_environmental_rows": caused & keyed & finite,
        "environmental_zero_zero_rows": caused & _at_origin(),
    }
    return profiled.agg(F.count("*").alias("total_rows"), F.count_distinct("match_id").alias("distinct_match_ids"), *(F.count_if(c).alias(n) for n, c in counters.items()))


def group_profile(profiled: DataFrame, by: str) -> DataFrame:
    """Counts, finite extremes and faults by a column of `typed` rows, a missing value under a name of its own."""
    extremes = [f(F.when(is_finite(v), F.col(v))).alias(f"{n}_{v}") for v in ("victim_x", "victim_y") for n, f in (("min", F.min), ("max", F.max))]
    grouped = profiled.withColumn("value", F.coalesce(by, F.lit(MISSING))).groupBy("value").agg(
        F.count("*").alias("row_count"),
        F.count_distinct("match_id").alias("distinct_match_ids"),
        *extremes,
        F.count_if(_at_origin()).alias("zero_zero_rows"),
        F.count_if(_known_map() & _off_map()).alias("out_of_bounds_rows"),
        *(F.count_if(F.col("killed_by") == c).alias(f"{c.lower()}_rows") for c in C.CAUSES),
    )
    return grouped.withColumnRenamed("value", by)


def match_maps(profiled: DataFrame) -> DataFrame:
    """By match: rows, rows without a map, distinct maps, the least map."""
    return profiled.groupBy("match_id").agg(F.count("*").alias("death_rows"), F.count_if(F.col("map").isNull()).alias("missing_map_rows"), F.count_distinct("map").alias("known_maps"), F.min("map").alias("only_map"))


def map_completeness(profiled: DataFrame) -> DataFrame:
    """One row: missing maps that the rest of their match could fill in (one map known), could not (none), or contradicts (several)."""
    lacking, n = F.col("missing_map_rows") > 0, F.col("known_maps")
    rows = F.col("missing_map_rows")
    return match_maps(profiled).agg(
        F.sum("death_rows").alias("total_rows"),
        F.sum(rows).alias("missing_map_rows"),
        F.count_if(lacking).alias("matches_with_missing_map"),
        F.sum(F.when(n == 1, rows).otherwise(0)).alias("recoverable_rows"),
        F.sum(F.when(n == 0, rows).otherwise(0)).alias("unrecoverable_rows"),
        F.count_if(lacking & (n == 0)).alias("all_missing_matches"),
        F.count_if(n > 1).alias("conflicting_map_matches"),
    )


def missing_maps_by_cause(profiled: DataFrame) -> DataFrame:
    """The same by cause, counting rows of the causes in question."""
    lacking = profiled.where(F.col("map").isNull() & F.col("killed_by").isin(*C.CAUSES)).select("match_id", "killed_by")
    n = F.col("known_maps")
    return lacking.join(match_maps(profiled), "match_id").groupBy("killed_by").agg(F.count("*").alias("missing_map_rows"), F.count_if(n == 1).alias("recoverable_rows"), F.count_if(n == 0).alias("unrecoverable_rows"), F.count_if(n > 1).alias("conflict_rows"))


def bounds_report(profiled: DataFrame) -> DataFrame:
    """Rows off the map by map and cause, with the rate as text."""
    rows = profiled.where(_known_map() & F.col("killed_by").isin(*C.CAUSES)).groupBy("map", "killed_by").agg(F.count("*").alias("cause_rows"), F.count_if(_off_map()).alias("out_of_bounds_rows"))
    return rows.withColumn("out_of_bounds_rate", F.format_string("%.9f%%", ratio("out_of_bounds_rows", "cause_rows") * 100))


def bounds_examples(profiled: DataFrame, limit: int = 12) -> DataFrame:
    """The rows farthest off the map, the causes in question first, with what they violate. A report of `limit` rows."""
    over = {f"{a.upper()}_{side}": v for a in "xy" for side, v in (("BELOW_0", -F.col(f"victim_{a}")), (f"ABOVE_{C.COORD_MAX:.0f}", F.col(f"victim_{a}") - C.COORD_MAX))}
    worst = F.greatest(*over.values())
    named = F.concat_ws(", ", *(F.when(v > 0, name) for name, v in over.items()))
    later = F.when(F.col("killed_by").isin(*C.CAUSES), 0).otherwise(1)
    file = [F.regexp_extract("source_file", "[^/]+$", 0).alias("source_file")] if "source_file" in profiled.columns else []
    far = profiled.where(_known_map() & _off_map()).orderBy(later, worst.desc(), "match_id", "victim_x", "victim_y").limit(limit)
    return far.select(*file, "killed_by", "map", "match_id", "victim_x", "victim_y", named.alias("violation"))


def _origin_rate(rows: str) -> Column:
    return F.format_string("%.9f%%", ratio("zero_zero_rows", rows) * 100).alias("zero_zero_rate")


def sentinel_summary(profiled: DataFrame, cause: str) -> DataFrame:
    """One row on a cause's positions: rows and matches at the origin, rows on one axis, rows near the origin but not at it."""
    x, y, near = F.col("victim_x"), F.col("victim_y"), {}
    for name, reach in (("nonzero_within_10m_square", 1_000), ("nonzero_within_100m_square", 10_000)):
        near[name] = F.count_if(x.between(0, reach) & y.between(0, reach) & ~_at_origin())
    counts = profiled.where(F.col("killed_by") == cause).agg(
        F.count("*").alias("cause_rows"),
        F.count_if(_at_origin()).alias("zero_zero_rows"),
        F.count_distinct("match_id").alias("cause_matches"),
        F.count_distinct(F.when(_at_origin(), F.col("match_id"))).alias("zero_zero_matches"),
        F.count_if((x == 0) & (y != 0)).alias("only_x_zero"),
        F.count_if((x != 0) & (y == 0)).alias("only_y_zero"),
        *(c.alias(n) for n, c in near.items()),
    )
    return counts.select("*", _origin_rate("cause_rows"))


def sentinel_by(profiled: DataFrame, cause: str, by: str) -> DataFrame:
    """A cause's rows and matches at the origin by map or file."""
    rows = profiled.where(F.col("killed_by") == cause).withColumn("value", F.coalesce(by, F.lit(MISSING))).groupBy("value")
    counts = rows.agg(F.count("*").alias("cause_rows"), F.count_if(_at_origin()).alias("zero_zero_rows"), F.count_distinct(F.when(_at_origin(), F.col("match_id"))).alias("zero_zero_matches"))
    return counts.select(F.col("value").alias(by), "cause_rows", "zero_zero_rows", _origin_rate("cause_rows"), "zero_zero_matches")


def sentinel_times(profiled: DataFrame, cause: str, early: tuple[int, int] = (120, 300)) -> DataFrame:
    """Times of a cause's rows at the origin and elsewhere: extremes, exact quantiles, mean, rows in an early span."""
    points = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    time, group = F.col("time"), F.when(_at_origin(), "ZERO_ZERO").otherwise("NON_ZERO")
    timed = profiled.where(F.col("killed_by") == cause).select(group.alias("position_group"), F.col("time").cast("double").alias("time"))
    early_rows = F.count_if((time >= early[0]) & (time < early[1])).alias("early_rows")
    sums = timed.groupBy("position_group").agg(F.count("*").alias("row_count"), F.min("time").alias("min_time"), F.max("time").alias("max_time"), F.avg("time").alias("avg_time"), early_rows)
    sliced = timed.groupBy("position_group", slice_of(time, 1).alias("slice")).agg(F.count("*").alias("n"))
    found = sums.join(exact_quantiles(timed, sliced, ["position_group"], "time", list(points.values()), 1), "position_group", "left")
    return found.select("position_group", "row_count", "min_time", *(F.col("q")[i].alias(f"{n}_time") for i, n in enumerate(points)), "max_time", "avg_time", "early_rows")


def sentinel_related(profiled: DataFrame, cause: str) -> DataFrame:
    """A cause's rows at the origin and elsewhere beside what else is missing from them: the killer's place and name, the placement, actors of one name."""
    x, y, killer, victim = (F.col(c) for c in ("killer_x", "killer_y", "killer_name", "victim_name"))
    return profiled.where(F.col("killed_by") == cause).groupBy(F.when(_at_origin(), "ZERO_ZERO").otherwise("NON_ZERO").alias("position_group")).agg(
        F.count("*").alias("row_count"),
        F.count_if((x == 0) & (y == 0)).alias("killer_zero_zero"),
        F.count_if(x.isNull() | y.isNull()).alias("killer_coordinate_missing"),
        F.count_if(killer == victim).alias("same_named_actor"),
        F.count_if(killer.isNull()).alias("missing_killer_name"),
        F.count_if(F.col("victim_placement").isNull()).alias("missing_victim_placement"),
    )


def _sum(column: Column) -> Column:
    return F.coalesce(F.sum(column), F.lit(0))


#: The filter of repeated fingerprints has 2 ** FILTER_LOG bits, in words of 64: 2 million rows at most.
FILTER_LOG = 27


def _repeated(rows: DataFrame, key: Column, whole: Column | None = None) -> DataFrame:
    """Those of `rows` whose `key`, a fingerprint of 64 bits, occurs more than once, and a few others; of rows that are not `whole` hardly any.

    Only fingerprints move: their counts are taken first, and the repeated ones go into a filter of bits, which
    is bounded and so is broadcast. Rows whose bit is set remain; whoever groups them by what the fingerprint
    stands for tells true copies from rows that share a bit or a fingerprint.
    """
    # rows that are not whole share a mark of their own; a fingerprint is never null, as tests for null would each repeat its whole expression
    marked = rows.withColumn("fingerprint", F.when(whole, key).otherwise(F.lit(0).cast("long")) if whole is not None else key)
    word = F.shiftrightunsigned("fingerprint", 64 - FILTER_LOG + 6)
    place = F.shiftrightunsigned("fingerprint", 64 - FILTER_LOG).bitwiseAND(63).cast("int")
    counts = marked.groupBy("fingerprint").agg(F.count("*").alias("n"), F.max("fingerprint").alias("same"))
    repeated = counts.where("n > 1" + (" and same <> 0" if whole is not None else ""))
    words = repeated.select(word.alias("word"), place.alias("place")).groupBy("word").agg(F.bit_or(F.expr("shiftleft(1L, place)")).alias("set_bits"))
    filled = settled(words)  # written out first: a broadcast waits for a limited time
    return marked.withColumn("word", word).join(F.broadcast(filled), "word").where(F.getbit("set_bits", place) == 1).select(rows.columns)


def _file_marks(file: str | None) -> list[Column]:
    """Least and greatest file of a group, by their digests, as numbers sum up without sorting; that they differ is all that is asked."""
    mark = F.xxhash64(file) if file else F.lit(0).cast("long")
    return [F.min(mark).alias("low"), F.max(mark).alias("high")]


def _across() -> Column:
    return F.when(F.col("low") < F.col("high"), 2).otherwise(1).alias("files")


def _copies(raw: DataFrame, columns: Sequence[str], file: str | None) -> DataFrame:
    """Groups of equal rows, by the columns themselves, so only true copies count; a fingerprint has ruled out most others before."""
    once = _repeated(raw.select(*columns, *([file] if file else [])), F.xxhash64(*columns))
    groups = once.groupBy(*columns).agg(F.count("*").alias("n"), *_file_marks(file)).where("n > 1")
    return groups.select(*columns, "n", _across())


def _sizes(groups: str, rows: str, most: str) -> list[Column]:
    n = F.col("n")
    return [F.count("*").alias(groups), _sum(n).alias(rows), _sum(n - 1).alias("excess_rows"), F.coalesce(F.max(n), F.lit(0)).alias(most)]


def exact_duplicates(raw: DataFrame, columns: Sequence[str], file: str | None = None) -> DataFrame:
    """One row over all groups of equal rows: groups, rows, excess, most copies; with `file`, groups inside one file and across files."""
    spread = [F.count_if(F.col("files") == 1).alias("within_file_groups"), F.count_if(F.col("files") > 1).alias("cross_file_groups")]
    return _copies(raw, columns, file).agg(*_sizes("duplicate_groups", "duplicate_rows", "most_copies"), *spread)


def exact_duplicates_by_cause(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same for each of the causes in question, as they are written."""
    return _copies(raw, columns, None).where(F.col("killed_by").isin(*C.CAUSES)).groupBy("killed_by").agg(*_sizes("duplicate_groups", "duplicate_rows", "most_copies"))


def _event_key() -> dict[str, Column]:
    """Parts of an event's key: trimmed texts, and the time as a number; null where there is none."""
    parts = {name: blank_to_null(F.col(name).cast("string")) for name in EVENT_KEY}
    return parts | {"time": parts["time"].try_cast("double")}


def _candidates(raw: DataFrame, columns: Sequence[str], file: str | None) -> DataFrame:
    """Whole event keys that occur more than once: rows, variants (distinct rows, untrimmed) and files."""
    keys = [f"{name}_key" for name in EVENT_KEY]
    keyed = raw.select(*columns, *([file] if file else []), *(part.alias(f"{name}_key") for name, part in _event_key().items()))
    whole = F.lit(True)
    for key in keys:
        whole &= F.col(key).isNotNull()
    rows = _repeated(keyed, F.xxhash64(*keys), whole).groupBy(*keys, *columns).agg(F.count("*").alias("rows"), *_file_marks(file))
    found = rows.groupBy(*keys).agg(F.sum("rows").alias("n"), F.count("*").alias("variants"), F.min("low").alias("low"), F.max("high").alias("high"), F.bool_and(whole).alias("whole"))
    return found.where("n > 1 and whole").select(*keys, "n", "variants", _across())


def _variants() -> list[Column]:
    return [F.count_if(F.col("variants") == 1).alias("equal_groups"), F.count_if(F.col("variants") > 1).alias("variant_groups")]


def event_candidates(raw: DataFrame, columns: Sequence[str], file: str | None = None) -> DataFrame:
    """One row over event keys that occur more than once: groups, rows, excess, most rows, groups whose rows are all equal, groups with several variants.

    A key is whole if no part is null or blank and the time is a number. With `file`, also the groups found in several files.
    """
    across = [F.count_if(F.col("files") > 1).alias("cross_file_groups")] if file else []
    return _candidates(raw, columns, file).agg(*_sizes("candidate_groups", "candidate_rows", "max_rows_per_key"), *_variants(), *across)


def event_candidates_by_cause(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same for each of the causes in question, trimmed."""
    found = _candidates(raw, columns, None).where(F.col("killed_by_key").isin(*C.CAUSES)).groupBy(F.col("killed_by_key").alias("killed_by"))
    return found.agg(*_sizes("candidate_groups", "candidate_rows", "max_rows_per_key"), *_variants())


def key_completeness(raw: DataFrame) -> DataFrame:
    """One row: rows, rows that lack each part of the event key (a time that is no number is lacking), rows with the whole key."""
    lack = {name: part.isNull() for name, part in _event_key().items()}
    complete = F.lit(True)
    for gone in lack.values():
        complete &= ~gone
    named = {"time": "invalid_or_missing_time"}
    return raw.agg(F.count("*").alias("total_rows"), *(F.count_if(gone).alias(named.get(k, f"missing_{k}")) for k, gone in lack.items()), F.count_if(complete).alias("complete_keys"))


def match_dimension(aggregate: DataFrame) -> DataFrame:
    """By trimmed match id: least date text and the number of distinct date texts (times of one day differ)."""
    keyed = aggregate.select(blank_to_null("match_id").alias("match_id"), blank_to_null("date").alias("date")).where("match_id is not null")
    return keyed.groupBy("match_id").agg(F.min("date").alias("match_date"), F.count_distinct("date").alias("date_count"))


def eligibility(raw: DataFrame, dimension: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct rows of the causes with their number of copies and rule flags; missing positions leave two flags null, on purpose."""
    once = raw.withColumn("cause", blank_to_null("killed_by")).where(F.col("cause").isin(*C.CAUSES)).groupBy("cause", *columns).agg(F.count("*").alias("copies"))
    x, y = (blank_to_null(F.col(f"victim_position_{a}").cast("string")).try_cast("double") for a in "xy")
    shaped = once.select(F.col("cause").alias("killed_by"), blank_to_null("map").alias("map"), blank_to_null("match_id").alias("match_id"), x.alias("victim_x"), y.alias("victim_y"), "copies")
    found = shaped.join(dimension, "match_id", "left")
    no_map = F.coalesce(~_known_map(), F.lit(True))
    return found.select("killed_by", "map", "match_id", "copies", no_map.alias("fails_map"), _at_origin().alias("fails_zero_zero"), (_known_map() & _off_map()).alias("fails_bounds"), F.coalesce(F.col("date_count") != 1, F.lit(True)).alias("fails_date"))


def eligibility_funnel(flags: DataFrame) -> DataFrame:
    """Rows of each cause that are left after each rule in turn."""
    left, steps = F.lit(True), []
    for rule, name in (("fails_map", "after_map"), ("fails_zero_zero", "after_zero_zero"), ("fails_bounds", "after_bounds"), ("fails_date", "final_eligible_rows")):
        left = left & ~F.col(rule)
        steps.append(F.count_if(left).alias(name))
    return flags.groupBy("killed_by").agg(F.sum("copies").alias("raw_rows"), F.count("*").alias("after_exact_dedup"), F.sum(F.col("copies") - 1).alias("exact_duplicate_excess"), *steps)


def _primary() -> Column:
    reasons = {"fails_map": "MISSING_MAP", "fails_zero_zero": "INVALID_OR_UNAVAILABLE_POSITION", "fails_bounds": "OUT_OF_MAP_BOUNDS", "fails_date": "DATE_NOT_FOUND_OR_CONFLICT"}
    out = F.lit("ELIGIBLE")
    for rule, name in reversed(reasons.items()):
        out = F.when(F.col(rule), name).otherwise(out)
    return out


def primary_reasons(flags: DataFrame) -> DataFrame:
    """Rows by cause and the first rule that they fail."""
    return flags.groupBy("killed_by", _primary().alias("primary_status")).agg(F.count("*").alias("unique_rows"))


def exclusion_combinations(flags: DataFrame) -> DataFrame:
    """Excluded rows by cause and all the rules that they fail."""
    names = {"fails_map": "MISSING_MAP", "fails_zero_zero": "ZERO_ZERO", "fails_bounds": "OUT_OF_BOUNDS", "fails_date": "DATE_NOT_FOUND_OR_CONFLICT"}
    named = F.concat_ws("|", *(F.when(F.col(rule), name) for rule, name in names.items()))
    return flags.where(" or ".join(names)).groupBy("killed_by", named.alias("exclusion_combination")).agg(F.count("*").alias("unique_rows"))


def final_by_map(flags: DataFrame) -> DataFrame:
    """Eligible rows by map and cause."""
    return flags.where("not fails_map and not fails_zero_zero and not fails_bounds and not fails_date").groupBy("map", "killed_by").agg(F.count("*").alias("eligible_rows"), F.count_distinct("match_id").alias("distinct_matches"))


def reconciliation(flags: DataFrame) -> DataFrame:
    """One row: raw rows less copies less excluded less eligible, 0 unless positions are missing."""
    excluded = F.col("fails_map") | F.col("fails_zero_zero") | F.col("fails_bounds") | F.col("fails_date")
    sums = flags.agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("raw_rows"), F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_excess"), F.count("*").alias("deduplicated_rows"), F.count_if(excluded).alias("excluded_rows"), F.count_if(~excluded).alias("eligible_rows"))
    return sums.withColumn("difference", F.col("raw_rows") - F.col("duplicate_excess") - F.col("excluded_rows") - F.col("eligible_rows"))


def first_rows(rows: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows in the order of all columns, nulls first: the same ones in every run, kept n at a time in each task."""
    return rows.orderBy(*(F.col(f"`{c}`").asc_nulls_first() for c in rows.columns)).limit(n)


def column_list(rows: DataFrame) -> list[tuple[int, str, str, bool]]:
    """(place, column, type, whether it may be null) of a table, told by its schema without a job."""
    return [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(rows.schema)]


def aggregate_profile(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """One row on players' results: rows, null keys, extremes of kills and damage, (match_id, player_name) keys that repeat and their excess.

    All rows count; with `limit`, the first so many by all columns. Null keys are keys of their own.
    """
    head = first_rows(rows, limit) if limit else rows
    sums = ("player_kills", "min_kills", "max_kills"), ("player_dmg", "min_damage", "max_damage")
    extremes = [f(c).alias(n) for c, low, high in sums for n, f in ((low, F.min), (high, F.max))]
    by_key = head.groupBy("match_id", "player_name").agg(F.count("*").alias("n"), *extremes)
    merged = [f(n).alias(n) for _, low, high in sums for n, f in ((low, F.min), (high, F.max))]
    counts = [F.coalesce(F.sum(F.when(F.col(c).isNull(), F.col("n"))), F.lit(0)).alias(f"null_{c}") for c in ("match_id", "player_name")]
    repeated = F.col("n") > 1
    return by_key.agg(_sum(F.col("n")).alias("row_count"), *counts, *merged, F.count_if(repeated).alias("duplicate_groups"), _sum(F.when(repeated, F.col("n") - 1)).alias("duplicate_rows"))
