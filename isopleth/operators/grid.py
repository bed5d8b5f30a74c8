"""Hotspots on square grids: counts by cell, ranks, drill-down, comparison of resolutions, local lift.

Events carry map, killed_by, match_id, date, victim_position_x and victim_position_y (centimetres). Only
cell totals leave the aggregation, so every window below runs over cells, not over events.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.expr import cell, joined, lookup, ratio, round_to
from ..sources.interim import settled

GROUP = ("map", "killed_by")
#: A table is broadcast only if it is counted and has no more rows.
MOST_BROADCAST = 20_000
#: Cells that the bits of one long tell apart.
MASK_BITS = 63
#: Events that a task tells the matches of.
TASK_EVENTS = 300_000


def _same(a: str, b: str, keys: Sequence[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}"))
    return out


def _counted(placed: DataFrame, keys: Sequence[str], n: Column) -> DataFrame:
    """Events, matches and dates of each cell. Distinct matches and dates are groups that are counted, so hot cells are summed up before they move."""
    by_match = placed.groupBy(*keys, "match_id").agg(F.sum(n).alias("n")).groupBy(*keys).agg(F.sum("n").alias("death_count"), F.count("match_id").alias("match_count"))
    by_date = placed.groupBy(*keys, "date").agg(F.count("*").alias("rows")).groupBy(*keys).agg(F.count("date").alias("date_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"))
    both = by_match.alias("m").join(by_date.alias("d"), _same("m", "d", keys))
    return both.select(*(F.col(f"m.{k}").alias(k) for k in keys), "death_count", "match_count", "date_count", "first_date", "last_date")


def cell_counts(events: DataFrame, size_m: int) -> DataFrame:
    """Events, matches and dates by cell."""
    size = size_m * C.CM_PER_M
    placed = events.select(*GROUP, "match_id", "date", cell("victim_position_x", size).alias("grid_x"), cell("victim_position_y", size).alias("grid_y"))
    return _counted(placed, [*GROUP, "grid_x", "grid_y"], F.lit(1))


def cell_pyramid(events: DataFrame, sizes_m: Sequence[int] = (10, 100, 250, 500)) -> DataFrame:
    """cell_counts of several sizes at once, told apart by grid_size_m.

    No event stands in memory once for each size. Events and dates are counted in cells of the sizes' greatest common
    divisor, 64 days as the bits of one long, and the larger cells are made of those. Distinct matches do not add up; they are
    told by masks, see _matches.
    """
    unit = math.gcd(*sizes_m)
    at = [cell(f"victim_position_{a}", unit * C.CM_PER_M).alias(f"unit_{a}") for a in "xy"]
    placed = events.select(*GROUP, "match_id", "date", *at)
    keys = [*GROUP, "grid_size_m", "grid_x", "grid_y"]
    # groups of cells and matches spread evenly, so their number of tasks follows that of the events
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, math.ceil(events.count() / TASK_EVENTS))
    none, no_date = F.lit(0).cast("long"), F.lit(None).cast("date")
    found = _dates(placed, unit, sizes_m, keys).select(*keys, "death_count", none.alias("match_count"), "date_count", "first_date", "last_date")
    for some in _bunches(sizes_m):
        found = found.unionByName(_matches(placed, unit, some, tasks).select(*keys, none.alias("death_count"), "match_count", none.alias("date_count"), no_date.alias("first_date"), no_date.alias("last_date")))
    sums = (F.sum(c).alias(c) for c in ("death_count", "match_count", "date_count"))
    return found.groupBy(*keys).agg(*sums, F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def _within(axis: str, unit: int, size_m: int) -> Column:
    """The cell of `size_m` that a cell of `unit` lies in."""
    return F.floor(F.col(f"unit_{axis}") / (size_m // unit)).cast("int")


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.cast("int"))


def _dates(placed: DataFrame, unit: int, sizes_m: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Events and dates of the cells of all sizes."""
    day = F.unix_date("date")
    told = [F.bit_or("days").alias("days"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date")]
    rows = placed.select(*GROUP, "unit_x", "unit_y", F.floor(day / 64).alias("days_from"), _bit(day.bitwiseAND(F.lit(63))).alias("days"), F.col("date").alias("first_date"), F.col("date").alias("last_date"))
    units = rows.groupBy(*GROUP, "unit_x", "unit_y", "days_from").agg(F.count("*").alias("n"), *told)
    levels = F.array(*(F.struct(F.lit(m).alias("grid_size_m"), *(_within(a, unit, m).alias(f"grid_{a}") for a in "xy")) for m in sizes_m))
    cells = units.select(*GROUP, "days_from", "n", "days", "first_date", "last_date", F.inline(levels)).groupBy(*keys, "days_from").agg(F.sum("n").alias("n"), *told)
    dates = F.coalesce(F.sum(F.bit_count("days")), F.lit(0).cast("long"))
    return cells.groupBy(*keys).agg(F.sum("n").alias("death_count"), dates.alias("date_count"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def _masks(sizes_m: Sequence[int]) -> int:
    """Cells of all sizes in a square whose edge is their least common multiple."""
    return sum((math.lcm(*sizes_m) // m) ** 2 for m in sizes_m)


def _bunches(sizes_m: Sequence[int]) -> list[list[int]]:
    """Sizes in bunches, largest first, such that the cells of a bunch in one square are told apart by a long's bits; a size alone is."""
    out: list[list[int]] = []
    for m in sorted(sizes_m, reverse=True):
        if out and _masks([*out[-1], m]) <= MASK_BITS:
            out[-1].append(m)
        else:
            out.append([m])
    return out


def _matches(placed: DataFrame, unit: int, sizes_m: Sequence[int], tasks: int) -> DataFrame:
    """Distinct matches of the cells of a bunch of sizes.

    A square holds whole cells of every size. Each match has one mask of the cells that it reaches into in a square; equal masks
    are counted before they are taken apart, so a match costs one row a square, however many sizes there are. Rows are dealt
    to the tasks by match and square, and not counted before, as few of them are equal.
    """
    square = math.lcm(*sizes_m)
    mask, cells, first = F.lit(0).cast("long"), [], 0
    for m in sizes_m:
        k = square // m
        # where a coordinate is missing so is the square's, and with it the cell's
        at_x, at_y = (F.coalesce(_within(a, unit, m) - _within(a, unit, square) * k, F.lit(0)) for a in "xy")
        mask = mask.bitwiseOR(_bit(at_x * k + at_y + first))
        cells += [(m, k, x, y, 1 << (first + x * k + y)) for x in range(k) for y in range(k)]
        first += k * k
    keys = [*GROUP, "square_x", "square_y"]
    rows = placed.where("match_id is not null").select(*GROUP, *(_within(a, unit, square).alias(f"square_{a}") for a in "xy"), "match_id", mask.alias("mask"))
    masks = rows.repartition(tasks, *keys, "match_id").groupBy(*keys, "match_id").agg(F.bit_or("mask").alias("mask")).groupBy(*keys, "mask").agg(F.count("*").alias("n"))
    every = F.array(*(F.struct(F.lit(m).alias("grid_size_m"), F.lit(k).alias("k"), F.lit(x).alias("x"), F.lit(y).alias("y"), F.lit(bit).cast("long").alias("bit")) for m, k, x, y, bit in cells))
    each = masks.select(*keys, "n", F.inline(F.filter(every, lambda c: F.col("mask").bitwiseAND(c["bit"]) != 0)))
    placed_cells = each.select(*GROUP, "grid_size_m", *((F.col(f"square_{a}") * F.col("k") + F.col(a)).alias(f"grid_{a}") for a in "xy"), "n")
    return placed_cells.groupBy(*GROUP, "grid_size_m", "grid_x", "grid_y").agg(F.sum("n").alias("match_count"))


def _by_count() -> list[Column]:
    return [F.desc("death_count"), F.desc("match_count"), F.asc("grid_x"), F.asc("grid_y")]


def ranked_cells(events: DataFrame, size_m: int, rank: str) -> DataFrame:
    """cell_counts with the group's total and a row number by events, matches and place."""
    group = Window.partitionBy(*GROUP)
    return cell_counts(events, size_m).select("*", F.sum("death_count").over(group).alias("cause_total"), F.row_number().over(group.orderBy(*_by_count())).alias(rank))


def edges(axis: str, size_m: Column, extent_m: int = C.MAP_EXTENT_M) -> list[Column]:
    """Both bounds of cells on an axis, in meters, clamped to the map."""
    g = F.col(f"grid_{axis}")
    return [(g * size_m).alias(f"grid_min_{axis}_m"), F.least((g + 1) * size_m, F.lit(extent_m)).alias(f"grid_max_{axis}_m")]


def grid_metrics(events: DataFrame, size_m: int, top: int = 10, extent_m: int = C.MAP_EXTENT_M) -> DataFrame:
    """Candidate cells of one size."""
    return candidates(cell_counts(events, size_m), size_m, top, extent_m)


def candidates(cells: DataFrame, size_m: int, top: int = 10, extent_m: int = C.MAP_EXTENT_M) -> DataFrame:
    """The cells with bounds clamped to the map, ratios, share of the group, dense rank by matches, dates, events up to `top`, ties kept."""
    group = Window.partitionBy(*GROUP)
    rank = F.dense_rank().over(group.orderBy(F.desc("match_count"), F.desc("date_count"), F.desc("death_count")))
    share = round_to(ratio("death_count", F.sum("death_count").over(group)) * 100, 4)
    scored = cells.withColumn("share", share).withColumn("rank", rank)
    return scored.where(F.col("rank") <= top).select(
        *GROUP,
        F.lit(size_m).alias("grid_size_m"),
        "grid_x",
        "grid_y",
        *edges("x", F.lit(size_m), extent_m),
        *edges("y", F.lit(size_m), extent_m),
        "death_count",
        F.col("match_count").alias("distinct_match_count"),
        F.col("date_count").alias("distinct_date_count"),
        F.col("first_date").alias("first_death_date"),
        F.col("last_date").alias("last_death_date"),
        round_to(ratio("death_count", "match_count"), 4).alias("deaths_per_match"),
        F.col("share").alias("death_share_pct"),
        F.col("rank").alias("hotspot_candidate_rank"),
    )


def heatmap_cells(events: DataFrame, size_m: int = 100, top: int = 400) -> DataFrame:
    """The `top` cells of each group by events; the share's denominator counts all cells."""
    ranked = ranked_cells(events, size_m, "heat_rank").where(F.col("heat_rank") <= top)
    return ranked.select(*GROUP, F.lit(size_m).alias("grid_size_m"), "grid_x", "grid_y", "death_count", "match_count", "date_count", round_to(ratio("death_count", "cause_total") * 100, 4).alias("share_pct"), "heat_rank")


def detail_cells(events: DataFrame, parent_m: int = 100, child_m: int = 10, top: int = 3) -> DataFrame:
    """Small cells inside the `top` parents of each group, ranked within their parent.

    The parents are `top` for each group, and groups are maps times causes; they are found first.
    """
    parents = ranked_cells(events, parent_m, "parent_rank").where(F.col("parent_rank") <= top)
    parents = parents.select(*GROUP, "parent_rank", F.col("grid_x").alias("parent_grid_x"), F.col("grid_y").alias("parent_grid_y"), F.col("death_count").alias("parent_total"))
    parents = settled(parents)
    large, small = parent_m * C.CM_PER_M, child_m * C.CM_PER_M
    placed = events.select(
        *GROUP, "match_id", "date",
        cell("victim_position_x", large).alias("parent_grid_x"), cell("victim_position_y", large).alias("parent_grid_y"),
        cell("victim_position_x", small).alias("detail_grid_x"), cell("victim_position_y", small).alias("detail_grid_y"),
    )
    keys = [*GROUP, "parent_rank", "parent_grid_x", "parent_grid_y", "detail_grid_x", "detail_grid_y", "parent_total"]
    inside = placed.join(F.broadcast(parents) if parents.count() <= MOST_BROADCAST else parents, [*GROUP, "parent_grid_x", "parent_grid_y"])
    counted = _counted(inside, keys, F.lit(1))
    order = Window.partitionBy(*GROUP, "parent_rank").orderBy(F.desc("death_count"), F.desc("match_count"), "detail_grid_x", "detail_grid_y")
    share = round_to(ratio("death_count", "parent_total") * 100, 4).alias("parent_share_pct")
    return counted.select(*keys[:5], F.lit(child_m).alias("grid_size_m"), *keys[5:7], "death_count", "match_count", "date_count", share, F.row_number().over(order).alias("detail_rank"))


def _range_km() -> Column:
    def km(name: str) -> Column:
        return round_to(F.col(name) / 1000.0, 2)

    return joined("X ", km("grid_min_x_m"), "~", km("grid_max_x_m"), "km, Y ", km("grid_min_y_m"), "~", km("grid_max_y_m"), "km")


def _labels(infix: str) -> list[Column]:
    code = joined(lookup("map", C.MAP_CODES), "-", lookup("killed_by", C.CAUSE_CODES), infix, F.col("grid_x"), "-", F.col("grid_y"))
    return [code.alias("candidate_id"), lookup("map", C.MAP_NAMES).alias("map_name_ko"), lookup("killed_by", C.CAUSE_NAMES).alias("death_cause_ko"), _range_km().alias("coordinate_range_km")]


def _said(size: str) -> list[Column | str]:
    """The part of the summary sentence that both reports share; a fixed text."""
    return [
        F.col("map_name_ko"), " ", F.col("death_cause_ko"), size, F.col("hotspot_candidate_rank"), "순위 후보(", F.col("coordinate_range_km"), "): ",
        F.col("death_count"), "건, ", F.col("distinct_match_count"), "개 경기, ", F.col("distinct_date_count"), "개 날짜에서 관측, 원인 내 비중 ", round_to("death_share_pct", 2), "%. ",
    ]


def with_report_extras(grid: DataFrame, image_px: int = 8192) -> DataFrame:
    """Repeat rate (matches per event) and the cell's corner in image pixels, one pixel a metre."""
    return grid.withColumn("repeat_rate", round_to(ratio("distinct_match_count", "death_count"), 4)).withColumn("pixel_x", F.least("grid_min_x_m", F.lit(image_px))).withColumn("pixel_y", F.least("grid_min_y_m", F.lit(image_px)))


def hotspot_report(grid: DataFrame) -> DataFrame:
    """grid_metrics as report rows: id, names, range in kilometres and a sentence."""
    labelled = grid.select("*", *_labels("-G"))
    return labelled.select(
        "candidate_id", "map_name_ko", "death_cause_ko", "coordinate_range_km", "death_count", "distinct_match_count", "distinct_date_count",
        F.col("first_death_date").alias("observed_from"), F.col("last_death_date").alias("observed_to"), F.col("deaths_per_match").alias("deaths_per_affected_match"),
        "death_share_pct", F.col("hotspot_candidate_rank").alias("candidate_rank"), joined(*_said(" "), "100m 상세 분석 후보.").alias("report_summary"), *GROUP, "grid_x", "grid_y",
    )


def overlaps(fine: DataFrame, coarse: DataFrame, bin_m: int) -> DataFrame:
    """(f, c, overlap_area_m2): every fine and coarse rectangle of one group that overlap in more than an edge, as structs of their columns.

    Both are dealt to the square bins that they reach into, and meet by an equi-join on group and bin. A pair
    that shares several bins counts in the one that holds the corner where its overlap begins. `bin_m` should be
    about the larger rectangles' edge, so that each reaches into a few bins.
    """

    def dealt(rows: DataFrame, name: str) -> DataFrame:
        def reach(axis: str) -> Column:
            last = F.ceil(F.col(f"grid_max_{axis}_m") / bin_m) - 1
            first = F.floor(F.col(f"grid_min_{axis}_m") / bin_m)
            return F.sequence(first, F.greatest(first, last))

        each = rows.select(*GROUP, F.struct(*rows.columns).alias(name), F.explode(reach("x")).alias("bin_x"), reach("y").alias("ys"))
        return each.select(*GROUP, name, "bin_x", F.explode("ys").alias("bin_y"))

    def begins(axis: str) -> Column:
        return F.greatest(f"f.grid_min_{axis}_m", f"c.grid_min_{axis}_m")

    def extent(axis: str) -> Column:
        return F.least(f"f.grid_max_{axis}_m", f"c.grid_max_{axis}_m") - begins(axis)

    met = dealt(fine, "f").join(dealt(coarse, "c"), [*GROUP, "bin_x", "bin_y"])
    once = (F.floor(begins("x") / bin_m) == F.col("bin_x")) & (F.floor(begins("y") / bin_m) == F.col("bin_y"))
    return met.where((extent("x") > 0) & (extent("y") > 0) & once).select("f", "c", (extent("x") * extent("y")).cast("double").alias("overlap_area_m2"))


def best_overlaps(fine: DataFrame, coarse: DataFrame, bin_m: int = 250) -> DataFrame:
    """For each fine cell that overlaps coarse ones in more than an edge: the one with most area, then best rank, then place."""
    pairs = overlaps(fine, coarse, bin_m).select(
        *(F.col(f"f.{g}").alias(g) for g in GROUP),
        F.col("f.grid_x").alias("grid_x"),
        F.col("f.grid_y").alias("grid_y"),
        F.col("c.grid_x").alias("grid_250_x"),
        F.col("c.grid_y").alias("grid_250_y"),
        F.col("c.hotspot_candidate_rank").alias("candidate_rank_250m"),
        "overlap_area_m2",
    )
    order = Window.partitionBy(*GROUP, "grid_x", "grid_y").orderBy(F.desc("overlap_area_m2"), "candidate_rank_250m", "grid_250_x", "grid_250_y")
    return pairs.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")


def cell_parents(cells: DataFrame, fine_m: int = 100, coarse_m: Sequence[int] = (250, 500)) -> DataFrame:
    """For every fine cell of a pyramid and each coarse size: the coarse cells that it overlaps, the one with most area
    (then most events, then place), the share of its own area there and of that cell's events.

    Over all cells, not candidates only.
    """
    placed = cells.select("*", *(e for a in "xy" for e in edges(a, F.col("grid_size_m"))))
    pairs = overlaps(placed.where(F.col("grid_size_m") == fine_m), placed.where(F.col("grid_size_m").isin(*coarse_m)), max(coarse_m))
    best = F.min(F.struct((-F.col("overlap_area_m2")).alias("area"), (-F.col("c.death_count")).alias("deaths"), F.col("c.grid_x").alias("x"), F.col("c.grid_y").alias("y")))
    keys = [F.col(f"f.{k}").alias(k) for k in (*GROUP, "grid_x", "grid_y")] + [F.col("c.grid_size_m").alias("parent_size_m")]
    own = (F.col("f.grid_max_x_m") - F.col("f.grid_min_x_m")) * (F.col("f.grid_max_y_m") - F.col("f.grid_min_y_m"))
    found = pairs.groupBy(*keys).agg(F.count("*").alias("overlapped"), F.sum("overlap_area_m2").alias("covered_m2"), best.alias("best"), F.first(own).alias("own_m2"), F.first("f.death_count").alias("death_count"))
    return found.select(
        *GROUP, "grid_x", "grid_y", "parent_size_m", "overlapped", F.col("best.x").alias("parent_x"), F.col("best.y").alias("parent_y"),
        round_to(ratio(-F.col("best.area"), "own_m2") * 100, 2).alias("overlap_pct"), round_to(ratio("covered_m2", "own_m2") * 100, 2).alias("covered_pct"),
        round_to(ratio("death_count", -F.col("best.deaths")) * 100, 2).alias("parent_death_share_pct"),
    )


def resolution_comparison(fine: DataFrame, coarse: DataFrame) -> DataFrame:
    """Fine candidates with their best coarse parent, overlap percentage, tier and sentence; none overlapped is a new candidate."""
    attached = fine.join(best_overlaps(fine, coarse), [*GROUP, "grid_x", "grid_y"], "left").select("*", *_labels("-100-G"))
    area = (F.col("grid_max_x_m") - F.col("grid_min_x_m")) * (F.col("grid_max_y_m") - F.col("grid_min_y_m"))
    rank = F.col("candidate_rank_250m")
    tier = F.when(rank <= 3, "250m 우선 후보와 일치").when(rank <= 10, "250m 상위 후보와 일치").otherwise("100m 신규 후보")
    judged = attached.withColumn("overlap_with_250m_pct", round_to(ratio("overlap_area_m2", area) * 100, 2)).withColumn("resolution_status", tier)
    ending = F.when(rank.isNull(), "250m 상위 10순위와 겹치지 않는 신규 후보.").otherwise(joined("250m ", rank, "순위 후보와 ", F.col("overlap_with_250m_pct"), "% 겹침."))
    return judged.select(
        F.col("candidate_id").alias("candidate_id_100m"), "map_name_ko", "death_cause_ko", F.col("coordinate_range_km").alias("coordinate_range_100m"), "death_count", "distinct_match_count", "distinct_date_count",
        F.col("first_death_date").alias("observed_from"), F.col("last_death_date").alias("observed_to"), F.col("deaths_per_match").alias("deaths_per_affected_match"), "death_share_pct",
        F.col("hotspot_candidate_rank").alias("candidate_rank_100m"), F.col("grid_x").alias("grid_x_100m"), F.col("grid_y").alias("grid_y_100m"), "grid_250_x", "grid_250_y", "candidate_rank_250m",
        "overlap_with_250m_pct", "resolution_status", joined(*_said(" 100m "), ending).alias("report_summary"), *GROUP,
    )


def candidate_lift(events: DataFrame, raw: DataFrame, focus_map: str, focus_cause: str, focus_rank: int = 2, causes: tuple[str, ...] = C.CAUSES, size_m: int = 100, child_m: int = 10) -> DataFrame:
    """One focus cell against the ring of its eight neighbours: cause shares, their lift, shares of its top detail cells.

    Shares count raw rows; the focus and its details count clean events. No focus cell, no row. The focus is
    one row, found first, so that what lies around it is filtered by plain bounds.
    """
    size = size_m * C.CM_PER_M
    caused = F.col("killed_by") == focus_cause
    # ranks are within the group, so only the group's events need be counted
    ranked = ranked_cells(events.where((F.col("map") == focus_map) & caused), size_m, "count_rank").where(F.col("count_rank") == focus_rank)
    found = ranked.take(1)
    focus = events.sparkSession.createDataFrame(found, ranked.schema)
    at = {"x": found[0].grid_x, "y": found[0].grid_y} if found else {"x": 0, "y": 0}

    def within(reach: int) -> Column:
        def axis(a: str) -> Column:
            position = F.col(f"victim_position_{a}")
            return (position >= float((at[a] - reach) * size)) & (position < float((at[a] + 1 + reach) * size))

        return (F.col("map") == focus_map) & axis("x") & axis("y")

    inside, ring = within(0), within(1) & ~within(0)
    around = raw.agg(
        F.count("*").alias("raw_input_rows"),
        F.count_if(F.col("killed_by").isin(*causes)).alias("raw_environmental_rows"),
        F.count_if(inside).alias("cell_all"),
        F.count_if(inside & caused).alias("cell_cause"),
        F.count_if(ring).alias("ring_all"),
        F.count_if(ring & caused).alias("ring_cause"),
    )
    # one pass over the events counts all of them and those of the focus by its detail cells, (size_m / child_m) ** 2 at most
    at_detail = F.when(within(0) & caused, F.struct(*(cell(f"victim_position_{a}", child_m * C.CM_PER_M).alias(a) for a in "xy")))
    counts = events.groupBy(at_detail.alias("detail")).agg(F.count("*").alias("n"))
    ordered = F.sort_array(F.collect_list(F.when(F.col("detail").isNotNull(), F.col("n"))), asc=False)
    clean = counts.agg(F.sum("n").alias("final_analysis_rows"), ordered.alias("n")).select("final_analysis_rows", F.get("n", F.lit(0)).alias("top_one"), F.aggregate(F.slice("n", 1, 3), F.lit(0).cast("long"), lambda a, b: a + b).alias("top_three"))
    both = focus.crossJoin(F.broadcast(around)).crossJoin(F.broadcast(clean))
    return both.select(
        *GROUP, "count_rank", "grid_x", "grid_y", "death_count", "match_count", "date_count", "raw_input_rows", "raw_environmental_rows", "final_analysis_rows",
        F.col("cell_all").alias("cell_all_death_count"),
        round_to(ratio("cell_cause", "cell_all") * 100, 2).alias("cell_cause_share_pct"),
        F.col("ring_all").alias("neighbor_all_death_count"),
        F.col("ring_cause").alias("neighbor_cause_death_count"),
        round_to(ratio("ring_cause", "ring_all") * 100, 2).alias("neighbor_cause_share_pct"),
        round_to(ratio(ratio("cell_cause", "cell_all"), ratio("ring_cause", "ring_all")), 2).alias("neighbor_lift"),
        F.col("top_one").alias("top_detail_death_count"),
        round_to(ratio("top_one", "death_count") * 100, 2).alias("top_detail_share_pct"),
        round_to(ratio("top_three", "death_count") * 100, 2).alias("top_three_detail_share_pct"),
    )
