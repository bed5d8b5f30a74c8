"""Distance profiles of killings: percentiles by class and weapon, over all maps and each."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.expr import ratio, round_to
from ..sources.interim import settled
from .quantiles import exact_quantiles, slice_of

QUANTILES = {"median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}
#: Slices of a meter by which distances are counted before they are ordered.
SLICES_PER_M = 64
EVERYWHERE = "ALL"


def weapon_class(weapon: Column, classes: Mapping[str, tuple[str, ...]]) -> Column:
    """Class of a weapon, null if it is in none."""
    return F.element_at(F.create_map(*(F.lit(x) for name, weapons in classes.items() for w in weapons for x in (w, name))), weapon)


def distance_events(raw: DataFrame, maps: tuple[str, ...] = C.MAPS, classes: Mapping[str, tuple[str, ...]] = C.WEAPON_CLASSES, most_m: float = C.DISTANCE_MAX_M) -> DataFrame:
    """(map, weapon_class, killed_by, distance_m) of killings between two located, different, named actors with a known weapon."""
    places = [f"{who}_position_{axis}" for who in ("killer", "victim") for axis in "xy"]
    kept = F.col("map").isin(*maps) & F.col("killed_by").isin(*(w for weapons in classes.values() for w in weapons)) & (F.col("killer_name") != F.col("victim_name"))
    for place in places:
        kept &= F.col(place).between(C.COORD_MIN, C.COORD_MAX)
    for who in ("killer", "victim"):
        kept &= ~((F.col(f"{who}_position_x") == 0) & (F.col(f"{who}_position_y") == 0))
    apart = [F.col(f"killer_position_{a}") - F.col(f"victim_position_{a}") for a in "xy"]
    placed = raw.where(kept).select("map", "killed_by", (F.sqrt(apart[0] * apart[0] + apart[1] * apart[1]) / float(C.CM_PER_M)).alias("distance_m"))
    return placed.where(F.col("distance_m").between(0, most_m)).select("map", weapon_class(F.col("killed_by"), classes).alias("weapon_class"), "killed_by", "distance_m")


def distance_profiles(events: DataFrame, least: int = C.MIN_WEAPON_EVENTS) -> DataFrame:
    """One row per scope (a map or ALL), class and weapon; a null weapon is the class as a whole and has no least count.

    Percentiles are exact. The events are counted once, by map, class, weapon and slice of distance; scopes and
    whole classes are sums of those counts, and a second reading takes up only the slices that hold a quantile.
    """
    sliced = settled(
        events.groupBy("map", "weapon_class", "killed_by", slice_of(F.col("distance_m"), SLICES_PER_M).alias("slice")).agg(
            F.count("*").alias("n"),
            *(F.count_if(F.col("distance_m") >= d).alias(f"above_{d}") for d in (100, 300)),
        )
    )
    views = F.array(*(F.struct(scope.alias("scope"), weapon.alias("weapon")) for scope in (F.col("map"), F.lit(EVERYWHERE)) for weapon in (F.col("killed_by"), F.lit(None).cast("string"))))
    keys = ["scope", "weapon_class", "weapon"]
    viewed = sliced.select("weapon_class", "slice", "n", "above_100", "above_300", F.inline(views))
    counted = viewed.groupBy(*keys).agg(F.sum("n").alias("event_count"), *(F.sum(c).alias(c) for c in ("above_100", "above_300")))
    belongs = {
        "scope": (F.col("of_scope") == EVERYWHERE) | (F.col("of_scope") == F.col("map")),
        "weapon_class": F.col("of_weapon_class") == F.col("weapon_class"),
        "weapon": F.col("of_weapon").isNull() | (F.col("of_weapon") == F.col("killed_by")),
    }
    levels = exact_quantiles(events, viewed, keys, "distance_m", list(QUANTILES.values()), SLICES_PER_M, belongs.get).select(*(F.col(c).alias(f"q_{c}") for c in keys), "q")
    same = F.lit(True)
    for c in keys:
        same &= F.col(c).eqNullSafe(F.col(f"q_{c}"))
    found = counted.join(levels, same, "left")
    valid = sliced.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("valid_event_count"))
    return found.where(F.col("weapon").isNull() | (F.col("event_count") >= least)).crossJoin(F.broadcast(valid)).select(
        "scope",
        "weapon_class",
        F.col("weapon").alias("killed_by"),
        "event_count",
        *(round_to(F.col("q")[i], 1).alias(f"{name}_distance_m") for i, name in enumerate(QUANTILES)),
        *(round_to(ratio(f"above_{d}", "event_count") * 100, 2).alias(f"share_above_{d}m_pct") for d in (100, 300)),
        "valid_event_count",
    )


def report_order(profiles: DataFrame) -> DataFrame:
    """Profiles as a report lists them: all maps first, classes by range of use, the class as a whole before its weapons."""
    scope = F.when(F.col("scope") == "ALL", 0).when(F.col("scope") == C.MAPS[0], 1).otherwise(2)
    place = F.coalesce(F.array_position(F.array(*map(F.lit, C.CLASS_ORDER)), F.col("weapon_class")), F.lit(0))
    return profiles.orderBy(scope, F.when(place == 0, len(C.CLASS_ORDER) + 1).otherwise(place), F.col("killed_by").asc_nulls_first())


def distance_map_gaps(profiles: DataFrame, first: str = C.MAPS[0], second: str = C.MAPS[1]) -> DataFrame:
    """Weapons that have a profile over all and on both maps: events and medians on each, the gap and its size; the widest gap first."""
    weapons = settled(profiles).where("killed_by is not null")  # a row for each scope, class and weapon

    def of(scope: str, name: str) -> DataFrame:
        return weapons.where(F.col("scope") == scope).select("weapon_class", "killed_by", F.col("event_count").alias(f"{name}_event_count"), F.col("median_distance_m").alias(f"{name}_median_m"))

    everywhere = weapons.where("scope = 'ALL'").select("killed_by")
    gap = round_to(F.col("second_median_m") - F.col("first_median_m"), 1)
    both = of(first, "first").join(of(second, "second"), ["weapon_class", "killed_by"]).join(everywhere, "killed_by", "left_semi")
    return both.withColumn("median_gap_m", gap).withColumn("absolute_gap_m", F.abs("median_gap_m")).orderBy(F.desc("absolute_gap_m"), "killed_by")


def distance_summary(profiles: DataFrame, first: str = C.MAPS[0], second: str = C.MAPS[1], near: str = "Shotgun", far: str = "SR", middle: str = "DMR") -> DataFrame:
    """One row over all maps: events, weapons, classes, compared weapons and the median size of their gaps, medians of the
    nearest and the farthest class and their spread, the middle class's weapons of least and greatest median, the weapon
    of the greatest. Equal medians go to the weapon first in the report. What a table lacks is null.
    """
    profiles = settled(profiles)
    gaps = distance_map_gaps(profiles, first, second).agg(F.count("*").alias("map_comparison_count"), round_to(F.median("absolute_gap_m"), 1).alias("median_map_gap_m"))
    weapon, median = F.col("killed_by").isNotNull(), F.col("median_distance_m")
    place = F.array_position(F.array(*map(F.lit, C.CLASS_ORDER)), F.col("weapon_class"))
    of_class = {name: F.max(F.when(~weapon & (F.col("weapon_class") == name), median)) for name in (near, far)}
    own = F.when(weapon & (F.col("weapon_class") == middle), F.struct(median.alias("m"), "killed_by"))
    # least of (-median, place in the report), so that of equal medians the first wins
    least = F.when(weapon, F.struct((-median).alias("m"), place.alias("p"), "killed_by"))
    least_own = F.when(weapon & (F.col("weapon_class") == middle), F.struct((-median).alias("m"), "killed_by"))
    whole = profiles.where("scope = 'ALL'").agg(
        F.max("valid_event_count").alias("valid_event_count"),
        F.count_if(weapon).alias("weapon_count"),
        F.count_if(~weapon).alias("class_count"),
        of_class[near].alias("shotgun_median_m"),
        of_class[far].alias("sr_median_m"),
        round_to(of_class[far] - of_class[near], 1).alias("role_median_spread_m"),
        F.min(own)["killed_by"].alias("shortest_dmr"),
        F.min(own)["m"].alias("shortest_dmr_median_m"),
        F.min(least_own)["killed_by"].alias("longest_dmr"),
        (-F.min(least_own)["m"]).alias("longest_dmr_median_m"),
        F.min(least)["killed_by"].alias("longest_weapon"),
        (-F.min(least)["m"]).alias("longest_weapon_median_m"),
    )
    return whole.crossJoin(F.broadcast(gaps))
