"""Exact quantiles of groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slice_of(value: Column, per_unit: int) -> Column:
    """The narrow slice of values, `per_unit` to a unit, that a value lies in."""
    return F.floor(value * per_unit)


def exact_quantiles(values: DataFrame, slices: DataFrame, keys: Sequence[str], value: str, points: Sequence[float], per_unit: int, belongs: Callable[[str], Column] | None = None) -> DataFrame:
    """`keys` and q, the exact quantiles at `points` of `values` (keys, value), interpolated as Spark's percentile does.

    `slices` (keys, slice, n) holds the number of values in each slice. These counts tell which slices hold the
    two neighbouring ranks of each quantile; only the values there are counted and ordered, slice by slice, so
    `values` is read once and no task holds the values of a group. Groups must be few: at most two slices for
    each quantile of a group are broadcast. Where a value lies in several groups, belongs(key) is the condition
    that it lies in a group by that key, the group's being named of_<key>; else the keys must be equal.
    """
    whole = Window.partitionBy(*keys)
    before = Window.unboundedPreceding, -1
    summed = slices.groupBy(*keys, "slice").agg(F.sum("n").alias("in_slice")).where(F.col("slice").isNotNull()).select(
        "*",
        F.coalesce(F.sum("in_slice").over(whole.orderBy("slice").rowsBetween(*before)), F.lit(0)).alias("ahead"),
        F.sum("in_slice").over(whole).alias("total"),
    )
    at = [(F.col("total") - 1) * q for q in points]
    ranks = [(F.floor(x), F.ceil(x)) for x in at]

    def holds(first: Column, n: Column):
        return lambda rank: (rank >= first) & (rank < first + n)

    sliced = holds(F.col("ahead"), F.col("in_slice"))
    named = {c: f"of_{c}" for c in [*keys, "slice"]}
    chosen = summed.where(F.exists(F.array(*(r for pair in ranks for r in pair)), sliced)).select(*(F.col(c).alias(n) for c, n in named.items()), "ahead", "total")
    same = slice_of(F.col(value), per_unit) == F.col("of_slice")
    for c in keys:
        same &= belongs(c) if belongs else F.col(c).eqNullSafe(F.col(f"of_{c}"))
    known = values.join(F.broadcast(chosen), same).select(*(F.col(n).alias(c) for c, n in named.items()), value, "ahead", "total")
    counted = known.groupBy(*keys, "slice", value, "ahead", "total").agg(F.count("*").alias("n"))
    inside = Window.partitionBy(*keys, "slice").orderBy(value).rowsBetween(*before)
    placed = counted.withColumn("first", F.col("ahead") + F.coalesce(F.sum("n").over(inside), F.lit(0)))
    here = holds(F.col("first"), F.col("n"))
    ends = [F.max(F.when(here(r), F.col(value))).alias(f"{side}_{i}") for i, pair in enumerate(ranks) for side, r in zip(("low", "high"), pair)]
    found = placed.groupBy(*keys).agg(F.first("total").alias("total"), *ends)
    between = [F.when(F.col(f"low_{i}") == F.col(f"high_{i}"), F.col(f"low_{i}")).otherwise((high - x) * F.col(f"low_{i}") + (x - low) * F.col(f"high_{i}")) for i, (x, (low, high)) in enumerate(zip(at, ranks))]
    return found.select(*keys, F.array(*between).alias("q"))
