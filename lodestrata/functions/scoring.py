"""Rewards, ratios and percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def patch_reward(applied: Column, passed: Column, passed_before: Column) -> Column:
    """Applying gains 0.25 or loses 1, passing gains 1 or loses 0.5, a task that passed before loses 0.25."""
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.when(yes(applied), 0.25).otherwise(-1.0) + F.when(yes(passed), 1.0).otherwise(-0.5) + F.when(yes(passed_before), -0.25).otherwise(0.0)


def tiered_reward(solved: Column, applied: Column) -> Column:
    return F.when(solved.eqNullSafe(True), 1.0).when(applied.eqNullSafe(True), -0.25).otherwise(-1.0)


def ratio(part: Column, whole: Column, places: int = 6) -> Column:
    """0 if there is nothing to divide by."""
    return F.round(F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0)), places)


def nearest_index_percentiles(rows: DataFrame, groups: list[str], value: str, quantiles: dict[str, float]) -> DataFrame:
    """For each group the value at index ``round_half_even((n - 1) * q)`` of the sorted values.

    Values are counted first, so what is ordered are a group's distinct values, never its rows."""
    counted = rows.groupBy(*groups, value).agg(F.count("*").alias("n"))
    own = Window.partitionBy(*groups)
    placed = counted.select(
        *groups, value, F.sum("n").over(own).alias("total"),
        F.sum("n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
    )
    index = lambda q: F.bround((F.col("total") - 1) * q, 0)
    return placed.groupBy(*groups).agg(*[F.min(F.when(F.col("upto") > index(q), F.col(value))).alias(name) for name, q in quantiles.items()])
