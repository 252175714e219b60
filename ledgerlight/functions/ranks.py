"""Ranks and percentiles within large groups, from histograms.

Values are counted per group first. Their counts are summed over ranges of values, the ranges' sums are accumulated per group (some thousand rows at
most), and inside a range the values' own counts are. So no task holds a group, however many rows it has, and rows get
their ranks by a join with the counted values, which the adaptive planner broadcasts if they are few.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values per doubling.
RANGES = 256


def value_range(value: Column) -> Column:
    """A number that never falls as ``value`` grows; values within about 1/RANGES of a doubling share one."""
    v = value.cast("double")
    return (F.signum(v) * F.floor(F.log2(1 + F.abs(v)) * RANGES)).cast("int")


def value_positions(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """(by, value, N_BELOW, N_TIES, N_GROUP): per distinct value of a group the rows below it, at it, and all rows with a value."""
    by = list(by)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("N_TIES")).withColumn("_RANGE", value_range(F.col(value)))
    group = Window.partitionBy(*by)
    ranges = (
        counted.groupBy(*by, "_RANGE")
        .agg(F.sum("N_TIES").alias("_SUM"))
        .select(
            *by,
            "_RANGE",
            F.coalesce(F.sum("_SUM").over(group.orderBy("_RANGE").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_BEFORE"),
            F.sum("_SUM").over(group).alias("N_GROUP"),
        )
    )
    inside = Window.partitionBy(*by, "_RANGE").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_INSIDE", F.coalesce(F.sum("N_TIES").over(inside), F.lit(0)))
    on = reduce(lambda a, b: a & b, [F.col(f"p.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, "_RANGE"]])
    return placed.alias("p").join(ranges.alias("r"), on).select(
        *(F.col(f"p.{c}").alias(c) for c in [*by, value]), (F.col("_BEFORE") + F.col("_INSIDE")).alias("N_BELOW"), "N_TIES", "N_GROUP"
    )


def _joined(df: DataFrame, value: str, by: Sequence[str], name: str, rank: Column) -> DataFrame:
    keys = [*by, value]
    found = value_positions(df, value, by).select(*(F.col(c).alias(f"_{i}_KEY") for i, c in enumerate(keys)), rank.alias(name))
    on = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_{i}_KEY")) for i, c in enumerate(keys)])
    return df.join(found, on, "left").drop(*(f"_{i}_KEY" for i in range(len(keys))))


def with_percent_rank(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """``df`` with (rank - 1) / (n - 1) of each value in its group, ties at their lowest rank; 0 for a single row, null for null."""
    others = F.col("N_GROUP") - 1
    return _joined(df, value, by, name, F.when(others == 0, 0.0).otherwise(F.col("N_BELOW") / others))


def with_average_rank(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """``df`` with rank / n of each value in its group, ties at their mean rank; null for null."""
    return _joined(df, value, by, name, ((F.col("N_BELOW") + (F.col("N_TIES") + 1) / 2.0) / F.col("N_GROUP")).cast("double"))


def medians(df: DataFrame, value: str, by: Sequence[str], name: str) -> DataFrame:
    """(by, name): the median of each group's values, the mean of the two middle ones where their number is even. Groups of nulls have no row."""
    low, high = F.floor((F.col("N_GROUP") - 1) / 2), F.floor(F.col("N_GROUP") / 2)
    at = lambda place: (F.col("N_BELOW") <= place) & (place < F.col("N_BELOW") + F.col("N_TIES"))
    pick = lambda place: F.max(F.when(at(place), F.col(value)))
    placed = value_positions(df, value, by)
    return placed.groupBy(*by).agg(((pick(low) + pick(high)) / 2.0).alias(name))
