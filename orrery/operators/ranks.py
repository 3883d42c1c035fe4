"""Exact ranks and quantiles within groups, on counts of distinct values in ranges: no group is one task's or one buffer's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

RANGES = 64


def ranked(values: DataFrame, by: list[str]) -> DataFrame:
    """values(by, value, n) with first, last (the ranks of the value's rows, from 0) and total, all within by.

    Each group's values are cut into RANGES ranges; a window runs over the distinct values of one range,
    another over the ranges of a group. What is broadcast has RANGES rows a group.
    """
    cuts = values.groupBy(*by).agg(F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)], 1000).alias("cuts"))
    spread = values.join(F.broadcast(cuts), by) if by else values.join(F.broadcast(cuts))
    placed = spread.withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts")
    sums = placed.groupBy(*by, "range").agg(F.sum("n").alias("in_range"))
    over = Window.partitionBy(*by)
    upto = over.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*by, "range", F.coalesce(F.sum("in_range").over(upto), F.lit(0)).alias("before"), F.sum("in_range").over(over).alias("total"))
    own = F.sum("n").over(Window.partitionBy(*by, "range").orderBy("value"))
    rows = placed.withColumn("own", own).join(F.broadcast(before), [*by, "range"])
    return rows.select(*by, "value", "n", (F.col("before") + F.col("own") - F.col("n")).alias("first"), (F.col("before") + F.col("own") - 1).alias("last"), "total")


def counted(rows: DataFrame, by: list[str], value: Column) -> DataFrame:
    """by, value, n: the distinct known values."""
    known = rows.select(*by, value.cast("double").alias("value")).filter("value IS NOT NULL AND NOT isnan(value)")
    return known.groupBy(*by, "value").agg(F.count("*").alias("n"))


def quantile(rows: DataFrame, by: list[str], value: Column, share: float, name: str) -> DataFrame:
    """by, name: the quantile of the known values, between two ranks in proportion; groups without values have no row."""
    at = (F.col("total") - 1) * F.lit(float(share))
    holds = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank <= F.col("last")), F.col("value")))
    ends = ranked(counted(rows, by, value), by).groupBy(*by).agg(holds(F.floor(at)).alias("low"), holds(F.ceil(at)).alias("high"), F.max(at - F.floor(at)).alias("part"))
    return ends.select(*by, (F.col("low") + (F.col("high") - F.col("low")) * F.col("part")).alias(name))
