"""Measures of a published table exchanged for those of new supplements; what isn't a measure stays."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def duplicated(table: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: the keys that several rows have; empty for a table that may be joined by them. Null is a value like any other."""
    return table.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def unmatched(rows: DataFrame, supplement: DataFrame, keys: list[str]) -> DataFrame:
    """keys, side: rows without a record (missing), and records of no row (unknown); empty if both hold the same pages."""
    one = lambda t, other, side: t.select(*keys).join(other.select(*keys), keys, "left_anti").withColumn("side", F.lit(side))
    return one(rows, supplement, "missing").union(one(supplement, rows, "unknown"))


def refreshed(rows: DataFrame, supplements: list[DataFrame], keys: list[str]) -> DataFrame:
    """rows with the columns of each supplement in the place of their own; a row without a record has null there.

    Columns keep their order, and every supplement column has to be one of rows: an export's columns are
    fixed. A supplement has one row per key (duplicated() tells), or rows would repeat; null keys find none.
    """
    now = rows
    for supplement in supplements:
        own = [c for c in supplement.columns if c not in keys]
        if foreign := set(own) - set(rows.columns):
            raise ValueError(f"not in the export: {sorted(foreign)}")
        now = now.drop(*own).join(supplement.select(*keys, *own), keys, "left")
    return now.select(*rows.columns)
