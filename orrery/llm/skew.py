"""Joins with a table of unique keys where a few keys may hold most of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SHARE, FEW = 1000, 64


def lookup(rows: DataFrame, table: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """rows joined with table by key, which is unique in table and has one type in both; how: inner or left.

    Keys of over FEW rows that hold 1 / SHARE of the rows or more, of which there are SHARE at most, are
    looked up in a broadcast part of table, so that no key's rows have to meet in one task; all others are
    shuffled. Whether there are such keys is asked first: without them a plain join is a third of the plan.
    rows is read several times and should be a written table. Null keys find nothing.
    """
    total = rows.count()
    often = rows.groupBy(key).agg(F.count("*").alias("_n")).filter((F.col("_n") * SHARE >= total) & (F.col("_n") > FEW) & F.col(key).isNotNull()).select(key)
    if total <= FEW or often.isEmpty():
        return rows.join(table, key, how)
    hot = F.broadcast(often)
    few = F.broadcast(table.join(hot, key, "left_semi"))
    return rows.join(hot, key, "left_semi").join(few, key, how).unionByName(rows.join(hot, key, "left_anti").join(table, key, how))
