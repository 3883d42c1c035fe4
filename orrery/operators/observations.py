"""The wide observation row: ages, statuses and joins of the supplements, with unknown apart from zero."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def measured(x: Column) -> Column:
    """Finite and not negative, else unknown."""
    return F.when(~F.isnan(x) & (x >= 0) & (x < F.lit(float("inf"))), x)


def age_days(at: Column, reference: Column) -> Column:
    """Days from one time to another, both in microseconds; null if negative."""
    gap = (reference - at) / F.lit(86_400e6)
    return F.when(gap >= 0, gap)


def age_status(at: Column, reference: Column) -> Column:
    return F.when(at.isNull(), "unknown").when(at > reference, "after_graph_collection").otherwise("known")


def joined_history(census: DataFrame, history: DataFrame) -> DataFrame:
    """Adds the history columns and history_data_status. history(language, page_id, first_revision_id, creator_key, ...)."""
    rows = census.join(history.withColumn("has_history", F.lit(True)), ["language", "page_id"], "left")
    status = F.when(F.col("has_history").isNull(), "missing_page").when(F.col("first_revision_id").isNull(), "history_initial_revision_unknown").when(F.col("creator_key").isNull(), "unattributed_history").otherwise("matched_reconstructed_history")
    return rows.withColumn("history_data_status", status).drop("has_history")


def strictly_joined(left: DataFrame, supplement: DataFrame, keys: list[str], name: str) -> DataFrame:
    """An inner join in which every row must have its record; a missing one is an error when it is reached."""
    rows = left.join(supplement.withColumn("_has", F.lit(True)), keys, "left")
    return rows.filter(F.when(F.col("_has").isNull(), F.raise_error(F.lit(f"{name}: a page has no record")).cast("boolean")).otherwise(True)).drop("_has")


def revision_relation(sql_revision: Column, content_revision: Column) -> Column:
    return F.when(content_revision.isNull(), "unavailable").when(sql_revision.eqNullSafe(content_revision), "same").otherwise("different")


def category_status(manual: Column, choice: Column) -> Column:
    return F.when(manual, "reviewed").when(choice.isNotNull(), "heuristic_review_needed").otherwise("no_eligible_category")


#: Creator measures that no source supports; they are null by contract.
UNSUPPORTED = ("creator_edit_count", "creator_registered_at", "creator_tenure_days", "creator_prior_main", "creator_prior_other", "creator_prior_articles", "creator_active_months")


def with_unsupported(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in UNSUPPORTED if c not in df.columns} | {"origin": F.lit("unknown")})


def collection_interval(rows: DataFrame, by: list[str]) -> DataFrame:
    """Earliest start and latest finish by instant, as the strings they were; the first position wins ties. rows(started, finished, position)."""
    start, finish = F.struct(F.try_to_timestamp("started"), F.col("position")), F.struct(F.try_to_timestamp("finished"), -F.col("position"))
    return rows.groupBy(*by).agg(F.min_by("started", start).alias("started"), F.max_by("finished", finish).alias("finished"))


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once; the census has none."""
    return rows.groupBy(*keys).count().filter("count > 1")


def set_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either side that the other lacks, with the side that has them; empty if the sets are equal."""
    a, b = left.select(*keys).distinct(), right.select(*keys).distinct()
    return a.join(b, keys, "left_anti").withColumn("side", F.lit("left")).union(b.join(a, keys, "left_anti").withColumn("side", F.lit("right")))


def latest_entries(entries: DataFrame) -> DataFrame:
    """One entry per language: the latest by date, publication and file name."""
    order = Window.partitionBy("language").orderBy(F.desc("date"), F.desc("published_at"), F.desc("file"))
    return entries.withColumn("k", F.row_number().over(order)).filter("k = 1").drop("k")


def mixed(values: Column) -> Column:
    """An aggregate: the common value of the members, or mixed_per_language."""
    return F.when(F.count_distinct(values) <= 1, F.min(values)).otherwise("mixed_per_language")
