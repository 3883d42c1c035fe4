"""Reviews of suggested links as a table: submissions are checked, and win by the version that they have seen."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .editorial import CODE

EDGE = ["language", "target_id", "source_id"]
# What a review may say, and the greatest id and version.
STATUSES = ("fixed", "not_fixed", "bad_link")
MAX_ID = 2**53 - 1


def judged(submissions: DataFrame, edges: DataFrame, reviews: DataFrame) -> DataFrame:
    """The submissions with outcome: invalid, missing_edge, conflict or saved.

    submissions(language, target_id, source_id, status, version, position), edges(language, target_id,
    source_id) that are published, reviews(language, target_id, source_id, status, version). An edge
    without a review has version 0. All submissions have seen the reviews as they are here, so of those of
    one edge the first by position is saved, and the others conflict. A null in a submission makes it
    invalid; one that is repeated under its position counts once and has one outcome.
    """
    a_page = lambda c: F.col(c).between(1, MAX_ID)
    valid = F.col("language").rlike(CODE) & (F.col("language") != "all") & a_page("target_id") & a_page("source_id") & (F.col("target_id") != F.col("source_id"))
    valid = F.coalesce(valid & F.col("status").isin(*STATUSES) & F.col("version").between(0, MAX_ID - 1) & F.col("position").isNotNull(), F.lit(False))
    known = edges.select(*EDGE).distinct().withColumn("_edge", F.lit(True))
    now = reviews.select(*EDGE, F.col("version").alias("_now"))
    rows = submissions.join(known, EDGE, "left").join(now, EDGE, "left")
    seen = F.col("version") == F.coalesce("_now", F.lit(0))
    rows = rows.withColumn("outcome", F.when(~valid, "invalid").when(F.col("_edge").isNull(), "missing_edge").when(~seen, "conflict").otherwise("saved")).drop("_edge", "_now")
    first = rows.filter("outcome = 'saved'").groupBy(*EDGE).agg(F.min(F.struct("position", "status")).alias("_first"))
    lost = (F.col("outcome") == "saved") & (F.struct("position", "status") != F.col("_first"))
    return rows.join(first, EDGE, "left").withColumn("outcome", F.when(lost, "conflict").otherwise(F.col("outcome"))).drop("_first")


def applied(outcomes: DataFrame, reviews: DataFrame) -> DataFrame:
    """The reviews after the saved submissions of judged(): each has a new status and the next version."""
    saved = outcomes.filter("outcome = 'saved'").groupBy(*EDGE).agg(F.first("status").alias("_status"), (F.first("version") + 1).alias("_version"))
    rows = reviews.select(*EDGE, "status", "version").join(saved, EDGE, "full")
    return rows.select(*EDGE, F.coalesce("_status", "status").alias("status"), F.coalesce("_version", "version").alias("version"))


def listed(reviews: DataFrame, languages: list[str]) -> DataFrame:
    """The reviews of a dataset's editions, by edition, target and source."""
    return reviews.filter(F.col("language").isin(sorted(set(languages)))).orderBy(*EDGE)
