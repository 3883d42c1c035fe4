"""The history supplement: one record per page of the census, from revisions, page events, edits and user groups.

Times are texts YYYY-MM-DD HH:MM:SS[.f], as the event log has them, and null or unknown stays apart
from zero: a page without a usable creator has null measures, not zeros.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .history import attribution, bot_flags, continuity, creation_dates, month_index, normalised, page_events, periods, prior_edits, tenure_days

MEASURES = ("prior_main", "prior_other", "prior_articles", "months")
# The creator columns of an observation before any source is joined.
CREATOR_FIELDS = (
    "creator_key", "creator_attribution", "creator_account_type", "creator_is_bot_now", "creator_account_type_at_creation", "creator_registered_at", "creator_tenure_days", "creator_tenure_status",
    "creator_prior_edits_main", "creator_prior_edits_other", "creator_prior_articles", "creator_articles_created_total", "creator_languages_created", "creator_languages_before", "origin", "creation_tags",
    "import_log_observed", "move_log_observed", "creator_experience_status", "creator_orphans_at_30_days", "creator_articles_in_census", "creator_orphans_current", "creator_orphans_current_share",
)


def time_key(at: Column) -> Column:
    """A struct that orders times to the nanosecond, a second 60 after every other of its minute; null if it is no time."""
    parts = lambda k: F.regexp_extract(at, r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}):(\d{2})(?:\.(\d{1,9}))?\z", k)
    minute = F.try_to_timestamp(F.nullif(parts(1), F.lit("")), F.lit("yyyy-MM-dd HH:mm"))
    second, fraction = parts(2).try_cast("int"), F.rpad(parts(3), 9, "0").cast("int")
    valid = minute.isNotNull() & (second <= 60) & ~at.startswith("0000")
    return F.when(valid, F.struct(minute.alias("minute"), second.alias("second"), fraction.alias("nanos")))


def census_rows(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows whose page is in the census."""
    return rows.join(pages.select("page_id").distinct(), "page_id", "left_semi")


def attributed_edits(edits: DataFrame, records: DataFrame) -> DataFrame:
    """The edits of users who are some page's creator. records: as records() gives them."""
    users = records.select(F.col("creator_user_id").alias("user_id")).filter("user_id IS NOT NULL").distinct()
    return edits.join(users, "user_id", "left_semi")


def initial_revisions(revisions: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, initial_status (one, missing, ambiguous), initial (the revision, as a struct, if there is one).

    revisions(page_id, revision_id, parent_id, at, user_id, ...); those without a parent have parent_id 0.
    """
    own = F.struct(*(c for c in revisions.columns if c not in ("page_id", "parent_id")))
    per = revisions.filter("parent_id = 0").groupBy("page_id").agg(F.count("*").alias("n"), F.min_by(own, "revision_id").alias("initial"))
    rows = pages.select("page_id").join(per, "page_id", "left")
    status = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("one")
    return rows.select("page_id", status.alias("initial_status"), F.when(F.col("n") == 1, F.col("initial")).alias("initial"))


def creator_key(database: str, user: Column) -> Column:
    return F.when(user.isNotNull(), F.concat(F.lit(f"{database}:history-user:"), user.cast("string")))


def listed(names: Column) -> Column:
    """A list in one text, parted by commas; the empty text is unknown."""
    return F.when(names != "", F.split(names, ","))


def records(revisions: DataFrame, events: DataFrame, stamps: DataFrame, pages: DataFrame, database: str) -> DataFrame:
    """What is known of each page's beginning and creator, before any activity. events and stamps: as page_events() and creation_dates() take them."""
    rows = initial_revisions(revisions, pages).join(page_events(events), "page_id", "left").join(creation_dates(stamps, pages), "page_id")
    r = F.col("initial")
    told = attribution(r["at"], r["created"], r["first"], F.coalesce("imported", F.lit(False)), r["before"], F.coalesce("creates", F.lit(0)), F.col("first_create"), r["hidden"], r["user_id"])
    status = F.when(F.col("initial_status") == "missing", "history_missing_initial_revision").when(F.col("initial_status") == "ambiguous", "history_ambiguous_initial_revisions").otherwise(told)
    rows = rows.withColumn("creator_attribution", status)
    known = lambda c: F.when(F.col("creator_attribution") == "history_initial_revision_observed", c)
    return rows.select(
        "page_id", r["revision_id"].alias("first_revision_id"), normalised(r["at"]).alias("article_created_at"), "creator_attribution", known(r["user_id"]).alias("creator_user_id"),
        known(creator_key(database, r["user_id"])).alias("creator_key"), known(listed(r["groups"])).alias("creator_groups_at_creation"), known(listed(r["tags"])).alias("creation_tags_history"),
        known(normalised(r["registration"])).alias("creator_registered_at"), F.col("created").alias("page_created_at"), "creation_status",
    ).withColumn("creator_groups_status", F.when(F.col("creator_groups_at_creation").isNotNull(), "observed").otherwise("unknown"))


def activity(known: DataFrame, edits: DataFrame) -> DataFrame:
    """page_id, prior_main, prior_other, prior_articles, months: of the pages with a creator and a creation date, strictly before it.

    edits(user_id, at, ns). One edit without a readable time makes all dated measures of its user unknown.
    """
    own = attributed_edits(edits, known).select("user_id", F.unix_micros(normalised(F.col("at"))).alias("us"), "ns")
    bad = own.groupBy("user_id").agg(F.bool_or(F.col("us").isNull()).alias("bad")).filter("bad")
    made = known.filter("creator_user_id IS NOT NULL AND page_created_at IS NOT NULL").select("page_id", F.col("creator_user_id").alias("user_id"), F.unix_micros("page_created_at").alias("us"))
    sound, usable = own.join(bad, "user_id", "left_anti"), made.join(bad, "user_id", "left_anti")
    runs = periods(sound, month_index(F.col("us")))
    months = usable.select("page_id", "user_id", (month_index(F.col("us")) - 1).alias("period")).join(runs, ["user_id", "period"], "left").select("page_id", F.coalesce("streak", F.lit(0)).cast("long").alias("months"))
    counts = prior_edits(usable, sound).select("page_id", *MEASURES[:3]).join(months, "page_id")
    return made.select("page_id").join(counts, "page_id", "left")


def supplement(revisions: DataFrame, events: DataFrame, stamps: DataFrame, edits: DataFrame, groups: DataFrame, pages: DataFrame, snapshot: Column, database: str) -> DataFrame:
    """The record of each page: records(), the creator's activity, tenure and whether it is a bot now."""
    known = records(revisions, events, stamps, pages, database)
    rows = known.join(activity(known, edits).withColumn("dated", F.lit(True)), "page_id", "left")
    rows = rows.join(bot_flags(groups, snapshot).withColumnRenamed("user_id", "creator_user_id").withColumn("grouped", F.lit(True)), "creator_user_id", "left")
    has = F.col("creator_user_id").isNotNull()
    status = F.when(~has, "unavailable").when(F.col("dated") & F.col("prior_main").isNull(), "invalid_history_timestamp").otherwise("observed_surviving_history")
    tenure = tenure_days(F.unix_micros("page_created_at"), F.unix_micros("creator_registered_at"))
    bot = F.when(has, F.when(F.col("grouped"), F.col("bot")).otherwise(False))
    return rows.select(*known.columns, *MEASURES, continuity(F.col("months")).alias("bucket"), tenure.alias("tenure_days"), bot.alias("is_bot_now"), status.alias("creator_history_status")).withColumn("bucket", F.when(F.col("months").isNotNull(), F.col("bucket")))


def initialised(rows: DataFrame) -> DataFrame:
    """rows with the creator columns that they lack, null, and the statuses of what was never collected."""
    fixed = {"origin": "unknown", "creator_data_status": "not_collected", "creator_orphans_at_30_days_status": "unavailable_no_historical_link_graph"}
    return rows.withColumns({c: F.lit(None).cast("string") for c in CREATOR_FIELDS if c not in rows.columns} | {k: F.lit(v) for k, v in fixed.items()})


def observed_history(rows: DataFrame, records_: DataFrame | None, missing_status: str = "missing_page") -> DataFrame:
    """rows(page_id, created_at, ...) with the history of their pages; the record's creation date replaces theirs, known or not.

    A page that stands in several rows keeps as many. Without records every row is not_collected. A page without a known first revision, or without an
    attributed creator, has no creator columns.
    """
    if records_ is None:
        return rows.withColumn("history_data_status", F.lit("not_collected"))
    joined = rows.withColumnRenamed("created_at", "_created").join(records_.withColumn("_has", F.lit(True)), "page_id", "left")
    unknown, observed = F.col("article_created_at").isNull(), F.col("creator_history_status") == "observed_surviving_history"
    status = F.when(F.col("_has").isNull(), missing_status).when(unknown, "history_initial_revision_unknown").when(~observed, "unattributed_history").otherwise("matched_reconstructed_history")
    matched = lambda c: F.when(F.col("history_data_status") == "matched_reconstructed_history", F.col(c))
    told = joined.withColumn("history_data_status", status)
    return told.select(
        *(c for c in rows.columns if c != "created_at"), F.when(F.col("_has"), F.col("page_created_at")).otherwise(F.col("_created")).alias("created_at"),
        F.when(F.col("_has"), F.col("creation_status")).alias("creation_date_status"), F.col("article_created_at").alias("history_first_revision_at"),
        F.when(~unknown, F.col("creator_attribution")).alias("history_creator_status"), matched("creator_key").alias("history_creator_key"),
        *(matched(c).alias(c) for c in (*MEASURES, "bucket", "tenure_days", "is_bot_now")), "history_data_status",
        F.when(F.col("history_data_status") == "matched_reconstructed_history", F.when(F.col("tenure_days").isNull(), "missing_or_inconsistent_registration").otherwise("local_registration_to_reconstructed_creation")).alias("creator_tenure_status"),
    )
