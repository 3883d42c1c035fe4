"""Creation, attribution and prior activity from an event log; times are microseconds of the epoch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

DAY_US = 86_400_000_000
MONTH_THRESHOLD = 5


def normalised(at: Column) -> Column:
    """YYYY-MM-DD HH:MM:SS[.f] as a timestamp, null if it isn't one; the year 0000 and second 60 are none."""
    ok = at.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-5][0-9](\.[0-9]+)?\z")
    return F.when(ok, F.try_to_timestamp(F.regexp_replace(at, r"(\.[0-9]{1,6})[0-9]*\z", "$1")))


def creation_dates(stamps: DataFrame, pages: DataFrame) -> DataFrame:
    """page_id, created, creation_status. stamps(page_id, at): one distinct time is known, none is missing, several or an invalid one are ambiguous."""
    per = stamps.filter("at <> ''").select("page_id", normalised(F.col("at")).alias("t")).groupBy("page_id").agg(F.count_distinct(F.coalesce(F.col("t").cast("string"), F.lit("?"))).alias("n"), F.min("t").alias("t"), F.bool_or(F.col("t").isNull()).alias("bad"))
    joined = pages.select("page_id").join(per, "page_id", "left")
    status = F.when(F.col("n").isNull(), "missing_history_creation").when((F.col("n") > 1) | F.col("bad"), "ambiguous_history_creation").otherwise("reconstructed_history")
    return joined.select("page_id", F.when(status == "reconstructed_history", F.col("t")).alias("created"), status.alias("creation_status"))


def page_events(events: DataFrame) -> DataFrame:
    """page_id, creates, first_create, imported of events(page_id, event_type, at)."""
    create = F.col("event_type") == "create"
    return events.groupBy("page_id").agg(F.count_if(create).alias("creates"), F.min(F.when(create, F.col("at"))).alias("first_create"), F.bool_or(F.col("event_type").isin("import", "merge")).alias("imported"))


def attribution(at: Column, created: Column, first: Column, imported: Column, before: Column, creates: Column, first_create: Column, hidden: Column, user: Column) -> Column:
    """The precedence of what is known of an initial revision."""
    differs = lambda c: (c.isNotNull() & (c != "") & (c != at))
    return (
        F.when(normalised(at).isNull() | differs(created) | differs(first), "history_inconsistent_creation_dates")
        .when(imported | before | (creates > 1), "history_imported_or_ambiguous")
        .when((creates > 0) & ~first_create.eqNullSafe(at), "history_create_event_mismatch")
        .when(hidden | user.isNull(), "history_hidden_or_unregistered_creator")
        .otherwise("history_initial_revision_observed")
    )


def bot_flags(groups: DataFrame, snapshot: Column) -> DataFrame:
    """user_id, bot (null: unknown). groups(user_id, name, expiry as 14 digits or null)."""
    expiry = F.try_to_timestamp(F.col("expiry"), F.lit("yyyyMMddHHmmss"))
    per = groups.filter("name = 'bot'").groupBy("user_id").agg(F.bool_or(F.col("expiry").isNull() | F.coalesce(expiry > snapshot, F.lit(False))).alias("now"), F.bool_or(F.col("expiry").isNotNull() & expiry.isNull()).alias("unclear"))
    return per.select("user_id", F.when(F.col("now"), True).when(~F.col("unclear"), False).alias("bot"))


def prior_edits(creations: DataFrame, edits: DataFrame) -> DataFrame:
    """page_id, user_id, us, prior_main, prior_other, prior_articles: strictly before the creation. Edits of one user and instant are one row before the window."""
    grouped = edits.groupBy("user_id", "us").agg(F.count_if(F.col("ns") == 0).alias("main"), F.count_if(F.col("ns") != 0).alias("other"))
    both = grouped.withColumn("page_id", F.lit(None).cast("long")).unionByName(creations.select("user_id", "us", "page_id", F.lit(0).cast("long").alias("main"), F.lit(0).cast("long").alias("other")))
    before = Window.partitionBy("user_id").orderBy("us").rangeBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("long")
    articles = F.coalesce(F.count("page_id").over(before), F.lit(0)).cast("long")
    return both.select("page_id", "user_id", "us", count("main").alias("prior_main"), count("other").alias("prior_other"), articles.alias("prior_articles")).filter("page_id IS NOT NULL")


def recent(edits: DataFrame, most: int = 100) -> DataFrame:
    """The latest edits of all users, the newest first; ties by event_id. A top-k report, so each task keeps `most` rows."""
    return edits.orderBy(F.desc_nulls_last("us"), F.asc("event_id")).limit(most)


def periods(edits: DataFrame, period: Column, threshold: int = MONTH_THRESHOLD) -> DataFrame:
    """user_id, period, streak: the active periods (threshold edits or more) that end with this one."""
    active = edits.groupBy("user_id", period.alias("period")).agg(F.count("*").alias("n")).filter(F.col("n") >= threshold)
    order = Window.partitionBy("user_id").orderBy("period")
    islands = active.withColumn("island", F.col("period") - F.row_number().over(order))
    return islands.select("user_id", "period", F.row_number().over(Window.partitionBy("user_id", "island").orderBy("period")).cast("long").alias("streak"))


def streaks(creations: DataFrame, edits: DataFrame, period, threshold: int = MONTH_THRESHOLD) -> DataFrame:
    """page_id, streak, bucket: active periods in a row up to the one before the creation's. period: a function of the time column."""
    runs = periods(edits, period(F.col("us")), threshold)
    at = creations.select("page_id", "user_id", (period(F.col("us")) - 1).alias("period"))
    n = F.coalesce("streak", F.lit(0)).cast("long")
    return at.join(runs, ["user_id", "period"], "left").select("page_id", n.alias("streak"), continuity(n).alias("bucket"))


def continuity(n: Column) -> Column:
    return F.when(n == 0, "none").when(n == 1, "one").when(n == 2, "two").when(n <= 6, "three_to_six").when(n <= 12, "seven_to_twelve").when(n <= 24, "thirteen_to_twenty_four").otherwise("over_twenty_four")


def month_index(us: Column) -> Column:
    t = F.timestamp_micros(us)
    return F.year(t) * 12 + F.month(t)


def day_index(us: Column) -> Column:
    return F.floor(us / DAY_US)


def tenure_days(created_us: Column, registered_us: Column) -> Column:
    gap = created_us - registered_us
    return F.when(gap >= 0, gap / F.lit(1e6) / F.lit(86400.0))
