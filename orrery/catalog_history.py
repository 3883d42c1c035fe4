"""Queries of the history supplement, and the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from . import catalog
from .operators import supplement
from .plans.views import duckdb_with, spark_view

DATABASE, SNAPSHOT = "xxwiki", "2024-06-01 00:00:00"
TABLES = ("revision", "page_event", "stamp", "user_edit", "user_group", "history_page")


def query(name: str, sql: str):
    """As the catalog's; `at` is a keyword in DuckDB, so it is quoted there."""
    return catalog.query(name, re.sub(r"(?<![\w\".])at(?!\w)", '"at"', sql))


_OK = "({0} IS NOT NULL AND {0} <> 'bad' AND {0} NOT LIKE '%:60')"
RECORDS = duckdb_with(*TABLES) + f""",
first_one AS (SELECT page_id, count(*) AS n FROM revision WHERE parent_id = 0 GROUP BY page_id),
one AS (SELECT r.* FROM revision r JOIN first_one f ON f.page_id = r.page_id AND f.n = 1 WHERE r.parent_id = 0),
pe AS (SELECT page_id, count(*) FILTER (event_type = 'create') AS creates, min(at) FILTER (event_type = 'create') AS first_create, bool_or(event_type IN ('import', 'merge')) AS imported FROM page_event GROUP BY page_id),
st AS (SELECT page_id, count(DISTINCT at) AS n, min(at) AS at, bool_or(NOT {_OK.format('at')}) AS bad FROM stamp WHERE at <> '' GROUP BY page_id),
rec0 AS (SELECT h.page_id, f.n, o.* EXCLUDE (page_id), CASE WHEN st.n = 1 AND NOT st.bad THEN st.at END AS page_created_at,
  CASE WHEN st.n IS NULL THEN 'missing_history_creation' WHEN st.n > 1 OR st.bad THEN 'ambiguous_history_creation' ELSE 'reconstructed_history' END AS creation_status,
  CASE WHEN f.n IS NULL THEN 'history_missing_initial_revision' WHEN f.n > 1 THEN 'history_ambiguous_initial_revisions'
    WHEN (o.created <> '' AND o.created <> o.at) OR (o.first <> '' AND o.first <> o.at) THEN 'history_inconsistent_creation_dates'
    WHEN coalesce(pe.imported, false) OR o.before OR coalesce(pe.creates, 0) > 1 THEN 'history_imported_or_ambiguous'
    WHEN pe.creates > 0 AND pe.first_create IS DISTINCT FROM o.at THEN 'history_create_event_mismatch'
    WHEN o.hidden OR o.user_id IS NULL THEN 'history_hidden_or_unregistered_creator' ELSE 'history_initial_revision_observed' END AS creator_attribution
  FROM history_page h LEFT JOIN first_one f USING (page_id) LEFT JOIN one o ON o.page_id = h.page_id LEFT JOIN pe ON pe.page_id = h.page_id LEFT JOIN st ON st.page_id = h.page_id),
rec AS (SELECT *, CASE WHEN creator_attribution = 'history_initial_revision_observed' THEN user_id END AS creator FROM rec0),
bad_user AS (SELECT DISTINCT user_id FROM user_edit WHERE at = 'bad'),
active AS (SELECT user_id, substr(at, 1, 7) AS m FROM user_edit WHERE at <> 'bad' GROUP BY ALL HAVING count(*) >= 5),
act AS (SELECT r.page_id, count(e.at) FILTER (e.at < r.page_created_at AND e.ns = 0) AS prior_main, count(e.at) FILTER (e.at < r.page_created_at AND e.ns <> 0) AS prior_other
  FROM rec r LEFT JOIN user_edit e ON e.user_id = r.creator AND e.at <> 'bad' WHERE r.creator IS NOT NULL AND r.page_created_at IS NOT NULL AND r.creator NOT IN (SELECT user_id FROM bad_user) GROUP BY r.page_id),
art AS (SELECT r.page_id, (SELECT count(*) FROM rec o WHERE o.creator = r.creator AND o.page_created_at < r.page_created_at) AS prior_articles,
  CASE WHEN r.page_created_at LIKE '2024-02%' AND EXISTS (SELECT 1 FROM active a WHERE a.user_id = r.creator AND a.m = '2024-01') THEN 1 ELSE 0 END AS months FROM rec r JOIN act USING (page_id)),
bot AS (SELECT user_id, CASE WHEN bool_or(expiry IS NULL OR expiry > '20240601000000' AND expiry <> 'invalid') THEN true WHEN NOT bool_or(expiry = 'invalid') THEN false END AS bot FROM user_group WHERE name = 'bot' GROUP BY user_id),
supplement AS (SELECT r.*, a.prior_main, a.prior_other, t.prior_articles, t.months, CASE WHEN r.creator IS NULL THEN 'unavailable' WHEN r.page_created_at IS NOT NULL AND a.page_id IS NULL THEN 'invalid_history_timestamp' ELSE 'observed_surviving_history' END AS creator_history_status,
  CASE WHEN r.creator IS NOT NULL THEN CASE WHEN b.user_id IS NULL THEN false ELSE b.bot END END AS is_bot_now,
  CASE WHEN r.creator IS NOT NULL AND {_OK.format('registration')} AND CAST(r.page_created_at AS TIMESTAMP) >= try_cast(r.registration AS TIMESTAMP) THEN round((epoch_us(CAST(r.page_created_at AS TIMESTAMP)) - epoch_us(try_cast(r.registration AS TIMESTAMP))) / 1e6 / 86400.0, 6) END AS tenure_days
  FROM rec r LEFT JOIN act a USING (page_id) LEFT JOIN art t USING (page_id) LEFT JOIN bot b ON b.user_id = r.creator)"""


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


def records(s, d):
    return supplement.records(*(spark_view(s, d, n) for n in ("revision", "page_event", "stamp", "history_page")), DATABASE)


def whole(s, d):
    return supplement.supplement(*(spark_view(s, d, n) for n in TABLES), F.lit(SNAPSHOT).cast("timestamp"), DATABASE)


@query("J_H2_initial_revisions", RECORDS + " SELECT page_id, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'ambiguous' ELSE 'one' END AS initial_status, revision_id FROM rec")
def _(s, d):
    rows = supplement.initial_revisions(spark_view(s, d, "revision"), spark_view(s, d, "history_page"))
    return rows.select("page_id", "initial_status", F.col("initial.revision_id").alias("revision_id"))


@query("J_H4_creator_keys", RECORDS + f" SELECT page_id, creator_attribution, CASE WHEN creator IS NOT NULL THEN '{DATABASE}:history-user:' || creator END AS creator_key, CASE WHEN creator IS NOT NULL AND groups <> '' THEN replace(groups, ',', '+') END AS groups, CASE WHEN creator IS NOT NULL AND groups <> '' THEN 'observed' ELSE 'unknown' END AS groups_status, CASE WHEN creator IS NOT NULL AND tags <> '' THEN replace(tags, ',', '+') END AS tags FROM rec")
def _(s, d):
    return records(s, d).select("page_id", "creator_attribution", "creator_key", F.array_join("creator_groups_at_creation", "+").alias("groups"), F.col("creator_groups_status").alias("groups_status"), F.array_join("creation_tags_history", "+").alias("tags"))


@query("J_H6_activity", RECORDS + " SELECT r.page_id, a.prior_main, a.prior_other, t.prior_articles, CAST(t.months AS BIGINT) AS months FROM rec r LEFT JOIN act a USING (page_id) LEFT JOIN art t USING (page_id) WHERE r.creator IS NOT NULL AND r.page_created_at IS NOT NULL")
def _(s, d):
    return supplement.activity(records(s, d), spark_view(s, d, "user_edit")).select("page_id", *supplement.MEASURES)


@query("Q2_history", RECORDS + """ SELECT page_id, revision_id AS first_revision_id, at AS article_created_at, creator_attribution, creator AS creator_user_id, page_created_at, creation_status, prior_main, prior_other, prior_articles, CAST(months AS BIGINT) AS months,
 CASE months WHEN 0 THEN 'none' WHEN 1 THEN 'one' END AS bucket, tenure_days, is_bot_now, creator_history_status FROM supplement""")
def _(s, d):
    rows = whole(s, d).withColumn("tenure_days", F.round("tenure_days", 6))
    return rows.select("page_id", "first_revision_id", _text("article_created_at"), "creator_attribution", "creator_user_id", _text("page_created_at"), "creation_status", *supplement.MEASURES, "bucket", "tenure_days", "is_bot_now", "creator_history_status")


_SEEN = """, seen AS (SELECT h.page_id, s.page_id IS NOT NULL AS has, s.* EXCLUDE (page_id) FROM (SELECT page_id FROM history_page UNION ALL SELECT DISTINCT page_id + 2000000 FROM history_page) h LEFT JOIN supplement s ON s.page_id = h.page_id),
told AS (SELECT *, CASE WHEN NOT has THEN 'missing_page' WHEN at IS NULL THEN 'history_initial_revision_unknown' WHEN creator_history_status <> 'observed_surviving_history' THEN 'unattributed_history' ELSE 'matched_reconstructed_history' END AS status FROM seen)"""


@query("J_H8_observed_history", RECORDS + _SEEN + """ SELECT page_id, CASE WHEN has THEN page_created_at ELSE '2001-01-15 00:00:00' END AS created_at, CASE WHEN has THEN creation_status END AS creation_date_status, CASE WHEN at IS NOT NULL THEN creator_attribution END AS history_creator_status,
 CASE WHEN status LIKE 'matched%' THEN prior_main END AS prior_main, status AS history_data_status, CASE WHEN status LIKE 'matched%' THEN CASE WHEN tenure_days IS NULL THEN 'missing_or_inconsistent_registration' ELSE 'local_registration_to_reconstructed_creation' END END AS creator_tenure_status FROM told""")
def _(s, d):
    pages = spark_view(s, d, "history_page")
    rows = pages.union(pages.select(F.col("page_id") + 2_000_000).distinct()).withColumn("created_at", F.lit("2001-01-15 00:00:00").cast("timestamp"))
    return supplement.observed_history(rows, whole(s, d)).select("page_id", _text("created_at"), "creation_date_status", "history_creator_status", "prior_main", "history_data_status", "creator_tenure_status")


@query("D6_census_rows", RECORDS + " SELECT r.page_id, r.revision_id FROM revision r WHERE r.page_id IN (SELECT page_id * 2 FROM history_page)")
def _(s, d):
    pages = spark_view(s, d, "history_page").select((F.col("page_id") * 2).alias("page_id"))
    return supplement.census_rows(spark_view(s, d, "revision"), pages).select("page_id", "revision_id")


@query("D7_attributed_edits", RECORDS + " SELECT user_id, count(*) AS n FROM user_edit WHERE user_id IN (SELECT creator FROM rec WHERE creator % 2 = 0) GROUP BY user_id")
def _(s, d):
    known = records(s, d).withColumn("creator_user_id", F.when(F.col("creator_user_id") % 2 == 0, F.col("creator_user_id")))
    return supplement.attributed_edits(spark_view(s, d, "user_edit"), known).groupBy("user_id").agg(F.count("*").alias("n"))


@query("K_history_time_key", """SELECT o_custkey AS id, min_by(at, k) AS first, max_by(at, k) AS last FROM (SELECT o_custkey, at, substr(at, 1, 19) || rpad(substr(at, 21), 9, '0') AS k FROM
 (SELECT o_custkey, '2024-01-0' || (1 + o_orderkey % 3) || ' 10:00:' || lpad(CAST(o_orderkey % 61 AS VARCHAR), 2, '0') || '.' || lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0') AS at FROM orders)) GROUP BY o_custkey""")
def _(s, d):
    k = F.col("o_orderkey")
    padded = lambda c, n: F.lpad(c.cast("string"), n, "0")
    at = F.concat(F.lit("2024-01-0"), (1 + k % 3).cast("string"), F.lit(" 10:00:"), padded(k % 61, 2), F.lit("."), padded(k * 7919 % 1_000_000_000, 9))
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("id"), at.alias("at"))
    return rows.groupBy("id").agg(F.min_by("at", supplement.time_key(F.col("at"))).alias("first"), F.max_by("at", supplement.time_key(F.col("at"))).alias("last"))


@query("C16_creator_columns", duckdb_with("census") + " SELECT page_id, 'unknown' AS origin, 'not_collected' AS creator_data_status, 'unavailable_no_historical_link_graph' AS creator_orphans_at_30_days_status, 22 AS n_null FROM census")
def _(s, d):
    rows = supplement.initialised(spark_view(s, d, "census").select("page_id"))
    empty = sum((F.col(c).isNull().cast("int") for c in supplement.CREATOR_FIELDS), F.lit(0))
    return rows.select("page_id", "origin", "creator_data_status", "creator_orphans_at_30_days_status", empty.alias("n_null"))
