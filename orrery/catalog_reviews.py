"""Queries of reviews and refreshed exports, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _PAGES, _SHORT, census, published, query, shortlist
from .operators import refresh, reviews
from .plans.views import duckdb_with
from .session import hold

_FAR = 1_000_000_000

_REVIEWS = _SHORT + f""", held AS (SELECT language, target_id + CASE WHEN link_id % 7 = 0 THEN {_FAR} ELSE 0 END AS target_id, link_id AS source_id, 'not_fixed' AS status, link_id % 2 AS version FROM short),
sent AS (SELECT language, target_id, link_id AS source_id, CASE link_id % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'not_fixed' WHEN 2 THEN 'bad_link' ELSE 'done' END AS status, link_id % 2 AS version, link_id AS position FROM short
  UNION ALL SELECT language, target_id + CASE WHEN link_id % 5 = 0 THEN {_FAR} ELSE 0 END, link_id, 'fixed', link_id % 3, link_id + {_FAR} FROM short),
seen AS (SELECT s.*, CASE WHEN s.status = 'done' OR least(s.source_id, s.target_id) < 1 OR s.source_id = s.target_id THEN 'invalid' WHEN e.target_id IS NULL THEN 'missing_edge'
  WHEN s.version <> coalesce(h.version, 0) THEN 'conflict' ELSE 'saved' END AS o
  FROM sent s LEFT JOIN short e ON e.language = s.language AND e.target_id = s.target_id AND e.link_id = s.source_id LEFT JOIN held h ON h.language = s.language AND h.target_id = s.target_id AND h.source_id = s.source_id),
judged AS (SELECT * EXCLUDE (o), CASE WHEN o = 'saved' AND row_number() OVER (PARTITION BY language, target_id, source_id, o ORDER BY position) > 1 THEN 'conflict' ELSE o END AS outcome FROM seen),
after AS (SELECT language, target_id, source_id, coalesce(j.status, h.status) AS status, coalesce(j.version + 1, h.version) AS version FROM held h FULL JOIN (SELECT * FROM judged WHERE outcome = 'saved') j USING (language, target_id, source_id))"""


def _reviews(s, d):
    """Published edges, reviews so far, and submissions, two for each edge; some of them for edges that aren't there."""
    short = hold(shortlist(s, d).select("language", "target_id", F.col("link_id").alias("source_id")))
    k, far = F.col("source_id"), lambda n: F.when(F.col("source_id") % n == 0, F.col("target_id") + _FAR).otherwise(F.col("target_id"))
    said = F.when(k % 4 == 0, "fixed").when(k % 4 == 1, "not_fixed").when(k % 4 == 2, "bad_link").otherwise("done")
    held = short.select("language", far(7).alias("target_id"), "source_id", F.lit("not_fixed").alias("status"), (k % 2).alias("version"))
    first = short.select("language", "target_id", "source_id", said.alias("status"), (k % 2).alias("version"), k.alias("position"))
    second = short.select("language", far(5).alias("target_id"), "source_id", F.lit("fixed").alias("status"), (k % 3).alias("version"), (k + _FAR).alias("position"))
    return reviews.judged(first.union(second), short, held), held


@query("N4_review_outcomes", _REVIEWS + " SELECT language, target_id, source_id, position, outcome FROM judged")
def _(s, d):
    return _reviews(s, d)[0].select("language", "target_id", "source_id", "position", "outcome")


@query("B16_reviews", _REVIEWS + " SELECT * FROM after")
def _(s, d):
    return reviews.applied(*_reviews(s, d))


@query("Q15_review_list", _REVIEWS + " SELECT * FROM after WHERE language IN ('de', 'fr')")
def _(s, d):
    return reviews.listed(reviews.applied(*_reviews(s, d)), ["fr", "de", "fr"])


@query("R1_duplicates", duckdb_with("census") + " SELECT language, item, count(*) AS n FROM census GROUP BY language, item HAVING count(*) > 1")
def _(s, d):
    return refresh.duplicated(census(s, d), ["language", "item"])


@query("J_R1_refresh", _PAGES + " SELECT language, page_id, title, n AS \"count\", CASE WHEN page_id % 6 <> 0 THEN page_id % 100 / 100.0 END AS quality, CASE WHEN page_id % 4 <> 0 THEN 'history-user:' || CAST(page_id % 9 AS STRING) END AS creator_key FROM p")
def _(s, d):
    """Records of history and quality for some pages; the others lose what they had, and graph, topics and candidates stay."""
    k, pages = F.col("page_id"), census(s, d)
    told = pages.select("language", "page_id", F.when(k % 4 != 0, F.concat(F.lit("history-user:"), (k % 9).cast("string"))).alias("creator_key"))
    scored = pages.select("language", "page_id", F.when(k % 6 != 0, (k % 100).cast("double") / 100).alias("quality"))
    return refresh.refreshed(published(s, d), [told, scored], ["language", "page_id"]).select("language", "page_id", "title", "count", "quality", "creator_key")
