"""All queries of the census operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .operators import categories, compare, graph, history, observations, quality, reports, serving, topics
from .plans import publish
from .plans.views import duckdb_with, spark_view
from .sources import dump

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

EDITIONS = ["en", "de", "fr", "es"]
TOPICS = ["Culture.Biography", "Geography.Regions", "STEM.Biology", "History and Society.History"]
MACRO = ["Culture", "Geography", "History and Society", "STEM"]
REFERENCE_US = 1_735_689_600_000_000  # the time of the census in the derived tables: 2025-01-01


def query(name: str, oracle: str | None = None):
    def add(f):
        QUERIES[name] = f
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add


# --- shared parts: Spark frames, and the clauses that mean the same in SQL

def census(s, d):
    return spark_view(s, d, "census")


def occurrences(s, d):
    """The derived titles keep six digits of a key, so from a million parts on pages share them; a link leads to each of these, as in the SQL."""
    return graph.resolved_links(spark_view(s, d, "raw_link"), census(s, d), graph.resolve_redirects(spark_view(s, d, "redirect")), shared_titles=True)


def edges(s, d):
    return graph.edges(occurrences(s, d))


def degree(s, d, edge=None):
    return graph.degrees(census(s, d), edges(s, d) if edge is None else edge)


def observed(s, d, edge=None):
    """The pages with what the reports need; every column's values follow from the page's id."""
    k = F.col("page_id")
    rows = census(s, d).join(degree(s, d, edge), ["language", "page_id"])
    label = F.element_at(F.array(*map(F.lit, TOPICS)), (F.floor(k / 4) % 4 + 1).cast("int"))
    return rows.select(
        "language", "page_id", "title", "item", "length_bytes", "in_degree", "out_degree", (F.col("in_degree") == 0).alias("orphan"),
        F.when(k % 9 != 0, F.concat(F.lit("u"), (k % 150).cast("string"))).alias("creator_key"),
        F.when(k % 6 == 0, None).when(k % 6 == 1, F.array().cast("array<string>")).when(k % 6 == 2, F.array_distinct(F.array(label, F.lit(TOPICS[0])))).otherwise(F.array(label)).alias("topic_labels"),
        F.when(k % 10 != 0, (k % 977).cast("double")).alias("age"), F.when(k % 8 != 0, (k % 101).cast("double") / 100).alias("quality"),
    )


GRAPH = duckdb_with("census", "raw_link", "redirect") + """,
resolved AS (SELECT r.language, r.title, CASE WHEN r3.title IS NOT NULL THEN NULL ELSE coalesce(r2.target, r.target) END AS target FROM redirect r
  LEFT JOIN redirect r2 ON r2.language = r.language AND r2.title = r.target LEFT JOIN redirect r3 ON r3.language = r.language AND r3.title = coalesce(r2.target, r.target)),
occ AS (SELECT k.language, k.source_id, c.page_id AS target_id FROM raw_link k LEFT JOIN resolved r ON r.language = k.language AND r.title = k.target_title
  LEFT JOIN census c ON c.language = k.language AND c.title = CASE WHEN r.title IS NOT NULL THEN r.target ELSE k.target_title END),
edge AS (SELECT DISTINCT * FROM occ WHERE target_id IS NOT NULL AND source_id <> target_id),
degree AS (SELECT c.language, c.page_id, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) AS out_degree FROM census c
  LEFT JOIN (SELECT language, target_id, count(*) n FROM edge GROUP BY ALL) i ON i.language = c.language AND i.target_id = c.page_id
  LEFT JOIN (SELECT language, source_id, count(*) n FROM edge GROUP BY ALL) o ON o.language = c.language AND o.source_id = c.page_id),
item_count AS (SELECT language, item, count(*) AS n, CASE WHEN count(*) = 1 THEN min(page_id) END AS page_id FROM census WHERE regexp_full_match(item, 'Q[1-9][0-9]*') GROUP BY language, item),
uniq AS (SELECT language, item, page_id FROM item_count WHERE n = 1),
eligible AS (SELECT e.language, e.source_id, e.target_id, a.item AS source_item, b.item AS target_item FROM edge e
  JOIN uniq a ON a.language = e.language AND a.page_id = e.source_id JOIN uniq b ON b.language = e.language AND b.page_id = e.target_id)"""
OBSERVED = GRAPH + f""",
observed AS (SELECT c.*, d.in_degree, d.out_degree, d.in_degree = 0 AS orphan, CASE WHEN c.page_id % 9 <> 0 THEN 'u' || (c.page_id % 150) END AS creator_key,
  CASE WHEN c.page_id % 6 = 0 THEN NULL WHEN c.page_id % 6 = 1 THEN [] WHEN c.page_id % 6 = 2 THEN list_distinct([{TOPICS}[c.page_id // 4 % 4 + 1], '{TOPICS[0]}']) ELSE [{TOPICS}[c.page_id // 4 % 4 + 1]] END AS topic_labels,
  CASE WHEN c.page_id % 10 <> 0 THEN CAST(c.page_id % 977 AS DOUBLE) END AS age, CASE WHEN c.page_id % 8 <> 0 THEN CAST(c.page_id % 101 AS DOUBLE) / 100 END AS quality
  FROM census c JOIN degree d USING (language, page_id))"""


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


# --- sources, filters

@query("C2_valid_items", duckdb_with("census") + " SELECT language, page_id, title, CASE WHEN regexp_full_match(item, 'Q[1-9][0-9]*') THEN item END AS item FROM census")
def _(s, d):
    return census(s, d).select("language", "page_id", "title", F.when(graph.valid_item(F.col("item")), F.col("item")).alias("item"))


@query("A13_anchors", r"""SELECT page_id, CAST(len(h) AS BIGINT) AS n, coalesce(h[1], '') AS first FROM (SELECT page_id, list_transform(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*("[^"]*"|''[^'']*''|[^\s"''>]+)', 1), lambda x: CASE WHEN x[1] IN ('"', '') THEN x[2:-2] ELSE x END) AS h FROM pages)""")
def _(s, d):
    rows = s.read.parquet(f"{d}/pages.parquet").select("page_id", dump.anchors(F.col("html")).alias("h"))
    return rows.select("page_id", F.size("h").cast("long").alias("n"), F.coalesce(F.get("h", F.lit(0)), F.lit("")).alias("first"))


@query("A15_latest_entries", "SELECT o_orderpriority AS language, CAST(o_orderkey AS VARCHAR) AS file FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey DESC) k FROM orders) WHERE k = 1")
def _(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("language"), F.col("o_orderdate").alias("date"), F.col("o_orderkey").alias("published_at"), F.col("o_orderkey").cast("string").alias("file"))
    return observations.latest_entries(o).select("language", "file")


@query("B13_fingerprint", """WITH h AS (SELECT sha256('[' || CASE WHEN p_partkey % 5 = 0 THEN 'null' ELSE '"' || p_brand || '"' END || ',' || CASE WHEN p_partkey % 3 = 0 THEN 'null' ELSE '"' || p_partkey || '"' END || ']') AS h FROM part)
SELECT count(*) AS n, """ + " || '-' || ".join(f"CAST(sum(CAST('0x' || substr(h, {1 + 12 * k}, 12) AS BIGINT)) AS VARCHAR)" for k in range(4)) + " AS total FROM h")
def _(s, d):
    k = F.col("p_partkey")
    return publish.fingerprint(s.read.parquet(f"{d}/part.parquet").select(F.when(k % 5 != 0, F.col("p_brand")).alias("a"), F.when(k % 3 != 0, k).alias("b")))


@query("C5_category_candidates", duckdb_with("page_category") + " SELECT DISTINCT language, page_id, category FROM page_category WHERE NOT regexp_matches(category, '(?i)(steel|^size 3)') AND category NOT IN ('Brand#11', 'size 4')")
def _(s, d):
    return categories.candidates(spark_view(s, d, "page_category"), ("steel", "^size 3"), ("Brand#11", "size 4"))


@query("C11_folded_labels", r"""SELECT p_partkey, trim(regexp_replace(replace(lower(p_name || '_X'), '_', ' '), '\s+', ' ', 'g')) AS label FROM part""")
def _(s, d):
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", serving.folded(F.concat("p_name", F.lit("_X"))).alias("label"))


# --- graph

@query("I1_redirects", GRAPH + " SELECT language, title, target FROM resolved")
def _(s, d):
    return graph.resolve_redirects(spark_view(s, d, "redirect"))


@query("D5_resolved_links", GRAPH + " SELECT language, source_id, target_id FROM occ")
def _(s, d):
    return occurrences(s, d)


@query("E1_degrees", GRAPH + " SELECT language, page_id, in_degree, out_degree FROM degree")
def _(s, d):
    return degree(s, d)


@query("E1_unresolved", GRAPH + " SELECT language, count(*) FILTER (target_id IS NULL) AS unresolved, count(*) AS links FROM occ GROUP BY language")
def _(s, d):
    return graph.unresolved(occurrences(s, d))


@query("E2_items", GRAPH + " SELECT language, item, n, page_id FROM item_count")
def _(s, d):
    return graph.item_counts(census(s, d))


@query("I3_reverse_adjacency", GRAPH + " SELECT language, target_id AS page_id, string_agg(CAST(source_id AS VARCHAR), ' ' ORDER BY source_id) AS sources FROM edge GROUP BY language, target_id")
def _(s, d):
    return graph.reverse_adjacency(edges(s, d)).withColumn("sources", F.array_join(F.transform("sources", lambda x: x.cast("string")), " "))


@query("I4_matchable_edges", GRAPH + " SELECT * FROM eligible")
def _(s, d):
    return graph.matchable_edges(edges(s, d), graph.unique_items(census(s, d))).select("language", "source_id", "target_id", "source_item", "target_item")


_KNOWN = "CAST(substr(item, 2) AS BIGINT) % 3 <> 0"


@query("I7_topic_inputs", GRAPH + f""", near AS (SELECT e.language, e.source_id, u.item FROM edge e JOIN uniq u ON u.language = e.language AND u.page_id = e.target_id),
per AS (SELECT language, source_id, string_agg(DISTINCT item, ' ' ORDER BY item) FILTER ({_KNOWN}) AS input, count(DISTINCT item) FILTER ({_KNOWN}) AS n FROM near GROUP BY ALL)
SELECT c.language, c.page_id, coalesce(p.input, '') AS input, coalesce(p.n, 0) AS n, p.language IS NOT NULL AS mapped FROM census c LEFT JOIN per p ON p.language = c.language AND p.source_id = c.page_id""")
def topic_inputs(s, d):
    c = census(s, d)
    unique = graph.unique_items(c)
    vocabulary = unique.select("item").distinct().filter(F.substring("item", 2, 20).cast("long") % 3 != 0)
    return graph.topic_inputs(c, edges(s, d), unique, vocabulary)


@query("J_T3_topics", GRAPH + f""", near AS (SELECT e.language, e.source_id, u.item FROM edge e JOIN uniq u ON u.language = e.language AND u.page_id = e.target_id),
known AS (SELECT DISTINCT language, source_id, item, CAST(substr(item, 2) AS BIGINT) % 4 AS k FROM near WHERE {_KNOWN}),
share AS (SELECT language, source_id, k, count(*) * 2.0 / sum(count(*)) OVER (PARTITION BY language, source_id) AS p FROM known GROUP BY language, source_id, k),
label AS (SELECT language, source_id, string_agg({TOPICS}[k + 1], ',' ORDER BY {TOPICS}[k + 1]) AS labels FROM share WHERE p > 0.5 GROUP BY ALL),
n AS (SELECT language, source_id, count(DISTINCT item) FILTER ({_KNOWN}) AS n FROM near GROUP BY ALL)
SELECT c.language, c.page_id, CASE WHEN n.n > 0 THEN 'predicted' WHEN n.n = 0 THEN 'no_model_vocabulary' ELSE 'no_mapped_outlinks' END AS topic_status, CASE WHEN n.n > 0 THEN coalesce(l.labels, '') END AS labels
FROM census c LEFT JOIN n ON n.language = c.language AND n.source_id = c.page_id LEFT JOIN label l ON l.language = c.language AND l.source_id = c.page_id""")
def _(s, d):
    model = topics.LinearStub([f"__label__{t.replace(' ', '_')}" for t in TOPICS])
    return topics.supplement(topic_inputs(s, d), model).select("language", "page_id", "topic_status", F.array_join("topic_labels", ",").alias("labels"))


# --- categories

CAT = duckdb_with("census", "page_category", "category_parent") + """,
reach AS (SELECT language, category, parent AS ancestor FROM category_parent UNION SELECT r.language, r.category, p.parent FROM reach r JOIN category_parent p ON p.language = r.language AND p.category = r.ancestor),
cand AS (SELECT DISTINCT language, page_id, category FROM page_category),
broader AS (SELECT DISTINCT c.language, c.page_id, c.category FROM cand c JOIN cand d ON d.language = c.language AND d.page_id = c.page_id AND d.category <> c.category
  JOIN reach u ON u.language = c.language AND u.category = d.category AND u.ancestor = c.category
  WHERE NOT EXISTS (SELECT 1 FROM reach b WHERE b.language = c.language AND b.category = c.category AND b.ancestor = d.category)),
sup AS (SELECT language, category, count(DISTINCT page_id) AS support FROM page_category GROUP BY ALL),
nn AS (SELECT language, count(*) AS n FROM census GROUP BY language),
scored AS (SELECT c.language, c.page_id, c.category, s.support, round_even(ln(CAST(n.n + 1 AS DOUBLE) / (s.support + 1)) * least(s.support / 5.0, 1.0), 6) AS score, CASE c.category WHEN 'size 5' THEN 2.0 ELSE 0.0 END AS priority
  FROM cand c ANTI JOIN broader b ON b.language = c.language AND b.page_id = c.page_id AND b.category = c.category JOIN sup s ON s.language = c.language AND s.category = c.category JOIN nn n ON n.language = c.language),
ranked AS (SELECT *, row_number() OVER (PARTITION BY language, page_id ORDER BY priority DESC, score DESC, category) AS rank FROM scored)"""


@query("E3_support", CAT + " SELECT * FROM sup")
def _(s, d):
    return categories.support(spark_view(s, d, "page_category"))


@query("C4_visible_categories", CAT + " SELECT p.* FROM page_category p ANTI JOIN (SELECT language, category FROM category_parent WHERE category LIKE 'size %') h ON h.language = p.language AND h.category = p.category")
def _(s, d):
    return categories.visible(spark_view(s, d, "page_category"), spark_view(s, d, "category_parent").filter("category LIKE 'size %'"))


@query("E23_label_text", CAT + " SELECT language, page_id, string_agg(DISTINCT category, ' · ' ORDER BY category) AS labels FROM page_category GROUP BY language, page_id")
def _(s, d):
    return categories.label_text(spark_view(s, d, "page_category"))


@query("I5_ancestors", CAT + " SELECT DISTINCT language, category, ancestor FROM reach")
def closure(s, d):
    return categories.ancestors(spark_view(s, d, "category_parent"))


@query("I6_narrowest", CAT + " SELECT language, page_id, category FROM scored")
def _(s, d):
    return categories.narrowest(categories.candidates(spark_view(s, d, "page_category")), closure(s, d))


@query("J_C1_ranked", CAT + " SELECT language, page_id, category, support, CAST(score AS DOUBLE) AS score, CAST(priority AS DOUBLE) AS priority FROM ranked")
def _(s, d):
    return ranked(s, d).select("language", "page_id", "category", "support", "score", "priority")


def ranked(s, d):
    return categories.ranked(spark_view(s, d, "page_category"), census(s, d), closure(s, d), priority={"size 5": 2.0})


@query("G1_choices", CAT + " SELECT c.language, c.page_id, r.category AS choice, false AS manual FROM census c LEFT JOIN ranked r ON r.language = c.language AND r.page_id = c.page_id AND r.rank = 1")
def _(s, d):
    return categories.choices(ranked(s, d), census(s, d))


# --- history

HIST = duckdb_with("edit", "creation")


@query("F3_prior_edits", HIST + """ SELECT c.page_id, c.user_id, c.us, (SELECT count(*) FROM edit e WHERE e.user_id = c.user_id AND e.us < c.us AND e.ns = 0) AS prior_main,
 (SELECT count(*) FROM edit e WHERE e.user_id = c.user_id AND e.us < c.us AND e.ns <> 0) AS prior_other, (SELECT count(*) FROM creation o WHERE o.user_id = c.user_id AND o.us < c.us) AS prior_articles FROM creation c""")
def _(s, d):
    return history.prior_edits(spark_view(s, d, "creation"), spark_view(s, d, "edit"))


_STREAK = """, active AS (SELECT user_id, us // {unit} AS p FROM edit GROUP BY ALL HAVING count(*) >= {least}),
isle AS (SELECT user_id, p, p - row_number() OVER (PARTITION BY user_id ORDER BY p) AS g FROM active),
run AS (SELECT user_id, p, row_number() OVER (PARTITION BY user_id, g ORDER BY p) AS streak FROM isle)
SELECT c.page_id, coalesce(r.streak, 0) AS streak, CASE coalesce(r.streak, 0) WHEN 0 THEN 'none' WHEN 1 THEN 'one' WHEN 2 THEN 'two' ELSE CASE WHEN r.streak <= 6 THEN 'three_to_six' WHEN r.streak <= 12 THEN 'seven_to_twelve' WHEN r.streak <= 24 THEN 'thirteen_to_twenty_four' ELSE 'over_twenty_four' END END AS bucket
FROM creation c LEFT JOIN run r ON r.user_id = c.user_id AND r.p = c.us // {unit} - 1"""


@query("F5_streaks", HIST + _STREAK.format(unit=86_400_000_000, least=2))
def _(s, d):
    return history.streaks(spark_view(s, d, "creation"), spark_view(s, d, "edit"), history.day_index, 2)


@query("G11_recent_edits", HIST + " SELECT * FROM edit ORDER BY us DESC, event_id LIMIT 100")
def _(s, d):
    return history.recent(spark_view(s, d, "edit"))


@query("E6_periods", HIST + ", active AS (SELECT user_id, us // 21600000000 AS period, count(*) AS n FROM edit GROUP BY ALL HAVING count(*) >= 2), isle AS (SELECT *, period - row_number() OVER (PARTITION BY user_id ORDER BY period) AS g FROM active) SELECT user_id, period, row_number() OVER (PARTITION BY user_id, g ORDER BY period) AS streak FROM isle")
def _(s, d):
    return history.periods(spark_view(s, d, "edit"), F.floor(F.col("us") / 21_600_000_000), 2)


@query("E4_page_events", "SELECT user_id AS page_id, count(*) FILTER (event_type = 'signup') AS creates, min(CAST(event_id AS VARCHAR)) FILTER (event_type = 'signup') AS first_create, bool_or(event_type IN ('error')) AS imported FROM events GROUP BY user_id")
def _(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    kind = F.when(F.col("event_type") == "signup", "create").when(F.col("event_type") == "error", "import").otherwise(F.col("event_type"))
    return history.page_events(e.select(F.col("user_id").alias("page_id"), kind.alias("event_type"), F.col("event_id").cast("string").alias("at")))


def _stamp(c: Column) -> Column:
    return F.concat(F.lit("2024-01-"), F.lpad((c % 31 + 1).cast("string"), 2, "0"), F.lit(" 10:00:"), F.lpad((c % 61).cast("string"), 2, "0"))


_STAMP = "'2024-01-' || lpad(CAST({0} % 31 + 1 AS VARCHAR), 2, '0') || ' 10:00:' || lpad(CAST({0} % 61 AS VARCHAR), 2, '0')"


@query("J_H1_creation_dates", f"""WITH st AS (SELECT o_custkey AS page_id, CASE WHEN o_orderkey % 5 = 0 THEN {_STAMP.format('o_orderkey % 91')} END AS stamp FROM orders),
per AS (SELECT page_id, count(DISTINCT CASE WHEN stamp LIKE '%:60' THEN '?' ELSE stamp END) AS n, bool_or(stamp LIKE '%:60') AS bad, min(stamp) AS stamp FROM st WHERE stamp IS NOT NULL GROUP BY page_id)
SELECT c_custkey AS page_id, CASE WHEN n = 1 AND NOT bad THEN stamp END AS created, CASE WHEN n IS NULL THEN 'missing_history_creation' WHEN n > 1 OR bad THEN 'ambiguous_history_creation' ELSE 'reconstructed_history' END AS creation_status FROM customer LEFT JOIN per ON page_id = c_custkey""")
def _(s, d):
    o = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("page_id"), F.when(F.col("o_orderkey") % 5 == 0, _stamp(F.col("o_orderkey") % 91)).otherwise("").alias("at"))
    pages = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("page_id"))
    return history.creation_dates(o, pages).withColumn("created", F.date_format("created", "yyyy-MM-dd HH:mm:ss"))


@query("J_H3_attribution", """SELECT o_orderkey AS page_id, CASE WHEN k % 7 = 0 THEN 'history_inconsistent_creation_dates' WHEN k % 5 = 0 OR k % 11 = 0 THEN 'history_imported_or_ambiguous'
 WHEN k % 3 = 0 THEN 'history_create_event_mismatch' WHEN k % 2 = 0 OR k % 13 = 0 THEN 'history_hidden_or_unregistered_creator' ELSE 'history_initial_revision_observed' END AS attribution FROM (SELECT *, o_orderkey AS k FROM orders)""")
def _(s, d):
    k, at = F.col("o_orderkey"), F.lit("2024-01-01 00:00:00")
    no = F.lit(None).cast("string")
    a = history.attribution(at, F.when(k % 7 == 0, "2023-01-01 00:00:00"), no, k % 5 == 0, k % 11 == 0, F.when(k % 3 == 0, 1).otherwise(0), no, k % 2 == 0, F.when(k % 13 != 0, k))
    return s.read.parquet(f"{d}/orders.parquet").select(k.alias("page_id"), a.alias("attribution"))


@query("J_H5_bots", """SELECT o_custkey AS user_id, CASE WHEN bool_or(o_orderkey % 7 = 0 OR o_orderkey % 7 = 1) THEN true WHEN NOT bool_or(o_orderkey % 7 = 2) THEN false END AS bot FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey""")
def _(s, d):
    k = F.col("o_orderkey") % 7
    expiry = F.when(k == 0, None).when(k == 1, "20300101000000").when(k == 2, "invalid").otherwise("20200101000000")
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderkey") % 3 == 0, "bot").otherwise("sysop").alias("name"), expiry.alias("expiry"))
    return history.bot_flags(rows, F.lit("2025-01-01 00:00:00").cast("timestamp"))


@query("J_H7_tenure", HIST + " SELECT c.page_id, round((c.us - e.us) / 1e6 / 86400.0, 6) AS days FROM creation c JOIN (SELECT user_id, min(us) AS us FROM edit GROUP BY user_id) e USING (user_id) WHERE c.us >= e.us UNION ALL SELECT c.page_id, NULL FROM creation c JOIN (SELECT user_id, min(us) AS us FROM edit GROUP BY user_id) e USING (user_id) WHERE c.us < e.us")
def _(s, d):
    first = spark_view(s, d, "edit").groupBy("user_id").agg(F.min("us").alias("registered"))
    return spark_view(s, d, "creation").join(first, "user_id").select("page_id", F.round(history.tenure_days(F.col("us"), F.col("registered")), 6).alias("days"))


# --- observations

@query("J_A1_ages", HIST + f" SELECT page_id, CASE WHEN us <= {REFERENCE_US} - page_id % 400 * 86400000000 THEN round(({REFERENCE_US} - page_id % 400 * 86400000000 - us) / 86400000000.0, 6) END AS age, CASE WHEN us > {REFERENCE_US} - page_id % 400 * 86400000000 THEN 'after_graph_collection' ELSE 'known' END AS status FROM creation")
def _(s, d):
    at, end = F.col("us"), F.lit(REFERENCE_US) - F.col("page_id") % 400 * history.DAY_US
    return spark_view(s, d, "creation").select("page_id", F.round(observations.age_days(at, end), 6).alias("age"), observations.age_status(at, end).alias("status"))


@query("J_H8_history_status", duckdb_with("census") + " SELECT language, page_id, CASE WHEN page_id % 5 = 0 THEN 'missing_page' WHEN page_id % 7 = 0 THEN 'history_initial_revision_unknown' WHEN page_id % 3 = 0 THEN 'unattributed_history' ELSE 'matched_reconstructed_history' END AS history_data_status FROM census")
def _(s, d):
    c, k = census(s, d), F.col("page_id")
    h = c.filter(k % 5 != 0).select("language", "page_id", F.when(k % 7 != 0, k).alias("first_revision_id"), F.when(k % 3 != 0, k.cast("string")).alias("creator_key"))
    return observations.joined_history(c, h).select("language", "page_id", "history_data_status")


@query("D10_revision_relation", "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN 'unavailable' WHEN o_orderkey % 4 = 1 THEN 'different' ELSE 'same' END AS relation FROM orders")
def _(s, d):
    k = F.col("o_orderkey")
    return s.read.parquet(f"{d}/orders.parquet").select(k, observations.revision_relation(k, F.when(k % 4 == 0, None).when(k % 4 == 1, k + 1).otherwise(k)).alias("relation"))


@query("E21_interval", "SELECT o_custkey AS collection, strftime(min(o_orderdate), '%Y-%m-%dT%H:%M:%S') || 'Z' AS started, strftime(max(o_orderdate), '%Y-%m-%dT%H:%M:%S') || 'Z' AS finished FROM orders GROUP BY o_custkey")
def _(s, d):
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    rows = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("collection"), at.alias("started"), at.alias("finished"), F.col("o_orderkey").alias("position"))
    return observations.collection_interval(rows, ["collection"])


@query("D18_set_difference", "SELECT c_custkey AS id, 'left' AS side FROM customer ANTI JOIN (SELECT o_custkey * 2 AS id FROM orders) o ON o.id = c_custkey UNION ALL SELECT DISTINCT o_custkey * 2, 'right' FROM orders ANTI JOIN customer ON o_custkey * 2 = c_custkey")
def _(s, d):
    return observations.set_difference(s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("id")), s.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") * 2).alias("id")), ["id"])


@query("B14_mixed_metadata", "SELECT n_regionkey AS region, CASE WHEN count(DISTINCT n_nationkey % 5) <= 1 THEN CAST(min(n_nationkey % 5) AS VARCHAR) ELSE 'mixed_per_language' END AS value FROM nation GROUP BY n_regionkey")
def _(s, d):
    return s.read.parquet(f"{d}/nation.parquet").groupBy(F.col("n_regionkey").alias("region")).agg(observations.mixed((F.col("n_nationkey") % 5).cast("string")).alias("value"))


# --- quality

_WIKI = duckdb_with("census", "content") + r""",
f AS (SELECT language, page_id, text, CAST(strlen(text) AS BIGINT) AS bytes, CAST(len(regexp_extract_all(text, '(?i)<ref>[^<]*</ref>')) AS BIGINT) AS refs, CAST(len(list_filter(regexp_extract_all(text, '(={2,})(.*?)(={2,})', 1), lambda x: length(x) <= 3)) AS BIGINT) AS headings,
  CAST(len(regexp_extract_all(text, '\[\[Foo')) AS BIGINT) AS links, CAST(len(regexp_extract_all(text, '\[\[File:')) AS BIGINT) AS media, CAST(len(regexp_extract_all(text, '\[\[Category:')) AS BIGINT) AS categories FROM content),
x AS (SELECT language, page_id, text IS NOT NULL AS has_text, sqrt(CAST(bytes AS DOUBLE)) AS x0, CASE WHEN bytes = 0 THEN 0.0 ELSE refs / sqrt(CAST(bytes AS DOUBLE)) END AS x1, CASE WHEN bytes = 0 THEN 0.0 ELSE headings / sqrt(CAST(bytes AS DOUBLE)) END AS x2,
  CASE WHEN bytes = 0 THEN 0.0 ELSE sqrt(CAST(links AS DOUBLE)) / sqrt(CAST(bytes AS DOUBLE)) END AS x3, CAST(media AS DOUBLE) AS x4, CAST(categories AS DOUBLE) AS x5 FROM f),
m AS (SELECT language, """ + ", ".join(f"greatest(CAST({v} AS DOUBLE), quantile_cont(x{k}, 0.95)) AS m{k}" for k, v in enumerate(quality.MINIMUMS)) + " FROM x WHERE has_text GROUP BY language)"


@query("J_Q1_features", _WIKI + " SELECT page_id, bytes, refs, headings, links, media, categories FROM f")
def _(s, d):
    return quality.features(spark_view(s, d, "content")).select("page_id", "bytes", "refs", "headings", "links", "media", "categories")


@query("E8_normalisers", _WIKI + " SELECT language, " + ", ".join(f"round(m{k}, 6) AS m{k}" for k in range(6)) + " FROM m")
def _(s, d):
    x = quality.transformed(quality.features(spark_view(s, d, "content"))).filter("text IS NOT NULL")
    return rounded(quality.normalisers(x), *(f"m{k}" for k in range(6)))


@query("J_Q4_quality", _WIKI + """ SELECT c.language, c.page_id, CASE WHEN x.page_id IS NULL THEN 'missing_current_page' WHEN NOT has_text THEN 'missing_wikitext' ELSE 'scored' END AS quality_status,
 round(CASE WHEN has_text THEN """ + " + ".join(f"{w} * least(x{k}, m{k}) / m{k}" for k, w in enumerate(quality.WEIGHTS)) + """ END, 6) AS quality_score FROM (SELECT DISTINCT lang AS language, doc_id * 2 AS page_id FROM documents UNION SELECT DISTINCT lang, doc_id * 2 + 1 FROM documents) c LEFT JOIN x ON x.page_id * 2 = c.page_id AND x.language = c.language LEFT JOIN m ON m.language = c.language""")
def _(s, d):
    """Every document is the content of one page, and there is one without content beside it."""
    twice = F.explode(F.array(F.col("doc_id") * 2, F.col("doc_id") * 2 + 1))
    pages = s.read.parquet(f"{d}/documents.parquet").select(F.col("lang").alias("language"), twice.alias("page_id")).distinct()
    return rounded(quality.supplement(spark_view(s, d, "content").withColumn("page_id", F.col("page_id") * 2), pages), "quality_score")


@query("E7_quality_coverage", _WIKI + " SELECT language, count(*) AS pages, count(*) FILTER (text IS NOT NULL) AS scored, count(*) FILTER (text IS NULL) AS missing FROM content GROUP BY language")
def _(s, d):
    t = F.col("text")
    return spark_view(s, d, "content").groupBy("language").agg(F.count("*").alias("pages"), F.count_if(t.isNotNull()).alias("scored"), F.count_if(t.isNull()).alias("missing"))


# --- comparison of editions

COMPARE = GRAPH + """, orphan AS (SELECT u.language, u.page_id, u.item FROM uniq u JOIN degree d ON d.language = u.language AND d.page_id = u.page_id WHERE in_degree = 0),
evidence AS (SELECT DISTINCT o.language, o.page_id AS target_id, l.page_id AS link_id, e.language AS reference, e.source_id AS ref_source, e.target_id AS ref_target FROM orphan o JOIN eligible e ON e.target_item = o.item AND e.language <> o.language
  JOIN uniq l ON l.language = o.language AND l.item = e.source_item WHERE l.page_id <> o.page_id),
candidate AS (SELECT language, target_id, link_id, count(DISTINCT reference) AS "references", count(*) AS n_evidence FROM evidence GROUP BY language, target_id, link_id),
placed AS (SELECT k.*, d.out_degree = 0 AS dead_end, row_number() OVER (PARTITION BY k.language, k.target_id ORDER BY d.out_degree = 0 DESC, c.title, k.link_id) - 1 AS position
  FROM candidate k JOIN degree d ON d.language = k.language AND d.page_id = k.link_id JOIN census c ON c.language = k.language AND c.page_id = k.link_id),
all_orphan AS (SELECT c.language, c.page_id, c.item FROM census c JOIN degree d USING (language, page_id) WHERE d.in_degree = 0),
grid AS (SELECT o.language, o.page_id, w.other, i.n, i.page_id AS page_id_there, g.in_degree AS in_degree_there FROM orphan o CROSS JOIN (VALUES ('en'), ('de'), ('fr'), ('es')) w(other)
  LEFT JOIN item_count i ON i.language = w.other AND i.item = o.item LEFT JOIN degree g ON g.language = w.other AND g.page_id = i.page_id WHERE w.other <> o.language)"""


class _Comparison:
    def __init__(self, s, d, edge=None):
        self.census, edge = census(s, d), edges(s, d) if edge is None else edge
        self.degree, self.items, self.unique = degree(s, d, edge), graph.item_counts(self.census), graph.unique_items(self.census)
        none_in = self.degree.filter("in_degree = 0").select("language", "page_id")
        self.all_orphans = self.census.join(none_in, ["language", "page_id"]).select("language", "page_id", "item")
        self.orphans = self.unique.join(none_in, ["language", "page_id"]).select("language", "page_id", "item")
        self.evidence = compare.evidence(self.orphans, self.unique, graph.matchable_edges(edge, self.unique))
        self.candidates = compare.candidates(self.evidence, self.degree, self.census)
        self.counterparts = compare.counterparts(self.orphans, self.items, self.degree, EDITIONS)


@query("J_X1_evidence", COMPARE + " SELECT * FROM evidence")
def _(s, d):
    return _Comparison(s, d).evidence


@query("G2_candidates", COMPARE + ' SELECT language, target_id, link_id, "references", n_evidence, dead_end, position FROM placed')
def _(s, d):
    return _Comparison(s, d).candidates.select("language", "target_id", "link_id", "references", "n_evidence", "dead_end", F.col("position").cast("long").alias("position"))


@query("J_X2_target_status", COMPARE + """ SELECT o.language, o.page_id, CASE WHEN i.n > 1 THEN 'ambiguous_item' WHEN i.n IS NULL THEN 'missing_item' WHEN a.page_id IS NULL THEN 'counterpart_unavailable' ELSE 'compared' END AS status,
 CASE WHEN i.n = 1 AND a.page_id IS NOT NULL THEN coalesce(k.n, 0) END AS candidates FROM all_orphan o LEFT JOIN item_count i ON i.language = o.language AND i.item = o.item
 LEFT JOIN (SELECT DISTINCT language, page_id FROM grid WHERE page_id_there IS NOT NULL) a ON a.language = o.language AND a.page_id = o.page_id LEFT JOIN (SELECT language, target_id, count(*) n FROM candidate GROUP BY ALL) k ON k.language = o.language AND k.target_id = o.page_id""")
def _(s, d):
    c = _Comparison(s, d)
    return compare.target_status(c.all_orphans, c.items, c.counterparts, c.candidates)


@query("J_X3_counterparts", COMPARE + " SELECT language, page_id, other, CASE WHEN n > 1 THEN 'ambiguous_item' WHEN n IS NULL THEN 'missing_counterpart' WHEN in_degree_there = 0 THEN 'orphan' ELSE 'non_orphan' END AS status, page_id_there, in_degree_there FROM grid")
def _(s, d):
    return _Comparison(s, d).counterparts


@query("E20_counterpart_counts", COMPARE + " SELECT language, count(*) FILTER (n > 1) AS ambiguous, count(*) FILTER (n IS NULL) AS missing, count(*) FILTER (in_degree_there = 0) AS orphans FROM grid GROUP BY language")
def _(s, d):
    c, n = _Comparison(s, d).counterparts, lambda v: F.count_if(F.col("status") == v)
    return c.groupBy("language").agg(n("ambiguous_item").alias("ambiguous"), n("missing_counterpart").alias("missing"), n("orphan").alias("orphans"))


_SHORT = COMPARE + """, mention AS (SELECT *, CASE link_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS local_mention FROM placed),
rk AS (SELECT *, row_number() OVER (PARTITION BY language, target_id ORDER BY (local_mention IS NOT DISTINCT FROM true) DESC, "references" DESC, dead_end DESC, position) AS rank FROM mention),
short AS (SELECT language, target_id, link_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY language, target_id, dead_end ORDER BY rank) AS g FROM rk) WHERE g <= 5)"""


def shortlist(s, d, edge=None):
    c = _Comparison(s, d, edge).candidates
    mention = c.select("language", "target_id", "link_id", F.when(F.col("link_id") % 3 == 0, True).when(F.col("link_id") % 3 == 1, False).alias("local_mention"))
    return compare.shortlist(c, mention)


@query("F1_shortlist", _SHORT + " SELECT * FROM short")
def _(s, d):
    return shortlist(s, d).select("language", "target_id", "link_id", F.col("rank").cast("long").alias("rank"))


# --- reports

@query("E10_overview", OBSERVED + """ SELECT language, count(*) AS total, count(*) FILTER (orphan) AS orphans, round(100.0 * count(*) FILTER (orphan) / count(*), 6) AS percent, count(*) FILTER (out_degree = 0) AS dead_ends,
 count(*) FILTER (orphan AND creator_key IS NOT NULL) AS attributed_orphans, count(*) FILTER (creator_key IS NULL) AS missing_creators, count(DISTINCT creator_key) FILTER (orphan) AS orphan_creators FROM observed GROUP BY language""")
def _(s, d):
    return rounded(reports.overview(observed(s, d)), "percent")


@query("H_S1_overall", OBSERVED + """ SELECT 'all' AS language, count(*) AS total, count(*) FILTER (orphan) AS orphans, round(100.0 * count(*) FILTER (orphan) / count(*), 6) AS percent, count(*) FILTER (out_degree = 0) AS dead_ends,
 count(*) FILTER (orphan AND creator_key IS NOT NULL) AS attributed_orphans, count(*) FILTER (creator_key IS NULL) AS missing_creators, count(DISTINCT language || ':' || creator_key) FILTER (orphan) AS orphan_creators FROM observed""")
def _(s, d):
    return rounded(reports.overall(observed(s, d)), "percent")


@query("E11_category_counts", OBSERVED + ", " + duckdb_with("page_category").removeprefix("WITH RECURSIVE ") + " SELECT category AS label, count(*) AS total, count(*) FILTER (orphan) AS orphans, round(100.0 * count(*) FILTER (orphan) / count(*), 6) AS percent FROM page_category JOIN observed USING (language, page_id) GROUP BY category")
def _(s, d):
    rows = spark_view(s, d, "page_category").join(observed(s, d).select("language", "page_id", "orphan"), ["language", "page_id"])
    return rounded(reports.label_counts(rows, "category"), "percent")


@query("E12_creators", OBSERVED + """ SELECT creator_key AS key, count(*) AS total, count(*) FILTER (orphan) AS orphans, round(100.0 * count(*) FILTER (orphan) / count(*), 6) AS percent, string_agg(DISTINCT language, ',' ORDER BY language) AS languages, min_by(title, page_id) AS first_type FROM observed WHERE creator_key IS NOT NULL GROUP BY creator_key""")
def _(s, d):
    rows = observed(s, d).filter("creator_key IS NOT NULL").select(F.col("creator_key").alias("key"), "orphan", "language", F.col("title").alias("type"), F.col("page_id").alias("position"))
    return rounded(reports.creators(rows), "percent")


@query("E13_bot_groups", OBSERVED + " SELECT g.b AS bot_group, count(o.page_id) AS total, count(*) FILTER (o.orphan) AS orphans FROM (VALUES (0), (1), (2)) g(b) LEFT JOIN observed o ON CASE o.page_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END = g.b GROUP BY g.b")
def _(s, d):
    k = F.col("page_id") % 4
    return reports.bot_groups(observed(s, d).select("orphan", F.when(k == 0, True).when(k == 1, False).alias("bot")))


@query("E14_group_labels", OBSERVED + " SELECT label, count(*) AS total, count(*) FILTER (orphan) AS orphans, round(100.0 * count(*) FILTER (orphan) / count(*), 6) AS percent FROM (SELECT orphan, unnest(CASE WHEN topic_labels IS NULL OR len(topic_labels) = 0 THEN ['__missing__'] ELSE topic_labels END) AS label FROM observed) GROUP BY label")
def _(s, d):
    return rounded(reports.group_labels(observed(s, d).withColumnRenamed("topic_labels", "groups")), "percent")


_FEATURES = [*((f"'topic'", t, f"list_contains(topic_labels, '{t}')") for t in TOPICS), *(("'macrotheme'", p, f"len(list_filter(topic_labels, lambda x: starts_with(x, '{p}.'))) > 0") for p in MACRO)] + [
    ("'feature'", *x) for x in (("new", "age < am"), ("old", "age >= am"), ("quality_high", "q >= qm"), ("quality_low", "q < qm"), ("short", "length_bytes < lm"), ("long", "length_bytes >= lm"))
]


@query("E16_profiles", OBSERVED + """, o2 AS (SELECT *, CASE WHEN quality <= 0.998001 THEN quality END AS q FROM observed), med AS (SELECT language, median(age) AS am, median(q) AS qm, median(length_bytes) AS lm FROM o2 GROUP BY language), j AS (SELECT * FROM o2 JOIN med USING (language)),
g AS (SELECT orphan FROM (VALUES (true), (false)) v(orphan)) """ + " UNION ALL ".join(f"SELECT {kind} AS kind, '{label}' AS label, orphan, count(*) FILTER ({e}) AS count, count(*) FILTER (({e}) IS NOT NULL) AS known, count(*) AS total, CASE WHEN count(*) FILTER (({e}) IS NOT NULL) > 0 THEN round(100.0 * count(*) FILTER ({e}) / count(*) FILTER (({e}) IS NOT NULL), 6) END AS percent FROM j GROUP BY orphan" for kind, label, e in _FEATURES))
def _(s, d):
    rows = observed(s, d).withColumnRenamed("length_bytes", "length")
    return rounded(reports.profiles(rows, TOPICS, MACRO), "percent")


@query("E9_medians", OBSERVED + " SELECT language, round(median(age), 6) AS age_median, round(median(length_bytes), 6) AS length_bytes_median FROM observed GROUP BY language")
def _(s, d):
    return rounded(reports.thresholds(observed(s, d), ["age", "length_bytes"]), "age_median", "length_bytes_median")


_BOUNDS = ", v AS (SELECT orphan, length_bytes AS value FROM observed), r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS k, count(*) OVER () AS n FROM v WHERE value IS NOT NULL), b AS (SELECT max(value) FILTER (k = CAST(floor((n - 1) * 0.02) AS BIGINT)) AS lower, max(value) FILTER (k = CAST(ceil((n - 1) * 0.98) AS BIGINT)) AS upper FROM r)"


@query("F6_order_statistics", OBSERVED + _BOUNDS + " SELECT lower, upper FROM b")
def _(s, d):
    return reports.order_statistics(observed(s, d).select("orphan", F.col("length_bytes").alias("value")))


@query("J_N1_histogram", OBSERVED + _BOUNDS + """, bin AS (SELECT orphan, CASE WHEN value < lower THEN 0 WHEN value > upper THEN 19 WHEN ln(1 + upper) = ln(1 + lower) THEN 10 ELSE 1 + least(CAST(floor((ln(1 + value) - ln(1 + lower)) / (ln(1 + upper) - ln(1 + lower)) * 18) AS BIGINT), 17) END AS bin FROM v, b),
n AS (SELECT orphan, bin, count(*) AS n FROM bin GROUP BY ALL), t AS (SELECT orphan, count(*) AS t FROM v GROUP BY orphan)
SELECT g.orphan, CAST(g.bin AS INTEGER) AS bin, coalesce(n.n, 0) AS count, round(100.0 * coalesce(n.n, 0) / t.t, 6) AS percent FROM (SELECT o.orphan, r.bin FROM (VALUES (true), (false)) o(orphan), range(20) r(bin)) g LEFT JOIN n ON n.orphan = g.orphan AND n.bin = g.bin LEFT JOIN t ON t.orphan = g.orphan""")
def _(s, d):
    return rounded(reports.histogram(observed(s, d).select("orphan", F.col("length_bytes").alias("value")), "log"), "percent")


@query("E18_months", OBSERVED + ", n AS (SELECT orphan, least(page_id % 20, 13) AS bin, count(*) AS n FROM observed GROUP BY ALL) SELECT o.orphan, CAST(r.bin AS INTEGER) AS bin, coalesce(n.n, 0) AS count FROM (VALUES (true), (false)) o(orphan) CROSS JOIN range(14) r(bin) LEFT JOIN n ON n.orphan = o.orphan AND n.bin = r.bin")
def _(s, d):
    return reports.month_histogram(observed(s, d).select("orphan", (F.col("page_id") % 20).cast("double").alias("value")))


@query("F7_cumulative", OBSERVED + " SELECT DISTINCT orphan, length_bytes AS value, round(cume_dist() OVER (PARTITION BY orphan ORDER BY length_bytes), 6) AS share FROM observed")
def _(s, d):
    return rounded(reports.cumulative(observed(s, d).select("orphan", F.col("length_bytes").alias("value"))), "share")


@query("E19_interests", OBSERVED + """, ed AS (SELECT language, topic_labels FROM observed), n AS (SELECT count(*) AS edits, count(*) FILTER (len(topic_labels) > 0) AS known FROM ed),
w AS (SELECT label, sum(share) AS weight FROM (SELECT unnest(topic_labels) AS label, 1.0::DOUBLE / len(topic_labels) AS share FROM ed WHERE len(topic_labels) > 0) GROUP BY label), l AS (SELECT language, count(*) AS c FROM ed GROUP BY language),
sp AS (SELECT page_id, sum(weight) AS weight FROM (SELECT page_id, unnest(topic_labels) AS label FROM observed) JOIN w USING (label) GROUP BY page_id)
SELECT o.page_id AS key, round(coalesce(sp.weight, 0) / n.known, 6) AS topic, round(coalesce(l.c, 0)::DOUBLE / n.edits, 6) AS language FROM observed o CROSS JOIN n LEFT JOIN sp ON sp.page_id = o.page_id LEFT JOIN l ON l.language = o.language""")
def _(s, d):
    rows = observed(s, d).select(F.col("page_id").alias("key"), "language", "topic_labels")
    return rounded(reports.interests(rows, rows, aggregate=True), "topic", "language")


@query("J_N2_creator_totals", OBSERVED + " SELECT page_id, count(*) OVER (PARTITION BY creator_key) AS total, sum(CAST(orphan AS INTEGER)) OVER (PARTITION BY creator_key)::BIGINT AS orphans FROM observed WHERE creator_key IS NOT NULL")
def _(s, d):
    rows = observed(s, d).filter("creator_key IS NOT NULL")
    per = rows.groupBy("creator_key").agg(F.count("*").alias("total"), F.count_if("orphan").alias("orphans"))  # an aggregate and a join, so that no creator's pages meet in one task
    return rows.select("page_id", "creator_key").join(per, "creator_key").select("page_id", "total", "orphans")


# --- serving

_PAGES = OBSERVED + ", p AS (SELECT *, lower(title) AS title_fold, CASE WHEN page_id % 5 <> 0 THEN page_id % 4 END AS n, 'c' || (page_id % 7) AS category FROM observed)"


def published(s, d, edge=None):
    k = F.col("page_id")
    return observed(s, d, edge).withColumns({"count": F.when(k % 5 != 0, k % 4), "category": F.concat(F.lit("c"), (k % 7).cast("string"))})


@query("N1_articles", _PAGES + " SELECT language, page_id, title FROM p WHERE language = 'de' AND contains(title_fold, '1') AND category NOT IN ('c1', 'c2') ORDER BY age IS NULL, age DESC, title_fold, title, page_id, language LIMIT 25 OFFSET 25")
def _(s, d):
    q = serving.PageQuery(language="de", search="1", hidden=["c1", "c2"], sort="age", descending=True, offset=25)
    return serving.run(published(s, d), q)[1].select("language", "page_id", "title")


@query("N1_article_total", _PAGES + " SELECT count(*) AS total FROM p WHERE language = 'de' AND contains(title_fold, '1') AND category NOT IN ('c1', 'c2')")
def _(s, d):
    return serving.run(published(s, d), serving.PageQuery(language="de", search="1", hidden=["c1", "c2"]))[0]


@query("N1_cards", _PAGES + " SELECT language, page_id FROM p WHERE orphan AND n > 0 AND len(list_filter(topic_labels, lambda x: contains(lower(x), 'bio'))) > 0 ORDER BY n IS NULL, n DESC, title_fold, title, page_id, language LIMIT 16")
def _(s, d):
    q = serving.PageQuery(kind="cards", with_candidates=True, label="Bio", sort="count", descending=True)
    return serving.run(published(s, d), q)[1].select("language", "page_id")


@query("G6_personalised", _PAGES + f" SELECT language, page_id FROM (SELECT *, coalesce(list_sum(list_transform(topic_labels, lambda x: CASE x WHEN '{TOPICS[0]}' THEN 0.75 WHEN '{TOPICS[2]}' THEN 0.25 ELSE 0.0 END)), 0) AS w FROM p) WHERE orphan ORDER BY w DESC, coalesce(n, 0) DESC, title_fold, title, page_id, language LIMIT 16")
def _(s, d):
    q = serving.PageQuery(kind="cards", sort="personal", weights={TOPICS[0]: 0.75, TOPICS[2]: 0.25})
    return serving.run(published(s, d), q)[1].select("language", "page_id")


@query("D22_open_targets", _SHORT + " SELECT d.language, d.page_id FROM degree d WHERE d.in_degree = 0 AND NOT (EXISTS (SELECT 1 FROM short s WHERE s.language = d.language AND s.target_id = d.page_id) AND NOT EXISTS (SELECT 1 FROM short s WHERE s.language = d.language AND s.target_id = d.page_id AND s.link_id % 2 <> 0))")
def _(s, d):
    edge = edges(s, d)
    short = shortlist(s, d, edge)
    q = serving.PageQuery(kind="cards", all_open=True)
    return serving.filtered(published(s, d, edge), q, closed=short.filter("link_id % 2 = 0"), shortlist=short).select("language", "page_id")


@query("G3_casefold_preview", OBSERVED + " SELECT language, page_id, title FROM observed WHERE orphan ORDER BY lower(title), title, language, page_id LIMIT 25")
def _(s, d):
    from .functions.text import casefold

    return observed(s, d).filter("orphan").orderBy(casefold("title"), "title", "language", "page_id").limit(25).select("language", "page_id", "title")


@query("B6_topic_shards", OBSERVED + " SELECT language, page_id // 1024 AS bucket, count(*) AS pages FROM observed WHERE topic_labels IS NOT NULL GROUP BY ALL")
def _(s, d):
    return observed(s, d).filter("topic_labels IS NOT NULL").groupBy("language", F.floor(F.col("page_id") / 1024).alias("bucket")).agg(F.count("*").alias("pages"))


@query("C15_category_status", duckdb_with("census") + " SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'reviewed' WHEN page_id % 3 = 0 THEN 'no_eligible_category' ELSE 'heuristic_review_needed' END AS status FROM census")
def _(s, d):
    k = F.col("page_id")
    return census(s, d).select(k, observations.category_status(k % 5 == 0, F.when(k % 3 != 0, "c")).alias("status"))


@query("C6_measured", "SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS v FROM customer")
def _(s, d):
    return s.read.parquet(f"{d}/customer.parquet").select("c_custkey", observations.measured(F.col("c_acctbal")).alias("v"))


from . import catalog_editorial, catalog_history, catalog_reviews  # noqa: E402, F401  they add their queries to these
