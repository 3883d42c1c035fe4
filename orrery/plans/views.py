"""The census tables derived from the star schema, as SQL that Spark and DuckDB both read.

{name} stands for a table; text in double angle brackets is written in each engine's own dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("part", "lineitem", "events", "documents", "orders", "customer", "supplier", "nation", "pages")
_LANG = "(VALUES (0, 'en'), (1, 'de'), (2, 'fr'), (3, 'es')) AS l(k, language)"

#: Each engine's form of what the two write differently.
DIALECT = {
    "us": ("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)", "epoch_us(ts)"),
    "at": ("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    "k": ("CAST(get_json_object(props, '$.k') AS BIGINT)", "CAST(json_extract_string(props, '$.k') AS BIGINT)"),
}

VIEWS = {
    "census": f"""SELECT l.language, p.p_partkey * 4 + l.k AS page_id, l.language || '-' || lpad(CAST(p.p_partkey AS STRING), 6, '0') AS title,
  CASE WHEN p.p_partkey % 17 = l.k THEN NULL WHEN p.p_partkey % 53 = l.k THEN 'Q7' WHEN p.p_partkey % 41 = l.k THEN 'Q0' || CAST(p.p_partkey AS STRING)
    ELSE 'Q' || CAST(p.p_partkey + 1 AS STRING) END AS item, CAST(p.p_size * 100 + p.p_partkey % 97 AS DOUBLE) AS length_bytes
FROM {{part}} p CROSS JOIN {_LANG} WHERE p.p_partkey % 7 <> l.k""",
    "raw_link": f"""SELECT l.language, CASE WHEN x.p % 7 <> x.k THEN x.p WHEN x.p < 3 THEN x.p + 3 ELSE x.p - 3 END * 4 + l.k AS source_id,
  CASE WHEN x.l_linenumber = 1 THEN 'R-' || CAST(x.n AS STRING) ELSE l.language || '-' || lpad(CAST(x.n AS STRING), 6, '0') END AS target_title
FROM (SELECT l_linenumber, k, greatest(p - (p + k + 1) % 3, 0) AS p, greatest(n - (n + k) % 3, 0) AS n
  FROM (SELECT l_linenumber, l_orderkey % 4 AS k, l_partkey AS p, (l_suppkey * 31 + l_orderkey) % (SELECT count(*) FROM {{part}}) AS n FROM {{lineitem}}) y) x
JOIN {_LANG} ON x.k = l.k""",
    "redirect": f"""SELECT l.language, 'R-' || CAST(p.p_partkey AS STRING) AS title, 'S-' || CAST(p.p_partkey AS STRING) AS target FROM {{part}} p CROSS JOIN {_LANG}
UNION ALL SELECT l.language, 'S-' || CAST(p.p_partkey AS STRING), CASE WHEN p.p_partkey % 50 = 0 THEN 'R-' || CAST(p.p_partkey AS STRING)
  WHEN p.p_partkey % 61 = 0 THEN 'missing-' || CAST(p.p_partkey AS STRING) ELSE l.language || '-' || lpad(CAST(p.p_partkey AS STRING), 6, '0') END FROM {{part}} p CROSS JOIN {_LANG}""",
    "page_category": f"""SELECT l.language, p.p_partkey * 4 + l.k AS page_id, c.j AS position,
  CASE c.j WHEN 0 THEN p.p_type WHEN 1 THEN p.p_brand ELSE 'size ' || CAST(p.p_size % 10 AS STRING) END AS category
FROM {{part}} p CROSS JOIN {_LANG} CROSS JOIN (VALUES (0), (1), (2)) AS c(j) WHERE p.p_partkey % 7 <> l.k AND (p.p_partkey + c.j) % 5 <> 0""",
    "category_parent": f"""SELECT DISTINCT l.language, 'size ' || CAST(p.p_size % 10 AS STRING) AS category, p.p_brand AS parent FROM {{part}} p CROSS JOIN {_LANG} WHERE p.p_partkey % 3 = 0
UNION SELECT DISTINCT l.language, p.p_brand, p.p_type FROM {{part}} p CROSS JOIN {_LANG} WHERE p.p_partkey % 11 = 0
UNION SELECT l.language, 'size 1', 'size 2' FROM {_LANG} UNION SELECT l.language, 'size 2', 'size 1' FROM {_LANG}""",
    "edit": "SELECT user_id, <<us>> AS us, <<k>> % 2 AS ns, event_id FROM {events} WHERE event_type <> 'signup'",
    "creation": "SELECT event_id AS page_id, user_id, <<us>> AS us FROM {events} WHERE event_type = 'signup'",
    "revision": """SELECT user_id * 20 + <<k>> % 20 AS page_id, event_id AS revision_id, CASE WHEN event_id % 2 = 0 THEN 0 ELSE event_id END AS parent_id, <<at>> AS at, CASE WHEN event_id % 11 <> 0 THEN user_id END AS user_id,
  event_id % 13 = 0 AS hidden, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'sysop,bot' WHEN 2 THEN 'editor' END AS groups, CASE event_id % 5 WHEN 0 THEN 'mobile,new' WHEN 1 THEN '' END AS tags,
  CASE user_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'bad' WHEN 2 THEN '2030-01-01 00:00:00' ELSE '2020-01-01 00:00:00' END AS registration,
  CASE WHEN event_id % 17 = 1 THEN '2020-01-01 00:00:00' ELSE <<at>> END AS created, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN <<at>> END AS first, event_id % 19 = 0 AS before FROM {events}""",
    "page_event": """SELECT user_id * 20 + <<k>> % 20 AS page_id, CASE WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'create' WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'import' ELSE event_type END AS event_type, <<at>> AS at FROM {events}""",
    "stamp": """SELECT user_id * 20 + <<k>> % 20 AS page_id, CASE WHEN (user_id * 20 + <<k>> % 20) % 9 = 0 THEN '2024-02-01 00:00:60' WHEN (user_id * 20 + <<k>> % 20) % 3 = 0 THEN '2024-02-01 00:00:00' WHEN user_id % 3 = 0 THEN '' ELSE <<at>> END AS at FROM {events}""",
    "user_edit": """SELECT user_id, CASE WHEN user_id % 13 = 0 AND event_id % 5 = 0 THEN 'bad' ELSE <<at>> END AS at, <<k>> % 2 AS ns FROM {events}""",
    "user_group": """SELECT DISTINCT user_id, CASE WHEN user_id % 2 = 0 THEN 'bot' ELSE 'sysop' END AS name, CASE user_id % 7 WHEN 1 THEN '20300101000000' WHEN 2 THEN 'invalid' WHEN 3 THEN '20200101000000' WHEN 4 THEN NULL ELSE '20240201000001' END AS expiry FROM {events}""",
    "history_page": """SELECT DISTINCT user_id * 20 + <<k>> % 20 AS page_id FROM {events} UNION SELECT DISTINCT user_id * 20 + <<k>> % 20 + 1000000 FROM {events}""",
    "content": """SELECT doc_id AS page_id, lang AS language, CASE WHEN doc_id % 13 = 0 THEN NULL WHEN doc_id % 17 = 0 THEN ''
  ELSE text || repeat('[[Category:C]]', CAST(doc_id % 4 AS INT)) || repeat('[[File:X]]', CAST(doc_id % 3 AS INT)) || repeat('[[Foo|bar]]', CAST(doc_id % 5 AS INT)) || repeat('==A==', CAST(doc_id % 3 AS INT)) || repeat('<ref>a</ref>', CAST(doc_id % 2 AS INT)) END AS text
FROM {documents}""",
}


def spark_view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table; its base tables are read with the columns that it needs."""
    sql = re.sub(r"<<(\w+)>>", lambda m: DIALECT[m[1]][0], VIEWS[name])
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in BASE if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def duckdb_with(*names: str) -> str:
    """WITH clauses that define the derived tables."""
    out = []
    for name in names:
        sql = re.sub(r"<<(\w+)>>", lambda m: DIALECT[m[1]][1], VIEWS[name])
        out.append(f"{name} AS ({re.sub(r'{(\w+)}', r'\1', sql)})")
    return "WITH RECURSIVE " + ",\n".join(out)
