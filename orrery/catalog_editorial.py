"""Queries of suggestions, cards, creators, exports and whole observations, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .catalog import _KNOWN, _PAGES, _SHORT, _WIKI, CAT, COMPARE, GRAPH, OBSERVED, TOPICS, _Comparison, census, degree, edges, observed, published, query, ranked, shortlist
from .operators import categories, compare, editorial, graph, observations, quality, reports, topics
from .plans.views import duckdb_with, spark_view


def _after(sql: str, *names: str) -> str:
    """What follows the derived tables in a query's clauses."""
    return sql[len(duckdb_with(*names)) :]


def _more(*names: str) -> str:
    return ", " + duckdb_with(*names).removeprefix("WITH RECURSIVE ")


_TITLED = COMPARE + """, titled AS (SELECT e.*, a.title AS source_title, b.title AS target_title FROM evidence e JOIN census a ON a.language = e.reference AND a.page_id = e.ref_source JOIN census b ON b.language = e.reference AND b.page_id = e.ref_target)"""


def titled(s, d):
    c = _Comparison(s, d)
    return editorial.titled(c.evidence, c.census)


@query("D15_titled_evidence", _TITLED + " SELECT language, target_id, link_id, reference, source_title, target_title FROM titled")
def _(s, d):
    return titled(s, d).select("language", "target_id", "link_id", "reference", "source_title", "target_title")


_CODE = "CASE WHEN ref_source % 10 = 0 THEN 'all' WHEN ref_source % 10 = 1 THEN 'X!' WHEN ref_source % 10 = 2 THEN language ELSE reference END"


def doubtful(s, d):
    """The evidence with codes and titles some of which aren't valid."""
    k, t = F.col("ref_source") % 10, F.col("ref_target") % 7
    code = F.when(k == 0, "all").when(k == 1, "X!").when(k == 2, F.col("language")).otherwise(F.col("reference"))
    title = F.when(t == 0, F.lit("\x1c \t")).when(t == 1, None).otherwise(F.col("target_title"))
    return titled(s, d).withColumns({"reference": code, "target_title": title, "position": F.col("ref_source") * 100_000 + F.col("ref_target")})


@query("C10_valid_references", _TITLED + " SELECT language, target_id, link_id, ref_source, ref_target, ref_source % 10 > 2 AND ref_target % 7 > 1 AS valid FROM titled")
def _(s, d):
    ok = editorial.valid_reference(F.col("reference"), F.col("language"), F.col("source_title"), F.col("target_title"))
    return doubtful(s, d).select("language", "target_id", "link_id", "ref_source", "ref_target", ok.alias("valid"))


@query("E22_support", _TITLED + f""", d AS (SELECT language, target_id, link_id, {_CODE} AS code, ref_source % 10 > 2 AND ref_target % 7 > 1 AS ok, ref_source * 100000 + ref_target AS position FROM titled)
SELECT language, target_id, link_id, count(DISTINCT code) FILTER (ok) AS "references", min(position) FILTER (ok) AS first_edge FROM d GROUP BY language, target_id, link_id""")
def _(s, d):
    return editorial.support(doubtful(s, d), census(s, d))


@query("D23_references", _TITLED + ' SELECT language, target_id, count(DISTINCT reference) AS "references" FROM titled GROUP BY language, target_id')
def _(s, d):
    return titled(s, d).groupBy("language", "target_id").agg(F.count_distinct("reference").alias("references"))


@query("G12_prompts", _SHORT + """, named AS (SELECT m.*, c.title FROM mention m JOIN census c ON c.language = m.language AND c.page_id = m.link_id)
SELECT language, target_id, link_id, place FROM (SELECT *, row_number() OVER (PARTITION BY language, target_id ORDER BY coalesce(local_mention, false) DESC, "references" DESC, dead_end DESC, title, link_id) AS place FROM named) WHERE place <= 5""")
def _(s, d):
    k, c = F.col("link_id") % 3, _Comparison(s, d)
    return editorial.prompts(c.candidates.drop("title").withColumn("local_mention", F.when(k == 0, True).when(k == 1, False)), c.census)


_STATUS = COMPARE + """, status AS (SELECT o.language, o.page_id, CASE WHEN i.n > 1 THEN 'ambiguous_item' WHEN i.n IS NULL THEN 'missing_item' WHEN a.page_id IS NULL THEN 'counterpart_unavailable' ELSE 'compared' END AS status,
 CASE WHEN i.n = 1 AND a.page_id IS NOT NULL THEN coalesce(k.n, 0) END AS candidates FROM all_orphan o LEFT JOIN item_count i ON i.language = o.language AND i.item = o.item
 LEFT JOIN (SELECT DISTINCT language, page_id FROM grid WHERE page_id_there IS NOT NULL) a ON a.language = o.language AND a.page_id = o.page_id LEFT JOIN (SELECT language, target_id, count(*) n FROM candidate GROUP BY ALL) k ON k.language = o.language AND k.target_id = o.page_id)"""


@query("D17_counted_pages", _STATUS + " SELECT c.language, c.page_id, s.status AS candidate_status, s.candidates AS candidate_count FROM census c LEFT JOIN status s ON s.language = c.language AND s.page_id = c.page_id")
def _(s, d):
    c = _Comparison(s, d)
    return editorial.counted_pages(c.census.select("language", "page_id"), compare.target_status(c.all_orphans, c.items, c.counterparts, c.candidates))


@query("D21_cards", _SHORT + """, linked AS (SELECT s.language, s.target_id AS page_id, string_agg(s.link_id || '=' || c.title, ';' ORDER BY s.rank) AS links FROM short s JOIN census c ON c.language = s.language AND c.page_id = s.link_id GROUP BY ALL)
SELECT l.language, l.page_id, c.title, CASE WHEN c.page_id % 3 > 0 THEN 'c' || (c.page_id % 7) END AS category, l.links FROM linked l JOIN census c ON c.language = l.language AND c.page_id = l.page_id""")
def _(s, d):
    k, c = F.col("page_id"), census(s, d)
    category = c.select("language", k, F.when(k % 3 > 0, F.concat(F.lit("c"), (k % 7).cast("string"))).alias("category"))
    rows = editorial.cards(shortlist(s, d).select("language", "target_id", "link_id", "rank"), c, category)
    return rows.withColumn("links", F.array_join(F.transform("links", lambda x: F.concat(x["link_id"].cast("string"), F.lit("="), x["title"])), ";"))


@query("D16_invalid_seeds", COMPARE + """, stored AS (SELECT language, target_id, link_id, reference, ref_source + CASE WHEN ref_target % 9 = 0 THEN 4 ELSE 0 END AS ref_source, ref_target FROM evidence)
SELECT s.* FROM stored s LEFT JOIN uniq a ON a.language = s.language AND a.page_id = s.target_id LEFT JOIN uniq b ON b.language = s.language AND b.page_id = s.link_id LEFT JOIN uniq c ON c.language = s.reference AND c.page_id = s.ref_source
 LEFT JOIN uniq e ON e.language = s.reference AND e.page_id = s.ref_target LEFT JOIN edge g ON g.language = s.reference AND g.source_id = s.ref_source AND g.target_id = s.ref_target
 WHERE NOT coalesce(g.language IS NOT NULL AND a.item = e.item AND b.item = c.item, false)""")
def _(s, d):
    edge = edges(s, d)
    c = _Comparison(s, d, edge)
    stored = c.evidence.withColumn("ref_source", F.col("ref_source") + F.when(F.col("ref_target") % 9 == 0, 4).otherwise(0))
    return editorial.invalid_seeds(stored, c.unique, edge)


@query("O2_edit_topics", OBSERVED + _more("user_edit") + " SELECT u.user_id, u.ns, count(*) AS edits, count(k.topic_labels) AS known FROM user_edit u LEFT JOIN observed k ON k.page_id = u.user_id AND u.ns = 0 GROUP BY u.user_id, u.ns")
def _(s, d):
    made = spark_view(s, d, "user_edit").withColumn("page_id", F.col("user_id"))
    rows = editorial.with_topics(made, observed(s, d).select("page_id", "topic_labels"))
    return rows.groupBy("user_id", "ns").agg(F.count("*").alias("edits"), F.count("topic_labels").alias("known"))


_CREATORS = OBSERVED + ", cr AS (SELECT creator_key AS key, count(*) AS articles, CASE WHEN min(page_id) % 4 <> 0 THEN count(*) * 2 END AS total, count(*) FILTER (orphan) AS orphans FROM observed WHERE creator_key IS NOT NULL GROUP BY creator_key)"


def _creators(s, d):
    known = F.min("page_id") % 4 != 0
    return observed(s, d).filter("creator_key IS NOT NULL").groupBy(F.col("creator_key").alias("key")).agg(F.count("*").alias("articles"), F.when(known, F.count("*") * 2).alias("total"), F.count_if("orphan").alias("orphans"))


@query("G8_creators", _CREATORS + " SELECT key, total FROM cr WHERE contains(lower(key), 'u1') ORDER BY total IS NULL, total, key LIMIT 25 OFFSET 25")
def _(s, d):
    return editorial.creators(_creators(s, d), "U1", "articles-asc", 25, census_counts=False)[1].select("key", "total")


@query("N1_creators", _CREATORS + " SELECT key, articles, orphans FROM cr ORDER BY orphans DESC, key LIMIT 25")
def _(s, d):
    return editorial.creators(_creators(s, d))[1].select("key", "articles", "orphans")


@query("N1_creator_total", _CREATORS + " SELECT count(*) AS total FROM cr WHERE contains(lower(key), '7')")
def _(s, d):
    return editorial.creators(_creators(s, d), "7")[0]


@query("C12_card_filters", _PAGES + " SELECT language, page_id FROM p WHERE orphan AND page_id % 11 <> 0 AND n > 0 AND category NOT IN ('c1', 'c2')")
def _(s, d):
    k = F.col("page_id")
    rows = published(s, d).withColumns({"special": k % 11 == 0, "redirect": k % 13 == 0})
    return editorial.card_filters(rows, "orphans", redirects=True, hidden=["c1", "c2"]).select("language", "page_id")


@query("C13_topic_filter", OBSERVED + """ SELECT language, page_id FROM observed WHERE CASE WHEN topic_labels IS NULL THEN false WHEN len(topic_labels) = 0 THEN true ELSE len(list_filter(topic_labels, lambda x: contains(replace(lower(x), '.', ' · '), 'culture · b'))) > 0 END""")
def _(s, d):
    rows = observed(s, d).withColumn("topic_status", F.when(F.col("topic_labels").isNotNull(), "predicted"))
    return editorial.topic_filter(rows, "Culture · B", "Not predicted", "None of these; culture · b").select("language", "page_id")


@query("B4_csv", OBSERVED + """ SELECT page_id, language || ',' || page_id || ',' || CASE WHEN orphan THEN 'True' ELSE 'False' END || ',' || CASE WHEN page_id % 4 = 0 THEN '"a, ""b""' || chr(10) || '"' ELSE '' END || ',' || in_degree || ','
 || CASE WHEN topic_labels IS NULL THEN '' WHEN len(topic_labels) = 0 THEN '[]' WHEN len(topic_labels) = 1 THEN '[''' || topic_labels[1] || ''']' ELSE '"[''' || topic_labels[1] || ''', ''' || topic_labels[2] || ''']"' END || chr(13) || chr(10) AS line FROM (SELECT * REPLACE (list_sort(topic_labels) AS topic_labels) FROM observed)""")
def _(s, d):
    rows = observed(s, d).withColumns({"note": F.when(F.col("page_id") % 4 == 0, F.lit('a, "b"\n')), "topic_labels": F.array_sort("topic_labels")})
    return editorial.csv_lines(rows, ["language", "page_id", "orphan", "note", "in_degree", "topic_labels"], ["page_id"])


@query("B5_projections", OBSERVED + """ SELECT language, page_id // 1024 AS shard, '[' || string_agg(CAST(page_id AS VARCHAR), ',' ORDER BY page_id) || ']' AS page_id, '[' || string_agg('"' || title || '"', ',' ORDER BY page_id) || ']' AS title, '[' || string_agg(coalesce('"' || creator_key || '"', 'null'), ',' ORDER BY page_id) || ']' AS creator_key FROM observed o GROUP BY language, o.page_id // 1024""")
def _(s, d):
    return editorial.projections(observed(s, d), ["page_id", "title", "creator_key"])


@query("B8_summary_categories", OBSERVED + _more("page_category") + " SELECT category AS label, count(*) AS total, count(*) FILTER (orphan) AS orphans FROM page_category JOIN observed USING (language, page_id) GROUP BY category ORDER BY orphans DESC, label LIMIT 20")
def _(s, d):
    """A top-k report: the twenty categories of most orphans."""
    rows = spark_view(s, d, "page_category").join(observed(s, d).select("language", "page_id", "orphan"), ["language", "page_id"])
    return reports.label_counts(rows, "category").orderBy(F.desc("orphans"), "label").limit(20).select("label", "total", "orphans")


_WHOLE = GRAPH + _more("page_category", "category_parent", "content") + _after(CAT, "census", "page_category", "category_parent") + _after(_WIKI, "census", "content") + f""",
near AS (SELECT e.language, e.source_id, count(DISTINCT u.item) FILTER ({_KNOWN}) AS n FROM edge e JOIN uniq u ON u.language = e.language AND u.page_id = e.target_id GROUP BY ALL)"""


@query("Q7_observations", _WHOLE + """ SELECT c.language, c.page_id, CASE WHEN regexp_full_match(c.item, 'Q[1-9][0-9]*') THEN c.item END AS item, d.in_degree, d.out_degree, d.in_degree = 0 AS orphan, r.category AS choice, CASE WHEN r.category IS NULL THEN 'no_eligible_category' ELSE 'heuristic_review_needed' END AS category_status,
 CASE WHEN t.n > 0 THEN 'predicted' WHEN t.n = 0 THEN 'no_model_vocabulary' ELSE 'no_mapped_outlinks' END AS topic_status, CASE WHEN x.page_id IS NULL THEN 'missing_current_page' WHEN NOT x.has_text THEN 'missing_wikitext' ELSE 'scored' END AS quality_status
 FROM census c JOIN degree d ON d.language = c.language AND d.page_id = c.page_id LEFT JOIN ranked r ON r.language = c.language AND r.page_id = c.page_id AND r.rank = 1 LEFT JOIN near t ON t.language = c.language AND t.source_id = c.page_id LEFT JOIN x ON x.language = c.language AND x.page_id = c.page_id""")
def _(s, d):
    """The wide row of each page: graph, category, topics and quality, each of which must have a record of it."""
    c, edge, keys = census(s, d), edges(s, d), ["language", "page_id"]
    unique = graph.unique_items(c)
    vocabulary = unique.select("item").distinct().filter(F.substring("item", 2, 20).cast("long") % 3 != 0)
    model = topics.LinearStub([f"__label__{t.replace(' ', '_')}" for t in TOPICS])
    told = topics.supplement(graph.topic_inputs(c, edge, unique, vocabulary), model).select(*keys, "topic_status")
    scored = quality.supplement(spark_view(s, d, "content"), c).select(*keys, "quality_status")
    rows = c.join(degree(s, d, edge), keys).join(categories.choices(ranked(s, d), c), keys)
    rows = observations.strictly_joined(observations.strictly_joined(rows, told, keys, "topics"), scored, keys, "quality")
    item = F.when(graph.valid_item(F.col("item")), F.col("item"))
    return rows.select(*keys, item.alias("item"), "in_degree", "out_degree", (F.col("in_degree") == 0).alias("orphan"), "choice", observations.category_status(F.col("manual"), F.col("choice")).alias("category_status"), "topic_status", "quality_status")
