"""The queries of these operators over their whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, decontaminate, fingerprint, html, langid, license, lm, neardup, tokencount, warc

VOCABULARY = "word_bpe_49k.json"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), bpe.vocabulary_of(VOCABULARY))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts before and after one edit of each document: 64 code points from a third on give way to its first 64."""
    docs, n = _table(spark, sf_dir, "documents"), F.length("text")
    start = F.floor(n / 3)
    edit = F.struct(start.alias("start"), (start + 64).alias("end"), F.substring("text", 1, 64).alias("replacement"))
    return tokencount.counts(docs, bpe.vocabulary_of(VOCABULARY), F.array(edit)).drop("sums")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses_of(_table(spark, sf_dir, "pages"))).withColumnRenamed("key", "page_id")


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), width=2)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no paths: a document lies in a directory of its source, or in one of eight below it."""
    below = F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("d"), (F.col("doc_id") % 8).cast("string")))
    path = F.when(F.col("source").isNotNull(), F.concat_ws("/", "source", below, F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))))
    return license.scan(_table(spark, sf_dir, "documents"), path)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_with_groups(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_token_counts, op3_main_text, op4_language_id, op5_decontamination, op6_warc_derivatives, op7_lm_scores, op8_near_duplicates, op9_licenses, op10_fingerprints)}

ORACLE_SQL = {
    "op8_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM words),
sized AS (SELECT doc_id, s, CAST(len(s) AS BIGINT) AS n FROM sets),
same AS (SELECT min(doc_id) AS rep, list_sort(s) AS s, n FROM sized WHERE n > 0 GROUP BY ALL),
spread AS (SELECT rep, n, unnest(s) AS g FROM same),
often AS (SELECT g, count(*) AS df FROM spread GROUP BY g),
ranked AS (SELECT rep, n, spread.g, row_number() OVER (PARTITION BY rep ORDER BY df, spread.g) AS k FROM spread JOIN often ON spread.g = often.g),
pairs AS (
  SELECT DISTINCT a.rep AS x, b.rep AS y FROM ranked a JOIN ranked b ON a.g = b.g AND a.rep < b.rep
  WHERE a.k <= a.n - (a.n * 4 + 4) // 5 + 1 AND b.k <= b.n - (b.n * 4 + 4) // 5 + 1 AND 5 * least(a.n, b.n) >= 4 * greatest(a.n, b.n)),
linked AS (
  SELECT x, y FROM (SELECT p.x, p.y, len(list_intersect(a.s, b.s)) AS c, a.n + b.n AS t FROM pairs p JOIN same a ON a.rep = p.x JOIN same b ON b.rep = p.y)
  WHERE 100 * c >= 80 * (t - c)),
edges AS (SELECT x, y FROM linked UNION ALL SELECT y, x FROM linked),
reach AS (SELECT rep AS a, rep AS b FROM same UNION SELECT r.a, e.y FROM reach r JOIN edges e ON r.b = e.x),
least_id AS (SELECT a AS rep, min(b) AS component_id FROM reach GROUP BY a),
named AS (SELECT s, component_id FROM same JOIN least_id USING (rep))
SELECT d.doc_id, d.n AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(component_id, d.doc_id) = d.doc_id AS kept
FROM sized d LEFT JOIN named ON list_sort(d.s) = named.s AND d.n > 0
""",
}
