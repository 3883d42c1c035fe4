"""What the review of round 2 found."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from orrery import catalog
from orrery.operators import graph, supplement

SF = "/root/testdata/sf0.001"


def test_links_lead_to_all_pages_of_a_title(spark):
    c = spark.createDataFrame([("x", 1, "A"), ("x", 2, "A"), ("x", 3, "B")], "language string, page_id long, title string")
    k = spark.createDataFrame([("x", 3, "A"), ("x", 3, "R"), ("x", 1, "B"), ("x", 1, "C")], "language string, source_id long, target_title string")
    r = spark.createDataFrame([("x", "R", "A")], "language string, title string, target string")
    got = graph.resolved_links(k, c, graph.resolve_redirects(r), shared_titles=True).collect()
    assert sorted((x.source_id, x.target_id or 0) for x in got) == [(1, 0), (1, 3), (3, 1), (3, 1), (3, 2), (3, 2)]


def test_degrees_with_keys_over_a_million(spark, tmp_path):
    """Such keys have titles cut to six digits, which pages share."""
    import duckdb

    part = spark.read.parquet(f"{SF}/part.parquet")
    keys = part.withColumn("p_partkey", F.when(F.col("p_partkey") < 100, F.col("p_partkey")).otherwise(F.col("p_partkey") + 999_900))
    keys.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    os.symlink(f"{SF}/lineitem.parquet", f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for f in glob.glob(f"{tmp_path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' * os.path.isdir(f)}'")
    want = con.execute(f"SELECT language, page_id, in_degree, out_degree FROM ({catalog.ORACLE_SQL['E1_degrees']})").fetchall()
    got = catalog.QUERIES["E1_degrees"](spark, str(tmp_path)).select("language", "page_id", "in_degree", "out_degree").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_history_of_a_page_in_several_rows(spark):
    rows = spark.createDataFrame([(1, "2001-01-15 00:00:00"), (1, "2001-01-16 00:00:00"), (2, "2001-01-17 00:00:00")], "page_id long, created_at string")
    record = "page_id long, article_created_at string, creator_history_status string, page_created_at string, creation_status string, creator_attribution string, creator_key string, prior_main long, prior_other long, prior_articles long, months long, bucket string, tenure_days double, is_bot_now boolean"
    records = spark.createDataFrame([(1, None, "unavailable", "2020-01-01 00:00:00", "reconstructed_history", *[None] * 9)], record)
    got = sorted((r.page_id, r.created_at, r.history_data_status) for r in supplement.observed_history(rows, records).collect())
    assert got == [(1, "2020-01-01 00:00:00", "history_initial_revision_unknown")] * 2 + [(2, "2001-01-17 00:00:00", "missing_page")]


@pytest.mark.parametrize("name", ["C10_valid_references", "D15_titled_evidence", "D17_counted_pages"])
def test_evidence_with_keys_over_a_million(spark, tmp_path, name):
    import duckdb

    part = spark.read.parquet(f"{SF}/part.parquet")
    keys = part.withColumn("p_partkey", F.when(F.col("p_partkey") < 100, F.col("p_partkey")).otherwise(F.col("p_partkey") + 999_900))
    keys.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    os.symlink(f"{SF}/lineitem.parquet", f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for f in glob.glob(f"{tmp_path}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}{'/*.parquet' * os.path.isdir(f)}'")
    got = catalog.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({catalog.ORACLE_SQL[name]})").fetchall()
    assert want and sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
