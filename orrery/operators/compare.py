"""Link suggestions from other editions: edges between the same items there."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def evidence(orphans: DataFrame, unique: DataFrame, eligible: DataFrame) -> DataFrame:
    """language, target_id, link_id, reference, ref_source, ref_target: a link from link_id to the orphan exists in the reference edition.

    orphans(language, page_id, item) of unique items; eligible: edges with source_item, target_item. The
    orphans' items cut the reference edges down before the sources are looked up.
    """
    wanted = orphans.select("language", F.col("page_id").alias("target_id"), F.col("item").alias("target_item"))
    edges = eligible.select(F.col("language").alias("reference"), F.col("source_id").alias("ref_source"), F.col("target_id").alias("ref_target"), "source_item", "target_item")
    local = unique.select("language", F.col("item").alias("source_item"), F.col("page_id").alias("link_id"))
    found = edges.join(wanted, "target_item").filter("language <> reference").join(local, ["language", "source_item"]).filter("link_id <> target_id")
    return found.select("language", "target_id", "link_id", "reference", "ref_source", "ref_target").distinct()


def candidates(evidence_rows: DataFrame, degree: DataFrame, census: DataFrame) -> DataFrame:
    """language, target_id, link_id, references, dead_end, position: dead ends first, then by title and id."""
    per = evidence_rows.groupBy("language", "target_id", "link_id").agg(F.count_distinct("reference").alias("references"), F.count("*").alias("n_evidence"))
    about = degree.join(census.select("language", "page_id", "title"), ["language", "page_id"]).select("language", F.col("page_id").alias("link_id"), (F.col("out_degree") == 0).alias("dead_end"), "title")
    order = Window.partitionBy("language", "target_id").orderBy(F.desc("dead_end"), "title", "link_id")
    return per.join(about, ["language", "link_id"]).withColumn("position", F.row_number().over(order) - 1)


def shortlist(candidate: DataFrame, mention: DataFrame | None = None, most: int = 5) -> DataFrame:
    """The best of each group (dead ends, others) of a target by local mention, references, dead end, position; rank runs over the target."""
    rows = candidate.join(mention, ["language", "target_id", "link_id"], "left") if mention is not None else candidate.withColumn("local_mention", F.lit(None).cast("boolean"))
    order = [F.desc(F.col("local_mention").eqNullSafe(True)), F.desc("references"), F.desc("dead_end"), "position"]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("language", "target_id").orderBy(*order)))
    return ranked.withColumn("in_group", F.row_number().over(Window.partitionBy("language", "target_id", "dead_end").orderBy("rank"))).filter(F.col("in_group") <= most).drop("in_group")


def target_status(orphans: DataFrame, items: DataFrame, counterpart: DataFrame, candidate: DataFrame) -> DataFrame:
    """language, page_id, status, candidates (0 is known; null unless compared). items: of graph.item_counts()."""
    n = candidate.groupBy("language", F.col("target_id").alias("page_id")).agg(F.count("*").alias("found"))
    available = counterpart.filter("page_id_there IS NOT NULL").select("language", "page_id").distinct().withColumn("available", F.lit(True))
    rows = orphans.join(items.select("language", "item", F.col("n").alias("n_item")), ["language", "item"], "left").join(available, ["language", "page_id"], "left").join(n, ["language", "page_id"], "left")
    status = F.when(F.col("n_item") > 1, "ambiguous_item").when(F.col("n_item").isNull(), "missing_item").when(F.col("available").isNull(), "counterpart_unavailable").otherwise("compared")
    return rows.select("language", "page_id", status.alias("status"), F.when(status == "compared", F.coalesce("found", F.lit(0).cast("long"))).alias("candidates"))


def counterparts(orphans: DataFrame, items: DataFrame, degree: DataFrame, editions: list[str]) -> DataFrame:
    """language, page_id, other, status, page_id_there, in_degree_there for each other edition. orphans have unique items; editions is a short fixed list."""
    grid = orphans.select("language", "page_id", "item").withColumn("other", F.explode(F.array(*map(F.lit, editions)))).filter("other <> language")
    there = items.select(F.col("language").alias("other"), "item", "n", F.col("page_id").alias("page_id_there"))
    into = degree.select(F.col("language").alias("other"), F.col("page_id").alias("page_id_there"), F.col("in_degree").alias("in_degree_there"))
    rows = grid.join(there, ["other", "item"], "left").join(into, ["other", "page_id_there"], "left")
    status = F.when(F.col("n") > 1, "ambiguous_item").when(F.col("n").isNull(), "missing_counterpart").when(F.col("in_degree_there") == 0, "orphan").otherwise("non_orphan")
    return rows.select("language", "page_id", "other", status.alias("status"), "page_id_there", "in_degree_there")
