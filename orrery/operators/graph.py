"""The link graph: redirects, degrees, unique items, eligible edges, topic inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import hold

ITEM = r"^Q[1-9][0-9]*\z"


def valid_item(item: Column) -> Column:
    """Q and a positive number, ASCII only."""
    return F.coalesce(item.rlike(ITEM), F.lit(False))


def resolve_redirects(redirects: DataFrame, max_rounds: int = 40) -> DataFrame:
    """language, title, target, where target is the end of the chain; titles in or before a cycle have a null target.

    redirects(language, title, target) and, where a title may have several rows, position: the last one counts,
    or the greatest target without positions.
    Each round doubles the steps that a row has taken, so a chain of n steps takes log2(n) rounds.
    """
    last = F.max_by("target", "position") if "position" in redirects.columns else F.max("target")
    start = redirects.groupBy("language", "title").agg(last.alias("target"))
    now, rows = start, None
    for _ in range(max_rounds):
        step = now.select("language", F.col("title").alias("target"), F.col("target").alias("far"))
        moved = now.join(step, ["language", "target"], "left").select("language", "title", F.coalesce("far", "target").alias("target"), F.col("far").isNotNull().alias("moved"))
        moved = hold(moved)
        going = moved.filter("moved").count()
        now = moved.select("language", "title", "target")
        if going in (0, rows):  # every chain has rows that stop in each round, so what goes on in the same number runs in circles
            break
        rows = going
    ends = start.select("language", F.col("title").alias("target"), F.lit(True).alias("goes_on"))
    return now.join(ends, ["language", "target"], "left").select("language", "title", F.when(F.col("goes_on").isNull(), F.col("target")).alias("target"))


def one_page() -> Column:
    """An aggregate: the page of a title; two pages of one title are an error, as links would count twice."""
    return F.when(F.count("*") > 1, F.raise_error(F.concat(F.lit("two pages have the title "), F.first("title"))).cast("long")).otherwise(F.min("page_id"))


def resolved_links(links: DataFrame, census: DataFrame, resolved: DataFrame, shared_titles: bool = False) -> DataFrame:
    """language, source_id, target_id per link occurrence; a null target_id is unresolved. A redirect goes before a page of its title.

    A title of two pages is an error, or with shared_titles an occurrence for each of its pages.
    """
    hop = resolved.select("language", F.col("title").alias("target_title"), F.col("target"), F.lit(True).alias("redirected"))
    title = F.col("title").alias("final")
    pages = census.select("language", title, F.col("page_id").alias("target_id")) if shared_titles else census.groupBy("language", title).agg(one_page().alias("target_id"))
    ends = links.join(hop, ["language", "target_title"], "left").withColumn("final", F.when(F.col("redirected"), F.col("target")).otherwise(F.col("target_title")))
    return ends.join(pages, ["language", "final"], "left").select("language", "source_id", "target_id")


def edges(occurrences: DataFrame) -> DataFrame:
    """Distinct edges between different pages."""
    return occurrences.filter("target_id IS NOT NULL AND source_id <> target_id").distinct()


def degrees(census: DataFrame, edge: DataFrame) -> DataFrame:
    """language, page_id, in_degree, out_degree; isolated pages have zeros. One shuffle serves both counts."""
    ends = edge.select("language", F.explode(F.array(F.struct(F.col("source_id").alias("page_id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_id").alias("page_id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e"))
    counts = ends.groupBy("language", "e.page_id").agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return census.select("language", "page_id").join(counts, ["language", "page_id"], "left").select("language", "page_id", zero(F.col("i")).alias("in_degree"), zero(F.col("o")).alias("out_degree"))


def unresolved(occurrences: DataFrame) -> DataFrame:
    return occurrences.groupBy("language").agg(F.count_if(F.col("target_id").isNull()).alias("unresolved"), F.count("*").alias("links"))


def item_counts(census: DataFrame) -> DataFrame:
    """language, item, n, page_id (null where the item is ambiguous), for valid items."""
    return census.filter(valid_item(F.col("item"))).groupBy("language", "item").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).select("language", "item", "n", F.when(F.col("n") == 1, F.col("first")).alias("page_id"))


def unique_items(census: DataFrame) -> DataFrame:
    return item_counts(census).filter("n = 1").select("language", "item", "page_id")


def matchable_edges(edge: DataFrame, unique: DataFrame) -> DataFrame:
    """Edges both of whose ends have an item of their own, with the items."""
    source = unique.select("language", F.col("page_id").alias("source_id"), F.col("item").alias("source_item"))
    target = unique.select("language", F.col("page_id").alias("target_id"), F.col("item").alias("target_item"))
    return edge.join(source, ["language", "source_id"]).join(target, ["language", "target_id"])


def reverse_adjacency(edge: DataFrame) -> DataFrame:
    return edge.groupBy("language", F.col("target_id").alias("page_id")).agg(F.array_sort(F.collect_list("source_id")).alias("sources"))


def topic_inputs(census: DataFrame, edge: DataFrame, unique: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """language, page_id, input (sorted distinct known items of the out-neighbours, joined by spaces), n, mapped."""
    known = unique.join(vocabulary.select("item", F.lit(True).alias("known")), "item", "left")
    near = edge.join(known.select("language", F.col("page_id").alias("target_id"), "item", "known"), ["language", "target_id"])
    per = near.groupBy("language", F.col("source_id").alias("page_id")).agg(F.array_sort(F.collect_set(F.when(F.col("known"), F.col("item")))).alias("items"))
    found = census.select("language", "page_id").join(per, ["language", "page_id"], "left")
    items = F.coalesce("items", F.array().cast("array<string>"))
    return found.select("language", "page_id", F.array_join(items, " ").alias("input"), F.size(items).cast("long").alias("n"), F.col("items").isNotNull().alias("mapped"))


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
