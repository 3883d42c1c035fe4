"""Suggestions as editors see them: valid references, support of candidates, cards, prompts, creators, exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import csv_row
from .serving import PAGE

CODE = r"^[a-z][a-z0-9-]{0,19}\z"
KEYS = ["language", "target_id", "link_id"]


def has_title(title: Column) -> Column:
    """Whether anything but white space stands in it; the separators U+001C to U+001F count as white space."""
    return F.coalesce(title.rlike(r"(?U)[^\s\x1c-\x1f]"), F.lit(False))


def valid_reference(code: Column, own: Column, source_title: Column, target_title: Column) -> Column:
    """Whether evidence from another edition can be shown: a code of an edition that isn't the page's, and two titles."""
    return F.coalesce(code.rlike(CODE) & (code != "all") & (code != own), F.lit(False)) & has_title(source_title) & has_title(target_title)


def titled(evidence: DataFrame, census: DataFrame) -> DataFrame:
    """evidence(language, target_id, link_id, reference, ref_source, ref_target) with the two titles in the other edition."""
    there = lambda page, title: census.select(F.col("language").alias("reference"), F.col("page_id").alias(page), F.col("title").alias(title))
    return evidence.join(there("ref_source", "source_title"), ["reference", "ref_source"]).join(there("ref_target", "target_title"), ["reference", "ref_target"])


def support(evidence: DataFrame, census: DataFrame) -> DataFrame:
    """language, target_id, link_id, references, first_edge of each candidate.

    evidence: as titled() gives it, with position. references: editions that hold valid evidence;
    first_edge: the first valid position, null if there is none or the candidate has no title.
    """
    ok = valid_reference(F.col("reference"), F.col("language"), F.col("source_title"), F.col("target_title"))
    per = evidence.groupBy(*KEYS).agg(F.count_distinct(F.when(ok, F.col("reference"))).alias("references"), F.min(F.when(ok, F.col("position"))).alias("edge"))
    names = census.select("language", F.col("page_id").alias("link_id"), F.col("title").alias("link_title"))
    return per.join(names, ["language", "link_id"], "left").select(*KEYS, "references", F.when(has_title(F.col("link_title")), F.col("edge")).alias("first_edge"))


def prompts(candidates: DataFrame, census: DataFrame, most: int = 5) -> DataFrame:
    """The first candidates of each target: by mention, references, dead end, title, id. candidates(keys, references, dead_end, local_mention)."""
    names = census.select("language", F.col("page_id").alias("link_id"), F.col("title").alias("link_title"))
    rows = candidates.join(names, ["language", "link_id"]).filter(has_title(F.col("link_title")) & (F.col("link_id") != F.col("target_id")))
    order = Window.partitionBy("language", "target_id").orderBy(F.desc(F.coalesce("local_mention", F.lit(False))), F.desc("references"), F.desc("dead_end"), "link_title", "link_id")
    return rows.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most).select(*KEYS, F.col("place").cast("long").alias("place"))


def counted_pages(pages: DataFrame, status: DataFrame) -> DataFrame:
    """pages with candidate_count and candidate_status; pages that weren't compared have neither. status(language, page_id, status, candidates)."""
    own = status.select("language", "page_id", F.col("status").alias("candidate_status"), F.col("candidates").alias("candidate_count"))
    return pages.join(own, ["language", "page_id"], "left")


def cards(shortlist: DataFrame, census: DataFrame, category: DataFrame) -> DataFrame:
    """language, page_id, title, category, links: a card per target with its shortlisted links in order. A shortlist has ten links at most.

    shortlist(keys, rank); category(language, page_id, category), one a page.
    """
    names = census.select("language", "page_id", "title")
    links = shortlist.join(names.toDF("language", "link_id", "link_title"), ["language", "link_id"])
    per = links.groupBy("language", F.col("target_id").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("rank", "link_id", F.col("link_title").alias("title")))).alias("links"))
    return per.join(names, ["language", "page_id"]).join(category, ["language", "page_id"], "left").select("language", "page_id", "title", "category", "links")


def with_topics(edits: DataFrame, topics: DataFrame) -> DataFrame:
    """edits(page_id, ns, ...) with the topics of their pages; pages outside the main namespace, or not observed, have null. topics: one row a page."""
    known = topics.select("page_id", "topic_labels", F.lit(0).alias("ns"))
    return edits.join(known, (edits["page_id"] == known["page_id"]) & (edits["ns"] == known["ns"]), "left").drop(known["page_id"]).drop(known["ns"])


def creator_order(order: str, census_counts: bool) -> tuple[str, bool]:
    """The column and the direction of a listing: "articles" means the census' count, or where only the history counts, its total."""
    column = ("articles" if census_counts else "total") if order.startswith("articles") else "orphans"
    return column, not order.endswith("asc")


def creators(rows: DataFrame, search: str = "", order: str = "orphans-desc", offset: int = 0, census_counts: bool = True) -> tuple[DataFrame, DataFrame]:
    """The count of the creators found, and a page of them. rows(key, articles, total, orphans); unknown counts come last, ties by key."""
    if offset < 0 or offset % PAGE:
        raise ValueError(f"offset must be a multiple of {PAGE}")
    found = rows.filter(F.lower("key").contains(search.lower())) if search else rows
    column, down = creator_order(order, census_counts)
    first = F.col(column).desc_nulls_last() if down else F.col(column).asc_nulls_last()
    return found.agg(F.count("*").alias("total")), found.orderBy(first, "key").offset(offset).limit(PAGE)


def card_filters(pages: DataFrame, group: str = "all", disambiguations: bool = False, redirects: bool = False, unconnected: bool = False, hidden: list[str] | None = None) -> DataFrame:
    """The flags of a listing. pages(orphan, special, redirect, count, category); group: all, orphans, non-orphans."""
    rows = pages
    if group != "all":
        rows = rows.filter(F.col("orphan") == (group == "orphans"))
    for shown, condition in ((disambiguations, ~F.col("special")), (redirects, ~F.col("redirect")), (unconnected, F.col("count") > 0)):
        rows = rows if shown else rows.filter(condition)
    folded = F.coalesce(F.translate(F.trim(F.lower("category")), "_", " "), F.lit(""))
    return rows.filter(~folded.isin(hidden)) if hidden else rows


def topic_filter(pages: DataFrame, wanted: str, missing: str, empty: str) -> DataFrame:
    """Pages one of whose topics contains the text; pages without a prediction, or without a topic, go by the names that stand for these."""
    text = wanted.lower()
    labels, predicted = F.col("topic_labels"), F.coalesce(F.col("topic_status") == "predicted", F.lit(False))
    any_label = F.exists(labels, lambda x: F.replace(F.lower(x), F.lit("."), F.lit(" · ")).contains(text))
    return pages.filter((~predicted & F.lit(text in missing.lower())) | (predicted & (F.coalesce(F.size(labels), F.lit(0)) <= 0) & F.lit(text in empty.lower())) | (predicted & F.coalesce(any_label, F.lit(False))))


def csv_lines(rows: DataFrame, columns: list[str], key: list[str]) -> DataFrame:
    """key, line: the columns as a line of CSV, as Python writes values, ended by CRLF."""

    def plain(v):
        return None if isinstance(v, float) and v != v else v.tolist() if hasattr(v, "tolist") else v

    def run(frames):
        for frame in frames:
            out = frame[key].copy()
            out["line"] = [csv_row(map(plain, values)) for values in zip(*(frame[f"c_{c}"] for c in columns), strict=True)] if len(frame) else []
            yield out

    chosen = rows.select(*key, *(F.col(c).alias(f"c_{c}") for c in columns))
    types = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in key)
    return chosen.mapInPandas(run, f"{types}, line string")


def projections(pages: DataFrame, columns: list[str], size: int = 1024) -> DataFrame:
    """language, shard, and each column as a JSON array, of the pages in order of their ids; a shard has `size` ids at most."""
    rows = pages.withColumn("shard", F.floor(F.col("page_id") / size)).groupBy("language", "shard").agg(F.array_sort(F.collect_list(F.struct("page_id", *(c for c in columns if c != "page_id")))).alias("r"))
    return rows.select("language", "shard", *(F.to_json(F.col("r")[c], {"ignoreNullFields": "false"}).alias(c) for c in columns))


def invalid_seeds(evidence: DataFrame, unique: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows of stored evidence that today's graphs don't bear out: a page, an item or an edge that is gone or has changed. Empty if all may be used again."""
    item = lambda lang, page, name: unique.select(F.col("language").alias(lang), F.col("page_id").alias(page), F.col("item").alias(name))
    edge = edges.select(F.col("language").alias("reference"), F.col("source_id").alias("ref_source"), F.col("target_id").alias("ref_target"), F.lit(True).alias("there"))
    rows = evidence
    for lang, page in (("language", "target_id"), ("language", "link_id"), ("reference", "ref_source"), ("reference", "ref_target")):
        rows = rows.join(item(lang, page, f"item_{page}"), [lang, page], "left")
    rows = rows.join(edge, ["reference", "ref_source", "ref_target"], "left")
    sound = F.col("there") & (F.col("item_target_id") == F.col("item_ref_target")) & (F.col("item_link_id") == F.col("item_ref_source"))
    return rows.filter(~F.coalesce(sound, F.lit(False))).select(*evidence.columns)
