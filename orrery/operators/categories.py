"""Representative categories by structural specificity."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, Window, functions as F

from ..session import hold

def check_rules(patterns: tuple[str, ...], priority: dict[str, float], min_support: float) -> None:
    if not (math.isfinite(min_support) and min_support > 0):
        raise ValueError("min_support must be a positive number")
    if not all(math.isfinite(v) for v in priority.values()):
        raise ValueError("priorities must be finite")
    for p in patterns:
        re.compile(p)


def support(page_category: DataFrame) -> DataFrame:
    """Distinct pages of each category, before any exclusion."""
    return page_category.groupBy("language", "category").agg(F.count_distinct("page_id").alias("support"))


def candidates(page_category: DataFrame, patterns: tuple[str, ...] = (), excluded: tuple[str, ...] = ()) -> DataFrame:
    rows = page_category.select("language", "page_id", "category").distinct()
    if patterns:
        rows = rows.filter(~F.col("category").rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns)))
    return rows.filter(~F.col("category").isin(list(excluded))) if excluded else rows


def visible(page_category: DataFrame, hidden: DataFrame) -> DataFrame:
    """The rows whose category isn't hidden in its edition. hidden(language, category) may repeat rows; null categories stay."""
    return page_category.join(hidden, ["language", "category"], "left_anti")


def label_text(page_category: DataFrame) -> DataFrame:
    """language, page_id, labels: the page's distinct categories in binary order, joined by a middle dot; null ones are left out."""
    labels = F.array_join(F.array_sort(F.collect_set("category")), " · ")
    return page_category.groupBy("language", "page_id").agg(labels.alias("labels"))


def ancestors(parent: DataFrame, max_depth: int = 64) -> DataFrame:
    """language, category, ancestor of the hierarchy, cycles included; breadth first, each pair once. The frontier joins the parents and leaves out what is seen."""
    step = parent.select("language", F.col("category").alias("ancestor"), F.col("parent").alias("next"))
    seen = hold(parent.select("language", "category", F.col("parent").alias("ancestor")).distinct())
    frontier = seen
    for _ in range(max_depth):
        reached = frontier.join(step, ["language", "ancestor"]).select("language", "category", F.col("next").alias("ancestor")).distinct()
        frontier = hold(reached.join(seen, ["language", "category", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            return seen
        seen = hold(seen.union(frontier))
    raise ValueError(f"the hierarchy is deeper than {max_depth}")


def narrowest(candidate: DataFrame, closure: DataFrame) -> DataFrame:
    """Without the categories that are ancestors of another of the page's, unless each is the other's ancestor."""
    c, d = candidate, candidate.withColumnRenamed("category", "other")
    above = closure.select("language", F.col("category").alias("other"), F.col("ancestor").alias("category"))
    below = closure.select("language", "category", F.col("ancestor").alias("other"))
    broader = c.join(d, ["language", "page_id"]).filter("category <> other").join(above, ["language", "other", "category"], "left_semi").join(below, ["language", "category", "other"], "left_anti")
    return c.join(broader.select("language", "page_id", "category").distinct(), ["language", "page_id", "category"], "left_anti")


def ranked(page_category: DataFrame, census: DataFrame, closure: DataFrame, patterns=(), excluded=(), priority: dict[str, float] | None = None, min_support: float = 5) -> DataFrame:
    """language, page_id, category, support, score, priority, rank of each page's remaining categories."""
    check_rules(patterns, priority or {}, min_support)
    n = census.groupBy("language").agg(F.count("*").alias("n"))
    first = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in priority.items() for x in kv]), F.col("category")), F.lit(0.0)) if priority else F.lit(0.0)
    left = narrowest(candidates(page_category, patterns, excluded), closure).join(support(page_category), ["language", "category"]).join(F.broadcast(n), "language")
    raw = F.log((F.col("n") + 1) / (F.col("support") + 1)) * F.least(F.col("support") / F.lit(float(min_support)), F.lit(1.0))
    scored = left.select("language", "page_id", "category", "support", (F.rint(raw * 1e6) / 1e6).alias("score"), first.alias("priority"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("language", "page_id").orderBy(F.desc("priority"), F.desc("score"), "category")))


def choices(rank: DataFrame, census: DataFrame, overrides: DataFrame | None = None, page_category: DataFrame | None = None) -> DataFrame:
    """language, page_id, choice, manual. overrides(language, page_id, category), one a page; a category that page_category doesn't give the page is an error."""
    top = rank.filter("rank = 1").select("language", "page_id", F.col("category").alias("choice"))
    rows = census.select("language", "page_id").join(top, ["language", "page_id"], "left")
    if overrides is None:
        return rows.withColumn("manual", F.lit(False))
    owned = page_category.select("language", "page_id", "category", F.lit(True).alias("owned")).distinct()
    named = overrides.join(owned, ["language", "page_id", "category"], "left").withColumnRenamed("category", "named")
    both = rows.join(named, ["language", "page_id"], "left")
    checked = F.when(F.col("named").isNotNull() & F.col("owned").isNull(), F.raise_error(F.concat(F.lit("an override names a category that the page hasn't: "), F.col("named")))).otherwise(F.col("named"))
    return both.select("language", "page_id", F.coalesce(checked.cast("string"), "choice").alias("choice"), F.col("named").isNotNull().alias("manual"))
