"""Queries of a published collection: filters, orders, pages of rows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

PAGE, CARD_PAGE = 25, 16
_ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
SORTS = ("title", "category", "length", "age", "quality", "count", "in_degree", "out_degree", "topic", "personal")


def folded(label: Column) -> Column:
    """Lower case without the usual accents and combining marks, _ and runs of white space as one space."""
    plain = F.regexp_replace(F.translate(F.lower(label), *_ACCENTS), r"\p{M}", "")
    return F.trim(F.regexp_replace(F.translate(plain, "_", " "), r"\s+", " "))


@dataclass
class PageQuery:
    """A request. hidden: category labels left out; closed: (target, source) pairs that are done."""

    kind: str = "articles"
    language: str | None = None
    orphans_only: bool = False
    search: str = ""
    hidden: list[str] = field(default_factory=list)
    label: str = ""
    sort: str = "title"
    descending: bool = False
    offset: int = 0
    with_candidates: bool = False
    all_open: bool = False
    weights: dict[str, float] = field(default_factory=dict)

    @property
    def page(self) -> int:
        return CARD_PAGE if self.kind == "cards" else PAGE

    def check(self) -> None:
        if self.kind not in ("articles", "cards") or self.sort not in SORTS:
            raise ValueError("unknown kind or sort")
        if self.offset < 0 or self.offset % self.page:
            raise ValueError(f"offset must be a multiple of {self.page}")
        if len(self.hidden) > 128 or len(self.search.encode()) > 2048 or len(self.label.encode()) > 2048:
            raise ValueError("too many or too long values")


def filtered(pages: DataFrame, q: PageQuery, closed: DataFrame | None = None, shortlist: DataFrame | None = None) -> DataFrame:
    """pages(language, page_id, title, category, topic_labels, orphan, count, ...); closed and shortlist(language, target_id, link_id)."""
    q.check()
    rows = pages.withColumn("title_fold", F.lower("title"))
    if q.language:
        rows = rows.filter(F.col("language") == q.language)
    if q.orphans_only or q.kind == "cards":
        rows = rows.filter("orphan")
    if q.search:
        rows = rows.filter(F.col("title_fold").contains(q.search.lower()))
    if q.hidden:
        rows = rows.filter(F.col("category").isNull() | ~F.col("category").isin(q.hidden))
    if q.label:
        rows = rows.filter(F.exists("topic_labels", lambda x: F.lower(x).contains(q.label.lower())))
    if q.with_candidates:
        rows = rows.filter("count > 0")
    if q.all_open and closed is not None and shortlist is not None:  # relational division: targets all of whose pairs are closed go
        keys = ["language", "target_id", "link_id"]
        done = shortlist.select(*keys).join(closed.select(*keys).distinct().withColumn("done", F.lit(True)), keys, "left").groupBy("language", F.col("target_id").alias("page_id")).agg(F.bool_and(F.coalesce("done", F.lit(False))).alias("all_done"))
        rows = rows.join(done.filter("all_done"), ["language", "page_id"], "left_anti")
    return rows


def ordered(rows: DataFrame, q: PageQuery) -> DataFrame:
    """Unknown values last in either direction; then by title, id and edition."""
    ties = ["title_fold", "title", "page_id", "language"]
    if q.sort == "personal":
        weight = F.create_map(*[F.lit(x) for kv in q.weights.items() for x in kv]) if q.weights else None
        score = F.aggregate(F.coalesce("topic_labels", F.array().cast("array<string>")), F.lit(0.0), lambda a, x: a + F.coalesce(F.try_element_at(weight, x), F.lit(0.0))) if weight is not None else F.lit(0.0)
        return rows.withColumn("personal", score).orderBy(F.desc("personal"), F.desc(F.coalesce("count", F.lit(0))), *ties)
    key = {"title": "title_fold"}.get(q.sort, q.sort)
    return rows.orderBy(F.col(key).desc_nulls_last() if q.descending else F.col(key).asc_nulls_last(), *ties)


def run(pages: DataFrame, q: PageQuery, closed: DataFrame | None = None, shortlist: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The count of all matches, as a row, and the page of them that is asked for."""
    rows = filtered(pages, q, closed, shortlist)
    return rows.agg(F.count("*").alias("total")), ordered(rows, q).offset(q.offset).limit(q.page)
