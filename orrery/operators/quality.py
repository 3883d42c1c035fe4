"""Structural quality of wikitext: six features, their normalisers and the score."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from .ranks import quantile

FIELDS = ("sqrt_length", "refs", "headings", "links", "media", "categories")
# Fixed values of the measure: weights and least normalisers of the six features in their order.
WEIGHTS = (0.395, 0.181, 0.123, 0.115, 0.114, 0.07)
MINIMUMS = (100.0, 0.15, 0.1, 0.1, 2.0, 5.0)
MEDIA, CATEGORY = ("File", "Image", "Media"), ("Category",)

# Fixed values of the measure: what counts as a reference, a heading and a link. A link is whatever stands between
# brackets, which aren't part of the find, so that neighbouring links may share them.
_REF_EMPTY = r"(?i)<ref([\s\x1c-\x1f][^/>]*)?/>"
_REF_FULL = r"(?i)<ref([\s\x1c-\x1f][^/>]*)?>[\s\S]*?</ref>"
_HEADING = r"(={2,})(.*?)(={2,})"
_LINK = re.compile(r"(?s)(?<=\[\[).*?(?=\]\])")


def link_counts(media: tuple[str, ...], category: tuple[str, ...]):
    """A pandas UDF: article links, media and categories of a text."""
    media_set, category_set = set(media), set(category)

    def counted(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            n = m = c = 0
            for found in _LINK.finditer(text or ""):
                namespace = found[0].partition(":")[0]
                n, m, c = n + 1, m + (namespace in media_set), c + (namespace in category_set)
            rows.append((n - m - c, m, c))
        return pd.DataFrame(rows, columns=["links", "media", "categories"])

    return pandas_udf(counted, "links long, media long, categories long")


def features(content: DataFrame, media: tuple[str, ...] = MEDIA, category: tuple[str, ...] = CATEGORY, text_col: str = "text") -> DataFrame:
    """Adds bytes, refs, headings, links, media, categories; all null where the text is null."""
    text = F.col(text_col)
    heads = F.size(F.filter(F.regexp_extract_all(text, F.lit(_HEADING), F.lit(1)), lambda left: F.length(left) <= 3)).cast("long")
    has_links = F.when(text.contains("[["), link_counts(media, category)(text)).otherwise(F.when(text.isNotNull(), F.struct(*(F.lit(0).cast("long").alias(k) for k in ("links", "media", "categories")))))
    refs = (F.regexp_count(text, F.lit(_REF_EMPTY)) + F.regexp_count(text, F.lit(_REF_FULL))).cast("long")
    return content.withColumns({"bytes": F.octet_length(text).cast("long"), "refs": refs, "headings": F.when(text.isNotNull(), heads), "found": has_links}).select("*", "found.links", "found.media", "found.categories").drop("found")


def transformed(df: DataFrame) -> DataFrame:
    """Adds x0 to x5, the features relative to the root of the length; ratios are 0 for empty texts."""
    root = F.sqrt(F.col("bytes").cast("double"))
    ratio = lambda c: F.when(root > 0, c / root).when(root == 0, F.lit(0.0))
    values = (root, ratio(F.col("refs")), ratio(F.col("headings")), ratio(F.sqrt(F.col("links").cast("double"))), F.col("media").cast("double"), F.col("categories").cast("double"))
    return df.withColumns({f"x{k}": v for k, v in enumerate(values)})


def normalisers(df: DataFrame, by: tuple[str, ...] = ("language",)) -> DataFrame:
    """The exact 95th percentile of each feature, at least its minimum; a row per edition. No edition's values meet in one task."""
    out = df.select(*by).distinct()
    for k, least in enumerate(MINIMUMS):
        top = quantile(df, list(by), F.col(f"x{k}"), 0.95, f"m{k}")
        out = out.join(F.broadcast(top), list(by), "left").withColumn(f"m{k}", F.greatest(F.lit(least), F.coalesce(f"m{k}", F.lit(least))))
    return out


def score(x: list[Column], m: list[Column]) -> Column:
    """The six weighted terms in their order."""
    total = F.lit(0.0)
    for w, v, top in zip(WEIGHTS, x, m, strict=True):
        total = total + F.lit(w) * F.least(v, top) / top
    return total


def supplement(content: DataFrame, census: DataFrame) -> DataFrame:
    """language, page_id, quality_status, quality_score: one row per page of the census."""
    x = transformed(features(content)).select("language", "page_id", F.col("text").isNotNull().alias("has_text"), *(f"x{k}" for k in range(6)))
    norm = normalisers(x.filter("has_text"))
    joined = census.select("language", "page_id").join(x, ["language", "page_id"], "left").join(F.broadcast(norm), "language", "left")
    status = F.when(F.col("has_text").isNull(), "missing_current_page").when(~F.col("has_text"), "missing_wikitext").otherwise("scored")
    return joined.select("language", "page_id", status.alias("quality_status"), F.when(status == "scored", score([F.col(f"x{k}") for k in range(6)], [F.col(f"m{k}") for k in range(6)])).alias("quality_score"))
