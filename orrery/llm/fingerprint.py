"""Canonical exact digests with DataFrame functions only.

The canonical text is the compatibility composition (NFKC) in lower case, with each run of white
space as one space and none at the ends. Its fingerprint is two 64-bit xxHash values, the second
seeded by a constant's hash, as 32 hexadecimal digits. Documents of one fingerprint are a bucket; the
least and the greatest canonical text of a bucket are compared byte by byte, and a bucket of
different texts is told apart by the texts themselves. Buckets are aggregated before the shuffle,
so copies meet as one row per task.

Likeness of exact digests is 1.0 for equal fingerprints of equal canonical bytes, else 0.0.

Defined results: null texts are the empty text, which has a fingerprint like any other. Null doc_ids
come last in descending order. Rows of one doc_id are ordered by their texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import written
from .skew import lookup

BUCKET_ROWS, MAX_BUCKETS = 4000, 4096


def canonical(text: Column) -> Column:
    """Evaluate it in a select of its own: Spark calls the composition anew for each use within one."""
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.trim(F.regexp_replace(F.lower(composed), r"(?U)\s+", " "))


def hashed(canon: Column) -> Column:
    wide = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(canon), F.xxhash64(F.lit(1), canon))]
    return F.concat(*wide)


def _printed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    canon = docs.select(docs[id_col].alias("doc_id"), canonical(F.coalesce(docs[text_col], F.lit(""))).alias("canon"))
    return canon.select("doc_id", "canon", hashed(F.col("canon")).alias("fingerprint"))


def _groups(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """doc_id, fingerprint of each row; the buckets of one text; the buckets of several; and those by their texts.

    Only texts of buckets of two documents or more are compared; a table of those buckets is written,
    and Spark broadcasts it if its size is within its own threshold.
    """
    printed = _printed(docs, id_col, text_col)
    prints = written(printed.select("doc_id", "fingerprint"), "fingerprints")
    buckets = written(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies")), "fingerprint-buckets")
    shared = written(buckets.filter("n_copies > 1").select("fingerprint"), "fingerprint-shared")
    texts = printed.join(shared, "fingerprint").groupBy("fingerprint").agg(F.min("canon").alias("low"), F.max("canon").alias("high"))
    clashing = written(texts.filter("low <> high").select("fingerprint"), "fingerprint-clashes")
    apart = printed.join(clashing, "fingerprint").groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("n_copies"))
    return prints, buckets.join(clashing, "fingerprint", "left_anti"), clashing, apart


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint, group_id, n_copies of every document; documents of one group have the same canonical text."""
    prints, alike, clashing, apart = _groups(docs, id_col, text_col)
    columns = ["doc_id", "fingerprint", "group_id", "n_copies"]
    usual = lookup(prints, alike, "fingerprint").select(*columns)
    if clashing.isEmpty():
        return usual
    return usual.union(_printed(docs, id_col, text_col).join(clashing, "fingerprint").join(apart, ["fingerprint", "canon"]).select(*columns))


def edited_with_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The columns of edited_digests(), group_id and n_copies of every document: each row gets the group of its own fingerprint, whatever its id."""
    _, alike, clashing, apart = _groups(docs, id_col, text_col)
    digests = edited_digests(docs, id_col, text_col, with_canon=True)
    columns = [c for c in digests.columns if c != "canon"]
    usual = lookup(written(digests.drop("canon"), "fingerprint-digests"), alike, "fingerprint").select(*columns, "group_id", "n_copies")
    if clashing.isEmpty():
        return usual
    return usual.union(digests.join(clashing, "fingerprint").join(apart, ["fingerprint", "canon"]).select(*columns, "group_id", "n_copies"))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, next_text: the document that follows in descending order of ids, the first after the last.

    Ids are cut into ranges of about BUCKET_ROWS rows, at most MAX_BUCKETS; the first row of the range
    below stands at the end of each range as well, so one window over the ranges finds every neighbour.
    """
    rows = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    n = docs.count()
    n_buckets = min(MAX_BUCKETS, max(1, math.ceil(n / BUCKET_ROWS)))
    cuts = rows.agg(F.percentile_approx("doc_id", [k / n_buckets for k in range(1, n_buckets)], 10_000)).first()[0] if n_buckets > 1 else []
    cuts = sorted(set(cuts or []))
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)
    ranged = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), -1).otherwise(above))
    tops = ranged.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()  # MAX_BUCKETS + 1 rows at most
    order = sorted((r.bucket for r in tops), reverse=True)
    spark, top = docs.sparkSession, {r.bucket: r.top for r in tops}
    below = [(b, order[(k + 1) % len(order)]) for k, b in enumerate(order)]
    named = spark.createDataFrame([(b, c, top[c]) for b, c in below], "to_bucket int, from_bucket int, top long") if below else None
    if named is None:
        return rows.withColumn("next_text", F.col("text"))
    firsts = ranged.join(F.broadcast(named), (F.col("bucket") == F.col("from_bucket")) & F.col("doc_id").eqNullSafe(F.col("top")))
    firsts = firsts.groupBy("to_bucket", "top").agg(F.min("text").alias("text")).select(F.col("top").alias("doc_id"), "text", F.col("to_bucket").alias("bucket"), F.lit(True).alias("copy"))
    whole = ranged.withColumn("copy", F.lit(False)).unionByName(firsts)
    down = Window.partitionBy("bucket").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    return whole.withColumn("next_text", F.lead("text").over(down)).filter("NOT copy").select("doc_id", "text", "next_text")


def edited_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_canon: bool = False) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document.

    The edited text has the last third of its code points replaced by the first as many of the next document.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    keep, third = F.col("n_chars") - F.floor(F.col("n_chars") / 3), F.floor(F.col("n_chars") / 3)
    edited = F.concat(F.substring(F.col("text"), F.lit(1), keep.cast("int")), F.substring(F.col("next_text"), F.lit(1), third.cast("int")))
    rows = rows.select("doc_id", "n_chars", "text", "next_text", edited.alias("edited"))
    rows = rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), canonical(F.col("text")).alias("canon"), canonical(F.col("edited")).alias("canon_edited"), canonical(F.col("next_text")).alias("canon_next"))
    like = lambda other: (F.col("canon") == F.col(other)).cast("double")
    return rows.select(*["canon"] * with_canon, "doc_id", "n_chars", "edited_sha256", hashed(F.col("canon")).alias("fingerprint"), hashed(F.col("canon_edited")).alias("edited_fingerprint"), like("canon_edited").alias("near_edited"), like("canon_next").alias("near_next"))
