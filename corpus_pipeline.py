"""A training corpus from documents: language ID, near-duplicate removal, decontamination, BPE.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, and
run() writes what a stage returns and reads it again for the next one. A stage decides about rows, never
about ids: these may be null or repeat, and columns may have any names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from orrery.llm import bpe, decontaminate, langid, neardup
from orrery.llm.scratch import written


def _unused(docs: DataFrame, name: str) -> str:
    """A column's name that docs hasn't."""
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def _without(rows: DataFrame, key: str, gone: DataFrame, name: str) -> DataFrame:
    """The rows whose key isn't in the column of gone. gone is written first, so that its size decides how it is joined."""
    return rows.join(written(gone.toDF(key), name), key, "left_anti").drop(key)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in no learned language: null texts, texts without letters, and long texts that cost too many bits in every language."""
    told = langid.identify(docs, carry=docs.columns)
    kept = told.filter((F.col("lang_pred") != langid.UNKNOWN) & ~F.col("foreign"))
    return kept.select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(docs.columns)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of five-word shingle sets that are 0.8 alike: that of the least doc_id, and of the first row among equal ones; null ids come last."""
    key = _unused(docs, "row")
    rows = written(docs.withColumn(key, F.monotonically_increasing_id()), "numbered")
    groups = neardup.near_duplicates(rows, id_col=key, numbered=True).select(F.col("doc_id").alias(key), F.col("component_id").alias("group"))
    ids = written(groups.join(rows.select(key, F.col("doc_id").alias("own_id")), key), "near-groups")
    best = ids.groupBy("group").agg(F.min(F.struct(F.col("own_id").isNull().alias("unknown"), "own_id", key)).alias("m"))
    return _without(rows, key, ids.select(key).join(best.select(F.col(f"m.{key}").alias(key)), key, "left_anti"), "near-duplicates")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a passage of the benchmark. The text alone decides, so its digest is the key."""
    key = _unused(docs, "digest")
    rows = docs.withColumn(key, F.sha2("text", 256))
    found = decontaminate.leaks(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=key)
    return _without(rows, key, found.select("doc_id").distinct(), "leaks")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of the ids and of the text decoded from them.

    Blocks are half the usual size: the executors' heaps have grown in the stages before and leave less to Python.
    """
    return bpe.digests(docs, bpe.vocabulary_of("word_bpe_49k.json"), block_bytes=8 << 20)


STAGES = [("language ID", language_id), ("MinHash near-dedup", near_duplicates), ("benchmark decontamination", decontamination), ("BPE encoding and decoding", encoded)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
