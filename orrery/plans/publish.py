"""Publication of tables: staging, checks, one pointer that is swapped; fingerprints; reviews with versions."""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

CHECKPOINT_REASONS = ("missing_checkpoint", "source_mismatch", "missing_output", "output_mismatch", "definition_mismatch", "stage_table_mismatch", "verified_reuse")


def canonical_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=True)


def canonical_sha256(value) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def fingerprint(df: DataFrame) -> DataFrame:
    """n, total: of a table's rows in any order, repeated rows included; total sums the four 48-bit parts of each row's SHA-256.

    A row is the JSON list of its values as text, in order of the columns' names, with null apart from any text.
    """
    text = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.cast("string").alias("v"))), '(?s)^.{5}(.*).$', 1), F.lit(""))
    values = [F.when(df[c].isNull(), F.lit("null")).otherwise(text(df[c])) for c in sorted(df.columns)]
    h = F.sha2(F.concat(F.lit("["), F.concat_ws(",", *values), F.lit("]")), 256)
    parts = [F.sum(F.conv(F.substring(h, 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)")).cast("string") for k in range(4)]
    return df.agg(F.count("*").alias("n"), F.concat_ws("-", *parts).alias("total"))


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm


def _numbered(fs, folder) -> list[int]:
    if not fs.exists(folder):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    return sorted(int(n) for n in names if n.isdecimal())


def write_next(spark: SparkSession, path: str, text: str) -> int:
    """Writes text as the next numbered file of the folder path, and returns its number.

    A file gets its number by one rename when it is whole, so a reader finds the old or the new text,
    whenever the writer stops. Two writers at once: one gets the number, the other an error.
    """
    fs, folder, jvm = _fs(spark, path)
    fs.mkdirs(folder)
    staged = jvm.org.apache.hadoop.fs.Path(folder, f"_{uuid.uuid4().hex}")
    out = fs.create(staged)
    out.write(bytearray(text.encode()))
    out.close()
    number = max(_numbered(fs, folder), default=0) + 1
    target = jvm.org.apache.hadoop.fs.Path(folder, str(number))
    if fs.exists(target) or not fs.rename(staged, target):
        fs.delete(staged, False)
        raise RuntimeError(f"{target.toString()} is another writer's")
    return number


def read_last(spark: SparkSession, path: str) -> str | None:
    fs, folder, _ = _fs(spark, path)
    found = _numbered(fs, folder)
    return "\n".join(r.value for r in spark.read.text(f"{path}/{found[-1]}").collect()) if found else None


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], checks: dict[str, DataFrame] | None = None, partition_by: str = "language") -> dict:
    """Writes the tables to a new version, requires each check to be empty, then swaps the pointer; returns the manifest."""
    version = uuid.uuid4().hex
    manifest = {"version": version, "tables": {}}
    for name, df in sorted(tables.items()):
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(partition_by) if partition_by in df.columns else writer).parquet(f"{root}/{version}/{name}")
        manifest["tables"][name] = fingerprint(spark.read.parquet(f"{root}/{version}/{name}")).first().asDict()
    for name, bad in (checks or {}).items():
        if not bad.isEmpty():
            raise ValueError(f"not published: {name}")
    manifest["sha256"] = canonical_sha256(manifest["tables"])
    write_next(spark, f"{root}/current", canonical_json(manifest))
    return manifest


def current(spark: SparkSession, root: str) -> dict | None:
    text = read_last(spark, f"{root}/current")
    return json.loads(text) if text else None


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{current(spark, root)['version']}/{name}")


def reuse(checkpoint: dict | None, sources: str, definition: str, output: str | None) -> str:
    """Whether a stage's output may be used again, and if not, why."""
    if checkpoint is None:
        return "missing_checkpoint"
    if checkpoint.get("sources") != sources:
        return "source_mismatch"
    if checkpoint.get("definition") != definition:
        return "definition_mismatch"
    if output is None:
        return "missing_output"
    return "verified_reuse" if checkpoint.get("output") == output else "output_mismatch"


def stale_pairs(old: dict[str, str], new: dict[str, str]) -> tuple[list[tuple[str, str]], list[str]]:
    """Ordered pairs (language, reference) to compute anew, and editions that are gone; both dicts: identity by language."""
    dirty = {k for k, v in new.items() if old.get(k) != v}
    return sorted((a, b) for a in new for b in new if a != b and (a in dirty or b in dirty)), sorted(set(old) - set(new))


def upsert_review(reviews: dict[tuple, dict], key: tuple, status: str, version: int) -> dict:
    """Compare and swap on the version; a new review starts at version 0."""
    row = reviews.setdefault(key, {"status": "open", "version": 0})
    if row["version"] != version:
        raise ValueError("409: the review has changed")
    row |= {"status": status, "version": version + 1}
    return row


def bench_verdict(pairs: list[tuple[float, float]], rss: list[tuple[float, float]], least: float = 1.10) -> str:
    """passed: three pairs or more, each faster, median speed-up and memory within bounds."""
    if len(pairs) < 3:
        return "inconclusive"
    ups, mem = sorted(a / b for a, b in pairs), sorted(b / a for a, b in rss)
    mid = lambda v: v[len(v) // 2] if len(v) % 2 else v[len(v) // 2 - 1] / 2 + v[len(v) // 2] / 2
    return "passed" if mid(ups) >= least and ups[0] > 1 and mid(mem) <= 1.10 else "no_improvement"
