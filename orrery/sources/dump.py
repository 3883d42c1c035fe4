"""Readers of SQL dumps, event logs, page XML, and what surrounds them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

_ESCAPES = {"0": "\0", "n": "\n", "r": "\r", "t": "\t", "b": "\b", "Z": "\x1a"}
_VALUE = re.compile(r"\s*(?:'((?:[^'\\]|\\.)*)'|([^,()'\s]+))\s*", re.S)


def parse_insert(statement: str) -> list[list[str | None]]:
    """The tuples of an INSERT ... VALUES statement; NULL is None. A statement that is cut off, or a scalar that is empty, is an error."""
    at = statement.upper().find("VALUES")
    if at < 0:
        raise ValueError("no VALUES")
    at, rows = at + 6, []
    while True:
        while at < len(statement) and statement[at] in " \t\r\n,":
            at += 1
        if at >= len(statement) or statement[at] == ";":
            return rows
        if statement[at] != "(":
            raise ValueError(f"a tuple is expected at {at}")
        at, row = at + 1, []
        while True:
            m = _VALUE.match(statement, at)
            if not m:
                raise ValueError(f"a value is expected at {at}")
            row.append(re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m[1], flags=re.S) if m[1] is not None else None if m[2] == "NULL" else m[2])
            at = m.end()
            if at >= len(statement):
                raise ValueError("the statement is cut off")
            if statement[at] == ")":
                at += 1
                break
            if statement[at] != ",":
                raise ValueError(f"a comma is expected at {at}")
            at += 1
        rows.append(row)


def read_dump(spark: SparkSession, path: str, table: str, columns: list[str]) -> DataFrame:
    """The columns of a table's INSERT statements, as strings; each statement is a line, and lines are dealt out."""
    lines = spark.read.text(path).filter(F.col("value").startswith(f"INSERT INTO `{table}`"))
    wide = spark.read.text(path).filter(F.col("value").rlike(r"^  `"))  # the columns of CREATE TABLE, in order
    names = [re.match(r"\s*`([^`]+)`", r.value)[1] for r in wide.collect()]
    missing = set(columns) - set(names)
    if missing:
        raise ValueError(f"{table} has no columns {sorted(missing)}")
    places = [names.index(c) for c in columns]

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [[row[p] for p in places] for line in batch["value"] for row in parse_insert(line)]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return lines.mapInPandas(parsed, ", ".join(f"`{c}` string" for c in columns))


def titles(column):
    """Underscores as spaces; a replacement character is an error."""
    return F.when(column.contains("�"), F.raise_error(F.lit("a title is not UTF-8"))).otherwise(F.translate(column, "_", " "))


def raw_graph(page: DataFrame, pagelinks: DataFrame, linktarget: DataFrame, redirect: DataFrame, props: DataFrame, categorylinks: DataFrame, language: str) -> dict[str, DataFrame]:
    """The census, its links, redirects, categories and the categories' parents, of the dump tables as read."""
    pages = page.select(F.col("page_id").cast("long"), F.col("page_namespace").cast("int").alias("ns"), titles(F.col("page_title")).alias("title"), (F.col("page_is_redirect") == "1").alias("is_redirect"), F.col("page_len").cast("double").alias("length_bytes"), F.col("page_latest").cast("long").alias("revision_id"))
    target = linktarget.select(F.col("lt_id").alias("id"), F.col("lt_namespace").cast("int").alias("target_ns"), titles(F.col("lt_title")).alias("target_title"))
    props = props.filter("pp_propname IN ('wikibase_item', 'hiddencat', 'disambiguation')")
    item = props.filter("pp_propname = 'wikibase_item'").groupBy(F.col("pp_page").cast("long").alias("page_id")).agg(F.max("pp_value").alias("item"))
    hidden = props.filter("pp_propname = 'hiddencat'").select(F.col("pp_page").cast("long").alias("page_id")).distinct()
    census = pages.filter("ns = 0 AND NOT is_redirect").join(item, "page_id", "left")
    valid = F.when(F.col("item").rlike(r"^Q[1-9][0-9]*\z"), F.col("item"))
    named = lambda df: df.withColumn("language", F.lit(language))
    links = pagelinks.filter("pl_from_namespace = '0'").select(F.col("pl_from").cast("long").alias("page_id"), F.col("pl_target_id").alias("id")).join(target.filter("target_ns = 0"), "id").join(census.select("page_id"), "page_id", "left_semi")
    hidden_titles = pages.filter("ns = 14").join(hidden, "page_id", "left_semi").select(F.col("title").alias("category"))
    own = categorylinks.columns
    labelled = categorylinks.withColumn("id", F.col("cl_target_id") if "cl_target_id" in own else F.lit(None).cast("string")).withColumn("cl_label", F.translate("cl_to", "_", " ") if "cl_to" in own else F.lit(None).cast("string"))
    category = labelled.select(F.col("cl_from").cast("long").alias("page_id"), "id", "cl_label").join(target, "id", "left").filter("target_ns = 14 OR cl_label IS NOT NULL").select("page_id", F.coalesce("target_title", "cl_label").alias("category")).join(hidden_titles, "category", "left_anti")
    parents = category.join(pages.filter("ns = 14").select("page_id", "title"), "page_id").select(F.col("title").alias("category"), F.col("category").alias("parent"))
    moved = redirect.filter("rd_namespace = '0' AND coalesce(rd_interwiki, '') = ''").select(F.col("rd_from").cast("long").alias("page_id"), titles(F.col("rd_title")).alias("target")).join(pages.filter("ns = 0 AND is_redirect"), "page_id").select("title", "target")
    return {
        "census": named(census.withColumn("item", valid)), "links": named(links.select(F.col("page_id").alias("source_id"), "target_title")), "redirects": named(moved),
        "categories": named(category.join(census.select("page_id"), "page_id", "left_semi")), "parents": named(parents),
    }


EVENT_FIELDS = {"entity": 2, "event_type": 3, "at": 4, "user_id": 6, "groups": 12, "registered": 23, "page_id": 28, "ns": 31, "ns_now": 33, "created": 37, "first_edit": 38, "revision_id": 60, "parent_id": 61, "deleted": 63, "before": 76, "tags": 77}
N_EVENT_FIELDS = 78


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """The used fields of an event log, as strings; a row of other than 78 fields is an error."""
    fields = F.split("value", "\t", -1)
    rows = spark.read.text(path).select(F.when(F.size(fields) != N_EVENT_FIELDS, F.raise_error(F.lit("a row has not 78 fields"))).otherwise(fields).alias("f"))
    return rows.select(*(F.col("f")[k].alias(n) for n, k in EVENT_FIELDS.items())).withColumn("ns", F.coalesce(F.nullif("ns", F.lit("")), F.nullif("ns_now", F.lit("")))).drop("ns_now")


CONTENT = """id LONG, ns INT, redirect STRUCT<_title: STRING>, revision STRUCT<id: LONG, model: STRING, text: STRUCT<_VALUE: STRING, _deleted: STRING>,
  slots: STRUCT<slot: ARRAY<STRUCT<_role: STRING, model: STRING, text: STRUCT<_VALUE: STRING, _deleted: STRING>>>>>"""


def read_content(spark: SparkSession, path: str) -> DataFrame:
    """page_id, revision_id, text of the articles of a page XML; text is null if absent, deleted or no wikitext, and empty if known to be."""
    rows = spark.read.format("xml").option("rowTag", "page").option("ignoreSurroundingSpaces", "false").schema(CONTENT).load(path).filter("ns = 0 AND redirect IS NULL")
    slot = F.get(F.filter("revision.slots.slot", lambda s: s["_role"] == "main"), F.lit(0))
    text, model = F.coalesce(slot["text"], F.col("revision.text")), F.coalesce(slot["model"], F.col("revision.model"), F.lit("wikitext"))
    known = text.isNotNull() & text["_deleted"].isNull() & (model == "wikitext")
    return rows.select(F.col("id").alias("page_id"), F.col("revision.id").alias("revision_id"), F.when(known, F.coalesce(text["_VALUE"], F.lit(""))).alias("text"))


def anchors(html):
    """The href of each anchor, in order, in quotes of either kind or in none; quotes may hold >."""
    value = r"""("[^"]*"|'[^']*'|[^\s"'>]+)"""
    found = F.regexp_extract_all(html, F.lit(rf"""(?i)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?href\s*=\s*{value}"""), F.lit(1))
    return F.transform(found, lambda x: F.when(F.substring(x, 1, 1).isin('"', "'"), F.substring(x, F.lit(2), F.length(x) - 2)).otherwise(x))


def history_partitions(names: list[str]) -> list[str]:
    """all-time alone, or years and months that leave no gap and don't overlap; in order."""
    if names == ["all-time"]:
        return names
    covered: dict[int, str] = {}
    for name in names:
        if re.fullmatch(r"\d{4}", name):
            months = range(int(name) * 12, int(name) * 12 + 12)
        elif (m := re.fullmatch(r"(\d{4})-(\d{2})", name)) and 1 <= int(m[2]) <= 12:
            months = range(int(m[1]) * 12 + int(m[2]) - 1, int(m[1]) * 12 + int(m[2]))
        else:
            raise ValueError(f"no partition: {name}")
        for k in months:
            if k in covered:
                raise ValueError(f"{name} overlaps {covered[k]}")
            covered[k] = name
    if not covered or max(covered) - min(covered) + 1 != len(covered):
        raise ValueError("partitions leave a gap")
    return sorted(set(names), key=lambda n: min(k for k, v in covered.items() if v == n))


def wiki_database(language: str, database: str | None = None) -> str:
    if not re.fullmatch(r"[a-z][a-z0-9-]{0,19}", language) or language == "all":
        raise ValueError(f"no language: {language}")
    name = database or language.replace("-", "_") + "wiki"
    if not (5 <= len(name) <= 45 and name.endswith("wiki")):
        raise ValueError(f"no database: {name}")
    return name


def select_languages(pool: list[str], wanted: list[str]) -> list[str]:
    """The wanted languages in the order of the pool; one that isn't there is an error."""
    if unknown := set(wanted) - set(pool):
        raise ValueError(f"not in the pool: {sorted(unknown)}")
    return [x for x in pool if x in set(wanted)]
