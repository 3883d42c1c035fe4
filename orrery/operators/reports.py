"""Orphans against the rest: overview, counts, feature profiles, histograms, interests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .observations import measured
from .ranks import counted, quantile, ranked


def percent(n: Column, d: Column) -> Column:
    return F.when(d > 0, F.lit(100.0) * n / d)


def overview(rows: DataFrame) -> DataFrame:
    """Per edition: rows(language, orphan, out_degree, creator_key)."""
    orphans = F.count_if("orphan")
    return rows.groupBy("language").agg(
        F.count("*").alias("total"), orphans.alias("orphans"), percent(orphans, F.count("*")).alias("percent"), F.count_if(F.col("out_degree") == 0).alias("dead_ends"),
        F.count_if(F.col("orphan") & F.col("creator_key").isNotNull()).alias("attributed_orphans"), F.count_if(F.col("creator_key").isNull()).alias("missing_creators"),
        F.count_distinct(F.when(F.col("orphan"), F.col("creator_key"))).alias("orphan_creators"),
    )


def overall(rows: DataFrame) -> DataFrame:
    """The overview of all editions as one; a creator's key counts once in each edition. rows as for overview()."""
    scoped = F.concat_ws(":", "language", "creator_key")
    return overview(rows.withColumns({"creator_key": F.when(F.col("creator_key").isNotNull(), scoped), "language": F.lit("all")}))


def label_counts(rows: DataFrame, label: str) -> DataFrame:
    """label, total, orphans, percent; most orphans first, then by label."""
    n = F.count_if("orphan")
    return rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("total"), n.alias("orphans"), percent(n, F.count("*")).alias("percent")).orderBy(F.desc("orphans"), "label")


def creators(rows: DataFrame) -> DataFrame:
    """key, total, orphans, percent, languages (sorted), first_type: of the least position. rows(key, orphan, language, type, position)."""
    n = F.count_if("orphan")
    return rows.groupBy("key").agg(F.count("*").alias("total"), n.alias("orphans"), percent(n, F.count("*")).alias("percent"), F.array_join(F.array_sort(F.collect_set("language")), ",").alias("languages"), F.min_by("type", "position").alias("first_type"))


def bot_groups(rows: DataFrame) -> DataFrame:
    """bot_group (0 bot, 1 not, 2 unknown), total, orphans: always three rows. rows(bot, orphan)."""
    group = F.when(F.col("bot"), 0).when(~F.col("bot"), 1).otherwise(2)
    found = rows.groupBy(group.alias("bot_group")).agg(F.count("*").alias("t"), F.count_if("orphan").alias("o"))
    three = rows.sparkSession.range(3).select(F.col("id").cast("int").alias("bot_group"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return three.join(found, "bot_group", "left").select("bot_group", zero(F.col("t")).alias("total"), zero(F.col("o")).alias("orphans"))


def group_labels(rows: DataFrame) -> DataFrame:
    """Each distinct label of a page's groups counts once; __missing__ stands for none. rows(groups, orphan)."""
    labels = F.when(F.size("groups") > 0, F.array_distinct("groups")).otherwise(F.array(F.lit("__missing__")))
    return label_counts(rows.select("orphan", F.explode(labels).alias("label")), "label")


def features(rows: DataFrame, labels: list[tuple[str, Column]]) -> DataFrame:
    """label, orphan, count, known, total, percent of tri-state columns, for both groups. One pass: the labels are unpivoted after the sums."""
    sums = [F.count_if(c).alias(f"c{k}") for k, (_, c) in enumerate(labels)] + [F.count_if(c.isNotNull()).alias(f"k{k}") for k, (_, c) in enumerate(labels)]
    per = rows.groupBy("orphan").agg(F.count("*").alias("total"), *sums)
    both = rows.sparkSession.createDataFrame([(True,), (False,)], "orphan boolean").join(per, "orphan", "left")
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("label"), F.coalesce(f"c{k}", F.lit(0)).alias("count"), F.coalesce(f"k{k}", F.lit(0)).alias("known")) for k, (name, _) in enumerate(labels))))
    spread = both.select("orphan", F.coalesce("total", F.lit(0)).alias("total"), each.alias("e"))
    return spread.select("e.label", "orphan", "e.count", "e.known", "total", percent(F.col("e.count"), F.col("e.known")).alias("percent"))


def thresholds(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The exact median of each measure per edition."""
    out = rows.select("language").distinct()
    for c in columns:
        out = out.join(F.broadcast(quantile(rows, ["language"], measured(F.col(c)), 0.5, f"{c}_median")), "language", "left")
    return out


def _below(parent: str):
    return lambda label: label.startswith(f"{parent}.")


def profiles(rows: DataFrame, topics: list[str], parents: list[str]) -> DataFrame:
    """kind, label, orphan, count, known, total, percent. rows(language, orphan, topic_labels or null, age, length, quality).

    Topics and their parents (any topic of the prefix) are known where topic_labels isn't null; the six
    others split each edition at its own medians: new, short and low are below, high is from it on.
    """
    usable = rows.withColumn("quality", F.when(F.col("quality") <= 0.998001, F.col("quality")))
    split = usable.join(F.broadcast(thresholds(usable, ["age", "length", "quality"])), "language")
    below = {c: measured(F.col(c)) < F.col(f"{c}_median") for c in ("age", "length", "quality")}
    kinds = {
        "topic": [(t, F.array_contains("topic_labels", t)) for t in topics],
        "macrotheme": [(p, F.exists("topic_labels", _below(p))) for p in parents],
        "feature": [("new", below["age"]), ("old", ~below["age"]), ("quality_high", ~below["quality"]), ("quality_low", below["quality"]), ("short", below["length"]), ("long", ~below["length"])],
    }
    told = features(split, [(f"{kind}/{name}", known) for kind, labels in kinds.items() for name, known in labels])
    part = lambda k: F.regexp_extract("label", "^([^/]*)/(.*)$", k)
    return told.select(part(1).alias("kind"), part(2).alias("label"), *(c for c in told.columns if c != "label"))


def order_statistics(rows: DataFrame) -> DataFrame:
    """lower, upper: values at ranks floor(.02 (n - 1)) and ceil(.98 (n - 1)) of all known values; found on counts of distinct values."""
    values = rows.select(measured(F.col("value")).alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    bounds = values.agg(F.sum("n").alias("n")).select("n", F.floor((F.col("n") - 1) * 0.02).alias("low"), F.ceil((F.col("n") - 1) * 0.98).alias("high"))
    return ranked(values, []).join(F.broadcast(bounds.select("low", "high"))).agg(F.max(F.when((F.col("first") <= F.col("low")) & (F.col("low") <= F.col("last")), F.col("value"))).alias("lower"), F.max(F.when((F.col("first") <= F.col("high")) & (F.col("high") <= F.col("last")), F.col("value"))).alias("upper"))


def axis(v: Column, kind: str) -> Column:
    return {"log": F.log1p(v), "age": v / 365.25, "plain": v}[kind]


def histogram(rows: DataFrame, kind: str = "plain") -> DataFrame:
    """orphan, bin, count, percent: 20 bins of rows(orphan, value); 0 and 19 are the tails beyond the order statistics, percentages are of all pages of the group."""
    v = measured(F.col("value"))
    known = rows.select("orphan", v.alias("value"))
    tails = order_statistics(rows)
    width = axis(F.col("upper"), kind) - axis(F.col("lower"), kind)
    middle = F.least(F.floor((axis(F.col("value"), kind) - axis(F.col("lower"), kind)) / width * 18), F.lit(17)) + 1
    place = F.when(F.col("value") < F.col("lower"), 0).when(F.col("value") > F.col("upper"), 19).when(width == 0, 10).otherwise(middle)
    binned = known.join(F.broadcast(tails)).groupBy("orphan", F.when(F.col("value").isNotNull(), place).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    totals = binned.groupBy("orphan").agg(F.sum("n").alias("total"))
    grid = rows.sparkSession.range(20).select(F.col("id").cast("int").alias("bin"), F.explode(F.array(F.lit(True), F.lit(False))).alias("orphan"))
    n = F.coalesce("n", F.lit(0).cast("long"))
    return grid.join(binned, ["orphan", "bin"], "left").join(totals, "orphan", "left").select("orphan", "bin", n.alias("count"), percent(n, F.col("total")).alias("percent"))


def month_histogram(rows: DataFrame) -> DataFrame:
    """orphan, bin, count: months 0 to 12 and more, 14 bins. rows(orphan, value); a value that isn't whole is an error."""
    v = F.col("value")
    whole = F.when(v != F.floor(v), F.raise_error(F.lit("months must be whole"))).otherwise(F.least(v.cast("int"), F.lit(13)))
    binned = rows.filter(v.isNotNull()).groupBy("orphan", whole.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = rows.sparkSession.range(14).select(F.col("id").cast("int").alias("bin"), F.explode(F.array(F.lit(True), F.lit(False))).alias("orphan"))
    return grid.join(binned, ["orphan", "bin"], "left").select("orphan", "bin", F.coalesce("n", F.lit(0).cast("long")).alias("count"))


def cumulative(rows: DataFrame) -> DataFrame:
    """orphan, value, share of the group's known values up to it, ties as one; by counts of distinct values."""
    values = counted(rows, ["orphan"], measured(F.col("value")))
    return ranked(values, ["orphan"]).select("orphan", "value", ((F.col("last") + 1) / F.col("total")).alias("share"))


def interests(edits: DataFrame, candidates: DataFrame, aggregate: bool) -> DataFrame:
    """key, topic, language: how well candidates(key, language, topic_labels) suit who made edits(language, topic_labels); each edit shares one among its labels."""
    labels = lambda c: F.array_distinct(F.filter(c, lambda x: x != ""))
    known = edits.select("language", labels(F.col("topic_labels")).alias("labels"))
    n = known.agg(F.count("*").alias("edits"), F.count_if(F.size("labels") > 0).alias("known"))
    weight = known.filter(F.size("labels") > 0).select(F.explode("labels").alias("label"), (F.lit(1.0) / F.size("labels")).alias("share")).groupBy("label").agg(F.sum("share").alias("weight"))
    spread = candidates.select("key", F.explode(labels(F.col("topic_labels"))).alias("label")).join(weight, "label").groupBy("key").agg(F.sum("weight").alias("weight"))
    lang = known.groupBy("language").agg(F.count("*").alias("in_language"))
    rows = candidates.select("key", "language").join(spread, "key", "left").join(lang, "language", "left").join(F.broadcast(n))
    topic = F.when(F.col("known") > 0, F.coalesce("weight", F.lit(0.0)) / F.col("known")).otherwise(F.lit(0.0))
    affinity = F.when(F.lit(aggregate) & (F.col("edits") > 0), F.coalesce("in_language", F.lit(0)) / F.col("edits")).otherwise(F.lit(0.0))
    return rows.select("key", topic.alias("topic"), affinity.alias("language"))


KINDS = {"overview": overview, "categories": label_counts, "creators": creators, "origins": bot_groups, "profiles": profiles, "numeric": histogram, "interests": interests}


def calculate(kind: str, *args, **kwargs) -> DataFrame:
    """A report by its name."""
    if kind not in KINDS:
        raise ValueError(f"unknown report {kind!r}; known: {', '.join(sorted(KINDS))}")
    return KINDS[kind](*args, **kwargs)
