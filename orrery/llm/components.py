"""Connected components of an edge table, by minimum labels with short cuts; every step is a join or an aggregate, but for small tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordblocks as wb
from .scratch import cut

ALONE = 1_000_000


def _labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of all edges a, b that come: each root takes the least root beside it until no edge has two."""
    ends = [np.stack([batch.column(k).to_numpy() for k in (0, 1)]) for batch in batches if batch.num_rows]
    if not ends:
        return
    nodes, places = np.unique(np.concatenate(ends, axis=1), return_inverse=True)
    one, other = places.reshape(2, -1)
    label = np.arange(len(nodes))
    while len(open_ := np.flatnonzero(label[one] != label[other])):
        one, other = label[one[open_]], label[other[open_]]
        np.minimum.at(label, np.maximum(one, other), np.minimum(one, other))
        while (label != (up := label[label])).any():
            label = up
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes), "label": pa.array(nodes[label])})


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for the nodes of edges(a, b), which are longs. Edges may repeat; an empty table gives none.

    Up to ALONE distinct edges, 16 MB, are one task's work: two queries, where the rounds take a dozen and
    the driver's memory for their plans. Beyond, a label travels to all neighbours in each round, and each
    node then takes its label's label, so the rounds grow with the logarithm of a component's diameter; one
    for stars. Rows are a few numbers each; partitions that one node's edges or one label's nodes make large
    are split by AQE.
    """
    pairs = cut(edges.select("a", "b").filter("a != b").distinct())
    if pairs.count() <= ALONE:
        return cut(pairs.coalesce(1).mapInArrow(lambda rows: wb.lean(_labels(rows)), "node long, label long"))
    both = cut(pairs.union(pairs.select("b", "a")).distinct().toDF("u", "v"))
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    while True:
        least = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("near"))
        new = labels.join(least, F.col("node") == F.col("u"), "left").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        top = new.select(F.col("node").alias("label"), F.col("label").alias("top"))
        new = cut(new.join(top, "label", "left").select("node", "old", F.least("label", "top").alias("label")))
        if new.filter("old != label").isEmpty():
            return labels
        labels = new.select("node", "label")
