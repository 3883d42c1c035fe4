"""Multilabel topics of pages from their out-links' items, with a model of one's own."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

THRESHOLD = 0.5


class TopicModel(Protocol):
    """What predicts: labels in order, and their probabilities for a text of items."""

    labels: list[str]

    def predict(self, text: str) -> dict[str, float]: ...


class LinearStub:
    """A deterministic model for tests: an item's number modulo the number of labels names its label."""

    def __init__(self, labels: list[str]):
        self.labels = labels

    def predict(self, text: str) -> dict[str, float]:
        items, p = text.split(), dict.fromkeys(self.labels, 0.0)
        for item in items:
            p[self.labels[int(item[1:]) % len(self.labels)]] += 1
        return {k: min(1.0, 2 * v / max(1, len(items))) for k, v in p.items()}


def named(label: str) -> str:
    return label.removeprefix("__label__").replace("_", " ")


def predicted(model: TopicModel, text: str) -> list[str]:
    p = model.predict(text)
    if set(p) != set(model.labels) or not all(0 <= v <= 1.0001 for v in p.values()):
        raise ValueError("a model must give one probability per label")
    return sorted(named(k) for k, v in p.items() if v > THRESHOLD)


def supplement(inputs: DataFrame, model: TopicModel) -> DataFrame:
    """language, page_id, topic_status, topic_input_count, topic_labels (null unless predicted). inputs: of graph.topic_inputs()."""
    shared = inputs.sparkSession.sparkContext.broadcast(model)

    @pandas_udf("array<string>")
    def labels(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        for batch in texts:
            yield batch.map(lambda t: predicted(own, t) if t else None)

    status = F.when(F.col("n") > 0, "predicted").when(F.col("mapped"), "no_model_vocabulary").otherwise("no_mapped_outlinks")
    return inputs.select("language", "page_id", status.alias("topic_status"), F.col("n").alias("topic_input_count"), labels(F.col("input")).alias("topic_labels"))
