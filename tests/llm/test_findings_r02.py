"""What the check tool found in round 2: edges of near-duplicates grew much faster than their groups."""

import itertools
import re

import pyarrow as pa
from pyspark.sql import functions as F

from orrery.llm import license, neardup
from orrery.llm.components import components


def test_edges_of_many_hubs_are_thinned(spark):
    """Members that share forty hubs keep an edge each, and so do the hubs; the components stay."""
    edges = [(h, 100 + m) for h, m in itertools.product(range(40), range(50))] + [(1000, 1001), (1001, 1002), (1001, 1000)]
    df = spark.createDataFrame(edges, "a long, b long")
    thin = neardup._thinned(df)
    assert thin.count() == 50 + 39 + 3
    assert sorted(map(tuple, components(thin).collect())) == sorted(map(tuple, components(df).collect()))


def test_links_of_a_block_join_labels_once():
    """Eight centres and twenty members of one text: one link for each label but one, not one for each pair."""
    rows = [{"unit": 1, "block": 0, "chunk": 0, "centre": True, "node": k, "label": k, "text": "one two three"} for k in range(8)]
    rows += [{"unit": 1, "block": 0, "chunk": 0, "centre": False, "node": k, "label": 50 if k > 10 else k, "text": "one two three"} for k in range(28)]
    found = [tuple(r.values()) for b in neardup._checked(iter(pa.RecordBatch.from_pylist(rows[i : i + 9]) for i in range(0, len(rows), 9)), 2, 80) for r in b.to_pylist()]
    assert len(found) == 11  # labels 0 to 10 and 50


def test_anchors_as_a_tree_hold_what_a_list_of_them_holds(spark):
    """The scan's anchors took 977 CPU seconds a GB as a list of 185 words; the tree must find the same whole words."""
    words = license.anchors()
    parts = [*words, *(w[:-1] for w in words), *(w + "s" for w in words), *(w.upper() for w in words[::3]), "_mit", "mit_", "x-mit.", "MIT\u0301", "\u212aind", "19", "1", "200", "2004", "", "é", "cc0", "cc00"]
    texts = [(f"{a} {b}",) for a, b in zip(parts, reversed(parts))] + [(p,) for p in parts] + [(None,)]
    plain = rf"(?i)\b(?:{'|'.join(words)})\b"
    rows = spark.createDataFrame(texts, "t string").select("t", F.col("t").rlike(plain).alias("a"), F.col("t").rlike(license.any_of(words)).alias("b")).collect()
    assert [r.t for r in rows if r.a != r.b] == [] and {r.a for r in rows} == {True, False, None}
    assert not re.search(license.any_of([]), "any text") and re.fullmatch(license.any_of(["a", "ab", "b"]), "AB")
