"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

1. Words are lower-case, without ASCII punctuation, split at ASCII white space.
2. All n-grams of SEED words of an item are its seeds, however often they occur: a limit on counts
   would lose edited or partial passages that repeat. The filter of the next step is what drops
   chance hits; its cost grows with the items that share an n-gram.
3. Where seeds of an item lie close in a document, the passage around them joins the item if it holds
   enough of its words for the score that a leak needs (each matching word adds 2 at most), and a
   local alignment of the words (match 2, others -1) scores it: its value over that of the whole item.
   A pair is a leak from MIN_SCORE on.

The benchmark is the stated query set: it is looked up in blocks of BLOCK_CHARS at most, which is
what is broadcast. Documents are never shuffled; only passages are.

Defined results: null and empty texts and items have no rows. Items of fewer than SEED words can't be
told from ordinary prose and have no rows. Items of equal text each have their rows. Repeated
documents repeat under their doc_id, of which the best passage stays.
"""

from __future__ import annotations

import string
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordblocks as wb

SEED, MIN_SCORE, BLOCK_CHARS = 3, 0.5, 32 << 20
_PUNCTUATION = string.punctuation.encode()


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(None, _PUNCTUATION).split() if text else []


class Index:
    """The n-grams of a block of items: keys in order, and where each stands."""

    def __init__(self, items: list[tuple[object, str]]):
        self.words = [words_of(t) for _, t in items]
        self.bags = [Counter(ws) for ws in self.words]
        self.vocabulary = {w: k for k, w in enumerate(sorted({w for ws in self.words for w in ws}), 1)}
        found: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, ws in enumerate(self.words):
            for p, key in enumerate(self.keys(self.numbers(ws)).tolist()):
                found[key].append((i, p))
        self.places = dict(found)
        self.grams = np.array(sorted(found), np.int64)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def keys(self, numbers: np.ndarray) -> np.ndarray:
        """The key of the n-gram at each place; -1 if a word isn't in the vocabulary."""
        n = len(numbers) - SEED + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        key, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(SEED):
            part = numbers[k : k + n]
            key = key * (len(self.vocabulary) + 1) + part
            known &= part > 0
        return np.where(known, key, -1)

    def hits(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of known n-grams, and where in grams each stands."""
        keys = self.keys(numbers)
        at = np.flatnonzero(keys >= 0) if len(self.grams) else np.zeros(0, np.int64)
        near = np.minimum(np.searchsorted(self.grams, keys[at]), len(self.grams) - 1)
        found = self.grams[near] == keys[at] if len(at) else np.zeros(0, bool)
        return at[found], near[found]


def spans(at: list[int], items: list[tuple[int, int]], sizes: list[int]) -> Iterator[tuple[int, int, int]]:
    """item, begin, end of the passages around close seeds of an item; at: places in the document, items: (item, place in it)."""
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for a, (i, p) in zip(at, items, strict=True):
        slack = sizes[i] // 3 + 4
        by[i].append((max(0, a - p - slack), a - p + sizes[i] + slack))
    for i, ranges in by.items():
        ranges.sort()
        begin, end = ranges[0]
        for b, e in ranges[1:]:
            if b > end:
                yield i, begin, end
                begin, end = b, e
            end = max(end, e)
        yield i, begin, end


def _passages(index: Index, min_score: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sizes = [len(w) for w in index.words]
    for batch in batches:
        out = {"doc_id": [], "item": [], "begin": [], "passage": []}
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = words_of(text)
            at, grams = index.hits(index.numbers(words))
            if not len(at):
                continue
            pairs = [(a, place) for a, k in zip(at.tolist(), index.grams[grams].tolist(), strict=True) for place in index.places[k]]
            for i, begin, end in spans([a for a, _ in pairs], [p for _, p in pairs], sizes):
                if (Counter(words[begin:end]) & index.bags[i]).total() < min_score * sizes[i]:
                    continue
                for k, v in zip(out, (doc, i, begin, b" ".join(words[begin:end])), strict=True):
                    out[k].append(v)
        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(out["doc_id"], batch.schema.field("doc_id").type), "item": pa.array(out["item"], pa.int32()), "begin": pa.array(out["begin"], pa.int64()), "passage": pa.array(out["passage"], pa.binary()).cast(pa.string())})


def aligned(item: list[bytes], passage: list[bytes]) -> tuple[float, int]:
    """Best local alignment over that of the item with itself, and the place after its end in the passage."""
    if not item or not passage:
        return 0.0, 0
    number = {w: k for k, w in enumerate(dict.fromkeys(passage))}
    own = np.fromiter((number[w] for w in passage), np.int64, len(passage))
    steps = np.arange(len(passage) + 1)
    row, best, end = np.zeros(len(passage) + 1), 0.0, 0
    for w in item:
        new = np.maximum(0.0, row - 1)
        new[1:] = np.maximum(new[1:], row[:-1] + np.where(own == number.get(w, -1), 2.0, -1.0))
        row = np.maximum.accumulate(new + steps) - steps
        if (top := row.max()) > best:
            best, end = float(top), int(row.argmax())
    return best / (2 * len(item)), end


def _aligned(batches: Iterator[pa.RecordBatch], min_score: float) -> Iterator[pa.RecordBatch]:
    memo: dict[tuple[bytes, bytes], tuple[float, int]] = {}
    for batch in batches:
        scores, ends = [], []
        for a, b in zip(batch.column("item_text").cast(pa.binary()).to_pylist(), batch.column("passage").cast(pa.binary()).to_pylist(), strict=True):
            if (a, b) not in memo:
                if len(memo) > 20_000:
                    memo.clear()
                memo[a, b] = aligned(words_of(a.decode()), b.split())
            score, end = memo[a, b]
            scores.append(score)
            ends.append(end)
        out = pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "item_id": batch.column("item_id"), "score": pa.array(scores, pa.float64()), "end_word": pa.compute.add(batch.column("begin"), pa.array(ends, pa.int64()))})
        yield out.filter(pa.compute.greater_equal(out.column("score"), min_score))


def leaks(docs: DataFrame, benchmark: DataFrame, min_score: float = MIN_SCORE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, score, end_word: the pairs of document and item that align from min_score on; end_word: the word of the document after the passage."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    texts = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).filter(F.col("text").isNotNull())
    items = benchmark.select(benchmark[item_col].alias("item_id"), benchmark[item_text_col].alias("item_text")).filter(F.col("item_text").isNotNull())
    total = items.agg(F.coalesce(F.sum(F.length("item_text")), F.lit(0))).first()[0]
    n_blocks, result = max(1, -(-2 * total // BLOCK_CHARS)), None
    for k in range(n_blocks):
        rows = items.filter(F.pmod(F.xxhash64("item_text"), F.lit(n_blocks)) == k).collect() if n_blocks > 1 else items.collect()
        by_text: dict[str, list] = defaultdict(list)
        for r in rows:
            by_text[r.item_text].append(r.item_id)
        listed = [(t, by_text[t]) for t in sorted(by_text)]
        index = Index([(i, t) for i, (t, _) in enumerate(listed)])
        shared = spark.sparkContext.broadcast(index)
        passages = texts.mapInArrow(lambda b, x=shared: wb.lean(_passages(x.value, min_score, b)), f"doc_id {id_type}, item int, begin long, passage string")
        known = spark.createDataFrame([(i, item, t) for i, (t, ids) in enumerate(listed) for item in ids] or [(-1, -1, "")], "item int, item_id long, item_text string")
        scored = passages.join(F.broadcast(known), "item").mapInArrow(lambda b: wb.lean(_aligned(b, min_score)), f"doc_id {id_type}, item_id long, score double, end_word long")
        best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct("score", "end_word")).alias("m")).select("doc_id", "item_id", "m.score", "m.end_word")
        result = best if result is None else result.union(best)
    return result
