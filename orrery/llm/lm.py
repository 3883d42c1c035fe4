"""Language model scores by a probabilistic suffix tree over the words of a text.

Tokens are the words of a text (A-Z in lower case, split at ASCII white space) and one end.

Symbols. A word that occurs SYMBOL times in training is a symbol of its own, and so is the end; other
words, known or not, share the symbol of their last two bytes if that occurs as often, and one last
symbol otherwise. P(token | before) = P(symbol | before) * P(token | symbol). Within a shared symbol of
count C and V training words, a known word of count c has (c - 0.5) / C, and all unknown words together,
one event as in the base model, have 0.5 * V / C.

Tree. Contexts are the one to DEPTH symbols before a token (an end stands before the first), if they
occur CONTEXT times. A context is retained if its next-symbol distribution diverges from that of its
longest retained suffix: the training tokens after it gain DIVERGENCE nats or more per next symbol it
stores. It stores next symbols that occur PAIR times after it; what is left of its count, and one for
each stored symbol, goes to its suffix's distribution. Scoring uses the longest retained suffix.

Size. SYMBOL, CONTEXT and PAIR are factors of n ** (2/3), n the training tokens. So the model grows
with the corpus, as n ** (1/3): n / (CONTEXT * n ** (2/3)) contexts and n / (PAIR * n ** (2/3)) pairs of
each length at most, of 16 bytes: 10 MB a length at 1e8 tokens, 0.5 GB at 1.6e13 (100 TB). That is what
the driver holds and what is broadcast.

Counts come from all training documents: words by the distinct words of blocks (see wordblocks),
contexts and what follows them by blocks of symbols, one length after the other.

Defined results: null and empty texts are the end alone. A null doc_id is never held out. Without
training documents N and V are 0, base_score is 0 per token, and every symbol is equally likely.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from . import wordblocks as wb
from .scratch import written

SYMBOL, CONTEXT, PAIR = 0.08, 0.04, 0.0008
DEPTH = 4
DIVERGENCE = 1.0
BLOCK_BYTES = 8 << 20
DISCOUNT = 0.5

SCORES = T.StructType([T.StructField(k, t) for k, t in (("doc_id", T.LongType()), ("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))])


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; false for null ids."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


@dataclass
class Symbols:
    """Numbers of symbols: 0 is the end, 1 the last shared one, then words, then endings; and what each is made of."""

    words: dict[str, int]
    endings: dict[str, int]
    count: np.ndarray  # training tokens
    kinds: np.ndarray  # distinct training words of a shared symbol, 0 for the others
    n: int
    v: int
    n_end: int


def least(factor: float, n: int, floor: int = 2) -> int:
    """The least count that factor stands for among n training tokens."""
    return max(floor, math.ceil(factor * n ** (2 / 3)))


def ending(word: Column) -> Column:
    """The last two bytes as text of hexadecimal digits."""
    return F.hex(F.substring(word.cast("binary"), -2, 2))


def symbols(words: DataFrame, n_end: int) -> Symbols:
    """words: word, c, end (of the word). Only endings and words that are symbols reach the driver."""
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1))).first()
    n, v = n + n_end, v + (n_end > 0)
    often = least(SYMBOL, n, 1)
    own = {r.word: r.c for r in words.filter(F.col("c") >= often).select("word", "c").collect()}
    rest = words.filter((F.col("c") > 0) & (F.col("c") < often)).groupBy("end").agg(F.sum("c").alias("c"), F.count("*").alias("k")).filter(F.col("c") >= often).collect()
    count, kinds = [n_end, 0], [0, 0]
    own_no, end_no = {}, {}
    for word in sorted(own):
        own_no[word] = len(count)
        count.append(own[word])
        kinds.append(0)
    for r in sorted(rest, key=lambda r: r.end):
        end_no[r.end] = len(count)
        count.append(r.c)
        kinds.append(r.k)
    count[1], kinds[1] = n - sum(count), v - (n_end > 0) - len(own) - sum(kinds)
    return Symbols(own_no, end_no, np.array(count, np.float64), np.array(kinds, np.float64), n, v, n_end)


def _marked(word: Iterator[pa.RecordBatch], s: Symbols) -> Iterator[pa.RecordBatch]:
    """Adds to block, idx, word, end, c the number of the symbol; leaves the word behind."""
    for batch in word:
        found = [s.words.get(w) or s.endings.get(e, 1) for w, e in zip(batch.column("word").to_pylist(), batch.column("end").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "idx": batch.column("idx"), "c": batch.column("c"), "symbol": pa.array(found, pa.int32())})


def _sums(values: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """Sums of values over runs of the given lengths, 0 for empty runs."""
    out, full = np.zeros(len(lens)), lens > 0
    if full.any():
        out[full] = np.add.reduceat(values, (np.cumsum(lens) - lens)[full])
    return out


def _symbol_rows(s: Symbols, docs: dict, rows: pa.Table) -> pa.Table:
    """One row for a block: base scores and what is known before any context, and the symbols of all tokens in order."""
    c, sym = np.asarray(rows.column("c").to_numpy(), np.float64), np.asarray(rows.column("symbol").to_numpy(), np.int64)
    base = np.log10((c + 0.5) / (s.n + 0.5 * (s.v + 1)))
    shared = s.kinds[sym] + (sym == 1) > 0
    with np.errstate(divide="ignore", invalid="ignore"):
        inside = np.where(c > 0, np.log10(np.maximum(c - DISCOUNT, DISCOUNT) / s.count[sym]), np.log10(DISCOUNT * s.kinds[sym] / s.count[sym]))
    inside = np.where(shared & (s.count[sym] > 0), inside, 0.0)
    lens, idx = docs["lens"], docs["idx"]
    ends = np.cumsum(lens + 1) - 1
    out = np.zeros(len(idx) + len(lens), np.int64)
    spots = np.ones(len(out), bool)
    spots[ends] = False
    out[spots] = sym[idx]
    held = {
        "ids": docs["ids"], "marks": docs["marks"], "lens": lens + 1, "symbols": out, "known": _sums((c > 0).astype(np.float64)[idx], lens).tobytes(),
        "base": (_sums(base[idx], lens) + np.log10((s.n_end + 0.5) / (s.n + 0.5 * (s.v + 1)))).tobytes(), "inside": _sums(inside[idx], lens).tobytes(),
    }
    return pa.table({"payload": pa.array([wb.pack(held)], pa.binary())})


@dataclass
class Levels:
    """The contexts of each length. The contexts of length k + 1 are keys[k - 1], sorted: number of the k older symbols * size + the newest."""

    size: int
    keys: list[np.ndarray]

    def numbers(self, sym: np.ndarray, first: np.ndarray) -> list[np.ndarray]:
        """The number of the context of each length before each token, -1 where there is none. first: whether a document begins here."""
        before = np.r_[0, sym[:-1]][: len(sym)]
        before[first] = 0
        out = [before]
        for keys in self.keys:
            older = np.r_[-1, out[-1][:-1]][: len(sym)]
            older[first] = -1
            out.append(found(keys, np.where(older >= 0, older * self.size + before, -1)))
        return out


def found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number among the sorted keys, -1 where it isn't one."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _read(data: bytes) -> tuple[dict, np.ndarray, np.ndarray]:
    """The block, its symbols, and where documents begin."""
    docs = wb.unpack(data, ("lens", "symbols"))
    first = np.zeros(len(docs["symbols"]), bool)
    first[np.cumsum(docs["lens"]) - docs["lens"]] = True
    return docs, docs["symbols"], first


def _counted(batches: Iterator[pa.RecordBatch], levels: Levels) -> Iterator[pa.RecordBatch]:
    """Counts of (context of the greatest length, next symbol) in the training documents."""
    for batch in batches:
        for data in batch.column("payload").to_pylist():
            docs, sym, first = _read(data)
            ctx = levels.numbers(sym, first)[-1]
            use = np.repeat(np.frombuffer(docs["marks"], bool), docs["lens"]) & (ctx >= 0)
            keys, n = np.unique(ctx[use] * levels.size + sym[use], return_counts=True)
            yield pa.RecordBatch.from_pydict({"pair": pa.array(keys.astype(np.int64)), "n": pa.array(n.astype(np.int64))})


def _pairs(blocks: DataFrame, levels: Levels, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that occur PAIR times, sorted, and their counts."""
    shared = blocks.sparkSession.sparkContext.broadcast(levels)
    rows = blocks.mapInArrow(lambda b: wb.lean(_counted(b, shared.value)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= least(PAIR, n, 1)).toArrow().sort_by("pair")
    return tuple(np.asarray(rows.column(k).to_numpy(), np.int64) for k in ("pair", "n"))


class Tree:
    """State 0 is the root. A state has its parent, and the weight that goes to the parent; stored pairs have their whole probability.

    own[k] gives the state of each context of length k + 1, 0 where it isn't retained, and total[k] its count.
    """

    def __init__(self, s: Symbols):
        self.size = len(s.count)
        self.root = (s.count + 0.5) / (s.count + 0.5).sum()
        self.levels = Levels(self.size, [])
        self.own = [np.zeros(self.size, np.int64)]
        self.total = [s.count]
        self.shorter: list[np.ndarray] = [np.full(self.size, -1)]  # the context without its oldest symbol
        self.parent, self.weight = np.zeros(1, np.int64), np.ones(1)
        self.pair, self.p = np.zeros(0, np.int64), np.zeros(0)

    def states(self, numbers: list[np.ndarray]) -> np.ndarray:
        """The longest retained suffix."""
        out = np.zeros(len(numbers[0]), np.int64)
        for own, ctx in zip(self.own, numbers, strict=True):
            state = np.where(ctx >= 0, own[ctx], 0) if len(own) else np.zeros(len(ctx), np.int64)
            out = np.where(state > 0, state, out)
        return out

    def probability(self, state: np.ndarray, sym: np.ndarray) -> np.ndarray:
        out, open_, weight = np.zeros(len(sym)), np.arange(len(sym)), np.ones(len(sym))
        while len(open_):
            at_root = state == 0
            out[open_[at_root]] = weight[at_root] * self.root[sym[at_root]]
            open_, state, sym, weight = (x[~at_root] for x in (open_, state, sym, weight))
            if not len(open_):
                break
            key = state * self.size + sym
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            hit = self.pair[at] == key
            out[open_[hit]] = weight[hit] * self.p[at[hit]]
            open_, sym, weight, state = (x[~hit] for x in (open_, sym, weight * self.weight[state], self.parent[state]))
        return out

    def longest(self, ctx: int) -> int:
        """The longest retained proper suffix of a context of the greatest length."""
        for k in range(len(self.own) - 1, 0, -1):
            ctx = self.shorter[k][ctx]
            if ctx < 0:
                return 0
            if self.own[k - 1][ctx]:
                return int(self.own[k - 1][ctx])
        return 0

    def grow(self, ctx: np.ndarray, sym: np.ndarray, n: np.ndarray) -> None:
        """Retains contexts of the greatest length that pass the divergence test. Rows are sorted by context."""
        if not len(ctx):
            return
        starts = np.flatnonzero(np.r_[True, ctx[1:] != ctx[:-1]])
        pair, p, parents, weights = [], [], [], []
        for a, b in zip(starts, np.r_[starts[1:], len(ctx)], strict=True):
            c, kinds, parent = int(ctx[a]), b - a, self.longest(int(ctx[a]))
            count = self.total[-1][c]
            own = n[a:b] / (count + kinds)
            left = 1 - own.sum()
            below = self.probability(np.full(kinds, parent), sym[a:b])
            gain = (n[a:b] * np.log((own + left * below) / below)).sum() + (count - n[a:b].sum()) * np.log(left)
            if gain >= DIVERGENCE * kinds:
                self.own[-1][c] = len(self.parent) + len(parents)
                pair.append(self.own[-1][c] * self.size + sym[a:b])
                p.append(own + left * below)
                parents.append(parent)
                weights.append(left)
        if parents:
            self.parent, self.weight = np.r_[self.parent, parents], np.r_[self.weight, weights]
            self.pair, self.p = np.r_[self.pair, *pair], np.r_[self.p, *p]

    def deepen(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Adds the contexts of the next length: keys, and how often they occur."""
        older, newest = keys // self.size, keys % self.size
        if len(self.own) == 1:
            shorter = newest
        else:
            short = self.shorter[-1][older]
            shorter = found(self.levels.keys[-1], np.where(short >= 0, short * self.size + newest, -1))
        self.levels = Levels(self.size, [*self.levels.keys, keys])
        self.own.append(np.zeros(len(keys), np.int64))
        self.total.append(counts.astype(np.float64))
        self.shorter.append(shorter)


def fit(blocks: DataFrame, s: Symbols) -> Tree:
    tree, size, often = Tree(s), len(s.count), least(CONTEXT, s.n)
    for depth in range(1, DEPTH + 1):
        pair, n = _pairs(blocks, tree.levels, s.n)
        keep = tree.total[-1][pair // size] >= often if len(pair) else np.zeros(0, bool)
        tree.grow(pair[keep] // size, pair[keep] % size, n[keep])
        deeper = (n >= often) & (pair % size != 0)  # after an end nothing follows
        if depth == DEPTH or not deeper.any():
            return tree
        tree.deepen(pair[deeper], n[deeper])
    return tree


def _scores(s: tuple[int, int], tree: Tree, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, n_end = s
    for batch in batches:
        for data in batch.column("payload").to_pylist():
            docs, sym, first = _read(data)
            state = tree.states(tree.levels.numbers(sym, first))
            p = np.concatenate([tree.probability(state[a : a + 500_000], sym[a : a + 500_000]) for a in range(0, len(sym), 500_000)])
            base, inside, known = (np.frombuffer(docs[k], np.float64) for k in ("base", "inside", "known"))
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(docs["ids"], pa.int64()), "held_out": pa.array(~np.frombuffer(docs["marks"], bool)), "n_tokens": pa.array(docs["lens"]), "n_known": pa.array((known + (n_end > 0)).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(base), n)), "base_score": pa.array(base), "score": pa.array(_sums(np.log10(p), docs["lens"]) + inside),
            })


def score(docs: DataFrame, modulus: int = 5, remainder: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document; learns from those that aren't held out."""
    spark = docs.sparkSession
    table = written(wb.both(docs, ~held_out(docs[id_col], modulus, remainder), id_col, text_col, lower=True, block_bytes=BLOCK_BYTES), "lm-blocks")
    seen = table.filter("payload IS NULL").select("block", "idx", "word", "marked")
    words = written(seen.groupBy("word").agg(F.sum("marked").alias("c")).withColumn("end", ending(F.col("word"))), "lm-words")
    n_end = docs.select(F.count(F.when(~held_out(docs[id_col], modulus, remainder), 1))).first()[0]
    s = symbols(words, n_end)
    shared = spark.sparkContext.broadcast(s)
    marked = seen.select("block", "idx", "word").join(words, "word").mapInArrow(lambda b: _marked(b, shared.value), "block long, idx int, c long, symbol int")
    payload = table.filter("payload IS NOT NULL").select("block", "n_words", "words_digest", "payload")
    blocks = written(wb.rejoined(payload, marked, lambda d, w: _symbol_rows(shared.value, d, w), T.StructType([T.StructField("payload", T.BinaryType())])), "lm-symbols")
    tree = spark.sparkContext.broadcast(fit(blocks, s))
    return blocks.mapInArrow(lambda b: wb.lean(_scores((s.n, s.n_end), tree.value, b)), SCORES)
