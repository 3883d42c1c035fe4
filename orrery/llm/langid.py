"""Language identification by cross-parsing: the language whose reference text needs the fewest normalised phrases wins.

Each language of the labelled rows has a reference: the whole texts of a bounded sample of its rows,
REFERENCE symbols in all (less, if TOTAL symbols are shared by many languages). A suffix automaton of the reference follows a text symbol by
symbol for as long as what it has read occurs in the reference; where it can't go on, a phrase ends
and it starts anew. The score of a language is phrases * log2(reference length) / symbols, an
estimate of the cross entropy in bits per symbol.

Symbols: lower-case letters (the most frequent ones of the references have their own, the others that
of their Unicode block), and one separator for each run of anything else. Whole texts are parsed, in
segments of SEGMENT symbols that run side by side in arrays, which adds one phrase end a segment for
every language alike.

The model has TOTAL symbols at most, of 512 bytes each, however large the corpus and however many
languages; it is what is broadcast. Rows of more than REFERENCE code points don't train.

Defined results: `und` with score 0 if the text is null or has no letters, or if there is no labelled
row. With one language its score is 1. Ties go to the first language in order of names. Null
doc_ids count as training rows; null labels and null texts don't train.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window, functions as F

from . import wordblocks as wb

SALTS, DOCS, ROW, REFERENCE, TOTAL, SEGMENT = 32, 96, 1000, 20_480, 327_680, 256
TRIALS, LONG = 32, 200
UNKNOWN = "und"
_OWN, _SYMBOLS, _WIDTH = 44, 64, 6
_PAD, _GAP, _FIRST = 0, 1, 2

PREDICTED = "held_out boolean, lang_pred string, score double, bits double, foreign boolean"


def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def symbol_table(references: dict[str, list[str]]) -> np.ndarray:
    """The symbol of each code point."""
    seen = Counter(c for texts in references.values() for t in texts for c in t.lower() if c.isalpha())
    points = np.arange(0x110000)
    table = np.where(_letters(), _FIRST + _OWN + (points >> 7) % (_SYMBOLS - _FIRST - _OWN), _GAP).astype(np.uint8)
    for k, (c, _) in enumerate(sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:_OWN]):
        table[ord(c)] = _FIRST + k
    return table


def to_symbols(text: str, table: np.ndarray) -> np.ndarray:
    out = table[np.frombuffer(text.lower().encode("utf-32-le"), "<u4")]
    return out[~((out == _GAP) & (np.r_[_GAP, out[:-1]] == _GAP))] if len(out) else out


def automaton(symbols: list[int]) -> np.ndarray:
    """Transitions of the suffix automaton, state * 64 + symbol; 0: none, 1: the start. Padding stays in place."""
    link, length, go = [0, 0], [0, 0], [{}, {}]
    last = 1
    for s in symbols:
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and s not in go[p]:
            go[p][s] = new
            p = link[p]
        if p:
            q = go[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p and go[p].get(s) == q:
                    go[p][s] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    table = np.zeros((len(go), _SYMBOLS), np.int32)
    for state, edges in enumerate(go):
        for s, to in edges.items():
            table[state, s] = to
    table[1:, _PAD] = np.arange(1, len(go))
    return table.ravel()


@dataclass
class Model:
    names: list[str]
    table: np.ndarray
    moves: list[np.ndarray]
    sizes: list[int]


def train(references: dict[str, list[str]]) -> Model:
    """references: texts by language."""
    table, names = symbol_table(references), sorted(references)
    parts = [np.concatenate([to_symbols(t, table) for t in references[k]] or [np.zeros(0, np.uint8)]) for k in names]
    return Model(names, table, [automaton(p.tolist()) for p in parts], [max(2, len(p)) for p in parts])


def phrases(columns: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Phrases that each column needs; columns are segments, padded at their end."""
    state, out = np.ones(columns.shape[1], np.int32), np.zeros(columns.shape[1], np.int32)
    for row in columns:
        to = moves[(state << _WIDTH) + row]
        missed = to == 0
        out += missed
        state = np.where(missed, np.maximum(moves[(1 << _WIDTH) + row.astype(np.int32)], 1), to)
    return out


def bits(texts: list[str | None], model: Model, at_once: int = 16_384) -> tuple[np.ndarray, np.ndarray]:
    """Bits per symbol of each text and language, and which texts have letters."""
    out, lettered = np.zeros((len(texts), len(model.names))), np.zeros(len(texts), bool)
    counts, lens, held = [], [], []
    for k, text in enumerate(texts):
        s = to_symbols(text, model.table) if text else np.zeros(0, np.uint8)
        lettered[k] = bool((s >= _FIRST).any())
        n = -(-len(s) // SEGMENT)
        lens.append(len(s))
        counts.append(n)
        held.append(np.r_[s, np.zeros(n * SEGMENT - len(s), np.uint8)])
    rows = np.concatenate(held).reshape(-1, SEGMENT) if held else np.zeros((0, SEGMENT), np.uint8)
    owner = np.repeat(np.arange(len(texts)), counts)
    for a in range(0, len(rows), at_once):
        columns = np.ascontiguousarray(rows[a : a + at_once].T)
        for k, moves in enumerate(model.moves):
            out[:, k] += np.bincount(owner[a : a + at_once], phrases(columns, moves) + 1, len(texts))
    return out * np.log2(model.sizes) / np.maximum(lens, 1)[:, None], lettered


def _predicted(model: Model, limit: float, keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for table in wb.runs(batches, 8 << 20):
        names, scores, best, foreign = [], [], [], []
        values, lettered = bits(table.column("text").to_pylist(), model)
        for row, known, n in zip(values, lettered, pa.compute.utf8_length(table.column("text")).to_pylist(), strict=True):
            foreign.append(bool(known and len(row) and n >= LONG and row.min() > limit))
            if not known or not len(row):
                names.append(UNKNOWN)
                scores.append(0.0)
                best.append(None)
                continue
            first = int(np.argmin(row))
            names.append(model.names[first])
            best.append(float(row[first]))
            scores.append(1.0 if len(row) == 1 else float(1 - row[first] / np.delete(row, first).min()))
        yield pa.RecordBatch.from_pydict({**{k: table.column(k).combine_chunks() for k in keys}, "held_out": table.column("held_out").combine_chunks(), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64()), "bits": pa.array(best, pa.float64()), "foreign": pa.array(foreign)})


def references(docs: DataFrame, held_out, id_col: str, text_col: str, lang_col: str) -> tuple[dict[str, list[str]], list[str]]:
    """The texts that train, by language, and TRIALS others of each language at most; nothing else reaches the driver.

    Of each language the first DOCS rows of REFERENCE code points at most, short ones (ROW) before long
    ones, in order of their ids' hashes; of these, whole texts as long as the reference has room.
    """
    usable = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[lang_col].alias("lang")).filter(~held_out & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.length(F.col("text")) <= REFERENCE))
    order = [F.length("text") > ROW, F.xxhash64("doc_id"), "doc_id"]
    keyed = usable.select("lang", "doc_id", order[0].alias("long"), order[1].alias("hash"))
    for by in (["lang", F.pmod("hash", F.lit(SALTS))], ["lang"]):  # the first of each part, then of these: no language is one task's
        first = Window.partitionBy(*by).orderBy("long", "hash", "doc_id")
        keyed = keyed.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= DOCS).drop("k")
    ids = keyed.select("doc_id").distinct().collect()
    chosen = F.col("doc_id").isin([r.doc_id for r in ids if r.doc_id is not None]) | (F.col("doc_id").isNull() if any(r.doc_id is None for r in ids) else F.lit(False))
    rows = usable.filter(chosen).withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "text"))).filter(F.col("k") <= DOCS).collect()
    listed: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.k)):
        listed.setdefault(r.lang, []).append(r.text)
    table, room = symbol_table(listed), min(REFERENCE, TOTAL // max(1, len(listed)))
    found: dict[str, list[str]] = {}
    others: list[str] = []
    for lang, texts in listed.items():
        left, own, trials = room, found.setdefault(lang, []), 0
        for text in texts:
            if (n := len(to_symbols(text, table))) <= left:
                own.append(text)
                left -= n
            elif trials < TRIALS:
                others.append(text)
                trials += 1
    return found, others


def foreign_from(model: Model, others: list[str]) -> float:
    """Bits per symbol from which a text is in no learned language: halfway between the worst of the labelled texts that didn't train and a phrase for each symbol."""
    values, lettered = bits(others, model)
    worst = max((float(row.min()) for row, known, t in zip(values, lettered, others, strict=True) if known and len(row) and len(t) >= LONG), default=0.0)
    return (worst + float(np.log2(max(model.sizes, default=2)))) / 2


def identify(docs: DataFrame, modulus: int = 4, remainder: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits (of the winner per symbol, null for und), foreign of every document.

    foreign: a text of LONG code points or more that needs more bits than foreign_from() allows; its
    language is still named. carry: columns of docs that come along in front, as k0, k1, ...; a row stays a row.
    """
    from .lm import held_out

    texts, others = references(docs, held_out(F.col("doc_id"), modulus, remainder), id_col, text_col, lang_col)
    trained = train(texts)
    limit, model = foreign_from(trained, others), docs.sparkSession.sparkContext.broadcast(trained)
    keys = {f"k{i}": c for i, c in enumerate(carry or [])} | {"doc_id": id_col}
    rows = docs.select(*(docs[c].alias(k) for k, c in keys.items()), held_out(docs[id_col], modulus, remainder).alias("held_out"), docs[text_col].alias("text"))
    schema = ", ".join(f"{k} {docs.schema[c].dataType.simpleString()}" for k, c in keys.items())
    return wb.small_batches(rows).mapInArrow(lambda b: wb.lean(_predicted(model.value, limit, list(keys), b)), f"{schema}, {PREDICTED}")
