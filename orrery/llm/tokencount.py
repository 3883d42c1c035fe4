"""Token counts that follow edits: a tree of sums over segments of pre-tokens for each document.

A text is cut into segments of about LEAF_BYTES bytes that end where a word begins; the vocabulary's
pre-tokens never look across ASCII white space, so the count of a text is the sum over its words. The
tree is kept as a heap: node k has the children 2k and 2k + 1, the leaves are the segments. An edit
encodes only the segments that it touches and the neighbour whose last or first word it may join,
and renews the sums on the way to the root.

Counts of words are kept per task, at most CACHE of them at once.

Defined results: null and empty texts have no tokens and one empty segment. Edits that reach beyond
the text are cut at its end; a null replacement deletes; start after end inserts at start.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import wordblocks as wb
from .bpe import tokenizer

LEAF_BYTES, CACHE = 1024, 1_000_000
_SPACE = b" \t\n\r\x0b\x0c"


@dataclass
class Counter:
    """Token counts of words; encodes the words it doesn't know."""

    vocabulary: str
    known: dict[bytes, int] = field(default_factory=dict)
    encoded: int = 0

    def learn(self, words: set[bytes]) -> None:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.encoded += len(new)
        self.known.update(zip(new, (len(e.ids) for e in tokenizer(self.vocabulary).encode_batch_fast([w.decode() for w in new], add_special_tokens=False)), strict=True))

    def count(self, piece: bytes) -> int:
        words = piece.split()
        try:
            return sum(map(self.known.__getitem__, words))
        except KeyError:
            self.learn(set(words))
            return sum(map(self.known.__getitem__, words))


def segments(text: bytes) -> list[bytes]:
    """Pieces of about LEAF_BYTES that join to the text; each but the first begins with white space."""
    out, at = [], 0
    while len(text) - at > LEAF_BYTES:
        stop = at + LEAF_BYTES
        while stop < len(text) and text[stop] not in _SPACE:
            stop += 1
        out.append(text[at:stop])
        at = stop
    out.append(text[at:])
    return out


def heap(leaves: list[int]) -> list[int]:
    width = 1
    while width < len(leaves):
        width *= 2
    tree = [0] * width + leaves + [0] * (width - len(leaves))
    for k in range(width - 1, 0, -1):
        tree[k] = tree[2 * k] + tree[2 * k + 1]
    return tree


@dataclass
class Tree:
    pieces: list[bytes]
    sums: list[int]

    @property
    def total(self) -> int:
        return self.sums[1]


def build(text: bytes, counter: Counter) -> Tree:
    pieces = segments(text)
    return Tree(pieces, heap([counter.count(p) for p in pieces]))


def edit(tree: Tree, start: int, end: int, new: bytes, counter: Counter) -> int:
    """Replaces the bytes from start to end; returns how many bytes were encoded anew."""
    end = max(start, end)
    first = at = 0
    while first < len(tree.pieces) - 1 and at + len(tree.pieces[first]) < start:
        at += len(tree.pieces[first])
        first += 1
    last, stop = first, at + len(tree.pieces[first])
    while last < len(tree.pieces) - 1 and stop <= end:  # the next piece too, where the edit may join its first word
        last += 1
        stop += len(tree.pieces[last])
    old = b"".join(tree.pieces[first : last + 1])
    touched = old[: max(0, start - at)] + new + old[max(0, end - at) :]
    if first and touched[:1] and touched[0] not in _SPACE:
        first -= 1
        touched = tree.pieces[first] + touched
    fresh = segments(touched)
    if len(fresh) == last + 1 - first:
        width = len(tree.sums) // 2
        tree.pieces[first : last + 1] = fresh
        for k, piece in enumerate(fresh, width + first):
            tree.sums[k] = counter.count(piece)
        low, high = (width + first) // 2, (width + last) // 2
        while low:
            for k in range(low, high + 1):
                tree.sums[k] = tree.sums[2 * k] + tree.sums[2 * k + 1]
            low, high = low // 2, high // 2
    else:
        width = len(tree.sums) // 2
        leaves = tree.sums[width : width + len(tree.pieces)]
        tree.pieces[first : last + 1] = fresh
        tree.sums = heap([*leaves[:first], *(counter.count(p) for p in fresh), *leaves[last + 1 :]])
    return len(touched)


def _byte_at(text: str, place: int) -> int:
    return len(text[:place].encode())


COUNTED = "doc_id long, n_tokens long, edited_tokens long, n_segments long, n_bytes long, bytes_encoded long, sums array<long>"


def _counted(vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counter = Counter(vocabulary)
    for table in wb.runs(batches, 4 << 20):
        out: dict[str, list] = {k: [] for k in ("n_tokens", "edited_tokens", "n_segments", "n_bytes", "bytes_encoded", "sums")}
        texts = table.column("text").to_pylist()
        counter.learn({w for t in texts if t for w in t.encode().split()})
        for text, edits in zip(texts, table.column("edits").to_pylist(), strict=True):
            now = text or ""
            tree = build(now.encode(), counter)
            before, n_bytes, renewed = tree.total, len(now.encode()), 0
            for e in edits or []:
                a, b = min(max(e["start"] or 0, 0), len(now)), min(max(e["end"] or 0, 0), len(now))
                b, new = max(a, b), e["replacement"] or ""
                renewed += edit(tree, _byte_at(now, a), _byte_at(now, b), new.encode(), counter)
                now = now[:a] + new + now[b:]
            for k, v in zip(out, (before, tree.total, len(tree.pieces), n_bytes, renewed, tree.sums), strict=True):
                out[k].append(v)
        yield pa.RecordBatch.from_pydict({"doc_id": table.column("doc_id").combine_chunks(), **{k: pa.array(v, pa.list_(pa.int64()) if k == "sums" else pa.int64()) for k, v in out.items()}})


def counts(docs: DataFrame, vocabulary: str, edits=None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, edited_tokens (after the edits in order), n_segments, n_bytes, bytes_encoded (for the edits), sums (the tree after them).

    edits: a column of array<struct<start, end, replacement>>, places in code points of the text as the edit before left it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    none = F.lit(None).cast("array<struct<start:long,end:long,replacement:string>>")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), (none if edits is None else edits.cast("array<struct<start:long,end:long,replacement:string>>")).alias("edits"))
    return wb.small_batches(rows).mapInArrow(lambda b: _counted(shared.value, b), COUNTED)
