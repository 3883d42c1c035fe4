"""Blocks of whole documents with a table of their distinct words.

A block is a run of neighbouring documents of one input partition, of BLOCK_BYTES of text (or what the
caller names: smaller blocks need less memory and repeat more words) or one longer document. Each of its distinct words (maximal runs of bytes other than ASCII white space) has
a number, in order of first appearance. Two tables describe the blocks:

- payload: one row per block, with the documents' ids, word counts and the numbers of their words
  in order of position (packed and compressed);
- words: one row per block and distinct word, with its number and its occurrences in the documents
  that are marked.

Whatever is computed once per distinct word (token ids, counts, log probabilities) comes back to the
documents by a join on the block and the number. So a word crosses the network once per block and
not once per occurrence, and the most frequent word has as many rows as there are blocks.
"""

from __future__ import annotations

import ctypes
import hashlib
import pickle
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

BLOCK_BYTES = 16 << 20
BATCH_BYTES = 4 << 20
BUCKETS = 1024  # at least; eight for each shuffle partition, so that tasks can grow in number with the input

PAYLOAD = T.StructType([T.StructField("block", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("words_digest", T.LongType()), T.StructField("payload", T.BinaryType())])
WORDS = T.StructType([T.StructField("block", T.LongType()), T.StructField("idx", T.IntegerType()), T.StructField("word", T.StringType()), T.StructField("marked", T.LongType())])
BOTH = T.StructType([*WORDS.fields, T.StructField("n_words", T.LongType()), T.StructField("words_digest", T.LongType()), T.StructField("payload", T.BinaryType())])


def words_digest(words: Iterable[bytes]) -> int:
    """64 bits of a digest of the words in their order."""
    return int.from_bytes(hashlib.blake2b(b" ".join(words), digest_size=8).digest(), "little", signed=True)


def release() -> None:
    """Gives freed memory back to the system: Python workers are used again by later stages, which would find it taken."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows as they come, then release()."""
    try:
        yield from rows
    finally:
        release()


def small_batches(rows: DataFrame) -> DataFrame:
    """rows, whose session sends BATCH_BYTES at a time to Python from now on, unless it has a setting of its own.

    Spark's default of 64 MB is held several times over: in the JVM's Arrow buffers, which grow by
    doubling outside its heap, and in the worker, for each task of an executor.
    """
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", rows.sparkSession.conf
    if conf.get(key, None) is None:
        conf.set(key, str(BATCH_BYTES))
    return rows


def each(column: pa.ChunkedArray) -> Iterator[bytes | None]:
    """The texts of a column as bytes, made one chunk after the other."""
    return chain.from_iterable(chunk.cast(pa.binary()).to_pylist() for chunk in column.chunks)


def numbered(texts: Iterable[bytes | None], index: defaultdict, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Word counts of the texts, and the numbers of all their words; new words get the next number. lower: A-Z first."""
    lens, parts = [], []
    for text in texts:
        words = (text.lower() if lower else text).split() if text else []
        lens.append(len(words))
        if words:
            parts.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
    return np.array(lens, np.int64), np.concatenate(parts) if parts else np.zeros(0, np.int32)


def new_index() -> defaultdict:
    return defaultdict(count().__next__)


def pack(rows: dict) -> bytes:
    """Arrays of 32-bit numbers as byte planes, which compress better, then the whole with zstd."""
    planes = {k: np.ascontiguousarray(v.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() if isinstance(v, np.ndarray) else v for k, v in rows.items()}
    raw = pickle.dumps(planes, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(data: bytes, arrays: tuple[str, ...] = ("lens", "idx")) -> dict:
    rows = pickle.loads(pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True))
    for k in arrays:
        rows[k] = np.ascontiguousarray(np.frombuffer(rows[k], np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
    return rows


def runs(batches: Iterator[pa.RecordBatch], limit: int = BLOCK_BYTES) -> Iterator[pa.Table]:
    """The rows of a partition in order, cut into tables of about limit bytes of text."""
    held, size = [], 0
    for batch in batches:
        start, lens = 0, np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), np.int64)
        for stop, n in enumerate(lens.tolist(), 1):
            size += n
            if size >= limit:
                held.append(batch.slice(start, stop - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, stop
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _block_rows(batches: Iterator[pa.RecordBatch], want: str, lower: bool, block_bytes: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = (TaskContext.get().partitionId() + 1) << 24
    for seq, table in enumerate(runs(batches, block_bytes)):
        index, block = new_index(), task + seq
        lens, idx = numbered(each(table.column("text")), index, lower)
        n = len(index)
        marks = np.asarray(table.column("mark").fill_null(False).to_numpy(), bool)
        if want != "payload":
            per_word = np.bincount(idx[np.repeat(marks, lens)], minlength=n) if n else np.zeros(0, np.int64)
            words = pa.array(list(index), pa.binary()).cast(pa.string())
            for at in range(0, n, 50_000):
                m = min(50_000, n - at)
                rows = {"block": pa.array(np.full(m, block)), "idx": pa.array(np.arange(at, at + m, dtype=np.int32)), "word": words.slice(at, m), "marked": pa.array(per_word[at : at + m].astype(np.int64))}
                if want == "both":
                    rows |= {"n_words": pa.nulls(m, pa.int64()), "words_digest": pa.nulls(m, pa.int64()), "payload": pa.nulls(m, pa.binary())}
                yield pa.RecordBatch.from_pydict(rows)
        digest = words_digest(index)
        del index
        if want != "words":
            data = pack({"ids": table.column("doc_id").to_pylist(), "marks": marks.tobytes(), "lens": lens, "idx": idx})
            rows = {"block": pa.array([block]), "n_words": pa.array([n]), "words_digest": pa.array([digest]), "payload": pa.array([data], pa.binary())}
            if want == "both":
                rows = {"block": rows["block"], "idx": pa.nulls(1, pa.int32()), "word": pa.nulls(1, pa.string()), "marked": pa.nulls(1, pa.int64()), "n_words": rows["n_words"], "words_digest": rows["words_digest"], "payload": rows["payload"]}
            yield pa.RecordBatch.from_pydict(rows)


def _packs(batches: Iterator[pa.RecordBatch], block_bytes: int = BLOCK_BYTES, buckets: int = BUCKETS) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = (TaskContext.get().partitionId() + 1) << 24
    for seq, table in enumerate(runs(batches, block_bytes)):
        index = new_index()
        numbered(each(table.column("text")), index)
        words, digest = list(index), words_digest(index)
        bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
        order = np.argsort(bucket, kind="stable")
        begins = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(words) else []
        packs = [pack({"idx": part, "words": b" ".join(map(words.__getitem__, part.tolist()))}) for part in np.split(order, begins[1:])] if len(words) else []
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket[order][begins] if len(words) else [], pa.int32()), "block": pa.array(np.full(len(packs), task + seq)), "words_digest": pa.array(np.full(len(packs), digest)), "pack": pa.array(packs, pa.binary())})


def word_packs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """bucket, block, words_digest, pack: the block's distinct words of one of the hash buckets, with their numbers, in one row."""
    buckets = max(BUCKETS, 8 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return small_batches(chosen).mapInArrow(lambda b: lean(_packs(b, block_bytes, buckets)), "bucket int, block long, words_digest long, pack binary")


def _rows(docs: DataFrame, want: str, mark: Column | None, id_col: str, text_col: str, lower: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), (F.lit(False) if mark is None else mark).alias("mark"))
    return small_batches(chosen).mapInArrow(lambda b: lean(_block_rows(b, want, lower, block_bytes)), {"payload": PAYLOAD, "words": WORDS, "both": BOTH}[want])


def payloads(docs: DataFrame, mark: Column | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, n_words, words_digest, payload. Reading docs again gives the same blocks as long as its partitions are those of files or of a written table."""
    return _rows(docs, "payload", mark, id_col, text_col, block_bytes=block_bytes)


def block_words(docs: DataFrame, mark: Column | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """block, idx, word, marked: a row per block and distinct word."""
    return _rows(docs, "words", mark, id_col, text_col)


def both(docs: DataFrame, mark: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lower: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """payloads() and block_words() in one pass; rows of either kind leave the other's columns null."""
    return _rows(docs, "both", mark, id_col, text_col, lower, block_bytes)


def rejoined(payload: DataFrame, words: DataFrame, per_block: Callable, schema: T.StructType, restore: Callable | None = None) -> DataFrame:
    """per_block(rows of the payload, table of the block's words in order of idx) for each block.

    restore makes that table, with a column idx, of the rows that came back where they aren't it already.
    Where docs is read twice, the words carry the digest of their block's words in order, and so does
    the payload: a block that was read in other partitions or in another order the second time is an
    error and never a wrong result.
    """

    def joined(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        digests = set(right.column("words_digest").unique().to_pylist()) if "words_digest" in right.column_names else set()
        right = restore(right) if restore else right
        if not left.num_rows:
            raise RuntimeError("words came back of a block that isn't there: its documents were read in another order")
        for n, digest, data in zip(*(left.column(k).to_pylist() for k in ("n_words", "words_digest", "payload")), strict=True):
            if digests - {digest}:
                raise RuntimeError("a block's words came back of other documents: they were read in another order")
            right = right.sort_by("idx").combine_chunks()
            if right.num_rows != n or (n and right.column("idx")[-1].as_py() != n - 1):
                raise RuntimeError(f"a block has {n} words, and {right.num_rows} came back: its documents were read in another order")
            out.append(per_block(unpack(data), right))
        release()
        return pa.concat_tables(out)

    own = payload.select(F.col("block").alias("own_block"), "n_words", "words_digest", "payload")
    return own.groupBy("own_block").cogroup(words.groupBy("block")).applyInArrow(joined, schema)
