"""BPE encoding and decoding over a table of distinct words.

Words are the runs of characters between ASCII white space. The vocabulary's rules (composition,
lower case, the pattern of pre-tokens, special tokens) never look across white space, so the ids of a
text are those of its words in order. Each distinct word is encoded once, in a table dealt out by the
words' hash buckets; its ids come back to the documents by block and word number (see wordblocks), and a
join of a block's distinct ids with the id-to-piece table gives its words' pieces. Only the vocabulary
file and that table are broadcast; their size is that of the vocabulary.

Defined results: null and empty texts have no ids, and the digests of the empty string. A null
doc_id stays null. Repeated rows give repeated results. Columns other than the two named are unread.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from . import wordblocks as wb

@functools.lru_cache(4)
def tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    found = Tokenizer.from_str(vocabulary)
    found.no_padding()
    found.no_truncation()
    return found


@functools.lru_cache(4)
def pieces(vocabulary: str) -> list[str]:
    """The piece of each id: the id-to-piece table as a list."""
    t = tokenizer(vocabulary)
    return [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]


def pieces_table(spark, vocabulary: str) -> DataFrame:
    return spark.createDataFrame(list(enumerate(pieces(vocabulary))), "id int, piece string")


STEP = 20_000  # words that are turned into text at a time
KNOWN = 2_000_000  # words of a bucket that are kept; a bucket of more encodes some of them again


def _encode(vocabulary: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket, so a word is encoded once: where its bucket first holds it."""
    t, known, at = tokenizer(vocabulary), {}, None
    for batch in batches:
        out = []
        for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist(), strict=True):
            rows = wb.unpack(data, ("idx",))
            words = rows["words"].split()
            if bucket != at or len(known) > KNOWN:
                known, at = {}, bucket
            if new := [w for w in words if w not in known]:
                known.update(zip(new, (e.ids for e in t.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)), strict=True))
            ids = [known[w] for w in words]
            out.append(wb.pack({"idx": rows["idx"], "counts": np.fromiter(map(len, ids), np.int64, len(ids)), "ids": np.fromiter(chain.from_iterable(ids), np.int64)}))
        yield pa.RecordBatch.from_pydict({"block": batch.column("block"), "words_digest": batch.column("words_digest"), "pack": pa.array(out, pa.binary())})


def word_ids(packs: DataFrame, vocabulary: str) -> DataFrame:
    """block, words_digest, pack: the ids of each distinct word, for each block that holds it."""
    shared = packs.sparkSession.sparkContext.broadcast(vocabulary)
    dealt = packs.repartition("bucket").sortWithinPartitions("bucket", "block")
    return dealt.mapInArrow(lambda b: wb.lean(_encode(shared.value, b)), "block long, words_digest long, pack binary")


def _restored(rows: pa.Table) -> pa.Table:
    """idx, ids (32-bit numbers) of a block's words, in order of idx."""
    parts = [wb.unpack(p, ("idx", "counts", "ids")) for p in rows.column("pack").to_pylist()]
    idx, counts, ids = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in ("idx", "counts", "ids"))
    ends = np.r_[0, np.cumsum(counts)] * 4
    column = pa.Array.from_buffers(pa.large_binary(), len(idx), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(ids.astype("<u4").tobytes())])
    return pa.table({"idx": pa.array(idx), "ids": column}).take(pa.array(np.argsort(idx)))


def _split_ids(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    column = rows.column("ids")
    counts = np.asarray(pa.compute.binary_length(column).to_numpy(), np.int64) // 4
    flat = np.frombuffer(b"".join(column.to_pylist()), "<u4")
    return flat, counts


def _sha256(words: np.ndarray, text: list[bytes]) -> str:
    """Of the words' texts, joined by a space."""
    found = hashlib.sha256()
    for at in range(0, len(words), STEP):
        found.update((b" " if at else b"") + b" ".join(map(text.__getitem__, words[at : at + STEP].tolist())))
    return found.hexdigest()


def _named(flat: np.ndarray, table: pa.Table) -> list[bytes]:
    """The pieces of the ids, by a join of the ids that occur with the id-to-piece table; at other ids nothing."""
    ids = pa.table({"id": pa.array(np.unique(flat).astype(np.int32))})
    found = ids.join(table, "id", join_type="inner")
    if found.num_rows != ids.num_rows:
        raise RuntimeError("an id has no piece")
    out = [b""] * (int(flat.max()) + 1 if len(flat) else 0)
    for i, piece in zip(found.column("id").to_pylist(), found.column("piece").to_pylist(), strict=True):
        out[i] = piece.encode()
    return out


def _digests(table: pa.Table, docs: dict, rows: pa.Table) -> pa.Table:
    flat, counts = _split_ids(rows)
    bounds, idx, own, out = np.r_[0, np.cumsum(counts)], docs.pop("idx").astype(np.int32), [], {"n": [], "a": [], "b": []}
    for end, n in zip(np.cumsum(docs["lens"]).tolist(), docs["lens"].tolist(), strict=True):
        words = idx[end - n : end]
        per_word = counts[words]
        own.append(words[per_word > 0])
        out["n"].append(int(per_word.sum()))
    del idx
    for key, names in (("a", [str(i).encode() for i in range(int(flat.max()) + 1 if len(flat) else 0)]), ("b", _named(flat, table))):  # one after the other, for memory
        text = []
        for at in range(0, len(counts), STEP):
            cuts = bounds[at : at + STEP + 1]
            ids, cuts = flat[cuts[0] : cuts[-1]].tolist(), (cuts - cuts[0]).tolist()
            text += [b" ".join(map(names.__getitem__, ids[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        out[key] = [_sha256(words, text) for words in own]
        del text
    return pa.table({"doc_id": pa.array(docs["ids"], pa.int64()), "n_tokens": pa.array(out["n"], pa.int64()), "ids_sha256": pa.array(out["a"], pa.string()), "decoded_sha256": pa.array(out["b"], pa.string())})


def _ids(docs: dict, rows: pa.Table) -> pa.Table:
    flat, counts = _split_ids(rows)
    starts, ends = np.cumsum(counts) - counts, np.cumsum(docs["lens"])
    lists = []
    for end, n in zip(ends.tolist(), docs["lens"].tolist(), strict=True):
        own = docs["idx"][end - n : end]
        lists.append(np.concatenate([flat[starts[w] : starts[w] + counts[w]] for w in own]).astype(np.int32) if n else np.zeros(0, np.int32))
    return pa.table({"doc_id": pa.array(docs["ids"], pa.int64()), "n_tokens": pa.array([len(x) for x in lists], pa.int64()), "ids": pa.array(lists, pa.list_(pa.int32()))})


def _joined(docs: DataFrame, vocabulary: str, per_block, schema, id_col: str, text_col: str, block_bytes: int = wb.BLOCK_BYTES) -> DataFrame:
    ids = word_ids(wb.word_packs(docs, id_col, text_col, block_bytes), vocabulary)
    return wb.rejoined(wb.payloads(docs, id_col=id_col, text_col=text_col, block_bytes=block_bytes), ids, per_block, schema, _restored)


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (array of int) of every document. vocabulary: the content of a tokenizer file."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return _joined(docs, vocabulary, _ids, schema, id_col, text_col)


def decode(encoded: DataFrame, vocabulary: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, decoded: the pieces of the ids by a join with the id-to-piece table, joined by a space in order of position.

    key must be unique. Ids outside the vocabulary have no piece and are left out; null or empty lists give the empty string.
    """
    spread = encoded.select(F.col(key).alias("key"), F.posexplode_outer(ids).alias("pos", "id"))
    found = spread.join(F.broadcast(pieces_table(encoded.sparkSession, vocabulary)), "id", "left")
    ordered = F.array_sort(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
    return found.groupBy("key").agg(F.array_join(F.transform(ordered, lambda x: x["piece"]), " ").alias("decoded")).withColumnRenamed("key", key)


def digests(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = wb.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 (the decoded text), without writing out ids or texts.

    block_bytes: text of a block; smaller blocks need less of a worker's memory and more shuffle. The result is the same.
    """
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])
    listed = pieces(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(pa.table({"id": pa.array(range(len(listed)), pa.int32()), "piece": pa.array(listed, pa.string())}))
    return _joined(docs, vocabulary, lambda d, w: _digests(shared.value, d, w), schema, id_col, text_col, block_bytes)


def vocabulary_of(name_or_path: str = "word_bpe_49k.json") -> str:
    """The content of a tokenizer file: a path, or the name of one of the installed public files."""
    if Path(name_or_path).exists():
        return Path(name_or_path).read_text()
    import public_tokenizers

    return Path(public_tokenizers.path(name_or_path)).read_text()
