"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidate edges.

1. A document's set holds the 64-bit hashes of its distinct w-word shingles. Documents with equal
   sets (a 128-bit digest) become one class before anything else, so copies cost nothing later.
2. One permutation: the hash range is cut into BANDS * ROWS bins, and each keeps its least hash. An
   empty bin takes the value of a bin that universal hashing of (bin, attempt) names, the first that
   isn't empty (optimal densification). ROWS neighbouring bins make a band's bucket. Two sets of
   similarity 0.8 miss each other in all bands with probability (1 - 0.8 ** ROWS) ** BANDS = 5e-6.
3. Each bucket is sorted by set size and cut where the next set is over 1/threshold times as large,
   for no link can cross there. The least class of a piece is the hub of a star: as many edges as
   members, never all pairs. A group of near copies has the same least class in most of its bands,
   so its stars are mostly one. Buckets are dealt by ranges, so a large one has many tasks.
4. Each member is compared with its hub on the full sets; a task holds the hub's set, and a hub of
   many members stands in many tasks. Components of the links that hold are settled; of a member's
   hubs, the others are first linked with the least, as many members have the same few.
5. Stars whose members lie in several components may hold further links; those that share members
   make a unit. Any link between components has an end outside the largest component of its unit:
   such members are centres, of which a task holds CENTRES, and all members of the unit are compared
   with them, as they go by. Where that sends more rows, the unit is first cut by shingles: two sets
   that reach the threshold share one of their rarest, counted within the unit, that is one of the
   first n - ceil(threshold * n) + 1 of a set of n. Either way decides every candidate.

Defined results: null and white-space texts have an empty set and are linked with nothing. Null
doc_ids take part, but never name a component; a component of null ids alone has the id null, and
its rows are kept. Repeated rows are copies; rows of one doc_id that is its component's id are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from . import wordblocks as wb
from .components import components
from .scratch import written
from .skew import lookup

BANDS, ROWS = 40, 6
CENTRES, CENTRE_SHINGLES, CHUNK = 64, 4_000_000, 256
_ATTEMPTS = 2000

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: list[bytes | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text (A-Z in lower case)."""
    index = wb.new_index()
    lens, idx = wb.numbered(texts, index, lower=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in index), np.uint64, len(index))[idx] if len(index) else np.zeros(0, np.uint64)
    at = 0
    for n in lens.tolist():
        own, at = hashes[at : at + n], at + n
        take = max(1, n - width + 1) if n else 0
        out = np.zeros(take, np.uint64)
        for k in range(min(width, n)):
            out = _mixed(out + own[k : k + take] + np.uint64(k + 1))
        yield np.unique(out)


_BINS = BANDS * ROWS
_EDGES = np.array([-(-(j << 64) // _BINS) for j in range(_BINS)], np.uint64)
_DONORS = (_mixed(np.arange(_ATTEMPTS * _BINS, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)) % np.uint64(_BINS)).astype(np.int64).reshape(_ATTEMPTS, _BINS)
_ODD = _mixed(np.arange(1, ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_BAND = _mixed(np.arange(1000, 1000 + BANDS, dtype=np.uint64))


def band_keys(values: np.ndarray) -> np.ndarray:
    """The bucket of each band for a sorted set of hashes that isn't empty."""
    starts = np.searchsorted(values, _EDGES)
    full = np.r_[starts[1:], len(values)] > starts
    source = np.where(full, np.arange(_BINS), -1)
    empty = np.flatnonzero(~full)
    for donors in _DONORS:
        if not len(empty):
            break
        named = donors[empty]
        hit = full[named]
        source[empty[hit]] = named[hit]
        empty = empty[~hit]
    source[empty] = np.flatnonzero(full)[0]
    bins = values[starts[source]].reshape(BANDS, ROWS)
    return _mixed((_mixed(bins) * _ODD).sum(axis=1, dtype=np.uint64) + _BAND).astype(np.int64)


def _digest(values: np.ndarray) -> bytes | None:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest() if len(values) else None


def _signed(batches: Iterator[pa.RecordBatch], width: int, numbered: bool) -> Iterator[pa.RecordBatch]:
    """numbered: doc_id is the row's number already, and the texts are found by it; else rows get one, and keep their text."""
    from pyspark import TaskContext

    row = TaskContext.get().partitionId() << 40
    for table in wb.runs(batches, 8 << 20):
        sizes, digests, keys = [], [], []
        for values in shingle_sets(list(wb.each(table.column("text"))), width):
            sizes.append(len(values))
            digests.append(_digest(values))
            keys.append(band_keys(values) if len(values) else None)
        ids = table.column("doc_id").combine_chunks()
        columns = {"row": ids if numbered else pa.array(np.arange(row, row + len(sizes))), "doc_id": ids, "n_shingles": pa.array(sizes, pa.int64()), "class": pa.array(digests, pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64()))}
        yield pa.RecordBatch.from_pydict(columns if numbered else columns | {"text": table.column("text").combine_chunks()})
        row += len(sizes)


def _stars(batches: Iterator[pa.RecordBatch], threshold: float, most: int = 1_000_000) -> Iterator[pa.RecordBatch]:
    """a (the hub), b (a member), key of rows that come sorted by key and size.

    key is null unless the piece may go on elsewhere: the first and last piece of a task, and pieces
    of over `most` rows, which are given out in parts. Of those the hub is a member as well.
    """
    held, loose = [np.zeros(0, np.int64)] * 3, True

    def out(key: np.ndarray, node: np.ndarray, begins: np.ndarray, first: bool, last: bool) -> pa.RecordBatch:
        lens = np.diff(np.r_[begins, len(node)])
        hub, open_ = np.minimum.reduceat(node, begins), np.zeros(len(begins), bool)
        open_[0], open_[-1] = open_[0] | first, open_[-1] | last
        hub, open_ = np.repeat(hub, lens), np.repeat(open_, lens)
        keep = (hub != node) | open_
        return pa.RecordBatch.from_pydict({"a": pa.array(hub[keep]), "b": pa.array(node[keep]), "key": pa.array(key[keep], mask=~open_[keep])})

    for batch in batches:
        if not batch.num_rows:
            continue
        key, n, node = (np.r_[h, np.asarray(batch.column(k).to_numpy(), np.int64)] for h, k in zip(held, ("key", "n", "node"), strict=True))
        begins = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (n[1:] * threshold > n[:-1] + 1e-9)])
        end = begins[-1]
        if end:
            yield out(key[:end], node[:end], begins[:-1], loose, False)
            loose = False
        held = [x[end:] for x in (key, n, node)]
        if len(held[0]) >= most:
            yield out(held[0], held[2], np.zeros(1, np.int64), True, True)
            held, loose = [np.zeros(0, np.int64)] * 3, True
    if len(held[0]):
        yield out(held[0], held[2], np.zeros(1, np.int64), True, True)


def _checked(batches: Iterator[pa.RecordBatch], width: int, percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (unit, block, chunk), and of each its centres first; every other row is compared with all of them.

    Links are given out where they join labels that no link of the same block and chunk has joined before, so fewer than labels.
    """
    at, centres, sets, joined = None, [], [], {}

    def root(x: int) -> int:
        while (up := joined.get(x, x)) != x:
            joined[x] = x = joined.get(up, up)
        return x

    keys, owners, sizes = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for table in wb.runs(batches, 8 << 20):
        found = {"a": [], "b": []}
        ends = zip(*(table.column(k).to_pylist() for k in ("unit", "block", "chunk", "centre", "node", "label")), shingle_sets(list(wb.each(table.column("text"))), width), strict=True)
        for unit, block, chunk, centre, node, label, values in ends:
            if (unit, block, chunk) != at:
                at, centres, sets, joined, keys = (unit, block, chunk), [], [], {}, None
            if centre:
                centres.append((node, label))
                sets.append(values)
                continue
            if not sets:  # a block that no centre fell into
                continue
            if keys is None:
                flat = np.concatenate(sets)
                order = np.argsort(flat, kind="stable")
                keys, owners, sizes = flat[order], np.repeat(np.arange(len(sets)), [len(x) for x in sets])[order], np.array([len(x) for x in sets])
            low, high = np.searchsorted(keys, values, "left"), np.searchsorted(keys, values, "right")
            many = high - low
            places = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common = np.bincount(owners[places], minlength=len(sizes))
            for k in np.flatnonzero(100 * common >= percent * (sizes + len(values) - common)).tolist():
                if (one := root(centres[k][1])) != (other := root(label)):
                    joined[one] = other
                    found["a"].append(centres[k][0])
                    found["b"].append(node)
        yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in found.items()})


def _confirmed(units: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """a, b: links between the centres and the members of a unit, on the full sets, that join all labels which such links join. units: unit, node, centre, n, label.

    A task holds the sets of CENTRES centres at most, and of so many shingles in all; members go by.
    A unit of more centres has several blocks of them, and one of many members several chunks.
    """
    per = units.groupBy("unit").agg(F.greatest(F.ceil(F.count_if("centre") / CENTRES), F.ceil(F.sum(F.when(F.col("centre"), F.col("n"))) / CENTRE_SHINGLES)).cast("int").alias("blocks"), F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    rows = lookup(units, written(per, "dedup-units"), "unit")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c: F.pmod(F.hash("node"), F.col(c))
    centres = rows.filter("centre").select("unit", place("blocks").alias("block"), upto("chunks").alias("chunk"), "node", "label", "centre")
    members = rows.select("unit", upto("blocks").alias("block"), place("chunks").alias("chunk"), "node", "label", F.lit(False).alias("centre"))
    dealt = centres.union(members).join(texts.withColumnRenamed("row", "node"), "node")
    ordered = dealt.repartition("unit", "block", "chunk").sortWithinPartitions("unit", "block", "chunk", F.desc("centre"))
    return wb.small_batches(ordered).mapInArrow(lambda r: wb.lean(_checked(r, width, percent)), "a long, b long").distinct()


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for table in wb.runs(batches, 8 << 20):
        values = [v.view(np.int64) for v in shingle_sets(list(wb.each(table.column("text"))), width)]
        yield pa.RecordBatch.from_pydict({"node": table.column("node").combine_chunks(), "shingles": pa.array(values, pa.list_(pa.int64()))})


def _refined(open_: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """unit, of: a unit for each shingle that is among the rarest of two members of a unit (now: of) or more."""
    nodes = open_.select("node").distinct().join(texts.withColumnRenamed("row", "node"), "node")
    sets = written(wb.small_batches(nodes).mapInArrow(lambda rows: wb.lean(_sets(rows, width)), "node long, shingles array<long>"), "dedup-rest-sets")
    each = open_.join(sets, "node").select(F.col("unit").alias("of"), "node", "label", "n", F.explode("shingles").alias("s"))
    often = each.groupBy("of", "s").agg(F.count("*").alias("c")).filter("c > 1")
    shared = each.join(often, ["of", "s"]).groupBy("of", "node", "label", "n").agg(F.array_sort(F.collect_list(F.struct("c", "s"))).alias("own"))  # an array of one document's shingles
    alone = F.col("n") - F.size("own")  # these are rarer, and shared with nobody
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - alone
    rows = shared.filter(length > 0).select("of", "node", "label", "n", F.explode(F.slice("own", F.lit(1), length.cast("int"))).alias("x"))
    return rows.select(F.xxhash64("of", "x.s").alias("unit"), "of", "node", "label", "n")


def _undecided(rows: DataFrame) -> DataFrame:
    """unit, top, cost: the label of most members in each unit of several labels, and the rows to be sent for the comparison of all others with its members."""
    per = rows.groupBy("unit", "label").agg(F.count("*").alias("m"))
    tops = per.groupBy("unit").agg(F.max_by("label", F.struct("m", "label")).alias("top"), F.max("m").alias("most"), F.sum("m").alias("m"))
    return tops.filter("most < m").select("unit", "top", (F.col("m") * F.ceil((F.col("m") - F.col("most")) / CENTRES)).alias("cost"))


def _thinned(edges: DataFrame) -> DataFrame:
    """a, b: fewer edges of the same components. Each b stays with its least a, with which its others are linked; edges of stars, so a b has BANDS of them at most."""
    hubs = edges.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("hubs"))
    return hubs.select("a", F.explode(F.array_union("hubs", F.array("b"))).alias("b")).filter("a <> b").distinct()


def _rest(stars: DataFrame, links: DataFrame, classes: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """node, label: the components of the links, and of those between members of the stars that are still to be found."""
    labels = components(_thinned(links))
    named = written(stars.join(labels.withColumnRenamed("node", "b"), "b", "left").select("a", "b", F.coalesce("label", "b").alias("label")), "dedup-named")
    own = stars.select("a").distinct().join(labels.select(F.col("node").alias("a"), F.col("label").alias("own")), "a", "left").withColumn("own", F.coalesce("own", "a"))
    ends = named.groupBy("a").agg(F.min("label").alias("low"), F.max("label").alias("high")).join(own, "a")
    hubs = written(ends.filter("low <> own OR high <> own").select("a"), "dedup-open")
    if hubs.isEmpty():
        return labels
    groups = components(_thinned(lookup(named, hubs, "a").select("a", "b"))).toDF("node", "unit")
    rows = groups.join(labels, "node", "left").join(classes.select("node", "n"), "node").select("unit", "node", F.coalesce("label", "node").alias("label"), "n")
    rows = written(rows, "dedup-rest")
    whole = written(_undecided(rows), "dedup-rest-groups")
    fine = written(_refined(lookup(rows, whole, "unit").select("unit", "node", "label", "n"), texts, width, percent), "dedup-rest-shingles")
    parts = written(_undecided(fine), "dedup-rest-units")
    cost = fine.select("unit", "of").distinct().join(parts, "unit").groupBy("of").agg(F.sum("cost").alias("fine_cost")).withColumnRenamed("of", "unit")
    best = whole.join(cost, "unit", "left").withColumn("fine_cost", F.coalesce("fine_cost", F.lit(0)))
    whole_ones, fine_ones = best.filter("cost <= fine_cost").select("unit", "top"), best.filter("cost > fine_cost").select(F.col("unit").alias("of"))
    chosen = lookup(rows, written(whole_ones, "dedup-rest-whole"), "unit").select("unit", "node", "n", "label", (F.col("label") != F.col("top")).alias("centre"))
    small = lookup(lookup(fine, written(fine_ones, "dedup-rest-fine"), "of"), parts, "unit")
    chosen = written(chosen.union(small.select("unit", "node", "n", "label", (F.col("label") != F.col("top")).alias("centre"))), "dedup-rest-chosen")
    return components(labels.select(F.col("label").alias("a"), F.col("node").alias("b")).union(_confirmed(chosen, texts, width, percent)))


def near_duplicates(docs: DataFrame, width: int = 5, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text", numbered: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links are sets with 100 * common >= 100 * threshold * union.

    numbered: the ids are numbers, none null or twice, and docs is a written table; its texts needn't be written again.
    """
    percent, id_type = round(100 * threshold), docs.schema[id_col].dataType.simpleString()
    chosen = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"row long, doc_id {id_type}, n_shingles long, class binary, bands array<long>" + (", text string" if not numbered else "")
    signed = written(wb.small_batches(chosen).mapInArrow(lambda b: wb.lean(_signed(b, width, numbered)), schema), "dedup-sets")
    filled, texts = signed.filter("class IS NOT NULL"), chosen.toDF("row", "text") if numbered else signed.select("row", "text")
    classes = written(filled.groupBy("class").agg(F.min("row").alias("node"), F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")), "dedup-classes")
    dealt = classes.select(F.explode("bands").alias("key"), "n", "node").repartitionByRange("key", "n", "node").sortWithinPartitions("key", "n", "node")
    pieces = written(dealt.mapInArrow(lambda b: wb.lean(_stars(b, threshold)), "a long, b long, key long"), "dedup-pieces")
    # Pieces at the ends of tasks get the least hub of their key: two keys a task at most, and one for a million rows.
    whole = F.broadcast(pieces.filter("key IS NOT NULL").groupBy("key").agg(F.min("a").alias("least")))
    stars = pieces.join(whole, "key", "left").select(F.coalesce("least", "a").alias("a"), "b").filter("a <> b").distinct()
    stars = written(stars, "dedup-stars")
    of_hub = stars.select(F.col("a").alias("unit"), F.col("b").alias("node"), F.lit(False).alias("centre")).union(stars.select("a", "a", F.lit(True)).distinct())
    units = written(of_hub.join(classes.select("node", "n"), "node").select("unit", "node", "centre", "n"), "dedup-star-units")
    links = written(_confirmed(units.withColumn("label", F.col("node")), texts, width, percent), "dedup-links")
    labels = _rest(stars, links, classes, texts, width, percent)
    joined = written(labels.join(classes.select("node", "rep"), "node"), "dedup-labels")
    least = joined.groupBy("label").agg(F.min("rep").alias("component_id"))
    linked_to = lookup(joined, least, "label").select("node", "component_id")
    named = classes.select("class", "node", "rep").join(linked_to, "node", "left").select("class", F.coalesce("component_id", "rep").alias("component_id"))
    with_set = lookup(filled.select("doc_id", "n_shingles", "class"), named, "class").select("doc_id", "n_shingles", "component_id")
    without = signed.filter("class IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    kept = F.col("component_id").isNull() | F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))
    return with_set.union(without).withColumn("kept", kept)
