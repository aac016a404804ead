"""Ranked lexical search by pipelined term partitioning.

The documents are indexed in blocks: per block and term one row with the
positions of the documents that hold the term, their term counts and lengths.
Terms are dealt to a fixed number of owners.  Items travel in bundles: for
every block a bundle visits one term owner after the other, carrying a sparse
accumulator (positions and integer scores) per item.  At each owner a cogroup
brings the bundle together with the owner's postings for its terms; the last
owner keeps each item's best documents of the block, and a ranked window over
those gives the item's best of all.

Only terms that some item holds are indexed: a bitmap of fixed size (2**20
slots, one bit of hash each) lets every such term pass, and a join by the term
itself drops the rest.  Nothing else is sent to all tasks but two numbers.
The sizes of blocks, bundles and owners' shares bound a task's memory,
whatever the number of documents or items.

Scores are exact integers: see ``impact``.

Defined cases: a null text holds no terms; a document without terms is in no
count and no result; documents without an id count in all statistics and are
ranked, after equal scores with an id, under a null id; rows that share a
doc_id are documents of their own; rows that share an item_id (null included)
are one item with all their terms; items without terms or without a document
of score above 0 have no rows; empty tables give an empty result; other
columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F, types as T

from txnrisk.llm.common import LOWER, staged, text_chunks, word_hashes

#: Slots of the bitmap that lets item terms pass.
SLOT_BITS = 20
#: Documents of a block at most, and postings held for one while it is built.
BLOCK_DOCS = 16384
BLOCK_POSTINGS = 4_000_000
#: Terms of a bundle about, and of a bundle's share at one owner.
BUNDLE_TERMS = 1024
OWNERS = 4

_IN_TERM = np.zeros(256, dtype=bool)
_IN_TERM[0x30:0x3A] = _IN_TERM[0x41:0x5B] = _IN_TERM[0x61:0x7B] = True
_IN_TERM[0x80:] = True


def _terms(data: np.ndarray, offsets: np.ndarray):
    """(lower-cased bytes, term starts, term ends, each row's first term): terms are maximal runs of digits, ASCII
    letters and code points from 0x80 on; only A-Z are lower-cased."""
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IN_TERM[data]
    start, end = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] |= inside[1:-1][edges]
    end[edges - 1] |= inside[1:-1][edges - 1]
    starts = np.flatnonzero(start)
    return LOWER[data], starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _row_terms(data, offsets, passing=None):
    """Counts of the terms of each row: (row, term bytes index, tf), the terms' bytes, and each row's number of terms.
    With ``passing`` only terms whose slot is set are told apart."""
    data, starts, ends, first = _terms(data, offsets)
    lengths = np.diff(first)
    if not len(starts):
        return np.zeros((3, 0), np.int64), [], lengths
    hashes = word_hashes(data, starts, ends, seed=41)
    rows = np.repeat(np.arange(len(lengths)), lengths)
    if passing is not None:
        at = np.flatnonzero(passing[_slots(hashes)])
        starts, ends, hashes, rows = starts[at], ends[at], hashes[at], rows[at]
        if not len(at):
            return np.zeros((3, 0), np.int64), [], lengths
    other = word_hashes(data, starts, ends, seed=43)  # with the first one 128 bits, to tell terms apart
    order = np.lexsort((rows, other, hashes))
    hashes, other, rows = hashes[order], other[order], rows[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (other[1:] != other[:-1])
    term = np.cumsum(new) - 1
    words = [data[starts[i]:ends[i]].tobytes() for i in order[new]]
    new[1:] |= rows[1:] != rows[:-1]
    at = np.flatnonzero(new)
    return np.stack([rows[at], term[at], np.diff(at, append=len(order))]), words, lengths


# ----------------------------------------------------------------------- items
def item_terms(items: DataFrame) -> DataFrame:
    """(item, term, slot, times) of ``items`` (item, text): occurrences of each term over the item's rows."""

    def emit(batches):
        for batch in batches:
            for lo, data, offsets in text_chunks(batch.column("text")):
                (rows, term, tf), words, _ = _row_terms(data, offsets)
                if not len(words):
                    continue
                sizes = np.array([len(w) for w in words])
                joined, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum(sizes)
                slots = _slots(word_hashes(joined, ends - sizes, ends, seed=41))
                yield pa.record_batch({"item": batch.column("item").take(pa.array(rows + lo)),
                                       "term": pa.array(words, pa.binary()).take(pa.array(term)),
                                       "slot": pa.array(slots[term], pa.int32()), "times": pa.array(tf)})

    schema = T.StructType([items.schema["item"], *T.StructType.fromDDL("term binary, slot int, times long").fields])
    return (items.select("item", "text").mapInArrow(emit, schema)
            .groupBy("item", "term").agg(F.first("slot").alias("slot"), F.sum("times").alias("times")))


def bundled(terms: DataFrame) -> DataFrame:
    """(item, bundle, place): items in bundles of about ``BUNDLE_TERMS`` terms, numbered inside each."""
    sizes = terms.groupBy("item").agg(F.count(F.lit(1)).alias("n"))
    row = sizes.agg(F.sum("n").alias("n")).first()
    bundles = max(1, math.ceil((row.n or 0) / BUNDLE_TERMS))
    placed = sizes.select("item", F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle"))
    return placed.select("item", "bundle", (F.row_number().over(Window.partitionBy("bundle").orderBy("item")) - 1).alias("place"))


def _placed(terms: DataFrame, bundles: DataFrame) -> DataFrame:
    """``terms`` with their item's bundle and place; a null item is an item too."""
    own = bundles.withColumnRenamed("item", "own")
    return terms.join(own, F.col("item").eqNullSafe(F.col("own"))).drop("own")


# ----------------------------------------------------------------------- index
INDEX = "block long, term binary, n_docs long, n_terms long, places binary, tfs binary, lengths binary, ids array<long>"


def index_blocks(docs: DataFrame, passing: np.ndarray, block_docs: int) -> DataFrame:
    """The index of ``docs`` (doc_id, text).  A row with a term holds its postings in one block; the row without one
    holds the block's ids by place (in order of ids, so equal scores rank by place), its documents with a term and
    their terms."""
    mask = docs.sparkSession.sparkContext.broadcast(np.packbits(passing))

    def flush(block, ids, lengths, found):
        ids, lengths = pa.chunked_array(ids).combine_chunks(), np.concatenate(lengths)
        order = pa.compute.sort_indices(ids, null_placement="at_end").to_numpy()
        place = np.empty(len(order), dtype=np.int64)
        place[order] = np.arange(len(order))
        parts = {}
        for words, rows, term, tf in found:
            cuts = np.flatnonzero(np.diff(term, prepend=-1))
            for a, b in zip(cuts, [*cuts[1:], len(term)]):
                parts.setdefault(words[term[a]], []).append((rows[a:b], tf[a:b]))
        columns = {"block": [block], "term": [None], "n_docs": [int((lengths > 0).sum())], "n_terms": [int(lengths.sum())],
                   "places": [None], "tfs": [None], "lengths": [None], "ids": [ids.take(pa.array(order)).to_pylist()]}
        for word, pieces in parts.items():
            rows, tf = (np.concatenate(x) for x in zip(*pieces))
            row = (block, word, len(rows), int(tf.sum()), place[rows].astype("<u2").tobytes(), tf.astype("<u4").tobytes(),
                   lengths[rows].astype("<u4").tobytes(), None)
            for held, value in zip(columns.values(), row):
                held.append(value)
        return pa.record_batch({c: pa.array(v, t) for (c, v), t in zip(columns.items(), (
            pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())))})

    def emit(batches):
        passing = np.unpackbits(mask.value).astype(bool)
        block, n, postings = TaskContext.get().partitionId() << 32, 0, 0
        ids, lengths, found = [], [], []
        for batch in batches:
            for lo, data, offsets in text_chunks(batch.column("text"), max_rows=min(4096, block_docs)):
                (rows, term, tf), words, size = _row_terms(data, offsets, passing)
                if n and (n + len(size) > block_docs or postings + len(rows) > BLOCK_POSTINGS):
                    yield flush(block, ids, lengths, found)
                    block, n, postings, ids, lengths, found = block + 1, 0, 0, [], [], []
                ids.append(batch.column("doc_id").slice(lo, len(size)))
                lengths.append(size)
                found.append((words, rows + n, term, tf))
                n, postings = n + len(size), postings + len(rows)
        if n:
            yield flush(block, ids, lengths, found)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(emit, INDEX)


# ---------------------------------------------------------------------- search
def impact(tf: np.ndarray, length: np.ndarray, n: int, total: int) -> np.ndarray:
    """A term's part of a document's score before its weight, in whole numbers."""
    m = 25 + (75 * length * n) // total
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


_CARRIED = "block long, bundle int, item_place int, places binary, scores binary"
_BEST = "block long, bundle int, item_place int, place int, score long"


def _visit(block_docs: int, n: int, total: int, best: int | None):
    """What happens at one term owner; with ``best`` it is the last one and only the best documents go on."""

    def visit(key, carried, postings):
        parts, score = {}, np.zeros(block_docs, dtype=np.int64)
        for item, places, scores in zip(*(carried.column(c).to_pylist() for c in ("item_place", "places", "scores"))):
            parts[item] = [(np.frombuffer(places, "<u2"), np.frombuffer(scores, "<i8"), 1)]
        for p, tf, length, items in zip(*(postings.column(c).to_pylist() for c in ("places", "tfs", "lengths", "items"))):
            p, tf, length = np.frombuffer(p, "<u2"), *(np.frombuffer(x, "<u4").astype(np.int64) for x in (tf, length))
            part = impact(tf, length, n, total)
            for x in items:
                parts.setdefault(x["place"], []).append((p, part, x["weight"]))
        out = {"item_place": [], "places": [], "scores": []}
        for item, own in parts.items():
            score[:] = 0
            for p, part, weight in own:
                score[p] += part * weight
            places = np.flatnonzero(score)
            if best is not None and len(places) > best:
                least = np.partition(score[places], -best)[-best]
                places = places[score[places] >= least]
                places = np.sort(places[np.argsort(-score[places], kind="stable")[:best]])
            if len(places):
                out["item_place"].append(item)
                out["places"].append(places)
                out["scores"].append(score[places])
        block, bundle = (pa.scalar(k.as_py()) for k in key)
        if best is None:
            rows = {"item_place": pa.array(out["item_place"], pa.int32()),
                    "places": pa.array([x.astype("<u2").tobytes() for x in out["places"]], pa.binary()),
                    "scores": pa.array([x.tobytes() for x in out["scores"]], pa.binary())}
        else:
            sizes = [len(x) for x in out["places"]]
            rows = {"item_place": pa.array(np.repeat(np.array(out["item_place"], np.int32), sizes), pa.int32()),
                    "place": pa.array(np.concatenate([[], *out["places"]]).astype(np.int32)),
                    "score": pa.array(np.concatenate([np.zeros(0, np.int64), *out["scores"]]))}
        size = len(rows["item_place"])
        return pa.table({"block": pa.array([block.as_py()] * size, pa.int64()), "bundle": pa.array([bundle.as_py()] * size, pa.int32()), **rows})

    return visit


def _empty(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def search(items: DataFrame, docs: DataFrame, k: int = 10, item_id: str = "item_id", item_text: str = "text",
           doc_id: str = "doc_id", doc_text: str = "text", owners: int = OWNERS) -> DataFrame:
    """The ``k`` best documents of every item: item_id, rank, doc_id, score (columns under the given id names)."""
    spark = docs.sparkSession
    items = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    result = T.StructType([T.StructField(item_id, items.schema["item"].dataType), *T.StructType.fromDDL(f"rank int, {doc_id} long, score long")])
    terms = staged(item_terms(items), "item_terms")
    # At most 2**SLOT_BITS numbers, whatever the items.
    slots = [r.slot for r in terms.select("slot").distinct().collect()]
    if not slots:
        return _empty(spark, result)
    passing = np.zeros(1 << SLOT_BITS, dtype=bool)
    passing[slots] = True
    bundles = staged(bundled(terms), "bundles")
    # The largest bundle's terms at one owner and the documents of a block bound a group.
    largest = _placed(terms, bundles).groupBy("bundle").agg(F.count_distinct("term").alias("n")).agg(F.max("n")).first()[0]
    block_docs = int(min(BLOCK_DOCS, max(256, BLOCK_DOCS * (BUNDLE_TERMS // OWNERS) * 2 // max(1, largest // owners))))
    index = staged(index_blocks(docs, passing, block_docs), "index")
    postings, blocks = index.where("term IS NOT NULL"), index.where("term IS NULL")
    whole = blocks.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("total")).first()
    if not whole.total:
        return _empty(spark, result)
    held = postings.groupBy("term").agg(F.sum("n_docs").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(whole.n) + 2) / (2 * F.col("df") + 1)))
    weighted = (_placed(terms.join(held, "term").withColumn("weight", weight * F.col("times")).where("weight > 0"), bundles)
                .groupBy("term", "bundle").agg(F.collect_list(F.struct("place", "weight")).alias("items"))
                .withColumn("owner", F.pmod(F.xxhash64("term"), F.lit(owners)).cast("int")))
    weighted = staged(weighted, "weighted")
    carried = None
    for owner in range(owners):
        share = (postings.join(weighted.where(F.col("owner") == owner), "term")
                 .select("block", "bundle", "places", "tfs", "lengths", "items").groupBy("block", "bundle"))
        last = owner == owners - 1
        visit = _visit(block_docs, whole.n, whole.total, k if last else None)
        if carried is None:  # no accumulators yet
            carried = _empty(spark, _CARRIED)
        carried = carried.groupBy("block", "bundle").cogroup(share).applyInArrow(visit, _BEST if last else _CARRIED)
    best = staged(carried, "best")
    ids = blocks.select("block", F.posexplode("ids").alias("place", "doc_id"))
    ranked = best.join(ids, ["block", "place"]).withColumnRenamed("place", "doc_place")
    order = Window.partitionBy("bundle", "item_place").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "block", "doc_place")
    ranked = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return (ranked.join(bundles.withColumnRenamed("place", "item_place"), ["bundle", "item_place"])
            .select(F.col("item").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score"))
