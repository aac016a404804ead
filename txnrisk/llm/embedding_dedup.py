"""Near-duplicate embeddings by random-hyperplane signs and exact cosines.

Equal vectors collapse first.  Each distinct vector gets a ``bits``-bit sign
key in each of several tables; vectors that share a key in some table are
compared exactly, in double precision.  ``bits`` grows with the logarithm of
the number of vectors and the number of tables follows from it, so that a pair
exactly at the threshold is met with probability ``recall``; closer pairs are
met more surely.  A bucket of any size is compared in full: it is cut into
blocks and every pair of blocks is a task of its own.  Only buckets with two
vectors or more ever carry vectors through a shuffle.

Defined cases: a vector that is null, empty, zero or holds null or non-finite
components links with nothing; vectors of different lengths never link; rows
with a null vec_id are returned with no links and a null component; rows
repeated under one vec_id are one vector (each row is returned); an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from txnrisk.llm.common import staged
from txnrisk.llm.components import connected_components

#: Vectors of one bucket compared with as many others at a time.
BLOCK_ROWS = 512


def plan_tables(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Sign bits per key and number of tables for ``n`` vectors."""
    bits = min(max(8, math.ceil(math.log2(max(n, 2)))), 62)
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def sign_keys(vectors: np.ndarray, bits: int, tables: int, seed: int) -> np.ndarray:
    """One key per row and table."""
    planes = np.random.default_rng(seed + vectors.shape[1]).standard_normal((vectors.shape[1], bits * tables))
    signs = (vectors @ planes >= 0).reshape(len(vectors), tables, bits)
    return signs @ (np.int64(1) << np.arange(bits, dtype=np.int64))


def _matrix(blobs) -> np.ndarray:
    return np.stack([np.frombuffer(b, np.float64) for b in blobs])


def usable(rows: DataFrame) -> DataFrame:
    """(vec_id, embedding): one row per usable vector."""
    x = F.col("embedding")
    good = rows.where(
        F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0)
        & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
        & F.exists(x, lambda v: v != 0))
    # -0.0 and 0.0 are equal components
    return good.select("vec_id", F.transform(x, lambda v: v + F.lit(0.0)).alias("embedding")).distinct()


def distinct_vectors(vectors: DataFrame) -> DataFrame:
    """(node, copies, dim, vec): equal vectors once, under their smallest id;
    ``vec`` holds the unit vector's doubles as bytes."""
    classes = vectors.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count(F.lit(1)).alias("copies"))

    def unit(batches):
        for batch in batches:
            parts = [np.array(v, dtype=np.float64) for v in batch.column("embedding").to_pylist()]
            parts = [v / np.abs(v).max() for v in parts]  # no overflow or underflow in the squares
            yield pa.record_batch({
                "node": batch.column("node"), "copies": batch.column("copies"),
                "dim": pa.array([len(v) for v in parts], pa.int32()),
                "vec": pa.array([(v / np.sqrt(v @ v)).tobytes() for v in parts], pa.binary())})

    return classes.select("node", "copies", "embedding").mapInArrow(unit, "node long, copies long, dim int, vec binary")


def bucket_rows(vectors: DataFrame, bits: int, tables: int, seed: int) -> DataFrame:
    """(node, dim, tbl, key) for every vector and table."""

    def emit(batches):
        for batch in batches:
            node, dim = batch.column("node").to_numpy(), batch.column("dim").to_numpy()
            blobs = batch.column("vec").to_pylist()
            for d in np.unique(dim):
                at = np.flatnonzero(dim == d)
                keys = sign_keys(_matrix([blobs[i] for i in at]), bits, tables, seed)
                yield pa.record_batch({
                    "node": pa.array(np.repeat(node[at], tables)), "dim": pa.array(np.full(keys.size, d, dtype=np.int32)),
                    "tbl": pa.array(np.tile(np.arange(tables, dtype=np.int32), len(at))), "key": pa.array(keys.ravel())})

    return vectors.select("node", "dim", "vec").mapInArrow(emit, "node long, dim int, tbl int, key long")


def block_links(rows: DataFrame, bits: int, tables: int, seed: int, threshold: float) -> DataFrame:
    """Per pair of blocks: (node, links, head): linked vectors counted with
    their copies, and the smallest node of the block's linked cluster."""

    def compare(key, table):
        tbl, low, high = key[1].as_py(), key[3].as_py(), key[4].as_py()
        node, copies, block = (table.column(c).to_numpy() for c in ("node", "copies", "block"))
        vec = _matrix(b.as_py() for b in table.column("vec"))
        left = np.flatnonzero(block == low)
        right = left if low == high else np.flatnonzero(block == high)
        near = vec[left] @ vec[right].T >= threshold
        if low == high:
            np.fill_diagonal(near, False)
        if near.any() and tbl:  # a pair counts in the first table in which it meets
            keys = sign_keys(vec, bits, tables, seed)[:, :tbl]
            for i in np.flatnonzero(near.any(axis=1)):
                j = np.flatnonzero(near[i])
                near[i, j] = ~(keys[right[j]] == keys[left[i]]).any(axis=1)
        links = np.zeros(len(node), dtype=np.int64)
        np.add.at(links, left, near @ copies[right])
        if low != high:
            np.add.at(links, right, near.T @ copies[left])
        a, b = np.nonzero(near)
        a, b = left[a], right[b]
        head = node.copy()
        while len(a):  # smallest node through the block's links
            least = np.minimum(head[a], head[b])
            if (least == head[a]).all() and (least == head[b]).all():
                break
            np.minimum.at(head, a, least)
            np.minimum.at(head, b, least)
        out = np.flatnonzero(links > 0)
        return pa.table({"node": pa.array(node[out]), "links": pa.array(links[out]), "head": pa.array(head[out])})

    return (rows.groupBy("dim", "tbl", "key", "low", "high")
            .applyInArrow(compare, "node long, links long, head long"))


def embedding_links(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.95,
                    recall: float = 0.97, seed: int = 7) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    single = staged(usable(rows), "usable")
    vectors = staged(distinct_vectors(single), "vectors")
    bits, tables = plan_tables(vectors.count(), threshold, recall)
    keyed = staged(bucket_rows(vectors, bits, tables, seed), "keyed")
    crowded = staged(keyed.groupBy("dim", "tbl", "key").agg(F.count(F.lit(1)).alias("c")).where("c > 1"), "crowded")
    met = keyed.join(crowded, ["dim", "tbl", "key"]).withColumn("blocks", F.ceil(F.col("c") / BLOCK_ROWS).cast("int"))
    own = F.pmod(F.xxhash64("node", "tbl"), F.col("blocks")).cast("int")
    met = (met.withColumn("block", own)
           .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .select("node", "dim", "tbl", "key", "block", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high")))
    met = met.join(vectors.select("node", "copies", "vec"), "node")
    found = staged(block_links(met, bits, tables, seed, threshold), "found")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    parts = connected_components(found.select(F.col("node").alias("u"), F.col("head").alias("v")))
    verdict = staged(vectors.select("node", "copies").join(links, "node", "left").join(parts, "node", "left")
                     .select("node", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                             F.coalesce("component", "node").alias("component_id")), "verdict")
    classes = single.groupBy("embedding").agg(F.min("vec_id").alias("node"))
    member = staged(single.join(classes, "embedding").select("vec_id", "node"), "member")
    out = rows.select("vec_id").join(member, "vec_id", "left").join(verdict, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
