"""Hard-negative mining by angular triangle filtering.

Vectors are quantised to integers, and each stores its angles to a few
reference directions and its norm.  By the triangle inequality of angles, the
angle between two vectors is at least every |a - b| and at most every a + b
(or 2 pi less that) of their angles a, b to one reference; the cosines of these
ends, times both norms and widened beyond any rounding, bound the integer inner
product.  Only rows whose bounds overlap an anchor's score window get their
exact integer score.

Anchors are compared with all rows in blocks: rows are dealt to blocks by their
nearest reference, anchors to bundles likewise, and the same bounds taken over
the ranges of a bundle's and a block's angles and norms tell which blocks a
bundle opens.  Blocks are opened in rounds, nearest first and eight times as
many in each round as in all before; what a round finds narrows the windows of
the next, so far blocks are seldom opened.

``search_windows`` keeps, per anchor and window, the ``k`` best scored rows of
the anchor's label (or of other labels) inside the window.

Defined cases: rows with a null id, label or vector, an empty vector, or a null
or non-finite component take no part, nor do rows whose quantised squared norm
is 2**56 or more (a hundred times their scores would not fit 64 bits); vectors
of different lengths are never compared; rows equal in id, label and vector
are one; rows that share an id only are rows of their own, but never partners
of each other; zero vectors score 0; empty tables give an empty result; other
columns are left out.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from txnrisk.llm.common import staged

REFERENCES = 16
#: The references are fitted on at most so many rows.
FIT_ROWS = 2048
#: Rows of a block and anchors of a bundle, about.
BLOCK_ROWS = 4096
BUNDLE_ANCHORS = 1024
#: Blocks opened in the first round; each later round opens up to eight times as many.
FIRST_BLOCKS = 4
#: Angles are kept as 32-bit floats: far above their error, in radians.
SLACK = 1e-6
_ALL = 1 << 60


def participants(rows: DataFrame) -> DataFrame:
    """(vec_id, label, embedding): rows that take part, equal rows once."""
    x = F.col("embedding")
    return (rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & (F.size(x) > 0)
                       & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))))
            .select("vec_id", "label", F.transform(x, lambda v: v + F.lit(0.0)).alias("embedding")).distinct())


def quantised(vectors: np.ndarray) -> np.ndarray:
    return np.floor(256.0 * vectors)


def _units(q: np.ndarray) -> np.ndarray:
    norms = np.sqrt((q * q).sum(axis=1))
    return q / np.where(norms == 0, 1, norms)[:, None]


def fit_references(sample: np.ndarray, count: int = REFERENCES, rounds: int = 6) -> np.ndarray:
    """Unit directions: centres of clusters of the sample by angle; random ones where the sample has too few rows."""
    draw = np.random.default_rng(17 + sample.shape[1])
    centres = draw.standard_normal((count, sample.shape[1]))
    units = _units(quantised(sample))
    units = np.unique(units[(units != 0).any(axis=1)], axis=0)
    centres[:min(count, len(units))] = units[draw.permutation(len(units))[:count]]
    for _ in range(rounds if len(units) > count else 0):
        near = (units @ centres.T).argmax(axis=1)
        for c in range(count):
            if (near == c).any() and (total := units[near == c].sum(axis=0)).any():
                centres[c] = total / np.sqrt(total @ total)
    return centres / np.sqrt((centres * centres).sum(axis=1))[:, None]


PACKED = "vec_id long, label long, row long, dim int, cell int, norm double, angles array<float>, q binary"


def pack(rows: DataFrame, references: dict[int, np.ndarray]) -> DataFrame:
    """Quantised rows with their norm, angles to the references, and nearest reference."""
    known = rows.sparkSession.sparkContext.broadcast(references)

    def emit(batches):
        for batch in batches:
            column = batch.column("embedding")
            sizes = np.diff(column.offsets.to_numpy())
            starts, flat = column.offsets.to_numpy()[:-1], column.values.to_numpy()
            for dim in np.unique(sizes):
                at = np.flatnonzero(sizes == dim)
                with np.errstate(over="ignore"):
                    q = quantised(flat[starts[at][:, None] + np.arange(dim)])
                    squares = (q * q).sum(axis=1)
                at, q, squares = (x[squares < 2.0**56] for x in (at, q, squares))
                refs = known.value.get(int(dim))
                if refs is None:
                    refs = fit_references(np.zeros((0, int(dim))))
                angles = np.arccos(np.clip(_units(q) @ refs.T, -1, 1)).astype(np.float32)
                yield pa.record_batch({
                    **{c: batch.column(c).take(pa.array(at)) for c in ("vec_id", "label", "row")},
                    "dim": pa.array(np.full(len(at), dim, np.int32)), "cell": pa.array(angles.argmin(axis=1).astype(np.int32)),
                    "norm": pa.array(np.sqrt(squares)), "angles": pa.FixedSizeListArray.from_arrays(pa.array(angles.ravel()), REFERENCES).cast(pa.list_(pa.float32())),
                    "q": pa.array([v.tobytes() for v in q.astype("<i4")], pa.binary())})

    return (rows.select("vec_id", F.col("label").cast("long").alias("label"), F.xxhash64("vec_id", "label", "embedding").alias("row"), "embedding")
            .mapInArrow(emit, PACKED))


def _dealt(rows: DataFrame, size: int, name: str, merge: bool) -> DataFrame:
    """``rows`` with a group id of about ``size`` rows of one nearest reference.  With ``merge``, references with few
    rows share a group."""
    counts = rows.groupBy("dim", "cell").agg(F.count(F.lit(1)).alias("n"))  # a row per length and reference
    if merge:
        groups = F.least(F.ceil(F.sum("n").over(Window.partitionBy("dim")) / size), F.lit(REFERENCES))
        counts = counts.withColumn("part", F.floor(F.col("cell") * groups / REFERENCES))
    else:
        counts = counts.withColumn("part", F.col("cell"))
    counts = counts.withColumn("parts", F.ceil(F.sum("n").over(Window.partitionBy("dim", "part")) / size)).drop("n")
    group = F.xxhash64("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")))
    return rows.join(counts, ["dim", "cell"]).withColumn(name, group).drop("part", "parts", "cell")


def _ranges(rows: DataFrame, name: str) -> DataFrame:
    """Per group: the least and largest norm and angles."""
    each = [f(F.col("angles")[r]) for f in (F.min, F.max) for r in range(REFERENCES)]
    return rows.groupBy("dim", name).agg(F.array(F.min("norm"), F.max("norm")).alias("norms"),
                                         F.array(*each[:REFERENCES]).alias("least"), F.array(*each[REFERENCES:]).alias("most"))


def _scores_between(near, far, least_norms, most_norms):
    """Bounds of a product of norms times the cosine of an angle between ``near`` and ``far``, safe from rounding."""
    top, low = np.cos(np.maximum(near - SLACK, 0)), np.cos(np.minimum(far + SLACK, math.pi))
    slack = 1 + 1e-9 * most_norms
    return (np.where(low >= 0, least_norms, most_norms) * low - slack, np.where(top >= 0, most_norms, least_norms) * top + slack)


def block_pairs(bundles: DataFrame, blocks: DataFrame) -> DataFrame:
    """(dim, bundle, block, low, high, turn): score bounds of every bundle against every block of its length, and the
    block's turn by nearness.  Both sides are cut into slots, and every two slots meet in one group."""
    def slots(n):
        return max(1, math.ceil(n / 2048))

    i, j = slots(bundles.count()), slots(blocks.count())
    left = bundles.withColumn("i", F.pmod(F.xxhash64("bundle"), F.lit(i))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(j - 1))))
    right = blocks.withColumn("j", F.pmod(F.xxhash64("block"), F.lit(j))).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(i - 1))))

    def bound(key, a, b):
        def matrix(table, name):
            return np.array(table.column(name).to_pylist(), dtype=np.float64)

        if not len(a) or not len(b):
            return pa.table({c: pa.array([], t) for c, t in (("dim", pa.int32()), ("bundle", pa.int64()), ("block", pa.int64()),
                                                             ("low", pa.float64()), ("high", pa.float64()), ("near", pa.float64()))})
        (an, al, am), (bn, bl, bm) = ([matrix(t, c) for c in ("norms", "least", "most")] for t in (a, b))
        near, far = np.zeros((len(a), len(b))), np.full((len(a), len(b)), math.pi)
        for r in range(REFERENCES):
            near = np.maximum(near, np.maximum(bl[:, r] - am[:, r, None], al[:, r, None] - bm[:, r]))
            first, last = al[:, r, None] + bl[:, r], am[:, r, None] + bm[:, r]
            reach = np.where((first <= math.pi) & (last >= math.pi), math.pi,
                             np.maximum(np.minimum(first, 2 * math.pi - first), np.minimum(last, 2 * math.pi - last)))
            far = np.minimum(far, reach)
        low, high = _scores_between(near, far, an[:, :1] * bn[:, 0], an[:, 1:] * bn[:, 1])
        ids = [np.array(t.column(c).to_pylist(), np.int64) for t, c in ((a, "bundle"), (b, "block"))]
        return pa.table({"dim": pa.array(np.full(near.size, key[0].as_py(), np.int32)), "bundle": np.repeat(ids[0], len(b)),
                         "block": np.tile(ids[1], len(a)), "low": low.ravel(), "high": high.ravel(), "near": near.ravel()})

    met = (left.groupBy("dim", "i", "j").cogroup(right.groupBy("dim", "i", "j"))
           .applyInArrow(bound, "dim int, bundle long, block long, low double, high double, near double"))
    turn = Window.partitionBy("dim", "bundle").orderBy("near", F.desc("high"), "block")
    return met.withColumn("turn", F.row_number().over(turn) - 1).drop("near")


_FOUND = "anchor_id long, anchor_row long, window int, vec_id long, score long"


def _open_block(k: int, same_label: bool):
    """Exact scores of a block's rows that may fall into the windows of a bundle's anchors; the ``k`` best per window."""

    def columns(table):
        dim = len(table.column("q")[0].as_py()) // 4
        q = np.frombuffer(b"".join(table.column("q").to_pylist()), "<i4").reshape(-1, dim)
        angles = table.column("angles").combine_chunks().flatten().to_numpy().reshape(len(table), -1)
        return q, angles, *(table.column(c).to_numpy() for c in ("norm", "label", "vec_id"))

    def opened(key, anchors, rows):
        found = {c: [] for c in ("anchor_id", "anchor_row", "window", "vec_id", "score")}
        if len(anchors) and len(rows):
            aq, aa, an, al, ai = columns(anchors)
            bq, ba, bn, bl, bi = columns(rows)
            whole = np.float64 if an.max() * bn.max() < 2.0**52 else np.int64  # either way exact
            aq, bq, row = aq.astype(whole), bq.astype(whole), anchors.column("row").to_numpy()
            windows = anchors.column("windows").to_pylist()
            for label in np.unique(al):
                own = np.flatnonzero(bl == label if same_label else bl != label)
                some = np.flatnonzero(al == label)
                for part in np.array_split(some, math.ceil(len(some) / 64)) if len(own) else []:
                    near, far = np.zeros((len(part), len(own)), np.float32), np.full((len(part), len(own)), math.pi, np.float32)
                    for r in range(REFERENCES):
                        a, b = aa[part, r][:, None], ba[own, r]
                        np.maximum(near, np.abs(a - b), out=near)
                        s = a + b
                        np.minimum(far, np.minimum(s, np.float32(2 * math.pi) - s), out=far)
                    norms = an[part][:, None] * bn[own]
                    low, high = _scores_between(near.astype(np.float64), far.astype(np.float64), norms, norms)
                    least = np.array([min(w["low"] for w in windows[i]) for i in part], np.float64)[:, None]
                    most = np.array([max(w["high"] for w in windows[i]) for i in part], np.float64)[:, None]
                    wanted = (high >= least) & (low <= most) & (bi[own] != ai[part][:, None])
                    for i, hits in zip(part, wanted):
                        at = own[hits]
                        score = (bq[at] @ aq[i]).astype(np.int64)
                        for w in windows[i]:
                            inside = np.flatnonzero((score >= w["low"]) & (score <= w["high"]))
                            if len(inside) > k:  # equal scores at the k-th place stay until ids decide
                                inside = inside[score[inside] >= np.partition(score[inside], -k)[-k]]
                            best = inside[np.lexsort((bi[at[inside]], -score[inside]))[:k]]
                            for c, v in (("anchor_id", np.full(len(best), ai[i])), ("anchor_row", np.full(len(best), row[i])),
                                         ("window", np.full(len(best), w["window"])), ("vec_id", bi[at[best]]), ("score", score[best])):
                                found[c].append(v)
        return pa.table({c: pa.array(np.concatenate([np.zeros(0, np.int64), *v]).astype(np.int32 if c == "window" else np.int64))
                         for c, v in found.items()})

    return opened


def search_windows(windows: DataFrame, anchors: DataFrame, rows: DataFrame, pairs: DataFrame, k: int, same_label: bool) -> DataFrame:
    """The ``k`` best rows per anchor and window.

    ``windows``: (anchor_id, anchor_row, window, low, high), inclusive scores.  ``anchors`` and ``rows`` are packed and
    carry their ``bundle`` and ``block``; ``pairs`` are ``block_pairs``.  Returns (anchor_id, anchor_row, window, vec_id,
    score, rank)."""
    key = ["anchor_id", "anchor_row", "window"]
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    turns = pairs.agg(F.max("turn")).first()[0]
    best, now, first, after = None, windows, 0, FIRST_BLOCKS
    while turns is not None and first <= turns:
        sought = now.groupBy(*key[:2]).agg(F.collect_list(F.struct("window", "low", "high")).alias("windows"))
        seekers = anchors.join(sought, (F.col("vec_id") == F.col("anchor_id")) & (F.col("row") == F.col("anchor_row"))).drop("anchor_id", "anchor_row")
        seekers = staged(seekers, "seekers")
        ends = (seekers.withColumn("w", F.explode("windows")).groupBy("dim", "bundle")
                .agg(F.min("w.low").alias("from"), F.max("w.high").alias("to")))
        opened = (pairs.where((F.col("turn") >= first) & (F.col("turn") < after)).join(ends, ["dim", "bundle"])
                  .where("high >= from AND low <= to").select("dim", "bundle", "block"))
        opened = staged(opened, "opened")
        group = ["dim", "bundle", "block"]
        found = (seekers.join(opened, ["dim", "bundle"]).groupBy(*group).cogroup(rows.join(opened, ["dim", "block"]).groupBy(*group))
                 .applyInArrow(_open_block(k, same_label), _FOUND))
        best = found if best is None else best.drop("rank").unionByName(found)
        best = staged(best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), "best")
        first, after = after, after * 8
        if first <= turns:  # a full window takes nothing below its k-th score any more
            full = best.where(F.col("rank") == k).select(*key, F.col("score").alias("least"))
            now = windows.join(full, key, "left").withColumn("low", F.greatest("low", "least")).drop("least")
    return best if best is not None else windows.sparkSession.createDataFrame([], _FOUND + ", rank int")


def mine(rows: DataFrame, is_anchor, id_col: str = "vec_id", vector_col: str = "embedding", label="label", positives: int = 5,
         negatives: int = 10, low_percent: int = 30, high_percent: int = 90) -> DataFrame:
    """Hard negatives of the rows for which the condition ``is_anchor`` holds.

    An anchor's positives are its ``positives`` best other rows of the same label; for each of them the ``negatives``
    best rows of other labels follow whose score is ``low_percent`` to ``high_percent`` of the positive's."""
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), (F.col(label) if isinstance(label, str) else label).cast("long").alias("label"),
                       F.col(vector_col).cast("array<double>").alias("embedding"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    asked = rows.where("is_anchor").select("vec_id").distinct()
    taking = staged(participants(rows), "participants")
    # A bounded sample, the same whatever the partitioning.
    sample = [r[0] for r in taking.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")).limit(FIT_ROWS).select("embedding").collect()]
    references = {d: fit_references(np.array([v for v in sample if len(v) == d])) for d in {len(v) for v in sample}}
    packed = staged(pack(taking, references), "packed")
    blocked = staged(_dealt(packed, BLOCK_ROWS, "block", False), "blocked")
    anchors = staged(_dealt(packed.join(asked, "vec_id", "left_semi"), BUNDLE_ANCHORS, "bundle", True), "anchors")
    pairs = staged(block_pairs(staged(_ranges(anchors, "bundle"), "bundles"), staged(_ranges(blocked, "block"), "blocks")), "pairs")
    every = anchors.select(F.col("vec_id").alias("anchor_id"), F.col("row").alias("anchor_row"), F.lit(0).alias("window"),
                           F.lit(-_ALL).alias("low"), F.lit(_ALL).alias("high"))
    positive = search_windows(every, anchors, blocked, pairs, positives, True)
    positive = staged(positive.select("anchor_id", "anchor_row", F.col("rank").alias("window"), F.col("vec_id").alias("positive_id"),
                                      F.col("score").alias("positive_score")), "positives")
    windows = (positive.where("positive_score >= 0")
               .select("anchor_id", "anchor_row", "window", F.expr(f"({low_percent} * positive_score + 99) div 100").alias("low"),
                       F.expr(f"({high_percent} * positive_score) div 100").alias("high")))
    negative = search_windows(windows, anchors, blocked, pairs, negatives, False)
    return (negative.join(positive, ["anchor_id", "anchor_row", "window"])
            .select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score",
                    F.col("score").alias("negative_score")))
