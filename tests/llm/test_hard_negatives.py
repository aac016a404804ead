"""Hard negatives against brute force, bounds against exact scores, and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<float>, label int, score long, row string, cell int, window int, block long, bundle long"


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "r", 2, 3, 4, 5) for r in rows], SCHEMA)


def clustered(n, dim, seed, labels=4, first=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, dim))
    return [(first + i, [float(x) for x in (centres[rng.integers(6)] + 0.4 * rng.standard_normal(dim)) * rng.uniform(0.2, 3)],
             int(rng.integers(labels))) for i in range(n)]


def brute(rows, every, positives=5, negatives=10):
    use = [(i, y, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, y in dict.fromkeys((i, tuple(v), y) for i, v, y in rows
           if i is not None and v and y is not None and all(x is not None and math.isfinite(x) for x in v))]
    out = []
    for a, label, q in use:
        if a % every:
            continue
        scored = sorted((-sum(x * z for x, z in zip(q, w)), i, y) for i, y, w in use if i != a and len(w) == len(q))
        for s, i, _ in [r for r in scored if r[2] == label][:positives]:
            fits = [r for r in scored if r[2] != label and -30 * s <= -100 * r[0] <= -90 * s][:negatives]
            out += [(a, i, k + 1, r[1], -s, -r[0]) for k, r in enumerate(fits)]
    return sorted(out)


def mined(df, every):
    keep = hn.mine(df, F.col("vec_id") % every == 0)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in keep.collect())


def test_against_brute_force(spark, monkeypatch):
    rows = clustered(700, 12, 1) + clustered(300, 5, 2, first=2000)
    rows += [(5000 + i, rows[3][1], i % 2) for i in range(60)]  # many equal vectors, so equal scores
    rows += [(6000, None, 1), (6001, [], 1), (6002, [1.0] * 11 + [math.nan], 1), (6003, [0.0] * 12, 2), (6010, [0.0] * 5, 2),
             (None, [1.0] * 12, 1), (6020, [1.0] * 12, None), rows[0], rows[0], (6030, [1.0] * 3, 1)]
    monkeypatch.setattr(hn, "BLOCK_ROWS", 40)  # many blocks and several rounds
    monkeypatch.setattr(hn, "BUNDLE_ANCHORS", 8)
    assert mined(table(spark, rows), 10) == brute(rows, 10) != []


def test_one_label_or_few_rows(spark):
    same = [(i, [float(i), 1.0], 3) for i in range(12)]
    assert mined(table(spark, same), 1) == []
    few = [(0, [1.0, 0.0], 1), (1, [1.0, 0.1], 1), (2, [0.6, 0.1], 2), (3, [-1.0, 0.0], 2)]
    assert mined(table(spark, few), 1) == brute(few, 1) != []
    assert mined(table(spark, []), 1) == []


def test_bounds_hold():
    rng = np.random.default_rng(5)
    for dim in (2, 7, 64):
        refs = hn.fit_references(rng.standard_normal((200, dim)))
        q = hn.quantised(rng.standard_normal((150, dim)) * rng.uniform(0.001, 30, (150, 1)))
        q[0], q[1], q[2] = q[4], -q[4], 0  # equal, opposite, zero
        angles = np.arccos(np.clip(hn._units(q) @ refs.T, -1, 1)).astype(np.float32).astype(np.float64)
        near = np.abs(angles[:, None] - angles).max(axis=2)
        s = angles[:, None] + angles
        far = np.minimum(s, 2 * math.pi - s).min(axis=2)
        norms = np.sqrt((q * q).sum(axis=1))
        low, high = hn._scores_between(near, far, *[norms[:, None] * norms] * 2)
        assert (low <= q @ q.T).all() and (q @ q.T <= high).all()


def test_large_components_are_left_out(spark):
    rows = [(i, [float(i % 5), 2.0, 1.0], i % 2) for i in range(20)]
    assert mined(table(spark, rows + [(100, [1e30, 1.0, 1.0], 1)]), 10) == brute(rows, 10)


@pytest.mark.parametrize("partitions", [1, 6])
def test_partitioning_does_not_matter(spark, partitions):
    rows = clustered(200, 6, 9)
    assert mined(table(spark, rows).repartition(partitions), 20) == brute(rows, 20)
