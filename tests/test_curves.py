"""Curves on unrounded scores against a plain loop."""

import random

from txnrisk.operators import evaluate


def test_close_scores_stay_apart_and_ties_count_half(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(2), 0.9 + rng.randrange(2000) * 1e-12) for _ in range(3000)]
    df = spark.createDataFrame(rows, "is_fraud int, score double")
    pos, neg = ([s for y, s in rows if y == k] for k in (1, 0))
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    assert abs(evaluate.roc_auc(df).first().roc_auc - wins / (len(pos) * len(neg))) < 1e-12
    got = {r.threshold: (r.fpr, r.tpr) for r in evaluate.roc_curve(df).collect()}
    assert got.pop(None) == (0.0, 0.0)  # the starting point
    assert got == {t: (sum(n >= t for n in neg) / len(neg), sum(p >= t for p in pos) / len(pos)) for t in {s for _, s in rows}}


def test_no_rows_give_no_points(spark):
    df = spark.createDataFrame([], "is_fraud int, score double")
    assert evaluate.pr_curve(df).count() == 0
