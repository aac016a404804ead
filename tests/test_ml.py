"""Training helpers: exact SMOTE balance and interpolation, class weights, split."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from txnrisk.operators import features, ml
from txnrisk.schema import FEATURES
from txnrisk.sources import fixtures as fx


@pytest.fixture(scope="module")
def train(spark):
    f = features.build_features(fx.transactions(spark, SF_SMALL))
    return ml.hash_split(f, 0.2, 42).where(F.col("split") == "train").drop("split")


def test_smote_balances_exactly_and_interpolates(spark, train):
    syn = ml.smote(train, k=5, seed=7)
    n0 = train.where("is_fraud = 0").count()
    n1 = train.where("is_fraud = 1").count()
    assert syn.count() == n0 - n1
    assert syn.where("is_fraud <> 1").count() == 0
    lo = train.where("is_fraud = 1").agg(*[F.min(c).alias(c) for c in FEATURES]).first()
    hi = train.where("is_fraud = 1").agg(*[F.max(c).alias(c) for c in FEATURES]).first()
    s_lo = syn.agg(*[F.min(c).alias(c) for c in FEATURES]).first()
    s_hi = syn.agg(*[F.max(c).alias(c) for c in FEATURES]).first()
    for c in FEATURES:
        assert s_lo[c] >= lo[c] - 1e-9 and s_hi[c] <= hi[c] + 1e-9, c
    # deterministic for a seed
    assert syn.select(F.sum("Amount")).first()[0] == pytest.approx(
        ml.smote(train, k=5, seed=7).select(F.sum("Amount")).first()[0])


def test_class_weights_balance(spark, train):
    w = {r["is_fraud"]: r for r in ml.class_weight_table(train).collect()}
    n = w[0]["n"] + w[1]["n"]
    assert w[0]["weight"] * w[0]["n"] == pytest.approx(n / 2)
    assert w[1]["weight"] * w[1]["n"] == pytest.approx(n / 2)


def test_forest_scores_injected_patterns(spark):
    from txnrisk.operators import evaluate, inject
    t = inject.inject_nine_patterns(fx.transactions(spark, SF_SMALL), ratio=0.1, seed=3).drop("pattern")
    f = ml.hash_split(features.build_features(t, point_in_time=True), 0.3, 1)
    model = ml.fit(ml.random_forest_pipeline(num_trees=15, max_depth=6), f.where("split = 'train'"))
    auc = evaluate.roc_auc(ml.score(model, f.where("split = 'test'"))).first()["roc_auc"]
    assert auc > 0.8
