"""The registered model queries fit the operators' default models; nearest_city keeps rows without a location."""

import pytest

import __spark_entry__ as entry
from tests.conftest import SF_SMALL
from txnrisk.operators import locations, ml


class _Fitted(Exception):
    pass


@pytest.mark.parametrize("name", ["train_rf", "train_gbt", "feature_importance", "retrain", "stream_score",
                                  "injected_model_quality"])
def test_queries_fit_the_default_model(spark, monkeypatch, name):
    def fit(pipeline, *args, **kwargs):
        raise _Fitted(pipeline.getStages()[-1])

    monkeypatch.setattr(ml, "fit", fit)
    with pytest.raises(_Fitted) as got:
        entry.queries()[name](spark, SF_SMALL)
    used = got.value.args[0]
    full = (ml.boosted_trees_pipeline() if name == "train_gbt" else ml.random_forest_pipeline()).getStages()[-1]
    assert {p.name: v for p, v in used.extractParamMap().items()} == {p.name: v for p, v in full.extractParamMap().items()}


def test_nearest_city_keeps_unusable_locations(spark):
    rows = [(1, "19.07, 72.87"), (2, "n/a"), (3, None), (4, "1, 2, 3"), (5, "x, 77.5")]
    got = {r.txn_id: r for r in locations.nearest_city(spark.createDataFrame(rows, "txn_id long, location string")).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1].city is not None
    assert all(got[i].city is None and got[i].distance_km is None for i in (2, 3, 4, 5))
