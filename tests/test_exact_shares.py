"""Exact shares, ranks and positions; distributed dictionaries; curve ends; CSV by name."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from txnrisk.operators import evaluate, inject, ml, ranks
from txnrisk.operators.inject import unit_hash
from txnrisk.sources import fixtures as fx
from txnrisk.sources import io
from txnrisk.streaming.scoring import scratch


@pytest.mark.parametrize("bins", [4, 65536])
@pytest.mark.parametrize("share", [0.0, 0.2, 0.37, 1.0])
def test_least_draws_are_exact(spark, bins, share):
    df = spark.range(997).select((F.col("id") + 5).alias("txn_id"), (F.col("id") % 7 == 0).cast("int").alias("c"))
    got = ranks.least_draws(df, share, 3, "txn_id", "c", bins=bins)
    rows = got.withColumn("u", unit_hash(F.col("txn_id"), 3)).collect()
    for c in (0, 1):
        own = sorted((r.u, r.txn_id) for r in rows if r.c == c)
        k = int(len(own) * share + 0.5)
        assert sorted((r.u, r.txn_id) for r in rows if r.c == c and r.chosen) == own[:k]
    assert got.columns == ["txn_id", "c", "chosen"] and len(rows) == 997


def test_ranks_and_positions(spark):
    df = spark.range(500).select(F.col("id").alias("txn_id"), (F.col("id") * 7919 % 500).alias("x"))
    by_draw = ranks.draw_ranks(df, 9, bins=8).withColumn("u", unit_hash(F.col("txn_id"), 9)).orderBy("u").collect()
    assert [r.draw_rank for r in by_draw] == list(range(500))
    assert all(r.position == r.x for r in ranks.ordered_positions(df, [F.col("x")]).collect())
    sizes = [ranks.equal_shares(df.where(F.col("txn_id") < n), "txn_id", 9).groupBy("share").count().orderBy("share").collect() for n in (500, 7)]
    assert [r["count"] for r in sizes[0]] == [56] * 5 + [55] * 4 and [r["count"] for r in sizes[1]] == [1] * 7


def test_nine_exact_shares(spark):
    t = fx.transactions(spark, SF_SMALL)
    n = t.count()
    got = inject.inject_nine_patterns(t, 0.05, 1, exact=True).where("pattern IS NOT NULL").groupBy("pattern").count().collect()
    sizes = [r["count"] for r in got]
    assert sum(sizes) == int(n * 0.05 + 0.5) and len(sizes) == 9 and max(sizes) - min(sizes) <= 1


def test_dictionary_with_heavy_light_null_and_unseen_values(spark):
    rows = [(i, "hot" if i % 3 else f"v{i}", None if i % 5 == 0 else str(i % 2)) for i in range(3000)]
    train = spark.createDataFrame(rows, "txn_id long, a string, b string")
    model = ml.learned_one_hot(["a", "b"]).fit(train)
    assert model.sizes == {"a": 1001, "b": 2} and not model._all_heavy["a"] and model._all_heavy["b"]
    more = train.unionByName(spark.createDataFrame([(9999, "new", None)], train.schema))
    got = {r.txn_id: r for r in model.transform(more).collect()}
    assert len(got) == 3001 and got[1].a_idx == 0.0 and got[9999].a_idx == 1001.0 and got[9999].b_idx == 2.0 == got[0].b_idx
    light = sorted((f"v{i}") for i in range(0, 3000, 3))
    assert all(got[int(v[1:])].a_idx == light.index(v) + 1 for v in light)
    assert got[1].a_ohe.size == 1002 and got[1].a_ohe.indices.tolist() == [0]  # sparse


def test_curves_start_and_end(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.4), (0, 0.1)], "is_fraud int, score double")
    assert [r[1:] for r in evaluate.roc_curve(df).where("threshold IS NULL").collect()] == [(0.0, 0.0)]
    assert [r[1:] for r in evaluate.pr_curve(df).where("threshold IS NULL").collect()] == [(1.0, 0.0)]
    assert evaluate.roc_auc(df).first()[0] == pytest.approx(0.625)


def test_csv_by_name_and_quarantine(spark):
    path = scratch(spark, "csv")
    text = ("Amount,Is_Fraud,Transaction_ID,Extra,Timestamp\n12.5,True,t1,x,2024-01-02T03:04:05\nbroken\n"
            "7,0,t2,y,2024-01-02 03:04:06\n1,2,3,4,5,6\n")
    spark.createDataFrame([(text,)], "line string").coalesce(1).write.text(path)
    got = sorted((r.txn_id, r.amount, r.is_fraud, str(r.ts), r.sender_id) for r in io.read_transactions(spark, path).collect())
    assert got == [("t1", 12.5, 1, "2024-01-02 03:04:05", None), ("t2", 7.0, 0, "2024-01-02 03:04:06", None)]
    assert sorted(r.line for r in io.quarantined_lines(spark, path).collect()) == ["1,2,3,4,5,6", "broken"]
    other = scratch(spark, "csv")
    for head in ("Transaction_ID,Amount", "Amount,Transaction_ID"):
        spark.createDataFrame([(f"{head}\n1,2",)], "line string").coalesce(1).write.mode("append").text(other)
    with pytest.raises(Exception):
        io.read_transactions(spark, other).collect()
