"""The (sender, bucket) history features equal plain per-sender windows,
including a hot sender with a third of all rows, sparse senders whose
halos span many buckets, equal timestamps, and tiny buckets."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txnrisk.operators.features import history_features, running_distinct, trailing_velocity


def _rows(n=1500, seed=3):
    rnd = random.Random(seed)
    base = dt.datetime(2024, 3, 1)
    rows = []
    t_hot = base
    for i in range(n):
        if i % 3 == 0:  # hot sender: a third of all rows, dense in time
            t_hot += dt.timedelta(seconds=rnd.choice([0, 5, 30, 90, 400, 700, 3000]))
            sender, ts = "HOT", t_hot
        else:
            sender = f"S{rnd.randint(1, 40)}"
            ts = base + dt.timedelta(seconds=rnd.randint(0, 20 * 86400))
        loc = rnd.choice(["12.9716, 77.5946", "28.6139, 77.2090", "n/a", "1,2,3", None, "-34.6037, -58.3816"])
        rows.append((i, ts, sender, float(rnd.choice([0.0, 5.0, 100.0, 250.5, 7000.0])),
                     rnd.choice(["Device_1", "Device_2", "Unknown_Device_9", None]),
                     loc, rnd.choice(["Merchant_1", "Suspicious_2", "Test_3"])))
    return rows


@pytest.fixture(scope="module")
def txn(spark):
    schema = "txn_id long, ts timestamp, sender_id string, amount double, device_id string, location string, receiver_id string"
    return spark.createDataFrame(_rows(), schema)


def _plain(txn):
    w = Window.partitionBy("sender_id").orderBy("ts", "txn_id")
    roll = w.rowsBetween(-9, 0)
    gap = (F.unix_micros("ts") - F.lag(F.unix_micros("ts")).over(w)) / F.lit(1e6) / F.lit(3600.0)
    tdh = F.coalesce(gap, F.lit(24.0))
    x = txn.withColumn("tdh", tdh)
    return x.select(
        "txn_id", F.col("tdh").alias("p_tdh"),
        F.row_number().over(w).alias("p_total"),
        F.sum(F.when(F.col("tdh") <= 1, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p_c1"),
        F.sum(F.when(F.col("tdh") <= 24, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("p_c24"),
        F.sum(F.when(F.col("tdh") <= 0.1, 1).otherwise(0)).over(roll).alias("p_rapid"),
        F.avg("amount").over(roll).alias("p_mean"),
        F.row_number().over(Window.partitionBy("sender_id", "receiver_id").orderBy("ts", "txn_id")).alias("p_rf"),
        F.lag("device_id").over(w).alias("p_prev_dev"),
        F.lag("location").over(w).alias("p_prev_loc"),
    )


@pytest.mark.parametrize("bucket_seconds,hot_rows", [(600, None), (3600, None), (86400, None),
                                                     (86400, 100), (7 * 86400, 50)])
def test_bucketed_history_equals_plain_windows(spark, txn, bucket_seconds, hot_rows):
    """Fixed widths, and adaptive widths where the hot sender (500 rows) and
    busier plain senders get narrower buckets than the default."""
    h = history_features(txn, bucket_seconds=bucket_seconds, hot_rows=hot_rows, target_rows=20)
    j = h.join(_plain(txn), "txn_id").collect()
    assert len(j) == txn.count()
    for r in j:
        assert r["Time_Diff_Hours"] == pytest.approx(r["p_tdh"])
        assert r["Txn_Count_Total"] == r["p_total"]
        assert r["Txn_Count_Last_1H"] == r["p_c1"]
        assert r["Txn_Count_Last_24H"] == r["p_c24"]
        assert r["Rapid_Txn_Count_Last_1H"] == r["p_rapid"]
        assert r["Amount_Rolling_Mean_10"] == pytest.approx(r["p_mean"])
        assert r["Receiver_Frequency"] == r["p_rf"]
        same = r["device_id"] is not None and r["device_id"] == r["p_prev_dev"] and r["p_total"] > 1
        assert r["Is_New_Device"] == (0 if same else 1)


def test_velocity_and_running_distinct(spark, txn):
    v = trailing_velocity(txn, bucket_seconds=86400, hot_rows=100, target_rows=50).collect()
    rows = {r["txn_id"]: r for r in v}
    data = sorted(_rows(), key=lambda r: (r[2], r[1], r[0]))
    by_sender = {}
    for r in data:
        by_sender.setdefault(r[2], []).append(r)
    for s, rs in by_sender.items():
        for i, r in enumerate(rs):
            for h in (1, 6, 24):
                lo = r[1] - dt.timedelta(hours=h)
                expect = sum(1 for q in rs[: i + 1] if q[1] > lo)
                assert rows[r[0]][f"Velocity_{h}H"] == expect
    d = {r["txn_id"]: r["n"] for r in running_distinct(txn, "receiver_id", "n", bucket_seconds=86400,
                                                      hot_rows=30, target_rows=10).collect()}
    for s, rs in by_sender.items():
        seen = set()
        for r in rs:
            seen.add(r[6])
            assert d[r[0]] == len(seen)


def test_no_row_window_is_partitioned_by_sender_alone(spark, txn):
    """Row-level windows are partitioned by (sender, bucket[, x]); a window
    partitioned by the sender alone may only order the small bucket table."""
    import re
    h = history_features(txn)
    plan = h._jdf.queryExecution().executedPlan().toString()
    specs = re.findall(r"windowspecdefinition\(sender_id#\d+L?, (\w+)#", plan)
    assert specs, plan
    assert set(specs) <= {"_b", "_g", "receiver_id"}, specs


def test_hot_sender_gets_narrow_buckets(spark, txn):
    from txnrisk.operators.timeline import plan_buckets
    b = plan_buckets(txn, key="sender_id", ts="ts", default_seconds=7 * 86400, min_seconds=600,
                     hot_rows=100, target_rows=20)
    hot = {r["sender_id"]: r["_hw"] for r in b.hot.collect()}
    assert set(hot) == {"HOT"} and b.broadcast_hot
    assert 600 * 1_000_000 <= hot["HOT"] < 7 * 86400 * 1_000_000
    per_bucket = (b.apply(txn).where("sender_id = 'HOT'").groupBy("_b").count()
                  .agg({"count": "max"}).first()[0])
    assert per_bucket < 500  # the hot sender is split over many buckets
    none = plan_buckets(txn, key="sender_id", ts="ts", default_seconds=86400, min_seconds=600,
                        hot_rows=10_000)
    assert none.hot is None


@pytest.mark.parametrize("bucket_seconds,hot_rows", [(3600, None), (86400, 100)])
def test_point_in_time_sender_stats(spark, txn, bucket_seconds, hot_rows):
    """Mean amount, devices and receivers so far equal plain running windows."""
    h = history_features(txn.na.fill({"device_id": "Unknown"}), bucket_seconds=bucket_seconds,
                         point_in_time=True, hot_rows=hot_rows, target_rows=20)
    data = sorted([(r[2], r[1], r[0], r[3], r[4] if r[4] is not None else "Unknown", r[6]) for r in _rows()])
    got = {r["txn_id"]: r for r in h.collect()}
    state = {}
    for snd, _ts, tid, amt, dev, rcv in data:
        s = state.setdefault(snd, {"sum": 0.0, "n": 0, "dev": set(), "rcv": set()})
        s["sum"] += amt
        s["n"] += 1
        s["dev"].add(dev)
        s["rcv"].add(rcv)
        r = got[tid]
        assert r["_avg_amount"] == pytest.approx(s["sum"] / s["n"])
        assert r["Device_Count"] == len(s["dev"])
        assert r["Receiver_Diversity"] == len(s["rcv"])


def test_no_row_exchange_on_pair_keys(spark, txn):
    """Pair running counts use co-partitioned offset markers: no exchange on
    (sender, bucket, receiver/device), whatever the co-partition setting."""
    import re
    old = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition", "true")
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "true")
    try:
        plan = history_features(txn, point_in_time=True)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", old)
    keys = [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]
    assert not any(k.startswith("sender_id, _g, ") and ("receiver_id" in k or "device_id" in k) for k in keys), keys
