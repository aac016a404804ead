"""Rows behind the watermark come out of the scoring stream; idle senders keep their history."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from txnrisk.streaming import scoring
from txnrisk.streaming.sender_state import sender_state_features

SCHEMA = ("txn_id long, ts timestamp, amount double, sender_id string, receiver_id string, txn_type string, "
          "merchant_type string, device_id string, location string, is_fraud int")
DAY = datetime(2024, 1, 1)


def _files(spark, name, *batches):
    src = scoring.scratch(spark, name)
    for rows in batches:
        rows = [(i, DAY + timedelta(hours=h), 10.0 * i, s, "R1", "UPI", "Retail", "D1", "12.9, 77.5", 0) for i, h, s in rows]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    return src


def test_late_rows_get_a_decision(spark):
    src = _files(spark, "late-src", [(1, 0, "A")], [(2, 100, "A"), (3, 100, "B")], [(4, 101, "A")],
                 [(5, 10, "A"), (6, 10, "C"), (7, 102, "A"), (8, 90, "B")])
    scoring.seal_source(spark.read.parquet(src), src)
    out = scoring.scratch(spark, "late-out")
    scoring.run_scoring_stream(spark, src, SCHEMA, None, out, scoring.scratch(spark, "late-ckpt"))
    got = {r.txn_id: r for r in spark.read.parquet(out).collect()}
    assert sorted(got) == list(range(1, 9))
    assert {i for i, r in got.items() if r.late} == {5, 6}
    assert all((got[i].decision, got[i].reason, got[i].Txn_Count_Total) == ("ERROR", scoring.LATE, None) for i in (5, 6))
    assert [got[i].Txn_Count_Total for i in (1, 2, 4, 7)] == [1, 2, 3, 4]  # the idle sender's history goes on


def test_idle_seconds_start_anew(spark):
    src = _files(spark, "idle-src", [(1, 0, "A"), (2, 1, "A"), (3, 40, "A")], [(4, 41, "A"), (5, 90, "A")])
    scoring.seal_source(spark.read.parquet(src), src)
    out = scoring.scratch(spark, "idle-out")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    scoring.stream_to_parquet(sender_state_features(stream, idle_seconds=86400), out, scoring.scratch(spark, "idle-ckpt"))
    got = spark.read.parquet(out).orderBy("txn_id").select("Txn_Count_Total", F.col("late")).collect()
    assert [(r[0], r[1]) for r in got] == [(1, False), (2, False), (1, False), (2, False), (1, False)]


def test_order_repeats_and_bad_rows(spark):
    """Rows inside the watermark are folded in event order; repeats, null times and null amounts leave no trace."""
    src = _files(spark, "mixed-src", [(1, 0, "A")], [(2, 5, "A"), (9, 6, "A")], [(3, 1, "A"), (2, 5, "A")], [(4, 5.1, "A"), (3, 1, "A")])
    odd = [(5, None, 3.0), (6, DAY + timedelta(hours=7), None), (7, DAY + timedelta(hours=7), float("nan"))]
    rows = [(i, t, a, "A", "R1", "UPI", "Retail", "D1", "12.9, 77.5", 0) for i, t, a in odd]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(src)
    scoring.seal_source(spark.read.parquet(src), src)
    out = scoring.scratch(spark, "mixed-out")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    scoring.stream_to_parquet(sender_state_features(stream), out, scoring.scratch(spark, "mixed-ckpt"))
    got = spark.read.parquet(out).collect()
    good = sorted((r.ts, r.txn_id, r.Txn_Count_Total, r.Time_Diff_Hours, r.Txn_Count_Last_10_Min) for r in got if r.refused is None)
    assert [g[1:3] for g in good] == [(1, 1), (3, 2), (2, 3), (4, 4), (9, 5)]
    assert [round(g[3], 6) for g in good] == [24.0, 1.0, 4.0, 0.1, 0.9] and [g[4] for g in good] == [1, 1, 1, 2, 1]
    assert sorted((r.refused, r.txn_id) for r in got if r.refused) == [("duplicate", 2), ("duplicate", 3), ("no amount", 6),
                                                                       ("no amount", 7), ("no time", 5)]
    assert max(r.sender_mean_so_far for r in got if r.refused is None) < 100  # no NaN from the refused rows
