"""Replaying a table through the keyed-state stream gives the batch
point-in-time features; feedback micro-batches equal the batch upsert."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from txnrisk.operators.features import history_features, running_distinct
from txnrisk.sources import fixtures as fx
from txnrisk.streaming import scoring
from txnrisk.streaming.sender_state import sender_state_features

POINT_IN_TIME = ["Time_Since_Last_Txn", "Time_Diff_Hours", "Txn_Count_Total", "Txn_Count_Last_1H",
                 "Txn_Count_Last_6H", "Txn_Count_Last_24H", "Rapid_Txn_Count_Last_1H",
                 "Amount_Rolling_Mean_10", "Amount_Rolling_Std_10", "Is_New_Device", "Location_Distance_Km",
                 "Is_Unusual_Location", "Location_Speed_Kmh", "Is_High_Speed", "Receiver_Frequency",
                 "Is_First_Time_Receiver", "Txn_Count_Last_10_Min"]


def test_stream_replay_equals_batch(spark):
    t = fx.transactions(spark, SF_SMALL).drop("user_id", "k")
    src, out = scoring.scratch(spark, "t-src"), scoring.scratch(spark, "t-out")
    late = F.pmod(F.xxhash64("txn_id"), F.lit(20 * 3_600_000_000))  # up to 20 hours late
    scoring.replay_source(t, src, n_files=5, arrival=F.unix_micros(F.col("ts").cast("timestamp")) + late)
    scoring.seal_source(t, src, after="900 days")
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(src)
    feats = sender_state_features(stream, idle_seconds=400 * 86400)
    scoring.stream_to_parquet(feats, out,
                              scoring.scratch(spark, "t-ckpt"))
    s = spark.read.parquet(out)
    b = history_features(t)
    dev = running_distinct(t, "device_id", "dev_so_far").select("txn_id", "dev_so_far")
    j = s.join(b.select("txn_id", *[F.col(c).alias("b_" + c) for c in POINT_IN_TIME]), "txn_id") \
        .join(dev, "txn_id").collect()
    assert len(j) == t.count() == s.count()
    for r in j:
        for c in POINT_IN_TIME:
            assert r[c] == pytest.approx(r["b_" + c], rel=1e-9, abs=1e-9), c
        assert r["device_count_so_far"] == r["dev_so_far"]


def test_stream_feedback_equals_batch(spark):
    import __spark_entry__ as entry
    from tests.oracle_compare import compare, duck
    got = entry.queries()["stream_feedback"](spark, SF_SMALL).toPandas()
    want = duck(SF_SMALL).execute(entry.oracle_sql()["apply_feedback"]).df()
    assert compare(got, want) is None


def test_json_transaction_stream(spark):
    """A9: one JSON transaction per line, read as a stream with the canonical schema."""
    from txnrisk.sources import io
    t = fx.transactions(spark, SF_SMALL).select(
        F.col("txn_id").cast("string").alias("txn_id"), "ts", "amount", "sender_id", "receiver_id", "txn_type",
        "merchant_type", "device_id", "location", "is_fraud")
    src, out = scoring.scratch(spark, "json-src"), scoring.scratch(spark, "json-out")
    t.write.json(src)
    scoring.seal_source(t, src, fmt="json")
    stream = io.read_transaction_stream(spark, src, fmt="json", max_files_per_trigger=4)
    scoring.stream_to_parquet(sender_state_features(stream, idle_seconds=400 * 86400), out,
                              scoring.scratch(spark, "json-ckpt"))
    got = spark.read.parquet(out)
    assert got.count() == t.count()
    assert got.where(F.col("Txn_Count_Total") < 1).count() == 0
