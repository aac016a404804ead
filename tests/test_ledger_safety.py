"""Ledger rows and versions survive nulls, failed reads and restarts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from txnrisk.functions.validate import amount_number
from txnrisk.operators.ledger import apply_feedback
from txnrisk.schema import LEDGER_SCHEMA
from txnrisk.session import shared_path
from txnrisk.sources import io
from txnrisk.streaming.feedback import retrain_due
from txnrisk.streaming.scoring import run_feedback_stream, scratch

FEEDBACK = "txn_id string, is_fraud boolean, feedback_ts timestamp"
NOW = dt.datetime(2026, 1, 2)


def ledger(spark):
    row = {f.name: None for f in LEDGER_SCHEMA.fields} | {"txn_id": "a", "amount": 5.0, "fraud_probability": 0.9}
    return spark.createDataFrame([row], LEDGER_SCHEMA)


@pytest.mark.parametrize("limit", [10, -1])
def test_null_status_is_untouched(spark, limit):
    none = spark.createDataFrame([], FEEDBACK)
    r = apply_feedback(ledger(spark), none, broadcast_rows=limit).first()
    assert (r.amount, r.fraud_probability, r.status) == (5.0, 0.9, None)


def test_ensure_ledger_never_overwrites(spark):
    path = scratch(spark, "broken")
    spark.createDataFrame([("not a ledger",)], "x string").write.text(path)
    io.ensure_ledger(spark, path)
    assert spark.read.text(path).count() == 1
    io.ensure_ledger(spark, shared_path(spark, "fresh-" + path.rsplit("/", 1)[-1]))


def test_feedback_stream_restart_keeps_its_version(spark):
    work, source, start = scratch(spark, "w"), scratch(spark, "s"), scratch(spark, "l")
    ledger(spark).write.parquet(start)
    fb = spark.createDataFrame([("a", True, NOW)], FEEDBACK)
    fb.write.parquet(source)
    first = run_feedback_stream(spark, source, fb.schema, start, work)
    assert first != start and run_feedback_stream(spark, source, fb.schema, start, work) == first


def test_first_retrain_is_due(spark):
    fb = spark.range(60).select((F.col("id") % 2 == 0).alias("is_fraud"))
    runs = spark.createDataFrame([], "run_ts timestamp, ok boolean")
    assert retrain_due(runs, fb, spark.createDataFrame([(NOW,)], "now timestamp")).first().due is True


def test_amount_suffixes_do_not_parse(spark):
    df = spark.createDataFrame([("5d",), ("10f",), (" 7.5 ",), ("1e3",), ("x",)], "a string")
    assert [r[0] for r in df.select(amount_number(F.col("a"))).collect()] == [None, None, 7.5, 1000.0, None]
