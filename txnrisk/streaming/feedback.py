"""Feedback handling: the retrain check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.clean import attach_one_row
from txnrisk.schema import RETRAIN_INTERVAL_HOURS, RETRAIN_MIN_SAMPLES


def retrain_due(run_log: DataFrame, feedback: DataFrame, now: DataFrame,
                min_samples: int = RETRAIN_MIN_SAMPLES,
                interval_hours: int = RETRAIN_INTERVAL_HOURS) -> DataFrame:
    """One row: buffered feedback, classes present, and whether a retrain is due
    (enough samples, both classes, interval elapsed since the last good run).

    ``now`` is a one-row DataFrame whose first column is the current time.
    """
    fb = feedback.agg(F.count(F.lit(1)).cast("long").alias("n_feedback"),
                      F.count_distinct("is_fraud").cast("long").alias("n_classes"))
    last = run_log.where(F.col("ok")).agg(F.max("run_ts").alias("_last"))
    now1 = now.select(F.col(now.columns[0]).alias("_now"))
    j = attach_one_row(attach_one_row(fb, last), now1)
    due = ((F.col("n_feedback") >= min_samples) & (F.col("n_classes") == 2)
           & (F.col("_last").isNull()  # no good run yet
              | (F.col("_now") >= F.col("_last") + F.make_interval(hours=F.lit(interval_hours)))))
    return j.select("n_feedback", "n_classes", due.alias("due"))
