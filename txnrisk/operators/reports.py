"""Ledger and run reports.  Every report is one aggregation with map-side
partial aggregation; outputs are small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.operators.clean import attach_one_row, cast_label
from txnrisk.schema import NO_FRAUD_TYPE


def _is_fraud(df: DataFrame, col: str = "is_fraud") -> Column:
    return cast_label(F.col(col)) == 1


def ledger_stats(ledger: DataFrame) -> DataFrame:
    """Total, fraud, legitimate and fraud rate in percent (1 decimal)."""
    fraud = F.sum(F.when(_is_fraud(ledger), 1).otherwise(0))
    total = F.count(F.lit(1))
    return ledger.agg(total.cast("long").alias("total_transactions"),
                      fraud.cast("long").alias("fraud_count")) \
        .select("total_transactions", "fraud_count",
                (F.col("total_transactions") - F.col("fraud_count")).alias("legitimate_count"),
                F.when(F.col("total_transactions") > 0,
                       F.round(F.col("fraud_count") / F.col("total_transactions") * 100, 1))
                .otherwise(F.lit(0.0)).alias("fraud_rate"))


def fraud_type_distribution(ledger: DataFrame, exclude_dash: bool = True) -> DataFrame:
    """Fraud rows per type; empty types (and ``-`` when ``exclude_dash``) skipped."""
    t = F.col("fraud_type")
    keep = _is_fraud(ledger) & t.isNotNull() & (t != "")
    if exclude_dash:
        keep = keep & (t != NO_FRAUD_TYPE)
    return ledger.where(keep).groupBy("fraud_type").agg(F.count(F.lit(1)).cast("long").alias("n"))


def daily_volume(ledger: DataFrame) -> DataFrame:
    """Amount and count per calendar day, in day order."""
    return (ledger.groupBy(F.to_date("ts").alias("day"))
            .agg(F.sum("amount").alias("volume"), F.count(F.lit(1)).cast("long").alias("n"))
            .orderBy("day"))


def fraud_stats(ledger: DataFrame) -> DataFrame:
    """Total, fraud count, fraud percentage (2 decimals), distinct fraud types,
    and ``fraud_types``: a map type -> count."""
    types = fraud_type_distribution(ledger, exclude_dash=False)
    types = types.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("fraud_type", "n")))).alias("fraud_types"))
    return attach_one_row(_fraud_totals(ledger), types)


def _fraud_totals(ledger: DataFrame) -> DataFrame:
    fraud = _is_fraud(ledger)
    t = F.col("fraud_type")
    return ledger.agg(
        F.count(F.lit(1)).cast("long").alias("total_transactions"),
        F.sum(F.when(fraud, 1).otherwise(0)).cast("long").alias("fraud_count"),
        F.count_distinct(F.when(fraud & t.isNotNull() & (t != ""), t)).cast("long").alias("n_fraud_types"),
    ).withColumn("fraud_percentage",
                 F.when(F.col("total_transactions") > 0,
                        F.round(F.col("fraud_count") / F.col("total_transactions") * 100, 2))
                 .otherwise(F.lit(0.0)))


def prediction_fraud_summary(pred: DataFrame, flag: str = "pred_is_fraud",
                             type_col: str = "fraud_type") -> DataFrame:
    """Detected frauds per inferred type."""
    return (pred.where(F.col(flag) == 1).groupBy(type_col)
            .agg(F.count(F.lit(1)).cast("long").alias("n")))


def run_summary(pred: DataFrame, actual: str = "is_fraud", flag: str = "pred_is_fraud",
                type_col: str = "fraud_type") -> DataFrame:
    """Totals of a scoring run: actual, detected, errors, detection rate."""
    a = F.col(actual) == 1
    p = F.col(flag) == 1
    return pred.agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.sum(F.when(a, 1).otherwise(0)).cast("long").alias("actual_fraud"),
        F.sum(F.when(p, 1).otherwise(0)).cast("long").alias("detected"),
        F.sum(F.when(a & p, 1).otherwise(0)).cast("long").alias("true_detected"),
        F.sum(F.when(F.col(type_col) == "Error", 1).otherwise(0)).cast("long").alias("errors"),
    ).withColumn("detection_rate",
                 F.when(F.col("actual_fraud") > 0, F.col("true_detected") / F.col("actual_fraud"))
                 .otherwise(F.lit(0.0)))


def dataset_profile(txn: DataFrame, label: str = "is_fraud") -> DataFrame:
    """Rows and fraud rows per payment type, with a grand-total row (null type)."""
    return (txn.rollup("txn_type")
            .agg(F.count(F.lit(1)).cast("long").alias("n"),
                 F.sum(F.col(label)).cast("long").alias("n_fraud"))
            .withColumn("fraud_pct", F.col("n_fraud") / F.col("n") * 100))


def scenario_scorecard(df: DataFrame, expected: str = "is_fraud", detected: str = "pred_is_fraud") -> DataFrame:
    """Accuracy, recall on fraud and specificity on legitimate rows."""
    e, d = F.col(expected) == 1, F.col(detected) == 1
    agg = df.agg(
        F.count(F.lit(1)).cast("long").alias("n"),
        F.sum(F.when(e == d, 1).otherwise(0)).cast("long").alias("correct"),
        F.sum(F.when(e, 1).otherwise(0)).cast("long").alias("n_fraud"),
        F.sum(F.when(e & d, 1).otherwise(0)).cast("long").alias("fraud_detected"),
        F.sum(F.when(~e, 1).otherwise(0)).cast("long").alias("n_legit"),
        F.sum(F.when(~e & ~d, 1).otherwise(0)).cast("long").alias("legit_passed"))
    return agg.select(
        "*",
        (F.col("correct") / F.col("n")).alias("accuracy"),
        F.when(F.col("n_fraud") > 0, F.col("fraud_detected") / F.col("n_fraud")).alias("fraud_recall"),
        F.when(F.col("n_legit") > 0, F.col("legit_passed") / F.col("n_legit")).alias("legit_specificity"))


def model_stats(run_log: DataFrame, feedback: DataFrame, predictions: DataFrame,
                interval_hours: int = 24) -> DataFrame:
    """Last retrain, buffer size, next due time, predictions count (one row)."""
    last = run_log.where(F.col("ok")).agg(F.max("run_ts").alias("last_retrained"))
    buf = feedback.agg(F.count(F.lit(1)).cast("long").alias("training_data_size"))
    npred = predictions.agg(F.count(F.lit(1)).cast("long").alias("predictions_count"))
    return (attach_one_row(attach_one_row(last, buf), npred)
            .withColumn("next_retrain_due",
                        F.col("last_retrained") + F.make_interval(hours=F.lit(interval_hours))))


def feature_profile(features: DataFrame, label: str = "is_fraud", keep: tuple[str, ...] = ("txn_id",)) -> DataFrame:
    """Rows, feature count (columns but the label and ``keep``) and fraud ratio of a feature matrix."""
    n_features = len([c for c in features.columns if c not in (label, *keep)])
    return features.agg(F.count(F.lit(1)).cast("long").alias("n_rows"),
                        F.avg(F.col(label).cast("double")).alias("fraud_ratio")) \
        .withColumn("n_features", F.lit(n_features).cast("long"))


def latency_summary(timings: DataFrame, col: str = "ms") -> DataFrame:
    """Mean, median and p95 of per-row or per-batch latencies."""
    return timings.agg(F.count(F.lit(1)).cast("long").alias("n"), F.avg(col).alias("mean_ms"),
                       F.percentile_approx(col, 0.5).alias("p50_ms"),
                       F.percentile_approx(col, 0.95).alias("p95_ms"))
