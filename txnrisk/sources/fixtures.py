"""Transaction-shaped views over the driver's test tables.

The test tables are not payment data, so a payment view is derived from
``events`` by formula (see FIXTURES.md §2).  Every derived column is a
deterministic function of the row's own keys, so the view is a narrow
projection over the scan (Parquet pruning keeps only the columns a query
needs).  An input read as fewer partitions than the session's parallelism (a
single-row-group file) is first spread round-robin; large inputs are not.

The same formulas exist as DuckDB SQL in ``txnrisk.plans.oracle_views`` so
results can be compared engine to engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.schema import CITIES


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def with_input_parallelism(df: DataFrame) -> DataFrame:
    """Spread an under-split input over the session's parallelism.

    A single-row-group file is read by one task, which would then run every
    per-row derivation alone.  Inputs that already have at least as many
    partitions as the session's default parallelism (any large table) are
    returned unchanged, so no shuffle is added at scale.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df


def _city_location(idx: Column) -> Column:
    expr = None
    for i, (_, lat, lon) in enumerate(CITIES):
        text = F.lit(f"{lat:.4f}, {lon:.4f}")
        expr = F.when(idx == i, text) if expr is None else expr.when(idx == i, text)
    return expr


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payment transactions derived from ``events`` (one row per event)."""
    ev = with_input_parallelism(read_table(spark, sf_dir, "events"))
    k = F.get_json_object("props", "$.k").cast("int")
    base = ev.select(
        F.col("event_id").alias("txn_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("user_id"),
        k.alias("k"),
        F.col("event_type"),
        F.col("value"),
    )
    k = F.col("k")
    uid = F.col("user_id")
    kstr = k.cast("string")
    city_idx = F.pmod(uid + F.when(k % 10 == 3, 1).otherwise(0), F.lit(8))
    return base.select(
        "txn_id", "ts", "user_id", "k",
        (F.col("value") * F.col("value") * 4).alias("amount"),
        F.concat(F.lit("User_"), uid.cast("string")).alias("sender_id"),
        F.when(k < 5, F.concat(F.lit("Suspicious_"), kstr))
        .when(k < 10, F.concat(F.lit("Test_Merchant_"), kstr))
        .otherwise(F.concat(F.lit("Merchant_"), kstr)).alias("receiver_id"),
        F.when(F.col("event_type").isin("purchase", "click"), "UPI")
        .when(F.col("event_type").isin("view", "signup"), "Card")
        .otherwise("Netbanking").alias("txn_type"),
        F.when(k % 7 == 0, "Online_Retail").when(k % 7 == 1, "Food")
        .when(k % 7 == 2, "Travel").when(k % 7 == 3, "Entertainment")
        .when(k % 7 == 4, "Utilities").when(k % 7 == 5, "Unknown")
        .otherwise("Retail_Physical").alias("merchant_type"),
        F.when(k % 20 == 0, F.concat(F.lit("Unknown_Device_"), kstr))
        .when(k % 20 == 1, F.concat(F.lit("New_Device_"), kstr))
        .otherwise(F.concat(F.lit("Device_"), uid.cast("string"))).alias("device_id"),
        F.when(k == 77, "-34.6037, -58.3816").when(k == 78, "35.6762, 139.6503")
        .when(k == 79, "n/a").otherwise(_city_location(city_idx)).alias("location"),
        F.when(((k < 8) & (F.col("txn_id") % 10 != 0))
               | ((k >= 92) & (F.col("txn_id") % 13 == 0)), 1).otherwise(0).alias("is_fraud"),
    )


def orders_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tie-heavy transaction view over ``orders`` (day-granular timestamps)."""
    o = with_input_parallelism(read_table(spark, sf_dir, "orders"))
    return o.select(
        F.col("o_orderkey").alias("txn_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("Cust_"), F.col("o_custkey").cast("string")).alias("sender_id"),
        F.col("o_totalprice").alias("amount"),
    )


def requests(txn: DataFrame) -> DataFrame:
    """Payment requests: transactions plus card and UPI fields by formula."""
    return with_request_fields(txn).select("txn_id", "k", "amount", "txn_type", "card_number", "cvv",
                                           "expiry", "upi_id")


def with_request_fields(txn: DataFrame) -> DataFrame:
    """The transaction rows with their card and UPI request fields added."""
    k, tid = F.col("k"), F.col("txn_id")
    tail10 = F.lpad((tid * 7919 % 10000000000).cast("string"), 10, "0")
    return txn.select(
        "*",
        F.when(k % 17 == 0, F.concat(F.lit("40000"), tail10))
        .otherwise(F.concat(F.lit("400000"), tail10)).alias("card_number"),
        F.when(k % 9 == 0, "12").when(k % 11 == 0, "12a")
        .otherwise(F.lpad((tid % 1000).cast("string"), 3, "0")).alias("cvv"),
        F.concat(F.lpad((k % 14).cast("string"), 2, "0"), F.lit("/"),
                 F.lpad((20 + k % 10).cast("string"), 2, "0")).alias("expiry"),
        F.when(k % 6 == 0, F.concat("sender_id", F.lit("@bank")))
        .when(k % 6 == 1, F.col("sender_id"))
        .otherwise(F.concat(F.lit("user"), F.col("user_id").cast("string"), F.lit("@bank.com")))
        .alias("upi_id"),
    )


def feedback(txn: DataFrame) -> DataFrame:
    """Admin feedback events: two rounds on known ids, one on unknown ids."""
    k, tid = F.col("k"), F.col("txn_id")
    first = txn.where(tid % 50 == 0).select(
        tid.alias("txn_id"), (k % 2 == 0).alias("is_fraud"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("feedback_ts"))
    later = txn.where(tid % 500 == 0).select(
        tid.alias("txn_id"), (k % 3 == 0).alias("is_fraud"),
        (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("feedback_ts"))
    unknown = txn.where(tid % 1000 == 7).select(
        (tid + 1000000).alias("txn_id"), (k % 2 == 1).alias("is_fraud"),
        (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("feedback_ts"))
    return first.unionByName(later).unionByName(unknown)


def ledger(txn: DataFrame) -> DataFrame:
    """A scored ledger: labels, a fraud type and a probability by formula."""
    tid = F.col("txn_id")
    fraud = F.col("is_fraud") == 1
    return txn.select(
        "txn_id", "ts", "amount", "sender_id", "receiver_id", "txn_type", "merchant_type",
        "device_id", "location", "is_fraud",
        F.when(fraud, F.when(tid % 4 == 0, "SIM Swap").when(tid % 4 == 1, "Small Testing")
               .when(tid % 4 == 2, "CNP Fraud").otherwise("")).otherwise("-").alias("fraud_type"),
        ((tid * 7919 % 1000) / F.lit(1000.0)).alias("fraud_probability"),
        F.when(fraud, "BLOCKED").otherwise("COMPLETED").alias("status"),
    )
