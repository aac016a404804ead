"""Named queries over the driver's test tables, each with a DuckDB twin.

``QUERIES[name]`` is a callable ``(spark, sf_dir) -> DataFrame``; ``ORACLE[name]``
is the equivalent SQL over the base tables (fixture views inlined as CTEs).
Queries without an ``ORACLE`` entry are model- or stream-dependent and are
checked on row counts only.  Every query reads whole tables.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.functions import risk, validate
from txnrisk.operators import clean, evaluate, features, ledger, reports, rules
from txnrisk.operators import inject, locations
from txnrisk.plans import sql_parts as S
from txnrisk.plans.oracle_views import with_views
from txnrisk.schema import FEATURES
from txnrisk.sources import fixtures as fx

AS_OF = dt.date(2024, 2, 1)  # fixed "today" for expiry checks
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def _norm(df: DataFrame) -> DataFrame:
    """Integer columns as bigint so both engines report the same types."""
    cols = [F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType))
            else F.col(f.name) for f in df.schema.fields]
    return df.select(*cols)


def _txn(spark, sf):
    return fx.transactions(spark, sf)


def _hist(spark, sf):
    return features.history_features(_txn(spark, sf))


def _hist_sql(body: str) -> str:
    return with_views(body, "txn", extra=[("hist0", S.HIST0), ("hist", S.HIST)])


# ---------------------------------------------------------------- cleaning --
_NULLED_SQL = """SELECT txn_id, ts,
 CASE WHEN k % 25 = 2 THEN NULL ELSE amount END AS amount,
 CASE WHEN k % 31 = 3 THEN NULL ELSE device_id END AS device_id,
 CASE WHEN k % 29 = 4 THEN NULL ELSE merchant_type END AS merchant_type,
 CASE WHEN k % 23 = 5 THEN NULL ELSE location END AS location, txn_type, sender_id, receiver_id FROM txn"""


@query("clean_fill", with_views("""
SELECT txn_id, coalesce(amount, 0.0e0) AS amount, coalesce(device_id, 'Unknown') AS device_id,
 coalesce(merchant_type, 'Unknown') AS merchant_type, coalesce(location, '0.0, 0.0') AS location,
 CAST(0 AS BIGINT) AS is_fraud FROM nulled""", "txn", extra=[("nulled", _NULLED_SQL)]))
def q_clean_fill(spark, sf):
    t = _txn(spark, sf)
    k = F.col("k")
    nulled = t.select("txn_id", "ts",
                      F.when(k % 25 == 2, None).otherwise(F.col("amount")).alias("amount"),
                      F.when(k % 31 == 3, None).otherwise(F.col("device_id")).alias("device_id"),
                      F.when(k % 29 == 4, None).otherwise(F.col("merchant_type")).alias("merchant_type"),
                      F.when(k % 23 == 5, None).otherwise(F.col("location")).alias("location"),
                      "txn_type", "sender_id", "receiver_id")
    out = clean.fill_missing(clean.ensure_columns(nulled))
    return _norm(out.select("txn_id", "amount", "device_id", "merchant_type", "location", "is_fraud"))


@query("cast_label_status", with_views("""
SELECT txn_id, CAST(CASE WHEN lower(trim(lbl)) IN ('1', 'true', '1.0') THEN 1 ELSE 0 END AS BIGINT) AS label,
 CASE WHEN lower(trim(lbl)) IN ('1', 'true', '1.0') THEN 'Fraud' ELSE 'Success' END AS status
FROM (SELECT txn_id, CASE WHEN k % 3 = 0 THEN CAST(is_fraud AS VARCHAR)
      WHEN k % 3 = 1 THEN CASE WHEN is_fraud = 1 THEN 'True' ELSE 'False' END
      ELSE CASE WHEN is_fraud = 1 THEN 'true' ELSE 'no' END END AS lbl FROM txn)""", "txn"))
def q_cast_label(spark, sf):
    t = _txn(spark, sf)
    k, f = F.col("k"), F.col("is_fraud") == 1
    lbl = (F.when(k % 3 == 0, F.col("is_fraud").cast("string"))
           .when(k % 3 == 1, F.when(f, "True").otherwise("False"))
           .otherwise(F.when(f, "true").otherwise("no")))
    x = t.select("txn_id", clean.cast_label(lbl).alias("label"))
    return _norm(x.withColumn("status", clean.label_to_status(F.col("label"))))


@query("parse_location", with_views("""
SELECT txn_id,
 CASE WHEN len(string_split(location, ',')) = 2 THEN TRY_CAST(trim(string_split(location, ',')[1]) AS DOUBLE) END AS lat_raw,
 CASE WHEN len(string_split(location, ',')) = 2 THEN TRY_CAST(trim(string_split(location, ',')[2]) AS DOUBLE) END AS lon_raw
FROM txn""", "txn"))
def q_parse_location(spark, sf):
    from txnrisk.functions import geo
    t = _txn(spark, sf).withColumn("p", geo.parse_location(F.col("location")))
    return t.select("txn_id", F.col("p.lat").alias("lat_raw"), F.col("p.lon").alias("lon_raw"))


# --------------------------------------------------------- row features --
@query("time_features", with_views(f"SELECT txn_id, Hour, Day_of_Week, Is_Weekend, Is_Night FROM (SELECT txn_id, {S.ROW_FEATURES} FROM txn)", "txn"))
def q_time_features(spark, sf):
    f = features.row_features(_txn(spark, sf))
    return _norm(f.select("txn_id", "Hour", "Day_of_Week", "Is_Weekend", "Is_Night"))


@query("cyclic_features", with_views(f"SELECT txn_id, Hour_Sin, Hour_Cos, Day_Sin, Day_Cos FROM (SELECT txn_id, {S.ROW_FEATURES} FROM txn)", "txn"))
def q_cyclic(spark, sf):
    f = features.row_features(_txn(spark, sf))
    return f.select("txn_id", "Hour_Sin", "Hour_Cos", "Day_Sin", "Day_Cos")


@query("one_hot_fixed", with_views("""
SELECT txn_id,
 CASE WHEN txn_type = 'Card' THEN 1 ELSE 0 END AS Transaction_Type_Card,
 CASE WHEN txn_type = 'UPI' THEN 1 ELSE 0 END AS Transaction_Type_UPI,
 CASE WHEN txn_type = 'Netbanking' THEN 1 ELSE 0 END AS Transaction_Type_Netbanking,
 CASE WHEN merchant_type = 'Online_Retail' THEN 1 ELSE 0 END AS Merchant_Type_Online_Retail,
 CASE WHEN merchant_type = 'Food' THEN 1 ELSE 0 END AS Merchant_Type_Food,
 CASE WHEN merchant_type = 'Travel' THEN 1 ELSE 0 END AS Merchant_Type_Travel,
 CASE WHEN merchant_type = 'Entertainment' THEN 1 ELSE 0 END AS Merchant_Type_Entertainment,
 CASE WHEN merchant_type = 'Utilities' THEN 1 ELSE 0 END AS Merchant_Type_Utilities,
 CASE WHEN merchant_type = 'Unknown' THEN 1 ELSE 0 END AS Merchant_Type_Unknown
FROM txn""", "txn"))
def q_one_hot(spark, sf):
    f = features.one_hot_fixed(_txn(spark, sf))
    return _norm(f.select("txn_id", *[c for c in FEATURES if c.startswith(("Transaction_Type_", "Merchant_Type_"))]))


@query("standardize_amount", with_views("""
SELECT txn_id, (amount - mu) / CASE WHEN sd = 0 OR sd IS NULL THEN 1.0e0 ELSE sd END AS amount_z
FROM txn, (SELECT avg(amount) AS mu, stddev_pop(amount) AS sd FROM txn WHERE txn_id % 5 <> 0) s""", "txn"))
def q_standardize(spark, sf):
    t = _txn(spark, sf)
    stats = features.fit_standardizer(t.where(F.col("txn_id") % 5 != 0))
    return features.standardize(t, stats, out="amount_z").select("txn_id", "amount_z")


# ----------------------------------------------------- history features --
@query("gap_features", _hist_sql("SELECT txn_id, Time_Since_Last_Txn, Time_Diff_Hours FROM hist"))
def q_gap(spark, sf):
    return _hist(spark, sf).select("txn_id", "Time_Since_Last_Txn", "Time_Diff_Hours")


@query("gap_run_counts", _hist_sql("SELECT txn_id, Txn_Count_Last_1H, Txn_Count_Last_6H, Txn_Count_Last_24H FROM hist"))
def q_gap_counts(spark, sf):
    return _hist(spark, sf).select("txn_id", "Txn_Count_Last_1H", "Txn_Count_Last_6H", "Txn_Count_Last_24H")


@query("velocity_10min", _hist_sql("SELECT txn_id, Txn_Count_Last_10_Min FROM hist"))
def q_vel10(spark, sf):
    return _hist(spark, sf).select("txn_id", "Txn_Count_Last_10_Min")


@query("velocity_1_6_24h", with_views("""
SELECT txn_id,
 CAST(count(*) OVER (PARTITION BY sender_id ORDER BY ts RANGE BETWEEN INTERVAL '3599999999 microseconds' PRECEDING AND INTERVAL '1 microseconds' PRECEDING) + p AS BIGINT) AS Velocity_1H,
 CAST(count(*) OVER (PARTITION BY sender_id ORDER BY ts RANGE BETWEEN INTERVAL '21599999999 microseconds' PRECEDING AND INTERVAL '1 microseconds' PRECEDING) + p AS BIGINT) AS Velocity_6H,
 CAST(count(*) OVER (PARTITION BY sender_id ORDER BY ts RANGE BETWEEN INTERVAL '86399999999 microseconds' PRECEDING AND INTERVAL '1 microseconds' PRECEDING) + p AS BIGINT) AS Velocity_24H
FROM (SELECT *, row_number() OVER (PARTITION BY sender_id, ts ORDER BY txn_id) AS p FROM txn)""", "txn"))
def q_vel(spark, sf):
    return features.trailing_velocity(_txn(spark, sf)).select("txn_id", "Velocity_1H", "Velocity_6H", "Velocity_24H")


@query("rapid_count", _hist_sql("SELECT txn_id, Rapid_Txn_Count_Last_1H FROM hist"))
def q_rapid(spark, sf):
    return _hist(spark, sf).select("txn_id", "Rapid_Txn_Count_Last_1H")


@query("txn_ordinal", _hist_sql("SELECT txn_id, sender_id, Txn_Count_Total FROM hist"))
def q_ordinal(spark, sf):
    return _hist(spark, sf).select("txn_id", "sender_id", "Txn_Count_Total")


@query("amount_stats", _hist_sql("""
SELECT txn_id, avg_amount AS sender_mean_amount, amount - avg_amount AS Amount_Deviation,
 amount / CASE WHEN avg_amount = 0 THEN 0.01e0 ELSE avg_amount END AS Amount_Ratio,
 ln(1 + amount) AS Amount_Log,
 CASE WHEN amount <= 100 THEN 1 ELSE 0 END AS Is_Small_Amount,
 CASE WHEN amount >= 50000 THEN 1 ELSE 0 END AS Is_Large_Amount FROM hist"""))
def q_amount_stats(spark, sf):
    h = features.amount_stats(features.row_features(_hist(spark, sf)))
    return _norm(h.select("txn_id", F.col("_avg_amount").alias("sender_mean_amount"), "Amount_Deviation",
                          "Amount_Ratio", "Amount_Log", "Is_Small_Amount", "Is_Large_Amount"))


@query("amount_rolling", _hist_sql("SELECT txn_id, Amount_Rolling_Mean_10, Amount_Rolling_Std_10 FROM hist"))
def q_rolling(spark, sf):
    return _hist(spark, sf).select("txn_id", "Amount_Rolling_Mean_10", "Amount_Rolling_Std_10")


@query("device_features", _hist_sql("""
SELECT txn_id, Is_New_Device, Device_Count,
 CASE WHEN contains(device_id, 'Unknown') THEN 1 ELSE 0 END AS Is_Unknown_Device FROM hist"""))
def q_device(spark, sf):
    h = features.row_features(_hist(spark, sf))
    return _norm(h.select("txn_id", "Is_New_Device", "Device_Count", "Is_Unknown_Device"))


@query("device_count_so_far", with_views("""
SELECT txn_id, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sender_id ORDER BY ts, txn_id) AS BIGINT) AS device_count_so_far
FROM (SELECT *, row_number() OVER (PARTITION BY sender_id, device_id ORDER BY ts, txn_id) AS rn FROM txn)""", "txn"))
def q_device_so_far(spark, sf):
    return features.running_distinct(_txn(spark, sf), "device_id", "device_count_so_far").select(
        "txn_id", "device_count_so_far")


@query("receiver_diversity_so_far", with_views("""
SELECT txn_id, CAST(sum(CASE WHEN rn = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY sender_id ORDER BY ts, txn_id) AS BIGINT) AS receiver_diversity_so_far
FROM (SELECT *, row_number() OVER (PARTITION BY sender_id, receiver_id ORDER BY ts, txn_id) AS rn FROM txn)""", "txn"))
def q_recv_so_far(spark, sf):
    return features.running_distinct(_txn(spark, sf), "receiver_id", "receiver_diversity_so_far").select(
        "txn_id", "receiver_diversity_so_far")


@query("geo_distance", _hist_sql("SELECT txn_id, prev_location, Location_Distance_Km FROM hist"))
def q_geo_distance(spark, sf):
    return _hist(spark, sf).select("txn_id", "prev_location", "Location_Distance_Km")


@query("geo_speed", _hist_sql("""
SELECT txn_id, Is_Unusual_Location, Location_Speed_Kmh, CASE WHEN Location_Speed_Kmh > 1000 THEN 1 ELSE 0 END AS Is_High_Speed FROM hist"""))
def q_geo_speed(spark, sf):
    return _norm(_hist(spark, sf).select("txn_id", "Is_Unusual_Location", "Location_Speed_Kmh", "Is_High_Speed"))


@query("receiver_features", _hist_sql("""
SELECT txn_id, Is_First_Time_Receiver, Receiver_Frequency, Receiver_Diversity,
 CASE WHEN contains(receiver_id, 'Suspicious') THEN 1 ELSE 0 END AS Is_Suspicious_Receiver,
 CASE WHEN contains(receiver_id, 'Test') THEN 1 ELSE 0 END AS Is_Test_Receiver FROM hist"""))
def q_receiver(spark, sf):
    h = features.row_features(_hist(spark, sf))
    return _norm(h.select("txn_id", "Is_First_Time_Receiver", "Receiver_Frequency", "Receiver_Diversity",
                          "Is_Suspicious_Receiver", "Is_Test_Receiver"))


_MATRIX_SQL = _hist_sql(f"""
SELECT txn_id, CAST(is_fraud AS BIGINT) AS is_fraud, amount AS Amount, ln(1 + amount) AS Amount_Log,
 CASE WHEN txn_type = 'Card' THEN 1 ELSE 0 END AS Transaction_Type_Card,
 CASE WHEN txn_type = 'UPI' THEN 1 ELSE 0 END AS Transaction_Type_UPI,
 CASE WHEN txn_type = 'Netbanking' THEN 1 ELSE 0 END AS Transaction_Type_Netbanking,
 CASE WHEN merchant_type = 'Online_Retail' THEN 1 ELSE 0 END AS Merchant_Type_Online_Retail,
 CASE WHEN merchant_type = 'Food' THEN 1 ELSE 0 END AS Merchant_Type_Food,
 CASE WHEN merchant_type = 'Travel' THEN 1 ELSE 0 END AS Merchant_Type_Travel,
 CASE WHEN merchant_type = 'Entertainment' THEN 1 ELSE 0 END AS Merchant_Type_Entertainment,
 CASE WHEN merchant_type = 'Utilities' THEN 1 ELSE 0 END AS Merchant_Type_Utilities,
 CASE WHEN merchant_type = 'Unknown' THEN 1 ELSE 0 END AS Merchant_Type_Unknown,
 {S.ROW_FEATURES},
 Time_Since_Last_Txn, Txn_Count_Total, Txn_Count_Last_1H, Txn_Count_Last_6H, Txn_Count_Last_24H,
 Time_Diff_Hours, Rapid_Txn_Count_Last_1H,
 amount - avg_amount AS Amount_Deviation,
 amount / CASE WHEN avg_amount = 0 THEN 0.01e0 ELSE avg_amount END AS Amount_Ratio,
 CASE WHEN amount <= 100 THEN 1 ELSE 0 END AS Is_Small_Amount,
 CASE WHEN amount >= 50000 THEN 1 ELSE 0 END AS Is_Large_Amount,
 Amount_Rolling_Mean_10, Amount_Rolling_Std_10, Is_New_Device, Device_Count,
 CASE WHEN contains(device_id, 'Unknown') THEN 1 ELSE 0 END AS Is_Unknown_Device,
 Location_Distance_Km, Is_Unusual_Location, Location_Speed_Kmh,
 CASE WHEN Location_Speed_Kmh > 1000 THEN 1 ELSE 0 END AS Is_High_Speed,
 CASE WHEN contains(receiver_id, 'Suspicious') THEN 1 ELSE 0 END AS Is_Suspicious_Receiver,
 CASE WHEN contains(receiver_id, 'Test') THEN 1 ELSE 0 END AS Is_Test_Receiver,
 Is_First_Time_Receiver, Receiver_Diversity, Receiver_Frequency
FROM hist""")


@query("feature_matrix", _MATRIX_SQL)
def q_matrix(spark, sf):
    return _norm(features.build_features(_txn(spark, sf)))


_HIST_PIT = """
SELECT * REPLACE (
 avg(amount) OVER w AS avg_amount,
 CAST(sum(CASE WHEN dn = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS Device_Count,
 CAST(sum(CASE WHEN Receiver_Frequency = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS Receiver_Diversity)
FROM (SELECT *, row_number() OVER (PARTITION BY sender_id, device_id ORDER BY ts, txn_id) AS dn FROM hist)
WINDOW w AS (PARTITION BY sender_id ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""


def _matrix_pit_sql() -> str:
    body = _MATRIX_SQL[_MATRIX_SQL.rindex("\nSELECT txn_id, CAST(is_fraud"):]
    ctes = _MATRIX_SQL[: _MATRIX_SQL.rindex("\nSELECT txn_id, CAST(is_fraud")]
    return ctes + f",\nhist_p AS ({_HIST_PIT})" + body.replace("FROM hist", "FROM hist_p")


@query("feature_matrix_point_in_time", _matrix_pit_sql())
def q_matrix_pit(spark, sf):
    """The 44 features with the sender mean, device count and receiver
    diversity taken over each row's past only (training without look-ahead)."""
    return _norm(features.build_features(_txn(spark, sf), point_in_time=True))


@query("feature_profile", with_views("""
SELECT CAST(count(*) AS BIGINT) AS n_rows, avg(CAST(is_fraud AS DOUBLE)) AS fraud_ratio, CAST(44 AS BIGINT) AS n_features FROM txn""", "txn"))
def q_feature_profile(spark, sf):
    return reports.feature_profile(features.build_features(_txn(spark, sf)))


@query("order_gap_features", with_views("""
SELECT txn_id, CAST(row_number() OVER w AS BIGINT) AS Txn_Count_Total,
 coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w))/1e6/3600.0, 24.0e0) AS Time_Diff_Hours,
 avg(amount) OVER (w ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS Amount_Rolling_Mean_10
FROM otxn WINDOW w AS (PARTITION BY sender_id ORDER BY ts, txn_id)""", "otxn"))
def q_order_gaps(spark, sf):
    o = fx.orders_transactions(spark, sf)
    o = o.select("*", F.lit("D").alias("device_id"), F.lit("0, 0").alias("location"),
                 F.lit("R").alias("receiver_id"))
    h = features.history_features(o, totals=False)
    return h.select("txn_id", "Txn_Count_Total", "Time_Diff_Hours", "Amount_Rolling_Mean_10")


# -------------------------------------------------------------- validation --
def _req(spark, sf):
    return fx.requests(_txn(spark, sf))


_LUHN_SQL = """(length(regexp_replace(card_number, '[^0-9]', '', 'g')) IN (13, 15, 16) AND
 list_sum(list_transform(range(1, length(regexp_replace(card_number, '[^0-9]', '', 'g')) + 1), lambda i:
   CASE WHEN i % 2 = 0 THEN (CASE WHEN CAST(substring(reverse(regexp_replace(card_number, '[^0-9]', '', 'g')), i, 1) AS INTEGER) * 2 > 9
        THEN CAST(substring(reverse(regexp_replace(card_number, '[^0-9]', '', 'g')), i, 1) AS INTEGER) * 2 - 9
        ELSE CAST(substring(reverse(regexp_replace(card_number, '[^0-9]', '', 'g')), i, 1) AS INTEGER) * 2 END)
   ELSE CAST(substring(reverse(regexp_replace(card_number, '[^0-9]', '', 'g')), i, 1) AS INTEGER) END)) % 10 = 0)"""
_CVV_SQL = "coalesce(regexp_matches(cvv, '^[0-9]{3,4}$'), false)"
_EXP_SQL = """coalesce(length(expiry) = 5 AND substring(expiry, 3, 1) = '/'
 AND TRY_CAST(trim(substring(expiry, 1, 2)) AS INTEGER) BETWEEN 1 AND 12
 AND TRY_CAST(trim(substring(expiry, 4, 2)) AS INTEGER) IS NOT NULL
 AND NOT (TRY_CAST(trim(substring(expiry, 4, 2)) AS INTEGER) < 24
   OR (TRY_CAST(trim(substring(expiry, 4, 2)) AS INTEGER) = 24 AND TRY_CAST(trim(substring(expiry, 1, 2)) AS INTEGER) < 2)), false)"""
_UPI_SQL = "coalesce(regexp_matches(upi_id, '^[a-zA-Z0-9.-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}$'), false)"


@query("luhn", with_views(f"SELECT txn_id, card_number, {_LUHN_SQL} AS luhn_valid FROM req", "req"))
def q_luhn(spark, sf):
    r = _req(spark, sf)
    return r.select("txn_id", "card_number", validate.luhn_valid(F.col("card_number")).alias("luhn_valid"))


@query("cvv", with_views(f"SELECT txn_id, cvv, {_CVV_SQL} AS cvv_valid FROM req", "req"))
def q_cvv(spark, sf):
    r = _req(spark, sf)
    return r.select("txn_id", "cvv", validate.cvv_valid(F.col("cvv")).alias("cvv_valid"))


@query("expiry", with_views(f"SELECT txn_id, expiry, {_EXP_SQL} AS expiry_valid FROM req", "req"))
def q_expiry(spark, sf):
    r = _req(spark, sf)
    return r.select("txn_id", "expiry", validate.expiry_valid(F.col("expiry"), AS_OF).alias("expiry_valid"))


@query("upi_id", with_views(f"SELECT txn_id, upi_id, {_UPI_SQL} AS upi_valid FROM req", "req"))
def q_upi(spark, sf):
    r = _req(spark, sf)
    return r.select("txn_id", "upi_id", validate.upi_id_valid(F.col("upi_id")).alias("upi_valid"))


_VALIDATE_SQL = f"""CASE WHEN amount IS NULL AND txn_type IS NULL THEN 'Missing required fields: Amount, Transaction_Type'
 WHEN amount IS NULL THEN 'Missing required fields: Amount'
 WHEN txn_type IS NULL THEN 'Missing required fields: Transaction_Type'
 WHEN TRY_CAST(trim(CAST(amount AS VARCHAR)) AS DOUBLE) IS NULL THEN 'Invalid amount format'
 WHEN amount <= 0 THEN 'Amount must be greater than zero'
 WHEN upper(txn_type) = 'CARD' AND NOT {_LUHN_SQL} THEN 'Invalid card number'
 WHEN upper(txn_type) = 'CARD' AND NOT {_CVV_SQL} THEN 'Invalid CVV'
 WHEN upper(txn_type) = 'CARD' AND NOT {_EXP_SQL} THEN 'Invalid expiry date'
 WHEN upper(txn_type) = 'UPI' AND NOT {_UPI_SQL} THEN 'Invalid UPI ID format' END"""
_REQ2 = """SELECT txn_id, k, CASE WHEN k = 42 THEN NULL WHEN k = 43 THEN -1.0e0 WHEN k = 44 THEN 0.0e0 ELSE amount END AS amount,
 CASE WHEN k = 45 THEN NULL ELSE txn_type END AS txn_type, card_number, cvv, expiry, upi_id FROM req"""


def _req2(spark, sf):
    r = _req(spark, sf)
    k = F.col("k")
    return r.select("txn_id", "k",
                    F.when(k == 42, None).when(k == 43, -1.0).when(k == 44, 0.0).otherwise(F.col("amount")).alias("amount"),
                    F.when(k == 45, None).otherwise(F.col("txn_type")).alias("txn_type"),
                    "card_number", "cvv", "expiry", "upi_id")


@query("validate_requests", with_views(f"SELECT txn_id, {_VALIDATE_SQL} AS validation_message FROM req2", "req",
                                       extra=[("req2", _REQ2)]))
def q_validate(spark, sf):
    r = _req2(spark, sf)
    return r.select("txn_id", validate.validation_message(
        F.col("amount"), F.col("txn_type"), F.col("card_number"), F.col("cvv"), F.col("expiry"),
        F.col("upi_id"), AS_OF).alias("validation_message"))


@query("mask_card", with_views("SELECT txn_id, concat(substring(card_number, 1, 6), '******', substring(card_number, 13)) AS masked FROM req", "req"))
def q_mask(spark, sf):
    return _req(spark, sf).select("txn_id", validate.mask_card(F.col("card_number")).alias("masked"))


@query("card_risk_score", with_views("""
SELECT txn_id, CAST(least(
 (CASE WHEN length(card_number) > 0 AND contains(card_number, '4242') THEN 10 ELSE 0 END)
 + (CASE WHEN length(card_number) > 0 AND (length(card_number) < 16 OR length(card_number) > 19) THEN 20 ELSE 0 END)
 + (CASE WHEN length(card_number) > 0 AND regexp_matches(card_number, '0{6,}|1{6,}|2{6,}|3{6,}|4{6,}|5{6,}|6{6,}|7{6,}|8{6,}|9{6,}') THEN 30 ELSE 0 END)
 + (CASE WHEN length(cvv) > 0 AND cvv IN ('123', '000') THEN 15 ELSE 0 END)
 + (CASE WHEN length(expiry) > 0 AND coalesce((CASE WHEN trim(string_split(expiry, '/')[2]) = '' THEN 0.0e0
        ELSE TRY_CAST(trim(string_split(expiry, '/')[2]) AS DOUBLE) END) < 24, false) THEN 25 ELSE 0 END)
 + (CASE WHEN amount > 5000 THEN 20 ELSE 0 END), 100) AS BIGINT) AS card_risk FROM req""", "req"))
def q_card_risk(spark, sf):
    r = _req(spark, sf)
    return _norm(r.select("txn_id", risk.card_risk_score(F.col("card_number"), F.col("cvv"), F.col("expiry"),
                                                          F.col("amount"), AS_OF).alias("card_risk")))


@query("upi_risk_score", with_views("""
SELECT txn_id, CAST(least(
 (CASE WHEN length(u) > 0 AND NOT contains(u, '@') THEN 30 ELSE 0 END)
 + (CASE WHEN length(u) > 0 AND contains(u, 'suspicious') THEN 50 ELSE 0 END)
 + (CASE WHEN amount > 5000 THEN 20 ELSE 0 END), 100) AS BIGINT) AS upi_risk
FROM (SELECT txn_id, amount, CASE WHEN k % 5 = 0 THEN concat('suspicious', upi_id) WHEN k % 5 = 1 THEN replace(upi_id, '@', '') ELSE upi_id END AS u FROM req)""", "req"))
def q_upi_risk(spark, sf):
    r = _req(spark, sf)
    k = F.col("k")
    u = (F.when(k % 5 == 0, F.concat(F.lit("suspicious"), F.col("upi_id")))
         .when(k % 5 == 1, F.replace(F.col("upi_id"), F.lit("@"), F.lit(""))).otherwise(F.col("upi_id")))
    return _norm(r.select("txn_id", risk.upi_risk_score(u, F.col("amount")).alias("upi_risk")))


# ------------------------------------------------------------------ rules --
def _scored_sql(body: str) -> str:
    base = _hist_sql(f"SELECT 1")
    ctes = base[: base.rindex("\nSELECT 1")]
    return ctes + f",\nscored AS (SELECT *, {S.scores_select()} FROM hist)\n" + body


@query("infer_fraud_type", _scored_sql(f"SELECT txn_id, {S.pick_type_sql()} AS fraud_type FROM scored"))
def q_infer(spark, sf):
    return rules.infer_fraud_type(_hist(spark, sf)).select("txn_id", "fraud_type")


def _unpivot_sql() -> str:
    from txnrisk.schema import FRAUD_TYPES_BY_PAYMENT as BY, FRAUD_TYPES_OTHER as OTHER
    parts = []
    for cond, names in [("txn_type = 'UPI'", BY["UPI"]), ("txn_type = 'Card'", BY["Card"]),
                        ("txn_type NOT IN ('UPI', 'Card')", OTHER)]:
        for i, n in enumerate(names):
            parts.append(f"SELECT txn_id, CAST({i + 1} AS BIGINT) AS position, '{n}' AS fraud_type, "
                         f"{S.score_col(n)} AS score FROM scored WHERE {cond}")
    return " UNION ALL ".join(parts)


@query("fraud_type_scores", _scored_sql(_unpivot_sql()))
def q_type_scores(spark, sf):
    return _norm(rules.fraud_type_scores(_hist(spark, sf)))


_PROB = "(txn_id*7919 % 1000)/1000.0e0"


@query("decide", _scored_sql(f"""
SELECT s.txn_id, CASE WHEN v.msg IS NOT NULL THEN 'ERROR' WHEN {_PROB} >= 0.3 THEN 'BLOCKED' ELSE 'PENDING' END AS decision,
 CASE WHEN v.msg IS NOT NULL THEN v.msg WHEN {_PROB} >= 0.3 THEN {S.pick_type_sql('s.txn_type')} END AS reason,
 CASE WHEN {_PROB} >= 0.3 THEN 1 ELSE 0 END AS is_fraud_pred
FROM scored s JOIN (SELECT txn_id, {_VALIDATE_SQL} AS msg FROM req2) v ON s.txn_id = v.txn_id""".replace(
    "(txn_id*7919", "(s.txn_id*7919")).replace(
    "scored AS (", "req AS (" + __import__("txnrisk.plans.oracle_views", fromlist=["VIEWS"]).VIEWS["req"]
    + "), req2 AS (" + _REQ2 + "), scored AS (", 1))
def q_decide(spark, sf):
    """Validate, featurize, name the type and decide, all on the request rows
    themselves: the request fields ride through the history pass (no join)."""
    t = fx.with_request_fields(_txn(spark, sf))
    k = F.col("k")
    t = t.withColumns({
        "amount_in": F.when(k == 42, None).when(k == 43, -1.0).when(k == 44, 0.0).otherwise(F.col("amount")),
        "txn_type_in": F.when(k == 45, None).otherwise(F.col("txn_type"))})
    t = t.withColumn("validation_message", validate.validation_message(
        F.col("amount_in"), F.col("txn_type_in"), F.col("card_number"), F.col("cvv"), F.col("expiry"),
        F.col("upi_id"), AS_OF))
    h = rules.infer_fraud_type(features.history_features(t))
    h = h.withColumn("fraud_probability", (F.col("txn_id") * 7919 % 1000) / F.lit(1000.0))
    d = rules.decide(h, threshold=0.3)
    return _norm(d.select("txn_id", "decision", "reason", "is_fraud_pred"))


_STATUS_EVENTS_SQL = """
SELECT txn_id, ts AS event_ts, 0 AS seq, 'PENDING' AS status FROM ledger WHERE status = 'COMPLETED'
UNION ALL SELECT txn_id, ts + INTERVAL '1' MINUTE, 1, 'COMPLETED' FROM ledger WHERE status = 'COMPLETED' AND txn_id % 3 <> 0
UNION ALL SELECT txn_id, ts, 0, 'BLOCKED' FROM ledger WHERE status = 'BLOCKED'"""


def _status_events(spark, sf):
    lg = fx.ledger(_txn(spark, sf))
    done = F.col("status") == "COMPLETED"
    a = lg.where(done).select("txn_id", F.col("ts").alias("event_ts"), F.lit(0).alias("seq"), F.lit("PENDING").alias("status"))
    b = lg.where(done & (F.col("txn_id") % 3 != 0)).select(
        "txn_id", (F.col("ts") + F.expr("INTERVAL 1 MINUTE")).alias("event_ts"), F.lit(1).alias("seq"),
        F.lit("COMPLETED").alias("status"))
    c = lg.where(F.col("status") == "BLOCKED").select("txn_id", F.col("ts").alias("event_ts"), F.lit(0).alias("seq"),
                                                       F.lit("BLOCKED").alias("status"))
    return a.unionByName(b).unionByName(c)


@query("ledger_status", with_views("""
SELECT txn_id, max_by(status, event_ts * 1 + to_microseconds(seq)) AS status, CAST(count(*) AS BIGINT) AS n_events
FROM events_s GROUP BY txn_id""", "ledger", extra=[("events_s", _STATUS_EVENTS_SQL)]).replace(
    "event_ts * 1 + to_microseconds(seq)", "epoch_us(event_ts) * 2 + seq"))
def q_ledger_status(spark, sf):
    return rules.current_status(_status_events(spark, sf))


# ----------------------------------------------------------------- ledger --
@query("apply_feedback", with_views("""
SELECT coalesce(l.txn_id, f.txn_id) AS txn_id,
 CASE WHEN l.status IS NOT NULL THEN l.amount ELSE 0.0e0 END AS amount,
 CASE WHEN l.status IS NOT NULL THEN l.txn_type ELSE 'Unknown' END AS txn_type,
 CAST(CASE WHEN f.n IS NOT NULL THEN CASE WHEN f.last THEN 1 ELSE 0 END ELSE l.is_fraud END AS BIGINT) AS is_fraud,
 CASE WHEN f.n IS NOT NULL THEN
   CASE WHEN f.last THEN CASE WHEN l.fraud_type IS NOT NULL AND l.fraud_type NOT IN ('', '-') AND NOT f.any_legit
                              THEN l.fraud_type ELSE 'Admin Flagged' END ELSE '-' END
   ELSE l.fraud_type END AS fraud_type,
 CASE WHEN l.status IS NOT NULL THEN l.fraud_probability ELSE 0.5e0 END AS fraud_probability,
 CASE WHEN l.status IS NOT NULL THEN l.status ELSE 'COMPLETED' END AS status
FROM ledger l FULL OUTER JOIN
 (SELECT txn_id, max_by(is_fraud, feedback_ts) AS last, bool_or(NOT is_fraud) AS any_legit, count(*) AS n
  FROM feedback GROUP BY txn_id) f ON l.txn_id = f.txn_id""", "ledger", "feedback"))
def q_apply_feedback(spark, sf):
    t = _txn(spark, sf)
    out = ledger.apply_feedback(fx.ledger(t), fx.feedback(t))
    return _norm(out.select("txn_id", "amount", "txn_type", "is_fraud", "fraud_type", "fraud_probability", "status"))


_PRED_SQL = f"""SELECT txn_id, ts AS predicted_at, amount, txn_type,
 CASE WHEN {_PROB} >= 0.3 THEN 1 ELSE 0 END AS pred_is_fraud, fraud_type FROM ledger WHERE txn_id % 7 <> 0"""


def _predictions(spark, sf):
    lg = fx.ledger(_txn(spark, sf))
    p = (F.col("txn_id") * 7919 % 1000) / F.lit(1000.0)
    return lg.where(F.col("txn_id") % 7 != 0).select(
        "txn_id", F.col("ts").alias("predicted_at"), "amount", "txn_type",
        F.when(p >= 0.3, 1).otherwise(0).alias("pred_is_fraud"), "fraud_type")


@query("lookup_prediction", with_views("""
SELECT f.txn_id, CAST(f.is_fraud AS BIGINT) AS actual, CASE WHEN p.k IS NOT NULL THEN 1 ELSE 0 END AS found,
 CASE WHEN p.k IS NOT NULL THEN p.amount ELSE 0.0e0 END AS amount,
 CASE WHEN p.k IS NOT NULL THEN p.txn_type ELSE 'Unknown' END AS txn_type,
 CASE WHEN p.k IS NOT NULL THEN p.fraud_type ELSE CASE WHEN f.is_fraud THEN 'Admin Flagged' ELSE '-' END END AS fraud_type,
 CAST(p.pred AS BIGINT) AS predicted,
 CASE WHEN p.k IS NOT NULL AND p.pred <> CAST(f.is_fraud AS INTEGER) THEN 1 ELSE 0 END AS mismatch
FROM feedback f LEFT JOIN (SELECT CAST(txn_id AS VARCHAR) AS k, min_by(amount, predicted_at) AS amount,
  min_by(txn_type, predicted_at) AS txn_type, min_by(fraud_type, predicted_at) AS fraud_type,
  min_by(pred_is_fraud, predicted_at) AS pred FROM preds GROUP BY 1) p ON CAST(f.txn_id AS VARCHAR) = p.k""",
                                       "ledger", "feedback", extra=[("preds", _PRED_SQL)]))
def q_lookup(spark, sf):
    t = _txn(spark, sf)
    out = ledger.lookup_prediction(fx.feedback(t), _predictions(spark, sf))
    return _norm(out)


@query("describe_fraud_type", with_views("""
SELECT txn_id, fraud_type, coalesce(d.text, fraud_type) AS description FROM ledger LEFT JOIN (VALUES
""" + ",\n".join(f"('{c}', '{t}')" for c, t in __import__("txnrisk.schema", fromlist=["x"]).FRAUD_TYPE_DESCRIPTIONS)
+ ") d(code, text) ON ledger.fraud_type = d.code", "ledger"))
def q_describe(spark, sf):
    lg = fx.ledger(_txn(spark, sf))
    return ledger.describe_fraud_type(lg.select("txn_id", "fraud_type"))


@query("recent_per_class", with_views("""
SELECT txn_id, CAST(is_fraud AS BIGINT) AS is_fraud FROM (SELECT *, row_number() OVER (PARTITION BY is_fraud ORDER BY ts DESC, txn_id DESC) AS r FROM txn)
WHERE (is_fraud = 1 AND r <= 100) OR (is_fraud = 0 AND r <= 400)""", "txn"))
def q_recent(spark, sf):
    return _norm(ledger.recent_per_class(_txn(spark, sf)).select("txn_id", "is_fraud"))


@query("keep_latest", with_views("""
SELECT txn_id, feedback_ts FROM feedback ORDER BY feedback_ts DESC, txn_id DESC LIMIT 100""", "feedback"))
def q_keep_latest(spark, sf):
    return ledger.keep_latest(fx.feedback(_txn(spark, sf)), 100).select("txn_id", "feedback_ts")


@query("union_training", with_views("""
SELECT txn_id, amount, CAST(is_fraud AS BIGINT) AS is_fraud, NULL::VARCHAR AS source FROM txn
UNION ALL SELECT txn_id, NULL::DOUBLE, CASE WHEN is_fraud THEN 1 ELSE 0 END, 'feedback' FROM feedback""", "txn", "feedback"))
def q_union_training(spark, sf):
    t = _txn(spark, sf)
    fb = fx.feedback(t).select("txn_id", F.when(F.col("is_fraud"), 1).otherwise(0).alias("is_fraud"),
                               F.lit("feedback").alias("source"))
    return _norm(ledger.union_training(t.select("txn_id", "amount", "is_fraud"), fb))


# ---------------------------------------------------------------- reports --
@query("ledger_stats", with_views("""
SELECT CAST(count(*) AS BIGINT) AS total_transactions, CAST(sum(is_fraud) AS BIGINT) AS fraud_count,
 CAST(count(*) - sum(is_fraud) AS BIGINT) AS legitimate_count, round(sum(is_fraud) / count(*) * 100, 1) AS fraud_rate FROM ledger""", "ledger"))
def q_ledger_stats(spark, sf):
    return reports.ledger_stats(fx.ledger(_txn(spark, sf)))


@query("fraud_stats", with_views("""
SELECT CAST(count(*) AS BIGINT) AS total_transactions, CAST(sum(is_fraud) AS BIGINT) AS fraud_count,
 CAST(count(DISTINCT CASE WHEN is_fraud = 1 AND fraud_type <> '' THEN fraud_type END) AS BIGINT) AS n_fraud_types,
 round(sum(is_fraud) / count(*) * 100, 2) AS fraud_percentage FROM ledger""", "ledger"))
def q_fraud_stats(spark, sf):
    return reports.fraud_stats(fx.ledger(_txn(spark, sf))).drop("fraud_types")


@query("fraud_type_map", with_views("""
SELECT string_agg(concat(fraud_type, '=', n), ';' ORDER BY fraud_type) AS fraud_types FROM (
 SELECT fraud_type, count(*) AS n FROM ledger WHERE is_fraud = 1 AND fraud_type <> '' GROUP BY fraud_type)""", "ledger"))
def q_fraud_type_map(spark, sf):
    """The map type -> count of the fraud statistics, as text."""
    types = reports.fraud_stats(fx.ledger(_txn(spark, sf))).select(F.map_entries("fraud_types").alias("e"))
    pair = F.transform(F.array_sort("e"), lambda x: F.concat_ws("=", x["key"], x["value"].cast("string")))
    return types.select(F.array_join(pair, ";").alias("fraud_types"))


@query("order_by_time", with_views("""
SELECT txn_id, ts, CAST(row_number() OVER (ORDER BY ts, txn_id) - 1 AS BIGINT) AS position FROM txn""", "txn"))
def q_order_by_time(spark, sf):
    """Time order with each row's position, from a range-partitioned sort."""
    from txnrisk.operators import ranks
    placed = ranks.ordered_positions(_txn(spark, sf).select("txn_id", "ts"), [F.col("ts"), F.col("txn_id")])
    return ranks.order_by_time(placed.withColumn("position", F.col("position").cast("long")))


@query("fraud_type_distribution", with_views("""
SELECT fraud_type, CAST(count(*) AS BIGINT) AS n FROM ledger WHERE is_fraud = 1 AND fraud_type <> '' AND fraud_type <> '-' GROUP BY fraud_type""", "ledger"))
def q_type_dist(spark, sf):
    return reports.fraud_type_distribution(fx.ledger(_txn(spark, sf)))


@query("daily_volume", with_views("""
SELECT CAST(ts AS DATE) AS day, sum(amount) AS volume, CAST(count(*) AS BIGINT) AS n FROM ledger GROUP BY 1 ORDER BY 1""", "ledger"))
def q_daily(spark, sf):
    return reports.daily_volume(fx.ledger(_txn(spark, sf)))


@query("dataset_profile", with_views("""
SELECT txn_type, CAST(count(*) AS BIGINT) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, sum(is_fraud) / count(*) * 100 AS fraud_pct
FROM txn GROUP BY ROLLUP (txn_type)""", "txn"))
def q_profile(spark, sf):
    return reports.dataset_profile(_txn(spark, sf))


_PRED_FULL_SQL = f"""SELECT l.txn_id, l.is_fraud, CASE WHEN {_PROB.replace('txn_id', 'l.txn_id')} >= 0.3 THEN 1 ELSE 0 END AS pred_is_fraud,
 CASE WHEN l.txn_id % 97 = 0 THEN 'Error' ELSE i.fraud_type END AS fraud_type FROM ledger l JOIN inferred i ON l.txn_id = i.txn_id"""


def _pred_full(spark, sf):
    """Scored rows: label, prediction, inferred type (errors every 97th row)."""
    t = _txn(spark, sf)
    inf = rules.infer_fraud_type(features.history_features(t))
    p = (F.col("txn_id") * 7919 % 1000) / F.lit(1000.0)
    return inf.select("txn_id", "is_fraud", F.when(p >= 0.3, 1).otherwise(0).alias("pred_is_fraud"),
                      F.when(F.col("txn_id") % 97 == 0, "Error").otherwise(F.col("fraud_type")).alias("fraud_type"))


def _pred_sql(body: str) -> str:
    base = _scored_sql("SELECT 1")
    ctes = base[: base.rindex("\nSELECT 1")]
    ledger_cte = __import__("txnrisk.plans.oracle_views", fromlist=["VIEWS"]).VIEWS["ledger"]
    return (ctes + f",\nledger AS ({ledger_cte}),\ninferred AS (SELECT txn_id, {S.pick_type_sql()} AS fraud_type FROM scored)"
            f",\npreds AS ({_PRED_FULL_SQL})\n" + body)


@query("prediction_fraud_summary", _pred_sql("SELECT fraud_type, CAST(count(*) AS BIGINT) AS n FROM preds WHERE pred_is_fraud = 1 GROUP BY 1"))
def q_pred_summary(spark, sf):
    return reports.prediction_fraud_summary(_pred_full(spark, sf))


@query("run_summary", _pred_sql("""
SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum(is_fraud) AS BIGINT) AS actual_fraud, CAST(sum(pred_is_fraud) AS BIGINT) AS detected,
 CAST(sum(CASE WHEN is_fraud = 1 AND pred_is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS true_detected,
 CAST(sum(CASE WHEN fraud_type = 'Error' THEN 1 ELSE 0 END) AS BIGINT) AS errors,
 sum(CASE WHEN is_fraud = 1 AND pred_is_fraud = 1 THEN 1 ELSE 0 END) / sum(is_fraud) AS detection_rate FROM preds"""))
def q_run_summary(spark, sf):
    return reports.run_summary(_pred_full(spark, sf))


@query("scenario_scorecard", _pred_sql("""
SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN is_fraud = pred_is_fraud THEN 1 ELSE 0 END) AS BIGINT) AS correct,
 CAST(sum(is_fraud) AS BIGINT) AS n_fraud, CAST(sum(CASE WHEN is_fraud = 1 AND pred_is_fraud = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fraud_detected,
 CAST(sum(1 - is_fraud) AS BIGINT) AS n_legit, CAST(sum(CASE WHEN is_fraud = 0 AND pred_is_fraud = 0 THEN 1 ELSE 0 END) AS BIGINT) AS legit_passed,
 sum(CASE WHEN is_fraud = pred_is_fraud THEN 1 ELSE 0 END) / count(*) AS accuracy,
 sum(CASE WHEN is_fraud = 1 AND pred_is_fraud = 1 THEN 1 ELSE 0 END) / sum(is_fraud) AS fraud_recall,
 sum(CASE WHEN is_fraud = 0 AND pred_is_fraud = 0 THEN 1 ELSE 0 END) / sum(1 - is_fraud) AS legit_specificity FROM preds"""))
def q_scorecard(spark, sf):
    return reports.scenario_scorecard(_pred_full(spark, sf))


_RUNLOG_SQL = "SELECT DISTINCT date_trunc('day', ts) + INTERVAL '23' HOUR AS run_ts, (day(ts) % 4 <> 0) AS ok FROM txn"


@query("model_stats", with_views("""
SELECT l.last_retrained, b.training_data_size, p.predictions_count, l.last_retrained + INTERVAL '24' HOUR AS next_retrain_due
FROM (SELECT max(run_ts) AS last_retrained FROM runlog WHERE ok) l,
 (SELECT CAST(count(*) AS BIGINT) AS training_data_size FROM feedback) b,
 (SELECT CAST(count(*) AS BIGINT) AS predictions_count FROM txn) p""", "txn", "feedback", extra=[("runlog", _RUNLOG_SQL)]))
def q_model_stats(spark, sf):
    t = _txn(spark, sf)
    runlog = t.select((F.date_trunc("day", "ts") + F.expr("INTERVAL 23 HOURS")).alias("run_ts"),
                      (F.dayofmonth("ts") % 4 != 0).alias("ok")).distinct()
    return reports.model_stats(runlog, fx.feedback(t), t)


@query("retrain_due", with_views("""
SELECT CAST(n AS BIGINT) AS n_feedback, CAST(n_classes AS BIGINT) AS n_classes,
 (n >= 50 AND n_classes = 2 AND now_ts >= last_ts + INTERVAL '24' HOUR) AS due
FROM (SELECT count(*) AS n, count(DISTINCT is_fraud) AS n_classes, max(feedback_ts) AS now_ts FROM feedback),
 (SELECT max(run_ts) AS last_ts FROM runlog WHERE ok)""", "txn", "feedback", extra=[("runlog", _RUNLOG_SQL)]))
def q_retrain_due(spark, sf):
    from txnrisk.streaming.feedback import retrain_due
    t = _txn(spark, sf)
    runlog = t.select((F.date_trunc("day", "ts") + F.expr("INTERVAL 23 HOURS")).alias("run_ts"),
                      (F.dayofmonth("ts") % 4 != 0).alias("ok")).distinct()
    fb = fx.feedback(t)
    return retrain_due(runlog, fb, now=fb.agg(F.max("feedback_ts")))


# ------------------------------------------------------------- evaluation --
def _scored_eval(spark, sf, ties=False):
    t = _txn(spark, sf)
    mod = 10 if ties else 1000
    return t.select("txn_id", "is_fraud",
                    ((F.col("txn_id") * 7919 % mod) / F.lit(float(mod))).alias("score")) \
        .withColumn("pred", F.when(F.col("score") >= 0.5, 1).otherwise(0))


_EVAL_SQL = "SELECT txn_id, is_fraud, (txn_id*7919 % {m})/{m}.0e0 AS score, CASE WHEN (txn_id*7919 % {m})/{m}.0e0 >= 0.5 THEN 1 ELSE 0 END AS pred FROM txn"


def _eval_sql(body: str, ties=False) -> str:
    return with_views(body, "txn", extra=[("ev", _EVAL_SQL.format(m=10 if ties else 1000))])


@query("accuracy", _eval_sql("SELECT avg(CASE WHEN is_fraud = pred THEN 1.0e0 ELSE 0.0e0 END) AS accuracy, CAST(count(*) AS BIGINT) AS n FROM ev"))
def q_accuracy(spark, sf):
    return evaluate.accuracy(_scored_eval(spark, sf))


@query("confusion_matrix", _eval_sql("""
SELECT a.actual, a.predicted, CAST(coalesce(c.n, 0) AS BIGINT) AS n FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) a(actual, predicted)
LEFT JOIN (SELECT is_fraud AS actual, pred AS predicted, count(*) AS n FROM ev GROUP BY 1, 2) c USING (actual, predicted)"""))
def q_confusion(spark, sf):
    return _norm(evaluate.confusion_matrix(_scored_eval(spark, sf)))


_CR_C = """SELECT CAST(sum(CASE WHEN is_fraud = 0 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN is_fraud = 0 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN is_fraud = 1 AND pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
  CAST(sum(CASE WHEN is_fraud = 1 AND pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp FROM ev"""
_CR_M = """SELECT *, tn + fp + fn + tp AS n, tn + fp AS s0, tp + fn AS s1,
  CASE WHEN tn + fn > 0 THEN tn / (tn + fn) ELSE 0.0e0 END AS p0, CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0e0 END AS r0,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0e0 END AS p1, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0e0 END AS r1 FROM c"""
_CR_F = """SELECT *, CASE WHEN p0 + r0 > 0 THEN 2.0e0 * p0 * r0 / (p0 + r0) ELSE 0.0e0 END AS f0,
  CASE WHEN p1 + r1 > 0 THEN 2.0e0 * p1 * r1 / (p1 + r1) ELSE 0.0e0 END AS f1 FROM m"""
_CR_BODY = """SELECT '0' AS class, p0 AS precision, r0 AS recall, f0 AS f1, s0 AS support FROM f
UNION ALL SELECT '1', p1, r1, f1, s1 FROM f
UNION ALL SELECT 'accuracy', NULL, NULL, CASE WHEN n > 0 THEN (tn + tp) / n ELSE 0.0e0 END, n FROM f
UNION ALL SELECT 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n FROM f
UNION ALL SELECT 'weighted avg', CASE WHEN n > 0 THEN (p0 * s0 + p1 * s1) / n ELSE 0.0e0 END,
  CASE WHEN n > 0 THEN (r0 * s0 + r1 * s1) / n ELSE 0.0e0 END, CASE WHEN n > 0 THEN (f0 * s0 + f1 * s1) / n ELSE 0.0e0 END, n FROM f"""


@query("classification_report", with_views(_CR_BODY, "txn", extra=[
    ("ev", _EVAL_SQL.format(m=1000)), ("c", _CR_C), ("m", _CR_M), ("f", _CR_F)]))
def q_class_report(spark, sf):
    return _norm(evaluate.classification_report(_scored_eval(spark, sf)))


@query("roc_auc", _eval_sql("""
SELECT sum(pos * (neg_below + neg * 0.5e0)) / (sum(pos) * sum(neg)) AS roc_auc FROM (
 SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
 FROM (SELECT score, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM ev GROUP BY score))""", ties=True))
def q_auc(spark, sf):
    return evaluate.roc_auc(_scored_eval(spark, sf, ties=True))


_CURVE_SQL = """(SELECT score, sum(pos) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp,
 sum(neg) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp,
 sum(pos) OVER () AS P, sum(neg) OVER () AS N
 FROM (SELECT score, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM ev GROUP BY score))"""


@query("roc_curve", _eval_sql(f"SELECT score AS threshold, CASE WHEN N > 0 THEN fp / N ELSE 0.0e0 END AS fpr, CASE WHEN P > 0 THEN tp / P ELSE 0.0e0 END AS tpr FROM {_CURVE_SQL} UNION ALL SELECT NULL, 0.0e0, 0.0e0"))
def q_roc(spark, sf):
    return evaluate.roc_curve(_scored_eval(spark, sf))


@query("pr_curve", _eval_sql(f"SELECT score AS threshold, tp / (tp + fp) AS precision, CASE WHEN P > 0 THEN tp / P ELSE 0.0e0 END AS recall FROM {_CURVE_SQL} UNION ALL SELECT NULL, 1.0e0, 0.0e0"))
def q_pr(spark, sf):
    return evaluate.pr_curve(_scored_eval(spark, sf))


_SWEEP_SQL = """SELECT threshold, (tp + (n - pp - (P - tp))) / n AS accuracy,
 CASE WHEN pp > 0 THEN tp / pp ELSE 0.0e0 END AS precision, CASE WHEN P > 0 THEN tp / P ELSE 0.0e0 END AS recall
FROM (SELECT t.threshold, CAST(count(*) AS BIGINT) AS n, sum(is_fraud) AS P,
  sum(CASE WHEN is_fraud = 1 AND score >= t.threshold THEN 1 ELSE 0 END) AS tp,
  sum(CASE WHEN score >= t.threshold THEN 1 ELSE 0 END) AS pp
 FROM ev, (VALUES (0.1e0), (0.2e0), (0.3e0), (0.4e0), (0.5e0), (0.6e0), (0.7e0), (0.8e0), (0.9e0)) t(threshold) GROUP BY t.threshold)"""
_SWEEP_F1 = f"SELECT *, CASE WHEN precision + recall > 0 THEN 2.0e0 * precision * recall / (precision + recall) ELSE 0.0e0 END AS f1 FROM ({_SWEEP_SQL})"


@query("threshold_sweep", _eval_sql(_SWEEP_F1))
def q_sweep(spark, sf):
    return evaluate.threshold_sweep(_scored_eval(spark, sf))


@query("best_threshold", _eval_sql(f"""
SELECT coalesce((SELECT threshold FROM ({_SWEEP_F1}) WHERE f1 > 0 ORDER BY f1 DESC, threshold LIMIT 1), 0.3e0) AS best_threshold,
 (SELECT greatest(max(f1), 0.0e0) FROM ({_SWEEP_F1})) AS best_f1"""))
def q_best(spark, sf):
    return evaluate.best_threshold(evaluate.threshold_sweep(_scored_eval(spark, sf)))


@query("class_weights", with_views("""
SELECT CAST(is_fraud AS BIGINT) AS is_fraud, CAST(count(*) AS BIGINT) AS n, (SELECT count(*) FROM txn) / (2.0e0 * count(*)) AS weight
FROM txn GROUP BY is_fraud""", "txn"))
def q_class_weights(spark, sf):
    from txnrisk.operators.ml import class_weight_table
    return _norm(class_weight_table(_txn(spark, sf)))


def _uh(seed: int) -> str:
    return f"(('0x' || substring(sha256(concat(CAST(txn_id AS VARCHAR), '|{seed}')), 1, 13))::BIGINT / 4503599627370496.0e0)"


@query("stratified_split", with_views(f"""
SELECT CAST(is_fraud AS BIGINT) AS is_fraud, split, CAST(count(*) AS BIGINT) AS n FROM (
 SELECT is_fraud, CASE WHEN {_uh(42)} < 0.2 THEN 'test' ELSE 'train' END AS split FROM txn)
GROUP BY 1, 2""", "txn"))
def q_split(spark, sf):
    from txnrisk.operators.ml import hash_split
    s = hash_split(_txn(spark, sf), test_fraction=0.2, seed=42, key="txn_id")
    return _norm(s.groupBy("is_fraud", "split").agg(F.count(F.lit(1)).cast("long").alias("n")))


@query("stratified_split_exact", with_views(f"""
SELECT txn_id, CAST(is_fraud AS BIGINT) AS is_fraud,
 CASE WHEN row_number() OVER (PARTITION BY is_fraud ORDER BY u, txn_id) <= floor(count(*) OVER (PARTITION BY is_fraud) * 0.2e0 + 0.5e0)
      THEN 'test' ELSE 'train' END AS split FROM (SELECT txn_id, is_fraud, {_uh(42)} AS u FROM txn)""", "txn"))
def q_split_exact(spark, sf):
    """Exactly a fifth of each class, by histograms of the draws."""
    from txnrisk.operators.ml import stratified_split
    return _norm(stratified_split(_txn(spark, sf), 0.2, 42).select("txn_id", "is_fraud", "split"))


@query("roc_auc_distinct_scores", _eval_sql("""
SELECT sum(pos * (neg_below + neg * 0.5e0)) / (sum(pos) * sum(neg)) AS roc_auc FROM (
 SELECT score, pos, neg, coalesce(sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
 FROM (SELECT score, sum(is_fraud) AS pos, sum(1 - is_fraud) AS neg FROM ev GROUP BY score))"""))
def q_auc_distinct(spark, sf):
    """AUC over more distinct scores than there are score ranges."""
    return evaluate.roc_auc(_scored_eval(spark, sf))


# -------------------------------------------------------------- locations --
@query("nearest_city", with_views(f"""
SELECT txn_id, arg_min(city, d * 100 + city_pos) AS city, min(d) AS distance_km FROM (
 SELECT txn_id, city, city_pos, {S._dist('location', "concat(CAST(city_lat AS VARCHAR), ', ', CAST(city_lon AS VARCHAR))")} AS d
 FROM txn, cities WHERE location <> 'n/a') GROUP BY txn_id""", "txn", extra=[("cities", S.CITIES_SQL)]))
def q_nearest_city(spark, sf):
    t = _txn(spark, sf).where(F.col("location") != "n/a")
    return locations.nearest_city(t).select("txn_id", "city", "distance_km")


@query("city_of_all", with_views(f"""
SELECT t.txn_id, b.city, b.distance_km FROM txn t LEFT JOIN (
 SELECT txn_id, arg_min(city, d * 100 + city_pos) AS city, min(d) AS distance_km FROM (
  SELECT txn_id, city, city_pos, {S._dist('location', "concat(CAST(city_lat AS VARCHAR), ', ', CAST(city_lon AS VARCHAR))")} AS d
  FROM txn, cities WHERE len(string_split(location, ',')) = 2 AND TRY_CAST(trim(string_split(location, ',')[1]) AS DOUBLE) IS NOT NULL
   AND TRY_CAST(trim(string_split(location, ',')[2]) AS DOUBLE) IS NOT NULL) GROUP BY txn_id) b ON t.txn_id = b.txn_id""",
                              "txn", extra=[("cities", S.CITIES_SQL)]))
def q_city_of_all(spark, sf):
    """Every row, those without a usable location with a null city."""
    return locations.nearest_city(_txn(spark, sf)).select("txn_id", "city", "distance_km")


# -------------------------------------------------------------- injection --
@query("inject_simple", with_views(f"""
SELECT txn_id, CAST(CASE WHEN u < 0.2 THEN 1 ELSE is_fraud END AS BIGINT) AS is_fraud,
 CASE WHEN u < 0.2 THEN 5000 + 5000 * u2 ELSE amount END AS amount,
 CASE WHEN u < 0.2 THEN '0.0, 0.0' ELSE location END AS location,
 CASE WHEN u < 0.2 THEN 'DEV_Unknown' ELSE device_id END AS device_id,
 CASE WHEN u < 0.2 THEN 'Unknown' ELSE merchant_type END AS merchant_type
FROM (SELECT *, {_uh(7)} AS u, {_uh(1007)} AS u2 FROM txn)""", "txn"))
def q_inject_simple(spark, sf):
    out = inject.inject_simple(_txn(spark, sf), ratio=0.2, seed=7)
    return _norm(out.select("txn_id", "is_fraud", "amount", "location", "device_id", "merchant_type"))


def _nine_sql() -> str:
    vals = ",\n".join(
        f"({i}, '{n}', {S.dbl(lo)}, {S.dbl(hi)}, '{tt}', " + ", ".join(
            "NULL" if v is None else f"'{v}'" for v in (m, d, r, loc)) + ")"
        for i, (n, lo, hi, tt, m, d, r, loc) in enumerate(inject.NINE_PATTERNS))
    return with_views(f"""
SELECT txn_id, CAST(CASE WHEN hit THEN 1 ELSE is_fraud END AS BIGINT) AS is_fraud, p.name AS pattern,
 CASE WHEN hit THEN p.lo + (p.hi - p.lo) * u2 ELSE amount END AS amount,
 coalesce(p.rcv || CAST(txn_id AS VARCHAR), receiver_id) AS receiver_id,
 coalesce(p.tt, txn_type) AS txn_type, coalesce(p.merchant, merchant_type) AS merchant_type,
 coalesce(p.dev || CAST(txn_id AS VARCHAR), device_id) AS device_id, coalesce(p.loc, location) AS location
FROM (SELECT *, u < 0.03 AS hit, CASE WHEN u < 0.03 THEN least(CAST(floor(u / 0.03e0 * 9) AS INTEGER), 8) END AS idx
      FROM (SELECT *, {_uh(11)} AS u, {_uh(1011)} AS u2 FROM txn)) t
LEFT JOIN (VALUES {vals}) p(i, name, lo, hi, tt, merchant, dev, rcv, loc) ON t.idx = p.i""", "txn")


@query("inject_nine_patterns", _nine_sql())
def q_inject_nine(spark, sf):
    out = inject.inject_nine_patterns(_txn(spark, sf), ratio=0.03, seed=11)
    return _norm(out.select("txn_id", "is_fraud", "pattern", "amount", "receiver_id", "txn_type",
                            "merchant_type", "device_id", "location"))


def _nine_exact_sql() -> str:
    ranked = f"""SELECT *, row_number() OVER (ORDER BY u, txn_id) - 1 AS r, floor(count(*) OVER () * 0.03e0 + 0.5e0) AS m FROM (
  SELECT *, {_uh(11)} AS u, {_uh(1011)} AS u2 FROM txn)"""
    share = """CASE WHEN r < m THEN CAST(CASE WHEN r < (m % 9) * (floor(m / 9) + 1) THEN floor(r / (floor(m / 9) + 1))
   ELSE m % 9 + floor((r - (m % 9) * (floor(m / 9) + 1)) / greatest(floor(m / 9), 1)) END AS INTEGER) END"""
    sql = _nine_sql()
    old = sql[sql.index("FROM (SELECT *, u < 0.03 AS hit"):sql.index("LEFT JOIN (VALUES")]
    return sql.replace(old, f"FROM (SELECT *, r < m AS hit, {share} AS idx FROM ({ranked})) t\n")


@query("inject_nine_patterns_exact", _nine_exact_sql())
def q_inject_nine_exact(spark, sf):
    """Exactly 3 % of the rows, in nine equal shares."""
    out = inject.inject_nine_patterns(_txn(spark, sf), ratio=0.03, seed=11, exact=True)
    return _norm(out.select("txn_id", "is_fraud", "pattern", "amount", "receiver_id", "txn_type",
                            "merchant_type", "device_id", "location"))


def _anomaly_sql() -> str:
    from txnrisk.schema import CITIES
    pats = ",\n".join(
        f"({i}, '{n}', {lo}, {hi}, '{inject.RECEIVER_KINDS[k][0]}', {inject.RECEIVER_KINDS[k][1]}, "
        f"{inject.RECEIVER_KINDS[k][2]}, {str(loc).lower()}, {str(dev).lower()})"
        for i, (n, lo, hi, k, loc, dev) in enumerate(inject.ANOMALY_PATTERNS))
    texts = ", ".join(f"({i}, '{lat:.4f}, {lon:.4f}')" for i, (_, lat, lon) in enumerate(CITIES))
    dist = S._dist("location", "concat(CAST(city_lat AS VARCHAR), ', ', CAST(city_lon AS VARCHAR))")
    return with_views(f"""
SELECT t.txn_id, CAST(CASE WHEN hit THEN 1 ELSE is_fraud END AS BIGINT) AS is_fraud,
 CASE WHEN hit THEN replace(p.name, '_', ' ') END AS fraud_type,
 CASE WHEN hit THEN CAST(p.lo + floor(u0 * (p.hi - p.lo + 1)) AS DOUBLE) ELSE amount END AS amount,
 CASE WHEN hit THEN concat(p.rp, CAST(CAST(p.rlo + floor(u1 * (p.rhi - p.rlo + 1)) AS BIGINT) AS VARCHAR), '@', lower(txn_type))
      ELSE receiver_id END AS receiver_id,
 CASE WHEN hit AND p.dev THEN concat('Unknown_Device_', CAST(CAST(1 + floor(u3 * 100) AS BIGINT) AS VARCHAR)) ELSE device_id END AS device_id,
 CASE WHEN hit AND p.loc THEN ct.txt ELSE location END AS location,
 CASE WHEN hit THEN 'Unknown' ELSE merchant_type END AS merchant_type
FROM (SELECT x.*, u < 0.08 AS hit, CASE WHEN u < 0.08 THEN least(CAST(floor(u / 0.08e0 * 7) AS INTEGER), 6) END AS idx,
        ((coalesce(b.pos, 0) + 1 + CAST(floor(u2 * 7) AS INTEGER)) % 8) AS other
      FROM (SELECT *, {_uh(13)} AS u, {_uh(1013)} AS u0, {_uh(2013)} AS u1, {_uh(3013)} AS u2, {_uh(4013)} AS u3 FROM txn) x
      LEFT JOIN (SELECT txn_id, arg_min(city_pos, d * 100 + city_pos) AS pos FROM (
          SELECT txn_id, city_pos, {dist} AS d FROM txn, cities
          WHERE len(string_split(location, ',')) = 2
            AND TRY_CAST(trim(string_split(location, ',')[1]) AS DOUBLE) IS NOT NULL
            AND TRY_CAST(trim(string_split(location, ',')[2]) AS DOUBLE) IS NOT NULL) GROUP BY txn_id) b
      ON x.txn_id = b.txn_id) t
LEFT JOIN (VALUES {pats}) p(i, name, lo, hi, rp, rlo, rhi, loc, dev) ON t.idx = p.i
LEFT JOIN (VALUES {texts}) ct(i, txt) ON t.other = ct.i""", "txn", extra=[("cities", S.CITIES_SQL)])


@query("inject_anomaly_patterns", _anomaly_sql())
def q_inject_anomaly(spark, sf):
    out = inject.inject_anomaly_patterns(_txn(spark, sf), ratio=0.08, seed=13)
    return _norm(out.select("txn_id", "is_fraud", "fraud_type", "amount", "receiver_id", "device_id",
                            "location", "merchant_type"))


@query("fraud_type_counts", _scored_sql(f"""
SELECT fraud_type, CAST(count(*) AS BIGINT) AS n FROM (SELECT {S.pick_type_sql()} AS fraud_type FROM scored) GROUP BY fraud_type"""))
def q_type_counts(spark, sf):
    """Flagship: one scan, the (sender, day) history pass, rules, one aggregate."""
    t = rules.infer_fraud_type(_hist(spark, sf))
    return t.groupBy("fraud_type").agg(F.count(F.lit(1)).cast("long").alias("n"))


# -------------------------------------------------------------- streaming --
ARRIVAL_SPREAD_HOURS = 12  # rows arrive up to so much later than they happen


def _arrival(hours: int = 0):
    """Arrival time: the event time and a delay by id, so rows of a sender arrive out of order."""
    late = F.pmod(F.xxhash64("txn_id"), F.lit(ARRIVAL_SPREAD_HOURS * 3_600_000_000))
    return F.unix_micros(F.col("ts").cast("timestamp")) + late + F.lit(hours * 3_600_000_000)


def _stream_features(spark, sf, repeat: bool = False):
    from txnrisk.streaming import scoring
    from txnrisk.streaming.sender_state import sender_state_features
    t = _txn(spark, sf).drop("user_id", "k").withColumn("arrival", _arrival())
    if repeat:  # every fifth row is sent again six hours later
        t = t.unionByName(t.where(F.col("txn_id") % 5 == 0).withColumn("arrival", _arrival(6)))
    src, out = scoring.scratch(spark, "src"), scoring.scratch(spark, "out")
    files = scoring.replay_source(t, src, n_files=8, arrival=F.col("arrival"))
    scoring.seal_source(t, src)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 2 * files).parquet(src)
    scoring.stream_to_parquet(sender_state_features(stream), out, scoring.scratch(spark, "ckpt"))
    return spark.read.parquet(out)


_STREAM_FEATURES_SQL = _hist_sql("""
SELECT sender_id, txn_id, ts, amount, device_id, location, receiver_id, txn_type, merchant_type, is_fraud,
 Time_Since_Last_Txn, Time_Diff_Hours, Txn_Count_Total, Txn_Count_Last_1H, Txn_Count_Last_6H, Txn_Count_Last_24H,
 Rapid_Txn_Count_Last_1H, Amount_Rolling_Mean_10, Amount_Rolling_Std_10, CAST(Is_New_Device AS BIGINT) AS Is_New_Device,
 Location_Distance_Km, CAST(Is_Unusual_Location AS BIGINT) AS Is_Unusual_Location, Location_Speed_Kmh,
 CAST(CASE WHEN Location_Speed_Kmh > 1000 THEN 1 ELSE 0 END AS BIGINT) AS Is_High_Speed, Receiver_Frequency,
 CAST(Is_First_Time_Receiver AS BIGINT) AS Is_First_Time_Receiver, Txn_Count_Last_10_Min,
 CAST(sum(CASE WHEN dn = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS device_count_so_far,
 CAST(sum(CASE WHEN Receiver_Frequency = 1 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS receiver_diversity_so_far,
 avg(amount) OVER w AS sender_mean_so_far
FROM (SELECT *, row_number() OVER (PARTITION BY sender_id, device_id ORDER BY ts, txn_id) AS dn FROM hist)
WINDOW w AS (PARTITION BY sender_id ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")


@query("stream_features", _STREAM_FEATURES_SQL)
def q_stream_features(spark, sf):
    """Replay the table, out of order, as a file stream through keyed sender state."""
    return _stream_features(spark, sf).drop("epoch", "late", "refused")


@query("stream_velocity", _hist_sql("SELECT txn_id, sender_id, Txn_Count_Last_10_Min FROM hist"))
def q_stream_velocity(spark, sf):
    return _stream_features(spark, sf).select("txn_id", "sender_id", "Txn_Count_Last_10_Min")


@query("stream_deduplicated", _hist_sql("""
SELECT txn_id, sender_id, Txn_Count_Total, Receiver_Frequency, Txn_Count_Last_10_Min, Time_Since_Last_Txn,
 avg(amount) OVER (PARTITION BY sender_id ORDER BY ts, txn_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sender_mean_so_far,
 CAST(CASE WHEN txn_id % 5 = 0 THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM hist"""))
def q_stream_deduplicated(spark, sf):
    """Every fifth row is sent twice: the repeats come out as such and count in no feature."""
    out = _stream_features(spark, sf, repeat=True)
    repeats = out.where(F.col("refused") == "duplicate").groupBy("txn_id").agg(F.count(F.lit(1)).cast("long").alias("repeats"))
    return (out.where(F.col("refused").isNull()).join(repeats, "txn_id", "left")
            .select("txn_id", "sender_id", "Txn_Count_Total", "Receiver_Frequency", "Txn_Count_Last_10_Min", "Time_Since_Last_Txn",
                    "sender_mean_so_far", F.coalesce("repeats", F.lit(0)).alias("repeats")))


def _stream_ledger_sql() -> str:
    """History over the valid requests only; invalid ones come out with their message."""
    views = __import__("txnrisk.plans.oracle_views", fromlist=["VIEWS"]).VIEWS
    probability = "(txn_id * 7919 % 1000) / 1000.0e0"
    return f"""WITH alltxn AS ({views["txn"]}),
req AS ({views["req"].replace("FROM txn", "FROM alltxn")}),
req2 AS ({_REQ2}),
msgs AS (SELECT txn_id, amount, txn_type, {_VALIDATE_SQL} AS msg FROM req2),
txn AS (SELECT t.* FROM alltxn t JOIN msgs m ON t.txn_id = m.txn_id WHERE m.msg IS NULL),
hist0 AS ({S.HIST0}), hist AS ({S.HIST}),
scored AS (SELECT *, {S.scores_select()} FROM hist),
decided AS (SELECT txn_id, amount, {probability} AS p, {S.pick_type_sql()} AS fraud_type FROM scored)
SELECT m.txn_id, CASE WHEN m.msg IS NOT NULL THEN 'ERROR' WHEN p >= 0.3 THEN 'BLOCKED' ELSE 'PENDING' END AS decision,
 CASE WHEN m.msg IS NOT NULL THEN m.msg WHEN p >= 0.3 THEN fraud_type END AS reason,
 CASE WHEN p >= 0.3 THEN 'BLOCKED' WHEN p IS NOT NULL THEN 'PENDING' END AS ledger_status, d.amount AS ledger_amount,
 CASE WHEN p >= 0.3 THEN fraud_type WHEN p IS NOT NULL THEN '' END AS ledger_type
FROM msgs m LEFT JOIN decided d ON m.txn_id = d.txn_id"""


@query("stream_ledger", _stream_ledger_sql())
def q_stream_ledger(spark, sf):
    """JSON requests, out of order: validate, featurize, decide by a fixed score, append to the ledger by epoch."""
    from txnrisk.schema import LEDGER_SCHEMA
    from txnrisk.sources import io
    from txnrisk.sources.commits import EpochTable
    from txnrisk.streaming import scoring
    k = F.col("k")
    t = fx.with_request_fields(_txn(spark, sf)).withColumn("arrival", _arrival())
    t = t.withColumns({"amount": F.when(k == 42, None).when(k == 43, -1.0).when(k == 44, 0.0).otherwise(F.col("amount")),
                       "txn_type": F.when(k == 45, None).otherwise(F.col("txn_type"))}).drop("user_id", "k")
    src, out, ledger_at = (scoring.scratch(spark, x) for x in ("requests", "decisions", "ledger"))
    files = scoring.replay_source(t, src, n_files=4, arrival=F.col("arrival"), fmt="json")
    scoring.seal_source(t, src, fmt="json")
    events = io.read_transaction_stream(spark, src, schema=t.schema, max_files_per_trigger=2 * files)
    scoring.run_scoring_stream(spark, events, None, None, out, scoring.scratch(spark, "ckpt"), as_of=AS_OF, ledger=ledger_at,
                               probability=(F.col("txn_id") * 7919 % 1000) / F.lit(1000.0))
    kept = EpochTable(spark, ledger_at).rows(LEDGER_SCHEMA).select(
        F.col("txn_id").cast("long").alias("txn_id"), F.col("status").alias("ledger_status"), F.col("amount").alias("ledger_amount"),
        F.col("fraud_type").alias("ledger_type"))
    return spark.read.parquet(out).select("txn_id", "decision", "reason").join(kept, "txn_id", "left")


@query("stream_score")
def q_stream_score(spark, sf):
    """Train a forest on the batch features, then validate-score-decide the
    replayed stream with it."""
    from txnrisk.operators import ml
    from txnrisk.streaming import scoring
    t = _txn(spark, sf)
    # Trained on point-in-time features: the stream's sender state only knows the past.
    feats = ml.hash_split(_computed(features.build_features(t, point_in_time=True), "features"), 0.2, 42)
    model = ml.fit(ml.random_forest_pipeline(), feats.where(F.col("split") == "train"))
    raw = t.drop("user_id", "k")
    src, out = scoring.scratch(spark, "src"), scoring.scratch(spark, "out")
    files = scoring.replay_source(raw, src, n_files=4)
    scoring.seal_source(raw, src)
    scoring.run_scoring_stream(spark, src, raw.schema, model, out, scoring.scratch(spark, "ckpt"),
                               max_files_per_trigger=2 * files)
    return spark.read.parquet(out).select("txn_id", "fraud_probability", "fraud_type", "decision", "reason")


@query("stream_feedback", ORACLE["apply_feedback"])
def q_stream_feedback(spark, sf):
    """Feedback events replayed as a file stream; each micro-batch is a delta of
    the ledger, compacted on the way.  Equals the one-shot batch upsert."""
    from txnrisk.sources.delta_ledger import DeltaLedger
    from txnrisk.streaming import scoring
    t = _txn(spark, sf)
    work = scoring.scratch(spark, "fb")
    fx.ledger(t).write.parquet(f"{work}/ledger_v0")
    fb = fx.feedback(t)
    files = scoring.replay_source(fb, f"{work}/src", n_files=4, ts="feedback_ts")
    final = scoring.run_feedback_stream(spark, f"{work}/src", fb.schema, f"{work}/ledger_v0", work, max_files_per_trigger=files,
                                        compact_every=3)
    out = DeltaLedger(spark, final).rows()
    return _norm(out.select("txn_id", "amount", "txn_type", "is_fraud", "fraud_type", "fraud_probability", "status"))


# --------------------------------------------------------------------- ML --
def _computed(df: DataFrame, name: str) -> DataFrame:
    """``df`` computed once, as a Parquet table: a fit reads its rows several times, and the scoring once more."""
    from txnrisk.streaming.scoring import scratch
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _split_features(spark, sf):
    from txnrisk.operators import ml
    return ml.hash_split(_computed(features.build_features(_txn(spark, sf)), "features"), 0.2, 42)


@query("train_rf")
def q_train_rf(spark, sf):
    """Random forest on the train split (balanced weights); test-split scores."""
    from txnrisk.operators import ml
    f = _split_features(spark, sf)
    model = ml.fit(ml.random_forest_pipeline(), f.where(F.col("split") == "train"))
    return ml.score(model, f.where(F.col("split") == "test")).select("txn_id", "is_fraud", "score", "pred")


@query("train_gbt")
def q_train_gbt(spark, sf):
    """Boosted trees with fixed positive weight 10; test-split scores."""
    from txnrisk.operators import ml
    f = _split_features(spark, sf)
    model = ml.fit(ml.boosted_trees_pipeline(), f.where(F.col("split") == "train"),
                   balance="fixed", fixed_positive=10.0)
    return ml.score(model, f.where(F.col("split") == "test")).select("txn_id", "is_fraud", "score", "pred")


@query("feature_importance")
def q_importance(spark, sf):
    from txnrisk.operators import ml
    f = _split_features(spark, sf)
    model = ml.fit(ml.random_forest_pipeline(), f.where(F.col("split") == "train"))
    rows = ml.feature_importance(model)
    return spark.createDataFrame([(n, float(v)) for n, v in rows], "feature string, importance double")


@query("smote")
def q_smote(spark, sf):
    """Synthetic fraud rows on the train split until the classes balance."""
    from txnrisk.operators import ml
    f = _split_features(spark, sf).where(F.col("split") == "train")
    return ml.smote(f, k=5, seed=42)


_OHE_CATS = ["txn_type", "merchant_type", "sender_id", "receiver_id", "device_id", "location"]


def _one_hot_sql() -> str:
    train = f"{_uh(42)} >= 0.2"
    extra, cols, joins = [], [], []
    for c in _OHE_CATS:
        extra.append((f"lab_{c}", f"""SELECT {c} AS v, row_number() OVER (ORDER BY count(*) DESC, {c}) - 1 AS i,
 count(*) OVER () AS n FROM txn WHERE {train} GROUP BY {c}"""))
        extra.append((f"n_{c}", f"SELECT count(DISTINCT {c}) AS n FROM txn WHERE {train}"))
        cols.append(f"CAST((SELECT n FROM n_{c}) + 1 AS BIGINT) AS {c}_width")
        cols.append(f"CAST(coalesce(l_{c}.i, (SELECT n FROM n_{c})) AS DOUBLE) AS {c}_index")
        joins.append(f"LEFT JOIN lab_{c} l_{c} ON t.{c} = l_{c}.v")
    body = f"SELECT t.txn_id, {', '.join(cols)} FROM txn t " + " ".join(joins)
    return with_views(body, "txn", extra=extra)


@query("one_hot_learned", _one_hot_sql())
def q_one_hot_learned(spark, sf):
    """Indexer + one-hot over the six categoricals, ids included, fit on train."""
    from txnrisk.operators import ml
    cats = _OHE_CATS
    t = ml.hash_split(clean.clean_ids(_txn(spark, sf), numeric=["amount"], categorical=cats), 0.2, 42)
    model = ml.learned_one_hot(cats).fit(t.where(F.col("split") == "train"))
    out = model.transform(t)
    return _norm(out.select("txn_id", *[F.lit(model.sizes[c] + 1).cast("long").alias(f"{c}_width") for c in cats],
                            *[F.col(f"{c}_idx").alias(f"{c}_index") for c in cats]))


def _feedback_buffer(spark, sf):
    """Feedback as labelled transactions: those of known ids, by their latest verdict."""
    t = _txn(spark, sf)
    last = ledger.latest_feedback(fx.feedback(t)).select("txn_id", "fb_is_fraud", F.col("fb_first_ts").alias("feedback_ts"))
    t = t.drop("user_id", "k")
    return t, t.join(last, "txn_id").withColumn("is_fraud", F.col("fb_is_fraud").cast("int")).drop("fb_is_fraud")


@query("retrain")
def q_retrain(spark, sf):
    """Refit on the training rows plus the feedback rows, publish the model,
    load the published one and score the test split."""
    from txnrisk.operators import ml
    from txnrisk.streaming.scoring import scratch
    t, buffer = _feedback_buffer(spark, sf)
    split = ml.hash_split(t, 0.2, 42)
    models = scratch(spark, "models")
    done = ml.retrain(split.where("split = 'train'").drop("split"), buffer, models)
    if done["version"] is None:
        raise ValueError("retraining needs both classes")
    test = ml.hash_split(features.build_features(t), 0.2, 42).where("split = 'test'")
    return ml.score(ml.load_pipeline(models), test).select("txn_id", "is_fraud", "score", "pred")


@query("retrain_run", with_views(f"""
SELECT CAST(1 AS BIGINT) AS version, (SELECT CAST(count(DISTINCT txn_id) AS BIGINT) FROM known) AS n_feedback, n_training, n_fraud,
 least(100, (SELECT count(DISTINCT txn_id) FROM known) // 5) AS n_kept
FROM (SELECT CAST(count(*) AS BIGINT) AS n_training, CAST(sum(is_fraud) AS BIGINT) AS n_fraud FROM (
 SELECT is_fraud FROM txn WHERE {_uh(42)} >= 0.2
 UNION ALL SELECT CASE WHEN max_by(is_fraud, feedback_ts) THEN 1 ELSE 0 END FROM known GROUP BY txn_id))""", "feedback",
                             extra=[("known", "SELECT f.* FROM feedback f JOIN txn t ON f.txn_id = t.txn_id")]))
def q_retrain_run(spark, sf):
    """What a retrain reports: the published version, the rows it trained on and the buffer it kept (small trees)."""
    from txnrisk.operators import ml
    from txnrisk.sources.commits import Versions
    from txnrisk.streaming.scoring import scratch
    t, buffer = _feedback_buffer(spark, sf)
    train = ml.hash_split(t, 0.2, 42).where("split = 'train'").drop("split")
    models, kept = scratch(spark, "models"), scratch(spark, "buffer")
    ml.retrain(train, buffer, models, pipeline=ml.random_forest_pipeline(num_trees=3, max_depth=4), buffer_store=kept)
    number, entry = Versions(spark, models).latest()
    n_kept = spark.read.parquet(Versions(spark, kept).path()).agg(F.count(F.lit(1)).alias("n_kept"))
    seen = buffer.agg(F.count(F.lit(1)).alias("n_feedback"))
    fraud = train.select("is_fraud").unionByName(buffer.select("is_fraud")).agg(F.sum("is_fraud").cast("long").alias("n_fraud"))
    row = clean.attach_one_row(clean.attach_one_row(seen, fraud), n_kept)
    return row.select(F.lit(number).cast("long").alias("version"), "n_feedback", F.lit(entry["n_training"]).cast("long").alias("n_training"),
                      "n_fraud", "n_kept")


# -------------------------------------------------------- sources / sinks --
_TXN_IO_SQL = with_views("""
SELECT CAST(txn_id AS VARCHAR) AS txn_id, ts, amount, sender_id, receiver_id, txn_type, merchant_type, device_id,
 location, CAST(is_fraud AS BIGINT) AS is_fraud FROM txn""", "txn")


@query("csv_roundtrip", _TXN_IO_SQL)
def q_csv_roundtrip(spark, sf):
    """Write the transactions as headed CSV, read them back with the schema."""
    from txnrisk.sources import io
    from txnrisk.streaming.scoring import scratch
    t = _txn(spark, sf).drop("user_id", "k")
    path = scratch(spark, "csv")
    io.write_transactions(t, path)
    return _norm(io.read_transactions(spark, path))


@query("csv_by_name", _TXN_IO_SQL)
def q_csv_by_name(spark, sf):
    """CSV with its columns in another order, one more column, and two broken lines, which are quarantined."""
    from txnrisk.sources import io
    from txnrisk.streaming.scoring import scratch
    t = _txn(spark, sf).drop("user_id")
    order = ["location", "is_fraud", "k", "txn_id", "amount", "ts", "device_id", "merchant_type", "txn_type", "receiver_id", "sender_id"]
    path = scratch(spark, "csv")
    io.write_transactions(t.select(*order), path)
    head = ",".join(io.CSV_HEADER.get(c, c) for c in order)
    spark.createDataFrame([(f"{head}\nonly,three,fields\n{head},and,more",)], "line string").coalesce(1).write.mode("append").text(path)
    if io.quarantined_lines(spark, path).count() != 2:
        raise ValueError("two lines are broken")
    return _norm(io.read_transactions(spark, path))


@query("json_predictions", with_views("""
SELECT txn_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS ts, fraud_type, fraud_probability,
 CAST(CASE WHEN fraud_probability >= 0.3 THEN 1 ELSE 0 END AS BIGINT) AS pred_is_fraud FROM ledger""", "ledger"))
def q_json_predictions(spark, sf):
    """Predictions written as JSON lines (ISO timestamps) and read back."""
    from txnrisk.sources import io
    from txnrisk.streaming.scoring import scratch
    lg = fx.ledger(_txn(spark, sf))
    pred = lg.select("txn_id", "ts", "fraud_type", "fraud_probability",
                     F.when(F.col("fraud_probability") >= 0.3, 1).otherwise(0).alias("pred_is_fraud"))
    path = scratch(spark, "json")
    io.write_predictions(pred, path)
    schema = "txn_id long, ts string, fraud_type string, fraud_probability double, pred_is_fraud long"
    return spark.read.schema(schema).json(path)


@query("ledger_roundtrip", with_views("""
SELECT CAST(txn_id AS VARCHAR) AS txn_id, amount, is_fraud, fraud_type, status FROM (
 SELECT txn_id, amount, CAST(is_fraud AS INTEGER) AS is_fraud, fraud_type, 'PENDING' AS status FROM ledger WHERE status = 'COMPLETED'
 UNION ALL SELECT txn_id, amount, CAST(is_fraud AS INTEGER), fraud_type, status FROM ledger)""", "ledger"))
def q_ledger_roundtrip(spark, sf):
    """Create the ledger, append pending then final rows, rewrite it as a new
    version and read the current version."""
    from txnrisk.sources import io
    from txnrisk.streaming.scoring import scratch
    lg = fx.ledger(_txn(spark, sf)).withColumn("txn_id", F.col("txn_id").cast("string"))
    base = scratch(spark, "ledger")
    io.ensure_ledger(spark, f"{base}/live")
    io.append_ledger(lg.where(F.col("status") == "COMPLETED"), f"{base}/live", "PENDING")
    io.append_ledger(lg, f"{base}/live", F.col("status"))
    io.rewrite_ledger(spark, io.read_ledger(spark, f"{base}/live"), f"{base}/versions")
    cur = io.current_ledger(spark, f"{base}/versions")
    return cur.select("txn_id", "amount", "is_fraud", "fraud_type", "status")


# ------------------------------------------------------ remaining operators --
@query("fill_identity", with_views("""
SELECT txn_ref, coalesce(txn_id, concat('TXN_', substring(sha256(concat_ws('|', sender_id, CAST(epoch_us(ts) AS VARCHAR))), 1, 10))) AS txn_id,
 coalesce(receiver_id, concat('Merchant_', CAST(('0x' || substring(sha256(coalesce(merchant_type, '')), 1, 8))::BIGINT % 10000 AS VARCHAR))) AS receiver_id
FROM (SELECT txn_id AS txn_ref, CASE WHEN k % 13 = 0 THEN NULL ELSE CAST(txn_id AS VARCHAR) END AS txn_id, sender_id, ts,
      CASE WHEN k % 17 = 0 THEN NULL ELSE receiver_id END AS receiver_id, merchant_type FROM txn)""", "txn"))
def q_fill_identity(spark, sf):
    """Requests without id or receiver get deterministic generated values."""
    t = _txn(spark, sf)
    k = F.col("k")
    raw = t.select(F.col("txn_id").alias("txn_ref"),
                   F.when(k % 13 == 0, None).otherwise(F.col("txn_id").cast("string")).alias("txn_id"),
                   "sender_id", "ts", F.when(k % 17 == 0, None).otherwise(F.col("receiver_id")).alias("receiver_id"),
                   "merchant_type")
    return clean.fill_identity(raw).select("txn_ref", "txn_id", "receiver_id")


@query("flatten_predictions", with_views("""
SELECT txn_id, amount, CAST(CASE WHEN fraud_probability >= 0.3 THEN 1 ELSE 0 END AS BIGINT) AS is_fraud,
 fraud_probability, fraud_type FROM ledger""", "ledger"))
def q_flatten(spark, sf):
    """Nested prediction records (as stored by the scorer) to flat audit rows."""
    lg = fx.ledger(_txn(spark, sf))
    nested = lg.select("txn_id", "amount", F.struct(
        F.when(F.col("fraud_probability") >= 0.3, 1).otherwise(0).cast("long").alias("is_fraud"),
        F.col("fraud_probability"), F.col("fraud_type")).alias("prediction"))
    return ledger.flatten_predictions(nested)


@query("shuffle_rows", with_views("SELECT txn_id, amount FROM txn", "txn"))
def q_shuffle(spark, sf):
    """Deterministic pseudo-random order of the whole table."""
    return ledger.shuffle_rows(_txn(spark, sf).select("txn_id", "amount"), seed=42)


@query("latency_summary")
def q_latency(spark, sf):
    """Duration per micro-batch of the replayed feature stream, from the log of all batches: mean, p50, p95."""
    from txnrisk.streaming import scoring
    from txnrisk.streaming.progress import ProgressLog
    from txnrisk.streaming.sender_state import sender_state_features
    t = _txn(spark, sf).drop("user_id", "k")
    src, out = scoring.scratch(spark, "lat-src"), scoring.scratch(spark, "lat-out")
    files = scoring.replay_source(t, src, n_files=6)
    scoring.seal_source(t, src)
    stream = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", files).parquet(src)
    with ProgressLog(spark, scoring.scratch(spark, "lat-log")) as log:
        log.wait_for(scoring.stream_to_parquet(sender_state_features(stream), out, scoring.scratch(spark, "lat-ckpt")))
    timings = log.rows()
    whole = timings.agg((F.sum("n_rows") - 1).alias("rows"),  # without the closing marker
                        ((F.sum("n_rows") - 1) / (F.sum("ms") / 1000.0)).alias("rows_per_sec"))
    return clean.attach_one_row(reports.latency_summary(timings), whole)


@query("injected_model_quality")
def q_model_quality(spark, sf):
    """Nine-pattern injection, point-in-time features (no look-ahead),
    time-ordered hold-out (last 20% of time), forest on the rest: AUC, and
    precision/recall at the best-F1 threshold."""
    from txnrisk.operators import ml
    t = inject.inject_nine_patterns(_txn(spark, sf), ratio=0.03, seed=11).drop("pattern")
    f = _computed(features.build_features(t, keep=["txn_id", "is_fraud", "ts"], point_in_time=True), "features")
    cut = f.select(F.percentile_approx(F.unix_micros("ts"), 0.8).alias("_cut"))
    f = clean.attach_one_row(f, cut).withColumn(
        "split", F.when(F.unix_micros("ts") > F.col("_cut"), "test").otherwise("train")).drop("_cut")
    model = ml.fit(ml.random_forest_pipeline(), f.where(F.col("split") == "train"))
    scored = ml.score(model, f.where(F.col("split") == "test"))
    sweep = evaluate.threshold_sweep(scored)
    best = evaluate.best_threshold(sweep)
    at_best = sweep.join(best, sweep["threshold"] == best["best_threshold"]).select("precision", "recall")
    return clean.attach_one_row(clean.attach_one_row(evaluate.roc_auc(scored), best), at_best)
