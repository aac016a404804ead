"""Rule scenarios and validation cases of the reference (FIXTURES.md §3-4)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from txnrisk.functions import risk, validate
from txnrisk.operators import rules

# (amount, receiver, type, merchant, device, expected plain, expected unusual)
SCENARIOS = [
    (6500, "Suspicious_001", "UPI", "Unknown", "Device_1", "Phishing Link", "Phishing Link"),
    (2500, "Merchant_123", "UPI", "Unknown", "Device_1", "QR Code Scam", "Unusual Location"),
    (4000, "Merchant_456", "UPI", "Unknown", "New_Device_123", "Fake UPI App", "SIM Swap"),
    (3500, "Merchant_789", "UPI", "Unknown", "Unknown_Device_456", "Fake UPI App", "SIM Swap"),
    (5, "Merchant_101", "UPI", "Unknown", "Device_1", "QR Code Scam", "Unusual Location"),
    (8500, "Merchant_202", "Card", "Retail_Physical", "Unknown_Device_789", "Card Skimming", "Unusual Location"),
    (4500, "Merchant_303", "Card", "Online_Retail", "Unknown_Device_101", "Data Breach Reuse", "Unusual Location"),
    (6000, "Merchant_404", "Card", "Online_Retail", "Device_2", "Small Testing", "Unusual Location"),
    (9500, "Merchant_505", "Card", "Online_Retail", "Unknown_Device_202", "Card Skimming", "Unusual Location"),
    (250, "Merchant_606", "UPI", "Food", "Device_3", "QR Code Scam", "Unusual Location"),
    (1200, "Merchant_707", "Card", "Entertainment", "Device_3", "Unusual Location", "Unusual Location"),
    (500, "merchant456@okaxis.com", "UPI", "Food", "Device_1234", "QR Code Scam", "Unusual Location"),
    (2000, "suspicious999@paytm.com", "UPI", "Unknown", "Device_5678", "QR Code Scam", "Unusual Location"),
    (10, "Test_Merchant_001", "Card", "Unknown", "Device_9999", "Card Skimming", "Unusual Location"),
    (2500, "Merchant_789", "Card", "Online_Retail", "Device_1111", "Unusual Location", "Unusual Location"),
    (15000, "merchant123@paytm.com", "UPI", "Travel", "Unknown_Device_456", "SIM Swap", "Unusual Location"),
    (5000, "Merchant_999", "UPI", "Unknown", "Unknown_Device_123", "Fake UPI App", "SIM Swap"),
    (5, "REC_SUSPICIOUS", "Transfer", "Unknown", "DEV_Unknown", "QR Code Scam", "Unusual Location"),
    (8000, "REC_NORMAL", "Payment", "Online", "DEV_9999", "Small Testing", "Unusual Location"),
]


@pytest.mark.parametrize("unusual", [0, 1])
def test_reference_scenarios(spark, unusual):
    rows = [(i, float(a), r, t, m, d, unusual) for i, (a, r, t, m, d, _, _) in enumerate(SCENARIOS)]
    df = spark.createDataFrame(rows, "txn_id int, amount double, receiver_id string, txn_type string, "
                                     "merchant_type string, device_id string, Is_Unusual_Location int")
    got = {r["txn_id"]: r["fraud_type"] for r in rules.infer_fraud_type(df).collect()}
    for i, sc in enumerate(SCENARIOS):
        assert got[i] == sc[6 if unusual else 5], (i, sc)


def test_phishing_score_value(spark):
    df = spark.createDataFrame([(6500.0, "Suspicious_001", "UPI", "Unknown", "Device_1")],
                               "amount double, receiver_id string, txn_type string, merchant_type string, device_id string")
    r = rules.with_type_scores(df).first()
    assert r["score_phishing_link"] == pytest.approx(0.9)
    assert r["score_qr_code_scam"] == pytest.approx(0.85)


def test_small_testing_needs_count(spark):
    df = spark.createDataFrame([(5.0, "M", "UPI", "Food", "D", 6)],
                               "amount double, receiver_id string, txn_type string, merchant_type string, "
                               "device_id string, Txn_Count_Last_10_Min int")
    assert rules.infer_fraud_type(df).first()["fraud_type"] == "Small Testing"


CARDS = [("4532015112830366", True), ("4111111111111111", True), ("4111111111111112", False),
         ("411111111111", False), ("abcdefghijklmnop", False), ("4111 1111 1111 1111", True), (None, False)]


def test_luhn(spark):
    df = spark.createDataFrame(CARDS, "c string, ok boolean")
    for r in df.select("ok", validate.luhn_valid(F.col("c")).alias("v")).collect():
        assert r["v"] == r["ok"]


def test_cvv_expiry_upi(spark):
    as_of = dt.date(2026, 12, 1)
    cvv = [("123", True), ("1234", True), ("12", False), ("12a", False)]
    exp = [("12/26", True), ("11/26", False), ("13/27", False), ("1/27", False), ("", False)]
    upi = [("user1234@okhdfcbank.com", True), ("suspicious@user.com", True), ("rpr092004@okaxis", False),
           ("user@", False), ("", False)]
    for v, ok in cvv:
        assert spark.range(1).select(validate.cvv_valid(F.lit(v)).alias("x")).first()["x"] == ok, v
    for v, ok in exp:
        assert spark.range(1).select(validate.expiry_valid(F.lit(v), as_of).alias("x")).first()["x"] == ok, v
    for v, ok in upi:
        assert spark.range(1).select(validate.upi_id_valid(F.lit(v)).alias("x")).first()["x"] == ok, v


def test_validation_messages(spark):
    as_of = dt.date(2026, 12, 1)
    rows = [(None, "UPI", None, None, None, "a@b.com", "Missing required fields: Amount"),
            ("abc", "UPI", None, None, None, "a@b.com", "Invalid amount format"),
            ("0", "UPI", None, None, None, "a@b.com", "Amount must be greater than zero"),
            ("-5", "UPI", None, None, None, "a@b.com", "Amount must be greater than zero"),
            ("10", "card", "4111111111111112", "123", "12/27", None, "Invalid card number"),
            ("10", "Card", "4111111111111111", "12", "12/27", None, "Invalid CVV"),
            ("10", "Card", "4111111111111111", "123", "11/26", None, "Invalid expiry date"),
            ("10", "UPI", None, None, None, "rpr092004@okaxis", "Invalid UPI ID format"),
            ("10", "Netbanking", None, None, None, None, None),
            (None, None, None, None, None, None, "Missing required fields: Amount, Transaction_Type")]
    df = spark.createDataFrame(rows, "a string, t string, c string, v string, e string, u string, want string")
    out = df.select("want", validate.validation_message(F.col("a"), F.col("t"), F.col("c"), F.col("v"),
                                                        F.col("e"), F.col("u"), as_of).alias("got")).collect()
    for r in out:
        assert r["got"] == r["want"]


def test_risk_meters(spark):
    as_of = dt.date(2026, 12, 1)
    df = spark.createDataFrame([("4242424242424242", "123", "12/20", 6000.0, "suspicious-user", 6000.0),
                                ("4111111111111111", "456", "12/30", 10.0, "a@b", 10.0),
                                ("4000000000", "", "", 1.0, "", 1.0)],
                               "c string, v string, e string, a double, u string, ua double")
    got = df.select(risk.card_risk_score(F.col("c"), F.col("v"), F.col("e"), F.col("a"), as_of).alias("card"),
                    risk.upi_risk_score(F.col("u"), F.col("ua")).alias("upi")).collect()
    assert [r["card"] for r in got] == [70, 30, 50]
    assert [r["upi"] for r in got] == [100, 0, 0]


def test_mask_card(spark):
    r = spark.range(1).select(validate.mask_card(F.lit("4111111111111111")).alias("m")).first()
    assert r["m"] == "411111******1111"


def test_timestamp_and_label_parsing(spark):
    from txnrisk.operators.clean import cast_label, parse_timestamp
    df = spark.createDataFrame([("2025-08-29 11:00:11", "1"), ("2025-11-23T23:45:00.000Z", "True"),
                                ("2025-11-23T23:45:00", "true"), ("not a time", "0"), (None, "false")],
                               "t string, l string")
    got = df.select(parse_timestamp(F.col("t")).alias("ts"), cast_label(F.col("l")).alias("y")).collect()
    assert [str(r["ts"]) if r["ts"] else None for r in got] == [
        "2025-08-29 11:00:11", "2025-11-23 23:45:00", "2025-11-23 23:45:00", None, None]
    assert [r["y"] for r in got] == [1, 1, 1, 0, 0]
