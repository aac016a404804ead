"""Hand-made edge rows (FIXTURES.md §5)."""

import datetime as dt
import math

import pytest

from txnrisk.operators.features import build_features

T0 = dt.datetime(2024, 1, 7, 5, 0, 0)  # a Sunday, 05:00


@pytest.fixture(scope="module")
def feats(spark):
    rows = [
        # sender A: first row, then same-time row in another city, then malformed location
        (1, T0, "A", 100.0, "D1", "12.9716, 77.5946", "Merchant_1", "UPI", "Food", 0),
        (2, T0, "A", 100.01, "D1", "28.6139, 77.2090", "Suspicious_1", "Card", "Unknown", 1),
        (3, T0 + dt.timedelta(hours=1), "A", 49999.99, "D2", "n/a", "Test_9", "Netbanking", "ATM", 0),
        (4, T0 + dt.timedelta(hours=25), "A", 50000.0, "D2", "1,2,3", "Merchant_1", "UPI", "Travel", 0),
        # sender B: one row, amount 0 (mean 0)
        (5, T0 + dt.timedelta(days=1, hours=1), "B", 0.0, None, None, "R", "UPI", "Food", 0),
        # sender C: antipodal move
        (6, T0, "C", 10.0, "D", "-34.6037, -58.3816", "R", "UPI", "Food", 0),
        (7, T0 + dt.timedelta(hours=2), "C", 10.0, "D", "34.6037, 121.6184", "R", "UPI", "Food", 0),
    ]
    df = spark.createDataFrame(rows, "txn_id long, ts timestamp, sender_id string, amount double, device_id string, "
                                     "location string, receiver_id string, txn_type string, merchant_type string, "
                                     "is_fraud int")
    return {r["txn_id"]: r for r in build_features(df).collect()}


def test_first_row_defaults(feats):
    r = feats[1]
    assert r["Time_Since_Last_Txn"] == 10000.0 and r["Time_Diff_Hours"] == 24.0
    assert r["Is_New_Device"] == 1 and r["Location_Distance_Km"] == 10000.0
    assert r["Location_Speed_Kmh"] == pytest.approx(10000.0 / 24) and r["Is_Unusual_Location"] == 0
    assert r["Txn_Count_Last_24H"] == 1 and r["Txn_Count_Last_1H"] == 0
    assert r["Amount_Rolling_Std_10"] == 0.0 and r["Is_First_Time_Receiver"] == 1


def test_zero_gap_city_change(feats):
    r = feats[2]
    assert r["Time_Diff_Hours"] == 0.0 and r["Is_New_Device"] == 0
    assert r["Location_Distance_Km"] > 1000
    assert r["Location_Speed_Kmh"] == pytest.approx(r["Location_Distance_Km"] / 0.01)
    assert r["Is_Unusual_Location"] == 1 and r["Is_High_Speed"] == 1
    assert r["Is_Suspicious_Receiver"] == 1 and r["Transaction_Type_Card"] == 1 and r["Merchant_Type_Unknown"] == 1


def test_malformed_location_and_vocabulary(feats):
    assert feats[3]["Location_Distance_Km"] == 10000.0 and feats[4]["Location_Distance_Km"] == 10000.0
    r = feats[3]
    assert r["Is_Test_Receiver"] == 1 and r["Transaction_Type_Netbanking"] == 1
    assert sum(r[c] for c in r.asDict() if c.startswith("Merchant_Type_")) == 0  # ATM not in vocabulary
    assert r["Time_Diff_Hours"] == 1.0 and r["Txn_Count_Last_1H"] == 2


def test_amount_edges(feats):
    assert feats[1]["Is_Small_Amount"] == 1 and feats[2]["Is_Small_Amount"] == 0
    assert feats[3]["Is_Large_Amount"] == 0 and feats[4]["Is_Large_Amount"] == 1
    assert feats[5]["Amount_Ratio"] == 0.0 and feats[5]["Amount_Deviation"] == 0.0


def test_time_edges(feats):
    r = feats[1]
    assert r["Hour"] == 5 and r["Is_Night"] == 1 and r["Day_of_Week"] == 6 and r["Is_Weekend"] == 1
    assert feats[3]["Hour"] == 6 and feats[3]["Is_Night"] == 0
    assert feats[5]["Day_of_Week"] == 0 and feats[5]["Is_Weekend"] == 0
    assert r["Hour_Sin"] == pytest.approx(math.sin(2 * math.pi * 5 / 24))


def test_antipodal_distance(feats):
    assert feats[7]["Location_Distance_Km"] == pytest.approx(20015.0868, rel=1e-6)
