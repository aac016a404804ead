"""Schemas, vocabularies and the fixed values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Canonical column names (snake case inside the library).
# ---------------------------------------------------------------------------
TXN_ID, TS, AMOUNT = "txn_id", "ts", "amount"
SENDER, RECEIVER, DEVICE = "sender_id", "receiver_id", "device_id"
LOCATION, TXN_TYPE, MERCHANT, LABEL = "location", "txn_type", "merchant_type", "is_fraud"

TRANSACTION_SCHEMA = T.StructType([
    T.StructField(TXN_ID, T.StringType()),
    T.StructField(TS, T.TimestampType()),
    T.StructField(AMOUNT, T.DoubleType()),
    T.StructField(SENDER, T.StringType()),
    T.StructField(RECEIVER, T.StringType()),
    T.StructField(TXN_TYPE, T.StringType()),
    T.StructField(MERCHANT, T.StringType()),
    T.StructField(DEVICE, T.StringType()),
    T.StructField(LOCATION, T.StringType()),
    T.StructField(LABEL, T.IntegerType()),
])

LEDGER_SCHEMA = T.StructType(list(TRANSACTION_SCHEMA.fields) + [
    T.StructField("fraud_type", T.StringType()),
    T.StructField("fraud_probability", T.DoubleType()),
    T.StructField("status", T.StringType()),
])

FEEDBACK_SCHEMA = T.StructType([
    T.StructField(TXN_ID, T.StringType()),
    T.StructField(LABEL, T.BooleanType()),
    T.StructField("feedback_ts", T.TimestampType()),
    T.StructField("source", T.StringType()),
])

# ---------------------------------------------------------------------------
# Fixed values (must equal the reference's for equal results).
# ---------------------------------------------------------------------------

# Defaults for absent/null raw columns.
COLUMN_DEFAULTS = {
    AMOUNT: 0.0,
    SENDER: "Unknown",
    RECEIVER: "Unknown",
    DEVICE: "Unknown",
    LOCATION: "0.0, 0.0",
    TXN_TYPE: "Unknown",
    MERCHANT: "Unknown",
    LABEL: 0,
}

# One-hot vocabularies, in model order.
TXN_TYPES = ["Card", "UPI", "Netbanking"]
MERCHANT_TYPES = ["Online_Retail", "Food", "Travel", "Entertainment", "Utilities", "Unknown"]

# The 44 model features, in model order.
FEATURES = [
    "Amount", "Amount_Log",
    "Transaction_Type_Card", "Transaction_Type_UPI", "Transaction_Type_Netbanking",
    "Merchant_Type_Online_Retail", "Merchant_Type_Food", "Merchant_Type_Travel",
    "Merchant_Type_Entertainment", "Merchant_Type_Utilities", "Merchant_Type_Unknown",
    "Hour", "Day_of_Week", "Is_Weekend", "Is_Night",
    "Hour_Sin", "Hour_Cos", "Day_Sin", "Day_Cos",
    "Time_Since_Last_Txn", "Txn_Count_Total",
    "Txn_Count_Last_1H", "Txn_Count_Last_6H", "Txn_Count_Last_24H",
    "Time_Diff_Hours", "Rapid_Txn_Count_Last_1H",
    "Amount_Deviation", "Amount_Ratio", "Is_Small_Amount", "Is_Large_Amount",
    "Amount_Rolling_Mean_10", "Amount_Rolling_Std_10",
    "Is_New_Device", "Device_Count", "Is_Unknown_Device",
    "Location_Distance_Km", "Is_Unusual_Location", "Location_Speed_Kmh", "Is_High_Speed",
    "Is_Suspicious_Receiver", "Is_Test_Receiver", "Is_First_Time_Receiver",
    "Receiver_Diversity", "Receiver_Frequency",
]

# Feature constants.
FIRST_GAP_MINUTES = 10000.0       # Time_Since_Last_Txn of a sender's first row
FIRST_GAP_HOURS = 24.0            # Time_Diff_Hours of a sender's first row
GAP_COUNT_HOURS = (1, 6, 24)      # Txn_Count_Last_{h}H thresholds
RAPID_GAP_HOURS = 0.1             # gap counted as rapid
ROLLING_ROWS = 10                 # rolling frames: current row and 9 before
SMALL_AMOUNT, LARGE_AMOUNT = 100.0, 50000.0
EARTH_RADIUS_KM = 6371.0
MISSING_DISTANCE_KM = 10000.0
UNUSUAL_DISTANCE_KM, UNUSUAL_GAP_HOURS = 500.0, 24.0
ZERO_GAP_HOURS = 0.01             # divisor used when the gap is 0
HIGH_SPEED_KMH = 1000.0
ZERO_MEAN_DIVISOR = 0.01
VELOCITY_WINDOW_SECONDS = 600     # 10-minute count used by the rules

# Decision thresholds.
THRESHOLD_DEFAULT, THRESHOLD_GATEWAY, THRESHOLD_EVAL = 0.3, 0.05, 0.5

# Base cities: name, latitude, longitude.
CITIES = [
    ("Delhi", 28.6139, 77.2090),
    ("Mumbai", 19.0760, 72.8777),
    ("Bangalore", 12.9716, 77.5946),
    ("Chennai", 13.0827, 80.2707),
    ("Kolkata", 22.5726, 88.3639),
    ("Hyderabad", 17.3850, 78.4867),
    ("Pune", 18.5204, 73.8567),
    ("Ahmedabad", 23.0225, 72.5714),
]

# Fraud-type rule weights: type -> ordered (signal, weight) pairs.  The order
# of types is the tie-break order and the order of terms is the order of
# addition (floating sums must add in this order).
FRAUD_WEIGHTS = [
    ("Phishing Link", [("amount", 0.3), ("merchant", 0.2), ("receiver", 0.3), ("txn_type", 0.2)]),
    ("QR Code Scam", [("amount", 0.3), ("merchant", 0.4), ("txn_type", 0.3)]),
    ("SIM Swap", [("device", 0.4), ("location", 0.3), ("txn_type", 0.3)]),
    ("Fake UPI App", [("device", 0.4), ("merchant", 0.3), ("txn_type", 0.3)]),
    ("Small Testing", [("amount", 0.4), ("count10", 0.4), ("txn_type", 0.2)]),
    ("Card Skimming", [("amount", 0.4), ("merchant", 0.3), ("device", 0.3)]),
    ("Data Breach Reuse", [("amount", 0.3), ("merchant", 0.3), ("device", 0.4)]),
    ("Unusual Location", [("location", 0.5), ("amount", 0.3), ("txn_type", 0.2)]),
    ("CNP Fraud", [("amount", 0.4), ("merchant", 0.3), ("device", 0.3)]),
]
# Applicable types per payment type, in tie-break order.
FRAUD_TYPES_BY_PAYMENT = {
    "UPI": ["Phishing Link", "QR Code Scam", "SIM Swap", "Fake UPI App", "Small Testing",
            "Unusual Location"],
    "Card": ["Card Skimming", "Data Breach Reuse", "CNP Fraud", "Unusual Location",
             "Small Testing"],
}
# Any other payment type: the UPI list followed by the Card-only types.
FRAUD_TYPES_OTHER = ["Phishing Link", "QR Code Scam", "SIM Swap", "Fake UPI App",
                     "Small Testing", "Unusual Location", "Card Skimming",
                     "Data Breach Reuse", "CNP Fraud"]
RULE_HIGH_AMOUNT, RULE_LOW_AMOUNT, RULE_LOW_FACTOR = 5000.0, 10.0, 0.8
RULE_TXN_TYPE_FACTOR = 0.5
RULE_COUNT10_LIMIT = 5

# Fraud-type code -> sentence (client display table); unknown codes show as is.
FRAUD_TYPE_DESCRIPTIONS = [
    ("Phishing Link", "Detected phishing attempt with suspicious link"),
    ("QR Code Scam", "Suspicious QR code used for payment"),
    ("SIM Swap", "Transaction detected from unusual location/device"),
    ("Fake UPI App", "Potential fraudulent app installation detected"),
    ("Small Testing", "Multiple small transactions detected"),
    ("Unusual Location", "Transaction from unexpected location"),
    ("Card Skimming", "Card data may be compromised"),
    ("Data Breach Reuse", "Card information linked to known data breach"),
    ("CNP Fraud", "Card-not-present fraud detected"),
    ("Suspicious Card Transaction", "Unusual card transaction pattern"),
    ("Suspicious UPI Transaction", "Unusual UPI transaction pattern"),
]

# Ledger / feedback constants.
ADMIN_FLAGGED = "Admin Flagged"
NO_FRAUD_TYPE = "-"
FEEDBACK_DEFAULT_PROBABILITY = 0.5
RETRAIN_MIN_SAMPLES, RETRAIN_INTERVAL_HOURS = 50, 24
