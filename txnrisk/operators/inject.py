"""Plant labelled fraud patterns in an existing transaction table.

Rows are chosen by a per-row hash below ``ratio`` and assigned to a pattern
by the same hash, so the choice is deterministic, needs no global ranking
and runs as a narrow map over the table (no shuffle).  Pattern parameters
live in small literal arrays indexed by pattern number (no join).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.operators.locations import nearest_city
from txnrisk.schema import CITIES

# Leading hex digits of a digest that make a draw: 52 bits, exact in a double.
DRAW_DIGITS = 13


def unit_hash(key: Column, seed: int) -> Column:
    """Deterministic value in [0, 1) per key and seed, independent between
    seeds: the leading 52 bits of SHA-256 over ``key|seed``.  Keys of any type
    and sign; reproducible in any SQL engine.  Null keys give null."""
    digest = F.sha2(F.concat(key.cast("string"), F.lit(f"|{seed}")), 256)
    return F.conv(F.substring(digest, 1, DRAW_DIGITS), 16, 10).cast("long") / F.lit(float(16 ** DRAW_DIGITS))


def _uniform(u: Column, lo: Column | float, hi: Column | float) -> Column:
    return F.lit(lo) + (F.lit(hi) - F.lit(lo)) * u if not isinstance(lo, Column) else lo + (hi - lo) * u


def inject_simple(df: DataFrame, ratio: float = 0.2, seed: int = 0, key: str = "txn_id") -> DataFrame:
    """High amount (5000-10000), location ``0.0, 0.0``, device ``DEV_Unknown``,
    merchant ``Unknown``, label 1 for a ``ratio`` share of rows."""
    u = unit_hash(F.col(key), seed)
    u2 = unit_hash(F.col(key), seed + 1000)
    hit = u < ratio
    return (df.withColumn("is_fraud", F.when(hit, 1).otherwise(F.col("is_fraud")))
            .withColumn("amount", F.when(hit, 5000 + 5000 * u2).otherwise(F.col("amount")))
            .withColumn("location", F.when(hit, F.lit("0.0, 0.0")).otherwise(F.col("location")))
            .withColumn("device_id", F.when(hit, F.lit("DEV_Unknown")).otherwise(F.col("device_id")))
            .withColumn("merchant_type", F.when(hit, F.lit("Unknown")).otherwise(F.col("merchant_type"))))


# The nine labelled patterns.  Fields: name, amount low, amount
# high, payment type, merchant type (None = keep), device prefix (None =
# keep), receiver prefix (None = keep), location (None = keep).
NINE_PATTERNS = [
    ("Phishing Link", 4000.0, 8000.0, "UPI", "Unknown", None, "Suspicious_", None),
    ("QR Code Scam", 1000.0, 3000.0, "UPI", "Unknown", None, None, None),
    ("SIM Swap", 2500.0, 5000.0, "UPI", None, "New_Device_", None, "-34.6037, -58.3816"),
    ("Fake UPI App", 2000.0, 4000.0, "UPI", "Unknown", "Unknown_Device_", None, None),
    ("Small Testing", 1.0, 10.0, "UPI", "Unknown", None, None, None),
    ("Card Skimming", 5000.0, 10000.0, "Card", "Retail_Physical", "Unknown_Device_", None, None),
    ("Data Breach Reuse", 3000.0, 6000.0, "Card", "Online_Retail", "Unknown_Device_", None, None),
    ("Unusual Location", 4000.0, 8000.0, "Card", None, None, None, "35.6762, 139.6503"),
    ("CNP Fraud", 7000.0, 12000.0, "Card", "Online_Retail", "Unknown_Device_", None, None),
]

_PATTERN_TYPE = T.StructType([
    T.StructField("name", T.StringType()), T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()), T.StructField("txn_type", T.StringType()),
    T.StructField("merchant", T.StringType()), T.StructField("device", T.StringType()),
    T.StructField("receiver", T.StringType()), T.StructField("location", T.StringType())])


def _pattern_array(rows) -> Column:
    return F.array(*[F.struct(*[F.lit(v).cast(f.dataType).alias(f.name)
                                for v, f in zip(r, _PATTERN_TYPE.fields)]) for r in rows])


def _keep_or(new: Column, old: str) -> Column:
    return F.coalesce(new, F.col(old))


def inject_nine_patterns(df: DataFrame, ratio: float = 0.03, seed: int = 0, key: str = "txn_id", exact: bool = False) -> DataFrame:
    """Label a ``ratio`` share of rows as one of nine fraud patterns (equal
    shares in expectation) and rewrite their columns to the pattern.

    With ``exact`` just round(ratio * n) rows, those of the least draws, in
    nine shares as equal as can be (the first ones take the rest)."""
    u = unit_hash(F.col(key), seed)
    u2 = unit_hash(F.col(key), seed + 1000)
    if exact:
        from txnrisk.operators import ranks
        chosen = ranks.least_draws(df.select(key), ratio, seed, key).where("chosen")
        shares = ranks.equal_shares(ranks.draw_ranks(chosen, seed, key), "draw_rank", 9, "_share")
        df = df.join(shares.select(key, "_share"), key, "left")
        hit, idx = F.col("_share").isNotNull(), F.col("_share")
    else:
        hit = u < ratio
        idx = F.least(F.floor(u / F.lit(ratio) * 9).cast("int"), F.lit(8))
    p = F.when(hit, F.element_at(_pattern_array(NINE_PATTERNS), idx + 1))
    tag = F.col(key).cast("string")
    out = (df.withColumn("_p", p)
           .withColumn("is_fraud", F.when(hit, 1).otherwise(F.col("is_fraud")))
           .withColumn("pattern", F.col("_p.name"))
           .withColumn("amount", F.when(hit, _uniform(u2, F.col("_p.lo"), F.col("_p.hi"))).otherwise(F.col("amount")))
           .withColumn("txn_type", _keep_or(F.col("_p.txn_type"), "txn_type"))
           .withColumn("merchant_type", _keep_or(F.col("_p.merchant"), "merchant_type"))
           .withColumn("device_id", _keep_or(F.concat(F.col("_p.device"), tag), "device_id"))
           .withColumn("receiver_id", _keep_or(F.concat(F.col("_p.receiver"), tag), "receiver_id"))
           .withColumn("location", _keep_or(F.col("_p.location"), "location")))
    return out.drop("_p", "_share")


# The seven anomaly patterns.  Fields: name, amount low, amount
# high (integers), receiver kind, location anomaly, device anomaly.
ANOMALY_PATTERNS = [
    ("QR_Code_Scam", 100, 5000, "suspicious", True, False),
    ("Small_Testing", 1, 100, "test", False, False),
    ("SIM_Swap", 500, 50000, "merchant", True, True),
    ("Data_Breach", 1000, 100000, "merchant", True, True),
    ("Phishing_Scam", 500, 25000, "suspicious", True, False),
    ("Card_Testing", 1, 50, "test", False, False),
    ("Unusual_Location", 100, 50000, "merchant", True, False),
]
# Receiver kinds: prefix and id range.
RECEIVER_KINDS = {"suspicious": ("Suspicious_", 1, 100), "test": ("Test_Merchant_", 1, 50),
                  "merchant": ("Merchant_", 100, 999)}
UNKNOWN_DEVICE_RANGE = (1, 100)


def _randint(u: Column, lo: Column, hi: Column) -> Column:
    return (lo + F.floor(u * (hi - lo + 1))).cast("long")


def inject_anomaly_patterns(df: DataFrame, ratio: float = 0.08, seed: int = 0, key: str = "txn_id") -> DataFrame:
    """Label a ``ratio`` share of rows with one of seven anomaly patterns:
    integer amount in the pattern range, receiver by kind and payment type,
    a different base city when the pattern moves location, an unknown
    device when it changes device, merchant ``Unknown``."""
    u = unit_hash(F.col(key), seed)
    us = [unit_hash(F.col(key), seed + 1000 * (i + 1)) for i in range(4)]
    hit = u < ratio
    n = len(ANOMALY_PATTERNS)
    idx = F.least(F.floor(u / F.lit(ratio) * n).cast("int"), F.lit(n - 1))
    arr = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(lo).cast("long").alias("lo"),
                             F.lit(hi).cast("long").alias("hi"),
                             F.lit(RECEIVER_KINDS[kind][0]).alias("rp"),
                             F.lit(RECEIVER_KINDS[kind][1]).cast("long").alias("rlo"),
                             F.lit(RECEIVER_KINDS[kind][2]).cast("long").alias("rhi"),
                             F.lit(loc).alias("loc"), F.lit(dev).alias("dev"))
                    for name, lo, hi, kind, loc, dev in ANOMALY_PATTERNS])
    city_text = F.array(*[F.lit(f"{lat:.4f}, {lon:.4f}") for _, lat, lon in CITIES])
    based = nearest_city(df, keep_all=True)
    # A different city: shift the base city's position by 1..7.
    other = F.pmod(F.col("_city_pos") + 1 + F.floor(us[2] * (len(CITIES) - 1)).cast("int"), F.lit(len(CITIES)))
    p = F.element_at(arr, idx + 1)
    dlo, dhi = UNKNOWN_DEVICE_RANGE
    out = (based.withColumn("_p", F.when(hit, p))
           .withColumn("is_fraud", F.when(hit, 1).otherwise(F.col("is_fraud")))
           .withColumn("fraud_type", F.when(hit, F.replace(F.col("_p.name"), F.lit("_"), F.lit(" "))))
           .withColumn("amount", F.when(hit, _randint(us[0], F.col("_p.lo"), F.col("_p.hi")).cast("double"))
                       .otherwise(F.col("amount")))
           .withColumn("receiver_id", F.when(hit, F.concat(
               F.col("_p.rp"), _randint(us[1], F.col("_p.rlo"), F.col("_p.rhi")).cast("string"),
               F.lit("@"), F.lower(F.col("txn_type")))).otherwise(F.col("receiver_id")))
           .withColumn("location", F.when(hit & F.col("_p.loc"), F.element_at(city_text, other + 1))
                       .otherwise(F.col("location")))
           .withColumn("device_id", F.when(hit & F.col("_p.dev"), F.concat(
               F.lit("Unknown_Device_"), _randint(us[3], F.lit(dlo).cast("long"), F.lit(dhi).cast("long")).cast("string")))
               .otherwise(F.col("device_id")))
           .withColumn("merchant_type", F.when(hit, F.lit("Unknown")).otherwise(F.col("merchant_type"))))
    return out.drop("_p", "_city_pos", "city", "distance_km")
