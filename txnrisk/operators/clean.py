"""Cleaning and projection operators (ensure, fill, parse, cast, drop)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.schema import COLUMN_DEFAULTS, FEATURES, LABEL, TS


def ensure_columns(df: DataFrame, defaults: dict | None = None,
                   now: Column | None = None) -> DataFrame:
    """Add absent columns with their defaults (timestamp: ``now``)."""
    defaults = dict(COLUMN_DEFAULTS if defaults is None else defaults)
    out = df
    for name, value in defaults.items():
        if name not in out.columns:
            out = out.withColumn(name, F.lit(value))
    if TS not in out.columns:
        out = out.withColumn(TS, now if now is not None else F.current_timestamp())
    return out


def fill_missing(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Null -> default per column (the timestamp is left as is)."""
    defaults = dict(COLUMN_DEFAULTS if defaults is None else defaults)
    defaults.pop(LABEL, None)
    present = {k: v for k, v in defaults.items() if k in df.columns}
    return df.na.fill(present)


def parse_timestamp(c: Column) -> Column:
    """ISO text (``T`` or space separated, optional fraction and zone) -> timestamp."""
    return F.coalesce(F.try_to_timestamp(c), F.try_to_timestamp(c, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSSXXX")))


def cast_label(c: Column) -> Column:
    """Truthy text or number -> 1, else 0 (``1``, ``true``, ``True``)."""
    return F.when(F.lower(F.trim(c.cast("string"))).isin("1", "true", "1.0"), 1).otherwise(0)


def label_to_status(label: Column) -> Column:
    return F.when(label == 1, "Fraud").when(label == 0, "Success")


def sanitize_numeric(c: Column) -> Column:
    """NaN and +/-inf -> 0."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(0.0)).otherwise(c)


def select_features(df: DataFrame, names: list[str] | None = None,
                    keep: list[str] | None = None) -> DataFrame:
    """Fix the model column order; absent features become 0."""
    names = names or FEATURES
    cols = [F.col(c) if c in df.columns else F.lit(0).alias(c) for c in names]
    return df.select(*(keep or []), *cols)


def clean_ids(df: DataFrame, numeric: list[str], categorical: list[str]) -> DataFrame:
    """Alternative featurizer cleaning: numeric null -> 0, categorical -> 'Unknown'."""
    fills = {c: 0 for c in numeric if c in df.columns}
    fills.update({c: "Unknown" for c in categorical if c in df.columns})
    return df.na.fill(fills)


def attach_one_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Append the columns of a one-row table (an aggregate) to every row.

    A broadcast equi-join on a constant key: the broadcast side is a single
    row by construction, so its size is fixed.
    """
    return (df.withColumn("_one", F.lit(1))
            .join(F.broadcast(one_row.withColumn("_one", F.lit(1))), "_one").drop("_one"))


# Generated id prefix/length and the receiver default for requests.
GENERATED_ID_PREFIX, GENERATED_ID_HEX = "TXN_", 10
DEFAULT_RECEIVER_PREFIX, DEFAULT_RECEIVER_MOD = "Merchant_", 10000


def fill_identity(df: DataFrame, id_col: str = "txn_id", receiver: str = "receiver_id",
                  merchant: str = "merchant_type", parts: tuple[str, ...] = ("sender_id", "ts")) -> DataFrame:
    """Fill a missing id with ``TXN_`` + 10 hex digits of a content hash and a
    missing receiver with ``Merchant_<hash(merchant type) mod 10000>``
    (deterministic across runs and engines)."""
    def text(c):
        t = dict(df.dtypes)[c]
        return F.unix_micros(F.col(c).cast("timestamp")).cast("string") if t.startswith("timestamp") \
            else F.col(c).cast("string")
    digest = F.sha2(F.concat_ws("|", *[text(c) for c in parts]), 256)
    gen_id = F.concat(F.lit(GENERATED_ID_PREFIX), F.substring(digest, 1, GENERATED_ID_HEX))
    m_hash = F.conv(F.substring(F.sha2(F.coalesce(F.col(merchant), F.lit("")), 256), 1, 8), 16, 10).cast("long")
    gen_receiver = F.concat(F.lit(DEFAULT_RECEIVER_PREFIX), (m_hash % DEFAULT_RECEIVER_MOD).cast("string"))
    return (df.withColumn(id_col, F.coalesce(F.col(id_col).cast("string"), gen_id))
            .withColumn(receiver, F.coalesce(F.col(receiver), gen_receiver)))
