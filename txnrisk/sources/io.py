"""Readers and writers: transaction tables, the ledger, predictions, streams.

Tables are read with explicit schemas (no inference).  The ledger is a
Parquet table that is never edited in place: appends add files, rewrites
publish a new version by a numbered commit (``sources.commits``), so a failed
rewrite leaves the previous version the current one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.operators.clean import cast_label, parse_timestamp
from txnrisk.operators.ledger import LEDGER_COLUMNS, ledger_record
from txnrisk.schema import LEDGER_SCHEMA, TRANSACTION_SCHEMA
from txnrisk.sources.commits import Versions

# Header names of the reference's CSV files, in column order.
CSV_HEADER = {"txn_id": "Transaction_ID", "ts": "Timestamp", "amount": "Amount", "sender_id": "Sender_ID",
              "receiver_id": "Receiver_ID", "txn_type": "Transaction_Type", "merchant_type": "Merchant_Type",
              "device_id": "Device_ID", "location": "Location", "is_fraud": "Is_Fraud",
              "fraud_type": "Fraud_Type", "fraud_probability": "Fraud_Probability", "status": "Status"}


#: Column of a malformed line's text.
BAD_LINE = "_bad_line"


def _csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """Headed CSV as text columns by header name; ``BAD_LINE`` holds a line with too few or too many fields.

    The header gives the names, whatever their order; a file of the folder whose header differs from the first
    one's is an error, not a misread table."""
    def reader(**how):
        return spark.read.options(header=True, **how)

    names = reader().csv(path).columns  # reads a header line
    text = T.StructType([*[T.StructField(c, T.StringType()) for c in names], T.StructField(BAD_LINE, T.StringType())])
    return reader(enforceSchema=False, mode="PERMISSIVE", columnNameOfCorruptRecord=BAD_LINE, columnPruning=False).schema(text).csv(path)


def _canonical(raw: DataFrame) -> DataFrame:
    """Transaction columns by header name (absent ones null), leniently parsed."""
    there = {c.strip().lower(): c for c in raw.columns}

    def field(name: str):
        found = there.get(CSV_HEADER[name].lower())
        return F.lit(None).cast("string") if found is None else F.col(f"`{found}`")

    return raw.select(
        field("txn_id").alias("txn_id"), parse_timestamp(field("ts")).alias("ts"), field("amount").try_cast("double").alias("amount"),
        *[field(c).alias(c) for c in ("sender_id", "receiver_id", "txn_type", "merchant_type", "device_id", "location")],
        cast_label(field("is_fraud")).alias("is_fraud"))


def read_transactions(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Headed CSV (reference header names, in any order) or Parquet -> canonical columns.

    CSV fields are read as text and parsed leniently: timestamps in ISO or
    space-separated form, labels from ``1/true/True``, bad numbers -> null.
    Malformed lines are left to ``quarantined_lines``.
    """
    if fmt == "parquet":
        return spark.read.parquet(path)
    raw = _csv_lines(spark, path)
    return _canonical(raw.where(F.col(BAD_LINE).isNull()).drop(BAD_LINE))


def quarantined_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line) of the lines that ``read_transactions`` leaves out: too few or too many fields."""
    raw = _csv_lines(spark, path).withColumn("file", F.input_file_name())
    # Spark wants a parsed column read beside the corrupt one: the second condition always holds.
    first = F.coalesce(F.col(f"`{raw.columns[0]}`"), F.lit(""))
    return raw.where(F.col(BAD_LINE).isNotNull() & (first >= "")).select("file", F.col(BAD_LINE).alias("line"))


def write_transactions(df: DataFrame, path: str, fmt: str = "csv", mode: str = "overwrite") -> None:
    """Write with the reference's header names (CSV) or as Parquet."""
    if fmt == "parquet":
        df.write.mode(mode).parquet(path)
        return
    out = df.select(*[F.col(c).alias(CSV_HEADER.get(c, c)) for c in df.columns])
    out.write.mode(mode).option("header", True).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").csv(path)


def write_predictions(pred: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; timestamps as ISO text, other non-JSON types as strings."""
    cols = []
    for f in pred.schema.fields:
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            cols.append(F.date_format(F.col(f.name), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias(f.name))
        elif isinstance(f.dataType, (T.BinaryType, T.DecimalType)):
            cols.append(F.col(f.name).cast("string").alias(f.name))
        else:
            cols.append(F.col(f.name))
    pred.select(*cols).write.mode(mode).json(path)


def ensure_ledger(spark: SparkSession, path: str) -> None:
    """Create an empty ledger table when nothing is at ``path``.

    Existence is asked of the file system: a ledger that is there but cannot
    be read just now is left alone, and nothing is ever overwritten.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        spark.createDataFrame([], LEDGER_SCHEMA).write.mode("errorifexists").parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Rows without an id are skipped; text nulls become empty strings."""
    df = spark.read.schema(LEDGER_SCHEMA).parquet(path)
    text = [f.name for f in LEDGER_SCHEMA.fields if isinstance(f.dataType, T.StringType)]
    return df.where(F.length(F.col("txn_id")) > 0).na.fill("", subset=text)


def append_ledger(scored: DataFrame, path: str, status) -> None:
    """Append scored transactions as ledger rows with the given status."""
    ledger_record(scored, status).select(*LEDGER_COLUMNS).write.mode("append").parquet(path)


def rewrite_ledger(spark: SparkSession, df: DataFrame, base: str) -> int:
    """Publish ``df`` as the current version of the ledger under ``base``; returns its number.

    A version counts from its commit on, so a failed rewrite leaves the one before."""
    return Versions(spark, base).publish(lambda path: df.write.parquet(path))


def current_ledger(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(Versions(spark, base).path())


def read_transaction_stream(spark: SparkSession, path: str, schema: T.StructType = TRANSACTION_SCHEMA,
                            fmt: str = "json", max_files_per_trigger: int | None = None) -> DataFrame:
    """One JSON (or Parquet) transaction per line, arriving as files."""
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.json(path) if fmt == "json" else r.parquet(path)
