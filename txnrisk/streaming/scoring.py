"""Structured Streaming jobs: feature+score+decide, and feedback upserts.

Sources are file directories (one JSON or Parquet file per arrival batch);
sinks are Parquet tables written per micro-batch with ``foreachBatch``
(idempotent per epoch: each epoch writes its own directory, so a retried
batch overwrites its own output).  The ledger takes one commit per epoch
(``sources.commits``), so a batch that dies between its write and its commit
leaves no row twice and loses none.  Checkpoints live under the shared
``spark.checkpoint.dir``.
"""

from __future__ import annotations

import datetime as dt
import math
import uuid
from contextlib import contextmanager

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from txnrisk.functions import validate
from txnrisk.operators import features, rules
from txnrisk.operators.ledger import LEDGER_COLUMNS, ledger_record
from txnrisk.schema import FEATURES, LEDGER_SCHEMA, THRESHOLD_DEFAULT
from txnrisk.session import shared_path
from txnrisk.sources.commits import Commits, EpochTable
from txnrisk.sources.delta_ledger import DeltaLedger
from txnrisk.streaming.sender_state import CLOSING_SENDER, STATE_CONF, sender_state_features

#: Rows of a replayed file, about.
FILE_ROWS = 500_000
#: Reason of the rows that arrive behind the watermark.
LATE = "Late: older than the stream's watermark"
#: Reasons of the other rows without features.
REFUSED = {"late": LATE, "duplicate": "Duplicate: its id has been seen", "no time": "No time", "no amount": "No amount"}


def replay_source(df: DataFrame, path: str, n_files: int, ts: str = "ts", arrival: Column | None = None,
                  fmt: str = "parquet", file_rows: int = FILE_ROWS) -> int:
    """Write a table as ``n_files`` slices, oldest first, one append per
    slice, so a file stream (which orders files by modification time) replays
    it in event-time order, or in order of ``arrival`` (microseconds).  Slice
    bounds are approximate quantiles (``n_files - 1`` numbers to the driver).

    The table is computed once, into a staging folder by slice, so a slice's append reads its own rows alone.
    A slice is one file, or several of about ``file_rows`` rows; returns how many."""
    spark, us = df.sparkSession, F.unix_micros(F.col(ts).cast("timestamp")) if arrival is None else arrival
    probs = [i / n_files for i in range(1, n_files)]
    cuts = [int(c) for c in df.select(us.alias("_u")).approxQuantile("_u", probs, 0.001)] if n_files > 1 else []
    place = sum(((us > c).cast("int") for c in cuts), F.lit(0))
    rows = df.where(us.isNotNull()) if cuts else df
    staged = Commits(spark, scratch(spark, "replay"))
    rows.withColumn("_slice", place).write.partitionBy("_slice").parquet(staged.full("rows"))
    there = [staged.full(f"rows/_slice={i}") for i in range(n_files)]
    parts = [spark.read.schema(df.schema).parquet(p) if staged.exists(p) else spark.createDataFrame([], df.schema) for p in there]
    files = max(1, math.ceil(max(part.count() for part in parts) / file_rows))
    for part in parts:
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").format(fmt).save(path)
    staged.remove()
    return files


def seal_source(df: DataFrame, path: str, ts: str = "ts", key: str = "sender_id", after: str = "2 days",
                fmt: str = "parquet") -> None:
    """End a finite replay: one marker row, ``after`` the latest time of ``df``, moves the watermark past every row.
    It comes out of no query."""
    late = df.agg((F.max(F.col(ts).cast("timestamp")) + F.expr(f"INTERVAL {after}")).cast(df.schema[ts].dataType).alias(ts))
    rest = [F.lit(CLOSING_SENDER).alias(key) if f.name == key else F.col(ts) if f.name == ts
            else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema.fields]
    late.select(*rest).coalesce(1).write.mode("append").format(fmt).save(path)


@contextmanager
def state_conf(spark: SparkSession):
    """The state store settings, for queries started inside."""
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _drained(stream: DataFrame, sink, checkpoint: str):
    with state_conf(stream.sparkSession):
        q = (stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def stream_to_parquet(stream: DataFrame, out: str, checkpoint: str):
    """Append every micro-batch to ``out/epoch=<id>`` and wait for the input to drain."""
    def sink(batch: DataFrame, epoch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/epoch={epoch_id}")

    return _drained(stream, sink, checkpoint)


def model_features(stream_feats: DataFrame) -> DataFrame:
    """The 44 model features from point-in-time stream state (Q4 point-in-time
    forms stand in for the whole-history sender statistics)."""
    f = stream_feats.withColumn("_avg_amount", F.col("sender_mean_so_far")) \
        .withColumn("Device_Count", F.col("device_count_so_far")) \
        .withColumn("Receiver_Diversity", F.col("receiver_diversity_so_far"))
    f = features.amount_stats(features.row_features(f)).withColumn("Amount", F.col("amount"))
    return f


def score_decide(feats: DataFrame, model: PipelineModel | None, threshold: float = THRESHOLD_DEFAULT,
                 probability: Column | None = None) -> DataFrame:
    """Score with ``model`` (fraud probability), or by the expression ``probability``; name the type, decide.

    Rows without features are not scored: their decision is ERROR, with the
    failed validation or one of ``REFUSED`` as the reason."""
    # The model's "Amount" would take the place of "amount", which the rules read.
    x = model_features(feats.withColumn("__amount", F.col("amount")))
    refused = F.col("refused") if "refused" in x.columns else F.lit(None).cast("string")
    known = refused.isNull()
    if model is not None:
        for c in FEATURES:
            x = x.withColumn(c, F.when(known, F.col(c).cast("double")).otherwise(0.0))
        x = model.transform(x).withColumn("fraud_probability",
                                          F.element_at(vector_to_array(F.col("probability")), 2))
        x = x.drop("features", "rawPrediction", "probability", "prediction")
        for c in FEATURES:
            x = x.withColumn(c, F.when(known, F.col(c)))
    else:
        x = x.withColumn("fraud_probability", F.lit(None).cast("double") if probability is None else probability)
    x = x.withColumn("fraud_probability", F.when(known, F.col("fraud_probability")))
    x = x.drop("Amount").withColumnRenamed("__amount", "amount")
    x = rules.infer_fraud_type(x)
    if "validation_message" not in x.columns:
        x = x.withColumn("validation_message", F.lit(None).cast("string"))
    x = x.withColumn("fraud_type", F.when(known, F.col("fraud_type")))
    why = F.coalesce(*[F.when(refused == k, F.lit(text)) for k, text in REFUSED.items()])
    x = x.withColumn("validation_message", F.coalesce("validation_message", why))
    return rules.decide(x, threshold=threshold)


def validated(events: DataFrame, as_of: dt.date) -> DataFrame:
    """``events`` with the message of the first failed request check (null: valid)."""
    field = {c: F.col(c) if c in events.columns else F.lit(None).cast("string")
             for c in ("amount", "txn_type", "card_number", "cvv", "expiry", "upi_id")}
    return events.withColumn("validation_message", validate.validation_message(*field.values(), as_of))


def ledger_rows(decided: DataFrame) -> DataFrame:
    """The blocked and pending transactions as ledger rows."""
    taken = decided.where(F.col("decision").isin("BLOCKED", "PENDING"))
    taken = taken.withColumns({"is_fraud": F.col("is_fraud_pred"), "txn_id": F.col("txn_id").cast("string"),
                               "fraud_type": F.when(F.col("decision") == "BLOCKED", F.col("fraud_type"))})
    return ledger_record(taken, F.col("decision")).select(*[F.col(c).cast(LEDGER_SCHEMA[c].dataType) for c in LEDGER_COLUMNS])


def run_scoring_stream(spark: SparkSession, source, schema, model: PipelineModel | None,
                       out: str, checkpoint: str, threshold: float = THRESHOLD_DEFAULT,
                       max_files_per_trigger: int = 1, idle_seconds: int | None = None, as_of: dt.date | None = None,
                       ledger: str | None = None, probability: Column | None = None, watermark: str = "24 hours"):
    """Validate, add sender features, score, decide, and append to the ledger.

    ``source`` is a Parquet folder or a streaming DataFrame (``sources.io.read_transaction_stream``).  With ``as_of`` the
    request fields are validated and invalid requests leave no trace in the sender state.  With ``ledger`` each epoch's
    blocked and pending rows become one commit of the ``EpochTable`` in that folder."""
    events = source if isinstance(source, DataFrame) else (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source))
    if as_of is not None:
        events = validated(events, as_of)
    feats = sender_state_features(events, watermark=watermark, idle_seconds=idle_seconds)
    scored = score_decide(feats, model, threshold, probability)
    table = EpochTable(spark, ledger) if ledger else None

    def sink(batch: DataFrame, epoch_id: int) -> None:
        if table is not None and epoch_id in table.numbers():
            return  # committed by an earlier attempt
        here = f"{out}/epoch={epoch_id}"
        batch.write.mode("overwrite").parquet(here)
        if table is not None:  # from the written rows: the batch is computed once
            table.append(ledger_rows(batch.sparkSession.read.schema(batch.schema).parquet(here)), epoch_id)

    return _drained(scored, sink, checkpoint)


def run_feedback_stream(spark: SparkSession, source: str, schema, ledger_path: str, work: str,
                        max_files_per_trigger: int = 1, compact_every: int = 16) -> str:
    """Apply each feedback micro-batch to the ledger; returns the folder of the ``DeltaLedger``.

    The ledger at ``ledger_path`` is taken over once.  A micro-batch appends
    its feedback rows as a delta, in one commit per epoch; every
    ``compact_every`` deltas the touched buckets are rewritten.
    """
    store = DeltaLedger(spark, f"{work}/ledger")
    store.create(spark.read.parquet(ledger_path))

    def upsert(batch: DataFrame, epoch_id: int) -> None:
        store.upsert(batch, epoch_id)
        if len(store.latest()[1]["deltas"]) >= compact_every:
            store.compact()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).parquet(source)
    q = (stream.writeStream.foreachBatch(upsert).option("checkpointLocation", f"{work}/_ckpt")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return store.folder


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint directory."""
    return shared_path(spark, "txnrisk", f"{name}-{uuid.uuid4().hex[:12]}")


__all__ = ["replay_source", "seal_source", "state_conf", "stream_to_parquet", "model_features", "score_decide", "validated",
           "ledger_rows", "run_scoring_stream", "run_feedback_stream", "scratch"]
