"""Exact deduplication with streaming state (DataFrame functions only).

Arrivals are appended to a narrow log (digest, identifier, content locator).
A Structured Streaming aggregation keyed by digest keeps its state in RocksDB
without expiry: per digest the largest identifier, that row's locator and the
number of arrivals.  The state itself is the result and is read back with the
state-store source, so later batches go on from it.  Every digest that was hit
more than once is checked on its full bytes: the batch's texts against each
other and against the text of one earlier row, read from the file that its
locator names.  Texts that share a digest without being equal are grouped by
their text instead, with the earlier ones read through their locators.

Defined cases: a null text counts as empty; rows with a null doc_id take part
and never win against a numbered row; a repeated (doc_id, text) row counts in
group_size and every copy of the winning row has kept = true; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from txnrisk.llm.common import staged
from txnrisk.session import shared_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bounds what all state stores of an executor hold in memory, and lets their
#: many small files take only the disk they fill.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: The hot digests' rows are spread over this many keys when their bytes are compared.
SALTS = 32


def sha256_bytes(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


class ExactDedup:
    """Keyed dedup state in ``folder`` (under the shared folder by default).

    ``add`` appends a batch of documents to the log; ``advance`` lets the stream
    take all that is new; ``groups`` reads the state; ``resolve`` decides the
    batch added last.  The same folder can be opened again later to go on where
    it stopped.  All batches name their columns alike, and files that hold
    documents stay where they are; documents that come from no file are kept
    beside the log.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, digest=sha256_bytes):
        self.spark, self.digest = spark, digest
        self.folder = folder or shared_path(spark, f"llm-{uuid.uuid4().hex}", "exact")
        self.log = f"{self.folder}/log"
        self.checkpoint = f"{self.folder}/state"
        self.mixed_log = f"{self.folder}/mixed"
        self.batch = None

    def rows(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"),
                           self.digest(text).alias("digest"))

    def add(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        self.batch = uuid.uuid4().hex
        rows = self.rows(docs, id_col, text_col)
        if not docs.inputFiles():
            content = rows.select(F.col("doc_id").alias(id_col), F.col("text").alias(text_col))
            folder = f"{self.folder}/content/{self.batch}"
            content.write.parquet(folder)
            rows = self.rows(self.spark.read.schema(content.schema).parquet(folder), id_col, text_col)
        narrow = rows.select(
            "doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"),
            F.input_file_name().alias("file"), F.lit(self.batch).alias("batch"))
        narrow.write.mode("append").parquet(self.log)
        self._note(self.spark.createDataFrame([], self._mixed_schema))

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self._schema).parquet(self.log)

    def earlier(self) -> DataFrame:
        """Log entries of the batches before the last one."""
        return self.entries().where(F.col("batch") != self.batch)

    _schema = "doc_id long, digest binary, n_bytes long, file string, batch string"
    #: Digests with unequal texts; a row of nulls marks a batch that was resolved.
    _mixed_schema = "digest binary, n_bytes long, batch string"

    def mixed(self) -> DataFrame:
        return self.spark.read.schema(self._mixed_schema).parquet(self.mixed_log)

    def _note(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(self.mixed_log)

    def located(self, wanted: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, digest, n_bytes, text) of log entries, read from the files they name.  The driver holds the names
        of those files, as it does for any scan of them."""
        key = ["doc_id", "digest", "n_bytes", "file"]
        paths = [unquote(r.file) for r in wanted.select("file").distinct().collect()]
        if "" in paths:
            raise ValueError("documents without a file cannot be found again: write them as a table and add that")
        if not paths:
            return self.spark.createDataFrame([], "doc_id long, digest binary, n_bytes long, text string")
        rows = self.rows(self.spark.read.parquet(*paths), id_col, text_col).select(
            "doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes"), "text", F.input_file_name().alias("file"))
        named = wanted.select(*[F.col(k).alias(f"w_{k}") for k in key]).distinct()
        return rows.join(named, [rows[k].eqNullSafe(named[f"w_{k}"]) for k in key], "left_semi").drop("file")

    def advance(self) -> None:
        conf = self.spark.conf
        saved = {k: conf.get(k, None) for k in STATE_CONF}
        for k, v in STATE_CONF.items():
            conf.set(k, v)
        try:
            arrivals = self.spark.readStream.schema(self._schema).parquet(self.log)
            state = arrivals.groupBy("digest", "n_bytes").agg(
                F.max(F.struct("doc_id", "file")).alias("keeper"), F.count(F.lit(1)).alias("n"))
            (state.writeStream.outputMode("update").format("noop")
             .option("checkpointLocation", self.checkpoint)
             .trigger(availableNow=True).start().awaitTermination())
        finally:
            for k, v in saved.items():
                conf.unset(k) if v is None else conf.set(k, v)

    def groups(self) -> DataFrame:
        """One row per digest: digest, n_bytes, keep_id, file, n."""
        if self.entries().isEmpty():
            return self.spark.createDataFrame([], "digest binary, n_bytes long, keep_id long, file string, n long")
        state = self.spark.read.format("statestore").load(self.checkpoint)
        value = state.schema["value"].dataType.fieldNames()
        return state.select(
            F.col("key.digest").alias("digest"), F.col("key.n_bytes").alias("n_bytes"),
            F.col("value").getField(value[0]).getField("doc_id").alias("keep_id"),
            F.col("value").getField(value[0]).getField("file").alias("file"),
            F.col("value").getField(value[1]).alias("n"))

    def check_hits(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Full-byte check of every digest of the last batch, ``docs``, that was
        seen more than once: (digest, n_bytes) whose texts are not all equal.
        The rows of a digest are salted, and each salt sends on only its least
        and greatest text.  Earlier batches have been checked, so one of their
        rows stands for all, unless they were found unequal."""
        hits = (self.groups().where("n > 1").select("digest", "n_bytes")
                .withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))))
        rows = self.rows(docs, id_col, text_col).select(
            "digest", F.octet_length("text").cast("long").alias("n_bytes"), "text",
            F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
        part = (rows.join(hits, ["digest", "n_bytes", "salt"])
                .groupBy("digest", "n_bytes", "salt").agg(F.min("text").alias("lo"), F.max("text").alias("hi")))
        if self.earlier().isEmpty():
            return self._unequal(part)
        left = self.earlier().select("batch").distinct().join(self.mixed().where("digest IS NULL"), "batch", "left_anti")
        if not left.isEmpty():
            raise ValueError("an earlier batch has not been resolved")
        key = ["digest", "n_bytes"]
        met = self.entries().where(F.col("batch") == self.batch).select(*key).distinct()
        first = (self.earlier().join(met, key, "left_semi").groupBy(*key).agg(F.min(F.struct("doc_id", "file")).alias("at"))
                 .select(*key, "at.doc_id", "at.file"))
        before = self.located(staged(first, "first"), id_col, text_col)
        found = self._unequal(part.unionByName(before.select(*key, F.lit(None).cast("int").alias("salt"),
                                                             F.col("text").alias("lo"), F.col("text").alias("hi"))))
        return found.unionByName(self.mixed().select(*key).join(met, key, "left_semi")).distinct()

    @staticmethod
    def _unequal(part: DataFrame) -> DataFrame:
        return (part.groupBy("digest", "n_bytes").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
                .where("lo <> hi").select("digest", "n_bytes"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                folder: str | None = None, digest=sha256_bytes) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest, n_bytes.

    Texts are equal when their bytes are; the largest doc_id of a group stays.
    """
    state = ExactDedup(docs.sparkSession, folder, digest)
    state.add(docs, id_col, text_col)
    state.advance()
    return resolve(state, docs, id_col, text_col)


def resolve(state: ExactDedup, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Decisions for ``docs``, the batch that ``state`` was given last, against
    all it has seen.  Every batch is resolved before the next one."""
    groups = staged(state.groups().select("digest", "n_bytes", "keep_id", "n"), "groups")
    unequal = staged(state.check_hits(docs, id_col, text_col), "unequal")
    out = state.entries().where(F.col("batch") == state.batch).join(groups, ["digest", "n_bytes"])
    if not unequal.isEmpty():
        rows = state.rows(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
        mixed = rows.join(unequal, ["digest", "n_bytes"])
        before = staged(state.earlier().join(unequal, ["digest", "n_bytes"], "left_semi"), "before")
        texts = mixed.unionByName(state.located(before, id_col, text_col))
        own = texts.groupBy("digest", "n_bytes", "text").agg(F.max("doc_id").alias("keep_id"),
                                                             F.count(F.lit(1)).alias("n"))
        apart = mixed.join(own, ["digest", "n_bytes", "text"]).select("digest", "n_bytes", "doc_id", "keep_id", "n")
        out = (out.join(unequal, ["digest", "n_bytes"], "left_anti")
               .select("digest", "n_bytes", "doc_id", "keep_id", "n").unionByName(apart))
    mark = state.spark.createDataFrame([(None, None)], "digest binary, n_bytes long")
    state._note(unequal.unionByName(mark).withColumn("batch", F.lit(state.batch)))
    return out.select("doc_id", "keep_id", F.col("n").alias("group_size"),
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest", "n_bytes")


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the copies: of equal texts the row with the largest
    doc_id; of repeated rows of one doc_id and text, one.  Rows are told apart
    by identifier and text, so different texts under one doc_id, or under none,
    all stay."""
    key = ["__id", "__digest", "__n_bytes"]
    kept = (exact_dedup(docs, id_col, text_col).where("kept")
            .select(*[F.col(c).alias(f"__kept{k}") for c, k in zip(("doc_id", "digest", "n_bytes"), key)]).distinct())
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select("*", F.col(id_col).cast("long").alias("__id"), sha256_bytes(text).alias("__digest"),
                       F.octet_length(text).cast("long").alias("__n_bytes"))
    same = [rows[k].eqNullSafe(kept[f"__kept{k}"]) for k in key]
    return rows.join(kept, same, "left_semi").dropDuplicates(key).drop(*key)
