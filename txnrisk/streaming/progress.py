"""A table of every micro-batch's figures.

Spark keeps the progress of a query's last 100 batches.  ``ProgressLog``
listens to all of them and writes one small JSON file per batch, so no batch is
missing from a summary however long the query runs.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

SCHEMA = "run_id string, batch long, ms double, n_rows long, state_rows long, late_rows long, watermark string"


class ProgressLog(StreamingQueryListener):
    """Use as ``with ProgressLog(spark, folder) as log:`` around the queries, then ``log.rows()``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.seen = spark, folder.rstrip("/"), set()

    def __enter__(self) -> "ProgressLog":
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        at = (str(p.runId), p.batchId)
        if at in self.seen or "triggerExecution" not in p.durationMs:
            return
        row = {"run_id": at[0], "batch": p.batchId, "ms": float(p.durationMs["triggerExecution"]), "n_rows": p.numInputRows,
               "state_rows": sum(s.numRowsTotal for s in p.stateOperators),
               "late_rows": sum(s.numRowsDroppedByWatermark for s in p.stateOperators), "watermark": p.eventTime.get("watermark")}
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{at[0]}-{p.batchId:012d}.json")
        sink = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).create(path, True)
        sink.write(bytearray(json.dumps(row).encode()))
        sink.close()
        self.seen.add(at)

    def wait_for(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Until the last batch of a finished query is in the table (events reach listeners after the batch)."""
        last = query.lastProgress
        until = time.monotonic() + seconds
        while last is not None and (str(last["runId"]), last["batchId"]) not in self.seen:
            if time.monotonic() > until:
                raise TimeoutError("the query's last progress event has not arrived")
            time.sleep(0.05)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(SCHEMA).json(self.folder)
