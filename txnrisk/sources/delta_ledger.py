"""A ledger that takes feedback as small deltas, merged on read and compacted by bucket.

Base rows lie in buckets by a hash of their id.  Feedback is appended as delta
files of the feedback rows alone, so an upsert writes in proportion to the
feedback, not to the ledger.  Reading applies the deltas to the base
(``operators.ledger.apply_feedback``).  Compaction rewrites only the buckets
that some delta touches; the others stay where they are.  Every step is one
commit (``sources.commits``): readers see a whole state, and a retried epoch
is taken once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F, types as T

from txnrisk.operators.ledger import apply_feedback
from txnrisk.sources.commits import Commits

BUCKET = "__bucket"


class DeltaLedger(Commits):
    key = "txn_id"

    def _bucketed(self, df: DataFrame, buckets: int) -> DataFrame:
        """``df`` with its bucket, dealt so that a bucket is one task's file (a large bucket is several)."""
        bucket = F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(buckets)).cast("int")
        return df.withColumn(BUCKET, bucket)

    def create(self, ledger: DataFrame, buckets: int = 64) -> None:
        """The first state; nothing happens when there is one."""
        if self.latest() is not None:
            return
        name = self.new_data("base")
        self._bucketed(ledger, buckets).repartition(BUCKET).write.partitionBy(BUCKET).parquet(self.full(name))
        self.commit(0, {"buckets": buckets, "schema": ledger.schema.json(), "base": {str(b): name for b in range(buckets)}, "deltas": [],
                        "epoch": -1})

    def _state(self) -> tuple[int, dict]:
        found = self.latest()
        if found is None:
            raise FileNotFoundError(f"no ledger under {self.folder}")
        return found

    def upsert(self, feedback: DataFrame, epoch: int) -> bool:
        """Append the feedback rows of ``epoch``; False when that epoch, or a later one, is in already."""
        number, state = self._state()
        if epoch <= state["epoch"]:
            return False
        name = self.new_data("delta")
        self._bucketed(feedback, state["buckets"]).write.partitionBy(BUCKET).parquet(self.full(name))
        deltas = [*state["deltas"], {"path": name, "schema": feedback.schema.json()}]
        if not self.commit(number + 1, {**state, "deltas": deltas, "epoch": epoch}):
            raise RuntimeError(f"another writer changed the ledger under {self.folder}")
        return True

    def _base(self, state: dict, buckets: list[int]) -> DataFrame:
        """Base rows of some buckets (their folders alone are read)."""
        schema = T.StructType.fromJson(json.loads(state["schema"]))
        paths = [self._path(f"{self.full(state['base'][str(b)])}/{BUCKET}={b}") for b in buckets]
        there = [p.toString() for p in paths if self._fs().exists(p)]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def _feedback(self, state: dict) -> DataFrame | None:
        out = None
        for delta in state["deltas"]:
            schema = T.StructType.fromJson(json.loads(delta["schema"])).add(BUCKET, T.IntegerType())
            part = self.spark.read.schema(schema).parquet(self.full(delta["path"]))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        return out

    def rows(self) -> DataFrame:
        """The ledger with all feedback applied."""
        _, state = self._state()
        base, feedback = self._base(state, range(state["buckets"])), self._feedback(state)
        return base if feedback is None else apply_feedback(base, feedback.drop(BUCKET), self.key)

    def compact(self) -> int:
        """Rewrite the buckets that deltas touch; returns how many."""
        number, state = self._state()
        feedback = self._feedback(state)
        if feedback is None:
            return 0
        touched = sorted(r[0] for r in feedback.select(BUCKET).distinct().collect())  # bucket numbers
        name = self.new_data("base")
        merged = apply_feedback(self._base(state, touched), feedback.drop(BUCKET), self.key)
        merged = merged.select(*[F.col(f["name"]).cast(T.StructField.fromJson(f).dataType) for f in json.loads(state["schema"])["fields"]])
        self._bucketed(merged, state["buckets"]).repartition(BUCKET).write.partitionBy(BUCKET).parquet(self.full(name))
        base = {**state["base"], **{str(b): name for b in touched}}
        if not self.commit(number + 1, {**state, "base": base, "deltas": []}):
            raise RuntimeError(f"another writer changed the ledger under {self.folder}")
        return len(touched)
