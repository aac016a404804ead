"""A replayed table is computed by all its tasks, and its slices come in order, in one file or several."""

from pyspark.sql import functions as F

from txnrisk.streaming import scoring


def _table(spark):
    ids = spark.range(0, 4000, numPartitions=5)
    at = F.timestamp_seconds(F.lit(1_700_000_000) + (F.col("id") * 7919) % 4000)
    return ids.select(F.col("id").alias("txn_id"), at.alias("ts"), F.spark_partition_id().alias("task"))


def _batches(spark, src, schema, files):
    out = scoring.scratch(spark, "replayed")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(src)
    scoring.stream_to_parquet(stream, out, scoring.scratch(spark, "replay-ckpt"))
    return spark.read.parquet(out).groupBy("epoch").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))


def test_all_tasks_compute_the_table(spark):
    t, src = _table(spark), scoring.scratch(spark, "slices")
    scoring.replay_source(t, src, n_files=4)
    assert spark.read.parquet(src).select("task").distinct().count() == 5  # one task read all of it before
    assert spark.read.parquet(src).select("txn_id").distinct().count() == spark.read.parquet(src).count() == 4000


def test_large_slices_are_several_files_of_one_batch(spark):
    t, src = _table(spark), scoring.scratch(spark, "slices")
    files = scoring.replay_source(t, src, n_files=4, file_rows=300)
    assert files > 1 and len(spark.read.parquet(src).inputFiles()) == 4 * files
    got = _batches(spark, src, t.schema, files).orderBy("epoch").collect()
    assert len(got) == 4 and sum(r.n for r in got) == 4000
    assert all(a.hi < b.lo for a, b in zip(got, got[1:]))


def test_rows_of_one_time_and_of_none(spark):
    rows = [(i, 5 if i < 30 else None) for i in range(40)]
    t = spark.createDataFrame(rows, "txn_id long, at long")
    for n_files, kept in ((1, 40), (3, 30)):  # a row without a time has no slice
        src = scoring.scratch(spark, "ties")
        scoring.replay_source(t, src, n_files=n_files, arrival=F.col("at"))
        assert spark.read.parquet(src).count() == kept
