"""Session construction and cluster-shared paths.

Library code never builds its own session: every operator takes the
DataFrames it works on.  ``get_session`` exists for tests, the bench and
command-line use.  The checkpoint directory is always read from the
session (``spark.checkpoint.dir``); a local default is only set when the
setting is absent, which is the case in tests and local runs.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "txnrisk") -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or int(cpus)
    spark = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Joins on (sender, bucket, x) may reuse a (sender, bucket) partitioning.
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        # Checkpointed intermediates are removed once their DataFrames are gone.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("TXNRISK_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    workers_find_package(spark)
    return spark


def workers_find_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    Functions are sent to workers by name.  On a cluster the package must lie
    under the same path there, or be sent along (``--py-files``)."""
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    known = env.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(p for p in (root, known) if p)


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the session.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used
    as is.  When it is unset on a local master (tests, local runs) a scratch
    folder is created once and registered with the SparkContext so every later
    call agrees; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="txnrisk-ckpt-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def shared_path(spark: SparkSession, *parts: str) -> str:
    """A path under the shared checkpoint folder (for written tables)."""
    base = checkpoint_dir(spark)
    return "/".join([base.rstrip("/"), *parts])


def materialize(df):
    """Compute ``df`` once into the shared checkpoint folder and return a
    DataFrame reading it back: lineage is cut, executors can be lost without
    recomputing it, and nothing stays cached in memory.  Meant for small
    intermediate tables that several branches of one plan read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
