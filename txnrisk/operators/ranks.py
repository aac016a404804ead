"""Exact ranks and shares of large tables without a global sort in one task.

Rows are dealt into bins by a value in [0, 1) or by ranges of sort keys; the
bins' counts (a small table) give each bin's first rank, and rows are ranked
inside their bin.  No window covers the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.operators.clean import attach_one_row
from txnrisk.operators.inject import unit_hash
from txnrisk.session import materialize

#: Bins of a draw: a bin holds about rows / BINS of a group's rows.
BINS = 65536


def _offsets(counts: DataFrame, group: list[str], bin_col: str) -> DataFrame:
    """``counts`` (group, bin, n) with the rows of all lower bins of the group."""
    below = Window.partitionBy(*(group or [F.lit(0)])).orderBy(bin_col).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("n").over(below), F.lit(0)))


def least_draws(df: DataFrame, share: float, seed: int, key: str = "txn_id", group: str | None = None, out: str = "chosen",
                bins: int = BINS) -> DataFrame:
    """Add ``out``: true for exactly round(share * n) of the n rows of each
    ``group`` (of the table without one), those with the least hash draws of
    ``key``; equal draws by key.

    A histogram of the draws finds the bin of the last chosen row; only the
    rows of that bin are ranked, the rest are decided by their bin.  Nothing
    but the histogram and the boundary bins' rows is shuffled.
    """
    g = "_g"
    # As sort keys: the draw, then the key.
    dealt = df.withColumn("_u", unit_hash(F.col(key), seed)).withColumn("_bin", F.floor(F.col("_u") * bins).cast("int"))
    dealt = dealt.withColumn(g, F.lit(0) if group is None else F.col(group))
    counts = materialize(dealt.groupBy(g, "_bin").agg(F.count(F.lit(1)).alias("n")))
    wanted = counts.groupBy(g).agg(F.floor(F.sum("n") * share + 0.5).alias("_k"))
    edge = (_offsets(counts, [g], "_bin").join(wanted, g).where("_before <= _k AND _k < _before + n")
            .select(g, F.col("_bin").alias("_edge"), (F.col("_k") - F.col("_before")).alias("_more")))
    edge = edge.unionByName(wanted.join(edge, g, "left_anti").select(g, F.lit(bins).alias("_edge"), F.lit(0).cast("long").alias("_more")))
    edge = materialize(edge)  # a row per group
    cut = dealt.select(g, "_bin", "_u", F.col(key).alias("_key")).join(edge.where("_more > 0"), g).where("_bin = _edge")
    nth = F.row_number().over(Window.partitionBy(g).orderBy("_u", "_key"))
    inside = cut.withColumn("_nth", nth).where("_nth <= _more").select(F.col(g).alias("_ig"), F.col("_key").alias("_ik"))
    marked = dealt.join(edge, g, "left").join(inside.withColumn("_hit", F.lit(True)), (F.col(g) == F.col("_ig"))
                                              & (F.col("_bin") == F.col("_edge")) & (F.col(key) == F.col("_ik")), "left")
    return (marked.withColumn(out, F.coalesce((F.col("_bin") < F.col("_edge")) | F.col("_hit"), F.lit(False)))
            .drop(g, "_u", "_bin", "_edge", "_more", "_ig", "_ik", "_hit"))


def draw_ranks(df: DataFrame, seed: int, key: str = "txn_id", out: str = "draw_rank", bins: int = 4096) -> DataFrame:
    """Add ``out``: the rank, from 0, of each row's hash draw of ``key`` among all rows (equal draws by key)."""
    dealt = df.withColumn("_u", unit_hash(F.col(key), seed)).withColumn("_bin", F.floor(F.col("_u") * bins).cast("int"))
    first = _offsets(dealt.groupBy("_bin").agg(F.count(F.lit(1)).alias("n")), [], "_bin").select("_bin", "_before")
    nth = F.row_number().over(Window.partitionBy("_bin").orderBy("_u", key))
    return dealt.join(first, "_bin").withColumn(out, F.col("_before") + nth - 1).drop("_u", "_bin", "_before")


def ordered_positions(df: DataFrame, order: list[Column], out: str = "position") -> DataFrame:
    """Add ``out``: the position, from 0, of each row in ``order``, which must not leave ties.

    Rows are range-partitioned and sorted once; the partitions' sizes give each one's first position."""
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged = materialize(ranged)  # the ranges are drawn from a sample: they are looked at once
    first = _offsets(ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("n")), [], "_part").select("_part", "_before")
    nth = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return ranged.join(first, "_part").withColumn(out, F.col("_before") + nth - 1).drop("_part", "_before")


def order_by_time(df: DataFrame, ts: str = "ts", tie: str = "txn_id") -> DataFrame:
    """Rows in time order (equal times by id): a range-partitioned sort."""
    return df.orderBy(F.col(ts).asc_nulls_last(), F.col(tie))


def equal_shares(df: DataFrame, rank: str, shares: int, out: str = "share") -> DataFrame:
    """Add ``out``: 0 .. shares - 1 by ``rank``, as equal as can be, the first shares one row larger."""
    n = df.agg(F.count(F.lit(1)).alias("_n"))
    size, more = F.floor(F.col("_n") / shares), F.col("_n") % shares
    large = more * (size + 1)
    own = F.when(F.col(rank) < large, F.floor(F.col(rank) / (size + 1))).otherwise(more + F.floor((F.col(rank) - large) / size))
    return attach_one_row(df, n).withColumn(out, own.cast("int")).drop("_n")
