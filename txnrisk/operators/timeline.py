"""Skew-safe ordered windows over a key's whole history.

A plain ``Window.partitionBy(sender).orderBy(ts)`` puts every row of a
sender into one task; one hot sender holding a third of all rows would make
one task read a third of the data.  Here the window partition is
``(key, time bucket)`` instead, so a hot key is spread over as many tasks as
it has buckets, and exactness is restored by two small side tables:

* **halo rows** - copies of the rows just before each bucket (the last
  ``lookback_rows`` rows of the key before the bucket start, plus every row
  less than ``lookback_seconds`` before it).  They give lag / rolling / range
  frames their true predecessors; they are context only and are dropped after
  the window step.  At most ``lookback_rows`` copies per bucket plus the rows
  of a ``lookback_seconds`` strip, so the extra volume is bounded and small.
* **bucket offsets** - per ``(key, bucket)`` totals (row counts, counts of
  gap thresholds) turned into exclusive prefix sums over buckets, so running
  counters become ``local running value + offset``.

The big table is shuffled on ``(key, bucket)`` only; everything else is a
partial aggregate or a window over the per-bucket table, whose size is the
number of non-empty (key, bucket) pairs, not the number of rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.session import materialize

US = 1_000_000
UNBOUNDED = Window.unboundedPreceding


@dataclass(frozen=True)
class Timeline:
    """Frames ready for the window step.

    ``frames``: own rows (``_own`` true, ``_g`` = bucket) plus halo rows
    (``_own`` false, ``_g`` = the bucket they serve), with ``_us`` = event
    time in microseconds.  Window over ``window()``; keep ``_own`` rows.

    ``buckets``: one row per non-empty ``(key, _g)`` with ``_cum`` (rows of the
    key in earlier buckets) and ``_off_<name>`` prefix offsets of the gap
    counters requested.
    """

    frames: DataFrame
    buckets: DataFrame
    key: str
    tie: str

    def window(self):
        return Window.partitionBy(self.key, "_g").orderBy("_us", self.tie)


@dataclass(frozen=True)
class Bucketing:
    """How rows are cut into (key, bucket) frames.

    Every key uses ``default_seconds`` wide buckets except the hot keys listed
    in ``hot`` (key -> ``_hw`` width in microseconds), which get narrower
    buckets so that no bucket holds much more than the target row count.
    ``hot`` is small by construction (see :func:`plan_buckets`); it is
    broadcast when its counted size allows (``broadcast_hot``), otherwise
    joined with a shuffle whose skewed partitions adaptive execution splits.
    """

    key: str
    ts: str
    default_seconds: int
    hot: DataFrame | None = None
    broadcast_hot: bool = True

    def apply(self, df: DataFrame) -> DataFrame:
        us = F.unix_micros(F.col(self.ts).cast("timestamp"))
        d = df.withColumn("_us", us)
        default_w = F.lit(self.default_seconds * US)
        if self.hot is None:
            d = d.withColumn("_w", default_w)
        else:
            hot = F.broadcast(self.hot) if self.broadcast_hot else self.hot
            d = (d.join(hot, self.key, "left")
                 .withColumn("_w", F.coalesce(F.col("_hw"), default_w)).drop("_hw"))
        return d.withColumn("_b", F.floor(F.col("_us") / F.col("_w")).cast("long"))


def plan_buckets(df: DataFrame, *, key: str, ts: str, default_seconds: int, min_seconds: int,
                 hot_rows: int | None = 5_000_000, target_rows: int = 1_000_000,
                 max_broadcast_keys: int = 200_000) -> Bucketing:
    """Choose bucket widths: fixed, except for keys with more than ``hot_rows``
    rows, whose width is cut so a bucket holds about ``target_rows`` rows on
    average (never below ``min_seconds``, the longest time lookback).

    The hot-key table comes from one partial aggregate (at most
    rows / ``hot_rows`` entries).  It is materialized and counted up front, so
    the broadcast decision rests on its actual size and the rows are never
    shuffled by key just to attach a width: with no hot key there is no
    join at all, up to ``max_broadcast_keys`` it is a broadcast join, beyond
    that a shuffled join with adaptive skew splitting.  Keys hotter than
    ``target_rows`` per ``min_seconds`` keep minimum-width buckets (the
    lookback strip needs that width).
    """
    if hot_rows is None:
        return Bucketing(key=key, ts=ts, default_seconds=default_seconds)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    stats = (df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.min(us).alias("_lo"),
                                 F.max(us).alias("_hi"))
             .where(F.col("_n") > hot_rows))
    width = F.floor((F.col("_hi") - F.col("_lo")).cast("double") * target_rows / F.col("_n")).cast("long")
    hot = stats.select(key, F.least(F.greatest(width, F.lit(min_seconds * US)),
                                    F.lit(default_seconds * US)).alias("_hw"))
    hot = materialize(hot)
    n_hot = hot.count()
    if n_hot == 0:
        return Bucketing(key=key, ts=ts, default_seconds=default_seconds)
    return Bucketing(key=key, ts=ts, default_seconds=default_seconds, hot=hot,
                     broadcast_hot=n_hot <= max_broadcast_keys)


def gap_hours(w) -> Column:
    """Hours since the previous row of the frame (null for the first)."""
    return (F.col("_us") - F.lag("_us").over(w)) / F.lit(1e6) / F.lit(3600.0)


def build_timeline(df: DataFrame, *, key: str, ts: str = "ts", tie: str = "txn_id",
                   carry: list[str], lookback_rows: int, lookback_seconds: int,
                   bucket_seconds: int, gap_counters: dict[str, float] | None = None,
                   first_gap_hours: float = 24.0, bucketing: Bucketing | None = None,
                   sum_columns: tuple[str, ...] = ()) -> Timeline:
    """Split ``df`` into (key, bucket) frames with halos and bucket offsets.

    ``gap_counters`` maps a name to an hour threshold: the bucket table gets
    ``_off_<name>``, the number of the key's rows in earlier buckets whose
    gap to their predecessor is at most the threshold (a key's first row
    counts with ``first_gap_hours``).  Each column in ``sum_columns`` gets
    ``_offsum_<column>``, its sum over the key's earlier buckets.
    """
    if lookback_seconds > bucket_seconds:
        raise ValueError("lookback_seconds must not exceed bucket_seconds")
    gap_counters = gap_counters or {}
    bucketing = bucketing or Bucketing(key=key, ts=ts, default_seconds=bucket_seconds)
    bucket_us = F.col("_w")  # per-key bucket width (microseconds)
    range_us = lookback_seconds * US
    cols = list(dict.fromkeys([key, tie, "_us", "_w", "_b", *carry]))
    d = bucketing.apply(df).select(*cols)

    # Per-bucket sizes and time span: partial aggregates, no row shuffle.
    wk = Window.partitionBy(key).orderBy("_b")
    bt = (d.groupBy(key, "_b")
          .agg(F.count(F.lit(1)).alias("_n"), F.min("_us").alias("_first_us"),
               F.max("_us").alias("_last_us"), *[F.sum(c).alias(f"_bsum_{c}") for c in sum_columns]))
    earlier = wk.rowsBetween(UNBOUNDED, -1)
    bt = bt.withColumns({
        "_cum": F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long"),
        "_prev_last_us": F.lag("_last_us").over(wk),
        **{f"_offsum_{c}": F.coalesce(F.sum(f"_bsum_{c}").over(earlier), F.lit(0)) for c in sum_columns}})
    bt = bt.withColumn("_next", F.collect_list(F.struct(F.col("_b").alias("b"),
                                                        F.col("_cum").alias("cum")))
                       .over(wk.rowsBetween(1, lookback_rows)))
    # (One row per non-empty (key, bucket); its two readers each recompute the
    # partial aggregate, which is cheaper than writing and reading it back.)

    # Pass A: position inside the bucket, local gap counts, tail rows.
    wa = Window.partitionBy(key, "_b").orderBy("_us", tie)
    gh = gap_hours(wa)
    # Local gap counts skip the bucket's first row (its predecessor lies in an
    # earlier bucket); that row is added back from the bucket table.
    a = d.select("*", F.row_number().over(wa).alias("_rn"),
                 *[F.sum(F.when(gh <= hours, 1).otherwise(0)).over(wa.rowsBetween(UNBOUNDED, 0))
                   .alias(f"_in_{name}") for name, hours in gap_counters.items()])
    a = a.join(bt.select(key, "_b", "_n", "_cum", "_next"), [key, "_b"])
    near_end = F.col("_us") > (F.col("_b") + 1) * bucket_us - F.lit(range_us)
    # Tail rows feed both the halo copies and the bucket totals.  They are a
    # small table (<= lookback_rows per bucket plus the range strip), so they
    # are computed once instead of re-running pass A for each consumer.
    tails = materialize(a.where((F.col("_rn") > F.col("_n") - lookback_rows) | near_end))

    # Halo rows: each tail row is copied to the later buckets that need it.
    nxt = F.explode("_next").alias("_t")
    h = tails.select(*cols, "_rn", "_n", "_cum", nxt)
    rows_between = (F.col("_n") - F.col("_rn")) + (F.col("_t.cum") - F.col("_cum") - F.col("_n"))
    by_rows = rows_between < lookback_rows
    by_range = (F.col("_t.b") == F.col("_b") + 1) & \
        (F.col("_us") > F.col("_t.b") * bucket_us - F.lit(range_us))
    halo = (h.where(by_rows | by_range)
            .select(*cols, F.col("_t.b").alias("_g"), F.lit(False).alias("_own")))
    own = d.select(*cols, F.col("_b").alias("_g"), F.lit(True).alias("_own"))
    frames = own.unionByName(halo)

    # Bucket offsets: exclusive prefix sums of per-bucket totals.
    buckets = bt.select(key, F.col("_b").alias("_g"), "_cum", "_first_us", "_prev_last_us",
                        *[f"_offsum_{c}" for c in sum_columns])
    if gap_counters:
        last = (tails.where(F.col("_rn") == F.col("_n"))
                .select(key, F.col("_b").alias("_g"),
                        *[F.col(f"_in_{n}") for n in gap_counters]))
        buckets = buckets.join(last, [key, "_g"], "left")
        wg = Window.partitionBy(key).orderBy("_g").rowsBetween(UNBOUNDED, -1)
        first_gap = (F.col("_first_us") - F.col("_prev_last_us")) / F.lit(1e6) / F.lit(3600.0)
        for name, hours in gap_counters.items():
            first_flag = F.when(F.coalesce(first_gap, F.lit(first_gap_hours)) <= hours, 1).otherwise(0)
            total = F.coalesce(F.col(f"_in_{name}"), F.lit(0)) + first_flag
            buckets = buckets.withColumn(f"_tot_{name}", total)
        for name in gap_counters:
            buckets = buckets.withColumn(
                f"_off_{name}", F.coalesce(F.sum(f"_tot_{name}").over(wg), F.lit(0)).cast("long"))
        buckets = buckets.drop(*[f"_tot_{n}" for n in gap_counters],
                               *[f"_in_{n}" for n in gap_counters])
    return Timeline(frames=frames, buckets=buckets, key=key, tie=tie)


def pair_offsets(df: DataFrame, *, key: str, other: str, ts: str,
                 bucket_seconds: int, name: str, bucketing: Bucketing | None = None) -> DataFrame:
    """Rows of each (key, other) pair in earlier buckets: ``_poff_<name>``.

    With the local running count over ``(key, bucket, other)`` this gives the
    running count over the pair's whole history.  One row per non-empty
    (key, other, bucket); the prefix window runs over buckets of one pair.
    """
    bucketing = bucketing or Bucketing(key=key, ts=ts, default_seconds=bucket_seconds)
    d = bucketing.apply(df)
    pc = d.groupBy(key, other, "_b").agg(F.count(F.lit(1)).alias("_pn"))
    w = Window.partitionBy(key, other).orderBy("_b").rowsBetween(UNBOUNDED, -1)
    return pc.select(key, other, F.col("_b").alias("_g"),
                     F.coalesce(F.sum("_pn").over(w), F.lit(0)).cast("long").alias(f"_poff_{name}"))



def first_sighting_offsets(buckets: DataFrame, poff: DataFrame, *, key: str, name: str) -> DataFrame:
    """Per (key, bucket) of ``buckets``: how many distinct values of a pair
    table were first seen in earlier buckets (``_foff_<name>``).  A pair's
    first bucket is where its offset is 0.  Small tables only."""
    firsts = (poff.where(F.col(f"_poff_{name}") == 0)
              .groupBy(key, "_g").agg(F.count(F.lit(1)).alias("_new")))
    w = Window.partitionBy(key).orderBy("_g").rowsBetween(UNBOUNDED, -1)
    return (buckets.select(key, "_g").join(firsts, [key, "_g"], "left")
            .select(key, "_g", F.coalesce(F.sum(F.coalesce(F.col("_new"), F.lit(0))).over(w), F.lit(0))
                    .cast("long").alias(f"_foff_{name}")))
