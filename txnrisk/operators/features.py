"""Per-sender history features and the 44-column feature matrix.

Senders of up to ``HOT_ROWS`` rows are one frame each: one exchange of the rows
by sender serves every window, and the whole-history statistics are sums of
first sightings over the frame.  Hotter senders go through the (sender, bucket)
frames of :mod:`txnrisk.operators.timeline`; their running counters add bucket
offsets, and their whole-history statistics come from partial aggregates joined
at (sender, bucket) granularity.  Either way the only full shuffle of the rows
is one by sender and bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.functions import geo, scalar
from txnrisk.operators.clean import attach_one_row, sanitize_numeric, select_features
from txnrisk.operators.timeline import (UNBOUNDED, US, Bucketing, build_timeline, first_sighting_offsets, pair_offsets,
                                       plan_buckets)
from txnrisk.schema import (AMOUNT, DEVICE, FEATURES, FIRST_GAP_HOURS, FIRST_GAP_MINUTES,
                            GAP_COUNT_HOURS, LOCATION, MERCHANT, MERCHANT_TYPES, RAPID_GAP_HOURS,
                            RECEIVER, ROLLING_ROWS, SENDER, TS, TXN_ID, TXN_TYPE, TXN_TYPES,
                            VELOCITY_WINDOW_SECONDS)

DAY_SECONDS = 86400
HOT_ROWS = 5_000_000      # senders above this many rows get narrower buckets
TARGET_ROWS = 1_000_000   # average rows per bucket aimed at for hot senders


def sender_totals(txn: DataFrame, key: str = SENDER) -> DataFrame:
    """Whole-history sender statistics: mean amount, distinct devices/receivers.

    One aggregation: Catalyst rewrites the two distinct counts into a partial
    aggregate over (sender, device) and (sender, receiver) (an Expand), so a
    hot sender is combined map side and never lands in one task as raw rows.
    """
    return txn.groupBy(key).agg(F.avg(AMOUNT).alias("_avg_amount"),
                                F.count_distinct(DEVICE).alias("Device_Count"),
                                F.count_distinct(RECEIVER).alias("Receiver_Diversity"))


def history_features(txn: DataFrame, *, key: str = SENDER, ts: str = TS, tie: str = TXN_ID,
                     bucket_seconds: int = DAY_SECONDS, totals: bool = True, point_in_time: bool = False,
                     hot_rows: int | None = HOT_ROWS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Add the point-in-time history features to every transaction row.

    Output adds: Time_Since_Last_Txn, Time_Diff_Hours, Txn_Count_Total,
    Txn_Count_Last_{1,6,24}H, Rapid_Txn_Count_Last_1H, Amount_Rolling_Mean_10,
    Amount_Rolling_Std_10, Is_New_Device, Location_Distance_Km,
    Is_Unusual_Location, Location_Speed_Kmh, Is_High_Speed,
    Receiver_Frequency, Is_First_Time_Receiver, Txn_Count_Last_10_Min and,
    with ``totals``, _avg_amount, Device_Count, Receiver_Diversity over the
    sender's whole history.  With ``point_in_time`` the last three count
    only the sender's history up to and including each row (mean amount so
    far, devices and receivers seen so far), as training and streaming need.
    Id columns are expected non-null (``clean.fill_missing`` first).
    """
    bucketing = plan_buckets(txn, key=key, ts=ts, default_seconds=bucket_seconds,
                             min_seconds=VELOCITY_WINDOW_SECONDS, hot_rows=hot_rows, target_rows=target_rows)
    how = dict(key=key, ts=ts, tie=tie, totals=totals, point_in_time=point_in_time)
    if hot_rows is None:  # buckets for all
        return _bucketed_history(txn, bucketing, bucket_seconds, **how)
    cold, hot = split_hot(txn, bucketing)
    out = _whole_history(cold, **how)
    return out if hot is None else out.unionByName(_bucketed_history(hot, bucketing, bucket_seconds, **how))


def split_hot(txn: DataFrame, bucketing: Bucketing) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the senders that fit one frame, and those of the hot ones (None: there are none)."""
    if bucketing.hot is None:
        return txn, None
    keys = bucketing.hot.select(bucketing.key)
    keys = F.broadcast(keys) if bucketing.broadcast_hot else keys
    return txn.join(keys, bucketing.key, "left_anti"), txn.join(keys, bucketing.key, "left_semi")


def _one_frame(txn: DataFrame, ts: str) -> DataFrame:
    """``txn`` with its time in microseconds and one bucket for all times, so windows read as those over buckets do."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return txn.withColumn("_us", us).withColumn("_g", F.shiftright(F.col("_us") + F.lit(1 << 61), 62).cast("long"))


def _sightings(f: DataFrame, other: str, key: str, tie: str, out: str) -> DataFrame:
    """How often the sender has used the row's value of ``other``, this row included."""
    return f.withColumn(out, F.row_number().over(Window.partitionBy(key, "_g", other).orderBy("_us", tie)))


def _whole_history(txn: DataFrame, *, key: str, ts: str, tie: str, totals: bool, point_in_time: bool) -> DataFrame:
    """History features of senders that are one frame each: one exchange, three sorts."""
    f = _sightings(_sightings(_one_frame(txn, ts), DEVICE, key, tie, "_dev_n"), RECEIVER, key, tie, "_recv_n")
    w = Window.partitionBy(key, "_g").orderBy("_us", tie)
    run = w.rowsBetween(UNBOUNDED, 0)
    f = f.select("*", *_frame_columns(w, key, tie), F.row_number().over(w).cast("long").alias("Txn_Count_Total"))
    f = _with_gaps(f)
    tdh = F.col("Time_Diff_Hours")
    new = {"Device_Count": (F.col("_dev_n") == 1), "Receiver_Diversity": (F.col("_recv_n") == 1)}
    if totals or point_in_time:
        over = run if point_in_time else Window.partitionBy(key, "_g")
        known = {"Device_Count": F.lit(True) if point_in_time else F.col(DEVICE).isNotNull(),
                 "Receiver_Diversity": F.lit(True) if point_in_time else F.col(RECEIVER).isNotNull()}
        stats = [F.avg(AMOUNT).over(over).alias("_avg_amount"),
                 *[F.sum(F.when(flag & known[c], 1).otherwise(0)).over(over).cast("long").alias(c) for c, flag in new.items()]]
    else:
        stats = []
    f = f.select("*", _rapid(tdh, w), *stats,
                 *[F.sum(F.when(tdh <= float(h), 1).otherwise(0)).over(run).cast("long").alias(f"Txn_Count_Last_{h}H")
                   for h in GAP_COUNT_HOURS])
    return _finished(f)


def _frame_columns(w, key: str, tie: str) -> list:
    """What every frame takes from its earlier rows, in one Window operator on one sort."""
    roll = w.rowsBetween(-(ROLLING_ROWS - 1), 0)
    prev_us = F.lag("_us").over(w)
    range_w = Window.partitionBy(key, "_g").orderBy("_us").rangeBetween(-(VELOCITY_WINDOW_SECONDS * US - 1), -1)
    peer_w = Window.partitionBy(key, "_g", "_us").orderBy(tie)
    return [
        ((F.col("_us") - prev_us) / F.lit(1e6) / F.lit(3600.0)).alias("_gap_h"),
        ((F.col("_us") - prev_us) / F.lit(1e6) / F.lit(60.0)).alias("_gap_m"),
        F.lag(DEVICE).over(w).alias("_prev_device"),
        F.lag(LOCATION).over(w).alias("_prev_location"),
        F.avg(AMOUNT).over(roll).alias("Amount_Rolling_Mean_10"),
        F.coalesce(F.stddev_samp(AMOUNT).over(roll), F.lit(0.0)).alias("Amount_Rolling_Std_10"),
        # 10-minute count: earlier rows in (t - 10 min, t) plus same-time rows up to this one.
        (F.count(F.lit(1)).over(range_w) + F.row_number().over(peer_w)).cast("long").alias("Txn_Count_Last_10_Min"),
    ]


def _with_gaps(f: DataFrame) -> DataFrame:
    return f.withColumns({"Time_Diff_Hours": F.coalesce(F.col("_gap_h"), F.lit(FIRST_GAP_HOURS)),
                          "Time_Since_Last_Txn": F.coalesce(F.col("_gap_m"), F.lit(FIRST_GAP_MINUTES))})


def _rapid(tdh, w):
    roll = w.rowsBetween(-(ROLLING_ROWS - 1), 0)
    return F.sum(F.when(tdh <= RAPID_GAP_HOURS, 1).otherwise(0)).over(roll).cast("long").alias("Rapid_Txn_Count_Last_1H")


def _finished(f: DataFrame) -> DataFrame:
    """Columns that follow from the row and its predecessor; working columns are dropped."""
    out = f.withColumns({
        "Receiver_Frequency": F.col("_recv_n").cast("long"),
        # Unequal or missing (first row, null device) counts as a new device.
        "Is_New_Device": F.when(F.col(DEVICE) == F.col("_prev_device"), 0).otherwise(1),
        "Location_Distance_Km": geo.location_distance_km(F.col(LOCATION), F.col("_prev_location")),
        "prev_location": F.col("_prev_location"),
    })
    speed = geo.speed_kmh(F.col("Location_Distance_Km"), F.col("Time_Diff_Hours"))
    out = out.withColumns({
        "Is_First_Time_Receiver": F.when(F.col("Receiver_Frequency") == 1, 1).otherwise(0),
        "Is_Unusual_Location": geo.is_unusual_location(F.col("Location_Distance_Km"), F.col("Time_Diff_Hours")),
        "Location_Speed_Kmh": speed,
        "Is_High_Speed": geo.is_high_speed(speed),
    })
    return out.drop(*[c for c in out.columns if c.startswith("_") and c != "_avg_amount"])


def _bucketed_history(txn: DataFrame, bucketing: Bucketing, bucket_seconds: int, *, key: str, ts: str, tie: str, totals: bool,
                      point_in_time: bool) -> DataFrame:
    """History features over (sender, bucket) frames, for senders of any size."""
    carry = [c for c in txn.columns if c not in (key, tie)]
    counters = {f"{h}h": float(h) for h in GAP_COUNT_HOURS}
    tl = build_timeline(txn, key=key, ts=ts, tie=tie, carry=carry,
                        lookback_rows=ROLLING_ROWS, lookback_seconds=VELOCITY_WINDOW_SECONDS,
                        bucket_seconds=bucket_seconds, gap_counters=counters,
                        first_gap_hours=FIRST_GAP_HOURS, bucketing=bucketing,
                        sum_columns=(AMOUNT,) if point_in_time else ())
    w = tl.window()
    run = w.rowsBetween(UNBOUNDED, 0)
    own = F.col("_own")
    f = tl.frames.select("*", *_frame_columns(w, key, tie), F.sum(F.when(own, 1).otherwise(0)).over(run).alias("_local_n"))
    f = _with_gaps(f)
    # Sums of gap flags (they need the lag): same spec, same sort.
    tdh = F.col("Time_Diff_Hours")
    f = f.select(
        "*", _rapid(tdh, w),
        *[F.sum(F.when(own & (tdh <= float(h)), 1).otherwise(0)).over(run).alias(f"_local_{h}h")
          for h in GAP_COUNT_HOURS],
        *([F.sum(F.when(own, F.col(AMOUNT)).otherwise(0.0)).over(run).alias("_local_amt")]
          if point_in_time else []),
    )
    f = f.where(F.col("_own"))

    buckets = tl.buckets
    if totals and not point_in_time:
        buckets = buckets.join(sender_totals(txn, key), key, "left")
    poff = pair_offsets(txn, key=key, other=RECEIVER, ts=ts, bucket_seconds=bucket_seconds,
                        name="recv", bucketing=bucketing)
    if point_in_time:
        dpoff = pair_offsets(txn, key=key, other=DEVICE, ts=ts, bucket_seconds=bucket_seconds,
                             name="dev", bucketing=bucketing)
        buckets = (buckets.join(first_sighting_offsets(tl.buckets, poff, key=key, name="recv"), [key, "_g"], "left")
                   .join(first_sighting_offsets(tl.buckets, dpoff, key=key, name="dev"), [key, "_g"], "left"))
    f = f.join(buckets, [key, "_g"], "left")
    f = _pair_running_count(f, poff, key=key, tie=tie, other=RECEIVER, name="recv")
    if point_in_time:
        # First sightings: the pair's offset and its local count are both 0
        # before this row.  Their running sums (same frames, one more window
        # pass) plus earlier buckets' sightings give the distinct counts so far.
        f = _pair_running_count(f, dpoff, key=key, tie=tie, other=DEVICE, name="dev")
        first_recv = F.col("_recv_n") == 1
        first_dev = F.col("_dev_n") == 1
        own_run = w.rowsBetween(UNBOUNDED, 0)
        f = f.select("*",
                     F.sum(F.when(first_recv, 1).otherwise(0)).over(own_run).alias("_loc_rdiv"),
                     F.sum(F.when(first_dev, 1).otherwise(0)).over(own_run).alias("_loc_ddiv"))
        n_so_far = F.col("_cum") + F.col("_local_n")
        f = f.withColumns({
            "_avg_amount": (F.col(f"_offsum_{AMOUNT}") + F.col("_local_amt")) / n_so_far,
            "Device_Count": (F.col("_foff_dev") + F.col("_loc_ddiv")).cast("long"),
            "Receiver_Diversity": (F.col("_foff_recv") + F.col("_loc_rdiv")).cast("long")})

    return _finished(f.withColumns({
        "Txn_Count_Total": (F.col("_cum") + F.col("_local_n")).cast("long"),
        **{f"Txn_Count_Last_{h}H": (F.col(f"_off_{h}h") + F.col(f"_local_{h}h")).cast("long")
           for h in GAP_COUNT_HOURS}}))


def _pair_running_count(f: DataFrame, poff: DataFrame, *, key: str, tie: str, other: str,
                        name: str) -> DataFrame:
    """Running count per (sender, ``other``) over the whole history, as ``_<name>_n``.

    Each (sender, value, bucket) with earlier occurrences becomes one
    *offset marker* carrying that count.  Markers are hash-partitioned like
    the rows, (sender, bucket) into the session's shuffle partitions, so the
    union keeps the rows' partitioning.  A running sum over
    (sender, bucket, value) then starts at the offset: no row-level join.
    """
    n = int(f.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    markers = (poff.where(F.col(f"_poff_{name}") > 0)
               .select(key, "_g", other, F.col(f"_poff_{name}").alias("_wt"), F.lit(False).alias("_row"))
               .repartition(n, key, "_g"))
    rows = f.withColumns({"_wt": F.lit(1).cast("long"), "_row": F.lit(True)})
    u = rows.unionByName(markers, allowMissingColumns=True)
    w = (Window.partitionBy(key, "_g", other).orderBy(F.col("_row"), "_us", tie)
         .rowsBetween(UNBOUNDED, 0))
    return u.withColumn(f"_{name}_n", F.sum("_wt").over(w)).where(F.col("_row")).drop("_wt", "_row")


def row_features(df: DataFrame, amount_col: str = AMOUNT) -> DataFrame:
    """Per-row features: time of day, amount shape, id flags, one-hot types."""
    ts = F.col(TS)
    amt = F.col(amount_col)
    hour, dow = scalar.hour(ts), scalar.day_of_week(ts)
    hs, hc = scalar.cyclic(hour, 24)
    ds, dc = scalar.cyclic(dow, 7)
    out = df.withColumns({
        "Hour": hour, "Day_of_Week": dow,
        "Is_Weekend": scalar.is_weekend(dow), "Is_Night": scalar.is_night(hour),
        "Hour_Sin": hs, "Hour_Cos": hc, "Day_Sin": ds, "Day_Cos": dc,
        "Amount_Log": scalar.amount_log(amt),
        "Is_Small_Amount": scalar.is_small_amount(amt),
        "Is_Large_Amount": scalar.is_large_amount(amt),
        "Is_Unknown_Device": scalar.contains_flag(F.col(DEVICE), "Unknown"),
        "Is_Suspicious_Receiver": scalar.contains_flag(F.col(RECEIVER), "Suspicious"),
        "Is_Test_Receiver": scalar.contains_flag(F.col(RECEIVER), "Test"),
    })
    return one_hot_fixed(out)


def one_hot_fixed(df: DataFrame) -> DataFrame:
    """Fixed-vocabulary one-hot columns; values outside it give all zeros."""
    cols = [scalar.one_hot(F.col(TXN_TYPE), v).alias(f"Transaction_Type_{v}") for v in TXN_TYPES]
    cols += [scalar.one_hot(F.col(MERCHANT), v).alias(f"Merchant_Type_{v}") for v in MERCHANT_TYPES]
    return df.select("*", *cols)


def amount_stats(df: DataFrame, amount_col: str = AMOUNT) -> DataFrame:
    """Amount_Deviation and Amount_Ratio against the sender mean (``_avg_amount``)."""
    amt = F.col(amount_col)
    return df.withColumns({"Amount_Deviation": amt - F.col("_avg_amount"),
                           "Amount_Ratio": scalar.amount_ratio(amt, F.col("_avg_amount"))})


def fit_standardizer(train: DataFrame, col: str = AMOUNT) -> DataFrame:
    """Population mean and std of ``col`` on the training rows (one row)."""
    return train.agg(F.avg(col).alias("mean"), F.stddev_pop(col).alias("std"))


def standardize(df: DataFrame, stats: DataFrame, col: str = AMOUNT,
                out: str | None = None) -> DataFrame:
    """(x - mean) / std with fitted stats; std 0 -> divide by 1."""
    s = stats.select(F.col("mean").alias("_mu"), F.col("std").alias("_sd"))
    sd = F.when((F.col("_sd") == 0) | F.col("_sd").isNull(), F.lit(1.0)).otherwise(F.col("_sd"))
    return (attach_one_row(df, s)
            .withColumn(out or col, (F.col(col) - F.col("_mu")) / sd).drop("_mu", "_sd"))


def build_features(txn: DataFrame, *, amount_scale: str = "raw", scaler: DataFrame | None = None,
                   keep: list[str] | None = None, bucket_seconds: int = DAY_SECONDS,
                   point_in_time: bool = False) -> DataFrame:
    """The 44-feature matrix (plus ``keep`` columns), one row per transaction.

    ``amount_scale="raw"`` computes every amount feature on the raw amount and
    reports the raw amount; ``"standardized"`` standardizes the amount first
    (with ``scaler`` stats, fitted on ``txn`` when not given) and computes the
    amount features on the standardized value, as the coded reference does.
    ``point_in_time`` uses only each row's past for the sender mean, device
    count and receiver diversity (for training without look-ahead).
    """
    base = txn
    if amount_scale == "standardized":
        stats = scaler if scaler is not None else fit_standardizer(txn)
        base = standardize(txn, stats)
    hist = history_features(base, bucket_seconds=bucket_seconds, point_in_time=point_in_time)
    feats = amount_stats(row_features(hist)).withColumn("Amount", F.col(AMOUNT))
    types = dict(feats.dtypes)
    keep = keep if keep is not None else [TXN_ID, "is_fraud"]
    keep = [c for c in keep if c in feats.columns]

    def clean(c):
        # NaN and +/-inf -> 0 for floating features (one projection for all).
        if types[c] in ("double", "float"):
            return sanitize_numeric(F.col(c)).alias(c)
        return F.col(c)
    return select_features(feats.select(*keep, *[clean(c) for c in FEATURES]), keep=keep)


def trailing_velocity(txn: DataFrame, hours: tuple[int, ...] = (1, 6, 24), *, key: str = SENDER,
                      ts: str = TS, tie: str = TXN_ID, bucket_seconds: int = 7 * DAY_SECONDS,
                      hot_rows: int | None = HOT_ROWS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Transactions of the sender in the trailing ``h`` hours, current row
    included (``Velocity_{h}H``): true interval counts.

    Frames as in :func:`history_features`; a hot sender's halo holds the rows
    of the widest interval before each bucket, so buckets are wider (a week by
    default) to keep the halo a small share of the data.
    """
    width = max(hours) * 3600
    base = txn.select(key, tie, ts)

    def counted(f: DataFrame) -> DataFrame:
        f = f.withColumn("_peer", F.row_number().over(Window.partitionBy(key, "_g", "_us").orderBy(tie)))
        for h in hours:
            rw = Window.partitionBy(key, "_g").orderBy("_us").rangeBetween(-(h * 3600 * US - 1), -1)
            f = f.withColumn(f"Velocity_{h}H", (F.count(F.lit(1)).over(rw) + F.col("_peer")).cast("long"))
        return f

    out = [key, tie, ts, *[f"Velocity_{h}H" for h in hours]]
    bucketing = plan_buckets(base, key=key, ts=ts, default_seconds=max(bucket_seconds, width),
                             min_seconds=width, hot_rows=hot_rows, target_rows=target_rows)
    cold, hot = (None, base) if hot_rows is None else split_hot(base, bucketing)
    whole = None if cold is None else counted(_one_frame(cold, ts)).select(*out)
    if hot is None:
        return whole
    tl = build_timeline(hot, key=key, ts=ts, tie=tie, carry=[ts],
                        lookback_rows=1, lookback_seconds=width,
                        bucket_seconds=max(bucket_seconds, width), bucketing=bucketing)
    cut = counted(tl.frames).where(F.col("_own")).select(*out)
    return cut if whole is None else whole.unionByName(cut)


def running_distinct(txn: DataFrame, other: str, out: str, *, key: str = SENDER, ts: str = TS,
                     tie: str = TXN_ID, bucket_seconds: int = DAY_SECONDS,
                     hot_rows: int | None = HOT_ROWS, target_rows: int = TARGET_ROWS) -> DataFrame:
    """Distinct values of ``other`` seen by the sender up to each row
    (point-in-time form of Device_Count / Receiver_Diversity).

    For a hot sender each (sender, value) pair's first row comes from a partial aggregate (a
    *marker*).  Markers are unioned into the sender's (sender, bucket) frames
    and sorted just before the row they mark, so the distinct count so far is
    a running sum of markers plus the markers of earlier buckets (a small
    per-bucket prefix table).  One exchange of the rows; no row-level join.
    """
    bucketing = plan_buckets(txn, key=key, ts=ts, default_seconds=bucket_seconds, min_seconds=60,
                             hot_rows=hot_rows, target_rows=target_rows)
    base = txn.select(key, tie, ts, other)
    cold, hot = (None, base) if hot_rows is None else split_hot(base, bucketing)
    whole = None
    if cold is not None:  # first sightings, summed along the sender's frame
        f = _sightings(_one_frame(cold, ts), other, key, tie, "_n")
        run = Window.partitionBy(key, "_g").orderBy("_us", tie).rowsBetween(UNBOUNDED, 0)
        whole = f.select(key, tie, ts, F.sum(F.when(F.col("_n") == 1, 1).otherwise(0)).over(run).cast("long").alias(out))
    if hot is None:
        return whole
    d = bucketing.apply(hot)
    firsts = (d.groupBy(key, other).agg(F.min(F.struct("_us", tie, "_b")).alias("_f"))
              .select(key, F.col("_f._b").alias("_b"), F.col("_f._us").alias("_us"),
                      F.col(f"_f.{tie}").alias(tie)))
    rows = d.select(key, "_b", "_us", tie, ts, F.lit(0).alias("_m"), F.lit(True).alias("_own"))
    markers = firsts.select(key, "_b", "_us", tie, F.lit(None).cast(d.schema[ts].dataType).alias(ts),
                            F.lit(1).alias("_m"), F.lit(False).alias("_own"))
    w = Window.partitionBy(key, "_b").orderBy("_us", tie, "_own").rowsBetween(UNBOUNDED, 0)
    local = rows.unionByName(markers).withColumn("_loc", F.sum("_m").over(w)).where(F.col("_own"))
    # Markers in earlier buckets, for every bucket that has rows.
    per_bucket = firsts.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_new"))
    all_b = d.groupBy(key, "_b").agg(F.lit(0).alias("_z"))
    wg = Window.partitionBy(key).orderBy("_b").rowsBetween(UNBOUNDED, -1)
    boff = (all_b.join(per_bucket, [key, "_b"], "left")
            .select(key, "_b", F.coalesce(F.sum(F.coalesce(F.col("_new"), F.lit(0))).over(wg), F.lit(0))
                    .alias("_boff")))
    f = local.join(boff, [key, "_b"], "left")
    cut = f.select(key, tie, ts, (F.coalesce(F.col("_boff"), F.lit(0)) + F.col("_loc")).cast("long").alias(out))
    return cut if whole is None else whole.unionByName(cut)
