"""Model evaluation tables from a (label, score) DataFrame.

Everything is computed from aggregates: conditional counts in one pass
(map-side combined) for fixed thresholds, or counts per distinct score for
curves and AUC.  The per-score table may be as long as the input: it is cut
into score ranges, summed inside each range, and offset by the totals of the
ranges before (at most ``RANGES`` + 1 rows).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.session import materialize

# Score ranges of the running sums, and how far their sizes may differ
# (a share of the distinct scores).
RANGES = 256
RANGE_ERROR = 0.001

# Thresholds of the sweep and the fallback threshold.
SWEEP_THRESHOLDS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
DEFAULT_BEST_THRESHOLD = 0.3


def _label(label: str) -> Column:
    return F.col(label) == 1


def _safe_div(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _f1(p: Column, r: Column) -> Column:
    return F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0))


def accuracy(df: DataFrame, label: str = "is_fraud", pred: str = "pred") -> DataFrame:
    return df.agg(F.avg(F.when(F.col(label) == F.col(pred), 1.0).otherwise(0.0)).alias("accuracy"),
                  F.count(F.lit(1)).cast("long").alias("n"))


def confusion_counts(df: DataFrame, label: str = "is_fraud", pred: str = "pred") -> DataFrame:
    """One row: tn, fp, fn, tp."""
    y, p = _label(label), F.col(pred) == 1
    return df.agg(*[F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n) for n, c in
                    [("tn", ~y & ~p), ("fp", ~y & p), ("fn", y & ~p), ("tp", y & p)]])


def confusion_matrix(df: DataFrame, label: str = "is_fraud", pred: str = "pred") -> DataFrame:
    """All four (actual, predicted) cells, empty cells as 0."""
    c = confusion_counts(df, label, pred)
    cells = F.array(*[F.struct(F.lit(a).alias("actual"), F.lit(b).alias("predicted"),
                               F.coalesce(F.col(n), F.lit(0)).alias("n"))
                      for a, b, n in [(0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp")]])
    return c.select(F.inline(cells))


def classification_report(df: DataFrame, label: str = "is_fraud", pred: str = "pred") -> DataFrame:
    """Per class precision/recall/F1/support, accuracy, macro and weighted means."""
    c = confusion_counts(df, label, pred)
    tn, fp, fn, tp = (F.coalesce(F.col(x), F.lit(0)) for x in ("tn", "fp", "fn", "tp"))
    n = tn + fp + fn + tp
    p1, r1 = _safe_div(tp, tp + fp), _safe_div(tp, tp + fn)
    p0, r0 = _safe_div(tn, tn + fn), _safe_div(tn, tn + fp)
    f0, f1 = _f1(p0, r0), _f1(p1, r1)
    s0, s1 = tn + fp, tp + fn

    def row(name, p, r, f, s):
        return F.struct(F.lit(name).alias("class"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))

    acc = _safe_div(tn + tp, n)
    rows = F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("accuracy", F.lit(None).cast("double"), F.lit(None).cast("double"), acc, n),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, n),
        row("weighted avg", _safe_div(p0 * s0 + p1 * s1, n), _safe_div(r0 * s0 + r1 * s1, n),
            _safe_div(f0 * s0 + f1 * s1, n), n))
    return c.select(F.inline(rows))


def score_counts(df: DataFrame, label: str = "is_fraud", score: str = "score") -> DataFrame:
    """Positives and negatives per distinct score (partial aggregate)."""
    y = _label(label)
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.sum(F.when(y, 1).otherwise(0)).cast("long").alias("pos"),
        F.sum(F.when(y, 0).otherwise(1)).cast("long").alias("neg"))


def _range_of(score: Column, cuts: list[float]) -> Column:
    """How many of the sorted ``cuts`` are at or below the score: a binary search in plain expressions."""
    if not cuts:
        return F.lit(0)
    middle = len(cuts) // 2
    low, high = cuts[:middle], cuts[middle + 1:]
    below = _range_of(score, low) if low else F.lit(0)
    above = _range_of(score, high) + (middle + 1) if high else F.lit(middle + 1)
    return F.when(score >= cuts[middle], above).otherwise(below)


def _running(df: DataFrame, label: str, score: str) -> DataFrame:
    """Per distinct score, exact: positives and negatives at or above it
    (``tp``, ``fp``), below it (``neg_below``), and in all (``P``, ``N``)."""
    sc = materialize(score_counts(df, label, score))  # read for the cuts, the totals and the sums
    shares = [k / RANGES for k in range(1, RANGES)]
    cuts = sorted(set(sc.approxQuantile("score", shares, RANGE_ERROR)))
    # The range is a function of the score alone, so a lost task recomputes the
    # same one.  Two levels of a sixteenth each keep the expression small.
    coarse, fine = cuts[15::16], [cuts[i:i + 15] for i in range(0, len(cuts), 16)]
    sc = sc.withColumn("coarse", _range_of(F.col("score"), coarse))
    inner = F.lit(0)
    for k, part in enumerate(fine):
        inner = F.when(F.col("coarse") == k, _range_of(F.col("score"), part)).otherwise(inner)
    sc = sc.withColumn("range", F.col("coarse") * 16 + inner).drop("coarse")
    totals = sc.groupBy("range").agg(F.sum("pos").alias("rp"), F.sum("neg").alias("rn"))
    above = Window.partitionBy(F.lit(1)).orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(1))
    offsets = totals.select("range", F.coalesce(F.sum("rp").over(above), F.lit(0)).alias("op"),
                            F.coalesce(F.sum("rn").over(above), F.lit(0)).alias("on"),
                            F.sum("rp").over(whole).alias("P"), F.sum("rn").over(whole).alias("N"))
    w = Window.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return (sc.join(F.broadcast(offsets), "range")  # a row per range
            .withColumn("tp", F.sum("pos").over(w) + F.col("op")).withColumn("fp", F.sum("neg").over(w) + F.col("on"))
            .withColumn("neg_below", F.col("N") - F.col("fp")).drop("range", "op", "on"))


def roc_auc(df: DataFrame, label: str = "is_fraud", score: str = "score") -> DataFrame:
    """Area under the ROC curve by rank sums with tied scores counted half."""
    return _running(df, label, score).agg((F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") * 0.5))
                                           / (F.sum("pos") * F.sum("neg"))).alias("roc_auc"))


def _with_point(curve: DataFrame, **values: float) -> DataFrame:
    """``curve`` and one point without a threshold, if the curve has any."""
    there = curve.agg(F.count(F.lit(1)).alias("n")).where("n > 0")
    return curve.unionByName(there.select(F.lit(None).cast("double").alias("threshold"), *[F.lit(v).alias(k) for k, v in values.items()]))


def roc_curve(df: DataFrame, label: str = "is_fraud", score: str = "score") -> DataFrame:
    """(threshold, fpr, tpr) for every distinct score, all points kept, and the
    starting point (0, 0) above every score, whose threshold is null."""
    t = _running(df, label, score)
    t = t.select(F.col("score").alias("threshold"), _safe_div(F.col("fp"), F.col("N")).alias("fpr"),
                 _safe_div(F.col("tp"), F.col("P")).alias("tpr"))
    return _with_point(t, fpr=0.0, tpr=0.0)


def pr_curve(df: DataFrame, label: str = "is_fraud", score: str = "score") -> DataFrame:
    """(threshold, precision, recall) for every distinct score, and the end
    point (precision 1, recall 0), whose threshold is null."""
    t = _running(df, label, score)
    t = t.select(F.col("score").alias("threshold"),
                 (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
                 _safe_div(F.col("tp"), F.col("P")).alias("recall"))
    return _with_point(t, precision=1.0, recall=0.0)


def threshold_sweep(df: DataFrame, label: str = "is_fraud", score: str = "score",
                    thresholds: list[float] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1 at each threshold (one aggregation pass)."""
    thresholds = thresholds or SWEEP_THRESHOLDS
    y = _label(label)
    s = F.col(score)
    aggs = [F.count(F.lit(1)).cast("long").alias("n"), F.sum(F.when(y, 1).otherwise(0)).cast("long").alias("P")]
    for i, t in enumerate(thresholds):
        aggs.append(F.sum(F.when(y & (s >= t), 1).otherwise(0)).cast("long").alias(f"tp{i}"))
        aggs.append(F.sum(F.when(s >= t, 1).otherwise(0)).cast("long").alias(f"pp{i}"))
    c = df.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"),
                              F.col(f"pp{i}").alias("pp")) for i, t in enumerate(thresholds)])
    r = c.select("n", "P", F.inline(rows))
    tn = F.col("n") - F.col("pp") - (F.col("P") - F.col("tp"))
    prec = _safe_div(F.col("tp"), F.col("pp"))
    rec = _safe_div(F.col("tp"), F.col("P"))
    return r.select("threshold", ((F.col("tp") + tn) / F.col("n")).alias("accuracy"),
                    prec.alias("precision"), rec.alias("recall")) \
        .withColumn("f1", _f1(F.col("precision"), F.col("recall")))


def best_threshold(sweep: DataFrame, default: float = DEFAULT_BEST_THRESHOLD) -> DataFrame:
    """Threshold with the highest F1 (first listed wins); default when all F1 are 0."""
    best = sweep.agg(F.max_by(F.struct("threshold", "f1"),
                              F.struct(F.col("f1"), -F.col("threshold"))).alias("b"))
    return best.select(F.when(F.col("b.f1") > 0, F.col("b.threshold")).otherwise(F.lit(default))
                       .alias("best_threshold"),
                       F.greatest(F.col("b.f1"), F.lit(0.0)).alias("best_f1"))
