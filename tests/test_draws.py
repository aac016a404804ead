"""Draws per key and seed: independent, full range, any kind of key."""

import pytest
from pyspark.sql import functions as F

from txnrisk.operators import inject, ml

N = 100_000
KEYS = {"negative": "-id", "large": "id + 1000000000000000000", "text": "concat('T-', id)"}


def test_draws_of_different_seeds_are_uncorrelated(spark):
    seeds = [11, 1011, 2011, 3011]
    draws = spark.range(N).select(*[inject.unit_hash(F.col("id"), s).alias(f"u{s}") for s in seeds])
    pairs = [(a, b) for i, a in enumerate(seeds) for b in seeds[i + 1:]]
    row = draws.agg(*[F.corr(f"u{a}", f"u{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    assert all(abs(c) < 0.05 for c in row)


@pytest.mark.parametrize("kind", KEYS)
def test_split_share_per_class_for_any_key(spark, kind):
    rows = spark.range(N).select(F.expr(KEYS[kind]).alias("txn_id"), (F.col("id") % 2).alias("is_fraud"))
    shares = ml.hash_split(rows, 0.2, 42).groupBy("is_fraud").agg(F.avg((F.col("split") == "test").cast("int")).alias("share")).collect()
    assert len(shares) == 2 and all(abs(r.share - 0.2) < 0.01 for r in shares)


def test_pattern_amounts_cover_their_range(spark):
    rows = spark.range(N).select((-F.col("id")).alias("txn_id"), F.lit(0).alias("is_fraud"), F.lit(1.0).alias("amount"),
                                 *[F.lit("x").alias(c) for c in ("txn_type", "merchant_type", "device_id", "receiver_id", "location")])
    got = {r.pattern: r for r in inject.inject_nine_patterns(rows, ratio=0.2, seed=11).where("pattern IS NOT NULL")
           .groupBy("pattern").agg(F.min("amount").alias("lo"), F.max("amount").alias("hi"), F.count("*").alias("n")).collect()}
    for name, lo, hi, *_ in inject.NINE_PATTERNS:
        assert got[name].hi - got[name].lo >= 0.95 * (hi - lo)
    assert abs(sum(r.n for r in got.values()) / N - 0.2) < 0.01
