"""Connected components over an edge table, by star contraction.

Every round is a few joins and grouped minima, so no node's edges meet in one
place and nothing reaches the driver but two numbers per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from txnrisk.session import materialize


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
    return row.n, row.s


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """``edges`` (u, v longs) -> (node, component): the smallest node reachable.

    Only nodes with an edge appear.  Null ends and self-loops are ignored.
    Alternates "large star" (hang larger neighbours on the smallest one) and
    "small star" (hang smaller neighbours on the smallest one) until nothing
    changes; then every node hangs directly on its component's minimum.
    """
    cur = (edges.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
           .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    cur = materialize(cur)
    before = _state(cur)
    for _ in range(max_rounds):
        if not before[0]:
            break
        both = cur.unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(least, "u").where("v <> m")
                 .select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        cur = materialize(small)
        now = _state(cur)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return (cur.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))
