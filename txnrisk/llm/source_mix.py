"""Mixing sources to target weights by Poisson replication.

A source with weight w of the mix and n of N documents has the mean repetition
rate w * N / n.  A document's count is that Poisson distribution's inverse at
a uniform draw hashed from its id and the seed, so a rerun repeats it exactly
and no draw depends on how rows are dealt.  Rates above ``MAX_STEP`` are drawn
as sums of independent smaller ones.  Documents are exploded by their counts
and dealt out by a hash of (id, copy), in whose order each partition lies.

Defined cases: a null source is a source of its own; without weights the
target is the square root of each source's size; a source missing from the
weights gets 0 and its documents go; null text is an ordinary row; rows with a
null doc_id share one draw, as rows repeated under one doc_id do; an empty
table gives an empty mix; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

MAX_STEP = 256.0
HEX_DIGITS = 13  # 52 bits


def uniform(key: Column, seed: int, step: Column) -> Column:
    """A draw in [0, 1) from the text of ``key``, the seed and a step."""
    text = F.concat_ws("|", F.coalesce(key.cast("string"), F.lit("null")), F.lit(str(seed)), step.cast("string"))
    return F.conv(F.substring(F.sha2(text, 256), 1, HEX_DIGITS), 16, 10).cast("long") / F.lit(float(16**HEX_DIGITS))


def cumulative(rate: Column) -> Column:
    """P(count <= j) for j = 0, 1, ... as far as doubles tell it from 1."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), last), start, lambda s, j: F.struct(
        (s["p"] * rate / j).alias("p"),
        F.concat(s["c"], F.array(F.element_at(s["c"], -1) + s["p"] * rate / j)).alias("c")), lambda s: s["c"])


def source_rates(docs: DataFrame, weights: dict | None = None, source_col: str = "source") -> DataFrame:
    """(no_source, name, step_rate, steps): one row per source."""
    sizes = docs.groupBy(F.col(source_col).isNull().alias("no_source"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("name")).agg(
        F.count(F.lit(1)).alias("n"))
    if weights is None:
        sizes = sizes.withColumn("w", F.sqrt("n"))
    else:
        rows = [(k is None, "" if k is None else str(k), float(v)) for k, v in weights.items()]
        given = docs.sparkSession.createDataFrame(rows, "no_source boolean, name string, w double")
        sizes = sizes.join(given, ["no_source", "name"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    total = sizes.agg(F.sum("n").alias("all_n"), F.sum("w").alias("all_w")).first()
    n, w = float(total.all_n or 0), float(total.all_w or 0)
    rate = F.lit(n / w if w else 0.0) * F.col("w") / F.col("n")
    steps = F.greatest(F.ceil(rate / MAX_STEP), F.lit(1)).cast("int")
    return sizes.select("no_source", "name", (rate / steps).alias("step_rate"), steps.alias("steps"))


def mix_sources(docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source",
                seed: int = 2024) -> DataFrame:
    """``docs`` repeated to the target weights, plus __copy (from 0) and
    __order (the shuffle key)."""
    rates = source_rates(docs, weights, source_col).withColumn("__cdf", cumulative(F.col("step_rate")))
    rates = rates.select(F.col("no_source").alias("__none"), F.col("name").alias("__name"), F.col("steps").alias("__steps"), "__cdf")
    key = [docs[source_col].isNull() == F.col("__none"), F.coalesce(docs[source_col].cast("string"), F.lit("")) == F.col("__name")]
    draws = F.transform(F.sequence(F.lit(0), F.col("__steps") - 1), lambda step: uniform(F.col(id_col), seed, step))
    drawn = F.aggregate(draws, F.lit(0), lambda total, u: total + F.size(F.filter("__cdf", lambda c: c <= u)))
    own = docs.columns
    count = docs.join(rates, key).withColumn("__n", drawn).where("__n > 0")
    copies = count.withColumn("__copy", F.explode(F.sequence(F.lit(0), F.col("__n") - 1)))
    mixed = copies.select(*own, "__copy", F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("null")), "__copy", F.lit(seed)).alias("__order"))
    return mixed.repartition("__order").sortWithinPartitions("__order", id_col, "__copy")
