"""Row-level feature expressions (time of day, amount shape, id flags)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrisk.schema import LARGE_AMOUNT, SMALL_AMOUNT, ZERO_MEAN_DIVISOR


def hour(ts: Column) -> Column:
    return F.hour(ts)


def day_of_week(ts: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(ts)


def is_weekend(dow: Column) -> Column:
    return F.when(dow >= 5, 1).otherwise(0)


def is_night(h: Column) -> Column:
    return F.when((h >= 22) | (h <= 5), 1).otherwise(0)


def cyclic(value: Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * value / F.lit(float(period))
    return F.sin(angle), F.cos(angle)


def amount_log(amount: Column) -> Column:
    return F.log1p(amount)


def amount_ratio(amount: Column, mean: Column) -> Column:
    return amount / F.when(mean == 0, F.lit(ZERO_MEAN_DIVISOR)).otherwise(mean)


def is_small_amount(amount: Column) -> Column:
    return F.when(amount <= SMALL_AMOUNT, 1).otherwise(0)


def is_large_amount(amount: Column) -> Column:
    return F.when(amount >= LARGE_AMOUNT, 1).otherwise(0)


def contains_flag(s: Column, needle: str) -> Column:
    """1 when ``s`` contains ``needle`` (case-sensitive), else 0 (null -> 0)."""
    return F.when(F.coalesce(s.contains(needle), F.lit(False)), 1).otherwise(0)


def one_hot(c: Column, value: str) -> Column:
    return F.when(F.coalesce(c == value, F.lit(False)), 1).otherwise(0)
