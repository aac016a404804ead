"""Heuristic 0-100 risk meters for card and UPI payment forms."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points of the client-side meters.
CARD_TEST_NUMBER, CARD_TEST_POINTS = "4242", 10
CARD_LENGTH_RANGE, CARD_LENGTH_POINTS = (16, 19), 20
CARD_REPEAT_POINTS = 30
CARD_REPEAT_PATTERN = "|".join(f"{d}{{6,}}" for d in range(10))  # six equal digits
CVV_WEAK = ("123", "000")
CVV_WEAK_POINTS = 15
EXPIRED_POINTS = 25
HIGH_AMOUNT, HIGH_AMOUNT_POINTS = 5000.0, 20
UPI_NO_AT_POINTS, UPI_SUSPICIOUS, UPI_SUSPICIOUS_POINTS = 30, "suspicious", 50
MAX_SCORE = 100


def _pts(cond: Column, points: int) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), F.lit(points)).otherwise(F.lit(0))


def expiry_year(expiry: Column) -> Column:
    """The number after the first ``/``; empty text counts as 0, junk as null."""
    part = F.trim(F.get(F.split(expiry, "/"), 1))
    return F.when(part == "", F.lit(0.0)).otherwise(part.try_cast("double"))


def card_risk_score(card: Column, cvv: Column, expiry: Column, amount: Column,
                    as_of: _dt.date) -> Column:
    card = F.coalesce(card, F.lit(""))
    cvv = F.coalesce(cvv, F.lit(""))
    expiry = F.coalesce(expiry, F.lit(""))
    has_card = F.length(card) > 0
    lo, hi = CARD_LENGTH_RANGE
    score = (_pts(has_card & card.contains(CARD_TEST_NUMBER), CARD_TEST_POINTS)
             + _pts(has_card & ((F.length(card) < lo) | (F.length(card) > hi)), CARD_LENGTH_POINTS)
             + _pts(has_card & card.rlike(CARD_REPEAT_PATTERN), CARD_REPEAT_POINTS)
             + _pts((F.length(cvv) > 0) & cvv.isin(*CVV_WEAK), CVV_WEAK_POINTS)
             + _pts((F.length(expiry) > 0) & (expiry_year(expiry) < as_of.year % 100), EXPIRED_POINTS)
             + _pts(amount > HIGH_AMOUNT, HIGH_AMOUNT_POINTS))
    return F.least(score, F.lit(MAX_SCORE))


def upi_risk_score(upi: Column, amount: Column) -> Column:
    upi = F.coalesce(upi, F.lit(""))
    has = F.length(upi) > 0
    score = (_pts(has & ~upi.contains("@"), UPI_NO_AT_POINTS)
             + _pts(has & upi.contains(UPI_SUSPICIOUS), UPI_SUSPICIOUS_POINTS)
             + _pts(amount > HIGH_AMOUNT, HIGH_AMOUNT_POINTS))
    return F.least(score, F.lit(MAX_SCORE))
