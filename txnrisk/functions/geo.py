"""Location parsing and great-circle distance as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from txnrisk.schema import (EARTH_RADIUS_KM, HIGH_SPEED_KMH, MISSING_DISTANCE_KM,
                            UNUSUAL_DISTANCE_KM, UNUSUAL_GAP_HOURS, ZERO_GAP_HOURS)


def parse_location(loc: Column) -> Column:
    """``"lat, lon"`` -> struct<lat, lon>; null unless exactly two numeric parts."""
    parts = F.split(loc, ",")
    p0 = F.trim(F.get(parts, 0)).try_cast("double")
    p1 = F.trim(F.get(parts, 1)).try_cast("double")
    ok = (F.size(parts) == 2) & p0.isNotNull() & p1.isNotNull()
    return F.when(ok, F.struct(p0.alias("lat"), p1.alias("lon")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km (R = 6371); the asin argument is clamped to 1."""
    dlat = F.radians(lat2 - lat1)
    dlon = F.radians(lon2 - lon1)
    s_lat = F.sin(dlat / 2)
    s_lon = F.sin(dlon / 2)
    a = s_lat * s_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * s_lon * s_lon
    root = F.sqrt(a)
    # Clamp rounding overshoot at antipodes; null stays null (least() would skip it).
    clamped = F.when(root > 1.0, F.lit(1.0)).otherwise(root)
    return F.lit(EARTH_RADIUS_KM) * (2 * F.asin(clamped))


def location_distance_km(loc: Column, prev_loc: Column) -> Column:
    """Distance between two location strings; missing or malformed -> 10000."""
    p, q = parse_location(loc), parse_location(prev_loc)
    d = haversine_km(p["lat"], p["lon"], q["lat"], q["lon"])
    return F.coalesce(d, F.lit(MISSING_DISTANCE_KM))


def is_unusual_location(distance_km: Column, gap_hours: Column) -> Column:
    return F.when((distance_km > UNUSUAL_DISTANCE_KM) & (gap_hours < UNUSUAL_GAP_HOURS), 1).otherwise(0)


def speed_kmh(distance_km: Column, gap_hours: Column) -> Column:
    return distance_km / F.when(gap_hours == 0, F.lit(ZERO_GAP_HOURS)).otherwise(gap_hours)


def is_high_speed(speed: Column) -> Column:
    return F.when(speed > HIGH_SPEED_KMH, 1).otherwise(0)
