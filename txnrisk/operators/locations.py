"""Base-city lookup for location strings.

The eight cities are a fixed literal array, so the lookup is a per-row array
expression (distance to each city, smallest first) - no join, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import geo
from txnrisk.schema import CITIES


def nearest_city(df: DataFrame, location: str = "location", keep_all: bool = True) -> DataFrame:
    """Add ``city``, ``distance_km`` (great-circle, km) and ``_city_pos``.

    Ties go to the first listed city.  Unparseable locations get null city
    and distance.  The location is parsed once; the eight distances are plain
    column expressions (no lambda), so the whole lookup stays in codegen.
    """
    p = geo.parse_location(F.col(location))
    out = df.withColumn("_loc", p)
    lat, lon = F.col("_loc.lat"), F.col("_loc.lon")
    cands = [F.struct(geo.haversine_km(lat, lon, F.lit(clat), F.lit(clon)).alias("d"),
                      F.lit(i).alias("pos"), F.lit(name).alias("name"))
             for i, (name, clat, clon) in enumerate(CITIES)]
    out = out.withColumn("_best", F.when(F.col("_loc").isNotNull(), F.array_min(F.array(*cands))))
    return (out.withColumn("city", F.col("_best.name")).withColumn("distance_km", F.col("_best.d"))
            .withColumn("_city_pos", F.coalesce(F.col("_best.pos"), F.lit(0))).drop("_best", "_loc"))
