"""Distances on the sphere and the grid join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RADIUS_KM = 6371.0


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle km; the root's argument is held to 1."""
    a, b, c, d = (F.radians(x if isinstance(x, Column) else F.col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * RADIUS_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def grid_join(left: DataFrame, right: DataFrame, km: float) -> DataFrame:
    """Pairs (left row `l`, right row `r`, `km`) within ``km``; both tables have lat and lon.

    Latitude is cut into bands of ``km``; in each band longitude is cut into cells that are ``km`` wide at the band's
    widest neighbour. A left row meets the nine cells around it, so the join is an equi-join and nothing is compared
    with everything. Rows without a position meet nothing; pairs across the date line are not found.
    """
    step = km / 110.57
    band = F.floor(F.col("lat") / step)

    def width(b: Column) -> Column:
        far = F.least(F.lit(89.0), (F.greatest(F.abs(b), F.abs(b + 1))) * step)
        return km / (111.19 * F.cos(F.radians(far))) * 1.01

    placed = right.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.struct("*").alias("r"), band.alias("_band"), F.floor(F.col("lon") / width(band)).alias("_cell")
    )
    bands = left.where("lat IS NOT NULL AND lon IS NOT NULL").select(
        F.struct("*").alias("l"), F.col("lon").alias("_lon"), F.explode(F.sequence(band - 1, band + 1)).alias("_band")
    )
    around = bands.withColumn("_own", F.floor(F.col("_lon") / width(F.col("_band"))))
    asked = around.select("l", "_band", F.explode(F.sequence(F.col("_own") - 1, F.col("_own") + 1)).alias("_cell"))
    met = asked.join(placed, ["_band", "_cell"])
    return met.select("l", "r", haversine("l.lat", "l.lon", "r.lat", "r.lon").alias("km")).where(F.col("km") <= km)
