"""Radius search over a grid, radii and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import half_up, haversine_km

#: Degrees of a grid cell, metres of a degree in the search box, radius bounds in km.
CELL, METRES_A_DEGREE, LEAST_KM, MOST_KM, DEFAULT_KM = 0.02, 111_320.0, 2.0, 12.0, 8.0


def market_radius(markets: DataFrame) -> DataFrame:
    """Adds radius_km: half the larger side of the bounding box (south, north, west, east), 2 to 12; 8 without a box."""
    mid_lat, mid_lon = (F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2
    tall = haversine_km(F.col("south"), mid_lon, F.col("north"), mid_lon)
    wide = haversine_km(mid_lat, F.col("west"), mid_lat, F.col("east"))
    r = F.greatest(tall, wide) / 2
    return markets.withColumn("radius_km", F.when(r.isNull(), F.lit(DEFAULT_KM)).otherwise(half_up(F.greatest(F.lit(LEAST_KM), F.least(F.lit(MOST_KM), r)), 1)))


def with_cells(points: DataFrame) -> DataFrame:
    return points.withColumn("cell_row", F.floor(F.col("lat") / CELL).cast("int")).withColumn("cell_col", F.floor(F.col("lon") / CELL).cast("int"))


def radius_join(markets: DataFrame, points: DataFrame, pad_cells: int = 0) -> DataFrame:
    """Points within radius_km of a market's centre (lat, lon), inclusive, with distance_km.

    Each market is exploded to the grid cells of its box and meets points by an equi-join on the cell, so a dense city
    spreads over many keys. pad_cells=1 also finds points beyond the box, which is a little smaller than the circle.
    """
    d_lat = F.col("radius_km") * 1000 / METRES_A_DEGREE
    d_lon = d_lat / F.greatest(F.lit(1e-6), F.cos(F.radians("lat")))
    cells = lambda c, d: F.sequence(F.floor((F.col(c) - d) / CELL).cast("int") - pad_cells, F.floor((F.col(c) + d) / CELL).cast("int") + pad_cells)
    m = markets.select("market_id", F.col("lat").alias("m_lat"), F.col("lon").alias("m_lon"), "radius_km", cells("lat", d_lat).alias("rows"), cells("lon", d_lon).alias("cols"))
    m = m.withColumn("cell_row", F.explode("rows")).withColumn("cell_col", F.explode("cols")).drop("rows", "cols")
    near = m.join(with_cells(points), ["cell_row", "cell_col"])
    near = near.withColumn("distance_km", haversine_km(F.col("m_lat"), F.col("m_lon"), F.col("lat"), F.col("lon")))
    return near.where("distance_km <= radius_km").drop("m_lat", "m_lon", "cell_row", "cell_col", "radius_km")


def tagged_in_radius(markets: DataFrame, points: DataFrame, pairs: DataFrame, pad_cells: int = 0) -> DataFrame:
    """radius_join of the named points whose tags (map) hold one of their market's (key, value) pairs; a point comes once a market.

    pairs: market_id, key, value, as few as a business type has tags.
    """
    wanted = pairs.groupBy("market_id").agg(F.collect_set(F.struct("key", "value")).alias("_pairs"))
    named = points.where(F.coalesce(F.try_element_at("tags", F.lit("name")), F.lit("")) != "")
    near = radius_join(markets, named, pad_cells).join(wanted, "market_id")
    return near.where(F.exists("_pairs", lambda p: F.coalesce(F.try_element_at("tags", p["key"]) == p["value"], F.lit(False)))).drop("_pairs")


def box_covers(markets: DataFrame) -> DataFrame:
    """Adds covered: the whole circle's box lies in the region's box (r_south, r_north, r_west, r_east)."""
    d_lat = F.col("radius_km") * 1000 / METRES_A_DEGREE
    d_lon = d_lat / F.greatest(F.lit(1e-6), F.cos(F.radians("lat")))
    inside = (F.col("lat") - d_lat >= F.col("r_south")) & (F.col("lat") + d_lat <= F.col("r_north")) & (F.col("lon") - d_lon >= F.col("r_west")) & (F.col("lon") + d_lon <= F.col("r_east"))
    return markets.withColumn("covered", inside)


def narrowed_radius(found: DataFrame, most: int = 500) -> DataFrame:
    """Per market the radius at which fewer than ``most`` are found: r, then half, then a quarter (2 km at least), else limited.

    found: market_id, radius_km, distance_km. All three counts come from one pass.
    """
    half = F.greatest(F.lit(LEAST_KM), half_up(F.col("radius_km") / 2, 1))
    quarter = F.greatest(F.lit(LEAST_KM), half_up(half / 2, 1))
    g = found.groupBy("market_id", "radius_km").agg(F.count("*").alias("n0"), F.count_if(F.col("distance_km") <= half).alias("n1"), F.count_if(F.col("distance_km") <= quarter).alias("n2"))
    used = F.when(F.col("n0") < most, F.col("radius_km")).when(F.col("n1") < most, half).otherwise(quarter)
    return g.select("market_id", used.alias("used_km"), ((F.col("n0") >= most) & (F.col("n1") >= most) & (F.col("n2") >= most)).alias("limited"))
