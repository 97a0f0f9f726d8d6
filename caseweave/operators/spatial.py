"""Hexagonal hot cells and the exact radius join."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geo


def with_cell(df: DataFrame, lat: str, lon: str, resolution: int = 8, name: str = "cell") -> DataFrame:
    return df.withColumn(name, geo.hex_cell(lat, lon, resolution))


def hotspots(df: DataFrame, lat: str, lon: str, resolution: int = 8, where: Column | None = None) -> DataFrame:
    """Rows per cell, intensity relative to the fullest cell, and the centroid of the rows.

    The peak is a scalar subquery over the aggregated cells; both use one exchange.
    """
    rows = df.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
    if where is not None:
        rows = rows.where(where)
    cells = (rows.select(geo.hex_cell(lat, lon, resolution).alias("cell"), lat, lon).where(F.col("cell").isNotNull())
             .groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.avg(lat).alias("_lat"), F.avg(lon).alias("_lon")))
    return cells.select("cell", "n", F.round(F.col("n") / cells.agg(F.max("n")).scalar(), 3).alias("intensity"),
                        F.round("_lat", 6).alias("lat"), F.round("_lon", 6).alias("lon"))


def hottest(cells: DataFrame, k: int = 5) -> DataFrame:
    """The k fullest cells as next areas with their intensity as probability."""
    return cells.orderBy(F.desc("n"), "cell").limit(k).select("cell", F.col("intensity").alias("prob"))


def within_km(points: DataFrame, centres: DataFrame, km: float, point_lat: str, point_lon: str,
              centre_lat: str, centre_lon: str, on: Column | None = None, also: tuple[tuple[str, str], ...] = (),
              distance: str = "km") -> DataFrame:
    """Pairs (centre, point) at most ``km`` apart, by an equi-join on band and cell keys.

    Every point has one key and every centre up to nine, so each pair is met once. ``also``
    adds further equality keys (point column, centre column).
    """
    p = points.withColumn("_key", geo.radius_key(point_lat, point_lon, km))
    c = centres.withColumn("_key", F.explode(geo.radius_probe_keys(centre_lat, centre_lon, km)))
    p = p.where(F.col(point_lat).isNotNull() & F.col(point_lon).isNotNull()).alias("p")
    c = c.where(F.col(centre_lat).isNotNull() & F.col(centre_lon).isNotNull()).alias("c")
    cond = F.col("p._key") == F.col("c._key")
    for a, b in also:
        cond = cond & (F.col(f"p.{a}") == F.col(f"c.{b}"))
    if on is not None:
        cond = cond & on
    d = geo.haversine_km(F.col(f"p.{point_lat}"), F.col(f"p.{point_lon}"), F.col(f"c.{centre_lat}"), F.col(f"c.{centre_lon}"))
    taken = set(centres.columns)
    return (p.join(c, cond).withColumn(distance, d).where(F.col(distance) <= km)
            .select(*[F.col(f"c.{x}") for x in centres.columns],
                    *[F.col(f"p.{x}").alias(x if x not in taken else f"point_{x}") for x in points.columns], distance))
