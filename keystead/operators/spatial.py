"""Permit and listing proximity."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import MILES_RADIUS, haversine_miles, within_radius
from ..functions.numbers import py_round
from .skew import HOT_FLOOR, grid_join


def _columns(band: Column, dlat: float) -> Column:
    """Number of cells around a band, each wide enough to cover the radius; one cell near the poles."""
    edge = F.greatest(F.abs(band * dlat), F.abs((band + 1) * dlat)) + dlat
    fit = F.floor(360.0 * F.cos(F.radians(F.least(edge, F.lit(89.0)))) / dlat)
    return F.when(edge >= 89.0, 1).otherwise(F.greatest(fit, F.lit(1))).cast("int")


def near_pairs(
    points: DataFrame, probes: DataFrame, miles: float, point_id: str, probe_id: str, floor: int = HOT_FLOOR
) -> DataFrame:
    """Pairs within ``miles`` by a grid equi-join; needs p_lat/p_lng and q_lat/q_lng.

    Each probe is repeated for the cells around it (3 x 3, fewer where a band has
    less), each point lies in one cell, so a pair meets exactly once and only
    neighbours are compared. Cells go around the globe. A hot cell is dealt to a
    grid of tasks.
    """
    dlat = math.degrees(miles / MILES_RADIUS) * 1.02

    def column(lng: Column, band: Column) -> Column:
        n = _columns(band, dlat)
        return F.pmod(F.floor((lng + 180.0) / 360.0 * n).cast("int"), n)

    a = points.filter(F.col("p_lat").isNotNull() & F.col("p_lng").isNotNull()).withColumn("_band", F.floor(F.col("p_lat") / dlat).cast("int"))
    a = a.withColumn("_col", column(F.col("p_lng"), F.col("_band")))
    around = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    b = (
        probes.filter(F.col("q_lat").isNotNull() & F.col("q_lng").isNotNull())
        .withColumn("_band", F.explode(F.transform(around, lambda i: F.floor(F.col("q_lat") / dlat).cast("int") + i)))
        .withColumn("_n", _columns(F.col("_band"), dlat))
        .withColumn("_mid", column(F.col("q_lng"), F.col("_band")))
        .withColumn("_col", F.explode(F.array_distinct(F.transform(around, lambda i: F.pmod(F.col("_mid") + i, F.col("_n"))))))
        .drop("_mid", "_n")
    )
    dist = haversine_miles(F.col("q_lat"), F.col("q_lng"), F.col("p_lat"), F.col("p_lng"))
    return (
        grid_join(a, b, ["_band", "_col"], point_id, probe_id, floor)
        .withColumn("distance", dist)
        .filter(F.col("distance") <= miles)
        .drop("_band", "_col")
    )


def proximity_alerts(
    permits: DataFrame, listings: DataFrame, radius: float = 0.25, recent: Column | None = None,
    types: list[str] | None = None, floor: int = HOT_FLOOR,
) -> DataFrame:
    """Recent permits near active listings, distance in miles to three digits."""
    if recent is not None:
        permits = permits.filter(recent)
    if types:
        permits = permits.filter(F.col("permit_type").isin(*types))
    points = listings.filter(F.col("status") == "active").select(
        F.col("id").alias("listing_id"), F.col("address").alias("listing_address"),
        F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"),
    )
    probes = permits.select(
        F.col("id").alias("permit_id"), "permit_number", "permit_type",
        F.col("address").alias("permit_address"), F.col("lat").alias("q_lat"), F.col("lng").alias("q_lng"),
    )
    return near_pairs(points, probes, radius, "listing_id", "permit_id", floor).select(
        "listing_id", "permit_id", "permit_number", "permit_type", "permit_address", "listing_address",
        py_round(F.col("distance"), 3).alias("distance_miles"),
    )


def permits_near(permits: DataFrame, lat: float, lng: float, miles: float = 0.25, n: int = 100) -> DataFrame:
    """Newest permits within a radius of one point."""
    hit = within_radius(F.col("lat"), F.col("lng"), lat, lng, miles)
    return permits.filter(hit).orderBy(F.col("filing_date").desc_nulls_first(), F.col("id")).limit(n)


def permits_at(permits: DataFrame, address: str, n: int = 50) -> DataFrame:
    """Newest permits whose address contains the text, wildcards removed."""
    needle = address.replace("%", "").replace("_", "").upper()
    hit = F.upper(F.col("address")).contains(needle)
    return permits.filter(hit).orderBy(F.col("filing_date").desc_nulls_first(), F.col("id")).limit(n)
