"""Distance, bounding box and grid-cell expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

MILES_RADIUS = 3959.0
METERS_RADIUS = 6371008.8
METERS_PER_MILE = 1609.34

# Bounding box of the city.
CITY_BOX = {"min_lat": 40.4774, "max_lat": 40.9176, "min_lng": -74.2591, "max_lng": -73.7004}


def haversine(lat1, lng1, lat2, lng2, radius: float) -> Column:
    dlat = F.radians(lat2 - lat1)
    dlng = F.radians(lng2 - lng1)
    a = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(dlng / 2), 2
    )
    return F.lit(radius) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_miles(lat1, lng1, lat2, lng2) -> Column:
    return haversine(lat1, lng1, lat2, lng2, MILES_RADIUS)


def haversine_meters(lat1, lng1, lat2, lng2) -> Column:
    return haversine(lat1, lng1, lat2, lng2, METERS_RADIUS)


def is_in_city(lat: Column, lng: Column) -> Column:
    b = CITY_BOX
    return lat.between(b["min_lat"], b["max_lat"]) & lng.between(b["min_lng"], b["max_lng"])


def degree_box(lat: float, miles: float) -> tuple[float, float]:
    """Half-height and half-width in degrees that safely cover a radius.

    The width is taken at the latitude of the circle's edge nearer to the pole,
    with two percent to spare; near a pole every longitude is covered.
    """
    dlat = 1.02 * math.degrees(miles * METERS_PER_MILE / METERS_RADIUS)
    edge = min(abs(lat) + dlat, 90.0)
    c = math.cos(math.radians(edge))
    return dlat, (360.0 if c < 1e-3 else min(360.0, dlat / c))


def within_radius(lat: Column, lng: Column, center_lat: float, center_lng: float, miles: float):
    """Radius test around a constant point: pushable box first, then the circle."""
    dlat, dlng = degree_box(center_lat, miles)
    box = lat.between(center_lat - dlat, center_lat + dlat)
    if abs(center_lng) + dlng < 180.0:
        box = box & lng.between(center_lng - dlng, center_lng + dlng)
    dist = haversine_meters(lat, lng, F.lit(center_lat), F.lit(center_lng))
    return box & (dist <= miles * METERS_PER_MILE)


def cell(x: Column, size: float) -> Column:
    return F.floor(x / F.lit(size)).cast("int")


# Accepted shapes of a location value.
LOCATION_SHAPES = {
    "zip": r"^\d{5}(-\d{4})?$",
    "coordinate": r"^-?\d{1,3}\.\d{4,}$",
    "wkt_point": r"(?i)^POINT\s*\(",
    "wkt_polygon": r"(?i)^(MULTI)?POLYGON\s*\(",
}
RESOLVED_TYPES = ("lat_long", "geometry", "h3")


def location_shape(value: Column) -> Column:
    out = F
    for name, pattern in LOCATION_SHAPES.items():
        out = out.when(value.rlike(pattern), F.lit(name))
    return out


def is_resolved(location_type: Column) -> Column:
    return location_type.isin(*RESOLVED_TYPES)
