"""Geocode enrichment from a stored response table (no service is called)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geo import is_in_city
from ..functions.numbers import strip

TTL_DAYS = 30
RESPONSE = """status STRING, results ARRAY<STRUCT<
  formatted_address: STRING,
  geometry: STRUCT<location: STRUCT<lat: DOUBLE, lng: DOUBLE>>,
  address_components: ARRAY<STRUCT<long_name: STRING, types: ARRAY<STRING>>>>>"""
GEO_FIELDS = ("lat", "lng", "formatted_address", "neighborhood", "borough", "zip_code", "valid_nyc")


def geocode_key(address: Column) -> Column:
    return F.concat(F.lit("geocode:"), F.md5(strip(F.lower(address))))


def flatten_geocode(responses: DataFrame, json: str = "json") -> DataFrame:
    """First result of each OK response; other responses give NULL fields."""
    r = responses.withColumn("r", F.from_json(json, RESPONSE))
    ok = (F.col("r.status") == "OK") & (F.size("r.results") > 0)
    r = r.withColumn("top", F.when(ok, F.get("r.results", F.lit(0))))
    parts = F.filter(F.coalesce("top.address_components", F.array()), lambda c: F.size(c.types) > 0)

    def part(kind: str) -> Column:
        # a later component of the same first type replaces an earlier one
        named = F.filter(parts, lambda c: F.get(c.types, F.lit(0)) == kind)
        return F.when(
            F.col("top").isNotNull(), F.coalesce(F.try_element_at(named, F.lit(-1))["long_name"], F.lit(""))
        )

    lat, lng = F.col("top.geometry.location.lat"), F.col("top.geometry.location.lng")
    return r.select(
        *[c for c in responses.columns if c != json],
        lat.alias("lat"), lng.alias("lng"),
        F.when(F.col("top").isNotNull(), F.coalesce("top.formatted_address", F.lit(""))).alias("formatted_address"),
        part("neighborhood").alias("neighborhood"),
        part("sublocality_level_1").alias("borough"),
        part("postal_code").alias("zip_code"),
        is_in_city(lat, lng).alias("valid_nyc"),
    )


def enrich_geocode(listings: DataFrame, cache: DataFrame, now: Column, days: int = TTL_DAYS) -> DataFrame:
    """Add ``geo``: the cached result of the address, if younger than the limit."""
    age = now.cast("double") - F.col("cached_at").cast("double")
    fresh = cache.filter(age < days * 86400).groupBy("key").agg(
        F.max_by(F.struct(*GEO_FIELDS), "cached_at").alias("geo")
    )
    key = F.when(F.length("address") > 0, geocode_key(F.col("address")))
    return listings.withColumn("key", key).join(fresh, "key", "left")
