"""Raw listing text to typed, keyed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import text as X

TEXT_FIELDS = ("source", "address", "price", "bedrooms", "bathrooms", "sqft")


def normalize_listings(raw: DataFrame) -> DataFrame:
    """Cleaned address, key, cents, rooms and area; other columns become ``extra``."""
    others = [c for c in raw.columns if c not in TEXT_FIELDS]
    pairs = [x for c in others for x in (F.lit(c), F.col(c).cast("string"))]
    t = {c: F.col(c).cast("string") for c in TEXT_FIELDS}
    out = raw.select(
        *others,
        "source",
        X.clean_address(t["address"]).alias("address_clean"),
        X.parse_price_cents(t["price"]).alias("price_cents"),
        X.parse_bedrooms(t["bedrooms"]).alias("bedrooms"),
        X.parse_bathrooms(t["bathrooms"]).alias("bathrooms"),
        X.parse_sqft(t["sqft"]).alias("sqft"),
        (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("extra"),
    )
    return out.withColumn(
        "canonical_hash", X.canonical_hash(F.col("source"), F.col("address_clean"), F.col("bedrooms"))
    )
