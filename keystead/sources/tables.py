"""The eight stored tables, event log and run log: schemas, scan, sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

SCHEMAS = {
    "listings": """id BIGINT, address STRING, unit STRING, borough STRING, neighborhood STRING, lat DOUBLE, lng DOUBLE,
        price INT, bedrooms INT, bathrooms DOUBLE, sqft INT, amenities ARRAY<STRING>, description STRING,
        undervalue_score DOUBLE, rs_probability DOUBLE, quality_score DOUBLE, canonical_hash STRING, status STRING,
        source_count INT, days_on_market INT, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP,
        created_at TIMESTAMP, updated_at TIMESTAMP""",
    "listing_sources": """id BIGINT, listing_id BIGINT, source STRING, source_url STRING, source_listing_id STRING,
        raw_data MAP<STRING, STRING>, scraped_at TIMESTAMP""",
    "price_history": """id BIGINT, listing_id BIGINT, price INT, previous_price INT, event_type STRING,
        recorded_at TIMESTAMP""",
    "users": """id BIGINT, email STRING, device_tokens ARRAY<STRING>,
        notification_preferences MAP<STRING, STRING>, created_at TIMESTAMP""",
    "saved_searches": """id BIGINT, user_id BIGINT, name STRING, min_price INT, max_price INT, bedrooms INT,
        borough STRING, center_lat DOUBLE, center_lng DOUBLE, radius_miles DOUBLE, amenities ARRAY<STRING>,
        min_undervalue_score DOUBLE, min_rs_probability DOUBLE, min_quality_score DOUBLE, notify_new BOOLEAN,
        notify_price_drop BOOLEAN, notify_removed BOOLEAN, channels ARRAY<STRING>, is_active BOOLEAN,
        created_at TIMESTAMP""",
    "notifications": """id BIGINT, user_id BIGINT, listing_id BIGINT, channel STRING, event_type STRING,
        message STRING, sent_at TIMESTAMP, read_at TIMESTAMP""",
    "rent_stabilized_buildings": """id BIGINT, zip_code STRING, building_number STRING, street_name STRING,
        street_suffix STRING, building_number_2 STRING, street_name_2 STRING, street_suffix_2 STRING, city STRING,
        county_code INT, status1 STRING, status2 STRING, status3 STRING, block INT, lot INT, bbl STRING""",
    "building_permits": """id BIGINT, permit_number STRING, address STRING, borough STRING, lat DOUBLE, lng DOUBLE,
        permit_type STRING, residential_units INT, estimated_cost BIGINT, filing_date TIMESTAMP,
        approval_date TIMESTAMP, completion_date TIMESTAMP, status STRING, raw_data STRING, created_at TIMESTAMP""",
    "listing_events": "listing_id BIGINT, event_type STRING, created_at TIMESTAMP",
    "scrape_runs": """source STRING, ts TIMESTAMP, n_listings INT, duration_seconds DOUBLE, success INT,
        error STRING""",
}

# Unique keys and text lengths of the stored tables.
UNIQUE = {
    "listings": [["canonical_hash"]],
    "listing_sources": [["source_url"], ["listing_id", "source"]],
    "users": [["email"]],
    "building_permits": [["permit_number"]],
}
MAX_LENGTH = {
    "listings": {"address": 500, "unit": 50, "borough": 20, "neighborhood": 100, "canonical_hash": 64, "status": 20},
    "listing_sources": {"source": 20, "source_url": 1000, "source_listing_id": 100},
    "price_history": {"event_type": 20},
    "users": {"email": 255},
    "saved_searches": {"name": 200, "borough": 20},
    "notifications": {"channel": 20, "event_type": 20},
    "rent_stabilized_buildings": {
        "zip_code": 10, "building_number": 20, "street_name": 100, "street_suffix": 20, "building_number_2": 20,
        "street_name_2": 100, "street_suffix_2": 20, "city": 50, "status1": 50, "status2": 50, "status3": 50, "bbl": 10,
    },
    "building_permits": {"permit_number": 50, "address": 500, "borough": 20, "permit_type": 30, "status": 30},
}


def schema_of(name: str) -> T.StructType:
    return T.StructType.fromDDL(SCHEMAS[name])


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """Scan with the declared schema; filters and columns reach the files."""
    return spark.read.schema(schema_of(name)).parquet(f"{base.rstrip('/')}/{name}")


def conform(df: DataFrame, name: str) -> DataFrame:
    """Columns of a stored table in order and type, missing ones NULL."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schema_of(name).fields
    ])


def append_table(df: DataFrame, base: str, name: str) -> None:
    """Append-only sink: event log, price history, run log."""
    conform(df, name).write.mode("append").parquet(f"{base.rstrip('/')}/{name}")


def replace_table(df: DataFrame, base: str, name: str, cluster_by: tuple[str, ...] = ()) -> None:
    """Full rewrite; ``cluster_by`` range-sorts the files for min/max skipping."""
    out = conform(df, name)
    if cluster_by:
        out = out.repartitionByRange(*cluster_by).sortWithinPartitions(*cluster_by)
    out.write.mode("overwrite").parquet(f"{base.rstrip('/')}/{name}")
