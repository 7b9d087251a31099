"""Rental views derived from the generic star-schema test tables.

The view texts use only SQL that Spark and DuckDB read alike, so the check
queries can start from the same inputs. ``{name}`` marks a base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("streeteasy", "craigslist", "zillow", "rentcom", "zumper")
BOROUGHS = ("Manhattan", "Brooklyn", "Queens", "Bronx", "Staten Island")
AMENITIES = ("laundry", "dishwasher", "doorman", "gym", "elevator", "roof", "storage", "parking")

#: A user has 30 customers' searches, so users grow with customers.
USER_ID = "CAST(floor(c_custkey / 30) AS bigint)"

BASE = {
    "listings": ("orders", "customer", "nation", "documents"),
    "observations": ("lineitem",),
    "saved_searches": ("customer",),
    "permits": ("part",),
    "register": ("part",),
    "scrape_runs": ("events",),
    "notifications": ("events",),
}


def _case(expr: str, values) -> str:
    *head, last = values
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(head))
    return f"CASE {expr} {whens} ELSE '{last}' END"


def _lat(e: str) -> str:
    return f"CAST(40.4774 AS DOUBLE) + ({e}) / CAST(10000.0 AS DOUBLE)"


def _lng(e: str) -> str:
    return f"CAST(-74.2591 AS DOUBLE) + ({e}) / CAST(10000.0 AS DOUBLE)"


VIEWS = {
    "listings": f"""
SELECT o_orderkey AS id,
  concat(CAST(1 + o_orderkey % 400 AS string), ' East ', CAST(1 + o_custkey % 90 AS string), 'th Street') AS address,
  {_case('n_regionkey', BOROUGHS)} AS borough,
  CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE n_name END AS neighborhood,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE {_lat('o_orderkey * 7919 % 4402')} END AS lat,
  CASE WHEN o_orderkey % 53 = 0 THEN NULL ELSE {_lng('o_orderkey * 104729 % 5587')} END AS lng,
  CAST(900 + floor(o_totalprice / 100) AS int) AS price,
  CAST(o_orderkey % 5 AS int) AS bedrooms,
  1 + (o_custkey % 4) * CAST(0.5 AS DOUBLE) AS bathrooms,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(350 + o_custkey % 1200 AS int) END AS sqft,
  CASE WHEN o_orderstatus = 'F' THEN 'removed' ELSE 'active' END AS status,
  o_orderkey % (SELECT greatest(count(*), 1) FROM {{documents}}) AS doc_id,
  CAST(o_orderkey % 256 AS int) AS amenity_bits,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE CAST(o_custkey % 121 AS int) END AS days_on_market,
  CAST(1 + o_custkey % 4 AS int) AS source_count,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE (o_orderkey * 37 % 1000) / CAST(10.0 AS DOUBLE) END AS undervalue_score,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE (o_orderkey * 53 % 1000) / CAST(1000.0 AS DOUBLE) END AS rs_probability,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE (o_orderkey * 71 % 1000) / CAST(10.0 AS DOUBLE) END AS quality_score,
  o_orderdate AS created_at
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    "observations": f"""
SELECT l_orderkey AS listing_id,
  {_case('l_suppkey % 5', SOURCES)} AS source,
  CASE WHEN l_partkey % 41 = 0 THEN NULL ELSE CAST(900 + floor(l_extendedprice / 20) AS int) END AS price,
  CAST(((year(l_shipdate) - 1995) * 372 + (month(l_shipdate) - 1) * 31 + day(l_shipdate)) * 2160 AS bigint) AS scraped_sec,
  l_linenumber, l_suppkey, l_partkey
FROM {{lineitem}}""",
    "saved_searches": f"""
SELECT c_custkey AS search_id, {USER_ID} AS user_id,
  concat('search ', CAST(c_custkey AS string)) AS name,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(900 + c_custkey % 2000 AS int) END AS min_price,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(2500 + c_custkey % 3000 AS int) END AS max_price,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE CAST(c_custkey % 5 AS int) END AS bedrooms,
  CASE WHEN c_nationkey % 6 = 5 THEN NULL WHEN c_nationkey % 5 = 0 THEN 'Manhattan' WHEN c_nationkey % 5 = 1 THEN 'Brooklyn'
    WHEN c_nationkey % 5 = 2 THEN 'Queens' WHEN c_nationkey % 5 = 3 THEN 'Bronx' ELSE 'Staten Island' END AS borough,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE {_lat('c_custkey * 7919 % 4402')} END AS center_lat,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE {_lng('c_custkey * 104729 % 5587')} END AS center_lng,
  CASE WHEN c_custkey % 2 = 0 THEN NULL ELSE CAST(1.0 AS DOUBLE) + c_custkey % 10 END AS radius_miles,
  CAST((c_custkey * 31) % 4 AS int) AS amenity_bits,
  CASE WHEN c_custkey % 9 = 0 THEN CAST(40.0 AS DOUBLE) ELSE NULL END AS min_quality_score,
  c_custkey % 11 <> 0 AS is_active,
  CASE c_custkey % 3 WHEN 0 THEN 'push,email' WHEN 1 THEN 'sse' ELSE '' END AS channel_list
FROM {{customer}}""",
    "permits": f"""
SELECT p_partkey AS id, concat('P', CAST(p_partkey AS string)) AS permit_number,
  concat(CAST(1 + p_partkey % 400 AS string), ' ', upper(p_name)) AS address,
  {_case('p_partkey % 5', BOROUGHS)} AS borough,
  CASE p_type WHEN 'STANDARD' THEN 'NB' WHEN 'PROMO' THEN 'A1' WHEN 'SMALL' THEN 'A2' WHEN 'LARGE' THEN 'DM' ELSE 'EW' END AS permit_type,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE {_lat('p_partkey * 6007 % 4402')} END AS lat,
  CASE WHEN p_partkey % 19 = 0 THEN NULL ELSE {_lng('p_partkey * 7001 % 5587')} END AS lng,
  CAST(p_size AS int) AS filed_days_ago, CAST(p_partkey % 300 AS int) AS residential_units
FROM {{part}}""",
    "register": """
SELECT p_partkey AS id, CAST(10001 + p_partkey % 280 AS string) AS zip_code,
  CAST(1 + p_partkey % 400 AS string) AS building_number, concat('East ', CAST(1 + p_size AS string), 'th') AS street_name,
  CAST(p_partkey % 1800 AS int) AS block, CAST(p_size AS int) AS lot
FROM {part}""",
    "scrape_runs": f"""
SELECT event_id AS run_id, ts,
  {_case('user_id % 5', SOURCES)} AS source,
  CASE WHEN event_type = 'error' OR event_type = 'signup' THEN 0 ELSE 1 END AS success,
  CAST(floor(value) AS int) AS n_listings, round(value * 20, 2) AS duration_seconds
FROM {{events}}""",
    "notifications": """
SELECT event_id AS id, user_id,
  CASE event_type WHEN 'view' THEN 'listed' WHEN 'click' THEN 'price_drop' WHEN 'purchase' THEN 'price_increase' WHEN 'signup' THEN 'relisted' ELSE 'removed' END AS event_type,
  ts AS sent_at, CASE WHEN event_id % 3 = 0 THEN NULL ELSE ts END AS read_at
FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One derived view as a DataFrame (nothing is cached or collected)."""
    out = spark.sql(VIEWS[name], **{t: table(spark, sf_dir, t) for t in BASE[name]})
    if name == "listings":
        return out.selectExpr("*", f"{amenity_array('amenity_bits')} AS amenities")
    if name == "saved_searches":
        return out.selectExpr(
            "*",
            f"{amenity_array('amenity_bits')} AS amenities",
            "filter(split(channel_list, ','), c -> c <> '') AS channels",
        )
    return out


def view_sql(name: str) -> str:
    """Text of a view over the bare table names."""
    return VIEWS[name].format(**{t: t for t in BASE[name]})


def amenity_array(bits: str) -> str:
    words = ", ".join(f"'{a}'" for a in AMENITIES)
    return (
        f"filter(transform(array({words}), (w, i) -> "
        f"if(getbit({bits}, i) = 1, w, NULL)), w -> w IS NOT NULL)"
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One user per id found in the saved searches."""
    ids = view(spark, sf_dir, "saved_searches").select("user_id").distinct()
    return ids.selectExpr(
        "user_id",
        "concat('u', user_id, '@example.com') AS email",
        "if(user_id % 3 = 0, array(), array(concat('tok', user_id))) AS device_tokens",
    )


USERS_SQL = f"""SELECT DISTINCT {USER_ID} AS user_id,
  concat('u', CAST({USER_ID} AS string), '@example.com') AS email,
  {USER_ID} % 3 <> 0 AS has_token FROM customer"""
