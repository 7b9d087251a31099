"""Search, statistics, notification-log and similarity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo
from ..operators import quality_rules as R, search as S, spatial, matching
from ..sources import derived as D
from .catalog import METERS, amenity_text, hav, over, query, rnd

V = D.view
ROW = "id, price, bedrooms, borough, status"
ROW_LIST = ROW.split(", ")


def _search(name: str, f: S.Filters, where: str):
    sql = over("listings", f"SELECT {ROW} FROM listings WHERE {where}")

    @query(name, sql)
    def run(spark, sf):
        return S.search_listings(V(spark, sf, "listings"), f).select(*ROW_LIST)


_search("F01_status_filter", S.Filters(), "status = 'active'")
_search("F02_price_range", S.Filters(min_price=1500, max_price=3000), "status = 'active' AND price BETWEEN 1500 AND 3000")
_search("F03_bedrooms_in", S.Filters(bedrooms=[1, 3]), "status = 'active' AND bedrooms IN (1, 3)")
_search(
    "F04_area_equality",
    S.Filters(status="", borough="Queens", neighborhood="NATION_2"),
    "borough = 'Queens' AND neighborhood = 'NATION_2'",
)
_search(
    "F05_minimum_scores",
    S.Filters(min_undervalue_score=60.0, min_rs_probability=0.25),
    "status = 'active' AND undervalue_score >= 60 AND rs_probability >= 0.25",
)
_search(
    "F06_amenity_containment",
    S.Filters(amenities=["laundry", "doorman", "laundry"]),
    "status = 'active' AND (amenity_bits & 5) = 5",
)
_search(
    "F07_geo_radius",
    S.Filters(lat=40.73, lng=-73.99, radius_miles=3.0),
    f"status = 'active' AND {hav('CAST(40.73 AS DOUBLE)', 'CAST(-73.99 AS DOUBLE)', 'lat', 'lng', METERS)} <= 3.0 * 1609.34",
)
_search(
    "F20_client_filters",
    S.Filters(boroughs=["Bronx", "Queens"], neighborhoods=["NATION_2", "NATION_3", "NATION_7"], bathrooms_min=2.0),
    "status = 'active' AND borough IN ('Bronx', 'Queens') AND neighborhood IN ('NATION_2', 'NATION_3', 'NATION_7') AND bathrooms >= 2.0",
)


_MATCH_SQL = f"""(s.min_price IS NULL OR l.price >= s.min_price)
  AND (s.max_price IS NULL OR l.price <= s.max_price)
  AND (s.bedrooms IS NULL OR l.bedrooms = s.bedrooms)
  AND (s.borough IS NULL OR l.borough = s.borough)"""


@query(
    "F08_search_preview",
    over(
        "listings saved_searches",
        f"""SELECT search_id, id, rank FROM (
  SELECT s.search_id, l.id, CAST(row_number() OVER (PARTITION BY s.search_id ORDER BY l.created_at DESC, l.id) AS INTEGER) AS rank
  FROM saved_searches s JOIN listings l ON l.status = 'active' AND {_MATCH_SQL}
   AND (l.amenity_bits & s.amenity_bits) = s.amenity_bits
   AND (coalesce(s.center_lat, 0) = 0 OR coalesce(s.center_lng, 0) = 0 OR coalesce(s.radius_miles, 0) = 0
     OR {hav('s.center_lat', 's.center_lng', 'l.lat', 'l.lng', METERS)} <= s.radius_miles * 1609.34)) WHERE rank <= 10""",
    ),
)
def search_preview(spark, sf):
    listings = V(spark, sf, "listings").select(
        "id", "status", "created_at", "price", "bedrooms", "borough", "lat", "lng", "amenities", "undervalue_score", "rs_probability")
    return matching.preview_search(listings, V(spark, sf, "saved_searches")).select("search_id", "id", "rank")


@query(
    "F09_active_searches",
    over(
        "saved_searches",
        "SELECT search_id, user_id, name, min_price, max_price FROM saved_searches WHERE user_id = 7 AND is_active",
    ),
)
def active_searches(spark, sf):
    s = V(spark, sf, "saved_searches").withColumn("created_at", F.col("search_id"))
    return S.list_searches(s, 7).select("search_id", "user_id", "name", "min_price", "max_price")


@query(
    "F10_unread_notifications",
    over(
        "notifications",
        "SELECT id, event_type, CAST(sent_at AS VARCHAR) AS sent FROM notifications WHERE user_id = 3 AND read_at IS NULL",
    ),
)
def unread_notifications(spark, sf):
    return S.list_notifications(V(spark, sf, "notifications"), 3, True).select(
        "id", "event_type", F.col("sent_at").cast("string").alias("sent")
    )


@query(
    "F10_notification_pages",
    over(
        "notifications",
        """SELECT id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY sent_at DESC, id DESC) AS rank, count(*) OVER (PARTITION BY user_id) AS total,
 CAST(ceil(count(*) OVER (PARTITION BY user_id) / 3) AS BIGINT) AS pages FROM notifications WHERE read_at IS NULL QUALIFY rank BETWEEN 4 AND 6""",
    ),
)
def notification_pages(spark, sf):
    out = S.notification_pages(V(spark, sf, "notifications"), 2, 3, unread=True)
    return out.select("id", "user_id", F.col("rank").cast("bigint").alias("rank"), "total", "pages")


@query(
    "F12_search_patches",
    over(
        "saved_searches",
        """SELECT search_id, user_id, CASE WHEN search_id % 10 IN (3, 9) THEN 1000 ELSE min_price END AS min_price, CASE WHEN search_id % 10 IN (4, 9) THEN NULL ELSE max_price END AS max_price, name,
 is_active FROM saved_searches WHERE search_id % 10 IN (3, 4, 9) UNION ALL SELECT -search_id, user_id, 7, NULL, NULL, true FROM saved_searches WHERE search_id % 10 = 5""",
    ),
)
def search_patches(spark, sf):
    """Patches of one or two fields, in turn, of a user's own and of other users' searches, and new searches."""
    s = V(spark, sf, "saved_searches")
    none = F.lit(None).cast("int")

    def patch(last: int, turn: int, given, key=F.col("search_id"), user=F.col("user_id"), price=none, active=F.lit(None).cast("boolean")):
        return s.filter(F.col("search_id") % 10 == last).select(
            key.alias("search_id"), user.alias("user_id"), price.alias("min_price"), none.alias("max_price"), active.alias("is_active"),
            F.array(*[F.lit(g) for g in given]).alias("given"), F.lit(turn).alias("turn"))

    rows = [
        patch(3, 1, ["min_price"], price=F.lit(1000)), patch(4, 1, ["max_price"]),
        patch(9, 1, ["min_price", "max_price"], price=F.lit(5)), patch(9, 2, ["min_price"], price=F.lit(1000)),
        patch(6, 1, ["min_price"], user=F.col("user_id") + 1, price=F.lit(1)),
        patch(5, 2, ["min_price", "is_active"], key=-F.col("search_id"), price=F.lit(7), active=F.lit(True)),
        patch(5, 3, ["min_price"], key=-F.col("search_id"), user=F.col("user_id") + 1, price=F.lit(8)),
    ]
    patches = rows[0]
    for r in rows[1:]:
        patches = patches.unionByName(r)
    return S.patch_rows(s, patches, "search_id", "user_id", ["turn"]).select("search_id", "user_id", "min_price", "max_price", "name", "is_active")


@query(
    "F11_mark_read",
    over(
        "notifications",
        """SELECT id, user_id, CAST(CASE WHEN user_id = 3 AND read_at IS NULL THEN TIMESTAMP '2024-06-01 12:00:00'
 ELSE read_at END AS VARCHAR) AS read_text FROM notifications""",
    ),
)
def mark_read(spark, sf):
    now = F.expr("TIMESTAMP_NTZ '2024-06-01 12:00:00'")
    return S.mark_read(V(spark, sf, "notifications"), 3, now).select(
        "id", "user_id", F.col("read_at").cast("string").alias("read_text")
    )


@query(
    "F12_soft_delete",
    over(
        "saved_searches",
        """SELECT search_id, is_active AND search_id NOT IN (SELECT search_id FROM saved_searches WHERE user_id = 4) AS is_active
FROM saved_searches""",
    ),
)
def soft_delete(spark, sf):
    s = V(spark, sf, "saved_searches")
    return S.deactivate(s, s.filter("user_id = 4").select("search_id")).select("search_id", "is_active")


_BOX = "lat BETWEEN 40.4774 AND 40.9176 AND lng BETWEEN -74.2591 AND -73.7004"


@query(
    "F14_city_box",
    over(
        "listings",
        f"SELECT borough, count(*) FILTER (WHERE {_BOX}) AS inside, count(*) FILTER (WHERE lat IS NULL) AS unknown FROM listings GROUP BY borough",
    ),
)
def city_box(spark, sf):
    return V(spark, sf, "listings").groupBy("borough").agg(
        F.count_if(geo.is_in_city(F.col("lat"), F.col("lng"))).alias("inside"),
        F.count_if(F.col("lat").isNull()).alias("unknown"),
    )


_VALUES = """CASE id % 6 WHEN 0 THEN CAST(10001 + id % 280 AS VARCHAR) WHEN 1 THEN concat(CAST(10001 + id % 280 AS VARCHAR), '-0001')
  WHEN 2 THEN concat('-73.', CAST(10000 + id % 5000 AS VARCHAR)) WHEN 3 THEN concat('point (', CAST(id AS VARCHAR), ' 1)')
  WHEN 4 THEN 'MULTIPOLYGON (((0 0)))' ELSE address END"""
_TYPES = "CASE id % 4 WHEN 0 THEN 'lat_long' WHEN 1 THEN 'geometry' WHEN 2 THEN 'h3' ELSE 'place_ref' END"


@query(
    "F15_location_classifier",
    over(
        "listings",
        rf"""SELECT id, v, CASE WHEN regexp_matches(v, '^\d{{5}}(-\d{{4}})?$') THEN 'zip'
 WHEN regexp_matches(v, '^-?\d{{1,3}}\.\d{{4,}}$') THEN 'coordinate'
 WHEN regexp_matches(v, '(?i)^POINT\s*\(') THEN 'wkt_point' WHEN regexp_matches(v, '(?i)^(MULTI)?POLYGON\s*\(') THEN 'wkt_polygon' END AS shape,
 t IN ('lat_long', 'geometry', 'h3') AS resolved FROM (SELECT id, {_VALUES} AS v, {_TYPES} AS t FROM listings)""",
    ),
)
def location_classifier(spark, sf):
    df = V(spark, sf, "listings").selectExpr(
        "id", f"{_VALUES.replace('VARCHAR', 'STRING')} AS v", f"{_TYPES} AS t"
    )
    return df.select(
        "id", "v", geo.location_shape(F.col("v")).alias("shape"), geo.is_resolved(F.col("t")).alias("resolved")
    )


_DIRTY = """id, CASE WHEN id % 101 = 0 THEN 0 WHEN id % 103 = 0 THEN NULL ELSE price END AS price,
 CASE WHEN id % 89 = 0 THEN -1 ELSE bedrooms END AS bedrooms, CASE WHEN id % 71 = 0 THEN NULL ELSE bathrooms END AS bathrooms,
 CASE WHEN id % 37 = 0 THEN 0 ELSE sqft END AS sqft"""


@query(
    "F16_row_validation",
    over(
        "listings",
        f"""SELECT * FROM (SELECT id, concat_ws(',', CASE WHEN NOT coalesce(price > 0, false) THEN 'price' END,
 CASE WHEN NOT coalesce(bedrooms >= 0, false) THEN 'bedrooms' END, CASE WHEN NOT coalesce(bathrooms >= 0, false) THEN 'bathrooms' END,
 CASE WHEN sqft IS NOT NULL AND NOT sqft > 0 THEN 'sqft' END) AS reasons FROM (SELECT {_DIRTY} FROM listings)) WHERE reasons <> ''""",
    ),
)
def row_validation(spark, sf):
    dirty = V(spark, sf, "listings").selectExpr(*[p.strip() for p in _split_top(_DIRTY)])
    _, bad = R.split_valid(dirty, R.listing_rules())
    return bad.select("id", F.array_join("reasons", ",").alias("reasons"))


def _split_top(text: str) -> list[str]:
    """Split a select list at its commas (no nested commas in these texts)."""
    return [p for p in text.replace("\n", " ").split(",")]


@query(
    "F17_constraint_report",
    over(
        "listings",
        """SELECT 'unique(address,bedrooms)' AS rule, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS violations FROM
 (SELECT count(*) AS n FROM listings GROUP BY address, bedrooms HAVING count(*) > 1)
UNION ALL SELECT 'unique(id)', 0
UNION ALL SELECT 'length(address)', count(*) FILTER (WHERE length(address) > 18) FROM listings
UNION ALL SELECT 'length(neighborhood)', count(*) FILTER (WHERE length(neighborhood) > 8) FROM listings""",
    ),
)
def constraint_report(spark, sf):
    return R.constraint_report(
        V(spark, sf, "listings"), [["address", "bedrooms"], ["id"]], {"address": 18, "neighborhood": 8}
    )


@query(
    "F19_listing_projection",
    over(
        "listings",
        f"""SELECT id, address, borough, neighborhood, price, bedrooms, bathrooms, sqft, {amenity_text('amenity_bits')} AS amenities,
 lat, lng, undervalue_score, rs_probability, quality_score, status, source_count, days_on_market, CAST(created_at AS VARCHAR) AS created_at
 FROM listings""",
    ),
)
def listing_projection(spark, sf):
    return S.to_listing_row(V(spark, sf, "listings")).withColumns(
        {"amenities": F.array_join("amenities", ","), "created_at": F.col("created_at").cast("string")}
    )


_NULL_ORDER = "CASE WHEN undervalue_score IS NULL THEN 0 ELSE 1 END, undervalue_score DESC, id"


@query(
    "O01_whitelisted_sort",
    over(
        "listings",
        f"""SELECT id, undervalue_score, CAST(row_number() OVER (ORDER BY {_NULL_ORDER}) AS INTEGER) AS pos
FROM listings WHERE status = 'active' ORDER BY {_NULL_ORDER} LIMIT 100""",
    ),
)
def whitelisted_sort(spark, sf):
    # the first page of 100 (the largest page allowed), with its positions
    df = S.search_listings(V(spark, sf, "listings"), S.Filters())
    top = S.page(S.sort_listings(df, "undervalue_score", "desc"), 1, 100)
    w = S.W.orderBy(*S.sort_order("undervalue_score", "desc"))
    return top.select("id", "undervalue_score", F.row_number().over(w).alias("pos"))


@query(
    "O02_offset_page",
    over(
        "listings",
        "SELECT id, price FROM listings WHERE status = 'active' ORDER BY price ASC NULLS LAST, id LIMIT 20 OFFSET 40",
    ),
)
def offset_page(spark, sf):
    df = S.search_listings(V(spark, sf, "listings"), S.Filters())
    return S.page(S.sort_listings(df, "price", "asc"), 3, 20).select("id", "price")


@query(
    "O04_newest",
    over(
        "listings",
        """SELECT id, CAST(created_at AS VARCHAR) AS created FROM listings WHERE status = 'active'
ORDER BY created_at DESC NULLS FIRST, id LIMIT 10""",
    ),
)
def newest(spark, sf):
    df = S.search_listings(V(spark, sf, "listings"), S.Filters())
    return S.page(S.sort_listings(df, "no_such_column"), 1, 10).select(
        "id", F.col("created_at").cast("string").alias("created")
    )


@query(
    "A04_neighborhood_stats",
    over(
        "listings",
        f"""SELECT borough, neighborhood, count(*) AS count, {rnd('nullif(avg(price), 0)', 2)} AS avg_price, min(price) AS min_price,
 max(price) AS max_price, {rnd('nullif(avg(undervalue_score), 0)', 4)} AS avg_undervalue_score
FROM listings WHERE status = 'active' GROUP BY borough, neighborhood""",
    ),
)
def neighborhood_stats(spark, sf):
    return S.listing_stats(V(spark, sf, "listings"))


@query(
    "A05_page_info",
    over(
        "listings",
        """SELECT count(*) AS total, 2 AS page, 20 AS per_page,
 CASE WHEN count(*) > 0 THEN (count(*) + 19) // 20 ELSE 0 END AS pages FROM listings WHERE status = 'active' AND bedrooms = 2""",
    ),
)
def page_info(spark, sf):
    df = S.search_listings(V(spark, sf, "listings"), S.Filters(bedrooms=[2]))
    return S.page_info(df, 2, 20)


@query(
    "A06_market_overview",
    over(
        "listings",
        f"""SELECT 'total' AS section, 'all' AS key, count(*) AS count, {rnd('avg(price)', 6)} AS avg_price, median(price) AS median_price FROM listings
UNION ALL SELECT 'by_borough', borough, count(*), {rnd('avg(price)', 6)}, NULL FROM listings GROUP BY borough
UNION ALL SELECT 'by_bedrooms', CAST(bedrooms AS VARCHAR), count(*), {rnd('avg(price)', 6)}, NULL FROM listings GROUP BY bedrooms""",
    ),
)
def market_overview(spark, sf):
    from ..functions.numbers import py_round

    return S.market_overview(V(spark, sf, "listings")).withColumn("avg_price", py_round(F.col("avg_price"), 6))


@query(
    "A11_unread_counts",
    over("notifications", "SELECT user_id, count(*) FILTER (WHERE read_at IS NULL) AS unread FROM notifications GROUP BY user_id"),
)
def unread_counts(spark, sf):
    return S.unread_counts(V(spark, sf, "notifications"))


@query(
    "A12_source_counts",
    over(
        "observations",
        """SELECT listing_id, CAST(count(DISTINCT source) AS INTEGER) AS source_count,
 array_to_string(list_sort(list(DISTINCT source)), ',') AS sources FROM observations GROUP BY listing_id""",
    ),
)
def source_counts(spark, sf):
    return S.source_counts(V(spark, sf, "observations"))


_SIMILAR = """SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY abs(b.price - a.price), b.id) AS rank,
 b.id AS similar_id, b.price AS similar_price, abs(b.price - a.price) AS gap
 FROM listings a JOIN listings b ON b.id <> a.id AND b.status = 'active' AND a.borough = b.borough
  AND b.bedrooms BETWEEN a.bedrooms - 1 AND a.bedrooms + 1
  AND b.price BETWEEN floor(CAST(a.price AS DOUBLE) * 0.7) AND floor(CAST(a.price AS DOUBLE) * 1.3)"""


@query(
    "J12_similar_listings",
    over("listings", f"SELECT id, CAST(rank AS INTEGER) AS rank, similar_id, similar_price, gap FROM ({_SIMILAR}) WHERE rank <= 5"),
)
def similar_listings(spark, sf):
    return S.similar(V(spark, sf, "listings"))


@query(
    "O03_nearest_price",
    over("listings", f"SELECT id, similar_id FROM ({_SIMILAR}) WHERE rank = 1"),
)
def nearest_price(spark, sf):
    return S.similar(V(spark, sf, "listings"), k=1).select("id", "similar_id")


@query(
    "J03_permit_proximity",
    over(
        "permits listings",
        f"""SELECT l.id AS listing_id, p.id AS permit_id, p.permit_type, {rnd(hav('p.lat', 'p.lng', 'l.lat', 'l.lng', 3959.0), 3)} AS distance_miles
FROM permits p JOIN listings l ON l.status = 'active' AND p.filed_days_ago <= 7
 AND {hav('p.lat', 'p.lng', 'l.lat', 'l.lng', 3959.0)} <= 0.25""",
    ),
)
def permit_proximity(spark, sf):
    return spatial.proximity_alerts(
        V(spark, sf, "permits"), V(spark, sf, "listings"), recent=F.col("filed_days_ago") <= 7
    ).select("listing_id", "permit_id", "permit_type", "distance_miles")


@query(
    "F18_relevant_permit_types",
    over(
        "permits listings",
        f"""SELECT l.id AS listing_id, p.id AS permit_id, p.permit_type
FROM permits p JOIN listings l ON l.status = 'active' AND p.filed_days_ago <= 7 AND p.permit_type IN ('NB', 'A1', 'A2', 'DM')
 AND {hav('p.lat', 'p.lng', 'l.lat', 'l.lng', 3959.0)} <= 0.25""",
    ),
)
def relevant_permit_types(spark, sf):
    return spatial.proximity_alerts(
        V(spark, sf, "permits"), V(spark, sf, "listings"), recent=F.col("filed_days_ago") <= 7,
        types=["NB", "A1", "A2", "DM"],
    ).select("listing_id", "permit_id", "permit_type")


@query(
    "J04_permits_near_point",
    over(
        "permits",
        f"""SELECT id, permit_number FROM permits WHERE {hav('CAST(40.7 AS DOUBLE)', 'CAST(-73.95 AS DOUBLE)', 'lat', 'lng', METERS)} <= 2.0 * 1609.34
ORDER BY filed_days_ago, id LIMIT 100""",
    ),
)
def permits_near_point(spark, sf):
    p = V(spark, sf, "permits").withColumn("filing_date", -F.col("filed_days_ago"))
    return spatial.permits_near(p, 40.7, -73.95, 2.0).select("id", "permit_number")


@query(
    "J05_permits_at_address",
    over(
        "permits",
        "SELECT id, permit_number, address FROM permits WHERE contains(address, '2 RED') ORDER BY filed_days_ago, id LIMIT 50",
    ),
)
def permits_at_address(spark, sf):
    p = V(spark, sf, "permits").withColumn("filing_date", -F.col("filed_days_ago"))
    return spatial.permits_at(p, "2 r_ed%").select("id", "permit_number", "address")


@query(
    "C15_haversine",
    over(
        "listings",
        f"""SELECT borough, count(*) AS n, {rnd(f"avg({hav('lat', 'lng', 'CAST(40.7128 AS DOUBLE)', 'CAST(-74.006 AS DOUBLE)', 3959.0)})", 6)} AS mean_miles
FROM listings WHERE lat IS NOT NULL GROUP BY borough""",
    ),
)
def haversine(spark, sf):
    from ..functions.numbers import py_round

    d = geo.haversine_miles(F.col("lat"), F.col("lng"), F.lit(40.7128), F.lit(-74.006))
    return (
        V(spark, sf, "listings").filter("lat IS NOT NULL").groupBy("borough")
        .agg(F.count(F.lit(1)).alias("n"), py_round(F.avg(d), 6).alias("mean_miles"))
    )


@query(
    "U03_array_inclusion",
    over(
        "listings",
        "SELECT status, count(*) FILTER (WHERE (amenity_bits & 12) = 12) AS hits, count(*) AS n FROM listings GROUP BY status",
    ),
)
def array_inclusion(spark, sf):
    need = F.array(F.lit("doorman"), F.lit("gym"))
    return V(spark, sf, "listings").groupBy("status").agg(
        F.count_if(S.contains_all(F.col("amenities"), need)).alias("hits"), F.count(F.lit(1)).alias("n")
    )


@query(
    "J11_referential_cleanup",
    over(
        "listings notifications",
        """SELECT 'cascade' AS mode, n.id, n.listing_id FROM (SELECT id, user_id, id % 20000 AS listing_id FROM notifications) n
 WHERE n.listing_id IN (SELECT id FROM listings WHERE status = 'active')
UNION ALL SELECT 'set_null', n.id, CASE WHEN n.listing_id IN (SELECT id FROM listings WHERE status = 'active') THEN n.listing_id END
 FROM (SELECT id, user_id, id % 20000 AS listing_id FROM notifications) n""",
    ),
)
def referential_cleanup(spark, sf):
    child = V(spark, sf, "notifications").selectExpr("id", "id % 20000 AS listing_id")
    parent = V(spark, sf, "listings").filter("status = 'active'").select(F.col("id").alias("pid"))
    parts = [
        R.enforce_fk(child, parent, "listing_id", "pid", mode).select(F.lit(mode).alias("mode"), "id", "listing_id")
        for mode in ("cascade", "set_null")
    ]
    return parts[0].unionByName(parts[1])
