"""Tables, pages, feeds, register, normalisation and validation queries."""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import functions as F, types as PT

from ..functions import numbers as N, permit_fields as PF, text as X
from ..operators import normalize as NZ, register as G, scoring as S
from ..session import work_dir
from ..sources import derived as D, geocode as GC, pages as P, permits as PM, registry as R, rendered as RD, tables as TB
from .catalog import over, query, rnd

V = D.view


# --- stored tables ---


@query(
    "S01_table_scan",
    over(
        "listings",
        """SELECT borough, count(*) AS n, CAST(sum(price) AS BIGINT) AS price_sum, min(bathrooms) AS min_baths,
 CAST(sum(bit_count(amenity_bits)) AS BIGINT) AS amenities FROM listings WHERE status = 'active' AND price >= 2000 GROUP BY borough""",
    ),
)
def table_scan(spark, sf):
    """Writes the listings table once, then scans it with its declared schema."""
    base = work_dir(spark, "tables")
    TB.replace_table(V(spark, sf, "listings"), base, "listings", cluster_by=("borough", "price"))
    df = TB.read_table(spark, base, "listings").filter("status = 'active' AND price >= 2000")
    return df.groupBy("borough").agg(
        F.count(F.lit(1)).alias("n"), F.sum("price").alias("price_sum"), F.min("bathrooms").alias("min_baths"),
        F.sum(F.size("amenities")).alias("amenities"),
    )


# --- pages ---

_SHOWN = '''concat(address, CASE id % 10 WHEN 0 THEN ' & Rear' WHEN 1 THEN concat(' caf', chr(233), ' ', chr(8211), ' 5"') WHEN 2 THEN concat(' &lt;b&gt; &nosuch; ', chr(8364)) WHEN 3 THEN chr(127968) ELSE '' END)'''
_PAGE = "id // 20 AS page_id, CAST(id % 20 AS INTEGER) AS pos"
_COLS = ["page_id", "pos", "source_url", "address", "price", "bedrooms", "bathrooms", "sqft", "description", "images", "raw_data"]


def _page_rows(spark, sf, source, keys):
    rows = R.extract(RD.render_pages(V(spark, sf, "listings"), source), source)
    raw = [F.coalesce(F.col("raw_data")[k], F.lit("~")) for k in keys]
    return rows.withColumns({
        "images": F.array_join("images", ","),
        "raw_data": F.concat_ws("|", *raw) if raw else F.lit(""),
    }).select(*_COLS)


@query(
    "S10_streeteasy_cards",
    over(
        "listings",
        f"""SELECT {_PAGE}, CASE WHEN id % 3 = 0 THEN concat('https://streeteasy.com#', {_SHOWN}) ELSE concat('https://streeteasy.com/rental/', id) END AS source_url,
 {_SHOWN} AS address, price, bedrooms, bathrooms, sqft, CAST(NULL AS VARCHAR) AS description,
 concat('https://img/', CASE WHEN id % 2 = 0 THEN 'b' ELSE 'a' END, id, '.jpg') AS images,
 concat(bedrooms, 'BR in ', borough, '|Listed by', status, '|', CASE WHEN id % 4 = 0 THEN 'Base rent' ELSE '' END, '|', CASE WHEN id % 5 = 0 THEN 'No Fee' ELSE '' END) AS raw_data FROM listings""",
    ),
)
def streeteasy_cards(spark, sf):
    return _page_rows(spark, sf, "streeteasy", ("title", "listed_by", "base_rent_tooltip", "price_tag"))


@query(
    "S11_zillow_cards",
    over(
        "listings",
        f"""SELECT {_PAGE}, CASE WHEN id % 7 = 0 THEN concat('https://zillow.com#', {_SHOWN}) ELSE concat('https://www.zillow.com/homedetails/', id) END AS source_url,
 {_SHOWN} AS address, price, bedrooms, bathrooms, sqft, CAST(NULL AS VARCHAR) AS description, concat('https://photos/z', id, '.jpg') AS images, '' AS raw_data FROM listings""",
    ),
)
def zillow_cards(spark, sf):
    return _page_rows(spark, sf, "zillow", ())


_MONEY = "concat('$', format('{:,}', CAST(price AS BIGINT)))"
CRAIGSLIST_SQL = f"""SELECT {_PAGE}, concat('https://newyork.craigslist.org/apt/', id, '.html') AS source_url, {_SHOWN} AS address,
 CASE WHEN id % 9 <> 0 THEN price END AS price, CAST(NULL AS INTEGER) AS bedrooms, CAST(NULL AS DOUBLE) AS bathrooms, CAST(NULL AS INTEGER) AS sqft,
 concat(bedrooms, 'br - ', borough) AS description, '' AS images, concat({_SHOWN}, '|', CASE WHEN id % 9 <> 0 THEN {_MONEY} ELSE '' END) AS raw_data FROM listings"""


@query("S12_craigslist_rows", over("listings", CRAIGSLIST_SQL))
def craigslist_rows(spark, sf):
    return _page_rows(spark, sf, "craigslist", ("title", "price_raw"))


@query(
    "S13_rentcom_embedded_json",
    over(
        "listings",
        f"""SELECT {_PAGE}, concat('https://www.rent.com/h/', id) AS source_url, concat(address, ', ', borough, CASE WHEN id % 4 = 0 THEN '' ELSE ', NY' END) AS address,
 price, bedrooms, bathrooms, CAST(NULL AS INTEGER) AS sqft, CAST(NULL AS VARCHAR) AS description, concat('u', id, ',v', id) AS images,
 concat('Home ', id, '|', coalesce(neighborhood, ''), '|', coalesce(CASE WHEN lat IS NOT NULL THEN rtrim(rtrim(printf('%.3f', id / CAST(8 AS DOUBLE)), '0'), '.') END, '~'),
  '|', CASE WHEN lat IS NOT NULL THEN CAST(-id AS VARCHAR) ELSE '~' END) AS raw_data FROM listings""",
    ),
)
def rentcom_embedded_json(spark, sf):
    df = _page_rows(spark, sf, "rentcom", ("name", "neighborhood", "lat", "lng"))
    return df.withColumn("raw_data", F.regexp_replace("raw_data", r"\.0\|", "|"))


@query(
    "S14_zumper_json_ld",
    over(
        "listings",
        f"""SELECT {_PAGE}, concat('https://www.zumper.com/apt/', id) AS source_url, concat(address, CASE WHEN id % 5 = 0 THEN '' ELSE concat(', ', borough) END) AS address,
 price, bedrooms, bathrooms, sqft, concat('On floor ', id % 9, '.') AS description, concat('i', id, CASE WHEN id % 2 = 0 THEN '' ELSE concat(',j', id, ',k') END) AS images,
 concat('Home ', id) AS raw_data FROM listings WHERE id % 11 <> 0""",
    ),
)
def zumper_json_ld(spark, sf):
    return _page_rows(spark, sf, "zumper", ("name",))


_BLOCK_RX = "(" + "|".join(P.BLOCKED_PHRASES) + ")"


@query(
    "S15_blocked_pages",
    f"""SELECT page_id, regexp_matches(html, '{_BLOCK_RX}') AS blocked FROM
(SELECT page_id, CASE page_id % 20 WHEN 3 THEN concat(html, '<h1>Access Denied</h1>') WHEN 7 THEN concat('<p>unusual traffic</p>', html) ELSE html END AS html FROM pages)""",
)
def blocked_pages(spark, sf):
    shown = D.table(spark, sf, "pages").selectExpr(
        "page_id",
        """CASE page_id % 20 WHEN 3 THEN concat(html, '<h1>Access Denied</h1>') WHEN 7 THEN concat('<p>unusual traffic</p>', html) ELSE html END AS html""",
    )
    return P.flag_blocked(shown).select("page_id", "blocked")


@query("X01_source_registry", "SELECT source, CAST(0 AS BIGINT) AS n FROM (VALUES ('streeteasy'), ('craigslist'), ('zillow'), ('rentcom'), ('zumper')) v(source)")
def source_registry(spark, sf):
    """Every registered source over the general web pages, which hold no cards."""
    web = P.flag_blocked(D.table(spark, sf, "pages")).filter("NOT blocked")
    found = [
        R.extract(web, s).agg(F.count(F.lit(1)).alias("n")).select(F.lit(s).alias("source"), "n") for s in R.source_names()
    ]
    return R.union_sources(found)


class _Rows(HTMLParser):
    """Collects href, title, price and details of result rows."""

    def __init__(self):
        super().__init__()
        self.rows, self.part, self.open = [], None, 0  # open: li elements open within the row, itself included

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        names = (a.get("class") or "").split()
        if tag == "li" and "cl-static-search-result" in names:
            self.rows.append({})
            self.open = 1
        elif not self.open:
            return
        elif tag == "li":
            self.open += 1
        elif tag == "a":
            self.rows[-1].setdefault("href", a.get("href", ""))
        else:
            self.part = next((n for n in names if n in ("title", "price", "details")), self.part)

    def handle_data(self, data):
        if self.rows and self.part:
            self.rows[-1][self.part] = self.rows[-1].get(self.part, "") + data.strip()

    def handle_endtag(self, tag):
        if tag == "div":
            self.part = None
        elif tag == "li" and self.open:
            self.open -= 1


def _parse_rows(html: str):
    p = _Rows()
    p.feed(html)
    for row in p.rows:
        yield lambda row=row: {"title": row["title"], "price_raw": row["price"], "details": row["details"]}


@query(
    "X02_page_parse_hook",
    over(
        "listings",
        f"""SELECT {_PAGE}, CASE WHEN id % 9 <> 0 THEN {_SHOWN} END AS title, CASE WHEN id % 9 <> 0 THEN {_MONEY} END AS price_raw,
 CASE WHEN id % 9 <> 0 THEN concat(bedrooms, 'br - ', borough) END AS details, CASE WHEN id % 9 = 0 THEN 'KeyError' END AS error FROM listings""",
    ),
)
def page_parse_hook(spark, sf):
    fields = PT.StructType([PT.StructField(n, PT.StringType()) for n in ("title", "price_raw", "details")])
    return R.parse_pages(RD.render_pages(V(spark, sf, "listings"), "craigslist"), _parse_rows, fields)


@query(
    "U01_source_union",
    over(
        "listings",
        """SELECT s.source, count(*) AS n, count(price) AS priced, CAST(sum(price) AS BIGINT) AS price_sum FROM
(SELECT unnest(['streeteasy', 'craigslist', 'zillow', 'rentcom', 'zumper']) AS source) s JOIN
(SELECT id, price FROM listings) l ON NOT (s.source = 'zumper' AND l.id % 11 = 0) GROUP BY s.source""".replace(
            "count(price) AS priced, CAST(sum(price) AS BIGINT) AS price_sum",
            "count(*) FILTER (WHERE s.source <> 'craigslist' OR l.id % 9 <> 0) AS priced, CAST(sum(price) FILTER (WHERE s.source <> 'craigslist' OR l.id % 9 <> 0) AS BIGINT) AS price_sum",
        ),
    ),
)
def source_union(spark, sf):
    listings = V(spark, sf, "listings")
    feeds = [R.extract(RD.render_pages(listings, s), s) for s in D.SOURCES]
    return R.union_sources(feeds).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count("price").alias("priced"), F.sum("price").alias("price_sum")
    )


@query(
    "C18_absolute_url",
    """SELECT page_id, CASE WHEN u <> '' AND NOT starts_with(u, 'http') THEN concat('https://www.rent.com', u) ELSE u END AS url
FROM (SELECT page_id, CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN regexp_replace(url, '^https?://[^/]*', '') ELSE url END AS u FROM pages)""",
)
def absolute_url(spark, sf):
    u = F.expr("CASE WHEN page_id % 3 = 0 THEN '' WHEN page_id % 3 = 1 THEN regexp_replace(url, '^https?://[^/]*', '') ELSE url END")
    return D.table(spark, sf, "pages").select("page_id", X.absolutize(u, P.SITES["rentcom"]).alias("url"))


@query("C20_scalar_or_min", "SELECT event_id, CAST(regexp_extract(props, '(\\d+)', 1) AS INTEGER) AS v FROM events")
def scalar_or_min(spark, sf):
    """The same number as scalar, text and object with a minimum."""
    e = D.table(spark, sf, "events").selectExpr("event_id", "regexp_extract(props, '([0-9]+)', 1) AS k").selectExpr(
        "event_id",
        """parse_json(CASE event_id % 3 WHEN 0 THEN k WHEN 1 THEN concat('{"min": ', k, ', "max": 999}') ELSE concat('"', k, ' total"') END) AS v""",
    )
    return e.select("event_id", P.loose_int(P._scalar_or_min(F.col("v"))).alias("v"))


# --- permits ---

_DAY = "1 + filed_days_ago % 28"
FLAT_SQL = f"""flat AS (SELECT id, CASE WHEN id % 7 <> 0 THEN permit_number WHEN id % 14 = 0 THEN '' ELSE concat('S', id) END AS permit_number, address, borough, permit_type,
 CASE WHEN id % 3 <> 0 THEN residential_units END AS residential_units, CAST(id * 1000 AS BIGINT) AS estimated_cost,
 make_timestamp(2024, 3, {_DAY}, CASE WHEN id % 4 = 3 THEN 10 ELSE 0 END, CASE WHEN id % 4 = 3 THEN 20 ELSE 0 END, CASE WHEN id % 4 = 3 THEN 30 ELSE 0 END) AS filed, lat, lng FROM permits)"""


def _flat(spark, sf):
    return PM.parse_flat_permits(RD.flat_permit_rows(V(spark, sf, "permits")))


@query(
    "S05_flat_permits",
    over(
        "permits",
        f"WITH {FLAT_SQL} SELECT permit_number, address, borough, permit_type, residential_units, estimated_cost, CAST(filed AS VARCHAR) AS filed, lat, lng, 'ISSUED' AS status FROM flat",
    ),
)
def flat_permits(spark, sf):
    return _flat(spark, sf).select(
        "permit_number", "address", "borough", "permit_type", "residential_units", "estimated_cost",
        F.col("filing_date").cast("string").alias("filed"), "lat", "lng", "status",
    )


@query(
    "S06_nested_permits",
    over(
        "permits",
        """SELECT permit_number, concat(id // 10, ' Main') AS address, CASE id // 10 % 4 WHEN 0 THEN 'Manhattan' WHEN 1 THEN 'Brooklyn' WHEN 2 THEN 'Queens' ELSE 'Erie' END AS borough,
 permit_type, residential_units, CAST(id AS BIGINT) AS estimated_cost, '2024-03-05 00:00:00' AS filed, CAST(concat('40.', id // 10) AS DOUBLE) AS lat,
 CASE WHEN id // 10 % 3 <> 0 THEN CAST(-73.5 AS DOUBLE) END AS lng FROM permits""",
    ),
)
def nested_permits(spark, sf):
    out = PM.parse_nested_permits(RD.nested_permit_documents(V(spark, sf, "permits")))
    return out.select(
        "permit_number", "address", "borough", "permit_type", "residential_units", "estimated_cost",
        F.col("filing_date").cast("string").alias("filed"), "lat", "lng",
    )


def _newest():
    return [F.col("filing_date").desc(), F.col("permit_number"), F.col("estimated_cost")]


_SINCE = f"""{FLAT_SQL}, feed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY borough ORDER BY filed DESC, permit_number, estimated_cost) AS rn
 FROM flat WHERE filed >= TIMESTAMP '2024-03-10') WHERE permit_number <> '')"""


def _since(spark, sf):
    return PM.permits_since(_flat(spark, sf), F.col("filing_date") >= F.to_timestamp(F.lit("2024-03-10")), _newest())


@query("S07_incremental_permits", over("permits", f"WITH {_SINCE} SELECT permit_number, borough, CAST(filed AS VARCHAR) AS filed FROM feed"))
def incremental_permits(spark, sf):
    return _since(spark, sf).select("permit_number", "borough", F.col("filing_date").cast("string").alias("filed"))


_STORED = "SELECT permit_number FROM permits WHERE permit_type = 'NB'"
_FRESH = f"""{_SINCE}, twice AS (SELECT * FROM feed UNION ALL SELECT * FROM feed),
fresh AS (SELECT DISTINCT permit_number, borough, CASE WHEN coalesce(lat, 0) <> 0 AND coalesce(lng, 0) <> 0 THEN lat END AS lat FROM feed
 WHERE permit_number NOT IN ({_STORED}))"""


def _twice(spark, sf):
    """A batch in which every permit occurs twice, against stored new-building permits."""
    feed = _since(spark, sf)
    return V(spark, sf, "permits").filter("permit_type = 'NB'"), feed.unionByName(feed)


@query("S08_insert_if_absent", over("permits", f"WITH {_FRESH} SELECT * FROM fresh"))
def insert_if_absent(spark, sf):
    target, batch = _twice(spark, sf)
    return PM.new_permits(target, batch, _newest()).select("permit_number", "borough", "lat")


@query("A07_ingest_counts", over("permits", f"WITH {_FRESH} SELECT (SELECT count(*) FROM fresh) AS new_permits, (SELECT count(*) FROM twice) - (SELECT count(*) FROM fresh) AS duplicates_skipped"))
def ingest_counts(spark, sf):
    target, batch = _twice(spark, sf)
    return PM.ingest_counts(batch, PM.new_permits(target, batch, _newest()))


@query("J10_new_permit_anti_join", over("permits", f"SELECT id, permit_number FROM permits WHERE permit_number NOT IN ({_STORED})"))
def new_permit_anti_join(spark, sf):
    p = V(spark, sf, "permits")
    return p.join(p.filter("permit_type = 'NB'").select("permit_number"), "permit_number", "left_anti").select("id", "permit_number")


@query("C12_lenient_numbers", """SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE CAST(trunc(value) AS BIGINT) END AS i,
 CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS f FROM events""")
def lenient_numbers(spark, sf):
    t = F.expr("CASE WHEN event_id % 3 = 0 THEN concat(value, ' USD') ELSE concat(' ', value) END")
    return D.table(spark, sf, "events").select("event_id", N.safe_int(t).alias("i"), N.safe_float(t).alias("f"))


@query(
    "C13_multi_format_dates",
    """SELECT event_id, CASE event_id % 5 WHEN 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') WHEN 1 THEN strftime(ts, '%Y-%m-%d %H:%M:%S')
 WHEN 2 THEN strftime(ts, '%Y-%m-%d 00:00:00') WHEN 3 THEN strftime(ts, '%Y-%m-%d 00:00:00') END AS parsed FROM events""",
)
def multi_format_dates(spark, sf):
    text = F.expr(
        """CASE event_id % 5 WHEN 0 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS") WHEN 1 THEN date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
 WHEN 2 THEN date_format(ts, 'yyyy-MM-dd') WHEN 3 THEN date_format(ts, 'MM/dd/yyyy') ELSE date_format(ts, 'dd.MM.yyyy') END"""
    )
    parsed = F.date_trunc("second", PF.parse_date(text))
    return D.table(spark, sf, "events").select("event_id", parsed.cast("string").alias("parsed"))


@query(
    "C14_borough_codes",
    over(
        "listings",
        """SELECT id, CASE WHEN id % 3 = 0 THEN 'Kings County' WHEN borough = 'Brooklyn' THEN 'Brooklyn' WHEN borough = 'Manhattan' THEN 'Manhattan' ELSE upper(borough) END AS from_county,
 CASE WHEN id % 3 = 0 THEN '9' ELSE borough END AS from_code, CASE borough WHEN 'Bronx' THEN '2' WHEN 'Brooklyn' THEN '3' WHEN 'Queens' THEN '4' WHEN 'Staten Island' THEN '5' ELSE '1' END AS code
FROM listings""".replace("ELSE upper(borough) END AS from_county", "WHEN borough = 'Staten Island' THEN 'Staten Island' ELSE borough END AS from_county"),
    ),
)
def borough_codes(spark, sf):
    county = F.expr(
        """CASE WHEN id % 3 = 0 THEN 'Kings County' WHEN borough = 'Brooklyn' THEN 'kings' WHEN borough = 'Manhattan' THEN 'New York'
 WHEN borough = 'Staten Island' THEN 'RICHMOND' ELSE borough END"""
    )
    code = F.expr("CASE WHEN id % 3 = 0 THEN '9' ELSE concat(' ', borough) END")
    return V(spark, sf, "listings").select(
        "id", PF.borough_from_county(county).alias("from_county"), PF.borough_from_code(code).alias("from_code"),
        PF.borough_code(F.col("borough")).alias("code"),
    )


# --- register ---


def _chunks(spark, sf):
    """Three chunks with own headers and dirt, plus one that is no register table."""
    r = V(spark, sf, "register")
    base = r.selectExpr(
        "id",
        "if(id % 15 = 0, concat(' ', zip_code), zip_code) AS ZIP", "concat(building_number, ' ') AS BLDGNO1", "street_name AS STREET1",
        "'  ' AS STSUFX1", "cast(null as string) AS BLDGNO2", "'' AS STREET2", "'' AS STSUFX2", "if(id % 2 = 0, 'NEW YORK', ' ') AS CITY",
        "'62' AS COUNTY", "'MULTIPLE DWELLING A' AS STATUS1", "cast(null as string) AS STATUS2", "cast(null as string) AS STATUS3",
        "if(id % 33 = 0, 'n/a', cast(block as string)) AS BLOCK", "cast(lot as string) AS LOT",
    )
    header = spark.range(1).select(*[F.lit(c).alias(c) for c in G.REGISTER_COLUMNS])
    a = base.filter("id % 3 = 0").drop("id").unionByName(header)
    b = base.filter("id % 3 = 1").drop("id", "STATUS3")
    c = base.filter("id % 3 = 2").drop("id")
    c = c.select(*reversed(c.columns))
    c = c.toDF(*[f" {n.lower()} " for n in c.columns])
    junk = r.select("id", "zip_code")
    return [a, b, c, junk]


_REG_ROWS = "register"


@query("S02_register_union", over("register", "SELECT count(*) + 1 AS n, count(DISTINCT zip_code) + 1 + (SELECT count(DISTINCT zip_code) FROM register WHERE id % 15 = 0) - (SELECT count(DISTINCT zip_code) FROM register WHERE id % 15 = 0 AND zip_code NOT IN (SELECT zip_code FROM register WHERE id % 15 <> 0)) AS zips, count(*) + 1 AS named FROM register"))
def register_union(spark, sf):
    return G.union_register_chunks(_chunks(spark, sf)).agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("ZIP").alias("zips"), F.count("BLDGNO1").alias("named")
    )


_CLEAN = """clean AS (SELECT * FROM (SELECT *, concat('1', lpad(CAST(block AS VARCHAR), 5, '0'), lpad(CAST(lot AS VARCHAR), 4, '0')) AS bbl,
 row_number() OVER (PARTITION BY block, lot ORDER BY zip_code, building_number, street_name) AS rn
 FROM register WHERE id % 15 <> 0 AND id % 33 <> 0) WHERE rn = 1)"""


@query("S03_register_clean", over("register", f"WITH {_CLEAN} SELECT zip_code AS \"ZIP\", building_number AS \"BLDGNO1\", street_name AS \"STREET1\", block AS \"BLOCK\", lot AS \"LOT\", bbl AS \"BBL\" FROM clean"))
def register_clean(spark, sf):
    return G.clean_register(G.union_register_chunks(_chunks(spark, sf))).select(
        "ZIP", "BLDGNO1", "STREET1", "BLOCK", "LOT", "BBL"
    )


@query("S04_register_reload", over("register", f"WITH {_CLEAN} SELECT city, county_code, status1, count(*) AS n FROM (SELECT 'NEW YORK' AS city, 62 AS county_code, 'MULTIPLE DWELLING A' AS status1 FROM clean) GROUP BY ALL"))
def register_reload(spark, sf):
    path = work_dir(spark, "register")
    G.reload_register(G.clean_register(G.union_register_chunks(_chunks(spark, sf))), path)
    return spark.read.parquet(path).groupBy("city", "county_code", "status1").agg(F.count(F.lit(1)).alias("n"))


@query("U02_chunk_union", over("register", "SELECT zip_code, count(*) AS n FROM register WHERE id % 15 <> 0 GROUP BY zip_code"))
def chunk_union(spark, sf):
    u = G.union_register_chunks(_chunks(spark, sf)).filter(F.col("ZIP").rlike(r"^\d{5}$"))
    return u.groupBy(F.col("ZIP").alias("zip_code")).agg(F.count(F.lit(1)).alias("n"))


@query("C11_bbl", over("register", "SELECT id, concat('1', CASE WHEN length(b) < 5 THEN lpad(b, 5, '0') ELSE b END, lpad(CAST(lot AS VARCHAR), 4, '0')) AS bbl FROM (SELECT *, CAST(block * 1000 AS VARCHAR) AS b FROM register)"))
def bbl(spark, sf):
    return V(spark, sf, "register").select("id", PF.bbl(F.col("block") * 1000, F.col("lot")).alias("bbl"))


@query("W07_dedup", over("register", "SELECT block, lot, min(id) AS id FROM register GROUP BY block, lot"))
def dedup(spark, sf):
    r = V(spark, sf, "register").select("block", "lot", "id")
    return G.dedup(r, ["block", "lot"], ["id"])


# --- geocoding ---

_GEO = "g AS (SELECT address, min(id) AS n FROM listings GROUP BY address)"


@query(
    "S16_geocode_flatten",
    over(
        "listings",
        f"""WITH {_GEO} SELECT address, CASE WHEN n % 10 <> 0 THEN 40 + (n % 100) / CAST(100 AS DOUBLE) END AS lat, CASE WHEN n % 10 <> 0 THEN concat('zone', n % 5) END AS neighborhood,
 CASE WHEN n % 10 <> 0 THEN '' END AS borough, CASE WHEN n % 10 <> 0 THEN CAST(10001 + n AS VARCHAR) END AS zip_code,
 CASE WHEN n % 10 <> 0 THEN 40 + (n % 100) / CAST(100 AS DOUBLE) BETWEEN 40.4774 AND 40.9176 END AS valid_nyc FROM g""",
    ),
)
def geocode_flatten(spark, sf):
    out = GC.flatten_geocode(RD.geocode_responses(V(spark, sf, "listings")))
    return out.select("address", "lat", "neighborhood", "borough", "zip_code", "valid_nyc")


@query(
    "S16_geocode_enrich",
    over(
        "listings",
        f"""WITH {_GEO} SELECT l.id, CASE WHEN l.id % 23 <> 0 AND n % 4 <> 0 AND n % 10 <> 0 THEN concat('zone', n % 5) END AS zone,
 CASE WHEN l.id % 23 <> 0 THEN concat('geocode:', md5(lower(trim(l.address)))) END AS key FROM listings l JOIN g ON l.address = g.address""",
    ),
)
def geocode_enrich(spark, sf):
    # the addresses of every fourth response were cached too long ago
    listings = V(spark, sf, "listings")
    now = F.lit(40 * 86400)
    flat = GC.flatten_geocode(RD.geocode_responses(listings)).filter("lat IS NOT NULL")
    cache = flat.withColumn("key", GC.geocode_key(F.col("address"))).withColumn(
        "cached_at", F.when(F.col("n") % 4 == 0, 86400).otherwise(20 * 86400)
    )
    asked = listings.withColumn("address", F.when(F.col("id") % 23 == 0, "").otherwise(F.concat(F.lit(" "), F.upper("address"))))
    return GC.enrich_geocode(asked, cache, now).select("id", F.col("geo.neighborhood").alias("zone"), "key")


# --- normalisation ---

#: Some texts hold a no-break space, which counts as a blank.
_RAW = {
    "address": """CASE id % 8 WHEN 0 THEN upper(address) WHEN 1 THEN concat(address, ' Apt 4B') WHEN 2 THEN concat(address, ', Unit #5')
 WHEN 3 THEN concat('  ', CAST(id AS string), ' ocean   parkway ') WHEN 4 THEN concat(CAST(id AS string), ' o''brien-lopez BLVD., suite 9') WHEN 5 THEN ''
 WHEN 6 THEN concat('22ND STR & ', address) ELSE address END""",
    "price": """CASE id % 6 WHEN 0 THEN concat('$', CAST(price AS string), '.99') WHEN 1 THEN concat('from $', CAST(price AS string), '/mo') WHEN 2 THEN 'call'
 WHEN 3 THEN ',' WHEN 4 THEN concat('1,', CAST(100 + price % 900 AS string)) ELSE '' END""",
    "bedrooms": """CASE id % 7 WHEN 0 THEN 'Studio' WHEN 1 THEN concat(CAST(bedrooms AS string), ' Beds') WHEN 2 THEN concat(CAST(bedrooms AS string), 'br') WHEN 3 THEN ' 2.5 '
 WHEN 4 THEN 'loft' WHEN 5 THEN NULL ELSE concat(CAST(bedrooms AS string), chr(160), 'br') END""",
    "bathrooms": """CASE id % 5 WHEN 0 THEN concat(CAST(1 + id % 3 AS string), '.5 baths') WHEN 1 THEN concat(CAST(1 + id % 3 AS string), ' BA') WHEN 2 THEN concat(CAST(1 + id % 3 AS string), chr(160))
 WHEN 3 THEN concat(CAST(1 + id % 3 AS string), chr(160), 'bath') ELSE if(id % 2 = 0, 'none', '') END""",
    "sqft": """CASE id % 5 WHEN 0 THEN concat('1,', CAST(100 + id % 900 AS string), ' sq. ft.') WHEN 1 THEN concat(CAST(100 + id % 900 AS string), 'SF') WHEN 2 THEN concat(' ', CAST(id AS string))
 WHEN 3 THEN concat(CAST(100 + id % 900 AS string), chr(160), 'sqft') ELSE if(id % 2 = 0, 'large', NULL) END""",
}
_RAW_LIST = ", ".join(f"{e} AS {c}" for c, e in _RAW.items())
_RAW_SQL = f"raw AS (SELECT id, borough AS source, {_RAW_LIST} FROM listings)"


def _raw(spark, sf):
    return V(spark, sf, "listings").selectExpr("id", "borough AS source", *[f"{e} AS {c}" for c, e in _RAW.items()])


_ORD_LOWER = "regexp_replace(regexp_replace(regexp_replace(regexp_replace({x}, '\\b(\\d+)st\\b', '\\1st', 'gi'), '\\b(\\d+)nd\\b', '\\1nd', 'gi'), '\\b(\\d+)rd\\b', '\\1rd', 'gi'), '\\b(\\d+)th\\b', '\\1th', 'gi')"
_MAP = "map([" + ", ".join(f"'{k}'" for k in X.STREET_TYPES) + "], [" + ", ".join(f"'{v}'" for v in X.STREET_TYPES.values()) + "])"
_UNIT = X.UNIT_SUFFIX.replace("(?i)", "")


def _clean_sql(a: str) -> str:
    stripped = f"regexp_replace(regexp_replace({a}, '^\\s+|\\s+$', '', 'g'), '{_UNIT}', '', 'i')"
    words = f"list_filter(string_split_regex({_ORD_LOWER.replace('{x}', stripped)}, '\\s+'), lambda w: w <> '')"
    typed = f"array_to_string(list_transform({words}, lambda w: coalesce({_MAP}[lower(trim(w, '.,'))], w)), ' ')"
    titled = f"array_to_string(list_transform(regexp_extract_all({typed}, '([A-Za-z]+|[^A-Za-z]+)'), lambda t: upper(t[1]) || lower(t[2:])), '')"
    return _ORD_LOWER.replace("{x}", titled)


_PRICE_SQL = "CAST(trunc(TRY_CAST(nullif(replace(regexp_extract(price, '\\$?\\s*([\\d,]+(?:\\.\\d{2})?)', 1), ',', ''), '') AS DOUBLE) * 100) AS BIGINT)"
_BED_SQL = """CASE WHEN length(bedrooms) > 0 THEN CASE WHEN regexp_matches(bedrooms, '(?i)\\bstudio\\b') THEN 0.0
 ELSE coalesce(TRY_CAST(nullif(regexp_extract(bedrooms, '(\\d+)[\\s\\x{A0}]*(?:bed(?:room)?s?|br|bd)', 1, 'i'), '') AS DOUBLE), TRY_CAST(trim(bedrooms, concat(' ', chr(160))) AS DOUBLE)) END END"""
_BATH_SQL = """CASE WHEN length(bathrooms) > 0 THEN coalesce(TRY_CAST(nullif(regexp_extract(bathrooms, '([\\d.]+)[\\s\\x{A0}]*(?:bath(?:room)?s?|ba)', 1, 'i'), '') AS DOUBLE),
 TRY_CAST(trim(bathrooms, concat(' ', chr(160))) AS DOUBLE)) END"""
_SQFT_SQL = """CASE WHEN length(sqft) > 0 THEN coalesce(TRY_CAST(nullif(replace(regexp_extract(sqft, '([\\d,]+)[\\s\\x{A0}]*(?:sq\\.?[\\s\\x{A0}]*ft\\.?|sf|sqft)', 1, 'i'), ',', ''), '') AS INTEGER),
 TRY_CAST(replace(trim(sqft, concat(' ', chr(160))), ',', '') AS INTEGER)) END"""
_NORM = f"""{_RAW_SQL}, norm AS (SELECT id, source, {_clean_sql('address')} AS address_clean, {_PRICE_SQL} AS price_cents, CAST({_BED_SQL} AS DOUBLE) AS bedrooms,
 {_BATH_SQL} AS bathrooms, {_SQFT_SQL} AS sqft FROM raw)"""


@query("C01_clean_address", over("listings", f"WITH {_RAW_SQL} SELECT id, {_clean_sql('address')} AS address_clean FROM raw"))
def clean_address(spark, sf):
    return _raw(spark, sf).select("id", X.clean_address(F.col("address")).alias("address_clean"))


@query("C04_price_cents", over("listings", f"WITH {_RAW_SQL} SELECT id, {_PRICE_SQL} AS price_cents FROM raw"))
def price_cents(spark, sf):
    return _raw(spark, sf).select("id", X.parse_price_cents(F.col("price")).alias("price_cents"))


@query(
    "C05_price_dollars",
    over("listings", f"WITH {_RAW_SQL} SELECT id, TRY_CAST(nullif(replace(regexp_extract(price, '[$]?\\s*([\\d,]+)', 1), ',', ''), '') AS INTEGER) AS price FROM raw"),
)
def price_dollars(spark, sf):
    return _raw(spark, sf).select("id", X.parse_price_dollars(F.col("price")).alias("price"))


@query("C06_bedrooms_text", over("listings", f"WITH {_RAW_SQL} SELECT id, CAST({_BED_SQL} AS DOUBLE) AS bedrooms FROM raw"))
def bedrooms_text(spark, sf):
    return _raw(spark, sf).select("id", X.parse_bedrooms(F.col("bedrooms")).alias("bedrooms"))


@query("C07_bathrooms_text", over("listings", f"WITH {_RAW_SQL} SELECT id, {_BATH_SQL} AS bathrooms FROM raw"))
def bathrooms_text(spark, sf):
    return _raw(spark, sf).select("id", X.parse_bathrooms(F.col("bathrooms")).alias("bathrooms"))


@query("C08_sqft_text", over("listings", f"WITH {_RAW_SQL} SELECT id, {_SQFT_SQL} AS sqft FROM raw"))
def sqft_text(spark, sf):
    return _raw(spark, sf).select("id", X.parse_sqft(F.col("sqft")).alias("sqft"))


@query(
    "C09_loose_numbers",
    over(
        "listings",
        f"""WITH {_RAW_SQL} SELECT id, CASE WHEN regexp_matches(bedrooms, '(?i)\\bstudio\\b') THEN 0 ELSE TRY_CAST(nullif(replace(regexp_extract(bedrooms, '([\\d,]+)', 1), ',', ''), '') AS INTEGER) END AS i,
 TRY_CAST(nullif(regexp_extract(bathrooms, '([\\d.]+)', 1), '') AS DOUBLE) AS f FROM raw""",
    ),
)
def loose_numbers(spark, sf):
    return _raw(spark, sf).select("id", X.parse_int(F.col("bedrooms")).alias("i"), X.parse_float(F.col("bathrooms")).alias("f"))


_HASH = "sha256(concat(source, '|', lower(address_clean), '|', coalesce(CAST(bedrooms AS VARCHAR), 'none')))"


@query("C02_canonical_hash", over("listings", f"WITH {_NORM} SELECT id, {_HASH} AS canonical_hash FROM norm"))
def canonical_hash(spark, sf):
    return NZ.normalize_listings(_raw(spark, sf)).select("id", "canonical_hash")


@query("C03_source_key", "SELECT page_id, sha256(concat('zillow', ':', url)) AS canonical_key FROM pages")
def source_key(spark, sf):
    return D.table(spark, sf, "pages").select(
        "page_id", X.canonical_key(F.lit("zillow"), F.col("url")).alias("canonical_key")
    )


@query(
    "C10_normalize_listings",
    over("listings", f"WITH {_NORM} SELECT *, {_HASH} AS canonical_hash, CAST(id AS VARCHAR) AS extra_id FROM norm"),
)
def normalize_listings(spark, sf):
    return NZ.normalize_listings(_raw(spark, sf)).select(
        "id", "source", "address_clean", "price_cents", "bedrooms", "bathrooms", "sqft", "canonical_hash",
        F.col("extra")["id"].alias("extra_id"),
    )
