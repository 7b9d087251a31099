"""Listings rendered as result pages and feed rows, for round-trip queries and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import pages as P

PER_PAGE = 20

# The address as shown: some carry character references that have to be decoded once.
SHOWN = """concat(address, CASE id % 10 WHEN 0 THEN ' &amp; Rear' WHEN 1 THEN ' caf&eacute; &#8211; 5&#x22;' WHEN 2 THEN ' &amp;lt;b&amp;gt; &nosuch; &#128;' WHEN 3 THEN ' <b>&#x1F3E0;</b>' ELSE '' END)"""
# Elements within elements of the same name, closed one by one.
NESTED = "concat('<span><span>', substring({0}, 1, 1), '</span><span></span></span>', substring({0}, 2))"
PRICE = "concat('$', format_number(price, 0))"
PRICE_IN = f"if(id % 2 = 0, {PRICE}, {NESTED.format(PRICE)})"

CARDS = {
    "streeteasy": f"""concat(
 if(id % 2 = 0, '<div data-testid="listing-card">', '<div class="card" data-testid=''listing-card''>'),
 if(id % 6 = 1, '<div title="a > b"><div><div></div>photo</div></div><div/>', ''), '<p class="{P.SE_TITLE}">', bedrooms, 'BR in ', borough, '</p>',
 if(id % 3 = 0, concat('<a class="{P.SE_ADDRESS}">', {SHOWN}, '</a>'),
   concat('<a href="https://streeteasy.com/rental/', id, '" class="x {P.SE_ADDRESS}"> ', {SHOWN}, ' </a>')),
 '<span class="{P.SE_PRICE}">', {PRICE_IN}, '</span>',
 if(id % 4 = 0, '<button class="{P.SE_BASE_RENT}">Base rent</button>', ''),
 if(id % 5 = 0, '<div class="{P.SE_PRICE_TAG}"><span data-testid="tag-text">No Fee</span></div>', ''),
 '<ul class="{P.SE_FACTS}"><li><span class="{P.SE_FACT}">', if(bedrooms = 0, 'Studio', concat(bedrooms, ' beds')), '</span></li>',
 '<li><span class="{P.SE_FACT}">', bathrooms, ' baths</span></li>',
 if(sqft IS NULL, '', concat('<li><span class="{P.SE_FACT}">', format_number(sqft, 0), ' ft²</span></li>')), '</ul>',
 '<p class="{P.SE_LISTED_BY}">Listed by <b>', status, '</b></p>',
 '<img class="{P.SE_IMAGE}" src="https://img/a', id, '.jpg"/>',
 if(id % 2 = 0, concat('<img src="https://img/b', id, '.jpg" class="{P.SE_IMAGE} {P.SE_ACTIVE_IMAGE}"/>'), ''), '</div>')""",
    "zillow": f"""concat('<article data-test="property-card">',
 if(id % 7 = 0, '', concat('<a data-test="property-card-link" href="', if(id % 2 = 0, 'https://www.zillow.com', ''), '/homedetails/', id, '">')),
 '<img src="https://photos/z', id, '.jpg" data-test="property-card-img"/></a>',
 '<address data-test="property-card-addr">', {SHOWN}, '</address>',
 '<span data-test="property-card-price">', {PRICE_IN}, '/mo</span><abbr aria-label="', bedrooms, ' bedrooms">', bedrooms, ' bd</abbr>',
 '<abbr aria-label="', bathrooms, ' bathrooms">', bathrooms, ' ba</abbr>',
 if(sqft IS NULL, '', concat('<abbr aria-label="', sqft, ' sqft">', format_number(sqft, 0), ' sqft</abbr>')), '</article>')""",
    "craigslist": f"""concat('<li class="cl-static-search-result"><a href="', if(id % 2 = 0, '', 'https://newyork.craigslist.org'), '/apt/', id, '.html">',
 '<div class="title">', if(id % 4 = 0, concat('<div><div>', {SHOWN}, '</div></div>'), {SHOWN}), '</div>', if(id % 9 = 0, '', concat('<div class="price">', {PRICE}, '</div>')), if(id % 4 = 1, '<ul><li>a</li><li>b</li></ul>', ''),
 '<div class="details">', bedrooms, 'br - ', borough, '</div></a></li>')""",
    "rentcom": """concat('{"name": "Home ', id, '", "address": "', address, '", "city": "', borough, if(id % 4 = 0, '"', '", "state": "NY"'),
 if(id % 3 = 0, concat(', "price": ', price), if(id % 3 = 1, concat(', "rent": {"min": ', price, ', "max": ', price + 500, '}'), concat(', "rent": "$', format_number(price, 0), '"'))),
 if(id % 2 = 0, concat(', "beds": ', bedrooms, ', "baths": ', bathrooms), concat(', "bedrooms": {"min": ', bedrooms, '}, "bathrooms": {"min": ', bathrooms, '}')),
 ', "neighborhood": ', if(neighborhood IS NULL, 'null', concat('"', neighborhood, '"')), ', "url": "', if(id % 2 = 0, 'https://www.rent.com', ''), '/h/', id, '"',
 if(lat IS NULL, '', concat(', "latitude": ', cast(id as double) / 8, ', "longitude": ', -id)), ', "images": [{"url": "u', id, '"}, "v', id, '"]}')""",
    "zumper": """concat('{"@type": "ListItem", "item": {"@type": "Apartment", "name": "Home ', id, '", "url": "', if(id % 2 = 0, 'https://www.zumper.com', ''), '/apt/', id, '",',
 if(id % 11 = 0, '"address": {}', if(id % 5 = 0, concat('"address": "', address, '"'), concat('"address": {"streetAddress": "', address, '", "addressLocality": "', borough, '"}'))),
 ', "numberOfBedrooms": ', bedrooms, ', "numberOfBathroomsTotal": "', bathrooms, ' baths"',
 if(sqft IS NULL, '', if(id % 2 = 0, concat(', "floorSize": {"value": ', sqft, '}'), concat(', "floorSize": "', format_number(sqft, 0), ' sf"'))),
 if(id % 3 = 0, concat(', "offers": [{"price": ', price, '}]'), if(id % 3 = 1, concat(', "offers": {"lowPrice": ', price, '}'), concat(', "offers": {"price": "', price, '"}'))),
 if(id % 2 = 0, concat(', "image": "i', id, '"'), concat(', "image": [{"contentUrl": "i', id, '"}, {"url": "j', id, '"}, "k"]')),
 if(lat IS NULL, '', concat(', "geo": {"latitude": ', cast(id as double) / 8, ', "longitude": ', -id, '}')), ', "description": "On floor ', id % 9, '."}}')""",
}
FRAMES = {
    # what follows the last card looks like the parts that a card may lack
    "streeteasy": (
        "<!-- page --><html><body>", "",
        f"""<div class="footer"><button class="{P.SE_BASE_RENT}">Footer</button><div class="{P.SE_PRICE_TAG}"><span data-testid="tag-text">Footer</span></div>
<ul class="{P.SE_FACTS}"><li><span class="{P.SE_FACT}">9 beds</span></li></ul><img class="{P.SE_IMAGE} {P.SE_ACTIVE_IMAGE}" src="footer.jpg"/></div></body></html>""",
    ),
    "zillow": ("<html><body>", "\n", '<a data-test="property-card-link" href="/footer"></a><abbr aria-label="99 sqft">99 sqft</abbr></body></html>'),
    "craigslist": ("<html><body><ol>", "\n", '<li><div class="price">$1</div></li></ol></body></html>'),
    "rentcom": (
        '<html><body><script id="__NEXT_DATA__" type="application/json">{"props": {"pageProps": {"listings": [',
        ", ",
        "]}}}</script></body></html>",
    ),
    "zumper": (
        '<html><head><script type="application/ld+json">{"@type": "ItemList", "itemListElement": [',
        ", ",
        ']}</script><script type="application/ld+json">{broken</script></head></html>',
    ),
}


def render_pages(listings: DataFrame, source: str) -> DataFrame:
    """Result pages of one source, twenty listings in id order on each.

    Listings are shuffled before their cards are made, as their rows are much smaller. The given number of partitions
    keeps the tasks that read the pages even: their work is far more than the size of the shuffle tells.
    """
    head, sep, tail = FRAMES[source]
    tasks = int(listings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        listings.withColumn("page_id", (F.col("id") / PER_PAGE).cast("bigint")).repartition(tasks, "page_id")
        .select("page_id", "id", F.expr(CARDS[source]).alias("card"))
        .groupBy("page_id")
        .agg(F.array_sort(F.collect_list(F.struct("id", "card"))).alias("cards"))
        .select(
            "page_id",
            F.concat(F.lit(head), F.array_join(F.col("cards.card"), sep), F.lit(tail)).alias("html"),
        )
    )


FLAT_PERMIT = """to_json(named_struct(
 'job__', if(id % 7 = 0, '', permit_number), 'permit_si_no', if(id % 14 = 0, NULL, concat('S', id)),
 'house__', split(address, ' ')[0], 'street_name', concat(substring(address, locate(' ', address) + 1), ' '),
 'borough', if(id % 2 = 0, upper(borough), CASE borough WHEN 'Manhattan' THEN '1' WHEN 'Bronx' THEN '2' WHEN 'Brooklyn' THEN '3' WHEN 'Queens' THEN '4' ELSE ' 5' END),
 'permit_type', permit_type, 'residential', if(id % 3 = 0, 'n/a', concat(residential_units, '.7')), 'estimated_job_cost', concat(id * 1000, ''),
 'filing_date', CASE id % 4 WHEN 0 THEN concat('2024-03-', lpad(1 + filed_days_ago % 28, 2, '0'), 'T00:00:00.000') WHEN 1 THEN concat('2024-03-', lpad(1 + filed_days_ago % 28, 2, '0'))
   WHEN 2 THEN concat('03/', lpad(1 + filed_days_ago % 28, 2, '0'), '/2024') ELSE concat('2024-03-', lpad(1 + filed_days_ago % 28, 2, '0'), 'T10:20:30') END,
 'issuance_date', if(id % 5 = 0, 'soon', NULL), 'filing_status', 'ISSUED', 'gis_latitude', cast(lat as string), 'gis_longitude', cast(lng as string)))"""


def flat_permit_rows(permits: DataFrame) -> DataFrame:
    return permits.selectExpr("id", f"{FLAT_PERMIT} AS json")


def nested_permit_documents(permits: DataFrame) -> DataFrame:
    """Property documents of up to ten permits each."""
    permit = """named_struct('permitNumber', permit_number, 'permitType', permit_type, 'residentialUnits', residential_units,
      'estimatedCost', concat(id, '.5'), 'filingDate', '2024-03-05', 'status', 'OPEN')"""
    return (
        permits.selectExpr("CAST(id / 10 AS bigint) AS doc", f"{permit} AS p", "id")
        .groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("id", "p"))).alias("ps"))
        .selectExpr(
            """to_json(named_struct('property', array(named_struct(
 'address', named_struct('oneLine', concat(doc, ' Main'), 'countrySubd', element_at(array('New York', 'kings', 'Queens', 'Erie'), cast(doc % 4 as int) + 1),
   'latitude', concat('40.', doc), 'longitude', if(doc % 3 = 0, NULL, '-73.5')),
 'building', named_struct('permits', ps.p))))) AS json"""
        )
    )


def geocode_responses(listings: DataFrame) -> DataFrame:
    """One stored response per distinct address."""
    body = """CASE WHEN n % 10 = 0 THEN '{"status": "ZERO_RESULTS", "results": []}' ELSE concat(
 '{"status": "OK", "results": [{"formatted_address": "', address, ', NY", "geometry": {"location": {"lat": ', 40 + (n % 100) / 100.0D, ', "lng": -73.9}},',
 '"address_components": [{"long_name": "zone', n % 5, '", "types": ["neighborhood", "political"]}, {"long_name": "x", "types": []},',
 '{"long_name": "', 10001 + n, '", "types": ["postal_code"]}]}, {"formatted_address": "other"}]}') END"""
    return listings.groupBy("address").agg(F.min("id").alias("n")).selectExpr("address", "n", f"{body} AS json")
