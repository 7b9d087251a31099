"""Sightings, events, matching, limiter, messages and monitoring queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.numbers import py_round
from ..operators import events as E, health as H, limiter as L, matching as M, messages as T
from ..session import stored, work_dir
from ..sources import derived as D, tables
from ..sources.keyed import KeyedRuns
from .catalog import METERS, amenity_text, hav, over, query, rnd

V = D.view
ORDER = ("scraped_sec", "l_linenumber", "l_suppkey", "l_partkey")
ORD = ", ".join(ORDER)
AT = f"({ORD})"
NOW_SEC = (6 * 372 + 10 * 31 + 4) * 2160
GAP = 172800


def changes(spark: SparkSession, sf: str) -> DataFrame:
    return E.detect_changes(V(spark, sf, "observations"), order=ORDER)


CHANGES_SQL = f"""steps AS (SELECT *, lag(price) OVER w AS previous_price, lag(scraped_sec) OVER w AS previous_time
 FROM observations WINDOW w AS (PARTITION BY listing_id ORDER BY {ORD})),
changes AS (SELECT *, CASE WHEN price < previous_price THEN 'price_drop' WHEN price > previous_price THEN 'price_increase' END AS price_change,
 CASE WHEN previous_time IS NULL THEN 'listed' WHEN scraped_sec - previous_time > {GAP} THEN 'relisted'
  WHEN price < previous_price THEN 'price_drop' WHEN price > previous_price THEN 'price_increase' END AS event_type FROM steps)"""


def with_changes(body: str, views: str = "observations") -> str:
    return over(views, f"WITH {CHANGES_SQL} {body}" if not body.startswith(",") else f"WITH {CHANGES_SQL}{body}")


KEYS = ["listing_id", "source", *ORDER]


@query(
    "W01_price_change_events",
    with_changes(f"SELECT listing_id, source, {ORD}, price, previous_price, event_type FROM changes WHERE event_type IS NOT NULL"),
)
def price_change_events(spark, sf):
    return E.listing_events(changes(spark, sf)).select(*KEYS, "price", "previous_price", "event_type")


@query(
    "S18_event_log",
    with_changes(
        f""", removed AS (SELECT listing_id, previous_time + {GAP} AS at_sec FROM changes WHERE scraped_sec - previous_time > {GAP}
 UNION ALL SELECT listing_id, max(scraped_sec) + {GAP} FROM changes GROUP BY listing_id HAVING {NOW_SEC} - max(scraped_sec) > {GAP})
SELECT listing_id, 'removed' AS event_type, at_sec FROM removed
UNION ALL SELECT listing_id, price_change, scraped_sec FROM changes WHERE price_change IS NOT NULL"""
    ),
)
def event_log(spark, sf):
    ch = changes(spark, sf)
    removed = E.removal_events(ch, NOW_SEC).select("listing_id", "event_type", F.col("removed_at").alias("at_sec"))
    prices = E.price_history(ch).select(
        "listing_id", F.col("price_change").alias("event_type"), F.col("scraped_sec").alias("at_sec")
    )
    return removed.unionByName(prices)


@query(
    "W02_latest_state",
    over(
        "observations",
        f"""SELECT o.listing_id, arg_max(struct_pack(p := price, s := source), {AT}).p AS price,
 arg_max(struct_pack(p := price, s := source), {AT}).s AS source, arg_max(price, {AT}) FILTER (WHERE price IS NOT NULL) AS known_price,
 min(scraped_sec) AS first_seen, max(scraped_sec) AS last_seen FROM observations o GROUP BY o.listing_id""",
    ),
)
def latest_state(spark, sf):
    obs = V(spark, sf, "observations").withColumn("known_price", F.col("price"))
    return E.current_listings(obs, "listing_id", ORDER, ["price", "source"], keep=["known_price"])


_SIGHT = f"""SELECT CAST(listing_id AS VARCHAR) AS canonical_hash, listing_id,
 CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE CAST(l_suppkey AS DOUBLE) END AS lat,
 CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_partkey AS DOUBLE) END AS lng,
 CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN source END AS neighborhood,
 CASE WHEN l_linenumber % 2 = 0 THEN 'Queens' ELSE '' END AS borough, source AS source_url, price, {ORD} FROM observations"""


S09_SQL = over(
    "observations listings",
    f"""WITH sight AS ({_SIGHT}), n AS (SELECT canonical_hash,
  arg_max(struct_pack(u := source_url, p := price), {AT}) AS x,
  arg_max(lat, {AT}) FILTER (WHERE lat IS NOT NULL) AS lat, arg_max(lng, {AT}) FILTER (WHERE lng IS NOT NULL) AS lng,
  arg_max(neighborhood, {AT}) FILTER (WHERE neighborhood <> '') AS nb, arg_max(borough, {AT}) FILTER (WHERE borough <> '') AS bo,
  arg_min(struct_pack(b := borough, n := neighborhood), {AT}) AS f FROM sight GROUP BY 1),
 cur AS (SELECT CAST(id AS VARCHAR) AS canonical_hash, 'old' AS source_url, price, lat, lng, neighborhood, borough, status, id, bedrooms, sqft FROM listings)
SELECT coalesce(c.canonical_hash, n.canonical_hash) AS canonical_hash,
 CASE WHEN n.canonical_hash IS NULL THEN c.source_url ELSE n.x.u END AS source_url,
 CASE WHEN n.canonical_hash IS NULL THEN c.price ELSE n.x.p END AS price, coalesce(n.lat, c.lat) AS lat, coalesce(n.lng, c.lng) AS lng,
 coalesce(n.nb, CASE WHEN c.canonical_hash IS NULL THEN n.f.n ELSE c.neighborhood END) AS neighborhood,
 coalesce(n.bo, CASE WHEN c.canonical_hash IS NULL THEN n.f.b ELSE c.borough END) AS borough,
 CASE WHEN n.canonical_hash IS NULL THEN c.status ELSE 'active' END AS status,
 CASE WHEN c.canonical_hash IS NULL THEN 2 ELSE 1 END AS first_seen_at, CASE WHEN n.canonical_hash IS NULL THEN 1 ELSE 2 END AS last_seen_at,
 c.id, c.bedrooms, c.sqft
FROM cur c FULL JOIN n ON c.canonical_hash = n.canonical_hash""",
)


@query("S09_listing_merge", S09_SQL)
def listing_merge(spark, sf):
    return E.merge_listings(_stored_listings(spark, sf), _sightings(spark, sf), F.lit(2), ORDER)


def _stored_listings(spark, sf):
    # ids stand in for hashes; 1 marks the load before, 2 this load
    return V(spark, sf, "listings").selectExpr(
        "CAST(id AS STRING) AS canonical_hash", "'old' AS source_url", "price", "lat", "lng", "neighborhood",
        "borough", "status", "1 AS first_seen_at", "1 AS last_seen_at", "id", "bedrooms", "sqft",
    )


def _sightings(spark, sf):
    return spark.sql(_SIGHT.replace("VARCHAR", "STRING").replace("FROM observations", "FROM {observations}"), observations=V(spark, sf, "observations"))


@query("S09_merge_sink", S09_SQL)
def merge_sink(spark, sf):
    """The table is stored, then merged with three batches in time order; the last one comes twice."""
    current, sight = _stored_listings(spark, sf), _sightings(spark, sf)
    store = KeyedRuns(spark, work_dir(spark, "listings"), "canonical_hash", current.schema)
    store.apply("load", lambda version: current)
    lo, hi = sight.agg(F.min("scraped_sec"), F.max("scraped_sec")).first()
    lo, hi = lo or 0, hi or 0
    for i in (0, 1, 2, 2):
        at = F.least(F.floor((F.col("scraped_sec") - lo) * 3 / (hi - lo + 1)), F.lit(2))
        E.upsert_listings(store, sight.filter(at == i), f"batch {i}", F.lit(2), ORDER)
    return store.table()


@query(
    "W01_stored_status",
    over(
        "observations listings",
        f"""WITH sight AS ({_SIGHT}), o AS (SELECT *, lag(price) OVER w AS p, row_number() OVER w AS k FROM sight WINDOW w AS (PARTITION BY canonical_hash ORDER BY {ORD})),
x AS (SELECT o.*, l.id, l.status, CASE WHEN k = 1 THEN l.price ELSE p END AS old_price FROM o LEFT JOIN listings l ON l.id = o.listing_id AND l.id % 5 <> 0)
SELECT canonical_hash, {ORD}, old_price AS previous_price, CASE WHEN k = 1 AND id IS NULL THEN 'listed' WHEN k = 1 AND status = 'removed' THEN 'relisted'
 WHEN price < old_price THEN 'price_drop' WHEN price > old_price THEN 'price_increase' END AS event_type FROM x""",
    ),
)
def stored_status(spark, sf):
    """Events of a batch against the stored table; every fifth listing is not stored, others as removed."""
    ev = E.upsert_events(_stored_listings(spark, sf).filter("id % 5 <> 0"), _sightings(spark, sf), ORDER)
    return ev.select("canonical_hash", *ORDER, "previous_price", "event_type")


def _seen(spark, sf):
    seen = V(spark, sf, "observations").groupBy(F.col("listing_id").alias("id")).agg(F.max("scraped_sec").alias("s"))
    return seen.select(
        "id", F.lit("active").alias("status"), F.timestamp_seconds("s").alias("last_seen_at"),
        F.timestamp_seconds("s").alias("updated_at"),
    )


_SEEN_SQL = "SELECT listing_id AS id, max(scraped_sec) AS s FROM observations GROUP BY listing_id"


@query(
    "F13_stale_removal",
    over(
        "observations",
        f"""SELECT id, CASE WHEN s < {NOW_SEC} - {GAP} THEN 'removed' ELSE 'active' END AS status,
 CASE WHEN s < {NOW_SEC} - {GAP} THEN CAST({NOW_SEC} AS BIGINT) ELSE CAST(s AS BIGINT) END AS updated_sec FROM ({_SEEN_SQL})""",
    ),
)
def stale_removal(spark, sf):
    marked, _ = E.detect_removed(_seen(spark, sf), F.timestamp_seconds(F.lit(NOW_SEC)))
    return marked.select("id", "status", F.unix_seconds("updated_at").alias("updated_sec"))


@query(
    "F13_removed_events",
    over(
        "observations",
        f"SELECT id AS listing_id, 'removed' AS event_type, CAST({NOW_SEC} AS BIGINT) AS created_sec FROM ({_SEEN_SQL}) WHERE s < {NOW_SEC} - {GAP}",
    ),
)
def removed_events(spark, sf):
    _, ev = E.detect_removed(_seen(spark, sf), F.timestamp_seconds(F.lit(NOW_SEC)))
    return ev.select("listing_id", "event_type", F.unix_seconds("created_at").alias("created_sec"))


@query(
    "A09_price_history_stats",
    over(
        "observations",
        f"""SELECT listing_id, last AS current, low, high, last - first AS change,
 CASE WHEN first > 0 THEN (last - first) / first * 100 ELSE 0 END AS change_pct FROM (SELECT listing_id,
 arg_min(price, {AT}) AS first, arg_max(price, {AT}) AS last, min(price) AS low, max(price) AS high
 FROM observations WHERE price IS NOT NULL GROUP BY listing_id)""",
    ),
)
def price_history_stats(spark, sf):
    return E.price_stats(V(spark, sf, "observations"), order=ORDER)


@query(
    "W08_change_vs_original",
    over(
        "observations",
        f"""SELECT listing_id, first AS original_price, last AS current_price, CASE WHEN first > 0 THEN (last - first) / first * 100 END AS price_change_pct
FROM (SELECT listing_id, arg_min(price, {AT}) AS first, arg_max(price, {AT}) AS last FROM observations WHERE price IS NOT NULL GROUP BY listing_id)""",
    ),
)
def change_vs_original(spark, sf):
    return E.price_change_pct(V(spark, sf, "observations"), order=ORDER)


_PIVOT = ", ".join(
    f"arg_max(struct_pack(p := price), {AT}) FILTER (WHERE source = '{s}').p AS {s}" for s in D.SOURCES
)


@query(
    "A10_price_pivot",
    over("observations", f"SELECT listing_id, scraped_sec // 2160 AS day, {_PIVOT} FROM observations GROUP BY 1, 2"),
)
def price_pivot(spark, sf):
    obs = V(spark, sf, "observations")
    # prices are wrapped so that a NULL last price wins like any other
    return E.price_pivot(obs, F.floor(F.col("scraped_sec") / 2160), list(D.SOURCES), ORDER)


@query(
    "C19_chart_date",
    """SELECT concat(strftime(ts, '%b'), ' ', CAST(day(ts) AS VARCHAR)) AS label, count(*) AS n FROM events GROUP BY 1""",
)
def chart_date(spark, sf):
    return D.table(spark, sf, "events").groupBy(E.chart_date(F.col("ts")).alias("label")).agg(F.count(F.lit(1)).alias("n"))


# --- alerts: price drops of known listings, matched, limited and dispatched ---


def alerts(spark: SparkSession, sf: str) -> DataFrame:
    """Price-drop sightings with the details of their listing, as a stored table."""
    drops = changes(spark, sf).filter("event_type = 'price_drop'").select(
        F.concat_ws("-", "listing_id", *ORDER).alias("event_id"), F.col("listing_id").alias("id"),
        "event_type", F.col("previous_price").cast("double").alias("old_price"),
        F.col("price").cast("double").alias("new_price"), F.col("scraped_sec").alias("ts_sec"),
    )
    details = V(spark, sf, "listings").select(
        "id", "address", "bedrooms", "borough", "lat", "lng", "amenities", "quality_score"
    )
    return stored(drops.join(details, "id").withColumnRenamed("new_price", "price"), "alerts")


ALERTS = f"""alerts AS (SELECT concat_ws('-', listing_id, {ORD}) AS event_id, listing_id AS id, c.event_type,
  CAST(c.previous_price AS DOUBLE) AS old_price, CAST(c.price AS DOUBLE) AS price, scraped_sec AS ts_sec,
  l.address, l.bedrooms, l.borough, l.lat, l.lng, l.amenity_bits, l.quality_score
 FROM changes c JOIN listings l ON c.listing_id = l.id WHERE c.event_type = 'price_drop')"""
MATCHES = f"""matches AS (SELECT e.*, s.search_id, s.user_id, s.name, s.channel_list, s.amenity_bits AS need, s.min_quality_score
 FROM alerts e JOIN saved_searches s ON s.is_active
  AND (s.min_price IS NULL OR e.price >= s.min_price) AND (s.max_price IS NULL OR e.price <= s.max_price)
  AND (s.bedrooms IS NULL OR e.bedrooms = s.bedrooms) AND (s.borough IS NULL OR e.borough = s.borough)
  AND (s.center_lat IS NULL OR s.center_lng IS NULL OR s.radius_miles IS NULL
   OR {hav('s.center_lat', 's.center_lng', 'coalesce(e.lat, 0)', 'coalesce(e.lng, 0)', METERS)} <= s.radius_miles * 1609.34)),
kept AS (SELECT * FROM matches WHERE (amenity_bits & need) = need
  AND (min_quality_score IS NULL OR coalesce(quality_score, 0) >= min_quality_score))"""


def alert_sql(body: str) -> str:
    return over("observations listings saved_searches", f"WITH {CHANGES_SQL}, {ALERTS}, {MATCHES}{body}")


PER_SEARCH = "search_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS id_sum, min(ts_sec) AS first_sec, max(ts_sec) AS last_sec, CAST(sum(price) AS BIGINT) AS price_sum"


TOTALS = {"id_sum": ("sum", "id"), "first_sec": ("min", "ts_sec"), "last_sec": ("max", "ts_sec"), "price_sum": ("sum", "l_price")}


def per_search(spark, sf, filtered: bool) -> DataFrame:
    found = M.match_searches(
        alerts(spark, sf), V(spark, sf, "saved_searches"), D.users(spark, sf), filtered=filtered, totals=TOTALS)
    return found.withColumn("price_sum", F.col("price_sum").cast("bigint"))


@query("J01_search_match", alert_sql(f" SELECT {PER_SEARCH} FROM matches GROUP BY search_id"))
def search_match(spark, sf):
    return per_search(spark, sf, False)


@query("J02_post_filter", alert_sql(f" SELECT {PER_SEARCH} FROM kept GROUP BY search_id"))
def post_filter(spark, sf):
    return per_search(spark, sf, True)


@query(
    "J13_event_listing_fetch",
    over(
        "observations listings",
        f"""WITH {CHANGES_SQL} SELECT c.listing_id, c.scraped_sec AS at_sec, c.event_type, l.address, l.borough,
 CASE WHEN l.id % 29 <> 0 THEN l.price * 100 / CAST(100 AS DOUBLE) END AS price, c.previous_price * 100 / CAST(100 AS DOUBLE) AS old_price
FROM changes c JOIN listings l ON c.listing_id = l.id WHERE c.event_type IS NOT NULL""",
    ),
)
def event_listing_fetch(spark, sf):
    ev = E.listing_events(changes(spark, sf)).select(
        F.col("listing_id").alias("canonical_hash"), "event_type", F.col("scraped_sec").alias("at_sec"),
        (F.col("previous_price") * 100).alias("old_price_cents"),
    )
    # ids stand in for hashes; every 29th listing has no price
    stored = V(spark, sf, "listings").selectExpr(
        "id AS canonical_hash", "address", "borough", "if(id % 29 = 0, 0, price * 100) AS price_cents"
    )
    return E.event_rows(ev, stored).withColumnRenamed("canonical_hash", "listing_id")


# Fold of the limiter in SQL: accepted times are carried along the ordered list.
def _limited(table: str, rows: str, tie: str) -> str:
    """Accepted (user, position) pairs by folding each user's ordered times."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_sec, {tie}) AS pos FROM {table}),
folded AS (SELECT user_id, list_reduce(list(struct_pack(t := CAST(ts_sec AS DOUBLE), acc := [CAST(NULL AS DOUBLE)], p := pos, hit := [CAST(NULL AS BIGINT)]) ORDER BY pos),
  lambda a, x: CASE WHEN len(list_filter(a.acc, lambda y: y > x.t - 3600)) < 10
   THEN struct_pack(t := x.t, acc := list_append(list_filter(a.acc, lambda y: y > x.t - 3600), x.t), p := x.p, hit := list_append(a.hit, x.p))
   ELSE struct_pack(t := x.t, acc := list_filter(a.acc, lambda y: y > x.t - 3600), p := x.p, hit := a.hit) END,
  struct_pack(t := CAST(-1 AS DOUBLE), acc := CAST([] AS DOUBLE[]), p := CAST(0 AS BIGINT), hit := CAST([] AS BIGINT[]))) AS f FROM ranked GROUP BY user_id),
accepted AS (SELECT r.* FROM ranked r JOIN (SELECT user_id, unnest(f.hit) AS pos FROM folded) USING (user_id, pos))"""


@query(
    "W03_rate_limit",
    over(
        "notifications",
        f"WITH timed AS (SELECT id, user_id, event_type, epoch(sent_at) AS ts_sec FROM notifications), {_limited('timed', '', 'id')} SELECT id, user_id, event_type FROM accepted",
    ),
)
def rate_limit(spark, sf):
    timed = V(spark, sf, "notifications").select(
        "id", "user_id", "event_type", (F.unix_micros(F.col("sent_at").cast("timestamp")) / 1e6).alias("ts_sec")
    )
    return L.rate_limit(timed, ["id"]).select("id", "user_id", "event_type")


def accepted(spark, sf, details: tuple[str, ...] = ()) -> DataFrame:
    """Accepted matches with the event columns ``details``, and with those of their search and user.

    The matches that can be among the first of their user and instant come in the order of the limiter and bring their
    details along, so they pass through it and on without being stored, shuffled or joined.
    """
    events, searches, users = alerts(spark, sf), V(spark, sf, "saved_searches"), D.users(spark, sf)
    kept = M.match_searches(events, searches, users, filtered=True, first=L.LIMIT, carried=details)
    passed = L.rate_limit(kept, ["search_id", "event_id"], in_order=True)
    return M.with_details(passed, events, searches, users, carried=details)


LIMITED = ", " + _limited("kept", "", "search_id, event_id")


@query(
    "T02_dispatch_batch",
    alert_sql(
        LIMITED
        + """, sent AS (SELECT *, unnest(CASE channel_list WHEN '' THEN ['sse'] ELSE string_split(channel_list, ',') END) AS channel FROM accepted)
SELECT user_id, search_id, event_id, channel, CASE channel WHEN 'push' THEN user_id % 3 <> 0 ELSE true END AS deliverable FROM sent"""
    ),
)
def dispatch_batch(spark, sf):
    return M.dispatch(accepted(spark, sf)).select("user_id", "search_id", "event_id", "channel", "deliverable")


@query(
    "A13_dispatch_counts",
    alert_sql(
        LIMITED
        + """ SELECT event_id, CAST(sum(CASE channel_list WHEN '' THEN 1 ELSE len(string_split(channel_list, ',')) END) AS BIGINT) AS dispatched
FROM accepted GROUP BY event_id"""
    ),
)
def dispatch_counts(spark, sf):
    return M.dispatch_counts(M.dispatch(accepted(spark, sf)))


_MONEY = "replace(format('{{:,}}', CAST(CAST(printf('%.0f', {x}) AS DOUBLE) AS BIGINT)), ' ', '')"


def _money(x: str) -> str:
    return _MONEY.replace("{{:,}}", "{:,}").replace("{x}", x)


@query(
    "C16_push_text",
    with_changes(
        f""", {ALERTS.replace("WHERE c.event_type = 'price_drop'", "WHERE c.event_type IS NOT NULL")}
SELECT event_id, CASE event_type WHEN 'listed' THEN 'New Listing' WHEN 'price_drop' THEN 'Price Drop' WHEN 'price_increase' THEN 'Price Increase'
  WHEN 'relisted' THEN 'Relisted' ELSE 'Listing Removed' END AS title,
 trim(CASE event_type WHEN 'price_drop' THEN concat(bedrooms, 'BR ', address, ' now ', pt, CASE WHEN price <> 0 AND old_price <> 0 THEN concat(' (-$', {_money('old_price - price')}, ')') ELSE '' END)
  WHEN 'listed' THEN concat(bedrooms, 'BR in ', borough, ' — ', pt) ELSE concat(bedrooms, 'BR ', address, ' — ', pt) END) AS body
FROM (SELECT *, CASE WHEN coalesce(price, 0) <> 0 THEN concat('$', {_money('price')}, '/mo') ELSE 'Price N/A' END AS pt FROM alerts)""",
        "observations listings",
    ),
)
def push_text(spark, sf):
    ev = E.listing_events(changes(spark, sf)).select(
        F.concat_ws("-", "listing_id", *ORDER).alias("event_id"), F.col("listing_id").alias("id"), "event_type",
        F.col("previous_price").cast("double").alias("old_price"), F.col("price").cast("double").alias("price"),
    )
    details = V(spark, sf, "listings").select("id", "address", "bedrooms", "borough")
    return T.push_text(ev.join(details, "id")).select("event_id", "title", "body")


def digest_input(spark, sf) -> DataFrame:
    details = ("event_type", "old_price", "price", "address", "bedrooms")
    return accepted(spark, sf, details).withColumnRenamed("name", "search_name")


@query(
    "A14_alert_digest",
    alert_sql(
        LIMITED
        + f""", lined AS (SELECT *, row_number() OVER (PARTITION BY search_id, event_type ORDER BY ts_sec, event_id) AS rn,
 concat_ws('|', address, concat(bedrooms, ' BR'), concat('$', {_money('price')}, '/mo'), concat('-$', {_money('old_price - price')})) AS line FROM accepted)
SELECT search_id, event_type, count(*) AS count,
 concat('Price drop', CASE WHEN count(*) = 1 THEN '' ELSE 's' END, ' on ', count(*), ' listing', CASE WHEN count(*) = 1 THEN '' ELSE 's' END) AS subject,
 string_agg(line, chr(10) ORDER BY rn) FILTER (WHERE rn <= 20) AS rows, greatest(count(*) - 20, 0) AS overflow
FROM lined GROUP BY search_id, event_type"""
    ),
)
def alert_digest(spark, sf):
    out = T.alert_digest(digest_input(spark, sf), [F.col("ts_sec"), F.col("event_id")], in_order=("ts_sec", "event_id"))
    return out.withColumn("rows", F.array_join("rows", "\n"))


@query(
    "C17_digest_text",
    with_changes(
        f""", {ALERTS.replace("WHERE c.event_type = 'price_drop'", "WHERE c.event_type IS NOT NULL")},
g AS (SELECT borough, event_type, count(*) AS n, count(*) FILTER (WHERE coalesce(price, 0) = 0) AS without_price,
 min(CASE WHEN coalesce(price, 0) <> 0 THEN concat('$', {_money('price')}, '/mo') ELSE 'N/A' END) AS lowest_text,
 max(CASE WHEN event_type = 'price_drop' THEN concat('-$', {_money('old_price - price')}) END) AS top_drop FROM alerts GROUP BY borough, event_type)
SELECT borough, event_type, CASE event_type WHEN 'listed' THEN concat(n, ' new listing', p, ' matching ', borough)
  WHEN 'price_drop' THEN concat('Price drop', p, ' on ', n, ' listing', p) WHEN 'price_increase' THEN concat('Price increase on ', n, ' listing', p)
  ELSE concat(n, ' listing', p, ' relisted') END AS subject, without_price, lowest_text, top_drop
FROM (SELECT *, CASE WHEN n = 1 THEN '' ELSE 's' END AS p FROM g)""",
        "observations listings",
    ),
)
def digest_text(spark, sf):
    ev = E.listing_events(changes(spark, sf)).select(
        F.col("listing_id").alias("id"), "event_type",
        F.col("previous_price").cast("double").alias("old_price"), F.col("price").cast("double").alias("price"),
    ).join(V(spark, sf, "listings").select("id", "address", "bedrooms", "borough"), "id")
    g = T.digest_row(ev).groupBy("borough", "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("price_text") == "N/A").alias("without_price"),
        F.min("price_text").alias("lowest_text"), F.max("drop_text").alias("top_drop"),
    )
    return g.select(
        "borough", "event_type", T.digest_subject(F.col("event_type"), F.col("n"), F.col("borough")).alias("subject"),
        "without_price", "lowest_text", "top_drop",
    )


@query(
    "S19_user_messages",
    alert_sql(
        LIMITED
        + """ SELECT concat('sse:user:', CAST(user_id AS VARCHAR)) AS channel, count(*) AS n, min(concat('{"event":"price_drop","data":{"listing_id":', CAST(id AS VARCHAR),
 ',"address":"', address, '","price":', CAST(price AS VARCHAR), ',"event_type":"price_drop","search_name":"', name, '"}}')) AS first_value
FROM accepted WHERE channel_list IN ('', 'sse') GROUP BY user_id"""
    ),
)
def user_messages(spark, sf):
    details = ("id", "event_type", "price", "address")
    sent = M.dispatch(accepted(spark, sf, details)).filter("channel = 'sse'").withColumnsRenamed(
        {"id": "listing_id", "name": "search_name"}
    )
    return T.per_channel(T.to_user_messages(sent))


@query(
    "J08_listing_detail",
    over(
        "observations listings",
        f"""WITH {CHANGES_SQL}, src AS (SELECT listing_id, string_agg(line, ';' ORDER BY source) AS sources FROM
 (SELECT listing_id, source, concat(source, '@', CAST(max(scraped_sec) AS VARCHAR)) AS line FROM observations GROUP BY listing_id, source) GROUP BY listing_id),
 hist AS (SELECT listing_id, string_agg(line, ';' ORDER BY rn) FILTER (rn <= 1000) AS price_history, count(*) AS n FROM
 (SELECT listing_id, row_number() OVER (PARTITION BY listing_id ORDER BY scraped_sec, price, previous_price, price_change) AS rn, concat(CAST(scraped_sec AS VARCHAR), ':', CAST(price AS VARCHAR), ':', price_change) AS line FROM changes WHERE price_change IS NOT NULL) GROUP BY listing_id)
SELECT id, coalesce(n, 0) AS n_history, lat IS NOT NULL AS rs_nearby, coalesce(sources, '') AS sources, coalesce(price_history, '') AS price_history
FROM listings LEFT JOIN src ON src.listing_id = id LEFT JOIN hist ON hist.listing_id = id""",
    ),
)
def listing_detail(spark, sf):
    from ..operators import search as S

    obs = V(spark, sf, "observations")
    sources = obs.select("listing_id", "source", F.concat_ws("/", "source", "listing_id").alias("source_url"), F.col("scraped_sec").alias("scraped_at"))
    history = E.price_history(changes(spark, sf)).select(
        "listing_id", F.col("scraped_sec").alias("recorded_at"), "price", "previous_price",
        F.col("price_change").alias("event_type"),
    )
    out = S.listing_detail(V(spark, sf, "listings"), sources, history, V(spark, sf, "register"), page_rows=1000)
    src = F.transform("sources", lambda s: F.concat_ws("@", s.source, s.scraped_at.cast("string")))
    his = F.transform("price_history", lambda h: F.concat_ws(":", h.recorded_at.cast("string"), h.price.cast("string"), h.event_type))
    return out.select(
        "id", "n_history", "rs_nearby",
        F.coalesce(F.array_join(src, ";"), F.lit("")).alias("sources"),
        F.coalesce(F.array_join(his, ";"), F.lit("")).alias("price_history"),
    )


@query(
    "J09_rs_nearby",
    over(
        "listings register",
        "SELECT borough, count(*) FILTER (WHERE lat IS NOT NULL AND (SELECT count(*) FROM register) > 0) AS nearby FROM listings GROUP BY borough",
    ),
)
def rs_nearby(spark, sf):
    from ..operators import search as S

    out = S.with_rs_nearby(V(spark, sf, "listings"), V(spark, sf, "register"))
    return out.groupBy("borough").agg(F.count_if("rs_nearby").alias("nearby"))


# --- monitoring ---


def runs(spark, sf) -> DataFrame:
    return V(spark, sf, "scrape_runs").withColumn("ts_sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


_STREAK = """streaks AS (SELECT *, CAST(sum(1 - success) OVER (PARTITION BY source, g ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM
 (SELECT *, sum(success) OVER (PARTITION BY source ORDER BY ts, run_id ROWS UNBOUNDED PRECEDING) AS g FROM scrape_runs))"""


@query("W05_failure_streak", over("scrape_runs", f"WITH {_STREAK} SELECT run_id, source, success, streak FROM streaks"))
def failure_streak(spark, sf):
    return H.failure_streak(runs(spark, sf)).select("run_id", "source", "success", "streak")


ALERTS_SQL = f"""{_STREAK}, raised AS (SELECT source, run_id, ts, 'critical' AS level, concat(source, ' has ', CAST(streak AS VARCHAR), ' consecutive failures') AS message FROM streaks WHERE streak >= 3
UNION ALL SELECT source, run_id, ts, 'warning', concat(source, ' yielded only ', CAST(n_listings AS VARCHAR), ' listings (min: 5)') FROM streaks WHERE success = 1 AND n_listings < 5
UNION ALL SELECT source, run_id, ts, 'warning', concat(source, ' took ', CAST(duration_seconds AS VARCHAR), 's (max: 600s)') FROM streaks WHERE duration_seconds > 600)"""


@query("W06_run_alerts", over("scrape_runs", f"WITH {ALERTS_SQL} SELECT source, run_id, level, message FROM raised"))
def run_alerts(spark, sf):
    return H.run_alerts(H.failure_streak(runs(spark, sf))).select("source", "run_id", "level", "message")


@query(
    "W04_keep_last",
    over(
        "scrape_runs",
        """SELECT run_id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY ts DESC, run_id DESC) AS rn FROM scrape_runs) WHERE rn <= 100""",
    ),
)
def keep_last_runs(spark, sf):
    return H.keep_last(runs(spark, sf), ["source"], 100, [F.desc("ts"), F.desc("run_id")]).select("run_id", "source")


@query(
    "W04_recent_alerts",
    over(
        "scrape_runs",
        f"WITH {ALERTS_SQL} SELECT source, run_id, message FROM raised ORDER BY ts DESC, run_id DESC, message LIMIT 10",
    ),
)
def recent_alerts(spark, sf):
    raised = H.run_alerts(H.failure_streak(runs(spark, sf)))
    order = [F.desc("ts"), F.desc("run_id"), F.col("message")]
    return H.keep_last(H.keep_last(raised, [], 200, order), [], 10, order).select("source", "run_id", "message")


@query(
    "A08_scraper_health",
    over(
        "scrape_runs",
        f"""WITH {_STREAK}, last AS (SELECT source, arg_max(struct_pack(t := ts, n := n_listings, d := duration_seconds, s := success, k := streak), (ts, run_id)) AS x,
 sum(success) AS total_success, sum(1 - success) AS total_failures, sum(success * n_listings) AS total_listings FROM streaks GROUP BY source)
SELECT v.source, CASE WHEN x IS NULL THEN 'no_data' WHEN x.k >= 3 THEN 'critical' WHEN x.s = 0 THEN 'degraded' ELSE 'healthy' END AS status,
 CAST(x.t AS VARCHAR) AS last_run, x.n AS last_count, x.d AS last_duration, CAST(total_success AS BIGINT) AS total_success,
 CAST(total_failures AS BIGINT) AS total_failures, CAST(total_listings AS BIGINT) AS total_listings, x.k AS consecutive_failures
FROM (VALUES ('streeteasy'), ('craigslist'), ('zillow'), ('rentcom'), ('zumper')) v(source) LEFT JOIN last USING (source)""",
    ),
)
def scraper_health(spark, sf):
    return H.scraper_health(runs(spark, sf)).withColumn("last_run", F.col("last_run").cast("string"))


@query(
    "S20_run_metrics",
    f"""SELECT CASE user_id % 5 WHEN 0 THEN 'streeteasy' WHEN 1 THEN 'craigslist' WHEN 2 THEN 'zillow' WHEN 3 THEN 'rentcom' ELSE 'zumper' END AS source,
 CAST(floor(value) AS INTEGER) AS n_listings, {rnd('value * 7.777', 2)} AS duration_seconds, CAST(event_type <> 'error' AS INTEGER) AS success,
 CASE WHEN event_type = 'error' THEN 'failed' ELSE '' END AS error FROM events""",
)
def run_metrics(spark, sf):
    e = D.table(spark, sf, "events")
    src = F.expr("element_at(array('streeteasy','craigslist','zillow','rentcom','zumper'), cast(user_id % 5 as int) + 1)")
    failed = F.col("event_type") == "error"
    rows = e.select(*H.run_record(
        src, F.col("ts"), F.floor("value").cast("int"), F.col("value") * 7.777, ~failed,
        F.when(failed, "failed").otherwise(""),
    ))
    return tables.conform(rows, "scrape_runs").drop("ts")
