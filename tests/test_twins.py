"""Operators against brute force on small fixtures, hot paths switched on."""

import contextlib
import math
import random
from collections import defaultdict, deque

import numpy as np
import pytest
from pyspark.sql import functions as F

from keystead.operators import events as E, limiter as L, matching as M, register as G, search as S, spatial
from keystead.sources import derived as D

ORDER = ("scraped_sec", "l_linenumber", "l_suppkey", "l_partkey")


@contextlib.contextmanager
def like_large_tables(spark):
    """No merging of small partitions and no broadcast joins, as tables run that are too large for either."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def hav(a, b, c, d, r):
    p = math.radians
    x = math.sin(p(c - a) / 2) ** 2 + math.cos(p(a)) * math.cos(p(c)) * math.sin(p(d - b) / 2) ** 2
    return 2 * r * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_events_sequential_twin(spark, sf):
    obs = D.view(spark, sf, "observations")
    want, last = [], {}
    for r in sorted(obs.collect(), key=lambda r: [r[c] for c in ORDER]):
        old = last.get(r.listing_id)
        if old is None:
            ev = "listed"
        elif r.scraped_sec - old[1] > 172800:
            ev = "relisted"
        elif r.price is None or old[0] is None or r.price == old[0]:
            ev = None
        else:
            ev = "price_drop" if r.price < old[0] else "price_increase"
        want.append(str((r.listing_id, *[r[c] for c in ORDER], ev)))
        last[r.listing_id] = (r.price, r.scraped_sec)
    for floor in (3, 10**6):
        got = E.detect_changes(obs, order=ORDER, floor=floor).select("listing_id", *ORDER, "event_type").collect()
        assert sorted(str(tuple(r)) for r in got) == sorted(want)


def match_twin(listings, searches, missing_is_zero):
    out = set()
    for l in listings:
        for s in searches:
            if not s.is_active:
                continue
            ok = all((
                s.min_price is None or (l.price is not None and l.price >= s.min_price),
                s.max_price is None or (l.price is not None and l.price <= s.max_price),
                s.bedrooms is None or l.bedrooms == s.bedrooms,
                s.borough is None or l.borough == s.borough,
            ))
            if ok and None not in (s.center_lat, s.center_lng, s.radius_miles):
                lat, lng = l.lat, l.lng
                if missing_is_zero:
                    lat, lng = lat or 0.0, lng or 0.0
                ok = hav(s.center_lat, s.center_lng, lat, lng, 6371008.8) <= s.radius_miles * 1609.34
            if ok:
                out.add((l.event_id, s.search_id))
    return out


@pytest.mark.parametrize("floor", [20, 10**6])
def test_search_match_twin(spark, sf, floor):
    listings = D.view(spark, sf, "listings").limit(300).withColumn("event_id", F.col("id"))
    odd = spark.sql(
        """SELECT * FROM VALUES (-1L, 'Mars', 9, 2000.0D, 40.7D, -73.9D), (-2L, NULL, NULL, 1500.0D, NULL, NULL), (-3L, 'Bronx', 2, NULL, 80.0D, 10.0D)
        AS t(event_id, borough, bedrooms, price, lat, lng)"""
    )
    cols = ["event_id", "borough", "bedrooms", "price", "lat", "lng", "amenities", "quality_score"]
    listings = listings.select(*cols).unionByName(odd, allowMissingColumns=True)
    searches = D.view(spark, sf, "saved_searches")
    extra = spark.sql(
        """SELECT * FROM VALUES (9001L, 40.7D, -73.9D, 5000.0D, CAST(NULL AS STRING)), (9002L, 79.9D, 10.0D, 30.0D, NULL), (9003L, 0.0D, 0.0D, 3.0D, NULL),
        (9004L, NULL, NULL, NULL, 'Mars'), (9005L, 40.7D, 179.99D, 8.0D, NULL) AS t(search_id, center_lat, center_lng, radius_miles, borough)"""
    ).withColumn("is_active", F.lit(True)).withColumn("user_id", F.lit(1))
    searches = searches.unionByName(extra, allowMissingColumns=True)
    got = M.match_searches(listings, searches, D.users(spark, sf), floor=floor).select("event_id", "search_id").collect()
    pairs = [tuple(r) for r in got]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == match_twin(listings.collect(), searches.collect(), True)


@pytest.mark.parametrize("floor", [20, 10**6])
def test_search_match_edges(spark, floor):
    """Circles over the date line and near poles, ends of price ranges, wide and tiny circles."""
    rng = random.Random(floor)
    places = [(0.0, 179.9), (0.0, -179.9), (10.0, 180.0), (89.5, 0.0), (-88.0, 100.0), (40.7, -73.9), (0.0, 0.0)]
    near = lambda v, d: v + rng.uniform(-d, d)
    searches = []
    for i in range(400):
        lat, lng = rng.choice(places)
        lo, hi = (rng.choice([None, rng.randrange(0, 9000)]) for _ in range(2))
        circle = (near(lat, 0.3), near(lng, 0.3), rng.choice([0.0, 0.01, 1.0, 30.0, 400.0, 4000.0])) if rng.random() < 0.7 else (None, None, None)
        searches.append((i, 1, lo, hi, rng.choice([None, 1, 9]), rng.choice([None, "Bronx", "Mars"]), *circle, True))
    searches.append((999, 1, -5, -1, None, None, None, None, None, True))
    searches = spark.createDataFrame(searches, "search_id long, user_id long, min_price int, max_price int, bedrooms int, borough string, "
                                     "center_lat double, center_lng double, radius_miles double, is_active boolean")
    listings = []
    for i in range(300):
        lat, lng = rng.choice(places)
        price = rng.choice([None, 0.0, -3.0, float(rng.randrange(9000)), rng.uniform(0, 9000)])
        lng = (near(lng, 0.5) + 180) % 360 - 180
        listings.append((i, rng.choice([None, "Bronx", "Mars"]), rng.choice([None, 1, 9]), price, min(90.0, near(lat, 0.5)), lng))
    listings = spark.createDataFrame(listings, "event_id long, borough string, bedrooms int, price double, lat double, lng double").withColumn("amenities", F.array()).withColumn("quality_score", F.lit(1.0))
    pairs = [tuple(r) for r in M.match_searches(listings, searches, floor=floor).select("event_id", "search_id").collect()]
    assert len(pairs) == len(set(pairs)) > 1000
    assert set(pairs) == match_twin(listings.collect(), searches.collect(), True)


def test_search_match_tests_few_pairs(spark):
    from keystead.plans import event_queries as Q

    big = "/root/testdata/sf0.1"
    events, searches = Q.alerts(spark, big), D.view(spark, big, "saved_searches").filter("is_active")
    hits = F.count_if(M.search_criteria())
    row = M.candidates(events, searches).agg(F.count("*").alias("tested"), hits.alias("hits")).first()
    assert row.hits > 10**7 and row.tested <= 1.5 * row.hits


def test_grid_join_spreads_both_sides(spark):
    """One key with most searches and few events, and one with most events and few searches, run in many tasks."""
    from keystead.operators import skew

    left = spark.range(3000).selectExpr("id AS a", "IF(id < 20, 1, IF(id < 2900, 2, id)) AS k")
    right = spark.range(3000).selectExpr("id AS b", "IF(id < 20, 2, IF(id < 2900, 1, id)) AS k")
    out = skew.grid_join(left, right, ["k"], "a", "b", 100, share=10).repartition(1).withColumn("one", F.lit(1))
    pairs = [(r.a, r.b) for r in out.collect()]
    assert len(pairs) == len(set(pairs)) == 2 * 20 * 2880 + 100
    with like_large_tables(spark):
        tasks = skew.grid_join(left, right, ["k"], "a", "b", 100, share=10).groupBy("k", F.spark_partition_id().alias("task")).count().collect()
    for key in (1, 2):
        parts = [r["count"] for r in tasks if r.k == key]
        assert len(parts) > 3 and max(parts) < 0.6 * sum(parts)


def limit_twin(rows, limit, window):
    out, seen = set(), defaultdict(deque)
    for user, t, i in sorted(rows):
        q = seen[user]
        while q and q[0] <= t - window:
            q.popleft()
        if len(q) < limit:
            q.append(t)
            out.add(i)
    return out


@pytest.mark.parametrize("spread", [300, 3000, 40000, 400000])
def test_rate_limit_twin(spark, spread):
    rng = random.Random(spread)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 8), float(rng.randrange(spread)), i) for i in range(2500)]
    rows += [(9, 0.0, 3000 + i) for i in range(25)] + [(9, 3600.0, 4000), (9, 3599.5, 4001)]
    df = spark.createDataFrame(rows, "user_id long, ts_sec double, id long")
    got = [r.id for r in L.rate_limit(df, ["id"]).select("id").collect()]
    assert len(got) == len(set(got))
    assert set(got) == limit_twin(rows, 10, 3600)


def test_decide_is_the_row_loop_and_can_be_cut(spark):
    for seed in range(300):
        rng = random.Random(seed)
        limit, window, scale = rng.choice([1, 2, 3, 10]), rng.choice([1, 7, 50]), rng.choice([1.0, 0.1, 1 / 3])
        t = sorted({rng.randrange(rng.choice([30, 300, 3000])) * scale for _ in range(rng.randrange(1, 200))})
        n = [min(limit, rng.choice([0, 1, 1, 2, 20])) for _ in t]
        known = [rng.choice([0, 0, 0, 0, 1, 3]) if rng.random() < 0.3 else 0 for _ in t]
        want, q = [], deque()
        for x, a, b in zip(t, n, known):
            while q and q[0] <= x - window:
                q.popleft()
            q.extend([x] * b)
            want.append(max(0, min(a, limit - len(q))))
            q.extend([x] * want[-1])
        cuts = sorted(rng.choice(range(len(t) + 1)) for _ in range(rng.randrange(4)))
        got, state = [], (np.empty(0), np.empty(0, np.int64))
        for i, j in zip([0, *cuts], [*cuts, len(t)]):
            if i < j:
                k, *state = L.decide(np.array(t[i:j]), np.array(n[i:j]), np.array(known[i:j]), *state, limit, window)
                got += k.tolist()
        assert got == want, seed


def test_rate_limit_spreads_one_user(spark):
    df = spark.range(0, 1_000_000, 1, 8).selectExpr("1L AS user_id", "CAST(id AS DOUBLE) AS ts_sec", "id")
    with like_large_tables(spark):
        rows = L.rate_limit(df, ["id"]).withColumn("task", F.spark_partition_id()).collect()
    assert [r.id for r in sorted(rows)] == [3600 * w + i for w in range(278) for i in range(10)][: len(rows)] and len(rows) == 2780
    assert len({r.task for r in rows}) > 4


def test_rate_limit_continues_earlier_batches(spark):
    rng = random.Random(1)
    rows = sorted((rng.randrange(4), float(rng.randrange(20000)), i) for i in range(1500))
    want = limit_twin(rows, 10, 3600)
    by_time = sorted(rows, key=lambda r: (r[1], r[2]))
    # a cut between two instants: a batch never splits an instant here
    cut = next(i for i in range(700, 1500) if by_time[i][1] != by_time[i - 1][1])
    schema = "user_id long, ts_sec double, id long"
    first = L.rate_limit(spark.createDataFrame(by_time[:cut], schema), ["id"])
    second = L.rate_limit(
        spark.createDataFrame(by_time[cut:], schema), ["id"], accepted_before=first.select("user_id", "ts_sec")
    )
    got = [r.id for r in first.collect()] + [r.id for r in second.collect()]
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("floor", [20, 10**6])
def test_proximity_twin(spark, floor):
    rng = random.Random(2)
    pts = [(i, "active", "x", 40.5 + rng.random() * 0.05, -74 + rng.random() * 0.05) for i in range(400)]
    pts += [(1000 + i, "active", "x", 40.51, -73.98) for i in range(60)] + [(2000, "active", "x", None, -74.0)]
    per = [(i, f"P{i}", "NB", "y", 40.5 + rng.random() * 0.05, -74 + rng.random() * 0.05) for i in range(150)]
    listings = spark.createDataFrame(pts, "id long, status string, address string, lat double, lng double")
    permits = spark.createDataFrame(per, "id long, permit_number string, permit_type string, address string, lat double, lng double")
    want = {
        (p[0], q[0], round(hav(q[4], q[5], p[3], p[4], 3959.0), 3))
        for p in pts for q in per if p[3] is not None and hav(q[4], q[5], p[3], p[4], 3959.0) <= 0.25
    }
    got = spatial.proximity_alerts(permits, listings, floor=floor).select("listing_id", "permit_id", "distance_miles").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_register_contains_twin(spark):
    addresses = ["123 East 5th Street", "23 East 5th", "7 A  B Road", "9 Broadway", "99 Broadwayx Ave", "Main", None, "12 EAST ST", " 4 Elm"]
    register = [("23", "East 5th"), ("7", "A"), ("9", "Broadway"), ("12", "east "), ("", "Main"), ("4", "elm st"), ("A", " B"), ("3", "East 5th Street")]
    a = spark.createDataFrame([(i, x) for i, x in enumerate(addresses)], "id int, address string")
    r = spark.createDataFrame(register, "building_number string, street_name string")
    keys = [f"{n} {s}".upper() for n, s in register if n.strip() and s.strip()]
    want = {i: bool(x) and any(k in x.upper() for k in keys) for i, x in enumerate(addresses)}
    assert {x.id: x.hcr_match for x in G.register_match(a, r).collect()} == want


def test_similar_twin(spark, sf):
    listings = D.view(spark, sf, "listings")
    rows = listings.select("id", "borough", "bedrooms", "price", "status").collect()
    want = {}
    for a in rows[:120]:
        near = sorted(
            (abs(b.price - a.price), b.id) for b in rows
            if b.id != a.id and b.status == "active" and b.borough == a.borough
            and abs(b.bedrooms - a.bedrooms) <= 1 and int(a.price * 0.7) <= b.price <= int(a.price * 1.3)
        )[:5]
        want[a.id] = [i for _, i in near]
    ids = spark.createDataFrame([(i,) for i in want], "id long")
    got = defaultdict(list)
    for r in S.similar(listings, ids).orderBy("id", "rank").collect():
        got[r.id].append(r.similar_id)
    assert all(got.get(i, []) == w for i, w in want.items())


@pytest.mark.parametrize("floor", [20, 10**6])
@pytest.mark.parametrize("miles", [0.25, 40.0, 1500.0])
def test_proximity_around_the_globe(spark, floor, miles):
    """Pairs over the date line, around and over the poles."""
    rng = random.Random(int(miles))
    spread = miles / 60
    places = [(0.0, 180.0), (60.0, -180.0), (89.99, 0.0), (-89.9, 170.0), (88.9, 10.0), (40.7, -74.0)]

    def point():
        lat, lng = rng.choice(places)
        lat, lng = lat + rng.uniform(-spread, spread), lng + rng.choice([0, 180, 359.999]) * (abs(lat) > 88) + rng.uniform(-spread, spread)
        return max(-90.0, min(90.0, lat)), (lng + 180) % 360 - 180

    listings = spark.createDataFrame([(i, "a", "active", *point()) for i in range(150)], "id long, address string, status string, lat double, lng double")
    permits = spark.createDataFrame([(i, "p", "NB", "a", *point()) for i in range(150)], "id long, permit_number string, permit_type string, address string, lat double, lng double")
    got = [(r.listing_id, r.permit_id) for r in spatial.proximity_alerts(permits, listings, radius=miles, floor=floor).collect()]
    want = {(a.id, b.id) for a in listings.collect() for b in permits.collect() if hav(a.lat, a.lng, b.lat, b.lng, 3959.0) <= miles}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 50
