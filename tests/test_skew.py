"""Hot-key paths against plain windows and joins, with the hot limit set low."""

import random

from pyspark.sql import Window as W, functions as F

from keystead.operators import health, skew


def skewed(spark, n=3000):
    rng = random.Random(5)
    rows = []
    for i in range(n):
        k = "hot" if rng.random() < 0.4 else f"k{rng.randrange(200)}"
        rows.append((k, rng.randrange(4000), i, rng.choice([None, 1, 2, 3])))
    rows += [(None, 5, n, 1), (None, 9, n + 1, 2)]
    return spark.createDataFrame(rows, "k string, t long, id long, price int")


def test_hot_keys_are_bounded_and_exact(spark):
    df = skewed(spark)
    hot = skew.hot_keys(df, ["k"], floor=100).collect()
    assert [r.k for r in hot] == ["hot"]
    assert hot[0]["_n"] == df.filter("k = 'hot'").count()
    assert skew.hot_keys(df, ["k"]).count() == 0


def test_previous_row_across_segments(spark):
    df = skewed(spark)
    w = W.partitionBy("k").orderBy("t", "id")
    want = df.withColumn("p", F.lag("price").over(w)).withColumn("pt", F.lag("t").over(w))
    cut = skew.with_segments(df, ["k"], ["t"], floor=50)
    assert cut.filter("_hot").select("_seg").distinct().count() > 10
    got = skew.with_previous(df, ["k"], ["t", "id"], ["price", "t"], floor=50)
    got = got.select("id", F.col("_prev.price").alias("p"), F.col("_prev.t").alias("pt"))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select("id", "p", "pt").collect()))


def test_salted_join_keeps_all_rows(spark):
    df = skewed(spark)
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), ("zz", 4)], "k string, v int")
    for how in ("inner", "left"):
        want = df.join(small, "k", how).select("id", "v")
        for salt_by in (None, ["id"]):
            got = skew.salted_join(df, small, ["k"], how=how, floor=50, salt_by=salt_by).select("id", "v")
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_failure_streak_segments_and_start(spark):
    rng = random.Random(3)
    rows, streak, want = [], {"a": 2, "b": 0}, {}
    for i in range(2000):
        src = "a" if rng.random() < 0.8 else "b"
        ok = 0 if i < 300 else int(rng.random() < 0.3)
        streak[src] = 0 if ok else streak[src] + 1
        want[i] = streak[src]
        rows.append((i, float(i // 2), src, ok))
    df = spark.createDataFrame(rows, "run_id long, ts_sec double, source string, success int")
    start = spark.createDataFrame([("a", 2)], "source string, streak long")
    for floor in (20, 10**6):
        got = health.failure_streak(df, start=start, floor=floor).select("run_id", "streak").collect()
        assert {r.run_id: r.streak for r in got} == want


def test_listing_detail_is_one_row_at_every_history_length(spark):
    from keystead.operators.search import listing_detail

    listings = spark.createDataFrame([(1, 40.7, -74.0), (2, None, None), (3, 40.7, -74.0)], "id long, lat double, lng double")
    sources = spark.createDataFrame([(1, "zillow", "u", 5)], "listing_id long, source string, source_url string, scraped_at long")
    history = spark.range(2_500).selectExpr(
        "1L AS listing_id", "id DIV 2 AS recorded_at", "cast(id AS int) AS price", "0 AS previous_price", "'price_drop' AS event_type"
    ).union(spark.createDataFrame([(3, 1, 2, 1, "price_increase")], "listing_id long, recorded_at long, price int, previous_price int, event_type string"))
    register = spark.createDataFrame([(1,)], "id long")
    for page, want in ((1, (1_000, 0)), (3, (500, 2_000)), (4, None)):
        rows = {r["id"]: r for r in listing_detail(listings, sources, history, register, page_rows=1_000, page=page).collect()}
        assert sorted(rows) == [1, 2, 3]
        assert [rows[i]["n_history"] for i in (1, 2, 3)] == [2_500, 0, 1]
        got = rows[1]["price_history"]
        assert (got and (len(got), got[0]["price"])) == want
        assert rows[2]["rs_nearby"] is False and rows[3]["rs_nearby"] is True


def test_slices_are_even_however_rows_bunch(spark):
    """90 % of a key's rows in one minute, and a key with all rows at one instant, cut by the tie columns."""
    df = spark.range(40_000).selectExpr(
        "IF(id < 20000, 'burst', IF(id < 39000, 'instant', concat('k', id))) AS k",
        "CASE WHEN id < 18000 THEN 1000000 + id % 60 WHEN id < 20000 THEN id * 1000 WHEN id < 39000 THEN 5 ELSE id END AS t",
        "id * 7919 % 40009 AS tie", "CAST(id % 13 AS INT) AS price", "id")
    cut, any_hot = skew.hot_slices(df, ["k"], ["t", "tie"], floor=2000)
    assert any_hot
    sizes = [r["count"] for r in cut.filter("_hot").groupBy("k", "_seg").count().collect()]
    assert len(sizes) > 40 and max(sizes) <= 3 * sorted(sizes)[len(sizes) // 2]
    got = {r.id: r._prev for r in skew.with_previous(df, ["k"], ["t", "tie"], ["price", "id"], floor=2000).collect()}
    last = {}
    for r in sorted(df.collect(), key=lambda r: (r.t, r.tie)):
        assert (got[r.id] and got[r.id]["id"]) == last.get(r.k), r
        last[r.k] = r.id
    assert skew.hot_slices(df, ["k"], ["t"])[1] is False


def test_deep_pages_of_a_hot_listing_read_the_slices_of_their_ranks(spark):
    from keystead.operators import search as S

    listings = spark.createDataFrame([(1, 1.0, 1.0), (2, None, None), (3, 1.0, 1.0)], "id long, lat double, lng double")
    sources = spark.createDataFrame([(1, "a", "u", 1)], "listing_id long, source string, source_url string, scraped_at long")
    history = spark.range(9000).selectExpr("IF(id % 30 = 0, 2L, 1L) AS listing_id", "id % 50 AS recorded_at", "id AS price", "id AS previous_price", "'x' AS event_type")
    register = spark.range(1)
    rows = sorted((r.recorded_at, r.price) for r in history.filter("listing_id = 1").collect())
    for floor in (1000, 10**6):
        for page in (1, 3, 8, 9):
            out = {r.id: r for r in S.listing_detail(listings, sources, history, register, 1200, page, floor).collect()}
            assert out[1].n_history == 8700 and out[2].n_history == 300 and out[3].n_history == 0
            assert [(h.recorded_at, h.price) for h in out[1].price_history or []] == rows[(page - 1) * 1200 : page * 1200]
            assert len(out[2].price_history or []) == (300 if page == 1 else 0)


def test_register_match_with_a_very_common_word(spark):
    """Every address holds the word; keys that begin with a blank are found at the begin of a word only."""
    from keystead.operators import register as G

    addresses = [f"{i} EAST 7TH STREET" for i in range(300)] + ["12  EAST 7TH", " 5 EAST 7TH", "A12 EAST 7TH", "", " ", "ONE", None]
    listings = spark.createDataFrame(list(enumerate(addresses)), "id long, address string")
    keys = [("7", "East 7th"), ("2", "EAST"), (" 12", "East 7th"), ("12", " East"), ("", "x"), ("300", "Nowhere St"), ("5", "East 7th S")]
    reg = spark.createDataFrame(keys, "building_number string, street_name string")
    needles = [f"{n} {s}".upper() for n, s in keys if n.strip() and s.strip()]
    want = {i: any(k in (a or "").upper() for k in needles) for i, a in enumerate(addresses)}
    for floor in (5, 10**6):
        got = {r.id: r.hcr_match for r in G.register_match(listings, reg, floor=floor).collect()}
        assert got == want
