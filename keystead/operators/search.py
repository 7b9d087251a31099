"""Listing search, paging, statistics, nesting and similar listings."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.geo import within_radius
from ..functions.numbers import py_round
from .skew import HOT_FLOOR, hot_keys, hot_slices


@dataclass
class Filters:
    """Search parameters; ``None`` (or empty text / list) switches a test off."""

    status: str = "active"
    min_price: int | None = None
    max_price: int | None = None
    bedrooms: list[int] | None = None
    borough: str | None = None
    neighborhood: str | None = None
    min_undervalue_score: float | None = None
    min_rs_probability: float | None = None
    amenities: list[str] | None = None
    lat: float | None = None
    lng: float | None = None
    radius_miles: float | None = None
    # names only the client sends
    boroughs: list[str] | None = None
    neighborhoods: list[str] | None = None
    bathrooms_min: float | None = None


def predicates(f: Filters) -> list[Column]:
    c = F.col
    tests: list[tuple[bool, Column]] = []

    def test(on, cond):
        if on:
            tests.append(cond())

    test(f.status, lambda: c("status") == f.status)
    test(f.min_price is not None, lambda: c("price") >= f.min_price)
    test(f.max_price is not None, lambda: c("price") <= f.max_price)
    test(f.bedrooms, lambda: c("bedrooms").isin(*f.bedrooms))
    test(f.borough, lambda: c("borough") == f.borough)
    test(f.neighborhood, lambda: c("neighborhood") == f.neighborhood)
    test(f.boroughs, lambda: c("borough").isin(*f.boroughs))
    test(f.neighborhoods, lambda: c("neighborhood").isin(*f.neighborhoods))
    test(f.bathrooms_min is not None, lambda: c("bathrooms") >= f.bathrooms_min)
    test(f.min_undervalue_score is not None, lambda: c("undervalue_score") >= f.min_undervalue_score)
    test(f.min_rs_probability is not None, lambda: c("rs_probability") >= f.min_rs_probability)
    test(f.amenities, lambda: contains_all(c("amenities"), F.array(*map(F.lit, f.amenities))))
    test(
        None not in (f.lat, f.lng, f.radius_miles),
        lambda: within_radius(c("lat"), c("lng"), f.lat, f.lng, f.radius_miles),
    )
    return tests


def contains_all(present: Column, required: Column) -> Column:
    """Every required element is present; nothing required passes."""
    missing = F.exists(required, lambda a: ~F.coalesce(F.array_contains(present, a), F.lit(False)))
    return (F.size(required) == 0) | ~missing


def search_listings(df: DataFrame, f: Filters) -> DataFrame:
    for p in predicates(f):
        df = df.filter(p)
    return df


SORT_COLUMNS = {
    "price": "price",
    "undervalue_score": "undervalue_score",
    "rs_probability": "rs_probability",
    "days_on_market": "days_on_market",
    "created_at": "created_at",
}
CLIENT_SORT_COLUMNS = {**SORT_COLUMNS, "quality_score": "quality_score", "dom": "days_on_market"}


def sort_order(by: str = "created_at", order: str = "desc", client: bool = False) -> list[Column]:
    """Allowed sort keys with the NULL order of PostgreSQL and id as tie-break."""
    table = CLIENT_SORT_COLUMNS if client else SORT_COLUMNS
    col = F.col(table.get(by, "created_at"))
    return [col.asc_nulls_last() if order == "asc" else col.desc_nulls_first(), F.col("id").asc()]


def sort_listings(df: DataFrame, by: str = "created_at", order: str = "desc", client: bool = False):
    return df.orderBy(*sort_order(by, order, client))


def page(df: DataFrame, number: int, per_page: int) -> DataFrame:
    return df.offset((number - 1) * per_page).limit(per_page)


def page_info(df: DataFrame, number: int, per_page: int) -> DataFrame:
    """Total and page count of a filtered table."""
    total = F.col("total")
    pages = F.floor((total + per_page - 1) / per_page).cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(number).alias("page"),
        F.lit(per_page).alias("per_page"),
        F.when(total > 0, pages).otherwise(F.lit(0).cast("bigint")).alias("pages"),
    )


LISTING_COLUMNS = (
    "id", "address", "borough", "neighborhood", "price", "bedrooms", "bathrooms", "sqft", "amenities",
    "lat", "lng", "undervalue_score", "rs_probability", "quality_score", "status", "source_count",
    "days_on_market", "created_at",
)


def to_listing_row(df: DataFrame) -> DataFrame:
    return df.select(*LISTING_COLUMNS)


def listing_stats(df: DataFrame, borough: str | None = None) -> DataFrame:
    """Active listings per borough and neighbourhood."""
    df = df.filter(F.col("status") == "active")
    if borough:
        df = df.filter(F.col("borough") == borough)
    avg_price, avg_score = F.avg("price"), F.avg("undervalue_score")
    return (
        df.groupBy("borough", "neighborhood")
        .agg(
            F.count(F.lit(1)).alias("count"),
            py_round(F.nullif(avg_price, F.lit(0.0)), 2).alias("avg_price"),
            F.min("price").alias("min_price"),
            F.max("price").alias("max_price"),
            py_round(F.nullif(avg_score, F.lit(0.0)), 4).alias("avg_undervalue_score"),
        )
        .orderBy(F.col("borough").asc_nulls_last(), F.col("neighborhood").asc_nulls_last())
    )


def market_overview(df: DataFrame) -> DataFrame:
    """Totals, per borough and per bedroom count, as one table.

    Rows are first folded to (borough, bedrooms, price) with a count, so the
    exact median works on a frequency table instead of on all rows.
    """
    folded = df.groupBy("borough", "bedrooms", "price").agg(F.count(F.lit(1)).alias("n"))
    sums = [
        F.sum("n").alias("count"),
        (F.sum(F.col("price").cast("double") * F.col("n")) / F.sum(F.when(F.col("price").isNotNull(), F.col("n")))).alias("avg_price"),
    ]
    none = F.lit(None)
    total = folded.agg(*sums, F.percentile("price", 0.5, F.col("n")).alias("median_price")).select(
        F.lit("total").alias("section"), F.lit("all").alias("key"), "count", "avg_price", "median_price"
    )
    parts = [
        folded.groupBy(k).agg(*sums).select(
            F.lit(f"by_{k}").alias("section"), F.col(k).cast("string").alias("key"),
            "count", "avg_price", none.cast("double").alias("median_price"),
        )
        for k in ("borough", "bedrooms")
    ]
    return total.unionByName(parts[0]).unionByName(parts[1])


def with_rs_nearby(listings: DataFrame, register: DataFrame) -> DataFrame:
    """Flag ``rs_nearby``: the listing has a position and the register is not empty."""
    known = register.limit(1).agg((F.count(F.lit(1)) > 0).alias("known")).scalar()
    return listings.withColumn("rs_nearby", F.col("lat").isNotNull() & F.col("lng").isNotNull() & known)


def listing_detail(
    listings: DataFrame, sources: DataFrame, history: DataFrame, register: DataFrame, page_rows: int, page: int = 1,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Listing with its sources and one page of its price history, nested in time order: always one row a listing.

    ``n_history`` counts the whole history; page ``page`` (from 1) holds its rows (page - 1) * page_rows + 1 to
    page * page_rows, an empty page is NULL. The history of a hot listing is cut into even slices; any page is read
    from the slices that hold its ranks.
    Sources are unique per (listing, source) and therefore few.
    """
    src = (
        sources.groupBy("listing_id", "source")
        .agg(F.max_by(F.struct("source_url", "scraped_at"), F.struct("scraped_at", "source_url")).alias("s"))
        .groupBy("listing_id")
        .agg(F.array_sort(F.collect_list(F.struct("source", "s.source_url", "s.scraped_at"))).alias("sources"))
    )
    entry = ("recorded_at", "price", "previous_price", "event_type")
    first, last = (page - 1) * page_rows, page * page_rows
    cut, any_hot = hot_slices(history.select("listing_id", *entry), ["listing_id"], list(entry), floor)
    in_slice = F.row_number().over(W.partitionBy("listing_id", "_seg").orderBy(*entry))
    if any_hot:
        # counts of the slices before a slice tell which ranks it holds; slices without any of the page are not sorted
        sizes = cut.filter("_hot").groupBy("listing_id", "_seg").agg(F.count(F.lit(1)).alias("_rows"))
        before = F.sum("_rows").over(W.partitionBy("listing_id").orderBy("_seg").rowsBetween(W.unboundedPreceding, -1))
        held = sizes.withColumn("_before", F.coalesce(before, F.lit(0))).filter((F.col("_before") < last) & (F.col("_before") + F.col("_rows") > first))
        held = held.select(F.col("listing_id").alias("_h_id"), F.col("_seg").alias("_h_seg"), "_before")
        cut = cut.join(F.broadcast(held), (F.col("listing_id") == F.col("_h_id")) & (F.col("_seg") == F.col("_h_seg")), "left")
        cut = cut.filter(~F.col("_hot") | F.col("_before").isNotNull()).withColumn("_rank", in_slice + F.coalesce("_before", F.lit(0)))
    else:
        cut = cut.withColumn("_rank", in_slice)
    hist = (
        cut.filter((F.col("_rank") <= last) & (F.col("_rank") > first))
        .groupBy("listing_id")
        .agg(F.array_sort(F.collect_list(F.struct(*entry))).alias("price_history"))
    )
    total = history.groupBy("listing_id").agg(F.count(F.lit(1)).alias("n_history"))
    return (
        with_rs_nearby(listings, register)
        .join(src.withColumnRenamed("listing_id", "id"), "id", "left")
        .join(hist.withColumnRenamed("listing_id", "id"), "id", "left")
        .join(total.withColumnRenamed("listing_id", "id"), "id", "left")
        .withColumn("n_history", F.coalesce("n_history", F.lit(0)))
    )


def similar(listings: DataFrame, ids: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Closest-priced active listings: same borough, bedrooms +-1, price +-30 %.

    The answer depends only on (borough, bedrooms, price), and of candidates
    with one price only the lowest ``k+1`` ids can appear. So the search runs on
    price points: each point knows its ``k+1`` nearest candidates below and
    above from two running windows, never a pair list of listings.
    """
    keep = k + 1
    cands = listings.filter(
        (F.col("status") == "active")
        & F.col("borough").isNotNull() & F.col("bedrooms").isNotNull() & F.col("price").isNotNull()
    ).select("borough", "bedrooms", "price", "id")
    lowest = W.partitionBy("borough", "bedrooms", "price").orderBy("id")
    points = (
        cands.withColumn("rn", F.row_number().over(lowest))
        .filter(F.col("rn") <= keep)
        .groupBy("borough", "bedrooms", "price")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    asked = listings if ids is None else listings.join(ids.select("id").distinct(), "id", "left_semi")
    profiles = asked.select("borough", F.col("bedrooms").alias("beds"), "price").dropna().distinct()
    probes = profiles.withColumn(
        "bedrooms", F.explode(F.array(F.col("beds") - 1, F.col("beds"), F.col("beds") + 1))
    )
    line = (
        points.unionByName(
            probes.select("borough", "bedrooms", "price").distinct().withColumn(
                "ids", F.lit(None).cast("array<bigint>")
            )
        )
        .groupBy("borough", "bedrooms", "price")
        .agg(F.max("ids").alias("ids"))
    )
    has = F.col("ids").isNotNull()
    group = W.partitionBy("borough", "bedrooms", has)
    span = F.when(has, F.transform("ids", lambda i: F.struct(F.col("price").alias("price"), i.alias("id"))))

    def nearest(order: Column) -> Column:
        near = F.flatten(F.collect_list("span").over(group.orderBy(order).rowsBetween(-(keep - 1), 0)))
        by_price = F.array_sort(
            near,
            lambda a, b: F.when(a.price == b.price, F.when(a.id < b.id, -1).otherwise(1))
            .when((a.price > b.price) == F.lit(order is up), -1)
            .otherwise(1),
        )
        return F.when(has, F.slice(by_price, 1, keep))

    up, down = F.col("price").asc(), F.col("price").desc()
    line = line.withColumn("span", span)
    line = line.withColumn("below", nearest(up)).withColumn("above", nearest(down))
    run = W.partitionBy("borough", "bedrooms")
    # `above` is exclusive so that candidates at the very price are not met twice.
    line = line.withColumn(
        "below", F.last("below", True).over(run.orderBy(up).rowsBetween(W.unboundedPreceding, 0))
    ).withColumn(
        "above", F.last("above", True).over(run.orderBy(down).rowsBetween(W.unboundedPreceding, -1))
    )
    none = F.array().cast("array<struct<price:int,id:bigint>>")
    answers = line.select(
        "borough", "bedrooms", "price",
        F.concat(F.coalesce("below", none), F.coalesce("above", none)).alias("near"),
    )
    p = F.col("price")
    lo, hi = F.floor(p.cast("double") * 0.7), F.floor(p.cast("double") * 1.3)
    best = (
        probes.join(answers, ["borough", "bedrooms", "price"])
        .groupBy("borough", "beds", "price")
        .agg(F.flatten(F.collect_list("near")).alias("near"))
        .select(
            "borough", F.col("beds").alias("bedrooms"), "price",
            F.slice(
                F.array_sort(
                    F.transform(
                        F.filter("near", lambda x: (x.price >= lo) & (x.price <= hi)),
                        lambda x: F.struct(
                            F.abs(x.price - p).alias("gap"), x.id.alias("similar_id"), x.price.alias("similar_price")
                        ),
                    )
                ),
                1, keep,
            ).alias("near"),
        )
    )
    picked = asked.select("id", "borough", "bedrooms", "price").join(
        best, ["borough", "bedrooms", "price"]
    )
    own = F.slice(F.filter("near", lambda x: x.similar_id != F.col("id")), 1, k)
    return picked.select("id", F.posexplode(own).alias("pos", "s")).select(
        "id", (F.col("pos") + 1).alias("rank"), "s.similar_id", "s.similar_price", "s.gap"
    )


def list_searches(searches: DataFrame, user_id: int) -> DataFrame:
    return searches.filter((F.col("user_id") == user_id) & F.col("is_active")).orderBy(
        F.col("created_at").desc(), F.col("search_id").desc()
    )


def deactivate(searches: DataFrame, ids: DataFrame) -> DataFrame:
    """Soft delete: rows stay, ``is_active`` becomes false."""
    gone = ids.select(F.col("search_id").alias("_gone")).distinct()
    return searches.join(gone, searches["search_id"] == gone["_gone"], "left").withColumn(
        "is_active", F.col("is_active") & F.col("_gone").isNull()
    ).drop("_gone")


def patch_rows(table: DataFrame, patches: DataFrame, key: str, owner: str, order: list[str]) -> DataFrame:
    """The rows of ``table`` that ``patches`` create or change, whole; patches of another owner's row change nothing.

    A patch has any columns of the table and ``given``, the names of those that it sets (NULL: all that it has), also to
    NULL. Of several patches of a row the last one that gives a column counts, so they are folded by one combined
    aggregate. A key that is not stored is created by its first patch's owner; columns never given are NULL.
    """
    fields = [c for c in table.columns if c in patches.columns and c not in (key, owner)]
    at = F.struct(*order)
    sets = lambda c: F.col("given").isNull() | F.array_contains("given", c)
    first = patches.groupBy(key).agg(F.min_by(F.col(owner), at).alias("_creator"))
    mine = patches.groupBy(key, owner).agg(*[F.max_by(F.struct(F.col(c).alias("v")), F.when(sets(c), at)).alias(f"_{c}") for c in fields])
    j = mine.join(first, key).withColumnsRenamed({key: "_key", owner: "_owner"}).join(table.withColumn("_stored", F.lit(True)), F.col("_key") == F.col(key), "left")
    known = F.col("_stored").isNotNull()
    j = j.filter((known & F.col(owner).eqNullSafe(F.col("_owner"))) | (~known & F.col("_creator").eqNullSafe(F.col("_owner"))))
    new = {key: F.col("_key"), owner: F.col("_owner"), **{c: F.when(F.col(f"_{c}").isNotNull(), F.col(f"_{c}")["v"]).otherwise(F.col(c)) for c in fields}}
    return j.select(*[new.get(c, F.col(c)).cast(table.schema[c].dataType).alias(c) for c in table.columns])


def notification_pages(df: DataFrame, page: int, per_page: int = 20, unread: bool = False) -> DataFrame:
    """One page of every user's notifications, newest first, with ``rank``, the user's ``total`` and number of ``pages``.

    Tasks pass on the first rows of a user only; the totals are a combined count.
    """
    if unread:
        df = df.filter(F.col("read_at").isNull())
    newest = W.partitionBy("user_id").orderBy(F.col("sent_at").desc(), F.col("id").desc())
    ranked = df.withColumn("rank", F.row_number().over(newest)).filter((F.col("rank") <= page * per_page) & (F.col("rank") > (page - 1) * per_page))
    totals = df.groupBy(F.col("user_id").alias("_user")).agg(F.count(F.lit(1)).alias("total"))
    return ranked.join(totals, F.col("user_id") == F.col("_user")).drop("_user").withColumn("pages", F.ceil(F.col("total") / per_page).cast("bigint"))


def list_notifications(df: DataFrame, user_id: int, unread: bool = False) -> DataFrame:
    df = df.filter(F.col("user_id") == user_id)
    if unread:
        df = df.filter(F.col("read_at").isNull())
    return df.orderBy(F.col("sent_at").desc(), F.col("id").desc())


def mark_read(df: DataFrame, user_id: int, now: Column, notification_id: int | None = None) -> DataFrame:
    """One id: always stamped; without id: only the user's unread rows."""
    mine = F.col("user_id") == user_id
    hit = mine & (
        F.col("read_at").isNull() if notification_id is None else F.col("id") == notification_id
    )
    return df.withColumn("read_at", F.when(hit, now).otherwise(F.col("read_at")))


def unread_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.count_if(F.col("read_at").isNull()).alias("unread"))


def source_counts(observations: DataFrame) -> DataFrame:
    """Distinct sources per listing; pairs are combined before the second count."""
    return (
        observations.select("listing_id", "source").distinct()
        .groupBy("listing_id")
        .agg(
            F.count("source").cast("int").alias("source_count"),
            F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"),
        )
    )
