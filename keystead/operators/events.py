"""Listing events from the log of sightings, current state and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .skew import HOT_FLOOR, with_previous

GAP_SECONDS = 48 * 3600


def price_event(old: Column, new: Column) -> Column:
    """price_drop / price_increase; NULL when equal or either side is NULL."""
    return F.when(new < old, "price_drop").when(new > old, "price_increase")


def detect_changes(
    obs: DataFrame,
    key: str = "listing_id",
    order: tuple[str, ...] = ("scraped_sec",),
    gap: int = GAP_SECONDS,
    floor: int = HOT_FLOOR,
) -> DataFrame:
    """Every sighting with its event (NULL: nothing to tell) and the price before.

    ``order[0]`` is the time in seconds; further columns break ties. A gap of more
    than ``gap`` seconds means the listing had been removed in between, so the
    sighting counts as relisted, whatever the price did.
    """
    time = order[0]
    out = with_previous(obs, [key], list(order), ["price", time], floor)
    prev = F.col("_prev")
    changed = price_event(prev["price"], F.col("price"))
    return out.select(
        *obs.columns,
        prev["price"].alias("previous_price"),
        prev[time].alias("previous_time"),
        changed.alias("price_change"),
        F.when(prev.isNull(), "listed")
        .when(F.col(time) - prev[time] > gap, "relisted")
        .otherwise(changed)
        .alias("event_type"),
    )


def upsert_events(current: DataFrame, batch: DataFrame, order: tuple[str, ...], key: str = "canonical_hash", floor: int = HOT_FLOOR) -> DataFrame:
    """Every row of a batch with its event against the stored table: (batch columns, previous_price, price_change, event_type).

    Rows count in the order of arrival: a batch follows all that is stored, whatever its times, and ``order`` holds
    within the batch. The first row of a key that is stored as removed is relisted, whatever the price did; of a key
    that is not stored, listed.
    """
    known = current.select(F.col(key).alias("_key"), F.col("price").alias("_price"), (F.col("status") == "removed").alias("_removed"), F.lit(True).alias("_stored"))
    rows = batch.join(known, F.col(key) == F.col("_key"), "left").drop("_key")
    out = with_previous(rows, [key], list(order), ["price"], floor)
    first = F.col("_prev").isNull()
    old = F.when(first, F.col("_price")).otherwise(F.col("_prev")["price"])
    changed = price_event(old, F.col("price"))
    event = F.when(first & F.col("_stored").isNull(), "listed").when(first & F.col("_removed"), "relisted").otherwise(changed)
    return out.select(*batch.columns, old.alias("previous_price"), changed.alias("price_change"), event.alias("event_type"))


def listing_events(changes: DataFrame) -> DataFrame:
    return changes.filter(F.col("event_type").isNotNull())


def price_history(changes: DataFrame) -> DataFrame:
    """One row per price change, also when the event itself says relisted."""
    return changes.filter(F.col("price_change").isNotNull())


def removal_events(changes: DataFrame, now: int, key: str = "listing_id", time: str = "scraped_sec") -> DataFrame:
    """Removals between sightings and after the last one, dated last sighting + gap."""
    between = changes.filter(F.col(time) - F.col("previous_time") > GAP_SECONDS).select(
        key, (F.col("previous_time") + GAP_SECONDS).alias("removed_at")
    )
    final = (
        changes.groupBy(key).agg(F.max(time).alias("last_seen"))
        .filter(F.lit(now) - F.col("last_seen") > GAP_SECONDS)
        .select(key, (F.col("last_seen") + GAP_SECONDS).alias("removed_at"))
    )
    return between.unionByName(final).withColumn("event_type", F.lit("removed"))


def last_known(value: Column, order: Column) -> Column:
    """Value of the latest row that has one (combined before the shuffle)."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def current_listings(
    obs: DataFrame, key: str, order: tuple[str, ...], overwrite: list[str], keep: list[str] = (), keep_text: list[str] = ()
) -> DataFrame:
    """Latest state per key.

    ``overwrite`` columns come from the last row even when NULL; ``keep`` columns
    from the last row that has a value; ``keep_text`` also skips ''.
    """
    at = F.struct(*order)
    aggs = [F.max_by(F.struct(*overwrite), at).alias("_last")]
    aggs += [last_known(F.col(c), at).alias(c) for c in keep]
    aggs += [last_known(F.nullif(F.col(c), F.lit("")), at).alias(c) for c in keep_text]
    out = obs.groupBy(key).agg(
        *aggs, F.min(order[0]).alias("first_seen"), F.max(order[0]).alias("last_seen")
    )
    return out.select(key, "_last.*", *keep, *keep_text, "first_seen", "last_seen")


OVERWRITTEN = ("source_url", "address", "price", "bedrooms", "bathrooms", "sqft", "raw_data")
KEPT = ("lat", "lng")
KEPT_TEXT = ("neighborhood", "borough")


def merge_listings(current: DataFrame, batch: DataFrame, now: Column, order: tuple[str, ...]) -> DataFrame:
    """Keyed upsert of a batch into the listings table.

    Both sides are unique on the key after the batch is folded, so the outer
    join has no skew. Untouched rows pass through unchanged, and every stored column is kept.
    """
    at = F.struct(*order)
    new = batch.groupBy("canonical_hash").agg(
        F.max_by(F.struct(*[c for c in OVERWRITTEN if c in batch.columns]), at).alias("n"),
        *[last_known(F.col(c), at).alias(f"n_{c}") for c in KEPT],
        *[last_known(F.nullif(F.col(c), F.lit("")), at).alias(f"n_{c}") for c in KEPT_TEXT],
        *[F.min_by(F.col(c), at).alias(f"f_{c}") for c in KEPT_TEXT],
    )
    j = current.withColumn("_old", F.lit(True)).join(new.withColumn("_new", F.lit(True)), "canonical_hash", "full")
    seen = F.col("_new").isNotNull()
    cols = {}
    for c in OVERWRITTEN:
        if c in batch.columns:
            cols[c] = F.when(seen, F.col(f"n.{c}")).otherwise(F.col(c))
    for c in KEPT:
        cols[c] = F.coalesce(f"n_{c}", c)
    for c in KEPT_TEXT:
        # an insert stores the text as given, '' included
        cols[c] = F.coalesce(f"n_{c}", c, F.when(F.col("_old").isNull(), F.col(f"f_{c}")))
    cols["status"] = F.when(seen, F.lit("active")).otherwise(F.col("status"))
    cols["first_seen_at"] = F.coalesce(F.col("first_seen_at"), now)
    cols["last_seen_at"] = F.when(seen, now).otherwise(F.col("last_seen_at"))
    # stored columns that a batch never writes stay as they are (NULL in new rows)
    stays = [c for c in current.columns if c not in cols and c != "canonical_hash"]
    return j.select("canonical_hash", *[v.alias(k) for k, v in cols.items()], *stays)


def upsert_listings(store, batch: DataFrame, batch_id: str, now: Column, order: tuple[str, ...]) -> bool:
    """Merge a batch into a stored listings table (``sources.keyed.KeyedRuns``) that is read and written in one go.

    Only stored rows of the batch's keys are read, and only these are written. A batch that was merged before changes
    nothing.
    """
    return store.apply(batch_id, lambda version: merge_listings(store.read(version, batch), batch, now, order).select(*store.columns))


def detect_removed(
    listings: DataFrame, now: Column, hours: int = 48, last_seen: str = "last_seen_at"
) -> tuple[DataFrame, DataFrame]:
    """Mark active listings not seen for ``hours``; one removed event for each."""
    cutoff = now - F.make_dt_interval(hours=F.lit(hours))
    stale = (F.col("status") == "active") & (F.col(last_seen) < cutoff)
    marked = listings.withColumn("updated_at", F.when(stale, now).otherwise(F.col("updated_at"))).withColumn(
        "status", F.when(stale, "removed").otherwise(F.col("status"))
    )
    events = listings.filter(stale).select(
        F.col("id").alias("listing_id"), F.lit("removed").alias("event_type"), now.alias("created_at")
    )
    return marked, events


def event_rows(events: DataFrame, listings: DataFrame) -> DataFrame:
    """Events with the details of their listing; cents become dollars.

    A price of NULL or 0 cents becomes NULL, as does a missing old price.
    """
    dollars = F.nullif(F.col("price_cents"), F.lit(0)) / 100
    old = events.withColumn("old_price", F.col("old_price_cents") / 100).drop("old_price_cents")
    return old.join(listings.withColumn("price", dollars).drop("price_cents"), "canonical_hash")


# --- price history reports ---


def price_stats(history: DataFrame, key: str = "listing_id", order: tuple[str, ...] = ("recorded_at",)) -> DataFrame:
    """Current, low, high and change of every listing's price series."""
    at = F.struct(*order)
    first, last = F.col("first_price"), F.col("current")
    change = last - first
    return (
        history.filter(F.col("price").isNotNull())
        .groupBy(key)
        .agg(
            F.min_by("price", at).alias("first_price"),
            F.max_by("price", at).alias("current"),
            F.min("price").alias("low"),
            F.max("price").alias("high"),
        )
        .select(
            key, "current", "low", "high", change.alias("change"),
            F.when(first > 0, change / first * 100).otherwise(F.lit(0.0)).alias("change_pct"),
        )
    )


def price_pivot(history: DataFrame, day: Column, sources: list[str], order: tuple[str, ...], key: str = "listing_id"):
    """One row per listing and day, one column per source, last price wins."""
    return (
        history.withColumn("day", day)
        .groupBy(key, "day")
        .pivot("source", sources)
        .agg(F.max_by("price", F.struct(*order)))
    )


def price_change_pct(history: DataFrame, key: str = "listing_id", order: tuple[str, ...] = ("recorded_at",)):
    """Original price, latest price and the change between them in percent."""
    at = F.struct(*order)
    return (
        history.filter(F.col("price").isNotNull())
        .groupBy(key)
        .agg(F.min_by("price", at).alias("original_price"), F.max_by("price", at).alias("current_price"))
        .withColumn(
            "price_change_pct",
            F.when(
                F.col("original_price") > 0,
                (F.col("current_price") - F.col("original_price")) / F.col("original_price") * 100,
            ),
        )
    )


def chart_date(ts: Column) -> Column:
    """Axis label such as 'Jan 5'."""
    return F.date_format(ts, "MMM d")
