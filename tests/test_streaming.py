"""Streams over several time-ordered micro-batches give the rows of the batch jobs."""

import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from keystead.operators import events as E, health as H, limiter as L, matching as M
from keystead.plans.event_queries import ORDER, alerts, runs
from keystead.session import work_dir
from keystead.sources import derived as D
from keystead.sources.keyed import KeyedRuns
from keystead.streaming import jobs as J


def sliced(spark, df, time, folder, parts=4):
    """Time-ordered files, one micro-batch each; an instant is never split."""
    lo, hi = df.agg(F.min(time), F.max(time)).first()
    step = (hi - lo) / parts + 1
    for i in range(parts):
        part = df.filter((F.col(time) >= lo + i * step) & (F.col(time) < lo + (i + 1) * step))
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("floor", [5, 10**6])
def test_upserts(spark, sf, floor):
    out = work_dir(spark, "t01")
    obs = D.view(spark, sf, "observations")
    stream = sliced(spark, obs, "scraped_sec", out)
    J.stream_upserts(stream, f"{out}/data", f"{out}/cp", "listing_id", list(ORDER), floor=floor)
    cols = ["listing_id", *ORDER, "price", "previous_price", "event_type"]
    got = spark.read.parquet(f"{out}/data/changes").select(*cols)
    assert same(got, E.detect_changes(obs, order=ORDER).select(*cols))
    # a batch writes one state row per listing that it has, and nothing else
    for n in range(4):
        met = spark.read.parquet(f"{out}/data/changes/batch_id={n}").select("listing_id").distinct().count()
        assert spark.read.parquet(f"{out}/data/state/runs/run={n:012d}-{n:012d}").count() == met
    assert len(os.listdir(f"{out}/data/state/runs")) == 4


def batches_of(spark, out, schema, *batches):
    """One batch after the other through files."""
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{out}/in")
        yield spark.readStream.schema(schema).parquet(f"{out}/in")


def test_late_sightings_are_not_listed_again(spark):
    out, day = work_dir(spark, "t01-late"), 86400
    schema = "listing_id long, price int, scraped_sec long"
    batches = [[(1, 10, 1000), (2, 7, 1000)], [(1, 12, 500)], [(1, 12, 2000), (2, 6, 20 * day)], [(2, 6, 10 * day), (2, 5, 21 * day), (3, 1, 1)]]
    for stream in batches_of(spark, out, schema, *batches):
        J.stream_upserts(stream, f"{out}/data", f"{out}/cp", "listing_id", ["scraped_sec"])
    got = spark.read.parquet(f"{out}/data/changes").collect()
    assert sorted((r.listing_id, r.scraped_sec, r.previous_price, r.event_type or "") for r in got) == sorted([
        (1, 1000, None, "listed"), (2, 1000, None, "listed"), (1, 500, 10, "price_increase"), (1, 2000, 12, ""), (2, 20 * day, 7, "relisted"),
        (2, 10 * day, 6, ""), (2, 21 * day, 6, "price_drop"), (3, 1, None, "listed")], key=lambda r: (r[0], r[1]))


def test_limiter_reads_the_window_of_the_batch_before_only(spark):
    out = work_dir(spark, "t03-window")
    schema = "id long, user_id long, ts_sec double"
    batches = [[(100 * n + i, i % 2, 1800.0 * n + i) for i in range(50)] for n in range(6)]
    for n, stream in enumerate(batches_of(spark, out, schema, *batches)):
        for old in range(n - 1):  # nothing older is read again
            shutil.rmtree(f"{out}/data/window/batch_id={old}", ignore_errors=True)
            shutil.rmtree(f"{out}/data/accepted/batch_id={old}", ignore_errors=True)
        J.stream_rate_limit(stream, ["id"], f"{out}/data", f"{out}/cp")
        held = spark.read.parquet(f"{out}/data/window/batch_id={n}")
        assert held.count() <= 20 and held.agg(F.min("ts_sec")).first()[0] > 1800.0 * n + 49 - L.WINDOW_SECONDS - 50
    accepted = [r.id for r in spark.read.parquet(f"{out}/data/accepted").collect()]
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    assert set(accepted) == {r.id for r in L.rate_limit(whole, ["id"]).collect() if r.id >= 400}


def test_stale_plan_has_no_python(spark):
    seen = spark.readStream.format("rate").load().selectExpr("value AS listing_id", "timestamp AS seen_at")
    plan = J.stream_stale(seen, "listing_id")._jdf.queryExecution().analyzed().toString()
    assert "session_window" in plan and "Pandas" not in plan and "Python" not in plan


def test_health_keeps_streaks_of_quiet_sources(spark):
    out = work_dir(spark, "t05-quiet")
    schema = "run_id long, source string, ts string, ts_sec double, success int, n_listings int, duration_seconds double"
    fail = lambda i, s: (i, s, str(i), float(i), 0, 0, 1.0)
    batches = [[fail(1, "a"), fail(2, "a"), fail(3, "b")], [fail(4, "b")], [fail(5, "a")]]
    for stream in batches_of(spark, out, schema, *batches):
        J.stream_health(stream, f"{out}/out", f"{out}/cp")
    whole = spark.createDataFrame([r for b in batches for r in b], schema)
    cols = ["source", "run_id", "level", "message"]
    assert same(spark.read.parquet(f"{out}/out/alerts").select(*cols), H.run_alerts(H.failure_streak(whole)).select(*cols))


def test_keyed_runs(spark):
    """Versions over many writes and merges, replays, and what a batch rewrites."""
    rng = random.Random(4)
    path = work_dir(spark, "keyed")
    frame = lambda rows: spark.createDataFrame(rows, "k long, v string")
    store = KeyedRuns(spark, path, "k", frame([]).schema, buckets=4, fanout=3)
    assert store.live(0) == [] and store.live(13) == [(0, 8), (9, 11), (12, 12)] and store.table().count() == 0
    want = {}
    for n in range(11):
        rows = {rng.randrange(12): f"v{n}" for _ in range(rng.randrange(5))}
        assert store.apply(f"b{n}", lambda version: frame(list(rows.items()))) is True
        assert store.apply(f"b{n}", lambda version: frame([(1, "replayed")])) is False
        want |= rows
        if n == 5:  # a write that failed before its commit leaves nothing behind
            store.write(frame([(3, "lost")]), store.version())
    assert dict(store.table().collect()) == want and store.version() == 11
    some = frame([(k, "") for k in list(want)[:3]])
    assert dict(store.read(11, some).collect()) == {k: want[k] for k in list(want)[:3]}
    gone = store.vacuum(11)
    assert gone and dict(store.table().collect()) == want


def test_merge_sink_writes_what_a_batch_meets(spark, sf):
    from keystead.plans.event_queries import _sightings, _stored_listings

    current, sight = _stored_listings(spark, sf), _sightings(spark, sf)
    store = KeyedRuns(spark, work_dir(spark, "sink"), "canonical_hash", current.schema)
    store.apply("load", lambda version: current)
    batch = sight.filter("listing_id < 50")
    E.upsert_listings(store, batch, "one", F.lit(2), ORDER)
    assert spark.read.parquet(f"{store.path}/runs/run={1:012d}-{1:012d}").count() == batch.select("canonical_hash").distinct().count()
    assert same(store.table().select(*current.columns), E.merge_listings(current, batch, F.lit(2), ORDER).select(*current.columns))


def test_limiter(spark, sf):
    out = work_dir(spark, "t03")
    df = D.view(spark, sf, "notifications").select(
        "id", "user_id", (F.unix_micros(F.col("sent_at").cast("timestamp")) / 1e6).alias("ts_sec")
    )
    J.stream_rate_limit(sliced(spark, df, "ts_sec", out), ["id"], f"{out}/data", f"{out}/cp")
    assert same(spark.read.parquet(f"{out}/data/accepted").select("id"), L.rate_limit(df, ["id"]).select("id"))


def test_staleness(spark, sf):
    out = work_dir(spark, "t04")
    obs = D.view(spark, sf, "observations")
    now = obs.agg(F.max("scraped_sec")).first()[0]
    stream = sliced(spark, obs, "scraped_sec", out).select("listing_id", F.timestamp_seconds("scraped_sec").alias("seen_at"))
    J.run_available(J.stream_stale(stream, "listing_id"), f"{out}/data", f"{out}/cp")
    got = spark.read.parquet(f"{out}/data").select("listing_id", F.unix_seconds("removed_at").alias("removed_at"))
    want = E.removal_events(E.detect_changes(obs, order=ORDER), now).select("listing_id", "removed_at")
    assert same(got, want)


def test_health(spark, sf):
    out = work_dir(spark, "t05")
    df = runs(spark, sf)
    J.stream_health(sliced(spark, df, "ts_sec", out), f"{out}/out", f"{out}/cp")
    cols = ["source", "run_id", "level", "message"]
    assert same(spark.read.parquet(f"{out}/out/alerts").select(*cols), H.run_alerts(H.failure_streak(df)).select(*cols))


def test_dispatch(spark, sf):
    out = work_dir(spark, "t02")
    ev, searches, users = alerts(spark, sf), D.view(spark, sf, "saved_searches"), D.users(spark, sf)
    J.stream_dispatch(sliced(spark, ev, "ts_sec", out), searches, users, f"{out}/out", f"{out}/cp")
    slim = M.post_filter(M.match_searches(ev, searches, users)).select("user_id", "ts_sec", "search_id", "event_id")
    kept = M.with_details(L.rate_limit(slim, ["search_id", "event_id"]), ev, searches, users)
    cols = ["user_id", "search_id", "event_id", "channel", "deliverable"]
    got = spark.read.parquet(f"{out}/out/notifications")
    assert got.count() > 0 and same(got.select(*cols), M.dispatch(kept).select(*cols))
    sse = got.filter("channel = 'sse'").count()
    assert spark.read.parquet(f"{out}/out/messages").count() == sse
