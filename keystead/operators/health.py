"""Scrape-run monitoring: metric log, streaks, alerts and the per-source summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions.numbers import py_round
from ..sources.derived import SOURCES
from .skew import HOT_FLOOR, with_segments

MIN_LISTINGS = 5
MAX_SECONDS = 600
MAX_FAILURES = 3


def run_record(source: Column, at: Column, count: Column, seconds: Column, success: Column, error: Column):
    """Columns of one metric row."""
    return [
        source.alias("source"), at.alias("ts"), count.alias("n_listings"),
        py_round(seconds, 2).alias("duration_seconds"), success.cast("int").alias("success"), error.alias("error"),
    ]


def keep_last(df: DataFrame, keys: list[str], n: int, order: list[Column]) -> DataFrame:
    """Newest ``n`` rows per key (over all rows when ``keys`` is empty)."""
    if not keys:
        return df.orderBy(*order).limit(n)
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def failure_streak(
    runs: DataFrame, time: str = "ts_sec", tie: str = "run_id", floor: int = HOT_FLOOR, start: DataFrame | None = None
) -> DataFrame:
    """Add ``streak``: consecutive failures of the source up to and with each run.

    ``start`` (source, streak) gives the streaks the runs continue, one row per
    source of the fixed source list.

    There are only a few sources, so each large one is cut into even slices. Inside a
    slice the streak is a running count since the last success; a slice that has
    not seen a success yet continues the streak of the slices before, which comes
    from one short row per slice.
    """
    cut = with_segments(runs, ["source"], [time, tie], floor)
    ok = F.col("success")
    order = [time, tie]
    so_far = W.partitionBy("source", "_seg").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    cut = cut.withColumn("_wins", F.sum(ok).over(so_far))
    since = W.partitionBy("source", "_seg", "_wins").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    cut = cut.withColumn("_run", F.sum(1 - ok).over(since))

    # short rows: failures after the last success of a slice (all, if it has none)
    marks = cut.select("source", "_seg", "_hot", "success", F.struct(*order).alias("at")).filter("_hot")
    last_win = marks.groupBy("source", "_seg").agg(
        F.max(F.when(ok == 1, F.col("at"))).alias("win"), F.max(ok).alias("any_win")
    )
    tails = marks.join(F.broadcast(last_win), ["source", "_seg"]).groupBy("source", "_seg", "any_win").agg(
        F.count_if((ok == 0) & (F.col("win").isNull() | (F.col("at") > F.col("win")))).alias("tail")
    )
    by_seg = W.partitionBy("source").orderBy("_seg")
    tails = tails.withColumn("_group", F.sum("any_win").over(by_seg.rowsBetween(W.unboundedPreceding, 0)))
    chain = W.partitionBy("source", "_group").orderBy("_seg").rowsBetween(W.unboundedPreceding, 0)
    tails = tails.withColumn("_out", F.sum("tail").over(chain))
    carry = tails.select(
        "source", "_seg", F.lag("_out", 1, 0).over(by_seg).alias("_carry"),
        (F.lag("_group", 1, 0).over(by_seg) > 0).alias("_won"),
    )
    out = cut.join(F.broadcast(carry), ["source", "_seg"], "left")
    before = F.coalesce("_carry", F.lit(0))
    if start is not None:
        begun = start.select("source", F.col("streak").alias("_start"))
        out = out.join(F.broadcast(begun), "source", "left")
        before = before + F.when(F.coalesce("_won", F.lit(False)), 0).otherwise(F.coalesce("_start", F.lit(0)))
    return out.withColumn(
        "streak", (F.col("_run") + F.when(F.col("_wins") == 0, before).otherwise(0)).cast("bigint")
    ).drop("_seg", "_hot", "_wins", "_run", "_carry", "_won", "_start")


def run_alerts(runs_with_streak: DataFrame) -> DataFrame:
    """Alerts raised by each run, with their text."""
    src, n, secs = F.col("source"), F.col("n_listings"), F.col("duration_seconds")

    def alert(test: Column, rule: str, level: str, message: Column) -> Column:
        row = F.struct(F.lit(rule).alias("rule"), F.lit(level).alias("level"), message.alias("message"))
        return F.when(test, row)

    alerts = F.array(
        alert(
            F.col("streak") >= MAX_FAILURES, "failures", "critical",
            F.concat(src, F.lit(" has "), F.col("streak").cast("string"), F.lit(" consecutive failures")),
        ),
        alert(
            (F.col("success") == 1) & (n < MIN_LISTINGS), "yield", "warning",
            F.concat(src, F.lit(" yielded only "), n.cast("string"), F.lit(f" listings (min: {MIN_LISTINGS})")),
        ),
        alert(
            secs > MAX_SECONDS, "slow", "warning",
            F.concat(src, F.lit(" took "), secs.cast("string"), F.lit(f"s (max: {MAX_SECONDS}s)")),
        ),
    )
    return runs_with_streak.withColumn("a", F.explode(F.filter(alerts, lambda x: x.isNotNull()))).select(
        "source", "run_id", "ts", "a.level", "a.rule", "a.message"
    )


def source_table(spark: SparkSession) -> DataFrame:
    """The five known sources."""
    return spark.sql(f"SELECT explode(array({', '.join(repr(s) for s in SOURCES)})) AS source")


def scraper_health(runs: DataFrame) -> DataFrame:
    """Summary of all known sources; needs no ordered pass over the runs.

    The current streak is the number of failures after the last success.
    """
    at = F.struct("ts", "run_id")
    ok = F.col("success") == 1
    base = runs.groupBy("source").agg(
        F.max_by(F.struct("ts", "n_listings", "duration_seconds", "success"), at).alias("last"),
        F.count_if(ok).alias("total_success"),
        F.count_if(~ok).alias("total_failures"),
        F.coalesce(F.sum(F.when(ok, F.col("n_listings"))), F.lit(0)).alias("total_listings"),
        F.max(F.when(ok, at)).alias("win"),
    )
    known = source_table(runs.sparkSession)
    base = known.join(base, "source", "left")  # five rows
    failures = (
        runs.filter(~ok).join(F.broadcast(base.select("source", "win")), "source")
        .filter(F.col("win").isNull() | (at > F.col("win")))
        .groupBy("source").agg(F.count(F.lit(1)).alias("streak"))
    )
    out = base.join(failures, "source", "left").withColumn("streak", F.coalesce("streak", F.lit(0)))
    seen = F.col("last").isNotNull()
    status = (
        F.when(~seen, "no_data").when(F.col("streak") >= MAX_FAILURES, "critical")
        .when(F.col("last.success") == 0, "degraded").otherwise("healthy")
    )
    return out.select(
        "source", status.alias("status"), F.col("last.ts").alias("last_run"),
        F.col("last.n_listings").alias("last_count"), F.col("last.duration_seconds").alias("last_duration"),
        "total_success", "total_failures", "total_listings",
        F.when(seen, F.col("streak")).alias("consecutive_failures"),
    )
