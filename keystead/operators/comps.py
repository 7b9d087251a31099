"""Comparable-rent statistics and their hourly snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import py_round


def comps(listings: DataFrame) -> DataFrame:
    """Exact median, quartiles and averages per (neighborhood, bedrooms).

    Rows are folded to one per (neighborhood, bedrooms, price) before the
    percentiles, so a neighbourhood that holds a third of all listings reaches
    the final step as a short frequency table.
    """
    ok = listings.filter(
        (F.col("status") == "active") & (F.col("price") > 0) & F.col("neighborhood").isNotNull()
    )
    sized = F.col("sqft") > 0
    folded = ok.groupBy("neighborhood", "bedrooms", "price").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(sized).alias("n_sized"),
        F.sum(F.when(sized, F.col("sqft"))).alias("sum_sqft"),
        F.sum(F.when(sized, F.col("price").cast("double") / F.col("sqft"))).alias("sum_ppsf"),
    )
    n_sized = F.nullif(F.sum("n_sized"), F.lit(0))
    q = F.col("q")
    return (
        folded.groupBy("neighborhood", "bedrooms")
        .agg(
            F.percentile("price", F.array(F.lit(0.5), F.lit(0.25), F.lit(0.75)), F.col("n")).alias("q"),
            F.sum("n").alias("count"),
            (F.sum("sum_sqft") / n_sized).alias("sqft"),
            (F.sum("sum_ppsf") / n_sized).alias("ppsf"),
        )
        .select(
            "neighborhood",
            "bedrooms",
            py_round(q[0], 2).alias("median"),
            py_round(q[1], 2).alias("p25"),
            py_round(q[2], 2).alias("p75"),
            "count",
            py_round(F.col("sqft"), 1).alias("avg_sqft"),
            py_round(F.col("ppsf"), 2).alias("avg_ppsf"),
        )
    )


def comp_for(listings: DataFrame, neighborhood: str, bedrooms: int) -> DataFrame:
    """Statistics of one pair; the filter reaches the scan."""
    return comps(
        listings.filter((F.col("neighborhood") == neighborhood) & (F.col("bedrooms") == bedrooms))
    )


def comp_key(neighborhood: Column, bedrooms: Column) -> Column:
    return F.concat(
        F.lit("comps:"), neighborhood, F.lit(":"), F.coalesce(bedrooms.cast("string"), F.lit("None"))
    )


def with_comps(listings: DataFrame, stats: DataFrame) -> DataFrame:
    """Listings with the statistics of their pair; ``comp_status`` tells a miss.

    A NULL neighbourhood never matches; NULL bedrooms match the NULL group.
    The statistics hold one row per pair, so AQE may broadcast them when they
    are small and otherwise splits a hot pair of the listing side.
    """
    s = stats.select(
        F.col("neighborhood").alias("_nb"), F.col("bedrooms").alias("_bd"),
        F.col("median").alias("comp_median"), F.col("p25").alias("comp_p25"),
        F.col("p75").alias("comp_p75"), F.col("count").alias("comp_count"),
        F.col("avg_ppsf").alias("comp_avg_ppsf"),
    )
    cond = (listings["neighborhood"] == s["_nb"]) & listings["bedrooms"].eqNullSafe(s["_bd"])
    out = listings.join(s, cond, "left").drop("_nb", "_bd")
    return out.withColumn(
        "comp_status", F.when(F.col("comp_median").isNull(), "no_comps").otherwise("ok")
    )


def snapshot(stats: DataFrame, now: Column) -> DataFrame:
    """Statistics stamped with their time of computation."""
    return stats.withColumn("key", comp_key(F.col("neighborhood"), F.col("bedrooms"))).withColumn(
        "computed_at", now
    )


def refresh(snap: DataFrame, listings: DataFrame, now: Column, ttl_seconds: int = 3600) -> DataFrame:
    """Reuse statistics younger than the time limit, recompute the other pairs."""
    age = now.cast("double") - F.col("computed_at").cast("double")
    fresh = snap.filter(age < ttl_seconds)
    have = fresh.select(F.col("neighborhood").alias("_nb"), F.col("bedrooms").alias("_bd"))
    miss = listings.join(
        have, (listings["neighborhood"] == have["_nb"]) & listings["bedrooms"].eqNullSafe(have["_bd"]), "left_anti"
    )
    return fresh.unionByName(snapshot(comps(miss), now))
