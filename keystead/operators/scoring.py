"""Undervalue, rent-stabilization and quality scores as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.numbers import let, py_round, strip
from .comps import comps, with_comps
from .register import register_match

UNDERVALUE_FEATURES = (
    "price_vs_comp_median", "price_vs_comp_p25", "sqft_ppsf_ratio", "dom", "source_count", "bedrooms", "has_sqft",
)
RS_FEATURES = ("hcr_match", "building_age", "unit_count", "has_tax_abatement", "borough_manhattan", "zip_rs_density")

# Weights and words of the quality score, rules of the law.
QUALITY_WEIGHTS = {"photos": 0.25, "sqft": 0.15, "description": 0.25, "amenities": 0.20, "sources": 0.15}
FEATURE_WORDS = (
    "laundry", "dishwasher", "elevator", "doorman", "gym", "roof", "renovated", "natural light",
    "hardwood", "stainless", "granite", "marble", "closet", "storage", "parking", "pet", "balcony", "terrace",
)
RS_CUTOFF_YEAR = 1974
RS_MIN_UNITS = 6


def undervalue_features(df: DataFrame) -> DataFrame:
    """Ratios against the comps joined by ``with_comps``; rows without comps drop out."""
    price = F.col("price").cast("double")

    def ratio(comp: str) -> Column:
        return F.when(F.col(comp) > 0, price / F.col(comp)).otherwise(F.lit(1.0))

    known = (F.col("sqft") > 0) & (F.col("comp_avg_ppsf") > 0)
    return df.filter(F.col("comp_status") == "ok").select(
        "*",
        ratio("comp_median").alias("price_vs_comp_median"),
        ratio("comp_p25").alias("price_vs_comp_p25"),
        F.when(known, price / F.col("sqft") / F.col("comp_avg_ppsf")).otherwise(F.lit(0.0)).alias("sqft_ppsf_ratio"),
        F.coalesce(F.col("days_on_market").cast("double"), F.lit(0.0)).alias("dom"),
        F.coalesce(F.col("sqft") > 0, F.lit(False)).alias("has_sqft"),
    )


def undervalue_score(ratio: Column, ppsf: Column, dom: Column, source_count: Column) -> Column:
    """Heuristic 0-100 score; NULL when the source count is unknown."""
    above = F.greatest(F.lit(0.0), F.lit(30.0) * (F.lit(1.0) - (ratio - 1.0) / 0.3))
    below = F.least(F.lit(30.0) + (F.lit(1.0) - ratio) * 200, F.lit(90.0))
    base = F.when(ratio >= 1.0, above).otherwise(below)
    bonus = F.when((ppsf > 0) & (ppsf < 0.85), 10.0).when((ppsf > 0) & (ppsf < 0.95), 5.0).otherwise(0.0)
    penalty = F.when(dom > 30, F.least((dom - 30) * 0.3, F.lit(15.0))).otherwise(0.0)
    boost = F.least((source_count - 1) * 3.0, F.lit(10.0))
    score = base + bonus - penalty + boost
    clipped = F.greatest(F.lit(0.0), F.least(score, F.lit(100.0)))
    return F.when(source_count.isNotNull() & ratio.isNotNull(), py_round(clipped, 1))


def score_undervalue(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "undervalue_score",
        undervalue_score(
            F.col("price_vs_comp_median"), F.col("sqft_ppsf_ratio"), F.col("dom"), F.col("source_count")
        ),
    )


def _have(df: DataFrame, name: str, default: Column) -> Column:
    return F.coalesce(F.col(name), default) if name in df.columns else default


def rs_features(df: DataFrame, ref_year: int = 2024) -> DataFrame:
    """Rent-stabilization features; inputs a table lacks take their neutral value."""
    year = _have(df, "building_year", F.lit(0))
    return df.withColumns({
        "building_age": F.when(year > 1800, F.lit(ref_year) - year).otherwise(F.lit(0)).cast("int"),
        "unit_count": _have(df, "unit_count", F.lit(0)).cast("int"),
        "has_tax_abatement": _have(df, "has_tax_abatement", F.lit(False)),
        "borough_manhattan": F.coalesce(F.upper("borough").isin("MANHATTAN", "NEW YORK"), F.lit(False)),
        "zip_rs_density": _have(df, "zip_rs_density", F.lit(0.0)).cast("double"),
    })


def rs_probability(ref_year: int = 2024) -> Column:
    """Heuristic probability over the columns of ``rs_features``."""
    c = F.col
    old = (c("building_age") > 0) & (F.lit(ref_year) - c("building_age") < RS_CUTOFF_YEAR)
    many = c("unit_count") >= RS_MIN_UNITS

    def add(total: Column, test: Column, value: float) -> Column:
        return F.when(test, total + value).otherwise(total)

    p = add(F.lit(0.0), old, 0.30)
    p = add(p, old & many, 0.25)
    p = add(p, many, 0.10)
    p = add(p, c("has_tax_abatement"), 0.20)
    p = add(p, c("borough_manhattan"), 0.05)
    p = p + c("zip_rs_density") * 0.10
    return F.when(c("hcr_match"), F.lit(0.95)).otherwise(py_round(F.least(p, F.lit(0.95)), 3))


def _ramp(n: Column, good: int, excellent: int) -> Column:
    rise = F.lit(70.0) + F.lit(30.0) * (n - good) / float(excellent - good)
    return (
        F.when(n <= 0, 0.0).when(n >= excellent, 100.0).when(n >= good, rise).otherwise(F.lit(70.0) * n / float(good))
    )


def photo_score(n: Column) -> Column:
    return _ramp(n, 5, 12)


def amenity_score(n: Column) -> Column:
    return _ramp(n, 8, 15)


def sqft_score(sqft: Column) -> Column:
    return F.when(sqft.between(100, 10000), 100.0).when(sqft > 0, 80.0).otherwise(0.0)


def source_score(n: Column) -> Column:
    return F.when(n <= 0, 0.0).when(n == 1, 40.0).when(n == 2, 70.0).when(n == 3, 90.0).otherwise(100.0)


def description_score(description: Column) -> Column:
    """0-100 from length, sentences and feature words of the whole text.

    Trimmed and lower-cased forms of a long text are each made once.
    """

    def score(t: Column) -> Column:
        n = F.length(t)
        size = (
            F.when(n >= 800, 60.0)
            .when(n >= 300, F.lit(40.0) + F.lit(20.0) * (n - 300) / 500.0)
            .when(n >= 50, F.lit(40.0) * (n - 50) / 250.0)
            .otherwise(0.0)
        )
        hits = let(F.lower(t), lambda low: sum((low.contains(w).cast("int") for w in FEATURE_WORDS), F.lit(0)))
        quality = (
            F.when(t != F.upper(t), 10.0).otherwise(0.0)
            + F.when(t.rlike("[.!]"), 10.0).otherwise(0.0)
            + F.least(hits * 5.0, F.lit(20.0))
        )
        return F.when(F.coalesce(n, F.lit(0)) == 0, 0.0).otherwise(F.least(size + quality, F.lit(100.0)))

    return let(strip(description), score)


def quality_scores(df: DataFrame) -> DataFrame:
    """Five sub-scores and the total; needs photo_count, sqft, description, amenities, source_count."""
    parts = {
        "photos": photo_score(F.col("photo_count")),
        "sqft": sqft_score(F.col("sqft")),
        "description": description_score(F.col("description")),
        "amenities": amenity_score(F.coalesce(F.size("amenities"), F.lit(0))),
        "sources": source_score(F.col("source_count")),
    }
    raw = df.withColumns({f"_{k}": v for k, v in parts.items()})
    total = None
    for k, weight in QUALITY_WEIGHTS.items():
        term = F.lit(weight) * F.col(f"_{k}")
        total = term if total is None else total + term
    return raw.withColumns({
        **{f"{k}_score": py_round(F.col(f"_{k}"), 1) for k in parts},
        "quality_score": py_round(total, 1),
    }).drop(*[f"_{k}" for k in parts])


def score_all(listings: DataFrame, register: DataFrame) -> DataFrame:
    """Scores of all active listings in one plan: comps, undervalue, RS, quality.

    ``source_count`` NULL or 0 counts as 1 in the quality step only; photos are
    not stored yet and count 0. Listings without comps get a NULL undervalue
    score, which ``apply_scores`` leaves as it was.
    """
    active = listings.filter(F.col("status") == "active")
    # the quality score needs one row alone: it comes first, so that no text goes through the joins
    rated = quality_scores(active.withColumns({
        "photo_count": F.lit(0), "_own_sources": F.col("source_count"),
        "source_count": F.coalesce(F.nullif(F.col("source_count"), F.lit(0)), F.lit(1)),
    }))
    active = rated.withColumn("source_count", F.col("_own_sources")).drop("_own_sources", "description", "amenities")
    joined = with_comps(active, comps(active))
    ok = F.col("comp_status") == "ok"
    price = F.col("price").cast("double")
    ratio = F.when(F.col("comp_median") > 0, price / F.col("comp_median")).otherwise(F.lit(1.0))
    known = (F.col("sqft") > 0) & (F.col("comp_avg_ppsf") > 0)
    ppsf = F.when(known, price / F.col("sqft") / F.col("comp_avg_ppsf")).otherwise(F.lit(0.0))
    dom = F.coalesce(F.col("days_on_market").cast("double"), F.lit(0.0))
    scored = joined.withColumn("undervalue_score", F.when(ok, undervalue_score(ratio, ppsf, dom, F.col("source_count"))))
    scored = rs_features(register_match(scored, register)).withColumn("rs_probability", rs_probability())
    return scored.select("id", "undervalue_score", "rs_probability", "quality_score")


def apply_scores(listings: DataFrame, scores: DataFrame) -> DataFrame:
    """Write scores back; a NULL new score keeps the stored one."""
    names = ("undervalue_score", "rs_probability", "quality_score")
    new = scores.select("id", *[F.col(c).alias(f"_n_{c}") for c in names])
    return (
        listings.join(new, "id", "left")
        .withColumns({c: F.coalesce(f"_n_{c}", c) for c in names})
        .drop(*[f"_n_{c}" for c in names])
    )
