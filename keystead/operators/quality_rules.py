"""Row validation, constraint reports and referential clean-up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _rule(test: Column) -> Column:
    """A rule holds only when its test is true; NULL breaks it."""
    return F.coalesce(test, F.lit(False))


def _optional(c: str, test: Column) -> Column:
    return F.col(c).isNull() | _rule(test)


def listing_rules() -> dict[str, Column]:
    c = F.col
    return {
        "price": _rule(c("price") > 0),
        "bedrooms": _rule(c("bedrooms") >= 0),
        "bathrooms": _rule(c("bathrooms") >= 0),
        "sqft": _optional("sqft", c("sqft") > 0),
    }


def filter_rules() -> dict[str, Column]:
    c = F.col
    return {
        "radius_miles": _optional("radius_miles", c("radius_miles") > 0),
        "min_score": _optional("min_score", c("min_score").between(0, 1)),
        "sort_order": _rule(c("sort_order").isin("asc", "desc")),
        "page": _rule(c("page") >= 1),
        "per_page": _rule(c("per_page").between(1, 100)),
    }


def user_rules() -> dict[str, Column]:
    return {"email": _rule(F.col("email").rlike(r"^[^@\s]+@[^@\s.]+(\.[^@\s.]+)+$"))}


def search_rules() -> dict[str, Column]:
    return {"name": _rule(F.length("name") <= 200)}


def with_reasons(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Add ``reasons``: names of the rules a row breaks."""
    broken = F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()])
    return df.withColumn("reasons", F.filter(broken, lambda r: r.isNotNull()))


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    tagged = with_reasons(df, rules)
    return tagged.filter(F.size("reasons") == 0).drop("reasons"), tagged.filter(F.size("reasons") > 0)


def constraint_report(df: DataFrame, unique: list[list[str]], max_length: dict[str, int]) -> DataFrame:
    """Violations per constraint: repeated keys (surplus rows) and over-long text."""
    spark = df.sparkSession
    parts = []
    for keys in unique:
        name = "unique(" + ",".join(keys) + ")"
        # NULL keys are never equal
        given = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        dup = df.filter(given).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        parts.append(dup.agg(F.lit(name).alias("rule"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")))
    if max_length:
        sums = df.agg(*[F.count_if(F.length(c) > n).alias(c) for c, n in max_length.items()])
        items = [F.struct(F.lit(f"length({c})").alias("rule"), F.col(c).alias("violations")) for c in max_length]
        parts.append(sums.select(F.explode(F.array(*items)).alias("r")).select("r.rule", "r.violations"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "rule string, violations bigint")


def enforce_fk(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str = "id", mode: str = "cascade"):
    """Clean-up after parents were deleted: drop orphans or clear their key."""
    keys = parent.select(F.col(parent_key).alias("_pk")).distinct()
    hit = child[child_key] == keys["_pk"]
    if mode == "cascade":
        return child.join(keys, hit, "left_semi")
    if mode == "set_null":
        return child.join(keys, hit, "left").withColumn(child_key, F.col("_pk")).drop("_pk")
    raise ValueError(mode)
