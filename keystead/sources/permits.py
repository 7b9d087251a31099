"""Permit feeds: flat and nested JSON rows, incremental read, insert-if-absent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from ..functions.numbers import safe_float, safe_int, strip
from ..functions.permit_fields import borough_from_code, borough_from_county, parse_date

# Field names of the two feeds.
FLAT_FIELDS = (
    "job__", "permit_si_no", "house__", "street_name", "borough", "permit_type", "residential",
    "estimated_job_cost", "filing_date", "issuance_date", "filing_status", "gis_latitude", "gis_longitude",
)
NESTED_FIELDS = (
    "permitNumber", "permitType", "residentialUnits", "estimatedCost", "filingDate", "approvalDate",
    "completionDate", "status",
)


def _text_struct(names) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


FLAT_SCHEMA = _text_struct(FLAT_FIELDS)
NESTED_SCHEMA = T.StructType([
    T.StructField("property", T.ArrayType(T.StructType([
        T.StructField("address", _text_struct(("oneLine", "countrySubd", "latitude", "longitude"))),
        T.StructField("building", T.StructType([
            T.StructField("permits", T.ArrayType(_text_struct(NESTED_FIELDS))),
        ])),
    ]))),
])


def _or_empty(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def parse_flat_permits(raw: DataFrame, json: str = "json") -> DataFrame:
    """Open-data rows (one JSON object per row) to permits."""
    r = raw.withColumn("r", F.from_json(json, FLAT_SCHEMA))
    return r.select(
        F.coalesce(F.nullif(_or_empty("r.job__"), F.lit("")), _or_empty("r.permit_si_no")).alias("permit_number"),
        strip(F.concat(_or_empty("r.house__"), F.lit(" "), _or_empty("r.street_name"))).alias("address"),
        borough_from_code(_or_empty("r.borough")).alias("borough"),
        _or_empty("r.permit_type").alias("permit_type"),
        safe_int(F.col("r.residential")).try_cast("int").alias("residential_units"),
        safe_int(F.col("r.estimated_job_cost")).alias("estimated_cost"),
        parse_date(F.col("r.filing_date")).alias("filing_date"),
        parse_date(F.col("r.issuance_date")).alias("approval_date"),
        F.lit(None).cast("timestamp").alias("completion_date"),
        _or_empty("r.filing_status").alias("status"),
        safe_float(F.col("r.gis_latitude")).alias("lat"),
        safe_float(F.col("r.gis_longitude")).alias("lng"),
        F.col(json).alias("raw_data"),
    )


def parse_nested_permits(raw: DataFrame, json: str = "json") -> DataFrame:
    """Property documents with nested permits, flattened; the address is shared."""
    p = (
        raw.withColumn("d", F.from_json(json, NESTED_SCHEMA))
        .select(F.explode("d.property").alias("prop"))
        .select("prop.address", F.explode("prop.building.permits").alias("p"))
    )
    return p.select(
        _or_empty("p.permitNumber").alias("permit_number"),
        _or_empty("address.oneLine").alias("address"),
        borough_from_county(_or_empty("address.countrySubd")).alias("borough"),
        _or_empty("p.permitType").alias("permit_type"),
        safe_int(F.col("p.residentialUnits")).try_cast("int").alias("residential_units"),
        safe_int(F.col("p.estimatedCost")).alias("estimated_cost"),
        parse_date(F.col("p.filingDate")).alias("filing_date"),
        parse_date(F.col("p.approvalDate")).alias("approval_date"),
        parse_date(F.col("p.completionDate")).alias("completion_date"),
        _or_empty("p.status").alias("status"),
        safe_float(F.col("address.latitude")).alias("lat"),
        safe_float(F.col("address.longitude")).alias("lng"),
        F.to_json("p").alias("raw_data"),
    )


def permits_since(df: DataFrame, recent: Column, order: list[Column], per_borough: int | None = None) -> DataFrame:
    """Permits of a run, those without a number left out; all of them unless the caller limits the newest per borough.

    With a limit, rows are ranked in every task first, so at most ``per_borough`` rows per task
    and borough are shuffled.
    """
    rows = df.filter(recent)
    if per_borough is not None:
        w = W.partitionBy("borough").orderBy(*order)
        rows = rows.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= per_borough).drop("_rn")
    return rows.filter(F.coalesce(F.col("permit_number"), F.lit("")) != "")


def new_permits(target: DataFrame, batch: DataFrame, order: list[Column]) -> DataFrame:
    """Batch rows whose number is neither stored nor met earlier in the batch.

    The location becomes NULL when either coordinate is missing or zero.
    """
    fresh = batch.join(target.select("permit_number"), "permit_number", "left_anti")
    w = W.partitionBy("permit_number").orderBy(*order)
    placed = (F.coalesce("lat", F.lit(0.0)) != 0) & (F.coalesce("lng", F.lit(0.0)) != 0)
    return (
        fresh.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
        .withColumns({"lat": F.when(placed, F.col("lat")), "lng": F.when(placed, F.col("lng"))})
    )


def ingest_counts(batch: DataFrame, fresh: DataFrame) -> DataFrame:
    """New permits and duplicates skipped, as a one-row table."""
    new = fresh.agg(F.count(F.lit(1)).alias("n")).scalar()
    return batch.agg(F.count(F.lit(1)).alias("all")).select(
        new.alias("new_permits"), (F.col("all") - new).alias("duplicates_skipped")
    )


def append_new_permits(path: str, batch: DataFrame, order: list[Column]) -> DataFrame:
    """Append the new permits of a batch to a stored table and report counts.

    The new rows are written first and counted from what was written, so the
    report stays right although the target changes.
    """
    spark = batch.sparkSession
    target = spark.read.parquet(path)
    before = target.count()
    new_permits(target, batch, order).select(*target.columns).write.mode("append").parquet(path)
    after = spark.read.parquet(path).count()
    return batch.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(after - before).alias("new_permits"), (F.col("n") - (after - before)).alias("duplicates_skipped")
    )
