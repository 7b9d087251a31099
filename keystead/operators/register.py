"""Rent-stabilized register: chunk union, cleaning, reload, address match."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.numbers import strip
from ..functions.permit_fields import bbl
from .skew import HOT_FLOOR, grid_join

# Columns of the published register and the defaults on load.
REGISTER_COLUMNS = (
    "ZIP", "BLDGNO1", "STREET1", "STSUFX1", "BLDGNO2", "STREET2", "STSUFX2", "CITY", "COUNTY",
    "STATUS1", "STATUS2", "STATUS3", "BLOCK", "LOT",
)
STORED_NAMES = {
    "ZIP": "zip_code", "BLDGNO1": "building_number", "STREET1": "street_name", "STSUFX1": "street_suffix",
    "BLDGNO2": "building_number_2", "STREET2": "street_name_2", "STSUFX2": "street_suffix_2",
    "CITY": "city", "COUNTY": "county_code", "STATUS1": "status1", "STATUS2": "status2",
    "STATUS3": "status3", "BLOCK": "block", "LOT": "lot", "BBL": "bbl",
}
DEFAULTS = {"building_number": "", "street_name": "", "city": "NEW YORK", "status1": "MULTIPLE DWELLING A"}
DEFAULT_COUNTY = 62


def union_register_chunks(chunks: list[DataFrame]) -> DataFrame:
    """Chunks with slightly different headers as one table of text columns."""
    parts = []
    for df in chunks:
        df = df.toDF(*[c.strip().upper().replace(" ", "") for c in df.columns])
        if not {"ZIP", "BLDGNO1"} <= set(df.columns):
            continue
        parts.append(
            df.select(*[
                (F.col(c) if c in df.columns else F.lit(None)).cast("string").alias(c) for c in REGISTER_COLUMNS
            ])
        )
    if not parts:
        raise ValueError("no chunk has the register columns")
    return reduce(DataFrame.unionByName, parts)


def clean_register(df: DataFrame) -> DataFrame:
    """Valid rows with trimmed text, whole-number block and lot, one row per BBL.

    The ZIP test runs on the raw text, so ' 10001' is dropped. Of rows with the
    same BBL the lowest (zip, number, street) stays.
    """
    df = df.filter(F.col("ZIP").rlike(r"^\d{5}$"))
    df = df.select(*[F.nullif(strip(F.col(c)), F.lit("")).alias(c) for c in df.columns])
    whole = {c: F.when(F.col(c).rlike(r"^[+-]?\d+$"), F.col(c).try_cast("int")) for c in ("COUNTY", "BLOCK", "LOT")}
    df = df.withColumns(whole).filter(F.col("BLOCK").isNotNull() & F.col("LOT").isNotNull())
    df = df.withColumn("BBL", bbl(F.col("BLOCK"), F.col("LOT")))
    return dedup(df, ["BBL"], ["ZIP", "BLDGNO1", "STREET1"])


def dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in the given order (cut before the shuffle)."""
    w = W.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in [*order, *df.columns] if c not in keys])
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def stored_register(df: DataFrame) -> DataFrame:
    out = df.withColumnsRenamed(STORED_NAMES)
    out = out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items()})
    return out.withColumn(
        "county_code", F.coalesce(F.nullif(F.col("county_code"), F.lit(0)), F.lit(DEFAULT_COUNTY))
    )


def reload_register(df: DataFrame, path: str, dry_run: bool = False) -> tuple[int, DataFrame]:
    """Replace the stored register; a dry run only counts. Returns count and sample."""
    out = stored_register(df)
    if not dry_run:
        out.write.mode("overwrite").parquet(path)
        out = out.sparkSession.read.parquet(path)
    return out.count(), out.limit(5)


def _tokens(c: Column) -> Column:
    return F.split(c, " ")


def register_match(
    listings: DataFrame, register: DataFrame, whole_token: bool = False, floor: int = HOT_FLOOR
) -> DataFrame:
    """Add ``hcr_match``: the address contains 'number street' of any building.

    A building key starts inside some word of the address: its first word is a
    suffix of that word and the next address word begins with the first letter of
    the key's second word. That pair is the equi-join key; a key with more than
    two words is looked up with its whole second word. ``contains`` then decides.
    Blanks before a key only ask for the begin of a word, which its whole first
    word finds too. The search runs over distinct addresses, so many copies of an
    address cost no more than one, and very common words are dealt to a grid of
    tasks. Keys without number or street are left out.
    """
    keys = (
        register.select(
            F.upper(F.concat("building_number", F.lit(" "), "street_name")).alias("needle"),
            (F.trim("building_number") != "").alias("ok1"), (F.trim("street_name") != "").alias("ok2"),
        )
        .filter("ok1 AND ok2").select("needle").distinct()
        .withColumn("t", _tokens(F.ltrim("needle")))
        .withColumn("long", (F.size("t") > 2) & (F.try_element_at("t", F.lit(3)) != ""))
        .select(
            "needle",
            F.when(F.col("long"), F.concat_ws(" ", F.col("t")[0], F.col("t")[1], F.substring(F.col("t")[2], 1, 1)))
            .otherwise(F.concat_ws(" ", F.col("t")[0], F.substring(F.col("t")[1], 1, 1))).alias("probe"),
        )
    )
    spaced = listings.select(F.upper("address").alias("addr")).filter(F.col("addr").contains(" ")).distinct()
    words = _tokens(F.col("addr"))
    at = spaced.withColumn("w", words).select(
        "addr", "w", F.explode(F.sequence(F.lit(0), F.size("w") - 2)).alias("i")
    )
    head = F.try_element_at("w", F.col("i") + 1)
    nxt = F.try_element_at("w", F.col("i") + 2)
    third = F.try_element_at("w", F.col("i") + 3)
    starts = F.sequence(F.lit(1), F.length("head"))
    at = at.withColumn("head", head).withColumn("nxt", nxt).withColumn("third", third).filter("head <> ''")
    if whole_token:
        starts = F.array(F.lit(1))
    at = at.withColumn("s", F.explode(starts)).withColumn("suffix", F.expr("substring(head, s)"))
    probes = at.select(
        "addr",
        F.explode(
            F.array(
                F.concat_ws(" ", "suffix", F.substring("nxt", 1, 1)),
                F.when(
                    F.col("third").isNotNull(),
                    F.concat_ws(" ", "suffix", "nxt", F.substring("third", 1, 1)),
                ),
            )
        ).alias("probe"),
    ).filter(F.col("probe").isNotNull())
    inside = F.col("addr").contains(F.col("needle"))
    if whole_token:
        inside = F.concat(F.lit(" "), F.col("addr"), F.lit(" ")).contains(
            F.concat(F.lit(" "), F.col("needle"), F.lit(" "))
        )
    hits = grid_join(probes.distinct(), keys, ["probe"], "addr", "needle", floor).filter(inside).select("addr").distinct()
    hits = hits.withColumn("hcr_match", F.lit(True))
    return (
        listings.withColumn("addr", F.upper("address")).join(hits, "addr", "left")
        .withColumn("hcr_match", F.coalesce("hcr_match", F.lit(False))).drop("addr")
    )
