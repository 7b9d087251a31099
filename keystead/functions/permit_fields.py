"""Field decoding for permit feeds."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

from .numbers import strip

# County names, borough codes and date layouts of the feeds.
COUNTY_TO_BOROUGH = {
    "NEW YORK": "Manhattan", "KINGS": "Brooklyn", "QUEENS": "Queens",
    "BRONX": "Bronx", "RICHMOND": "Staten Island",
}
CODE_TO_BOROUGH = {
    "1": "Manhattan", "2": "Bronx", "3": "Brooklyn", "4": "Queens", "5": "Staten Island",
    "MANHATTAN": "Manhattan", "BRONX": "Bronx", "BROOKLYN": "Brooklyn",
    "QUEENS": "Queens", "STATEN ISLAND": "Staten Island",
}
BOROUGH_TO_CODE = {
    "MANHATTAN": "1", "BRONX": "2", "BROOKLYN": "3", "QUEENS": "4", "STATEN ISLAND": "5",
}
DATE_LAYOUTS = (
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6}$", "y-M-d'T'H:m:s.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d'T'H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
)


def _lookup(table: dict[str, str], key: Column, default: Column) -> Column:
    m = F.create_map(*[F.lit(x) for x in chain(*table.items())])
    return F.coalesce(F.try_element_at(m, key), default)


def borough_from_county(county: Column) -> Column:
    return _lookup(COUNTY_TO_BOROUGH, F.upper(county), county)


def borough_from_code(code: Column) -> Column:
    return _lookup(CODE_TO_BOROUGH, strip(F.upper(code)), code)


def borough_code(name: Column) -> Column:
    """Code of a borough name; an unknown name counts as code 1."""
    return _lookup(BOROUGH_TO_CODE, F.upper(name), F.lit("1"))


def parse_date(text: Column) -> Column:
    """First of four layouts that fits the whole text, else NULL."""
    tries = [
        F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout)))
        for shape, layout in DATE_LAYOUTS
    ]
    return F.coalesce(*tries)


def zfill(c: Column, width: int) -> Column:
    """Left-pad with zeros without ever cutting longer text."""
    t = c.cast("string")
    return F.when(F.length(t) >= width, t).otherwise(F.lpad(t, width, "0"))


def bbl(block: Column, lot: Column, borough: int = 1) -> Column:
    """Borough digit, five-digit block, four-digit lot."""
    return F.concat(F.lit(str(borough)), zfill(block, 5), zfill(lot, 4))
